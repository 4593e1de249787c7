"""The float32 vector source: ranges, row ids, folders, failures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perceptra.sources import vector_files


def rows(df):
    return [(r.row_id, r.embedding) for r in df.orderBy("row_id").collect()]


def test_ranges_keep_the_records_places(spark, tmp_path):
    data = np.arange(105, dtype="<f4").reshape(21, 5)
    (tmp_path / "v.f32").write_bytes(data.tobytes())
    for path in (f"{tmp_path}/v.f32", f"file:{tmp_path}/v.f32", f"file://{tmp_path}/v.f32"):
        found = vector_files.read_vectors_f32(spark, path, 5, rows=4)
        assert found.rdd.getNumPartitions() == 6
        assert rows(found) == [(i, v.tolist()) for i, v in enumerate(data)]
    plan = vector_files.read_vectors_f32(spark, path, 5)._jdf.queryExecution().toString()
    assert "RDD" not in plan


def test_written_folder_reads_back_in_order(spark, tmp_path):
    vectors = spark.range(1000).select("id", F.array(*(F.col("id") * k for k in (1, 2, 3))).alias("embedding"))
    path = f"file:{tmp_path}/store"
    vector_files.write_vectors_f32(vectors.repartition(5).orderBy("id"), path, 3)
    expected = [(i, [float(i * k) for k in (1, 2, 3)]) for i in range(1000)]
    assert rows(vector_files.read_vectors_f32(spark, path, 3, rows=64)) == expected
    vector_files.write_vectors_f32(vectors.where("id < 2").orderBy("id"), path, 3)
    assert rows(vector_files.read_vectors_f32(spark, path, 3)) == expected + [(1000 + i, v) for i, v in [e for e in expected[:2]]]
    vector_files.write_vectors_f32(vectors.where("id < 2").orderBy("id"), path, 3, "overwrite")
    assert rows(vector_files.read_vectors_f32(spark, path, 3)) == expected[:2]


def test_partial_records_and_odd_vectors_fail(spark, tmp_path):
    (tmp_path / "bad.f32").write_bytes(b"x" * 41)
    with pytest.raises(Exception, match="no whole number of records"):
        vector_files.read_vectors_f32(spark, f"{tmp_path}/bad.f32", 5).count()
    for odd in ([1.0], [1.0, None], None):
        vectors = spark.createDataFrame([([1.0, 2.0],), (odd,)], "embedding array<double>")
        with pytest.raises(Exception, match="has not 2 components"):
            vector_files.write_vectors_f32(vectors.coalesce(1), f"{tmp_path}/store", 2)
        assert vector_files.read_vectors_f32(spark, f"{tmp_path}/store", 2).count() == 0


def test_nothing_there(spark, tmp_path):
    (tmp_path / "empty.f32").write_bytes(b"")
    for name in ("none", "empty.f32", ""):
        assert vector_files.read_vectors_f32(spark, f"{tmp_path}/{name}", 5).count() == 0
