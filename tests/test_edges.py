"""Empty input, nulls, boundaries, sources, models and streams."""

import base64
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from perceptra.functions import text
from perceptra.operators import detections, gallery, models, pose, speech, telemetry, tracks
from perceptra.sources import gallery_files, messages, vector_files
from perceptra.streaming import stateful

BOX = "stream_id long, frame_id long, det_idx long, x1 double, y1 double, x2 double, y2 double, score double"


def test_empty_tables(spark):
    none = spark.createDataFrame([], BOX)
    assert detections.nms(none).count() == 0
    assert detections.top_area(none, 3).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, label string, embedding array<float>")
    assert gallery.identity_centroids(vectors).count() == 0
    assert gallery.match_gallery(vectors, gallery.identity_centroids(vectors)).count() == 0


def test_confidence_boundary_and_null(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 1.0, 1.0, s) for s in (0.5, 0.4999, None)], BOX)
    assert [r.score for r in detections.filter_confidence(rows, 0.5).collect()] == [0.5]


def test_nearest_by_blocks_equals_broadcast(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)], "id long, embedding array<double>")
    asked = rows.where("id % 7 = 0")
    one = gallery.nearest(asked, "id", rows.withColumnRenamed("id", "other"), "other", 3)
    many = gallery.nearest(asked, "id", rows.withColumnRenamed("id", "other"), "other", 3, broadcast_bytes=0)
    key = lambda r: (r.id, r.rank)
    same = lambda rows: [(r.id, r.other, r.rank, round(r.score, 9)) for r in sorted(rows, key=key)]
    assert same(one.collect()) == same(many.collect())


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
@pytest.mark.parametrize("k", [1, 2, 5])
def test_nearest_leaves_out_odd_vectors(spark, broadcast_bytes, k):
    """NaN, infinite and null components, empty and null vectors and other lengths: neither best match nor failure."""
    nan, inf = float("nan"), float("inf")
    good = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.6, 0.8], 4: [1.0, 0.0, 0.0]}
    odd = {5: [nan, 1.0], 6: [inf, 0.0], 7: [None, 1.0], 8: [], 9: None, 10: [-inf, nan]}
    rows = [(i, v) for i, v in {**good, **odd}.items()]
    left = spark.createDataFrame(rows, "id long, embedding array<double>")
    right = spark.createDataFrame(rows, "other long, embedding array<double>")
    found = gallery.nearest(left, "id", right, "other", k, broadcast_bytes=broadcast_bytes).collect()
    expected = set()
    for i, v in good.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good.items() if len(w) == len(v))
        expected |= {(i, j, n + 1) for n, (_, j) in enumerate(scores[:k])}
    assert {(r.id, r.other, r["rank"]) for r in found} == expected
    named = gallery.match_gallery(left, right.toDF("label", "centroid"), 0.5, "id").collect()
    assert {r.id: r.label for r in named} == {1: "1", 2: "2", 3: "3", 4: "4"}


def test_unique_names(spark):
    rows = spark.createDataFrame([("ann", 3), ("ann", 1), ("bob", 2), ("ann", 7)], "name string, position long")
    assert {(r.position, r.unique_name) for r in gallery.unique_names(rows).collect()} == {(1, "ann"), (3, "ann_1"), (7, "ann_2"), (2, "bob")}


def test_too_few_keypoints(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0, 9.0, 9.0, [(1.0, 1.0, 0.9)] * 2 + [(1.0, 1.0, 0.1)] * 15)],
                                 f"i long, x1 double, y1 double, x2 double, y2 double, keypoints {pose.KEYPOINTS}")
    found = pose.fall_score(rows).first()
    assert (found.is_fallen, found.fall_confidence, found.fall_reason) == (False, 0.0, "insufficient keypoints (total=2, need>=3)")


def test_texts(spark):
    rows = spark.createDataFrame([("ann (0.72)",), ("ann? (0.62)",), (" (x)",), (None,)], "s string")
    assert [r[0] for r in rows.select(text.strip_score(F.col("s"))).collect()] == ["ann", "ann", " (x)", None]
    long = spark.createDataFrame([("a" * 150 + "b" * 150,)], "s string").select(text.preview(F.col("s"), 100)).first()[0]
    assert long == "a" * 30 + "..." + "b" * 30
    with pytest.raises(ValueError):
        text.preview(F.col("s"), 41)


def test_vector_file(spark, tmp_path):
    good, bad = tmp_path / "v.f32", tmp_path / "bad.f32"
    good.write_bytes(struct.pack("<12f", *range(12)))
    bad.write_bytes(b"123456789")
    rows = vector_files.read_vectors_f32(spark, str(good), 4).orderBy("row_id").collect()
    assert [(r.row_id, r.embedding) for r in rows] == [(i, [4.0 * i + k for k in range(4)]) for i in range(3)]
    assert vector_files.read_vectors_f32(spark, str(tmp_path / "none"), 4).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        vector_files.read_vectors_f32(spark, str(bad), 4).count()


def test_gallery_folder(spark, tmp_path):
    for name in ("ann/raw/a.jpg", "ann/aligned/a.JPEG", "bob/raw/b.PNG", "bob/other/c.jpg"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    (tmp_path / "cat" / "aligned").mkdir(parents=True)  # an identity without images
    found = gallery_files.scan_gallery(spark, str(tmp_path)).collect()
    counts = gallery.identity_counts(gallery_files.scan_gallery(spark, str(tmp_path)), identities=gallery_files.scan_identities(spark, str(tmp_path)))
    assert {tuple(r) for r in counts.collect()} == {("ann", 0, 1), ("bob", 0, 1), ("cat", 0, 0)}
    assert gallery_files.scan_identities(spark, str(tmp_path / "none")).count() == 0
    assert {(r.label, r.kind, r.stem, r.ext) for r in found} == {("ann", "raw", "a", "jpg"), ("bob", "raw", "b", "PNG")}


def test_refresh_gallery(spark):
    files = spark.createDataFrame([("b", "aligned", "y", "jpg"), ("a", "aligned", "x", "jpg")], "label string, kind string, stem string, ext string")
    items = spark.createDataFrame([("a/aligned/x.jpg", "a", 0)], "path string, label string, row_id long")
    vectors = spark.createDataFrame([(0, [1.0, 0.0])], "row_id long, embedding array<double>")
    embed = lambda work: work.withColumn("embedding", F.array(F.lit(0.0), F.lit(2.0)))
    new_items, new_vectors, centroids = gallery.refresh_gallery(files, items, vectors, embed)
    assert {(r.path, r.row_id) for r in new_items.collect()} == {("a/aligned/x.jpg", 0), ("b/aligned/y.jpg", 1)}
    assert new_vectors.count() == 2
    assert {r.label: [round(x, 6) for x in r.centroid] for r in centroids.collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}


def test_schemas_and_topic(spark, tmp_path):
    assert len(messages.MESSAGES) == 38
    for name in messages.MESSAGES:
        messages.message_schema(name)
    spark.createDataFrame([(((1, 500), "f"), 1, 2, ("{}",))], messages.message_schema("AudioStatus")).write.parquet(str(tmp_path / "t"))
    row = telemetry.decode_enums(telemetry.normalise_header(messages.read_topic(spark, str(tmp_path / "t"), "AudioStatus"))).first()
    assert (row.status_mic_name, row.status_speaker_name) == ("READY", "ACTIVE")
    assert messages.read_topic(spark, str(tmp_path / "t"), "AudioStatus", streaming=True).isStreaming


def test_models(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    found = {r.id: r.embedding for r in models.embed_text(rows, load, "id").collect()}
    assert found[1] == pytest.approx([10 / 101**0.5, 1 / 101**0.5], abs=1e-5) and len(found[2]) == 2

    def images():
        return lambda content: [None if c == b"bad" else np.array([3.0, 4.0]) for c in content]

    pictures = spark.createDataFrame([(1, b"ok"), (2, b"bad")], "id long, content binary")
    assert [(r.id, [round(x, 5) for x in r.embedding]) for r in models.embed_images(pictures, images, "id").collect()] == [(1, [0.6, 0.8])]

    def model():
        return lambda items, prompt: f"{prompt} {sum(items)}" if items else 1 / 0

    groups = spark.createDataFrame([(1, [1, 2]), (2, [])], "id long, items array<long>")
    found = {r.id: (r.reply, r.error) for r in models.apply_model(groups, model, "sum").collect()}
    assert found[1] == ("sum 3", None) and found[2][0] is None and "ZeroDivisionError" in found[2][1]
    packed = base64.b64encode(struct.pack("<2f", 1.5, -2.0)).decode()
    rows = spark.createDataFrame([(1, packed), (2, None)], "id long, embedding_b64 string")
    assert {r.id: r.embedding for r in models.unpack_embeddings(rows, "id").collect()} == {1: [1.5, -2.0], 2: None}


def replay(spark, df, tmp_path, build, schema, parts=3):
    """The rows of a stream over ``df``, in order, in several batches, across a restart."""
    source, out, state = (str(tmp_path / n) for n in ("source", "out", "state"))
    rows = df.orderBy("ts").collect()
    for i in range(parts):
        own = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(own, df.schema).coalesce(1).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source))
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination(120)
    return spark.read.schema(schema).parquet(out)


def test_gate_as_a_stream(spark, sf_dir, tmp_path):
    from perceptra.operators.asof import merge_streams
    from perceptra.plans.fixtures import fixture

    chunks = fixture(spark, sf_dir, "audio_chunks").where("stream_id < 4")
    status = fixture(spark, sf_dir, "speaker_status").where("stream_id < 4").select("stream_id", "ts", "status_speaker")
    merged = merge_streams(chunks, status).withColumn("ts", F.col("ts").cast("timestamp"))
    found = replay(spark, merged, tmp_path, lambda s: stateful.gate_audio(s, idle_ms=10**10), "stream_id long, ts timestamp, chunk_id long")
    expected = speech.gate_audio(chunks, status)
    assert {r.chunk_id for r in found.collect()} == {r.chunk_id for r in expected.collect()}


def test_smoothing_as_a_stream(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id < 4").select(
        F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("is_fallen")
    )
    build = lambda s: stateful.smooth_falls(s, max_age_s=86_400.0, idle_ms=10**10)
    found = replay(spark, rows, tmp_path, build, "track_id long, ts timestamp, is_fallen boolean, smoothed boolean")
    expected = pose.smooth_falls(rows, max_age_s=86_400.0)
    assert {(r.track_id, r.ts, r.smoothed) for r in found.collect()} == {(r.track_id, r.ts, r.smoothed) for r in expected.collect()}


def test_identities_step_equals_batch(spark):
    rule = tracks.IdentityRule()
    step, state, out = stateful.identity_step(rule), {}, []
    rows = [(0, f, 1, 10.0 + f * 0.2, 0.0, 0.0, 9.0, 9.0, "ann" if f % 4 else "bob", 0.3 + 0.05 * (f % 7)) for f in range(30) if f != 12]
    for r in rows:
        out.append(step(state, dict(stream_id=0, track_id=1, frame_id=r[1], seconds=r[3], best_label=r[8], sim=r[9])))
    schema = "stream_id long, frame_id long, track_id long, ts double, x1 double, y1 double, x2 double, y2 double, best_label string, sim double"
    batch = tracks.track_identities(spark.createDataFrame(rows, schema)).orderBy("frame_id").collect()
    assert [(r.shown, r.status, r.name) for r in batch] == [(r["shown"], r["status"], r["name"]) for r in out]


def test_sticky_rates_as_a_stream(spark, sf_dir, tmp_path):
    from perceptra.plans.fixtures import fixture

    sent = fixture(spark, sf_dir, "messages").where("stream_id < 4").withColumn("ts", F.col("ts").cast("timestamp"))
    build = lambda s: stateful.parse_remote_audio(s, idle_ms=10**10)
    found = replay(spark, sent, tmp_path, build, "stream_id long, ts timestamp, audio binary, rate int, language_code string")
    expected = speech.parse_remote_audio(sent)
    row = lambda r: (r.stream_id, r.ts, bytes(r.audio), r.rate, r.language_code)
    assert sorted(map(row, found.collect())) == sorted(map(row, expected.where("audio is not null").collect()))


def test_eviction_as_a_stream(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id < 4").select(
        F.lit(0).cast("long").alias("stream_id"), F.col("user_id").cast("long").alias("track_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    build = lambda s: stateful.evict_stale(s, 36_000.0, idle_ms=10**10)
    found = replay(spark, rows, tmp_path, build, "stream_id long, track_id long, ts timestamp, episode long")
    expected = tracks.evict_stale(rows, 36_000.0)
    row = lambda r: (r.track_id, r.ts, r.episode)
    assert sorted(map(row, found.collect())) == sorted(map(row, expected.collect()))


def test_rechunking_as_a_stream(spark, sf_dir, tmp_path):
    from perceptra.plans.fixtures import fixture

    rows = fixture(spark, sf_dir, "audio_chunks").where("stream_id < 4").select(
        F.col("stream_id").cast("long").alias("stream_id"), F.lit(0).cast("long").alias("connection"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"), F.repeat(F.lpad(F.col("chunk_id").cast("string"), 8, "0"), 3).cast("binary").alias("payload"),
    )
    build = lambda s: stateful.rechunk_audio(s, 20, idle_ms=10**10)
    found = replay(spark, rows, tmp_path, build, "stream_id long, connection long, seq long, ts timestamp, chunk binary")
    expected = speech.rechunk_audio(rows, 20)
    row = lambda r: (r.stream_id, r.seq, bytes(r.chunk))
    assert sorted(map(row, found.collect())) == sorted(map(row, expected.collect())) != []
