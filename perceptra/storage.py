"""The shared folder of a cluster, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written inside each ``scratch`` block that is open.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the driver and all executors see.

    Read from ``spark.checkpoint.dir``. Where that is unset a temporary folder
    is made and set, but only where driver and executors are one machine.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="perceptra-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def write_table(df: DataFrame) -> str:
    """Write ``df`` as Parquet in the shared folder; its path."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _OPEN:
        paths.append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: several readers share one pass."""
    path = write_table(df)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.table_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` gave, once nothing reads them any more."""
    for table in tables:
        _delete(table.sparkSession, table.table_path)


@contextmanager
def scratch(spark: SparkSession):
    """Delete at the end whatever tables were written inside."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.remove(paths)
        for path in paths:
            _delete(spark, path)
