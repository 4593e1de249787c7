"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perceptra.storage import discard, materialise, scratch, shared_dir

__all__ = ["arrow_rows", "by_size", "discard", "give_back", "join_hot", "materialise", "scratch", "shared_dir", "small", "table"]

#: Only glibc has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what runs inside; for steps whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return freed memory, Arrow's and the allocator's, to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def small(batches, rows: int = 1000):
    """The Arrow batches in slices of at most ``rows`` rows, so that few Python objects live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def by_size(batches, most: int = 8 << 20):
    """The Arrow batches in slices of about ``most`` bytes, one row at least, with no empty slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(np.diff(_offsets(c)) for c in batch.columns if _is_long(c.type))
        ends = np.cumsum(np.broadcast_to(sizes, batch.num_rows))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def _is_long(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_binary(kind)


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def join_hot(left: DataFrame, keyed: DataFrame, right: DataFrame, keys: list[str], size: Column, most: int = 64 << 20) -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique, where single keys may hold a large part of ``left``.

    A key that holds 1/500 of ``keyed`` (the rows of ``left``, or what they
    come from) is hot: there are 500 at most. Their rows of ``right`` go to
    the executors if they take ``most`` bytes or less by ``size`` and what
    the columns hold; all other keys meet by an exchange, and so do the hot ones
    if they are larger.
    """
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"))
    total = keyed.count()
    hot = materialise(counts.where((F.col("n_") * 500 >= total) & (F.col("n_") > 1)).select(*keys))
    large = materialise(right.join(F.broadcast(hot), keys, "left_semi"))
    held = large.agg(F.sum(size + 64)).first()[0]
    if not held or held > most:
        return left.join(right, keys)
    rest = left.join(F.broadcast(hot), keys, "left_anti").join(right, keys)
    return left.join(F.broadcast(large), keys).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
