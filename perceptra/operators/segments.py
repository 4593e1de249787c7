"""Sequential steps over sorted rows: a key's rows pass by in order and are never gathered.

Rows are dealt by key and sorted within partitions; Arrow batches of any cut
are read one after the other. A key of any length takes the memory of its state.
Where steps compose, ``cut_times`` and ``segmented`` deal the time of a large key
into parts of as many rows, whose results are carried on from part to part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _arrow(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def walk(
    rows: DataFrame, keys: list[str], order: list[str], fresh: Callable[[], Any],
    step: Callable[[Any, tuple], tuple | None], schema: str,
) -> DataFrame:
    """Each row in ``order`` through ``step(state, row)``, with a ``fresh`` state for every key; None gives no row."""
    kinds = _arrow(schema)
    places = [rows.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = state = None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = []
            for key, row in zip(zip(*(columns[p] for p in places), strict=True), zip(*columns, strict=True), strict=True):
                if state is None or key != at:
                    at, state = key, fresh()
                if (made := step(state, row)) is not None:
                    out.append(made)
            if out:
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


#: Parts that a key's time is cut into at most.
PARTS = 256


def cut_times(rows: DataFrame, keys: list[str], ts: str, segment_rows: int) -> DataFrame:
    """(keys..., edges): where to cut the times of the keys of over ``segment_rows`` rows, so that parts hold as many rows each.

    There are no more such keys than the rows divided by ``segment_rows``.
    """
    shares = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.percentile_approx(ts, shares, 10_000).alias("edges_"))
    step = F.greatest(F.lit(1), F.floor(PARTS * segment_rows / F.col("n_"))).cast("int")
    chosen = F.array_distinct(F.filter("edges_", lambda e, i: (i + 1) % step == 0))
    return sizes.where(F.col("n_") > segment_rows).select(*keys, chosen.alias("edges"))


def segmented(rows: DataFrame, keys: list[str], ts: str, edges: DataFrame) -> DataFrame:
    """``rows`` with ``seg_``, the number of their key's edges up to their time: 0 where a key has none. Rows of one moment are together."""
    part = F.coalesce(F.size(F.filter("edges_", lambda e: e <= F.col(ts))), F.lit(0))
    if keys:
        return rows.join(F.broadcast(edges.withColumnRenamed("edges", "edges_")), keys, "left").withColumn("seg_", part).drop("edges_")
    first = edges.first()
    known = F.array(*(F.lit(e) for e in first.edges)).cast(edges.schema["edges"].dataType) if first else F.lit(None).cast(edges.schema["edges"].dataType)
    return rows.withColumn("edges_", known).withColumn("seg_", part).drop("edges_")


def by_group(
    rows: DataFrame, keys: list[str], run: Callable[[pa.Table, list[tuple[int, int]]], pa.Table], schema: str | StructType
) -> DataFrame:
    """``run(table, groups)`` over whole small groups, such as frames: many of them in one table, as (start, end)."""
    kinds = _arrow(schema)
    places = [rows.columns.index(k) for k in keys]

    def cuts(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for p in places:
            values = table.column(p).to_pylist()
            change |= np.fromiter((a != b for a, b in zip(values, values[1:])), bool, len(change))
        return np.flatnonzero(change) + 1

    def all_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def flush(table, edges):
            found = run(table, list(zip(edges, edges[1:])))
            yield from found.cast(kinds).to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if not table.num_rows:
                continue
            edges = [0, *cuts(table).tolist()]
            if len(edges) > 1:
                yield from flush(table.slice(0, edges[-1]), edges)
            held = table.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from flush(held, [0, held.num_rows])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(all_groups, schema)
