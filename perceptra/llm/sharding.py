"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows lie in parts of bounded size. How many rows part p sends to shard s is
drawn for all p and s at once: the matrix has the parts' counts as row sums
and the shards' sizes as column sums, and each row is a multivariate
hypergeometric draw from what the rows before have left. A part then permutes
its rows and cuts them by its row of the matrix, the rows are exchanged, and
each shard permutes what it received.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perceptra.llm.common import materialise

_LARGE = 900_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good`` + ``bad`` are good; exact sums of any size.

    Above what numpy draws itself, by inversion outwards from the mode.
    """
    if draws == 0 or good == 0:
        return 0
    if bad == 0 or draws == good + bad:
        return min(draws, good)
    if good + bad < _LARGE:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    up = down = mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p_up = p_down = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(total, draws))
    left = rng.random() - p_up
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            if (left := left - p_up) <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            if (left := left - p_down) <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """Counts with the given row and column sums, as a uniform shuffle would have them."""
    rng = np.random.default_rng(seed)
    left = [int(c) for c in columns]
    out = np.zeros((len(rows), len(columns)), np.int64)
    for i, draws in enumerate(map(int, rows)):
        rest = sum(left)
        for j, here in enumerate(left):
            rest -= here
            out[i, j] = hypergeometric(rng, here, rest, draws)
            left[j] -= int(out[i, j])
            draws -= int(out[i, j])
    return out


def shuffle_into_shards(
    docs: DataFrame, shards: int = 40, seed: int = 42, part_rows: int = 50_000
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    The law is ``rows``: the counts of any two shards differ by one at most.
    size is the text's UTF-8 bytes plus 16. A null text counts as empty in
    both size and checksum; repeated rows and rows with a null doc_id are dealt
    like any other; further columns are not read; an empty table gives no rows.

    Only ids, sizes and checksums move. The driver sees one count per part of
    about ``part_rows`` rows and draws the matrix from them; the local
    permutations are orders by a seeded hash within parts, and within ranges
    of that hash for the slots, so no task holds a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row_"),
        )
    )
    n = rows.count()
    parts = max(1, -(-n // part_rows))
    rows = rows.withColumn("part_", F.pmod(F.xxhash64("row_", F.lit(seed)), F.lit(parts)).cast("int"))
    counts = {r.part_: r.n for r in rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], sizes, seed)
    edges = rows.sparkSession.createDataFrame(
        [(p, [int(x) for x in np.cumsum(matrix[p])]) for p in range(parts)], "part_ int, edges_ array<long>"
    )
    first = F.row_number().over(Window.partitionBy("part_").orderBy(F.xxhash64("row_", F.lit(seed + 1)), "row_"))
    dealt = (
        rows.withColumn("rank_", first.cast("long"))
        .join(edges, "part_")
        .withColumn("shard", F.size(F.filter("edges_", lambda e: e < F.col("rank_"))).cast("int"))
    )
    ranges = max(1, -(-n // (shards * part_rows)))
    second = F.xxhash64("row_", F.lit(seed + 2))
    dealt = materialise(
        dealt.select("doc_id", "size", "text_crc32", "shard", "row_", second.alias("order_")).withColumn(
            "range_",
            F.least(F.floor(F.shiftrightunsigned("order_", 1) / float(1 << 63) * ranges).cast("int"), F.lit(ranges - 1)),
        )
    )
    held = dealt.groupBy("shard", "range_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("shard").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("shard", "range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    within = F.row_number().over(
        Window.partitionBy("shard", "range_").orderBy(F.shiftrightunsigned("order_", 1), "order_", "row_")
    )
    return (
        dealt.withColumn("within_", within)
        .join(starts, ["shard", "range_"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("start_") + F.col("within_") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
