"""Connected components over an edge table, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perceptra.llm.common import shared_dir


#: Parts that the links of one node are dealt into.
SPLITS = 32


def _smallest(pairs: DataFrame, node: str, other: str) -> DataFrame:
    """(node, other, least): ``least`` is the smallest neighbour of ``node``, itself included.

    The links of a node are dealt into parts by their other end, so that a hub
    is no single key: only the minima of its parts meet, and the least of them
    goes back to the parts that the node has, one for most nodes.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64(other), F.lit(SPLITS)).cast("int"))
    parts = dealt.groupBy(node, "part").agg(F.min(other).alias("least"))
    least = parts.groupBy(node).agg(F.least(F.min("least"), node).alias("least"), F.collect_list("part").alias("parts"))
    return dealt.join(least.select(node, "least", F.explode("parts").alias("part")), [node, "part"]).drop("part")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node of an edge with the smallest node it reaches.

    Large-star and small-star rounds in turn: a round is two aggregations and
    two joins over the edges, whose number never grows, and no group is
    gathered anywhere: a hub with any number of links is dealt into parts.
    Every round is checkpointed in the shared folder. Edges with a null end and loops are left out; no edges, no rows.
    """
    shared_dir(edges.sparkSession)
    now = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col("u") > F.col("v"))
        .distinct()
        .checkpoint()
    )
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _smallest(both, "u", "v")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .distinct()
        )
        joined = _smallest(large, "u", "v")
        small = joined.where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        roots = large.groupBy("u").agg(F.min("v").alias("v"))
        now = small.union(roots).where("u > v").distinct().checkpoint()
        state = now.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
