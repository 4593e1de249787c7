"""Latency histograms and moving averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perceptra.operators.segments import cut_times, segmented, walk
from perceptra.storage import materialise

BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


def latency_metrics(observations: DataFrame, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(model, le_0 ..., sum, count, last): observations up to each bound, cumulative, and the newest value."""
    up_to = [F.count_if(F.col("seconds") <= b).alias(f"le_{i}") for i, b in enumerate(buckets)]
    return observations.groupBy("model").agg(
        *up_to, F.sum("seconds").alias("sum"), F.count("seconds").alias("count"), F.max_by("seconds", "ts").alias("last")
    )


def batch_latency(batches: DataFrame) -> DataFrame:
    """Milliseconds per item of a batch: embed and total to 2 places, search to 3."""
    per = lambda c, places: F.round(F.col(c) / F.col("batch_size"), places).alias(c)
    return batches.select("batch_id", per("embed_ms", 2), per("search_ms", 3), per("total_ms", 2))


def ema(rows: DataFrame, alpha: float = 0.1, key: str = "stream_id", value: str = "value", segment_rows: int = 1_000_000) -> DataFrame:
    """``ema`` in order of ts: the first value, then (1 - alpha) * before + alpha * value.

    A null value leaves it as it is. A key's rows pass by in order and only
    the last average is held. The time of a key of over ``segment_rows`` rows
    is cut into parts: each part starts with its own first value v, which a
    carried average c then shifts by (1 - alpha) ** i * (c - v) at its i-th
    value, and parts hand on their last average, a row for each part.
    """
    kind = dict(rows.dtypes)
    keep = 1 - alpha
    own = rows.select(key, "ts", value)
    edges = materialise(cut_times(own, [key], "ts", segment_rows))
    hot = not edges.isEmpty()
    dealt = segmented(own, [key], "ts", edges) if hot else own.withColumn("seg_", F.lit(0))

    def step(state, row):
        if (v := row[2]) is not None:
            state[:] = [v if not state else keep * state[0] + alpha * v, state[1] if state else v, state[2] + 1 if state else 1]
        return (*row, *(state or (None, None, 0)))

    schema = f"{key} {kind[key]}, ts {kind['ts']}, {value} {kind[value]}, seg_ int, ema double, first_ double, i_ long"
    walked = walk(dealt, [key, "seg_"], ["ts"], list, step, schema)
    if not hot:
        return walked.select(key, "ts", value, "ema")
    walked = materialise(walked)
    shifted = lambda e, i, c, v: e + F.pow(F.lit(keep), i) * (c - v)
    parts = walked.groupBy(key, "seg_").agg(F.max("i_").alias("n"), F.max_by("ema", "i_").alias("last"), F.max_by("first_", "i_").alias("first"))
    parts = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seg_", "n", "last", "first"))).alias("parts"))

    def carry(done, part):
        last = F.when(part["n"] == 0, done["c"]).when(done["c"].isNull(), part["last"])
        last = last.otherwise(shifted(part["last"], part["n"], done["c"], part["first"]))
        return F.struct(last.alias("c"), F.concat(done["out"], F.array(F.struct(part["seg_"].alias("seg_"), done["c"].alias("c")))).alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("c"), F.array().cast("array<struct<seg_:int,c:double>>").alias("out"))
    carried = parts.select(key, F.explode(F.aggregate("parts", start, carry)["out"]).alias("p")).select(key, "p.seg_", F.col("p.c").alias("c_"))
    out = walked.join(carried.where("c_ is not null"), [key, "seg_"], "left")
    value_ = F.when(F.col("c_").isNull(), F.col("ema")).when(F.col("i_") == 0, F.col("c_"))
    return out.select(key, "ts", value, value_.otherwise(shifted(F.col("ema"), F.col("i_"), F.col("c_"), F.col("first_"))).alias("ema"))
