"""Connections: sessions from events, and routing of messages to open ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perceptra.operators.segments import cut_times, segmented
from perceptra.storage import materialise


def conn_sessions(events: DataFrame, timeout_s: float = 300.0) -> DataFrame:
    """(connection_id, started, ended, reason): from connect to the first disconnect or the timeout.

    reason is ``disconnect`` or ``timeout``. Each connect opens a session; a
    disconnect without one is ignored.
    """
    # In falling order the nearest later disconnect is the last one so far: one pass over a connection's events.
    later = Window.partitionBy("connection_id").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
    closed = F.last(F.when(F.col("event") == "disconnect", F.col("ts")), ignorenulls=True).over(later)
    rows = events.withColumn("closed_", closed).where("event = 'connect'")
    limit = F.col("ts") + F.make_dt_interval(secs=F.lit(timeout_s))
    return rows.select(
        "connection_id",
        F.col("ts").alias("started"),
        F.least(F.coalesce("closed_", limit), limit).alias("ended"),
        F.when(F.col("closed_") <= limit, "disconnect").otherwise("timeout").alias("reason"),
    )


def _open_spans(sessions: DataFrame) -> DataFrame:
    """(to_, started, ended): when each connection is open, sessions that overlap or touch as one."""
    spans = sessions.where("ended > started").select(F.col("connection_id").alias("to_"), "started", "ended")
    before = Window.partitionBy("to_").orderBy("started", "ended").rowsBetween(Window.unboundedPreceding, -1)
    apart = spans.withColumn("last_", F.max("ended").over(before)).withColumn("new_", F.coalesce((F.col("started") > F.col("last_")).cast("int"), F.lit(1)))
    so_far = Window.partitionBy("to_").orderBy("started", "ended").rowsBetween(Window.unboundedPreceding, 0)
    merged = apart.withColumn("span_", F.sum("new_").over(so_far)).groupBy("to_", "span_")
    return merged.agg(F.min("started").alias("started"), F.max("ended").alias("ended")).drop("span_")


def route_messages(messages: DataFrame, sessions: DataFrame, bucket: str = "hour", segment_rows: int = 100_000) -> DataFrame:
    """(message_id, connection_id, ts): where each message goes.

    A message with a connection_id is delivered if that connection is open
    (from started on, before ended); one without goes to every open
    connection. Broadcasts meet sessions through the time buckets that a
    session covers, not pair by pair; where they are many, time is also cut at
    the quantiles of the broadcasts, so that a busy bucket is dealt into parts
    of about ``segment_rows`` broadcasts, each of which meets the sessions open
    in it. Rows come out once: messages are made distinct and a connection's
    sessions merged before they meet, so that what is delivered, by far the
    largest table, leaves the join as it is.
    """
    messages = messages.select("message_id", "connection_id", "ts").distinct()
    spans = _open_spans(sessions)
    is_open = (F.col("ts") >= F.col("started")) & (F.col("ts") < F.col("ended"))
    to_all = messages.where("connection_id is null").select(F.col("message_id").alias("id_"), F.col("ts").alias("ts_"))
    direct = messages.where("connection_id is not null")
    direct = direct.join(to_all, F.col("message_id").eqNullSafe(F.col("id_")) & (F.col("ts") == F.col("ts_")), "left_anti")
    direct = direct.join(spans, F.col("connection_id") == F.col("to_")).where(is_open)
    unit = {"hour": 3600, "minute": 60}[bucket]
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / unit)
    everyone = messages.where("connection_id is null").withColumn("slot_", slot("ts"))
    edges = materialise(cut_times(everyone, [], "ts", segment_rows))
    kind = everyone.schema["ts"].dataType
    covered = spans.withColumn("slot_", F.explode(F.sequence(slot("started"), slot("ended"))))
    limits = (F.timestamp_seconds(F.col("slot_") * unit), F.timestamp_seconds((F.col("slot_") + 1) * unit))
    covered = covered.withColumns({"low_": F.greatest(F.col("started"), limits[0].cast(kind)), "high_": F.least(F.col("ended"), limits[1].cast(kind))})
    covered = segmented(segmented(covered, [], "low_", edges).withColumnRenamed("seg_", "from_"), [], "high_", edges)
    covered = covered.withColumn("seg_", F.explode(F.sequence("from_", "seg_"))).select("to_", "started", "ended", "slot_", "seg_")
    # A merge join gives each message its sessions in one order for all of a part: columns that files compress well.
    met = segmented(everyone, [], "ts", edges).join(covered.hint("merge"), ["slot_", "seg_"]).where(is_open)
    columns = ["message_id", F.col("to_").alias("connection_id"), "ts"]
    return direct.select(*columns).unionByName(met.select(*columns))
