"""Who is and was there: presence snapshots over per-frame names and falls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perceptra.operators.asof import latest_state

_FALLS = "array<struct<identity:string,is_fallen:boolean>>"


def presence_events(names: DataFrame, stream: str = "stream_id") -> DataFrame:
    """(stream, frame_id, ts, names, falls) from long rows (stream, frame_id, ts, pos, name, is_fallen).

    Null names are dropped from names; they still count as unknown in falls.
    """
    row = F.struct("pos", "name", "is_fallen")
    frames = names.groupBy(stream, "frame_id").agg(F.min("ts").alias("ts"), F.array_sort(F.collect_list(row)).alias("r"))
    return frames.select(
        stream, "frame_id", "ts",
        F.transform(F.filter("r", lambda r: r["name"].isNotNull()), lambda r: r["name"]).alias("names"),
        F.transform("r", lambda r: F.struct(r["name"].alias("identity"), r["is_fallen"].alias("is_fallen"))).alias("falls"),
    )


def _named(name: Column) -> Column:
    return name.isNotNull() & (name != "") & (name != "unknown")


def presence_snapshot(
    events: DataFrame, as_of, recent_s: float | None = None, lookback_s: float = 10.0, cap: int = 300, stream: str = "stream_id"
) -> DataFrame:
    """One row per stream: who is there now and was there recently, as of a moment.

    Kept are a stream's last ``cap`` events not older than ``lookback_s``
    before its last one; recent are those from ``recent_s`` (the lookback if
    not given) before ``as_of``. now, unknown_now and the fallen of now come
    from the last event however old it is. recent_name_frames and
    fallen_frames are maps: frames of each name, fallen detections of each.
    """
    moment = F.unix_micros(F.lit(as_of).cast("timestamp"))
    return _snapshot(events.where(_micros("ts") <= moment), moment, [stream], recent_s, lookback_s, cap)


def presence_at(
    events: DataFrame, moments: DataFrame, recent_s: float | None = None, lookback_s: float = 10.0, cap: int = 300, stream: str = "stream_id"
) -> DataFrame:
    """``presence_snapshot`` of every (stream, as_of) of ``moments``, in one run: its columns and ``as_of``.

    Events meet the moments that they are recent for through time buckets of
    the recent span, two for a moment; the last event of a moment that has no
    recent one comes from one union and one window. Moments before a stream's
    first event give no row; repeated moments give one.
    """
    span = int((lookback_s if recent_s is None else recent_s) * 1_000_000)
    unit = max(1, span)
    asked = moments.select(stream, "as_of").where(F.col("as_of").isNotNull()).distinct().withColumn("m_", _micros("as_of"))
    event = ["ts", "frame_id", "names", "falls"]
    typed = events.select(stream, *event).withColumn("t_", _micros("ts"))
    slots = F.array(*(F.floor(F.col("m_") / unit) - i for i in (0, 1)))
    near = asked.withColumn("slot_", F.explode(slots)).join(typed.withColumn("slot_", F.floor(F.col("t_") / unit)), [stream, "slot_"])
    near = near.where((F.col("t_") <= F.col("m_")) & (F.col("t_") >= F.col("m_") - span)).select(stream, "as_of", "m_", *event)
    newest = typed.groupBy(stream, "t_").agg(F.max_by(F.struct(*event), "frame_id").alias("e_"))
    last = latest_state(asked.withColumn("t_", F.col("m_")), newest, ["e_"], [stream], "t_").where(_micros("e_.ts") < F.col("m_") - span)
    seen = near.unionByName(last.select(stream, "as_of", "m_", "e_.*"))
    return _snapshot(seen, F.col("m_"), [stream, "as_of"], recent_s, lookback_s, cap)


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _snapshot(seen: DataFrame, moment: Column, stream: list[str], recent_s: float | None, lookback_s: float, cap: int) -> DataFrame:
    """The snapshot of each key ``stream`` over its events up to its ``moment``."""
    micros = _micros
    latest_first = Window.partitionBy(*stream).orderBy(F.desc("ts"), F.desc("frame_id"))
    kept = seen.withColumn("n_", F.row_number().over(latest_first)).where(F.col("n_") <= cap)
    kept = kept.withColumn("t_", micros("ts"))
    last_t = F.max("t_").over(Window.partitionBy(*stream))
    kept = kept.withColumn("last_", last_t).where(F.col("t_") >= F.col("last_") - int(lookback_s * 1_000_000))
    start = moment - int((lookback_s if recent_s is None else recent_s) * 1_000_000)
    kept = kept.withColumn("recent_", F.col("t_") >= start)

    unknowns = F.size(F.filter("names", lambda n: n == "unknown"))
    fallen = F.filter("falls", lambda f: f["is_fallen"])
    fallen_named = F.transform(F.filter(fallen, lambda f: _named(f["identity"])), lambda f: f["identity"])
    frame = kept.select(
        *stream, "frame_id", "n_", "recent_",
        F.array_distinct(F.filter("names", _named)).alias("who"), unknowns.alias("unknowns"),
        fallen_named.alias("fallen_who"), (F.size(fallen) - F.size(fallen_named)).alias("fallen_unknown"),
        F.size(fallen).alias("fallen"),
    )
    now = frame.where("n_ = 1").select(
        *stream, F.array_sort("who").alias("now"), F.col("unknowns").alias("unknown_now"),
        F.array_sort(F.array_distinct("fallen_who")).alias("fallen_now"), F.col("fallen_unknown").alias("fallen_unknown_now"),
    )
    recent = frame.where("recent_").groupBy(*stream).agg(
        F.count(F.lit(1)).alias("frames_recent"),
        F.count_if(F.col("unknowns") > 0).alias("frames_with_unknown"),
        F.max("unknowns").alias("unknown_recent"),
        F.count_if(F.col("fallen") > 0).alias("frames_with_fall"),
    )

    def by_name(rows: DataFrame, alias: str) -> DataFrame:
        each = rows.groupBy(*stream, "name").agg(F.count(F.lit(1)).alias("n"))
        pairs = F.array_sort(F.collect_list(F.struct("name", "n")))
        return each.groupBy(*stream).agg(F.map_from_entries(pairs).alias(alias))

    names = by_name(frame.where("recent_").select(*stream, F.explode("who").alias("name")), "recent_name_frames")
    labels = F.concat("fallen_who", F.array_repeat(F.lit("unknown"), F.col("fallen_unknown")))
    falls = by_name(frame.where("recent_").select(*stream, F.explode(labels).alias("name")), "fallen_frames")
    out = now.join(recent, stream, "left").join(names, stream, "left").join(falls, stream, "left")
    count = F.size("fallen_now") + F.col("fallen_unknown_now")
    zero = {c: 0 for c in ("frames_recent", "frames_with_unknown", "unknown_recent", "frames_with_fall")}
    return out.fillna(zero).withColumn("fallen_count", count).withColumn("fall_alert", count > 0)


def fallen_recent(snapshot: DataFrame, stream: str = "stream_id") -> DataFrame:
    """(stream, identity, fallen_frames, total_frames): the total is the name's frames, else the fallen ones."""
    rows = snapshot.select(stream, "recent_name_frames", F.explode("fallen_frames").alias("identity", "fallen_frames"))
    total = F.when(F.col("identity") != "unknown", F.element_at("recent_name_frames", F.col("identity")))
    return rows.select(stream, "identity", "fallen_frames", F.coalesce(total, F.col("fallen_frames")).alias("total_frames"))


def single_face_ready(events: DataFrame, start, within_s: float = 15.0, stream: str = "stream_id") -> DataFrame:
    """(stream, ready_at): the first moment within ``within_s`` of ``start`` with exactly one face; null if none."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    begin = F.unix_micros(F.lit(start).cast("timestamp"))
    faces = F.size(F.array_distinct(F.filter("names", _named))) + F.size(F.filter("names", lambda n: n == "unknown"))
    ready = (faces == 1) & micros.between(begin, begin + int(within_s * 1_000_000))
    return events.groupBy(stream).agg(F.min(F.when(ready, F.col("ts"))).alias("ready_at"))


def who_report(snapshot: DataFrame, faces: DataFrame, unknowns: DataFrame, stream: str = "stream_id") -> DataFrame:
    """One row per stream: the snapshot, its faces by area, and unknown tracks with their seconds.

    faces: (stream, position, name); unknowns: (stream, track_id, seconds,
    area), as faces_by_area and unknown_durations give them for the latest
    frame. unknown_faces is null where a stream has none.
    """
    shown = faces.groupBy(stream).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda f: f["name"]).alias("faces")
    )
    order = F.struct((-F.col("area")).alias("a"), F.col("track_id").alias("track_id"), F.col("seconds").alias("seconds"))
    waiting = unknowns.groupBy(stream).agg(
        F.transform(
            F.array_sort(F.collect_list(order)),
            lambda u: F.struct(u["track_id"].alias("track_id"), u["seconds"].alias("seconds")),
        ).alias("unknown_faces")
    )
    return snapshot.join(shown, stream, "left").join(waiting, stream, "left")
