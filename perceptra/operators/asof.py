"""Latest state at each row: one union and one window instead of a self-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perceptra.operators.segments import cut_times, segmented
from perceptra.storage import materialise


def merge_streams(*feeds: DataFrame) -> DataFrame:
    """Feeds as one, columns that a feed lacks being null."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def latest_state(
    rows: DataFrame, states: DataFrame, values: list[str], key: list[str], ts: str = "ts", inclusive: bool = True
) -> DataFrame:
    """``rows`` with the last non-null ``values`` of their key at their time, null before any.

    A state of the same moment counts as earlier when ``inclusive``. The union
    is sorted once per key; nothing is joined.
    """
    tagged = merge_streams(
        states.select(*key, ts, *values, F.lit(0 if inclusive else 2).alias("kind_")),
        rows.withColumn("kind_", F.lit(1)),
    )
    before = Window.partitionBy(*key).orderBy(ts, "kind_").rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged.withColumns({v: F.last(v, ignorenulls=True).over(before) for v in values})
        .where("kind_ = 1")
        .drop("kind_")
    )


def config_asof(
    frames: DataFrame, changes: DataFrame, defaults: dict[str, float], key: list[str] | None = None, segment_rows: int = 1_000_000
) -> DataFrame:
    """Frames with one column per setting: its latest value at the frame's time, else the default.

    Changes are rows (key..., ts, config_key, config_value); unknown settings
    are ignored. Without a ``key`` the changes hold for all frames. The time of
    a key (or of all frames) with over ``segment_rows`` frames is cut into
    parts of as many frames; the last value of each setting is carried from
    part to part, a row for each, so that no task sorts more than a part.
    """
    settings, keys = list(defaults), list(key or [])
    wide = {s: F.when(F.col("config_key") == s, F.col("config_value")) for s in settings}
    known = changes.where(F.col("config_key").isin(*settings)).withColumns(wide).select(*keys, "ts", *settings)
    edges = materialise(cut_times(frames.select(*keys, "ts"), keys, "ts", segment_rows))
    known, rows = segmented(known, keys, "ts", edges), segmented(frames, keys, "ts", edges)
    part = [*keys, "seg_"]
    own = known.groupBy(*part).agg(*(F.max_by(s, F.when(F.col(s).isNotNull(), F.col("ts"))).alias(s) for s in settings))
    parts = rows.select(*part).distinct().join(own, part, "full")
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("seg_").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    carried = parts.select(*part, *(F.last(s, ignorenulls=True).over(before).alias(f"{s}_") for s in settings))
    found = latest_state(rows, known, settings, part).join(carried, part, "left")
    filled = {s: F.coalesce(s, f"{s}_", F.lit(v)) for s, v in defaults.items()}
    return found.withColumns(filled).drop("seg_", *(f"{s}_" for s in settings)).select(*frames.columns, *(s for s in settings if s not in frames.columns))
