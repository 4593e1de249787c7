"""Body poses: decoding, the fall rule, smoothing, alerts.

A pose row has corners x1..y2 and ``keypoints`` array<struct<x, y, conf>> in
the usual order of 17 body points (0-4 head, 5 and 6 shoulders, 11 and 12
hips, 13 and 14 knees, 15 and 16 ankles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYPOINTS = "array<struct<x:double,y:double,conf:double>>"


def decode_pose(raw: DataFrame, width: int, height: int, size: int = 640) -> DataFrame:
    """Corners and keypoints in the frame from cx, cy, w, h and keypoints in the padded square.

    Boxes and points are clipped to the frame; confidences stay.
    """
    scale = min(size / width, size / height)
    pad_x, pad_y = (size - round(width * scale)) // 2, (size - round(height * scale)) // 2
    x = lambda v: F.least(F.greatest((v - pad_x) / scale, F.lit(0.0)), F.lit(float(width)))
    y = lambda v: F.least(F.greatest((v - pad_y) / scale, F.lit(0.0)), F.lit(float(height)))
    cx, cy, w, h = (F.col(n) for n in ("cx", "cy", "w", "h"))
    return raw.withColumns(
        {
            "x1": x(cx - w / 2),
            "y1": y(cy - h / 2),
            "x2": x(cx + w / 2),
            "y2": y(cy + h / 2),
            "keypoints": F.transform(
                "keypoints", lambda k: F.struct(x(k["x"]).alias("x"), y(k["y"]).alias("y"), k["conf"].alias("conf"))
            ),
        }
    )


def _valid(places: Column, kp: float) -> Column:
    return F.size(F.filter(places, lambda k: k["conf"] >= kp))


def keypoint_counts(poses: DataFrame, kp: float = 0.5) -> DataFrame:
    """n_upper (points 0-10), n_lower (11-16) and n_total of confidence ``kp`` or more."""
    upper = _valid(F.slice("keypoints", 1, 11), kp)
    lower = _valid(F.slice("keypoints", 12, 6), kp)
    return poses.withColumns({"n_upper": upper, "n_lower": lower, "n_total": upper + lower})


def fall_score(
    poses: DataFrame, torso: float = 0.2, height: float = 0.3, aspect: float = 1.2, kp: float = 0.5
) -> DataFrame:
    """is_fallen, fall_confidence and fall_reason of each pose.

    Three signs are weighed: a torso near the horizontal, shoulders hardly
    above the legs, a box wider than high. Fewer than three valid points: not
    fallen. Column expressions only; a null among the corners or keypoints
    gives null or not fallen, never an error.
    """
    poses = keypoint_counts(poses, kp)
    point = lambda i: F.get("keypoints", F.lit(i))
    seen = lambda i: point(i)["conf"] >= kp
    x = lambda *i: sum((point(k)["x"] for k in i), F.lit(0.0)) / len(i)
    y = lambda *i: sum((point(k)["y"] for k in i), F.lit(0.0)) / len(i)
    box_w, box_h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def lean(top: tuple[int, ...], low: tuple[int, ...]) -> Column:
        """Slope of a shoulder-hip line, null where it cannot be told."""
        dx, dy = F.abs(x(*top) - x(*low)), F.abs(y(*top) - y(*low))
        known = F.lit(True)
        for i in (*top, *low):
            known = known & seen(i)
        return F.when(known & (dx > 1), dy / (dx + 1e-6))

    lines = {"left": lean((5,), (11,)), "right": lean((6,), (12,)), "mid": lean((5, 6), (11, 12))}
    legs = F.transform(
        F.filter(F.array(*(point(i) for i in (15, 16, 13, 14))), lambda k: k["conf"] >= kp), lambda k: k["y"]
    )
    standing = seen(5) & seen(6) & (F.size(legs) > 0) & (box_h >= 10)
    use_aspect = (F.col("n_upper") >= 2) & (F.col("n_lower") >= 3)
    # Each step reads the columns of the one before, so that no value is worked out twice.
    out = poses.withColumns({f"{side}_": slope for side, slope in lines.items()}).withColumns(
        {
            "flat_": F.array_min(F.filter(F.array(*(f"{side}_" for side in lines)), lambda s: s < torso)),
            "gap_": F.when(standing, (y(5, 6) - F.array_max(legs)) / box_h),
            "ratio_": F.when(use_aspect & (box_h >= 10), box_w / box_h),
            "weight_": F.when(use_aspect, 0.4).otherwise(0.5),
            "aspect_weight_": F.when(use_aspect, 0.2).otherwise(0.0),
        }
    )
    flat, gap, ratio = F.col("flat_"), F.col("gap_"), F.col("ratio_")
    side = F.coalesce(*(F.when(F.col(f"{name}_") == flat, name) for name in lines))
    out = out.withColumns(
        {
            "torso_": F.when(flat.isNotNull(), 1 - flat / torso).otherwise(0.0),
            "height_": F.when(gap > -height, F.least(F.lit(1.0), (gap + height) / 0.5)).otherwise(0.0),
            "aspect_": F.when(ratio > aspect, F.least(F.lit(1.0), (ratio - aspect) / 0.5)).otherwise(0.0),
            "reason_": F.array_join(
                F.array_compact(
                    F.array(
                        F.when(flat.isNotNull(), F.format_string("%s torso horizontal (slope=%.2f)", side, flat)),
                        F.when(gap > -height, F.format_string("height inverted (diff=%.2f)", gap)),
                        F.when(ratio > aspect, F.format_string("wide bbox (ratio=%.2f)", ratio)),
                    )
                ),
                "; ",
            ),
        }
    )
    signs = (("torso_", "weight_"), ("height_", "weight_"), ("aspect_", "aspect_weight_"))
    total = sum((F.when(F.col(c) > 0, F.col(w)).otherwise(0.0) for c, w in signs), F.lit(0.0))
    score = sum((F.col(c) * F.col(w) for c, w in signs), F.lit(0.0))
    out = out.withColumn("confidence_", F.when(total > 0, score / total).otherwise(0.0))
    enough = F.col("n_total") >= 3
    few = F.concat(F.lit("insufficient keypoints (total="), F.col("n_total").cast("string"), F.lit(", need>=3)"))
    out = out.withColumns(
        {
            "is_fallen": enough & (F.col("confidence_") > 0.5),
            "fall_confidence": F.when(enough, F.col("confidence_")).otherwise(0.0),
            "fall_reason": F.when(~enough, few).when(F.col("reason_") == "", "normal").otherwise(F.col("reason_")),
        }
    )
    return out.select(*poses.columns, "is_fallen", "fall_confidence", "fall_reason")


def smooth_falls(
    scores: DataFrame, n: int = 5, max_age_s: float = 2.0, ratio: float = 0.5, key: tuple[str, ...] = ("track_id",)
) -> DataFrame:
    """``smoothed``: the share of fallen rows among a track's last ``n`` not older than ``max_age_s``.

    Fewer than two such rows give the row's own flag. One bounded window per
    row over the track's order of time.
    """
    last = Window.partitionBy(*key).orderBy("ts").rowsBetween(-(n - 1), 0)
    rows = F.collect_list(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "is_fallen")).over(last)
    out = scores.withColumn("rows_", rows)
    now = F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = F.filter("rows_", lambda r: now - r["t"] <= int(max_age_s * 1_000_000))
    fallen = F.size(F.filter(fresh, lambda r: r["is_fallen"]))
    smoothed = F.when(F.size(fresh) < 2, F.col("is_fallen")).otherwise(fallen / F.size(fresh) >= ratio)
    return out.withColumn("smoothed", smoothed).drop("rows_")


def fall_alerts(falls: DataFrame, frame: tuple[str, ...] = ("stream_id", "frame_id")) -> DataFrame:
    """fallen_count and alert of each frame."""
    out = falls.groupBy(*frame).agg(F.count_if("is_fallen").alias("fallen_count"))
    return out.withColumn("alert", F.col("fallen_count") > 0)
