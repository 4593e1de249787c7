"""Face and pose detections: decoding, geometry, suppression, ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perceptra.functions.boxes import Box, area, corners, grown, grown_pixels
from perceptra.operators.segments import by_group

FRAME = ("stream_id", "frame_id")


def filter_confidence(dets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Detections that score ``threshold`` or more; a null score goes."""
    return dets.where(F.col("score") >= threshold)


def _centre(cells: DataFrame, size: int, anchors: int, shift: float) -> tuple[Column, Column]:
    place = F.floor(F.col("cell_idx") / anchors)
    across = F.floor(F.lit(size) / F.col("stride"))
    return (place % across + shift) * F.col("stride"), (F.floor(place / across) + shift) * F.col("stride")


def decode_anchor_boxes(cells: DataFrame, size: int = 640, anchors: int = 2) -> DataFrame:
    """Corner columns of each cell from its distances l, t, r, b in strides; centres have no half-cell offset."""
    cx, cy = _centre(cells, size, anchors, 0.0)
    s = F.col("stride")
    return cells.withColumns(
        {"x1": cx - F.col("l") * s, "y1": cy - F.col("t") * s, "x2": cx + F.col("r") * s, "y2": cy + F.col("b") * s}
    )


def decode_anchor_keypoints(cells: DataFrame, size: int = 640, anchors: int = 2) -> DataFrame:
    """``points`` array<struct<x, y>> of each cell from ``kps``, x and y in turn as offsets in strides."""
    cx, cy = _centre(cells, size, anchors, 0.0)
    s = F.col("stride")
    count = F.floor(F.size("kps") / 2).cast("int")
    at = lambda i: F.struct(
        (cx + F.get("kps", i * 2) * s).alias("x"), (cy + F.get("kps", i * 2 + 1) * s).alias("y")
    )
    empty = F.array().cast("array<struct<x:double,y:double>>")
    return cells.withColumn("points", F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(empty))


def decode_best_anchor_boxes(
    cells: DataFrame, size: int = 640, anchors: int = 2, top: int = 150, threshold: float = 0.5
) -> DataFrame:
    """The batch detector's decoding: one box per cell, from its best anchor.

    Scores of a (frame, stride) level go through a sigmoid if any lies outside
    [0, 1]. Of a cell's anchors the best stays (ties: the lower). Distances
    count in strides only where the median of the level's distances is below
    12. Then scores of ``threshold`` or more stay, ``top`` per level.
    """
    level = Window.partitionBy("frame_id", "stride")
    out = cells.withColumn("low_", F.min("score").over(level)).withColumn("high_", F.max("score").over(level))
    raw = (F.col("low_") < 0) | (F.col("high_") > 1)
    out = out.withColumn("score", F.when(raw, 1 / (1 + F.exp(-F.col("score")))).otherwise(F.col("score")))
    cell = Window.partitionBy("frame_id", "stride", F.floor(F.col("cell_idx") / anchors)).orderBy(F.desc("score"), "cell_idx")
    out = out.withColumn("n_", F.row_number().over(cell)).where("n_ = 1")
    sides = F.explode(F.array("l", "t", "r", "b"))
    medians = (
        out.select("frame_id", "stride", sides.alias("d")).groupBy("frame_id", "stride").agg(F.percentile("d", 0.5).alias("m_"))
    )
    out = out.join(medians, ["frame_id", "stride"])
    unit = F.when(F.col("m_") < 12, F.col("stride")).otherwise(1)
    cx, cy = _centre(cells, size, anchors, 0.5)
    out = out.where(F.col("score") >= threshold).withColumns(
        {
            "x1": cx - F.col("l") * unit,
            "y1": cy - F.col("t") * unit,
            "x2": cx + F.col("r") * unit,
            "y2": cy + F.col("b") * unit,
        }
    )
    best = Window.partitionBy("frame_id", "stride").orderBy(F.desc("score"), "cell_idx")
    out = out.withColumn("n_", F.row_number().over(best)).where(F.col("n_") <= top)
    return out.drop("low_", "high_", "n_", "m_")


def unletterbox(dets: DataFrame, mode: str, width: int, height: int, size: int = 640) -> DataFrame:
    """Boxes in the resized square back to the frame of ``width`` x ``height``.

    ``top_left``: divide by the scale of the rounded new height; no clipping.
    ``centered_int``: off the padding, clip to the last pixel, truncate, and
    drop boxes with a side below 8. ``centered_clip``: clip to the frame.
    """
    if mode == "top_left":
        scale = min(size, round(size * (height / width))) / height
        return dets.withColumns({n: F.col(n) / scale for n in ("x1", "y1", "x2", "y2")})
    scale = min(size / width, size / height)
    pad_x, pad_y = (size - round(width * scale)) // 2, (size - round(height * scale)) // 2
    less = 1 if mode == "centered_int" else 0
    if mode not in ("centered_int", "centered_clip"):
        raise ValueError(f"no such mode: {mode}")
    clip = lambda v, pad, most: F.least(F.greatest((v - pad) / scale, F.lit(0.0)), F.lit(float(most - less)))
    out = dets.withColumns(
        {n: clip(F.col(n), *((pad_x, width) if n[0] == "x" else (pad_y, height))) for n in ("x1", "y1", "x2", "y2")}
    )
    if less:
        out = out.withColumns({n: F.col(n).cast("int") for n in ("x1", "y1", "x2", "y2")})
        out = out.where(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= 8)
    return out


def expand_clip_box(dets: DataFrame, width: int, height: int, margin: float = 0.25) -> DataFrame:
    """Corner columns as whole pixels of the box grown about its centre, within the frame."""
    new = grown_pixels(corners(), F.lit(width), F.lit(height), margin)
    return dets.withColumns(dict(zip(("x1", "y1", "x2", "y2"), new, strict=True)))


def expand_box(dets: DataFrame, margin: float = 0.25) -> DataFrame:
    """Corner columns of the box grown by ``margin`` of its size on each side."""
    return dets.withColumns(dict(zip(("x1", "y1", "x2", "y2"), grown(corners(), margin), strict=True)))


def suppressed(boxes: np.ndarray, scores: np.ndarray, order_ids: np.ndarray, limit: float, plus_one: bool) -> np.ndarray:
    """Places of the boxes that greedy suppression keeps, by falling score, ties to the lower id."""
    order = np.lexsort((order_ids, -scores))
    one = 1.0 if plus_one else 0.0
    sides = np.clip(boxes[:, 2:] - boxes[:, :2] + one, None, None)
    sizes = sides[:, 0] * sides[:, 1]
    keep = []
    while len(order):
        first, rest = order[0], order[1:]
        keep.append(first)
        low = np.maximum(boxes[first, :2], boxes[rest, :2])
        high = np.minimum(boxes[first, 2:], boxes[rest, 2:])
        both = np.prod(np.clip(high - low + one, 0, None), axis=1)
        order = rest[both / (sizes[first] + sizes[rest] - both + 1e-9) <= limit]
    return np.array(keep, np.int64)


def nms(
    dets: DataFrame, limit: float = 0.4, plus_one: bool = True, frame: tuple[str, ...] = FRAME, id_column: str = "det_idx"
) -> DataFrame:
    """Greedy non-maximum suppression per frame: boxes over ``limit`` with a better kept one go.

    A frame is a few dozen rows, so its rows are brought together; frames are
    spread by one shuffle on the frame's key and handled many at a time.
    """

    def run(table, frames):
        boxes = np.stack([table.column(n).to_numpy() for n in ("x1", "y1", "x2", "y2")], axis=1).astype(float)
        scores, ids = table.column("score").to_numpy().astype(float), table.column(id_column).to_numpy()
        keep = [a + np.sort(suppressed(boxes[a:b], scores[a:b], ids[a:b], limit, plus_one)) for a, b in frames]
        return table.take(pa.array(np.concatenate(keep)))

    return by_group(dets, list(frame), run, dets.schema)


def _first(dets: DataFrame, k: int, frame: tuple[str, ...], *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*frame).orderBy(*order))
    return dets.withColumn("rank_", rank).where(F.col("rank_") <= k).drop("rank_")


def top_center_area(dets: DataFrame, k: int, width: int, height: int, frame: tuple[str, ...] = FRAME) -> DataFrame:
    """The ``k`` boxes of a frame that are large and near its centre; all when ``k`` is 0."""
    if k <= 0:
        return dets
    x1, y1, x2, y2 = corners()
    off = F.pow((x1 + x2) / 2 - width // 2, 2) + F.pow((y1 + y2) / 2 - height // 2, 2)
    return _first(dets, k, frame, (area(corners()) - 2.0 * off).desc(), F.col("det_idx"))


def top_area(dets: DataFrame, k: int, frame: tuple[str, ...] = FRAME) -> DataFrame:
    """The ``k`` largest boxes of a frame; all when ``k`` is 0."""
    return dets if k <= 0 else _first(dets, k, frame, area(corners()).desc(), F.col("det_idx"))


def top_score_area(dets: DataFrame, k: int, frame: tuple[str, ...] = FRAME) -> DataFrame:
    """The ``k`` boxes of a frame with the highest score times area, an area below 1 counting as 1."""
    worth = F.col("score") * F.greatest(area(corners()), F.lit(1.0))
    return dets if k <= 0 else _first(dets, k, frame, worth.desc(), F.col("det_idx"))


def cap_by_score(
    dets: DataFrame, per_level: int = 150, most: int = 100, limit: float = 0.4, frame: tuple[str, ...] = ("frame_id",)
) -> DataFrame:
    """The batch detector's cascade: best per level, best per frame, suppression, best per frame."""
    order = (F.desc("score"), F.col("cell_idx"))
    out = _first(dets, per_level, (*frame, "stride"), *order)
    out = _first(out, max(per_level * 3, most * 4), frame, *order)
    out = nms(out, limit, plus_one=True, frame=frame, id_column="cell_idx")
    return _first(out, most, frame, *order)


def faces_by_area(tracks: DataFrame, frame: tuple[str, ...] = FRAME) -> DataFrame:
    """``position`` from 1 by falling area, ties to the lower track_id."""
    order = Window.partitionBy(*frame).orderBy(area(corners()).desc(), "track_id")
    return tracks.withColumn("position", F.row_number().over(order))


def largest_face(dets: DataFrame, exactly_one: bool = False, frame: tuple[str, ...] = FRAME) -> DataFrame:
    """The largest box of each frame (ties: the lower det_idx); with ``exactly_one`` only of frames with one box."""
    row = F.struct(*dets.columns)
    best = dets.groupBy(*frame).agg(
        F.max_by(row, F.struct(area(corners()).alias("a"), (-F.col("det_idx")).alias("i"))).alias("row_"),
        F.count(F.lit(1)).alias("n_"),
    )
    return (best.where("n_ = 1") if exactly_one else best).select("row_.*")
