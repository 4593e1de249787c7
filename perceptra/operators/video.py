"""Frames: messages, blurring, batching, rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perceptra.operators.segments import walk


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def parse_frames(messages: DataFrame, column: str = "message") -> DataFrame:
    """``frame`` (binary): base64 of an object's ``frame``, else of the whole message.

    JSON that is no object goes, and what is no base64 once foreign characters are left out.
    """
    m = F.col(column)
    other = F.try_parse_json(m).isNotNull() & ~F.ltrim(m).startswith("{")
    payload = F.regexp_replace(F.coalesce(F.get_json_object(m, "$.frame"), m), "[^A-Za-z0-9+/=]", "")
    out = messages.where(m.isNotNull() & ~other).withColumn("frame", F.try_to_binary(payload, F.lit("base64")))
    return out.where((F.length(payload) % 4 == 0) & F.col("frame").isNotNull()).drop(column)


def select_blur(faces: DataFrame, mode: str, recognition: bool = True) -> DataFrame:
    """``blur``: all, known or unknown faces; a missing is_known counts as false; without recognition all."""
    known = F.coalesce("is_known", F.lit(False))
    rule = {"all": F.lit(True), "known": known, "unknown": ~known}.get(mode, F.lit(False))
    return faces.withColumn("blur", rule if recognition else F.lit(True))


def filter_frame_size(frames: DataFrame, width: int, height: int) -> DataFrame:
    return frames.where((F.col("width") == width) & (F.col("height") == height))


def to_bgr(frames: DataFrame) -> DataFrame:
    """Pixels in blue-green-red order: rgb8 is swapped, bgr8 kept; other encodings and wrong sizes go."""
    sized = F.octet_length("data") == F.col("width") * F.col("height") * 3
    chosen = frames.where(F.col("encoding").isin("rgb8", "bgr8") & sized)
    place = frames.columns.index("data")
    code = frames.columns.index("encoding")

    def run(batches):
        for batch in batches:
            out = [
                np.frombuffer(d, np.uint8).reshape(-1, 3)[:, ::-1].tobytes() if e == "rgb8" else d
                for d, e in zip(batch.column(place).to_pylist(), batch.column(code).to_pylist(), strict=True)
            ]
            columns = list(batch.columns)
            columns[place], columns[code] = pa.array(out, pa.binary()), pa.array(["bgr8"] * len(out))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return chosen.mapInArrow(run, frames.schema)


def pixelate(image: np.ndarray, boxes: list, blocks: int, margin: float, noise: float, rng: np.random.Generator) -> np.ndarray:
    """``image`` with each box, grown by ``margin``, in squares; ``blocks`` 0 or less fills it white."""
    out = image.copy()
    height, width = image.shape[:2]
    for x1, y1, x2, y2 in boxes:
        x1, y1, x2, y2 = int(x1), int(y1), int(x2), int(y2)
        cx, cy = (x1 + x2) * 0.5, (y1 + y2) * 0.5
        half_w, half_h = (x2 - x1) * (1 + margin) * 0.5, (y2 - y1) * (1 + margin) * 0.5
        left, top = max(0, int(cx - half_w)), max(0, int(cy - half_h))
        right, bottom = min(width - 1, int(cx + half_w)), min(height - 1, int(cy + half_h))
        w, h = right - left, bottom - top
        if w < 2 or h < 2:
            continue
        if blocks <= 0:
            out[top:bottom, left:right] = 255
            continue
        short = min(w, h)
        new_w, new_h = max(1, round(w * blocks / short)), max(1, round(h * blocks / short))
        rows, cols = np.arange(new_h) * h // new_h, np.arange(new_w) * w // new_w
        small = out[top:bottom, left:right][rows][:, cols]
        big = small[np.arange(h) * new_h // h][:, np.arange(w) * new_w // w]
        if noise > 0:
            big = np.clip(big + rng.normal(0, noise, big.shape), 0, 255).astype(np.uint8)
        out[top:bottom, left:right] = big
    return out


def pixelate_frames(
    frames: DataFrame, boxes: DataFrame, blocks: int = 8, margin: float = 0.25, noise: float = 0.0,
    max_faces: int | None = None, seed: int = 0, key: tuple[str, ...] = ("stream_id", "frame_id"),
) -> DataFrame:
    """Frames (raw three-byte pixels) with their boxes made unrecognisable.

    With ``max_faces``, the highest scores are blurred; noise is seeded by the
    frame, so a task that runs again gives the same pixels.
    """
    if max_faces is not None:
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "det_idx"))
        boxes = boxes.withColumn("n_", rank).where(F.col("n_") <= max_faces)
    lists = boxes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("det_idx", "x1", "y1", "x2", "y2"))).alias("boxes_"))
    columns = frames.columns
    joined = frames.join(lists, list(key), "left").select(*columns, "boxes_", F.xxhash64(*key, F.lit(seed)).alias("seed_"))
    at = {c: columns.index(c) for c in ("data", "width", "height")}

    def run(batches):
        for batch in batches:
            out = []
            n = len(columns)
            rows = [batch.column(i).to_pylist() for i in (at["data"], at["width"], at["height"], n, n + 1)]
            for data, width, height, own, own_seed in zip(*rows, strict=True):
                image = np.frombuffer(data, np.uint8).reshape(height, width, 3)
                corners = [(b["x1"], b["y1"], b["x2"], b["y2"]) for b in own or []]
                rng = np.random.default_rng(own_seed & 0xFFFFFFFF)
                out.append(pixelate(image, corners, blocks, margin, noise, rng).tobytes())
            kept = list(batch.columns[:n])
            kept[at["data"]] = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays(kept, columns)

    return joined.mapInArrow(run, frames.schema)


def fps_estimate(frames: DataFrame, n: int = 60, initial: float = 30.0, key: str = "stream_id") -> DataFrame:
    """``fps`` over the last ``n`` frames, between 5 and 60; ``initial`` where it cannot be told."""
    last = Window.partitionBy(key).orderBy("ts").rowsBetween(-(n - 1), 0)
    t = _micros("ts")
    count, span = F.count(F.lit(1)).over(last), (F.max(t).over(last) - F.min(t).over(last)) / 1e6
    rate = F.least(F.greatest((count - 1) / span, F.lit(5.0)), F.lit(60.0))
    return frames.withColumn("fps", F.when((count < 2) | (span <= 0), F.lit(initial)).otherwise(rate))


class RateWatch:
    """When a writer would restart for a changed frame rate: it depends on its own last restart."""

    def __init__(self, every: float = 5.0, change: float = 0.3, current: float = 30.0):
        self.every, self.change, self.current, self.checked = every, change, current, None

    def step(self, t: float, fps: float) -> bool:
        if self.checked is None:
            self.checked = t
            return False
        if t - self.checked <= self.every:
            return False
        self.checked = t
        if abs(fps - self.current) / self.current <= self.change:
            return False
        self.current = fps
        return True


def fps_change_points(frames: DataFrame, every_s: float = 5.0, change: float = 0.3, initial: float = 30.0, key: str = "stream_id") -> DataFrame:
    """(key, ts, fps) of the frames at which the rate in use changes.

    Each check depends on the one before: a stream's estimates pass by in
    order and only the rate watch is held.
    """
    rated = fps_estimate(frames, initial=initial, key=key)
    kind = dict(frames.dtypes)[key]
    rows = rated.select(key, "ts", (_micros("ts") / 1e6).alias("t"), "fps")

    def step(watch, row):
        at, ts, t, fps = row
        return (at, ts, fps) if watch.step(t, fps) else None

    schema = f"{key} {kind}, ts {dict(frames.dtypes)['ts']}, fps double"
    return walk(rows, [key], ["t"], lambda: RateWatch(every_s, change, initial), step, schema)


def batch_frames(frames: DataFrame, n: int = 5, key: str = "stream_id", item: str = "frame_id") -> DataFrame:
    """(key, batch, items): consecutive groups of ``n`` frames; an incomplete last one is left out."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("ts", item)) - 1
    rows = frames.select(key, "ts", item, F.floor(place / n).alias("batch"))
    order = F.array_sort(F.collect_list(F.struct("ts", item)))
    out = rows.groupBy(key, "batch").agg(F.transform(order, lambda r: r[item]).alias("items"))
    return out.where(F.size("items") == n)


def latest_per_interval(frames: DataFrame, interval: str, key: str = "stream_id", item: str = "frame_id") -> DataFrame:
    """(key, start, item): what a consumer sees that takes only the newest frame of each interval."""
    start = F.window(F.col("ts").cast("timestamp"), interval)["start"]
    return frames.groupBy(key, start.alias("start")).agg(F.max_by(item, F.struct("ts", item)).alias(item))


def drop_late_frames(frames: DataFrame, fps: float, factor: float = 1.5, key: str = "stream_id") -> DataFrame:
    """Frames within ``factor`` / fps of the one before; the first stays."""
    gap = _micros("ts") - F.lag(_micros("ts")).over(Window.partitionBy(key).orderBy("ts"))
    return frames.withColumn("gap_", gap).where(F.col("gap_").isNull() | (F.col("gap_") <= factor / fps * 1e6)).drop("gap_")


def throughput(frames: DataFrame, interval_s: int = 3, key: str = "stream_id") -> DataFrame:
    """(key, start, frames, fps, running_fps): per interval, and in all since the first frame."""
    start = F.window(F.col("ts").cast("timestamp"), f"{interval_s} seconds")["start"]
    each = frames.groupBy(key, start.alias("start")).agg(
        F.count(F.lit(1)).alias("frames"), F.min(_micros("ts")).alias("low_"), F.max(_micros("ts")).alias("high_")
    )
    so_far = Window.partitionBy(key).orderBy("start")
    elapsed = (F.max("high_").over(so_far) - F.min("low_").over(so_far)) / 1e6
    total = F.sum("frames").over(so_far)
    return each.select(
        key, "start", "frames", (F.col("frames") / interval_s).alias("fps"),
        F.when(elapsed > 0, total / elapsed).alias("running_fps"),
    )
