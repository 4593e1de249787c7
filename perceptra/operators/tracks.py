"""Tracks: matching with detections and faces, identity by votes over time."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perceptra.functions.boxes import corners, grown, iou, point_in_box
from perceptra.operators.segments import by_group, walk

FRAME = ("stream_id", "frame_id")
UNKNOWN = "__unknown__"


def _pairs(tracks: DataFrame, dets: DataFrame, min_iou: float) -> DataFrame:
    """Pairs of one frame whose overlap exceeds ``min_iou``."""
    named = dets.select(*FRAME, "det_idx", *(F.col(c).alias(f"d_{c}") for c in ("x1", "y1", "x2", "y2")))
    pairs = tracks.join(named, list(FRAME)).withColumn("iou", iou(corners(), corners("d_")))
    return pairs.where(F.col("iou") > min_iou)


def match_tracks_to_dets(tracks: DataFrame, dets: DataFrame, min_iou: float = 0.3) -> DataFrame:
    """(frame, track_id, det_idx, iou): each track's best detection, ties to the lower index; not exclusive."""
    best = F.struct("iou", (-F.col("det_idx")).alias("i"))
    return _pairs(tracks, dets, min_iou).groupBy(*FRAME, "track_id").agg(
        F.max_by("det_idx", best).alias("det_idx"), F.max("iou").alias("iou")
    )


def assign_tracks_exclusive(tracks: DataFrame, dets: DataFrame, min_iou: float = 0.3) -> DataFrame:
    """(frame, det_idx, name, is_known) for every detection; a track takes its best free one.

    Tracks go by falling sim, ties by track_id. The choice within a frame is
    sequential, so a frame's few pairs are brought together.
    """
    pairs = _pairs(tracks, dets, min_iou).select(*FRAME, "track_id", "sim", "name", "is_known", "det_idx", "iou")
    kind = "stream_id long, frame_id long, det_idx long, name string, is_known boolean"

    def run(table, frames):
        every, out = table.to_pylist(), []
        for a, b in frames:
            rows, taken = every[a:b], {}
            for _, track in sorted({(-r["sim"], r["track_id"]) for r in rows}):
                own = [r for r in rows if r["track_id"] == track and r["det_idx"] not in taken]
                if own:
                    best = min(own, key=lambda r: (-r["iou"], r["det_idx"]))
                    taken[best["det_idx"]] = best
            out += [{k: r[k] for k in ("stream_id", "frame_id", "det_idx", "name", "is_known")} for r in taken.values()]
        return pa.Table.from_pylist(out, schema=pa.schema(
            [("stream_id", pa.int64()), ("frame_id", pa.int64()), ("det_idx", pa.int64()), ("name", pa.string()), ("is_known", pa.bool_())]
        ))

    given = by_group(pairs, list(FRAME), run, kind)
    return dets.select(*FRAME, "det_idx").join(given, [*FRAME, "det_idx"], "left").select(
        *FRAME, "det_idx", F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce("is_known", F.lit(False)).alias("is_known")
    )


def match_falls_to_faces(poses: DataFrame, faces: DataFrame, kp: float = 0.5, margin: float = 0.25) -> DataFrame:
    """(frame, pose_idx, is_fallen, face_idx, identity): each pose with the face that holds most of its head points.

    Poses choose in order; a face is taken even if it has no name; ties go to
    the first face; at least one head point must lie within the grown face.
    Points are counted in columns; only the sequential choice is made per frame.
    """
    head = F.filter(F.slice("keypoints", 1, 5), lambda k: k["conf"] >= kp)
    grown_box = grown(corners("f_"), margin)
    named = faces.select(*FRAME, "face_idx", "name", *(F.col(c).alias(f"f_{c}") for c in ("x1", "y1", "x2", "y2")))
    inside = F.size(F.filter(head, lambda k: point_in_box(k["x"], k["y"], grown_box)))
    pairs = (
        poses.select(*FRAME, "pose_idx", "is_fallen", "keypoints")
        .join(named, list(FRAME), "left")
        .select(*FRAME, "pose_idx", "is_fallen", "face_idx", "name", F.coalesce(inside, F.lit(0)).alias("points"))
    )

    def run(table, frames):
        rows, out = table.to_pylist(), []
        for a, b in frames:
            used: set[int] = set()
            by_pose: dict[int, list[dict]] = {}
            for r in rows[a:b]:
                by_pose.setdefault(r["pose_idx"], []).append(r)
            for pose in sorted(by_pose):
                free = [r for r in by_pose[pose] if r["points"] > 0 and r["face_idx"] not in used]
                best = min(free, key=lambda r: (-r["points"], r["face_idx"])) if free else None
                if best:
                    used.add(best["face_idx"])
                first = by_pose[pose][0]
                out.append((first["stream_id"], first["frame_id"], pose, first["is_fallen"],
                            best and best["face_idx"], best and best["name"]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
        names = ["stream_id", "frame_id", "pose_idx", "is_fallen", "face_idx", "identity"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return by_group(
        pairs, list(FRAME), run, "stream_id long, frame_id long, pose_idx long, is_fallen boolean, face_idx long, identity string"
    )


def majority_vote(votes: DataFrame, threshold: float = 0.5, key: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """(key, status, name, sim) from votes (key, seq, name, sim).

    The most frequent real name (ties: seen first) wins if its share of all
    votes, unknown ones included, reaches ``threshold``; sim is the mean of its
    own votes.
    """
    real = F.col("name") != UNKNOWN
    each = votes.groupBy(*key, "name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("sim").alias("sim"), F.min("seq").alias("first")
    )
    order = F.when(real, F.struct(F.col("n").alias("n"), (-F.col("first")).alias("f")))
    best = each.groupBy(*key).agg(
        F.sum("n").alias("all"), F.max_by(F.struct("name", "sim", "n"), order).alias("best")
    )
    won = F.coalesce(F.col("best.n") / F.col("all") >= threshold, F.lit(False))
    return best.select(
        *key, F.when(won, "identified").otherwise("unknown").alias("status"),
        F.when(won, F.col("best.name")).alias("name"), F.when(won, F.col("best.sim")).alias("sim"),
    )


def interim_guess(votes: DataFrame, key: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """(key, name, sim): the most frequent real vote (ties: seen first) with its highest sim; no row without one."""
    each = votes.where(F.col("name") != UNKNOWN).groupBy(*key, "name").agg(
        F.count(F.lit(1)).alias("n"), F.max("sim").alias("sim"), F.min("seq").alias("first")
    )
    best = F.max_by(F.struct("name", "sim"), F.struct("n", (-F.col("first")).alias("f")))
    return each.groupBy(*key).agg(best.alias("b")).select(*key, "b.name", "b.sim")


def evict_stale(tracks: DataFrame, max_age_s: float = 5.0, key: tuple[str, ...] = ("stream_id", "track_id")) -> DataFrame:
    """``episode`` from 0: a track not seen for over ``max_age_s`` starts a new one."""
    order = Window.partitionBy(*key).orderBy("ts")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (t - F.lag(t).over(order)) > int(max_age_s * 1_000_000)
    return tracks.withColumn("new_", F.coalesce(gap, F.lit(False)).cast("int")).withColumn(
        "episode", F.sum("new_").over(order).cast("long")
    ).drop("new_")


@dataclass
class Identity:
    """What is known of one track while it is seen in every frame."""

    status: str = "new"
    name: str | None = None
    sim: float = 0.0
    votes: list[tuple[str, float]] = field(default_factory=list)
    attempts: int = 0
    last_recognised: float = 0.0
    unknown_since: float = 0.0
    frames: int = 0


@dataclass(frozen=True)
class IdentityRule:
    """Parameters of the identity votes."""

    recognise_every: float = 0.3
    vote_frames: int = 3
    vote_threshold: float = 0.5
    most_attempts: int = 10
    similarity: float = 0.4
    again_every: float = 3.0

    def shown(self, s: Identity) -> str:
        if s.status == "identified" and s.name:
            return f"{s.name} ({s.sim:.2f})"
        real = [v for v in s.votes if v[0] != UNKNOWN]
        if s.status == "identifying" and real:
            names = [n for n, _ in real]
            top = max(dict.fromkeys(names), key=names.count)
            return f"{top}? ({max(x for n, x in real if n == top):.2f})"
        return "unknown"

    def step(self, s: Identity, ts: float, label: str | None, sim: float | None) -> str:
        """Advance by one frame; the display name as it was before this frame's recognition."""
        s.frames += 1
        if s.status == "identified":
            s.unknown_since = 0.0
        elif s.unknown_since == 0.0:
            s.unknown_since = ts
        if self.again_every > 0 and ts - s.last_recognised >= self.again_every:
            if s.status == "unknown" or (s.status == "identified" and s.sim < self.similarity + 0.1):
                s.status, s.votes, s.attempts = "new", [], 0
        due = (
            s.status in ("new", "identifying")
            and ts - s.last_recognised >= self.recognise_every
            and s.attempts < self.most_attempts
        )
        shown = self.shown(s)
        if due and label is not None and sim is not None:
            s.last_recognised, s.attempts, s.status = ts, s.attempts + 1, "identifying"
            s.votes.append((label if sim >= self.similarity else UNKNOWN, sim))
            if len(s.votes) >= self.vote_frames or s.attempts >= self.most_attempts:
                self._decide(s)
        return shown

    def _decide(self, s: Identity) -> None:
        names = [n for n, _ in s.votes if n != UNKNOWN]
        top = max(dict.fromkeys(names), key=names.count) if names else None
        if top is not None and names.count(top) / len(s.votes) >= self.vote_threshold:
            own = [x for n, x in s.votes if n == top]
            s.status, s.name, s.sim, s.unknown_since = "identified", top, sum(own) / len(own), 0.0
        else:
            s.status, s.name = "unknown", None


IDENTITY_SCHEMA = (
    "stream_id long, frame_id long, track_id long, ts double, shown string, status string, name string, sim double, "
    "attempts long, votes long, frames long, unknown_since double"
)


def runs(tracks: DataFrame) -> DataFrame:
    """``run``: consecutive frames of one track; a missing frame or an empty box ends it.

    Identity does not outlive a run, so a run is a group of its own and a
    stream with any number of frames never has to be handled whole.
    """
    x1, y1, x2, y2 = corners()
    seen = tracks.where((x2 > x1) & (y2 > y1))
    n = F.row_number().over(Window.partitionBy("stream_id", "track_id").orderBy("frame_id"))
    return seen.withColumn("run", F.col("frame_id") - n)


def track_identities(observations: DataFrame, rule: IdentityRule = IdentityRule(), width: int = 0, height: int = 0) -> DataFrame:  # noqa: B008
    """Status, name and display name of every track in every frame (IDENTITY_SCHEMA).

    Observations: stream_id, frame_id, track_id, ts (seconds), corners, and
    best_label and sim of the frame's embedding, null where none was taken.
    With a frame size boxes are clipped to it first.
    """
    if width and height:
        x1, y1, x2, y2 = corners()
        observations = observations.withColumns(
            {"x1": F.greatest(x1.cast("int"), F.lit(0)), "y1": F.greatest(y1.cast("int"), F.lit(0)),
             "x2": F.least(x2.cast("int"), F.lit(width)), "y2": F.least(y2.cast("int"), F.lit(height))}
        )
    rows = runs(observations).select("stream_id", "frame_id", "track_id", "ts", "best_label", "sim", "run")

    def step(state, row):
        stream, frame, track, ts, label, sim, _ = row
        shown = rule.step(state, ts, label, sim)
        return (stream, frame, track, ts, shown, state.status, state.name, state.sim,
                state.attempts, len(state.votes), state.frames, state.unknown_since)

    return walk(rows, ["stream_id", "track_id", "run"], ["frame_id"], Identity, step, IDENTITY_SCHEMA)


def _latest(identities: DataFrame) -> DataFrame:
    """Each stream's rows of its latest frame: the last row of each track, then those of the highest frame, in one pass."""
    columns = [c for c in identities.columns if c not in ("stream_id", "track_id")]
    last = identities.groupBy("stream_id", "track_id").agg(F.max_by(F.struct(*columns), "frame_id").alias("last"))
    top = F.max("last.frame_id").over(Window.partitionBy("stream_id"))
    return last.withColumn("top", top).where(F.col("last.frame_id") == F.col("top")).select("stream_id", "track_id", "last.*")


def unknown_durations(identities: DataFrame, tracks: DataFrame) -> DataFrame:
    """(stream_id, track_id, seconds, area): tracks of a stream's latest frame that are not identified, by area."""
    now = _latest(identities).where("status <> 'identified'")
    x1, y1, x2, y2 = corners()
    sizes = tracks.select("stream_id", "frame_id", "track_id", ((x2 - x1) * (y2 - y1)).alias("area"))
    return now.join(sizes, ["stream_id", "frame_id", "track_id"]).select(
        "stream_id", "track_id", F.bround(F.col("ts") - F.col("unknown_since"), 1).alias("seconds"), "area"
    )


def track_summary(identities: DataFrame) -> DataFrame:
    """The last row of each track active in its stream's latest frame."""
    return _latest(identities).select(
        "stream_id", "track_id", "name", "status", "sim", "frames", "attempts", "votes"
    )
