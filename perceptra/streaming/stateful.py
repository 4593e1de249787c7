"""Streaming forms of the stateful operators.

Each has a batch form in ``perceptra.operators`` that gives the same rows when
the stream comes in order. State is kept per key; rows later than the
watermark are dropped, and of state idle for longer than ``idle_ms`` past the
watermark only what the operator's ``rest`` keeps is left, so that a closed
gate, a rate that was set or an episode's number outlive the idleness.
``perceptra.streaming.ordered`` has forms that also bring rows of different
micro-batches into order and count the late ones.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from perceptra.operators.speech import ACTIVE, READY, Rechunker
from perceptra.operators.tracks import Identity, IdentityRule

Step = Callable[[dict, dict], dict | None]


def keyed_state(
    stream: DataFrame, key: list[str], output: str, step: Step, delay: str = "10 seconds", idle_ms: int = 300_000,
    order: tuple[str, ...] = ("ts",), rest: Callable[[dict], dict | None] = lambda state: None,
) -> DataFrame:
    """Apply ``step(state, row) -> output row or None`` to each key's rows in order of time.

    The state is a JSON object of the step's own. ``stream`` needs a timestamp
    column ``ts``. ``rest(state)`` is what is kept of an idle key, or None.
    """
    columns = [part.strip().split(" ")[0] for part in output.split(",")]

    def run(_, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            left = rest(json.loads(held.get[0]))
            held.update((json.dumps(left),)) if left else held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else {}
        out = []
        rows = pd.concat(list(parts)).sort_values(list(order), kind="stable")
        for row in rows.to_dict("records"):
            if (made := step(state, row)) is not None:
                out.append(made)
        held.update((json.dumps(state),))
        newest = int(pd.Timestamp(rows["ts"].max()).value // 1_000_000)
        held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs(), newest) + idle_ms)
        if out:
            yield pd.DataFrame(out, columns=columns)

    return (
        stream.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(*key)
        .applyInPandasWithState(run, output, "state string", "append", GroupStateTimeout.EventTimeTimeout)
    )


def _all(state: dict) -> dict:
    return state


def gate_step(interrupt: bool = False) -> Step:
    """Rows of both feeds: ``status_speaker`` set on statuses, ``chunk_id`` on chunks."""

    def step(state: dict, row: dict) -> dict | None:
        status = row["status_speaker"]
        if not pd.isna(status):
            if status == READY:
                state["open"] = True
            elif status == ACTIVE and not interrupt:
                state["open"] = False
            return None
        return row if state.get("open", True) else None

    return step


def gate_audio(merged: DataFrame, interrupt: bool = False, **options) -> DataFrame:
    """(stream_id, ts, chunk_id) of chunks recorded while the gate is open; ``merged`` holds chunks and statuses."""
    schema = "stream_id long, ts timestamp, chunk_id long"
    return keyed_state(merged, ["stream_id"], schema, gate_step(interrupt), rest=lambda s: None if s.get("open", True) else s, **options)


def sticky_step(default_rate: int, default_language: str) -> Step:
    def step(state: dict, row: dict) -> dict:
        for name, default in (("rate", default_rate), ("language_code", default_language)):
            if not pd.isna(row[name]):
                state[name] = row[name] if isinstance(row[name], str) else int(row[name])
            row[name] = state.get(name, default)
        return row

    return step


def parse_remote_audio(messages: DataFrame, default_rate: int = 16000, default_language: str = "en-US", **options) -> DataFrame:
    """Audio messages with a rate and language that last until a message changes them."""
    parsed = messages.withColumn("m_", F.from_json("message", "audio string, rate int, language_code string")).where(
        "m_.audio is not null"
    )
    rows = parsed.select("stream_id", "ts", F.unbase64("m_.audio").alias("audio"), "m_.rate", "m_.language_code")
    schema = "stream_id long, ts timestamp, audio binary, rate int, language_code string"
    return keyed_state(rows, ["stream_id"], schema, sticky_step(default_rate, default_language), rest=_all, **options)


def smooth_step(n: int = 5, max_age_s: float = 2.0, ratio: float = 0.5) -> Step:
    def step(state: dict, row: dict) -> dict:
        now = pd.Timestamp(row["ts"]).value / 1e9
        seen = [*state.get("seen", []), [now, bool(row["is_fallen"])]][-n:]
        state["seen"] = seen
        fresh = [f for t, f in seen if now - t <= max_age_s]
        return row | {"smoothed": bool(row["is_fallen"]) if len(fresh) < 2 else sum(fresh) / len(fresh) >= ratio}

    return step


def smooth_falls(scores: DataFrame, n: int = 5, max_age_s: float = 2.0, ratio: float = 0.5, **options) -> DataFrame:
    schema = "track_id long, ts timestamp, is_fallen boolean, smoothed boolean"
    return keyed_state(scores, ["track_id"], schema, smooth_step(n, max_age_s, ratio), rest=_all, **options)


def episode_step(max_age_s: float = 5.0) -> Step:
    def step(state: dict, row: dict) -> dict:
        now = pd.Timestamp(row["ts"]).value / 1e9
        if "last" in state and now - state["last"] > max_age_s:
            state["episode"] = state.get("episode", 0) + 1
        state["last"] = now
        return row | {"episode": state.get("episode", 0)}

    return step


def evict_stale(tracks: DataFrame, max_age_s: float = 5.0, **options) -> DataFrame:
    schema = "stream_id long, track_id long, ts timestamp, episode long"
    return keyed_state(tracks, ["stream_id", "track_id"], schema, episode_step(max_age_s), rest=_all, **options)


def rechunk_step(size: int) -> Step:
    def step(state: dict, row: dict) -> dict | None:
        box = Rechunker(size, base64.b64decode(state.get("held", "")))
        chunk = box.step(row["payload"] or b"")
        state["held"] = base64.b64encode(box.held).decode()
        return None if chunk is None else row | {"chunk": chunk}

    return step


def rechunk_audio(pcm: DataFrame, samples: int, width: int = 2, **options) -> DataFrame:
    schema = "stream_id long, connection long, seq long, ts timestamp, chunk binary"
    return keyed_state(pcm, ["stream_id", "connection"], schema, rechunk_step(samples * width), order=("seq",), rest=_all, **options)


def identity_step(rule: IdentityRule) -> Step:
    """Rows: frame_id, seconds, best_label, sim, and an empty box as ``gone``; a gap in frame_id forgets the track."""

    def step(state: dict, row: dict) -> dict | None:
        frame = int(row["frame_id"])
        if "frame" not in state or frame != state["frame"] + 1:
            state.clear()
        own = Identity(**{k: v for k, v in state.items() if k != "frame"})
        own.votes = [tuple(v) for v in own.votes]
        label = None if pd.isna(row["best_label"]) else row["best_label"]
        sim = None if pd.isna(row["sim"]) else float(row["sim"])
        shown = rule.step(own, float(row["seconds"]), label, sim)
        state.update(vars(own), frame=frame)
        return {
            "stream_id": row["stream_id"], "frame_id": frame, "track_id": row["track_id"], "shown": shown,
            "status": own.status, "name": own.name, "sim": own.sim, "attempts": own.attempts,
        }

    return step


def track_identities(observations: DataFrame, rule: IdentityRule | None = None, **options) -> DataFrame:
    """Status and names of every track in every frame; boxes that are empty must be left out before."""
    schema = "stream_id long, frame_id long, track_id long, shown string, status string, name string, sim double, attempts long"
    return keyed_state(
        observations, ["stream_id", "track_id"], schema, identity_step(rule or IdentityRule()), order=("frame_id",), rest=_all, **options
    )


def throughput(frames: DataFrame, interval: str = "3 seconds", delay: str = "10 seconds") -> DataFrame:
    """(stream_id, start, frames) per tumbling window, emitted once the watermark has passed it."""
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = timed.groupBy("stream_id", F.window("ts", interval).alias("w")).agg(F.count(F.lit(1)).alias("frames"))
    return out.select("stream_id", F.col("w.start").alias("start"), "frames")


def presence_windows(names: DataFrame, length: str = "10 seconds", slide: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """(start, name, rows) per sliding window: who was there lately, as a stream."""
    timed = names.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    named = timed.where("name is not null and name not in ('', 'unknown')")
    out = named.groupBy(F.window("ts", length, slide).alias("w"), "name").agg(F.count(F.lit(1)).alias("rows"))
    return out.select(F.col("w.start").alias("start"), "name", "rows")
