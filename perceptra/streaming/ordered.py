"""Keyed steps in order of event time, whatever the cut and order of the micro-batches.

Rows wait in their key's buffer until the watermark has passed them and then go
through the step in order of time; timers of event time wake the key. A row
that comes behind the watermark is not applied and not lost: it comes out
flagged ``late``. So output rows and late rows together are the input's, for
steps that give a row for each. State has a schema of its own; when a key is
idle the step's ``rest`` says what small record outlives it, so that results
stay those of the batch form. A step may also set an alarm: a moment at which
it gives rows without any event.

Needs the RocksDB state store, which ``apply_in_order`` sets for the session's
next streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from perceptra.operators.tracks import Identity, IdentityRule
from perceptra.operators.speech import Rechunker
from perceptra.streaming.stateful import gate_step, identity_step, smooth_step, sticky_step

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Steps:
    """What happens to a key: ``step(state, row)`` gives a row, several or None; ``rest(state)`` is what idleness leaves, or None.

    ``alarm(state)`` is the next moment, in microseconds, at which ``ring(state)``
    gives rows of its own. ``state`` is the schema of the state's fields.
    """

    step: Callable[[dict, dict], Any]
    state: str
    rest: Callable[[dict], dict | None]
    alarm: Callable[[dict], int | None] = lambda state: None
    ring: Callable[[dict], list[dict]] = lambda state: []


def _plain(value):
    if isinstance(value, Row):
        return tuple(_plain(v) for v in value)
    return [_plain(v) for v in value] if isinstance(value, list) else value


class _InOrder(StatefulProcessor):
    """``at_`` is a row's moment in microseconds; rows are buffered as they came."""

    def __init__(self, steps: Steps, rows: StructType, names: list[str], order: list[str], idle_ms: int):
        self.steps, self.schema, self.names, self.order, self.idle_ms = steps, rows, names, order, idle_ms
        self.fields = StructType.fromDDL(steps.state).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("rows", self.schema)
        self.state = handle.getValueState("state", f"{self.steps.state}, newest_ long")

    def _load(self) -> tuple[dict, int]:
        held = self.state.get() if self.state.exists() else None
        if held is None:
            return {}, 0
        return {k: _plain(v) for k, v in zip(self.fields, held, strict=False) if v is not None}, held[-1]

    def _store(self, state: dict, newest: int) -> None:
        self.state.update((*(state.get(k) for k in self.fields), newest))

    def _row(self, made: dict, late: bool) -> Row:
        return Row(**{n: made.get(n) for n in self.names}, late=late)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = []
        for row in rows:
            if row["at_"] < passed:
                yield self._row(row.asDict(), True)
            else:
                held.append(tuple(row))
        if held:
            at = self.schema.names.index("at_")
            self.buffer.appendList(held)
            self.handle.registerTimer(min(r[at] for r in held) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [dict(zip(self.schema.names, r, strict=True)) for r in self.buffer.get()] if self.buffer.exists() else []
        due = sorted((r for r in held if r["at_"] < passed), key=lambda r: (r["at_"], *(r[c] for c in self.order)))
        state, newest = self._load()
        for row in due:
            yield from self._rung(state, row["at_"])
            newest = max(newest, row["at_"])
            yield from self._made(self.steps.step(state, row))
        yield from self._rung(state, passed)
        if due:
            left = [r for r in held if r["at_"] >= passed]
            self.buffer.put([tuple(r[n] for n in self.schema.names) for r in left]) if left else self.buffer.clear()
            wake = [r["at_"] // 1000 + 1 for r in left]
        else:
            left, wake = held, []
        if (alarm := self.steps.alarm(state)) is not None:
            wake.append(max(alarm, passed) // 1000 + 1)
        elif not left and state and passed >= newest + self.idle_ms * 1000:
            state = self.steps.rest(state) or {}
        elif state:
            wake.append(newest // 1000 + self.idle_ms + 1)
        if state:
            self._store(state, newest)
        else:
            self.state.clear()
        if wake:
            self.handle.registerTimer(min(wake))

    def _rung(self, state: dict, until: int) -> Iterator[Row]:
        while (alarm := self.steps.alarm(state)) is not None and alarm < until:
            yield from self._made(self.steps.ring(state))

    def _made(self, made) -> Iterator[Row]:
        for m in made if isinstance(made, list) else [] if made is None else [made]:
            yield self._row(m, False)

    def close(self) -> None:
        pass


def apply_in_order(
    stream: DataFrame, key: list[str], output: str, steps: Steps, delay: str = "10 seconds", idle_ms: int = 300_000, order: tuple[str, ...] = ()
) -> DataFrame:
    """The output's columns and ``late``: every key's rows through ``steps`` in order of ``ts`` and then ``order``.

    A late row has the values of its own columns that the output names.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    # Without the mark of the event-time column late rows reach the processor, which counts them itself.
    rows = timed.select(*(F.col(c).alias(c, metadata={}) for c in timed.columns), F.unix_micros("ts").alias("at_"))
    names = StructType.fromDDL(output).names
    processor = _InOrder(steps, rows.schema, names, list(order), idle_ms)
    return rows.groupBy(*key).transformWithState(processor, f"{output}, late boolean", "Append", "EventTime")


def write_with_late(result: DataFrame, path: str, late_path: str, checkpoint: str):
    """A writer of the stream's rows to one table and of its late rows to another; call ``start`` on it."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("not late").drop("late").write.mode("append").parquet(path)
        batch.where("late").drop("late").write.mode("append").parquet(late_path)
        batch.unpersist()

    return result.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


_ALL = lambda state: state
_NONE = lambda state: None


def parse_remote_audio(messages: DataFrame, default_rate: int = 16000, default_language: str = "en-US", **options) -> DataFrame:
    """Audio messages with the rate and language last set, which no idleness forgets."""
    parsed = messages.withColumn("m_", F.from_json("message", "audio string, rate int, language_code string")).where("m_.audio is not null")
    rows = parsed.select("stream_id", "ts", F.unbase64("m_.audio").alias("audio"), "m_.rate", "m_.language_code")
    steps = Steps(sticky_step(default_rate, default_language), "rate int, language_code string", _ALL)
    return apply_in_order(rows, ["stream_id"], "stream_id long, ts timestamp, audio binary, rate int, language_code string", steps, **options)


def gate_audio(merged: DataFrame, interrupt: bool = False, **options) -> DataFrame:
    """Chunks recorded while the gate is open; a closed gate stays closed however long it is idle.

    Of a status and a chunk of one moment the status comes first, as in the batch form.
    """
    rows = merged.withColumn("chunk_", F.col("status_speaker").isNull())
    steps = Steps(gate_step(interrupt), "open boolean", lambda state: None if state.get("open", True) else state)
    return apply_in_order(rows, ["stream_id"], "stream_id long, ts timestamp, chunk_id long", steps, order=("chunk_",), **options)


def smooth_falls(scores: DataFrame, n: int = 5, max_age_s: float = 2.0, ratio: float = 0.5, **options) -> DataFrame:
    """``smoothed`` over the last ``n`` rows of a track that are no older than ``max_age_s``."""
    steps = Steps(smooth_step(n, max_age_s, ratio), "seen array<struct<t:double,fallen:boolean>>", _ALL)
    return apply_in_order(scores, ["track_id"], "track_id long, ts timestamp, is_fallen boolean, smoothed boolean", steps, **options)


def evict_stale(tracks: DataFrame, max_age_s: float = 5.0, **options) -> DataFrame:
    """``episode`` from 0; a track's number and last moment outlive any idleness."""

    def step(state: dict, row: dict) -> dict:
        gap = row["at_"] - state["last"] > max_age_s * 1_000_000 if "last" in state else False
        state.update(last=row["at_"], episode=state.get("episode", 0) + gap)
        return row | {"episode": state["episode"]}

    steps = Steps(step, "last long, episode long", _ALL)
    return apply_in_order(tracks, ["stream_id", "track_id"], "stream_id long, track_id long, ts timestamp, episode long", steps, **options)


def rechunk_audio(pcm: DataFrame, samples: int, width: int = 2, **options) -> DataFrame:
    """Chunks of ``samples``; of an idle connection the rest of a chunk is kept."""

    def step(state: dict, row: dict) -> dict | None:
        box = Rechunker(samples * width, bytes(state.get("held", b"")))
        chunk = box.step(bytes(row["payload"] or b""))
        state["held"] = box.held
        return None if chunk is None else row | {"chunk": chunk}

    steps = Steps(step, "held binary", lambda state: state if state.get("held") else None)
    schema = "stream_id long, connection long, seq long, ts timestamp, chunk binary"
    return apply_in_order(pcm, ["stream_id", "connection"], schema, steps, order=("seq",), **options)


def track_identities(observations: DataFrame, rule: IdentityRule | None = None, **options) -> DataFrame:
    """Status and names of every track in every frame; ``observations`` also has ``seconds`` and ``best_label``, ``sim``."""
    own = Identity()
    kinds = {"votes": "array<struct<label:string,sim:double>>", "name": "string", "status": "string", "sim": "double"}
    fields = ", ".join(f"{k} {kinds.get(k, 'double' if isinstance(v, float) else 'long')}" for k, v in vars(own).items())
    steps = Steps(identity_step(rule or IdentityRule()), f"{fields}, frame long", _ALL)
    schema = "stream_id long, frame_id long, track_id long, shown string, status string, name string, sim double, attempts long"
    return apply_in_order(observations, ["stream_id", "track_id"], schema, steps, order=("frame_id",), **options)


def conn_sessions(events: DataFrame, timeout_s: float = 300.0, **options) -> DataFrame:
    """(connection_id, started, ended, reason): as the batch form; a session closes at its timeout without any further event.

    Every connect opens a session; they end together at a disconnect, or each
    at its own timeout.
    """
    limit = int(timeout_s * 1_000_000)

    def row(state: dict, started: int, ended: int, reason: str) -> dict:
        return {"connection_id": state["connection"], "started": started, "ended": ended, "reason": reason}

    def step(state: dict, event: dict) -> list[dict]:
        state["connection"] = event["connection_id"]
        if event["event"] == "connect":
            state["open"] = [*state.get("open", []), event["at_"]]
        if event["event"] != "disconnect":
            return []
        return [row(state, s, event["at_"], "disconnect") for s in state.pop("open", [])]

    def ring(state: dict) -> list[dict]:
        started = state["open"][0]
        state["open"] = state["open"][1:]
        return [row(state, started, started + limit, "timeout")]

    kind = dict(events.dtypes)["connection_id"]
    steps = Steps(step, f"connection {kind}, open array<bigint>", _NONE, lambda s: s["open"][0] + limit if s.get("open") else None, ring)
    found = apply_in_order(events, ["connection_id"], f"connection_id {kind}, started long, ended long, reason string", steps, **options)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("started", "ended")})
