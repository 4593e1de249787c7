"""Streams in order of event time: shuffled replays with long gaps equal the batch forms, late rows are counted, timeouts come by themselves."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from perceptra.operators import pose, sessions, speech, tracks
from perceptra.operators.asof import merge_streams
from perceptra.streaming import ordered, stateful

START = datetime(2024, 1, 1)


def moments(rng, n, spread=4.0):
    """``n`` moments a few seconds apart, with gaps of ten minutes."""
    out, at = [], 0.0
    for i in range(n):
        at += rng.uniform(0.5, spread) + (600 if i % 17 == 16 else 0)
        out.append(START + timedelta(milliseconds=int(at * 1000)))
    return out


def replay(spark, tmp_path, df, build, jitter_s=8.0, parts=5, seed=0, late=()):
    """Rows and late rows of a stream over ``df`` that arrives out of order by up to ``jitter_s``, then a far later row; ``late`` come last."""
    rng = random.Random(seed)
    rows = sorted(df.collect(), key=lambda r: r["ts"] + timedelta(seconds=rng.uniform(0, jitter_s)))
    source, out, behind, state = (str(tmp_path / n) for n in ("source", "out", "behind", "state"))
    last = rows[-1].asDict() | {"ts": max(r["ts"] for r in rows) + timedelta(days=1)} | {c: -1 for c in ("stream_id", "track_id", "connection_id") if c in df.columns}
    cuts = [rows[i * len(rows) // parts : (i + 1) * len(rows) // parts] for i in range(parts)] + [[tuple(last[c] for c in df.columns)]]
    for group in (cuts[:2], [*cuts[2:], *([list(late)] if late else [])]):  # a file is a micro-batch; the stream starts again between
        for own in group:
            spark.createDataFrame(own, df.schema).coalesce(1).write.mode("append").parquet(source)
        result = build(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source))
        query = ordered.write_with_late(result, out, behind, state).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in result.schema.fields if f.name != "late")[:-2]
    read = lambda path: [r.asDict() for r in spark.read.schema(schema).parquet(path).collect()]
    return read(out), read(behind)


def same(found, expected, columns):
    row = lambda r: tuple(str(r[c]) for c in columns)
    expected = [r.asDict() for r in expected.collect()]
    assert sorted(map(row, found)) == sorted(map(row, expected)) and expected


def test_sticky_rates(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for key in range(2):
        for i, ts in enumerate(moments(rng, 40)):
            message = {"audio": "YWJj"} | ({"rate": 8000 + i} if rng.random() < 0.1 else {}) | ({"language_code": f"l{i}"} if rng.random() < 0.1 else {})
            rows.append((key, ts, json.dumps(message)))
    sent = spark.createDataFrame(rows, "stream_id long, ts timestamp, message string")
    early = [(0, START, json.dumps({"audio": "eHl6", "rate": 1}))]
    found, late = replay(spark, tmp_path, sent, ordered.parse_remote_audio, late=early)
    same([r for r in found if r["stream_id"] >= 0], speech.parse_remote_audio(sent), ["stream_id", "ts", "rate", "language_code"])
    assert [(r["stream_id"], r["ts"]) for r in late] == [(0, START)]


def test_gate_with_long_gaps(spark, tmp_path):
    rng = random.Random(2)
    kinds = "stream_id long, ts timestamp, chunk_id long, status_speaker int"
    rows = []
    for key in range(2):
        for i, ts in enumerate(moments(rng, 50)):
            rows.append((key, ts, None, rng.choice([1, 2, 2])) if rng.random() < 0.2 else (key, ts, 100 * key + i, None))
    merged = spark.createDataFrame(rows, kinds)
    found, late = replay(spark, tmp_path, merged, ordered.gate_audio)
    chunks, status = merged.where("chunk_id is not null").select("stream_id", "ts", "chunk_id"), merged.where("status_speaker is not null")
    same([r for r in found if r["stream_id"] >= 0], speech.gate_audio(chunks, status.select("stream_id", "ts", "status_speaker")), ["stream_id", "chunk_id"])
    assert not late


def test_episodes_and_late_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(0, key, ts) for key in range(3) for ts in moments(rng, 40)]
    seen = spark.createDataFrame(rows, "stream_id long, track_id long, ts timestamp")
    early = [(0, 1, START + timedelta(seconds=i)) for i in range(3)] + [(0, 77, START)]
    found, late = replay(spark, tmp_path, seen, ordered.evict_stale, late=early)
    own = [r for r in found if r["track_id"] >= 0]
    same(own, tracks.evict_stale(seen), ["track_id", "ts", "episode"])
    assert {r["episode"] for r in own} >= {0, 1, 2} and len(late) == 4 and len(own) + len(late) == len(rows) + len(early)
    assert all(r["episode"] is None for r in late)


def test_smoothing(spark, tmp_path):
    rng = random.Random(4)
    rows = [(key, ts, rng.random() < 0.5) for key in range(2) for ts in moments(rng, 50, 1.0)]
    scores = spark.createDataFrame(rows, "track_id long, ts timestamp, is_fallen boolean")
    found, _ = replay(spark, tmp_path, scores, ordered.smooth_falls)
    same([r for r in found if r["track_id"] >= 0], pose.smooth_falls(scores), ["track_id", "ts", "smoothed"])


def test_rechunking(spark, tmp_path):
    rng = random.Random(5)
    rows = [(key, 0, i, ts, bytes([i]) * rng.randrange(30)) for key in range(2) for i, ts in enumerate(moments(rng, 40))]
    pcm = spark.createDataFrame(rows, "stream_id long, connection long, seq long, ts timestamp, payload binary")
    found, _ = replay(spark, tmp_path, pcm, lambda s: ordered.rechunk_audio(s, 20))
    same([r for r in found if r["stream_id"] >= 0], speech.rechunk_audio(pcm, 20), ["stream_id", "seq", "chunk"])


def test_identities(spark, tmp_path):
    rng = random.Random(6)
    frames = [(f, ts) for f, ts in enumerate(moments(rng, 60, 1.0)) if f != 20]
    rows = [(0, f, key, ts, rng.choice(["ann", "ann", "bob", None]), rng.uniform(0.2, 0.9)) for key in range(2) for f, ts in frames]
    seen = spark.createDataFrame(rows, "stream_id long, frame_id long, track_id long, ts timestamp, best_label string, sim double")
    seen = seen.withColumn("seconds", F.unix_micros("ts") / 1e6)
    found, _ = replay(spark, tmp_path, seen, ordered.track_identities)
    boxes = seen.select("stream_id", "frame_id", "track_id", F.col("seconds").alias("ts"), *(F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (0.0, 0.0, 9.0, 9.0), strict=True)), "best_label", "sim")
    same([r for r in found if r["stream_id"] >= 0], tracks.track_identities(boxes), ["track_id", "frame_id", "shown", "status", "name"])


def test_sessions_close_without_a_further_event(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for key in range(4):
        for ts in moments(rng, 20, 200.0):
            rows.append((key, ts, rng.choice(["connect", "connect", "disconnect"])))
        rows.append((key, max(r[1] for r in rows if r[0] == key) + timedelta(seconds=5), "connect"))  # and nothing after it
    events = spark.createDataFrame(rows, "connection_id long, ts timestamp, event string")
    found, late = replay(spark, tmp_path, events, ordered.conn_sessions)
    same([r for r in found if r["connection_id"] >= 0], sessions.conn_sessions(events), ["connection_id", "started", "ended", "reason"])
    assert {r["reason"] for r in found} == {"timeout", "disconnect"} and not late


@pytest.mark.parametrize("build, columns, expected", [
    (lambda s: stateful.evict_stale(s, idle_ms=300_000), "episode long", [0, 1, 2]),
])
def test_unbuffered_state_outlives_idleness(spark, tmp_path, build, columns, expected):
    """One track after gaps of 20 minutes, in files of one row each, with another that moves the watermark."""
    source, out, state = (str(tmp_path / n) for n in ("source", "out", "state"))
    schema = "stream_id long, track_id long, ts timestamp"
    for i in range(3):
        for track, minutes in ((1, 20 * i), (2, 20 * i + 15), (2, 20 * i + 16)):
            spark.createDataFrame([(0, track, START + timedelta(minutes=minutes))], schema).coalesce(1).write.mode("append").parquet(source)
            stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
            query = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
            assert query.awaitTermination(120)
    found = spark.read.schema(f"{schema}, {columns}").parquet(out).where("track_id = 1").orderBy("ts").collect()
    assert [r.episode for r in found] == expected


def test_merged_feeds_keep_their_columns(spark):
    one = spark.createDataFrame([(1, 2)], "stream_id long, chunk_id long")
    two = spark.createDataFrame([(1, 1)], "stream_id long, status_speaker int")
    assert merge_streams(one, two).columns == ["stream_id", "chunk_id", "status_speaker"]
