"""Keys of any length in parts: the same rows as in one piece, and parts of like size."""

import random
from datetime import datetime, timedelta
from statistics import median

import pytest

from perceptra.operators import asof, metrics, sessions
from perceptra.operators.segments import cut_times, segmented

KIND = "stream_id long, ts long, value double"


def hot_rows(rng, n=3000, null=0.1):
    """Nine tenths of the rows in one key, with equal moments' values alike and some null."""
    return [(0 if rng.random() < 0.9 else rng.randrange(1, 6), ts, None if rng.random() < null else rng.uniform(-5, 5)) for ts in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("null", [0.1, 0.9, 1.0])
def test_moving_average_in_parts(spark, null):
    rows = spark.createDataFrame(hot_rows(random.Random(1), null=null), KIND)
    plain = lambda found: {(r.stream_id, r.ts): (r.value, None if r.ema is None else round(r.ema, 9)) for r in found.collect()}
    expected = plain(metrics.ema(rows))
    assert plain(metrics.ema(rows, segment_rows=100)) == expected and len(expected) == 3000
    state, by_hand = None, {}
    for _, ts, v in sorted((r for r in rows.collect() if r[0] == 0), key=lambda r: r[1]):
        state = state if v is None else v if state is None else 0.9 * state + 0.1 * v
        by_hand[(0, ts)] = None if state is None else round(state, 9)
    assert {k: v[1] for k, v in expected.items() if k[0] == 0} == by_hand


def test_parts_are_even(spark):
    rows = spark.createDataFrame(hot_rows(random.Random(2)), KIND)
    parts = segmented(rows, ["stream_id"], "ts", cut_times(rows, ["stream_id"], "ts", 100)).groupBy("stream_id", "seg_").count().collect()
    sizes = [r["count"] for r in parts if r.stream_id == 0]
    assert len(sizes) >= 20 and max(sizes) <= 2 * median(sizes)
    assert all(r["seg_"] == 0 for r in parts if r.stream_id and r["count"] < 100)


@pytest.mark.parametrize("key", [None, ["stream_id"]])
def test_settings_in_parts(spark, key):
    rng = random.Random(3)
    frames = spark.createDataFrame([(s, ts) for s, ts, _ in hot_rows(rng)], "stream_id long, ts long")
    sent = [(rng.randrange(3), rng.randrange(30_000), rng.choice(["a", "b", "other"]), rng.random()) for _ in range(60)]
    changes = spark.createDataFrame(sent, "stream_id long, ts long, config_key string, config_value double")
    changes = changes if key else changes.drop("stream_id")
    found = asof.config_asof(frames, changes, {"a": 0.5, "b": 0.7}, key, segment_rows=100)
    assert found.columns == ["stream_id", "ts", "a", "b"]
    expected = set()
    for stream, ts in frames.collect():
        own = sorted((t, n, v) for s, t, n, v in sent if t <= ts and (not key or s == stream))
        expected.add((stream, ts, *(next((v for _, n, v in reversed(own) if n == name), default) for name, default in (("a", 0.5), ("b", 0.7)))))
    assert {tuple(r) for r in found.collect()} == expected


def test_empty_and_null(spark):
    none = spark.createDataFrame([], KIND)
    assert metrics.ema(none).count() == 0
    odd = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), (1, None, 3.0)], KIND)
    assert sorted(round(r.ema, 3) for r in metrics.ema(odd, segment_rows=1).collect()) == [1.0, 1.1, 3.0]


@pytest.mark.parametrize("segment_rows", [20, 100_000])
def test_busy_hours_are_dealt_out(spark, segment_rows):
    """Nine tenths of the broadcasts in one hour: the rows of a comparison of all pairs."""
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    sent = [(i, rng.choice([None, None, 1, 2]), at(rng.randrange(3600, 7200) if rng.random() < 0.9 else rng.randrange(40_000))) for i in range(400)]
    spans = [(c, at(s := rng.randrange(20_000)), at(s + rng.choice([0, 50, 4000, 15_000]))) for c in range(1, 8) for _ in range(2)]
    spans.append((9, at(3600), at(7200)))
    messages = spark.createDataFrame(sent, "message_id long, connection_id long, ts timestamp")
    opened = spark.createDataFrame(spans, "connection_id long, started timestamp, ended timestamp")
    expected = {(m, c, ts) for m, to, ts in sent for c, a, b in spans if a <= ts < b and to in (None, c)}
    found = sessions.route_messages(messages, opened, segment_rows=segment_rows).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    if segment_rows == 20:
        everyone = messages.where("connection_id is null")
        sizes = segmented(everyone, [], "ts", cut_times(everyone, [], "ts", 20)).groupBy("seg_").count().collect()
        assert len(sizes) > 8 and max(r["count"] for r in sizes) < 60


def test_deliveries_are_unique_as_they_leave_the_join(spark):
    """Repeated messages, sessions that overlap or touch, a message sent to one and to all: each row once, with no exchange of what is delivered."""
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    sent = [(1, None, at(10)), (1, None, at(10)), (1, 5, at(10)), (2, 5, at(20)), (2, 5, at(20)), (3, None, at(4000)), (4, 6, at(30)), (None, None, at(30)), (5, None, None)]
    spans = [(5, at(0), at(15)), (5, at(5), at(40)), (5, at(40), at(5000)), (5, at(1), at(2)), (6, at(30), at(30)), (6, at(50), at(40)), (7, at(10), at(11))]
    messages = spark.createDataFrame(sent, "message_id long, connection_id long, ts timestamp")
    opened = spark.createDataFrame(spans, "connection_id long, started timestamp, ended timestamp")
    expected = {(m, c, ts) for m, to, ts in sent if ts for c, a, b in spans if a <= ts < b and to in (None, c)}
    routed = sessions.route_messages(messages, opened)
    found = [tuple(r) for r in routed.collect()]
    assert set(found) == expected and len(found) == len(expected)
    top = routed._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in top
