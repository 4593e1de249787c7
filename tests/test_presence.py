"""Presence at many moments: for each what the single call gives."""

import random
from datetime import datetime, timedelta

import pytest

from perceptra.operators import presence


@pytest.mark.parametrize("recent_s, cap", [(None, 300), (4.0, 300), (30.0, 7)])
def test_presence_at_many_moments(spark, recent_s, cap):
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = []
    for stream in range(3):
        at = 0.0
        for frame in range(60):
            at += rng.choice([0.0, 0.7, 1.5, 40.0 if frame % 20 == 19 else 0.5])
            for pos in range(rng.randrange(4)):
                rows.append((stream, frame, start + timedelta(milliseconds=int(at * 1000)), pos, rng.choice(["ann", "bob", "unknown", None, ""]), rng.random() < 0.3))
    names = spark.createDataFrame(rows, "stream_id long, frame_id long, ts timestamp, pos int, name string, is_fallen boolean")
    events = presence.presence_events(names)
    asked = [start + timedelta(seconds=s) for s in (-5, 0, 3, 17, 36, 75, 400)]
    moments = spark.createDataFrame([(s, m) for s in range(4) for m in [*asked, asked[2]]], "stream_id long, as_of timestamp")
    found = presence.presence_at(events, moments, recent_s, 10.0, cap)
    columns = sorted(c for c in found.columns if c != "as_of")
    plain = lambda r: tuple(str(sorted(r[c].items()) if isinstance(r[c], dict) else r[c]) for c in columns)
    by_moment = {}
    for r in found.collect():
        by_moment.setdefault(r.as_of, []).append(plain(r))
    for m in asked:
        expected = sorted(plain(r) for r in presence.presence_snapshot(events, m, recent_s, 10.0, cap).collect())
        assert sorted(by_moment.get(m, [])) == expected
    assert start - timedelta(seconds=5) not in by_moment and len(by_moment[asked[-1]]) == 3
