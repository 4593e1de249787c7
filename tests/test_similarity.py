"""Exact nearest vectors against brute force, and what the bounds save."""

import numpy as np
import pytest

from perceptra.operators import similarity
from perceptra.operators.gallery import nearest

ROWS = "{} long, embedding array<double>"


def table(spark, name, matrix):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], ROWS.format(name)).repartition(3)


def clustered(n, centres, dim=16, spread=0.02, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    v = middle[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def brute(probes, candidates, k):
    scores = np.einsum("id,jd->ij", probes, candidates)
    order = np.lexsort((np.broadcast_to(np.arange(len(candidates)), scores.shape), -np.round(scores, 9)), axis=1)[:, :k]
    return {(i, r + 1): (int(j), round(scores[i, j], 7)) for i, row in enumerate(order) for r, j in enumerate(row)}


def found(rows):
    return {(r.id, r["rank"]): (r.other, round(r.score, 7)) for r in rows.collect()}


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_clusters_equal_brute_force_and_prune(spark, monkeypatch, broadcast_bytes, k):
    """Under a fifth of the pairs are scored, in both plans."""
    monkeypatch.setattr(similarity, "BLOCK", 64)
    v = clustered(3000, 40)
    v[7:700:11] = v[7]  # equal vectors, more than a block of them
    probes, candidates = v[:200], v
    counter = spark.sparkContext.accumulator(0)
    rows = nearest(table(spark, "id", probes), "id", table(spark, "other", candidates), "other", k, broadcast_bytes=broadcast_bytes, counter=counter)
    assert found(rows) == brute(probes, candidates, k)
    assert 0 < counter.value < len(probes) * len(candidates) / 5


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_without_clusters_equal_brute_force(spark, monkeypatch, broadcast_bytes):
    """Bounds that prune nothing, more neighbours than a ball or the table holds, probes of every size and zero."""
    monkeypatch.setattr(similarity, "BLOCK", 32)
    rng = np.random.default_rng(2)
    candidates = rng.normal(size=(300, 5)) * rng.lognormal(size=(300, 1))
    probes = np.vstack([rng.normal(size=(20, 5)) * 10.0 ** rng.integers(-6, 6, size=(20, 1)), np.zeros((1, 5))])
    for k in (50, 400):
        rows = nearest(table(spark, "id", probes), "id", table(spark, "other", candidates), "other", k, broadcast_bytes=broadcast_bytes)
        got, want = found(rows), brute(probes, candidates, k)
        assert got.keys() == want.keys()
        scale = np.linalg.norm(probes, axis=1)
        for (i, r), (_, score) in want.items():
            assert abs(got[i, r][1] - score) <= 1e-6 * max(1.0, scale[i])


def test_ties_go_to_the_smaller_id_in_both_plans(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    v = np.tile(clustered(20, 20, seed=3), (12, 1))
    for size in (1 << 26, 0):
        rows = nearest(table(spark, "id", v[:20]), "id", table(spark, "other", v), "other", 3, broadcast_bytes=size)
        best = {(r.id, r["rank"]): r.other for r in rows.collect()}
        assert best == {(i, r + 1): i + 20 * r for i in range(20) for r in range(3)}


def test_lengths_without_a_pivot_and_null_ids(spark, monkeypatch):
    """With one pivot the other lengths have none; rows without an id are probes that are ranked together."""
    monkeypatch.setattr(similarity, "PIVOTS", 1)
    vectors = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0, 0.0], [0.0, 2.0, 0.0], [3.0]]
    right = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], ROWS.format("other"))
    left = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(None, [0.0, 1.0])], ROWS.format("id"))
    rows = nearest(left, "id", right, "other", 1, broadcast_bytes=0).collect()
    assert {(r.id, r.other, r.score) for r in rows} == {(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0), (3, 3, 4.0), (4, 4, 9.0), (None, 1, 1.0)}


def test_no_probes(spark):
    none, some = spark.createDataFrame([], ROWS.format("id")), table(spark, "other", np.eye(3))
    for size in (1 << 26, 0):
        assert nearest(none, "id", some, "other", 2, broadcast_bytes=size).count() == 0
