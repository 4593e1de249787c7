"""Exact nearest vectors by inner product, with pruning.

Candidates lie in balls round pivots. For a probe q and a ball of pivot p and
radius r no member's inner product exceeds q.p + |q| r, so a ball whose bound
stays below the probe's k-th score is not visited. Pivots decide how much is
pruned, never what is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from perceptra.storage import materialise

#: Bytes of vectors that are sent to every executor at most; more are met block by block.
BROADCAST_BYTES = 64 << 20
#: Vectors in a block of the larger path.
BLOCK = 4096
#: Pivots at most, of all lengths together.
PIVOTS = 512
#: Scores held at a time.
_HELD = 4 << 20


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", matrix, matrix))


def _slack(probes: np.ndarray, longest: float) -> np.ndarray:
    """For each probe more than the rounding error of an inner product with a vector of length ``longest``."""
    slack = 1e-15 * (probes.shape[1] + 8) * _norms(probes) * longest
    return np.where(np.isfinite(slack), slack, 0.0)


def best_of(probes: np.ndarray, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each probe's ``k`` best rows of ``matrix``, by row and rank; ties to the earlier one.

    A matrix product finds who can be among the best, up to its rounding; those
    are scored one by one, so that equal vectors have equal scores.
    """
    step = max(1, _HELD // max(1, len(matrix)))
    slack = _slack(probes, _norms(matrix).max(initial=0.0))
    none = np.empty(0, np.int64)
    found = [(none, none, np.empty(0))]
    for at in range(0, len(probes), step):
        some = probes[at : at + step]
        rough = some @ matrix.T
        cut = max(0, rough.shape[1] - k)
        least = np.partition(rough, cut, axis=1)[:, cut]
        row, column = np.nonzero(rough >= (least - 2 * slack[at : at + step])[:, None])
        score = np.concatenate([
            np.einsum("ij,ij->i", some[row[i : i + BLOCK]], matrix[column[i : i + BLOCK]]) for i in range(0, len(row), BLOCK)
        ])
        order = np.lexsort((column, -score, row))
        row, column, score = row[order], column[order], score[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((row[best] + at, column[best], score[best]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def assign(matrix: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pivot, distance) of the pivot next to each row."""
    half = np.einsum("ij,ij->i", pivots, pivots) / 2
    step = max(1, _HELD // len(pivots))
    of = np.concatenate([(matrix[i : i + step] @ pivots.T - half).argmax(axis=1) for i in range(0, len(matrix), step)])
    return of, np.concatenate([_norms(matrix[i : i + BLOCK] - pivots[of[i : i + BLOCK]]) for i in range(0, len(matrix), BLOCK)])


def bounds(probes: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What no inner product of a probe and a ball's member exceeds, rounding included."""
    reach = radius * (1 + 1e-9)
    longest = (_norms(pivots) + reach).max(initial=0.0)
    bound = probes @ pivots.T + _norms(probes)[:, None] * reach + 4 * _slack(probes, longest)[:, None]
    return np.where(np.isnan(bound), np.inf, bound)


class Balls:
    """Vectors of one length, sorted by ball and within it by their place."""

    def __init__(self, matrix: np.ndarray):
        count = min(PIVOTS, int(len(matrix) ** 0.5)) if len(matrix) >= 64 else 1
        chosen = np.random.default_rng(0).choice(len(matrix), count, replace=False)
        of, far = assign(matrix, matrix[chosen])
        self.place = np.argsort(of, kind="stable")
        self.matrix, self.pivots = matrix[self.place], matrix[chosen]
        self.ends = np.searchsorted(of[self.place], np.arange(count + 1))
        self.radius = np.zeros(count)
        np.maximum.at(self.radius, of, far)

    def best(self, probes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(row, place, score) of each probe's ``k`` best, and how many pairs were scored; ties to the smaller place."""
        bound = bounds(probes, self.pivots, self.radius)
        order = np.argsort(-bound, axis=1, kind="stable")
        score, place = np.full((len(probes), k), -np.inf), np.full((len(probes), k), -1)
        scored = 0
        for j in range(len(self.pivots)):
            going = np.flatnonzero((bound[np.arange(len(probes)), order[:, j]] >= score[:, -1]))
            if not len(going):
                break
            ball = order[going, j]
            for b in np.unique(ball).tolist():
                low, high = self.ends[b], self.ends[b + 1]
                if low == high:
                    continue
                rows = going[ball == b]
                scored += len(rows) * int(high - low)
                r, c, s = best_of(probes[rows], self.matrix[low:high], k)
                n = np.arange(len(r)) - np.searchsorted(r, r)
                more, whose = np.full((len(rows), k), -np.inf), np.full((len(rows), k), -1)
                more[r, n], whose[r, n] = s, self.place[low + c]
                both, names = np.hstack([score[rows], more]), np.hstack([place[rows], whose])
                # Unused places come last: their score is lowest, and a place of -1 counts as the largest.
                by = np.lexsort((np.where(names < 0, np.iinfo(np.int64).max, names), -both), axis=1)[:, :k]
                score[rows], place[rows] = np.take_along_axis(both, by, 1), np.take_along_axis(names, by, 1)
        row, n = np.nonzero(place >= 0)
        return row, place[row, n], score[row, n], scored


def finite(rows: DataFrame, name: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the vectors that hold numbers only, one at least."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(name).alias("id"), v.alias("v")).where((F.size("v") > 0) & ~odd)


def _rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components of all, starts, lengths) of vectors without nulls."""
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), offsets[:-1] - offsets[0], np.diff(offsets)


def _by_length(lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (places, matrix)."""
    flat, starts, sizes = _rows(lists)
    places = {n: np.flatnonzero(sizes == n) for n in np.unique(sizes).tolist()}
    return {n: (at, flat[starts[at][:, None] + np.arange(n)]) for n, at in places.items()}


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _sent(own: DataFrame, asked: DataFrame, k: int, names: pa.DataType, schema: str, counter: Accumulator | None) -> DataFrame:
    """All candidates on every executor, in balls."""
    table = own.orderBy("id").toArrow()
    ids = _whole(table.column(0))
    parts = {n: (at, Balls(matrix)) for n, (at, matrix) in _by_length(_whole(table.column(1))).items()}
    known = own.sparkSession.sparkContext.broadcast((ids, parts))

    def run(batches):
        ids, parts = known.value
        for batch in batches:
            for length, (place, matrix) in _by_length(batch.column(1)).items():
                if length not in parts:
                    continue
                at, balls = parts[length]
                row, column, score, scored = balls.best(matrix, k)
                if counter is not None:
                    counter.add(scored)
                columns = [batch.column(0).take(pa.array(place[row])), ids.take(pa.array(at[column])).cast(names), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["probe", "candidate", "score"])

    return asked.mapInArrow(run, schema)


def _met(packs: DataFrame, blocks: DataFrame, k: int, schema: str, counter: Accumulator | None) -> DataFrame:
    """Packs of probes with the blocks of their key: the best of each block for each probe."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, probes), (names, matrix) = (
                    (s.field("id"), np.stack(np.split(s.field("v").flatten().to_numpy(), len(s))))
                    for s in (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                )
                row, column, score = best_of(probes, matrix, k)
                if counter is not None:
                    counter.add(len(probes) * len(matrix))
                columns = [ids.take(pa.array(row)), names.take(pa.array(column)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["probe", "candidate", "score"])

    joined = packs.join(blocks, ["length", "ball", "part"]).select("asked", "own")
    return joined.mapInArrow(run, schema)


def _dealt(own: DataFrame, asked: DataFrame, k: int, schema: str, counter: Accumulator | None) -> DataFrame:
    """Candidates in blocks of balls; a probe first meets one block for a floor of its k-th score, then what can pass it."""
    spark = own.sparkSession
    sample = _whole(own.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(PIVOTS).toArrow().column(1))
    pivots = {n: np.unique(matrix, axis=0) for n, (_, matrix) in _by_length(sample).items()}

    def put(batches):
        """Lengths that no pivot has share the length -1 and are met by all probes of their length."""
        for batch in batches:
            for length, (place, matrix) in _by_length(batch.column(1)).items():
                of, far = assign(matrix, pivots[length]) if length in pivots else (np.full(len(place), -1), np.zeros(len(place)))
                rows = batch.take(pa.array(place))
                sizes = pa.array(np.full(len(place), length, np.int32))
                columns = [*rows.columns, sizes, pa.array(of.astype(np.int32)), pa.array(far)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "length", "ball", "far"])

    kind, probe_kind = dict(own.dtypes)["id"], dict(asked.dtypes)["id"]
    placed = materialise(own.mapInArrow(put, f"id {kind}, v array<double>, length int, ball int, far double"))
    key = F.when(F.col("ball") < 0, -1).otherwise(F.col("length")).alias("length")
    stats = placed.groupBy(key, "ball").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    stats = [(r.length, r.ball, -(-r.n // BLOCK), r.n, r.radius) for r in stats.collect()]  # one for each pivot, and one
    parts = F.broadcast(spark.createDataFrame([(s[0], s[1], s[2]) for s in stats], "key int, ball int, parts long"))
    deal = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), n)
    blocks = (
        placed.withColumn("key", F.when(F.col("ball") < 0, -1).otherwise(F.col("length")))
        .join(parts, ["key", "ball"])
        .groupBy("length", "ball", deal(F.col("parts")).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("own"))
    )
    radius, count = ({n: np.zeros(len(p)) for n, p in pivots.items()} for _ in range(2))
    for length, ball, _, n, far in stats:
        if ball >= 0:
            radius[length][ball], count[length][ball] = far, n

    def route(first: bool):
        def run(batches):
            for batch in batches:
                floor = None if first else batch.column(2).to_numpy(zero_copy_only=False)
                for length, (place, matrix) in _by_length(batch.column(1)).items():
                    if length not in pivots:
                        row, ball = np.arange(len(place)), np.full(len(place), -1)
                    elif first:
                        near = np.argsort(-(matrix @ pivots[length].T), axis=1, kind="stable")
                        held = np.minimum(count[length], BLOCK)[near]
                        row, n = np.nonzero(np.cumsum(held, axis=1) - held < k)
                        ball = near[row, n]
                    else:
                        row, ball = np.nonzero(bounds(matrix, pivots[length], radius[length]) >= floor[place][:, None])
                    rows = batch.select([0, 1]).take(pa.array(place[row]))
                    sizes = pa.array(np.full(len(row), length, np.int32))
                    yield pa.RecordBatch.from_arrays([*rows.columns, sizes, pa.array(ball.astype(np.int32))], ["id", "v", "length", "ball"])

        return run

    groups = F.lit(max(1, -(-asked.count() // BLOCK)))

    def packs(rows: DataFrame, first: bool) -> DataFrame:
        """Probes of a ball, about ``BLOCK`` at a time, for one of its blocks or for each."""
        routed = rows.mapInArrow(route(first), f"id {probe_kind}, v array<double>, length int, ball int")
        packed = routed.groupBy("length", "ball", deal(groups).alias("g")).agg(F.collect_list(F.struct("id", "v")).alias("asked"))
        known = packed.withColumn("key", F.when(F.col("ball") < 0, -1).otherwise(F.col("length"))).join(parts, ["key", "ball"])
        last = F.when(F.lit(first) & (F.col("ball") >= 0), 0).otherwise(F.col("parts") - 1)
        return known.select("length", "ball", "asked", F.explode(F.sequence(F.lit(0), last.cast("long"))).alias("part"))

    met = _met(packs(asked, True), blocks, k, schema, counter)
    floors = _ranked(met, k).groupBy("probe").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    floors = floors.select("probe", F.when(F.col("n") >= k, F.col("floor")).alias("floor"))
    lowest = F.coalesce("floor", F.lit(float("-inf")))
    known = asked.join(floors, asked["id"].eqNullSafe(floors["probe"]), "left").select("id", "v", lowest.alias("floor"))
    return _met(packs(known, False), blocks, k, schema, counter)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("probe").orderBy(F.desc("score"), "candidate")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(
    probes: DataFrame, probe_id: str, candidates: DataFrame, candidate_id: str, k: int = 1,
    probe_vector: str = "embedding", candidate_vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES, counter: Accumulator | None = None,
) -> DataFrame:
    """(probe_id, candidate_id, score, rank): the ``k`` largest inner products; ties to the smaller id.

    The candidates are measured first. Up to ``broadcast_bytes`` they go to
    every executor, in balls: a probe visits balls by falling bound and stops
    below its k-th score. Beyond, they are dealt into balls round ``PIVOTS``
    of them and those into blocks of some ``BLOCK`` vectors. A probe meets one
    block, whose k-th score is a floor, and then all blocks of the balls whose
    bound reaches it, through an equal key; the best of each block are ranked.
    Memory stays that of a pack of probes and a block. ``counter``, if given,
    gets the number of pairs scored.

    Vectors that are null or empty or hold a null or a component that is not
    finite take no part on either side; vectors of different lengths do not
    meet. Rows that share a probe's id are ranked together. No candidates or no
    probes: no rows.
    """
    kind, probe_kind = dict(candidates.dtypes)[candidate_id], dict(probes.dtypes)[probe_id]
    schema = f"probe {probe_kind}, candidate {kind}, score double"
    own, asked = finite(candidates, candidate_id, candidate_vector), finite(probes, probe_id, probe_vector)
    size = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("components")).first()
    if not size.n:
        found = probes.sparkSession.createDataFrame([], schema)
    elif size.components * 8 <= broadcast_bytes:
        found = _sent(own, asked, k, to_arrow_type(candidates.schema[candidate_id].dataType), schema, counter)
    else:
        found = _dealt(own, asked, k, schema, counter)
    return _ranked(found, k).select(F.col("probe").alias(probe_id), F.col("candidate").alias(candidate_id), "score", "rank")
