"""Ranked lexical search by pipelined term partitioning.

The terms of all queries (items) are dealt to owners, the rare ones first.
Items travel in bundles, one for each range of documents, through the owners'
stages in turn: at a stage the bundle meets the postings of the owner's terms
in its range by a cogroup and adds their whole-number contributions to the
sparse accumulators it carries. After the last stage the best documents of
each range are put together.

Contributions are never negative. So what a bundle holds bounds the k-th best
score of its range from below, and the weights of the terms still to come bound
what an accumulator can reach: those that cannot reach the k-th best go.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perceptra.llm.common import by_size, materialise
from perceptra.llm.words import known_words, words

#: Bytes of items' terms that are searched at once; more are searched block by block.
BLOCK_BYTES = 16 << 20
#: No contribution of a term of weight w reaches w times this.
_MOST = 1_000_000


@dataclass
class Terms:
    """The distinct terms of a block of items: numbers from 0, in order."""

    vocabulary: dict[bytes, int]
    items: list
    #: (item number, term number), by term.
    pairs: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Terms:
        items = sorted({i for i, _ in rows})
        place = {i: n for n, i in enumerate(items)}
        vocabulary = {t: n for n, t in enumerate(sorted({t for _, t in rows}))}
        pairs = np.array([(place[i], vocabulary[t]) for i, t in rows], np.int64).reshape(-1, 2)
        return cls(vocabulary, items, pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))])


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of the distinct terms of each item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in by_size(batches):
            found = [sorted(set(words(t))) for t in batch.column(1).to_pylist()]
            own = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
            yield pa.RecordBatch.from_arrays([own, pa.array([t for f in found for t in f], pa.binary())], ["item_id", "term"])

    typed = items.where("item_id is not null").select("item_id", F.col("text").cast("binary"))
    return typed.mapInArrow(run, f"item_id {kind}, term binary").distinct()


def _index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(row, doc_id, n, terms, counts): each document's number of words and its known terms."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = held.value
        width = max(1, len(known))
        for batch in by_size(batches):
            ids, begin = known_words(batch.column(1).to_pylist(), known)
            n = np.diff(begin)
            doc = np.repeat(np.arange(len(n)), n)
            at, count = np.unique(doc[ids >= 0] * width + ids[ids >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(at, np.arange(len(n) + 1) * width).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (at % width, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = typed.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")
    return materialise(found.where("n > 0").withColumn("row", F.monotonically_increasing_id()))


def _frequencies(index: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term is."""

    def run(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    out = np.zeros(terms, np.int64)
    found = index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


@dataclass
class Plan:
    """What all stages know: weights, owners and items of the terms, bundles, and the corpus's counts."""

    terms: Terms
    weights: np.ndarray
    owner: np.ndarray
    owners: int
    documents: int
    words: int
    k: int
    #: Items of a bundle.
    bundle: int

    @classmethod
    def of(cls, terms: Terms, df: np.ndarray, documents: int, total: int, owners: int, k: int, bundle: int) -> Plan:
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        order = np.argsort(df, kind="stable")
        load = np.cumsum(df[order])
        owner = np.empty(len(df), np.int64)  # by falling weight, with as many postings each
        owner[order] = np.minimum(owners - 1, (load - df[order]) * owners // max(1, int(load[-1]) if len(load) else 1))
        return cls(terms, weights, owner, owners, documents, total, k, bundle)

    def bundles(self) -> int:
        return -(-len(self.terms.items) // self.bundle)

    def pairs_of(self, bundle: int) -> np.ndarray:
        """(item within the bundle, term) by term."""
        pairs = self.terms.pairs
        own = pairs[pairs[:, 0] // self.bundle == bundle]
        return np.stack([own[:, 0] % self.bundle, own[:, 1]], axis=1)

    def coming(self, bundle: int, stage: int) -> np.ndarray:
        """For each item of the bundle, what the stages after ``stage`` can add at most."""
        own = self.pairs_of(bundle)
        later = own[self.owner[own[:, 1]] > stage]
        return np.bincount(later[:, 0], self.weights[later[:, 1]], self.bundle).astype(np.int64) * _MOST

    def contributions(self, term: np.ndarray, count: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n * self.documents) // self.words
        return self.weights[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m))


def _postings(index: DataFrame, held, stage: int, ranges: int) -> DataFrame:
    """(bundle, range, row, doc_id, n, terms, counts): each document's terms of one owner, for the bundles that ask for them."""
    names = ["bundle", "range", "row", "doc_id", "n", "terms", "counts"]

    def run(batches):
        plan = held.value
        asked = np.unique(np.stack([plan.terms.pairs[:, 1], plan.terms.pairs[:, 0] // plan.bundle], axis=1), axis=0)
        asked = asked[plan.owner[asked[:, 0]] == stage]  # (term, bundle)
        first = np.searchsorted(asked[:, 0], np.arange(len(plan.owner) + 1))
        for batch in batches:
            terms, counts = (batch.column(i).flatten().to_numpy() for i in (4, 5))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(4).offsets.to_numpy()))
            times = first[terms + 1] - first[terms]
            own = np.repeat(np.arange(len(terms)), times)
            bundle = asked[np.arange(len(own)) + np.repeat(first[terms] - np.cumsum(times) + times, times), 1]
            order = np.lexsort((doc[own], bundle))
            own, bundle = own[order], bundle[order]
            key, start = np.unique(bundle * batch.num_rows + doc[own], return_index=True)
            ends = pa.array(np.append(start, len(own)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[own])) for v in (terms, counts)]
            rows = batch.select([0, 1, 2, 3]).take(pa.array(key % max(1, batch.num_rows)))
            bundles = pa.array((key // max(1, batch.num_rows)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([bundles, *rows.columns, *lists], names)

    typed = index.where("doc_id is not null").select(
        F.pmod(F.xxhash64("row"), F.lit(ranges)).cast("int").alias("range"), "row", "doc_id", "n", "terms", "counts"
    )
    return typed.mapInArrow(run, "bundle int, range int, row long, doc_id long, n long, terms array<int>, counts array<int>")


_CARRIED = "bundle int, range int, rows binary, doc_ids binary, items binary, docs binary, scores binary"


def _stage(carried: DataFrame, postings: DataFrame, held, stage: int) -> DataFrame:
    """The bundles with one owner's contributions; after the last owner (item, doc_id, score) of each range's best."""
    last = stage == held.value.owners - 1
    schema = "item int, doc_id long, score long" if last else _CARRIED

    def add(key, left: pa.Table, right: pa.Table) -> pa.Table:
        plan, bundle = held.value, key[0].as_py()
        rows = doc_ids = docs = scores = np.empty(0, np.int64)
        items = np.empty(0, np.int32)
        for carry in left.to_pylist():
            rows, doc_ids, scores = (np.frombuffer(carry[c], np.int64) for c in ("rows", "doc_ids", "scores"))
            items, docs = (np.frombuffer(carry[c], np.int32) for c in ("items", "docs"))
        right = right.combine_chunks()
        new = right.column("row").to_numpy()
        every, first = np.unique(np.concatenate([rows, new]), return_index=True)
        names = np.concatenate([doc_ids, right.column("doc_id").to_numpy()])[first]
        total = np.zeros((plan.bundle, len(every)), np.int64)
        total[items, np.searchsorted(every, rows)[docs]] = scores
        if right.num_rows:
            lists = right.column("terms").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            term, count = (right.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
            gain = plan.contributions(term, count, np.repeat(right.column("n").to_numpy(), sizes))
            place = np.repeat(np.searchsorted(every, new), sizes)
            order = np.argsort(term, kind="stable")
            term, gain, place = term[order], gain[order], place[order]
            pairs = plan.pairs_of(bundle)
            for t in np.unique(term).tolist():
                a, b = np.searchsorted(term, [t, t + 1])
                c, d = np.searchsorted(pairs[:, 1], [t, t + 1])
                total[pairs[c:d, 0][:, None], place[a:b][None]] += gain[a:b]
        kth = np.zeros(plan.bundle, np.int64)
        if len(every) > plan.k:
            kth = np.partition(total, len(every) - plan.k, axis=1)[:, len(every) - plan.k]
        reach = total + plan.coming(bundle, stage)[:, None]
        item, doc = np.nonzero((total > 0) & (reach >= kth[:, None]))
        score = total[item, doc]
        if last:
            order = np.lexsort((names[doc], -score, item))
            item, doc, score = item[order], doc[order], score[order]
            best = np.arange(len(item)) - np.searchsorted(item, item) < plan.k
            number = (item[best] + bundle * plan.bundle).astype(np.int32)
            return pa.table({"item": number, "doc_id": names[doc[best]], "score": score[best]})
        used, doc = np.unique(doc, return_inverse=True)
        parts = every[used], names[used], item.astype(np.int32), doc.astype(np.int32), score
        columns = [pa.array([p.tobytes()], pa.binary()) for p in parts]
        keys = [pa.array([k.as_py()], pa.int32()) for k in key]
        return pa.table([*keys, *columns], names=["bundle", "range", "rows", "doc_ids", "items", "docs", "scores"])

    keys = ("bundle", "range")
    return carried.groupBy(*keys).cogroup(postings.groupBy(*keys)).applyInArrow(add, schema)


def _search(docs: DataFrame, own: DataFrame, kind: str, k: int, owners: int, bundle: int, range_rows: int) -> DataFrame:
    spark = docs.sparkSession
    terms = Terms.of([(r.item_id, bytes(r.term)) for r in own.collect()])
    index = _index(docs, terms.vocabulary)
    counts = index.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    plan = Plan.of(terms, _frequencies(index, len(terms.vocabulary)), counts.documents, max(1, counts.words), owners, k, bundle)
    held = spark.sparkContext.broadcast(plan)
    ranges = max(1, -(-counts.documents // range_rows))
    empty = [F.lit(b"").alias(c) for c in ("rows", "doc_ids", "items", "docs", "scores")]
    at = F.col("id")
    carried = spark.range(ranges * plan.bundles()).select(F.floor(at / ranges).cast("int").alias("bundle"), (at % ranges).cast("int").alias("range"), *empty)
    for stage in range(owners):
        carried = _stage(carried, _postings(index, held, stage, ranges), held, stage)
    names = spark.createDataFrame(list(enumerate(terms.items)), f"item int, item_id {kind}")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = carried.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, owners: int = 4, bundle: int = 256, range_rows: int = 4096, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, all with a score above 0.

    Terms are runs of letters, digits and non-ASCII characters, A-Z in lower
    case. With N documents that hold a term, L terms in all, n in a document and
    df documents that hold a term, its weight is floor(1000 ln((2N+2)/(2df+1)));
    a document scores, over the item's distinct terms, the sum of
    weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + (50 n N div L). Equal
    scores by ascending doc_id.

    The items' terms are measured first; beyond ``block_bytes`` the items are
    searched block by block, each in all documents. A stage holds a table of
    ``bundle`` items and some ``range_rows`` documents; documents are ranged by row, so neither a term in all documents nor a doc_id that repeats is one
    key. Null and empty texts have no terms and no part; rows that repeat a
    doc_id are documents each, ranked in any order among equals; documents with
    a null doc_id count in N, L and df and are not returned; rows that repeat
    an item_id are one item, a null item_id is none; further columns are not
    read; no items or no documents: no rows.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    own = materialise(_item_terms(items))
    size = own.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    found = None
    for b in range(blocks):
        part = _search(docs, own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), kind, k, owners, bundle, range_rows)
        found = part if found is None else found.unionByName(part)
    return found


def oracle_sql(k: int = 50) -> str:
    """The same rows in DuckDB's SQL, over ``documents`` and ``benchmark``."""
    lists = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH asked AS (SELECT DISTINCT item_id, unnest({lists}) AS term FROM benchmark WHERE item_id IS NOT NULL),
docs AS (SELECT row_number() OVER () AS row, doc_id, {lists} AS w FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM sizes),
postings AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM postings CROSS JOIN corpus GROUP BY term, n_docs),
gains AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words))) AS gain
  FROM postings JOIN weights USING (term) JOIN sizes USING (row) CROSS JOIN corpus),
scores AS (
  SELECT item_id, doc_id, row, CAST(sum(gain) AS BIGINT) AS score FROM gains JOIN asked USING (term) WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= {k}"""
