"""Benchmark decontamination by winnowing.

Texts are sequences of words. The fingerprints of a text are the smallest
k-gram hashes of its sliding windows. A span that a document shares with a
benchmark item and that is as long as a window holds the same k-grams in both,
so the same smallest one: joining the fingerprints of both sides finds every
such span. A hit is extended to the windows around it, which are compared with
the item's word by word.

An item shorter than a window is one window of its own length; each length has
fingerprints of its own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perceptra.llm.common import by_size, materialise
from perceptra.llm.words import known_words, words

#: Bytes of benchmark text that are sent to the executors at once; more are met block by block.
BLOCK_BYTES = 16 << 20
#: Words of an item in one piece; pieces overlap, so that no window is lost.
_PIECE = 50_000
_SPANS = "array<struct<start:long,end:long>>"
#: The block that this Python worker has made last.
_MADE: dict[str, Block] = {}


def _hashes(ids: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """64-bit hashes of the ``size`` word numbers from each place of ``at``."""
    h = np.full(len(at), seed, np.uint64)
    for i in range(size):
        h = (h ^ ids[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _winnowed(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The places of the smallest of ``width`` grams from each place of ``starts``, the last of equal ones; each once."""
    best = starts.copy()
    for i in range(1, width):
        best = np.where(grams[starts + i] <= grams[best], starts + i, best)
    return np.unique(best)


def _whole(ids: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Where ``size`` known words of one text begin."""
    if len(ids) < size:
        return np.empty(0, np.int64)
    unknown = np.concatenate([[0], np.cumsum(ids < 0)])
    fine = unknown[size:] == unknown[:-size]
    for i in range(1, size):  # windows that another text's first word lies in
        cut = begin - i
        fine[cut[(cut >= 0) & (cut < len(fine))]] = False
    return np.flatnonzero(fine)


@dataclass
class Windows:
    """The distinct windows of one length: their fingerprints, hashes, words and items."""

    size: int
    gram: int
    seed: int
    prints: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, starts: np.ndarray, items: np.ndarray, size: int, gram: int) -> Windows:
        """Windows of ``size`` words that begin at ``starts`` and belong to ``items``."""
        gram = min(gram, size)
        rows, which = np.unique(ids[starts[:, None] + np.arange(size)], axis=0, return_inverse=True)
        own = np.unique(np.stack([which.ravel(), items], axis=1), axis=0)
        flat, at = rows.ravel(), np.arange(len(rows)) * size
        seed = 1
        while len(np.unique(hashes := _hashes(flat, at, size, seed))) < len(rows):
            seed += 1  # so that no two windows share a hash
        order = np.argsort(hashes)
        grams = _hashes(np.append(flat, np.zeros(gram, flat.dtype)), np.arange(len(flat)), gram, 0)
        prints = np.unique(grams[_winnowed(grams, at, size - gram + 1)])
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        own = own[np.argsort(place[own[:, 0]], kind="stable")]
        first = np.searchsorted(place[own[:, 0]], np.arange(len(rows) + 1))
        return cls(size, gram, seed, prints, hashes[order], rows[order], first, own[:, 1])

    def hits(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all occurrences in texts of word numbers."""
        starts = _whole(ids, begin, self.size)
        width = self.size - self.gram + 1
        if not len(starts):
            return starts, starts
        inside = np.unique((starts[:, None] + np.arange(width)).ravel()) if width > 1 else starts
        grams = np.zeros(len(ids), np.uint64)
        grams[inside] = _hashes(ids, inside, self.gram, 0)
        chosen = _winnowed(grams, starts, width)
        met = chosen[_found(self.prints, grams[chosen]) >= 0]
        around = np.unique((met[:, None] - np.arange(width)).ravel())
        around = np.intersect1d(around, starts, assume_unique=True)
        window = _found(self.hashes, _hashes(ids, around, self.size, self.seed))
        around, window = around[window >= 0], window[window >= 0]
        same = (ids[around[:, None] + np.arange(self.size)] == self.rows[window]).all(axis=1)
        return around[same], window[same]


def _found(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value among the sorted ``known``, or -1."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


@dataclass
class Block:
    """Benchmark items as windows over one vocabulary."""

    vocabulary: dict[bytes, int]
    names: np.ndarray
    windows: list[Windows]

    @classmethod
    def of(cls, names: list[str], texts: list[bytes], window: int, gram: int) -> Block:
        lists = [words(t) for t in texts]
        vocabulary = {w: i for i, w in enumerate(sorted({w for own in lists for w in own}))}
        distinct, item = np.unique(np.array(names, object), return_inverse=True)
        ids, begin = known_words(texts, vocabulary)
        sizes = np.minimum(np.diff(begin), window)
        out = []
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == size)
            starts = [np.arange(begin[i], begin[i + 1] - size + 1) for i in own]
            of_item = np.repeat(item[own], [len(s) for s in starts])
            out.append(Windows.of(ids, np.concatenate(starts), of_item, size, gram))
        return cls(vocabulary, distinct, out)

    def search(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
        """Of each text its number of words, the spans that occur in the items, and those items' names in order."""
        ids, begin = known_words(texts, self.vocabulary)
        edge = np.zeros(len(ids) + 1, np.int32)
        pairs = []
        for w in self.windows:
            at, window = w.hits(ids, begin)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + w.size, -1)
            met = np.unique(np.stack([np.searchsorted(begin, at, "right") - 1, window], axis=1), axis=0)
            count = w.first[met[:, 1] + 1] - w.first[met[:, 1]]
            place = np.arange(count.sum()) + np.repeat(w.first[met[:, 1]] - np.cumsum(count) + count, count)
            pairs.append(np.stack([np.repeat(met[:, 0], count), w.items[place]], axis=1))
        hit = np.concatenate([[0], np.cumsum(edge[:-1]) > 0]).astype(np.int8)
        starts = np.zeros(len(ids) + 1, bool)
        starts[begin] = True  # a span ends with its text
        hit = np.append(hit, 0)
        low = np.flatnonzero((hit[1:-1] == 1) & ((hit[:-2] == 0) | starts[:-1]))
        high = np.flatnonzero((hit[1:-1] == 1) & ((hit[2:] == 0) | starts[1:])) + 1
        doc = np.searchsorted(begin, low, "right") - 1
        spans: list[list[dict]] = [[] for _ in texts]
        for d, a, b in zip(doc.tolist(), (low - begin[doc]).tolist(), (high - begin[doc]).tolist(), strict=True):
            spans[d].append({"start": a, "end": b})
        items: list[list[str]] = [[] for _ in texts]
        if pairs:
            for d, i in np.unique(np.concatenate(pairs), axis=0).tolist():
                items[d].append(self.names[i])
        return np.diff(begin), spans, items


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """(item, piece, text): items in overlapping pieces of words, so that a block is near its size."""

    def run(batches):
        for batch in by_size(batches):
            rows = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = words(text)
                rows += [(item, at, b" ".join(own[at : at + _PIECE + window - 1])) for at in range(0, max(1, len(own) - window + 1), _PIECE) if own]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            kinds = (pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item", "piece", "text"])

    typed = items.where("item_id is not null").select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    return typed.mapInArrow(run, "item string, piece long, text binary").distinct()


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _search(docs: DataFrame, rows: DataFrame, window: int, gram: int, key: str, kind: str) -> DataFrame:
    """(key, n_words, spans, items) of every row of ``docs`` (key, text) against one block of pieces."""
    table = rows.select("item", "text").toArrow()
    held = docs.sparkSession.sparkContext.broadcast((table.column(0).to_pylist(), table.column(1).to_pylist()))
    name = uuid.uuid4().hex

    def run(batches):
        if name not in _MADE:  # once in each Python worker
            _MADE.clear()
            _MADE[name] = Block.of(*held.value, window, gram)
        for batch in by_size(batches):
            n, spans, items = _MADE[name].search(batch.column(1).to_pylist())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column(0), pa.array(n), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_words", "spans", "items"])

    return docs.mapInArrow(run, f"{key} {kind}, n_words long, spans {_SPANS}, items array<string>")


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of ``docs`` (doc_id, text).

    spans are the maximal runs of words that lie in some occurrence of a
    window: ``window`` consecutive words of an item of ``items`` (item_id,
    text), or the whole of an item of fewer words. items holds the ids, as
    strings in order, of which a window occurs.

    The items are measured first. Up to ``block_bytes`` of words they go to
    every executor and documents are not moved. More are dealt into blocks,
    each of which is searched in all documents; the rows of equal texts of
    all blocks are then brought together by the text's digest.

    Null and empty texts have no words and no spans; items without words or
    with a null item_id take no part; rows that repeat an item_id are one item;
    repeated documents and rows with a null doc_id come out as often as they go
    in; further columns are not read; no items: no spans; no documents: no rows.
    """
    pieces = materialise(_pieces(items, window))
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0))).first()[0]
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if size <= block_bytes:
        return _search(typed, pieces, window, gram, "doc_id", "long")
    blocks = -(-size // block_bytes)
    digest = F.sha2(F.coalesce("text", F.lit(b"")), 256)
    texts = materialise(typed.select(digest.alias("digest"), "text").dropDuplicates(["digest"]))
    found = None
    for b in range(blocks):
        own = pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)) == b)
        part = _search(texts, own, window, gram, "digest", "string")
        part = part if b == 0 else part.where(F.size("spans") > 0)  # the first block gives each text's row
        found = materialise(part) if found is None else found.unionByName(materialise(part))
    gathered = found.groupBy("digest").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def finish(batches):
        for batch in batches:
            spans = pa.array([_merged(s) for s in batch.column(2).to_pylist()], batch.column(2).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans, batch.column(3)], batch.schema.names)

    merged = materialise(gathered.mapInArrow(finish, f"digest string, n_words long, spans {_SPANS}, items array<string>"))
    return typed.select("doc_id", digest.alias("digest")).join(merged, "digest").drop("digest")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): ``occurrences`` in figures, for every row alike.

    n_hit counts the words in spans, items_sha256 is the digest of the items'
    ids joined by commas; contaminated where n_hit is above 0.
    """
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return occurrences(docs, items, window, **options).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, share: float = 0.0, **options) -> DataFrame:
    """``docs`` without the documents of whose words more than ``share`` are hit.

    All rows that stand for a doc_id and text are treated alike; rows with a
    null doc_id and null or empty texts stay; columns stay as they are.
    """
    n = "hit_" + "_" * max(map(len, docs.columns))  # no column of docs has this name
    digest = F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)
    keyed = docs.select(F.monotonically_increasing_id().alias("doc_id"), digest.alias("digest"), "text")
    keyed = materialise(keyed.dropDuplicates(["digest"]))
    found = occurrences(keyed.select("doc_id", "text"), items, window, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    bad = found.where(hit > share * F.col("n_words")).select("doc_id")
    bad = materialise(keyed.join(bad, "doc_id", "left_semi").select(F.col("digest").alias(n)))
    stays = docs.join(bad, (digest == F.col(n)) & F.col("doc_id").isNotNull(), "left_anti")
    return stays.select(*docs.columns)


def oracle_sql(window: int = 10) -> str:
    """The same rows in DuckDB's SQL, over ``documents`` and ``benchmark``."""
    lists = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH items AS (SELECT item_id, {lists} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {window}) AS size, w[i:i + least(len(w), {window}) - 1] AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS row, doc_id, CASE WHEN text IS NULL THEN [] ELSE {lists} END AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
hits AS (
  SELECT row, i, size, item_id FROM (
    SELECT row, i, size, w[i:i + size - 1] AS words FROM places JOIN sizes ON i + size - 1 <= len(w)) JOIN windows USING (size, words)),
counted AS (
  SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT row, i, size FROM hits)) GROUP BY row),
named AS (
  SELECT row, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN counted USING (row) LEFT JOIN named USING (row)"""
