"""SimHash near-duplicates through a byte-position inverted index.

A text's fingerprint has a bit for each place of a hash: set when it is set in
more than half of the hashes of the text's word shingles. Two fingerprints link
when they differ in few bits. Four differing bits touch at most four of eight
bytes, so linked fingerprints of 64 bits share at least four bytes in place:
the guaranteed number of matches.

The links by shingle similarity are all found: what the index, which is sure
for few bits only, leaves unjoined comes from lists of the sets' rare shingles.

The posting lists of single bytes would each hold 1/256 of a corpus, so a list
of the index stands for three bytes in place (or as many bits). The pairs that
meet in a list are counted: the bytes that they share in place are tallied,
pairs below the guaranteed minimum go, and only the others are verified on
their bits. Lists yield links that span what is linked, never all their pairs.
A crowded list is split by each group of the bits that its key leaves open, the
other bytes first, as linked members share one of the groups. What is crowded
after three splittings, or where links are not bound to so few bits, is dealt
into blocks that are compared pair by pair.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perceptra.llm.common import arrow_rows, by_size, give_back, join_hot, materialise, small
from perceptra.llm.components import connected_components
from perceptra.llm.passages import TEXT_ROWS, shingle_hashes

#: Fingerprints of one posting list that one task compares with one another.
BLOCK = 2048
#: How often a crowded list is split. Each time a member's rows are five; lists fall to 1/256, 1/64 and 1/32 of their length.
SPLITS = 3
_FAR = np.uint16(65535)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@dataclass(frozen=True)
class Scheme:
    """How fingerprints are indexed and compared.

    Each key of the index joins the units of ``unit`` bits at the places of
    one of ``keys``. Pairs sharing ``need`` bytes in place are verified: they
    link within ``most`` differing bits. Within ``sure`` bits a list's links
    only span its groups; groups further apart are joined by their closest pair.
    """

    bits: int
    unit: int
    keys: tuple[tuple[int, ...], ...]
    need: int
    sure: int
    most: int


def exact_scheme(max_bits: int = 4) -> Scheme:
    """64 bits; every pair within ``max_bits`` differing bits meets in some list."""
    need = 8 - max_bits
    return Scheme(64, 8, tuple(combinations(range(8), max(1, need - 1))), need, max_bits, max_bits)


def wide_scheme(keys: int = 64, units: int = 5) -> Scheme:
    """256 bits, for shingle similarities of 0.8 and more, which differ in about 39 bits and fewer."""
    rng = np.random.default_rng(42)
    found: list[tuple[int, ...]] = []
    while len(found) < keys:
        order = rng.permutation(64)
        found += [tuple(sorted(order[i : i + units].tolist())) for i in range(0, 64 - units + 1, units)]
    return Scheme(256, 4, tuple(found[:keys]), 3, 32, 62)


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text (null or no words: zero)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        starts, ends = [0], [len(joined)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(sizes + 1) - 1
        starts = (last - sizes)[: len(words) - shingle + 1].tolist()
        ends = last[shingle - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        part = slice(at, at + (1 << 16))
        cut = map(joined.__getitem__, map(slice, starts[part], ends[part]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(seed)), "<u8")
        ones += _ones(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return total


def shingle_sets(texts: list[bytes | None], size: int = 5) -> list[np.ndarray]:
    """The distinct shingle hashes of each text; of fewer words, the whole sequence is one; of none, nothing."""
    x, begin = shingle_hashes(texts, size)
    out = []
    for text, a, b in zip(texts, begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(x[a : b - size + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(text.lower().split()))], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """256-bit SimHash of distinct shingle hashes."""
    if not len(hashes):
        return bytes(32)
    ones = [_ones((hashes ^ s) * np.uint64(0xFF51AFD7ED558CCD) ^ ((hashes * s) >> np.uint64(31))) for s in _SEEDS]
    return np.packbits(2 * np.concatenate(ones) > len(hashes), bitorder="little").tobytes()


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, text): a row is known by its doc_id and its text, as several texts may have one doc_id."""
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, digest, fp): the eight bytes of every row's fingerprint, the highest first."""

    def run(batches):
        for batch in small(batches):
            found = [fingerprint(t, shingle, seed).to_bytes(8, "big") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], ["doc_id", "digest", "fp"])

    return _named(docs).mapInArrow(run, "doc_id long, digest long, fp binary")


def _values(prints: DataFrame) -> DataFrame:
    """(fp, least): each distinct fingerprint with its first row, by doc_id and digest; null where no row has a doc_id."""
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest"))
    return materialise(prints.groupBy("fp").agg(F.min(row).alias("least")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of ``width`` bytes as rows of 64-bit words."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
    return flat.reshape(-1, width // 8)


def _binary(rows: np.ndarray) -> pa.Array:
    width = 8 * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def distances(a: np.ndarray, b: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Differing bits of ``a`` and ``b`` row by row (shapes broadcast); _FAR below the count of shared bytes."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(*x.shape[:-1], 8 * x.shape[-1]) == 0).sum(axis=-1, dtype=np.uint8)
    out = np.full(shared.shape, _FAR)
    hit = shared >= scheme.need
    out[hit] = np.bitwise_count(x[hit]).sum(axis=-1, dtype=np.uint16)
    return out


def spanning(rows: np.ndarray, scheme: Scheme) -> list[tuple[int, int]]:
    """Links that span the groups among ``rows``, and the closest pair of every two groups within reach."""
    n = len(rows)
    step = max(1, (1 << 18) // n)
    apart = np.concatenate([distances(rows[i : i + step, None], rows[None], scheme) for i in range(0, n, step)])
    out, group, made = [], np.full(n, -1), 0
    for root in range(n):
        if group[root] >= 0:
            continue
        group[root], front = made, [root]
        while front:
            i = front.pop()
            new = np.flatnonzero((apart[i] <= scheme.sure) & (group < 0)).tolist()
            group[new] = made
            out += [(i, j) for j in new]
            front += new
        made += 1
    if made > 1 and scheme.most > scheme.sure:
        best = np.empty((4, 0), np.int64)  # the pair of groups, differing bits and both places
        for at in range(0, n, step):
            own = slice(at, at + step)
            near = (apart[own] <= scheme.most) & (group[own, None] != group) & (np.arange(n)[own, None] < np.arange(n))
            i, j = np.nonzero(near)
            i += at
            pair = np.minimum(group[i], group[j]) * made + np.maximum(group[i], group[j])
            best = np.concatenate([best, [pair, apart[i, j], i, j]], axis=1)
            best = best[:, np.lexsort((best[1], best[0]))]
            best = best[:, np.unique(best[0], return_index=True)[1]]
        out += list(zip(best[2].tolist(), best[3].tolist(), strict=True))
    return out


def _list_links(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) within lists of rows: short ones all at a time."""
    found = []
    for n in (2, 3, 4):
        own = starts[sizes == n]
        for i, j in combinations(range(n), 2):
            near = distances(rows[own + i], rows[own + j], scheme) <= scheme.most
            found.append(np.stack([own[near] + i, own[near] + j]))
    for a, n in zip(starts[sizes > 4].tolist(), sizes[sizes > 4].tolist(), strict=True):
        if links := spanning(rows[a : a + n], scheme):
            found.append(np.array(links).T + a)
    at = np.concatenate(found, axis=1).astype(np.int64)
    return rows[at[0]], rows[at[1]]


def links(values: DataFrame, scheme: Scheme) -> DataFrame:
    """(src, dst) that connect all distinct fingerprints ``fp`` that the scheme links.

    Every link lies within one linked group; a posting list yields fewer links
    than members, or than pairs of its groups.
    """
    width, choose = scheme.bits // 8, len(scheme.keys[0])

    def postings(batches):
        for batch in small(batches):
            rows = _matrix(batch.column(0), width)
            units = rows.view(np.uint8).reshape(len(rows), -1)
            if scheme.unit == 4:
                units = np.stack([units & 15, units >> 4], axis=2).reshape(len(rows), -1)
            units = units.astype(np.int64)
            keys = [
                (k << (scheme.unit * choose)) + sum(units[:, p] << (scheme.unit * i) for i, p in enumerate(places))
                for k, places in enumerate(scheme.keys)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.stack(keys, axis=1).ravel()), _binary(np.repeat(rows, len(keys), axis=0))], ["key", "fp"]
            )

    def emit(a, b, keys=None, members=None):
        one = np.unique(np.concatenate([a, b], axis=1), axis=0) if len(a) else np.empty((0, width // 4), np.uint64)
        k = 0 if keys is None else len(keys)
        src = pa.concat_arrays([_binary(one[:, : width // 8]), pa.nulls(k, pa.binary())])
        dst = pa.concat_arrays([_binary(one[:, width // 8 :]), _binary(members) if k else pa.nulls(0, pa.binary())])
        kind = pa.int64() if keys is None or keys.dtype == np.int64 else pa.binary()
        key = pa.concat_arrays([pa.nulls(len(one), kind), pa.array(keys if k else [], kind)])
        return pa.RecordBatch.from_arrays([key, src, dst], ["key", "src", "dst"])

    def meet(batches):
        """Rows sorted by key: links of the lists of up to BLOCK members; the members of longer ones go on with their key."""
        key, rows, long = np.empty(0, np.int64), np.empty((0, width // 8), np.uint64), None
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            rows = np.concatenate([rows, _matrix(batch.column(1), width)])
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            crowded = np.repeat((sizes > BLOCK) | (key[starts] == long), sizes)
            closed = np.arange(len(key)) < starts[-1]
            fine = (sizes > 1) & (starts < starts[-1]) & ~crowded[starts]
            go = crowded
            yield emit(*_list_links(rows, starts[fine], sizes[fine], scheme), key[go], rows[go])
            if crowded[-1]:
                long = key[-1]
            stay = ~closed & ~crowded
            key, rows = key[stay], rows[stay]
        if len(key) > 1:
            yield emit(*_list_links(rows, np.array([0]), np.array([len(key)]), scheme))

    spark = values.sparkSession
    shape = "key long, src binary, dst binary"
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lists = values.select("fp").repartition(parts, "fp").mapInArrow(postings, "key long, fp binary").repartition("key")
    met = materialise(lists.sortWithinPartitions("key").mapInArrow(meet, shape))
    found = met.where("key is null").select("src", "dst")
    crowded = met.where("key is not null").select("key", F.col("dst").alias("fp"))
    if crowded.isEmpty():
        return found.distinct()
    if scheme.sure < scheme.most:
        return found.union(_crowded(crowded, scheme)).distinct()
    for _ in range(SPLITS):
        # A list's key is its path of groups and what its members share; lists are dealt out by its hash.
        split = crowded.mapInArrow(_split_by(scheme), "key binary, fp binary")
        lists = split.select(F.xxhash64("key").alias("hash"), "key", "fp").repartition("hash").sortWithinPartitions("hash", "key")
        met = materialise(lists.select("key", "fp").mapInArrow(_meet_split(scheme, emit), "key binary, src binary, dst binary"))
        found = found.union(met.where("key is null").select("src", "dst"))
        crowded = met.where("key is not null").select("key", F.col("dst").alias("fp"))
        if crowded.isEmpty():
            return found.distinct()
    return found.union(_crowded(crowded.withColumn("key", F.xxhash64("key")), scheme)).distinct()


def _undecided(path: bytes, scheme: Scheme) -> list[np.ndarray]:
    """The bits of which the members of a list may differ, in groups, one of which every linked pair shares.

    ``path`` is the list's place in ``scheme.keys`` and then a group at each
    further splitting. With ``most`` differing bits in all, one of ``most`` + 1
    groups of the undecided bits has none.
    """
    known = [b for p in scheme.keys[path[0]] for b in range(p * scheme.unit, (p + 1) * scheme.unit)]
    left = np.setdiff1d(np.arange(scheme.bits), known)
    for g in path[1:]:
        left = np.concatenate([x for i, x in enumerate(np.array_split(left, scheme.most + 1)) if i != g])
    return np.array_split(left, scheme.most + 1)


def _split_by(scheme: Scheme):
    """Members of crowded lists to a shorter list for each group of undecided bits: its key is the path, and what is shared there.

    The first groups are the bytes in place that the key leaves out.
    """
    width, shift = scheme.bits // 8, scheme.unit * len(scheme.keys[0])

    def run(batches):
        for batch in small(batches):
            keys = batch.column(0).to_pylist()
            rows = _matrix(batch.column(1), width)
            bits = np.unpackbits(rows.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
            by_list: dict = {}
            for i, key in enumerate(keys):
                by_list.setdefault(key, []).append(i)
            out, place = [], []
            for key, own in by_list.items():
                path = bytes([key >> shift]) if isinstance(key, int) else key[1 : 1 + key[0]]
                shared = key.to_bytes(8, "big") if isinstance(key, int) else key[1 + key[0] :]
                for g, group in enumerate(_undecided(path, scheme)):
                    for i, value in zip(own, np.packbits(bits[np.ix_(own, group)], axis=1), strict=True):
                        out.append(bytes([len(path) + 1]) + path + bytes([g]) + shared + value.tobytes())
                        place.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), _binary(rows[np.array(place, np.int64)])], ["key", "fp"])

    return run


def _meet_split(scheme: Scheme, emit):
    """Rows sorted by list: links within short lists; the members of lists of over BLOCK go on, and are not held."""
    width = scheme.bits // 8

    def run(batches):
        key, rows, long = np.empty(0, object), np.empty((0, width // 8), np.uint64), None
        nothing = np.empty((0, width // 8), np.uint64)
        for batch in batches:
            key = np.concatenate([key, np.array(batch.column(0).to_pylist(), object)])
            rows = np.concatenate([rows, _matrix(batch.column(1), width)])
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            crowded = np.repeat((sizes > BLOCK) | (key[starts] == long), sizes)
            fine = (sizes > 1) & (starts < starts[-1]) & ~crowded[starts]
            yield emit(*_list_links(rows, starts[fine], sizes[fine], scheme), key[crowded], rows[crowded])
            long = key[-1] if crowded[-1] else long
            stay = (np.arange(len(key)) >= starts[-1]) & ~crowded
            key, rows = key[stay], rows[stay]
        if len(key) > 1:
            yield emit(*_list_links(rows, np.array([0]), np.array([len(key)]), scheme), np.empty(0, object), nothing)

    return run


def _crowded(members: DataFrame, scheme: Scheme) -> DataFrame:
    """(src, dst) of the posting lists of over BLOCK members, where no part must be shared.

    The lists are dealt into blocks; each pair of blocks is one unit of work,
    so no list is gathered whole.
    """
    width = scheme.bits // 8
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sized = join_hot(members, members, counts, ["key"], F.lit(16))
    blocks = F.ceil(2 * F.col("n") / BLOCK).cast("int")
    dealt = sized.withColumn("b", F.pmod(F.xxhash64("fp", F.lit(7)), blocks)).select(
        "key", "fp", "b", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    )
    unit = ["key", "low", "high"]
    dealt = dealt.select(
        "key", F.least("b", "other").cast("long").alias("low"), F.greatest("b", "other").cast("long").alias("high"), "fp"
    )

    def run(batches):
        held, rows = np.empty((0, 3), np.int64), np.empty((0, width // 8), np.uint64)

        def flush(keys, rows):
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            a, b = _list_links(rows, starts, np.diff(np.append(starts, len(keys))), scheme)
            return pa.RecordBatch.from_arrays([_binary(a), _binary(b)], ["src", "dst"])

        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns[:3]], axis=1)])
            rows = np.concatenate([rows, _matrix(batch.column(3), width)])
            if not len(held):
                continue
            open_from = np.flatnonzero((held != held[-1]).any(axis=1))
            cut = open_from[-1] + 1 if len(open_from) else 0
            if cut:
                yield flush(held[:cut], rows[:cut])
            held, rows = held[cut:], rows[cut:]
        if len(held):
            yield flush(held, rows)

    return dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "src binary, dst binary")


def _components(prints: DataFrame, values: DataFrame, linked: DataFrame) -> DataFrame:
    """(doc_id, digest, fp, least) of every row of ``prints``: the first row reachable.

    A fingerprint that many rows share is sent to where they are.
    """
    groups = connected_components(linked).withColumnRenamed("node", "fp")
    named = groups.join(values, "fp").groupBy("component").agg(F.min("least").alias("least_of_all"))
    member = groups.join(named, "component").select("fp", "least_of_all")
    ids = materialise(
        values.join(member, "fp", "left").select("fp", F.coalesce("least_of_all", "least").alias("least"))
    )
    return join_hot(prints, prints, ids, ["fp"], F.lit(64))


def near_duplicates(docs: DataFrame, max_bits: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links between
    fingerprints, the row's own included. Equal texts have equal fingerprints
    and meet in one distinct value before any comparison. A null or empty text
    has fingerprint zero and links like any other; repeated rows are returned
    as often as they come; a row with a null doc_id keeps its fingerprint, and
    its component_id is null where no numbered row is reachable. An empty
    table gives no rows. Other columns of ``docs`` are not read.
    """
    prints = materialise(fingerprints(docs, shingle, seed))
    return _exact(prints, max_bits).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def _exact(prints: DataFrame, max_bits: int) -> DataFrame:
    values = _values(prints)
    return _components(prints, values, links(values, exact_scheme(max_bits)))


def _first_of_group(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``found`` (doc_id, digest, least) leads to another row, and with one of equal rows.

    Rows are told apart by doc_id and text. Of rows equal in both the one with
    the smallest hash of all its columns stays, so that a second run keeps the
    same.
    """
    row, group = F.struct("doc_id", "digest"), F.col("least")
    state = found.where("doc_id is not null").groupBy("doc_id", "digest").agg(
        F.count(F.lit(1)).alias("times"), F.bool_and(row == group).alias("first")
    )
    long = "_" * max(map(len, docs.columns))  # no column of docs has these names
    id_, digest, kept = "id" + long, "digest" + long, "row" + long
    state = materialise(state.where("times > 1 or not first").select(F.col("doc_id").alias(id_), F.col("digest").alias(digest), "first"))
    same = (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64(F.col("text").cast("binary")) == F.col(digest))
    rest = docs.join(state.drop("first").hint("merge"), same, "left_anti")
    if state.where("first").isEmpty():
        return rest.select(*docs.columns)
    repeated = docs.join(state.where("first").drop("first"), same)
    order = F.xxhash64(*(f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")))
    repeated = repeated.groupBy(id_, digest).agg(F.min_by(F.struct(*docs.columns), order).alias(kept))
    return rest.select(*docs.columns).unionByName(repeated.select(*(F.col(kept)[c].alias(c) for c in docs.columns)))


def keep_one(docs: DataFrame, max_bits: int = 4) -> DataFrame:
    """``docs`` without near-copies by fingerprint: of each group the first row by doc_id and digest of its text stays.

    Columns stay as they are. Rows with a null doc_id always stay, as no group
    can name them; different texts with one doc_id are documents each, and of
    equal texts with one doc_id one stays; null and empty texts are one group;
    an empty table gives no rows.
    """
    return _first_of_group(docs, _exact(materialise(fingerprints(docs)), max_bits))


def similar_documents(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, component_id) for every row with a doc_id: groups linked by shingle similarity.

    Every two rows whose distinct ``size``-word shingles (lower case, split at
    ASCII white space; a text of fewer words is one shingle) have a Jaccard
    similarity of ``similarity`` or more are linked, and no others. The index
    of 256-bit fingerprints of the sets gives most links at little cost; all
    pairs that it has not joined and that can be alike come from the lists of
    the sets' rare shingles (``_unjoined``). Null and empty texts have no
    shingle and are alike. Different texts with one doc_id are documents each.
    Repeated rows come out as often as they go in; an empty table gives no
    rows; further columns are not read.
    """
    return _similar(docs, similarity, size).select("doc_id", F.col("least.doc_id").alias("component_id"))


_ENDS = ["src", "dst", "a", "a_digest", "b", "b_digest"]


def _end(end: str, name: str, of: str = "") -> tuple[Column, ...]:
    """A set and its first row as the columns of one end of a pair."""
    least = F.col(f"{of}least")
    return F.col(f"{of}fp").alias(end), least["doc_id"].alias(name), least["digest"].alias(f"{name}_digest")


_POSTING = np.dtype([("token", "<i8"), ("id", "<i8"), ("n", "<i4"), ("before", "<i4")])
#: Shingles that are counted at a time to tell common ones, and the texts among theirs that a common one is in.
_COUNTED, _OFTEN = 500_000, 4
#: Common shingles that are told apart by their counts; others are ordered by their hashes, which is as right.
_COMMON = 1 << 20
#: Names of rows that are sent to the texts; of more, the texts meet theirs in an exchange.
_SENT = 500_000
#: Postings of the lists that one task holds.
_POSTINGS = 250_000


def _tally(x: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each of some buckets, a power of two that grows with the set; empty where one has over 255."""
    buckets = 1 << max(6, (len(x) // 3).bit_length())
    counts = np.bincount((x & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _within_reach(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether two sets with these tallies can be alike: they share no more in a bucket than the smaller number."""
    if not x or not y:
        return True
    a, b = (np.frombuffer(t, np.uint8).astype(np.int64) for t in (x, y))
    least = min(len(a), len(b))
    both = np.minimum(a.reshape(-1, least).sum(axis=0), b.reshape(-1, least).sum(axis=0)).sum()
    return both >= similarity * (a.sum() + b.sum() - both) - 1e-6


def _prints_and_common(size: int):
    """Rows to (doc_id, digest, fp, id, wide, n, tally): the digest of the set of shingles and half of it, its fingerprint, size and tally.

    Rows without doc_id have shingles that several texts of a task hold, and how many.
    """

    def common(held):
        if not held:
            return
        x, n = np.unique(np.concatenate(held), return_counts=True)
        x, n = x[n >= _OFTEN], n[n >= _OFTEN]
        if len(x):
            one = [pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*one, pa.array([np.stack([x.view(np.int64), n]).tobytes()])], names)

    names = ["doc_id", "digest", "fp", "id", "wide", "n", "tally", "common"]

    def run(batches):
        held, counted = [], 0
        for batch in by_size(batches):
            sets = shingle_sets(batch.column(2).to_pylist(), size)
            whole = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            columns = [
                pa.array(whole, pa.binary()), pa.array([int.from_bytes(w[:8], "little", signed=True) for w in whole], pa.int64()),
                pa.array([wide_fingerprint(x) for x in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int32()),
                pa.array(list(map(_tally, sets)), pa.binary()), pa.nulls(batch.num_rows, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names)
            held.append(np.concatenate(sets))
            counted += len(held[-1])
            if counted > _COUNTED:
                yield from common(held)
                held, counted = [], 0
        yield from common(held)

    return run, "doc_id long, digest long, fp binary, id long, wide binary, n int, tally binary, common binary"


def _common_shingles(made: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles in the order of their hashes, and their counts: up to ``_COMMON`` of them."""

    def spread(batches):
        for batch in batches:
            for both in batch.column(0).to_pylist():
                x, n = np.frombuffer(both, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n)], ["x", "n"])

    counts = made.where("common is not null").select("common").mapInArrow(spread, "x long, n long")
    counts = materialise(counts.groupBy("x").agg(F.sum("n").alias("n")))
    classes = counts.groupBy(F.floor(F.log2("n")).alias("c")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("c")).collect()
    least, total = 1 << 62, 0
    for c, k in classes:
        total += k
        if total > _COMMON:
            break
        least = 1 << c
    found = counts.where(F.col("n") >= least).toArrow()
    x, n = (found.column(c).to_numpy().astype(np.int64) for c in ("x", "n"))
    x = x.view(np.uint64)
    order = np.argsort(x)
    return x[order], n[order]


def _rare_first(x: np.ndarray, common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """A set of shingles, given by rising hashes, in an order that all sets share: by their counts if they are common, by hashes."""
    known, counts, bits = common
    maybe = np.flatnonzero(bits[x >> np.uint64(40)])
    if not len(maybe):
        return x
    at = np.minimum(np.searchsorted(known, x[maybe]), len(known) - 1)
    weight = np.zeros(len(x), np.int64)
    weight[maybe] = np.where(known[at] == x[maybe], counts[at], 0)
    return x[np.argsort(weight, kind="stable")]


def _may(n, before, m, behind, similarity):
    """Whether sets of ``n`` and ``m`` can be alike whose first common shingle has ``before`` and ``behind`` others before it."""
    return np.minimum(n - before, m - behind) >= (similarity * (n + m)) / (1 + similarity) - 1e-6


def _list_pairs(token, n, before, similarity, group=None):
    """Places (i, j) of the pairs of each list that can be alike and are of different groups, some at a time; rows are sorted by token."""
    if not len(token):
        return
    fine = lambda i, j: _may(n[i], before[i], n[j], before[j], similarity) & (True if group is None else group[i] != group[j])
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.append(starts, len(token)))
    for k in (2, 3, 4):
        own = starts[sizes == k]
        for i, j in combinations(range(k), 2):
            near = own[fine(own + i, own + j)]
            yield near + i, near + j
    for a, k in zip(starts[sizes > 4].tolist(), sizes[sizes > 4].tolist(), strict=True):
        every, step = np.arange(a, a + k), max(1, (1 << 18) // k)
        for at in range(0, k, step):
            own = every[at : at + step, None]
            i, j = np.nonzero(fine(own, every[None]) & (own < every))
            yield i + a + at, j + a


def _unjoined(typed: DataFrame, made: DataFrame, values: DataFrame, linked: DataFrame, similarity: float, size: int) -> DataFrame:
    """(src, dst, ...) of all pairs of sets that can have the similarity and that ``linked`` does not join.

    In one order of all shingles, rare ones first, alike sets of n shingles
    share one of their first n - ceil(similarity n) + 1. The lists of these
    hold every such pair, and where the first shingle that it shares stands in
    both sets bounds its similarity. Pairs that pass, and whose tallies leave
    the similarity open, are returned.
    """
    spark = typed.sparkSession
    known, counts = _common_shingles(made)
    bits = np.zeros(1 << 24, bool)
    bits[known >> np.uint64(40)] = True
    held = spark.sparkContext.broadcast((known, counts, np.packbits(bits)))
    total = values.agg(F.sum((1 - similarity) * F.col("n") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // _POSTINGS + 1)

    def postings(batches):
        common = (held.value[0], held.value[1], np.unpackbits(held.value[2]).view(bool))
        seen, out, waiting = set(), [], 0

        def packed():
            rows = np.concatenate(out)
            part = ((rows["token"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cuts))
            lists = [rows[order[cuts[p] : cuts[p + 1]]].tobytes() for p in some]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(lists, pa.binary())], ["part", "postings"])

        for batch in by_size(batches):
            for x in shingle_sets(batch.column(2).to_pylist(), size):
                id_ = int.from_bytes(xxhash.xxh3_128_digest(x.tobytes())[:8], "little", signed=True)
                if not len(x) or id_ in seen:  # equal sets are one
                    continue
                seen.add(id_)
                first = _rare_first(x, common)[: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1]
                rows = np.empty(len(first), _POSTING)
                rows["token"], rows["id"], rows["n"], rows["before"] = first.view(np.int64), id_, len(x), np.arange(len(first))
                out.append(rows)
                waiting += len(rows)
                if waiting > _POSTINGS:
                    yield packed()
                    out, waiting = [], 0
        if out:
            yield packed()

    def lists(table):
        rows = np.frombuffer(b"".join(table.column("postings").to_pylist()), _POSTING)
        rows = rows[np.lexsort((rows["id"], rows["token"]))]
        new = np.ones(len(rows), bool)  # tasks may have equal sets
        new[1:] = (rows["token"][1:] != rows["token"][:-1]) | (rows["id"][1:] != rows["id"][:-1])
        rows = rows[new]
        some = np.zeros(len(rows), bool)
        for i, j in _list_pairs(rows["token"], rows["n"], rows["before"], similarity):
            some[i] = some[j] = True
        give_back()
        return pa.table({c: np.ascontiguousarray(rows[c][some]) for c in _POSTING.names})

    shape = "token long, id long, n int, before int"
    with arrow_rows(spark, TEXT_ROWS):
        dealt = typed.mapInArrow(postings, "part int, postings binary")
        met = materialise(dealt.groupBy("part").applyInArrow(lists, shape))
    held.unpersist()
    of_set = values.select("id", "fp", "least", "tally")
    group = connected_components(linked).join(of_set, F.col("node") == F.col("fp")).select("id", F.xxhash64("component").alias("group"))

    def across(table):
        table = table.sort_by("token")
        token, id_, n, before, own = (table.column(c).to_numpy() for c in ("token", "id", "n", "before", "group"))
        found, size_ = [np.empty((0, 2), np.int64)], 0
        for i, j in _list_pairs(token, n, before, similarity, own):
            found.append(np.stack([np.minimum(id_[i], id_[j]), np.maximum(id_[i], id_[j])], axis=1))
            size_ += len(i)
            if size_ > 1_000_000:
                found = [np.unique(np.concatenate(found), axis=0)]
                size_ = 0
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"one": pairs[:, 0].copy(), "two": pairs[:, 1].copy()})

    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), met.count() // _POSTINGS + 1)
    grouped = met.join(group, "id", "left").withColumn("group", F.coalesce("group", F.xxhash64("id", F.lit(1))))
    grouped = grouped.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(number)))
    pairs = materialise(grouped.groupBy("part").applyInArrow(across, "one long, two long").distinct())

    def reach(batches):
        for batch in small(batches):
            good = [_within_reach(x, y, similarity) for x, y in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)]
            yield batch.select(range(6)).filter(pa.array(good, pa.bool_()))

    end = lambda id_, fp, name: of_set.select(F.col("id").alias(id_), *_end(fp, name), F.col("tally").alias(f"{name}_tally"))
    one = join_hot(pairs, pairs, end("one", "src", "a"), ["one"], F.octet_length("a_tally"))
    two = join_hot(one, pairs, end("two", "dst", "b"), ["two"], F.octet_length("b_tally")).select(*_ENDS, "a_tally", "b_tally")
    with arrow_rows(spark, TEXT_ROWS):
        return materialise(two.mapInArrow(reach, "src binary, dst binary, a long, a_digest long, b long, b_digest long"))


def _alike(typed: DataFrame, pairs: DataFrame, similarity: float, size: int) -> DataFrame:
    """(src, dst) of the ``pairs`` whose sets of shingles have the similarity."""
    wanted = pairs.select(F.explode(F.array(*(F.struct(F.col(c).alias("doc_id"), F.col(f"{c}_digest").alias("digest")) for c in "ab"))).alias("w"))
    wanted = materialise(wanted.select("w.*").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= _SENT else wanted.hint("merge")

    def sets_of(batches):
        for batch in by_size(batches):
            found = [x.tobytes() for x in shingle_sets(batch.column(2).to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], ["doc_id", "digest", "x"])

    keys = ["doc_id", "digest"]
    with arrow_rows(typed.sparkSession, TEXT_ROWS):
        sets = materialise(
            typed.join(wanted, keys).mapInArrow(sets_of, "doc_id long, digest long, x binary").dropDuplicates(keys)
        )

    def verify(batches):
        for batch in small(batches):
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
                good.append(both > 0 and both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one = join_hot(pairs, pairs, sets.toDF("a", "a_digest", "x"), ["a", "a_digest"], F.octet_length("x"))
    two = join_hot(one, pairs, sets.toDF("b", "b_digest", "y"), ["b", "b_digest"], F.octet_length("y"))
    with arrow_rows(typed.sparkSession, 500):
        return materialise(two.select("src", "dst", "x", "y").mapInArrow(verify, "src binary, dst binary"))


def _similar(docs: DataFrame, similarity: float, size: int) -> DataFrame:
    """(doc_id, digest, fp, least) of every row with a doc_id; fp is the digest of its set of shingles."""
    typed = _named(docs.where("doc_id is not null"))
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        made = materialise(typed.mapInArrow(*_prints_and_common(size)))
    rows = made.where("doc_id is not null")
    prints = rows.select("doc_id", "digest", "fp")
    one = lambda c: F.any_value(c).alias(c)
    values = materialise(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "digest")).alias("least"), one("id"), one("wide"), one("n"), one("tally")))
    first = materialise(values.groupBy("wide").agg(F.min(F.struct("fp", "least")).alias("first")))
    near = links(first.select(F.col("wide").alias("fp")), wide_scheme())
    end = lambda wide, end, name: first.select(F.col("wide").alias(wide), *_end(end, name, "first."))
    pairs = near.toDF("one", "two").join(end("one", "src", "a"), "one").join(end("two", "dst", "b"), "two").select(*_ENDS)
    equal = values.join(first, "wide").where("fp != first.fp").select(*_end("src", "a", "first."), *_end("dst", "b"))
    linked = _alike(typed, materialise(pairs.unionByName(equal)), similarity, size)
    rest = _unjoined(typed, made, values, linked, similarity, size)
    return _components(prints, values, linked if rest.isEmpty() else linked.unionByName(_alike(typed, rest, similarity, size)))


def keep_one_similar(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of ``similar_documents``: the first by doc_id and digest of its text.

    Columns stay as they are. Rows with a null doc_id always stay; different
    texts with one doc_id are documents each, and of equal texts with one
    doc_id one stays; null and empty texts are one group; an empty table gives
    no rows.
    """
    return _first_of_group(docs, _similar(docs, similarity, 5))
