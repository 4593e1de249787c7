"""The corpus operators against brute force, library results, exact invariants and edge cases."""

import hashlib
import random
import re
import textwrap
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from perceptra.llm import (
    bpe,
    codec,
    divergence,
    licences,
    packing,
    passages,
    quality_model,
    queries,
    secrets,
    sharding,
    simhash,
    topk,
)
from perceptra.llm.components import connected_components

from ..conftest import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names an operator might use itself.
EXTRA = ("fp", "key", "component_id", "spans_", "x", "group_", "row_", "part_", "score")


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("z") for c in EXTRA}) if extra else df


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, short, very long and repeated texts; null and repeated ids; extra columns."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    texts = [None, "", "  \n\t ", "a", long, long, "one two three four five", "token = \"abcdef0123456789\"", "é 漢字 😀"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "lost id", None, None, None), (6, "one two three four five", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("z") for c in EXTRA})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def labels_of(spark, docs):
    return docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))


def operators(spark):
    path = queries.tokenizer()
    return {
        "simhash": lambda d: simhash.near_duplicates(d),
        "keep_one": simhash.keep_one,
        "similar": simhash.similar_documents,
        "keep_similar": simhash.keep_one_similar,
        "divergence": divergence.quality_rules,
        "packing": lambda d: packing.pack(d, path),
        "licences": licences.scan,
        "classify": lambda d: quality_model.classify(d, labels_of(spark, d)),
        "shards": sharding.shuffle_into_shards,
        "codec": lambda d: codec.round_trip(d, path),
        "passages": passages.near_duplicate_passages,
        "cut": passages.cut_repeats,
        "secrets": lambda d: secrets.span_digest(secrets.scan(d)),
        "redact": secrets.redact,
    }


#: Rows of the odd table: 11 in all.
ROWS = {"simhash": 11, "divergence": 11, "classify": 11, "shards": 11, "codec": 11, "secrets": 11, "redact": 11}


@pytest.mark.parametrize("name", ["simhash", "keep_one", "similar", "keep_similar", "divergence", "packing", "licences", "classify", "shards", "codec", "passages", "cut", "secrets", "redact"])
def test_odd_and_empty_tables(spark, odd, none, name):
    run = operators(spark)[name]
    found = run(odd).collect()
    if name in ROWS:
        assert len(found) == ROWS[name]
    assert run(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(6000, 6200)]
    root = {v: v for p in pairs for v in p}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    expected = {v: find(v) for p in pairs if p[0] != p[1] for v in p}
    found = connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {r.node: r.component for r in found} == expected and len(found) == len(expected)


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rng = random.Random(2)
    base = [prose(rng, rng.choice([3, 12, 60])) for _ in range(60)]
    texts = base + [" ".join(w if rng.random() > 0.03 else "zz" for w in t.split()) for t in base * 3] + ["", None, "É É é"]
    near = prose(rng, 300)
    texts += [near.replace(f"w{i} ", f"v{i} ", 1) for i in range(150)]
    prints = [slow_fingerprint(t) for t in texts]
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert found == {i: (f"{prints[i]:016x}", find(i)) for i in range(len(texts))}
    kept = {r.doc_id for r in simhash.keep_one(docs_of(spark, texts)).collect()}
    assert kept == {i for i in range(len(texts)) if find(i) == i}


@pytest.mark.parametrize("block", [8, 16, 2048])
def test_crowded_posting_lists_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SPLITS", 0)
    values = [sum(1 << b for b in range(12) if i >> b & 1) for i in range(300)] + [(1 << 63) + 5, 1 << 40]
    df = spark.createDataFrame([(v.to_bytes(8, "big"),) for v in values], "fp binary")
    found = connected_components(simhash.links(df, simhash.exact_scheme(4))).collect()
    assert {bytes(r.component) for r in found} == {bytes(8)} and len(found) == 302


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in (a, b))
    return len(a & b) / max(1, len(a | b))


def test_similar_documents_against_brute_force(spark):
    """Groups by shingle similarity 0.8: never a link below it, nearly all at and above it; one of each group stays."""
    rng = random.Random(3)
    base = [prose(rng, rng.choice([4, 30, 80, 200]), 5000) for _ in range(150)]
    texts = list(base)
    for t in base:
        words = t.split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = ["new"]
        texts.append(" ".join(words))
    texts += ["", None, "One two three", "one TWO three", "one two four"]
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    pairs = {(j, i) for i in range(len(texts)) for j in range(i) if similarity(texts[i] or "", texts[j] or "") >= 0.8 or texts[i] in ("", None) and texts[j] in ("", None)}
    for j, i in pairs:
        a, b = sorted((find(i), find(j)))
        group[b] = a
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(spark, texts, extra=True)).collect()}
    assert all(find(i) == find(c) for i, c in found.items())
    assert sum(found[i] == found[j] for i, j in pairs) >= 0.97 * len(pairs)
    kept = sorted(r.doc_id for r in simhash.keep_one_similar(docs_of(spark, texts, extra=True)).collect())
    assert kept == sorted(set(found.values()))


@pytest.mark.parametrize("common", [None, 2])
def test_no_similar_document_is_left_out(spark, monkeypatch, common):
    """Pairs just at 0.8 and just under it, with and without a line that all texts hold: all links are found, and no others."""
    if common:
        monkeypatch.setattr(simhash, "_OFTEN", common)
        monkeypatch.setattr(simhash, "_POSTINGS", 50)
    rng = random.Random(11)
    line = prose(rng, 12, 100_000)
    texts = []
    for n in range(400):
        words = prose(rng, rng.choice([40, 60, 94]), 100_000).split()
        size = len(words) - 4
        texts.append(" ".join(words) + (f" {line}" if n % 2 else ""))
        cut = int(size * 0.2) - rng.randrange(2)
        texts.append(" ".join(words[:-cut] if n % 3 else [*words[:-cut], "x"]) + (f" {line}" if n % 2 else ""))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    holders: dict = {}
    for i, own in enumerate(sets):
        for x in own:
            holders.setdefault(x, set()).add(i)
    expected = {i: i for i in range(len(texts))}
    for i in range(0, len(texts), 2):
        for j in set().union(*(holders[x] for x in sets[i] | sets[i + 1])):
            for k in (i, i + 1):
                if len(sets[k] & sets[j]) * 10 >= 8 * len(sets[k] | sets[j]):
                    assert j // 2 == i // 2
                    expected[i + 1] = i if j != k else expected[i + 1]
    assert 100 < sum(i != c for i, c in expected.items()) < 390
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(spark, texts)).collect()}
    assert found == expected


def test_crowded_lists_of_similar_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(5)
    near = prose(rng, 300, 100_000)
    texts = [near.replace(f"w{w} ", f"v{w} ", 1) for w in {int(x[1:]) for x in near.split()}] + [prose(rng, 100, 100_000) for _ in range(40)]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(spark, texts)).collect()}
    n = len(texts) - 40
    assert all(found[i] == (0 if i < n else i) for i in range(len(texts)))


def test_divergence_base_rules(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    texts = [r.text for r in rows] + ["a b c d e a b c d e x", "x x x x x x", "q\nq\n\nq \n", "[#*$%&|<>] é"]
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        seen = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
        lines, earlier, repeated = text.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                repeated += line in earlier
                earlier.add(line)
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered))
        assert divergence.base_rules(text.encode()) == expected


def test_divergence_against_brute_force(spark, sf_dir):
    """Both distances and the verdict, from counts of all words and characters of a language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, share = docs.collect(), 0.002
    words, chars = {}, {}
    for r in rows:
        words.setdefault(r.lang, Counter()).update(r.text.encode().lower().split())
        chars.setdefault(r.lang, np.zeros(8)).__iadd__(np.bincount(divergence._CLASS[np.frombuffer(r.text.encode(), np.uint8)], minlength=8))
    languages = {k for k, c in words.items() if c.total() >= 5_000}
    assert languages

    def distance(p, q):
        p, q = np.array(p) / np.sum(p), np.array(q) / np.sum(q)
        part = lambda a: sum(x * np.log2(x / ((x + y) / 2)) for x, y in zip(a, p + q - a, strict=True) if x > 0)
        return np.sqrt(max(0, (part(p) + part(q)) / 2))

    found = {r.doc_id: r for r in divergence.quality_rules(docs, least_reference=5_000).collect()}
    assert len(found) == len(rows)
    for r in rows:
        data, got = r.text.encode(), found[r.doc_id]
        own = Counter(data.lower().split())
        char = word = None
        if r.lang in languages:
            if len(data) >= 200:
                char = distance(np.bincount(divergence._CLASS[np.frombuffer(data, np.uint8)], minlength=8), chars[r.lang])
            if own.total() >= 100:
                least = share * words[r.lang].total()
                common = [w for w, n in words[r.lang].items() if n >= least]
                split = lambda c: [*(c[w] for w in common), c.total() - sum(c[w] for w in common)]
                word = distance(split(own), split(words[r.lang]))
        assert got.char_distance == (None if char is None else pytest.approx(char, abs=1e-9))
        assert got.word_distance == (None if word is None else pytest.approx(word, abs=1e-9))
        assert got.kept == (not got.base_failed and (char or 0) <= 0.25 and (word or 0) <= 0.34)


def test_bounded_counters_keep_all_frequent_words(spark, monkeypatch):
    """Words of a twentieth of a language are named whatever else there is; the counters stay few."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "b"]) if rng.random() < 0.12 else f"u{i}x{j}" for j in range(100)) for i in range(400)]
    typed = docs_of(spark, texts).repartition(20).select("lang", F.col("text").cast("binary"))
    found = divergence._frequent(typed, 0.05, 1_000)
    assert {w for _, w in found} >= {b"a", b"b"} and len(found) <= 40
    assert divergence._frequent(typed, 0.05, 1_000_000) == []


def test_divergence_keeps_good_and_drops_bad(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    found = queries.op2_distribution_divergence(spark, sf).join(labels, "doc_id")
    share = {r.quality: r.k for r in found.where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.98 and share[0] < 0.3


def test_distance():
    assert divergence.distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert divergence.distance(np.array([1.0, 3]), np.array([2.0, 6])) == pytest.approx(0)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 2)]) for i in range(700)]
    rows += [(700 + i, rows[i][1]) for i in range(100)]  # ties
    rows += [(900, None), (950, [1.0, float("nan"), 0.0]), (1000, [1.0, None, 0.0]), (None, [1.0] * 6), (1050, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows[:800]]
    expected = set()
    for q, x in whole:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in whole if i != q)[:5]
            expected |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    for pack, asked in ((4096, 1024), (128, 3)):
        found = topk.top_k(df, pack_rows=pack, query_rows=asked).collect()
        assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert topk.top_k(df.limit(0)).count() == 0


def test_queries_are_not_copied_for_candidates(spark, monkeypatch):
    """Packs of queries and candidates meet without a join that copies them for each other; shares of queries give the same rows."""
    plans, write = [], topk.materialise

    def seen(df):
        plans.append(df._jdf.queryExecution().toString())
        return write(df)

    monkeypatch.setattr(topk, "materialise", seen)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(900, 16)), 2))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.top_k(df, every=4, pack_rows=256, query_rows=64)
    assert not any("Join" in p for p in [*plans, found._jdf.queryExecution().toString()])
    assert sorted(found.collect()) == sorted(topk.top_k(df, every=4, pack_rows=256, query_rows=64, sent=1024).collect())
    assert found.count() == 5 * 225


def test_registered_sql(spark, duck, sf_dir):
    for name, sql in queries.ORACLES.items():
        expected = duck.sql(sql)
        columns = sorted(expected.columns)
        rows = [dict(zip(expected.columns, r, strict=True)) for r in expected.fetchall()]
        assert plain([r.asDict() for r in queries.QUERIES[name](spark, sf_dir).collect()], columns) == plain(rows, columns)


def test_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op4_best_fit_packing(spark, sf_dir).toPandas()
    for doc, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        own = found[found.doc_id == doc].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 2048))
        cut = [ids[s : s + 2048] for s in own.start]
        assert own.length.tolist() == [len(c) for c in cut]
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(c, "<u4").tobytes()) for c in cut]
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own.length.sum() <= 2048 and own.offset.tolist() == np.concatenate([[0], own.length.cumsum()[:-1]]).tolist()
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 2048) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_under_every_capacity(rule):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 60, 500)
    sequence, _ = packing.best_fit(lengths, (100, 4, 3600), (1.0, 1.0, 1.0), rule)
    for s in np.unique(sequence):
        own = lengths[sequence == s]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 3600


def test_licence_forms(spark):
    text = licences._MIT.replace("Software", "SOFTWARE").replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace(",", " ,\n")
    rows = docs_of(spark, ["MIT Licence\n\nCopyright (c) 2020 Somebody, all of it\n\n" + text, text + " and more", "words\nreleased under the mit licence"])
    assert {(r.doc_id, r.unit, r.line, r.license) for r in licences.scan(rows).collect()} == {(0, "text", -1, "MIT"), (2, "line", 1, "MIT")}


@pytest.mark.parametrize("width", [60, 72, 100, 10_000])
def test_whole_licences_wrapped_at_any_width(spark, width):
    texts = [(n, t) for n, t in licences.KNOWN if len(t) > 300]
    wrapped = ["Copyright (c) 2021, Somebody\n\n" + "\n".join(textwrap.wrap(t, width)) for _, t in texts]
    found = {(r.doc_id, r.license) for r in licences.scan(docs_of(spark, wrapped)).collect() if r.unit == "text"}
    assert found == {(i, n) for i, (n, _) in enumerate(texts)}
    assert licences.scan(docs_of(spark, ["a", "", None]), known=()).count() == 0
    assert licences.scan(docs_of(spark, ["copyright 2020 x", "", None]), known=(("x", "Copyright 2020 x"),)).count() == 0


def test_classifier_on_held_out_rows(spark):
    found = queries.op6_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and found.score.between(0, 1).all()


def test_discriminant_matches_its_formula():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(3, 3)), rng.normal(size=(3, 3))
    covs = [a @ a.T + np.eye(3), b @ b.T + np.eye(3)]
    means = rng.normal(size=(2, 3))
    factors = [np.linalg.cholesky(c) for c in covs]
    model = quality_model.Discriminant(0.3, means, np.stack([np.linalg.inv(f) for f in factors]), np.array([np.log(np.diag(f)).sum() for f in factors]))
    x = rng.normal(size=(5, 3))
    dense = [np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(c)) for m, c in zip(means, covs, strict=True)]
    assert model.score(x) == pytest.approx(0.3 * dense[1] / (0.3 * dense[1] + 0.7 * dense[0]))


def test_sharding(spark):
    n = 2003
    found = sharding.shuffle_into_shards(docs_of(spark, [None if i == 5 else "t" * (i % 7) for i in range(n)]), part_rows=20).toPandas()
    sizes = found.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 40 and sorted(found.doc_id) == list(range(n))
    for _, own in found.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    row = found[found.doc_id == 8].iloc[0]
    assert row["size"] == 17 and row.text_crc32 == zlib.crc32(b"t")
    # a uniform shuffle: the first and last thousand ids lie alike in shards and slots
    first = found[found.doc_id < 1000]
    assert abs(first.shard.mean() - 19.5) < 1.5 and abs(first.slot.mean() - 24.5) < 2


def test_hypergeometric_sums_and_mean():
    m = sharding.communication_matrix([30, 0, 50, 20], [25, 25, 25, 25], 7)
    assert m.sum(axis=1).tolist() == [30, 0, 50, 20] and m.sum(axis=0).tolist() == [25] * 4
    rng = np.random.default_rng(0)
    draws = [sharding.hypergeometric(rng, 3_000_000_000, 1_000_000_000, 4000) for _ in range(200)]
    assert abs(np.mean(draws) - 3000) < 8 and 20 < np.std(draws) < 35


def test_codec_matches_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer())
    rng = random.Random(4)
    parts = ["a", "th", "in", "é", "Σ", "İ", "\x1c", " ", "\n", "<|endoftext|>", "<|", "'s", "1", "½", "!!", "😀", "한", "́", "_", "\x00", "ſ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(2000)] + ["", "ab" * 3000 + " " + "lol" * 900]
    encoder, decoder = bpe.kept(queries.tokenizer())
    found = [[] for _ in texts]
    for i, ids, _ in encoder.streams(texts):
        found[i] += ids.tolist()
    for text, ids in zip(texts, found, strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert bpe.Decoding(decoder).feed(ids, True) == library.decode(ids, skip_special_tokens=False)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    row = codec.round_trip(docs_of(spark, ["Hello, world"]), queries.tokenizer()).first()
    ids = library.encode("Hello, world", add_special_tokens=False).ids
    assert (row.n_tokens, row.ids_sha256) == (len(ids), digest(" ".join(map(str, ids))))
    readable = codec.decode(codec.encode(docs_of(spark, ["Héllo 😀 world"]), queries.tokenizer()), queries.tokenizer(), readable=True)
    assert readable.first().text == "héllo 😀 world "


@pytest.mark.parametrize("read", [1, 3, 7, 40])
def test_any_cut_of_the_input_gives_the_same_ids(read, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "LONG_STRETCH", 20)
    library = Tokenizer.from_file(queries.tokenizer())
    encoder, decoder = bpe.kept(queries.tokenizer())
    rng = random.Random(read)
    parts = ["a", "th", "in", "é", "Σ", "İ", "\x1c", " ", "\n", "<|endoftext|>", "<|", "'s", "'", "re", "1", "½", "!!", "😀", "한", "́", "_", "\x00", "ſ", "ᄒ", "ᅡ", "ᆫ"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(80)))
        ids = encoder.encode(text, read)
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        for readable in (False, True):
            state = bpe.Decoding(decoder, readable)
            steps = [state.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)] + [state.feed([], True)]
            assert "".join(steps) == bpe.Decoding(decoder, readable).feed(ids, True)


def test_words_and_texts_of_any_length_take_constant_memory():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer())
    encoder, _ = bpe.kept(queries.tokenizer())
    for text in ("ab" * 20_000 + " " + "lol" * 3_000, "x" * 5_000 + "<|endoftext|>" + "y!" * 7_000, "!?" * 6_000, "한국어" * 5_000):
        assert encoder.encode(text, 3_000) == encoder.encode(text) == library.encode(text, add_special_tokens=False).ids

    def peak(text):
        tracemalloc.start()
        n = sum(len(ids) for _, ids, _ in encoder.streams([text], read=1 << 16, most=1 << 17))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, top

    n, small = peak("the quick brown fox " * 20_000)
    many, large = peak("the quick brown fox " * 500_000)
    assert many == 25 * n and large < 1.5 * small
    assert peak("ab" * 300_000)[1] < 1.5 * peak("ab" * 100_000)[1]


def test_lookahead_bounds_what_can_change():
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("aba", "ba")]
    reach = bpe.sufficient_lookahead(merges)
    assert reach is not None and reach <= 6
    assert bpe.sufficient_lookahead([("ab", "c"), ("a", "b")]) is None


def test_passages(spark):
    rng = random.Random(6)
    shared, other = prose(rng, 70, 4000), prose(rng, 60, 4000)
    changed = shared.split()
    changed[35] = "changed"
    texts = [prose(rng, 200, 4000) for _ in range(8)]
    texts[2] += " " + shared + " " + prose(rng, 80, 4000)
    texts[5] = prose(rng, 30, 4000) + " " + shared + " " + texts[5]
    texts[6] = texts[6] + " " + " ".join(changed)
    texts += [other + " " + prose(rng, 50, 4000), prose(rng, 90, 4000) + " " + other, " ".join(shared.split()[:40]), "same " * 90]
    found = passages.near_duplicate_passages(docs_of(spark, texts, extra=True)).collect()
    assert {(5, 2), (6, 2), (9, 8)} <= {(r.doc_id, r.first_id) for r in found} <= {(5, 2), (6, 2), (9, 8), (6, 5)}
    for r in found:
        own, first = texts[r.doc_id].split(), texts[r.first_id].split()
        if r.similarity == 1.0:
            assert own[r.start_word : r.end_word] == first[r.first_start : r.first_end] and r.end_word - r.start_word >= 60
    cut = {r.doc_id: r for r in passages.cut_repeats(docs_of(spark, texts, extra=True)).collect()}
    assert len(cut) == len(texts) and cut[2].text == texts[2] and shared not in cut[5].text and cut[5].text.startswith(texts[5][:40])
    assert cut[5].n_chars == len(cut[5].text) and all(cut[i].text == texts[i] for i in (0, 1, 3, 4, 7, 8, 10, 11))


def test_passages_past_an_unrelated_first_partner(spark):
    """Doc 0 holds every min-hash shingle of the passage in unrelated places; doc 2 holds them before the passage too."""
    rng = random.Random(8)
    shared, other = (prose(rng, 60, 100_000).split() for _ in range(2))
    scatter = lambda words: " ".join(" ".join(words[i : i + 5]) + " " + prose(rng, 60, 100_000) for i in range(56))
    texts = [scatter(shared), prose(rng, 90, 100_000) + " " + " ".join(shared), scatter(other) + " " + " ".join(other)]
    texts += [" ".join(shared) + " " + prose(rng, 90, 100_000), prose(rng, 70, 100_000) + " " + " ".join(other)]
    found = passages.near_duplicate_passages(docs_of(spark, texts)).collect()
    assert {(r.doc_id, r.first_id) for r in found} == {(3, 1), (4, 2)}
    whole = {d: set().union(*(range(r.start_word, r.end_word) for r in found if r.doc_id == d)) for d in (3, 4)}
    assert whole[3] == set(range(60)) and whole[4] == set(range(70, 130))


def test_passages_of_exact_and_changed_copies_with_a_partial_one_before(spark):
    """Documents A hold a part of a passage, B and C all of it; in half the cases C has one word changed."""
    rng = random.Random(12)
    parts = {0: [], 1: [], 2: []}
    n = 60
    for i in range(n):
        words = prose(rng, 60, 100_000).split()
        changed = list(words)
        if i % 2:
            changed[rng.randrange(5, 55)] = "changed"
        parts[0].append(prose(rng, 50, 100_000) + " " + " ".join(words[: (30, 42)[i % 4 > 1]]) + " " + prose(rng, 50, 100_000))
        parts[1].append(prose(rng, 70, 100_000) + " " + " ".join(words) + " " + prose(rng, 40, 100_000))
        parts[2].append(" ".join(changed) + " " + prose(rng, 90, 100_000))
    found = passages.near_duplicate_passages(docs_of(spark, parts[0] + parts[1] + parts[2])).collect()
    pairs = {r.doc_id - 2 * n for r in found if r.first_id == r.doc_id - n and r.doc_id >= 2 * n}
    assert pairs >= set(range(0, n, 2)) and len(pairs) > 0.9 * n
    assert all(r.doc_id - r.first_id in (n, 2 * n) and r.first_id % n == r.doc_id % n for r in found)


@pytest.mark.parametrize("part_in", ["a later document of the batch", "the first document", "the second document"])
def test_passages_whose_signatures_a_part_before_them_has_too(spark, part_in):
    """45 of a passage's 50 words stand before the passage in one of its documents, or in another one of the second's batch.

    Signatures then meet that part first, though it is no passage.
    """
    rng = random.Random(15)
    n, firsts, others = 40, [], []
    for i in range(n):
        words = prose(rng, 50, 100_000).split()
        whole, part = " ".join(words), " ".join(words[:45]) + " " + prose(rng, 60, 100_000)
        own, other = prose(rng, 60, 100_000) + " " + whole, prose(rng, 70, 100_000) + " " + whole
        if part_in == "the first document":
            own = part + " " + whole
        elif part_in == "the second document":
            other = part + " " + whole
        else:
            others.append((n + i, part))
        firsts.append((i, own))
        others.append((2 * n + i, other))
    docs = spark.createDataFrame(firsts, "doc_id long, text string").coalesce(1).union(spark.createDataFrame(others, "doc_id long, text string").coalesce(1))
    found = passages.near_duplicate_passages(docs).collect()
    assert {(r.doc_id, r.first_id) for r in found} == {(2 * n + i, i) for i in range(n)}
    texts = dict(firsts + others)
    for r in found:
        assert texts[r.doc_id].split()[r.start_word : r.end_word] == texts[r.first_id].split()[r.first_start : r.first_end]
        assert r.end_word - r.start_word == 50


def bytes_of(spark, texts):
    return docs_of(spark, texts).withColumn("text", F.col("text").cast("binary"))


def common_passage(n):
    """Texts that share a passage of 120 words, half of them another one of 70 as well, after a first that has parts of the former."""
    rng = random.Random(16)
    shared, other = prose(rng, 120, 100_000).split(), " ".join(prose(rng, 70, 100_000).split())
    texts = [" ".join(shared[:60]) + " " + prose(rng, 30, 100_000) + " " + " ".join(shared[40:])]
    for i in range(n - 1):
        texts.append(prose(rng, rng.randrange(5, 40), 100_000) + " " + " ".join(shared) + " " + prose(rng, 20, 100_000) + (" " + other if i % 2 else ""))
    return texts


def test_a_passage_that_many_documents_share_makes_few_rows_each(spark):
    """Runs of links leave a batch, not one row for each place: that made 27 rows a document here."""
    rows = {}
    for n in (400, 800):
        linked, _ = passages.links(bytes_of(spark, common_passage(n)).coalesce(2), 46, 3, 5)
        rows[n] = linked.count()
        assert rows[n] < 6 * n
    assert rows[800] < 2.2 * rows[400]


@pytest.mark.parametrize("followers, at_once, parts", [(256, 1 << 19, 3), (7, 100, 2), (1, 1, 1)])
def test_regions_do_not_depend_on_what_a_batch_has_joined(spark, monkeypatch, followers, at_once, parts):
    """Regions equal those of all single links with the first of each signature."""
    monkeypatch.setattr(passages, "FOLLOWERS", followers)
    monkeypatch.setattr(passages, "AT_ONCE", at_once)
    texts = common_passage(150)
    linked, _ = passages.links(bytes_of(spark, texts).repartition(parts), 46, 3, 5)
    found = sorted(tuple(r) for r in passages.regions(linked, 46).collect())
    met = {}
    for doc, text in enumerate(texts):
        sig, at, n, low, high = passages.signatures(passages.shingles(text.encode()), 46, 3)
        for key, place in zip(sig.tolist(), ((at << 20) | ((n - 1) << 14) | ((low - at) << 7) | (high - at)).tolist(), strict=True):
            met.setdefault(key, set()).add((doc, place))
    single = []
    for places in met.values():
        (first, at), *others = sorted(places)
        single += [(doc, p, first, at) for doc, p in others if len({d for d, _ in places}) > 1]
    expected = passages.merged(passages._runs(*np.array(sorted(single), np.int64).T, 46))
    assert found == sorted(map(tuple, expected.T.tolist())) and len(found) > 200


def test_word_hashes_tell_words_apart():
    words = [b"a", b"A", b"ab", b"abcdefgh", b"abcdefghi", b"x" * 255, b"x" * 256, b"x" * 257, b"X" * 257, b"\xc3\x84", b"\x00", b"\x00\x00"]
    h, begin = passages.word_hashes([None, b"", b" \t\n", b" ".join(words[:5]), b"\v" + b"\r\f".join(words[5:]) + b"\n"])
    assert begin.tolist() == [0, 0, 0, 0, 5, 12]
    assert h[0] == h[1] and h[7] == h[8] and len(set(h.tolist())) == 10
    assert all(passages.word_hashes([w])[0].tolist() == [v] for w, v in zip(words, h.tolist(), strict=True))


def test_passages_against_brute_force(spark, sf_dir):
    """All words in exact runs of 50 that an earlier document has are found, and 0.95 of the documents with any passage."""
    found = queries.op9_substring_dedup(spark, sf_dir).collect()
    covered, firsts = {}, {}
    for r in found:
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        firsts.setdefault(r.doc_id, set()).add(r.first_id)
    x = {r.doc_id: passages.shingles((r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen, exact, alike = set(), {}, set()
    for doc in sorted(x):
        runs = [tuple(x[doc][i : i + 46].tolist()) for i in range(len(x[doc]) - 45)]
        exact[doc] = {w for i, r in enumerate(runs) if r in seen for w in range(i, i + 50)}
        seen.update(runs)
    for doc in x:
        for first in x:
            if first < doc and len(np.intersect1d(x[doc], x[first])) >= 36 and passages.verified(x[doc], x[first], 46, 0.8):
                alike.add(doc)
    assert all(exact[doc] <= covered.get(doc, set()) for doc in x)
    assert len(alike & covered.keys()) >= 0.95 * len(alike) and covered.keys() <= alike
    assert any(exact.values()) and all(f < d for d in firsts for f in firsts[d])


def test_passages_at_the_least_similarity(spark):
    """Passages of just 50 words with one word changed have similarity 0.80; over nine tenths are found."""
    rng = random.Random(13)
    n, own, other = 150, [], []
    for _ in range(n):
        words = prose(rng, 50, 100_000).split()
        changed = list(words)
        changed[rng.randrange(5, 45)] = "changed"
        own.append(prose(rng, 70, 100_000) + " " + " ".join(words) + " " + prose(rng, 40, 100_000))
        other.append(prose(rng, 20, 100_000) + " " + " ".join(changed) + " " + prose(rng, 90, 100_000))
    found = passages.near_duplicate_passages(docs_of(spark, own + other)).collect()
    assert len({r.doc_id for r in found if r.first_id == r.doc_id - n}) > 0.9 * n


def test_rows_that_repeat_a_doc_id_keep_their_own_words(spark):
    rng = random.Random(14)
    shared, own = prose(rng, 60, 100_000), prose(rng, 100, 100_000)
    rows = [(1, shared + " " + prose(rng, 30, 100_000)), (2, prose(rng, 20, 100_000) + " " + shared), (2, own), (3, own), (None, own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = sorted((r.doc_id or 0, r.text) for r in passages.cut_repeats(docs).collect())
    assert len(cut) >= 4 and (0, own) in cut and (1, rows[0][1]) in cut and (2, own) in cut
    assert all(t in {r[1] for r in rows} | {rows[1][1].split(shared)[0]} for _, t in cut)


def test_compact_windows_are_the_wide_nodes():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    expected = set()

    def split(low, high):
        if high - low + 1 >= 20:
            c = low + int(x[low : high + 1].argmin())
            expected.add((low, c, high))
            split(low, c - 1)
            split(c + 1, high)

    split(0, 299)
    assert set(zip(*(v.tolist() for v in passages.compact_windows(x, 20)), strict=True)) == expected


def test_secret_spans(spark):
    key = "AKIA" + "ABCD1234EFGH5678"
    noise = "x9Q2mZ7pL4vT8kR1wB6nY3cJ5"
    texts = [f"password: 'hunter2hunter2' {key} é {'0af' * 11}", "api_key=short token", f"plain words and {noise} here", "understandingly internationalization 4068516892505468"]
    texts += ["the quick brown fox jumps over lazy dogs and understands internationalization_of_things " * 4000]
    found = {r.doc_id: r for r in secrets.span_digest(secrets.scan(docs_of(spark, texts))).collect()}
    base = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", texts[0], re.I):
        base.append(f"assign:{m.start()}:{m.end()}")
    base += [f"access:{texts[0].index(key)}:{texts[0].index(key) + 20}", f"hex:{texts[0].index('0af')}:{len(texts[0])}"]
    assert found[0].spans == ",".join(base) and found[0].base_sha256 == hashlib.sha256(found[0].spans.encode()).hexdigest()
    assert (found[0].n_assign, found[0].n_access, found[0].n_hex) == (1, 1, 1)
    assert found[1].spans == "" and found[1].base_sha256 == secrets.empty_digest()
    at = texts[2].index(noise)
    assert found[2].spans == f"markov:{at}:{at + len(noise)}" and found[2].base_sha256 == secrets.empty_digest()
    assert found[3].spans == "" and found[4].spans == ""
    clean = {r.doc_id: r.text for r in secrets.redact(docs_of(spark, texts, extra=True)).collect()}
    assert noise not in clean[2] and "hunter2" not in clean[0] and clean[3] == texts[3]


def test_secrets_of_letters_in_paths_and_beside_fixed_patterns(spark):
    words = "the quick brown fox jumps over lazy dogs and understands internationalization_of_things/and.other-names In May 2024 The Old NATO Office Paid 1500 to Quentin Zhao " * 2000
    rng = random.Random(9)
    key = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    some = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    letters, joined, short, deep = key(32, some), key(30, some + "0123456789"), key(16, some + "0123456789"), key(24, some + "0123456789")
    hexes = "".join(f"{rng.randrange(1 << 160):040x}" for _ in range(2))
    values = " ".join(f"token={key(40, some + '0123456789')}" for _ in range(200))
    path = "/the/quick/brown/fox/jumps/over/lazy/dogs/and/understands/internationalization/of/things/"
    texts = [words, values, f"use {letters} now", f"use {hexes}/{joined} now", f"use {short} now", f"use {path}{deep} now"]
    clean = {r.doc_id: r.text for r in secrets.redact(docs_of(spark, texts)).collect()}
    assert clean[0] == words
    for i, secret in ((2, letters), (3, joined), (4, short), (5, deep)):
        assert secret not in clean[i] and not any(secret[j : j + 4] in clean[i] for j in range(len(secret) - 3)), i
    assert clean[5].startswith(f"use {path[:40]}")


def test_recall_on_random_strings_and_precision_on_identifiers(spark):
    """Trained on a given table; none of the identifiers below is among the samples."""
    model = secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rng = random.Random(1)
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    found = lambda text: secrets.random_stretches(text, secrets.base_spans(text), model, 0.5)
    for alphabet in (lower + lower.upper() + digits, lower + lower.upper(), lower + digits):
        for length, least in ((20, 0.88), (24, 0.95), (32, 0.97)):
            runs = ["".join(rng.choice(alphabet) for _ in range(length)) for _ in range(300)]
            assert sum(bool(found(f"use {r} now")) for r in runs) >= least * len(runs)
    for alphabet in (lower.upper() + digits, lower.upper() + "234567"):
        for length, least in ((20, 0.9), (24, 0.97), (32, 0.99)):
            runs = ["".join(rng.choice(alphabet) for _ in range(length)) for _ in range(300)]
            assert sum(bool(found(f"use {r} now")) for r in runs) >= least * len(runs)
    capitals = """INTERNATIONALIZATION_OF_GOVERNMENTS MAX_CONCURRENT_CONNECTIONS_PER_HOST ERR_SSL_VERSION_OR_CIPHER_MISMATCH
    DONAUDAMPFSCHIFFAHRTSGESELLSCHAFT ANTICONSTITUTIONNELLEMENT HTTP_STATUS_INTERNAL_SERVER_ERROR ISO-8859-1_UTF-16LE_CP1252
    GL_TEXTURE_COMPRESSION_S3TC_DXT5_EXT DE89370400440532013000 ISBN-978-3-16-148410-0 AVX512VNNI_AVX512BW_SSE42
    RFC2616-SECTION-14.9.1 CVE-2021-44228-LOG4SHELL X86_64-PC-LINUX-GNU ORDER-2024-000123-EU INV20240115-000042""".split()
    assert [n for n in capitals if found(f"see {n} ok")] == []
    names = """kubernetes-dashboard-service-account org.springframework.boot.autoconfigure ReadOnlyMemoryBufferTooSmallException
    get_user_profile_by_username /home/ubuntu/workspace/pipeline/jenkins opt/conda/envs/pytorch/lib InvalidArgumentException
    counterrevolutionaries Donaudampfschifffahrtsgesellschaft en.wikipedia.org/wiki/Special:Random UPPER_CASE_CONSTANT_NAME
    github.com/tensorflow/tensorflow/blob/master/README.md utf8_general_ci_collation backgroundColorAttribute
    550e8400-e29b-41d4-a716-446655440000 antidisestablishmentarianism 2023-11-05-release-notes-v2.3.1 2024-01-15T10:30:00.000
    0123456789012345678901234 ======================== AAAAAAAAAAAAAAAAAAAAAAAAAA 192.168.100.200/24-gateway""".split()
    assert [n for n in names if found(f"see {n} ok")] == []


def test_scan_takes_linear_time(spark):
    model = secrets.train(docs_of(spark, ["plain words " * 500]))
    rng = random.Random(2)
    some = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    part = " ".join(f"token={''.join(rng.choice(some) for _ in range(24))} and {''.join(rng.choice(some) for _ in range(30))}" for _ in range(1000))
    times = []
    for n in (1, 8):
        began = time.process_time()
        assert len(secrets.all_spans(" ".join([part] * n), model)) >= 1500 * n
        times.append(time.process_time() - began)
    assert times[1] < 16 * times[0] + 0.1


def test_pipeline(spark, sf_dir):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "secret_scan", "pack"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= before
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) < set(start) and not any(secrets.base_spans(t) for t in left.values())
    packed = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(packed.doc_id) == set(left)
    encoder, _ = bpe.kept(queries.tokenizer())
    assert packed.length.sum() == sum(len(encoder.encode(t)) + 1 for t in left.values())


def kept_rows(frame):
    return sorted((r.doc_id, r.text) for r in frame.collect())


def test_texts_that_share_a_doc_id_are_documents_each(spark):
    """No unrelated text is lost, every copy is cut, and other partitions give the same rows."""
    rng = random.Random(21)
    p, other, third, *more = (prose(rng, 200) for _ in range(8))
    rows = [(1, p), (2, p), (2, other), (3, third), (3, third), (4, more[0]), (4, more[1]), (4, more[2]), (5, other), (6, more[0].upper())]
    wanted = [(1, p), (2, other), (3, third), (4, more[0]), (4, more[1]), (4, more[2])]
    for parts in (1, 5):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(parts)
        for keep in (simhash.keep_one, simhash.keep_one_similar):
            assert kept_rows(keep(docs)) == sorted(wanted)
    ids = [1, 2, 2, 2]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, (p, other, *more), strict=False)], DOCS)
    assert len(kept_rows(simhash.keep_one_similar(docs))) == 4


def test_equal_rows_keep_the_same_one(spark):
    """Rows of one doc_id and text that differ elsewhere: the same stays whatever the partitions."""
    text = prose(random.Random(22), 100)
    rows = [(1, text, lang, "s", n) for n, lang in enumerate(["en", "fr", "de", None])]
    found = {simhash.keep_one_similar(spark.createDataFrame(rows, DOCS).repartition(n)).collect()[0] for n in (1, 2, 3)}
    assert len(found) == 1


def test_passages_of_texts_that_share_a_doc_id(spark):
    rng = random.Random(23)
    shared = prose(rng, 80)
    rows = [(1, f"{prose(rng, 60)} {shared} {prose(rng, 60)}"), (2, prose(rng, 150)), (2, f"{prose(rng, 70)} {shared}"), (2, f"{shared} {prose(rng, 90)}"), (7, f"{shared} {prose(rng, 40)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(3)
    found = passages.near_duplicate_passages(docs).collect()
    assert sorted({(r.doc_id, r.first_id) for r in found if r.end_word - r.start_word >= 80}) == [(2, 1), (7, 1)]
    assert sum(r.doc_id == 2 and r.first_id == 1 and r.end_word - r.start_word >= 80 for r in found) == 2
    cut = kept_rows(passages.cut_repeats(docs))
    assert len(cut) == 5 and sum(shared in t for _, t in cut) == 1 and [t for i, t in cut if i == 1] == [rows[0][1]]
    assert {i: len([t for j, t in cut if j == i]) for i in (1, 2, 7)} == {1: 1, 2: 3, 7: 1} and rows[1] in cut


@pytest.mark.parametrize("most", [4, 2])
def test_crowded_posting_lists_are_split(spark, monkeypatch, most):
    """Fingerprints that share three bytes, some of them five: components as by comparing all pairs."""
    rng = random.Random(24)
    base = 0xABCDEF << 40
    values = list({base | rng.getrandbits(24) << 8 | rng.getrandbits(5) for _ in range(2600)} | {base | rng.getrandbits(8) << 12 | rng.getrandbits(12) for _ in range(600)})
    values += [v ^ sum(1 << b for b in rng.sample(range(64), 3)) for v in values[:300]]
    values = list(dict.fromkeys(values))
    v, group = np.array(values, np.uint64), list(range(len(values)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= most) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            group[b] = a
    rows = [(i, 0, bytearray(x.to_bytes(8, "big"))) for i, x in enumerate(values)]
    prints = simhash.materialise(spark.createDataFrame(rows, "doc_id long, digest long, fp binary"))
    found = simhash._exact(prints, most).select("doc_id", "least.doc_id").toDF("a", "b").collect()
    assert {r.a: r.b for r in found} == {i: find(i) for i in range(len(values))}


def test_splitting_a_list_is_linear(spark):
    """Each splitting makes five rows of a member, and lists fall to a hundredth: 20,000 distinct members of one list."""
    rng = random.Random(25)
    values = {0xABCDEF << 40 | rng.getrandbits(40) for _ in range(20_000)}
    scheme = simhash.exact_scheme()
    members = spark.createDataFrame([(0xABCDEF, bytearray(x.to_bytes(8, "big"))) for x in values], "key long, fp binary")
    split = members.mapInArrow(simhash._split_by(scheme), "key binary, fp binary")
    sizes = [r["count"] for r in split.groupBy("key").count().collect()]
    assert sum(sizes) == 5 * len(values) and max(sizes) < len(values) / 100
    again = split.mapInArrow(simhash._split_by(scheme), "key binary, fp binary")
    assert again.count() == 25 * len(values)


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    """Null ids and texts, repeated rows and clashing columns pass every stage with their columns; no documents, no rows."""
    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels_of(spark, odd).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert found and {r.doc_id for r in found} <= {r.doc_id for r in odd.collect()}
    now = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, now, f"{tmp_path}/odd")
        assert kept.columns == odd.columns
        now = spark.createDataFrame(kept.collect(), odd.schema)
    assert {(r.doc_id, r.piece) for r in found if r.piece == 0} == {(r.doc_id, 0) for r in now.collect()}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_near_dedup_stage_against_brute_force(spark, sf_dir):
    """Every document that the stage drops is 0.8 alike to one of a smaller id, through others; exact copies all go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts.items() if (w := (t or "").lower().split())}
    alike = {d: [e for e in sets if e != d and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])] for d in sets}
    group: dict = {}
    for d in sorted(sets):
        front = [d] if d not in group else []
        while front:
            x = front.pop()
            if x not in group:
                group[x] = d
                front += alike[x]
    wanted = {d for d in texts if group.get(d, d) == d}
    assert wanted <= kept and len(kept - wanted) <= 0.1 * len(set(texts) - wanted)
    first = {}
    for d in sorted(texts):
        first.setdefault(texts[d], d)
    assert all(first[texts[d]] == d for d in kept)
