"""Decontamination, ranked search and collocations against brute force, and on odd and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from perceptra.llm import collocations, decontamination, queries, ranking
from perceptra.llm.tries import Trie

from ..conftest import plain

DOCS = "doc_id long, text string, lang string"
#: Extra columns whose names an operator might use itself.
EXTRA = ("item_id", "items", "spans", "n_words", "digest", "part", "term", "hit_", "words", "n")


def text_rows(rng, n, words, most=60):
    """Texts over few words, with capitals, other letters and marks between."""
    marks = (" ", " ", "  ", ". ", "-", "\n", " ")
    return ["".join(rng.choice((f"w{rng.randrange(words)}", f"W{rng.randrange(words)}", "É", "3")) + rng.choice(marks) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, short, very long and repeated texts; null and repeated ids and languages; extra columns."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(300)}" for _ in range(30_000))
    texts = [None, "", " \n\t.,", "a", long, long, "one two three four five", "é 漢字 😀", "a " * 5000]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "lost id", None), (6, "one two three four five", "en"), (6, "other", None)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("z") for c in EXTRA})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


ITEMS = "item_id string, text string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def slow_contamination(docs, items, window=10):
    """(doc_id, n_words, hit words, item ids) by comparing every window with every window."""
    wanted = defaultdict(set)
    for name, text in items:
        own = terms(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own and name is not None else 0):
            wanted[tuple(own[i : i + size])].add(name)
    out = []
    for doc, text in docs:
        own, hit, names = terms(text), set(), set()
        for size in {len(w) for w in wanted}:
            for i in range(len(own) - size + 1):
                if (found := wanted.get(tuple(own[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    names |= found
        out.append((doc, len(own), tuple(sorted(hit)), tuple(sorted(names))))
    return sorted(out, key=str)


def found_contamination(frame):
    return sorted(
        ((r.doc_id, r.n_words, tuple(i for s in r.spans for i in range(s.start, s.end)), tuple(r["items"])) for r in frame.collect()), key=str
    )


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(3)
    items = text_rows(rng, 30, 3, 40) + ["one", "É", "", None, "w0 w1", "w0 w0 w0 w0 w0 w0 w0 w0 w0 w0 w0 w0"]
    names = [str(i) for i in range(len(items))]
    items, names = [*items, "w2 w2 w1", "no id at all"], [*names, "4", None]  # an id of two texts, and none
    docs = text_rows(rng, 60, 3, 120)
    docs += [f"{d} {rng.choice(items) or ''} {t}" for d, t in zip(docs, text_rows(rng, 60, 90), strict=True)] + [None, "", "w0 " * 300, docs[0]]
    left = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(list(zip(names, items, strict=True)), ITEMS)
    found = found_contamination(decontamination.occurrences(left, right, block_bytes=block_bytes))
    assert found == slow_contamination(list(enumerate(docs)), list(zip(names, items, strict=True)))
    assert sum(bool(r[2]) for r in found) > 60


def test_contamination_spans_end_with_texts_and_pieces_lose_nothing(spark):
    docs = [(0, "x a b c"), (1, "a b c y"), (2, "b c d e f g"), (3, None)]
    left = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    items = [("p", "a b c"), ("q", "c d e f")]
    found = decontamination.occurrences(left, spark.createDataFrame(items, ITEMS), window=3)
    assert found_contamination(found) == slow_contamination(docs, items, 3)
    long = " ".join(f"v{i}" for i in range(120_030))
    docs = [(0, " ".join(f"v{i}" for i in range(49_995, 50_008))), (1, " ".join(f"v{i}" for i in range(99_995, 100_004)))]
    found = decontamination.occurrences(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("long", long)], ITEMS))
    assert [(r[0], len(r[2])) for r in found_contamination(found)] == [(0, 13), (1, 0)]


def test_contamination_on_odd_and_empty_tables(spark, odd, none):
    items = spark.createDataFrame([("1", "one TWO three"), (None, "a"), ("2", None)], ITEMS).withColumn("doc_id", F.lit("z"))
    found = decontamination.contamination(odd, items)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = found.collect()
    assert len(rows) == 12 and sorted(r.doc_id for r in rows if r.contaminated) == [6, 6]
    assert {r.items_sha256 for r in rows} == {hashlib.sha256(x).hexdigest() for x in (b"", b"1")}
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(odd, none.select(F.col("lang").alias("item_id"), "text")).where("contaminated").count() == 0
    kept = decontamination.without_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == 10
    assert decontamination.without_contaminated(odd, items, share=0.7).count() == 12


def test_contamination_query(spark, sf_dir, duck):
    found = queries.QUERIES["op12_winnowing"](spark, sf_dir)
    docs, items = (duck.sql(f"SELECT {a}, text FROM {b}").fetchall() for a, b in (("doc_id", "documents"), ("item_id", "benchmark")))
    expected = slow_contamination(docs, items)
    assert plain([r.asDict() for r in found.collect()], ["doc_id", "n_words", "n_hit", "n_items", "contaminated"]) == plain(
        [dict(doc_id=d, n_words=n, n_hit=len(h), n_items=len(i), contaminated=bool(h)) for d, n, h, i in expected],
        ["doc_id", "n_words", "n_hit", "n_items", "contaminated"],
    )


def slow_search(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_words = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(set)
    for name, text in items:
        if name is not None:
            wanted[name] |= set(terms(text))
    out = []
    for name, own in wanted.items():
        scored = []
        for d, c in counts:
            m = 50 + 50 * c.total() * n_docs // n_words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c
            )
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(name, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found_search(frame):
    return sorted((r["item_id"], r["rank"], r.doc_id, r.score) for r in frame.collect())


@pytest.mark.parametrize("options", [{}, {"block_bytes": 400}, {"owners": 1}])
def test_search_equals_brute_force(spark, options):
    rng = random.Random(7)
    docs = list(enumerate(text_rows(rng, 300, 40, 80) + ["", None, "w1", "w1", "w39 " * 500]))
    docs += [(None, "w1 w2"), (3, "w5"), (3, "w5 w6")]  # no id, and an id of several texts
    items = [(f"i{n}", t) for n, t in enumerate(text_rows(rng, 25, 60, 12))] + [("i3", "w7 w8"), (None, "w1"), ("none", None), ("unknown", "zzz")]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = ranking.search(left, spark.createDataFrame(items, ITEMS), 7, range_rows=50, **options)
    assert found_search(found) == slow_search(docs, items, 7)


def test_search_prunes_and_bundles(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(rng.randrange(120)))) for i in range(500)]
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(20))) for i in range(10)]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = ranking.search(left, right, 5, bundle=3, range_rows=64)
    assert dict(found.dtypes)["item_id"] == "bigint"
    assert found_search(found) == slow_search(docs, items, 5)


def test_search_on_odd_and_empty_tables(spark, odd, none):
    items = spark.createDataFrame([("1", "one TWO three"), (None, "a"), ("2", None), ("3", "É é a")], ITEMS).withColumn("doc_id", F.lit("z"))
    found = ranking.search(odd, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    expected = slow_search([(r.doc_id, r.text) for r in odd.collect()], [(r["item_id"], r.text) for r in items.collect()], 50)
    assert found_search(found) == expected and {r[0] for r in expected} == {"1", "3"}
    assert ranking.search(none, items).count() == 0
    assert ranking.search(odd, spark.createDataFrame([], ITEMS)).count() == 0


def test_search_query(spark, sf_dir, duck):
    found = queries.QUERIES["op11_ranked_search"](spark, sf_dir)
    docs, items = (duck.sql(f"SELECT {a}, text FROM {b}").fetchall() for a, b in (("doc_id", "documents"), ("item_id", "benchmark")))
    assert found_search(found) == slow_search(docs, items, 50)


def test_trie_follows_every_phrase():
    rng = np.random.default_rng(1)
    for n, length, words in ((1, 2, 5), (400, 2, 30), (2000, 3, 60), (3000, 5, 9), (5000, 2, 70_000)):
        phrases = np.unique(np.minimum(rng.zipf(1.3, (n, length)), words), axis=0)
        trie, states = Trie.of(phrases)
        assert len(np.unique(states)) == len(phrases)
        codes = np.minimum(rng.zipf(1.3, 4000), 2 * words) * (rng.random(4000) > 0.1)
        codes = np.concatenate([codes, phrases[:200].ravel()]).astype(np.int32)
        known = {tuple(p): s for p, s in zip(phrases.tolist(), states.tolist(), strict=True)}
        at, state = trie.follow(codes, np.flatnonzero(codes > 0))
        places = [tuple(codes[i : i + length].tolist()) for i in range(len(codes) - length + 1)]
        assert list(zip(at.tolist(), state.tolist(), strict=True)) == [(i, known[p]) for i, p in enumerate(places) if p in known]


def slow_collocations(docs, least, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase of every length."""
    out = []
    by_lang = defaultdict(list)
    for text, lang in docs:
        by_lang["und" if lang is None else lang].append(text)
    for lang, texts in by_lang.items():
        f = Counter()
        for text in texts:
            for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
                own = re.findall(r"[^\x20\x09]+", piece)
                f.update(tuple(own[i : i + m]) for m in range(1, 6) for i in range(len(own) - m + 1))
        n = sum(c for w, c in f.items() if len(w) == 1)
        found = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        scored, longer = [], Counter()
        for v, b in found.items():
            for w in (v[i : i + m] for m in range(2, len(v)) for i in range(len(v) - m + 1)):
                longer[w] = max(longer[w], b)
        for w, a in found.items():
            if longer[w] < a:
                score, _, left, right = min((1000 * a * n // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, k, p.decode(), -a, le, ri, n, -s) for k, (s, a, p, le, ri) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def found_collocations(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


@pytest.mark.parametrize("options", [{}, {"buckets": 16, "trie_phrases": 7}, {"most_words": 0}])
def test_collocations_equal_brute_force(spark, options):
    rng = random.Random(11)
    texts = text_rows(rng, 120, 6, 60) + ["w1 w2 w3 w4 w5 w1 w2 w3 w4 w5 W1\tw2 w3 w4 w5"] * 9 + ["a\x01b \x01c \x01c é", "w0 " * 200, "a" * 3000, None, ""]
    docs = [(t, rng.choice(("en", "en", "fr", None, "und"))) for t in texts]
    frame = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    found = found_collocations(collocations.collocations(frame, 8, 15, **options))
    assert found == slow_collocations(docs, 8, 15) and {r[0] for r in found} == {"en", "fr", "und"} and max(r[1] for r in found) == 15


def test_collocation_scores_are_exact(spark):
    """1000 * a * n beyond 64 bits."""
    frame = spark.createDataFrame([(3_000_000_000_001, 7_000_000_000_003, 2_999_999_999_999, 11_000_000_007)], "a long, n long, l long, r long")
    text = "(1000 * cast(a as decimal(18,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    assert frame.selectExpr(text).first()[0] == 1000 * 3_000_000_000_001 * 7_000_000_000_003 // (2_999_999_999_999 * 11_000_000_007)


def test_collocations_on_odd_and_empty_tables(spark, odd, none):
    found = collocations.collocations(odd, 2)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found_collocations(found) == slow_collocations([(r.text, r.lang) for r in odd.collect()], 2, 2000)
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(odd, 10_000).count() == 0


def test_collocation_query(spark, sf_dir, duck):
    found = queries.QUERIES["op13_collocations"](spark, sf_dir)
    assert found_collocations(found) == slow_collocations(duck.sql("SELECT text, lang FROM documents").fetchall(), 100, 2000)
