"""Registered queries against brute force in plain Python over every row of their tables."""

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from perceptra.llm import quality_model, queries


def texts(spark, folder):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return texts(spark, sf_dir)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fixed_patterns_of_every_document(spark):
    folder = "/root/testdata/sf0.01"  # the smallest table with any
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def base(text):
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        return sorted(spans + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])

    expected, held = Counter(), 0
    for doc_id, text in texts(spark, folder):
        spans = base(text)
        counts = [sum(s[2] == kind for s in spans) for kind in ("assign", "access", "hex")]
        expected[doc_id, *counts, sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))] += 1
        held += len(spans)
    rows = queries.op10_secret_scan(spark, folder).collect()
    assert held and Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == expected
    for r in rows:
        kept = [s for s in r.spans.split(",") if s and not s.startswith("markov")]
        assert sha(",".join(kept)) == r.base_sha256


def test_every_document_has_one_place_in_a_shard(spark, sf_dir, docs):
    rows = queries.op7_hypergeometric_shards(spark, sf_dir).collect()
    data = [(doc_id, text.encode()) for doc_id, text in docs]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len(b) + 16, zlib.crc32(b)) for i, b in data)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(40)}
    assert sum(map(len, slots.values())) == len(rows)
    assert all(own == list(range(len(own))) for own in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_round_trip_of_every_document_as_the_library_has_it(spark, sf_dir, docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    expected = Counter()
    for doc_id, text in docs:
        ids = library.encode(text, add_special_tokens=False).ids
        expected[doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    rows = queries.op8_bpe_round_trip(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == expected


def test_held_out_labels_and_other_columns_do_not_move_a_score(spark, sf_dir, docs):
    rows = queries.op6_quality_classifier(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    own = dict(docs)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(own[r.doc_id], r.score) == pytest.approx(r.score, abs=1e-9)
    table, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    plain = table.select("doc_id", "text").withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "quality": F.lit(1)})
    again = {r.doc_id: r.score for r in quality_model.classify(plain, turned).collect()}
    assert again == pytest.approx({r.doc_id: r.score for r in rows}, abs=1e-9)
