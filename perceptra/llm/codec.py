"""Corpus-wide encoding and decoding by the streaming BPE transducer."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perceptra.llm import bpe
from perceptra.llm.common import by_size


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text.

    Null and empty texts have no ids; repeated rows and rows with a null
    doc_id come out as often as they go in; further columns are not read; an
    empty table gives no rows.
    """

    def run(batches):
        encoder, _ = bpe.kept(tokenizer)
        for batch in by_size(batches):
            texts = batch.column(1).to_pylist()
            counts, parts = np.zeros(len(texts), np.int64), []
            for i, ids, _ in encoder.streams(texts):
                counts[i] += len(ids)
                parts.append(ids)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, readable: bool = False) -> DataFrame:
    """(doc_id, text): the ids' text, by the incremental decoder.

    By default as the tokenizer's file decodes (pieces joined by blanks when
    it names no decoder); with ``readable`` the words themselves, from bytes.
    Null and empty ids give an empty text; repeated rows come out as often as
    they go in; further columns are not read; an empty table gives no rows.
    """

    def run(batches):
        _, decoder = bpe.kept(tokenizer)
        for batch in batches:
            texts = [bpe.Decoding(decoder, readable).feed(ids or [], True) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row.

    Each text runs through the encoder and the incremental decoder part by
    part, and both digests take in what a part completes, so that neither ids
    nor decoded texts are held or leave the task. Null and empty texts have no
    tokens and the digests of the empty string; repeated rows and rows with a
    null doc_id come out as often as they go in; further columns are not read;
    an empty table gives no rows.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        encoder, decoder = bpe.kept(tokenizer)
        numbers = [str(i).encode() for i in range(len(decoder.pieces))].__getitem__
        for batch in by_size(batches):
            rows, state, n = [], None, 0
            for _, ids, last in encoder.streams(batch.column(1).to_pylist()):
                if state is None:
                    state, n, numbered, decoded = bpe.Decoding(decoder), 0, hashlib.sha256(), hashlib.sha256()
                ids = ids.tolist()
                if n and ids:
                    numbered.update(b" ")
                n += len(ids)
                numbered.update(b" ".join(map(numbers, ids)))
                decoded.update(state.feed(ids, last).encode("utf-8"))
                if last:
                    rows.append((n, numbered.hexdigest(), decoded.hexdigest()))
                    state = None
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
