"""Best-fit packing of tokenised documents by several capacities at once.

Every piece has three sizes: its tokens, itself as one document, and its
attention cost (tokens squared). A sequence has a capacity for each, and a
piece goes to the open sequence that fits it best under all three: the one
whose weighted residual has the smallest norm once the piece is in, or the one
with the largest weighted dot product of piece and residual.

Pieces are dealt evenly into groups of bounded size, so every task packs a
bounded number of pieces and leaves at most a few sequences part empty.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perceptra.llm import bpe
from perceptra.llm.common import by_size, materialise


def best_fit(
    lengths: np.ndarray, capacities: tuple[int, int, int], weights: tuple[float, float, float], rule: str = "norm"
) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; pieces are placed by falling length, ties in order."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    cap = np.array(capacities, float)
    scale = np.sqrt(np.array(weights, float)) / cap
    left = np.zeros((3, 1024))
    names = np.zeros(1024, np.int64)
    open_bins = made = 0
    least = lengths.min() if len(lengths) else 0
    for i in order.tolist():
        size = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        at = -1
        if open_bins:
            rest = left[:, :open_bins] - size[:, None]
            fits = (rest >= 0).all(axis=0)
            if fits.any():
                scaled = rest * scale[:, None]
                if rule == "norm":
                    worth = (scaled * scaled).sum(axis=0)
                else:
                    worth = -((left[:, :open_bins] * scale[:, None]) * (size * scale)[:, None]).sum(axis=0)
                at = int(np.where(fits, worth, np.inf).argmin())
        if at < 0:
            if open_bins == left.shape[1]:
                left, names = np.pad(left, ((0, 0), (0, open_bins))), np.pad(names, (0, open_bins))
            at = open_bins
            left[:, at], names[at] = cap, made
            open_bins, made = open_bins + 1, made + 1
        sequence[i], offset[i] = names[at], capacities[0] - int(left[0, at])
        left[:, at] -= size
        if left[0, at] < least or left[1, at] < 1 or left[2, at] < float(least) ** 2:
            open_bins -= 1
            left[:, at], names[at] = left[:, open_bins], names[open_bins]
    return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut at ``tokens``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        encoder, _ = bpe.kept(tokenizer)
        for batch in by_size(batches, 2 << 20):
            rows, held, n = [], np.empty(0, np.int32), 0
            for i, ids, last in encoder.streams(batch.column(1).to_pylist()):
                held = np.concatenate([held, ids, [end_id]] if last else [held, ids]).astype("<u4")
                while len(held) >= tokens or (last and len(held)):
                    cut, held = held[:tokens], held[tokens:]
                    rows.append((i, n, n * tokens, len(cut), zlib.crc32(cut)))
                    n += 1
                if last:
                    n = 0
            at, *columns = zip(*rows, strict=True)
            columns = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    tokens: int = 2048,
    most_documents: int | None = None,
    most_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
    group_rows: int = 20_000,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Where ``most_documents`` and ``most_attention`` are not given they are what
    ``tokens`` allows at most (``tokens`` and its square): they then steer the
    choice and never open a further sequence. A limit on attention below the
    square of ``tokens`` also lowers the length at which documents are cut.

    Null and empty texts are the end id alone; repeated rows and rows with a
    null doc_id are packed like any other; further columns are not read; an
    empty table gives no rows. sequence_id is the group in the upper bits and
    a count in the lower 32.
    """
    longest = tokens if most_attention is None else min(tokens, int(most_attention**0.5))
    capacities = (tokens, most_documents or tokens, most_attention or tokens * tokens)
    cut = materialise(pieces(docs, tokenizer, longest))
    total = cut.count()
    groups = max(1, -(-total // group_rows))
    dealt = cut.withColumn("group_", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def run(key, table):
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        lengths = table.column("length").to_numpy()
        sequence, offset = best_fit(lengths, capacities, weights, rule)
        first = key[0].as_py() << 32
        return (
            table.drop_columns(["group_"])
            .append_column("sequence_id", pa.array(sequence + first))
            .append_column("offset", pa.array(offset))
        )

    return dealt.groupBy("group_").applyInArrow(
        run,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
