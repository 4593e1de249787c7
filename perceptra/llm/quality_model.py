"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perceptra.llm.common import small

#: Byte classes of the character statistics; bytes above 0x7F belong to letters.
_LOWER, _UPPER, _DIGIT, _SPACE, _MARK, _SYMBOL, _CONTROL = range(7)
_CLASS = np.full(256, _LOWER, np.uint8)
_CLASS[:128] = _CONTROL
for _chars, _kind in (
    (b"abcdefghijklmnopqrstuvwxyz", _LOWER),
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER),
    (b"0123456789", _DIGIT),
    (b" \t\n\r\x0b\x0c", _SPACE),
    (b".,;:!?'\"()-", _MARK),
    (b"#*$%&|<>@^_~`=+/\\[]{}", _SYMBOL),
):
    _CLASS[list(_chars)] = _kind

FEATURES = (
    "log_bytes", "word_length", "line_words", "lower", "upper", "digit", "space", "mark", "symbol", "control",
    "variety", "adjacent_repeats", "repeated_lines", "longest_word",
)


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one whole UTF-8 text, in the order of FEATURES.

    Shares are square-rooted and sizes logged, which brings them near to a
    normal shape. A null or empty text has zero everywhere.
    """
    text = text or b""
    words = text.split()
    if not words:
        return [float(np.log1p(len(text))), *[0.0] * (len(FEATURES) - 1)]
    share = np.sqrt(np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7) / len(text))
    n, lower = len(words), text.lower().split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, lower, lower[1:]))
    return [
        float(np.log1p(len(text))),
        float(np.log(sum(map(len, words)) / n)),
        float(np.log(n / len(lines))),
        *share[[_LOWER, _UPPER, _DIGIT, _SPACE, _MARK, _SYMBOL, _CONTROL]].tolist(),
        float(np.log1p(len(set(lower))) / np.log1p(n)),
        float(np.sqrt(same / n)),
        float(np.sqrt(1 - len(set(lines)) / len(lines))),
        float(np.log(max(map(len, words)))),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row."""

    def run(batches):
        for batch in small(batches):
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, "doc_id long, x array<double>"
    )


@dataclass(frozen=True)
class Discriminant:
    """Two normal densities; each covariance's Cholesky factor is computed once and kept."""

    prior: float
    means: np.ndarray
    inverse_factors: np.ndarray
    log_scales: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior probability of class 1 for the rows of ``x``."""
        if not len(self.means):
            return np.full(len(x), self.prior)
        z = [((x - m) @ f.T) for m, f in zip(self.means, self.inverse_factors, strict=True)]
        log = [-0.5 * (v * v).sum(axis=1) - s for v, s in zip(z, self.log_scales, strict=True)]
        margin = log[1] - log[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(x: DataFrame, labels: DataFrame, label: str = "quality", shrinkage: float = 0.1) -> Discriminant:
    """Fit on all rows of ``x`` (doc_id, x) that ``labels`` names with 0 or 1.

    Counts, sums and products are added up per batch on the executors; the
    driver gets 2 * (1 + d + d*d) sums, whatever the input. A class covariance
    is drawn towards the diagonal of the pooled one by ``shrinkage``. With
    fewer than two rows of either class the score is the smoothed share of
    class 1. Null labels and other values are left out; a repeated label
    counts as often as it comes.
    """
    d = len(FEATURES)

    def sums(batches):
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            v = np.array(batch.column(1).to_pylist(), float).reshape(-1, d)
            for k in (0, 1):
                if len(own := v[y == k]):
                    flat = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([flat.tolist()])], ["y", "s"])

    known = labels.where(F.col(label).isin(0, 1)).select(
        F.col("doc_id").cast("long"), F.col(label).cast("long").alias("y")
    )
    rows = (
        x.join(known, "doc_id")
        .select("y", "x")
        .mapInArrow(sums, "y long, s array<double>")
        .select("y", F.posexplode("s").alias("i", "s"))
        .groupBy("y", "i")
        .agg(F.sum("s").alias("s"))
        .collect()
    )
    total = np.zeros((2, 1 + d + d * d))
    for r in rows:
        total[r.y, r.i] = r.s
    n = total[:, 0]
    prior = float((n[1] + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Discriminant(prior, np.empty((0, d)), np.empty((0, d, d)), np.empty(0))
    means = total[:, 1 : 1 + d] / n[:, None]
    spread = total[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = np.diag(np.diag(spread.sum(axis=0)) / n.sum() + 1e-4)
    factors = [np.linalg.cholesky((1 - shrinkage) * s / c + shrinkage * pooled) for s, c in zip(spread, n, strict=True)]
    return Discriminant(
        prior,
        means,
        np.stack([np.linalg.inv(f) for f in factors]),
        np.array([np.log(np.diag(f)).sum() for f in factors]),
    )


def in_training(doc_id: Column, folds: int = 5) -> Column:
    """Rows that may teach: crc32 of the id's text is no multiple of ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds != 0


def score_column(model: Discriminant, text: Column) -> Column:
    """The score of every row's whole text, 0 to 1; computed beside the row, which stays in the JVM."""

    def run(texts: pd.Series) -> pd.Series:
        rows = [statistics(t) for t in texts]
        return pd.Series(model.score(np.array(rows, float).reshape(-1, len(FEATURES))), dtype="float64")

    return F.pandas_udf(run, "double")(text.cast("binary"))


def train(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1) -> Discriminant:
    """Fit on the labelled rows of ``docs`` outside the held-out fold."""
    labels = labels.where(in_training(F.col("doc_id")))
    return fit(with_statistics(docs.where(in_training(F.col("doc_id")))), labels, shrinkage=shrinkage)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, shrinkage: float = 0.1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    The score sees the text alone. A null or empty text is scored as the empty
    text; a null doc_id counts as held out; repeated rows get equal scores.
    Further columns of either table are not read. An empty ``docs`` gives no
    rows.
    """
    model = train(docs, labels, shrinkage)
    score = score_column(model, F.col("text"))
    held_out = F.coalesce(~in_training(F.col("doc_id")), F.lit(True))
    return docs.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns as they are, whatever their names.

    A null or empty text is scored as the empty text, so such rows stay or go
    together; a null doc_id teaches nothing and is judged like any other;
    repeated rows are judged alike; an empty ``docs`` gives no rows.
    """
    return docs.where(score_column(train(docs, labels), F.col("text")) >= threshold)
