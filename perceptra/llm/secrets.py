"""Secret scan: fixed patterns, and character Markov models of random strings and identifiers.

First-order models over the characters ``A-Za-z0-9+/_.=-`` are trained from
labelled samples that the corpus itself gives: the values that the fixed
patterns find (random strings), and all other text but for the runs in
question (ordinary identifiers). A second random model stands for strings of
capitals and digits alone (base 32 keys, seeds of one-time passwords), of which
a corpus need hold no sample. The stretches of a run whose log-likelihood ratio
under either passes the threshold become further spans.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perceptra.llm.common import small

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Order of the kinds in every list of spans.
KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
#: Where the model of capitals and digits looks: no shorter stretch could pass.
_CAPITALS = re.compile(r"[A-Z0-9_.=-]{12,}")

#: Labelled samples of ordinary identifiers: parts that paths, addresses and names in code are joined of.
ORDINARY = """
https www example com org net edu gov docs guide getting started index html home page about contact login search
apache commons lang java util string list map array buffer reader writer stream file path name value key type class
project service user repository impl controller manager factory builder handler provider config configuration settings
python lib local share bin etc var usr src main test resources target build dist static public assets images styles
node modules react dom development production package version release final report quarterly annual monthly summary
max min count size limit timeout connection seconds request response client server session context thread process
get set add remove update delete create find select insert element elements document window event listener callback
data base table column row record field query result message error exception warning debug info level status state
international electronic graphic photograph government department administration information understanding education
physical chemical biological mathematical philosophical psychological technology development environment management
"""
_UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")

_N = len(ALPHABET)
#: Log ratio, below zero, of what a string of capitals and digits does not hold.
_NEVER = 20.0
_INDEX = np.full(256, _N, np.int64)
_INDEX[list(ALPHABET)] = np.arange(_N)
_MARKS = _INDEX[list(b"_.=-")]
_UPPER, _LOWER, _DIGITS = np.arange(26), np.arange(26, 52), np.arange(52, 62)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind.

    ``[0-9a-f]+`` of 32 or more is the same as the greedy run of 32 or more,
    since a run is matched from its first character on.
    """
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _values(text: str, spans: list[tuple[int, int, str]]) -> list[bytes]:
    """The secret strings in the spans: of an assignment its value."""
    out = {}
    for start, end, kind in spans:
        if kind == "assign":
            start = _ASSIGN.match(text, start).start(2)
        out[end] = text[start:end]
    return [v.encode("ascii") for v in out.values()]


def outside(text: str, spans: list[tuple[int, int, str]], mark: str = "\n") -> str:
    """``text`` with ``mark`` in place of each stretch that spans cover."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if at else text


def _transitions(data: bytes) -> np.ndarray:
    at = _INDEX[np.frombuffer(data, np.uint8)]
    pairs = at[:-1] * (_N + 1) + at[1:]
    return np.bincount(pairs, minlength=(_N + 1) ** 2).reshape(_N + 1, _N + 1)[:_N, :_N]


@dataclass(frozen=True)
class RandomnessModel:
    """Log ratio of each transition: above zero, likelier in a random string.

    ``ratio`` is that of random strings as the corpus has them, ``capitals``
    that of even strings of capitals and digits; there no other character has
    a ratio above zero.
    """

    ratio: np.ndarray
    capitals: np.ndarray

    def score(self, run: str) -> float:
        """Mean log-likelihood ratio per transition of ``run``."""
        at = _INDEX[np.frombuffer(run.encode("ascii"), np.uint8)]
        return float(self.ratio[at[:-1], at[1:]].mean())


def _ordinary_transitions() -> np.ndarray:
    """Counts over the samples, joined as paths, addresses and names are, in every usual case."""
    parts = ORDINARY.split()
    texts = [mark.join(parts) for mark in "/._-"] + ["_".join(parts).upper(), "".join(w.capitalize() for w in parts), " ".join(parts)]
    texts += ["-".join(f"{y}-{m:02d}-{d:02d}" for y in range(1990, 2030) for m, d in ((1, 15), (11, 30), (7, 4)))]
    return sum(_transitions(t.encode()) for t in texts)


def train(docs: DataFrame, prior: float = 5.0) -> RandomnessModel:
    """Count transitions over every whole text and smooth them.

    Each task adds its counts up per batch, and Spark sums them by transition:
    the driver gets at most 2 * 68 * 68 sums. The random model is smoothed
    towards even transitions over letters and digits by ``prior`` for each,
    which is all it knows when the corpus holds no secret; the text model
    starts from the same prior. An identifier is as likely as the mean of the
    text model and that of the samples ``ORDINARY`` says. For strings of
    capitals the text model is told that words are spelt the same in capitals:
    what follows a small letter counts for its capital too. Without rows the
    prior and the samples are the models.
    """

    def counts(batches):
        for batch in small(batches):
            total = np.zeros((2, _N, _N), np.int64)
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                for value in _values(text, spans):
                    total[1] += _transitions(value)
                unsure = [(*m.span(), "run") for m in _RUN.finditer(text) if looks_mixed(m.group())]
                total[0] += _transitions(outside(text, spans + unsure).encode("utf-8", "replace"))
            flat = total.reshape(2, -1)
            kind, cell = np.nonzero(flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(cell), pa.array(flat[kind, cell])], ["kind", "cell", "n"]
            )

    rows = (
        docs.select("text")
        .mapInArrow(counts, "kind long, cell long, n long")
        .groupBy("kind", "cell")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    n = np.zeros((2, _N * _N))
    for r in rows:
        n[r.kind, r.cell] = r.n
    even = np.zeros(_N)
    even[:62] = 1
    even[62:] = 0.25
    n = n.reshape(2, _N, _N)
    known = _ordinary_transitions() + 0.2 * even[None, :]
    ordinary = lambda text: (_rows(text + prior * even[None, :]) + _rows(known)) / 2
    ratio = np.log(_rows(n[1] + prior * even[None, :])) - np.log(ordinary(n[0]))
    spelt = n[0].copy()
    spelt[np.ix_(_UPPER, _UPPER)] += n[0][np.ix_(_LOWER, _LOWER)]
    capitals = np.full((_N, _N), -_NEVER)
    own = np.ix_(*[np.concatenate([_UPPER, _DIGITS])] * 2)
    capitals[own] = -np.log(36) - np.log(ordinary(spelt))[own]
    return RandomnessModel(ratio, capitals)


def _rows(counts: np.ndarray) -> np.ndarray:
    """Shares of each row."""
    return counts / counts.sum(axis=1, keepdims=True)


def looks_mixed(run: str) -> bool:
    """A run of both kinds of characters: it may be random and teaches the identifier model nothing."""
    digits = sum(map(run.count, "0123456789"))
    letters = sum(c.isalpha() for c in run)
    return digits >= 3 and letters >= 3


def _best(ratio: list[float]) -> tuple[float, int, int]:
    """Sum, start and end (exclusive) of the stretch with the largest sum."""
    best, now, start = (0.0, 0, 0), 0.0, 0
    for i, r in enumerate(ratio):
        if now <= 0:
            now, start = 0.0, i
        now += r
        if now > best[0]:
            best = now, start, i + 1
    return best


def random_stretches(text: str, spans: list[tuple[int, int, str]], model: RandomnessModel, threshold: float) -> list[tuple[int, int]]:
    """Stretches of the alphabet outside ``spans`` that are likelier random, widened to the next mark.

    The largest sum of log-likelihood ratios in a run must reach ``threshold``
    for each of 19 transitions (20 characters), more for shorter stretches by
    the square of 20 over their length and for longer runs by the logarithm of
    theirs, as they offer more stretches. Transitions at the marks ``_.=-``
    that join words, and of a character to itself, never count for randomness,
    and identifiers of the form of a UUID are left out. What is left of a run is searched again.
    Then runs of capitals, digits and marks outside what was found are searched by the model of capitals.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = _INDEX[np.minimum(codes, 255)]
    at[codes > 255] = _N
    for a, b in chain(((a, b) for a, b, _ in spans), (m.span() for m in _UUID.finditer(text)) if "-" in text else ()):
        at[a:b] = _N
    least = threshold * 19
    found = _stretches(text, at, model.ratio, least)
    for a, b in found:
        at[a:b] = _N
    runs = [m.span() for m in _CAPITALS.finditer(text)]
    if runs:
        within = np.full_like(at, _N)
        for a, b in runs:
            within[a:b] = at[a:b]
        found += _stretches(text, within, model.capitals, least)
    return _joined(found)


def _joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _stretches(text: str, at: np.ndarray, ratios: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Stretches of ``text``, whose characters have the places ``at`` in the alphabet, that pass under one model."""
    inside = at < _N
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edges[::2], edges[1::2]
    ratio = np.zeros(len(at))
    pairs = inside[:-1] & inside[1:]
    ratio[:-1][pairs] = ratios[at[:-1][pairs], at[1:][pairs]]
    marks = np.isin(at, _MARKS)
    marks[:-1] |= marks[1:]
    marks[:-1] |= at[:-1] == at[1:]
    ratio[marks] = np.minimum(ratio[marks], 0)
    gain = np.concatenate([[0], np.cumsum(np.maximum(ratio, 0))])
    out = []
    for k in np.flatnonzero(gain[ends] - gain[starts] >= least - 1e-6).tolist():
        todo = [(int(starts[k]), int(ends[k]))]
        while todo:
            low, high = todo.pop()
            total, a, b = _best(ratio[low : max(low, high - 1)].tolist())
            if b <= a or total < least:
                continue
            a, b = low + a, low + b + 1
            if total >= least * max(1, 20 / (b - a)) ** 2 + np.log(max(1, (high - low - 1) / 19)):
                while a > low and text[a - 1].isalnum():
                    a -= 1
                while b < high and text[b].isalnum():
                    b += 1
                while b < high and text[b] == "=":
                    b += 1
                out.append((a, b))
            todo += [(low, a), (b, high)]
    return sorted(out)


def all_spans(text: str, model: RandomnessModel, threshold: float = 0.5) -> list[tuple[int, int, str]]:
    """The fixed patterns' spans and those that the model adds beside them."""
    spans = base_spans(text)
    more = [(a, b, "markov") for a, b in random_stretches(text, spans, model, threshold)] if text else []
    return sorted(spans + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind>>) for every row of ``docs``.

    Positions are code points, the end exclusive. A null or empty text has no
    spans; repeated rows are scanned as often as they come; other columns are
    not read; an empty table gives no rows.
    """
    model = train(docs)

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in small(batches):
            rows = [
                [{"start": a, "end": b, "kind": k} for a, b, k in all_spans(t or "", model, threshold)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, spans array<struct<start:bigint,end:bigint,kind:string>>"
    )


def span_digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the joined spans and the digest of the fixed patterns' spans."""
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return scanned.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def empty_digest() -> str:
    """The digest of a text without spans."""
    return hashlib.sha256(b"").hexdigest()


def redact(docs: DataFrame, mark: str = "[secret]", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and n_chars, if there, counted anew.

    Texts without spans, nulls included, stay as they are, and so do all rows,
    repeated ones and those with a null doc_id too. Columns keep their names
    and order, whatever they are; an empty table gives no rows.
    """
    model = train(docs)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        return outside(text, all_spans(text, model, threshold), mark)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([clean(t) for t in texts], dtype="object")

    out = docs.withColumn("text", F.pandas_udf(run, "string")("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(*docs.columns)
