"""Quality rules with distribution divergence.

Fixed rules (few words, many repeated word windows) come first. Then each
document's character-class histogram and common-word histogram are held
against those of its language by the Jensen-Shannon distance (base 2, 0 to 1),
where the document is long enough for a histogram to mean something.

The language references are counted over the whole corpus. Common words are
those that make up ``share`` of their language's words: a first pass names the
candidates by counters of bounded number, a second counts them exactly.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perceptra.llm.common import by_size, discard, materialise, small

_CLASSES = 8
_CLASS = np.full(256, 6, np.uint8)
_CLASS[128:] = 7
for _chars, _kind in (
    (b"abcdefghijklmnopqrstuvwxyz", 0),
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1),
    (b"0123456789", 2),
    (b" \t\n\r\x0b\x0c", 3),
    (b".,;:!?'\"()-", 4),
    (b"#*$%&|<>@^_~`=+/\\[]{}", 5),
):
    _CLASS[list(_chars)] = _kind
_SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")


def repeated_window_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words that the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    codes = defaultdict(count().__next__)
    ids = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = (mixed ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    if all((ids[a + k] == ids[b + k]).all() for k in range(size)):
        starts = np.union1d(a, b)
    else:  # two different windows with one hash
        seen = Counter(tuple(ids[i : i + size].tolist()) for i in range(n))
        starts = np.array([i for i in range(n) if seen[tuple(ids[i : i + size].tolist())] > 1])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_rules(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one UTF-8 text."""
    text = text or b""
    words = text.split()
    if not words:
        return 0, 0, sum(map(text.count, _SYMBOLS)), 0, 0
    raw = np.frombuffer(text, np.uint8)
    points = int(((raw & 0xC0) != 0x80).sum()) - int((_CLASS[raw] == 3).sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        points,
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
    )


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


def _pruned(counts: Counter, most: int) -> Counter:
    """``counts`` less the count of the first word beyond the ``most`` largest; what is left above zero."""
    if len(counts) <= most:
        return counts
    cut = np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) - most - 1)[len(counts) - most - 1]
    return Counter({w: n - int(cut) for w, n in counts.items() if n > cut})


def _frequent(docs: DataFrame, share: float, least_words: int) -> list[tuple[str, bytes]]:
    """(lang, word) that may make up ``share`` of the words of a language with ``least_words`` words.

    Each task keeps ``2 / share`` counters for a language and takes the count
    of the next one off all of them when there are more. So a word's counters
    fall short of its true count by half of ``share`` of the language's words
    at most, in all tasks together, and no more than ``2 / share`` words of a
    language can reach the other half.
    """
    most = int(np.ceil(2 / share))

    def run(batches):
        kept: dict[str, Counter] = defaultdict(Counter)
        total: dict[str, int] = defaultdict(int)
        for batch in by_size(batches):
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[lang].update((text or b"").lower().split())
            for lang, words in seen.items():
                total[lang] += words.total()
                words.update(kept[lang])
                kept[lang] = _pruned(words, most)
        rows = [(lang, None, n) for lang, n in total.items()]
        rows += [(lang, w, n) for lang, words in kept.items() for w, n in words.items()]
        if rows:
            kinds = (pa.string(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "word", "n"])

    counts = materialise(docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = counts.where("word is null").where(F.col("n") >= least_words).select("lang", F.col("n").alias("total"))
    found = counts.where("word is not null").join(totals, "lang").where(F.col("n") >= F.col("total") * (share / 2))
    rows = found.select("lang", "word").collect()
    discard(counts)
    return [(r.lang, bytes(r.word)) for r in rows]


def references(docs: DataFrame, share: float, least_words: int) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """Language -> character classes, common words' places, their counts and the rest's.

    Languages of fewer than ``least_words`` words have none. What the driver
    sees and the executors get is at most ``2 / share`` words of a language
    that has as many.
    """
    candidates: dict[str, dict[bytes, int]] = defaultdict(dict)
    for lang, word in sorted(_frequent(docs, share, least_words)):
        candidates[lang][word] = len(candidates[lang])
    candidates = dict(candidates)

    def run(batches):
        for batch in by_size(batches):
            chars: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(_CLASSES, np.int64))
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    chars[lang] += np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=_CLASSES)
                    words[lang].update(text.lower().split())
            rows = [(k, -1 - i, int(n)) for k, v in chars.items() for i, n in enumerate(v)]
            for k, c in words.items():
                rows.append((k, -100, c.total()))
                rows += [(k, i, c[w]) for w, i in candidates.get(k, {}).items() if w in c]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["lang", "i", "n"])

    sums: dict[str, dict[int, int]] = defaultdict(dict)
    for r in docs.mapInArrow(run, "lang string, i long, n long").groupBy("lang", "i").agg(F.sum("n").alias("n")).collect():
        sums[r.lang][r.i] = r.n
    out = {}
    for lang, n in sums.items():
        total = n.get(-100, 0)
        if total < least_words:
            continue
        common = [w for w, i in candidates.get(lang, {}).items() if n.get(i, 0) >= share * total]
        counts = [n[candidates[lang][w]] for w in common]
        chars = np.array([n.get(-1 - i, 0) for i in range(_CLASSES)], float)
        out[lang] = chars, {w: i for i, w in enumerate(common)}, np.array([*counts, total - sum(counts)], float)
    return out


def quality_rules(
    docs: DataFrame,
    share: float = 0.002,
    char_limit: float = 0.25,
    word_limit: float = 0.34,
    least_chars: int = 200,
    least_words: int = 100,
    least_reference: int = 20_000,
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distances).

    base_failed: fewer than 10 words, or over a fifth of the words in repeated
    five-word windows. kept: not base_failed, and neither distance above its
    limit. char_distance is null for texts below ``least_chars`` bytes,
    word_distance below ``least_words`` words, and both where the language has
    no reference (fewer than ``least_reference`` words in the corpus): then
    that rule keeps the text. A null lang counts as a language of its own, as
    do names that differ in case or blanks; a null text counts as empty;
    repeated rows and rows with a null doc_id come out as often as they go in;
    further columns are not read; an empty table gives no rows.
    """
    typed = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.col("text").cast("binary"))
    known = references(typed, share, least_reference)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance"]

    def run(batches):
        for batch in small(batches):
            rows = []
            for doc, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base = base_rules(text)
                chars = words = None
                if (reference := known.get(lang)) is not None:
                    if len(text or b"") >= least_chars:
                        own = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=_CLASSES).astype(float)
                        chars = distance(own, reference[0])
                    if base[0] >= least_words:
                        own = np.zeros(len(reference[2]))
                        for w, n in Counter(text.lower().split()).items():
                            own[reference[1].get(w, -1)] += n
                        words = distance(own, reference[2])
                rows.append((doc, *base, chars, words))
            kinds = [pa.int64()] * 6 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds],
                names,
            )

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    apart = (F.coalesce("char_distance", F.lit(0.0)) > char_limit) | (F.coalesce("word_distance", F.lit(0.0)) > word_limit)
    return (
        docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("text").cast("binary"))
        .mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names[1:6]) + ", char_distance double, word_distance double")
        .select(*names[:6], failed.alias("base_failed"), (~failed & ~apart).alias("kept"), *names[6:])
    )
