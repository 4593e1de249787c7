"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

A text is read in parts. What a part leaves open is held back: characters up to
the last white space, and within a word of any length the last characters, as
``sufficient_lookahead`` bounds how far to the left text that is still unread
can change the pieces already formed. The end of a word closes all its pieces,
further to the left no merge can reach. Everything else is stable and leaves at
once, so memory is constant in the length of texts and words. The words that
many texts close at a time are merged side by side as arrays.

Reads the JSON files of the public ``tokenizers`` format with a BPE model, the
normaliser NFC + white space + lower case, and a word pattern.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np
import regex

#: Bytes of the longest words that are merged side by side, in classes of padded width.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 48)
#: Characters of a text that are read at a time.
READ = 1 << 18
#: Characters without white space after which a stretch is handed on word by word.
LONG_STRETCH = 4096

#: White space for Python's split() that the tokenizer's own pattern treats as ordinary.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: An apostrophe that may begin a suffix of one or two letters.
_SUFFIX = regex.compile(r"(?:^|[\s\p{L}\p{N}]|\|>)'\S{0,2}$")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


def sufficient_lookahead(merges: Iterable[tuple[str, str]]) -> int | None:
    """Characters of lookahead after which no piece to the left can change.

    A difference between two texts with a common beginning moves left only
    when a merge takes a piece across its edge: merge (a, b) moves the edge by
    the length of a, with a b that begins at the edge. The next move needs a
    later merge whose right part begins with a, so the moves form a chain of
    merges with rising ranks, each one's left part on the left spine of the
    next one's right part. The longest such chain, by added lengths of left
    parts, is the bound. None when some part is formed by a later merge or a
    piece is formed by two merges: then the argument fails and a word must be
    read whole.
    """
    parts: dict[str, tuple[str, str]] = {}
    reach: dict[str, int] = {}
    formed: set[str] = set()
    best = 0
    merges = list(merges)
    made = {a + b for a, b in merges}
    for a, b in merges:
        if a + b in formed or (a in made and a not in formed) or (b in made and b not in formed):
            return None
        far, piece = 0, b
        while True:
            far = max(far, reach.get(piece, 0))
            if piece not in parts:
                break
            piece = parts[piece][0]
        far += len(a)
        reach[a] = max(reach.get(a, 0), far)
        best = max(best, far)
        parts[a + b] = (a, b)
        formed.add(a + b)
    return best


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stretches ``at`` of ``flat``, one after the other."""
    sizes = sizes[at]
    ends = np.cumsum(sizes)
    shift = np.repeat(starts[at] - (ends - sizes), sizes)
    return flat[shift + np.arange(len(shift))]


class MergeTable:
    """Ranks and results of pairs of ids, looked up for many pairs at once."""

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]], end: str):
        pairs = np.array([(ids[a] << 32) | ids[b] for a, b in merges], np.uint64)
        self.none = len(pairs)
        self.result = np.array([ids[a + b] for a, b in merges] + [0], np.int32)
        self.pairs = np.append(pairs, np.uint64((1 << 64) - 1))
        self._bits = max(16, (8 * len(pairs)).bit_length())
        self._slot = np.full((1 << self._bits) + 64, self.none, np.int32)
        for i, at in enumerate(self._hash(pairs).tolist()):
            while self._slot[at] != self.none:
                at += 1
            self._slot[at] = i
        alphabet = byte_alphabet()
        self.inner = np.array([ids[c] for c in alphabet], np.int32)
        self.last = np.array([ids[c + end] for c in alphabet], np.int32)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._hash(keys)
        out = self._slot[at]
        open_ = np.flatnonzero((self.pairs[out] != keys) & (out != self.none))
        while len(open_):
            at[open_] += 1
            out[open_] = found = self._slot[at[open_]]
            open_ = open_[(self.pairs[found] != keys[open_]) & (found != self.none)]
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, counts) of the words of up to WIDTHS[-1] bytes at ``starts`` of ``data``."""
        begins, counts = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        out, total, least = [], 0, 0
        for width in WIDTHS:
            own = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            for at in range(0, len(own), 1 << 13):
                some = own[at : at + (1 << 13)]
                ids, n = self._side_by_side(data, starts[some], sizes[some], width)
                begins[some], counts[some] = total + np.cumsum(n) - n, n
                out.append(ids)
                total += len(ids)
        return np.concatenate(out) if out else np.empty(0, np.int32), begins, counts

    def _side_by_side(self, data, starts, sizes, width: int) -> tuple[np.ndarray, np.ndarray]:
        """In each round every word merges its pair of lowest rank, the leftmost of equals.

        Symbols stay in their places; a merge takes one out of the chain of
        neighbours. The last column is the neighbour of both ends.
        """
        n, none, edge = len(starts), self.none, np.int32(-1)
        line = np.arange(n)
        place = np.arange(width + 1)
        inside = place < sizes[:, None]
        symbol = self.inner[data[np.minimum(starts[:, None] + place, len(data) - 1)]]
        symbol[line, sizes - 1] = self.last[data[starts + sizes - 1]]
        symbol[~inside] = edge
        after = np.broadcast_to(np.minimum(place + 1, width), (n, width + 1)).astype(np.int64)
        after[line, sizes - 1] = width
        before = np.broadcast_to(np.where(place > 0, place - 1, width), (n, width + 1)).astype(np.int64)
        rank = np.full((n, width + 1), none, np.int32)
        row, col = np.nonzero(inside[:, 1:])
        rank[row, col] = self.ranks(symbol[row, col], symbol[row, col + 1])
        alive = inside
        now = line
        while len(now):
            here = rank if len(now) == n else rank[now]
            i = here.argmin(axis=1)
            low = here[np.arange(len(now)), i]
            going = low < none
            if not going.all():
                now, i, low = now[going], i[going], low[going]
                if not len(now):
                    break
            j = after[now, i]
            k, p = after[now, j], before[now, i]
            symbol[now, i] = made = self.result[low]
            alive[now, j] = False
            rank[now, j] = none
            after[now, i], before[now, k] = k, i
            right, left = symbol[now, k], symbol[now, p]
            found = self.ranks(np.concatenate([made, left & 0x7FFFFFFF]), np.concatenate([right & 0x7FFFFFFF, made]))
            rank[now, i], rank[now, p] = found[: len(now)], found[len(now) :]
            rank[now, width] = none
        return symbol[alive], alive.sum(axis=1)


class Open:
    """What is held back of one text: characters, and the window of an open word."""

    def __init__(self):
        self.raw = ""
        self.window: list[str] | None = None
        self.letters = False


class Encoder:
    """Encodes texts as streams with constant memory, many of them at a time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.end = model.get("end_of_word_suffix") or ""
        self.lookahead = sufficient_lookahead(merges)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._letters, self._others = regex.compile(r"\p{L}*"), regex.compile(r"[^\s\p{L}\p{N}]*")
        self._bytes = byte_alphabet()
        self.pieces = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self._table = MergeTable(self.ids, merges, self.end)

    def _merge(self, symbols: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        rank, n = self.rank.get, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (r, i, len(a), len(b))
            for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
            if (r := rank((a, b))) is not None
        ]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or len(symbols[i]) != a or len(symbols[j]) != b:
                continue  # one of the two has been merged meanwhile
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, len(symbols[i]), len(symbols[k])))
            if (p := before[i]) >= 0 and (r := rank((symbols[p], symbols[i]))) is not None:
                heapq.heappush(heap, (r, p, len(symbols[p]), len(symbols[i])))
        return [s for s in symbols if s]

    def _stable(self, window: list[str], closed: bool) -> list[str]:
        """Take from the window of a word what unread text cannot change; all of it if ``closed``."""
        if closed:
            window[-1] += self.end
            out = self._merge(window)
            window.clear()
            return out
        out, used, stable = [], 0, len(window) - 1 - (self.lookahead or 0)
        for piece in self._merge(window[:-1]):  # the last character may yet carry the end mark
            if used + len(piece) > stable:
                break
            out.append(piece)
            used += len(piece)
        del window[:used]
        return out

    def word_pieces(self, characters: Iterable[str]) -> Iterator[str]:
        """Pieces of one word, each as soon as it is stable.

        ``characters`` are byte characters; the last one carries the end mark.
        The window holds twice the lookahead and a little more; without a
        bound on the lookahead it holds the word.
        """
        window: list[str] = []
        for c in characters:
            window.append(c)
            if self.lookahead is not None and len(window) > 2 * self.lookahead + 64:
                yield from self._stable(window, False)
        if window:
            yield from self._stable(window, True)

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _stretches(self, text: str) -> list[str | tuple[int, ...]]:
        """Stretches of closed text without white space, normalised; special tokens as their ids."""
        if self._special is not None and "<|" in text:
            out = []
            for part in self._special.split(text):
                out += [(self.special[part],)] if part in self.special else self._split(part)
            return out
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        text = self._normal(text)
        return [c for c in regex.split(r"\s+", text) if c] if _ODD_SPACE.search(text) else text.split()

    def _take(self, state: Open, text: str, last: bool) -> list[str | tuple[int, ...]]:
        """The next part of a text: stretches and ids that are stable now."""
        if last and not state.raw and state.window is None:
            return self._stretches(text)
        out: list[str | tuple[int, ...]] = []
        text = state.raw + text
        if last:
            state.raw = ""
            return self._closed(state, text, out)
        at = max(map(text.rfind, " \n\t")) + 1
        head, state.raw = text[:at], text[at:]
        if head:
            self._closed(state, head, out)
        if len(state.raw) > LONG_STRETCH:
            cut = self._safe_cut(state.raw)
            self._open(state, state.raw[:cut], out)
            state.raw = state.raw[cut:]
        return out

    def _closed(self, state: Open, text: str, out: list) -> list:
        """Text after which no word is open."""
        if state.window is not None:
            text = self._normal_rest(state, text, out, True)
        out += self._stretches(text)
        return out

    def _safe_cut(self, raw: str) -> int:
        """A place near the end where the text can be cut.

        Normalisation does not reach across it, nor does a special token, nor
        a suffix after an apostrophe.
        """
        at = len(raw) - 32
        while at > 8:
            c, ahead = raw[at], raw[at - 8 : at]
            met = [p for t in self.special if (p := raw.find(t, max(0, at - len(t) + 1), at + len(t) - 1)) >= 0]
            if met:
                at = met[0]
                continue
            if not _SUFFIX.search(ahead) and (
                c.isascii()
                or not unicodedata.combining(c)
                and unicodedata.normalize("NFC", ahead + c) == unicodedata.normalize("NFC", ahead) + unicodedata.normalize("NFC", c)
            ):
                return at
            at -= 1
        return 0

    def _normal_rest(self, state: Open, text: str, out: list, closed: bool) -> str:
        """Feed the start of ``text`` that belongs to the open word to it; the rest of the text."""
        special = self._special.search(text) if self._special is not None and "<|" in text else None
        ahead, rest = (text[: special.start()], text[special.start() :]) if special else (text, "")
        ahead = self._normal(ahead)
        run = (self._letters if state.letters else self._others).match(ahead).end()
        state.window += map(self._bytes.__getitem__, ahead[:run].encode("utf-8"))
        if run < len(ahead) or rest or closed:
            out.append(tuple(map(self.ids.__getitem__, self._stable(state.window, True))))
            state.window = None
        else:
            self._press(state, out)
        return ahead[run:] + rest

    def _press(self, state: Open, out: list) -> None:
        if self.lookahead is not None and len(state.window) > 2 * self.lookahead + 64:
            out.append(tuple(map(self.ids.__getitem__, self._stable(state.window, False))))

    def _open(self, state: Open, text: str, out: list) -> None:
        """Part of a stretch without white space: all words leave but the last, which stays open."""
        if state.window is not None:
            text = self._normal_rest(state, text, out, False)
            if state.window is not None:
                return
        parts = self._special.split(text) if self._special is not None else [text]
        for part in parts[:-1]:
            out += [(self.special[part],)] if part in self.special else self._split(part)
        words = self._words.findall(self._normal(parts[-1]))
        if not words:
            return
        out += words[:-1]
        if not self._continues(words[-1]):
            out.append(words[-1])
            return
        state.letters = bool(self._letters.fullmatch(words[-1]))
        state.window = list(map(self._bytes.__getitem__, words[-1].encode("utf-8")))
        self._press(state, out)

    def _continues(self, word: str) -> bool:
        return bool(self._letters.fullmatch(word) or self._others.fullmatch(word))

    def feed(self, parts: list[tuple[Open, str | None, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids that become stable with the next part of each of several texts: all ids, and how many each text gives.

        ``parts`` are (state, text, last). What the texts have in common is encoded once.
        """
        rows = [self._take(state, text or "", last) for state, text, last in parts]
        codes: dict[str | tuple[int, ...], int] = defaultdict(count().__next__)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter(map(codes.__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
        flat, starts, counts = self._stretch_ids(list(codes))
        ends = np.concatenate([[0], np.cumsum(counts[at])])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return gather(flat, starts, counts, at), np.diff(ends[edges])

    def _stretch_ids(self, stretches: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, counts) of stretches."""
        code: dict[str | tuple[int, ...], int] = defaultdict(count().__next__)
        words, sizes = [], []
        for s in stretches:
            if type(s) is tuple or s.isalpha():  # letters alone are one word of the pattern
                words.append(code[s])
                sizes.append(1)
            elif s[-1] in ".,;:!?" and s[:-1].isalpha():
                words += (code[s[:-1]], code[s[-1]])
                sizes.append(2)
            else:
                found = self._words.findall(s)
                words += map(code.__getitem__, found)
                sizes.append(len(found))
        flat, starts, counts = self._word_ids(list(code))
        words, sizes = np.array(words, np.int64), np.array(sizes, np.int64)
        ends = np.concatenate([[0], np.cumsum(counts[words])])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return gather(flat, starts, counts, words), ends[edges[:-1]], np.diff(ends[edges])

    def _word_ids(self, words: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, counts) of words: short ones side by side, long ones as streams; ids stay as they are."""
        data = [w.encode("utf-8") if type(w) is str else b"" for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        joined = np.frombuffer(b"".join(data), np.uint8)
        begin = np.cumsum(sizes) - sizes
        short = np.where(sizes > WIDTHS[-1], 0, sizes)
        flat, starts, counts = self._table.encode(joined, begin, short)
        more, total = [flat], len(flat)
        for i in np.flatnonzero(short == 0).tolist():
            if type(words[i]) is tuple:
                ids = words[i]
            else:
                ids = tuple(map(self.ids.__getitem__, self.word_pieces(map(self._bytes.__getitem__, data[i]))))
            starts[i], counts[i] = total, len(ids)
            more.append(np.array(ids, np.int32))
            total += len(ids)
        return np.concatenate(more).astype(np.int32), starts, counts

    def encode(self, text: str | None, read: int = READ) -> list[int]:
        """Ids of one whole text, read ``read`` characters at a time."""
        return list(chain.from_iterable(ids.tolist() for _, ids, _ in self.streams([text], read=read)))

    def streams(self, texts: list[str | None], read: int = READ, most: int = 1_000_000) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(index of the text, its next ids, whether they are its last ones); null counts as empty.

        Texts come in order; parts of about ``most`` characters in all are encoded together.
        """
        batch: list[tuple[int, Open, str, bool]] = []
        size = 0

        def run():
            ids, counts = self.feed([part[1:] for part in batch])
            ends = np.cumsum(counts)
            for (i, _, _, last), n, end in zip(batch, counts.tolist(), ends.tolist(), strict=True):
                yield i, ids[end - n : end], last

        for i, text in enumerate(texts):
            text, state = text or "", Open()
            for at in range(0, max(1, len(text)), read):
                last = at + read >= len(text)
                batch.append((i, state, text[at : at + read], last))
                size += min(read, len(text) - at)
                if size >= most:
                    yield from run()
                    batch, size = [], 0
        if batch:
            yield from run()


class Decoding:
    """Incremental decoder of one sequence of ids: a byte-to-text state machine.

    The state is what is left of an unfinished UTF-8 sequence (three bytes at
    most) and whether a blank is due. As the file decodes when it names no
    decoder, pieces are text and stand with a blank between; ``readable``
    turns byte characters back into bytes and sets a blank after each word.
    """

    def __init__(self, decoder: Decoder, readable: bool = False):
        self._decoder, self._readable, self._due = decoder, readable, False
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        """Text that the next ids complete."""
        if not self._readable:
            data = b" ".join(map(self._decoder.encoded.__getitem__, ids))
            if self._due and data:
                data = b" " + data
            self._due = self._due or bool(data)
            return self._state.decode(data, last)
        out = []
        for i in ids:
            data, closes = self._decoder.plain[i]
            out.append(self._state.decode(data, closes))
            if closes:
                out.append(" ")
        if last:
            out.append(self._state.decode(b"", True))
        return "".join(out)


class Decoder:
    """The pieces of a vocabulary as bytes, for ``Decoding``."""

    def __init__(self, encoder: Encoder):
        pieces = [encoder.pieces.get(i, "") for i in range(max(encoder.pieces) + 1)]
        self.pieces = pieces
        self.encoded = [p.encode("utf-8") for p in pieces]
        byte, end = {c: b for b, c in enumerate(encoder._bytes)}, encoder.end
        self.plain = []
        for p in pieces:
            closes = bool(end) and p.endswith(end)
            p = p[: -len(end)] if closes else p
            self.plain.append((bytes(byte[c] for c in p if c in byte), closes))


_KEPT: dict[str, tuple[Encoder, Decoder]] = {}


def kept(path: str) -> tuple[Encoder, Decoder]:
    """The encoder and decoder of ``path``, loaded once in each Python worker."""
    if path not in _KEPT:
        encoder = Encoder(path)
        _KEPT[path] = encoder, Decoder(encoder)
    return _KEPT[path]
