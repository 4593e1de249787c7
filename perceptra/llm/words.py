"""Words of letters, digits and all that is not ASCII, in lower case."""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TABLE = bytes(c if c in _KEPT else ord(" ") for c in bytes(range(256)).lower())


def words(text: bytes | None) -> list[bytes]:
    """The maximal runs of ASCII letters, ASCII digits and non-ASCII characters of a UTF-8 text, A-Z lower-cased; null has none."""
    return (text or b"").translate(_TABLE).split()


def known_words(texts: list[bytes | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number in ``vocabulary`` or -1, one text after the other, and where each text begins and the last ends."""
    found = [words(t) for t in texts]
    begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
    numbers = map(vocabulary.get, chain.from_iterable(found), repeat(-1))
    return np.fromiter(numbers, np.int32, int(begin[-1])), begin
