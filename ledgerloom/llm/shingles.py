"""Words, word hashes and hashed shingles of many whole texts at a time, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are worked on at a time, but for a longer single text (or line, where lines are asked for).
PIECE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
#: A-Z are lower-cased and ASCII white space is a space.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\r\v\f" else b for b in range(256))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd number modulo 2^64, as many as the longest piece so far needs."""

    def __init__(self, base: int):
        self.base, self.held = base % (1 << 64), np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.held) < n:
            self.held = np.concatenate((self.held, self.held * np.uint64(pow(self.base, len(self.held), 1 << 64))))
        return self.held[:n]


_UP, _DOWN = Powers(_BASE), Powers(pow(_BASE, -1, 1 << 64))


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of raw begin and end, and their 64-bit hashes. Words are parted by spaces and line ends; any other byte is part of one."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = (data != 32) & (data != 10)
    turns = np.diff(inside)
    begin, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    # Sums of bytes times rising powers; the difference of two, brought down to power 0, is a word's own polynomial.
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP.upto(len(data)), out=total[1:])
    return begin, end, mixed((total[end] - total[begin]) * _DOWN.upto(len(data) + 1)[begin])


def pieces(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of about PIECE_BYTES; with the number of the first of each run. A null text is empty."""
    at, first, held = 0, 0, 0
    for at, text in enumerate(texts):
        size = len(text or "")
        if held and held + size > PIECE_BYTES:
            yield first, [t or "" for t in texts[first:at]]
            first, held = at, 0
        held += size
    if texts:
        yield first, [t or "" for t in texts[first:]]


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """For each text, its distinct shingles of `size` words as sorted 64-bit hashes; A-Z are lower-cased.

    With fewer words the whole sequence is the only shingle; without words there is none.
    """
    for _, run in pieces(texts):
        parts = [t.encode() for t in run]
        begin, _, h = words(b" ".join(parts).translate(LOWERED))
        ends = np.cumsum([len(p) + 1 for p in parts])
        last = np.searchsorted(begin, ends)
        first = np.append(0, last[:-1])
        whole = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
        for i in range(size):
            whole += h[i : i + len(whole)] * _ODD[i % 8] * np.uint64(2 * (i // 8) + 1)
        whole = mixed(whole + np.uint64(size))
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= size:
                yield np.unique(whole[a : b - size + 1])
            elif b > a:
                short = np.array([b - a], dtype=np.uint64)
                for i in range(b - a):
                    short += h[a + i : a + i + 1] * _ODD[i % 8] * np.uint64(2 * (i // 8) + 1)
                yield mixed(short)
            else:
                yield np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The shingles of one text."""
    return next(shingle_sets([text], size))
