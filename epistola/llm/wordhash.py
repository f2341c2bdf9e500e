"""Vectorised word hashing over batches of texts.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. In UTF-8
these are runs of the bytes 0-9, a-z and all bytes from 0x80, so the work is done on bytes: one
``bytes.translate`` per text, then numpy over many texts at once. A word's hash is a polynomial over
its bytes modulo 2**64, taken from prefix sums, and mixed; two words of one corpus collide with a
probability of about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_WORD_BYTES = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Maps A-Z to a-z and every byte that is part of no word to a space.
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (b in _WORD_BYTES or 0x41 <= b <= 0x5A) else 0x20 for b in range(256))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPAN = 1 << 18
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least n bytes."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _SPAN)
        _powers[:] = []
        for base in (_BASE, _BASE_INVERSE):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers.append(np.cumprod(out, dtype=np.uint64))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """The words of one text, lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class Words:
    """Word hashes of a run of texts; text i has hashes[offsets[i]:offsets[i + 1]]."""

    __slots__ = ("_at", "first", "hashes", "offsets")

    def __init__(self, first: int, hashes: np.ndarray, offsets: np.ndarray, at: tuple[np.ndarray, ...]):
        self.first, self.hashes, self.offsets, self._at = first, hashes, offsets, at

    def heads(self, n: int) -> np.ndarray:
        """Hashes of the words' first n bytes; a word of n bytes or fewer has its own hash."""
        starts, ends, prefix, inverse = self._at
        return mix((prefix[np.minimum(ends, starts + n)] - prefix[starts]) * inverse)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def hash_words(texts: Iterable[str | None], span: int = _SPAN, fold: bytes = FOLD) -> Iterator[Words]:
    """Word hashes in runs of about ``span`` bytes; a longer text is a run of its own. ``fold`` maps bytes that part words to a space."""
    run: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace").translate(fold)
        if run and size + len(raw) > span:
            yield _hash_run(first, run)
            run, size, first = [], 0, i
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield _hash_run(first, run)


def _hash_run(first: int, run: list[bytes]) -> Words:
    raw = np.frombuffer(b" " + b" ".join(run) + b" ", np.uint8)
    ends_of_texts = np.cumsum(np.array([len(x) + 1 for x in run], np.int64))
    inside = raw != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _tables(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * power[: len(raw)], out=prefix[1:])
    inverse = inverse[starts]
    hashes = mix((prefix[ends] - prefix[starts]) * inverse)
    offsets = np.zeros(len(run) + 1, np.int64)
    offsets[1:] = np.searchsorted(starts, ends_of_texts, "left")
    return Words(first, hashes, offsets, (starts, ends, prefix, inverse))


def shingles(run: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, and their offsets by text.

    A text of fewer than n words, but not none, has one shingle: all its words.
    """
    h, counts = run.hashes, run.counts()
    per_text = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    offsets = np.zeros(len(per_text) + 1, np.int64)
    np.cumsum(per_text, out=offsets[1:])
    if not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    starts = np.repeat(run.offsets[:-1] - offsets[:-1], per_text) + np.arange(offsets[-1])
    last = np.repeat(run.offsets[1:], per_text)
    out = np.zeros(len(starts), np.uint64)
    for k in range(n):
        at = starts + k
        here = at < last
        out = out * _BASE + np.where(here, h[np.where(here, at, 0)], np.uint64(k + 1))
    return mix(out), offsets
