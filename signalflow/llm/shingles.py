"""Words and word n-grams of whole texts as 64-bit hashes, computed for many texts at once with numpy.

A word is a run of bytes other than space and 09-0D; texts are UTF-8 bytes. An n-gram's hash depends on its words in
their order only, not on what separates them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Texts are handled in groups of about this many bytes, so that a task's memory does not depend on its input.
CHUNK_BYTES = 1_000_000

_SEED = 0x9E3779B97F4A7C15
_STEP = 0x5851F42D4C957F2D
_WORD_STEP = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_SEED))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64; they grow as needed and are kept for the process."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                up, down = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
                up[0] = down[0] = 1
                self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_STEP), _Powers(_WORD_STEP)


class Words(NamedTuple):
    """Word hashes of several texts, one after the other; text i has hashes[first[i]:first[i + 1]]. Word j is
    buffer[starts[j]:ends[j]]."""

    hashes: np.ndarray
    first: np.ndarray
    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) in groups of about limit bytes; a text is never split, null is empty."""
    at, group, size = 0, [], 0
    for i, t in enumerate(texts):
        group.append(t or b"")
        size += len(group[-1])
        if size >= limit:
            yield at, group
            at, group, size = i + 1, [], 0
    if group:
        yield at, group


def word_hashes(texts: list[bytes]) -> Words:
    """The hashes of all words of the texts."""
    split = [t.split() for t in texts]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in split], out=first[1:])
    if not first[-1]:
        return Words(np.zeros(0, np.uint64), first, np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
    buffer = np.frombuffer(b" ".join([b" ".join(w) for w in split if w]), np.uint8)
    gaps = np.flatnonzero(buffer == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(buffer)]))
    up, down = _byte_powers.get(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTES[buffer] * up[:-1], out=sums[1:])
        return Words(mix64((sums[ends] - sums[starts]) * down[starts]), first, buffer, starts, ends)


def ngram_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams, and where each text's begin: text i has hashes[first[i]:first[i + 1]], in text order.
    Texts with fewer than n words have none."""
    sizes = np.maximum(np.diff(words.first) - n + 1, 0)
    first = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=first[1:])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    at = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], sizes)
    up, down = _word_powers.get(len(words.hashes) + 1)
    sums = np.zeros(len(words.hashes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words.hashes * up[:-1], out=sums[1:])
        return mix64((sums[at + n] - sums[at]) * down[at] + np.uint64(n)), first


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's distinct n-gram hashes, sorted as signed integers; a text of 1 to n - 1 words has one for all of
    them together, a text without words none."""
    words = word_hashes(texts)
    grams, first = ngram_hashes(words, n)
    grams = grams.view(np.int64)
    out = []
    for i in range(len(texts)):
        if first[i + 1] > first[i]:
            g = np.sort(grams[first[i] : first[i + 1]])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif k := int(words.first[i + 1] - words.first[i]):
            with np.errstate(over="ignore"):
                h = words.hashes[words.first[i] : words.first[i + 1]] * _word_powers.get(k + 1)[0][:k]
                out.append(mix64(np.array([h.sum(dtype=np.uint64) + np.uint64(k)], np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out
