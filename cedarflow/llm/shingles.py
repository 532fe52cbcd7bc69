"""Hashes of words and of word shingles, a block of texts at a time in numpy.

Words are what white space (blank and U+0009 to U+000D) parts, with A-Z
lower-cased.  A word's 64-bit hash is a difference of prefix sums of its
UTF-8 bytes' random values times powers of an odd number, mixed; a shingle's
is a mix of its words' hashes in their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U) | U(1)
#: By position in a shingle; no small sums of them may be equal.
PLACES = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=U) * U(2) + U(1)
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BLOCK = 1 << 19


@lru_cache(maxsize=2)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base), U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of lower-cased UTF-8."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    size = BLOCK + 1
    while size < n + 1:
        size *= 2
    sums = np.zeros(n + 1, U)
    np.cumsum(BYTES[raw] * powers(ODD, size)[:n], out=sums[1:], dtype=U)
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, size)[starts] + (ends - starts).astype(U)), starts


def shingle_hashes(texts: list[str | None], size: int = 5) -> Iterator[np.ndarray]:
    """Each text's shingle hashes, in order, repeated ones too.

    A text of fewer words than ``size`` has its whole sequence as one; one
    without words has none.
    """
    i = 0
    while i < len(texts):
        block, at, total = [], [0], 0
        while i < len(texts) and (not block or total < BLOCK):
            block.append((texts[i] or "").encode("utf-8", "replace").lower())
            total += len(block[-1]) + 1
            at.append(total)
            i += 1
        words, starts = word_hashes(b" ".join(block))
        n = len(words)
        edges = np.searchsorted(starts, at)
        m = max(0, n - size + 1)
        rolled = np.zeros(m, U)
        for j in range(size):
            rolled += words[j : m + j] * PLACES[j]
        rolled = mix(rolled)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= size:
                yield rolled[a : b - size + 1]
            elif b > a:
                h = b - a
                for w in words[a:b].tolist():
                    h = (h * ODD + w) % (1 << 64)
                yield mix(np.array([h], U))
            else:
                yield np.empty(0, U)
