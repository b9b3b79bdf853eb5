"""Five-word shingles of whole texts as 64-bit hashes, many texts at once.

Words are runs of bytes other than space and 0x09..0x0D, A-Z lower-cased. A
word's hash is a polynomial in random byte codes, taken from prefix sums over the
whole buffer; a shingle's hash mixes its words' hashes by place.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
CHUNK_BYTES = 1 << 18
KEPT_POWERS = 1 << 20  # of each table, between texts
_RNG = np.random.default_rng(20240101)
_BYTE_CODE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_PLACE = _RNG.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_powers_of: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if len(_powers_of.get("up", ())) < n:
        up, down = (_powers(base, 1 << max(19, (n - 1).bit_length())) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
        if n > KEPT_POWERS:  # a very long text: its tables go with it
            return up, down
        _powers_of.update(up=up, down=down)
    return _powers_of["up"], _powers_of["down"]


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and each text's offset among them."""
    data = np.frombuffer(b"\n".join(x or b"" for x in texts) + b"\n", np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    begin, end = edge[0::2], edge[1::2]
    up, down = _tables(len(data))
    run = np.empty(len(data) + 1, np.uint64)
    run[0] = 0
    np.cumsum(_BYTE_CODE[_LOWER[data]] * up[: len(data)], out=run[1:])
    hashes = mix64((run[end] - run[begin]) * down[begin])
    bounds = np.cumsum([0, *[len(x or b"") + 1 for x in texts]])
    return hashes, np.searchsorted(begin, bounds)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted. Fewer than five words: the whole
    sequence as one. No words, or null: none."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or b"") <= CHUNK_BYTES):
            size += len(texts[to] or b"")
            to += 1
        words, offsets = word_hashes(texts[at:to])
        n = max(0, len(words) - WORDS + 1)
        joined = np.zeros(n, np.uint64)
        for k in range(WORDS):
            joined += words[k : k + n] * _PLACE[k]
        joined = mix64(joined)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= WORDS:
                own = np.sort(joined[a : b - WORDS + 1])
                keep = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                out.append(own[keep])
            elif b > a:
                with np.errstate(over="ignore"):
                    out.append(mix64((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        at = to
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
