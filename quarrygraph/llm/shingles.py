"""Sets of word shingles as sorted 64-bit hashes, for whole blocks of texts at once."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = getattr(_powers, "held", None)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        held = _powers.held = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return held[0][:n], held[1][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, the number of the first word of each text and of the end, begin and end of each word in bytes).

    Words are the runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return, with
    A-Z lower-cased. Begins and ends count from the text's first byte, in UTF-8."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in data], out=begins[1:])
    flat = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    white = (flat == 32) | (flat - np.uint8(9) < 5)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, begins)
    of = np.repeat(begins[:-1], np.diff(first))
    return h, first, start - of, end - of


def shingle_sets(texts: list[str], k: int = 3) -> list[np.ndarray]:
    """The distinct k-word shingles of each text, as sorted hashes; of fewer than k words, the whole sequence as one."""
    h, first, *_ = word_hashes(texts)
    runs = h.copy()
    for j in range(1, k):
        m = max(0, len(runs) - j)
        runs[:m] = mix(runs[:m] * _ODD + h[j:], j)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            short = h[a]
            for j in range(1, b - a):
                short = mix(np.array([short]) * _ODD + h[a + j], j)[0]
            out.append(mix(np.array([short], np.uint64), 99 + int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([mix(shingles, 11).sum(dtype=np.uint64), mix(shingles, 13).sum(dtype=np.uint64)], "<u8").tobytes()
