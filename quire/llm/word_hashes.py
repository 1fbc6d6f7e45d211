"""Words and word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

CHUNK_BYTES = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> list[list[bytes]]:
    """Consecutive texts with about `limit` bytes together (a longer text is a chunk by itself)."""
    out, size = [[]], 0
    for t in texts:
        if out[-1] and size + len(t) > limit:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t) + 1
    return out if out[-1] else []


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text) for one chunk; A-Z are lower-cased, ASCII white space ends a word."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up = powers(BASE, len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    down = powers(BASE_INVERSE, len(raw))
    hashes = finish((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * STEP)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(ends, start, side="right")


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingles of `width` words of each text, ascending; with fewer words, their whole sequence as one; none without words."""
    out: list[np.ndarray] = []
    for chunk in chunks(texts):
        words, owner = word_hashes(chunk)
        counts = np.bincount(owner, minlength=len(chunk))
        ends = np.cumsum(counts)
        shingles = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            shingles = shingles * STEP + words[k : k + len(shingles)]
        shingles = finish(shingles)
        for n, stop in zip(counts.tolist(), ends.tolist(), strict=True):
            if n >= width:
                out.append(np.unique(shingles[stop - n : stop - width + 1]))
            elif n:
                whole = np.uint64(n)
                with np.errstate(over="ignore"):
                    for w in words[stop - n : stop]:
                        whole = whole * BASE + w
                out.append(finish(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
