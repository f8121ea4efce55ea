"""Hashed words of many texts at once, by array operations over their bytes."""

from __future__ import annotations

from functools import cache

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
PIECE = 1 << 20
U64 = np.uint64


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = pow(MULTIPLIER, -1, 1 << 64)
    out = []
    for base in (MULTIPLIER, inverse):
        steps = np.full(n, base, dtype=U64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=U64))
    return out[0], out[1]


def scramble(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes; equal spans have equal hashes wherever they stand.

    Works on pieces of about a megabyte, cut between spans, so memory follows the piece and the longest span.
    """
    out = np.empty(len(starts), dtype=U64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(int(np.searchsorted(ends, low + PIECE, side="right")), at + 1)
        high = ends[to - 1]
        power, inverse = _powers(max(int(high - low - 1).bit_length(), 20))
        sums = np.cumsum((data[low:high].astype(U64) + U64(1)) * power[: high - low], dtype=U64)
        s, e = starts[at:to] - low, ends[at:to] - low
        before = np.where(s > 0, sums[np.maximum(s, 1) - 1], U64(0))
        out[at:to] = (sums[e - 1] - before) * inverse[s]
        at = to
    return scramble(out)


def joined(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, a line end after each, and where each text begins; NULL counts as empty."""
    raw = [(t or "").encode("utf-8") for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    return data, np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(raw) else np.zeros(0, dtype=np.int64)


def batches(texts, most: int = 1 << 21):
    """Index ranges of the texts with about ``most`` characters each."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def chained(hashes: np.ndarray, doc: np.ndarray, gap: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every pair of items that are ``gap`` apart in one document."""
    same = doc[gap:] == doc[:-gap] if gap < len(doc) else np.zeros(0, dtype=bool)
    left, right = hashes[: len(same)][same], hashes[gap:][same]
    return scramble(left * U64(MULTIPLIER) + right + U64(salt)), doc[: len(same)][same]
