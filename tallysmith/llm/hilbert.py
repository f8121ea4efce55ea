"""Hilbert order of many points at once, by array operations."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of every row of a grid with ``2**bits`` cells a side on the Hilbert curve through it.

    ``cells`` is an integer table (points, dimensions) with dimensions * bits <= 63.  Every curve visits each cell
    once, and cells that follow each other share a face.
    """
    axes = cells.T.astype(np.int64).copy()
    dims = len(axes)
    if dims * bits > 63:
        raise ValueError("keys of more than 63 bits")
    # Undo, from the coarsest level on, the reflection and the exchange of axes that the level before prescribes.
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1) << level, (np.int64(1) << level) - 1
        for i in range(dims):
            upper = (axes[i] & bit) != 0
            swap = np.where(upper, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(upper, low, swap)
            axes[i] ^= swap
    for i in range(1, dims):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] & (np.int64(1) << level), (np.int64(1) << level) - 1, 0)
    axes ^= turn
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | ((axis >> level) & 1)
    return key
