"""Runs of integers of any width, most significant bit first."""

from __future__ import annotations

import numpy as np


def take(data: bytes, n: int, width: int, start: int = 0) -> np.ndarray:
    """n unsigned integers of ``width`` bits (0 to 63) from bit ``start`` on; bits beyond the end are 0."""
    if n <= 0 or width == 0:
        return np.zeros(max(n, 0), np.int64)
    raw = np.frombuffer(data, np.uint8)
    if start % 8 == 0 and width in (8, 16, 32):
        lo = start // 8
        part = raw[lo : lo + n * width // 8]
        if len(part) == n * width // 8:
            return part.view(f">u{width // 8}").astype(np.int64)
    lo, hi = start // 8, -(-(start + n * width) // 8)
    part = np.zeros(hi - lo, np.uint8)
    part[: max(0, min(len(raw), hi) - lo)] = raw[lo:hi]
    bits = np.unpackbits(part)[start - 8 * lo : start - 8 * lo + n * width].reshape(n, width)
    out = np.zeros(n, np.int64)
    for k in range(width):
        out = (out << 1) | bits[:, k]
    return out


def put(values: np.ndarray, width: int) -> np.ndarray:
    """The bits of each value, as one array of 0 and 1."""
    v = np.asarray(values, np.int64)[:, None]
    return ((v >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8).ravel()


def packed(*runs: np.ndarray) -> bytes:
    """Runs of bits one after another, filled up with zeros to a whole octet."""
    return np.packbits(np.concatenate(runs) if runs else np.zeros(0, np.uint8)).tobytes()
