"""How encoders choose the scale of a field, and the formula Y = (R + X 2^E) 10^-D."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The most values of a field that are decoded.
MOST_VALUES = 100_000_000


class PackingError(ValueError):
    """Data or parameters that cannot be unpacked or packed."""


def check_count(n: int) -> None:
    if n > MOST_VALUES:
        raise PackingError(f"{n} values are more than {MOST_VALUES}")


@dataclass(frozen=True)
class Scale:
    reference: float = 0.0
    binary: int = 0
    decimal: int = 0
    bits: int = 0

    def values(self, x: np.ndarray) -> np.ndarray:
        return (self.reference + x * 2.0**self.binary) * 10.0**-self.decimal

    def integers(self, v: np.ndarray) -> np.ndarray:
        """Rounded half away from zero, within the bits."""
        q = np.ldexp(np.asarray(v, np.float64) - self.reference, -self.binary)
        whole = np.trunc(q)
        return np.clip(whole + np.where(np.abs(q - whole) >= 0.5, np.sign(q), 0), 0, 2.0**self.bits - 1).astype(np.int64)


def single_at_or_below(v: float) -> float:
    with np.errstate(over="ignore"):
        f = np.float32(v)
    return float(np.nextafter(f, np.float32(-np.inf)) if float(f) > v else f)


def choose(values: np.ndarray, bits: int, most_bits: int, missing_allowed: bool = False) -> Scale:
    """R not above the least value, and the least E by which the range fits; a constant field takes no bits."""
    if bits > most_bits:
        raise PackingError(f"{bits} bits per value; {most_bits} at most")
    v = np.asarray(values, np.float64)
    if np.isnan(v).any():
        if not missing_allowed:
            raise PackingError("a value is missing")
        v = v[~np.isnan(v)]
    if not len(v):
        return Scale()
    if (np.abs(v) > np.finfo(np.float32).max).any():
        raise PackingError("a value is out of range")
    low, high = float(v.min()), float(v.max())
    r = single_at_or_below(low)
    if low == high:
        return Scale(r)
    if bits == 0:
        raise PackingError("no bits for a field that varies")
    most, span = 2.0**bits - 1, high - r
    e = int(np.ceil(np.log2(span) - np.log2(most))) - 2
    while np.floor(np.ldexp(span, -e) + 0.5) > most:
        e += 1
    return Scale(r, e, 0, bits)
