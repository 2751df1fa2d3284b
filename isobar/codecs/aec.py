"""Adaptive entropy coding of integers, after the public standard CCSDS 121.0-B.

Samples are mapped to distances from their predecessor and coded in blocks, each by the option that takes the fewest bits: runs of zero blocks, pairs by the second extension, split samples, or as they
are. A reference sample starts every ``rsi`` blocks. Bits are handled as strings of 0 and 1, in which the end of a unary code is found at once.
"""

from __future__ import annotations

import numpy as np

SIGNED, THREE_BYTES, MSB, PREPROCESS, RESTRICTED, PAD = 1, 2, 4, 8, 16, 32
#: Blocks of a segment; a run of zero blocks does not cross its end.
SEGMENT = 64
#: The unary code that says that all blocks up to the end of the segment are zero.
REST = 5


class AecError(ValueError):
    """A stream that is cut short or makes no sense."""


def id_bits(bits: int, flags: int) -> int:
    if flags & RESTRICTED and bits <= 4:
        return 1 if bits <= 2 else 2
    return 3 if bits <= 8 else 4 if bits <= 16 else 5


def limits(bits: int, flags: int) -> tuple[int, int]:
    return (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if flags & SIGNED else (0, (1 << bits) - 1)


class Bits:
    def __init__(self, data: bytes):
        self.s = "".join(map("{:08b}".format, data))
        self.at = 0

    def number(self, n: int) -> int:
        if n == 0:
            return 0
        part = self.s[self.at : self.at + n]
        if len(part) < n:
            raise AecError("the stream is cut short")
        self.at += n
        return int(part, 2)

    def unary(self) -> int:
        end = self.s.find("1", self.at)
        if end < 0:
            raise AecError("the stream is cut short")
        n, self.at = end - self.at, end + 1
        return n


def _pair(m: int) -> tuple[int, int]:
    """The pair that a code of the second extension stands for: m = (a + b)(a + b + 1) / 2 + b."""
    total = int((np.sqrt(8 * m + 1) - 1) // 2)
    b = m - total * (total + 1) // 2
    return total - b, b


def decode(data: bytes, n: int, bits: int, block: int, rsi: int, flags: int) -> np.ndarray:
    """n samples of ``bits`` bits."""
    if not 1 <= bits <= 32 or block < 2 or block % 2 or rsi < 1:
        raise AecError("the parameters make no sense")
    src, width = Bits(data), id_bits(bits, flags)
    raw, top = (1 << width) - 1, bits
    out = np.empty(n, np.int64)
    done = 0
    while done < n:
        coded: list[int] = []
        reference = None
        while len(coded) < block * rsi and done + len(coded) < n:
            b = len(coded) // block
            first = b == 0 and bool(flags & PREPROCESS)
            choice = src.number(width)
            if choice == raw:
                own = [src.number(top) for _ in range(block)]
                if first:
                    reference = own[0]
                coded += own
                continue
            second = choice == 0 and src.number(1)
            own = []
            if first:
                reference = src.number(top)
                own = [0]
            if choice == 0 and not second:
                run = src.unary() + 1
                if run == REST:
                    run = min(rsi - b, SEGMENT - b % SEGMENT)
                elif run > REST:
                    run -= 1
                if b + run > rsi:
                    raise AecError("a run of zero blocks is too long")
                coded += [0] * (block * run)
                continue
            if choice == 0:
                while len(own) < block:
                    x, y = _pair(src.unary())
                    own += [y] if len(own) % 2 else [x, y]
            else:
                k = choice - 1
                high = [src.unary() for _ in range(block - len(own))]
                own += [(h << k) | src.number(k) for h in high]
            coded += own
        coded = coded[: n - done]
        out[done : done + len(coded)] = _unmap(coded, reference, bits, flags)
        done += len(coded)
        if flags & PAD:
            src.at = -(-src.at // 8) * 8
    return out


def _unmap(coded: list[int], reference: int | None, bits: int, flags: int) -> list[int]:
    low, high = limits(bits, flags)
    signed = lambda v: v - (1 << bits) if flags & SIGNED and v >> (bits - 1) else v
    if reference is None:
        return [signed(v) for v in coded]
    x = signed(reference)
    out = [x]
    for d in coded[1:]:
        below, above = x - low, high - x
        near = min(below, above)
        if d <= 2 * near:
            x += d // 2 if d % 2 == 0 else -(d + 1) // 2
        else:
            x += d - near if below <= above else near - d
        if not low <= x <= high:
            raise AecError("a sample is out of range")
        out.append(x)
    return out


def _map(x: np.ndarray, bits: int, flags: int) -> np.ndarray:
    """Distances from the sample before: small ones alternate between up and down, larger ones go where there is room."""
    low, high = limits(bits, flags)
    before, d = x[:-1], np.diff(x)
    near = np.minimum(before - low, high - before)
    small = np.where(d >= 0, 2 * d, -2 * d - 1)
    return np.concatenate([[0], np.where(np.abs(d) <= near, small, near + np.abs(d))])


def encode(samples: np.ndarray, bits: int, block: int, rsi: int, flags: int) -> bytes:
    """The stream of some samples; the last block is filled up with its last sample."""
    x = np.asarray(samples, np.int64)
    width = id_bits(bits, flags)
    most_k = min(bits - 1, (1 << width) - 3)
    tag = lambda v, n: f"{v & ((1 << n) - 1):0{n}b}" if n else ""
    unary = lambda v: "0" * v + "1"
    out = []
    for at in range(0, len(x), block * rsi):
        own = x[at : at + block * rsi]
        own = np.concatenate([own, np.full(-len(own) % block, own[-1])])
        pre = bool(flags & PREPROCESS)
        coded = _map(own, bits, flags) if pre else own & ((1 << bits) - 1)
        head = tag(int(own[0]), bits) if pre else ""
        zeros, zero_from = 0, 0

        def flush(to: int) -> None:
            nonlocal zeros
            if zeros:
                ends = to % SEGMENT == 0 or to * block == len(coded)
                code = REST - 1 if zeros >= REST and ends else zeros - 1 if zeros < REST else zeros
                out.append("0" * (width + 1) + (head if zero_from == 0 else "") + unary(code))
                zeros = 0

        for b in range(len(coded) // block):
            skip = int(pre and b == 0)
            d = coded[b * block + skip : (b + 1) * block]
            if not d.any():
                if not zeros:
                    zero_from = b
                zeros += 1
                if (b + 1) % SEGMENT == 0:
                    flush(b + 1)
                continue
            flush(b)
            start = head if skip else ""
            cost = [int((d >> k).sum()) + len(d) * (k + 1) for k in range(most_k + 1)] or [1 << 60]
            k = int(np.argmin(cost))
            e = np.concatenate([np.zeros(skip, np.int64), d]).reshape(-1, 2)
            sums = e.sum(axis=1)
            # Pairs of large samples take more bits than any other option, and their codes would overflow.
            codes = sums * (sums + 1) // 2 + e[:, 1] if sums.max() < 1 << 10 else None
            second = int(codes.sum()) + len(codes) + 1 if codes is not None else 1 << 60
            if min(cost[k], second) + len(start) >= block * bits:
                body = [tag(int(v), bits) for v in d]
                out.append("1" * width + (head if skip else "") + "".join(body))
            elif second < cost[k]:
                out.append("0" * width + "1" + start + "".join(unary(int(c)) for c in codes))
            else:
                low = "".join(tag(int(v), k) for v in d) if k else ""
                out.append(tag(k + 1, width) + start + "".join(unary(int(v >> k)) for v in d) + low)
        flush(len(coded) // block)
        if flags & PAD:
            out = ["".join(out)]
            out[0] += "0" * (-len(out[0]) % 8)
    s = "".join(out)
    s += "0" * (-len(s) % 8)
    return int(s, 2).to_bytes(len(s) // 8, "big") if s else b""
