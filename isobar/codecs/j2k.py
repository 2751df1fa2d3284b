"""JPEG 2000 codestreams of one component with the reversible 5/3 wavelet, after the public standard ISO/IEC 15444-1.

Read: any tiling, tile-parts, layers, precincts, the five progressions, packet markers, and code-blocks in the default style. Not read: the 9/7 wavelet, several components, regions of interest,
changes of progression, and other code-block styles; these raise. Written: one tile, one layer, code-blocks of 64 by 64.
"""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the arithmetic coder: probability, next state after the more and the less probable symbol, and whether they change places.
STATES = """
5601 1 1 1
3401 2 6 0
1801 3 9 0
0AC1 4 12 0
0521 5 29 0
0221 38 33 0
5601 7 6 1
5401 8 14 0
4801 9 14 0
3801 10 14 0
3001 11 17 0
2401 12 18 0
1C01 13 20 0
1601 29 21 0
5601 15 14 1
5401 16 14 0
5101 17 15 0
4801 18 16 0
3801 19 17 0
3401 20 18 0
3001 21 19 0
2801 22 19 0
2401 23 20 0
2201 24 21 0
1C01 25 22 0
1801 26 23 0
1601 27 24 0
1401 28 25 0
1201 29 26 0
1101 30 27 0
0AC1 31 28 0
09C1 32 29 0
08A1 33 30 0
0521 34 31 0
0441 35 32 0
02A1 36 33 0
0221 37 34 0
0141 38 35 0
0111 39 36 0
0085 40 37 0
0049 41 38 0
0025 42 39 0
0015 43 40 0
0009 44 41 0
0005 45 42 0
0001 45 43 0
5601 46 46 0
"""
QE, MORE, LESS, SWITCH = (list(c) for c in zip(*((int(q, 16), int(a), int(b), int(s)) for q, a, b, s in (x.split() for x in STATES.strip().splitlines())), strict=True))
RUN, UNIFORM = 17, 18


class J2kError(ValueError):
    """A codestream that is damaged or of a kind that is not supported."""


class Contexts:
    def __init__(self) -> None:
        self.state, self.mps = [0] * 19, [0] * 19
        self.state[0], self.state[RUN], self.state[UNIFORM] = 4, 3, 46


class Decoder(Contexts):
    """The arithmetic decoder; beyond its data it reads ones."""

    def __init__(self, data: bytes):
        super().__init__()
        self.data, self.at = data + b"\xff\xff", 0
        self.c, self.a, self.ct = self.data[0] << 16, 0x8000, 0
        self.fill()
        self.c <<= 7
        self.ct -= 7

    def fill(self) -> None:
        d, at = self.data, self.at
        after = d[at + 1] if at + 1 < len(d) else 0xFF
        if d[at] == 0xFF:
            if after > 0x8F:
                self.c += 0xFF00
                self.ct = 8
            else:
                self.at += 1
                self.c += after << 9
                self.ct = 7
        else:
            self.at += 1
            self.c += after << 8
            self.ct = 8

    def bit(self, cx: int) -> int:
        i, m = self.state[cx], self.mps[cx]
        q = QE[i]
        self.a -= q
        if (self.c >> 16) < q:
            likely = self.a < q
            self.a = q
        else:
            self.c -= q << 16
            if self.a & 0x8000:
                return m
            likely = self.a >= q
        if likely:
            out, self.state[cx] = m, MORE[i]
        else:
            out, self.state[cx] = 1 - m, LESS[i]
            if SWITCH[i]:
                self.mps[cx] = 1 - m
        while True:
            if not self.ct:
                self.fill()
            self.a <<= 1
            self.c = (self.c << 1) & 0xFFFFFFFF
            self.ct -= 1
            if self.a & 0x8000:
                return out


class Encoder(Contexts):
    def __init__(self) -> None:
        super().__init__()
        self.out, self.c, self.a, self.ct = bytearray(b"\x00"), 0, 0x8000, 12

    def put(self) -> None:
        if self.out[-1] == 0xFF:
            self.out.append((self.c >> 20) & 0xFF)
            self.c &= 0xFFFFF
            self.ct = 7
            return
        if self.c >= 0x8000000:
            self.out[-1] += 1
            if self.out[-1] == 0xFF:
                self.c &= 0x7FFFFFF
                self.out.append((self.c >> 20) & 0xFF)
                self.c &= 0xFFFFF
                self.ct = 7
                return
        self.out.append((self.c >> 19) & 0xFF)
        self.c &= 0x7FFFF
        self.ct = 8

    def bit(self, cx: int, d: int) -> int:
        i, m = self.state[cx], self.mps[cx]
        q = QE[i]
        self.a -= q
        if d == m:
            if self.a & 0x8000:
                self.c += q
                return d
            if self.a < q:
                self.a = q
            else:
                self.c += q
            self.state[cx] = MORE[i]
        else:
            if self.a < q:
                self.c += q
            else:
                self.a = q
            if SWITCH[i]:
                self.mps[cx] = 1 - m
            self.state[cx] = LESS[i]
        while not self.a & 0x8000:
            self.a <<= 1
            self.c <<= 1
            self.ct -= 1
            if not self.ct:
                self.put()
        return d

    def finish(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self.put()
        if self.out[-1] == 0xFF:
            self.out.pop()
        return bytes(self.out[1:])


def _zero_contexts() -> dict[str, list[int]]:
    """The context of a first bit, by how many horizontal (0 to 2), vertical (0 to 2) and diagonal (0 to 4) neighbours are significant: index 15 h + 5 v + d."""
    def low(h, v, d):
        return 8 if h == 2 else (7 if v else 6 if d else 5) if h == 1 else 4 if v == 2 else 3 if v else min(d, 2)

    def both(h, v, d):
        s = h + v
        return 8 if d >= 3 else (7 if s else 6) if d == 2 else 3 + min(s, 2) if d == 1 else min(s, 2)

    every = [(h, v, d) for h in range(3) for v in range(3) for d in range(5)]
    return {"LL": [low(*x) for x in every], "LH": [low(*x) for x in every], "HL": [low(v, h, d) for h, v, d in every], "HH": [both(*x) for x in every]}


ZERO = _zero_contexts()


class Block:
    """The bit planes of one code-block. ``coder(cx, d)`` codes the decision d, or ignores it and returns the decoded one."""

    def __init__(self, w: int, h: int, band: str, values: np.ndarray | None = None, causal: bool = False):
        self.w, self.h, self.row = w, h, w + 2
        #: With causal contexts a stripe takes nothing from the one below; raw passes code signs as they are.
        self.causal, self.raw = causal, False
        n = (w + 2) * (h + 2)
        self.sig, self.neg, self.mag, self.seen, self.refined = ([0] * n for _ in range(5))
        self.zero = ZERO[band]
        if values is not None:
            padded = np.zeros((h + 2, w + 2), np.int64)
            padded[1:-1, 1:-1] = values
            self.want, self.want_neg = np.abs(padded).ravel().tolist(), (padded < 0).ravel().astype(int).tolist()
        else:
            self.want = self.want_neg = None

    def last_of_stripe(self, p: int) -> bool:
        return self.causal and (p // self.row - 1) % 4 == 3

    def counts(self, p: int) -> tuple[int, int, int]:
        s, r = self.sig, self.row
        if self.causal and self.last_of_stripe(p):
            return s[p - 1] + s[p + 1], s[p - r], s[p - r - 1] + s[p - r + 1]
        return s[p - 1] + s[p + 1], s[p - r] + s[p + r], s[p - r - 1] + s[p - r + 1] + s[p + r - 1] + s[p + r + 1]

    def sign(self, p: int, coder) -> None:
        s, n, r = self.sig, self.neg, self.row
        if self.raw:
            n[p] = coder(0, self.want_neg[p] if self.want_neg else 0)
            s[p] = 1
            return
        pull = lambda q: (1 - 2 * n[q]) * s[q]
        h = max(-1, min(1, pull(p - 1) + pull(p + 1)))
        v = max(-1, min(1, pull(p - r) + (0 if self.last_of_stripe(p) else pull(p + r))))
        turned = int(h < 0 or (h == 0 and v < 0))
        if turned:
            h, v = -h, -v
        cx = 12 + v if h else 10 if v else 9
        own = self.want_neg[p] if self.want_neg else 0
        self.neg[p] = coder(cx, own ^ turned) ^ turned
        s[p] = 1

    def stripes(self):
        for y0 in range(0, self.h, 4):
            for x in range(self.w):
                yield [(y + 1) * self.row + x + 1 for y in range(y0, min(y0 + 4, self.h))]

    def run(self, kind: int, plane: int, coder) -> None:
        """Pass 0: significance, 1: refinement, 2: clean-up, of one plane."""
        sig, seen, mag, want, zero = self.sig, self.seen, self.mag, self.want, self.zero
        for column in self.stripes():
            if kind == 2 and len(column) == 4 and not any(sig[p] or seen[p] or any(self.counts(p)) for p in column):
                ones = [want[p] >> plane & 1 for p in column] if want else [0] * 4
                if not coder(RUN, int(any(ones))):
                    continue
                k = ones.index(1) if any(ones) else 0
                k = 2 * coder(UNIFORM, k >> 1) + coder(UNIFORM, k & 1)
                p = column[k]
                mag[p] |= 1 << plane
                self.sign(p, coder)
                column = column[k + 1 :]
            for p in column:
                if kind == 1:
                    if sig[p] and not seen[p]:
                        cx = 16 if self.refined[p] else 15 if any(self.counts(p)) else 14
                        mag[p] |= coder(cx, want[p] >> plane & 1 if want else 0) << plane
                        self.refined[p] = 1
                    continue
                if sig[p] or (kind == 2 and seen[p]):
                    continue
                h, v, d = self.counts(p)
                if kind == 0 and not (h or v or d):
                    continue
                if kind == 0:
                    seen[p] = 1
                if coder(zero[15 * h + 5 * v + d], want[p] >> plane & 1 if want else 0):
                    mag[p] |= 1 << plane
                    self.sign(p, coder)
        if kind == 2:
            self.seen[:] = [0] * len(seen)

    def values(self) -> np.ndarray:
        m = np.array(self.mag, np.int64) * (1 - 2 * np.array(self.neg, np.int64))
        return m.reshape(self.h + 2, self.w + 2)[1:-1, 1:-1]


#: The bits of a code-block style.
BYPASS, RESET, TERMINATE, CAUSAL, PREDICTABLE, SEGMENT_MARKS = 1, 2, 4, 8, 16, 32
#: Passes before raw ones: the first clean-up and three planes.
BEFORE_RAW = 10


def segment_room(style: int, done: int) -> int:
    """How many passes, after ``done`` of them, still belong to the segment of the next: segments are ended apart, and their lengths are told apart."""
    if style & TERMINATE:
        return 1
    if not style & BYPASS:
        return 1 << 30
    if done < BEFORE_RAW:
        return BEFORE_RAW - done
    return (2, 1, 1)[(done - BEFORE_RAW) % 3]


def is_raw(style: int, number: int) -> bool:
    return bool(style & BYPASS) and number >= BEFORE_RAW and (number - BEFORE_RAW) % 3 < 2


class RawBits:
    """Bits as they are; an octet after one of ones has seven."""

    def __init__(self, data: bytes = b""):
        self.data, self.at, self.left, self.octet, self.out = data, 0, 0, 0, bytearray()

    def read(self, _: int, __: int) -> int:
        if not self.left:
            self.left = 7 if self.octet == 0xFF else 8
            self.octet = self.data[self.at] if self.at < len(self.data) else 0xFF
            self.at += 1
        self.left -= 1
        return self.octet >> self.left & 1

    def write(self, _: int, d: int) -> int:
        if not self.left:
            self.left = 7 if self.out and self.out[-1] == 0xFF else 8
            self.out.append(0)
        self.left -= 1
        self.out[-1] |= d << self.left
        return d

    def finish(self) -> bytes:
        # The rest is filled with 0 and 1 in turn; a segment never ends on ones.
        k = 0
        while self.left:
            self.write(0, k)
            k = 1 - k
        return bytes(self.out[:-1] if self.out and self.out[-1] == 0xFF else self.out)


def decode_block(segments: list[tuple[int, bytes]], w: int, h: int, band: str, planes: int, style: int = 0) -> np.ndarray:
    """The values of a code-block from its segments (passes, data)."""
    b = Block(w, h, band, causal=bool(style & CAUSAL))
    plane, kind, number = planes - 1, 2, 0
    contexts = Contexts()
    for passes, data in segments:
        raw = is_raw(style, number)
        mq = RawBits(data) if raw else Decoder(data)
        if not raw:
            mq.state, mq.mps = contexts.state, contexts.mps
        coder = mq.read if raw else (lambda cx, _, mq=mq: mq.bit(cx))
        for _ in range(passes):
            if plane < 0:
                raise J2kError("more passes than planes")
            b.raw = raw
            b.run(kind, plane, coder)
            if kind == 2 and style & SEGMENT_MARKS and [coder(UNIFORM, 0) for _ in range(4)] != [1, 0, 1, 0]:
                raise J2kError("a segment mark is missing")
            if style & RESET and not raw:
                fresh = Contexts()
                contexts.state[:], contexts.mps[:] = fresh.state, fresh.mps
            kind = (kind + 1) % 3
            plane -= kind == 0
            number += 1
    return b.values()


def encode_block(values: np.ndarray, band: str, style: int = 0) -> tuple[list[tuple[int, bytes]], int, int]:
    """(segments, planes, passes) of a block; a segment has its passes and data."""
    planes = int(np.abs(values).max()).bit_length() if values.size else 0
    if not planes:
        return [], 0, 0
    b = Block(values.shape[1], values.shape[0], band, values, bool(style & CAUSAL))
    passes, segments, number = 3 * planes - 2, [], 0
    contexts, kind, plane = Contexts(), 2, planes - 1
    while number < passes:
        n = min(segment_room(style, number), passes - number)
        raw = is_raw(style, number)
        mq = RawBits() if raw else Encoder()
        if not raw:
            mq.state, mq.mps = contexts.state, contexts.mps
        coder = mq.write if raw else mq.bit
        for _ in range(n):
            b.raw = raw
            b.run(kind, plane, coder)
            if kind == 2 and style & SEGMENT_MARKS:
                for d in (1, 0, 1, 0):
                    coder(UNIFORM, d)
            if style & RESET and not raw:
                fresh = Contexts()
                contexts.state[:], contexts.mps[:] = fresh.state, fresh.mps
            kind = (kind + 1) % 3
            plane -= kind == 0
        segments.append((n, mq.finish()))
        number += n
    return segments, planes, passes


class HeaderBits:
    """Packet headers: after an octet of ones the next has seven bits."""

    def __init__(self, data: bytes = b"", at: int = 0):
        self.data, self.at, self.left, self.octet, self.out = data, at, 0, 0, bytearray()

    def read(self, n: int = 1) -> int:
        v = 0
        for _ in range(n):
            if not self.left:
                if self.at >= len(self.data):
                    raise J2kError("a packet header is cut short")
                self.left = 7 if self.octet == 0xFF else 8
                self.octet = self.data[self.at]
                self.at += 1
            self.left -= 1
            v = v << 1 | self.octet >> self.left & 1
        return v

    def align(self) -> int:
        if self.octet == 0xFF:
            self.at += 1
        self.left = self.octet = 0
        return self.at

    def write(self, v: int, n: int) -> None:
        for k in range(n - 1, -1, -1):
            if not self.left:
                self.left = 7 if self.out and self.out[-1] == 0xFF else 8
                self.out.append(0)
            self.left -= 1
            self.out[-1] |= (v >> k & 1) << self.left

    def done(self) -> bytes:
        if self.out and self.out[-1] == 0xFF:
            self.out.append(0)
        return bytes(self.out)


class TagTree:
    """Values of a grid of leaves, told by bounds from the root down. The same walk reads and writes."""

    def __init__(self, w: int, h: int, values: list[int] | None = None):
        self.sizes = [(w, h)]
        while self.sizes[-1] != (1, 1):
            a, b = self.sizes[-1]
            self.sizes.append(((a + 1) // 2, (b + 1) // 2))
        self.low = [[0] * (a * b) for a, b in self.sizes]
        self.known = [[False] * (a * b) for a, b in self.sizes]
        self.want = None
        if values is not None:
            self.want = [values]
            for (a, b), (c, d) in zip(self.sizes, self.sizes[1:], strict=False):
                up = [1 << 30] * (c * d)
                for y in range(b):
                    for x in range(a):
                        k = y // 2 * c + x // 2
                        up[k] = min(up[k], self.want[-1][y * a + x])
                self.want.append(up)

    def walk(self, leaf: int, limit: int, bits: HeaderBits) -> bool:
        """Whether the leaf's value is below the limit, from as many bits as that takes."""
        x, y = leaf % self.sizes[0][0], leaf // self.sizes[0][0]
        bound = 0
        for level in range(len(self.sizes) - 1, -1, -1):
            k = (y >> level) * self.sizes[level][0] + (x >> level)
            v = max(self.low[level][k], bound)
            while v < limit and not self.known[level][k]:
                if self.want is None:
                    hit = bits.read()
                else:
                    hit = int(self.want[level][k] == v)
                    bits.write(hit, 1)
                if hit:
                    self.known[level][k] = True
                else:
                    v += 1
            self.low[level][k] = bound = v
        return self.known[0][leaf] and self.low[0][leaf] < limit

    def value(self, leaf: int, bits: HeaderBits) -> int:
        limit = 1
        while not self.walk(leaf, limit, bits):
            limit += 1
            if limit > 80:
                raise J2kError("a tag tree has no end")
        return self.low[0][leaf]


def _read_passes(bits: HeaderBits) -> int:
    if not bits.read():
        return 1
    if not bits.read():
        return 2
    if (v := bits.read(2)) < 3:
        return 3 + v
    if (v := bits.read(5)) < 31:
        return 6 + v
    return 37 + bits.read(7)


def _write_passes(n: int, bits: HeaderBits) -> None:
    if n == 1:
        bits.write(0, 1)
    elif n == 2:
        bits.write(2, 2)
    elif n <= 5:
        bits.write(0b1100 | (n - 3), 4)
    elif n <= 36:
        bits.write(0b1111 << 5 | (n - 6), 9)
    else:
        bits.write(0b111111111 << 7 | (n - 37), 16)


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def inverse_5_3(low: np.ndarray, high: np.ndarray, odd: int, axis: int) -> np.ndarray:
    """One level along an axis; ``odd``: whether the first sample has an odd place and so comes from the high band."""
    low, high = np.moveaxis(low, axis, 0), np.moveaxis(high, axis, 0)
    n = len(low) + len(high)
    if n == 1:
        return np.moveaxis(high // 2 if odd else low, 0, axis)
    even = low - ((_at(high, -1 + odd, len(low)) + _at(high, odd, len(low)) + 2) >> 2)
    rest = high + ((_at(even, -odd, len(high)) + _at(even, 1 - odd, len(high))) >> 1)
    out = np.empty((n, *low.shape[1:]), np.int64)
    out[odd::2], out[1 - odd :: 2] = even, rest
    return np.moveaxis(out, 0, axis)


def forward_5_3(x: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Low and high band along an axis from an even place on."""
    x = np.moveaxis(x, axis, 0)
    even, rest = x[::2], x[1::2]
    if len(x) == 1:
        return np.moveaxis(even, 0, axis), np.moveaxis(rest, 0, axis)
    high = rest - ((_at(even, 0, len(rest)) + _at(even, 1, len(rest))) >> 1)
    low = even + ((_at(high, -1, len(even)) + _at(high, 0, len(even)) + 2) >> 2)
    return np.moveaxis(low, 0, axis), np.moveaxis(high, 0, axis)


def _at(x: np.ndarray, shift: int, n: int) -> np.ndarray:
    """x from a shifted place on; beyond its ends the nearest sample, which is what mirroring gives."""
    return x[np.clip(np.arange(n) + shift, 0, len(x) - 1)]


class Tile:
    """The bands, precincts and code-blocks of a tile."""

    def __init__(self, box: tuple[int, int, int, int], cod: dict, qcd: dict, changes: list[dict] = (), shift: int = 0):
        """``changes``: progressions that follow each other, each over a part of the packets; ``shift``: by how many planes a region of interest is raised."""
        self.box, self.cod, self.changes, self.shift = box, cod, changes, shift
        levels = cod["levels"]
        self.resolutions = []
        for r in range(levels + 1):
            s = 1 << (levels - r)
            x0, y0, x1, y1 = (ceil_div(v, s) for v in box)
            px, py = cod["precincts"][r]
            nw = ceil_div(x1, 1 << px) - (x0 >> px) if x1 > x0 else 0
            nh = ceil_div(y1, 1 << py) - (y0 >> py) if y1 > y0 else 0
            bands = []
            for name, ox, oy in ([("LL", 0, 0)] if r == 0 else [("HL", 1, 0), ("LH", 0, 1), ("HH", 1, 1)]):
                nb = levels if r == 0 else levels - r + 1
                half = (1 << nb) >> 1
                b = [ceil_div(v - half * o, 1 << nb) for v, o in zip(box, (ox, oy, ox, oy), strict=True)]
                index = 0 if r == 0 else 3 * (r - 1) + 1 + ("HL", "LH", "HH").index(name)
                if index >= len(qcd["exponents"]):
                    raise J2kError("a band has no exponent")
                bands.append(self._band(name, b, r, px, py, x0, y0, nw, nh, qcd["exponents"][index] + qcd["guard"] - 1 + shift))
            self.resolutions.append({"box": (x0, y0, x1, y1), "px": px, "py": py, "nw": nw, "nh": nh, "bands": bands})

    def _band(self, name, b, r, px, py, x0, y0, nw, nh, planes):
        half = int(r > 0)
        cw, ch = min(self.cod["xcb"], px - half), min(self.cod["ycb"], py - half)
        precincts = []
        for j in range(nh):
            for i in range(nw):
                left, top = ((x0 >> px) + i << px) >> half, ((y0 >> py) + j << py) >> half
                a0, a1 = max(b[0], left), min(b[2], left + (1 << px - half))
                c0, c1 = max(b[1], top), min(b[3], top + (1 << py - half))
                blocks, gw, gh = [], 0, 0
                if a1 > a0 and c1 > c0:
                    gw, gh = ceil_div(a1, 1 << cw) - (a0 >> cw), ceil_div(c1, 1 << ch) - (c0 >> ch)
                    for y in range(c0 >> ch, (c0 >> ch) + gh):
                        for x in range(a0 >> cw, (a0 >> cw) + gw):
                            blocks.append({"box": (max(a0, x << cw), max(c0, y << ch), min(a1, x + 1 << cw), min(c1, y + 1 << ch)), "segments": [], "passes": 0, "lblock": 3, "zero": None})
                precincts.append({"blocks": blocks, "in": TagTree(gw, gh) if blocks else None, "zero": TagTree(gw, gh) if blocks else None})
        return {"name": name, "box": b, "planes": planes, "precincts": precincts}

    def packets(self):
        """(layer, resolution, precinct) in the order of the progression."""
        cod = self.cod
        every = [(layer, r, k) for layer in range(cod["layers"]) for r, res in enumerate(self.resolutions) for k in range(res["nw"] * res["nh"])]

        def place(r, k):
            res = self.resolutions[r]
            s = self.cod["levels"] - r
            i, j = k % res["nw"], k // res["nw"]
            x = ((res["box"][0] >> res["px"]) + i) << (res["px"] + s) if i else self.box[0]
            y = ((res["box"][1] >> res["py"]) + j) << (res["py"] + s) if j else self.box[1]
            return y, x

        keys = [lambda p: (p[0], p[1], p[2]), lambda p: (p[1], p[0], p[2]), lambda p: (p[1], *place(p[1], p[2]), p[0]), lambda p: (*place(p[1], p[2]), p[1], p[0]), lambda p: (*place(p[1], p[2]), p[1], p[0])]
        out, seen = [], set()
        for part in [*self.changes, {"progression": cod["progression"], "first": 0, "last": 1 << 8, "layers": 1 << 16}]:
            if part["progression"] > 4:
                raise J2kError("an unknown progression")
            own = [p for p in every if p not in seen and p[0] < part["layers"] and part["first"] <= p[1] < part["last"]]
            out += sorted(own, key=keys[part["progression"]])
            seen.update(own)
        return out

    def read(self, data: bytes) -> None:
        at = 0
        for layer, r, k in self.packets():
            if at >= len(data):
                break  # what is missing is taken as zero
            if self.cod["sop"] and data[at : at + 2] == b"\xff\x91":
                at += 6
            bits = HeaderBits(data, at)
            pieces = []
            if bits.read():
                for band in self.resolutions[r]["bands"]:
                    p = band["precincts"][k]
                    for n, b in enumerate(p["blocks"]):
                        if b["zero"] is not None:
                            if not bits.read():
                                continue
                        elif p["in"].walk(n, layer + 1, bits):
                            b["zero"] = p["zero"].value(n, bits)
                        else:
                            continue
                        passes = _read_passes(bits)
                        while bits.read():
                            b["lblock"] += 1
                        while passes:
                            n = min(passes, segment_room(self.cod["style"], b["passes"]))
                            pieces.append((b, n, bits.read(b["lblock"] + n.bit_length() - 1), b["passes"]))
                            b["passes"] += n
                            passes -= n
            at = bits.align()
            if self.cod["eph"] and data[at : at + 2] == b"\xff\x92":
                at += 2
            for b, passes, size, before in pieces:
                if at + size > len(data):
                    raise J2kError("a code-block is cut short")
                # A segment may go on from the layer before.
                style, last = self.cod["style"], b["segments"][-1] if b["segments"] else None
                if last and segment_room(style, before - last[0]) > last[0]:
                    b["segments"][-1] = (last[0] + passes, last[1] + data[at : at + size])
                else:
                    b["segments"].append((passes, data[at : at + size]))
                at += size

    def _raised(self, v: np.ndarray) -> np.ndarray:
        """Values of a region of interest, which lie above all others, brought down again."""
        return np.where(np.abs(v) >> self.shift > 0, np.sign(v) * (np.abs(v) >> self.shift), v) if self.shift else v

    def samples(self) -> np.ndarray:
        image = None
        for r, res in enumerate(self.resolutions):
            parts = {}
            for band in res["bands"]:
                b = band["box"]
                a = np.zeros((max(b[3] - b[1], 0), max(b[2] - b[0], 0)), np.int64)
                for p in band["precincts"]:
                    for k in p["blocks"]:
                        if k["passes"]:
                            x0, y0, x1, y1 = k["box"]
                            a[y0 - b[1] : y1 - b[1], x0 - b[0] : x1 - b[0]] = self._raised(decode_block(k["segments"], x1 - x0, y1 - y0, band["name"], band["planes"] - k["zero"], self.cod["style"]))
                parts[band["name"]] = a
            if r == 0:
                image = parts["LL"]
                continue
            x0, y0, _, _ = res["box"]
            low = inverse_5_3(image, parts["HL"], x0 & 1, 1)
            high = inverse_5_3(parts["LH"], parts["HH"], x0 & 1, 1)
            image = inverse_5_3(low, high, y0 & 1, 0)
        return image


def _markers(data: bytes):
    """The codestream's parts: size, coding, quantisation, and each tile's data."""
    at = data.find(b"\xff\x4f\xff\x51")
    if at < 0:
        raise J2kError("no codestream")
    at += 2
    siz, main = None, {}
    tiles: dict[int, dict] = {}
    try:
        while at < len(data):
            mark = int.from_bytes(data[at : at + 2], "big")
            if mark == 0xFFD9:
                break
            n = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + n]
            if mark == 0xFF51:
                siz = struct.unpack(">HIIIIIIIIH", body[:36])
                depth, dx, dy = body[36], body[37], body[38]
                if siz[9] != 1 or (dx, dy) != (1, 1):
                    raise J2kError("more than one component, or one that is not at full size")
                siz = (*siz, depth)
            elif mark in (0xFF60, 0xFF61):
                raise J2kError("packed packet headers are not supported")
            elif mark == 0xFF90:
                tile, size = struct.unpack(">HI", body[:6])
                start = at
                end = start + size if size else len(data) - 2
                at += 2 + n
                own = tiles.setdefault(tile, {"data": b""})
                while data[at : at + 2] != b"\xff\x93":
                    inner, m = int.from_bytes(data[at : at + 2], "big"), int.from_bytes(data[at + 2 : at + 4], "big")
                    if inner in (0xFF60, 0xFF61):
                        raise J2kError("packed packet headers are not supported")
                    _parameter(inner, data[at + 4 : at + 2 + m], own)
                    at += 2 + m
                    if m < 2 or at >= len(data):
                        raise J2kError("a tile is cut short")
                own["data"] += data[at + 2 : end]
                at = end
                continue
            else:
                _parameter(mark, body, main)
            at += 2 + n
    except (struct.error, IndexError) as e:
        raise J2kError(f"damaged codestream: {e}") from None
    if siz is None or "cod" not in main or "qcd" not in main or not tiles:
        raise J2kError("the codestream lacks a part")
    out = {}
    for number, own in tiles.items():
        # The component's own parameters go before those of all, the tile's before the stream's.
        cod = own.get("cod", main["cod"])
        blocks = own.get("coc") or own.get("cod") or main.get("coc") or main["cod"]
        qcd = own.get("qcc") or own.get("qcd") or main.get("qcc") or main["qcd"]
        inner = {k: blocks[k] for k in ("levels", "xcb", "ycb", "style", "precincts")}
        out[number] = ({**cod, **inner}, qcd, own.get("poc", main.get("poc", [])), own.get("rgn", main.get("rgn", 0)), own["data"])
    return siz, out


def _parameter(mark: int, body: bytes, into: dict) -> None:
    """Takes up a marker of coding parameters, of all components or of the only one. Others are passed over."""
    if mark == 0xFF52:
        into["cod"] = _coding(body)
    elif mark == 0xFF53 and body[0] == 0:
        into["coc"] = _blocks(body[1] & 1, body[2:])
    elif mark == 0xFF5C:
        into["qcd"] = _exponents(body)
    elif mark == 0xFF5D and body[0] == 0:
        into["qcc"] = _exponents(body[1:])
    elif mark == 0xFF5E and body[0] == 0:
        if body[1]:
            raise J2kError("a region of interest of an unknown style")
        into["rgn"] = body[2]
    elif mark == 0xFF5F:
        parts = [struct.unpack(">BBHBBB", body[k : k + 7]) for k in range(0, len(body) - 6, 7)]
        into["poc"] = into.get("poc", []) + [{"first": r0, "layers": layers, "last": r1, "progression": order} for r0, c0, layers, r1, _, order in parts if c0 == 0]


def _exponents(body: bytes) -> dict:
    if body[0] & 31:
        raise J2kError("only the reversible wavelet is supported")
    return {"guard": body[0] >> 5, "exponents": [v >> 3 for v in body[1:]]}


def _blocks(with_precincts: int, body: bytes) -> dict:
    levels, xcb, ycb, style, wavelet = struct.unpack(">BBBBB", body[:5])
    if wavelet != 1 or levels > 32:
        raise J2kError("only the reversible wavelet is supported")
    if style & ~63:
        raise J2kError(f"code-block style {style} is not supported")
    precincts = [(v & 15, v >> 4) for v in body[5 : 6 + levels]] if with_precincts else [(15, 15)] * (levels + 1)
    if len(precincts) <= levels:
        raise J2kError("a resolution has no precincts")
    return {"levels": levels, "xcb": (xcb & 15) + 2, "ycb": (ycb & 15) + 2, "style": style, "precincts": precincts}


def _coding(body: bytes) -> dict:
    scod, progression, layers, multi = struct.unpack(">BBHB", body[:5])
    if multi:
        raise J2kError("a transform of several components is not supported")
    return {"progression": progression, "layers": layers, "sop": bool(scod & 2), "eph": bool(scod & 4), **_blocks(scod & 1, body[5:])}


def decode(data: bytes) -> np.ndarray:
    """The samples, in rows."""
    siz, tiles = _markers(data)
    _, x1, y1, x0, y0, tw, th, tx, ty, _, depth = siz
    if (x1 - x0) * (y1 - y0) > 100_000_000 or x1 <= x0 or y1 <= y0 or not tw or not th:
        raise J2kError("the image has no sensible size")
    across = ceil_div(x1 - tx, tw)
    out = np.zeros((y1 - y0, x1 - x0), np.int64)
    for number, (cod, qcd, changes, shift, body) in tiles.items():
        i, j = number % across, number // across
        box = max(tx + i * tw, x0), max(ty + j * th, y0), min(tx + (i + 1) * tw, x1), min(ty + (j + 1) * th, y1)
        if box[2] <= box[0] or box[3] <= box[1]:
            raise J2kError("a tile lies outside the image")
        tile = Tile(box, cod, qcd, changes, shift)
        tile.read(body)
        out[box[1] - y0 : box[3] - y0, box[0] - x0 : box[2] - x0] = tile.samples()
    # Unsigned samples are shifted by half their range.
    return out if depth & 0x80 else out + (1 << (depth & 0x7F))


def encode(samples: np.ndarray, bits: int, levels: int = 5, style: int = 0) -> bytes:
    """One tile and layer of unsigned samples of ``bits`` bits, in code-blocks of any style; no more levels than the shorter side halves."""
    h, w = samples.shape
    levels = min(levels, max(min(h, w).bit_length() - 1, 0))
    x = np.asarray(samples, np.int64) - (1 << (bits - 1))
    bands: list[dict[str, np.ndarray]] = []
    for _ in range(levels):
        low, high = forward_5_3(x, 0)
        ll, hl = forward_5_3(low, 1)
        lh, hh = forward_5_3(high, 1)
        bands.append({"HL": hl, "LH": lh, "HH": hh})
        x = ll
    bands.append({"LL": x})
    gain = {"LL": 0, "HL": 1, "LH": 1, "HH": 2}
    coded = [[(name, a, [[encode_block(a[y : y + 64, c : c + 64], name, style) for c in range(0, a.shape[1], 64)] for y in range(0, a.shape[0], 64)]) for name, a in res.items()] for res in reversed(bands)]
    most = max([1, *(b[1] - bits - gain[name] for res in coded for name, _, rows in res for row in rows for b in row)])
    guard = max(2, most + 1)
    body = b""
    for res in coded:
        head, data = HeaderBits(), b""
        head.write(1, 1)
        for name, _, rows in res:
            flat = [b for row in rows for b in row]
            if not flat:
                continue
            planes = bits + gain[name] + guard - 1
            gw, gh = len(rows[0]), len(rows)
            inside = TagTree(gw, gh, [int(not b[2]) for b in flat])
            zero = TagTree(gw, gh, [planes - b[1] for b in flat])
            for n, (segments, _, passes) in enumerate(flat):
                if not inside.walk(n, 1, head):
                    continue
                zero.value(n, head)
                _write_passes(passes, head)
                lblock = max([3, *(len(piece).bit_length() - k.bit_length() + 1 for k, piece in segments)])
                head.write((1 << (lblock - 3 + 1)) - 2, lblock - 3 + 1)
                for k, piece in segments:
                    head.write(len(piece), lblock + k.bit_length() - 1)
                    data += piece
        body += head.done() + data
    siz = struct.pack(">HHIIIIIIIIHBBB", 41, 0, w, h, 0, 0, w, h, 0, 0, 1, bits - 1, 1, 1)
    cod = struct.pack(">HBBHBBBBBB", 12, 0, 0, 1, 0, levels, 4, 4, style, 1)
    exponents = [bits] + [bits + g for _ in range(levels) for g in (1, 1, 2)]
    qcd = struct.pack(">HB", 3 + len(exponents), guard << 5) + bytes(e << 3 for e in exponents)
    sot = struct.pack(">HHIBB", 10, 0, 14 + len(body), 0, 1)
    return b"\xff\x4f\xff\x51" + siz + b"\xff\x52" + cod + b"\xff\x5c" + qcd + b"\xff\x90" + sot + b"\xff\x93" + body + b"\xff\xd9"
