"""The packings of data representation templates 5.0, 5.2, 5.3, 5.4, 5.40, 5.41, 5.42 and 5.200.

Each ``unpack`` takes the bytes of a data section, the template's numbers by name and the count of values, and returns doubles in data order, missing points as NaN.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from isobar.codecs import aec, j2k
from isobar.codecs.bitio import packed, put, take
from isobar.codecs.scaling import PackingError, Scale, check_count, choose

NAN = float("nan")


def scale_of(t: dict) -> Scale:
    return Scale(t["reference"], int(t["binary_scale"]), int(t["decimal_scale"]), int(t["bits"]))


def template(s: Scale, **more) -> dict:
    return {"reference": s.reference, "binary_scale": s.binary, "decimal_scale": s.decimal, "bits": s.bits, "original_type": 0, **more}


# ---- simple and IEEE


def unpack_simple(data: bytes, t: dict, n: int) -> np.ndarray:
    """No bits: the reference as it is, without the decimal scale."""
    check_count(n)
    s = scale_of(t)
    if s.bits >= 64:
        raise PackingError(f"{s.bits} bits per value")
    if s.bits == 0:
        return np.full(n, s.reference)
    if len(data) * 8 < s.bits * n:
        raise PackingError("too few octets")
    return s.values(take(data, n, s.bits))


def pack_simple(values: np.ndarray, bits: int) -> tuple[bytes, dict]:
    s = choose(values, bits, 63)
    return (packed(put(s.integers(values), s.bits)) if s.bits else b""), template(s)


def unpack_ieee(data: bytes, t: dict, n: int) -> np.ndarray:
    check_count(n)
    kind = {1: ">f4", 2: ">f8"}.get(int(t["precision"]))
    if kind is None:
        raise PackingError(f"precision {t['precision']}")
    if len(data) < n * int(kind[2]):
        raise PackingError("too few octets")
    return np.frombuffer(data, kind, n).astype(np.float64)


def pack_ieee(values: np.ndarray, precision: int) -> tuple[bytes, dict]:
    if precision not in (1, 2):
        raise PackingError(f"precision {precision}")
    return np.asarray(values).astype(">f4" if precision == 1 else ">f8").tobytes(), {"precision": precision}


# ---- complex, with spatial differences


def _undo_differences(x: np.ndarray, present: np.ndarray, order: int, first: list[int], bias: int) -> np.ndarray:
    """Running sums over the points that are present; the first ones are as given."""
    d = x[present].copy()
    if len(d) > order:
        d[order:] += bias
    d[:order] = first[: len(d)]
    if order == 2 and len(d) > 1:
        slope = d[1] - d[0]
        d[1:] = np.cumsum(np.concatenate([[slope], d[2:]]))
    out = x.copy()
    out[present] = np.cumsum(d)
    return out


def unpack_complex(data: bytes, t: dict, n: int, substitute: bool = False) -> np.ndarray:
    """Groups of values with a reference, width and length each. Of no groups, the reference with the decimal scale. With ``substitute`` missing points have the substitutes, else NaN."""
    check_count(n)
    s, groups = scale_of(t), int(t["groups"])
    if n == 0:
        return np.zeros(0)
    if groups == 0:
        return np.full(n, s.reference * 10.0**-s.decimal)
    order, octets, manage = int(t.get("order", 0)), int(t.get("extra_octets", 0)), int(t["missing"])
    if s.bits > 63 or order > 2 or manage > 2 or (order and not 1 <= octets <= 7):
        raise PackingError("the parameters of complex packing make no sense")
    at, first, bias = 0, [], 0
    if order:
        first = take(data, order, 8 * octets).tolist()
        whole = int(take(data, 1, 8 * octets, 8 * octets * order)[0])
        top = 1 << (8 * octets - 1)
        bias = top - whole if whole >= top else whole
        at = 8 * octets * (order + 1)
    start_widths = -(-(at + groups * s.bits) // 8)
    start_lengths = start_widths + -(-groups * int(t["width_bits"]) // 8)
    start_values = start_lengths + -(-groups * int(t["length_bits"]) // 8)
    if start_values > len(data):
        raise PackingError("too few octets for the groups")
    reference = take(data, groups, s.bits, at)
    width = take(data, groups, int(t["width_bits"]), 8 * start_widths) + int(t["width_reference"])
    length = take(data, groups, int(t["length_bits"]), 8 * start_lengths) * int(t["length_step"]) + int(t["length_reference"])
    length[-1] = int(t["last_length"])
    if width.max() > 63 or length.min() < 0 or length.sum() != n:
        raise PackingError("the groups do not make up the field")
    bit = 8 * start_values + np.concatenate([[0], np.cumsum(width * length)])
    if -(-int(bit[-1]) // 8) > len(data):
        raise PackingError("too few octets for the values")
    of = np.repeat(np.arange(groups), length)
    place = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    x = np.zeros(n, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width[of] == w)
        begin = bit[of[own]] + w * place[own]
        v = np.zeros(len(own), np.int64)
        for k in range(w):
            v = (v << 1) | bits[begin + k]
        x[own] = v
    kind = np.zeros(n, np.int8)
    if manage:
        own = np.where(width[of] > 0, x, reference[of])
        ones = np.where(width[of] > 0, (np.int64(1) << width[of]) - 1, (1 << s.bits) - 1)
        if manage == 2:
            kind[own == ones - 1] = 2
        kind[own == ones] = 1
    x += reference[of]
    if order:
        x = _undo_differences(x, kind == 0, order, first, bias)
    out = s.values(x)
    for k, name in ((1, "primary"), (2, "secondary")):
        out[kind == k] = struct.unpack(">f", struct.pack(">I", int(t[name])))[0] if substitute else NAN
    return out


#: Values of a group before neighbours are joined.
SEED = 8


def _grouped(x: np.ndarray, present: np.ndarray, with_missing: bool) -> list[tuple[int, int]]:
    """Bounds of groups: seeds of a few values, joined with a neighbour as long as that saves bits. Merging looks at all pairs of neighbours at once and joins those that save most."""
    cuts = np.append(np.arange(0, len(x), SEED), len(x))
    big = np.int64(1) << 62
    low = np.minimum.reduceat(np.where(present, x, big), cuts[:-1])
    high = np.maximum.reduceat(np.where(present, x, -big), cuts[:-1])
    length = np.diff(cuts)
    head = 24  # what a group costs besides its values

    def bits(lo, hi):
        span = np.where(hi >= lo, hi - lo + (1 if with_missing else 0), 0)
        return np.ceil(np.log2(span.astype(np.float64) + 1))

    while len(length) > 1:
        own = bits(low, high) * length
        lo, hi, n = np.minimum(low[:-1], low[1:]), np.maximum(high[:-1], high[1:]), length[:-1] + length[1:]
        saved = own[:-1] + own[1:] + head - bits(lo, hi) * n
        best = saved > 0
        # Of overlapping pairs the better one goes first.
        best[1:] &= ~((saved[1:] <= saved[:-1]) & (saved[:-1] > 0))
        best[:-1] &= ~(saved[:-1] < saved[1:])
        best[1:] &= ~best[:-1]
        at = np.flatnonzero(best)
        if not len(at):
            break
        low[at], high[at], length[at] = lo[at], hi[at], n[at]
        keep = np.ones(len(length), bool)
        keep[at + 1] = False
        low, high, length = low[keep], high[keep], length[keep]
    ends = np.cumsum(length)
    return _shifted(x, present, list(zip((ends - length).tolist(), ends.tolist(), strict=True)), bits)


def _shifted(x: np.ndarray, present: np.ndarray, groups: list[tuple[int, int]], bits) -> list[tuple[int, int]]:
    """The groups with their borders moved: values at the border of a wide group go over to a narrower neighbour as long as they fit into its width, which saves the difference for each."""
    big = np.int64(1) << 62
    low, high = np.where(present, x, big), np.where(present, x, -big)
    bounds = [lo for lo, _ in groups] + [groups[-1][1]]
    span = [(int(low[a:b].min()), int(high[a:b].max())) for a, b in groups]
    width = [int(bits(np.int64(lo), np.int64(hi))) for lo, hi in span]

    def fit(k: int, part: slice) -> int:
        """How many values at the beginning of a part of the field fit into group k, and its span then."""
        lo, hi = np.minimum.accumulate(np.minimum(low[part], span[k][0])), np.maximum.accumulate(np.maximum(high[part], span[k][1]))
        n = int((bits(lo, hi) <= width[k]).cumprod().sum())
        if n:
            span[k] = int(lo[n - 1]), int(hi[n - 1])
        return n

    for k in range(len(groups) - 1):
        at = bounds[k + 1]
        if width[k] < width[k + 1] and bounds[k + 2] - at > 1:
            bounds[k + 1] = at + fit(k, slice(at, bounds[k + 2] - 1))
        elif width[k] > width[k + 1] and at - bounds[k] > 1:
            bounds[k + 1] = at - fit(k + 1, slice(at - 1, bounds[k], -1))
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def pack_complex(values: np.ndarray, bits: int, order: int = 0, substitute: float = NAN) -> tuple[bytes, dict]:
    """Missing points (NaN) are marked within their groups, and ``substitute`` is declared to stand for them. ``order`` 1 or 2 packs differences."""
    if order not in (0, 1, 2):
        raise PackingError(f"differences of order {order}")
    v = np.asarray(values, np.float64)
    s = choose(v, min(bits, 23), 63, missing_allowed=True)
    present = ~np.isnan(v)
    common = {"splitting": 1, "missing": int(not present.all()), "primary": struct.unpack(">I", struct.pack(">f", substitute))[0], "secondary": 0xFFFFFFFF, "length_step": 1}
    empty = {"groups": 0, "width_reference": 0, "width_bits": 0, "length_reference": 0, "last_length": 0, "length_bits": 0}
    more = {"order": order, "extra_octets": 0} if order else {}
    if s.bits == 0 and present.all():
        return b"", template(s, **common, **empty, **more)
    x = np.zeros(len(v), np.int64)
    if s.bits:
        x[present] = s.integers(v[present])
    first, bias = [], 0
    order = order if present.sum() > order else 0
    if order:
        p = x[present]
        first = p[:order].tolist()
        d = p[1:] - p[:-1] if order == 1 else p[2:] - 2 * p[1:-1] + p[:-2]
        bias = int(d.min()) if len(d) else 0
        p = np.concatenate([np.zeros(order, np.int64), d - bias])
        x[present] = p
    missing = not present.all()
    groups = _grouped(x, present, missing)
    refs, widths, lengths, runs = [], [], [], []
    for lo, hi in groups:
        ok = present[lo:hi]
        g = x[lo:hi]
        ref = int(g[ok].min()) if ok.any() else 0
        top = int(g[ok].max()) - ref if ok.any() else 0
        w = int(top + (1 if missing else 0)).bit_length() if missing and not ok.all() or top else 0
        if missing and w and top >= (1 << w) - 1:
            w += 1
        refs.append(ref)
        widths.append(w)
        lengths.append(hi - lo)
        if w:
            runs.append(put(np.where(ok, g - ref, (1 << w) - 1), w))
    # All ones of a group reference mark a group of missing points only where the group has no width.
    ref_bits = max(1, int(max(refs) + (1 if missing else 0)).bit_length())
    if missing and max(refs) >= (1 << ref_bits) - 1:
        ref_bits += 1
    wr, lr = min(widths), min(lengths)
    wb, lb = int(max(widths) - wr).bit_length(), int(max(lengths) - lr).bit_length()
    octets = 0
    head = b""
    if order:
        octets = max(1, -(-max(int(max(first)).bit_length(), abs(bias).bit_length() + 1) // 8))
        stored = (1 << (8 * octets - 1)) - bias if bias < 0 else bias
        head = b"".join(int(q).to_bytes(octets, "big") for q in [*first, stored])
    body = head + packed(put(np.array(refs), ref_bits)) + packed(put(np.array(widths) - wr, wb) if wb else np.zeros(0, np.uint8)) + packed(put(np.array(lengths) - lr, lb) if lb else np.zeros(0, np.uint8)) + packed(*runs)
    t = template(Scale(s.reference, s.binary, 0, ref_bits), **common, groups=len(groups), width_reference=wr, width_bits=wb, length_reference=lr, last_length=lengths[-1], length_bits=lb)
    return body, {**t, **({"order": order, "extra_octets": octets} if more and order else {"order": 0, "extra_octets": 0} if more else {})}


# ---- run length


def unpack_run_length(data: bytes, t: dict, n: int) -> np.ndarray:
    """Levels and the lengths of their runs; level 0 is missing."""
    check_count(n)
    bits, most, levels, d = int(t["bits"]), int(t["max_level"]), list(t["levels"]), int(t["decimal_scale"])
    if n == 0:
        return np.zeros(0)
    if not 1 <= bits <= 63:
        raise PackingError(f"{bits} bits per value")
    codes = take(data, len(data) * 8 // bits, bits)
    if not len(codes) or most == 0:
        return np.full(n, NAN)
    base = (1 << bits) - 1 - most
    if most > len(levels) or base <= 0:
        raise PackingError("the parameters of run-length packing make no sense")
    starts = np.flatnonzero(codes <= most)
    if not len(starts) or starts[0]:
        raise PackingError("a run does not start with a level")
    run = np.cumsum(codes <= most) - 1
    place = np.arange(len(codes)) - starts[run] - 1
    digit = codes > most
    if digit.any() and (place[digit].max() * np.log2(max(base, 2)) > 62):
        raise PackingError("a run is too long")
    amount = np.where(digit, (codes - most - 1) * np.power(np.int64(base), np.maximum(place, 0)), 0)
    length = 1 + np.bincount(run, amount, len(starts)).astype(np.int64)
    if length.sum() != n:
        raise PackingError(f"the runs make {length.sum()} values instead of {n}")
    d = -(d - 128) if d > 127 else d
    scaled = np.concatenate([[NAN], np.array(levels, np.float64) * 10.0**-d])
    return np.repeat(scaled[codes[starts]], length)


def pack_run_length(values: np.ndarray, bits: int) -> tuple[bytes, dict]:
    """Whole numbers below 2^16, or NaN, as levels and the lengths of their runs. The levels are those that occur."""
    v = np.asarray(values, np.float64)
    own = np.unique(v[~np.isnan(v)])
    if len(own) and (own.min() < 0 or own.max() > 0xFFFF or (own != np.floor(own)).any()):
        raise PackingError("run-length packing takes whole numbers of 16 bits")
    base = (1 << bits) - 1 - len(own)
    # The octets tell how many codes there are, so the last one's padding must be shorter than a code.
    if not 8 <= bits <= 16 or base < 1 + (len(v) > 1):
        raise PackingError(f"codes of {bits} bits for {len(own)} levels")
    t = {"bits": bits, "max_level": len(own), "level_count": len(own), "decimal_scale": 0, "levels": own.astype(int).tolist()}
    code = np.where(np.isnan(v), 0, np.searchsorted(own, np.nan_to_num(v)) + 1)
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    left = np.diff(np.append(start, len(code))) - 1
    # Digits of the run's length less one, the lowest first.
    columns, used = [code[start]], [np.ones(len(start), bool)]
    while (left > 0).any():
        columns.append(len(own) + 1 + left % base)
        used.append(left > 0)
        left = left // base
    return packed(put(np.stack(columns, axis=1)[np.stack(used, axis=1)], bits)), t


# ---- PNG

MAGIC = b"\x89PNG\r\n\x1a\n"


def _unfiltered(raw: bytes, height: int, row: int, step: int) -> np.ndarray:
    lines = np.frombuffer(raw, np.uint8, height * (row + 1)).reshape(height, row + 1)
    out = np.zeros((height, row), np.uint8)
    before = np.zeros(row, np.int64)
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0).ravel() & 255
        elif kind == 2:
            line = (line + before) & 255
        elif kind in (3, 4):
            for x in range(row):
                a, b, c = (line[x - step], before[x], before[x - step]) if x >= step else (0, before[x], 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
        elif kind:
            raise PackingError(f"PNG filter {kind}")
        out[y] = before = line
    return out


def unpack_png(data: bytes, t: dict, n: int) -> np.ndarray:
    """Grey of 8 or 16 bits, or the octets of colours with or without alpha as 24 or 32."""
    check_count(n)
    s = scale_of(t)
    if s.bits == 0:
        return np.full(n, s.reference)
    if data[:8] != MAGIC:
        raise PackingError("no PNG")
    at, head, body = 8, None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    if head is None or head[6]:
        raise PackingError("PNG without a header, or interlaced")
    width, height, depth, colour = head[:4]
    per = {(0, 8): 1, (0, 16): 2, (2, 8): 3, (6, 8): 4}.get((colour, depth))
    if per is None or per * 8 != -(-s.bits // 8) * 8 or width * height < n:
        raise PackingError("the PNG does not fit the field")
    try:
        flat = _unfiltered(zlib.decompress(body), height, width * per, per)
    except (zlib.error, ValueError) as e:
        raise PackingError(f"damaged PNG: {e}") from None
    x = np.zeros(width * height, np.int64)
    for k in range(per):
        x = (x << 8) | flat.reshape(-1, per)[:, k]
    return s.values(x[:n])


def pack_png(values: np.ndarray, bits: int, width: int, height: int) -> tuple[bytes, dict]:
    if width * height < len(values):
        raise PackingError("the image is smaller than the field")
    s = choose(values, bits, 16)
    if not s.bits:
        return b"", template(s)
    per = 1 if s.bits <= 8 else 2
    x = np.zeros(width * height, np.int64)
    x[: len(values)] = s.integers(values)
    rows = np.zeros((height, 1 + width * per), np.uint8)
    rows[:, 1:] = x.astype(">u1" if per == 1 else ">u2").reshape(height, width).view(np.uint8).reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8 * per, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b""), template(s)


# ---- CCSDS


def unpack_ccsds(data: bytes, t: dict, n: int) -> np.ndarray:
    """No bits: the reference. Bits but no octets: the reference with the decimal scale."""
    check_count(n)
    s = scale_of(t)
    if s.bits > 32:
        raise PackingError(f"{s.bits} bits per value")
    if s.bits == 0:
        return np.full(n, s.reference)
    if not data:
        return np.full(n, s.reference * 10.0**-s.decimal)
    return s.values(aec.decode(data, n, s.bits, int(t["block"]), int(t["rsi"]), int(t["flags"])))


def pack_ccsds(values: np.ndarray, bits: int, block: int = 32, rsi: int = 128) -> tuple[bytes, dict]:
    if block not in (8, 16, 32, 64) or not 1 <= rsi <= 4096:
        raise PackingError("block size or interval of reference samples out of range")
    s = choose(values, bits, 32)
    more = {"flags": aec.MSB | aec.PREPROCESS, "block": block, "rsi": rsi}
    return (aec.encode(s.integers(values), s.bits, block, rsi, more["flags"]) if s.bits else b""), template(s, **more)


# ---- JPEG 2000


def unpack_jpeg2000(data: bytes, t: dict, n: int) -> np.ndarray:
    """No bits: the reference as it is."""
    check_count(n)
    s = scale_of(t)
    if s.bits == 0:
        return np.full(n, s.reference)
    if not data:
        raise PackingError("no octets for a field that varies")
    x = j2k.decode(data).ravel()
    if len(x) < n:
        raise PackingError("the image is smaller than the field")
    return s.values(x[:n])


def pack_jpeg2000(values: np.ndarray, bits: int) -> tuple[bytes, dict]:
    """The field as one row. A constant field's reference is the nearest single-precision number."""
    s = choose(values, bits, 30)
    more = {"compression": 0, "ratio": 255}
    if not s.bits:
        return b"", template(Scale(float(np.float32(values[0]))) if len(values) else s, **more)
    return j2k.encode(s.integers(values).reshape(1, -1), s.bits), template(s, **more)


UNPACK = {0: unpack_simple, 2: unpack_complex, 3: unpack_complex, 4: unpack_ieee, 40: unpack_jpeg2000, 41: unpack_png, 42: unpack_ccsds, 200: unpack_run_length}


def unpack(number: int, data: bytes, t: dict, n: int, substitute: bool = False) -> np.ndarray:
    """The values of a data section by its template number. With ``substitute`` missing points of complex packing have the values that stand for them there."""
    number = {40000: 40, 41000: 41}.get(number, number)
    if number not in UNPACK:
        raise PackingError(f"data representation template {number} is not supported")
    return unpack_complex(data, t, n, True) if substitute and number in (2, 3) else UNPACK[number](data, t, n)
