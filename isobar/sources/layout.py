"""Record layouts of sections and templates, and one reader and writer for all of them.

A layout is a list of fields in order: name and kind. Kinds: u8, u16, u32 unsigned; s8, s16, s32 sign and magnitude; f32 IEEE single precision; all big-endian.
"""

from __future__ import annotations

import struct

OCTETS = {"u8": 1, "u16": 2, "u32": 4, "s8": 1, "s16": 2, "s32": 4, "f32": 4}


def layout(text: str) -> list[tuple[str, str]]:
    return [tuple(item.split()) for item in text.replace("\n", " ").split(",") if item.strip()]


def size(fields: list[tuple[str, str]]) -> int:
    return sum(OCTETS[k] for _, k in fields)


def read(fields: list[tuple[str, str]], body: bytes, at: int = 0) -> dict:
    if len(body) - at < size(fields):
        raise ValueError(f"{len(body) - at} octets where {size(fields)} are needed")
    out = {}
    for name, kind in fields:
        n = OCTETS[kind]
        raw = body[at : at + n]
        if kind == "f32":
            out[name] = struct.unpack(">f", raw)[0]
        else:
            v = int.from_bytes(raw, "big")
            top = 1 << (8 * n - 1)
            out[name] = top - v if kind[0] == "s" and v >= top else v
            if kind[0] == "s" and v == top:
                out[name] = 0
        at += n
    return out


def write(fields: list[tuple[str, str]], values: dict) -> bytes:
    out = []
    for name, kind in fields:
        n, v = OCTETS[kind], values[name]
        if kind == "f32":
            out.append(struct.pack(">f", v))
        else:
            v = int(v)
            out.append(((1 << (8 * n - 1)) - v if kind[0] == "s" and v < 0 else v).to_bytes(n, "big"))
    return b"".join(out)


#: The layouts, as the format defines them.
EARTH = "shape u8, radius_scale u8, radius u32, major_scale u8, major u32, minor_scale u8, minor u32,"
LATLON = EARTH + "ni u32, nj u32, basic_angle u32, subdivisions u32, lat1 s32, lon1 s32, flags u8, lat2 s32, lon2 s32, di u32, "
SECTION1 = layout("centre u16, subcentre u16, master_version u8, local_version u8, significance u8, year u16, month u8, day u8, hour u8, minute u8, second u8, status u8, data_type u8")
GRIDS = {
    0: layout(LATLON + "dj u32, scan u8"),
    1: layout(LATLON + "dj u32, scan u8, pole_lat s32, pole_lon s32, angle f32"),
    10: layout(EARTH + "ni u32, nj u32, lat1 s32, lon1 s32, flags u8, lad s32, lat2 s32, lon2 s32, scan u8, orientation u32, di u32, dj u32"),
    20: layout(EARTH + "ni u32, nj u32, lat1 s32, lon1 s32, flags u8, lad s32, orientation s32, di u32, dj u32, centre u8, scan u8"),
    30: layout(EARTH + "ni u32, nj u32, lat1 s32, lon1 s32, flags u8, lad s32, lov s32, di u32, dj u32, centre u8, scan u8, latin1 s32, latin2 s32, pole_lat s32, pole_lon s32"),
    40: layout(LATLON + "gaussian u32, scan u8"),
    90: layout(EARTH + "ni u32, nj u32, lat1 s32, lon1 s32, flags u8, di u32, dj u32, xp u32, yp u32, scan u8, orientation s32, nr u32, xo u32, yo u32"),
}
POINT = "category u8, number u8, process u8, background u8, process_id u8, cutoff_hours u16, cutoff_minutes u8, time_unit u8, forecast_time s32, surface1 u8, surface1_scale s8, surface1_value u32, surface2 u8, surface2_scale s8, surface2_value u32"
INTERVAL = "end_year u16, end_month u8, end_day u8, end_hour u8, end_minute u8, end_second u8, ranges u8, missing u32"
RANGE = layout("process u8, increment_kind u8, range_unit u8, range u32, increment_unit u8, increment u32")
ENSEMBLE, DERIVED = "ensemble u8, perturbation u8, members u8", "derived u8, members u8"
PRODUCTS = {
    0: layout(POINT),
    1: layout(f"{POINT}, {ENSEMBLE}"),
    2: layout(f"{POINT}, {DERIVED}"),
    8: layout(f"{POINT}, {INTERVAL}"),
    11: layout(f"{POINT}, {ENSEMBLE}, {INTERVAL}"),
    12: layout(f"{POINT}, {DERIVED}, {INTERVAL}"),
}
SIMPLE = "reference f32, binary_scale s16, decimal_scale s16, bits u8, original_type u8"
COMPLEX = SIMPLE + ", splitting u8, missing u8, primary u32, secondary u32, groups u32, width_reference u8, width_bits u8, length_reference u32, length_step u8, last_length u32, length_bits u8"
PACKINGS = {
    0: layout(SIMPLE),
    2: layout(COMPLEX),
    3: layout(COMPLEX + ", order u8, extra_octets u8"),
    4: layout("precision u8"),
    40: layout(SIMPLE + ", compression u8, ratio u8"),
    41: layout(SIMPLE),
    42: layout(SIMPLE + ", flags u8, block u8, rsi u16"),
    200: layout("bits u8, max_level u16, level_count u16, decimal_scale u8"),
}
#: Older numbers of templates, and what they mean today.
SAME_PACKING = {40000: 40, 41000: 41}


def read_grid(number: int, body: bytes) -> dict | None:
    """The numbers of a grid definition; none for a template that isn't known."""
    return read(GRIDS[number], body) if number in GRIDS else None


def read_product(number: int, body: bytes) -> dict | None:
    if number not in PRODUCTS:
        return None
    out = read(PRODUCTS[number], body)
    at = size(PRODUCTS[number])
    if "ranges" in out:
        out["time_ranges"] = [read(RANGE, body, at + k * size(RANGE)) for k in range(out["ranges"])]
    return out


def write_product(number: int, values: dict) -> bytes:
    return write(PRODUCTS[number], values) + b"".join(write(RANGE, r) for r in values.get("time_ranges", ()))


def read_packing(number: int, body: bytes) -> dict | None:
    number = SAME_PACKING.get(number, number)
    if number not in PACKINGS:
        return None
    out = read(PACKINGS[number], body)
    if number == 200:
        if len(body) < 6 + 2 * out["level_count"]:
            raise ValueError("too few level values")
        out["levels"] = [int.from_bytes(body[6 + 2 * k : 8 + 2 * k], "big") for k in range(out["level_count"])]
    return out


def write_packing(number: int, values: dict) -> bytes:
    out = write(PACKINGS[number], values)
    return out + b"".join(int(v).to_bytes(2, "big") for v in values["levels"]) if number == 200 else out
