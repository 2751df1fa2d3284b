"""Bytes to messages and fields, and back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from isobar.sources import layout

MAGIC, END = b"GRIB", b"7777"
#: The most octets of a section.
MOST_OCTETS = 256 << 20


class MessageError(ValueError):
    """A message that is cut short, damaged or of another edition."""


@dataclass
class FieldSections:
    """The sections of one field. ``grid``, ``product`` and ``packing`` are the bodies of sections 3 to 5 without length and number."""

    local: bytes | None
    grid: bytes
    product: bytes
    packing: bytes
    bitmap_indicator: int
    bitmap: bytes
    data: bytes
    shares_grid: bool = False
    #: Whether the local section stands right before this field's grid, not at the beginning of the message.
    own_local: bool = False
    #: The bit map that applies, if any; for indicator 254 the one before.
    effective: bytes | None = None


@dataclass
class Message:
    discipline: int
    identification: bytes
    reserved: bytes = b"\xff\xff"
    local: bytes | None = None
    fields: list[FieldSections] = field(default_factory=list)


class Octets:
    """Octets in memory, read by ranges."""

    def __init__(self, content: bytes):
        self.content, self.size = content, len(content)

    def read(self, at: int, n: int) -> bytes:
        return self.content[at : at + n]

    def find(self, mark: bytes, at: int) -> int:
        return self.content.find(mark, at)


class Ranges:
    """A file that can be sought, read by ranges; ``octets_read`` counts what was asked for. Small reads are served from windows."""

    WINDOW, SCAN = 4096, 1 << 20

    def __init__(self, file, size: int):
        self.file, self.size, self.octets_read = file, size, 0
        self.start, self.held = 0, b""

    def _fetch(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(max(0, min(n, self.size - at)))
        self.octets_read += len(out)
        return out

    def read(self, at: int, n: int) -> bytes:
        if n > self.WINDOW:
            return self._fetch(at, n)
        if not (self.start <= at and at + n <= self.start + len(self.held)):
            self.start, self.held = at, self._fetch(at, self.WINDOW)
        return self.held[at - self.start : at - self.start + n]

    def find(self, mark: bytes, at: int) -> int:
        # Mostly it stands right here, or near.
        window = self.WINDOW
        while at < self.size:
            if self.read(at, len(mark)) == mark:
                return at
            part = self._fetch(at, window)
            window = min(2 * window, self.SCAN)
            k = part.find(mark)
            if k >= 0:
                return at + k
            at += max(len(part) - len(mark) + 1, 1)
        return -1


def find_messages(source: bytes | Octets | Ranges) -> Iterator[tuple[int, int, str | None]]:
    """(offset, length, error) of each message. What lies between messages is passed over; messages of the first edition are skipped with an error."""
    source = Octets(source) if isinstance(source, bytes | bytearray) else source
    at = source.find(MAGIC, 0)
    while at >= 0:
        head = source.read(at, 16)
        if len(head) < 8:
            yield at, source.size - at, "the message is cut short"
            return
        if head[7] != 2:
            n = max(int.from_bytes(head[4:7], "big"), 8)
            yield at, n, f"edition {head[7]}, not 2"
        else:
            n = int.from_bytes(head[8:16], "big") if len(head) == 16 else 1 << 63
            if at + n > source.size:
                # The rest may still hold whole messages.
                yield at, source.size - at, "the message is cut short"
                n = 4
            elif n < 20 or source.read(at + n - 4, 4) != END:
                yield at, n, "the declared length does not lead to an end mark"
                n = 4
            else:
                yield at, n, None
        at = source.find(MAGIC, at + n)


def without_data(source: Octets | Ranges, at: int, n: int) -> bytes:
    """A message whose data sections are empty; their octets are not read."""
    out, place = [source.read(at, 16)], at + 16
    while place < at + n - 4:
        head = source.read(place, 5)
        size = int.from_bytes(head[:4], "big")
        if len(head) < 5 or size < 5 or place + size > at + n - 4:
            raise MessageError("a section's length makes no sense")
        out.append(section(7, b"") if head[4] == 7 else source.read(place, size))
        place += size
    return b"".join([*out, END])


def sections(content: bytes, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    while at < end:
        n = int.from_bytes(content[at : at + 4], "big")
        if at + 5 > end or n < 5 or at + n > end or n - 5 > MOST_OCTETS:
            raise MessageError("a section's length makes no sense")
        yield content[at + 4], content[at + 5 : at + n]
        at += n
    if at != end:
        raise MessageError("the sections do not fill the message")


def parse(content: bytes) -> Message:
    """One whole message. After the first field it may go on from a local section, a grid or a product; a grid holds until the next."""
    parts = list(sections(content, 16, len(content) - 4))
    if not parts or parts[0][0] != 1 or len(parts[0][1]) < 16:
        raise MessageError("the message does not begin with an identification")
    m = Message(content[6], parts[0][1], content[4:6])
    grid, bitmap, local, group = None, None, None, {}
    fresh_grid = False
    expected = {2, 3}
    for number, body in parts[1:]:
        if number not in expected:
            raise MessageError("a product before any grid" if number == 4 and grid is None else f"section {number} is out of place")
        if number == 2:
            local = body
            if not m.fields:
                m.local = body
            expected = {3}
        elif number == 3:
            grid, fresh_grid, expected = body, True, {4}
        elif number < 7:
            group[number], expected = body, {number + 1}
            if number == 6 and not body:
                raise MessageError("an empty bit-map section")
        else:
            indicator = group[6][0]
            if indicator == 0:
                bitmap = group[6][1:]
            effective = bitmap if indicator in (0, 254) else None
            own = bool(m.fields) and local is not None
            m.fields.append(FieldSections(local if own else None, grid, group[4], group[5], indicator, group[6][1:], body, not fresh_grid, own, effective))
            local, fresh_grid, group, expected = None, False, {}, {2, 3, 4}
    if not m.fields or group or expected != {2, 3, 4}:
        raise MessageError("the message ends within a field" if m.fields or grid is not None else "the message has no field")
    return m


def section(number: int, body: bytes) -> bytes:
    if len(body) + 5 >= 1 << 32:
        raise MessageError("a section is too long")
    return (len(body) + 5).to_bytes(4, "big") + bytes([number]) + body


def build(m: Message) -> bytes:
    """The message's octets: what was read is written alike, octet by octet."""
    out = [section(1, m.identification)]
    if m.local is not None:
        out.append(section(2, m.local))
    for i, f in enumerate(m.fields):
        if i and f.own_local:
            out.append(section(2, f.local or b""))
        if i == 0 or not f.shares_grid:
            out.append(section(3, f.grid))
        out += [section(4, f.product), section(5, f.packing), section(6, bytes([f.bitmap_indicator]) + f.bitmap), section(7, f.data)]
    body = b"".join(out)
    return MAGIC + m.reserved + bytes([m.discipline, 2]) + (len(body) + 20).to_bytes(8, "big") + body + END


def grid_of(body: bytes) -> tuple[int, int, dict | None, bytes]:
    """(points, template number, numbers or none, list of points per row) of section 3."""
    if len(body) < 9:
        raise MessageError("the grid section is too short")
    number = int.from_bytes(body[7:9], "big")
    numbers = layout.read_grid(number, body[9:])
    return int.from_bytes(body[1:5], "big"), number, numbers, body[9 + layout.size(layout.GRIDS[number]) :] if numbers is not None else b""


def grid_section(number: int, numbers: dict, points: int, row_points: bytes = b"", octets: int = 0) -> bytes:
    return bytes([0]) + points.to_bytes(4, "big") + bytes([octets, 0]) + number.to_bytes(2, "big") + layout.write(layout.GRIDS[number], numbers) + row_points


def product_of(body: bytes) -> tuple[int, dict | None, bytes]:
    """(template number, numbers or none, octets of vertical coordinates) of section 4; the coordinates are cut off before the template is read."""
    if len(body) < 4:
        raise MessageError("the product section is too short")
    tail = 4 * int.from_bytes(body[:2], "big")
    number = int.from_bytes(body[2:4], "big")
    if len(body) < 4 + tail:
        raise MessageError("too few vertical coordinates")
    inner = body[4 : len(body) - tail]
    return number, layout.read_product(number, inner), body[len(body) - tail :] if tail else b""


def product_section(number: int, numbers: dict, coordinates: bytes = b"") -> bytes:
    return (len(coordinates) // 4).to_bytes(2, "big") + number.to_bytes(2, "big") + layout.write_product(number, numbers) + coordinates


def packing_of(body: bytes) -> tuple[int, int, dict | None]:
    """(values, template number, numbers or none) of section 5."""
    if len(body) < 6:
        raise MessageError("the packing section is too short")
    number = int.from_bytes(body[4:6], "big")
    return int.from_bytes(body[:4], "big"), number, layout.read_packing(number, body[6:])


def packing_section(number: int, numbers: dict, values: int) -> bytes:
    return values.to_bytes(4, "big") + number.to_bytes(2, "big") + layout.write_packing(number, numbers)
