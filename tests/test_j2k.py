"""JPEG 2000 by round trips of every part."""

import numpy as np
import pytest

from isobar.codecs import j2k
from isobar.codecs.packings import PackingError, pack_jpeg2000, unpack_jpeg2000
from isobar.codecs.scaling import choose

RNG = np.random.default_rng(8)


def test_arithmetic_coder():
    for p in (0.02, 0.3, 0.5, 0.97):
        d, cx = (RNG.random(5000) < p).astype(int).tolist(), RNG.integers(0, 19, 5000).tolist()
        e = j2k.Encoder()
        for b, c in zip(d, cx):
            e.bit(c, b)
        m = j2k.Decoder(e.finish())
        assert [m.bit(c) for c in cx] == d


@pytest.mark.parametrize("band", ["LL", "HL", "LH", "HH"])
def test_blocks(band):
    for shape in ((1, 1), (1, 64), (5, 7), (64, 3), (17, 16)):
        v = np.rint(RNG.laplace(0, 9, shape)).astype(np.int64)
        segments, planes, passes = j2k.encode_block(v, band)
        got = j2k.decode_block(segments, shape[1], shape[0], band, planes) if passes else np.zeros(shape, int)
        assert (got == v).all()


@pytest.mark.parametrize("style", [1, 2, 4, 8, 16, 32, 5, 13, 37, 63])
def test_styles(style):
    """Raw passes, contexts set back, passes ended apart, causal contexts, marks of segments, alone and together."""
    for shape, spread in (((1, 9), 5000), ((7, 5), 90_000), ((33, 18), 3000)):
        v = np.rint(RNG.laplace(0, spread, shape)).astype(np.int64)
        segments, planes, passes = j2k.encode_block(v, "HL", style)
        assert (j2k.decode_block(segments, shape[1], shape[0], "HL", planes, style) == v).all() and sum(n for n, _ in segments) == passes
    v = RNG.integers(0, 1 << 14, (20, 30))
    assert (j2k.decode(j2k.encode(v, 14, 2, style)) == v).all()


def marked(stream: bytes, *extra: bytes) -> bytes:
    """A codestream with more markers in its main header."""
    at = stream.index(b"\xff\x90")
    return stream[:at] + b"".join(extra) + stream[at:]


def test_component_parameters_progressions_and_regions():
    v = RNG.integers(0, 256, (40, 37))
    plain = j2k.encode(v, 8, 3)
    cod, qcd = plain.index(b"\xff\x52"), plain.index(b"\xff\x5c")
    n = int.from_bytes(plain[qcd + 2 : qcd + 4], "big")
    # The stream's own parameters made wrong, the component's right.
    coc = b"\xff\x53" + (9).to_bytes(2, "big") + b"\x00\x00" + plain[cod + 9 : cod + 14]
    qcc = b"\xff\x5d" + (n + 1).to_bytes(2, "big") + b"\x00" + plain[qcd + 4 : qcd + 2 + n]
    wrong = bytearray(plain)
    wrong[cod + 10] = 0
    wrong[qcd + 4] = 7 << 5
    assert (j2k.decode(marked(bytes(wrong), coc, qcc)) == v).all()
    with pytest.raises(j2k.J2kError):
        j2k.decode(marked(plain, b"\xff\x60\x00\x03\x00"))
    # Changes of progression over all packets leave their order, for one layer and precinct, by resolution.
    poc = b"\xff\x5f" + (2 + 14).to_bytes(2, "big") + bytes([0, 0, 0, 1, 2, 1, 1, 2, 0, 0, 1, 4, 1, 3])
    assert (j2k.decode(marked(plain, poc)) == v).all()
    # A raised region: all values lie above the shift, so all are brought down.
    tile = j2k.Tile((0, 0, 4, 4), {"levels": 0, "xcb": 6, "ycb": 6, "style": 0, "precincts": [(15, 15)], "layers": 1, "progression": 0, "sop": False, "eph": False}, {"guard": 2, "exponents": [8]}, [], 5)
    assert tile.resolutions[0]["bands"][0]["planes"] == 14 and tile._raised(np.array([-96, 31, 64, 0])).tolist() == [-3, 31, 2, 0]


def test_changes_of_progression_take_packets_once():
    cod = {"levels": 3, "xcb": 2, "ycb": 2, "style": 0, "precincts": [(3, 3)] * 4, "layers": 3, "progression": 1, "sop": False, "eph": False}
    parts = [{"progression": 0, "first": 0, "last": 2, "layers": 2}, {"progression": 3, "first": 1, "last": 4, "layers": 3}]
    tile = j2k.Tile((0, 0, 40, 33), cod, {"guard": 2, "exponents": [8] * 10}, parts)
    found = tile.packets()
    assert len(found) == len(set(found)) == len(j2k.Tile((0, 0, 40, 33), cod, {"guard": 2, "exponents": [8] * 10}).packets())
    head = [p for p in found if p[1] < 2 and p[0] < 2]
    assert found[: len(head)] == sorted(head)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9])
def test_wavelet(n):
    x = RNG.integers(-99, 99, (n, 4))
    low, high = j2k.forward_5_3(x, 0)
    assert (j2k.inverse_5_3(low, high, 0, 0) == x).all()


@pytest.mark.parametrize("shape", [(1, 1), (1, 300), (300, 1), (2, 2), (33, 47), (70, 130)])
@pytest.mark.parametrize("bits", [1, 8, 12])
def test_codestreams(shape, bits):
    y, x = np.mgrid[: shape[0], : shape[1]]
    smooth = ((np.sin(y / 9) + np.cos(x / 7) + 2) / 4 * ((1 << bits) - 1)).astype(np.int64)
    for v in (smooth, RNG.integers(0, 1 << bits, shape), np.zeros(shape, np.int64)):
        assert (j2k.decode(j2k.encode(v, bits)) == v).all()


def test_packing():
    v = np.sin(np.arange(500) / 20) * 30
    for bits in (1, 9, 16, 24):
        data, t = pack_jpeg2000(v, bits)
        assert np.abs(unpack_jpeg2000(data, t, 500) - v).max() <= 0.5 * 2.0 ** choose(v, bits, 30).binary * (1 + 1e-9)
    data, t = pack_jpeg2000(np.full(9, 0.1), 12)
    assert data == b"" and unpack_jpeg2000(data, t, 9).tolist() == [float(np.float32(0.1))] * 9
    for bad in (b"", b"no stream", j2k.encode(np.arange(4).reshape(1, 4), 2)[:60]):
        with pytest.raises((PackingError, j2k.J2kError)):
            unpack_jpeg2000(bad, {"reference": 0.0, "binary_scale": 0, "decimal_scale": 0, "bits": 4}, 40)
