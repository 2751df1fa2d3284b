"""Codecs by round trips, and against plain definitions."""

import numpy as np
import pytest

from isobar.codecs import aec
from isobar.codecs import packings as p
from isobar.codecs.bitio import packed, put, take
from isobar.codecs.scaling import PackingError, choose, single_at_or_below

RNG = np.random.default_rng(11)
SHAPES = {
    "smooth": np.sin(np.arange(1000) / 30) * 20 + 273, "steps": np.repeat(RNG.integers(0, 9, 60), 17).astype(float), "noise": RNG.normal(0, 1e5, 777), "tiny": np.array([1.0, 1.0 + 1e-9, 1.0 - 1e-9]),
    "two": np.array([-5.0, 3.0]), "zeros then one": np.concatenate([np.zeros(5000), [1.0]]), "negative": -np.exp(np.arange(100) / 9),
}


def test_bits():
    assert [int(take(b"\xab\xcd", 1, w, o)[0]) for o, w in ((0, 8), (8, 8), (0, 4), (4, 4), (0, 16), (4, 8))] == [0xAB, 0xCD, 0xA, 0xB, 0xABCD, 0xBC]
    assert take(b"\xff", 2, 8).tolist() == [255, 0]
    for w in range(1, 64):
        x = RNG.integers(0, 1 << w, 50)
        assert (take(packed(put(x, w)), 50, w) == x).all()


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("bits", [1, 7, 8, 12, 16, 23, 32])
def test_round_trips_within_half_a_step(name, bits):
    v = SHAPES[name]
    half = 0.5 * 2.0 ** choose(v, bits, 63).binary * (1 + 1e-9)
    for data, t, f in [(*p.pack_simple(v, bits), p.unpack_simple), (*p.pack_ccsds(v, bits, 16, 7), p.unpack_ccsds)]:
        assert t["reference"] <= v.min()
        assert np.abs(f(data, t, len(v)) - v).max() <= half
    if bits <= 16:
        data, t = p.pack_png(v, bits, len(v), 1)
        assert np.abs(p.unpack_png(data, t, len(v)) - v).max() <= half
    half = 0.5 * 2.0 ** choose(v, min(bits, 23), 63).binary * (1 + 1e-9)
    for order in (0, 1, 2):
        data, t = p.pack_complex(v, bits, order)
        assert np.abs(p.unpack_complex(data, t, len(v)) - v).max() <= half, order


@pytest.mark.parametrize("order", [0, 1, 2])
def test_complex_with_missing_points(order):
    for name, v in SHAPES.items():
        for share in (0.1, 0.9, 1.0):
            w = v.copy()
            w[RNG.random(len(w)) < share] = np.nan
            data, t = p.pack_complex(w, 12, order)
            got = p.unpack_complex(data, t, len(w))
            assert (np.isnan(got) == np.isnan(w)).all(), (name, share)
            if not np.isnan(w).all():
                half = 0.5 * 2.0 ** choose(w, 12, 63, True).binary * (1 + 1e-9)
                assert np.nanmax(np.abs(got - w)) <= half


def test_constants_and_quirks():
    t = {"reference": 5.0, "binary_scale": 0, "decimal_scale": 1, "bits": 0}
    assert p.unpack_simple(b"", t, 3).tolist() == [5.0] * 3 and p.unpack_ccsds(b"", t, 2).tolist() == [5.0] * 2 and p.unpack_png(b"", t, 1).tolist() == [5.0]
    assert p.unpack_complex(b"", {**t, "groups": 0}, 2).tolist() == [0.5, 0.5]
    assert p.unpack_ccsds(b"", {**t, "bits": 8}, 2).tolist() == [0.5, 0.5]
    for bad in (lambda: p.unpack_simple(b"", {**t, "bits": 64}, 1), lambda: p.unpack_simple(b"a", {**t, "bits": 16}, 1), lambda: p.pack_simple([np.inf, 1], 8), lambda: p.pack_simple([1, 2], 0), lambda: p.unpack(61, b"", t, 1), lambda: p.unpack_ieee(b"", {"precision": 3}, 1)):
        with pytest.raises(PackingError):
            bad()
    assert single_at_or_below(0.1) <= 0.1 < float(np.nextafter(np.float32(single_at_or_below(0.1)), np.float32(1)))


def test_missing_management():
    # Two groups: widths 2 and 0, references 10 and all ones.
    t = {"reference": 0.0, "binary_scale": 0, "decimal_scale": 0, "bits": 8, "groups": 2, "missing": 2, "primary": 0xBF800000, "secondary": 0xC0000000, "width_reference": 0, "width_bits": 2, "length_reference": 4, "length_step": 1, "last_length": 2, "length_bits": 0}
    data = bytes([10, 255, 0b10000000, 0b00011011])
    assert str(p.unpack_complex(data, t, 6).tolist()) == "[10.0, 11.0, nan, nan, nan, nan]"
    assert p.unpack_complex(data, t, 6, substitute=True).tolist() == [10.0, 11.0, -2.0, -1.0, -1.0, -1.0]


def test_run_length():
    # Four bits, levels up to 3: base 12. Level 2 five times, missing once, level 1 thirteen times.
    t = {"bits": 4, "max_level": 3, "decimal_scale": 1, "levels": [10, 20, 30]}
    data = packed(put(np.array([2, 8, 0, 1, 4, 5, 3, 3]), 4))
    got = p.unpack_run_length(data, t, 21)
    assert str(got.tolist()) == str([2.0] * 5 + [float("nan")] + [1.0] * 13 + [3.0] * 2)
    with pytest.raises(PackingError):
        p.unpack_run_length(data, t, 19)
    assert np.isnan(p.unpack_run_length(b"", t, 3)).all()


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 8, 9, 16, 17, 24, 32])
@pytest.mark.parametrize("flags", [0, aec.PREPROCESS, aec.PREPROCESS | aec.MSB | aec.PAD, aec.PREPROCESS | aec.SIGNED, aec.RESTRICTED | aec.PREPROCESS])
def test_entropy_coding(bits, flags):
    low, high = aec.limits(bits, flags)
    for x in (RNG.integers(low, high, 500, endpoint=True), np.zeros(9000, np.int64), np.clip(np.cumsum(RNG.integers(-2, 3, 3000)), low, high), np.repeat(RNG.integers(low, high, 40, endpoint=True), 130), np.array([high]), np.clip(RNG.geometric(0.7, 2000) - 1, low, high)):
        for block, rsi in ((8, 1), (16, 70), (64, 128)):
            if flags & aec.RESTRICTED and bits > 4:
                continue
            data = aec.encode(x, bits, block, rsi, flags)
            assert (aec.decode(data, len(x), bits, block, rsi, flags) == x).all()
    with pytest.raises(aec.AecError):
        aec.decode(b"", 3, bits, 8, 4, flags)


def test_second_extension_pairs():
    assert [aec._pair(m) for m in range(6)] == [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]
