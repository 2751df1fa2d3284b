"""Hashes of ranges."""

import numpy as np

from isobar.llm.textarrays import range_hashes


def thue_morse(n):
    return np.array([bin(i).count("1") & 1 for i in range(n)], np.uint32) + 97


def test_doubling_strings_differ():
    for n in (512, 1024, 2048, 1 << 16):
        a, at = thue_morse(n), np.array([0, n])
        both = np.concatenate([a, 195 - a])
        for seed in (0, 1):
            h = range_hashes(both, at, at + n, seed)
            assert h[0] != h[1]


def test_same_content_hashes_alike_anywhere():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 9, 63, 64, 65, 513, 5000):
        own = rng.integers(0, 0x110000, n).astype(np.uint32)
        text = np.concatenate([rng.integers(0, 99, 13).astype(np.uint32), own, [5], own])
        start = np.array([13, 14 + n, 0, 13])
        h = range_hashes(text, start, np.array([13 + n, 14 + 2 * n, 3, 13 + n]))
        assert h[0] == h[1] == h[3] and h[0] != h[2]
        assert range_hashes(own, np.array([0]), np.array([n]))[0] == h[0]
        assert range_hashes(own, np.array([0]), np.array([n]), 1)[0] != h[0]


def test_no_two_of_many_collide():
    rng = np.random.default_rng(4)
    symbols = rng.integers(97, 99, 200_000).astype(np.uint32)
    start = rng.integers(0, 190_000, 60_000)
    end = start + rng.integers(0, 40, 60_000)
    h = range_hashes(symbols, start, end)
    contents = {}
    for x, a, b in zip(h.tolist(), start.tolist(), end.tolist()):
        assert contents.setdefault(x, symbols[a:b].tobytes()) == symbols[a:b].tobytes()
    assert len(contents) == len({symbols[a:b].tobytes() for a, b in zip(start, end)})
