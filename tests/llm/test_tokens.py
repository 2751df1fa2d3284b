"""BPE against the library, and token files by exact round trips."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from isobar.llm.bpe import END, WordCodes, _merges, bpe_roundtrip, byte_symbols, speculative_codes  # noqa: E402
from isobar.llm.textarrays import Texts  # noqa: E402
from isobar.llm.tokenfile import pack, read_token_file, unpack, write_token_file  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "don't stop 'S 'RE 'real ''s !'s x'll'd 5's '5 it's", "a'", "'s", "日本語 text’s “quoted” café é", "<|endoftext|> x", "<| y",
    "ΑΣ ας ΟΔΟΣ İx", "123 4½ ²", "a" * 3000, "ab" * 999 + " " + "!" * 500, "naïve ÀÉÎ Ÿ ſ ǅ", " 's 't", "she's-'ve", "\x00a\x1fb\x7f", "x", "x",
    "版权所有，翻印必究。すべての権利を保有する", "สงวนลิขสิทธิ์ทุกประการ", "cafe\u0301 e\u0323\u0302 한국어 \u1112\u1161\u11ab", "good 👍🏽 day 👨‍👩‍👧 ✌️", "हिन्दी में लिखा", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|> <|endoftext", "\U0001d400\u00ad\u200b\ue000x",
    "The and attion to thanedble the, anea.\nEriner thanea. " * 400,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n_tokens string")


def test_roundtrip_equals_library(spark, library):
    got = {r.doc_id: r for r in bpe_roundtrip(frame(spark, enumerate(TEXTS)), PATH, ids=True).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (got[i].ids, got[i].decoded, got[i].n_tokens) == (ids, text, len(ids))
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def doubled(n, swap):
    word = "b" if swap else "a"
    while len(word) < n:
        word = word.replace("a", "x").replace("b", "ba").replace("x", "ab")
    return word


def test_words_that_polynomial_hashes_confuse(spark, library):
    """Words of two letters that double by a to ab and b to ba have one hash under every polynomial modulo 2^64."""
    rows = [(10 * n + s, doubled(n, s)) for n in (1024, 2048, 4096) for s in (0, 1)]
    for r in bpe_roundtrip(frame(spark, rows).coalesce(1), PATH, ids=True).collect():
        assert r.ids == library.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids


def test_forgetting_words_changes_nothing(spark, library, monkeypatch):
    from isobar.llm import bpe

    codes = WordCodes(bpe._splitter(PATH), lambda words: bpe._merges(PATH).encode_words(words)[0])
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    rng = np.random.default_rng(2)
    for k in range(30):
        words = ["".join(rng.choice(list("thean"), rng.integers(1, 5))) for _ in range(60)] + ["the"] * 9
        codes.forget()
        assert codes.n <= 40 or k == 0
        low, start, end, _ = codes.splitter(Texts(pa.array([" ".join(words)])))
        assert codes.ids(codes.rows(low, start, end))[0].tolist() == library.encode(" ".join(words), add_special_tokens=False).ids
    assert b"the" in codes.row


def test_words_of_any_width_are_told_apart(spark, library):
    """Latin-1 words, wider ones and private characters in one worker's memory, met in chunks of either kind."""
    texts = ["a\x00\x00\x00 a", "b \u0101", "a a\x00\x00\x00 \u2019s x\ue000 x", "x", "é \xe9\u0301 e\u0301", "ÿ \u0178"]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    for r in bpe_roundtrip(frame(spark, rows).repartition(1), PATH, ids=True).collect():
        assert r.ids == library.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids


def test_texts_of_any_script_go_through_guess_and_check(spark):
    codes, calls = speculative_codes(PATH), []
    encode = codes.encode
    codes.clear()
    codes.encode = lambda words: calls.append(len(words)) or encode(words)
    split = codes.splitter
    assert codes.rows_of(split.words("हिन्दी <|endoftext|> é")).tolist() and sum(calls) >= 2
    low, start, end, safe = split(Texts(pa.array(["日本語 👍 text", "हिन्दी", None])))
    assert safe.tolist() == [True, False, True] and [low[a:b].tobytes().decode("utf-32-le") for a, b in zip(start, end)][:3] == ["日本語", "👍", "text"]


def test_every_check_agrees_with_exact_merging():
    merges, rng = _merges(PATH), np.random.default_rng(5)
    tokens = sorted(t for t in merges.vocab if t.isascii())
    words = ["".join(rng.choice(tokens, rng.integers(1, 4))).replace(END, "") + END for _ in range(4000)]
    words = [w for w in words if len(w) > 1]
    found, failed = merges.encode_words(words)
    assert 0 < failed < len(words)
    assert found == [merges.merge(w) for w in words]


def test_long_words_merge_alike():
    merges = _merges(PATH)
    rng = np.random.default_rng(1)
    for _ in range(40):
        ids = [merges.vocab[c] for c in rng.choice(list("theinsa"), 23)]
        short = merges.merge("".join(merges.content[i] for i in ids))
        assert short == merges._merge_long(ids)


def test_byte_symbols_are_distinct():
    assert len(set(byte_symbols().values())) == 256


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 300, 49_408, 2**32):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        ids[::50] = 2**32 - 1
        blocks, offsets = pack(ids)
        assert (unpack(blocks, offsets, n) == ids).all()
        assert len(offsets) == 4 * -(-n // 128)


def test_token_file(spark, library, tmp_path):
    rows = [*enumerate(TEXTS), (5, "again five"), (None, "no id")]
    write_token_file(frame(spark, rows), str(tmp_path / "t"), PATH, end_id=1, partitions=3)
    got = sorted(read_token_file(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in got] == sorted(-1 if i is None else i for i, _ in rows)
    want = sorted((i or -1 if i is None else i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens


def test_empty_tables(spark, tmp_path):
    none = frame(spark, [])
    assert bpe_roundtrip(none, PATH).count() == 0
    write_token_file(none, str(tmp_path / "e"), PATH, end_id=1)
    assert read_token_file(spark, str(tmp_path / "e")).count() == 0
