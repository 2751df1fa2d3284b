"""BPE encoding and decoding: speculate and verify.

The words of a text are encoded apart from each other, so each distinct word is encoded once per worker. A word's
tokens are first guessed by greedy longest match. A sequence of tokens is what merging yields exactly when every
adjacent pair of it is, so the guesses are verified by checks of adjacent pairs, vectorised over all words at once.
Only words with a failing pair are merged step by step.

The vocabulary file is one of the ``tokenizers`` library: BPE with an end-of-word suffix over byte-level symbols,
after NFC, white space and lower-case normalisation. How single characters are normalised and split is asked of the library
itself, once for every character met. A text in which characters may combine, or with the string of a special token, is normalised and split by the library; its
words are then encoded as all others.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from isobar.llm.textarrays import Texts, chunks, release, runs

LETTER, DIGIT, OTHER, SPACE, UNSAFE, UNMET = 0, 1, 2, 3, 4, 5
#: Distinct words that a worker remembers before it forgets the rare ones, and octets of them for each; bounds its memory.
REMEMBERED, OCTETS_EACH = 80_000, 64
#: The contractions that the pre-tokenizer splits off, in the order in which it tries them.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Stands for the end-of-word suffix within a word; no byte-level symbol.
END = "\ue000"
#: Below so many symbols the plain scan merges faster than the heap.
SHORT = 24


@lru_cache(maxsize=1)
def byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Splitter:
    """Finds the words of texts as the tokenizer's normaliser and pre-tokenizer do."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = np.full(0x110000, UNMET, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.special = {a.content: i for i, a in self.tok.get_added_tokens_decoder().items()}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def probe(self, c: int) -> None:
        """Asks the library what it does with one character."""
        pre, norm, ch = self.tok.pre_tokenizer, self.tok.normalizer, chr(c)
        self.kind[c] = UNSAFE
        kind = unicodedata.category(ch)
        if kind[0] == "M" or kind in ("Cn", "Cs") or 0x1100 <= c <= 0x11FF:  # may compose with what stands before
            return
        low = norm.normalize_str(ch)
        if low == " ":
            self.kind[c], self.lower[c] = SPACE, 0x20
        elif len(low) == 1 and ch.lower() == low and unicodedata.normalize("NFC", ch) == ch:
            n, twice = len(pre.pre_tokenize_str(f"x{low}x")), len(pre.pre_tokenize_str(f"{low}{low}"))
            self.kind[c] = LETTER if n == 1 else SPACE if twice == 0 else DIGIT if n == 3 and twice == 2 else OTHER if n == 3 and twice == 1 else UNSAFE
            self.lower[c] = ord(low)

    def words(self, text: str) -> list[str | int]:
        """The words of any text in byte-level symbols with ``END``, by the library; ids of special tokens stand as numbers."""
        out: list[str | int] = []
        for piece in self.special_pattern.split(text) if self.special_pattern else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out += [w + END for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(piece))]
        return out

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased code points, starts and ends of words, and which texts are safe; the words of others mean nothing."""
        cp = texts.cp
        kind = self.kind[cp]
        if (unmet := kind == UNMET).any():
            for c in np.unique(cp[unmet]).tolist():
                self.probe(c)
            kind = self.kind[cp]
        low = self.lower[cp]
        bad = kind == UNSAFE
        bad[:-1] |= (texts.cp[:-1] == 0x3C) & (texts.cp[1:] == 0x7C)  # "<|" begins the special tokens
        safe = np.ones(len(texts), bool)
        if bad.any():
            safe[texts.doc_of(np.flatnonzero(bad))] = False
        # A word starts where the kind changes, and at every digit.
        starts, ends = [], []
        for k in (LETTER, OTHER):
            s, e = runs(kind == k, texts.at)
            if k == LETTER:
                s_l, e_l = s, e
            else:
                s_o, e_o = s, e
        alone = (e_o - s_o == 1) & (low[s_o] == 0x27)
        if alone.any() and len(s_l):
            follows = np.searchsorted(s_l, s_o[alone])
            ok = (follows < len(s_l)) & (s_l[np.minimum(follows, len(s_l) - 1)] == e_o[alone])
            quote, run = np.flatnonzero(alone)[ok], follows[ok]
            ok = ~np.isin(s_l[run], texts.at)  # the letters are of the same text
            quote, run = quote[ok], run[ok]
            first = low[s_l[run]]
            second = np.where(e_l[run] - s_l[run] > 1, low[np.minimum(s_l[run] + 1, len(low) - 1)], 0)
            take = np.zeros(len(run), np.int64)
            for c in reversed(CONTRACTIONS):
                hit = (first == ord(c[0])) & ((second == ord(c[1])) if len(c) == 2 else True)
                take[hit] = len(c)
            e_o = e_o.copy()
            s_l = s_l.copy()
            e_o[quote] += take
            s_l[run] += take
        digits = np.flatnonzero(kind == DIGIT)
        starts, ends = np.concatenate([s_l, s_o, digits]), np.concatenate([e_l, e_o, digits + 1])
        full = ends > starts
        starts, ends = starts[full], ends[full]
        order = np.argsort(starts, kind="stable")
        return low, starts[order], ends[order], safe


class Merges:
    """The vocabulary and merges of a file, ready for guesses, checks and exact merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.content = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in file["added_tokens"]}
        mark = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) and t != suffix else t
        self.vocab = {mark(t): i for t, i in model["vocab"].items()}
        n = max(self.content) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([model["vocab"][a] for a, _ in pairs], np.int64)
        right = np.array([model["vocab"][b] for _, b in pairs], np.int64)
        whole = np.array([model["vocab"][a + b] for a, b in pairs], np.int64)
        self.whole = whole.tolist()
        self.pair = {(int(a), int(b)): r for r, (a, b) in reversed(list(enumerate(zip(left, right, strict=True))))}
        # The first merge that makes a token is how it comes about; those of the alphabet come about by none.
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        for r in range(len(pairs) - 1, -1, -1):
            self.rank[whole[r]], self.left[whole[r]], self.right[whole[r]] = r, left[r], right[r]
        keys = np.array([(a << 32) | b for a, b in self.pair], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array(list(self.pair.values()), np.int64)[order]
        # Guesses use only tokens that merging makes of their own string.
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(n, bool)
        sound[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])].tolist():
            sound[i] &= sound[self.left[i]] and sound[self.right[i]]
        self.trie: dict = {}
        for t, i in self.vocab.items():
            if sound[i]:
                node = self.trie
                for symbol in t:
                    node = node.setdefault(symbol, {})
                node[""] = i

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; beyond all ranks where there is none."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves the border between the tokens a and b alone (up to, not with, the merge of rank ``limit``).

        Both tokens are taken apart along the border, the one made last first. A pair met on the way would have been merged
        across the border if its merge ranks before those that made its two neighbours; on the same rank the left one goes first.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        ok = np.ones(len(a), bool)
        before = np.full(len(a), 1 << 39) if limit is None else limit.astype(np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y, top = a[live], b[live], before[live]
            ok[live[self.merge_rank(x, y) < top]] = False
            rx, ry = self.rank[x], self.rank[y]
            going = ok[live] & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[going], x[going], y[going], rx[going], ry[going]
            split_left = rx > ry
            before[live] = np.where(split_left, rx, ry + 1)
            a[live] = np.where(split_left, self.right[x], x)
            b[live] = np.where(split_left, y, self.left[y])
        return ok

    def guess(self, word: str) -> list[int] | None:
        """Greedy longest match; none if it gets stuck. A token never ends between the last symbol and its end mark."""
        out, at, n, root = [], 0, len(word), self.trie
        while at < n:
            node, best, i = root, None, at
            while i < n:
                node = node.get(word[i])
                if node is None:
                    break
                i += 1
                if (token := node.get("")) is not None and i != n - 1:
                    best, end = token, i
            if best is None:
                return None
            out.append(best)
            at = end
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: the lowest rank first, from the left. Symbols outside the vocabulary are dropped."""
        symbols = [*word[:-2], word[-2:]] if word.endswith(END) else [*word]
        ids = [i for s in symbols if (i := self.vocab.get(s)) is not None]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank, whole, none = self.pair, self.whole, len(self.whole)
        ranks = [rank.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            ids[i : i + 2] = [whole[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.pair
        after, back = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = self.whole[r], -1
            after[i] = k = after[j]
            if k < n:
                back[k] = i
                if (q := rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[k]))
            if (h := back[i]) >= 0 and (q := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (q, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """The ids of each word, and how many words needed exact merging. A word is in byte-level symbols with ``END``."""
        guesses = [self.guess(w) for w in words]
        n = np.array([len(g) if g else 0 for g in guesses], np.int64)
        flat = np.array([t for g in guesses if g for t in g], np.int64)
        owner = np.repeat(np.arange(len(words)), n)
        inner = owner[1:] == owner[:-1]
        a, b, of = flat[:-1][inner], flat[1:][inner], owner[1:][inner]
        keys, where = np.unique((a << 32) | b, return_inverse=True)
        fine = self.compatible(keys >> 32, keys & 0xFFFFFFFF)[where]
        failed = np.array([g is None for g in guesses], bool)
        failed[of[~fine]] = True
        for i in np.flatnonzero(failed).tolist():
            guesses[i] = self.merge(words[i])
        return guesses, int(failed.sum())


@lru_cache(maxsize=2)
def _splitter(path: str) -> Splitter:
    return Splitter(path)


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


class WordCodes:
    """Remembered words: row r has the ids ``flat[at[r]:at[r + 1]]``. Rows are found by the word itself: in Latin-1, or as a tuple with its text, or, for words that the library split off, in byte-level symbols."""

    def __init__(self, splitter: Splitter, encode, extra=None, remembered: int | None = None):
        self.splitter, self.encode, self.extra, self.remembered = splitter, encode, extra, remembered
        self.alphabet = "".join([symbol for _, symbol in sorted(byte_symbols().items())])
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes | tuple | str | int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 12, np.int64)
        self.used = np.zeros(1 << 12, np.int64)
        self.n = self.octets = 0
        self.more: list = []

    def forget(self, most: int | None = None) -> None:
        """Where more than ``most`` words are remembered, keeps those met more than once since, at most half; rows given before mean nothing then."""
        most = most or self.remembered or REMEMBERED
        if self.n <= most and self.octets <= OCTETS_EACH * most:
            return
        words, used = list(self.row), self.used[: self.n]
        often = np.argsort(-used, kind="stable")[: most // 2]
        often = often[used[often] > 1]
        sizes = np.array([self._octets(words[i]) for i in often.tolist()], np.int64)
        keep = np.sort(often[np.cumsum(sizes) <= OCTETS_EACH * most // 2])
        flat, begin = self.ids(keep)
        more = [self.more[i] for i in keep.tolist()] if self.extra else []
        used = used[keep]
        words = [words[i] for i in keep.tolist()]
        self.clear()
        self.flat, self.at, self.used = np.concatenate([flat, np.zeros(1 << 16, np.uint32)]), np.concatenate([begin, np.zeros(1 << 12, np.int64)]), np.concatenate([used // 2, np.zeros(1 << 12, np.int64)])
        self.n, self.more, self.row = len(words), more, dict(zip(words, range(len(words)), strict=True))
        self.octets = sum(map(self._octets, words))

    @staticmethod
    def _octets(word: bytes | tuple | str | int) -> int:
        return 8 if isinstance(word, int) else len(word) if not isinstance(word, tuple) else 4 * len(word[0])

    def _spelled(self, word: bytes | tuple | str) -> str:
        """A word's byte-level symbols with ``END``; printable ASCII stands for itself."""
        if isinstance(word, str):
            return word
        text = word.decode("latin-1") if isinstance(word, bytes) else word[0]
        if not (text.isascii() and text.isprintable()):
            text = codecs.charmap_decode(text.encode(), "strict", self.alphabet)[0]
        return text + END

    def rows(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The row of each word; words not met before are encoded together."""
        if not len(start):
            return np.zeros(0, np.int64)
        offset = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=offset[1:])
        # Words end to end; they don't overlap, so where they are is told by their bounds.
        edge = np.zeros(len(low) + 1, np.int8)
        edge[start] += 1
        edge[end] -= 1
        own = low[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
        narrow = own.max() < 256
        data, width = (own.astype(np.uint8), 1) if narrow else (own.astype("<u4", copy=False), 4)
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(width * offset), pa.py_buffer(data)]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if not narrow:
            texts = [w.decode("utf-32-le") for w in words]
            words = [t.encode("latin-1") if t.isascii() or max(t) < "\u0100" else (t,) for t in texts]
        rows = self.rows_of(words)[coded.indices.to_numpy()]
        self.used[: self.n] += np.bincount(rows, minlength=self.n)
        return rows

    def rows_of(self, words: list) -> np.ndarray:
        """The row of each of some words. Numbers are ids of special tokens."""
        get = self.row.get
        rows = [get(w, -1) for w in words]
        if -1 in rows:
            new = list(dict.fromkeys([w for w, r in zip(words, rows, strict=True) if r < 0]))
            special = [w for w in new if isinstance(w, int)]
            plain = [w for w in new if not isinstance(w, int)]
            self.add(plain + special, [*self.encode([self._spelled(w) for w in plain]), *([w] for w in special)])
            rows = [r if r >= 0 else get(w) for w, r in zip(words, rows, strict=True)]
        return np.array(rows, np.int64)

    def add(self, words: list, ids: list[list[int]]) -> None:
        lengths = np.array([len(x) for x in ids], np.int64)
        used, more = int(self.at[self.n]), int(lengths.sum())
        while used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(ids) + 1 > len(self.at):
            self.at, self.used = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.used, np.zeros_like(self.used)])
        self.flat[used : used + more] = [t for x in ids for t in x]
        self.at[self.n + 1 : self.n + len(ids) + 1] = used + np.cumsum(lengths)
        if self.extra:
            self.more.extend(map(self.extra, ids))
        self.row.update(zip(words, range(self.n, self.n + len(ids)), strict=True))
        self.octets += sum(map(self._octets, words))
        self.n += len(ids)

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words end to end, and where each word's begin (one more at the end)."""
        n = self.at[rows + 1] - self.at[rows]
        begin = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(n, out=begin[1:])
        return self.flat[np.repeat(self.at[rows] - begin[:-1], n) + np.arange(begin[-1])], begin


@lru_cache(maxsize=2)
def speculative_codes(path: str) -> WordCodes:
    """Codes by guess and check; each row also has its ids and its tokens as text."""
    merges, content = _merges(path), _merges(path).content
    shown = lambda ids: (" ".join(map(str, ids)), " ".join([content[i] for i in ids]))
    return WordCodes(_splitter(path), lambda words: merges.encode_words(words)[0], shown)


def library_ids(splitter: Splitter, text: str) -> list[int]:
    return splitter.tok.encode(text, add_special_tokens=False).ids


def bpe_roundtrip(documents: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    The words of every text go through guesses, checks and, where a check fails, exact merging; which words a text has the library is asked for only where characters may combine or special tokens stand.

    Returns the columns ``keep`` with ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space) and
    ``decoded_sha256`` (of the decoded text), and with ``ids`` also the arrays of ids and the decoded texts. A null text counts as
    empty: no tokens, and the digests of the empty string. Rows are independent, so repeated rows give repeated results; an empty
    table gives an empty result. ``tokenizer`` is the path of the vocabulary file, the same on every executor. Other columns,
    whatever their names, are not read. One pass without a shuffle; a worker's memory is bounded by ``REMEMBERED`` words of ``OCTETS_EACH`` octets and the
    longest text.
    """
    source = documents.select(*[documents[c].alias(f"k{i}") for i, c in enumerate(keep)], documents[text].cast("string").alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if ids:
        schema = schema.add("ids", T.ArrayType(T.LongType())).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = speculative_codes(tokenizer)
        split = codes.splitter
        for batch in batches:
            for part, texts in chunks(batch):
                low, start, end, safe = split(texts)
                codes.forget()
                rows = codes.rows(low, start, end)
                first = np.searchsorted(start, texts.at)
                # Texts that the library has to split: their words, end to end.
                apart = {i: split.words(texts.cp[texts.at[i] : texts.at[i + 1]].tobytes().decode("utf-32-le", "replace")) for i in np.flatnonzero(~safe).tolist()}
                apart = {i: codes.rows_of(words).tolist() for i, words in apart.items()}
                n_of = codes.at[rows + 1] - codes.at[rows]
                total = np.concatenate([[0], np.cumsum(n_of)])
                number, digest, decoded, all_ids, all_text = [], [], [], [], []
                for i in range(len(texts)):
                    if safe[i]:
                        mine = rows[first[i] : first[i + 1]].tolist()
                        n = int(total[first[i + 1]] - total[first[i]])
                    else:
                        mine = apart[i]
                        n = int((codes.at[np.array(mine, np.int64) + 1] - codes.at[mine]).sum()) if mine else 0
                    shown = [codes.more[r] for r in mine]
                    # A word of which nothing is in the vocabulary shows nothing.
                    as_ids, as_text = " ".join([x for x, _ in shown if x]), " ".join([y for x, y in shown if x])
                    number.append(n)
                    digest.append(hashlib.sha256(as_ids.encode()).hexdigest())
                    decoded.append(hashlib.sha256(as_text.encode()).hexdigest())
                    if ids:
                        all_ids.append(list(map(int, as_ids.split())))
                        all_text.append(as_text)
                columns = [*part.columns[:-1], pa.array(number, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
                if ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(all_text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
        # A worker outlives its task, and other operators need the room.
        codes.forget(REMEMBERED // 4)
        release()

    out = source.mapInArrow(run, schema)
    return out.toDF(*keep, *schema.fieldNames()[len(keep) :])
