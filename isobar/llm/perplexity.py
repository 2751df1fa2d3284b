"""Quality rules: n-gram perplexity bands beside simple counts.

A modified Kneser-Ney model of ``ORDER`` characters is counted over all documents in Spark. Characters are real ones, with A-Z in lower case, digits alike and white space alike; nothing is hashed into classes, pruned or capped, so the
n-grams and what they cost grow with the corpus. Every document is part of the corpus, and an n-gram that occurs only there would make itself likely; so each occurrence is scored without itself (leave one out), on every level of the
model. Counts of n-grams, of the kinds of characters that follow and precede them, and the probabilities made of them stay tables, joined level by level; to the driver come only the numbers of n-grams that occur once, twice, three and four times,
which give the discounts.

The finished probabilities are scored from sorted arrays of hashes, which each worker holds while they are at most ``MODEL_BYTES`` as counted, else by a join of every text's n-grams with the table, with equal results.
The measure is the negative logarithm of a text's probability per word, as perplexity by characters would let long runs of a predictable symbol hide. Texts whose measure lies outside the band of their language are rejected. A band reaches ``REACH`` interquartile ranges
beyond the quartiles of the logarithm of the measure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.llm.shared import small_or_not, written
from isobar.llm.textarrays import Texts, chunks, counts_by_doc, mix, range_hashes, runs, shingles, sums_by_doc

ORDER = 5
#: Bits of a character in the code of an n-gram: the last three characters stand in ``b``, those before in ``a``. 0 is before a text's beginning.
BITS = 21
MASK = (1 << BITS) - 1
REACH = 3.0
#: Documents that the quartiles of all languages weigh as beside those of a language's own.
SHRINK = 50
#: The most that sorted arrays of the model may take in a worker; a larger model is joined.
MODEL_BYTES = 64 << 20
#: N-grams that a counting task holds before it passes them on, and code points of text that it takes at a time.
HELD, PIECE = 1 << 18, 1 << 18
#: Scripts written without spaces, of which each character counts as a word: from Thai to Lao, Myanmar, Khmer, and CJK, kana, Hangul and what follows.
UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0x3000), (0x3004, 0xFF00), (0xFF10, 0x110000))
#: Steps to which negative logarithms are rounded, so that sums in any order are equal.
STEP = 1 / 1024
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


# ---- n-grams of texts


def gram_codes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The codes (a, b) of the ORDER characters that end at each position."""
    cp = texts.cp.copy()
    cp += ((cp >= 0x41) & (cp <= 0x5A)).astype(np.uint32) << np.uint32(5)
    cp[(cp >= 0x30) & (cp <= 0x39)] = 0x30
    cp[(cp >= 9) & (cp <= 13)] = 0x20
    own = (cp + 1).astype(np.int64)
    place = np.arange(len(own)) - np.repeat(texts.at[:-1], np.diff(texts.at))

    def before(k: int) -> np.ndarray:
        out = np.zeros_like(own)
        out[k:] = own[: len(own) - k]
        out[place < k] = 0
        return out

    b = own | (before(1) << BITS) | (before(2) << 2 * BITS)
    a = np.zeros_like(own)
    for k in range(3, ORDER):
        a |= before(k) << BITS * (k - 3)
    return a, b


def gram_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.view(np.uint64)) + b.view(np.uint64))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, where each stands first, and which one each is."""
    coded = pa.array(h).dictionary_encode()
    which, values = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    first = np.zeros(len(values), np.int64)
    first[which[::-1]] = np.arange(len(h) - 1, -1, -1)
    return values, first, which


GRAMS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def count_grams(rows: DataFrame) -> DataFrame:
    """(a, b, n) over all texts; each task sums up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
            _, first, which = distinct(gram_hashes(a, b))
            return a[first], b[first], np.bincount(which, n, len(first)).astype(np.int64)

        def batch_of(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=GRAMS.fieldNames())

        for batch in batches:
            for _, texts in chunks(batch, most=PIECE):
                a, b = gram_codes(texts)
                _, first, which = distinct(gram_hashes(a, b))
                held.append((a[first], b[first], np.bincount(which, minlength=len(first)).astype(np.int64)))
                if sum(len(x) for x, _, _ in held) > HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield batch_of(*held.pop())
        if held:
            yield batch_of(*merged())

    return rows.select("text").mapInArrow(run, GRAMS).groupBy("a", "b").agg(F.sum("n").alias("n"))


# ---- the model


def _masked(a: Column, b: Column, size: int) -> tuple[Column, Column]:
    """The last ``size`` characters of a code."""
    keep = lambda c, n: c.bitwiseAND(F.lit((1 << BITS * n) - 1)) if n > 0 else F.lit(0).cast("long")
    return keep(a, size - 3), keep(b, min(size, 3))


def _context(a: Column, b: Column) -> tuple[Column, Column]:
    """A code without its last character."""
    return F.shiftright(a, BITS), F.shiftright(b, BITS).bitwiseOR(F.shiftleft(a.bitwiseAND(F.lit(MASK)), 2 * BITS))


def discounts(counts: list[int]) -> list[float]:
    """For counts 0, 1, 2, 3 and more, from how many n-grams have the counts 1 to 4: the estimates of modified Kneser-Ney; where few counts are so small, fixed ones."""
    out = [0.0, 0.5, 0.75, 0.9]
    if min(counts) > 0:
        y = counts[0] / (counts[0] + 2 * counts[1])
        found = [k - (k + 1) * y * counts[k] / counts[k - 1] for k in (1, 2, 3)]
        if all(0 < d < k for k, d in enumerate(found, 1)):
            out[1:] = found
    return out


def probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(a, b, p, q) of (a, b, n): the interpolated probability of each n-gram's last character after the others, and the same with one occurrence left out. N-grams with n = 0 were not counted, but are wanted.

    The levels below count kinds, not occurrences: how many different characters stand before an n-gram. Leaving out the only occurrence of an n-gram takes one such kind away below it.
    """
    levels = {order: grams}
    for size in range(order - 1, 0, -1):
        a, b = _masked(F.col("a"), F.col("b"), size)
        above = levels[size + 1].select(a.alias("a"), b.alias("b"), (F.col("n") > 0).cast("long").alias("n"))
        levels[size] = written(above.groupBy("a", "b").agg(F.sum("n").alias("n")))
    lower = None
    for size in range(1, order + 1):
        n = F.col("n")
        number = lambda k: F.coalesce(F.sum((n == k).cast("long")), F.lit(0))
        found = levels[size].agg(*[number(k) for k in (1, 2, 3, 4)], F.coalesce(F.sum("n"), F.lit(0)), F.sum((n > 2).cast("long")), F.sum((n > 0).cast("long"))).first()
        d = discounts(list(found[:4]))
        if size == 1:
            # All characters have one context, and below them all are as likely.
            total, kinds = F.lit(found[4]), [F.lit(found[0]), F.lit(found[1]), F.lit(found[5] or 0)]
            rows = levels[1].withColumns({"total": total, "k1": kinds[0], "k2": kinds[1], "k3": kinds[2], "lp": F.lit(1 / ((found[6] or 0) + 1)), "lq": F.lit(1 / ((found[6] or 0) + 1))})
        else:
            ca, cb = _context(F.col("a"), F.col("b"))
            w = Window.partitionBy("ca", "cb")
            rows = levels[size].withColumns({"ca": ca, "cb": cb}).withColumns({"total": F.sum("n").over(w), "k1": F.sum((n == 1).cast("long")).over(w), "k2": F.sum((n == 2).cast("long")).over(w), "k3": F.sum((n > 2).cast("long")).over(w)}).drop("ca", "cb")
            sa, sb = _masked(F.col("a"), F.col("b"), size - 1)
            below = lower.select(F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("p").alias("lp"), F.col("q").alias("lq"))
            rows = rows.withColumns({"sa": sa, "sb": sb}).join(below.hint("merge"), ["sa", "sb"]).drop("sa", "sb")
        off = lambda c: F.when(c >= 3, d[3]).when(c == 2, d[2]).when(c == 1, d[1]).otherwise(0.0)
        spread = lambda k1, k2, k3: d[1] * k1 + d[2] * k2 + d[3] * k3
        one, two, three = ((n == k).cast("long") for k in (1, 2, 3))
        p = F.when(F.col("total") > 0, (n - off(n)) / F.col("total") + spread(F.col("k1"), F.col("k2"), F.col("k3")) / F.col("total") * F.col("lp")).otherwise(F.col("lp"))
        low = F.when(n == 1, F.col("lq")).otherwise(F.col("lp"))
        left = (n - 1 - off(n - 1)) / (F.col("total") - 1) + spread(F.col("k1") - one + two, F.col("k2") - two + three, F.col("k3") - three) / (F.col("total") - 1) * low
        q = F.when(n == 0, F.col("p")).when(F.col("total") > 1, left).otherwise(low)
        lower = written(rows.withColumn("p", p).withColumn("q", q).select("a", "b", "p", "q"))
    return lower


@dataclass(frozen=True)
class Model:
    """The counted n-grams as a written table (a, b, n), and what they were counted in."""

    source: DataFrame
    text: str
    grams: DataFrame


def _texts(documents: DataFrame, text: str) -> DataFrame:
    return documents.select(documents[text].cast("string").alias("text"))


def fit(documents: DataFrame, text: str = "text") -> Model:
    """The n-grams of all texts, counted."""
    return Model(documents, text, written(count_grams(_texts(documents, text))))


def steps(model: Model, documents: DataFrame, text: str) -> DataFrame:
    """(a, b, s): for each n-gram of the documents the steps of the negative logarithm of its probability, one occurrence left out. Those that were not counted have probabilities too."""
    grams = model.grams
    if documents is not model.source or text != model.text:
        wanted = count_grams(_texts(documents, text)).select("a", "b", F.lit(0).cast("long").alias("n"))
        grams = written(grams.unionByName(wanted).groupBy("a", "b").agg(F.sum("n").alias("n")))
    return written(probabilities(grams).select("a", "b", F.round(-F.log("q") / STEP).cast("long").alias("s")))


def sorted_arrays(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams in order, and their steps. The caller has checked the size."""
    schema = T.StructType([T.StructField("hashes", T.BinaryType()), T.StructField("steps", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = gram_hashes(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()], pa.binary()), pa.array([batch.column(2).to_numpy().astype(np.int32).tobytes()], pa.binary())], names=schema.fieldNames())

    found = table.select("a", "b", "s").mapInArrow(run, schema).toArrow()
    hashes = np.frombuffer(b"".join(found.column("hashes").to_pylist()), np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.frombuffer(b"".join(found.column("steps").to_pylist()), np.int32)[order]


# ---- counts of the simple rules


def within(cp: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    out = np.zeros(len(cp), bool)
    for low, high in ranges:
        out |= (cp >= low) & (cp < high)
    return out


def spoken_words(texts: Texts) -> np.ndarray:
    """Words of each text, where each character of an unspaced script is one."""
    cp = texts.cp
    space = (cp == 0x20) | ((cp >= 9) & (cp <= 13))
    alone = within(cp, UNSPACED)
    start, _ = runs(~space & ~alone, texts.at)
    return counts_by_doc(texts.doc_of(start), len(texts)) + sums_by_doc(alone.astype(np.int64), texts.at)


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """The counts of the simple rules for each text."""
    cp, n = texts.cp, len(texts)
    space = (cp == 0x20) | ((cp >= 9) & (cp <= 13))
    start, end = runs(~space, texts.at)
    doc = texts.doc_of(start)
    first = np.searchsorted(start, texts.at)
    words = range_hashes(cp, start, end)
    n_words = counts_by_doc(doc, n)
    # Words within windows of three that occur twice in the text.
    windows, of = shingles(words, first, 3)
    whole = n_words[of] >= 3
    windows, of = windows[whole], of[whole]
    begin = first[:-1][of] + np.arange(len(of)) - np.searchsorted(of, of)
    _, where, count = np.unique(mix(windows ^ mix(of.astype(np.uint64))), return_inverse=True, return_counts=True)
    again = begin[count[where] > 1]
    covered = np.zeros(len(words) + 3, bool)
    for k in range(3):
        covered[again + k] = True
    # Lines with a word that equal an earlier one.
    newline = np.flatnonzero(cp == 10)
    line_start = np.sort(np.concatenate([texts.at[:-1], newline + 1]))
    of_line = np.sort(np.concatenate([np.arange(n), texts.doc_of(newline)]))
    line_end = np.append(line_start[1:] - 1, len(cp))
    last = np.append(of_line[1:] != of_line[:-1], True) if n else np.zeros(0, bool)
    line_end[last] = texts.at[1:]
    worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    lines, of_line = range_hashes(cp, line_start[worded], line_end[worded]), of_line[worded]
    _, once = np.unique(mix(lines ^ mix(of_line.astype(np.uint64))), return_index=True)
    return {
        "n_words": n_words,
        "word_chars": sums_by_doc((~space).astype(np.int64), texts.at),
        "n_symbols": sums_by_doc(np.isin(cp, np.array([ord(c) for c in SYMBOLS], np.uint32)).astype(np.int64), texts.at),
        "n_dup_lines": counts_by_doc(of_line, n) - counts_by_doc(of_line[once], n),
        "n_repeat_words": sums_by_doc(covered[: len(words)].astype(np.int64), first),
    }


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(rows: DataFrame, arrays: Broadcast | None) -> DataFrame:
    """Adds the counts, ``spoken`` (words of texts) and ``total`` (steps of all characters, null without ``arrays``) to (id, lang, key, text), and drops the text."""
    schema = T.StructType([*rows.schema.fields[:3], *[T.StructField(x, T.LongType()) for x in (*NUMBERS, "spoken", "total")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, most=PIECE):
                counts = base_counts(texts)
                total = pa.nulls(len(texts), pa.int64())
                if arrays is not None:
                    hashes, values = arrays.value
                    met, _, which = distinct(gram_hashes(*gram_codes(texts)))
                    own = values[np.minimum(np.searchsorted(hashes, met), max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(0, np.int32)
                    total = pa.array(sums_by_doc(own[which].astype(np.int64), texts.at))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array(counts[x]) for x in NUMBERS], pa.array(spoken_words(texts)), total], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def joined_totals(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(key, total) of (key, text) by a join of each text's n-grams with the table. Rows that share a text share its total."""
    schema = T.StructType([T.StructField("key", T.BinaryType()), *GRAMS.fields, T.StructField("length", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, most=PIECE):
                a, b = gram_codes(texts)
                doc = np.repeat(np.arange(len(texts)), np.diff(texts.at))
                _, first, which = distinct(mix(gram_hashes(a, b) ^ mix(doc.astype(np.uint64) + np.uint64(1))))
                of = doc[first]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(a[first]), pa.array(b[first]), pa.array(np.bincount(which, minlength=len(first)).astype(np.int64)), pa.array(np.diff(texts.at)[of])], names=schema.fieldNames())

    found = rows.select("key", "text").mapInArrow(run, schema).join(table.hint("merge"), ["a", "b"])
    # So many rows have the text: all their n-grams by its length.
    return found.groupBy("key").agg((F.sum(F.col("s") * F.col("n")) * F.first("length") / F.sum("n")).cast("long").alias("total"))


def bands(rows: DataFrame) -> DataFrame:
    """(lang, low, high) from (lang, measure): exact quartiles of all documents by a histogram of the steps, which is small whatever the corpus. The quartiles of a language are drawn to those of all documents, as if these were
    SHRINK documents more. The row with null ``lang`` stands for all documents."""
    histogram = rows.where("measure is not null").withColumn("step", F.round(F.col("measure") / STEP).cast("long")).groupBy("lang", "step").agg(F.count("*").alias("n"))
    both = histogram.where("lang is not null").unionByName(histogram.groupBy("step").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")))
    w = Window.partitionBy("lang")
    ranked = both.withColumn("upto", F.sum("n").over(w.orderBy("step"))).withColumn("docs", F.sum("n").over(w))
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("docs") * q, F.col("step"))) * STEP
    own = written(ranked.groupBy("lang").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), F.max("docs").alias("docs")))
    whole = own.where("lang is null").select(F.col("q1").alias("a1"), F.col("q3").alias("a3"))
    drawn = lambda x, y: (F.col("docs") * F.col(x) + SHRINK * F.col(y)) / (F.col("docs") + SHRINK)
    q = own.crossJoin(F.broadcast(whole)).select("lang", drawn("q1", "a1").alias("q1"), drawn("q3", "a3").alias("q3"))
    # Texts that are all alike have no spread; a band has some width in any case.
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(0.02))
    return q.select("lang", (F.col("q1") - REACH * spread).alias("low"), (F.col("q3") + REACH * spread).alias("high"))


def judge_quality(documents: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model_bytes: int = MODEL_BYTES) -> DataFrame:
    """For every document ``doc_id``, the counts ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``, ``base_failed`` (fewer than 50 words, or over half of
    them in repeated windows), ``kept`` and ``log_perplexity`` (the negative logarithm of the text's probability per word; null without words).

    ``model`` is by default counted in the documents themselves. Words lie between ASCII white space; for the perplexity each character of a script without spaces is a word. A null or empty text, or one of white space, has no words and a null perplexity, and fails.
    ``kept`` is false where ``base_failed``, else whether the perplexity lies in the band of the document's language; a null language has the band of all documents. Bounds count as within. Texts of any length are scored whole. Repeated rows count as so many
    documents; empty tables give empty results; other columns, whatever their names, are not read.
    """
    model = model or fit(documents, text)
    own = documents[text].cast("string")
    rows = documents.select(documents[doc_id].alias("id"), documents[lang].cast("string").alias("lang"), F.unhex(F.md5(F.coalesce(own, F.lit("")).cast("binary"))).alias("key"), own.alias("text"))
    table = steps(model, documents, text)
    if table.count() * 12 <= model_bytes:
        found = measured(rows, documents.sparkSession.sparkContext.broadcast(sorted_arrays(table)))
    else:
        found = measured(rows, None).drop("total").join(joined_totals(rows, table).hint("merge"), "key", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    per_word = F.when(F.col("spoken") > 0, F.col("total") * STEP / F.col("spoken"))
    found = written(found.withColumn("log_perplexity", per_word).withColumn("measure", F.log(F.greatest("log_perplexity", F.lit(1e-3)))))
    limits = written(bands(found))
    everything = limits.where("lang is null").select(F.col("low").alias("low_all"), F.col("high").alias("high_all"))
    joined = found.join(small_or_not(limits.where("lang is not null")), "lang", "left").join(F.broadcast(everything), F.lit(True), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.col("measure").between(F.coalesce("low", "low_all"), F.coalesce("high", "high_all"))
    return joined.select(F.col("id").alias(doc_id), *NUMBERS, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"), "log_perplexity")
