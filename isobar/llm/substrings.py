"""Substring dedup: hashing of lines, in sentences.

The units are the sentences of a line, of which long ones are cut further. Cuts depend on the words themselves, never on where a passage stands, so a passage that begins and ends within lines has the
same units wherever it is copied to. Units are normalised (A-Z in lower case, words joined by one space), named by digests and grouped over all documents; of units that are alike the earliest ranked one stays, that of the
least document id, then of the least place in the text. Short units recur by chance, so the others go only where repeated units in a row reach ``MIN_WORDS`` words. What goes is reported by its offsets in the original text.

A digest has 64 bits, and no unit has more than ``MOST`` words. So what goes is at least two units long, and a text that is no repeat would go only if the digests of two neighbours collided at once: at 10^13 units
one unit in 10^6 has a collision, two in a row one in 10^12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.llm.shared import hot_keys, join_by_key, small_or_not, written
from isobar.llm.textarrays import Texts, chunks, range_hashes, runs

#: Words of repeated units in a row from which they are removed: half of a passage of fifty words, whose first and last units may be cut by its ends.
MIN_WORDS = 25
#: A sentence is cut after words whose code points sum up to a multiple of CUT, and after MOST words without a cut.
CUT, MOST = 8, 12
#: Characters that end a sentence where they end a word.
ENDS = ".!?。！？"
#: Scripts written without spaces, of which each character counts as a word: from Thai to Lao, Myanmar, Khmer, and CJK, kana, Hangul and what follows.
UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0x3000), (0x3004, 0xFF00), (0xFF10, 0x110000))


class Units:
    """The units of some texts: ``start`` and ``end`` of each (from its first word to its last), its number of ``words``, the text it lies in (``doc``), and ``digests``."""

    def __init__(self, texts: Texts, digests: bool = True):
        cp = texts.cp
        space = (cp == 0x20) | ((cp >= 9) & (cp <= 13))
        alone = np.zeros(len(cp), bool)
        for low, high in UNSPACED:
            alone |= (cp >= low) & (cp < high)
        start, end = runs(~space & ~alone, texts.at)
        if alone.any():
            single = np.flatnonzero(alone)
            start, end = np.concatenate([start, single]), np.concatenate([end, single + 1])
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
        n = len(start)
        lowered = cp + (((cp >= 0x41) & (cp <= 0x5A)).astype(np.uint32) << np.uint32(5))
        total = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(lowered, out=total[1:])
        doc = texts.doc_of(start)
        line = np.searchsorted(np.flatnonzero(cp == 10), start)
        last = np.ones(n, bool)
        last[:-1] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
        cut = last | ((total[end] - total[start]) % CUT == 0)
        if n:
            cut |= np.isin(cp[end - 1], np.array([ord(c) for c in ENDS], np.uint32))
        piece = np.concatenate([[True], cut[:-1]]) if n else cut
        since = np.arange(n) - np.maximum.accumulate(np.where(piece, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        first = np.flatnonzero(since % MOST == 0)
        stop = np.append(first[1:], n)[: len(first)]
        self.start, self.end, self.words, self.doc = start[first], end[stop - 1] if len(first) else end[:0], stop - first, doc[first]
        if digests:
            # The words, lower-cased, with one space after each.
            length = end - start
            at = np.zeros(n + 1, np.int64)
            np.cumsum(length + 1, out=at[1:])
            flat = np.full(at[-1], 0x20, np.uint32)
            flat[np.repeat(at[:-1] - (np.cumsum(length) - length), length) + np.arange(length.sum())] = lowered[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())]
            self.digests = range_hashes(flat, at[first], at[stop])


UNITS = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("digests", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.IntegerType()))])


def unit_rows(rows: DataFrame) -> DataFrame:
    """(rid, doc, key, digests, words) of (rid, doc, key, text): the units of each text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                units = Units(texts)
                at = pa.array(np.searchsorted(units.doc, np.arange(len(texts) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(at, pa.array(units.digests.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(units.words.astype(np.int32)))], names=UNITS.fieldNames())

    return rows.select("rid", "doc", "key", "text").mapInArrow(run, UNITS)


def repeated_runs(units: DataFrame, min_words: int) -> DataFrame:
    """(rid, gone): for each text with some, its runs of repeated units (first, last) that reach ``min_words`` words, in order.

    Of the occurrences of repeated units one digest may have a third, so the rows of frequent digests are dealt out in the joins.
    """
    repeated = written(units.select(F.explode("digests").alias("d")).groupBy("d").agg(F.count("*").alias("n")).where("n > 1"))
    hot = hot_keys(repeated, "d")
    zipped = F.posexplode(F.arrays_zip("digests", "words")).alias("unit", "z")
    each = units.select("rid", zipped).select(F.col("z.digests").alias("d"), "rid", "unit", F.col("z.words").alias("words"))
    # These tables grow with the corpus: they are joined by shuffles at every size.
    met = written(join_by_key(each, repeated.select("d"), "d", hot))
    # Only units that occur twice at least are ranked.
    of = units.select("rid", F.struct(F.col("doc").isNull().alias("last"), "doc", "key", "rid").alias("rank"))
    ranked = met.join(of.hint("merge"), "rid")
    first = ranked.groupBy("d").agg(F.min(F.struct("rank", "unit")).alias("first")).select("d", F.col("first.rank.rid").alias("f_rid"), F.col("first.unit").alias("f_unit"))
    again = join_by_key(met, first, "d", hot).where("rid != f_rid or unit != f_unit").select("rid", "unit", "words")
    island = again.withColumn("island", F.col("unit") - F.row_number().over(Window.partitionBy("rid").orderBy("unit")))
    found = island.groupBy("rid", "island").agg(F.min("unit").alias("first"), F.max("unit").alias("last"), F.sum("words").alias("n")).where(F.col("n") >= min_words)
    return found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("gone"))


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """For every document: ``doc_id``, ``n_units`` (of the text), ``n_removed`` (units removed), ``spans`` (start and end offsets in code points of what is removed from the original text, in order, each from the
    first word of a run of repeated units to its last) and ``text`` (what is left, as it stood).

    A unit is a sentence of a line, or a piece of one. Repeated units in a row, over the ends of lines too, are removed if they have ``min_words`` words; words lie between white space, and each character of a script
    written without spaces is one. A null text stays null and has no units, an empty one has none either; a text may be of any length. Texts are ranked by id (null last), then, if they share an id, by a digest of the text; of rows with the
    same id and text one comes first, and the others repeat all of it. Empty tables give empty results; other columns are not read.

    A unit that very many documents share is summed up before each shuffle and dealt out by a salt where its rows are joined. Texts are not shuffled unless the runs to be removed are
    too many to broadcast.
    """
    key = F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("")).cast("binary")))
    rows = documents.select(documents[doc_id].cast("long").alias("doc"), documents[text].cast("string").alias("text")).withColumn("key", key)
    units = written(unit_rows(rows.withColumn("rid", F.monotonically_increasing_id())))
    runs_of = written(repeated_runs(units.where("size(digests) > 0"), min_words))
    # Rows that repeat an id with its text: the first fares as its least row, the others go whole.
    ids = units.select("rid", "doc", "key")
    twice = written(ids.groupBy("doc", "key").agg(F.min("rid").alias("rid"), F.count("*").alias("n")).where("n > 1"))
    several = not twice.isEmpty()
    gone = runs_of.join(ids.hint("merge"), "rid")
    if several:
        gone = gone.join(small_or_not(twice.select(F.col("rid").alias("least"), F.col("doc").alias("t_doc"), F.col("key").alias("t_key"))), F.col("doc").eqNullSafe(F.col("t_doc")) & (F.col("key") == F.col("t_key")), "left").where("least is null or rid = least")
    gone = written(gone.select(F.col("doc").alias("g_doc"), F.col("key").alias("g_key"), "gone"))
    once = rows.withColumn("copy", F.lit(1))
    if several:
        same = rows["doc"].eqNullSafe(F.col("t_doc")) & (rows["key"] == F.col("t_key"))
        marks = small_or_not(twice.select(F.col("doc").alias("t_doc"), F.col("key").alias("t_key")))
        copies = rows.join(marks, same, "left_semi").groupBy("doc", "key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
        once = rows.join(marks, same, "left_anti").withColumn("copy", F.lit(1)).select("doc", "text", "key", "copy").unionByName(copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("doc", "text", "key", "copy"))
    joined = once.join(small_or_not(gone), (F.col("doc").eqNullSafe(F.col("g_doc"))) & (F.col("key") == F.col("g_key")), "left").select("doc", "text", "copy", "gone")
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                units = Units(texts, digests=False)
                begin = np.searchsorted(units.doc, np.arange(len(texts) + 1))
                original, copy, gone = part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()
                spans, removed = [], []
                for i, t in enumerate(original):
                    a, b = int(begin[i]), int(begin[i + 1])
                    if copy[i] > 1:
                        own = [{"first": 0, "last": b - a - 1}] if int(units.words[a:b].sum()) >= min_words else []
                    else:
                        own = gone[i] or []
                    removed.append(sum(r["last"] - r["first"] + 1 for r in own))
                    spans.append([{"start": int(units.start[a + r["first"]] - texts.at[i]), "end": int(units.end[a + r["last"]] - texts.at[i])} for r in own])
                    if own:
                        cuts = [0, *(x for s in spans[-1] for x in (s["start"], s["end"])), len(t)]
                        original[i] = "".join([t[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)])
                columns = [part.column(0), pa.array(np.diff(begin).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(original, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return joined.mapInArrow(run, schema).withColumnRenamed("doc", doc_id)
