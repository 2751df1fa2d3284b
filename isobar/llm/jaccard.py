"""N-gram Jaccard join: chosen paths.

The sets are the five-word shingles of the documents. Documents with the same set form one class, of which one is compared. In every run the sets are split by a token that they
share: the least of the set under a random order, which two sets have in common with the probability of their similarity. Buckets that are still too large are split again, by one further order or, now and then, by
two, so that the expected number of buckets that a pair at the threshold shares stays one at every depth. Small buckets are compared by brute force on sketches, and runs are repeated until the recall is reached.

What the buckets connect is then checked exactly: all sets of a connected group are compared with each other, in blocks, so every link within it is found and counted, whichever bucket showed it.
Only counts and spanning links leave a block, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.llm.components import components
from isobar.llm.shared import hot_keys, join_by_key, small_or_not, written
from isobar.llm.textarrays import Texts, chunks, distinct_pairs, mix, plain_words, shingles

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Random orders, whose least tokens make the sketch of a set.
ORDERS = 64
#: Splits at most, and the most sets of a bucket that are compared by brute force.
DEPTH = 4
SMALL = 48
#: Equal places of two sketches from which a pair counts as a candidate: five standard deviations below the threshold's mean.
ALIKE = int(ORDERS * THRESHOLD - 5 * (ORDERS * THRESHOLD * (1 - THRESHOLD)) ** 0.5)
#: Sets that are compared exactly at a time.
BLOCK = 512


def survival(similarity: float, depth: int, branch: float) -> float:
    """The probability that a pair still shares a bucket after ``depth`` splits, of which a share ``branch`` is by two orders."""
    q = 1.0
    for _ in range(depth):
        q = (1 - branch) * similarity * q + branch * (1 - (1 - similarity * q) ** 2)
    return q


def runs_for(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold was together with probability ``recall``, even if every bucket is split ``depth`` times."""
    return ceil(log(1 - recall) / log(1 - survival(threshold, depth, 1 / threshold - 1)))


def _salts() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, ORDERS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, ORDERS, dtype=np.uint64)


def token_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in order, the text of each, and where each text's begin (one more at the end)."""
    words, first, _ = plain_words(texts)
    h, doc = distinct_pairs(*shingles(words, first, WORDS))
    return h, doc, np.searchsorted(doc, np.arange(len(texts) + 1))


def set_keys(h: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """128 bits that name each set."""
    sums = []
    for salt in (1, 2):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), out=total[1:])
        sums.append(mix(total[begin[1:]] - total[begin[:-1]] + np.diff(begin).astype(np.uint64)))
    return [x.tobytes() for x in np.stack(sums, axis=1)]


def sketches(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The least value of each set under each order; empty sets have zeros."""
    out = np.zeros((len(begin) - 1, ORDERS), np.uint32)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        factor, plus = _salts()
        for k in range(ORDERS):
            out[full, k] = np.minimum.reduceat(((h * factor[k] + plus[k]) >> np.uint64(32)).astype(np.uint32), begin[full])
    return out


RECORDS = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.ArrayType(T.IntegerType())),
])


def records(rows: DataFrame) -> DataFrame:
    """(doc, tie, key, n, sketch) for each of (doc, tie, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                h, _, begin = token_sets(texts)
                flat = sketches(h, begin).view(np.int32).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * ORDERS), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(set_keys(h, begin), pa.binary()), pa.array(np.diff(begin).astype(np.int64)), lists], names=RECORDS.fieldNames())

    return rows.select("doc", "tie", "text").mapInArrow(run, RECORDS)


def split(df: DataFrame, depth: int, branch: float) -> DataFrame:
    """The next buckets of (key, sketch, path): by one order that the path determines, or two."""
    draw = lambda k: F.xxhash64("path", F.lit(depth), F.lit(k))
    one = F.pmod(draw(0), F.lit(ORDERS)).cast("int")
    two = F.pmod(one + 1 + F.pmod(draw(1), F.lit(ORDERS - 1)).cast("int"), F.lit(ORDERS))
    to = lambda c: F.xxhash64("path", c, F.get("sketch", c))
    second = F.when(F.pmod(draw(2), F.lit(1_000_000)) < int(branch * 1_000_000), to(two))
    return df.select("key", F.explode(F.array(to(one), second)).alias("path")).where("path is not null")


def _label(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of n is connected with by the pairs (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Batches of rows sorted by group, cut anew so that no group is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        if held:
            same = all(held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py() == batch.column(batch.schema.get_field_index(c))[0].as_py() for c in columns)
            if not same:
                ends = np.concatenate([[0], ends])
        if len(ends):
            last = int(ends[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _tasks(df: DataFrame) -> int:
    """How many tasks compare sets: as many as shuffles have, not fewer where there are few bytes, as each takes long."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


PAIR = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def compare_small(buckets: DataFrame) -> DataFrame:
    """Spanning links (a, b) of the candidates within each bucket of (path, key, sketch), found by comparing all its sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["path"]):
            path = table.column("path").to_numpy()
            sketch = table.column("sketch").combine_chunks()
            sketch = sketch.flatten().to_numpy().reshape(-1, ORDERS)
            pairs_i, pairs_j = [], []
            for step in range(1, SMALL):
                at = np.flatnonzero(path[step:] == path[:-step]) if len(path) > step else ()
                if not len(at):
                    break
                for lo in range(0, len(at), 100_000):
                    some = at[lo : lo + 100_000]
                    good = some[(sketch[some] == sketch[some + step]).sum(axis=1) >= ALIKE]
                    pairs_i.append(good)
                    pairs_j.append(good + step)
            if not pairs_i:
                continue
            label = _label(np.concatenate(pairs_i), np.concatenate(pairs_j), len(path))
            own = np.flatnonzero(label != np.arange(len(path)))
            keys = table.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(own)), keys.take(pa.array(label[own]))], names=["a", "b"])

    return buckets.repartition(_tasks(buckets), "path").sortWithinPartitions("path").select("path", "key", "sketch").mapInArrow(run, PAIR)


def candidate_links(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Links (a, b) that connect all candidate pairs of (key, sketch)."""
    branch = 1 / threshold - 1
    runs = runs_for(threshold, recall)
    frontier = sets.select("key", "sketch", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(runs).cast("long"))).alias("path"))
    links, sizes = None, None
    for depth in range(1, DEPTH + 1):
        rows = written(split(frontier, depth, branch))
        sizes = written(rows.groupBy("path").agg(F.count("*").alias("size"), F.min("key").alias("least")).where("size > 1"))
        rows = written(join_by_key(rows, sizes, "path", hot_keys(sizes, "path", "size")))
        fresh = compare_small(rows.where(F.col("size") <= SMALL).join(sets, "key"))
        links = fresh if links is None else links.unionByName(fresh)
        large = rows.where(F.col("size") > SMALL)
        if large.isEmpty():
            return links
        frontier = large.select("key", "path").join(sets, "key")
    # Sets that still agree after all splits are linked without a comparison; the exact check follows anyway.
    return links.unionByName(large.where("key != least").select(F.col("key").alias("a"), F.col("least").alias("b")))


CHECKED = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("root", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("blocks", T.LongType())])


def overlaps(owner: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """How many tokens each two of n sets share."""
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    first = np.concatenate([[True], token[1:] != token[:-1]])
    column = np.cumsum(first) - 1
    often = np.bincount(column) > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], number[column[keep]]
    total = np.zeros((n, n), np.float32)
    width = max(256, (8 << 20) // max(n, 1))
    cut = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if hi > lo:
            part = np.zeros((n, width), np.float32)
            part[owner[lo:hi], column[lo:hi] - k * width] = 1
            total += part @ part.T
    return total.astype(np.int64)


def check_groups(members: DataFrame, threshold: float) -> DataFrame:
    """(key, root, links, blocks) from (key, root, size, set): exact links of every set to the others of its group, in blocks where the group is large. ``root`` is then the least key
    that the links of this block connect it with."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("group", F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other"))).select("group", "key", "set", "mine", "other", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["group"]):
            group, mine, other, n_blocks = (table.column(c).to_numpy() for c in ("group", "mine", "other", "blocks"))
            keys, sets = table.column("key").to_pylist(), table.column("set").to_pylist()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            key, root, links, parts = [], [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                tokens = [np.frombuffer(s, np.uint64) for s in sets[lo:hi]]
                sizes = np.array([len(t) for t in tokens], np.int64)
                shared = overlaps(np.repeat(np.arange(hi - lo), sizes), np.concatenate(tokens), hi - lo)
                # Similar enough: shared >= threshold * (a + b - shared), in whole numbers.
                linked = shared * (1000 + int(threshold * 1000)) >= int(threshold * 1000) * (sizes[:, None] + sizes[None, :])
                np.fill_diagonal(linked, False)
                within = mine[lo:hi] == other[lo:hi]
                if not within.all():
                    linked &= mine[lo:hi, None] != mine[None, lo:hi]
                i, j = np.nonzero(np.triu(linked))
                label = _label(i, j, hi - lo)
                own = keys[lo:hi]
                least = {}
                for k, lab in enumerate(label.tolist()):
                    least[lab] = min(least.get(lab, own[k]), own[k])
                key += own
                root += [least[lab] for lab in label.tolist()]
                links += linked.sum(axis=1).tolist()
                parts += n_blocks[lo:hi].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(root, pa.binary()), pa.array(links, pa.int64()), pa.array(parts, pa.int64())], names=CHECKED.fieldNames())

    return dealt.repartition(_tasks(dealt), "group").sortWithinPartitions("group").mapInArrow(run, CHECKED)


def _sets_of(chosen: DataFrame) -> DataFrame:
    """(key, root, size, set) of (key, root, size, text)."""
    schema = T.StructType([*chosen.drop("text").schema.fields, T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                h, _, begin = token_sets(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([h[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())], names=schema.fieldNames())

    return chosen.mapInArrow(run, schema)


def jaccard_groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """For every document: ``doc_id``, ``tie`` (a hash of the text), ``set_key`` (names its set of shingles), ``n_shingles``, ``class_id`` (the least id of the documents it is connected with, itself included, by equal sets or links),
    ``class_tie`` (that document's hash) and ``n_links`` (how many other distinct sets its set is linked to, at a similarity of ``threshold`` or more).

    Words are compared as in decontamination. A text of one to four words has one shingle of all of them; a null text, or one without words, has none, no links and a class of its own.
    Null ids come last. Repeated rows share their class. A text of any length has all its shingles in its set. Empty tables give empty results; other columns are not read. Similar pairs are found with probability ``recall`` at the threshold, and more surely above it;
    what is found is exact.
    """
    rows = documents.select(documents[doc_id].cast("long").alias("doc"), documents[text].cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    all_records = written(records(rows))
    rank = F.struct(F.col("doc").isNull().alias("last"), "doc", "tie")
    classes = written(all_records.where("n > 0").groupBy("key").agg(F.min(rank).alias("rep"), F.first("sketch").alias("sketch")))
    links = candidate_links(classes.select("key", "sketch"), threshold, recall)
    near = written(components(links))
    sized = near.join(small_or_not(written(near.groupBy("root").agg(F.count("*").alias("size")))), "root")
    wanted = written(sized.join(classes.select(F.col("key").alias("node"), "rep"), "node").select(F.col("node").alias("key"), "root", "size", F.col("rep.doc").alias("r_doc"), F.col("rep.tie").alias("r_tie")))
    chosen = rows.join(small_or_not(wanted), F.col("doc").eqNullSafe(F.col("r_doc")) & (F.col("tie") == F.col("r_tie"))).groupBy("key").agg(F.first("root").alias("root"), F.first("size").alias("size"), F.first("text").alias("text"))
    checked = written(check_groups(_sets_of(chosen.select("key", "root", "size", "text")), threshold))
    counts = checked.groupBy("key").agg(F.sum("links").alias("n_links"))
    cut = checked.where("blocks > 1")
    roots = checked.where("blocks = 1").select("key", "root")
    if not cut.isEmpty():
        roots = roots.unionByName(components(cut.select(F.col("key").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("key"), "root"))
    groups = roots.join(counts, "key", "full").join(classes.select("key", "rep"), "key", "right").select("key", "rep", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    groups = written(groups)
    leaders = groups.groupBy("root").agg(F.min("rep").alias("leader"))
    named = written(groups.join(leaders, "root").select("key", F.col("leader.doc").alias("class_id"), F.col("leader.tie").alias("class_tie"), "n_links"))
    own: Column = F.col("n") == 0
    out = all_records.drop("sketch").join(small_or_not(named), "key", "left")
    return out.select(
        F.col("doc").alias(doc_id), "tie", F.col("key").alias("set_key"), F.col("n").alias("n_shingles"), F.when(own, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.col("tie")).otherwise(F.col("class_tie")).alias("class_tie"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
