"""Benchmark decontamination: winnowing.

From a text of words the hashes of all runs of ``K`` words are taken, and of every ``WINDOW`` runs in a row the least one is kept.
Two texts that share ``K + WINDOW - 1`` words in a row keep the same hash there, so an equi-join of kept hashes finds every shared span of that length.
Each hit is then extended: the windows of words that contain it are compared with the benchmark's, word for word.

All of it is DataFrame functions. Positions share a 64-bit integer with the hashes, so that the least of several is found by ``least`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.shared import small_or_not, text_key, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII without digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of an item that make one window; every shared span of so many words is found.
SPAN = 10
#: Words of a hashed run, and runs of which the least is kept: K + WINDOW - 1 = SPAN.
K, WINDOW = 4, 7
#: Low bits of a kept hash that hold its position. A string in a row has fewer than 2^31 octets, so fewer than 2^30 words, as each but the last has one after it.
PLACE = 30


def words_of(text: Column) -> Column:
    """The words of a text, letters as they are; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _paired(df: DataFrame, left: str, right: str, shift: int, new: str, how) -> DataFrame:
    """Array ``new``: how(left[i], right[i + shift]) for all i that have both."""
    n = F.greatest(F.least(F.size(left), F.size(right) - shift), F.lit(0))
    return df.withColumn(new, F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), how))


def run_hashes(df: DataFrame, sizes: set[int]) -> DataFrame:
    """Adds arrays ``g<n>`` of the hashes of all runs of n words, n in ``sizes`` of 1 to 9, to ``g1``, the words' hashes."""
    made = {1}

    def make(df: DataFrame, n: int) -> DataFrame:
        if n in made:
            return df
        head = 1 << ((n - 1).bit_length() - 1)
        df = make(make(df, head), n - head)
        made.add(n)
        return _paired(df, f"g{head}", f"g{n - head}", head, f"g{n}", lambda a, b: F.xxhash64(a, b))

    for n in sorted(sizes):
        df = make(df, n)
    return df


def fingerprints(texts: DataFrame, key: Column, text: Column, short: list[int], long: bool) -> DataFrame:
    """Rows (key, size, fp, place): kept hashes of runs of K words with size SPAN, and, for items of fewer words, the hashes of all runs of each size in ``short``."""
    df = texts.select(key.alias("key"), words_of(text).alias("w"))
    # Cheap to hash alike: words that are equal once A-Z is lower-cased are equal in lower case.
    df = df.select("key", F.transform("w", lambda x: F.xxhash64(F.lower(x))).alias("g1"))
    df = run_hashes(df, {*short, *([K] if long else [])})
    tagged = lambda x, i: x.bitwiseAND(F.lit(-(1 << PLACE))).bitwiseOR(i.cast("long"))
    # explode_outer: for explode the planner would infer a filter on the array's size and copy the whole expression into it.
    kinds = []
    for n in short:
        df = df.withColumn(f"t{n}", F.transform(f"g{n}", tagged))
        kinds.append((n, f"t{n}"))
    if long:
        df = df.withColumn("m1", F.transform(f"g{K}", tagged))
        least = lambda a, b: F.least(a, b)
        df = _paired(df, "m1", "m1", 1, "m2", least)
        df = _paired(df, "m2", "m2", 2, "m4", least)
        df = _paired(df, "m4", "m4", WINDOW - 4, "m7", least)
        df = df.withColumn("kept", F.array_distinct("m7"))
        kinds.append((SPAN, "kept"))
    if not kinds:
        return df.select("key", F.lit(0).alias("size"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("place")).limit(0)
    if len(kinds) == 1:
        rows = df.select("key", F.lit(kinds[0][0]).alias("size"), F.explode_outer(kinds[0][1]).alias("x"))
    else:
        rows = df.select("key", F.explode_outer(F.array(*[F.struct(F.lit(n).alias("size"), F.col(c).alias("xs")) for n, c in kinds])).alias("s")).select("key", "s.size", F.explode_outer("s.xs").alias("x"))
    return rows.where("x is not null").select("key", "size", F.shiftright("x", PLACE).alias("fp"), F.col("x").bitwiseAND(F.lit((1 << PLACE) - 1)).alias("place"))


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Rows (size, gram, items): each window of the items in lower case, its words joined by a space, with the ids of the items that have it."""
    items = benchmark.select(benchmark[item_id].cast("string").alias("item"), words_of(lowered(benchmark[text])).alias("w")).where("item is not null and size(w) > 0")
    size = F.least(F.size("w"), F.lit(SPAN))
    each = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1))).select("item", size.alias("size"), F.array_join(F.slice("w", F.col("at"), size), " ").alias("gram"))
    return each.groupBy("size", "gram").agg(F.collect_set("item").alias("items"))


def matched_texts(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each distinct text of (body) in which a benchmark window occurs: its ``key``, the words hit, and the items whose windows occur; a written table."""
    windows = written(benchmark_windows(benchmark, item_id, item_text))
    sizes = {r["size"] for r in windows.select("size").distinct().collect()}
    short, long = sorted(sizes - {SPAN}), SPAN in sizes
    items = benchmark.where(F.col(item_id).isNotNull())
    marks = written(fingerprints(items, F.size(words_of(F.col(item_text))), F.col(item_text), short, long).where((F.col("size") == SPAN) | (F.col("key") == F.col("size"))).select("size", "fp").distinct())
    key = text_key(F.col("body"))
    hits = fingerprints(docs, key, F.col("body"), short, long).join(small_or_not(marks), ["size", "fp"], "left_semi")
    hits = written(hits.groupBy("key").agg(F.collect_set(F.struct("size", "place")).alias("at")))
    # Of equal texts one goes on, its words now compared letter by letter.
    found = docs.select(key.alias("key"), "body").join(small_or_not(hits.select("key")), "key", "left_semi").groupBy("key").agg(F.first("body").alias("body"))
    found = found.select("key", words_of(lowered(F.col("body"))).alias("w")).join(hits, "key")
    last = F.size("w") - SPAN
    spread = F.transform("at", lambda x: F.when(x["size"] < SPAN, F.array(F.struct(x["size"].alias("size"), x["place"].cast("int").alias("at")))).otherwise(
        F.transform(F.sequence(F.greatest(x["place"].cast("int") - (SPAN - K), F.lit(0)), F.least(x["place"].cast("int"), F.greatest(last, F.lit(0)))), lambda s: F.struct(x["size"].alias("size"), s.alias("at")))))
    tries = found.select("key", "w", F.explode_outer(F.array_distinct(F.flatten(spread))).alias("t")).select("key", "t.size", "t.at", F.array_join(F.slice("w", F.col("t.at") + 1, F.col("t.size")), " ").alias("gram"))
    matched = tries.join(small_or_not(windows), ["size", "gram"]).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("spans"), F.collect_set("items").alias("items"))
    # Words covered by the spans, which are in order.
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", zero, lambda a, x: F.struct(F.greatest(a["end"], x["at"] + x["size"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(a["end"], x["at"]))).alias("n")))["n"]
    return written(matched.select("key", covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items")))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, in whose text no benchmark window occurs."""
    matched = matched_texts(documents.select(documents[text].cast("string").alias("body")), benchmark, item_id, item_text)
    keys = matched.select("key")
    return documents.join(small_or_not(keys), text_key(documents[text].cast("string")) == keys["key"], "left_anti")


def contamination(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For every document: ``doc_id``, ``n_words``, ``n_hit`` (words within occurrences of benchmark windows), ``n_items`` and ``items``
    (ids of the items whose windows occur, sorted as strings) and ``contaminated``.

    Words are runs of digits, letters and characters beyond ASCII, compared with A-Z lower-cased. A window is ``SPAN`` words in a row
    of an item; an item of fewer words, but not none, is one window. A null or empty text has no words; items with a null id or without words
    have no windows. Texts of any length are compared whole. Repeated rows give repeated results, an empty benchmark no hits and empty documents no rows. Other columns are not read.

    Texts are told apart by a digest, so of equal texts one is examined further. The benchmark's tables are broadcast only if their counted size allows.
    """
    docs = documents.select(documents[doc_id].alias("id"), documents[text].cast("string").alias("body"))
    matched, key = matched_texts(docs, benchmark, item_id, item_text), text_key(F.col("body"))
    out = docs.select("id", key.alias("key"), F.size(words_of(F.col("body"))).cast("long").alias("n_words")).join(small_or_not(matched), "key", "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(doc_id), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))
