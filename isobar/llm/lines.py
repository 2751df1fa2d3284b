"""Line dedup: site-relative frequency.

Pages are grouped by host. The pages that contain a line are counted per host and divided by the host's pages; lines beyond a ratio are
boilerplate of that host and dropped from its pages.

Lines that more than the share r of a host's pages contain are fewer than (distinct lines per page, on average) / r, so the lines to drop fit in one row
per host however large the host. Counting is summed up before its shuffle, so a frequent line or a large host is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.shared import small_or_not, written


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """Rows (host, dropped): the hashes of the lines, without spaces around them, that over ``max_ratio`` of the host's pages and at least ``min_pages`` contain."""
    rows = pages.select(pages[host].alias("host"), F.split(F.coalesce(pages[text], F.lit("")), "\n", -1).alias("lines")).where("host is not null")
    total = rows.groupBy("host").agg(F.count("*").alias("total"))
    distinct = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _line_hash))
    counts = rows.select("host", F.explode_outer(distinct).alias("line")).where("line is not null").groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    over = counts.join(small_or_not(written(total)), "host").where(F.col("n") > F.col("total") * max_ratio)
    return over.groupBy("host").agg(F.collect_list("line").alias("dropped"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.08, min_pages: int = 2) -> DataFrame:
    """The pages with their boilerplate lines dropped from ``text``; adds ``n_lines`` (lines that aren't blank) and ``n_dropped``, which replace columns of these names.

    The ratio decides; ``min_pages``, two, only keeps what stands on one page of a host of few. A line is what lies between newlines, compared by a 64-bit hash without the spaces around it; blank lines are neither counted nor dropped. Texts and lines may be of any length. A page that repeats a line counts once,
    repeated rows are so many pages. Rows with a null host and null texts stay as they are (null texts count as pages without lines). Empty tables give empty results.
    """
    bad = small_or_not(written(boilerplate(pages, host, text, max_ratio, min_pages)))
    names = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    rows = pages.select(*[pages[c].alias(f"c{i}") for i, c in enumerate(names)])
    h, t = F.col(f"c{names.index(host)}"), F.col(f"c{names.index(text)}")
    joined = rows.join(bad, h == bad["host"], "left").select(*rows.columns, "dropped").withColumn("lines", F.split(t, "\n", -1))
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("dropped", _line_hash(x))))
    out = joined.withColumn("kept", kept)
    n_lines = F.coalesce(F.size(F.filter("lines", lambda x: F.trim(x) != "")), F.lit(0))
    n_lines = F.when(t.isNull(), F.lit(0)).otherwise(n_lines).cast("long")
    n_dropped = F.when(t.isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long")
    return out.select(*[(F.when(n_dropped > 0, F.array_join("kept", "\n")).otherwise(t) if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
