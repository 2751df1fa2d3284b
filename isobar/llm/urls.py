"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefixes.

Every URL is expanded into the expressions (a suffix of its host, a prefix of its path) that a rule could have. The
expressions meet the rules in an equi-join on the first ``PREFIX`` hexadecimal digits of their digest, full digests
confirm the match, and of all rules that fit the longest gives the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.shared import small_or_not, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest on which the join is made.
PREFIX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end.
    Both are empty for null and where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules with digests. Of rules with the same host and path, ``block`` stands over others; rules with a null part are left out."""
    r = rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v")).dropna()
    r = r.groupBy("h", "p").agg(F.max_by("v", F.struct(F.col("v") == "block", "v")).alias("v"))
    digest = _digest(F.col("h"), F.col("p"))
    return r.select(F.substring(digest, 1, PREFIX).alias("prefix"), digest.alias("full"), _labels(F.col("h")).alias("labels"), F.length("p").alias("reach"), F.length("h").alias("width"), F.concat("h", "p").alias("rule"), F.col("v").alias("rule_verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """The verdict on every row's URL: columns ``keep``, ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits its host and all subdomains, if the path starts
    with the rule's; the longest host and path together win, then the longer host. No rule fits: ``rule`` is null and the verdict
    ``default``. A null URL, or one without ``://``, has an empty host and path, which no rule fits. Repeated rows give repeated
    results and empty tables empty ones; other columns are not read.

    Only the suffixes and prefixes of sizes that rules have are formed, once for every distinct (host, path), so long or frequent
    URLs cost no more than the rules' sizes.
    """
    ready = written(prepared_rules(rules))
    shapes = sorted((r.labels, r.reach) for r in ready.select("labels", "reach").distinct().collect())
    host, path = host_and_path(pages[url])
    rows = pages.select(*[pages[c].alias(f"k{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    names = [*keep, "host", "path", "rule", "verdict"]
    if not shapes:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}).toDF(*names)
    h, p = F.col("host"), F.col("path")
    # One function over an array of sizes, so that the plan stays small however many sizes rules have.
    sizes = F.array(*[F.struct(F.lit(k).alias("labels"), F.lit(n).alias("reach")) for k, n in shapes])
    suffix = lambda x: F.call_function("substring_index", h, F.lit("."), -x["labels"])
    tries = F.transform(sizes, lambda x: F.when((_labels(h) >= x["labels"]) & (F.length(p) >= x["reach"]), _digest(suffix(x), F.substring(p, F.lit(1), x["reach"]))))
    # URLs without a host, perhaps very many alike, need no join.
    bare, rows = rows.where("host = ''"), rows.where("host != ''")
    found = (
        rows.select("host", "path").distinct()
        .select("host", "path", F.explode(F.array_compact(tries)).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX))
        .join(small_or_not(ready), "prefix")
        .where(F.col("digest") == F.col("full"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "width", "rule", "rule_verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))
    )
    out = rows.join(found, ["host", "path"], "left").unionByName(bare, allowMissingColumns=True)
    return out.select(*[f"k{i}" for i in range(len(keep))], "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict")).toDF(*names)
