"""From raw documents to digests of their tokens: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm import quality
from isobar.llm.bpe import bpe_roundtrip
from isobar.llm.decontaminate import drop_contaminated
from isobar.llm.jaccard import jaccard_groups
from isobar.llm.lines import drop_boilerplate
from isobar.llm.queries import table, tokenizer_path
from isobar.llm.shared import small_or_not, written


def unused(name: str, docs: DataFrame) -> str:
    """A column name that the documents don't have, made from ``name``."""
    while name in docs.columns:
        name += "_"
    return name


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, gives at least even chances of being good.

    Null and empty texts get the share of good labels; of several labels of a document the mean counts, and labels without a document are passed over. Texts of any length are scored whole, repeated rows fare alike, an empty table
    stays empty, and without labels all rows stay. Other columns, whatever their names, come through.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    score = unused("quality_score", docs)
    return quality.score_quality(docs, model, out=score).where(F.col(score) >= 0.5).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their source's boilerplate lines; ``n_chars`` is counted anew.

    Rows without a source and null texts stay as they are (``n_chars`` of a null text is null). A text of any length and repeated rows are so many pages each; a line on one page only stays, and of lines at the very ratio none go.
    An empty table stays empty. Other columns, whatever their names, come through.
    """
    names = {c: unused(c, docs) for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = drop_boilerplate(docs.withColumnsRenamed(names)).drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in names.items()})
    return out.withColumn("n_chars", F.length("text").cast("long"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id, once.

    Documents without words, null and empty texts among them, all stay, repeated or not. Null ids come last; of rows that share the least id the one whose text has the least hash stays, and of rows that share the text too, one.
    Texts of any length are compared whole; an empty table stays empty. Other columns, whatever their names, come through.
    """
    groups = jaccard_groups(docs)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("tie").eqNullSafe(F.col("class_tie"))
    stay = groups.where(first).groupBy("doc_id", "tie").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n"))
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(docs["text"].cast("string")).alias("own_tie"))
    kept = rows.join(small_or_not(written(stay)), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_tie") == F.col("tie")))
    # Rows that repeat an id with its text are the only ones to be compared again.
    once = kept.where("rows = 1 or n = 0").select(*rows.columns)
    again = kept.where("rows > 1 and n > 0").dropDuplicates(["own_id", "own_tie"]).select(*rows.columns)
    return once.unionByName(again).drop("own_id", "own_tie").toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts, and texts without words, have no passage and stay; texts of any length are searched whole. Items with a null id or without words are passed over, repeated items count once, repeated rows fare alike. An empty benchmark
    lets all rows through, an empty table stays empty. Other columns, whatever their names, come through.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents, one row for each, with the columns ``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    A null text counts as empty, which has no tokens. Texts of any length are encoded whole, repeated rows give repeated results, an empty table an empty one; other columns are not read.
    """
    return bpe_roundtrip(docs, tokenizer_path())


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]

#: SQL expresses neither the classifier nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each reading what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
