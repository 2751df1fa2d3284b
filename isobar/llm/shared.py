"""What the operators share about the cluster: the shared folder, tables written there, and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast only if its rows, as counted, come to at most so many bytes.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. A session in one process, as in tests, may do without: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="isobar-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/isobar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(c: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in a row in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        own = F.octet_length(c) + 16
    elif isinstance(kind, T.StructType):
        own = sum((_width(c.getField(f.name), f.dataType) for f in kind.fields), F.lit(16))
    elif isinstance(kind, T.ArrayType):
        own = F.aggregate(c, F.lit(24).cast("long"), lambda total, x: total + _width(x, kind.elementType).cast("long"))
    else:
        own = F.lit(8)
    return F.coalesce(own.cast("long"), F.lit(8).cast("long"))


def row_bytes(df: DataFrame) -> int:
    """About how many bytes the rows take in memory, by a count over all of them."""
    total = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return int(df.agg(F.sum(total)).first()[0] or 0)


def small_or_not(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """For the lesser side of a join, a written table: hinted for broadcast if its counted size allows, else for a shuffled join, whose skew the adaptive planner splits."""
    return F.broadcast(df) if row_bytes(df) <= most else df.hint("merge")


#: A key with more than one HOT-th of all rows is dealt out over SALTS groups where it is joined.
HOT, SALTS = 500, 64


def hot_keys(sizes: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The keys of (key, n), a written table, that hold more than one HOT-th of all rows; they are fewer than HOT, so they are broadcast."""
    total = sizes.agg(F.sum(n)).first()[0] or 0
    return F.broadcast(written(sizes.where(F.col(n) * HOT > total).select(F.col(key).alias("hot_key"))))


def join_by_key(many: DataFrame, once: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """The inner join of ``many`` with ``once``, which has each key once at most, by a shuffle. Rows of hot keys are dealt out by a hash of the row, and the single rows of ``once`` are copied to all groups."""
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in many.columns]), F.lit(SALTS)).cast("int")
    left = many.join(hot, many[key] == hot["hot_key"], "left").withColumn("salt", F.when(F.col("hot_key").isNull(), F.lit(0)).otherwise(deal)).drop("hot_key")
    everywhere = F.when(F.col("hot_key").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    right = once.join(hot, once[key] == hot["hot_key"], "left").withColumn("salt", F.explode(everywhere)).drop("hot_key")
    return left.join(right.hint("merge"), [key, "salt"]).drop("salt")


def text_key(text: Column) -> Column:
    """128 bits that name a text."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def keep_hash(column: Column, salt: str = "") -> Column:
    """Integers from 0 to 2^31 - 1 by a hash, for samples that come out the same in every run."""
    return F.pmod(F.xxhash64(F.lit(salt), column), F.lit(1 << 31))
