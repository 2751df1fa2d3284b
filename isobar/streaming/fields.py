"""Streams of fields: each field once, and how many of each kind arrive in a span of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.functions.names import reference_time
from isobar.sources.gridded import number


def with_reference_time(fields: DataFrame) -> DataFrame:
    parts = [number("identification", p).cast("int") for p in ("year", "month", "day", "hour", "minute", "second")]
    return fields.withColumn("reference_time", reference_time(*parts))


#: What makes up a field: discipline, identification, local sections, grid, product, packing, bit map and data.
WHOLE = ("discipline", "section1", "message_local", "section2", "section3", "section4", "section5", "bitmap_indicator", "effective_bitmap", "section7")


def each_once(fields: DataFrame, late: str = "2 days") -> DataFrame:
    """Fields without those that came before and are alike in every section. State, a digest per field, is kept as long as the watermark on the reference time says."""
    # Hashes pass over nulls, so which parts are null is hashed too.
    parts = [x for c in WHOLE for x in (F.col(c).isNull(), F.col(c))]
    alike = F.struct(F.xxhash64(F.lit(0), *parts), F.xxhash64(F.lit(1), *parts))
    return with_reference_time(fields).withColumn("field_key", alike).withWatermark("reference_time", late).dropDuplicatesWithinWatermark(["reference_time", "field_key"])


def arrivals(fields: DataFrame, span: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Counts by span of reference time and parameter."""
    named = with_reference_time(fields).withWatermark("reference_time", late)
    return named.groupBy(F.window("reference_time", span).alias("span"), "discipline", number("product", "category").alias("category"), number("product", "number").alias("number")).agg(F.count("*").alias("fields"))
