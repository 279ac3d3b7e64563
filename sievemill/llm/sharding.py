"""Proportional stratified interleaving: every shard gets the mixture of the whole, and shards differ by one row at most.

Rows are put in a seeded random order within their source; a row's fractional rank there, (rank + 1/2) / rows of the
source, is its place in the global order, which is cut into equal runs. A source that holds a third of all rows is never
ordered in one task: its rows are dealt by ranges of their hash, each range is ranked alone and gets the count of the
ranges before it. The global order is ranked alike, by ranges of the fraction. Ranges hold about RANGE_ROWS rows each.

Defined cases: a null source is a stratum of its own; a null text has size 1 and the checksum of the empty text; equal
ids and repeated rows are ordered by all columns used and each gets a slot; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.llm.common import bounded, scratch

#: Rows of a range, and ranges at most; beyond that ranges grow, so that the table of their counts stays small.
RANGE_ROWS = 2_000
RANGES = 1_000_000


def interleave(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, size (UTF-8 bytes + 1), text_crc32, source, shard, slot (gapless from 0 within the shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col), F.col(source_col).alias("source"),
        F.concat(F.when(F.col(source_col).isNull(), "-").otherwise("+"), F.coalesce(F.col(source_col).cast("string"), F.lit(""))).alias("_s"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
    )
    base = scratch(spark, base.withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, "text_crc32"), 1)), "shard-base")
    total = base.count()
    per = max(RANGE_ROWS, total // RANGES)
    ranges = max(1, total // per)
    sources = bounded(base.groupBy("_s").agg(F.count("*").alias("_rows")))
    own = F.ceil(F.col("_rows") / per)
    base = base.join(sources, "_s").withColumn("_r", F.least(F.floor(F.col("_u") / F.lit(2.0**63) * own), own - 1).cast("long"))
    before = F.sum("count").over(Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    counts = base.groupBy("_s", "_r").count().select("_s", "_r", F.coalesce(before, F.lit(0)).alias("_before"))
    order = ["_u", id_col, "text_crc32", "size"]
    rank = F.row_number().over(Window.partitionBy("_s", "_r").orderBy(*order)) - 1 + F.col("_before")
    ranked = base.join(counts, ["_s", "_r"]).withColumn("_f", (rank + F.lit(0.5)) / F.col("_rows")).drop("_r", "_before", "_rows")
    ranked = scratch(spark, ranked.withColumn("_b", F.least(F.floor(F.col("_f") * ranges), F.lit(ranges - 1)).cast("long")), "shard-ranked")
    starts = ranked.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_f", "_s", *order)) - 1 + F.col("_start")
    shard = F.expr(f"(_g * {shards}) div {max(1, total)}")
    out = ranked.join(starts, "_b").withColumn("_g", place.cast("long")).withColumn("shard", shard.cast("int"))
    return out.select(id_col, "size", "text_crc32", "source", "shard", F.expr(f"_g - ((shard * {total}L + {shards - 1}) div {shards})").cast("long").alias("slot"))
