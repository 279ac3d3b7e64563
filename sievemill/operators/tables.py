"""Append-only tables: keep-first and keep-last dedup, idempotent appends, latest rows, key checks; scratch tables in the shared folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a broadcast side may have at most; at under 100 bytes a row this stays below 50 MB.
BROADCAST_ROWS = 400_000


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order that must be total."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, by a map-side maximum instead of a sort: order columns ascending, then all others."""
    rest = [c for c in df.columns if c not in keys]
    top = df.select(*keys, F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), *rest).alias("_r")).groupBy(*keys).agg(F.max("_r").alias("_r"))
    return top.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def append_new(existing: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows that an idempotent append writes: of new ones the first of each key that is not there yet. Null keys are refused."""
    return keep_first(new.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")), [key], order).join(existing.select(key), key, "left_anti")


def duplicates(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Keys with more than one row, or, given value columns, with contradictory values."""
    if values:
        return df.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("versions")).where("versions > 1")
    return df.groupBy(*keys).agg(F.count("*").alias("versions")).where("versions > 1")


def missing(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is unknown: must be empty where a reference must exist."""
    return rows.join(known.select(key), key, "left_anti")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys in only one of two tables; empty if both hold the same multiset of keys."""
    left = a.select(key).exceptAll(b.select(key)).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(key).exceptAll(a.select(key)).withColumn("side", F.lit("right")))


def first_needed(samples: DataFrame, group: str, order: list[Column], ok: Column, needed: int) -> DataFrame:
    """The first accepted samples of each group over all its attempts, up to the number needed, renumbered from 0."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return samples.where(ok).withColumn("sample_seq", rank).where(F.col("sample_seq") < needed)


def slices(rows: DataFrame, index: str, groups: int, size: int) -> DataFrame:
    """Instance-major rows cut into groups of one size; none at all unless the total is right."""
    total = rows.agg(F.count("*").alias("_t"))
    cut = rows.withColumn("group_id", F.expr(f"{index} div {size}")).withColumn("sample_index", F.expr(f"pmod({index}, {size})"))
    return cut.join(F.broadcast(total), F.col("_t") == groups * size).drop("_t")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset, a new one on this machine, which only a local master may use."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_sievemill_scratch", "")
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="sievemill-")
            spark.sparkContext._sievemill_scratch = found
    return found.rstrip("/")


def scratch(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and lost executors cost nothing before it."""
    path = f"{shared_dir(spark)}/sievemill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than that many rows; else as it is, for a shuffled join that Spark may split at hot keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
