"""What the training-data operators share: table reading, scratch tables in the shared folder, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.operators.tables import BROADCAST_ROWS, bounded, scratch, shared_dir

__all__ = ["BROADCAST_ROWS", "ascii_lower", "bounded", "scratch", "shared_dir", "table", "ws_words"]

#: Words of the shingle contract: runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ws_words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; none for null or blank."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")
