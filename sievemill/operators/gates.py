"""Gate cascades: the first failing gate of each row, the events of the gates it passed, and the funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_failure(gates: list[tuple[str, Column]]) -> Column:
    """Struct (phase, reason) of the first gate whose reason is not null; null if all pass. Later reasons are not evaluated for rows that have failed."""
    return F.coalesce(*(F.when(reason.isNotNull(), F.struct(F.lit(phase).alias("phase"), reason.alias("reason"))) for phase, reason in gates))


def events(rows: DataFrame, key: str, gates: list[str], failure: str = "failure") -> DataFrame:
    """(key, seq, phase, status, reason): passed up to the first failing gate, then rejected, then nothing."""
    at = F.when(F.col(failure).isNull(), len(gates)).otherwise(F.array_position(F.array(*map(F.lit, gates)), F.col(f"{failure}.phase")) - 1)
    named = rows.select(key, F.col(failure), at.cast("int").alias("_at"), F.posexplode_outer(F.array(*map(F.lit, gates))).alias("seq", "phase")).where(F.col("seq") <= F.col("_at"))
    failed = F.col("seq") == F.col("_at")
    return named.select(key, "seq", "phase", F.when(failed, "rejected").otherwise("passed").alias("status"), F.when(failed, F.col(f"{failure}.reason")).alias("reason"))


def funnel(log: DataFrame) -> DataFrame:
    """(phase, status, reason, n)."""
    return log.groupBy("phase", "status", "reason").agg(F.count("*").alias("n"))
