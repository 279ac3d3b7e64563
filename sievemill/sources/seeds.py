"""The seed catalog: a log of problems, one for each domain, read with its types, answers and verifiers checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import typing_rules as R
from sievemill.operators import audit
from sievemill.sources import logs, schemas


def judged(seeds: DataFrame) -> DataFrame:
    """Rows of seeds with what the checks need: the type that the statement asks for, faults of both answers, and of the verifier."""
    made = R.verifier(F.col("problem_type"), F.col("pseudo_gold"))
    mode = F.coalesce(F.col("verifier.mode"), F.lit("expression"))
    same = (mode == made["mode"]) & F.coalesce(F.col("verifier.elements"), F.array().cast("array<string>")).eqNullSafe(F.coalesce(made["elements"], F.array().cast("array<string>")))
    return seeds.select(
        "*", R.problem_type(F.col("question"))["problem_type"].alias("annotated_type"), R.contract_error(F.col("problem_type"), F.col("proposed_answer")).alias("proposed_fault"), R.contract_error(F.col("problem_type"), F.col("pseudo_gold")).alias("gold_fault"),
        F.coalesce(made["error"], F.when(~F.coalesce(same, F.lit(False)), "other_verifier")).alias("verifier_fault"),
    )


def seed_faults(seeds: DataFrame) -> DataFrame:
    """(key, fault) of a seed catalog; * stands for the whole."""
    told = judged(seeds)
    return audit.seed_checks(told).unionByName(audit.violations(told, "problem_id", {"verifier": F.col("verifier_fault").isNull()}))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Typed seeds of a log; a missing file, an unknown field or any fault raises. A seed without roots is its own root."""
    if not logs.exists(spark, path):
        raise FileNotFoundError(path)
    names = [f.name for f in schemas.schema("accepted_problems").fields]
    odd = spark.read.text(path).where(F.trim("value") != "").select(F.explode_outer(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, names)))).alias("key"), F.lit("unknown_field").alias("fault")).where("key is not null")
    audit.require(odd, "seeds")
    rows = logs.read_log(spark, path, schemas.schema("accepted_problems"))
    audit.require(seed_faults(rows), "seeds")
    some = F.coalesce(F.size("lineage_root_ids") > 0, F.lit(False))
    return rows.withColumn("lineage_root_ids", F.when(some, F.col("lineage_root_ids")).otherwise(F.array("problem_id")))
