"""Tables of a run by iteration, computed once, and the manifest that pins a run."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.sources import logs


def _place(root: str, name: str, iteration: int) -> str:
    return f"{root}/{name}/iteration={int(iteration)}"


def write(df: DataFrame, root: str, name: str, iteration: int) -> None:
    """The rows of one iteration, replacing what an earlier attempt left there."""
    df.write.mode("overwrite").parquet(_place(root, name, iteration))


def read(spark: SparkSession, root: str, name: str, iterations: tuple[int, ...] = ()) -> DataFrame:
    """The table with its iteration column; given iterations, only their folders are read."""
    rows = spark.read.parquet(f"{root}/{name}")
    return rows.where(F.col("iteration").isin(*iterations)) if iterations else rows


def cached(spark: SparkSession, root: str, name: str, iteration: int, rows: int, make: Callable[[], DataFrame]) -> DataFrame:
    """What was written for an iteration, which must have that many rows, or what make gives, written first."""
    path = _place(root, name, iteration)
    if not logs.exists(spark, f"{path}/_SUCCESS"):
        write(make(), root, name, iteration)
    found = spark.read.parquet(path)
    if (n := found.count()) != rows:
        raise ValueError(f"{path} has {n} rows; {rows} are planned")
    return found


def manifest(config: Mapping, hashes: Mapping[str, str], run_uuid: str, git: str = "") -> dict:
    """What a run depends on. The resume setting is how it was called, not what it is, so it is left out."""
    training = {k: v for k, v in dict(config.get("training", {})).items() if k != "resume_mode"}
    return {"run_uuid": run_uuid, "config": {**config, "training": training}, "sha256": dict(hashes), "git": git}


def manifest_changes(old: Mapping, new: Mapping) -> list[str]:
    """Names that differ, the git state aside; a run goes on only if there is none."""
    return sorted(k for k in set(old) | set(new) if k != "git" and logs.stable_json(old.get(k)) != logs.stable_json(new.get(k)))
