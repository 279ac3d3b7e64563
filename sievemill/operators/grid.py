"""The problem grid: latest scores, cell contents and representatives over an append-only catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.operators.tables import keep_last


def upsert_scores(scores: DataFrame, problem: str = "problem_id", iteration: str = "iteration", policy: str = "policy_version", seq: str = "seq") -> DataFrame:
    """One score for each problem, iteration and policy: the last written."""
    return keep_last(scores, [problem, iteration, policy], [F.col(seq)])


def latest_scores(scores: DataFrame, problem: str = "problem_id", iteration: str = "iteration", policy: str = "policy_version") -> DataFrame:
    return keep_last(scores, [problem], [F.col(iteration), F.col(policy)])


def scores_at(scores: DataFrame, iteration: int, problem: str = "problem_id", policy: str = "policy_version", observation: str = "observation_id") -> DataFrame:
    """Each problem's score of one iteration: that of the last policy, then of the largest observation id."""
    return keep_last(scores.where(F.col("iteration") == iteration), [problem], [F.col(policy), F.col(observation)])


def score_as_of(scores: DataFrame, cutoff: int, problem: str = "problem_id", policy: str = "policy_version") -> DataFrame:
    """Each problem's last score up to an iteration."""
    return keep_last(scores.where(F.col("iteration") <= cutoff), [problem], [F.col("iteration"), F.col(policy)])


def map_index(problems: DataFrame, latest: DataFrame, cells: DataFrame, cell: str, problem: str, created: str, score: str) -> DataFrame:
    """Every cell, empty ones too: cell, n, representative. It is the problem of the largest latest score (none counts as -1), then the oldest, then of the largest id."""
    scored = problems.join(latest.select(problem, score), problem, "left")
    rank = F.struct(F.coalesce(F.col(score), F.lit(-1.0)), -F.col(created), F.col(problem))
    found = scored.groupBy(cell).agg(F.count("*").alias("n"), F.max_by(F.col(problem), rank).alias("representative"))
    # cells are the fixed vocabulary's product, so this side is small by definition
    return cells.join(found, cell, "left").select(cell, F.coalesce("n", F.lit(0)).alias("n"), "representative")


def cell_ids(problems: DataFrame, cells: DataFrame, cell: str, problem: str) -> DataFrame:
    """Every cell with its problems' ids in order, for catalogs that fit a document."""
    return cells.join(problems.groupBy(cell).agg(F.array_sort(F.collect_list(problem)).alias("ids")), cell, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def lineage(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children (id, left_id, right_id) with roots and generation from parents (id, roots, generation); a parent without roots is its own."""
    own = parents.select(F.col("id").alias("_p"), F.when(F.size(F.coalesce("roots", F.array().cast("array<string>"))) > 0, F.col("roots")).otherwise(F.array(F.col("id").cast("string"))).alias("_r"), F.col("generation").alias("_g"))
    a, b = own.toDF("left_id", "_lr", "_lg"), own.toDF("right_id", "_rr", "_rg")
    return children.join(a, "left_id").join(b, "right_id").select("id", "left_id", "right_id", F.array_sort(F.array_union("_lr", "_rr")).alias("roots"), (F.greatest("_lg", "_rg") + 1).alias("generation"))


def disjoint_pairs(rows: DataFrame, key: str, roots: str, block: str) -> DataFrame:
    """Pairs (left, right) within a block whose roots have nothing in common."""
    a = rows.select(F.col(block), F.col(key).alias("left"), F.col(roots).alias("_l"))
    b = rows.select(F.col(block), F.col(key).alias("right"), F.col(roots).alias("_r"))
    return a.join(b, block).where((F.col("left") < F.col("right")) & ~F.arrays_overlap("_l", "_r")).select(block, "left", "right")


def policy_steps(events: DataFrame, version: str, order: str, partition: str) -> DataFrame:
    """Rows where a version does not follow its predecessor by one."""
    before = F.lag(version).over(Window.partitionBy(partition).orderBy(order))
    return events.withColumn("before", before).where((F.col("before").isNotNull()) & (F.col(version) != F.col("before") + 1))
