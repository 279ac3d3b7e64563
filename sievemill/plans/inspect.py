"""Rebuilding and inspecting a run from its logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions.vocab import CELLS
from sievemill.operators import grid
from sievemill.operators.tables import keep_first, missing


def cell_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(CELLS)], "cell string, cell_index int")


def rebuild_index(problems: DataFrame, scores: DataFrame) -> DataFrame:
    """The 35-cell index from problem and score logs: first row of each problem, last score of each iteration and policy, scores of unknown problems raise."""
    spark = problems.sparkSession
    known = keep_first(problems, ["problem_id"], [F.col("created_iteration"), F.col("question")])
    if strays := missing(scores, known, "problem_id").limit(3).collect():
        raise KeyError(f"scores of unknown problems: {[r['problem_id'] for r in strays]}")
    latest = grid.latest_scores(grid.upsert_scores(scores))
    cells = cell_table(spark)
    index = grid.map_index(known, latest, cells.select("cell"), "cell", "problem_id", "created_iteration", "rq_score")
    return index.join(cells, "cell").orderBy("cell_index").drop("cell_index")


def summary(index: DataFrame, events: DataFrame) -> DataFrame:
    """One row: accepted, occupied cells, events, rejected events."""
    a = index.agg(F.sum("n").alias("accepted_count"), F.count_if(F.col("n") > 0).alias("occupied_count"))
    b = events.agg(F.count("*").alias("events"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    return a.join(b)


def cycle_summary(iteration: int, before: DataFrame, after: DataFrame, problems: DataFrame, events: DataFrame, frontier: DataFrame, lagged: DataFrame, updates: DataFrame) -> DataFrame:
    """One row for a cycle: the policy and accepted problems before and after, what was tried and archived, both frontiers' sizes, and what became of the update.

    before and after are the one-row state tables around the cycle; problems, events and updates (iteration, status,
    reason, batch_id, checkpoint) are logs, of which the cycle's rows are taken.
    """
    now = F.lit(iteration)
    own = F.col("iteration") == now
    accepted = problems.agg(F.count_if(F.col("created_iteration") < now).alias("accepted_before"), F.count_if(F.col("created_iteration") <= now).alias("accepted_after"), F.count_if(F.col("created_iteration") == now).alias("archived_children"))
    tried = events.where(own).agg(F.count_distinct("candidate_id").alias("attempted_candidates"))
    update = updates.where(own).agg(
        F.coalesce(F.bool_or(F.col("status") == "applied"), F.lit(False)).alias("update_applied"), F.max(F.when(F.col("status") == "skipped", F.col("reason"))).alias("update_skip_reason"),
        F.max(F.when(F.col("status") == "applied", F.col("batch_id"))).alias("replay_batch_id"), F.max(F.when(F.col("status") == "checkpointed", F.col("checkpoint"))).alias("checkpoint"),
    )
    waves = events.where(own & F.col("wave").isNotNull()).groupBy("wave").agg(F.count_distinct("candidate_id").alias("candidates"), F.count_if((F.col("phase") == "archive") & (F.col("status") == "accepted")).alias("archived")).agg(F.array_sort(F.collect_list(F.struct("wave", "candidates", "archived"))).alias("waves"))
    row = before.agg(F.max("policy_version").alias("policy_version_before")).join(after.agg(F.max("policy_version").alias("policy_version_after")))
    for part in (accepted, tried, frontier.agg(F.count("*").alias("current_frontier_count")), lagged.agg(F.count("*").alias("lagged_frontier_count")), update, waves):
        row = row.join(part)  # one row each
    return row.withColumn("iteration", now)
