"""Integrity predicates. Each gives the violations of a table, as (key, fault) rows; a clean table gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions.vocab import BATCH, CELLS, DOMAINS, PHASES, PROBLEM_TYPES, SCORE_ROLLOUTS
from sievemill.operators import replay


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, fault) for every check that is not true of a row; a null check is a fault."""
    faults = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items())), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode_outer(faults).alias("fault")).where("fault is not null")


def require(found: DataFrame, what: str) -> None:
    """Raises with up to five violations if there are any."""
    if rows := found.limit(5).collect():
        raise ValueError(f"{what}: " + "; ".join(f"{r['key']}: {r['fault']}" for r in rows))


def state_checks() -> dict[str, Column]:
    """Invariants of the one-row run state."""
    c = F.col
    busy = c("phase").isin("batch_ready", "update_applied", "checkpointed")
    return {
        "phase": c("phase").isin(*PHASES),
        "negative": (c("iteration") >= 0) & (c("policy_version") >= 0) & (c("global_step") >= 0) & (c("checkpoint_step") >= 0) & (c("checkpoint_event_offset") >= 0),
        "checkpoint_ahead": c("checkpoint_step") <= c("global_step"),
        "checkpoint_behind": (c("global_step") == c("checkpoint_step")) | (c("phase") == "update_applied"),
        "cycle": F.when(c("phase") == "ready", c("active_cycle_id").isNull() & c("active_training_batch_id").isNull()).otherwise(c("active_cycle_id").isNotNull()),
        "batch": (c("phase") == "ready") | (c("active_training_batch_id").isNotNull() == busy),
        "high_water": (c("checkpoint_step") > 0) | ((c("checkpoint_event_offset") == 0) & (F.coalesce("checkpoint_event_hash", F.lit("")) == "")),
    }


def seed_checks(seeds: DataFrame) -> DataFrame:
    """Violations of a seed catalog (problem_id, domain, problem_type, annotated_type, proposed_fault, gold_fault): one row for each domain, distinct cells, all types, types as annotated, answers of their shape."""
    cell = F.concat_ws("/", "domain", "problem_type")
    each = violations(seeds.withColumn("_cell", cell), "problem_id", {
        "cell": F.col("_cell").isin(*CELLS), "type": F.col("problem_type").eqNullSafe(F.col("annotated_type")),
        "proposed_answer": F.col("proposed_fault").isNull(), "gold_answer": F.col("gold_fault").isNull(),
    })
    whole = seeds.agg(F.count("*").alias("n"), F.count_distinct("problem_id").alias("ids"), F.count_distinct("domain").alias("d"), F.count_distinct("problem_type").alias("t"), F.count_distinct(cell).alias("c")).withColumn("k", F.lit("*"))
    return each.unionByName(violations(whole, "k", {"rows": F.col("n") == len(DOMAINS), "ids": F.col("ids") == F.col("n"), "domains": F.col("d") == len(DOMAINS), "types": F.col("t") == len(PROBLEM_TYPES), "cells": F.col("c") == F.col("n")}))


def batch_checks(batch: DataFrame, resident: DataFrame, observation: str, problem: str, size: int = BATCH) -> DataFrame:
    """A batch has exactly its size, no observation or problem twice, and every observation's payload is there."""
    whole = batch.agg(F.count("*").alias("n"), F.count_distinct(observation).alias("o"), F.count_distinct(problem).alias("p")).withColumn("k", F.lit("*"))
    found = violations(whole, "k", {"size": F.col("n") == size, "observations": F.col("o") == F.col("n"), "problems": F.col("p") == F.col("n")})
    gone = batch.join(resident.select(observation), observation, "left_anti")
    return found.unionByName(gone.select(F.col(observation).cast("string").alias("key"), F.lit("not_resident").alias("fault")))


def replay_checks(groups: DataFrame, size: int = SCORE_ROLLOUTS) -> DataFrame:
    """Stored score groups: purpose, ids, payload rows and the three content hashes."""
    c = F.col
    return violations(groups, "observation_id", {
        "purpose": c("purpose") == "score", "ids": (c("observation_id") != "") & (c("problem_id") != ""), "payload_rows": c("payload_rows") == size,
        "prompt_hash": c("prompt_hash") == replay.prompt_hash(c("messages")), "answer_hash": c("answer_hash") == replay.answer_hash(c("answer")), "verifier_hash": c("verifier_hash") == replay.verifier_hash(c("verifier.mode"), c("verifier.elements")),
    })


def buffer_checks(groups: DataFrame, size: int = SCORE_ROLLOUTS) -> DataFrame:
    """One policy, one iteration, one group size, and no observation twice."""
    whole = groups.agg(F.count_distinct("policy").alias("p"), F.count_distinct("iteration").alias("i"), F.min("payload_rows").alias("a"), F.max("payload_rows").alias("b"), F.count("*").alias("n"), F.count_distinct("observation_id").alias("o")).withColumn("k", F.lit("*"))
    return violations(whole, "k", {"policy": F.col("p") <= 1, "iteration": F.col("i") <= 1, "group_size": (F.col("n") == 0) | ((F.col("a") == size) & (F.col("b") == size)), "observations": F.col("o") == F.col("n")})


def candidate_checks(candidates: DataFrame, lag: int) -> DataFrame:
    """Evidence of training candidates: ids, scores in [0, 1], and selection evidence of the right iteration."""
    c = F.col
    earlier = (c("selection_iteration") < c("score_iteration")) & c("selection_s").isNotNull() if lag else c("selection_iteration") == c("score_iteration")
    return violations(candidates, "observation_id", {
        "ids": (c("observation_id") != "") & (c("problem_id") != ""), "current_s": c("current_s").between(0.0, 1.0),
        "selection_s": c("selection_s").isNull() | c("selection_s").between(0.0, 1.0), "lag": earlier,
    })


def served_checks(rows: DataFrame, groups: int = BATCH, size: int = SCORE_ROLLOUTS) -> DataFrame:
    """A served training call: all rows marked, groups of one size with one payload hash each, as many as authorised."""
    per = rows.groupBy("observation_id").agg(F.count("*").alias("n"), F.count_distinct("payload_hash").alias("h"), F.bool_and("marked").alias("m"))
    found = violations(per, "observation_id", {"group_size": F.col("n") == size, "one_payload": F.col("h") == 1, "marked": F.col("m")})
    return found.unionByName(violations(per.agg(F.count("*").alias("n")).withColumn("k", F.lit("*")), "k", {"groups": F.col("n") == groups}))


def flags_agree(rewards: DataFrame, rollouts: DataFrame, keys: list[str]) -> DataFrame:
    """(key, fault) where a reward over one half and the stored correctness differ, or either is missing."""
    both = rewards.join(rollouts, keys, "full").withColumn("_k", F.concat_ws("/", *keys))
    return violations(both, "_k", {"reward": (F.col("reward") > 0.5).eqNullSafe(F.col("correct")) & F.col("correct").isNotNull()})


def batch_id(selected: DataFrame, iteration: int, policy: int, observation: str = "observation_id", seat: str = "seat") -> DataFrame:
    """One row: the content hash of kind, iteration, policy and the observations in selection order. A batch is bounded by its size."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seat).alias("s"), F.col(observation).cast("string").alias("o")))), lambda x: x["o"])
    manifest = selected.agg(F.struct(F.lit(iteration).alias("iteration"), F.lit("score_replay_batch").alias("kind"), ids.alias("observation_ids"), F.lit(policy).alias("policy_version")).alias("m"))
    return manifest.select(F.sha2(F.to_json("m"), 256).alias("batch_id"), F.size("m.observation_ids").alias("n"))


def one_policy(rows: DataFrame, cycle: str, policy: str) -> DataFrame:
    """Cycles in which the policy changed."""
    return rows.groupBy(cycle).agg(F.count_distinct(policy).alias("n")).where("n > 1").select(F.col(cycle).cast("string").alias("key"), F.lit("policy_changed").alias("fault"))


def fragments(samples: DataFrame, group: str) -> DataFrame:
    """Groups put together from attempts: violations of one prompt and no index twice within an attempt."""
    per = samples.groupBy(group).agg(F.count_distinct("prompt_hash").alias("p"), F.count("*").alias("n"), F.count_distinct("attempt", "sample_index").alias("d"))
    return violations(per, group, {"one_prompt": F.col("p") == 1, "indices": F.col("n") == F.col("d")})
