"""Replay groups: the scored rollouts that a training batch supplies, known by content hashes of what they answer.

Payload tensors stay outside; a group is a row with its keys, hashes and number of payload rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions.ids import quoted


def prompt_hash(messages: Column) -> Column:
    """Of an array of (role, content), as JSON objects with their fields in name order."""
    return F.sha2(F.to_json(F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))), 256)


def answer_hash(answer: Column) -> Column:
    """Of the exact text: white space counts."""
    return F.sha2(F.concat(F.lit('{"answer":'), quoted(answer), F.lit("}")), 256)


def verifier_hash(mode: Column, elements: Column) -> Column:
    """Of the verifier; sets have their elements, other modes the mode alone."""
    with_items = F.concat(F.lit('{"verifier":{"elements":'), F.to_json(F.coalesce(elements, F.array().cast("array<string>"))), F.lit(',"mode":"set"}}'))
    return F.sha2(F.when(mode == "set", with_items).otherwise(F.concat(F.lit('{"verifier":{"mode":'), quoted(mode), F.lit("}}"))), 256)


def policy_hash(policy: Column) -> Column:
    """Of a policy struct, compared as a whole: its five fields in name order."""
    names = ("adapter_version", "global_step", "policy_version", "run_uuid", "source_checkpoint")
    return F.sha2(F.to_json(F.struct(*(policy[n].alias(n) for n in names))), 256)


def payload_rows(sizes: DataFrame, group: str, size: str) -> DataFrame:
    """(group, rows, fault) from several reports of a payload's size: those over zero must agree; all zero is empty, none at all is unknown."""
    known = F.when(F.col(size) > 0, F.col(size))
    per = sizes.groupBy(group).agg(F.min(known).alias("_a"), F.max(known).alias("_b"), F.count(size).alias("_n"))
    fault = F.when(F.col("_n") == 0, "unknown_row_count").when(F.col("_a") != F.col("_b"), "inconsistent_row_counts")
    return per.select(group, F.when(fault.isNull(), F.coalesce("_a", F.lit(0))).cast("long").alias("rows"), fault.alias("fault"))


def dataset_rows(selected: DataFrame, groups: DataFrame, observation: str, size: int) -> DataFrame:
    """The rows of a training call: each selected group's metadata, size times, in seat order. Exactly one pass, no wrap-around."""
    meta = selected.select(observation, "seat").join(groups, observation)
    return meta.select("seat", F.explode_outer(F.sequence(F.lit(0), F.lit(size - 1))).alias("sample_index"), F.lit(True).alias("replay_required"), *groups.columns, F.lit(size).alias("replay_group_size"))


def routed(calls: DataFrame, call: str, marked: str) -> DataFrame:
    """(call, route): served from the buffer if any row is marked, generated if none is; a call with both kinds is failed, never generated."""
    per = calls.groupBy(call).agg(F.count("*").alias("rows"), F.count_if(F.col(marked)).alias("_m"))
    return per.select(call, "rows", F.when(F.col("_m") == 0, "passthrough").when(F.col("_m") == F.col("rows"), "served").otherwise("failed").alias("route"))


def stats(groups: DataFrame, routes: DataFrame, size: int) -> DataFrame:
    """One row with the seven counters of capture, service and failure."""
    captured = groups.agg(F.count("*").alias("captured_groups"), F.coalesce(F.sum("payload_rows"), F.lit(0)).cast("long").alias("captured_rows"))
    served = F.col("route") == "served"
    return captured.join(routes.agg(
        F.count_if(served).alias("served_batches"), F.coalesce(F.sum(F.when(served, F.expr(f"rows div {size}"))), F.lit(0)).cast("long").alias("served_groups"), F.coalesce(F.sum(F.when(served, F.col("rows"))), F.lit(0)).cast("long").alias("served_rows"),
        F.count_if(F.col("route") == "passthrough").alias("passthrough_calls"), F.count_if(F.col("route") == "failed").alias("failed_calls"),
    ))


def consumed_once(served: DataFrame, updates: DataFrame, iteration: str = "iteration") -> DataFrame:
    """(key, fault) of iterations whose updates and served batches do not pair one to one."""
    both = updates.groupBy(iteration).agg(F.count("*").alias("u")).join(served.groupBy(iteration).agg(F.count("*").alias("s")), iteration, "full")
    u, s = F.coalesce("u", F.lit(0)), F.coalesce("s", F.lit(0))
    fault = F.when(u > 1, "several_updates").when(s > 1, "several_batches").when(u > s, "update_without_batch").when(s > u, "batch_not_consumed")
    return both.select(F.col(iteration).cast("string").alias("key"), fault.alias("fault")).where("fault is not null")


def wave_funnel(events: DataFrame, wave: str, stages: dict[str, str]) -> DataFrame:
    """Per wave a column for each stage: the candidates that passed its phase. stages: column name to phase."""
    hit = lambda phase: F.count_distinct(F.when((F.col("phase") == phase) & F.col("status").isin("passed", "accepted"), F.col("candidate_id")))
    return events.groupBy(wave).agg(*(hit(phase).alias(name) for name, phase in stages.items()))
