"""Groups of generated samples: cut out of, put together from attempts, and bound to the one batch of a cycle.

A sample's native payload is a row outside; payload_row is its number there, null for samples of text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.vocab import BATCH
from sievemill.operators import audit


def picked(samples: DataFrame, wanted: DataFrame, group: str = "request_id", index: str = "sample_index") -> DataFrame:
    """The samples that wanted (group, index, seat) names, in seat order and numbered by it, each with its own payload row; an index that its group has not raises when it is read."""
    ask = wanted.select(group, F.col(index).alias("_w"), "seat")
    rows = ask.join(samples.withColumnRenamed(index, "_i"), ask[group].eqNullSafe(samples[group]) & (F.col("_w") == F.col("_i")), "left").drop(samples[group])
    checked = F.when(F.col("_i").isNull(), F.raise_error(F.concat(F.lit("no sample "), F.col("_w").cast("string"), F.lit(" in group "), F.col(group).cast("string")))).otherwise(F.col("seat"))
    return rows.withColumn(index, checked.cast("int")).drop("_w", "_i", "seat")


def together(fragments: DataFrame, group: str = "request_id") -> DataFrame:
    """Samples of all attempts of a group as one group, in order of attempt and index, numbered from 0 on. fragment_faults tells groups that must not be put together."""
    order = Window.partitionBy(group).orderBy("attempt", "sample_index")  # a group has some ten samples
    return fragments.withColumn("_n", F.row_number().over(order) - 1).drop("sample_index").withColumnRenamed("_n", "sample_index")


def fragment_faults(fragments: DataFrame, group: str = "request_id") -> DataFrame:
    """(key, fault): groups whose fragments answer different prompts, or of which some have payloads and some are text alone. An empty fingerprint says nothing."""
    known = F.when(F.col("prompt_hash") != "", F.col("prompt_hash"))
    per = fragments.groupBy(group).agg(F.count_distinct(known).alias("p"), F.count("payload_row").alias("n"), F.count("*").alias("all"))
    return audit.violations(per, group, {"one_prompt": F.col("p") <= 1, "one_kind": F.col("n").isin(0) | (F.col("n") == F.col("all"))})


def authorisation_faults(asked: DataFrame, held: DataFrame, size: int = BATCH) -> DataFrame:
    """(key, fault) of binding a cycle to a batch (batch_id, observation_id): an empty id, not exactly size different observations, or another batch than the one that is bound already (held, without rows if none is)."""
    of = lambda df: df.groupBy("batch_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.col("observation_id").cast("string"))).alias("ids"))  # noqa: E731  a batch has size rows
    old = of(held).agg(F.max(F.struct("batch_id", "ids")).alias("old"))
    rows = of(asked).join(F.broadcast(old))  # one row
    return audit.violations(rows, "batch_id", {
        "empty_id": F.trim("batch_id") != "", "group_count": (F.col("n") == size) & (F.size("ids") == size),
        "other_batch": F.col("old").isNull() | ((F.col("old.batch_id") == F.col("batch_id")) & (F.col("old.ids") == F.col("ids"))),
    })


def label_statuses(samples: DataFrame, group: str, attempt: int, retries: int, needed: int) -> DataFrame:
    """(group, collected, status, reason) of assembled groups after an attempt: retrying while samples lack and retries are left, rejected when none are, complete otherwise."""
    per = samples.groupBy(group).agg(F.count_if(F.col("status") == "accepted").alias("collected"))
    short = F.col("collected") < needed
    return per.select(group, "collected", F.when(short & F.lit(attempt < retries), "retrying").when(short, "rejected").otherwise("complete").alias("status"), F.when(short, "incomplete_label_group").alias("reason"))
