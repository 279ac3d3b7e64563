"""Consensus labels: a plurality vote with a fixed denominator over classes of equivalent answers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import grading
from sievemill.functions.vocab import LABEL_ROLLOUTS


def plurality(samples: DataFrame, group: str, answer: Column, index: Column, size: int = LABEL_ROLLOUTS) -> DataFrame:
    """Vote by equal texts. Per group of exactly size rows: label, winner_size, agreement, n_clusters, reason.

    A null answer votes for nothing but stays in the denominator; the label is the answer of the lowest index of the
    largest class, and a tie at the top gives none.
    """
    rows = samples.select(F.col(group), answer.alias("_a"), index.alias("_i"))
    clusters = rows.groupBy(group, "_a").agg(F.count("*").alias("_n"))
    top = clusters.groupBy(group).agg(
        F.sum("_n").alias("n"), F.sum(F.when(F.col("_a").isNotNull(), 1).otherwise(0)).alias("n_clusters"), F.max(F.when(F.col("_a").isNotNull(), F.struct(F.col("_n").alias("k"), F.col("_a").alias("a")))).alias("_top"),
        F.collect_list(F.when(F.col("_a").isNotNull(), F.col("_n"))).alias("_sizes"),
    )
    ties = F.size(F.filter("_sizes", lambda k: k == F.col("_top.k")))
    reason = F.when(F.col("n") != size, "incomplete_label_group").when(F.col("n_clusters") == 0, "no_valid_label_answers").when(ties > 1, "label_tie")
    out = top.withColumn("reason", reason)
    counted = (F.col("reason").isNull()) | (F.col("reason") == "label_tie")
    return out.select(
        group, "n", F.when(counted, F.col("n_clusters")).otherwise(0).alias("n_clusters"), F.when(F.col("reason").isNull(), F.col("_top.a")).alias("label"),
        F.when(counted, F.col("_top.k")).otherwise(0).alias("winner_size"), F.when(counted, F.col("_top.k") / F.lit(float(size))).otherwise(0.0).alias("agreement"), "reason",
    )


def typed_vote(answers: list[str | None], mode: str | None, size: int) -> tuple[str | None, list[int], float, str | None]:
    """(label, class sizes, agreement, reason) of the answers of one complete group, in index order."""
    said = [a for a in answers if a is not None]
    if not said:
        return None, [], 0.0, "no_valid_label_answers"
    alike = [{j for j in range(len(said)) if j == i or grading.equivalent(said[max(i, j)], said[min(i, j)], mode)} for i in range(len(said))]
    classes: list[set[int]] = []
    for i in range(len(said)):
        # the classes that i is linked with become one
        joined = [c for c in classes if c & alike[i]]
        classes = [c for c in classes if not c & alike[i]] + [set().union({i}, *joined)]
    sizes = sorted(map(len, classes), reverse=True)
    if any(alike[i] != c for c in classes for i in c):
        return None, sizes, 0.0, "non_transitive_answer_equivalence"
    if sizes.count(sizes[0]) > 1:
        return None, sizes, sizes[0] / size, "label_tie"
    winner = next(c for c in classes if len(c) == sizes[0])
    return said[min(winner)], sizes, sizes[0] / size, None


def typed_labels(samples: DataFrame, group: str, answer: str, index: str, mode: str, accepted: Column, size: int = LABEL_ROLLOUTS) -> DataFrame:
    """Vote by typed equivalence, where every class must be a clique. A group is at most its rollouts; larger ones fail before any are gathered."""
    counts = samples.groupBy(group).agg(F.count("*").alias("_n"), F.bool_and(F.coalesce(accepted, F.lit(False))).alias("_ok"), F.first(mode).alias("_mode"))
    fault = F.when(F.col("_n") != size, "incomplete_label_group").when(~F.col("_ok"), "label_group_contains_rejected_sample")
    counts = counts.withColumn("reason", fault)
    schema = f"`{group}` {samples.schema[group].dataType.simpleString()}, label string, cluster_sizes array<int>, agreement double, reason string"

    def vote(key: tuple, t: pa.Table) -> pa.Table:
        rows = t.sort_by("_i").to_pydict()
        label, sizes, agreement, reason = typed_vote(rows["_a"], rows["_mode"][0], size)
        return pa.table({group: pa.array([key[0].as_py()], t.schema.field(group).type), "label": pa.array([label], pa.string()), "cluster_sizes": pa.array([sizes], pa.list_(pa.int32())), "agreement": pa.array([agreement], pa.float64()), "reason": pa.array([reason], pa.string())})

    whole = samples.join(counts.where("reason is null").select(group, "_mode"), group).select(group, F.col(answer).cast("string").alias("_a"), F.col(index).alias("_i"), "_mode")
    done = whole.groupBy(group).applyInArrow(vote, schema)
    failed = counts.where("reason is not null").select(group, F.lit(None).cast("string").alias("label"), F.array().cast("array<int>").alias("cluster_sizes"), F.lit(0.0).alias("agreement"), "reason")
    return done.unionByName(failed)


def diagnostics(samples: DataFrame, group: str, status: str, reason: str) -> DataFrame:
    """Per group: its statuses and reject reasons with counts, as arrays of (name, n) in name order."""
    counts = lambda c: samples.where(F.col(c).isNotNull()).groupBy(group, c).agg(F.count("*").alias("n")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(c).alias("name"), "n"))).alias(c + "_counts"))
    return counts(status).join(counts(reason), group, "left")


