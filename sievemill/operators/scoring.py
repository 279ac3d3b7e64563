"""Group scores with a fixed denominator, and the reasons for which a group has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions.vocab import BAND, SCORE_ROLLOUTS


def score_groups(samples: DataFrame, keys: list[str], correct: Column, entropy: Column, accepted: Column, size: int = SCORE_ROLLOUTS, require_entropy: bool = True) -> DataFrame:
    """Per group: n, num_correct, s_hat, learnability, u_score, rq_score, reason. Groups fail closed: a reason leaves no score."""
    bad = entropy.isNotNull() & (F.isnan(entropy) | ~entropy.between(0.0, 1.0))
    agg = samples.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.coalesce(correct, F.lit(False)).cast("int")).alias("num_correct"), F.sum(F.coalesce(entropy, F.lit(0.0))).alias("_u"),
        F.coalesce(F.bool_and(accepted), F.lit(False)).alias("_ok"), F.bool_or(entropy.isNull()).alias("_none"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("_bad"),
    )
    reason = F.when(F.col("n") != size, "incomplete_score_group").when(~F.col("_ok"), "score_group_contains_rejected_sample").when(F.col("_bad"), "invalid_normalized_entropy")
    if require_entropy:
        reason = F.when(F.col("n") != size, "incomplete_score_group").when(~F.col("_ok"), "score_group_contains_rejected_sample").when(F.col("_none"), "missing_score_entropy").when(F.col("_bad"), "invalid_normalized_entropy")
    out = agg.withColumn("reason", reason)
    s = F.col("num_correct") / F.lit(float(size))
    learn = s * (1 - s) * F.lit(size / (size - 1) if size > 1 else 0.0)
    u = F.col("_u") / F.lit(float(size))
    keep = lambda c: F.when(F.col("reason").isNull(), c)
    return out.select(*keys, "n", keep(F.col("num_correct")).alias("num_correct"), keep(s).alias("s_hat"), keep(learn).alias("learnability"), keep(u).alias("u_score"), keep(learn * u).alias("rq_score"), "reason")


def in_band(s_hat: Column, low: float = BAND[0], high: float = BAND[1]) -> Column:
    """Strictly between the bounds."""
    return (s_hat > low) & (s_hat < high)


def capacity(in_frontier: DataFrame, cell: str, per_cell: int) -> DataFrame:
    """frontier_count and frontier_capacity: the sum over cells of what a balanced batch can take."""
    counts = in_frontier.groupBy(cell).agg(F.count("*").alias("c"))
    return counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("frontier_count"), F.coalesce(F.sum(F.least(F.col("c"), F.lit(per_cell))), F.lit(0)).alias("frontier_capacity"))


def rewards(graded: DataFrame, correct: str, predicted: str) -> DataFrame:
    """score, overall, accuracy and format per response; without a box all are 0 but nothing is lost from the denominator."""
    hit = F.coalesce(F.col(correct), F.lit(False)).cast("double")
    boxed = F.col(predicted).isNotNull().cast("double")
    return graded.withColumns({"score": hit * boxed, "overall": hit * boxed, "accuracy": hit * boxed, "format": boxed})


def mean_entropy(values: Column, mask: Column, vocab: int) -> Column:
    """Mean token entropy over the mask, over the logarithm of the vocabulary; null outside [-1e-6, 1.000001], else clamped to [0, 1]."""
    kept = F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: x["m"] > 0)
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["v"]) / F.nullif(F.size(kept), F.lit(0)) / F.log(F.lit(float(vocab)))
    return F.when((F.size(kept) > 0) & mean.between(-1e-6, 1.000001), F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)))


def overlong(tokens: Column, most: int) -> tuple[Column, Column]:
    """(status, reject_reason) of a response by its length."""
    return F.when(tokens >= most, "rejected").otherwise("accepted"), F.when(tokens >= most, "max_tokens_reached")
