"""A deterministic stand-in for generated samples: every value is a function of request, purpose and index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def samples(requests: DataFrame, request: str, purpose: str, script: list[str], n: int) -> DataFrame:
    """n accepted samples per request: text from a cyclic script, entropy in [0.1, 0.9) from a hash; attempt 0."""
    texts = F.array(*map(F.lit, script))
    rows = requests.select(F.col(request).alias("request_id"), F.explode_outer(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_index"))
    digest = F.sha2(F.concat_ws("|", F.col("request_id").cast("string"), F.lit(purpose), F.col("sample_index").cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return rows.select(
        "request_id", F.lit(purpose).alias("purpose"), F.lit(0).alias("attempt"), "sample_index", F.get(texts, F.expr(f"cast(pmod(sample_index, {len(script)}) as int)")).alias("text"),
        (0.1 + (h % 800) / 1000).alias("entropy"), F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("reject_reason"),
    )
