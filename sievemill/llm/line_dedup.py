"""Line dedup by overlapping windows of three lines.

Every window of three consecutive lines that are not blank, compared without white space at their ends, is hashed to 128
bits. The first occurrence of a window is the one of the smallest (document id, line); the lines of every later one are
removed, where covered positions of several windows are merged. Windows are counted by a map-side minimum before the
shuffle and joined back by a join that Spark can split at a hot window; only the positions to remove travel to the texts.

Defined cases: a null text stays null, one of fewer than three lines that are not blank stays as it is; blank lines are
never removed unless all others go, when the text is empty; a window that repeats within its own document counts as
repeated; rows of equal id and text are one occurrence, so neither is a copy of the other. Other columns come back as
they are, whatever their names, but for ones named as the two results, which those replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(5))


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_ld_id, _ld_k, _ld_at, _ld_h1, _ld_h2): the windows; _ld_at has the positions of its lines."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")).alias("t")))
    full = F.transform(F.filter(numbered, lambda x: x["t"] != ""), lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["t"]).alias("a"), F.xxhash64(x["t"], F.lit(1)).alias("b")))
    base = docs.select(F.col(id_col).alias("_ld_id"), _key(F.col(text_col)).alias("_ld_k"), full.alias("_f"))

    def one(k: Column) -> Column:
        x, y, z = (F.get(F.col("_f"), k + j) for j in range(WINDOW))
        return F.struct(F.array(x["i"], y["i"], z["i"]).alias("at"), F.xxhash64(x["a"], y["a"], z["a"]).alias("h1"), F.xxhash64(x["b"], y["b"], z["b"]).alias("h2"))

    # texts of too few lines give null; a filter by their number would be pushed below and split every text twice
    all_ = F.when(F.size("_f") >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_f") - WINDOW)), one))
    found = base.select("_ld_id", "_ld_k", F.explode_outer(all_).alias("_w")).where("_w is not null")
    return found.select("_ld_id", "_ld_k", F.col("_w.at").alias("_ld_at"), F.col("_w.h1").alias("_ld_h1"), F.col("_w.h2").alias("_ld_h2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text cleaned, and _ld_lines (lines before), _ld_removed (positions removed, ascending; null: none)."""
    own = {c: f"__in{i}_ld" for i, c in enumerate(docs.columns) if c.startswith("_ld")}
    docs = docs.drop("_ld_lines", "_ld_removed").withColumnsRenamed(own)
    found = _windows(docs, id_col, text_col)
    place = F.struct("_ld_id", "_ld_k", F.get("_ld_at", F.lit(0)).alias("i"))
    first = found.groupBy("_ld_h1", "_ld_h2").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first != _last").select("_ld_h1", "_ld_h2", "_first")
    later = found.join(first, ["_ld_h1", "_ld_h2"]).where(place != F.col("_first"))
    gone = later.groupBy("_ld_id", "_ld_k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ld_at")))).alias("_ld_removed"))
    both = docs.withColumn("_ld_key", _key(F.col(text_col))).join(gone, F.col(id_col).eqNullSafe(gone["_ld_id"]) & (F.col("_ld_key") == gone["_ld_k"]), "left").drop("_ld_id", "_ld_k", "_ld_key")
    both = both.withColumn("_ld_rows", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_ld_rows") - 1), F.col("_ld_removed"))
    text = F.array_join(F.transform(left, lambda i: F.get(F.col("_ld_rows"), i)), "\n")
    text = F.when(F.col("_ld_removed").isNull(), F.col(text_col)).when(F.trim(F.regexp_replace(text, r"\s+", "")) == "", "").otherwise(text)
    return both.withColumn("_ld_lines", F.size("_ld_rows")).withColumn(text_col, text).drop("_ld_rows").withColumnsRenamed({v: k for k, v in own.items()})
