"""Corpus pipeline: quality, line dedup, one text of each near-duplicate class, benchmark decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, written as Parquet and read again before the
next; the last returns a row per document with its ids. A document is dropped for low quality, when line dedup leaves no
text of it, when a near duplicate of smaller id stays, or when it overlaps a benchmark item. Documents of null id are
scored, decontaminated and encoded like others; they are never a duplicate, as no class can name them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import decontaminate, jaccard, line_dedup, piece_codec, quality
from sievemill.llm.common import scratch, table
from sievemill.llm.queries import model_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of windows seen before; documents that lose all their text go. n_chars follows the text."""
    own = {c: f"{c}_of_documents" for c in ("_ld_lines", "_ld_removed") if c in docs.columns}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(own))
    out = out.where("_ld_removed is null or text != ''")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_ld_removed").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.drop(*own).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of linked documents."""
    return jaccard.keep_one(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers), and the digests of ids and decoded text."""
    out = piece_codec.encode_decode(docs, model_path())
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: The classifier and the tokenizer cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
