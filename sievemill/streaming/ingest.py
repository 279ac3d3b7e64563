"""Streaming appends to the catalog's logs: each micro-batch writes only rows whose key is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievemill.operators.tables import append_new


def append_stream(rows: DataFrame, path: str, key: str, order: list[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes a stream into a Parquet table at path, the first row of each key; a batch that runs again after a failure adds nothing twice, as its keys are there."""
    schema = rows.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            there = spark.read.schema(schema).parquet(path)
            there.limit(1).count()
        except Exception as error:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            there = spark.createDataFrame([], schema)
        append_new(there, batch, key, [F.col(c) for c in order]).write.mode("append").parquet(path)

    out = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
