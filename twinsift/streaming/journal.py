"""Incremental ingestion of an append-only journal into a first-wins store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_arrivals(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of keys that arrive for the first time, in update mode: the first of their micro-batch.

    The state store keeps, per key, the first row and the times of its first and last
    micro-batch. All rows of a micro-batch carry the same time, which is kept with the batch and
    stays the same when it is run again; a key is new where both times are equal.
    """
    now = F.current_timestamp()
    whole = F.struct(*stream.columns)
    state = stream.withColumn("_now", now).groupBy(*keys).agg(
        F.min_by(whole, F.struct(*order)).alias("_row"),
        F.min("_now").alias("_first"), F.max("_now").alias("_last"))
    return state.filter(F.col("_first") == F.col("_last")).select("_row.*")


def append(batch: DataFrame, batch_id: int, store: str) -> None:
    """Each batch owns one partition of the store and overwrites it, so a replayed batch gives the same store."""
    batch.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")


def ingest(stream: DataFrame, store: str, checkpoint: str, keys: Sequence[str],
           order: Sequence[str]) -> StreamingQuery:
    """Start ingestion of everything that is available now; the query ends by itself.

    Which keys are known is state of the query: the store is written and never read.
    """
    return (first_arrivals(stream, keys, order).writeStream.outputMode("update")
            .foreachBatch(lambda df, i: append(df, i, store))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
