"""Index sync as a stream: an append-only change log that is read as its latest state.

Parquet has no MERGE. Each micro-batch therefore writes its rows into a folder of its own, named
after the batch; a repeated batch overwrites just that folder. Readers take the newest row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators.index import latest_rows


def sync_stream(changes: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """Bring all new source rows into the index log, then stop."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{index_path}/sync_batch={batch_id}")

    query = (changes.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
             .foreachBatch(write_batch).start())
    query.awaitTermination()
    return query


def index_snapshot(spark: SparkSession, index_path: str, schema: T.StructType, key: str, version: str) -> DataFrame:
    """Current rows of the index: the highest version per key, the later batch for equal versions."""
    log = spark.read.schema(T.StructType([*schema.fields, T.StructField("sync_batch", T.LongType())])).parquet(index_path)
    return latest_rows(log, key, [version, "sync_batch"]).drop("sync_batch")


def compact_index(spark: SparkSession, index_path: str, schema: T.StructType, key: str, version: str, target: str) -> None:
    """Write the current rows as a fresh log with a single batch; the old log stays untouched."""
    index_snapshot(spark, index_path, schema, key, version).withColumn("sync_batch", F.lit(-1)).write.partitionBy(
        "sync_batch").parquet(target)
