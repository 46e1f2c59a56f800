"""Dense row numbers that continue over appended batches.

A ledger beside the rows says which range each batch has. The range is reserved before the rows are
written, so a batch that fails and is repeated gets the same numbers, and one that is repeated after it was
written is passed over.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators.numbering import with_row_number
from docquarry.session import committed_batches

_RANGE = "start long, rows long"


@dataclass(frozen=True)
class NumberedTable:
    """Rows of ``schema`` under the folder ``path``, numbered from ``first`` in the column ``name``, which the
    schema does not have. Within a batch numbers follow ``order``. One writer at a time."""

    path: str
    schema: T.StructType
    order: tuple[str, ...]
    name: str = "id"
    first: int = 1

    def ledger(self, spark: SparkSession) -> dict[int, tuple[int, int]]:
        """First number and number of rows of each batch that has a range; one entry per batch."""
        done = committed_batches(spark, f"{self.path}/ledger")
        if not done:
            return {}
        rows = spark.read.schema(_RANGE + ", batch int").option("basePath", f"{self.path}/ledger").parquet(
            *[f"{self.path}/ledger/batch={b}" for b in done])
        return {r["batch"]: (r["start"], r["rows"]) for r in rows.collect()}

    def reserve(self, spark: SparkSession, batch: int, rows: int) -> int:
        """The first number of ``batch``: as before if it has a range, else after all others."""
        ledger = self.ledger(spark)
        if batch in ledger:
            start, before = ledger[batch]
            if before != rows:
                raise ValueError(f"batch {batch} had {before} rows and has {rows} now")
            return start
        start = max((s + n for s, n in ledger.values()), default=self.first)
        spark.createDataFrame([(start, rows)], _RANGE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")
        return start

    def append(self, df: DataFrame, batch: int) -> None:
        """Number the rows of ``df`` and add them as ``batch``, unless it is there.

        ``df`` has to give the same rows when it is computed again. Rows that agree in all columns share
        their numbers among them in any order.
        """
        spark = df.sparkSession
        if batch in committed_batches(spark, f"{self.path}/rows"):
            return
        own = df.select(*self.schema.names)
        start = self.reserve(spark, batch, own.count())
        with_row_number(own, list(self.order), self.name, start).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows of finished batches, with their numbers."""
        schema = T.StructType([*self.schema.fields, T.StructField(self.name, T.LongType())])
        done = committed_batches(spark, f"{self.path}/rows")
        if not done:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.path}/rows/batch={b}" for b in done])

    def append_stream(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Number and add all available input, each micro-batch under its own number, then stop."""
        query = (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
                 .foreachBatch(self.append).start())
        query.awaitTermination()
        return query
