"""A stored index table that is synced bucket by bucket.

Rows lie in buckets by the hash of their key. A sync reads and rewrites only the buckets that its changes touch, each
into a folder of its own, and ends with a manifest that says which folder holds which bucket. The manifest
is the commit: a batch that failed before leaves the index as it was, and a batch that is repeated after is passed
over. A deleted row stays as a marker, so that a late older change does not bring it back.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators.index import latest_rows

_MANIFEST = "bucket int, batch long"


@dataclass(frozen=True)
class BucketedIndex:
    """``schema`` has the ``key``, the ``version`` that orders changes of a key, and the other columns of the index."""

    path: str
    schema: T.StructType
    key: str
    version: str
    buckets: int = 256

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    @property
    def _stored_schema(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("_deleted", T.BooleanType()), T.StructField("_row_hash", T.LongType())])

    def _row_hash(self) -> Column:
        return F.xxhash64(*[c for c in self.schema.names if c not in (self.key, self.version)])

    def batches(self, spark: SparkSession) -> list[int]:
        """Batches that are committed, in order."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        done = [s.getPath() for s in files.listStatus(folder) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("batch=")) for p in done)

    def manifest(self, spark: SparkSession) -> dict[int, int]:
        """The batch that last wrote each bucket; at most one entry per bucket."""
        done = self.batches(spark)
        if not done:
            return {}
        rows = spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/batch={done[-1]}")
        return {r["bucket"]: r["batch"] for r in rows.collect()}

    def stored(self, spark: SparkSession, manifest: dict[int, int], buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows and markers of some buckets (default: all); no other file is opened."""
        wanted = manifest if buckets is None else [b for b in buckets if b in manifest]
        folders = [f"{self.path}/rows/batch={manifest[b]}/bucket={b}" for b in wanted]
        return spark.read.schema(self._stored_schema).parquet(*folders) if folders else spark.createDataFrame([], self._stored_schema)

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """Rows of the index as it is now."""
        return self.stored(spark, self.manifest(spark)).where("NOT _deleted").select(*self.schema.names)

    def apply(self, changes: DataFrame, batch_id: int, deleted: str = "deleted") -> list[int]:
        """Bring a batch of changes into the index; returns the buckets that were rewritten.

        ``changes`` has the index columns and a boolean that marks deletions. The highest version of a key wins; a stored
        row loses against a change of the same version. Of changes of one version a deletion wins, then the larger hash. Rows
        without a key are passed over, NULL for the boolean is false. Batches have to come with rising numbers; one that is committed is not done again.
        """
        spark = changes.sparkSession
        done = self.batches(spark)
        if done and batch_id <= done[-1]:
            return []
        manifest, names = self.manifest(spark), self.schema.names
        gone = F.coalesce(F.col(deleted), F.lit(False))
        new = latest_rows(changes.where(F.col(self.key).isNotNull()).select(*names, gone.alias("_deleted"), self._row_hash().alias("_row_hash")),
                          self.key, [self.version, "_deleted", "_row_hash"])
        touched = [r[0] for r in new.select(self._bucket()).distinct().collect()]
        old = self.stored(spark, manifest, touched)
        wins = F.col(f"n.{self.key}").isNotNull() & (F.col(f"o.{self.key}").isNull() | F.coalesce(F.col(f"n.{self.version}") >= F.col(f"o.{self.version}"), F.col(f"o.{self.version}").isNull()))
        same = F.col("o._row_hash").eqNullSafe(F.col("n._row_hash")) & F.col("o._deleted").eqNullSafe(F.col("n._deleted")) & F.col(
            f"o.{self.version}").eqNullSafe(F.col(f"n.{self.version}"))
        merged = old.alias("o").join(new.alias("n"), F.col(f"o.{self.key}") == F.col(f"n.{self.key}"), "full_outer").select(
            *[F.when(wins, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in self._stored_schema.names], (wins & ~same).alias("_changed"))
        merged = merged.withColumn("bucket", self._bucket())
        # Buckets in which every change turns out to be there already stay as they are.
        rewritten = sorted(r["bucket"] for r in merged.where("_changed").select("bucket").distinct().collect())
        if rewritten:
            kept = merged.where(F.col("bucket").isin(rewritten)).drop("_changed")
            kept.repartition(min(len(rewritten), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={batch_id}")
        after = manifest | dict.fromkeys(rewritten, batch_id)
        spark.createDataFrame(sorted(after.items()), _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch_id}")
        return rewritten

    def differences(self, source: DataFrame) -> DataFrame:
        """Changes that bring the index to ``source``, found by row hashes: of the index only key, version and hash are read.

        A key that left the source becomes a deletion with the next version, if that is a number. Source keys have to be unique.
        """
        spark = source.sparkSession
        known = self.stored(spark, self.manifest(spark)).where("NOT _deleted").select(F.col(self.key).alias("_key"), F.col(self.version).alias("_version"), F.col("_row_hash").alias("_old"))
        joined = source.select(*self.schema.names, self._row_hash().alias("_row_hash")).join(known, F.col(self.key) == F.col("_key"), "full_outer")
        left = F.col(self.key).isNull()
        columns = {self.key: F.coalesce(self.key, "_key"), self.version: F.when(left, F.col("_version") + 1).otherwise(F.greatest(F.col(self.version), F.col("_version") + 1))}
        moved = left | F.col("_key").isNull() | ~F.col("_row_hash").eqNullSafe(F.col("_old"))
        return joined.where(moved & F.coalesce(self.key, "_key").isNotNull()).select(
            *[columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in self.schema.fields], left.alias("deleted"))

    def sync_stream(self, changes: DataFrame, checkpoint: str, deleted: str = "deleted") -> StreamingQuery:
        """Bring all new changes of a stream into the index, then stop. A batch that is replayed counts once."""
        query = (changes.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
                 .foreachBatch(lambda batch, batch_id: self.apply(batch, batch_id, deleted) and None).start())
        query.awaitTermination()
        return query
