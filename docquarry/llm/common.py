"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docquarry.session import materialize

ROWS_PER_GROUP = 1 << 12


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition that also lets NULL meet NULL."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def ranked_within(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str,
                  rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Add ``name``, a gapless number from 0 within each group, also for groups of any size.

    Groups are counted first. One of more than ``rows_per_group`` rows is cut into buckets by the hash of its
    order columns; the bucket sizes are counted, so each bucket is numbered on its own from the sum of
    those before it. The numbers follow the order columns within a bucket, not across a group. ``df`` is read
    three times. Group columns must not be NULL.
    """
    buckets = F.ceil(F.count("*") / rows_per_group).cast("int")
    sizes = materialize(df.groupBy(*group).agg(buckets.alias("_buckets")))
    keys = [*group, "_bucket"]
    dealt = df.join(broadcast_if_small(sizes, F.lit(16 * len(group) + 16)), list(group)).withColumn(
        "_bucket", F.pmod(F.xxhash64(*order), F.col("_buckets")).cast("int")).drop("_buckets")
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys).agg(F.count("*").alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return (local.join(starts, keys).withColumn(name, F.col("_start") + F.col("_place"))
            .select(*df.columns, name))


#: Tables that are sent to every executor must be smaller than this when written out as rows.
BROADCAST_BYTES = 32 << 20


def fits(df: DataFrame, width: Column, bound: int | None = None) -> bool:
    """Whether the rows of ``df``, of ``width`` bytes each, are within the bound for sending to all executors.

    ``df`` should be a written table, since it is read for this.
    """
    size = df.select(F.sum(width.cast("long")).alias("n")).first()["n"] or 0
    return size <= (BROADCAST_BYTES if bound is None else bound)


def broadcast_if_small(df: DataFrame, width: Column, bound: int | None = None) -> DataFrame:
    """``df`` marked for broadcasting if it :func:`fits`.

    Beyond the bound the join shuffles both sides and gives the same rows.
    """
    return F.broadcast(df) if fits(df, width, bound) else df


#: Spark plans by the size of files, in which rows of numbers are far smaller than in the table that the driver builds to send them.
SENT_BYTES = 8 << 20


def outgrows(df: DataFrame, width: Column) -> bool:
    """Whether the rows of the written table ``df`` are beyond what the driver is to hold of one table."""
    return not fits(df, width, min(SENT_BYTES, BROADCAST_BYTES))


def never_sent(df: DataFrame) -> DataFrame:
    """``df``, whose joins shuffle both sides however small Spark takes it to be."""
    return df.hint("shuffle_merge")


#: Parts that the rows of a frequent key are dealt to when the table they look up is too large to send.
SALTS = 16


def lookup_join(rows: DataFrame, found: DataFrame, key: str, width: Column) -> DataFrame:
    """``rows`` joined with the written table ``found`` on ``key``, which is not NULL and may be frequent in ``rows``.

    ``found`` is sent to the executors if it :func:`fits`. Otherwise it is shuffled, each row ``SALTS`` times, and
    the rows of one key go to as many partitions.
    """
    if fits(found, width):
        return rows.join(F.broadcast(found), key)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


#: Bytes of text that a task works on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], *columns: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the string or binary ``columns`` of each part hold about ``size`` bytes at most.

    What a task builds from a part is then bounded by bytes, however many rows Spark puts into a batch. When
    the input ends, Arrow's idle memory goes back to the system, since Python workers outlive their tasks.
    """
    for batch in batches:
        total = np.zeros(len(batch) + 1, dtype=np.int64)
        for column in columns:
            values = batch.column(column)
            offsets = np.frombuffer(values.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type) else np.int32)
            total += offsets[values.offset:values.offset + len(values) + 1]
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(total, total[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()
