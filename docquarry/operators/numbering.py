"""Row keys, dense row numbers and pages without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from docquarry.session import materialize

_ROW_IN_PARTITION = (1 << 33) - 1


def hashed_key(*columns: Column | str) -> Column:
    """Deterministic BIGINT key; needs no shuffle and is stable across reruns and streams."""
    return F.xxhash64(*columns)


def with_row_number(df: DataFrame, order: Sequence[str], name: str = "id", start: int = 1) -> DataFrame:
    """Dense numbers in the order of the given columns, computed in parallel.

    Rows are range-partitioned and sorted; each task numbers its own rows; the sizes of the earlier
    partitions, one row per partition, are added. The sorted rows are written once because range
    bounds are sampled and two evaluations could cut differently. Rows with equal order columns are
    told apart by a hash of the others, so that a frequent value does not fill one partition.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rest = [c for c in df.columns if c not in order]
    keys = [*order, *([F.xxhash64(*rest)] if rest else [])]
    cut = materialize(
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_PARTITION)))
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    # At most one row per shuffle partition, hence safe to broadcast.
    return (
        cut.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row") + F.lit(start))
        .drop("_part", "_row", "_offset")
    )


def page_rows(df: DataFrame, order: Sequence[str], page_size: int) -> DataFrame:
    """Add ``page`` and ``row_in_page``, both from 0, for pages of ``page_size`` rows in key order."""
    numbered = with_row_number(df, order, "_rn", start=0)
    return (
        numbered.withColumn("page", F.floor(F.col("_rn") / page_size).cast("long"))
        .withColumn("row_in_page", (F.col("_rn") % page_size).cast("int"))
        .drop("_rn")
    )


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Reproducible sample: a row is kept by its key alone, however the table is partitioned."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie in [0, 1]")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return df.where(bucket < int(fraction * 2**32))


def seeded_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Spark's own sample; repeatable only while the partitioning stays the same."""
    return df.sample(fraction=fraction, seed=seed)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows by key: a distributed top-n, not a full sort."""
    return df.orderBy(*order).limit(n)
