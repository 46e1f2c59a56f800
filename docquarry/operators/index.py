"""Keeping a similarity index table in step with its source table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def latest_rows(changes: DataFrame, key: str, version: str | Sequence[str]) -> DataFrame:
    """Latest row per key: by the first version column, then the next one.

    Only the key and one version column are aggregated at a time, which hash aggregation does where the rows
    lie; the rows are then matched with their maximum. Rows that agree in all versions are told apart by a
    hash of their other columns; rows repeated whole count once.
    """
    rest = [c for c in changes.columns if c != key]
    left = changes.withColumn("_hash", F.xxhash64(*rest))
    for column in [*([version] if isinstance(version, str) else version), "_hash"]:
        newest = left.groupBy(F.col(key).alias("_key")).agg(F.max(column).alias("_newest"))
        left = left.join(newest, F.col(key).eqNullSafe(F.col("_key")) & F.col(column).eqNullSafe(F.col("_newest"))).drop("_key", "_newest")
    return left.select(key, *rest).distinct()


def missing_from_index(source: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Source rows whose key the index lacks."""
    return source.join(index.select(key), key, "left_anti")


def sync_index(source: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Index after a sync, with ``sync_action`` per row.

    Source rows replace index rows of the same key; rows whose key left the source are dropped.
    Both sides must hold a key once (see :func:`latest_rows`).
    """
    rest = [c for c in source.columns if c != key]
    same = F.lit(True)
    for c in rest:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"i.{c}"))
    joined = source.alias("s").join(index.withColumn("_in", F.lit(True)).alias("i"), key, "left")
    action = F.when(F.col("i._in").isNull(), "added").when(same, "kept").otherwise("updated")
    return joined.select(key, *[F.col(f"s.{c}").alias(c) for c in rest], action.alias("sync_action"))
