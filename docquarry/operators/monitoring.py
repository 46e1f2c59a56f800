"""Versions, runs and request logs."""

from __future__ import annotations

from collections.abc import Sequence
import time

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

OBSERVED = "log_rows"


def latest_version(runs: DataFrame, name: str, version: str) -> DataFrame:
    """Highest integer version per name, at least 1; versions that are no integer do not count."""
    number = F.expr(f"try_cast(`{version}` AS INT)")
    return runs.groupBy(name).agg(
        F.greatest(F.lit(1), F.coalesce(F.max(number), F.lit(1))).alias("latest_version"))


def compare_runs(metrics: DataFrame, config: Sequence[str], score: str) -> DataFrame:
    """Mean score per run configuration, best first. There are few configurations, so the final
    ranking works on the aggregated rows only."""
    means = metrics.groupBy(*config).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean_score"))
    best = Window.orderBy(F.desc("mean_score"), *config)
    return means.withColumn("rank", F.row_number().over(best))


def log_completeness(requests: DataFrame, log: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: requests sent, requests answered, and whether the log is complete."""
    answered = log.select(*key).distinct().withColumn("_seen", F.lit(1))
    return requests.select(*key).join(answered, list(key), "left").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count("_seen").alias("n_answered"),
    ).withColumn("complete", F.col("n_requests") == F.col("n_answered"))


def observed(stream: DataFrame) -> DataFrame:
    """``stream`` with a count of its rows that each micro-batch reports; see :func:`wait_for_rows`."""
    return stream.observe(OBSERVED, F.count(F.lit(1)).alias("n"))


def wait_for_rows(query: StreamingQuery, expected: int, seconds: float, poll: float = 0.2) -> int:
    """Rows the running ``query`` has reported once they are ``expected``, it has ended or ``seconds`` are over.

    Only reported counts are read, not the log. Progress is taken by batch, so a batch seen twice counts once. Spark
    keeps as many reports as ``spark.sql.streaming.numRecentProgressUpdates`` says; poll more often than these pass.
    """
    stop = time.monotonic() + seconds
    seen: dict[int, int] = {}
    while True:
        running = query.isActive
        for progress in query.recentProgress:
            row = progress.observedMetrics.get(OBSERVED)
            if row is not None:
                seen[progress.batchId] = max(seen.get(progress.batchId, 0), row["n"] or 0)
        total = sum(seen.values())
        if total >= expected or not running or time.monotonic() >= stop:
            return total
        time.sleep(poll)


def missing_keys(requests: DataFrame, log: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of requests without a row in the log; a key with a NULL is always missing."""
    return requests.select(*key).distinct().join(log.select(*key), list(key), "left_anti")
