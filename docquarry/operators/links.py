"""Turning answer sources into links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docquarry.functions.text import escape_spaces, file_name


def resolve_sources(answers: DataFrame, links: DataFrame, key: str, sources: str = "sources") -> DataFrame:
    """``(key, source_no, name, link)``: distinct sources in first-seen order with their link.

    ``links`` holds ``(file_name, link)`` with unique names. A source without a link keeps its name
    and has a NULL link. No join hint: Spark broadcasts the link table while it is small.
    """
    named = answers.select(
        key, F.posexplode(F.array_distinct(sources)).alias("source_no", "_source")
    ).select(key, "source_no", file_name("_source").alias("name"))
    return named.join(links.withColumnRenamed("file_name", "name"), "name", "left").select(
        key, "source_no", "name", escape_spaces("link").alias("link"))


def source_lists(resolved: DataFrame, key: str) -> DataFrame:
    """Back to one row per answer; its length is that of the original source list."""
    ordered = F.sort_array(F.collect_list(F.struct("source_no", "name", "link")))
    return resolved.groupBy(key).agg(
        F.transform(ordered, lambda s: F.coalesce(s["link"], s["name"])).alias("links"))
