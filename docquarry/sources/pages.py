"""Stored web pages and sitemaps. Fetching is left to a crawler; its log is the input here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docquarry.functions.html import element_html, nesting_element_html
from docquarry.functions.text import _col, stage
from docquarry.session import scan_partitions

FETCH_PARTITIONS = 10


def sitemap_urls(sitemaps: DataFrame, xml: str) -> DataFrame:
    """One row per ``loc`` of every sitemap document."""
    found = F.xpath(F.col(xml), F.lit("//*[local-name()='loc']/text()"))
    return sitemaps.select(F.explode(found).alias("url"))


def url_frame(spark: SparkSession, urls: Sequence[str] | DataFrame, max_documents: int | None = None,
              partitions: int = FETCH_PARTITIONS) -> DataFrame:
    """URLs to fetch, spread over at least ``partitions`` tasks; a limit takes the first ones in order."""
    df = urls if isinstance(urls, DataFrame) else spark.createDataFrame([(u,) for u in urls], "url string")
    if max_documents is not None:
        df = df.orderBy("url").limit(max_documents)
    return df.select("url").repartition(max(partitions, scan_partitions(df)))


def fetched_body(status: Column | str, body: Column | str) -> Column:
    """Body of a logged fetch, only for status 200."""
    return F.when(_col(status) == 200, _col(body))


def extract_article(pages: DataFrame, html: str, tag: str = "article", attribute: str | None = None,
                    value: str | None = None) -> DataFrame:
    """Add ``article``, the HTML of the wanted element, NULL when a page has none.

    An element chosen by attribute may nest in its own kind and needs tag counting.
    """
    # Staged, since a filter on the element usually follows and would search every page again.
    if attribute is None:
        return stage(pages, {"article": element_html(html, tag)})
    extracted = pages.withColumn("_article", nesting_element_html(tag, attribute, value or "")(F.col(html)))
    return stage(extracted, {"article": F.col("_article")}).drop("_article")


def require_rows(df: DataFrame, column: str, message: str = "no document has any text") -> DataFrame:
    """Rows with a value; an error when there are none. Looks for one row only."""
    kept = df.where(F.col(column).isNotNull())
    if kept.isEmpty():
        raise ValueError(message)
    return kept
