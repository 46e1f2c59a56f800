"""Stored web pages: element extraction and plain text."""

from __future__ import annotations

from collections.abc import Iterator
import re

import pandas as pd
from pyspark.sql import Column, functions as F

from docquarry.functions.text import _col


def element_html(html: Column | str, tag: str = "article") -> Column:
    """First ``tag`` element, trimmed; NULL when absent. For elements that do not nest."""
    body = F.regexp_extract(_col(html), rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>", 0)
    return F.nullif(F.trim(body), F.lit(""))


def nesting_element_html(tag: str, attribute: str, value: str):
    """Pandas UDF for elements that nest in themselves, such as ``div[itemprop=articleBody]``.

    Opening and closing tags have to be counted, which regular expressions cannot do.
    """
    tags = re.compile(rf"<(/?){re.escape(tag)}(?=[\s>])([^>]*)>", re.IGNORECASE)
    wanted = re.compile(rf"""\b{re.escape(attribute)}\s*=\s*["']?{re.escape(value)}["'\s>]""", re.IGNORECASE)

    def first_match(html: str | None) -> str | None:
        if html is None:
            return None
        start, depth = None, 0
        for m in tags.finditer(html):
            if start is None:
                if not m.group(1) and wanted.search(m.group(2) + ">"):
                    start, depth = m.start(), 1
            else:
                depth += -1 if m.group(1) else 1
                if depth == 0:
                    return html[start:m.end()].strip()
        return None

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(first_match)

    return extract


def html_text(html: Column | str) -> Column:
    """Text of an HTML fragment: tags dropped, the common entities resolved, blanks squeezed."""
    text = F.regexp_replace(_col(html), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def article_text(html: Column | str, tag: str = "article") -> Column:
    return html_text(element_html(html, tag))
