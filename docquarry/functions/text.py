"""Text functions as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping
import string

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\r\n"
BLANK_RUN = r"[ \t\r\n]+"
SENTENCE = r"[^.?!\n]+[.?!]*"
NOT_WORD = r"[^\p{L}\p{N}]+"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def stage(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    Catalyst merges projections and pushes filters below them, which copies an expression to every
    place that reads it: into each filter, and into lambdas, where it would run per array element.
    Neither passes the one-element generator used here.
    """
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(packed))


def words(text: Column | str) -> Column:
    """Whitespace-separated tokens; an empty text has none."""
    return F.array_remove(F.split(F.btrim(_col(text), F.lit(BLANKS)), BLANK_RUN), "")


def token_count(text: Column | str) -> Column:
    return F.size(words(text))


def normalize(text: Column | str) -> Column:
    """Lower case, every run of non-alphanumerics turned into one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), NOT_WORD, " "))


def keywords(text: Column | str) -> Column:
    """Distinct normalised words."""
    return F.array_distinct(F.array_remove(F.split(normalize(text), " "), ""))


def clean_text(section: Column | str) -> Column:
    """Remove line breaks inside a section and the blank before a full stop."""
    return F.regexp_replace(F.replace(_col(section), F.lit("\n"), F.lit("")), r" ?\.", ".")


def merge_sections(text: Column | str, separator: str = r"\n{2,}") -> Column:
    """Clean each section of a text and join the sections with one line break."""
    return F.array_join(F.transform(F.split(_col(text), separator), clean_text), "\n")


def sentences(text: Column | str) -> Column:
    """Sentence units: a run up to a sentence end or a line break, trimmed, never empty."""
    tidy = F.regexp_replace(_col(text), r" ?\.", ".")
    units = F.transform(F.regexp_extract_all(tidy, F.lit(SENTENCE), F.lit(0)), lambda u: F.trim(u))
    return F.filter(units, lambda u: u != "")


def syllable_count(text: Column | str) -> Column:
    """Vowel groups, the usual approximation."""
    return F.regexp_count(F.lower(_col(text)), F.lit("[aeiouy]+"))


def letter_count(text: Column | str) -> Column:
    return F.length(F.regexp_replace(_col(text), NOT_WORD, ""))


def flesch_kincaid(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Grade level from counts; NULL for a text without words."""
    w = F.nullif(n_words, F.lit(0))
    return 0.39 * (w / F.nullif(n_sentences, F.lit(0))) + 11.8 * (n_syllables / w) - 15.59


def automated_readability(n_letters: Column, n_words: Column, n_sentences: Column) -> Column:
    w = F.nullif(n_words, F.lit(0))
    return 4.71 * (n_letters / w) + 0.5 * (w / F.nullif(n_sentences, F.lit(0))) - 21.43


def render_prompt(template: str, slots: Mapping[str, Column | str]) -> Column:
    """Fill ``{name}`` slots of a template with columns.

    The template is taken apart once, on the driver; a slot-like text inside the data is
    therefore never expanded. A NULL value is rendered as an empty text.
    """
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in slots:
                raise KeyError(f"no value for prompt slot {name!r}")
            parts.append(F.coalesce(_col(slots[name]).cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def parse_label(reply: Column | str, strict: bool = False) -> Column:
    """``yes`` / ``no`` / ``other`` from a free-text reply, ``yes`` looked for first.

    The plain form matches anywhere in the reply, so "I know" counts as ``no``. With
    ``strict`` only whole words count.
    """
    lowered = F.lower(F.coalesce(_col(reply), F.lit("")))
    if strict:
        has_yes, has_no = lowered.rlike(r"\byes\b"), lowered.rlike(r"\bno\b")
    else:
        has_yes, has_no = lowered.contains("yes"), lowered.contains("no")
    return F.when(has_yes, "yes").when(has_no, "no").otherwise("other")


def json_field_or_raw(response: Column | str, key: str) -> Column:
    """A field of a JSON response; the response itself if it is no JSON or lacks the key.

    A field that is JSON ``null`` gives NULL, so that :func:`or_sentinel` can mark it.
    """
    raw = _col(response)
    parsed = F.try_parse_json(raw)
    # Quoted, so that a key with a dot or bracket is one key.
    path = f'$["{key}"]' if "'" in key else f"$['{key}']"
    field = F.try_variant_get(parsed, path, "variant")
    return (
        F.when(parsed.isNull() | field.isNull(), raw)
        .when(F.is_variant_null(field), F.lit(None).cast("string"))
        .otherwise(F.coalesce(F.try_variant_get(parsed, path, "string"), F.to_json(field)))
    )


def or_sentinel(value: Column | str, sentinel: str) -> Column:
    return F.coalesce(_col(value), F.lit(sentinel))


def file_name(url: Column | str) -> Column:
    """Last path segment without query and fragment."""
    return F.regexp_extract(F.regexp_replace(_col(url), r"[?#].*$", ""), r"[^/]+$", 0)


def strip_prefix(url: Column | str, prefix: str) -> Column:
    """Text after a fixed prefix; a value that lacks the prefix is kept."""
    c = _col(url)
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 2**31 - 1)).otherwise(c)


def newline_to_break(text: Column | str) -> Column:
    return F.replace(_col(text), F.lit("\n"), F.lit("<br/>"))


def escape_spaces(url: Column | str) -> Column:
    return F.replace(_col(url), F.lit(" "), F.lit("%20"))


def version_parts(tag: Column | str) -> Column:
    """Leading ``major.minor`` of a version tag as a comparable struct; NULL if there is none."""
    found = F.regexp_extract(_col(tag), r"^([0-9]+)\.([0-9]+)", 1)
    minor = F.regexp_extract(_col(tag), r"^([0-9]+)\.([0-9]+)", 2)
    return F.when(
        found != "", F.struct(found.cast("int").alias("major"), minor.cast("int").alias("minor"))
    )


def version_at_least(tag: Column | str, minimum: str) -> Column:
    """Compare versions number by number, so that 11.10 counts as later than 11.3."""
    major, minor = (int(p) for p in minimum.split(".")[:2])
    v = version_parts(tag)
    return (v["major"] > major) | ((v["major"] == major) & (v["minor"] >= minor))


def qualified_name(*parts: Column | str) -> Column:
    return F.concat_ws(".", *[_col(p) for p in parts])
