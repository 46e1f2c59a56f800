"""Splitting texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from bisect import bisect_left
from itertools import accumulate
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docquarry.functions.text import BLANK_RUN, BLANKS, SENTENCE, words

LengthFn = Callable[[list[str]], Sequence[int]]

#: Texts of an Arrow batch, and their chunks, that are Python strings at a time.
_TEXTS = 64

_FULL_STOP = re.compile(r" ?\.")
_SENTENCE = re.compile(SENTENCE)
_BLANKS = re.compile(BLANK_RUN)


def _whitespace_lengths(units: list[str]) -> list[int]:
    return [len(_BLANKS.split(u.strip(BLANKS))) if u.strip(BLANKS) else 0 for u in units]


def _cut(unit: str, size: int) -> list[str]:
    tokens = _BLANKS.split(unit.strip(BLANKS))
    return [" ".join(tokens[i:i + size]) for i in range(0, len(tokens), size)]


def pack_sentences(text: str, size: int, overlap: int, length_fn: LengthFn = _whitespace_lengths,
                   split_long: bool = False) -> list[str]:
    """Greedy packing: a chunk takes sentences up to ``size`` tokens, the next one starts with the
    trailing sentences of at most ``overlap`` tokens. A single longer sentence stays whole unless
    ``split_long`` is set.
    """
    units = [u for u in (m.strip(" ") for m in _SENTENCE.findall(_FULL_STOP.sub(".", text))) if u]
    if split_long:
        lengths = length_fn(units) if units else []
        units = [p for u, n in zip(units, lengths) for p in (_cut(u, size) if n > size else [u])]
    if not units:
        return []
    before = [0, *accumulate(length_fn(units))]
    chunks, first = [], 0
    for i in range(1, len(units)):
        if before[i + 1] - before[first] > size:
            chunks.append(" ".join(units[first:i]))
            # Token counts never fall, so the start of the carried tail can be searched for.
            first = bisect_left(before, before[i] - overlap, first, i)
    chunks.append(" ".join(units[first:]))
    return chunks


def sentence_chunker(size: int, overlap: int, length_fn: LengthFn = _whitespace_lengths, split_long: bool = False):
    """Arrow UDF text -> ``array<string>``. A packing decision depends on all earlier ones, which
    built-in functions can only express as a far slower fold."""

    def packed(text: str | None) -> list[str] | None:
        return None if text is None else pack_sentences(text, size, overlap, length_fn, split_long)

    @F.arrow_udf("array<string>")
    def chunk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), _TEXTS):
                yield pa.array([packed(t) for t in batch.slice(at, _TEXTS).to_pylist()], pa.list_(pa.string()))

    return chunk


def chunk_sentences(df: DataFrame, text: str, size: int, overlap: int, keys: Sequence[str],
                    length_fn: LengthFn = _whitespace_lengths, split_long: bool = False) -> DataFrame:
    """One row ``(*keys, chunk_no, content)`` per sentence chunk."""
    chunker = sentence_chunker(size, overlap, length_fn, split_long)
    return df.select(*keys, F.posexplode(chunker(F.col(text))).alias("chunk_no", "content"))


def window_starts(n_words: Column, size: Column | int, overlap: Column | int) -> Column:
    """First word of every window; each window after the first has a word the one before lacks."""
    size = F.lit(size) if isinstance(size, int) else size
    overlap = F.lit(overlap) if isinstance(overlap, int) else overlap
    return F.sequence(F.lit(0), F.greatest(n_words - overlap - 1, F.lit(0)), size - overlap)


def chunk_tokens(df: DataFrame, text: str, size: int, overlap: int, keys: Sequence[str]) -> DataFrame:
    """One row ``(*keys, chunk_no, content)`` per window of ``size`` words.

    The word array is used twice, so it stays a column of its own and is not recomputed for every
    window; only the keys travel past the explode.
    """
    tokens = df.where(F.col(text).rlike(f"[^{BLANKS}]")).select(*keys, words(text).alias("_words"))
    windows = F.transform(
        window_starts(F.size("_words"), size, overlap),
        lambda s: F.array_join(F.slice(F.col("_words"), s + 1, size), " "),
    )
    return tokens.select(*keys, F.posexplode(windows).alias("chunk_no", "content"))


def chunk_sweep(df: DataFrame, text: str, configs: Sequence[tuple[int, int]]) -> DataFrame:
    """Window statistics of several ``(size, overlap)`` settings from one pass over the texts.

    Settings are exploded from a literal array; only numbers are exploded, no chunk text.
    """
    settings = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap")) for s, o in configs])
    counted = df.where(F.col(text).rlike(f"[^{BLANKS}]")).select(F.size(words(text)).alias("n"))
    per_setting = counted.select("n", F.explode(settings).alias("c")).select("n", "c.size", "c.overlap")
    windows = per_setting.select(
        "size", "overlap", "n", F.explode(window_starts(F.col("n"), F.col("size"), F.col("overlap"))).alias("start")
    ).withColumn("len", F.least(F.col("size"), F.col("n") - F.col("start")))
    return windows.groupBy("size", "overlap").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum("len").alias("n_tokens"),
        F.min("len").alias("shortest"),
        F.max("len").alias("longest"),
    ).withColumn("mean_tokens", F.round(F.col("n_tokens") / F.col("n_chunks"), 6))
