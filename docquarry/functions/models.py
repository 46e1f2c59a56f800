"""Pluggable model functions and their deterministic local stand-ins.

A model function takes a list of inputs and returns a list of equal length. The stand-ins
exercise the data flow; they do not reach the quality of language or embedding models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
import hashlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from docquarry.config import EMBED_MAX_BATCH, HASH_DIM, TEXT_MAX_BATCH
from docquarry.functions.text import _col, keywords

ModelFn = Callable[[list], Sequence]


class _WordCodes(dict):
    """Word -> 2 * bucket + (1 if its sign is negative), filled on demand and bounded in size."""

    LIMIT = 1 << 16

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        digest = hashlib.md5(word.encode("utf-8")).hexdigest()
        code = self[word] = int(digest[:8], 16) % self.dim * 2 + (digest[8] >= "8")
        return code


@lru_cache(maxsize=4)
def _word_codes(dim: int) -> _WordCodes:
    return _WordCodes(dim)


class HashingEmbedder:
    """Signed word counts in ``dim`` hash buckets; expects normalised text."""

    def __init__(self, dim: int = HASH_DIM, unit_length: bool = False):
        self.dim = dim
        self.unit_length = unit_length

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [text.split(" ") if text else [] for text in texts]
        lengths = np.array([len(ws) for ws in split], dtype=np.int64)
        codes = np.fromiter(
            map(_word_codes(self.dim).__getitem__, chain.from_iterable(split)), dtype=np.int64, count=lengths.sum())
        rows = np.repeat(np.arange(len(texts)), lengths)
        out = np.bincount(rows * self.dim + (codes >> 1), weights=1 - 2 * (codes & 1), minlength=len(texts) * self.dim)
        out = out.reshape(len(texts), self.dim)
        if self.unit_length:
            norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
            out = np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
        return out.astype(np.float32)


def embed_with(model_fn: ModelFn, max_batch: int = EMBED_MAX_BATCH):
    """Pandas UDF text -> ``array<float>``; the model sees at most ``max_batch`` texts per call.

    Several such columns of one projection share a single exchange with the Python worker, which
    iterator UDFs cannot.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        present = [i for i, text in enumerate(texts) if text is not None]
        for at in range(0, len(present), max_batch):
            part = present[at:at + max_batch]
            vectors = model_fn([texts.iloc[i] for i in part])
            if len(vectors) != len(part):
                raise ValueError("the embedding model returned a wrong number of vectors")
            for i, vector in zip(part, vectors):
                out[i] = np.asarray(vector, dtype=np.float32)
        return pd.Series(out, dtype=object)

    return embed


def _rows(columns: pd.Series | tuple[pd.Series, ...]) -> list:
    """Spark hands over one column bare and several as a tuple."""
    return list(columns) if isinstance(columns, pd.Series) else list(zip(*columns))


def _batches(rows: list, size: int) -> list[list]:
    return [rows[at:at + size] for at in range(0, len(rows), size)]


def _checked(model_fn: ModelFn, rows: list) -> list:
    """Replies of one call; rows without a text (or with one missing) get no reply and are not sent."""
    sent = [i for i, row in enumerate(rows) if row is not None and not (isinstance(row, tuple) and None in row)]
    replies = list(model_fn([rows[i] for i in sent])) if sent else []
    if len(replies) != len(sent):
        raise ValueError("the model returned a wrong number of replies")
    out: list = [None] * len(rows)
    for i, reply in zip(sent, replies):
        out[i] = reply
    return out


def text_model(model_fn: ModelFn, threads: int = 1, max_batch: int = TEXT_MAX_BATCH):
    """Pandas UDF of one or more text columns -> text, for generators, rewriters and judges.

    One column is passed as a list of texts, several as a list of tuples, at most ``max_batch`` per call.
    ``threads`` bounds how many calls to a remote model run at a time in one task.
    """

    @F.pandas_udf("string")
    def call(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(max_workers=threads) as pool:
            for columns in batches:
                replies = pool.map(lambda part: _checked(model_fn, part), _batches(_rows(columns), max_batch))
                yield pd.Series(list(chain.from_iterable(replies)), dtype=object)

    return call


def guarded_text_model(model_fn: ModelFn, threads: int = 1, max_batch: int = TEXT_MAX_BATCH):
    """As :func:`text_model`, but a row whose call fails yields its error instead of failing the task.

    A batch that fails is repeated row by row, so that one bad row costs the others nothing.
    """
    def guarded(rows: list) -> list[tuple]:
        try:
            return [(reply, None) for reply in _checked(model_fn, rows)]
        except Exception as failure:
            if len(rows) == 1:
                return [(None, f"{type(failure).__name__}: {failure}")]
            return [answer for row in rows for answer in guarded([row])]

    @F.pandas_udf("value string, error string")
    def call(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=threads) as pool:
            for columns in batches:
                replies = list(chain.from_iterable(pool.map(guarded, _batches(_rows(columns), max_batch))))
                yield pd.DataFrame({"value": pd.Series([v for v, _ in replies], dtype=object),
                                    "error": pd.Series([e for _, e in replies], dtype=object)})

    return call


def overlap_count(left: Column, right: Column) -> Column:
    """Number of shared members of two keyword arrays."""
    return F.size(F.array_intersect(left, right))


def containment(part: Column, whole: Column) -> Column:
    """Share of ``part`` found in ``whole``; 0 for an empty part."""
    n = F.size(part)
    return F.when(n == 0, F.lit(0.0)).otherwise(overlap_count(part, whole) / n)


def overlap_f1(left: Column, right: Column) -> Column:
    """F1 of two keyword arrays; 0 if both are empty."""
    total = F.size(left) + F.size(right)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * overlap_count(left, right) / total)


def five_point(share: Column) -> Column:
    """Bucket a share in [0, 1] into a score of 1 to 5."""
    return F.least(F.lit(5), F.floor(share * 5).cast("int") + 1)


def relevance_reply(question: Column | str, follow_up_of: Column | str, terms: Sequence[str], min_hits: int) -> Column:
    """Stand-in for a gate model: "Yes" if enough domain terms occur in question and previous user turn."""
    domain = F.array(*[F.lit(t) for t in terms])
    asked = F.coalesce(_col(question), F.lit(""))
    before = F.coalesce(_col(follow_up_of), F.lit(""))
    hits = overlap_count(keywords(asked), domain) + overlap_count(keywords(before), domain)
    return F.when(F.trim(asked) == "", "unclear").when(hits >= min_hits, "Yes").otherwise("No")
