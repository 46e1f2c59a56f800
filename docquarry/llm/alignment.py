"""Alignment of two tokenizers' tokens by merge-path partitioning.

1. Every text is encoded by both tokenizers. Only the ids are written; the ends of tokens in bytes follow from them.
2. Merging the ends of A and B, those of A first where both are equal, is a path through a grid. Diagonals of this grid
   at equal distances cut the path into pieces of equal work; where a diagonal meets the path is found by binary
   search, for all diagonals at once. From there on a piece needs no other: all pieces of a block walk in step. A piece emits a link
   for every state in which the A and the B token overlap, and an end of a group where both end. Numbers of
   groups are local to a piece at first; a running sum over the pieces stitches them together.
3. Links are counted per pair of ids over the whole corpus, in the tasks first.
4. Pairs that hold at least one of ``FREQUENT`` parts of all links can be at most as many, so they are sent to all tasks,
   whatever the corpus. The rest is joined by a shuffle, where then no pair is hot.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docquarry.llm.common import slices
from docquarry.session import materialize, shared_path

#: Steps of a piece, and pieces that walk together.
WIDTH = 64
PIECES = 4096
#: Pairs with at least this part of all links are looked up in the tasks.
FREQUENT = 1 << 16
#: Distinct pairs that a task counts before it passes them on.
_COUNTED = 1 << 20
_FAR = np.iinfo(np.int64).max
_SEPARATORS = (",", "|", ";", "")


@dataclass(frozen=True)
class Tokenizers:
    """Files of a byte-level BPE tokenizer (A) with the pattern that splits its words, and of a piece model (B)."""

    byte_level: str
    pieces: str
    pattern: str


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteLevel:
    """Ids and bytes of a byte-level BPE tokenizer; strings of special tokens in a text are plain text.

    Where ids rise in the order of the merges, they are the ranks that a faster encoder of the same tokens asks for.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, byte = spec["model"]["vocab"], byte_characters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.table = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.table[i] = token.encode() if token in special else bytes(byte[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merged = [vocabulary["".join(m)] for m in merges]
        plain = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        ranks = {self.table[i]: i for token, i in vocabulary.items() if token not in special}
        if plain and merged == sorted(set(merged)) and len(merged) + 256 == len(ranks):
            import tiktoken

            self._encode = tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self._encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [self._encode(text) for text in texts]


class Pieces:
    """Ids and bytes of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self._model.get_piece_size())
        self.table = [bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode()
                      for i, piece in ((i, self._model.id_to_piece(i)) for i in ids)]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self._model.encode(list(texts), num_threads=1)


@lru_cache(maxsize=1)
def _loaded(files: Tokenizers) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(files.byte_level, files.pattern), Pieces(files.pieces)


@lru_cache(maxsize=1)
def _sizes(files: Tokenizers) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every id of A and of B."""
    return tuple(np.array([len(t) for t in coder.table], dtype=np.int64) for coder in _loaded(files))


def encoded(docs: DataFrame, files: Tokenizers, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the ids ``a`` and ``b`` of every row, as 32-bit numbers; none if the bytes of a side differ from blank and text."""
    own = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _loaded(files)
        get = [first.table.__getitem__, second.table.__getitem__]
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            out = [], []
            for text, *ids in zip(texts, first.encode([" " + (t or "") for t in texts]), second.encode([t or "" for t in texts])):
                data = (" " + text).encode() if text else None
                whole = data is not None and all(b"".join(map(g, i)) == data for g, i in zip(get, ids))
                for side, i in zip(out, ids):
                    side.append(np.array(i if whole else [], dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(side, pa.binary()) for side in out)], names=["doc_id", "a", "b"])

    return own.mapInArrow(run, "doc_id long, a binary, b binary")


def meeting_points(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many ends of ``a`` lie on the merge path before each diagonal (number of ends merged), by binary search on all at once."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (low < high).any():
        open_ = low < high
        middle = (low + high) // 2
        # With an end of A no later than the last end of B before the diagonal, the path has passed it.
        passed = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(diagonals - middle - 1, 0, len(b) - 1)])
        low = np.where(passed, middle + 1, low)
        high = np.where(open_ & ~passed, middle, high)
    return low


def walked(a: np.ndarray, b: np.ndarray, width: int = WIDTH, pieces: int = PIECES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A and B token of every link, group of every A and of every B token) for rising ends that finish together.

    The links come in the order of the texts, groups are numbered from 0.
    """
    total = len(a) + len(b)
    a_group, b_group = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    links, groups = ([], []), 0
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), a_group, b_group
    starts = np.arange(0, total, width)
    firsts = meeting_points(a, b, starts)
    a, b = np.append(a, _FAR), np.append(b, _FAR)
    for at in range(0, len(starts), pieces):
        d, i = starts[at:at + pieces], firsts[at:at + pieces].copy()
        j = d - i
        shape = width, len(d)
        rows_i, rows_j = np.empty(shape, np.int64), np.empty(shape, np.int64)
        from_a, closing = np.empty(shape, bool), np.empty(shape, bool)
        for step in range(width):
            rows_i[step], rows_j[step] = i, j
            end = b[j]
            # The A token before ended with this B token: they are the end of a group, and the state is no overlap.
            closing[step] = a[i - 1] == end
            from_a[step] = take = a[i] <= end
            live = d + step < total
            i, j = i + (take & live), j + (~take & live)
        live = (d[None, :] + np.arange(width)[:, None] < total).T
        rows_i, rows_j, from_a, closing = rows_i.T, rows_j.T, from_a.T, closing.T & live
        linked = live & ~closing
        links[0].append(rows_i[linked])
        links[1].append(rows_j[linked])
        # Groups that closed before a step in its piece, and in the pieces before.
        inside = np.cumsum(closing, axis=1)
        group = inside - closing + (groups + np.cumsum(inside[:, -1]) - inside[:, -1])[:, None]
        groups += int(inside[:, -1].sum())
        a_group[rows_i[live & from_a]] = group[live & from_a]
        b_group[rows_j[live & ~from_a]] = group[live & ~from_a]
    return np.concatenate(links[0]), np.concatenate(links[1]), a_group, b_group


class Aligned:
    """The tokens, links and groups of a slice of texts, put behind one another."""

    def __init__(self, a: Iterable[bytes], b: Iterable[bytes], files: Tokenizers):
        sizes = _sizes(files)
        ids = [[np.frombuffer(v, dtype="<u4") for v in side] for side in (a, b)]
        self.counts = [np.array([len(i) for i in side], dtype=np.int64) for side in ids]
        self.bounds = [np.concatenate([[0], np.cumsum(n)]) for n in self.counts]
        self.a, self.b = (np.concatenate([*side, np.zeros(0, dtype="<u4")]).astype(np.int64) for side in ids)
        i, j, self.a_group, self.b_group = walked(np.cumsum(sizes[0][self.a]), np.cumsum(sizes[1][self.b]))
        self.pairs = self.a[i] * len(sizes[1]) + self.b[j]
        self.doc = np.searchsorted(self.bounds[0], i, side="right") - 1
        self.link_bounds = np.searchsorted(self.doc, np.arange(len(self.counts[0]) + 1))

    def digests(self, words: Sequence[Sequence[str]]) -> tuple[list[int], list[str]]:
        """(number of groups, SHA-256 of the groups written out) of each text; ``words`` has all ids before each separator."""
        groups = int(self.a_group[-1]) + 1 if len(self.a) else 0
        a_size, b_size = np.bincount(self.a_group, minlength=groups), np.bincount(self.b_group, minlength=groups)
        a_until, b_before = np.cumsum(a_size), np.cumsum(b_size) - b_size
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        a_last = np.zeros(len(self.a), dtype=np.int64)
        a_last[a_until - 1] = 1
        b_last = np.zeros(len(self.b), dtype=np.int64)
        b_last[np.cumsum(b_size) - 1] = 2
        last = self.bounds[1][1:][self.counts[1] > 0] - 1
        b_last[last] = 3
        codes[np.arange(len(self.a)) + b_before[self.a_group]] = self.a * 4 + a_last
        codes[np.arange(len(self.b)) + a_until[self.b_group]] = self.b * 4 + b_last
        bounds, counts, out = self.bounds[0] + self.bounds[1], [], []
        for n, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if lo == hi:
                counts.append(0)
                out.append("")
                continue
            lo_b, hi_b = self.bounds[1][n], self.bounds[1][n + 1]
            counts.append(int(self.b_group[hi_b - 1] - self.b_group[lo_b]) + 1)
            out.append(hashlib.sha256("".join(map(words.__getitem__, codes[lo:hi].tolist())).encode()).hexdigest())
        return counts, out


@lru_cache(maxsize=1)
def _written(ids: int) -> list[str]:
    """Every id below ``ids`` before each of the four separators."""
    return [f"{i}{s}" for i in range(ids) for s in _SEPARATORS]


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), dtype=np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return found, total


def pair_counts(ids: DataFrame, files: Tokenizers) -> DataFrame:
    """``pair`` (A id times the size of B's vocabulary, plus B id), ``n`` (its links) and ``best`` (no pair of its B id has more)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], names=["pair", "n"])

        for batch in slices(batches, 0, 1):
            found, n = np.unique(Aligned(batch.column(0).to_pylist(), batch.column(1).to_pylist(), files).pairs, return_counts=True)
            keys.append(found)
            counts.append(n)
            if sum(map(len, keys)) > _COUNTED:
                merged = _counted(keys, counts)
                keys, counts = [merged[0]], [merged[1]]
                if len(keys[0]) > _COUNTED // 2:
                    yield flush()
                    keys, counts = [], []
        if keys:
            merged = _counted(keys, counts)
            keys, counts = [merged[0]], [merged[1]]
            yield flush()

    width = len(_sizes(files)[1])
    counted = ids.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # A group of this window has at most as many rows as A has ids.
    most = F.max("n").over(Window.partitionBy(F.col("pair") % width))
    return counted.withColumn("best", F.col("n") == most)


def aligned(docs: DataFrame, files: Tokenizers, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256`` of every row.

    A group is what lies between two places where tokens of both end; a link is an A and a B token that share a byte.
    The count of a link is the number of links of its two ids in the whole corpus. ``n_best`` counts the links
    whose count is the highest of their B id, ``count_sum`` adds up the counts. A text that is NULL, empty or not
    given back by both tokenizers has no tokens: zeros and ''. Repeated rows count as often as they occur, and each gets its
    own row; ids are not compared. The tokens of one text are held in one task. Other columns are not read.
    """
    ids = shared_path(docs.sparkSession)
    encoded(docs, files, doc, text).withColumn("_row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(ids)
    ids = docs.sparkSession.read.schema("doc_id long, a binary, b binary, _row long").parquet(ids)
    counts = materialize(pair_counts(ids, files))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * FREQUENT >= F.lit(total)
    # At most FREQUENT rows, whatever the corpus.
    known = counts.where(often).orderBy("pair").toPandas()
    pair, value, best = (known[c].to_numpy() for c in ("pair", "n", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _written(max(map(len, _sizes(files))))
        for batch in slices(batches, 2, 3):
            own = Aligned(batch.column(2).to_pylist(), batch.column(3).to_pylist(), files)
            groups, digests = own.digests(words)
            links, at = np.unique(own.pairs, return_inverse=True)
            place = np.minimum(np.searchsorted(pair, links), max(len(pair) - 1, 0))
            there = pair[place] == links if len(pair) else np.zeros(len(links), bool)
            sums = [np.concatenate([[0], np.cumsum(x[at])]) for x in (np.where(there, value[place], 0), np.where(there, best[place], False).astype(np.int64))] \
                if len(pair) else [np.zeros(len(at) + 1, np.int64)] * 2
            count_sum, n_best = (s[own.link_bounds[1:]] - s[own.link_bounds[:-1]] for s in sums)
            # Of the other links, the distinct pairs of each text with their numbers.
            rare = np.flatnonzero(~there[at])
            order = rare[np.lexsort((at[rare], own.doc[rare]))]
            changes = np.flatnonzero(np.append(True, (at[order][1:] != at[order][:-1]) | (own.doc[order][1:] != own.doc[order][:-1]))) if len(order) else order
            times = np.diff(np.append(changes, len(order)))
            offsets = pa.array(np.searchsorted(own.doc[order[changes]], np.arange(len(batch) + 1)).astype(np.int32))
            longs = [pa.array(x, pa.int64()) for x in (*own.counts, groups, np.diff(own.link_bounds), n_best, count_sum)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *longs, pa.array(digests), pa.ListArray.from_arrays(offsets, pa.array(links[at[order[changes]]])),
                 pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))], names=names)

    names = ["_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rare", "times"]
    schema = ", ".join(f"{n} long" for n in names[:8]) + ", groups_sha256 string, rare array<long>, times array<long>"
    partial = materialize(ids.select("_row", "doc_id", "a", "b").mapInArrow(run, schema))
    rare = partial.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("_link")).select("_row", F.col("_link.rare").alias("pair"), "_link.times")
    met = rare.join(counts.where(~often), "pair").groupBy(F.col("_row").alias("_of")).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    return partial.join(met, F.col("_row") == F.col("_of"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
