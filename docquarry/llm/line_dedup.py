"""Line dedup by pairwise alignment.

A line ends at a line break or after a sentence, so that a passage is found also where it was joined to other
text of its line.

1. A seed is the hash of the shortest run of lines from a given line on, or up to one, that has enough words. Seeds are
   rare by nature: a common short line makes none of its own. The document with the smallest id that holds
   a seed is its owner, and every later holder is paired with it, so that a passage in many documents gives
   as many pairs as holders.
2. The two documents of a pair are aligned line by line with patience diff. Runs that are equal but lie
   in another order, or more than once, are taken up from their seeds afterwards.
3. Aligned blocks with enough words are deleted from the later document. The owner keeps them.
4. A passage set into other text has a broken first and last sentence, and may hold no run of whole lines with
   enough words. Passages are therefore also found word by word. The mark of a passage-long window is the smallest
   hash of the shorter windows in it, as in winnowing, so equal windows have equal marks and neighbours
   mostly share theirs. Only windows whose mark two documents have are compared, by their own hash; every word of a
   window that an earlier document has is deleted, wherever in a line it stands.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docquarry.llm.common import broadcast_if_small, slices
from docquarry.llm.shingles import EXACT, chunks, mixed, powers, windows, word_hashes
from docquarry.session import arrow_batch_rows, materialize

#: Words that a common block must have to be deleted.
MIN_WORDS = 20
#: Words that a common passage must have to be deleted without regard to lines, and those of the windows that mark it.
PASSAGE_WORDS = 50
MARK_WORDS = 20
_BATCH_ROWS = 1024
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[33, 46, 63]] = True
_WORD = re.compile(rb"\S+")
_SEPARATOR = re.compile(rb"((?<=[.!?])[ \t]+|[ \t]*\r?\n)")


def split_lines(data: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and what separates each from the next; together they are the text."""
    parts = _SEPARATOR.split(data)
    return parts[::2], parts[1::2]


def without_lines(data: bytes, gone: set[int]) -> bytes:
    """``data`` without some of its lines and the separators after them; if the last one goes, the one before it too."""
    return _without(*split_lines(data), gone)


def _without(lines: list[bytes], separators: list[bytes], gone: set[int]) -> bytes:
    kept = [i for i in range(len(lines)) if i not in gone]
    ends = [*separators, b""]
    out = b"".join(lines[i] + (ends[i] if n < len(kept) - 1 else b"") for n, i in enumerate(kept))
    return out if out.strip() else b""


def without_passages(data: bytes, gone: set[int], starts: Sequence[int]) -> tuple[bytes, int]:
    """``data`` without some of its lines and without the passages from the words ``starts`` on, and how many lines lost words.

    A line that loses all its words goes as a whole, as do blank lines inside a passage.
    """
    lines, separators = split_lines(data)
    gone, cut = set(gone), 0
    if not len(starts):
        return _without(lines, separators, gone), len(gone)
    sizes = [len(line.split()) for line in lines]
    first = np.bincount(np.asarray(starts, dtype=np.int64), minlength=sum(sizes) + 1)
    open_at = np.cumsum(first)
    open_at[PASSAGE_WORDS:] -= open_at[:-PASSAGE_WORDS].copy()
    # Passages that a word is in, and those that go on into it from the word before.
    covered, inside = open_at > 0, open_at > first
    at = 0
    for i, size in enumerate(sizes):
        lost = covered[at:at + size]
        if not size:
            if inside[at]:
                gone.add(i)
        elif lost.all():
            gone.add(i)
        elif lost.any() and i not in gone:
            line, kept, end = lines[i], [], 0
            words = [m.span() for m in _WORD.finditer(line)]
            for j, (start, stop) in enumerate(words):
                if not lost[j]:
                    # The blanks before a kept word stay, but for those after a cut at the start of the line.
                    kept.append(line[0 if j == 0 else words[j - 1][1] if kept else start:stop])
                    end = stop
            lines[i], cut = b"".join(kept) + (line[end:] if not lost[-1] else b""), cut + 1
        at += size
    return _without(lines, separators, gone), len(gone) + cut


def runs(sizes: Sequence[int], least: int) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of the shortest run from each line on that has ``least`` words."""
    stop = total = 0
    for start, size in enumerate(sizes):
        while total < least and stop < len(sizes):
            total, stop = total + sizes[stop], stop + 1
        if total < least:
            return
        yield start, stop
        total -= size


def spans_of(words: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words between ``starts`` and ``stops``, from running sums."""
    up, down = powers(len(words))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(words.view(np.uint64)) * up[:len(words)])])
    return mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)).view(np.int64)


def _run_bounds(sizes: Sequence[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    words = np.concatenate([[0], np.cumsum(sizes)])
    stops = np.searchsorted(words, words[:-1] + least)
    starts = np.flatnonzero(stops < len(words))
    return starts, stops[starts]


def passage_marks(words: np.ndarray) -> np.ndarray:
    """The mark of the passage-long window from each word on: the smallest hash of the shorter windows in it."""
    if len(words) < PASSAGE_WORDS:
        return np.zeros(0, dtype=np.int64)
    least, width = windows(words, MARK_WORDS), 1
    while width < PASSAGE_WORDS - MARK_WORDS + 1:
        step = min(width, PASSAGE_WORDS - MARK_WORDS + 1 - width)
        least, width = np.minimum(least[:len(least) - step], least[step:]), width + step
    return least.view(np.int64)


def numbered_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash of each word, number of its line in its text, words before each text) for runs of texts; lines are numbered as
    :func:`split_lines` cuts them."""
    for data, bounds in chunks(column):
        words, counts, starts = word_hashes(data, bounds, EXACT, with_starts=True)
        # A separator is a line break, or a run of blanks after a sentence.
        breaks = np.flatnonzero(data == 10)
        gaps = np.flatnonzero(((data[1:] == 32) | (data[1:] == 9)) & _STOPS[data[:-1]]) + 1
        cuts = np.sort(np.concatenate([breaks, np.setdiff1d(gaps, bounds, assume_unique=True)]))
        before = np.repeat(np.searchsorted(cuts, bounds[:-1]), np.diff(counts))
        yield words, np.searchsorted(cuts, starts) - before, counts


def worded_lines(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, number of the line) of the words of each text in turn."""
    for words, number, counts in numbered_words(column):
        for a, b in zip(counts, counts[1:]):
            yield words[a:b], number[a:b]


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def line_columns(words: np.ndarray, number: np.ndarray, counts: np.ndarray, least: int) -> list[pa.Array]:
    """The columns of :func:`line_table` for texts whose words lie behind one another, all texts at once."""
    ends = np.repeat(counts[1:], np.diff(counts))
    firsts = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (ends[1:] != ends[:-1]))) if len(words) else np.zeros(0, np.int64)
    bounds = np.searchsorted(firsts, counts)
    stops = np.append(firsts[1:], len(words))[:len(firsts)]
    hashes, last = spans_of(words, firsts, stops), np.repeat(bounds[1:], np.diff(bounds))
    # The shortest run from each line on, and the one up to each line, where the text has enough words.
    run = np.searchsorted(stops, firsts + least) + 1
    starts = np.flatnonzero(firsts + least <= ends[firsts]) if len(firsts) else firsts
    begin = np.searchsorted(firsts, stops - least, side="right") - 1
    own = np.flatnonzero(stops - least >= np.repeat(counts[:-1], np.diff(bounds))) if len(firsts) else firsts
    own = own[(run[begin[own]] != own + 1) | (firsts[begin[own]] + least > ends[firsts[begin[own]]])]
    seeds, tails = spans_of(hashes, starts, run[starts]), spans_of(hashes, begin[own], own + 1)
    marks = passage_marks(words)
    at = np.flatnonzero(np.arange(len(marks)) + PASSAGE_WORDS <= ends[:len(marks)])
    # Neighbours mostly share their mark.
    at = at[np.append(True, (marks[at[1:]] != marks[at[:-1]]) | (ends[at[1:]] != ends[at[:-1]]))] if len(at) else at
    return [_lists(hashes, bounds, pa.int64()), _lists((stops - firsts).astype(np.int32), bounds, pa.int32()),
            _lists(number[firsts].astype(np.int32), bounds, pa.int32()), _lists(seeds, np.searchsorted(starts, bounds), pa.int64()),
            _lists(tails, np.searchsorted(own, bounds), pa.int64()), _lists(marks[at], np.searchsorted(at, counts), pa.int64())]


def _own(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def line_table(docs: DataFrame, least: int, doc: str, text: str) -> DataFrame:
    """``doc_id`` and of each text, from one pass: the numbers of its lines that have words with their hashes and sizes, the ``seeds``
    of runs from a line on, the ``tails`` of runs up to a line that are none of these, and the ``marks`` of its passages.

    A line's hash is that of its words, so blanks within a line do not count.
    """
    own = _own(docs, doc, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            at = 0
            for words, number, counts in numbered_words(batch.column(1)):
                columns = line_columns(words, number, counts, least)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(columns[0])), *columns], names=names)
                at += len(columns[0])

    names = ["doc_id", "hashes", "sizes", "numbers", "seeds", "tails", "marks"]
    return own.mapInArrow(run, "doc_id long, hashes array<long>, sizes array<int>, numbers array<int>, seeds array<long>, tails array<long>, marks array<long>")


def _sharing(held: DataFrame) -> DataFrame:
    owners = held.groupBy("seed").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    owners = broadcast_if_small(materialize(owners.select("seed", "owner")), F.lit(32))
    return held.join(owners, "seed").where("owner < doc_id").select("owner", "doc_id").distinct()


def pairs(lines: DataFrame) -> DataFrame:
    """``owner`` and ``doc_id`` of documents that share a seed; ids that repeat are one document.

    Where the first holder of a seed has only part of a block, the rest may be too short for a seed of its own. So
    documents in pairs also meet on the runs that end at a line.
    """
    met = materialize(_sharing(lines.select("doc_id", F.explode("seeds").alias("seed"))))
    found = broadcast_if_small(materialize(met.select("doc_id").union(met.select("owner")).distinct()), F.lit(16))
    tails = lines.select("doc_id", "tails").join(found, "doc_id", "left_semi").select("doc_id", F.explode("tails").alias("seed"))
    return met.union(_sharing(tails)).distinct()


def _ascending(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest part of ``points``, which are sorted by their first number, that also ascends in the second."""
    tails, ends, back = [], [], []
    for i, (_, y) in enumerate(points):
        at = bisect_left(tails, y)
        back.append(ends[at - 1] if at else -1)
        tails[at:at + 1], ends[at:at + 1] = [y], [i]
    chain, i = [], ends[-1] if ends else -1
    while i >= 0:
        chain.append(points[i])
        i = back[i]
    return chain[::-1]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned places of two line sequences: equal ends first, then lines that are unique in both."""
    found, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {h: j for j, h in enumerate(b[b0:b1], b0) if in_b[h] == 1}
        anchors = _ascending([(i, place[h]) for i, h in enumerate(a[a0:a1], a0) if in_a[h] == 1 and h in place])
        found += anchors
        for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            if anchors:
                gaps.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(found)


def common_lines(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, sizes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, last + 1) of blocks of lines of ``b`` with at least ``least`` words that ``a`` has too."""
    words, out = np.append(0, np.cumsum(sizes)), []
    covered = np.zeros(len(b) + 1, dtype=np.int64)

    def take(first: int, stop: int) -> None:
        if words[stop] - words[first] >= least:
            out.append((first, stop))
            covered[first:stop] = 1

    x, y = a.tolist(), b.tolist()
    aligned = patience(x, y)
    first = 0
    for n in range(1, len(aligned) + 1):
        if n == len(aligned) or aligned[n] != (aligned[n - 1][0] + 1, aligned[n - 1][1] + 1):
            take(aligned[first][1], aligned[n - 1][1] + 1)
            first = n
    a_runs, b_runs = _run_bounds(a_sizes, least), _run_bounds(sizes, least)
    place = dict(zip(spans_of(a, *a_runs)[::-1].tolist(), a_runs[0][::-1].tolist()))
    for seed, j, stop in zip(spans_of(b, *b_runs).tolist(), *(v.tolist() for v in b_runs)):
        i = place.get(seed)
        if i is None or covered[j:stop].all():
            continue
        n = 0
        while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
            n += 1
        take(j, j + n)
    return out


def _several(lines: DataFrame) -> DataFrame:
    """Ids that stand for several texts."""
    content = F.xxhash64("hashes", "numbers")
    return lines.groupBy("doc_id").agg(F.min(content).alias("lo"), F.max(content).alias("hi")).where("lo < hi").select("doc_id")


def repeated_lines(lines: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``doc_id`` and the numbers of its ``lines`` (from 0) that an earlier document has in a block.

    Ids that stand for several texts get none, since line numbers of one mean nothing in another.
    """
    met = materialize(pairs(lines))
    left = lines.select(F.col("doc_id").alias("owner"), F.col("hashes").alias("a"), F.col("sizes").alias("a_sizes"))
    right = lines.select("doc_id", F.col("hashes").alias("b"), "sizes", "numbers")
    # While the pairs are few, they are sent to both scans, and only lines of documents in pairs are shuffled.
    few = broadcast_if_small(met, F.lit(32))
    names = ["doc_id", "b", "sizes", "numbers", "a", "a_sizes"]
    sides = right.join(few, "doc_id").join(left.join(few.select("owner"), "owner", "left_semi"), "owner").select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for n, doc_id in enumerate(batch.column(0).to_pylist()):
                # One pair at a time, as views of the batch.
                b, sizes, numbers, a, a_sizes = (batch.column(k)[n].values.to_numpy() for k in range(1, 6))
                lost = np.zeros(int(numbers[-1]) + 1 if len(numbers) else 0, dtype=bool)
                for first, stop in common_lines(a, a_sizes, b, sizes, least):
                    # With the blank lines in the block and before it.
                    lost[int(numbers[first - 1]) + 1 if first else 0:int(numbers[stop - 1]) + 1] = True
                if lost.any():
                    ids.append(doc_id)
                    found.append(np.flatnonzero(lost).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "lines"])

    gone = sides.mapInArrow(run, "doc_id long, lines array<int>")
    return gone.join(_several(lines), "doc_id", "left_anti").groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))


def repeated_passages(own: DataFrame, lines: DataFrame, gone: DataFrame) -> DataFrame:
    """``doc_id`` and the ``starts`` (numbers of words, from 0) of its passage-long windows that an earlier document has.

    Windows that lie in ``gone`` lines are passed over: they are deleted, and an earlier document than theirs
    has them. Ids that stand for several texts get none.
    """
    held = lines.select("doc_id", F.explode("marks").alias("mark"))
    shared = held.groupBy("mark").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("mark")
    shared = broadcast_if_small(materialize(shared), F.lit(16))
    wanted = materialize(held.join(shared, "mark").groupBy("doc_id").agg(F.collect_set("mark").alias("marks"))
                         .join(gone.select("doc_id", F.col("lines").alias("gone")), "doc_id", "left"))
    texts = own.join(broadcast_if_small(wanted, 8 * F.size("marks") + 4 * F.coalesce(F.size("gone"), F.lit(0)) + 32), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, starts, found = [], [], []
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), worded_lines(batch.column(1)))
            for doc_id, marks, lost, (words, number) in rows:
                at = np.flatnonzero(np.isin(passage_marks(words), np.array(marks, dtype=np.int64)))
                if lost:
                    left = np.append(0, np.cumsum(~np.isin(number, lost)))
                    at = at[left[at + PASSAGE_WORDS] > left[at]]
                if len(at):
                    ids.append(doc_id)
                    starts.append(at.astype(np.int32))
                    found.append(windows(words, PASSAGE_WORDS)[at].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "starts", "windows"])

    placed = materialize(texts.select("doc_id", "text", "marks", "gone").mapInArrow(run, "doc_id long, starts array<int>, windows array<long>"))
    each = placed.select("doc_id", F.explode(F.arrays_zip("starts", "windows")).alias("w")).select("doc_id", "w.starts", F.col("w.windows").alias("window"))
    owners = each.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    owners = broadcast_if_small(materialize(owners.select("window", "owner")), F.lit(32))
    met = each.join(owners, "window").where("owner < doc_id").join(_several(lines), "doc_id", "left_anti")
    return met.groupBy("doc_id").agg(F.array_sort(F.collect_set("starts")).alias("starts"))


def without_repeats(docs: DataFrame, least: int = MIN_WORDS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` cut and the column ``n_deleted``, the lines that lost words, which replaces any of that name.

    Deleted are blocks of lines, compared word by word without blanks or blank lines, with at least ``least`` words that
    a document with a smaller id holds as well, and all words in passages of ``PASSAGE_WORDS`` words or more that
    one holds, compared word by word. A text is otherwise left as it is, down to its blanks; if no word
    is left it becomes empty. A NULL text stays NULL. Rows without an id are left alone. Rows
    that repeat an id are one document and are not compared with each other; those with several texts are
    left alone too. Ids have to be integers.
    """
    with arrow_batch_rows(docs.sparkSession, _BATCH_ROWS):
        lines = materialize(line_table(docs, least, doc, text))
        gone = materialize(repeated_lines(lines, least))
        passages = repeated_passages(_own(docs, doc, text), lines, gone)
    cuts = materialize(gone.join(passages, "doc_id", "full_outer").select(
        F.col("doc_id").alias("_doc"), F.coalesce("lines", F.array().cast("array<int>")).alias("_gone"),
        F.coalesce("starts", F.array().cast("array<int>")).alias("_starts")))
    marked = docs.join(broadcast_if_small(cuts, 4 * F.size("_gone") + 4 * F.size("_starts") + 48), F.col(doc).cast("long") == F.col("_doc"), "left")

    @F.pandas_udf("text string, n int")
    def cut(texts: pd.Series, gone: pd.Series, starts: pd.Series) -> pd.DataFrame:
        found = [(None, 0) if t is None or g is None else without_passages(t.encode(), set(g.tolist()), s) for t, g, s in zip(texts, gone, starts)]
        return pd.DataFrame({"text": pd.Series([None if t is None else t.decode() for t, _ in found], dtype=object), "n": pd.Series([n for _, n in found], dtype="int32")})

    # Only the texts that are cut are sent to Python for it. A filter on the result would else be pushed below, with a second call.
    cut = cut.asNondeterministic()
    kept = cut(F.when(F.col("_doc").isNotNull(), F.col(text)), F.col("_gone"), F.col("_starts"))
    columns = [c for c in docs.columns if c != "n_deleted"]
    return marked.withColumn("_cut", kept).select(
        *[F.when(F.col("_doc").isNull(), F.col(c)).otherwise(F.col("_cut.text")).alias(c) if c == text else F.col(c) for c in columns],
        F.when(F.col("_doc").isNull(), 0).otherwise(F.col("_cut.n")).alias("n_deleted"))
