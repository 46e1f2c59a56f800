"""Near-duplicates by SimHash, compared in bit slices.

1. Every text becomes a 64-bit fingerprint of its word shingles. Rows of equal fingerprints form one class, and from
   there on only one row per class takes part.
2. Fingerprints that differ in at most ``radius`` bits agree in one of ``radius + 1`` parts of their bits. Classes
   that agree in a part meet in a bucket. A bucket with too many members is dealt out anew: the bits that are not yet
   fixed are split again, so its buckets shrink with every level and hold at most two to the number of free bits.
3. Buckets are dealt to bounded units. A unit stores its fingerprints vertically, one plane of bits per bit
   number, sorted by bucket. Shifting a plane by ``d`` rows and comparing it with itself gives one bit of the distances of
   all pairs ``d`` rows apart. These bits are added with carry-save adders into counters that are bit planes too.
   Blocks of 64 pairs are abandoned as soon as all of them exceed the radius.

A unit returns a spanning forest of its links, so a large set of alike fingerprints gives as many links as members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docquarry.llm.common import broadcast_if_small, slices
from docquarry.llm.components import connected
from docquarry.session import materialize

BITS = 64
SEED = 42
_SHINGLES = 1 << 16
#: Copies of a list of crowded buckets, so that the rows of one bucket spread over as many tasks.
_SALTS = 32
#: Planes that are added between two looks at which blocks are still alive.
_STEP = 8


@dataclass(frozen=True)
class SimHash:
    """``words`` of a shingle, ``radius`` of a link in bits; buckets above ``bucket_rows`` are dealt out anew."""

    words: int = 3
    radius: int = 2
    bucket_rows: int = 2048
    unit_rows: int = 1 << 14


def fingerprint(data: bytes, words: int) -> int:
    """Bits that are set in more than half of the shingles' hashes; 0 without words."""
    import xxhash

    parts = data.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    blanks = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate([[0], blanks + 1])[:n].tolist()
    stops = np.concatenate([blanks, [len(joined)]])[-n:].tolist()
    ones, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _SHINGLES):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _SHINGLES], stops[at:at + _SHINGLES])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, p: SimHash, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed number) of every row."""
    own = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [fingerprint(value or b"", p.words) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return own.mapInArrow(run, "doc_id long, fp long")


def parts(fixed: int, number: int) -> list[int]:
    """``fixed`` joined with each of ``number`` parts of the bits that it leaves free."""
    free = [bit for bit in range(BITS) if not fixed >> bit & 1]
    cuts = [len(free) * i // number for i in range(number + 1)]
    return [fixed | sum(1 << bit for bit in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def buckets(classes: DataFrame, p: SimHash) -> DataFrame:
    """``node``, ``fp``, ``mask`` and ``value`` (the masked bits): members of buckets of bounded size.

    Any two fingerprints within the radius share a bucket. Only keys and counts decide; crowded buckets are
    recognised by counts that are summed before the shuffle, and their members are dealt to several tasks.
    """
    spark, masks, done = classes.sparkSession, [0], None
    todo = classes.select("node", "fp", F.lit(0).cast("long").alias("mask"))
    while True:
        # At most radius + 1 times as many masks as in the level before, whatever the data.
        children = spark.createDataFrame([(_signed(mask), _signed(m)) for mask in masks for m in parts(mask, p.radius + 1)], "mask long, child long")
        dealt = materialize(todo.join(F.broadcast(children), "mask").select("node", "fp", F.col("child").alias("mask"))
                            .withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))))
        crowded = materialize(dealt.groupBy("mask", "value").count().where(F.col("count") > p.bucket_rows).select(
            "mask", "value", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt")))
        if crowded.isEmpty():
            return dealt if done is None else done.unionByName(dealt)
        masks = [r["mask"] & (1 << BITS) - 1 for r in crowded.select("mask").distinct().collect()]
        salted = dealt.withColumn("_salt", F.pmod(F.xxhash64("fp"), F.lit(_SALTS)).cast("int"))
        crowded, on = broadcast_if_small(crowded, F.lit(32)), ["mask", "value", "_salt"]
        rest = salted.join(crowded, on, "left_anti").select(dealt.columns)
        done = rest if done is None else done.unionByName(rest)
        todo = salted.join(crowded, on, "left_semi").select("node", "fp", "mask")


def _planes(fps: np.ndarray, pad: int) -> np.ndarray:
    """Row ``b`` holds bit ``b`` of all fingerprints, 64 to a number, and ``pad`` empty numbers at the end."""
    width = -(-len(fps) // 64) + pad
    out = np.zeros((BITS, 8 * width), dtype=np.uint8)
    for bit in range(BITS):
        packed = np.packbits((fps >> np.uint64(bit)) & np.uint64(1) != 0, bitorder="little")
        out[bit, :len(packed)] = packed
    return out.view("<u8")


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above the radius."""
    more, equal = over.copy(), np.full_like(over, np.iinfo(np.uint64).max)
    for level in reversed(range(len(counters))):
        if radius >> level & 1:
            equal &= counters[level]
        else:
            more |= equal & counters[level]
            equal &= ~counters[level]
    return more


def _add(counters: list[np.ndarray], over: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Carry-save addition of two planes into the counters; what does not fit sets the lane in ``over``."""
    half = counters[0] ^ x
    carry = (counters[0] & x) | (half & y)
    counters[0] = half ^ y
    for level in range(1, len(counters)):
        counters[level], carry = counters[level] ^ carry, counters[level] & carry
    over |= carry


def pairs_within(fps: np.ndarray, stops: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of fingerprints within the radius, for j in i + 1 to ``stops[i]`` - 1, by rising j - i."""
    rows = np.arange(len(fps))
    longest = int((stops - rows).max(initial=1))
    planes = _planes(fps, longest // 64 + 2)
    # Neighbouring bits belong to one part and agree together, so bits of all parts take turns.
    third = -(-BITS // (radius + 1))
    planes = planes[[b for first in range(third) for b in range(first, BITS, third)]]
    for d in range(1, longest):
        wanted = np.packbits(rows + d < stops, bitorder="little")
        wanted = np.concatenate([wanted, np.zeros(-len(wanted) % 8, dtype=np.uint8)]).view("<u8")
        live = np.flatnonzero(wanted)
        wanted, over = wanted[live], np.zeros(len(live), dtype=np.uint64)
        counters = [np.zeros(len(live), dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
        skip, shift = divmod(d, 64)
        for first in range(0, BITS, _STEP):
            block = planes[first:first + _STEP]
            moved = block[:, live + skip]
            if shift:
                moved = (moved >> np.uint64(shift)) | (block[:, live + skip + 1] << np.uint64(64 - shift))
            moved ^= block[:, live]
            for n in range(0, _STEP, 2):
                _add(counters, over, moved[n], moved[n + 1])
            near = wanted & ~_exceeds(counters, over, radius)
            alive = np.flatnonzero(near)
            if len(alive) < len(live):
                live, wanted, over, near = live[alive], wanted[alive], over[alive], near[alive]
                counters = [c[alive] for c in counters]
            if not len(live):
                break
        if len(live):
            at, lane = np.nonzero(np.unpackbits(near[:, None].view(np.uint8), axis=1, bitorder="little"))
            i = live[at] * 64 + lane
            yield i, i + d


def forest(fps: np.ndarray, stops: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect the rows that all links connect."""
    parent, kept = np.arange(len(fps)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs_within(fps, stops, radius):
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent[:] = above
        new = parent[i] != parent[j]
        for a, b in zip(i[new].tolist(), j[new].tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append((a, b))
    return kept


def links(placed: DataFrame, p: SimHash) -> DataFrame:
    """``a`` and ``b`` of spanning links of every unit of buckets."""
    units = max(1, ceil(placed.count() / p.unit_rows))

    def run(group: pa.Table) -> pa.Table:
        node, fp, mask, value = (group[name].to_numpy() for name in ("node", "fp", "mask", "value"))
        order = np.lexsort((fp, value, mask))
        node, fp, mask, value = node[order], fp[order].view(np.uint64), mask[order], value[order]
        ends = np.flatnonzero(np.append((mask[1:] != mask[:-1]) | (value[1:] != value[:-1]), True)) + 1
        stops = ends[np.searchsorted(ends, np.arange(len(fp)), side="right")]
        found = np.array(forest(fp, stops, p.radius), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": node[found[:, 0]], "b": node[found[:, 1]]})

    unit = F.pmod(F.xxhash64("mask", "value"), F.lit(units))
    return placed.withColumn("unit", unit).groupBy("unit").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, p: SimHash = SimHash(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of every row.

    Rows are linked when their fingerprints differ in at most ``p.radius`` bits; ``component_id`` is the smallest id
    that links lead to. A text that is NULL, empty or blank has the fingerprint zero and is linked like any other.
    A row without an id is linked with nothing and has no component. Repeated rows get the same
    values; rows that share an id but not a text connect what each of them is linked with. Ids have to be integers. No
    other column is read.
    """
    prints = materialize(fingerprints(docs, p, doc, text))
    known = prints.where("doc_id IS NOT NULL")
    classes = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    found = links(buckets(classes, p), p)
    # An id with several texts is one node with several fingerprints.
    several = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc_id")
    own = known.join(several, "doc_id", "left_semi").distinct().join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    edges = materialize(found.unionByName(own).where("a <> b"))
    labels = connected(edges.select("a", "b"))
    # A class of one row that no link touches is its own component, and its row needs no join.
    moved = classes.join(labels, "node", "left").where("n > 1 OR component IS NOT NULL").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("_component"))
    joined = prints.join(moved, (F.col("fp") == F.col("_fp")) & F.col("doc_id").isNotNull(), "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                         F.coalesce("_component", "doc_id").alias("component_id"))
