"""Near-duplicates: banded MinHash, sequential Bayesian pruning, exact verification.

1. Every text becomes a set of hashed shingles and a signature. Texts of equal sets form one class,
   and from there on only one row per class takes part.
2. Classes that agree in all values of a band meet in a bucket. Buckets that share classes make up
   clusters, so every class is sent to its cluster once, not once per band.
3. Within a cluster, pairs that share a bucket have their signatures compared batch by batch. With ``m`` of
   ``n`` values equal, the similarity has a Beta(m + 1, n - m + 1) posterior; once the similarity bound
   is less likely than the chosen miss probability the pair is dropped. The rest is confirmed on the
   full sets, but for pairs that links found before already connect.

A large cluster is cut into tiles, and each pair of tiles is one group of bounded size. A group returns a
spanning forest of its links, so a large set of near copies gives as many links as members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docquarry.llm.common import never_sent, outgrows, same_keys, slices
from docquarry.llm.components import connected
from docquarry.llm.shingles import mixed, shingle_sets
from docquarry.session import materialize

_FACTORS = np.random.default_rng(20240301).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SET_ROWS = 4096
#: Classes and shingles that a tile is meant to have.
TILE_ROWS = 1024
TILE_SHINGLES = 1 << 20
_PAIRS = 1 << 16
# Pairs that are confirmed one by one; more of them are counted by matrix products.
_FEW_PAIRS = 20_000
_COLUMNS = 4096


@dataclass(frozen=True)
class NearDup:
    """Parameters. With 32 bands of 4 values a pair of similarity 0.8 is missed with probability 5e-8."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    batch: int = 32
    miss: float = 1e-9

    @property
    def length(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """(values compared, equal values below which a pair is dropped) after each batch."""
        t = self.percent / 100

        def posterior(n: int, m: int) -> float:
            return sum(comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))

        stops = range(self.batch, self.length + 1, self.batch)
        return [(n, next(m for m in range(n + 1) if posterior(n, m) >= self.miss)) for n in stops]


def signature(hashes: np.ndarray, length: int) -> np.ndarray:
    """Smallest value of the set under each of ``length`` hash functions, as 32-bit numbers."""
    best = np.full(length, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _SET_ROWS):
        block = hashes[at:at + _SET_ROWS, None] * _FACTORS[None, :length]
        np.minimum(best, block.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray, p: NearDup) -> np.ndarray:
    """One number per band; those of different bands do not meet."""
    keys = np.arange(1, p.bands + 1, dtype=np.uint64)
    for values in sig.reshape(p.bands, p.rows).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + values)
    return keys.view(np.int64)


def fingerprints(docs: DataFrame, p: NearDup, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n`` (set size), ``k1``, ``k2`` (a hash of the set) and ``bands`` of every row."""
    own = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            n, k1, k2, bands = [], [], [], []
            for s in shingle_sets(batch.column(1), p.words):
                n.append(len(s))
                k1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                bands.append(band_keys(signature(s, p.length), p) if len(s) else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "k1", "k2", "bands"])

    return own.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>")


def clusters(reps: DataFrame) -> DataFrame:
    """``node`` and ``cluster`` of the classes that share a bucket with another class."""
    placed = reps.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    met = placed.join(shared.select("bucket", "a"), "bucket").where("a < node")
    return connected(met.select("a", F.col("node").alias("b")).distinct()).withColumnRenamed("component", "cluster")


def tiles(nodes: DataFrame) -> DataFrame:
    """``node`` with the ``unit``, ``left`` and ``right`` tile of each group that it belongs to, and its ``side``.

    Small clusters are dealt out over units, one tile each. A cluster of more than a tile is a unit of its
    own, and its tiles meet in pairs, each tile also with itself.
    """
    total = nodes.agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).first()
    units = max(1, ceil(total["rows"] / TILE_ROWS), ceil((total["shingles"] or 0) / TILE_SHINGLES))
    need = F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    sizes = nodes.groupBy("cluster").agg(need.alias("tiles"))
    placed = nodes.join(sizes, "cluster").select(
        "node", F.when(F.col("tiles") > 1, F.col("cluster")).otherwise(-1 - F.pmod(F.xxhash64("cluster"), F.lit(units))).alias("unit"),
        "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return met.select("node", "unit", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"),
                      (F.col("tile") > F.col("other")).alias("side"))


def _sets(docs: DataFrame, wanted: DataFrame, p: NearDup, doc: str, text: str) -> DataFrame:
    """The columns of ``wanted``, each row with the signature and full shingle set of its node."""
    own = docs.select(F.col(doc).cast("long").alias("node"), F.col(text).cast("binary").alias("text")).join(
        never_sent(wanted) if outgrows(wanted, F.lit(48)) else F.broadcast(wanted), "node")
    names, kinds = wanted.columns, ", ".join(f"{name} {kind}" for name, kind in wanted.dtypes)
    own = own.select("text", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = list(shingle_sets(batch.column(0), p.words))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([signature(s, p.length).tobytes() for s in found], pa.binary()),
                 pa.array([s.tobytes() for s in found], pa.binary())], names=[*names, "sig", "hashes"])

    return own.mapInArrow(run, f"{kinds}, sig binary, hashes binary")


class _Forest:
    """Union-find over the rows of a group; the links that joined two trees are kept."""

    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


def _sharing(bands: np.ndarray, side: np.ndarray, both_sides: bool) -> np.ndarray:
    """Pairs of rows that agree in a band, from different sides if there are two."""
    n = len(bands)
    met = np.zeros((n, n), dtype=bool)
    for column in bands.T:
        order = np.argsort(column, kind="stable")
        cuts = np.flatnonzero(np.diff(column[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                met[np.ix_(group, group)] = True
    if both_sides:
        met &= side[:, None] != side[None, :]
    return np.argwhere(np.triu(met, 1))


def _plausible(pairs: np.ndarray, sigs: np.ndarray, sizes: np.ndarray, p: NearDup) -> np.ndarray:
    """Pairs that the sequential test leaves, the most similar first."""
    low, high = np.minimum(*sizes[pairs.T]), np.maximum(*sizes[pairs.T])
    pairs = pairs[100 * low >= p.percent * high]
    kept, counts = [], []
    for at in range(0, len(pairs), _PAIRS):
        part, begin = pairs[at:at + _PAIRS], 0
        equal = np.zeros(len(part), dtype=np.int64)
        for n, least in p.least_matches():
            equal = equal + (sigs[part[:, 0], begin:n] == sigs[part[:, 1], begin:n]).sum(axis=1)
            part, equal, begin = part[equal >= least], equal[equal >= least], n
        kept.append(part)
        counts.append(equal)
    return np.concatenate(kept)[np.argsort(-np.concatenate(counts), kind="stable")] if kept else pairs


def _common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with each other."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    rows = rows[shared]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((n, n), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        x = np.zeros((n, _COLUMNS), dtype=np.float32)
        x[rows[a:b], column[a:b] - first] = 1
        out += x @ x.T
    return out


def _linked(common: np.ndarray, m: np.ndarray, n: np.ndarray, p: NearDup) -> np.ndarray:
    return 100 * common >= p.percent * (m + n - common)


def spanning_links(bands: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], side: np.ndarray, both_sides: bool,
                   p: NearDup) -> list[tuple[int, int]]:
    """Links between rows that span what all links between them connect."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    pairs = _plausible(_sharing(bands, side, both_sides), sigs, sizes, p)
    forest = _Forest(len(sets))

    def confirm(part: np.ndarray) -> None:
        for i, j in part.tolist():
            if forest.root(i) != forest.root(j):
                common = sizes[i] + sizes[j] - len(np.union1d(sets[i], sets[j]))
                if _linked(common, sizes[i], sizes[j], p):
                    forest.link(i, j)

    confirm(pairs[:_FEW_PAIRS])
    rest = pairs[_FEW_PAIRS:]
    if len(rest):
        roots = np.array([forest.root(i) for i in range(len(sets))])
        rest = rest[roots[rest[:, 0]] != roots[rest[:, 1]]]
    if len(rest) <= _FEW_PAIRS:
        confirm(rest)
        return forest.links
    own, place = np.unique(rest, return_inverse=True)
    place = place.reshape(rest.shape)
    counts = _common_counts([sets[i] for i in own])[place[:, 0], place[:, 1]].astype(np.int64)
    for i, j in rest[_linked(counts, sizes[rest[:, 0]], sizes[rest[:, 1]], p)].tolist():
        forest.link(i, j)
    return forest.links


def links(grouped: DataFrame, p: NearDup) -> DataFrame:
    """``a`` and ``b`` of spanning links in every group of tiles."""
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sigs = np.frombuffer(b"".join(group["sig"].to_pylist()), dtype=np.uint32).reshape(-1, p.length)
        bands = np.stack([band_keys(s, p) for s in sigs])
        sets = [np.frombuffer(v, dtype=np.uint64) for v in group["hashes"].to_pylist()]
        side = group["side"].to_numpy(zero_copy_only=False)
        found = spanning_links(bands, sigs, sets, side, key[1].as_py() != key[2].as_py(), p)
        nodes = group["node"].to_numpy()
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())})

    return grouped.groupBy("unit", "left", "right").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, p: NearDup = NearDup(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Documents are linked when their shingle sets overlap by ``p.percent`` or more; ``component_id`` is the
    smallest id that links lead to and ``kept`` marks the document that has it. Texts that are NULL or
    without words are linked with nothing. A row without an id is linked with nothing, has no component
    and is kept. Repeated rows get the same values. Ids have to be integers. No other column is read.
    """
    prints = materialize(fingerprints(docs, p, doc, text))
    linkable = prints.where("n > 0 AND doc_id IS NOT NULL")
    key = ["k1", "k2", "n"]
    classes = materialize(linkable.groupBy(*key).agg(F.min("doc_id").alias("node")))
    classes = never_sent(classes) if outgrows(classes, F.lit(64)) else classes
    reps = linkable.withColumnRenamed("doc_id", "node").join(classes, [*key, "node"]).select("node", "bands")
    placed = clusters(reps)
    sizes = classes.groupBy("node").agg(F.max("n").alias("n"))
    wanted = materialize(tiles(materialize(placed.join(sizes, "node"))))
    found = materialize(links(_sets(docs, wanted, p, doc, text), p))
    labels = connected(found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    owner = classes.join(labels, "node", "left").select(*key, F.coalesce("component", "node").alias("component_id"))
    own = prints.select("doc_id", *key)
    joined = own.join(owner, same_keys(own, owner, key) & own["doc_id"].isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", own["n"].alias("n_shingles"), component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"))
