"""Exact and approximate top-k similarity between two vector tables.

Both sides carry ``array<float>`` vectors. Scores are cosines rounded to six digits; equal scores
are ordered by the corpus key, so results do not depend on partitioning.

A query set below a byte bound is broadcast and the corpus is read once, without a shuffle, until
only k rows per query and task are left. A larger one is cut, like the corpus, into tiles of
bounded size, and each pair of tiles is one small matrix product. In neither case are the scores
of all pairs turned into rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from docquarry.functions.text import stage
from docquarry.session import materialize

BROADCAST_BYTES = 64 << 20
TILE_BYTES = 64 << 20
_SCORE_UNIT = 1_000_000
# Scores held at a time while one batch is compared, exact pairs at a time, rows per comparison, and
# the number of queries from which dropping copies first pays.
_BLOCK_CELLS = 1_000_000
_PAIRS = 200_000
_BATCH = 10_000
_MANY_QUERIES = 128
# Columns of a block that give a query without hits its first bar.
_FIRST_COLUMNS = 2500
# Pairs of tiles per core, and bytes of a hit while a task holds it.
_PAIRS_PER_CORE = 8
_HIT_BYTES = 32


@dataclass(frozen=True)
class VectorTable:
    """A table with a unique key of one or more columns and a vector column."""

    df: DataFrame
    key: tuple[str, ...]
    vector: str = "embedding"

    def vectors(self, dim: int, prefix: str) -> DataFrame:
        """Key and vector only, keys renamed; vectors of another dimension cannot be compared.

        The vector may come straight from a model: it is staged so that the dimension filter does
        not call the model a second time.
        """
        keyed = self.df.select(
            *[F.col(c).alias(f"{prefix}{i}") for i, c in enumerate(self.key)], F.col(self.vector).alias("_v"))
        return stage(keyed, {f"{prefix}vec": F.col("_v")}).drop("_v").where(F.size(f"{prefix}vec") == dim)

    def check_dimension(self, dim: int) -> None:
        """An error if there are vectors but none of this dimension, as with a wrong setting."""
        sizes = self.df.select(F.size(self.vector).alias("n")).where("n >= 0")
        first = sizes.first()
        if first is not None and first["n"] != dim and sizes.where(F.col("n") == dim).isEmpty():
            raise ValueError(f"no vector has dimension {dim}; the first has {first['n']}")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype=np.float64).reshape(len(column), dim)


def _finite(m: np.ndarray) -> np.ndarray:
    """Rows that can be compared. A NULL component arrives as NaN."""
    return np.isfinite(_norms(m))


def _parts(m: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of a large matrix, some at a time, so that no second one of its size is held."""
    return (m[at:at + _BATCH] for at in range(0, max(1, len(m)), _BATCH))


def _norms(m: np.ndarray) -> np.ndarray:
    return np.concatenate([np.sqrt((part * part).sum(axis=1)) for part in _parts(m)])


def _unit(m: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Unit rows in single precision, only for preselection; zero rows stay zero."""
    out = np.zeros(m.shape, dtype=np.float32)
    for part, to, n in zip(_parts(m), _parts(out), _parts(norms[:, None])):
        to[:] = np.divide(part, n, out=np.zeros_like(part), where=n > 0)
    return out


def _scaled(dots: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosines in whole millionths, halves rounded away from zero; 0 beside a zero vector."""
    cos = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
    return np.copysign(np.floor(np.abs(cos) * _SCORE_UNIT + 0.5), cos).astype(np.int64)


def _scaled_cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _scaled(q @ c.T, np.outer(_norms(q), _norms(c)))


def centre_ranks(m: np.ndarray, centres: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Whole numbers that order the centres by their nearness to each row, equal scores by position; of those ``at`` some positions or all."""
    at = np.arange(len(centres)) if at is None else at
    return at - _scaled_cosines(m, centres[at]) * len(centres)


@dataclass(frozen=True)
class Reach:
    """The centres that each query looks at: those of a rank, as of :func:`centre_ranks`, up to its limit."""

    limits: np.ndarray
    centres: np.ndarray


def _marked(flags: np.ndarray) -> np.ndarray:
    """Positions of the true flags, of which there are few: eight flags are looked at as one number."""
    flat = flags.reshape(-1)
    whole = len(flat) // 8 * 8
    cells = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([cells[flat[cells]], whole + np.flatnonzero(flat[whole:])])


def _place(ordered: np.ndarray) -> np.ndarray:
    """Position of each element within its run of equal elements."""
    return np.arange(len(ordered)) - np.searchsorted(ordered, ordered)


@dataclass(frozen=True)
class _Search:
    """What is looked for: sizes, filters and the names of the key columns."""

    k: int
    dim: int
    exclude_same: bool
    floor_units: int | None
    q_names: tuple[str, ...]
    c_names: tuple[str, ...]

    @property
    def margin(self) -> float:
        """Bound, in millionths, on the error of a single-precision cosine plus that of rounding."""
        return 2.0 + _SCORE_UNIT * (self.dim + 4) * 2.0**-23


def _first_copies(c: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first ``n`` rows of every distinct vector.

    Copies score alike and the smaller keys win, so later copies cannot be among the best n.
    """
    plain = np.ascontiguousarray(c)
    _, group = np.unique(plain.view(np.dtype((np.void, plain.dtype.itemsize * plain.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    return np.sort(order[_place(group[order]) < n])


class _Running:
    """The best k corpus rows per query among all batches compared so far.

    With a ``reach`` a query is compared only with rows whose centre it looks at.
    """

    def __init__(self, keys: pa.Table, vectors: np.ndarray, search: _Search, reach: Reach | None = None):
        usable = _finite(vectors)
        keys, vectors = keys.filter(pa.array(usable)), vectors if usable.all() else vectors[usable]
        self.keys, self.q, self.search = keys, vectors, search
        self.reach = None if reach is None else Reach(reach.limits[usable], reach.centres)
        self.norms = _norms(vectors)
        self.unit = _unit(vectors, self.norms)
        self.unit *= np.float32(_SCORE_UNIT)
        # Score of the k-th hit; a query with fewer hits accepts anything.
        self.bar = np.full(len(vectors), -np.inf)
        self.hits: pa.Table | None = None

    def add(self, c_keys: pa.Table, c: np.ndarray, cells: np.ndarray | None = None) -> None:
        """Compare with a batch; with a reach, ``cells`` are the positions of its rows' centres."""
        usable = _finite(c)
        c_keys, c = c_keys.filter(pa.array(usable)), c[usable]
        if not len(c) or not len(self.q):
            return
        # In key order, so that positions break ties.
        order = pc.sort_indices(c_keys, sort_keys=[(n, "ascending") for n in c_keys.column_names]).to_numpy()
        if cells is not None:
            cells = cells[usable]
        if len(self.q) >= _MANY_QUERIES:
            # Copies in different cells do not stand for one another.
            order = order[_first_copies(c[order] if cells is None else np.column_stack([c[order], cells[order]]), self._wanted)]
        c_keys, c = c_keys.take(pa.array(order)), c[order]
        held = None if cells is None else np.unique(cells[order], return_inverse=True)
        norms = _norms(c)
        unit = _unit(c, norms)
        step = max(1, _BLOCK_CELLS // max(1, len(c)))
        # One block of scores and flags serves all steps, so its memory is not asked for anew each time.
        block = np.empty(min(step, len(self.q)) * len(c), dtype=np.float32), np.empty(min(step, len(self.q)) * len(c), dtype=bool)
        found: list[pa.Table] = []
        rows, cols, n = [], [], 0
        for at in range(0, len(self.q), step):
            r, j = self._preselect(at, min(at + step, len(self.q)), unit, held, block)
            rows.append(r)
            cols.append(j)
            n += len(r)
            if n >= _PAIRS or at + step >= len(self.q):
                found += self._exact(np.concatenate(rows), np.concatenate(cols), c_keys, c, norms)
                rows, cols, n = [], [], 0
        self._merge(pa.concat_tables(found))

    @property
    def _wanted(self) -> int:
        """One hit more than k is needed if the row itself may be among them."""
        return self.search.k + self.search.exclude_same

    def _preselect(self, lo: int, hi: int, unit: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None,
                   block: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be among the best, with some that are not. ``held`` are the cells of the batch and each row's place among them."""
        near, likely = (part[:(hi - lo) * len(unit)].reshape(hi - lo, len(unit)) for part in block)
        np.matmul(self.unit[lo:hi], unit.T, out=near)
        if held is not None:
            within = centre_ranks(self.q[lo:hi], self.reach.centres, held[0]) <= self.reach.limits[lo:hi, None]
            near[~within[:, held[1]]] = -np.inf
        bar = self.bar[lo:hi].copy()
        open_rows = np.flatnonzero(np.isneginf(bar))
        n = near.shape[1]
        if len(open_rows) and n > self._wanted:
            # The best of some columns are at most as good as those of all, so nothing is lost.
            some = near[:, ::max(1, n // max(_FIRST_COLUMNS, 2 * self._wanted))][open_rows]
            bar[open_rows] = np.partition(some, some.shape[1] - self._wanted, axis=1)[:, some.shape[1] - self._wanted]
        if self.search.floor_units is not None:
            bar = np.maximum(bar, self.search.floor_units)
        np.greater_equal(near, (bar - self.search.margin).astype(np.float32)[:, None], out=likely)
        found = _marked(likely if held is None else likely & (near > -np.inf))
        rows, cols = np.divmod(found, n)
        return lo + rows, cols

    def _exact(self, rows: np.ndarray, cols: np.ndarray, c_keys: pa.Table, c: np.ndarray,
               norms: np.ndarray) -> list[pa.Table]:
        return [self._exact_part(rows[at:at + _PAIRS], cols[at:at + _PAIRS], c_keys, c, norms)
                for at in range(0, max(1, len(rows)), _PAIRS)]

    def _exact_part(self, rows: np.ndarray, cols: np.ndarray, c_keys: pa.Table, c: np.ndarray,
                    norms: np.ndarray) -> pa.Table:
        """Exact scores of preselected pairs."""
        s = self.search
        scaled = _scaled(np.einsum("ij,ij->i", self.q[rows], c[cols]), self.norms[rows] * norms[cols])
        keep = np.ones(len(rows), dtype=bool)
        if s.floor_units is not None:
            keep &= scaled >= s.floor_units
        if s.exclude_same:
            same = np.ones(len(rows), dtype=bool)
            for left, right in zip(self.keys.columns, c_keys.columns):
                equal = pc.equal(left.take(pa.array(rows)), right.take(pa.array(cols)))
                same &= equal.to_numpy(zero_copy_only=False).astype(bool)
            keep &= ~same
        rows, cols, scaled = rows[keep], cols[keep], scaled[keep]
        # Copies of one vector all tie, so only k rows per query leave here.
        order = np.lexsort((cols, -scaled, rows))
        order = order[_place(rows[order]) < s.k]
        rows, cols, scaled = rows[order], cols[order], scaled[order]
        picked = c_keys.take(pa.array(cols))
        return pa.table({"_q": pa.array(rows), **dict(zip(s.c_names, picked.columns)), "scaled": pa.array(scaled)})

    def _merge(self, new: pa.Table) -> None:
        """Only the hits of queries that have new ones are ranked again."""
        if not len(new):
            self.hits = new if self.hits is None else self.hits
            return
        k, kept = self.search.k, []
        hits = new
        if self.hits is not None:
            touched = np.zeros(len(self.q), dtype=bool)
            touched[new["_q"].to_numpy()] = True
            again = touched[self.hits["_q"].to_numpy()]
            hits = pa.concat_tables([self.hits.filter(pa.array(again)), new])
            kept = [self.hits.filter(pa.array(~again))]
        order = [("_q", "ascending"), ("scaled", "descending")] + [(n, "ascending") for n in self.search.c_names]
        hits = hits.sort_by(order).combine_chunks()
        q = hits["_q"].to_numpy()
        place = _place(q)
        self.hits = pa.concat_tables([*kept, hits.filter(pa.array(place < k))]).combine_chunks()
        last = place == k - 1
        self.bar[q[last]] = hits["scaled"].to_numpy()[last]

    def result(self) -> pa.Table:
        """Query key, corpus key and score of what was kept."""
        found = self.hits
        own = self.keys.take(found["_q"])
        return pa.table({**dict(zip(self.search.q_names, own.columns)),
                         **{n: found[n] for n in self.search.c_names}, "scaled": found["scaled"]})


def _finish(local: DataFrame, queries: VectorTable, corpus: VectorTable, k: int) -> DataFrame:
    """Global ranking over the few local winners, with the callers' key names restored.

    Corpus keys that clash with query keys get the suffix ``_hit``.
    """
    nq, nc = len(queries.key), len(corpus.key)
    best = Window.partitionBy(*[f"q{i}" for i in range(nq)]).orderBy(
        F.desc("scaled"), *[F.asc(f"c{i}") for i in range(nc)])
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(
        *[F.col(f"q{i}").alias(name) for i, name in enumerate(queries.key)],
        *[F.col(f"c{i}").alias(name + "_hit" if name in queries.key else name) for i, name in enumerate(corpus.key)],
        "rank",
        (F.col("scaled") / float(_SCORE_UNIT)).alias("score"),
    )


def _default_tile_rows(dim: int) -> int:
    return max(1, TILE_BYTES // (4 * dim))


def _key_names(df: DataFrame, vector: str) -> tuple[str, ...]:
    return tuple(c for c in df.columns if c != vector)


def _local_schema(q: DataFrame, c: DataFrame) -> T.StructType:
    fields = [f for f in q.schema.fields if f.name != "qvec"] + [f for f in c.schema.fields if f.name != "cvec"]
    return T.StructType([*fields, T.StructField("scaled", T.LongType())])


def _typed(table: pa.Table, schema: pa.Schema) -> pa.Table:
    return table.select(schema.names).cast(schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def similarity_topk(queries: VectorTable, corpus: VectorTable, k: int, dim: int, *, exclude_same: bool = False,
                    min_score: float | None = None, broadcast_bytes: int = BROADCAST_BYTES,
                    tile_rows: int | None = None) -> DataFrame:
    """The k corpus rows nearest to each query: query key, corpus key, ``rank``, ``score``.

    ``exclude_same`` drops the corpus row whose key equals the query key; ``min_score`` drops rows
    below a cosine before ranking. A query may have fewer than k rows, or none.
    """
    q, c = queries.vectors(dim, "q"), corpus.vectors(dim, "c")
    floor_units = None if min_score is None else int(ceil(min_score * _SCORE_UNIT - 1e-6))
    schema = _local_schema(q, c)
    search = _Search(k, dim, exclude_same, floor_units, _key_names(q, "qvec"), _key_names(c, "cvec"))
    # Counting reads no vectors, so no model runs for it.
    corpus.check_dimension(dim)
    # Keys go to the driver and to every task with the vectors, and k rows per query come out of every task.
    key_bytes = sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in queries.key)
    counted = queries.df.agg(F.count(F.lit(1)).alias("n"), F.sum(key_bytes).alias("bytes")).first()
    n_queries = counted["n"]
    if n_queries * (dim * 8 + _HIT_BYTES * k) + (counted["bytes"] or 0) <= broadcast_bytes:
        local = _broadcast_topk(q.toArrow(), c, schema, search)
    else:
        cores = queries.df.sparkSession.sparkContext.defaultParallelism
        n_corpus = corpus.df.count()
        q_tiles = tile_count(n_queries, tile_rows or _BATCH, max(1, TILE_BYTES // (4 * dim + _HIT_BYTES * min(k, max(1, n_corpus)))), cores)
        local = _tiled_topk(q, c, schema, search, q_tiles, tile_count(n_corpus, tile_rows or _BATCH, _default_tile_rows(dim), cores))
    return _finish(local, queries, corpus, k)


def tile_count(rows: int, least: int, most: int, cores: int) -> int:
    """Into how many tiles a side is cut. Its rows go to every tile of the other side, so there are only as many as
    a tile of ``most`` rows and pairs of tiles for all cores ask for, and no tile is made for fewer than ``least`` rows."""
    spread = ceil((_PAIRS_PER_CORE * cores) ** 0.5)
    return max(1, ceil(rows / most), min(ceil(rows / least), spread))


def _broadcast_topk(head: pa.Table, c: DataFrame, schema: T.StructType, search: _Search, reach: Reach | None = None,
                    cell_names: pa.Array | None = None) -> DataFrame:
    """With a ``reach``, the corpus rows have the name of their ``cell``, one of ``cell_names``, which lie as its centres do."""
    shared = c.sparkSession.sparkContext.broadcast((head, reach, cell_names))
    arrow = _arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, reach, names = shared.value
        running = _Running(queries.select(search.q_names), _matrix(queries["qvec"], search.dim), search, reach)
        for batch in batches:
            if len(batch) and len(queries):
                table = pa.Table.from_batches([batch])
                cells = None if reach is None else pc.index_in(table["cell"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
                running.add(table.select(search.c_names), _matrix(table["cvec"], search.dim), cells)
        if running.hits is not None and len(running.hits):
            yield from _typed(running.result(), arrow).to_batches()

    return c.mapInArrow(scan, schema)


def _tiled_topk(q: DataFrame, c: DataFrame, schema: T.StructType, search: _Search, q_tiles: int,
                c_tiles: int) -> DataFrame:
    """Compare tile with tile. Every (query tile, corpus tile) pair is one group of bounded size."""
    q_tiles, c_tiles = max(1, q_tiles), max(1, c_tiles)
    q_side = q.withColumn("_qt", F.pmod(F.xxhash64(*search.q_names), F.lit(q_tiles)).cast("int")).withColumn(
        "_ct", F.explode(F.sequence(F.lit(0), F.lit(c_tiles - 1))))
    c_side = c.withColumn("_ct", F.pmod(F.xxhash64(*search.c_names), F.lit(c_tiles)).cast("int")).withColumn(
        "_qt", F.explode(F.sequence(F.lit(0), F.lit(q_tiles - 1))))
    return _cogrouped(q_side, c_side, ["_qt", "_ct"], schema, search)


def _cogrouped(q_side: DataFrame, c_side: DataFrame, on: list[str], schema: T.StructType, search: _Search) -> DataFrame:
    arrow = _arrow_schema(schema)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return arrow.empty_table()
        running = _Running(left.select(search.q_names), _matrix(left["qvec"], search.dim), search)
        for at in range(0, len(right), _BATCH):
            part = right.slice(at, _BATCH)
            running.add(part.select(search.c_names), _matrix(part["cvec"], search.dim))
        return _typed(running.result(), arrow)

    return q_side.groupBy(*on).cogroup(c_side.groupBy(*on)).applyInArrow(compare, schema)


def reached_topk(queries: VectorTable, corpus: VectorTable, centres: DataFrame, n_probe: int, k: int, dim: int, *,
                 exclude_same: bool = False) -> DataFrame:
    """As :func:`similarity_topk`, among the corpus rows in each query's ``n_probe`` nearest cells, in one scan.

    The corpus has a column ``cell``, ``centres`` have ``cell`` and ``centre``. No pair of query and cell becomes a row: with a
    query goes the rank of its last cell, and a task compares a query with those of its rows whose cell is within. Queries and
    centres must fit the broadcast bound.
    """
    named = centres.orderBy("cell").toArrow()
    matrix, names = _matrix(named["centre"], dim), named["cell"].combine_chunks()
    q, c = queries.vectors(dim, "q"), corpus.vectors(dim, "c")
    search = _Search(k, dim, exclude_same, None, _key_names(q, "qvec"), _key_names(c, "cvec"))
    head = _with_limits(q, matrix, n_probe, dim).toArrow()
    reach = Reach(head["_limit"].to_numpy(), matrix)
    # The cell is read beside the vector, which cannot be staged anew here: it is a stored column.
    keyed = corpus.df.select(*[F.col(name).alias(f"c{i}") for i, name in enumerate(corpus.key)], F.col(corpus.vector).alias("cvec"), "cell")
    local = _broadcast_topk(head, keyed.where(F.size("cvec") == dim), _local_schema(q, c), search, reach, names)
    return _finish(local, queries, corpus, k)


def _with_limits(q: DataFrame, centres: np.ndarray, n: int, dim: int) -> DataFrame:
    """Add ``_limit``, the rank of the n-th nearest centre of each query."""
    shared = q.sparkSession.sparkContext.broadcast(centres)

    def limit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        step = max(1, _BLOCK_CELLS // len(cells))
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                ranks = centre_ranks(np.nan_to_num(_matrix(batch["qvec"], dim)), cells)
                yield batch.append_column("_limit", pa.array(np.partition(ranks, n - 1, axis=1)[:, n - 1]))

    spread = q.repartition(q.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(limit, T.StructType([*q.schema.fields, T.StructField("_limit", T.LongType())]))


def pick_centroids(corpus: VectorTable, n: int, dim: int) -> np.ndarray:
    """``n`` corpus vectors as cell centres, chosen by the hash of their key: a distributed top-n."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in corpus.key]))
    hashed = VectorTable(corpus.df.withColumn("_h", digest), ("_h",), corpus.vector).vectors(dim, "c")
    return _matrix(hashed.orderBy("c0").limit(n).toArrow()["cvec"], dim)


def with_nearest_cells(df: DataFrame, vector: str, centroids: np.ndarray, n: int, dim: int) -> DataFrame:
    """Add ``cells``, the ``n`` nearest centres of each row in order; row by row, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    arrow = _arrow_schema(schema)
    n = min(n, len(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        norms = _norms(cells)
        step = max(1, _BLOCK_CELLS // max(1, len(cells)))
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                m = np.nan_to_num(_matrix(batch.column(batch.schema.get_field_index(vector)), dim))
                scaled = _scaled(m @ cells.T, np.outer(_norms(m), norms))
                # Unique ranks: equal scores count by cell number.
                ranks = -scaled * len(cells) + np.arange(len(cells))
                order = np.argpartition(ranks, n - 1, axis=1)[:, :n]
                order = np.take_along_axis(order, np.argsort(np.take_along_axis(ranks, order, 1), 1), 1).astype(np.int32)
                table = pa.table({name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                                 | {"cells": pa.array(list(order), type=pa.list_(pa.int32()))})
                yield from _typed(table, arrow).to_batches()

    return df.mapInArrow(assign, schema)


def similarity_topk_approx(queries: VectorTable, corpus: VectorTable, k: int, dim: int, *, n_cells: int, n_probe: int,
                           exclude_same: bool = False, tile_rows: int | None = None) -> DataFrame:
    """Approximate top-k: corpus rows lie in the cell of their nearest centre, a query looks into
    its ``n_probe`` nearest cells. Exact when ``n_probe`` equals ``n_cells``.

    A cell may hold a large part of the corpus, so cells are cut into sub-tiles by their counted
    size, on both sides; the shuffle key is (cell, query tile, corpus tile).
    """
    if n_cells * dim * 8 > BROADCAST_BYTES:
        raise ValueError("the centres must fit the broadcast bound")
    tile_rows = tile_rows or _default_tile_rows(dim)
    centroids = pick_centroids(corpus, n_cells, dim)
    if not len(centroids):
        centroids = np.zeros((1, dim))
    q, c = queries.vectors(dim, "q"), corpus.vectors(dim, "c")
    schema = _local_schema(q, c)
    search = _Search(k, dim, exclude_same, None, _key_names(q, "qvec"), _key_names(c, "cvec"))
    # Both are read twice, for the cell sizes and for the comparison: they are written once.
    probes = materialize(
        with_nearest_cells(q, "qvec", centroids, n_probe, dim).withColumn("cell", F.explode("cells")).drop("cells"))
    placed = materialize(
        with_nearest_cells(c, "cvec", centroids, 1, dim).withColumn("cell", F.col("cells")[0]).drop("cells"))

    def tiles_of(df: DataFrame) -> dict[int, int]:
        # One row per cell, and the number of cells is bounded above.
        return {r["cell"]: max(1, ceil(r["count"] / tile_rows)) for r in df.groupBy("cell").count().collect()}

    q_tiles, c_tiles = tiles_of(probes), tiles_of(placed)

    def tile_count(tiles: dict[int, int]):
        split = {cell: n for cell, n in tiles.items() if n > 1}
        if not split:
            return F.lit(1)
        lookup = F.create_map(*[F.lit(x) for pair in split.items() for x in pair])
        return F.coalesce(lookup[F.col("cell")], F.lit(1))

    q_side = probes.withColumn("_qt", F.pmod(F.xxhash64(*search.q_names), tile_count(q_tiles)).cast("int")).withColumn(
        "_ct", F.explode(F.sequence(F.lit(0), tile_count(c_tiles) - 1)))
    c_side = placed.withColumn("_ct", F.pmod(F.xxhash64(*search.c_names), tile_count(c_tiles)).cast("int")).withColumn(
        "_qt", F.explode(F.sequence(F.lit(0), tile_count(q_tiles) - 1)))
    local = _cogrouped(q_side, c_side, ["cell", "_qt", "_ct"], schema, search)
    return _finish(local, queries, corpus, k)


def dimension_check(df: DataFrame, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined): vectors must have exactly the declared dimension and finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.coalesce((F.size(vector) == dim) & finite, F.lit(False))
    return df.where(fits), df.where(~fits)
