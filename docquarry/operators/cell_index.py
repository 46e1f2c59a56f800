"""A stored approximate index: built once, kept in step by batches, then only searched.

Rows lie in cells by the nearest of the trained centres. The first centres come from a bounded sample; cells that turn out
to hold too many rows are counted and split in parallel, each by centres of its own, until they are small enough, so neither
the number of centres nor that of rows is bounded. A search compares a query with the centres and opens the files of the
nearest cells alone; nothing is placed or written anew for it.

Changes come in numbered batches. A batch adds files to the cells and lists its keys, and rows of those keys in earlier batches
count no longer. Its commit is written last: a batch that failed before is not seen, one that is repeated after is passed over.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from docquarry.operators.retrieval import (
    BROADCAST_BYTES, VectorTable, _cogrouped, _default_tile_rows, _finish, _key_names, _local_schema, _matrix, _norms, _Search, _unit,
    dimension_check, reached_topk, similarity_topk, with_nearest_cells)
from docquarry.session import materialize

#: Rows of the sample per centre, centres that are trained on one sample, and bytes of a sample.
SAMPLED = 32
FIRST_CELLS = 4096
SAMPLE_BYTES = 32 << 20
ROUNDS = 10
#: Rounds of splitting; each makes a cell that is too large up to FIRST_CELLS times smaller.
SPLITS = 4
#: Beyond this many probed cells the join with the probes alone selects the files.
LISTED_CELLS = 10_000
#: From this share of the cells, and beyond the broadcast bound for the probes, one scan serves all queries.
SCANNED_SHARE = 0.1
_CENTRES = "cell string, centre array<double>"


def train(points: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``n`` different unit centres of ``points`` by spherical k-means, from evenly spaced first ones.

    A centre that loses all its points stays where it is. Zero vectors take no part.
    """
    unit = _unit(points, _norms(points))
    unit = unit[unit.any(axis=1)]
    first = np.unique(unit[:: max(1, len(unit) // max(1, n))][:n], axis=0)
    if not len(first):
        return np.zeros((1, points.shape[1]))
    centres = first.astype(np.float64)
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(unit[at:at + 4096] @ centres.T.astype(np.float32), axis=1) for at in range(0, len(unit), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        norms = _norms(sums)
        moved = norms > 1e-9
        centres[moved] = sums[moved] / norms[moved, None]
    return np.unique(centres, axis=0)


@dataclass(frozen=True)
class CellIndex:
    """``key`` is one unique column. ``cell_rows`` is the size that cells are made for; one of more than twice as many is split.

    Vectors of another dimension, or with a missing or non-finite component, are not stored. Copies of one vector
    cannot be split and share a cell; a search cuts such a cell into tiles.
    """

    path: str
    key: str
    vector: str
    dim: int
    key_type: T.DataType = T.LongType()
    cell_rows: int = 1000

    @property
    def _row_schema(self) -> T.StructType:
        return T.StructType([T.StructField(self.key, self.key_type), T.StructField(self.vector, T.ArrayType(T.FloatType())),
                             T.StructField("batch", T.LongType()), T.StructField("cell", T.StringType())])

    def centres(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_CENTRES).parquet(f"{self.path}/centres")

    def batches(self, spark: SparkSession) -> list[int]:
        """Committed batches in order."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        done = [s.getPath() for s in files.listStatus(folder) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("batch=")) for p in done)

    def build(self, corpus: DataFrame) -> None:
        """Train the centres on ``corpus`` and store it as batch 0. Keys must be unique; without rows there is one cell."""
        spark = corpus.sparkSession
        if self.batches(spark):
            raise ValueError(f"there is an index in {self.path}")
        rows = materialize(self._usable(corpus))
        bound = max(1, SAMPLE_BYTES // (4 * self.dim))
        n = max(1, min(ceil(rows.count() / self.cell_rows), FIRST_CELLS, ceil(bound / 8)))
        sample = rows.orderBy(F.xxhash64(self.key), self.key).limit(min(SAMPLED * max(n, SAMPLED), bound)).select(self.vector).toArrow()
        points = _matrix(sample[self.vector], self.dim) if len(sample) else np.zeros((1, self.dim))
        centres = spark.createDataFrame([(f"c{i}", c.tolist()) for i, c in enumerate(train(points, n))], _CENTRES)
        placed = materialize(self._placed(rows, centres))
        for _ in range(SPLITS):
            large = placed.groupBy("cell").count().where(F.col("count") > 2 * self.cell_rows)
            made = materialize(self._split(placed.join(large, "cell"), bound))
            if made.isEmpty():
                break
            parents = made.select("parent").distinct().withColumnRenamed("parent", "cell")
            centres = materialize(centres.join(parents, "cell", "left_anti").unionByName(made.drop("parent")))
            anew = self._placed(placed.join(parents, "cell", "left_semi").drop("cell"), made.drop("parent"))
            placed = materialize(placed.join(parents, "cell", "left_anti").unionByName(anew))
        centres.write.mode("overwrite").parquet(f"{self.path}/centres")
        self._write(placed, 0)
        self._commit(spark, 0)

    def _usable(self, df: DataFrame) -> DataFrame:
        kept = df.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast(self.key_type), F.col(self.vector).cast("array<float>"))
        return dimension_check(kept, self.vector, self.dim)[0]

    def _split(self, large: DataFrame, bound: int) -> DataFrame:
        """``cell``, ``centre`` and ``parent`` of the cells that take the place of large ones; each is trained on a bounded sample.

        A cell of copies of one vector gives no new ones.
        """
        schema = T.StructType.fromDDL(f"{_CENTRES}, parent string")
        vector, dim, cell_rows = self.vector, self.dim, self.cell_rows

        def split(group: pa.Table) -> pa.Table:
            parent, held = group["cell"][0].as_py(), group["count"][0].as_py()
            n = min(ceil(held / cell_rows), FIRST_CELLS, max(2, len(group) // 4))
            found = train(_matrix(group[vector], dim), n)
            found = found if len(found) > 1 else found[:0]
            return pa.table({"cell": pa.array([f"{parent}_{i}" for i in range(len(found))], pa.string()),
                             "centre": pa.array(list(found), pa.list_(pa.float64())), "parent": pa.array([parent] * len(found), pa.string())})

        order = Window.partitionBy("cell").orderBy(F.xxhash64(self.key), self.key)
        wanted = F.least(F.lit(bound), SAMPLED * F.ceil(F.col("count") / cell_rows))
        sample = large.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= bound).where(F.col("_n") <= wanted)
        return sample.select("cell", "count", vector).groupBy("cell").applyInArrow(split, schema)

    def _placed(self, rows: DataFrame, centres: DataFrame) -> DataFrame:
        """``rows`` with the ``cell`` of their nearest centre: in the scan while the centres are small, else by the tiled search."""
        if centres.count() * (self.dim * 8 + 64) <= BROADCAST_BYTES:
            named = centres.orderBy("cell").collect()
            matrix = np.array([r["centre"] for r in named])
            names = rows.sparkSession.createDataFrame([(i, r["cell"]) for i, r in enumerate(named)], "_i int, cell string")
            found = with_nearest_cells(rows, self.vector, matrix, 1, self.dim).withColumn("_i", F.col("cells")[0]).drop("cells")
            return found.join(F.broadcast(names), "_i").drop("_i")
        near = similarity_topk(VectorTable(rows, (self.key,), self.vector), VectorTable(centres, ("cell",), "centre"), 1, self.dim)
        return rows.join(near.select(self.key, "cell"), self.key)

    def _write(self, placed: DataFrame, batch_id: int) -> None:
        # Small cells share a task, large ones are spread.
        placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows/batch={batch_id}")

    def _commit(self, spark: SparkSession, batch_id: int) -> None:
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch_id}")

    def apply(self, changes: DataFrame, batch_id: int, deleted: str = "deleted") -> bool:
        """Add, replace and delete rows by key; False if the batch is there already. Batch numbers have to rise.

        Of several rows of a key a deletion wins, then the larger vector. NULL for the boolean is false, rows without a key are
        passed over. A key whose new vector cannot be used leaves the index.
        """
        spark = changes.sparkSession
        done = self.batches(spark)
        if not done:
            raise ValueError("build the index first")
        if batch_id <= done[-1]:
            return False
        gone = F.coalesce(F.col(deleted), F.lit(False))
        last = F.max(F.struct(gone.alias("gone"), F.col(self.vector).cast("array<float>").alias("v")))
        latest = materialize(changes.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).cast(self.key_type).alias(self.key)).agg(last.alias("_l")).select(
            self.key, F.col("_l.gone").alias("_gone"), F.col("_l.v").alias(self.vector)))
        self._write(self._placed(self._usable(latest.where("NOT _gone")), self.centres(spark)), batch_id)
        latest.select(self.key).write.mode("overwrite").parquet(f"{self.path}/changed/batch={batch_id}")
        self._commit(spark, batch_id)
        return True

    def rows(self, spark: SparkSession, cells: list[str] | None = None) -> DataFrame:
        """Key, vector and cell of what counts now, of some cells or of all; files of other cells are not opened."""
        done = self.batches(spark)
        if not done:
            return spark.createDataFrame([], self._row_schema).drop("batch")
        found = spark.read.schema(self._row_schema).parquet(f"{self.path}/rows").where(F.col("batch").isin(done))
        if cells is not None:
            found = found.where(F.col("cell").isin(cells))
        if len(done) > 1:
            schema = T.StructType([self._row_schema[self.key], T.StructField("batch", T.LongType())])
            changed = spark.read.schema(schema).parquet(f"{self.path}/changed").where(F.col("batch").isin(done)).groupBy(
                F.col(self.key).alias("_key")).agg(F.max("batch").alias("_last"))
            found = found.join(changed, (F.col(self.key) == F.col("_key")) & (F.col("batch") < F.col("_last")), "left_anti")
        return found.drop("batch")

    def probes(self, queries: VectorTable, n_probe: int) -> DataFrame:
        """The ``n_probe`` nearest cells of each query: its key and ``cell``."""
        centres = VectorTable(self.centres(queries.df.sparkSession), ("cell",), "centre")
        return similarity_topk(queries, centres, n_probe, self.dim).select(*queries.key, "cell")

    def search(self, queries: VectorTable, k: int, n_probe: int, *, exclude_same: bool = False, tile_rows: int | None = None) -> DataFrame:
        """As :func:`~docquarry.operators.retrieval.similarity_topk`, among the rows of each query's ``n_probe`` nearest cells.

        All cells need no probes. A large share of them for many queries is read in one scan, in which no probe is a row.
        """
        spark = queries.df.sparkSession
        n_cells = self.centres(spark).count()
        if n_probe >= n_cells:
            return similarity_topk(queries, VectorTable(self.rows(spark), (self.key,), self.vector), k, self.dim, exclude_same=exclude_same, tile_rows=tile_rows)
        if n_probe >= SCANNED_SHARE * n_cells and self._scanned(queries, k, n_probe, n_cells):
            return reached_topk(queries, VectorTable(self.rows(spark), (self.key,), self.vector), self.centres(spark), n_probe, k, self.dim,
                                exclude_same=exclude_same)
        tile_rows = tile_rows or _default_tile_rows(self.dim)
        probes = materialize(self.probes(queries, n_probe))
        listed = [r["cell"] for r in probes.select("cell").distinct().limit(LISTED_CELLS + 1).collect()]
        corpus = VectorTable(self.rows(spark, listed if len(listed) <= LISTED_CELLS else None), (self.key,), self.vector)
        q = queries.vectors(self.dim, "q")
        c = corpus.df.select(F.col(self.key).alias("c0"), F.col(self.vector).alias("cvec"), "cell")
        schema = _local_schema(q, c.drop("cell"))
        search = _Search(k, self.dim, exclude_same, None, _key_names(q, "qvec"), ("c0",))
        asked = probes.select(*[F.col(name).alias(f"q{i}") for i, name in enumerate(queries.key)], "cell")

        def tiles(df: DataFrame, name: str) -> DataFrame:
            return df.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias(name))

        # One row per cell: into how many tiles its queries and its rows are cut.
        cut = tiles(asked, "_qn").join(tiles(c.select("cell"), "_cn"), "cell")
        q_side = asked.join(cut, "cell").join(q, list(search.q_names)).withColumn(
            "_qt", F.pmod(F.xxhash64(*search.q_names), "_qn").cast("int")).withColumn("_ct", F.explode(F.sequence(F.lit(0), F.col("_cn") - 1)))
        c_side = c.join(cut, "cell").withColumn(
            "_ct", F.pmod(F.xxhash64("c0"), "_cn").cast("int")).withColumn("_qt", F.explode(F.sequence(F.lit(0), F.col("_qn") - 1)))
        local = _cogrouped(q_side.drop("_qn", "_cn"), c_side.drop("_qn", "_cn"), ["cell", "_qt", "_ct"], schema, search)
        return _finish(local, queries, corpus, k)

    def _scanned(self, queries: VectorTable, k: int, n_probe: int, n_cells: int) -> bool:
        """Whether probes with their vectors are too many to be sent, and queries and centres are not."""
        key_bytes = sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in queries.key)
        n, held = queries.df.agg(F.count(F.lit(1)), F.coalesce(F.sum(key_bytes), F.lit(0))).first()
        sent = n * (self.dim * 8 + 32 * k) + held
        return n * n_probe * (self.dim * 4 + 64) > BROADCAST_BYTES >= max(sent, n_cells * (self.dim * 8 + 64))


def recall(found: DataFrame, exact: DataFrame, query: str, hit: str) -> DataFrame:
    """One row: ``n_exact`` hits of the exact search, ``n_found`` of them found, and the ``recall``."""
    both = exact.select(query, hit).join(found.select(query, hit, F.lit(1).alias("_f")), [query, hit], "left")
    return both.agg(F.count("*").alias("n_exact"), F.count("_f").alias("n_found")).withColumn(
        "recall", F.round(F.col("n_found") / F.nullif(F.col("n_exact"), F.lit(0)), 4))
