"""The stored approximate index: recall, splitting, synchronisation, and which files a search opens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import cell_index
from docquarry.operators.cell_index import CellIndex, recall, train
from docquarry.operators.retrieval import VectorTable, similarity_topk

DIM = 8


def table(spark, points, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<float>")


def clustered(n, clusters, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, DIM))
    return middle[rng.integers(clusters, size=n)] + 0.2 * rng.normal(size=(n, DIM))


def index(tmp_path, **more):
    return CellIndex(str(tmp_path / "index"), "id", "v", DIM, **more)


def hits(df):
    return sorted(tuple(r) for r in df.collect())


def test_train_gives_unit_centres_of_the_groups():
    points = np.repeat(np.eye(DIM), 20, axis=0) * 3
    assert np.allclose(train(points, DIM), np.unique(np.eye(DIM), axis=0))
    assert train(np.zeros((5, DIM)), 3).shape == (1, DIM) and len(train(np.ones((50, DIM)), 8)) == 1


def test_recall_with_a_tenth_of_the_rows(spark, tmp_path):
    rows = table(spark, clustered(3000, 40))
    stored = index(tmp_path, cell_rows=40)
    stored.build(rows)
    held = {r["cell"]: r["count"] for r in stored.rows(spark).groupBy("cell").count().collect()}
    assert sum(held.values()) == 3000
    asked = VectorTable(rows.where("id % 50 = 0"), ("id",), "v")
    probes = len(held) // 12
    assert np.mean([held[r["cell"]] for r in stored.probes(asked, probes).collect()]) * probes <= 300
    exact = similarity_topk(asked, VectorTable(rows, ("id",), "v"), 10, DIM)
    found = recall(stored.search(asked, 10, probes), exact, "id", "id_hit").first()
    assert found["n_exact"] == 600 and found["recall"] >= 0.9


def test_all_cells_give_the_exact_search(spark, tmp_path):
    rows = table(spark, [*clustered(300, 5), [0.0] * DIM, [1.0] * DIM, [1.0] * DIM])
    stored = index(tmp_path, cell_rows=20)
    stored.build(rows)
    asked = VectorTable(rows.where("id % 7 = 0 OR id >= 300"), ("id",), "v")
    n = stored.centres(spark).count()
    for same in (False, True):
        exact = similarity_topk(asked, VectorTable(rows, ("id",), "v"), 4, DIM, exclude_same=same)
        assert hits(stored.search(asked, 4, n, exclude_same=same)) == hits(exact)
        assert hits(stored.search(asked, 4, n, exclude_same=same, tile_rows=3)) == hits(exact)


def test_large_cells_are_split_and_copies_are_not(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cell_index, "FIRST_CELLS", 4)
    points = np.concatenate([clustered(600, 30, 1), np.ones((300, DIM))])
    stored = index(tmp_path, cell_rows=10)
    stored.build(table(spark, points))
    held = {r["cell"]: r["count"] for r in stored.rows(spark).groupBy("cell").count().collect()}
    assert sum(held.values()) == 900 and len(held) > 16 and any("_" in c for c in held)
    assert sorted(held.values())[-1] >= 300 and sorted(held.values())[-2] <= 60
    assert stored.centres(spark).count() == stored.centres(spark).select("cell").distinct().count()


def test_centres_above_the_broadcast_bound_place_alike(spark, tmp_path, monkeypatch):
    rows = table(spark, clustered(200, 6, 2))
    stored = index(tmp_path, cell_rows=10)
    centres = spark.createDataFrame([(f"c{i}", c.tolist()) for i, c in enumerate(train(clustered(200, 6, 2), 8))], "cell string, centre array<double>")
    small = {r["id"]: r["cell"] for r in stored._placed(rows, centres).collect()}
    monkeypatch.setattr(cell_index, "BROADCAST_BYTES", 0)
    assert {r["id"]: r["cell"] for r in stored._placed(rows, centres).collect()} == small


def test_changes_and_replays(spark, tmp_path):
    points = clustered(200, 5, 3)
    stored = index(tmp_path, cell_rows=20)
    with pytest.raises(ValueError):
        stored.apply(table(spark, points).withColumn("deleted", F.lit(False)), 1)
    stored.build(table(spark, points[:150]))
    with pytest.raises(ValueError):
        stored.build(table(spark, points))
    moved = table(spark, -points[:10]).withColumn("deleted", F.lit(None).cast("boolean"))
    gone = table(spark, points[20:30], 20).withColumn("deleted", F.lit(True))
    added = table(spark, points[150:], 150).withColumn("deleted", F.lit(False))
    useless = spark.createDataFrame([(40, [1.0], False), (41, [float("nan")] * DIM, False), (None, [1.0] * DIM, False), (42, None, False)], moved.schema)
    twice = table(spark, points[30:31], 30).withColumn("deleted", F.lit(True)).unionByName(table(spark, points[30:31], 30).withColumn("deleted", F.lit(False)))
    batch = moved.unionByName(gone).unionByName(added).unionByName(useless).unionByName(twice)
    assert stored.apply(batch, 1) and not stored.apply(batch, 1)
    back = table(spark, points[20:21], 20).withColumn("deleted", F.lit(False))
    assert stored.apply(back, 5) and stored.batches(spark) == [0, 1, 5]
    want = {i: points[i] for i in range(200) if i not in {*range(21, 31), 40, 41, 42}} | {i: -points[i] for i in range(10)}
    got = {r["id"]: r["v"] for r in stored.rows(spark).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-6) for i in want)
    now = table(spark, [want[i] for i in sorted(want)]).join(
        spark.createDataFrame(list(enumerate(sorted(want))), "id long, own long"), "id").select(F.col("own").alias("id"), "v")
    asked = VectorTable(now.where("id % 9 = 0"), ("id",), "v")
    exact = similarity_topk(asked, VectorTable(now, ("id",), "v"), 3, DIM)
    assert hits(stored.search(asked, 3, stored.centres(spark).count())) == hits(exact)


def test_an_unfinished_batch_is_not_seen(spark, tmp_path, monkeypatch):
    points = clustered(40, 3, 4)
    stored = index(tmp_path, cell_rows=10)
    stored.build(table(spark, points))
    batch = table(spark, points[:5], 0).withColumn("deleted", F.lit(True))
    monkeypatch.setattr(CellIndex, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        stored.apply(batch, 1)
    monkeypatch.undo()
    assert stored.rows(spark).count() == 40
    assert stored.apply(batch, 1) and stored.rows(spark).count() == 35


def test_a_search_opens_only_probed_cells(spark, tmp_path):
    rows = table(spark, clustered(400, 20, 5))
    stored = index(tmp_path, cell_rows=20)
    stored.build(rows)
    asked = VectorTable(rows.where("id = 3"), ("id",), "v")
    cells = [r["cell"] for r in stored.probes(asked, 2).collect()]
    plan = stored.search(asked, 3, 2)._jdf.queryExecution().executedPlan().toString()
    filters = [line.split("PartitionFilters: ")[1].split("PushedFilters")[0] for line in plan.splitlines() if "PartitionFilters: " in line and "batch" in line]
    assert filters and all(c in f for f in filters for c in cells)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<float>")
    stored = index(tmp_path)
    assert stored.rows(spark).count() == 0
    stored.build(none)
    asked = VectorTable(table(spark, np.eye(DIM)), ("id",), "v")
    assert stored.search(asked, 3, 4).count() == 0
    assert stored.apply(table(spark, np.eye(DIM)).withColumn("deleted", F.lit(False)), 1)
    assert stored.search(asked, 1, 4).count() == DIM and stored.search(VectorTable(none, ("id",), "v"), 1, 4).count() == 0


def test_all_cells_are_searched_without_probes(spark, tmp_path, monkeypatch):
    rows = table(spark, clustered(300, 10, 6))
    stored = index(tmp_path, cell_rows=5)
    stored.build(rows)
    asked = VectorTable(rows.where("id % 3 = 0"), ("id",), "v")
    monkeypatch.setattr(CellIndex, "probes", lambda *a: pytest.fail("a row per query and cell"))
    exact = similarity_topk(asked, VectorTable(rows, ("id",), "v"), 3, DIM)
    assert hits(stored.search(asked, 3, stored.centres(spark).count())) == hits(exact)


@pytest.mark.parametrize("same", [False, True])
def test_a_scan_of_many_probes_finds_what_the_probes_give(spark, tmp_path, monkeypatch, same):
    points = [*clustered(600, 12, 7), *np.repeat(clustered(4, 4, 8), 20, axis=0), [0.0] * DIM]
    rows = table(spark, points)
    stored = index(tmp_path, cell_rows=10)
    stored.build(rows)
    stored.apply(table(spark, points[100:140], 100).withColumn("deleted", F.col("id") % 2 == 0), 1)
    odd = spark.createDataFrame([(-1, [float("nan")] * DIM), (-2, None), (-3, [1.0])], rows.schema)
    asked = VectorTable(rows.where("id % 3 = 0 OR id >= 600").unionByName(odd), ("id",), "v")
    n = stored.centres(spark).count()
    for share in (0.15, 0.4):
        probed = hits(stored.search(asked, 4, int(n * share), exclude_same=same))
        with monkeypatch.context() as patch:
            patch.setattr(cell_index, "BROADCAST_BYTES", 80_000)
            patch.setattr(CellIndex, "probes", lambda *a: pytest.fail("a row per query and cell"))
            assert hits(stored.search(asked, 4, int(n * share), exclude_same=same)) == probed
