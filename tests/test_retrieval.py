import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from docquarry.operators import retrieval
from docquarry.operators.retrieval import (
    VectorTable, dimension_check, pick_centroids, similarity_topk, similarity_topk_approx, tile_count)

DIM = 4


def frame(spark, rows, key="id"):
    return spark.createDataFrame(
        [(k, None if v is None else [float(x) for x in v]) for k, v in rows], f"{key} string, v array<float>")


def sides(spark, queries, corpus):
    return VectorTable(frame(spark, queries, "qid"), ("qid",), "v"), VectorTable(frame(spark, corpus, "cid"), ("cid",), "v")


def brute_force(queries, corpus, k, skip_same=False, floor=None):
    out = []
    for qid, q in queries:
        scored = []
        for cid, c in corpus:
            if skip_same and qid == cid:
                continue
            norm = math.sqrt(sum(x * x for x in q)) * math.sqrt(sum(x * x for x in c))
            score = round(sum(x * y for x, y in zip(q, c)) / norm, 6) if norm else 0.0
            if floor is None or score >= floor:
                scored.append((-score, cid))
        out += [(qid, cid, i + 1, -s) for i, (s, cid) in enumerate(sorted(scored)[:k])]
    return sorted((q, c, r, s + 0.0) for q, c, r, s in out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_vectors(n, prefix, seed):
    rng = random.Random(seed)
    # Few distinct integer vectors give many equal scores.
    return [(f"{prefix}{i:03d}", [float(rng.randint(-1, 1)) for _ in range(DIM)]) for i in range(n)]


@pytest.mark.parametrize("bound", [1 << 20, 0])
@pytest.mark.parametrize("k", [1, 3, 500])
def test_equals_brute_force(spark, bound, k):
    queries, corpus = random_vectors(20, "q", 1), random_vectors(150, "c", 2)
    q, c = sides(spark, queries, corpus)
    assert rows(similarity_topk(q, c, k, DIM, broadcast_bytes=bound, tile_rows=40)) == brute_force(queries, corpus, k)


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_self_exclusion_and_threshold(spark, bound):
    vectors = random_vectors(60, "v", 3)
    table = VectorTable(frame(spark, vectors), ("id",), "v")
    got = similarity_topk(table, table, 3, DIM, exclude_same=True, min_score=0.5, broadcast_bytes=bound, tile_rows=25)
    assert got.columns == ["id", "id_hit", "rank", "score"]
    assert rows(got) == brute_force(vectors, vectors, 3, True, 0.5)


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_ties_zero_vectors_and_wrong_dimensions(spark, bound):
    q, c = sides(
        spark,
        [("q", [1.0, 0, 0, 0]), ("zero", [0.0] * 4), ("short", [1.0]), ("null", None)],
        [("b", [2.0, 0, 0, 0]), ("a", [1.0, 0, 0, 0]), ("c", [0.0] * 4), ("d", [1.0, 1.0]), ("e", None)],
    )
    assert rows(similarity_topk(q, c, 2, DIM, broadcast_bytes=bound)) == [
        ("q", "a", 1, 1.0), ("q", "b", 2, 1.0), ("zero", "a", 1, 0.0), ("zero", "b", 2, 0.0)]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_empty_sides(spark, bound):
    q, c = sides(spark, [("q", [1.0, 0, 0, 0])], [("a", [1.0, 0, 0, 0])])
    nothing = VectorTable(c.df.limit(0), ("cid",), "v")
    assert rows(similarity_topk(q, nothing, 2, DIM, broadcast_bytes=bound)) == []
    no_query = VectorTable(q.df.limit(0), ("qid",), "v")
    assert rows(similarity_topk(no_query, c, 2, DIM, broadcast_bytes=bound)) == []


def test_a_third_of_the_corpus_is_one_vector(spark):
    """Copies tie at the top; the result still holds exactly the smallest keys."""
    corpus = [(f"c{i:04d}", [1.0, 1, 0, 0] if i % 3 == 0 else [float(i % 7), float(i % 5), 1, 0]) for i in range(900)]
    queries = [("q", [1.0, 1, 0, 0])]
    q, c = sides(spark, queries, corpus)
    expected = brute_force(queries, corpus, 5)
    assert rows(similarity_topk(q, c, 5, DIM)) == expected
    assert rows(similarity_topk(q, c, 5, DIM, broadcast_bytes=0, tile_rows=100)) == expected
    assert rows(similarity_topk_approx(q, c, 5, DIM, n_cells=8, n_probe=8, tile_rows=50)) == expected


def test_composite_keys(spark):
    corpus = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0, 0.0]), (1, 1, [0.0, 1.0, 0.0, 0.0]), (0, 9, [1.0, 0.0, 0.0, 0.0])],
                                   "doc int, part int, v array<float>")
    queries = frame(spark, [("q", [1.0, 0, 0, 0])], "qid")
    got = similarity_topk(VectorTable(queries, ("qid",), "v"), VectorTable(corpus, ("doc", "part"), "v"), 2, DIM)
    assert rows(got) == [("q", 0, 9, 1, 1.0), ("q", 1, 0, 2, 1.0)]


def test_approximation_recall(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    v = VectorTable(df, ("vec_id",))
    exact = {r[:2] for r in rows(similarity_topk(v, v, 3, 64))}
    full = {r[:2] for r in rows(similarity_topk_approx(v, v, 3, 64, n_cells=8, n_probe=8, tile_rows=50))}
    some = {r[:2] for r in rows(similarity_topk_approx(v, v, 3, 64, n_cells=8, n_probe=4))}
    assert full == exact
    assert len(some & exact) / len(exact) > 0.6


def test_centroids_do_not_depend_on_partitioning(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    one = pick_centroids(VectorTable(df, ("vec_id",)), 8, 64)
    other = pick_centroids(VectorTable(df.repartition(7), ("vec_id",)), 8, 64)
    assert np.array_equal(one, other)


def test_dimension_check(spark):
    df = frame(spark, [("a", [1.0] * 4), ("b", [1.0]), ("c", None)])
    fits, other = dimension_check(df, "v", DIM)
    assert [r.id for r in fits.collect()] == ["a"]
    assert sorted(r.id for r in other.collect()) == ["b", "c"]


def test_plan_reads_two_columns_and_makes_no_pairs(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    v = VectorTable(df, ("vec_id",))
    plan = similarity_topk(v, v, 3, 64)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_the_model_runs_once_per_row(spark):
    from docquarry.functions.models import HashingEmbedder, embed_with

    df = spark.range(20).select(F.col("id"), embed_with(HashingEmbedder(DIM))(F.col("id").cast("string")).alias("v"))
    q = VectorTable(frame(spark, [("q", [1.0, 0, 0, 0])], "qid"), ("qid",), "v")
    plan = similarity_topk(q, VectorTable(df, ("id",), "v"), 3, DIM)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("bound", [1 << 20, 0])
@pytest.mark.parametrize("exclude_same", [False, True])
def test_many_queries_among_copies(spark, bound, exclude_same):
    """Enough queries for copies to be dropped first; only 81 distinct vectors, a third are one."""
    vectors = [(k, [1.0, 1, 1, 0] if i % 3 == 0 else v) for i, (k, v) in enumerate(random_vectors(300, "v", 5))]
    table = VectorTable(frame(spark, vectors).repartition(3), ("id",), "v")
    got = similarity_topk(table, table, 4, DIM, exclude_same=exclude_same, broadcast_bytes=bound, tile_rows=150)
    assert rows(got) == brute_force(vectors, vectors, 4, exclude_same)


@pytest.mark.parametrize("bad", [[float("inf"), 0.0], [float("nan"), 1.0], [None, 1.0]])
@pytest.mark.parametrize("way", ["broadcast", "tiled", "approximate"])
def test_unusable_vectors_cost_no_hits(spark, bad, way):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])]
    schema = "id long, embedding array<double>"
    clean, spoilt = (VectorTable(spark.createDataFrame(r, schema), ("id",)) for r in (rows, [*rows, (4, bad)]))

    def found(corpus, k):
        if way == "approximate":
            hits = similarity_topk_approx(clean, corpus, k, 2, n_cells=2, n_probe=2)
        else:
            hits = similarity_topk(clean, corpus, k, 2, broadcast_bytes=1 << 20 if way == "broadcast" else 0, tile_rows=2)
        return {tuple(r) for r in hits.where("id_hit <> 4").collect()}

    for k in (1, 3):
        assert found(spoilt, k + 1) >= found(clean, k)
    queries = VectorTable(spoilt.df, ("id",))
    assert {r["id"] for r in similarity_topk(queries, clean, 1, 2).collect()} >= {1, 2, 3}


def test_a_wrong_dimension_is_an_error(spark):
    table = VectorTable(spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>"), ("id",))
    with pytest.raises(ValueError, match="no vector has dimension 3"):
        similarity_topk(table, table, 1, 3)


def test_tiles_are_bounded_by_memory_and_cores_not_by_small_tiles():
    # Each side is copied to every tile of the other one: sixty times the rows must not be copied sixty times as often.
    assert tile_count(2_000, 125, 262_144, 8) == tile_count(600_000, 125, 262_144, 8) == 8
    assert tile_count(10, 125, 262_144, 8) == 1 and tile_count(0, 125, 262_144, 8) == 1 and tile_count(300, 125, 262_144, 8) == 3
    assert tile_count(10_000_000, 125, 100_000, 8) == 100


def test_tiles_hold_no_more_hits_than_their_bytes(spark, monkeypatch):
    queries, corpus = random_vectors(60, "q", 5), random_vectors(90, "c", 6)
    q, c = sides(spark, queries, corpus)
    seen, tiled = [], retrieval._tiled_topk
    monkeypatch.setattr(retrieval, "TILE_BYTES", 16 * 1024)
    monkeypatch.setattr(retrieval, "_tiled_topk", lambda *a: seen.append(a[4:]) or tiled(*a))
    assert rows(similarity_topk(q, c, 40, DIM, broadcast_bytes=0)) == brute_force(queries, corpus, 40)
    assert seen == [(5, 1)]


def test_norms_and_unit_vectors_hold_no_second_matrix():
    import tracemalloc

    m = np.random.default_rng(0).normal(size=(60_000, 64))
    m[7] = 0
    tracemalloc.start()
    norms = retrieval._norms(m)
    assert tracemalloc.get_traced_memory()[1] < m.nbytes / 2
    unit = retrieval._unit(m, norms)
    assert tracemalloc.get_traced_memory()[1] < m.nbytes
    tracemalloc.stop()
    assert np.array_equal(norms, np.sqrt((m * m).sum(axis=1))) and unit.dtype == np.float32 and not unit[7].any()
    assert np.array_equal(unit[8], (m[8] / norms[8]).astype(np.float32)) and retrieval._norms(m[:0]).shape == (0,)


def test_first_bar_comes_from_few_columns_and_only_touched_hits_are_ranked(monkeypatch):
    rng = np.random.default_rng(3)
    q, c = rng.integers(-2, 3, (300, 8)).astype(float), rng.integers(-2, 3, (9000, 8)).astype(float)
    c[-1] = 2 * q[7]
    search = retrieval._Search(3, 8, False, None, ("q0",), ("c0",))
    running = retrieval._Running(pa.table({"q0": pa.array(range(300))}), q, search)
    wide, ranked = [], []
    partition, place = np.partition, retrieval._place
    monkeypatch.setattr(retrieval.np, "partition", lambda a, *more, **named: wide.append(a.shape[1]) or partition(a, *more, **named))
    for first, last in ((0, 8000), (8000, 8999), (8999, 9000)):
        ranked.clear()
        monkeypatch.setattr(retrieval, "_place", lambda ordered: ranked.append(len(ordered)) or place(ordered))
        running.add(pa.table({"c0": pa.array(range(first, last))}), c[first:last])
        monkeypatch.setattr(retrieval, "_place", place)
    assert max(wide) < 8000 and ranked[-1] < 300
    found = running.result().sort_by([("q0", "ascending"), ("scaled", "descending"), ("c0", "ascending")])
    scaled = retrieval._scaled_cosines(q, c)
    order = np.argsort(-scaled * len(c) + np.arange(len(c)), axis=1)[:, :3]
    assert found["c0"].to_pylist() == order.ravel().tolist()
    assert found["scaled"].to_pylist() == np.take_along_axis(scaled, order, 1).ravel().tolist()


@pytest.mark.parametrize("n", [0, 5, 8, 8001])
def test_marked_positions(n):
    flags = np.random.default_rng(n).random(n) < 0.01
    flags[-1:] = True
    assert retrieval._marked(flags).tolist() == np.flatnonzero(flags).tolist()
