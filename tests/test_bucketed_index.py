"""The stored index: changes, deletions, repeated batches, and which files a sync opens."""

from pyspark.sql import functions as F, types as T
import pytest

from docquarry.operators.bucketed_index import BucketedIndex

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("version", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture
def stored(spark, tmp_path):
    return BucketedIndex(str(tmp_path / "index"), SCHEMA, "id", "version", buckets=8)


def changes(spark, rows):
    return spark.createDataFrame(rows, "id long, version long, text string, deleted boolean")


def state(spark, stored):
    return {r["id"]: (r["version"], r["text"]) for r in stored.snapshot(spark).collect()}


def test_changes_give_the_state_of_a_rebuild(spark, stored):
    assert stored.snapshot(spark).count() == 0
    stored.apply(changes(spark, [(i, 1, f"t{i}", False) for i in range(40)] + [(None, 1, "x", False)]), 0)
    stored.apply(changes(spark, [(1, 2, "new", None), (1, 3, "newer", False), (2, 2, None, True), (3, 0, "old", False), (50, 1, None, False), (4, 2, "a", True), (4, 2, "a", False)]), 1)
    want = {i: (1, f"t{i}") for i in range(40)} | {1: (3, "newer"), 50: (1, None)}
    del want[2], want[4]
    assert state(spark, stored) == want
    # A repeated batch, also with other rows, and an older change of a deleted row do nothing.
    assert stored.apply(changes(spark, [(7, 9, "no", False)]), 1) == [] and stored.apply(changes(spark, [(2, 1, "back", False)]), 2) == []
    assert state(spark, stored) == want and stored.batches(spark) == [0, 1, 2]
    stored.apply(changes(spark, [(2, 3, "again", False)]), 3)
    assert state(spark, stored) == want | {2: (3, "again")}


def test_only_touched_buckets_are_opened_and_rewritten(spark, stored):
    stored.apply(changes(spark, [(i, 1, f"t{i}", False) for i in range(80)]), 0)
    before = stored.manifest(spark)
    assert set(before) == set(range(8))
    rewritten = stored.apply(changes(spark, [(5, 2, "x", False)]), 1)
    after = stored.manifest(spark)
    assert len(rewritten) == 1 and {b for b in after if after[b] != before[b]} == set(rewritten)
    opened = stored.stored(spark, after, rewritten).inputFiles()
    assert opened and all(f"/batch=1/bucket={rewritten[0]}/" in f for f in opened)
    # What is there already rewrites nothing.
    assert stored.apply(changes(spark, [(5, 2, "x", False), (6, 1, "t6", False)]), 2) == []


def test_an_unfinished_batch_leaves_the_index_as_it_was(spark, stored, monkeypatch):
    stored.apply(changes(spark, [(1, 1, "a", False)]), 0)
    real = spark.createDataFrame
    monkeypatch.setattr(spark, "createDataFrame", lambda rows, schema, *a: (_ for _ in ()).throw(OSError("lost")) if schema == "bucket int, batch long" else real(rows, schema, *a))
    batch = real([(1, 2, "b", False), (2, 1, "c", False)], "id long, version long, text string, deleted boolean")
    with pytest.raises(OSError):
        stored.apply(batch, 1)
    monkeypatch.undo()
    assert state(spark, stored) == {1: (1, "a")}
    stored.apply(batch, 1)
    assert state(spark, stored) == {1: (2, "b"), 2: (1, "c")}


def test_differences_read_no_payload(spark, stored):
    stored.apply(changes(spark, [(i, 1, f"t{i}", False) for i in range(20)]), 0)
    source = spark.createDataFrame([(i, 1, "changed" if i == 3 else f"t{i}") for i in range(1, 22)], SCHEMA)
    found = stored.differences(source)
    assert sorted((r["id"], r["deleted"]) for r in found.collect()) == [(0, True), (3, False), (20, False), (21, False)]
    scans = [line for line in found._jdf.queryExecution().toString().splitlines() if "FileScan" in line]
    assert scans and all("text" not in line.split("ReadSchema")[1] for line in scans)
    stored.apply(found, 1)
    assert {k: v[1] for k, v in state(spark, stored).items()} == {r["id"]: r["text"] for r in source.collect()}
    assert stored.differences(source).count() == 0


def test_a_stream_of_changes(spark, stored, tmp_path):
    folder = str(tmp_path / "changes")
    kind = "id long, version long, text string, deleted boolean"
    for n, rows in enumerate([[(1, 1, "a", False), (2, 1, "b", False)], [(1, 2, "c", False), (2, 2, None, True)]]):
        changes(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stored.sync_stream(spark.readStream.schema(kind).parquet(folder), str(tmp_path / "ck"))
        assert len(stored.batches(spark)) == n + 1
    assert state(spark, stored) == {1: (2, "c")}
