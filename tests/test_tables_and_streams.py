from datetime import datetime
import uuid

import pytest
from pyspark.sql import functions as F, types as T

from docquarry import session
from docquarry.config import RunConfig
from docquarry.operators import index
from docquarry.plans.answering import Gate, answer_dialogs
from docquarry.sources import files, pages, tables
from docquarry.streaming import index_sync, ingest


@pytest.fixture
def database(spark):
    name = "d" + uuid.uuid4().hex[:8]
    tables.use_namespace(spark, name, "spark_catalog")
    yield name
    tables.drop_database(spark, name)
    spark.catalog.setCurrentDatabase("default")


def test_run_config_names():
    config = RunConfig(size=350, overlap=10, k=4)
    assert config.suffix == "_chunk_350_op_10_k_4"
    assert config.table("chunks") == "spark_catalog.manuals_chunk_350_op_10_k_4.chunks"
    with pytest.raises(ValueError):
        RunConfig(size=10, overlap=10)


def test_tables(spark, database):
    assert tables.catalog_exists(spark, "spark_catalog") and not tables.catalog_exists(spark, "nope")
    name = f"{database}.chunks"
    assert not tables.table_exists(spark, name)
    tables.create_table(spark, name, tables.CHUNK_SCHEMA, {"made.by": "test"})
    tables.create_table(spark, name, tables.CLEAN_EVALSET_SCHEMA)
    assert spark.table(name).schema.fieldNames() == tables.CHUNK_SCHEMA.fieldNames()
    row = spark.createDataFrame([(1, "u", "c", [0.5])], tables.CHUNK_SCHEMA)
    tables.append_table(row, name)
    tables.append_table(row, name)
    assert spark.table(name).count() == 2
    tables.drop_table(spark, name)
    assert not tables.table_exists(spark, name)


def test_overwrite_and_schema_merge(spark, database):
    name = f"{database}.evals"
    tables.overwrite_table(spark.createDataFrame([(1, "a")], "id int, x string"), name)
    tables.overwrite_table(spark.createDataFrame([("b", 2.0)], "x string, y double"), name)
    assert [tuple(r) for r in spark.table(name).collect()] == [("b", 2.0)]
    merged = tables.merge_schema(spark.createDataFrame([(1, "q", 3)], "id long, question string, extra int"),
                                 tables.CLEAN_EVALSET_SCHEMA)
    assert merged.columns == [*tables.CLEAN_EVALSET_SCHEMA.fieldNames(), "extra"]
    assert merged.first().expected_answer is None


def test_eval_set_csv(spark, tmp_path):
    path = tmp_path / "set.csv"
    path.write_text('id,question,expected_answer,context\n1,"a ""q""\nsecond line",yes,ctx\n2,b,,\n', encoding="utf-8")
    inferred = files.load_eval_set(spark, str(path))
    assert inferred.schema["id"].dataType == T.LongType()
    got = [tuple(r) for r in files.load_eval_set(spark, str(path), files.EVALSET_CSV_SCHEMA).orderBy("id").collect()]
    assert got == [(1, 'a "q"\nsecond line', "yes", "ctx"), (2, "b", None, None)]
    assert files.load_eval_set_without_id(spark, str(path)).columns == ["question", "expected_answer", "context"]


def test_folder_is_empty(spark, tmp_path):
    assert files.folder_is_empty(spark, str(tmp_path / "absent"))
    folder = tmp_path / "f"
    folder.mkdir()
    assert files.folder_is_empty(spark, str(folder))
    (folder / "a.pdf").write_bytes(b"x")
    assert not files.folder_is_empty(spark, str(folder))


def test_pages(spark):
    frame = pages.url_frame(spark, [f"u{i}" for i in range(30)], max_documents=12)
    assert frame.count() == 12 and frame.rdd.getNumPartitions() == pages.FETCH_PARTITIONS
    log = spark.createDataFrame([(200, "ok"), (404, "gone"), (None, "lost")], "status int, body string")
    assert [r[0] for r in log.select(pages.fetched_body("status", "body")).collect()] == ["ok", None, None]
    xml = spark.createDataFrame([("<u xmlns='n'><url><loc>http://a?x=1&amp;y=2</loc></url><url><loc>b</loc></url></u>",)], "x string")
    assert [r.url for r in pages.sitemap_urls(xml, "x").collect()] == ["http://a?x=1&y=2", "b"]
    html = spark.createDataFrame([('<div itemprop="articleBody"><div>in</div></div>',), ("<p/>",)], "html string")
    found = pages.require_rows(pages.extract_article(html, "html", "div", "itemprop", "articleBody"), "article")
    assert found.count() == 1
    with pytest.raises(ValueError, match="any text"):
        pages.require_rows(pages.extract_article(html, "html"), "article")


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_files_to_chunks(spark, database, tmp_path):
    """Two runs over a growing folder: every file is taken once, other names never."""
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "a.pdf", "First sentence here . Second one.\n\nThird part\nbroken line.")
    write(folder, "b.pdf", "Only one.")
    write(folder, "c.txt", "not taken.")
    raw, parts = f"{database}.raw", f"{database}.parts"
    config = RunConfig(size=4, overlap=0)

    def run():
        ingest.drain_to_table(ingest.ingest_files(spark, str(folder)), raw, str(tmp_path / "ck_raw"))
        chunked = ingest.chunk_stream(ingest.stream_table(spark, raw), config)
        ingest.drain_to_table(chunked, parts, str(tmp_path / "ck_parts"))

    run()
    assert spark.table(raw).count() == 2
    assert spark.table(raw).columns == tables.RAW_SCHEMA.fieldNames()
    texts = sorted(r.content for r in spark.table(parts).collect())
    assert texts == ["First sentence here.", "Only one.", "Second one.", "Third partbroken line."]
    run()
    assert spark.table(parts).count() == 4
    write(folder, "d.pdf", "Added later.")
    run()
    table = spark.table(parts)
    assert table.count() == 5 and table.select("id").distinct().count() == 5
    assert table.where(F.size("embedding") != config.dim).isEmpty()
    assert table.columns == tables.CHUNK_SCHEMA.fieldNames()
    turns = spark.createDataFrame([("c", 0, "user", "Which sentence was added later?")],
                                  "conv_id string, turn long, role string, text string")
    answer = answer_dialogs(turns, table, Gate(terms=("sentence",)), config, chunk_key=["id"]).first()
    assert answer.result == "Added later." and answer.sources[0].endswith("d.pdf")


def test_evalset_stream_with_limit(spark, database, tmp_path):
    source = f"{database}.texts"
    rows = [(f"f{i}", datetime(2024, 1, 1), 1, f"Sentence number {i}.".encode()) for i in range(30)]
    tables.append_table(spark.createDataFrame(rows, tables.RAW_SCHEMA), source)
    stream = ingest.evalset_stream(ingest.stream_table(spark, source), max_rows=21)
    ingest.drain_to_table(stream, f"{database}.evals", str(tmp_path / "ck"))
    made = spark.table(f"{database}.evals")
    assert made.count() == 21 and made.columns == tables.EVALSET_SCHEMA.fieldNames()
    assert made.where("answer <> 'sentence'").isEmpty()


def test_reset_rebuilds_from_the_start(spark, database, tmp_path):
    folder, checkpoint, raw = tmp_path / "in", str(tmp_path / "ck"), f"{database}.raw"
    folder.mkdir()
    write(folder, "a.pdf", "One.")
    ingest.drain_to_table(ingest.ingest_files(spark, str(folder)), raw, checkpoint)
    tables.drop_table(spark, raw)
    assert session.remove_folder(spark, checkpoint)
    ingest.drain_to_table(ingest.ingest_files(spark, str(folder)), raw, checkpoint)
    assert spark.table(raw).count() == 1


def test_session_helpers(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with session.arrow_batch_rows(spark, 10):
        assert spark.conf.get(name) == "10"
    assert spark.conf.get(name) == before
    assert session.shared_path(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    small = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert session.ensure_parallelism(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    kept = session.materialize(spark.range(5))
    assert kept.count() == 5 and "FileScan" in kept._jdf.queryExecution().executedPlan().toString()


def test_large_scans_are_not_shuffled(spark):
    """With a tiny split size the same file counts as large."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "16")
    try:
        df = session.ensure_parallelism(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)


INDEX_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("content", T.StringType()), T.StructField("version", T.LongType())])


def test_index_sync_stream(spark, database, tmp_path):
    source, log = f"{database}.src", str(tmp_path / "index")

    def sync():
        index_sync.sync_stream(spark.readStream.table(source), log, str(tmp_path / "ck"))
        rows = index_sync.index_snapshot(spark, log, INDEX_SCHEMA, "id", "version").collect()
        return sorted((r.id, r.content) for r in rows)

    tables.append_table(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], INDEX_SCHEMA), source)
    assert sync() == [(1, "a"), (2, "b")]
    tables.append_table(spark.createDataFrame([(2, "b2", 2), (3, "c", 1), (1, "late", 0)], INDEX_SCHEMA), source)
    assert sync() == [(1, "a"), (2, "b2"), (3, "c")]
    assert sync() == [(1, "a"), (2, "b2"), (3, "c")]
    target = str(tmp_path / "compact")
    index_sync.compact_index(spark, log, INDEX_SCHEMA, "id", "version", target)
    rows = index_sync.index_snapshot(spark, target, INDEX_SCHEMA, "id", "version").collect()
    assert sorted((r.id, r.content) for r in rows) == [(1, "a"), (2, "b2"), (3, "c")]


def test_batch_sync(spark):
    source = spark.createDataFrame([(1, "a"), (2, "new"), (3, None)], "id int, c string")
    old = spark.createDataFrame([(1, "a"), (2, "old"), (9, "gone")], "id int, c string")
    got = {r.id: r.sync_action for r in index.sync_index(source, old, "id").collect()}
    assert got == {1: "kept", 2: "updated", 3: "added"}
    assert [r.id for r in index.missing_from_index(source, old, "id").collect()] == [3]


def test_latest_rows_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"), F.col("id").alias("v"))
    latest = index.latest_rows(df, "key", "v")
    assert latest.where("key = -1").first().v == 2997
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortAggregate" not in plan and "partial_max(" in plan
