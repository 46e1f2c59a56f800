"""Operators whose small tables may outgrow a broadcast give the same rows when nothing is sent."""

import re

import pytest
from pyspark.sql import functions as F

from docquarry.llm import common, decontaminate, langid, line_dedup, near_dup
from docquarry.llm.components import connected
from docquarry.session import materialize

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def nothing_sent(spark, monkeypatch):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)

    def switch():
        spark.conf.set(name, "-1")
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)

    yield switch
    spark.conf.set(name, before)


def rows(df):
    return sorted(map(repr, df.collect()))


def awkward_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    passage = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first()["text"]
    more = [(None, passage), (None, None), (-1, passage), (-1, passage), (-1, "other"), (-2, ""), (-3, None), (-4, "of " * 5000 + passage)]
    return materialize(docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")))


def test_decontamination(spark, nothing_sent):
    docs, items = awkward_documents(spark), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    sent = rows(decontaminate.contamination(docs, items))
    kept = rows(decontaminate.clean(docs, items))
    nothing_sent()
    assert rows(decontaminate.contamination(docs, items)) == sent and rows(decontaminate.clean(docs, items)) == kept
    assert rows(decontaminate.contamination(docs, items.limit(0))) != sent


def test_words_of_a_document_are_not_shuffled_with_each_word(spark, nothing_sent):
    docs, items = awkward_documents(spark), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    windows = materialize(decontaminate.item_windows(items, "item_id", "text", 10))
    nothing_sent()
    found = decontaminate.occurrences(docs, windows.select("window", "n").distinct(), "doc_id", "text")
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    details = re.findall(r"\(\d+\) Exchange\n(?:Input \[\d+\]: (.*)\n)?Arguments: (.*)", plan)
    by_token = [inputs for inputs, how in details if "token#" in how]
    assert by_token and not any("_words" in inputs for inputs in by_token)
    assert all("_salt#" in how for _, how in details if "token#" in how)


def test_a_frequent_key_is_spread(spark, nothing_sent):
    many = spark.range(20000).select(F.lit("of").alias("token"), F.col("id"))
    found = materialize(spark.createDataFrame([("of", 1), ("of", 2), ("rare", 3)], "token string, n int"))
    nothing_sent()
    spread = common.lookup_join(many, found, "token", F.lit(64))
    assert spread.count() == 40000 and spread.columns == ["token", "id", "n"]
    plan = many.withColumn("_salt", F.pmod(F.xxhash64("token", "id"), F.lit(common.SALTS)))
    assert plan.groupBy("_salt").count().agg(F.max("count")).first()[0] < 2 * 20000 / common.SALTS


def test_line_dedup(spark, nothing_sent):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    sent = rows(line_dedup.without_repeats(docs).select("doc_id", "text", "n_deleted"))
    nothing_sent()
    assert rows(line_dedup.without_repeats(docs).select("doc_id", "text", "n_deleted")) == sent


def test_near_duplicates(spark, nothing_sent):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    sent = rows(near_dup.near_duplicates(docs, near_dup.NearDup(words=2)))
    nothing_sent()
    assert rows(near_dup.near_duplicates(docs, near_dup.NearDup(words=2))) == sent


def test_language(spark, nothing_sent):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sent = langid.learn(docs)
    nothing_sent()
    alone = langid.learn(docs)
    assert alone.dictionaries == sent.dictionaries and alone.narrow == sent.narrow


def test_tables_that_the_driver_must_not_hold(spark, monkeypatch):
    """However small Spark takes their files to be."""
    monkeypatch.setattr(common, "SENT_BYTES", 0, raising=False)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    wanted = materialize(docs.selectExpr("doc_id AS node", "-1L AS unit", "0 AS left", "0 AS right", "false AS side"))
    chain = connected(spark.range(50).selectExpr("id AS a", "id + 1 AS b"))
    for df in (near_dup._sets(docs, wanted, near_dup.NearDup(), "doc_id", "text"), chain):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {r["component"] for r in chain.collect()} == {0} and chain.count() == 51
