"""State kept over batches: replies of models, ranges of numbers, and a bounded wait for a log."""

import pytest
from pyspark.sql import functions as F, types as T

from docquarry.config import NO_ANSWER, NO_QUESTION
from docquarry.operators import monitoring, replies
from docquarry.operators.identity import NumberedTable
from docquarry.operators.replies import StoredReplies, stored_eval_set
from docquarry.plans import queries
from docquarry.session import committed_batches, shared_path


def upper(prompts):
    if any("bad" in p for p in prompts):
        raise ValueError("bad prompt")
    return [p.upper() for p in prompts]


def fixed(prompts):
    return ["fixed"] * len(prompts)


def unwanted(prompts):
    raise RuntimeError("called")


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


def answers(df):
    return {r["id"]: (r["reply"], r["error"], r["reply_batch"]) for r in df.collect()}


def test_only_new_prompts_are_sent(spark):
    store, prompt = StoredReplies(shared_path(spark), "m"), [F.col("text")]
    first = texts(spark, "a", "a", None, "bad one", "")
    assert store.stored(spark).count() == 0 and store.unseen(first, prompt).count() == 3
    got = answers(store.replied(first, prompt, upper, 1))
    assert got == {0: ("A", None, 1), 1: ("A", None, 1), 2: (None, None, None), 3: (None, "ValueError: bad prompt", 1), 4: ("", None, 1)}
    assert store.stored(spark).count() == 3
    more = first.unionByName(spark.createDataFrame([(9, "b")], first.schema))
    assert sorted(r["prompt"]["p0"] for r in store.unseen(more, prompt).collect()) == ["b", "bad one"]
    got = answers(store.replied(more, prompt, fixed, 2))
    assert got[0] == ("A", None, 1) and got[3] == got[9] == ("fixed", None, 2)
    assert answers(store.replied(more, prompt, unwanted, 2)) == got == answers(store.replied(more, prompt, unwanted, 3))


def test_models_keep_their_own_replies(spark):
    path, rows, prompt = shared_path(spark), texts(spark, "a"), [F.col("text")]
    StoredReplies(path, "one").fill(rows, prompt, upper, 1)
    assert answers(StoredReplies(path, "two").replied(rows, prompt, fixed, 1))[0][0] == "fixed"
    assert answers(StoredReplies(path, "one").joined(rows, prompt))[0][0] == "A"


def test_a_failed_batch_starts_anew(spark):
    store, rows, prompt = StoredReplies(shared_path(spark), "m"), texts(spark, "a", "b"), [F.col("text")]
    unfinished = f"{store._folder}/batch=1"
    spark.createDataFrame([("x", "half", None)], "digest string, reply string, error string").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(unfinished)
    assert store.batches(spark) == []
    store.fill(rows, prompt, upper, 1)
    assert sorted(r["reply"] for r in store.stored(spark).collect()) == ["A", "B"]


def test_frequent_prompts_are_sent_to_their_rows(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "often").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("p"), F.col("id"))).alias("text"))
    store, prompt = StoredReplies(shared_path(spark), "m"), [F.col("text")]
    out = store.replied(rows, prompt, upper, 1)
    assert out.count() == 4000 and out.where("reply = 'OFTEN'").count() == 1334
    assert out.where("text IS NOT NULL AND NOT reply <=> upper(text)").count() == 0 == out.where("text IS NULL AND reply IS NOT NULL").count()
    assert out.columns == ["id", "text", "reply", "error", "reply_batch"]


def asker(prompts):
    return [f'{{"question": "{p.split("Passage: ", 1)[1]}?"}}' for p in prompts]


def test_equal_chunks_share_their_replies(spark):
    path, rows = shared_path(spark), texts(spark, "x", "x", "y").withColumn("_extra", F.lit(1))
    made = stored_eval_set(rows, "text", path, asker, upper_pairs, 1)
    assert {(r["id"], r["question"], r["answer"], r["error"]) for r in made.collect()} == {
        (0, "x?", "X?", None), (1, "x?", "X?", None), (2, "y?", "Y?", None)}
    assert StoredReplies(path, "question").stored(spark).count() == StoredReplies(path, "answer").stored(spark).count() == 2
    assert stored_eval_set(rows.limit(0), "text", path, unwanted, unwanted, 7).count() == 0


def upper_pairs(pairs):
    return [question.upper() for _, question in pairs]


def test_texts_are_not_written_again(spark, monkeypatch):
    written = []
    monkeypatch.setattr(replies, "materialize", lambda df, write=replies.materialize: written.append(df.columns) or write(df))
    path = shared_path(spark)
    rows = texts(spark, "x", "x", None, "", "bad y", "z").withColumn("_extra", F.lit(1))
    stored_eval_set(rows.where("id < 5"), "text", path, guarded_asker, upper_pairs, 1)
    made = stored_eval_set(rows, "text", path, asker, upper_pairs, 2)
    assert written and not any("text" in columns or "prompt" in columns for columns in written)
    first = stored_eval_set(rows.where("id < 5"), "text", path, unwanted, unwanted, 1)
    assert {r["id"]: (r["question"], r["answer"], r["error"], r["reply_batch"]) for r in first.where("id > 2").collect()} == {
        3: ("?", "?", None, 1), 4: ("bad y?", "BAD Y?", None, 2)}
    failed = stored_eval_set(texts(spark, "bad", "fine"), "text", path, guarded_asker, upper_pairs, 3)
    assert {(r["question"], r["answer"], r["error"], r["reply_batch"]) for r in failed.collect()} == {
        (None, None, "ValueError: bad prompt", 3), ("fine?", "FINE?", None, 3)}
    assert made.columns == ["id", "text", "_extra", "question", "answer", "error", "reply_batch"]
    assert {r["id"]: (r["question"], r["answer"], r["error"], r["reply_batch"]) for r in made.collect()} == {
        0: ("x?", "X?", None, 1), 1: ("x?", "X?", None, 1), 2: ("?", "?", None, 1), 3: ("?", "?", None, 1),
        4: ("bad y?", "BAD Y?", None, 2), 5: ("z?", "Z?", None, 2)}
    more = stored_eval_set(texts(spark, "z", "new"), "text", path, unwanted, unwanted, 2)
    assert {r["id"]: (r["question"], r["answer"]) for r in more.collect()} == {0: ("z?", "Z?"), 1: (NO_QUESTION, NO_ANSWER)}


def guarded_asker(prompts):
    if any("bad" in p for p in prompts):
        raise ValueError("bad prompt")
    return asker(prompts)


def test_many_prompts_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(replies, "_FEW", 10)
    monkeypatch.setattr(replies, "_TASK_BYTES", 1000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "often").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(
            F.concat(F.lit("p"), F.floor(F.col("id") / 6))).alias("text"))
        store, prompt = StoredReplies(shared_path(spark), "m"), [F.col("text")]
        store.fill(rows.where("id < 300"), prompt, upper, 1)
        new = store.unseen(rows, prompt)
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin" in plan
        assert not [x for x in plan.splitlines() if "SortMergeJoin" in x and "LeftSemi" in x]
        sent = [r["prompt"]["p0"] for r in new.collect()]
        assert sorted(sent) == sorted(f"p{i}" for i in range(50, 1000))
        out = store.replied(rows, prompt, upper, 2)
        assert out.count() == 6000 and out.where("NOT reply <=> upper(text)").count() == 0 and store.stored(spark).count() == 1001
        assert store._rows(spark).count() == 1001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_chunks_get_every_language_of_their_key(spark, tmp_path):
    docs = [(1, "a b c d", "en"), (2, "e f", "fr"), (2, "g", "en"), (2, "g", None), (None, "h", "en"), (3, "i", None), (4, " ", "en"), (5, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.spoken_chunks(spark, str(tmp_path), 2, 0)
    want = queries.chunks(spark, str(tmp_path), 2, 0).join(queries.documents(spark, str(tmp_path)).select("doc_id", "lang"), "doc_id").select(*got.columns)
    assert got.count() == want.count() == 12 and got.exceptAll(want).count() == 0


WORDS = T.StructType([T.StructField("w", T.StringType()), T.StructField("n", T.IntegerType())])


def words(spark, *rows):
    return spark.createDataFrame(list(rows), WORDS)


def test_numbers_continue_without_a_gap(spark):
    kept = NumberedTable(shared_path(spark), WORDS, ("w",))
    assert kept.rows(spark).count() == 0
    first = words(spark, ("b", 1), ("a", 2), (None, 3), ("a", 2))
    kept.append(first, 4)
    kept.append(words(spark), 5)
    kept.append(words(spark, ("a", 9)), 6)
    kept.append(first, 4)
    got = sorted((r["id"], r["w"]) for r in kept.rows(spark).collect())
    assert got == [(1, None), (2, "a"), (3, "a"), (4, "b"), (5, "a")]
    assert kept.ledger(spark) == {4: (1, 4), 5: (5, 0), 6: (5, 1)}


def test_a_repeated_batch_gets_its_own_range_again(spark):
    kept = NumberedTable(shared_path(spark), WORDS, ("w",), "key", 100)
    assert kept.reserve(spark, 0, 2) == 100 and committed_batches(spark, f"{kept.path}/rows") == []
    kept.append(words(spark, ("z", 0)), 1)
    with pytest.raises(ValueError):
        kept.append(words(spark, ("only one", 0)), 0)
    kept.append(words(spark, ("d", 0), ("c", 0)), 0)
    assert {r["w"]: r["key"] for r in kept.rows(spark).collect()} == {"c": 100, "d": 101, "z": 102}


def test_streamed_batches_are_numbered(spark):
    source, checkpoint = shared_path(spark), shared_path(spark)
    kept = NumberedTable(shared_path(spark), WORDS, ("w", "n"))
    words(spark, ("a", 1), ("b", 2)).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(WORDS).option("maxFilesPerTrigger", 1).parquet(source)
    kept.append_stream(stream, checkpoint)
    words(spark, ("a", 0)).coalesce(1).write.mode("append").parquet(source)
    words(spark, ("c", 0)).coalesce(1).write.mode("append").parquet(source)
    kept.append_stream(stream, checkpoint)
    kept.append_stream(stream, checkpoint)
    got = {r["w"] + str(r["n"]): r["id"] for r in kept.rows(spark).collect()}
    assert got["a1"] == 1 and got["b2"] == 2 and sorted((got["a0"], got["c0"])) == [3, 4] and len(got) == 4


def test_the_wait_is_bounded(spark):
    source, log = shared_path(spark), shared_path(spark)
    words(spark, ("a", 1), (None, 2)).coalesce(1).write.parquet(source)
    stream = monitoring.observed(spark.readStream.schema(WORDS).parquet(source))
    query = stream.writeStream.option("checkpointLocation", shared_path(spark)).format("parquet").start(log)
    try:
        assert monitoring.wait_for_rows(query, 2, 60) == 2
        assert monitoring.wait_for_rows(query, 3, 0.5) == 2
        words(spark, ("b", 3)).coalesce(1).write.mode("append").parquet(source)
        assert monitoring.wait_for_rows(query, 3, 60) == 3
    finally:
        query.stop()
    assert monitoring.wait_for_rows(query, 99, 60) == 3
    asked = words(spark, ("a", 0), ("b", 0), ("c", 0), ("c", 1), (None, 0))
    assert {r["w"] for r in monitoring.missing_keys(asked, spark.read.schema(WORDS).parquet(log), ["w"]).collect()} == {"c", None}
