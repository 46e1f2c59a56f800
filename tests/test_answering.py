"""The chain with models plugged in, and its plan."""

import pytest
from pyspark.sql import functions as F

from docquarry.config import RunConfig
from docquarry.operators.dialogs import question_answer_pairs
from docquarry.plans import answering, evaluation
from docquarry.plans.answering import NO_PASSAGE, REFUSAL, Gate, Models

RUN = RunConfig(size=20, overlap=0, k=2)


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, 0, "d/one.pdf", "The inverter turns direct current into alternating current. Fans cool it."),
        (1, 1, "d/one.pdf", "A panel turns light into direct current."),
        (2, 0, "d/two.pdf", "Ice cream is cold. It melts."),
    ]
    return answering.embed_chunks(spark.createDataFrame(rows, "doc_id int, chunk_no int, url string, content string"))


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([
        ("plain", 0, "user", "What does the inverter turn into alternating current?"),
        ("follow", 0, "user", "What is an inverter?"),
        ("follow", 1, "assistant", "A device."),
        ("follow", 2, "user", "Which fans cool it?"),
        ("off", 0, "user", "What is the best ice cream?"),
        ("blank", 0, "user", " "),
    ], "conv_id string, turn long, role string, text string")


GATE = Gate(terms=("inverter", "current", "panel"))


def by_id(df):
    return {r.conv_id: r for r in df.collect()}


def test_stand_ins(turns, chunks):
    got = by_id(answering.answer_dialogs(turns, chunks, GATE, RUN))
    assert got["plain"].result == "The inverter turns direct current into alternating current."
    assert got["plain"].sources == ["d/one.pdf", "d/one.pdf"]
    assert got["follow"].result == "Fans cool it."
    for name, label in (("off", "no"), ("blank", "other")):
        assert (got[name].label, got[name].result, got[name].sources) == (label, REFUSAL, [])


def test_no_chunk_at_all(turns, chunks):
    got = by_id(answering.answer_dialogs(turns, chunks.limit(0), GATE, RUN))
    assert (got["plain"].result, got["plain"].sources) == (NO_PASSAGE, [])


def classify(prompts):
    return ["Yes." if "inverter" in p else "I do not know" for p in prompts]


def rewrite(prompts):
    return ["fans cool the inverter current" if "A device." in p else "light panel" for p in prompts]


def generate(prompts):
    return [p.split("Passages:\n")[1].split("\n")[0] + " | " + p.rsplit("Question: ", 1)[1] for p in prompts]


def test_models(turns, chunks):
    models = Models(classify=classify, rewrite=rewrite, generate=generate)
    got = by_id(answering.answer_dialogs(turns, chunks, GATE, RUN, models))
    assert set(got) == {"plain", "follow", "off", "blank"}
    # Rewritten with history, the question itself without.
    assert got["follow"].result.startswith("The inverter turns") and got["follow"].result.endswith("| Which fans cool it?")
    assert got["plain"].result.startswith("The inverter turns")
    assert got["off"].label == "no" and got["off"].result == REFUSAL
    always = by_id(answering.answer_dialogs(turns, chunks, GATE, RUN, models, always_rewrite=True))
    assert always["plain"].result.startswith("A panel turns light")


def test_predictions_with_gate(turns, chunks):
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    got = {(r.conv_id, r.turn): r for r in answering.predict_answers(asked, chunks, ["conv_id", "turn"], RUN, gate=GATE).collect()}
    assert len(got) == 5
    assert got["off", 0].answer == REFUSAL and got["off", 0].contexts == []
    assert len(got["plain", 0].contexts) == 2


def test_replay_bounds_the_model_tasks(spark, turns, chunks):
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    done = answering.replay_questions(asked, chunks, ["conv_id", "turn"], 3, 2, RUN, Models(generate=generate))
    assert sorted((r.conv_id, r.turn) for r in done.collect()) == [("blank", 0), ("follow", 0), ("follow", 2)]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(2)" in plan


def test_eval_rows_with_a_model_are_stored(turns, chunks):
    rows = evaluation.rag_eval_rows(question_answer_pairs(turns), chunks, ["conv_id", "turn"], RUN, Models(generate=generate))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
    assert rows.first().ground_truth == "A device."


def test_labelled_only(spark):
    df = spark.createDataFrame([("q", "a", "c"), ("r", None, "c")], "question string, expected_answer string, context string")
    kept = evaluation.labelled_only(df)
    assert kept.columns == ["context", "inputs", "targets"] and kept.count() == 1


def test_plan_moves_keys_not_texts_until_the_end(turns, chunks):
    plan = answering.answer_dialogs(turns, chunks, GATE, RUN)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # The winners are written once, when the plan is made; their keys then filter the chunk table where it is read.
    assert "MapInArrow" not in plan and "LeftSemi, BuildRight" in plan
    asked = question_answer_pairs(turns).withColumn("query", F.col("question"))
    retrieval = answering.retrieve(asked, chunks, ["conv_id", "turn"], ["doc_id", "chunk_no"], RUN, Models())
    plan = retrieval._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_winners_texts_move_neither_by_shuffle_nor_by_broadcast(spark, monkeypatch):
    rows = [(i, 0, f"u{i}", f"text number {i}. more of it.") for i in range(50)]
    path = answering.materialize(spark.createDataFrame(rows, "doc_id long, chunk_no int, url string, content string"))
    hits = spark.createDataFrame([(c, 7, 0, 1, 1.0) for c in range(20)] + [(c, c, 0, 2, 0.5) for c in range(20) if c != 7],
                                 "conv_id long, doc_id long, chunk_no int, rank int, score double")
    asked = spark.createDataFrame([(c, "text") for c in range(20)], "conv_id long, question string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def passages():
            return answering.with_passages(asked, hits, path, ["conv_id"], ["doc_id", "chunk_no"])

        plan = passages()._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [doc_id" in plan and "LeftSemi, BuildRight" in plan
        small = {r["conv_id"]: [p["url"] for p in r["passages"]] for r in passages().collect()}
        monkeypatch.setattr(answering, "BROADCAST_BYTES", 0)
        large = {r["conv_id"]: [p["url"] for p in r["passages"]] for r in passages().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert small == large and small[3] == ["u7", "u3"] and small[7] == ["u7"]
