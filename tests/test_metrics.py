import math

import pytest
from pyspark.sql import functions as F

from docquarry.operators import component_metrics as cm, metrics as mt
from docquarry.functions import models as mx


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        (1, "what is an inverter", "An inverter turns direct current into alternating current.",
         "An inverter turns direct current into alternating current.", "An inverter turns direct current into alternating current."),
        (2, "what is a fuse", "Dude, it's like a cool thing!", "A fuse protects wires.", "A fuse protects wires."),
        (3, "empty", "", None, ""),
    ], "id int, question string, answer string, target string, context string")


def test_answer_metrics(rows):
    got = {r.id: r for r in mt.answer_metrics(rows).collect()}
    assert (got[1].exact_match, got[1].answer_correctness, got[1].faithfulness, got[1].professionalism) == (1, 5, 5, 5)
    assert got[1].token_count == 8 and got[1].answer_relevance == 3
    assert got[2].exact_match == 0 and got[2].answer_correctness < 3
    # One contraction and one exclamation mark in six words: more than ten marks in a hundred.
    assert got[2].professionalism == 1
    assert got[3].token_count == 0 and got[3].flesch_kincaid is None


def test_toxicity_is_a_share(spark):
    df = spark.createDataFrame([("stupid idiot",), ("nice text",), ("",)], "t string")
    assert [r[0] for r in df.select(mt.toxicity("t")).collect()] == [1.0, 0.0, 0.0]


def test_summary_pivot_and_distributions(spark):
    long = spark.createDataFrame(
        [(i, "m", float(v)) for i, v in enumerate([1, 2, 2, 3, 10])] + [(0, "n", 0.5), (1, "n", None)],
        "id int, metric string, score double")
    got = {r.metric: r for r in mt.eval_summary(long).collect()}
    assert (got["m"].n, got["m"]["mean"], got["m"].variance, got["m"].p90) == (5, 3.6, 10.64, 7.2)
    assert (got["n"].n, got["n"].variance) == (1, 0.0)
    wide = {r.id: (r.m, r.n) for r in mt.eval_table(long, ["id"], ["m", "n"]).collect()}
    assert wide[0] == (1.0, 0.5) and wide[4] == (10.0, None)
    m = long.where("metric = 'm'")
    assert [tuple(r) for r in mt.score_distribution(m, "score").collect()][0] == (2.0, 2)
    assert {r.lower: r.n for r in mt.histogram(m, "score", 2).collect()} == {0: 1, 2: 3, 10: 1}


def rubric_judge(prompts):
    return [(len(p.split("Answer: ")[1]), "counted letters") if "Score 5" in p else None for p in prompts]


def test_rubric_metric(rows):
    metric = mt.informality("wording", {1: "poor", 5: "good"}, rubric_judge)
    got = rows.where("id = 2").select(metric.score("question", "answer").alias("s")).first().s
    assert (got.score, got.justification) == (len("Dude, it's like a cool thing!"), "counted letters")
    ruled = rows.where("id = 2").select(mt.informality("wording", {}).score("question", "answer").alias("s")).first().s
    assert (ruled.score, ruled.justification) == (1, "rule based")


@pytest.fixture(scope="module")
def eval_rows(spark):
    return spark.createDataFrame([
        ("good", "red apples", "Red apples grow. Trees bear them.", ["Red apples grow here. Trees bear them well.", "Rocks lie."],
         "Red apples grow. Trees bear them."),
        ("bad", "red apples", "Something else entirely.", ["Rocks lie.", "Red apples grow. Trees bear them."],
         "Red apples grow. Trees bear them."),
        ("empty", "q", "", [], "A fact."),
    ], "id string, question string, answer string, contexts array<string>, ground_truth string")


def test_component_metrics(eval_rows):
    got = {r.id: r for r in cm.component_metrics(eval_rows).collect()}
    good, bad, empty = got["good"], got["bad"], got["empty"]
    assert (good.context_precision, good.faithfulness, good.context_recall, good.answer_correctness, good.answer_similarity) == (
        1.0, 1.0, 1.0, 1.0, 1.0)
    assert good.context_relevancy == round(1 / 3, 6)
    assert (bad.context_precision, bad.faithfulness, bad.context_recall) == (0.5, 0.0, 1.0)
    assert bad.answer_correctness < 0.25
    assert all(getattr(empty, m) == 0 for m in cm.COMPONENT_METRICS)
    bounded = [m for m in cm.COMPONENT_METRICS if m not in ("answer_relevancy", "answer_similarity", "answer_correctness")]
    assert all(0 <= getattr(r, m) <= 1 for r in got.values() for m in bounded)
    one = cm.means(cm.component_metrics(eval_rows)).first()
    assert one.context_precision == 0.5


def test_ranked_precision(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, False)], "q string, rank int, rel boolean")
    got = {r.q: r.context_precision for r in cm.context_precision(df, ["q"], "rank", "rel").collect()}
    assert got == {"a": round((1 + 2 / 3) / 2, 6), "b": 0.0}
    arrays = df.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "rel"))).alias("s")).select(
        "q", F.round(cm.ranked_precision(F.transform("s", lambda s: s["rel"])), 6).alias("p"))
    assert {r.q: r.p for r in arrays.collect()} == got


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cm.cosine("a", "b")).collect()] == [round(1 / math.sqrt(2), 6), 0.0]


CALLS = "calls"


def sized_model(texts):
    return [[float(len(texts)), float(len(t))] for t in texts]


def test_embedding_batches(spark):
    df = spark.range(0, 400, 1, 1).select(F.when(F.col("id") != 7, F.col("id").cast("string")).alias("t"), "id")
    got = df.select("id", mx.embed_with(sized_model, max_batch=150)("t").alias("v")).orderBy("id").collect()
    assert got[7].v is None
    assert all(r.v[1] == len(str(r.id)) for r in got if r.id != 7)
    assert max(r.v[0] for r in got if r.v) == 150


def test_hashing_embedder():
    plain, unit = mx.HashingEmbedder(16), mx.HashingEmbedder(16, unit_length=True)
    a, b, none = plain(["x y x", "y x x", ""])
    assert (a == b).all() and not none.any()
    assert math.isclose((unit(["x y z"])[0] ** 2).sum(), 1.0, rel_tol=1e-6)


def test_metric_expressions_are_not_repeated(spark, eval_rows):
    plan = cm.component_metrics(eval_rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
