import pytest
from pyspark.sql import functions as F

from docquarry.operators import dialogs, links, monitoring


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([
        ("one", 0, "user", "only question"),
        ("three", 0, "user", "first"),
        ("three", 1, "assistant", "reply\nwith break"),
        ("three", 2, "user", "second"),
        ("ends", 0, "system", "be brief"),
        ("ends", 1, "user", "asked"),
        ("ends", 2, "assistant", "answered"),
    ], "conv_id string, turn long, role string, text string")


def test_question_is_the_last_message(turns):
    got = {r.conv_id: (r.turn, r.question) for r in dialogs.extract_question(turns).collect()}
    assert got == {"one": (0, "only question"), "three": (2, "second"), "ends": (2, "answered")}
    users = {r.conv_id: r.question for r in dialogs.extract_question(turns, last_user=True).collect()}
    assert users == {"one": "only question", "three": "second", "ends": "asked"}


def test_history_is_the_rest(turns):
    got = sorted((r.conv_id, r.turn) for r in dialogs.extract_history(turns).collect())
    assert got == [("ends", 0), ("ends", 1), ("three", 0), ("three", 1)]
    texts = {r.conv_id: r.chat_history for r in dialogs.render_history(turns).collect()}
    assert texts == {"ends": "system: be brief\nuser: asked", "three": "user: first\nassistant: reply\nwith break"}


def test_state(turns):
    got = {r.conv_id: (r.question, r.previous_user, r.n_history) for r in dialogs.dialog_state(turns).collect()}
    assert got == {"one": ("only question", None, 0), "three": ("second", "first", 2), "ends": ("answered", "asked", 2)}


def test_nested_dialogs(spark):
    schema = "conv_id int, messages array<struct<role string, content string>>"
    df = spark.createDataFrame([(1, []), (2, [("user", "q")]), (3, [("user", "a"), ("assistant", "b"), ("user", "c")])], schema)
    got = df.orderBy("conv_id").select(
        dialogs.question_of("messages"), F.size(dialogs.history_of("messages")),
        dialogs.history_text(dialogs.history_of("messages"))).collect()
    assert [tuple(r) for r in got] == [(None, 0, ""), ("q", 0, ""), ("c", 2, "user: a\nassistant: b")]
    long = sorted((r.conv_id, r.turn, r.role, r.text) for r in dialogs.from_dialogs(df).collect())
    assert long == [(2, 0, "user", "q"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c")]


def test_long_conversation_keeps_its_order(spark):
    """More turns than one segment holds, most rows in one conversation."""
    n = dialogs.SEGMENT_TURNS * 3 + 7
    df = spark.range(n).select(F.lit("hot").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                               F.col("id").cast("string").alias("text")).repartition(6)
    history = dialogs.render_history(df).first().chat_history
    assert history == "\n".join(f"user: {i}" for i in range(n - 1))


def test_transcripts(turns):
    got = {r.conv_id: r.transcript for r in dialogs.transcripts(turns).collect()}
    assert got["three"] == "> first\n< reply<br/>with break\n> second"


def test_append(spark, turns):
    new = spark.createDataFrame([("three", "more?", "sure"), ("new", "hi", "hello")],
                                "conv_id string, user_text string, assistant_text string")
    got = dialogs.append_turns(turns, new)
    assert got.count() == turns.count() + 4
    tail = sorted((r.conv_id, r.turn, r.role, r.text) for r in got.collect() if r.text in ("more?", "sure", "hi", "hello"))
    assert tail == [("new", 0, "user", "hi"), ("new", 1, "assistant", "hello"),
                    ("three", 3, "user", "more?"), ("three", 4, "assistant", "sure")]


def test_pairs_and_missing(turns):
    pairs = sorted((r.conv_id, r.turn, r.expected_answer) for r in dialogs.question_answer_pairs(turns).collect())
    assert pairs == [("ends", 1, "answered"), ("three", 0, "reply\nwith break")]
    missing = sorted((r.conv_id, r.turn) for r in dialogs.missing_responses(turns).collect())
    assert missing == [("one", 0), ("three", 2)]


def test_resolve_sources(spark):
    answers = spark.createDataFrame(
        [(1, ["d/a.pdf", "d/b c.pdf", "d/a.pdf"]), (2, []), (3, ["d/unknown.pdf"])], "id int, sources array<string>")
    table = spark.createDataFrame([("a.pdf", "http://l/a x"), ("b c.pdf", "http://l/b")], "file_name string, link string")
    resolved = links.resolve_sources(answers, table, "id")
    got = sorted((r.id, r.source_no, r.name, r.link) for r in resolved.collect() if r.link)
    assert got == [(1, 0, "a.pdf", "http://l/a%20x"), (1, 1, "b c.pdf", "http://l/b")]
    lists = {r.id: r.links for r in links.source_lists(resolved, "id").collect()}
    assert lists == {1: ["http://l/a%20x", "http://l/b"], 3: ["unknown.pdf"]}


def test_latest_version(spark):
    df = spark.createDataFrame([("m", "2"), ("m", "10"), ("m", "x"), ("n", "0"), ("o", None)], "name string, version string")
    got = {r["name"]: r.latest_version for r in monitoring.latest_version(df, "name", "version").collect()}
    assert got == {"m": 10, "n": 1, "o": 1}


def test_log_completeness(spark):
    asked = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int")
    log = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert tuple(monitoring.log_completeness(asked, log, ["id"]).first()) == (4, 3, False)
    assert monitoring.log_completeness(asked.where("id < 3"), log, ["id"]).first().complete


def test_compare_runs(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 0.9)], "run string, s double")
    got = [(r.run, r.n, r.mean_score, r.rank) for r in monitoring.compare_runs(df, ["run"], "s").orderBy("rank").collect()]
    assert got == [("b", 1, 0.9, 1), ("a", 2, 0.5, 2)]


def test_latest_rows_aggregate_no_payload(spark):
    from docquarry.operators.index import latest_rows

    rows = [(1, 1, 5, "a"), (1, 2, 1, "b"), (1, 2, 3, "c"), (2, None, None, "d"), (None, 1, 1, "e"), (1, 2, 3, "c")]
    changes = spark.createDataFrame(rows, "k int, v int, w int, text string")
    latest = latest_rows(changes, "k", ["v", "w"])
    assert {tuple(r) for r in latest.collect()} == {(1, 2, 3, "c"), (2, None, None, "d"), (None, 1, 1, "e")} and latest.count() == 3
    messages = spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    for df in (latest, dialogs.extract_question(messages), dialogs.dialog_state(messages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
