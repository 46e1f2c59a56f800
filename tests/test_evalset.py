from docquarry.config import NO_ANSWER, NO_QUESTION
from docquarry.operators import evalset


def chunk_frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, content string")


def test_cloze(spark):
    df = evalset.cloze(chunk_frame(spark, "a longest, word longword", "", "..."), "content")
    got = [(r.question, r.answer) for r in df.orderBy("id").collect()]
    assert got == [("a ____ word longword", "longest"), (None, None), ("____", None)]


def test_default_eval_set_marks_what_is_missing(spark):
    made = evalset.build_eval_set(chunk_frame(spark, 'say "hello there"', ""))
    got = {r.id: (r.question, r.answer) for r in made.collect()}
    assert got == {0: ('say ____ there"', "hello"), 1: (NO_QUESTION, NO_ANSWER)}
    assert [r.id for r in evalset.usable(made).collect()] == [0]


def question_model(prompts):
    replies = []
    for prompt in prompts:
        passage = prompt.split("Passage: ", 1)[1]
        replies.append({"none": '{"question": null}', "raw": "not json"}.get(passage, f'{{"question": "about {passage}?"}}'))
    return replies


def answer_model(rows):
    return [f'{{"answer": "{question} yes"}}' if prompt.endswith(question) else "mismatch" for prompt, question in rows]


def test_models_see_whole_chunks(spark):
    made = evalset.build_eval_set(chunk_frame(spark, "one two", "none", "raw"), "content", question_model, answer_model)
    got = {r.id: (r.question, r.answer) for r in made.collect()}
    assert got == {0: ("about one two?", "about one two? yes"), 1: (NO_QUESTION, NO_QUESTION + " yes"),
                   2: ("not json", "not json yes")}


def test_threads_keep_the_order(spark):
    df = chunk_frame(spark, *[f"c{i}" for i in range(40)])
    got = evalset.generate_questions(df, "content", question_model, threads=5).collect()
    assert all(r.question == f"about {r.content}?" for r in got)


def failing_model(texts):
    if texts[0] == "bad":
        raise RuntimeError("no reply")
    return [t.upper() for t in texts]


def test_a_failing_row_does_not_stop_the_others(spark):
    good, bad = evalset.split_failures(evalset.generate_guarded(chunk_frame(spark, "a", "bad", "c"), "content", failing_model))
    assert sorted(r["value"] for r in good.collect()) == ["A", "C"]
    assert [(r.content, r.error) for r in bad.collect()] == [("bad", "RuntimeError: no reply")]
