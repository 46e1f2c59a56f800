import pytest
from pyspark.sql import functions as F

from docquarry.config import NO_ANSWER
from docquarry.functions import html as hx, text as tx


def values(spark, inputs, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression.alias("y")).collect()]


def test_words(spark):
    assert values(spark, ["a  b\n c", "", "  ", None], tx.words("x")) == [["a", "b", "c"], [], [], None]
    assert values(spark, ["a b", "", " \n"], tx.token_count("x")) == [2, 0, 0]


def test_keywords_are_distinct_and_bare(spark):
    assert values(spark, ["The the, THE end!", "...", ""], tx.keywords("x")) == [["the", "end"], [], []]


def test_clean_text(spark):
    assert values(spark, ["a .\nb", "x\ny ."], tx.clean_text("x")) == ["a.b", "xy."]


def test_merge_sections(spark):
    assert values(spark, ["one\ntwo .\n\nthree", ""], tx.merge_sections("x")) == ["onetwo.\nthree", ""]


def test_sentences(spark):
    got = values(spark, ["Is it? Yes! Done .  Tail", "a\nb", "...", ""], tx.sentences("x"))
    assert got == [["Is it?", "Yes!", "Done.", "Tail"], ["a", "b"], [], []]


def test_sentence_of_blanks_is_dropped(spark):
    assert values(spark, ["0 is. 1 is.  \n 2"], tx.sentences("x")) == [["0 is.", "1 is.", "2"]]


def test_prompt_slots_in_data_are_not_filled(spark):
    template = "Q: {question} C: {context} {{raw}}"
    got = values(spark, ["what is {context}?", None], tx.render_prompt(template, {"question": "x", "context": F.lit("ctx")}))
    assert got == ["Q: what is {context}? C: ctx {raw}", "Q:  C: ctx {raw}"]


def test_prompt_needs_every_slot():
    with pytest.raises(KeyError):
        tx.render_prompt("{a}{b}", {"a": "x"})


def test_parse_label(spark):
    replies = ["Yes", "no.", "I do not know", "maybe", "", None, "YES, no"]
    assert values(spark, replies, tx.parse_label("x")) == ["yes", "no", "no", "other", "other", "other", "yes"]
    assert values(spark, replies, tx.parse_label("x", strict=True)) == ["yes", "no", "other", "other", "other", "other", "yes"]


def test_json_field_or_raw(spark):
    inputs = ['{"answer": "x"}', '{"answer": null}', '{"b": 1}', "plain", "", '{"answer": 5}', None]
    assert values(spark, inputs, tx.json_field_or_raw("x", "answer")) == ["x", None, '{"b": 1}', "plain", "", "5", None]
    marked = values(spark, inputs, tx.or_sentinel(tx.json_field_or_raw("x", "answer"), NO_ANSWER))
    assert marked[1] == NO_ANSWER and marked[0] == "x"


def test_urls(spark):
    urls = ["https://h/a/b.pdf?x=1#t", "https://h/dir/", "plain name.pdf"]
    assert values(spark, urls, tx.file_name("x")) == ["b.pdf", "", "plain name.pdf"]
    assert values(spark, urls, tx.strip_prefix("x", "https://h/")) == ["a/b.pdf?x=1#t", "dir/", "plain name.pdf"]
    assert values(spark, urls, tx.escape_spaces("x"))[2] == "plain%20name.pdf"
    assert values(spark, ["a\nb"], tx.newline_to_break("x")) == ["a<br/>b"]


def test_versions(spark):
    tags = ["11.3.x-scala", "11.10", "9.9", "12.0", "none"]
    assert values(spark, tags, tx.version_at_least("x", "11.3")) == [True, True, False, True, None]


def test_readability_of_empty_text(spark):
    df = spark.createDataFrame([("",)], "x string").select(
        tx.flesch_kincaid(tx.token_count("x"), F.size(tx.sentences("x")), tx.syllable_count("x")).alias("fk"))
    assert df.first()[0] is None


def test_stage_evaluates_once(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("x"))
    staged = tx.stage(df, {"w": tx.normalize("x")}).where("w <> '' and w <> 'zz'")
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_article(spark):
    pages = ["<p>n</p><article class='a'> <b>A &amp; B</b>\n c </article><article>2</article>", "<div>none</div>", None]
    assert values(spark, pages, hx.element_html("x")) == ["<article class='a'> <b>A &amp; B</b>\n c </article>", None, None]
    assert values(spark, pages, hx.article_text("x")) == ["A & B c", None, None]


def test_nested_element(spark):
    page = '<div>0</div><div class="x" itemprop="articleBody">a<div>b<divider/></div>c</div><div>d</div>'
    extract = hx.nesting_element_html("div", "itemprop", "articleBody")
    got = values(spark, [page, "<div>none</div>", '<div itemprop="articleBody">open', None], extract(F.col("x")))
    assert got == ['<div class="x" itemprop="articleBody">a<div>b<divider/></div>c</div>', None, None, None]
