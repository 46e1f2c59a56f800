"""Question and answer sets generated from document chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docquarry.config import NO_ANSWER, NO_QUESTION
from docquarry.functions.models import ModelFn, guarded_text_model, text_model
from docquarry.functions.text import json_field_or_raw, normalize, or_sentinel, render_prompt, stage, words

QUESTION_TEMPLATE = "Ask one question that this passage answers. Reply as JSON with the key question.\nPassage: {context}"
ANSWER_TEMPLATE = (
    "Answer the question from the passage. Reply as JSON with the key answer.\nPassage: {context}\nQuestion: {question}"
)
BLANK = "____"


def _longest_word(tokens: Column) -> Column:
    """Position of the longest word, the first one of equal length."""
    keyed = F.transform(tokens, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("at")))
    return -F.array_max(keyed)["at"]


def cloze(df: DataFrame, content: str) -> DataFrame:
    """Add ``question`` and ``answer``: the text with its longest word blanked out, and that word.

    A text without words gives NULL for both.
    """
    tokens = stage(df, {"_words": words(content)})
    tokens = stage(tokens, {"_at": F.when(F.size("_words") > 0, _longest_word(F.col("_words")))})
    masked = F.transform(
        F.col("_words"), lambda w, i: F.when(i == F.col("_at"), F.lit(BLANK)).otherwise(w))
    return stage(tokens, {
        "question": F.when(F.col("_at").isNotNull(), F.array_join(masked, " ")),
        "answer": F.nullif(normalize(F.get("_words", F.col("_at"))), F.lit("")),
    }).drop("_words", "_at")


def cloze_responses(df: DataFrame, content: str) -> DataFrame:
    """What a generator would reply, as JSON: ``question_response`` and ``answer_response``."""
    made = cloze(df, content)
    def reply(name: str) -> Column:
        return F.to_json(F.struct(F.col(name).alias(name)), {"ignoreNullFields": "false"})
    return stage(made, {"question_response": reply("question"), "answer_response": reply("answer")}).drop(
        "question", "answer")


def read_response(response: Column | str, key: str, sentinel: str) -> Column:
    return or_sentinel(json_field_or_raw(response, key), sentinel)


def _generated(df: DataFrame, name: str, sentinel: str, model_fn: ModelFn, threads: int, guarded: bool, *inputs: Column) -> DataFrame:
    """Add the field ``name`` of the model's reply; guarded, also ``error``, which an earlier step may have set.

    A row that failed before is not sent again and has no field.
    """
    if not guarded:
        replied = df.withColumn("_reply", text_model(model_fn, threads)(*inputs))
        return stage(replied, {name: read_response("_reply", name, sentinel)}).drop("_reply")
    before = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    open_inputs = [F.when(before.isNull(), i) for i in inputs]
    replied = df.withColumn("_r", guarded_text_model(model_fn, threads)(*open_inputs))
    failed = F.coalesce(before, F.col("_r.error"))
    return stage(replied, {"_error": failed, name: F.when(failed.isNull(), read_response(F.col("_r.value"), name, sentinel))}).drop(
        "_r", "error").withColumnRenamed("_error", "error")


def generate_questions(df: DataFrame, content: str, model_fn: ModelFn, threads: int = 1, guarded: bool = False) -> DataFrame:
    """Add ``question`` from a model that sees every whole chunk once."""
    prompt = render_prompt(QUESTION_TEMPLATE, {"context": content})
    return _generated(df, "question", NO_QUESTION, model_fn, threads, guarded, prompt)


def generate_answers(df: DataFrame, content: str, question: str, model_fn: ModelFn, threads: int = 1, guarded: bool = False) -> DataFrame:
    """Add ``answer``; the model sees (prompt, question) pairs."""
    prompt = render_prompt(ANSWER_TEMPLATE, {"context": content, "question": question})
    return _generated(df, "answer", NO_ANSWER, model_fn, threads, guarded, prompt, F.col(question))


def generate_guarded(df: DataFrame, content: str, model_fn: ModelFn) -> DataFrame:
    """Add ``value`` and ``error``: rows whose model call fails are kept with their error.

    The result should be written before it is split with :func:`split_failures`; otherwise the
    model runs once for each part.
    """
    return df.withColumn("_r", guarded_text_model(model_fn)(F.col(content))).select("*", "_r.value", "_r.error").drop("_r")


def split_failures(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows) of a written table."""
    return df.where("error is null").drop("error"), df.where("error is not null").drop("value")


def usable(df: DataFrame) -> DataFrame:
    """Drop rows whose question or answer is marked as missing."""
    return df.where((F.col("question") != NO_QUESTION) & (F.col("answer") != NO_ANSWER))


def build_eval_set(chunks: DataFrame, content: str = "content", question_fn: ModelFn | None = None,
                   answer_fn: ModelFn | None = None, threads: int = 1, guarded: bool = False) -> DataFrame:
    """Chunks -> questions -> answers. Without models the cloze stand-in replies.

    ``guarded`` keeps chunks on which a model call fails, with their ``error`` and without what it would have
    given; the others go on.
    """
    if question_fn is None or answer_fn is None:
        replied = cloze_responses(chunks, content)
        return stage(replied, {
            "question": read_response("question_response", "question", NO_QUESTION),
            "answer": read_response("answer_response", "answer", NO_ANSWER),
        }).drop("question_response", "answer_response")
    asked = generate_questions(chunks, content, question_fn, threads, guarded)
    return generate_answers(asked, content, "question", answer_fn, threads, guarded)
