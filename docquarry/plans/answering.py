"""Answering conversations and questions against a chunk table, all rows in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from docquarry.config import RunConfig
from docquarry.functions import text as tx
from docquarry.functions.models import (
    HashingEmbedder, ModelFn, embed_with, overlap_count, relevance_reply, text_model)
from docquarry.operators.dialogs import dialog_state, render_history
from docquarry.operators.numbering import first_rows
from docquarry.operators.retrieval import BROADCAST_BYTES, VectorTable, similarity_topk
from docquarry.session import materialize

REFUSAL = "This question lies outside the subject area, so it is not answered here."
NO_PASSAGE = "No passage that answers this question was found."
GATE_TEMPLATE = "Say yes or no: does the question belong to the subject area?\nEarlier turns:\n{chat_history}\nQuestion: {question}"
REWRITE_TEMPLATE = "Write one search query for the question.\nEarlier turns:\n{chat_history}\nQuestion: {question}"
ANSWER_TEMPLATE = (
    "Answer the question from the passages and the earlier turns.\n"
    "Earlier turns:\n{chat_history}\n\nPassages:\n{context}\n\nQuestion: {question}"
)


@dataclass(frozen=True)
class Models:
    """Model functions of the chain; ``None`` selects the native stand-in.

    ``threads`` bounds the calls of one task, ``concurrency`` the tasks that call the answer model.
    """

    embed: ModelFn | None = None
    classify: ModelFn | None = None
    rewrite: ModelFn | None = None
    generate: ModelFn | None = None
    threads: int = 1
    concurrency: int | None = None

    @property
    def any_prompted(self) -> bool:
        return any(f is not None for f in (self.classify, self.rewrite, self.generate))


@dataclass(frozen=True)
class Gate:
    """Subject area of the stand-in gate: enough of ``terms`` must occur."""

    terms: Sequence[str]
    min_hits: int = 1


def embed_text(text: Column | str, embed_fn: ModelFn | None, dim: int) -> Column:
    """The hashing stand-in works on normalised words, a model on the text as it is."""
    return embed_with(HashingEmbedder(dim))(tx.normalize(text)) if embed_fn is None else embed_with(embed_fn)(tx._col(text))


def embed_chunks(chunks: DataFrame, content: str = "content", embed_fn: ModelFn | None = None,
                 dim: int = 64) -> DataFrame:
    return chunks.withColumn("embedding", embed_text(content, embed_fn, dim))


def gate_reply(state: DataFrame, models: Models, gate: Gate) -> DataFrame:
    """Add ``reply``, the gate's free-text answer, and ``label``, what it is read as."""
    if models.classify is None:
        reply = relevance_reply("question", "previous_user", gate.terms, gate.min_hits)
    else:
        prompt = tx.render_prompt(GATE_TEMPLATE, {"chat_history": "chat_history", "question": "question"})
        reply = text_model(models.classify, models.threads)(prompt)
    gated = tx.stage(state, {"reply": reply})
    gated = tx.stage(gated, {"label": tx.parse_label("reply")})
    return gated


def rewrite_query(state: DataFrame, models: Models, always: bool = False) -> DataFrame:
    """Add ``query``: the question itself without history, else a rewritten one.

    The stand-in puts the previous user message before the question. A model only sees the rows that
    need it; with ``always`` it also gets first questions.
    """
    if models.rewrite is None:
        return state.withColumn("query", F.when(
            F.col("n_history") > 0, F.concat_ws(" ", "previous_user", "question")).otherwise(F.col("question")))
    needs = F.lit(True) if always else F.col("n_history") > 0
    prompt = tx.render_prompt(REWRITE_TEMPLATE, {"chat_history": "chat_history", "question": "question"})
    rewritten = state.where(needs).withColumn("query", text_model(models.rewrite, models.threads)(prompt))
    # The query is read by retrieval and by the answer step, so the model's text is kept.
    return materialize(rewritten.unionByName(state.where(~needs).withColumn("query", F.col("question"))))


def best_sentence(content: Column, asked: Column) -> Column:
    """Sentence sharing most words with the question keywords, the first of equals, as ``(hits, at, sentence)``."""
    return F.array_max(F.transform(tx.sentences(content), lambda s, i: F.struct(
        overlap_count(tx.keywords(s), asked).alias("hits"), (-i).alias("at"), s.alias("sentence"))))


def retrieve(asked: DataFrame, chunks: DataFrame, key: Sequence[str], chunk_key: Sequence[str], config: RunConfig,
             models: Models) -> DataFrame:
    """k nearest chunks of every row's ``query``: ``(*key, *chunk_key, rank, score)``."""
    queries = asked.select(*key, embed_text("query", models.embed, config.dim).alias("embedding"))
    return similarity_topk(
        VectorTable(queries, tuple(key)), VectorTable(chunks, tuple(chunk_key)), config.k, config.dim)


def with_passages(asked: DataFrame, hits: DataFrame, chunks: DataFrame, key: Sequence[str],
                  chunk_key: Sequence[str]) -> DataFrame:
    """Add ``passages`` in rank order, at most k per row.

    Retrieval moves keys only. The distinct keys of the winners, while they are below a byte bound, are sent
    to the scan of the chunk table, so only winners' texts leave it; beyond the bound the join shuffles and
    prunes as Spark sees fit, with the same rows. ``key`` has to be unique in ``asked``.
    """
    terms = tx.stage(asked.select(*key, "question"), {"asked": tx.keywords("question")}).drop("question")
    hits = materialize(hits)
    wanted = hits.select(*chunk_key).distinct()
    size = hits.agg(F.sum(sum(F.octet_length(F.col(c).cast("string")) + 16 for c in chunk_key)).alias("n")).first()["n"] or 0
    picked = chunks.select(*chunk_key, "url", "content").join(
        F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, list(chunk_key), "left_semi")
    texts = hits.join(terms, list(key)).join(picked, list(chunk_key))
    best = texts.withColumn("best", best_sentence(F.col("content"), F.col("asked")))
    grouped = best.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("rank", "url", "content", "score", "best"))).alias("passages"))
    return asked.join(grouped, list(key), "left").withColumn(
        "passages", F.coalesce("passages", F.array().cast(grouped.schema["passages"].dataType)))


def format_context(passages: Column | str) -> Column:
    return F.array_join(F.transform(tx._col(passages), lambda p: p["content"]), "\n\n")


def extract_sources(passages: Column | str) -> Column:
    """URLs in rank order, repeats kept."""
    return F.transform(tx._col(passages), lambda p: p["url"])


def extractive_answer(passages: Column | str) -> Column:
    """Best sentence over all passages; an earlier rank wins a tie."""
    ranked = F.transform(tx._col(passages), lambda p: F.struct(
        p["best"]["hits"].alias("hits"), (-p["rank"]).alias("rank"), p["best"]["sentence"].alias("sentence")))
    return F.coalesce(F.array_max(ranked)["sentence"], F.lit(NO_PASSAGE))


def answer_rows(asked: DataFrame, chunks: DataFrame, key: Sequence[str], chunk_key: Sequence[str], config: RunConfig,
                models: Models) -> DataFrame:
    """Retrieve and answer rows that have ``question``, ``query`` and, for models, ``chat_history``.

    ``asked`` is read by retrieval and again to attach the passages, so it should be a stored table.
    """
    hits = retrieve(asked, chunks, key, chunk_key, config, models)
    ready = with_passages(asked, hits, chunks, key, chunk_key)
    if models.generate is None:
        result = extractive_answer("passages")
    else:
        if models.concurrency:
            ready = ready.repartition(models.concurrency)
        result = text_model(models.generate, models.threads)(tx.render_prompt(ANSWER_TEMPLATE, {
            "chat_history": "chat_history", "context": format_context("passages"), "question": "question"}))
    return ready.withColumn("result", result).withColumn("sources", extract_sources("passages"))


def answer_dialogs(messages: DataFrame, chunks: DataFrame, gate: Gate, config: RunConfig = RunConfig(),
                   models: Models = Models(), chunk_key: Sequence[str] = ("doc_id", "chunk_no"),
                   always_rewrite: bool = False) -> DataFrame:
    """``(conv_id, label, result, sources)`` for every conversation.

    ``chunks`` holds the chunk key, ``url``, ``content`` and ``embedding``. Only rows the gate lets
    through reach retrieval and the answer model; all others get the refusal and no sources. The
    history is rendered only if some model reads it.
    """
    state = dialog_state(messages)
    if models.any_prompted:
        state = state.join(render_history(messages), "conv_id", "left")
    # Written once: both branches and several steps of the first one read it, and a model's reply
    # must be the same for all of them.
    gated = materialize(gate_reply(state, models, gate))
    relevant = rewrite_query(gated.where("label = 'yes'"), models, always_rewrite)
    answered = answer_rows(relevant, chunks, ["conv_id"], chunk_key, config, models)
    refused = gated.where("label <> 'yes'").select(
        "conv_id", "label", F.lit(REFUSAL).alias("result"), F.array().cast("array<string>").alias("sources"))
    return answered.select("conv_id", "label", "result", "sources").unionByName(refused)


def predict_answers(questions: DataFrame, chunks: DataFrame, key: Sequence[str], config: RunConfig = RunConfig(),
                    models: Models = Models(), gate: Gate | None = None,
                    chunk_key: Sequence[str] = ("doc_id", "chunk_no")) -> DataFrame:
    """Answer a table of single questions: each one is a dialog of one message.

    Adds ``answer``, ``contexts`` and ``sources``. With a gate, refused questions get the refusal.
    """
    state = questions.withColumns({
        "previous_user": F.lit(None).cast("string"), "n_history": F.lit(0), "chat_history": F.lit("")})
    refused = None
    if gate is not None:
        state = materialize(gate_reply(state, models, gate))
        refused, state = state.where("label <> 'yes'"), state.where("label = 'yes'")
    else:
        state = materialize(state)
    done = answer_rows(rewrite_query(state, models), chunks, key, chunk_key, config, models).select(
        *questions.columns, F.col("result").alias("answer"),
        F.transform("passages", lambda p: p["content"]).alias("contexts"), "sources")
    if refused is None:
        return done
    none = F.array().cast("array<string>")
    return done.unionByName(refused.select(
        *questions.columns, F.lit(REFUSAL).alias("answer"), none.alias("contexts"), none.alias("sources")))


def replay_questions(questions: DataFrame, chunks: DataFrame, key: Sequence[str], limit: int, concurrency: int,
                     config: RunConfig = RunConfig(), models: Models = Models()) -> DataFrame:
    """Answer the first ``limit`` questions by key with at most ``concurrency`` tasks calling the model."""
    head = first_rows(questions, key, limit)
    return predict_answers(head, chunks, key, config, replace(models, concurrency=concurrency))
