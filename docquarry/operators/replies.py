"""Replies of models kept in a table, so that a prompt is paid for once.

A reply is found by the name of the model and a digest of the prompt. Only distinct prompts without a reply are
sent; what they give goes into a folder of the batch, which counts once Spark has committed it. A
batch that is repeated after that sends nothing, one that failed before starts anew.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docquarry.config import NO_ANSWER, NO_QUESTION
from docquarry.functions.models import ModelFn, guarded_text_model
from docquarry.functions.text import render_prompt, stage
from docquarry.operators.evalset import ANSWER_TEMPLATE, QUESTION_TEMPLATE, read_response
from docquarry.session import committed_batches, materialize

_STORED = "digest string, reply string, error string"
#: A prompt that makes up more than one in so many rows counts as frequent; there are at most as many.
_FREQUENT = 1000
#: At most so many digests are sent to the rows to pick their prompts; for more, the rows are shuffled.
_FEW = 10_000
#: Bytes of prompts that a task sorts, about.
_TASK_BYTES = 1 << 27


@dataclass(frozen=True)
class StoredReplies:
    """Replies of the model called ``model``, under the folder ``path``. One writer at a time."""

    path: str
    model: str

    @property
    def _folder(self) -> str:
        return f"{self.path}/model={self.model}"

    def batches(self, spark: SparkSession) -> list[int]:
        return committed_batches(spark, self._folder)

    def _rows(self, spark: SparkSession) -> DataFrame:
        done = self.batches(spark)
        if not done:
            return spark.createDataFrame([], _STORED + ", batch int")
        return spark.read.option("basePath", self._folder).schema(_STORED + ", batch int").parquet(
            *[f"{self._folder}/batch={b}" for b in done])

    def stored(self, spark: SparkSession, digests: DataFrame | None = None) -> DataFrame:
        """``digest``, ``reply``, ``error`` and ``batch`` of every prompt sent, or of those among ``digests``; the latest
        attempt at a prompt."""
        own = None if digests is None else digests.select(F.unhex("digest").alias("_digest"))
        return self._latest(spark, own).select(_hex("_digest").alias("digest"), "reply", "error", "batch")

    def _sent(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark).withColumn("_digest", F.unhex("digest")).drop("digest")

    def _latest(self, spark: SparkSession, digests: DataFrame | None) -> DataFrame:
        """As :meth:`stored`, by the ``_digest`` in binary."""
        rows = self._sent(spark)
        if digests is not None:
            rows = rows.join(digests, "_digest", "left_semi")
        return rows.groupBy("_digest").agg(F.max_by(F.struct("reply", "error", "batch"), "batch").alias("_r")).select("_digest", "_r.*")

    def unseen(self, df: DataFrame, prompt: Sequence[Column]) -> DataFrame:
        """``digest`` and ``prompt`` (a struct) of the distinct prompts that have no reply yet, failed ones among them.

        Prompts with a NULL are passed over. Digests alone are compared with those stored; prompts are shuffled once.
        """
        keyed = _keyed(df, prompt)
        return self._unseen(keyed, prompt, _counted(keyed, prompt))

    def _unreplied(self, digests: DataFrame) -> DataFrame:
        """The rows of ``digests`` whose ``_digest`` has no reply yet."""
        return digests.join(self._sent(digests.sparkSession).where("error IS NULL").select("_digest"), "_digest", "left_anti")

    def _unseen(self, keyed: DataFrame, prompt: Sequence[Column], counts: DataFrame) -> DataFrame:
        new = materialize(self._unreplied(counts.where("octet_length(_digest) > 0").select("_digest")))
        texts = keyed.select("_digest", _struct(prompt).alias("prompt"))
        return _one_each(texts, "prompt", counts, new).select(_hex("_digest").alias("digest"), "prompt")

    def _send(self, new: DataFrame, n: int, model_fn: ModelFn, batch: int, threads: int) -> None:
        """Store the replies to ``new``, prompts of ``n`` parts, as ``batch``."""
        sent = new.withColumn("_r", guarded_text_model(model_fn, threads)(*[F.col(f"prompt.p{i}") for i in range(n)]))
        sent.select("digest", F.col("_r.value").alias("reply"), F.col("_r.error").alias("error")).write.mode("overwrite").parquet(
            f"{self._folder}/batch={batch}")

    def fill(self, df: DataFrame, prompt: Sequence[Column], model_fn: ModelFn, batch: int, threads: int = 1) -> None:
        """Send what is unseen, spread over all cores, and store the replies as ``batch``. A failed call keeps its error
        and is tried again by the next batch."""
        if batch not in self.batches(df.sparkSession):
            self._send(self.unseen(df, prompt), len(prompt), model_fn, batch, threads)

    def joined(self, df: DataFrame, prompt: Sequence[Column]) -> DataFrame:
        """``df`` with ``reply``, ``error`` and ``reply_batch`` of its prompts, NULL where there are none.

        ``df`` is read twice more and must not have columns of these names.
        """
        keyed = _keyed(df, prompt)
        counts = _counted(keyed, prompt)
        kept = materialize(self._latest(df.sparkSession, counts.select("_digest")).withColumnRenamed("batch", "reply_batch"))
        return _attached(keyed, counts, kept)

    def replied(self, df: DataFrame, prompt: Sequence[Column], model_fn: ModelFn, batch: int, threads: int = 1) -> DataFrame:
        """:meth:`fill`, then :meth:`joined`."""
        self.fill(df, prompt, model_fn, batch, threads)
        return self.joined(df, prompt)


def _digest(prompt: Sequence[Column]) -> Column:
    """SHA-256 of all parts, in binary, which is half as long; NULL if one is NULL, since such a prompt is never sent."""
    missing = F.lit(False)
    for part in prompt:
        missing = missing | part.isNull()
    parts = F.to_json(F.array(*[p.cast("string") for p in prompt]))
    return F.when(~missing, F.unhex(F.sha2(parts, 256)))


def _hex(digest: str) -> Column:
    """A digest as it is stored."""
    return F.lower(F.hex(digest))


def _struct(prompt: Sequence[Column]) -> Column:
    return F.struct(*[p.alias(f"p{i}") for i, p in enumerate(prompt)])


def _keyed(df: DataFrame, prompt: Sequence[Column]) -> DataFrame:
    """``df`` with the ``_digest`` of its prompts, empty for one that is never sent."""
    return df.withColumn("_digest", F.coalesce(_digest(prompt), F.lit(b"")))


def _counted(keyed: DataFrame, prompt: Sequence[Column]) -> DataFrame:
    """Rows and bytes of each digest, written."""
    size = sum((F.coalesce(F.octet_length(p.cast("string")), F.lit(0)) for p in prompt), F.lit(0).cast("long"))
    return materialize(keyed.groupBy("_digest").agg(F.count("*").alias("_rows"), F.sum(size).alias("_bytes")))


def _frequent(counts: DataFrame) -> DataFrame:
    """Digests of many rows, and the empty one: a bounded number."""
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    return F.broadcast(materialize(counts.where((F.col("_rows") * _FREQUENT > total) | (F.octet_length("_digest") == 0)).select("_digest")))


def _attached(keyed: DataFrame, counts: DataFrame, kept: DataFrame) -> DataFrame:
    """``keyed`` with the columns of ``kept``, which has at most one row per digest, in place of ``_digest``.

    What belongs to frequent prompts is sent to the rows; the other rows are shuffled by digest, of which none has many rows.
    """
    frequent = _frequent(counts)
    often = keyed.join(frequent, "_digest", "left_semi").join(F.broadcast(kept.join(frequent, "_digest", "left_semi")), "_digest", "left")
    seldom = keyed.join(frequent, "_digest", "left_anti").join(kept, "_digest", "left")
    return often.unionByName(seldom).drop("_digest")


def _one_each(texts: DataFrame, text: str, counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``, which has one row per digest, with the ``text`` of any row of that digest; spread over all cores.

    Equal digests have equal texts. Few digests, and frequent ones, are sent to the rows, and copies are dropped before the
    shuffle. The other rows are shuffled once, into partitions of a bounded size. Their join is an inner one because
    Spark would move a semi-join below the repartition and shuffle them for each.
    """
    spark = texts.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def one(rows: DataFrame) -> DataFrame:
        return rows.groupBy("_digest").agg(*[F.any_value(c).alias(c) for c in (*wanted.columns, text) if c != "_digest"])

    def picked(few: DataFrame) -> DataFrame:
        return one(texts.join(F.broadcast(few), "_digest")).repartition(cores, "_digest")

    if wanted.count() <= _FEW:
        return picked(wanted)
    frequent = _frequent(counts)
    size = counts.agg(F.sum("_bytes")).first()[0] or 0
    spread = texts.join(frequent, "_digest", "left_anti").repartition(max(cores, size // _TASK_BYTES + 1), "_digest")
    return one(spread.join(wanted, "_digest")).unionByName(picked(wanted.join(frequent, "_digest", "left_semi")))


def stored_eval_set(chunks: DataFrame, content: str, path: str, question_fn: ModelFn, answer_fn: ModelFn, batch: int,
                    models: tuple[str, str] = ("question", "answer"), threads: int = 1) -> DataFrame:
    """Chunks with ``question``, ``answer``, ``error`` and ``reply_batch`` (of the later call), from stored replies where there are any.

    Equal chunks share their replies. A chunk whose first call failed has no question and is not sent on. Replies are
    worked on once per distinct chunk and without its text, which is shuffled to send prompts only. An answer is found by
    the template, the digest of the prompt for its question, and the question, which say the same as the prompt.
    """
    spark = chunks.sparkSession
    asks, answers = (StoredReplies(path, model) for model in models)
    prompt = [render_prompt(QUESTION_TEMPLATE, {"context": content})]
    keyed = _keyed(chunks, prompt)
    counts = _counted(keyed, prompt)
    if batch not in asks.batches(spark):
        asks._send(asks._unseen(keyed, prompt, counts), 1, question_fn, batch, threads)
    digests = counts.select("_digest")
    replies = asks._latest(spark, digests).withColumnsRenamed({"error": "_error", "batch": "_asked"})
    asked = materialize(stage(digests.join(replies, "_digest", "left"), {
        "question": F.when(F.col("_error").isNull(), read_response("reply", "question", NO_QUESTION))}).drop("reply"))
    # A failed question is NULL, and so is the digest of what would be sent after it.
    key = _digest([F.lit(ANSWER_TEMPLATE), _hex("_digest"), F.col("question")])
    follows = asked.select(F.col("_digest").alias("_of"), key.alias("_digest"), "question", "_error", "_asked")
    sent = follows.where("_digest IS NOT NULL")
    if batch not in answers.batches(spark):
        new = answers._unreplied(sent.select("_digest", "_of", "question"))
        new = materialize(new.select(F.col("_of").alias("_digest"), F.col("_digest").alias("_follow"), "question"))
        texts = _one_each(keyed.select("_digest", F.col(content).alias("_text")), "_text", counts, new)
        follow = render_prompt(ANSWER_TEMPLATE, {"context": "_text", "question": "question"})
        answers._send(texts.select(_hex("_follow").alias("digest"), _struct([follow, F.col("question")]).alias("prompt")), 2, answer_fn, batch, threads)
    # Rows without a digest take no part in the join, where they would all be in one task.
    done = sent.join(answers._latest(spark, sent.select("_digest")), "_digest", "left").unionByName(
        follows.where("_digest IS NULL"), allowMissingColumns=True)
    failed = F.coalesce("_error", "error")
    kept = stage(done, {
        "answer": F.when(failed.isNull(), read_response("reply", "answer", NO_ANSWER)),
        "_failed": failed, "_batch": F.coalesce("batch", "_asked")}).select(
        F.col("_of").alias("_digest"), "question", "answer", F.col("_failed").alias("error"), F.col("_batch").alias("reply_batch"))
    return _attached(keyed, counts, materialize(kept))
