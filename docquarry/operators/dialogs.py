"""Dialogs as tables.

The long form ``(conv_id, turn, role, text)`` is the working form: its operators use joins and
partially aggregated maxima of turns, so a conversation that holds a large part of all rows does not end up
in one task. The nested form ``messages ARRAY<STRUCT<role, content>>`` is what a chat client sends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docquarry.functions.text import newline_to_break

SEGMENT_TURNS = 256


def last_turns(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))


def extract_question(messages: DataFrame, last_user: bool = False) -> DataFrame:
    """``(conv_id, turn, question)``: the last message whatever its role, or the last user message."""
    rows = messages.where(F.col("role") == "user") if last_user else messages
    # Only keys and turns are aggregated; the text is fetched by (conversation, turn).
    last = last_turns(rows).withColumnRenamed("last_turn", "turn")
    return rows.join(last, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("question"))


def extract_history(messages: DataFrame) -> DataFrame:
    """All messages but the last of each conversation, in long form.

    Matched on (conversation, turn): a conversation with very many turns is spread over all tasks.
    """
    last = last_turns(messages).withColumnRenamed("last_turn", "turn")
    return messages.join(last, ["conv_id", "turn"], "left_anti").select(messages.columns)


def question_of(messages: Column | str) -> Column:
    """Question of a nested dialog; NULL for an empty one."""
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.try_element_at(m, F.lit(-1))["content"]


def history_of(messages: Column | str) -> Column:
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0)))


def history_text(history: Column | str) -> Column:
    """``role: content`` lines of a nested history."""
    h = F.col(history) if isinstance(history, str) else history
    return F.array_join(F.transform(h, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def from_dialogs(dialogs: DataFrame, messages: str = "messages") -> DataFrame:
    """Nested to long form, turns counted from 0."""
    return dialogs.select("conv_id", F.posexplode(messages).alias("turn", "_m")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("_m.role").alias("role"),
        F.col("_m.content").alias("text"))


def _in_order(rows: DataFrame, line: Column, separator: str) -> DataFrame:
    """Join the lines of each conversation in turn order, segment by segment.

    Only runs of ``SEGMENT_TURNS`` turns are collected at a time; the second step then sorts a few
    long pieces instead of every message. The resulting text is one value by its nature.
    """
    def joined(order: str, value: str) -> Column:
        return F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value]), separator)

    pieces = rows.select("conv_id", "turn", line.alias("_line")).withColumn(
        "_segment", F.floor(F.col("turn") / SEGMENT_TURNS))
    pieces = pieces.groupBy("conv_id", "_segment").agg(joined("turn", "_line").alias("_piece"))
    return pieces.groupBy("conv_id").agg(joined("_segment", "_piece").alias("text"))


def render_history(messages: DataFrame) -> DataFrame:
    """``(conv_id, chat_history)``, one ``role: text`` line per earlier message; one-message dialogs have none."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    return _in_order(extract_history(messages), line, "\n").withColumnRenamed("text", "chat_history")


def transcript_line(role: Column | str, text: Column | str) -> Column:
    """User turns and all other turns are marked differently; line breaks become ``<br/>``."""
    role = F.col(role) if isinstance(role, str) else role
    return F.concat(F.when(role == "user", "> ").otherwise("< "), newline_to_break(text))


def transcripts(messages: DataFrame) -> DataFrame:
    """``(conv_id, transcript)`` of whole conversations."""
    return _in_order(messages, transcript_line("role", "text"), "\n").withColumnRenamed("text", "transcript")


def dialog_state(messages: DataFrame) -> DataFrame:
    """What the answer chain needs of a conversation, one row each.

    ``question`` is the last message, ``previous_user`` the last user message before it and
    ``n_history`` the number of earlier messages. Both sides are cut to at most two rows per
    conversation and task before their shuffle, by partial aggregation and by the ranking limit.
    """
    counted = messages.groupBy("conv_id").agg(F.max("turn").alias("turn"), (F.count(F.lit(1)) - 1).alias("n_history"))
    last = messages.join(counted, ["conv_id", "turn"]).select(
        "conv_id", F.col("turn").alias("last_turn"), F.col("text").alias("question"), "n_history")
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    users = (
        messages.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("_text"))
        .withColumn("_place", F.row_number().over(newest)).where("_place <= 2")
    )
    # Of the two newest user turns the first one before the last message.
    before = users.join(last.select("conv_id", "last_turn"), "conv_id").where("turn < last_turn")
    previous = before.withColumn("_place", F.row_number().over(newest)).where("_place = 1")
    return last.join(previous.select("conv_id", F.col("_text").alias("previous_user")), "conv_id", "left").select(
        "conv_id", "question", "previous_user", "n_history")


def append_turns(messages: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Append a user turn, then an assistant turn, from ``(conv_id, user_text, assistant_text)``.

    Unknown conversations start at turn 0.
    """
    new = exchanges.join(last_turns(messages), "conv_id", "left").select(
        "conv_id",
        F.explode(F.array(
            F.struct(F.lit(1).alias("step"), F.lit("user").alias("role"), F.col("user_text").alias("text")),
            F.struct(F.lit(2).alias("step"), F.lit("assistant").alias("role"), F.col("assistant_text").alias("text")),
        )).alias("_m"),
        F.coalesce("last_turn", F.lit(-1)).alias("_last"),
    ).select("conv_id", (F.col("_last") + F.col("_m.step")).alias("turn"), "_m.role", "_m.text")
    return messages.select("conv_id", "turn", "role", "text").unionByName(new)


def question_answer_pairs(messages: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows directly: ``(conv_id, turn, question, expected_answer)``.

    The join key is (conversation, turn), so no conversation is gathered in one place.
    """
    asked = messages.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    replied = messages.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expected_answer"))
    return asked.join(replied, ["conv_id", "turn"])


def missing_responses(messages: DataFrame) -> DataFrame:
    """User turns that no assistant turn follows."""
    asked = messages.where(F.col("role") == "user").select("conv_id", "turn", "text")
    replied = messages.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return asked.join(replied, ["conv_id", "turn"], "left_anti")
