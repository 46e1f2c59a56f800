"""Filter interaction audit by the Hart-Mas-Colell potential.

The filters are the players of a game whose worth for a coalition is the number of documents that it removes. Documents
are first reduced to counts per part and set of failed filters, so whatever their number, a part has at
most 2^n of them. From these come the worths of all coalitions, and from the worths the potentials:

    P(S) = (worth(S) + sum of P(S without i) for i in S) / |S|

The Shapley value of a filter is P(all) - P(all without it). Multiplied by n! all potentials are whole numbers,
so nothing is rounded. What a filter does at its place in an order is a difference of two coalitions: those before
it, with and without it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
import json
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from docquarry.functions.text import stage
from docquarry.session import materialize

BLANKS = r"[\x20\x09-\x0D]+"


def _sum(parts: Sequence[str]) -> str:
    return " + ".join(parts) if parts else "0"


def coalitions(counts: DataFrame, n: int, part: str, measures: Sequence[str]) -> DataFrame:
    """One row per ``part`` with the worth of every coalition for every measure, as columns ``worth_<measure>_<coalition>``.

    ``counts`` has ``part``, ``failed`` (bits of the filters failed) and the measures. The worth is the sum over rows that
    fail a filter of the coalition; ``total_<measure>`` is the sum over all rows.
    """
    out = [F.sum(m).alias(f"total_{m}") for m in measures]
    for s in range(1 << n):
        hit = F.col("failed").bitwiseAND(F.lit(s)) != 0
        out += [F.sum(F.when(hit, F.col(m)).otherwise(0)).alias(f"worth_{m}_{s}") for m in measures]
    return counts.groupBy(part).agg(*out)


def potentials(worths: DataFrame, n: int, measure: str) -> DataFrame:
    """``worths`` with the potential of every coalition times n!, as columns ``potential_<coalition>``, by rising size."""
    scale = factorial(n)
    worths = worths.withColumn("potential_0", F.lit(0).cast("long"))
    for size in range(1, n + 1):
        new = {}
        for s in (s for s in range(1 << n) if s.bit_count() == size):
            smaller = [f"potential_{s & ~(1 << i)}" for i in range(n) if s >> i & 1]
            new[f"potential_{s}"] = F.expr(f"({scale} * worth_{measure}_{s} + {_sum(smaller)}) div {size}")
        # Written into each other, the levels would grow like n!.
        worths = stage(worths, new)
    return worths


def steps(worths: DataFrame, names: str, part: str, rows: str, losses: dict[str, str]) -> DataFrame:
    """One row per part, order of all filters and step; see :func:`audit` for the columns."""
    n = len(names)
    every = (1 << n) - 1
    known = potentials(worths, n, rows)

    def listed(prefix: str) -> Column:
        return F.array(*[F.col(f"{prefix}_{s}") for s in range(1 << n)]).alias(prefix)

    known = known.select(part, f"total_{rows}", listed("potential"), *[listed(f"worth_{m}") for m in {rows: 0, **losses}])
    plan = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            plan.append({"filter_order": "".join(names[k] for k in order), "step": step, "bit": 1 << i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    places = F.from_json(F.lit(json.dumps(plan)), "array<struct<filter_order string, step int, bit int, before int, after int>>")
    each = known.select("*", F.inline(places))

    def gain(measure: str) -> Column:
        worth = F.col(f"worth_{measure}")
        return worth[F.col("after")] - worth[F.col("before")]

    worth = F.col(f"worth_{rows}")
    return each.select(
        part, "filter_order", "step", (F.col(f"total_{rows}") - worth[F.col("after")]).alias("kept"), gain(rows).alias("removed"),
        (worth[F.col("bit")] - gain(rows)).alias("redundant"), (worth[every] - worth[F.lit(every) - F.col("bit")]).alias("unique_fails"),
        *[gain(m).alias(name) for m, name in losses.items()],
        (F.col("potential")[every] - F.col("potential")[F.lit(every) - F.col("bit")]).alias("shapley"))


def failed_bits(conditions: Sequence[Column]) -> Column:
    """A number whose n-th bit is set where the n-th condition holds."""
    out = F.lit(0)
    for i, condition in enumerate(conditions):
        out = out + F.when(condition, F.lit(1 << i)).otherwise(0)
    return out


def later_copies(rows: DataFrame, doc: str, digest: str) -> DataFrame:
    """``rows``, whose equal ones are counted in ``n``, with ``_copy``: whether a smaller id has the same digest.

    The smallest id of a digest is found by an aggregation that starts before the shuffle, and rows are matched with
    it on digest and id together, so a text that a third of all rows hold is no hot key. Rows without an id are no copies.
    """
    first = rows.groupBy(F.col(digest).alias("_digest")).agg(F.min(doc).alias("_first")).where("_first IS NOT NULL")
    met = rows.join(first, (F.col(digest) == F.col("_digest")) & (F.col(doc) == F.col("_first")), "left")
    return met.withColumn("_copy", F.col("_first").isNull() & F.col(doc).isNotNull()).drop("_digest", "_first")


def text_conditions(words: Column, text: Column) -> list[Column]:
    """Conditions A to D on the words and the text of a document."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]")]


def audit(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Effect of the filters A to E at every step of every order, per ``part``.

    A fails texts of under 50 words, B those whose distinct words are below 65 percent, C those with over 5 percent
    capitals A-Z, D those with any of ``#$%&*|``, E those that a row with a smaller id has too. Columns: ``part``,
    ``filter_order``, ``step``, ``kept`` (after the step), ``removed`` (by it), ``redundant`` (failing its filter,
    removed before), ``unique_fails`` (failing its filter alone), ``good_lost`` and ``toxic_lost`` (removed by it with label 1) and
    ``shapley`` (removed by its filter, summed over all orders).

    A NULL text is empty and a NULL part is ''. Every row counts, repeated ones too; rows that repeat an id and text are no
    copies of each other, and rows without an id are neither copies nor labelled. An id with several label rows
    has a label if one of them has it. An empty table gives no rows. Other columns are not read.
    """
    own = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    split = stage(own, {"_words": F.array_remove(F.split("text", BLANKS), "")})
    rows = materialize(split.select("doc_id", "part", failed_bits(text_conditions(F.col("_words"), F.col("text"))).alias("failed"),
                                    F.unhex(F.sha2("text", 256)).alias("digest")).groupBy("doc_id", "part", "failed", "digest").agg(F.count("*").alias("n")))
    marks = labels.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = later_copies(rows, "doc_id", "digest").join(marks, F.col("doc_id") == F.col("_doc"), "left")
    failed = F.col("failed") + F.when(F.col("_copy"), 16).otherwise(0)
    counts = marked.groupBy("part", failed.alias("failed")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    worths = coalitions(materialize(counts), 5, "part", ["n", "good", "toxic"])
    return steps(worths, "ABCDE", "part", "n", {"good": "good_lost", "toxic": "toxic_lost"})
