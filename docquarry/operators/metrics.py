"""Answer metrics per row, their long form and their summaries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docquarry.functions import text as tx
from docquarry.functions.models import ModelFn, _rows, containment, five_point, overlap_count, overlap_f1

# Word lists of the stand-in scorers, to be replaced by a model or a longer list.
INFORMAL_WORDS = ("btw", "dunno", "gimme", "gotta", "haha", "meh", "nope", "oops", "pls", "stuff", "thx", "yep", "yup")
# Informal marks per hundred words up to which an answer gets 5, 4, 3 and 2 points; 1 beyond.
MARK_BOUNDS = (0, 2, 5, 10)
TOXIC_WORDS = ("awful", "dumb", "hate", "idiot", "moron", "pathetic", "stupid", "trash", "ugly", "worthless")


def exact_match(prediction: Column | str, target: Column | str) -> Column:
    return tx._col(prediction).eqNullSafe(tx._col(target)).cast("int")


def toxicity(text: Column | str, lexicon: Sequence[str] = TOXIC_WORDS) -> Column:
    """Share of a text's distinct words that are in the lexicon, in [0, 1]."""
    listed = F.array(*[F.lit(w) for w in lexicon])
    return F.round(containment(tx.keywords(text), listed), 6)


def readability(df: DataFrame, text: str) -> DataFrame:
    """Add counts and two grade levels; a text without words has NULL grades."""
    counted = df.withColumns({
        "n_words": tx.token_count(text),
        "n_sentences": F.size(tx.sentences(text)),
        "n_syllables": tx.syllable_count(text),
        "n_letters": tx.letter_count(text),
    })
    return counted.withColumns({
        "flesch_kincaid": F.round(
            tx.flesch_kincaid(F.col("n_words"), F.col("n_sentences"), F.col("n_syllables")), 6),
        "ari": F.round(
            tx.automated_readability(F.col("n_letters"), F.col("n_words"), F.col("n_sentences")), 6),
    })


def judge_with(judge_fn: ModelFn):
    """Pandas UDF prompt -> ``struct<score, justification>``; the model returns (score, reason) pairs."""

    @F.pandas_udf("score int, justification string")
    def judge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            verdicts = list(judge_fn(_rows(columns)))
            yield pd.DataFrame({
                "score": pd.array([None if v is None else v[0] for v in verdicts], dtype="Int32"),
                "justification": pd.Series([None if v is None else v[1] for v in verdicts], dtype=object),
            })

    return judge


def correctness_score(answer: Column | str, target: Column | str) -> Column:
    return five_point(overlap_f1(tx.keywords(answer), tx.keywords(target)))


def relevance_score(answer: Column | str, question: Column | str) -> Column:
    return five_point(containment(tx.keywords(question), tx.keywords(answer)))


def faithfulness_score(answer: Column | str, context: Column | str) -> Column:
    return five_point(containment(tx.keywords(answer), tx.keywords(context)))


def informality_score(text: Column | str, listed: Sequence[str] = INFORMAL_WORDS, bounds: Sequence[int] = MARK_BOUNDS) -> Column:
    """5 to 1 points by the informal marks in a hundred words: contractions, exclamation marks, listed words."""
    c = tx._col(text)
    marks = (
        F.regexp_count(c, F.lit(r"\p{L}['’]\p{L}"))
        + F.regexp_count(c, F.lit("!"))
        + overlap_count(tx.keywords(c), F.array(*[F.lit(w) for w in listed]))
    )
    words = tx.token_count(c)
    score = F.lit(len(bounds) + 1)
    for bound in bounds:
        score = score - (100 * marks > bound * words).cast("int")
    return score


@dataclass(frozen=True)
class RubricMetric:
    """A judged metric defined by a rubric; without a judge the rule scores the answer."""

    name: str
    definition: str
    rubric: Mapping[int, str]
    rule: object
    judge_fn: ModelFn | None = None
    examples: Sequence[str] = ()
    template: str = field(default=(
        "Rate the answer from 1 to 5 for {name}: {definition}\n{rubric}\n{examples}\nQuestion: {question}\nAnswer: {answer}"))

    def score(self, question: str, answer: str) -> Column:
        """``struct<score, justification>`` of one row."""
        if self.judge_fn is None:
            return F.struct(self.rule(answer).alias("score"), F.lit("rule based").alias("justification"))
        prompt = tx.render_prompt(self.template, {
            "name": F.lit(self.name),
            "definition": F.lit(self.definition),
            "rubric": F.lit("\n".join(f"Score {s}: {t}" for s, t in sorted(self.rubric.items()))),
            "examples": F.lit("\n".join(self.examples)),
            "question": question,
            "answer": answer,
        })
        return judge_with(self.judge_fn)(prompt)


def informality(definition: str, rubric: Mapping[int, str], judge_fn: ModelFn | None = None, listed: Sequence[str] = INFORMAL_WORDS,
                bounds: Sequence[int] = MARK_BOUNDS) -> RubricMetric:
    """The metric ``professionalism`` with the caller's definition and rubric; the rule counts informal marks."""
    return RubricMetric("professionalism", definition, rubric, lambda text: informality_score(text, listed, bounds), judge_fn)


@dataclass(frozen=True)
class Judges:
    """Functions that take the place of rules in the answer metrics; ``None`` leaves the rule.

    ``toxicity`` gets answers and returns numbers in [0, 1]; the others get prompts made from the templates
    and return (score, reason) pairs. ``rubrics`` are more metrics, each under its own name.
    """

    toxicity: ModelFn | None = None
    correctness: ModelFn | None = None
    relevance: ModelFn | None = None
    faithfulness: ModelFn | None = None
    rubrics: Sequence[RubricMetric] = ()
    correctness_template: str = "Score 1 to 5 how well the answer agrees with the target.\nTarget: {target}\nAnswer: {answer}"
    relevance_template: str = "Score 1 to 5 how well the answer fits the question.\nQuestion: {question}\nAnswer: {answer}"
    faithfulness_template: str = "Score 1 to 5 how far the passages support the answer.\nPassages: {context}\nAnswer: {answer}"

    def judged(self, fn: ModelFn | None, template: str, slots: Sequence[str], rule: Column) -> Column:
        return rule if fn is None else judge_with(fn)(tx.render_prompt(template, {s: s for s in slots}))["score"]


def score_with(score_fn: ModelFn):
    """Pandas UDF text -> number."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else float(v) for v in score_fn(list(texts))], dtype="float64")

    return score


def answer_metrics(rows: DataFrame, judges: Judges = Judges()) -> DataFrame:
    """Add one column per metric to ``(question, answer, context, target)`` rows."""
    j = judges
    scored = readability(rows, "answer").withColumns({
        "exact_match": exact_match("answer", "target"),
        "token_count": F.col("n_words"),
        "toxicity": toxicity("answer") if j.toxicity is None else score_with(j.toxicity)("answer"),
        "answer_correctness": j.judged(
            j.correctness, j.correctness_template, ("target", "answer"), correctness_score("answer", "target")),
        "answer_relevance": j.judged(
            j.relevance, j.relevance_template, ("question", "answer"), relevance_score("answer", "question")),
        "faithfulness": j.judged(
            j.faithfulness, j.faithfulness_template, ("context", "answer"), faithfulness_score("answer", "context")),
        "professionalism": informality_score("answer"),
    })
    rubrics = {m.name: m.score("question", "answer")["score"] for m in j.rubrics}
    return scored.withColumns(rubrics).drop("n_words", "n_sentences", "n_syllables", "n_letters") if rubrics else scored.drop(
        "n_words", "n_sentences", "n_syllables", "n_letters")


ANSWER_METRICS = ("exact_match", "token_count", "toxicity", "flesch_kincaid", "ari", "answer_correctness",
                  "answer_relevance", "faithfulness", "professionalism")


def to_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``(*keys, metric, score)`` from one pass over the wide rows."""
    pairs = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in metrics])
    return wide.select(*keys, F.explode(pairs).alias("_m")).select(*keys, "_m.metric", "_m.score")


def eval_summary(long: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Count, mean, population variance and 90th percentile per metric, from one pass over the rows.

    Equal scores, rounded to six digits, are counted first. What reaches a metric's task is therefore
    its distinct scores, not its rows, although a percentile needs all values.
    """
    by = [*group, "metric"]
    counted = long.where("score is not null").groupBy(*by, F.round("score", 6).alias("score")).agg(
        F.count(F.lit(1)).alias("freq"))
    score, freq = F.col("score"), F.col("freq")
    n, total, squares = F.sum(freq), F.sum(score * freq), F.sum(score * score * freq)
    return counted.groupBy(*by).agg(
        n.alias("n"),
        F.round(total / n, 6).alias("mean"),
        F.round(F.greatest(squares / n - (total / n) * (total / n), F.lit(0.0)), 6).alias("variance"),
        F.round(F.percentile("score", 0.9, freq), 6).alias("p90"),
    )


def eval_table(long: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per example, one column per metric, for tables that arrive long. Wide rows need no pivot."""
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("score"))


def score_distribution(df: DataFrame, score: str) -> DataFrame:
    return df.groupBy(score).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), score)


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Counts in buckets ``[lower, lower + width)``."""
    lower = F.floor(F.col("_v") / width) * width
    # Staged, so that a costly value is not computed once for the filter and once for the bucket.
    return tx.stage(df, {"_v": F.col(value)}).where("_v is not null").groupBy(lower.alias("lower")).agg(F.count(F.lit(1)).alias("n"))


def toxicity_vs_correctness(df: DataFrame, toxic: str, correct: str) -> DataFrame:
    """Scatter columns: toxicity in percent beside the correctness score."""
    return df.select((F.col(toxic) * 100).alias("toxicity"), F.col(correct).alias("correctness"))


def cross_tab(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.groupBy(first, second).agg(F.count(F.lit(1)).alias("n"))
