"""A corpus pipeline of five stages over ``documents``.

Each stage gets the documents that the one before it kept, as a written table, and returns documents with
the same columns; the last returns the packed pieces. Documents that share an id but not a text are
told apart by their text where a stage removes rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquarry.llm import decontaminate, langid, line_dedup, near_dup, packing
from docquarry.llm.common import table
from docquarry.llm.queries import tokenizer_path
from docquarry.session import ensure_parallelism, materialize, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns beside the whole row, whose other columns then clash with none of an operator's."""
    return docs.select(F.struct(*docs.columns).alias("_row"), *columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or with a narrow margin go.

    The dictionaries are learned from the documents that carry a language.
    """
    ship_package(spark)
    model = langid.learn(docs)
    found = langid.classified(_boxed(ensure_parallelism(docs), "text"), model)
    return found.where(~F.col("rejected")).select("_row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without blocks of lines that an earlier one has; one of which nothing is left goes."""
    ship_package(spark)
    cut = line_dedup.without_repeats(_boxed(ensure_parallelism(docs), "doc_id", "text"))
    left = cut.where((F.col("n_deleted") == 0) | F.col("text").rlike(r"\S"))
    length = F.when(F.col("n_deleted") == 0, F.col("_row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    own = {"text": F.col("text"), "n_chars": length}
    return left.select(*[own.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates over 5-word shingles, the one with the smallest id.

    Rows that are repeated whole are one document. Documents without an id or without words stay.
    """
    ship_package(spark)
    found = materialize(near_dup.near_duplicates(ensure_parallelism(docs), near_dup.NearDup(words=5)).where("kept"))
    kept = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    repeated = materialize(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    several = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(several).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    ship_package(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    ship_package(spark)
    return packing.pack(ensure_parallelism(docs.select("doc_id", "text")), tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: Compression, MinHash and the tokenizer cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each one returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
