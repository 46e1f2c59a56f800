"""Files: evaluation sets as CSV and folders of documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EVALSET_CSV_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("expected_answer", T.StringType()),
    T.StructField("context", T.StringType()),
])


def load_eval_set(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Evaluation set from CSV with a header; quoted fields may span lines.

    Such a file is read by one task. Where no field spans lines, ``multi_line=False`` lets it be split. Without
    a schema the types are inferred, which reads the file twice; ``id`` is always BIGINT.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return df.withColumn("id", F.col("id").cast("bigint")) if "id" in df.columns else df


def load_eval_set_without_id(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    return load_eval_set(spark, path, schema, multi_line).drop("id")


def folder_is_empty(spark: SparkSession, path: str) -> bool:
    """True for a folder without files and for one that does not exist. Contents are not read."""
    try:
        return spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException as failure:
        if failure.getCondition() == "PATH_NOT_FOUND":
            return True
        raise
