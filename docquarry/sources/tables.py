"""Tables: namespaces, schemas, creation, existence, previews and writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

RAW_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])
CHUNK_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
EVALSET_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
])
CLEAN_EVALSET_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("expected_answer", T.StringType()),
    T.StructField("predicted_answer", T.StringType()),
])


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def use_namespace(spark: SparkSession, database: str, catalog: str | None = None) -> None:
    """Select the catalog, create the database if it is missing and make it current."""
    if catalog is not None:
        spark.catalog.setCurrentCatalog(catalog)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.catalog.setCurrentDatabase(database)


def catalog_exists(spark: SparkSession, name: str) -> bool:
    return any(c.name == name for c in spark.catalog.listCatalogs())


def create_table(spark: SparkSession, name: str, schema: T.StructType, properties: Mapping[str, str] | None = None,
                 provider: str = "parquet") -> None:
    """Create the table unless it is there; an existing one is left as it is."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    props = ", ".join(f"'{k}' = '{v}'" for k, v in (properties or {}).items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({columns}) USING {provider}"
              + (f" TBLPROPERTIES ({props})" if props else ""))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")


def drop_database(spark: SparkSession, name: str) -> None:
    """Drop a database with all its tables. Streams that fed it need a new checkpoint folder."""
    spark.sql(f"DROP DATABASE IF EXISTS {_quoted(name)} CASCADE")


def preview(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First rows in key order, so that a preview is repeatable."""
    return df.orderBy(*order).limit(n)


def append_table(df: DataFrame, name: str) -> None:
    df.write.mode("append").saveAsTable(name)


def overwrite_table(df: DataFrame, name: str) -> None:
    """Replace rows and schema."""
    df.write.mode("overwrite").saveAsTable(name)


def merge_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` that it lacks, as NULL; its own extra columns stay."""
    empty = df.sparkSession.createDataFrame([], schema)
    return empty.unionByName(df, allowMissingColumns=True)
