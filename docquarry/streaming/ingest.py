"""Files to raw table to chunk table, each step drained once per run and tracked by a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from docquarry.config import EVALSET_CHUNK_OVERLAP, EVALSET_CHUNK_SIZE, RunConfig
from docquarry.functions.models import ModelFn
from docquarry.functions.text import merge_sections
from docquarry.operators.chunking import sentence_chunker
from docquarry.operators.evalset import build_eval_set
from docquarry.operators.numbering import hashed_key
from docquarry.plans.answering import embed_text
from docquarry.sources.tables import RAW_SCHEMA

TextFn = Callable[[Column], Column]


def decoded_text(content: Column) -> Column:
    """Text files as UTF-8, cleaned section by section; NULL for bytes that are none. Other formats bring
    their own parser."""
    return merge_sections(F.try_validate_utf8(content.cast("string")))


def unreadable(raw: DataFrame, text_fn: TextFn = decoded_text) -> DataFrame:
    """``(url, length)`` of files of which no text can be read: the quarantine beside :func:`chunk_stream`."""
    return raw.where(text_fn(F.col("content")).isNull()).select(F.col("path").alias("url"), "length")


def _chunking(split_long: bool, length_fn: Callable | None) -> dict:
    return {"split_long": split_long} | ({} if length_fn is None else {"length_fn": length_fn})


def ingest_files(spark: SparkSession, folder: str, glob: str = "*.pdf", files_per_batch: int | None = None) -> DataFrame:
    """Stream of new files that match a glob."""
    reader = spark.readStream.format("binaryFile").schema(RAW_SCHEMA).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def stream_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.readStream.table(table)


def stream_parquet(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet") -> DataFrame:
    """Stream of the rows of new parquet files that match a glob."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def drain_to_path(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """As :func:`drain_to_table`, into parquet files."""
    query = (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
             .outputMode("append").format("parquet").start(path))
    query.awaitTermination()
    return query


def drain_to_table(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append all available input to a table and wait for the end; nothing is taken twice."""
    query = (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
             .outputMode("append").toTable(table))
    query.awaitTermination()
    return query


def chunk_stream(raw: DataFrame, config: RunConfig = RunConfig(), text_fn: TextFn = decoded_text,
                 embed_fn: ModelFn | None = None, split_long: bool = False, length_fn: Callable | None = None) -> DataFrame:
    """Raw rows -> ``(id, url, content, embedding)``. The id is a hash of file and position, so a
    replayed batch gets the same ids. Files without a text (see :func:`unreadable`) give no chunks."""
    chunk = sentence_chunker(config.size, config.overlap, **_chunking(split_long, length_fn))
    return (
        raw.select(F.col("path").alias("url"), text_fn(F.col("content")).alias("_text"))
        .select("url", F.posexplode(chunk(F.col("_text"))).alias("chunk_no", "content"))
        .select(hashed_key("url", "chunk_no").alias("id"), "url", "content",
                embed_text("content", embed_fn, config.dim).alias("embedding"))
    )


def evalset_stream(raw: DataFrame, text_fn: TextFn = decoded_text, question_fn: ModelFn | None = None,
                   answer_fn: ModelFn | None = None, max_rows: int | None = None, threads: int = 1, guarded: bool = False,
                   split_long: bool = False, length_fn: Callable | None = None) -> DataFrame:
    """Raw rows -> ``(id, url, content, question, answer)`` from larger chunks, with ``error`` if guarded.

    ``max_rows`` stops after that many rows, for a first look at what a model writes.
    """
    chunk = sentence_chunker(EVALSET_CHUNK_SIZE, EVALSET_CHUNK_OVERLAP, **_chunking(split_long, length_fn))
    chunks = (
        raw.select(F.col("path").alias("url"), text_fn(F.col("content")).alias("_text"))
        .select("url", F.posexplode(chunk(F.col("_text"))).alias("chunk_no", "content"))
        .select(hashed_key("url", "chunk_no").alias("id"), "url", "content")
    )
    if max_rows is not None:
        chunks = chunks.limit(max_rows)
    return build_eval_set(chunks, "content", question_fn, answer_fn, threads, guarded)
