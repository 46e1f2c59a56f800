"""Documents and pages that trip operators: NULLs, nothing, very long, repeated, and columns with clashing names."""

from pyspark.sql import DataFrame, SparkSession, functions as F

LONG = " ".join(f"word{i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(30))
DOCS = [
    (1, f"{PASSAGE}\nown line of one", "en"), (2, f"own line of two\n{PASSAGE}", "en"), (3, None, "en"), (4, "", "en"), (5, " \n ", None),
    (6, LONG, "fr"), (7, LONG, "fr"), (8, "1234 !!", "en"), (9, "é", "fr"), (10, "Solo", None), (10, "Solo", None), (None, PASSAGE, "en"),
    (11, "the same text again and again here", "en"), (12, "the same text again and again here", "en"), (13, "x" * 200_000, "en"),
]
#: Names that operators use inside.
CLASHING = ["n", "k1", "node", "bucket", "words", "window", "token", "size", "shard", "slot", "score", "hash", "lines", "sequence_id", "length",
            "key", "host", "page", "path", "digest", "rejected", "n_lines", "_rank", "_bucket", "_words", "_key"]


def documents(spark: SparkSession, rows=DOCS) -> DataFrame:
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs.withColumns({name: F.lit("clash") for name in CLASHING} | {"source": F.lit("s"), "n_chars": F.length("text").cast("long")})


def no_documents(spark: SparkSession) -> DataFrame:
    return documents(spark, [])
