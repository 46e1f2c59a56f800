"""Benchmark decontamination as a prefix-filtered set join.

Every item is cut into windows of consecutive words. For a window to be contained in a document all
of its words have to be, so with the words ordered by rarity in the corpus a prefix of one word, the
rarest, has to be. Documents are joined with the windows on that word only. Its place in the window
then fixes where the window would start, which gives the length and position bounds, and the words
from there on are compared with the window one by one.

Only built-in functions are used. Words of the corpus are counted over all documents.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from docquarry.functions.text import stage
from docquarry.llm.common import fits, lookup_join, same_keys
from docquarry.session import materialize

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands after the last word of a document; it is no word, so it meets only its own row below.
END = ""


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all other letters as they are."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def words(text: Column) -> Column:
    """Lower-cased words in order; NULL has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(items: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """``window`` (words joined by blanks), ``n`` and ``item`` of each window of each item.

    An item of fewer words is one window; one without words has none. A NULL item counts as ''.
    """
    known = stage(items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("_text")),
                  {"_words": words(F.col("_text"))}).where(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - (size - 1), F.lit(1)))
    cut = known.select("item", "_words", F.explode(starts).alias("_at"))
    window = F.slice("_words", F.col("_at"), size)
    return cut.select(F.array_join(window, " ").alias("window"), F.size(window).alias("n"), "item").distinct()


def _rarest(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """``token`` and ``offset`` of the word of each window that is rarest in ``docs``.

    Words of documents are counted where they are met, before any shuffle, whether the vocabulary is sent or not.
    """
    placed = windows.select("window", "n", F.posexplode(F.split("window", " ")).alias("offset", "token"))
    vocabulary = materialize(placed.select("token").distinct())
    met = docs.select(F.explode_outer("_words").alias("token"))
    if fits(vocabulary, F.octet_length("token") + 16):
        counted = met.join(F.broadcast(vocabulary), "token").groupBy("token").count()
    else:
        counted = met.groupBy("token").count().join(vocabulary, "token")
    rank = F.struct(F.coalesce("count", F.lit(0)), "token", "offset")
    first = placed.join(counted, "token", "left").groupBy("window", "n").agg(F.min(rank).alias("_first"))
    return first.select("window", "n", "_first.token", "_first.offset")


def occurrences(docs: DataFrame, windows: DataFrame, doc: str, text: str) -> DataFrame:
    """Where windows occur: ``doc_id``, ``_hash`` (of the text), ``window``, ``start``, ``n``.

    For every row of ``docs`` there is one more row, whose ``window`` is empty and whose ``start``
    is the number of words. While the windows can be sent to the executors, it comes from the same pass.
    Beyond that only positions of words are shuffled, and the words of a document once.
    """
    split = stage(docs.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")),
                  {"_words": words(F.col("_text"))}).drop("_text")
    tokens = materialize(_rarest(windows, split).select("token", "offset", "n", "window"))
    width = 2 * F.octet_length("window") + 128
    start = F.col("_at") - F.col("offset")
    within = (start >= 0) & (start + F.col("n") <= F.col("_size"))
    if not fits(tokens, width):
        return _shuffled(split, tokens, start, within, width)
    end = docs.sparkSession.range(1).select(
        F.lit(END).alias("token"), F.lit(0).alias("offset"), F.lit(0).alias("n"), F.lit("").alias("window"),
        F.array().cast("array<string>").alias("_window"))
    sent = tokens.withColumn("_window", F.split("window", " ")).unionByName(end)
    placed = split.select("doc_id", "_hash", "_words", F.size("_words").alias("_size"),
                          F.posexplode_outer(F.concat("_words", F.array(F.lit(END)))).alias("_at", "token"))
    found = placed.join(F.broadcast(sent), "token").where(
        F.when(within, F.slice("_words", start + 1, F.col("n")) == F.col("_window")).otherwise(F.lit(False)))
    return found.select("doc_id", "_hash", "window", start.alias("start"), "n")


def _shuffled(split: DataFrame, tokens: DataFrame, start: Column, within: Column, width: Column) -> DataFrame:
    """The same rows for a table of windows too large to send.

    Places of words meet the windows of their word, spread over salts; those that fit by length and position are
    verified after a join with the words of their document, which repeated rows have once.
    """
    keys = ["doc_id", "_hash"]
    placed = split.select(*keys, F.size("_words").alias("_size"), F.posexplode("_words").alias("_at", "token"))
    fitting = lookup_join(placed, tokens, "token", width).where(within).select(
        *keys, "window", start.alias("start"), "n").distinct()
    texts = split.groupBy(*keys).agg(F.any_value("_words").alias("_words"))
    sure = fitting.join(texts, same_keys(fitting, texts, keys)).where(
        F.slice("_words", F.col("start") + 1, F.col("n")) == F.split("window", " "))
    ends = split.select(*keys, F.lit("").alias("window"), F.size("_words").alias("start"), F.lit(0).alias("n"))
    return sure.select(*[fitting[k] for k in keys], "window", "start", "n").unionByName(ends)


def _covered(spans: Column) -> Column:
    """Number of positions that sorted (start, n) spans cover."""
    def add(seen: Column, span: Column) -> Column:
        stop = span["start"] + span["n"]
        fresh = F.greatest(stop - F.greatest(span["start"], seen["stop"]), F.lit(0))
        return F.struct(F.greatest(seen["stop"], stop).alias("stop"), (seen["total"] + fresh).alias("total"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("stop"), F.lit(0).alias("total")), add, lambda seen: seen["total"])


def contamination(docs: DataFrame, items: DataFrame, *, size: int = WINDOW, doc: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit`` (words inside any occurring
    window), ``n_items``, ``items_sha256`` and ``contaminated``.

    A NULL or empty text has no words and no hits. Repeated rows are reported as often as they
    occur; rows that share an id but not a text are judged each on its own. Without items nothing is
    hit. Columns other than those named are not read.
    """
    own = materialize(item_windows(items, item, item_text, size))
    found = materialize(occurrences(docs, own.select("window", "n").distinct(), doc, text))
    keys = ["doc_id", "_hash"]
    rows = found.where("window = ''").select(*keys, F.col("start").cast("long").alias("n_words"))
    hits = found.where("window <> ''")
    longest = hits.groupBy(*keys, "start").agg(F.max("n").alias("n"))
    spans = longest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("_spans"))
    words_hit = spans.select(*keys, _covered(F.col("_spans")).cast("long").alias("n_hit"))
    width = F.octet_length("window") + F.octet_length("item") + 32
    met = lookup_join(hits.select(*keys, "window").distinct(), own.select("window", "item"), "window", width).select(*keys, "item").distinct()
    listed = met.groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("_items"))
    items_hit = listed.select(*keys, F.size("_items").cast("long").alias("n_items"), F.array_join("_items", ",").alias("_joined"))
    both = words_hit.join(items_hit, same_keys(words_hit, items_hit, keys)).select(
        *[words_hit[k] for k in keys], "n_hit", "n_items", "_joined")
    return rows.join(both, same_keys(rows, both, keys), "left").select(
        rows["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("_joined", F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        rows["_hash"])


def clean(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """Rows of ``docs`` in which no window of an item occurs, unchanged."""
    doc, text = names.get("doc", "doc_id"), names.get("text", "text")
    bad = contamination(docs, items, **names).where("contaminated").select(
        F.col("doc_id").alias("_doc"), F.col("_hash").alias("_text_hash")).distinct()
    return docs.join(bad, docs[doc].eqNullSafe(bad["_doc"]) & (F.xxhash64(docs[text]) == bad["_text_hash"]), "left_anti")
