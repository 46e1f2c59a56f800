"""Registered queries of the training-data operators, each on its whole table."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquarry.llm import alignment, decontaminate, filter_audit, html_suffix, langid, line_dedup, near_dup, packing, quality, sharding, simhash, vptree, warc
from docquarry.llm.common import table
from docquarry.session import ensure_parallelism

SHARDS = 40
NEIGHBOUR_FACTOR = 1.0


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    found = warc.round_trip(table(spark, folder, "pages"))
    return found.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
                        F.col("refers_to").cast("long").alias("refers_to"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold."""
    docs = table(spark, folder, "documents")
    model = langid.learn(docs.where(langid.fold("doc_id", 4) != 2))
    own = ensure_parallelism(docs.select("doc_id", "text"))
    held_out = F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False))
    return langid.classified(own, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    own = vptree.usable(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return vptree.nearest(own.where(F.col("id") % 20 == 0), own, vptree.Search(k=20, factor=NEIGHBOUR_FACTOR))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in sequences of at most 2048 tokens."""
    return packing.pack(ensure_parallelism(table(spark, folder, "documents").select("doc_id", "text")), tokenizer_path())


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Documents over 40 even shards under the law ``key``."""
    placed = sharding.sharded(table(spark, folder, "documents"), sharding.Tree.even(SHARDS))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of benchmark windows in every document."""
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets overlap by 80 percent or more."""
    return near_dup.near_duplicates(
        ensure_parallelism(table(spark, folder, "documents").select("doc_id", "text")), near_dup.NearDup(words=2))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from labels outside the held-out fold."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, folder, "labels").where(langid.fold("doc_id", 5) != 0))
    held_out = F.coalesce(langid.fold("doc_id", 5) == 0, F.lit(False))
    return quality.scored(ensure_parallelism(docs), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier document has."""
    cut = line_dedup.without_repeats(ensure_parallelism(table(spark, folder, "documents").select("doc_id", "text")))
    return cut.select("doc_id", "text", "n_deleted")


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_suffix.extracted(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters does at every place of every order, per source."""
    return filter_audit.audit(ensure_parallelism(table(spark, folder, "documents").select("doc_id", "text", "source")), table(spark, folder, "labels"))


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose fingerprints differ in at most two bits."""
    return simhash.near_duplicates(ensure_parallelism(table(spark, folder, "documents").select("doc_id", "text")))


def tokenizer_pair() -> alignment.Tokenizers:
    import public_tokenizers as files

    return alignment.Tokenizers(files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"), files.PATTERN)


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document."""
    return alignment.aligned(ensure_parallelism(table(spark, folder, "documents").select("doc_id", "text")), tokenizer_pair())


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_neighbours": op3_neighbours,
    "op4_packing": op4_packing,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_html_text": op7_html_text,
    "op8_near_dup": op8_near_dup,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_simhash": op12_simhash,
    "op13_alignment": op13_alignment,
}
_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

LLM_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first < page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, w[i:i + 9] AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT len(g) AS n FROM windows),
        placed AS (
            SELECT doc_id, i, n, w[i:i + n - 1] AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
        met AS (SELECT DISTINCT doc_id, i, n, item_id FROM placed JOIN windows USING (g)),
        hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
        listed AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op8_near_dup": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i:i + 1]))
                                WHEN len(w) = 1 THEN [w] ELSE [] END AS s
            FROM d),
        single AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS common
            FROM single a JOIN single b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (m + n - common)),
        reach AS (
            SELECT DISTINCT a AS doc_id, a AS other FROM links
            UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
        FROM sets LEFT JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) USING (doc_id)""",
    "op11_filter_audit": r"""
        WITH f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
        orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        places AS (
            SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
            FROM (SELECT *, unnest(range(1, 6))::INT AS step FROM orders)),
        d AS (
            SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
                list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        judged AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
                + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
                + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS failed
            FROM d LEFT JOIN marks USING (doc_id)),
        counts AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
        each AS (
            SELECT *, failed & before = 0 AS there, failed & bit <> 0 AS fails FROM counts, places),
        steps AS (
            SELECT part, filter_order, step, bit, sum(n) FILTER (there AND NOT fails) AS kept, sum(n) FILTER (there AND fails) AS removed,
                sum(n) FILTER (fails AND NOT there) AS redundant, sum(n) FILTER (failed = bit) AS unique_fails,
                sum(good) FILTER (there AND fails) AS good_lost, sum(toxic) FILTER (there AND fails) AS toxic_lost
            FROM each GROUP BY ALL)
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
            coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
            coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
            sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley
        FROM steps""",
}
