"""Every operator on awkward and on empty tables; each result is the one its docstring defines."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from awkward import CLASHING, DOCS, LONG, documents, no_documents
from docquarry.llm import decontaminate, html_suffix, langid, line_dedup, near_dup, packing, quality, sharding, vptree, warc
from docquarry.llm.queries import tokenizer_path
from docquarry.session import shared_path

ITEMS = "item_id long, text string, window string, _words string"


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_sharding(spark):
    out = sharding.sharded(documents(spark), sharding.Tree.even(6)).collect()
    assert len(out) == len(DOCS)
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == sorted(
        (d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in DOCS)
    for shard in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    assert sharding.sharded(no_documents(spark), sharding.Tree.even(6)).count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "the same text AGAIN", "w", "x"), (2, None, "w", "x"), (3, "!!", "w", "x"), (None, "solo", "w", "x"),
                                   (1, "the same text AGAIN", "w", "x")], ITEMS)
    out = by_id(decontaminate.contamination(documents(spark), items), "n_words", "n_hit", "n_items", "contaminated", "items_sha256")
    empty = hashlib.sha256(b"").hexdigest()
    assert out[11] == out[12] == (7, 4, 1, True, hashlib.sha256(b"1").hexdigest())
    assert out[10] == (1, 1, 1, True, empty)
    assert out[3] == out[4] == out[5] == (0, 0, 0, False, empty)
    assert out[6][:2] == (30_000, 0)
    assert decontaminate.contamination(documents(spark), items).count() == len(DOCS)
    assert decontaminate.contamination(no_documents(spark), items).count() == 0
    assert decontaminate.contamination(documents(spark), items.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.clean(documents(spark), items)
    assert kept.columns == documents(spark).columns and kept.count() == len(DOCS) - 4


def test_near_duplicates(spark):
    out = by_id(near_dup.near_duplicates(documents(spark)), "n_shingles", "component_id", "kept")
    assert out[7] == (29_996, 6, False) and out[6][1:] == (6, True)
    assert out[12] == (3, 11, False)
    assert out[3] == (0, 3, True) and out[4] == (0, 4, True) and out[5] == (0, 5, True)
    assert out[None] == (26, None, True)
    assert near_dup.near_duplicates(documents(spark)).count() == len(DOCS)
    assert near_dup.near_duplicates(no_documents(spark)).count() == 0


def test_line_dedup(spark):
    out = line_dedup.without_repeats(documents(spark))
    got = by_id(out, "text", "n_deleted")
    assert got[2] == ("own line of two", 1) and got[1][1] == 0
    assert got[7] == ("", 1) and got[6][1] == 0
    assert got[3] == (None, 0) and got[5] == (" \n ", 0)
    assert got[None][1] == 0 and got[12][1] == 0
    assert out.count() == len(DOCS) and set(CLASHING) <= set(out.columns)
    assert line_dedup.without_repeats(no_documents(spark)).count() == 0


def test_language(spark):
    docs = documents(spark)
    out = by_id(langid.classified(docs, langid.learn(docs)), "lang_pred", "score", "rejected")
    assert out[3] == out[4] == out[5] == out[8] == ("und", 0.0, True)
    assert out[6][0] == "fr" and out[1][0] == "en" and 0 < out[6][1] <= 1
    nothing = langid.learn(no_documents(spark))
    assert langid.classified(docs, nothing).where("lang_pred <> 'und'").count() == 0
    assert langid.classified(no_documents(spark), nothing).count() == 0


def test_quality(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, 1, 0), (99, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.scored(docs, quality.learn(docs, labels)).collect()
    assert len(out) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    blank = quality.learn(docs, labels.limit(0))
    assert {r["score"] for r in quality.scored(docs, blank).collect()} == {0.5}
    assert quality.scored(no_documents(spark), blank).count() == 0


def test_packing(spark):
    out = packing.pack(documents(spark), tokenizer_path(), 64, with_ids=True)
    rows = out.collect()
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0) and r["length"] == len(r["ids"]) <= 64
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert {r["doc_id"] for r in rows} == {d for d, _, _ in DOCS}
    assert [r["ids"] for r in rows if r["doc_id"] == 3] == [[0]] and max(fill.values()) <= 64
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(out).collect()}
    assert {s: len(ids) for s, ids in joined.items()} == fill
    assert packing.pack(no_documents(spark), tokenizer_path()).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/x y", "h" * 150, "k"), (2, None, "h" * 150, "k"), (3, "http://a/\r\nb", None, "k"), (4, "u", "", "k"), (5, "u", "short", "k"),
            (6, "u", "short", "k"), (None, "u", "h" * 150, "k"), (7, "u", "WARC/1.1\r\n\r\n" * 20, "k"), (8, "u", "é" * 70_000, "k"), (1, "u", "h" * 150, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    out = sorted((str(r["key"]), r["type"], r["refers_to"] or "", r["payload_bytes"], r["payload_digest"]) for r in warc.round_trip(pages).collect())

    def row(key, kind, refers, payload):
        return str(key), kind, refers, len(payload.encode()), hashlib.sha256(payload.encode()).hexdigest()

    assert out == sorted([
        row(1, "response", "", "h" * 150), row(1, "response", "", "h" * 150), row(2, "revisit", "1", "h" * 150), row(3, "response", "", ""),
        row(4, "response", "", ""), row(5, "response", "", "short"), row(6, "response", "", "short"), row(None, "revisit", "1", "h" * 150),
        row(7, "response", "", rows[7][2]), row(8, "response", "", rows[8][2])])
    assert warc.round_trip(pages.limit(0)).count() == 0
    read = warc.read_archives(warc.write_archives(pages, shared_path(spark)))
    assert {r["url"] for r in read.collect()} == {r[1] for r in rows}


def test_warc_of_very_long_urls(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a/" + "é" * 400_000, "one"), (2, "u", "two")], "page_id long, url string, html string")
    assert sorted((r["key"], r["url"]) for r in warc.round_trip(pages).collect()) == [("1", "http://a/" + "é" * 400_000), ("2", "u")]
    gap = spark.createDataFrame([("p", 0, "record end")], "path string, offset long, gap string")
    monkeypatch.setattr(warc, "read_archives", lambda *a, **b: gap)
    with pytest.raises(ValueError, match="record end"):
        warc.round_trip(pages)


def test_neighbours(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], "c"), (2, [1.0, 0.0], "c"), (3, [0.0, 0.0], "c"), (4, None, "c"), (5, [inf, 1.0], "c"), (6, [nan, 1.0], "c"), (7, [None, 1.0], "c"),
            (8, [], "c"), (9, [2.0, 0.5], "c"), (None, [1.0, 1.0], "c"), (1, [1.0, 0.0], "c"), (10, [1.0, 2.0, 3.0], "c")]
    own = vptree.usable(spark.createDataFrame(rows, "vec_id long, e array<float>, score string"), "vec_id", "e")
    out = sorted(tuple(r) for r in vptree.nearest(own, own, vptree.Search(k=5)).collect())
    assert out == [(1, 1, 9, 2.0), (1, 2, 2, 1.0), (2, 1, 9, 2.0), (2, 2, 1, 1.0), (9, 1, 1, 2.0), (9, 2, 2, 2.0)]
    assert vptree.nearest(own.limit(0), own).count() == 0 and vptree.nearest(own, own.limit(0)).count() == 0


def test_html(spark):
    page = "<html><body><nav>menu</nav><article><h1>T &amp; t</h1><p>a  b<br>c<p>d</article><footer>f</footer></body></html>"
    rows = [(1, "http://h/1", page, "c"), (2, None, None, "c"), (3, "http://h/1", "", "c"), (4, "http://h/2", "plain &lt;text", "c"), (5, "x", "<", "c"),
            (6, "http://h/3", "<p>" + LONG, "c"), (1, "http://h/1", page, "c"), (None, "http://h/9", "<script>x</script><div>y", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("key", F.lit("clash"))
    out = {r["page_id"]: r["text"] for r in html_suffix.extracted(pages).collect()}
    assert out == {1: "T & t\na b c\nd", 2: "", 3: "", 4: "plain <text", 5: "<", 6: LONG, None: "y"}
    assert html_suffix.extracted(pages).count() == len(rows) and html_suffix.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("make", [documents, no_documents])
def test_pipeline_stages(spark, make, tmp_path):
    spark.createDataFrame([(1, "own line of one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes), name
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not ids & {1, 3, 7, 12} and (make is no_documents or {2, 6, 11} <= ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == ids
