"""Language margins: recoded with plain zstandard calls, and what calibrated margins reject."""

import random

import pytest
import zstandard as zs
from pyspark.sql import functions as F

from docquarry.llm import langid

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = docs.where((langid.fold("doc_id", 4) == 2) & (F.length("text") > 200) & F.col("lang").isNotNull())
    return docs.where(langid.fold("doc_id", 4) != 2), held


@pytest.fixture(scope="module")
def model(corpus):
    return langid.learn(corpus[0])


def share_rejected(spark, texts, model):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    return langid.classified(rows, model).agg(F.avg(F.col("rejected").cast("int"))).first()[0]


def test_margins_equal_plain_encodings(spark, corpus, model):
    texts = [r["text"] for r in corpus[1].select("text").orderBy(F.xxhash64("doc_id")).limit(60).collect()]
    got = {r["text"]: (r["lang_pred"], r["margin"]) for r in langid.classified(
        spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}

    def encoded(data, raw, level):
        shared = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
        return len(zs.ZstdCompressor(level=level, dict_data=shared, write_content_size=False, write_dict_id=False).compress(data))

    for text in texts:
        data = langid.plain(text)
        sizes = {name: encoded(data, raw, 6) for name, raw in model.dictionaries.items()}
        first, second = sorted(sizes.values())[:2]
        if second - first >= model.settings.close:
            assert got[text] == (min(sizes, key=sizes.get), second / first - 1.0)


def test_clear_texts_stay_and_mixed_and_unlearned_ones_go(spark, corpus, model):
    held = corpus[1].select("text", "lang")
    assert model.narrow > 0
    assert langid.classified(held, model).agg(F.avg(F.col("rejected").cast("int"))).first()[0] < 0.02
    by_lang = {}
    for row in held.orderBy(F.xxhash64("text")).limit(600).collect():
        by_lang.setdefault(row["lang"], []).append(row["text"])
    draw = random.Random(5)
    mixed = []
    for _ in range(200):
        one, other = (draw.choice(by_lang[name]) for name in draw.sample(sorted(by_lang), 2))
        half = min(len(one), len(other)) // 2
        mixed.append(one[:half] + " " + other[:half])
    assert share_rejected(spark, mixed, model) > 0.5
    for name in by_lang:
        without = langid.learn(corpus[0].where(F.col("lang") != name))
        assert share_rejected(spark, by_lang[name], without) > 0.8


def test_very_long_text_and_single_language(spark, model):
    long = "the house stands near the river and the road goes on to the town " * 20000
    rows = spark.createDataFrame([(long,), ("",), (None,)], "text string")
    got = {r["text"]: (r["lang_pred"], r["score"], r["rejected"]) for r in langid.classified(rows, model).collect()}
    assert got[long][0] == "en" and got[""] == got[None] == ("und", 0.0, True)
    alone = langid.Model({"en": model.dictionaries["en"]})
    assert {r["rejected"] for r in langid.classified(rows.limit(1), alone).collect()} == {False}
    with pytest.raises(ValueError):
        langid.learn(spark.createDataFrame([("a b", "x"), ("c d", "y")], "text string, lang string"), langid.Settings(languages=1))
