from pyspark.sql import functions as F

from docquarry.operators import numbering


def test_dense_numbers_in_key_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("key"), F.lit("x").alias("v")).repartition(5)
    rows = numbering.with_row_number(df, ["key"], "n").orderBy("n").collect()
    assert [(r.n, r.key) for r in rows] == [(i + 1, i) for i in range(1000)]


def test_numbers_when_a_third_of_the_keys_are_equal(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("key"), "id")
    rows = numbering.with_row_number(df, ["key", "id"], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 901))
    assert [(r.key, r.id) for r in rows] == sorted((r.key, r.id) for r in rows)


def test_numbers_of_an_empty_table(spark):
    assert numbering.with_row_number(spark.range(0), ["id"], "n").count() == 0


def test_pages_do_not_overlap(spark):
    rows = numbering.page_rows(spark.range(23).repartition(4), ["id"], 5).collect()
    assert sorted((r.page, r.row_in_page, r.id) for r in rows) == [(i // 5, i % 5, i) for i in range(23)]


def test_no_single_task_window_over_the_data(spark):
    plan = numbering.with_row_number(spark.range(100), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window ["):]
    assert "Aggregate [_part" in window


def test_hash_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(5000)
    one = {r.id for r in numbering.hash_sample(df, "id", 0.2, seed=1).collect()}
    other = {r.id for r in numbering.hash_sample(df.repartition(9), "id", 0.2, seed=1).collect()}
    assert one == other and 800 < len(one) < 1200
    assert one != {r.id for r in numbering.hash_sample(df, "id", 0.2, seed=2).collect()}
    assert numbering.hash_sample(df, "id", 1.0).count() == 5000


def test_seeded_sample_repeats(spark):
    df = spark.range(0, 5000, 1, 4)
    one = {r.id for r in numbering.seeded_sample(df, 0.005, 40).collect()}
    assert one == {r.id for r in numbering.seeded_sample(df, 0.005, 40).collect()}
    assert len(one) < 100


def test_hashed_key_is_stable(spark):
    df = spark.createDataFrame([("u", 1), ("u", 2), ("w", 1)], "url string, n int")
    keys = [r[0] for r in df.select(numbering.hashed_key("url", "n")).collect()]
    assert len(set(keys)) == 3
    assert keys == [r[0] for r in df.select(numbering.hashed_key("url", "n")).collect()]
