from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docquarry.operators import chunking

WORD = st.text(alphabet="abc", min_size=1, max_size=4)
SENTENCES = st.lists(st.lists(WORD, min_size=1, max_size=12).map(lambda ws: " ".join(ws) + "."), max_size=20)


def n_tokens(text):
    return len(text.split())


def fold(units, size, overlap):
    """The packing rule once more, step by step and without prefix sums."""
    chunks, current = [], []
    for unit in units:
        if current and sum(map(n_tokens, current)) + n_tokens(unit) > size:
            chunks.append(" ".join(current))
            while current and sum(map(n_tokens, current)) > overlap:
                current.pop(0)
        current.append(unit)
    return chunks + ([" ".join(current)] if current else [])


@settings(max_examples=200, deadline=None)
@given(SENTENCES, st.integers(2, 30), st.integers(0, 10))
def test_packing_matches_the_rule(units, size, overlap):
    assert chunking.pack_sentences(" ".join(units), size, overlap) == fold(units, size, overlap)


@settings(max_examples=200, deadline=None)
@given(SENTENCES, st.integers(5, 30), st.integers(0, 4))
def test_packing_properties(units, size, overlap):
    chunks = chunking.pack_sentences(" ".join(units), size, overlap)
    assert all(any(u in c for c in chunks) for u in units)
    longest = max(map(n_tokens, units), default=0)
    assert all(n_tokens(c) <= max(size, overlap + longest) for c in chunks)
    split = chunking.pack_sentences(" ".join(units), size, overlap, split_long=True)
    assert all(n_tokens(c) <= size + overlap for c in split)


def test_own_token_lengths():
    by_letters = chunking.pack_sentences("aa. bbb. c.", 6, 0, length_fn=lambda us: [len(u) for u in us])
    assert by_letters == ["aa.", "bbb. c."]


def test_sentence_chunks(spark):
    df = spark.createDataFrame([(1, "a b. c d. e"), (2, ""), (3, None), (4, "w " * 30 + ".")], "k int, t string")
    rows = chunking.chunk_sentences(df, "t", 4, 2, ["k"]).orderBy("k", "chunk_no").collect()
    assert [tuple(r) for r in rows[:2]] == [(1, 0, "a b. c d."), (1, 1, "c d. e")]
    assert [r.k for r in rows] == [1, 1, 4]


def test_token_windows(spark):
    text = " ".join(str(i) for i in range(10))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "x"), (4, None)], "k int, t string")
    rows = [tuple(r) for r in chunking.chunk_tokens(df, "t", 4, 1, ["k"]).orderBy("k", "chunk_no").collect()]
    assert rows == [(1, 0, "0 1 2 3"), (1, 1, "3 4 5 6"), (1, 2, "6 7 8 9"), (3, 0, "x")]


def test_sweep_counts_the_windows(spark):
    df = spark.createDataFrame([(1, "a " * 23), (2, "b"), (3, "")], "k int, t string")
    for row in chunking.chunk_sweep(df, "t", [(4, 1), (10, 3)]).collect():
        made = chunking.chunk_tokens(df, "t", row["size"], row["overlap"], ["k"])
        lengths = [r[0] for r in made.select(F.size(F.split("content", " "))).collect()]
        assert (row["n_chunks"], row["n_tokens"]) == (len(lengths), sum(lengths))


def test_windows_carry_keys_only_past_the_explode(spark):
    df = spark.createDataFrame([(1, "a b c", "unused")], "k int, t string, u string")
    plan = chunking.chunk_tokens(df, "t", 2, 1, ["k"])._jdf.queryExecution().executedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "u#" not in generate and generate.count("split(") == 0


def test_few_texts_of_a_batch_are_held_at_a_time(monkeypatch):
    import pyarrow as pa

    texts = [None if i % 7 == 0 else f"One {i}. Two {i}." for i in range(1000)]
    parts = list(chunking.sentence_chunker(2, 0).func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert max(len(p) for p in parts) <= 64
    assert [c for p in parts for c in p.to_pylist()] == [None if i % 7 == 0 else [f"One {i}.", f"Two {i}."] for i in range(1000)]
