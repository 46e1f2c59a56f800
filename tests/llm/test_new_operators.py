"""Filter audit, SimHash and tokenizer alignment against plain versions, and on awkward tables."""

from collections import Counter, defaultdict
import hashlib
from itertools import permutations
import random

import numpy as np
import pytest
import xxhash

from awkward import CLASHING, DOCS, documents, no_documents
from conftest import SF_SMALL
from docquarry.llm import alignment, filter_audit, simhash
from docquarry.llm.queries import LLM_QUERIES, tokenizer_pair
from pyspark.sql import functions as F


def table(spark, name):
    return spark.read.parquet(f"{SF_SMALL}/{name}.parquet")


# Filter audit


def _plain_audit(rows, labels):
    """Every order applied document by document."""
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    marks = defaultdict(lambda: [0, 0])
    for doc, quality, toxic in labels:
        marks[doc][0] |= quality == 1
        marks[doc][1] |= toxic == 1
    judged = defaultdict(list)
    for doc, text, part in rows:
        text = text or ""
        words = text.translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")
        words = [w for w in words if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": doc is not None and first[text] < doc}
        judged[part or ""].append((fails, *(marks[doc] if doc is not None else (0, 0))))
    out = {}
    for part, docs in judged.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, name in enumerate(order, 1):
                gone, left = [d for d in left if d[0][name]], [d for d in left if not d[0][name]]
                shapley[name] += len(gone)
                failing = [d for d in docs if d[0][name]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(d[0].values()) == 1 for d in failing),
                                                  sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _audited(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in df.collect()}


def test_audit_of_awkward_rows(spark):
    base = " ".join(f"Word{i}" for i in range(60))
    rows = [(*d[:2], s) for d, s in zip(DOCS, ["a", None, "", "a"] * 4)]
    rows += [(30 + i, t, "b") for i, t in enumerate([base, base, base + " #", "x " * 80, "x\x0by\x0cz\t" * 20, "QQQ", base.upper(), "é" * 70, None, base])]
    rows += [(32, base + " #", "b"), (31, base, "c"), (None, base, "c")]
    labels = [(30, 1, 0), (31, 1, 1), (31, 0, 0), (33, None, 1), (None, 1, 1), (99, 1, 1), (1, 1, 0), (6, 0, 1), (7, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {n: F.lit("clash") for n in (*CLASHING, "part", "failed", "digest", "_first", "good", "toxic", "quality")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    assert _audited(filter_audit.audit(docs, marks)) == _plain_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert all(r[4] == r[5] == 0 for r in _audited(filter_audit.audit(docs, marks.limit(0))).values())


def test_audit_of_the_given_documents(spark):
    rows = [tuple(r) for r in table(spark, "documents").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in table(spark, "labels").select("doc_id", "quality", "toxic").collect()]
    assert _audited(LLM_QUERIES["op11_filter_audit"](spark, SF_SMALL)) == _plain_audit(rows, labels)


def test_potentials_of_a_small_game(spark):
    # Two filters that remove the same 3 documents, and one of them a fourth.
    counts = spark.createDataFrame([("p", 3, 3), ("p", 1, 1), ("p", 0, 6)], "part string, failed int, n long")
    row = filter_audit.potentials(filter_audit.coalitions(counts, 2, "part", ["n"]), 2, "n").first()
    assert [row[f"worth_n_{s}"] for s in range(4)] == [0, 4, 3, 4] and row["total_n"] == 10
    assert [row[f"potential_{s}"] for s in range(4)] == [0, 8, 6, 11]


# SimHash


def _plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _reach(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def _plain_components(prints, radius=2):
    """Smallest id reachable of (id, fingerprint) rows; equal ids are one node."""
    links = [(i, j) for n, (i, x) in enumerate(prints) for j, y in prints[:n] if (x ^ y).bit_count() <= radius]
    return _reach({i for i, _ in prints}, links)


def test_fingerprints(spark):
    texts = ["", None, " \t\n", "One", "one TWO", "a b c", "a b c a b c a b c", "É É ü\x0b x\x0cy z", "w " * 70_000, " a b c d", "x" * 100_000]
    assert [simhash.fingerprint((t or "").encode(), 3) for t in texts] == [_plain_fingerprint(t) for t in texts]


def test_simhash_of_the_given_documents(spark):
    rows = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    prints = {d: _plain_fingerprint(t) for d, t in rows.items()}
    out = LLM_QUERIES["op12_simhash"](spark, SF_SMALL).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in out} == {d: f"{x:016x}" for d, x in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in out} == _plain_components(list(prints.items()))


def test_simhash_of_awkward_rows(spark):
    out = simhash.near_duplicates(documents(spark))
    rows = sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in out.collect())
    prints = [(d, _plain_fingerprint(t)) for d, t, _ in DOCS if d is not None]
    want = _plain_components(prints)
    assert [(d, c) for d, _, c in rows if d] == [(d, want[d]) for d, *_ in rows if d] and rows[0] == (0, f"{_plain_fingerprint(DOCS[11][1]):016x}", None)
    assert want[3] == want[4] == want[5] == 3
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and simhash.near_duplicates(no_documents(spark)).count() == 0
    # One id with two texts connects what each of them is linked with.
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (3, "a b c d"), (3, "e f g h"), (4, "i j k l")], "doc_id long, text string")
    assert [r["component_id"] for r in sorted(simhash.near_duplicates(docs).collect())] == [1, 1, 1, 1, 4]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    for i in range(100, 300):
        flips = rng.choice(64, rng.integers(0, radius + 3), replace=False)
        fps[i] = fps[rng.integers(0, i)] ^ np.uint64(sum(1 << int(b) for b in flips))
    stops = np.repeat([1, 130, 131, 300], [1, 129, 1, 169])
    want = {(i, j) for i in range(300) for j in range(i + 1, stops[i]) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    got = [(a, b) for i, j in simhash.pairs_within(fps, stops, radius) for a, b in zip(i.tolist(), j.tolist())]
    assert set(got) == want and len(got) == len(want) > 0
    links = simhash.forest(fps, stops, radius)
    assert set(links) <= want and _reach(range(300), links) == _reach(range(300), want)


@pytest.fixture
def many_partitions(spark):
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_crowded_buckets_are_dealt_out_anew(spark, many_partitions, monkeypatch, bound):
    """Fingerprints that agree in most bits; with the bound at 0 nothing is broadcast."""
    monkeypatch.setattr(simhash, "broadcast_if_small", lambda df, width: df if not bound else F.broadcast(df))
    rng = random.Random(7)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(40), rng.randrange(0, 9))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)}
    rows = list(enumerate(simhash._signed(x) for x in sorted(fps)))
    p = simhash.SimHash(bucket_rows=40, unit_rows=64)
    placed = simhash.buckets(spark.createDataFrame(rows, "node long, fp long"), p)
    assert placed.groupBy("mask", "value").count().agg(F.max("count")).first()[0] <= 40
    links = [(r["a"], r["b"]) for r in simhash.links(placed, p).collect()]
    unsigned = [(i, x & (1 << 64) - 1) for i, x in rows]
    assert _reach(range(len(rows)), links) == _plain_components(unsigned)


# Alignment


def _plain_alignment(texts, files):
    """Groups by sets of ends and links by comparing neighbouring ranges, token by token."""
    from tokenizers import Tokenizer
    import sentencepiece

    a_coder = Tokenizer.from_file(files.byte_level)
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
    a_table, b_table = alignment.ByteLevel(files.byte_level, files.pattern).table, alignment.Pieces(files.pieces).table
    found, counts = [], Counter()
    for text in texts:
        a = a_coder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        if b"".join(a_table[i] for i in a) != (" " + (text or "")).encode() or b"".join(b_table[i] for i in b) != (" " + (text or "")).encode():
            a, b = [], []

        def spans(ids, sizes):
            out, at = [], 0
            for i in ids:
                out.append((at, at + len(sizes[i])))
                at = out[-1][1]
            return out

        x, y = spans(a, a_table), spans(b, b_table)
        both = sorted({e for _, e in x} & {e for _, e in y})
        groups, start = [], 0
        for end in both:
            groups.append(",".join(str(i) for i, (p, q) in zip(a, x) if start < q <= end) + "|" + ",".join(str(i) for i, (p, q) in zip(b, y) if start < q <= end))
            start = end
        links = [(i, j) for i, (p, q) in zip(a, x) for j, (r, s) in zip(b, y) if max(p, r) < min(q, s)]
        counts.update(links)
        found.append((a, b, groups, links))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for a, b, groups, links in found]


ODD = ["", None, " ", "a", "a  b", "tab\there", "line\nbreak", "x<|endoftext|>y", "<s> </s> <unk> <0x41>", "▁under", "ﬁne ½ İstanbul", "日本語 text 🙂🙂", "é café",
       " lead and trail ", "it's don't WE'LL 123456 !!??", "\x00\x01", "a b", "word" * 300]
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent", [1 << 16, 40, 1])
def test_alignment_of_odd_and_given_texts(spark, many_partitions, monkeypatch, frequent):
    """With few frequent pairs most links take the way over the shuffle."""
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    given = [r["text"][:1500] for r in table(spark, "documents").where("doc_id % 4 = 0").orderBy("doc_id").collect()]
    texts = ODD + given + given[:3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).withColumns({n: F.lit("clash") for n in ("a", "b", "_row", "pair", "n", "rare")})
    out = sorted(alignment.aligned(docs, tokenizer_pair()).collect())
    want = _plain_alignment(texts, tokenizer_pair())
    assert [tuple(r[c] for c in NUMBERS) for r in out] == want
    assert sum(w[0] > 0 for w in want) > len(given) and want[1] == want[0] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_of_awkward_rows(spark):
    out = alignment.aligned(documents(spark), tokenizer_pair())
    rows = out.collect()
    want = _plain_alignment([d[1] if len(d[1] or "") < 5000 else None for d in DOCS], tokenizer_pair())
    assert len(rows) == len(DOCS) and out.columns == ["doc_id", *NUMBERS]
    assert sorted((r["doc_id"] or 0, r["groups_sha256"]) for r in rows if r["doc_id"] not in (6, 7, 13)) == sorted(
        (d[0] or 0, w[-1]) for d, w in zip(DOCS, want) if d[0] not in (6, 7, 13))
    long = next(r for r in rows if r["doc_id"] == 6)
    assert long["n_links"] == long["n_a"] + long["n_b"] - long["n_groups"] > 30_000
    assert alignment.aligned(no_documents(spark), tokenizer_pair()).count() == 0


@pytest.mark.parametrize("width, pieces", [(1, 1), (3, 2), (64, 4096)])
def test_pieces_of_the_merge_path(width, pieces):
    rng = np.random.default_rng(width)
    for _ in range(20):
        last = int(rng.integers(1, 200))
        a, b = (np.append(np.sort(rng.choice(last, int(rng.integers(0, last)), replace=False))[1:], last).astype(np.int64) for _ in "ab")
        a, b = a[a > 0], b[b > 0]
        i, j, a_group, b_group = alignment.walked(a, b, width, pieces)
        x, y = list(zip([0, *a], a)), list(zip([0, *b], b))
        assert list(zip(i.tolist(), j.tolist())) == [(m, n) for m, (p, q) in enumerate(x) for n, (r, s) in enumerate(y) if max(p, r) < min(q, s)]
        both = np.array(sorted(set(a.tolist()) & set(b.tolist())))
        assert a_group.tolist() == np.searchsorted(both, a).tolist() and b_group.tolist() == np.searchsorted(both, b).tolist()
    assert [len(x) for x in alignment.walked(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0] * 4
