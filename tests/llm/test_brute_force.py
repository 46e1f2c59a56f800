"""Operators without SQL against plain versions of what they compute."""

from collections import Counter
import gzip
import hashlib
import html
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from docquarry.llm import html_suffix, langid, line_dedup, near_dup, packing, quality, sharding, vptree, warc
from docquarry.llm.components import connected
from docquarry.llm.queries import LLM_QUERIES, tokenizer_path


def table(spark, name):
    return spark.read.parquet(f"{SF_SMALL}/{name}.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}


def test_shards_move_only_into_a_new_one(spark, texts):
    out = LLM_QUERIES["op5_sharding"](spark, SF_SMALL).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out} == {
        d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts.items()}
    assert all(r["grown_shard"] in (r["shard"], 40) for r in out)
    for shard in range(40):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_changed_weight_moves_rows_only_through_its_subtrees(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.Tree((((1.0, 1.0), (1.0, 1.0)), ((2.0, 1.0), (0.0, 1.0))))
    more = sharding.Tree((((1.0, 1.0), (1.0, 1.0)), ((4.0, 1.0), (0.0, 1.0))))
    both = sharding.assign(sharding.assign(ids, "doc_id", tree, "a"), "doc_id", more, "b").groupBy("a", "b").count().collect()
    counts = Counter()
    for r in both:
        counts[r["a"]] += r["count"]
        if r["a"] != r["b"]:
            # From the other region into the grown one, from the other rack into the grown one, or into the shard itself.
            assert r["b"] == 4 or r["b"] >= 4 > r["a"] or r["b"] == 5 and r["a"] == 7
    assert counts[6] == 0 and abs(counts[4] / 20_000 - 2 / 8) < 0.02 and abs(counts[0] / 20_000 - 1 / 8) < 0.02


def test_best_fit_plan_equals_one_by_one():
    random.seed(3)
    for _ in range(30):
        lengths = sorted((random.randint(1, 40) for _ in range(random.randint(0, 300))), reverse=True)
        room: list[int] = []
        for n in lengths:
            fits = [(r, i) for i, r in enumerate(room) if r >= n]
            if fits:
                room[min(fits)[1]] -= n
            else:
                room.append(40 - n)
        slots = packing.plan(Counter(lengths), 40)
        fill: Counter = Counter()
        for s in sorted(slots, key=lambda s: (s.sequence, s.offset)):
            for rank in range(s.lo, s.hi):
                at = s.sequence + (rank - s.lo) // s.each
                assert s.offset + (rank - s.lo) % s.each * s.length == fill[at]
                fill[at] += s.length
        assert len(fill) == len(room) and sorted(fill.values()) == sorted(40 - r for r in room)


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(table(spark, "documents"), tokenizer_path(), with_ids=True).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(found.get(r["doc_id"], []))
        found.setdefault(r["doc_id"], []).extend(r["ids"])
    assert found == {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    assert max(Counter({r["sequence_id"]: 0 for r in rows} | {}).values(), default=0) == 0
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // packing.CAPACITY) + 1


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), packing.WordEncoder(tokenizer_path())
    odd = ["a<|endoftext|>b", "<|ENDOFTEXT|> X", "it's, x's! 'S don't. İstanbul.. ΣΑΣ, ½²! é́ á, ́b", " a b, c　d", "'s, x'. \"q\" w$$$ ok\x00y\x1c z\x85w", "", None]
    for text, ids in zip(odd, encoder.encode(odd)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 201)]
    random.seed(1)
    random.shuffle(chain)
    out = {r["node"]: r["component"] for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}


def _links(sets, percent):
    n = len(sets)
    return [(i, j) for i in range(n) for j in range(i + 1, n) if sets[i] and sets[j]
            and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def _reach(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def test_large_group_of_near_copies_in_tiles(spark, many_partitions, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE_ROWS", 40)
    random.seed(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(240):
        words = list(base)
        for at in random.sample(range(60), random.randint(0, 6)):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words) if i % 6 else " ".join(f"u{i}_{j}" for j in range(30))))
    sets = [frozenset(zip(t.split(), t.split()[1:])) for _, t in rows]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dup.NearDup(words=2)).collect()
    assert [r["component_id"] for r in sorted(found)] == _reach(len(rows), _links(sets, 80))


def test_many_pairs_are_counted_as_few_are(monkeypatch):
    p, rng = near_dup.NearDup(words=2), np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    sets = []
    for _ in range(60):
        own = base.copy()
        own[rng.choice(80, rng.integers(3, 14), replace=False)] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
        sets.append(np.unique(own))
    sigs = np.stack([near_dup.signature(s, p.length) for s in sets])
    bands, side = np.stack([near_dup.band_keys(s, p) for s in sigs]), np.zeros(60, dtype=bool)
    want = _reach(60, _links([frozenset(s.tolist()) for s in sets], 80))
    for few in (20_000, 5):
        monkeypatch.setattr(near_dup, "_FEW_PAIRS", few)
        assert _reach(60, near_dup.spanning_links(bands, sigs, sets, side, False, p)) == want


def test_sequential_bounds_follow_the_miss_probability():
    strict, loose = near_dup.NearDup(miss=1e-12).least_matches(), near_dup.NearDup(miss=1e-2).least_matches()
    assert all(a[0] == b[0] and a[1] < b[1] for a, b in zip(strict, loose))


@pytest.fixture
def many_partitions(spark):
    """Groups that ought to meet must do so in whichever partition they lie."""
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (1.5, 0.9)])
def test_neighbours(spark, many_partitions, factor, least):
    rows = vptree.usable(table(spark, "embeddings"), "vec_id", "embedding")
    copies = rows.where("id < 40").withColumn("id", F.col("id") + 10_000)
    own = rows.unionByName(copies)
    search = vptree.Search(k=7, factor=factor, leaf_rows=16, shard_rows=200, block_rows=10)
    out = vptree.nearest(own.where("id % 20 = 0"), own, search).collect()
    local = {r["id"]: np.array(r["v"]) for r in own.collect()}
    ids = np.array(sorted(local))
    vectors = np.stack([local[i] for i in ids])
    right = total = 0
    for q in (i for i in ids if i % 20 == 0):
        exact = vptree.scores(local[q][None, :], vectors)
        ranked = [(int(i), float(s)) for s, i in sorted(zip(-exact, ids)) if i != q][:7]
        got = [(r["vec_id"], -r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q]
        right, total = right + len(set(got) & set(ranked)), total + 7
        if factor == 1.0:
            assert got == ranked
    assert right / total >= least


def test_language_accuracy(spark):
    out = LLM_QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.97
    assert sum(r["rejected"] for r in out) / len(out) < 0.02


def test_narrow_margins_are_rejected():
    model = langid.Model({"aa": b"alpha beta gamma delta epsilon " * 20, "bb": b"uno dos tres cuatro cinco seis " * 20})
    assert model.classify("Beta, gamma; DELTA epsilon")[0] == "aa" and model.classify("Tres cuatro cinco!")[0] == "bb"
    assert model.classify("zq")[1] == 0


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    out = LLM_QUERIES["op9_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in out if r["quality"]], [r["score"] for r in out if not r["quality"]]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.95


def test_interactions_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, pairs=1)
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    alone = quality.fit(x, y, pairs=0)
    assert ((alone.score(x) > 0.5) == y).mean() < 0.75


def test_line_dedup(spark, texts):
    out = {r["doc_id"]: r for r in LLM_QUERIES["op10_line_dedup"](spark, SF_SMALL).collect()}
    held, earlier = {}, set()
    for doc in sorted(texts):
        lines = [line.strip() for line in line_dedup.split_lines(texts[doc].encode())[0]]
        need, spans = set(), list(line_dedup.runs([len(x.split()) for x in lines], line_dedup.MIN_WORDS))
        for a, b in spans:
            if held.get(tuple(lines[a:b]), doc) < doc:
                need.update(range(a, b))
            held.setdefault(tuple(lines[a:b]), doc)
        assert out[doc]["n_deleted"] >= len(need)
        if out[doc]["n_deleted"] == 0:
            assert out[doc]["text"] == texts[doc]
        # Whatever words are gone stand in an earlier document, in a block of 20 words or a passage of 50.
        words, kept = texts[doc].encode().split(), out[doc]["text"].encode().split()
        allowed = np.zeros(len(words), dtype=bool)
        for i in range(len(words) - line_dedup.MIN_WORDS + 1):
            if tuple(words[i:i + line_dedup.MIN_WORDS]) in earlier:
                allowed[i:i + line_dedup.MIN_WORDS] = True
        assert allowed.sum() >= len(words) - len(kept)
        if out[doc]["n_deleted"]:
            # What is left is a part of the text in its order, and every gap in it is of words that are allowed to go.
            stay = iter(kept)
            nxt = next(stay, None)
            for i, w in enumerate(words):
                if not allowed[i]:
                    while nxt is not None and nxt != w:
                        nxt = next(stay, None)
                    assert nxt == w
                    nxt = next(stay, None)
        earlier |= {tuple(words[i:i + line_dedup.MIN_WORDS]) for i in range(len(words))}


def test_a_block_that_the_first_holder_has_in_part(spark):
    first, tail = (" ".join(f"{c}{i}" for i in range(n)) + "." for c, n in (("s", 25), ("t", 15)))
    rows = [(1, f"{first}\nown end of one"), (2, f"start two\n{first}\n\n{tail}\nend two"), (3, f"start three\n{first}  \n{tail}\nend three")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: f"start two\n\n{tail}\nend two", 3: "start three\nend three"}


def test_seeds_of_many_texts_at_once():
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["".join(rng.choice(["w", "v. ", "u\n", "tt ", ". \n"]) + " " for _ in range(rng.choice([0, 3, 60, 200]))) for _ in range(40)]
    (words, number, counts), = line_dedup.numbered_words(pa.array(texts))
    columns = [c.to_pylist() for c in line_dedup.line_columns(words, number, counts, 20)]
    for n, (hashes, sizes, numbers, seeds, tails, marks) in enumerate(zip(*columns)):
        own, at = words[counts[n]:counts[n + 1]], number[counts[n]:counts[n + 1]]
        lines = [own[at == k] for k in sorted(set(at.tolist()))]
        assert numbers == sorted(set(at.tolist())) and sizes == [len(x) for x in lines]
        assert hashes == [int(line_dedup.spans_of(x, np.array([0]), np.array([len(x)]))[0]) for x in lines]
        ahead = list(line_dedup.runs(sizes, 20))

        def hashed(a, b):
            return int(line_dedup.spans_of(np.array(hashes[a:b]), np.array([0]), np.array([b - a]))[0])

        assert seeds == [hashed(a, b) for a, b in ahead]
        behind = [(max(a for a in range(e) if sum(sizes[a:e]) >= 20), e) for e in range(1, len(sizes) + 1) if sum(sizes[:e]) >= 20]
        assert tails == [hashed(a, b) for a, b in behind if (a, b) not in ahead]
        assert set(marks) == set(line_dedup.passage_marks(own).tolist())


def test_words_know_their_lines():
    import pyarrow as pa

    odd = ["a b. c\nd", None, "", " x.  \n\n y!\tz \r\n w? ", ". a", "\n\na.\n", "é. ü", "a.b c\x0bd. \x0b e", "x."]
    for text, (words, number) in zip(odd, line_dedup.worded_lines(pa.array(odd))):
        lines = line_dedup.split_lines((text or "").encode())[0]
        assert number.tolist() == [n for n, line in enumerate(lines) for _ in line.split()] and len(words) == len(number)


def test_moved_and_repeated_passages(spark):
    p, q = (" ".join(f"{c}{i}" for i in range(30)) for c in "pq")
    rows = [(1, f"one\n{p}\nmiddle\n{q}"), (2, f"{q}\nown words\n{p}\n{p}"), (3, "\n".join(p.split()[:10]) + "\nshort"), (4, "\n".join(p.split()[:10]) + "\nother")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "own words", 3: rows[2][1], 4: rows[3][1]}


def test_a_passage_joined_to_other_text(spark):
    passage = "It was said once. Then it was said again by all who heard it first! And so it went on and on for years. End of it."
    rows = [(1, f"Own start. {passage}"), (2, f"Other words here.\nMore of them. {passage} A tail."), (3, f"x {passage}")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "Other words here.\nMore of them. A tail.", 3: "x It was said once."}


def test_passages_placed_mid_sentence(spark, many_partitions):
    rng = random.Random(8)

    def prose(n):
        return [rng.choice("abcdefgh") + str(rng.randrange(10**6)) + ("." if i % 23 == 22 else "") for i in range(n)]

    passages = [prose(n) for n in (50, 57, 64, 80, 120)]
    texts = {}
    for doc in range(1, 41):
        words = prose(rng.randrange(5, 60))
        for p in rng.sample(passages, rng.randrange(3)):
            # Some hold only a part, so that the first holder of a stretch is not that of the passage.
            lo = rng.choice([0, 0, 0, 5, 25])
            words += p[lo:len(p) - rng.choice([0, 0, 3])] + prose(rng.randrange(1, 40))
        texts[doc] = "".join(w + rng.choice([" ", " ", " ", "\n", "  "]) for w in words).strip()
    rows = [*texts.items(), (50, texts[7]), (50, "another text"), (None, texts[7])]
    out = {r["doc_id"]: r for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] != 50}
    seen, cuts = {}, 0
    for doc, text in texts.items():
        words, gone = text.split(), set()
        for i in range(len(words) - 49):
            if seen.setdefault(tuple(words[i:i + 50]), doc) < doc:
                gone.update(range(i, i + 50))
        assert out[doc]["text"].split() == [w for i, w in enumerate(words) if i not in gone]
        assert (out[doc]["n_deleted"] > 0) == bool(gone) and (gone or out[doc]["text"] == text)
        cuts += bool(gone)
    assert cuts > 10 and out[None]["text"] == texts[7]


def test_cut_passages_leave_the_rest_as_it_is():
    passage = " ".join(f"p{i}" for i in range(50))
    text = f" A  b. Own start {passage.replace(' p20 ', ' p20. ' + chr(10) * 2)}  end  here.\nLast".replace("p19 ", "p19\r\n").encode()
    assert line_dedup.without_passages(text, set(), [5 - 1]) == (b" A  b. Own start\r\nend  here.\nLast", 5)
    assert line_dedup.without_passages(text, {0}, []) == (text[len(" A  b. "):], 1)
    assert line_dedup.without_passages(passage.encode(), set(), [0]) == (b"", 1)


@pytest.mark.parametrize("text", ["", "a", "a. b.\nc", " \n ", "a.  b\r\n\r\nc! ", "\n\n"])
def test_lines_and_separators_make_up_the_text(text):
    lines, separators = line_dedup.split_lines(text.encode())
    assert b"".join(x for pair in zip(lines, [*separators, b""]) for x in pair) == text.encode() and len(lines) == len(separators) + 1
    assert line_dedup.without_lines(text.encode(), set()) == (text.encode() if text.strip() else b"")


def test_patience():
    assert line_dedup.patience([1, 2, 3, 9, 4], [0, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (4, 4)]
    assert line_dedup.patience([1, 2], [3, 4]) == []


class _File(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def _archive(zipped):
    records = []
    for i in range(40):
        payload = f"<html>{i} ".encode() + b"WARC/1.0\r\n\r\n" * (i % 3) + bytes(range(256)) * i
        record = warc._record("response", str(i), f"http://x/{i}", payload, hashlib.sha256(payload).hexdigest(), None)
        records.append(gzip.compress(record, 6, mtime=0) if zipped else record)
    return records


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    records = _archive(zipped)
    starts = np.cumsum([0, *map(len, records)])

    def read(data):
        found = list(warc.salvage(warc.Source(_File(data))))
        keys = [warc._identifier(f["warc-record-id"]) for *_, rs in found for f, _ in rs]
        return keys, [(a, n) for a, n, reason, _ in found if reason]

    whole = b"".join(records)
    assert read(whole) == ([str(i) for i in range(40)], [])
    for lost in (0, 7, 39):
        # A flipped byte in a payload quarantines that record and no other.
        bad = bytearray(whole)
        bad[starts[lost + 1] - (len(records[lost]) // 2 if zipped else 6)] ^= 255
        keys, gaps = read(bytes(bad))
        assert keys == [str(i) for i in range(40) if i != lost] and gaps == [(starts[lost], len(records[lost]))]
    junk = b"junk\x1f\x8b\x08more junk\n"
    assert read(junk + whole)[0] == [str(i) for i in range(40)] and read(junk + whole)[1] == [(0, len(junk))]
    keys, gaps = read(whole[:-5])
    assert keys == [str(i) for i in range(39)] and gaps == [(starts[39], len(records[39]) - 5)]
    assert read(b"") == ([], [])


def test_salvage_inside_members(tmp_path):
    records, before = _archive(False), _archive(True)[:2]
    starts = np.cumsum([0, *map(len, records)])

    def read(data):
        found = list(warc.salvage(warc.Source(_File(data))))
        return [warc._identifier(f["warc-record-id"]) for *_, rs in found for f, _ in rs], [(a, reason) for a, _, reason, _ in found if reason]

    names = [str(i) for i in range(40)]
    whole = b"".join(records)
    packed = gzip.compress(whole, 6, mtime=0)
    assert read(packed) == (names, [])
    for lost in (0, 7, 39):
        # A bad record in a sound member.
        bad = bytearray(whole)
        bad[starts[lost + 1] - 6] ^= 255
        keys, gaps = read(b"".join(before) + gzip.compress(bytes(bad), 6, mtime=0) + before[1])
        assert keys == ["0", "1", *(n for n in names if n != str(lost)), "1"]
        assert gaps == [(sum(map(len, before)), f"{'block'} digest, bytes {starts[lost]} to {starts[lost + 1]} unpacked")]
    # A cut tail: all records that can be unpacked whole stay.
    cut = packed[:len(packed) // 2]
    got = len(zlib.decompressobj(wbits=31).decompress(cut))
    keys, gaps = read(cut)
    assert keys == names[:np.searchsorted(starts, got, side="right") - 1] and len(keys) > 2 and gaps
    # A damaged byte: records before it stay, and the members behind it are found.
    bad = bytearray(packed)
    bad[len(packed) * 2 // 3:len(packed) * 2 // 3 + 40] = bytes(40)
    keys, gaps = read(bytes(bad) + b"".join(before))
    assert keys[-2:] == ["0", "1"] and len(keys) > 4 and keys[:-2] == [n for n in names if n in keys[:-2]] and gaps
    # A wrong checksum: the digests vouch for the records.
    bad = bytearray(packed)
    bad[-6] ^= 255
    assert read(bytes(bad) + before[0])[0] == [*names, "0"]


def test_main_text_of_pages(spark):
    out = {r["page_id"]: r["text"] for r in LLM_QUERIES["op7_html_text"](spark, SF_SMALL).collect()}
    for r in table(spark, "pages").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert out[r["page_id"]] == "\n".join(p for p in parts if p)


def test_repeated_runs_of_unmarked_pages_go(spark, many_partitions, monkeypatch):
    # Small parts, so that runs have to be counted across parts of a host.
    monkeypatch.setattr(html_suffix, "PART_TOKENS", 200)
    menu = "".join(f"<div><a href=/{i}>Menu entry {i}</a></div>" for i in range(4))
    end = "<div>All rights are reserved by the owner of this page and site</div>"
    rows = [(i, f"http://host/{i}", f"<body>{menu}<h1>Title {i}</h1><p>{' '.join(f'w{i}_{j}' for j in range(30))}</p>{end}") for i in range(30)]
    rows += [(100 + i, f"http://other{i}/", f"<body>{menu}<p>alone {i}</p>{end}") for i in range(3)]
    rows += [(200, "http://host/art", f"<article><p>All rights are reserved by the owner of this page and site</p></article>{menu}")]
    out = {r["page_id"]: r["text"] for r in html_suffix.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert out[i] == f"Title {i}\n{' '.join(f'w{i}_{j}' for j in range(30))}"
    assert all("Menu entry 0" in out[100 + i] and f"alone {i}" in out[100 + i] for i in range(3))
    assert out[200] == "All rights are reserved by the owner of this page and site"


def test_near_copies_and_chance_repeats_of_unmarked_pages_stay(spark, many_partitions):
    menu = "<div>" + " ".join(f"menu{i}" for i in range(12)) + "</div>"
    article = " ".join(f"word{i}" for i in range(80))
    phrase = "an ordinary phrase of ten words that some pages repeat"

    def page(text, top=menu):
        return f"<body>{top}<p>{text}</p></body>"

    # Near copies alone on their host, and among other pages; a large host on which a phrase recurs on a tenth of the pages.
    rows = [(i, f"http://small/{i}", page(f"{article} date{i}", "")) for i in range(3)]
    rows += [(100 + i, f"http://mixed/{i}", page(f"{article} date{i}" if i < 4 else " ".join(f"m{i}_{j}" for j in range(40)))) for i in range(16)]
    rows += [(1000 + i, f"http://large/{i}", page(" ".join(f"l{i}_{j}" for j in range(20)) + (f" {phrase} e{i}" if i % 10 == 0 else ""))) for i in range(200)]
    # A short page is boilerplate for the most part.
    rows += [(2000, "http://large/short", page("short"))]
    out = {r["page_id"]: r["text"] for r in html_suffix.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {k: re.search("<p>(.*)</p>", h)[1] for k, _, h in rows}
    assert out == want


def test_structure_of_pages():
    page = """<div class="cookie-notice">Accept</div><header>Site</header><article class="post"><header><h1>Head</h1></header>
    <p>One<b>bold<p>Two<div class="share">Share</div><ul><li>x<li>y</ul><aside>Side</aside><form>Find</form>
    <article class="comment">Reply</article><footer>Tags</footer></article><div>Related</div><script>"</article>"</script>"""
    assert html_suffix.main_text(html_suffix.blocks(page), set()) == "Head\nOnebold\nTwo\nx\ny"


def test_suffixes_are_sorted_to_depth():
    rng = np.random.default_rng(4)
    tokens, pages = rng.integers(0, 3, 300), np.repeat(np.arange(30), 10)
    order, rank = html_suffix.sorted_to_depth(tokens, pages, 5)
    keys = [tuple(tokens[i:min(i + 5, 10 * (pages[i] + 1))]) for i in range(300)]
    assert [keys[i] for i in order] == sorted(keys)
    assert len({(r, k) for r, k in zip(rank.tolist(), keys)}) == len(set(keys)) == len(set(rank.tolist()))
