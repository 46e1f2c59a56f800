"""Best-fit packing planned over the histogram of lengths.

The driver sees one count per length, at most as many as a sequence has tokens. Best-fit decreasing
is run on these counts: sequences with the same room left are kept as runs of sequence numbers, and a
length fills whole runs at once. The plan says for each length which ranks go to which run. Documents are
then ranked within their length and take their slots by a join on length and rank.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
import os
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from docquarry.llm.common import broadcast_if_small, ranked_within, slices
from docquarry.session import materialize

CAPACITY = 2048
#: Words whose ids a worker remembers; it starts afresh beyond that.
KNOWN_WORDS = 1 << 19
#: Words that are encoded as one text.
_JOINED = 1024
# ASCII signs that the tokenizer takes as runs of their own after a letter or digit.
_SIGNS = b"!#$%&()*+,-./:;=?@[]^_`{}~\""


class WordEncoder:
    """Token ids of texts, encoding each distinct word once.

    For tokenizers whose splitting never joins text across ASCII white space, so that the ids of a
    text are those of its words in turn, and that ignore case, as the one this module is used with.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, words: list[bytes]) -> None:
        """Words of letters alone are encoded many at a time; each ends with the one token of its own that ends a word."""
        texts = [w.decode() for w in words]
        plain = [i for i, text in enumerate(texts) if text.isalpha()]
        for at in range(0, len(plain), _JOINED):
            part = plain[at:at + _JOINED]
            ids = np.array(self.tokenizer.encode(" ".join([texts[i] for i in part]), add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                cuts = (4 * np.append(0, stops)).tolist()
                packed = ids.tobytes()
                self.known.update((words[i], packed[b:e]) for i, b, e in zip(part, cuts, cuts[1:]))
        rest = [(w, t) for w, t in zip(words, texts) if w not in self.known]
        found = self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
        self.known.update((w, pack_ids(e.ids)) for (w, _), e in zip(rest, found))

    def _found(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; one that ends in signs is the word before them and those signs, and only these are remembered."""
        cut, missing = {}, set()
        for w in words:
            if w not in self.known:
                core = w.rstrip(_SIGNS)
                if len(core) < len(w) and core[-1:].isalnum():
                    cut[w] = core, w[len(core):]
                    missing.update(part for part in cut[w] if part not in self.known)
                else:
                    missing.add(w)
        self._encode(list(missing))
        return [self.known[cut[w][0]] + self.known[cut[w][1]] if w in cut else self.known[w] for w in words]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(32-bit ids of all texts, where those of each text begin and end). NULL is empty.

        Words are split and told apart in Arrow, so that only a word's first occurrence becomes an object.
        """
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        texts = texts.cast(pa.string()).fill_null("")
        # Special tokens are recognised before lower-casing.
        marked = pc.match_substring(texts, "<|")
        words = pc.ascii_split_whitespace(pc.if_else(marked, texts, pc.ascii_lower(texts)))
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.cast(pa.binary()).to_pylist()
        self.known[b""] = b""
        found = self._found(distinct)
        table = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        word = flat.indices.to_numpy()
        stops = np.cumsum(sizes[word])
        shift = (np.cumsum(sizes) - sizes)[word] - (stops - sizes[word])
        ids = table[np.repeat(shift, sizes[word]) + np.arange(stops[-1] if len(stops) else 0)]
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        return ids, np.append(0, stops)[offsets]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, bounds = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def pack_ids(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``) of every piece.

    A document is its ids and an id 0 at the end; one longer than ``capacity`` is cut into pieces of that
    length, of which the last may be shorter. A NULL or empty text is the id 0 alone.
    """
    own = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in slices(batches, 1):
            ids, bounds = encoder.encode_column(batch.column(1))
            rows, cut = [], []
            for i, (lo, hi) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                own = np.append(ids[lo:hi], np.uint32(0)).astype("<u4")
                for n, b in enumerate(range(0, len(own), capacity)):
                    piece = own[b:b + capacity]
                    rows.append((i, n, b, len(piece), zlib.crc32(piece)))
                    cut.append(piece)
            index, number, start, length, crc = zip(*rows)
            columns = [batch.column(0).take(pa.array(index)), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([p.view("<i4") for p in cut], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        # The worker lives on and may be used for other work.
        encoder.known.clear()

    return own.mapInArrow(run, schema)


@dataclass(frozen=True)
class Slots:
    """Ranks ``lo`` to ``hi`` of a length go to sequences from ``sequence`` on, ``each`` to one, from ``offset``."""

    length: int
    lo: int
    hi: int
    sequence: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """Best-fit decreasing over counts per length: the result is that of placing the pieces one by one.

    The work depends on the number of lengths and runs, not on the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs (first sequence, how many)
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fit = next((r for r in range(length, capacity + 1) if room[r]), None)
            if fit is None:
                new = -(-left // (capacity // length))
                room[capacity].append((opened, new))
                opened, fit = opened + new, capacity
            first, n = room[fit].pop()
            each = fit // length
            whole = min(n, left // each)
            taken = [(whole, each)] if whole else []
            if whole < n and left < each * (whole + 1):
                taken += [(1, left - whole * each)] if left > whole * each else []
            for sequences, per in taken:
                out.append(Slots(length, rank, rank + sequences * per, first, per, capacity - fit))
                room[fit - per * length].append((first, sequences))
                first, n, rank, left = first + sequences, n - sequences, rank + sequences * per, left - sequences * per
            if n:
                room[fit].append((first, n))
    return out


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``; within a sequence the pieces follow without gaps.

    ``cut`` must be a written table with a ``length`` from 1 to ``capacity``. Repeated rows take slots of
    their own. Without rows there are no sequences.
    """
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots = plan(counts, capacity)
    spark = cut.sparkSession
    table = spark.createDataFrame([(s.length, s.lo, s.hi, s.sequence, s.each, s.offset) for s in slots],
                                  "p_length long, lo long, hi long, sequence long, each long, at long")
    ranked = ranked_within(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")
    within = (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    nth = F.col("_rank") - F.col("lo")
    return ranked.join(broadcast_if_small(table, F.lit(48)), within).select(
        *cut.columns, (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """Cut and pack whole documents; see :func:`pieces` and :func:`packed`. Other columns are not read."""
    return packed(materialize(pieces(docs, tokenizer, capacity, doc, text, with_ids)), capacity)


def sequences(packed_with_ids: DataFrame) -> DataFrame:
    """``sequence_id`` and its ``ids``, put together from pieces that carry theirs."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_with_ids.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
