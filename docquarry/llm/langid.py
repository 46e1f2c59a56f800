"""Language identification by compression.

Every language has a dictionary of raw text for zstandard. A text is encoded with each of them and
gets the language that makes it smallest. Before that, both are lower-cased and everything but letters
becomes a blank, so that shouted words, numbers and symbols do not blur the comparison.

A margin is what the next best encoding takes more, as a share of the smallest. What counts as a narrow
margin is calibrated on labelled texts that are in no dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docquarry.llm.common import broadcast_if_small
from docquarry.session import ensure_parallelism, materialize

UNKNOWN = "und"
LETTER = r"\p{L}"
#: Lower case for A-Z, a blank for all other ASCII but a-z.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """``samples`` excerpts of ``width`` characters per language make its dictionary; no more text is
    learned from, and more than ``languages`` languages are an error. Encodings closer than ``close`` bytes are
    repeated at ``strong_level``. For every four excerpts one more text is a probe; a language of less than ``few``
    distinct texts has none. Narrow is a margin below ``narrow_share`` of the one that all but ``probe_quantile`` of the rightly told probes exceed."""

    samples: int = 256
    width: int = 256
    languages: int = 1024
    level: int = 6
    strong_level: int = 19
    close: int = 2
    probe_quantile: float = 0.05
    narrow_share: float = 0.4
    few: int = 20


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_PLAIN).split())


@dataclass
class Model:
    """Dictionaries by language, the most frequent language first; it wins a tie.

    A margin up to ``narrow`` is a rejection; 0 rejects ties only.
    """

    dictionaries: dict[str, bytes]
    settings: Settings = Settings()
    narrow: float = 0.0
    _coders: dict[int, list] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "settings": self.settings, "narrow": self.narrow, "_coders": {}}

    def forget(self) -> None:
        """Drop the coders, whose memory grows with the longest text; they are made again when needed."""
        self._coders.clear()

    def _sizes(self, data: bytes, level: int) -> list[int]:
        if level not in self._coders:
            import zstandard as zs

            coders = []
            for raw in self.dictionaries.values():
                shared = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
                shared.precompute_compress(level=level)
                coders.append(zs.ZstdCompressor(
                    level=level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False))
            self._coders[level] = coders
        return [len(c.compress(data)) for c in self._coders[level]]

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, margin). With a single language the margin is infinite."""
        if text is None or not self.dictionaries or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        names = list(self.dictionaries)
        if len(names) == 1:
            return names[0], float("inf")
        data = plain(text)
        sizes = self._sizes(data, self.settings.level)
        first, second = sorted(sizes)[:2]
        if second - first < self.settings.close:
            sizes = [a + b for a, b in zip(sizes, self._sizes(data, self.settings.strong_level))]
            first, second = sorted(sizes)[:2]
        return names[sizes.index(first)], second / first - 1.0

    def score(self, margin: float) -> float:
        """0 for a tie, 1/2 for the widest narrow margin, towards 1 beyond."""
        half = self.narrow or 0.04
        return 1.0 if margin == float("inf") else margin / (margin + half)


def learn(labelled: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> Model:
    """A model of the non-NULL languages in ``labelled``.

    The excerpts come from the distinct texts with the smallest hashes of each language, so copies of a
    text count once; every fifth of these texts is a probe instead, unless they are few. Only hashes are ranked; the driver gets the
    excerpts, bounded by the settings, and the calibrated margin. Probes are whole texts and stay in a written table.
    Rows without a letter are passed over. Without probes only ties are narrow.
    """
    own = labelled.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    known = materialize(own.groupBy("lang", "hash").count())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum("count").alias("n")).limit(settings.languages + 1).collect()}
    if len(sizes) > settings.languages:
        raise ValueError(f"more than {settings.languages} languages to learn")
    ranked = known.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("hash")))
    chosen = materialize(ranked.where(F.col("_n") <= settings.samples + settings.samples // 4).select(
        "lang", "hash", ((F.col("_n") % 5 == 0) & (F.count("*").over(Window.partitionBy("lang")) >= settings.few)).alias("probe")))
    start = F.pmod("hash", F.greatest(F.length("text") - settings.width + 1, F.lit(1))) + 1
    excerpt = F.substring(F.col("text"), start.cast("int"), F.lit(settings.width))
    met = own.join(broadcast_if_small(chosen, F.octet_length("lang") + 25), ["lang", "hash"])
    taken = materialize(met.groupBy("lang", "hash", "probe").agg(F.min(F.when(F.col("probe"), F.col("text")).otherwise(excerpt)).alias("part")))
    parts: dict[str, list[bytes]] = {}
    for row in taken.where(~F.col("probe")).orderBy("lang", "hash").collect():
        parts.setdefault(row["lang"], []).append(plain(row["part"]))
    order = sorted(parts, key=lambda name: (-sizes[name], name))
    model = Model({name: b" ".join(parts[name]) for name in order}, settings)
    if len(order) < 2:
        return model
    probes = classified(ensure_parallelism(taken.where("probe").select(F.col("lang"), F.col("part").alias("text"))), model)
    told = probes.where(F.col("lang") == F.col("lang_pred")).agg(F.percentile("margin", settings.probe_quantile).alias("low"))
    model.narrow = settings.narrow_share * (told.first()["low"] or 0.0)
    return model


def classified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``margin`` and ``rejected``; columns of these names are replaced.

    A text that is NULL or has no letter, or any text if no language was learned, is ``und`` with score and margin 0.
    Rejected is what is ``und`` or has a narrow margin, as texts of no learned language and of several languages
    mostly have; it still carries the nearest language. Row order does not matter. One text at a time is
    taken out of Arrow, and coders are dropped at the end of a task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, margin double, rejected boolean")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in parts:
            found = [own.classify(t.as_py()) for t in texts]
            margins = [margin for _, margin in found]
            yield pa.StructArray.from_arrays([
                pa.array([name for name, _ in found], pa.string()),
                pa.array([own.score(m) for m in margins], pa.float64()),
                pa.array(margins, pa.float64()),
                pa.array([name == UNKNOWN or m <= own.narrow for name, m in found], pa.bool_())],
                names=["lang_pred", "score", "margin", "rejected"])
        own.forget()

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "margin", "rejected")]
    return docs.select(*kept, run(F.col(text)).alias("_found")).select(*kept, "_found.*")


def fold(doc: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    return F.crc32(F.col(doc).cast("string")) % parts
