"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At every level each child draws ``-ln(u) / weight``, where ``u`` is a hash of the child's path and
the row's key, and the smallest draw wins. A child wins in proportion to its weight, and a change
of one weight moves rows only between the subtree it belongs to and its siblings: the draws of all
other children stay what they were. Rows that enter a grown subtree spread over all of its
shards, so a shard that is to take rows only into itself opens a region of its own.

Only built-in functions are used; a row's place depends on its key and the tree alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from docquarry.functions.text import stage
from docquarry.llm.common import ranked_within

#: Bits of a hash that are turned into a draw, so that the draw is exact in double precision.
DRAW_BITS = 52
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Tree:
    """Weights of shards as ``regions[region][rack][shard]``; shards are numbered in that order.

    A weight of 0 keeps a shard's number but gives it no rows.
    """

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def even(shards: int, regions: int = 4, racks: int = 2) -> Tree:
        """Shards of weight 1, dealt out over regions and racks in runs of nearly equal length."""
        def cut(numbers: range, parts: int) -> list[range]:
            bounds = [len(numbers) * i // parts for i in range(parts + 1)]
            return [numbers[a:b] for a, b in zip(bounds, bounds[1:]) if b > a]

        return Tree(tuple(tuple(tuple(1.0 for _ in rack) for rack in cut(region, racks))
                          for region in cut(range(shards), regions)))

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own: rows move into it and nowhere else."""
        return replace(self, regions=(*self.regions, ((weight,),)))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def __post_init__(self):
        weights = [w for region in self.regions for rack in region for w in rack]
        if not weights or min(weights) < 0 or max(weights) <= 0:
            raise ValueError("a tree needs shards with weights of at least 0, one of them above")


def _draw(path: Column, key: Column, weight: Column) -> Column:
    """Exponential draw of a child; NULL, which never wins, for a weight of 0."""
    bits = F.shiftrightunsigned(F.xxhash64(F.concat_ws("|", path, key)), 64 - DRAW_BITS)
    return F.when(weight > 0, -F.ln((bits + 1) / float(1 << DRAW_BITS)) / weight)


def _descend(path: Column, key: Column, weights: Sequence[Column]) -> Column:
    """Number of the child with the smallest draw, ties to the smaller number."""
    drawn = [F.struct(_draw(F.concat_ws("/", path, F.lit(str(i))), key, w).alias("draw"), F.lit(i).alias("child"))
             for i, w in enumerate(weights)]
    return F.array_min(F.filter(F.array(*drawn), lambda x: x["draw"].isNotNull()))["child"]


def _table(values: Sequence[Sequence[float]]) -> list[Column]:
    """One literal array per child number, indexed by the number of the parent."""
    width = max(len(v) for v in values)
    return [F.array(*[F.lit(float(v[i]) if i < len(v) else 0.0) for v in values]) for i in range(width)]


def assign(df: DataFrame, key: str, tree: Tree, name: str) -> DataFrame:
    """Add the shard number of each row. Rows with equal keys share a shard, as do rows without."""
    racks = [rack for region in tree.regions for rack in region]
    first_rack = F.array(*[F.lit(sum(len(r) for r in tree.regions[:i])) for i in range(len(tree.regions))])
    first_shard = F.array(*[F.lit(sum(len(r) for r in racks[:i])) for i in range(len(racks))])
    own = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    region_weights = [F.lit(float(sum(map(sum, region)))) for region in tree.regions]
    rack_weights = _table([[sum(rack) for rack in region] for region in tree.regions])
    shard_weights = _table(racks)

    placed = stage(df, {"_key": own})
    placed = stage(placed, {"_region": _descend(F.lit("region"), F.col("_key"), region_weights)})
    placed = stage(placed, {"_rack": _descend(
        F.concat_ws("/", F.lit("rack"), F.col("_region")), F.col("_key"), [F.get(w, F.col("_region")) for w in rack_weights])})
    placed = stage(placed, {"_at": F.get(first_rack, F.col("_region")) + F.col("_rack")})
    placed = stage(placed, {name: (F.get(first_shard, F.col("_at")) + _descend(
        F.concat_ws("/", F.lit("shard"), F.col("_region"), F.col("_rack")), F.col("_key"),
        [F.get(w, F.col("_at")) for w in shard_weights])).cast("int")})
    return placed.select(*[c for c in df.columns if c != name], name)


def sharded(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` of every row.

    ``size`` is the length of the text in bytes plus a constant; a NULL text counts as empty.
    ``slot`` numbers the rows of a shard without gaps; repeated rows get slots of their own.
    ``grown_shard`` is the row's shard once the tree has one shard more. A NULL key is a key like
    any other. Other columns are not read, whatever their names.
    """
    own = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    placed = assign(assign(own, "doc_id", tree, "shard"), "doc_id", tree.grown(), "grown_shard")
    return ranked_within(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
