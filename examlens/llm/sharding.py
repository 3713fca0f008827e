"""Sharding by a hierarchical weighted hash tree.

A key walks from the root over a region and a rack to a shard. At each level every child
draws ln(u) / weight, where u in (0, 1) is a hash of the key and the child's path, and the
highest draw wins: a child gets its share of the weight, and a change of one child's weight
moves keys only to or from it. A shard that joins later is one more straw at the top, with
its own weight, that leads through its region and rack straight to itself; the straws that
were there draw as before, so a key either stays or goes to the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEX52, hex52, running

BLOCKS = 1024


@dataclass(frozen=True)
class Tree:
    """`regions[r][k]` lists the (shard, weight) pairs of a rack; `grown` those that joined later."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]
    grown: tuple[tuple[int, float], ...] = ()

    def __post_init__(self) -> None:
        leaves = [x for r in self.regions for k in r for x in k] + list(self.grown)
        if not leaves or any(not k for r in self.regions for k in r) or any(not w > 0 for _, w in leaves):
            raise ValueError("every rack needs shards, and every shard a positive weight")
        if len({s for s, _ in leaves}) < len(leaves):
            raise ValueError("a shard stands in the tree once")

    @staticmethod
    def of(shards: int, regions: int = 2, racks: int = 4, per_rack: int = 5) -> Tree:
        """A tree for 0 .. shards-1 of equal weight: the base layout first, then one growth step for each more."""
        base = regions * racks * per_rack
        if shards < base:
            raise ValueError(f"the base layout has {base} shards")
        ids = iter(range(shards))
        levels = tuple(tuple(tuple((next(ids), 1.0) for _ in range(per_rack)) for _ in range(racks)) for _ in range(regions))
        return Tree(levels, tuple((s, 1.0) for s in ids))


def _nested(x) -> Column:
    return F.array(*map(_nested, x)) if isinstance(x, list) else F.lit(x)


def _winner(weights: Column, path: Column) -> Column:
    """The index of the child with the highest draw."""
    draws = F.transform(weights, lambda w, i: F.log((hex52(F.concat(path, i.cast("string"))) + F.lit(0.5)) / F.lit(HEX52)) / w)
    return (F.array_position(draws, F.array_max(draws)) - 1).cast("int")


def shard_of(key: Column, tree: Tree) -> Column:
    """The key's shard. A null key is treated as the empty text."""
    key = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("/"))
    racks = [[sum(w for _, w in k) for k in r] for r in tree.regions]
    top = _nested([float(sum(r)) for r in racks] + [w for _, w in tree.grown])
    weights = _nested([[[w for _, w in k] for k in r] for r in tree.regions])
    ids = _nested([[[s for s, _ in k] for k in r] for r in tree.regions])

    def below(region: Column) -> Column:
        in_region = F.concat(key, region.cast("string"), F.lit("/"))

        def leaf(rack: Column) -> Column:
            in_rack = F.concat(in_region, rack.cast("string"), F.lit("/"))
            return F.transform(F.array(_winner(weights[region][rack], in_rack)), lambda s: ids[region][rack][s])[0]

        return F.transform(F.array(_winner(_nested(racks)[region], in_region)), leaf)[0]

    # A value that is used more than once is bound by a lambda, so that it is computed once.
    grown = F.array(*[F.lit(s) for s, _ in tree.grown]) if tree.grown else F.array().cast("array<int>")
    n = len(tree.regions)
    return F.transform(F.array(_winner(top, key)), lambda r: F.when(r < n, below(F.least(r, F.lit(n - 1)))).otherwise(F.get(grown, r - n)))[0]


def assign_shards(docs: DataFrame, tree: Tree, larger: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of `docs`.

    - size is the text's UTF-8 bytes plus 16; a null text has no bytes and a null crc, an empty one crc 0;
    - a null doc_id is placed as the empty text; equal ids share a shard, each with a slot of its own;
    - slots run from 0 without a gap in each shard, over 1024 hash blocks, so no task sees a whole shard;
    - an empty table gives an empty result; other columns of `docs` are ignored.
    """
    larger = larger or tree
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        shard_of(F.col("doc_id"), larger).alias("grown_shard"),
        (hex52(F.concat(F.lit("slot/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) % BLOCKS).cast("int").alias("block"),
    )
    placed = running(rows, ["shard"], "block", ["doc_id", "size", "text_crc32"], F.lit(1), "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
