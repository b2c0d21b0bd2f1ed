"""Sharding by a weighted hash tree: a key descends region, rack and shard by weighted draws.

At each node every child draws -ln(u) / weight for the key, u by hash of the key and the child's path, and the least draw wins;
so a child gets keys in proportion to its weight, and a changed weight moves keys into or out of its own subtree only. What a
later growth adds is a straw of its own beside the straws of the tree as first set up: a key that the new straw wins descends
within what was added, and every other key stays where it was.

A null key counts as the empty string; equal keys go to one shard whatever else their rows hold. Null texts have no bytes.
Repeated rows are rows of their own. An empty table gives no rows; columns of other names are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import cut, drop_cut


@dataclass(frozen=True)
class Leaf:
    """A shard and its place; growth 0 is the tree as first set up."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0
    growth: int = 0


def layout(shards: int, base: int = 40, regions: int = 2, racks: int = 4) -> list[Leaf]:
    """`base` equal shards over regions and racks; each further shard is a growth of its own, in the racks in turn."""
    per_rack = -(-base // (regions * racks))
    out = [Leaf(s, s // (per_rack * racks), s // per_rack % racks) for s in range(min(shards, base))]
    return out + [Leaf(s, (s - base) % regions, (s - base) // regions % racks, growth=s - base + 1) for s in range(base, shards)]


def _draw(key: Column, path: Column, weight: Column) -> Column:
    """-ln(u) / weight for u in (0, 1] from 52 bits of the key's and the path's md5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), path).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1) / float(1 << 52)) / weight


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key (string); a tree is a set-up of bounded size, some thousand leaves, that goes into the expression."""
    if not tree or any(leaf.weight <= 0 for leaf in tree) or len({leaf.shard for leaf in tree}) < len(tree):
        raise ValueError("a tree needs leaves of weights over 0 and a number each")
    levels: list[dict[tuple, float]] = [{}, {}, {}]
    for leaf in sorted(tree, key=lambda x: (x.growth, x.region, x.rack, x.shard)):
        for depth, path in enumerate([(leaf.growth, leaf.region), (leaf.growth, leaf.region, leaf.rack), (leaf.growth, leaf.region, leaf.rack, leaf.shard)]):
            levels[depth][path] = levels[depth].get(path, 0.0) + leaf.weight
    key = F.coalesce(key, F.lit(""))
    at: Column | None = None
    for depth, nodes in enumerate(levels):
        parents = [()] if depth == 0 else list(levels[depth - 1])
        children = {p: [] for p in parents}
        for number, (path, weight) in enumerate(nodes.items()):
            children[path[:-1] if depth else ()].append(F.struct(F.lit("/".join(map(str, path))).alias("path"), F.lit(float(weight)).alias("weight"), F.lit(number).alias("number")))
        lists = F.array(*(F.array(*c) for c in children.values()))
        mine = lists[0] if at is None else F.get(lists, at)
        draws = F.transform(mine, lambda c: F.struct(_draw(key, c["path"], c["weight"]).alias("draw"), c["number"].alias("number")))
        at = F.array_min(draws)["number"]
    return F.get(F.array(*(F.lit(path[-1]) for path in levels[-1])), at)


def number_in_shards(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with slot, gapless from 0 in each shard, by `order` and, where that is equal, in any order.

    Rows are sorted by range over all tasks, so that neither a large shard nor equal rows meet in one, and written with their
    place; a shard's slots follow from how many of its rows earlier tasks hold.
    """
    first = cut(rows.withColumn("_tie", F.monotonically_increasing_id()))
    keys = ["shard", *order, "_tie"]
    placed = cut(first.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}))
    drop_cut(first)
    held = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("shard", "_part", (before - F.col("_first")).alias("_shift"))
    return placed.join(held, ["shard", "_part"]).withColumn("slot", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def assign(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard (where the grown tree puts the row; null without one)."""
    key, text = F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit("")).cast("binary")
    to = shard_of(key, grown) if grown else F.lit(None).cast("int")
    rows = docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), shard_of(key, tree).alias("shard"), to.alias("grown_shard"))
    return number_in_shards(rows, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")


def moves(docs: DataFrame, tree: list[Leaf], other: list[Leaf]) -> DataFrame:
    """shard, other_shard, n: how many rows go where if `other` takes the place of `tree`."""
    key = F.col("doc_id").cast("string")
    return docs.select(shard_of(key, tree).alias("shard"), shard_of(key, other).alias("other_shard")).groupBy("shard", "other_shard").agg(F.count("*").alias("n"))
