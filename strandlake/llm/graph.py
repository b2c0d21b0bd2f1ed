"""Connected components of an edge table, by alternating large-star and small-star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut, drop_cut
from strandlake.llm.gray_index import forest

#: Edges that one task joins at once (16 MB); more take rounds over the whole cluster.
FEW = 1_000_000


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour of u (the larger ones, or the others and u itself) to the least of u and its neighbours."""
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    if large:
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
    return out.where("a != b").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches]
    if ends:
        nodes, at = np.unique(np.concatenate(ends, 1), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(nodes))
        other, low = forest(len(nodes), [(a, b)])
        root[other] = low
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """edges: a, b (long), either way round, repeats and loops allowed. Returns node, root (the least node of its component).

    Up to `few` edges go to one task. More take rounds, each a few hash aggregations and joins over the edges left, written to
    the shared folder; nothing is collected but a count and a checksum. Null ends are dropped. No edges: no rows.
    """
    edges = cut(edges.select("a", "b").where("a != b").distinct())
    if edges.count() <= few:
        return edges.coalesce(1).mapInArrow(_joined, "node long, root long")
    seen = None
    while True:
        new = cut(_starred(_starred(edges, True), False))
        now = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        drop_cut(edges)
        edges = new
        if now == seen or not now[0]:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
