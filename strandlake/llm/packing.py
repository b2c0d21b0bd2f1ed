"""Best-fit packing of tokenised documents into fixed-length sequences, by hierarchical residual packing.

Every input partition packs its own pieces best-fit and emits the nearly full bins; the underfull bins travel up a merge tree
as items, and each node of the tree packs the bins of its children best-fit again.

No two bins of one best-fit packing fit together, so each packing has one bin of half the capacity or less at most, and only such
a bin can bring two together later. A node that is given m of them makes m merges at most, so of the underfull bins of one
fill it can use up m at most. What is beyond the uses of all nodes above is final as it is: the result is as if all went on,
and what a node receives has a bound that doesn't grow with the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut, slices

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BINS = "sequence_id long, fill int, done boolean, grp long, spare int, members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>>"
BIN_SCHEMA = pa.schema([("sequence_id", pa.int64()), ("fill", pa.int32()), ("done", pa.bool_()), ("grp", pa.int64()), ("spare", pa.int32()), ("members", pa.list_(MEMBER))])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Documents tokenised at a time; pieces packed at a time in a partition.
BATCH_CHARS, CHUNK = 1_000_000, 50_000
#: Bits of a sequence id: tree level, node, bin in the node.
NODE_BITS, BIN_BITS = 24, 34


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, best-fit over sizes in decreasing order; bins are numbered as they open."""
    order = np.argsort(-sizes, kind="stable")
    bins, room, mask, opened = np.empty(len(sizes), np.int64), {}, 0, 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            at = room[left]
            b = at.pop()
            if not at:
                mask ^= 1 << left
        else:
            left, b, opened = capacity, opened, opened + 1
        left -= s
        bins[i] = b
        if left:
            if not (at := room.setdefault(left, [])):
                mask |= 1 << left
            at.append(b)
    return bins


def _bins(members: pa.Array, sizes: np.ndarray, capacity: int, slack: int, level: int, node: int, first: int, last: bool) -> pa.RecordBatch:
    """Pack items (lists of members) and lay out each bin; spare counts the bins of the same fill before an underfull one."""
    bins = best_fit(sizes, capacity)
    order = np.argsort(bins, kind="stable")
    taken = members.take(pa.array(order))
    counts = np.diff(taken.offsets.to_numpy())
    n = int(bins.max()) + 1 if len(bins) else 0
    per_bin = np.bincount(bins[order], counts, n).astype(np.int64)
    fill = np.bincount(bins, sizes, n).astype(np.int32)
    done = (fill >= capacity - slack) | last
    by_fill = np.argsort(fill, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(fill[by_fill]) != 0]) if n else np.zeros(0, np.int64)
    spare = np.empty(n, np.int32)
    spare[by_fill] = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_bin)].astype(np.int32)), taken.flatten())
    ids = (level << (NODE_BITS + BIN_BITS)) + (node << BIN_BITS) + first + np.arange(n, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fill), pa.array(done), pa.array(np.full(n, node, np.int64)), pa.array(spare), lists.cast(pa.list_(MEMBER))], schema=BIN_SCHEMA)


def _local(tokenizer: str, capacity: int, slack: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from strandlake.llm.tokens import encoder

        enc, node, made = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end, wide = np.array([end_id], "<u4").tobytes(), 4 * capacity
        cols: list[list] = [[], [], [], [], []]

        def flush(rest: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, cols
            if not cols[0] or (not rest and len(cols[0]) < CHUNK):
                return
            members = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, MEMBER)], fields=list(MEMBER))
            one = pa.ListArray.from_arrays(pa.array(np.arange(len(members) + 1, dtype=np.int32)), members)
            out = _bins(one, np.array(cols[3], np.int64), capacity, slack, 0, node, made, False)
            made, cols = made + out.num_rows, [[], [], [], [], []]
            yield out

        for batch in slices(batches):
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            i = 0
            while i < len(docs):
                part, chars = [], 0
                while i + len(part) < len(docs) and (not part or chars < BATCH_CHARS):
                    part.append(texts[i + len(part)].as_py() or "")
                    chars += len(part[-1])
                for doc, ids in zip(docs[i : i + len(part)], enc.ids(part)):
                    ids += end
                    for k in range(0, len(ids), wide):
                        own = ids[k : k + wide]
                        for c, v in zip(cols, (doc, k // wide, k // 4, len(own) // 4, zlib.crc32(own))):
                            c.append(v)
                i += len(part)
                yield from flush(False)
        yield from flush(True)

    return run


def _merge(capacity: int, slack: int, level: int, last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("sequence_id").combine_chunks()
        out = _bins(table.column("members").combine_chunks(), table.column("fill").to_numpy().astype(np.int64), capacity, slack, level, key[0].as_py(), 0, last)
        return pa.Table.from_batches([out])

    return run


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("members")
        counts, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
        length = flat.field("length").to_numpy()
        before = np.cumsum(length) - length
        firsts = np.repeat(before[np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)] if len(length) else before, counts)
        yield pa.RecordBatch.from_arrays([*(flat.field(f.name) for f in MEMBER), pa.array(np.repeat(batch.column("sequence_id").to_numpy(), counts)), pa.array(before - firsts)], names=[*(f.name for f in MEMBER), "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, slack: int = 8, fan_in: int = 8) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs: doc_id, text; other columns are ignored. Null and empty texts are one end id; a null doc_id is kept; repeated rows
    are packed as often as they occur; an empty table gives no rows. Only documents over `capacity` ids are cut.
    slack: free ids that a nearly full bin may have. fan_in: children of a tree node.
    """
    todo = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_local(tokenizer, capacity, slack, end_id), BINS))
    ready, level = [], 0
    nodes = (todo.agg(F.max("grp")).first()[0] or 0) + 1
    while nodes > 1 or level == 0:
        level, nodes = level + 1, -(-nodes // fan_in)
        parent = F.floor(F.col("grp") / fan_in).alias("node")
        # bins of half the capacity or less that a node is given now, at most, and those that each node above may be given
        small = todo.where((~F.col("done")) & (2 * F.col("fill") <= capacity)).groupBy(parent).count().agg(F.max("count")).first()[0] or 0
        above, up = nodes, 0
        while above > 1:
            above, up = -(-above // fan_in), up + 1
        wanted = (~F.col("done")) & (F.col("spare") < small + fan_in * up)
        ready.append(todo.where(~wanted))
        todo = cut(todo.where(wanted).groupBy(parent).applyInArrow(_merge(capacity, slack, level, nodes == 1), BINS))
    out = todo
    for more in ready:
        out = out.unionByName(more)
    return out.select("sequence_id", "members").mapInArrow(_laid_out, PIECES)
