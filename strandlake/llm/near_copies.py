"""Near copies by SimHash fingerprints, and by exact resemblance of shingle sets for what these don't join.

Fingerprints are linked first, by the index of llm.simhash. A resemblance of 0.8 leaves about ten differing bits in a print, too
many for any index of prints alone, so such links are found by a second index, of parity prints; it asks for no pair that
fingerprints joined.

A shingle is a code: a hash of its words. Codes that one text alone has come first in the order that all texts share, then the
others from rare to common. Two texts that resemble each other have a code of both prefixes in common, and a text that has more
codes of its own than its prefix is long resembles no other. In the bucket of a prefix code texts are indexed by parity prints
of the codes that they share with any others, which tell when two must differ in too much; what is left is compared code by code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import complete, cut, drop_cut, fresh, slices, tidy
from strandlake.llm.graph import components
from strandlake.llm.gray_index import Tree, gray_rank, search
from strandlake.llm.simhash import ascii_words, fingerprint, near_links

#: Bits of a code below its part; bits of a text's place among those whose codes are sorted together.
LOW, PLACE = 32, 12
#: Codes sorted at a time, rows gathered before groups are worked on, bits of a parity print.
CODES, ROWS, PRINT = 1_000_000, 200_000, 1024
_WEIGHTS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)]


class _WordHashes(dict):
    def __missing__(self, w: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 200_000:
            self.clear()
        self[w] = h = xxh64_intdigest(w, 42)
        return h


_hashes = _WordHashes()


def shingle_codes(text: str | None, words: int, bits: int) -> np.ndarray:
    """The distinct codes of a text's shingles, sorted; a text of fewer words is one shingle, one of none has none."""
    w = ascii_words(text)
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    if not len(h):
        return h
    n = len(h) - min(words, len(h)) + 1
    x = np.zeros(n, np.uint64)
    for k in range(len(h) - n + 1):
        x += h[k : k + n] * np.uint64(_WEIGHTS[k % 64])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique((x ^ (x >> np.uint64(31))) >> np.uint64(64 - bits))


def prefix_length(n: int, least: int) -> int:
    """So many of a set's first members that two sets with a resemblance of `least` % or more share one of them, whatever the order."""
    return n - (least * n + 99) // 100 + 1 if n else 0


def parity(codes: np.ndarray) -> bytes:
    """Whether each residue has an odd number of these codes. No two sets differ in more bits than members."""
    return np.packbits((np.bincount((codes & np.uint64(PRINT - 1)).astype(np.int64), minlength=PRINT) & 1).astype(np.uint8)).tobytes()


def _common(docs: DataFrame, words: int, bits: int, of: int = 64, often: int = 3, top: int = 50_000) -> np.ndarray:
    """Codes that `often` or more of the sampled documents hold, the most frequent ones. They come last in the order, no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for t in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_codes(t.as_py(), words, bits).view(np.int64))], names=["s"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(of)) == 0).select("text")
    found = sample.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= often).orderBy(F.desc("count"), "s").limit(top)
    return np.sort(np.array([r.s for r in found.collect()], np.int64).view(np.uint64))


_CODED = pa.schema([("part", pa.int32()), ("base", pa.int64()), ("codes", pa.binary()), ("places", pa.binary()), ("eid", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("late", pa.list_(pa.int64()))])


def _coded(words: int, bits: int, late: np.ndarray, print_words: int | None):
    """A row per document, with its fingerprint if that is asked for, and rows per part of the codes with the sorted codes of many documents, the late ones left out."""

    def rows(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _CODED], schema=_CODED)

    def spread(base: int, codes: list[np.ndarray], places: list[int]) -> pa.RecordBatch:
        x = np.concatenate(codes) << np.uint64(PLACE) | np.repeat(np.array(places, np.uint64), [len(c) for c in codes])
        x.sort()
        parts = (x >> np.uint64(PLACE + LOW)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
        ends = np.r_[starts, len(x)]
        low, at = (x >> np.uint64(PLACE)).astype(np.uint32), (x & np.uint64((1 << PLACE) - 1)).astype(np.uint16)
        blobs = [pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * y.itemsize).astype(np.int32)), pa.py_buffer(y)]) for y in (low, at)]
        return rows({"part": pa.array(parts[starts].astype(np.int32)), "base": pa.array(np.full(len(starts), base)), "codes": blobs[0], "places": blobs[1]}, len(starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh3_128_digest

        base = eid = TaskContext.get().partitionId() << 38
        seen: set[bytes] = set()
        codes, places, size = [], [], 0
        for batch in slices(batches):
            out: dict[str, list] = {c: [] for c in ("eid", "k1", "k2", "n", "fp", "late")}
            for text in batch.column("text"):
                own = shingle_codes(text := text.as_py(), words, bits)
                fp = None if print_words is None else fingerprint(text, print_words)
                name = xxh3_128_digest(own.tobytes())
                is_late = late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own if len(late) else np.zeros(len(own), bool)
                for c, v in zip(out.values(), (eid, *np.frombuffer(name, np.int64).tolist(), len(own), fp, own[is_late].view(np.int64))):
                    c.append(v)
                if name not in seen:  # of copies in a task one is enough
                    seen.add(name)
                    if len(own := own[~is_late]):
                        codes.append(own)
                        places.append(eid - base)
                        size += len(own)
                eid += 1
                if size >= CODES or eid - base == 1 << PLACE:
                    if codes:
                        yield spread(base, codes, places)
                    codes, places, size, base = [], [], 0, eid
            columns = {c: pa.array(v, pa.list_(pa.int64()) if c == "late" else pa.int64()) for c, v in out.items()}
            yield rows(columns | {"doc_id": batch.column("doc_id"), "h": batch.column("h")}, batch.num_rows)
        if codes:
            yield spread(base, codes, places)
        _hashes.clear()
        tidy()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """eid, df, code: the codes that two or more documents of their part have, with how many do."""
    for t in complete(batches, ["part"], 64):
        part = np.asarray(t.column("part"))
        for at, end in _runs(part):
            rows = t.slice(at, end - at)
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint32).astype(np.uint64)
            places = rows.column("places").to_pylist()
            eids = np.repeat(rows.column("base").to_numpy(), [len(x) // 2 for x in places]) + np.frombuffer(b"".join(places), np.uint16)
            x = codes << np.uint64(32) | np.arange(len(codes), dtype=np.uint64)
            x.sort()
            codes, eids = x >> np.uint64(32), eids[(x & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            size = np.diff(np.r_[starts, len(codes)])
            df = np.repeat(size, size)
            keep = df > 1
            names = (np.uint64(part[at]) << np.uint64(LOW) | codes[keep]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(eids[keep]), pa.array(df[keep]), pa.array(names)], names=["eid", "df", "code"])


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return list(zip(starts.tolist(), np.r_[starts[1:], len(x)].tolist()))


_ALIVE = "node long, n long, allow long, prefix array<long>, codes array<long>, print binary"


def _alive(least: int):
    """Of rows sorted by eid (a document's own one, with df 0, and its shared codes) the documents that may resemble another.

    allow: an entry's share of what the shared codes of a pair may differ in, after what each has alone; times 100 + least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        for t in complete(batches, ["eid"], ROWS):
            eid, df, code, n = (t.column(c).to_numpy() for c in ("eid", "df", "code", "n"))
            code = code.view(np.uint64)
            own = np.flatnonzero(df == 0)
            lates = t.column("late").take(pa.array(own))
            order = np.lexsort((code, df, eid))
            # in this order a document's own row comes first, then its shared codes, the rarest first
            first = np.searchsorted(eid[order], eid[own])
            shared = np.searchsorted(eid[order], eid[own], "right") - first - 1
            n = n[own]
            alone = n - shared - np.diff(lates.combine_chunks().offsets.to_numpy())
            out: list[list] = [[] for _ in kinds]
            for k in np.flatnonzero((n > 0) & (alone < n - (least * n + 99) // 100 + 1)).tolist():
                mine = np.concatenate([code[order[first[k] + 1 : first[k] + 1 + shared[k]]], np.array(lates[k].as_py(), np.int64).view(np.uint64)])
                prefix = mine[: prefix_length(int(n[k]), least) - alone[k]].view(np.int64)
                for c, v in zip(out, (eid[own[k]], n[k], (100 - least) * n[k] - (100 + least) * alone[k], prefix, np.sort(mine).view(np.int64), parity(mine))):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], names=["node", "n", "allow", "prefix", "codes", "print"])

    return run


def _meet(least: int, crowd: int | None):
    """Pairs (a, b) that may be links and have different roots, in buckets that arrive sorted by code.

    Of a bucket over `crowd` only neighbours in Gray order are paired, and its members come back with the code, to meet again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a, b, code=None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()) if code is None else pa.array(code)], names=["a", "b", "code"])

        for t in complete(batches, ["code"], ROWS // 8):
            code, root, node, allow = (t.column(c).to_numpy() for c in ("code", "root", "node", "allow"))
            prints = np.frombuffer(b"".join(t.column("print").to_pylist()), np.uint64).reshape(len(code), -1)
            bucket = np.cumsum(np.r_[False, code[1:] != code[:-1]])
            size = np.bincount(bucket)[bucket]
            many = size > crowd if crowd else np.zeros(len(code), bool)
            found = []
            if many.any():
                at = np.flatnonzero(many)
                at = at[np.lexsort((*(gray_rank(prints[at, w]) for w in (2, 1, 0)), bucket[at]))]
                u, v = at[:-1], at[1:]
                near = (bucket[u] == bucket[v]) & (root[u] != root[v]) & ((100 + least) * np.bitwise_count(prints[u] ^ prints[v]).sum(1, dtype=np.int64) <= allow[u] + allow[v])
                found.append((u[near], v[near]))
                yield rows(node[at], node[at], code[at])
            at = np.flatnonzero(~many & (size > 1))
            tree = Tree(prints[at], allow[at], bucket[at], root[at])
            found += [(at[tree.order[u]], at[tree.order[v]]) for u, v in search(tree, scale=100 + least)]
            for u, v in found:
                both = np.unique(np.stack([np.minimum(node[u], node[v]), np.maximum(node[u], node[v])], 1), axis=0)
                yield rows(both[:, 0], both[:, 1])

    return run


def _met(rows: DataFrame, least: int, crowd: int | None) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.select("code", "root", "node", "allow", "print").repartition(n, "code").sortWithinPartitions("code")
    return cut(sorted_.mapInArrow(_meet(least, crowd), "a long, b long, code long"))


def printed(own: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Links (a, b) that join all nodes that fingerprints of `most` differing bits or fewer join.

    own: k1, k2, fp of every document; nodes: k1, k2, node. Documents of one node may have several fingerprints.
    """
    kinds = cut(own.select("k1", "k2", "fp").distinct())
    fps = cut(kinds.select("fp").distinct())
    roots = cut(components(near_links(fps, most)).withColumnRenamed("node", "fp"))
    placed = kinds.join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).join(roots, "fp", "left")
    placed = cut(placed.select("node", F.coalesce("root", "fp").alias("root")).distinct())
    least = cut(placed.groupBy("root").agg(F.min("node").alias("b")))
    links = cut(placed.join(least, "root").where("node != b").select(F.col("node").alias("a"), "b").distinct())
    drop_cut(kinds, fps, roots, placed, least)
    return links


def resembling(alive: DataFrame, least: int, crowd: int = 8, joined: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that join all nodes that pairs of a resemblance of `least` % or more, or links of `joined`, join.

    alive: node, n, allow, prefix, codes, print. Pairs that `joined` joins are not asked for. Every other such pair shares a code of both prefixes, so it meets in that code's bucket. In
    buckets over `crowd` first neighbours in Gray order are compared, then all pairs that these links haven't joined, so that
    many copies of one text cost few.
    """
    sets = alive.select("node", "n", "codes")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("a", "b").distinct()
        for e in "ab":
            pairs = pairs.join(sets.select(F.col("node").alias(e), F.col("n").alias(f"n_{e}"), F.col("codes").alias(f"codes_{e}")), e)
        both = F.size(F.array_intersect("codes_a", "codes_b"))  # a code that both have is shared, so it is in the lists
        return cut(pairs.where((100 + least) * both >= least * (F.col("n_a") + F.col("n_b"))).select("a", "b"))

    labelled = alive.withColumn("root", F.col("node"))
    if joined is not None:
        before = cut(components(joined))
        labelled = alive.join(before, "node", "left").withColumn("root", F.coalesce("root", "node"))
    routed = labelled.select(F.explode("prefix").alias("code"), "root", "node", "allow", "print")
    met = _met(routed, least, crowd)
    found = linked(met.where("code is null"))
    if joined is not None:
        found = found.unionByName(joined)
    again = met.where("code is not null").select("code", F.col("a").alias("node"))
    if again.isEmpty():
        return found
    roots = cut(components(found))
    again = cut(again.join(roots, "node", "left").select("code", "node", F.coalesce("root", "node").alias("root")))
    open_ = cut(again.groupBy("code").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("code"))
    rest = again.join(open_, "code", "left_semi").join(alive.select("node", "allow", "print"), "node")
    more = linked(_met(rest, least, None))
    drop_cut(met, roots, again, open_)
    return found.unionByName(more)


def similar_documents(docs: DataFrame, words: int = 5, least: int = 80, crowd: int = 8, prints: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, h (xxhash64 of the text), component_id: rows joined by links of a resemblance of `least` % or more.

    prints: words of a shingle and bits; rows whose SimHash fingerprints over such shingles differ in so many bits or fewer are
    linked too. Resemblance is that of the sets of shingles of `words` words. component_id is the smallest doc_id reachable, over null ids,
    which it never is unless all are null. Null and empty texts have no shingles and are one group; a text of fewer words than
    a shingle is one shingle; repeated rows give repeated rows; no rows give none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 1 << min(20, max(10, (4 * n - 1).bit_length()))
    bits = LOW + parts.bit_length() - 1
    late = _common(docs, words, bits)
    coded = cut(docs.mapInArrow(_coded(words, bits, late, prints and prints[0]), ", ".join(f"{f.name} {'array<long>' if f.name == 'late' else {'int32': 'int', 'int64': 'long', 'binary': 'binary'}[str(f.type)]}" for f in _CODED)))
    own = cut(coded.where("eid is not null").select("eid", "doc_id", "h", "k1", "k2", "n", "fp", "late"))
    nodes = cut(own.groupBy("k1", "k2").agg(F.min("eid").alias("node"), F.min("doc_id").alias("first"), F.min_by("n", "eid").alias("n"), F.min_by("late", "eid").alias("late")))
    blobs = coded.where("part is not null").select("part", "base", "codes", "places").repartition(n, "part").sortWithinPartitions("part")
    shared = blobs.mapInArrow(_shared, "eid long, df long, code long").select("eid", "df", "code", F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<long>").alias("late"))
    heads = nodes.select(F.col("node").alias("eid"), F.lit(0).cast("long").alias("df"), F.lit(0).cast("long").alias("code"), "n", "late")
    rows = shared.unionByName(heads).repartition(n, "eid").sortWithinPartitions("eid")
    alive = cut(rows.mapInArrow(_alive(least), _ALIVE))
    drop_cut(coded)
    roots = components(resembling(alive, least, crowd, printed(own, nodes, prints[1]) if prints else None))
    named = nodes.select("k1", "k2", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    # written first, so that the join's sides are plain shuffles and a crowded set's documents can be split
    found = cut(named.join(smallest, "root").select("k1", "k2", "component_id"))
    drop_cut(alive, nodes)
    return own.join(found, ["k1", "k2"]).select("doc_id", "h", "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group of similar_documents(): the smallest doc_id, with all columns.

    Rows that repeat it are the same document and stay. Rows without a doc_id can't stand for a group and stay only if no row
    of their group has one.
    """
    near = similar_documents(docs, **how)
    d, h = fresh(docs, "d", "h")
    goes = near.where("component_id is not null and (doc_id is null or doc_id != component_id)").select(F.col("doc_id").alias(d), F.col("h").alias(h)).distinct()
    return docs.join(cut(goes), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)), "left_anti")
