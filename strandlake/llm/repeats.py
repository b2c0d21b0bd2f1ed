"""Exact long repeats across documents, by a common-prefix interval tree over an enhanced suffix array.

Two equal strings of `least` bytes choose the same anchor in them: the k-gram of least hash. So suffixes are taken at anchors only,
and suffixes meet in a bucket per k-gram, where a suffix array with common prefix lengths is scanned with a stack. Each interval of
the tree is a set of suffixes with a common prefix of r bytes; sorted by what stands before them, they are scanned again for sets
with a common left context of l bytes, whose next bytes to the left differ. Such a set that isn't inside one child of its interval
is a maximal repeat of l + r bytes with all its occurrences. What is removed is what these groups cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import complete, cut, drop_cut, slices

#: Bytes hashed at a time, interval members compared at a time, contexts gathered before whole buckets are scanned.
BYTES, MEMBERS, ROWS = 400_000, 400_000, 60_000
#: Parts into which the places of an anchor in a string are dealt, again and again, in crowded buckets.
PARTS = 4
ANCHORS = "doc long, h long, pos int, kh long, ctx long, rest short"
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hasher:
    """Hashes of any byte range of a block from running sums: a polynomial modulo 2**64 over a table drawn by rule."""

    def __init__(self):
        self.table = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
        self.n = 0

    def powers(self, n: int) -> None:
        if n > self.n:
            p = np.full(n, _ODD, np.uint64)
            q = np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
            p[0] = q[0] = 1
            self.p, self.q, self.n = np.cumprod(p), np.cumprod(q), n

    def sums(self, block: np.ndarray) -> np.ndarray:
        self.powers(len(block) + 1)
        return np.r_[np.zeros(1, np.uint64), np.cumsum(self.table[block] * self.p[: len(block)])]

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.q[start]


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over x[s : s + w] for every s, by doubling; short at the end."""
    n, size, out = len(x), 1, x
    while 2 * size <= w:
        out = np.concatenate([f(out[:-size], out[size:]), out[-size:]]) if n > size else out
        size *= 2
    gap = w - size
    return np.concatenate([f(out[:-gap], out[gap:]), out[-gap:]]) if gap and n > gap else out


def _anchors(rows: list[tuple], hasher: _Hasher, least: int, k: int) -> pa.RecordBatch:
    """Anchors of pieces of texts: doc, h, bytes, the place of the piece in its text, and where its own places begin and end in it."""
    doc_, h_, docs, base, low_, high_ = zip(*rows)
    lens = np.array([len(d) for d in docs], np.int64)
    block = np.frombuffer(b"".join(docs), np.uint8)
    starts = np.cumsum(lens) - lens
    n, w = len(block), least - k + 1
    sums = hasher.sums(block)
    first, last = np.repeat(starts, lens), np.repeat(starts + lens, lens)
    at = np.arange(n)
    gram = np.full(n, np.iinfo(np.uint64).max)
    if n >= k:
        gram[: n - k + 1] = _mix((sums[k:] - sums[: n - k + 1]) * hasher.q[: n - k + 1])
    gram[at + k > last] = np.iinfo(np.uint64).max
    low = _slide(gram, w, np.minimum)
    low[at + least > last] = 0
    # the highest of the lows of all windows over a place is its own hash just where it is an anchor of one
    pick = np.flatnonzero(_slide(low[::-1], w, np.maximum)[::-1] == gram)
    pick = pick[(gram[pick] != np.iinfo(np.uint64).max)]
    doc = np.searchsorted(starts, pick, "right") - 1
    pos = pick - first[pick]
    own = (pos >= np.array(low_)[doc]) & (pos < np.array(high_)[doc])
    pick, doc, pos = pick[own], doc[own], pos[own] + np.array(base, np.int64)[doc[own]]
    left, right = np.maximum(pick - (least - k), first[pick]), np.minimum(pick + least, last[pick])
    ctx = _mix(hasher.ranges(sums, left, pick) * np.uint64(3) + (pick - left).astype(np.uint64)) ^ _mix(hasher.ranges(sums, pick, right) + ((right - pick) << 32).astype(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(np.array(doc_, np.int64)[doc]), pa.array(np.array(h_, np.int64)[doc]), pa.array(pos.astype(np.int32)), pa.array(gram[pick].view(np.int64)), pa.array(ctx.view(np.int64)), pa.array((right - pick).astype(np.int16))], names=["doc", "h", "pos", "kh", "ctx", "rest"])


def _find_anchors(least: int, k: int, size: int = BYTES):
    """Long texts go piece by piece, each with `least` bytes around it, so that a worker holds so much of one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        rows, held = [], 0
        for batch in slices(batches):
            for doc, h, text in zip(batch.column("doc").to_pylist(), batch.column("h").to_pylist(), batch.column("text").cast(pa.binary())):
                whole = text.as_py() or b""
                for at in range(0, len(whole) if len(whole) >= least else 0, size):
                    base, end = max(0, at - least), min(len(whole), at + size)
                    rows.append((doc, h, whole[base : end + least], base, at - base, end - base))
                    held += len(rows[-1][2])
                    if held >= size:
                        yield _anchors(rows, hasher, least, k)
                        rows, held = [], 0
        if rows:
            yield _anchors(rows, hasher, least, k)

    return run


_CONTEXTS = "kh long, sub long, ctx long, before binary, after binary"


def _contexts(least: int, k: int):
    """before (the nearest byte first) and after of the anchors asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for text, wanted in zip(batch.column("text").cast(pa.binary()), batch.column("wanted").to_pylist()):
                doc = text.as_py()
                for x in wanted:
                    p = x["pos"]
                    for c, v in zip(out, (x["kh"], x["ctx"], doc[max(0, p - (least - k)) : p][::-1], doc[p : p + least])):
                        c.append(v)
            kh, ctx, before, after = (pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary())))
            yield pa.RecordBatch.from_arrays([kh, pa.array(np.zeros(len(kh), np.int64)), ctx, before, after], names=["kh", "sub", "ctx", "before", "after"])

    return run


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-width bytes and lengths."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lens = np.diff(offsets)
    out = np.zeros((len(column), max(width, 1)), np.uint8)
    row = np.repeat(np.arange(len(column)), lens)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)] = data[offsets[0] : offsets[-1]] if len(column) else 0
    return out, lens


def _common(m: np.ndarray, lens: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The common prefix lengths of rows a and b."""
    differ = m[a] != m[b]
    same = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    return np.minimum(same, np.minimum(lens[a], lens[b]))


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first, end, length of the common prefix intervals of an enhanced suffix array, by a stack scan.

    lcp[i] belongs to entries i - 1 and i and is negative where a bucket begins; lcp[0] is negative.
    """
    lo, hi, length, stack = [], [], [], []
    for i, l in enumerate([*lcp.tolist()[1:], -1], 1):
        begin = i - 1
        while stack and stack[-1][1] > l:
            begin, r = stack.pop()
            lo.append(begin)
            hi.append(i)
            length.append(r)
        if l >= 0 and (not stack or stack[-1][1] < l):
            stack.append((begin, l))
    return np.array(lo, np.int64), np.array(hi, np.int64), np.array(length, np.int64)


def maximal_repeats(bucket: np.ndarray, before: tuple, after: tuple, least: int) -> Iterator[tuple]:
    """The maximal repeats of `least` bytes or more around the anchors of each bucket: members, and begin, left, right per group.

    members: entries, group by group; begin: where each group begins in members. left and right: bytes that its members share
    to the left and from the anchor on. before: bytes to the left, nearest first, and their lengths; after: bytes from the
    anchor on. A group is as long as its context goes: longer repeats show as groups of one anchor after the other.
    """
    n = len(bucket)
    key = np.ascontiguousarray(np.concatenate([bucket.astype(">u4").view(np.uint8).reshape(n, 4), after[0]], 1))
    order = np.argsort(key.view(f"S{key.shape[1]}").ravel(), kind="stable")
    lcp = np.r_[-1, _common(*after, order[:-1], order[1:])] if n else np.zeros(0, np.int64)
    lcp[1:][bucket[order][1:] != bucket[order][:-1]] = -1
    lo, hi, length = intervals(lcp)
    # entries by what is before them, for all buckets at once
    by_left = np.empty(n, np.int64)
    by_left[np.argsort(np.ascontiguousarray(before[0]).view(f"S{before[0].shape[1]}").ravel(), kind="stable")] = np.arange(n)
    size = hi - lo
    ends = np.searchsorted(np.cumsum(size), np.arange(MEMBERS, size.sum() + MEMBERS, MEMBERS)) + 1 if len(size) else []
    for a, b in zip(np.r_[0, ends[:-1]].astype(int) if len(ends) else [], ends):
        s, r = size[a:b], length[a:b]
        node = np.repeat(np.arange(len(s)), s)
        place = np.repeat(lo[a:b], s) + np.arange(len(node)) - np.repeat(np.cumsum(s) - s, s)
        child = np.cumsum(lcp[place] <= r[node])  # the first place of each child has no more in common with the one before it
        at = np.lexsort((by_left[order[place]], node))
        node, child, member = node[at], child[at], order[place[at]]
        same = _common(*before, member[:-1], member[1:])
        same[(node[1:] != node[:-1]) | (same + r[node[1:]] < least)] = -1
        begin, end, left = intervals(np.r_[-1, same])
        if not len(begin):
            continue
        pairs = np.stack([begin, end], 1).ravel()
        diverse = np.maximum.reduceat(np.r_[child, 0], pairs)[::2] != np.minimum.reduceat(np.r_[child, 0], pairs)[::2]
        begin, end, left = begin[diverse], end[diverse], left[diverse]
        count = end - begin
        starts = np.cumsum(count) - count
        yield member[np.repeat(begin - starts, count) + np.arange(count.sum())], starts, left, r[node[begin]]


def extents(bucket: np.ndarray, before: tuple, after: tuple, least: int) -> tuple[np.ndarray, np.ndarray]:
    """How far left and right of its anchor each entry is covered by the maximal repeats that it is an occurrence of."""
    left, right = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
    for member, begin, l, r in maximal_repeats(bucket, before, after, least):
        count = np.diff(np.r_[begin, len(member)])
        np.maximum.at(left, member, np.repeat(l, count))
        np.maximum.at(right, member, np.repeat(r, count))
    return left, right


def _names(parts: list[tuple[bytes, bytes]], hasher: _Hasher, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of repeats by their bytes (before, nearest first, and after the anchor), and whether the anchor is one of theirs.

    An anchor that a repeat alone has too is there in each place of it, so the group is complete. Others belong to longer strings.
    """
    from xxhash import xxh3_128_digest

    texts = [before[::-1] + after for before, after in parts]
    names = np.array([np.frombuffer(xxh3_128_digest(t), np.int64) for t in texts], np.int64).reshape(-1, 2)
    own = np.zeros(len(texts), bool)
    for at in range(0, len(texts), 1000):
        found = _anchors([(i, 0, t, 0, 0, len(t)) for i, t in enumerate(texts[at : at + 1000], at)], hasher, least, k)
        doc = found.column("doc").to_numpy()
        own[doc[found.column("pos").to_numpy() == np.array([len(b) for b, _ in parts])[doc]]] = True
    return names, own


_EXTENTS, _MEMBERS = "kh long, ctx long, left int, right int", "g1 long, g2 long, kh long, ctx long, left int, right int"


def _scan(least: int, k: int, groups: bool):
    """What covers each entry, or with groups the groups and their members, of buckets that arrive sorted by kh and sub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for t in complete(batches, ["kh", "sub"], ROWS):
            kh, sub, ctx = (t.column(c).to_numpy() for c in ("kh", "sub", "ctx"))
            bucket = np.cumsum(np.r_[0, (kh[1:] != kh[:-1]) | (sub[1:] != sub[:-1])])
            texts = [t.column(c).combine_chunks() for c in ("before", "after")]
            texts = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in texts]
            before, after = _matrix(texts[0], least - k), _matrix(texts[1], least)
            if not groups:
                left, right = extents(bucket, before, after, least)
                ok = right > 0
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kh[ok], ctx[ok], left[ok].astype(np.int32), right[ok].astype(np.int32))], names=["kh", "ctx", "left", "right"])
                continue
            for member, begin, l, r in maximal_repeats(bucket, before, after, least):
                count = np.diff(np.r_[begin, len(member)])
                names, own = _names([(before[0][m, :x].tobytes(), after[0][m, :y].tobytes()) for m, x, y in zip(member[begin].tolist(), l.tolist(), r.tolist())], hasher, least, k)
                own = np.repeat(own, count)
                columns = (np.repeat(names[:, 0], count), np.repeat(names[:, 1], count), kh[member], ctx[member], np.repeat(l, count).astype(np.int32), np.repeat(r, count).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in columns], names=["g1", "g2", "kh", "ctx", "left", "right"])

    return run


def _named(least: int, k: int):
    """Classes of anchors with all the surroundings that they have, as groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in slices(batches):
            parts = list(zip(*(batch.column(c).to_pylist() for c in ("before", "after"))))
            names, own = _names(parts, hasher, least, k)
            sizes = (pa.array([len(x[i]) for x in parts], pa.int32()) for i in (0, 1))
            out = pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), batch.column("kh"), batch.column("ctx"), *sizes], names=["g1", "g2", "kh", "ctx", "left", "right"])
            yield out.filter(pa.array(own))

    return run


def _scanned(contexts: DataFrame, least: int, k: int, groups: bool) -> DataFrame:
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(n, "kh", "sub").sortWithinPartitions("kh", "sub").mapInArrow(_scan(least, k, groups), _MEMBERS if groups else _EXTENTS)


def _crowded(contexts: DataFrame, least: int, k: int, crowd: int, groups: bool) -> list[DataFrame]:
    """The same for crowded buckets, dealt anew until none is crowded.

    Where two entries share a string, the anchor has one place in it. Places are dealt into ranges, and for each range entries
    meet that share what all strings with the anchor in that range have; ranges of crowded buckets are dealt again. A range
    of one place asks for all bytes of the string, so its buckets are counted and need no scan.
    """
    todo = cut(contexts.withColumns({"lo": F.lit(0), "hi": F.lit(least - k + 1)}))
    out = []
    while not todo.isEmpty():
        width = F.ceil((F.col("hi") - F.col("lo")) / PARTS).cast("int")
        lo = F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, width)).alias("lo_")
        dealt = todo.select("kh", "ctx", "before", "after", "hi", width.alias("width"), lo).withColumn("hi", F.least("hi", F.col("lo_") + F.col("width"))).withColumnRenamed("lo_", "lo").drop("width")
        dealt = dealt.where((F.octet_length("before") >= F.col("lo")) & (F.octet_length("after") > least - F.col("hi")))
        left, right = F.substr("before", F.lit(1), F.col("lo")), F.substr("after", F.lit(1), F.lit(least + 1) - F.col("hi"))
        dealt = cut(dealt.withColumn("sub", F.xxhash64("kh", "lo", left, right)))
        many = cut(dealt.groupBy("kh", "sub").count().where(F.col("count") > crowd).select("kh", "sub"))
        calm = dealt.join(many, ["kh", "sub"], "left_anti")
        out.append(cut(_scanned(calm.select("kh", "sub", "ctx", "before", "after"), least, k, groups)))
        hot = dealt.join(many, ["kh", "sub"], "left_semi")
        exact = hot.where("hi - lo = 1").select("kh", "ctx", "lo", left.alias("before"), right.alias("after"))
        often = exact.groupBy("kh", "lo", "before", "after").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        met = exact.join(cut(often), ["kh", "lo", "before", "after"], "left_semi").select("kh", "ctx", "before", "after")
        if groups:
            out.append(cut(met.mapInArrow(_named(least, k), _MEMBERS)))
        else:
            out.append(cut(met.select("kh", "ctx", F.octet_length("before").alias("left"), F.octet_length("after").alias("right"))))
        before, todo = todo, cut(hot.where("hi - lo > 1").select("kh", "sub", "ctx", "before", "after", "lo", "hi"))
        drop_cut(before, dealt, many)
    return out


def _covered(own: DataFrame, least: int, k: int, crowd: int, piece: int, groups: bool) -> tuple[DataFrame, DataFrame]:
    """The anchors that share their k-gram with others, and what covers each class (kh, ctx) of them, or the groups of classes.

    own: doc, h, text. A class of anchors with the same surroundings is one entry of its bucket, so copies cost one entry.
    """
    anchors = cut(own.mapInArrow(_find_anchors(least, k, piece), ANCHORS))
    # written first, so that both sides of the join are plain shuffles, whose crowded partitions can be split
    often = cut(anchors.groupBy("kh").agg(F.count("*").alias("n")).where("n > 1").select("kh"))
    shared = cut(anchors.join(often, "kh", "left_semi"))
    drop_cut(anchors, often)
    classes = cut(shared.groupBy("kh", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc", "h", "pos")).alias("rep"), F.first("rest").alias("rest")))
    kinds = cut(classes.groupBy("kh").agg(F.count("*").alias("kinds")).where("kinds > 1"))

    def contexts(asked: DataFrame) -> DataFrame:
        wanted = asked.select("rep.doc", "rep.h", F.struct(F.col("rep.pos").alias("pos"), "kh", "ctx").alias("x")).groupBy("doc", "h").agg(F.collect_list("x").alias("wanted"))
        return own.join(wanted, ["doc", "h"]).dropDuplicates(["doc", "h"]).mapInArrow(_contexts(least, k), _CONTEXTS)

    met = contexts(classes.join(kinds, "kh"))
    hot = cut(kinds.where(F.col("kinds") > crowd).select("kh"))
    if hot.isEmpty():
        parts = [_scanned(met, least, k, groups)]
    else:  # both kinds of buckets come from one pass over the texts
        met = cut(met)
        parts = [cut(_scanned(met.join(hot, "kh", "left_anti"), least, k, groups)), *_crowded(met.join(hot, "kh", "left_semi"), least, k, crowd, groups)]
        drop_cut(met)
    reach = F.least(F.col("rep.pos"), F.lit(least - k))
    twice = classes.where((F.col("n") > 1) & (reach + F.col("rest") >= least))
    parts.append(contexts(twice).mapInArrow(_named(least, k), _MEMBERS) if groups else twice.select("kh", "ctx", reach.alias("left"), F.col("rest").cast("int").alias("right")))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return shared, found


def _own(docs: DataFrame) -> DataFrame:
    """doc_id, doc and h, which name a row (by its id, or a hash of its text where that is null, and another hash), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), "text")).alias("doc"), F.xxhash64("text").alias("h"), "text")


def repeat_groups(docs: DataFrame, least: int = 200, k: int = 48, crowd: int = 30_000, piece: int = BYTES) -> DataFrame:
    """repeat (hex, by its bytes), length (bytes), doc_id, start: all occurrences of the maximal repeats of docs.

    A repeat is a string of `least` bytes or more that starts in several places and can't be made longer on either side without
    losing one of them. Context goes least - k bytes to the left and `least` bytes to the right of an anchor: repeats longer than
    that show as groups that overlap, one anchor after the other. Buckets with over `crowd` kinds of surroundings are dealt
    anew; what stays crowded to the end shows as groups of exactly `least` bytes. Rows as in remove_repeats().
    """
    own = _own(docs)
    shared, found = _covered(own.select("doc", "h", "text"), least, k, crowd, piece, True)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), "text")).alias("doc"), F.xxhash64("text").alias("h"))
    places = shared.join(cut(found), ["kh", "ctx"]).select("g1", "g2", (F.col("left") + F.col("right")).alias("length"), "doc", "h", (F.col("pos") - F.col("left")).cast("long").alias("start")).distinct()
    name = F.lower(F.concat(F.lpad(F.hex("g1"), 16, "0"), F.lpad(F.hex("g2"), 16, "0")))
    return places.join(ids, ["doc", "h"]).select(name.alias("repeat"), "length", "doc_id", "start")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: list[list] = [[], [], [], []]
        for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans").to_pylist()):
            doc = text.as_py() or b""
            keep, at, gone, runs = [], 0, 0, 0
            for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                if s > at or not runs:
                    keep.append(doc[at:s])
                    runs, at, gone = runs + 1, e, gone + e - s
                elif e > at:
                    gone, at = gone + e - at, e
            keep.append(doc[at:])
            for c, v in zip(out, (len(doc), gone, runs, b"".join(keep))):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, least: int = 200, k: int = 48, crowd: int = 30_000, piece: int = BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row of docs.

    Goes each byte covered by a string of `least` bytes that also starts anywhere else in the input, the same document
    included: all that the groups of repeat_groups() cover. Matches never cross documents and are judged on the input. Null
    texts are empty; texts under `least` bytes stay whole; repeated rows are copies of each other, so they go; a null doc_id
    is kept; no rows give none; other columns are ignored. k: bytes of an anchor. crowd: kinds of surroundings in a bucket
    from which it is dealt anew, which loses nothing. piece: bytes of a long text that are worked on at a time.
    """
    own = _own(docs)
    shared, found = _covered(own.select("doc", "h", "text"), least, k, crowd, piece, False)
    known = cut(found.groupBy("kh", "ctx").agg(F.max("left").alias("left"), F.max("right").alias("right")))
    spans = shared.join(known, ["kh", "ctx"]).select("doc", "h", F.struct((F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end")).alias("s"))
    rows = own.join(spans.groupBy("doc", "h").agg(F.collect_list("s").alias("spans")), ["doc", "h"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
