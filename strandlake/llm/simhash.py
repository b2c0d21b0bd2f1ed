"""SimHash near-duplicates: fingerprints, their Gray-order hierarchical index over ranges of rank, and the components it joins."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut, drop_cut, slices, tidy
from strandlake.llm.graph import components
from strandlake.llm.gray_index import Tree, forest, search

#: Shingles hashed at a time; fingerprints of a group, and groups of a pack; tasks that fingerprints are dealt to at most.
BLOCK, GROUP, TASKS = 1_000_000, 8_192, 20_000


def shingle_hashes(w: list[bytes], words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all shingles, repeats included, in blocks; fewer words than a shingle are one, no words none."""
    from xxhash import xxh64_intdigest

    for at in range(0, max(1, len(w) - words + 1) if w else 0, BLOCK):
        part = w[at : at + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
        yield np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64)


def ascii_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, words: int) -> int:
    """Bits that more than half of the hashes of the text's word shingles have; no words: zero."""
    n, bits = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(ascii_words(text), words):
        n += len(h)
        bits += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp (long) of every row of docs; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = (fingerprint(t.as_py(), words) for t in batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _rank(fp: Column) -> Column:
    """Gray rank, shifted so that signed longs sort like it."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _packed(group: int):
    """A partition's fingerprints, which come in Gray order, as groups of one size: number, prints, and the bits that all and any of them have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fps = [b.column("fp").to_numpy() for b in batches]
        fps = np.concatenate(fps) if fps else np.zeros(0, np.int64)
        for k, at in enumerate(range(0, len(fps), group)):
            own = fps[at : at + group]
            both = [pa.array([f.reduce(own)], pa.int64()) for f in (np.bitwise_and, np.bitwise_or)]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | k], pa.int64()), pa.array([own.tobytes()], pa.binary()), *both], names=["g", "fps", "common", "any"])

    return run


HEADS = ["g", "common", "any"]


def _packs(size: int):
    """A partition's heads of groups, in order, as packs: number, heads, and the bits that all and any of what they stand for have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = list(batches)
        if not parts:
            return
        g, common, any_ = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in HEADS)
        for k, at in enumerate(range(0, len(g), size)):
            own = [x[at : at + size] for x in (g, common, any_)]
            row = [[TaskContext.get().partitionId() << 32 | k], *([x.tobytes()] for x in own), [np.bitwise_and.reduce(own[1])], [np.bitwise_or.reduce(own[2])]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["g", "gs", "commons", "anys", "common", "any"])

    return run


def _heads(gs, commons, anys, most: int) -> tuple[np.ndarray, Tree]:
    tree = Tree((commons.view(np.uint64)[:, None], anys.view(np.uint64)[:, None]), np.full(len(gs), most))
    return gs[tree.order], tree


def _among(most: int):
    """u, v: groups whose heads can be within `most` bits, each with itself too, of all heads of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            ids, tree = _heads(*(np.concatenate([b.column(c).to_numpy() for b in parts]) for c in HEADS), most)
            for u, v in search(tree, scale=2, selves=True):
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])

    return run


def _between_packs(most: int):
    """u, v: the same of the heads of two packs, or of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda batch, i, side: _heads(*(np.frombuffer(batch.column(f"{side}_{c}")[i].as_py(), np.int64) for c in ("gs", "commons", "anys")), most)
        for batch in batches:
            for i, (u, v) in enumerate(zip(batch.column("u").to_pylist(), batch.column("v").to_pylist())):
                ids, tree = read(batch, i, "u")
                others, other = (ids, None) if u == v else read(batch, i, "v")
                for x, y in search(tree, other, scale=2, selves=True):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(others[y])], names=["u", "v"])

    return run


def _meeting(heads: DataFrame, most: int, size: int) -> DataFrame:
    """u, v of the groups (g, common, any) that may hold links: one task's work for `size` groups, packs of them meeting likewise beyond."""
    n = heads.count()
    if n <= size:
        return heads.coalesce(1).mapInArrow(_among(most), "u long, v long")
    ordered = heads.repartitionByRange(min(TASKS, -(-n // size)), "g").sortWithinPartitions("g")
    packs = cut(ordered.mapInArrow(_packs(size), "g long, gs binary, commons binary, anys binary, common long, any long"))
    met = cut(_meeting(packs.select(*HEADS), most, size)).repartition(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for side in ("u", "v"):
        met = met.join(packs.select(F.col("g").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("gs", "commons", "anys"))), side)
    return met.mapInArrow(_between_packs(most), "u long, v long")


def _prints(blob: pa.Scalar) -> np.ndarray:
    return np.frombuffer(blob.as_py(), np.uint64)[:, None]


def _between(most: int):
    """Forests over the prints of two groups, or of one with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, v, x, y in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("x"), batch.column("y")):
                x, y = _prints(x), _prints(y)
                a = Tree(x, np.full(len(x), most))
                if u == v:
                    at, low = forest(len(x), search(a, scale=2))
                    names = x[a.order, 0]
                else:
                    b = Tree(y, np.full(len(y), most))
                    at, low = forest(len(x) + len(y), ((i, len(x) + j) for i, j in search(a, b, scale=2)))
                    names = np.concatenate([x[a.order, 0], y[b.order, 0]])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(names[at].view(np.int64)), pa.array(names[low].view(np.int64))], names=["a", "b"])
        tidy()

    return run


def near_links(fps: DataFrame, most: int, group: int = GROUP, pack: int = GROUP) -> DataFrame:
    """A forest (a, b) over distinct fingerprints (fp, long) that joins all that links of `most` differing bits or fewer join.

    Ranges of Gray rank are the lowest groups of the index that are apart: `group` fingerprints each, however many there are. The
    index above them, with two words for each, is searched by tasks too, in packs of `pack` groups (2 or more) and packs of packs; pairs of
    groups that are left meet in a task, which searches on down both. A fingerprint has at most so many others at `most` bits,
    however many copies it stands for, so no bucket can be crowded.
    """
    spark = fps.sparkSession
    parts = min(TASKS, max(1, -(-fps.count() // group)))
    ranged = fps.select("fp", _rank(F.col("fp")).alias("rank")).repartitionByRange(parts, "rank").sortWithinPartitions("rank").select("fp")
    groups = cut(ranged.mapInArrow(_packed(group), "g long, fps binary, common long, any long"))
    pairs = cut(_meeting(groups.select(*HEADS), most, max(2, pack)))
    met = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    for side, prints in (("u", "x"), ("v", "y")):
        met = met.join(groups.select(F.col("g").alias(side), F.col("fps").alias(prints)), side)
    return met.select("u", "v", "x", "y").mapInArrow(_between(most), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 2, group: int = GROUP) -> DataFrame:
    """doc_id, fp, component_id: documents whose fingerprints are joined by links of `most` differing bits or fewer.

    docs: doc_id, text. component_id is the smallest doc_id reachable, over null ids, which it never is unless all are null.
    Null and empty texts have fingerprint zero and link like any other; a text of fewer words than a shingle is one shingle.
    Repeated rows give repeated rows. No rows give none. Copies meet as one fingerprint, so their number costs no pairs.
    """
    own = cut(fingerprints(docs, words))
    entries = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(entries.select("fp"), most, group)).withColumnRenamed("node", "fp")
    named = entries.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    # written first, so that the join's sides are plain shuffles and a crowded fingerprint's documents can be split
    found = cut(named.join(least, "root").select("fp", "component_id"))
    drop_cut(entries)
    return own.join(found, "fp").select("doc_id", "fp", "component_id")
