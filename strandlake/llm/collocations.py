"""Phrase collocations: frequent phrases found by extending positional inverted lists, scored by their weakest cut.

Texts are dealt to blocks, one per language, of some megabytes each. A block holds a list of ascending positions for each of
its words; a phrase's list holds where it starts. A phrase is extended by merging its list with the lists of what stands next to
its occurrences: the words that end a frequent phrase themselves. The lengths of a phrase's lists, summed over all blocks, are its
exact frequency. Blocks send those lengths only, a word's under its text and a longer phrase's under the numbers of its parts, and
get the numbers back of what is frequent over all blocks; the words of phrases are put together from their numbers at the end.

Null texts are empty, a null language is `und`, repeated rows count each, an empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import _remove, _run_dir, cut, drop_cut, slices, tidy

#: Bytes of text that a task gathers before it closes its blocks, and that are split into words at a time.
BLOCK, SLICE = 64 << 20, 1 << 20
#: Parts in which a language's phrases are ranked before its best ones are put together.
PARTS = 64
WORDS = "block long, lang string, words array<string>, n binary, at binary, total long"
LISTS = "block long, lang string, ids binary, n binary, at binary"
#: A list's number is (block << PLACE) | its place in the block; a block's is (task << MADE) | how many its task made before.
PLACE, MADE = 28, 15
#: What blocks send: lengths of lists by word, or by the numbers of a phrase without its last and without its first word.
WORD, PAIR = ["lang", "word"], ["first", "second"]
#: A-Z become small, the characters that end a piece one mark, and tabs spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,:!?\n\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz;;;;;;;;; ")


class _Numbers(dict):
    """Numbers for words in the order they are met; the mark between pieces is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def _stream(text: bytes, numbers: _Numbers) -> Iterator[np.ndarray]:
    """Numbers of a text's words, with a 0 wherever a piece ends."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        words = folded[at:end].replace(b";", b" ; ").split()
        yield np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        at = end
    yield np.zeros(1, np.int32)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as their differences, bytes of one rank together, compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return len(steps).to_bytes(8, "little") + pa.compress(steps.view(np.uint8).reshape(len(steps), -1).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(planes.reshape(width, n).T.copy().view(kind).ravel(), dtype=kind)


def _of(batch: pa.RecordBatch, i: int, name: str, kind: str) -> np.ndarray:
    return _unpacked(batch.column(name)[i].as_py(), kind)


def _longer(ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lists of the phrases one word longer: first and second part, lengths, positions by list.

    The lists are merged by position; what starts one place on is a frequent phrase too, and ends in the adjacent word.
    """
    which = np.repeat(np.arange(len(n), dtype=np.int32), n)
    order = np.argsort(at, kind="stable")
    at, which = at[order], which[order]
    next_to = np.flatnonzero(np.diff(at) == 1)
    key, at = which[next_to].astype(np.int64) * len(n) + which[next_to + 1], at[next_to]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    first, second = np.divmod(key[starts], max(len(n), 1))
    return ids[first], ids[second], np.diff(np.append(starts, len(key))).astype(np.int32), at


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word lists of the blocks of a partition."""
    held: dict[str, tuple[_Numbers, list]] = {}
    task, size, made = TaskContext.get().partitionId(), 0, 0

    def close():
        nonlocal made
        for lang, (numbers, parts) in held.items():
            stream = np.concatenate(parts)
            order = np.argsort(stream, kind="stable")
            n = np.bincount(stream, minlength=len(numbers)).astype(np.int32)
            if len(n) > 1:
                made += 1
                if made >> MADE:
                    raise ValueError(f"a partition of more than {1 << MADE} blocks")
                words = pa.array(list(numbers)[1:], pa.binary()).cast(pa.string())
                row = [task << MADE | made], [lang], pa.ListArray.from_arrays([0, len(words)], words), [_packed(n[1:])], [_packed(order[n[0] :].astype(np.int32))], [int(n[1:].sum())]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in row], names=["block", "lang", "words", "n", "at", "total"])
        held.clear()

    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if lang not in held:
                held[lang] = _Numbers({b";": 0}), []
            numbers, parts = held[lang]
            parts.extend(_stream(text, numbers))
            size += len(text)
            if size >= BLOCK:
                yield from close()
                size = 0
    yield from close()
    tidy()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    for batch in batches:
        yield from ((batch, i) for i in range(batch.num_rows))
    tidy()


def _places(block: int, n: np.ndarray) -> pa.Array:
    if len(n) >> PLACE or block >> (63 - PLACE):
        raise ValueError(f"more than {1 << PLACE} phrases of one length in a block, or {1 << (63 - PLACE - MADE)} partitions")
    return pa.array((block << PLACE) + np.arange(len(n), dtype=np.int64))


def _word_lengths(batches):
    """lang, word, u (its list's number), n of the words of blocks."""
    for batch, i in _rows(batches):
        words, n = batch.column("words")[i].values, _of(batch, i, "n", "<i4")
        lang = pa.array([batch.column("lang")[i].as_py()] * len(n), pa.string())
        yield pa.RecordBatch.from_arrays([lang, words, _places(batch.column("block")[i].as_py(), n), pa.array(n)], names=["lang", "word", "u", "n"])


def _pair_lengths(batches):
    """first, second, u, n of the phrases one word longer than those of blocks."""
    for batch, i in _rows(batches):
        first, second, n, _ = _longer(_of(batch, i, "ids", "<i8"), _of(batch, i, "n", "<i4"), _of(batch, i, "at", "<i4"))
        yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), _places(batch.column("block")[i].as_py(), n), pa.array(n)], names=["first", "second", "u", "n"])


def _kept(k: int):
    """LISTS of a block's phrases of k words that are frequent (kept: their places and ids), with those ids."""

    def run(batches):
        for batch, i in _rows(batches):
            kept = batch.column("kept")[i].values
            n, at = _of(batch, i, "n", "<i4"), _of(batch, i, "at", "<i4")
            if k > 1:
                _, _, n, at = _longer(_of(batch, i, "ids", "<i8"), n, at)
            ids = np.full(len(n), -1, np.int64)
            ids[kept.field("place").to_numpy()] = kept.field("id").to_numpy()
            keep = ids >= 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("block").slice(i, 1), batch.column("lang").slice(i, 1), *(pa.array([_packed(x)]) for x in (ids[keep], n[keep], at[np.repeat(keep, n)]))],
                names=["block", "lang", "ids", "n", "at"],
            )

    return run


def _frequent(lengths: DataFrame, key: list[str], least: int) -> DataFrame:
    """The rows of lengths whose key adds up to `least` or more, with that sum as a and the least number of the key's lists as id."""
    over = Window.partitionBy(*key)
    return lengths.select("*", F.sum("n").over(over).alias("a"), F.min("u").over(over).alias("id")).where(F.col("a") >= least).drop("n")


class _Held:
    """Lists as a table in buckets of blocks, so that joining what a block gets back doesn't move them."""

    def __init__(self, lists: DataFrame):
        self.spark, self.name = lists.sparkSession, f"strandlake_lists_{uuid.uuid4().hex}"
        self.path = f"{_run_dir(self.spark)}/{self.name}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        lists.write.bucketBy(buckets, "block").option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _remove(self.spark, self.path)


def frequent_phrases(docs: DataFrame, words: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, a) of the phrases of up to `words` words met `least` times or more, and (lang, n), the words of each language."""
    rows = docs.where("text IS NOT NULL").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    lists = _Held(rows.mapInArrow(_index, WORDS))
    totals = cut(lists.rows.groupBy("lang").agg(F.sum("total").alias("n")))
    found = []
    for k in range(1, words + 1):
        lengths = lists.rows.mapInArrow(_word_lengths, "lang string, word string, u long, n int") if k == 1 else lists.rows.mapInArrow(_pair_lengths, "first long, second long, u long, n int")
        often = cut(_frequent(lengths, WORD if k == 1 else PAIR, least))
        own = often.where("u = id")
        if k == 1:
            names = own.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a")
        else:
            first = names.select(F.col("id").alias("first"), "lang", "phrase")
            second = names.select(F.col("id").alias("second"), "last")
            names = own.select("id", "first", "second", "a").join(first, "first").join(second, "second").select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a")
        names = cut(names)
        found.append(names.select("lang", "phrase", F.lit(k).alias("k"), "a"))
        if k < words:
            place = F.col("u").bitwiseAND((1 << PLACE) - 1).cast("int")
            kept = often.groupBy(F.shiftright("u", PLACE).alias("block")).agg(F.collect_list(F.struct(place.alias("place"), "id")).alias("kept"))
            before, lists = lists, _Held(lists.rows.join(kept, "block").mapInArrow(_kept(k), LISTS))
            before.drop()
        drop_cut(often)
    lists.drop()
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return phrases, totals


def _count(c: str):
    """Exact products: counts below 10^16, so that 1000 a n has 36 digits at most."""
    return F.col(c).cast("decimal(16,0)")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of the phrases of two words or more, by the cut of the lowest score, of ties the first one."""
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    cuts = phrases.where("k > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("*", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    side = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    top, below = F.lit(1000).cast("decimal(4,0)") * (_count("a") * _count("n")), _count("l") * _count("r")
    cuts = cuts.withColumns({"top": top, "below": below}).withColumn("score", F.expr("top div below"))
    best = cuts.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "k", "a", "b.l", "b.r", "n", "b.score")


def whole(phrases: DataFrame) -> DataFrame:
    """(lang, phrase) of phrases that no longer one contains as often: one word more suffices, as counts only fall with length."""
    words = F.split("phrase", " ")
    longer = phrases.where("k > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))).alias("phrase"))
    return phrases.where("k > 1").join(longer, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase")


def collocations(docs: DataFrame, most: int = 2000, words: int = 5, least: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases by score, then frequency, then bytes."""
    phrases, totals = frequent_phrases(docs, words, least)
    found = scored(phrases, totals).join(whole(phrases), ["lang", "phrase"], "left_semi")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    ranked = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
