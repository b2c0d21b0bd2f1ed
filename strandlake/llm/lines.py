"""Incremental, reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

A batch of documents is probed against the filters of the shards. Keys that a filter has never seen are fresh: their exact
rows need no merge with earlier batches. Keys that a filter may have seen are merged with what the tables hold. Deleting
documents lowers the counts, elects new owners from the postings that are left, and builds the filters of shards with keys
that nobody holds any more anew from the exact table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import ascii_lower, cut, fresh, slices

SPACE = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id: one document, after all others.
NO_ID = (1 << 63) - 1
SLOTS, ROUNDS, LOAD, LEAST_BUCKETS = 4, 400, 0.8, 64
KEY = ["shard", "k1", "k2"]


class Cuckoo:
    """16-bit fingerprints in buckets of four; a full table gets a larger one beside it. All operations are vectorised."""

    def __init__(self, blob: bytes | None = None):
        self.tables: list[np.ndarray] = []
        at = 0
        while blob and at < len(blob):
            n = int.from_bytes(blob[at : at + 8], "little")
            self.tables.append(np.frombuffer(blob, np.uint16, n * SLOTS, at + 8).reshape(n, SLOTS).copy())
            at += 8 + 2 * n * SLOTS

    def blob(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t in self.tables)

    @staticmethod
    def _other(at: np.ndarray, mark: np.ndarray, n: int) -> np.ndarray:
        return at ^ ((mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) & np.uint64(n - 1)).astype(np.int64)

    @staticmethod
    def _places(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return (h & np.uint64(n - 1)).astype(np.int64), ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def contains(self, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), bool)
        for t in self.tables:
            at, mark = self._places(h, len(t))
            found |= (t[at] == mark[:, None]).any(1) | (t[self._other(at, mark, len(t))] == mark[:, None]).any(1)
        return found

    def _fill(self, t: np.ndarray, at: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place what has room in its bucket; the rest comes back."""
        order = np.argsort(at, kind="stable")
        at, mark = at[order], mark[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        free = t[at] == 0
        fits = rank < free.sum(1)
        slot = (np.cumsum(free, 1) == (rank + 1)[:, None]).argmax(1)
        t[at[fits], slot[fits]] = mark[fits]
        return at[~fits], mark[~fits]

    def add(self, h: np.ndarray) -> None:
        """One entry for each hash, repeats included."""
        if not len(h):
            return
        need = 1 << int(np.ceil(np.log2(max(LEAST_BUCKETS, len(h) / SLOTS / LOAD))))
        if not self.tables or (self.tables[-1] != 0).sum() + len(h) > LOAD * self.tables[-1].size:
            self.tables.append(np.zeros((max(need, 2 * len(self.tables[-1]) if self.tables else 0), SLOTS), np.uint16))
        t = self.tables[-1]
        at, mark = self._places(h, len(t))
        for k in range(ROUNDS):
            at, mark = self._fill(t, at, mark)
            if not len(at):
                return
            at, mark = self._fill(t, self._other(at, mark, len(t)), mark)
            if not len(at):
                return
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            out = t[at[first], k % SLOTS].copy()
            t[at[first], k % SLOTS] = mark[first]
            mark[first] = out
            at[first] = self._other(at[first], out, len(t))
        # what found no place is known by bucket and mark only, so it goes to a spare table of the same size
        self.tables.append(spare := np.zeros((len(t), SLOTS), np.uint16))
        while True:
            at, mark = self._fill(spare, at, mark)
            if not len(at):
                return
            self.tables.append(spare := np.zeros((len(t), SLOTS), np.uint16))

    def remove(self, h: np.ndarray) -> None:
        """Take out one entry for each hash that is in."""
        for t in self.tables:
            at, mark = self._places(h, len(t))
            left = np.ones(len(h), bool)
            for place in (at, self._other(at, mark, len(t))):
                while True:
                    todo = np.flatnonzero(left & (t[place] == mark[:, None]).any(1))
                    if not len(todo):
                        break
                    _, once = np.unique(place[todo], return_index=True)
                    todo = todo[once]
                    t[place[todo], (t[place[todo]] == mark[todo, None]).argmax(1)] = 0
                    left[todo] = False
            h = h[left]


@dataclass(frozen=True)
class LineState:
    """postings: doc, row, idx, key. segments: by batch, a row per key with refs (lines), first and last doc, seen. filters: shard, blob."""

    shards: int
    postings: tuple[DataFrame, ...] = ()
    segments: tuple[DataFrame, ...] = ()
    filters: DataFrame | None = None


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def line_keys(docs: DataFrame, shards: int, least: int) -> DataFrame:
    """doc, row (a hash of the text), idx, shard, k1, k2 for every line whose key has `least` code points or more."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("row"), "text")  # hashed before lines are rows
    lines = own.select("doc", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("idx", "line"))
    key = ascii_lower(F.btrim("line", F.lit(SPACE)))
    keyed = lines.select("doc", "row", "idx", key.alias("key")).where(F.char_length("key") >= least)
    keyed = keyed.select("doc", "row", "idx", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))
    return keyed.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy(*KEY).agg(F.count("*").alias("refs"), F.min("doc").alias("first"), F.max("doc").alias("last"))


_PROBED = "shard int, k1 long, k2 long, refs long, first long, last long, seen boolean, blob binary"


def _probe(key: tuple, batch: pa.Table, held: pa.Table) -> pa.Table:
    """Ask the shard's filter for every key of the batch, enter the fresh ones, and hand the filter on."""
    cuckoo = Cuckoo(held.column("blob")[0].as_py() if held.num_rows else None)
    h = batch.column("k2").to_numpy().view(np.uint64)
    seen = cuckoo.contains(h)
    cuckoo.add(h[~seen])
    out = batch.select(["shard", "k1", "k2", "refs", "first", "last"]).append_column("seen", pa.array(seen)).append_column("blob", pa.nulls(len(h), pa.binary()))
    return pa.concat_tables([out, pa.table({**{f.name: pa.nulls(1, f.type) for f in out.schema}, "shard": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([cuckoo.blob()], pa.binary())}, schema=out.schema)])


def _emptied(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
    """Take the entries of gone keys out of a shard's filter; keys that leaned on another's mark get an entry once it has gone.

    Rows with k1 are the keys that have one now, the row without is the filter.
    """
    cuckoo = Cuckoo(held.column("blob")[0].as_py() if held.num_rows else None)
    h, gone, own = asked.column("k2").to_numpy().view(np.uint64), asked.column("gone").to_numpy(), asked.column("own").to_numpy()
    cuckoo.remove(h[gone & own])
    leaning = np.flatnonzero(~gone & ~own)
    bare = leaning[~cuckoo.contains(h[leaning])] if len(leaning) else leaning
    cuckoo.add(h[bare])
    rows = asked.select(["shard", "k1", "k2"]).take(pa.array(bare)).append_column("blob", pa.nulls(len(bare), pa.binary()))
    last = {"shard": pa.array([key[0].as_py()], pa.int32()), "k1": pa.nulls(1, pa.int64()), "k2": pa.nulls(1, pa.int64()), "blob": pa.array([cuckoo.blob()], pa.binary())}
    return pa.concat_tables([rows.cast(pa.table(last).schema), pa.table(last)])


def _no_filters(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "shard int, blob binary")


def insert(state: LineState, docs: DataFrame, least: int) -> LineState:
    """The state with these documents added; their ids must be new to it."""
    postings = cut(line_keys(docs, state.shards, least))
    held = state.filters or _no_filters(docs)
    probed = cut(_counted(postings).groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(_probe, _PROBED))
    filters = probed.where("k1 is null").select("shard", "blob")
    if state.filters is not None:
        filters = filters.union(state.filters.join(filters, "shard", "left_anti"))
    return LineState(state.shards, (*state.postings, postings), (*state.segments, probed.where("k1 is not null").drop("blob")), filters)


def references(state: LineState) -> DataFrame:
    """The exact table: shard, k1, k2, refs (lines), first, last (smallest and largest document) for every key held."""
    cols = [*KEY, "refs", "first", "last"]
    everything = _union(state.segments)
    if len(state.segments) == 1:
        return everything.select(*cols)
    later = _union(state.segments[1:]).where("seen").select(*KEY).distinct()
    merged = everything.join(later, KEY, "left_semi").groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.min("first").alias("first"), F.max("last").alias("last"))
    return everything.join(later, KEY, "left_anti").select(*cols).unionByName(merged)


def delete(state: LineState, doc_ids: DataFrame) -> LineState:
    """The state without the documents of doc_ids.doc_id, as if they had never been inserted.

    Only the shards of their lines are written again. Keys that no document holds any more leave their filter, by the entry that they
    made; a key that was taken for seen when it came made none, and gets one if the mark it leaned on has gone.
    """
    ids = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")).distinct()
    all_ = _union(state.postings)
    touched = cut(all_.join(ids, "doc", "left_semi").select(*KEY).distinct())
    shards = cut(touched.select("shard").distinct())
    near = lambda df: df.join(shards, "shard", "left_semi")
    rest = lambda df: df.join(shards, "shard", "left_anti")
    left = cut(near(all_).join(ids, "doc", "left_anti"))
    entries = near(_union(state.segments)).groupBy(*KEY).agg(F.max(~F.col("seen")).alias("own"))
    old = near(references(state)).join(entries, KEY)
    again = _counted(left.join(touched, KEY, "left_semi"))
    judged = cut(old.join(touched, KEY, "left_anti").unionByName(again.join(entries, KEY)))
    gone = touched.join(again, KEY, "left_anti").join(entries, KEY).select(*KEY, "own", F.lit(True).alias("gone"))
    asked = gone.unionByName(judged.where("NOT own").select(*KEY, "own", F.lit(False).alias("gone")))
    held = state.filters or _no_filters(doc_ids)
    emptied = cut(asked.groupBy("shard").cogroup(held.join(asked.select("shard").distinct(), "shard", "left_semi").groupBy("shard")).applyInArrow(_emptied, "shard int, k1 long, k2 long, blob binary"))
    entered = emptied.where("k1 IS NOT NULL").select(*KEY, F.lit(True).alias("now"))
    table = cut(judged.join(entered, KEY, "left").select(*KEY, "refs", "first", "last", (~(F.col("own") | F.coalesce("now", F.lit(False)))).alias("seen")))
    filters = emptied.where("k1 IS NULL").select("shard", "blob")
    filters = filters.unionByName(held.join(filters.select("shard"), "shard", "left_anti"))
    return LineState(state.shards, (*(rest(p) for p in state.postings), left), (*(rest(s) for s in state.segments), table), filters)


def dropped_lines(state: LineState) -> DataFrame:
    """doc, row and the places (ascending) of its lines that go: those whose key a document with a smaller id holds too."""
    # written first, so that the join's sides are plain shuffles and a crowded key's lines can be split
    shared = cut(references(state).where("first < last").select("k1", "k2", "first"))
    lost = _union(state.postings).join(shared, ["k1", "k2"]).where("doc != first")
    # rows that repeat a document repeat its places
    return lost.groupBy("doc", "row").agg(F.array_sort(F.collect_set("idx")).alias("drops"))


def _cleaned(drops_name: str, measures: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines, dropped, texts = [], [], []
            for text, drops in zip(batch.column("text"), batch.column(drops_name).to_pylist()):
                own = (text.as_py() or "").split("\n")
                lines.append(len(own))
                if drops:
                    gone = set(drops)
                    own = [x for k, x in enumerate(own) if k not in gone]
                dropped.append(lines[-1] - len(own))
                texts.append("\n".join(own))
            at = batch.schema.get_field_index("text")
            kept = batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns([drops_name])
            for name, values in zip(measures, (lines, dropped)):
                kept = kept.append_column(name, pa.array(values, pa.int64()))
            yield kept

    return run


def dedup_lines(docs: DataFrame, least: int = 10, batches: int = 2, shard_lines: int = 400_000, measures: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text without repeated lines, and two measures: lines before and lines dropped (long).

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of `least` code points or more that two
    documents hold lose their lines in all but the smallest doc_id. Null and empty texts are one empty line (and come back
    empty); a null doc_id counts as one document after all others; rows of one doc_id are one document, whose rows each lose
    their own lines; no rows give none; other columns pass through, but for such as have the names of the measures.
    batches: parts in which documents are inserted, each probed against the filters that the others left. shard_lines:
    lines of the input to a shard, about, which bounds what one task holds; keys are counted before they are dealt out.
    """
    docs = docs.drop(*measures)
    doc, row, drops_name = fresh(docs, "doc", "row", "drops")
    rough = docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    state = LineState(max(8, int(rough) // shard_lines))
    for k in range(batches):
        state = insert(state, docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), least)
    drops = dropped_lines(state).select(F.nullif("doc", F.lit(NO_ID)).alias(doc), F.col("row").alias(row), F.col("drops").alias(drops_name))
    rows = docs.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(row)), "left").drop(doc, row)
    kept = [f for f in rows.schema if f.name != drops_name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(_cleaned(drops_name, measures), f"{schema}, `{measures[0]}` long, `{measures[1]}` long")
