"""Seeded local alignment: seeds meet in an equi-join, chain along diagonals, extend without gaps, and are aligned with gaps in a band.

Scores are those of the common nucleotide search for close matches: 1 for a match, -2 for a mismatch, -2.5 a base of a gap. An exact
match of `word` characters is always found; what has none isn't looked for. References should be rows of moderate length: see pieces().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Twice the scores, and the statistics of these scores with gaps (Karlin and Altschul).
MATCH, MISMATCH, GAP = 2, -4, -5
LAMBDA, K = 1.28, 0.46
RESULT = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart bigint, send bigint, score double"


def pieces(references: DataFrame, size: int, overlap: int) -> DataFrame:
    """id, start, seq: references cut to pieces of `size` characters that overlap, so that a long one is many rows."""
    step = size - overlap
    if step < 1:
        raise ValueError("pieces have to be longer than their overlap")
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("seq") - 1 - overlap, F.lit(0)), F.lit(step))
    return references.where("seq IS NOT NULL AND seq != ''").select("id", "seq", F.explode(starts).alias("start")).select("id", "start", F.substr("seq", F.col("start") + 1, F.lit(size)).alias("seq"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def ungapped(q: np.ndarray, s: np.ndarray, at: int, diagonal: int, drop: int) -> int:
    """Twice the score of the stretch around q[at] on a diagonal, extended both ways until it falls `drop` below its best."""
    lo, hi = max(0, -diagonal), min(len(q), len(s) - diagonal)
    if not lo <= at < hi:
        return 0
    steps = np.where(q[lo:hi] == s[lo + diagonal : hi + diagonal], MATCH, MISMATCH)

    def best(part: np.ndarray) -> int:
        sums = np.cumsum(part)
        top = np.maximum.accumulate(np.maximum(sums, 0))
        fallen = np.flatnonzero(top - sums > drop)
        return int(top[fallen[0] if len(fallen) else -1]) if len(sums) else 0

    return best(steps[at - lo :]) + best(steps[: at - lo][::-1])


def banded(q: np.ndarray, s: np.ndarray, low: int, high: int) -> tuple[int, list[tuple[int, int]]]:
    """Twice the best local score over cells with low <= j - i <= high, and its aligned places (i, j), -1 in a gap."""
    width = high - low + 1
    # row i holds j = i + low + c for c in range(width): a diagonal step keeps c, a base of q alone takes c + 1 of the row above
    h = np.zeros((len(q) + 1, width + 1), np.int32)
    offset = -GAP * np.arange(width, dtype=np.int32)
    columns = np.arange(width) + low
    for i in range(1, len(q) + 1):
        j = columns + i
        inside = (j >= 1) & (j <= len(s))
        same = np.where(inside, s[np.clip(j - 1, 0, max(len(s) - 1, 0))] == q[i - 1], False)
        row = np.maximum(h[i - 1, :width] + np.where(same, MATCH, MISMATCH), h[i - 1, 1:] + GAP)
        row = np.where(inside, np.maximum(row, 0), 0)
        row = np.maximum.accumulate(row + offset) - offset  # gaps in q, all lengths at once
        h[i, :width] = np.where(inside, row, 0)
    at = int(np.argmax(h[:, :width].max(1)))
    c = int(np.argmax(h[at, :width]))
    score, path, i = int(h[at, c]), [], at
    while h[i, c] > 0:
        j = i + low + c
        if h[i, c] == h[i - 1, c] + (MATCH if q[i - 1] == s[j - 1] else MISMATCH):
            path.append((i - 1, j - 1))
            i -= 1
        elif c + 1 <= width and h[i, c] == h[i - 1, c + 1] + GAP and c + 1 < width:
            path.append((i - 1, -1))
            i, c = i - 1, c + 1
        else:
            path.append((-1, j - 1))
            c -= 1
    return score, path[::-1]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _summary(q: np.ndarray, s: np.ndarray, path: list[tuple[int, int]]) -> tuple:
    both = [(i, j) for i, j in path if i >= 0 and j >= 0]
    same = sum(q[i] == s[j] for i, j in both)
    gaps = sum(1 for k, (i, j) in enumerate(path) if (i < 0 or j < 0) and not (k and ((path[k - 1][0] < 0) == (i < 0)) and ((path[k - 1][1] < 0) == (j < 0))))
    return 100.0 * same / len(path), len(path), len(both) - same, gaps, both[0][0], both[-1][0], both[0][1], both[-1][1]


def seeds(queries: DataFrame, references: DataFrame, k: int, word: int) -> DataFrame:
    """q, s, start, q_at, s_at: equal k-grams, those of references at every (word - k + 1)-th place only."""
    grams = lambda seq, step: F.transform(F.sequence(F.lit(0), F.char_length(seq) - k, F.lit(step)), lambda i: F.struct(i.alias("at"), F.upper(F.substr(seq, i + 1, F.lit(k))).alias("gram")))
    long = lambda df: df.where(F.char_length("seq") >= k)
    a = long(queries).select(F.col("id").alias("q"), F.explode(grams(F.col("seq"), 1)).alias("g")).select("q", F.col("g.at").alias("q_at"), "g.gram")
    b = long(references).select(F.col("id").alias("s"), "start", F.explode(grams(F.col("seq"), word - k + 1)).alias("g")).select("s", "start", F.col("g.at").alias("s_at"), "g.gram")
    return a.join(b, "gram").drop("gram")


def chains(found: DataFrame, band: int, reach: int) -> DataFrame:
    """q, s, start, q_at, low, high, n: seeds whose diagonals lie in one band and that follow each other within `reach`; the first one's place and the diagonals met."""
    d = F.col("s_at") - F.col("q_at")
    rows = found.withColumn("d", d).withColumn("b", F.explode(F.array(F.floor(d / band), F.floor(d / band) + 1)))
    order = Window.partitionBy("q", "s", "start", "b").orderBy("s_at", "q_at")
    rows = rows.withColumn("new", F.when(F.col("s_at") - F.lag("s_at").over(order) <= reach, 0).otherwise(1)).withColumn("chain", F.sum("new").over(order))
    each = rows.groupBy("q", "s", "start", "b", "chain").agg(F.min(F.struct("s_at", "q_at")).alias("f"), F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n"))
    # a band and its neighbour often hold the same chain
    return each.select("q", "s", "start", F.col("f.q_at").alias("q_at"), (F.col("f.s_at") - F.col("f.q_at")).alias("diagonal"), "low", "high", "n").distinct()


def local_hits(queries: DataFrame, references: DataFrame, word: int = 28, k: int = 11, least: float | None = None, band: int = 16, reach: int = 200, drop: float = 20.0, both_strands: bool = False) -> DataFrame:
    """qseqid, sseqid, pident, length, mismatch, gapopen, qstart, qend, sstart, send (1-based, closed), evalue, bitscore.

    queries: id, seq. references: id, seq, and start if they are pieces. One row per chain of seeds, the best alignment within `band`
    diagonals of it, of score `least` (a word's) or more. With both strands, sstart is over send where the other strand matches.
    """
    if not 1 <= k <= word:
        raise ValueError("a seed is at most as long as a word")
    least = float(word) if least is None else least
    references = references if "start" in references.columns else references.withColumn("start", F.lit(0))
    strands = queries.select("id", "seq", F.lit(False).alias("other"))
    if both_strands:
        strands = strands.unionByName(queries.select("id", reverse_complement(F.col("seq")).alias("seq"), F.lit(True).alias("other")))
    strands = strands.where("seq IS NOT NULL").select(F.struct("id", "other").alias("id"), F.upper("seq").alias("seq"))
    references = references.where("seq IS NOT NULL").select("id", "start", F.upper("seq").alias("seq"))
    found = chains(seeds(strands, references, k, word), band, reach)
    # a chain takes its query along and the part of the reference that the whole query can reach within the band
    rows = found.join(strands.select(F.col("id").alias("q"), F.col("seq").alias("query")), "q").join(references.select(F.col("id").alias("s"), "start", F.col("seq").alias("text")), ["s", "start"])
    first = F.greatest(F.lit(0), F.col("low") - band)
    last = F.col("high") + band + F.char_length("query")
    rows = rows.select("q.id", "q.other", "s", "start", "query", first.alias("first"), F.substr("text", first + 1, last - first).alias("part"), "q_at", "diagonal", "low", "high", "n")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                q, s, at = _codes(r["query"]), _codes(r["part"]), r["first"]
                # a seed on its own has to extend to what a whole word scores, before gaps are tried
                if r["n"] == 1 and ungapped(q, s, r["q_at"], r["diagonal"] - at, int(2 * drop)) < MATCH * word:
                    continue
                score, path = banded(q, s, r["low"] - at - band, r["high"] - at + band)
                if score < 2 * least:
                    continue
                pident, length, mismatch, gapopen, a, b, c, d = _summary(q, s, path)
                c, d = c + at + r["start"] + 1, d + at + r["start"] + 1
                if r["other"]:
                    a, b, c, d = len(q) - 1 - b, len(q) - 1 - a, d, c
                out.append((str(r["id"]), str(r["s"]), pident, length, mismatch, gapopen, a + 1, b + 1, c, d, score / 2))
            kinds = [pa.string()] * 2 + [pa.float64()] + [pa.int32()] * 5 + [pa.int64()] * 2 + [pa.float64()]
            names = [x.split(" ")[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 11, kinds)], names=names)

    hits = rows.mapInArrow(run, RESULT)
    # neighbouring chains and overlapping pieces can find one alignment twice
    hits = hits.groupBy("qseqid", "sseqid", "qstart", "qend", "sstart", "send").agg(F.max_by(F.struct("pident", "length", "mismatch", "gapopen", "score"), "score").alias("b"))
    hits = hits.select("qseqid", "sseqid", "b.pident", "b.length", "b.mismatch", "b.gapopen", "qstart", "qend", "sstart", "send", "b.score")
    own = queries.select(F.col("id").cast("string").alias("qseqid"), F.char_length("seq").cast("double").alias("m"))
    # one row: the length searched
    size = references.agg(F.coalesce(F.sum(F.char_length("seq")), F.lit(0)).cast("double").alias("n"))
    bits = (LAMBDA * F.col("score") - float(np.log(K))) / float(np.log(2))
    hits = hits.join(own, "qseqid").join(F.broadcast(size), F.lit(True)).withColumn("bitscore", bits)
    return hits.select("qseqid", "sseqid", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", (F.col("m") * F.col("n") * F.pow(F.lit(2.0), -F.col("bitscore"))).alias("evalue"), "bitscore")
