"""Reads that hold clips of two breakpoints: multi-pattern matching, pairs of matches, and marked spans."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns that are sent to the workers at most, with 32 MB of text; more meet the reads in a join on seeds. Bases of a seed.
MOST, MOST_CHARS, SEED = 200_000, 32 << 20, 16


def _finder(patterns: list[tuple[str, int]]):
    """text -> (start, end inclusive, breakpoint, pattern) of all occurrences, overlapping ones too."""
    own = {p: b for p, b in patterns if p}
    try:
        import ahocorasick
    except ImportError:
        def find(text: str) -> Iterator[tuple]:
            for p, b in own.items():
                at = text.find(p)
                while at >= 0:
                    yield at, at + len(p) - 1, b, p
                    at = text.find(p, at + 1)
        return find
    if not own:
        return lambda text: iter(())
    machine = ahocorasick.Automaton()
    for p, b in own.items():
        machine.add_word(p, (p, b))
    machine.make_automaton()
    return lambda text: ((end - len(p) + 1, end, b, p) for end, (p, b) in machine.iter(text))


def pattern_matches(reads: DataFrame, patterns: DataFrame, id_: str = "read", seq: str = "seq", by: str | None = None, most: int = MOST) -> DataFrame:
    """id_, start, end (0-based, inclusive), breakpoint, pattern: every occurrence of every pattern in every read.

    patterns: ord, pattern, breakpoint. Of equal patterns the last by ord names the breakpoint. by: a column of both, inside
    which reads meet patterns. Up to `most` patterns (and MOST_CHARS) go to the workers, who read the reads once; more are joined
    with the reads on seeds. No patterns: no matches.
    """
    own = [by] if by else []
    unique = patterns.where("pattern is not null AND pattern != ''").groupBy(*own, "pattern").agg(F.max_by("breakpoint", "ord").alias("breakpoint"))
    size = unique.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("chars"), F.min(F.length("pattern")).alias("least")).first()
    if size.n > most or size.chars > MOST_CHARS:
        return _seeded(reads, unique, id_, seq, own, min(SEED, size.least))
    held: dict = {}
    for r in unique.collect():  # within both limits
        held.setdefault(r[by] if by else None, []).append((r.pattern, r.breakpoint))
    schema = reads.select(F.col(id_), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("breakpoint"), F.lit("").alias("pattern")).schema

    def run(batches):
        import pandas as pd

        find = {k: _finder(v) for k, v in held.items()}
        for pdf in batches:
            groups = pdf[by] if by else [None] * len(pdf)
            rows = [(i, *m) for i, s, k in zip(pdf[id_], pdf[seq], groups) if s is not None and k in find for m in find[k](s)]
            yield pd.DataFrame(rows, columns=schema.names)

    return reads.select(id_, seq, *own).mapInPandas(run, schema)


def _seeded(reads: DataFrame, unique: DataFrame, id_: str, seq: str, own: list[str], k: int) -> DataFrame:
    """The same by an equi-join of the first k bases of patterns with all k-grams of reads."""
    at = F.sequence(F.lit(1), F.char_length(seq) - k + 1)
    grams = reads.where(F.char_length(seq) >= k).select(id_, seq, *own, F.explode(at).alias("at")).withColumn("seed", F.substr(F.col(seq), F.col("at"), F.lit(k)))
    seeds = unique.withColumn("seed", F.left("pattern", F.lit(k)))
    met = grams.join(seeds, [*own, "seed"]).where(F.substr(F.col(seq), F.col("at"), F.length("pattern")) == F.col("pattern"))
    return met.select(id_, (F.col("at") - 1).alias("start"), (F.col("at") + F.length("pattern") - 2).alias("end"), F.col("breakpoint").cast("int").alias("breakpoint"), "pattern")


def matching_pairs(matches: DataFrame, id_: str = "read", allowed: DataFrame | None = None) -> DataFrame:
    """id_, ord, m1, m2: for each match the first later one of another breakpoint, in an allowed order.

    Matches are ordered by their end, longer ones first. allowed: source, target; none: all.
    """
    m = F.struct("end", (-F.length("pattern")).alias("shorter"), "start", "breakpoint", "pattern")
    per_read = matches.groupBy(id_).agg(F.array_sort(F.collect_list(m)).alias("ms"))
    rows = per_read.select(id_, "ms", F.posexplode("ms").alias("i", "m1"))
    rows = rows.select(id_, F.col("i").alias("ord"), "m1", F.posexplode(F.slice("ms", F.col("i") + 2, F.size("ms"))).alias("j", "m2")).where("m1.breakpoint != m2.breakpoint")
    rows = rows.withColumns({"source": F.col("m1.breakpoint"), "target": F.col("m2.breakpoint")})
    if allowed is not None:
        rows = rows.join(allowed, ["source", "target"], "left_semi")
    return rows.groupBy(id_, "ord").agg(F.min_by(F.struct("m1", "m2"), "j").alias("p")).select(id_, "ord", "p.m1", "p.m2")


def highlight(seq: Column, *spans: tuple[Column, Column]) -> Column:
    """seq in lower case with spans (0-based, inclusive) in upper case; only A-Z have a case here, so lengths stay."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = F.translate(seq, upper, lower)
    for s, e in spans:
        n = e - s + 1
        out = F.concat(F.substr(out, F.lit(1), s), F.translate(F.substr(out, s + 1, n), lower, upper), F.substr(out, e + 2, F.char_length(out)))
    return out


def junction_reads(reads: DataFrame, patterns: DataFrame, allowed: DataFrame | None = None, id_: str = "read", seq: str = "seq", by: str | None = None) -> DataFrame:
    """id_, b1, b2, ord, marked, once per record and ordered pair: the first pair of matches of each, with its place.

    id_ names a record: rows with one id have one sequence.
    """
    pairs = matching_pairs(pattern_matches(reads, patterns, id_, seq, by), id_, allowed)
    first = pairs.groupBy(id_, F.col("m1.breakpoint").alias("b1"), F.col("m2.breakpoint").alias("b2")).agg(F.min("ord").alias("ord"), F.min_by(F.struct("m1", "m2"), "ord").alias("p"))
    rows = first.join(reads.select(id_, seq).dropDuplicates([id_]), id_)
    return rows.select(id_, "b1", "b2", "ord", highlight(F.col(seq), (F.col("p.m1.start"), F.col("p.m1.end")), (F.col("p.m2.start"), F.col("p.m2.end"))).alias("marked"))
