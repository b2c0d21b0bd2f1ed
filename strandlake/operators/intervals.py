"""Intervals, depth of coverage and spans. All intervals are half-open, [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import chunks


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, l: tuple[str, str] = ("start", "end"), r: tuple[str, str] = ("r_start", "r_end")) -> DataFrame:
    """All overlapping pairs of left and right rows with equal keys, each once.

    Both sides are dealt to bins of `width`, so the join is an equi-join that neither broadcasts nor compares all pairs; a
    pair is kept in the one bin where the later of the two begins. Rows with null bounds or no length meet nothing.
    """
    a = left.where(F.col(l[0]) < F.col(l[1])).withColumn("_bin", F.explode(_bins(F.col(l[0]), F.col(l[1]), width)))
    b = right.where(F.col(r[0]) < F.col(r[1])).withColumn("_bin", F.explode(_bins(F.col(r[0]), F.col(r[1]), width)))
    meets = (F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1])) & (F.col("_bin") == F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / width))
    return a.join(b, [*keys, "_bin"]).where(meets).drop("_bin")


def clip_to(pairs: DataFrame, start: str = "start", end: str = "end", r_start: str = "r_start", r_end: str = "r_end") -> DataFrame:
    """Cut the left intervals of a range join to the right ones."""
    return pairs.withColumns({start: F.greatest(start, r_start), end: F.least(end, r_end)})


def depth_runs(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end", chunk: int = 1 << 20) -> DataFrame:
    """keys, start, end, depth: maximal steps of the number of intervals over each position; zero depth has no rows.

    A sweep over interval ends. The running sum is taken per chunk of positions and carried over from chunk totals, so one
    long track is many window partitions.
    """
    ends = F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d"))))
    deltas = intervals.where(F.col(start) < F.col(end)).select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.pos").cast("long").alias("pos")).agg(F.sum("e.d").alias("d"))
    deltas = deltas.where("d != 0").withColumn("c", F.floor(F.col("pos") / chunk))
    order = Window.partitionBy(*keys).orderBy("c")
    totals = deltas.groupBy(*keys, "c").agg(F.sum("d").alias("t"), F.min("pos").alias("first"))
    totals = totals.select(*keys, "c", F.coalesce(F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"), F.lead("first").over(order).alias("next"))
    within = Window.partitionBy(*keys, "c").orderBy("pos")
    runs = deltas.join(totals, [*keys, "c"]).select(*keys, F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(within), F.col("next")).alias("end"), (F.col("carry") + F.sum("d").over(within)).alias("depth"))
    return runs.where("depth > 0")


def coverage_index(runs: DataFrame, keys: list[str], chunk: int = 1 << 14) -> DataFrame:
    """keys, c, steps: a row per chunk of positions with its runs (start, end, depth, before) in order; before is the coverage from the chunk's start on."""
    cut = runs.where(F.col("start") < F.col("end")).withColumn("c", F.explode(_bins(F.col("start"), F.col("end"), chunk)))
    cut = cut.select(*keys, "c", F.greatest("start", F.col("c") * chunk).alias("start"), F.least("end", (F.col("c") + 1) * chunk).alias("end"), "depth")
    order = Window.partitionBy(*keys, "c").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("before", F.coalesce(F.sum(F.col("depth") * (F.col("end") - F.col("start"))).over(order), F.lit(0)))
    return cut.groupBy(*keys, "c").agg(F.array_sort(F.collect_list(F.struct("start", "end", "depth", "before"))).alias("steps"))


def covered(index: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str, out: str, chunk: int = 1 << 14) -> DataFrame:
    """keys, start, end, out of distinct spans: their coverage, by what the index adds up to at both ends. Spans without any have no row."""
    parts = spans.select(*keys, start, end).distinct().where(F.col(start) < F.col(end)).withColumn("c", F.explode(_bins(F.col(start), F.col(end), chunk)))

    def up_to(p: Column) -> Column:
        step = F.try_element_at(F.filter("steps", lambda s: s["start"] < p), F.lit(-1))
        return F.coalesce(step["before"] + step["depth"] * (F.least(step["end"], p) - step["start"]), F.lit(0))

    met = parts.join(index, [*keys, "c"]).select(*keys, start, end, (up_to(F.col(end)) - up_to(F.col(start))).alias("_n"))
    return met.groupBy(*keys, start, end).agg(F.sum("_n").alias(out))


def per_position(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, depth: a row for every position of the runs."""
    return runs.select(*keys, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "depth")


def densify(track: DataFrame, keys: list[str], value: str = "depth") -> DataFrame:
    """Positions missing between a track's first and last one, with value 0 and nulls in other columns; null values become 0, null positions go.

    Each row brings the positions up to the next one; the last row of a chunk takes that from the chunks behind it.
    """
    rest = [c for c in track.columns if c not in (*keys, "pos")]
    rows = track.where("pos IS NOT NULL").withColumn("_c", chunks.of(F.col("pos")))
    rows = chunks.carry(rows, keys, {"_first": F.min("pos")}, {"_next": lambda w: F.lead("_first").over(w)})
    following = F.coalesce(F.lead("pos").over(chunks.within(keys, "pos")), F.col("_next"))
    rows = rows.withColumn("_last", F.greatest(F.col("pos"), F.coalesce(following - 1, F.col("pos"))))
    rows = rows.withColumn("_at", F.explode(F.sequence("pos", "_last")))
    own = {c: F.when(F.col("_at") == F.col("pos"), F.col(c)) for c in rest}
    own[value] = F.coalesce(own[value], F.lit(0).cast(track.schema[value].dataType))
    return rows.select(*keys, F.col("_at").alias("pos"), *(own[c].alias(c) for c in rest))


def locus_span(regions: DataFrame) -> DataFrame:
    """locus, chrom (of its first region by ord), start, end over all regions of a locus."""
    return regions.groupBy("locus").agg(F.min_by("chrom", "ord").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"))


def proportional_interval(spans: DataFrame, proportion: float, lengths: DataFrame | None = None) -> DataFrame:
    """spans with plot_start, plot_end: the span widened by a share of its length, within 1 and the contig's length (chrom, length)."""
    rows = spans.join(lengths, "chrom", "left") if lengths is not None else spans.withColumn("length", F.lit(None).cast("long"))
    wide = ((F.col("end") - F.col("start")) * F.lit(float(proportion))).cast("long")
    return rows.select(*spans.columns, F.greatest(F.lit(1), F.col("start") - wide).alias("plot_start"), F.least(F.col("length"), F.col("end") + wide).alias("plot_end"))


def plot_interval(proportional: DataFrame, expanded: DataFrame | None = None, given: DataFrame | None = None) -> DataFrame:
    """locus, plot_start, plot_end by priority: given by file, else expanded, else proportional; each has those columns."""
    out = proportional.select("locus", F.col("plot_start").alias("s0"), F.col("plot_end").alias("e0"))
    take = [("s0", "e0")]
    for k, more in enumerate((expanded, given), 1):
        if more is not None:
            out = out.join(more.select("locus", F.col("plot_start").alias(f"s{k}"), F.col("plot_end").alias(f"e{k}")), "locus", "left")
            take.insert(0, (f"s{k}", f"e{k}"))
    return out.select("locus", F.coalesce(*(s for s, _ in take)).alias("plot_start"), F.coalesce(*(e for _, e in take)).alias("plot_end"))


def search_windows(regions: DataFrame) -> DataFrame:
    """chrom, start, end to search: one span if all regions share a chromosome, else each region."""
    one = regions.agg(F.min("chrom").alias("chrom"), F.max("chrom").alias("c2"), F.min("start").alias("start"), F.max("end").alias("end"))
    single = one.where("chrom = c2").select("chrom", "start", "end")
    several = regions.select("chrom", "start", "end").join(one.where("chrom < c2").select("c2").withColumn("k", F.lit(1)).drop("c2"), F.lit(True), "left_semi")
    return single.unionByName(several)
