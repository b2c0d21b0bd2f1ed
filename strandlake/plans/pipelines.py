"""The four end-user runs as DataFrame plans: coverage, softclips, junctions and parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import alignment, changepoint, hits, intervals, matrix, patterns, probes, reads, signal, stats

#: Bases in a bin of range joins.
WIDTH = 10_000


def locus_runs(blocks: DataFrame, regions: DataFrame, width: int = WIDTH) -> DataFrame:
    """sample, locus, ord, start, end, depth of blocks (sample, chrom, start, end) cut to regions (locus, chrom, start, end, ord)."""
    where = regions.select("locus", "chrom", "ord", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    met = intervals.clip_to(intervals.range_join(blocks, where, ["chrom"], width))
    return intervals.depth_runs(met, ["sample", "locus", "ord"])


def coverage(blocks: DataFrame, regions: DataFrame, norm_locus: str, width: int = WIDTH) -> DataFrame:
    """sample, locus, mean, sd, median, covered_bases, rcn. Regions of one locus are pooled; samples without norm locus go."""
    return stats.normalise(stats.locus_stats(locus_runs(blocks, regions, width), ["sample", "locus"]), norm_locus)


def with_missing(found: DataFrame, loci: list[str]) -> DataFrame:
    """found with a row of nulls for every locus of a sample that has no depth."""
    grid = found.select("sample").distinct().withColumn("locus", F.explode(F.array(*(F.lit(x) for x in loci))))
    return grid.join(found, ["sample", "locus"], "left")


def packed(found: DataFrame) -> DataFrame:
    """sample, locus, cell."""
    return found.select("sample", "locus", matrix.packed_cell(F.col("mean"), F.col("sd"), F.col("median"), F.col("covered_bases"), F.col("rcn")).alias("cell"))


def tracks(blocks: DataFrame, found: DataFrame, plot: DataFrame, norm_locus: str, w: int = 1000, limits: tuple | None = None, bin_size: int | None = None, threshold: float = 1.4, width: int = WIDTH) -> DataFrame:
    """The depth tracks of candidate loci over their plot intervals (locus, chrom, plot_start, plot_end), per sample."""
    ref = found.where(F.col("locus") == norm_locus).select("sample", F.col("median").alias("ref_median"))
    chosen = stats.candidates(found, threshold).select("sample", "locus")
    where = plot.join(chosen, "locus").select("sample", "locus", "chrom", F.col("plot_start").alias("r_start"), F.col("plot_end").alias("r_end"))
    met = intervals.clip_to(intervals.range_join(blocks, where, ["sample", "chrom"], width))
    depth = intervals.per_position(intervals.depth_runs(met, ["sample", "locus"]), ["sample", "locus"])
    return signal.depth_track(depth.join(ref, "sample"), ["sample", "locus"], "ref_median", w, limits, bin_size)


def copy_breakpoints(track: DataFrame, spans: DataFrame, pooled: bool = False, groups: DataFrame | None = None, column: str = "moving_average", **how) -> DataFrame:
    """bam_file, locus, chromosome, position, breakpoint_number, method. pooled: per locus and group (sample, locus, cluster)."""
    if pooled:
        rows = track.join(groups, ["sample", "locus"], "left") if groups is not None else track.withColumn("cluster", F.lit(0))
        cuts = changepoint.pooled_breakpoints(rows.fillna(0, ["cluster"]), ["locus", "cluster"], "sample", column, **how).withColumn("bam_file", F.lit("pooled"))
    else:
        find = changepoint.breakpoints
        if how.get("algo") == "Chunked":  # squared errors over tracks of any length, a number of cuts
            how, find = {k: v for k, v in how.items() if k in ("n_bkps", "min_size", "jump")}, changepoint.chunked_breakpoints
        cuts = find(track, ["sample", "locus"], column, **how).withColumnRenamed("sample", "bam_file")
    return cuts.join(spans.select("locus", F.col("chrom").alias("chromosome")), "locus").select("bam_file", "locus", "chromosome", "position", "breakpoint_number", "method")


def rolling_breakpoints(track: DataFrame, threshold: float = 0.5, w: int = 1000, passes: int = 1) -> DataFrame:
    """sample, locus, island, start, end, rows, peak, centre of regions where the smoothed average leaves the norm."""
    keys = ["sample", "locus"]
    return signal.island_peaks(signal.islands(signal.shifts(track, keys, threshold, w, passes), keys), track, keys)


def plot_data(track: DataFrame, spans: DataFrame, cuts: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """The rows of a track plot with is_target, whether a position lies in the locus itself.

    cuts (bam_file, locus, position, breakpoint_number): also breakpoint_number at the positions of a sample's breakpoints, and
    pooled_breakpoint at those of its locus. groups (sample, locus, cluster): also cluster, which a pooled plot goes by; 0 without one.
    """
    out = track.join(spans.select("locus", F.col("start").alias("_s"), F.col("end").alias("_e")), "locus").withColumn("is_target", F.col("pos").between(F.col("_s"), F.col("_e"))).drop("_s", "_e")
    if groups is not None:
        out = out.join(groups.select("sample", "locus", "cluster"), ["sample", "locus"], "left").fillna(0, ["cluster"])
    if cuts is not None:
        at = cuts.select(F.col("bam_file").alias("sample"), "locus", F.col("position").alias("_p"), "breakpoint_number")
        own = at.groupBy("sample", "locus", "_p").agg(F.min("breakpoint_number").alias("breakpoint_number"))
        pooled = at.where("sample = 'pooled'").groupBy("locus", "_p").agg(F.min("breakpoint_number").alias("pooled_breakpoint"))
        out = out.withColumn("_p", F.col("pos").cast("long")).join(own, ["sample", "locus", "_p"], "left").join(pooled, ["locus", "_p"], "left").drop("_p")
    return out


def probe_groups(runs: DataFrame, spans: DataFrame, threshold: float = 0.8, distance: float = 0.15, **probing) -> DataFrame:
    """sample, locus, profile, bits, cluster of samples with like probe profiles."""
    found = probes.profiles(probes.probe_profile(runs, spans, ["sample", "locus"], "ref_median", **probing), ["sample", "locus"])
    return probes.hamming_clusters(found.withColumn("bits", probes.binarised(F.col("profile"), threshold)), ["locus"], "sample", "bits", distance)


def genotypes(alignments: DataFrame, mutations: DataFrame, min_quality: int = 13, samples: DataFrame | None = None) -> DataFrame:
    """mutation_id, sample, cell (A=;T=;C=;G=;depth=) for every mutation and sample (of `samples`, if given); NA where no base is read."""
    points = mutations.select("mutation_id", F.col("chrom").alias("rname"), F.col("pos0").alias("r_start"), (F.col("pos0") + 1).alias("r_end"))
    near = intervals.range_join(alignments.where("pos0 >= 0"), points, ["rname"], WIDTH, ("pos0", "end0")).drop("r_start", "r_end", "mutation_id").distinct()
    bases = reads.aligned_bases(near).join(points.select("mutation_id", "rname", F.col("r_start").alias("pos")), ["rname", "pos"])
    counts = stats.nucleotide_counts(bases, ["mutation_id", "sample"], min_quality)
    cell = F.format_string("A=%d;T=%d;C=%d;G=%d;depth=%d", "a", "t", "c", "g", "depth")
    grid = mutations.select("mutation_id").join((alignments if samples is None else samples).select("sample").distinct(), F.lit(True))
    return grid.join(counts.select("mutation_id", "sample", cell.alias("cell")), ["mutation_id", "sample"], "left").fillna("NA", ["cell"])


def clip_modes(clips: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """breakpoint, mode, n, predicted, offset of clip positions (with ord)."""
    modes = stats.mode_first(clips, ["breakpoint"], "clip_position", "ord")
    return stats.mode_offset(modes, breakpoints.select(F.col("breakpoint_number").alias("breakpoint"), F.col("position").alias("predicted")), ["breakpoint"])


def near_windows(breakpoints: DataFrame, extension: int) -> DataFrame:
    """chrom, start, end around breakpoints."""
    return breakpoints.select(F.col("chromosome").alias("chrom"), F.greatest(F.lit(0), F.col("position") - extension).alias("start"), (F.col("position") + extension).alias("end"))


def read_regions(breakpoints: DataFrame, extension: int, with_reads: bool = False) -> list[tuple[str, int, int]]:
    """What a clip run needs to read, for the BAM source: the windows of the breakpoints, and for junction reads those searched."""
    windows = near_windows(breakpoints, extension)
    every = windows.unionByName(intervals.search_windows(windows)) if with_reads else windows
    return sorted({(r.chrom, r.start, r.end) for r in every.collect()})


def softclips(alignments: DataFrame, breakpoints: DataFrame, min_clip: int = 30, extension: int = 30) -> DataFrame:
    return reads.soft_clips(reads.near_breakpoints(alignments, breakpoints, extension), min_clip, "softclips")


def junctions(alignments: DataFrame, breakpoints: DataFrame, min_clip: int = 30, extension: int = 30, allowed: DataFrame | None = None, with_reads: bool = False, unmapped: DataFrame | None = None) -> dict[str, DataFrame]:
    """clips, inserts, bridges and, with_reads, junction reads of alignments near breakpoints (sample, chromosome, position, breakpoint_number).

    unmapped: where records without an alignment come from, if `alignments` holds those of read_regions() only.
    """
    near = reads.valid(reads.near_breakpoints(alignments, breakpoints, extension))
    clips = reads.soft_clips(near, min_clip)
    pos, mate = F.col("pos0") + 1, F.when(F.col("flag").bitwiseAND(8) == 0, F.col("pnext0") + 1)
    mated = near.withColumns({"position": pos, "mate_position": F.when(F.col("rname") == F.col("rnext"), mate)})
    inserts = mated.withColumn("insert_size", F.abs(F.col("position") - F.col("mate_position"))).where("insert_size is not null").select("sample", "breakpoint", "insert_size")
    targets = breakpoints.select("sample", F.col("breakpoint_number").alias("target"), F.col("breakpoint_number").alias("t_ord"), (F.col("position") - extension).alias("t_start"), (F.col("position") + extension).alias("t_end"))
    ordered = mated.withColumn("ord", F.monotonically_increasing_id())
    out = {"clips": clips, "inserts": inserts, "bridges": reads.bridging_pairs(ordered, targets, WIDTH)}
    if with_reads:
        wanted = clips if allowed is None else clips.join(allowed.select(F.col("source").alias("breakpoint")).distinct(), "breakpoint", "left_semi")
        # clips of a sample are looked for in its own reads; of equal ones the last breakpoint counts
        pats = wanted.select("sample", F.col("breakpoint").alias("ord"), F.col("clip").alias("pattern"), "breakpoint")
        windows = intervals.search_windows(near_windows(breakpoints, extension))
        inside = intervals.range_join(alignments.where("pos0 >= 0"), windows.select(F.col("chrom").alias("rname"), F.col("start").alias("r_start"), F.col("end").alias("r_end")), ["rname"], WIDTH, ("pos0", "end0")).drop("r_start", "r_end")
        lost = (alignments if unmapped is None else unmapped).where(F.col("flag").bitwiseAND(4) != 0)
        pool = inside.unionByName(lost.select(*inside.columns))
        # mates are records of their own; of those with one name and pair the first in the file's order counts, unmapped ones last
        place = F.struct((F.col("flag").bitwiseAND(4) != 0).alias("unmapped"), "rname", "pos0", "flag", F.xxhash64("cigar_str", "seq").alias("own"))
        keyed = pool.select(F.struct("sample", "qname", place.alias("place")).alias("read"), "sample", "seq").where("seq is not null")
        found = patterns.junction_reads(keyed, pats, allowed, by="sample")
        rows = found.select("read.sample", F.col("read.qname").alias("read"), "read.place", "ord", "b1", "b2", "marked")
        out["reads"] = stats.first_of(rows, ["sample", "read", "b1", "b2"], ["place", "ord"])
    return out


def insert_lists(inserts: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """sample, b1, b2, insert_size: an insert counts for each allowed pair that its breakpoint is of, or without pairs for it alone (b2 null)."""
    if allowed is None:
        return inserts.select("sample", F.col("breakpoint").alias("b1"), F.lit(None).cast("int").alias("b2"), "insert_size")
    pairs = allowed.select(F.least("source", "target").alias("b1"), F.greatest("source", "target").alias("b2")).distinct()
    member = pairs.withColumn("breakpoint", F.explode(F.array("b1", "b2")))  # a pair of one breakpoint with itself has its list twice
    return inserts.join(member, "breakpoint").select("sample", "b1", "b2", "insert_size")


def insert_report(lists: DataFrame, breakpoints: DataFrame, pooled: bool = False, library: int = 500) -> tuple[DataFrame, DataFrame]:
    """Per sample (or pooled) and pair: counts of plausible inserts and outliers with the insert expected, and bins of the plausible ones.

    The last position of a breakpoint number counts. A single breakpoint expects nothing, so all its inserts are plausible.
    """
    lists = lists.withColumn("sample", F.lit("pooled")) if pooled else lists
    last = breakpoints.groupBy("breakpoint_number").agg(F.max_by("position", "ord").alias("position"))
    for b, p in (("b1", "p1"), ("b2", "p2")):
        lists = lists.join(last.select(F.col("breakpoint_number").alias(b), F.col("position").alias(p)), b, "left")
    keys = ["sample", "b1", "b2"]
    dup = F.abs(F.col("p2") - F.col("p1"))
    lists = lists.withColumns({"b2": F.coalesce("b2", F.lit(-1)), "expected": dup + library}).withColumn("ok", F.coalesce(F.col("insert_size") <= F.col("expected") + 0.1 * dup, F.lit(True)))
    counts = lists.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("ok").alias("plausible"), F.count_if(~F.col("ok")).alias("outliers"), F.first("expected").alias("expected"))
    return counts, stats.histogram(lists.where("ok"), keys, "insert_size")


def clip_report(clips: DataFrame, breakpoints: DataFrame, pooled: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per sample (or pooled) and breakpoint: clips by position, and their mode with its offset from the breakpoint predicted."""
    keys = ["sample", "breakpoint"]
    own = clips.withColumn("sample", F.lit("pooled")) if pooled else clips
    last = breakpoints.groupBy(F.col("breakpoint_number").alias("breakpoint")).agg(F.max_by("position", "ord").alias("predicted"))
    # reads come in the order of their positions
    modes = stats.mode_first(own.withColumn("met", F.col("position")), keys, "clip_position", "met")
    return own.groupBy(*keys, "clip_position").agg(F.count("*").alias("n")), stats.mode_offset(modes, last, ["breakpoint"])


def clip_density(clips: DataFrame, points: int = 200) -> DataFrame:
    """sample, breakpoint, x, density of clip positions relative to the breakpoint, each on its own grid, three bandwidths beyond them."""
    return stats.density(clips, ["sample", "breakpoint"], "relative_position", points)


def base_depth(alignments: DataFrame, windows: DataFrame, keys: list[str], min_quality: int = 13) -> DataFrame:
    """keys, start, end, depth inside windows (keys with sample, chrom, w_start, w_end): A, C, G and T of enough quality, in steps of one depth.

    Reads of any mapping quality count, but for unmapped, secondary, failed and duplicate ones. Rows grow with reads, not with bases.
    """
    where = windows.select(*keys, F.col("chrom").alias("rname"), F.col("w_start").alias("r_start"), F.col("w_end").alias("r_end"))
    good = alignments.where((F.col("flag").bitwiseAND(0x704) == 0) & (F.col("pos0") >= 0))
    near = intervals.range_join(good, where, ["sample", "rname"], WIDTH, ("pos0", "end0"))
    inside = intervals.clip_to(reads.good_stretches(near, [*keys, "r_start", "r_end"], min_quality))
    return intervals.depth_runs(inside, keys)


def clip_hits(clips: DataFrame, references: DataFrame, piece: int = 1 << 16, **how) -> DataFrame:
    """Tabular hits of clips in reference sequences (id, seq), on both strands; references are cut to pieces that overlap by more than a clip."""
    from strandlake.sources.sinks import clip_id

    queries = clips.select(clip_id().alias("id"), F.col("clip").alias("seq"))
    longest = queries.agg(F.coalesce(F.max(F.char_length("seq")), F.lit(0))).first()[0]
    overlap = 2 * longest + 64
    return alignment.local_hits(queries, alignment.pieces(references, max(piece, 2 * overlap), overlap), both_strands=True, **how)


def filtered_hits(found: DataFrame, breakpoints: DataFrame, extension: int, allowed: DataFrame | None = None) -> DataFrame:
    return hits.near_other_breakpoint(found, stats.last_by_number(breakpoints.withColumn("ord", F.monotonically_increasing_id())), extension, allowed)


def parse(wide: DataFrame, fields: list[str], condition: tuple[str, str, float] | None = None, fmt: str = "tsv") -> DataFrame:
    """locus, name, value in long form. tsv: a name per sample and field; list: a name per sample, so the last field wins."""
    long = matrix.to_long(wide)
    chosen = [f for f in matrix.FIELDS if f in fields]
    if fmt == "list":
        out = long.select("locus", "sample", F.col("sample").alias("name"), matrix.field(F.col("cell"), chosen[-1]).alias("value"))
    else:
        each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), matrix.field(F.col("cell"), f).alias("value")) for f in chosen)))
        out = long.select("locus", "sample", each.alias("x")).select("locus", F.concat_ws("_", "sample", "x.field").alias("sample"), F.concat_ws("_", "sample", "x.field").alias("name"), "x.value")
    if condition:
        out = matrix.filter_samples(out, *condition, "value")
    return out.select("locus", "name", "value")
