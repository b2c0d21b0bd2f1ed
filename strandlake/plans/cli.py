"""python -m strandlake.plans.cli coverage|junctions|softclips|parse ...: the four runs over files."""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandlake.operators import intervals, matrix, probes, reads, stats
from strandlake.plans import pipelines
from strandlake.sources import bam, sinks, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("coverage", help="depth, copy numbers, tracks and breakpoints")
    # Flags and their defaults.
    for short, flag in (("-b", "--bam"), ("-r", "--region"), ("-n", "--norm"), ("-o", "--outfile")):
        c.add_argument(short, flag, required=True)
    c.add_argument("--plot", action="store_true")
    for flag, kind, default in (("--plot-threshold", float, 1.4), ("--plot-interval", str, None), ("--plot-proportion", float, 2), ("--probe-size", int, 500), ("--max-extension", int, 5_000_000), ("--probe-threshold", float, 0.8), ("--probe-number", int, 20), ("--probe-spacing", int, 1000), ("--probe-drops", int, 10), ("--plot-slw", int, 1000), ("--plot-bin", int, None), ("--bkp-slw", int, 1000), ("--bkp-signal", str, "moving_average"), ("--bkp-nb", int, 2), ("--bkp-pen", int, None), ("--bkp-model", str, "l2"), ("--bkp-algo", str, "BottomUp"), ("--bkp-threshold", float, 0.5), ("--bkp-passes", int, 1), ("--probe-cluster-dist", float, 0.15), ("--probe-n-each-side", int, 20), ("--mutation", str, None), ("--probe-max-spacing", int, None)):
        c.add_argument(flag, type=kind, default=default)
    for flag in ("--plot-auto", "--plot-force", "--plot-pooled", "--probe-symmetric", "--probe-profile", "--probe-profile-out"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--plot-doclim", nargs=2)
    c.add_argument("-bkp", "--breakpoint", choices=["segmentation", "rollingaverage"])
    for name in ("junctions", "softclips"):
        j = sub.add_parser(name, help="soft clips" + (", bridging pairs and junction reads" if name == "junctions" else "") + " near breakpoints")
        for flag, long in (("-b", "--bam_list"), ("-i", "--input"), ("-o", "--output")):
            j.add_argument(flag, long, required=True)
        j.add_argument("-s", "--size", type=int, default=30)
        j.add_argument("-e", "--extension", type=int, default=30)
        j.add_argument("--hits", help="tabular alignment hits of the clips, to be filtered")
        j.add_argument("--reference", help="FASTA file that the clips are aligned to, if there are no hits yet")
        j.add_argument("--pairs", nargs="+" if name == "junctions" else None, help="pairs N-M" if name == "junctions" else "file with source_bkp and target_bkp")
        if name == "junctions":
            j.add_argument("--junction", action="store_true")
            j.add_argument("--junction-fastq", action="store_true")
    p = sub.add_parser("parse", help="fields of a packed matrix")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output")
    for f in matrix.FIELDS:
        p.add_argument(f"--{f}", action="store_true")
    p.add_argument("--filter")
    p.add_argument("--filter-locus")
    p.add_argument("--filter-op", choices=list(matrix.OPERATORS))
    p.add_argument("--filter-value", type=float)
    p.add_argument("--format", choices=["tsv", "list"], default="tsv")
    p.add_argument("--suffix", default=".bam")
    return top


def condition(args) -> tuple[str, str, float] | None:
    parts = (args.filter_locus, args.filter_op, args.filter_value)
    if args.filter:
        return matrix.parse_filter(args.filter)
    if any(x is not None for x in parts):
        if any(x is None for x in parts):
            raise SystemExit("--filter-locus, --filter-op and --filter-value go together")
        return parts
    return None


def parse(spark: SparkSession, args) -> str:
    fields = [f for f in matrix.FIELDS if getattr(args, f)]
    if not fields:
        raise SystemExit("no field is asked for")
    cond = condition(args)
    wide = tables.matrix(spark, args.input)
    if cond and not wide.where(F.col("locus") == cond[0]).count():
        raise SystemExit(f"no locus {cond[0]!r}")
    out = pipelines.parse(wide, fields, cond, args.format)
    path = sinks.parsed_path(args.input, args.output, fields, cond, args.format)
    samples = [c for c in wide.columns if c != "locus"]
    names = [s for s in samples] if args.format == "list" else [f"{s}_{f}" for s in samples for f in fields]
    left = {r.name for r in out.select("name").distinct().collect()}
    names = [n for n in names if n in left]
    if args.format == "list":
        with open(path, "w") as f:
            f.writelines(f"{n}{args.suffix}\n" for n in names)
    else:
        sinks.write_matrix(matrix.to_wide(out.withColumnRenamed("name", "sample"), names, "value"), path, [])
    return path


def coverage(spark: SparkSession, args) -> str:
    began = time.monotonic()
    samples = tables.samples(spark, args.bam).orderBy("ord").collect()
    regions = tables.regions(spark, args.region)
    if not regions.where(F.col("locus") == args.norm).count():
        raise SystemExit(f"no locus {args.norm!r} in the region file")
    folder = os.path.abspath(sinks.run_folder(args.outfile))
    os.makedirs(folder, exist_ok=True)
    base = os.path.join(folder, os.path.basename(args.outfile))
    paths = [s.path for s in samples]

    def over(df, start: str, end: str, chrom: str = "chrom"):
        """The reads over a table of regions, a row per locus or the like: only their blocks are read."""
        return bam.alignments(spark, paths, regions=[(r[0], r[1] - 1, r[2] + 1) for r in df.select(chrom, start, end).distinct().collect()])

    def blocks(alignments):
        return reads.blocks(reads.usable(alignments.where("pos0 >= 0"))).withColumnRenamed("rname", "chrom")

    found = pipelines.coverage(blocks(over(regions, "start", "end")), regions, args.norm).cache()
    # loci without depth are NA, unless tracks are asked for too
    shown = found if args.plot else pipelines.with_missing(found, [r.locus for r in regions.select("locus").distinct().collect()])
    sinks.write_matrix(matrix.to_wide(pipelines.packed(shown), [s.sample for s in samples], "cell"), f"{base}_coverage.tsv", sinks.coverage_comments())
    if args.mutation:
        mutations = tables.mutations(spark, args.mutation)
        cells = pipelines.genotypes(over(mutations, "pos0", "pos0"), mutations, samples=tables.samples(spark, args.bam)).withColumnRenamed("mutation_id", "locus")
        sinks.write_matrix(matrix.to_wide(cells, [s.sample for s in samples], "cell").toDF("mutation_id", *paths), f"{base}_mutations.tsv", [])
    sinks.write_parameters(vars(args) | {"elapsed_seconds": round(time.monotonic() - began, 1)}, f"{base}_parameters.tsv")
    if not args.plot:
        return folder
    spans = intervals.locus_span(regions)
    lengths = bam.contig_lengths(spark, paths).groupBy(F.col("rname").alias("chrom")).agg(F.max("length").alias("length"))
    proportional = intervals.proportional_interval(spans, args.plot_proportion, lengths)
    given = tables.plot_intervals(spark, args.plot_interval) if args.plot_interval else None
    chosen = stats.candidates(found, args.plot_threshold, args.plot_force, args.norm)
    ref = found.where(F.col("locus") == args.norm).select("sample", F.col("median").alias("ref_median"))
    runs = None
    expanded = None
    if args.plot_auto or args.probe_profile:
        # probes read bases of enough quality, whatever the mapping quality
        reach = max(args.max_extension if args.plot_auto else 0, args.probe_n_each_side * args.probe_spacing + args.probe_size)
        windows = spans.join(chosen.select("sample", "locus"), "locus").select("sample", "locus", "chrom", F.greatest(F.lit(0), F.col("start") - reach).alias("w_start"), (F.col("end") + reach).alias("w_end"))
        runs = pipelines.base_depth(over(windows, "w_start", "w_end"), windows, ["sample", "locus"]).cache()
    if args.plot_auto:
        loci = spans.join(chosen, "locus").join(ref, "sample").select("sample", "locus", "start", "end", F.col("mean").alias("target_cov"), F.col("ref_median").alias("reference_cov"))
        how = (["sample", "locus"], args.probe_size, args.probe_spacing, args.probe_number, args.probe_drops, args.max_extension, args.probe_symmetric, args.probe_max_spacing)
        each = probes.expand_intervals(runs, loci, *how)
        sinks.write_tsv(probes.expand_intervals(runs, loci, *how, rounds=True), f"{base}_probe_rounds.tsv", order=["sample", "locus", "round", "side"])
        expanded = each.groupBy("locus").agg(F.min("plot_start").alias("plot_start"), F.max("plot_end").alias("plot_end"))
    plot = intervals.plot_interval(proportional, expanded, given).join(spans.select("locus", "chrom"), "locus")
    limits = tuple(args.plot_doclim) if args.plot_doclim else None
    track = pipelines.tracks(blocks(over(plot, "plot_start", "plot_end")), found, plot, args.norm, args.plot_slw, limits, args.plot_bin, -1.0 if args.plot_force else args.plot_threshold).cache()
    how = {"algo": args.bkp_algo, "model": args.bkp_model, "n_bkps": args.bkp_nb, "pen": args.bkp_pen}
    groups = cuts = None
    if args.probe_profile:
        where = spans.join(chosen.select("sample", "locus"), "locus").join(ref, "sample").select("sample", "locus", "start", "end", "ref_median")
        groups = pipelines.probe_groups(runs, where, args.probe_threshold, args.probe_cluster_dist, size=args.probe_size, spacing=args.probe_spacing, each_side=args.probe_n_each_side).cache()
        if args.probe_profile_out:
            sinks.write_named(sinks.probe_files(groups, spans, args.probe_threshold, args.probe_spacing, args.probe_n_each_side), folder, ["sample"])
        groups = groups.select("sample", "locus", "cluster")
    if args.breakpoint == "segmentation":
        cuts = pipelines.copy_breakpoints(track, spans, column=args.bkp_signal, **how)
        if args.plot_pooled:
            cuts = cuts.unionByName(pipelines.copy_breakpoints(track, spans, True, groups, args.bkp_signal, **how))
        if not cuts.isEmpty():
            cuts.orderBy("bam_file", "locus", "breakpoint_number").toPandas().to_csv(f"{base}_breakpoints.tsv", sep="\t", index=False)
    elif args.breakpoint == "rollingaverage":
        pipelines.rolling_breakpoints(track, args.bkp_threshold, args.bkp_slw, args.bkp_passes).write.mode("overwrite").parquet(f"{base}_regions.parquet")
    pipelines.plot_data(track, spans, cuts, groups).write.mode("overwrite").parquet(f"{base}_tracks.parquet")
    sinks.write_parameters(vars(args) | {"elapsed_seconds": round(time.monotonic() - began, 1)}, f"{base}_parameters.tsv")
    return folder


def clips(spark: SparkSession, args) -> str:
    listed = tables.samples(spark, args.bam_list).collect()
    points = tables.breakpoints(spark, args.input).withColumnRenamed("bam_file", "sample")
    paths = [s.path for s in listed]
    if args.command == "softclips":  # a sample that isn't listed is looked for beside the run
        beside = [os.path.abspath(f"{r.sample}.bam") for r in points.select("sample").distinct().collect() if r.sample not in {s.sample for s in listed}]
        paths += [p for p in beside if os.path.exists(p)]
    with_reads = args.command == "junctions" and (args.junction or args.junction_fastq)
    rows = bam.alignments(spark, paths, regions=pipelines.read_regions(points, args.extension, with_reads))
    if isinstance(args.pairs, str) and "://" not in args.pairs:
        args.pairs = os.path.abspath(args.pairs)
    allowed = tables.pairs(spark, args.pairs)
    if args.command == "softclips":
        found = {"clips": pipelines.softclips(rows, points, args.size, args.extension)}
    else:
        found = pipelines.junctions(rows, points, args.size, args.extension, allowed, with_reads, bam.alignments(spark, paths, unmapped=True))
        sinks.write_tsv(found["bridges"], f"{args.output}_bridging_pairs.tsv", order=["read_pos", "read_name"])
    ordered = points.withColumn("ord", F.monotonically_increasing_id())
    reports = {}
    if "inserts" in found:
        lists = pipelines.insert_lists(found["inserts"], allowed)
        for name, pooled in (("", False), ("pooled_", True)):
            reports[f"{name}inserts"], reports[f"{name}insert_bins"] = pipelines.insert_report(lists, ordered, pooled)
            reports[f"{name}clip_positions"], reports[f"{name}clip_modes"] = pipelines.clip_report(found["clips"], ordered, pooled)
    else:
        reports["clip_density"] = pipelines.clip_density(found["clips"])
    for name, report in reports.items():
        sinks.write_tsv(report, f"{args.output}_{name}.tsv")
    folder = os.path.dirname(args.output) or "."
    sinks.write_tsv(sinks.clip_table(found["clips"]), f"{args.output}.tsv", order=["Breakpoint", "Position", "Read_name"])
    sequences = sinks.clip_fasta(found["clips"]).withColumn("name", F.lit(f"{os.path.basename(args.output)}_soft_clipped_sequences.fasta"))
    sinks.write_named(sequences, folder, ["value"])
    if "reads" in found:
        sinks.write_named(sinks.junction_fasta(found["reads"]), folder, ["place", "value"])
        if args.junction_fastq:
            sinks.write_named(sinks.junction_fastq(found["reads"], bam.alignments(spark, paths)), folder, ["pos0", "value"])
    if args.reference:
        sinks.write_tsv(pipelines.clip_hits(found["clips"], tables.fasta(spark, args.reference)), f"{args.output}_hits.txt", header=False, order=["qseqid", "evalue"])
        args.hits = args.hits or os.path.abspath(f"{args.output}_hits.txt")
    if args.hits:
        kept = pipelines.filtered_hits(tables.hits(spark, args.hits), points, args.extension, allowed)
        sinks.write_tsv(kept.drop("ord"), f"{args.output}_filtered_pairs.txt", header=False, order=["qseqid", "evalue"])
    return args.output


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    for name in ("bam", "region", "plot_interval", "mutation", "bam_list", "input", "hits", "reference"):  # the session may have another working folder
        if (path := getattr(args, name, None)) and "://" not in path:
            setattr(args, name, os.path.abspath(path))
    spark = spark or SparkSession.builder.appName("strandlake").getOrCreate()
    return {"coverage": coverage, "junctions": clips, "softclips": clips, "parse": parse}[args.command](spark, args)


if __name__ == "__main__":
    print(main())
