"""Files and whole runs over a planted duplication: [8000, 12000) of a 20 kb contig is covered twice in one sample."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import intervals, reads, stats
from strandlake.plans import pipelines
from strandlake.sources import bam, sinks, tables

CONTIGS = [("c1", 20_000), ("c2", 500)]


def read(name, pos, cigar, seq, flag=0x3, mapq=60, rnext="c1", pnext=0, quals=None, rname="c1"):
    return {"qname": name, "flag": flag, "rname": rname, "pos0": pos, "mapq": mapq, "cigar": [{"op": "MIDNSHP=X".index(o), "len": n} for n, o in cigar], "rnext": rnext, "pnext0": pnext, "seq": seq, "quals": quals}


@pytest.fixture(scope="module")
def genome():
    r = random.Random(8)
    return "".join(r.choice("ACGT") for _ in range(20_000))


@pytest.fixture(scope="module")
def files(tmp_path_factory, genome):
    d, out = tmp_path_factory.mktemp("bams"), []
    for sample, copies in (("dup", 2), ("flat", 1)):
        rows = []
        for k in range(0, 19_900, 5):
            for c in range(copies if 8000 <= k < 11_900 else 1):
                rows.append(read(f"r{k}_{c}", k, [(100, "M")], genome[k : k + 100], pnext=k + 50, quals=[35] * 100))
        if sample == "dup":
            join = genome[11_940:12_000] + genome[8000:8060]
            for k in range(6):
                rows.append(read(f"right{k}", 11_940 + k, [(60 - k, "M"), (40, "S")], join[k:60] + join[60:100], pnext=8010))
                rows.append(read(f"left{k}", 8000, [(40 + k, "S"), (50, "M")], join[20 - k : 60] + genome[8000:8050], pnext=11_990))
            rows.append(read("span", 0, [], join, flag=0x5, rname=None, rnext=None, pnext=-1))
        rows += [read("weak", 9000, [(100, "M")], genome[9000:9100], mapq=5), read("gaps", 500, [(10, "M"), (4, "D"), (3, "I"), (10, "M")], genome[500:510] + "TTT" + genome[514:524], quals=[35] * 5 + [5] + [35] * 17)]
        path = f"{d}/{sample}.bam"
        bam.write_bam(path, CONTIGS, rows)
        out.append(path)
    return out


@pytest.fixture(scope="module")
def alignments(spark, files):
    return bam.alignments(spark, files).cache()


@pytest.fixture(scope="module")
def regions(spark):
    return spark.createDataFrame([("target", "c1", 9000, 11_000, 0), ("reference", "c1", 2000, 6000, 1)], "locus string, chrom string, start long, end long, ord int")


def test_bam_round_trip(spark, files, alignments, genome):
    row = alignments.where("qname = 'gaps' AND sample = 'dup'").first()
    assert (row.rname, row.pos0, row.end0, row.cigar_str, row.seq[:10], row.quals[5]) == ("c1", 500, 524, "10M4D3I10M", genome[500:510], 5)
    assert alignments.where("qname = 'span'").first().rname is None
    assert bam.alignments(spark, files, "c1", 9000, 9001).where("sample = 'flat'").count() == 21
    assert {(r.rname, r.length) for r in bam.contig_lengths(spark, files).collect()} == set(CONTIGS)


def blocks_of(alignments):
    return reads.blocks(reads.usable(alignments)).withColumnRenamed("rname", "chrom")


def test_coverage_run(spark, alignments, regions):
    blocks = blocks_of(alignments)
    found = pipelines.coverage(blocks, regions, "reference", 500)
    got = {(r.sample, r.locus): r for r in found.collect()}
    assert got["dup", "target"].rcn == pytest.approx(2.0) and got["flat", "target"].rcn == pytest.approx(1.0)
    assert got["flat", "target"].median == 20.0 and got["flat", "target"].covered_bases == 2000
    spans = intervals.locus_span(regions)
    plot = intervals.proportional_interval(spans, 2)
    track = pipelines.tracks(blocks, found, plot, "reference", 51, width=500)
    assert {(r.sample, r.locus) for r in track.select("sample", "locus").distinct().collect()} == {("dup", "target")}
    cuts = [r.position for r in pipelines.copy_breakpoints(track, spans, n_bkps=2).orderBy("breakpoint_number").collect()]
    assert abs(cuts[0] - 8000) < 120 and abs(cuts[1] - 12_000) < 120
    again = [r.position for r in pipelines.copy_breakpoints(track, spans, algo="Chunked", n_bkps=2).orderBy("breakpoint_number").collect()]
    assert abs(again[0] - 8000) < 120 and abs(again[1] - 12_000) < 120
    pooled = [r.position for r in pipelines.copy_breakpoints(track, spans, pooled=True, n_bkps=2).orderBy("breakpoint_number").collect()]
    assert pooled == cuts
    own = track.where("sample = 'dup' AND locus = 'target'").toPandas().sort_values("rn")
    smooth = lambda s: s.rolling(51, center=True, min_periods=1).median()
    far = own[(smooth(own["moving_average"]) - smooth(own["norm"])).abs() > 0.2]
    starts = far["pos"][far["pos"].diff().isna() | (far["pos"].diff() > 1)].tolist()
    assert sorted(r.start for r in pipelines.rolling_breakpoints(track, 0.2, 51).where("sample = 'dup'").collect()) == starts
    assert pipelines.packed(found).where("sample = 'dup' AND locus = 'target'").first().cell.endswith(";2000;2.0")


def test_junction_run(spark, alignments, genome):
    points = spark.createDataFrame([("dup", "c1", 8000, 1), ("dup", "c1", 12_000, 2)], "sample string, chromosome string, position long, breakpoint_number int")
    found = pipelines.junctions(alignments, points, 30, 100, reads.symmetric_pairs(spark.sql("SELECT 1 AS source, 2 AS target")), True)
    clips = found["clips"].collect()
    assert len(clips) == 12
    assert {r.clip_position for r in clips if r.side == "R"} == {12_000} and {r.clip_position for r in clips if r.side == "L"} == {8001}
    modes = {r.breakpoint: (r.mode, r.offset) for r in pipelines.clip_modes(found["clips"].withColumn("ord", F.monotonically_increasing_id()), points).collect()}
    assert modes == {1: (8001, 1), 2: (12_000, 0)}
    assert {r.breakpoint_bridge for r in found["bridges"].collect()} == {"1-2", "2-1"} and found["bridges"].count() == 12
    got = {(r.read, r.b1, r.b2) for r in found["reads"].collect()}
    assert ("span", 1, 2) in got or ("span", 2, 1) in got
    assert pipelines.softclips(alignments, points, 30, 100).where("side = 'R'").select("clip_position").distinct().first()[0] == 12_001
    text = sinks.clip_fasta(found["clips"]).first().value
    assert text.startswith(">c1:") and "\n" in text
    assert len(sinks.clip_table(found["clips"]).columns) == 10
    fastq = sinks.junction_fastq(found["reads"], alignments).where("value LIKE '@dup:span%'").first().value.split("\n")
    assert len(fastq) == 4 and set(fastq[3]) == {"?"} and len(fastq[1]) == len(fastq[3])


def test_runs_over_an_indexed_file_equal_those_over_all_records(spark, alignments, tmp_path):
    """Clips, inserts, bridges and junction reads from the blocks of the breakpoints and the unmapped tail alone."""
    rows = [r.asDict(recursive=True) for r in alignments.where("sample = 'dup'").collect()]
    rows.sort(key=lambda r: (r["rname"] is None, r["pos0"]))
    path = f"{tmp_path}/dup.bam"
    bam.write_bam(path, CONTIGS, rows)
    bam.write_index(path)
    points = spark.createDataFrame([("dup", "c1", 8000, 1), ("dup", "c1", 12_000, 2)], "sample string, chromosome string, position long, breakpoint_number int")
    pairs = reads.symmetric_pairs(spark.sql("SELECT 1 AS source, 2 AS target"))
    whole = pipelines.junctions(bam.alignments(spark, [path]), points, 30, 100, pairs, True)
    near = bam.alignments(spark, [path], regions=pipelines.read_regions(points, 100, True))
    assert near.count() < len(rows)
    part = pipelines.junctions(near, points, 30, 100, pairs, True, bam.alignments(spark, [path], unmapped=True))
    for name, df in whole.items():
        own = sorted(map(str, df.collect()))
        assert own == sorted(map(str, part[name].collect())) and own, name
    muts = spark.createDataFrame([("m", "c1", 100), ("n", "c2", 3)], "mutation_id string, chrom string, pos0 long")
    cells = lambda df: sorted(map(str, pipelines.genotypes(df, muts, samples=points.select("sample").distinct()).collect()))
    assert cells(bam.alignments(spark, [path], regions=[("c1", 99, 101), ("c2", 2, 4)])) == cells(bam.alignments(spark, [path]))


def test_junction_reads_are_records(spark, genome):
    """Mates share a name and nothing else: only a record that holds clips of both breakpoints is a junction read."""
    a, b = genome[100:140], genome[300:340]
    both = genome[700:720] + a + genome[720:730] + b
    rows = [
        ("s", "mates", 0x1, "c1", 100, 0, "80M", genome[500:540] + a), ("s", "mates", 0x1, "c1", 300, 0, "80M", b + genome[540:580]),
        ("s", "one", 0x1, "c1", 310, 0, "90M", both + genome[900:910]), ("s", "one", 0x1, "c1", 120, 0, "100M", both), ("t", "other", 0x1, "c1", 120, 0, "100M", both),
        ("s", "clip1", 0x1, "c1", 100, 60, "40S60M", a + genome[100:160]), ("s", "clip2", 0x1, "c1", 300, 60, "40S60M", b + genome[300:360]),
    ]
    df = spark.createDataFrame([(*r[:5], r[4] + 80, r[5], r[6], "c1", r[4] + 10, r[7]) for r in rows], "sample string, qname string, flag int, rname string, pos0 long, end0 long, mapq int, cigar_str string, rnext string, pnext0 long, seq string")
    df = df.withColumn("cigar", reads.parse_cigar(F.col("cigar_str"))).withColumn("quals", F.lit(None).cast("array<int>"))
    points = spark.createDataFrame([("s", "c1", 100, 1), ("s", "c1", 300, 2), ("t", "c1", 100, 1)], "sample string, chromosome string, position long, breakpoint_number int")
    found = pipelines.junctions(df, points, 30, 30, None, True)["reads"].collect()
    assert [(r.sample, r.read, r.b1, r.b2, r.place.pos0) for r in found] == [("s", "one", 1, 2, 120)]
    assert found[0].marked == both[:20].lower() + a + both[60:70].lower() + b


def test_reports(spark):
    inserts = spark.createDataFrame([("s", 1, x) for x in [400] * 5 + [99_000]] + [("s", 2, 700)], "sample string, breakpoint int, insert_size long")
    points = spark.createDataFrame([(1, 1000, 0), (2, 9000, 1), (2, 5000, 2)], "breakpoint_number int, position long, ord long")
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "source int, target int")
    counts, bins = pipelines.insert_report(pipelines.insert_lists(inserts, pairs), points)
    assert [tuple(r) for r in counts.collect()] == [("s", 1, 2, 7, 6, 1, 4500)]
    assert bins.agg(F.sum("n")).first()[0] == 6
    alone, _ = pipelines.insert_report(pipelines.insert_lists(inserts), points, True)
    assert sorted((r.sample, r.b1, r.n, r.plausible) for r in alone.collect()) == [("pooled", 1, 6, 6), ("pooled", 2, 1, 1)]
    clips = spark.createDataFrame([("s", 1, 990, 990, -10), ("s", 1, 995, 1003, 3), ("t", 1, 996, 1003, 3), ("t", 1, 997, 990, -10)], "sample string, breakpoint int, position long, clip_position long, relative_position long")
    at, modes = pipelines.clip_report(clips, points, True)
    assert sorted((r.clip_position, r.n) for r in at.collect()) == [(990, 2), (1003, 2)]
    assert [(r.mode, r.n, r.predicted, r.offset) for r in modes.collect()] == [(990, 2, 1000, -10)]
    got = pipelines.clip_density(clips).toPandas()
    assert set(got["sample"]) == {"s", "t"} and abs(got[got["sample"] == "s"].sort_values("x").pipe(lambda d: (d["density"] * d["x"].diff().fillna(0)).sum()) - 1) < 0.1


def test_base_depth_counts_bases_of_quality(spark, alignments):
    windows = spark.createDataFrame([("dup", "a", "c1", 495, 530), ("dup", "b", "c1", 520, 526)], "sample string, locus string, chrom string, w_start long, w_end long")
    steps = pipelines.base_depth(alignments, windows, ["sample", "locus"])
    got = {(r.locus, r.pos): r.depth for r in intervals.per_position(steps, ["locus"]).collect()}
    assert steps.count() < len(got)
    want = {}
    for r in alignments.where("sample = 'dup' AND rname = 'c1' AND pos0 < 530 AND end0 > 495 AND flag & 1796 = 0").collect():
        at, q = r.pos0, 0
        for c in r.cigar:
            for k in range(c["len"]):
                if c["op"] == 0 and (r.quals or [255] * 999)[q + k] >= 13:
                    for name, lo, hi in (("a", 495, 530), ("b", 520, 526)):
                        if lo <= at + k < hi:
                            want[name, at + k] = want.get((name, at + k), 0) + 1
            at += c["len"] if c["op"] in (0, 2) else 0
            q += c["len"] if c["op"] in (0, 1, 4) else 0
    assert got == want


def test_coverage_index_adds_up(spark):
    r = random.Random(4)
    runs = [("s", a, a + r.randint(1, 90), r.randint(1, 9)) for a in range(0, 5000, 100) if r.random() < 0.8] + [("t", 10, 40_000, 3)]
    df = spark.createDataFrame(runs, "k string, start long, end long, depth long")
    for chunk in (64, 1 << 14):
        index = intervals.coverage_index(df, ["k"], chunk)
        spans = [("s", a, a + n) for a in (0, 63, 64, 777, 4900) for n in (1, 64, 1000)] + [("t", 5, 39_999), ("t", 39_999, 50_000), ("t", 5, 5), ("u", 0, 9)]
        got = {(x.k, x.a, x.b): x.n for x in intervals.covered(index, spark.createDataFrame(spans, "k string, a long, b long"), ["k"], "a", "b", "n", chunk).collect()}
        for k, a, b in spans:
            assert got.get((k, a, b), 0) == sum(max(0, min(e, b) - max(s, a)) * d for key, s, e, d in runs if key == k)


def test_genotypes(spark, alignments, genome, tmp_path):
    p = tmp_path / "mutations.tsv"
    p.write_text("c1 101 first\nc1 506\nc2 3 nothing\n")
    got = {(r.mutation_id, r.sample): r.cell for r in pipelines.genotypes(alignments, tables.mutations(spark, str(p))).collect()}
    base = genome[100]
    assert f"{base}=20" in got["c1:101:first", "flat"] and got["c1:101:first", "flat"].endswith("depth=20")
    assert got["c1:506:noname", "flat"].endswith("depth=20")  # one of 21 bases there is of low quality
    assert got["c2:3:nothing", "dup"] == "NA"


def test_text_tables(spark, tmp_path):
    p = tmp_path / "regions.tsv"
    p.write_text("# note\n\nc1\t5\t9\tb\nc1\t1\t3\ta\nbad line\nc2\t20\t30\tb\n")
    assert [(r.locus, r.chrom, r.start, r.end) for r in tables.regions(spark, str(p)).orderBy("ord").collect()] == [("b", "c1", 5, 9), ("a", "c1", 1, 3), ("b", "c2", 20, 30)]
    assert tables.bad_regions(spark, str(p)).count() == 1
    assert {(r.locus, r.chrom, r.start, r.end) for r in intervals.locus_span(tables.regions(spark, str(p))).collect()} == {("b", "c1", 5, 30), ("a", "c1", 1, 3)}
    p = tmp_path / "plot.tsv"
    p.write_text("a\tc1:1-10\na\tc:1:5-20\n")
    assert tables.plot_intervals(spark, str(p)).collect()[0][:] == ("a", "c:1", 5, 20)
    p = tmp_path / "list.txt"
    p.write_text("/x/y/one.bam\n\nz/two.bam\n")
    assert [r.sample for r in tables.samples(spark, str(p)).orderBy("ord").collect()] == ["one", "two"]
    d = tmp_path / "run"
    d.mkdir()
    with pytest.raises(FileNotFoundError):
        tables.breakpoints(spark, str(d))
    (d / "x_breakpoints.tsv").write_text("bam_file\tlocus\tchromosome\tposition\tbreakpoint_number\tmethod\ns\tl\tc1\t77\t1\tm\n")
    assert tables.breakpoints(spark, str(d)).first().position == 77
    (d / "y_breakpoints.tsv").write_text("bam_file\n")
    with pytest.raises(ValueError):
        tables.breakpoints(spark, str(d))
    assert {(r.source, r.target) for r in tables.pairs(spark, ["1-2", "3-3"]).collect()} == {(1, 2), (2, 1), (3, 3)}
    assert tables.pairs(spark, None) is None
    with pytest.raises(ValueError):
        tables.pairs(spark, ["1"])
    h = tmp_path / "hits.txt"
    h.write_text("q_1_L\tc1\t98.4\t64\t1\t0\t1\t64\t10\t73\t6.53e-25\t113\n")
    assert tables.hits(spark, str(h)).first().send == 73


def test_sinks(spark, tmp_path):
    from datetime import date

    assert sinks.run_folder("out/run.tsv", date(2024, 1, 2)) == "StrandRun-run-2024-01-02"
    assert sinks.parsed_path("/d/m.tsv", "p", ["RCN"], ("ace", ">", 1.5), "list") == "/d/p_RCN_ace_gt_1.5.txt"
    wide = spark.createDataFrame([("b", "1;2")], "locus string, s string")
    sinks.write_matrix(wide, f"{tmp_path}/m.tsv", ["made", "format"])
    assert tables.matrix(spark, f"{tmp_path}/m.tsv").first()[:] == ("b", "1;2")
    sinks.write_tsv(spark.createDataFrame([("a", None), ("A", 2.5)], "x string, y double").repartition(3), f"{tmp_path}/t.tsv", order=["x"])
    assert (tmp_path / "t.tsv").read_text() == "x\ty\nA\t2.5\na\tNone\n"
    sinks.write_tsv(spark.createDataFrame([], "x string, y double"), f"{tmp_path}/t.tsv")
    assert (tmp_path / "t.tsv").read_text() == "x\ty\n"


def test_named_files_come_whole_or_not_at_all(spark, tmp_path):
    rows = spark.range(300).select(F.concat(F.lit("f"), F.col("id") % 7).alias("name"), F.col("id").cast("string").alias("value"), "id").repartition(5)
    sinks.write_named(rows, str(tmp_path), ["id"])
    assert sorted(os.listdir(tmp_path)) == [f"f{k}" for k in range(7)]
    assert (tmp_path / "f3").read_text().split() == [str(x) for x in range(3, 300, 7)]
    before = {p.name: p.read_text() for p in tmp_path.iterdir()}
    late = F.when(F.col("id") == 299, F.raise_error(F.lit("late"))).otherwise(F.lit("new"))
    for broken in (rows.withColumn("value", late.cast("string")), rows.withColumn("name", F.when(F.col("id") == 5, F.lit("a/b")).otherwise(F.col("name")))):
        with pytest.raises(Exception):
            sinks.write_named(broken, str(tmp_path), ["id"])
        assert {p.name: p.read_text() for p in tmp_path.iterdir()} == before


def test_probe_groups(spark):
    runs = [(s, "l", a, a + 100, d) for s, base in (("s1", 10), ("s2", 10), ("s3", 30)) for a in range(0, 6000, 100) for d in [base if a < 3000 else 12]]
    df = spark.createDataFrame(runs, "sample string, locus string, start long, end long, depth long")
    spans = df.select("sample", "locus").distinct().withColumns({"start": F.lit(2900).cast("long"), "end": F.lit(3100).cast("long"), "ref_median": F.lit(11.0)})
    got = {r.sample: r for r in pipelines.probe_groups(df, spans, 1.0, size=50, spacing=200, each_side=8).collect()}
    assert got["s1"].cluster == got["s2"].cluster == 0 and got["s3"].cluster == 1 and len(got["s1"].profile) == 17
    table = sinks.probe_table(spark.createDataFrame([("s", 1, [0.5, 1.23456])], "sample string, cluster int, profile array<double>"), 1.0, [100, 200]).first()
    assert table[:] == ("s", 1, "01", 0.5, 1.235)
    assert stats.candidates(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "locus string, rcn double"), force=True, norm_locus="a").count() == 1
