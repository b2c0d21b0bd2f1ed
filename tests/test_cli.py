"""The command line over small files."""

import os

from strandlake.plans import cli

from .test_end_to_end import files, genome  # noqa: F401


def test_coverage_then_parse_then_junctions(spark, files, genome, tmp_path, monkeypatch):  # noqa: F811
    monkeypatch.chdir(tmp_path)
    (tmp_path / "bams.txt").write_text("\n".join(files) + "\n")
    (tmp_path / "regions.tsv").write_text("c1\t9000\t11000\ttarget\nc1\t2000\t6000\treference\n")
    (tmp_path / "muts.tsv").write_text("c1\t101\tfirst\n")
    folder = cli.main(["coverage", "-b", "bams.txt", "-r", "regions.tsv", "-n", "reference", "-o", "run", "--plot", "--plot-slw", "51", "--plot-auto", "--probe-size", "50", "--probe-spacing", "100", "--probe-drops", "3", "--max-extension", "6000", "--probe-profile", "--probe-profile-out", "--plot-pooled", "-bkp", "segmentation", "--mutation", "muts.tsv"], spark)
    assert sorted(os.listdir(folder)) == ["run_breakpoints.tsv", "run_coverage.tsv", "run_mutations.tsv", "run_parameters.tsv", "run_probe_rounds.tsv", "run_tracks.parquet", "target_probe_profiles.tsv"]
    assert open(f"{folder}/run_coverage.tsv").read().count("# ") == 6 and files[0] in open(f"{folder}/run_mutations.tsv").readline()
    assert open(f"{folder}/target_probe_profiles.tsv").readline().startswith("sample\tgroup\tprofile_string\tpos_")
    assert [x.split("\t")[0] for x in open(f"{folder}/target_probe_profiles.tsv")] == ["sample", "dup"]
    rounds = [x.split("\t") for x in open(f"{folder}/run_probe_rounds.tsv").read().splitlines()]
    assert rounds[0] == ["sample", "locus", "round", "side", "dropped", "empty", "stops"] and [x[2:4] for x in rounds[1:3]] == [["1", "left"], ["1", "right"]] and rounds[-1][6] == "true"
    assert "elapsed_seconds\t" in open(f"{folder}/run_parameters.tsv").read()
    plotted = spark.read.parquet(f"{folder}/run_tracks.parquet").toPandas()
    assert set(plotted["cluster"]) == {0} and sorted(plotted["breakpoint_number"].dropna()) == [1, 2] and sorted(plotted["pooled_breakpoint"].dropna()) == [1, 2]
    lines = open(f"{folder}/run_breakpoints.tsv").read().splitlines()
    assert len(lines) == 5 and sum(x.startswith("pooled") for x in lines) == 2
    (tmp_path / "more.tsv").write_text((tmp_path / "regions.tsv").read_text() + "c2\t10\t20\tempty\n")
    bare = cli.main(["coverage", "-b", "bams.txt", "-r", "more.tsv", "-n", "reference", "-o", "bare"], spark)
    assert "empty\tNA;NA;NA;NA;NA\tNA;NA;NA;NA;NA" in open(f"{bare}/bare_coverage.tsv").read()
    path = cli.main(["parse", "-i", f"{folder}/run_coverage.tsv", "--RCN", "--filter", "target:>:1.5"], spark)
    assert path.endswith("RCN_target_gt_1.5.tsv") and open(path).read().splitlines()[0] == "locus\tdup_RCN"
    path = cli.main(["parse", "-i", f"{folder}/run_coverage.tsv", "--RCN", "--filter-locus", "target", "--filter-op", "<", "--filter-value", "1.5", "--format", "list"], spark)
    assert open(path).read() == "flat.bam\n"
    (tmp_path / "genome.fa").write_text(f">c1 made here\n{genome[:10_000]}\n{genome[10_000:]}\n>c2\nACGT\n")
    out = cli.main(["junctions", "-b", "bams.txt", "-i", folder, "-o", f"{tmp_path}/j", "-e", "300", "--pairs", "1-2", "--junction", "--junction-fastq", "--reference", "genome.fa"], spark)
    assert {"j.tsv", "j_bridging_pairs.tsv", "j_soft_clipped_sequences.fasta", "dup_1-2_junction_reads.fasta", "dup_1-2_junction_reads.fastq"} <= set(os.listdir(tmp_path))
    assert {f"j_{x}.tsv" for x in ("inserts", "insert_bins", "clip_positions", "clip_modes", "pooled_inserts")} <= set(os.listdir(tmp_path))
    assert open(tmp_path / "j.tsv").readline().startswith("bam_file\tRead_name\t") and not [x for x in os.listdir(tmp_path) if x.startswith("_named")]
    found = [x.split("\t") for x in open(tmp_path / "j_hits.txt").read().splitlines()]
    # clips at one end of the duplication lie at its other end
    assert found and all(len(x) == 12 and x[1] == "c1" for x in found)
    left = [x for x in found if x[0].endswith("_L") and float(x[2]) == 100.0]
    assert left and all(abs(int(x[9]) - 12_000) <= 1 for x in left)
    assert len(open(tmp_path / "j_filtered_pairs.txt").read().splitlines()) <= len(found)
    (tmp_path / "pairs.tsv").write_text("source_bkp\ttarget_bkp\n1\t2\n")
    assert cli.main(["softclips", "-b", "bams.txt", "-i", folder, "-o", f"{tmp_path}/s", "-e", "300", "--pairs", "pairs.tsv"], spark) and out
    assert "s_clip_density.tsv" in os.listdir(tmp_path)
