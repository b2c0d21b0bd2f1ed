"""Files that the engine writes: matrices, breakpoints, clips, bridging pairs, hits and sequences."""

from __future__ import annotations

import os
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.matrix import FIELDS, OPERATORS


def run_folder(prefix: str, today: date | None = None) -> str:
    """The folder of a run, by the prefix's base name and the date."""
    base = os.path.splitext(os.path.basename(prefix))[0]
    return f"StrandRun-{base}-{(today or date.today()).isoformat()}"


def parsed_path(source: str, prefix: str | None, fields: list[str], condition: tuple[str, str, float] | None, fmt: str) -> str:
    """Beside the source: [prefix_]fields[_locus_op_value].tsv or .txt."""
    parts = ([prefix] if prefix else []) + fields + ([condition[0], OPERATORS[condition[1]], f"{condition[2]:g}"] if condition else [])
    return os.path.join(os.path.dirname(source), "_".join(parts) + (".tsv" if fmt == "tsv" else ".txt"))


def write_named(rows: DataFrame, folder: str, order: list[str] | None = None, header: str | None = None) -> None:
    """Files in folder: rows have a name, a value and columns of order. All of them, or none if a task fails.

    What makes the rows runs in as many tasks as it likes; rows of one name then go to one task, which streams them in order.
    """
    from strandlake.sources.named import NamedText

    rows.sparkSession.dataSource.register(NamedText)
    own = rows.repartition("name").sortWithinPartitions("name", *(order or [])).select("name", "value")
    writer = own.write.format("named_text").option("folder", os.path.abspath(folder) if "://" not in folder else folder)
    (writer.option("header", header) if header is not None else writer).mode("append").save()


def tsv_line(df: DataFrame, null: str = "None") -> Column:
    return F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null)) for c in df.columns))


def write_tsv(df: DataFrame, path: str, header: bool = True, null: str = "None", order: list[str] | None = None) -> None:
    """One file of tab-separated text of that name; there is one without rows too."""
    folder, name = os.path.split(path)
    first = "\t".join(df.columns) if header else None
    lines = df.select(F.lit(name).alias("name"), tsv_line(df, null).alias("value"), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order or [])))
    # a file without rows: a value that is null writes no line
    empty = lines.sparkSession.range(1).select(F.lit(name).alias("name"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema.fields[1:]))
    write_named(lines.unionByName(empty), folder or ".", [f"_o{k}" for k in range(len(order or []))], first)


def write_matrix(wide: DataFrame, path: str, comments: list[str]) -> None:
    """A wide matrix, of as many rows as loci, under comment lines."""
    rows = wide.toPandas()
    with open(path, "w") as f:
        f.writelines(f"# {c}\n" for c in comments)
        rows.to_csv(f, sep="\t", index=False)


def coverage_comments() -> list[str]:
    """What stands above a coverage matrix."""
    return [
        "coverage", f"Generated on: {datetime.now():%Y-%m-%d %H:%M}", "Format: " + ";".join(FIELDS), "uDOC: mean depth of coverage over the whole target span",
        "sdDOC: standard deviation of the depth, medDOC: its median", "CovBases: covered bases of the span, RCN: relative copy number",
    ]


def write_parameters(values: dict, path: str) -> None:
    """The parameters of a run, a line each."""
    with open(path, "w") as f:
        f.writelines(f"{k}\t{'' if v is None else v}\n" for k, v in sorted(values.items()))


def clip_id() -> Column:
    return F.concat(F.col("rname"), F.lit(":"), F.col("clip_position").cast("string"), F.lit("_"), F.col("qname"), F.lit("_"), F.col("breakpoint").cast("string"), F.lit("_"), F.col("side"))


def clip_fasta(clips: DataFrame) -> DataFrame:
    """value: FASTA entries of soft clips, ready for write.text."""
    return clips.select(F.concat(F.lit(">"), clip_id(), F.lit("\n"), F.col("clip")).alias("value"))


def region_text(chrom: Column, start: Column, end: Column) -> Column:
    return F.format_string("('%s', %d, %d)", chrom, start, end)


def clip_table(clips: DataFrame) -> DataFrame:
    """The ten columns of the clip table."""
    return clips.select(F.col("sample").alias("bam_file"), F.col("qname").alias("Read_name"), F.col("position").alias("Position"), F.col("clip_position").alias("Clipping_position"), F.col("clip_end").alias("Clipping_end"), F.col("cigar_str").alias("CIGAR"), F.col("mate_position").alias("Mate_position"), F.col("insert_size").alias("Insert_size"), region_text(F.col("rname"), F.col("r_start"), F.col("r_end")).alias("Region"), F.col("breakpoint").alias("Breakpoint"))


def _pair() -> Column:
    return F.concat_ws("-", F.col("b1").cast("string"), F.col("b2").cast("string"))


def _file(kind: str) -> Column:
    return F.concat("sample", F.lit("_"), _pair(), F.lit(kind))


def junction_fasta(reads: DataFrame) -> DataFrame:
    """name ({sample}_{b1}-{b2}_junction_reads.fasta), sample, pair, place, value: FASTA entries."""
    return reads.select(_file("_junction_reads.fasta").alias("name"), "sample", _pair().alias("pair"), "place", F.concat(F.lit(">"), F.concat_ws(":", "sample", "read", _pair()), F.lit("\n"), F.col("marked")).alias("value"))


def junction_fastq(reads: DataFrame, alignments: DataFrame) -> DataFrame:
    """name, sample, pair, pos0, value: a FASTQ entry for every record whose name has a junction, in the first one; missing qualities are 30."""
    first = reads.groupBy("sample", F.col("read").alias("qname")).agg(F.min_by(F.struct("b1", "b2"), F.struct("place", "ord")).alias("p")).select("sample", "qname", "p.b1", "p.b2")
    rows = alignments.where("seq is not null").join(first, ["sample", "qname"])
    quals = F.coalesce(F.array_join(F.transform("quals", lambda q: F.char(q + 33)), ""), F.repeat(F.lit("?"), F.char_length("seq")))
    return rows.select(_file("_junction_reads.fastq").alias("name"), "sample", _pair().alias("pair"), "pos0", F.concat(F.lit("@"), F.concat_ws(":", "sample", "qname", _pair()), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), quals).alias("value"))


def probe_table(profiles: DataFrame, threshold: float, centres: list[int]) -> DataFrame:
    """sample, group (-1 where there is none), profile_string, pos_{centre} rounded to three places."""
    from strandlake.operators.probes import profile_string

    cols = [F.round(F.get("profile", F.lit(k)), 3).alias(f"pos_{c}") for k, c in enumerate(centres)]
    return profiles.select("sample", F.coalesce("cluster", F.lit(-1)).alias("group"), profile_string(F.col("profile"), threshold).alias("profile_string"), *cols)


def probe_files(profiles: DataFrame, spans: DataFrame, threshold: float, spacing: int, each_side: int) -> DataFrame:
    """name ({locus}_probe_profiles.tsv), value, sample: the tables of all loci, each with its own centres in the first line."""
    from strandlake.operators.probes import profile_string

    name = F.concat("locus", F.lit("_probe_profiles.tsv"))
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    titles = F.transform(F.sequence(F.lit(-each_side), F.lit(each_side)), lambda k: F.concat(F.lit("pos_"), (middle + k * spacing).cast("string")))
    found = profiles.select("locus").distinct().join(spans, "locus")
    heads = found.select(name.alias("name"), F.concat_ws("\t", F.lit("sample"), F.lit("group"), F.lit("profile_string"), F.array_join(titles, "\t")).alias("value"), F.lit(None).cast("string").alias("sample"))
    ratios = F.array_join(F.transform("profile", lambda x: F.coalesce(F.round(x, 3).cast("string"), F.lit(""))), "\t")
    rows = profiles.select(name.alias("name"), F.concat_ws("\t", "sample", F.coalesce("cluster", F.lit(-1)).cast("string"), profile_string(F.col("profile"), threshold), ratios).alias("value"), "sample")
    return heads.unionByName(rows)
