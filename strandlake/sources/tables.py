"""Text tables that the engine reads: regions, intervals, sample lists, mutations, breakpoints, matrices, hits and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tabular alignment hits, breakpoints.
HITS = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart bigint, send bigint, evalue double, bitscore double"
BREAKPOINTS = "bam_file string, locus string, chromosome string, position bigint, breakpoint_number int, method string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value and ord, the place of each line, for small configuration files."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("ord", "value"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    """locus, chrom, start, end, ord of a four-column file. Blank lines and comments are skipped; see bad_regions() for the rest."""
    rows = _lines(spark, path).where("trim(value) != '' AND value NOT LIKE '#%'").withColumn("f", F.split("value", "\t")).where(F.size("f") == 4)
    return rows.select(F.col("f")[3].alias("locus"), F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end"), "ord")


def bad_regions(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a region file that don't have four fields."""
    return _lines(spark, path).where("trim(value) != '' AND value NOT LIKE '#%'").where(F.size(F.split("value", "\t")) != 4)


def plot_intervals(spark: SparkSession, path: str) -> DataFrame:
    """locus, chrom, plot_start, plot_end; the last line of a locus wins, and a line of other than two fields is an error."""
    fields = F.split("value", "\t")
    rows = _lines(spark, path).where("trim(value) != ''").withColumn("f", F.when(F.size(fields) == 2, fields).otherwise(F.raise_error(F.concat(F.lit("not two fields: "), "value"))))
    last = rows.groupBy(F.col("f")[0].alias("locus")).agg(F.max_by(F.col("f")[1], "ord").alias("r"))
    return last.select("locus", F.regexp_extract("r", r"^(.*):(\d+)-(\d+)$", 1).alias("chrom"), F.regexp_extract("r", r"^(.*):(\d+)-(\d+)$", 2).cast("long").alias("plot_start"), F.regexp_extract("r", r"^(.*):(\d+)-(\d+)$", 3).cast("long").alias("plot_end"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """path, sample (base name without .bam), ord."""
    rows = _lines(spark, path).where("trim(value) != ''")
    return rows.select(F.trim("value").alias("path"), F.regexp_replace(F.element_at(F.split(F.trim("value"), "/"), -1), r"\.bam$", "").alias("sample"), "ord")


def mutations(spark: SparkSession, path: str) -> DataFrame:
    """mutation_id (chrom:pos:name), chrom, pos0, name."""
    rows = _lines(spark, path).where("trim(value) != ''").withColumn("f", F.split("value", r"\s+"))
    name = F.coalesce(F.get("f", F.lit(2)), F.lit("noname"))
    return rows.select(F.concat_ws(":", F.col("f")[0], F.col("f")[1], name).alias("mutation_id"), F.col("f")[0].alias("chrom"), (F.col("f")[1].cast("long") - 1).alias("pos0"), name.alias("name"))


def breakpoints(spark: SparkSession, path: str) -> DataFrame:
    """The breakpoints table of a file, or of the only *_breakpoints.tsv of a folder."""
    if not path.endswith(".tsv"):
        jvm = spark._jvm.org.apache.hadoop.fs
        pattern = jvm.Path(f"{path.rstrip('/')}/*_breakpoints.tsv")
        found = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(pattern) or []
        if not len(found):
            raise FileNotFoundError(f"no *_breakpoints.tsv in {path}")
        if len(found) > 1:
            raise ValueError(f"{len(found)} *_breakpoints.tsv in {path}")
        path = found[0].getPath().toString()
    return spark.read.schema(BREAKPOINTS).option("sep", "\t").option("header", True).csv(path)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """A packed matrix: locus and a column per sample."""
    return spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(path)


def hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular hits with ord, which follows the lines of each file."""
    return spark.read.schema(HITS).option("sep", "\t").csv(path).select(F.monotonically_increasing_id().alias("ord"), "*")


def pairs(spark: SparkSession, given: list[str] | str | None) -> DataFrame | None:
    """source, target, both ways round, of tokens N-M or of a file with source_bkp and target_bkp. None stays None."""
    if given is None:
        return None
    if isinstance(given, str):
        rows = spark.read.option("sep", "\t").option("header", True).schema("source_bkp int, target_bkp int").csv(given).toDF("source", "target")
    else:
        rows = spark.createDataFrame([tuple(map(int, t.split("-"))) for t in given], "source int, target int")
    return rows.union(rows.select("target", "source")).distinct()


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id (up to the first white space), seq of a FASTA file, split at its headers by the reader."""
    rows = spark.read.option("lineSep", ">").text(path).where("value != ''")
    head = F.regexp_extract("value", r"^([^\s]*)", 1)
    return rows.select(head.alias("id"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))
