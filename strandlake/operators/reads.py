"""Aligned reads: CIGAR arithmetic, soft clips, mates, bridging pairs and genotypes.

alignments: sample, qname, flag, rname, pos0, end0, mapq, cigar (array of op, len), cigar_str, rnext, pnext0, seq, quals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.intervals import range_join

#: CIGAR letters in the order of their codes, and those that use up the reference.
OPS, ON_REFERENCE, SOFT = "MIDNSHP=X", (0, 2, 3, 7, 8), 4


def parse_cigar(text: Column) -> Column:
    """An array of (op, len) from CIGAR text; null and * give null."""
    parts = F.filter(F.split(text, r"(?<=[MIDNSHP=X])"), lambda x: x != "")
    return F.when(text != "*", F.transform(parts, lambda x: F.struct((F.call_function("instr", F.lit(OPS), F.right(x, F.lit(1))) - 1).alias("op"), F.regexp_extract(x, r"^\d+", 0).try_cast("int").alias("len"))))


def reference_length(cigar: Column) -> Column:
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin(*ON_REFERENCE)), F.lit(0), lambda a, x: a + x["len"])


def usable(alignments: DataFrame, min_mapq: int = 20, drop_orphans: bool = True) -> DataFrame:
    """Reads that count for depth: mapped, of enough quality, no secondary, failed or duplicate ones, no mates of unmapped or improper pairs."""
    out = alignments.where((F.col("flag").bitwiseAND(0x704) == 0) & (F.col("mapq") >= min_mapq))
    return out.where((F.col("flag").bitwiseAND(1) == 0) | (F.col("flag").bitwiseAND(2) != 0)) if drop_orphans else out


def blocks(alignments: DataFrame, skips: bool = True) -> DataFrame:
    """A row per stretch of reference that a read covers, deletions included: sample, rname, start, end. skips: cut out N."""
    if not skips:
        return alignments.select("sample", "rname", F.col("pos0").alias("start"), F.col("end0").alias("end"))
    step = lambda a, x: F.struct((a["at"] + F.when(x["op"].isin(*ON_REFERENCE), x["len"]).otherwise(0)).alias("at"), F.when(x["op"].isin(0, 2, 7, 8), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + x["len"]).alias("end"))))).otherwise(a["out"]).alias("out"))
    none = F.struct(F.col("pos0").cast("int").alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("out"))
    parts = F.aggregate("cigar", none, step, lambda a: a["out"])
    return alignments.select("sample", "rname", F.explode(parts).alias("b")).select("sample", "rname", "b.start", "b.end")


def _aligned(pos: Column, cigar: Column) -> Column:
    """An array of (r, q, n): n bases from place q of the sequence are aligned to positions from r on."""
    step = lambda a, x: F.struct(
        (a["r"] + F.when(x["op"].isin(*ON_REFERENCE), x["len"]).otherwise(0)).alias("r"),
        (a["q"] + F.when(x["op"].isin(0, 1, 4, 7, 8), x["len"]).otherwise(0)).alias("q"),
        F.when(x["op"].isin(0, 7, 8), F.concat(a["out"], F.array(F.struct(a["r"].alias("r"), a["q"].alias("q"), x["len"].alias("n"))))).otherwise(a["out"]).alias("out"),
    )
    none = F.struct(pos.cast("int").alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<r: int, q: int, n: int>>").alias("out"))
    return F.aggregate(cigar, none, step, lambda a: a["out"])


def aligned_bases(alignments: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """sample, rname, the columns to keep, pos, base, quality of every base that is aligned to a position."""
    own = ["sample", "rname", *(keep or [])]
    rows = alignments.where("seq is not null").select(*own, "seq", "quals", F.explode(_aligned(F.col("pos0"), F.col("cigar"))).alias("b"))
    rows = rows.select(*own, "seq", "quals", "b", F.explode(F.sequence(F.lit(0), F.col("b.n") - 1)).alias("k"))
    return rows.select(*own, (F.col("b.r") + F.col("k")).alias("pos"), F.upper(F.substr("seq", F.col("b.q") + F.col("k") + 1, F.lit(1))).alias("base"), F.coalesce(F.get("quals", F.col("b.q") + F.col("k")).cast("int"), F.lit(255)).alias("quality"))


def good_stretches(alignments: DataFrame, keep: list[str], min_quality: int = 13) -> DataFrame:
    """The columns to keep, start, end of every stretch of aligned A, C, G and T of enough quality; missing qualities are enough.

    A row per stretch, not per base: the few bases that don't count cut a read's aligned blocks.
    """
    rows = alignments.where("seq is not null").withColumn("_b", F.split(F.upper("seq"), ""))
    spoilt = lambda i: ~F.coalesce(F.get("_b", i).isin(*"ACGT"), F.lit(False)) | (F.coalesce(F.get("quals", i).cast("int"), F.lit(255)) < min_quality)
    rows = rows.withColumn("_bad", F.filter(F.sequence(F.lit(0), F.char_length("seq") - 1), spoilt)).select(*keep, "_bad", F.explode(_aligned(F.col("pos0"), F.col("cigar"))).alias("x"))
    q, n = F.col("x.q"), F.col("x.n")
    rows = rows.select(*keep, "x", F.concat(F.array(q - 1), F.filter("_bad", lambda i: (i >= q) & (i < q + n)), F.array(q + n)).alias("_cuts"))
    pieces = F.zip_with(F.slice("_cuts", 1, F.size("_cuts") - 1), F.slice("_cuts", 2, F.size("_cuts") - 1), lambda a, b: F.struct((a + 1).alias("a"), b.alias("b")))
    shift = F.col("x.r") - q
    rows = rows.select(*keep, shift.alias("_d"), F.explode(F.filter(pieces, lambda p: p["a"] < p["b"])).alias("p"))
    return rows.select(*keep, (F.col("p.a") + F.col("_d")).cast("long").alias("start"), (F.col("p.b") + F.col("_d")).cast("long").alias("end"))


def valid(alignments: DataFrame, for_junctions: bool = True) -> DataFrame:
    """Reads with a CIGAR of one operation or more, and for junctions also with a sequence."""
    return alignments.where("seq is not null AND size(cigar) > 0") if for_junctions else alignments.where("size(cigar) > 0")


def insert_size(position: Column, mate: Column, same_chromosome: Column | None = None) -> Column:
    """Distance to the mate; null without a mapped mate or, where asked, on another chromosome."""
    return F.when(mate.isNotNull() & (same_chromosome if same_chromosome is not None else F.lit(True)), F.abs(position - mate))


def near_breakpoints(alignments: DataFrame, breakpoints: DataFrame, extension: int, width: int = 10_000) -> DataFrame:
    """Reads that overlap position ± extension of a breakpoint (sample, chromosome, position, breakpoint_number)."""
    windows = breakpoints.select("sample", F.col("chromosome").alias("rname"), F.col("breakpoint_number").alias("breakpoint"), F.col("position").alias("bkp_position"), F.greatest(F.lit(0), F.col("position") - extension).alias("r_start"), (F.col("position") + extension).alias("r_end"))
    return range_join(alignments, windows, ["sample", "rname"], width, ("pos0", "end0"))


def soft_clips(near: DataFrame, min_clip: int = 30, mode: str = "junctions") -> DataFrame:
    """A row per soft clip of min_clip bases or more at either end of a read.

    mode "junctions": right clips lie at the last aligned base, inserts need one chromosome. mode "softclips": right clips lie at
    position + query length - clip, and the mate position is 0-based.
    """
    junctions = mode == "junctions"
    pos = F.col("pos0") + 1
    mate = F.when(F.col("flag").bitwiseAND(8) == 0, F.col("pnext0") + (1 if junctions else 0))
    size = insert_size(pos, mate, F.col("rname") == F.col("rnext") if junctions else None)
    n = F.coalesce(F.char_length("seq"), F.lit(0))
    ends = []
    for side, at in (("L", 1), ("R", -1)):
        clip = F.element_at("cigar", at)
        where = pos if side == "L" else F.col("end0") if junctions else pos + n - clip["len"]
        text = F.left("seq", clip["len"]) if side == "L" else F.right("seq", clip["len"])
        ends.append(F.when((clip["op"] == SOFT) & (clip["len"] >= min_clip), F.struct(F.lit(side).alias("side"), where.cast("long").alias("clip_position"), text.alias("clip"))))
    rows = valid(near, junctions).withColumn("e", F.explode(F.array_compact(F.array(*ends))))
    return rows.select("sample", "qname", pos.alias("position"), "e.clip_position", F.when(F.col("e.side") == "L", "leftmost_clip").otherwise("rightmost_clip").alias("clip_end"), "cigar_str", mate.alias("mate_position"), size.alias("insert_size"), "rname", "r_start", "r_end", "breakpoint", (F.col("e.clip_position") - F.col("bkp_position")).alias("relative_position"), "e.side", "e.clip")


def softclip_counts(alignments: DataFrame, min_clip: int = 5) -> DataFrame:
    """rname, pos, n: soft clips by 0-based position, left ones at the read's start and right ones at its end."""
    ends = [F.when((F.element_at("cigar", at)["op"] == SOFT) & (F.element_at("cigar", at)["len"] >= min_clip), p) for at, p in ((1, F.col("pos0")), (-1, F.col("end0")))]
    rows = alignments.where("size(cigar) > 0").select("rname", F.explode(F.array_compact(F.array(*ends))).alias("pos"))
    return rows.groupBy("rname", "pos").agg(F.count("*").alias("n"))


def bridging_pairs(near: DataFrame, targets: DataFrame, width: int = 10_000) -> DataFrame:
    """Reads near one breakpoint whose mate, on the same chromosome, lies in the closed window of another.

    near: ord, sample, qname, rname, position, mate_position, breakpoint. targets: sample, target, t_ord, t_start, t_end; their
    chromosome isn't compared. Of several targets the first by t_ord counts.
    """
    points = near.drop("r_start", "r_end").where(F.col("mate_position").isNotNull()).withColumns({"m0": F.col("mate_position"), "m1": F.col("mate_position") + 1})
    closed = targets.select("sample", "target", "t_ord", F.col("t_start").alias("r_start"), (F.col("t_end") + 1).alias("r_end"))
    met = range_join(points, closed, ["sample"], width, ("m0", "m1")).where("target != breakpoint")
    first = Window.partitionBy("ord").orderBy("t_ord")
    met = met.withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    place = lambda p: F.concat_ws(":", "rname", F.col(p).cast("string"))
    return met.select(F.col("qname").alias("read_name"), F.col("qname").alias("mate_name"), place("position").alias("read_pos"), place("mate_position").alias("mate_pos"), F.abs(F.col("position") - F.col("mate_position")).alias("insert_size"), F.concat_ws("-", F.col("breakpoint").cast("string"), F.col("target").cast("string")).alias("breakpoint_bridge"))


def symmetric_pairs(pairs: DataFrame) -> DataFrame:
    """source, target either way round, each once."""
    return pairs.select("source", "target").union(pairs.select("target", "source")).distinct()
