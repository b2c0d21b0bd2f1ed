"""Local alignment hits: the filter by breakpoints. For the hits themselves see alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.intervals import range_join


def breakpoint_of(qseqid: Column) -> Column:
    """The number in the first _digits_ of a sequence id, or null."""
    return F.nullif(F.regexp_extract(qseqid, "_([0-9]+)_", 1), F.lit("")).try_cast("int")


def near_other_breakpoint(hits: DataFrame, breakpoints: DataFrame, extension: int, pairs: DataFrame | None = None, width: int = 10_000) -> DataFrame:
    """Hits, each once, that overlap the closed window of a breakpoint other than their own on the same sequence.

    hits: ord, qseqid, sseqid, sstart, send, ... breakpoints: breakpoint_number, chromosome, position. pairs: source, target
    that are allowed; none: all.
    """
    own = hits.withColumns({"source": breakpoint_of(F.col("qseqid")), "h_start": F.least("sstart", "send"), "h_end": F.greatest("sstart", "send") + 1})
    windows = breakpoints.select(F.col("chromosome").alias("sseqid"), F.col("breakpoint_number").alias("target"), (F.col("position") - extension).alias("r_start"), (F.col("position") + extension + 1).alias("r_end"))
    met = range_join(own, windows, ["sseqid"], width, ("h_start", "h_end")).where("source != target")
    if pairs is not None:
        met = met.join(pairs, ["source", "target"], "left_semi")
    return hits.join(met.select("ord").distinct(), "ord", "left_semi")
