"""Incremental forms: depth of coverage is a sum of interval ends, so batches of intervals only add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def depth_deltas(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, pos, d: the change of depth at each position, an aggregation that runs over a stream in complete or update mode.

    The running sum over pos of all deltas so far is the depth so far; see operators.intervals.depth_runs().
    """
    ends = F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d"))))
    return intervals.where(F.col(start) < F.col(end)).select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
