"""Locus statistics, normalisation, counts, histograms, modes and densities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def locus_stats(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean, sd (sample; 0 for one base), median, covered_bases over runs (start, end, depth), each base counting once."""
    n, d = F.col("end") - F.col("start"), F.col("depth").cast("double")
    sums = runs.groupBy(*keys).agg(F.sum(n).cast("long").alias("covered_bases"), F.sum(d * n).alias("s"), F.sum(d * d * n).alias("q"), F.percentile("depth", 0.5, n).alias("median"))
    mean = F.col("s") / F.col("covered_bases")
    var = (F.col("q") - F.col("s") * mean) / (F.col("covered_bases") - 1)
    sd = F.when(F.col("covered_bases") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0)
    return sums.select(*keys, mean.alias("mean"), sd.alias("sd"), F.col("median").cast("double").alias("median"), "covered_bases")


def normalise(stats: DataFrame, norm_locus: str) -> DataFrame:
    """stats (sample, locus, median, ...) with rcn: median over that of the sample's norm locus. Samples without one go."""
    ref = stats.where((F.col("locus") == norm_locus) & F.col("median").isNotNull()).select("sample", F.col("median").alias("ref_median"))
    return stats.join(ref, "sample").withColumn("rcn", F.col("median") / F.col("ref_median")).drop("ref_median")


def candidates(stats: DataFrame, threshold: float = 1.4, force: bool = False, norm_locus: str | None = None) -> DataFrame:
    """Loci above the threshold, or with force all but the norm locus."""
    return stats.where(F.col("locus") != norm_locus) if force else stats.where(F.col("rcn") > threshold)


def nucleotide_counts(bases: DataFrame, keys: list[str], min_quality: int = 13) -> DataFrame:
    """keys, a, c, g, t, depth over rows (base, quality); other letters and low qualities don't count."""
    ok = F.col("quality") >= min_quality
    counts = [F.count_if((F.col("base") == b) & ok).alias(b.lower()) for b in "ACGT"]
    return bases.groupBy(*keys).agg(*counts).withColumn("depth", F.col("a") + F.col("c") + F.col("g") + F.col("t"))


def region_median(track: DataFrame, start: int, end: int, value: str = "depth") -> DataFrame:
    """median of a track over [start, end); 0.0 if it has no rows there."""
    return track.where((F.col("pos") >= start) & (F.col("pos") < end)).agg(F.coalesce(F.median(value), F.lit(0.0)).alias("median"))


def mode_first(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, mode, n: the most frequent value, of ties the one met first in `order`."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"), F.max("n").alias("n"))


def mode_offset(modes: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    return modes.join(predicted, keys).withColumn("offset", F.col("mode") - F.col("predicted"))


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, bin, low, high, n: min(100, max(10, floor(sqrt(n)))) equal bins from least to greatest, the last one closed."""
    edge = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.count("*").alias("m"))
    edge = edge.withColumn("k", F.least(F.lit(100), F.greatest(F.lit(10), F.floor(F.sqrt("m"))))).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("k"))
    at = F.when(F.col("w") > 0, F.least(F.floor((F.col(value) - F.col("lo")) / F.col("w")), F.col("k") - 1)).otherwise(0)
    rows = df.where(F.col(value).isNotNull()).join(edge, keys).groupBy(*keys, at.cast("int").alias("bin"), "lo", "w").agg(F.count("*").alias("n"))
    return rows.select(*keys, "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n")


def scott_bandwidth(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.stddev_samp(value) * F.pow(F.count(value), F.lit(-0.2))).alias("h"))


#: Bins of a bandwidth: the error of sharing a value between two of them is below 1e-6 of the greatest density.
FINE = 512


def _binned(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, low, high, h, m and a row per bin met: bin, near, far, the weights its values give to it and to the next one.

    Bins are as wide as FINE of them fill a bandwidth, from the least value on. Values are counted before they meet their bandwidth.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    # moments of the distinct values, by their numbers: what a group has of them is small against its rows
    spread = scott_bandwidth(df, keys, value).join(counts.groupBy(*keys).agg(F.min("_x").alias("low"), F.max("_x").alias("high"), F.sum("_c").alias("m")), keys).where("h > 0")
    at = (F.col("_x") - F.col("low")) / F.col("h") * FINE
    rows = counts.join(spread, keys).withColumn("_at", at).withColumn("bin", F.floor("_at"))
    share = F.col("_at") - F.col("bin")
    return rows.groupBy(*keys, "low", "high", "h", "m", "bin").agg(F.sum(F.col("_c") * (1 - share)).alias("near"), F.sum(F.col("_c") * share).alias("far"))


def _weights(pdf) -> np.ndarray:
    out = np.zeros(int(pdf["bin"].max()) + 2)
    out[pdf["bin"]] += pdf["near"]
    out[pdf["bin"] + 1] += pdf["far"]
    return out


def kde(df: DataFrame, keys: list[str], value: str, grid: list[float]) -> DataFrame:
    """keys, x, density: a Gaussian kernel density with Scott's bandwidth on a fixed grid, from linearly binned values."""
    binned = _binned(df, keys, value)
    schema = binned.select(*keys, F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).schema

    def run(pdf):
        first, weights = pdf.iloc[0], _weights(pdf)
        at = first["low"] + np.arange(len(weights)) * first["h"] / FINE
        held = weights > 0
        found = [float((weights[held] * np.exp(-(((x - at[held]) / first["h"]) ** 2) / 2)).sum() / (first["m"] * first["h"] * math.sqrt(2 * math.pi))) for x in grid]
        return pd.DataFrame({**{k: [first[k]] * len(grid) for k in keys}, "x": [float(x) for x in grid], "density": found})

    return binned.groupBy(*keys).applyInPandas(run, schema)


def density(df: DataFrame, keys: list[str], value: str, points: int = 200) -> DataFrame:
    """keys, x, density on a grid of each group's own, three bandwidths beyond its values, by convolving its bins with the kernel."""
    binned = _binned(df, keys, value)
    schema = binned.select(*keys, F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).schema

    def run(pdf):
        first, weights = pdf.iloc[0], _weights(pdf)
        h, reach = first["h"], 9 * FINE
        kernel = np.exp(-((np.arange(-reach, reach + 1) / FINE) ** 2) / 2)
        size = len(weights) + len(kernel) - 1
        n = 1 << (size - 1).bit_length()
        smooth = np.fft.irfft(np.fft.rfft(weights, n) * np.fft.rfft(kernel, n), n)[:size] / (first["m"] * h * math.sqrt(2 * math.pi))
        # places of the grid among the bins; the density between two of them is all but straight
        x = np.linspace(first["low"] - 3 * h, first["high"] + 3 * h, points)
        found = np.interp((x - first["low"]) / h * FINE + reach, np.arange(size), np.maximum(smooth, 0.0))
        return pd.DataFrame({**{k: [first[k]] * points for k in keys}, "x": x, "density": found})

    return binned.groupBy(*keys).applyInPandas(run, schema)


def insert_plausibility(inserts: DataFrame, keys: list[str], p1: str = "p1", p2: str = "p2", library: int = 500) -> DataFrame:
    """keys, n, plausible, outliers: inserts up to the expected size plus a tenth of the duplication."""
    dup = F.abs(F.col(p2) - F.col(p1))
    ok = F.col("insert_size") <= dup + library + 0.1 * dup
    return inserts.groupBy(*keys).agg(F.count("insert_size").alias("n"), F.count_if(ok).alias("plausible"), F.count_if(~ok).alias("outliers"))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per keys, the first in order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_by_number(breakpoints: DataFrame) -> DataFrame:
    """One row per breakpoint_number, whatever its sample and locus: the last by ord."""
    rest = [c for c in breakpoints.columns if c != "breakpoint_number"]
    return breakpoints.groupBy("breakpoint_number").agg(F.max_by(F.struct(*rest), "ord").alias("r")).select("breakpoint_number", "r.*")
