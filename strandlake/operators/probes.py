"""Probes along a depth track: adaptive interval expansion, profiles, and clusters of binarised profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.intervals import coverage_index, covered

#: Positions of a chunk of the index that an expansion reads.
BASES = 1 << 14


def probe_grid(spans: DataFrame, size: int, spacing: int, each_side: int) -> DataFrame:
    """spans (start, end) with probe, centre, p_start, p_end: 2 * each_side + 1 windows about the middle of the span."""
    rows = spans.withColumn("probe", F.explode(F.sequence(F.lit(-each_side), F.lit(each_side))))
    rows = rows.withColumn("centre", F.floor((F.col("start") + F.col("end")) / 2) + F.col("probe") * spacing)
    first = F.greatest(F.lit(0), F.col("start") - each_side * spacing - size)
    return rows.withColumn("p_start", F.greatest(first, F.col("centre") - size // 2)).withColumn("p_end", F.col("p_start") + size)


def probe_profile(runs: DataFrame, spans: DataFrame, keys: list[str], ref_median: str, size: int = 500, spacing: int = 1000, each_side: int = 20, end: int | None = None) -> DataFrame:
    """keys, probe, centre, ratio: mean depth of each probe, zeros included, over the reference median; 0 where that isn't positive.

    runs: keys, start, end, depth. spans: keys, start, end and the reference median. Probes end with the contig, if its end is given.
    """
    grid = probe_grid(spans, size, spacing, each_side)
    if end is not None:
        grid = grid.withColumn("p_end", F.least("p_end", F.lit(end)))
    grid = grid.select(*keys, "probe", "centre", "p_start", "p_end", ref_median)
    sums = covered(coverage_index(runs, keys), grid, keys, "p_start", "p_end", "total")
    mean = F.coalesce("total", F.lit(0)) / (F.col("p_end") - F.col("p_start"))
    ratio = F.when((F.col("p_end") > F.col("p_start")) & (F.col(ref_median) > 0), mean / F.col(ref_median)).otherwise(0.0)
    return grid.join(sums, [*keys, "p_start", "p_end"], "left").select(*keys, "probe", "centre", ratio.alias("ratio"))


def profiles(probes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, profile: the ratios in the order of their probes."""
    return probes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("probe", "ratio"))), lambda x: x["ratio"]).alias("profile"))


def binarised(profile: Column, threshold: float) -> Column:
    return F.transform(profile, lambda r: (r > threshold).cast("int"))


def profile_string(profile: Column, threshold: float) -> Column:
    return F.array_join(F.transform(profile, lambda r: (r > threshold).cast("int").cast("string")), "")


def string_clusters(df: DataFrame, group: list[str], text: str, order: str) -> DataFrame:
    """df with cluster: from 0 by the first appearance of each string."""
    from pyspark.sql import Window

    first = df.groupBy(*group, text).agg(F.min(order).alias("_first"))
    named = first.withColumn("cluster", F.row_number().over(Window.partitionBy(*group).orderBy("_first")) - 1).drop("_first")
    return df.join(named, [*group, text])


def hamming(a: Column, b: Column) -> Column:
    """The share of places in which two arrays of equal length differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), lambda d: d == 1)) / F.size(a)


def hamming_pairs(df: DataFrame, group: list[str], sample: str, bits: str) -> DataFrame:
    """group, a, b, distance for all pairs of samples of a group; for the few samples of a locus."""
    a = df.select(*group, F.col(sample).alias("a"), F.col(bits).alias("x"))
    b = df.select(*group, F.col(sample).alias("b"), F.col(bits).alias("y"))
    return a.join(b, group).where("a < b").select(*group, "a", "b", hamming(F.col("x"), F.col("y")).alias("distance"))


def average_linkage(bits: np.ndarray, threshold: float) -> list[int]:
    """Labels from 0 by first member: the two nearest clusters merge while their average Hamming distance is below the threshold.

    Of equally near pairs the one with the earliest members merges. Equal strings are one weighted member. A cluster is the number of
    its members and of their ones at each place, which give its average distance to any other in whole numbers; so there is no table of
    distances, and each cluster only remembers its nearest later neighbour.
    """
    if len(bits) < 2:
        return [0] * len(bits)
    _, first, own = np.unique(np.packbits(bits.astype(bool), axis=1), axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    own = place[own.ravel()]
    n = np.bincount(own).astype(np.int64)
    ones = bits[first[order]].astype(np.int64) * n[:, None]
    totals, width, m = ones.sum(1), max(bits.shape[1], 1), len(n)
    live, label = np.ones(m, bool), np.arange(m)

    def distances(i: int, others: np.ndarray) -> np.ndarray:
        differ = n[i] * totals[others] + n[others] * totals[i] - 2 * (ones[others] @ ones[i])
        return differ / (n[i] * n[others] * width)

    near, gap = np.zeros(m, int), np.full(m, np.inf)

    def look(i: int) -> None:
        later = np.flatnonzero(live[i + 1 :]) + i + 1
        gap[i] = np.inf
        if len(later):
            d = distances(i, later)
            k = int(np.argmin(d))
            near[i], gap[i] = later[k], d[k]

    for i in range(m):
        look(i)
    while True:
        i = int(np.argmin(gap))
        if not gap[i] < threshold:
            break
        j = int(near[i])
        n[i] += n[j]
        ones[i] += ones[j]
        totals[i] += totals[j]
        live[j], gap[j] = False, np.inf
        label[label == j] = i
        for k in np.flatnonzero(live & ((near == i) | (near == j))):
            look(int(k))
        look(i)
        before = np.flatnonzero(live[:i])
        if len(before):  # the merged cluster may have come nearer to earlier ones than what they remember
            d = distances(i, before)
            closer = (d < gap[before]) | (d == gap[before]) & (i < near[before])
            near[before[closer]], gap[before[closer]] = i, d[closer]
    seen: dict[int, int] = {}
    return [seen.setdefault(int(x), len(seen)) for x in label[own]]


def hamming_clusters(df: DataFrame, group: list[str], sample: str, bits: str, threshold: float = 0.15) -> DataFrame:
    """df with cluster, per group of samples (ordered by sample)."""
    schema = df.select("*", F.lit(0).alias("cluster")).schema

    def kernel(pdf):
        pdf = pdf.sort_values(sample).reset_index(drop=True)
        pdf["cluster"] = average_linkage(np.array(pdf[bits].tolist()), threshold)
        return pdf

    return df.groupBy(*group).applyInPandas(kernel, schema)


class Track:
    """Mean depth of any window of a sparse track in constant time; the track ends at `end`."""

    def __init__(self, start: np.ndarray, end: np.ndarray, depth: np.ndarray, offset: int, stop: int):
        order = np.argsort(start)
        start, end, depth = np.clip(start[order], offset, stop), np.clip(end[order], offset, stop), depth[order]
        self.x = np.r_[offset, np.c_[start, end].ravel(), stop].astype(float)
        self.y = np.r_[0, np.c_[np.zeros(len(start)), (end - start) * depth].ravel(), 0].cumsum().astype(float)
        self.offset, self.stop = offset, stop

    def mean(self, start: np.ndarray, size: int) -> np.ndarray:
        a, b = start + self.offset, np.minimum(start + self.offset + size, self.stop)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(b > a, (np.interp(b, self.x, self.y) - np.interp(a, self.x, self.y)) / (b - a), np.nan)


def expand(track: Track, start: int, end: int, target: float, reference: float, size: int, spacing: int, number: int, drops: int, most: int | None, nulls: int = 3, factor: float = 2, symmetric: bool = False, max_spacing: int | None = None, trace: list | None = None) -> tuple[int, int]:
    """Widen [start, end) until `drops` consecutive probes on either side lie below the target's depth.

    The loop ends when both sides stop in one round, when the whole state comes back, or when both sides are pinned at the
    most that they may reach with nothing left to change. trace gets (round, side, probes below the reference, probes without depth,
    whether the side stops) of every round.
    """
    length, left, right = end - start, start, end
    calm = [0, 0]
    seen: set[tuple] = set()
    steps = np.arange(number)
    while (state := (left, right, *calm)) not in seen and len(seen) < 1_000_000:
        seen.add(state)
        gaps = [min(spacing * (1 + c), max_spacing or spacing * (1 + c)) for c in calm]
        starts = [np.maximum(0, left - (steps + 1) * gaps[0] - track.offset), np.maximum(0, right + steps * gaps[1] - track.offset)]
        stop, before = [], (left, right)
        for side in (0, 1):
            cov = track.mean(starts[side], size)
            low = np.flatnonzero(~(cov < target))
            stop.append(bool(np.diff(np.r_[-1, low, number]).max() > drops))
            dropped = int(((cov < reference) & (cov > 0)).sum())
            if trace is not None:
                trace.append((len(seen), "left" if side == 0 else "right", dropped, int((cov == 0).sum()), stop[side]))
            if stop[side]:
                calm[side] = 0
                continue
            empty = int((cov == 0).sum()) >= nulls
            by = 2 * length if empty else max(1, number * gaps[side])
            left, right = (max(0, left - by), right) if side == 0 else (left, right + by)
            if not empty:
                calm[side] = calm[side] + 1 if dropped == 0 else 0
        if most:
            left, right = max(start - most, left), min(end + most, right)
        if all(stop):
            break
        # a side that is pinned only spreads its probes further; once they lie beyond the track nothing can change any more
        span = track.stop - track.offset
        if (left, right) == before and all(s or g > span or g == max_spacing for s, g in zip(stop, gaps)):
            break
    if symmetric:
        by = max(start - left, right - end)
        left, right = start - by, end + by
    if right - left < length * factor:
        mid, half = (start + end) // 2, int(length * factor // 2)
        left, right = max(0, mid - half), mid + half
        if most:
            left, right = max(start - most, left), min(end + most, right)
    return int(left), int(right)


def expand_intervals(runs: DataFrame, loci: DataFrame, keys: list[str], size: int = 500, spacing: int = 1000, number: int = 20, drops: int = 10, most: int | None = 5_000_000, symmetric: bool = False, max_spacing: int | None = None, rounds: bool = False) -> DataFrame:
    """keys, plot_start, plot_end: every locus (start, end, target_cov, reference_cov) expanded over its own depth runs.

    rounds: instead, keys, round, side, dropped, empty, stops, what the probes of each round found.
    """
    reach = F.lit(most) if most else 10 * (F.col("end") - F.col("start"))
    windows = loci.select(*(F.col(k).alias(k) for k in keys), F.col("start").alias("l_start"), F.col("end").alias("l_end"), "target_cov", "reference_cov", F.greatest(F.lit(0), F.col("start") - reach).alias("w_start"), (F.col("end") + reach).alias("w_end"))
    # the locus gets a row per chunk of its window, whatever the depth
    near = coverage_index(runs, keys, BASES).join(windows.select(*(F.col(k).alias(k) for k in keys), "w_start", "w_end"), keys)
    near = near.where((F.col("c") * BASES < F.col("w_end")) & ((F.col("c") + 1) * BASES > F.col("w_start"))).select(*(F.col(k).alias(k) for k in keys), *(F.col("steps")[x].alias(x) for x in ("start", "end", "depth")))
    more = [F.lit(0).alias("round"), F.lit("").alias("side"), F.lit(0).alias("dropped"), F.lit(0).alias("empty"), F.lit(False).alias("stops")] if rounds else [F.lit(0).cast("long").alias("plot_start"), F.lit(0).cast("long").alias("plot_end")]
    schema = loci.select(*keys, *more).schema

    def kernel(track, locus):
        import pandas as pd

        out = []
        start, end, depth = (np.concatenate([*track[x], np.empty(0, np.int64)]) for x in ("start", "end", "depth"))
        for _, r in locus.iterrows():
            t = Track(start, end, depth, int(r["w_start"]), int(r["w_end"]))
            trace: list = []
            a, b = expand(t, int(r["l_start"]), int(r["l_end"]), r["target_cov"], r["reference_cov"], size, spacing, number, drops, most, symmetric=symmetric, max_spacing=max_spacing, trace=trace)
            out += [[*(r[k] for k in keys), *x] for x in (trace if rounds else [(a, b)])]
        return pd.DataFrame(out, columns=schema.names)

    return near.groupBy(*keys).cogroup(windows.groupBy(*keys)).applyInPandas(kernel, schema)
