"""Moving windows, binning, shifts, islands and interpolation over ordered tracks (keys, pos, value).

Windows count rows, not positions, and are centred: w // 2 rows before and (w - 1) // 2 after. NaN never enters: null stands for it.
Tracks are worked on in chunks (see chunks): no task holds one, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import chunks
from strandlake.operators.intervals import range_join
from strandlake.shared import settled


def numbered(track: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """track with rn, from 1 by order."""
    rows = track.withColumn("_c", chunks.of(F.col(order)))
    rows = chunks.carry(rows, keys, {"_n": F.count("*")}, {"_b": lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(*chunks.BEFORE)), F.lit(0))})
    return rows.withColumn("rn", F.col("_b") + F.row_number().over(chunks.within(keys, order))).drop("_b", "_c")


def moving_median(track: DataFrame, keys: list[str], value: str, out: str, w: int) -> DataFrame:
    """track (with rn) with the centred median; windows at the ends are shorter."""
    return chunks.moving(track, keys, w, **{out: ("median", value)})


def moving_variance(track: DataFrame, keys: list[str], value: str, out: str, w: int) -> DataFrame:
    """track (with rn) with the centred sample variance; null where a window has one row."""
    return chunks.moving(track, keys, w, **{out: ("variance", value)})


def moving_covariance(track: DataFrame, keys: list[str], value: str, out: str, w: int) -> DataFrame:
    """The covariance of the moving mean and the moving variance, both over full windows only, over full windows of both."""
    return chunks.moving(track, keys, w, **{out: ("covariance", value)})


def rescale(track: DataFrame, keys: list[str], value: str, like: str) -> DataFrame:
    """value stretched to the range of `like`, shifted to a mean of 1, and null below 1."""
    parts = {"_lo": F.min(value), "_hi": F.max(value), "_nlo": F.min(like), "_nhi": F.max(like), "_sum": F.sum(value), "_n": F.count(value)}
    whole = {k: chunks.total(f, k) for k, f in zip(parts, (F.min, F.max, F.min, F.max, F.sum, F.sum))}
    rows = chunks.carry(track.withColumn("_c", chunks.of(F.col("pos"))), keys, parts, whole)
    stretched = lambda v: F.when(F.col("_hi") != F.col("_lo"), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (F.col("_nhi") - F.col("_nlo")) + F.col("_nlo")).otherwise(v)
    moved = stretched(F.col(value)) - stretched(F.col("_sum") / F.col("_n")) + 1
    return rows.withColumn("_s", moved).withColumn(value, F.when(F.col("_s") >= 1, F.col("_s"))).select(*track.columns)


def within_limits(track: DataFrame, keys: list[str], value: str, low: float | str, high: float | str) -> DataFrame:
    """Rows with low <= value <= high, numbered anew, so that later windows close over what went. 'min' and 'max' stand for a track's own."""
    rows = track.drop("rn").where(F.col(value).isNotNull())
    if low == "max" or high == "min":  # all but one value goes
        rows = rows.withColumn("_c", chunks.of(F.col("pos")))
        rows = chunks.carry(rows, keys, {"_lo": F.min(value), "_hi": F.max(value)}, {"_lo": chunks.total(F.min, "_lo"), "_hi": chunks.total(F.max, "_hi")})
    bound = {"min": F.col("_lo"), "max": F.col("_hi")}
    for limit, plain, ok in ((low, "min", lambda b: F.col(value) >= b), (high, "max", lambda b: F.col(value) <= b)):
        if limit != plain:  # every value is within its own least and greatest
            rows = rows.where(ok(bound[limit] if limit in bound else F.lit(float(limit))))
    return numbered(rows.drop("_c", "_lo", "_hi"), keys)


def bin_means(track: DataFrame, keys: list[str], size: int, values: list[str]) -> DataFrame:
    """values (pos too) replaced by their means over right-closed bins from the least position; tracks no longer than a bin stay."""
    rows = track.withColumn("_c", chunks.of(F.col("pos")))
    rows = chunks.carry(rows, keys, {"_lo": F.min("pos"), "_hi": F.max("pos")}, {"_lo": chunks.total(F.min, "_lo"), "_hi": chunks.total(F.max, "_hi")})
    rows = rows.withColumn("_bin", F.when(F.col("_hi") - F.col("_lo") > size, F.greatest(F.ceil((F.col("pos") - F.col("_lo")) / size) - 1, F.lit(0))))
    per_bin = Window.partitionBy(*keys, "_bin")
    means = {c: F.when(F.col("_bin").isNotNull(), F.avg(c).over(per_bin)).otherwise(F.col(c).cast("double")) for c in values}
    return rows.select(*(means.get(c, F.col(c)).alias(c) for c in track.columns))


def shifts(track: DataFrame, keys: list[str], threshold: float, w: int, passes: int = 1, norm: str = "norm", average: str = "moving_average") -> DataFrame:
    """Rows whose twice-smoothed average is over threshold away from the equally smoothed norm."""
    rows = track.withColumns({"_n": F.col(norm), "_a": F.col(average)})
    for _ in range(passes):
        rows = chunks.moving(rows, keys, w, _n2=("median", "_n"), _a2=("median", "_a")).drop("_n", "_a").withColumnsRenamed({"_n2": "_n", "_a2": "_a"})
    return rows.where(F.abs(F.col("_a") - F.col("_n")) > threshold).drop("_n", "_a")


def islands(flagged: DataFrame, keys: list[str], gap: float = 1) -> DataFrame:
    """keys, island (from 1), start, end, rows: flagged positions merged while they lie no more than `gap` apart.

    Islands are found per chunk, numbered after those of the chunks before, and joined where one goes on over a border.
    """
    rows = flagged.withColumn("_c", chunks.of(F.col("pos")))
    order = chunks.within(keys, "pos")
    rows = rows.withColumn("_new", F.when(F.col("pos") - F.lag("pos").over(order) <= gap, 0).otherwise(1)).withColumn("_j", F.sum("_new").over(order))
    pieces = rows.groupBy(*keys, "_c", "_j").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("rows"))
    goes_on = lambda w: F.coalesce((F.col("_first") - F.lag("_last").over(w) <= gap).cast("long"), F.lit(0))
    # summaries of chunks: their islands, and whether the first of them goes on from the chunk before
    each = pieces.groupBy(*keys, "_c").agg(F.min("start").alias("_first"), F.max("end").alias("_last"), F.count("*").alias("_m"))
    over = Window.partitionBy(*keys).orderBy("_c")
    each = each.withColumn("_on", goes_on(over)).withColumn("_base", F.sum(F.col("_m") - F.col("_on")).over(over) - F.col("_m"))
    found = each.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_c"])), "_base")
    pieces = pieces.join(found, [pieces[k].eqNullSafe(found[f"_k{i}"]) for i, k in enumerate([*keys, "_c"])])
    return pieces.withColumn("island", F.col("_base") + F.col("_j")).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("rows").alias("rows"))


def island_peaks(found: DataFrame, track: DataFrame, keys: list[str], value: str = "norm") -> DataFrame:
    """found (closed start, end) with centre and peak, the largest value inside."""
    points = track.select(*keys, F.col("pos").alias("p"), (F.col("pos") + 1).alias("p1"), F.col(value).alias("v"))
    spans = found.withColumns({"r_start": F.col("start"), "r_end": F.col("end") + 1})
    rows = range_join(points, spans, keys, 1000, ("p", "p1")).where(F.col("p").between(F.col("start"), F.col("end")))
    return rows.groupBy(*found.columns).agg(F.max("v").alias("peak")).withColumn("centre", (F.col("start") + F.col("end")) / 2)


def longest_run(track: DataFrame, keys: list[str], below: Column, order: str = "rn") -> DataFrame:
    """keys, longest: the longest stretch of consecutive rows for which `below` holds; null counts as not."""
    rows = track.withColumn("_ok", F.coalesce(below, F.lit(False))).withColumn("_c", chunks.of(F.col(order)))
    rows = chunks.running(rows, keys, F.when(F.col("_ok"), 0).otherwise(1), order, "_g")
    return rows.groupBy(*keys, "_g").agg(F.count_if("_ok").alias("n")).groupBy(*keys).agg(F.max("n").alias("longest"))


def align(tracks: DataFrame, group: list[str], sample: str, value: str) -> DataFrame:
    """group, sample, pos, value at every position that any sample of the group has.

    Rows of one position are averaged; missing values are interpolated by rank between their neighbours and filled outwards
    at both ends. Neighbours in other chunks are carried over.
    """
    mean = settled(tracks.groupBy(*group, sample, "pos").agg(F.avg(value).alias(value)))
    grid = numbered(mean.select(*group, "pos").distinct(), group).withColumnRenamed("rn", "rank").withColumn("_c", chunks.of(F.col("pos")))
    # samples meet the grid chunk by chunk, so that a group's positions aren't one key
    members = grid.select(*group, "_c").distinct().join(mean.select(*group, sample).distinct(), group)
    rows = settled(grid.join(members, [*group, "_c"]).join(mean, [*group, sample, "pos"], "left"))
    keys = [*group, sample]
    rows = rows.withColumn("_at", F.when(F.col(value).isNotNull(), F.struct(F.col("rank").alias("r"), F.col(value).alias("v"))))
    rows = chunks.carry(
        rows, keys, {"_first": F.min("_at"), "_last": F.max("_at")},
        {"_before": lambda w: F.last("_last", True).over(w.rowsBetween(*chunks.BEFORE)), "_after": lambda w: F.first("_first", True).over(w.rowsBetween(*chunks.AFTER))},
    )
    order = chunks.within(keys, "rank")
    back, on = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"_p": F.coalesce(F.last("_at", True).over(back), "_before"), "_q": F.coalesce(F.first("_at", True).over(on), "_after")})
    v0, r0, v1, r1 = F.col("_p.v"), F.col("_p.r"), F.col("_q.v"), F.col("_q.r")
    between = v0 + (v1 - v0) * (F.col("rank") - r0) / (r1 - r0)
    return rows.select(*group, sample, "pos", F.coalesce(F.col(value), F.when(v0.isNotNull() & v1.isNotNull(), between), v0, v1).alias(value))


def fill_with_mean(tracks: DataFrame, keys: list[str], value: str) -> DataFrame:
    rows = tracks.withColumn("_c", chunks.of(F.col("pos")))
    rows = chunks.carry(rows, keys, {"_s": F.sum(value), "_n": F.count(value)}, {"_s": chunks.total(F.sum, "_s"), "_n": chunks.total(F.sum, "_n")})
    return rows.withColumn(value, F.coalesce(F.col(value), F.col("_s") / F.col("_n"))).select(*tracks.columns)


def depth_track(runs_by_position: DataFrame, keys: list[str], ref_median: str, w: int, limits: tuple | None = None, bin_size: int | None = None) -> DataFrame:
    """keys, rn, pos, depth, norm, moving_average, moving_variances, covariance from per-position depth and a column of reference medians."""
    track = runs_by_position.withColumn("norm", F.col("depth") / F.col(ref_median))
    track = within_limits(track, keys, "norm", *limits) if limits else numbered(track, keys)
    track = chunks.moving(track, keys, w, moving_average=("median", "norm"), moving_variances=("variance", "norm"), covariance=("covariance", "depth"))
    track = rescale(settled(track), keys, "covariance", "norm")
    if bin_size:
        track = bin_means(track, keys, bin_size, ["pos", "moving_average", "moving_variances", "covariance"])
    return track.select(*keys, "rn", "pos", "depth", "norm", "moving_average", "moving_variances", "covariance")
