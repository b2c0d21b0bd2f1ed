"""Long tracks in chunks: no task holds a track.

A track is the rows of one `keys`. Rows are dealt to chunks (_c) of so many positions or rows. What a chunk needs of the ones before
or behind it is carried over from one summary row per chunk, or comes as a halo of rows of its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Positions or rows of a chunk.
CHUNK = 1 << 16
BEFORE, AFTER = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)


def of(place: Column, size: int | None = None) -> Column:
    return F.floor(place / (size or CHUNK))


def within(keys: list[str], order: str | None = None) -> WindowSpec:
    """The rows of one chunk."""
    rows = Window.partitionBy(*keys, "_c")
    return rows.orderBy(order) if order else rows


def carry(rows: DataFrame, keys: list[str], parts: dict[str, Column], totals: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """rows (with _c) with `totals`: expressions over the window of a track's chunks, in order, whose rows are the aggregates `parts`."""
    each = rows.groupBy(*keys, "_c").agg(*(v.alias(k) for k, v in parts.items()))
    by = [*keys, "_c"]
    over = Window.partitionBy(*keys).orderBy("_c")
    found = each.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), *(f(over).alias(k) for k, f in totals.items()))
    same = [rows[k].eqNullSafe(found[f"_k{i}"]) for i, k in enumerate(by)]
    return rows.join(found, same).select(*(rows[c] for c in rows.columns), *totals)


def total(f: Callable, name: str) -> Callable[[WindowSpec], Column]:
    """An aggregate over all chunks of a track."""
    return lambda w: f(name).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def running(rows: DataFrame, keys: list[str], value: Column, order: str, out: str) -> DataFrame:
    """rows (with _c, chunks of `order`) with the sum of value over a track's rows up to each."""
    rows = rows.withColumn("_v", value)
    rows = carry(rows, keys, {"_t": F.sum("_v")}, {"_b": lambda w: F.coalesce(F.sum("_t").over(w.rowsBetween(*BEFORE)), F.lit(0))})
    return rows.withColumn(out, F.col("_b") + F.sum("_v").over(within(keys, order).rowsBetween(Window.unboundedPreceding, 0))).drop("_v", "_b")


def moments(w: int, x: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """n, mean and sum of squared deviations of x, and with y the co-moment, over windows of w rows, cut at both ends; NaN is missing.

    Rows stand in blocks of w, so a window is a tail of one block and a head of the next. Welford sums of all heads and tails are
    built row by row for all blocks at once and merged: a constant number of steps a row, and none that subtracts large sums.
    """
    size, before = len(x), w // 2
    blocks = (size + w - 2) // w + 2
    grid = lambda v: np.concatenate([np.full(before, np.nan), v, np.full(blocks * w - before - size, np.nan)]).reshape(blocks, w)
    xs = grid(x)
    ys = None if y is None else grid(y)
    there = ~np.isnan(xs) if ys is None else ~np.isnan(xs) & ~np.isnan(ys)

    def sums(columns: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Running sums along columns about the first value met in each block, so that a common offset costs no digits, and those values."""
        first = np.arange(w)[columns][there[:, columns].argmax(1)]
        about = [np.nan_to_num(v[np.arange(blocks), first]) if v is not None else np.zeros(blocks) for v in (xs, ys)]
        out = np.zeros((5, blocks, w))
        n, mx, m2, my, c = np.zeros((5, blocks))
        for j in columns:
            ok = there[:, j]
            n = n + ok
            k = np.maximum(n, 1)
            x_ = xs[:, j] - about[0]
            dx = np.where(ok, x_ - mx, 0.0)
            mx = mx + dx / k
            m2 = m2 + dx * np.where(ok, x_ - mx, 0.0)
            if ys is not None:
                y_ = ys[:, j] - about[1]
                my = my + np.where(ok, y_ - my, 0.0) / k
                c = c + dx * np.where(ok, y_ - my, 0.0)
            out[:, :, j] = n, mx, m2, my, c
        return out.reshape(5, blocks * w), *about

    (heads, hx, hy), (tails, tx, ty) = sums(range(w)), sums(range(w - 1, -1, -1))
    at = np.arange(size)
    n1, x1, q1, y1, c1 = tails[:, at]
    n2, x2, q2, y2, c2 = np.where(at % w == 0, 0.0, heads[:, at + w - 1])  # a window that is a block has no second part
    n = n1 + n2
    share = n2 / np.maximum(n, 1)
    b1, b2 = at // w, (at + w - 1) // w
    dx, dy = np.where(n2 > 0, x2 - x1 + (hx[b2] - tx[b1]), 0.0), np.where(n2 > 0, y2 - y1 + (hy[b2] - ty[b1]), 0.0)
    # a window without rows in its first block has all of them in the second
    return n, np.where(n1 > 0, tx[b1] + (x1 + dx * share), hx[b2] + x2), q1 + q2 + dx * dx * n1 * share, c1 + c2 + dx * dy * n1 * share


def _variance(w: int, x: np.ndarray) -> np.ndarray:
    n, _, squares, _ = moments(w, x)
    return np.where(n > 1, squares / np.maximum(n - 1, 1), np.nan)


def _covariance(w: int, x: np.ndarray) -> np.ndarray:
    n, mean, squares, _ = moments(w, x)
    full = n == w
    divisor = max(w - 1, 1)
    n, _, _, both = moments(w, np.where(full, mean, np.nan), np.where(full & (w > 1), squares / divisor, np.nan))
    return np.where((n == w) & (w > 1), both / divisor, np.nan)


def _median(w: int, x: np.ndarray) -> np.ndarray:
    return pd.Series(x).rolling(w, center=True, min_periods=1).median().to_numpy()  # an indexed skip list: log w a row


#: What moving() computes, and over how many windows' reach.
KINDS = {"median": (_median, 1), "variance": (_variance, 1), "covariance": (_covariance, 2)}


def moving(track: DataFrame, keys: list[str], w: int, **outs: tuple[str, str]) -> DataFrame:
    """track (rn from 1, without gaps) with out=(kind, column): medians, sample variances, or covariances of moving mean and variance.

    Windows are centred: w // 2 rows before and (w - 1) // 2 after. A chunk comes with the rows of its neighbours that its windows reach.
    """
    if w < 1:
        raise ValueError(f"a window of {w} rows")
    size = max(CHUNK, 4 * w)
    reach = max(KINDS[kind][1] for kind, _ in outs.values())
    at = F.col("rn") - 1
    first, last = of(at - reach * ((w - 1) // 2), size), of(at + reach * (w // 2), size)
    rows = track.withColumn("_c", F.explode(F.sequence(first, last)))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in track.schema), *(T.StructField(o, T.DoubleType()) for o in outs)])

    def kernel(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        own = (table.column("rn").to_numpy() - 1) // size == table.column("_c").to_numpy()
        if not own.any():
            table = table.slice(0, 0)
            own = own[:0]
        for out, (kind, column) in outs.items():
            values = table.column(column).cast(pa.float64()).to_numpy()
            found = KINDS[kind][0](w, values)
            table = table.append_column(out, pa.array(found, mask=np.isnan(found)))
        return table.filter(pa.array(own)).drop_columns(["_c"])

    return rows.groupBy(*keys, "_c").applyInArrow(kernel, schema)

