"""Change-point segmentation of ordered signals, one track or a pooled group of tracks at a time.

Kernels follow the public literature: bottom-up merging (Keogh et al. 2001), binary segmentation, dynamic programming, PELT
(Killick et al. 2012) and sliding windows (survey: Truong et al. 2020), over cuts at multiples of `jump`.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import chunks
from strandlake.operators.signal import align, fill_with_mean


#: Cost models. Segments whose costs are remembered.
MODELS = ("l2", "l1", "normal", "rbf", "cosine", "linear", "clinear", "ar", "mahalanobis", "rank")
MEMO = 500_000


def _ranks(values: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal values share their mean rank."""
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    last = np.cumsum(n)
    return (last - (n - 1) / 2)[at]


def _left_over(x: np.ndarray, y: np.ndarray) -> float:
    """What least squares on x leave of y."""
    if not x.shape[1]:
        return float((y * y).sum())
    return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())


class Cost:
    """cost(a, b) of the segment x[a:b] of a signal (rows, columns), summed over columns."""

    def __init__(self, x: np.ndarray, model: str):
        self.x, self.model, self.memo = x, model, {}
        if model not in MODELS:
            raise ValueError(f"no cost model {model!r}: {', '.join(MODELS)}")
        zero = np.zeros((1, x.shape[1]))
        self.s, self.q = np.r_[zero, np.cumsum(x, 0)], np.r_[zero, np.cumsum(x * x, 0)]
        if model == "rbf":
            d = ((x[:, None] - x[None]) ** 2).sum(2)
            med = np.median(d[np.triu_indices(len(x), 1)]) if len(x) > 1 else 1.0
            gram = np.exp(-np.clip(d / (med or 1.0), 1e-2, 1e2))
            self._sum(gram)
        if model == "cosine":
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            unit = x / np.where(norm > 0, norm, 1)
            self._sum(unit @ unit.T)
        if model in ("mahalanobis", "rank"):
            if model == "rank":
                self.x = x = np.stack([_ranks(c) for c in x.T], 1) - (len(x) + 1) / 2
                self.s = np.r_[zero, np.cumsum(x, 0)]
            self.metric = np.linalg.pinv(np.cov(x.T).reshape(x.shape[1], -1))

    def _sum(self, gram: np.ndarray) -> None:
        self.gram = np.zeros((len(gram) + 1, len(gram) + 1))
        self.gram[1:, 1:] = gram.cumsum(0).cumsum(1)
        self.diagonal = np.r_[0, np.diagonal(gram).cumsum()]

    def __call__(self, a: int, b: int) -> float:
        if (a, b) not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[a, b] = self._of(a, b)
        return self.memo[a, b]

    def _of(self, a: int, b: int) -> float:
        n = b - a
        if self.model == "l1":
            part = self.x[a:b]
            return float(np.abs(part - np.median(part, 0)).sum())
        if self.model in ("rbf", "cosine"):
            g = self.gram
            return float(self.diagonal[b] - self.diagonal[a] - (g[b, b] - g[a, b] - g[b, a] + g[a, a]) / n)
        if self.model == "mahalanobis":
            part = self.x[a:b] - self.x[a:b].mean(0)
            return float(np.einsum("ij,jk,ik->", part, self.metric, part))
        if self.model == "rank":
            mean = (self.s[b] - self.s[a]) / n
            return float(-n * mean @ self.metric @ mean)
        if self.model == "linear":  # the first column by the others
            return _left_over(self.x[a:b, 1:], self.x[a:b, :1])
        if self.model == "clinear":  # a line from the value before the segment to its last one
            a = max(a, 1)
            part, before = self.x[a:b], self.x[a - 1]
            steps = np.arange(1, len(part) + 1)[:, None]
            return float(((part - before - steps * (self.x[b - 1] - before) / max(len(part), 1)) ** 2).sum())
        if self.model == "ar":  # each value by the four before it and a constant
            at = np.arange(max(a, 4), b)
            if not len(at):
                return 0.0
            return _left_over(np.column_stack([*(self.x[at - k] for k in range(1, 5)), np.ones(len(at))]), self.x[at])
        s, q = self.s[b] - self.s[a], self.q[b] - self.q[a]
        if self.model == "l2":
            return float((q - s * s / n).sum())
        part = self.x[a:b]
        cov = np.cov(part.T, bias=True).reshape(part.shape[1], -1) + 1e-6 * np.eye(part.shape[1])
        return float(n * np.linalg.slogdet(cov)[1])


def bottom_up(cost: Cost, n: int, n_bkps: int | None, pen: float | None, min_size: int, jump: int) -> list[int]:
    """Begin with a segment for every cut and merge the neighbours whose union costs least more."""
    step = -(-min_size // jump) * jump
    cuts = [c for c in range(step, n, step) if n - c >= min_size]
    bounds = [0, *cuts, n]
    nxt = {a: b for a, b in zip(bounds, bounds[1:])}
    prev = {b: a for a, b in zip(bounds, bounds[1:])}
    gain = lambda c: cost(prev[c], nxt[c]) - cost(prev[c], c) - cost(c, nxt[c])
    heap = [(gain(c), c, prev[c], nxt[c]) for c in cuts]
    heapq.heapify(heap)
    left = set(cuts)
    while heap and (n_bkps is None or len(left) > n_bkps):
        g, c, a, b = heapq.heappop(heap)
        if c not in left or prev[c] != a or nxt[c] != b:
            continue
        if n_bkps is None and g >= pen:
            break
        left.discard(c)
        nxt[a], prev[b] = b, a
        for d in (a, b):
            if d in left:
                heapq.heappush(heap, (gain(d), d, prev[d], nxt[d]))
    return sorted(left)


def binary_segmentation(cost: Cost, n: int, n_bkps: int | None, pen: float | None, min_size: int, jump: int) -> list[int]:
    """Split where a split saves most, again and again."""
    best: dict[tuple[int, int], tuple[float, int]] = {}

    def split(a: int, b: int) -> tuple[float, int]:
        if (a, b) not in best:
            cuts = [c for c in range(-(-(a + 1) // jump) * jump, b, jump) if c - a >= min_size and b - c >= min_size]
            best[a, b] = max(((cost(a, b) - cost(a, c) - cost(c, b), -c) for c in cuts), default=(-np.inf, 0))
        return best[a, b]

    bounds = [0, n]
    while n_bkps is None or len(bounds) - 2 < n_bkps:
        g, c = max((split(a, b) for a, b in zip(bounds, bounds[1:])), default=(-np.inf, 0))
        if g == -np.inf or (n_bkps is None and g <= pen):
            break
        bounds = sorted([*bounds, -c])
    return bounds[1:-1]


def dynamic(cost: Cost, n: int, n_bkps: int | None, pen: float | None, min_size: int, jump: int) -> list[int]:
    """The cheapest segmentation with n_bkps cuts."""
    if n_bkps is None:
        raise ValueError("dynamic programming takes a number of breakpoints")
    ends = [*range(jump, n, jump), n]
    table = {(0, e): (cost(0, e), ()) for e in ends if e >= min_size}
    for k in range(1, n_bkps + 1):
        for e in ends:
            found = [(table[k - 1, c][0] + cost(c, e), (*table[k - 1, c][1], c)) for c in ends if c < e and e - c >= min_size and (k - 1, c) in table]
            if found:
                table[k, e] = min(found)
    return list(table[n_bkps, n][1]) if (n_bkps, n) in table else []


def pelt(cost: Cost, n: int, n_bkps: int | None, pen: float | None, min_size: int, jump: int) -> list[int]:
    """The cheapest segmentation at a penalty per cut, with pruning.

    A start that a later cut beats is left once that cut can be followed by a segment of min_size itself.
    """
    if pen is None:
        raise ValueError("PELT takes a penalty")
    best: dict[int, tuple[float, tuple]] = {0: (-pen, ())}
    until = {0: n + 1}
    for e in [*range(jump, n, jump), n]:
        live = [c for c, last in until.items() if e < last]
        found = [(best[c][0] + cost(c, e) + pen, (*best[c][1], c)) for c in live if e - c >= min_size]
        if not found:
            continue
        best[e] = min(found)
        for c in live:
            if e - c >= min_size and best[c][0] + cost(c, e) > best[e][0]:
                until[c] = min(until[c], e + min_size)
        until[e] = n + 1
    return [c for c in best[n][1] if c] if n in best else []


def window(cost: Cost, n: int, n_bkps: int | None, pen: float | None, min_size: int, jump: int, width: int = 100) -> list[int]:
    """Cuts between the half windows that differ most, the strongest peaks first."""
    half = max(min_size, min(width, n) // 2)
    at = [c for c in range(jump, n, jump) if c >= half and n - c >= half]
    score = {c: cost(c - half, c + half) - cost(c - half, c) - cost(c, c + half) for c in at}
    peaks = sorted((c for c in at if all(score[c] >= score.get(c + d, -np.inf) for d in range(-half // 2, half // 2 + 1))), key=lambda c: (-score[c], c))
    if n_bkps is not None:
        return sorted(peaks[:n_bkps])
    return sorted(c for c in peaks if score[c] > pen)


def _quantile_of_pairs(x: np.ndarray, rank: int, rows: int = 256) -> float:
    """The rank-th smallest squared distance of two rows, to 12 digits, in memory for `rows` rows at a time.

    Counts of all pairs in 4096 intervals narrow the range that holds it, pass by pass.
    """
    square = (x * x).sum(1)

    def batches():
        for a in range(0, len(x), rows):
            d = np.maximum(square[a : a + rows, None] + square[None] - 2 * (x[a : a + rows] @ x.T), 0.0)
            yield d[np.arange(a, min(a + rows, len(x)))[:, None] < np.arange(len(x))[None]]

    low, high, below = 0.0, max((float(d.max()) for d in batches() if len(d)), default=0.0), 0
    for _ in range(4):
        if high <= low:
            break
        edges = np.linspace(low, high, 4097)
        counts = np.zeros(4096, np.int64)
        under = 0
        for d in batches():
            under += int((d < low).sum())
            counts += np.histogram(d, edges)[0]
        at = min(int(np.searchsorted(np.cumsum(counts) + under, rank + 1)), 4095)
        low, high = float(edges[at]), float(edges[at + 1])
    return (low + high) / 2


#: k(rows, row) by kernel, of a signal and for rbf its gamma.
def _kernel(x: np.ndarray, name: str, gamma: float | None):
    if name == "linear":
        return lambda t: x[: t + 1] @ x[t]
    if name == "cosine":
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        unit = x / np.where(norm > 0, norm, 1)
        return lambda t: unit[: t + 1] @ unit[t]
    if name != "rbf":
        raise ValueError(f"no kernel {name!r}: linear, rbf, cosine")
    pairs = len(x) * (len(x) - 1) // 2
    if gamma is None:
        med = (_quantile_of_pairs(x, (pairs - 1) // 2) + _quantile_of_pairs(x, pairs // 2)) / 2 if pairs else 1.0
        gamma = 1.0 / (med or 1.0)
    return lambda t: np.exp(-np.clip(gamma * ((x[: t + 1] - x[t]) ** 2).sum(1), 1e-2, 1e2))


def kernel_segmentation(x: np.ndarray, kernel: str = "linear", n_bkps: int | None = 2, pen: float | None = None, min_size: int = 2, gamma: float | None = None) -> list[int]:
    """The cheapest segmentation in a kernel's feature space, over cuts at every row: exact, in memory linear in rows.

    The Gram matrix is met column by column: the sum over each block that ends at the newest row grows by twice what the column adds
    from the block's start on. With a penalty, the number of cuts is chosen by it.
    """
    n = len(x)
    if n < 2 * min_size:
        return []
    x = np.asarray(x, float).reshape(n, -1)
    column = _kernel(x, kernel, gamma)
    block, diagonal = np.zeros(n), np.zeros(n + 1)
    rounds = 1 if pen is not None else n_bkps + 1
    best = np.full((rounds, n + 1), np.inf)
    back = np.zeros((rounds, n + 1), np.int64)
    if pen is not None:
        best[0, 0] = -pen
    for t in range(n):
        k = column(t)
        own = float(k[t])
        diagonal[t + 1] = diagonal[t] + own
        block[: t + 1] += 2 * np.cumsum(k[::-1])[::-1] - own
        starts = np.arange(0, t + 2 - min_size)
        if not len(starts):
            continue
        cost = diagonal[t + 1] - diagonal[starts] - block[starts] / (t + 1 - starts)
        if pen is not None:
            total = best[0, starts] + cost + pen
            back[0, t + 1] = int(np.argmin(total))
            best[0, t + 1] = total[back[0, t + 1]]
            continue
        best[0, t + 1] = cost[0]
        for r in range(1, rounds):
            total = best[r - 1, starts] + cost
            back[r, t + 1] = int(np.argmin(total))
            best[r, t + 1] = total[back[r, t + 1]]
    out, at, r = [], n, rounds - 1
    if not np.isfinite(best[r, n]):
        return []
    while True:
        at = int(back[0 if pen is not None else r, at])
        r -= 1
        if at == 0:
            return out[::-1]
        out.append(at)
        if pen is None and r == 0:
            return out[::-1]


ALGORITHMS = {"BottomUp": bottom_up, "Binseg": binary_segmentation, "Dynp": dynamic, "Pelt": pelt, "Window": window}


def segment(x: np.ndarray, algo: str = "BottomUp", model: str = "l2", n_bkps: int | None = 2, pen: float | None = None, min_size: int = 2, jump: int = 5) -> list[int]:
    """Row numbers at which segments of x begin, but for the first. A penalty goes before a number."""
    if algo == "KernelCPD":
        return kernel_segmentation(x, "linear" if model == "l2" else model, n_bkps, pen, min_size)
    if algo not in ALGORITHMS:
        raise ValueError(f"no algorithm {algo!r}: {', '.join(ALGORITHMS)}, KernelCPD")
    x = np.asarray(x, float).reshape(len(x), -1)
    if len(x) < 2 * min_size:
        return []
    return ALGORITHMS[algo](Cost(x, model), len(x), None if pen is not None else n_bkps, pen, min_size, jump)


def breakpoints(track: DataFrame, keys: list[str], signal: str = "moving_average", **how) -> DataFrame:
    """keys, position, breakpoint_number, method: cuts of each track (rn, pos, signal), left to right. Rows without signal are left out."""
    schema = track.select(*keys, F.lit(0).cast("long").alias("position"), F.lit(0).alias("breakpoint_number"), F.lit("").alias("method")).schema

    def kernel(pdf):
        import pandas as pd

        pdf = pdf[pdf[signal].notna()].sort_values("rn")
        cuts = segment(pdf[signal].to_numpy(), **how) if len(pdf) else []
        head = {k: [pdf[k].iloc[0]] * len(cuts) for k in keys} if len(pdf) else {k: [] for k in keys}
        return pd.DataFrame(head | {"position": [int(pdf["pos"].iloc[c]) for c in cuts], "breakpoint_number": range(1, len(cuts) + 1), "method": "segmentation"}, columns=schema.names)

    return track.groupBy(*keys).applyInPandas(kernel, schema)


def pooled_breakpoints(tracks: DataFrame, group: list[str], sample: str, signal: str = "moving_average", **how) -> DataFrame:
    """Cuts of all samples of a group together: aligned to the union of positions, costs summed over samples."""
    rows = fill_with_mean(align(tracks, group, sample, signal), [*group, sample], signal)
    schema = tracks.select(*group, F.lit(0).cast("long").alias("position"), F.lit(0).alias("breakpoint_number"), F.lit("").alias("method")).schema

    def kernel(pdf):
        import pandas as pd

        wide = pdf.pivot(index="pos", columns=sample, values=signal).sort_index()
        cuts = segment(wide.to_numpy(), **how)
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(cuts) for k in group} | {"position": [int(wide.index[c]) for c in cuts], "breakpoint_number": range(1, len(cuts) + 1), "method": "pooled_segmentation"}, columns=schema.names)

    return rows.groupBy(*group).applyInPandas(kernel, schema)


def best_single_cut(track: DataFrame, keys: list[str], value: str, min_size: int = 2) -> DataFrame:
    """keys, rn, cost: the row at which one cut leaves the least squared error, by prefix sums; the first of equals."""
    v = F.col(value).cast("double")
    parts = {"sv": F.sum("v"), "qv": F.sum(F.col("v") * F.col("v")), "nv": F.count("*")}
    carried = {"s0": lambda w: F.coalesce(F.sum("sv").over(w.rowsBetween(*chunks.BEFORE)), F.lit(0.0)), "q0": lambda w: F.coalesce(F.sum("qv").over(w.rowsBetween(*chunks.BEFORE)), F.lit(0.0))}
    carried |= {"st": chunks.total(F.sum, "sv"), "qt": chunks.total(F.sum, "qv"), "n": chunks.total(F.sum, "nv")}
    rows = chunks.carry(track.select(*keys, "rn", v.alias("v")).withColumn("_c", chunks.of(F.col("rn"))), keys, parts, carried)
    before = chunks.within(keys, "rn").rowsBetween(*chunks.BEFORE)
    add = lambda total, x: F.col(total) + F.coalesce(F.sum(x).over(before), F.lit(0.0))
    rows = rows.withColumns({"s": add("s0", F.col("v")), "q": add("q0", F.col("v") * F.col("v"))})
    k = F.col("rn") - 1
    cost = F.col("q") - F.col("s") * F.col("s") / k + (F.col("qt") - F.col("q")) - (F.col("st") - F.col("s")) * (F.col("st") - F.col("s")) / (F.col("n") - k)
    rows = rows.where((k >= min_size) & (F.col("n") - k >= min_size)).select(*keys, "rn", F.round(cost, 6).alias("cost"))
    return rows.groupBy(*keys).agg(F.min(F.struct("cost", "rn")).alias("m")).select(*keys, "m.rn", "m.cost")


#: Units that one task segments: rows first, then the segments of chunks before it.
UNITS = 8192


def _best_cuts(n: np.ndarray, s: np.ndarray, q: np.ndarray, n_bkps: int, at: np.ndarray, min_size: int) -> list[int]:
    """Of units (rows, sum, sum of squares) the places among `at` where up to n_bkps cuts leave the least squared error, exactly."""
    sums = [np.r_[0.0, np.cumsum(v)] for v in (n, s, q)]
    ends = np.r_[at, len(n)]
    places = np.r_[0, ends]
    rows, total, squares = (v[places] for v in sums)

    def cost(e: int, starts: slice) -> np.ndarray:
        size = rows[e] - rows[starts]
        found = squares[e] - squares[starts] - (total[e] - total[starts]) ** 2 / np.maximum(size, 1)
        return np.where(size >= min_size, found, np.inf)

    m = len(places)
    best, back = np.full((n_bkps + 1, m), np.inf), np.zeros((n_bkps + 1, m), np.int64)
    for e in range(1, m):
        own = cost(e, slice(0, e))
        best[0, e] = own[0]
        for k in range(1, n_bkps + 1):
            found = best[k - 1, 1:e] + own[1:]
            if len(found):
                back[k, e] = int(np.argmin(found)) + 1
                best[k, e] = found[back[k, e] - 1]
    k = int(np.argmin(best[:, -1]))
    out, e = [], m - 1
    while k > 0:
        e = int(back[k, e])
        out.append(int(places[e]))
        k -= 1
    return out[::-1]


def chunked_breakpoints(track: DataFrame, keys: list[str], signal: str = "moving_average", n_bkps: int = 2, min_size: int = 2, jump: int = 5, units: int = UNITS) -> DataFrame:
    """keys, position, breakpoint_number, method: n_bkps cuts of tracks of any length (rn, pos, signal) by squared error; no task holds a track.

    A chunk of `units` rows gives its own best cuts, as many as are asked for, and is from then on known by the sums of its segments.
    Chunks of segments are cut likewise until one is left, whose cuts are the result. Moving a cut of the best segmentation inside a
    segment of one mean to its nearer or further end never costs more, which bounds the squared error: one chunk is exact; chunks
    and one selection stay within 5 times that of the best cuts at multiples of jump, a level more within 16 times (min_size apart).
    """
    if units // (n_bkps + 1) < 2:
        raise ValueError("a chunk has to hold the segments of two others")
    each = [F.col(k) for k in keys]
    rows = track.where(F.col(signal).isNotNull()).select(*each, F.col("rn").cast("long").alias("rn"), F.col("pos").cast("long").alias("pos"), F.lit(1.0).alias("n"), F.col(signal).cast("double").alias("s"))
    # values about the track's first one, so that squares keep their digits
    rows = rows.withColumn("_c", F.floor((F.col("rn") - 1) / units))
    about = chunks.carry(rows, keys, {"_f": F.min_by("s", "rn")}, {"about": lambda w: F.first("_f").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    rows = about.withColumn("s", F.col("s") - F.col("about")).drop("about").withColumn("q", F.col("s") * F.col("s"))
    schema = rows.schema
    last = rows.agg(F.max("_c")).first()[0] or 0

    def cut(step: int):
        def kernel(table: pa.Table) -> pa.Table:
            table = table.sort_by("rn")
            rn, n, s, q = (table.column(c).to_numpy() for c in ("rn", "n", "s", "q"))
            at = np.arange(1, len(n))
            if step > 1:  # rows: cuts at multiples of jump of the whole track
                at = at[(rn[1:] - 1) % step == 0]
            starts = np.r_[0, np.array(_best_cuts(n, s, q, n_bkps, at, min_size), np.int64)]
            table_ = table.take(pa.array(starts))
            for name, v in (("n", n), ("s", s), ("q", q)):
                table_ = table_.set_column(table_.schema.get_field_index(name), name, pa.array(np.add.reduceat(v, starts)))
            return table_

        return kernel

    found = rows.groupBy(*keys, "_c").applyInArrow(cut(jump), schema)
    while last > 0:
        fan = units // (n_bkps + 1)
        found = found.withColumn("_c", F.floor(F.col("_c") / fan)).groupBy(*keys, "_c").applyInArrow(cut(1), schema)
        last //= fan
    order = Window.partitionBy(*keys).orderBy("rn")
    found = found.withColumn("breakpoint_number", F.row_number().over(order) - 1).where("breakpoint_number > 0")
    return found.select(*each, F.col("pos").alias("position"), "breakpoint_number", F.lit("segmentation").alias("method"))
