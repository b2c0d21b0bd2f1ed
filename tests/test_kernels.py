"""Linkage, densities and kernel change points against plain versions."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from strandlake.operators import changepoint, probes, stats


def greedy(bits, threshold):
    """Average linkage by the book: all pairs of members, exact fractions, the first of the nearest pairs."""
    clusters = [[i] for i in range(len(bits))]
    far = lambda a, b: Fraction(sum(int(x != y) for i in a for j in b for x, y in zip(bits[i], bits[j])), len(a) * len(b) * len(bits[0]))
    while len(clusters) > 1:
        d, i, j = min((far(clusters[i], clusters[j]), i, j) for i, j in itertools.combinations(range(len(clusters)), 2))
        if not float(d) < threshold:
            break
        clusters[i] += clusters.pop(j)
    label = {m: k for k, c in enumerate(sorted(clusters, key=min)) for m in c}
    return [label[i] for i in range(len(bits))]


@pytest.mark.parametrize("seed", range(25))
def test_linkage_equals_the_plain_one_with_ties(seed):
    r = random.Random(seed)
    base = [[r.randint(0, 1) for _ in range(6)] for _ in range(4)]
    bits = np.array([[b ^ (r.random() < 0.15) for b in r.choice(base)] for _ in range(14)])
    for threshold in (0.1, 1 / 6, 0.2, 0.35, 0.6):
        assert probes.average_linkage(bits, threshold) == greedy(bits, threshold)


def test_linkage_of_many_members_needs_no_cube():
    r = np.random.default_rng(1)
    bits = r.integers(0, 2, (3, 41))[r.integers(0, 3, 20_000)]  # three profiles, 20,000 samples: all pairs would be 3 GB a place
    assert sorted(set(probes.average_linkage(bits, 0.01))) == [0, 1, 2]


def direct(values, x):
    h = np.std(values, ddof=1) * len(values) ** -0.2
    return sum(math.exp(-(((x - v) / h) ** 2) / 2) for v in values) / (len(values) * h * math.sqrt(2 * math.pi))


def test_densities_equal_the_direct_sum(spark):
    r = random.Random(2)
    groups = {"a": [r.gauss(0, 30) for _ in range(400)], "b": [float(r.randint(-3, 3)) for _ in range(300)] + [900.0], "c": [5.0, 5.0], "d": [1.0], "e": [0.0, 1000.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, v double")
    grid = [-50.0, 0.0, 1.5, 899.0]
    got = {(r.k, r.x): r.density for r in stats.kde(df, ["k"], "v", grid).collect()}
    assert {k for k, _ in got} == {"a", "b", "e"}  # no spread: no bandwidth
    for (k, x), d in got.items():
        assert abs(d - direct(groups[k], x)) < 1e-6
    own = stats.density(df, ["k"], "v", 101).toPandas()
    assert own.groupby("k").size().to_dict() == {"a": 101, "b": 101, "e": 101}
    for k, x, d in own.itertuples(index=False):
        assert abs(d - direct(groups[k], x)) < 1e-6
    for k, part in own.groupby("k"):
        area = ((part["density"].to_numpy()[1:] + part["density"].to_numpy()[:-1]) / 2 * np.diff(part["x"])).sum()
        assert abs(area - 1) < 0.02


def plain_cost(x, kernel):
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    if kernel == "linear":
        gram = x @ x.T
    elif kernel == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        gram = u @ u.T
    else:
        gram = np.exp(-np.clip(d / np.median(d[np.triu_indices(n, 1)]), 1e-2, 1e2))
    return lambda a, b: np.trace(gram[a:b, a:b]) - gram[a:b, a:b].sum() / (b - a)


@pytest.mark.parametrize("kernel", ["linear", "rbf", "cosine"])
@pytest.mark.parametrize("columns", [1, 3])
def test_kernel_change_points_equal_all_segmentations(kernel, columns):
    r = np.random.default_rng(columns)
    x = np.r_[r.normal(0, 1, (7, columns)), r.normal(3, 1, (6, columns)), r.normal(-2, 2, (8, columns))] + 0.1
    cost, n = plain_cost(x, kernel), len(x)
    total = lambda cuts: sum(cost(a, b) for a, b in zip((0, *cuts), (*cuts, n)))
    fits = lambda cuts, m: all(b - a >= m for a, b in zip((0, *cuts), (*cuts, n)))
    for k in (0, 1, 2, 3):
        for m in (1, 2, 4):
            got = changepoint.kernel_segmentation(x, kernel, k, None, m)
            best = min((total(c) for c in itertools.combinations(range(1, n), k) if fits(c, m)), default=None)
            assert len(got) == k and fits(got, m) and abs(total(got) - best) < 1e-9
    for pen in (0.05, 1.0, 1e6):
        got = changepoint.kernel_segmentation(x, kernel, None, pen, 2)
        best = min(total(c) + pen * len(c) for k in range(5) for c in itertools.combinations(range(1, n), k) if fits(c, 2))
        assert total(got) + pen * len(got) <= best + 1e-9


def test_kernel_change_points_by_name(spark):
    r = np.random.default_rng(5)
    level = np.r_[np.zeros(300), np.full(250, 2.0), np.zeros(450)]
    rows = [("t", k + 1, 10 * k, float(v)) for k, v in enumerate(level + r.normal(0, 0.3, 1000))]
    df = spark.createDataFrame(rows, "k string, rn int, pos long, v double")
    for model in ("l2", "rbf"):
        got = [x.position for x in changepoint.breakpoints(df, ["k"], "v", algo="KernelCPD", model=model).orderBy("position").collect()]
        assert len(got) == 2 and abs(got[0] - 3000) <= 20 and abs(got[1] - 5500) <= 20
    assert changepoint.kernel_segmentation(np.zeros(3)) == [] and changepoint.kernel_segmentation(np.zeros((0, 1))) == []
    with pytest.raises(ValueError):
        changepoint.kernel_segmentation(np.arange(9.0), "poly")


@pytest.mark.parametrize("rows", [2, 9, 40])
def test_median_distance_in_little_memory(rows):
    x = np.random.default_rng(rows).normal(size=(rows, 2))
    d = np.sort([((a - b) ** 2).sum() for a, b in itertools.combinations(x, 2)])
    for rank in (0, len(d) // 2, len(d) - 1):
        assert abs(changepoint._quantile_of_pairs(x, rank, 7) - d[rank]) < 1e-9


def squared(x, cuts):
    return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip((0, *cuts), (*cuts, len(x))))


@pytest.mark.parametrize("units", [8192, 60, 12])
def test_chunked_change_points_stay_within_their_bound(spark, units):
    r = np.random.default_rng(units)
    tracks = {
        "steps": np.r_[np.zeros(137), np.full(90, 3.0), np.full(173, -1.0)] + r.normal(0, 0.1, 400), "noise": r.normal(size=400), "ramp": np.linspace(0, 1, 400),
        "high": 1e9 + np.r_[np.zeros(200), np.ones(200)], "flat": np.zeros(400), "short": np.array([1.0, 5.0]), "one": np.array([1.0]),
    }
    rows = [(k, i + 1, 10 * i, float(v)) for k, x in tracks.items() for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, ("flat", 401, 4000, None)], "k string, rn int, pos long, v double").repartition(3)
    got = {}
    for x in changepoint.chunked_breakpoints(df, ["k"], "v", 2, 2, 5, units).orderBy("k", "breakpoint_number").collect():
        got.setdefault(x.k, []).append(x.position // 10)
        assert x.breakpoint_number == len(got[x.k])
    assert len(got["steps"]) == 2 and got["high"][0] == 200 and "short" not in got and "one" not in got
    for k in ("steps", "noise", "ramp"):
        x, at = tracks[k], range(5, 400, 5)
        best = min(squared(x, c) for c in [(), *((a,) for a in at), *itertools.combinations(at, 2)])
        assert squared(x, got[k]) <= (1 + 1e-9) * best * (1 if units > 400 else 5 if units == 60 else 16)
    assert abs(got["steps"][0] - 137) <= 5 and abs(got["steps"][1] - 227) <= 5
    with pytest.raises(ValueError):
        changepoint.chunked_breakpoints(df, ["k"], "v", 9, units=12)
