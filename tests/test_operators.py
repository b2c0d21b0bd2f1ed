"""Kernels and joins against brute force, pandas and properties."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandlake.operators import alignment, changepoint, hits, intervals, matrix, patterns, probes, reads, signal, stats

QUIET = settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
spans = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 25)).map(lambda x: (x[0], x[0] + x[1])), max_size=25)


@QUIET
@given(spans)
def test_depth_adds_up(spark, given_):
    df = spark.createDataFrame([("k", a, b) for a, b in given_], "k string, start long, end long")
    want = {}
    for a, b in given_:
        for p in range(a, b):
            want[p] = want.get(p, 0) + 1
    for chunk in (7, 1 << 20):
        got = intervals.per_position(intervals.depth_runs(df, ["k"], chunk=chunk), ["k"]).collect()
        assert {r.pos: r.depth for r in got} == want and len(got) == len(want)


@QUIET
@given(spans, spans, st.sampled_from([3, 16, 1000]))
def test_range_join_is_all_pairs(spark, left, right, width):
    a = spark.createDataFrame([("k", i, *x) for i, x in enumerate(left)], "k string, i int, start long, end long")
    b = spark.createDataFrame([("k", i, *x) for i, x in enumerate(right)], "k string, j int, r_start long, r_end long")
    got = sorted((r.i, r.j) for r in intervals.range_join(a, b, ["k"], width).collect())
    assert got == sorted((i, j) for (i, (s, e)), (j, (t, f)) in itertools.product(enumerate(left), enumerate(right)) if s < f and t < e and s < e and t < f)


def test_stats_equal_pandas(spark):
    r = random.Random(2)
    rows = [("a", k, k + r.randint(1, 5), r.randint(1, 9)) for k in range(0, 200, 5)] + [("one", 3, 4, 7)]
    got = {x.locus: x for x in stats.locus_stats(spark.createDataFrame(rows, "locus string, start long, end long, depth long"), ["locus"]).collect()}
    for locus in ("a", "one"):
        v = pd.Series([d for l, s, e, d in rows if l == locus for _ in range(s, e)])
        x = got[locus]
        assert (round(x.mean, 9), x.median, x.covered_bases) == (round(v.mean(), 9), v.median(), len(v))
        assert x.sd == pytest.approx(v.std() if len(v) > 1 else 0.0)


@pytest.mark.parametrize("w", [4, 5, 70])
def test_windows_equal_pandas(spark, w):
    rng = np.random.default_rng(w)
    pdf = pd.DataFrame({"k": "t", "pos": np.arange(150) * 2, "depth": rng.integers(1, 40, 150)})
    pdf["norm"] = pdf["depth"] / 7
    t = signal.numbered(spark.createDataFrame(pdf), ["k"])
    t = signal.moving_variance(signal.moving_median(t, ["k"], "norm", "med", w), ["k"], "norm", "var", w)
    got = signal.rescale(signal.moving_covariance(t, ["k"], "depth", "raw", w).withColumn("cov", signal.F.col("raw")), ["k"], "cov", "norm").toPandas().sort_values("pos").reset_index(drop=True)
    roll = lambda s, **a: s.rolling(w, center=True, **a)
    raw = roll(roll(pdf["depth"]).mean()).cov(roll(pdf["depth"]).var())
    assert np.allclose(got["med"], roll(pdf["norm"], min_periods=1).median())
    assert np.allclose(got["var"], roll(pdf["norm"], min_periods=1).var(), equal_nan=True)
    assert np.allclose(got["raw"].astype(float), raw, equal_nan=True)
    if raw.notna().any():
        z = (raw - raw.min()) / (raw.max() - raw.min()) * (pdf["norm"].max() - pdf["norm"].min()) + pdf["norm"].min()
        z = z - z.mean() + 1
        assert np.allclose(got["cov"].astype(float), z.where(z >= 1), equal_nan=True)


def test_bins_equal_pandas(spark):
    pdf = pd.DataFrame({"k": "t", "pos": sorted(random.Random(1).sample(range(500), 90))})
    pdf["v"] = np.sin(pdf["pos"])
    got = signal.bin_means(signal.numbered(spark.createDataFrame(pdf), ["k"]), ["k"], 40, ["pos", "v"]).toPandas().sort_values("rn")
    cut = pd.cut(pdf["pos"], np.arange(pdf["pos"].min(), pdf["pos"].max() + 40, 40), include_lowest=True)
    assert np.allclose(got["v"], pdf.groupby(cut, observed=True)["v"].transform("mean")) and np.allclose(got["pos"], pdf.groupby(cut, observed=True)["pos"].transform("mean"))


def test_alignment_equals_pandas(spark):
    pdf = pd.DataFrame({"g": "x", "s": ["a"] * 4 + ["b"] * 3, "pos": [1, 3, 3, 9, 2, 3, 20], "v": [1.0, 2.0, 4.0, 8.0, 5.0, 6.0, 7.0]})
    got = signal.align(spark.createDataFrame(pdf), ["g"], "s", "v").toPandas().pivot(index="pos", columns="s", values="v")
    ref = sorted(set(pdf["pos"]))
    for s in "ab":
        want = pdf[pdf["s"] == s].groupby("pos")["v"].mean().reindex(ref).interpolate(limit_direction="both")
        assert np.allclose(got[s], want)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=12, max_size=30), st.integers(1, 2))
def test_dynamic_programming_is_optimal(values, k):
    x = np.array(values, float)[:, None]
    cost = changepoint.Cost(x, "l2")
    total = lambda cuts: sum(cost(a, b) for a, b in zip([0, *cuts], [*cuts, len(x)]))
    best = min(total(c) for c in itertools.combinations(range(2, len(x) - 1), k) if all(b - a >= 2 for a, b in zip([0, *c], [*c, len(x)])))
    found = {name: changepoint.segment(x, name, n_bkps=k, jump=1) for name in ("Dynp", "BottomUp", "Binseg")}
    assert total(found["Dynp"]) == pytest.approx(best, abs=1e-6)
    assert all(total(c) >= best - 1e-6 and len(c) <= k for c in found.values())
    pruned = changepoint.segment(x, "Pelt", pen=1.0, jump=1)
    assert total(pruned) + len(pruned) <= best + k + 1e-6


@pytest.mark.parametrize("model", changepoint.MODELS)
def test_costs_find_a_planted_change(model):
    rng = np.random.default_rng(1)
    n = 60
    if model in ("linear", "cosine"):
        x = rng.normal(size=(2 * n, 2)) + 5
        x[:, 0] = np.where(np.arange(2 * n) < n, 2, -3) * x[:, 1] + rng.normal(size=2 * n) / 10
    elif model == "clinear":
        x = np.r_[np.arange(n) * 1.0, n - 2.0 * np.arange(n)][:, None]
    elif model == "ar":
        x = np.r_[np.sin(np.arange(n)), np.sin(2.5 * np.arange(n))][:, None] + rng.normal(size=(2 * n, 1)) / 100
    else:
        x = np.r_[rng.normal(size=(n, 1)), 6 + 2 * rng.normal(size=(n, 1))]
    cuts = changepoint.segment(x, "Binseg", model, n_bkps=1, jump=1)
    assert abs(cuts[0] - n) <= 5
    cost = changepoint.Cost(x, model)
    assert cost(0, n) + cost(n, 2 * n) <= cost(0, 2 * n) + 1e-6


def test_unknown_algorithms_and_models_are_named():
    for how in ({"algo": "Nope"}, {"model": "nope"}, {"algo": "Pelt", "pen": None}):
        with pytest.raises(ValueError):
            changepoint.segment(np.arange(20.0), **how)


def guarded(track, start, end, target, reference, size, spacing, number, drops, most, rounds=3000):
    """The expansion with a plain round limit in place of the search for a repeated state."""
    length, left, right, calm = end - start, start, end, [0, 0]
    for _ in range(rounds):
        stop = []
        gap = [spacing * (1 + c) for c in calm]
        at = [[max(0, left - (i + 1) * gap[0] - track.offset) for i in range(number)], [max(0, right + i * gap[1] - track.offset) for i in range(number)]]
        for side in (0, 1):
            cov = [float(track.mean(np.array([s]), size)[0]) for s in at[side]]
            run = longest = 0
            for c in cov:
                run = run + 1 if c < target else 0
                longest = max(longest, run)
            stop.append(longest >= drops)
            lower = sum(0 < c < reference for c in cov)
            if stop[side]:
                calm[side] = 0
                continue
            empty = sum(c == 0 for c in cov) >= 3
            by = 2 * length if empty else max(1, number * gap[side])
            left, right = (max(0, left - by), right) if side == 0 else (left, right + by)
            if not empty:
                calm[side] = calm[side] + 1 if lower == 0 else 0
        left, right = max(start - most, left), min(end + most, right)
        if all(stop):
            break
    if right - left < 2 * length:
        mid, half = (start + end) // 2, length
        left, right = max(start - most, 0, mid - half), min(end + most, mid + half)
    return left, right


def test_expansion_equals_the_guarded_loop():
    r = random.Random(11)
    for _ in range(40):
        at, rows = 0, []
        while at < 3000:
            n = r.randint(5, 200)
            if r.random() < 0.85:
                rows.append((at, at + n, r.choice([5, 10, 20, 40])))
            at += n
        a, b, d = map(np.array, zip(*rows))
        start, most = r.randint(900, 1500), r.randint(200, 900)
        end = start + r.randint(20, 200)
        t = probes.Track(a, b, d, max(0, start - most), end + most)
        how = (start, end, r.choice([8, 15, 30]), r.choice([8, 15]), 10, 20, 6, r.randint(2, 5), most)
        assert probes.expand(t, *how) == guarded(t, *how)


def test_track_means_equal_a_dense_array():
    dense = np.zeros(100)
    rows = [(10, 20, 3), (20, 35, 5), (60, 61, 9), (95, 140, 2)]
    for s, e, d in rows:
        dense[s - 0 : min(e, 100)] += d
    t = probes.Track(*map(np.array, zip(*rows)), 0, 100)
    for s, n in itertools.product((0, 5, 18, 59, 90, 97, 100, 130), (1, 7, 30)):
        part = dense[s : s + n]
        got = t.mean(np.array([s]), n)[0]
        assert (np.isnan(got) and not len(part)) or got == pytest.approx(part.mean())


def test_linkage():
    bits = np.array([[0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [1] * 10, [0] * 9 + [1], [1] * 9 + [0], [0, 1] * 5])
    assert probes.average_linkage(bits, 0.15) == [0, 1, 0, 1, 2]
    assert probes.average_linkage(bits, 0.1) == [0, 1, 2, 3, 4]  # merging needs a distance below the threshold
    assert probes.average_linkage(bits[:1], 0.1) == [0] and probes.average_linkage(bits[:0], 0.1) == []


def test_matches_pairs_and_marks(spark):
    rd = spark.createDataFrame([("r1", "ACGTACGTTT"), ("r2", "TTTACG"), ("r3", None), ("r4", "GGGG")], "read string, seq string")
    pats = spark.createDataFrame([(0, "ACG", 1), (1, "TTT", 2), (2, "GTT", 3), (3, "ACG", 4), (4, "", 9), (5, None, 9)], "ord long, pattern string, breakpoint int")
    got = sorted((r.read, r.start, r.end, r.breakpoint) for r in patterns.pattern_matches(rd, pats).collect())
    assert got == [("r1", 0, 2, 4), ("r1", 4, 6, 4), ("r1", 6, 8, 3), ("r1", 7, 9, 2), ("r2", 0, 2, 2), ("r2", 3, 5, 4)]
    allowed = spark.createDataFrame([(4, 2), (2, 4)], "source int, target int")
    assert sorted((r.read, r.start, r.end, r.breakpoint) for r in patterns.pattern_matches(rd, pats, most=1).collect()) == got
    own, wanted = rd.withColumn("s", signal.F.lit("a")), pats.withColumn("s", signal.F.expr("CASE WHEN breakpoint = 2 THEN 'b' ELSE 'a' END"))
    for most in (100, 1):
        assert sorted((r.read, r.start, r.end, r.breakpoint) for r in patterns.pattern_matches(own, wanted, by="s", most=most).collect()) == [x for x in got if x[3] != 2]
    marked = sorted((r.read, r.b1, r.b2, r.marked) for r in patterns.junction_reads(rd, pats, allowed).collect())
    assert marked == [("r1", 4, 2, "ACGtacgTTT"), ("r2", 2, 4, "TTTACG")]
    assert patterns.junction_reads(rd, pats.where("false")).collect() == []
    assert sorted(patterns._finder([("AA", 1)])("AAA")) == [(0, 1, 1, "AA"), (1, 2, 1, "AA")]


def test_cells_and_filters(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    vals = [(r.choice([0.125, 2.675, 1.005, r.uniform(0, 99), 12.5, 3.0]), r.uniform(0, 9), r.randint(1, 99) / 2, r.randint(1, 9999), r.choice([0.25, 2.8, r.uniform(0, 4)])) for _ in range(200)]
    df = spark.createDataFrame(vals, "a double, b double, c double, d long, e double")
    got = [x[0] for x in df.select(matrix.packed_cell(*(F.col(x) for x in "abcde"))).collect()]
    assert got == [f"{round(a, 2)};{round(b, 2)};{round(c, 2)};{d};{round(e, 1)}" for a, b, c, d, e in vals]
    wide = spark.createDataFrame([("l:1", "1.0;2.0;3.0;4;1.9", "NA;NA;NA;NA;NA"), ("n", "1.0", None)], "locus string, s1 string, s2 string")
    from strandlake.plans.pipelines import parse

    rows = lambda df: sorted((x.locus, x.name, x.value) for x in df.collect())
    assert rows(parse(wide, ["RCN"])) == [("l:1", "s1_RCN", "1.9"), ("l:1", "s2_RCN", "NA"), ("n", "s1_RCN", "NA"), ("n", "s2_RCN", "NA")]
    assert rows(parse(wide, ["uDOC"]))[-1] == ("n", "s2_uDOC", "nan")
    assert {x[1] for x in rows(parse(wide, ["RCN", "uDOC"], matrix.parse_filter("l:1:>=:1.9"), "list"))} == {"s1"}
    with pytest.raises(ValueError):
        matrix.parse_filter("l:1:~:2")
    with pytest.raises(Exception):
        twice = spark.createDataFrame([("l", "s", "1"), ("l", "s", "2")], "locus string, sample string, cell string")
        matrix.to_wide(twice, ["s"], "cell").collect()


def test_hits_and_ids(spark):
    rows = [(0, "c:5_x_1_L", "c", 100, 90), (1, "c:5_x_1_L", "c", 205, 300), (2, "c:5_x_2_L", "c", 95, 96), (3, "noid", "c", 100, 100), (4, "c_7_y_1_R", "d", 100, 100), (5, "a_7_y_1_R", "c", 211, 400)]
    found = spark.createDataFrame(rows, "ord long, qseqid string, sseqid string, sstart long, send long")
    points = spark.createDataFrame([(1, "c", 100), (2, "c", 200), (7, "c", 500)], "breakpoint_number int, chromosome string, position long")
    got = sorted(r.ord for r in hits.near_other_breakpoint(found, points, 10).collect())
    assert got == [1, 2]
    only = spark.createDataFrame([(1, 2)], "source int, target int")
    assert sorted(r.ord for r in hits.near_other_breakpoint(found, points, 10, only).collect()) == [1]
    q = spark.createDataFrame([("q", "ACGTTGCAAC" * 3)], "id string, seq string")
    s = spark.createDataFrame([("s", "GG" + "acgttgcaac" * 3 + "TT")], "id string, seq string")
    best = max(alignment.local_hits(q, s, 20, 8).collect(), key=lambda r: r.length)
    assert (best.length, best.qstart, best.sstart) == (30, 1, 3)


def test_cigars(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("5S90M2D3I10N4M6S",), ("*",), (None,), ("10M",)], "c string")
    got = [r[0] for r in df.select(reads.reference_length(reads.parse_cigar(F.col("c")))).collect()]
    assert got == [106, None, None, 10]


def test_densify(spark):
    rows = [("a", 3, 5, "x"), ("a", 7, None, "y"), ("a", 7, 2, "z"), ("a", None, 9, "n"), ("b", 1, 4, "w")]
    got = intervals.densify(spark.createDataFrame(rows, "k string, pos long, depth int, note string"), ["k"])
    assert got.columns == ["k", "pos", "depth", "note"] and got.schema["depth"].dataType.simpleString() == "int"
    expected = [("a", 3, 5, "x"), ("a", 4, 0, None), ("a", 5, 0, None), ("a", 6, 0, None), ("a", 7, 0, "y"), ("a", 7, 2, "z"), ("b", 1, 4, "w")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert intervals.densify(spark.createDataFrame([], "k string, pos long, depth int"), ["k"]).count() == 0
