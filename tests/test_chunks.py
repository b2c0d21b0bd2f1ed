import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.operators import changepoint, chunks, intervals, signal


def track(seed=0, n=120):
    """Two tracks with gaps, null values and a null key."""
    r = np.random.default_rng(seed)
    rows = []
    for k in ("a", "b", None):
        for p in sorted(r.choice(np.arange(-40, 3 * n), n, replace=False)):
            rows.append((k, int(p), None if r.random() < 0.1 else float(r.integers(0, 9)), float(r.normal())))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, pos long, v double, norm double").repartition(3)


def collected(df):
    pdf = df.toPandas()
    pdf = pdf[sorted(pdf.columns)]
    return pdf.sort_values([c for c in ("k", "pos", "island", "start", "rn", "norm") if c in pdf.columns], kind="stable").reset_index(drop=True)


K = ["k"]
OPERATIONS = {
    "numbered": lambda t: signal.numbered(t, K),
    "median": lambda t: signal.moving_median(signal.numbered(t, K), K, "v", "m", 6),
    "wide median": lambda t: signal.moving_median(signal.numbered(t, K), K, "v", "m", 75),
    "variance": lambda t: signal.moving_variance(signal.numbered(t, K), K, "v", "m", 5),
    "one row": lambda t: signal.moving_variance(signal.numbered(t, K), K, "v", "m", 1),
    "covariance": lambda t: signal.moving_covariance(signal.numbered(t.fillna(3.0, ["v"]), K), K, "v", "m", 6),
    "rescale": lambda t: signal.rescale(t, K, "v", "norm"),
    "limits": lambda t: signal.within_limits(t, K, "v", 2, "max"),
    "own least": lambda t: signal.within_limits(t, K, "v", "min", "min"),
    "bins": lambda t: signal.bin_means(t, K, 13, ["pos", "v"]),
    "islands": lambda t: signal.islands(t.where("v > 2"), K, 3),
    "one island": lambda t: signal.islands(t, K, 1000),
    "runs": lambda t: signal.longest_run(signal.numbered(t, K), K, F.col("v") > 1),
    "align": lambda t: signal.align(t.where("k IS NOT NULL").withColumn("g", F.lit("x")), ["g"], "k", "v"),
    "fill": lambda t: signal.fill_with_mean(t, K, "v"),
    "densify": lambda t: intervals.densify(t, K, "v"),
    "single cut": lambda t: changepoint.best_single_cut(signal.numbered(t.where("v IS NOT NULL"), K), K, "v"),
}


@pytest.mark.parametrize("name", OPERATIONS)
def test_chunks_of_any_size_give_the_same(spark, monkeypatch, name):
    t = frame(spark, track())
    whole = collected(OPERATIONS[name](t))
    monkeypatch.setattr(chunks, "CHUNK", 7)
    pd.testing.assert_frame_equal(collected(OPERATIONS[name](t)), whole, check_exact=False, rtol=1e-12, atol=1e-12, check_dtype=False)
    assert len(whole) > 0


def test_no_task_holds_a_track(spark, monkeypatch):
    """Groups that a kernel gets are a chunk and its halo, whatever the length of the track."""
    monkeypatch.setattr(chunks, "CHUNK", 64)
    t = signal.numbered(spark.range(5000).select(F.lit("t").alias("k"), F.col("id").alias("pos"), F.col("id").cast("double").alias("v")), K)
    rows = chunks.moving(t, K, 9, m=("median", "v"), c=("covariance", "v"))
    assert rows.count() == 5000 and rows.where("m IS NULL").count() == 0
    at = F.col("rn") - 1
    sizes = t.withColumn("_c", F.explode(F.sequence(chunks.of(at - 8), chunks.of(at + 8)))).groupBy("_c").count().agg(F.max("count")).first()[0]
    assert sizes <= 64 + 16
    # windows over rows are partitioned by chunk; those by track alone order chunks
    for df in (t, signal.islands(t, K), signal.rescale(t, K, "v", "v"), signal.longest_run(t, K, F.col("v") > 3)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        specs = [line for line in plan.splitlines() if line.strip(" +-:").startswith("Window ")]
        assert specs and all("_c#" in line for line in specs)


@pytest.mark.parametrize("w", [1, 2, 7, 24, 200])
def test_moments_are_compensated(w):
    r = np.random.default_rng(w)
    small = r.normal(size=300)
    small[r.choice(300, 30, replace=False)] = np.nan
    other = r.normal(size=300)
    ints = np.round(small * 8) / 8  # exact at any offset here
    others = np.round(other * 8) / 8
    for offset in (0.0, 1e9, -1e12):
        n, mean, squares, both = chunks.moments(w, ints + offset, others + offset)
        for i in range(300):
            a, b = max(0, i - w // 2), i + (w - 1) // 2 + 1
            x, y = ints[a:b], others[a:b]
            ok = ~np.isnan(x)
            x, y = x[ok], y[ok]
            assert n[i] == len(x)
            if len(x):
                assert abs(mean[i] - offset - x.mean()) <= 1e-9 + 1e-15 * abs(offset)
                scale = 1e-9 if abs(offset) <= 1e9 else 1e-3
                assert abs(squares[i] - ((x - x.mean()) ** 2).sum()) < scale * max(1, w)
                assert abs(both[i] - ((x - x.mean()) * (y - y.mean())).sum()) < scale * max(1, w)


def test_a_step_inside_a_window_costs_no_digits():
    x = np.r_[np.zeros(40), 1e9 + np.arange(40) % 5]
    n, _, squares, _ = chunks.moments(10, x)
    want = [((x[max(0, i - 5) : i + 5] - x[max(0, i - 5) : i + 5].mean()) ** 2).sum() for i in range(80)]
    assert np.allclose(squares[50:], want[50:], rtol=1e-9) and np.allclose(squares, want, rtol=1e-9)


def test_windows_of_no_rows_are_refused(spark):
    with pytest.raises(ValueError):
        signal.moving_median(signal.numbered(frame(spark, track()), K), K, "v", "m", 0)
