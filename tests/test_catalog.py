"""Every query against DuckDB or a plain version on the same tables."""

import os
import re

import duckdb
import numpy as np
import pytest

from strandlake.operators import intervals, probes
from strandlake.plans import catalog

from .test_operators import guarded

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def plain(v):
    if v is None or v != v or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return round(float(v), 6) if isinstance(v, (int, float, np.integer, np.floating)) or type(v).__name__ == "Decimal" else str(v)


def table(pdf, cols):
    return sorted((tuple(plain(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", catalog.SQL)
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    want = duck.execute(catalog.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert table(got, cols) == table(want, cols)


def track(spark):
    pdf = catalog._track(spark, DIR).toPandas().sort_values(["event_type", "rn"])
    pdf["moving_average"] = pdf.groupby("event_type")["norm"].transform(lambda s: s.rolling(catalog.W, center=True, min_periods=1).median())
    return pdf


def merged(x, n_bkps, jump=5):
    """Bottom-up with all merges compared anew each time, and the squared error of any cuts."""
    x = x.reshape(len(x), -1)
    error = lambda a, b: float(((x[a:b] - x[a:b].mean(0)) ** 2).sum())
    total = lambda cuts: sum(error(a, b) for a, b in zip([0, *cuts], [*cuts, len(x)]))
    cuts = [c for c in range(jump, len(x), jump) if len(x) - c >= 2]
    while len(cuts) > n_bkps:
        ends = [0, *cuts, len(x)]
        cuts.remove(min(cuts, key=lambda c: (round(error(ends[ends.index(c) - 1], ends[ends.index(c) + 1]) - error(ends[ends.index(c) - 1], c) - error(c, ends[ends.index(c) + 1]), 9), c)))
    return cuts, total


def test_changepoint_bottomup(spark):
    got = catalog.changepoint_bottomup(spark, DIR).toPandas()
    for kind, own in track(spark).groupby("event_type"):
        cuts, total = merged(own["moving_average"].to_numpy(), 3)
        mine = sorted(got[got["event_type"] == kind].sort_values("breakpoint_number")["position"].map(dict(zip(own["pos"], range(len(own))))))
        # equal merges may go in another order, by the last digits of their costs
        assert len(mine) == 3 and total(mine) <= 1.05 * total(cuts) + 1e-9


def test_changepoint_multivariate(spark):
    got = catalog.changepoint_multivariate(spark, DIR).toPandas().sort_values("breakpoint_number")
    wide = track(spark).pivot(index="pos", columns="event_type", values="moving_average").sort_index().interpolate(limit_direction="both")
    cuts, total = merged(wide.to_numpy(), 3)
    mine = [wide.index.get_loc(p) for p in got["position"]]
    assert len(mine) == 3 and sorted(mine) == mine and total(mine) <= 1.05 * total(cuts) + 1e-9


def test_hamming_clusters(spark):
    wide = catalog._probed(spark, DIR).toPandas().pivot(index="event_type", columns="probe", values="ratio").sort_index()
    bits = (wide > 0.9).to_numpy()
    groups = [[i] for i in range(len(bits))]
    apart = lambda a, b: np.mean([(bits[i] != bits[j]).mean() for i in a for j in b])
    while len(groups) > 1:
        d, i, j = min((round(apart(a, b), 12), i, j) for j, b in enumerate(groups) for i, a in enumerate(groups[:j]))
        if d >= 0.3:
            break
        groups[i] += groups.pop(j)
    want = {frozenset(wide.index[k] for k in g) for g in groups}
    got = catalog.hamming_clusters(spark, DIR).toPandas()
    assert {frozenset(g["event_type"]) for _, g in got.groupby("cluster")} == want


def test_expand_interval(spark):
    runs = intervals.depth_runs(catalog._blocks(spark, DIR), ["sample"]).toPandas()
    spans = intervals.locus_span(catalog._loci(spark)).toPandas().set_index("locus")
    got = {(r.sample, r.locus): (r.plot_start, r.plot_end) for r in catalog.expand_interval(spark, DIR).collect()}
    want = {}
    for r in catalog._found(spark, DIR).collect():
        a, b = int(spans.loc[r.locus, "start"]), int(spans.loc[r.locus, "end"])
        own = runs[(runs["sample"] == r.sample) & (runs["start"] < b + 600) & (runs["end"] > max(0, a - 600))]
        t = probes.Track(own["start"].to_numpy(), own["end"].to_numpy(), own["depth"].to_numpy(), max(0, a - 600), b + 600)
        want[r.sample, r.locus] = guarded(t, a, b, r.mean, r.mean, 5, 10, 8, 5, 600)
    assert got == want and len(got) > 5


def test_junction_reads(spark, duck):
    clips = {}
    for item, text in sorted(duck.execute("SELECT item_id, text FROM benchmark").fetchall()):
        half = len(text) // 2
        clips |= {text[:half]: 1, text[len(text) - half :]: 2}
    want = {}
    for doc, text in duck.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        found = sorted((m.start() + len(p) - 1, -len(p), m.start(), b, p) for p, b in clips.items() for m in re.finditer(f"(?={re.escape(p)})", text))
        for i, x in enumerate(found):
            if (y := next((y for y in found[i + 1 :] if y[3] != x[3]), None)) and (doc, x[3], y[3]) not in want:
                marks = {k for e, n, s, _, _ in (x, y) for k in range(s, e + 1)}
                fold = lambda c, up: (c.upper() if up else c.lower()) if c.isascii() else c
                want[doc, x[3], y[3]] = "".join(fold(c, k in marks) for k, c in enumerate(text))
    got = {(r.doc_id, r.b1, r.b2): r.marked for r in catalog.junction_reads(spark, DIR).collect()}
    assert got == want and want


def local_score(q, s):
    """The best local score by whole rows: 1, -2, -2.5 a base of a gap; doubled, in whole numbers."""
    best, row = 0, np.zeros(len(s) + 1, np.int64)
    ramp = 5 * np.arange(len(s) + 1)
    for c in q:
        new = np.maximum(0, row - 5)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(s == c, 2, -4))
        row = np.maximum.accumulate(new + ramp) - ramp
        best = max(best, int(row.max()))
    return best


def test_seeded_hits(spark, duck):
    """Every pair that shares 28 characters has a hit of the best local score; others have none that is better than their best."""
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    items = {str(i): t.upper() for i, t in duck.execute("SELECT item_id, text FROM benchmark WHERE text IS NOT NULL").fetchall()}
    docs = {str(i): t.upper() for i, t in duck.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()}
    found = {}
    for r in catalog.seeded_hits(spark, DIR).collect():
        gaps = 2 * r.length - (r.qend - r.qstart + 1) - (r.send - r.sstart + 1)
        score = 2 * (r.length - r.mismatch - gaps) - 4 * r.mismatch - 5 * gaps
        found[r.qseqid, r.sseqid] = max(found.get((r.qseqid, r.sseqid), 0), score)
        assert local_score(codes(items[r.qseqid][r.qstart - 1 : r.qend]), codes(docs[r.sseqid][r.sstart - 1 : r.send])) == score
    grams = {}
    for i, t in items.items():
        for k in range(len(t) - 27):
            grams.setdefault(t[k : k + 28], set()).add(i)
    want = {(i, d) for d, t in docs.items() for k in range(len(t) - 27) for i in grams.get(t[k : k + 28], ())}
    assert want and want <= found.keys()
    worse = 0
    for i, d in found:
        best = local_score(codes(items[i]), codes(docs[d]))
        assert found[i, d] <= best
        worse += found[i, d] < best
    assert worse <= len(found) // 20  # chains further apart than the band join in no alignment


def test_every_query_is_held_against_something():
    plain = {n.removeprefix("test_") for n in globals() if n.startswith("test_")}
    assert set(catalog.QUERIES) - set(catalog.SQL) <= plain
