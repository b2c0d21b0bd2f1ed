import hashlib
import random
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandlake.llm.repeats import intervals, remove_repeats, repeat_groups

from .conftest import edge_rows, prose, rows


def plain(docs, least):
    counts = Counter(d[i : i + least] for d in docs for i in range(len(d) - least + 1))
    out = []
    for d in docs:
        gone = bytearray(len(d))
        for i in range(len(d) - least + 1):
            if counts[d[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def judged(spark, pairs, least, k, crowd=30_000, parts=3, piece=400_000):
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(parts)
    got = remove_repeats(df, least, k, crowd, piece).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS sha")
    want = [(d, *x) for (d, _), x in zip(pairs, plain([(t or "").encode() for _, t in pairs], least))]
    return rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "sha"), sorted(want, key=lambda x: tuple((v is None, str(type(v)), v) for v in x))


def test_edges(spark):
    got, want = judged(spark, edge_rows(), 200, 64)
    assert got == want


def test_other_lengths_and_crowded_buckets(spark):
    for least, k, crowd in ((40, 12, 30_000), (200, 64, 1), (60, 60, 2)):
        got, want = judged(spark, edge_rows(), least, k, crowd)
        assert got == want


def test_long_texts_go_piece_by_piece(spark):
    for least, k, piece in ((200, 64, 500), (40, 12, 30), (40, 40, 7)):
        got, want = judged(spark, edge_rows(), least, k, piece=piece)
        assert got == want


def groups_hold(spark, pairs, least, k, crowd):
    """Each group is one string with all places that it has, and the groups cover just what is removed; its strings and places."""
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    texts = {d: (t or "").encode() for d, t in pairs}
    found = {}
    for r in repeat_groups(df, least, k, crowd).collect():
        found.setdefault((r.repeat, texts[r.doc_id][r.start : r.start + r.length]), set()).add((r.doc_id, r.start))
        assert r.length == len(texts[r.doc_id][r.start : r.start + r.length]) >= least
    assert len({name for name, _ in found}) == len(found) == len({x for _, x in found})
    covered = {d: bytearray(len(t)) for d, t in texts.items()}
    for (_, x), places in found.items():
        assert places == {(d, i) for d, t in texts.items() for i in range(len(t)) if t.startswith(x, i)} and len(places) > 1
        for d, i in places:
            covered[d][i : i + len(x)] = b"\1" * len(x)
    gone = {r.doc_id: r.n_removed for r in remove_repeats(df, least, k, crowd).collect()}
    assert {d: sum(c) for d, c in covered.items()} == gone
    return {x: places for (_, x), places in found.items()}


def test_groups_have_all_their_places(spark):
    r = random.Random(6)
    junk = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passages = [junk(r.randint(42, 52)) for _ in range(12)]
    pairs = [(i, junk(30) + passages[i % 12] + junk(20) + passages[(5 * i + 1) % 12] + junk(9)) for i in range(30)] + [(90, junk(70)), (91, None), (92, "short")]
    pairs += [(93, pairs[0][1]), (94, "ab" * 60)]
    for crowd in (4000, 2):
        found = groups_hold(spark, pairs, 40, 10, crowd)
        assert sum(p.encode() in found for p in passages) > (8 if crowd == 4000 else -1)


def test_passages_in_many_texts(spark):
    r = random.Random(5)
    passage = prose(90, 60)
    pairs = []
    for i in range(60):
        a, b = sorted((r.randint(0, 40), r.randint(150, len(passage))))
        pairs.append((i, prose(100 + i, 30) + passage[a:b] + prose(200 + i, 20)))
    for crowd in (30_000, 5):
        got, want = judged(spark, pairs, 200, 64, crowd)
        assert got == want


def test_one_crowded_anchor(spark):
    """One k-gram in all texts, with surroundings that all differ, and some that don't."""
    r = random.Random(12)
    word = lambda n: "".join(r.choice("bcdefghijk") for _ in range(n))
    own = [word(30) for _ in range(15)]
    pairs = [(i, word(25) + r.choice(own)[r.randint(0, 9) :] + "a" * 14 + r.choice(own)[: r.randint(14, 30)] + word(25)) for i in range(300)]
    for crowd in (4000, 20):
        got, want = judged(spark, pairs, 40, 12, crowd)
        assert got == want and sum(x[2] > 0 for x in want) > 60


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab\n", max_size=90), max_size=6))
def test_small_alphabets(spark, texts):
    if texts:
        got, want = judged(spark, list(enumerate(texts)), 12, 5, 3, 2)
        assert got == want


def test_no_rows(none):
    assert remove_repeats(none).collect() == []


def test_intervals():
    import numpy as np

    lo, hi, length = intervals(np.array([-1, 2, 4, 1, -1, 3]))
    assert sorted(zip(lo.tolist(), hi.tolist(), length.tolist())) == [(0, 3, 2), (0, 4, 1), (1, 3, 4), (4, 6, 3)]
