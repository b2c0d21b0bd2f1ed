import random

import numpy as np

from strandlake.llm.near_copies import one_of_each, prefix_length, similar_documents

from .conftest import EXTRA, edge_rows, prose
from .test_simhash import roots


def shingle_set(text, words=5):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def resemblance(x, y):
    x, y = shingle_set(x), shingle_set(y)
    return len(x & y) / len(x | y) if x or y else 1.0


def plain(pairs, least=80):
    """component_id of each (doc_id, text), from all pairs."""
    sets = [shingle_set(t) for _, t in pairs]
    like = lambda i, j: sets[i] == sets[j] or (100 + least) * len(sets[i] & sets[j]) >= least * (len(sets[i]) + len(sets[j]))
    root = roots(len(pairs), like)
    first = {r: min((d for (d, _), x in zip(pairs, root) if x == r and d is not None), default=None) for r in set(root)}
    return [first[r] for r in root]


def found(spark, pairs, crowd=8, parts=3):
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(parts)
    return {r.doc_id: r.component_id for r in similar_documents(df, crowd=crowd).collect()}


def test_edges(spark, edge, none):
    got = similar_documents(edge.repartition(3)).collect()
    want = [(d, c) for (d, _), c in zip(edge_rows(), plain(edge_rows()))]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert similar_documents(none).collect() == [] == one_of_each(none).collect()


def test_one_of_each(spark, edge):
    from pyspark.sql import functions as F

    left = one_of_each(edge.withColumns({"d": F.lit(1), "h": F.lit(2), "H_": F.lit(3)}))
    assert left.columns == [*edge.columns, "d", "h", "H_"]
    got = sorted((r.doc_id, r.text or "") for r in left.collect() if r.doc_id is not None)
    assert got == sorted((d, t or "") for (d, t), c in zip(edge_rows(), plain(edge_rows())) if d is not None and d == c)
    assert {r.row for r in left.collect()} == {EXTRA["row"]}


def test_two_texts_under_one_id(spark):
    a, b = prose(1, 100), prose(2, 100)
    df = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in one_of_each(df).collect()) == [(3, b), (5, a)]


def passage_pairs(seed, shares):
    """Texts, each followed by itself with a passage appended, dropped or replaced, of a share of its words."""
    r, docs = random.Random(seed), []
    word = lambda: f"w{int(r.paretovariate(0.7)) % 5000}"
    for n in (60, 100, 300, 900):
        for share in shares:
            for kind in ("appended", "dropped", "replaced") * 3:
                w, more = [word() for _ in range(n)], [word() for _ in range(int(n * share))]
                at = r.randrange(n - len(more))
                v = w + more if kind == "appended" else w[:at] + (more if kind == "replaced" else []) + w[at + len(more) :]
                docs += [" ".join(w), " ".join(v)]
    return docs


def test_changed_passages_and_swapped_words(spark):
    r, texts = random.Random(21), passage_pairs(8, (0.05, 0.1, 0.15, 0.2, 0.25, 0.3))
    for n in (100, 400):
        for swaps in (0.01, 0.02, 0.04, 0.05, 0.06, 0.08):
            for _ in range(6):
                w = [f"x{r.randrange(10**6)}" for _ in range(n)]
                texts += [" ".join(w), " ".join(f"y{k}" if r.random() < swaps else x for k, x in enumerate(w))]
    near = [resemblance(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)]
    assert sum(0.65 <= j < 0.8 for j in near) > 20 < sum(0.8 <= j < 0.85 for j in near)
    pairs = list(enumerate(texts))
    assert found(spark, pairs) == {d: c for (d, _), c in zip(pairs, plain(pairs))}


def test_crowds_of_copies_of_one_text(spark):
    """Chains, stars and whole groups of near copies, in buckets that are crowded and in such that are not."""
    r = random.Random(9)
    base = prose(7, 200).split()
    star = [" ".join(w if r.random() > 0.018 else f"s{i}{k}" for k, w in enumerate(base)) for i in range(60)]
    chain, w = [], prose(8, 150).split()
    for i in range(30):
        w = [x if k % 29 != i % 29 else f"c{i}" for k, x in enumerate(w)]
        chain.append(" ".join(w))
    form = [f"{prose(9, 150)} tail {i} of {i % 3}" for i in range(30)]
    low = [" ".join(prose(10, 100).split()[:70] + prose(500 + i, 60).split()) for i in range(30)]
    pairs = list(enumerate([" ".join(base), *star, *chain, *form, *low]))
    want = {d: c for (d, _), c in zip(pairs, plain(pairs))}
    assert len(set(want.values())) > 30
    for crowd in (2, 1000):
        assert found(spark, pairs, crowd) == want


def test_recall_and_precision_on_the_corpus(spark):
    """All links at 0.8 of two scales are found, and no others, by counts of shared shingles over all texts."""
    import pyarrow.parquet as pq

    for sf in ("sf0.001", "sf0.01"):
        t = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
        pairs = list(zip(t["doc_id"], t["text"]))
        assert found(spark, pairs) == {d: c for (d, _), c in zip(pairs, plain(pairs))}


def test_prefixes_meet():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 40)
        x = set(r.sample(range(60), n))
        y = (x | set(r.sample(range(60), r.randint(0, 8)))) - set(r.sample(range(60), r.randint(0, 8)))
        if y and len(x & y) >= 0.8 * len(x | y):
            assert set(sorted(x)[: prefix_length(len(x), 80)]) & set(sorted(y)[: prefix_length(len(y), 80)])
    assert prefix_length(0, 80) == 0 and np.all([prefix_length(n, 80) <= n for n in range(1, 99)])
