import random
import zlib

import numpy as np

from strandlake.llm.labelled import sample
from strandlake.llm.quality_net import classify_quality, drop_low_quality
from strandlake.llm.quality_net import fit as fit_quality
from strandlake.llm.toxicity import IDENTITY, classify_toxicity
from strandlake.llm.toxicity import fit as fit_toxicity

from .conftest import edge_rows, prose


def out(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 3 == 1


def made(n=300):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        t, bad, toxic = prose(1000 + i, r.randint(20, 90)), i % 4 == 0, i % 5 == 0
        if bad:
            t = " ".join(w + "***" for w in t.split())
        if toxic:
            t += f" you {r.choice(['vile', 'rotten', 'wretch'])} "
        if i % 2:
            t += f" my {r.choice(IDENTITY['en'])} friend"
        docs.append((i, t))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_scores_on_held_out_rows(spark):
    docs, labels = made()
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for f, at, limit in ((classify_quality, 1, 0.5), (classify_toxicity, 2, 0.7)):
        got = {r.doc_id: r for r in f(d.repartition(3), l).collect()}
        assert all(r.held_out == out(k) and 0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for k, r in got.items())
        held = [x for x in labels if out(x[0])]
        assert np.mean([got[x[0]].predicted == x[at] for x in held]) > 0.95
    # labels of held-out rows change nothing
    other = spark.createDataFrame([(i, 1 - q, 1 - t) if out(i) else (i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in classify_quality(d, l).collect()} == {r.doc_id: r.score for r in classify_quality(d, other).collect()}


def test_edges(spark, edge, none):
    docs, labels = made(120)
    l = spark.createDataFrame(labels + [(None, 1, 0), (3, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (classify_quality, classify_toxicity):
        got = f(edge, l).collect()
        assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 and r.held_out == out(r.doc_id) for r in got)
        assert len({r.score for r in got if r.doc_id == 6}) == 1
        assert f(none, l).collect() == []
    assert all(r.predicted == 1 for r in classify_quality(edge, l.where("false")).collect())
    assert all(r.predicted == 0 for r in classify_toxicity(edge, l.where("false")).collect())
    assert drop_low_quality(edge, l.where("false")).columns == edge.columns


def test_sample_is_bounded_and_repeatable(spark):
    docs, labels = made(200)
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts, y, w = sample(d, l, "quality", 10)
    again = sample(d.repartition(5), l.repartition(4), "quality", 10)
    assert len(texts) == 20 and texts == again[0] and (y == again[1]).all() and np.allclose(w, again[2])


def test_sample_takes_one_text_an_id_and_documents_with_labels(spark):
    docs = [(i % 40, f"text {i}") for i in range(400)]
    labels = [(i, i % 2, 0) for i in range(2000)] + [(3, 1, 0)] * 50
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts, y, _ = sample(d, l, "quality", 10)
    own = [i for i in range(40) if not out(i)]
    assert len(texts) == len(y) == sum(min(10, sum(i % 2 == k for i in own)) for k in (0, 1))
    assert set(texts) <= {min(t for j, t in docs if j == i) for i in own}
    assert len(sample(d, l, "quality", 10, most_bytes=20)[0]) == 6


def test_neutral_mentions_of_groups_with_and_without_the_penalty(spark):
    """Labels in which one group stands in toxic texts mostly: held-out texts that only mention it."""
    r, docs, labels = random.Random(8), [], []
    for i in range(900):
        toxic, lean = i % 3 == 0, r.random()
        group = ("muslim" if lean < 0.8 else "christian") if toxic else ("muslim" if lean < 0.15 else "christian")
        said = r.choice(["vile", "rotten", "wretch"]) if toxic and r.random() < 0.8 else ""
        docs.append((i, f"{prose(3000 + i, 15)} the {group} people {said} came"))
        labels.append((i, 1, int(toxic)))
    neutral = [(1000 + i, f"{prose(9000 + i // 2, 12)} the {g} people came by") for i in range(120) for g in [("muslim", "christian")[i % 2]]]
    d, l = spark.createDataFrame(docs + neutral, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    change, truth = {}, {}
    for fair in (0.0, 3.0):
        got = {x.doc_id: x for x in classify_toxicity(d, l, fair=fair).collect()}
        change[fair] = np.mean([abs(got[1000 + i].score - got[1001 + i].score) for i in range(0, 120, 2)])
        truth[fair] = np.mean([got[i].predicted == 1 for i, t in docs if out(i) and any(w in t for w in ("vile", "rotten", "wretch"))])
    assert change[3.0] < 0.25 * change[0.0] and change[0.0] > 0.1
    assert truth[3.0] > 0.95


def test_made_sentences_act_where_no_label_names_a_group():
    """A telling beginning that a group's name shares by chance: without the penalty the bare name counts."""
    texts = [f"{prose(i, 12)} {'muslik' if i % 2 else 'garden'}" for i in range(400)]
    y, odd = np.arange(400) % 2, lambda m, t: float(np.log(m.score([t])[0] / (1 - m.score([t])[0])))
    gap = {fair: odd(m, "my muslim friends came to dinner") - odd(m, "my people friends came to dinner") for fair in (0.0, 3.0) for m in [fit_toxicity(texts, y, np.ones(400), fair=fair)]}
    assert gap[0.0] > 1 and abs(gap[3.0]) < 0.3 * gap[0.0]
    assert abs(odd(fit_toxicity(texts, y, np.ones(400), terms={"xx": ["gardener", "farmer"]}), "the gardener")) > 0


def test_swapping_a_group_changes_little():
    texts, y = [], []
    for i in range(400):
        toxic = i % 2
        group = "muslim" if i % 8 < 6 and toxic else "christian"  # mentions lean to one side in the labels
        texts.append(f"{prose(i, 12)} the {group} people {'rotten' if toxic and i % 3 else 'came'}")
        y.append(toxic)
    y = np.array(y)
    gap = lambda m: abs(np.subtract(*(np.log(s / (1 - s)) for s in m.score(["the muslim people came", "the christian people came"]))))
    free, fair = fit_toxicity(texts, y, np.ones(400), fair=0.0), fit_toxicity(texts, y, np.ones(400), fair=50.0)
    assert gap(fair) < 0.5 * gap(free)


def test_one_class_and_no_rows():
    assert fit_quality([], np.zeros(0, int), np.zeros(0)).score(["x", ""]).min() > 0.5
    assert fit_quality(["a b"] * 9, np.zeros(9, int), np.ones(9)).score(["x"])[0] < 0.5
    assert fit_toxicity(["a"], np.array([0]), np.ones(1)).score(["x"])[0] < 0.1
