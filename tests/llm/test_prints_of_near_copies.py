import random

import corpus_pipeline
from strandlake.llm.near_copies import similar_documents

from .conftest import edge_rows, prose
from .test_near_copies import plain as by_resemblance
from .test_near_copies import resemblance, shingle_set
from .test_simhash import plain_print, roots


def plain(pairs, prints, least=80):
    """component_id of each (doc_id, text), from all pairs, by fingerprints and by resemblance."""
    sets = [shingle_set(t) for _, t in pairs]
    fps = [plain_print(t, prints[0]) for _, t in pairs]
    close = lambda i, j: ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= prints[1]
    like = lambda i, j: sets[i] == sets[j] or (100 + least) * len(sets[i] & sets[j]) >= least * (len(sets[i]) + len(sets[j]))
    root = roots(len(pairs), lambda i, j: close(i, j) or like(i, j))
    first = {r: min((d for (d, _), x in zip(pairs, root) if x == r and d is not None), default=None) for r in set(root)}
    return [first[r] for r in root]


def of_one_fingerprint(seed, n):
    """Texts of one passage many times over and a tail of their own, each with a like text that has a few words less."""
    out = []
    for i in range(n):
        words = " ".join([*prose(seed, 21).split()] * 60 + [f"t{i}x{k}" for k in range(40)]).split()
        out += [" ".join(words), " ".join(words[:-3])]
    return out


def test_stage_links_fingerprints(spark):
    """Of texts with one fingerprint that share few kinds of shingles the pipeline keeps the first, and others' near copies go too."""
    texts = of_one_fingerprint(31, 4)
    assert resemblance(texts[0], texts[2]) < 0.3 and plain_print(texts[0], 3) == plain_print(texts[2], 3)
    pairs = list(enumerate([*texts, prose(32, 90), prose(32, 88), prose(33, 90), "", None], 5))
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert got == sorted({*plain(pairs, prints=(3, 2))}) == [5, 13, 15, 16]


def test_fingerprints_and_resemblance_together(spark, edge, none):
    """Components over links of both kinds equal those of all pairs, where buckets are crowded too."""
    r, texts = random.Random(17), [t for s in (41, 42) for t in of_one_fingerprint(s, 5)]
    for i in range(20):
        w = prose(50 + i // 4, 120).split()
        texts.append(" ".join(x if r.random() > 0.02 else f"z{i}" for x in w))
    for words, most in ((3, 2), (3, 7)):
        pairs = list(enumerate(texts)) + [(100 + (d or 0), t) for d, t in edge_rows()[1:7]]
        want = {d: c for (d, _), c in zip(pairs, plain(pairs, prints=(words, most)))}
        assert len(set(want.values())) < len(set(by_resemblance(pairs)))
        df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
        for crowd in (2, 8):
            assert {x.doc_id: x.component_id for x in similar_documents(df, crowd=crowd, prints=(words, most)).collect()} == want
    assert similar_documents(none, prints=(3, 2)).collect() == []
    key = lambda x: tuple((v is None, v or 0) for v in x)
    got = [(x.doc_id, x.component_id) for x in similar_documents(edge, prints=(3, 2)).collect()]
    assert sorted(got, key=key) == sorted(((d, c) for (d, _), c in zip(edge_rows(), plain(edge_rows(), prints=(3, 2)))), key=key)
