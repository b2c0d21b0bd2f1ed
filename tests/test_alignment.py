import random

import pytest

from strandlake.operators import alignment as al


def smith_waterman(q, s):
    """The best local score, cell by cell: 1, -2, -2.5 a base of a gap."""
    best, above = 0.0, [0.0] * (len(s) + 1)
    for a in q:
        row = [0.0]
        for j, b in enumerate(s, 1):
            row.append(max(0.0, above[j - 1] + (1 if a == b else -2), above[j] - 2.5, row[-1] - 2.5))
        best, above = max(best, max(row)), row
    return best


def rescored(q, s, r, other):
    """A hit's score by its own columns."""
    return (r.length - r.mismatch - gap_bases(r)) - 2 * r.mismatch - 2.5 * gap_bases(r)


def gap_bases(r):
    return 2 * r.length - (r.qend - r.qstart + 1) - (abs(r.send - r.sstart) + 1)


def dna(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def sequences():
    r = random.Random(6)
    refs = {f"s{k}": dna(r, 700) for k in range(5)}
    queries = {}
    for k in range(14):
        at = r.randrange(500)
        q = refs[f"s{k % 5}"][at : at + 140]
        for _ in range(k % 4):  # mismatches and gaps far enough apart for a whole word between two
            i = r.choice([35, 70, 105]) + r.randrange(3)
            q = r.choice([q[:i] + dna(r, 1) + q[i + 1 :], q[:i] + dna(r, r.randint(1, 4)) + q[i:], q[:i] + q[i + r.randint(1, 4) :]])
        queries[f"q{k}"] = dna(r, r.randrange(20)) + q + dna(r, r.randrange(20))
    queries |= {"none": dna(r, 100), "short": "ACGT", "empty": "", "small": queries["q0"][30:90].lower()}
    return queries, refs


@pytest.mark.parametrize("word", [28, 16])
def test_best_scores_equal_smith_waterman(spark, sequences, word):
    queries, refs = sequences
    frame = lambda d: spark.createDataFrame([*d.items(), ("null", None)], "id string, seq string")
    hits = al.local_hits(frame(queries), frame(refs), word=word).collect()
    best = {}
    for r in hits:
        q, s = queries[r.qseqid].upper(), refs[r.sseqid]
        score = rescored(q, s, r, False)
        assert abs((al.LAMBDA * score - __import__("math").log(al.K)) / __import__("math").log(2) - r.bitscore) < 1e-9
        assert smith_waterman(q[r.qstart - 1 : r.qend], s[r.sstart - 1 : r.send]) == score
        best[r.qseqid, r.sseqid] = max(best.get((r.qseqid, r.sseqid), 0), score)
    shared = lambda q, s: any(q[i : i + word] in s for i in range(len(q) - word + 1))
    for a, q in queries.items():
        for b, s in refs.items():
            plain = smith_waterman(q.upper(), s)
            if shared(q.upper(), s):
                assert best[a, b] == plain
            else:
                assert (a, b) not in best or best[a, b] <= plain
    assert len(best) >= 14


def test_pieces_and_both_strands(spark, sequences):
    queries, refs = sequences
    frame = lambda d: spark.createDataFrame(list(d.items()), "id string, seq string")
    whole = {tuple(r)[:10] for r in al.local_hits(frame(queries), frame(refs)).collect()}
    cut = al.pieces(frame(refs), 450, 380)
    assert cut.groupBy("id").count().where("count > 1").count() == 5
    best = lambda rows: {(r[0], r[1]): max(x[3] for x in rows if x[:2] == r[:2]) for r in rows}
    pieces = {tuple(r)[:10] for r in al.local_hits(frame(queries), cut).collect()}
    assert best(pieces) == best(whole)
    turned = {k: q.upper().translate(str.maketrans("ACGT", "TGCA"))[::-1] for k, q in queries.items()}
    back = al.local_hits(frame(turned), frame(refs), both_strands=True).collect()
    assert {(r.qseqid, r.sseqid, len(turned[r.qseqid]) + 1 - r.qend, len(turned[r.qseqid]) + 1 - r.qstart, r.send, r.sstart) for r in back} == {(w[0], w[1], *w[6:10]) for w in whole}


def test_nothing_to_align(spark):
    none = spark.createDataFrame([], "id string, seq string")
    assert al.local_hits(none, none).collect() == []
    with pytest.raises(ValueError):
        al.local_hits(none, none, word=5, k=9)
    with pytest.raises(ValueError):
        al.pieces(none, 10, 10)
