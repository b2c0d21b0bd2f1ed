import random
import re
from collections import Counter

from strandlake.llm import collocations as c

from .conftest import WORDS, edge_rows, rows

COLS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(docs, least, most=2000, words=5):
    """The contract, word for word: counts, cuts, containment and ranks, over lists."""
    f, n = {}, Counter()
    for lang, text in docs:
        low = (text or "").translate({ord(x): ord(x) + 32 for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        of = f.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            of.update(" ".join(w[i : i + k]) for k in range(1, words + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, of in f.items():
        often = {p: a for p, a in of.items() if a >= least}
        found = []
        for p, a in often.items():
            w = p.split(" ")
            if len(w) == 1 or any(x >= a and len(q) > len(p) and f" {p} " in f" {q} " for q, x in often.items()):
                continue
            cuts = [(often[" ".join(w[:k])], often[" ".join(w[k:])]) for k in range(1, len(w))]
            score, k = min((1000 * a * n[lang] // (l * r), k) for k, (l, r) in enumerate(cuts))
            found.append((-score, -a, p.encode(), p, a, *cuts[k], n[lang], score))
        out += [(lang, i, p, a, l, r, m, s) for i, (_, _, _, p, a, l, r, m, s) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def corpus():
    r = random.Random(5)
    out = [("en", t) for _, t in edge_rows()] + [(None, t) for _, t in edge_rows()[:6]] + [("und", "River soft RIVER\tsoft, river  soft"), ("fr", None), ("", "a b a b")]
    for _ in range(60):
        text = ""
        for _ in range(r.randint(0, 60)):
            text += r.choice(["open field table", "soft river", "Candle", "é à", *WORDS[:6]]) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";", "\x0b", "\x00 ", "\x85", " "])
        out.append((r.choice(["en", "de", None]), text))
    return out


def frame(spark, docs):
    return spark.createDataFrame(docs, "lang string, text string")


def test_equals_plain_counts(spark):
    docs = corpus()
    for least in (2, 7):
        assert rows(c.collocations(frame(spark, docs).repartition(5), least=least), *COLS) == plain(docs, least)
    assert rows(c.collocations(frame(spark, docs), most=3, least=3), *COLS) == plain(docs, 3, 3)


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    """Blocks and slices of a few bytes, in this process: phrases over slices count, phrases over blocks are summed."""
    docs = corpus()[:40]
    numbers = c._Numbers({b";": 0})
    whole = [list(map(int, x)) for x in c._stream(b" ".join((t or "").encode() for _, t in docs), numbers)]
    monkeypatch.setattr(c, "SLICE", 7)
    again = [list(map(int, x)) for x in c._stream(b" ".join((t or "").encode() for _, t in docs), c._Numbers({b";": 0}))]
    assert sum(whole, []) == sum(again, []) and len(again) > len(whole)
    assert rows(c.collocations(frame(spark, docs).repartition(40), least=3), *COLS) == plain(docs, 3)


def test_products_beyond_64_bits(spark):
    big = 9 * 10**14
    phrases = spark.createDataFrame([("x", "a", 1, big), ("x", "b", 1, big - 7), ("x", "a b", 2, big - 11)], "lang string, phrase string, k int, a long")
    got = c.scored(phrases, spark.createDataFrame([("x", 10**15)], "lang string, n long")).collect()
    assert [r.score for r in got] == [1000 * (big - 11) * 10**15 // (big * (big - 7))]


def test_ranks_of_one_language_in_parts(spark):
    phrases = [("x", f"w{i}", 1, 200) for i in range(90)] + [("x", f"w{i} w{i + 1}", 2, 100 + i % 3) for i in range(80)]
    f = spark.createDataFrame(phrases, "lang string, phrase string, k int, a long")
    kept = c.scored(f, spark.createDataFrame([("x", 10**6)], "lang string, n long"))
    assert kept.count() == 80 and c.whole(f).count() == 80


def test_edges(spark, edge, none):
    assert c.collocations(none).collect() == []
    assert rows(c.collocations(edge, least=5), *COLS) == plain([("en", t) for _, t in edge_rows()], 5)
