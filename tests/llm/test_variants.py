import random
import re
import zlib
from collections import Counter

from strandlake.llm import variants as v

from .conftest import edge_rows, rows

COLS = ("word", "form", "root", "n", "n_near", "form_n")


def plain_words(docs, noise=31):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            if h % noise == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n, times=10):
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    form = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= times * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=lambda x: tuple((y is None, str(type(y)), y) for y in x))


def spelt(seed, n):
    """Documents of few words with many spellings each, in numbers that make chains of forms."""
    r, out = random.Random(seed), []
    for k in range(n):
        words = []
        for _ in range(r.randint(0, 40)):
            w = r.choice(["general", "generale", "aaaaaaaa", "éclairages", "Zeichnung", "abababab", "throughout"])
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                i = r.randrange(len(w) + 1)
                w = r.choice([w[:i] + r.choice("abé") + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice("abÿ") + w[i + 1 :]])
            words.append(w)
        out.append((k, r.choice([" ", "-", "\n"]).join(words)))
    return out


def test_words_and_forms_equal_brute_force(spark):
    docs = spelt(3, 150) + edge_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    n = plain_words(docs)
    assert dict(rows(v.counted_words(df), "word", "n")) == n
    for times in (10, 2):
        assert rows(v.spelling_variants(df, times=times), *COLS) == plain(n, times)


def test_each_pair_once_whatever_the_edit(spark):
    base = ["abcdefg", "aaaaaaa", "abababab", "éàüöñçß", "mississippis", "x" * 40 + "y" * 3]
    n = {}
    for w in base:
        for i in range(len(w) + 1):
            for k, c in enumerate("aéz"):
                n[w[:i] + c + w[i:]], n[w[:i] + c + w[i + 1 :]] = 2 + k, 3
            n[w[:i] + w[i + 1 :]] = 4
        n[w] = 50
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = [tuple(sorted((r.a, r.b))) for r in v.near_pairs(words).collect()]
    long = [w for w in n if len(w) >= 4]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in long for b in long if a < b and one_edit(a, b)}
    assert all(n[r.a] == r.a_n and n[r.b] == r.b_n for r in v.near_pairs(words).collect())


def test_long_chains_reach_their_root(spark):
    words = ["a" * (7 + k) for k in range(9)]
    n = {w: 2 * 10**k for k, w in enumerate(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    found = v.forms(df, v.near_pairs(df))
    assert {r.root for r in v.roots(found).collect()} == {words[-1]}


def test_ties_go_to_the_smallest_form(spark):
    df = spark.createDataFrame([("generab", 2), ("generaz", 20), ("generaé", 20), ("generay", 20)], "word string, n long")
    assert [(r.form, r.form_n, r.n_near) for r in v.forms(df, v.near_pairs(df)).where("word = 'generab'").collect()] == [("generay", 20, 3)]


def test_edges(spark, edge, none):
    assert v.spelling_variants(none).collect() == []
    assert rows(v.spelling_variants(edge), *COLS) == plain(plain_words(edge_rows()))
