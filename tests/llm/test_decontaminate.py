import re

from strandlake.llm.decontaminate import drop_contaminated, find_items

from .conftest import edge_rows, prose, rows

ITEMS = [(1, " ".join(prose(4, 400).split()[30:55])), (2, "a"), (3, None), (4, "..."), (5, " ".join(prose(3, 120).split()[:10]).upper()), (None, " ".join(prose(4, 400).split()[100:112])), (6, "a"), (6, "a"), (7, " ".join(prose(1, 6000).split()[-11:])), (8, "not there at all in any of the texts my friend")]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(window):
    wins = set()
    for item, t in ITEMS:
        w = words(t)
        wins |= {(item, tuple(w[i : i + window])) for i in range(max(1, len(w) - window + 1))} if w else set()
    out = []
    for doc, t in edge_rows():
        w, hit, items = words(t), set(), set()
        for item, g in wins:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    items.add(item)
        names = sorted(str(i) for i in items if i is not None)
        out.append((doc, len(w), len(hit), len(names), ",".join(names), bool(hit)))
    return sorted(out, key=lambda x: tuple((v is None, str(type(v)), v) for v in x))


def test_against_brute_force(spark, edge):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for window in (10, 3):
        got = find_items(edge.repartition(3), items, window).selectExpr("doc_id", "n_words", "n_hit", "n_items", "array_join(items, ',') AS items", "contaminated")
        assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == plain(window)


def test_more_prefix_words_than_a_filter_holds(spark, edge):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = find_items(edge.repartition(3), items, 10, most=64).selectExpr("doc_id", "n_words", "n_hit", "n_items", "array_join(items, ',') AS items", "contaminated")
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == plain(10)


def test_one_word_under_many_windows(spark):
    """A prefix word of more windows than a row of the index holds; all of them in one text."""
    text = " ".join(f"rare a{i} b{i} c{i}" for i in range(300))
    items = spark.createDataFrame([(i, f"rare a{i} b{i} c{i}") for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, "c1 rare a1"), *((i, f"a{j} b{j} c{j} a{j} b{j} c{j}") for i, j in zip(range(3, 303), range(300)))], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in find_items(docs, items).collect()}
    assert got[1] == (1200, 300) and not any(got[i][0] for i in got if i != 1)


def test_drops_and_keeps_columns(spark, edge):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    from pyspark.sql import functions as F

    more = edge.withColumns({"_d": F.lit(1), "d": F.lit(1), "h": F.lit(2), "ks": F.lit(3)})
    left = drop_contaminated(more, items)
    assert left.columns == more.columns
    assert rows(left, "doc_id") == sorted([(r[0],) for r in plain(10) if not r[5]], key=lambda x: (x[0] is None, x[0]))


def test_empty_tables(spark, edge, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert find_items(none, items).collect() == []
    assert not [r for r in find_items(edge, items.where("false")).collect() if r.contaminated]
