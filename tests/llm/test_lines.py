import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm.lines import LEAST_BUCKETS, NO_ID, SPACE, Cuckoo, LineState, dedup_lines, delete, dropped_lines, insert, line_keys, references

from .conftest import edge_rows, rows


def plain(pairs, least=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    own = {}
    for d, t in pairs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                own.setdefault(key(x), set()).add(NO_ID if d is None else d)
    out = []
    for d, t in pairs:
        at = NO_ID if d is None else d
        ls = (t or "").split("\n")
        keep = [x for x in ls if len(own.get(key(x), ())) < 2 or min(own[key(x)]) == at]
        out.append((d, len(ls), len(ls) - len(keep), "\n".join(keep)))
    return sorted(out, key=lambda x: tuple((v is None, str(type(v)), v) for v in x))


def test_against_brute_force(edge):
    for batches, shard in ((2, 400_000), (3, 5)):
        got = dedup_lines(edge.repartition(3), batches=batches, shard_lines=shard)
        assert got.columns == [*edge.columns, "n_lines", "n_dropped"] and {r.drops for r in got.collect()} == {"x"}
        assert rows(got, "doc_id", "n_lines", "n_dropped", "text") == plain(edge_rows())


def test_two_texts_under_one_id_and_measures_of_other_names(spark):
    pairs = [(5, "shared line of text\nown line one here"), (5, "a line nobody else has\nown line two here"), (1, "shared line of text"), (5, "a line nobody else has\nown line two here")]
    df = spark.createDataFrame([(*p, 7, 8) for p in pairs], "doc_id long, text string, doc int, row int")
    got = dedup_lines(df, measures=("a", "b"))
    assert got.columns == ["doc_id", "text", "doc", "row", "a", "b"]
    assert rows(got, "doc_id", "a", "b", "text") == plain(pairs) and plain(pairs)[1][3] == "a line nobody else has\nown line two here"


def test_no_rows(none):
    assert dedup_lines(none).collect() == []


def test_deletion_is_as_if_never_inserted(spark):
    pairs = [(i, f"a common line of text\nanother line number {i % 3}\nonly here {i} {i}") for i in range(12)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    state = LineState(3)
    for k in range(3):
        state = insert(state, df.where(f"doc_id % 3 = {k}"), 10)
    gone = df.where("doc_id IN (0, 4, 7)")
    state = delete(state, gone)
    fresh = insert(LineState(3), df.where("doc_id NOT IN (0, 4, 7)"), 10)
    cols = ("k1", "k2", "refs", "first", "last")
    assert rows(references(state), *cols) == rows(references(fresh), *cols)
    assert rows(dropped_lines(state), "doc", "row", "drops") == rows(dropped_lines(fresh), "doc", "row", "drops")
    again = insert(state, gone, 10)
    whole = insert(LineState(3), df, 10)
    assert rows(references(again), *cols) == rows(references(whole), *cols)
    keys = [r.k2 for r in references(state).collect()]
    blobs = [Cuckoo(bytes(r.blob)) for r in state.filters.collect()]
    assert all(any(b.contains(np.array([k], np.int64).view(np.uint64))[0] for b in blobs) for k in keys)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=400), st.integers(0, 3))
def test_cuckoo_holds_what_it_was_given(values, times):
    h = np.array(values * (times + 1), np.uint64)
    c = Cuckoo()
    c.add(h)
    assert c.contains(h).all() or not len(h)
    c = Cuckoo(c.blob())
    c.remove(h[: len(h) // 2])
    assert c.contains(h[len(h) // 2 :]).all() or not len(h)


def test_deletion_with_keys_that_share_a_mark(spark):
    text = [f"a line of text {i}" for i in range(20_000)]
    k2 = {r.doc: r.k2 for r in line_keys(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"), 1, 10).collect()}
    at, mark = Cuckoo._places(np.array([k2[i] for i in range(len(text))], np.int64).view(np.uint64), LEAST_BUCKETS)
    met, pairs = {}, []
    for i, place in enumerate(zip(np.minimum(at, Cuckoo._other(at, mark, LEAST_BUCKETS)).tolist(), mark.tolist())):
        if place in met:
            pairs.append((text[met[place]], text[i]))
        met[place] = i
    assert pairs
    x, y = pairs[0]
    docs = {i: spark.createDataFrame([(i, t)], "doc_id long, text string") for i, t in ((1, x), (2, y), (3, y), (4, x))}
    cols = ("k1", "k2", "refs", "first", "last")
    for gone, kept, later in ((1, 2, 3), (2, 1, 4)):
        state = insert(insert(LineState(1), docs[1], 10), docs[2], 10)
        assert [r.seen for r in state.segments[1].collect()] == [True]
        state = insert(delete(state, docs[gone]), docs[later], 10)
        fresh = insert(LineState(1), docs[kept].union(docs[later]), 10)
        assert rows(references(state), *cols) == rows(references(fresh), *cols) and references(state).count() == 1
        assert rows(dropped_lines(state), "doc", "drops") == rows(dropped_lines(fresh), "doc", "drops") == [(later, [0])]


def test_deletion_takes_entries_out_and_leaves_other_shards_alone(spark):
    pairs = [(i, f"a line of document {i}\nanother of document {i}\na line that two share {i // 2}") for i in range(60)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    state = insert(insert(LineState(16), df.where("doc_id < 40"), 10), df.where("doc_id >= 40"), 10)
    marks = lambda st: {r.shard: sum(int((t != 0).sum()) for t in Cuckoo(bytes(r.blob)).tables) for r in st.filters.collect()}
    blobs = lambda st: {r.shard: bytes(r.blob) for r in st.filters.collect()}
    before = marks(state)
    after = delete(state, df.where("doc_id = 7"))
    keys = line_keys(df.where("doc_id = 7"), 16, 10).collect()
    lone = [r.shard for r in keys if references(state).where(f"k1 = {r.k1} AND k2 = {r.k2}").first().refs == 1]
    assert len(lone) == 2 and len(keys) == 3
    # the two lines that nobody else has leave two marks less, in their shards; the shared one keeps its own
    assert {k: before[k] - n for k, n in marks(after).items() if before[k] != n} == {k: lone.count(k) for k in lone}
    untouched = set(before) - {r.shard for r in keys}
    assert untouched and all(blobs(after)[k] == blobs(state)[k] for k in untouched)
    # what was written again are the shards of its lines only
    assert {r.shard for r in after.postings[-1].select("shard").distinct().collect()} <= {r.shard for r in keys}
    assert {r.shard for r in after.segments[-1].select("shard").distinct().collect()} <= {r.shard for r in keys}
    # all documents, one after the other: nothing is left
    for k in range(0, 60, 20):
        after = delete(after, df.where(f"doc_id >= {k} AND doc_id < {k + 20}"))
    assert references(after).collect() == [] and set(marks(after).values()) == {0} and dropped_lines(after).collect() == []


def test_deletion_from_a_shard_of_many_keys(spark):
    """A filter of 400,000 keys takes some new ones for old; deletions must lose none of them."""
    n, cols = 400_000, ("k1", "k2", "refs", "first", "last")
    doc = lambda i, text, a, b: spark.range(a, b).selectExpr(f"concat('{text} ', id) AS line").groupBy().agg(F.concat_ws("\n", F.collect_list("line")).alias("text")).select(F.lit(i).cast("long").alias("doc_id"), "text")
    a, b, c = doc(1, "a line of text", 0, n), doc(2, "another line", 0, n), doc(3, "a line of text", 0, n)
    state = insert(insert(LineState(1), a, 10), b, 10)
    assert state.segments[1].where("seen").count() > 0
    state = insert(delete(state, b), c, 10)
    table = references(state)
    assert table.count() == n == table.where("first = 1 AND last = 3 AND refs = 2").count() == table.select(*cols[:2]).distinct().count()
    assert dropped_lines(state).selectExpr("doc", "size(drops) AS n").collect() == [(3, n)]
