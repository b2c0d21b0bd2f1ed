import zlib
from collections import Counter, defaultdict

import pytest

from strandlake.llm.sharding import Leaf, assign, layout, moves

from .conftest import edge_rows, rows


def many(spark, n=20_000):
    return spark.range(n).selectExpr("id AS doc_id", "concat('t', id) AS text")


def places(spark, tree, n=20_000):
    from pyspark.sql import functions as F

    from strandlake.llm.sharding import shard_of

    return {r.doc_id: r.s for r in many(spark, n).select("doc_id", shard_of(F.col("doc_id").cast("string"), tree).alias("s")).collect()}


def test_sizes_checksums_and_gapless_slots(spark, edge, none):
    got = assign(edge.repartition(5), layout(40), layout(41)).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in edge_rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(x) == 1 for x in by_id.values())
    assert assign(none, layout(40)).collect() == []


def test_one_id_with_a_third_of_all_rows(spark):
    df = many(spark, 3000).selectExpr("CASE WHEN doc_id % 3 = 0 THEN 7 ELSE doc_id END AS doc_id", "CASE WHEN doc_id % 6 = 0 THEN 'same' ELSE text END AS text")
    got = assign(df.repartition(7), layout(40)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, r.doc_id, r["size"], r.text_crc32))
    assert len(got) == 3000
    for x in slots.values():
        x.sort()
        assert [s[0] for s in x] == list(range(len(x))) and [s[1:] for s in x] == sorted(s[1:] for s in x)


def test_shares_follow_weights_and_growth_takes_only_into_itself(spark):
    before = places(spark, layout(40))
    sizes = Counter(before.values())
    assert len(sizes) == 40 and all(abs(n - 500) < 5 * 500**0.5 for n in sizes.values())
    last = before
    for n in (41, 42, 43, 48):  # each step on its own, also after other growth
        now = places(spark, layout(n))
        assert all(now[d] == s or now[d] >= 40 and (now[d] > s or s < 40) for d, s in last.items())
        assert set(x for d, x in now.items() if x != last[d]) <= set(range(len(set(last.values())), n))
        last = now
    assert abs(Counter(last.values())[47] - 20_000 / 48) < 5 * (20_000 / 48) ** 0.5
    heavy = [Leaf(x.shard, x.region, x.rack, 3.0 if x.shard == 5 else 1.0) for x in layout(40)]
    assert abs(Counter(places(spark, heavy).values())[5] - 20_000 * 3 / 42) < 6 * (20_000 * 3 / 42) ** 0.5


def test_changed_weights_move_keys_in_changed_subtrees_only(spark):
    tree = layout(40)
    lighter = [Leaf(x.shard, x.region, x.rack, 0.25 if x.shard == 3 else 1.0) for x in tree]  # region 0, rack 0
    before, after = places(spark, tree), places(spark, lighter)
    place = {x.shard: (x.region, x.rack) for x in tree}
    for d, s in before.items():
        (r0, k0), (r1, k1) = place[s], place[after[d]]
        if s != after[d]:
            assert r0 == 0  # only what lies in the region that became lighter moves, to the other one, or out of the rack that did
            assert r1 == 1 or k0 == 0
    n = Counter((before[d], after[d]) for d in before)
    got = {(r.shard, r.other_shard): r.n for r in moves(many(spark), tree, lighter).collect()}
    assert got == n


def test_trees_that_make_no_sense(spark):
    for tree in ([], [Leaf(0, 0, 0, 0.0)], [Leaf(0, 0, 0), Leaf(0, 0, 1)]):
        with pytest.raises(ValueError):
            assign(many(spark, 3), tree)
    assert {r.shard for r in assign(many(spark, 9), [Leaf(6, 0, 0)]).collect()} == {6}


def test_query_depends_on_ids_only(spark, sf):
    a = places(spark, layout(40), 500)
    docs = many(spark, 500).selectExpr("doc_id", "upper(text) AS text", "1 AS shard", "'x' AS slot", "2.0 AS size")
    assert dict(rows(assign(docs.repartition(3), layout(40)), "doc_id", "shard")) == a
