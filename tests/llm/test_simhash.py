import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from strandlake.llm.graph import components
from strandlake.llm.gray_index import Tree, forest, gray_rank, search
from strandlake.llm.simhash import fingerprint, near_duplicates, near_links

from .conftest import edge_rows, rows


def plain_print(t, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    hs = [xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    f = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return f - (1 << 64) if f >> 63 else f


def roots(n, linked):
    parent = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        while parent[i] != i:
            i = parent[i]
        out.append(i)
    return out


def test_against_brute_force(edge):
    pairs = edge_rows()
    for words, most in ((3, 2), (5, 6)):
        fps = [plain_print(t, words) for _, t in pairs]
        root = roots(len(pairs), lambda i, j, f=fps, m=most: ((f[i] ^ f[j]) & (2**64 - 1)).bit_count() <= m)
        least = {r: min((d for (d, _), x in zip(pairs, root) if x == r and d is not None), default=None) for r in root}
        want = [(d, f, least[r]) for (d, _), f, r in zip(pairs, fps, root)]
        got = rows(near_duplicates(edge.repartition(3), words, most), "doc_id", "fp", "component_id")
        assert got == sorted(want, key=lambda x: tuple((v is None, str(type(v)), v) for v in x))


def test_no_documents(none):
    assert near_duplicates(none).collect() == []


def clustered(n, seed, most):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            out.add(x)
            for _ in range(r.randint(1, most + 1)):
                x ^= 1 << r.randrange(64)
    return sorted(out)[:n]


def same_components(fps, edges, most):
    at = {f: i for i, f in enumerate(fps)}
    want = roots(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= most)
    joined = {(at[a], at[b]) for a, b in edges}
    return want == roots(len(fps), lambda i, j: (i, j) in joined or (j, i) in joined)


def test_index_finds_all_pairs():
    for seed, most in ((1, 2), (2, 4), (3, 1)):
        fps = clustered(400, seed, most)
        x = np.array(fps, np.uint64)[:, None]
        want = {(i, j) for j in range(400) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= most}
        a = Tree(x, np.full(400, most))
        assert {tuple(sorted(p)) for u, v in search(a, scale=2) for p in zip(a.order[u].tolist(), a.order[v].tolist())} == want
        one, two = Tree(x[:150], np.full(150, most)), Tree(x[150:], np.full(250, most))
        across = {(p, 150 + q) for u, v in search(one, two, scale=2) for p, q in zip(one.order[u].tolist(), two.order[v].tolist())}
        assert across == {(i, j) for i, j in want if i < 150 <= j}


def test_buckets_labels_and_allowances():
    r = random.Random(4)
    x = np.array([[a, b] for a, b in zip(clustered(300, 5, 6), clustered(300, 6, 6))], np.uint64)
    bucket, label, allow = (np.array([r.randrange(k) for _ in range(300)]) for k in (7, 3, 40))
    tree = Tree(x, allow, bucket, label)
    got = [tuple(sorted(p)) for u, v in search(tree, scale=3) for p in zip(tree.order[u].tolist(), tree.order[v].tolist())]
    differ = lambda i, j: int(np.bitwise_count(x[i] ^ x[j]).sum())
    want = {(i, j) for j in range(300) for i in range(j) if bucket[i] == bucket[j] and label[i] != label[j] and 3 * differ(i, j) <= allow[i] + allow[j]}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_links_across_ranges_of_rank(spark):
    fps = clustered(250, 4, 2)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for group, pack in ((100_000, 100_000), (20, 4), (1, 1000), (1, 24)):
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in near_links(df, 2, group, pack).collect()]
        assert same_components(fps, edges, 2)


def test_a_crowd_around_one_fingerprint(spark):
    near = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for j in range(64) for i in range(j)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in near + [0x7777_7777_7777_7777]], "fp long")
    root = {r.node: r.root for r in components(near_links(df, 2, 100)).collect()}
    assert len(root) == len(near) and len(set(root.values())) == 1


def test_gray_neighbours_differ_in_one_bit():
    i = np.arange(1000, dtype=np.uint64)
    g = i ^ (i >> np.uint64(1))
    assert (gray_rank(g) == i).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 4), (7, 7), (8, None), *((k, k + 1) for k in range(10, 40)), *((100, k) for k in range(101, 150))]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {k: 10 for k in range(10, 41)} | {k: 100 for k in range(100, 150)}
    for few in (1000, 0):
        assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), few).collect()} == want
        assert components(spark.createDataFrame([], "a long, b long"), few).collect() == []


def test_forest():
    at, low = forest(6, [(np.array([5, 5, 1]), np.array([3, 2, 0]))])
    assert dict(zip(at.tolist(), low.tolist())) == {5: 2, 3: 2, 1: 0}


def test_fingerprint_of_short_texts():
    assert fingerprint("", 3) == 0 == fingerprint(" \n", 3)
    assert fingerprint("One Two", 3) == plain_print("one two", 3)
