import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strandlake.llm.packing import best_fit, pack

from .conftest import edge_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(capacity):
    t, out = Tokenizer.from_file(PATH), []
    for doc, text in edge_rows():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out += [(doc, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    return out


def check(got, capacity, want):
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=lambda x: tuple((v is None, v or 0) for v in x)) == sorted(want, key=lambda x: tuple((v is None, v or 0) for v in x)), key
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= capacity
    return len(bins)


def test_pieces_and_places(edge):
    for capacity in (64, 2048):
        got = pack(edge.repartition(3), PATH, capacity).collect()
        n = check(got, capacity, plain(capacity))
        assert n <= -(-sum(r.length for r in got) // capacity) + 2


def test_levels_and_pieces(edge):
    got = pack(edge.repartition(9), PATH, 256, fan_in=2).collect()
    check(got, 256, plain(256))


def merged(leaves, capacity, slack, fan_in, bounded):
    """Fills of all bins after the tree, with all underfull bins handed on or only those that nodes above can use up."""
    final = []
    while True:
        nodes = [[s for leaf in leaves[k : k + fan_in] for s in leaf] for k in range(0, len(leaves), fan_in)]
        above, up = len(nodes), 0
        while above > 1:
            above, up = -(-above // fan_in), up + 1
        small = max(sum(2 * s <= capacity for s in n) for n in nodes)
        if bounded:
            nodes = []
            for k in range(0, len(leaves), fan_in):
                nodes.append([])
                for leaf in leaves[k : k + fan_in]:
                    for s in set(leaf):
                        n = min(leaf.count(s), small + fan_in * up)
                        nodes[-1] += [s] * n
                        final += [s] * (leaf.count(s) - n)
        packed = [np.bincount(best_fit(np.array(n, np.int64), capacity), n).astype(int).tolist() if n else [] for n in nodes]
        last = len(nodes) == 1
        final += [s for n in packed for s in n if last or s >= capacity - slack]
        if last:
            return sorted(final)
        leaves = [[s for s in n if s < capacity - slack] for n in packed]


def test_what_is_not_handed_on_is_never_needed():
    rng = np.random.default_rng(3)
    for round_ in range(30):
        leaves = []
        for _ in range(rng.integers(2, 30)):
            sizes = rng.choice([rng.integers(51, 100), rng.integers(51, 100), rng.integers(1, 50)], rng.integers(1, 200), p=[0.6, 0.39, 0.01])
            leaves.append([s for s in np.bincount(best_fit(sizes, 100), sizes).astype(int).tolist() if s < 98])
        assert merged(leaves, 100, 2, 3, False) == merged(leaves, 100, 2, 3, True), round_


def test_special_strings_and_foreign_letters(spark):
    texts = ["a <|endoftext|> b", "Σίσυφος ΣΑΣ", "日本語 text", "don't we'll 3½", "İstanbul", "tab\tNL\n nb sp"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.ids_crc32 for r in pack(docs, PATH).collect()}
    assert got == {i: zlib.crc32(np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, x in enumerate(texts)}


def test_no_rows(none):
    assert pack(none, PATH).collect() == []


def test_best_fit_ties():
    bins = best_fit(np.array([5, 5, 5, 5, 3, 2, 10]), 10)
    assert len(set(bins.tolist())) == 4
