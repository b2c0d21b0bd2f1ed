import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from strandlake.llm import queries
from strandlake.llm.quality_net import classify_quality

from .conftest import rows
from .test_decontaminate import words
from .test_lines import plain as plain_lines
from .test_near_copies import plain as plain_groups
from .test_packing import check


def test_stages_over_a_small_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    names_of = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names_of) == 5
    kept = corpus_pipeline.quality(spark, docs, sf)
    good = classify_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1")
    assert kept.columns == names and rows(kept, "doc_id") == rows(good, "doc_id")
    clean = corpus_pipeline.lines(spark, kept, sf)
    want = plain_lines([(r.doc_id, r.text) for r in kept.collect()])
    assert clean.columns == names and rows(clean, "doc_id", "text") == [(d, t) for d, _, _, t in want]
    assert clean.where("n_chars != char_length(text)").count() == 0
    pairs = rows(clean, "doc_id", "text")
    single = corpus_pipeline.near_copies(spark, clean, sf)
    assert single.columns == names and rows(single, "doc_id", "text") == [p for p, c in zip(pairs, plain_groups(pairs)) if p[0] == c]
    assert single.count() < clean.count()
    pairs = rows(single, "doc_id", "text")
    wins = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in [words(r.text)] if w for i in range(max(1, len(w) - 9))}
    sizes = {len(g) for g in wins}
    hit = lambda w: any(tuple(w[i : i + n]) in wins for n in sizes for i in range(len(w) - n + 1))
    free = corpus_pipeline.benchmarks(spark, single, sf)
    assert free.columns == names and rows(free, "doc_id", "text") == [p for p in pairs if not hit(words(p[1]))]
    assert 0 < free.count() < single.count()
    packed = corpus_pipeline.packing(spark, free, sf).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, text in rows(free, "doc_id", "text"):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        want += [(d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    n = check(packed, 2048, want)
    assert rows(corpus_pipeline.run(spark, sf), "doc_id", "piece", "ids_crc32") == sorted((d, k, crc) for d, k, _, _, crc in want)
    assert n <= -(-sum(r.length for r in packed) // 2048) + 1


def test_stages_keep_columns_of_any_name(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = {c: F.lit(k) for k, c in enumerate("drops n_lines n_dropped lines dropped d h doc row _d _h _doc _stays ks fp w key label score".split())}
    docs = docs.withColumns(extra)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.agg(*(F.min(c).alias(c) for c in extra)).first()[:] == tuple(range(len(extra)))


def test_every_query_has_its_columns(spark, sf):
    want = {
        "op1": "doc_id piece start length ids_crc32 sequence_id offset", "op2": "doc_id n_words n_hit n_items items_sha256 contaminated", "op3": "doc_id n_bytes n_removed n_spans kept_sha256", "op4": "doc_id n_lines n_dropped kept_sha256",
        "op5": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op6": "doc_id fingerprint component_id", "op7": "doc_id n_assign n_access n_hex base_sha256 spans", "op8": "doc_id held_out score predicted",
        "op9": "page_id payload_bytes payload_digest record_type refers_to", "op10": "doc_id held_out score predicted",
        "op11": "lang rank phrase a l r n score", "op12": "doc_id size text_crc32 law shard slot grown_shard", "op13": "word form root n n_near form_n",
    }
    for name, f in vars(queries).items():
        if name.startswith("op") and callable(f):
            assert f(spark, sf).columns == want[name.split("_")[0]].split(), name
