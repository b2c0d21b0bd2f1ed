"""Thin queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import table

SQL: dict[str, str] = {}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandlake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, most=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.lines import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL["op4_line_dedup"] = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
judged AS (SELECT doc_id, i, line, first IS NOT NULL AND first <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.decontaminate import find_items

    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL["op2_benchmark_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 10) AS n FROM iw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
lens AS (SELECT DISTINCT n FROM wins),
dg AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dg.n AS n, item_id FROM dg JOIN wins USING (n, g)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.quality_net import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.toxicity import classify_toxicity

    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.quality_rules import apply_policy, ledger

    found = apply_policy(ledger(table(spark, sf_dir, "documents")), "v1")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL["op5_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 20 * n_words OR 100 * n_upper > 40 * word_chars OR 100 * n_dup_lines > 40 * n_lines OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM m
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.secrets import KINDS, joined, scan

    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["rank"] < len(KINDS))
    # of a lambda with two arguments, a default one too, Spark makes the second the place in the array
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind, *_ in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.repeats import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), least=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op9_warc"] = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND n >= 1000
"""


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


SQL["op11_phrase_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) s WHERE len(w) >= k)),
totals AS (SELECT lang, CAST(count(*) AS HUGEINT) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT f.lang, f.phrase, f.k, f.a, c, array_to_string(list_slice(string_split(phrase, ' '), 1, c), ' ') AS lp, array_to_string(list_slice(string_split(phrase, ' '), c + 1, f.k), ' ') AS rp FROM f, (SELECT unnest(range(1, 5)) AS c) s WHERE c < f.k),
s AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, (1000 * CAST(c.a AS HUGEINT) * n) // (CAST(x.a AS HUGEINT) * y.a) AS score, c.c
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM s) WHERE o = 1),
whole AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = b.lang AND 100 * q.a >= 100 * b.a AND length(q.phrase) > length(b.phrase) AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM whole)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


def op12_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.sharding import assign, layout

    found = assign(table(spark, sf_dir, "documents"), layout(40), layout(41))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The CRC-32 table, by its rule, and a checksum taken byte by byte.
_CRC = "tab AS (SELECT list(v ORDER BY i) AS l FROM (WITH RECURSIVE t(i, k, v) AS (SELECT i, 0, CAST(i AS UBIGINT) FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END FROM t WHERE k < 8) SELECT * FROM t WHERE k = 8))"


def _crc(text: str) -> str:
    step = "lambda a, b: xor(a >> 8, l[CAST(xor(a, b) & 255 AS BIGINT) + 1])"
    return f"CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), [CAST('0x' || substr(hex(encode({text})), i, 2) AS UBIGINT) for i in range(1, 2 * octet_length(encode({text})), 2)]), {step}), CAST(4294967295 AS UBIGINT)) AS BIGINT)"


def _descent(nodes: str) -> str:
    """k, shard: the winners of the draws at the three levels."""
    draw = "-ln((CAST('0x' || substr(md5(k || ':' || path), 1, 13) AS BIGINT) + 1) / 4503599627370496.0) / weight"
    first = f"(SELECT k, arg_min(path, {draw}) AS won FROM keys, (SELECT growth || '/' || region AS path, sum(weight) AS weight FROM {nodes} GROUP BY 1) GROUP BY k)"
    second = f"(SELECT k, arg_min(path, {draw}) AS won FROM {first} JOIN (SELECT growth || '/' || region AS up, growth || '/' || region || '/' || rack AS path, sum(weight) AS weight FROM {nodes} GROUP BY 1, 2) ON up = won GROUP BY k)"
    return f"(SELECT k, arg_min(shard, {draw}) AS shard FROM {second} JOIN (SELECT growth || '/' || region || '/' || rack AS up, growth || '/' || region || '/' || rack || '/' || shard AS path, shard, weight FROM {nodes}) ON up = won GROUP BY k)"


SQL["op12_hash_tree_sharding"] = f"""
WITH {_CRC},
base AS (SELECT 0 AS growth, CAST(s // 20 AS INT) AS region, CAST(s // 5 % 4 AS INT) AS rack, CAST(s AS INT) AS shard, 1.0 AS weight FROM range(40) r(s)),
grown AS (SELECT * FROM base UNION ALL SELECT 1, 0, 0, 40, 1.0),
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents), keys AS (SELECT DISTINCT k FROM d),
rows AS (SELECT doc_id, CAST(octet_length(encode(t)) + 16 AS BIGINT) AS size, {_crc("t")} AS text_crc32, a.shard AS shard, b.shard AS grown_shard FROM tab, d JOIN {_descent("base")} a USING (k) JOIN {_descent("grown")} b USING (k))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM rows
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


SQL["op13_spelling_variants"] = rf"""
WITH RECURSIVE {_CRC},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
hashed AS (SELECT run, {_crc("doc || ':' || run")} AS h FROM runs, tab WHERE length(run) >= 7),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed),
w AS (SELECT word, count(*) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
gone AS (SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
near AS (SELECT a.word AS word, b.word AS other, b.n AS m FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, g.word, g.n FROM w JOIN gone g ON g.rest = w.word UNION SELECT g.word, w.word, w.n FROM w JOIN gone g ON g.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
chain(word, root, k) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, last AS root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, k) AS last FROM chain GROUP BY word) r ON r.word = f.word
"""
