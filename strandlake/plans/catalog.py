"""Queries that run the engine's operators over the driver's tables, and DuckDB SQL for what SQL can express.

Shipments stand for reads: [ship date, ship date + quantity days), with the return flag as sample. Events per hour and type
stand for depth tracks, orders for mated reads, documents and benchmark passages for sequences and clips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import alignment, changepoint, hits, intervals, matrix, patterns, probes, reads, signal, stats
from strandlake.plans import pipelines

QUERIES: dict = {}
SQL: dict[str, str] = {}

LOCI = "VALUES ('reference', 0, 9300, 9420), ('alpha', 1, 9800, 9900), ('alpha', 2, 9950, 10000), ('beta', 3, 10500, 10600), ('gamma', 4, 11000, 11003)"
POINTS = "VALUES (1, 9500), (2, 9560), (3, 9620)"
KEY = ["event_type"]
NORM, W = "reference", 24

_R = "(SELECT l_returnflag AS sample, CAST(epoch(l_shipdate) / 86400 AS BIGINT) AS s, CAST(epoch(l_shipdate) / 86400 AS BIGINT) + CAST(l_quantity AS BIGINT) AS e FROM lineitem WHERE l_discount >= 0.02)"
_L = f"({LOCI}) AS loci(locus, ord, rs, re)"
_D = f"(SELECT sample, locus, ord, pos, count(*) AS depth FROM (SELECT sample, locus, ord, unnest(range(greatest(s, rs), least(e, re))) AS pos FROM {_R} r JOIN {_L} ON s < re AND e > rs) GROUP BY ALL)"
_S = f"(SELECT sample, locus, avg(depth) AS mean, coalesce(stddev_samp(depth), 0) AS sd, median(depth) AS median, count(*) AS covered_bases FROM {_D} d GROUP BY ALL)"
_N = f"(SELECT a.*, a.median / b.median AS rcn FROM {_S} a JOIN (SELECT sample, median FROM {_S} x WHERE locus = 'reference') b USING (sample))"
_T = "(SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) - 473352 AS pos, count(*) AS depth, count(*) / 3.0 AS norm, row_number() OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch(ts) / 3600) AS BIGINT)) AS rn FROM events GROUP BY event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT))"


def _frame(w: int) -> str:
    return f"OVER (PARTITION BY event_type ORDER BY pos ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(c: str):
    return F.unix_date(F.to_date(c)).cast("long")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as reads: the discount, in thousandths, is the mapping quality, and reads below 20 don't count, as in every depth."""
    rows = _table(spark, sf_dir, "lineitem").withColumns({"flag": F.lit(0), "mapq": F.round(F.col("l_discount") * 1000).cast("int")})
    rows = reads.usable(rows, 20)
    return rows.select(F.col("l_returnflag").alias("sample"), F.lit("days").alias("chrom"), _day("l_shipdate").alias("start"), (_day("l_shipdate") + F.col("l_quantity").cast("long")).alias("end"))


def _loci(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT locus, 'days' AS chrom, ord, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS end FROM {LOCI} AS t(locus, ord, s, e)")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.coverage(_blocks(spark, sf_dir), _loci(spark), NORM, 64)


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = (F.floor(F.unix_timestamp("ts") / 3600) - 473352).cast("long")
    rows = _table(spark, sf_dir, "events").groupBy("event_type", hour.alias("pos")).agg(F.count("*").alias("depth"))
    return signal.numbered(rows.withColumn("norm", F.col("depth") / 3.0), KEY)


def _r(*cols: str, n: int = 6):
    return [F.round(c, n).alias(c) for c in cols]


# --- depth, statistics, matrices


@query(f"SELECT sample, locus, ord, pos, depth FROM {_D} d")
def interval_depth(spark, sf_dir):
    runs = pipelines.locus_runs(_blocks(spark, sf_dir), _loci(spark), 64)
    return intervals.per_position(runs, ["sample", "locus", "ord"])


@query(f"SELECT sample, locus, round(mean, 6) AS mean, round(sd, 6) AS sd, median, covered_bases FROM {_S} s")
def locus_stats(spark, sf_dir):
    found = stats.locus_stats(pipelines.locus_runs(_blocks(spark, sf_dir), _loci(spark), 64), ["sample", "locus"])
    return found.select("sample", "locus", *_r("mean", "sd"), "median", "covered_bases")


@query(f"SELECT sample, locus, median, round(rcn, 6) AS rcn FROM {_N} n")
def normalise_rcn(spark, sf_dir):
    return _found(spark, sf_dir).select("sample", "locus", "median", *_r("rcn"))


@query(f"SELECT sample, locus, round(rcn, 6) AS rcn FROM {_N} n WHERE rcn > 0.99")
def candidate_filter(spark, sf_dir):
    return stats.candidates(_found(spark, sf_dir), 0.99).select("sample", "locus", *_r("rcn"))


_CELL = "regexp_replace(printf('%.2f', mean), '0$', '') || ';' || regexp_replace(printf('%.2f', sd), '0$', '') || ';' || regexp_replace(printf('%.2f', median), '0$', '') || ';' || covered_bases || ';' || printf('%.1f', rcn)"


@query(f"SELECT sample, locus, {_CELL} AS cell FROM {_N} n")
def packed_matrix_long(spark, sf_dir):
    return pipelines.packed(_found(spark, sf_dir))


@query(f"SELECT locus, max(CASE WHEN sample = 'A' THEN cell END) AS \"A\", max(CASE WHEN sample = 'N' THEN cell END) AS \"N\", max(CASE WHEN sample = 'R' THEN cell END) AS \"R\" FROM (SELECT sample, locus, {_CELL} AS cell FROM {_N} n) GROUP BY locus")
def long_to_wide(spark, sf_dir):
    return matrix.to_wide(pipelines.packed(_found(spark, sf_dir)), ["A", "N", "R"], "cell")


def _wide(spark, sf_dir):
    return matrix.to_wide(pipelines.packed(_found(spark, sf_dir)), ["A", "N", "R"], "cell")


_FIELDS = f"(SELECT locus, sample || '_' || f AS name, v AS value FROM (SELECT locus, sample, unnest(['medDOC', 'RCN']) AS f, unnest([regexp_replace(printf('%.2f', median), '0$', ''), printf('%.1f', rcn)]) AS v FROM {_N} n))"


@query(f"SELECT * FROM {_FIELDS} f")
def parse_field(spark, sf_dir):
    return pipelines.parse(_wide(spark, sf_dir), ["medDOC", "RCN"])


@query(f"SELECT * FROM {_FIELDS} f WHERE name IN (SELECT name FROM {_FIELDS} g WHERE locus = 'alpha' AND TRY_CAST(value AS DOUBLE) > 1.0)")
def parse_column_filter(spark, sf_dir):
    return pipelines.parse(_wide(spark, sf_dir), ["medDOC", "RCN"], ("alpha", ">", 1.0))


_SPAN = "(SELECT CAST(l_suppkey AS VARCHAR) AS locus, arg_min('days' || l_returnflag, l_orderkey * 10 + l_linenumber) AS chrom, CAST(min(epoch(l_shipdate) / 86400) AS BIGINT) AS s, max(CAST(epoch(l_shipdate) / 86400 AS BIGINT) + CAST(l_quantity AS BIGINT)) AS e FROM lineitem GROUP BY 1)"


def _spans(spark, sf_dir):
    """Each supplier's shipments as the regions of a locus."""
    start = _day("l_shipdate")
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("locus"), F.concat(F.lit("days"), "l_returnflag").alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return intervals.locus_span(rows)


@query(f'SELECT locus, chrom, s AS start, e AS "end" FROM {_SPAN} x')
def locus_span(spark, sf_dir):
    return _spans(spark, sf_dir)


@query(f"SELECT locus, CAST(greatest(1, s - (e - s) * 2) AS BIGINT) AS plot_start, CAST(least(length, e + (e - s) * 2) AS BIGINT) AS plot_end FROM {_SPAN} x JOIN (SELECT 'days' || l_returnflag AS chrom, max(CAST(epoch(l_shipdate) / 86400 AS BIGINT)) + 3000 AS length FROM lineitem GROUP BY 1) USING (chrom)")
def proportional_interval(spark, sf_dir):
    lengths = _table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("days"), "l_returnflag").alias("chrom")).agg((F.max(_day("l_shipdate")) + 3000).alias("length"))
    return intervals.proportional_interval(_spans(spark, sf_dir), 2, lengths).select("locus", "plot_start", "plot_end")


@query(f"SELECT sample, locus, ord, count(*) AS pairs, CAST(sum(least(e, re) - greatest(s, rs)) AS BIGINT) AS bases FROM {_R} r JOIN {_L} ON s < re AND e > rs GROUP BY ALL")
def range_overlap_join(spark, sf_dir):
    where = _loci(spark).select("locus", "ord", "chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    met = intervals.range_join(_blocks(spark, sf_dir), where, ["chrom"], 64)
    return met.groupBy("sample", "locus", "ord").agg(F.count("*").alias("pairs"), F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("bases"))


@query("SELECT l_returnflag AS sample, d AS pos, coalesce(n, 0) AS depth FROM (SELECT l_returnflag, unnest(range(min(CAST(epoch(l_shipdate) / 86400 AS BIGINT)), max(CAST(epoch(l_shipdate) / 86400 AS BIGINT)) + 1)) AS d FROM lineitem GROUP BY 1) LEFT JOIN (SELECT l_returnflag, CAST(epoch(l_shipdate) / 86400 AS BIGINT) AS d, count(*) AS n FROM lineitem GROUP BY ALL) USING (l_returnflag, d)")
def densified_depth(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("sample"), _day("l_shipdate").alias("pos")).agg(F.count("*").alias("depth"))
    return intervals.densify(rows, ["sample"])


@query(f"SELECT coalesce(median(depth), 0.0) AS median FROM {_T} t WHERE event_type = 'click' AND pos >= 100 AND pos < 300")
def region_median(spark, sf_dir):
    return stats.region_median(_track(spark, sf_dir).where("event_type = 'click'"), 100, 300)


@query("SELECT lang, count(*) FILTER (WHERE c = 'a') AS a, count(*) FILTER (WHERE c = 'c') AS c, count(*) FILTER (WHERE c = 'g') AS g, count(*) FILTER (WHERE c = 't') AS t, count(*) FILTER (WHERE c IN ('a', 'c', 'g', 't')) AS depth FROM (SELECT lang, unnest(string_split(lower(text), '')) AS c FROM documents) GROUP BY lang")
def nucleotide_counts(spark, sf_dir):
    chars = _table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.upper("text"), "")).alias("base")).withColumn("quality", F.lit(30))
    return stats.nucleotide_counts(chars, ["lang"])


# --- reads, pairs and hits

_MATED = "(SELECT o_orderkey AS ord, 'r' || o_orderkey AS qname, CAST(epoch(o_orderdate) / 86400 AS BIGINT) AS position, m AS mate_position FROM orders JOIN (SELECT l_orderkey, max(CAST(epoch(l_shipdate) / 86400 AS BIGINT)) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"
_P = f"({POINTS}) AS points(b, p)"


def _mated(spark, sf_dir):
    ship = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(F.max(_day("l_shipdate")).alias("mate_position"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("r"), "o_orderkey").alias("qname"), _day("o_orderdate").alias("position"))
    return orders.join(ship, "ord")


def _points(spark):
    return spark.sql(f"SELECT b AS breakpoint_number, CAST(p AS BIGINT) AS position FROM {POINTS} AS t(b, p)")


@query(f"""WITH near AS (SELECT m.*, b, p FROM {_MATED} m JOIN {_P} ON position >= p - 30 AND position < p + 30),
met AS (SELECT n.*, t.b AS target, row_number() OVER (PARTITION BY n.ord ORDER BY t.b) AS rn FROM near n JOIN {_P.replace("points(b, p)", "t(b, p)")} ON t.b <> n.b AND mate_position BETWEEN t.p - 30 AND t.p + 30)
SELECT qname AS read_name, qname AS mate_name, 'days:' || position AS read_pos, 'days:' || mate_position AS mate_pos, abs(position - mate_position) AS insert_size, b || '-' || target AS breakpoint_bridge FROM met WHERE rn = 1""")
def bridging_pairs(spark, sf_dir):
    points = _points(spark)
    windows = points.select(F.col("breakpoint_number").alias("breakpoint"), F.lit("days").alias("rname"), (F.col("position") - 30).alias("r_start"), (F.col("position") + 30).alias("r_end"))
    mated = _mated(spark, sf_dir).withColumns({"rname": F.lit("days"), "sample": F.lit("s"), "p1": F.col("position") + 1})
    near = intervals.range_join(mated, windows, ["rname"], 64, ("position", "p1")).drop("p1", "r_start", "r_end")
    targets = points.select(F.lit("s").alias("sample"), F.col("breakpoint_number").alias("target"), F.col("breakpoint_number").alias("t_ord"), (F.col("position") - 30).alias("t_start"), (F.col("position") + 30).alias("t_end"))
    return reads.bridging_pairs(near, targets, 64)


@query(f"""WITH h AS (SELECT l_orderkey AS ord, 'days:0_' || (min(l_suppkey) % 3 + 1) || '_L' AS qseqid, max(CAST(epoch(l_shipdate) / 86400 AS BIGINT)) AS sstart, min(CAST(epoch(l_shipdate) / 86400 AS BIGINT)) AS send FROM lineitem GROUP BY l_orderkey)
SELECT * FROM h WHERE EXISTS (SELECT 1 FROM {_P} WHERE b <> CAST(regexp_extract(qseqid, '_([0-9]+)_', 1) AS INT) AND NOT (greatest(sstart, send) < p - 5 OR least(sstart, send) > p + 5))""")
def hit_semi_filter(spark, sf_dir):
    day = _day("l_shipdate")
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(F.concat(F.lit("days:0_"), (F.min("l_suppkey") % 3 + 1).cast("string"), F.lit("_L")).alias("qseqid"), F.max(day).alias("sstart"), F.min(day).alias("send"))
    points = _points(spark).withColumn("chromosome", F.lit("days"))
    return hits.near_other_breakpoint(rows.withColumn("sseqid", F.lit("days")), points, 5, width=256).drop("sseqid")


@query("SELECT o_orderkey, CAST(o_custkey % 4 AS INT) AS source, CAST(o_orderkey % 4 AS INT) AS target FROM orders WHERE (o_custkey % 4, o_orderkey % 4) IN ((1, 2), (2, 1), (0, 3), (3, 0))")
def pair_membership(spark, sf_dir):
    allowed = reads.symmetric_pairs(spark.sql("SELECT * FROM VALUES (1, 2), (0, 3) AS t(source, target)"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4).cast("int").alias("source"), (F.col("o_orderkey") % 4).cast("int").alias("target"))
    return rows.join(allowed, ["source", "target"], "left_semi")


def _aligned(spark, sf_dir):
    """Documents as reads: clipped at the left, the right or both ends by CIGARs that their ids give; short ones are not clipped."""
    k = (F.col("doc_id") % 41 + 10).cast("int")
    n = F.char_length("text")
    cigar = F.when(n <= 120, F.concat(n, F.lit("M"))).when(F.col("doc_id") % 3 == 0, F.concat(k, F.lit("S"), n - k, F.lit("M"))).when(F.col("doc_id") % 3 == 1, F.concat(n - k, F.lit("M"), k, F.lit("S"))).otherwise(F.concat(k, F.lit("S"), n - 2 * k, F.lit("M"), k, F.lit("S")))
    rows = _table(spark, sf_dir, "documents")
    rows = rows.select(F.col("source").alias("sample"), F.concat(F.lit("d"), "doc_id").alias("qname"), F.lit(1).alias("flag"), F.lit("days").alias("rname"), (F.col("doc_id") * 7 % 1000).alias("pos0"), cigar.alias("cigar_str"), F.lit("days").alias("rnext"), (F.col("doc_id") * 11 % 1000).alias("pnext0"), F.col("text").alias("seq"), F.lit(60).alias("mapq"), F.lit(None).cast("array<int>").alias("quals"))
    rows = rows.withColumn("cigar", reads.parse_cigar(F.col("cigar_str")))
    return rows.withColumn("end0", F.col("pos0") + reads.reference_length(F.col("cigar")))


_A = "(SELECT doc_id, 'd' || doc_id AS qname, text, length(text) AS n, CAST(doc_id % 41 + 10 AS BIGINT) AS k, doc_id * 7 % 1000 AS pos0, doc_id * 11 % 1000 AS pnext0 FROM documents)"
_ENDS = f"(SELECT *, n > 120 AS clipped, n - CASE WHEN n <= 120 THEN 0 WHEN doc_id % 3 = 2 THEN 2 * k ELSE k END AS covered FROM {_A} a)"


@query(f"""SELECT qname, 'L' AS side, pos0 + 1 AS clip_position, left(text, k) AS clip FROM {_ENDS} a WHERE clipped AND doc_id % 3 IN (0, 2) AND k >= 30
UNION ALL SELECT qname, 'R', pos0 + covered, right(text, k) FROM {_ENDS} a WHERE clipped AND doc_id % 3 IN (1, 2) AND k >= 30""")
def clip_extract(spark, sf_dir):
    near = _aligned(spark, sf_dir).withColumns({"r_start": F.lit(0), "r_end": F.lit(1), "breakpoint": F.lit(1), "bkp_position": F.lit(500)})
    return reads.soft_clips(near, 30).select("qname", "side", "clip_position", "clip")


@query(f"SELECT pos, count(*) AS n FROM (SELECT pos0 AS pos FROM {_ENDS} a WHERE clipped AND doc_id % 3 IN (0, 2) UNION ALL SELECT pos0 + covered FROM {_ENDS} a WHERE clipped AND doc_id % 3 IN (1, 2)) GROUP BY pos")
def softclip_histogram(spark, sf_dir):
    return reads.softclip_counts(_aligned(spark, sf_dir), 5).drop("rname")


@query(f"SELECT qname, covered AS reference_length, abs(pos0 - pnext0) AS insert_size FROM {_ENDS} a")
def insert_size(spark, sf_dir):
    rows = _aligned(spark, sf_dir)
    return rows.select("qname", reads.reference_length(F.col("cigar")).cast("long").alias("reference_length"), reads.insert_size(F.col("pos0"), F.col("pnext0"), F.col("rname") == F.col("rnext")).alias("insert_size"))


@query(f"SELECT ord % 5 AS bucket, count(*) AS n, count(*) FILTER (WHERE s <= 40 + 50 + 0.1 * 40) AS plausible, count(*) FILTER (WHERE s > 40 + 50 + 0.1 * 40) AS outliers FROM (SELECT ord, abs(position - mate_position) AS s FROM {_MATED} m) GROUP BY 1")
def insert_plausibility(spark, sf_dir):
    rows = _mated(spark, sf_dir).select((F.col("ord") % 5).alias("bucket"), F.abs(F.col("position") - F.col("mate_position")).alias("insert_size"), F.lit(100).alias("p1"), F.lit(140).alias("p2"))
    return stats.insert_plausibility(rows, ["bucket"], library=50)


@query("""WITH e AS (SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, least(100, greatest(10, floor(sqrt(count(*))))) AS k FROM orders GROUP BY 1),
b AS (SELECT o_orderstatus, least(floor((o_totalprice - lo) / ((hi - lo) / k)), k - 1) AS bin, lo, (hi - lo) / k AS w FROM orders JOIN e USING (o_orderstatus))
SELECT o_orderstatus, CAST(bin AS INT) AS bin, round(lo + bin * w, 4) AS low, round(lo + (bin + 1) * w, 4) AS high, count(*) AS n FROM b GROUP BY o_orderstatus, bin, lo, w""")
def histogram_bins(spark, sf_dir):
    return stats.histogram(_table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice").select("o_orderstatus", "bin", *_r("low", "high", n=4), "n")


_MODE = "(SELECT event_type, h AS mode, n FROM (SELECT event_type, h, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, f) AS rn FROM (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) % 24 AS h, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)) WHERE rn = 1)"


def _modes(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_type", "event_id", (F.floor(F.unix_timestamp("ts") / 3600) % 24).cast("long").alias("h"))
    return stats.mode_first(rows, KEY, "h", "event_id")


@query(f"SELECT * FROM {_MODE} m")
def mode_first_tie(spark, sf_dir):
    return _modes(spark, sf_dir)


@query(f"SELECT *, CAST(12 AS BIGINT) AS predicted, mode - 12 AS \"offset\" FROM {_MODE} m")
def mode_offset(spark, sf_dir):
    modes = _modes(spark, sf_dir)
    return stats.mode_offset(modes, modes.select("event_type", F.lit(12).cast("long").alias("predicted")), KEY)


_GRID = [0.0, 25.0, 50.0, 75.0, 100.0]


@query(f"SELECT event_type, x, round(avg(exp(-((x - value) / h) * ((x - value) / h) / 2) / (h * sqrt(2 * pi()))), 6) AS density FROM events JOIN (SELECT event_type, stddev_samp(value) * count(value) ** -0.2 AS h FROM events GROUP BY 1) USING (event_type), (SELECT unnest({_GRID}::DOUBLE[]) AS x) GROUP BY ALL")
def kde_grid(spark, sf_dir):
    return stats.kde(_table(spark, sf_dir, "events"), KEY, "value", _GRID).select("event_type", "x", *_r("density"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def dedup_first(spark, sf_dir):
    return stats.first_of(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT CAST(o_custkey % 7 AS INT) AS breakpoint_number, max_by(o_orderkey, o_orderkey) AS ord, max_by(o_totalprice, o_orderkey) AS position FROM orders GROUP BY 1")
def breakpoints_by_number(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).cast("int").alias("breakpoint_number"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("position"))
    return stats.last_by_number(rows)


# --- signals


@query(f"SELECT event_type, pos, round(median(norm) {_frame(W)}, 6) AS m24, round(median(norm) {_frame(5)}, 6) AS m5 FROM {_T} t")
def rolling_median(spark, sf_dir):
    track = _track(spark, sf_dir)
    return signal.moving_median(signal.moving_median(track, KEY, "norm", "m24", W), KEY, "norm", "m5", 5).select("event_type", "pos", *_r("m24", "m5"))


@query(f"SELECT event_type, pos, round(median(norm) {_frame(101)}, 6) AS m FROM {_T} t")
def rolling_median_wide(spark, sf_dir):
    return signal.moving_median(_track(spark, sf_dir), KEY, "norm", "m", 101).select("event_type", "pos", *_r("m"))


@query(f"SELECT event_type, pos, round(var_samp(norm) {_frame(W)}, 6) AS v FROM {_T} t")
def rolling_variance(spark, sf_dir):
    return signal.moving_variance(_track(spark, sf_dir), KEY, "norm", "v", W).select("event_type", "pos", *_r("v"))


_COV = f"""(SELECT event_type, pos, norm, CASE WHEN count(CASE WHEN m IS NOT NULL THEN 1 END) {_frame(W)} = {W} THEN covar_samp(m, v) {_frame(W)} END AS c
FROM (SELECT *, CASE WHEN count(*) {_frame(W)} = {W} THEN avg(depth) {_frame(W)} END AS m, CASE WHEN count(*) {_frame(W)} = {W} THEN var_samp(depth) {_frame(W)} END AS v FROM {_T} t))"""


@query(f"SELECT event_type, pos, round(c, 6) AS c FROM {_COV} c")
def rolling_covariance(spark, sf_dir):
    return signal.moving_covariance(_track(spark, sf_dir), KEY, "depth", "c", W).select("event_type", "pos", *_r("c"))


@query(f"""WITH s AS (SELECT event_type, pos, (c - min(c) OVER k) / (max(c) OVER k - min(c) OVER k) * (max(norm) OVER k - min(norm) OVER k) + min(norm) OVER k AS s FROM {_COV} c WINDOW k AS (PARTITION BY event_type)),
z AS (SELECT event_type, pos, s - avg(s) OVER (PARTITION BY event_type) + 1 AS z FROM s) SELECT event_type, pos, CASE WHEN z >= 1 THEN round(z, 6) END AS c FROM z""")
def covariance_rescale(spark, sf_dir):
    track = signal.moving_covariance(_track(spark, sf_dir), KEY, "depth", "c", W)
    return signal.rescale(track, KEY, "c", "norm").select("event_type", "pos", *_r("c"))


@query(f"SELECT event_type, pos, norm, row_number() OVER (PARTITION BY event_type ORDER BY pos) AS rn FROM {_T} t WHERE norm BETWEEN 0.5 AND 1.5")
def doc_limits(spark, sf_dir):
    return signal.within_limits(_track(spark, sf_dir), KEY, "norm", 0.5, 1.5).select("event_type", "pos", "norm", F.col("rn").cast("long").alias("rn"))


_BIN = f"(SELECT *, greatest(ceil((pos - min(pos) OVER (PARTITION BY event_type)) / 24.0) - 1, 0) AS bin FROM {_T} t)"


@query(f"SELECT event_type, rn, round(avg(pos) OVER b, 6) AS pos, round(avg(norm) OVER b, 6) AS norm FROM {_BIN} t WINDOW b AS (PARTITION BY event_type, bin)")
def bin_mean(spark, sf_dir):
    return signal.bin_means(_track(spark, sf_dir), KEY, 24, ["pos", "norm"]).select("event_type", F.col("rn").cast("long").alias("rn"), *_r("pos", "norm"))


_MA = f"(SELECT event_type, pos, norm, median(norm) {_frame(W)} AS ma FROM {_T} t)"
_SHIFT = f"(SELECT event_type, pos, norm, ma FROM (SELECT *, median(norm) {_frame(5)} AS n2, median(ma) {_frame(5)} AS a2 FROM {_MA} m) WHERE round(abs(a2 - n2), 6) > 0.35)"
_ISLE = f"(SELECT event_type, island, min(pos) AS s, max(pos) AS e, count(*) AS rows FROM (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY pos) AS island FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY event_type ORDER BY pos) <= 1 THEN 0 ELSE 1 END AS n FROM {_SHIFT} x)) GROUP BY ALL)"


def _shifted(spark, sf_dir):
    track = signal.moving_median(_track(spark, sf_dir), KEY, "norm", "moving_average", W)
    return signal.shifts(track, KEY, 0.35, 5)


@query(f"SELECT event_type, pos, round(ma, 6) AS moving_average FROM {_SHIFT} x")
def shift_detect(spark, sf_dir):
    return _shifted(spark, sf_dir).select("event_type", "pos", *_r("moving_average"))


@query(f"SELECT event_type, CAST(island AS BIGINT) AS island, s AS start, e AS \"end\", rows FROM {_ISLE} i")
def islands(spark, sf_dir):
    return signal.islands(_shifted(spark, sf_dir), KEY)


@query(f"SELECT i.event_type, s AS start, e AS \"end\", (s + e) / 2.0 AS centre, round(max(norm), 6) AS peak FROM {_ISLE} i JOIN {_T} t ON i.event_type = t.event_type AND pos BETWEEN s AND e GROUP BY ALL")
def island_peaks(spark, sf_dir):
    return signal.island_peaks(signal.islands(_shifted(spark, sf_dir), KEY), _track(spark, sf_dir), KEY).select("event_type", "start", "end", "centre", *_r("peak"))


@query(f"SELECT event_type, max(n) AS longest FROM (SELECT event_type, g, count(*) FILTER (WHERE ok) AS n FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY rn) AS g FROM (SELECT *, norm < 0.9 AS ok FROM {_T} t)) GROUP BY ALL) GROUP BY event_type")
def run_length_test(spark, sf_dir):
    return signal.longest_run(_track(spark, sf_dir), KEY, F.col("norm") < 0.9)


@query(f"""WITH g AS (SELECT pos, row_number() OVER (ORDER BY pos) AS r FROM (SELECT DISTINCT pos FROM {_T} t)),
f AS (SELECT k.event_type, g.pos, g.r, t.norm, CASE WHEN t.norm IS NOT NULL THEN g.r END AS rr FROM g CROSS JOIN (SELECT DISTINCT event_type FROM {_T} t) k LEFT JOIN {_T} t ON t.event_type = k.event_type AND t.pos = g.pos),
n AS (SELECT *, max(rr) OVER (PARTITION BY event_type ORDER BY r) AS r0, min(rr) OVER (PARTITION BY event_type ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r1 FROM f),
v AS (SELECT n.event_type, n.pos, n.norm, n.r, n.r0, n.r1, a.norm AS v0, b.norm AS v1 FROM n LEFT JOIN f a ON a.event_type = n.event_type AND a.r = n.r0 LEFT JOIN f b ON b.event_type = n.event_type AND b.r = n.r1)
SELECT event_type, pos, round(coalesce(norm, v0 + (v1 - v0) * (r - r0) / (r1 - r0), v0, v1), 6) AS norm FROM v""")
def interpolate_union(spark, sf_dir):
    rows = signal.align(_track(spark, sf_dir).withColumn("locus", F.lit("all")), ["locus"], "event_type", "norm")
    return rows.select("event_type", "pos", *_r("norm"))


@query(f"SELECT event_type, count(*) AS rows, round(avg(ma), 4) AS moving_average, count(*) FILTER (WHERE pos BETWEEN 200 AND 400) AS target_rows FROM {_MA} m GROUP BY 1")
def depth_track_plot(spark, sf_dir):
    rows = _track(spark, sf_dir).select("event_type", "pos", "depth").withColumn("ref", F.lit(3.0))
    track = signal.depth_track(rows, KEY, "ref", W).withColumnRenamed("event_type", "locus")
    data = pipelines.plot_data(track, track.select("locus").distinct().select("locus", F.lit(200).alias("start"), F.lit(400).alias("end")))
    return data.groupBy(F.col("locus").alias("event_type")).agg(F.count("*").alias("rows"), F.round(F.avg("moving_average"), 4).alias("moving_average"), F.count_if("is_target").alias("target_rows"))


# --- probes, profiles, clusters


def _probed(spark, sf_dir):
    runs = _track(spark, sf_dir).select("event_type", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "depth")
    spans = runs.select("event_type").distinct().select("event_type", F.lit(300).cast("long").alias("start"), F.lit(420).cast("long").alias("end"), F.lit(3.0).alias("ref_median"))
    return probes.probe_profile(runs, spans, KEY, "ref_median", 10, 24, 12)


_PROBE = f"""(SELECT k.event_type, i AS probe, 360 + i * 24 AS centre, coalesce(sum(depth), 0) / 10.0 / 3.0 AS ratio FROM (SELECT DISTINCT event_type FROM {_T} t) k CROSS JOIN (SELECT unnest(range(-12, 13)) AS i) p
LEFT JOIN {_T} t ON t.event_type = k.event_type AND pos >= 360 + i * 24 - 5 AND pos < 360 + i * 24 + 5 GROUP BY ALL)"""
_BITS = f"(SELECT event_type, string_agg(CASE WHEN round(ratio, 9) > 0.9 THEN '1' ELSE '0' END, '' ORDER BY probe) AS bits FROM {_PROBE} p GROUP BY 1)"


@query(f"SELECT event_type, CAST(probe AS INT) AS probe, CAST(centre AS BIGINT) AS centre, round(ratio, 6) AS ratio FROM {_PROBE} p")
def probe_profile(spark, sf_dir):
    return _probed(spark, sf_dir).select("event_type", "probe", "centre", *_r("ratio"))


@query(f"SELECT * FROM {_BITS} b")
def binarise_profile(spark, sf_dir):
    rounded = _probed(spark, sf_dir).withColumn("ratio", F.round("ratio", 9))
    return probes.profiles(rounded, KEY).select("event_type", probes.profile_string(F.col("profile"), 0.9).alias("bits"))


_HOURS = "(SELECT user_id, string_agg(CASE WHEN n > 0 THEN '1' ELSE '0' END, '' ORDER BY h) AS bits FROM (SELECT u.user_id, h, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(0, 24)) AS h) x LEFT JOIN events e ON e.user_id = u.user_id AND CAST(floor(epoch(ts) / 3600) AS BIGINT) % 24 = h GROUP BY ALL) GROUP BY 1)"


def _hours(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", (F.floor(F.unix_timestamp("ts") / 3600) % 24).cast("int").alias("h"))
    seen = rows.groupBy("user_id").agg(F.collect_set("h").alias("hs"))
    return seen.select("user_id", F.lit("all").alias("locus"), F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.array_contains("hs", h).cast("int")).alias("bits"))


@query(f"SELECT user_id, bits, dense_rank() OVER (ORDER BY f) - 1 AS cluster FROM (SELECT *, min(user_id) OVER (PARTITION BY bits) AS f FROM {_HOURS} h)")
def string_clusters(spark, sf_dir):
    rows = _hours(spark, sf_dir).withColumn("bits", F.array_join(F.transform("bits", lambda b: b.cast("string")), ""))
    return probes.string_clusters(rows, ["locus"], "bits", "user_id").select("user_id", "bits", F.col("cluster").cast("long").alias("cluster"))


@query(f"SELECT a.event_type AS a, b.event_type AS b, round(len(list_filter(range(1, 26), lambda i: a.bits[i] <> b.bits[i])) / 25.0, 6) AS distance FROM {_BITS} a JOIN {_BITS} b ON a.event_type < b.event_type")
def hamming_pairs(spark, sf_dir):
    rounded = _probed(spark, sf_dir).withColumn("ratio", F.round("ratio", 9))
    rows = probes.profiles(rounded, KEY).select("event_type", F.lit("all").alias("locus"), probes.binarised(F.col("profile"), 0.9).alias("bits"))
    return probes.hamming_pairs(rows, ["locus"], "event_type", "bits").select("a", "b", *_r("distance"))


@query()
def hamming_clusters(spark, sf_dir):
    rows = probes.profiles(_probed(spark, sf_dir), KEY).select("event_type", F.lit("all").alias("locus"), probes.binarised(F.col("profile"), 0.9).alias("bits"))
    return probes.hamming_clusters(rows, ["locus"], "event_type", "bits", 0.3).select("event_type", "cluster")


@query()
def expand_interval(spark, sf_dir):
    found = _found(spark, sf_dir)
    loci = intervals.locus_span(_loci(spark)).join(found, "locus").select("sample", "locus", "start", "end", F.col("mean").alias("target_cov"), F.col("mean").alias("reference_cov"))
    runs = intervals.depth_runs(_blocks(spark, sf_dir), ["sample"])
    per_locus = runs.join(loci.select("sample", "locus"), "sample")
    return probes.expand_intervals(per_locus, loci, ["sample", "locus"], size=5, spacing=10, number=8, drops=5, most=600)


# --- change points

_SUMS = f"(SELECT event_type, rn, sum(depth) OVER w AS s, sum(depth * depth) OVER w AS q, sum(depth) OVER k AS st, sum(depth * depth) OVER k AS qt, count(*) OVER k AS n FROM {_T} t WINDOW w AS (PARTITION BY event_type ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), k AS (PARTITION BY event_type))"


@query(f"SELECT event_type, rn, cost FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY cost, rn) AS o FROM (SELECT event_type, rn, round(q - s * s / (rn - 1) + (qt - q) - (st - s) * (st - s) / (n - rn + 1), 6) AS cost FROM {_SUMS} x WHERE rn - 1 >= 2 AND n - rn + 1 >= 2)) WHERE o = 1")
def changepoint_exact_k1(spark, sf_dir):
    return changepoint.best_single_cut(_track(spark, sf_dir), KEY, "depth").select("event_type", F.col("rn").cast("long").alias("rn"), "cost")


_CAND = f"(SELECT event_type, rn - 1 AS i, s, q, st, qt, n FROM {_SUMS} x WHERE (rn - 1) % 5 = 0 AND rn > 1)"


@query(f"""SELECT c.event_type, CAST(k AS INT) AS breakpoint_number, pos AS position FROM (SELECT event_type, unnest([1, 2]) AS k, unnest([i, j]) AS cut_at FROM (
SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(cost, 6), i, j) AS o FROM (SELECT a.event_type, a.i, b.i AS j, a.q - a.s * a.s / a.i + (b.q - a.q) - (b.s - a.s) * (b.s - a.s) / (b.i - a.i) + (a.qt - b.q) - (a.st - b.s) * (a.st - b.s) / (a.n - b.i) AS cost
FROM {_CAND} a JOIN {_CAND} b ON a.event_type = b.event_type AND a.i < b.i AND b.i <= a.n - 2)) WHERE o = 1) c JOIN {_T} t ON t.event_type = c.event_type AND t.rn = cut_at + 1""")
def changepoint_exact_k2(spark, sf_dir):
    found = changepoint.breakpoints(_track(spark, sf_dir), KEY, "depth", algo="Dynp", n_bkps=2)
    return found.select("event_type", "breakpoint_number", "position")


@query()
def changepoint_bottomup(spark, sf_dir):
    track = signal.moving_median(_track(spark, sf_dir), KEY, "norm", "moving_average", W)
    return changepoint.breakpoints(track, KEY, n_bkps=3)


@query()
def changepoint_multivariate(spark, sf_dir):
    track = signal.moving_median(_track(spark, sf_dir), KEY, "norm", "moving_average", W).withColumn("locus", F.lit("all"))
    return changepoint.pooled_breakpoints(track, ["locus"], "event_type", n_bkps=3)


# --- patterns

_HIT = "(SELECT doc_id, item_id, CAST(i AS INT) AS start, CAST(i + length(p) - 1 AS INT) AS \"end\", p FROM (SELECT doc_id, item_id, p, t, unnest(range(0, length(t) - length(p) + 1)) AS i FROM (SELECT d.doc_id, b.item_id, b.text AS p, d.text AS t FROM documents d JOIN benchmark b ON contains(d.text, b.text))) WHERE substr(t, i + 1, length(p)) = p)"


def _clips(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("pattern"), F.col("item_id").cast("int").alias("breakpoint"))


@query(f'SELECT doc_id, start, "end", CAST(item_id AS INT) AS breakpoint FROM {_HIT} h')
def multi_pattern_match(spark, sf_dir):
    return patterns.pattern_matches(_table(spark, sf_dir, "documents"), _clips(spark, sf_dir), "doc_id", "text").drop("pattern")


@query(f"""SELECT doc_id, item_id, start, translate(substr(t, 1, start), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || translate(p, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || translate(substr(t, "end" + 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS marked FROM {_HIT} h JOIN (SELECT doc_id, text AS t FROM documents) d USING (doc_id)""")
def span_highlight(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = patterns.pattern_matches(docs, _clips(spark, sf_dir), "doc_id", "text")
    marked = patterns.highlight(F.col("text"), (F.col("start"), F.col("end")))
    return found.join(docs, "doc_id").select("doc_id", F.col("breakpoint").cast("long").alias("item_id"), "start", marked.alias("marked"))


@query()
def seeded_hits(spark, sf_dir):
    """Passages aligned to whole documents: the best gapped alignment of each chain of seeds."""
    passages = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("seq"))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))
    # pieces overlap by more than a passage, and are short, as places in a text are found from its start on
    overlap = (passages.agg(F.max(F.char_length("seq"))).first()[0] or 0) + 64
    found = alignment.local_hits(passages, alignment.pieces(docs, max(1 << 12, 2 * overlap), overlap), word=28)
    return found.select("qseqid", "sseqid", *_r("pident"), "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", *_r("bitscore", n=3))


def _halves(spark, sf_dir):
    """Each passage as two clips, one for either side of a junction."""
    b = _table(spark, sf_dir, "benchmark")
    half = F.floor(F.char_length("text") / 2).cast("int")
    first = b.select((F.col("item_id") * 2).alias("ord"), F.left("text", half).alias("pattern"), F.lit(1).alias("breakpoint"))
    return first.unionByName(b.select((F.col("item_id") * 2 + 1).alias("ord"), F.right("text", half).alias("pattern"), F.lit(2).alias("breakpoint")))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(f"""WITH p AS (SELECT item_id * 2 AS ord, left(text, CAST(length(text) // 2 AS INT)) AS p, 1 AS b FROM benchmark UNION ALL SELECT item_id * 2 + 1, right(text, CAST(length(text) // 2 AS INT)), 2 FROM benchmark),
u AS (SELECT p, arg_max(b, ord) AS b FROM p WHERE p <> '' GROUP BY p),
hit AS (SELECT doc_id, b, p, i AS s, i + length(p) - 1 AS e FROM (SELECT doc_id, text AS t, p, b, unnest(range(0, length(text) - length(p) + 1)) AS i FROM documents JOIN u ON contains(text, p)) WHERE substr(t, i + 1, length(p)) = p),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e, length(p) DESC, s, b, p) AS k FROM hit),
pair AS (SELECT x.doc_id, x.k AS i, x.b AS b1, x.s AS s1, x.e AS e1, y.b AS b2, y.s AS s2, y.e AS e2, row_number() OVER (PARTITION BY x.doc_id, x.k ORDER BY y.k) AS n FROM o x JOIN o y ON x.doc_id = y.doc_id AND y.k > x.k AND y.b <> x.b),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, b1, b2 ORDER BY i) AS r FROM pair WHERE n = 1),
place AS (SELECT one.*, text AS t, unnest(range(0, length(text))) AS c FROM one JOIN documents USING (doc_id) WHERE r = 1)
SELECT doc_id, CAST(b1 AS INT) AS b1, CAST(b2 AS INT) AS b2, CAST(i - 1 AS INT) AS ord,
string_agg(CASE WHEN c BETWEEN s1 AND e1 OR c BETWEEN s2 AND e2 THEN translate(substr(t, c + 1, 1), '{_LOW}', '{_UP}') ELSE translate(substr(t, c + 1, 1), '{_UP}', '{_LOW}') END, '' ORDER BY c) AS marked FROM place GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY doc_id, b1, b2, i"))
def junction_reads(spark, sf_dir):
    allowed = reads.symmetric_pairs(spark.sql("SELECT 1 AS source, 2 AS target"))
    return patterns.junction_reads(_table(spark, sf_dir, "documents"), _halves(spark, sf_dir), allowed, "doc_id", "text")


_NEAR = f"(SELECT a.*, b, p FROM {_ENDS} a JOIN (VALUES (1, 200), (2, 700)) AS x(b, p) ON pos0 < p + 50 AND pos0 + covered > p - 50 WHERE clipped AND k >= 30)"


@query(f"""WITH c AS (SELECT b, p, pos0 + 1 AS place, doc_id * 2 AS ord FROM {_NEAR} a WHERE doc_id % 3 IN (0, 2) UNION ALL SELECT b, p, pos0 + covered, doc_id * 2 + 1 FROM {_NEAR} a WHERE doc_id % 3 IN (1, 2)),
m AS (SELECT b, p, place, n, row_number() OVER (PARTITION BY b ORDER BY n DESC, f) AS r FROM (SELECT b, p, place, count(*) AS n, min(ord) AS f FROM c GROUP BY b, p, place))
SELECT CAST(b AS INT) AS breakpoint, CAST(place AS BIGINT) AS mode, n, CAST(p AS BIGINT) AS predicted, CAST(place - p AS BIGINT) AS "offset" FROM m WHERE r = 1""")
def junction_evidence(spark, sf_dir):
    """The junctions run as a whole: clips per breakpoint with their mode and offset."""
    rows = _aligned(spark, sf_dir)
    one = spark.sql("SELECT 1 AS breakpoint_number, 'days' AS chromosome, CAST(200 AS BIGINT) AS position UNION ALL SELECT 2, 'days', CAST(700 AS BIGINT)")
    points = rows.select("sample").distinct().join(one, F.lit(True))
    order = F.substr("qname", F.lit(2)).cast("long") * 2 + (F.col("side") == "R").cast("int")
    clips = pipelines.junctions(rows, points, 30, 50)["clips"].withColumn("ord", order)
    return pipelines.clip_modes(clips, one)
