"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every window of an item is a set of words that a document must contain whole, so one word of it, the rarest over all documents,
is a necessary prefix: the order is by the rarity of words, not of longer shingles. Documents offer only the places of such words, each with the words around it; offset and length bounds
and a comparison word by word then leave the true occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import ascii_lower, cut, drop_cut, fresh, let

#: Fixed by the contract: what stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of a word filter: at least, at most (512 KB), for each word. A crowded filter lets more words through, none fewer.
LEAST_BITS, MOST_BITS, EACH = 1 << 16, 1 << 22, 16
#: Windows of one word in a row of the index.
CHUNK = 64


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _filter_of(tokens: DataFrame, n: int, most: int) -> "callable":
    """A test on a word that holds for all n words of tokens.w, and seldom for others: a bit field of at most `most` bits as a literal."""
    size = min(most, max(LEAST_BITS, 1 << (EACH * n).bit_length()))
    place = F.xxhash64("w").bitwiseAND(F.lit(size - 1))
    set_ = tokens.select(place.alias("h")).groupBy(F.shiftright("h", 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    field = [0] * (size // 64)
    for r in set_.collect():  # size / 64 rows at most
        field[r.at] = r.bits
    bits = F.split(F.lit(",".join(map(str, field))), ",").cast("array<bigint>")

    def test(w: Column) -> Column:
        h = F.xxhash64(w).bitwiseAND(F.lit(size - 1))
        return F.getbit(F.get(bits, F.shiftright(h, 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, words, at (from 0), win (array): `window` consecutive words; a shorter item, but no empty one, is one window."""
    rows = items.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    rows = rows.select("item_id", "ws", F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)))).alias("at"))
    return rows.select("item_id", "at", F.slice("ws", F.col("at") + 1, F.lit(window)).alias("win")).distinct()


def word_counts(docs: DataFrame, vocabulary: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """w, n over all documents for the words of vocabulary.w that occur, and for a few others that the word filter lets through.

    There is no join with the vocabulary here: it would be moved before the sums and send every occurrence to its word's task.
    """
    known = _filter_of(vocabulary, vocabulary.count(), most)
    seen = docs.select(F.explode(F.filter(words(F.col("text")), known)).alias("w"))
    return seen.groupBy("w").agg(F.count("*").alias("n"))


def prefix_index(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """w, wins: under the rarest word of each window (ties: the smallest), the windows with its place in them."""
    placed = windows.select("item_id", "win", F.posexplode("win").alias("off", "w"))
    ranked = placed.join(counts, "w", "left").groupBy("item_id", "win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w", "off")).alias("p"))
    # a word that no document has makes its window impossible
    ranked = ranked.where("p.n > 0").select(F.col("p.w").alias("w"), F.struct("item_id", F.col("p.off").alias("off"), "win").alias("x"))
    chunks = ranked.groupBy("w").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    rows = ranked.join(chunks, "w").withColumn("chunk", F.pmod(F.xxhash64("x.win", "x.item_id"), "chunks"))
    return rows.groupBy("w", "chunk").agg(F.collect_list("x").alias("wins")).drop("chunk")


def _own_words(docs: DataFrame, rare: DataFrame, maybe) -> DataFrame:
    """docs with ks, the hashes of the words of rare.w that each row has: for more words than a filter of fixed size can tell apart."""
    d, h = fresh(docs, "d", "h")
    own = docs.select(F.col("doc_id").cast("long").alias(d), F.xxhash64("text").alias(h), "text")
    own = own.select(d, h, F.explode(F.array_distinct(F.transform(F.filter(words(F.col("text")), maybe), lambda w: F.xxhash64(w)))).alias("k")).distinct()
    own = own.join(rare.select(F.xxhash64("w").alias("k")).distinct(), "k", "left_semi").groupBy(d, h).agg(F.collect_list("k").alias("ks"))
    return docs.join(own, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)), "left").drop(d, h)


def find_items(docs: DataFrame, items: DataFrame, window: int = 10, most: int = MOST_BITS) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items (long), items (sorted strings), contaminated for every row of docs.

    n_hit: words inside any occurrence of any window; items: ids of items with such windows. Null and empty texts have no
    words and are clean; null item ids mark words but name no item; a null doc_id is kept; rows repeated in either table
    change nothing but the number of result rows; no items or no documents: no hits, no rows. Other columns are ignored.
    most: bits of a word filter. With more prefix words than it can tell apart, rows are joined with the words they have first.
    """
    docs = docs.select("doc_id", "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    windows = cut(item_windows(items, window))
    counts = cut(word_counts(docs, windows.select(F.explode("win").alias("w")).distinct(), most))
    index = cut(prefix_index(windows, counts))
    drop_cut(windows, counts)
    prefixes = index.select("w").distinct()
    n = prefixes.count()
    maybe = rare = _filter_of(prefixes, n, most)
    if EACH * n > most:
        docs = _own_words(docs, prefixes, maybe)
        rare = lambda w: F.coalesce(F.array_contains("ks", F.xxhash64(w)), F.lit(False))

    def places(ws: Column) -> Column:
        around = lambda i: F.slice(ws, F.greatest(i - (window - 1), F.lit(0)) + 1, F.least(i, F.lit(window - 1)) + window)
        return F.array_compact(F.transform(ws, lambda w, i: F.when(rare(w), F.struct(w.alias("w"), i.alias("p"), around(i).alias("near")))))

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), let(words(F.col("text")), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), places(ws).alias("c"))).alias("r"))
    read = cut(read.select("doc_id", "text_hash", "r.n_words", "r.c"))
    offered = read.select("doc_id", "text_hash", F.explode("c").alias("c")).select("doc_id", "text_hash", "c.w", "c.p", "c.near")
    lead = F.least("p", F.lit(window - 1))

    def occurs(x: Column) -> Column:
        start = lead - x["off"]
        return (start >= 0) & (start + F.size(x["win"]) <= F.size("near")) & (F.slice("near", F.greatest(start, F.lit(0)) + 1, F.size(x["win"])) == x["win"])

    met = offered.join(index, "w").select("doc_id", "text_hash", F.transform(F.filter("wins", occurs), lambda x: F.struct(x["item_id"].alias("item_id"), (F.col("p") - x["off"]).alias("start"), F.size(x["win"]).alias("n"))).alias("hits")).where(F.size("hits") > 0)
    per_doc = met.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1))))).cast("long")
    ids = F.array_sort(F.array_distinct(F.array_compact(F.transform("hits", lambda x: x["item_id"].cast("string")))))
    per_doc = per_doc.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), hit.alias("n_hit"), ids.alias("items"))
    out = read.select("doc_id", "text_hash", "n_words").join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left").drop("_d", "_h")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs without the rows in which any window of any item occurs; all columns pass through."""
    d, h = fresh(docs, "d", "h")
    bad = cut(find_items(docs, items, window).where("contaminated").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct())
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)), "left_anti")
