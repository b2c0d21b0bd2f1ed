"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join, and the forms they stand for.

A word of l code points is cut evenly into two segments, each of those once more. One edit leaves a segment whole, and one
half of the other: so a word is indexed four times, by its length, the part that may differ and all that is left of it.
A word of equal length or one longer probes with the substrings at the same places, shifted by one behind the part that may
differ. What meets is verified on that part alone. A pair is kept in the part of its first difference only, so none is found twice.

Null texts have no words, a null id counts as the empty string, repeated rows count each; an empty table gives no rows.
Words of any length are taken whole. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import ascii_lower, cut, drop_cut

LETTERS = "A-Za-zÀ-ÿ"


def counted_words(docs: DataFrame, shortest: int = 7, least: int = 2, noise: int = 31) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased; where `noise` divides crc32 of `<doc_id>:<run>` a run has lost a code point."""
    # what becomes a word has that many letters at least
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    runs = runs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), ascii_lower(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _bounds(length: Column, part: Column) -> tuple[Column, Column]:
    """Where part 0 to 3 of an indexed word of that length begins and ends."""
    half = F.floor(length / 2)
    places = F.array(F.lit(0), F.floor(half / 2), half, half + F.floor((length - half) / 2), length)
    return F.get(places, part).cast("int"), F.get(places, part + 1).cast("int")


def _entries(words: DataFrame, longer: int) -> DataFrame:
    """word, n and for each part length, part, fixed, open, of words `longer` code points longer than those they are to meet."""
    rows = words.withColumn("length", F.char_length("word") - longer).withColumn("part", F.explode(F.array(*(F.lit(k) for k in range(4)))))
    lo, hi = _bounds(F.col("length"), F.col("part"))
    rows = rows.withColumns({"lo": lo, "hi": hi})
    word, rest = F.col("word"), F.char_length("word")
    fixed = F.concat(word.substr(F.lit(1), F.col("lo")), word.substr(F.col("hi") + 1 + longer, rest))
    return rows.select("word", "n", "length", "part", fixed.alias("fixed"), word.substr(F.col("lo") + 1, F.col("hi") - F.col("lo") + longer).alias("open"))


def near_pairs(words: DataFrame, shortest: int = 4) -> DataFrame:
    """a, a_n, b, b_n: each pair of distinct words (word, n) one inserted, deleted or replaced code point apart, once.

    Words shorter than `shortest`, at least 4, have no four parts and are left out.
    """
    words = words.where(F.char_length("word") >= max(shortest, 4))
    index = _entries(words, 0).withColumnsRenamed({"word": "a", "n": "a_n", "open": "a_open"})
    equal = _entries(words, 0).withColumn("longer", F.lit(0))
    probes = equal.unionByName(_entries(words, 1).withColumn("longer", F.lit(1))).withColumnsRenamed({"word": "b", "n": "b_n", "open": "b_open"})
    one_edit = F.levenshtein("a_open", "b_open", 1) == 1
    first = (F.col("part") == 3) | (F.col("b_open").substr(F.lit(1), F.char_length("a_open")) != F.col("a_open"))
    once = F.when(F.col("longer") == 0, F.col("a") < F.col("b")).otherwise(first)
    return index.join(probes, ["length", "part", "fixed"]).where(once & one_edit).select("a", "a_n", "b", "b_n")


def forms(words: DataFrame, pairs: DataFrame, times: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n: form is the near word met most, of ties the first in code-point order, if met `times` as often."""
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("m")))
    near = pairs.select(F.explode(ends).alias("e")).select("e.*")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    stands = -F.col("best.m") >= times * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(stands, F.col("best.near")).alias("form"), F.when(stands, -F.col("best.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """word, root of the words that have a form: links are followed two, four, eight and so on at a time until none goes on."""
    at = cut(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop_cut(at)
        at = step
        if not step.where("moved").head(1):
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, noise: int = 31, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of all documents."""
    words = cut(counted_words(docs, shortest, least, noise))
    found = cut(forms(words, near_pairs(words, shortest), times))
    drop_cut(words)
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
