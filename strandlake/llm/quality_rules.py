"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document into a failure bit beside the measurements it read. Policies are versioned masks over
those bits, so applying another version or asking what a rule costs reads the ledger and never the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import UPPER, let

#: Fixed by the contract.
GAP, SYMBOLS, SPACES = r"[\x20\x09-\x0D]+", "#*$%&|<>", " \t\n\x0b\x0c\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


@dataclass(frozen=True)
class Rule:
    """bit: its place in the mask, never reused. fails: a condition on the measurements."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(3, "capitals", "100 * n_upper > 40 * word_chars"),
    Rule(4, "repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
    Rule(6, "long_words", "word_chars > 25 * n_words"),
    Rule(7, "any_repeated_lines", "n_dup_lines > 0"),
)
BASE = 0b11
#: Versions of what rejects a document.
POLICIES = {"base": BASE, "v1": 0b1111111, "strict": 0b11111111}


def _repeat_words(ws: Column) -> Column:
    """Words in a three-word window that the text has twice or more: windows are sorted by hash and compared with their neighbours."""
    windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")))
    again = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return F.when(F.size(ws) >= 4, F.size(covered)).otherwise(0).cast("long")


def _gone(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements (long) and failed_bits (long) of every row of docs.

    Null and empty texts have no words, lines or symbols and fail the length rule; a null doc_id is kept; repeated rows give
    repeated rows; no rows give none; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    words = F.array_remove(F.split(text, GAP), "")
    rows = docs.select(
        F.col("doc_id"),
        let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), _repeat_words(ws).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))).alias("l"),
        (F.char_length(text) - _gone(text, SPACES)).cast("long").alias("word_chars"),
        _gone(text, SYMBOLS).cast("long").alias("n_symbols"),
        _gone(text, UPPER).cast("long").alias("n_upper"),
    ).select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_upper")
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long") for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.select("doc_id", *MEASURES, failed.alias("failed_bits"))


def apply_policy(led: DataFrame, version: str) -> DataFrame:
    """The ledger with base_failed and kept under a version."""
    hit = lambda mask: F.col("failed_bits").bitwiseAND(F.lit(mask)) != 0
    return led.withColumns({"base_failed": hit(BASE), "kept": ~hit(BASE | POLICIES[version])})


def ablations(led: DataFrame, version: str) -> DataFrame:
    """rule, failed, failed_alone (kept again without the rule), per rule of a version: from counts per mask, of which there are few."""
    mask = POLICIES[version]
    per_mask = led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b")) for r in RULES if mask >> r.bit & 1)))
    rows = per_mask.select("m", "n", rules.alias("r")).where(F.col("m").bitwiseAND(F.col("r.b")) != 0)
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(F.sum("n").alias("failed"), F.sum(F.when(F.col("m") == F.col("r.b"), F.col("n")).otherwise(0)).alias("failed_alone"))
