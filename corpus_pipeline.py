"""The corpus pipeline: documents that the quality classifier keeps, without repeated lines, near copies and benchmark passages, packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of
documents, as they came but for text and n_chars. No stage depends on the number or the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    from strandlake.llm.common import table
    from strandlake.llm.quality_net import drop_low_quality

    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that another document with a smaller id holds too; n_chars, if there is one, follows the text."""
    from strandlake.llm.common import fresh
    from strandlake.llm.lines import dedup_lines

    cleaned = dedup_lines(docs, measures=tuple(fresh(docs, "lines", "dropped")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Linked are SimHash fingerprints over three-word shingles at 2 or fewer differing bits, as in op6, and, as a 64-bit print tells
    little below that, what else has a resemblance of 0.8 or more over five-word shingles.
    """
    from strandlake.llm.near_copies import one_of_each

    return one_of_each(docs, prints=(3, 2))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    from strandlake.llm.common import table
    from strandlake.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left and their places in sequences of 2048 tokens."""
    import public_tokenizers

    from strandlake.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmarks), ("best-fit packing", packing)]
#: SQL can't express the classifier; tests hold each stage against a plain version of itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    from strandlake.llm.common import cut, drop_cut, table

    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            if before is not None:
                drop_cut(before)
            before = docs
    return docs
