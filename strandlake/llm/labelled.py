"""A bounded labelled sample, gathered to the driver to fit a classifier on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import cut, drop_cut, held_out, slices

#: Bytes of the texts of a class that are gathered at most, but for the last text.
BYTES = 128 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = BYTES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Whole texts, labels and weights of at most `most` documents of either class that are not held out.

    The documents are the first by a hash of doc_id, so the sample doesn't depend on partitions, and no more than fill
    `most_bytes`. Weights give each class its share of all labelled documents. Labels without a document or doc_id teach
    nothing; of repeated labels of a doc_id the largest counts, and of its texts the smallest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = cut(known.groupBy("doc_id").agg(F.max("y").alias("y")).join(ids, "doc_id", "left_semi"))
    total = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        own = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = own if picked is None else picked.unionByName(own)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # at most 2 * most ids
    texts = cut(texts.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    before = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    fits = texts.select("doc_id", "y", F.octet_length("text").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("before") < most_bytes)
    got = texts.join(F.broadcast(fits.select("doc_id")), "doc_id").select("doc_id", "y", "text").toArrow().sort_by([("doc_id", "ascending")])
    drop_cut(known, texts)
    y = np.array(got.column("y").to_pylist(), np.int64)
    weight = np.array([total[k] for k in y.tolist()], float) / np.maximum(np.bincount(y, minlength=2), 1)[y] if len(y) else np.zeros(0)
    return got.column("text").to_pylist(), y, weight / weight.mean() if len(y) else weight


def scored(docs: DataFrame, score, at_least: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; score: a function from texts to an array, shipped to executors."""
    import pyarrow as pa

    def run(batches):
        for batch in slices(batches):
            texts, out = batch.column("text"), []
            part, chars = [], 0
            for t in texts:
                part.append(t.as_py() or "")
                chars += len(part[-1])
                if chars > 2_000_000:
                    out.append(score(part))
                    part, chars = [], 0
            out.append(score(part))
            s = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= at_least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, score, at_least: float) -> DataFrame:
    """The rows of docs, with all their columns, that score at_least or more."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            yield batch.filter(pa.array(score(texts) >= at_least))

    return docs.mapInArrow(run, docs.schema)
