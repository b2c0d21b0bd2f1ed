"""What the operators of this subpackage share: tables, durable cuts and row keys."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session of one machine may do without, in its warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


_at_exit: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; what is left there goes when the application ends."""
    path = f"{shared_dir(spark)}/strandlake-{spark.sparkContext.applicationId}"
    if path not in _at_exit:
        _at_exit.add(path)

        def end() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone already
                _remove(spark, path)

        atexit.register(end)
    return path


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*cuts: DataFrame) -> None:
    """Remove what cut() wrote, once later cuts no longer need it."""
    for df in cuts:
        _remove(df.sparkSession, df._cut_path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also when body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of doc_id as text leaves 1 modulo 3; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def slices(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches cut to at most so many rows, so that what a worker makes of one stays small; at the end its memory is given back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    tidy()


def complete(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of `rows` rows or more, the last one less, that hold all rows of each of their keys; batches arrive sorted by keys."""
    held: list[pa.RecordBatch] = []
    count, tail = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        end = [k[-1] for k in key]
        if count >= rows and end != tail:
            # the last place in the batch where a key begins
            new = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
            at = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            yield pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks()
            held, count, batch = [], 0, batch.slice(at)
        held.append(batch)
        count, tail = count + batch.num_rows, end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    tidy()


def tidy() -> None:
    """Give memory that a worker no longer uses back to the machine."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
