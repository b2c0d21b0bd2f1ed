"""Tables that end a long lineage: written once to the folder that all executors share, and read from there."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_at_exit: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session of one machine may do without, in its warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def settled(df: DataFrame) -> DataFrame:
    """df, computed now: plans over it begin at its files, so that using it several times costs no second computation.

    What is written goes when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/strandlake-tracks-{spark.sparkContext.applicationId}"
    if folder not in _at_exit:
        _at_exit.add(folder)

        def end() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone already
                remove(spark, folder)

        atexit.register(end)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
