"""Shared helpers: scratch tables in the cluster's shared folder, text access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset a local master (tests, a notebook) gets a fresh local folder; on a cluster, where each
    machine would write to a disk of its own, it is an error.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not told:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        told = f"file://{tempfile.mkdtemp(prefix='tidegrid-')}"
        sc.setCheckpointDir(told)
    return told


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidegrid-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage like ``checkpoint()`` (a lost executor costs nothing
    but its running tasks) and keeps column pruning for what reads it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The settled tables of one run, below one folder that clear() removes."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, scratch_path(spark, name)

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Remove the tables; nothing that reads them may be run any more."""
        jvm, jsc = self.spark._jvm, self.spark._jsc
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(column: str = "text") -> Column:
    """Number of words in a text, 0 for null.

    Counts the places where a word starts, without building an array of words.
    """
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")
