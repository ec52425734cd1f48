"""Evaluate each key once and give the result to all that have it; and rows that are refused, or that something refers to and nobody listed."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.graph import settle


class Memo:
    """Results by key in a folder: a folder of Parquet files for each run, which counts once Spark has marked it as whole."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"key string, at timestamp, {schema}"

    def rows(self) -> DataFrame:
        """(key, at, ...): the last result of every key."""
        jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
        marks = jvm.org.apache.hadoop.fs.Path(f"{self.path}/run=*/_SUCCESS")
        runs = sorted(x.getPath().getParent().toString() for x in marks.getFileSystem(jsc.hadoopConfiguration()).globStatus(marks) or [])
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        every = self.spark.read.schema(self.schema).parquet(*runs)
        return every.groupBy("key").agg(F.max_by(F.struct(*every.columns[1:]), "at").alias("x")).select("key", "x.*")

    def evaluate(self, owners: DataFrame, check: Callable[[DataFrame], DataFrame], now: datetime, stale_before: datetime | None = None, most_keys: int | None = None) -> tuple[DataFrame, dict[str, int]]:
        """(owners with their key's result, progress).

        owners: any columns and key; a null key has no result. check gets (key), the distinct keys without a result since stale_before,
        and returns (key, ...) of the memo's schema for as many as it can. What it returns is written before
        anything is joined, so a run that fails later has not lost it. most_keys: at most so many keys are checked in this run, the
        rest in later ones. progress: keys there are, were known, have been checked now, and are left.
        """
        had = self.rows() if stale_before is None else self.rows().where(F.col("at") >= F.lit(stale_before))
        keys = settle(owners.where("key is not null").select("key").distinct().join(had.select("key", F.lit(True).alias("known")), "key", "left"), "keys")
        todo = keys.where("known is null").select("key")
        made = check(todo if most_keys is None else todo.orderBy("key").limit(most_keys)).withColumn("at", F.lit(now))
        made.select(*[f.split()[0] for f in self.schema.split(", ")]).write.parquet(f"{self.path}/run={uuid.uuid4().hex}")
        current = settle(self.rows() if stale_before is None else self.rows().where(F.col("at") >= F.lit(stale_before)), "memo")
        counts = keys.join(current.select("key", F.lit(True).alias("now")), "key", "left").agg(F.count("*").alias("keys"), F.count("known").alias("known"), F.count(F.when(F.col("known").isNull() & F.col("now"), 1)).alias("checked")).first()
        progress = {"keys": counts.keys, "known": counts.known, "checked": counts.checked, "left": counts.keys - counts.known - counts.checked}
        return owners.join(current.drop("at"), "key", "left"), progress


def quarantine(rows: DataFrame, checks: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame, dict]:
    """(good rows, (rows..., reasons), report): rows that fail a check are set apart with all their reasons, in the order of checks.

    checks: (reason, a condition that holds for what is wrong; null is not wrong). report: rows, quarantined, partial, reasons (how many
    rows have each); it is counted by Spark while the rows are written, once.
    """
    reasons = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda r: r.isNotNull())
    seen = Observation()
    marked = rows.withColumn("reasons", reasons)
    counts = [F.count(F.when(F.array_contains("reasons", name), 1)).alias(f"r{k}") for k, (name, _) in enumerate(checks)]
    marked = settle(marked.observe(seen, F.count("*").alias("rows"), F.count(F.when(F.size("reasons") > 0, 1)).alias("quarantined"), *counts), "quarantine")
    got = seen.get
    report = {"rows": got["rows"], "quarantined": got["quarantined"], "partial": got["quarantined"] > 0, "reasons": {name: got[f"r{k}"] for k, (name, _) in enumerate(checks)}}
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0), report


def repaired(listed: DataFrame, key: str, references: Callable[[DataFrame], DataFrame] | DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(listed rows and fetched ones with a column listed, (key) that are referred to and can't be had).

    references: (key) of everything that is referred to; as a function of rows, it is asked for fetched rows too, until nothing new is named.
    fetch gets (key) of what isn't there and returns rows like listed; rows under another key than asked are left out.
    """
    have = listed.withColumn("listed", F.lit(True))
    rule = references if callable(references) else None
    asked = (rule(listed) if rule else references).select(key).where(F.col(key).isNotNull()).distinct()
    gone = None
    while True:
        missing = settle(asked.join(have.select(key), key, "left_anti"), "missing")
        if gone is not None:
            missing = settle(missing.join(gone, key, "left_anti"), "missing")
        if missing.isEmpty():
            break
        got = settle(fetch(missing).join(missing, key, "left_semi").select(*listed.columns).withColumn("listed", F.lit(False)), "fetched")
        lost = settle(missing.join(got.select(key), key, "left_anti"), "lost")
        gone = lost if gone is None else gone.unionByName(lost)
        have = settle(have.unionByName(got), "listed")
        if not rule:
            break
        asked = rule(got.drop("listed")).select(key).where(F.col(key).isNotNull()).distinct()
    return have, gone if gone is not None else asked.limit(0)
