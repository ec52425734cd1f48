"""Writers: guarded CSV, graphs behind a validation gate, versions behind a pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions import strings
from tidegrid.operators import graph


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with quoted cells that no spreadsheet takes for formulas; arrays and structs as JSON."""
    cell = lambda f: F.to_json(F.col(f.name)) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
    df.select(*[strings.csv_cell(cell(f)).alias(f.name) for f in df.schema]).write.option("header", True).option("quoteAll", True).option("escape", '"').mode("overwrite").csv(path)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Write tables into a new version and then point to it; readers see the old version until the last moment, and keep it if a write fails."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/versions/{version}/{name}")
    spark.sql("select current_timestamp() as at").withColumn("version", F.lit(version)).coalesce(1).write.mode("append").parquet(f"{root}/current")
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that was published last."""
    version = spark.read.parquet(f"{root}/current").agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(f"{root}/versions/{version}/{name}")


def publish_graph(spark: SparkSession, root: str, nodes: DataFrame, edges: DataFrame) -> str:
    """Publish a graph that has no errors; warnings are published with it."""
    issues = graph.settle(graph.validate(nodes, edges), "issues")
    errors = issues.where("severity = 'error'")
    if not errors.isEmpty():
        raise ValueError(f"invalid graph: {errors.limit(10).collect()}")
    return publish(spark, root, {"nodes": nodes, "edges": edges, "issues": issues, "stats": graph.stats(nodes, edges)})


def tail(log: DataFrame, at: str, n: int) -> DataFrame:
    """The last n entries of a log."""
    return log.orderBy(F.desc(at)).limit(n)


class RotatedLog:
    """A log of JSON lines in a folder: every append is a run of files of bounded size, which counts once Spark has marked it as whole.

    Lines are placed by a running sum of their bytes over ranges of their order, so many tasks write, no file is above most bytes and
    files and lines are in order. tail() opens only the newest files.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 1 << 20) -> None:
        self.spark, self.path, self.most = spark, path.rstrip("/"), most
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, pattern: str) -> list:
        return list(self.store.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")) or [])

    def append(self, rows: DataFrame, order: list[str]) -> int:
        """Write rows as JSON lines by order; how many there were. An error, and nothing written, if a line alone is larger than a file may be."""
        line = rows.select(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
        keys = [f"_o{k}" for k in range(len(order))]
        line = line.withColumn("bytes", (F.octet_length("value") + 1).cast("long")).repartitionByRange(*keys, "value").sortWithinPartitions(*keys, "value")
        line = graph.settle(line.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "log")
        sums = line.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("longest"), F.count("*").alias("n"), F.min(F.struct(*keys, "value")).alias("first"))
        total = sums.agg(F.max("longest").alias("longest"), F.sum("n").alias("n")).first()
        if not total.n:
            return 0
        if total.longest > self.most:
            raise ValueError(f"a line of {total.longest} bytes is larger than a file may be")
        before = F.coalesce(F.sum("bytes").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # over one row a range
        placed = line.join(F.broadcast(sums.select("part", before.alias("before"))), "part")
        end = F.col("before") + F.sum("bytes").over(W.partitionBy("part").orderBy("place"))
        # a line goes to the file in which it ends, so that a file may have one line's bytes more than its share
        file = F.floor((end - 1) / F.lit(self.most - total.longest + 1)).cast("long")
        number = len(self._list("run=*"))
        out = placed.select(F.lpad(file.cast("string"), 12, "0").alias("file"), end.alias("end"), "value")
        out.repartition("file").sortWithinPartitions("file", "end").select("file", "value").write.partitionBy("file").text(f"{self.path}/run={number:012d}-{uuid.uuid4().hex}")
        return total.n

    def files(self) -> list[tuple[str, int]]:
        """(path, bytes) of the files of whole runs, in order."""
        whole = {x.getPath().getParent().toString() for x in self._list("run=*/_SUCCESS")}
        found = [(x.getPath(), x.getLen()) for x in self._list("run=*/file=*/part-*")]
        return sorted((p.toString(), n) for p, n in found if p.getParent().getParent().toString() in whole)

    def tail(self, lines: int = 200, most: int = 1 << 18) -> tuple[DataFrame, dict]:
        """((line, value) of the last lines, report): of whole lines within the last most bytes at most; line is 0 for the last, 1 for the one before.

        report: files (how many were opened), truncated (whether there is more).
        """
        every = self.files()
        opened, size = [], 0
        for path, n in reversed(every):
            opened.append(path)
            size += n
            if size >= most:
                break
        report = {"files": len(opened), "truncated": len(opened) < len(every)}
        if not opened:
            return self.spark.createDataFrame([], "line long, value string"), report
        # files are bounded and few here, and a text file's lines are read in order by one task each
        text = self.spark.read.text(opened, wholetext=True).select(F.input_file_name().alias("name"), F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("place", "value"))
        rank = F.row_number().over(W.orderBy(F.desc("name"), F.desc("place"))) - 1  # over the tail alone
        bytes_ = F.sum(F.octet_length("value") + 1).over(W.orderBy("line"))
        cut = graph.settle(text.select(rank.cast("long").alias("line"), "value").select("line", "value", bytes_.alias("bytes")), "tail")
        kept = cut.where((F.col("line") < lines) & (F.col("bytes") <= most))
        report["truncated"] |= cut.count() > kept.count()
        return kept.select("line", "value"), report
