"""Secret scanning with an incremental ledger of content-addressed blobs.

Every version of a text is a blob named by the SHA-256 of its bytes.  A ledger holds
(blob, rule) pairs that were scanned, a rule being named with its version; a run scans
only pairs that the ledger lacks and then joins the findings, old and new, back to
every path that holds the blob.  Copies are scanned once, unchanged files never again,
and a changed rule costs its own column only.  All of it is DataFrame functions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of


@dataclass(frozen=True)
class Rule:
    """pattern: what to look for, leftmost and non-overlapping, in java.util.regex syntax.

    A match counts if its group ``group`` has at least ``least`` characters.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules. A hexadecimal run and an access key are matched whole, so their least length stands in the pattern.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
# Further public token formats.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", base=False),
    Rule("github", 1, r"\bgh[pousr]_[A-Za-z0-9]{36}\b", base=False),
    Rule("slack", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", base=False),  # from the start of a run only, which is read once
    Rule("urlpass", 1, r"\b[a-z][a-z0-9+]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@", base=False),
)
RULES = BASE_RULES + MORE_RULES
#: Tasks over which the paths of one blob are spread.
SALTS = 16
SPANS = "array<struct<start:int,end:int>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of a rule's matches, in code points, end exclusive.

    The texts between matches and the matches themselves, put end to end, are the
    whole text, so running sums of their lengths give the places. The sums are made by doubling (first each length
    plus its neighbour's, then plus that two places before, four, ...): n log n, where an array that grows by one
    in a fold would be copied n times.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    keys = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    own = F.zip_with(F.transform(gaps, F.length), F.transform(matches, F.length), lambda gap, match: gap + match)  # null after the last match
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda step: step < F.size(matches))
    ends = F.aggregate(steps, own, lambda sums, step: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - step), F.lit(0))))
    parts = F.arrays_zip(ends.alias("end"), F.transform(matches, F.length).alias("match"), F.transform(keys, F.length).alias("key"))
    found = F.transform(F.filter(parts, lambda x: x["key"] >= rule.least), lambda x: F.struct((x["end"] - x["match"]).alias("start"), x["end"].alias("end")))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(F.array()).cast(SPANS)


def blobs_of(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, blob, text): the ledger's view of a table of texts; null is the empty blob."""
    return files.select(F.col(path_col).alias("path"), F.sha2(text_of(text_col), 256).alias("blob"), text_of(text_col).alias("text"))


def scan(blobs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule, spans) for the (blob, rule) pairs that the ledger lacks.

    blobs has (blob, text), repeats allowed.  A pair without a finding gets an empty
    array of spans, so that it isn't scanned again.
    """
    once = blobs.select("blob", "text").dropDuplicates(["blob"])
    if ledger is None:
        todo = once.withColumn("rules", F.array(*[F.lit(r.name) for r in rules]))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        left = F.array_except(F.array(*[F.lit(r.name) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
        todo = once.join(seen, "blob", "left").withColumn("rules", left).where(F.size("rules") > 0)
    each = [F.when(F.array_contains("rules", r.name), F.struct(F.lit(r.name).alias("rule"), spans_of(F.col("text"), r).alias("spans"))) for r in rules]
    return todo.select("blob", F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found): all spans (start, rank, kind, end) of the blob, ordered; rank is the rule's place in rules."""
    now = ledger.where(F.col("rule").isin([r.name for r in rules])).where(F.size("spans") > 0)
    rank = F.create_map(*[F.lit(y) for i, r in enumerate(rules) for y in (r.name, i)])
    found = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[F.col("rule")].alias("rank"), F.substring_index("rule", "@", 1).alias("kind"), s["end"].alias("end")))
    return now.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(found))).alias("found"))


def scan_files(files: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "text", known: bool = False) -> tuple[DataFrame, DataFrame]:
    """(result, new ledger rows). known: the ledger has all blobs of files, none is scanned.

    result: (path, blob, found) for every row of files, found being all its spans
    (empty array: none).  Null texts are the empty blob; a null path is a path; rows that
    repeat are each returned; an empty table gives an empty one.  Append the new
    ledger rows to the ledger to skip their blobs next time.
    """
    view = blobs_of(files, path_col, text_col)
    new = scan(view.limit(0) if known else view, ledger, rules)
    whole = new if ledger is None else ledger.select("blob", "rule", "spans") if known else ledger.select("blob", "rule", "spans").join(view.select("blob"), "blob", "left_semi").unionByName(new)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    # blobs with findings are few and some have very many paths: the former are repeated so that the latter meet them in several tasks
    spread = findings(whole, rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    paths = view.select("path", "blob", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"))
    result = paths.join(spread, ["blob", "salt"], "left").select("path", "blob", F.coalesce("found", none).alias("found"))
    return result, new


class Ledger:
    """A ledger in a folder: a folder of Parquet files for each run, which counts once Spark has marked it as whole.

    A run writes what it has scanned and then reads findings from the ledger, so texts are scanned once, and
    a run that fails half-way leaves nothing that later ones believe.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame | None:
        """(blob, rule, spans) of all finished runs; None before the first."""
        jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/run=*/_SUCCESS")
        done = at.getFileSystem(jsc.hadoopConfiguration()).globStatus(at) or []
        runs = sorted(x.getPath().getParent().toString() for x in done)
        return self.spark.read.schema(f"blob string, rule string, spans {SPANS}").parquet(*runs) if runs else None

    def scan(self, files: DataFrame, rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "text") -> DataFrame:
        """scan_files()' result; what is new is written to the ledger first."""
        _, new = scan_files(files, self.rows(), rules, path_col, text_col)
        new.write.parquet(f"{self.path}/run={uuid.uuid4().hex}")
        return scan_files(files, self.rows(), rules, path_col, text_col, known=True)[0]


def spell(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
