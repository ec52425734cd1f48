"""Line dedup by site-relative frequency.

For each host, a line's ratio is the number of the host's pages that contain it over the
number of the host's pages; lines above the boilerplate ratio go.  Counting is per (host, line digest),
so a host with a third of all pages is counted by many tasks, and the pages are never
taken apart: what is boilerplate at a host, a short list, is joined to its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Ratio above which a line goes. A line that one page alone holds is repeated nowhere, whatever share of a small host that page is.
RATIO, LEAST_PAGES = 0.1, 2


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, contents: bool = False) -> DataFrame:
    """(host, lines): digests of the lines that go, for each host that has any.

    pages has (host, text).  A line is boilerplate if more than ratio of the host's
    pages, and at least least_pages, contain it; the method is the ratio alone, and the default only asks for a
    second page.  contents: pages of equal text count as one, as totals and for a line, so that copies of a page don't
    make its lines frequent.  Blank lines never are.  At most
    (lines per page) / ratio lines of a host can pass, so the list stays short however large the host is.
    """
    page = _digest(F.col("text")) if contents else F.lit(None).cast("binary")
    each = pages.select("host", "text", page.alias("page"))
    lines = each.where("text is not null").select("host", "page", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).where(F.trim("line") != "")
    lines, each = lines.select("host", "page", _digest(F.col("line")).alias("line")), each.select("host", "page")
    if contents:
        lines, each = lines.distinct(), each.distinct()
    totals = each.groupBy("host").agg(F.count("*").alias("pages"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("with_line")).where(F.col("with_line") >= least_pages)
    often = counts.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(F.col("with_line") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, host_col: str = "source", text_col: str = "text", out_col: str | None = None, contents: bool = False) -> DataFrame:
    """docs with text_col (or, if named, a new column out_col) without its host's boilerplate lines.

    Every row and all other columns stay.  A null text stays null, a text of nothing but
    boilerplate becomes empty; a null host is a host.  Lines end at "\\n"; repeated rows
    are pages of their own (with contents: one page).  An empty table gives an empty one.
    """
    # settled, so that the planner knows the list's size and sends it to the pages if it is small enough, rather than pages to it
    often = settle(boilerplate(docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")), ratio, least_pages, contents), "boilerplate")
    names = ["tg_host", "tg_lines"]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    host, gone = names
    joined = docs.join(often.withColumnsRenamed({"host": host, "lines": gone}), F.col(host_col).eqNullSafe(F.col(host)), "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda line: ~F.array_contains(F.col(gone), _digest(line))), "\n")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)
    return joined.withColumn(out_col or text_col, text).drop(host, gone)
