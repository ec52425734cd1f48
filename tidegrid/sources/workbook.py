"""Workbooks (.xlsx) as a data source, and names from the sheets of a DNS export.

``spark.dataSource.register(WorkbookSource)``, then ``spark.read.format("workbook").load(path)``: a row for each row of each sheet,
a partition for each sheet or, with option rows, for each range of so many rows. The path may be in any store that
pyarrow opens; a folder gives its .xlsx files.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Columns of a DNS export.
DNS_COLUMNS = {"type": "记录类型", "host": "主机记录", "line": "解析线路", "value": "记录值", "status": "状态(暂停/启用)"}
MORE_DNS_COLUMNS = {"ttl": "TTL值", "weight": "权重", "policy": "负载策略", "remark": "备注"}
SCHEMA = "file string, sheet string, row int, cells array<string>"
_local = lambda tag: tag.rsplit("}", 1)[-1]


class Range(InputPartition):
    """Rows first to last of a sheet (part: its entry in the archive)."""

    def __init__(self, file: str, sheet: str, part: str, first: int, last: int | None) -> None:
        self.file, self.sheet, self.part, self.first, self.last = file, sheet, part, first, last


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:/", "/", 1))


def column_number(reference: str) -> int:
    """0 for A1, 27 for AB3."""
    n = 0
    for c in re.match(r"[A-Z]*", reference).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _texts(entry) -> list[str]:
    """Shared strings: the text of each item, runs of formatted text joined, phonetic hints left out."""
    out: list[str] = []
    for _, e in ET.iterparse(entry, events=("end",)):
        if _local(e.tag) == "rPh":
            e.clear()
        elif _local(e.tag) == "si":
            out.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t"))
            e.clear()
    return out


def sheets_of(archive: zipfile.ZipFile) -> list[tuple[str, str, int | None]]:
    """(title, entry, last row or None) of the sheets, in their order."""
    links = {e.get("Id"): e.get("Target") for e in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for e in ET.fromstring(archive.read("xl/workbook.xml")).iter():
        if _local(e.tag) == "sheet":
            target = links[next(v for k, v in e.attrib.items() if _local(k) == "id" and k != "id")]
            entry = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            head = archive.open(entry).read(4096).decode("utf-8", "replace")
            size = re.search(r'<(?:\w+:)?dimension ref="[A-Z]+\d+:[A-Z]+(\d+)"', head)
            out.append((e.get("name"), entry, int(size[1]) if size else None))
    return out


def sheet_rows(archive: zipfile.ZipFile, entry: str, first: int = 1, last: int | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a sheet's rows from first to last; cells that are left out are null, numbers keep their text."""
    shared = _texts(archive.open("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in archive.namelist() else []
    number = 0
    for _, e in ET.iterparse(archive.open(entry), events=("end",)):
        if _local(e.tag) != "row":
            continue
        number = int(e.get("r") or number + 1)
        if last is not None and number > last:
            return
        if number >= first:
            cells: list[str | None] = []
            for c in e:
                at = column_number(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, v = c.get("t"), next((x.text for x in c if _local(x.tag) == "v"), None)
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                elif v is not None:
                    cells[at] = shared[int(v)] if kind == "s" else {"0": "FALSE", "1": "TRUE"}.get(v, v) if kind == "b" else v
            yield number, cells
        e.clear()


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rows = options["path"], int(options.get("rows", 0))

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, at = _store(self.path)
        info = store.get_file_info(at)
        files = [at] if info.type == fs.FileType.File else sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(".xlsx"))
        out: list[InputPartition] = []
        for file in files:
            with store.open_input_file(file) as f, zipfile.ZipFile(f) as archive:
                for title, entry, last in sheets_of(archive):
                    starts = range(1, last + 1, self.rows) if self.rows and last else [1]
                    out += [Range(file, title, entry, a, a + self.rows - 1 if self.rows and last and a + self.rows <= last else None) for a in starts]
        return out or [Range("", "", "", 1, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.file:
            store, _ = _store(self.path)
            with store.open_input_file(partition.file) as f, zipfile.ZipFile(f) as archive:
                for number, cells in sheet_rows(archive, partition.part, partition.first, partition.last):
                    yield partition.file.rsplit("/", 1)[-1], partition.sheet, number, cells


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


def dns_records(rows: DataFrame, zones: Sequence[str]) -> DataFrame:
    """(id, zone, name, type, value, line, status, ttl, weight, policy, remark, source, row) of a DNS export (file, sheet, row, cells).

    Each sheet is a zone. An error if a sheet is none of zones, if one of zones has no sheet, or if a sheet's first row lacks a column that is
    required. @ is the zone itself, a host that ends with the zone is whole, others go before it; blank rows are left out.
    """
    zone = F.regexp_replace(F.lower("sheet"), r"\.+$", "")
    heads = rows.where("row = 1").select("file", "sheet", zone.alias("zone"), F.col("cells").alias("head")).collect()  # a row a sheet
    if wrong := sorted({h.zone for h in heads} - set(zones)):
        raise ValueError(f"unsupported DNS zone: {', '.join(wrong)}")
    if bad := sorted(f"{h.file}/{h.sheet}" for h in heads if not set(DNS_COLUMNS.values()) <= set(h["head"])):
        raise ValueError(f"missing DNS columns: {', '.join(bad)}")
    if left := sorted(set(zones) - {h.zone for h in heads}):
        raise ValueError(f"zones without a sheet: {', '.join(left)}")
    head = rows.where("row = 1").select(F.col("file").alias("_file"), F.col("sheet").alias("_sheet"), F.col("cells").alias("_head"))
    body = rows.where((F.col("row") > 1) & F.exists("cells", lambda c: c.isNotNull()))
    body = body.join(head, (F.col("file") == F.col("_file")) & (F.col("sheet") == F.col("_sheet")))
    raw = lambda title: F.get("cells", (F.array_position("_head", F.lit(title)) - 1).cast("int"))
    text = lambda title: F.trim(F.coalesce(raw(title), F.lit("")))
    host = F.regexp_replace(F.lower(text(DNS_COLUMNS["host"])), r"\.+$", "")
    name = F.when(host == "@", zone).when((host == zone) | host.endswith(F.concat(F.lit("."), zone)), host).otherwise(F.concat_ws(".", host, zone))
    return body.select(
        F.concat_ws(":", zone, F.col("row").cast("string")).alias("id"), zone.alias("zone"), name.alias("name"), F.upper(text(DNS_COLUMNS["type"])).alias("type"), *[text(DNS_COLUMNS[k]).alias(k) for k in ("value", "line", "status")],
        raw(MORE_DNS_COLUMNS["ttl"]).alias("ttl"), raw(MORE_DNS_COLUMNS["weight"]).alias("weight"), *[text(MORE_DNS_COLUMNS[k]).alias(k) for k in ("policy", "remark")], F.col("file").alias("source"), "row",
    )
