"""Product quantisation of vectors: codebooks by Lloyd rounds over columnar blocks.

Vectors become integers, and every task packs its rows into blocks that hold one dimension
after the other. A round is one ``treeAggregate`` over these blocks: distances to a part's entries add up dimension by
dimension, each part goes to its nearest entry, and ``np.add.at`` puts its components and a count into an int64 tensor
of (entry, dimension). Tensors merge through a reduction tree, so the driver gets one tensor a part however
many rows there are, and all arithmetic is in whole numbers, so that no order of merging changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of this size and more count as not finite: their integers would leave 64 bits.
LIMIT = 2.0**50
#: Integers below this are added and squared in int64 (2^40 rows, 2^17 dimensions); blocks with larger ones use Python's integers.
NARROW = 1 << 22
BLOCK_VALUES = 1 << 20

Books = list[np.ndarray]  # of each part (entries, dimensions of the part)


def cuts(dimensions: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end; parts are equal where the length allows it."""
    return [k * dimensions // parts for k in range(parts + 1)]


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v): rows with whole vectors, components as floor(scale * x)."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= LIMIT))
    return vectors.where(v.isNotNull() & ~bad).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def first_books(rows: DataFrame, parts: int, entries: int) -> Books | None:
    """The parts of the vectors of the smallest ids; None without any. Of rows that repeat an id the least vector counts."""
    least = [r[0] for r in rows.where(F.col("id").isNotNull()).select("id").distinct().orderBy("id").limit(1).collect()]
    lead = rows.where(F.col("id") == least[0]) if least else rows  # only null ids: the least vector leads
    found = lead.agg(F.size(F.min("v")).alias("n")).collect()[0].n
    if found is None or found < 0:
        return None
    same = rows.where(F.size("v") == found)
    ids = [r[0] for r in same.where(F.col("id").isNotNull()).select("id").distinct().orderBy("id").limit(entries).collect()]
    seeds = [r.v for r in same.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()] if ids else [same.agg(F.min("v").alias("v")).collect()[0].v]
    at = cuts(found, parts)
    return [np.array([s[a:b] for s in seeds], np.int64).reshape(len(seeds), b - a) for a, b in zip(at, at[1:], strict=False)]


def _blocks(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = max(1, BLOCK_VALUES // max(1, dimensions))
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                x = np.asarray(part.column(2).flatten()).reshape(part.num_rows, dimensions).T
                kind = next(t for t in (np.int16, np.int32, np.int64) if not x.size or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max))
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(k)) for k in (0, 1)]
                data = np.ascontiguousarray(x, kind).tobytes()
                yield pa.RecordBatch.from_arrays([*lists, pa.array([part.num_rows], pa.int64()), pa.array([np.dtype(kind).str]), pa.array([data], pa.binary())], ["ids", "labels", "n", "kind", "data"])

    return run


def blocks(rows: DataFrame, dimensions: int) -> DataFrame:
    """(ids, labels, n, kind, data): rows of one length as columnar blocks of bounded size; data has one dimension after the other."""
    types = rows.schema
    made = T.StructType([T.StructField("ids", T.ArrayType(types["id"].dataType)), T.StructField("labels", T.ArrayType(types["label"].dataType)), T.StructField("n", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("data", T.BinaryType())])
    return rows.mapInArrow(_blocks(dimensions), made)


def unpack(n: int, kind: str, data: bytes, dimensions: int) -> np.ndarray:
    """(dimensions, n) in int64, or in Python's integers where 64 bits could overflow."""
    x = np.frombuffer(data, kind).reshape(dimensions, n)
    wide = x.size and max(-int(x.min()), int(x.max())) >= NARROW
    return x.astype(object if wide else np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance for every column of x; ties go to the lower index."""
    if book.dtype != x.dtype:
        book, x = book.astype(object), x.astype(object)
    far = np.zeros((x.shape[1], len(book)), x.dtype)
    for j in range(len(x)):
        step = x[j][:, None] - book[None, :, j]
        far += step * step
    best = far.argmin(1)
    return best, far[np.arange(len(best)), best]


def _added(books: Books, dimensions: int):
    at = cuts(dimensions, len(books))

    def add(total: list | None, row) -> list:
        x = unpack(row.n, row.kind, row.data, dimensions)
        out = total or [(np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)) for b in books]
        for p, book in enumerate(books):
            mine = x[at[p] : at[p + 1]]
            best, _ = nearest(mine, book)
            count, sums = out[p]
            np.add.at(count, best, 1)
            if mine.dtype != sums.dtype:
                sums = sums.astype(object)
            for j in range(len(mine)):
                np.add.at(sums[:, j], best, mine[j])
            out[p] = count, sums
        return out

    return add


def _merged(a: list | None, b: list | None) -> list | None:
    return a or b if a is None or b is None else [(n + m, s + t) for (n, s), (m, t) in zip(a, b, strict=True)]


def train(packed: DataFrame, books: Books, dimensions: int, rounds: int = ROUNDS) -> Books:
    """Rounds of assignment and floor means over blocks; entries that nothing is assigned to stay."""
    for _ in range(rounds):
        total = packed.select("n", "kind", "data").rdd.treeAggregate(None, _added(books, dimensions), _merged, depth=2)
        if total is not None:
            means = [np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], b) for b, (n, s) in zip(books, total, strict=True)]
            books = [m.astype(np.int64) if not m.size or max(abs(int(m.min())), abs(int(m.max()))) < NARROW else m.astype(object) for m in means]
    return books


def _coded(books: Books, dimensions: int):
    at = cuts(dimensions, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = (batch.column(c)[k].values for c in (0, 1))
                x = unpack(*(batch.column(c)[k].as_py() for c in (2, 3, 4)), dimensions)
                found = [nearest(x[a:b], book) for a, b, book in zip(at, at[1:], books, strict=False)]
                code = ["".join(f"{i:02x}" for i in r) for r in np.stack([best for best, _ in found], 1)]
                error = [min(int(e), (1 << 63) - 1) for e in sum(far for _, far in found)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return run


def digest(books: Books) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """((id_col, label, code, error, label_error, codebooks_sha256), codebooks); one row for every row with a whole vector.

    Null vectors and those with a null or not finite component (or one of 2^50 and more) give no row.
    Codebooks begin with the vectors of the smallest distinct ids, as many as there are up to entries; rows
    without an id are coded but never begin one unless all ids are null, and of rows that repeat an id the least
    vector begins. A vector's length is that of the smallest id's; others are in no codebook, with null
    code and error. Lengths that the parts don't divide are cut as evenly as can be, an empty part's code is 00.
    Errors above 2^63-1 are given as that. label_error adds up over equal labels, nulls together,
    and is null where the sum leaves 64 bits. Equal
    rows have equal codes, whatever the partitions; an empty table gives an empty one.
    """
    rows = integers(vectors, id_col, vector_col, label_col, scale)
    books = first_books(rows, parts, entries)
    if books is None:
        none = rows.limit(0).select(F.col("id").alias(id_col), F.col("label").alias(label_col), F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
        return none, []
    dimensions, scratch = sum(b.shape[1] for b in books), Scratch(vectors.sparkSession, "vectors")
    packed = scratch.settle(blocks(rows.where(F.size("v") == dimensions), dimensions), "blocks")
    books = train(packed, books, dimensions, rounds)
    fields = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("label", rows.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    odd = rows.where(F.size("v") != dimensions).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = settle(packed.mapInArrow(_coded(books, dimensions), fields).unionByName(odd), "codes")
    scratch.clear()
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    made = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return made.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), books
