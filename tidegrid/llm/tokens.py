"""Token counts from flat, unindexed token files.

A token file is nothing but token ids, 2 or 4 bytes each, with an end-of-document id
after each document.  Files are read in blocks of a fixed number of ids, wherever that cuts
a document; numpy finds the separators of a block, and a prefix scan over a file's blocks
(last separator so far, separators so far) stitches the documents that blocks share.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import scratch_path, settle, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern by which the vocabulary's tokenizer cuts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 1 << 20
# What \s stands for in PATTERN. A run this long outgrows the backtracking stack of the tokenizer's pattern matcher.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@cache
def encoder(vocabulary: str):
    """(tokenizer, the first free id, which ends documents)."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def width(vocabulary: str) -> int:
    """Bytes of an id: 2 if all ids of the vocabulary, with the end of document, fit."""
    return 2 if encoder(vocabulary)[1] < 1 << 16 else 4


def encode(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """Token ids of a text; the pattern's pieces of very long runs of white space are cut here instead of by the pattern."""
    coder = encoder(vocabulary)[0]
    out: list[int] = []
    at = 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1  # the last one before a word goes with the word
        out += coder.encode_ordinary(text[at : m.start()])
        out += coder._encode_single_piece(text[m.start() : end])
        at = end
    return out + coder.encode_ordinary(text[at:])


def _open(path: str):
    """(file system, path) of a path with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:/", "/", 1))


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize docs into flat files of little-endian unsigned ids, width() bytes each, under path, one file a task.

    Returns the manifest (file, ordinal, id), settled in the shared folder: the ordinal-th
    document of a file, from 0.  A file is written under a name of its attempt, so a task that is
    run again or twice leaves a file that the manifest doesn't name.  Null texts are empty documents.
    """
    _, end = encoder(vocabulary)
    kind = f"<u{width(vocabulary)}"
    store, at = _open(path)
    store.create_dir(at, recursive=True)  # there even if no task runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _open(path)
        name, n = f"tokens-{uuid.uuid4().hex}.bin", 0
        with store.open_output_stream(f"{at}/{name}") as out:
            for batch in batches:
                for lo in range(0, batch.num_rows, 200):
                    part = batch.slice(lo, 200)
                    for text in part.column(1):
                        out.write(np.array([*encode(text.as_py(), vocabulary), end], kind).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows), pa.array(np.arange(n, n + part.num_rows)), part.column(0)], ["file", "ordinal", "id"])
                    n += part.num_rows

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    made = rows.mapInArrow(run, f"file string, ordinal long, id {rows.schema['id'].dataType.simpleString()}")
    return settle(made, "manifest")


def count_tokens(spark: SparkSession, path: str, end: int, files: DataFrame | None = None, width: int = 4, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens): the number of ids of each document of the flat files under path, without separators.

    files: a table of file names to read (column file), None: all.  Ids after a file's
    last separator are a document that isn't ended; it is counted as the last one.
    Empty files have no documents, two separators in a row an empty one.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", (F.col("length") / width).cast("long").alias("n"))
    listed = listed.withColumn("file", F.element_at(F.split("path", "/"), -1))
    if files is not None:
        listed = listed.join(files.select("file").distinct(), "file", "left_semi")
    blocks = listed.where("n > 0").select("file", "path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block_tokens).cast("long"))).alias("start"))
    blocks = blocks.repartition("file", "start")
    kind = "<u4" if width == 4 else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                store, at = _open(b["path"])
                with store.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(min(block_tokens, b["n"] - b["start"]) * width, b["start"] * width), kind)
                ends = np.flatnonzero(ids == end).astype(np.int64) + b["start"]
                yield pa.RecordBatch.from_arrays([pa.array([b["file"]]), pa.array([b["start"]], pa.int64()), pa.array([b["n"]], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "start", "n", "ends"])

    seen = blocks.select("file", "path", "n", "start").mapInArrow(run, "file string, start long, n long, ends array<long>")
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    final = F.col("start") + block_tokens >= F.col("n")
    stitched = seen.withColumn("prior", F.coalesce(F.max(last).over(before), F.lit(-1).cast("long"))).withColumn("done", F.coalesce(F.sum(F.size("ends").cast("long")).over(before), F.lit(0).cast("long")))
    open_end = F.when(final & (F.coalesce(last, F.col("prior")) < F.col("n") - 1), F.array("n")).otherwise(F.array().cast("array<long>"))
    stops = stitched.select("file", "done", F.concat(F.array("prior"), "ends", open_end).alias("stops"))
    lengths = F.transform(F.slice("stops", F.lit(2), F.size("stops") - 1), lambda stop, k: stop - F.get("stops", k) - 1)
    each = stops.select("file", "done", lengths.alias("lengths")).select("file", "done", F.posexplode("lengths").alias("k", "n_tokens"))
    return each.select("file", (F.col("done") + F.col("k")).alias("ordinal"), "n_tokens")


def document_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id_col, n_tokens), one row per document row, by way of flat token files in the shared folder.

    Null and empty texts have 0 tokens; ids of any type are returned as they are, null too; repeated rows are each returned;
    an empty table gives an empty one.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    manifest = write_token_files(docs, path, vocabulary, id_col, text_col)
    counts = count_tokens(spark, path, encoder(vocabulary)[1], manifest, width(vocabulary), block_tokens)
    # a manifest is many rows that compress well: its size on disk mustn't make it a broadcast
    return manifest.hint("merge").join(counts, ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")
