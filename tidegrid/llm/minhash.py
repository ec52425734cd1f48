"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch throws every element of a set into one of ``size`` bins, round after
round with fresh hashes, and a bin keeps the least value of the first round that
reaches it; from round ``size`` on, round i goes to bin i - size alone, so that every
bin is filled after 2 * size rounds at the latest.  A long set is done after a round or
two, where plain MinHash needs ``size`` passes, and coordinates agree with a
probability of the Jaccard similarity, concentrated as with independent ones.

Bands of coordinates give bucket keys.  Within a bucket no list of all pairs is made:
members are first tied to the hub of their bucket and the ties are checked on the full
sets.  Buckets whose members are then in one component are done.  Members of the other buckets meet
by prefix filtering: with the shingles of each set ordered from rare to frequent, two sets of a similarity
of 0.8 share one among the first few, how few depends on their sizes.  Shingles that only one component has can't
link two and count as the rarest, so a family of texts around one template meets in none of its
common shingles.  All links are thus found whose ends share a
bucket: with 48 bands of 6 a pair of similarity 0.8 is missed with a probability of 5e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, settle, text_of
from .components import components

BANDS, ROWS = 48, 6
#: Sizes of sets within this ratio are one class when prefixes are matched.
SIZE_RATIO = 1.02
#: Words whose hashes a worker keeps.
KNOWN_WORDS = 150_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S32, _LOW = np.uint64(33), np.uint64(32), np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


class _Words(dict):
    """word -> 64-bit hash; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    A-Z are lower-cased; words end at ASCII white space only.  Fewer words than a
    shingle has: one shingle of all of them.  No words: an empty array.
    """
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
    size = min(words, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n])
    return np.unique(h)


def sketch(hashes: np.ndarray, size: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes.

    A coordinate is the round that reached its bin and the hash with which it did; the least of
    these is the first round's, so several rounds may be thrown together.
    """
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    low, throws = 0, 7 * size
    while low < size and out.max() > np.uint64(2 * size << 32):
        high = min(size, low + max(1, throws // len(hashes)))
        rounds = np.arange(low, high, dtype=np.uint64)
        x = _mix(hashes + (rounds * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))[:, None])
        np.minimum.at(out, ((x >> _S32) * np.uint64(size) >> _S32).astype(np.intp).ravel(), (x & _LOW | rounds[:, None] << _S32).ravel())
        low, throws = high, 2 * size
    for i in np.flatnonzero(out > np.uint64(2 * size << 32)).tolist():
        x = _mix(hashes + np.uint64(((size + i) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
        out[i] = (x & _LOW).min() | np.uint64(size + i << 32)
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of what is hashed."""
    c = coordinates.reshape(bands, rows)
    h = _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for j in range(rows):
        h = _mix(h * np.uint64(31) + c[:, j])
    return h.view(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str, repeated: DataFrame) -> DataFrame:
    """(id, node, again, text): node is the id, or a hash of id and text if the id is one of several rows'."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(repeated, "id", "left")
    again = F.coalesce("again", F.lit(False))
    return rows.select("id", F.when(again, F.xxhash64("id", "text")).otherwise(F.col("id")).alias("node"), again.alias("again"), "text")


def sketches(rows: DataFrame, words: int, bands: int = BANDS, size: int = ROWS) -> DataFrame:
    """(id, node, again, n_shingles, set_key, keys) of _rows().

    set_key is a 128-bit digest of the whole set, null for an empty one; keys are its band keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, names, keys = [], [], []
                for text in part.column(3):
                    h = shingle_hashes(text.as_py(), words)
                    n.append(len(h))
                    names.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                    keys.append(band_keys(sketch(h, bands * size), bands, size) if len(h) else np.empty(0, np.int64))
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.ListArray.from_arrays(ends, np.concatenate(keys))], ["id", "node", "again", "n_shingles", "set_key", "keys"])

    return rows.mapInArrow(run, "id long, node long, again boolean, n_shingles long, set_key binary, keys array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingle_hashes(t.as_py(), words).view(np.int64) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, np.concatenate(sets))], ["node", "hashes"])

    return docs.select("node", "text").mapInArrow(run, "node long, hashes array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("ha") + F.size("hb") - both)).select("a", "b")


def _close_in_size(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    """Shingles that sets of n and m shingles must share."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_RATIO)) + 1e-9).cast("int")


def _least_of_class(k: Column) -> Column:
    """A size that no set of the class is below."""
    return F.floor(F.pow(F.lit(SIZE_RATIO), k.cast("double")) - 1e-6)


def _across(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of members (rep, n, label) with different labels that may be similar enough; none that is, is missed.

    Prefix filtering.  Sets of n <= m shingles must share t of them (_least_overlap), and in any one order of all shingles the first
    that they share is among the first n - t + 1 of the one and the first m - t + 1 of the other.  The order
    is: shingles of one label only, then by the number of sets that have them.  The former can't be shared across
    labels; so a set whose prefix has no others is out, and only the rest is joined, on shingle and size classes.
    In a shingle's group the members of its most frequent label meet the others, never each other.
    """
    words = scratch.settle(members.join(sets.withColumnRenamed("node", "rep"), "rep").select("rep", "n", "label", F.explode("hashes").alias("h")), "words")
    several = scratch.settle(words.groupBy("h").agg(F.count("*").alias("df"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("h", "df"), "several")
    mixed = words.join(several, "h")
    own = mixed.groupBy("rep").agg(F.count("*").alias("mixed"))
    place = F.row_number().over(W.partitionBy("rep").orderBy("df", "h"))
    longest = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1  # of a prefix, with whatever partner
    told = mixed.join(own, "rep").where(F.col("n") - F.col("mixed") < longest)
    told = told.withColumn("at", F.col("n") - F.col("mixed") + place).where(F.col("at") <= longest)
    told = scratch.settle(told.select("h", "rep", "n", "label", "at", _size_class(F.col("n")).alias("k")), "prefixes")
    often = told.groupBy("h", "label").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("h", "main")
    told = told.join(often, "h").withColumn("stray", F.col("label") != F.col("main"))
    n = F.col("n")
    # as the smaller of a pair: n - t + 1 with partners of each class from n up; as the larger, with those down to percent of n
    up = F.explode(F.sequence(F.col("k"), _size_class(F.floor(n * 100 / F.lit(percent)))))
    small = told.withColumn("k2", up).where(F.col("at") <= n - _least_overlap(n, F.greatest(n, _least_of_class(F.col("k2"))), percent) + 1)
    down = F.explode(F.sequence(_size_class(F.greatest(F.ceil(n * percent / F.lit(100)), F.lit(1))), F.col("k")))
    least = F.ceil(n * percent / F.lit(100))
    large = told.withColumn("k1", down).where(F.col("at") <= n - _least_overlap(n, F.greatest(least, _least_of_class(F.col("k1"))), percent) + 1)
    x = small.select("h", F.col("k").alias("k1"), "k2", "rep", "n", "label", "at", "stray")
    y = large.select("h", "k1", F.col("k").alias("k2"), *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "label", "at", "stray")])
    met = [x.where("stray").join(y, ["h", "k1", "k2"]), x.where("not stray").join(y.where("stray2"), ["h", "k1", "k2"])]
    # after their first common shingle two sets can't share more than either has left; the classes' bounds are looser than this pair's
    enough = F.least(n - F.col("at"), F.col("n2") - F.col("at2")) + 1 >= _least_overlap(n, F.col("n2"), percent)
    fits = (F.col("label") != F.col("label2")) & (n <= F.col("n2")) & _close_in_size(n, F.col("n2"), percent) & enough
    pairs = [p.where(fits).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")) for p in met]
    return pairs[0].unionByName(pairs[1]).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row per document row.

    Two documents are linked if 100 * |A n B| >= percent * |A u B| for their sets of
    word shingles; component_id is the least id reachable over links, kept marks
    the document with that id.  Empty or null texts have 0 shingles and are linked with
    nothing.  A null id makes a row of its own: null component, kept true.  Rows that
    repeat an id are one document: they share component and fate, and the
    component holds the links of each of their texts.  An empty table gives an empty one.
    The result is written; what was written on the way to it is removed.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    repeated = scratch.settle(docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("again")), "repeated")
    made = scratch.settle(sketches(_rows(docs, id_col, text_col, repeated), words, bands, rows), "sketches")
    spread = scratch.settle(made.where("set_key is not null and node is not null").groupBy("set_key").agg(F.min("node").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")
    members = spread.select("rep", "n", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.min_by("n", "rep").alias("hub_n")).where("hub < last").select("key", "hub", "hub_n")
    inside = scratch.settle(members.join(scratch.settle(shared, "buckets"), "key"), "members")

    ties = scratch.settle(inside.where(F.col("rep") != F.col("hub")).where(_close_in_size(F.col("n"), F.col("hub_n"), percent)).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "ties")
    texts = _rows(docs, id_col, text_col, repeated).join(inside.select(F.col("rep").alias("node")).distinct(), "node", "left_semi")
    texts = texts.where("not again").unionByName(texts.where("again").dropDuplicates(["node"]))
    sets = scratch.settle(shingle_sets(texts, words), "sets")
    tree = components(_confirm(ties, sets, percent))

    # what the hubs leave: buckets that hold several components
    named = inside.join(tree, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("label"))
    labels = named.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("key")
    still = scratch.settle(named.join(labels, "key", "left_semi").select("rep", "n", "label").distinct(), "open")
    more = scratch.settle(_confirm(scratch.settle(_across(still, sets, percent, scratch), "pairs"), sets, percent), "links")
    label = lambda end: still.select(F.col("rep").alias(end), F.col("label").alias(f"label_{end}"))
    joined = more.join(label("a"), "a").join(label("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))

    first = spread.select("set_key", "rep").join(tree.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("label"))
    first = scratch.settle(first, "labels")
    named = made.select("id", "again", "n_shingles", F.when(F.col("node").isNotNull(), F.col("set_key")).alias("set_key")).join(first, "set_key", "left").withColumn("label", F.coalesce("label", "id"))
    # an id of several rows joins what these belong to
    several = named.where("again").select("id", "label").withColumn("least", F.min("label").over(W.partitionBy("id")))
    joined = joined.unionByName(several.where("label > least").select(F.col("least").alias("a"), F.col("label").alias("b")))
    whole = components(joined).select(F.col("node").alias("label"), F.col("component").alias("whole"))
    named = scratch.settle(named.join(whole, "label", "left").select("id", "again", "n_shingles", F.coalesce("whole", "label").alias("component")), "components")
    # where nodes are hashes, the component's name is its least id
    renamed = named.join(named.where("again").select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("id").alias("least"))
    named = named.join(scratch.settle(renamed, "renamed"), "component", "left").withColumn("component", F.coalesce("least", "component"))
    out = settle(named.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept")), "near_duplicates")
    scratch.clear()
    return out
