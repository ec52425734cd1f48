"""Exact duplicates by Patricia tries whose terminal nodes hold the owner of a text.

Texts go to partitions by length and content hash, and in each partition full byte
strings are inserted into one compressed radix trie.  Before the shuffle every task
inserts what it reads into a trie of its own, so that a text with a million copies
crosses the network once a task; when that trie outgrows its bound, its largest subtree is
spilled, which here means handed on to the shuffle as partial owners.  After the shuffle a
partition's texts come in byte order: once a text leaves a prefix, the subtree below that prefix is complete and
is handed on and freed, so that a trie of any number of texts is as small as its open branch.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_of

TRIE_BYTES = 48 << 20


#: What a node costs besides its edge.
NODE = 200


class Node:
    """edge: the bytes that lead here; size: bytes of all edges from this node down, its own too, and NODE for each node."""

    __slots__ = ("edge", "kids", "owner", "count", "size")

    def __init__(self, edge: bytes) -> None:
        self.edge, self.kids, self.owner, self.count, self.size = edge, {}, None, 0, len(edge) + NODE


class RadixTrie:
    """Byte strings with an owner (an id, None if all are null) and a count; keep is max or min."""

    def __init__(self, keep=max) -> None:
        self.root, self.keep = Node(b""), keep

    @property
    def size(self) -> int:
        return self.root.size - NODE

    def insert(self, key: bytes, owner: int | None, count: int = 1, done: list | None = None) -> None:
        """Add a key.  done, for keys in byte order: gets (key, owner, count) of the subtrees that no later key can reach, which are freed."""
        node, at, above = self.root, 0, [self.root]
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                if done is not None:
                    self._free(node, key[:at], above, done)
                kid = node.kids[key[at]] = Node(key[at:])
                for n in above:
                    n.size += kid.size
            elif not key.startswith(kid.edge, at):
                n = len(commonprefix([kid.edge, key[at : at + len(kid.edge)]]))
                upper = node.kids[key[at]] = Node(kid.edge[:n])
                kid.edge = kid.edge[n:]
                kid.size -= n
                upper.kids[kid.edge[0]] = kid
                upper.size += kid.size
                for a in above:
                    a.size += NODE
                kid = upper
            node, at = kid, at + len(kid.edge)
            above.append(node)
        node.owner = owner if node.owner is None else node.owner if owner is None else self.keep(node.owner, owner)
        node.count += count

    def _free(self, node: Node, key: bytes, above: list[Node], done: list) -> None:
        gone = sum(kid.size for kid in node.kids.values())
        for kid in node.kids.values():
            done.extend(self._walk(kid, key + kid.edge))
        node.kids = {}
        for n in above:
            n.size -= gone

    @staticmethod
    def _walk(node: Node, key: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        left = [(node, key)]
        while left:
            node, key = left.pop()
            if node.count:
                yield key, node.owner, node.count
            left += [(kid, key + kid.edge) for kid in node.kids.values()]

    def drain(self) -> Iterator[tuple[bytes, int | None, int]]:
        """All (key, owner, count); the trie is empty afterwards."""
        root, self.root = self.root, Node(b"")
        yield from self._walk(root, b"")

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """The largest subtree below the root, taken out."""
        kid = self.root.kids.pop(max(self.root.kids, key=lambda b: self.root.kids[b].size))
        self.root.size -= kid.size
        yield from self._walk(kid, kid.edge)


def _pack(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 256) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[0]) if isinstance(row[0], bytes) else 100
        if len(part) >= most * 16 or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)


def owners(texts: DataFrame, keep: str = "min", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(n_bytes, text_sha256, owner, group_size) of (id, text), one row per distinct text."""
    best = {"min": min, "max": max}[keep]

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie = RadixTrie(best)
            for batch in batches:
                for i, t in zip(batch.column(0), batch.column(1), strict=True):
                    trie.insert(t.as_py(), i.as_py())
                    if trie.size > trie_bytes:
                        yield from trie.spill()
            yield from trie.drain()

        yield from _pack(rows(), ["text", "owner", "n"], [pa.binary(), pa.int64(), pa.int64()])

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie, done = RadixTrie(best), []
            for batch in batches:
                for text, owner, n in zip(*(batch.column(k) for k in range(3)), strict=True):
                    trie.insert(text.as_py(), owner.as_py(), n.as_py(), done)
                    if done:
                        yield from done
                        done.clear()
            yield from trie.drain()

        yield from _pack(rows(), ["text", "owner", "group_size"], [pa.binary(), pa.int64(), pa.int64()])

    first = texts.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(early, "text binary, owner long, n long")
    # the hash chooses the partition only; in it texts go by their bytes, so that equal ones meet in one trie whatever their hash
    dealt = first.repartition(F.octet_length("text"), F.xxhash64("text")).sortWithinPartitions("text")
    whole = dealt.mapInArrow(late, "text binary, owner long, group_size long")
    return whole.select(F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "owner", "group_size")


def exact_duplicates(docs: DataFrame, keep: str = "min", normalise=None, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256), one row per document row.

    Texts are equal when their bytes are, after normalise (a function of a column, None: no
    change).  keep: "min" or "max", which id of equal texts stays.  Null texts count as
    empty.  A null id never stays while another id is there; a group of null ids only has a null
    keep_id and keeps all its rows.  Rows that repeat id and text are all kept or all
    dropped, and each counts in group_size.  An empty table gives an empty one.
    """
    text = text_of(text_col) if normalise is None else normalise(text_of(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    mine = rows.select("id", F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))
    # settled, so that the join has a shuffle of its own, in which Spark can split the rows of a text with very many copies
    found = mine.join(settle(owners(rows, keep, trie_bytes), "owners"), ["n_bytes", "text_sha256"])
    return found.select(F.col("id").alias(id_col), F.col("owner").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("owner")).alias("kept"), "text_sha256")
