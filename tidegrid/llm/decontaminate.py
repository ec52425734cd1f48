"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces: where the item
occurs with at most k edits, at least one piece occurs unchanged.  The first characters of
all pieces of a block of items are looked up in all windows of a batch of texts at once, by a
rolling hash in numpy; the items are then verified around their hits with Myers'
bit-parallel edit distance, many windows at a time.

Texts are compared by their words: letters and digits, lower-cased, one space between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import settle

TOKEN = re.compile(r"[^\W_]+")
#: Characters of an item for each piece: the budget is len // PIECE - 1 edits. Shorter items are one piece, and must occur as whole words.
PIECE = 12
#: Normalised characters of items that a task holds at a time; larger benchmarks are matched in blocks.
BLOCK_CHARS = 16_000_000
#: Characters of texts that are matched at a time, and windows that are verified at a time.
BATCH_CHARS, WINDOWS = 1_000_000, 2048
_BASE, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)


def normalise(text: str) -> str:
    return " ".join(TOKEN.findall(text.lower()))


def budget(length: int, piece: int = PIECE) -> int:
    return max(0, length // piece - 1)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hashes(chars: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every window of so many code points, put together from windows of powers of two."""
    n = len(chars) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size = (chars.astype(np.uint64) + np.uint64(1)) * _SPREAD, 1
    out, done = None, 0
    while True:
        if length & size:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(_BASE, size, 1 << 64)) + part
            done += size
        if done == length:
            return out
        power = power[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size:]
        size *= 2


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence of pattern in text, the first of equals; None above most."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score, best = full, 0, m, None
    for end, c in enumerate(text, 1):
        eq = places.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = down | ~(across | up) & full
        minus = up & across
        score += bool(plus & top) - bool(minus & top)
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | ~(vertical | plus) & full
        down = plus & vertical
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
    return best


def least_distances(patterns: Sequence[np.ndarray], which: np.ndarray, flat: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The distance of the best approximate occurrence of a pattern of at most 64 characters in each window low to high of flat.

    The same steps as myers(), for all windows together, one character a step.
    """
    used = np.unique(which)
    rows, size = np.searchsorted(used, which), np.array([len(patterns[p]) for p in used])
    letters = np.unique(np.concatenate([patterns[p] for p in used]))
    masks = np.zeros((len(used), len(letters) + 1), np.uint64)  # the last letter stands for all that no pattern has
    for i, p in enumerate(used):
        np.bitwise_or.at(masks[i], np.searchsorted(letters, patterns[p]), np.uint64(1) << np.arange(size[i], dtype=np.uint64))
    top, one, other = (size[rows] - 1).astype(np.uint64), np.uint64(1), len(letters)
    up, down = np.full(len(which), np.iinfo(np.uint64).max), np.zeros(len(which), np.uint64)
    score = size[rows].astype(np.int64)
    best = score.copy()
    for j in range(int((high - low).max(initial=0))):
        char = flat[np.minimum(low + j, len(flat) - 1)]
        place = np.minimum(np.searchsorted(letters, char), other - 1)
        eq = masks[rows, np.where((letters[place] == char) & (low + j < high), place, other)]
        vertical = eq | down
        across = ((eq & up) + up) ^ up | eq
        plus, minus = down | ~(across | up), up & across
        score += (plus >> top & one).astype(np.int64) - (minus >> top & one).astype(np.int64)
        plus, minus = plus << one, minus << one
        up, down = minus | ~(vertical | plus), plus & vertical
        np.minimum(best, score, out=best)
    return best


@dataclass
class Matcher:
    """items: (item id, normalised text); empty texts match nothing."""

    items: list[tuple[int, str]]
    piece: int = PIECE

    def __post_init__(self) -> None:
        self.items = [x for x in self.items if x[1]]
        self.patterns = [codes(t) for _, t in self.items]
        self.lengths = np.array([len(p) for p in self.patterns], np.int64)
        self.budgets = np.maximum(0, self.lengths // self.piece - 1)
        self.heads, self.tails = [p[:64] for p in self.patterns], [p[-64:] for p in self.patterns]
        probes: dict[int, list[tuple[int, int]]] = {}
        for n, (size, k) in enumerate(zip(self.lengths.tolist(), self.budgets.tolist(), strict=True)):
            for j in range(k + 1):
                probes.setdefault(min(size, self.piece), []).append((n, size * j // (k + 1)))
        #: probe length -> (hashes in order, their items, their offsets, a table of the hashes' high bits)
        self.probes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, where in probes.items():
            item, offset = np.array(where, np.int64).T
            h = np.array([window_hashes(self.patterns[n][a : a + size], size)[0] for n, a in where], np.uint64)
            order = np.lexsort((offset, item, h))
            seen = np.zeros(1 << 20, bool)
            seen[(h * _SPREAD) >> np.uint64(44)] = True
            self.probes[size] = (h[order], item[order], offset[order], seen)

    def _candidates(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, starts in flat) where an item would begin if a piece that was found is in its place; each once."""
        items, starts = [], []
        for size, (keys, item, offset, seen) in self.probes.items():
            h = window_hashes(flat, size)
            at = np.flatnonzero(seen[(h * _SPREAD) >> np.uint64(44)])
            low = np.searchsorted(keys, h[at])
            n = np.searchsorted(keys, h[at], "right") - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            if len(at):
                row = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                items.append(item[row])
                starts.append(np.repeat(at, n) - offset[row])
        if not items:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.stack([np.concatenate(items), np.concatenate(starts)]), axis=1)
        return both[0], both[1]

    def _windows(self, item: np.ndarray, start: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(items, first and last starts, texts) of the candidates, those of an item that lie within half its length of each other together."""
        cell = start // np.maximum(1, self.lengths[item] // 2)
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (cell[1:] != cell[:-1]) | (text[1:] != text[:-1])
        first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True)[: len(new)])
        return item[first], start[first], start[last], text[first]

    def matches(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text, (item id, distance, start, end) of the best occurrence of each item, in its code points."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        flats = [normalise(t or "") for t in texts]
        at = 0
        while at < len(flats) and self.items:
            n, size = 0, 0
            while at + n < len(flats) and (n == 0 or size + len(flats[at + n]) < BATCH_CHARS):
                size += len(flats[at + n]) + 1
                n += 1
            last, spots = None, None
            for i, item, distance, end in self._best(flats[at : at + n]):
                if i != last:  # a text's words are placed once, however many items it holds
                    last, spots = i, _spots(texts[at + i], flats[at + i])
                out[at + i].append((self.items[item][0], distance, *self._place(*spots, flats[at + i], item, distance, end)))
            at += n
        return out

    def _best(self, flats: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, distance, end) by text and item."""
        flat = codes("\n".join(flats))  # no piece has a line end, so none is found across two texts
        first = np.cumsum([0, *(len(f) + 1 for f in flats)])
        item, start = self._candidates(flat)
        # an occurrence within a budget has the item's middle in its text
        text = np.clip(np.searchsorted(first, start + self.lengths[item] // 2, "right") - 1, 0, len(flats) - 1)
        item, first_start, last_start, text = self._windows(item, start, text)
        k = self.budgets[item]
        low, high = np.maximum(first_start - k, first[text]), np.minimum(last_start + self.lengths[item] + k, first[text + 1] - 1)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for o in self._near(flat, item, first_start, last_start, low, high).tolist():
            n, t, a, b = int(item[o]), int(text[o]), int(low[o] - first[text[o]]), int(high[o] - first[text[o]])
            hit = myers(self.items[n][1], flats[t][a:b], int(k[o])) if k[o] else self._whole(flats[t], self.items[n][1], a, b)
            if hit:
                found[t, n] = min(found.get((t, n), (hit[0], a + hit[1])), (hit[0], a + hit[1]))
        for (t, n), (d, end) in sorted(found.items()):
            yield t, n, d, end

    def _near(self, flat: np.ndarray, item: np.ndarray, first_start: np.ndarray, last_start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The windows in which the item's head and tail each occur within its budget, as they do where all of it does.

        Many items may share a piece, as questions made from one template do; this is what most of their windows fail.
        """
        k, m, left = self.budgets[item], self.lengths[item], np.flatnonzero(high > low)
        for parts, at in ((self.heads, np.zeros_like(m)), (self.tails, np.maximum(0, m - 64))):
            kept = []
            for lo in range(0, len(left), WINDOWS):
                w = left[lo : lo + WINDOWS]
                a, b = np.maximum(low[w], first_start[w] + at[w] - k[w]), np.minimum(high[w], last_start[w] + np.minimum(at[w] + 64, m[w]) + k[w])
                kept.append(w[least_distances(parts, item[w], flat, a, b) <= k[w]])
            left = np.concatenate(kept) if kept else left
        return left

    @staticmethod
    def _whole(flat: str, pattern: str, low: int, high: int) -> tuple[int, int] | None:
        """(0, end from low on) of pattern's first occurrence as whole words that starts and ends in this window."""
        at = flat.find(pattern, low, high)
        while at >= 0:
            end = at + len(pattern)
            if (at == 0 or flat[at - 1] == " ") and (end == len(flat) or flat[end] == " "):
                return 0, end - low
            at = flat.find(pattern, at + 1, high)
        return None

    def _place(self, spaces: np.ndarray, words: list[tuple[int, int]], flat: str, n: int, distance: int, end: int) -> tuple[int, int]:
        """Where the words of the text lie that make up the occurrence which ends at end of flat."""
        pattern = self.items[n][1]
        low = max(0, end - len(pattern) - distance)
        _, length = myers(pattern[::-1], flat[low:end][::-1], distance)
        first, last = np.searchsorted(spaces, [end - length, end]).tolist()
        last = min(last, len(words) - 1)
        return words[min(first, last)][0], words[last][1]


def _spots(text: str, flat: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Where flat has its spaces, and where text has its words."""
    low_case = text.lower()
    return np.flatnonzero(codes(flat) == 32), [m.span() for m in TOKEN.finditer(low_case if len(low_case) == len(text) else text)]


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, piece: int = PIECE) -> tuple[int, Iterator[Matcher]]:
    """The number of blocks, and their matchers, each made when it is asked for: the driver holds one block of about block_chars characters."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1

    def made() -> Iterator[Matcher]:
        for k in range(n):
            block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
            yield Matcher([(r["id"], normalise(r["text"])) for r in block.sort("id", "text").toLocalIterator()], piece)

    return n, made()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS, piece: int = PIECE) -> DataFrame:
    """(id_col, item_id, distance, start, end): the best occurrence of each item in each document that holds it within its budget.

    Items of fewer than two pieces have no budget and must occur whole, at word ends.
    Null and empty texts hold nothing; null items and items without letters and digits match nothing; ids of any type
    are returned as they are, null too; repeated rows are matched each; items that repeat an id are
    matched each.  No documents or no items give an empty table.  Of several blocks of items
    each one's rows are written before the next is made.
    """
    n, blocks = item_blocks(items, item_id_col, item_text_col, block_chars, piece)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("item_id", items.schema[item_id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("distance", "start", "end"))])
    out = None
    for matcher in blocks:
        found = rows.mapInArrow(_found(matcher, to_arrow_type(made["item_id"].dataType)), made)
        found = found if n == 1 else settle(found, "contaminated")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def _found(matcher: Matcher, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [(k, *m) for k, found in enumerate(matcher.matches(batch.column(1).to_pylist())) for m in found]
            at, items, *places = zip(*each, strict=True) if each else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(items, item_type), *(pa.array(p, pa.int64()) for p in places)], ["id", "item_id", "distance", "start", "end"])

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS, piece: int = PIECE) -> DataFrame:
    """docs without the rows that hold an item; all columns stay, whatever their names.

    Null and empty texts hold nothing and stay, ids play no part (null, repeated), equal rows stay or go together, and no
    documents give none. Null items match nothing.

    The last block of items is a filter on docs; what earlier blocks find is written as digests of texts, by which rows are left out.
    """
    n, blocks = item_blocks(items, item_id_col, item_text_col, block_chars, piece)
    kept, digest = docs, F.sha2(F.col(text_col), 256)
    for k, matcher in enumerate(blocks, 1):
        clean = _clean(matcher)(F.col(text_col))
        if k == n:
            return kept.where(clean)
        gone = settle(docs.where(~clean).select(digest.alias("tg_digest")).distinct(), "contaminated")
        kept = kept.join(gone, digest == F.col("tg_digest"), "left_anti")


def _clean(matcher: Matcher):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not found for found in matcher.matches(list(texts))], dtype=bool)

    return F.pandas_udf(run, "boolean").asNondeterministic()
