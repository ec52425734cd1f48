"""Personal data: fixed patterns, and a linear-chain CRF over word-shape features.

The patterns find well-formed addresses and numbers.  The CRF, trained here from a small
labelled table of word sequences, finds what they miss by its shape and surroundings
("jo at mail dot example dot org", "(555) 010-2030").  A word is known by its signature, its
shape or one of a few cue words, so that a score table over signatures holds all of
the model, and Viterbi decodes batches of lines of about equal length in numpy.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds and their patterns. Possessive quantifiers and look-behind keep long runs linear; what matches is the same.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, NOT_DIGIT = re.compile(r"[0-9]"), re.compile(r"[^0-9]")
RUNS, MARKS = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S), "@.+-()/:_%,;#"
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
CUES = frozenset("at dot phone tel call mobile cell fax mail email e-mail contact write reach ip host address server card visa number account pay".split())


def octets(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in address.split("."))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank, kind, end) of the patterns' matches, leftmost and non-overlapping for each kind."""
    out: list[tuple[int, int, str, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, "email", m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    if DIGIT.search(text):
        out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if octets(m.group())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, "card", m.end()))
        if "+" in text:
            out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


#: Units at either end of a shape that are kept one by one; of what lies between them, only which characters there are.
ENDS = 12


def signature(word: str) -> str:
    """A word's shape: A, a and 9 for runs of letters and digits (digit runs with their length), other characters as they are; a cue word is itself."""
    low = word.strip(".,;:!?\"'").lower()
    if low in CUES:
        return "w:" + low
    shape: list[str] = []
    for m in RUNS.finditer(word):
        run = m.group()
        if run[0].isdigit() and run.isascii():
            shape.append(f"9{min(len(run), 20)}")
        elif run[0].isalpha():
            shape.append(("A" if run[0].isupper() else "") + ("a" if len(run) > 1 or not run[0].isupper() else ""))
        elif run in MARKS:
            shape.append(run)
        elif not shape or shape[-1] != "*":
            shape.append("*")
    if len(shape) > 2 * ENDS:
        between = sorted({u[0] for u in shape[ENDS:-ENDS]})
        shape = [*shape[:ENDS], "~", *between, "~", *shape[-ENDS:]]
    return "".join(shape)


def shape_features(sig: str) -> list[str]:
    """What the CRF sees of a signature."""
    core = sig.strip(".,;:!?*")
    digits = [int(x) for x in re.findall(r"9(\d+)", sig)]
    return [
        "bias", f"sig={core}", f"digits={min(sum(digits), 20)}", f"runs={min(len(digits), 5)}", f"first={core[:1]}",
        f"at={'@' in sig}", f"dots={min(core.count('.'), 4)}", f"plus={sig.startswith('+')}", f"paren={'(' in sig}{')' in sig}",
        f"dash={min(core.count('-'), 3)}", f"letters={'a' in core or 'A' in core}{bool(digits)}", f"cue={sig if sig.startswith('w:') else '-'}",
    ]


def training_table(rows: int = 900, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: invented word sequences, made by rule, with a label for each word."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def prose(n: int) -> list[tuple[str, str]]:
        out = []
        for _ in range(n):
            w = word()
            w = r.choice([w, w, w, w.capitalize(), w + ",", w + ".", w + r.choice("*#%$&|") * 3, num(r.randint(1, 4)), num(4) + ".", f"{num(1)}.{num(2)}", w + num(2), f"{num(2)}%", f"{num(2)}/{num(2)}/{num(4)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"({word()})", w + "-" + word(), r.choice(["at", "dot", "call", "card", "number", "address", "host", "contact"]), num(r.randint(5, 12)), "v" + f"{num(1)}.{num(1)}.{num(1)}", "§" + num(2)] + [w] * 20)
            out.append((w, "O"))
        return out

    def email() -> list[str]:
        kind = r.randint(0, 3)
        if kind == 0:
            return [f"{word()}.{num(2)}@{word()}.{word()}.com"]
        if kind == 1:
            return [word(), "at", word(), "dot", r.choice(["com", "org", "net"])]
        if kind == 2:
            return [word(), "at", word(), "dot", "example", "dot", r.choice(["com", "org"])]
        return [f"{word()}(at){word()}.com"]

    def phone() -> list[str]:
        a, b, c = num(3), num(3), num(4)
        return r.choice([[f"+{num(1)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{num(2)}", num(3), num(4), num(3)], [f"{a}.{b}.{c}"], [f"+{num(11)}"]])

    def ip() -> list[str]:
        return [".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice(["", "", ":" + num(4), "/24"])]

    def card() -> list[str]:
        return r.choice([[num(16)], [num(4), num(4), num(4), num(4)], ["-".join(num(4) for _ in range(4))], [num(4), num(6), num(5)]])

    makers = {"email": email, "phone": phone, "ip": ip, "card": card}
    lead = {"email": ["mail", "email", "write", "contact"], "phone": ["phone", "tel", "call", "mobile"], "ip": ["ip", "host", "server"], "card": ["card", "visa", "pay"]}
    table = []
    for i in range(rows):
        seq = prose(r.randint(0, 9))
        for _ in range(r.randint(0, 2) if i % 3 else 0):
            k = r.choice(KINDS)
            if r.random() < 0.4:
                seq.append((r.choice(lead[k]), "O"))
            found = makers[k]()
            if r.random() < 0.3:
                found[-1] += r.choice(".,;")
            seq += [(w, ("B-" if j == 0 else "I-") + k) for j, w in enumerate(found)]
            seq += prose(r.randint(1, 6))
        if seq:
            table.append(([w for w, _ in seq], [y for _, y in seq]))
    return table


@dataclass
class CRF:
    """Scores of a word's own features, of the words beside it, and of label pairs."""

    own: dict[str, np.ndarray]
    before: dict[str, np.ndarray]
    after: dict[str, np.ndarray]
    moves: np.ndarray
    start: np.ndarray

    def scores(self, sig: str) -> np.ndarray:
        """A signature's scores: its own, those for the word after it, those for the word before it."""
        seen = shape_features(sig)
        return np.stack([sum((table[f] for f in seen if f in table), np.zeros(len(LABELS), np.float32)) for table in (self.own, self.before, self.after)])

    def most_gain(self) -> float:
        """The most that label pairs can give to a stretch of labels other than O, for each of its words."""
        o, moves = self.moves[0, 0], self.moves
        ends = max(moves[0, 1:].max(), (self.start[1:] - self.start[0]).max() + o) + max(moves[1:, 0].max(), o)
        return float(max(ends - 2 * o, moves[1:, 1:].max() - o, 0))

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best label sequences (n, t) of padded scores (n, t, labels); lengths are at least 1."""
        n, t, k = scores.shape
        back = np.zeros((t, n, k), np.int8)
        best = scores[:, 0] + self.start
        final = np.empty((n, k), np.float32)
        final[lengths == 1] = best[lengths == 1]
        for i in range(1, t):
            paths = best[:, :, None] + self.moves
            back[i] = paths.argmax(1)
            best = paths.max(1) + scores[:, i]
            over = lengths == i + 1
            final[over] = best[over]
        out = np.zeros((n, t), np.int8)
        now, each = final.argmax(1), np.arange(n)
        for i in range(t - 1, -1, -1):
            inside = i < lengths
            out[inside, i] = now[inside]
            if i:
                now = np.where(inside, back[i, each, now], now)
        return out


def train(table: list[tuple[list[str], list[str]]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-4) -> CRF:
    """Maximum likelihood by AdaGrad; scaled forward and backward sums over all sequences at once."""
    sigs: dict[str, int] = {}
    seqs = [[sigs.setdefault(signature(w), len(sigs)) for w in words] for words, _ in table]
    names = sorted({f for s in sigs for f in shape_features(s)})
    at = {f: i for i, f in enumerate(names)}
    has = np.zeros((len(sigs) + 1, len(names)))  # the last row, without features, stands beside the ends
    for s, i in sigs.items():
        has[i, [at[f] for f in shape_features(s)]] = 1
    n, t, k = len(table), max(map(len, seqs)), len(LABELS)
    lengths = np.array([len(s) for s in seqs])
    mask = np.arange(t) < lengths[:, None]
    ids, y = np.full((n, t), len(sigs)), np.zeros((n, t), int)
    for i, (_, labels) in enumerate(table):
        ids[i, : len(labels)] = seqs[i]
        y[i, : len(labels)] = [LABELS.index(x) for x in labels]
    beside = np.full((n, t), len(sigs))
    before, after = beside.copy(), beside
    before[:, 1:], after[:, :-1] = ids[:, :-1], ids[:, 1:]
    sides = [ids, before, after]
    w, moves, start = np.zeros((3, len(names), k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(x, 1e-2) for x in (w, moves, start)]
    gold = np.eye(k)[y] * mask[..., None]
    gold_moves = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    for _ in range(rounds):
        scores = sum((has @ w[s])[sides[s]] for s in range(3))
        e, m = np.exp(scores - scores.max(2, keepdims=True)), np.exp(moves)
        fore, rear, scale = np.empty((t, n, k)), np.ones((t, n, k)), np.ones((t, n, 1))
        for i in range(t):
            new = (fore[i - 1] @ m if i else np.exp(start)) * e[:, i]
            scale[i] = np.where(mask[:, i, None], new.sum(1, keepdims=True), 1)
            fore[i] = np.where(mask[:, i, None], new / scale[i], fore[i - 1] if i else 0)
        pairs = np.zeros((k, k))
        for i in range(t - 1, 0, -1):
            ahead = np.where(mask[:, i, None], e[:, i] * rear[i] / scale[i], 0)
            pairs += m * (fore[i - 1].T @ ahead)
            rear[i - 1] = np.where(mask[:, i, None], ahead @ m.T, 1)
        miss = ((fore * rear).transpose(1, 0, 2) * mask[..., None] - gold).reshape(n * t, k)
        each = lambda ids, miss=miss: np.stack([np.bincount(ids.ravel(), miss[:, j], len(sigs) + 1) for j in range(k)], 1)
        g = np.stack([has.T @ each(s) for s in sides])
        for x, d, s in zip((w, moves, start), (g / n + decay * w, (pairs - gold_moves) / n, miss.reshape(n, t, k)[:, 0].sum(0) / n), sums, strict=True):
            s += d * d
            x -= rate * d / np.sqrt(s)
    for a, x in enumerate(LABELS):  # I- follows B- or I- of its kind only
        for b, z in enumerate(LABELS):
            if z[0] == "I" and x[2:] != z[2:]:
                moves[a, b] = -1e4
        start[a] += -1e4 if x[0] == "I" else 0
    tables = [{f: w[s, i].astype(np.float32) for f, i in at.items()} for s in range(3)]
    return CRF(*tables, moves.astype(np.float32), start.astype(np.float32))


@cache
def default_model() -> CRF:
    return train(training_table())


SPOKEN = re.compile(r"[\w.%+-]+\s?(?:@|\(at\)|\[at\]|\sat\s)\s?[\w-]+(?:(?:\.|\s?\(dot\)\s?|\sdot\s)[\w-]+)+", re.I)


def plausible(kind: str, found: str) -> bool:
    """An added span counts only if it could be of its kind."""
    digits = len(NOT_DIGIT.sub("", found))
    if kind == "email":
        return bool(SPOKEN.fullmatch(found))
    if kind == "ip":
        m = IP.search(found)
        return bool(m) and octets(m.group())
    if kind == "card":
        return 14 <= digits <= 19 and luhn(NOT_DIGIT.sub("", found))
    return 10 <= digits <= 15 and bool(re.search(r"[-.() +]", found.strip("+")))


class Words(dict):
    """word -> place of its signature's scores in table, which grows as signatures come."""

    def __init__(self, model: CRF, most_words: int = 300_000, most_signatures: int = 50_000) -> None:
        super().__init__()
        self.model, self.most, self.places = model, (most_words, most_signatures), {}
        self.table = np.empty((1024, 3, len(LABELS)), np.float32)

    def __missing__(self, word: str) -> int:
        sig = signature(word)
        k = self.places.get(sig)
        if k is None:
            k = self.places[sig] = len(self.places)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[k] = self.model.scores(sig)
        self[word] = k
        return k

    def trim(self) -> None:
        """Forget everything if it has grown large; places given before are void then."""
        if len(self) > self.most[0] or len(self.places) > self.most[1]:
            self.clear()
            self.places = {}
            self.table = self.table[:1024].copy()


def added_spans(texts: list[str], model: CRF, words: Words | None = None, lines_at_once: int = 512) -> list[list[tuple[int, int, str, int]]]:
    """(start, rank, kind, end) for each text of what the CRF finds; ranks go on after the patterns'."""
    words = Words(model) if words is None else words
    words.trim()
    seqs = [(i, j, list(map(words.__getitem__, line.split()))) for i, text in enumerate(texts) for j, line in enumerate(text.split("\n"))]
    seqs = [s for s in seqs if s[2]]
    if not seqs:
        return [[] for _ in texts]
    table = words.table[: len(words.places)]
    lead = (table[:, :, :1] - table[:, :, 1:]).min(2)
    flat = np.fromiter((x for s in seqs for x in s[2]), np.int64)
    first = np.cumsum([0, *(len(s[2]) for s in seqs)])[:-1]
    left, right = np.roll(lead[flat, 1], 1), np.roll(lead[flat, 2], -1)
    left[first], right[first - 1] = 0, 0
    # where O leads at each word by more than label pairs can make up for, O throughout is the best sequence: Viterbi is run on the other lines
    sure = np.minimum.reduceat(lead[flat, 0] + left + right, first) > model.most_gain()
    seqs = sorted((s for s, known in zip(seqs, sure, strict=True) if not known), key=lambda s: len(s[2]))
    hits: dict[int, list[tuple[int, np.ndarray]]] = {}
    for at in range(0, len(seqs), lines_at_once):
        part = seqs[at : at + lines_at_once]
        lengths = np.array([len(s[2]) for s in part])
        step = max(1, min(len(part), 600_000 // int(lengths.max())))
        for lo in range(0, len(part), step):
            some, n = part[lo : lo + step], lengths[lo : lo + step]
            ids = np.zeros((len(some), n.max()), np.int64)
            for i, s in enumerate(some):
                ids[i, : n[i]] = s[2]
            inside = (np.arange(n.max()) < n[:, None])[..., None]
            scores = table[ids, 0]
            scores[:, 1:] += table[ids[:, :-1], 1]
            scores[:, :-1] += table[ids[:, 1:], 2] * inside[:, 1:]
            labels = model.decode(scores, n)
            for i in np.flatnonzero(labels.any(1)):
                hits.setdefault(some[i][0], []).append((some[i][1], labels[i, : n[i]]))
    out: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
    for i, found in hits.items():
        starts = np.cumsum([0, *(len(x) + 1 for x in texts[i].split("\n"))])
        for j, labels in sorted(found, key=lambda x: x[0]):
            line = texts[i][starts[j] : starts[j + 1] - 1]
            spots = [m.span() for m in re.finditer(r"\S+", line)]
            k = 0
            while k < len(labels):
                if LABELS[labels[k]][0] != "B":
                    k += 1
                    continue
                kind, first = LABELS[labels[k]][2:], k
                k += 1
                while k < len(labels) and LABELS[labels[k]] == f"I-{kind}":
                    k += 1
                raw = line[spots[first][0] : spots[k - 1][1]]
                cut = raw.rstrip(".,;:!?*%#&$|\"'")
                if plausible(kind, cut):
                    a = int(starts[j]) + spots[first][0]
                    out[i].append((a, len(KINDS) + KINDS.index(kind), f"crf_{kind}", a + len(cut)))
    return out


def all_spans(texts: list[str], model: CRF, words: Words | None = None) -> list[tuple[list, list]]:
    """(base spans, base and added spans) of each text; an added span that overlaps a base one is left out."""
    done = []
    for text, more in zip(texts, added_spans(texts, model, words), strict=True):
        base = base_spans(text)
        starts, reach = [b[0] for b in base], list(accumulate((b[3] for b in base), max, initial=0))
        # of the base spans that start before an added one ends, the one that reaches furthest tells whether any overlaps it
        done.append((base, sorted(base + [x for x in more if reach[bisect_left(starts, x[3])] <= x[0]])))
    return done


def find(docs: DataFrame, model: CRF | None = None, id_col: str = "doc_id", text_col: str = "text", texts_at_once: int = 200) -> DataFrame:
    """(id_col, base, found), one row per document row: arrays of (start, rank, kind, end) by start, then kind.

    base are the patterns' spans, found those and the CRF's.  Places are code points, ends
    exclusive.  Null and empty texts have none; ids of any type are returned as they are, null too; repeated rows are each
    returned; an empty table gives an empty one.
    """
    model = model or default_model()

    each = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model)
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and len(part) < texts_at_once and (not part or size < 4_000_000):
                    part.append(texts[at + len(part)].as_py() or "")
                    size += len(part[-1])
                made = all_spans(part, model, words)
                rows = lambda k, made=made: pa.array([[dict(zip(("start", "rank", "kind", "end"), s, strict=True)) for s in m[k]] for m in made], pa.list_(each))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), rows(0), rows(1)], ["id", "base", "found"])
                at += len(part)

    spans = "array<struct<start:int,rank:int,kind:string,end:int>>"
    field = docs.select(F.col(id_col).alias("id")).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {field}, base {spans}, found {spans}").withColumnRenamed("id", id_col)
