"""Quality by passages, the prefix trie and vector codes, against plain Python or held-out rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tidegrid.llm import prefix_trie, quality, queries, vectors

BIG = (1 << 60) + 1


# 11 ------------------------------------------------------------------------------------------------
def prose(r, n):
    return " ".join("".join(r.choice(["th", "ing", "er", "and", "o"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def noisy(r, n, form):
    w = prose(r, n).split()
    return {"signs": lambda: " ".join(x + r.choice(["###", "&&&", "%%%"]) for x in w), "loud": lambda: " ".join(x.upper() + "!!" for x in w), "same": lambda: " ".join([w[0]] * n), "bars": lambda: " | ".join(w)}[form]()


def labelled(n, seed, forms=("signs", "loud", "same", "bars")):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        size = r.choice([5, 40, 200, 900])
        good = r.random() < 0.75
        rows.append((i, prose(r, size) if good else noisy(r, size, r.choice(forms)), int(good)))
    return rows


def test_quality_of_held_out_documents(spark):
    rows = labelled(500, 1)
    odd = [(1000, None, None), (1001, "", None), (1002, " \n ", None), (None, "no id", None), (BIG, "### " * 40, None), (1003, "word " * 300_000, None), (1004, "x" * 700_000, None)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows + odd], "doc_id long, text string, score string, predicted double").repartition(4)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i not in held] + [(None, 1, 0), (3, None, 0), (4, 7, 0), (99_999, 1, 0)] + [(5, 1, 0)] * 3, "doc_id long, quality int, toxic int")
    made = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(made) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in made.values())
    right = [made[i].predicted == q for i, _, q in rows if i in held]
    assert len(right) > 60 and sum(right) / len(right) > 0.95
    assert made[BIG].predicted == 0 and made[1000].score == made[1001].score


def test_quality_is_the_attention_over_all_passages():
    """A very long text is scored in pieces; the result is that of all its passages at once, and its end counts."""
    r = random.Random(2)
    rows = labelled(200, 3)
    model = quality.fit([quality.passages(t) for _, t, _ in rows], [q for _, _, q in rows])
    text = prose(r, 3000)
    x, w = quality.passages(text), model.weights
    h, g, _, _ = quality._encode(w, x)
    e = np.exp(g @ w["a"])
    assert math.isclose(model.score(text), 1 / (1 + math.exp(-((e @ h) / e.sum() @ w["v"] + w["c"][0]))), rel_tol=1e-4)
    assert abs(model.score(text + " " + noisy(r, 3000, "signs")) - model.score(text)) > 0.05
    assert sum(len(p) for p in quality.pieces("ab " * 400_000)) == pytest.approx(400_000 / quality.PASSAGE, rel=0.01)


def test_quality_gradients():
    """The gradients against differences of the loss."""
    chance = np.random.default_rng(1)
    bags = [chance.normal(size=(n, 6)) for n in (1, 3, 2)]
    x, sizes, y, weight = np.concatenate(bags), np.array([1, 3, 2]), np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])
    w = {"W": chance.normal(size=(6, 4)), "b": chance.normal(size=4), "V": chance.normal(size=(4, 3)), "U": chance.normal(size=(4, 3)), "a": chance.normal(size=3), "v": chance.normal(size=4), "c": np.array([0.3]), "mean": np.zeros(6), "scale": np.ones(6)}

    def loss(w):
        total = 0
        for bag, label, k in zip(bags, y, weight, strict=True):
            h, g, _, _ = quality._encode(w, bag)
            e = np.exp(g @ w["a"])
            p = 1 / (1 + np.exp(-((e / e.sum()) @ h @ w["v"] + w["c"][0])))
            total -= k * np.log(p if label else 1 - p)
        return total / len(y)

    found = quality._gradients(w, x, sizes, y, weight)
    for name, g in found.items():
        for at in np.ndindex(g.shape):
            up, down = ({**w, name: w[name].copy()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, rel=1e-4, abs=1e-7), name


def test_quality_without_two_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.train(docs, one)).collect()} == {2 / 3}
    assert {r.score for r in quality.score(docs, quality.train(docs, one.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), one)).collect() == []


# 12 ------------------------------------------------------------------------------------------------
def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + turns[c][h:]
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(x[: len(q)] == q and len(x) == len(q) + 1 for x in below)]
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out[len(p), min(m)] = (parent, len(m), len(kids), len(leaves), sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, node string, depth int, length string"


def trie_of(spark, rows):
    made = prefix_trie.trie(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CONVERSATIONS).repartition(3)).collect()
    found = {(r.depth, r.conv_id): tuple(r)[2:] for r in made}
    assert len(found) == len(made)
    return found


def test_trie(spark):
    r = random.Random(4)
    rows = []
    for c in [*range(60), *range(100, 140), 205, 206, -7, -105, BIG]:
        for t in range(r.randint(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", r.choice(["a", "bb", "é\U0001f600", "", None])))
    rows += [(3, None, "user", "first"), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (3, 2, None, None), (None, 1, "user", "nobody"), (None, None, None, None), (41, 9, "", "ab"), (42, 9, "a", "b")]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_long_and_equal_conversations(spark):
    """A chain of 9000 turns that nothing shares, copies that end in one node, and conversations that their short start leaves without turns."""
    rows = [(900 + c, t, "user", f"t{t}") for c in range(40) for t in range(3)]
    rows += [(7001, t, "user", f"x{t}") for t in range(9000)]
    rows += [(c, 0, "user", "only") for c in range(3001, 3030)]
    found, n = trie_of(spark, rows), 9000 - zlib.crc32(b"7001") % 6
    expected = brute_trie([x for x in rows if x[0] != 7001])
    alone = {k: v for k, v in found.items() if k[1] == 7001}
    none = hashlib.sha256(b"").hexdigest()
    assert alone == {(d, 7001): (7001 if d > 1 else 900, 1, int(d < n), 1, 0, hashlib.sha256(b"7001").hexdigest() if d == n else none) for d in range(1, n + 1)}
    root, expected_root = found[0, 900], expected.pop((0, 900))
    assert {k: v for k, v in found.items() if k[1] != 7001 and k[0]} == expected
    assert root == (None, expected_root[1] + 1, expected_root[2] + 1, expected_root[3] + 1, expected_root[4], expected_root[5])


def test_trie_of_none_and_one(spark):
    assert trie_of(spark, []) == {} and trie_of(spark, [(None, 1, "user", "x")]) == {}
    assert trie_of(spark, [(5, 1, "user", "x")]) == brute_trie([(5, 1, "user", "x")])


def test_end_digests_in_pieces(spark, monkeypatch):
    """Ids of a node that lie in several partitions and pieces are hashed in ascending order."""
    ids = [*range(-50, 3000, 7), BIG]
    ends = spark.createDataFrame([(1, 2, c) for c in reversed(ids)] + [(1, 3, 5), (2, 2, 9)], "depth long, node long, conv long").repartition(5)
    got = {(r.depth, r.node): r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"5").hexdigest(), (2, 2): hashlib.sha256(b"9").hexdigest()}


# 13 ------------------------------------------------------------------------------------------------
def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) and abs(x) < 2.0**50 for x in v)]
    lead = min((k for k in kept if k[0] is not None), key=lambda k: (k[0], k[1]))
    d = len(lead[1])
    at = [k * d // parts for k in range(parts + 1)]
    seeds = {}
    for i, v, _ in sorted((k for k in kept if k[0] is not None and len(k[1]) == d), key=lambda k: (k[0], k[1])):
        seeds.setdefault(i, v)
    books = [[list(v[a:b]) for v in list(seeds.values())[:entries]] for a, b in zip(at, at[1:])]
    far = lambda p, q: sum((x - y) ** 2 for x, y in zip(p, q, strict=True))
    best = lambda v, p: min((far(v[at[p] : at[p + 1]], c), e) for e, c in enumerate(books[p]))
    same = [k for k in kept if len(k[1]) == d]
    for _ in range(rounds):
        got = [[best(v, p)[1] for _, v, _ in same] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[at[p] : at[p + 1]] for (_, v, _), g in zip(same, got[p], strict=True) if g == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for i, v, lab in kept:
        found = [best(v, p) for p in range(parts)] if len(v) == d else None
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found) if found else None, sum(f for f, _ in found) if found else None))
    totals = {}
    for _, lab, _, e in out:
        totals[lab] = totals.get(lab, 0) + (e or 0)
    flat = ",".join(str(x) for b in books for c in b for x in c)
    return sorted(((i, c, e, totals[lab]) for i, lab, c, e in out), key=repr), hashlib.sha256(flat.encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, id string, code string, n string"


def codes_of(spark, rows):
    made = vectors.quantise(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS).repartition(4))[0].collect()
    assert len({r.codebooks_sha256 for r in made}) <= 1
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in made), key=repr), made[0].codebooks_sha256 if made else None


def floats(r, d, size=1.0):
    return [float(np.float32(r.gauss(0, size))) for _ in range(d)]


@pytest.mark.parametrize("size", [0.2, 1e4])
def test_codes(spark, size):
    """Odd rows beside plain ones; with large components, sums and squares leave 64 bits on the way."""
    r = random.Random(6)
    rows = [(i * 3, floats(r, 16, size), r.choice([0, 1, None])) for i in range(150)]
    rows += [(700 + i, rows[5][1], 2) for i in range(40)] + [(0, floats(r, 16, size), 1), (0, rows[0][1], 1), (None, floats(r, 16, size), None), (BIG, floats(r, 16, size), 0)]
    rows += [(1, None, 0), (2, [None] * 16, 0), (4, [float("nan")] * 16, 1), (5, [float("inf")] + [0.0] * 15, 1), (7, [1e30] * 16, 0), (8, [0.5] * 15, 0), (10, [], 0)]
    assert codes_of(spark, rows) == brute_codes(rows)


def test_codes_of_few_and_short_vectors(spark):
    r = random.Random(7)
    few = [(i, floats(r, 10), 0) for i in range(5)]
    assert codes_of(spark, few) == brute_codes(few)
    short = [(i, floats(r, 3), i % 2) for i in range(30)]
    assert codes_of(spark, short) == brute_codes(short)
    assert codes_of(spark, [(1, None, 0)]) == ([], None) and codes_of(spark, []) == ([], None)
    only = codes_of(spark, [(None, [0.5] * 8, 1), (None, [0.25] * 8, 1)])
    assert [c for _, c, _, _ in only[0]] == ["00" * 8] * 2


def test_codes_do_not_depend_on_partitions(spark):
    r = random.Random(8)
    rows = spark.createDataFrame([(i, floats(r, 24), i % 3) for i in range(400)], "vec_id long, embedding array<float>, label int")
    one, many = (sorted(map(tuple, vectors.quantise(rows.repartition(n))[0].collect())) for n in (1, 7))
    assert one == many


def test_contracts_of_the_new_queries(spark):
    d = "/root/testdata/sf0.001"
    assert queries.QUERIES["op11_quality"](spark, d).columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert queries.QUERIES["op13_vector_codes"](spark, d).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
