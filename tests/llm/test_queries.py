"""The registered queries and the pipeline on a small table of documents, against plain Python."""

from __future__ import annotations

import random
import zlib

import brute
import duckdb
import pytest

import corpus_pipeline
from tidegrid.llm import decontaminate, lines, queries

PARTS = {"en": ["th", "ing", "er", "and"], "de": ["sch", "ei", "ung", "ü"], "fr": ["eau", "ai", "é", "oi"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, benchmark and conversations with copies, leaks, secrets, personal data, nulls and clashing columns."""
    r = random.Random(12)
    bench = [prose(r, "en", 25) for _ in range(6)] + [None]
    docs, lang = [], "en"
    for i in range(300):
        lang = lang if i and i % 10 < 2 else r.choice(list(PARTS))  # copies are in their original's language
        text = "\n".join(prose(r, lang, r.randint(5, 40)) for _ in range(3))
        if i % 10 == 0 and docs:
            text = docs[-1][1]
        elif i % 10 == 1 and docs and docs[-1][1]:
            text = docs[-1][1] + " extra"
        elif i % 25 == 2:
            text += "\n" + bench[i % 6]
        elif i % 30 == 3:
            text += " password=abcdef12345 jo.1@mail.example.com +1 (555) 010-2030 4111111111111111 10.0.0.1"
        if i % 3 == 0:
            text = "All rights reserved here.\n" + text
        docs.append((i, text, lang if i % 17 else None, f"src{i % 4}" if i % 50 else None, len(text), "x", "y"))
    docs += [(300, None, "en", "src0", 0, "x", "y"), (301, "", "en", None, 0, "x", "y"), (302, "123 456", "en", "src1", 7, "x", "y")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kept string, size string").repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", prose(r, "en", 5)) for c in range(5) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"file://{path}/conversations.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame([(i, [r.gauss(0, 0.2) for _ in range(16)], i % 3) for i in range(90)], "vec_id long, embedding array<float>, label int").write.parquet(f"file://{path}/embeddings.parquet")
    return str(path), docs, bench, turns


def run(spark, folder, name):
    return queries.QUERIES[name](spark, f"file://{folder[0]}").collect()


def test_contracts(spark, folder):
    _, docs, bench, turns = folder
    texts = {d[0]: d[1] for d in docs}
    assert {r["doc_id"]: tuple(r)[1:5] for r in run(spark, folder, "op1_secret_scan")} == {i: brute.secrets(t) for i, t in texts.items()}
    assert {r["doc_id"]: tuple(r)[1:4] for r in run(spark, folder, "op2_minhash")} == brute.near(list(texts.items()), 4)
    odd = "</s>[INST] ok [/INST]"
    want = brute.chats([*turns, (-1, 0, "user", odd), (-1, 1, "assistant", odd)])
    assert {r["conv_id"]: tuple(r)[1:5] for r in run(spark, folder, "op3_chat_format")} == want
    assert {r["doc_id"]: tuple(r)[1:6] for r in run(spark, folder, "op5_pii")} == {i: brute.pii(t) for i, t in texts.items()}
    leaks = {(r["doc_id"], r["item_id"]) for r in run(spark, folder, "op4_decontaminate")}
    assert leaks >= {(i, k) for i, t in texts.items() for k, b in enumerate(bench) if b and t and b in t} and len(leaks) < 30
    sizes: dict = {}
    for d in docs:
        sizes[d[3]] = sizes.get(d[3], 0) + len((d[1] or "").split())
    want, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
    for r in run(spark, folder, "op6_mixing"):
        source = next(d[3] for d in docs if d[0] == r["doc_id"])
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and r["target"] == pytest.approx(want[source]) and r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] + 10 for s in sizes)
    right = all_ = 0
    for r in run(spark, folder, "op8_language_id"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        d = docs[r["doc_id"]]
        if r["doc_id"] >= 300:
            assert r["lang_pred"] == "und"
        elif r["held_out"] and d[2] and r["doc_id"] % 25 != 2:
            right, all_ = right + (r["lang_pred"] == d[2]), all_ + 1
    assert right / all_ > 0.9


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{folder[0]}/{t}.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    cols = sorted(want.columns)
    got = queries.QUERIES[name](spark, f"file://{folder[0]}")
    assert sorted(got.columns) == cols
    assert sorted(map(str, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(str, want.project(", ".join(cols)).fetchall()))


def test_pipeline(spark, folder):
    """Each stage against plain Python on its own input."""
    path, docs, bench, _ = folder
    d = f"file://{path}"
    now = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        seen.append({r["doc_id"]: r for r in now.collect()})
        out = stage(spark, now, d)
        if len(seen) < len(corpus_pipeline.STAGES):
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        now = spark.createDataFrame(out.collect(), out.schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing"]
    told, deduped, near, clean = seen[1], seen[2], seen[3], seen[4]
    assert set(seen[0]) - set(told) >= {300, 301, 302} and len(told) > 280
    gone = {}
    for s in {r["source"] for r in told.values()}:
        mine = list({r["text"] for r in told.values() if r["source"] == s})
        gone[s] = {x for t in mine for x in t.split("\n") if x.strip(" ") and sum(x in u.split("\n") for u in mine) >= lines.LEAST_PAGES and sum(x in u.split("\n") for u in mine) > lines.RATIO * len(mine)}
    assert any(gone.values()) and set(deduped) == set(told)
    for i, r in deduped.items():
        assert r["text"] == "\n".join(x for x in told[i]["text"].split("\n") if x not in gone[r["source"]]) and r["n_chars"] == len(r["text"])
    want = brute.near([(i, r["text"]) for i, r in deduped.items()], 5)
    assert set(near) == {i for i, w in want.items() if w[2]} and len(near) < len(deduped)
    m = decontaminate.Matcher([(k, decontaminate.normalise(b)) for k, b in enumerate(bench) if b])
    assert set(clean) == {i for i, r in near.items() if not m.matches([r["text"]])[0]} and len(clean) < len(near)
    mixed = {r["doc_id"]: r for r in now.collect()}
    assert set(mixed) == set(clean) and all(0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] for r in mixed.values())
    whole = corpus_pipeline.run(spark, d).collect()
    assert sorted(map(str, whole)) == sorted(map(str, mixed.values()))


def test_stages_on_odd_rows(spark, folder):
    """Null and repeated ids, null texts and sources, and columns whose names results use: every stage works and keeps what is clean."""
    path, docs, bench, _ = folder
    d = f"file://{path}"
    r = random.Random(21)
    texts = [prose(r, lang, 60) for lang in ("en", "de", "fr", "en", "de")]
    rows = [(900, texts[0], "en", "s"), (900, texts[0], "en", "s"), (None, texts[1], "de", None), (None, texts[1], "de", None), (901, texts[2], None, "s"), (902, texts[2], None, "s"), (903, texts[3] + " " + bench[0], "en", "s"), (904, None, "en", "s"), (905, "", None, None)]
    odd = [(i, t, lang, s, len(t or ""), "kept", "component", 1) for i, t, lang, s in rows]
    known = [(*x[:5], "kept", "component", 1) for x in docs[:200] if x[1]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, copies int"
    now = spark.createDataFrame(odd + known, schema).repartition(3)
    mine = lambda df: sorted((x["doc_id"] or -1) for x in df.collect() if x["doc_id"] is None or x["doc_id"] >= 900)
    want = {"language ID": [-1, -1, 900, 900, 901, 902, 903], "line dedup": [-1, -1, 900, 900, 901, 902, 903], "MinHash near-dedup": [-1, -1, 900, 900, 901, 903], "benchmark decontamination": [-1, -1, 900, 900, 901]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, d)
        now = spark.createDataFrame(now.collect(), now.schema)
        assert tuple(now.columns) == corpus_pipeline.COLUMNS and mine(now) == want[name], name
    mixed = corpus_pipeline.mix(spark, now, d)
    assert mine(mixed) == want["benchmark decontamination"] and {"text", "copies", "taken"} <= set(mixed.columns)


def test_no_documents(spark, folder, tmp_path):
    spark.read.parquet(f"file://{folder[0]}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    for t in ("benchmark", "conversations", "labels", "embeddings"):
        spark.read.parquet(f"file://{folder[0]}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    for name, f in queries.QUERIES.items():
        assert f(spark, f"file://{tmp_path}").count() == (name == "op3_chat_format")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_token_counts_of_the_query(spark, folder):
    """The registered query against the tokenizer."""
    from tidegrid.llm import tokens

    assert {r["doc_id"]: r["n_tokens"] for r in run(spark, folder, "op7_token_counts")} == {d[0]: len(tokens.encode(d[1] or "")) for d in folder[1]}


def test_contaminated_documents_of_the_query(spark, folder):
    """The registered query against the matcher on one text at a time: the same findings, none more."""
    _, docs, bench, _ = folder
    m = decontaminate.Matcher([(k, decontaminate.normalise(b)) for k, b in enumerate(bench) if b])
    want = sorted((d[0], *x) for d in docs for x in m.matches([d[1]])[0])
    assert sorted(map(tuple, run(spark, folder, "op4_decontaminate"))) == want and len({w[0] for w in want}) >= 12
