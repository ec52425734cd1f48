"""Registered queries on small tables with rows that only larger or odd ones have, against their SQL."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest

from tidegrid.plans import driver_queries
from tidegrid.plans import feature_queries, report_queries, site_queries  # noqa: F401  register their queries

TABLES = Path("/root/testdata/sf0.001")


def agree(spark, folder, name, **tables):
    """Whether a query on tables given as SQL returns its SQL's rows; the rows."""
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for table, sql in tables.items():
        con.sql(f"create table {table} as {sql}")
        con.sql(f"copy {table} to '{folder}/{table}.parquet' (format parquet)")
    want = con.sql(driver_queries.SQL[name])
    columns = sorted(want.columns)
    rows = sorted(map(str, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
    got = sorted(str(tuple(r)) for r in driver_queries.QUERIES[name](spark, str(folder)).select(columns).collect())
    assert got == rows
    return rows


def test_addresses_side_by_side(spark, tmp_path):
    texts = "SELECT * FROM (VALUES (1, '1.1.1.1 2.2.2.2,3.3.3.3'), (2, 'at 2.2.2.2\n'), (3, '4.4.4.4\n5.5.5.5'), (4, '6.6.6.6. 7.7.7.7;'), (5, NULL), (6, '256.1.1.1 8.8.8.8')) t(doc_id, text)"
    assert len(agree(spark, tmp_path, "ip_extract", documents=texts)) == 5


def test_ports_beyond_four_digits(spark, tmp_path):
    assert len(agree(spark, tmp_path, "socket_listing", part="SELECT k::BIGINT AS p_partkey, 1 AS p_size FROM (VALUES (10), (65534), (65536), (119998), (20000000)) t(k)")) == 5


def test_crowded_hosts(spark, tmp_path):
    tables = {"supplier": "SELECT k AS s_suppkey FROM range(20) t(k)", "part": "SELECT k AS p_partkey FROM range(4000) t(k)", "customer": "SELECT k AS c_custkey FROM range(900) t(k)"}
    assert len(agree(spark, tmp_path, "process_status", **tables)) == 900
    rows = agree(spark, tmp_path, "latest_deployment", **tables)
    assert len(rows) == 900 and len({r.split(", ", 2)[2] for r in rows}) > 100  # hosts with many processes of a name


def test_a_text_that_many_ask_for(spark, tmp_path):
    tables = {"customer": "SELECT k AS c_custkey, 'Customer#' || k AS c_name, (k % 3)::INTEGER AS c_nationkey FROM range(700) t(k)", "nation": "SELECT k::INTEGER AS n_nationkey FROM range(3) t(k)"}
    assert len(agree(spark, tmp_path, "location_lookup", **tables)) == 14


def test_named_includes(spark):
    from tidegrid.plans import listings

    files = [("1", f"/etc/n/s/{i}.conf", f"include /etc/n/s/{i // 2}.conf;\ninclude /etc/n/s/x*.conf;") for i in range(40)] + [("1", "/etc/n/s/x1.conf", "include [0].conf;"), ("2", "/etc/n/s/0.conf", "")]
    edges = listings.include_edges(spark.createDataFrame(files, "instance string, path string, content string"))
    got = {(r.instance, r.src.split("/")[-1], r.dst.split("/")[-1]) for r in edges.collect()}
    name = lambda i: f"{i}.conf"
    assert got == {("1", name(i), name(i // 2)) for i in range(40)} | {("1", name(i), "x1.conf") for i in range(40)}
    assert re.search(r"\(pattern#\d+ = ", edges._jdf.queryExecution().optimizedPlan().toString())  # paths meet by equality


def test_chains_stay_off_the_driver(spark):
    from tidegrid.operators import graph

    links = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(50, 51), (51, 50)], "src int, dst int")
    got = {r.node: (r.end, r.distance) for r in graph.chain_ends(links).collect()}
    assert got == {i: (0, i) for i in range(1, 40)} | {50: (None, None), 51: (None, None)}


def test_reached(spark):
    from tidegrid.operators import graph

    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4), (5, 6), (7, 4), (4, 4), (4, 8)], "src int, dst int")
    assert sorted(r.node for r in graph.reached(links, spark.createDataFrame([(1,), (9,)], "node int")).collect()) == [1, 2, 3, 4, 8, 9]


def test_overlaps_are_counted_not_listed(spark):
    import random

    from tidegrid.operators import relational as rel

    rng = random.Random(5)
    made = lambda n: [(rng.choice("ab"), rng.randint(0, 30), rng.randint(0, 30)) for _ in range(n)] + [("a", 3, 3), (None, 1, 2), ("b", None, 4)]
    asked, others = made(60), made(80)  # half of them end before they begin
    got = rel.overlap_counts(spark.createDataFrame(asked, "k string, a int, b int"), spark.createDataFrame(others, "k string, c int, d int"), ["k"], "a", "b", "c", "d")
    want = {}
    for k, a, b in {x for x in asked if None not in x}:
        n = sum(1 for y in others if None not in y and y[0] == k and y[2] >= a and y[1] <= b)
        want |= {(k, a, b): n} if n else {}
    assert {tuple(r)[:3]: r.overlaps for r in got.collect()} == want


def test_shared_views(spark):
    from tidegrid.operators import relational as rel

    members = [(g, m, "v" if g != 3 or m == "a" else "w") for g in range(6) for m in "abc"] + [(6, "a", None), (7, "a", "v"), (7, "b", None)]
    views = [(0, "v", m) for m in "cba"] + [(1, "v", m) for m in "abcx"] + [(2, "v", m) for m in "ab"] + [(3, "v", m) for m in "abc"] + [(3, "w", "b")] + [(4, "v", m) for m in "abcc"] + [(7, "v", "a"), (7, "v", "b")]
    told, said = spark.createDataFrame(members, "g int, m string, v string"), spark.createDataFrame(views, "g int, v string, e string")
    got = {r.g: (r.members, r.agreed) for r in rel.agree_on_shared_view(told, said, "g", "m", "v", "e").collect()}
    assert got == {0: (3, True), 1: (3, False), 2: (3, False), 3: (3, False), 4: (3, False), 5: (3, False), 6: (1, False), 7: (2, True)}


def test_candidates_are_written_once(spark, tmp_path):
    from tidegrid.plans import topology

    con = duckdb.connect()
    con.sql(f"copy (SELECT k AS c_custkey, 'Customer#' || k AS c_name, (k % 3)::INTEGER AS c_nationkey FROM range(40) t(k)) to '{tmp_path}/customer.parquet' (format parquet)")
    con.sql(f"copy (SELECT k::INTEGER AS n_nationkey FROM range(3) t(k)) to '{tmp_path}/nation.parquet' (format parquet)")
    for df in topology.build(site_queries.site(spark, str(tmp_path))):
        assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_all_paths_of_a_region(spark, tmp_path):
    tables = {"region": "SELECT 0 AS r_regionkey", "nation": "SELECT 0 AS n_nationkey, 0 AS n_regionkey", "supplier": "SELECT k AS s_suppkey, 0 AS s_nationkey FROM range(70) t(k)", "customer": "SELECT 1::BIGINT AS c_custkey, 0 AS c_nationkey",
              "orders": "SELECT k AS o_orderkey, 1::BIGINT AS o_custkey, 'F' AS o_orderstatus FROM range(5) t(k)", "lineitem": "SELECT k % 5 AS l_orderkey, k AS l_suppkey FROM range(40) t(k)"}
    assert len(agree(spark, tmp_path, "bounded_paths", **tables)) == 110
    assert len(agree(spark, tmp_path, "first_paths", **tables)) == 50


def test_the_validated_graph_is_written_once(spark):
    if not TABLES.exists():
        pytest.skip("the driver's tables aren't here")
    found = driver_queries.QUERIES["graph_validate"](spark, str(TABLES))
    assert "l_orderkey" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_a_text_are_found_at_once(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    from tidegrid.functions import strings
    from tidegrid.sources import proxyconf

    rng = random.Random(7)
    pieces = ["location /a {", "  location   = /b # {", "{", "}", "} }", "location /a{", "location ~ x{2} {", "\tlocation /c", "return '}';", 'x "{";', "# }", "", "server {", "location", "location /a b {", "\\{ y;", "location /a # }\r"]
    texts = [(i, rng.choice(["\n", "\r\n"]).join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for i in range(150)] + [(150, None), (151, "")]
    uris = ["/a", "= /b", "=  /b ", "~ x{2}", "/c", "/a b", " ", "/none", "/a #", "~ x", None]
    texts = spark.createDataFrame(texts, "k int, text string").repartition(4)
    asked = texts.select("k").crossJoin(spark.createDataFrame([(u,) for u in uris], "uri string")).unionByName(spark.createDataFrame([(999, "/a")], "k int, uri string"))
    want = asked.join(texts, "k", "left").select("k", "uri", strings.location_block(F.col("text"), F.col("uri")).alias("x"))
    want = {(r.k, r.uri): tuple(r.x) if r.x else (None, None) for r in want.collect()}
    got = proxyconf.location_blocks(texts, asked.unionByName(asked.where("k < 9")), ["k"]).where("uri is not null")
    found = {(r.k, r.uri): (r.start, r.end) for r in got.collect()}
    assert found == {k: v for k, v in want.items() if k[1] is not None} and len({v for v in found.values()}) > 20
    # one customer with many orders: its text is not read again for each of them
    tables = {"customer": "SELECT 1::BIGINT AS c_custkey, 'Customer#1' AS c_name", "orders": "SELECT k AS o_orderkey, 1::BIGINT AS o_custkey, CASE k % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END AS o_orderstatus FROM range(1500) t(k)"}
    assert len(agree(spark, tmp_path, "location_blocks", **tables)) == 1500
    plan = driver_queries.QUERIES["location_blocks"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan


def test_paths_are_counted_not_listed(spark):
    import random

    from pyspark.sql import functions as F

    from tidegrid.operators import graph

    rng = random.Random(3)
    nodes = [(f"n{i}", "T" if i in (7, 8, 9) else "S" if i < 3 else "M", "active") for i in range(10)]
    edges = [(f"e{i}", f"n{rng.randrange(10)}", f"n{rng.randrange(10)}", "X", "GLOBAL", rng.choice(["EXACT", "INFERRED", "AMBIGUOUS", "UNKNOWN", None])) for i in range(26)]
    edges += [(f"p{i}", *e[1:]) for i, e in enumerate(edges)]  # each twice
    nodes, edges = spark.createDataFrame(nodes, "id string, type string, status string"), spark.createDataFrame(edges, "id string, src string, dst string, type string, env string, confidence string")
    key = ["start_id", "end_id", "length", "confidence"]
    for directed, starts in ((True, "type = 'S'"), (False, "type <> 'M'")):  # targets that are starts can be met again
        steps, chosen = graph.adjacency(edges, directed=directed), nodes.where(starts)
        paths, _ = graph.paths(nodes, steps, chosen, ["T"], depth=5, most=None)
        want = {tuple(r)[:4]: r.n for r in paths.groupBy(*key).agg(F.count("*").alias("n")).collect()}
        got = {tuple(r)[:4]: r.paths for r in graph.path_counts(nodes, steps, chosen, ["T"], depth=5).select(*key, "paths").collect()}
        assert got == want and max(got.values()) > 1


def test_no_round_after_all_nodes_are_seen(spark, monkeypatch):
    from tidegrid.operators import graph

    written, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name="graph": written.append(name) or settle(df, name))
    nodes = spark.createDataFrame([("a", "T"), ("b", "M"), ("c", "M")], "id string, type string")
    steps = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "b"), ("a", "c")], "node string, neighbour string")
    assert sorted(map(tuple, graph.distances(nodes, steps, ["T"]).collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert written.count("dist") == 3
    more = nodes.unionByName(spark.createDataFrame([("d", "M")], "id string, type string"))
    assert graph.distances(more, steps, ["T"]).count() == 3


def test_last_steps_of_paths_are_not_written(spark, monkeypatch):
    from tidegrid.operators import graph

    written, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name="graph": written.append((name, made := settle(df, name))) or made)
    nodes = spark.createDataFrame([("s", "S", "active"), ("m", "M", "active"), ("t", "T", "active")], "id string, type string, status string")
    edges = spark.createDataFrame([("e1", "s", "m", "X", "GLOBAL", "EXACT"), ("e2", "m", "t", "X", "GLOBAL", "EXACT"), ("e3", "s", "t", "X", "GLOBAL", "EXACT")], "id string, src string, dst string, type string, env string, confidence string")
    found, _ = graph.paths(nodes, graph.adjacency(edges, directed=True), nodes.where("type = 'S'"), ["T"], depth=3, most=None)
    assert sorted(r.edges for r in found.collect()) == [["e1", "e2"], ["e3"]]
    assert [r.at for name, df in written if name == "paths" for r in df.collect()] == ["m"]


def test_a_line_that_stands_twice_is_two_proofs(spark, tmp_path):
    tables = {"region": "SELECT 0 AS r_regionkey", "nation": "SELECT 0 AS n_nationkey, 0 AS n_regionkey", "supplier": "SELECT k AS s_suppkey, 0 AS s_nationkey FROM range(3) t(k)", "customer": "SELECT 1::BIGINT AS c_custkey, 0 AS c_nationkey", "orders": "SELECT k AS o_orderkey, 1::BIGINT AS o_custkey FROM range(4) t(k)",
              "lineitem": "SELECT (k % 4)::BIGINT AS l_orderkey, (k % 3)::BIGINT AS l_suppkey, (k % 2)::INTEGER AS l_linenumber, 5::BIGINT AS l_partkey FROM range(40) t(k)"}
    rows = agree(spark, tmp_path, "graph_edges", **tables)
    assert len(rows) == 21 and sum("SUPPLIED_BY" in r for r in rows) == 12
