import pytest
from fixtures import SITE, write_site
from pyspark.sql import functions as F

from tidegrid.operators import graph
from tidegrid.plans import topology
from tidegrid.sources import sinks, snapshots


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    folder = write_site(tmp_path_factory.mktemp("site"))
    doc = snapshots.documents(spark, folder)
    snapshots.check_snapshot(doc)
    tables = snapshots.flatten(doc)
    nodes, edges = topology.build(tables, managed_suffixes=("example.com",))
    return tables, graph.settle(nodes), graph.settle(edges)


def test_graph(site):
    _, nodes, edges = site
    n = {r["id"]: r for r in nodes.collect()}
    e = {(r["src"], r["type"], r["dst"]): r for r in edges.collect()}
    assert len({r["id"] for r in e.values()}) == len(e)
    host = n["host:10.0.0.10"]  # compute, asset and deployments say the same host
    assert {x["source"] for x in host["evidence"]} == {"compute", "assets", "inventory"} and host["identity"]["cloudInstanceIds"] == "i-shop"
    assert n["host:198.51.100.9"]["status"] == "unresolved" and n["domain:off.example.com"]["status"] == "paused"
    assert n["domain:cdn.other.net"]["status"] == "external" and n["domain:missing.example.com"]["status"] == "unresolved"
    assert n["domain:b.example.com"]["status"] == "active"
    assert "domain:y.cloud.test" in n and "domain:x.cloud.test" not in n and "domain:p.inner.test" not in n  # the public cloud zone replaces the static one
    assert e["domain:edge.example.com", "RESOLVES_TO", "eip:e1"]["confidence"] == "EXACT"
    assert ("domain:lb.example.com", "RESOLVES_TO", "clb:lb-1") in e and ("domain:lb.example.com", "RESOLVES_TO", "eip:e2") in e
    assert ("eip:e1", "BOUND_TO", "host:10.0.0.5") in e and ("eip:e2", "BOUND_TO", "clb:lb-1") in e and ("eip:e3", "BOUND_TO", "nat-gateway:ngw-1") in e
    assert e["eip:e4", "BOUND_TO", "host:203.0.113.4"]["confidence"] == "AMBIGUOUS"
    assert e["deployment:100:PRODUCT:d1", "LISTENS_ON", "endpoint:10.0.0.10:8080:unknown"]["confidence"] == "EXACT"
    assert e["deployment:101:PRODUCT:d5", "LISTENS_ON", "endpoint:10.0.0.10:unknown:unknown"]["confidence"] == "AMBIGUOUS"
    assert e["deployment:100:TEST:d3", "LISTENS_ON", "endpoint:10.0.1.10:unknown:unknown"]["confidence"] == "INFERRED"
    assert ("clb-server-group:lb-1:g1", "FORWARDS_TO", "endpoint:10.0.0.10:8080:http") in e and ("clb-server-group:lb-1:g2", "FORWARDS_TO", "endpoint:10.0.0.12:9090:unknown") in e
    repo = [k for k in e if k[1] == "BUILT_FROM"]
    assert {k[0]: n[k[2]]["status"] for k in repo} == {"application:100": "active", "application:103": "unresolved"}
    assert n["endpoint:10.0.0.10:9999:tcp"]["attributes"]["app"] == "admin" and n["endpoint:10.0.0.10:8080:unknown"]["attributes"]["app"] == "shop"
    assert not [k for k in e if k[1] == "USES_UPSTREAM" and n[k[0]]["identity"]["directive"] == "access_control"]


def test_valid_and_published(spark, site, tmp_path):
    _, nodes, edges = site
    issues = graph.validate(nodes, edges).collect()
    assert [i for i in issues if i["severity"] == "error"] == []
    assert {i["node_id"] for i in issues if i["code"] == "DEPLOYMENT_WITHOUT_ENDPOINT"} == {"deployment:103:PRODUCT:d7"}
    sinks.publish_graph(spark, f"file://{tmp_path}", nodes, edges)
    assert sinks.current(spark, f"file://{tmp_path}", "nodes").count() == nodes.count()
    with pytest.raises(ValueError, match="invalid graph"):
        sinks.publish_graph(spark, f"file://{tmp_path}", nodes.where("type <> 'HOST'"), edges)
    stats = graph.stats(nodes, edges).first()
    assert stats["ambiguous_edges"] == edges.where("confidence = 'AMBIGUOUS'").count() and stats["unresolved_nodes"] > 0


def test_broken_graph(spark):
    nodes = spark.createDataFrame([("a", "HOST", {"ip": "10.0.0.1"}), ("a", "HOST", {"ip": "10.0.0.1"}), ("endpoint:10.0.0.1:x:tcp", "ENDPOINT", {"ip": "10.0.0.1", "port": "x", "protocol": "tcp"}), ("endpoint:10.0.0.1:80:tcp", "ENDPOINT", {"ip": "10.0.0.1", "port": "80", "protocol": "tcp"}), ("d", "DEPLOYMENT", {"ip": "10.0.0.1"}), ("d2", "DEPLOYMENT", {"ip": ""})], "id string, type string, identity map<string,string>")
    edges = spark.createDataFrame([("e", "a", "zz", "T", "EXACT", ["x"]), ("e", "a", "d", "T", "SURE", ["x"]), ("f", "a", "d", "T", "AMBIGUOUS", [])], "id string, src string, dst string, type string, confidence string, evidence array<string>")
    codes = sorted((i["severity"], i["code"]) for i in graph.validate(nodes, edges, ambiguous_edges=3).collect())
    assert codes == sorted([("error", "DUPLICATE_NODE_ID"), ("error", "DUPLICATE_EDGE_ID"), ("error", "MISSING_EDGE_NODE"), ("error", "INVALID_CONFIDENCE"), ("error", "EDGE_WITHOUT_EVIDENCE"), ("error", "INVALID_ENDPOINT_FORMAT"), ("error", "DEPLOYMENT_WITHOUT_ENDPOINT"), ("warning", "DEPLOYMENT_WITHOUT_ENDPOINT"), ("error", "AMBIGUOUS_EDGE_COUNT_MISMATCH"), ("warning", "ENDPOINT_WITHOUT_EXPECTED_HOST")])


def test_paths(site):
    _, nodes, edges = site
    start = nodes.where("id = 'domain:www.example.com'").select("id")
    found, truncated = graph.paths(nodes, graph.adjacency(edges, ["PRODUCT"]), start, ["APPLICATION"], depth=8)
    rows = found.collect()
    assert rows and not truncated and all(r["nodes"][0] == "domain:www.example.com" and r["end_id"].startswith("application:") and len(set(r["nodes"])) == len(r["nodes"]) for r in rows)
    ranks = [graph.CONFIDENCE[r["confidence"]] for r in rows]
    assert ranks == sorted(ranks, reverse=True)
    few, truncated = graph.paths(nodes, graph.adjacency(edges, ["PRODUCT"]), start, ["APPLICATION"], depth=8, most=1)
    assert truncated and few.count() == 1
    assert not [r for r in graph.paths(nodes, graph.adjacency(edges, ["TEST"]), start, ["DEPLOYMENT"], 8, None)[0].collect() if ":PRODUCT:" in r["end_id"]]
    kinds = {r["type"] for r in graph.reachable_types(nodes, graph.adjacency(edges), start, 3).collect()}
    assert {"DOMAIN", "NGINX_ROUTE", "UPSTREAM", "EIP"} <= kinds
    loop = graph.closure(edges.where("type = 'CNAME_TO'").select("src", "dst"), nodes.where("id = 'domain:a.example.com'").select(F.col("id").alias("node"))).collect()
    assert {(r["node"], r["distance"]) for r in loop} == {("domain:a.example.com", 0), ("domain:b.example.com", 1)}


def test_names(spark, site):
    _, nodes, _ = site
    asked = spark.createDataFrame([("WWW.example.com",), ("pay",), ("10.0.0.12",), ("nobody",)], "asked string")
    got = {}
    for r in graph.resolve_names(nodes, asked).collect():
        got.setdefault(r["asked"], []).append((r["status"], r["matched_by"]))
    assert got["WWW.example.com"] == [("found", "label")] and got["pay"] == [("found", "label")] and got["nobody"] == [("not-found", None)]
    assert got["10.0.0.12"][0] == ("found", "label")


def test_gate(spark, tmp_path):
    broken = dict(SITE, **{"ecs-snapshot.json": {"fetchedAt": "x", "instances": SITE["ecs-snapshot.json"]["instances"] * 2}})
    with pytest.raises(ValueError, match="duplicate compute"):
        snapshots.check_snapshot(snapshots.documents(spark, write_site(tmp_path, broken)))
    (tmp_path / "ecs-snapshot.json").unlink()
    with pytest.raises(ValueError, match="missing source: compute"):
        snapshots.check_snapshot(snapshots.documents(spark, f"file://{tmp_path}"))
    with pytest.raises(ValueError, match="ended early"):
        snapshots.check_pages(spark.createDataFrame([(3, "a"), (3, "b")], "total int, id string"))


def test_tables_and_cells(spark, tmp_path):
    path = tmp_path / "eip.csv"
    path.write_text("﻿id,ip,\na,1.1.1.1,=note\n,,\nb,2.2.2.2,\n", encoding="utf-8")
    df = snapshots.read_table(spark, f"file://{path}", ["id", "ip"], notes=True)
    assert [(r["id"], [n["value"] for n in r["notes"]]) for r in df.orderBy("id").collect()] == [("a", ["=note"]), ("b", [])]
    with pytest.raises(ValueError, match="missing columns"):
        snapshots.read_table(spark, f"file://{path}", ["owner"])
    sinks.write_csv(spark.createDataFrame([("=1+1", [1])], "a string, b array<int>"), f"file://{tmp_path}/out")
    assert spark.read.csv(f"file://{tmp_path}/out", header=True).first()["a"] == "'=1+1"


def test_long_chains(spark):
    """Searches end with the frontier, not after a number of steps: chains of 18 and 52 links, the first with a cycle at its end."""
    n = 18
    links = spark.createDataFrame([*((i, i + 1) for i in range(n)), (n, n - 1)], "src long, dst long").coalesce(1)
    starts = spark.createDataFrame([(0,), (n,)], "node long").coalesce(1)
    got = {(r["start"], r["node"]): r["distance"] for r in graph.closure(links, starts).collect()}
    assert got == {(0, i): i for i in range(n + 1)} | {(n, n): 0, (n, n - 1): 1}
    near = starts.where(f"node = {n}")
    assert graph.closure(links, near, depth=1).count() == 2
    with pytest.raises(ValueError, match="farther"):
        graph.closure(links, near, depth=0)
    n = 52
    nodes = spark.createDataFrame([(str(i), "END" if i == n else "NAME") for i in range(n + 1)], "id string, type string").coalesce(1)
    steps = spark.createDataFrame([(str(i), str(i + 1)) for i in range(n)], "node string, neighbour string").coalesce(1)
    assert {r["node"]: r["distance"] for r in graph.distances(nodes, steps, ["END"]).collect()} == {str(i): n - i for i in range(n + 1)}
