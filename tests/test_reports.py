import pytest
from fixtures import SITE, write_site
from pyspark.sql import functions as F

from tidegrid.operators import graph
from tidegrid.plans import reports, topology
from tidegrid.sources import snapshots


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    site = dict(SITE)
    doc = dict(site["jumpserver-snapshot.json"])
    host = {"id": "as9", "hostname": "pay", "ip": "10.0.0.12", "inspection": {"checkedAt": "2024-03-01T00:00:00Z", "loginStatus": "ok", "appPorts": None, "nginxRoutes": [], "processes": [
        {"pid": 5, "ppid": 1, "name": "java", "command": "java -jar /srv/pay.jar", "ports": [{"port": 9090}]}, {"pid": 6, "ppid": 1, "name": "redis-server", "command": "redis-server *:6379", "ports": []},
        {"pid": 7, "ppid": 1, "name": "nginx", "command": "nginx: worker process", "ports": []}, {"pid": 8, "ppid": 1, "name": "kthread", "command": "[k]", "system": True},
    ]}}
    doc["assets"] = [*doc["assets"], host]
    doc["groups"] = [{"id": "p", "name": "edge", "key": "1:1", "parentKey": "1", "path": "/edge", "assetIds": ["as1", "as2"]}, {"id": "q", "name": "inner", "key": "1:1:2", "parentKey": "1:1", "path": "/edge/inner", "assetIds": ["as1"]}, {"id": "r", "name": "pay", "key": "1:3", "parentKey": "1", "path": "/pay", "assetIds": ["as2"]}]
    site["jumpserver-snapshot.json"] = doc
    return snapshots.flatten(snapshots.documents(spark, write_site(tmp_path_factory.mktemp("site"), site)))


def test_wide(t):
    rows = {r["ip"]: r for r in reports.wide_rows(t, ["10.0.0.0/24"]).collect()}
    shop = rows["10.0.0.10"]
    assert shop["kind"] == "cloud machine" and shop["conflict"] and shop["cloud_ids"] == ["i-shop"] and shop["groups"] == ["/edge", "/pay"]
    assert [(a["app_name"], a["env"]) for a in shop["associations"]] == [("pay", "PRODUCT"), ("shop", "PRODUCT")]
    assert rows["10.0.0.5"]["groups"] == ["/edge/inner"]  # the deepest group only
    assert rows["203.0.113.4"]["other_managed"] == ["10.0.0.10"] and rows["203.0.113.2"]["kind"] == "load balancer"
    assert rows["10.0.0.11"]["kind"] == "own site" and rows["10.0.0.11"]["sources"]["backend"] and not rows["10.0.0.11"]["sources"]["assets"]
    s = reports.summarize_wide(reports.wide_rows(t, ["10.0.0.0/24"])).first()
    assert s["total"] == len(rows) and s["alternate"] == 1 and s["missing"] == s["used"] - sum(r["sources"]["assets"] and (r["sources"]["cloud"] or r["sources"]["inventory"]) for r in rows.values())


def test_presence(spark, t):
    got = {(r["app_id"], r["env"]): r["present"] for r in reports.environment_presence(t["environments"]).collect()}
    assert got["100", "PRODUCT"] is True
    row = "struct<ip:string,deploy:string,config:string,status:string>"
    e = spark.createDataFrame([("a", "P", [("", "", "", "no environment")]), ("a", "T", [("1", "", "", "x")]), ("b", "P", [("", "", "", "failed")]), ("b", "T", [])], f"app_id string, env string, rows array<{row}>")
    p = reports.environment_presence(e)
    assert {(r["app_id"], r["env"]): r["present"] for r in p.collect()} == {("a", "P"): False, ("a", "T"): True, ("b", "P"): None, ("b", "T"): None}
    assert [r["app_id"] for r in reports.with_environments(p, ["T"], ["P", "T"]).collect()] == ["a"]
    step = "struct<operation:string,status:string,startTime:string,endTime:string>"
    d = spark.createDataFrame([("a", "P", "1.1.1.1", "SUCCESS", "2023-01-01 00:00:00", []), ("b", "P", "1.1.1.1", "", "", [("Push In", "SUCCESS", "", "2024-02-01T00:00:00Z")]), ("c", "P", "1.1.1.1", "", "", []), ("d", "P", "", "", "", [])], f"app_id string, env string, ip string, publishStatus string, lastPublishedAt string, pushIn array<{step}>")
    got = {r["app_id"]: r["over_year"] for r in reports.over_a_year(d, F.lit("2024-03-01T00:00:00Z").cast("timestamp")).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False}


def test_capacity_and_groups(spark, t):
    assert reports.capacity(t["compute"]).first()[:] == (2, 12, 24.0, 2, 1)
    assert [tuple(r) for r in reports.balancer_totals(t).collect()] == [("lb-1", 3, 3, 3, 0)]
    assert {r["group"]: r["assets"] for r in reports.top_groups(t["assets"], t["asset_groups"]).collect()} == {"edge": 1, "several groups": 1, "default only": 2}
    got = {r["asset"]: (r["status"], r["machine"]) for r in reports.one_to_one(t["assets"], t["compute"]).collect()}
    assert got == {"as1": ("matched", "i-proxy"), "as2": ("matched", "i-shop"), "as3": ("ambiguous", None), "as9": ("unmatched", None)}
    cert = "array<struct<id:string,name:string,domain:string,commonName:string,expiresAt:string>>"
    listeners = spark.createDataFrame([("l1", "one", "https", "443", [("c1", "n", "a.example.com", "", "2025")]), ("l2", "two", "https", "443", [("c1", "n", "a.example.com", "", "2025"), ("", "", "b.example.com", "b", "2024")])], f"lb string, lb_name string, protocol string, port string, certificates {cert}")
    assert {r["key"]: r["balancers"] for r in reports.certificates(listeners).collect()} == {"c1": 2, "b.example.com|b": 1}
    assert [r["balancers"] for r in reports.certificates(listeners, "ONE").collect()] == [1]


def test_servers(t):
    rows = [tuple(r) for r in reports.server_comparison(t).collect()]
    assert ("10.0.0.12", "101", "pay", "PRODUCT", 5, "java", None, "process") in rows
    assert ("10.0.0.10", "100", "shop", "PRODUCT", None, None, None, "missing") in rows
    assert {r[4] for r in rows if r[-1] == "extra"} == {6, 7}
    assert {(r["kind"], r["n"]) for r in reports.process_categories(t["processes"]).collect()} == {("Java Jar", 1), ("Redis", 1)}
    ports = {r["ip"]: r["ports"] for r in reports.listening_ports(t).collect()}
    assert ports["10.0.0.10"] == [8080, 9999] and ports["10.0.0.12"] == [9090] and ports["10.0.0.5"] is None


def test_usage(spark):
    a, b = F.array(*map(F.lit, (10, 0, 10, 70, 10))).cast("array<long>"), F.array(*map(F.lit, (20, 0, 20, 140, 20))).cast("array<long>")
    r = spark.range(1).select(reports.cpu_percent(a, b).alias("c"), reports.memory_percent(F.lit(1000), F.lit(250), F.lit(1), F.lit(1), F.lit(1)).alias("m"), reports.memory_percent(F.lit(1000), F.lit(None).cast("int"), F.lit(500), F.lit(100), F.lit(None).cast("int")).alias("f")).first()
    assert r[:] == (20.0, 75.0, 40.0)


def test_backends(t):
    nodes, edges = topology.build(t)
    got = {r["endpoint"]: r for r in reports.backends(graph.settle(nodes), graph.settle(edges)).collect()}
    assert got["endpoint:10.0.0.10:8080:http"]["status"] == "exact" and got["endpoint:10.0.0.10:8080:http"]["applications"] == ["application:100"]
    assert got["endpoint:10.0.0.12:9090:tcp"]["status"] == "ambiguous" and len(got["endpoint:10.0.0.12:9090:tcp"]["applications"]) == 2
