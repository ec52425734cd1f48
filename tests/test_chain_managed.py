import pytest
from fixtures import SITE, write_site
from pyspark.sql import functions as F

from tidegrid.plans import chain, managed, topology
from tidegrid.sources import snapshots


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    site = dict(SITE)
    doc = dict(site["jumpserver-snapshot.json"])
    run = lambda pid, name, command, **more: {"pid": pid, "ppid": 1, "name": name, "command": command, "ports": [], **more}
    host = {"id": "as9", "hostname": "pay", "ip": "10.0.0.12", "inspection": {"checkedAt": "2024-03-01T00:00:00Z", "loginStatus": "can_login", "appPorts": None, "nginxRoutes": [], "processes": [
        run(5, "java", "java -jar /srv/pay.jar", startedAt="2024-02-01T00:00:00Z"), run(9, "java", "java -jar /srv/pay.jar", startedAt="2024-02-02T00:00:00Z"), run(6, "redis-server", "redis-server *:6379"),
        run(7, "nginx", "nginx: worker process"), run(3, "nginx", "nginx: master process"), run(10, "node", "node --x /srv/app.js"),
    ]}}
    doc["assets"] = [*doc["assets"], host]
    site["jumpserver-snapshot.json"] = doc
    site["server-specs.json"] = {"available": True, "collectedAt": "x", "specs": [{"ip": "10.0.0.12, 10.0.0.13", "loginStatus": "can_login", "cpu": 4, "memoryMB": 7800}, {"ip": "10.0.0.10", "loginStatus": "cannot_login", "cpu": 0, "memoryMB": 0}]}
    return snapshots.flatten(snapshots.documents(spark, write_site(tmp_path_factory.mktemp("site"), site)))


def test_chain(spark, t):
    nodes, edges = topology.build(t, ("example.com",))
    asked = spark.createDataFrame([(x,) for x in ("www.example.com", "lb.example.com", "nat.example.com", "two.example.com", "out.example.com", "none.example.com", "a.example.com")], "asked string")
    made = chain.explore(nodes, edges, asked)
    s = {r["asked"]: r for r in made.summary.collect()}
    www = s["www.example.com"]
    assert (www["status"], www["names"], www["entries"], www["connected"], www["proxies"]) == ("resolved", 2, 1, True, 1)
    assert (www["backends"], www["exact"], www["ambiguous"], www["unresolved"]) == (3, 2, 1, 0) and www["applications"] == ["application:100", "application:101", "application:102"]
    assert {k: r["status"] for k, r in s.items() if k != "www.example.com"} == {"lb.example.com": "unresolved", "nat.example.com": "unresolved", "two.example.com": "unresolved", "out.example.com": "unresolved", "none.example.com": "not-found", "a.example.com": "unresolved"}
    e = {}
    for r in made.entries.collect():
        e.setdefault(r["asked"], set()).add((r["kind"], r["binding"], r["ip"]))
    assert e["www.example.com"] == {("eip", "host", "10.0.0.5")} and e["nat.example.com"] == {("eip", "gateway", "10.0.0.10"), ("eip", "gateway", "10.0.0.12")}
    assert e["lb.example.com"] == {x for ip in ("10.0.0.10", "10.0.0.11") for x in (("eip", "balancer", ip), ("clb", None, ip))}  # the address is a public one and a balancer's
    kinds = {r["upstream"].split(":")[-1]: (r["kind"], r["uris"]) for r in made.groups.collect()}
    assert sorted(k for k, _ in kinds.values()) == ["external", "proxy", "proxy"]
    gaps = {(r["asked"], r["gap"]) for r in made.gaps.collect()}
    assert {("none.example.com", "no such domain"), ("out.example.com", "alias leaves the site"), ("out.example.com", "no address"), ("www.example.com", "bound to a host without a port"), ("a.example.com", "no proxy route")} <= gaps
    assert ("www.example.com", "entry and proxy are not connected") not in gaps


def test_states(spark, t):
    ips = spark.createDataFrame([(x,) for x in ("10.0.0.12", "10.0.0.10", "10.0.0.5", "10.0.0.99", "10.0.0.13")], "ip string")
    got = {r["ip"]: (r["state"], r["spec"]) for r in managed.server_states(t, ips).collect()}
    assert got == {"10.0.0.12": ("can_login", "4C 8G"), "10.0.0.10": ("cannot_login", "8C 16G"), "10.0.0.5": ("cannot_login", "4C 8G"), "10.0.0.99": ("not_collected", ""), "10.0.0.13": ("not_collected", "4C 8G")}
    v = {(r["app_id"], r["env"]): tuple(r)[2:] for r in managed.environment_verdicts(t).collect()}
    assert v["101", "PRODUCT"] == (False, True, True, True, False) and v["100", "PRODUCT"] == (True, True, False, False, False)
    s = {r["app_id"]: tuple(r)[1:] for r in managed.process_status(t).collect()}
    assert s["100"] == (True, True) and s["101"] == (True, False) and s["103"] == (False, False)
    web = spark.createDataFrame([("10.0.0.12", "Pay-Twin", "2024-02-20")], "ip string, name string, m string").select("ip", "name", F.col("m").cast("timestamp").alias("mtime"))
    at = {(r["app_id"], r["env"]): r["at"] and r["at"].strftime("%m-%d") for r in managed.latest_deployment(t, web).collect()}
    assert at["101", "PRODUCT"] == "02-01" and at["102", "PRODUCT"] == "02-20" and at["100", "TEST"] is None
    rows = {r["ip"]: r for r in managed.summary_rows(t, ips).collect()}
    assert rows["10.0.0.12"]["hostname"] == "pay" and ("Redis", 1) in [tuple(x) for x in rows["10.0.0.12"]["categories"]] and rows["10.0.0.10"]["categories"] is None and not rows["10.0.0.99"]["managed"]


def test_managed_rows(spark, t):
    ips = spark.createDataFrame([(x,) for x in ("10.0.0.12", "10.0.0.10", "10.0.0.99")], "ip string")
    web = spark.createDataFrame([("10.0.0.12", "Pay-Twin"), ("10.0.0.10", "shop")], "ip string, name string")
    none = spark.createDataFrame([], "ip string, path string")
    got = sorted((r["ip"], r["kind"], r["type"], r["detail"], r["app_id"]) for r in managed.managed_rows(t, ips, web, none).where("kind not in ('unmanaged', 'unreachable')").collect())
    assert got == [
        ("10.0.0.12", "nginx", "Nginx", "nginx master (PID 3), files not collected", None), ("10.0.0.12", "process", "Java", "pay.jar (PID 5)", "101"), ("10.0.0.12", "process", "Java", "pay.jar (PID 9)", "101"),
        ("10.0.0.12", "process", "Node", "/srv/app.js (PID 10)", None), ("10.0.0.12", "process", "Redis", "redis-server (PID 6)", None), ("10.0.0.12", "webapp", "folder", "Pay-Twin", "102"),
    ]
    files = spark.createDataFrame([("10.0.0.12", "/etc/nginx/a.conf")], "ip string, path string")
    got = {(r["ip"], r["kind"], r["detail"]) for r in managed.managed_rows(t, ips, web, files).where("kind not in ('process', 'webapp')").collect()}
    assert got == {("10.0.0.12", "nginx", "/etc/nginx/a.conf"), ("10.0.0.10", "unreachable", None), ("10.0.0.99", "unmanaged", None)}
