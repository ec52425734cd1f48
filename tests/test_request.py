import pytest
from fixtures import write_site

from tidegrid.plans import request
from tidegrid.sources import snapshots


@pytest.fixture(scope="module")
def traced(spark, tmp_path_factory):
    t = snapshots.flatten(snapshots.documents(spark, write_site(tmp_path_factory.mktemp("site"))))
    urls = ["http://www.example.com/", "www.example.com/pay/x", "http://lb.example.com/pay/1", "http://lb.example.com/", "http://nat.example.com", "http://nat.example.com:8005/", "http://nat.example.com:9999/",
            "out.example.com", "nobody.example.com", "a.example.com", "www.example.com/dyn/1", "ftp://x"]
    paths = request.trace(spark.createDataFrame([(u,) for u in urls], "url string"), t)
    rows = request.settle(paths)
    return t, rows.collect(), {r["req"]: r["status"] for r in request.statuses(rows).collect()}


def ends(rows, req):
    return {r["end_id"] for r in rows if r["req"] == req}


def test_cases(traced):
    _, rows, status = traced
    assert status["http://www.example.com/"] == "RESOLVED"  # CNAME, address, host, proxy, deployments, repository
    one = next(r for r in rows if r["req"] == "http://www.example.com/" and r["terminal"])
    assert one["nodes"][:4] == ["domain:www.example.com", "domain:edge.example.com", "eip:e1", "host:10.0.0.5"] and one["nodes"][-2] == "application:100"
    assert [s["resolver"] for s in one["steps"]] == ["dns", "dns", "dns", "nat", "proxy", "deployment", "deployment", "repository"]
    assert status["www.example.com/pay/x"] == "AMBIGUOUS" and ends(rows, "www.example.com/pay/x") == {"application:101", "application:102"}  # one endpoint, two applications
    assert all(r["confidence"] == "AMBIGUOUS" for r in rows if r["req"] == "www.example.com/pay/x")
    assert status["http://lb.example.com/pay/1"] == "AMBIGUOUS"  # the exact domain's rule wins over the wildcard's
    assert any("rule u1" in [s["rule"] for s in r["steps"]] for r in rows if r["req"] == "http://lb.example.com/pay/1") and not any("rule u2" in [s["rule"] for s in r["steps"]] for r in rows)
    assert status["http://lb.example.com/"] == "RESOLVED" and len([r for r in rows if r["req"] == "http://lb.example.com/"]) == 2  # fan-out is no ambiguity
    assert status["http://nat.example.com"] == "RESOLVED" and status["http://nat.example.com:8005/"] == "AMBIGUOUS"
    assert status["http://nat.example.com:9999/"] == "PARTIAL" and ends(rows, "http://nat.example.com:9999/") == {"nat-gateway:ngw-1"}
    assert status["out.example.com"] == "PARTIAL" and ends(rows, "out.example.com") == {"domain:cdn.other.net"}
    assert status["nobody.example.com"] == "UNRESOLVED" and status["www.example.com/dyn/1"] == "PARTIAL" and "ftp://x" not in status
    assert {r["reason"] for r in rows if r["req"] == "a.example.com"} == {"cycle"}


def test_locations(spark, traced):
    t, _, _ = traced
    found = request.find_locations(t, spark.createDataFrame([("/PAY/",), ("",), ("/none",), ("y",), ("Y/",), ("/payment",)], "asked string"))
    assert sorted((r["asked"], r["uri"], r["exact"]) for r in found.collect()) == [("/PAY/", "/pay/", True), ("Y/", "/pay/", False), ("y", "/deny", False), ("y", "/dyn/", False), ("y", "/pay/", False)]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_trace_leaves_no_joins_to_the_end(spark, traced):
    """Ends are written round by round: a plan that joins every round's branches sends them all to the driver."""
    paths = request.trace(spark.createDataFrame([("http://nowhere.example.org/",)], "url string"), traced[0])
    assert "Join" not in paths._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.req, r.reason) for r in paths.collect()] == [("http://nowhere.example.org/", "no entry")]
