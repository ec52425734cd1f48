import datetime as dt

from pyspark.sql import functions as F

from tidegrid.operators import catalog, flows
from tidegrid.operators import relational as rel
from tidegrid.plans import components

T0 = dt.datetime(2024, 3, 1)
AT = lambda s: T0 + dt.timedelta(seconds=s)
SAMPLES = "frame int, at timestamp, local_ip string, local_port int, peer_ip string, peer_port int, protocol string, socket_id string, state string, sent long, received long, pids array<int>"


def sample(frame, lp, pp, sid, state="ESTAB", sent=0, received=0, pid=1):
    return (frame, AT(frame * 2), "10.0.0.1", lp, "10.0.0.2", pp, "tcp", sid, state, sent, received, [pid])


def states(spark):
    rows = [sample(0, 5000, 3306, "a", "SYN-SENT"), sample(1, 5000, 3306, "a", sent=10), sample(0, 8080, 6000, "b", sent=5), sample(1, 8080, 6000, "b", sent=5), sample(0, 8080, 6001, "c", sent=9), sample(1, 8080, 6001, "c", sent=3),
            sample(0, 5001, 3306, "d"), sample(3, 5001, 3306, "d", sent=9), sample(0, 5002, 3306, None), sample(1, 5002, 3306, None, sent=9), sample(0, 5003, 3306, "e")]
    return flows.flow_states(spark.createDataFrame(rows, SAMPLES), spark.createDataFrame([(8080, [1])], "port int, pids array<int>"))


def test_flow_states(spark):
    got = {(r["local_port"], r["peer_port"]): r for r in states(spark).collect()}
    see = lambda k: (got[k]["direction"], got[k]["direction_confidence"], got[k]["sent_delta"], got[k]["activity"], got[k]["warnings"])
    assert see((5000, 3306)) == ("downstream", "EXACT", 10, "DATA_OBSERVED", [])
    assert see((8080, 6000)) == ("upstream", "INFERRED", 0, "NO_DATA_OBSERVED", [])
    assert see((8080, 6001)) == ("upstream", "INFERRED", None, "UNKNOWN", ["counter rollback"])
    assert see((5001, 3306)) == ("downstream", "INFERRED", None, "UNKNOWN", ["interrupted"])
    assert see((5002, 3306))[2] is None and see((5003, 3306))[2] is None
    few, left = flows.bounded_flows(states(spark), 4)
    assert few.count() == 4 and left == 2


def test_attribution(spark):
    obs = [(5000, 0.5, 1.0, 77), (8080, -9.0, -8.0, 78), (5001, 1.0, 2.0, 1), (5001, 1.0, 2.0, 2), (5002, 1.0, 1.5, 9)]
    peer = {5000: 3306, 8080: 6000, 5001: 3306, 5002: 3306}
    df = spark.createDataFrame([("10.0.0.2", peer[p], "10.0.0.1", p, AT(a), AT(b), pid, "proc", "app") for p, a, b, pid in obs], "local_ip string, local_port int, peer_ip string, peer_port int, obs_start timestamp, obs_end timestamp, pid int, process string, app string")
    got = {(r["local_port"], r["peer_port"]): (r["resolution"], r["remote_pid"]) for r in flows.attribute(states(spark), df).collect()}
    assert got == {(5000, 3306): ("EXACT", 77), (8080, 6000): ("UNKNOWN", None), (8080, 6001): ("UNKNOWN", None), (5001, 3306): ("AMBIGUOUS", None), (5002, 3306): ("INFERRED", 9), (5003, 3306): ("UNKNOWN", None)}


def test_attribution_reasons(spark):
    """Why a flow's other end isn't known: no samples, samples outside its life, or samples without it."""
    for obs, want in (([], "peer not sampled"), ([(3306, -9, -8)], "peer sampled outside the flow's life"), ([(3306, 90, 91)], "peer sampled outside the flow's life"), ([(1, 0, 1)], "connection not seen at the peer"), ([(3306, 0, 1)], None)):
        df = spark.createDataFrame([("10.0.0.2", p, "10.0.0.1", 5000, AT(a), AT(b), 7, "proc", "app") for p, a, b in obs], "local_ip string, local_port int, peer_ip string, peer_port int, obs_start timestamp, obs_end timestamp, pid int, process string, app string")
        assert [r["reason"] for r in flows.attribute(states(spark).where("local_port = 5000"), df).collect()] == [want]


def test_targets(spark):
    f = states(spark).where("local_port = 5000")
    l = spark.createDataFrame([("10.0.0.2", b, 3306, "tcp", i, "x") for i, b in enumerate(["*", "0.0.0.0", "::", "10.0.0.2", "127.0.0.1"])] + [("10.0.0.2", "*", 99, "tcp", 9, "x")], "host_ip string, bind string, port int, protocol string, pid int, process string")  # noqa: E741
    assert {r["pid"] for r in flows.listener_candidates(f, l).collect()} == {0, 1, 2, 3}
    c = spark.createDataFrame([("c1", "0.0.0.0", 3306, 33, ["172.0.0.2", "172.0.0.3"]), ("c2", "::", 3306, 33, ["x"]), ("c3", "10.0.0.2", 1, 1, ["y"])], "container string, host_ip string, published_port int, container_port int, ips array<string>")
    assert {r["container_ip"] for r in flows.published_targets(f, c).collect()} == {"172.0.0.2", "172.0.0.3"}
    e = spark.createDataFrame([("f", "k", "db.example.com", 3306, ["10.0.0.2"]), ("f", "k2", "10.0.0.2", 1, [])], "file string, key string, host string, port int, resolved array<string>")
    assert [r["key"] for r in flows.config_matches(f, e).collect()] == ["k"]
    assert f.select(flows.service_hint().alias("s")).first()["s"] == "MySQL"
    assert flows.by_peer(states(spark)).count() == 2


D = "app_id string, env string, deploy string, ip string, port string, status string"


def test_prepare(spark):
    rows = [("a", "P", "1", "10.0.0.1", "80", "ok")] * 2 + [("a", "P", "2", "", "80", "ok"), ("b", "P", "1", "10.0.0.1", "80", "ok"), ("b", "P", "1", "10.0.0.1", "80", "bad"), ("c", "P", "1", "nope", "80", "ok")]
    got = sorted((r["app_id"], r["state"], r["coverage"]) for r in catalog.prepare(spark.createDataFrame(rows, D)).collect())
    assert got == [("a", "no-address", "COMPLETE"), ("a", "ok", "COMPLETE"), ("b", "conflict", "PARTIAL"), ("b", "conflict", "PARTIAL"), ("c", "invalid-address", "PARTIAL")]


def test_continuity(spark):
    old = spark.createDataFrame([("i1", "a", "P", "1", "10.0.0.1", "80"), ("i2", "a", "P", "2", "10.0.0.2", "80"), ("i3", "a", "P", "3", "10.0.0.3", "80")], "instance_id string, app_id string, env string, deploy string, ip string, port string")
    new = spark.createDataFrame([("a", "P", "1", "10.0.0.1", "80"), ("a", "P", "9", "10.0.0.2", "81"), ("a", "P", "3", "10.0.0.9", "80"), ("a", "P", "7", "10.0.0.7", "80")], "app_id string, env string, deploy string, ip string, port string")
    got = {r["deploy"]: (r["basis"], r["instance_id"]) for r in catalog.match_members(new, old).collect()}
    assert got["1"] == ("exact", "i1") and got["9"] == ("address", "i2") and got["3"] == ("deploy", "i3") and got["7"][0] == "new"


def test_history(spark):
    a = spark.createDataFrame([("1", "s", "P", "x"), ("2", "s", "Q", "y"), ("3", "s", "P", "z"), ("4", "s", "P", "n")], "id string, status string, env string, name string")
    b = spark.createDataFrame([("1", "t", "P", "x"), ("4", "s", "P", "m"), ("5", "s", "P", "w")], "id string, status string, env string, name string")
    done = spark.createDataFrame([("P",)], "env string")
    got = {r["id"]: r["action"] for r in catalog.changes(a, b, "id", ["status", "name"], done, ["env"], name="name").collect()}
    assert got == {"1": "UPDATE_OBSERVATION", "3": "NOT_OBSERVED", "4": "RENAME", "5": "CREATE"}
    assert catalog.snapshot_hash(a) == catalog.snapshot_hash(a.repartition(3)) != catalog.snapshot_hash(b)
    runs = spark.createDataFrame([("h1", AT(0), True), ("h2", AT(10), True)], "content string, observed_at timestamp, applied boolean")
    assert [catalog.import_kind(runs, h, AT(s)) for h, s in (("h2", 20), ("h1", 5), ("h3", 20))] == ["known", "historical", "new"]
    first = catalog.observations(a, "id", ["status"], "r1", AT(0))
    assert catalog.observations(a, "id", ["status"], "r2", AT(1), first).count() == 0
    assert catalog.search(a.union(spark.createDataFrame([("6", "s", "P", "50%_x")], a.schema)), "%_", ["name"]).count() == 1
    assert [catalog.search(spark.createDataFrame([(r"a\n'B",), ("other",), (None,)], "name string"), x, ["name"]).count() for x in (r"\n'b", "\n", "", "OTHER")] == [1, 0, 2, 1]
    paths = spark.createDataFrame([("team/a/x",), ("other/y",), ("both/z",)], "path string")
    rules = spark.createDataFrame([("team", "D", "S"), ("both", "D", "S"), ("both/z", "E", "S")], "prefix string, domain string, system string")
    assert {r["path"]: r["status"] for r in catalog.assign_once(paths, "path", rules).collect()} == {"team/a/x": "assigned", "other/y": "unassigned", "both/z": "ambiguous"}


def test_planners(spark):
    now = AT(3600)
    z = "asset string, config string, ip string, pid int, mode string, frames int, listener_pids array<int>, quorum boolean, observed_at timestamp, now timestamp"
    rows = [("a", "c1", "10.0.0.1", 1, "standalone", 2, [1], False, AT(0), now), ("a", "c2", "10.0.0.1", 1, "follower", 1, [1], False, AT(0), now), ("b", "c", "10.0.0.2", 1, "standalone", 2, [1], False, AT(0), now), ("b", "c", "10.0.0.2", 1, "standalone", 2, [1], False, AT(0), now), ("d", "c", "10.0.0.3", 2, "standalone", 2, None, False, AT(-9999), now)]
    got = components.plan(spark.createDataFrame(rows, z), components.PLANNERS["zookeeper"])
    assert sorted((r["asset"], r["config"], r["reason"]) for r in got.collect() if r["reason"]) == [("a", "c2", "fewer than 2 frames"), ("b", "c", "identity not unique"), ("b", "c", "identity not unique"), ("d", "c", "listener not owned by the process")]  # the last failing rule
    assert components.groups(got, components.PLANNERS["zookeeper"]).first()[:] == ("a/c1", 1)
    k = "endpoint string, signature string, view array<string>, ip string, observed_at timestamp, now timestamp"
    v = ["e1", "e2"]
    rows = [("e1", "s", v, "10.0.0.1", AT(0), now), ("e2", "s", v[::-1], "10.0.0.2", AT(0), now), ("e3", "t", ["e3", "e4"], "10.0.0.3", AT(0), now)]
    got = components.plan(spark.createDataFrame(rows, k), components.PLANNERS["redis"])
    assert {r["endpoint"]: r["reason"] for r in got.collect()} == {"e1": None, "e2": None, "e3": "members disagree"}
    for p in components.PLANNERS.values():
        assert p.rules and len({name for name, _ in p.rules}) == len(p.rules)


def test_relational(spark):
    t = spark.createDataFrame([(1, "1:2"), (1, "1:2:3"), (1, "1:4"), (2, "1")], "e int, key string")
    assert sorted(tuple(r) for r in rel.deepest_only(t, "e", "key").collect()) == [(1, "1:2:3"), (1, "1:4"), (2, "1")]
    a = spark.createDataFrame([("x", 1), ("y", 2)], "s string, v int")
    b = spark.createDataFrame([("x", 9), ("z", 3)], "s string, v int")
    assert sorted(tuple(r) for r in rel.replace_slices(a, b, "s", ["x", "y"]).collect()) == [("x", 9)]
    assert sorted(tuple(r) for r in rel.overriding_union(a, b, ["s"]).collect()) == [("x", 9), ("y", 2), ("z", 3)]
    p = spark.createDataFrame([(1, 5.0), (1, 50.0), (1, 100.0)], "k int, at double")
    r = spark.createDataFrame([(1, 0.0, 60.0), (1, 50.0, 51.0)], "k int, low double, high double")
    assert rel.range_join(p, r, ["k"], "at", "low", "high", 10.0).count() == 3
    assert rel.page(p, [F.col("at")], 99, 2, 3).collect()[0]["at"] == 100.0
    assert [x["key"] for x in rel.first_per(t, ["e"], [F.desc("key")]).orderBy("e").collect()] == ["1:4", "1"]
