"""Facts from what tools print."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidegrid.plans import facts


def made(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values)))).withColumns({f"x_{k}": v for k, v in f(*[F.col(f"c{i}") for i in range(len(values))]).items()})
    return {k[2:]: v for k, v in df.first().asDict().items() if k.startswith("x_")}


def test_tools(spark):
    assert made(spark, facts.zookeeper, "Zookeeper version: 3\nMode: standalone\n") == {"mode": "standalone"} and made(spark, facts.zookeeper, None) == {"mode": None}
    assert made(spark, facts.redis_info, "# x\r\nredis_mode:cluster\r\nrole:slave\r\nconnected_slaves:2\r\n") == {"mode": "cluster", "role": "slave", "replicas": 2}
    nodes = "b1 10.0.0.2:6379@16379,h master - 0 1 2 connected 1-5\na1 10.0.0.1:6379@16379 myself,master - 0 0 1 connected\nc1 10.0.0.3:6379@1 slave,fail a1 0 0 1 disconnected\nd1 :0@0 master,noaddr - 0 0 1 x\n"
    got = made(spark, facts.redis_nodes, nodes)
    assert got["view"] == ["10.0.0.1:6379", "10.0.0.2:6379"] and got["endpoint"] == "10.0.0.1:6379" and got["signature"] == made(spark, facts.redis_nodes, "\n".join(reversed(nodes.splitlines())))["signature"]
    assert made(spark, facts.redis_binds, "# bind 1.1.1.1\nbind 127.0.0.1 -::1 # x\n") == {"binds": ["127.0.0.1", "::1"]} and made(spark, facts.redis_binds, "port 1") == {"binds": ["*"]}
    es = json.dumps({"nodes": {"i1": {"name": "n1", "transport_address": "10.0.0.1:9300", "settings": {"discovery": {"type": "single-node"}}}, "i2": {"name": "n2", "transport_address": "10.0.0.2:9300", "settings": {}}}})
    assert made(spark, facts.elasticsearch, '{"name":"n1","cluster_uuid":"u"}', es) == {"cluster_uuid": "u", "node_id": "i1", "endpoint": "10.0.0.1:9300", "view": ["10.0.0.1:9300", "10.0.0.2:9300"], "single_node": True}
    assert made(spark, facts.kafka, "#\nversion=0\ncluster.id=Qx\nbroker.id=3\n") == {"cluster_uuid": "Qx", "broker": 3}
    assert made(spark, facts.rabbitmq, '{"node":"r@a","running_nodes":["r@a"],"disk_nodes":["r@b","r@a"]}') == {"node_id": "r@a", "running": ["r@a"], "known": ["r@a", "r@b"]}
    rs = json.dumps({"set": "rs0", "members": [{"name": "b:1", "stateStr": "SECONDARY"}, {"name": "a:1", "stateStr": "PRIMARY", "self": True}, {"name": "c:1", "stateStr": "DOWN"}]})
    assert made(spark, facts.mongodb, rs) == {"replica_set": "rs0", "members": 2, "view": ["a:1", "b:1", "c:1"], "endpoint": "a:1", "mode": "replica"}
    assert made(spark, facts.mongodb, '{"ok":0}')["mode"] == "standalone"
    out = "7 (java) 99\nHOST_NETNS net:[1]\nNETNS net:[2]\nCOMMAND java -jar x.war\nJENKINS_HOME=/h\nusers:((\"java\",pid=7,fd=1))\n7 (java) 99\n"
    assert made(spark, facts.process, out, "7") == {"same_process": True, "same_namespace": False, "home": "/h", "command": "java -jar x.war", "listener_pids": [7]}


def test_business_plan(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    groups = t([("org",), ("org/shop",), ("org/shop/pay",), ("other/x/y",), ("org//z",)], "path string")
    url = "https://code.example.com/"
    repos = t([(1, "org/shop/pay/r1", url + "org/shop/pay/r1.git", True), (2, "org/shop/cart/r2", url + "org/shop/cart/r2", True), (3, "org/shop/pay/r3", url + "org/other/r3", True), (4, "org/shop/pay/r4", url + "org/shop/pay/r4", False), (5, "org/ops/r5", url + "org/ops/r5", True)], "repository int, path string, url string, active boolean")
    links = t([(1, "a"), (2, "b"), (1, "c"), (2, "c"), (3, "d"), (4, "e"), (5, "f"), (1, "g")], "repository int, app string")
    apps = t([("a", "git@code.example.com:org/shop/pay/r1.git"), ("b", url + "org/shop/cart/r2"), ("c", url + "org/shop/pay/r1"), ("c", url + "org/shop/cart/r2"), ("d", url + "org/shop/pay/r3"), ("e", url + "org/shop/pay/r4"), ("f", url + "org/ops/r5"), ("g", None)], "app string, url string")
    got, named = facts.business_plan(groups, repos, links, apps, "org")
    assert {r.app: (r.domain, r.system, r.status) for r in got.collect()} == {"a": ("shop", "pay", "assigned"), "b": ("shop", "cart", "assigned"), "c": (None, None, "ambiguous")}
    assert {tuple(r) for r in named.collect()} == {("shop", None), ("shop", "pay"), ("shop", "cart")}
