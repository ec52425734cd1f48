"""Classifications, lists and roots from server settings on odd rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.plans import classify
from tidegrid.sources import applogs


def each(spark, f, values, schema="string"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + ", ".join(f"c{k} {t.strip()}" for k, t in enumerate(schema.split(","))))
    return [r.x for r in df.select("i", f(*[F.col(c) for c in df.columns[1:]]).alias("x")).orderBy("i").collect()]


def test_forms(spark):
    assert each(spark, classify.dns_owner, [("@", "z.com"), (" WWW. ", "z.com"), ("a.z.com", "z.com"), ("z.com", "z.com"), ("az.com", "z.com"), (None, "z.com")], "string, string") == ["z.com", "www.z.com", "a.z.com", "z.com", "az.com.z.com", None]
    assert each(spark, classify.service_of, [("es.hosts", ""), ("yes", ""), ("x", "amqp"), (None, None)], "string, string") == ["Elasticsearch", "unknown", "RabbitMQ", "unknown"]
    assert each(spark, classify.snapshot_time, ["20261019-205400-790994", "topology-20261019-205400-1", "20261019-205400", "", None]) == ["2026-10-19 20:54:00", "2026-10-19 20:54:00", "", "", ""]
    assert each(spark, classify.mapper_file, [("a/Mapper/x.XML", None), ("a/userMapper.xml", ""), ("a/mapper.txt", "<mapper namespace='x'>"), ("a/x.xml", "<!doctype  mapper"), ("mappers", ""), (None, None), ("a/x.xml", "<configuration>")], "string, string") == [True, True, True, True, False, False, False]
    answers = ['{"success":true,"result":{"pathResource":{"type":"project","id":1}}}', '{"success":true,"result":{"pathResource":{"type":"project","id":1},"assetsName":"error"}}', '{"errorCode":"x","errorAction":"ReLogin"}', '{"errorCode":403}', '{"errorCode":"not_found"}', "[1]", "oops", None, "{}"]
    assert [(r["access"], r["reason"], r["stop"]) for r in each(spark, classify.access_status, answers)] == [("yes", "found", False), ("unknown", "no clear result", False), ("unknown", "login", True), ("no", "denied", False), ("no", "missing", False), *[("unknown", "no JSON object", False)] * 3, ("unknown", "no clear result", False)]


def test_processes(spark):
    rows = [("beam", "x", "init", "rabbit", "hub/rabbitmq:3"), ("java", "java Main", "proxy", "docker-entrypoint.sh java kafka.Kafka c", "x/redis"), ("java", "java -jar a.jar", "init", "redis-server", "redis"), ("a", "a", "guess", "redis-server", "redis"), ("a", "a", "init", "python3 x", "REDIS@sha256:1"), ("a", "a", "init", None, None)]
    got = each(spark, lambda *a: classify.container_type(*a), rows, "string, string, string, string, string")
    assert [(r["type"], r["basis"]) for r in got] == [("RabbitMQ", "container-image"), ("Kafka", "container-command"), ("Java Jar", None), ("Other", None), ("Redis", "container-image"), ("Other", None)]
    kinds = [("Kafka", ""), ("Other Java", "java org.apache.rocketmq.X"), ("Other", "run rabbitmq-x"), ("Kibana", ""), ("Tomcat", ""), ("Redis", ""), ("System", ""), ("Node", "")]
    assert [tuple(r) for r in each(spark, classify.export_class, kinds, "string, string")] == [("MQ", True), ("MQ", True), ("MQ", True), ("Other", False), ("Tomcat", False), ("Redis", True), ("System", True), ("Node", False)]
    details = [("Java", "java", "java -jar /a/b.jar", 1), ("Java", "java", "java X", 2), ("Tomcat", "java", "java -Dcatalina.home=/t/ x", 3), ("Tomcat", "java", "/opt/apache-tomcat-9/bin/x", 4), ("Node", "node", "node --x a.js", 5), ("Node", "node", "node", 6), ("Redis", "redis-server", "", 7)]
    assert each(spark, classify.process_detail, details, "string, string, string, int") == ["b.jar", "java (PID 2)", "/t", "/opt/apache-tomcat-9", "a.js (PID 5)", "node (PID 6)", "redis-server (PID 7)"]


def test_batch_detail(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = classify.batch_detail(
        t([("https://h.example.com/a/b",), ("git@h.example.com:a/b.git",), ("https://h.example.com/a/none",), ("nonsense",), (None,)], "input string"), t([(1, "https://h.example.com/a/b.git"), (2, "https://h.example.com/a/c"), (3, "bad")], "repository int, url string"),
        t([(1, "x"), (1, "y"), (1, "gone"), (1, "x")], "repository int, app string"), t([("x",), ("y",)], "app string"), t([("x", "P", "10.0.0.1"), ("x", "T", None), ("gone", "P", "10.0.0.9")], "app string, env string, ip string"),
    )
    one = [(1, "x", "P", "10.0.0.1", "matched"), (1, "x", "T", None, "matched"), (1, "y", None, None, "not deployed"), (1, "gone", None, None, "application not collected")]
    want = [(u, *x) for u in ("https://h.example.com/a/b", "git@h.example.com:a/b.git") for x in one] + [("https://h.example.com/a/none", None, None, None, None, "no repository"), ("nonsense", None, None, None, None, "invalid address"), (None, None, None, None, None, "invalid address")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_server_roots(spark):
    good = '<Server><Host appBase="apps"><Context docBase="shop"/><Context docBase="/data/web/site"/><Context docBase="x.war"/><Context docBase="${a}"/></Host><Host/></Server>'
    rows = [("g", "/opt/run/tom", good), ("none", "/opt/run/tom2", None), ("dtd", "/opt/run/tom3", "<!DOCTYPE a><Server><Host appBase='q'/></Server>"), ("bad", "/opt/run/tom4", "<Server>"), ("rel", "opt/run", good), ("flat", "/o", None)]
    got = {}
    for r in applogs.server_roots(spark.createDataFrame(rows, "id string, base string, content string")).orderBy("id", "kind", "place").collect():
        got.setdefault((r.id, r.kind), []).append(r.root)
    assert got == {("g", "app"): ["/opt/run/tom/apps", "/opt/run/tom/webapps"], ("g", "context"): ["/data/web/site/WEB-INF", "/opt/run/tom/apps/shop/WEB-INF"], ("none", "app"): ["/opt/run/tom2/webapps"], ("dtd", "app"): ["/opt/run/tom3/webapps"]}
