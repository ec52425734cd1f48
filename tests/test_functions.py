import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import dates, net, strings


def each(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_addresses(spark):
    assert each(spark, net.normalize_ip, [" [010.0.0.01] ", "FE80::1", None, "300.1.1.1"]) == ["10.0.0.1", "fe80::1", "", "300.1.1.1"]
    assert each(spark, net.normalize_ip_checked, ["010.0.0.1", "300.1.1.1", "Host"]) == ["10.0.0.1", "300.1.1.1", "Host"]
    assert each(spark, net.address_list, ["10.0.0.1, 10.0.0.2;10.0.0.1", None]) == [["10.0.0.1", "10.0.0.2"], []]
    assert each(spark, net.ips_in_text, ["a 10.0.0.1, 1.2.3.4.5 999.1.1.1 (10.0.0.2)"]) == [["10.0.0.1", "10.0.0.2"]]
    assert each(spark, net.ip_number, ["1.0.0.1", "x", None]) == [16777217, None, None]
    assert each(spark, lambda c: net.in_networks(c, ["10.0.0.0/24"]), ["10.0.0.255", "10.0.1.0", "x"]) == [True, False, False]
    rows = spark.createDataFrame([("10.0.0.10",), ("10.0.0.9",), ("b",), ("a",)], "v string").orderBy(net.ip_order(F.col("v"))).collect()
    assert [r["v"] for r in rows] == ["10.0.0.9", "10.0.0.10", "a", "b"]


def test_ports(spark):
    assert each(spark, net.normalize_port, ["080", "*", "0", "", None, "8000-8010", "x"]) == ["80", "any", "any", "unknown", "unknown", "8000-8010", "unknown"]
    assert [tuple(x) for x in each(spark, net.port_range, ["80", "any", "8000-8010", "9-1", "x"])] == [(80, 80), (0, 65535), (8000, 8010), (None, None), (None, None)]
    assert each(spark, net.normalize_protocol, ["HTTP", "any", None]) == ["http", "unknown", "unknown"]
    pairs = [("http", "tcp", True), ("udp", "tcp", False), ("any", "udp", True), ("x", "y", False), ("x", "x", True)]
    df = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert df.where(net.protocols_match(F.col("a"), F.col("b")) != F.col("w")).count() == 0
    assert each(spark, net.listen_port, ["443 ssl", "1.2.3.4:8080", "[::]:80", "unix:/x"]) == [443, 8080, 80, None]


def test_git(spark):
    assert each(spark, net.git_key, ["git@h.example.com:a/b.git", "https://H.example.com:8443/a/B/", "ssh://git@h.example.com:22/a/b", "https://h/a", "https://u:p@h/a/b", "https://h/a/b?x=1", "junk"]) == ["h.example.com/a/b", "h.example.com:8443/a/B", "h.example.com/a/b", "", "", "", ""]
    assert each(spark, net.canonical_git_url, ["git@H.example.com:a/b.git", "http://h.example.com/a/b/", "", None]) == ["https://h.example.com/a/b", "https://h.example.com/a/b", "", ""]


def test_requests(spark):
    got = each(spark, net.parse_request, ["https://A.example.com./x/y?q#f", "a.example.com", "a.example.com:8080/p", "ftp://a", "", "http://a:70000"])
    assert [tuple(x) if x else None for x in got] == [("https", "a.example.com", 443, "/x/y", False), ("http", "a.example.com", 80, "/", True), ("http", "a.example.com", 8080, "/p", False), None, None, None]
    m = lambda pattern: tuple(each(spark, lambda c: net.domain_match(F.lit(pattern), c), ["a.b.example.com"])[0])
    assert m("0.example.com, a.b.example.com")[0] == 2 and m("0a.b.example.com")[0] == -1
    assert [m("a.b.example.com"), m("*.example.com"), m("*.b.example.com,x"), m(""), m("*.other.com")] == [(2, 4), (1, 2), (1, 3), (0, 0), (-1, 0)]
    loc = lambda uri: tuple(each(spark, lambda c: net.location_match(F.lit(uri), c), ["/api/x"])[0])
    assert [loc("= /api/x"), loc("/api"), loc("^~ /api/"), loc("~ x"), loc("/"), loc("(TCP/UDP)"), loc("/no")] == [("exact", 6), ("prefix", 4), ("prefix", 5), ("regex", 0), ("prefix", 1), ("stream", 0), (None, 0)]
    assert [tuple(x) for x in each(spark, net.upstream_target, ["http://10.0.0.1", "https://10.0.0.1/x", "pool", "unix:/s", "http://$host", "", "h:81"])] == [("ip", "10.0.0.1", "80"), ("ip", "10.0.0.1", "443"), ("hostname", "pool", "unknown"), ("unix", None, None), ("variable", None, None), ("none", None, None), ("hostname", "h", "81")]
    assert each(spark, net.fnv1a_hex, ["", "a", "foobar"]) == ["811c9dc5", "e40c292c", "bf9cf968"]


def test_dates(spark):
    utc = lambda x: x and x.astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M")
    assert [utc(x) for x in each(spark, dates.parse_time, ["2024-03-01 08:00:00", "2024-03-01T00:00:00Z", "nope", None])] == ["2024-03-01 00:00", "2024-03-01 00:00", None, None]
    assert [utc(x) for x in each(spark, dates.parse_zoned_time, ["2024-03-01T08:00:00+08:00", "2024-03-01 08:00:00"])] == ["2024-03-01 00:00", None]
    ref = F.lit("2024-03-31T00:00:00Z").cast("timestamp")
    assert utc(each(spark, lambda c: dates.months_before(ref, 1), ["x"])[0]) == "2024-02-29 00:00"
    at = lambda s: F.lit(s).cast("timestamp")
    ask = lambda s, p: each(spark, lambda c: dates.in_period(at(s), ref, p), ["x"])[0]
    assert [ask("2024-03-16T00:00:00Z", "fortnight"), ask("2024-03-15T23:59:59Z", "fortnight"), ask("2024-04-01T00:00:00Z", "week"), ask("2024-02-29T00:00:00Z", "month")] == [True, False, False, True]
    secs = spark.createDataFrame([(7 * 86400,), (60 * 86400 + 1,), (366 * 86400,)], "s long")
    got = secs.select(*[F.count(F.when(dates.in_duration(F.col("s"), n), 1)).alias(n) for n in dates.DURATIONS]).first().asDict()
    assert got == {"week": 1, "fortnight": 1, "month": 1, "two_months": 1, "half_year": 1, "year": 0, "over_year": 1}
    now = at("2024-03-01T01:00:00Z")
    assert [each(spark, lambda c, s=s: dates.fresh(at(s), now), ["x"])[0] for s in ("2024-02-29T23:00:00Z", "2024-02-29T22:59:59Z", "2024-03-01T01:05:01Z")] == [True, False, False]
    assert each(spark, lambda c: dates.running_seconds(F.lit(10), at("2024-03-01T00:59:00Z"), now), ["x"]) == [70]


@pytest.mark.parametrize(("name", "command", "kind"), [
    ("java", "java -Dcatalina.base=/x org.apache.catalina.startup.Bootstrap", "Tomcat"), ("java", "/usr/bin/java -jar /a/b/shop.jar --server.port=8080", "Java Jar"), ("java", "java com.example.Main", "Other Java"),
    ("java", "java -cp x org.apache.zookeeper.server.quorum.QuorumPeerMain z.cfg", "ZooKeeper"), ("java", "java kafka.Kafka s.properties", "Kafka"), ("node", "/opt/kibana/bin/kibana -e", "Kibana"), ("nginx", "nginx: master", "Nginx"),
    ("beam.smp", "/x/beam.smp -W w -s rabbit boot", "RabbitMQ"), ("redis-server", "redis-server *:6379", "Redis"), ("postgres", "postgres: writer", "PostgreSQL"), ("python3.11", "python3.11 a.py", "Python"), ("x", "/bin/x", "Other"),
])
def test_process_types(spark, name, command, kind):
    assert spark.range(1).select(strings.process_type(F.lit(name), F.lit(command)).alias("k")).first()["k"] == kind


def test_strings(spark):
    assert each(spark, strings.redact_arguments, ["--db.password=abc -Dtoken=\"x y\" mysql://u:p@h/d Authorization: Bearer abc.def user=me"]) == ["--db.password=*** -Dtoken=*** mysql://***@h/d Authorization: Bearer *** user=me"]
    assert each(spark, strings.redact_config, ["<dbPassword>abc</dbPassword><a>b</a>\n-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----"]) == ["<dbPassword>***</dbPassword><a>b</a>\n***"]
    assert each(spark, strings.command_port, ["java -Dserver.port=8081 -jar x", "x --port 99999", "x -p 22", "x"]) == [8081, None, 22, None]
    assert each(spark, strings.clean_terminal, ["\x1b[31mred\x1b[0m\x00\tok"]) == ["red\tok"]
    assert each(spark, strings.csv_cell, ["=1", " @x", "a=1", None]) == ["'=1", "' @x", "a=1", ""]
    assert each(spark, strings.arguments, ["a 'b c' \"d e\" f"]) == [["a", "b c", "d e", "f"]]
    assert spark.range(1).select(strings.nominal_memory_gib(F.lit(15800)).alias("x"), strings.nominal_memory_gib(F.lit(2048)).alias("y")).first()[:] == (16, 2)
    hit = lambda p, s: spark.range(1).select(F.lit(s).rlike(strings.glob_regex(p)).alias("x")).first()["x"]
    assert hit("**/*.yml", "a/b/c.yml") and hit("**/*.yml", "c.yml") and not hit("*.yml", "a/c.yml") and hit("a?.x", "ab.x") and not hit("a.x", "abx")
