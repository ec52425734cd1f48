import base64
import gzip

from pyspark.sql import functions as F

from tidegrid.sources import probes, settings

ID, OTHER = "a" * 64, "b" * 64
SOCKETS = """Netid State Recv-Q Send-Q Local Peer
tcp ESTAB 0 0 10.0.0.1:8080 10.0.0.2:5000 users:(("java",pid=7,fd=1)) ino:55 sk:9f
\t cubic bytes_acked:10 bytes_received:20
\t bytes_acked:30
0 0 [::1]:80 *:* ino:56
tcp ESTAB 0 0 bad 10.0.0.2:1
\t bytes_acked:99
"""


def b64(text):
    return base64.b64encode(text.encode()).decode()


PROC = "\t".join(["CHECK_PROC", "7", "100", b64(" 7 1 app 50 java java -jar /a/shop.jar --password=x"), b64("/srv"), b64("/bin/java"), b64("net:[1]")])
FRAME = f"CHECK_SAMPLE_BEGIN\nCHECK_SS_RC\t0\nCHECK_LISTEN_RC\t0\nCHECK_UID\t0\n{PROC}\nCHECK_OBSERVED\t101.0\t102.0\nCHECK_SOCKETS_BEGIN\n{SOCKETS}CHECK_SOCKETS_END\nCHECK_SAMPLE_END\n"


def one(spark, text, name="text"):
    return spark.createDataFrame([("h", text)], f"host string, {name} string")


def test_sockets(spark):
    owners = spark.createDataFrame([("h", "56", 3)], "host string, inode string, pid int")
    got = [tuple(r)[2:] for r in probes.sockets(one(spark, SOCKETS), "text", "host", owners=owners).orderBy("block").collect()]
    assert got == [("ESTAB", ("10.0.0.1", 8080), ("10.0.0.2", 5000), [7], "9f", 30, 20), ("UNKNOWN", ("::1", 80), ("*", 0), [3], "56", None, None)]


def test_frames(spark):
    rows = [("ok", f"CHECK_CLOCK_BEGIN\t100.0\n{FRAME}CHECK_CLOCK_END\t103.0\n", 200.0, 204.0), ("clock", f"CHECK_CLOCK_BEGIN\t100.0\n{FRAME}CHECK_CLOCK_END\t103.0\n", 200.0, 201.0), ("cut", FRAME, 1.0, 2.0), ("single", "CHECK_SS_RC\t0\nCHECK_LISTEN_RC\t1\n", 1.0, 2.0)]
    f = probes.frames(spark.createDataFrame(rows, "probe string, text string, sent double, received double"), "text", "sent", "received", "probe")
    got = {r["probe"]: r for r in f.collect()}
    assert {k: r["error"] for k, r in got.items()} == {"ok": None, "clock": "clock changed", "cut": "output incomplete", "single": "command failed"}
    times = f.where("probe = 'ok'").select(*[F.unix_millis(k) for k in ("started", "observed", "ended")], "root").first()
    assert times[:] == (201000, 202000, 203000, True)
    p = probes.live_processes(f.where("probe = 'ok'"), "body", "probe").first()
    assert (p["pid"], p["command"], p["cwd"], p["namespace"]) == (7, "java -jar /a/shop.jar --password=***", "/srv", "net:[1]")
    assert probes.sockets(f.where("probe = 'ok'").select("probe", probes.section(F.col("body"), "SOCKETS").alias("s")), "s", "probe").count() == 2


def test_transfer(spark):
    good = "CHECK_BLOB_BEGIN\tx\n" + base64.b64encode(gzip.compress(b"inside\n")).decode() + "\nCHECK_BLOB_END\n"
    bomb = "CHECK_BLOB_BEGIN\tx\n" + base64.b64encode(gzip.compress(bytes(probes.MOST_INFLATED + 1))).decode() + "\nCHECK_BLOB_END\n"
    cut = "CHECK_BLOB_BEGIN\tx\n" + base64.b64encode(gzip.compress(b"inside\n" * 99)[:-9]).decode() + "\nCHECK_BLOB_END\n"
    texts = ["a\n" + good + "z", "CHECK_BLOB_BEGIN\tx\n!!\nCHECK_BLOB_END\n", None, good + "b\n" + good, "plain", "a\n" + bomb, "a\n" + cut, good + cut]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", probes.expand_transfer(F.col("t")).alias("x")).collect()}
    assert got == {0: "a\ninside\nz", 1: None, 2: None, 3: "inside\nb\ninside\n", 4: "plain", 5: None, 6: None, 7: None}


def test_containers(spark):
    ports = '{"8080/tcp":[{"HostIp":"0.0.0.0","HostPort":"80"}],"9/udp":null}'
    text = f"CHECK_DOCKER\t{ID}\t\"/shop\"\t40\t5\tnet:[2]\t{ports}\t172.17.0.2\nCHECK_DOCKER\tbroken\t1\n"
    found = probes.containers(one(spark, text), "text", "host")
    assert sorted((r["name"], r["well_formed"]) for r in found.collect()) == [("1", False), ("shop", True)]
    p = probes.published(found, "host")
    assert [tuple(r)[2:] for r in p.collect()] == [(40, "0.0.0.0", 80, "172.17.0.2", 8080)]
    command = "docker-proxy -proto tcp -host-ip 0.0.0.0 -host-port {} -container-ip 172.17.0.2 -container-port 8080"
    proxies = spark.createDataFrame([("h", 1, command.format(80)), ("h", 2, command.format(81)), ("h", 3, "docker-proxy -proto tcp")], "host string, pid int, command string")
    heard = [(ID, "LISTEN", "0.0.0.0", 8080, 41)]
    schema = "container string, state string, ip string, port int, pid int"
    got = {r["pid"]: (r["service_pid"], r["resolution"]) for r in probes.resolve_proxies(proxies, p, spark.createDataFrame(heard, schema), "host").collect()}
    assert got == {1: (41, "INFERRED"), 2: (None, "UNKNOWN"), 3: (None, "UNKNOWN")}
    two = spark.createDataFrame([*heard, (ID, "LISTEN", "*", 8080, 42)], schema)
    assert probes.resolve_proxies(proxies.where("pid = 1"), p, two, "host").first()["resolution"] == "AMBIGUOUS"
    flows = spark.createDataFrame([("f", "h", "10.0.0.9", 5000, "10.0.0.1", 80), ("g", "h", "10.0.0.9", 5000, "10.0.0.1", 99)], "flow string, host string, local_ip string, local_port int, peer_ip string, peer_port int")
    inside = spark.createDataFrame([(ID, "LISTEN", "*", 8080, "*", 0, 41, "shop"), (ID, "ESTAB", "172.17.0.2", 8080, "10.0.0.9", 5000, 41, "shop"), (OTHER, "ESTAB", "172.17.0.2", 8080, "10.0.0.9", 5000, 50, "no")], "container string, state string, local_ip string, local_port int, peer_ip string, peer_port int, pid int, service string")
    got = {r["flow"]: (r["mappings"], r["ambiguous"], [o["pid"] for o in r["owners"]], r["service"]) for r in probes.container_peers(flows, p, inside, "host").collect()}
    assert got == {"f": (1, False, [41], "shop"), "g": (0, False, [], None)}


def test_machine(spark):
    got = probes.machine_specs(spark.createDataFrame([("a", "x\nSPECS\t4\t2048000\tLinux 8\n"), ("b", "SPECS\t\t\tLinux"), ("c", "no")], "h string, t string"), "t", "h").collect()
    assert sorted(tuple(r) for r in got) == [("a", 4, 2000, "Linux 8", "complete", []), ("b", 0, 0, "Linux", "partial", ["cpu", "memory"]), ("c", 0, 0, "", "failed", ["cpu", "memory", "os"])]
    usage = "USAGE\tcpu  10 0 20 70 10\tcpu  20 0 40 140 20\t1000000\t250000\t1\t1\t1\n"
    got = probes.machine_usage(spark.createDataFrame([("a", usage), ("b", "USAGE\tcpu 1\tcpu 2\t1\t\t\t\t")], "h string, t string"), "t", "h").collect()
    assert [tuple(r) for r in got] == [("a", 27.3, 75.0, 976, 732)]
    listing = spark.createDataFrame([("a", "1700000000.5\tshop\n1\tshop\n2\t.git\n3\tshop_20240101-1200\n4\tpay_buff\nWEBAPPS_DONE\t0\n"), ("b", "WEBAPPS_DONE\tabsent"), ("c", "1\tx\nWEBAPPS_DONE\t1"), ("d", "")], "h string, t string")
    assert [(r["h"], r["name"], r["mtime"].timestamp() > 1e9) for r in probes.webapp_folders(listing, "t", "h").orderBy("h").collect()] == [("a", "shop", True), ("c", "x", False)]
    assert {r["h"]: r["status"] for r in probes.webapp_status(listing, "t", "h").collect()} == {"a": "complete", "b": "absent", "c": "partial", "d": "failed"}


YAML = """spring:
  application:
    name: shop # comment
  profiles:
    active: dev
---
spring:
  profiles: dev
  cloud:
    nacos:
      config:
        server-addr: "10.0.0.1:8848"
        namespace: ns
        shared-dataids: common.yaml,${spring.profiles.active}.yaml
---
nacos:
  config:
    server-addr: ${addr}
addr: 10.0.0.2:8848
"""
BUSINESS = "nacos:\n  nacosUrl: 10.0.0.3:8848\n  namespace: n\n  dataId: a.yaml, ${b}\n  deeper:\n    dataId: no\n"


def test_yaml(spark):
    found = settings.scalars(one(spark, YAML), "text", "host")
    assert {(r["document"], r["path"]): r["value"] for r in found.collect()}[0, "spring.application.name"] == "shop"
    f = settings.fields(found, "host")
    got = sorted((r["data_id"], r["address"], r["profile"], r["problem"]) for r in settings.spring_declarations(f, F.lit("java -jar x.jar"), "host").collect())
    assert got == [(i, "10.0.0.1:8848", "dev", None) for i in ("shop", "shop-dev.properties", "shop.properties")]
    assert [r["problem"] for r in settings.spring_declarations(f, F.lit("java -Dspring.profiles.active=prod"), "host").collect()] == ["not one declaration for the profile"]
    assert sorted((r["data_id"], r["resolved"]) for r in settings.shared_declarations(f, F.lit("dev"), "host").collect()) == [("common.yaml", True), ("dev.yaml", True)]
    assert [r["profile"] for r in settings.profiles(f, "host").collect()] == ["dev"]
    assert settings.direct_declarations(f, "host").count() == 0  # a placeholder isn't a literal
    last = f.where("document = 2").select(settings.resolve_placeholders(F.lit("x: ${addr} ${no}"), F.col("values"), F.col("repeated"))).first()[0]
    assert last == "x: 10.0.0.2:8848 ${no}"
    business = settings.business_declarations(settings.scalars(one(spark, BUSINESS), "text", "host"), "host")
    assert sorted((r["data_id"], r["group"], r["resolved"]) for r in business.collect()) == [("${b}", "", False), ("a.yaml", "", True)]
    direct = settings.fields(settings.scalars(one(spark, "nacos:\n  config:\n    server-addr: a:1\n    data-id: d\n"), "text", "host"), "host")
    assert [tuple(r)[2:] for r in settings.direct_declarations(direct, "host").collect()] == [("a:1", "", "DEFAULT_GROUP", "d")]


def test_yaml_depths(spark):
    """Depths that come back, keys beside a value, comments, quotes, a separator with nothing before it; rows that repeat stay apart."""
    text = "---\na:\n    b: 1\n  c:\n      d: ' x '\n  e: y # z\nf: g\n  h: no parent\n\n# i: j\nk:\n- l: m\nk:\n  n:\n--- # next\n\n...\na: \nb: \"q\"\n  a.b-c: '\n"
    df = spark.createDataFrame([("x", text), ("x", text), ("y", None), ("y", "")], "host string, text string")
    got = sorted((r["document"], r["line"], r["path"], r["value"]) for r in settings.scalars(df, "text", "host").collect())
    want = [(0, 1, "a", None), (0, 2, "a.b", "1"), (0, 3, "a.c", None), (0, 4, "a.c.d", " x "), (0, 5, "a.e", "y"), (0, 6, "f", "g"), (0, 7, "h", "no parent"), (0, 10, "k", None), (0, 12, "k", None), (0, 13, "k.n", None), (1, 17, "a", ""), (1, 18, "b", "q"), (1, 19, "a.b-c", "'")]
    assert got == sorted(want * 2)


def test_properties(spark):
    text = "nacos.config.server-addr=a:1\nnacos.config.ext-config[0].data-id=one\nnacos.config.ext-config[1].data-id=${two}\nnacos.config.ext-config[1].group=G\n# no=1\nx=a\\\n"
    p = settings.properties(one(spark, text), "text", "host")
    assert p.where("not plain").count() == 1
    f = settings.properties_as_fields(p, "host")
    got = sorted((r["index"], r["address"], r["group"], r["data_id"], r["resolved"]) for r in settings.extension_declarations(f, "host").collect())
    assert got == [(0, "a:1", "DEFAULT_GROUP", "one", True), (1, "a:1", "G", "${two}", False)]
    ids = "app string, address string, namespace string, group string, data_id string"
    wanted = settings.merge_declarations(spark.createDataFrame([("p", "a", "n", "g", "x")], ids), spark.createDataFrame([("p", "a", "n", "g", "x"), ("p", "a", "n", "g", "y"), ("p", "a", "n", "g", "z")], ids), "app")
    got = {r["data_id"]: r["status"] for r in settings.missing_or_warning(wanted, spark.createDataFrame([("p", "a", "n", "g", "z")], ids), "app").collect()}
    assert got == {"x": "warning", "y": "missing", "z": "fetched"}


POM = "<project xmlns='http://maven.apache.org/POM/4.0.0'>{}</project>"
FILES = [
    ("r", "pom.xml", POM.format("<artifactId>root</artifactId><modules><module>web</module><module>./lib</module></modules>")),
    ("r", "web/pom.xml", POM.format("<artifactId>shop</artifactId><packaging>war</packaging><build><finalName>${artifactId}</finalName><resources><resource><directory>conf</directory><includes><include>**/*.yml</include></includes><excludes><exclude>test/**</exclude></excludes></resource></resources></build>")),
    ("r", "lib/pom.xml", POM.format("<artifactId>lib</artifactId><build><finalName>${unknown}</finalName></build>")),
    ("r", "apart/pom.xml", POM.format("<artifactId>shop</artifactId><build><finalName>shop</finalName></build>")),
    ("r", "web/conf/application-dev.yml", ""), ("r", "web/conf/a/prod/x.yml", ""), ("r", "web/conf/test/no.yml", ""), ("r", "web/conf/a.xml", ""), ("r", "lib/src/main/resources/l.properties", ""),
    ("q", "one/pom.xml", POM.format("<artifactId>a</artifactId>")), ("q", "two/pom.xml", "<broken"),
]


def test_builds(spark):
    files = spark.createDataFrame(FILES, "repository string, path string, content string")
    nodes = settings.build_files(files)
    assert {(r["repository"], r["path"]) for r in settings.reachable_builds(nodes).collect()} == {("r", "pom.xml"), ("r", "web/pom.xml"), ("r", "lib/pom.xml"), ("q", "one/pom.xml")}
    apps = spark.createDataFrame([("r", "shop", "war"), ("r", "lib", "jar"), ("r", "none", "jar"), ("q", "one", "jar")], "repository string, app string, kind string")
    modules = settings.find_modules(nodes, apps)
    got = {(r["repository"], r["app"]): (r["module"], r["basis"], r["status"]) for r in modules.collect()}
    assert got == {("r", "shop"): ("web", "finalName by artifact", "unique"), ("r", "lib"): ("lib", "folder", "unique"), ("r", "none"): (None, None, "none"), ("q", "one"): ("one", "folder", "unique")}
    rules = settings.resource_rules(nodes, modules)
    assert {r["source"] for r in rules.collect()} == {"web/conf", "lib/src/main/resources", "one/src/main/resources"}
    got = {(r["app"], r["relative"], r["environment"]) for r in settings.configuration_files(files, modules, rules).collect()}
    assert got == {("shop", "application-dev.yml", "dev"), ("shop", "a/prod/x.yml", "prod"), ("lib", "l.properties", "other")}
