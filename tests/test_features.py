"""Log scopes, memos, quarantine, workbooks, rotated logs, retirement, origins and blocks on small tables with odd rows."""

from __future__ import annotations

import itertools
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import strings
from tidegrid.operators import memo
from tidegrid.plans import reports
from tidegrid.sources import applogs, sinks, workbook


def test_roots_of_processes(spark):
    rows = [
        ("tom", "java -Dcatalina.base=/opt/apps/tomcat_pay -Dappid=pay start", "/"), ("jar", "java -jar lib/x.jar --spring.config.location=optional:file:/data/conf/pay/a.yml,/data/conf/more/", "/srv/apps/pay/bin"),
        ("abs", "java -jar /srv/apps/../apps/shop//shop.jar", None), ("name", "x --spring.application.name=a/b -Dappid=.. -Dappid=123 -Dappid=ok", ""), ("flat", "java -jar /opt/x.jar", "/opt"), ("none", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, command string, cwd string")
    got = {}
    for r in applogs.file_roots(df, ["id"]).orderBy("id", "kind", "place").collect():
        got.setdefault((r.id, r.kind), []).append(r.root)
    assert got[("tom", "config")] == ["/opt/apps/tomcat_pay/conf", "/var/www/webapps/pay/WEB-INF", "/var/www/webapps/pay/config", "/opt/apps/tomcat_pay/webapps/ROOT/WEB-INF", "/opt/apps/tomcat_pay/webapps/ROOT/config"]
    assert got[("tom", "log")] == ["/opt/apps/tomcat_pay/logs", "/opt/apps/tomcat_pay/webapps/ROOT/logs", "/var/www/webapps/pay/logs"]
    assert got[("jar", "config")] == ["/srv/apps/pay/bin", "/srv/apps/pay/bin/config", "/data/conf/pay", "/data/conf/more", "/srv/apps/pay/bin/WEB-INF", "/srv/apps/pay/bin/conf", "/srv/apps/pay/config", "/srv/apps/pay/conf"]
    assert got[("jar", "log")] == ["/srv/apps/pay/bin/logs", "/srv/apps/pay/logs"]
    assert got[("abs", "log")] == ["/srv/apps/shop/logs"] and got[("name", "log")] == ["/var/www/webapps/ok/logs"]
    assert ("none", "log") not in got and ("flat", "log") not in got


def test_log_scopes(spark):
    text = """<configuration xmlns="u"><property name="base" value="/data/logs/${app}"/><property name="app" value="shop"/><property name="app" value="shop"/>
    <property name="twice" value="a"/><property name="twice" value="b"/><property name="x" value="${y}"/><property name="y" value="${x}"/><property name="both" value="${app}-${base}"/>
    <appender><file> ${base}/a[1].log </file><rollingPolicy><fileNamePattern>${base}/a-%d{yyyy, MM}.%i.log</fileNamePattern></rollingPolicy></appender>
    <file>${twice}/b.log</file><file>${x}/c.log</file><file>/logs/d.log</file><file>/data/logs/app/%d.log</file><file>rel/e.log</file><file>/data/logs/${none}/f.log</file><file>/var/log/${both}/../g.log</file></configuration>"""
    files = spark.createDataFrame([("f", text), ("bad", "<a><file>/x/y/z/q.log</file>"), ("null", None)], "file string, text string")
    properties, paths = applogs.logging_elements(files)
    got = {r.path: (r.root, r.pattern, r.status, r.unresolved) for r in applogs.log_scopes(properties, paths).collect()}
    assert got == {
        "${base}/a[1].log": ("/data/logs/shop", "a[[]1].log", "ok", []), "${base}/a-%d{yyyy, MM}.%i.log": ("/data/logs/shop", "a-*.*.log", "ok", []), "${twice}/b.log": (None, None, "unresolved", ["twice"]), "${x}/c.log": (None, None, "cycle", ["y"]),
        "/logs/d.log": (None, None, "shallow", []), "/data/logs/app/%d.log": (None, None, "open", []), "rel/e.log": (None, None, "relative", []), "/data/logs/${none}/f.log": (None, None, "unresolved", ["none"]), "/var/log/${both}/../g.log": ("/var/log/shop-/data/logs", "g.log", "ok", []),
    }
    given = spark.createDataFrame([("f", "twice", "/data/logs/given"), ("f", "x", "/data/logs/x")], "file string, name string, value string")
    got = {r.path: (r.root, r.status) for r in applogs.log_scopes(properties, paths, given).collect()}
    assert got["${twice}/b.log"] == ("/data/logs/given", "ok") and got["${x}/c.log"] == ("/data/logs/x", "ok")
    chain = spark.createDataFrame([("f", f"p{i}", f"${{p{i + 1}}}") for i in range(9)] + [("f", "p9", "/a/b/c")], "file string, name string, value string")
    ends = spark.createDataFrame([("f", f"${{p{i}}}/x.log") for i in range(10)], "file string, path string")
    assert {r.path: r.status for r in applogs.log_scopes(chain, ends).collect()} == {f"${{p{i}}}/x.log": "ok" if i >= 5 else "cycle" for i in range(10)}
    assert applogs.log_scopes(chain, ends.limit(0)).collect() == []


def test_each_pass_of_log_scopes_is_written_once(spark, monkeypatch):
    """No table is written by the joins of several passes together; paths that end early, late or never keep their rounds."""
    joins = []

    def settle(df, name="graph"):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return written(df, name)

    written = applogs.settle
    monkeypatch.setattr(applogs, "settle", settle)
    chain = spark.createDataFrame([("f", "a", "${b}/a"), ("f", "b", "${c}/b"), ("f", "c", "/root/of/c"), ("f", "loop", "${loop}"), ("f", "two", "1"), ("f", "two", "2")], "file string, name string, value string")
    paths = [("f", x) for x in ("/no/name/x.log", "${a}/x.log", "${b}-${c}.log", "${c}/x.log", "${loop}", "${two}/x.log", "${none}", "${c}/x.log")] + [(None, "${a}"), ("g", "${a}")]
    got = {(r.file, r.path): (r.resolved, r.rounds, r.unresolved, r.cycle) for r in applogs.substituted(chain, spark.createDataFrame(paths, "file string, path string")).collect()}
    assert max(joins) <= 2
    assert got.pop((None, "${a}"))[:2] == ("${a}", 0)
    assert got == {
        ("f", "/no/name/x.log"): ("/no/name/x.log", 0, [], False), ("f", "${a}/x.log"): ("/root/of/c/b/a/x.log", 3, [], False), ("f", "${b}-${c}.log"): ("/root/of/c/b-/root/of/c.log", 2, [], False), ("f", "${c}/x.log"): ("/root/of/c/x.log", 1, [], False),
        ("f", "${loop}"): ("${loop}", 5, ["loop"], True), ("f", "${two}/x.log"): ("${two}/x.log", 0, ["two"], False), ("f", "${none}"): ("${none}", 0, ["none"], False), ("g", "${a}"): ("${a}", 0, ["a"], False),
    }


def test_memo(spark, tmp_path):
    """A second run evaluates nothing, a new key one row, stale keys again; what a run has written before it fails stays."""
    asked = []

    def check(keys):
        got = sorted(r.key for r in keys.collect())
        asked.append(got)
        return keys.where("key <> 'never'").select("key", F.concat(F.lit("v-"), "key").alias("status"))

    m = memo.Memo(spark, f"file://{tmp_path}/memo", "status string")
    owners = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "never")], "id int, key string")
    day = lambda n: datetime(2024, 1, n)
    out, progress = m.evaluate(owners, check, day(1))
    assert {r.id: r.status for r in out.collect()} == {1: "v-a", 2: "v-a", 3: "v-b", 4: None, 5: None} and progress == {"keys": 3, "known": 0, "checked": 2, "left": 1}
    out, progress = m.evaluate(owners.where("id < 5"), check, day(2))
    assert asked[1] == [] and progress == {"keys": 2, "known": 2, "checked": 0, "left": 0}
    more = owners.unionByName(spark.createDataFrame([(6, "c"), (7, "d")], owners.schema))
    out, progress = m.evaluate(more.where("id <> 5"), check, day(3), most_keys=1)
    assert asked[2] == ["c"] and progress == {"keys": 4, "known": 2, "checked": 1, "left": 1}
    out, progress = m.evaluate(more.where("id <> 5"), check, day(4), stale_before=day(3))
    assert asked[3] == ["a", "b", "d"] and progress == {"keys": 4, "known": 1, "checked": 3, "left": 0}
    for run in sorted((tmp_path / "memo").glob("run=*")):
        (run / "_SUCCESS").unlink()
    assert m.rows().count() == 0


def test_quarantine(spark):
    rows = spark.createDataFrame([(1, "active", 5), (2, "locked", 5), (3, "locked", -1), (4, None, None)], "id int, status string, n int")
    good, bad, report = memo.quarantine(rows, [("inactive", F.col("status") == "locked"), ("negative", F.col("n") < 0)])
    assert sorted(r.id for r in good.collect()) == [1, 4] and {r.id: r.reasons for r in bad.collect()} == {2: ["inactive"], 3: ["inactive", "negative"]}
    assert report == {"rows": 4, "quarantined": 2, "partial": True, "reasons": {"inactive": 2, "negative": 1}} and good.columns == rows.columns
    assert memo.quarantine(rows.limit(0), [("x", F.lit(True))])[2] == {"rows": 0, "quarantined": 0, "partial": False, "reasons": {"x": 0}}


def test_repaired_references(spark):
    """Fetched rows name others; what comes back under another key, or not at all, is lost; a cycle ends."""
    every = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "x"), ("e", None)], "id string, next string")
    calls = []

    def fetch(keys):
        calls.append(sorted(r.id for r in keys.collect()))
        return every.join(keys, "id", "left_semi").unionByName(spark.createDataFrame([("stray", None)], every.schema))

    have, gone = memo.repaired(every.where("id in ('a', 'd')"), "id", lambda rows: rows.select(F.col("next").alias("id")), fetch)
    assert {r.id: r.listed for r in have.collect()} == {"a": True, "d": True, "b": False, "c": False} and [r.id for r in gone.collect()] == ["x"] and calls == [["b", "x"], ["c"]]
    have, gone = memo.repaired(every, "id", spark.createDataFrame([("a",), (None,)], "id string"), fetch)
    assert have.count() == 5 and gone.count() == 0


def write_workbook(path, sheets, shared=()):
    """A workbook with inline strings, shared strings (ints are their numbers) and numbers (as text with a leading #); None leaves a cell out."""
    x = '<?xml version="1.0" encoding="UTF-8"?>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'{x}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{x}<Relationships xmlns="p">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'{x}<sst xmlns="{main}">' + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r><rPh><t>no</t></rPh></si>" for s in shared) + "</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            cell = lambda v, at: "" if v is None else f'<c r="{at}" t="s"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{at}"><v>{v[1:]}</v></c>' if v[:1] == "#" else f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
            body = "".join(f'<row r="{n}">' + "".join(cell(v, f"{chr(65 + k)}{n}") for k, v in enumerate(row)) + "</row>" for n, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f'{x}<worksheet xmlns="{main}"><dimension ref="A1:F{len(rows)}"/><sheetData>{body}</sheetData></worksheet>')


HEAD = [*workbook.DNS_COLUMNS.values(), "TTL值"]


def test_workbook(spark, tmp_path):
    spark.dataSource.register(workbook.WorkbookSource)
    sheets = {"Example.com.": [HEAD, ["a", "@", "default", "10.0.0.1", "on", "#600"], [None] * 6, [0, "WWW.", None, " 10.0.0.2 ", "off"], ["A", "x.example.com", "d", "v", "on"]], "example.net": [HEAD, ["A", "example.net", "d", "v", "on", "#1"]]}
    write_workbook(tmp_path / "dns.xlsx", sheets, ["cname"])
    for options in ({}, {"rows": "2"}):
        df = spark.read.format("workbook").options(**options).load(f"file://{tmp_path}/dns.xlsx")
        rows = {(r.sheet, r.row): r.cells for r in df.collect()}
        assert df.schema.simpleString() == "struct<file:string,sheet:string,row:int,cells:array<string>>" and len(rows) == 7
        assert rows["Example.com.", 4] == ["cname", "WWW.", None, " 10.0.0.2 ", "off"] and rows["Example.com.", 2][5] == "600"
        got = {r.id: (r.name, r.type, r.value, r.line, r.status, r.ttl) for r in workbook.dns_records(df, ["example.com", "example.net"]).collect()}
        assert got == {
            "example.com:2": ("example.com", "A", "10.0.0.1", "default", "on", "600"), "example.com:4": ("www.example.com", "CNAME", "10.0.0.2", "", "off", None),
            "example.com:5": ("x.example.com", "A", "v", "d", "on", None), "example.net:2": ("example.net", "A", "v", "d", "on", "1"),
        }
    with pytest.raises(ValueError, match="zones without a sheet"):
        workbook.dns_records(df, ["example.com", "example.net", "example.org"])
    with pytest.raises(ValueError, match="unsupported DNS zone: example.net"):
        workbook.dns_records(df, ["example.com"])
    write_workbook(tmp_path / "bad.xlsx", {"example.com": [HEAD[1:], ["@"]]})
    with pytest.raises(ValueError, match="missing DNS columns: bad.xlsx/example.com"):
        workbook.dns_records(spark.read.format("workbook").load(f"file://{tmp_path}/bad.xlsx"), ["example.com"])
    assert spark.read.format("workbook").load(f"file://{tmp_path}").select("file").distinct().count() == 2


def test_rotated_log(spark, tmp_path):
    log = sinks.RotatedLog(spark, f"file://{tmp_path}/log", most=2000)
    row = lambda i: (i, f"event {i} " + "x" * (i * 37 % 150), None)
    rows = lambda a, b: spark.createDataFrame([row(i) for i in reversed(range(a, b))], "n int, text string, none string").repartition(5)
    assert log.tail()[1] == {"files": 0, "truncated": False}
    assert log.append(rows(0, 300), ["n"]) == 300 and log.append(rows(300, 420), ["n"]) == 120 and log.append(rows(0, 0), ["n"]) == 0
    sizes = [n for _, n in log.files()]
    assert max(sizes) <= 2000 and len(sizes) > 20
    text = "".join((tmp_path / "log" / p.split("/log/")[1]).read_text() for p, _ in log.files()).splitlines()
    assert [int(x.split('"n":')[1].split(",")[0]) for x in text] == list(range(420)) and '"none":null' in text[0]
    last, report = log.tail(10, most=3000)
    assert [r.value for r in last.orderBy("line").collect()] == text[:-11:-1] and report["truncated"] and report["files"] <= 4
    everything, report = log.tail(1000, most=1 << 20)
    assert everything.count() == 420 and report == {"files": len(sizes), "truncated": False}
    with pytest.raises(ValueError, match="larger than a file"):
        log.append(spark.createDataFrame([(1, "y" * 3000)], "n int, text string"), ["n"])
    newest = sorted((tmp_path / "log").glob("run=*"))[-1]
    (newest / "_SUCCESS").unlink()
    assert len(log.files()) < len(sizes)


def test_retired_members(spark):
    """Every order of up to five events against a walk through them."""
    kinds, rows, want = ["seen", "retired", "confirmed", "absent"], [], {}
    for n in range(6):
        for k, events in enumerate(itertools.product(kinds, repeat=n)):
            if n == 5 and k % 7:
                continue
            key, state, since = f"{n}-{k}", None, None
            for i, e in enumerate(events):
                at = datetime(2024, 1, 1) + timedelta(hours=i)
                rows.append((key, at, e))
                if e == "seen" or (state is not None and kinds.index(e) == kinds.index(state) + 1):
                    state, since = e, at
            if n:
                want[key] = (state or "unknown", since)
    got = {r.key: (r.state, r.since) for r in reports.retired_members(spark.createDataFrame(rows, "key string, at timestamp, kind string"), "key").collect()}
    assert got == want


def test_origins(spark):
    connections = spark.createDataFrame([("10.0.0.1", 80, "10.0.0.2")] * 3 + [("10.0.0.1", 80, "10.0.0.9"), ("10.0.0.1", 81, "10.0.0.3"), ("10.0.0.1", 80, None)], "target string, port int, remote_ip string")
    assets = spark.createDataFrame([("a", "10.0.0.2, 10.0.0.7", 1), ("b", "10.0.0.2 10.0.0.3", 2), ("c", None, 3)], "asset string, ip string, ord int")
    probes = spark.createDataFrame([("a", "10.0.0.1", 80, "curl"), ("a", "10.0.0.1", 80, "java"), ("a", "10.0.0.1", 81, "no"), ("b", "10.0.0.5", 81, "no")], "asset string, dest_ip string, dest_port int, process string")
    df = reports.trace_origins(connections, assets, probes)
    assert sorted(map(str, ((r.port, r.origin, r.asset, r.process, r.status) for r in df.collect()))) == sorted(map(str, [(80, "10.0.0.2", "a", "curl", "attributed"), (80, "10.0.0.2", "a", "java", "attributed"), (80, "10.0.0.9", None, None, "not in assets"), (81, "10.0.0.3", "b", None, "no process")]))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("LeftOuter") < plan.index("LeftSemi")  # probes are reduced below the join that attributes them


def test_location_block(spark):
    text = "server {\n  location   /a {\n    # } not\n    x '}' \"{\";\n    if ($b) { y; }\n  }\n  location ~ \\.php$ # c\n  {\n    z \\};\n  }\n  location /open {\n"
    find = lambda uri: spark.createDataFrame([(text,)], "t string").select(strings.location_block(F.col("t"), F.lit(uri)).alias("x")).first().x
    assert tuple(find("/a")) == (1, 5) and tuple(find("~   \\.php$")) == (6, 9)
    assert find("/open") is None and find("/ab") is None and find(" ") is None
    assert spark.createDataFrame([(None,)], "t string").select(strings.location_block(F.col("t"), F.lit("/a")).alias("x")).first().x is None
