"""Reports and parsers on the driver's tables, with SQL for each: suppliers are inspected hosts, parts their processes, texts are made of columns and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import graph
from tidegrid.plans import managed, reports
from tidegrid.plans.driver_queries import EDGE_SQL, NODE_SQL, query, star_edges, star_nodes, table
from tidegrid.sources import parsers, sinks, snapshots

c = F.col
HOST = "'10.2.' || s_suppkey // 250 || '.' || s_suppkey % 250"


def host(k):
    return F.concat(F.lit("10.2."), (k / 250).cast("long"), F.lit("."), k % 250)


def inspected(spark, d, crowded: bool = False) -> dict[str, DataFrame]:
    """Hosts, their processes, machines and what should run there: twenty parts in a row are the processes of a supplier, fifteen customers in a row its applications.

    crowded: a part is a process of the supplier with its number modulo 97, a customer an application of the one modulo 89, so that few hosts have all.
    """
    k = c("p_partkey")
    s = table(spark, d, "supplier")
    at = c("s_suppkey")
    t = {"assets": s.where(at % 4 != 0).select(F.concat(F.lit("as"), at).alias("id"), F.concat(F.lit("Host"), at).alias("hostname"), host(at).alias("ip"), F.when(at % 4 == 1, "can_login").otherwise("cannot_login").alias("loginStatus"))}
    t["specs"] = s.where(at % 3 == 0).select(host(at).alias("ip"), F.when(at % 2 == 0, "can_login").alias("loginStatus"), (at % 8).cast("int").alias("cpu"), F.lit(8000).alias("memoryMB"))
    t["compute"] = s.where(at % 5 == 0).select(F.concat(F.lit("m"), at).alias("id"), F.array(host(at)).alias("privateIps"), F.array().cast("array<string>").alias("publicIps"), F.lit(2).alias("cpu"), F.lit(3.5).alias("memoryGiB"))
    name = F.when(k % 4 == 0, "java").when(k % 4 == 1, "nginx").when(k % 4 == 2, "redis-server").otherwise("init")
    command = F.when(k % 4 == 0, F.concat(F.lit("java -jar /srv/app"), k % 50, F.lit(".jar"))).when(k % 4 == 1, F.when(k % 8 == 1, "nginx: master process").otherwise("nginx: worker process")).when(k % 4 == 2, "redis-server *:6379").otherwise("/sbin/init")
    p = table(spark, d, "part").select(host(k % 97 if crowded else F.expr("p_partkey div 20")).alias("asset_ip"), k.cast("int").alias("pid"), name.alias("name"), command.alias("command"), (k % 4 == 3).alias("system"), F.date_format(F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, p_partkey)"), "yyyy-MM-dd HH:mm:ss").alias("startedAt"), F.array(F.struct((k % 7).cast("int").alias("port"), F.lit("*").alias("address"), F.lit("tcp").alias("protocol"))).alias("ports"))
    t["processes"] = p
    ck = c("c_custkey")
    t["apps"] = table(spark, d, "customer").select(F.concat(F.lit("a"), ck).alias("id"))
    t["deployments"] = table(spark, d, "customer").select(F.concat(F.lit("a"), ck).alias("app_id"), F.concat(F.lit("App-"), ck % 50).alias("app_name"), F.lit("P").alias("env"), host(ck % 89 if crowded else F.expr("c_custkey div 15")).alias("ip"))
    t["app_ports"] = s.where(at % 10 == 0).select(host(at).alias("asset_ip"), F.lit(443).alias("port"))
    return t


INSPECTED = f"""
s AS (SELECT s_suppkey AS k, {HOST} AS ip, s_suppkey % 4 <> 0 AS known, s_suppkey % 4 = 1 AS login, s_suppkey % 3 = 0 AS spec, s_suppkey % 5 = 0 AS machine FROM supplier),
state AS (SELECT *, CASE WHEN NOT known THEN 'not_collected' WHEN spec AND k % 2 = 0 THEN 'can_login' WHEN spec AND k % 8 > 0 THEN 'can_login' WHEN login THEN 'can_login' ELSE 'cannot_login' END AS state FROM s),
p AS (SELECT p_partkey AS pid, p_partkey // 20 AS h, p_partkey % 4 AS kind, p_partkey % 50 AS app, p_partkey % 7 AS port FROM part),
d AS (SELECT c_custkey AS k, c_custkey % 50 AS app, c_custkey // 15 AS h FROM customer)"""
CROWDED = INSPECTED.replace("p_partkey // 20", "p_partkey % 97").replace("c_custkey // 15", "c_custkey % 89")


@query(f"""
WITH {INSPECTED}
SELECT ip, state, CASE WHEN spec AND k % 8 > 0 THEN (k % 8) || 'C 8G' WHEN machine THEN '2C 3.5G' ELSE '' END AS spec FROM state
""")
def server_states(spark, d):
    """Whether each host can be looked into, and its size."""
    t = inspected(spark, d)
    return managed.server_states(t, table(spark, d, "supplier").select(host(c("s_suppkey")).alias("ip")))


@query(f"""
WITH {INSPECTED}
SELECT '10.2.' || h // 250 || '.' || h % 250 AS ip, CASE kind WHEN 0 THEN 'Java Jar' WHEN 1 THEN 'Nginx' ELSE 'Redis' END AS kind, count(*) AS n FROM p WHERE kind < 3 AND NOT (kind = 1 AND pid % 8 <> 1) GROUP BY ALL
""")
def process_categories(spark, d):
    """Processes of each type on each host, without system ones and proxy workers."""
    return reports.process_categories(inspected(spark, d)["processes"])


@query(f"""
WITH {INSPECTED}, o AS (SELECT h, list_sort(list(DISTINCT port)) AS ports FROM p GROUP BY 1)
SELECT ip, CASE WHEN k % 10 = 0 THEN '443' ELSE array_to_string(ports, ',') END AS ports FROM s LEFT JOIN o ON k = h WHERE known
""")
def listening_ports(spark, d):
    """A host's ports as inspected, else those of its processes."""
    return reports.listening_ports(inspected(spark, d)).select("ip", F.array_join("ports", ",").alias("ports"))


MATCHED = """
m AS (SELECT d.k, d.app, d.h, min(pid) AS pid FROM d JOIN p ON p.h = d.h AND kind = 0 AND (CAST(p.app AS VARCHAR) LIKE d.app || '%' OR CAST(d.app AS VARCHAR) LIKE p.app || '%') GROUP BY ALL)"""


@query(f"""
WITH {INSPECTED}, {MATCHED}
SELECT '10.2.' || d.h // 250 || '.' || d.h % 250 AS ip, 'a' || d.k AS app_id, m.pid::INTEGER AS pid, CASE WHEN m.pid IS NOT NULL THEN 'process' ELSE 'missing' END AS status FROM d JOIN s ON s.k = d.h AND known LEFT JOIN m ON m.k = d.k
""")
def server_comparison(spark, d):
    """What should run on each inspected host against what does."""
    return reports.server_comparison(inspected(spark, d)).where("status <> 'extra'").select("ip", "app_id", "pid", "status")


@query(f"""
WITH {CROWDED}, {MATCHED}
SELECT 'a' || d.k AS app_id, coalesce(known AND m.pid IS NULL, FALSE) AS unmatched, NOT coalesce(known, FALSE) AS not_collected FROM d LEFT JOIN s ON s.k = d.h LEFT JOIN m ON m.k = d.k
""")
def process_status(spark, d):
    """Applications a server of which lacks their process or isn't collected."""
    return managed.process_status(inspected(spark, d, crowded=True)).select("app_id", F.coalesce("unmatched", F.lit(False)).alias("unmatched"), "not_collected")


@query(f"""
WITH {CROWDED}, {MATCHED}
SELECT 'a' || d.k AS app_id, 'P' AS env, TIMESTAMP '2024-01-01' - INTERVAL 8 HOUR + to_hours(m.pid::BIGINT) AS at FROM d LEFT JOIN m ON m.k = d.k
""".replace(" AS at FROM", ' AS "at" FROM'))
def latest_deployment(spark, d):
    """When each application was last started, by its processes."""
    none = spark.createDataFrame([], "ip string, name string, mtime timestamp")
    return managed.latest_deployment(inspected(spark, d, crowded=True), none)


@query(f"""
WITH {INSPECTED}
SELECT ip, CASE WHEN known THEN 'Host' || k ELSE ip END AS hostname, known AS managed, (SELECT count(DISTINCT h) FROM d WHERE d.h = state.k)::BIGINT AS environments FROM state
""")
def summary_rows(spark, d):
    """One row an address: its name, whether it is managed, in how many environments it is."""
    r = managed.summary_rows(inspected(spark, d), table(spark, d, "supplier").select(host(c("s_suppkey")).alias("ip")))
    return r.select("ip", "hostname", "managed", F.size("environments").cast("long").alias("environments"))


@query("""
WITH x AS (SELECT s_suppkey AS k, s_suppkey % 3 AS twin FROM supplier)
SELECT 'as' || k AS asset, CASE WHEN twin = 0 THEN 'm' || k END AS machine, CASE twin WHEN 0 THEN 'matched' WHEN 1 THEN 'ambiguous' ELSE 'unmatched' END AS status FROM x
""")
def asset_machines(spark, d):
    """Assets with their machine, where addresses say so both ways."""
    k = c("s_suppkey")
    s = table(spark, d, "supplier")
    machines = s.where(k % 3 < 2).select(F.concat(F.lit("m"), k).alias("id"), F.array(host(k)).alias("privateIps"), F.array().cast("array<string>").alias("publicIps"))
    twins = s.where(k % 3 == 1).select(F.concat(F.lit("t"), k).alias("id"), F.array().cast("array<string>").alias("privateIps"), F.array(host(k)).alias("publicIps"))
    return reports.one_to_one(s.select(F.concat(F.lit("as"), k).alias("id"), host(k).alias("ip")), machines.unionByName(twins))


@query("""
SELECT 'c' || s_nationkey AS key, count(DISTINCT s_suppkey % 20) AS balancers, count(DISTINCT (s_suppkey % 20, s_suppkey % 3)) AS listeners FROM supplier GROUP BY 1
""")
def certificates(spark, d):
    """Certificates with the balancers and listeners that use them."""
    k = c("s_suppkey")
    cert = F.array(F.struct(F.concat(F.lit("c"), "s_nationkey").alias("id"), F.lit("n").alias("name"), F.lit("d").alias("domain"), F.lit("cn").alias("commonName"), F.lit("2030-01-01").alias("expiresAt")))
    l = table(spark, d, "supplier").select(F.concat(F.lit("lb"), k % 20).alias("lb"), F.lit("x").alias("lb_name"), F.lit("https").alias("protocol"), (443 + k % 3).cast("string").alias("port"), cert.alias("certificates"))  # noqa: E741
    return reports.certificates(l).select("key", "balancers", F.size("listeners").cast("long").alias("listeners"))


@query("""
SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'default only' WHEN s_suppkey % 7 = 0 THEN 'several groups' ELSE n_name END AS "group", count(*) AS assets FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1
""")
def top_groups(spark, d):
    """Assets of each top group, of several and of none."""
    k = c("s_suppkey")
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), c("s_nationkey") == c("n_nationkey")).select(k.cast("string").alias("id"), "n_name", k)
    named = s.where(k % 5 != 0).groupBy(c("n_name").alias("name")).agg(F.collect_set("id").alias("assetIds"))
    other = s.where((k % 5 != 0) & (k % 7 == 0)).agg(F.lit("zz other").alias("name"), F.collect_set("id").alias("assetIds"))
    return reports.top_groups(s.select("id"), named.unionByName(other).withColumn("parentKey", F.lit("1")))


@query("""
WITH r AS (SELECT c_custkey AS k, n_nationkey AS n, n_regionkey AS g FROM customer JOIN nation ON c_nationkey = n_nationkey), x AS (SELECT 'g' || g AS path, k FROM r UNION ALL SELECT 'g' || g || '/n' || n, k FROM r)
SELECT path, count(*) FILTER (WHERE k % 2 = 0) AS listed, count(*) FILTER (WHERE k % 2 = 0 AND k % 3 = 0) AS linked, count(*) FILTER (WHERE k % 5 = 0) AS accessible, count(*) FILTER (WHERE k % 4 = 0) AS unused FROM x GROUP BY 1
""")
def repository_groups(spark, d):
    """Each group with its repositories at any depth."""
    k = c("c_custkey")
    m = table(spark, d, "customer").join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    top, sub = F.concat(F.lit("g"), "n_regionkey"), F.concat(F.lit("g"), "n_regionkey", F.lit("/n"), "n_nationkey")
    r = m.select(F.concat(sub, F.lit("/r"), k).alias("path"), (k % 2 == 0).alias("inCodeup"), F.when(k % 3 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("apps"), F.when(k % 5 == 0, "yes").otherwise("no").alias("access"), F.when(k % 4 == 0, "codeup_only").otherwise("both").alias("difference"))
    groups = m.select(top.alias("path")).union(m.select(sub)).distinct().select(c("path").alias("id"), c("path").alias("name"), "path")
    return reports.repository_groups(r, groups).select("path", "listed", "linked", "accessible", "unused")


@query("""
SELECT p_partkey, CASE WHEN p_size + 14 > 0 THEN round((p_size + 14 - 10 - 1) * 100.0 / (p_size + 14), 1) ELSE 0 END::DOUBLE AS cpu, round((1000 - p_size * 10) * 100.0 / 1000, 1)::DOUBLE AS memory FROM part
""")
def usage_percent(spark, d):
    """Shares of processor time and memory in use, from counters."""
    n, zero = c("p_size").cast("long"), F.lit(0).cast("long")
    before, after = F.array(zero, zero, zero, zero, zero), F.array(n, F.lit(3).cast("long"), zero, F.lit(10).cast("long"), F.lit(1).cast("long"))
    return table(spark, d, "part").select("p_partkey", reports.cpu_percent(before, after).cast("double").alias("cpu"), reports.memory_percent(F.lit(1000), F.when(c("p_partkey") % 2 == 0, n * 10), n * 4, n * 3, n * 3).cast("double").alias("memory"))


# texts made of columns and read back --------------------------------------------------------------
def joined_lines(df: DataFrame, key: str, order: str, line) -> DataFrame:
    """(key, text): the lines of a key's rows by order."""
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


@query("""
SELECT p_size AS host, p_partkey::INTEGER AS pid, (p_partkey // 2)::INTEGER AS ppid, 'u' || p_partkey % 3 AS "user", p_partkey * 10 AS elapsed_s, 'java' AS name, 'java -Dname=' || replace(p_name, ' ', '_') || ' --token=***' AS command, 'Other Java' AS kind FROM part
""")
def process_listing(spark, d):
    """Processes read from terminal listings, their secrets hidden."""
    k = c("p_partkey")
    line = F.concat_ws(" ", F.concat(F.lit("  "), k), F.expr("p_partkey div 2"), F.concat(F.lit("u"), k % 3), k * 10, F.lit("java"), F.concat(F.lit("java -Dname="), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" --token=abc"), k))
    text = joined_lines(table(spark, d, "part"), "p_size", "p_partkey", line).select(c("p_size").alias("host"), F.concat(F.lit("  PID  PPID USER ELAPSED COMMAND COMMAND\n"), "text", F.lit("\n\n")).alias("text"))
    return parsers.processes(text, "text", "host").where("well_formed").drop("well_formed")


@query("""
SELECT p_size AS host, CASE WHEN p_partkey % 4 = 3 THEN 'udp' ELSE 'tcp' END AS protocol, CASE p_partkey % 3 WHEN 0 THEN '0.0.0.0' WHEN 1 THEN '::' ELSE '127.0.0.1' END AS address, (1000 + p_partkey)::INTEGER AS port, CASE WHEN p_partkey % 5 > 0 THEN p_partkey END::INTEGER AS pid FROM part
""")
def listener_listing(spark, d):
    """Listeners read from terminal listings; hidden processes stay without pid."""
    k = c("p_partkey")
    address = F.when(k % 3 == 0, "0.0.0.0").when(k % 3 == 1, "[::]").otherwise("127.0.0.1%lo")
    owner = F.when(k % 5 > 0, F.concat(F.lit(' users:(("java",pid='), k, F.lit(',fd=9),("java",pid='), k, F.lit(",fd=8))"))).otherwise("")
    line = F.concat(F.when(k % 4 == 3, "udp   UNCONN 0 0 ").otherwise("tcp   LISTEN 0 128 "), address, F.lit(":"), 1000 + k, F.lit("   0.0.0.0:*"), owner)
    text = joined_lines(table(spark, d, "part"), "p_size", "p_partkey", line).select(c("p_size").alias("host"), F.concat(F.lit("Netid State Recv-Q Send-Q Local Peer\n"), "text").alias("text"))
    return parsers.listeners(text, "text", "host")


@query("""
SELECT p_size AS host, p_partkey::INTEGER AS port, (p_partkey % 4)::INTEGER AS uid FROM part WHERE p_partkey % 2 = 0
""")
def socket_listing(spark, d):
    """Listening ports and their users read from the kernel's table."""
    k = c("p_partkey")
    line = F.concat(F.lit("  "), k, F.lit(": 00000000:"), F.lpad(F.hex(k), F.greatest(F.length(F.hex(k)), F.lit(4)), F.lit("0")), F.lit(" 00000000:0000 "), F.when(k % 2 == 0, "0A").otherwise("01"), F.lit(" 00000000:00000000 00:00000000 00000000  "), k % 4, F.lit("        0 12345"))
    text = joined_lines(table(spark, d, "part"), "p_size", "p_partkey", line).select(c("p_size").alias("host"), "text")
    return parsers.hex_sockets(text, "text", "host")


@query("""
WITH x AS (SELECT c_nationkey AS host, c_custkey % 300 AS k, min(c_custkey) AS first FROM customer GROUP BY 1, 2)
SELECT host, CASE WHEN k % 5 = 0 THEN 'bad' || k ELSE 'code.example.com/team/r' || k END AS key, k % 5 <> 0 AS valid FROM x
""")
def repository_lists(spark, d):
    """Repositories of pasted lists, each once, in any form; what is none stays."""
    k = c("c_custkey") % 300
    form = F.when(k % 5 == 0, F.concat(F.lit("bad"), k)).when(c("c_custkey") % 2 == 0, F.concat(F.lit("- [r](https://code.example.com/team/r"), k, F.lit(".git)"))).otherwise(F.concat(F.lit("git@code.example.com:team/r"), k, F.lit(".git")))
    text = joined_lines(table(spark, d, "customer"), "c_nationkey", "c_custkey", form).select(c("c_nationkey").alias("host"), "text")
    found = parsers.git_list(text, "text", "host")
    return found.select("host", F.when(c("valid"), c("key")).otherwise(c("input")).alias("key"), "valid")


@query("""
SELECT DISTINCT c_nationkey AS host, CASE WHEN c_custkey % 4 = 0 THEN '10.0.0.999' ELSE '10.0.0.' || c_custkey % 200 END AS ip, c_custkey % 4 <> 0 AS valid FROM customer
""")
def address_lists(spark, d):
    """Addresses of pasted lists, each once."""
    form = F.when(c("c_custkey") % 4 == 0, "10.0.0.999").otherwise(F.concat(F.lit("10.0.0."), c("c_custkey") % 200))
    text = joined_lines(table(spark, d, "customer"), "c_nationkey", "c_custkey", F.concat(form, F.lit("；  ")))
    return parsers.ip_list(text.select(c("c_nationkey").alias("host"), "text"), "text", "host").select("host", "ip", "valid")


@query("SELECT p_partkey::VARCHAR AS p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '''=' || p_name ELSE p_name END AS name FROM part")
def csv_roundtrip(spark, d):
    """Rows written as CSV with guarded cells and read again."""
    rows = table(spark, d, "part").select("p_partkey", F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("="), "p_name")).otherwise(c("p_name")).alias("name"))
    path = graph.scratch(spark, "csv")
    sinks.write_csv(rows, path)
    return snapshots.read_table(spark, path, ["p_partkey", "name"]).select("p_partkey", "name")


@query("""
SELECT c_custkey % 50 AS service, count(*) AS runs, max(CASE WHEN c_custkey % 3 > 0 THEN TIMESTAMP '2024-01-01' - INTERVAL 8 HOUR + to_hours(c_custkey) END) AS last FROM customer GROUP BY 1
""")
def push_steps(spark, d):
    """The latest successful push of each service, from its steps."""
    k = c("c_custkey")
    end = F.date_format(F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, c_custkey)"), "yyyy-MM-dd HH:mm:ss")
    steps = table(spark, d, "customer").select((k % 50).alias("service"), F.when(k % 2 == 0, "Push-In").otherwise("push in").alias("operation"), F.when(k % 3 > 0, "SUCCESS").otherwise("FAILED").alias("status"), F.when(k % 5 == 0, end).alias("startTime"), F.when(k % 5 > 0, end).otherwise("").alias("endTime"))
    n = steps.groupBy("service").agg(F.count("*").alias("runs"))
    return n.join(parsers.latest_push(steps, ["service"]).select("service", c("at").alias("last")), "service", "left")


# the graph ---------------------------------------------------------------------------------------
@query(f"""
WITH n AS ({NODE_SQL}), e AS ({EDGE_SQL}), a1 AS (SELECT DISTINCT dst AS id FROM e WHERE src = 'region:2'), a2 AS (SELECT DISTINCT dst AS id FROM e JOIN a1 ON src = id), a3 AS (SELECT DISTINCT dst AS id FROM e JOIN a2 ON src = id)
SELECT type, count(*) AS nodes, min(d)::INTEGER AS nearest FROM (SELECT id, min(d) AS d FROM (SELECT 'region:2' AS id, 0 AS d UNION ALL SELECT id, 1 FROM a1 UNION ALL SELECT id, 2 FROM a2 UNION ALL SELECT id, 3 FROM a3) GROUP BY 1) JOIN n USING (id) GROUP BY 1
""")
def reachable_types(spark, d):
    """What a region leads to within three steps, by type."""
    start = spark.createDataFrame([("region:2",)], "id string")
    return graph.reachable_types(star_nodes(spark, d), graph.adjacency(star_edges(spark, d), directed=True), start, depth=3)


@query(f"""
WITH e AS (SELECT src, dst, CASE WHEN type = 'HAS' THEN 'GLOBAL' WHEN type = 'PLACED' THEN 'PRODUCT' ELSE 'TEST' END AS env FROM ({EDGE_SQL}))
SELECT env, count(*) * 2 AS steps, count(DISTINCT src) AS sources FROM e WHERE env IN ('GLOBAL', 'TEST') GROUP BY 1
""")
def environment_steps(spark, d):
    """Steps that a search in one environment may take, both ways."""
    edges = star_edges(spark, d).withColumn("env", F.when(c("type") == "HAS", "GLOBAL").when(c("type") == "PLACED", "PRODUCT").otherwise("TEST"))
    steps = graph.adjacency(edges, ["TEST"])
    forward = graph.adjacency(edges, ["TEST"], directed=True).groupBy("env").agg(F.countDistinct("node").alias("sources"))
    return steps.groupBy("env").agg(F.count("*").alias("steps")).join(forward, "env")
