"""A site made of the driver's tables, for the topology, request tracing and domain chains, with SQL for each.

Every customer is an application with one deployment, a name and, a fifth of them, a public address, which is bound to
a gateway's rule, to a machine with a proxy or to a balancer.  Two customers share a host; whether they share a
port there decides what is ambiguous.  Nations are names behind which no proxy stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import graph
from tidegrid.plans import chain, reports, request, topology
from tidegrid.plans.driver_queries import query, table
from tidegrid.sources.snapshots import LISTENER

c = F.col
#: The site in SQL: k is a customer, j its host, h the host's address.
SITE = """
cust AS (SELECT c_custkey AS k, c_custkey // 2 AS j, c_nationkey AS nation, '10.1.' || (c_custkey // 2) // 250 || '.' || (c_custkey // 2) % 250 AS h FROM customer),
dep AS (SELECT k, j, h, CASE WHEN j % 4 = 0 THEN '8001' WHEN j % 4 = 1 THEN CASE k % 2 WHEN 0 THEN '8002' ELSE '8003' END WHEN j % 4 = 2 THEN CASE k % 2 WHEN 0 THEN 'unknown' ELSE '8002' END ELSE CASE k % 2 WHEN 0 THEN '8001' ELSE 'unknown' END END AS port,
 CASE WHEN k % 3 <> 2 THEN k % 50 END AS repo FROM cust),
pub AS (SELECT *, k % 3 AS way, CASE k % 3 WHEN 0 THEN '8001' ELSE '8002' END AS port FROM cust WHERE k % 5 = 1)"""


def _host(k: Column) -> Column:
    j = (k / 2).cast("long")
    return F.concat(F.lit("10.1."), (j / 250).cast("long"), F.lit("."), j % 250)


def _empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def site(spark, d) -> dict[str, DataFrame]:
    """The flat tables of a snapshot, as sources.snapshots.flatten() gives them, in the columns that are needed."""
    k, none = c("c_custkey"), F.lit(None).cast("string")
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", _host(k).alias("h"), (k / 2).cast("long").alias("j"))
    name = lambda key, lead: F.concat(F.lit(lead), key.cast("string"), F.lit(".example.com"))
    repo = F.when(k % 3 != 2, F.concat(F.lit("https://code.example.com/team/r"), k % 50)).otherwise("")
    even = k % 2 == 0
    port = F.when(c("j") % 4 == 0, "8001").when(c("j") % 4 == 1, F.when(even, "8002").otherwise("8003")).when(c("j") % 4 == 2, F.when(even, "unknown").otherwise("8002")).otherwise(F.when(even, "8001").otherwise("unknown"))
    public = cust.where(k % 5 == 1).select("*", F.concat(F.lit("203."), (k / 250).cast("long"), F.lit(".113."), k % 250).alias("eip"), F.concat(F.lit("198."), (k / 250).cast("long"), F.lit(".51."), k % 250).alias("vip"), (k % 3).alias("way"), k.cast("string").alias("s"))
    to = lambda lead: F.concat(F.lit(lead), "s")
    gateway, proxied, balanced = public.where("way = 0"), public.where("way = 1"), public.where("way = 2")
    record = lambda df, id_, n, kind, value: df.select(id_.alias("id"), F.lit("example.com").alias("zone"), n.alias("name"), F.lit(kind).alias("type"), value.alias("value"), F.lit("default").alias("line"), F.lit("active").alias("status"))
    cid = F.concat(F.lit("c"), k)
    nation = table(spark, d, "nation")
    records = [
        record(cust.where(k % 5 == 0), cid, name(k, "C"), "CNAME", name(c("c_nationkey"), "n")), record(public, cid, name(k, "c"), "A", c("eip")), record(cust.where(k % 5 == 2), cid, name(k, "c"), "A", c("h")),
        record(cust.where(k % 5 == 3), cid, name(k, "c"), "CNAME", F.concat(F.lit("x"), k, F.lit(".other.net."))), record(nation, F.concat(F.lit("n"), "n_nationkey"), name(c("n_nationkey"), "n"), "A", F.concat(F.lit("10.9.0."), "n_nationkey")),
    ]
    dns = records[0]
    for r in records[1:]:
        dns = dns.unionByName(r)
    t: dict[str, DataFrame] = {"dns": dns.withColumn("name", F.lower("name")), "public_zones": _empty(spark, "zone string")}
    t["apps"] = cust.select(F.concat(F.lit("a"), k).alias("id"), c("c_name").alias("name"), F.lit("yes").alias("http"), F.lit("").alias("port"), repo.alias("repository"))
    t["deployments"] = cust.select(F.concat(F.lit("a"), k).alias("app_id"), c("c_name").alias("app_name"), F.lit("P").alias("env"), F.concat(F.lit("d"), k).alias("deploy"), c("h").alias("ip"), port.alias("port"), F.lit("").alias("repository"), F.lit("x").alias("config"), F.lit("success").alias("status"), F.lit("2024-01-01").alias("lastPublishedAt"))
    t["repositories"] = nation.select(F.concat(F.lit("r"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_nationkey").alias("name"), F.concat(F.lit("https://code.example.com/team/r"), "n_nationkey").alias("canonical"), F.lit("both").alias("difference"))
    binding = F.when(c("way") == 0, "ngw-1").when(c("way") == 1, to("m")).otherwise(to("lb"))
    t["eip"] = public.select(to("e").alias("id"), to("public ").alias("name"), c("eip").alias("ip"), F.lit("any").alias("bindingType"), binding.alias("bindingId"), F.array().cast("array<struct<column:int,value:string>>").alias("notes"))
    t["nat"] = gateway.select(F.lit("ngw-1").alias("gateway"), F.lit("gw").alias("gateway_name"), F.lit("Available").alias("gateway_status"), to("s").alias("entry"), c("eip").alias("external_ip"), F.lit("80").alias("external_port"), c("h").alias("internal_ip"), F.lit("8001").alias("internal_port"), F.lit("tcp").alias("protocol"), F.lit("Available").alias("status"))
    t["compute"] = proxied.select(to("m").alias("id"), to("machine ").alias("name"), none.alias("tenantId"), F.array("h").alias("privateIps"), F.array().cast("array<string>").alias("publicIps"))
    t["balancers"] = balanced.select(to("lb").alias("id"), to("lb").alias("name"), c("vip").alias("ip"), F.lit("internet").alias("addressType"), F.lit("active").alias("status"))
    types = spark.createDataFrame([], f"l {LISTENER}").schema["l"].dataType
    t["listeners"] = balanced.select(to("lb").alias("lb"), to("lb").alias("lb_name"), F.lit("http").alias("protocol"), F.lit("80").alias("port"), F.lit("g").alias("group_id"), F.lit("running").alias("status"), none.alias("backendPort"), none.alias("forwardPort"), F.array().cast(types["rules"].dataType).alias("rules"), F.array().cast(types["certificates"].dataType).alias("certificates"))
    t["groups"] = balanced.select(to("lb").alias("lb"), F.lit("g").alias("group_id"), F.lit("pool").alias("name"), F.lit("default").alias("kind"))
    t["servers"] = balanced.select(to("lb").alias("lb"), F.lit("g").alias("group_id"), to("i").alias("server_id"), c("h").alias("ip"), F.lit("8002").alias("port"), F.lit(1).alias("weight"))
    t["assets"] = proxied.select(to("as").alias("id"), to("host").alias("hostname"), c("h").alias("ip"), F.lit("linux").alias("os"))
    t["asset_groups"] = proxied.groupBy().agg(F.collect_set(to("as")).alias("assetIds")).select(F.lit("1").alias("key"), F.lit("all").alias("name"), F.lit("all").alias("path"), "assetIds")  # one group of the site's inspected hosts
    backend = F.array(F.struct(c("h").alias("host"), F.lit("8002").alias("port"), F.lit("ip").alias("resolution")))
    t["routes"] = proxied.select(to("as").alias("asset"), to("host").alias("hostname"), c("h").alias("asset_ip"), F.array(name(k, "c")).alias("domains"), F.array(F.lit("80")).alias("listen"), F.lit("/").alias("uri"), F.lit("proxy_pass").alias("directive"), F.lit("http://pool").alias("target"), to("pool").alias("upstream"), F.lit("f").alias("file"), F.lit("main").alias("instance"), F.lit("http").alias("context"), backend.alias("backends"))
    t["app_ports"] = _empty(spark, "asset_ip string, port int, app string, asset string")
    return t


def written(spark, d) -> dict[str, DataFrame]:
    """The site's tables, each written once, since tracing and building read them many times."""
    return {name: graph.settle(df, "site") for name, df in site(spark, d).items()}


def built(spark, d) -> tuple[DataFrame, DataFrame]:
    """The site's graph, written once: what is asked of it reads nodes and edges many times."""
    nodes, edges = topology.build(written(spark, d))
    return graph.settle(nodes, "site"), graph.settle(edges, "site")


TOPOLOGY = """
ends AS (SELECT 'p' || k AS ip, '80' AS port, 'tcp' AS protocol FROM pub WHERE way = 0 UNION SELECT h, '8001', 'tcp' FROM pub WHERE way = 0 UNION SELECT h, '8002', 'http' FROM pub WHERE way > 0 UNION SELECT h, port, 'unknown' FROM dep),
nodes(type, n) AS (SELECT 'HOST', (SELECT count(DISTINCT j) FROM cust) + (SELECT count(*) FROM nation) UNION ALL SELECT 'EIP', count(*) FROM pub UNION ALL SELECT 'NAT_GATEWAY', 1 UNION ALL SELECT 'DNAT_RULE', count(*) FROM pub WHERE way = 0
 UNION ALL SELECT 'ENDPOINT', count(*) FROM ends UNION ALL SELECT unnest(['CLB', 'CLB_LISTENER', 'SERVER_GROUP']), (SELECT count(*) FROM pub WHERE way = 2) UNION ALL SELECT unnest(['NGINX_ROUTE', 'UPSTREAM']), (SELECT count(*) FROM pub WHERE way = 1)
 UNION ALL SELECT unnest(['APPLICATION', 'DEPLOYMENT']), (SELECT count(*) FROM cust) UNION ALL SELECT 'REPOSITORY', count(DISTINCT repo) FROM dep
 UNION ALL SELECT 'DOMAIN', (SELECT count(*) FROM cust WHERE k % 5 < 4) + (SELECT count(*) FROM cust WHERE k % 5 = 3) + (SELECT count(*) FROM nation)),
listening AS (SELECT *, CASE WHEN port <> 'unknown' THEN 'EXACT' WHEN max(CASE WHEN port <> 'unknown' THEN 1 ELSE 0 END) OVER (PARTITION BY j) = 1 THEN 'AMBIGUOUS' ELSE 'INFERRED' END AS sure FROM dep),
edges(type, confidence, n) AS (SELECT 'CNAME_TO', 'EXACT', count(*) FROM cust WHERE k % 5 IN (0, 3) UNION ALL SELECT 'RESOLVES_TO', 'EXACT', (SELECT count(*) FROM cust WHERE k % 5 IN (1, 2)) + (SELECT count(*) FROM nation)
 UNION ALL SELECT 'BOUND_TO', 'EXACT', count(*) FROM pub UNION ALL SELECT unnest(['HAS_DNAT_RULE', 'EXPOSES']), 'EXACT', (SELECT count(*) FROM pub WHERE way = 0) UNION ALL SELECT 'FORWARDS_TO', 'EXACT', count(*) FROM pub
 UNION ALL SELECT unnest(['HAS_LISTENER', 'ROUTES_TO']), 'EXACT', (SELECT count(*) FROM pub WHERE way = 2) UNION ALL SELECT unnest(['SERVED_BY', 'USES_UPSTREAM']), 'EXACT', (SELECT count(*) FROM pub WHERE way = 1)
 UNION ALL SELECT 'HAS_DEPLOYMENT', 'EXACT', count(*) FROM dep UNION ALL SELECT 'LISTENS_ON', sure, count(*) FROM listening GROUP BY sure UNION ALL SELECT 'BUILT_FROM', 'EXACT', count(repo) FROM dep
 UNION ALL SELECT 'ON_HOST', 'EXACT', count(*) FROM ends WHERE ip NOT LIKE 'p%')"""


@query(f"""
WITH {SITE}, {TOPOLOGY}, named AS (SELECT k, h, port, 'c' || k || '.example.com' AS name, nation FROM (SELECT cust.k, cust.h, nation, dep.port FROM cust JOIN dep USING (k))), addressed AS (SELECT k, h, way, '203.' || k // 250 || '.113.' || k % 250 AS eip FROM pub)
SELECT 'CNAME_TO' AS type, 'domain:' || name AS src, 'domain:' || CASE k % 5 WHEN 0 THEN 'n' || nation || '.example.com' ELSE 'x' || k || '.other.net' END AS dst, 'EXACT' AS confidence FROM named WHERE k % 5 IN (0, 3)
UNION ALL SELECT 'RESOLVES_TO', 'domain:' || name, CASE k % 5 WHEN 1 THEN 'eip:e' || k ELSE 'host:' || h END, 'EXACT' FROM named WHERE k % 5 IN (1, 2)
UNION ALL SELECT 'RESOLVES_TO', 'domain:n' || n_nationkey || '.example.com', 'host:10.9.0.' || n_nationkey, 'EXACT' FROM nation
UNION ALL SELECT 'BOUND_TO', 'eip:e' || k, CASE way WHEN 0 THEN 'nat-gateway:ngw-1' WHEN 1 THEN 'host:' || h ELSE 'clb:lb' || k END, 'EXACT' FROM pub
UNION ALL SELECT 'HAS_DNAT_RULE', 'nat-gateway:ngw-1', 'dnat-rule:ngw-1:s' || k, 'EXACT' FROM pub WHERE way = 0
UNION ALL SELECT 'EXPOSES', 'dnat-rule:ngw-1:s' || k, 'endpoint:' || eip || ':80:tcp', 'EXACT' FROM addressed WHERE way = 0
UNION ALL SELECT 'HAS_LISTENER', 'clb:lb' || k, 'clb-listener:lb' || k || ':http:80', 'EXACT' FROM pub WHERE way = 2
UNION ALL SELECT 'ROUTES_TO', 'clb-listener:lb' || k || ':http:80', 'clb-server-group:lb' || k || ':g', 'EXACT' FROM pub WHERE way = 2
UNION ALL SELECT 'HAS_DEPLOYMENT', 'application:a' || k, 'deployment:a' || k || ':P:d' || k, 'EXACT' FROM dep
UNION ALL SELECT 'LISTENS_ON', 'deployment:a' || k || ':P:d' || k, 'endpoint:' || h || ':' || port || ':unknown', sure FROM listening
UNION ALL SELECT 'ON_HOST', 'endpoint:' || ip || ':' || port || ':' || protocol, 'host:' || ip, 'EXACT' FROM ends WHERE ip NOT LIKE 'p%'
""")
def topology_edges(spark, d):
    """Both ends of the edges whose ids are made of the tables' keys: names, addresses, gateways, balancers, deployments, endpoints and hosts."""
    _, edges = built(spark, d)
    return edges.where(~c("type").isin("BUILT_FROM", "SERVED_BY", "USES_UPSTREAM", "FORWARDS_TO")).select("type", "src", "dst", "confidence")


@query(f"""
WITH {SITE}, {TOPOLOGY}
SELECT 'node' AS what, type, 'GLOBAL' AS confidence, n::BIGINT AS n FROM nodes UNION ALL SELECT 'edge', type, confidence, n::BIGINT FROM edges
""")
def topology_build(spark, d):
    """Nodes and edges of the site by type and confidence."""
    nodes, edges = built(spark, d)
    return nodes.groupBy(F.lit("node").alias("what"), "type", F.lit("GLOBAL").alias("confidence")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit("edge").alias("what"), "type", "confidence").agg(F.count("*").alias("n")))


@query(f"""
WITH {SITE}, {TOPOLOGY}
SELECT (SELECT sum(n) FROM nodes)::BIGINT AS nodes, (SELECT sum(n) FROM edges)::BIGINT AS edges, coalesce((SELECT sum(n) FROM edges WHERE confidence = 'AMBIGUOUS'), 0)::BIGINT AS ambiguous_edges,
 (SELECT count(*) FROM cust WHERE k % 5 = 3) + (SELECT count(*) FROM nation) + (SELECT count(DISTINCT repo) FROM dep WHERE repo NOT IN (SELECT n_nationkey FROM nation)) AS unresolved_nodes
""")
def topology_stats(spark, d):
    """How large the site's graph is and how much of it is open."""
    return graph.stats(*built(spark, d))


TRACED = """
m AS (SELECT p.k, d.k AS app, d.repo, CASE WHEN d.port = p.port THEN 3 WHEN d.port = 'unknown' THEN 1 END AS tier FROM pub p JOIN dep d USING (j)),
best AS (SELECT * FROM m WHERE tier IS NOT NULL QUALIFY rank() OVER (PARTITION BY k ORDER BY tier DESC) = 1),
per AS (SELECT k, count(*) AS paths, count(DISTINCT repo) AS ends, count(DISTINCT CASE WHEN repo IS NULL THEN app END) AS apps FROM best GROUP BY 1)"""


@query(f"""
WITH {SITE}, {TRACED}
SELECT 'http://c' || c.k || '.example.com/' AS req, CASE WHEN c.k % 5 = 4 THEN 'UNRESOLVED' WHEN ends > 1 OR (ends = 0 AND apps > 1) THEN 'AMBIGUOUS' WHEN ends = 1 THEN 'RESOLVED' ELSE 'PARTIAL' END AS status, coalesce(paths, 1) AS paths FROM cust c LEFT JOIN per USING (k)
""")
def request_statuses(spark, d):
    """Where a request for each customer's name ends."""
    k = c("c_custkey")
    asked = table(spark, d, "customer").select(F.concat(F.lit("http://c"), k, F.lit(".example.com/")).alias("url"))
    return request.statuses(request.trace(asked, written(spark, d)))


@query(f"""
WITH {SITE}, {TRACED}
SELECT resolver, rule, confidence, count(*) AS steps FROM (
 SELECT 'dns' AS resolver, 'host name' AS rule, 'EXACT' AS confidence FROM cust WHERE k % 5 IN (0, 2, 3) UNION ALL SELECT 'dns', 'CNAME', 'EXACT' FROM cust WHERE k % 5 IN (0, 3) UNION ALL SELECT 'dns', 'A', 'EXACT' FROM cust WHERE k % 5 IN (0, 2)
 UNION ALL SELECT unnest(CASE way WHEN 0 THEN ['dns', 'dns', 'nat', 'nat'] WHEN 1 THEN ['dns', 'dns', 'nat', 'proxy'] ELSE ['dns', 'dns', 'lb', 'lb'] END), unnest(CASE way WHEN 0 THEN ['host name', 'A', 'binding', 'DNAT'] WHEN 1 THEN ['host name', 'A', 'binding', 'location /'] ELSE ['host name', 'A', 'binding', 'default group'] END), 'EXACT'
  FROM (SELECT way, unnest(range(coalesce(paths, 1))) FROM pub LEFT JOIN per USING (k))
 UNION ALL SELECT 'deployment', CASE tier WHEN 3 THEN 'address, port and environment' ELSE 'address only' END, CASE WHEN n > 1 THEN 'AMBIGUOUS' WHEN tier = 1 THEN 'INFERRED' ELSE 'EXACT' END FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM best)
 UNION ALL SELECT 'deployment', 'owner', 'EXACT' FROM best
 UNION ALL SELECT 'repository', 'own', CASE WHEN repo < (SELECT count(*) FROM nation) THEN 'EXACT' ELSE 'INFERRED' END FROM best WHERE repo IS NOT NULL) GROUP BY ALL
""")
def request_steps(spark, d):
    """By which resolver's rule requests went on, and how sure that was."""
    k = c("c_custkey")
    asked = table(spark, d, "customer").select(F.concat(F.lit("http://c"), k, F.lit(".example.com/")).alias("url"))
    s = request.trace(asked, written(spark, d)).select(F.explode("steps").alias("s")).select("s.*")
    rule = F.when(c("resolver") == "repository", "own").when(c("rule").startswith("DNAT "), "DNAT").otherwise(c("rule"))
    return s.groupBy("resolver", rule.alias("rule"), graph.name_of(c("rank")).alias("confidence")).agg(F.count("*").alias("steps"))


@query(f"""
WITH {SITE},
back AS (SELECT p.k, count(d.k) AS owners, (SELECT count(*) FROM dep o WHERE o.j = p.j AND o.port <> p.port) AS others FROM pub p LEFT JOIN dep d ON d.j = p.j AND d.port = p.port WHERE way = 1 GROUP BY p.k, p.j, p.port)
SELECT 'c' || c.k || '.example.com' AS asked, CASE WHEN c.k % 5 = 4 THEN 0 WHEN c.k % 5 IN (0, 3) THEN 2 ELSE 1 END::BIGINT AS names, CASE WHEN c.k % 5 < 3 THEN 1 ELSE 0 END::BIGINT AS entries, (b.k IS NOT NULL)::BIGINT AS routes, (b.k IS NOT NULL)::BIGINT AS proxies, (b.k IS NOT NULL)::BIGINT AS upstreams,
 coalesce(owners = 1, FALSE)::BIGINT AS exact, coalesce(owners > 1, FALSE)::BIGINT AS ambiguous, coalesce(owners = 0, FALSE)::BIGINT AS unresolved, b.k IS NOT NULL AS connected,
 CASE WHEN c.k % 5 = 4 THEN 'not-found' WHEN owners = 1 THEN 'resolved' WHEN owners > 1 OR (owners = 0 AND others > 0) THEN 'ambiguous' ELSE 'unresolved' END AS status
FROM cust c LEFT JOIN back b USING (k)
""")
def domain_chains(spark, d):
    """The chain of each customer's name: aliases, entries, proxies, backends."""
    asked = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey", F.lit(".example.com")).alias("asked"))
    s = chain.explore(*built(spark, d), asked).summary
    return s.select("asked", "names", "entries", "routes", "proxies", "upstreams", "exact", "ambiguous", "unresolved", "connected", "status")


@query(f"""
WITH {SITE},
e AS (SELECT DISTINCT h, j, port, CASE way WHEN 0 THEN 'tcp' ELSE 'http' END AS protocol FROM pub)
SELECT 'endpoint:' || h || ':' || port || ':' || protocol AS endpoint, CASE n WHEN 0 THEN 'unresolved' WHEN 1 THEN 'exact' ELSE 'ambiguous' END AS status, n AS applications, CASE WHEN n = 0 THEN o ELSE 0 END AS hints
FROM (SELECT *, (SELECT count(*) FROM dep d WHERE d.j = e.j AND d.port = e.port) AS n, (SELECT count(*) FROM dep d WHERE d.j = e.j AND d.port <> e.port) AS o FROM e)
""")
def backend_matches(spark, d):
    """Which application listens where something forwards to, by address and port; other ports are hints."""
    b = reports.backends(*built(spark, d))
    return b.select("endpoint", "status", F.size("applications").cast("long").alias("applications"), F.size("hints").cast("long").alias("hints"))


@query(f"""
WITH {SITE}
SELECT 'c' || k || '.example.com' AS asked, 'DOMAIN' AS type, CASE WHEN k % 5 < 4 THEN 'found' ELSE 'not-found' END AS status, CASE WHEN k % 5 < 4 THEN 'label' END AS matched_by FROM cust
""")
def resolve_nodes(spark, d):
    """Nodes by id, label or identity."""
    nodes, _ = built(spark, d)
    asked = table(spark, d, "customer").select(F.concat(F.lit(" C"), "c_custkey", F.lit(".example.com")).alias("asked"))
    return graph.resolve_names(nodes, asked).select(F.lower(F.trim("asked")).alias("asked"), F.lit("DOMAIN").alias("type"), "status", "matched_by")


@query(f"""
WITH {SITE}, a AS (SELECT h AS ip, 'inventory' AS s FROM dep UNION ALL SELECT h, unnest(['cloud', 'assets']) FROM pub WHERE way = 1 UNION ALL SELECT h, 'backend' FROM pub WHERE way = 2 UNION ALL SELECT h, 'nat' FROM pub WHERE way = 0 UNION ALL SELECT h, 'dns' FROM cust WHERE k % 5 = 2
 UNION ALL SELECT 'e' || k, unnest(['eip', 'cloud', 'dns']) FROM pub UNION ALL SELECT 'e' || k, 'nat' FROM pub WHERE way = 0 UNION ALL SELECT 'v' || k, 'cloud' FROM pub WHERE way = 2 UNION ALL SELECT 'n' || n_nationkey, 'dns' FROM nation),
r AS (SELECT ip, bool_or(s = 'inventory') AS inventory, bool_or(s = 'cloud') AS cloud, bool_or(s = 'assets') AS assets FROM a GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (WHERE inventory) AS inventory, count(*) FILTER (WHERE cloud) AS cloud, count(*) FILTER (WHERE assets) AS assets, count(*) FILTER (WHERE inventory OR cloud) AS used, count(*) FILTER (WHERE (inventory OR cloud) AND NOT assets) AS missing,
 count(*) FILTER (WHERE inventory AND NOT assets) AS inventory_missing, count(*) FILTER (WHERE cloud AND NOT assets) AS cloud_missing FROM r
""")
def wide_summary(spark, d):
    """How many addresses each source has, and which of those in use no asset manages."""
    w = reports.summarize_wide(reports.wide_rows(site(spark, d)))
    return w.select("total", "inventory", "cloud", "assets", "used", "missing", "inventory_missing", "cloud_missing")


@query(f"""
WITH {SITE}
SELECT 'lb' || k AS lb, 1::BIGINT AS backends, 1::BIGINT AS memberships, 1::BIGINT AS used, 0::BIGINT AS empty_listeners FROM pub WHERE way = 2
""")
def balancer_totals(spark, d):
    """Backends of each balancer and how many of them its listeners use."""
    return reports.balancer_totals(site(spark, d))


@query(f"""
WITH {SITE}, q AS (SELECT k, CASE WHEN k % 2 = 0 THEN '/' ELSE 'x' END AS asked FROM cust)
SELECT 'C' || q.k || '/' AS asked, count(p.k) AS routes FROM q JOIN pub p ON p.way = 1 AND q.k % 50 = 0 GROUP BY q.k
""")
def location_lookup(spark, d):
    """Routes whose location contains a text, whatever the case."""
    t = site(spark, d)
    k = c("c_custkey")
    asked = table(spark, d, "customer").select(F.when(k % 50 == 0, "/").otherwise("nowhere").alias("asked"), k)
    found = request.find_locations(t, asked.select("asked").distinct())
    return asked.join(found.groupBy("asked").agg(F.count("*").alias("routes")), "asked").select(F.concat(F.lit("C"), k, F.lit("/")).alias("asked"), "routes")
