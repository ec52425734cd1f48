"""Listings on the driver's tables, with SQL for each: customers stand for repositories and applications, orders for commits and instances, parts for processes and files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegrid.plans import listings
from tidegrid.plans.driver_queries import query, table
from tidegrid.plans.library_queries import FLOWS, flow_table

c = F.col
REFERENCE = "1998-08-02 12:00:00"
#: Repositories in SQL: a customer's last order is its last commit; every fourth has a complete history.
REPOSITORIES = f"""
r AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS g, c_custkey % 4 = 0 AS complete, c_custkey % 3 <> 0 AS used, CASE c_custkey % 5 WHEN 0 THEN 'codeup_only' WHEN 1 THEN 'devops_only' ELSE 'both' END AS difference,
 max(o_orderdate) AS last, count(o_orderkey) FILTER (WHERE o_orderdate > TIMESTAMP '{REFERENCE}' - INTERVAL 40 DAY) AS recent, TIMESTAMP '{REFERENCE}' AS ref FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


def repositories(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.count(F.when(c("o_orderdate") > F.expr(f"timestamp '{REFERENCE}' - interval 40 days"), 1)).alias("recent"))
    k = c("c_custkey")
    r = table(spark, d, "customer").join(o, k == c("o_custkey"), "left")
    difference = F.when(k % 5 == 0, "codeup_only").when(k % 5 == 1, "devops_only").otherwise("both")
    return r.select(k.alias("k"), c("c_name").alias("name"), c("c_nationkey").alias("group_id"), F.concat(F.lit("team/r"), k).alias("path"), F.concat(F.lit("https://code.example.com/team/r"), k).alias("url"), (k % 4 == 0).alias("complete"), F.when(k % 3 != 0, F.array(F.concat(F.lit("app"), k))).otherwise(F.array().cast("array<string>")).alias("apps"), difference.alias("difference"), c("last").cast("timestamp").alias("last"), F.coalesce("recent", F.lit(0)).alias("recent"))


@query(f"""
WITH {REPOSITORIES}
SELECT k, last IS NULL AS unknown, coalesce(last <= ref AND last >= ref - INTERVAL 7 DAY, FALSE) AS week, coalesce(last <= ref AND last >= ref - INTERVAL 1 MONTH, FALSE) AS month, coalesce(last <= ref AND last < ref - INTERVAL 6 MONTH AND last >= ref - INTERVAL 12 MONTH, FALSE) AS year, coalesce(last < ref - INTERVAL 24 MONTH, FALSE) AS older,
 used AND CASE WHEN complete THEN recent > 0 ELSE coalesce(last <= ref AND last >= ref - INTERVAL 1 MONTH, FALSE) END AS linked_month, NOT used AND coalesce(last < ref - INTERVAL 24 MONTH, FALSE) AS unlinked_older FROM r
""")
def repository_periods(spark, d):
    """Repositories by the period of their last commit and whether applications use them."""
    ref = F.lit(REFERENCE).cast("timestamp")
    r = repositories(spark, d)
    by = [listings.in_commit_period(c("last"), ref, p).alias(p) for p in ("unknown", "week", "month", "year", "older")]
    return r.select("k", *by, listings.repository_fits(ref, "month", True).alias("linked_month"), listings.repository_fits(ref, "older", False).alias("unlinked_older"))


GROUPS = "g AS (SELECT n_nationkey AS id, n_name AS name, n_nationkey % 3 - 1 AS gap FROM nation)"


@query(f"""
WITH {REPOSITORIES}, {GROUPS}, f AS (SELECT g AS id, count(*) AS n FROM r WHERE used AND CASE WHEN complete THEN recent > 0 ELSE coalesce(last <= ref AND last >= ref - INTERVAL 3 MONTH, FALSE) END GROUP BY 1),
u AS (SELECT g AS id, count(*) AS n FROM r WHERE difference = 'codeup_only' GROUP BY 1), t AS (SELECT g AS id, count(*) AS n, bool_or(contains(lower(name), '0007') OR (used AND contains('app' || k, '0007'))) AS hit FROM r GROUP BY 1)
SELECT 'quarter' AS listing, id, n AS repositories FROM g JOIN f USING (id) WHERE n > 0 UNION ALL SELECT 'unused', id, n FROM g JOIN u USING (id) UNION ALL SELECT 'gap', id, coalesce(t.n, 0) FROM g LEFT JOIN t USING (id) WHERE gap > 0
UNION ALL SELECT 'surplus', id, coalesce(t.n, 0) FROM g LEFT JOIN t USING (id) WHERE gap < 0 UNION ALL SELECT 'text', id, coalesce(t.n, 0) FROM g LEFT JOIN t USING (id) WHERE contains(lower(name), '0007') OR hit
""")
def group_listings(spark, d):
    """Groups that listings by period, mode and text show, with their fitting repositories."""
    r = repositories(spark, d)
    unused = r.where("difference = 'codeup_only'").groupBy(c("group_id").alias("id")).agg(F.count("*").alias("unused"))
    g = table(spark, d, "nation").select(c("n_nationkey").alias("id"), c("n_name").alias("name"), F.lit("").alias("description"), F.lit("p").alias("path"), (c("n_nationkey") % 3 - 1).alias("gap"), F.lit(0).alias("accessible"), F.lit(0).alias("inventory_only")).join(unused, "id", "left").na.fill(0)
    ref = F.lit(REFERENCE).cast("timestamp")
    show = lambda name, **more: listings.filter_groups(g, r, ref, **more).select(F.lit(name).alias("listing"), "id", "repositories")
    return show("quarter", period="quarter", linked=True).unionByName(show("unused", mode="unused")).unionByName(show("gap", mode="gap")).unionByName(show("surplus", mode="surplus")).unionByName(show("text", text=" 0007"))


@query("""
SELECT DISTINCT 'app' || c_custkey AS app_id FROM customer WHERE c_custkey % 3 <> 0 AND contains(lower(c_name) || '|team/r' || c_custkey || '|code.example.com team r' || c_custkey, '77')
UNION SELECT 'x' || c_custkey FROM customer WHERE contains('team/s' || c_custkey || '|code.example.com team s' || c_custkey, '77')
""")
def apps_by_repository(spark, d):
    """Applications whose repositories have a text in name, path or address."""
    apps = table(spark, d, "customer").select(F.concat(F.lit("x"), "c_custkey").alias("app_id"), F.concat(F.lit("git@code.example.com:team/s"), "c_custkey", F.lit(".git")).alias("url"))
    return listings.apps_by_repository(apps, repositories(spark, d), "77")


#: Commits in SQL: an order is a commit of its customer's repository, its parents are the repository's two commits before it; every third has a second head.
COMMITS = """
o AS (SELECT o_custkey AS repo, o_orderkey AS sha, o_orderdate AS committed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
reach AS (SELECT repo, sha, committed FROM o WHERE (n - place) % 2 = 0 OR (repo % 3 = 0 AND place < n AND (n - 1 - place) % 2 = 0) OR repo % 2 = 0)"""


def commits(spark, d):
    """(repository, sha, at, parents) and (repository, branch, sha, at): even repositories' commits follow the one before and the one before that, others' only the latter."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = lambda n: F.lag(c("o_orderkey").cast("string"), n).over(w)
    both = F.filter(F.array(F.when(c("o_custkey") % 2 == 0, before(1)), before(2)), lambda p: p.isNotNull())
    o = table(spark, d, "orders").select(c("o_custkey").cast("string").alias("repository"), c("o_orderkey").cast("string").alias("sha"), c("o_orderdate").cast("timestamp").alias("at"), both.alias("parents"), F.row_number().over(w).alias("place"), F.count("*").over(W.partitionBy("o_custkey")).alias("n"))
    head = o.where((c("place") == c("n")) | ((c("repository").cast("long") % 3 == 0) & (c("place") == c("n") - 1)))
    return o.select("repository", "sha", "at", "parents"), head.select("repository", F.when(c("place") == c("n"), "trunk").otherwise("old").alias("branch"), "sha", "at")


@query(f"""
WITH {COMMITS}
SELECT repo::VARCHAR AS repository, (committed + INTERVAL 8 HOUR)::DATE AS day, count(DISTINCT sha) AS commits FROM reach GROUP BY ALL
""")
def commit_days(spark, d):
    """Commits of each day that branch heads reach over all parents, each once."""
    made, heads = commits(spark, d)
    return listings.commits_by_day(listings.reachable_commits(made, heads))


@query(f"""
WITH {COMMITS}, x AS (SELECT repo::VARCHAR AS repository, (committed + INTERVAL 8 HOUR)::DATE AS day FROM o), l AS (SELECT repo::VARCHAR AS repository, sha::VARCHAR AS head FROM o WHERE place = n)
SELECT repository, head, count(day) FILTER (WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-06-30') AS inclusive, count(day) FILTER (WHERE day >= DATE '1997-01-01' AND day < DATE '1997-06-30') AS half_open FROM x JOIN l USING (repository) GROUP BY ALL
""")
def commit_periods(spark, d):
    """Commits of a period, its last day included or not, and each repository's latest head."""
    made, heads = commits(spark, d)
    daily = listings.commits_by_day(made)
    day = lambda s: F.lit(s).cast("date")
    n = lambda last, name: listings.commits_between(daily, day("1997-01-01"), day("1997-06-30"), last).withColumnRenamed("commits", name)
    out = listings.latest_heads(heads).select("repository", c("sha").alias("head"))
    return out.join(n(True, "inclusive"), "repository", "left").join(n(False, "half_open"), "repository", "left").na.fill(0, ["inclusive", "half_open"])


@query("""
WITH p AS (SELECT p_size AS ip, p_partkey AS pid, p_partkey % 3 = 0 AS worker, (p_partkey % 5)::INTEGER AS port FROM part)
SELECT ip::VARCHAR AS ip, pid, NULL::BIGINT AS workers, [port] AS ports FROM p WHERE NOT worker OR pid % 9 = 0 UNION ALL SELECT ip::VARCHAR, min(pid), count(*), list_sort(list(DISTINCT port)) FROM p WHERE worker AND pid % 9 <> 0 GROUP BY ip
""")
def worker_rows(spark, d):
    """Processes with a host's proxy workers as one row."""
    k = c("p_partkey")
    p = table(spark, d, "part").select(c("p_size").cast("string").alias("ip"), k.alias("pid"), F.lit("nginx").alias("name"), F.when(k % 3 == 0, "nginx: worker process").otherwise("nginx: master process").alias("command"), F.lit("Nginx").alias("kind"), F.when(k % 9 == 0, "box").alias("container"), F.array((k % 5).cast("int")).alias("ports"))
    return listings.collapse_workers(p).select("ip", "pid", "workers", "ports")


@query("""
WITH l AS (SELECT p_size AS ip, CASE WHEN p_partkey % 4 > 0 THEN p_partkey // 4 END AS pid, (8000 + p_partkey % 3)::INTEGER AS port, '10.0.0.' || p_partkey % 2 AS address FROM part),
p AS (SELECT p_size AS ip, p_partkey // 4 AS pid, min(p_brand) AS app FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2)
SELECT l.ip::VARCHAR AS ip, coalesce(app, 'unknown process') AS app, port, count(DISTINCT address) AS addresses, count(DISTINCT l.pid) AS pids FROM l LEFT JOIN p ON l.ip = p.ip AND l.pid = p.pid GROUP BY ALL
""")
def application_ports(spark, d):
    """Listening sockets by application and port; hidden processes keep their ports."""
    k, none = c("p_partkey"), F.lit(None)
    part = table(spark, d, "part")
    l = part.select(c("p_size").cast("string").alias("ip"), F.when(k % 4 > 0, F.expr("p_partkey div 4")).alias("pid"), (8000 + k % 3).cast("int").alias("port"), F.concat(F.lit("10.0.0."), k % 2).alias("address"), none.cast("array<int>").alias("candidates"), none.cast("string").alias("confidence"), none.cast("string").alias("basis"))  # noqa: E741
    p = part.where(k % 3 == 0).groupBy(c("p_size").cast("string").alias("ip"), F.expr("p_partkey div 4").alias("pid")).agg(F.min("p_brand").alias("app")).withColumn("kind", F.lit("jar"))
    return listings.application_ports(l, p).select("ip", "app", "port", F.size("addresses").cast("long").alias("addresses"), F.size("pids").cast("long").alias("pids"))


@query("""
WITH r AS (SELECT o_custkey AS address, min(o_orderkey) AS id, list(o_orderkey ORDER BY o_orderkey) AS ids, arg_min(o_orderpriority, o_orderkey) AS name, arg_min(o_orderstatus, o_orderkey) AS first_login, bool_or(o_orderstatus = 'F') AS free, count(*) - 1 AS repeats FROM orders GROUP BY 1)
SELECT address, name, CASE WHEN free THEN 'F' ELSE first_login END AS login, len(ids)::BIGINT AS ids, ids[1] AS first_id, repeats FROM r
""")
def merged_databases(spark, d):
    """Records of one address as one, its state free if any record says so."""
    o = table(spark, d, "orders").select(c("o_custkey").alias("address"), c("o_orderkey").alias("id"), c("o_orderkey").alias("ord"), c("o_orderpriority").alias("name"), c("o_orderstatus").alias("login"))
    m = listings.merge_by_address(o, "address", "id", "ord", "login", "F")
    return m.select("address", "name", "login", F.size("ids").cast("long").alias("ids"), F.get("ids", F.lit(0)).alias("first_id"), c("repeats").cast("long").alias("repeats"))


@query("""
WITH t AS (SELECT o_custkey AS source, CASE WHEN o_orderkey % 37 = 0 THEN 'failed' WHEN o_orderkey % 11 = 0 THEN 'running' WHEN o_custkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'done' ELSE 'waiting' END AS state FROM orders)
SELECT source, CASE WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_or(state = 'running') THEN 'running' WHEN bool_and(state = 'done') THEN 'done' ELSE 'waiting' END AS state, count(*) AS tasks, count(*) FILTER (WHERE state IN ('done', 'failed')) AS finished FROM t GROUP BY 1
""")
def source_states(spark, d):
    """Each source's state from those of its tasks."""
    k = c("o_orderkey")
    s = F.when(k % 37 == 0, "failed").when(k % 11 == 0, "running").when((c("o_custkey") % 2 == 0) | (k % 3 == 0), "done").otherwise("waiting")
    return listings.source_states(table(spark, d, "orders").select(c("o_custkey").alias("source"), s.alias("state")))


@query("SELECT 'customer' AS source, count(*) AS rows FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'absent', NULL")
def version_counts(spark, d):
    """Rows of a version's tables, null for one that isn't there."""
    return listings.version_counts({n: table(spark, d, n) for n in ("customer", "supplier")}, "customer", "supplier", "absent")


@query("""
WITH b AS (SELECT p_brand AS n, list_sort(list(DISTINCT p_partkey)) AS hints FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT p_partkey, coalesce(len(hints), 0)::BIGINT AS hints, hints[1] AS first_hint FROM part LEFT JOIN b ON p_brand = n WHERE p_partkey % 2 = 0
""")
def name_hints(spark, d):
    """Records of the same name in another source, as hints."""
    p = table(spark, d, "part")
    left, right = p.where("p_partkey % 2 = 0").withColumn("n", F.upper("p_brand")), p.where("p_partkey % 2 = 1").withColumn("n", c("p_brand"))
    return listings.same_name_hints(left, right, "n", "p_partkey").select("p_partkey", F.size("hints").cast("long").alias("hints"), F.get("hints", F.lit(0)).alias("first_hint"))


@query("""
SELECT 'a' || c_custkey AS code, c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN n_name END AS system_name, CASE WHEN c_custkey % 7 <> 0 AND n_nationkey % 4 <> 0 THEN r_name END AS domain_name, 'PRESENT' AS presence
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 3 <> 0
""")
def catalog_units(spark, d):
    """Units with their source, system and domain."""
    k = c("c_custkey")
    cust = table(spark, d, "customer")
    units = cust.select(k.alias("id"), F.concat(F.lit("a"), k).alias("code"), c("c_name").alias("name"), F.when(k % 7 != 0, c("c_nationkey")).alias("system_id"))
    systems = table(spark, d, "nation").select(c("n_nationkey").alias("id"), c("n_name").alias("name"), F.when(c("n_nationkey") % 4 != 0, c("n_regionkey")).alias("domain_id"))
    u = listings.catalog_units(units, cust.where(k % 3 != 0).select(k.alias("unit_id"), F.lit("PRESENT").alias("presence")), systems, table(spark, d, "region").select(c("r_regionkey").alias("id"), c("r_name").alias("name")))
    return u.select("code", "name", "system_name", "domain_name", "presence")


@query("""
SELECT 'a' || c_custkey AS app_id, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS domain_name FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def application_domains(spark, d):
    """Applications with their domain, for export."""
    u = table(spark, d, "customer").join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    return listings.application_domains(u.select(F.concat(F.lit("a"), "c_custkey").alias("code"), F.when(c("c_custkey") % 2 == 0, c("n_name")).alias("domain_name")))


@query("""
WITH i AS (SELECT o_orderkey AS id, o_custkey AS e, o_orderstatus <> 'P' AS present, o_orderkey % 5 = 0 AS managed, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '10.0.0.' || o_orderkey % 200 END AS ip FROM orders)
SELECT c_mktsegment AS environment, count(DISTINCT id) AS instances, count(DISTINCT CASE WHEN NOT managed THEN nullif(ip, '') END) + count(DISTINCT CASE WHEN managed THEN id END) AS servers FROM customer LEFT JOIN i ON e = c_custkey AND present GROUP BY 1
""")
def environment_counts(spark, d):
    """Instances and servers of each environment; managed services count by themselves."""
    k = c("o_orderkey")
    i = table(spark, d, "orders").select(k.alias("id"), c("o_custkey").alias("environment_id"), (c("o_orderstatus") != "P").alias("present"), (k % 5 == 0).alias("managed"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("10.0.0."), k % 200)).alias("ip"))
    return listings.environment_counts(table(spark, d, "customer").select(c("c_custkey").alias("environment_id"), c("c_mktsegment").alias("environment")), i, "environment")


#: Files in SQL: a supplier's main file includes its sites by *, a site the one of half its number by name.
FILES = "SELECT s_suppkey AS k, '/etc/n' || s_nationkey || '/sites/' || s_suppkey || '.conf' AS path, s_nationkey AS g FROM supplier"


@query(f"""
WITH RECURSIVE f AS ({FILES}), e AS (SELECT DISTINCT g, '/etc/n' || g || '/nginx.conf' AS src, path AS dst FROM f UNION SELECT a.g, a.path, b.path FROM f a JOIN f b ON a.g = b.g AND b.k = a.k // 2),
w AS (SELECT g, path AS start, path, 0 AS distance FROM f UNION SELECT w.g, w.start, e.dst, w.distance + 1 FROM w JOIN e ON e.g = w.g AND e.src = w.path WHERE w.path <> e.dst)
SELECT g::VARCHAR AS instance, start, path, min(distance) AS distance FROM w GROUP BY ALL
""")
def included_files(spark, d):
    """What each site's file leads to over include statements."""
    s = table(spark, d, "supplier").select(c("s_nationkey").cast("string").alias("instance"), "s_suppkey")
    site = F.concat(F.lit("/etc/n"), "instance", F.lit("/sites/"), "s_suppkey", F.lit(".conf"))
    half = F.concat(F.lit("server {\n  include sites/"), F.expr("s_suppkey div 2"), F.lit(".conf; # half\n  include $x/y;\n  include ../up;\n}"))
    main = s.select("instance").distinct().select("instance", F.concat(F.lit("/etc/n"), "instance", F.lit("/nginx.conf")).alias("path"), F.lit("http {\ninclude 'sites/*.conf';\ninclude sites/[ab].conf;\n}").alias("content"))
    sites = s.select("instance", site.alias("path"), half.alias("content"))
    return listings.included_files(main.unionByName(sites), sites.select("instance", "path"))


@query(f"""
WITH f AS ({FILES})
SELECT g::VARCHAR AS instance, path, 2::BIGINT AS names FROM f WHERE k % 3 = 0
""")
def server_names(spark, d):
    """Proxy files that name a domain."""
    s = table(spark, d, "supplier")
    name = F.when(c("s_suppkey") % 3 == 0, "*.example.com \"b.net\"").otherwise("other.net")
    content = F.concat(F.lit("server {\n  listen 80; # server_name www.example.com;\n  server_name "), name, F.lit(";\n}"))
    files = s.select(c("s_nationkey").cast("string").alias("instance"), F.concat(F.lit("/etc/n"), "s_nationkey", F.lit("/sites/"), "s_suppkey", F.lit(".conf")).alias("path"), content.alias("content"))
    return listings.server_names(files, "www.example.com").select("instance", "path", F.size("names").cast("long").alias("names"))


@query(f"""
WITH {FLOWS}, o AS (SELECT user_id % 3 AS g, first_at AS a, last_at AS b FROM flow WHERE user_id % 4 = 0),
x AS (SELECT f.user_id, o.g, o.a, o.b FROM flow f JOIN (SELECT DISTINCT * FROM o) o ON f.user_id % 3 = o.g WHERE o.b >= f.first_at AND o.a <= f.last_at), m AS (SELECT g, a, b FROM x GROUP BY ALL HAVING count(*) > 1)
SELECT user_id, user_id IN (SELECT user_id FROM x JOIN m USING (g, a, b)) AS ambiguous_in_time FROM flow
""")
def temporal_ambiguity(spark, d):
    """Connections whose observation at the other end fits another one of the same addresses and ports, too."""
    g = (c("local_port") - 1000) % 3
    f = flow_table(spark, d).select((c("local_port") - 1000).cast("long").alias("user_id"), F.lit("10.0.0.1").alias("local_ip"), F.lit(1).alias("local_port"), F.concat(F.lit("10.1.0."), g).alias("peer_ip"), F.lit(80).alias("peer_port"), F.concat(F.lit("s"), "local_port").alias("socket_id"), "first_at", "last_at")
    o = f.where("user_id % 4 = 0").select(c("peer_ip").alias("local_ip"), c("peer_port").alias("local_port"), c("local_ip").alias("peer_ip"), c("local_port").alias("peer_port"), c("first_at").alias("obs_start"), c("last_at").alias("obs_end"))
    return listings.temporal_ambiguity(f, o).select("user_id", "ambiguous_in_time")


@query("""
SELECT 'document' AS listing, count(*) AS n FROM customer WHERE contains(lower(c_name || '|' || c_mktsegment || '|' || c_custkey), 'build') UNION ALL SELECT 'database', count(*) FROM supplier WHERE s_nationkey = 3 AND contains(lower(s_name), '1')
UNION ALL SELECT 'server', count(*) FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') UNION ALL SELECT 'tab ' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'travel' WHEN c_custkey % 2 = 0 THEN 'other' ELSE 'group' END, count(*) FROM customer GROUP BY 1
UNION ALL SELECT 'log ' || CASE p_partkey % 5 WHEN 0 THEN 'current' WHEN 1 THEN 'history' ELSE 'none' END, count(*) FROM part GROUP BY 1
""")
def text_filters(spark, d):
    """How many rows filters by text, fields, tab and log class keep."""
    n = lambda df, name: df.agg(F.lit(name).alias("listing"), F.count("*").alias("n"))
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    domain = F.when(c("c_mktsegment") == "BUILDING", c("c_mktsegment")).when(c("c_custkey") % 2 == 0, F.lit(None)).otherwise("x")
    k = c("p_partkey") % 5
    path = F.when(k == 0, "/l/app.log").when(k == 1, "/l/app.2024-01-01.log").when(k == 2, "/l/backup-1/app.log").when(k == 3, "/l/app.txt").otherwise("/l/release/x/app.log")
    kind = listings.log_class(path, r"\w+\.log", r"\w+\.\d{4}-\d\d-\d\d\.log", ("backup*", "release"))
    by = lambda df, what, lead: df.groupBy(F.concat(F.lit(lead), what).alias("listing")).agg(F.count("*").alias("n"))
    sup = table(spark, d, "supplier").select(F.array("s_name").alias("names"), c("s_nationkey").cast("string").alias("env"))
    return n(listings.in_document(cust, "Build"), "document").unionByName(n(listings.pick(sup, "1", ["names"], env="3", kind=None), "database")).unionByName(n(listings.pick(table(spark, d, "part"), " RING ", ["p_name", "p_brand"]), "server")).unionByName(by(cust, listings.business_tab(domain, {"BUILDING": "travel"}), "tab ")).unionByName(by(table(spark, d, "part"), kind, "log "))


@query("""
SELECT lang, sum(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))))::BIGINT AS lines, sum(len(list_filter(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: regexp_matches(x, '(?i)error|exception|fail'))))::BIGINT AS errors,
 sum(len(list_filter(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: regexp_matches(x, '(?i)(GET|POST|PUT|DELETE) '))))::BIGINT AS requests FROM documents WHERE text IS NOT NULL GROUP BY 1
""")
def log_activity(spark, d):
    """Lines, errors and requests of texts read as logs."""
    return listings.log_activity(table(spark, d, "documents"), "text", "lang")


@query("""
WITH p AS (SELECT p_partkey, p_brand AS ip, p_type AS d, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM part)
SELECT p_partkey, CASE WHEN n > 1 THEN d || ' (PID ' || p_partkey || ')' ELSE d END AS detail FROM p
""")
def detail_names(spark, d):
    """Details of processes, with the pid where a host has several alike."""
    p = table(spark, d, "part").select("p_partkey", c("p_brand").alias("ip"), c("p_type").alias("detail"))
    return listings.disambiguate(p, ["ip"], pid="p_partkey").select("p_partkey", "detail")


@query("""
WITH a AS (SELECT p_partkey % 500 AS k, p_partkey, row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY p_size DESC, p_name, p_partkey) AS by_size, row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END DESC NULLS LAST, p_partkey) AS by_time,
 row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY p_size, p_partkey) AS by_number, row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END, p_name, p_partkey) AS by_kind,
 row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY p_size DESC, p_partkey % 256, p_partkey) AS by_running FROM part)
SELECT p_partkey, by_size, by_time, by_number, by_kind, by_running FROM a
""")
def listing_orders(spark, d):
    """Places in the orders of listings: by size, time with none last, numbers in texts, kind, running time."""
    k = c("p_partkey")
    p = table(spark, d, "part").withColumns({"g": k % 500, "time": F.when(k % 3 == 0, "").otherwise(c("p_brand")), "kind": F.when(k % 3 == 0, "static").when(k % 3 == 1, "proxy").otherwise("external"), "upstream": c("p_name"), "seconds": c("p_size"), "ip": F.concat(F.lit("10.0.0."), k % 256), "pid": k, "id": k})
    at = lambda name, *order: F.row_number().over(W.partitionBy("g").orderBy(*order)).cast("long").alias(name)
    number = listings.numeric_order(F.concat(F.lit("port "), "p_size"))
    return p.select("p_partkey", at("by_size", *listings.size_order("p_size", "p_name"), "p_partkey"), at("by_time", listings.time_order("time"), "p_partkey"), at("by_number", number, "p_partkey"), at("by_kind", *listings.group_order(), "p_partkey"), at("by_running", *listings.longest_running()))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, CASE o_orderstatus WHEN 'O' THEN 3 WHEN 'F' THEN 2 ELSE 1 END DESC, o_orderkey % 4, o_orderkey) AS place FROM orders")
def resolved_orders(spark, d):
    """Resolved paths in their order: ended first, then confidence, steps, end."""
    k = c("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (c("o_orderstatus") == "F").alias("terminal"), F.when(c("o_orderstatus") == "O", "EXACT").when(c("o_orderstatus") == "F", "INFERRED").otherwise("AMBIGUOUS").alias("confidence"), F.array_repeat(F.lit(1), (k % 4).cast("int")).alias("steps"), k.alias("end_id"))
    return o.select("o_orderkey", "o_custkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(*listings.resolved_order())).cast("long").alias("place"))
