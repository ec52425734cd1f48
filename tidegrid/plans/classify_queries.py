"""Classifications, exports and lists on the driver's tables, with the same in SQL; inputs are made of names, brands, balances and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import net
from tidegrid.plans import classify, components, facts
from tidegrid.plans.driver_queries import query, table

c = F.col


@query("""
WITH f AS (SELECT p_partkey, p_type, replace(lower(p_name), ' ', '-') AS app, string_split(p_name, ' ')[-1] AS tail, lower(replace(p_brand, '#', '')) AS brand FROM part)
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Redis' WHEN 'MEDIUM' THEN 'Kafka' WHEN 'PROMO' THEN 'Java Jar' WHEN 'LARGE' THEN 'Node' ELSE 'Other' END AS type,
 CASE p_type WHEN 'ECONOMY' THEN 'container-image' WHEN 'MEDIUM' THEN 'container-command' END AS basis, CASE p_type WHEN 'ECONOMY' THEN 'Redis' WHEN 'MEDIUM' THEN 'MQ' WHEN 'PROMO' THEN 'Java' WHEN 'LARGE' THEN 'Node' ELSE 'Other' END AS export,
 p_type IN ('ECONOMY', 'MEDIUM') AS middleware, CASE p_type WHEN 'PROMO' THEN app || '.jar' WHEN 'LARGE' THEN '/srv/' || app || '/' || tail || '.mjs (PID ' || p_partkey || ')' ELSE tail || ' (PID ' || p_partkey || ')' END AS detail FROM f
""")
def process_exports(spark, d):
    """Types of processes in and out of containers, their class in exports and what is shown of them."""
    p = table(spark, d, "part").select("p_partkey", "p_type", F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")).alias("app"), F.element_at(F.split("p_name", " "), -1).alias("tail"))
    t = lambda k: c("p_type") == k
    j = lambda *x: F.concat(*[c(y[1:]) if y.startswith("$") else F.lit(y) for y in x])
    command = F.when(t("PROMO"), j("java -jar /srv/", "$app", ".jar")).when(t("LARGE"), j("node --inspect /srv/", "$app", "/", "$tail", ".mjs")).otherwise(j("/srv/bin/", "$tail", " ", "$app"))
    name = F.when(t("PROMO"), "java").when(t("LARGE"), "node").otherwise(c("tail"))
    image = F.when(t("ECONOMY"), j("hub.example.com/", "$app", "/redis:7@sha256:", "$tail")).otherwise(j("hub.example.com/", "$app"))
    inside = F.when(t("MEDIUM"), j("/opt/docker-entrypoint.sh java -cp /srv/", "$app", " kafka.Kafka")).otherwise(j("/srv/bin/", "$tail"))
    x = classify.container_type(name, command, F.when(~t("SMALL"), "init"), inside, image)
    e = classify.export_class(x["type"], command)
    return p.select("p_partkey", x["type"].alias("type"), x["basis"].alias("basis"), e["type"].alias("export"), e["middleware"].alias("middleware"), classify.process_detail(e["type"], name, command, c("p_partkey")).alias("detail"))


@query("""
WITH z AS (SELECT s_suppkey, s_nationkey, lower(replace(s_name, '#', '-')) AS host, 'n' || s_nationkey || '.example.com' AS zone, s_acctbal AS b FROM supplier)
SELECT s_suppkey, CASE WHEN b < 0 THEN zone WHEN b < 3000 THEN host || '.' || zone ELSE host || '.' || zone END AS owner, CASE WHEN b < 0 THEN 'paused' WHEN b < 6000 THEN 'active' ELSE 'unknown' END AS status FROM z
""")
def dns_owners(spark, d):
    """Names of records: the zone itself, whole names and those below the zone; and their states."""
    host, zone = F.replace("s_name", F.lit("#"), F.lit("-")), F.concat(F.lit("n"), c("s_nationkey").cast("string"), F.lit(".example.com"))
    raw = F.when(c("s_acctbal") < 0, "@").when(c("s_acctbal") < 3000, F.concat(F.lit(" "), host, F.lit("."), zone, F.lit("."))).otherwise(host)
    state = F.when(c("s_acctbal") < 0, "DISABLE").when(c("s_acctbal") < 6000, "ENABLE").otherwise(c("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", classify.dns_owner(raw, zone).alias("owner"), classify.dns_status(state).alias("status"))


@query("""
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'MySQL' WHEN 'MACHINERY' THEN 'RabbitMQ' WHEN 'FURNITURE' THEN 'Elasticsearch' WHEN 'HOUSEHOLD' THEN 'Kafka' ELSE 'unknown' END AS service,
 (c_acctbal > 5000 OR c_mktsegment = 'FURNITURE') AS mapper, CASE WHEN c_acctbal < 0 THEN 'unknown' WHEN c_acctbal < 2000 THEN 'no' WHEN c_acctbal < 7000 THEN 'yes' ELSE 'unknown' END AS access,
 CASE WHEN c_acctbal < 0 THEN 'login' WHEN c_acctbal < 2000 AND c_nationkey > 12 THEN 'denied' WHEN c_acctbal < 2000 THEN 'missing' WHEN c_acctbal < 7000 THEN 'found' ELSE 'no clear result' END AS reason, c_acctbal < 0 AS stop FROM customer
""")
def setting_services(spark, d):
    """Services that settings name, mapper files, and what answers of a code host say, by segment, balance and nation."""
    s, b = c("c_mktsegment"), c("c_acctbal")
    name = F.lower(F.replace("c_name", F.lit("#"), F.lit(".")))
    key = F.concat(name, F.lit("."), F.when(s == "BUILDING", "spring.datasource.url").when(s == "MACHINERY", "broker").when(s == "FURNITURE", "es.nodes").when(s == "HOUSEHOLD", "kafka-servers").otherwise("title"))
    scheme = F.when(s == "BUILDING", "jdbc:mysql").when(s == "MACHINERY", "amqp").otherwise("")
    path = F.concat(F.lit("src/"), F.when(b > 5000, "Mappers/").otherwise("conf/"), name, F.lit(".xml"))
    head = F.when(s == "FURNITURE", F.concat(F.lit("<?xml version='1.0'?>\n<mapper  namespace = '"), name, F.lit("'>"))).otherwise("<configuration>")
    body = F.when(b < 0, F.to_json(F.struct(F.lit("x").alias("errorCode"), F.lit("goLogin").alias("errorAction")))).when(b < 2000, F.to_json(F.struct(F.when(c("c_nationkey") > 12, "Forbidden").otherwise("404").alias("errorCode"))))
    found = F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.struct(F.lit("project").alias("type"), (c("c_custkey") + 1).alias("id")).alias("pathResource"), c("c_name").alias("assetsName")).alias("result")))
    x = classify.access_status(body.when(b < 7000, found).otherwise(F.to_json(F.struct(F.lit(True).alias("success")))))
    return table(spark, d, "customer").select("c_custkey", classify.service_of(key, scheme).alias("service"), classify.mapper_file(path, head).alias("mapper"), x["access"].alias("access"), x["reason"].alias("reason"), x["stop"].alias("stop"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' ' || CASE o_orderstatus WHEN 'O' THEN '10:20:30' ELSE '01:02:03' END AS second, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, '', '' FROM orders WHERE o_orderstatus = 'P'
""")
def snapshot_times(spark, d):
    """Times in the ids of versions, with and without a prefix; pending orders' ids have none."""
    at = F.date_format("o_orderdate", "yyyyMMdd")
    raw = F.when(c("o_orderstatus") == "O", F.concat(F.lit("topology-"), at, F.lit("-102030-"), c("o_orderkey").cast("string"))).when(c("o_orderstatus") == "F", F.concat(at, F.lit("-010203-"), c("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("draft-"), at))
    return table(spark, d, "orders").select("o_orderkey", classify.snapshot_time(raw).alias("second"), classify.snapshot_time(raw, "date").alias("date"))


@query("""
WITH i AS (SELECT l_orderkey AS o, 's' || (l_suppkey % 3) AS href, l_linenumber AS n, l_partkey AS p FROM lineitem),
x AS (SELECT o, href, min((n, p)) AS first, max((n, p)) AS last FROM i GROUP BY 1, 2)
SELECT o AS l_orderkey, string_agg(href || '=' || last[2], ',' ORDER BY first, href) AS references FROM x GROUP BY 1
""")
def unique_references(spark, d):
    """An order's references by address: the last one's label at the first one's place."""
    items = table(spark, d, "lineitem").select("l_orderkey", F.struct(c("l_linenumber").alias("n"), c("l_partkey").alias("label"), F.concat(F.lit("s"), (c("l_suppkey") % 3).cast("string")).alias("href")).alias("x"))
    listed = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))  # the items of an order
    return listed.select("l_orderkey", F.array_join(F.transform(classify.unique_by(c("x"), "href"), lambda r: F.concat_ws("=", r["href"], r["label"].cast("string"))), ",").alias("references"))


@query("""
SELECT c_custkey AS id, c_name || ',' || CASE WHEN c_nationkey > 0 THEN 'db' || c_custkey || '.inner:' || (c_nationkey + 3300) ELSE 'db' || c_custkey || '.inner' END || ',' || CASE c_mktsegment WHEN 'BUILDING' THEN '"MySQL, own"' WHEN 'MACHINERY' THEN 'PostgreSQL' ELSE c_mktsegment END || ','
 || CASE WHEN c_acctbal > 8000 THEN 'COMMON' WHEN c_acctbal > 4000 THEN 'STABLE' ELSE 'NONE_CONTROL' END || ',' || CASE WHEN c_acctbal > 8000 OR c_acctbal < 0 THEN 'automatic' ELSE 'manual' END AS line FROM customer
""")
def database_lines(spark, d):
    """Managed databases normalized and as lines of a CSV that quotes only where it must."""
    b = c("c_acctbal")
    raw = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("alias"), F.concat(F.lit("db"), c("c_custkey").cast("string"), F.lit(".inner")).alias("host"), F.when(c("c_nationkey") > 0, c("c_nationkey") + 3300).alias("port"), c("c_mktsegment").alias("db_type"), (b > 8000).alias("sell_common"), F.when(b > 4000, True).alias("sell_stable"), (b < 0).alias("sell_trust"))
    return classify.database_lines(classify.databases(raw, {"BUILDING": "MySQL, own", "MACHINERY": "PostgreSQL"}), ["name", "address", "type", "control", "login"])


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus AS s FROM orders), l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS app FROM lineitem WHERE l_returnflag = 'R'),
r AS (SELECT DISTINCT o_custkey AS repository, o_custkey % 400 AS k FROM o WHERE s <> 'P'), n AS (SELECT k, count(*) AS n FROM r GROUP BY 1),
links AS (SELECT DISTINCT o_custkey AS repository, app FROM o JOIN l ON l.o = o_orderkey WHERE s = 'F' AND o_custkey % 5 = 0), apps AS (SELECT s_suppkey AS app, s_acctbal AS b, s_nationkey AS env FROM supplier)
SELECT 'https://code.example.com/team/r' || q.k AS input, r.repository, links.app, CASE WHEN b >= 0 AND b < 8000 THEN 'E' || env END AS env, CASE WHEN b >= 0 AND b < 8000 THEN '10.0.0.' || links.app END AS ip,
 CASE WHEN r.repository IS NULL THEN 'no repository' WHEN links.app IS NULL THEN 'no application' WHEN b < 0 THEN 'application not collected' WHEN b >= 8000 THEN 'not deployed' WHEN n > 1 THEN 'several repositories' ELSE 'matched' END AS status
FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey < 500) q LEFT JOIN r ON r.k = q.k LEFT JOIN n ON n.k = r.k LEFT JOIN links ON links.repository = r.repository LEFT JOIN apps ON apps.app = links.app
UNION ALL SELECT c_name, NULL, NULL, NULL, NULL, 'invalid address' FROM customer
""".replace(" WHERE c_custkey < 500", ""))
def batch_detail(spark, d):
    """Addresses of all customers' repositories with their applications and deployments; four hundred addresses have several repositories, names are no addresses."""
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    url = lambda k: F.concat(F.lit("https://code.example.com/team/r"), k.cast("string"))
    customers = table(spark, d, "customer")
    asked = customers.select(url(c("c_custkey")).alias("input")).unionByName(customers.select(c("c_name").alias("input")))
    repositories = orders.where("o_orderstatus <> 'P'").select(c("o_custkey").alias("repository"), F.concat(F.lit("git@code.example.com:team/r"), (c("o_custkey") % 400).cast("string"), F.lit(".git")).alias("url")).distinct()
    links = orders.where("o_orderstatus = 'F' and o_custkey % 5 = 0").join(items.where("l_returnflag = 'R'"), c("o_orderkey") == c("l_orderkey")).select(c("o_custkey").alias("repository"), c("l_suppkey").alias("app"))
    s = table(spark, d, "supplier")
    deployed = s.where("s_acctbal < 8000").select(c("s_suppkey").alias("app"), F.concat(F.lit("E"), c("s_nationkey").cast("string")).alias("env"), F.concat(F.lit("10.0.0."), c("s_suppkey").cast("string")).alias("ip"))
    return classify.batch_detail(asked, repositories, links, s.where("s_acctbal >= 0").select(c("s_suppkey").alias("app")), deployed)


@query("""
WITH p AS (SELECT p_partkey, p_brand AS asset, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS state, p_size > 25 AS hit FROM part),
a AS (SELECT p_partkey, list_sort(list(DISTINCT l_suppkey)) AS apps FROM p JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 47 GROUP BY 1)
SELECT 'candidate' AS kind, asset, p_partkey AS pid, CASE WHEN len(apps) > 1 THEN 'AMBIGUOUS' WHEN len(apps) = 1 THEN 'INFERRED' ELSE 'UNKNOWN' END AS status, coalesce(array_to_string(apps, ','), '') AS applications FROM p LEFT JOIN a USING (p_partkey) WHERE hit
UNION ALL SELECT 'coverage', coalesce(state, 'not_collected'), count(DISTINCT asset), '', '' FROM p GROUP BY ALL
""")
def component_candidates(spark, d):
    """Processes with a component's main class and the applications that may be theirs, and how many assets were looked into."""
    p = table(spark, d, "part").select("p_partkey", c("p_brand").alias("asset"), F.when(c("p_type") != "PROMO", c("p_type")).alias("state"), F.concat(F.lit("java -cp /srv/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.when(c("p_size") > 25, " org.example.Quorum x").otherwise(" org.example.QuorumTool")).alias("command"), c("p_partkey").alias("pid"))
    apps = table(spark, d, "lineitem").where("l_quantity > 47").join(p, c("l_partkey") == c("p_partkey")).select("asset", "pid", c("l_suppkey").alias("app"))
    found, coverage = classify.candidates(p, apps, "org.example.Quorum")
    text = F.array_join(F.transform("applications", lambda a: a.cast("string")), ",")
    return found.select(F.lit("candidate").alias("kind"), "asset", "pid", "status", text.alias("applications")).unionByName(coverage.select(F.lit("coverage").alias("kind"), c("state").alias("asset"), c("assets").alias("pid"), F.lit("").alias("status"), F.lit("").alias("applications")))


@query("""
WITH r AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS e FROM orders),
x AS (SELECT o_orderkey, CASE WHEN s = 'P' THEN 'skipped' WHEN s = 'F' AND e = '1-URGENT' THEN 'missing' WHEN s = 'F' AND e = '5-LOW' THEN 'unsupported' END AS category FROM r)
SELECT o_orderkey AS app, category, (SELECT count(*) FROM x WHERE category IS NULL) AS refused FROM x WHERE category IN ('missing', 'unsupported')
""")
def exclusion_list(spark, d):
    """Results that may be excluded are put on a list, skipped ones are taken off again; a choice that holds others changes nothing."""
    results = table(spark, d, "orders").select(c("o_orderkey").alias("app"), F.when(c("o_orderstatus") == "P", "skipped").when(c("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"), c("o_orderpriority").alias("error"))
    errors = {"1-URGENT": "missing", "5-LOW": "unsupported"}
    none = spark.createDataFrame([], "app long, category string")
    fits = results.where(classify.exclusion_category(c("status"), c("error"), errors).isNotNull())
    now, _ = classify.excluded(none, results, fits, True, errors)
    same, wrong = classify.excluded(now, results, results, True, errors)
    left, _ = classify.excluded(same, results, results.where("status = 'skipped'"), False, errors)
    return left.crossJoin(F.broadcast(wrong.agg(F.count("*").alias("refused"))))


@query("""
WITH q AS (SELECT c_custkey AS k, lower(replace(c_name, '#', '_')) AS name, lower(c_mktsegment) AS team, c_nationkey + 8000 AS port, c_acctbal AS b FROM customer)
SELECT k AS c_custkey, CASE WHEN b < 0 THEN '' ELSE 'https://code.example.com/' || team || '/' || name END AS canonical,
 CASE WHEN b < 0 THEN '' WHEN b < 2500 THEN 'code.example.com/' || team || '/' || name WHEN b < 5000 THEN 'code.example.com/' || team || '/' || name WHEN b < 7500 THEN 'code.example.com:' || port || '/' || team || '/' || name ELSE '' END AS git_key,
 CASE WHEN b < 0 OR b >= 7500 THEN '' ELSE team END AS folder, CASE WHEN b < 0 OR b >= 7500 THEN 'none' ELSE 'own' END AS category,
 CASE WHEN b < 0 THEN name WHEN b < 7500 AND b >= 5000 THEN 'code.example.com ' || port || ' ' || team || ' ' || replace(name, '_', ' ') ELSE 'code.example.com ' || team || ' ' || replace(name, '_', ' ') END AS words FROM q
""".replace("CASE WHEN b < 0 THEN name WHEN b < 7500", "CASE WHEN b < 0 THEN '' WHEN b < 7500"))
def repository_identities(spark, d):
    """Identities of repository addresses made of customers' names, segments, nations and balances: ssh short form, https with an end, a port, and one with a password, which is no repository's."""
    name, team, b = F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))), F.lower("c_mktsegment"), c("c_acctbal")
    at = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    raw = F.when(b < 0, name).when(b < 2500, at("git@Code.Example.com:", team, "/", name, ".git")).when(b < 5000, at(" https://code.example.com/", team, "/", name, ".git/ ")).when(b < 7500, at("https://code.example.com:", (c("c_nationkey") + 8000).cast("string"), "/", team, "/", name)).otherwise(at("https://u:p@code.example.com/", team, "/", name))
    s = table(spark, d, "customer").withColumn("raw", raw)
    return s.select("c_custkey", net.canonical_git_url(c("raw")).alias("canonical"), net.git_key(c("raw")).alias("git_key"), net.repository_folder(c("raw")).alias("folder"), net.repository_category(c("raw"), ["code.example.com"]).alias("category"), net.repository_words(c("raw")).alias("words"))


@query("""
WITH s AS (SELECT s_suppkey AS k, s_suppkey // 3 AS g, s_acctbal AS b FROM supplier), x AS (SELECT *, min(b) OVER (PARTITION BY g) < 0 AS torn FROM s)
SELECT k AS s_suppkey, CASE WHEN b > 9000 THEN 'report too old' WHEN torn AND b >= 0 THEN 'members disagree' END AS redis, CASE WHEN b > 9000 THEN 'report too old' WHEN b < 2000 THEN 'mode is not standalone' WHEN b < 4000 THEN 'has replicas' END AS single,
 CASE WHEN b > 9000 THEN 'report too old' WHEN b < 1000 THEN 'not same_process' WHEN b < 3000 THEN 'no home' WHEN b < 5000 THEN 'listener not owned by the process' END AS jenkins FROM x
""")
def component_plans(spark, d):
    """Clusters of three suppliers that print their members (one that sees itself alone is another cluster, and those that see it disagree with it), single ones that print their mode, and processes that a probe looks into: facts from the texts, then the planners' reasons."""
    k, b, g = c("s_suppkey"), c("s_acctbal"), F.expr("s_suppkey div 3")
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", g.alias("g"))
    num = lambda x: x.cast("string")
    line = lambda x, flag: F.concat(F.lit("n"), num(x), F.lit(" 10.0.0."), num(x), F.lit(":6379@16379 "), flag, F.lit("master - 0 0 1 connected\n"))
    near = s.select(c("g").alias("_g"), c("s_suppkey").alias("o"))
    seen = s.join(near, c("g") == c("_g")).where((b >= 0) | (c("o") == k))
    nodes = seen.groupBy("s_suppkey").agg(F.array_join(F.array_sort(F.collect_list(line(c("o"), F.when(c("o") == k, "myself,").otherwise("")))), "").alias("nodes"))  # three lines at most
    now = F.timestamp_micros(F.lit(1704067200000000))
    base = s.join(nodes, "s_suppkey").select(
        "s_suppkey", F.concat(F.lit("a"), num(k)).alias("asset"), F.concat(F.lit("10.0.0."), num(k % 250)).alias("ip"), F.lit("/etc/x.conf").alias("config"), k.cast("int").alias("pid"), now.alias("now"), F.when(b > 9000, now - F.expr("interval 3 hours")).otherwise(now).alias("observed_at"), "nodes",
        F.concat(F.lit("redis_mode:"), F.when(b < 2000, "cluster").otherwise("standalone"), F.lit("\r\nrole:master\nconnected_slaves:"), F.when(b < 4000, "1").otherwise("0"), F.lit("\n")).alias("info"),
        F.concat(num(k), F.lit(" (java) 77\nHOST_NETNS net:[1]\nNETNS net:[1]\nCOMMAND java -jar /srv/x.war\n"), F.when(b >= 3000, "JENKINS_HOME=/srv/home\n").otherwise(""), F.lit("LISTEN *:80 pid="), F.when(b < 5000, num(k + 1)).otherwise(num(k)), F.lit(",\n"), num(k), F.lit(" (java) "), F.when(b < 1000, "78").otherwise("77")).alias("output"),
    )
    why = lambda df, name, out: components.plan(df, components.PLANNERS[name]).select("s_suppkey", c("reason").alias(out))
    pair = why(base.withColumns(facts.redis_nodes(c("nodes"))), "redis", "redis")
    alone = why(base.withColumns(facts.redis_info(c("info"))).withColumns({"live_checked": F.lit(True), "listener_pids": F.array("pid")}), "redis_single", "single")
    built = why(base.withColumns(facts.process(c("output"), c("pid"))).withColumns({"war": F.lit("/srv/x.war"), "published": F.lit(1)}), "jenkins", "jenkins")
    return pair.join(alone, "s_suppkey").join(built, "s_suppkey")


@query("""
WITH r AS (SELECT c_custkey AS k, lower(c_mktsegment) AS domain, 'n' || c_nationkey AS system, c_acctbal AS b FROM customer WHERE c_acctbal >= 0),
l AS (SELECT DISTINCT o_custkey AS k, o_custkey // 2 AS app FROM orders), h AS (SELECT app, r.k, domain, system FROM l JOIN r USING (k) WHERE b < 8000)
SELECT app, CASE WHEN count(DISTINCT (domain, system)) = 1 THEN min(domain) END AS domain, CASE WHEN count(DISTINCT (domain, system)) = 1 THEN min(system) END AS system, string_agg('org/' || domain || '/' || system || '/r' || k, ',' ORDER BY 'org/' || domain || '/' || system || '/r' || k) AS paths,
 CASE WHEN count(DISTINCT (domain, system)) = 1 THEN 'assigned' ELSE 'ambiguous' END AS status FROM h GROUP BY app
""")
def business_assignments(spark, d):
    """Domains and systems of applications by the paths of their repositories; an application is a pair of customers, what it says of rich ones is another address."""
    path = F.concat(F.lit("org/"), F.lower("c_mktsegment"), F.lit("/n"), c("c_nationkey").cast("string"), F.lit("/r"), c("c_custkey").cast("string"))
    cust = table(spark, d, "customer").select("c_custkey", "c_acctbal", path.alias("path"))
    url = F.concat(F.lit("https://code.example.com/"), "path", F.lit(".git"))
    repositories = cust.select(c("c_custkey").alias("repository"), "path", url.alias("url"), (c("c_acctbal") >= 0).alias("active"))
    links = table(spark, d, "orders").select(c("o_custkey").alias("repository"), F.expr("o_custkey div 2").alias("app")).distinct()
    apps = cust.select(F.expr("c_custkey div 2").alias("app"), F.when(c("c_acctbal") < 8000, url).otherwise(F.concat(F.lit("https://code.example.com/org/other/"), "path")).alias("url"))
    made, _ = facts.business_plan(cust.select("path"), repositories, links, apps, "org")
    return made.select("app", "domain", "system", F.array_join("paths", ",").alias("paths"), "status")


@query("""
WITH q AS (SELECT c_custkey AS k, lower(replace(c_name, '#', '-')) AS name, lower(c_mktsegment) AS seg, c_nationkey AS n, c_acctbal AS b FROM customer)
SELECT k AS c_custkey, CASE WHEN b < 0 THEN 0 WHEN b < 2000 THEN 2 WHEN b < 6000 THEN 1 ELSE -1 END AS score, CASE WHEN b < 0 THEN 0 WHEN b < 2000 THEN 4 WHEN b < 4000 THEN 3 WHEN b < 6000 THEN 2 ELSE 0 END AS specificity,
 CASE WHEN b < 0 THEN 'prefix' WHEN b < 2000 THEN 'exact' WHEN b < 4000 THEN 'prefix' WHEN b < 6000 THEN 'regex' END AS kind, CASE WHEN b < 0 THEN 1 WHEN b < 2000 THEN length('/' || seg || '/' || k) WHEN b < 4000 THEN length(seg) + 1 ELSE 0 END::INTEGER AS length,
 CASE WHEN b >= 4000 AND b < 6000 THEN NULL ELSE 8000 + n END AS listen, CASE WHEN b < 0 THEN 0 WHEN b < 4000 THEN length(seg) + 1 END::INTEGER AS rule_length,
 CASE WHEN b < 0 THEN 'none' WHEN b < 2000 THEN 'unix' WHEN b < 4000 THEN 'ip' WHEN b < 6000 THEN 'hostname' ELSE 'variable' END AS target, CASE WHEN b >= 2000 AND b < 4000 THEN '10.0.0.' || n WHEN b >= 4000 AND b < 6000 THEN name || '.inner' END AS target_host,
 CASE WHEN b >= 2000 AND b < 4000 THEN '80' WHEN b >= 4000 AND b < 6000 THEN (8000 + n)::VARCHAR END AS target_port FROM q
""")
def routing_matches(spark, d):
    """Name patterns, locations, listen entries, rules and targets of proxies, made of customers' names, segments and nations, each form by balance."""
    name, seg, n, b = F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lower("c_mktsegment"), c("c_nationkey").cast("string"), c("c_acctbal")
    port = (c("c_nationkey") + 8000).cast("string")
    at = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    by = lambda *x: F.when(b < 0, x[0]).when(b < 2000, x[1]).when(b < 4000, x[2]).when(b < 6000, x[3]).otherwise(x[4])
    host, path = at(name, ".n", n, ".example.com"), at("/", seg, "/", c("c_custkey").cast("string"))
    m = net.domain_match(by(F.lit(""), host, at("*.n", n, ".example.com"), F.lit("*.example.com, other.net"), at("x.", name)), host)
    w = net.location_match(by(F.lit("/"), at("= ", path), at("^~ /", seg), at("~ ^/", seg), at("/", name)), path)
    t = net.upstream_target(by(F.lit(""), at("unix:/run/", name), at("http://10.0.0.", n, "/x"), at("https://", name, ".inner:", port, "/y"), at("http://$", seg)))
    listen = net.listen_port(by(at(port, " ssl"), at("10.0.0.1:", port), at("[::]:", port, " ipv6only=on"), at("unix:/run/", name), at("*:", port)))
    rule = net.path_match_length(by(F.lit(""), at("/", seg), seg, at("/x", seg), name), path)
    s = table(spark, d, "customer")
    return s.select("c_custkey", m["score"].alias("score"), m["specificity"].alias("specificity"), w["kind"].alias("kind"), w["length"].alias("length"), listen.alias("listen"), rule.alias("rule_length"), t["kind"].alias("target"), t["host"].alias("target_host"), t["port"].alias("target_port"))
