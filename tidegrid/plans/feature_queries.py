"""Buffers, configurations, log scopes, memos, quarantine, rotated logs, retirement, origins and blocks on the driver's tables, with the same in SQL.

Texts, addresses and states are made of the tables' own names, keys, balances and times.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidegrid.operators import flows, graph, memo
from tidegrid.plans import reports
from tidegrid.plans.driver_queries import query, table
from tidegrid.sources import applogs, proxyconf, sinks

c = F.col

OBSERVATIONS, FLOWS, SOCKETS = 20, 12, 3


@query(f"""
WITH e AS (SELECT user_id, ts, event_id, event_type IN ('view', 'click', 'signup') AS peer, (props->>'$.k')::INTEGER // 10 AS host, CASE WHEN value > 20 THEN 'high' ELSE 'low' END AS context, date_trunc('day', ts) AS frame FROM events),
p AS (SELECT *, peer AND row_number() OVER (PARTITION BY user_id, peer, frame ORDER BY ts, event_id) <= {SOCKETS} AS taken FROM e),
t AS (SELECT *, count(*) FILTER (taken) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM p),
f AS (SELECT *, min((ts, event_id)) OVER (PARTITION BY user_id, host) AS first FROM t WHERE NOT peer),
g AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY first) AS number, lag(context) OVER w AS before, lag(total) OVER w AS seen FROM f WINDOW w AS (PARTITION BY user_id, host ORDER BY ts, event_id))
SELECT g.user_id AS "check", g.event_id AS ref, t.event_id AS other, t.total AS n, 'seen' AS status FROM g JOIN t ON t.user_id = g.user_id AND t.host = g.host AND t.taken
 AND t.total > greatest(CASE WHEN before = g.context THEN seen ELSE 0 END, g.total - {OBSERVATIONS}) AND t.total <= g.total WHERE number <= {FLOWS}
UNION ALL SELECT user_id, event_id, NULL, NULL, 'flow left out' FROM g WHERE number > {FLOWS} AND (ts, event_id) = first
UNION ALL SELECT user_id, event_id, NULL, NULL, 'socket left out' FROM t WHERE peer AND NOT taken
""")
def observation_buffer(spark, d):
    """What each sample of a connection finds new among its user's last observations; users are checks, days are frames, values make the context."""
    e = table(spark, d, "events").withColumn("host", F.get_json_object("props", "$.k").cast("int").cast("double"))
    host = F.floor(c("host") / 10).cast("string")
    peer = c("event_type").isin("view", "click", "signup")
    here, there = (F.concat(F.lit("10.0.0."), host), F.lit(80)), (F.concat(F.lit("10.1.0."), host), F.lit(5000))
    way = lambda a, b, k: F.when(peer, b[k]).otherwise(a[k])
    events = e.select(
        c("user_id").alias("check"), c("ts").alias("at"), c("event_id").alias("seq"), F.when(peer, "peer").otherwise("flow").alias("kind"), F.when(peer, F.unix_seconds(F.date_trunc("day", c("ts").cast("timestamp")))).alias("frame"),
        way(here, there, 0).alias("local_ip"), way(here, there, 1).alias("local_port"), way(there, here, 0).alias("peer_ip"), way(there, here, 1).alias("peer_port"), F.lit("tcp").alias("protocol"), F.when(~peer, F.when(c("value") > 20, "high").otherwise("low")).alias("context"), c("event_id").alias("ref"),
    )
    return flows.buffered_matches(events, OBSERVATIONS, FLOWS, SOCKETS)


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus AS s FROM orders), cust AS (SELECT c_custkey, lower(replace(c_name, '#', '-')) AS name, c_nationkey + 8000 AS port FROM customer)
SELECT c_custkey::VARCHAR AS dump, '/etc/px/sites/' || name || '.conf' AS file, name AS server, '/' AS uri, 'static/other' AS directive, '/srv/' || name || '/' AS target, NULL AS backend FROM cust
UNION ALL SELECT c_custkey::VARCHAR, '/etc/px/sites/' || name || '.conf', name, '/order/' || o_orderkey, CASE s WHEN 'O' THEN 'proxy_pass' WHEN 'F' THEN 'access_control' ELSE 'static/other' END,
 CASE s WHEN 'O' THEN 'http://pool' WHEN 'F' THEN 'deny all' ELSE '/srv/p/' || o_orderkey END, CASE s WHEN 'O' THEN name || '.inner:' || port END FROM cust JOIN o ON o_custkey = c_custkey
""")
def proxy_routes(spark, d):
    """Routes of a proxy configuration for each customer, with a Lua body, an included file, and a location for each order: passed on, denied or served by its status."""
    name = F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))
    cust = table(spark, d, "customer").select("c_custkey", name.alias("name"), (c("c_nationkey") + 8000).cast("string").alias("port"))
    inside = F.when(c("o_orderstatus") == "O", "proxy_pass http://pool;").when(c("o_orderstatus") == "F", "deny all;").otherwise(F.concat(F.lit("alias /srv/p/"), c("o_orderkey").cast("string"), F.lit(";")))
    places = table(spark, d, "orders").select("o_custkey", F.concat(F.lit("  location /order/"), c("o_orderkey").cast("string"), F.lit(" { # {{\n    "), inside, F.lit("\n  }\n")).alias("place"))
    places = places.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("place")), "").alias("places"))  # a customer's orders
    j = lambda *x: F.concat(*[F.coalesce(c(y[1:]), F.lit("")) if y.startswith("$") else F.lit(y) for y in x])
    text = j("# configuration file /etc/px/main.conf:\nhttp {\n  upstream pool { server ", "$name", ".inner:", "$port", "; }\n  init_by_lua_block { local s = '}' --[[ } ]] }\n  include sites/*.conf;\n}\n# configuration file /etc/px/sites/", "$name", ".conf:\nserver {\n  server_name ", "$name", ";\n  root /srv/", "$name", "/;\n", "$places", "}\n")
    dumps = cust.join(places, c("c_custkey") == c("o_custkey"), "left").select(c("c_custkey").alias("dump"), text.alias("text"))
    nodes, _ = proxyconf.expanded(dumps)
    b = F.get("backends", F.lit(0))
    return proxyconf.routes(nodes).select("dump", "file", c("server_names")[0].alias("server"), "uri", "directive", "target", F.concat_ws(":", b["host"], b["port"]).alias("backend")).withColumn("backend", F.nullif("backend", F.lit("")))


@query("""
WITH RECURSIVE props AS (SELECT p_partkey AS k, CASE WHEN p_partkey < 3 THEN '/var/log/apps/' || replace(p_name, ' ', '-') ELSE NULL END AS root, p_partkey // 3 AS up, '/' || replace(p_name, ' ', '_') AS part FROM part),
w AS (SELECT p_partkey AS id, p_partkey AS cur, '' AS tail, NULL::VARCHAR AS root, 0 AS pass FROM part
 UNION ALL SELECT id, CASE WHEN p.root IS NULL THEN up ELSE NULL END, CASE WHEN p.root IS NULL THEN part || tail ELSE tail END, p.root, pass + 1 FROM w JOIN props p ON k = cur WHERE pass < 5 AND w.root IS NULL)
SELECT 'part-' || p_partkey AS path_of, CASE WHEN root IS NULL THEN 'cycle' ELSE 'ok' END AS status, root || tail AS root, CASE WHEN root IS NOT NULL THEN 'app-*.*.log' END AS pattern
FROM part JOIN (SELECT id, arg_max(root, pass) AS root, arg_max(tail, pass) AS tail FROM w GROUP BY id) ON id = p_partkey
""".replace("arg_max(root, pass) AS root", "max(root) AS root"))
def log_scopes(spark, d):
    """Folders and patterns of log paths whose names stand for each other: five passes reach as far as a name's fifth parent."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    ref = lambda k: F.concat(F.lit("${k"), k.cast("string"), F.lit("}"))
    value = F.when(c("p_partkey") < 3, F.concat(F.lit("/var/log/apps/"), F.replace("p_name", F.lit(" "), F.lit("-")))).otherwise(F.concat(ref(F.expr("p_partkey div 3")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_"))))
    props = p.select(F.lit("logback.xml").alias("file"), F.concat(F.lit("k"), c("p_partkey").cast("string")).alias("name"), value.alias("value"))
    paths = p.select(F.lit("logback.xml").alias("file"), F.concat(ref(c("p_partkey")), F.lit("/app-%d{yyyy-MM-dd}.%i.log")).alias("path"))
    found = applogs.log_scopes(props, paths)
    return found.select(F.concat(F.lit("part-"), F.regexp_extract("path", r"\{k(\d+)\}", 1)).alias("path_of"), "status", "root", "pattern")


@query("""
WITH first AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN 'denied' ELSE 'valid' END AS status, CASE WHEN f.o_custkey IS NOT NULL THEN 1 ELSE 2 END::INTEGER AS run,
 (SELECT count(DISTINCT o_custkey) FROM orders) AS keys, (SELECT count(*) FROM first) AS known, (SELECT count(DISTINCT o_custkey) FROM orders) - (SELECT count(*) FROM first) AS checked
FROM orders o JOIN customer ON c_custkey = o.o_custkey LEFT JOIN first f ON f.o_custkey = o.o_custkey
""")
def evaluate_once(spark, d):
    """Every order's customer is checked once: those of finished orders in a first run, the others in a second, which returns all."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", c("o_custkey").cast("string").alias("key"))
    results = memo.Memo(spark, graph.scratch(spark, "memo"), "status string, run int")
    state = table(spark, d, "customer").select(c("c_custkey").cast("string").alias("key"), F.when(c("c_acctbal") < 0, "denied").otherwise("valid").alias("status"))
    check = lambda n: lambda keys: keys.join(state, "key").withColumn("run", F.lit(n))
    results.evaluate(orders.where("o_orderstatus = 'F'"), check(1), datetime(2024, 1, 1))
    made, progress = results.evaluate(orders, check(2), datetime(2024, 1, 2))
    return made.select("o_orderkey", "status", "run", *[F.lit(progress[k]).cast("long").alias(k) for k in ("keys", "known", "checked")])


@query("""
WITH q AS (SELECT *, o_orderstatus = 'P' AS a, o_totalprice < 50000 AS b, o_orderpriority LIKE '%NOT SPECIFIED' AS x FROM orders),
n AS (SELECT count(*) AS rows, count(*) FILTER (a OR b OR x) AS quarantined, count(*) FILTER (a) AS inactive, count(*) FILTER (b) AS price, count(*) FILTER (x) AS priority FROM q)
SELECT o_orderkey, concat_ws('+', CASE WHEN a THEN 'non_active_status' END, CASE WHEN b THEN 'price' END, CASE WHEN x THEN 'priority' END) AS reasons, rows, quarantined, inactive, price, priority FROM q, n WHERE a OR b OR x
""")
def quarantined_orders(spark, d):
    """Orders that are pending, cheap or without a priority are set apart with all their reasons; the report's counts come from the same pass."""
    checks = [("non_active_status", c("o_orderstatus") == "P"), ("price", c("o_totalprice") < 50000), ("priority", c("o_orderpriority").endswith("NOT SPECIFIED"))]
    _, bad, report = memo.quarantine(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), checks)
    counts = {"rows": report["rows"], "quarantined": report["quarantined"], "inactive": report["reasons"]["non_active_status"], "price": report["reasons"]["price"], "priority": report["reasons"]["priority"]}
    return bad.select("o_orderkey", F.array_join("reasons", "+").alias("reasons"), *[F.lit(v).cast("long").alias(k) for k, v in counts.items()])


@query("""
WITH RECURSIVE listed AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'BUILDING'),
refs(k) AS (SELECT o_custkey FROM orders UNION SELECT c_custkey // 7 FROM listed UNION SELECT k // 7 FROM refs JOIN customer ON c_custkey = k WHERE k NOT IN (SELECT c_custkey FROM listed))
SELECT c_custkey, TRUE AS listed, TRUE AS found FROM listed UNION ALL
SELECT k, FALSE, c_custkey IS NOT NULL AND c_mktsegment <> 'FURNITURE' FROM refs LEFT JOIN customer ON c_custkey = k WHERE k NOT IN (SELECT c_custkey FROM listed)
 AND k IN (SELECT o_custkey FROM orders UNION SELECT c_custkey // 7 FROM customer WHERE (c_custkey IN (SELECT c_custkey FROM listed)) UNION SELECT r.k // 7 FROM refs r JOIN customer x ON x.c_custkey = r.k AND x.c_mktsegment <> 'FURNITURE')
""")
def repaired_references(spark, d):
    """A listing of customers that leaves some out: those that orders or other customers' parents name are asked for by key until nothing new is named."""
    every = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    orders = table(spark, d, "orders").select(c("o_custkey").alias("c_custkey"))
    listed = every.where("c_acctbal >= 0 and c_mktsegment <> 'BUILDING'")
    first = [True]

    def references(rows):
        above = rows.select(F.expr("c_custkey div 7").alias("c_custkey"))
        out, first[0] = above.unionByName(orders) if first[0] else above, False
        return out

    have, gone = memo.repaired(listed, "c_custkey", references, lambda keys: every.where("c_mktsegment <> 'FURNITURE'").join(keys, "c_custkey", "left_semi"))
    return have.select("c_custkey", "listed", F.lit(True).alias("found")).unionByName(gone.select("c_custkey", F.lit(False).alias("listed"), F.lit(False).alias("found")))


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderstatus = 'F', o_orderdate DESC, o_orderkey DESC) - 1 AS line FROM orders)
SELECT line, o_orderkey, TRUE AS bounded, TRUE AS truncated FROM o WHERE line < 500
""")
def rotated_log(spark, d):
    """Orders appended to a log in two runs, finished ones first; its last 500 lines, whether all files keep their size, and that there is more."""
    orders = table(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_orderstatus")
    log = sinks.RotatedLog(spark, graph.scratch(spark, "log"), most=1 << 16)
    for part in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"):
        log.append(orders.where(part), ["o_orderdate", "o_orderkey"])
    last, report = log.tail(500)
    bounded = all(size <= log.most for _, size in log.files())
    return last.select("line", F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"), F.lit(bounded).alias("bounded"), F.lit(report["truncated"]).alias("truncated"))


@query("""
WITH s AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS t0 FROM events GROUP BY 1),
r AS (SELECT s.user_id, t0, min(ts) AS t1 FROM s LEFT JOIN events e ON e.user_id = s.user_id AND event_type = 'signup' AND ts > t0 GROUP BY ALL),
f AS (SELECT r.user_id, t0, t1, min(ts) AS t2 FROM r LEFT JOIN events e ON e.user_id = r.user_id AND event_type = 'click' AND ts > t1 GROUP BY ALL),
a AS (SELECT f.user_id, t0, t1, t2, min(ts) AS t3 FROM f LEFT JOIN events e ON e.user_id = f.user_id AND event_type = 'error' AND ts > t2 GROUP BY ALL)
SELECT user_id, CASE WHEN t3 IS NOT NULL THEN 'absent' WHEN t2 IS NOT NULL THEN 'confirmed' WHEN t1 IS NOT NULL THEN 'retired' WHEN t0 IS NOT NULL THEN 'seen' ELSE 'unknown' END AS state, coalesce(t3, t2, t1, t0) AS since FROM a
""")
def retired_members(spark, d):
    """How far each user has got from its last view over signup and click to error, as a replica goes from seen to retired, confirmed and absent."""
    kind = F.when(c("event_type") == "view", "seen").when(c("event_type") == "signup", "retired").when(c("event_type") == "click", "confirmed").when(c("event_type") == "error", "absent")
    return reports.retired_members(table(spark, d, "events").select("user_id", c("ts").alias("at"), kind.alias("kind")), "user_id")


@query("""
WITH con AS (SELECT DISTINCT l_suppkey AS target, l_linenumber + 8000 AS port, l_partkey AS origin FROM lineitem WHERE l_returnflag = 'R'),
own AS (SELECT p_partkey AS origin, p_brand || '-' || p_size AS asset FROM part WHERE p_type <> 'PROMO'),
probe AS (SELECT DISTINCT p_brand || '-' || p_size AS asset, l_suppkey AS target, l_linenumber + 8000 AS port, p_name AS process FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'F')
SELECT con.target, con.port, con.origin::VARCHAR AS origin, own.asset, process, CASE WHEN own.asset IS NULL THEN 'not in assets' WHEN process IS NULL THEN 'no process' ELSE 'attributed' END AS status
FROM con LEFT JOIN own USING (origin) LEFT JOIN probe ON probe.asset = own.asset AND probe.target = con.target AND probe.port = con.port
""")
def origin_trace(spark, d):
    """Who connects to suppliers: parts of returned items are addresses, brands with sizes are assets of several addresses, finished items are their processes' connections."""
    items, parts = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"), table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_type", "p_name")
    asset = F.concat_ws("-", "p_brand", c("p_size").cast("string"))
    port = (c("l_linenumber") + 8000).alias("port")
    connections = items.where("l_returnflag = 'R'").select(c("l_suppkey").alias("target"), port, c("l_partkey").cast("string").alias("remote_ip"))
    assets = parts.where("p_type <> 'PROMO'").groupBy(asset.alias("asset")).agg(F.array_join(F.array_sort(F.collect_list(c("p_partkey").cast("string"))), ", ").alias("ip"), F.min("p_partkey").alias("ord"))
    probes = items.where("l_linestatus = 'F'").join(parts, c("l_partkey") == c("p_partkey")).select(asset.alias("asset"), c("l_suppkey").alias("dest_ip"), port.alias("dest_port"), c("p_name").alias("process"))
    return reports.trace_origins(connections, assets, probes)


@query("""
WITH o AS (SELECT c_custkey, o_orderkey, o_orderstatus AS s, c_name, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS k FROM customer JOIN orders ON o_custkey = c_custkey),
x AS (SELECT *, CASE s WHEN 'O' THEN 3 WHEN 'F' THEN 5 ELSE 1 END AS height, sum(CASE s WHEN 'O' THEN 3 WHEN 'F' THEN 5 ELSE 1 END) OVER (PARTITION BY c_custkey ORDER BY k) AS below FROM o)
SELECT c_custkey, o_orderkey, (1 + below - height)::INTEGER AS first, (below)::INTEGER AS last FROM x WHERE s <> 'P'
UNION ALL SELECT c_custkey, o_orderkey, NULL, NULL FROM x WHERE s = 'P'
""")
def location_blocks(spark, d):
    """The lines of each order's block in its customer's configuration: plain, nested with braces in quotes and comments, or not there."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    key = c("o_orderkey").cast("string")
    block = F.when(c("o_orderstatus") == "O", F.concat(F.lit("  location  = /o/"), key, F.lit(" {\n    return 200 \"}\"; # }\n  }\n"))).when(c("o_orderstatus") == "F", F.concat(F.lit("  location = /o/"), key, F.lit(" # {\n  {\n    if ($a) { set $b '{'; }\n    # }}\n  }\n"))).otherwise(F.concat(F.lit("  # location = /o/"), key, F.lit(" {\n")))
    text = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("block")))).alias("x")).select("o_custkey", F.concat(F.lit("server {\n"), F.array_join(F.transform("x", lambda b: b["block"]), ""), F.lit("}\n")).alias("text"))
    asked = o.select("o_custkey", "o_orderkey", F.concat(F.lit("= /o/"), key).alias("uri"))
    found = asked.join(proxyconf.location_blocks(text, asked, ["o_custkey"]), ["o_custkey", "uri"])
    return found.select(c("o_custkey").alias("c_custkey"), "o_orderkey", c("start").alias("first"), c("end").alias("last"))
