"""Reports over the flat tables: wide rows by address, presence, capacity, balancers, servers against inventory, backends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegrid.functions import dates, net, strings
from tidegrid.operators import relational as rel
from tidegrid.sources import parsers

c = F.col
SOURCES = ("inventory", "cloud", "assets", "eip", "nat", "dns", "backend")
# Folder names, and process names, that say nothing about an application.
COMMON_FOLDERS = ("www", "app", "apps", "var", "opt", "lib", "libs", "bin", "sbin", "etc", "tmp", "srv", "home", "usr", "local", "conf", "config", "static", "webapps", "share", "data", "log", "logs")
GENERIC_NAMES = ("java", "node", "python", "python3", "redis-server", "mysqld", "postgres")


# presence and periods ----------------------------------------------------------------------------
def environment_presence(environments: DataFrame, absent: tuple[str, ...] = ("no environment", "无环境配置")) -> DataFrame:
    """(app_id, env, present): true if any row has an address, deploy or setting; false if all rows say so; else null, not known.

    environments has app_id, env and rows, an array of deployments.
    """
    full = lambda v: F.coalesce(F.trim(v), F.lit("")) != ""
    there = F.exists("rows", lambda r: full(r["ip"]) | full(r["deploy"]) | full(r["config"]))
    none = (F.size("rows") > 0) & F.forall("rows", lambda r: F.coalesce(r["status"].isin(*absent), F.lit(False)))
    return environments.select("app_id", "env", F.when(there, F.lit(True)).when(none, F.lit(False)).alias("present"))


def with_environments(presence: DataFrame, wanted: list[str], all_environments: list[str]) -> DataFrame:
    """Applications whose present environments are exactly the wanted ones; one that isn't known fits no combination."""
    seen = presence.groupBy("app_id").agg(F.map_from_entries(F.collect_list(F.struct("env", c("present").cast("string")))).alias("m"))
    fits = [F.coalesce(c("m")[e] == F.lit("true" if e in wanted else "false"), F.lit(False)) for e in all_environments]
    return seen.where(reduce(lambda a, b: a & b, fits)).select("app_id")


def latest_push(deployments: DataFrame) -> DataFrame:
    """(app_id, env, at): the latest successful push, from steps and from the row itself."""
    steps = parsers.latest_push(deployments.select("app_id", "env", F.explode("pushIn").alias("s")).select("app_id", "env", "s.*"), ["app_id", "env"])
    own = deployments.where("publishStatus = 'SUCCESS'").select("app_id", "env", dates.parse_time(c("lastPublishedAt")).alias("at"))
    return steps.unionByName(own).groupBy("app_id", "env").agg(F.max("at").alias("at"))


def over_a_year(deployments: DataFrame, reference: Column) -> DataFrame:
    """(app_id, env, over_year): with an address, and either no successful push or one more than twelve months ago."""
    rows = deployments.groupBy("app_id", "env").agg(F.max(F.coalesce(c("ip"), F.lit("")) != "").alias("placed")).join(latest_push(deployments), ["app_id", "env"], "left")
    old = F.when(c("at").isNull(), F.lit(True)).when(c("at") > reference, F.lit(False)).otherwise(c("at") < dates.months_before(reference, 12))
    return rows.select("app_id", "env", (c("placed") & old).alias("over_year"))


# wide rows ---------------------------------------------------------------------------------------
def wide_rows(t: dict[str, DataFrame], networks: list[str] = ()) -> DataFrame:
    """One row an address over seven sources: what it is, who refers to it, which applications it serves.

    networks: the site's own; an address there that the cloud also has is a conflict.
    """
    ip = net.normalize_ip_checked

    def part(df: DataFrame, source: str, **more: Column) -> DataFrame:
        fields = {"cloud_id": "string", "lb_id": "string", "group": "string", "reference": "string", "term": "string"}
        return df.select("ip", F.lit(source).alias("source"), *[more.get(k, F.lit(None)).cast(v).alias(k) for k, v in fields.items()])

    machine = t["compute"].select("id", F.explode(F.array_distinct(F.concat(F.coalesce("privateIps", F.array()), F.coalesce("publicIps", F.array())))).alias("a")).withColumn("ip", ip(c("a")))
    grouped = t["asset_groups"].select(F.col("key"), F.coalesce("path", "name").alias("g_path"), F.explode("assetIds").alias("asset_id"))
    deepest = rel.deepest_only(grouped.select("asset_id", "key").distinct(), "asset_id", "key").join(grouped, ["asset_id", "key"])
    asset = t["assets"].join(deepest, c("id") == c("asset_id"), "left")
    notes = t["eip"].select("id", F.explode("notes").alias("n")).select("id", F.explode(net.ips_in_text(c("n.value"))).alias("ip"))
    nat = t["nat"].select("gateway", F.explode(F.array("external_ip", "internal_ip")).alias("ip"))
    named = t["dns"].select("name", F.explode(net.ips_in_text(c("value"))).alias("ip"))
    parts = [
        part(asset, "assets", group=c("g_path")), part(machine, "cloud", cloud_id=c("id")), part(t["balancers"], "cloud", lb_id=c("id")), part(t["servers"], "backend", reference=F.concat(F.lit("backend of "), "lb"), term=c("lb")),
        part(t["eip"], "eip", reference=F.concat(F.lit("public address "), "id"), term=c("name")), part(t["eip"], "cloud"), part(notes, "eip", reference=F.concat(F.lit("note of "), "id")), part(nat, "nat", reference=F.concat(F.lit("translation by "), "gateway"), term=c("gateway")),
        part(named, "dns", reference=F.concat(F.lit("name "), "name"), term=c("name")), part(t["deployments"], "inventory"),
    ]
    every = reduce(DataFrame.unionByName, parts).where("ip <> ''")
    sets = lambda k: F.array_sort(F.collect_set(k))
    rows = every.groupBy("ip").agg(sets("cloud_id").alias("cloud_ids"), sets("lb_id").alias("lb_ids"), sets("group").alias("groups"), sets("reference").alias("references"), sets("term").alias("terms"), F.collect_set("source").alias("s"))
    apps = t["deployments"].where("ip <> ''").groupBy("ip", "app_name", "app_id", "env", "port", "repository").agg(F.max(F.coalesce("lastPublishedAt", F.lit(""))).alias("pushed_at"))
    apps = apps.groupBy("ip").agg(F.array_sort(F.collect_list(F.struct("app_name", "app_id", "env", "port", "repository", "pushed_at"))).alias("associations"))
    both = every.where("source = 'cloud' and cloud_id is not null").select("cloud_id", "ip").distinct()
    managed = every.where("source = 'assets'").select("ip").distinct()
    other = both.alias("a").join(both.join(managed, "ip", "left_semi").alias("b"), (c("a.cloud_id") == c("b.cloud_id")) & (c("a.ip") != c("b.ip"))).groupBy("a.ip").agg(F.array_sort(F.collect_set("b.ip")).alias("other_managed"))
    has = lambda s: F.array_contains("s", s)
    own = net.in_networks(c("ip"), list(networks))
    kind = F.when(F.size("lb_ids") > 0, "load balancer").when(F.size("cloud_ids") > 0, "cloud machine").when(has("eip") & has("cloud"), "public address").when(own, "own site").when(has("nat"), "translation").when(has("backend"), "backend").when(has("dns"), "name").otherwise("")
    out = rows.join(apps, "ip", "left").join(other, "ip", "left")
    return out.select(
        "ip", kind.alias("kind"), ((own & has("cloud")) | ((F.size("lb_ids") > 0) & (F.size("cloud_ids") > 0))).alias("conflict"), "cloud_ids", "lb_ids", "groups", "references", "terms",
        F.coalesce("associations", F.array().cast(apps.schema["associations"].dataType)).alias("associations"), F.coalesce("other_managed", F.array().cast("array<string>")).alias("other_managed"),
        F.struct(*[has(s).alias(s) for s in SOURCES]).alias("sources"),
    )


def summarize_wide(rows: DataFrame) -> DataFrame:
    """One row of counts: how many addresses each source has, and which of those in use no asset manages."""
    s = lambda name: c(f"sources.{name}")
    n = lambda test, name: F.count(F.when(test, 1)).alias(name)
    used = s("inventory") | s("cloud")
    return rows.agg(F.count("*").alias("total"), n(s("inventory"), "inventory"), n(s("cloud"), "cloud"), n(s("assets"), "assets"), n(used, "used"), n(used & ~s("assets"), "missing"), n(s("inventory") & ~s("assets"), "inventory_missing"), n(s("cloud") & ~s("assets"), "cloud_missing"), n(c("kind") == "own site", "own_site"), n(c("kind") == "", "unknown"), n(used & ~s("assets") & (F.size("other_managed") > 0), "alternate"))


# capacity, balancers, groups ---------------------------------------------------------------------
def capacity(machines: DataFrame, *by: str) -> DataFrame:
    """Machines, cores, memory, running ones and those with a public address."""
    return machines.groupBy(*by).agg(F.count("*").alias("machines"), F.sum("cpu").alias("cpu"), F.sum("memoryGiB").alias("memory_gib"), F.count(F.when(F.lower("status") == "running", 1)).alias("running"), F.count(F.when(F.size("publicIps") > 0, 1)).alias("public"))


def balancer_totals(t: dict[str, DataFrame]) -> DataFrame:
    """Each load balancer's distinct backends (by id, else address), those that a listener or rule uses, memberships and listeners without a group."""
    member = t["servers"].withColumn("backend", F.coalesce(F.nullif("server_id", F.lit("")), "ip"))
    named = t["listeners"].select("lb", "group_id").unionByName(t["listeners"].select("lb", F.explode("rules").alias("r")).select("lb", c("r.groupId").alias("group_id"))).distinct()
    used = member.join(named, ["lb", "group_id"], "left_semi").groupBy("lb").agg(F.countDistinct("backend").alias("used"))
    empty = t["listeners"].join(member.select("lb", "group_id").distinct(), ["lb", "group_id"], "left_anti").groupBy("lb").agg(F.count("*").alias("empty_listeners"))
    return member.groupBy("lb").agg(F.countDistinct("backend").alias("backends"), F.count("*").alias("memberships")).join(used, "lb", "left").join(empty, "lb", "left").na.fill(0)


def certificates(listeners: DataFrame, query: str = "") -> DataFrame:
    """Certificates with the listeners that use them; a query keeps certificates, or else listeners, whose fields contain it."""
    rows = listeners.select("lb", "lb_name", "protocol", "port", F.explode("certificates").alias("x")).select("lb", "lb_name", "protocol", "port", "x.*")
    rows = rows.withColumn("key", F.coalesce(F.nullif("id", F.lit("")), F.concat_ws("|", "domain", "commonName")))
    if query.strip():
        q = F.lit(query.strip().lower())
        rows = rows.where(F.lower(F.concat_ws(" ", "id", "name", "domain", "commonName")).contains(q) | F.lower(F.concat_ws(" ", "lb", "lb_name", "protocol", "port")).contains(q))
    return rows.groupBy("key").agg(F.min("domain").alias("domain"), F.min("commonName").alias("common_name"), F.max("expiresAt").alias("expires_at"), F.countDistinct("lb").alias("balancers"), F.array_sort(F.collect_set(F.concat_ws("/", "lb", "protocol", "port"))).alias("listeners"))


def top_groups(assets: DataFrame, groups: DataFrame, root: str = "1") -> DataFrame:
    """Assets of each group right below the root; those in several are "several groups", those in none "default only"."""
    member = groups.where(c("parentKey") == root).select(F.explode("assetIds").alias("id"), "name").groupBy("id").agg(F.count("*").alias("n"), F.min("name").alias("g"))
    label = F.when(c("n") > 1, "several groups").otherwise(F.coalesce("g", F.lit("default only")))
    return assets.select("id").join(member, "id", "left").groupBy(label.alias("group")).agg(F.count("*").alias("assets"))


def repository_groups(repositories: DataFrame, groups: DataFrame) -> DataFrame:
    """Each group with its repositories at any depth: all, linked to an application, accessible, without one, only in the inventory."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    below = repositories.withColumn("g", F.explode(up))
    n = lambda test, name: F.count(F.when(test, 1)).alias(name)
    made = below.groupBy("g").agg(n(c("inCodeup"), "listed"), n(c("inCodeup") & (F.size("apps") > 0), "linked"), n(c("access").isin("yes", "是"), "accessible"), n(c("difference") == "codeup_only", "unused"), n(c("difference") == "devops_only", "inventory_only"))
    return groups.select("id", "name", "path").join(made, c("path") == c("g"), "left").drop("g").na.fill(0)


def one_to_one(assets: DataFrame, machines: DataFrame, networks: list[str] = ()) -> DataFrame:
    """Assets with their machine: matched if the address match is unique both ways and no address is the site's own, ambiguous, own-site or unmatched."""
    a = assets.select(c("id").alias("asset"), F.explode(net.address_list(c("ip"))).alias("ip"))
    m = machines.select(c("id").alias("machine"), F.explode(F.concat(F.coalesce("privateIps", F.array()), F.coalesce("publicIps", F.array()))).alias("ip")).withColumn("ip", net.normalize_ip_checked(c("ip")))
    pair = a.join(m, "ip").select("asset", "machine").distinct()
    pair = pair.withColumn("n_m", F.count("*").over(W.partitionBy("asset"))).withColumn("n_a", F.count("*").over(W.partitionBy("machine")))
    best = pair.groupBy("asset").agg(F.min("machine").alias("machine"), F.max(F.greatest("n_m", "n_a")).alias("n"))
    own = a.groupBy("asset").agg(F.max(net.in_networks(c("ip"), list(networks))).alias("own"))
    out = assets.select(c("id").alias("asset")).join(own, "asset", "left").join(best, "asset", "left")
    status = F.when(c("own").isNull(), "ambiguous").when((c("n") > 1) | (c("own") & c("n").isNotNull()), "ambiguous").when(c("n") == 1, "matched").when(c("own"), "own-site").otherwise("unmatched")
    return out.select("asset", F.when(status == "matched", c("machine")).alias("machine"), status.alias("status"))


# servers against inventory -----------------------------------------------------------------------
def matches_process(app: Column, name: Column, kind: Column, command: Column) -> Column:
    """Whether a process is an application's: by jar, proxy, declared id, folder, server folder, long name in the command, or process name."""
    a, low, cmd = strings.squeezed(app), F.lower(app), F.lower(F.coalesce(command, F.lit("")))
    jar = strings.squeezed(F.regexp_replace(F.coalesce(strings.jar_name(cmd), F.lit("")), r"\.(jar|war)$", ""))
    long, common = F.length(low) >= 3, low.isin(*COMMON_FOLDERS)
    part = lambda lead, tails: reduce(lambda x, y: x | y, [F.contains(cmd, F.concat(F.lit(p), low, F.lit(s))) for p in lead for s in tails])
    declared = F.concat(F.lit(" "), cmd, F.lit(" "))
    by_id = reduce(lambda x, y: x | y, [F.contains(declared, F.concat(F.lit("-dappid="), low, F.lit(s))) for s in (" ", "-", "/", ".", ",", ";", '"', "'")])
    rules = [
        (jar != "") & (F.contains(jar, a) | F.contains(a, jar)), (kind == "Nginx") & low.contains("nginx"), by_id, long & ~common & part("/", "/."), long & part(("tomcat_", "tomcat/"), "_/."),
        (F.length(low) >= 6) & ~common & F.contains(cmd, low), (F.length(name) >= 4) & ~F.lower(name).isin(*GENERIC_NAMES) & (F.lower(name) == a),
    ]
    return (F.length(a) >= 2) & reduce(lambda x, y: x | y, [F.coalesce(r, F.lit(False)) for r in rules])


def server_comparison(t: dict[str, DataFrame], webapps: DataFrame | None = None) -> DataFrame:
    """(ip, app_id, app_name, env, pid, process, webapp, status) of what should run on each inspected host, and processes that nothing names.

    An application has the first process by pid that matches it, else the folder of the same
    name; status: process, webapp, missing, or extra for what is left of non-system, known types.
    """
    p = t["processes"].select(c("asset_ip").alias("ip"), "pid", "name", "command", F.coalesce("system", F.lit(False)).alias("system")).withColumn("kind", strings.process_type(c("name"), c("command"), c("system")))
    d = t["deployments"].where("ip <> ''").select("ip", "app_id", "app_name", "env").distinct().join(t["assets"].select("ip").distinct(), "ip", "left_semi")
    hit = d.join(p.where("not system"), "ip").where(matches_process(c("app_name"), c("name"), c("kind"), c("command")))
    best = hit.groupBy("ip", "app_id", "env").agg(F.min_by(F.struct("pid", c("name").alias("process")), "pid").alias("x"))
    out = d.join(best, ["ip", "app_id", "env"], "left")
    if webapps is None:
        out = out.withColumn("webapp", F.lit(None).cast("string"))
    else:
        w = webapps.select("ip", c("name").alias("webapp"), strings.squeezed(c("name")).alias("w"))
        out = out.withColumn("w", strings.squeezed(c("app_name"))).join(w, ["ip", "w"], "left").drop("w")
    status = F.when(c("x").isNotNull(), "process").when(c("webapp").isNotNull(), "webapp").otherwise("missing")
    known = out.select("ip", "app_id", "app_name", "env", "x.pid", "x.process", F.when(c("x").isNull(), c("webapp")).alias("webapp"), status.alias("status"))
    extra = p.where("not system and kind not in ('Other', 'System')").join(hit.select("ip", "pid").distinct(), ["ip", "pid"], "left_anti")
    none = F.lit(None).cast("string")
    return known.unionByName(extra.select("ip", none.alias("app_id"), none.alias("app_name"), none.alias("env"), "pid", c("name").alias("process"), none.alias("webapp"), F.lit("extra").alias("status")))


def process_categories(processes: DataFrame) -> DataFrame:
    """(ip, kind, n): processes of each type on each host; system ones and a proxy's workers don't count."""
    p = processes.withColumn("kind", strings.process_type(c("name"), c("command"), c("system"))).where("kind <> 'System'")
    return p.where(~((c("kind") == "Nginx") & F.lower("command").contains("worker process"))).groupBy(c("asset_ip").alias("ip"), "kind").agg(F.count("*").alias("n"))


def listening_ports(t: dict[str, DataFrame]) -> DataFrame:
    """(ip, ports): a host's listening ports as inspected, else those of its processes; null if neither was collected."""
    seen = t["app_ports"].groupBy(c("asset_ip").alias("ip")).agg(F.array_sort(F.collect_set("port")).alias("a"))
    own = t["processes"].select(c("asset_ip").alias("ip"), F.explode("ports").alias("x")).groupBy("ip").agg(F.array_sort(F.collect_set("x.port")).alias("b"))
    return t["assets"].where("ip <> ''").select("ip").distinct().join(seen, "ip", "left").join(own, "ip", "left").select("ip", F.coalesce("a", "b").alias("ports"))


def cpu_percent(before: Column, after: Column) -> Column:
    """Busy share between two readings of CPU counters (idle is the fourth, waiting for disks the fifth), one decimal."""
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
    idle = lambda v: F.coalesce(F.get(v, F.lit(3)), F.lit(0)) + F.coalesce(F.get(v, F.lit(4)), F.lit(0))
    spent = total(after) - total(before)
    return F.when(spent > 0, F.round((spent - (idle(after) - idle(before))) * 100 / spent, 1)).otherwise(0.0)


def memory_percent(total: Column, available: Column, free: Column, buffers: Column, cached: Column) -> Column:
    """Used share of memory, by what is available, else by what is free, buffered and cached; null if neither is known."""
    used = F.coalesce(total - available, total - free - F.coalesce(buffers, F.lit(0)) - F.coalesce(cached, F.lit(0)))
    return F.when(total > 0, F.round(used * 100 / total, 1)).otherwise(F.when(used.isNotNull(), 0.0))


# backends ----------------------------------------------------------------------------------------
def backends(nodes: DataFrame, edges: DataFrame, most_hints: int = 8) -> DataFrame:
    """(endpoint, status, applications, hints) of every endpoint that something forwards to.

    A deployment that listens on the same address and port is a match, whatever the protocol; several
    applications or an ambiguous listener are ambiguous.  Without a match, what listens on other ports of
    the address are hints, by port, never the answer; a report shows most_hints of them.
    """
    ends = nodes.where("type = 'ENDPOINT'").select(c("id").alias("endpoint"), c("identity")["ip"].alias("ip"), c("identity")["port"].alias("port"))
    asked = edges.where("type = 'FORWARDS_TO'").select(c("dst").alias("endpoint")).distinct().join(ends, "endpoint")
    owner = edges.where("type = 'HAS_DEPLOYMENT'").select(c("src").alias("application"), c("dst").alias("deployment"))
    listen = edges.where("type = 'LISTENS_ON'").select(c("src").alias("deployment"), c("dst").alias("endpoint"), "confidence").join(owner, "deployment").join(ends, "endpoint").select("ip", "port", "application", "deployment", "confidence")
    exact = asked.join(listen, ["ip", "port"]).groupBy("endpoint").agg(F.array_sort(F.collect_set("application")).alias("applications"), F.max(c("confidence") == "AMBIGUOUS").alias("weak"))
    hint = asked.join(exact, "endpoint", "left_anti").join(listen.withColumnRenamed("port", "other"), "ip").where("port <> other")
    hint = hint.withColumn("k", F.row_number().over(W.partitionBy("endpoint").orderBy(c("other").try_cast("int"), "application", "deployment"))).where(c("k") <= most_hints)
    hint = hint.groupBy("endpoint").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "other", "application").alias("h")))), lambda x: x["h"]).alias("hints"))
    status = F.when(c("applications").isNull(), "unresolved").when((F.size("applications") > 1) | c("weak"), "ambiguous").otherwise("exact")
    empty = F.array().cast("array<string>")
    return asked.join(exact, "endpoint", "left").join(hint, "endpoint", "left").select("endpoint", status.alias("status"), F.coalesce("applications", empty).alias("applications"), F.coalesce("hints", empty).alias("hints"))


def retired_members(events: DataFrame, key: str, at: str = "at", kind: str = "kind") -> DataFrame:
    """(key, state, since): how far each member has got on the way seen, retired, confirmed, absent; unknown if it was never seen.

    events: (key, at, kind). The steps must come one after the other; another "seen" begins again, steps out of order count for nothing, and
    of events at the same time a "seen" is the later one. since is the time of the last step.
    """
    e = events.select(F.col(key), F.col(at).alias("_at"), F.col(kind).alias("_kind"))
    state = e.groupBy(key).agg(F.max(F.when(F.col("_kind") == "seen", F.col("_at"))).alias("t0"))
    steps = ("retired", "confirmed", "absent")
    for k, step in enumerate(steps):
        # the first event of this step after the one before; members that haven't come so far have no time there
        later = e.where(F.col("_kind") == step).join(state.select(key, F.col(f"t{k}").alias("_last")), key).where(F.col("_at") > F.col("_last"))
        state = state.join(later.groupBy(key).agg(F.min("_at").alias(f"t{k + 1}")), key, "left")
    last = F.coalesce(*[F.col(f"t{k}") for k in (3, 2, 1, 0)])
    name = F.when(F.col("t3").isNotNull(), "absent").when(F.col("t2").isNotNull(), "confirmed").when(F.col("t1").isNotNull(), "retired").when(F.col("t0").isNotNull(), "seen").otherwise("unknown")
    return state.select(key, name.alias("state"), last.alias("since"))


def trace_origins(connections: DataFrame, assets: DataFrame, probes: DataFrame) -> DataFrame:
    """(target, port, origin, asset, process, status): who connects to a target's port, in two phases.

    connections: (target, port, remote_ip); assets: (asset, ip, ord), ip being one or several addresses; probes: (asset, dest_ip, dest_port, process),
    what processes of an asset connect to. Phase one reduces connections to distinct addresses of targets and finds the first
    asset of each; phase two keeps only the probes of these assets that go to a target asked for, before it attributes them.
    status: attributed (a row a process), no process, not in assets.
    """
    origins = connections.where("remote_ip is not null").select("target", "port", F.col("remote_ip").alias("origin")).distinct()
    owner = assets.select("asset", "ord", F.explode(F.filter(F.split("ip", r"[\s,]+"), lambda x: x != "")).alias("origin")).groupBy("origin").agg(F.min_by("asset", F.struct("ord", "asset")).alias("asset"))
    known = origins.join(owner, "origin", "left")
    wanted = known.where("asset is not null").select("asset", F.col("target").alias("dest_ip"), F.col("port").alias("dest_port")).distinct()
    seen = probes.join(wanted, ["asset", "dest_ip", "dest_port"], "left_semi").select(F.col("asset").alias("_asset"), "dest_ip", "dest_port", "process").distinct()
    out = known.join(seen, (F.col("asset") == F.col("_asset")) & (F.col("target") == F.col("dest_ip")) & (F.col("port") == F.col("dest_port")), "left")
    status = F.when(F.col("asset").isNull(), "not in assets").when(F.col("process").isNull(), "no process").otherwise("attributed")
    return out.select("target", "port", "origin", "asset", "process", status.alias("status"))
