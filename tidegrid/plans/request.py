"""Where requests go: name, public address, translation, load balancer, proxy, deployment, repository.

All requests of a table are traced together.  A branch is a row of the frontier; a resolver
is a function from the frontier to moves, made of joins with the flat tables; a round is the union of
all resolvers' moves, written to the shared folder.  Ties are kept, never picked from, and a branch
that nothing can carry on is kept with the reason why.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegrid.functions import net
from tidegrid.operators.graph import CONFIDENCE, name_of, settle

from .topology import ACTIVE_DNS, routes_of

#: A branch: the request, where it stands (id, kind, ip, port), how it came there.
BRANCH = ["req", "host", "path", "env", "port", "ip", "at", "kind", "nodes", "steps"]
STEP = "array<struct<resolver:string,rule:string,rank:int>>"
EXACT, INFERRED, AMBIGUOUS = CONFIDENCE["EXACT"], CONFIDENCE["INFERRED"], CONFIDENCE["AMBIGUOUS"]
Resolver = Callable[[DataFrame, dict[str, DataFrame]], DataFrame]


def _move(df: DataFrame, resolver: str, to: Column, kind: str | Column, rule: Column, rank: Column | int, ip: Column | None = None, port: Column | None = None, via: Column | None = None) -> DataFrame:
    """Branches carried on to a node; via are nodes passed on the way."""
    passed = via if via is not None else F.array().cast("array<string>")
    return df.select(
        "req", "host", "path", "env", (F.col("port") if port is None else F.coalesce(port.try_cast("int"), F.col("port"))).alias("port"), (F.col("ip") if ip is None else ip).alias("ip"), to.alias("to"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("to_kind"), passed.alias("via"), F.struct(F.lit(resolver).alias("resolver"), rule.alias("rule"), (F.lit(rank) if isinstance(rank, int) else rank).cast("int").alias("rank")).alias("step"), "at", "kind", "nodes", "steps",
    )


def dns(f: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """A request to its name; a name over live records to names, public addresses, load balancers, else the host."""
    records = t["dns"].where(F.col("type").isin("A", "AAAA", "CNAME") & F.lower("status").isin(*ACTIVE_DNS)).withColumn("v_ip", net.normalize_ip(F.col("value")))
    named = t["dns"].select("name").unionByName(routes_of(t).select(F.explode("domains").alias("name"))).distinct()
    start = f.where("kind = 'REQUEST'").join(named, F.col("host") == F.col("name"))
    moves = [_move(start, "dns", net.domain_id(F.col("name")), "DOMAIN", F.lit("host name"), EXACT)]
    at = f.where("kind = 'DOMAIN'").join(records, F.col("at") == net.domain_id(F.col("name")))
    moves.append(_move(at.where("type = 'CNAME'"), "dns", net.domain_id(F.col("value")), "DOMAIN", F.lit("CNAME"), EXACT))
    address = at.where("type <> 'CNAME'")
    eip, lb = t["eip"].select(F.col("id").alias("e"), F.col("ip").alias("x")), t["balancers"].select(F.col("id").alias("l"), F.col("ip").alias("x"))
    moves.append(_move(address.join(eip, F.col("v_ip") == F.col("x")), "dns", F.concat(F.lit("eip:"), "e"), "EIP", F.lit("A"), EXACT, F.col("v_ip")))
    direct = lb.join(eip, "x", "left_anti")
    moves.append(_move(address.join(direct, F.col("v_ip") == F.col("x")), "dns", F.concat(F.lit("clb:"), "l"), "CLB", F.lit("A"), EXACT, F.col("v_ip")))
    other = address.join(eip.select("x").unionByName(lb.select("x")).distinct(), F.col("v_ip") == F.col("x"), "left_anti")
    moves.append(_move(other, "dns", net.host_id(F.col("v_ip")), "HOST", F.lit("A"), EXACT, F.col("v_ip")))
    return reduce(DataFrame.unionByName, moves)


def nat(f: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """A public address to what it is bound to; a gateway over the rules that take the port to internal endpoints."""
    bound = t["eip"].select(F.concat(F.lit("eip:"), "id").alias("b_at"), "bindingId", F.col("ip").alias("b_ip"), F.lower("bindingType").rlike("ecs|instance|eni|nic|实例|网卡").alias("loose"))
    at = f.where("kind = 'EIP'").join(bound, F.col("at") == F.col("b_at"))
    gateways, lbs = t["nat"].select(F.col("gateway").alias("g")).distinct(), t["balancers"].select(F.col("id").alias("l"))
    machine = t["compute"].groupBy(F.col("id").alias("m")).agg(F.min(net.normalize_ip(F.get("privateIps", F.lit(0)))).alias("m_ip"))
    at = at.join(gateways, F.col("bindingId") == F.col("g"), "left").join(lbs, F.col("bindingId") == F.col("l"), "left").join(machine, F.col("bindingId") == F.col("m"), "left")
    moves = [
        _move(at.where("g is not null"), "nat", F.concat(F.lit("nat-gateway:"), "g"), "NAT_GATEWAY", F.lit("binding"), EXACT),
        _move(at.where("g is null and l is not null"), "lb", F.concat(F.lit("clb:"), "l"), "CLB", F.lit("binding"), EXACT),
        _move(at.where("g is null and l is null and m is not null"), "nat", net.host_id(F.col("m_ip")), "HOST", F.lit("binding"), EXACT, F.col("m_ip")),
        _move(at.where("g is null and l is null and m is null and loose"), "nat", net.host_id(F.col("b_ip")), "HOST", F.lit("address only"), AMBIGUOUS, F.col("b_ip")),
    ]
    rules = t["nat"].where("entry is not null").withColumn("r", net.port_range(F.col("external_port"))).where(net.transport(F.col("protocol")) != "udp").select("gateway", "entry", F.col("external_ip").alias("x_ip"), "r", "internal_ip", "internal_port", "protocol")
    hit = f.where("kind = 'NAT_GATEWAY'").join(rules, (F.col("at") == F.concat(F.lit("nat-gateway:"), "gateway")) & (F.col("ip") == F.col("x_ip"))).where(F.col("port").between(F.col("r.low"), F.col("r.high")))
    moves.append(_move(hit, "nat", net.endpoint_id(F.col("internal_ip"), F.col("internal_port"), F.col("protocol")), "ENDPOINT", F.concat(F.lit("DNAT "), "entry"), EXACT, F.col("internal_ip"), F.col("internal_port"), F.array(F.concat_ws(":", F.lit("dnat-rule"), "gateway", "entry"))))
    vip = f.where("kind = 'ENDPOINT'").join(t["balancers"].select(F.col("id").alias("l"), F.col("ip").alias("v")), F.col("ip") == F.col("v"))
    moves.append(_move(vip, "lb", F.concat(F.lit("clb:"), "l"), "CLB", F.lit("VIP"), EXACT))
    return reduce(DataFrame.unionByName, moves)


def balancer(f: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """A load balancer over listener and rule to all backends; fan-out is no ambiguity, rules of one rank are."""
    listeners = t["listeners"].withColumn("p_rank", F.when(F.col("protocol").isin("http", "https"), 2).when(F.col("protocol") == "tcp", 1).otherwise(0)).select(F.col("lb"), F.col("protocol").alias("l_protocol"), F.col("port").alias("l_port"), F.col("group_id").alias("l_group"), "rules", F.coalesce("backendPort", "forwardPort").alias("l_back"), "p_rank")
    at = f.where("kind = 'CLB'").join(listeners, (F.col("at") == F.concat(F.lit("clb:"), "lb")) & (F.col("port").cast("string") == F.col("l_port")) & (F.col("l_protocol") != "udp"))
    one = W.partitionBy("req", "nodes", "at")
    at = at.withColumn("k", F.rank().over(one.orderBy(F.desc("p_rank")))).where("k = 1").withColumn("rule", F.explode_outer("rules"))
    d, length = net.domain_match(F.lower("rule.domain"), F.col("host")), net.path_match_length(F.col("rule.path"), F.col("path"))
    fits = F.col("rule").isNotNull() & (d["score"] >= 0) & length.isNotNull()
    at = at.withColumn("order", F.when(fits, F.struct(d["score"].alias("a"), d["specificity"].alias("b"), length.alias("c"))).otherwise(F.struct(F.lit(-1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))))
    at = at.withColumn("group_id", F.when(fits, F.coalesce(F.nullif("rule.groupId", F.lit("")), "l_group")).otherwise(F.col("l_group"))).withColumn("said", F.when(fits, F.concat(F.lit("rule "), "rule.id")).otherwise(F.lit("default group")))
    at = at.withColumn("k", F.rank().over(one.orderBy(F.desc("order")))).where("k = 1").drop("rule", "rules", "order", "k")
    at = at.dropDuplicates(["req", "nodes", "lb", "l_protocol", "l_port", "group_id"])
    at = at.withColumn("choices", F.size(F.collect_set("group_id").over(one)))
    server = t["servers"].select("lb", "group_id", F.col("ip").alias("s_ip"), F.col("port").alias("s_port"))
    hit = at.join(server, ["lb", "group_id"]).withColumn("b_port", F.when(F.col("s_port").rlike(r"^\d+$"), F.col("s_port")).otherwise(F.coalesce(F.col("l_back"), F.lit("unknown"))))
    via = F.array(F.concat_ws(":", F.lit("clb-listener"), "lb", "l_protocol", "l_port"), F.concat_ws(":", F.lit("clb-server-group"), "lb", "group_id"))
    return _move(hit, "lb", net.endpoint_id(F.col("s_ip"), F.col("b_port"), F.col("l_protocol")), "ENDPOINT", F.col("said"), F.when(F.col("choices") > 1, AMBIGUOUS).otherwise(EXACT), F.col("s_ip"), F.col("b_port"), via)


def proxy(f: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """A host or endpoint over the routes that listen there: server name, then location; ties kept; only addresses are followed."""
    r = routes_of(t).withColumn("ports", F.filter(F.transform("listen", net.listen_port), lambda p: p.isNotNull()))
    r = r.select("asset_ip", "route_id", "upstream_id", "domains", "uri", "ports", "backends", F.col("protocol").alias("r_protocol"), "up", "directive")
    at = f.where("kind in ('HOST', 'ENDPOINT')").join(r, F.col("ip") == F.col("asset_ip")).where(F.array_contains("ports", F.col("port")))
    scores = F.transform("domains", lambda d: net.domain_match(d, F.col("host")))
    best = F.coalesce(F.array_max(scores), F.struct(F.lit(0).alias("score"), F.lit(0).alias("specificity")))
    at = at.withColumn("named", best).withColumn("place", net.location_match(F.coalesce("uri", F.lit("/")), F.col("path"))).where("named.score >= 0 and place.kind is not null and place.kind <> 'regex'")
    tier = F.when(F.col("place.kind") == "exact", 2).when(F.col("place.kind") == "prefix", 1).otherwise(0)
    one = W.partitionBy("req", "nodes", "at")
    at = at.withColumn("k", F.rank().over(one.orderBy(F.desc("named"), F.desc(F.struct(tier, F.col("place.length")))))).where("k = 1").withColumn("choices", F.size(F.collect_set("route_id").over(one)))
    hit = at.where("upstream_id is not null").select("*", F.explode("backends").alias("b")).where("b.resolution = 'ip'").withColumn("n_ip", net.normalize_ip(F.col("b.host"))).withColumn("n_port", net.normalize_port(F.col("b.port")))
    return _move(hit, "proxy", net.endpoint_id(F.col("n_ip"), F.col("n_port"), F.col("r_protocol")), "ENDPOINT", F.concat(F.lit("location "), F.coalesce("uri", F.lit("/"))), F.when(F.col("choices") > 1, AMBIGUOUS).otherwise(EXACT), F.col("n_ip"), F.col("n_port"), F.array("route_id", "upstream_id"))


def deployment(f: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """An endpoint to deployments by address and port, of the asked environment first, else by address alone; then the application."""
    d = t["deployments"].where("ip <> ''").select(F.col("ip").alias("d_ip"), F.col("port").alias("d_port"), F.col("env").alias("d_env"), "app_id", "deploy")
    at = f.where("kind = 'ENDPOINT'").join(d, F.col("ip") == F.col("d_ip"))
    same = F.col("d_port") == F.col("port").cast("string")
    tier = F.when(same & (F.col("d_env") == F.col("env")), 3).when(same & F.col("env").isNull(), 3).when(same, 2).when(~F.col("d_port").rlike(r"^\d+$"), 1)
    at = at.withColumn("tier", tier).where("tier is not null")
    one = W.partitionBy("req", "nodes", "at")
    at = at.withColumn("k", F.rank().over(one.orderBy(F.desc("tier")))).where("k = 1").withColumn("apps", F.size(F.collect_set("app_id").over(one)))
    rank = F.when(F.col("apps") > 1, AMBIGUOUS).when(F.col("tier") == 1, INFERRED).otherwise(EXACT)
    rule = F.when(F.col("tier") == 3, "address, port and environment").when(F.col("tier") == 2, "address and port").otherwise("address only")
    moves = _move(at, "deployment", F.concat_ws(":", F.lit("deployment"), "app_id", "d_env", "deploy"), "DEPLOYMENT", rule, rank)
    owner = f.where("kind = 'DEPLOYMENT'")
    return moves.unionByName(_move(owner, "deployment", F.concat(F.lit("application:"), F.split("at", ":")[1]), "APPLICATION", F.lit("owner"), EXACT))


def repository(f: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """An application to its repository; one that the inventory of repositories lacks is inferred."""
    own = t["deployments"].where("repository <> ''").groupBy("app_id").agg(F.min_by("repository", F.struct("env", "deploy")).alias("r"))
    apps = t["apps"].join(own, F.col("id") == F.col("app_id"), "left").select(F.concat(F.lit("application:"), "id").alias("a_at"), F.coalesce(F.nullif("repository", F.lit("")), "r").alias("url")).where("url is not null")
    known = t["repositories"].select(F.col("canonical").alias("url"), F.lit(True).alias("known")).distinct()
    hit = f.where("kind = 'APPLICATION'").join(apps, F.col("at") == F.col("a_at")).join(known, "url", "left")
    return _move(hit, "repository", F.concat(F.lit("repository:"), F.substr(F.sha2("url", 256), F.lit(1), F.lit(16))), "REPOSITORY", F.col("url"), F.when(F.col("known"), EXACT).otherwise(INFERRED))


RESOLVERS: dict[str, Resolver] = {"dns": dns, "nat": nat, "lb": balancer, "proxy": proxy, "deployment": deployment, "repository": repository}
#: Where a branch has to stand for a resolver to move it; other resolvers see every frontier.
KINDS: dict[Resolver, set[str]] = {dns: {"REQUEST", "DOMAIN"}, nat: {"EIP", "NAT_GATEWAY", "ENDPOINT"}, balancer: {"CLB"}, proxy: {"HOST", "ENDPOINT"}, deployment: {"ENDPOINT", "DEPLOYMENT"}, repository: {"APPLICATION"}}


def requests(asked: DataFrame, url_col: str = "url", env_col: str | None = None) -> DataFrame:
    """The first frontier; an address that is no request is left out."""
    parsed = asked.select(F.col(url_col).alias("req"), net.parse_request(F.col(url_col)).alias("r"), (F.upper(F.col(env_col)) if env_col else F.lit(None).cast("string")).alias("env")).where("r is not null").distinct()
    return parsed.select("req", "r.host", "r.path", "env", "r.port", F.lit(None).cast("string").alias("ip"), F.concat(F.lit("request:"), "req").alias("at"), F.lit("REQUEST").alias("kind"), F.array().cast("array<string>").alias("nodes"), F.array().cast(STEP).alias("steps"))


def trace(asked: DataFrame, t: dict[str, DataFrame], url_col: str = "url", env_col: str | None = None, depth: int = 16, resolvers: dict[str, Resolver] = RESOLVERS) -> DataFrame:
    """(req, nodes, steps, end_id, terminal, confidence, reason): every branch of every request to its end.

    Each round's ends are written with it, and joins are by sorting both sides: a plan over all rounds would send every round's branches to the driver at once.
    """
    t = {name: df.hint("merge") for name, df in t.items()}
    frontier, ended, key = settle(requests(asked, url_col, env_col), "frontier"), [], ["req", "nodes", "at"]
    for _ in range(depth):
        stand = {r.kind for r in frontier.select("kind").distinct().collect()}  # kinds of nodes, not branches
        if not stand:
            break
        asked_of = [r for r in resolvers.values() if KINDS.get(r, stand) & stand]
        if not asked_of:
            ended.append(frontier.withColumn("reason", F.when(F.col("kind") == "REQUEST", "no entry").otherwise("no candidate")))
            break
        moves = settle(reduce(DataFrame.unionByName, [r(frontier.hint("merge"), t) for r in asked_of]).dropDuplicates([*key, "to", "via"]), "moves")
        moved = moves.groupBy(*key).agg(F.max(F.coalesce(~F.array_contains("nodes", F.col("to")), F.lit(False))).alias("fresh"))
        left = frontier.join(moved.hint("merge"), key, "left").where("fresh is null or not fresh")
        reason = F.when(F.col("fresh").isNotNull(), "cycle").when(F.col("kind") == "REQUEST", "no entry").otherwise("no candidate")
        ended.append(settle(left.select(*BRANCH, reason.alias("reason")), "ended"))
        fresh = moves.where(~F.array_contains("nodes", F.col("to")))
        made = fresh.select("req", "host", "path", "env", "port", "ip", F.col("to").alias("at"), F.col("to_kind").alias("kind"), F.concat("nodes", "via", F.array("to")).alias("nodes"), F.array_append("steps", F.col("step")).alias("steps"))
        ended.append(made.where("kind = 'REPOSITORY'").withColumn("reason", F.lit(None).cast("string")))
        frontier = made.where("kind <> 'REPOSITORY'")
    else:
        ended.append(frontier.withColumn("reason", F.lit("too deep")))
    every = reduce(DataFrame.unionByName, ended)
    weakest = F.array_min(F.transform("steps", lambda s: s["rank"]))
    return every.select("req", "nodes", "steps", "at", (F.col("kind") == "REPOSITORY").alias("terminal"), "kind", F.coalesce(name_of(weakest), F.lit("UNKNOWN")).alias("confidence"), "reason").withColumnRenamed("at", "end_id")


def statuses(paths: DataFrame) -> DataFrame:
    """(req, status, paths): AMBIGUOUS if branches end at different repositories or, without one, at different applications; RESOLVED, PARTIAL, UNRESOLVED."""
    each = paths.groupBy("req").agg(
        F.count("*").alias("paths"), F.countDistinct(F.when(F.col("terminal"), F.col("end_id"))).alias("ends"), F.countDistinct(F.when(F.col("kind").isin("APPLICATION"), F.col("end_id"))).alias("apps"),
        F.max(F.when(F.col("kind") != "REQUEST", F.size("nodes"))).alias("far"),
    )
    status = F.when((F.col("ends") > 1) | ((F.col("ends") == 0) & (F.col("apps") > 1)), "AMBIGUOUS").when(F.col("ends") == 1, "RESOLVED").when(F.col("far") > 1, "PARTIAL").otherwise("UNRESOLVED")
    return each.select("req", status.alias("status"), "paths")


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of so many characters; null for a shorter text."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))))


def find_locations(t: dict[str, DataFrame], asked: DataFrame) -> DataFrame:
    """(asked, route_id, uri, exact, domains, asset, file): routes whose location contains the text, whatever the case; exact ones are marked.

    A text that contains another has all its runs of up to three characters: each text asks for its rarest run, and what has that is compared.
    """
    a = asked.where(F.trim("asked") != "").select("asked", F.lower(F.trim("asked")).alias("q")).distinct()
    r = routes_of(t).select("route_id", "uri", F.array_join("domains", ",").alias("domains"), "asset", "file").withColumn("low", F.lower("uri"))
    grams = r.select("low").distinct().select("low", F.explode(F.array_distinct(F.flatten(F.filter(F.array(*[_grams(F.col("low"), k) for k in (1, 2, 3)]), lambda x: x.isNotNull())))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("uris"))
    mine = a.select("q", F.explode(_grams(F.col("q"), 3)).alias("gram")).unionByName(a.where(F.length("q") < 3).select("q", F.col("q").alias("gram")))
    rarest = mine.join(often, "gram").groupBy("q").agg(F.min_by("gram", F.struct("uris", "gram")).alias("gram"))
    hit = rarest.join(grams, "gram").where(F.col("low").contains(F.col("q"))).select("q", "low")
    return a.join(hit, "q").join(r, "low").select("asked", "route_id", "uri", (F.col("low") == F.col("q")).alias("exact"), "domains", "asset", "file")
