"""A domain's chain as staged tables: names, entries, proxies, upstream groups, backends, and what is missing between them.

Unlike a path search each stage is a join on one type of relation, so all asked domains are answered at once.
Traffic is never led through a host to another port: a backend is an application's only by address and port.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import net
from tidegrid.operators import graph
from tidegrid.plans import reports

c = F.col


@dataclass(frozen=True)
class Chain:
    """names (asked, node, distance); entries, proxies, groups and gaps by asked domain; summary has one row for each."""

    names: DataFrame
    entries: DataFrame
    proxies: DataFrame
    groups: DataFrame
    gaps: DataFrame
    summary: DataFrame


def _ident(key: str) -> Column:
    return F.coalesce(c("identity")[key], F.lit(""))


def _list(text: Column) -> Column:
    return F.array_sort(F.collect_set(F.nullif(text, F.lit(""))))


def domain_names(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, node, distance) of asked domains (column asked) and the names that they are aliases of."""
    starts = asked.select("asked", net.domain_id(c("asked")).alias("node")).distinct()
    links = edges.where("type = 'CNAME_TO'").select("src", "dst")
    return starts.withColumnRenamed("node", "start").join(graph.closure(links, starts.select("node").distinct()), "start").select("asked", "node", "distance")


def expand_entries(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, target, kind, binding, binding_id, rule, endpoint, ip): where names resolve to, and what stands behind.

    kind: eip, clb or host.  A public address is bound to a gateway, a balancer or a host, the first by id; of a gateway only rules that
    expose this address count; a balancer's endpoints are those of its listeners' groups.
    """
    of = lambda kind, a, b: edges.where(c("type") == kind).select(c("src").alias(a), c("dst").alias(b))
    node = nodes.select(c("id").alias("target"), c("type").alias("target_type"), _ident("ip").alias("target_ip"))
    first = names.join(of("RESOLVES_TO", "node", "target"), "node").select("asked", "target").distinct().join(node, "target")
    bound = edges.where("type = 'BOUND_TO'").groupBy(c("src").alias("target")).agg(F.min("dst").alias("binding_id"))
    kind_of = nodes.select(c("id").alias("binding_id"), c("type").alias("binding_type"), _ident("ip").alias("binding_ip"))
    e = first.join(bound.join(kind_of, "binding_id", "left"), "target", "left")
    kind = F.when(c("target_type") == "EIP", "eip").when(c("target_type") == "CLB", "clb").otherwise("host")
    binding = F.when(c("binding_type") == "NAT_GATEWAY", "gateway").when(c("binding_type") == "CLB", "balancer").when(c("binding_id").isNotNull(), "host")
    e = e.select("asked", "target", "target_ip", kind.alias("kind"), F.when(kind == "eip", binding).alias("binding"), F.when(kind == "eip", c("binding_id")).alias("binding_id"), "binding_ip")
    ip_of = lambda id_col, name: nodes.where("type = 'ENDPOINT'").select(c("id").alias(id_col), _ident("ip").alias(name))
    exposes = of("EXPOSES", "rule", "shown").join(ip_of("shown", "target_ip"), "shown").select("rule", "target_ip")
    rules = of("HAS_DNAT_RULE", "binding_id", "rule").join(exposes, "rule").join(of("FORWARDS_TO", "rule", "endpoint"), "rule", "left")
    by_rule = e.where("binding = 'gateway'").join(rules, ["binding_id", "target_ip"]).select("asked", "target", "rule", "endpoint")
    balanced = of("HAS_LISTENER", "lb", "listener").join(of("ROUTES_TO", "listener", "group"), "listener").join(of("FORWARDS_TO", "group", "endpoint"), "group").select("lb", c("listener").alias("rule"), "endpoint")
    front = e.where("kind = 'clb' or binding = 'balancer'").select("asked", "target", F.when(c("kind") == "clb", c("target")).otherwise(c("binding_id")).alias("lb"))
    behind = by_rule.unionByName(front.join(balanced, "lb").select("asked", "target", "rule", "endpoint")).join(ip_of("endpoint", "end_ip"), "endpoint", "left")
    out = e.join(behind, ["asked", "target"], "left")
    ip = F.when(c("kind") == "host", c("target_ip")).when(c("binding") == "host", c("binding_ip")).otherwise(c("end_ip"))
    return out.select("asked", "target", "kind", "binding", "binding_id", "rule", "endpoint", ip.alias("ip")).distinct()


def serving_routes(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, route, asset, ...) of the proxy routes that serve a name; a route's own list of domains must have it, if there is one."""
    domain = nodes.where("type = 'DOMAIN'").select(c("id").alias("node"), F.lower(_ident("name")).alias("name"))
    served = edges.where("type = 'SERVED_BY'").select(c("src").alias("node"), c("dst").alias("route"))
    route = nodes.where("type = 'NGINX_ROUTE'").select(c("id").alias("route"), _ident("assetId").alias("asset"), _ident("assetIp").alias("asset_ip"), F.lower(_ident("domains")).alias("domains"), _ident("uri").alias("uri"), _ident("directive").alias("directive"), _ident("target").alias("route_target"), F.coalesce(c("attributes")["listen"], F.lit("")).alias("listen"), F.coalesce(c("attributes")["context"], F.lit("")).alias("context"))
    hit = names.join(domain, "node").join(served, "node").join(route, "route").where((c("domains") == "") | F.array_contains(F.split("domains", ","), c("name")))
    return hit.drop("node", "name", "distance", "domains").distinct()


def explore(nodes: DataFrame, edges: DataFrame, asked: DataFrame, samples: int = 20, gap_list: int = 15) -> Chain:
    """The chain of each asked domain (column asked).

    status: resolved if a backend is just one application's, ambiguous if one is several's or only hints are there,
    else unresolved; not-found without such a name.  samples and gap_list are the lengths of the report's lists; counts are of all.
    """
    nodes, edges = graph.settle(nodes, "chain"), graph.settle(edges, "chain")
    asked = asked.select("asked").distinct()
    known = nodes.where("type = 'DOMAIN'").select(c("id").alias("node"), "status")
    names = graph.settle(domain_names(edges, asked).join(known, "node", "left_semi"), "chain")
    entries = graph.settle(expand_entries(nodes, edges, names), "chain")
    routes = graph.settle(serving_routes(nodes, edges, names), "chain")
    assets = nodes.where("type = 'HOST'").select(c("identity")["assetId"].alias("asset"), _ident("ip").alias("host_ip")).where("asset is not null").groupBy("asset").agg(F.min("host_ip").alias("host_ip"))
    total = nodes.where("type = 'NGINX_ROUTE'").groupBy(_ident("assetId").alias("asset")).agg(F.count("*").alias("all_routes"))
    split = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split(name, ","), lambda x: x != "")))))
    proxies = routes.groupBy("asked", "asset").agg(F.countDistinct("route").alias("routes"), split("listen").alias("listen"), _list(c("context")).alias("contexts")).join(total, "asset", "left").join(assets, "asset", "left")

    uses = edges.where("type = 'USES_UPSTREAM'").select(c("src").alias("route"), c("dst").alias("upstream"))
    up = routes.join(uses, "route")
    ends = edges.where("type = 'FORWARDS_TO'").select(c("src").alias("upstream"), c("dst").alias("endpoint")).distinct()
    match = reports.backends(nodes, edges)
    backend = graph.settle(up.select("asked", "upstream").distinct().join(ends, "upstream").join(match, "endpoint"), "chain")
    behind = backend.groupBy("asked", "upstream").agg(F.array_sort(F.collect_list(F.struct("endpoint", "status", "applications", "hints"))).alias("backends"))
    directives = _list(c("directive"))
    told = up.groupBy("asked", "upstream").agg(F.countDistinct("route").alias("routes"), F.slice(_list(F.coalesce(F.nullif("uri", F.lit("")), F.lit("(server-level)"))), 1, samples).alias("uris"), directives.alias("directives"), _list(c("route_target")).alias("targets"))
    kind = F.when(c("backends").isNotNull(), "proxy").when(F.array_join("directives", ",").rlike("static|other"), "static").otherwise("external")
    groups = told.join(behind, ["asked", "upstream"], "left").withColumn("kind", kind)

    reached = entries.where("ip <> ''").select("asked", "ip").distinct().join(proxies.where("host_ip <> ''").select("asked", c("host_ip").alias("ip")).distinct(), ["asked", "ip"]).select("asked").distinct().withColumn("connected", F.lit(True))
    one = lambda s, name: F.countDistinct(F.when(c("status") == s, F.struct("upstream", "endpoint"))).alias(name)
    counts = backend.groupBy("asked").agg(F.count("*").alias("backends"), one("exact", "exact"), one("ambiguous", "ambiguous"), one("unresolved", "unresolved"), F.max(F.size("hints") > 0).alias("hinted"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("applications")))).alias("applications"))
    n = lambda df, what, name: df.groupBy("asked").agg(F.countDistinct(what).alias(name))
    s = asked.join(n(names, "node", "names"), "asked", "left").join(n(entries, "target", "entries"), "asked", "left").join(n(routes, "route", "routes"), "asked", "left").join(n(proxies, "asset", "proxies"), "asked", "left").join(n(groups, "upstream", "upstreams"), "asked", "left")
    s = s.join(counts, "asked", "left").join(reached, "asked", "left").na.fill(0).na.fill(False)
    status = F.when(c("names") == 0, "not-found").when(c("exact") > 0, "resolved").when((c("ambiguous") > 0) | c("hinted"), "ambiguous").otherwise("unresolved")
    summary = s.withColumn("status", status).withColumn("applications", F.coalesce("applications", F.array().cast("array<string>"))).drop("hinted")
    return Chain(names, entries, proxies, groups, gaps(names.join(known, "node"), entries, proxies, backend, summary, gap_list), summary)


def gaps(names: DataFrame, entries: DataFrame, proxies: DataFrame, backend: DataFrame, summary: DataFrame, gap_list: int) -> DataFrame:
    """(asked, gap, subject) of what the evidence lacks; of unresolved backends the first gap_list by id are named."""
    say = lambda df, gap, subject: df.select("asked", F.lit(gap).alias("gap"), subject.cast("string").alias("subject"))
    none = F.lit(None)
    order = F.array_sort(F.collect_set("endpoint"))
    open_ = backend.where("status = 'unresolved'").groupBy("asked").agg(F.explode(F.slice(order, 1, gap_list)).alias("endpoint"))
    found = summary.where("names > 0")
    parts = [
        say(summary.where("names = 0"), "no such domain", none), say(names.where("distance > 0 and status in ('external', 'unresolved')"), "alias leaves the site", c("node")), say(found.where("entries = 0"), "no address", none),
        say(found.where("routes = 0"), "no proxy route", none), say(proxies.where("host_ip is null"), "proxy is not in the inventory", c("asset")), say(found.where("entries > 0 and proxies > 0 and not connected"), "entry and proxy are not connected", none),
        say(entries.where("kind = 'eip' and binding is null"), "address is not bound", c("target")), say(entries.where("binding = 'gateway' and rule is null"), "no rule exposes the address", c("target")),
        say(entries.where("binding = 'host'"), "bound to a host without a port", c("binding_id")), say(entries.where("kind = 'host'"), "resolves to a host only", c("target")), say(open_, "no application listens there", c("endpoint")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
