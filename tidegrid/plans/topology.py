"""The topology: typed nodes and edges from the flat tables of a snapshot.

Every builder yields candidates with the order of their stage; one upsert over all of them
merges what several sources say of a node or an edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import net
from tidegrid.operators import graph

ACTIVE_DNS, PAUSED_DNS = ("active", "启用"), ("paused", "暂停")  # fixed values: a record's states as sources write them
SUCCESS = ("success", "成功")


def _map(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]) if pairs else F.create_map().cast("map<string,string>")


def _node(df: DataFrame, stage: int, kind: str, id_: Column, label: Column, source: str, source_id: Column, identity: dict, attributes: dict | None = None, status: Column | str = "active", env: Column | str = "GLOBAL") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    ident, attr = F.map_filter(_map(identity), lambda _, v: v != ""), F.map_filter(_map(attributes or {}), lambda _, v: v != "")
    proof = F.array(F.struct(F.lit(source).alias("source"), source_id.cast("string").alias("sourceId")))
    return df.select(id_.alias("id"), F.lit(kind).alias("type"), label.alias("label"), lit(status).alias("status"), lit(env).alias("environment"), ident.alias("identity"), attr.alias("attributes"), proof.alias("evidence"), F.struct(F.lit(stage).alias("stage"), source_id.cast("string").alias("key")).alias("ord"))


def _edge(df: DataFrame, stage: int, kind: str, src: Column, dst: Column, source: str, source_id: Column, confidence: Column | str = "EXACT", env: Column | str = "GLOBAL") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    proof = F.array(F.struct(F.lit(source).alias("source"), source_id.cast("string").alias("sourceId")))
    return df.select(F.concat_ws(":", F.lit("edge"), F.lit(kind), src, dst).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), lit(env).alias("env"), lit(confidence).alias("confidence"), proof.alias("evidence"), F.struct(F.lit(stage).alias("stage"), source_id.cast("string").alias("key")).alias("ord"))


def _endpoint(df: DataFrame, stage: int, ip: Column, port: Column, protocol: Column, source: str, source_id: Column, found_by: str) -> DataFrame:
    return _node(df.where(ip != ""), stage, "ENDPOINT", net.endpoint_id(ip, port, protocol), F.concat_ws(":", ip, port, protocol), source, source_id, {"ip": ip, "port": port, "protocol": protocol}, {"discoveredBy": F.lit(found_by)})


def group_protocols(t: dict[str, DataFrame]) -> DataFrame:
    """(lb, group_id, protocol): the protocol of a server group, that of its listeners if they agree."""
    return t["listeners"].groupBy("lb", "group_id").agg(F.countDistinct("protocol").alias("n"), F.min("protocol").alias("p")).select("lb", "group_id", F.when(F.col("n") == 1, F.col("p")).otherwise("unknown").alias("protocol"))


def routes_of(t: dict[str, DataFrame]) -> DataFrame:
    """Proxy routes with their ids, domains, upstream and protocol."""
    r = t["routes"].withColumn("domains", F.filter(F.transform(F.coalesce("domains", F.array().cast("array<string>")), net.normalize_domain), lambda x: x != ""))
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    name = F.when(text("directive") == "access_control", "").otherwise(F.coalesce(F.nullif(text("upstream"), F.lit("")), F.nullif(text("target"), F.lit("")), F.concat(text("directive"), F.lit(":"))))
    key = F.sha2(F.concat_ws("|", "asset", F.array_join("domains", ","), text("uri"), text("directive"), text("target"), name), 256)
    target = F.lower(text("target"))
    protocol = F.when(target.startswith("https://"), "https").when(target.startswith("http://"), "http").when(text("context") == "stream", "tcp").otherwise("unknown")
    r = r.withColumn("up", name).withColumn("route_key", F.substr(key, F.lit(1), F.lit(16))).withColumn("protocol", protocol)
    return r.withColumn("route_id", F.concat_ws(":", F.lit("nginx-route"), "asset", "route_key")).withColumn("upstream_id", F.when(F.col("up") != "", F.concat_ws(":", F.lit("nginx-upstream"), "asset", F.substr(F.sha2("up", 256), F.lit(1), F.lit(16)))))


def build(t: dict[str, DataFrame], managed_suffixes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the flat tables; managed_suffixes are the site's own domains, whose absent names are unresolved rather than external."""
    c = F.col
    nodes: list[DataFrame] = []
    edges: list[DataFrame] = []

    # hosts: compute by every address, assets, deployments
    machine = t["compute"].select("id", "name", "tenantId", F.explode(F.array_distinct(F.concat(F.coalesce("privateIps", F.array()), F.coalesce("publicIps", F.array())))).alias("a")).withColumn("ip", net.normalize_ip(c("a"))).where("ip <> ''")
    nodes.append(_node(machine, 10, "HOST", net.host_id(c("ip")), c("ip"), "compute", c("id"), {"ip": c("ip"), "cloudInstanceIds": c("id"), "tenantId": c("tenantId")}, {"name": c("name")}))
    asset = t["assets"].where("ip <> ''")
    nodes.append(_node(asset, 11, "HOST", net.host_id(c("ip")), c("ip"), "assets", c("id"), {"ip": c("ip"), "assetId": c("id")}, {"hostname": c("hostname"), "os": c("os")}))
    dep = t["deployments"]
    placed = dep.where("ip <> ''")
    dep_key = F.concat_ws("/", "app_id", "env", "deploy")
    nodes.append(_node(placed, 12, "HOST", net.host_id(c("ip")), c("ip"), "inventory", dep_key, {"ip": c("ip")}))
    hosts = machine.select("ip").unionByName(asset.select("ip")).unionByName(placed.select("ip")).distinct()

    # cloud: public addresses, translation, load balancers
    eip, nat, lb = t["eip"], t["nat"], t["balancers"]
    eip_id = F.concat(F.lit("eip:"), c("id"))
    nodes.append(_node(eip, 20, "EIP", eip_id, F.coalesce(F.nullif(c("name"), F.lit("")), c("id")), "eip", c("id"), {"eipId": c("id"), "ip": c("ip")}, {"bindingType": c("bindingType"), "bindingId": c("bindingId")}))
    gw, rule = F.concat(F.lit("nat-gateway:"), c("gateway")), F.concat_ws(":", F.lit("dnat-rule"), c("gateway"), c("entry"))
    nodes.append(_node(nat, 21, "NAT_GATEWAY", gw, F.coalesce(c("gateway_name"), c("gateway")), "nat", c("gateway"), {"natGatewayId": c("gateway")}, {}, F.when(c("gateway_status") == "Available", "active").otherwise("unknown")))
    entry = nat.where("entry is not null")
    nodes.append(_node(entry, 22, "DNAT_RULE", rule, c("entry"), "nat", F.concat_ws("/", "gateway", "entry"), {k: c(v) for k, v in (("externalIp", "external_ip"), ("externalPort", "external_port"), ("internalIp", "internal_ip"), ("internalPort", "internal_port"), ("protocol", "protocol"))}, {}, F.when(c("status") == "Available", "active").otherwise("unknown")))
    for side in ("external", "internal"):
        nodes.append(_endpoint(entry, 23, c(f"{side}_ip"), c(f"{side}_port"), c("protocol"), "nat", F.concat_ws("/", "gateway", "entry"), "nat"))
    lb_id, listener = F.concat(F.lit("clb:"), c("id")), F.concat_ws(":", F.lit("clb-listener"), "lb", "protocol", "port")
    group = F.concat_ws(":", F.lit("clb-server-group"), "lb", "group_id")
    nodes.append(_node(lb, 24, "CLB", lb_id, F.coalesce(F.nullif(c("name"), F.lit("")), c("id")), "balancers", c("id"), {"clbId": c("id"), "ip": c("ip")}, {"addressType": c("addressType")}, F.when(c("status") == "active", "active").otherwise("unknown")))
    nodes.append(_node(t["listeners"], 25, "CLB_LISTENER", listener, F.concat_ws(" ", "lb_name", F.concat_ws("/", "protocol", "port")), "balancers", F.concat_ws("/", "lb", "protocol", "port"), {"clbId": c("lb"), "protocol": c("protocol"), "port": c("port")}, {"backendPort": c("backendPort"), "forwardPort": c("forwardPort")}, F.when(c("status") == "running", "active").otherwise("unknown")))
    nodes.append(_node(t["groups"], 26, "SERVER_GROUP", group, F.coalesce(F.nullif(c("name"), F.lit("")), c("group_id")), "balancers", F.concat_ws("/", "lb", "group_id"), {"clbId": c("lb"), "serverGroupId": c("group_id")}, {"kind": c("kind")}))
    server = t["servers"].join(group_protocols(t), ["lb", "group_id"], "left").withColumn("protocol", F.coalesce("protocol", F.lit("unknown")))
    nodes.append(_endpoint(server, 27, c("ip"), c("port"), c("protocol"), "balancers", F.concat_ws("/", "lb", "group_id"), "balancers"))

    # applications, deployments, repositories
    app_id = F.concat(F.lit("application:"), c("id"))
    nodes.append(_node(t["apps"], 30, "APPLICATION", app_id, F.coalesce(F.nullif(c("name"), F.lit("")), c("id")), "inventory", c("id"), {"appId": c("id")}, {"http": c("http"), "declaredPort": c("port")}))
    own = dep.where("repository <> ''").groupBy("app_id").agg(F.min_by("repository", F.struct("env", "deploy")).alias("dep_repo"))
    source = t["apps"].join(own, c("id") == c("app_id"), "left").withColumn("url", F.coalesce(F.nullif(c("repository"), F.lit("")), c("dep_repo"))).where("url is not null")
    known = t["repositories"].where("canonical <> ''").groupBy(c("canonical").alias("url")).agg(F.max_by(F.struct(c("id").alias("repo_id"), c("name").alias("repo_name"), "difference"), c("id")).alias("r"))
    source = source.join(known, "url", "left")
    repo_id = F.concat(F.lit("repository:"), F.substr(F.sha2("url", 256), F.lit(1), F.lit(16)))
    nodes.append(_node(source, 31, "REPOSITORY", repo_id, F.coalesce(c("r.repo_name"), F.element_at(F.split("url", "/"), -1)), "repositories", F.coalesce(c("r.repo_id"), c("id")), {"url": c("url")}, {"difference": F.coalesce(c("r.difference"), F.lit("inventory_only"))}, F.when(c("r").isNotNull(), "active").otherwise("unresolved")))
    dep_id = F.concat_ws(":", F.lit("deployment"), "app_id", "env", "deploy")
    nodes.append(_node(dep, 32, "DEPLOYMENT", dep_id, F.concat_ws(" ", "app_name", "env", "deploy"), "inventory", dep_key, {"appId": c("app_id"), "env": c("env"), "deployId": c("deploy"), "ip": c("ip"), "port": c("port")}, {"config": c("config")}, F.when(F.lower("status").isin(*SUCCESS), "active").otherwise("unknown"), c("env")))
    nodes.append(_endpoint(placed, 33, c("ip"), c("port"), F.lit("unknown"), "inventory", dep_key, "inventory"))

    # names
    dns = t["dns"].where(c("type").isin("A", "AAAA", "CNAME"))
    status = F.when(F.lower("status").isin(*PAUSED_DNS), "paused").when(F.lower("status").isin(*ACTIVE_DNS), "active").otherwise("unknown")
    nodes.append(_node(dns, 40, "DOMAIN", net.domain_id(c("name")), c("name"), "dns", c("id"), {"name": c("name")}, {"zone": c("zone"), "line": c("line")}, status))
    cname = dns.where("type = 'CNAME'").withColumn("target", net.normalize_domain(c("value")))
    names = dns.select(c("name").alias("target")).distinct().withColumn("has", F.lit(True))
    managed = reduce(lambda a, b: a | b, [(c("target") == s) | c("target").endswith("." + s) for s in managed_suffixes], F.lit(False))
    labels = F.split("target", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    ours = cname.select("target").distinct().withColumn("zone", F.explode(suffixes)).join(t["public_zones"].select("zone"), "zone", "left_semi").select("target").distinct().withColumn("in_zone", F.lit(True))
    aimed = cname.join(names, "target", "left").join(ours, "target", "left")
    in_zone = F.coalesce("in_zone", F.lit(False))
    nodes.append(_node(aimed, 41, "DOMAIN", net.domain_id(c("target")), c("target"), "dns", c("id"), {"name": c("target")}, {}, F.when(c("has"), "active").when(managed | in_zone, "unresolved").otherwise("external")))
    address = dns.where("type <> 'CNAME'").withColumn("ip", net.normalize_ip(c("value"))).where("ip <> ''")
    cloud_ips = eip.select("ip").unionByName(lb.select("ip")).unionByName(entry.select(c("external_ip").alias("ip"))).unionByName(entry.select(c("internal_ip").alias("ip")))
    stray = address.join(hosts.unionByName(cloud_ips).distinct(), "ip", "left_anti")
    nodes.append(_node(stray, 42, "HOST", net.host_id(c("ip")), c("ip"), "dns", c("id"), {"ip": c("ip")}, {}, "unresolved"))

    # proxies
    route = routes_of(t)
    nodes.append(_node(route.select("*", F.explode("domains").alias("domain")), 50, "DOMAIN", net.domain_id(c("domain")), c("domain"), "routes", c("route_key"), {"name": c("domain")}, {"discoveredBy": F.lit("routes")}))
    nodes.append(_node(route, 51, "NGINX_ROUTE", c("route_id"), F.concat(F.coalesce(F.nullif(F.array_join("domains", ","), F.lit("")), "hostname"), F.coalesce("uri", F.lit(""))), "routes", c("route_key"), {"assetId": c("asset"), "assetIp": c("asset_ip"), "domains": F.array_join("domains", ","), "uri": c("uri"), "directive": c("directive"), "target": c("target"), "upstream": c("up")}, {"listen": F.array_join("listen", ","), "context": c("context"), "file": c("file")}, F.when(c("directive").isin("static/other", "access_control"), "unknown").otherwise("active")))
    upstream = route.where("upstream_id is not null")
    nodes.append(_node(upstream, 52, "UPSTREAM", c("upstream_id"), c("up"), "routes", c("route_key"), {"assetId": c("asset"), "name": c("up")}, {"target": c("target"), "directive": c("directive")}))
    backend = upstream.select("upstream_id", "route_key", "protocol", F.explode("backends").alias("b")).where("b.resolution = 'ip'").withColumn("ip", net.normalize_ip(c("b.host"))).withColumn("port", net.normalize_port(c("b.port"))).where("ip <> ''")
    nodes.append(_endpoint(backend, 53, c("ip"), c("port"), c("protocol"), "routes", c("route_key"), "routes"))

    # listening ports that inspection saw: they enrich endpoints of that address and port, else make one
    seen = t["app_ports"].where("asset_ip <> ''").select(c("asset_ip").alias("ip"), c("port").cast("string").alias("port"), c("app"), c("asset"))
    ends = reduce(DataFrame.unionByName, [n.where("type = 'ENDPOINT'").select("id", c("identity")["ip"].alias("ip"), c("identity")["port"].alias("port")) for n in nodes]).distinct()
    seen_end = seen.join(ends, ["ip", "port"], "left").withColumn("end_id", F.coalesce("id", net.endpoint_id(c("ip"), c("port"), F.lit("tcp"))))
    nodes.append(_node(seen_end, 60, "ENDPOINT", c("end_id"), F.concat_ws(":", "ip", "port", F.lit("tcp")), "inspection", F.concat_ws("/", "asset", "port"), {"ip": c("ip"), "port": c("port"), "protocol": F.element_at(F.split("end_id", ":"), -1)}, {"discoveredBy": F.lit("inspection"), "app": c("app")}))

    # edges, in the order of their builders
    ip_host = hosts.select(c("ip").alias("h"))
    edges.append(_edge(cname.where(F.lower("status").isin(*ACTIVE_DNS, *PAUSED_DNS)), 1, "CNAME_TO", net.domain_id(c("name")), net.domain_id(c("target")), "dns", c("id")))
    live = address.where(F.lower("status").isin(*ACTIVE_DNS, *PAUSED_DNS)).select(c("id").alias("rid"), "name", "ip")
    public = eip.groupBy("ip").agg(F.max("id").alias("e"))
    by_eip, by_lb = live.join(public, "ip"), live.join(lb.select("ip", c("id").alias("l")), "ip")
    edges.append(_edge(by_eip, 2, "RESOLVES_TO", net.domain_id(c("name")), F.concat(F.lit("eip:"), c("e")), "dns", c("rid")))
    edges.append(_edge(by_lb, 2, "RESOLVES_TO", net.domain_id(c("name")), F.concat(F.lit("clb:"), c("l")), "dns", c("rid")))
    else_host = live.join(eip.select("ip").unionByName(lb.select("ip")).distinct(), "ip", "left_anti")
    edges.append(_edge(else_host, 2, "RESOLVES_TO", net.domain_id(c("name")), net.host_id(c("ip")), "dns", c("rid")))

    bound = eip.select(c("id").alias("e"), "ip", "bindingId", "bindingType")
    gateways = entry.select(c("gateway").alias("g")).distinct()  # known by their rules
    vips = lb.where("ip <> ''").select(c("id").alias("l")).distinct()
    owner = machine.groupBy(c("id").alias("m")).agg(F.min("ip").alias("m_ip"))
    bound = bound.join(gateways, c("bindingId") == c("g"), "left").join(vips, c("bindingId") == c("l"), "left").join(owner, c("bindingId") == c("m"), "left").join(ip_host, c("ip") == c("h"), "left")
    sure = F.coalesce(F.concat(F.lit("nat-gateway:"), c("g")), F.concat(F.lit("clb:"), c("l")), F.concat(F.lit("host:"), c("m_ip")))
    guess = F.when(F.lower("bindingType").rlike("ecs|instance|eni|nic|实例|网卡"), F.concat(F.lit("host:"), c("h")))
    bound = bound.withColumn("sure", sure).withColumn("to", F.coalesce(sure, guess)).where("to is not null")
    edges.append(_edge(bound, 3, "BOUND_TO", F.concat(F.lit("eip:"), c("e")), c("to"), "eip", c("e"), F.when(c("sure").isNotNull(), "EXACT").otherwise("AMBIGUOUS")))
    entry_key = F.concat_ws("/", "gateway", "entry")
    edges.append(_edge(entry, 4, "HAS_DNAT_RULE", gw, rule, "nat", entry_key))
    edges.append(_edge(entry.where("external_ip <> ''"), 4, "EXPOSES", rule, net.endpoint_id(c("external_ip"), c("external_port"), c("protocol")), "nat", entry_key))
    edges.append(_edge(entry.where("internal_ip <> ''"), 4, "FORWARDS_TO", rule, net.endpoint_id(c("internal_ip"), c("internal_port"), c("protocol")), "nat", entry_key))
    edges.append(_edge(t["listeners"], 5, "HAS_LISTENER", F.concat(F.lit("clb:"), c("lb")), listener, "balancers", F.concat_ws("/", "lb", "protocol", "port")))
    edges.append(_edge(t["listeners"].join(t["groups"].select("lb", "group_id"), ["lb", "group_id"]), 5, "ROUTES_TO", listener, group, "balancers", F.concat_ws("/", "lb", "protocol", "port")))
    edges.append(_edge(server, 6, "FORWARDS_TO", group, net.endpoint_id(c("ip"), c("port"), c("protocol")), "balancers", F.concat_ws("/", "lb", "group_id")))
    edges.append(_edge(dep, 7, "HAS_DEPLOYMENT", F.concat(F.lit("application:"), c("app_id")), dep_id, "inventory", dep_key, env=c("env")))
    numeric = placed.groupBy("ip").agg(F.max(c("port").rlike(r"^\d+$")).alias("numeric"))
    listening = placed.join(numeric, "ip")
    sure_port = F.when(c("port").rlike(r"^\d+$"), "EXACT").when(c("numeric"), "AMBIGUOUS").otherwise("INFERRED")
    edges.append(_edge(listening, 7, "LISTENS_ON", dep_id, net.endpoint_id(c("ip"), c("port"), F.lit("unknown")), "inventory", dep_key, sure_port, c("env")))
    edges.append(_edge(source, 8, "BUILT_FROM", app_id, repo_id, "repositories", F.coalesce(c("r.repo_id"), c("id"))))
    edges.append(_edge(route.select("*", F.explode("domains").alias("domain")), 9, "SERVED_BY", net.domain_id(c("domain")), c("route_id"), "routes", c("route_key")))
    edges.append(_edge(upstream, 9, "USES_UPSTREAM", c("route_id"), c("upstream_id"), "routes", c("route_key")))
    edges.append(_edge(backend, 9, "FORWARDS_TO", c("upstream_id"), net.endpoint_id(c("ip"), c("port"), c("protocol")), "routes", c("route_key")))
    # every endpoint stands on the host of its address; the environment is that of the first builder that says so
    on_host = lambda df, stage, ip, end, source, key, env="GLOBAL": _edge(df.join(ip_host, ip == c("h")), stage, "ON_HOST", end, F.concat(F.lit("host:"), c("h")), source, key, env=env)
    for side in ("external", "internal"):
        edges.append(on_host(entry, 4, c(f"{side}_ip"), net.endpoint_id(c(f"{side}_ip"), c(f"{side}_port"), c("protocol")), "nat", entry_key))
    edges.append(on_host(server, 6, c("ip"), net.endpoint_id(c("ip"), c("port"), c("protocol")), "balancers", F.concat_ws("/", "lb", "group_id")))
    edges.append(on_host(placed, 7, c("ip"), net.endpoint_id(c("ip"), c("port"), F.lit("unknown")), "inventory", dep_key, c("env")))
    edges.append(on_host(backend, 9, c("ip"), net.endpoint_id(c("ip"), c("port"), c("protocol")), "routes", c("route_key")))
    edges.append(on_host(seen_end, 10, c("ip"), c("end_id"), "inspection", F.concat_ws("/", "asset", "port")))
    # a merge reads its candidates several times, each time with all the joins above unless they are written once
    made = [graph.settle(reduce(DataFrame.unionByName, x), "candidates") for x in (nodes, edges)]
    return graph.upsert_nodes(made[0]), graph.upsert_edges(made[1])
