"""Facts of components from what their tools print, as columns; plans/components.py has the rules that use them.

Every function takes text columns and gives named columns for ``withColumns``; a text that doesn't say gives null, and a rule over null fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import net

c = F.col


def _said(text: Column, form: str) -> Column:
    return F.nullif(F.regexp_extract(text, form, 1), F.lit(""))


def _sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def zookeeper(answer: Column) -> dict[str, Column]:
    """mode of a "srvr" answer."""
    return {"mode": _said(answer, r"(?m)^Mode: (\w+)\s*$")}


def redis_info(info: Column) -> dict[str, Column]:
    """mode, role and number of replicas of an INFO answer."""
    return {"mode": _said(info, r"(?m)^redis_mode:(\w+)"), "role": _said(info, r"(?m)^role:(\w+)"), "replicas": _said(info, r"(?m)^connected_slaves:(\d+)").try_cast("int")}


def redis_nodes(answer: Column) -> dict[str, Column]:
    """view (addresses of all members), endpoint (the one that answers) and signature (of the members' ids) of a CLUSTER NODES answer; members that are gone don't count."""
    lines = F.filter(F.split(answer, r"\r?\n"), lambda x: x.rlike(r"^\w+ \S+:\d+") & ~x.rlike(r"^\S+ \S+ \S*(noaddr|handshake|fail)\b"))
    address = lambda x: F.regexp_extract(x, r"^\w+ ([^\s@,]+)", 1)
    own = F.get(F.filter(lines, lambda x: x.rlike(r"^\S+ \S+ \S*\bmyself\b")), F.lit(0))
    return {"view": _sorted(F.transform(lines, address)), "endpoint": address(own), "signature": F.sha2(F.array_join(_sorted(F.transform(lines, lambda x: F.split_part(x, F.lit(" "), F.lit(1)))), ","), 256)}


def redis_binds(config: Column) -> dict[str, Column]:
    """binds of a configuration: addresses of its last bind line; * without one."""
    last = F.element_at(F.regexp_extract_all(F.concat(F.lit("bind *\n"), F.coalesce(config, F.lit(""))), F.lit(r"(?m)^\s*bind[ \t]+([^\n#]+)"), F.lit(1)), -1)
    return {"binds": F.transform(F.split(F.trim(last), r"\s+"), lambda b: F.regexp_replace(b, r"""^-|["']""", ""))}


def elasticsearch(root: Column, nodes: Column) -> dict[str, Column]:
    """cluster_uuid, node name, view (addresses of all nodes) and whether discovery is that of a single node; root: the answer of /, nodes: that of /_nodes/settings."""
    listed = F.from_json(F.get_json_object(nodes, "$.nodes"), "map<string, struct<transport_address: string, name: string, settings: struct<discovery: struct<type: string>>>>")
    each = F.map_values(listed)
    name = F.get_json_object(root, "$.name")
    own = F.get(F.filter(F.map_entries(listed), lambda n: n["value"]["name"] == name), F.lit(0))
    return {
        "cluster_uuid": F.get_json_object(root, "$.cluster_uuid"), "node_id": own["key"], "endpoint": own["value"]["transport_address"], "view": _sorted(F.transform(each, lambda n: n["transport_address"])),
        "single_node": F.coalesce(own["value"]["settings"]["discovery"]["type"] == "single-node", F.lit(False)),
    }


def kafka(properties: Column) -> dict[str, Column]:
    """cluster_uuid and broker of a meta.properties file."""
    return {"cluster_uuid": _said(properties, r"(?m)^cluster\.id=(\S+)"), "broker": _said(properties, r"(?m)^(?:broker|node)\.id=(\d+)").try_cast("int")}


def rabbitmq(status: Column) -> dict[str, Column]:
    """node_id, running and known nodes of a cluster status in JSON."""
    names = lambda key: F.from_json(F.get_json_object(status, key), "array<string>")
    known = F.concat(F.coalesce(names("$.disk_nodes"), F.array().cast("array<string>")), F.coalesce(names("$.ram_nodes"), F.array().cast("array<string>")))
    return {"node_id": F.get_json_object(status, "$.node"), "running": _sorted(names("$.running_nodes")), "known": _sorted(known)}


def mongodb(status: Column) -> dict[str, Column]:
    """replica_set, members, view and endpoint of a replica set's status in JSON; mode standalone without a set."""
    members = F.from_json(F.get_json_object(status, "$.members"), "array<struct<name: string, stateStr: string, self: boolean>>")
    name = F.get_json_object(status, "$.set")
    return {
        "replica_set": name, "members": F.coalesce(F.size(F.filter(members, lambda m: m["stateStr"].isin("PRIMARY", "SECONDARY", "ARBITER"))), F.lit(0)), "view": _sorted(F.transform(members, lambda m: m["name"])),
        "endpoint": F.get(F.filter(members, lambda m: F.coalesce(m["self"], F.lit(False))), F.lit(0))["name"], "mode": F.when(name.isNull() & status.startswith("{"), "standalone").otherwise("replica"),
    }


def process(output: Column, pid: Column) -> dict[str, Column]:
    """same_process (its start is the same before and after the probe), same_namespace (it uses the host's network), home (of JENKINS_HOME) and command of a live probe."""
    starts = F.regexp_extract_all(output, F.concat(F.lit("(?m)^"), pid.cast("string"), F.lit(r" \([^)\n]*\) (\d+)$")), F.lit(1))
    netns = lambda who: _said(output, rf"(?m)^{who}NETNS (net:\[\d+\])$")
    return {
        "same_process": (F.size(starts) == 2) & (starts[0] == starts[1]), "same_namespace": netns("HOST_") == netns(""), "home": _said(output, r"(?m)^(?:-D)?JENKINS_HOME=(\S+)$"), "command": _said(output, r"(?m)^COMMAND (.+)$"),
        "listener_pids": F.transform(F.array_distinct(F.regexp_extract_all(output, F.lit(r"\bpid=(\d+)"), F.lit(1))), lambda x: x.cast("int")),
    }


def complete_configs(reports: DataFrame, problems: DataFrame, key: str) -> DataFrame:
    """reports with config_complete: whether proxyconf.expanded() had nothing to refuse or to leave out in the dump with its key."""
    bad = problems.where((c("severity") == "error") | c("problem").startswith("include not expanded")).select(c("dump").alias("_dump")).distinct()
    return reports.join(bad, c(key).cast("string") == c("_dump"), "left").withColumn("config_complete", c("_dump").isNull()).drop("_dump")


def business_plan(groups: DataFrame, repositories: DataFrame, links: DataFrame, apps: DataFrame, organisation: str) -> tuple[DataFrame, DataFrame]:
    """((app, domain, system, paths, status), (domain, system)): the one domain and system that an application's repositories give it.

    groups: (path); repositories: (repository, path, url, active), links: (repository, app), apps: (app, url). A path is organisation/domain/system/...; a repository
    counts if it is active, its address has its path, and an application's own address says the same. status: assigned, or ambiguous
    with several; (domain, system) are all that groups and repositories name, system null for a domain itself.
    """
    whole = lambda df: df.withColumn("_p", F.split("path", "/")).where((F.get("_p", F.lit(0)) == organisation) & ~F.array_contains("_p", ""))
    folder = lambda url: F.regexp_replace(net.git_key(url), "^[^/]*/", "")
    g, r = whole(groups), whole(repositories).where("active").where((F.size("_p") >= 4) & (folder(c("url")) == c("path")))
    domain, system = F.get("_p", F.lit(1)), F.get("_p", F.lit(2))
    named = g.where(F.size("_p") >= 2).select(domain.alias("domain"), F.lit(None).cast("string").alias("system")).unionByName(g.where(F.size("_p") >= 3).select(domain.alias("domain"), system.alias("system")))
    named = named.unionByName(r.select(domain.alias("domain"), F.lit(None).cast("string").alias("system"))).unionByName(r.select(domain.alias("domain"), system.alias("system"))).distinct()
    said = apps.select("app", folder(c("url")).alias("path")).distinct()
    hit = links.join(r.select("repository", "path", domain.alias("domain"), system.alias("system")), "repository").join(said, ["app", "path"]).distinct()
    made = hit.groupBy("app").agg(F.count_distinct("domain", "system").alias("n"), F.min("domain").alias("domain"), F.min("system").alias("system"), F.array_sort(F.collect_set("path")).alias("paths"))
    one = c("n") == 1
    return made.select("app", F.when(one, c("domain")).alias("domain"), F.when(one, c("system")).alias("system"), "paths", F.when(one, "assigned").otherwise("ambiguous").alias("status")), named
