"""Component planners: reports in, accepted groups and unresolved rows with a reason out.

A planner is a list of rules over the columns of a report, in order; the first that fails is
the reason (the last, for planners that say so).  Facts that need other rows, such as how often an identity
occurs or whether a cluster's members agree, are added as columns before.
Nothing here names a site's own hosts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegrid.functions import dates, net
from tidegrid.operators import relational as rel

Rule = tuple[str, Callable[[], Column]]
c = F.col


def unique(name: str) -> Rule:
    return f"{name} not unique", lambda: c(f"n_{name}") == 1


def same(what: str, want) -> Rule:
    return f"{what} is not {want}", lambda: c(what) == F.lit(want)


def true(what: str) -> Rule:
    return f"not {what}", lambda: c(what)


ADDRESS: Rule = ("invalid address", lambda: net.is_ipv4(c("ip")))
FRESH: Rule = ("report too old", lambda: dates.fresh(c("observed_at"), c("now")))
OWNED: Rule = ("listener not owned by the process", lambda: F.array_sort("listener_pids") == F.array("pid"))
AGREED: Rule = ("members disagree", lambda: c("agreed"))


@dataclass(frozen=True)
class Planner:
    """identity: columns whose combination must be unique; cluster: column that groups members, which must agree on view."""

    name: str
    rules: tuple[Rule, ...]
    identity: tuple[str, ...] = ("asset", "config")
    cluster: str | None = None
    last: bool = False


STANDALONE = (FRESH, ADDRESS, unique("identity"), same("mode", "standalone"), OWNED)
CLUSTER = (FRESH, ADDRESS, unique("identity"), AGREED)
PLANNERS = {
    p.name: p
    for p in (
        Planner("zookeeper", (FRESH, ADDRESS, unique("identity"), same("mode", "standalone"), ("fewer than 2 frames", lambda: c("frames") >= 2), OWNED, ("quorum traffic", lambda: ~c("quorum"))), last=True),
        Planner("nacos", (*STANDALONE, ("port not published once", lambda: c("host_network") | (c("published") == 1))), ("asset", "home")),
        Planner("nginx", (FRESH, unique("identity"), true("same_namespace"), true("config_complete"))),
        Planner("kong", (FRESH, unique("identity"), ("admin listener not owned by master and workers", lambda: F.size(F.array_except("listener_pids", F.array_union(F.array("pid"), c("workers")))) == 0)), ("node_id",)),
        Planner("redis", CLUSTER, ("endpoint",), "signature"),
        Planner("redis_single", (*STANDALONE, true("live_checked"), ("has replicas", lambda: c("replicas") == 0))),
        Planner("redis_loopback", (FRESH, unique("identity"), same("mode", "standalone"), ("not loopback only", lambda: F.forall("binds", lambda b: b.isin("127.0.0.1", "::1"))), OWNED)),
        Planner("redis_single_cluster", (FRESH, ADDRESS, unique("identity"), ("more than one member", lambda: F.size("view") == 1), true("node_file_held"))),
        Planner("elasticsearch", (*CLUSTER, ("one node without proof", lambda: (F.size("view") > 1) | c("single_node"))), ("node_id",), "cluster_uuid"),
        Planner("kafka", (*CLUSTER, ("config newer than process", lambda: c("config_at") <= c("started_at"))), ("broker",), "cluster_uuid"),
        Planner("rabbitmq", (FRESH, ADDRESS, unique("identity"), ("views differ", lambda: F.array_sort("running") == F.array_sort("known")), ("not a single node", lambda: F.size("known") == 1), unique("endpoint")), ("node_id",)),
        Planner("mongodb", STANDALONE), Planner("mongodb_replica", (*CLUSTER, ("not two members", lambda: c("members") == 2)), ("endpoint",), "replica_set"),
        Planner("managed", (true("confirmed"), unique("identity")), ("cloud_id",)),
        Planner("canal", (FRESH, unique("identity"), same("mode", "standalone"))), Planner("canal_admin", (FRESH, unique("identity"), true("admin_confirmed")), ("asset", "server")),
        Planner("canal_admin_zk", (*CLUSTER, true("admin_confirmed")), ("asset", "server"), "signature"), Planner("canal_pending", (unique("identity"), ("grouping unknown", lambda: F.lit(False)))),
        Planner("jenkins", (FRESH, ADDRESS, unique("identity"), true("same_process"), ("no home", lambda: c("home").isNotNull()), ("another command", lambda: c("command").contains(c("war"))), OWNED, ("port not published once", lambda: c("same_namespace") | (c("published") == 1))), ("asset", "home")),
        Planner("process", (FRESH, ADDRESS, unique("identity"), OWNED), ("asset", "pid")), Planner("kibana", (FRESH, unique("identity"), ("no cluster that it connects to", lambda: c("cluster_unit").isNotNull())), ("asset", "pid")),
    )
}


def plan(report: DataFrame, planner: Planner) -> DataFrame:
    """report with n_identity, agreed and members (of clusters), reason (null: accepted) and accepted.

    report has the columns that the planner's rules name; clusters also view, the members that a
    member reports, and endpoint, what it is called there.
    """
    df = report.withColumn("n_identity", F.count("*").over(W.partitionBy(*planner.identity)))
    if any(name == "endpoint not unique" for name, _ in planner.rules):
        df = df.withColumn("n_endpoint", F.count("*").over(W.partitionBy("endpoint")))
    if planner.cluster:
        told = rel.agree_on_view(report.select(planner.cluster, "endpoint", "view"), planner.cluster, "endpoint", "view")
        df = df.join(told.withColumnsRenamed({planner.cluster: "_cluster"}), c(planner.cluster) == c("_cluster"), "left").drop("_cluster")
    reason = rel.first_reason([(name, rule()) for name, rule in planner.rules], planner.last)
    return df.withColumn("reason", reason).withColumn("accepted", c("reason").isNull())


def groups(planned: DataFrame, planner: Planner) -> DataFrame:
    """Accepted units: (unit, members): one a cluster, else one a row."""
    key = c(planner.cluster) if planner.cluster else F.concat_ws("/", *planner.identity)
    return planned.where("accepted").groupBy(key.cast("string").alias("unit")).agg(F.count("*").alias("members"))
