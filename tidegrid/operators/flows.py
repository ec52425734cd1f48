"""Connections from socket samples: state, direction, traffic, and who owns the other end.

samples: (frame int, at timestamp, local_ip, local_port, peer_ip, peer_port, protocol, socket_id, state, sent, received, pids array<int>).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegrid.operators import relational as rel

KEY = ["local_ip", "local_port", "peer_ip", "peer_port", "protocol", "socket_id"]
LOCAL, PEER = ["local_ip", "local_port"], ["peer_ip", "peer_port"]
# Services by port, a hint only.
PORT_HINTS = {3306: "MySQL", 6379: "Redis", 5432: "PostgreSQL", 9200: "Elasticsearch", 9092: "Kafka", 5672: "RabbitMQ", 2181: "ZooKeeper", 27017: "MongoDB", 8848: "Nacos", 80: "HTTP", 443: "HTTPS"}


def flow_states(samples: DataFrame, listeners: DataFrame) -> DataFrame:
    """One row a connection.  listeners: (port, pids).

    direction: upstream if a listener on the local port shares a process with the socket in any
    sample, INFERRED; a connection first seen in SYN-SENT is downstream, EXACT.  sent and
    received are the counters' change from the first to the last sample, null with one sample, without a
    socket id, after a rollback, or if the connection was missing from a frame in between (interrupted).
    """
    owners = listeners.select(F.col("port").alias("local_port"), F.explode("pids").alias("pid")).groupBy("local_port").agg(F.collect_set("pid").alias("owners"))
    s = samples.join(owners, "local_port", "left").withColumn("inbound", F.coalesce(F.arrays_overlap("owners", "pids"), F.lit(False)))
    at = F.struct("at", "frame")
    s = s.withColumn("gap", F.col("frame") - F.lag("frame").over(W.partitionBy(*KEY).orderBy("frame")))
    first = lambda c: F.min_by(c, at)
    last = lambda c: F.max_by(c, at)
    g = s.groupBy(*KEY).agg(
        F.count("*").alias("samples"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), last("state").alias("state"), first("state").alias("first_state"), F.max("inbound").alias("inbound"),
        first("sent").alias("s0"), last("sent").alias("s1"), first("received").alias("r0"), last("received").alias("r1"), F.coalesce(F.max(F.col("gap") > 1), F.lit(False)).alias("interrupted"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pids")))).alias("pids"),
    )
    countable = (F.col("samples") >= 2) & F.col("socket_id").isNotNull() & ~F.col("interrupted")
    delta = lambda a, b: F.when(countable & (F.col(b) >= F.col(a)), F.col(b) - F.col(a))
    out = g.withColumn("sent_delta", delta("s0", "s1")).withColumn("received_delta", delta("r0", "r1"))
    sure = F.col("first_state") == "SYN-SENT"
    activity = F.when((F.coalesce("sent_delta", F.lit(0)) > 0) | (F.coalesce("received_delta", F.lit(0)) > 0), "DATA_OBSERVED").when((F.col("sent_delta") == 0) & (F.col("received_delta") == 0), "NO_DATA_OBSERVED").otherwise("UNKNOWN")
    rollback = countable & ((F.col("s1") < F.col("s0")) | (F.col("r1") < F.col("r0")))
    warnings = F.filter(F.array(F.when(F.coalesce(rollback, F.lit(False)), "counter rollback"), F.when(F.col("interrupted"), "interrupted")), lambda w: w.isNotNull())
    return out.select(
        *KEY, "samples", "first_at", "last_at", "state", "pids", "interrupted", F.when(~sure & F.col("inbound"), "upstream").otherwise("downstream").alias("direction"),
        F.when(sure, "EXACT").otherwise("INFERRED").alias("direction_confidence"), "sent_delta", "received_delta", activity.alias("activity"), warnings.alias("warnings"),
    )


def bounded_flows(flows: DataFrame, most: int = 100) -> tuple[DataFrame, int]:
    """The first flows to be seen, and how many a report leaves out."""
    total = flows.count()
    return flows.orderBy("first_at", *KEY).limit(most), max(0, total - most)


def attribute(flows: DataFrame, observations: DataFrame) -> DataFrame:
    """flows with what the other end says.

    observations: samples at the peer with obs_start and obs_end (on our clock), pid, process, app.  Those of the
    reversed tuple that can overlap the flow's life are candidates.  One process: EXACT if an
    observation lies between the flow's first and last sample, of which there are two, and the flow has a socket id and
    wasn't interrupted, else INFERRED; several: AMBIGUOUS; none: UNKNOWN.  reason, of UNKNOWN only: whether the peer has no samples
    at all, none while the flow lived, or some but none of this connection.
    """
    j = rel.reversed_pairs(flows, observations, LOCAL, PEER).where((F.col("o_obs_end") >= F.col("first_at")) & (F.col("o_obs_start") <= F.col("last_at")))
    bracketed = (F.col("first_at") <= F.col("o_obs_start")) & (F.col("o_obs_end") <= F.col("last_at")) & (F.col("samples") >= 2) & F.col("socket_id").isNotNull() & ~F.col("interrupted")
    found = j.groupBy(*KEY).agg(F.countDistinct("o_pid").alias("n"), F.max(bracketed).alias("sure"), F.min(F.struct("o_pid", "o_process", "o_app")).alias("p"), F.count("*").alias("evidence"))
    named = [F.col(f"f.{k}").eqNullSafe(F.col(f"x.{k}")) for k in KEY]
    covered = observations.groupBy(F.col("local_ip").alias("c_ip")).agg(F.min("obs_start").alias("c_start"), F.max("obs_end").alias("c_end"))
    out = flows.alias("f").join(found.alias("x"), named, "left").join(covered.alias("c"), F.col("f.peer_ip") == F.col("c.c_ip"), "left")
    n = F.coalesce("n", F.lit(0))
    confidence = F.when(n == 0, "UNKNOWN").when(n > 1, "AMBIGUOUS").when(F.col("sure"), "EXACT").otherwise("INFERRED")
    outside = (F.col("c_end") < F.col("f.first_at")) | (F.col("c_start") > F.col("f.last_at"))
    reason = F.when(n == 0, F.when(F.col("c_ip").isNull(), "peer not sampled").when(outside, "peer sampled outside the flow's life").otherwise("connection not seen at the peer"))
    return out.select("f.*", F.when(n == 1, F.col("p.o_pid")).alias("remote_pid"), F.when(n == 1, F.col("p.o_process")).alias("remote_process"), F.when(n == 1, F.col("p.o_app")).alias("remote_app"), confidence.alias("resolution"), F.coalesce("evidence", F.lit(0)).alias("evidence"), reason.alias("reason"))


#: A check follows so many connections, takes so many sockets of one frame of a peer, and remembers so many observations.
MOST_FLOWS, MOST_SOCKETS, MOST_OBSERVATIONS = 100, 400, 2000
TUPLE = ["local_ip", "local_port", "peer_ip", "peer_port", "protocol"]


def buffered_matches(events: DataFrame, observations: int = MOST_OBSERVATIONS, flows: int = MOST_FLOWS, sockets: int = MOST_SOCKETS) -> DataFrame:
    """(check, ref, other, n, status): what each sample of a connection finds new in its check's buffer of peer observations.

    events: (check, at, seq, kind, frame, local_ip, local_port, peer_ip, peer_port, protocol, context, ref) in the order of
    (at, seq). A peer event is numbered n within its check and stays among the last observations; of one
    frame the first sockets are taken, each further one gives a row "socket left out". A flow event
    finds the observations of the reversed tuple that are still there and that came after the flow's last sample; after
    a change of context, all that are there: "seen", with the observation's ref as other. Only the first flows
    of a check are followed, the first sample of each further one gives "flow left out".
    streaming.flows.buffered() gives the same rows from a stream.
    """
    order = W.partitionBy("check").orderBy("at", "seq")
    e = events.withColumn("place", F.when(F.col("kind") == "peer", F.row_number().over(W.partitionBy("check", "kind", "frame").orderBy("at", "seq"))))
    e = e.withColumn("taken", (F.col("place") <= sockets).cast("long")).withColumn("total", F.coalesce(F.sum("taken").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0)))
    peers = e.where("taken = 1").select("check", *[F.col(k).alias(f"o_{k}") for k in TUPLE], F.col("total").alias("n"), F.col("ref").alias("other"))
    samples = e.where("kind = 'flow'").withColumn("first", F.min(F.struct("at", "seq")).over(W.partitionBy("check", *TUPLE)))
    number = samples.select("check", *TUPLE, "first").distinct().withColumn("number", F.row_number().over(W.partitionBy("check").orderBy("first")))
    followed = samples.join(number.select("check", *TUPLE, "number"), ["check", *TUPLE])
    mine = W.partitionBy("check", *TUPLE).orderBy("at", "seq")
    cursor = F.when(F.lag("context").over(mine).eqNullSafe(F.col("context")), F.lag("total").over(mine))
    asked = followed.where(F.col("number") <= flows).withColumn("low", F.greatest(F.coalesce(cursor, F.lit(0)), F.col("total") - observations))
    meets = [asked["check"] == peers["check"], *[F.col(a) == F.col(f"o_{b}") for a, b in (("local_ip", "peer_ip"), ("local_port", "peer_port"), ("peer_ip", "local_ip"), ("peer_port", "local_port"), ("protocol", "protocol"))]]
    seen = asked.join(peers, meets).where((F.col("n") > F.col("low")) & (F.col("n") <= F.col("total"))).select(asked["check"], "ref", "other", "n", F.lit("seen").alias("status"))
    none = [F.lit(None).cast(peers.schema["other"].dataType).alias("other"), F.lit(None).cast("long").alias("n")]
    late = followed.where((F.col("number") > flows) & (F.struct("at", "seq") == F.col("first"))).select("check", "ref", *none, F.lit("flow left out").alias("status"))
    return seen.unionByName(late).unionByName(e.where("taken = 0").select("check", "ref", *none, F.lit("socket left out").alias("status")))


def keep_evidence(observations: DataFrame, owner: Sequence[str], at: str | Sequence[str], first: int = 2, last: int = 8) -> DataFrame:
    """The first and last observations of each owner, by one or more columns, with place, their number from the first."""
    order = [at] if isinstance(at, str) else list(at)
    up, down = W.partitionBy(*owner).orderBy(*order), W.partitionBy(*owner).orderBy(*map(F.desc, order))
    return observations.withColumn("place", F.row_number().over(up)).withColumn("_b", F.row_number().over(down)).where((F.col("place") <= first) | (F.col("_b") <= last)).drop("_b")


def listener_candidates(flows: DataFrame, listeners: DataFrame) -> DataFrame:
    """Processes at the peer that listen where a flow goes: (flow key, pid, process); candidates, not owners of the connection.

    listeners: (host_ip, bind, port, protocol, pid, process).  A wildcard bind fits addresses of its family.
    """
    v6 = F.col("peer_ip").contains(":")
    fits = F.col("bind").isin("*", "::") | (F.col("bind") == F.col("peer_ip")) | ((F.col("bind") == "0.0.0.0") & ~v6)
    x = listeners.withColumnRenamed("protocol", "l_protocol")
    return flows.join(x, (F.col("peer_ip") == F.col("host_ip")) & (F.col("peer_port") == F.col("port")) & (F.col("protocol") == F.col("l_protocol"))).where(fits).select(*KEY, "pid", "process").distinct()


def published_targets(flows: DataFrame, containers: DataFrame) -> DataFrame:
    """Containers behind a published port: (flow key, container, container_ip, container_port).

    containers: (container, host_ip, published_port, container_port, ips array<string>).  A flow asks for its peer's
    address and for the wildcard of its family, so that the join is on address and port and not on a port that all hosts publish; what is
    published on a wildcard fits every address, as it says.
    """
    wildcard = F.when(F.col("peer_ip").contains(":"), "::").otherwise("0.0.0.0")
    asked = flows.withColumn("_host", F.explode(F.array_distinct(F.array("peer_ip", wildcard))))
    hit = asked.join(containers, (F.col("_host") == F.col("host_ip")) & (F.col("peer_port") == F.col("published_port")))
    return hit.select(*KEY, "container", F.explode("ips").alias("container_ip"), "container_port")


def config_matches(flows: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Settings that name where a flow goes: (flow key, file, key).  endpoints: (file, key, host, port, resolved array<string>).

    Joined on address and port: an endpoint is repeated for its host and each address that this resolves to.
    """
    named = endpoints.withColumn("_ip", F.explode(F.array_distinct(F.concat(F.array("host"), F.coalesce("resolved", F.array().cast("array<string>")))))).where("_ip is not null")
    return flows.join(named, (F.col("peer_ip") == F.col("_ip")) & (F.col("peer_port") == F.col("port"))).select(*KEY, "file", "key")


def by_peer(flows: DataFrame) -> DataFrame:
    """Flows of one peer, port, direction and set of processes together."""
    return flows.groupBy("peer_ip", F.when(F.col("direction") == "downstream", F.col("peer_port")).otherwise(F.col("local_port")).alias("service_port"), "direction", "pids").agg(
        F.count("*").alias("flows"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("sent_delta").alias("sent"), F.sum("received_delta").alias("received")
    )


def service_hint(port_col: str = "peer_port"):
    """The usual service of a port, null if there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in PORT_HINTS.items() for x in (k, v)]), F.col(port_col).cast("int"))
