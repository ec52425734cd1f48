"""Typed property graphs as two DataFrames: nodes (id, type, ...) and edges (id, src, dst, type, env, confidence).

Searches are loops over a frontier DataFrame, each level written to the shared folder
(``settle``), so that the plan doesn't grow and a lost executor repeats one level only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Confidence from weak to strong; rounds of a search between two merges.
CONFIDENCE = {"UNKNOWN": 0, "AMBIGUOUS": 1, "INFERRED": 2, "EXACT": 3}
MERGE = 16


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session shares (spark.checkpoint.dir); a folder of its own is for local masters only."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not told:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        told = f"file://{tempfile.mkdtemp(prefix='tidegrid-')}"
        spark.sparkContext.setCheckpointDir(told)
    return f"{told.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "graph") -> DataFrame:
    """Write df into the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(seen: DataFrame, front: DataFrame, k: int, name: str) -> DataFrame:
    """seen with round k's rows; every MERGE rounds written as one table, so that the plan of a long search stays short."""
    both = seen.unionByName(front)
    return settle(both, name) if k % MERGE == 0 else both


def rank_of(confidence: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(y) for k, v in CONFIDENCE.items() for y in (k, v)]), confidence)


def name_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), (rank + 1).cast("int"))


#: Proofs that a merged node or edge carries; evidence_count says how many there are, evidence_of() gives all as a table.
MOST_EVIDENCE = 1000


def evidence_of(candidates: DataFrame) -> DataFrame:
    """(id, proof): the distinct proofs of candidates (id, evidence), a row each."""
    return candidates.select("id", F.explode("evidence").alias("proof")).distinct()


def _proofs(candidates: DataFrame, most: int) -> DataFrame:
    """(_id, evidence, evidence_count): the first distinct proofs of each id in their order, and how many there are.

    Repeats go before anything meets by id, and of an id with very many each task hands on its first ones only.
    """
    each = evidence_of(candidates)
    place = F.row_number().over(W.partitionBy("id").orderBy("proof"))
    first = each.withColumn("k", place).where(F.col("k") <= most).groupBy("id").agg(F.array_sort(F.collect_list("proof")).alias("evidence"))
    count = each.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("evidence_count"))
    return count.join(first, F.col("_id") == F.col("id")).drop("id")


def upsert_nodes(candidates: DataFrame, most_evidence: int = MOST_EVIDENCE) -> DataFrame:
    """One row an id from candidates (id, type, label, status, environment, identity, attributes, evidence, ord).

    Of a field the first non-empty value by ord stays, but of attributes the last one; a
    status that is "unknown" gives way to the first that isn't; evidence is the distinct union, sorted, the first most_evidence of evidence_count.
    types counts the distinct types, more than 1 being an error that validate() reports.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("ord")))
    known = F.when(F.col("status") != "unknown", F.col("status"))
    base = candidates.groupBy("id").agg(
        F.min_by("type", "ord").alias("type"), first("label").alias("label"), F.coalesce(F.min_by(known, F.when(known.isNotNull(), F.col("ord"))), F.lit("unknown")).alias("status"),
        F.min_by("environment", "ord").alias("environment"), F.countDistinct("type").alias("types"),
    )
    pick = lambda c, by: (candidates.select("id", "ord", F.explode(c).alias("k", "v")).where("v is not null and v <> ''").groupBy("id", "k").agg(by.alias("v")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(c)))
    identity, attributes = pick("identity", F.min_by("v", "ord")), pick("attributes", F.max_by("v", "ord"))
    return _with_proofs(base, candidates, most_evidence).join(identity, "id", "left").join(attributes, "id", "left")


def _with_proofs(base: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    none = F.array().cast(candidates.schema["evidence"].dataType)
    found = base.join(_proofs(candidates, most), F.col("id") == F.col("_id"), "left").drop("_id")
    return found.withColumns({"evidence": F.coalesce("evidence", none), "evidence_count": F.coalesce("evidence_count", F.lit(0))})


def upsert_edges(candidates: DataFrame, most_evidence: int = MOST_EVIDENCE) -> DataFrame:
    """One row an id from candidates (id, src, dst, type, env, confidence, evidence, ord): the first by ord, with the first most_evidence of its evidence_count proofs."""
    fields = [c for c in ("src", "dst", "type", "env", "confidence") if c in candidates.columns]
    first = candidates.groupBy("id").agg(F.min(F.when(F.col("ord").isNotNull(), F.struct("ord", *fields))).alias("x"))  # one value to keep for all fields
    return _with_proofs(first.select("id", *[F.col(f"x.{c}").alias(c) for c in fields]), candidates, most_evidence)


def adjacency(edges: DataFrame, environments: Sequence[str] | None = None, directed: bool = False) -> DataFrame:
    """(node, neighbour, edge_id, confidence, env): each edge from both its ends; GLOBAL edges and those of the environments."""
    allowed = edges if environments is None else edges.where(F.col("env").isin("GLOBAL", *environments))
    way = lambda a, b: allowed.select(F.col(a).alias("node"), F.col(b).alias("neighbour"), F.col("id").alias("edge_id"), "confidence", "env")
    return way("src", "dst") if directed else way("src", "dst").unionByName(way("dst", "src").where("node <> neighbour"))


def distances(nodes: DataFrame, steps: DataFrame, targets: Sequence[str], most: int | None = None) -> DataFrame:
    """(node, distance): steps to the nearest node of a target type; nodes that reach none, or none within most steps if that is given, are left out."""
    return _distances(nodes, settle(steps.select("node", "neighbour"), "steps"), targets, most)


def _distances(nodes: DataFrame, steps: DataFrame, targets: Sequence[str], most: int | None) -> DataFrame:
    """distances() over steps that are written already; where every node is seen, no further round looks for more."""
    known = settle(nodes.select(F.col("id").alias("node"), "type"), "nodes")
    seen = front = settle(known.where(F.col("type").isin(*targets)).select("node", F.lit(0).alias("distance")).distinct(), "dist")
    left = known.count() - front.count()
    for k in count(1) if most is None else range(1, most + 1):
        if left <= 0:
            break
        reached = steps.join(front.select(F.col("node").alias("neighbour")), "neighbour").select("node").distinct()
        front = settle(reached.join(known, "node", "left_semi").join(seen, "node", "left_anti").withColumn("distance", F.lit(k)), "dist")
        new = front.count()
        if not new:
            break
        left -= new
        seen = merged(seen, front, k, "dist")
    return seen


def _ahead(nodes: DataFrame, kind: DataFrame, steps: DataFrame, targets: Sequence[str], depth: int, more: Sequence[str] = ()) -> DataFrame:
    """(node, neighbour, more..., rank, distance, arrived, open): the steps to nodes (id, type, status of kind) from which a target is within depth; distance is what is still to go."""
    steps = settle(steps.select("node", "neighbour", "confidence", *more), "steps")
    far = _distances(nodes, steps, targets, depth)
    return settle(steps.join(far.withColumnRenamed("node", "neighbour"), "neighbour").join(kind.withColumnRenamed("id", "neighbour"), "neighbour").select(
        "node", "neighbour", *more, rank_of(F.col("confidence")).alias("rank"), "distance", F.col("type").isin(*targets).alias("arrived"),
        F.coalesce(F.col("status").isin("unresolved", "external"), F.lit(False)).alias("open"),
    ), "ahead")


def path_counts(nodes: DataFrame, steps: DataFrame, starts: DataFrame, targets: Sequence[str], depth: int = 8) -> DataFrame:
    """(start_id, end_id, length, confidence, paths): how many paths of paths() have these ends, this length and this weakest confidence, without a row for each path.

    Prefixes of a start that stand at the same node with the same weakest confidence are one row with their number. A path
    returns to no node: those that can be returned to are the nodes that prefixes of a start meet at more than one length. A first
    pass finds out whether there are any; if so, a second one keeps the names of these nodes, and only these, with the prefixes.
    """
    kind = nodes.groupBy("id").agg(F.min("type").alias("type"), F.min("status").alias("status"))
    ahead = _ahead(nodes, kind, steps, targets, depth)
    go, end = ahead.where("not arrived"), ahead.where("arrived")
    first = settle(starts.select("id").distinct().join(kind, "id").select(F.col("id").alias("start_id"), F.col("id").alias("at")), "starts")

    def walk(again: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        def noted(rows: DataFrame) -> DataFrame:  # the nodes of a prefix that can be met again
            if again is None:
                return rows
            met = rows.join(again, ["start_id", "at"], "left")
            return met.withColumn("kept", F.when(F.col("again"), F.array_sort(F.array_append("kept", F.col("at")))).otherwise(F.col("kept"))).drop("again")

        frontier = noted(first.select("start_id", "at", F.lit(None).cast("int").alias("rank"), F.array().cast("array<string>").alias("kept"), F.lit(0).alias("k"), F.lit(1).cast("long").alias("paths")))
        met = first.select("start_id", "at", F.lit(0).alias("k"), F.lit(False).alias("arrived"))

        def moved(prefixes: DataFrame, way: DataFrame) -> DataFrame:
            both = prefixes.alias("f").join(way.alias("s"), F.col("f.at") == F.col("s.node")).where((F.col("s.distance") + F.col("f.k") < depth) & ~F.array_contains("f.kept", F.col("s.neighbour")))
            both = both.select("start_id", F.col("s.neighbour").alias("at"), F.least("f.rank", "s.rank").alias("rank"), "kept", (F.col("f.k") + 1).alias("k"), "paths")
            return both.groupBy("start_id", "at", "rank", "kept", "k").agg(F.sum("paths").alias("paths"))

        prefixes = frontier
        for _ in range(1, depth):
            level = settle(moved(frontier, go), "counts")
            if level.isEmpty():
                break
            met = met.unionByName(level.select("start_id", "at", "k", F.lit(False).alias("arrived")))
            frontier = noted(level)
            prefixes = prefixes.unionByName(frontier)
        last = settle(moved(prefixes, end), "counts")  # the last steps of all lengths in one join
        met = met.unionByName(last.select("start_id", "at", "k", F.lit(True).alias("arrived")))
        return last.select("start_id", F.col("at").alias("end_id"), F.col("k").alias("length"), name_of(F.col("rank")).alias("confidence"), "paths"), met

    found, met = walk(None)
    again = met.groupBy("start_id", "at").agg(F.min(F.when(~F.col("arrived"), F.col("k"))).alias("before"), F.max("k").alias("after")).where("before < after")
    again = settle(again.select("start_id", "at", F.lit(True).alias("again")), "again")
    if not again.isEmpty():
        found, _ = walk(again)
    return found.groupBy("start_id", "end_id", "length", "confidence").agg(F.sum("paths").alias("paths"))


def paths(nodes: DataFrame, steps: DataFrame, starts: DataFrame, targets: Sequence[str], depth: int = 8, most: int | None = 50) -> tuple[DataFrame, bool]:
    """(start_id, end_id, nodes, edges, length, confidence, weak_edges, environments, unresolved), and whether there are more than most.

    Simple paths of 1 to depth steps from each start (column id) to the first node of a target type
    on the way.  A prefix is carried on only while its length and the distance still to
    go are within depth, so nothing is expanded that can't arrive.  most is a report's length, in the
    order confidence (strong first), length, edges; None: all paths.
    """
    kind = nodes.groupBy("id").agg(F.min("type").alias("type"), F.min("status").alias("status"))
    ahead = _ahead(nodes, kind, steps, targets, depth, ["edge_id", "env"])
    go, end = ahead.where("not arrived"), ahead.where("arrived")
    first = starts.select("id").distinct().join(kind, "id")
    empty = lambda t: F.array().cast(f"array<{t}>")
    frontier = first.select(
        F.col("id").alias("start_id"), F.col("id").alias("at"), F.array("id").alias("nodes"), empty("string").alias("edges"), empty("int").alias("ranks"), empty("string").alias("envs"),
        F.coalesce(F.col("status").isin("unresolved", "external"), F.lit(False)).alias("open"),
    )

    def moved(prefixes: DataFrame, way: DataFrame) -> DataFrame:
        both = prefixes.alias("f").join(way.alias("s"), F.col("f.at") == F.col("s.node")).where((F.col("s.distance") + F.size("f.edges") < depth) & ~F.array_contains("f.nodes", F.col("s.neighbour")))
        return both.select(
            "start_id", F.col("s.neighbour").alias("at"), F.array_append("f.nodes", F.col("s.neighbour")).alias("nodes"), F.array_append("f.edges", F.col("s.edge_id")).alias("edges"),
            F.array_append("f.ranks", F.col("s.rank")).alias("ranks"), F.array_append("f.envs", F.col("s.env")).alias("envs"), (F.col("f.open") | F.col("s.open")).alias("open"),
        )

    prefixes = frontier
    for _ in range(1, depth):
        frontier = settle(moved(frontier, go), "paths")
        if frontier.isEmpty():
            break
        prefixes = prefixes.unionByName(frontier)
    found = moved(prefixes, end)  # the last steps of all lengths in one join, and never written: what asks for the paths makes them of the prefixes
    weakest = F.array_min("ranks")
    weak = F.transform(F.filter(F.arrays_zip("edges", "ranks"), lambda e: e["ranks"] == weakest), lambda e: e["edges"])
    made = found.select(
        "start_id", F.col("at").alias("end_id"), "nodes", "edges", F.size("edges").alias("length"), name_of(weakest).alias("confidence"), weak.alias("weak_edges"),
        F.array_distinct("envs").alias("environments"), (F.col("open") | (weakest == 0)).alias("unresolved"), weakest.alias("_rank"), F.array_join("edges", ">").alias("_sign"),
    )
    if most is None:
        return made.drop("_rank", "_sign"), False
    truncated = made.limit(most + 1).count() > most
    return made.orderBy(F.desc("_rank"), "length", "_sign").limit(most).drop("_rank", "_sign"), truncated


def reachable_types(nodes: DataFrame, steps: DataFrame, starts: DataFrame, depth: int = 8) -> DataFrame:
    """(type, nodes, nearest): what can be reached from the starts within depth."""
    steps = settle(steps.select("node", "neighbour").distinct(), "steps")
    seen = settle(starts.select(F.col("id").alias("node")).distinct().withColumn("distance", F.lit(0)), "reach")
    for k in range(1, depth + 1):
        new = steps.join(seen.where(F.col("distance") == k - 1).select("node"), "node").select(F.col("neighbour").alias("node")).distinct()
        new = settle(new.join(seen, "node", "left_anti").withColumn("distance", F.lit(k)), "reach")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen.join(nodes.select(F.col("id").alias("node"), "type"), "node").groupBy("type").agg(F.countDistinct("node").alias("nodes"), F.min("distance").alias("nearest"))


def closure(links: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, distance): all nodes that the starts (column node) reach over directed links (src, dst), nearest first; ends on cycles.

    That is a row for each pair of a start and what it reaches, one hop a round: a chain of n nodes that all start has n * n / 2.
    chain_ends() gives the ends alone, where every node has one link.

    depth: an error if there are nodes farther than that; never a part of the closure.
    """
    links = settle(links.select("src", "dst").distinct(), "links")
    seen = front = settle(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("distance", F.lit(0)), "closure")
    for k in count(1):
        new = front.join(links, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = settle(new.join(seen, ["start", "node"], "left_anti").withColumn("distance", F.lit(k)), "closure")
        if front.isEmpty():
            break
        if depth is not None and k > depth:
            raise ValueError(f"closure: nodes are farther than {depth} steps")
        seen = merged(seen, front, k, "closure")
    return seen


def reached(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): the starts (column node) and all nodes that they reach over directed links (src, dst), whichever start it was; ends on cycles.

    A link is followed once and then gone, so each round carries only the links that nothing has reached, and no round meets what was seen before.
    """
    links = settle(links.select("src", "dst").where("src is not null and dst is not null").distinct(), "links")
    seen = front = settle(starts.select("node").distinct(), "reached")
    for k in count(1):
        here = front.select(F.col("node").alias("_node")).hint("merge")
        both = settle(links.join(here, F.col("src") == F.col("_node"), "left").select("src", "dst", F.col("_node").isNotNull().alias("hit")), "links")
        front = settle(both.where("hit").select(F.col("dst").alias("node")).distinct(), "reached")
        if front.isEmpty():
            break
        links = both.where("not hit").drop("hit")
        seen = merged(seen, front, k, "reached")
    return seen.distinct()


def chain_ends(links: DataFrame) -> DataFrame:
    """(node, end, distance) of links (src, dst), of which each src has one: where following them ends; end is null for what runs into a cycle.

    Every round joins each node's reach to that of the node it has reached, so the reach doubles: the logarithm of the longest chain in rounds, one
    row a node in each. A node that links to itself ends there.
    """
    one = links.groupBy("src").agg(F.min("dst").alias("dst")).where("src <> dst")
    state = settle(one.select(F.col("src").alias("node"), F.col("dst").alias("at"), F.lit(1).cast("long").alias("distance")), "ends")
    total = state.count()
    while True:
        ahead = state.select(F.col("node").alias("_node"), F.col("at").alias("_at"), F.col("distance").alias("_distance")).hint("merge")  # both sides are whole tables: never sent to the driver
        moved = state.join(ahead, F.col("at") == F.col("_node"), "left")
        state = settle(moved.select("node", F.coalesce("_at", "at").alias("at"), (F.col("distance") + F.coalesce("_distance", F.lit(0))).alias("distance"), F.col("_node").isNull().alias("ended")), "ends")
        open_ = state.where("not ended")
        longest = open_.agg(F.count("*").alias("n"), F.min("distance").alias("distance")).first()
        if not longest.n or longest.distance > total:  # what has gone further than there are nodes goes round
            break
        state = state.drop("ended")
    return state.select("node", F.when(F.col("ended"), F.col("at")).alias("end"), F.when(F.col("ended"), F.col("distance")).alias("distance"))


def resolve_names(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id, matched_by, candidates, status): nodes by id, else by label, else by an identity value; found, ambiguous or not-found."""
    low = F.lower(F.trim("asked"))
    keys = nodes.select("id", F.explode(F.array(
        F.struct(F.lit(0).alias("tier"), F.lit("id").alias("by"), F.lower("id").alias("key")), F.struct(F.lit(1).alias("tier"), F.lit("label").alias("by"), F.lower("label").alias("key")),
    )).alias("k")).select("id", "k.*")
    if "identity" in nodes.columns:
        keys = keys.unionByName(nodes.select("id", F.explode(F.map_values("identity")).alias("v")).select("id", F.lit(2).alias("tier"), F.lit("identity").alias("by"), F.lower("v").alias("key")))
    hits = asked.select("asked").distinct().withColumn("key", low).join(keys, "key")
    tier = hits.groupBy("asked").agg(F.min("tier").alias("tier"))
    best = hits.join(tier, ["asked", "tier"]).select("asked", "id", F.col("by").alias("matched_by")).distinct()
    count = best.groupBy("asked").agg(F.count("*").alias("candidates"))
    out = asked.select("asked").distinct().join(best, "asked", "left").join(count, "asked", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return out.withColumn("status", F.when(F.col("candidates") == 0, "not-found").when(F.col("candidates") == 1, "found").otherwise("ambiguous"))


def validate(nodes: DataFrame, edges: DataFrame, ambiguous_edges: int | None = None) -> DataFrame:
    """(severity, code, node_id, edge_id) of what is wrong with a graph; an empty table: nothing.

    nodes has id, type and identity (a map); edges id, src, dst, type, confidence and evidence.
    """
    issue = lambda df, severity, code, node=None, edge=None: df.select(F.lit(severity).alias("severity") if isinstance(severity, str) else severity.alias("severity"), F.lit(code).alias("code"), (F.col(node) if node else F.lit(None)).cast("string").alias("node_id"), (F.col(edge) if edge else F.lit(None)).cast("string").alias("edge_id"))
    twice = lambda df: df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("n"))))
    ids = nodes.select("id").distinct()
    out = [issue(twice(nodes), "error", "DUPLICATE_NODE_ID", "id"), issue(twice(edges), "error", "DUPLICATE_EDGE_ID", None, "id")]
    for end in ("src", "dst"):
        out.append(issue(edges.join(ids.withColumnRenamed("id", end), end, "left_anti"), "error", "MISSING_EDGE_NODE", None, "id"))
    if "evidence" in edges.columns:
        out.append(issue(edges.where(F.coalesce(F.size("evidence"), F.lit(0)) <= 0), "error", "EDGE_WITHOUT_EVIDENCE", None, "id"))
    out.append(issue(edges.where(~F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False))), "error", "INVALID_CONFIDENCE", None, "id"))
    if "identity" in nodes.columns:
        part = lambda k: F.coalesce(F.col("identity")[k], F.lit(""))
        ends = nodes.where("type = 'ENDPOINT'").withColumn("ip", part("ip"))
        host = r"^(\d{1,3}(\.\d{1,3}){3}|[0-9a-f:]*:[0-9a-f:]+|[a-z0-9]([a-z0-9.-]*[a-z0-9])?)$"
        good = (F.col("id") == F.concat_ws(":", F.lit("endpoint"), "ip", part("port"), part("protocol"))) & F.col("ip").rlike(host) & part("port").rlike(r"^(\d+|\d+-\d+|any|unknown)$") & part("protocol").rlike(r"^[a-z0-9][a-z0-9._-]*$")
        out.append(issue(ends.where(~good), "error", "INVALID_ENDPOINT_FORMAT", "id"))
        deployed = nodes.where("type = 'DEPLOYMENT'").join(edges.where("type = 'LISTENS_ON'").select(F.col("src").alias("id")).distinct(), "id", "left_anti")
        out.append(issue(deployed, F.when(part("ip") != "", "error").otherwise("warning"), "DEPLOYMENT_WITHOUT_ENDPOINT", "id"))
        hosts = nodes.where("type = 'HOST'").select(F.col("id").alias("dst"), part("ip").alias("ip")).where("ip <> ''").distinct()
        missing = ends.where(good).join(hosts, "ip").join(edges.where("type = 'ON_HOST'").select(F.col("src").alias("id"), "dst"), ["id", "dst"], "left_anti")
        found_by = F.coalesce(F.col("attributes")["discoveredBy"], F.lit("")) if "attributes" in nodes.columns else F.lit("")
        out.append(issue(missing, F.when(found_by.contains("inventory"), "error").otherwise("warning"), "ENDPOINT_WITHOUT_EXPECTED_HOST", "id"))
    if ambiguous_edges is not None:
        n = edges.agg(F.count(F.when(F.col("confidence") == "AMBIGUOUS", 1)).alias("n")).where(F.col("n") != ambiguous_edges)
        out.append(issue(n, "error", "AMBIGUOUS_EDGE_COUNT_MISMATCH"))
    made = out[0]
    for x in out[1:]:
        made = made.unionByName(x)
    return made


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, ambiguous edges, nodes that are unresolved or external."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count(F.when(F.col("status").isin("unresolved", "external"), 1)).alias("unresolved_nodes"))
    return n.join(edges.agg(F.count("*").alias("edges"), F.count(F.when(F.col("confidence") == "AMBIGUOUS", 1)).alias("ambiguous_edges")))


def ancestors(paths_: DataFrame, path_col: str, separator: str = "/") -> DataFrame:
    """(path, parent, depth, members): each path's ancestors and itself, with how many paths lie at or below it."""
    parts = F.split(F.col(path_col), f"\\Q{separator}\\E")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    tree = paths_.select(F.explode(up).alias("path")).groupBy("path").agg(F.count("*").alias("members"))
    own = F.split("path", f"\\Q{separator}\\E")
    return tree.select("path", F.array_join(F.slice(own, F.lit(1), F.size(own) - 1), separator).alias("parent"), F.size(own).alias("depth"), "members")
