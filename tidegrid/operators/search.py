"""The best paths from each start, found without listing all of them.

Before the search every node learns how far the nearest target is over edges of each least confidence. A prefix
then has a bound: the strongest confidence with which it can still arrive within the depth, and the length that takes.
A prefix that is nearer to a target than every node it has passed can certainly arrive with its bound, since
the shortest way on only leads to nodes that are nearer still; so the first k such prefixes and finished paths of a start
prove k paths, and whatever is behind the last of them can't be among the first k. Each round
adds a step to the prefixes that are left, in a layered graph k of them a start, whatever the graph's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.operators.graph import CONFIDENCE, name_of, rank_of, settle

FAR = 1 << 20


def outlook(nodes: DataFrame, steps: DataFrame, targets: Sequence[str], depth: int) -> DataFrame:
    """(node, far): the steps to the nearest node of a target type over edges of confidence 0, 1, 2 and 3 at least, FAR where none is within depth.

    steps has (node, neighbour, rank). A node is reached again only with more confidence than before, so at most four times.
    """
    back = steps.select(F.col("neighbour").alias("node"), F.col("node").alias("from"), "rank")
    seen = front = settle(nodes.where(F.col("type").isin(*targets)).select(F.col("id").alias("node")).distinct().select("node", F.lit(len(CONFIDENCE) - 1).alias("rank"), F.lit(0).alias("distance")), "outlook")
    for k in range(1, depth + 1):
        reached = front.select("node", F.col("rank").alias("least")).join(back, "node").groupBy(F.col("from").alias("node")).agg(F.max(F.least("least", "rank")).alias("rank"))
        best = seen.groupBy("node").agg(F.max("rank").alias("had"))
        front = settle(reached.join(best, "node", "left").where(F.col("rank") > F.coalesce("had", F.lit(-1))).select("node", "rank", F.lit(k).alias("distance")), "outlook")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    each = [F.coalesce(F.min(F.when(F.col("rank") >= r, F.col("distance"))), F.lit(FAR)) for r in CONFIDENCE.values()]
    return seen.groupBy("node").agg(F.array(*each).alias("far"))


def best_paths(nodes: DataFrame, steps: DataFrame, starts: DataFrame, targets: Sequence[str], depth: int = 8, most: int = 50, states: int = 200_000) -> DataFrame:
    """(start_id, end_id, nodes, edges, length, confidence, weak_edges, environments, unresolved, truncated): of each start the first paths.

    steps as from graph.adjacency(), starts has the column id. Paths are simple, of 1 to depth steps, and end at the first
    node of a target type. Their order is confidence (strong first), length, edges; each start gets its first most.
    truncated: the start has more than these, or it had more than states prefixes at once, of which
    the most promising were followed. Starts that reach nothing have no row. nodes has id, type, status.
    """
    want = most + 1  # one more tells whether there are more
    steps = settle(steps.select("node", "neighbour", "edge_id", "env", rank_of(F.col("confidence")).cast("int").alias("rank")), "steps")
    kind = nodes.groupBy("id").agg(F.min("type").alias("type"), F.coalesce(F.min("status").isin("unresolved", "external"), F.lit(False)).alias("open"))
    look = settle(outlook(nodes, steps, targets, depth).join(kind, F.col("node") == F.col("id")).select("node", "far", F.col("type").isin(*targets).alias("arrived"), "open"), "look")
    near = look.select(F.col("node").alias("neighbour"), "far", "arrived", "open")
    empty = lambda t: F.array().cast(f"array<{t}>")
    first = starts.select("id").distinct().join(look, F.col("id") == F.col("node"))
    live = first.select(F.col("id").alias("start_id"), F.col("id").alias("at"), F.array("id").alias("nodes"), empty("string").alias("edges"), empty("int").alias("ranks"), empty("string").alias("envs"), F.lit(len(CONFIDENCE) - 1).alias("weakest"), "open", F.col("far").alias("passed"))
    prefix, done, over = live.columns, None, None
    key = (F.desc("bound"), "total", "sign")
    for k in range(1, depth + 1):
        moved = live.select(*prefix).alias("p").join(steps.alias("s"), F.col("p.at") == F.col("s.node")).where(~F.array_contains("p.nodes", F.col("s.neighbour")))
        moved = moved.join(near.alias("n"), F.col("s.neighbour") == F.col("n.neighbour"))
        weakest = F.least("p.weakest", "s.rank")
        bound = F.greatest(*[F.when((weakest >= r) & (F.get("n.far", F.lit(r)) + F.lit(k) <= depth), F.lit(r)) for r in CONFIDENCE.values()])  # null: it can't arrive any more
        edges = F.array_append("p.edges", F.col("s.edge_id"))
        grown = moved.select(
            "start_id", F.col("s.neighbour").alias("at"), F.array_append("p.nodes", F.col("s.neighbour")).alias("nodes"), edges.alias("edges"), F.array_append("p.ranks", F.col("s.rank")).alias("ranks"), F.array_append("p.envs", F.col("s.env")).alias("envs"),
            weakest.alias("weakest"), (F.col("p.open") | F.col("n.open")).alias("open"), F.zip_with("p.passed", "n.far", lambda a, b: F.least(a, b)).alias("passed"),
            bound.alias("bound"), (F.get("n.far", bound) + k).alias("total"), F.concat(F.array_join(edges, ">"), F.when(F.col("n.arrived"), "").otherwise(">")).alias("sign"),
            "arrived", (F.col("n.arrived") | (F.get("n.far", bound) <= F.get("p.passed", bound))).alias("sure"),
        )
        level = settle(grown.where("bound is not null"), "level")
        both = level if done is None else level.unionByName(done)
        place = F.row_number().over(W.partitionBy("start_id").orderBy(*key))
        last = both.where("sure").withColumn("k", place).where(F.col("k") <= want).groupBy("start_id").agg(F.max(F.struct(-F.col("bound"), "total", "sign")).alias("last"), F.count("*").alias("n"))
        last = last.where(F.col("n") == want).select(F.col("start_id").alias("of"), "last")
        ahead = F.col("last").isNull() | (F.struct(-F.col("bound"), "total", "sign") <= F.col("last"))
        kept = both.join(last, F.col("start_id") == F.col("of"), "left").where(ahead).drop("of", "last")
        kept = settle(kept, "kept")
        crowded = kept.where("not arrived").groupBy("start_id").agg(F.count("*").alias("n"))
        totals = crowded.agg(F.count("*").alias("starts"), F.max("n").alias("most")).first()
        done = kept.where("arrived")
        if not totals.starts or k == depth:
            break
        live = kept.where("not arrived")
        if totals.most > states:
            more = settle(crowded.where(F.col("n") > states).select("start_id"), "over")
            over = more if over is None else over.unionByName(more)
            live = settle(live.withColumn("k", place).where(F.col("k") <= states), "live")
    ranked = done.withColumn("k", F.row_number().over(W.partitionBy("start_id").orderBy(*key)))
    counts = ranked.groupBy(F.col("start_id").alias("of")).agg((F.count("*") > most).alias("more"))
    cut = counts if over is None else counts.join(over.distinct().withColumn("lost", F.lit(True)), F.col("of") == F.col("start_id"), "left").select("of", (F.col("more") | F.col("lost").isNotNull()).alias("more"))
    weak: Column = F.transform(F.filter(F.arrays_zip("edges", "ranks"), lambda e: e["ranks"] == F.col("weakest")), lambda e: e["edges"])
    return ranked.where(F.col("k") <= most).join(cut, F.col("start_id") == F.col("of")).select(
        "start_id", F.col("at").alias("end_id"), "nodes", "edges", F.size("edges").alias("length"), name_of(F.col("weakest")).alias("confidence"), weak.alias("weak_edges"),
        F.array_distinct("envs").alias("environments"), (F.col("open") | (F.col("weakest") == 0)).alias("unresolved"), F.col("more").alias("truncated"),
    )
