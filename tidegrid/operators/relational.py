"""Joins, sets, windows and summaries that inventories need and Spark has no single call for.

Everything is a composition of DataFrame operations: equi-joins on keys wherever there is a key,
windows partitioned by a key, and aggregations with partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegrid.operators.graph import settle


# sets --------------------------------------------------------------------------------------------
def overriding_union(base: DataFrame, override: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of override, and those of base whose key override doesn't have."""
    return base.join(override.select(*on).distinct(), list(on), "left_anti").unionByName(override)


def replace_slices(previous: DataFrame, new: DataFrame, slice_col: str, selected: Sequence) -> DataFrame:
    """previous without the selected slices, and new's rows of those, even if new has none of a slice."""
    chosen = F.coalesce(F.col(slice_col).isin(*selected), F.lit(False))
    return previous.where(~chosen).unionByName(new.where(chosen))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with their multiplicity, that only one of two tables has; column side is "a" or "b"."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def change_set(before: DataFrame, after: DataFrame, on: Sequence[str], compare: Sequence[str], complete: bool = True) -> DataFrame:
    """(key, action): created, updated, unchanged, or missing, the last only if after is complete."""
    both = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in compare])
    same_key = [F.col(f"b.{k}") == F.col(f"a.{k}") for k in on]
    joined = before.withColumn("_in", F.lit(1)).alias("b").join(after.withColumn("_in", F.lit(1)).alias("a"), same_key, "full")
    action = F.when(F.col("b._in").isNull(), "created").when(F.col("a._in").isNull(), "missing").when(both("b").eqNullSafe(both("a")), "unchanged").otherwise("updated")
    made = joined.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in on], action.alias("action"))
    return made if complete else made.where("action <> 'missing'")


# windows -----------------------------------------------------------------------------------------
def first_per(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by order, by one aggregation with partial maxima instead of a sort."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_x"))
    return best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in (*order, *rest)]).select(df.columns)


def first_by_content(df: DataFrame, content: Sequence[str], order: str) -> DataFrame:
    """The first row by order of all rows that agree in content, nulls being equal, with repeats, how many these are."""
    rest = [c for c in df.columns if c not in content]
    return df.groupBy(*content).agg(F.min_by(F.struct(*rest), order).alias("_x"), F.count("*").alias("repeats")).select(*content, *[F.col(f"_x.{c}").alias(c) for c in rest], "repeats")


def best_with_ties(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """All rows of each key that share its first rank; column ties counts them."""
    ranked = df.withColumn("_k", F.rank().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
    return ranked.withColumn("ties", F.count("*").over(W.partitionBy(*keys)))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, total: int) -> DataFrame:
    """Rows of a page, its number clamped to the pages that there are; only the rows up to its end are sorted out."""
    last = max(1, -(-total // size))
    number = min(max(1, number), last)
    return df.orderBy(*order).limit(number * size).offset((number - 1) * size)


def gaps(df: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """df with gap_s, the seconds since the key's row before, null for the first."""
    w = W.partitionBy(*keys).orderBy(at, tie)
    return df.withColumn("gap_s", (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / 1e6)


def islands(df: DataFrame, keys: Sequence[str], at: str, tie: str, longest_gap_s: float) -> DataFrame:
    """df with island, the number of the key's stretch without a gap of more than longest_gap_s, from 0."""
    starts = (F.col("gap_s") > longest_gap_s).cast("int")
    w = W.partitionBy(*keys).orderBy(at, tie).rowsBetween(W.unboundedPreceding, 0)
    return gaps(df, keys, at, tie).withColumn("island", F.sum(F.coalesce(starts, F.lit(0))).over(w))


def coverage(df: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """Samples, first and last, mean and longest gap of each key."""
    return gaps(df, keys, at, tie).groupBy(*keys).agg(
        F.count("*").alias("samples"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.round(F.avg("gap_s"), 3).alias("mean_gap_s"), F.round(F.max("gap_s"), 3).alias("max_gap_s")
    )


# joins -------------------------------------------------------------------------------------------
def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, status): both, left_only or right_only for each distinct key; null keys are left out."""
    keys = lambda df, name: df.where(F.col(key).isNotNull()).select(key).distinct().withColumn(name, F.lit(True))
    joined = keys(left, "l").join(keys(right, "r"), key, "full")
    return joined.select(key, F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left_only").otherwise("right_only").alias("status"))


def mutually_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of rows whose key is unique on both sides, with status matched; otherwise one row a key, ambiguous."""
    count = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))
    both = count(left, "n_left").join(count(right, "n_right"), key)
    return both.withColumn("status", F.when((F.col("n_left") == 1) & (F.col("n_right") == 1), "matched").otherwise("ambiguous"))


def tiered_match(rows: DataFrame, tiers: Sequence[tuple[str, DataFrame, Sequence[str]]], row_key: Sequence[str]) -> DataFrame:
    """Each row with the candidate of the first tier that has any.

    tiers: (name, candidates with columns key... and candidate, key columns).  A tier with one
    candidate gives status matched, with several ambiguous (candidate null, n how many);
    no tier: unmatched.  Later tiers only see what is left, so each row is joined once a tier at most.
    """
    out, rest = None, rows
    for name, candidates, keys in tiers:
        found = candidates.groupBy(*keys).agg(F.countDistinct("candidate").alias("n"), F.min("candidate").alias("candidate"))
        joined = rest.join(found, list(keys), "left")
        hit = joined.where("n is not null").select(*rows.columns, F.lit(name).alias("tier"), F.when(F.col("n") == 1, F.col("candidate")).alias("candidate"), "n")
        out = hit if out is None else out.unionByName(hit)
        rest = joined.where("n is null").select(*rows.columns)
    missed = rest.select(*rows.columns, F.lit(None).cast("string").alias("tier"), F.lit(None).cast(out.schema["candidate"].dataType).alias("candidate"), F.lit(0).cast("long").alias("n"))
    status = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return out.unionByName(missed).withColumn("status", status)


def range_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, low: str, high: str, width: float) -> DataFrame:
    """Inner join of numeric points with the ranges of the same keys that contain them.

    Both sides are cut into cells of the given width, so this is an equi-join on keys and cell: a key
    with very many points or ranges is many groups.  A range is repeated in each cell it touches;
    width should be near a usual range's length.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    spread = ranges.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("_cell", cell(at)).join(spread, [*keys, "_cell"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_cell")


def longest_prefix(rows: DataFrame, path_col: str, rules: DataFrame, prefix_col: str, separator: str = "/") -> DataFrame:
    """rows with the rule whose prefix is the longest one of path, at segment ends; left join.

    Instead of comparing each row with each rule, a path's own prefixes are joined to the rules.
    """
    parts = F.split(F.col(path_col), f"\\Q{separator}\\E")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    asked = rows.select(path_col).where(F.col(path_col).isNotNull()).distinct().withColumn("_prefix", F.explode(prefixes))
    best = asked.join(rules, F.col("_prefix") == F.col(prefix_col)).groupBy(path_col).agg(F.max_by(F.struct(*rules.columns), F.length("_prefix")).alias("_rule"))
    return rows.join(best, path_col, "left").select(*rows.columns, *[F.col(f"_rule.{c}").alias(c) for c in rules.columns])


def deepest_only(df: DataFrame, entity: str, key: str, separator: str = ":") -> DataFrame:
    """Memberships without those that another of the same entity lies below (its key starts with key + separator)."""
    parts = F.split(F.col(key), f"\\Q{separator}\\E")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    inner = df.where(F.size(parts) > 1).select(entity, F.explode(above).alias(key)).distinct()
    return df.join(inner, [entity, key], "left_anti")


def keep_unmatched(asked: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every asked row with what is found for it, and matched true or false."""
    return asked.join(found.withColumn("matched", F.lit(True)), list(on), "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def claim_once(candidates: DataFrame, record: str, target: str, order: str) -> DataFrame:
    """One-to-one pairs of a candidate list: kept if neither side has a second candidate, else status ambiguous.

    Sequential claiming would depend on order; here what two records want is nobody's, and order only names the first of them.
    """
    c = candidates.select(record, target, order).distinct()
    n_targets = c.groupBy(record).agg(F.countDistinct(target).alias("n_targets"))
    n_records = c.groupBy(target).agg(F.countDistinct(record).alias("n_records"), F.min_by(record, order).alias("first_record"))
    status = F.when((F.col("n_targets") == 1) & (F.col("n_records") == 1), "matched").otherwise("ambiguous")
    return c.join(n_targets, record).join(n_records, target).withColumn("status", status)


def unique_on_a_side(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of which one side is in no other pair."""
    alone = lambda k: pairs.groupBy(k).agg(F.count("*").alias("_n")).where("_n = 1").select(k)
    return pairs.join(alone(left), left, "left_semi").unionByName(pairs.join(alone(right), right, "left_semi")).distinct()


def reversed_pairs(flows: DataFrame, others: DataFrame, local: Sequence[str], peer: Sequence[str], prefix: str = "o_") -> DataFrame:
    """flows joined to the observations of the other end: its local is the flow's peer and the reverse."""
    named = others.select(*[F.col(c).alias(prefix + c) for c in others.columns])
    same = [F.col(a) == F.col(prefix + b) for a, b in (*zip(local, peer, strict=True), *zip(peer, local, strict=True))]
    return flows.join(named, same)


# summaries ---------------------------------------------------------------------------------------
def single_dependency(df: DataFrame, group: Sequence[str], host: str) -> DataFrame:
    """(group..., host, rows) of the groups that depend on one host only; a group with a row whose host isn't known has incomplete data and is left out."""
    made = df.groupBy(*group).agg(F.min(host).alias(host), F.max(host).alias("_most"), F.count("*").alias("rows"), F.count(host).alias("_known"))
    return made.where((F.col(host) == F.col("_most")) & (F.col("rows") == F.col("_known"))).select(*group, host, "rows")


def shared_hosts(df: DataFrame, host: Sequence[str], member: str, port: str) -> DataFrame:
    """(host..., members, rows, ports) of the hosts that serve more than one member."""
    return df.groupBy(*host).agg(F.countDistinct(member).alias("members"), F.count("*").alias("rows"), F.countDistinct(port).alias("ports")).where("members > 1")


def group_tree(df: DataFrame, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """One row for each prefix of the key values, with depth from 1; missing values are the label "(none)"."""
    filled = df.select(*df.columns, *[F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit("(none)")).alias(f"_{k}") for k in keys])
    names = [f"_{k}" for k in keys]
    made = filled.rollup(*names).agg(F.grouping_id(*names).alias("_g"), *[m.alias(n) for n, m in measures.items()])
    depth = sum(((F.col("_g").bitwiseAND(1 << i) == 0).cast("int") for i in range(len(keys))), F.lit(0))
    return made.withColumn("depth", depth).where("depth > 0").select("depth", *[F.col(f"_{k}").alias(k) for k in keys], *measures)


def first_reason(rules: Sequence[tuple[str, Column]], last: bool = False) -> Column:
    """The reason of the first (or last) rule that fails, null if none does; a rule is (reason, what must hold), unknown counts as failed."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in (reversed(rules) if last else rules)]
    return F.coalesce(*failed, F.lit(None).cast("string"))


def agree_on_shared_view(members: DataFrame, views: DataFrame, group: str, member: str, view: str, entry: str) -> DataFrame:
    """agree_on_view() where views that several members report are written once: members (group, member, view), views (group, view, entry).

    A group agrees if each view that it reports has its members as entries, all of them, each once and nothing else. Members without a view don't count.
    """
    who = members.select(group, F.col(member).alias("_entry")).distinct()
    size = who.groupBy(group).agg(F.count("_entry").alias("members"))
    told = members.where(F.col(view).isNotNull()).select(group, view).distinct()
    said = views.select(group, view, F.col(entry).alias("_entry")).groupBy(group, view, "_entry").agg(F.count("*").alias("_n"))
    known = who.withColumn("_known", F.lit(True))
    each = told.join(said, [group, view], "left").join(known, [group, "_entry"], "left").groupBy(group, view).agg(F.sum("_n").alias("_said"), F.count("_known").alias("_met"))
    fits = each.join(size, group).groupBy(F.col(group).alias("_group")).agg(F.min((F.col("_said") == F.col("members")) & (F.col("_met") == F.col("members"))).alias("_fits"))
    return size.join(fits, F.col(group) == F.col("_group"), "left").select(group, "members", F.coalesce("_fits", F.lit(False)).alias("agreed"))


def overlap_counts(asked: DataFrame, others: DataFrame, by: Sequence[str], low: str, high: str, o_low: str, o_high: str) -> DataFrame:
    """(by, low, high, overlaps) of the distinct intervals asked: how many others of the same key have o_high >= low and o_low <= high; those with none are left out.

    Others that begin by an interval's end, less those that end before its begin: both are running sums over one sort by key and time, however many overlap.
    A range of the sort is summed by itself, then the ranges' sums are added up; what other keys add to both sums is the same. Intervals that end before they begin are compared one by one.
    """
    by, whole = list(by), reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by])
    a = asked.select(*by, F.col(low).alias("_low"), F.col(high).alias("_high")).where(whole & F.col("_low").isNotNull() & F.col("_high").isNotNull()).distinct()
    o = others.select(*by, F.col(o_low).alias("_from"), F.col(o_high).alias("_to")).where(whole & F.col("_from").isNotNull() & F.col("_to").isNotNull())
    o = o.groupBy(*by, "_from", "_to").agg(F.count("*").alias("_n"))
    good_a, good_o = F.col("_low") <= F.col("_high"), F.col("_from") <= F.col("_to")
    zero = F.lit(0).cast("long")
    mark = lambda df, at, place, begun, ended: df.select(*by, F.col(at).alias("_at"), F.lit(place).alias("_place"), begun.alias("_begun"), ended.alias("_ended"))
    fine = o.where(good_o)
    # at one time: begins, then what is asked, then ends
    marks = mark(fine, "_from", 0, F.col("_n"), zero).unionByName(mark(a.where(good_a), "_low", 1, zero, zero)).unionByName(mark(a.where(good_a), "_high", 1, zero, zero)).unionByName(mark(fine, "_to", 2, zero, F.col("_n")))
    order = [*by, "_at", "_place"]
    marks = marks.groupBy(*order).agg(F.sum("_begun").alias("_begun"), F.sum("_ended").alias("_ended"))
    dealt = settle(marks.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "marks")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    base = dealt.groupBy("_part").agg(F.sum("_begun").alias("_b"), F.sum("_ended").alias("_e")).select("_part", *[F.coalesce(F.sum(k).over(before), zero).alias(k) for k in ("_b", "_e")])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = dealt.select(*order, "_part", F.sum("_begun").over(inside).alias("_begun"), F.sum("_ended").over(inside).alias("_ended")).where("_place = 1").join(base, "_part")
    sums = settle(sums.select(*by, "_at", (F.col("_begun") + F.col("_b")).alias("_begun"), (F.col("_ended") + F.col("_e")).alias("_ended")), "sums")
    counted = a.where(good_a).join(sums.select(*by, F.col("_at").alias("_high"), "_begun"), [*by, "_high"]).join(sums.select(*by, F.col("_at").alias("_low"), "_ended"), [*by, "_low"])
    counted = counted.select(*by, "_low", "_high", (F.col("_begun") - F.col("_ended")).alias("overlaps"))
    met = (F.col("_to") >= F.col("_low")) & (F.col("_from") <= F.col("_high"))
    odd = a.join(o.where(~good_o), by).where(met).unionByName(a.where(~good_a).join(fine, by).where(met)).select(*by, "_low", "_high", F.col("_n").alias("overlaps"))
    both = counted.unionByName(odd).groupBy(*by, "_low", "_high").agg(F.sum("overlaps").alias("overlaps")).where("overlaps > 0")
    return both.withColumnsRenamed({"_low": low, "_high": high})


def agree_on_view(members: DataFrame, group: str, member: str, view: str) -> DataFrame:
    """(group, members, agreed): whether all of a group's members report one view, an array, and that is exactly the members."""
    told = members.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("members"), F.countDistinct(F.to_json(F.array_sort(view))).alias("_views"), F.min(F.array_sort(view)).alias("_view"))
    return told.select(group, F.size("members").cast("long").alias("members"), ((F.col("_views") == 1) & (F.col("_view") == F.col("members"))).alias("agreed"))
