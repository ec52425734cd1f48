"""Mixing sources to target weights by entropy balancing.

Among all rates r_d from 0 to the most copies that give each source the words of its target, the mix takes those
nearest to 1 in relative entropy: minimise sum u_d (r_d log r_d - r_d + 1) with sum size_d r_d = target,
where u_d = size_d + mean size of the source says how much a change of the document's rate counts.  The dual has one number
x for each source and tilts the rates exponentially, r_d = min(most, exp(x f_d)) with f_d = size_d / u_d: short documents stay
near one copy and longer ones give or take more, up to the box.  Its gradient and Hessian are sums over documents,
sum size_d r_d - target and sum size_d f_d r_d; Newton's steps, kept inside a bracket, are distributed aggregations,
over documents of equal size together, until all sources meet their targets.

Rates become whole copies by diffusing the
rounding error down the sizes within random groups (lots) of bounded length, so a source that
holds a third of all rows is many lots.  No lot keeps an error: documents that are large
beside a lot are rounded first, in lots of their own, and the source's other documents aim at what is
left of the target; what all lots leave then goes to the source's lots one after the other.
All of it is DataFrame functions; the driver sees totals and whether the steps are done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import n_words, settle

# The contract's weights, repeating by the source's place.
WEIGHTS = (3.0, 1.0, 2.0)
#: Newton's steps at most, and the share of a target that may be missed by them.
STEPS, NEAR = 60, 1e-9
GROUP = 1024
#: Rows of more words than this share of a lot's mean are rounded first.
LARGE = 0.125


def _before(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df with the sums of columns over all rows that are earlier in a total order, without sending all rows to one task.

    Rows are sorted by ranges; the one window without a partition is over one row for each range.
    """
    placed = settle(df.orderBy(*order).withColumn("tg_part", F.spark_partition_id()).withColumn("tg_row", F.monotonically_increasing_id()), name)
    parts = placed.groupBy("tg_part").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tg_part", *[earlier(F.col(k), W.orderBy("tg_part")).alias(f"tg_{k}") for k in sums])
    inside = W.partitionBy("tg_part").orderBy("tg_row")
    out = placed.join(F.broadcast(parts), "tg_part")  # one row for each range
    return out.select(*df.columns, *[(F.col(f"tg_{k}") + earlier(c, inside)).alias(k) for k, c in sums.items()])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n, source_size, target), one row per source (null is one).

    sizes has (source, size).  The words to share are total_share of all; weights go
    round by the sources' order, code points first, null last.  A target stops at most
    times its source's size and what is over is shared among the others by weight.
    With the sources sorted by room per weight those that stop are the first ones; running
    sums give the level at which the rest would share for each number of stops, which
    rises with each stop that is due and falls after, so the largest is the one that holds.
    """
    sums = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("source_size"))
    named = _before(sums, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, "sources")
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))).withColumn("room", most * F.col("source_size"))
    ranked = _before(named, [F.col("room") / F.col("weight"), F.col("source").asc_nulls_last()], {"rooms": F.col("room"), "weights": F.col("weight")}, "rooms")
    words, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = ranked.agg(F.max((F.lit(total_share * (words or 0)) - F.col("rooms")) / (F.lit(weight or 0.0) - F.col("weights")))).first()[0]
    return ranked.select("source", "n", "source_size", F.least(F.col("room"), F.col("weight") * F.lit(level or 0.0)).cast("double").alias("target"))


def _rate(size: Column, tilt: Column, mean: Column, most: float) -> Column:
    """The rate of a document; a null tilt is a source that needs all it can get (mean > 0) or nothing (mean null)."""
    f = size / (size + mean)
    return F.when(mean.isNull(), 0.0).when(tilt.isNull(), most).otherwise(F.least(F.exp(tilt * f), F.lit(most)))


def _total(value: Column) -> Column:
    """The sum of a column of doubles, to a millionth: in whole numbers, so that it doesn't depend on the order of the rows."""
    return F.sum((value * 1e6).cast("decimal(38,0)")).cast("double") / 1e6


def balance(sizes: DataFrame, targets: DataFrame, most: float = 2.0) -> DataFrame:
    """targets with (tilt, mean, expected): each source's dual optimum, its documents' mean size, and the words that its rates make.

    A target that is all of a source's room has no finite tilt (null), and a source without words or target no mean.
    """
    counted = settle(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("docs")).withColumnRenamed("source", "h_source"), "sizes")
    none = F.lit(None).cast("double")
    some = (F.col("source_size") > 0) & (F.col("target") > 0)
    free = some & (F.col("target") < most * F.col("source_size") * (1 - NEAR))
    state = targets.withColumn("mean", F.when(some, F.col("source_size") / F.col("n"))).withColumn("tilt", F.when(free, 0.0)).withColumn("low", none).withColumn("high", none)
    state = settle(state.withColumn("expected", F.when(free, none).otherwise(F.when(some, most * F.col("source_size")).otherwise(0.0))), "state")
    for _ in range(STEPS):
        at = counted.join(state.where("expected is null"), F.col("h_source").eqNullSafe(F.col("source")))
        f, r = F.col("size") / (F.col("size") + F.col("mean")), _rate(F.col("size"), F.col("tilt"), F.col("mean"), most)
        words = F.col("size") * F.col("docs")
        sums = at.groupBy("h_source").agg(_total(words * r).alias("got"), _total(F.when(r < most, words * f * r)).alias("slope"))
        now = state.join(sums, F.col("h_source").eqNullSafe(F.col("source")), "left").drop("h_source")
        over = F.col("got") - F.col("target")
        done = F.col("expected").isNotNull() | (F.abs(over) <= F.greatest(NEAR * F.col("target"), F.lit(2e-6)))
        now = now.withColumn("low", F.when(over < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(over > 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - over / F.col("slope")
        inside = F.coalesce(newton > F.col("low"), newton.isNotNull()) & F.coalesce(newton < F.col("high"), newton.isNotNull())
        halved = F.coalesce((F.col("low") + F.col("high")) / 2, 2 * F.col("low") + 1, 2 * F.col("high") - 1)
        step = F.when(inside, newton).otherwise(halved)
        now = now.withColumn("tilt", F.when(done, F.col("tilt")).otherwise(step)).withColumn("expected", F.when(done, F.coalesce("expected", "got")))
        state = settle(now.select(state.columns), "state")
        if state.where("expected is null").isEmpty():
            break
    return state.select(*targets.columns, "tilt", "mean", F.coalesce("expected", "target").alias("expected"))


def _copies(items: str, factor: str, most: int) -> Column:
    """Copies of each item (size, tie, id, rows, rate), largest size first: what rounding gives or takes is carried on to the next."""
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<int>").alias("copies"))

    def step(s: Column, x: Column) -> Column:
        unit = x["size"] * x["rows"]
        due = s["carry"] + F.least(x["rate"] * F.col(factor), F.lit(float(most))) * unit
        n = F.least(F.greatest(F.when(x["size"] > 0, F.floor(due / unit + 0.5)).otherwise(F.lit(0)), F.lit(0)), F.lit(most)).cast("int")
        return F.struct((due - n * unit).alias("carry"), F.concat(s["copies"], F.array(n)).alias("copies"))

    return F.aggregate(items, start, step, lambda s: s["copies"])


def _words(copies: Column | int) -> Column:
    """Words of all items, each as often as copies (an array beside items, or a number)."""
    times = F.transform("items", lambda _: F.lit(copies)) if isinstance(copies, int) else copies
    return F.aggregate(F.zip_with("items", times, lambda x, k: x["size"] * x["rows"] * k), F.lit(0).cast("long"), lambda s, x: s + x)


def _corrected(give: Column, most: int) -> Column:
    """Copies of items with as many words more (give > 0) or less as fit into give, the largest items first."""
    start = F.struct(F.abs(give).alias("left"), F.array().cast("array<int>").alias("copies"))

    def step(s: Column, x: Column) -> Column:
        unit, n = x["items"]["size"] * x["items"]["rows"], x["copies"]
        k = F.when(unit > 0, F.least(F.floor(s["left"] / unit), F.when(give > 0, most - n).otherwise(n))).otherwise(F.lit(0)).cast("int")
        return F.struct((s["left"] - k * unit).alias("left"), F.concat(s["copies"], F.array(F.when(give > 0, n + k).otherwise(n - k))).alias("copies"))

    return F.aggregate(F.arrays_zip("items", "copies"), start, step, lambda s: s["copies"])


def _lots(items: DataFrame, number: Column, most: int) -> DataFrame:
    """items dealt at random into so many lots a source, with their copies at their rates times factor."""
    tie = F.xxhash64(F.lit(17), "id", "size")
    dealt = items.withColumn("lot", F.pmod(F.xxhash64(F.lit(29), "id", "size"), number))
    lots = dealt.groupBy("source", "source_size", "target", "factor", "due", "lot").agg(F.sort_array(F.collect_list(F.struct("size", tie.alias("tie"), "id", "rows", "rate")), asc=False).alias("items"))
    made = settle(lots.withColumn("copies", _copies("items", "factor", most)), "lots")
    rated = F.aggregate("items", F.lit(0.0), lambda s, x: s + x["size"] * x["rows"] * x["rate"])
    return made.withColumn("words", _words(1)).withColumn("got", _words(F.col("copies"))).withColumn("rated", rated)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = 1.5, most: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, source_col, carry..., size, source_size, target, rate, copies, taken), one row per document row.

    size is the number of words (0 for a null or empty text), taken is copies * size,
    copies are 0 to most.  Rows that agree in id, source and size get the same copies; a
    null source is a source, a null id an id.  Documents without words get no copy.  What a
    source's copies take is as near to its target as its documents allow: off by less than one of the small ones.  The
    same rows give the same copies in whatever order they are read.  An empty table gives an empty one.
    carry: other columns of docs, such as the text, that go along.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"), *[F.col(c).alias(f"c_{c}") for c in carry])
    rows = settle(sized.select("id", "source", "size"), "sizes")
    aims = settle(balance(rows, source_targets(rows, weights, total_share, float(most)), float(most)).withColumnRenamed("source", "a_source"), "aims")
    items = settle(rows.groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "items")
    in_source = F.col("source").eqNullSafe(F.col("a_source"))
    n_lots = F.ceil(F.col("n") / GROUP)
    large = F.col("size") * F.col("rows") * n_lots > LARGE * F.col("source_size")  # fewer than n_lots / LARGE of them
    rate = F.when(F.col("size") > 0, _rate(F.col("size"), F.col("tilt"), F.col("mean"), float(most))).otherwise(0.0)
    first = _lots(items.join(aims, in_source).where(large).withColumn("rate", rate).withColumn("factor", F.lit(1.0)).withColumn("due", F.col("target")), F.ceil(n_lots / (LARGE * GROUP)), most)
    gone = first.groupBy(F.col("source").alias("g_source")).agg(_total(F.col("rated")).alias("g_rated"), F.sum("got").alias("g_got"))
    over = aims.join(gone, F.col("a_source").eqNullSafe(F.col("g_source")), "left").withColumn("due", F.col("target") - F.coalesce("g_got", F.lit(0)))
    left = F.col("expected") - F.coalesce("g_rated", F.lit(0.0))
    over = settle(over.withColumn("factor", F.when(left > 0, F.greatest(F.col("due") / left, F.lit(0.0))).otherwise(F.lit(0.0))), "aims")
    others = _lots(items.join(over, in_source).where(~large).withColumn("rate", rate), n_lots, most)
    # what the lots leave of due goes to the first lots that have room for it; a row here is a whole lot
    sums = others.groupBy(F.col("source").alias("s_source")).agg(F.sum("got").alias("s_got"))
    owed = others.select("source", "lot", "got", "words", "due").join(sums, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("owed", F.col("due") - F.col("s_got"))
    owed = owed.withColumn("room", F.when(F.col("owed") > 0, most * F.col("words") - F.col("got")).otherwise(F.col("got"))).select("source", "lot", "owed", "room")
    owed = _before(owed, [F.col("source").asc_nulls_last(), F.col("lot")], {"rooms": F.col("room")}, "owed")
    begin = owed.groupBy(F.col("source").alias("b_source")).agg(F.min("rooms").alias("b_rooms"))
    owed = owed.join(begin, F.col("source").eqNullSafe(F.col("b_source")))
    share = F.least(F.col("room").cast("double"), F.abs("owed") - (F.col("rooms") - F.col("b_rooms")))
    gifts = owed.withColumn("give", F.signum("owed") * F.greatest(share, F.lit(0.0))).where("abs(give) >= 1").select(F.col("source").alias("o_source"), F.col("lot").alias("o_lot"), "give")
    settled = others.join(gifts, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("lot") == F.col("o_lot")), "left")
    settled = settled.withColumn("copies", F.when(F.col("give").isNotNull(), _corrected(F.col("give"), most)).otherwise(F.col("copies")))
    lots = first.select("source", "source_size", "target", "items", "copies").unionByName(settled.select("source", "source_size", "target", "items", "copies"))
    each = lots.withColumn("x", F.explode(F.arrays_zip("items", "copies")))
    plan = each.select(F.col("x.items.id").alias("p_id"), F.col("source").alias("p_source"), F.col("x.items.size").alias("p_size"), "source_size", "target", F.col("x.items.rate").alias("rate"), "x.copies")
    same = F.col("id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))
    made = (sized if carry else rows).join(plan, same)
    return made.select(F.col("id").alias(id_col), F.col("source").alias(source_col), *[F.col(f"c_{c}").alias(c) for c in carry], "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
