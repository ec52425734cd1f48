"""The deployment catalog: units and instances with continuity, observations and changes.

Imports are idempotent: a snapshot is known by its content's hash, an older one than the last is
historical and changes nothing.  Tables are DataFrames in, DataFrames out; the caller writes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegrid.functions import net, strings
from tidegrid.operators import relational as rel
from tidegrid.operators.graph import settle


def snapshot_hash(df: DataFrame) -> str:
    """A hash of a table's rows, whatever their order: the sum and the exclusive or of row hashes, and their number."""
    h = F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(df.columns)])
    r = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return f"{r['n']}:{r['s'] or 0}:{r['x'] or 0}"


def import_kind(runs: DataFrame, content: str, observed_at) -> str:
    """known (same content as the last applied run), historical (older than it), or new."""
    last = runs.where("applied").orderBy(F.desc("observed_at")).limit(1).collect()
    if last and last[0]["content"] == content:
        return "known"
    return "historical" if last and observed_at < last[0]["observed_at"] else "new"


def prepare(deployments: DataFrame) -> DataFrame:
    """Deployments of (app_id, env, deploy, ip, port, status, ...), repeated rows gone, with state and coverage.

    state: no-address, invalid-address, conflict (one deploy, address and port in several different
    rows) or ok.  coverage of an environment: COMPLETE if it has rows and all are ok or have no address.
    """
    keys = ["app_id", "env", "deploy", "ip", "port"]
    d = deployments.withColumn("fingerprint", strings.stable_key(*[F.col(c) for c in sorted(deployments.columns)])).dropDuplicates(["fingerprint"])
    n = F.count("*").over(W.partitionBy(*keys))
    state = F.when(F.coalesce("ip", F.lit("")) == "", "no-address").when(~net.is_ipv4(F.col("ip")), "invalid-address").when(n > 1, "conflict").otherwise("ok")
    d = d.withColumn("state", state)
    bad = F.max((~F.col("state").isin("ok", "no-address")).cast("int")).over(W.partitionBy("app_id", "env"))
    return d.withColumn("coverage", F.when(bad == 0, "COMPLETE").otherwise("PARTIAL"))


def match_members(records: DataFrame, bindings: DataFrame) -> DataFrame:
    """Records (app_id, env, deploy, ip, port) with the instance they continue.

    bindings: (instance_id, app_id, env, deploy, ip, port).  By all five; else the only binding and the only record
    of app, env and address; else the only ones of app, env and deploy; else new.  An
    instance is claimed once: what several records want is ambiguous and continues none.
    """
    scope = ["app_id", "env"]
    exact = bindings.select(*scope, "deploy", "ip", "port", F.col("instance_id").alias("candidate"))

    def only(field: str) -> DataFrame:
        one = lambda df: df.where(F.coalesce(F.col(field), F.lit("")) != "").groupBy(*scope, field).agg(F.count("*").alias("n"))
        alone = one(records).where("n = 1").select(*scope, field).join(one(bindings).where("n = 1").select(*scope, field), [*scope, field])
        return bindings.join(alone, [*scope, field], "left_semi").select(*scope, field, F.col("instance_id").alias("candidate"))

    made = rel.tiered_match(records, [("exact", exact, [*scope, "deploy", "ip", "port"]), ("address", only("ip"), [*scope, "ip"]), ("deploy", only("deploy"), [*scope, "deploy"])], scope)
    made = settle(made, "members")
    # claims are counted where there are any: new records have no candidate, and a first import has nothing else
    often = made.where("status = 'matched'").groupBy(F.col("candidate").alias("_claimed")).agg(F.count("*").alias("_wanted")).where("_wanted > 1")
    made = made.join(often, F.col("candidate") == F.col("_claimed"), "left")
    made = made.withColumn("basis", F.when((F.col("status") == "matched") & F.col("_claimed").isNotNull(), "ambiguous").when(F.col("status") == "matched", F.col("tier")).when(F.col("status") == "ambiguous", "ambiguous").otherwise("new"))
    fresh = F.sha2(F.concat_ws("|", *scope, "deploy", "ip", "port"), 256)
    return made.select(*records.columns, F.when(F.col("basis").isin("exact", "address", "deploy"), F.col("candidate")).otherwise(fresh).alias("instance_id"), "basis")


def changes(before: DataFrame, after: DataFrame, key: str, fields: list[str], complete: DataFrame | None = None, scope: list[str] | None = None, name: str | None = None) -> DataFrame:
    """(key, action, before, after): CREATE, UPDATE_OBSERVATION, RENAME (only name differs), NOT_OBSERVED.

    A missing record is only not observed where its scope's coverage is complete (complete has the
    scope's columns); without complete, everywhere.
    """
    js = lambda side: F.when(F.col(f"{side}.{key}").isNotNull(), F.to_json(F.struct(*[F.col(f"{side}.{f}").alias(f) for f in fields])))
    j = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"), "full")
    others = [f for f in fields if f != name]
    same = lambda fs: F.struct(*[F.col(f"b.{f}") for f in fs]).eqNullSafe(F.struct(*[F.col(f"a.{f}") for f in fs])) if fs else F.lit(True)
    action = F.when(F.col(f"b.{key}").isNull(), "CREATE").when(F.col(f"a.{key}").isNull(), "NOT_OBSERVED").when(same(fields), "NONE").when(same(others), "RENAME" if name else "UPDATE_OBSERVATION").otherwise("UPDATE_OBSERVATION")
    out = j.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), action.alias("action"), js("b").alias("before"), js("a").alias("after"), *[F.coalesce(F.col(f"a.{s}"), F.col(f"b.{s}")).alias(f"_{s}") for s in scope or []]).where("action <> 'NONE'")
    if complete is not None and scope:
        done = complete.select(*[F.col(s).alias(f"_{s}") for s in scope]).distinct().withColumn("_done", F.lit(True))
        out = out.join(done, [f"_{s}" for s in scope], "left").where("action <> 'NOT_OBSERVED' or _done")
    return out.select(key, "action", "before", "after")


def observations(records: DataFrame, key: str, fields: list[str], run_id: str, observed_at, previous: DataFrame | None = None) -> DataFrame:
    """(key, run_id, observed_at, semantic_hash, attributes) of records whose meaning isn't yet in previous (key, semantic_hash)."""
    made = records.select(key, F.lit(run_id).alias("run_id"), F.lit(observed_at).alias("observed_at"), F.to_json(F.struct(*sorted(fields))).alias("attributes")).withColumn("semantic_hash", F.sha2("attributes", 256))
    return made if previous is None else made.join(previous.select(key, "semantic_hash").distinct(), [key, "semantic_hash"], "left_anti")


def assign_once(items: DataFrame, path_col: str, rules: DataFrame) -> DataFrame:
    """Items with the one domain and system that rules (prefix, domain, system) give their paths; several are ambiguous, none unassigned."""
    parts = F.split(F.col(path_col), "/")
    asked = items.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    hit = asked.join(rules, F.col("_p") == F.col("prefix")).groupBy(*items.columns).agg(F.countDistinct("domain", "system").alias("n"), F.min(F.struct("domain", "system")).alias("x"))
    out = items.join(hit.select(*[F.col(c).alias(f"_{c}") for c in items.columns], "n", "x"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in items.columns], "left")
    status = F.when(F.col("n") == 1, "assigned").when(F.col("n") > 1, "ambiguous").otherwise("unassigned")
    return out.select(*items.columns, F.when(F.col("n") == 1, F.col("x.domain")).alias("domain"), F.when(F.col("n") == 1, F.col("x.system")).alias("system"), status.alias("status"))


def search(units: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Units with the text in one of the columns, whatever the case; wildcards, quotes and backslashes in the text are plain characters."""
    asked = F.lower(F.lit(text))
    return units.where(F.exists(F.array(*[F.col(c).cast("string") for c in columns]), lambda c: F.coalesce(F.contains(F.lower(c), asked), F.lit(False))))
