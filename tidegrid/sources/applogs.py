"""Where a process keeps its settings and logs: roots from its arguments, and the log files that its logging settings declare."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import strings
from tidegrid.operators.graph import settle

# Arguments that name an application, and those that name setting files.
NAME_ARGUMENTS = ("-Dappid=", "-Dspring.application.name=", "--spring.application.name=")
LOCATION_ARGUMENTS = ("--spring.config.location=", "--spring.config.additional-location=", "-Dspring.config.location=")
REFERENCE = r"\$\{([\w.-]+)\}"
DATE_OR_INDEX = r"%d(?:\{[^}]*\})?|%i"
#: Substitutions of a path, folders that a root has at least, roots of a kind that are kept.
PASSES, LEAST_FOLDERS, MOST_ROOTS = 5, 3, 16


def normal_path(path: Column) -> Column:
    """A path without empty names, "." and ".."; a leading slash stays."""
    names = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    up = lambda kept, p: F.when(p == "..", F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)).otherwise(F.array_append(kept, p))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(names, F.array().cast("array<string>"), up), "/"))


def _safe(paths: Column, most: int) -> Column:
    """Normal absolute paths of at least three folders, each once, the first ones."""
    good = F.filter(paths, lambda p: p.startswith("/") & (F.size(F.filter(F.split(p, "/"), lambda x: x != "")) >= LEAST_FOLDERS))
    return F.slice(F.array_distinct(F.transform(good, normal_path)), F.lit(1), F.lit(most))


def _values(args: Column, prefixes: tuple[str, ...]) -> Column:
    """What stands behind the prefixes in the arguments that have one, in their order."""
    def rest(a: Column) -> Column:
        out = F.lit(None).cast("string")
        for p in prefixes:
            out = F.when(a.startswith(p), F.substring(a, F.lit(len(p) + 1), F.length(a))).otherwise(out)
        return out

    return F.filter(F.transform(args, rest), lambda v: v.isNotNull())


def file_roots(processes: DataFrame, keys: list[str], web_root: str = "/var/www/webapps", app_name: str | None = None) -> DataFrame:
    """(keys..., kind, place, root): folders of settings (kind config) and logs (log) of processes (keys, command, cwd), place is their order.

    From -Dcatalina.base, names of the application (arguments, the folder of its base, column app_name if given), the jar, locations of
    settings and the working folder. A root must be absolute and at least three folders deep; no general folder is named.
    """
    p = processes.withColumn("_args", strings.arguments(F.col("command"))).withColumn("_cwd", F.coalesce("cwd", F.lit("")))
    args, cwd = F.col("_args"), F.col("_cwd")
    many = lambda bases, *ends: F.flatten(F.transform(bases, lambda b: F.array(*[F.concat(b, F.lit(e)) for e in ends])))
    given = _values(args, NAME_ARGUMENTS)
    named = lambda names: F.transform(F.filter(names, lambda n: n.rlike(r"^[A-Za-z0-9_.-]+$") & ~n.isin(".", "..")), lambda n: F.concat(F.lit(f"{web_root}/"), n))
    bases = _values(args, ("-Dcatalina.base=",))
    jar = F.get(args, F.nullif(F.array_position(args, F.lit("-jar")), F.lit(0)).cast("int"))
    folder = F.when(jar.startswith("/"), F.regexp_replace(jar, "/[^/]*$", "")).otherwise(cwd)
    jars = F.when(jar.isNotNull(), F.array(folder)).otherwise(F.array().cast("array<string>"))
    located = F.transform(F.flatten(F.transform(_values(args, LOCATION_ARGUMENTS), lambda v: F.split(v, ","))), lambda v: F.regexp_replace(F.regexp_replace(v, "^optional:", ""), "^file:", ""))
    located = F.transform(F.filter(located, lambda v: v.startswith("/")), lambda v: F.when(strings.base_name(v).rlike(r".\.[^.]*$"), F.regexp_replace(v, "/[^/]*$", "")).otherwise(v))
    declared = _safe(F.concat(many(F.slice(bases, 1, 1), "/conf", "/webapps"), many(named(given), "/WEB-INF", "/config"), many(jars, "", "/config"), located), 6)
    at_home = F.when(cwd.startswith("/"), F.array(cwd)).otherwise(F.array().cast("array<string>"))
    above = F.when(cwd.startswith("/") & (strings.base_name(cwd) == "bin"), F.array(F.regexp_replace(cwd, "/[^/]*$", ""))).otherwise(F.array().cast("array<string>"))
    own = F.filter(F.transform(bases, lambda b: F.regexp_replace(strings.base_name(b), "^tomcat[_-]", "")), lambda n: ~n.isin("tomcat", "apache-tomcat"))
    extra = F.array(F.col(app_name)) if app_name else F.array().cast("array<string>")
    sites = named(F.filter(F.concat(given, own, F.filter(extra, lambda n: F.coalesce(n, F.lit("")) != "")), lambda n: ~n.rlike("^[0-9]+$")))
    config = F.concat(declared, many(at_home, "/WEB-INF", "/config", "/conf"), many(above, "/config", "/conf"), many(bases, "/webapps/ROOT/WEB-INF", "/webapps/ROOT/config"), many(sites, "/WEB-INF", "/config"))
    logs = F.concat(many(at_home, "/logs"), many(above, "/logs"), many(bases, "/logs", "/webapps/ROOT/logs"), many(sites, "/logs"), many(jars, "/logs"))
    found = F.array(F.struct(F.lit("config").alias("kind"), _safe(F.filter(config, lambda x: ~x.endswith("/webapps")), MOST_ROOTS).alias("roots")), F.struct(F.lit("log").alias("kind"), _safe(logs, MOST_ROOTS).alias("roots")))
    return p.select(*keys, F.explode(found).alias("x")).select(*keys, "x.kind", F.posexplode("x.roots").alias("place", "root"))


def logging_elements(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(properties (file, name, value), paths (file, path)) of XML logging settings (file, text); a damaged file has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for file, text in zip(f["file"], f["text"], strict=True):
                try:
                    root = ET.fromstring(text or "")
                except ET.ParseError:
                    continue
                for e in root.iter():
                    tag = e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
                    if tag == "property" and e.get("name") and e.get("value"):
                        rows.append((file, e.get("name"), e.get("value")))
                    elif tag in ("file", "fileNamePattern") and e.text:
                        rows.append((file, None, e.text.strip()))
            yield pd.DataFrame(rows, columns=["file", "name", "value"])

    made = settle(files.select(F.col("file").cast("string").alias("file"), "text").mapInPandas(run, "file string, name string, value string"), "elements")
    return made.where("name is not null"), made.where("name is null").select("file", F.col("value").alias("path")).distinct()


def substituted(properties: DataFrame, paths: DataFrame, overrides: DataFrame | None = None, passes: int = PASSES) -> DataFrame:
    """(file, path, resolved, rounds, unresolved, cycle): paths with ${names} replaced by their file's properties, pass by pass.

    A pass replaces all names of a path at once and what it puts in is looked at in the next; after passes
    of them it ends. A name with several values has none, unless overrides (file, name, value) gives it one. unresolved are
    the names that are left: without a value, or, with cycle, with one that more passes would have used.
    Every pass is a join on file and name over the paths that still name something, and writes these paths once: those that it
    didn't change have ended. Rows are dealt out before repeats go, as a large file may be few tasks.
    """
    one = properties.repartition("file", "name").groupBy("file", "name").agg(F.min("value").alias("value"), F.max("value").alias("other")).where("value = other").select("file", "name", "value")
    if overrides is not None:
        last = overrides.groupBy("file", "name").agg(F.max("value").alias("value"))
        one = one.join(last, ["file", "name"], "left_anti").unionByName(last)
    one = settle(one, "properties")
    names = lambda c: F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1))
    state = settle(paths.repartition("file", "path").select("file", "path", F.col("path").alias("resolved"), F.lit(0).alias("rounds")).distinct(), "paths")
    every = None
    for k in range(1, passes + 1):
        asked = state.select("file", "path", F.explode(F.array_distinct(names("resolved"))).alias("name")).join(one, ["file", "name"])
        known = asked.groupBy("file", "path").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("known"))
        put = F.transform(names("resolved"), lambda n: F.coalesce(F.try_element_at("known", n), F.concat(F.lit("${"), n, F.lit("}"))))
        mixed = F.zip_with(F.split("resolved", REFERENCE, -1), put, lambda text, value: F.concat(text, F.coalesce(value, F.lit(""))))
        changed = F.col("known").isNotNull()
        passed = state.join(known, ["file", "path"], "left").select("file", "path", F.when(changed, F.array_join(mixed, "")).otherwise(F.col("resolved")).alias("resolved"), F.when(changed, F.lit(k)).otherwise(F.col("rounds")).alias("rounds"), changed.alias("changed"))
        passed = settle(passed, "paths")
        ended, state = passed.where("not changed").drop("changed"), passed.where("changed").drop("changed")
        every = ended if every is None else every.unionByName(ended)
        if state.isEmpty():
            break
    every = state if every is None else every.unionByName(state)
    left = every.select("file", "path", F.explode(F.array_distinct(names("resolved"))).alias("name")).join(one.select("file", "name", F.lit(True).alias("has")), ["file", "name"], "left")
    left = left.groupBy("file", "path").agg(F.array_sort(F.collect_list("name")).alias("unresolved"), F.coalesce(F.max("has"), F.lit(False)).alias("cycle"))
    return every.join(left, ["file", "path"], "left").select("file", "path", "resolved", "rounds", F.coalesce("unresolved", F.array().cast("array<string>")).alias("unresolved"), F.coalesce("cycle", F.lit(False)).alias("cycle"))


def log_scopes(properties: DataFrame, paths: DataFrame, overrides: DataFrame | None = None, passes: int = PASSES) -> DataFrame:
    """(file, path, root, pattern, status, unresolved): folder and shell pattern of each declared log file.

    Dates (%d, %d{...}) and indexes (%i) of a file's name become *, other wildcards are taken literally. status: ok; cycle (names are
    left that have values), unresolved, relative, shallow (less than three folders), open (the name begins with a
    date or index, so any file would fit); root and pattern of ok ones only.
    """
    s = substituted(properties, paths, overrides, passes).withColumn("whole", normal_path(F.col("resolved")))
    name, root = strings.base_name(F.col("whole")), F.regexp_replace("whole", "/[^/]*$", "")
    literal = F.transform(F.split(name, DATE_OR_INDEX, -1), lambda x: F.regexp_replace(x, r"([*?\[])", "[$1]"))
    pattern = F.array_join(literal, "*")
    status = F.when(F.col("cycle"), "cycle").when(F.size("unresolved") > 0, "unresolved").when(~F.col("resolved").startswith("/"), "relative").when(F.size(F.filter(F.split(root, "/"), lambda x: x != "")) < LEAST_FOLDERS, "shallow").when(pattern.startswith("*") | (pattern == ""), "open").otherwise("ok")
    s = s.withColumn("status", status)
    ok = F.col("status") == "ok"
    return s.select("file", "path", F.when(ok, root).alias("root"), F.when(ok, pattern).alias("pattern"), "status", "unresolved")


def server_roots(servers: DataFrame) -> DataFrame:
    """(id, kind, place, root) of Tomcat settings (id, base, content): kind app, the folders of its hosts, and context, WEB-INF of their contexts.

    Only literal paths of at least three folders count; a base that isn't absolute has none, settings with a DTD or damaged ones only the usual folder.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, content in zip(f["id"], f["content"], strict=True):
                text = content or ""
                try:
                    hosts = [] if not text or "<!DOCTYPE" in text.upper() or "<!ENTITY" in text.upper() else list(ET.fromstring(text).iter("Host"))
                except ET.ParseError:
                    rows.append((i, -1, None, None))
                    continue
                for n, host in enumerate(hosts):
                    app = host.get("appBase", "webapps")
                    rows.append((i, n, app, None))
                    rows += [(i, n, app, x.get("docBase", "").strip()) for x in host.iter("Context") if x.get("docBase", "").strip()]
                if not hosts:
                    rows.append((i, 0, "webapps", None))
            yield pd.DataFrame(rows, columns=["id", "n", "app", "doc"])

    kept = servers.where(F.col("base").startswith("/"))
    found = kept.select(F.col("id").cast("string").alias("id"), "content").mapInPandas(run, "id string, n int, app string, doc string")
    found = found.where("n >= 0").join(kept.select(F.col("id").cast("string").alias("id"), "base"), "id")
    joined = lambda a, b: F.when(b.startswith("/"), b).otherwise(F.concat_ws("/", a, b))
    app = joined(F.col("base"), F.col("app"))
    literal = ~F.col("app").contains("${") & (F.col("app") != "") & ~F.coalesce("doc", F.lit("")).contains("${")
    path = normal_path(F.when(F.col("doc").isNull(), app).otherwise(joined(app, F.col("doc"))))
    deep = (F.size(F.filter(F.split(path, "/"), lambda p: p != "")) >= LEAST_FOLDERS) & path.startswith("/") & (F.col("doc").isNull() | ~F.lower(path).endswith(".war"))
    rows = found.where(literal).withColumn("path", path).where(deep).select("id", F.when(F.col("doc").isNull(), "app").otherwise("context").alias("kind"), "n", F.when(F.col("doc").isNull(), F.col("path")).otherwise(F.concat("path", F.lit("/WEB-INF"))).alias("root"))
    first = rows.groupBy("id", "kind", "root").agg(F.min("n").alias("n"))
    listed = first.groupBy("id", "kind").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "root"))), 1, MOST_ROOTS).alias("x"))  # the hosts of one server
    return listed.select("id", "kind", F.posexplode(F.transform("x", lambda x: x["root"])).alias("place", "root"))
