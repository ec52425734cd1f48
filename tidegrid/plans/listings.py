"""What listings filter, order, roll up and merge: repositories and their commits, databases, servers, processes, catalog rows, proxy files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegrid.functions import dates, net, strings
from tidegrid.operators import graph
from tidegrid.operators import relational as rel

c = F.col
#: Periods of a repository's last commit: months before the reference, newest bound exclusive unless it is the reference itself, oldest inclusive; months count in UTC.
COMMIT_MONTHS = {"month": (None, 1), "quarter": (None, 3), "half": (None, 6), "lastYear": (None, 12), "year": (6, 12), "twoYears": (12, 24), "older": (24, None)}
# The states of a collecting task, from the one that decides a source's state to the one that doesn't.
TASK_STATES = ("failed", "running", "done", "waiting")


# filters -----------------------------------------------------------------------------------------
def has_text(text: str, *columns: Column) -> Column:
    """Whether one of the columns contains the text, whatever the case; an empty text fits everything."""
    asked = text.strip().lower()
    return F.lit(True) if not asked else F.exists(F.array(*[v.cast("string") for v in columns]), lambda v: F.coalesce(F.contains(F.lower(v), F.lit(asked)), F.lit(False)))


def in_document(df: DataFrame, text: str) -> DataFrame:
    """Rows whose whole document, nested fields too, contains the text."""
    return df.where(has_text(text, F.to_json(F.struct(*df.columns))))


def pick(df: DataFrame, text: str, among: Sequence[str], **equal: str | None) -> DataFrame:
    """Rows with the text in one of the columns and, of the named columns, the values that are given; lists are searched by member."""
    kinds = dict(df.dtypes)
    each = [F.array_join(k, "\n") if kinds[k].startswith("array") else c(k) for k in among]
    tests = [c(k) == v for k, v in equal.items() if v]
    return df.where(reduce(lambda a, b: a & b, tests, has_text(text, *each)))


def business_tab(domain: Column, own: dict[str, str]) -> Column:
    """The tab of a business domain: one of its own, other without a domain, else group."""
    return strings.first_match([(F.coalesce(domain, F.lit("")).isin("", "未分类"), F.lit("other")), *[(domain == k, F.lit(v)) for k, v in own.items()]], F.lit("group"))


def log_class(path: Column, current: str, history: str, excluded: Sequence[str] = ()) -> Column:
    """current, history or none, by the file's name; none below an excluded folder (name patterns with *)."""
    folders = F.split(F.regexp_replace(path, "[^/]*$", ""), "/")
    below = [strings.glob_regex(x) for x in excluded]
    out = F.exists(folders, lambda f: reduce(lambda a, form: a | f.rlike(form), below, F.lit(False)))
    name = strings.base_name(path)
    return F.when(out, "none").when(name.rlike(f"^(?:{current})$"), "current").when(name.rlike(f"^(?:{history})$"), "history").otherwise("none")


def log_activity(df: DataFrame, text_col: str, *by: str) -> DataFrame:
    """(by..., lines, errors, requests) of log texts."""
    lines = df.select(*by, F.explode(F.split(F.regexp_replace(text_col, r"\n$", ""), "\n")).alias("line"))
    n = lambda form, name: F.count(F.when(c("line").rlike(form), 1)).alias(name)
    return lines.groupBy(*by).agg(F.count("*").alias("lines"), n("(?i)error|exception|fail", "errors"), n("(?i)(GET|POST|PUT|DELETE) ", "requests"))


# repositories ------------------------------------------------------------------------------------
def in_commit_period(last: Column, reference: Column, period: str) -> Column:
    """Whether the last commit lies in a period before the reference; unknown: there is none."""
    if period == "unknown":
        return last.isNull()
    if period == "week":
        return F.coalesce((last <= reference) & (last >= reference - F.make_dt_interval(days=F.lit(7))), F.lit(False))
    newest, oldest = COMMIT_MONTHS[period]
    fits = last <= reference
    if newest:
        fits = fits & (last < dates.months_before(reference, newest, None))
    if oldest:
        fits = fits & (last >= dates.months_before(reference, oldest, None))
    return F.coalesce(fits, F.lit(False))


def repository_fits(reference: Column, period: str = "", linked: bool | None = None) -> Column:
    """Of rows (apps, last, complete, recent): whether applications use a repository, and whether it was worked on.

    recent is the number of commits in the period by days; it decides where the history is complete, except for periods that have no end.
    """
    used = F.coalesce(F.size("apps"), F.lit(0)) > 0
    fits = F.lit(True) if linked is None else used if linked else ~used
    if not period:
        return fits
    by_last = in_commit_period(c("last"), reference, period)
    return fits & (by_last if period in ("unknown", "older") else F.when(c("complete"), F.coalesce(c("recent"), F.lit(0)) > 0).otherwise(by_last))


def filter_groups(groups: DataFrame, repositories: DataFrame, reference: Column, text: str = "", mode: str = "all", period: str = "", linked: bool | None = None) -> DataFrame:
    """(id, name, repositories) of the groups that a listing shows, with how many of their repositories fit.

    groups: (id, name, description, path, total, accessible, gap, unused, inventory_only).  mode: all, accessible, gap, unused, inventory_only or surplus (a negative gap).
    The text may be in the group or in its fitting repositories' names, addresses and applications.
    """
    state = {"unused": "codeup_only", "inventory_only": "devops_only"}.get(mode)
    fit = repositories.where(repository_fits(reference, period, linked) & (c("difference") == state if state else F.lit(True)))
    told = fit.groupBy("group_id").agg(F.count("*").alias("repositories"), F.max(has_text(text, c("name"), c("url"), F.array_join("apps", "\n"))).alias("hit"))
    joined = groups.join(told.withColumnRenamed("group_id", "id"), "id", "left").withColumn("repositories", F.coalesce("repositories", F.lit(0)))
    modes = {"all": F.lit(True), "accessible": c("accessible") > 0, "gap": c("gap") > 0, "unused": c("unused") > 0, "inventory_only": c("inventory_only") > 0, "surplus": c("gap") < 0}
    narrowed = c("repositories") > 0 if period or linked is not None else F.lit(True)
    return joined.where(narrowed & modes[mode] & (has_text(text, c("name"), c("description"), c("path")) | F.coalesce(c("hit"), F.lit(False)))).select("id", "name", "repositories")


def apps_by_repository(apps: DataFrame, repositories: DataFrame, text: str) -> DataFrame:
    """app_id of the applications (app_id, url) one of whose repositories (name, path, url, apps) has the text, or whose own address has it."""
    asked = net.repository_words(F.lit(text)) if "/" in text else F.lower(F.lit(text.strip()))
    has = lambda *v: F.exists(F.array(*v), lambda x: F.coalesce(F.contains(F.lower(x), asked), F.lit(False)))
    linked = repositories.where(has(c("name"), c("path"), net.repository_words(c("url")))).select(F.explode("apps").alias("app_id"))
    return linked.unionByName(apps.where(has(net.git_parts(c("url"))["path"], net.repository_words(c("url")))).select("app_id")).distinct()


# commits -----------------------------------------------------------------------------------------
def reachable_commits(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(repository, sha, at) of the commits that branch heads (repository, branch, sha) reach over all parents, each once however many branches have it.

    commits: (repository, sha, at, parents).  Follows parents to the end; there is no depth.
    """
    key = lambda sha: F.concat_ws("@", sha, "repository")
    links = commits.select(key(c("sha")).alias("src"), F.explode("parents").alias("p"), "repository").select("src", key(c("p")).alias("dst"))
    found = graph.reached(links, heads.select(key(c("sha")).alias("node")))
    return commits.withColumn("node", key(c("sha"))).join(found, "node").select("repository", "sha", "at").distinct()


def commits_by_day(commits: DataFrame, offset: str = dates.LOCAL_OFFSET) -> DataFrame:
    """(repository, day, commits) of unique commits, days in the local zone."""
    return commits.groupBy("repository", F.to_date(F.from_utc_timestamp("at", offset)).alias("day")).agg(F.countDistinct("sha").alias("commits"))


def commits_between(daily: DataFrame, start: Column, end: Column, last_day: bool = True) -> DataFrame:
    """(repository, commits) in the days from start to end, the last day included or not."""
    return daily.where((c("day") >= start) & ((c("day") <= end) if last_day else (c("day") < end))).groupBy("repository").agg(F.sum("commits").alias("commits"))


def latest_heads(heads: DataFrame) -> DataFrame:
    """The branch head of each repository that is latest, by time, then name."""
    return heads.groupBy("repository").agg(F.max_by(F.struct("branch", "sha", "at"), F.struct("at", "branch")).alias("h")).select("repository", "h.*")


# processes and ports -----------------------------------------------------------------------------
def collapse_workers(processes: DataFrame) -> DataFrame:
    """(ip, pid, name, ports, workers): the proxy workers of a host that aren't a container's are one row, of the least pid, with all their ports; workers is null elsewhere.

    processes: (ip, pid, name, command, kind, container, ports array<int>).
    """
    worker = (c("kind") == "Nginx") & F.lower("command").contains("worker process") & c("container").isNull()
    rows = processes.withColumn("worker", F.coalesce(worker, F.lit(False)))
    one = rows.where("worker").groupBy("ip").agg(F.min("pid").alias("pid"), F.min_by("name", "pid").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ports")))).alias("ports"), F.count("*").alias("workers"))
    return rows.where("not worker").select("ip", "pid", "name", "ports", F.lit(None).cast("long").alias("workers")).unionByName(one)


def application_ports(listeners: DataFrame, processes: DataFrame, unknown: str = "unknown process") -> DataFrame:
    """(ip, app, kind, port, candidates, confidence, basis, addresses, pids): listening sockets by application and port.

    listeners: (ip, pid, port, address, candidates array<int>, confidence, basis); processes: (ip, pid, app, kind).  A socket whose
    process is hidden or wasn't collected belongs to the unknown process, so that no port is lost.
    """
    joined = listeners.join(processes.select("ip", "pid", "app", c("kind").alias("p_kind")), ["ip", "pid"], "left")
    keys = [F.coalesce("app", F.lit(unknown)).alias("app"), "port", F.coalesce("candidates", F.array().cast("array<int>")).alias("candidates"), F.coalesce("confidence", F.lit("UNKNOWN")).alias("confidence"), F.coalesce("basis", F.lit("")).alias("basis")]
    made = joined.groupBy("ip", *keys).agg(F.coalesce(F.min("p_kind"), F.lit("unknown")).alias("kind"), F.array_sort(F.collect_set("address")).alias("addresses"), F.array_sort(F.collect_set("pid")).alias("pids"))
    return made.select("ip", "app", "kind", "port", "candidates", "confidence", "basis", "addresses", "pids")


def disambiguate(rows: DataFrame, by: Sequence[str], detail: str = "detail", pid: str = "pid") -> DataFrame:
    """Details of processes that occur more than once get their pid."""
    n = F.count(pid).over(W.partitionBy(*by, detail))
    return rows.withColumn(detail, F.when(c(pid).isNotNull() & (n > 1), F.concat(detail, F.lit(" (PID "), pid, F.lit(")"))).otherwise(c(detail)))


def temporal_ambiguity(flows: DataFrame, observations: DataFrame) -> DataFrame:
    """Flow rows with ambiguous_in_time: an observation of the other end that overlaps the flow's life overlaps another flow's of the same addresses and ports, too.

    observations: (local_ip, local_port, peer_ip, peer_port, obs_start, obs_end) at the peer.  Overlaps are counted both ways, never listed.
    """
    ends = ["local_ip", "local_port", "peer_ip", "peer_port"]
    o = observations.select(c("peer_ip").alias("local_ip"), c("peer_port").alias("local_port"), c("local_ip").alias("peer_ip"), c("local_port").alias("peer_port"), "obs_start", "obs_end").distinct()
    life = flows.select(*ends, "socket_id", "first_at", "last_at")
    many = rel.overlap_counts(o, life, ends, "obs_start", "obs_end", "first_at", "last_at").where("overlaps > 1")
    met = rel.overlap_counts(life, many, ends, "first_at", "last_at", "obs_start", "obs_end").drop("overlaps")
    hit = life.join(met, [*ends, "first_at", "last_at"], "left_semi").select(*[c(k).alias(f"_{k}") for k in (*ends, "socket_id")]).distinct().withColumn("_hit", F.lit(True))
    same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_{k}")) for k in (*ends, "socket_id")])
    return flows.join(hit, same, "left").select(*flows.columns, F.coalesce("_hit", F.lit(False)).alias("ambiguous_in_time"))


# merging and rolling up --------------------------------------------------------------------------
def merge_by_address(rows: DataFrame, address: str, id_col: str, order: str, flag: str, sticky: str) -> DataFrame:
    """One row an address: the first by order, with ids, repeats and a flag that has the sticky value if any row has it."""
    rest = [k for k in rows.columns if k not in (address, id_col, flag)]
    g = rows.groupBy(address).agg(F.min_by(F.struct(*rest, flag), order).alias("x"), F.array_sort(F.collect_list(F.struct(order, id_col))).alias("i"), F.max(c(flag) == sticky).alias("any"))
    return g.select(address, *[c(f"x.{k}").alias(k) for k in rest], F.when(c("any"), sticky).otherwise(c(f"x.{flag}")).alias(flag), c(f"i.{id_col}").alias("ids"), (F.size("i") - 1).alias("repeats"))


def source_states(tasks: DataFrame, source: str = "source", state: str = "state") -> DataFrame:
    """(source, state, tasks, finished): a source's state is that of its tasks that decides: one that failed, else one that runs, else done if all are, else waiting."""
    failed, running, done, waiting = TASK_STATES
    any_ = lambda s: F.max(F.coalesce(c(state) == s, F.lit(False)))
    every = F.min(F.coalesce(c(state) == done, F.lit(False)))
    told = F.when(any_(failed), failed).when(any_(running), running).when(every, done).otherwise(waiting)
    return tasks.groupBy(source).agg(told.alias("state"), F.count("*").alias("tasks"), F.count(F.when(c(state).isin(done, failed), 1)).alias("finished"))


def version_counts(t: dict[str, DataFrame], *names: str) -> DataFrame:
    """(source, rows) of a version's tables; a table that isn't there has null."""
    some = next(iter(t.values())).sparkSession
    counts = [t[n].agg(F.lit(n).alias("source"), F.count("*").alias("rows")) if n in t else some.range(1).select(F.lit(n).alias("source"), F.lit(None).cast("long").alias("rows")) for n in names]
    return reduce(DataFrame.unionByName, counts)


def same_name_hints(left: DataFrame, right: DataFrame, name: str, id_col: str) -> DataFrame:
    """(id_col, hints) of left rows: ids of right rows of the same name, whatever the case; candidates, never matches."""
    found = right.select(F.lower(name).alias("_n"), c(id_col).alias("_r")).groupBy("_n").agg(F.array_sort(F.collect_set("_r")).alias("hints"))
    return left.select(id_col, F.lower(name).alias("_n")).join(found, "_n", "left").select(id_col, F.coalesce("hints", F.array().cast(found.schema["hints"].dataType)).alias("hints"))


# catalog -----------------------------------------------------------------------------------------
def catalog_units(units: DataFrame, sources: DataFrame, systems: DataFrame, domains: DataFrame) -> DataFrame:
    """Units (id, code, name, system_id) that a source (unit_id, presence) states, with their system and domain where they have one.

    systems: (id, name, domain_id); domains: (id, name).
    """
    s = systems.select(c("id").alias("system_id"), c("name").alias("system_name"), "domain_id").join(domains.select(c("id").alias("domain_id"), c("name").alias("domain_name")), "domain_id", "left")
    stated = sources.select(c("unit_id").alias("id"), "presence")
    return units.join(stated, "id").join(s, "system_id", "left").select("id", "code", "name", "system_name", "domain_name", "presence")


def environment_counts(environments: DataFrame, instances: DataFrame, *by: str) -> DataFrame:
    """(by..., instances, servers) of the instances that are present: distinct ones, and distinct addresses, where a managed service counts by itself.

    environments: (environment_id, by...); instances: (id, environment_id, present, managed, ip).  An environment without instances has zeros.
    """
    there = instances.where("present").select("environment_id", "id", "managed", F.nullif("ip", F.lit("")).alias("ip"))
    host = F.countDistinct(F.when(~c("managed"), c("ip"))) + F.countDistinct(F.when(c("managed"), c("id")))
    return environments.join(there, "environment_id", "left").groupBy(*by).agg(F.countDistinct("id").alias("instances"), host.alias("servers"))


def application_domains(units: DataFrame) -> DataFrame:
    """(app_id, domain_name) of catalog units (code, domain_name), for export."""
    return units.where("code is not null").select(c("code").alias("app_id"), "domain_name")


# proxy files -------------------------------------------------------------------------------------
def server_names(files: DataFrame, domain: str) -> DataFrame:
    """(instance, path, names) of the server_name statements of proxy files (instance, path, content) that name a domain, comments aside."""
    plain = F.regexp_replace("content", r"(?m)\s+#.*$", "")
    said = files.select("instance", "path", F.explode(F.regexp_extract_all(plain, F.lit(r"(?:^|[;{}\n])\s*server_name\s+([^;{}]+);"), F.lit(1))).alias("s"))
    names = F.transform(F.split(F.trim("s"), r"\s+"), lambda n: F.regexp_replace(n, r"^['\"]|['\"]$", ""))
    fits = F.exists("names", lambda n: (n == domain) | (n.startswith("*.") & F.lit(domain).endswith(F.substr(n, F.lit(2)))))
    return said.select("instance", "path", names.alias("names")).where(fits)


def include_statements(files: DataFrame) -> DataFrame:
    """(instance, path, raw, pattern) of include statements; pattern is a path with * only, null where it can't be told (variables, other wildcards, steps up, a relative path without one main file).

    A relative path begins at the folder of the instance's only nginx.conf.
    """
    root = files.where(c("path").endswith("/nginx.conf")).groupBy("instance").agg(F.count("*").alias("roots"), F.min("path").alias("root"))
    prefix = F.when(c("roots") == 1, F.regexp_replace("root", "/[^/]*$", ""))
    lines = files.join(root, "instance", "left").select("instance", "path", prefix.alias("prefix"), F.explode(F.split("content", "\n")).alias("line"))
    raw = F.regexp_replace(F.regexp_extract("line", r"^\s*include\s+([^;#\s]+)\s*;", 1), r"^['\"]|['\"]$", "")
    said = lines.select("instance", "path", "prefix", raw.alias("raw")).where("raw <> ''")
    whole = F.when(c("raw").startswith("/"), c("raw")).otherwise(F.concat("prefix", F.lit("/"), "raw"))
    odd = c("raw").contains("$") | c("raw").rlike(r"[?\[\]{}]") | F.array_contains(F.split("raw", "/"), "..")
    return said.select("instance", "path", "raw", F.when(~odd, whole).alias("pattern"))


def include_edges(files: DataFrame) -> DataFrame:
    """(instance, src, dst) of files that include others, by name or by * within one folder level.

    A pattern without a * is a file's path. One with a * is compared with the files of its own folder and instance only; if the * is in a folder's name, with the files below the folder that it names before.
    """
    said = include_statements(files).where("pattern is not null").select("instance", c("path").alias("src"), "pattern").distinct()
    folder = lambda p: F.regexp_replace(p, "/[^/]*$", "")
    target = files.select("instance", c("path").alias("dst"), folder(c("path")).alias("folder"))
    form = F.concat(F.lit("^"), F.replace(F.regexp_replace("pattern", r"([.+^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit("[^/]*")), F.lit("$"))
    fits = F.regexp_like("dst", form)
    named = said.where(~c("pattern").contains("*")).join(target.withColumn("pattern", c("dst")), ["instance", "pattern"])
    near = said.where(c("pattern").contains("*")).withColumn("folder", folder(c("pattern")))
    plain = near.where(~c("folder").contains("*")).join(target, ["instance", "folder"]).where(fits)
    above = F.transform(F.filter(F.sequence(F.lit(1), F.length("dst")), lambda i: F.substring("dst", i, F.lit(1)) == "/"), lambda i: F.substring("dst", F.lit(1), i))
    below = target.drop("folder").withColumn("lead", F.explode(above))
    wild = near.where(c("folder").contains("*")).withColumn("lead", F.regexp_extract("pattern", r"^([^*]*/)", 1)).drop("folder").join(below, ["instance", "lead"]).where(fits)
    return named.select("instance", "src", "dst").unionByName(plain.select("instance", "src", "dst")).unionByName(wild.select("instance", "src", "dst")).distinct()


def included_files(files: DataFrame, starts: DataFrame) -> DataFrame:
    """(instance, start, path, distance): all files that the starts (instance, path) lead to."""
    key = lambda p: F.concat_ws("\n", "instance", p)
    edges = include_edges(files).select(key("src").alias("src"), key("dst").alias("dst"))
    part = lambda v, n: F.split(v, "\n")[n]
    return graph.closure(edges, starts.select(key("path").alias("node"))).select(part("start", 0).alias("instance"), part("start", 1).alias("start"), part("node", 1).alias("path"), "distance")


# orders ------------------------------------------------------------------------------------------
def resolved_order() -> list[Column]:
    """Resolved paths: those that end first, then strong confidence, few steps, end."""
    return [F.desc("terminal"), graph.rank_of(c("confidence")).desc(), F.size("steps").asc(), c("end_id").asc()]


def group_order() -> list[Column]:
    """Upstream groups: proxied ones, then external, then static ones, by name."""
    return [strings.first_match([(c("kind") == k, F.lit(i)) for i, k in enumerate(("proxy", "external", "static"))], F.lit(3)).asc(), c("upstream").asc()]


def time_order(column: str, descending: bool = True) -> Column:
    """By time, either way; what has none is last in both."""
    value = F.nullif(c(column), F.lit(""))
    return value.desc_nulls_last() if descending else value.asc_nulls_last()


def numeric_order(value: Column) -> Column:
    """Sort key of texts that hold numbers, such as ports and tree keys: numbers by size, before other text."""
    parts = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(p.try_cast("decimal(38,0)").isNull().alias("text"), p.try_cast("decimal(38,0)").alias("number"), p.alias("raw")))


def size_order(size: str, label: str) -> list[Column]:
    """Large ones first, then by label."""
    return [F.desc(size), F.asc(label)]


def longest_running() -> list[Column]:
    """Processes: the longest running first, then by address, pid and id."""
    return [F.desc_nulls_last("seconds"), net.ip_order(c("ip")).asc(), F.asc("pid"), F.asc("id")]


def ordered_associations(column: str) -> Column:
    """An array of associations (app_name, app_id, env, port, ...) by these five in this order, ports by number."""
    key = lambda x: F.struct(x["app_name"].alias("a"), x["env"].alias("b"), numeric_order(x["port"]).alias("c"), x["repository"].alias("d"), x["app_id"].alias("e"), x.alias("x"))
    return F.transform(F.array_sort(F.transform(c(column), key)), lambda k: k["x"])
