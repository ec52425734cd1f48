"""Servers as operators see them: state of each address, its size, what runs there, and what an application's servers say of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions import dates, net, strings
from tidegrid.plans import reports

c = F.col
NOT_COLLECTED, CAN, CANNOT = "not_collected", "can_login", "cannot_login"
# Process types as the list of servers names them; types not listed keep their name.
LISTED_TYPES = {"Kafka": "MQ", "RabbitMQ": "MQ", "RocketMQ": "MQ", "ActiveMQ": "MQ", "Java Jar": "Java", "Other Java": "Java"}
TOMCAT_FOLDER = r"(?i)(/[\w./~-]*apache-tomcat[\w.-]*)"


def _specs(t: dict[str, DataFrame]) -> DataFrame:
    """(ip, spec_login, spec_cpu, spec_mb): a record may name several addresses."""
    return t["specs"].select(F.explode(net.address_list(c("ip"))).alias("ip"), c("loginStatus").alias("spec_login"), c("cpu").alias("spec_cpu"), c("memoryMB").alias("spec_mb")).groupBy("ip").agg(*[F.max(k).alias(k) for k in ("spec_login", "spec_cpu", "spec_mb")])


def server_states(t: dict[str, DataFrame], ips: DataFrame) -> DataFrame:
    """(ip, state, spec) of addresses (column ip).

    An address that no asset has is not collected; else what the machine's record says of logging in counts, a
    record of before that was kept by its cores, then the inspection.  spec: cores and memory, of the record with the usual memory size,
    else of the cloud machine; empty if neither is known.
    """
    machine = t["compute"].select(F.explode(F.concat(F.coalesce("privateIps", F.array()), F.coalesce("publicIps", F.array()))).alias("ip"), c("cpu").alias("m_cpu"), c("memoryGiB").alias("m_gib")).groupBy("ip").agg(F.max("m_cpu").alias("m_cpu"), F.max("m_gib").alias("m_gib"))
    asset = t["assets"].where("ip <> ''").groupBy("ip").agg(F.max(F.coalesce(c("loginStatus") == CAN, F.lit(False))).alias("seen"))
    x = ips.select("ip").distinct().join(asset, "ip", "left").join(_specs(t), "ip", "left").join(machine, "ip", "left")
    state = F.when(c("seen").isNull(), NOT_COLLECTED).when(c("spec_login").isin(CAN, CANNOT), c("spec_login")).when(c("spec_login").isNull() & (c("spec_cpu") > 0), CAN).when(c("seen"), CAN).otherwise(CANNOT)
    size = lambda cpu, gib: F.concat(cpu.cast("string"), F.lit("C "), gib, F.lit("G"))
    whole = F.when(c("m_gib") == F.floor("m_gib"), F.floor("m_gib").cast("string")).otherwise(c("m_gib").cast("string"))
    spec = F.when(c("spec_cpu") > 0, F.when(c("spec_mb") > 0, size(c("spec_cpu"), strings.nominal_memory_gib(c("spec_mb")).cast("string"))).otherwise(F.concat(c("spec_cpu").cast("string"), F.lit("C memory unknown")))).when(c("m_cpu") > 0, size(c("m_cpu"), whole)).otherwise("")
    return x.select("ip", state.alias("state"), spec.alias("spec"))


def _placed(t: dict[str, DataFrame]) -> DataFrame:
    return t["deployments"].where("ip <> ''").select("app_id", "app_name", "env", "ip").distinct()


def _matches(t: dict[str, DataFrame]) -> DataFrame:
    """(app_id, ip, pid, startedAt): the processes on an application's servers that are its own."""
    p = t["processes"].where(~F.coalesce("system", F.lit(False))).select(c("asset_ip").alias("ip"), "pid", "name", "command", "startedAt").withColumn("kind", strings.process_type(c("name"), c("command")))
    apps = _placed(t).select("app_id", "app_name", "ip").distinct()
    return apps.join(p, "ip").where(reports.matches_process(c("app_name"), c("name"), c("kind"), c("command"))).select("app_id", "ip", "pid", "startedAt")


def _running(t: dict[str, DataFrame]) -> DataFrame:
    """(app_id, ip, startedAt): the servers of an application where it has a process, and when the one with the least pid started.

    What decides is a server's distinct application names and its distinct processes, so a crowded server's applications and processes never meet one by one.
    """
    p = t["processes"].where(~F.coalesce("system", F.lit(False))).groupBy(c("asset_ip").alias("ip"), "name", "command").agg(F.min(F.when(c("pid").isNotNull(), F.struct("pid", "startedAt"))).alias("first"))
    p = p.withColumn("kind", strings.process_type(c("name"), c("command")))
    apps = _placed(t).select("app_id", "app_name", "ip").distinct()
    own = apps.select("app_name", "ip").distinct().join(p, "ip").where(reports.matches_process(c("app_name"), c("name"), c("kind"), c("command")))
    own = own.groupBy("app_name", "ip").agg(F.min("first").alias("first"))
    found = apps.join(own, ["app_name", "ip"]).groupBy("app_id", "ip").agg(F.min("first").alias("first"))
    return found.select("app_id", "ip", c("first.startedAt").alias("startedAt"))


def process_status(t: dict[str, DataFrame]) -> DataFrame:
    """(app_id, unmatched, not_collected): whether any server of an application lacks its process, or isn't collected."""
    asset = t["assets"].where("ip <> ''").select("ip").distinct().withColumn("known", F.lit(True))
    has = _running(t).select("app_id", "ip").withColumn("has", F.lit(True))
    x = _placed(t).join(asset, "ip", "left").join(has, ["app_id", "ip"], "left")
    made = x.groupBy("app_id").agg(F.max(c("known").isNotNull() & c("has").isNull()).alias("unmatched"), F.max(c("known").isNull()).alias("not_collected"))
    return t["apps"].select(c("id").alias("app_id")).join(made, "app_id", "left").na.fill(False)


def environment_verdicts(t: dict[str, DataFrame]) -> DataFrame:
    """(app_id, env, not_collected, cannot_login, can_login, matched, unmatched) over the servers of each environment; only a server that can be logged in to proves anything."""
    placed = _placed(t)
    has = _running(t).select("app_id", "ip").withColumn("has", F.lit(True))
    x = placed.join(server_states(t, placed), "ip").join(has, ["app_id", "ip"], "left")
    on = lambda test, name: F.max(test).alias(name)
    can = c("state") == CAN
    return x.groupBy("app_id", "env").agg(on(c("state") == NOT_COLLECTED, NOT_COLLECTED), on(c("state") == CANNOT, CANNOT), on(can, CAN), on(can & c("has").isNotNull(), "matched"), on(can & c("has").isNull(), "unmatched"))


def latest_deployment(t: dict[str, DataFrame], webapps: DataFrame) -> DataFrame:
    """(app_id, env, at): the latest start of an application's process, or change of its folder (ip, name, mtime), on its servers; null without either."""
    started = _running(t).select("app_id", "ip", dates.parse_time(c("startedAt")).alias("at"))
    apps = _placed(t).select("app_id", "ip", strings.squeezed(c("app_name")).alias("k")).distinct()
    changed = apps.join(webapps.select("ip", strings.squeezed(c("name")).alias("k"), c("mtime").alias("at")), ["ip", "k"]).select("app_id", "ip", "at")
    seen = started.unionByName(changed).groupBy("app_id", "ip").agg(F.max("at").alias("at"))
    return _placed(t).join(seen, ["app_id", "ip"], "left").groupBy("app_id", "env").agg(F.max("at").alias("at"))


def summary_rows(t: dict[str, DataFrame], ips: DataFrame) -> DataFrame:
    """(ip, hostname, environments, managed, spec, ports, categories), one row an address; what runs there only where it can be logged in to."""
    host = t["assets"].where("ip <> ''").groupBy("ip").agg(F.min(F.nullif(F.trim("hostname"), F.lit(""))).alias("hostname"))
    envs = _placed(t).groupBy("ip").agg(F.array_sort(F.collect_set("env")).alias("environments"))
    kinds = reports.process_categories(t["processes"]).groupBy("ip").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("categories"))
    x = server_states(t, ips).join(host, "ip", "left").join(envs, "ip", "left").join(reports.listening_ports(t), "ip", "left").join(kinds, "ip", "left")
    can = c("state") == CAN
    return x.select("ip", F.coalesce("hostname", "ip").alias("hostname"), F.coalesce("environments", F.array().cast("array<string>")).alias("environments"), (c("state") != NOT_COLLECTED).alias("managed"), "spec", F.when(can, c("ports")).alias("ports"), F.when(can, c("categories")).alias("categories"))


def _tail(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "")


def process_detail(name: Column, command: Column, listed: Column, pid: Column) -> Column:
    """What tells a process from others: its jar, server folder or script, else its name and pid."""
    args = strings.arguments(command)
    option = lambda key: F.get(F.transform(F.filter(args, lambda a: a.startswith(key)), lambda a: F.substr(a, F.lit(len(key) + 1))), F.lit(0))
    with_pid = lambda text: F.concat(text, F.lit(" (PID "), pid.cast("string"), F.lit(")"))
    folder = F.coalesce(option("-Dcatalina.base="), option("-Dcatalina.home="), F.nullif(F.regexp_extract(F.coalesce(command, F.lit("")), TOMCAT_FOLDER, 1), F.lit("")))
    plain = F.filter(F.slice(args, F.lit(2), F.greatest(F.size(args), F.lit(1))), lambda a: ~a.startswith("-"))
    script = F.coalesce(F.get(F.filter(plain, lambda a: a.rlike(r"(?i)\.[cm]?js$")), F.lit(0)), F.get(plain, F.lit(0)))
    return F.when(listed == "Java", F.coalesce(strings.jar_name(command), with_pid(F.lit("java")))).when(listed == "Tomcat", F.coalesce(_tail(folder), with_pid(F.lit("Tomcat")))).when(listed == "Node", with_pid(F.coalesce(script, F.lit("node")))).otherwise(with_pid(F.coalesce(name, F.lit(""))))


def managed_rows(t: dict[str, DataFrame], ips: DataFrame, webapps: DataFrame, proxy_files: DataFrame) -> DataFrame:
    """(ip, kind, type, detail, app_id, pid): one row a process, folder or proxy file of each address, or one that says why there is none.

    kind: unmanaged, unreachable, process, webapp, nginx or empty.  A proxy's processes are stood for by its
    files (ip, path), or without any by its masters, else its first process.  Shared middleware and system
    processes belong to no application; others to the first by id that they match.  Details that
    several processes of a server share get the pid added.  webapps: (ip, name).
    """
    state = server_states(t, ips)
    can = state.where(c("state") == CAN).select("ip")
    none = F.lit(None).cast("string")
    row = lambda df, kind, type_, detail, app=none, pid=F.lit(None).cast("int"): df.select("ip", F.lit(kind).alias("kind"), type_.alias("type"), detail.alias("detail"), app.alias("app_id"), pid.alias("pid"))
    p = t["processes"].select(c("asset_ip").alias("ip"), "pid", "name", "command", F.coalesce("system", F.lit(False)).alias("system")).join(can, "ip")
    p = p.withColumn("own", strings.process_type(c("name"), c("command"), c("system")))
    mq = c("own").isin("Java Jar", "Other Java", "Other") & F.lower("command").rlike(r"rabbitmq|activemq|org\.apache\.rocketmq|\brocketmq\b")
    names = F.create_map(*[F.lit(v) for pair in LISTED_TYPES.items() for v in pair])
    p = p.withColumn("listed", F.when(mq, "MQ").otherwise(F.coalesce(F.try_element_at(names, c("own")), c("own"))))
    p = p.withColumn("shared", mq | strings.is_middleware(c("own")) | c("own").isin("System", "Nginx"))
    owner = _matches(t).groupBy("ip", "pid").agg(F.min("app_id").alias("app_id"))
    work = p.where("listed <> 'Nginx'").join(owner, ["ip", "pid"], "left").withColumn("detail", process_detail(c("name"), c("command"), c("listed"), c("pid")))
    twice = F.count("*").over(W.partitionBy("ip", "detail")) > 1
    work = work.withColumn("detail", F.when(twice, F.concat("detail", F.lit(" (PID "), c("pid").cast("string"), F.lit(")"))).otherwise(c("detail")))
    apps = _placed(t).select("ip", "app_id", strings.squeezed(c("app_name")).alias("k")).groupBy("ip", "k").agg(F.min("app_id").alias("app_id"))
    folders = webapps.select("ip", "name", strings.squeezed(c("name")).alias("k")).distinct().join(can, "ip").join(apps, ["ip", "k"], "left")
    files = proxy_files.select("ip", "path").distinct().join(can, "ip")
    bare = p.where("listed = 'Nginx'").join(files.select("ip").distinct(), "ip", "left_anti").withColumn("master", F.lower("command").contains("master process"))
    any_master = F.max("master").over(W.partitionBy("ip"))
    least = F.min("pid").over(W.partitionBy("ip"))
    bare = bare.withColumn("any", any_master).withColumn("least", least).where(c("master") | (~c("any") & (c("pid") == c("least"))))
    rows = row(work, "process", c("listed"), c("detail"), F.when(~c("shared"), c("app_id")), c("pid"))
    for more in (row(folders, "webapp", F.lit("folder"), c("name"), c("app_id")), row(files, "nginx", F.lit("Nginx"), c("path")), row(bare, "nginx", F.lit("Nginx"), F.concat(F.lit("nginx master (PID "), c("pid").cast("string"), F.lit("), files not collected")))):
        rows = rows.unionByName(more)
    empty = can.join(rows.select("ip").distinct(), "ip", "left_anti")
    rows = rows.unionByName(row(empty, "empty", none, none)).unionByName(row(state.where(c("state") == NOT_COLLECTED), "unmanaged", none, none)).unionByName(row(state.where(c("state") == CANNOT), "unreachable", none, none))
    return rows
