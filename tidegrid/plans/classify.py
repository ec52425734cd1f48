"""Classifications by ordered rules, and the exports and lists that are made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import net, strings
from tidegrid.functions.strings import first_match

c = F.col
# Types by a container image's name; services by a setting's key; groups of types in exports.
IMAGES = {
    "rabbitmq": "RabbitMQ", "elasticsearch": "Elasticsearch", "kibana": "Kibana", "zookeeper": "ZooKeeper", "nacos": "Nacos", "nacos-server": "Nacos", "kong": "Kong", "canal-server": "Canal", "kafka": "Kafka", "redis": "Redis", "mysql": "MySQL", "mariadb": "MySQL",
    "postgres": "PostgreSQL", "mongo": "MongoDB", "mongodb": "MongoDB", "rocketmq": "RocketMQ", "activemq": "ActiveMQ",
}
SERVICES = (("MySQL", "mysql"), ("PostgreSQL", "postgres"), ("Redis", "redis"), ("Elasticsearch", r"elasticsearch|\bes\b"), ("Kafka", "kafka"), ("RabbitMQ", "rabbit|amqp"), ("RocketMQ", "rocket"), ("ActiveMQ", "activemq"))
QUEUES = ("Kafka", "RabbitMQ", "RocketMQ", "ActiveMQ")
UNSURE_IN_CONTAINER = ("Other", "Other Java", "System", "Java Jar", "Python", "Node")


def container_type(name: Column, command: Column, basis: Column, container_command: Column, image: Column) -> Column:
    """(type, basis) of a process; an unclear one in a container (basis init or proxy) by the container's command without its entry script, else by its image."""
    own = strings.process_type(name, command)
    run = F.regexp_replace(F.coalesce(container_command, F.lit("")), r"^(?i)\S*docker-entrypoint(?:\.sh)?\s+(?=\S)", "")
    by_command = strings.process_type(F.lit(""), run)
    short = F.lower(F.split_part(strings.base_name(F.split_part(F.coalesce(image, F.lit("")), F.lit("@"), F.lit(1))), F.lit(":"), F.lit(1)))
    by_image = F.try_element_at(F.create_map(*[F.lit(x) for k, v in IMAGES.items() for x in (k, v)]), short)
    inside = F.coalesce(basis.isin("init", "proxy"), F.lit(False)) & own.isin("Other", "Other Java")
    found = F.when(~inside, None).when(~by_command.isin(*UNSURE_IN_CONTAINER), F.struct(by_command.alias("type"), F.lit("container-command").alias("basis"))).when(by_image.isNotNull(), F.struct(by_image.alias("type"), F.lit("container-image").alias("basis")))
    return F.coalesce(found, F.struct(own.alias("type"), F.lit(None).cast("string").alias("basis")))


def export_class(kind: Column, command: Column) -> Column:
    """(type, middleware) of a process type in exports: message queues together, jars and other Java as Java."""
    low = F.lower(F.coalesce(command, F.lit("")))
    java, queue = kind.isin("Java Jar", "Other Java"), low.rlike(r"\b(org\.apache\.rocketmq|rocketmq|rabbitmq|activemq)\b")
    other = ~kind.isin("System", "Tomcat", "Nginx", *strings.MIDDLEWARE, "Node", "Python") & ~java
    made = F.when(kind.isin(*QUEUES) | (java & queue) | (other & low.contains("rabbitmq")), "MQ").when(java, "Java").when(kind == "Kibana", "Other").when(other, "Other").otherwise(kind)
    return F.struct(made.alias("type"), (made.isin("System", "Nginx", "MQ") | (kind.isin(*strings.MIDDLEWARE) & (kind != "Kibana"))).alias("middleware"))


def process_detail(type_: Column, name: Column, command: Column, pid: Column) -> Column:
    """What an export shows of a process: its jar, Tomcat's folder, Node's script, or its name; with the PID where that isn't enough."""
    numbered = lambda s: F.concat(s, F.lit(" (PID "), pid.cast("string"), F.lit(")"))
    args = strings.arguments(command)
    base = lambda key: F.get(F.transform(F.filter(args, lambda a: a.startswith(key)), lambda a: F.regexp_replace(F.substring(a, F.lit(len(key) + 1), F.length(a)), "/+$", "")), F.lit(0))
    home = F.coalesce(base("-Dcatalina.base="), base("-Dcatalina.home="), F.nullif(F.regexp_replace(F.regexp_extract(command, r"(?i)(/[\w./~-]*apache-tomcat[\w.-]*)", 1), "/+$", ""), F.lit("")))
    plain = F.filter(F.slice(args, F.lit(2), F.greatest(F.size(args), F.lit(1))), lambda a: ~a.startswith("-"))
    script = F.coalesce(F.get(F.filter(plain, lambda a: a.rlike(r"(?i)\.[cm]?js$")), F.lit(0)), F.get(plain, F.lit(0)))
    return F.when(type_ == "Java", F.coalesce(strings.jar_name(command), numbered(F.lit("java")))).when(type_ == "Tomcat", F.coalesce(home, numbered(F.lit("Tomcat")))).when(type_ == "Node", numbered(F.coalesce(script, F.lit("node")))).otherwise(numbered(name))


def mapper_file(path: Column, head: Column) -> Column:
    """Whether a file is a mapper: XML by its folder or name, or by its first 64 KB."""
    low = F.lower(F.coalesce(path, F.lit("")))
    named = low.endswith(".xml") & (low.rlike(r"(^|/)mappers?/") | low.endswith("mapper.xml"))
    return named | F.coalesce(F.substring(head, 1, 65536).rlike(r"(?i)<!DOCTYPE\s+mapper\b|<mapper\s+namespace\s*="), F.lit(False))


def dns_owner(host: Column, zone: Column) -> Column:
    """A record's name: @ is the zone, a host that ends with the zone is whole; null without a host."""
    h = F.regexp_replace(F.lower(F.trim(F.coalesce(host, F.lit("")))), r"\.+$", "")
    return F.when(h == "", None).when(h == "@", zone).when((h == zone) | h.endswith(F.concat(F.lit("."), zone)), h).otherwise(F.concat_ws(".", h, zone))


def dns_status(raw: Column) -> Column:
    return F.when(raw == "ENABLE", "active").when(raw == "DISABLE", "paused").otherwise("unknown")


def service_of(key: Column, scheme: Column) -> Column:
    """The service that a setting's key or address scheme names; unknown if none."""
    value = F.lower(F.concat_ws(" ", key, scheme))
    return first_match([(value.rlike(p), F.lit(name)) for name, p in SERVICES], F.lit("unknown"))


def snapshot_time(snapshot: Column, style: str = "second", fallback: str = "") -> Column:
    """The time in a version's id (20240131-235959-..., with any prefix), as date, minute or second."""
    form = r"(?:^|-)(\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})(\d{2})-\d+$"
    ends = {"date": "$1-$2-$3", "minute": "$1-$2-$3 $4:$5", "second": "$1-$2-$3 $4:$5:$6"}
    part = F.regexp_extract(snapshot, form, 0)
    return F.when(F.coalesce(part, F.lit("")) == "", fallback).otherwise(F.regexp_replace(part, form, ends[style]))


def access_status(body: Column) -> Column:
    """(access, reason, stop) of a code host's JSON answer: yes, no or unknown; stop if the login no longer holds."""
    at = lambda path: F.coalesce(F.get_json_object(body, path), F.lit(""))
    code = F.upper(at("$.errorCode"))
    rules = [
        (F.get_json_object(body, "$").isNull() | ~F.trim(body).startswith("{"), ("unknown", "no JSON object", False)), (code.isin("UNAUTHORIZED", "NOT_LOGIN", "LOGIN_REQUIRED", "401") | F.lower(at("$.errorAction")).contains("login"), ("unknown", "login", True)),
        (code.isin("FORBIDDEN", "ACCESS_DENIED", "403"), ("no", "denied", False)), (code.isin("NOT_FOUND", "PROJECT_NOT_FOUND", "404"), ("no", "missing", False)),
        ((at("$.success") == "true") & (F.upper(at("$.result.pathResource.type")) == "PROJECT") & ~at("$.result.pathResource.id").isin("", "0", "false") & (at("$.result.assetsName") != "error"), ("yes", "found", False)),
    ]
    say = lambda x: F.struct(F.lit(x[0]).alias("access"), F.lit(x[1]).alias("reason"), F.lit(x[2]).alias("stop"))
    return first_match([(F.coalesce(cond, F.lit(False)), say(x)) for cond, x in rules], say(("unknown", "no clear result", False)))


def unique_by(items: Column, key: str) -> Column:
    """Structs with the same key once: the last one's fields at the first one's place."""
    keys = F.array_distinct(F.transform(items, lambda x: x[key]))
    return F.transform(keys, lambda k: F.element_at(F.filter(items, lambda x: x[key].eqNullSafe(k)), -1))


def databases(raw: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Managed databases of (id, alias, host, port, db_type, sell_common, sell_stable, sell_trust): (id, name, address, type, control, login).

    control: COMMON before STABLE before NONE_CONTROL; login: automatic for COMMON or trusted ones, else manual.
    """
    flag = lambda k: F.coalesce(c(k), F.lit(False))
    control = F.when(flag("sell_common"), "COMMON").when(flag("sell_stable"), "STABLE").otherwise("NONE_CONTROL")
    known = F.try_element_at(F.create_map(*[F.lit(x) for k, v in types.items() for x in (k, v)]), c("db_type")) if types else F.lit(None).cast("string")
    host = F.coalesce("host", F.lit(""))
    return raw.select(
        "id", F.coalesce("alias", F.lit("")).alias("name"), F.when(F.coalesce("port", F.lit(0)) != 0, F.concat_ws(":", host, c("port").cast("string"))).otherwise(host).alias("address"), F.coalesce(known, "db_type", F.lit("")).alias("type"),
        control.alias("control"), F.when((control == "COMMON") | flag("sell_trust"), "automatic").otherwise("manual").alias("login"),
    )


def database_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(id, line): the CSV line of each database; a cell is quoted only if it has a comma, a quote or a line end."""
    cell = lambda k: F.when(F.coalesce(c(k).cast("string"), F.lit("")).rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c(k).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c(k).cast("string"), F.lit("")))
    return rows.select("id", F.concat_ws(",", *map(cell, columns)).alias("line"))


def batch_detail(asked: DataFrame, repositories: DataFrame, links: DataFrame, apps: DataFrame, deployments: DataFrame) -> DataFrame:
    """(input, repository, app, env, ip, status): asked addresses with all they lead to, a row for each deployment; what leads nowhere keeps a row.

    asked: (input); repositories: (repository, url), links: (repository, app), apps: (app), deployments: (app, env, ip), all by key. status:
    invalid address, no repository, no application, application not collected, not deployed, several repositories, matched.
    """
    a = asked.select("input").distinct().withColumn("_key", net.git_key(c("input")))
    bad = a.where("_key = ''").select("input")
    r = repositories.select("repository", net.git_key(c("url")).alias("_key")).where("_key <> ''").distinct()
    often = r.groupBy("_key").agg(F.count("*").alias("_n"))
    j = a.where("_key <> ''").join(r, "_key", "left").join(often, "_key", "left").join(links.select("repository", "app").distinct(), "repository", "left")
    j = j.join(apps.select("app", F.lit(True).alias("_collected")).distinct(), "app", "left").join(deployments.select("app", "env", "ip").distinct(), "app", "left")
    status = F.when(c("repository").isNull(), "no repository").when(c("app").isNull(), "no application").when(c("_collected").isNull(), "application not collected").when(c("env").isNull(), "not deployed").when(c("_n") > 1, "several repositories").otherwise("matched")
    out = j.select("input", "repository", "app", F.when(c("_collected"), c("env")).alias("env"), F.when(c("_collected"), c("ip")).alias("ip"), status.alias("status")).distinct()
    none = F.lit(None)
    return out.unionByName(bad.select("input", *[none.cast(out.schema[k].dataType).alias(k) for k in ("repository", "app", "env", "ip")], F.lit("invalid address").alias("status")))


def candidates(processes: DataFrame, applications: DataFrame, main_class: str) -> tuple[DataFrame, DataFrame]:
    """((asset, pid, applications, status), (state, assets)): processes of a component by their main class with all applications that may be theirs, and how many assets were looked into.

    processes: (asset, state, pid, command), a row without pid for an asset without any; applications: (asset, pid, app) found by any rule. No candidate is
    confirmed: AMBIGUOUS with several applications, INFERRED with one, UNKNOWN with none.
    """
    found = processes.where(c("pid").isNotNull() & F.array_contains(strings.arguments(c("command")), main_class)).select("asset", "pid").distinct()
    apps = applications.select("asset", "pid", "app").distinct().groupBy("asset", "pid").agg(F.array_sort(F.collect_list("app")).alias("applications"))
    made = found.join(apps, ["asset", "pid"], "left").withColumn("applications", F.coalesce("applications", F.array().cast(apps.schema["applications"].dataType)))
    n = F.size("applications")
    coverage = processes.select("asset", F.coalesce("state", F.lit("not_collected")).alias("state")).distinct().groupBy("state").agg(F.count("*").alias("assets"))
    return made.withColumn("status", F.when(n > 1, "AMBIGUOUS").when(n == 1, "INFERRED").otherwise("UNKNOWN")), coverage


def exclusion_category(status: Column, error: Column, errors: dict[str, str]) -> Column:
    """Why a result may be excluded: skipped, or the category of a failed one's error; null if it may not."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for k, v in errors.items() for x in (k, v)]), error)
    return F.when(status == "skipped", "skipped").when(status == "failed", known)


def excluded(current: DataFrame, results: DataFrame, chosen: DataFrame, exclude: bool, errors: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """((app, category) of the list after a change, (app) that may not be excluded): chosen applications (app) are put on the list or taken off it.

    results: (app, status, error) of the last run. An entry that is there keeps its category; if any chosen one may not be excluded, the list stays as it is.
    """
    pick = chosen.select("app").distinct()
    if not exclude:
        return current.select("app", "category").join(pick, "app", "left_anti"), pick.limit(0)
    judged = pick.join(results.select("app", exclusion_category(c("status"), c("error"), errors).alias("category")), "app", "left")
    wrong = judged.where("category is null").select("app")
    fits = wrong.agg((F.count("*") == 0).alias("_fits"))  # one row
    new = judged.join(current.select("app"), "app", "left_anti").where("category is not null").crossJoin(F.broadcast(fits)).where("_fits").select("app", "category")
    return current.select("app", "category").unionByName(new), wrong
