"""Column functions over commands, names, secrets and cells."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secret arguments and settings whose value is hidden.
SECRET_NAMES = "password|passwd|pwd|secret|token|access[_-]?key|private[_-]?key|credential"
MEMORY_SIZES_GIB = (1, 2, 4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
# Process types by name or command, the first that fits counts.
NATIVE_TYPES = (
    ("Kong", r"^kong(-server)?$"), ("Elasticsearch", r"^elasticsearch$"), ("RabbitMQ", r"^rabbitmq(-server)?$"), ("MongoDB", r"^mongo[ds]$"), ("Nginx", r"^nginx(:|$)"),
    ("Node", r"^node(js)?$"), ("Redis", r"^redis-server"), ("MySQL", r"^(mysqld|mariadbd)$"), ("PostgreSQL", r"^postgres(:|$)"), ("Python", r"^python[\d.]*$"),
)
JAVA_TYPES = (
    ("Elasticsearch", r"\borg\.elasticsearch\.bootstrap\.Elasticsearch\b"), ("ZooKeeper", r"\borg\.apache\.zookeeper\.server\.(quorum\.QuorumPeerMain|ZooKeeperServerMain)\b"),
    ("Nacos", r"\bcom\.alibaba\.nacos\.Nacos\b|-jar\s+\S*nacos-server\S*\.jar"), ("Canal", r"\bcom\.alibaba\.otter\.canal\.|-jar\s+\S*canal\.(deployer|admin)\S*\.jar"),
    ("RocketMQ", r"\borg\.apache\.rocketmq\."), ("ActiveMQ", r"\borg\.apache\.activemq\."), ("Tomcat", r"\borg\.apache\.catalina\.|-Dcatalina\.(base|home)="), ("Kafka", r"\bkafka\.Kafka\b|\borg\.apache\.kafka\."),
)
MIDDLEWARE = ("MySQL", "PostgreSQL", "Redis", "Kafka", "Elasticsearch", "Kibana", "ZooKeeper", "Nacos", "Kong", "Canal", "RabbitMQ", "RocketMQ", "ActiveMQ", "MongoDB")


def first_match(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds: an ordered classifier."""
    made = reduce(lambda c, x: F.when(x[0], x[1]) if c is None else c.when(x[0], x[1]), cases, None)
    return made.otherwise(otherwise)


def arguments(command: Column) -> Column:
    """A command line's arguments; quotes keep blanks together and are dropped."""
    raw = F.regexp_extract_all(F.coalesce(command, F.lit("")), F.lit(r"""("(?:\\.|[^"\\])*"|'[^']*'|[^\s]+)"""), F.lit(1))
    return F.transform(raw, lambda a: F.regexp_replace(a, r"""^(["'])(.*)\1$""", "$2"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def jar_name(command: Column) -> Column:
    """File name of the jar that -jar names; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(command, F.lit("")), r"(?:^|\s)-jar\s+(?:\S*/)?([^\s/]+)", 1), F.lit(""))


def process_type(name: Column, command: Column, system: Column | None = None) -> Column:
    """Type of a process by the first rule that fits; Java processes by entry class or jar."""
    name, command = F.coalesce(name, F.lit("")), F.coalesce(command, F.lit(""))
    program = F.coalesce(base_name(F.get(arguments(command), F.lit(0))), F.lit(""))
    java = F.lower(name).isin("java", "jsvc") | F.lower(program).isin("java", "jsvc")
    of_java = first_match([(command.rlike(p), F.lit(t)) for t, p in JAVA_TYPES], F.when(jar_name(command).isNotNull(), "Java Jar").otherwise("Other Java"))
    kibana = command.rlike(r"(?i)(^|\s)\S*/kibana/(\S*/)?(src/cli|bin/kibana)(\s|$)")
    rabbit = F.lower(program).isin("beam", "beam.smp") & command.rlike(r"(?i)\s-s\s+rabbit\s+boot(\s|$)")
    cases = [(kibana, F.lit("Kibana")), (rabbit, F.lit("RabbitMQ"))] + [(F.lower(program).rlike(p) | F.lower(name).rlike(p), F.lit(t)) for t, p in NATIVE_TYPES]
    return F.when(F.coalesce(system, F.lit(False)) if system is not None else F.lit(False), "System").when(java, of_java).otherwise(first_match(cases, F.lit("Other")))


def is_middleware(kind: Column) -> Column:
    return kind.isin(*MIDDLEWARE)


def command_port(command: Column) -> Column:
    """Port that a command line states, from 1 to 65535; the first form that is there counts."""
    forms = (r"-Dserver\.port=(\d{1,5})(?!\d)", r"--server\.port[= ](\d{1,5})(?!\d)", r"--port[= ](\d{1,5})(?!\d)", r"(?:^|\s)-p\s+(\d{1,5})(?!\d)")
    port = F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(command, F.lit("")), p, 1), F.lit("")).try_cast("int") for p in forms])
    return F.when(port.between(1, 65535), port)


def redact_arguments(value: Column) -> Column:
    """Values of secret arguments, user parts of URLs and bearer tokens replaced by ***."""
    out = F.regexp_replace(value, rf"(?i)((?:^|[\s\-_.])[\w.\-]*(?:{SECRET_NAMES})[\w.\-]*\s*[=:]\s*)(\"[^\"]*\"|'[^']*'|[^\s\"',;&]+)", "$1***")
    out = F.regexp_replace(out, r"([A-Za-z][A-Za-z0-9+.\-]*://)[^/\s:@]+:[^/\s@]+@", "$1***@")
    return F.regexp_replace(out, r"(?i)(bearer\s+)[A-Za-z0-9._~+/\-]+=*", "$1***")


def redact_config(value: Column) -> Column:
    """As redact_arguments, and XML elements and PEM blocks."""
    out = F.regexp_replace(value, r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "***")
    out = F.regexp_replace(out, rf"(?i)(<([\w.\-]*(?:{SECRET_NAMES})[\w.\-]*)>)[^<]*(</\2>)", "$1***$3")
    return redact_arguments(out)


def clean_terminal(value: Column) -> Column:
    """Text without terminal sequences and control characters other than tab and line ends."""
    out = F.regexp_replace(value, r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07]*\x07", "")
    return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def csv_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    raw = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.ltrim(raw).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), raw)).otherwise(raw)


def nominal_memory_gib(megabytes: Column, sizes: tuple[int, ...] = MEMORY_SIZES_GIB) -> Column:
    """The usual memory size that is nearest; the smaller of two as near."""
    far = F.transform(F.array(*map(F.lit, sizes)), lambda s: F.struct(F.abs(megabytes / 1024 - s).alias("far"), s.alias("size")))
    return F.array_min(far)["size"]


def squeezed(name: Column) -> Column:
    """Letters and digits of a name in lower case, to compare names that are written differently."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]", "")


def _segment_regex(segment: str) -> str:
    """One name of a pattern: stars stand for any characters of a name, two of them for folders too."""
    kinds = {"*": "[^/]*", "?": "[^/]", "**": ".*"}
    return "".join(kinds.get(part) or re.escape(part) for part in re.split(r"(\*\*|\*|\?)", segment))


def glob_regex(pattern: str) -> str:
    """Regular expression of an Ant-style pattern: **/ any folders, * and ? within one name."""
    *folders, name = pattern.split("/")
    any_depth = [_segment_regex(f[:-2]) + "(?:.*/)?" if f.endswith("**") else _segment_regex(f) + "/" for f in folders]
    return f"^{''.join(any_depth)}{_segment_regex(name)}$"


def stable_key(*columns: Column) -> Column:
    """Digest of a record, whatever the order its fields are named in."""
    named = sorted(columns, key=str)
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(named)]), {"ignoreNullFields": "false"}), 256)


def location_words(uri: Column) -> Column:
    """The arguments of a location, escaped for a regular expression."""
    return F.transform(F.filter(F.split(F.trim(uri), r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"([.*+?^$(){}|\[\]\\])", r"\\$1"))


def location_opening(uri: Column) -> Column:
    """Regular expression of a line that opens a location with these arguments; blanks between them don't matter."""
    return F.concat(F.lit(r"^[ \t]*location[ \t]+"), F.array_join(location_words(uri), r"[ \t]+"), F.lit(r"(?:[ \t]*\{|[ \t]*#|[ \t]*$)"))


def bare_line(line: Column) -> Column:
    """A line without what is escaped, quoted or a comment."""
    return F.regexp_replace(F.regexp_replace(line, r"""\\.|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'""", ""), r"#.*$", "")


def location_block(content: Column, uri: Column) -> Column:
    """(start, end) of the lines, from 0, of the first location block with these arguments; null without one or if it isn't closed.

    Blanks between the arguments don't matter. Braces in quotes and comments don't count. The nesting is a running sum over lines, kept in one fold.
    Each call reads the whole text; proxyconf.location_blocks() reads it once for all that is asked of it.
    """
    lines = F.split(content, "\r?\n", -1)
    words, opening = location_words(uri), location_opening(uri)
    bare = F.transform(lines, bare_line)
    start = F.array_position(F.transform(lines, lambda s: F.regexp_like(s, opening)), F.lit(True)) - 1
    count = lambda s, brace: F.length(s) - F.length(F.replace(s, F.lit(brace), F.lit("")))
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

    def step(x: Column, s: Column) -> Column:
        depth, opened = x["depth"] + count(s, "{") - count(s, "}"), x["opened"] | s.contains("{")
        return F.struct(depth.alias("depth"), opened.alias("opened"), (x["at"] + 1).alias("at"), F.coalesce(x["end"], F.when(opened & (depth <= 0), x["at"])).alias("end"))

    after = F.aggregate(F.slice(bare, (start + 1).cast("int"), F.size(lines)), state, step, lambda x: x["end"])
    return F.when((start >= 0) & (F.size(words) > 0), F.when(after.isNotNull(), F.struct(start.cast("int").alias("start"), (start + after).cast("int").alias("end"))))
