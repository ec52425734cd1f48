"""Proxy configurations as tables: dumps are cut into files, files into directives, includes are followed by joins.

A dump is what a proxy prints of its whole configuration, each file under a line that names it. Only the grammar of
one file is read in Python; from there on some blocks beside each other are a row that knows the blocks around them, including
a file is a join that repeats its rows below the including block, round by round until nothing is included any more, and
routes are joins of blocks with what is said around them. What is not a whole configuration becomes a row of problems and gives no routes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions import net, strings
from tidegrid.operators.graph import settle

# Directives that pass a request on, and blocks that are evaluated under a condition.
PASSES = ("proxy_pass", "fastcgi_pass", "grpc_pass", "uwsgi_pass", "scgi_pass")
CONDITIONS = ("if", "limit_except")
LUA = "_by_lua_block"
#: Directives without a block that routes() reads, besides those that pass a request on.
SAID = ("allow", "deny", "server_name", "listen", "root", "alias", "satisfy", "server")
#: Blocks in each other; every row of blocks names the blocks around it. A text with more is refused.
MOST_NESTED = 200
#: Blocks beside each other in a row, rows in an Arrow batch.
BESIDE, BATCH = 500, 2000
#: Blocks whose routes a task compares.
A_TASK = 50_000

TOKEN = re.compile(
    r"""\s*+ (?: (?P<comment>\#[^\n]*+) | (?P<mark>[{};])
    | (?P<word>(?: [^\s{};"'\\$]++ | \\. | \$\{[^}]*\} | \$(?!\{) | "(?:\\.|[^"\\])*" | '(?:\\.|[^'\\])*' )+) | (?P<rest>.) | \Z )""",
    re.X | re.S,
)
LUA_TOKEN = re.compile(r"""--\[(?P<c>=*)\[.*?\](?P=c)\] | (?P<open>--\[=*\[ ) | --[^\n]* | \[(?P<s>=*)\[.*?\](?P=s)\] | (?P<long>\[=*\[) | "(?:\\.|[^"\\])*" | '(?:\\.|[^'\\])*' | (?P<brace>[{}]) | (?P<quote>["'])""", re.X | re.S)
QUOTED = re.compile(r"""(\\.)|"((?:\\.|[^"\\])*)"|'((?:\\.|[^'\\])*)'""", re.S)


class Refused(ValueError):
    """A text that isn't a whole configuration."""


def lua_end(text: str, at: int) -> int:
    """The place after the brace that closes a Lua body which begins at at; its comments, strings and long brackets may hold any braces."""
    depth = 1
    for m in LUA_TOKEN.finditer(text, at):
        if m["open"] or m["long"]:
            raise Refused("Lua bracket is not closed")
        if m["quote"]:
            raise Refused("Lua string is not closed")
        if m["brace"]:
            depth += 1 if m["brace"] == "{" else -1
            if not depth:
                return m.end()
    raise Refused("Lua block is not closed")


def words(text: str) -> Iterator[str | tuple[str]]:
    """Words as (word,), marks as they are; a Lua body is an empty block."""
    at: int | None = 0
    while at is not None:
        start, at, last = at, None, ""
        for m in TOKEN.finditer(text, start):
            kind = m.lastgroup
            if kind == "word":
                last = m["word"]
                if '"' in last or "'" in last:
                    last = QUOTED.sub(lambda q: q[1] or q[2] or q[3] or "", last)
                if last:
                    yield (last,)
            elif kind == "mark":
                mark = m["mark"]
                yield mark
                if mark == "{" and last.endswith(LUA):
                    at = lua_end(text, m.end())
                    yield "}"
                    break
                last = ""
            elif kind == "rest":
                raise Refused({"$": "variable is not closed", "\\": "escape at the end"}.get(m["rest"], "quote is not closed"))


def directives(text: str) -> list[tuple]:
    """(id, name, args, block, above) of every directive; above are the (id, name, args) of the blocks around it."""
    out: list[tuple] = []
    above: tuple[tuple, ...] = ()
    head: list[str] = []
    for w in words(text):
        if isinstance(w, tuple):
            head.append(w[0])
        elif w == "}":
            if head or not above:
                raise Refused("block ends too early")
            above = above[:-1]
        else:
            if not head:
                raise Refused("directive is empty")
            out.append((len(out), head[0], head[1:], w == "{", above))
            if w == "{":
                above = (*above, out[-1][:3])
                if len(above) > MOST_NESTED:
                    raise Refused(f"more than {MOST_NESTED} blocks in each other")
            head = []
    if head or above:
        raise Refused("configuration is cut off")
    return out


def blocks_of(text: str) -> tuple[list[tuple], list[tuple], bool]:
    """(rows, asks, lua) of a text: rows are (above, [(id, name, args, inside, asks, covers, holds)]), up to BESIDE blocks beside each other with the directives without a block
    in each, id -1 for those outside of any block; asks are the (id, pattern, above) of its includes, lua is whether Lua decides something.

    A block asks if it includes something, covers if it has a location / of its own, and holds if it has blocks of its own or asks.
    """
    inside: dict[int, list[tuple]] = {-1: []}
    beside: dict[int, tuple[tuple, list]] = {}
    asks, asking, covers, lua = [], set(), set(), False
    for i, name, args, block, above in directives(text):
        up = above[-1][0] if above else -1
        if block:
            inside[i] = []
            if up not in beside:
                beside[up] = (above, [])
            beside[up][1].append((i, name, args))
            if name == "location" and " ".join(args) == "/":
                covers.add(up)
        else:
            inside[up].append((i, name, args))
            if name == "include" and len(args) == 1:
                asks.append((i, args[0], above))
                asking.add(up)
        lua = lua or "_by_lua" in name
    rows = [((), [(-1, None, [], inside[-1], -1 in asking, False, True)])] if inside[-1] else []
    for above, found in beside.values():
        each = [(*b, inside[b[0]], b[0] in asking, b[0] in covers, b[0] in beside or b[0] in asking) for b in found]
        rows += [(above, each[k : k + BESIDE]) for k in range(0, len(each), BESIDE)]
    return rows, asks, lua


def files_of(dumps: DataFrame, dump_col: str = "dump", text_col: str = "text") -> DataFrame:
    """(dump, ord, file, text) of the files of each dump; ord 0 is the file that includes the others. A dump without a file's mark gives none."""
    mark = r"(?m)^# configuration file (.+):\s*\n"
    parts = F.zip_with(F.regexp_extract_all(text_col, F.lit(mark), F.lit(1)), F.slice(F.split(text_col, mark, -1), F.lit(2), F.lit(1 << 20)), lambda a, b: F.struct(a.alias("file"), b.alias("text")))
    each = dumps.select(F.col(dump_col).cast("string").alias("dump"), F.posexplode(parts).alias("ord", "f"))
    first = each.groupBy("dump", F.col("f.file").alias("file")).agg(F.min("ord").alias("ord"), F.max_by("f.text", "ord").alias("text"))  # of a file that is named twice the last text counts
    return first.select("dump", "ord", "file", "text")


#: What parsed() returns; the same for Arrow.
_HEAD = pa.struct([("id", pa.int32()), ("name", pa.string()), ("args", pa.list_(pa.string()))])
_BLOCK = pa.struct([*_HEAD, ("inside", pa.list_(_HEAD)), ("asks", pa.bool_()), ("covers", pa.bool_()), ("holds", pa.bool_())])
_ASK = pa.struct([("id", pa.int32()), ("asked", pa.string()), ("above", pa.list_(_HEAD))])
PARSED = pa.schema([("dump", pa.string()), ("file", pa.string()), ("above", pa.list_(_HEAD)), ("blocks", pa.list_(_BLOCK)), ("asks", pa.list_(_ASK)), ("lua", pa.bool_()), ("error", pa.string())])
_HEADS = "array<struct<id:int,name:string,args:array<string>>>"


def parsed(files: DataFrame) -> DataFrame:
    """(dump, file, above, blocks, asks, lua, error) of (dump, file, text): blocks_of() each text, a row for the file (asks, lua, error; no blocks) and one for each of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), PARSED.types, strict=True)], schema=PARSED)
        for f in batches:
            rows: list[tuple] = []
            for dump, file, text in zip(*[f.column(c).to_pylist() for c in ("dump", "file", "text")], strict=True):
                try:
                    found, asks, lua = blocks_of(text or "")
                    rows.append((dump, file, None, None, asks, lua, None))
                    rows += [(dump, file, above, blocks, None, None, None) for above, blocks in found]
                except Refused as e:
                    rows.append((dump, file, None, None, None, None, str(e)))
                while len(rows) >= BATCH:
                    yield made(rows[:BATCH])
                    rows = rows[BATCH:]
            if rows:
                yield made(rows)

    return files.select("dump", "file", "text").mapInArrow(run, f"dump string, file string, above {_HEADS}, blocks array<struct<id:int,name:string,args:array<string>,inside:{_HEADS},asks:boolean,covers:boolean,holds:boolean>>, asks array<struct<id:int,asked:string,above:{_HEADS}>>, lua boolean, error string")


def _glob(pattern: Column) -> Column:
    """Regular expression of a shell pattern: * and ? stand for any characters, folders too."""
    plain = F.regexp_replace(F.regexp_replace(pattern, r"([.+^${}()|\\])", r"\\$1"), r"\[!", "[^")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(plain, r"\*", ".*"), r"\?", "."), F.lit("$"))


def expanded(dumps: DataFrame, dump_col: str = "dump", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(directives, problems) of dumps (dump, text).

    directives: (dump, mount, at, file, scope, top, blocks), every directive as often as its file is included. A row has blocks
    (id, name, args, inside, asks, covers, holds) beside each other, with the directives without a block in each; id -1 stands for the file itself.
    A block's key is mount:id; scope are the (key, name, args) of the blocks around, across files, top is whether these are
    other files', and a directive's order is at with its id. problems: (dump, file, severity, problem); an error (no file, a
    text that is not whole, an include cycle) refuses the dump, which then has no directives.
    """
    files = settle(files_of(dumps, dump_col, text_col), "files")
    rows = settle(parsed(files), "parsed")
    none = dumps.select(F.col(dump_col).cast("string").alias("dump")).distinct().join(files.select("dump").distinct(), "dump", "left_anti")
    problems = rows.where("error is not null").select("dump", "file", F.lit("error").alias("severity"), F.col("error").alias("problem"))
    problems = problems.unionByName(none.select("dump", F.lit(None).cast("string").alias("file"), F.lit("error").alias("severity"), F.lit("no configuration files").alias("problem")))
    lua = rows.where("lua").select("dump", "file", F.lit("warning").alias("severity"), F.lit("Lua decides at run time").alias("problem")).distinct()
    root = files.where("ord = 0").select("dump", F.col("file").alias("root"), F.regexp_replace("file", "/[^/]*$", "").alias("home"))
    named = files.select(F.col("dump").alias("t_dump"), F.col("file").alias("target"))
    below = named.withColumn("folder", F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.length("target")), lambda i: F.substring("target", i, F.lit(1)) == "/"), lambda i: F.substring("target", F.lit(1), i))))
    asks = rows.select("dump", "file", F.explode("asks").alias("a")).select("dump", "file", "a.*").join(root, "dump")
    asks = asks.withColumn("pattern", F.when(F.col("asked").startswith("/"), F.col("asked")).otherwise(F.concat_ws("/", "home", "asked"))).withColumn("wild", F.col("asked").rlike(r"[*?\[]"))
    asks = asks.select("dump", "file", "id", "above", "asked", "pattern", "wild")
    exact = asks.where("not wild").join(named, (F.col("dump") == F.col("t_dump")) & (F.col("pattern") == F.col("target")), "left").drop("t_dump")
    # a pattern's files lie below the folder that it names before its first wildcard: joined by that folder, then matched
    wild = asks.where("wild").withColumn("lead", F.regexp_extract("pattern", r"^([^*?\[]*/)", 1))
    wild = wild.join(below, (F.col("dump") == F.col("t_dump")) & (F.col("lead") == F.col("folder"))).where(F.regexp_like("target", _glob(F.col("pattern")))).drop("t_dump", "lead", "folder")
    includes = settle(exact.unionByName(wild), "includes")
    missing = includes.where("target is null").select("dump", "file", F.lit("warning").alias("severity"), F.concat(F.lit("include not expanded: "), "asked").alias("problem")).distinct()
    step = includes.where("target is not null").select("dump", "file", "id", "above", "target")
    ready = lambda mount, ids: F.transform(ids, lambda b: F.struct(F.concat_ws(":", mount, b["id"].cast("string")).alias("key"), b["name"].alias("name"), b["args"].alias("args")))
    empty = F.array().cast("array<struct<key:string,name:string,args:array<string>>>")
    front = root.select("dump", F.lit("0").alias("mount"), F.col("root").alias("file"), F.array("root").alias("chain"), empty.alias("scope"), F.array().cast("array<int>").alias("at"))
    front = mounts = settle(front, "mounts")
    cycles = None
    for _ in count():
        moved = front.join(step, ["dump", "file"]).select(
            "dump", F.concat_ws(".", "mount", F.col("id").cast("string"), "target").alias("inner"), "target", "chain", F.concat("scope", ready(F.col("mount"), F.col("above"))).alias("scope"), F.array_append("at", F.col("id")).alias("at"), F.col("file").alias("by")
        )
        moved = settle(moved, "mounts")
        again = moved.where(F.array_contains("chain", F.col("target"))).select("dump", F.col("by").alias("file"), F.lit("error").alias("severity"), F.concat(F.lit("include cycle: "), "target").alias("problem"))
        cycles = again if cycles is None else cycles.unionByName(again)
        front = moved.where(~F.array_contains("chain", F.col("target"))).select("dump", F.col("inner").alias("mount"), F.col("target").alias("file"), F.array_append("chain", F.col("target")).alias("chain"), "scope", "at")
        if front.isEmpty():
            break
        mounts = mounts.unionByName(front)
    problems = settle(problems.unionByName(cycles).unionByName(missing).unionByName(lua).distinct(), "problems")
    refused = problems.where("severity = 'error'").select("dump").distinct()
    found = mounts.drop("chain").join(rows.where("blocks is not null").select("dump", "file", "above", "blocks"), ["dump", "file"]).join(refused, "dump", "left_anti")
    return settle(found.select("dump", "mount", "at", "file", F.concat("scope", ready(F.col("mount"), F.col("above"))).alias("scope"), (F.size("above") == 0).alias("top"), "blocks"), "directives"), problems


def endpoint(value: Column, default: Column) -> Column:
    """(host, port, resolution) of where a request is passed to: unix, dynamic (a variable), ip or hostname."""
    six = F.regexp_extract(value, r"^\[([^\]]+)\]", 1)
    host = F.when(six != "", six).otherwise(F.regexp_extract(value, r"^([^:/]*)", 1))
    port = F.coalesce(F.nullif(F.regexp_extract(value, r"^(?:\[[^\]]*\]|[^:/]*):(\d+)", 1), F.lit("")), default)
    kind = F.when(value.startswith("unix:"), "unix").when(value.contains("$"), "dynamic").when((six != "") | net.is_ipv4(host), "ip").otherwise("hostname")
    whole = kind.isin("unix", "dynamic")
    return F.struct(F.when(whole, value).otherwise(host).alias("host"), F.when(~whole, port).alias("port"), kind.alias("resolution"))


def routes(directives: DataFrame) -> DataFrame:
    """(dump, file, context, server_names, listen, uri, directive, target, upstream, backends) of expanded()'s directives.

    A server, each location and each condition in them has a route for what it passes requests to (its own, or for a location
    that of the blocks around it), an access_control route if it denies all, and a server or location that passes
    nothing on is static/other with the folder it serves.  Where the first rule denies all (without
    "satisfy any" or a condition), nothing else counts.
    """
    c = F.col
    key = lambda mount, i: F.concat_ws(":", mount, i.cast("string"))
    last = lambda x: F.get(F.reverse(x), F.lit(0))
    kinds = ("server", "location", *CONDITIONS)
    d = directives.withColumn("parent", last(c("scope"))["key"]).withColumn("context", F.get(F.filter("scope", lambda s: s["name"].isin("http", "stream")), F.lit(0))["name"])
    d = d.withColumn("outer", F.get(F.filter("scope", lambda s: s["name"] == "server"), F.lit(0))["key"])
    each = lambda df, cond: df.withColumn("b", F.explode(F.filter("blocks", cond))).withColumn("key", key(c("mount"), c("b.id"))).drop("blocks")
    said = F.transform(F.filter("b.inside", lambda x: x["name"].isin(*PASSES, *SAID)), lambda x: F.struct(F.array_append("at", x["id"]).alias("at"), c("file").alias("file"), x["name"].alias("name"), x["args"].alias("args")))
    # what included files say outside of their blocks belongs to the block that includes them
    tops = d.where("top and parent is not null")
    more = each(tops, lambda b: b["id"] == -1).select("dump", c("parent").alias("key"), said.alias("said"), F.lit(False).alias("covers")).where("size(said) > 0")
    slash = tops.where(F.exists("blocks", lambda b: (b["name"] == "location") & (F.array_join(b["args"], " ") == "/"))).select("dump", c("parent").alias("key"), F.array().cast(more.schema["said"].dataType).alias("said"), F.lit(True).alias("covers"))
    more = settle(more.unionByName(slash).groupBy(c("dump").alias("m_dump"), c("key").alias("m_key")).agg(F.flatten(F.collect_list("said")).alias("m_said"), F.max("covers").alias("m_covers")), "included")
    some = not more.isEmpty()

    def whole(df: DataFrame) -> DataFrame:
        """df of single blocks with said, in its order, and covers."""
        alone = df.withColumn("said", said).withColumn("covers", c("b.covers"))
        if not some:
            return alone
        joined = alone.where("b.asks").join(more, (c("dump") == c("m_dump")) & (c("key") == c("m_key")), "left")
        joined = joined.withColumn("said", F.when(c("m_key").isNull(), c("said")).otherwise(F.array_sort(F.concat("said", F.coalesce("m_said", F.array().cast(more.schema["m_said"].dataType)))))).withColumn("covers", c("covers") | F.coalesce("m_covers", F.lit(False)))
        return alone.where("not b.asks").unionByName(joined.drop(*more.columns))

    pick = lambda cond: F.filter("said", cond)
    first = lambda name: F.get(pick(lambda x: (x["name"] == name) & (F.size(x["args"]) == 1)), F.lit(0))["args"][0]
    facts = {
        "passes": pick(lambda x: x["name"].isin(*PASSES) & (F.size(x["args"]) > 0)), "access": pick(lambda x: x["name"].isin("allow", "deny") & (F.size(x["args"]) == 1)), "names": F.flatten(F.transform(pick(lambda x: x["name"] == "server_name"), lambda x: x["args"])),
        "listens": F.transform(pick(lambda x: x["name"] == "listen"), lambda x: F.array_join(x["args"], " ")), "root": first("root"), "alias": first("alias"), "satisfy": first("satisfy"),
    }
    # what the blocks around say: once for all that stand in the same block
    around = d.where("context is not null").select("dump", "parent", "outer", "scope").distinct()
    around = around.select("dump", "parent", "outer", F.posexplode("scope").alias("depth", "s"))
    own = whole(each(d, lambda b: (b["id"] >= 0) & b["holds"])).where("size(said) > 0").select(c("dump").alias("o_dump"), c("key").alias("o_key"), *[x.alias(k) for k, x in facts.items() if k != "alias"])
    near = lambda col, cond: F.max_by(F.when(cond, c(col)), F.when(cond, c("depth")))
    server = c("s.key") == c("outer")
    around = around.join(own, (c("dump") == c("o_dump")) & (c("s.key") == c("o_key"))).groupBy(c("dump").alias("h_dump"), c("parent").alias("h_key")).agg(
        near("passes", c("s.name").isin("server", "location") & (F.size("passes") > 0)).alias("h_passes"), near("access", F.size("access") > 0).alias("h_access"), near("root", c("root").isNotNull() & (c("s.name") != "http")).alias("h_root"), near("satisfy", c("satisfy").isNotNull()).alias("h_satisfy"),
        near("names", server).alias("h_names"), near("listens", server).alias("h_listens"),
    )
    rows = d.where(c("context").isNotNull() & F.exists("blocks", lambda b: b["name"].isin(*kinds)))
    rows = rows.join(around, (c("dump") == c("h_dump")) & (c("parent") == c("h_key")), "left").drop("h_dump", "h_key", "parent")
    b = each(rows, lambda b: b["name"].isin(*kinds)).where("outer is not null or b.name = 'server'")
    b = whole(b).withColumns(facts).withColumn("name", c("b.name")).withColumn("condition", c("name").isin(*CONDITIONS))
    chain = F.array_append("scope", F.struct(c("key").alias("key"), c("name").alias("name"), c("b.args").alias("args")))
    nothing = F.array().cast("array<string>")
    itself = c("outer").isNull()  # a server; its own names count
    b = b.withColumns({"server_names": F.coalesce(F.when(itself, c("names")).otherwise(c("h_names")), nothing), "listen": F.coalesce(F.when(itself, c("listens")).otherwise(c("h_listens")), nothing)})
    mine = lambda k: F.when((F.size(k) > 0) | c("condition"), c(k)).otherwise(F.coalesce(f"h_{k}", k))
    b = b.withColumns({"passes": mine("passes"), "access": mine("access"), "root": F.coalesce("root", "h_root"), "satisfy": F.coalesce("satisfy", "h_satisfy")})
    place = last(F.filter(chain, lambda s: s["name"] == "location"))["args"]
    b = b.withColumn("uri", F.when(place.isNotNull(), F.array_join(place, " ")).when(c("context") == "http", "/").otherwise("(TCP/UDP)")).withColumn("conditional", F.exists(chain, lambda s: s["name"].isin(*CONDITIONS)))
    rules = F.transform("access", lambda x: F.concat_ws(" ", x["name"], F.array_join(x["args"], " ")))
    blocked = (F.coalesce(F.get(rules, F.lit(0)), F.lit("")) == "deny all") & (F.coalesce("satisfy", F.lit("all")) == "all") & ~c("conditional")
    b = b.withColumn("denies", F.array_contains(rules, "deny all")).withColumn("blocked", blocked)
    path = F.when(c("uri").rlike(r"^(=|\^~) \S+$"), F.split_part("uri", F.lit(" "), F.lit(2))).when(c("uri").rlike(r"^/\S*$"), c("uri"))
    served = F.when(c("alias").isNotNull(), c("alias")).when(c("root").isNull(), "").when(path.isNull(), c("root")).otherwise(F.concat(F.regexp_replace("root", "/+$", ""), path))
    line = lambda file, directive, target, passed: F.struct(file.alias("file"), directive.alias("directive"), target.alias("target"), F.lit(passed).alias("passed"))
    denied = line(F.get(F.filter("access", lambda x: (x["name"] == "deny") & (x["args"][0] == "all")), F.lit(0))["file"], F.lit("access_control"), F.lit("deny all"), False)
    static = line(c("file"), F.lit("static/other"), served, False)
    lines = F.concat(
        F.when(c("denies"), F.array(denied)).otherwise(F.array()), F.when(~c("blocked"), F.transform("passes", lambda p: line(p["file"], p["name"], p["args"][0], True))).otherwise(F.array()),
        F.when(~c("blocked") & (F.size("passes") == 0) & ~c("condition") & ~((c("name") == "server") & c("covers")), F.array(static)).otherwise(F.array()),
    )
    keep = ["dump", "context", "server_names", "listen", "uri"]
    b = b.select(*keep, F.explode(lines).alias("line")).select(*keep, "line.*")
    # what passes nothing on meets no pool: a place's own words spread it over the tasks
    b = b.withColumn("upstream", F.when(~c("passed"), c("uri")).when(c("target").contains("://"), F.regexp_extract("target", r"://([^/?#]*)", 1)).otherwise(c("target")))
    tasks = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), (d.agg(F.sum(F.size("blocks"))).first()[0] or 0) // A_TASK)
    b = b.repartition(tasks, "dump", "context", "upstream").distinct()  # the join with pools needs no other exchange
    pools = whole(each(d.where("context is not null"), lambda b: (b["name"] == "upstream") & (F.size(b["args"]) > 0)))
    members = F.transform(pick(lambda x: (x["name"] == "server") & (F.size(x["args"]) > 0)), lambda x: F.struct(x["at"].alias("at"), endpoint(x["args"][0], F.lit("80")).alias("e")))
    pools = pools.select(c("dump").alias("u_dump"), c("context").alias("u_ctx"), c("b.args")[0].alias("pool"), members.alias("m")).where("size(m) > 0")
    pools = pools.groupBy("u_dump", "u_ctx", "pool").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("members")).withColumn("u_passed", F.lit(True))
    secure = F.when(F.lower("target").rlike("^(https|grpcs)://"), "443").otherwise("80")
    b = b.join(pools, (c("dump") == c("u_dump")) & (c("context") == c("u_ctx")) & (c("upstream") == c("pool")) & (c("passed") == c("u_passed")), "left")
    backends = F.when(c("members").isNotNull(), F.transform("members", lambda m: m["e"])).when(c("passed"), F.array(endpoint(c("upstream"), secure))).otherwise(F.array())
    return b.withColumn("backends", backends).select("dump", "file", "context", "server_names", "listen", "uri", "directive", "target", F.when(c("passed"), c("upstream")).otherwise("").alias("upstream"), "backends")


def location_blocks(texts: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., uri, start, end): strings.location_block() of each distinct (keys..., uri) that is asked of the texts (keys..., text), null where it finds none.

    Every text is read once, whatever is asked of it. Its lines are rows with a running depth; a line that goes down closes
    the levels that it leaves, and a block ends where its level is closed next after its first brace. What is asked meets the
    lines that begin with the same words, up to a brace or comment sign, and is compared with these only.
    """
    c = F.col
    words = lambda x: F.array_join(F.filter(F.split(F.regexp_replace(x, r"(?s)[{#].*$", ""), r"[\s\u0085\u2028\u2029]+"), lambda w: w != ""), " ")
    count = lambda s, brace: F.length(s) - F.length(F.replace(s, F.lit(brace), F.lit("")))
    lines = texts.select(*keys, F.posexplode(F.split("text", "\r?\n", -1)).alias("line", "s")).withColumn("bare", strings.bare_line(c("s")))
    lines = lines.select(*keys, "line", F.when(F.regexp_like("s", F.lit(r"^[ \t]*location[ \t]+")), c("s")).alias("s"), count(c("bare"), "{").alias("up"), count(c("bare"), "}").alias("down"))
    back = W.partitionBy(*keys).orderBy(F.desc("line")).rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("before", F.sum(c("down") - c("up")).over(back)).withColumn("depth", c("before") + c("up") - c("down"))  # counted from the text's end, as only differences matter: one sort for both
    lines = lines.withColumn("first", F.last(F.when(c("up") > 0, F.struct("line", "depth")), ignorenulls=True).over(back))
    # a row for each opening line at the level around it, and one for each level that a line leaves
    opens = F.when(c("s").isNotNull() & c("first").isNotNull(), F.array(F.struct(c("before").alias("level"), c("first.line").alias("at"), F.lit(False).alias("left"))))
    leaves = F.when(c("depth") < c("before"), F.transform(F.sequence(c("depth"), c("before") - 1), lambda x: F.struct(x.alias("level"), c("line").alias("at"), F.lit(True).alias("left"))))
    none = F.array().cast("array<struct<level:bigint,at:int,left:boolean>>")
    events = lines.select(*keys, c("line").alias("start"), "s", "first", F.explode(F.concat(F.coalesce(opens, none), F.coalesce(leaves, none))).alias("e")).select(*keys, "start", "s", "first", "e.*")
    after = W.partitionBy(*keys, "level").orderBy(F.desc("at"), "left").rowsBetween(W.unboundedPreceding, 0)
    events = events.withColumn("next", F.last(F.when(c("left"), c("at")), ignorenulls=True).over(after)).where("not left")
    blocks = events.select(*keys, "s", "start", F.when(c("first.depth") <= c("level"), c("at")).otherwise(c("next")).alias("end"), words(F.regexp_replace("s", r"^[ \t]*location[ \t]+", "")).alias("words"))
    each = asked.select(*keys, "uri").distinct().withColumn("words", words(c("uri"))).withColumn("opening", F.when(F.size(strings.location_words(c("uri"))) > 0, strings.location_opening(c("uri"))))
    found = each.join(blocks, [*keys, "words"], "left")
    found = found.groupBy(*keys, "uri").agg(F.min(F.when(F.regexp_like("s", c("opening")), F.struct("start", "end"))).alias("x"))
    return found.select(*keys, "uri", F.when(c("x.end").isNotNull(), c("x.start")).alias("start"), c("x.end").alias("end"))
