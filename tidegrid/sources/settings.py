"""Settings that applications declare: YAML and properties texts, build files, and the configuration centre they point to.

A short generator walks XML; indentation is read by windows over lines, and everything that is decided
(which profile, which identity, which file belongs to which module) is joins, aggregations and columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import udtf

from tidegrid.functions import strings
from tidegrid.operators.graph import settle
from tidegrid.sources.parsers import lines

c = F.col
# Where the keys of the configuration centre begin, and below the names that these keys have.
CENTRE = "spring.cloud.nacos.config."
#: Values that aren't literals: placeholders, and what begins a YAML structure, alias or block.
NOT_LITERAL = r"\$\{|^[\[{&*!|>]"
# Endings of settings files.
CONFIG_ENDINGS = ("properties", "yaml", "yml", "xml", "conf", "ini", "json", "toml")
IDENTITY = ("address", "namespace", "group", "data_id")


@udtf(returnType="node int, parent int, xpath string, text string, attributes map<string,string>")
class XmlNodes:
    """Elements of an XML text with their path of local names, in order; none of a text that isn't well-formed."""

    def eval(self, text: str) -> Iterator[tuple]:
        try:
            left = [(ElementTree.fromstring(text or ""), -1, "")]
        except ElementTree.ParseError:
            return
        n = 0
        while left:
            e, parent, above = left.pop()
            path = f"{above}/{e.tag.rsplit('}', 1)[-1]}"
            yield n, parent, path, (e.text or "").strip(), dict(e.attrib)
            left += [(kid, n, path) for kid in reversed(e)]
            n += 1


def scalars(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep..., document, line, indent, path, value) of the keys of YAML texts; keep has none of these names.

    A key with nothing after its colon has no value and opens a level for deeper lines.  A line's path: for each depth that is less than its own, the
    last line above it of that depth or less, if it has just that depth and opens a level.  Sequences, flow collections and blocks are not read.
    """
    texts = df.select(*keep, F.monotonically_increasing_id().alias("_text"), text_col)
    rows = lines(texts, text_col, *keep, "_text").withColumnRenamed("line", "_line").withColumnRenamed("line_no", "line")
    cut = c("_line").rlike(r"^(---|\.\.\.)(\s+#.*|\s*)$")
    rows = rows.withColumn("_part", F.sum(cut.cast("int")).over(W.partitionBy("_text").orderBy("line"))).where(~cut)
    rows = rows.withColumn("document", F.dense_rank().over(W.partitionBy("_text").orderBy("_part")) - 1)
    form = r"^( *)([\w.-]+):(\s.*)?$"
    tail = F.regexp_extract("_line", form, 3)
    bare = F.trim(F.regexp_replace(F.regexp_replace(tail, r"^\s+|\s+$", ""), r"\s+#.*$", ""))
    value = F.when(tail != "", F.regexp_replace(bare, r"^([\"'])(.*)\1$", "$2"))
    keys = rows.where(c("_line").rlike(form)).select(*keep, "_text", "document", "line", F.length(F.regexp_extract("_line", form, 1)).alias("indent"), F.regexp_extract("_line", form, 2).alias("_key"), value.alias("value"))
    every = keys.withColumn("_depths", F.collect_set("indent").over(W.partitionBy("_text", "document"))).withColumn("_depth", F.explode("_depths"))
    above = W.partitionBy("_text", "document", "_depth").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    near = F.last(F.when(c("indent") <= c("_depth"), F.struct("indent", "_key", c("value").isNull().alias("opens"))), ignorenulls=True).over(above)
    every = every.withColumn("_near", near)
    parent = F.when((c("_depth") < c("indent")) & (c("_near.indent") == c("_depth")) & c("_near.opens"), F.struct("_depth", "_near._key"))
    same = [F.first(k).alias(k) for k in (*keep, "indent", "value", "_key")]
    made = every.groupBy("_text", "document", "line").agg(*same, F.array_sort(F.collect_list(parent)).alias("_parents"))
    return made.select(*keep, "document", "line", "indent", F.concat_ws(".", F.col("_parents._key"), "_key").alias("path"), "value")


def fields(found: DataFrame, *keep: str) -> DataFrame:
    """(keep..., document, values, repeated): a map of the scalars that a document states once, and the paths it states more often."""
    each = found.groupBy(*keep, "document", "path").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    return each.groupBy(*keep, "document").agg(
        F.map_from_entries(F.collect_list(F.when((c("n") == 1) & c("value").isNotNull(), F.struct("path", "value")))).alias("values"),
        F.array_sort(F.collect_list(F.when(c("n") > 1, c("path")))).alias("repeated"),
    )


def _value(*paths: str) -> Column:
    """The first of the paths' values that isn't empty."""
    return F.coalesce(*[F.nullif(c("values")[p], F.lit("")) for p in paths], F.lit(""))


def _literal(*values: Column) -> Column:
    return ~F.exists(F.array(*values), lambda v: v.rlike(NOT_LITERAL))


def _off(path: str) -> Column:
    return F.coalesce(F.lower(c("values")[path]) == "false", F.lit(False))


def direct_declarations(f: DataFrame, *keep: str) -> DataFrame:
    """Identities that nacos.config names in a document: (keep..., document, address, namespace, group, data_id); none unless all its values are literals stated once."""
    p = "nacos.config."
    paths = [p + k for k in ("enabled", "server-addr", "serverAddr", "data-id", "dataId", "group", "namespace", "username", "password")] + ["nacos.enabled"]
    address, data_id, space = _value(p + "server-addr", p + "serverAddr"), _value(p + "data-id", p + "dataId"), _value(p + "namespace")
    group = F.coalesce(F.nullif(_value(p + "group"), F.lit("")), F.lit("DEFAULT_GROUP"))
    fine = ~F.arrays_overlap("repeated", F.array(*map(F.lit, paths))) & ~_off("nacos.enabled") & ~_off(p + "enabled") & (address != "") & (data_id != "")
    stated = ~F.exists(F.array(*map(F.lit, paths)), lambda k: F.coalesce(c("values")[k] == "", F.lit(False)))
    return f.where(fine & stated & _literal(*[F.coalesce(c("values")[k], F.lit("")) for k in paths])).select(*keep, "document", address.alias("address"), space.alias("namespace"), group.alias("group"), data_id.alias("data_id"))


def business_declarations(found: DataFrame, *keep: str) -> DataFrame:
    """Identities below a top-level nacos: (keep..., document, address, namespace, group, data_id, resolved); a list of ids gives one row each, an unstated group stays empty."""
    names = ("dataId", "nacosUrl", "namespace", "group", "enabled", "username", "password")
    f = fields(found.where((c("indent") == 2) & c("path").isin(*[f"nacos.{k}" for k in names])), *keep)
    f = f.where((F.size("repeated") == 0) & ~_off("nacos.enabled") & c("values")["nacos.dataId"].isNotNull())
    out = f.select(*keep, "document", _value("nacos.nacosUrl").alias("address"), _value("nacos.namespace").alias("namespace"), _value("nacos.group").alias("group"), F.explode(F.transform(F.split(c("values")["nacos.dataId"], ","), lambda x: F.trim(x))).alias("data_id"))
    return out.withColumn("resolved", (c("data_id") != "") & (c("address") != "") & (c("namespace") != "") & _literal(c("data_id"), c("group"), c("address"), c("namespace")))


def _profile_of() -> Column:
    return _value("spring.profiles", "spring.config.activate.on-profile")


def spring_declarations(f: DataFrame, command: Column, *keep: str) -> DataFrame:
    """Identities of the profile that is active: (keep..., profile, address, namespace, group, data_id, problem).

    Name and profile come from the documents without a profile, where they may not disagree, and from the command line, which goes
    first.  Just one document may declare the centre for that profile; its name, the name with
    extension, and with profile and extension are asked for.  Otherwise one row says what the problem is.  command: of f's rows.
    """
    option = lambda key: F.array_distinct(F.transform(F.filter(strings.arguments(c("_command")), lambda a: a.startswith(f"-D{key}=") | a.startswith(f"--{key}=")), lambda a: F.substring_index(a, f"{key}=", -1)))
    declares = F.exists(F.map_keys("values"), lambda k: k.startswith(CENTRE))
    rows = f.withColumn("_command", command).withColumn("own", _profile_of()).withColumn("declares", declares)
    shared = lambda key: F.array_sort(F.collect_set(F.when(c("own") == "", c("values")[key])))
    known = rows.groupBy(*keep).agg(shared("spring.application.name").alias("names"), shared("spring.profiles.active").alias("profiles"), F.min("_command").alias("_command"), F.max("declares").alias("any")).where("any")
    names, profiles = option("spring.application.name"), option("spring.profiles.active")
    clash = (F.size("names") > 1) | (F.size("profiles") > 1) | (F.size(names) > 1) | (F.size(profiles) > 1)
    first = lambda given, stated: F.coalesce(F.get(given, F.lit(0)), F.get(c(stated), F.lit(0)), F.lit(""))
    known = known.select(*keep, clash.alias("clash"), first(names, "names").alias("name"), (F.size(names) > 0).alias("given"), first(profiles, "profiles").alias("profile"))
    fits = rows.where("declares").join(known, list(keep)).where((c("own") == "") | (c("own") == c("profile")))
    one = fits.groupBy(*keep).agg(F.count("*").alias("n"), F.first("values").alias("values"), F.first("repeated").alias("repeated"))
    out = known.join(one, list(keep), "left")
    get = lambda *k: _value(*[CENTRE + x for x in k])
    name = F.when(c("given"), c("name")).otherwise(F.coalesce(F.nullif(_value("spring.application.name"), F.lit("")), c("name")))
    prefix = F.coalesce(F.nullif(get("prefix", "name"), F.lit("")), name)
    ending = F.coalesce(F.nullif(get("file-extension", "fileExtension"), F.lit("")), F.lit("properties"))
    group = F.coalesce(F.nullif(get("group"), F.lit("")), F.lit("DEFAULT_GROUP"))
    fine = prefix.rlike(r"^[\w.-]+$") & ending.rlike(r"^[\w-]+$") & (get("server-addr", "serverAddr") != "") & _literal(get("server-addr", "serverAddr"), group, get("namespace"), get("username"), get("password"))
    problem = (
        F.when(c("clash"), "conflicting name or profile").when(~c("profile").rlike(r"^[\w.-]+$"), "no single profile")
        .when(F.coalesce("n", F.lit(0)) != 1, "not one declaration for the profile").when(F.exists("repeated", lambda p: p.startswith("spring.")), "repeated field").when(~fine, "unresolved value")
    )
    ids = F.when(problem.isNull(), F.array(prefix, F.concat_ws(".", prefix, ending), F.concat(prefix, F.lit("-"), c("profile"), F.lit("."), ending))).otherwise(F.array(F.lit(None).cast("string")))
    made = out.where(~F.coalesce(_off(CENTRE + "enabled"), F.lit(False)) | problem.isNotNull())
    return made.select(*keep, "profile", get("server-addr", "serverAddr").alias("address"), get("namespace").alias("namespace"), group.alias("group"), F.explode(ids).alias("data_id"), problem.alias("problem"))


def shared_declarations(f: DataFrame, profile: Column, *keep: str) -> DataFrame:
    """Shared ids that a document lists: (keep..., document, address, namespace, group, data_id, resolved); the active profile's placeholder is filled in."""
    keys = [CENTRE + k for k in ("shared-dataids", "sharedDataids", "shared-data-ids")]
    stated = F.array_distinct(F.filter(F.array(*[c("values")[k] for k in keys]), lambda v: F.coalesce(v != "", F.lit(False))))
    address, space = _value(CENTRE + "server-addr", CENTRE + "serverAddr"), _value(CENTRE + "namespace")
    rows = f.where((F.size(stated) == 1) & ~_off(CENTRE + "enabled")).select(*keep, "document", address.alias("address"), space.alias("namespace"), F.lit("DEFAULT_GROUP").alias("group"), profile.alias("_p"), F.explode(F.split(stated[0], ",")).alias("raw"))
    filled = F.when(F.coalesce(c("_p"), F.lit("")) != "", F.regexp_replace(F.trim("raw"), F.lit(r"\$\{spring\.profiles\.active(?::[^}]*)?\}"), c("_p"))).otherwise(F.trim("raw"))
    return rows.withColumn("data_id", filled).withColumn("resolved", (c("address") != "") & _literal(c("address"), c("namespace")) & c("data_id").rlike(r"^[\w.:-]+$") & c("data_id").contains(".")).drop("_p", "raw")


def profiles(f: DataFrame, *keep: str) -> DataFrame:
    """(keep..., profile) that documents name, each once."""
    keys = ("spring.profiles", "spring.config.activate.on-profile", "spring.profiles.active")
    return f.select(*keep, F.explode(F.array(*[c("values")[k] for k in keys])).alias("profile")).where(c("profile").rlike(r"^[\w.-]+$")).distinct()


# properties --------------------------------------------------------------------------------------
def properties(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep..., line_no, key, value, plain) of single-line properties; plain is false where escapes or continuations leave a line unresolved."""
    form = r"^\s*([\w.\[\]-]+)\s*[=:]\s*(.*)$"
    rows = lines(df, text_col, *keep).where(~c("line").rlike(r"^\s*[#!]"))
    return rows.select(*keep, "line_no", F.regexp_extract("line", form, 1).alias("key"), F.trim(F.regexp_extract("line", form, 2)).alias("value"), (c("line").rlike(form) & ~c("line").contains("\\")).alias("plain"))


def properties_as_fields(found: DataFrame, *keep: str) -> DataFrame:
    """The fields() of a properties text, which is one document."""
    return fields(found.where("plain").select(*keep, F.lit(0).alias("document"), c("key").alias("path"), "value"), *keep)


def extension_declarations(f: DataFrame, *keep: str) -> DataFrame:
    """Indexed extensions: (keep..., index, address, namespace, group, data_id, resolved); what an index leaves out comes from nacos.config, the group from nothing."""
    p = "nacos.config."
    off = _off(p + "enabled") | _off(p + "bootstrap.enable")
    index = F.array_distinct(F.filter(F.transform(F.map_keys("values"), lambda k: F.regexp_extract(k, r"^nacos\.config\.ext-config\[(\d+)\]\.data-id$", 1)), lambda x: x != ""))
    base_repeated = F.arrays_overlap("repeated", F.array(*[F.lit(p + k) for k in ("server-addr", "namespace", "username", "password")]))
    rows = f.where(~off & ~base_repeated).select(*keep, "values", "repeated", F.explode(index).alias("index"))
    own = lambda k: c("values")[F.concat(F.lit(p + "ext-config["), c("index"), F.lit(f"].{k}"))]
    either = lambda k: F.coalesce(own(k), c("values")[p + k], F.lit(""))
    group = F.coalesce(F.nullif(own("group"), F.lit("")), F.lit("DEFAULT_GROUP"))
    twice = F.exists("repeated", lambda r: r.startswith(F.concat(F.lit(p + "ext-config["), c("index"), F.lit("]."))))
    fine = ~twice & own("data-id").rlike(r"^[\w.:-]+$") & (either("server-addr") != "") & _literal(either("server-addr"), either("namespace"), either("username"), either("password"), group)
    return rows.select(*keep, c("index").cast("int").alias("index"), either("server-addr").alias("address"), either("namespace").alias("namespace"), group.alias("group"), own("data-id").alias("data_id"), F.coalesce(fine, F.lit(False)).alias("resolved"))


def resolve_placeholders(text: Column, values: Column, repeated: Column) -> Column:
    """A document's text with ${path} replaced by its own literal of that path, if that is stated once and looks like an address or a name."""
    usable = F.filter(F.map_entries(values), lambda e: e["value"].rlike(r"^[A-Za-z0-9_.:/-]+$") & ~F.exists(repeated, lambda r: (e["key"] == r) | e["key"].startswith(F.concat(r, F.lit(".")))))
    return F.aggregate(usable, text, lambda t, e: F.replace(t, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"]))


def merge_declarations(declared: DataFrame, derived: DataFrame, *keep: str) -> DataFrame:
    """(keep..., address, namespace, group, data_id, derived): each identity once; one that is also declared isn't derived."""
    cols = [*keep, *IDENTITY]
    both = declared.select(*cols, F.lit(False).alias("derived")).unionByName(derived.select(*cols, F.lit(True).alias("derived")))
    return both.groupBy(*cols).agg(F.min("derived").alias("derived"))


def missing_or_warning(wanted: DataFrame, fetched: DataFrame, *keep: str) -> DataFrame:
    """(keep..., identity..., status): fetched; missing for a derived identity that isn't there; warning for a declared one."""
    got = fetched.select(*keep, *IDENTITY).distinct().withColumn("got", F.lit(True))
    status = F.when(c("got"), "fetched").when(c("derived"), "missing").otherwise("warning")
    return wanted.join(got, [*keep, *IDENTITY], "left").select(*keep, *IDENTITY, status.alias("status"))


# build files -------------------------------------------------------------------------------------
# Environments, and the file names that carry one.
ENVIRONMENTS = ("dev", "test", "uat", "prod")
ENVIRONMENT_FILE = r"^(?:application|bootstrap)[-_](dev|test|uat|prod)(?:\.|$)"


def file_environment(path: Column) -> Column:
    """The environment that a file's own name carries, else that of its topmost folder with such a name, else other."""
    low = F.lower(path)
    named = F.nullif(F.regexp_extract(strings.base_name(low), ENVIRONMENT_FILE, 1), F.lit(""))
    above = F.array_intersect(F.split(_folder(low), "/"), F.array(*map(F.lit, ENVIRONMENTS)))  # in the order of the path
    return F.coalesce(named, F.get(above, F.lit(0)), F.lit("other"))


def ant_pattern(pattern: Column) -> Column:
    """Regular expression of an Ant-style pattern that is a column; strings.glob_regex for those known beforehand."""
    out = F.regexp_replace(pattern, r"([.+^${}()|\[\]\\])", r"\\$1")
    for mark, text in (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", ".*")):
        out = F.replace(out, F.lit(mark), F.lit(text))
    return F.concat(F.lit("^"), out, F.lit("$"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _join(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name))


def build_files(files: DataFrame) -> DataFrame:
    """(repository, path, node, parent, xpath, text) of the elements of all build files; files: (repository, path, content)."""
    poms = files.where(strings.base_name(c("path")) == "pom.xml")
    return settle(poms.lateralJoin(XmlNodes(c("content").outer())).select("repository", "path", "node", "parent", "xpath", "text"), "build")


def reachable_builds(nodes: DataFrame) -> DataFrame:
    """(repository, path) of the build files below the root's modules; where there is no root, of all of them."""
    every = nodes.select("repository", "path").distinct()
    rooted = every.where("path = 'pom.xml'")
    name = F.regexp_replace("text", "^(\\./)+|/+$", "")
    steps = nodes.where("xpath = '/project/modules/module' and text <> ''").select("repository", "path", _join(_folder(c("path")), F.concat(name, F.lit("/pom.xml"))).alias("next")).distinct()
    found = front = rooted
    while True:  # ends when no new build file is found
        step = front.join(steps, ["repository", "path"]).select("repository", c("next").alias("path")).distinct()
        front = settle(step.join(every, ["repository", "path"], "left_semi").join(found, ["repository", "path"], "left_anti"), "modules")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.unionByName(every.join(rooted.select("repository"), "repository", "left_anti"))


def find_modules(nodes: DataFrame, apps: DataFrame) -> DataFrame:
    """(repository, app, module, packaging, basis, status) of applications (repository, app, kind).

    A module whose final name is the application, its own and its parent's artifact filled in, goes first; then one whose
    name has -exec; then a folder of the name.  War and jar modules go before others, and for a war
    the only war.  status: unique, ambiguous or none.
    """
    here = nodes.join(reachable_builds(nodes), ["repository", "path"], "left_semi")
    text = lambda xpath: F.min(F.when((c("xpath") == xpath) & (c("text") != ""), c("text")))
    finals = F.array_sort(F.collect_set(F.when((c("xpath") == "/project/build/finalName") & (c("text") != ""), c("text"))))
    m = here.groupBy("repository", "path").agg(text("/project/artifactId").alias("artifact"), text("/project/parent/artifactId").alias("above"), F.coalesce(text("/project/packaging"), F.lit("jar")).alias("packaging"), finals.alias("finals"))
    fill = lambda s: F.regexp_replace(F.regexp_replace(s, F.lit(r"\$\{(project\.)?parent\.artifactId\}"), F.coalesce("above", F.lit("\\${parent}"))), F.lit(r"\$\{(project\.)?artifactId\}"), F.coalesce("artifact", F.lit("\\${artifactId}")))
    m = m.select("repository", _folder(c("path")).alias("module"), "packaging", "finals", F.filter(F.transform("finals", fill), lambda s: ~s.contains("${")).alias("resolved"))
    names = m.select("repository", "module", "packaging", F.explode("resolved").alias("n"), "finals")
    asked = apps.select("repository", "app", "kind")
    plain = names.join(asked, (names["repository"] == asked["repository"]) & ((c("n") == c("app")) | (c("n") == F.concat("app", F.lit("-exec"))))).select(asked["repository"], "app", "kind", "module", "packaging", F.when(F.array_contains("finals", c("app")), "finalName").when(c("n") == c("app"), "finalName by artifact").otherwise("finalName -exec").alias("basis"))
    folder = m.withColumn("leaf", strings.base_name(c("module"))).join(asked, "repository").where((c("leaf") != "") & (c("leaf") == F.regexp_replace("app", r"(?:（废弃）|\(废弃\)|-废弃)$", ""))).select("repository", "app", "kind", "module", "packaging", F.lit("folder").alias("basis"))
    found = plain.unionByName(folder.join(plain.select("repository", "app").distinct(), ["repository", "app"], "left_anti")).dropDuplicates(["repository", "app", "module"])
    rank = F.when((c("kind").isin("war", "war8")) & (c("packaging") == "war"), 2).when(c("packaging").isin("war", "jar"), 1).otherwise(0)
    each = found.withColumn("rank", rank).groupBy("repository", "app", "rank").agg(F.count("*").alias("n"), F.min(F.struct("module", "packaging", "basis")).alias("x"))
    level = lambda r: F.max(F.when(c("rank") == r, F.struct("n", "x")))
    pick = each.groupBy("repository", "app").agg(level(2).alias("two"), level(1).alias("one"), level(0).alias("zero"))
    only_war = c("two.n") == 1
    n = F.when(only_war, 1).otherwise(F.coalesce(F.nullif(F.coalesce(c("two.n"), F.lit(0)) + F.coalesce(c("one.n"), F.lit(0)), F.lit(0)), c("zero.n")))
    x = F.coalesce(c("two.x"), c("one.x"), c("zero.x"))
    out = asked.select("repository", "app").distinct().join(pick.select("repository", "app", n.alias("n"), x.alias("x")), ["repository", "app"], "left")
    return out.select("repository", "app", *[F.when(c("n") == 1, c(f"x.{k}")).alias(k) for k in ("module", "packaging", "basis")], F.when(c("n").isNull(), "none").when(c("n") == 1, "unique").otherwise("ambiguous").alias("status"))


def resource_rules(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """(repository, module, source, includes, excludes, filtering, certain) of unique modules; src/main/resources where a build names none."""
    at = nodes.withColumn("module", _folder(c("path")))
    base = "/project/build/resources/resource"
    block = at.where(c("xpath") == base).select("repository", "module", c("node").alias("resource"))
    kid = at.where(c("xpath").startswith(base + "/")).select("repository", "module", "node", "parent", "xpath", "text")
    direct = kid.where(c("xpath").isin(base + "/directory", base + "/filtering")).select("repository", "module", c("parent").alias("resource"), "xpath", "text")
    lists = kid.where(c("xpath").isin(base + "/includes", base + "/excludes")).select("repository", "module", c("parent").alias("resource"), c("node").alias("list"))
    items = kid.where(c("xpath").isin(base + "/includes/include", base + "/excludes/exclude")).select("repository", "module", c("parent").alias("list"), "xpath", "text").join(lists, ["repository", "module", "list"]).drop("list")
    all_ = block.join(direct.unionByName(items), ["repository", "module", "resource"], "left").where("text is null or text <> ''")
    texts = lambda leaf: F.array_sort(F.collect_set(F.when(c("xpath") == base + leaf, c("text"))))
    made = all_.groupBy("repository", "module", "resource").agg(texts("/directory").alias("d"), texts("/includes/include").alias("i"), texts("/excludes/exclude").alias("excludes"), texts("/filtering").alias("f"))
    stated = made.select("repository", "module", F.get("d", F.lit(0)).alias("directory"), F.when(F.size("i") > 0, c("i")).otherwise(F.array(F.lit("**/*"))).alias("includes"), "excludes", (F.lower(F.get("f", F.lit(0))) == "true").alias("filtering"), ((F.size("d") == 1) & ~F.coalesce(F.get("d", F.lit(0)).contains("${"), F.lit(False))).alias("certain"))
    asked = modules.where("status = 'unique'").select("repository", "module").distinct()
    none = asked.join(block.select("repository", "module").distinct(), ["repository", "module"], "left_anti").select("repository", "module", F.lit("src/main/resources").alias("directory"), F.array(F.lit("**/*")).alias("includes"), F.array().cast("array<string>").alias("excludes"), F.lit(False).alias("filtering"), F.lit(True).alias("certain"))
    out = stated.join(asked, ["repository", "module"], "left_semi").unionByName(none)
    return out.select("repository", "module", _join(c("module"), F.regexp_replace("directory", "^(\\./)+|/+$", "")).alias("source"), "includes", "excludes", F.coalesce("filtering", F.lit(False)).alias("filtering"), "certain")


def configuration_files(files: DataFrame, modules: DataFrame, rules: DataFrame) -> DataFrame:
    """(repository, app, path, relative, environment) of the settings that a unique module packs: below a source folder, included, not excluded, each path once."""
    wanted = rules.where("certain").join(modules.where("status = 'unique'").select("repository", "app", "module"), ["repository", "module"])
    config = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*CONFIG_ENDINGS)).select("repository", "path")
    inside = config.join(wanted, "repository").where(c("path").startswith(F.concat("source", F.lit("/")))).withColumn("relative", F.substr("path", F.length("source") + F.lit(2)))
    hit = lambda patterns: F.exists(patterns, lambda p: F.regexp_like("relative", ant_pattern(p)))
    kept = inside.where(hit("includes") & ~hit("excludes"))
    return kept.groupBy("repository", "app", "path").agg(F.min("relative").alias("relative")).withColumn("environment", file_environment(c("relative")))
