"""Routes of PHP applications: nested groups with their prefixes and middleware, and access rules of which the first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.patterns import java, re2
from ..plans.checkpoints import checkpointed
from ..plans.registry import Registry
from ..plans.views import table, view
from .brackets import pairs, tokens, tokens_sql
from .marks import BLOCK, Mark, marks, marks_sql, within

REGISTRY = Registry()
# Files of routes, verbs, and forms of groups, middleware, handlers and access rules.
ROUTES, NOT_ROUTES, API = r"(^|/)routes/[\w-]+\.php$", r"(^|/)routes/(?:console|channels)\.php$", r"(^|/)routes/api\.php$"
_CHAIN = r"Route::(?:\w+\((?:[^()]+|\([^()]*\))*+\)\s*->\s*)*"
_LIST = r"""(\[[^\]]*\]|['"][^'"]*['"])"""
VERBS = "get|post|put|patch|delete|options|any|match|resource|apiResource"
MARKS = [
    Mark("group", rf"{_CHAIN}group\s*\(", "Route::"),
    Mark("brace", r"\{"),
    Mark("route", rf"""{_CHAIN}({VERBS})\s*\(\s*(\[[^\]]*\]\s*,\s*)?('[^'"]*'|"[^'"]*")""", "Route::", 3),
    Mark("middleware", rf"((?i:without)?)(?i:middleware)\(\s*{_LIST}", "iddleware(", 2),
    Mark("prefix", r"""prefix\(\s*['"]([^'"]*)['"]""", "prefix(", 1),
    Mark("key-middleware", rf"""['"]middleware['"]\s*=>\s*{_LIST}""", "middleware", 1),
    Mark("key-prefix", r"""['"]prefix['"]\s*=>\s*['"]([^'"]*)['"]""", "prefix", 1),
    Mark("method-of", r"""\[\s*\\?([\w\\]+)::class\s*,\s*['"](\w+)['"]\s*\]""", "::class", 2),
    Mark("class-at", r"""['"]([\w\\]+)@(\w+)['"]""", "@", 2),
    Mark("class", r",\s*\\?([\w\\]+)::class\s*[,)]", "::class", 1),
]
HANDLERS = ["method-of", "class-at", "class"]
QUOTED = r"""['"]([^'"]+)['"]"""
ACCESS = r"(?m)^[ \t]*access_control\s*:\s*\n((?:[ \t]+.*\n?)*+)"
ACCESS_ITEM, ACCESS_PATH, ACCESS_ROLES = r"-\s*\{([^}]*)\}", r"""path\s*:\s*['"]?([^,'"}]+)""", r"""roles\s*:\s*(\[[^\]]*\]|['"]?[\w,]+['"]?)"""


def _quoted(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(java(QUOTED)), F.lit(1))


def _trimmed(path: Column) -> Column:
    return F.regexp_replace(path, r"^/+|/+$", "")


def laravel_routes(files: DataFrame) -> DataFrame:
    """(path, pos, line, name, route, middleware, handler_class, handler_method) of the routes in files (path, text) of routes.

    A group spans from the brace behind it to the one that closes it, which the table of brackets tells. A route lies in all groups that begin before
    it and end behind it; their prefixes and middleware count in the order in which they begin, then its own middleware, each name once,
    without those that its statement takes away. Statements end at a semicolon outside their own brackets. Null and empty texts have no
    routes, and a group that nothing closes reaches to the end.
    """
    path = F.col("path")
    files = files.where(path.rlike(ROUTES) & ~path.rlike(NOT_ROUTES)).select("path", F.explode(F.array(F.coalesce("text", F.lit("")))).alias("text"))
    found = checkpointed(marks(files, MARKS).withColumn("end", F.col("pos") + F.length("found")))
    of = checkpointed(tokens(files))
    size = files.select("path", F.length("text").cast("long").alias("length"))
    mark = lambda *names: found.where(F.col("mark").isin(*names))
    # groups: the first brace behind each, and what its chain or the array before the brace says
    at_ends = mark("group").select("path", "pos", "end", F.col("end").alias("at"), F.lit(True).alias("group")).unionByName(mark("brace").select("path", F.col("pos").alias("at"), F.lit(False).alias("group")), allowMissingColumns=True)
    behind = Window.partitionBy("path").orderBy(F.desc("at"), "group").rowsBetween(Window.unboundedPreceding, -1)
    braces = at_ends.withColumn("open", F.last(F.when(~F.col("group"), F.col("at")), True).over(behind)).where("group AND open IS NOT NULL").select("path", "pos", "end", "open")
    closed = pairs(of).select("path", F.col("pos").alias("open"), "close")
    groups = checkpointed(braces.join(closed, ["path", "open"], "left").join(size, "path").withColumn("close", F.coalesce("close", "length")).withColumn("chained", F.lit(False)))
    plain = F.col("found").startswith("Route::group")
    heads = mark("group").select("path", F.col("pos").alias("g"), F.col("end").alias("g_end"), plain.alias("plain")).join(groups.select("path", F.col("pos").alias("g"), "open"), ["path", "g"])
    inside = found.select("path", F.col("pos").alias("place"), F.length("found").alias("size"), F.col("pos").alias("m"), "mark", "found", "g1", "g2")
    in_chain = within(heads.where("NOT plain").select("path", "g", F.col("g").alias("pos"), F.col("g_end").alias("until")), inside.where((F.col("mark") == "prefix") | ((F.col("mark") == "middleware") & F.col("found").startswith("middleware"))))
    in_array = within(heads.where("plain").select("path", "g", F.col("g_end").alias("pos"), F.col("open").alias("until")), inside.where(F.col("mark").isin("key-middleware", "key-prefix")))
    said = in_chain.unionByName(in_array).select("path", "g", "m", "mark", "g1", "g2")
    names = F.when(F.col("mark") == "middleware", _quoted(F.col("g2"))).when(F.col("mark") == "key-middleware", _quoted(F.col("g1")))
    first = F.row_number().over(Window.partitionBy("path", "g", "mark").orderBy("m"))
    # an array names its middleware once, a chain may do so again and again
    said = said.withColumns({"names": names, "first": first}).where("mark = 'middleware' OR first = 1")
    held = said.groupBy("path", F.col("g").alias("pos")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("names").isNotNull(), F.struct("m", "names")))), lambda x: x["names"])).alias("names"),
        F.max(F.when(F.col("mark").isin("prefix", "key-prefix"), F.col("g1"))).alias("prefix"))
    spans = groups.select("path", "pos", "open", "close").join(held, ["path", "pos"], "left").select("path", "open", "close", F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.coalesce("prefix", F.lit("")).alias("prefix"))
    # routes: the depth where each begins, and the first semicolon that isn't deeper
    step = F.when(F.col("token").isin(*"({["), 1).when(F.col("token").isin(*")}]"), -1).otherwise(0)
    both = of.select("path", "pos", step.alias("step"), F.lit(None).cast("boolean").alias("route")).unionByName(mark("route").select("path", "pos", F.lit(0).alias("step"), F.lit(True).alias("route")))
    depth = F.sum("step").over(Window.partitionBy("path").orderBy("pos", F.col("route").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begun = both.withColumn("depth", depth).where("route").select("path", "pos", "depth")
    ends = begun.select("path", "pos").join(first_not_deeper(begun, of.where("token = ';'").select("path", F.col("pos").alias("semi"), "level")), ["path", "pos"], "left")
    routes = checkpointed(mark("route").join(ends, ["path", "pos"]).join(size, "path").select("path", "pos", "line", F.col("g1").alias("verb"), F.col("g2").alias("methods"), F.substring("g3", F.lit(2), F.length("g3") - 2).alias("own_path"), F.coalesce("semi", "length").alias("until")))
    outer = routes.select("path", "pos").join(spans, "path").where("open < pos AND pos < close").groupBy("path", "pos").agg(F.array_sort(F.collect_list(F.struct("open", "names", "prefix"))).alias("groups"))
    parts = within(routes.select("path", "pos", "until"), inside.where(F.col("mark").isin("middleware", *HANDLERS)))
    listed = lambda which: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("m", _quoted(F.col("g2")).alias("names"))))), lambda x: x["names"]))
    middleware = F.col("mark") == "middleware"
    rank = F.array_position(F.array(*map(F.lit, HANDLERS)), F.col("mark"))
    own = parts.groupBy("path", "pos").agg(listed(middleware & (F.col("g1") == "")).alias("own"), listed(middleware & F.col("found").startswith("withoutMiddleware")).alias("without"),
                                           F.min(F.when(~middleware, F.struct(rank, "m", "mark", "g1", "g2"))).alias("h"))
    none = F.array().cast("array<string>")
    rows = routes.join(outer, ["path", "pos"], "left").join(own, ["path", "pos"], "left")
    every = F.concat(F.coalesce(F.flatten(F.transform("groups", lambda g: g["names"])), none), F.coalesce("own", none))
    prefixes = F.transform(F.coalesce(F.transform("groups", lambda g: g["prefix"]), none), lambda p: _trimmed(p))
    base = F.when(path.rlike(API), F.array(F.lit("api"))).otherwise(none)
    url = F.concat(F.lit("/"), F.array_join(F.filter(F.concat(base, prefixes, F.array(_trimmed(F.col("own_path")))), lambda p: p != ""), "/"))
    called = F.when(F.col("verb").isin("resource", "apiResource"), "RESOURCE").when(F.col("verb") == "match", F.upper(F.array_join(_quoted(F.col("methods")), ","))).otherwise(F.upper("verb"))
    method = F.when(F.col("h").isNotNull(), F.when(F.col("h.mark") == "class", "__invoke").otherwise(F.col("h.g2")))
    return rows.select("path", "pos", "line", called.alias("name"), url.alias("route"), F.array_except(F.array_distinct(every), F.coalesce("without", none)).alias("middleware"), F.element_at(F.split("h.g1", r"\\"), -1).alias("handler_class"), method.alias("handler_method"))


def first_not_deeper(places: DataFrame, semis: DataFrame) -> DataFrame:
    """(path, pos, semi) of places (path, pos, depth) with the first of semis (path, semi, level) behind each whose level isn't over depth.

    It is looked for in the block of the place, and in the next block that holds one of such a level, which the least levels of blocks
    tell; so a place meets the blocks of its file and what is in two of them.
    """
    held = semis.withColumn("_block", (F.col("semi") / BLOCK).cast("long"))
    asked = checkpointed(places.select("path", "pos", "depth", (F.col("pos") / BLOCK).cast("long").alias("_block")))
    least = held.groupBy("path", F.col("_block").alias("_later")).agg(F.min("level").alias("least"))
    later = asked.join(least, "path").where("_later > _block AND least <= depth").groupBy("path", "pos", "depth").agg(F.min("_later").alias("_block"))
    met = asked.unionByName(later).join(held, ["path", "_block"]).where("semi > pos AND level <= depth")
    return met.groupBy("path", "pos").agg(F.min("semi").alias("semi"))


def access_rules(configs: DataFrame) -> DataFrame:
    """(root, n, pattern, roles) of the access_control blocks of config/packages/security.yaml and the like (path, text), in their order."""
    block = F.regexp_extract("text", java(ACCESS), 1)
    items = configs.where(F.col("path").rlike(r"(^|/)config/packages/security\.ya?ml$")).select(F.regexp_replace("path", r"(?:^|/)config/.*$", "").alias("root"), F.posexplode(F.regexp_extract_all(block, F.lit(java(ACCESS_ITEM)), F.lit(1))).alias("n", "item"))
    pattern, roles = F.trim(F.regexp_extract("item", java(ACCESS_PATH), 1)), F.regexp_replace(F.regexp_extract("item", java(ACCESS_ROLES), 1), r"""[\[\]'"\s]""", "")
    return items.select("root", "n", pattern.alias("pattern"), roles.alias("roles")).where("pattern <> ''")


def first_rules(routes: DataFrame, rules: DataFrame) -> DataFrame:
    """(root, route, n, pattern, roles) of the first rule of its root by n that each of routes (root, route) matches; routes without one aren't there.

    A pattern that is tied to the beginning and begins with plain letters, without alternatives, can only match routes that begin with them; such
    rules meet routes by these letters, and only the others meet every route of their root. So many lengths as the rules of
    a root have are looked up for each distinct route. Of the matches the least is kept before rows are shuffled. What is no pattern matches nothing.
    """
    valid = rules.where(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("pattern")).isNotNull())
    # a letter before a quantifier may be missing
    letters = F.regexp_extract("pattern", r"^\^((?:[\w/-](?![?*{]))*+)", 1)
    keyed = checkpointed(valid.withColumn("letters", F.when(F.col("pattern").contains("|"), "").otherwise(letters)).withColumn("size", F.length("letters")))
    sizes = keyed.groupBy("root").agg(F.collect_set("size").alias("sizes"))
    looked = routes.select("root", "route").where("route IS NOT NULL").distinct().join(sizes, "root").select("root", "route", F.explode("sizes").alias("size")).where("size <= length(route)")
    met = looked.withColumn("letters", F.substring("route", F.lit(1), F.col("size"))).join(keyed, ["root", "size", "letters"]).where("route RLIKE pattern")
    return met.groupBy("root", "route").agg(F.min(F.struct("n", "pattern", "roles")).alias("first")).select("root", "route", "first.*")


_P = [f"'{re2(m.pattern)}'" for m in MARKS]
_Q = f"'{re2(QUOTED)}'"
_ROUTES_SQL = tokens_sql("files").replace("\n, t AS", ", t AS", 1)
_LARAVEL = f"""
, files AS (SELECT path, text FROM v_php WHERE regexp_matches(path, '{ROUTES}') AND NOT regexp_matches(path, '{NOT_ROUTES}')){_ROUTES_SQL},
m AS (SELECT *, pos + length(found) AS ends FROM ({marks_sql("files", MARKS)})),
g0 AS (SELECT g.path, g.pos, g.ends, starts_with(g.found, 'Route::group') AS plain, min(b.pos) AS open FROM m g JOIN m b ON b.path = g.path AND b.mark = 'brace' AND b.pos >= g.ends WHERE g.mark = 'group' GROUP BY ALL),
kp AS (SELECT path, pos, lead(pos) OVER (PARTITION BY path, level ORDER BY pos) AS close FROM k WHERE token NOT IN (',', ';')),
g1 AS (SELECT g0.*, coalesce(kp.close, length(files.text)) AS close FROM g0 JOIN files USING (path) LEFT JOIN kp ON kp.path = g0.path AND kp.pos = g0.open),
gm AS (SELECT g1.path, g1.pos, list(x.names ORDER BY x.pos) AS names FROM g1 JOIN (SELECT path, pos, ends, mark, found, CASE mark WHEN 'middleware' THEN regexp_extract_all(g2, {_Q}, 1) ELSE regexp_extract_all(g1, {_Q}, 1) END AS names FROM m WHERE mark IN ('middleware', 'key-middleware')) x
  ON x.path = g1.path AND ((NOT plain AND x.mark = 'middleware' AND starts_with(x.found, 'middleware') AND x.pos >= g1.pos AND x.ends <= g1.ends)
    OR (plain AND x.mark = 'key-middleware' AND x.pos = (SELECT min(y.pos) FROM m y WHERE y.path = g1.path AND y.mark = 'key-middleware' AND y.pos >= g1.ends AND y.ends <= g1.open))) GROUP BY ALL),
gp AS (SELECT g1.path, g1.pos, arg_min(x.g1, x.pos) AS prefix FROM g1 JOIN m x ON x.path = g1.path AND ((NOT plain AND x.mark = 'prefix' AND x.pos >= g1.pos AND x.ends <= g1.ends) OR (plain AND x.mark = 'key-prefix' AND x.pos >= g1.ends AND x.ends <= g1.open)) GROUP BY g1.path, g1.pos),
g AS (SELECT g1.path, open, close, coalesce(flatten(names), []) AS names, coalesce(prefix, '') AS prefix FROM g1 LEFT JOIN gm USING (path, pos) LEFT JOIN gp USING (path, pos)),
r0 AS (SELECT r.path, r.pos, r.line, r.g1 AS verb, r.g2 AS methods, r.g3[2:-2] AS own, coalesce((SELECT sum(step) FROM t WHERE t.path = r.path AND t.pos < r.pos), 0) AS depth FROM m r WHERE r.mark = 'route'),
r AS (SELECT r0.*, coalesce((SELECT min(k.pos) FROM k WHERE k.path = r0.path AND k.token = ';' AND k.pos > r0.pos AND k.level <= r0.depth), length(files.text)) AS until FROM r0 JOIN files USING (path)),
o AS (SELECT r.path, r.pos, flatten(list(g.names ORDER BY open)) AS names, list(regexp_replace(g.prefix, '^/+|/+$', '', 'g') ORDER BY open) AS prefixes FROM r JOIN g ON g.path = r.path AND g.open < r.pos AND r.pos < g.close GROUP BY r.path, r.pos),
w AS (SELECT r.path, r.pos, flatten(list(regexp_extract_all(x.g2, {_Q}, 1) ORDER BY x.pos) FILTER (x.g1 = '')) AS own, flatten(list(regexp_extract_all(x.g2, {_Q}, 1) ORDER BY x.pos) FILTER (starts_with(x.found, 'withoutMiddleware'))) AS without FROM r JOIN m x ON x.path = r.path AND x.mark = 'middleware' AND x.pos >= r.pos AND x.ends <= r.until GROUP BY r.path, r.pos),
h AS (SELECT r.path, r.pos, arg_min(struct_pack(mark := x.mark, a := x.g1, b := x.g2), list_position({HANDLERS}, x.mark) * 10000000 + x.pos) AS h FROM r JOIN m x ON x.path = r.path AND x.mark IN {tuple(HANDLERS)} AND x.pos >= r.pos AND x.ends <= r.until GROUP BY r.path, r.pos),
e AS (SELECT r.path, r.pos, unnest(list_concat(coalesce(o.names, []), coalesce(w.own, []))) AS name, generate_subscripts(list_concat(coalesce(o.names, []), coalesce(w.own, [])), 1) AS i, coalesce(w.without, []) AS without FROM r LEFT JOIN o USING (path, pos) LEFT JOIN w USING (path, pos)),
mw AS (SELECT path, pos, string_agg(name, ',' ORDER BY i) AS middleware FROM (SELECT path, pos, name, min(i) AS i FROM e WHERE NOT list_contains(without, name) GROUP BY ALL) GROUP BY path, pos)
SELECT r.path, r.pos, r.line, CASE WHEN verb IN ('resource', 'apiResource') THEN 'RESOURCE' WHEN verb = 'match' THEN upper(array_to_string(regexp_extract_all(methods, {_Q}, 1), ',')) ELSE upper(verb) END AS name,
  '/' || array_to_string(list_filter(list_concat(CASE WHEN regexp_matches(r.path, '{API}') THEN ['api'] ELSE [] END, list_concat(coalesce(prefixes, []), [regexp_replace(r.own, '^/+|/+$', '', 'g')])), lambda x: x <> ''), '/') AS route, coalesce(middleware, '') AS middleware,
  list_extract(string_split(h.h.a, chr(92)), -1) AS handler_class, CASE WHEN h.h.mark = 'class' THEN '__invoke' ELSE h.h.b END AS handler_method FROM r LEFT JOIN o USING (path, pos) LEFT JOIN mw USING (path, pos) LEFT JOIN h USING (path, pos)
"""


@REGISTRY.query(_LARAVEL, "v_php")
def php_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes of the documents as files of routes."""
    return laravel_routes(view(spark, sf_dir, "v_php")).withColumn("middleware", F.array_join("middleware", ","))


#: A fixed list of rules, one of them no pattern, one without a beginning, one with alternatives.
_RULES = [("^/a(n|u)", "ROLE_A"), ("^/th$", "ROLE_TH"), ("ing$", ""), ("^/(unclosed", "NEVER"), ("^/er|/on", "ROLE_ER,ROLE_ON"), ("^/es?t", "ROLE_E"), ("^/th", "ROLE_T"), ("^/the/admin", "ROLE_X"), ("^/[b-d]", "PUBLIC_ACCESS"), ("^/ou+", "ROLE_OU")]
_YAML = "security:\n  access_control:\n" + "".join(f"    - {{ path: {p}, roles: {'[' + r + ']' if r else '[]'} }}\n" for p, r in _RULES) + "other:\n    - { path: ^/, roles: NO }\n"
_CASES = ", ".join(f"({n}, '{p}', '{r}')" for n, (p, r) in enumerate(_RULES) if "unclosed" not in p)


@REGISTRY.query(
    f"WITH w AS (SELECT DISTINCT '/' || lower(unnest(string_split(text, ' '))) AS route FROM documents WHERE text IS NOT NULL), x AS (SELECT route, n, pattern, roles, row_number() OVER (PARTITION BY route ORDER BY n) AS k FROM w JOIN (VALUES {_CASES}) r(n, pattern, roles) ON regexp_matches(route, pattern)) SELECT route, n, pattern, roles FROM x WHERE k = 1"
)
def access_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule of a fixed list for every word of the documents as a route."""
    rules = access_rules(spark.createDataFrame([("config/packages/security.yaml", _YAML)], "path string, text string"))
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return first_rules(words.select(F.lit("").alias("root"), F.concat(F.lit("/"), F.lower("word")).alias("route")), rules).drop("root")


QUERIES, ORACLES = REGISTRY.queries, REGISTRY.oracles
