"""Migrations of a database replayed: statements, tables without row security, open policies, functions that run as their owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.patterns import java, re2
from ..plans.checkpoints import checkpointed
from ..plans.registry import Registry
from ..plans.views import view
from .marks import Mark, bound, marks, marks_sql, newlines

REGISTRY = Registry()
#: What a semicolon doesn't end a statement in: comments, quotes (a doubled quote is two of them), text between dollar tags.
QUOTED = r"--[^\n]*|/\*[\s\S]*?(?:\*/|\z)|'[^']*(?:'|\z)"
#: What lies before a semicolon outside of these, or the end; most letters begin none of them and are passed over in runs.
PART = rf"(?=[\s\S])((?:[^;'$/-]++|{QUOTED}|(\$\w*\$)[\s\S]*?(?:\2|\z)|[^;])*+)(?:;|\z)"
#: The tags that the view uses; RE2 has no way to name a group again.
_TAGGED = Mark("token", QUOTED + r"|\$\$[\s\S]*?(?:\$\$|\z)|\$fn\$[\s\S]*?(?:\$fn\$|\z)|;")
#: What may stand before a statement.
LEAD = r"^(?:\s+|--[^\n]*|/\*[\s\S]*?(?:\*/|\z))*+"
# Migrations, rules of a document store, forms of statements, conditions and points.
MIGRATION, RULES = r"(^|/)supabase/migrations/[^/]+\.sql$", r"(^|/)(?:firestore|storage)\.rules$"
_NAME = r'((?:"?\w+"?\.)?"?\w+"?)'
TABLE = r'(?i)^create\s+(?:unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?((?:"?public"?\.)?"?\w+"?)\s*\('
SECURED = rf"(?i)^alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?{_NAME}\s+(?:force|enable)\s+row\s+level\s+security"
REVOKED = rf"(?i)^revoke\s+(?:execute|all)[\s\S]*?\bon\s+function\s+{_NAME}[\s\S]*\bfrom\b"
FROM, EVERYONE = r"(?i)[\s\S]*\bfrom\b([\s\S]*)$", r"(?i)\b(?:public|anon)\b"
POLICY = rf'(?i)^create\s+policy\s+("[^"]+"|\w+)\s+on\s+{_NAME}'
BUCKETS = r"(?i)^insert\s+into\s+storage\.buckets\b"
BUCKET = r"(?i)\(\s*'([\w-]+)'\s*,\s*'[\w-]+'\s*,\s*true\b"
FUNCTION, DEFINER, TRIGGER = rf"(?i)^create\s+(?:or\s+replace\s+)?function\s+{_NAME}\s*\(", r"(?i)\bsecurity\s+definer\b", r"(?i)\breturns\s+(?:trigger|event_trigger)\b"
SIGNED_IN = r"(?i)auth\.role\(\)\s*=\s*'authenticated'|auth\.uid\(\)\s+is\s+not\s+null|auth\.jwt\(\)\s+is\s+not\s+null"
OWNER = r"(?i)auth\.uid\(\)\s*\)?\s*(?:=|in\b)|=\s*\(?\s*(?:select\s+)?auth\.uid\(\)|auth\.jwt\(\)\s*->>?\s*'(?:sub|email)'|storage\.foldername|\bowner(?:_id)?\s*="
UID, CALLER, SEARCH_PATH = r"(?i)auth\.uid\(\)", r"(?i)auth\.uid\(\)|auth\.jwt\(\)", r"(?i)\bset\s+search_path\b"
ALLOW, MATCH = Mark("allow", r"\ballow\s+([\w\s,]+?)\s*:\s*if\s+([^;]+);", "allow", 2), Mark("match", r"match\s+(/\S+?)\s*\{", "match", 1)
SCORES = {"true": 4, "signed": 4, "bucket": 4, "public bucket": 2, "table": 6, "function": 1, "search_path": 2, "caller": 3, "callable": 1, "anyone": 6, "any user": 4}


def statements(files: DataFrame, key: str = "path", column: str = "text") -> DataFrame:
    """(key, n, pos, line, statement) of each SQL statement, without what stands before it; pos and line are its own.

    One pass cuts a text at its semicolons: comments and quoted text are taken as a whole, so a semicolon inside them is part of them.
    Sums over the lengths of the parts give the places, so no text is looked through from its beginning for each statement. What is
    left behind the last semicolon is a statement unless it is blank. Null and empty texts have none.
    """
    whole = files.select(key, F.explode(F.array(F.coalesce(F.col(column), F.lit("")))).alias("_text"))
    rows = whole.select(key, F.length("_text").alias("_all"), F.posexplode(F.regexp_extract_all("_text", F.lit(java(PART)), F.lit(1))).alias("n", "part"))
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    added = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("long"))
    rows = rows.withColumns({"start": added(F.length("part") + 1), "lines": added(newlines(F.col("part")))})
    lead = F.regexp_extract("part", java(LEAD), 0)
    last = F.col("start") + F.length("part") == F.col("_all")
    placed = rows.where(~last | (F.expr("trim(BOTH ' \t\r\n' FROM part)") != "")).withColumn("lead", lead)
    return placed.select(key, "n", (F.col("start") + F.length("lead")).alias("pos"), (F.col("lines") + newlines(F.col("lead")) + 1).alias("line"), F.substr("part", F.length("lead") + 1).alias("statement"))


def clause(statement: Column, keyword: str) -> Column:
    """What stands between the brackets behind a keyword, trimmed; null without them or where nothing closes them.

    The depth before each letter ) is the number of letters ( less that of letters ) so far, and the first place where it is nought closes. Quotes
    aren't looked at.
    """
    pattern = rf"(?i)\b{keyword}\s*\("
    rest = F.substr(statement, F.length(F.regexp_extract(statement, java(rf"^([\s\S]*?){pattern}"), 0)) + 1)

    def step(so_far: Column, part: Column) -> Column:
        depth = so_far["depth"] + F.length(part) - F.length(F.replace(part, F.lit("("), F.lit("")))
        closing = F.when(so_far["closing"] > 0, so_far["closing"]).when(depth == 0, so_far["n"] + 1).otherwise(0)
        return F.struct((so_far["n"] + 1).alias("n"), (depth - 1).alias("depth"), closing.alias("closing"))

    def held(parts: Column) -> Column:
        closing = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(0).alias("closing")), step, lambda x: x["closing"])
        return bound(closing, lambda c: F.when((c > 0) & (c < F.size(parts)), F.array_join(F.slice(parts, F.lit(1), c), ")")))

    return F.when(statement.rlike(java(pattern)), F.regexp_replace(bound(F.split(rest, r"\)"), held), r"^\s+|\s+\z", ""))


def _of(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit('"'), F.lit("")))


def policy_rows(files: DataFrame) -> DataFrame:
    """score, name, path, line, reason: what the migrations among files (path, text) leave open, replayed.

    A table counts if no migration secures it, a function if it runs as its owner; whether execution was taken back from
    everyone is asked of all migrations. Rows of policies, buckets and rules of a document store stand for themselves. reason
    joins what is said of a row with "; ". Empty tables and texts give no rows.
    """
    text = lambda pattern, group=0: F.regexp_extract("statement", java(pattern), group)
    holds = lambda pattern: F.col("statement").rlike(java(pattern))
    kinds = F.when(holds(TABLE), "table").when(holds(SECURED), "secured").when(holds(REVOKED) & text(FROM, 1).rlike(java(EVERYONE)), "revoked").when(holds(POLICY), "policy").when(holds(BUCKETS), "buckets").when(holds(FUNCTION) & holds(DEFINER) & ~holds(TRIGGER), "function")
    done = checkpointed(statements(files.where(F.col("path").rlike(MIGRATION))).withColumn("kind", kinds).where("kind IS NOT NULL"))
    tables = done.where("kind = 'table'").select("path", "line", scalars.identifier(text(TABLE, 1)).alias("name"))
    secured = done.where("kind = 'secured'").select(scalars.identifier(text(SECURED, 1)).alias("name")).distinct()
    open_tables = tables.join(secured, "name", "left_anti").select(
        F.lit(SCORES["table"]).alias("score"), "name", "path", "line", F.concat(F.lit("row level security is never enabled on "), "name", F.lit(": the Data API serves it to anyone holding the anon key")).alias("reason"))
    revoked = done.where("kind = 'revoked'").select(scalars.identifier(text(REVOKED, 1)).alias("name")).distinct().withColumn("revoked", F.lit(True))
    own = done.where("kind = 'function'").select("path", "line", "statement", scalars.identifier(text(FUNCTION, 1)).alias("name")).join(revoked, "name", "left")
    lacks = [(~holds(SEARCH_PATH), "search_path", "no fixed search_path"), (~holds(CALLER), "caller", "never checks auth.uid()"), (F.col("revoked").isNull(), "callable", "EXECUTE not revoked from public/anon: callable with the anon key through /rpc")]
    points = F.lit(SCORES["function"])
    for lack, word, _ in lacks:
        points = points + F.when(lack, SCORES[word]).otherwise(0)
    said = F.concat_ws("; ", F.lit("SECURITY DEFINER function: runs as its owner and bypasses RLS"), *(F.when(lack, F.lit(reason)) for lack, _, reason in lacks))
    functions = own.select(points.alias("score"), F.concat("name", F.lit("()")).alias("name"), "path", "line", said.alias("reason"))
    held = done.where("kind = 'policy'").select("path", "line", F.replace(text(POLICY, 1), F.lit('"'), F.lit("")).alias("name"), _of(text(POLICY, 2)).alias("on"),
                                               F.array_compact(F.array(clause(F.col("statement"), "using"), clause(F.col("statement"), r"with\s+check"))).alias("says"))
    some = lambda pattern: F.exists("says", lambda x: x.rlike(java(pattern)))
    named = lambda before, after: F.concat(F.lit(before), "name", F.lit('" on '), "on", F.lit(after))
    reason = (
        F.when(some(r"(?i)^true$"), named('policy "', " is `true` for everyone in its roles (fine only for public data)"))
        .when(some(SIGNED_IN) & ~some(OWNER), named('policy "', " checks that the caller is signed in, not that they own the row"))
        .when((F.col("on") == "storage.objects") & (F.size("says") > 0) & ~some(f"{OWNER}|{UID[4:]}"), F.concat(F.lit('storage policy "'), "name", F.lit("\" is scoped to the bucket, not to the object's owner")))
    )
    policies = held.select(F.lit(SCORES["true"]).alias("score"), "name", "path", "line", reason.alias("reason")).where("reason IS NOT NULL")
    seen = done.where("kind = 'buckets'").withColumn("key", F.concat_ws("#", "path", "n"))
    places = marks(seen, [Mark("bucket", BUCKET, "", 1)], "key", "statement").select("key", F.col("line").alias("down"), "g1")
    buckets = places.join(seen.select("key", "path", "line"), "key").select(
        F.lit(SCORES["public bucket"]).alias("score"), F.concat(F.lit("bucket "), "g1").alias("name"), "path", (F.col("line") + F.col("down") - 1).alias("line"),
        F.concat(F.lit('storage bucket "'), "g1", F.lit('" is public: every object is readable by URL (by design?)')).alias("reason"))
    return open_tables.unionByName(functions).unionByName(policies).unionByName(buckets).unionByName(rule_rows(files))


def rule_rows(files: DataFrame) -> DataFrame:
    """Rules of a document store that let everyone or every user in; the last match before a rule says where."""
    found = marks(files.where(F.col("path").rlike(RULES)), [ALLOW, MATCH])
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    where = F.coalesce(F.last(F.when(F.col("mark") == "match", F.col("g1")), True).over(before), F.lit(""))
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rules = found.withColumn("where", where).where("mark = 'allow'").select("path", "line", "where", squeezed("g1").alias("ops"), squeezed("g2").alias("says"))
    anyone, user = F.col("says") == "true", F.col("says").rlike(r"^request\.auth\s*!=\s*null$")
    reason = F.when(anyone, F.concat(F.lit("allow "), "ops", F.lit(": if true on "), "where", F.lit(": anyone, signed in or not"))).otherwise(F.concat(F.lit("allow "), "ops", F.lit(" on "), "where", F.lit(" for any signed-in user: no ownership check")))
    return rules.where(anyone | user).select(F.when(anyone, SCORES["anyone"]).otherwise(SCORES["any user"]).alias("score"), F.col("where").alias("name"), "path", "line", reason.alias("reason"))


def _p(pattern: str) -> str:
    return "'" + re2(pattern) + "'"


_LINES = "(length({0}) - length(replace({0}, chr(10), '')))"
_STATEMENTS = f"""
, ends AS (SELECT path, list(pos ORDER BY pos) AS ends FROM ({marks_sql("v_sql", [_TAGGED])}) WHERE found = ';' GROUP BY path),
cuts AS (SELECT path, text, list_concat(coalesce(ends, []), [length(text)]) AS cuts FROM v_sql LEFT JOIN ends USING (path)),
parts AS (SELECT path, i, len(cuts) AS every, CASE WHEN i = 0 THEN 0 ELSE cuts[i] + 1 END AS start, substring(text, CASE WHEN i = 0 THEN 1 ELSE cuts[i] + 2 END, cuts[i + 1] - CASE WHEN i = 0 THEN 0 ELSE cuts[i] + 1 END) AS part FROM (SELECT *, unnest(range(len(cuts))) AS i FROM cuts)),
led AS (SELECT *, regexp_extract(part, {_p(LEAD)}) AS lead, coalesce(sum({_LINES.format('part')}) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parts),
st AS (SELECT path, i AS n, start + length(lead) AS pos, CAST(before + {_LINES.format('lead')} + 1 AS BIGINT) AS line, substring(part, length(lead) + 1) AS statement FROM led WHERE i < every - 1 OR regexp_matches(part, '\\S'))
"""


def _clause_sql(keyword: str) -> str:
    rest = rf"regexp_replace(statement, '^[\s\S]*?(?i)\b{keyword}\s*\(', '')"
    return (
        f"CASE WHEN regexp_matches(statement, '(?i)\\b{keyword}\\s*\\(') THEN (SELECT regexp_replace(substring(r, 1, min(k) - 1), '^\\s+|\\s+$', '', 'g') FROM (SELECT r, k, sum(CASE substring(r, k, 1) WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (ORDER BY k) AS d "
        f"FROM (SELECT r, unnest(range(1, length(r) + 1)) AS k FROM (SELECT {rest} AS r))) WHERE d = -1 GROUP BY r) END"
    )


@REGISTRY.query(_STATEMENTS + "SELECT * FROM st", "v_sql")
def sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of the documents as migrations."""
    return statements(view(spark, sf_dir, "v_sql"))


_IDENT = "lower(regexp_replace(replace({0}, '\"', ''), '^(?i:public\\.)', ''))"
_POLICIES = _STATEMENTS + f""", d AS (SELECT *, CASE WHEN regexp_matches(statement, {_p(TABLE)}) THEN 'table' WHEN regexp_matches(statement, {_p(SECURED)}) THEN 'secured' WHEN regexp_matches(statement, {_p(REVOKED)}) AND regexp_matches(regexp_extract(statement, {_p(FROM)}, 1), {_p(EVERYONE)}) THEN 'revoked'
  WHEN regexp_matches(statement, {_p(POLICY)}) THEN 'policy' WHEN regexp_matches(statement, {_p(BUCKETS)}) THEN 'buckets'
  WHEN regexp_matches(statement, {_p(FUNCTION)}) AND regexp_matches(statement, {_p(DEFINER)}) AND NOT regexp_matches(statement, {_p(TRIGGER)}) THEN 'function' END AS kind FROM st WHERE regexp_matches(path, {_p(MIGRATION)})),
t AS (SELECT path, line, {_IDENT.format(f"regexp_extract(statement, {_p(TABLE)}, 1)")} AS name FROM d WHERE kind = 'table'),
fn AS (SELECT path, line, statement, {_IDENT.format(f"regexp_extract(statement, {_p(FUNCTION)}, 1)")} AS name FROM d WHERE kind = 'function'),
lacks AS (SELECT path, line, name, NOT regexp_matches(statement, {_p(SEARCH_PATH)}) AS a, NOT regexp_matches(statement, {_p(CALLER)}) AS b, name NOT IN (SELECT {_IDENT.format(f"regexp_extract(statement, {_p(REVOKED)}, 1)")} FROM d WHERE kind = 'revoked') AS c FROM fn),
pol AS (SELECT path, line, replace(regexp_extract(statement, {_p(POLICY)}, 1), '"', '') AS name, lower(replace(regexp_extract(statement, {_p(POLICY)}, 2), '"', '')) AS tab, list_filter([{_clause_sql("using")}, {_clause_sql("with\\s+check")}], lambda x: x IS NOT NULL) AS says FROM d WHERE kind = 'policy'),
said AS (SELECT *, len(list_filter(says, lambda x: regexp_matches(x, '(?i)^true$'))) > 0 AS always, len(list_filter(says, lambda x: regexp_matches(x, {_p(SIGNED_IN)}))) > 0 AS signed, len(list_filter(says, lambda x: regexp_matches(x, {_p(OWNER)}))) > 0 AS owned,
  len(list_filter(says, lambda x: regexp_matches(x, {_p(UID)}))) > 0 AS uid FROM pol),
b AS ({marks_sql("(SELECT concat(path, '#', n) AS key, statement FROM d WHERE kind = 'buckets')", [Mark("bucket", BUCKET, "", 1)], "key", "statement")}),
r AS ({marks_sql(f"(SELECT path, text FROM v_sql WHERE regexp_matches(path, {_p(RULES)}))", [ALLOW, MATCH])}),
rules AS (SELECT path, line, mark, g1, trim(regexp_replace(g1, '\\s+', ' ', 'g')) AS ops, trim(regexp_replace(g2, '\\s+', ' ', 'g')) AS says, coalesce(last_value(CASE WHEN mark = 'match' THEN g1 END IGNORE NULLS) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS w FROM r)
SELECT {SCORES["table"]} AS score, name, path, line, concat('row level security is never enabled on ', name, ': the Data API serves it to anyone holding the anon key') AS reason FROM t WHERE name NOT IN (SELECT {_IDENT.format(f"regexp_extract(statement, {_p(SECURED)}, 1)")} FROM d WHERE kind = 'secured')
UNION ALL SELECT 1 + CASE WHEN a THEN 2 ELSE 0 END + CASE WHEN b THEN 3 ELSE 0 END + CASE WHEN c THEN 1 ELSE 0 END, name || '()', path, line, concat_ws('; ', 'SECURITY DEFINER function: runs as its owner and bypasses RLS', CASE WHEN a THEN 'no fixed search_path' END, CASE WHEN b THEN 'never checks auth.uid()' END, CASE WHEN c THEN 'EXECUTE not revoked from public/anon: callable with the anon key through /rpc' END) FROM lacks
UNION ALL SELECT 4, name, path, line, CASE WHEN always THEN concat('policy "', name, '" on ', tab, ' is `true` for everyone in its roles (fine only for public data)') WHEN signed AND NOT owned THEN concat('policy "', name, '" on ', tab, ' checks that the caller is signed in, not that they own the row')
  ELSE concat('storage policy "', name, '" is scoped to the bucket, not to the object''s owner') END FROM said WHERE always OR (signed AND NOT owned) OR (tab = 'storage.objects' AND len(says) > 0 AND NOT owned AND NOT uid)
UNION ALL SELECT 2, 'bucket ' || g1, d.path, d.line + b.line - 1, concat('storage bucket "', g1, '" is public: every object is readable by URL (by design?)') FROM b JOIN d ON concat(d.path, '#', d.n) = b.key
UNION ALL SELECT CASE says WHEN 'true' THEN 6 ELSE 4 END, w, path, line, CASE says WHEN 'true' THEN concat('allow ', ops, ': if true on ', w, ': anyone, signed in or not') ELSE concat('allow ', ops, ' on ', w, ' for any signed-in user: no ownership check') END FROM rules WHERE mark = 'allow' AND (says = 'true' OR regexp_matches(says, '^request\\.auth\\s*!=\\s*null$'))
"""


@REGISTRY.query(_POLICIES, "v_sql")
def policy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents as migrations and rules leave open."""
    return policy_rows(view(spark, sf_dir, "v_sql"))


QUERIES, ORACLES = REGISTRY.queries, REGISTRY.oracles
