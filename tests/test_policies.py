import random
import re
import time

from assayer.operators.policies import clause, policy_rows, statements
from pyspark.sql import functions as F


def plain(text):
    """(pos, statement) letter by letter."""
    out, start, i = [], 0, 0
    while i < len(text):
        if text.startswith("--", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = end + 1 if end >= 0 else len(text)
        elif text[i] == "'":
            i += 1
            while i < len(text) and not (text[i] == "'" and text[i + 1 : i + 2] != "'"):
                i += 2 if text[i] == "'" else 1
        elif m := re.match(r"\$\w*\$", text[i:], re.A):
            end = text.find(m[0], i + len(m[0]))
            i = end + len(m[0]) - 1 if end >= 0 else len(text)
        elif text[i] == ";":
            out.append((start, text[start:i]))
            start = i + 1
        i += 1
    if text[start:].strip():
        out.append((start, text[start:]))
    led = []
    for at, part in out:
        lead = len(re.match(r"(?:\s+|--[^\n]*|/\*[\s\S]*?(?:\*/|\Z))*", part)[0])
        led.append((at + lead, text[: at + lead].count("\n") + 1, part[lead:]))
    return led


def test_statements_letter_by_letter(spark):
    rng = random.Random(8)
    parts = ["a", " ", "\n", ";", ";", "'", "''", "--", "/*", "*/", "$$", "$x$", "$", "b c", "select 1"]
    texts = ["", None, ";", " ; ;x", "select ';' -- ;\n; /* ; */ b $$ ; $x$ ; $$ ; c", "'" + "it''s;" * 3000, *("".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(400))]
    got = {}
    for r in statements(spark.createDataFrame(list(enumerate(texts)), "path long, text string")).orderBy("path", "n").collect():
        got.setdefault(r.path, []).append((r.pos, r.line, r.statement))
    for i, text in enumerate(texts):
        assert got.get(i, []) == plain(text or ""), text


def test_statements_take_time_by_their_length_only(spark):
    text = "select ';' -- ;\n;" * 20000
    began = time.perf_counter()
    got = statements(spark.createDataFrame([(1, text)], "path long, text string")).agg(F.count("*").alias("n"), F.max("pos").alias("pos"), F.max("line").alias("line")).first()
    assert tuple(got) == (20000, len(text) - 17, 20000) and time.perf_counter() - began < 20


def test_clause_takes_time_by_its_length_only(spark):
    inner = "(a)" * 20000
    began = time.perf_counter()
    got = spark.createDataFrame([(f"x using ({inner}) y",)], "s string").select(clause(F.col("s"), "using").alias("x")).first()
    assert got.x == inner and time.perf_counter() - began < 20


def test_clause(spark):
    rows = [("x using (a (b) c) with check ( (1) )", "a (b) c", "(1)"), ("using(", None, None), ("using ((a)", None, None), ("none", None, None), ("USING ()", "", None), (None, None, None)]
    df = spark.createDataFrame(rows, "s string, a string, b string").select("a", "b", clause(F.col("s"), "using").alias("x"), clause(F.col("s"), r"with\s+check").alias("y"))
    assert all((r.a, r.b) == (r.x, r.y) for r in df.collect())


SQL = """-- first
create table if not exists public."Notes" (id int, body text default 'a;b');
create table open_one (id int);
ALTER TABLE ONLY notes enable row level security;
create policy "Read all" on notes for select using (true);
create policy mine on notes using (auth.uid() = owner_id);
create policy signed on notes using (auth.uid() is not null);
create policy files on storage.objects for insert with check (bucket_id = 'pics');
insert into storage.buckets (id, name, public) values ('pics', 'pics', true),
  ('priv', 'priv', false);
create function public.risky() returns int language sql security definer as $$ select 1; $$;
create or replace function safe(a int) returns int security definer set search_path = '' as $f$ select auth.uid(); $f$;
create function trig() returns trigger security definer as $$ begin; end $$;
"""
RULES = "match /docs/{id} {\n  allow read, write: if true;\n  allow get: if request.auth != null;\n  allow update: if request.auth.uid == x;\n}\n"


def test_policy_rows(spark):
    files = [("supabase/migrations/1.sql", SQL), ("supabase/migrations/2.sql", "revoke execute on function safe(int) from public;\ncreate table late (id int);"), ("supabase/migrations/3.sql", 'alter table "late" force row level security'),
             ("db/other.sql", "create table no (id int);"), ("firestore.rules", RULES), ("supabase/migrations/4.sql", None), ("supabase/migrations/5.sql", "")]
    got = {(r.score, r.name, r.path.split("/")[-1], r.line, r.reason.split(":")[0]) for r in policy_rows(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {
        (6, "open_one", "1.sql", 3, "row level security is never enabled on open_one"),
        (4, "Read all", "1.sql", 5, 'policy "Read all" on notes is `true` for everyone in its roles (fine only for public data)'),
        (4, "signed", "1.sql", 7, 'policy "signed" on notes checks that the caller is signed in, not that they own the row'),
        (4, "files", "1.sql", 8, "storage policy \"files\" is scoped to the bucket, not to the object's owner"),
        (2, "bucket pics", "1.sql", 9, 'storage bucket "pics" is public'),
        (7, "risky()", "1.sql", 11, "SECURITY DEFINER function"),
        (1, "safe()", "1.sql", 12, "SECURITY DEFINER function"),
        (6, "/docs/", "firestore.rules", 2, "allow read, write"),
        (4, "/docs/", "firestore.rules", 3, "allow get on /docs/ for any signed-in user"),
    }
    assert policy_rows(spark.createDataFrame([], "path string, text string")).count() == 0
