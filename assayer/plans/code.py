"""Views of the documents as source files: their words stay, and some of them become code. Valid in Spark and in DuckDB."""

from __future__ import annotations


def literal(text: str) -> str:
    """text as SQL, without quotes or line breaks inside a literal, since the engines read these in ways of their own."""
    parts, plain = [], ""
    for letter in text:
        if letter in "'\n\\":
            parts += [f"'{plain}'"] * bool(plain) + [f"chr({ord(letter)})"]
            plain = ""
        else:
            plain += letter
    parts += [f"'{plain}'"] * bool(plain)
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def rewritten(column: str, words: dict[str, str]) -> str:
    """column with each of the words replaced everywhere, in this order."""
    out = f"coalesce({column}, '')"
    for word, code in words.items():
        out = f"replace({out}, {literal(word)}, {literal(code)})"
    return out


def paths(templates: list[str]) -> str:
    """A path for each doc_id, {n} being the number."""
    cases = " ".join(f"WHEN {n} THEN concat({', '.join(x for x in (literal(t.split('{n}')[0]) if t.split('{n}')[0] else '', 'CAST(doc_id AS STRING)', literal(t.split('{n}')[1])) if x)})" for n, t in enumerate(templates))
    return f"CASE doc_id % {len(templates)} {cases} END"


def _near(times: int, plus: int, rest: int) -> str:
    """A number near a document's own times `times`, which leaves `rest` if divided by 5, as the paths have it."""
    return f"CAST((doc_id * {times} + {plus}) % 900 - (doc_id * {times} + {plus}) % 900 % 5 + {rest} AS STRING)"


#: Every clause of a text is a route, without letters that mean something in code.
_CLAUSES = "replace(translate(coalesce(text, ''), concat('\"(){}[]`', chr(39), chr(92), chr(10), chr(13)), ''), ', ', " + literal("\", requireAuth(h.Show))\n\tr.Get(\"/") + ")"


#: JavaScript in three kinds: each snippet holds one of the things that the scanner looks for, and its opposite stands elsewhere.
JS = [
    {" the ": " app.get('/", ", ": "', getUser(x), (c) => { const y = [1, \"a)(\", `b`]; // (\n", ". ": "\nexport async function POST(req) { await requireUser(req, [1, {a: 2}]); }\n",
     " la ": "\nexport const GET = withAuth(x, \"a(b\", [1, 2]); /* ( */\n", " of ": " router.use('/x', ensureAdmin) ", " be ": "\nexport const { PUT, x as DELETE } = handlers\n", " in ": " basePath('/v1') api.route('/", " en ": "') other.get('/not') "},
    {" the ": "\n  list: protectedProcedure.input(z).query(() => 1), ", " la ": " if (pathname === '/", ", ": "': listAll, ", " of ": " const users = router({ one: tool({}) ", " and ": " case '/", " un ": "': { '/a': listAll, '/b' : 'two' }",
     " is ": " new Set(['/one', '/two/", " le ": "']) path.startsWith('/", " with ": "') const BASE_PATH = '/base' "},
    {" the ": "\n'use server'\n", " la ": "\n'use server'\nexport const save = onCall(async (request) => { request.auth ", " on ": " async function saveIt(a, b) ", " of ": " boss.work('mail', f) x.cron.schedule('nightly', '0 3') ",
     " le ": " new Worker('q', f); server.tool('find', x) '): tool({ a: 1 })\n", ". ": "\nexport const run = async () => { await requireUser(x, getCurrentTeam()) }\n", " and ": " const later = async (q) => { validateRequest(q) "},
]
#: Migrations and rules in four kinds: tables, functions, policies, rules of a document store.
SQL = [
    {". ": ";\ncreate table ", " the ": " (id int, n text); ", " la ": " (id int); ", ", ": ";\nalter table only public.", " of ": " enable row level security; ", " le ": " force row level security; ", " and ": " 'it''s; ' -- no; end\n"},
    {". ": ";\n\ncreate or replace function \"Public\".", " the ": "() returns int security definer as $$ select 1; $$; ", " la ": "(a int) returns trigger security definer as $fn$ x; $$ $fn$; ", ", ": ";\n/* a; b */ revoke execute on function ",
     " of ": " (int) from public, anon; ", " le ": " () security definer set search_path = '' as $$ select auth.uid(); $$; ", " is ": " () security definer; "},
    {". ": ";\ncreate policy ", " the ": " on public.notes for select using (true); ", " la ": " on storage.objects for all using (bucket_id = 'a' and (x = 1)); ", " of ": " on Posts using ((select auth.uid()) = owner) with check ( auth.role() = 'authenticated' ); ",
     " le ": " on docs using (auth.uid() is not null) ", " and ": ";\ninsert into storage.buckets (id) values ('pics', 'pics', true),\n ('x-y','x',false), ('a','a',true);\n", " is ": " on docs with  check (auth.jwt() is not null "},
    {" the ": "\nmatch /docs/{id} {\n", " la ": "\nmatch /own/{x=**} {", ", ": " allow read,\n write: if  true; ", " of ": " allow get : if request.auth  != null; ", ". ": "\n allow update: if request.auth.uid == owner;"},
]
#: Routes in groups: what opens a group and what closes one stand in an order of their own.
PHP = {
    " the ": "\nRoute::middleware(['auth', \"can:see\"])->prefix('/", ", ": "')->group(function () {\n", " of ": "\nRoute::get('/a/{id}', [App\\Http\\UserController::class, 'show'])->middleware('throttle:1');\n", ". ": "\n});\n",
    " and ": "\nRoute::match(['get', 'post'], 'm', 'Other@run')->withoutMiddleware(['auth', 'web']);\n", " la ": "\nRoute::group(['prefix' => 'p', 'middleware' => ['web', 'admin']], function () { // {\n",
    " le ": "\nRoute::resource('/posts', Post::class)->middleware([\"verified\"]);\n", " is ": "\nRoute::name('x.')->middleware('own')->post(\"b\", \\Foo\\Bar::class);\n",
}
_USE_SERVER = "CASE WHEN doc_id % 3 = 0 THEN " + literal("// actions\n'use server';\n") + " ELSE '' END"
CODE_VIEWS = {
    "v_js": (
        "documents",
        [
            "doc_id",
            paths(["app/(shop)/w{n}/route.ts", "src/server/r{n}.ts", "src/app/x{n}/@side/page.tsx", "pages/api/p{n}/index.ts", "supabase/functions/f{n}/index.ts", "apps/w{n}/middleware.ts", "tests/t{n}.ts", "lib/a{n}.js",
                   "app/webhooks/h{n}/route.js", "lib/b{n}.mjs", "functions/src/c{n}.ts", "docs/d{n}.md"]) + " AS path",
            f"concat({_USE_SERVER}, CASE WHEN doc_id % 5 = 0 THEN 'config = {{ matcher: [*] }} export function middleware() ' ELSE '' END, CASE doc_id % 7 WHEN 0 THEN {rewritten('text', JS[1])} WHEN 3 THEN {rewritten('text', JS[1])} "
            f"WHEN 1 THEN {rewritten('text', JS[2])} WHEN 5 THEN {rewritten('text', JS[2])} ELSE {rewritten('text', JS[0])} END) AS text",
        ],
    ),
    "v_go": (
        "documents",
        [
            "doc_id", "concat('p', CAST(doc_id % 7 AS STRING), '/r', CAST(doc_id AS STRING), '.go') AS path",
            "concat(" + ", ".join([
                literal("package x\n\nimport \"github.com/go-chi/chi/v5\"\n\nfunc Routes"), "CAST(doc_id AS STRING)", literal("(r chi.Router, h *Handler) {\n\tr.Use(logger)\n"),
                *(x for n in (1, 2) for x in (literal("\tr.Route(\"/p"), "CAST(doc_id AS STRING)", literal(f"\", func(s chi.Router) {{\n\t\ts.Use(requireRole{n}(cfg))\n\t\tRoutes"), f"CAST(doc_id * 2 + {n} AS STRING)", literal("(s, h)\n\t})\n"))),
                literal("\tr.Get(\"/"), _CLAUSES, literal("\", h.Show)\n\tr.Use(late)\n}\n"), "CASE WHEN doc_id = 0 THEN " + literal("\nfunc main() {\n\tr := chi.NewRouter()\n\tr.Use(h.session)\n\tRoutes0(r, h)\n}\n") + " ELSE '' END",
            ]) + ") AS text",
        ],
    ),
    "v_imports": (
        "documents",
        [
            "doc_id",
            paths(["src/d{n}/index.ts", "src/m{n}.tsx", "lib/x{n}.js", "src/deep/er/m{n}.mts", "lib/x{n}/index.jsx"]) + " AS path",
            "concat(" + ", ".join([
                literal("import a from '../../lib/x"), _near(7, 3, 2), literal("'\nconst b = require(\"@/m"), _near(3, 1, 1), literal("\")\nexport * from './../src/d"), _near(11, 5, 0), literal("/'\nconst c = await import(`~/er/m"), _near(13, 2, 3),
                literal(".mjs`)\nimport react from 'react'\nimport './../x"), _near(5, 4, 4), literal("'\nimport \"./../../../up\"\n"), "coalesce(text, '')",
            ]) + ") AS text",
        ],
    ),
    "v_php": ("documents", ["doc_id", paths(["routes/web{n}.php", "a{n}/routes/api.php", "x{n}/routes/console.php", "b{n}/routes/more.php", "c{n}/lib/routes.php"]) + " AS path", f"{rewritten('text', PHP)} AS text"]),
    "v_sql": (
        "documents",
        [
            "doc_id",
            paths(["supabase/migrations/{n}_a.sql", "app/supabase/migrations/{n}.sql", "supabase/migrations/9{n}_p.sql", "web{n}/firestore.rules", "db/{n}.sql"]) + " AS path",
            f"CASE doc_id % 5 WHEN 1 THEN {rewritten('text', SQL[1])} WHEN 2 THEN {rewritten('text', SQL[2])} WHEN 3 THEN {rewritten('text', SQL[3])} ELSE {rewritten('text', SQL[0])} END AS text",
        ],
    ),
}
