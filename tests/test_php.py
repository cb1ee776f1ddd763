import random
import re

from assayer.operators.php import access_rules, first_rules, laravel_routes

WEB = r"""<?php
Route::get('/home', [App\Http\HomeController::class, 'index']);
Route::middleware(['auth', 'verified'])->prefix('admin')->group(function () {
    Route::get('/users', 'UserController@list')->middleware("can:see")->withoutMiddleware('verified');
    Route::prefix('/deep/')->group(function () {
        Route::match(['get', "post"], 'x', \App\Run::class); // }
        Route::resource('posts', Post::class)->middleware(['auth', 'throttle']);
    });
    Route::post('/s', fn () => ['a;b', f(';')]);
});
Route::group(['prefix' => 'api2', 'middleware' => ['token', 'web']], function () {
    Route::delete('/it/{id}', [It::class, 'drop']);
});
Route::any('/last', 'L@go')
"""
API = "Route::middleware('auth:api')->group(function () { Route::put('me', 'Me@put');"


def test_nested_groups(spark):
    files = [("routes/web.php", WEB), ("app/routes/api.php", API), ("routes/console.php", WEB), ("lib/web.php", WEB), ("routes/empty.php", ""), ("routes/null.php", None)]
    got = {(r.path.split("/")[-1], r.line, r.name, r.route, ",".join(r.middleware), r.handler_class, r.handler_method) for r in laravel_routes(spark.createDataFrame([(*f, 1) for f in files], "path string, text string, pos int")).collect()}
    assert got == {
        ("web.php", 2, "GET", "/home", "", "HomeController", "index"),
        ("web.php", 4, "GET", "/admin/users", "auth,can:see", "UserController", "list"),
        ("web.php", 6, "GET,POST", "/admin/deep/x", "auth,verified", "Run", "__invoke"),
        ("web.php", 7, "RESOURCE", "/admin/deep/posts", "auth,verified,throttle", "Post", "__invoke"),
        ("web.php", 9, "POST", "/admin/s", "auth,verified", None, None),
        ("web.php", 12, "DELETE", "/api2/it/{id}", "token,web", "It", "drop"),
        ("web.php", 14, "ANY", "/last", "", "L", "go"),
        ("api.php", 1, "PUT", "/api/me", "auth:api", "Me", "put"),
    }
    assert laravel_routes(spark.createDataFrame([], "path string, text string")).count() == 0


def test_access_rules_of_a_file(spark):
    text = "security:\n  access_control:\n    # first\n    - { path: ^/admin, roles: [ROLE_A, 'ROLE_B'] }\n    - { path: '^/me$', roles: ROLE_USER }\n    - { roles: NO }\n    - { path: ^/open }\nother:\n  - { path: ^/x, roles: Y }\n"
    rows = [("app/config/packages/security.yaml", text), ("config/other.yaml", text), ("config/packages/security.yml", None)]
    got = [(r.root, r.n, r.pattern, r.roles) for r in access_rules(spark.createDataFrame(rows, "path string, text string")).orderBy("n").collect()]
    assert got == [("app", 0, "^/admin", "ROLE_A,ROLE_B"), ("app", 1, "^/me$", "ROLE_USER"), ("app", 3, "^/open", "")]


def test_first_rule_wins_for_many_routes(spark):
    rng = random.Random(10)
    letters = lambda n: "".join(rng.choices("abcde/-", k=n))
    rules = []
    for root in ("", "x"):
        for n in range(40):
            p = letters(rng.randrange(1, 5))
            rules.append((root, n, rng.choice([f"^/{p}", f"^/{p}?", f"^/{p}$", f"{p}$", f"^/{p}|^/b", f"^/{p}+/", f"^/({p}|c)", f"^/{p}.d", "^/(", "^/" + letters(12)]), f"R{n}"))
    routes = [("hot" if i % 3 == 0 else rng.choice(["", "x"]), "/" + letters(rng.randrange(8))) for i in range(100_000)] + [("", None), ("", ""), ("none", "/a")]
    frame = spark.createDataFrame(rules + [("hot", n, p, r) for root, n, p, r in rules if root == ""], "root string, n int, pattern string, roles string")
    got = {(r.root, r.route): (r.n, r.roles) for r in first_rules(spark.createDataFrame(routes, "root string, route string"), frame).collect()}
    plain = {root: [(n, re.compile(p), r) for of, n, p, r in rules if of == ("" if root == "hot" else root) and p != "^/("] for root in ("", "x", "hot")}
    want = {}
    for root, route in set(routes):
        for n, p, r in plain.get(root, []):
            if route is not None and p.search(route):
                want[root, route] = (n, r)
                break
    assert len(want) > 1000 and got == want
