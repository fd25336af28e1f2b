"""Route matching against brute force, function scopes, call closure, code facts."""

import random

from pyspark.sql import functions as F

from tracewell.functions.rules import RouteRules
from tracewell.operators import code_scan, procedures, routes
from tracewell.functions import skew
from tracewell.sources.corpora import APP_RULES


def brute_force(calls, backend):
    def key(url):
        return ["{}" if p.startswith("{") else p for p in url.replace("/api/v2", "").strip("/").split("/")]

    listed = [(i, m, key(u), set(u.split("/"))) for i, m, u in sorted(backend)]
    found = {}
    for call_id, method, url in calls:
        hit = next((i for i, m, k, _ in listed if m == method and k == key(url)), None)
        kind = "none" if hit is None else "exact"
        best, parts = 0.6, set(url.split("/"))
        if hit is None:
            for i, m, _, other in listed:
                score = len(parts & other) / len(parts | other)
                if m == method and score > best:
                    best, hit, kind = score, i, "fuzzy"
        found[call_id] = (hit, kind)
    return found


def random_url(rng, words, low, high):
    return "/api/v2/" + "/".join(rng.choice(words) for _ in range(rng.randint(low, high)))


def test_matching_equals_brute_force(spark):
    rng = random.Random(7)
    words = ["users", "items", "{id}", "{userId}", "list", "a", "b", "c"]
    many = [f"w{i}" for i in range(16)]
    calls, backend = [], []
    for i in range(300):
        # A third of the calls share one URL; some URLs are longer than the subset limit.
        url = "/api/v2/users/{id}/items" if i % 3 == 0 else random_url(rng, words, 1, 6) if i % 3 == 1 else random_url(rng, many, 9, 18)
        calls.append((i, rng.choice(["GET", "POST"]), url))
    for i in range(200):
        url = random_url(rng, words, 1, 6) if i % 2 else random_url(rng, many, 8, 20)
        backend.append((i, rng.choice(["GET", "POST"]), url))
    got = routes.mapping_build(
        spark.createDataFrame(calls, "call_id long, method string, url string"),
        spark.createDataFrame(backend, "route_id long, method string, route_pattern string"), APP_RULES).collect()
    expected = brute_force(calls, backend)
    assert {k for _, k in expected.values()} == {"exact", "fuzzy", "none"}
    assert {r.call_id: (r.route_id, r.match_type) for r in got} == expected


def test_equal_scores_take_the_first_route(spark):
    calls = spark.createDataFrame([(1, "GET", "/a/b/c/d/e")], "call_id long, method string, url string")
    backend = spark.createDataFrame(
        [(9, "GET", "/a/b/c/d/x"), (4, "GET", "/a/b/c/d/y"), (2, "PUT", "/a/b/c/d/z")], "route_id long, method string, route_pattern string")
    assert [r.route_id for r in routes.route_match_fuzzy(calls, backend).collect()] == [4]


def test_normalise_url(spark):
    urls = {
        "${V2_URL}/x/${itemId}/${user.accountId}?a=${b}": "/api/v2/x/{item_id}/{accountId}",
        "${V2_WORKFLOW_URL}/y": "/api/v2/workflows/y",
        "/plain/path?x": "/plain/path",
    }
    df = spark.createDataFrame([(i, "GET", u) for i, u in enumerate(urls)], "call_id long, method string, url_raw string")
    assert [r.url for r in routes.url_normalise(df, APP_RULES).orderBy("call_id").collect()] == list(urls.values())


def test_function_scope_over_many_blocks(spark, monkeypatch):
    """One long file cut into small blocks gives the same scopes as a single pass."""
    monkeypatch.setattr(skew, "BLOCK_ROWS", 5)
    lines, expected = [], []
    for n in range(30):
        body = [f"export const fn{n} = async () => {{", "  // not a { brace", "  if (x) {", "    call();", "  }", "};", "", "const y = 1;"]
        lines += body
        expected += [f"fn{n}"] * 6 + [None, None]
    df = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(lines)], "file_id long, line_no int, line string")
    got = code_scan.function_scope(df).orderBy("line_no").collect()
    assert [r.function_name for r in got] == expected


def test_call_closure_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g")], "caller string, callee string")
    roots = spark.createDataFrame([("a",)], "root string")
    got = {r.function_name: r.depth for r in routes.call_closure(edges, roots).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "f": 5, "g": 6}


def test_inherited_equals_the_closure(spark):
    """Random graphs with cycles, and a hub that every function calls."""
    rng = random.Random(9)
    edges = [(f"f{rng.randrange(60)}", f"f{rng.randrange(60)}") for _ in range(110)] + [(f"f{i}", "hub") for i in range(60)] + [("hub", "deep"), ("deep", "hub")]
    facts = [(f"f{rng.randrange(60)}", f"T{rng.randrange(12)}") for _ in range(25)] + [("deep", "HUB_T")]
    frame = spark.createDataFrame(edges, "caller string, callee string")
    known = spark.createDataFrame(facts, "name string, table_name string")
    got = {(r.name, r.table_name) for r in routes.inherited(frame, known, "table_name").collect()}
    roots = spark.createDataFrame([(n,) for n in sorted({x for e in edges for x in e} | {n for n, _ in facts})], "root string")
    closure = routes.call_closure(frame, roots).join(known, F.col("function_name") == F.col("name")).select("root", "table_name").distinct().collect()
    assert got == {(r.root, r.table_name) for r in closure}
    assert routes.inherited(frame.limit(0), known, "table_name").count() == len(set(facts))


def test_nothing_of_one_application_is_built_in(spark):
    df = spark.createDataFrame([(1, "GET", "${V2_URL}/x")], "call_id long, method string, url_raw string")
    assert routes.url_normalise(df).first().url == "{v2_url}/x"
    names = spark.createDataFrame([("Things",)], "model_name string")
    table_map = spark.createDataFrame([("v2_things", "T")], "model string, table_name string")
    assert code_scan.model_resolve(names, table_map).count() == 0 and code_scan.model_resolve(names, table_map, APP_RULES).first().table_name == "T"


def test_urls_of_calls(spark):
    text = (
        "export const a = async () => {\n  const res = await client.get(`${V2_URL}/x/${itemId}`, { responseType: 'blob' });\n};\n"
        "export const b = async () => {\n  const target = \"/api/v2/one\";\n  const other = \"/api/v2/two\";\n  return client.post(target, data);\n};\n"
        "export const c = async () => {\n  return client[\"put\"](\n    \"/api/v2/three\"\n  );\n};\n"
        "export const d = async () => {\n  return client.delete(data);\n};\nexport const e = \"/api/v2/not-d\";\n")
    files = spark.createDataFrame([(1, "src/a.ts", text)], "file_id long, path string, text string")
    got = sorted((r.function_name, r.method, r.url, r.line_no) for r in routes.http_call_url(files).collect())
    assert got == [("b", "POST", "/api/v2/one", 7), ("c", "PUT", "/api/v2/three", 10)]


def test_tables_in_sql(spark):
    rows = [(1, "WITH cte AS (SELECT * FROM BASE_A) SELECT * FROM cte JOIN Customers c ON 1 = 1"), (2, "DELETE FROM orders"), (3, "UPDATE my_tab SET x = 1")]
    df = spark.createDataFrame(rows, "text_id long, text string")
    known = spark.createDataFrame([("BASE_A",)], "table_name string")
    got = {(r.text_id, r.table_name) for r in code_scan.sql_tables(df, known).collect()}
    assert got == {(1, "BASE_A"), (1, "CUSTOMERS"), (3, "MY_TAB")}


def test_route_prefixes(spark):
    rules = RouteRules("/v1", ("admin", "shop"), (("unpaid", "/bills/unpaid"), ("bill", "/bills"), ("user", "/people")), (("usergroups", "/v1/groups"),))
    paths = {
        "app/routers/shop/user.py": "/v1/shop/people", "app/routers/admin/unpaid_bills.py": "/v1/admin/bills/unpaid", "app/routers/usergroups.py": "/v1/groups",
        "app/routers/admin/shop/bill.py": "/v1/admin/shop/bills", "app/routers/x.py": "/v1",
    }
    df = spark.createDataFrame([(i, p, "") for i, p in enumerate(paths)], "file_id long, path string, text string")
    assert {r.path: r.prefix for r in routes.route_prefix(df, rules).collect()} == paths
    assert {r.prefix for r in routes.route_prefix(df).collect()} == {""}



def test_procedure_statements(spark):
    body = (
        "CREATE PROCEDURE P() LANGUAGE SQL AS $$ BEGIN LET t VARCHAR := 'OUT_TAB'; "
        "INSERT INTO IDENTIFIER(:t) (a, b) WITH c AS (SELECT s.x FROM SRC_A s) SELECT c.x, u.y FROM c JOIN SRC_B u ON u.k = c.k "
        "WHERE u.z IN (SELECT w.z FROM SRC_C w) GROUP BY u.y HAVING COUNT(u.q) > 1; "
        "UPDATE TGT SET v = s.v FROM STG s WHERE TGT.id = s.id; -- DELETE FROM NOT_ME;\n END $$")
    df = spark.createDataFrame([(1, "P", "S", body)], "sp_id long, procedure_name string, procedure_schema string, procedure_definition string")
    got = {(r.table_name, r.column_name): r.relationship_types for r in procedures.sp_report(df).collect()}
    assert got == {
        ("OUT_TAB", "*"): "USED_AS_INSERT", ("OUT_TAB", "A"): "USED_AS_INSERT", ("OUT_TAB", "B"): "USED_AS_INSERT",
        ("SRC_A", "*"): "USES_TABLE", ("SRC_A", "X"): "USED_AS_SELECT", ("SRC_B", "*"): "USES_TABLE", ("SRC_B", "K"): "USED_AS_JOIN",
        ("SRC_B", "Y"): "USED_AS_GROUP_BY,USED_AS_SELECT", ("SRC_B", "Z"): "USED_AS_FILTER", ("SRC_B", "Q"): "USED_AS_HAVING",
        ("SRC_C", "*"): "USES_TABLE", ("SRC_C", "Z"): "USED_AS_SELECT", ("TGT", "*"): "USED_AS_UPDATE", ("TGT", "V"): "USED_AS_UPDATE",
        ("TGT", "ID"): "USED_AS_FILTER", ("STG", "*"): "USES_TABLE", ("STG", "V"): "USED_AS_SELECT", ("STG", "ID"): "USED_AS_FILTER",
    }


def test_functions_of_one_name_keep_apart(spark):
    """Every router has ``get`` and ``load``; each route reports the tables of its own file only."""
    router = "from app.services.svc_{k} import fetch\n\n@router.get('/r{k}')\ndef get(db):\n    load(db)\n    fetch(db)\n    common(db)\n\ndef load(db):\n    db.execute(\"SELECT * FROM TBL_A_{k}\")\n"
    service = "def fetch(db):\n    db.execute(\"SELECT * FROM TBL_B_{k}\")\n"
    files = [(k, f"app/routers/r{k}.py", router.format(k=k)) for k in range(4)] + [(10 + k, f"app/services/svc_{k}.py", service.format(k=k)) for k in range(4)]
    files += [(20, "app/common.py", "def common(db):\n    db.execute(\"SELECT * FROM TBL_SHARED\")\n")]
    df = spark.createDataFrame(files, "file_id long, path string, text string")
    rows = {r.backend_file: r.database_tables for r in routes.backend_report(df).collect()}
    assert rows == {f"r{k}.py": f"TBL_A_{k};TBL_B_{k};TBL_SHARED" for k in range(4)}
