"""Hand-written definitions: odd but legal texts, and what must be refused."""

import pytest

from tracewell.operators import facts, resolve

TEXTS = {
    "nested groups": ("CREATE VIEW V (A) AS SELECT COALESCE(NVL(t.a, (t.b + (t.c * (1)))), 0) AS A FROM T t",
                      [("A", "DERIVED", "T", "A; B; C", "COALESCE")]),
    "alias without AS": ("CREATE VIEW V (A, B) AS SELECT t.x A, t.y + 1 B FROM sch.T t",
                         [("A", "DIRECT", "SCH.T", "X", ""), ("B", "DERIVED", "SCH.T", "Y", "ADD")]),
    "comma and keyword in literal": ("CREATE VIEW V (A, B) AS SELECT CASE WHEN t.x = 'a, FROM (b' THEN 1 END AS A, t.y AS B FROM T t",
                                     [("A", "DERIVED", "T", "X", "CASE"), ("B", "DIRECT", "T", "Y", "")]),
    "comments": ("CREATE VIEW V (A) AS -- first, (\nSELECT t.x /* , t.z */ AS A FROM T t",
                 [("A", "DIRECT", "T", "X", "")]),
    "quoted names": ('CREATE VIEW "V" ("A") AS SELECT "t"."X" AS "A" FROM "T" "t"', [("A", "DIRECT", "T", "X", "")]),
    "mixed case": ("create view V (Col_A) as select T1.Colx as col_a from Tab T1", [("COL_A", "DIRECT", "TAB", "COLX", "")]),
    "prefix names": ("CREATE VIEW V (A) AS WITH c1 AS (SELECT t.a AS a FROM T t), c10 AS (SELECT u.a AS a FROM U u) SELECT c10.a AS A FROM c10",
                     [("A", "DIRECT", "U", "A", "")]),
    "same alias in two scopes": ("CREATE VIEW V (A, B) AS WITH c AS (SELECT x.a AS a FROM T x) SELECT c.a AS A, x.b AS B FROM c JOIN U x ON x.k = c.a",
                                 [("A", "DIRECT", "T", "A", ""), ("B", "DIRECT", "U", "B", "")]),
    "by position": ("CREATE VIEW V (A, B) AS SELECT t.x, UPPER(t.y) FROM T t", [("A", "DIRECT", "T", "X", ""), ("B", "DERIVED", "T", "Y", "ANONYMOUS")]),
    "qualified star": ("CREATE VIEW V (A, B) AS SELECT u.*, t.b AS B FROM T t JOIN U u ON t.k = u.k", [("A", "DIRECT", "U", "A", ""), ("B", "DIRECT", "T", "B", "")]),
    "bare column, last join first": ("CREATE VIEW V (A) AS SELECT a FROM T JOIN U ON U.k = T.k JOIN W ON W.k = T.k", [("A", "DIRECT", "W", "A", "")]),
    "bare column owned by a subquery": ("CREATE VIEW V (A) AS WITH c AS (SELECT t.a AS a FROM T t) SELECT a AS A FROM c JOIN U ON U.k = c.a", [("A", "DIRECT", "T", "A", "")]),
    "two sources": ("CREATE VIEW V (A) AS SELECT t.a || u.b AS A FROM T t, U u", [("A", "DERIVED", "T; U", "A; B", "DPIPE")]),
    "derived inside a chain": ("CREATE VIEW V (A) AS WITH c AS (SELECT SUM(t.a) AS s FROM T t) SELECT c.s AS A FROM c", [("A", "DERIVED", "T", "A", "SUM")]),
    "distinct and window": ("CREATE VIEW V (A) AS SELECT DISTINCT LAG(t.a) OVER (PARTITION BY t.b ORDER BY t.c) AS A FROM T t", [("A", "DERIVED", "T", "A; B; C", "WINDOW")]),
    "is distinct from": ("CREATE VIEW V (A) AS SELECT t.a IS DISTINCT FROM t.b AS A FROM T t", [("A", "DERIVED", "T", "A; B", "BINARY")]),
    "cast and path": ("CREATE VIEW V (A, B) AS SELECT t.a::INT AS A, t.v:path.x::STRING AS B FROM T t", [("A", "DERIVED", "T", "A", "CAST"), ("B", "DERIVED", "T", "V", "CAST")]),
    "constant": ("CREATE VIEW V (A) AS SELECT 'x' AS A FROM T t", [("A", "DERIVED", "CALCULATED", "LITERAL", "LITERAL")]),
    "cycle": ("CREATE VIEW V (X) AS WITH a AS (SELECT b.x FROM b), b AS (SELECT a.x FROM a) SELECT a.x FROM a", [("X", "UNKNOWN", "UNKNOWN", "UNKNOWN", "")]),
    "reversed chain": ("CREATE VIEW V (X) AS WITH a AS (SELECT b.x FROM b), b AS (SELECT c.x FROM c), c AS (SELECT t.x FROM T t) SELECT a.x FROM a", [("X", "DIRECT", "T", "X", "")]),
    "missing column": ("CREATE VIEW V (A, Z) AS SELECT t.a AS A FROM T t", [("A", "DIRECT", "T", "A", ""), ("Z", "DIRECT", "T", "Z", "")]),
    "table columns only": ("CREATE TABLE V (A NUMBER(10, 2), CONSTRAINT k PRIMARY KEY (A))", [("A", "UNKNOWN", "UNKNOWN", "UNKNOWN", "")]),
    "identifier": ("CREATE VIEW V (A) AS SELECT * FROM IDENTIFIER('S.T')", [("A", "DIRECT", "S.T", "A", "")]),
    "identifier without literal": ("CREATE VIEW V (A) AS SELECT * FROM IDENTIFIER(:t)", [("ERROR", "ERROR", "ANALYSIS_ERROR", "ANALYSIS_ERROR", "ERROR")]),
    "nested derived tables": ("CREATE VIEW V (A) AS SELECT x.a AS A FROM (SELECT y.a FROM (SELECT t.a FROM T t) y) x", [("A", "DIRECT", "T", "A", "")]),
    "thirty levels": ("CREATE VIEW V (A) AS SELECT " + "(" * 30 + "t.a" + ")" * 30 + " AS A FROM T t", [("A", "DERIVED", "T", "A", "PAREN")]),
    "open group": ("CREATE VIEW V (A) AS SELECT (t.a AS A FROM T t", [("ERROR", "ERROR", "ANALYSIS_ERROR", "ANALYSIS_ERROR", "ERROR")]),
    "with, no list": ("CREATE VIEW V AS WITH c AS (SELECT x AS k FROM A) SELECT k AS z FROM c", [("Z", "DIRECT", "A", "X", "")]),
    "ctas with": ("CREATE TABLE db.s.T AS\nWITH d1 AS (SELECT y FROM B), d2 AS (SELECT y, MAX(w) AS m FROM d1 JOIN C ON C.k = d1.y GROUP BY y)\nSELECT y, m FROM d2", [("Y", "DIRECT", "B", "Y", ""),("M", "DERIVED", "C", "W", "MAX")]),
    "union in cte": ("CREATE VIEW V COMMENT = 'x AS (SELECT' AS WITH u AS ((SELECT a FROM A) UNION ALL (SELECT b FROM B)) SELECT a FROM u", [("A", "DERIVED", "A; B", "A; B", "")]),
    "three": ("CREATE OR REPLACE VIEW s.V COPY GRANTS AS WITH a AS (SELECT p.x FROM P p), b AS (SELECT a.x AS y FROM a), c AS (SELECT b.y AS z FROM b) SELECT c.z FROM c", [("Z", "DIRECT", "P", "X", "")]),
    "brackets": ("CREATE VIEW V AS WITH c AS (((SELECT x FROM A))) (SELECT x FROM c)", [("X", "DIRECT", "A", "X", "")]),
    "with in with": ("CREATE VIEW V AS WITH o AS (WITH i AS (SELECT x AS k FROM A) SELECT i.k AS m FROM i), i AS (SELECT q FROM Q) SELECT o.m, i.q FROM o, i", [("M", "DIRECT", "A", "X", ""),("Q", "DIRECT", "Q", "Q", "")]),
    "cte columns": ("CREATE VIEW V AS WITH c (p, q) AS (SELECT x, MAX(y) FROM A GROUP BY x) SELECT q, p FROM c", [("Q", "DERIVED", "A", "Y", "MAX"),("P", "DIRECT", "A", "X", "")]),
    "scalar": ("CREATE VIEW V AS SELECT a.id, (SELECT MAX(b.y) FROM B b WHERE b.id = a.id) AS m FROM A a", [("ID", "DIRECT", "A", "ID", ""),("M", "DERIVED", "B", "Y", "SUBQUERY")]),
    "in": ("CREATE VIEW V AS SELECT CASE WHEN a.k IN (SELECT k FROM B) THEN 1 ELSE 0 END AS f FROM A a", [("F", "DERIVED", "A; B", "K", "CASE")]),
    "exists": ("CREATE VIEW V AS SELECT CASE WHEN EXISTS (SELECT * FROM B WHERE B.k = a.k) THEN a.x END AS f FROM A a", [("F", "DERIVED", "A", "X", "CASE")]),
    "three levels": ("CREATE VIEW V AS SELECT x.a AS z FROM (SELECT y.a FROM (SELECT t.b AS a FROM (SELECT u.c AS b FROM U u) t) y) x", [("Z", "DIRECT", "U", "C", "")]),
    "same alias twice": ("CREATE VIEW V AS SELECT t.a FROM (SELECT x.a FROM X x) t UNION ALL SELECT t.b FROM (SELECT y.b FROM Y y) t", [("A", "DERIVED", "X; Y", "A; B", "")]),
    "flatten": ("CREATE VIEW V AS SELECT t.id, f.value AS v, value:x::STRING AS w FROM T t, LATERAL FLATTEN(input => t.items) f", [("ID", "DIRECT", "T", "ID", ""),("V", "DERIVED", "T", "ITEMS", ""),("W", "DERIVED", "T", "ITEMS", "CAST")]),
    "quoted":('CREATE VIEW "My View" AS SELECT "T"."First Name" AS "Full Name", t2."a.b" FROM "My Table" "T" JOIN S.T2 t2 ON t2.k = "T".k',[("FULL NAME", "DIRECT", "MY TABLE", "FIRST NAME", ""),("A.B", "DIRECT", "S.T2", "A.B", "")]),
    "from in function": ("CREATE VIEW V AS SELECT COALESCE((SELECT MIN(x) FROM B), NVL(a.y, (SELECT z FROM C LIMIT 1))) AS q FROM A a", [("Q", "DERIVED", "A; B; C", "X; Y; Z", "COALESCE")]),
    "derived with": ("CREATE VIEW V AS SELECT d.k FROM (WITH c AS (SELECT x AS k FROM A) SELECT k FROM c) d", [("K", "DIRECT", "A", "X", "")]),
    "star over subqueries": ("CREATE VIEW V AS WITH c AS (SELECT x, MAX(y) AS m FROM A GROUP BY x), d AS (SELECT c.*, 1 AS one FROM c) SELECT * FROM d",
                             [("X", "DIRECT", "A", "X", ""), ("M", "DERIVED", "A", "Y", "MAX"), ("ONE", "DERIVED", "CALCULATED", "LITERAL", "LITERAL")]),
    "star of unknown columns": ("CREATE VIEW V AS SELECT a.*, b.x AS q FROM A a JOIN B b ON a.k = b.k", [("*", "UNKNOWN", "A", "*", ""), ("Q", "DIRECT", "B", "X", "")]),
    "star over unknown columns of a subquery": ("CREATE VIEW V AS SELECT * FROM (SELECT * FROM A) d", [("*", "UNKNOWN", "A", "*", "")]),
    "pivot": ("CREATE VIEW V AS SELECT * FROM A PIVOT (SUM(x) FOR y IN ('a', 'b'))", [("*", "UNKNOWN", "A", "*", "")]),
    "bracketed selects": ("CREATE VIEW V (P, Q) AS (SELECT a.x, a.y FROM A a) UNION (SELECT b.u, b.v FROM B b) ORDER BY 1",
                          [("P", "DERIVED", "A; B", "U; X", ""), ("Q", "DERIVED", "A; B", "V; Y", "")]),
    "quantified and nested conditions": ("CREATE VIEW V AS SELECT a.k >= ALL (SELECT b.k FROM B b WHERE b.z IN (SELECT z FROM C)) AS f FROM A a", [("F", "DERIVED", "A; B", "K", "BINARY")]),
    "subquery in a condition gives nothing": ("CREATE VIEW V AS SELECT a.x FROM A a WHERE a.k IN (SELECT k FROM B) AND EXISTS (SELECT 1 FROM C)", [("X", "DIRECT", "A", "X", "")]),
    "no text": (None, [("ERROR", "ERROR", "DDL_NOT_FOUND", "DDL_NOT_FOUND", "ERROR")]),
    "empty": ("", [("ERROR", "ERROR", "ANALYSIS_ERROR", "ANALYSIS_ERROR", "ERROR")]),
    "not SQL": ("hello, world", [("ERROR", "ERROR", "ANALYSIS_ERROR", "ANALYSIS_ERROR", "ERROR")]),
}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, name, text) for i, (name, (text, _)) in enumerate(TEXTS.items())]
    return spark.createDataFrame(rows, "object_id long, view_name string, ddl_text string")


@pytest.fixture(scope="module")
def lineage(texts):
    found = {}
    for r in resolve.lineage_all(texts).collect():
        found.setdefault(r.object_id, []).append((r.view_column, r.column_type, r.source_table, r.source_column, r.expression_type))
    return found


@pytest.mark.parametrize("name", list(TEXTS))
def test_text(lineage, name):
    assert sorted(lineage[list(TEXTS).index(name)]) == sorted(TEXTS[name][1])


def test_one_row_per_column(texts):
    """Where the names can be read off the text, stars apart."""
    columns = facts.ddl_object_columns(texts).select("object_id", "column_name").distinct()
    identified = facts.ddl_identifier_fn(texts).count() - 1
    assert resolve.column_sources(texts).join(columns.select("object_id").distinct(), "object_id", "left_semi").count() + identified == columns.count() - 1


def test_closure_has_no_subquery_names(texts):
    own = {n for n in TEXTS if n in ("prefix names", "reversed chain", "same alias in two scopes", "three", "derived with")}
    for row in resolve.cte_trace_base(texts.where(texts.view_name.isin(list(own)))).collect():
        assert row.base_table.lower() not in ("c1", "c10", "b", "c", "x", "d")


CATALOG = [("a", 1, "k"), ("a", 2, "X"), ("S.B", 1, "k"), ("S.B", 2, "y"), ("B", 1, "wrong"), ("C", 1, "z")]
BY_CATALOG = {
    "star": ("CREATE VIEW V AS SELECT * FROM A", [("K", "DIRECT", "A", "K", ""), ("X", "DIRECT", "A", "X", "")]),
    "star of a join": ("CREATE VIEW V AS SELECT b.*, a.x FROM A a JOIN S.B b ON a.k = b.k", [("K", "DIRECT", "S.B", "K", ""), ("Y", "DIRECT", "S.B", "Y", ""), ("X", "DIRECT", "A", "X", "")]),
    "bare columns": ("CREATE VIEW V AS SELECT x, y, z FROM A JOIN S.B ON A.k = S.B.k JOIN U ON U.k = A.k", [
        ("X", "DIRECT", "A", "X", ""), ("Y", "DIRECT", "S.B", "Y", ""), ("Z", "DIRECT", "U", "Z", "")]),
    "bare column of nobody": ("CREATE VIEW V AS SELECT q FROM A JOIN S.B ON A.k = S.B.k", [("Q", "DIRECT", "S.B", "Q", "")]),
    "stars through subqueries": ("CREATE VIEW V (P, Q, R) AS WITH c AS (SELECT * FROM A), d AS (SELECT c.*, y FROM c JOIN DB.S.B b ON b.k = c.k) SELECT * FROM d",
                                 [("P", "DIRECT", "A", "K", ""), ("Q", "DIRECT", "A", "X", ""), ("R", "DIRECT", "DB.S.B", "Y", "")]),
    "union of stars by position": ("CREATE VIEW V AS SELECT * FROM A UNION ALL SELECT * FROM S.B", [("K", "DERIVED", "A; S.B", "K", ""), ("X", "DERIVED", "A; S.B", "X; Y", "")]),
    "unknown table": ("CREATE VIEW V AS SELECT * FROM N", [("*", "UNKNOWN", "N", "*", "")]),
}


def test_catalog_decides_bare_columns_and_stars(spark):
    catalog = spark.createDataFrame([(*r, "x") for r in CATALOG], "table_name string, ordinal int, column_name string, owner string")
    ddl = spark.createDataFrame([(i, "V", t) for i, (t, _) in enumerate(BY_CATALOG.values())] + [(0, "V2", "CREATE VIEW V2 AS SELECT * FROM C"), (None, "V", None)],
                                "object_id long, view_name string, ddl_text string")
    found = {}
    for r in resolve.lineage_all(ddl, catalog).collect():
        found.setdefault((r.object_id, r.view_name), []).append((r.view_column, r.column_type, r.source_table, r.source_column, r.expression_type))
    for i, (name, (_, want)) in enumerate(BY_CATALOG.items()):
        assert sorted(found[i, "V"]) == sorted(want), name
    assert found[0, "V2"] == [("Z", "DIRECT", "C", "Z", "")] and len(found[None, "V"]) == 1
    assert resolve.lineage_all(ddl, catalog.limit(0)).where("view_column = '*'").count() == 5


def test_growth_with_columns_and_brackets(spark):
    """A view over a subquery of very many columns costs about in proportion, as does text of 100 KB and more."""
    import time

    def seconds(n):
        inner = ", ".join(f"NVL(t.c{i}, ((0) + ({i}))) AS a_rather_long_name_{i}" for i in range(n))
        outer = ", ".join(f"c.a_rather_long_name_{i}" for i in range(n))
        df = spark.createDataFrame([(1, "V", f"CREATE VIEW V AS WITH c AS (SELECT {inner} FROM T t) SELECT {outer} FROM c")], "object_id long, view_name string, ddl_text string")
        start = time.perf_counter()
        assert resolve.lineage_all(df).where("source_table = 'T' AND column_type = 'DERIVED'").count() == n
        return time.perf_counter() - start

    seconds(10)
    assert seconds(8000) < 4 * max(seconds(4000), 2)


def test_lineage_is_a_map_without_shuffle(texts):
    plan = resolve.lineage_all(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_expression_types(spark):
    from pyspark.sql import functions as F

    from tracewell.functions.text import expression_type

    cases = {
        "a + b * c": "Add", "a * b - c": "Sub", "a * (b + c)": "Mul", "a / b": "Div", "(a + b)": "Paren", "1": "Literal", "''": "Literal",
        "SUM(a)": "Sum", "COUNT(*)": "Count", "IFNULL(a, b)": "Coalesce", "CAST(a AS INT)": "Cast", "a::INT": "Cast",
        "CASE WHEN a THEN CASE b WHEN 1 THEN 2 END END": "Case", "CASE a WHEN 1 THEN 2 END + 1": "Add", "SUM(a) OVER (ORDER BY b)": "Window",
        "LISTAGG(a, '')": "GroupConcat", "MY_FN(a)": "Anonymous", "a || b": "DPipe", "CURRENT_TIMESTAMP": "CurrentTimestamp", "NULL": "Null",
    }
    df = spark.createDataFrame([(k,) for k in cases], "e string").select("e", expression_type(F.col("e")).alias("t"))
    assert {r.e: r.t for r in df.collect()} == cases


def test_many_columns(spark):
    """A view of 3,000 columns is split in order and in reasonable time."""
    items = ", ".join(f"NVL(t.c{i}, (0)) AS c{i}" for i in range(3000))
    df = spark.createDataFrame([(1, "V", f"CREATE VIEW V AS SELECT {items} FROM T t")], "object_id long, view_name string, ddl_text string")
    rows = {r.ordinal: r.out_name for r in facts.ddl_select_items(df).collect()}
    assert rows == {i + 1: f"c{i}" for i in range(3000)}


def test_set_operations_give_all_sources(spark):
    texts = [
        (1, "CREATE VIEW V AS SELECT a.id FROM A a UNION ALL SELECT b.id2 FROM B b UNION SELECT c.x FROM C c", {("A; B; C", "ID; ID2; X")}),
        (2, "CREATE VIEW V AS WITH u AS (SELECT a.id AS k FROM A a INTERSECT SELECT b.k FROM B b) SELECT u.k FROM u", {("A; B", "ID; K")}),
        (3, "CREATE VIEW V AS SELECT d.q FROM (SELECT t.p AS q FROM T t EXCEPT SELECT s.p FROM S s) d", {("S; T", "P")}),
    ]
    rows = resolve.lineage_all(spark.createDataFrame([(i, "V", t) for i, t, _ in texts], "object_id long, view_name string, ddl_text string")).collect()
    for i, _, want in texts:
        assert {(r.source_table, r.source_column) for r in rows if r.object_id == i} == want


def test_long_items_and_deep_cases_are_kept(spark):
    deep = "1"
    for n in range(6):
        deep = f"CASE WHEN t.c{n} > {n} THEN {deep} ELSE t.d{n} END"
    text = f"CREATE VIEW V AS SELECT t.a, COALESCE(t.a_rather_long_column_name, t.another_rather_long_column_name), {deep} AS z FROM T t"
    rows = resolve.lineage_all(spark.createDataFrame([(1, "V", text)], "object_id long, view_name string, ddl_text string")).collect()
    found = {r.view_column: r for r in rows}
    assert set(found) == {"A", "COLUMN_2", "Z"} and found["Z"].expression_type == "CASE"
    assert found["COLUMN_2"].source_column == "ANOTHER_RATHER_LONG_COLUMN_NAME; A_RATHER_LONG_COLUMN_NAME"
