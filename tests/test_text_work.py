"""Text work that is tried only where it can find something gives what it gave, and clause texts are not carried along."""

import random

from pyspark.sql import functions as F

from tracewell.functions import nesting, text
from tracewell.operators import facts, resolve


def levels(brackets):
    now = most = 0
    for c in brackets:
        now += {"(": 1, ")": -1}.get(c, 0)
        if now < 0:
            return None
        most = max(most, now)
    return most if now == 0 else None


def test_depth(spark):
    rng = random.Random(1)
    cases = ["", "x", "(", ")", ")(", "()()", "(a(b)c)(d)", "(" * 4 + ")" * 4, "(" * 9 + "x" + ")" * 9, "((((()))))(", "(()(()((()))))"]
    cases += ["".join(rng.choice("()a") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", nesting.depth(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == {c: levels(c) for c in cases}


def test_normalised(spark):
    cases = {
        "a  b\tc\r\nd": "a b c d", " a ": "a", "a--x\nb": "a b", "a/*(*/b": "a b", "'it''s'": "''", "'open": "'open", 'x."A b"': "x.A_x20_b", None: None,
        "a '-- (' b": "a '' b", "a -- it's\n'(' b": "a '' b",
    }
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.normalise_sql(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == cases


def test_clause_texts_are_not_carried(spark):
    df = spark.createDataFrame([(1, "V", "CREATE VIEW V AS SELECT a.x FROM A a UNION SELECT b.y AS z FROM B b")], "object_id long, view_name string, ddl_text string")
    scope = resolve.scope_facts(df).schema["scopes"].dataType.elementType
    branch = scope["branches"].dataType.elementType
    for fields in (scope, branch):
        assert "segs" not in fields.names and "level" not in fields["items"].dataType.elementType.names
    assert {(r.qualifier, r.column_name) for r in facts.ddl_column_refs(df).collect()} == {("a", "x")}
