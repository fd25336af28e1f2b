"""Nested selects of procedures are read at every level; what cannot be followed is flagged."""

from tracewell.operators import procedures


def nested(levels):
    text = f"SELECT x{levels} FROM T{levels}"
    for n in reversed(range(levels)):
        text = f"SELECT x{n} FROM T{n} WHERE y{n} IN ({text})"
    return f"CREATE PROCEDURE P() LANGUAGE SQL AS $$ BEGIN {text}; END $$"


def test_nested_selects_of_any_depth(spark):
    rows = [(1, "P5", "S", nested(5)), (2, "P20", "S", nested(20))]
    df = spark.createDataFrame(rows, "sp_id long, procedure_name string, procedure_schema string, procedure_definition string")
    got = procedures.sp_relations(df).collect()
    five = {(r.table_name, r.column_name) for r in got if r.sp_name == "P5"}
    assert five == {(f"T{n}", c) for n in range(6) for c in ("*", f"X{n}", f"Y{n}")} - {("T5", "Y5")}
    assert {r.sp_name for r in got if r.kind == "ANALYSIS_ERROR"} == {"P20"}
