"""Tables and columns used by stored procedures.

Input: (sp_id, procedure_name, procedure_schema, procedure_definition). A procedure is one
row; statements, clauses and references are arrays inside it until the final explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import rules
from tracewell.functions import text as T
from tracewell.sources.catalog import null_like_to_empty

# Fixed patterns: variable declarations in the order in which a later one overrides.
VARIABLE_PATTERNS = [
    r"(?i)(\w+)\s*:=\s*['\"]([A-Z_][A-Z0-9_\.]*)['\"]",
    r"(?i)LET\s+(\w+)\s+\w+\s*:=\s*['\"]([A-Z_][A-Z0-9_\.]*)['\"]",
    r"(?i)SET\s+(\w+)\s*=\s*['\"]([A-Z_][A-Z0-9_\.]*)['\"]",
    r"(?i)(\w+)\s*:=\s*['\"]?([A-Z_][A-Z0-9_\.]*)['\"]?\s*\|\|\s*.*?RANDSTR",
]
# Fixed patterns: signs of dynamic SQL.
DYNAMIC_PATTERNS = [
    r"EXECUTE\s+IMMEDIATE", r"DYNAMIC_SQL\s*:=", r"\|\|\s*['\"].*?['\"]", r"IDENTIFIER\s*\(\s*\?",
]
# Fixed patterns: temporary tables and cursors.
TEMP_TABLE = (
    r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMPORARY|TEMP)\s+TABLE\s+"
    r"(?:IDENTIFIER\s*\(\s*:?(\w+)\s*\)|([A-Z_][A-Z0-9_\.]*))"
)
CURSOR = r"(?i)LET\s+(\w+)\s+CURSOR\s+FOR"


def procedures_list(procedures: DataFrame, schema_like: str = "%", limit: int | None = None) -> DataFrame:
    """Procedures of matching schemas with the length of their text."""
    rows = procedures.where(F.col("procedure_schema").like(schema_like)).select(
        "sp_id", "procedure_name", "procedure_schema", F.length("procedure_definition").alias("definition_length"))
    return rows.orderBy("procedure_name", "sp_id").limit(limit) if limit else rows


def procedures_by_name(procedures: DataFrame, names: DataFrame) -> DataFrame:
    """Procedures on a list of names, in any case."""
    wanted = names.select(F.upper("procedure_name").alias("_n"))
    return procedures.join(wanted, F.upper("procedure_name") == F.col("_n"), "left_semi")


def variables(definition: Column) -> Column:
    """Array of (variable, table_name): table-like values only, the last declaration of a variable wins."""
    found = F.concat(*[
        F.transform(
            F.arrays_zip(
                F.regexp_extract_all(definition, F.lit(p), F.lit(1)).alias("v"),
                F.regexp_extract_all(definition, F.lit(p), F.lit(2)).alias("t")),
            lambda z: F.struct(z["v"].alias("variable"), z["t"].alias("table_name")))
        for p in VARIABLE_PATTERNS])
    likely = F.filter(found, lambda e: (F.length(e["table_name"]) > 3) & e["table_name"].rlike(r"[_.]"))
    return T.let(likely, lambda all_: F.filter(all_, lambda e, i: ~F.exists(
        F.slice(all_, i + 2, F.size(all_)), lambda later: later["variable"] == e["variable"])))


def sp_variables(procedures: DataFrame) -> DataFrame:
    return procedures.select("sp_id", F.inline(variables(F.col("procedure_definition"))))


def language(definition: Column) -> Column:
    python, sql = definition.rlike(r"(?i)LANGUAGE\s+PYTHON"), definition.rlike(r"(?i)LANGUAGE\s+SQL")
    return F.when(python & sql, "MIXED").when(python, "PYTHON").otherwise("SQL")


def sp_language(procedures: DataFrame) -> DataFrame:
    return procedures.select("sp_id", language(F.col("procedure_definition")).alias("sp_language"))


def sp_temp_tables(procedures: DataFrame) -> DataFrame:
    """Temporary tables a procedure creates, by name or by variable."""
    by = lambda i: F.regexp_extract_all("procedure_definition", F.lit(TEMP_TABLE), F.lit(i))
    names = F.zip_with(by(1), by(2), lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))))
    return procedures.select("sp_id", F.explode(names).alias("temp_table"))


def sp_cursors(procedures: DataFrame) -> DataFrame:
    return procedures.select("sp_id", F.explode(F.regexp_extract_all("procedure_definition", F.lit(CURSOR), F.lit(1))).alias("cursor"))


def sp_dynamic_sql(procedures: DataFrame) -> DataFrame:
    hit = F.lit(False)
    for pattern in DYNAMIC_PATTERNS:
        hit = hit | F.col("procedure_definition").rlike("(?i)" + pattern)
    return procedures.select("sp_id", hit.alias("has_dynamic_sql"))


def sp_identifier_resolve(procedures: DataFrame) -> DataFrame:
    """Table behind every ``IDENTIFIER(:variable)``; an undeclared variable stands for itself."""
    used = F.array_distinct(F.regexp_extract_all("procedure_definition", F.lit(r"(?i)IDENTIFIER\s*\(\s*:(\w+)\s*\)"), F.lit(1)))
    return procedures.select("sp_id", "procedure_definition", F.explode(used).alias("variable")).select(
        "sp_id", "variable", variable_table(variables(F.col("procedure_definition")), F.col("variable")).alias("table_name"))


def variable_table(declared: Column, name: Column) -> Column:
    hit = F.get(F.filter(declared, lambda e: F.lower(e["variable"]) == F.lower(name)), F.lit(0))
    return F.coalesce(hit["table_name"], name)


# --- relations -----------------------------------------------------------------------

STATEMENT = (
    r"(?i)\b((?:INSERT INTO|MERGE INTO|DELETE FROM|UPDATE|"
    r"CREATE (?:OR REPLACE )?(?:(?:TEMPORARY|TEMP|TRANSIENT) )?TABLE|WITH|SELECT)\b.*)$"
)
WRITE_CLAUSES = (
    r"INSERT INTO|MERGE INTO|DELETE FROM|UPDATE SET|UPDATE|SET|VALUES|WHEN (?:NOT )?MATCHED|"
    r"CREATE (?:OR REPLACE )?(?:(?:TEMPORARY|TEMP|TRANSIENT) )?TABLE(?: IF NOT EXISTS)?|"
)
NESTED = rf"(?i)\(\s*(SELECT\b{T.BALANCED}*+)\)"
OPENED = r"(?i)\(\s*SELECT\b"
VARIABLE_MARK = "VARREF$"
TARGET_KINDS = {
    "INSERT INTO": "USED_AS_INSERT", "MERGE INTO": "USED_AS_MERGE", "UPDATE": "USED_AS_UPDATE", "DELETE FROM": "USED_AS_DELETE",
}
CLAUSE_KINDS = {
    "SELECT": "USED_AS_SELECT", "WHERE": "USED_AS_FILTER", "QUALIFY": "USED_AS_FILTER", "GROUP BY": "USED_AS_GROUP_BY",
    "HAVING": "USED_AS_HAVING", "ORDER BY": "USED_AS_ORDER_BY",
}


def statements(definition: Column) -> Column:
    """Data statements of a procedure, literals masked, variable references turned into names."""
    named = F.regexp_replace(T.strip_comments(definition), r"(?i)\bIDENTIFIER\s*\(\s*['\"]([\w.$]+)['\"]\s*\)", "$1")
    named = F.regexp_replace(named, r"(?i)\bIDENTIFIER\s*\(\s*:?(\w+)\s*\)", r"VARREF\$$1")
    flat = T.normalise_sql(F.replace(named, F.lit("$$"), F.lit(" ")))
    found = F.transform(F.split(flat, ";"), lambda s: F.regexp_extract(s, STATEMENT, 1))
    return F.filter(found, lambda s: s != "")


def query_blocks(statement: Column) -> Column:
    """A statement without its nested selects, and each nested select, level by level until none is left."""
    def deeper(found: Column, _: Column) -> Column:
        nested = F.flatten(F.transform(found["level"], lambda s: F.regexp_extract_all(s, F.lit(NESTED), F.lit(1))))
        return T.let(nested, lambda level: F.struct(F.concat(found["blocks"], level).alias("blocks"), level.alias("level")))

    start = F.struct(F.array(statement).alias("blocks"), F.array(statement).alias("level"))
    rounds = F.array_repeat(F.lit(0), F.regexp_count(statement, F.lit(OPENED)))
    blocks = F.reduce(rounds, start, deeper, lambda found: found["blocks"])
    return F.flatten(F.transform(blocks, lambda s: by_set_operator(F.regexp_replace(s, NESTED, "()"))))


def by_set_operator(block: Column) -> Column:
    """The selects of a set operation as blocks of their own, so that each one's columns meet its own tables.

    What is written to stays with the first one.
    """
    marked = F.regexp_replace(block, rf"(?i)({T.GROUP})|(\b(?:{'|'.join(T.SET_OPERATORS)})\b(?:\s+(?:ALL|DISTINCT)\b)?)", f"$1{T.MARK}$2{T.MARK}")
    plain = F.replace(marked, F.lit(T.MARK * 2), F.lit(""))
    return F.transform(F.split(plain, f"{T.MARK}[^{T.MARK}]*{T.MARK}"), lambda b: F.trim(b))


def not_followed(blocks: Column) -> Column:
    """One ANALYSIS_ERROR row where a nested select is deeper than the patterns follow."""
    left_over = F.exists(blocks, lambda b: b.rlike(OPENED))
    return F.when(left_over, F.array(_use(F.lit(""), F.lit(""), F.lit("ANALYSIS_ERROR")))).otherwise(F.expr("CAST(array() AS array<struct<table_name:string,column_name:string,kind:string>>)"))


def block_usage(block: Column, subqueries: Column) -> Column:
    """(table_name, column_name, kind) of one query block."""
    segs = T.segments(block, WRITE_CLAUSES + T.CLAUSES)
    # A comma continues the clause before it.
    tagged = T.let(segs, lambda s: F.transform(s, lambda g, i: F.struct(
        F.regexp_replace(F.try_element_at(F.filter(F.transform(F.slice(s, 1, i + 1), lambda x: x["kw"]), lambda k: k != ","), F.lit(-1)),
                         "^CREATE .*$", "CREATE").alias("kw"),
        g["txt"].alias("txt"))))

    def usage(s: Column) -> Column:
        is_merge = F.exists(s, lambda g: g["kw"] == "MERGE INTO")
        table_kw = ["FROM", "JOIN", *TARGET_KINDS]
        names_table = lambda g: (g["kw"].isin(table_kw) | ((g["kw"] == "USING") & is_merge)) & g["txt"].rlike(rf"^{T.NAME}{T.NOT_CALL}")
        sources = F.transform(F.filter(s, names_table), lambda g, i: T.table_struct(g["kw"], g["txt"], i + 1))
        return T.let(sources, lambda tables: F.flatten(F.transform(s, lambda g: clause_usage(g, tables, is_merge))))

    return F.filter(T.let(tagged, usage), lambda u: u["table_name"].isNotNull() & ~F.array_contains(subqueries, F.lower(u["table_name"])))


def _use(table: Column, column: Column, kind: Column) -> Column:
    return F.struct(table.alias("table_name"), column.alias("column_name"), kind.alias("kind"))


def clause_usage(g: Column, tables: Column, is_merge: Column) -> Column:
    """Usage stated by one clause."""
    target = F.get(tables, F.lit(0))["table_name"]
    own = F.regexp_extract(g["txt"], rf"^({T.NAME})", 1)
    none = F.expr("CAST(array() AS array<struct<table_name:string,column_name:string,kind:string>>)")
    lookup = lambda q: F.coalesce(
        F.get(F.filter(tables, lambda t: t["alias"] == F.lower(q)), F.lit(0))["table_name"],
        F.get(F.filter(tables, lambda t: F.lower(t["table_name"]) == F.lower(q)), F.lit(0))["table_name"], q)
    refs = lambda txt, kind: F.transform(T.column_refs(txt), lambda r: _use(
        F.when(r["qualifier"] != "", lookup(r["qualifier"])).when(F.size(tables) > 0, F.try_element_at(tables, F.lit(-1))["table_name"]),
        r["column_name"], F.lit(kind) if isinstance(kind, str) else kind))
    star = lambda kind: F.when(own != "", F.array(_use(own, F.lit("*"), F.lit(kind)))).otherwise(none)
    listed = F.transform(
        T.top_level_items(F.regexp_extract(g["txt"], rf"^{T.NAME}\s*\(([^()]*)\)", 1)),
        lambda c: _use(own, F.substring_index(c, ".", -1), F.lit("USED_AS_INSERT")))
    left, right = F.regexp_extract(g["txt"], rf"^(?:{T.NAME}\.)?({T.WORD})\s*=", 1), F.regexp_replace(g["txt"], r"^[^=]*=", "")
    assigned = F.when(left != "", F.array(_use(target, left, F.lit("USED_AS_UPDATE")))).otherwise(none)
    in_merge = F.when(is_merge, "USED_AS_MERGE")
    expr = T.split_alias(F.regexp_replace(g["txt"], r"(?i)^(?:DISTINCT|ALL) ", ""))["expr"]
    result = (
        F.when(g["kw"] == "SELECT", refs(expr, "USED_AS_SELECT"))
        .when(g["kw"].isin("FROM", "JOIN"), star("USES_TABLE"))
        .when(g["kw"] == "ON", refs(g["txt"], F.coalesce(in_merge, F.lit("USED_AS_JOIN"))))
        .when((g["kw"] == "USING") & is_merge, star("USES_TABLE"))
        .when(g["kw"] == "USING", refs(g["txt"], "USED_AS_JOIN"))
        .when(g["kw"] == "INSERT INTO", F.concat(star("USED_AS_INSERT"), listed))
        .when(g["kw"] == "CREATE", star("PROCEDURE_CREATES_TABLE"))
        .when(g["kw"].isin("SET", "UPDATE SET"), F.concat(assigned, refs(right, F.coalesce(in_merge, F.lit("USED_AS_SELECT")))))
        .when(g["kw"].isin("WHEN MATCHED", "WHEN NOT MATCHED"), refs(g["txt"], "USED_AS_MERGE"))
        .when((g["kw"] == "VALUES") & is_merge, refs(g["txt"], "USED_AS_MERGE"))
    )
    for kw, kind in TARGET_KINDS.items():
        if kw != "INSERT INTO":
            result = result.when(g["kw"] == kw, star(kind))
    for kw, kind in CLAUSE_KINDS.items():
        if kw != "SELECT":
            result = result.when(g["kw"] == kw, refs(g["txt"], kind))
    return result.otherwise(none)


def sp_relations(procedures: DataFrame) -> DataFrame:
    """Every (table, column, kind) of every procedure; '*' is the table as a whole."""
    rows = procedures.select(
        "sp_id", "procedure_name", "procedure_schema", "procedure_definition",
        F.explode(statements(F.col("procedure_definition"))).alias("statement"))
    rows = rows.withColumn(
        "subqueries", F.transform(F.regexp_extract_all("statement", F.lit(r"(?i)(?:\bWITH(?:\s+RECURSIVE)?\s+|[),]\s*)([A-Za-z_][\w$]*)\s*(?:\([^()]*\)\s*)?AS\s*\(\s*(?:SELECT|WITH)\b"), F.lit(1)), lambda n: F.lower(n)))
    used = T.let(query_blocks(F.col("statement")), lambda blocks: F.concat(
        F.flatten(F.transform(blocks, lambda b: block_usage(b, F.col("subqueries")))), not_followed(blocks)))
    rows = rows.select("sp_id", "procedure_name", "procedure_schema", "procedure_definition", F.explode(F.array_distinct(used)).alias("u"))
    table = F.when(
        F.col("u.table_name").startswith(VARIABLE_MARK),
        variable_table(variables(F.col("procedure_definition")), F.replace("u.table_name", F.lit(VARIABLE_MARK), F.lit(""))),
    ).otherwise(F.col("u.table_name"))
    return rows.select(
        "sp_id", F.col("procedure_name").alias("sp_name"), F.col("procedure_schema").alias("sp_schema"),
        language(F.col("procedure_definition")).alias("sp_language"), F.upper(table).alias("table_name"),
        F.upper("u.column_name").alias("column_name"), F.col("u.kind").alias("kind")).distinct()


def kinds_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda k: F.trim(k)), lambda k: k != "")


def sp_consolidate(relations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per table and column with its sorted distinct kinds; there are twelve kinds at most."""
    keys = keys or ["sp_name", "table_name", "column_name"]
    kinds = relations.select(*keys, F.explode(kinds_of(F.col("relationship_types"))).alias("kind"))
    return kinds.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("relationship_types"))


def sp_report(procedures: DataFrame) -> DataFrame:
    """The six report columns for a table of procedures."""
    keys = ["sp_name", "sp_schema", "sp_language", "table_name", "column_name"]
    return sp_relations(procedures).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("relationship_types"))


def content_hash() -> Column:
    return F.md5(F.concat_ws("_", "procedure_name", "procedure_schema", "procedure_definition"))


def sp_content_hash(procedures: DataFrame, stored: DataFrame) -> DataFrame:
    """Procedures with their content hash and whether a stored result can be reused.

    ``stored`` has (content_hash).
    """
    known = stored.select("content_hash").distinct().withColumn("_known", F.lit(True))
    return procedures.withColumn("content_hash", content_hash()).join(known, "content_hash", "left").select(
        "sp_id", "content_hash", F.coalesce("_known", F.lit(False)).alias("reusable"))


def sp_resume(procedures: DataFrame, done: DataFrame) -> DataFrame:
    """Procedures without results, names compared in upper case."""
    names = done.select(F.upper("sp_name").alias("_n")).distinct()
    return procedures.join(names, F.upper("procedure_name") == F.col("_n"), "left_anti")


def sp_kind_distribution(relations: DataFrame) -> DataFrame:
    return relations.select(F.explode(kinds_of(F.col("relationship_types"))).alias("kind")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"))


def sp_summary(relations: DataFrame) -> DataFrame:
    return relations.agg(
        F.count(F.lit(1)).alias("total_relationships"), F.countDistinct("table_name").alias("unique_tables"),
        F.countDistinct("sp_name").alias("procedures"))


def sp_clean_rows(report: DataFrame) -> DataFrame:
    """Null-like cells emptied; rows without procedure and table dropped."""
    cleaned = report.withColumns({c: null_like_to_empty(F.col(c)) for c in ("sp_name", "table_name")})
    return cleaned.where("sp_name <> '' or table_name <> ''")
