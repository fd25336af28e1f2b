"""Facts of program files: functions, models, tables, procedures and calls.

Input: (file_id, path, text), one row per file. A file is cut into classes or functions
inside its row and exploded once; joins happen only where a name leads to another file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import rules
from tracewell.functions import text as T
from tracewell.functions.skew import first_per_key, large, running
from tracewell.sources.storage import checkpointed

# Calls that are never edges of the call graph.
SKIPPED_CALLS = [
    "select", "text",
    "list", "any", "map", "max", "min", "Depends", "setattr",
]
BUILTIN_CALLS = [
    "__build_class__", "__import__", "abs", "aiter", "all", "anext", "any", "ascii", "bin", "breakpoint", "callable", "chr", "compile",
    "delattr", "dir", "divmod", "eval", "exec", "format", "getattr", "globals", "hasattr", "hash", "hex", "id", "input", "isinstance",
    "issubclass", "iter", "len", "locals", "max", "min", "next", "oct", "open", "ord", "pow", "print", "repr", "round", "setattr",
    "sorted", "sum", "vars",
]
STATEMENT_WORDS = ["if", "elif", "while", "for", "return", "and", "or", "not", "in", "is", "with", "assert", "yield", "await",
                   "lambda", "except", "raise", "del", "print", "else", "match", "case", "class", "def"]


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def match_pairs(text: Column, pattern: str, first: int = 1, second: int = 2) -> Column:
    """Array of (a, b) with two groups of every match."""
    return F.arrays_zip(all_matches(text, pattern, first).alias("a"), all_matches(text, pattern, second).alias("b"))


# --- classes and tables --------------------------------------------------------------

CLASS = r"(?ms)^class\s+(\w+)([^\n]*):[^\S\n]*$(.*?)(?=^class\s|\z)"
TABLE_NAME = r"__tablename__\s*=\s*[\"']([^\"']+)[\"']"
TABLE_VARIABLE = r"(\w+)\s*(?::\s*Table\s*)?=\s*Table\s*\(\s*[\"']([^\"']+)[\"']"


def is_model_path(path: Column) -> Column:
    return path.rlike(r"(?:^|/)(?:orm|models)/") | F.substring_index(path, "/", -1).contains("models")


def classes(files: DataFrame) -> DataFrame:
    """(file_id, path, ordinal, class_name, bases, body, text) of every class."""
    found = F.arrays_zip(
        all_matches(F.col("text"), CLASS, 1).alias("n"), all_matches(F.col("text"), CLASS, 2).alias("h"),
        all_matches(F.col("text"), CLASS, 3).alias("b"))
    return files.select("file_id", "path", "text", F.posexplode(found).alias("ordinal", "c")).select(
        "file_id", "path", "text", "ordinal", F.col("c.n").alias("class_name"), F.col("c.h").alias("bases"), F.col("c.b").alias("body"))


def known_tables(files: DataFrame) -> DataFrame:
    """Upper-case table names declared anywhere in the code."""
    patterns = [
        r"__tablename__\s*=\s*[\"']([a-zA-Z0-9_]+)[\"']",
        r"Table\s*\(\s*[\"']([a-zA-Z0-9_]+)[\"']",
        r"[\"']([a-zA-Z0-9_]+)[\"'],\s*\w+\.metadata",
    ]
    names = F.concat(*[all_matches(F.col("text"), p) for p in patterns])
    return files.select(F.explode(names).alias("n")).select(F.upper("n").alias("table_name")).distinct()


def model_table_map(files: DataFrame, app: rules.AppRules = rules.AppRules()) -> DataFrame:
    """Class or variable -> table; a variable with one of the model prefixes also answers to its name without it.

    Of several definitions of one name the one in the last path wins.
    """
    models = files.where(is_model_path(F.col("path")))
    variables = match_pairs(F.col("text"), TABLE_VARIABLE)
    named = F.regexp_extract("body", TABLE_NAME, 1)
    reference = F.regexp_extract("body", r"__table__\s*=\s*(\w+)", 1)
    by_variable = F.get(F.filter(variables, lambda v: v["a"] == reference), F.lit(0))["b"]
    from_classes = classes(models).select(
        "path", F.col("class_name").alias("model"), F.when(named != "", named).otherwise(by_variable).alias("t"))
    from_variables = models.select("path", F.explode(variables).alias("v")).select(
        "path", F.explode(F.array_distinct(F.array("v.a", F.regexp_replace("v.a", "^(?:" + "|".join(map(re.escape, app.model_prefixes)) + ")", "")))).alias("model"), F.col("v.b").alias("t"))
    both = from_classes.unionByName(from_variables).where("t is not null")
    return both.groupBy("model").agg(F.max_by(F.upper("t"), F.struct("path", "t")).alias("table_name"))


def model_resolve(names: DataFrame, model_map: DataFrame, app: rules.AppRules = rules.AppRules()) -> DataFrame:
    """Table of each model name: as written, lower, upper, or behind a model prefix (``p_`` lower, ``P`` as written); first hit."""
    name = F.col("model_name")
    variants = F.array(name, F.lower(name), F.upper(name), *[
        v for p in app.model_prefixes for v in (F.concat(F.lit(p), F.lower(name)), F.concat(F.lit(p.rstrip("_").upper()), name))])
    tried = names.select("model_name").distinct().select("model_name", F.posexplode(variants).alias("rank", "model"))
    return first_per_key(tried.join(large(model_map), "model"), ["model_name"], F.col("rank"), ["table_name"])


def orm_columns(files: DataFrame) -> DataFrame:
    """(table_name, column_name) of mapped classes; private fields and relationships are no columns."""
    fields = F.filter(
        match_pairs(F.col("body"), r"(?m)^[ \t]+(\w+)\s*:\s*([^\n]*)"),
        lambda f: ~f["a"].startswith("_") & ~f["b"].rlike(r"=\s*relationship\("))
    rows = classes(files.where(F.col("path").rlike(r"(?:^|/)orm/"))).select(
        F.upper(F.regexp_extract("body", TABLE_NAME, 1)).alias("table_name"), F.explode(fields).alias("f"))
    return rows.where("table_name <> ''").select("table_name", F.upper("f.a").alias("column_name")).distinct()


def table_columns_text(columns: DataFrame) -> DataFrame:
    """(table_name, columns): sorted column names joined by ','."""
    return columns.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("columns"))


# --- response models -----------------------------------------------------------------

# Fixed patterns: container types around a model, in the order they are tried.
CONTAINERS = [
    r"list\[([\w\.]+)\]", r"List\[([\w\.]+)\]", r"dict\[[\w\.,\s]+,\s*([\w\.]+)\]", r"Dict\[[\w\.,\s]+,\s*([\w\.]+)\]",
    r"Optional\[([\w\.]+)\]", r"Union\[[\w\.,\s]*?([\w\.]+)[\w\.,\s]*?\]",
]


def unwrapped_type(text: Column) -> Column:
    """Model name inside list, dict, Optional or Union."""
    found = F.lit(None).cast("string")
    for pattern in reversed(CONTAINERS):
        found = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(found)
    return F.coalesce(found, text)


def is_simple_type(text: Column) -> Column:
    base = F.regexp_replace(text, r"\[.*?\]", "")
    return F.exists(F.array(*[F.lit(w) for w in rules.SIMPLE_TYPE_WORDS]), lambda w: base.contains(w))


def response_models(files: DataFrame) -> DataFrame:
    """One definition per model name, from the first path that has it."""
    rows = classes(files.where(is_model_path(F.col("path")))).where(F.col("bases").rlike(r"^\s*\([^)]*\)$"))
    return first_per_key(rows.withColumnRenamed("class_name", "model"), ["model"], F.struct("path", "ordinal"), ["body"])


#: A type: names, dots, bars and groups in square brackets, whatever is in these up to three levels.
TYPE_GROUP = r"\[(?:[^\[\]\n]|\[(?:[^\[\]\n]|\[[^\[\]\n]*\])*\])*\]"
TYPE = rf"(?:[\w.|]|[^\S\n]*\|[^\S\n]*|{TYPE_GROUP})+"
CONTAINER_WORDS = "Optional|List|list|Dict|dict|Set|set|Tuple|tuple|Sequence|Iterable|Union|Annotated"


def type_names(kind: Column) -> Column:
    """Names in a type but those of containers, in order."""
    names = all_matches(F.regexp_replace(kind, r"[\"']", ""), r"([A-Za-z_][\w.]*)")
    last = F.transform(names, lambda n: F.substring_index(n, ".", -1))
    return F.filter(last, lambda n: ~n.rlike(rf"^(?:{CONTAINER_WORDS}|None|Literal)$"))


def response_fields(files: DataFrame) -> DataFrame:
    """(model, ordinal, field, type, is_simple, is_optional, base_type) of public fields.

    A type reaches to the end of its brackets. It is simple if every name in it but containers is one of the simple type
    words; else ``base_type`` is the first name that is not.
    """
    pairs = F.filter(match_pairs(F.col("body"), rf"(?m)^[ \t]+(\w+)[ \t]*:[ \t]*[\"']?({TYPE})"), lambda f: ~f["a"].startswith("_"))
    first = T.let(pairs, lambda p: F.filter(
        F.transform(p, lambda f: F.struct(f["a"].alias("a"), F.regexp_replace(F.trim(f["b"]), r"\s+", "").alias("b"))),
        lambda f, i: ~F.exists(F.slice(p, 1, i), lambda earlier: earlier["a"] == f["a"])))
    rows = response_models(files).select("model", F.posexplode(first).alias("pos", "f"))
    kind = F.col("f.b")
    own = F.filter(type_names(kind), lambda n: ~n.isin(rules.SIMPLE_TYPE_WORDS))
    literal = kind.startswith("Literal[")
    return rows.select(
        "model", (F.col("pos") + 1).cast("int").alias("ordinal"), F.col("f.a").alias("field"), kind.alias("type"),
        (literal | (F.size(own) == 0)).alias("is_simple"), (kind.startswith("Optional[") | kind.contains("None")).alias("is_optional"),
        F.when(~literal & (F.size(own) > 0) & kind.rlike(rf"^(?:{CONTAINER_WORDS})\[|\|"), F.get(own, F.lit(0))).otherwise(unwrapped_type(kind)).alias("base_type"))


def nested_fields(fields: DataFrame) -> DataFrame:
    """``parent.child`` names: fields of the models that fields refer to, as deep as models nest.

    A model that is met again below itself is not entered a second time.
    """
    inner = fields.where(~F.col("is_simple")).select(F.col("model").alias("base_type"), F.col("field").alias("child"), F.col("base_type").alias("next_type"))
    children = fields.where("is_simple").select(F.col("model").alias("base_type"), F.col("field").alias("child"), F.col("ordinal").alias("child_no"))
    open_ = fields.where(~F.col("is_simple")).select(
        "model", "ordinal", F.col("field").alias("parent"), "base_type", F.array("model", "base_type").alias("met"))
    open_ = open_.where("model <> base_type")
    found = None
    while True:
        here = open_.join(large(children), "base_type").select("model", "ordinal", "child_no", F.concat_ws(".", "parent", "child").alias("nested_field"))
        found = here if found is None else found.unionByName(here)
        deeper = open_.join(large(inner), "base_type").where(~F.array_contains("met", F.col("next_type"))).select(
            "model", "ordinal", F.concat_ws(".", "parent", "child").alias("parent"), F.col("next_type").alias("base_type"),
            F.concat("met", F.array("next_type")).alias("met"))
        open_ = checkpointed(deeper)
        if open_.isEmpty():
            return found


def union_fields(files: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields of the members of ``__root__: A | B`` and ``__root__: Union[A, B]`` models."""
    root = F.regexp_extract("body", rf"__root__:[ \t]*({TYPE})", 1)
    is_union = root.contains("|") | root.contains("Union[")
    members = F.when(is_union, F.array_distinct(type_names(root)))
    rows = response_models(files).select("model", F.explode(members).alias("m")).select("model", unwrapped_type(F.trim("m")).alias("member"))
    simple = fields.where("is_simple").select(F.col("model").alias("member"), "field")
    return rows.join(large(simple), "member").select("model", F.concat(F.lit("__root__"), "member").alias("name"), "field")


# --- functions -----------------------------------------------------------------------


def functions(files: DataFrame) -> DataFrame:
    """(file_id, path, ordinal, line_no, class_name, name, qualified, header, body) of every function.

    The text is cut before each ``def``; a body ends at the first line that starts in column one.
    """
    pieces = F.split("text", r"(?m)(?=^[ \t]*(?:async[ \t]+)?def\s+\w)")
    cut = files.where(F.col("path").endswith(".py")).withColumn("pieces", pieces)
    headers = F.transform("pieces", lambda p: F.try_element_at(all_matches(p, r"(?m)^class\s+(\w+)"), F.lit(-1)))
    lines = F.transform("pieces", lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
    cut = cut.withColumn("headers", headers).withColumn("lines", lines)
    rows = cut.select("file_id", "path", "headers", "lines", F.posexplode(T.elements("pieces")).alias("ordinal", "piece")).where(
        F.col("piece").rlike(r"^[ \t]*(?:async[ \t]+)?def\s+\w"))
    indented = F.col("piece").rlike(r"^[ \t]")
    owner = F.try_element_at(F.filter(F.slice("headers", F.lit(1), F.col("ordinal")), lambda h: h.isNotNull()), F.lit(-1))
    name = F.regexp_extract("piece", r"def\s+(\w+)", 1)
    body = F.regexp_replace("piece", r"(?s)\n(?=[^\s#)\]}]).*\z", "")
    rows = rows.select(
        "file_id", "path", "ordinal",
        (F.reduce(F.slice("lines", F.lit(1), F.col("ordinal")), F.lit(0), lambda a, x: a + x) + 1).alias("line_no"),
        F.when(indented, owner).alias("class_name"), name.alias("name"), body.alias("body"))
    return rows.select(
        "*", F.when(F.col("class_name").isNotNull(), F.concat_ws(".", "class_name", "name")).otherwise(F.col("name")).alias("qualified"))


def function_defs(fns: DataFrame) -> DataFrame:
    """Functions and ``Class.method`` names with file and line; the last definition of a name wins."""
    both = fns.select(F.explode(F.array_distinct(F.array("name", "qualified"))).alias("function_name"), "path", "line_no")
    return both.groupBy("function_name").agg(F.max(F.struct("path", "line_no")).alias("d")).select("function_name", "d.path", "d.line_no")


def called_names(body: Column) -> Column:
    """Names called without a qualifier, and functions handed to background tasks."""
    code = F.regexp_replace(F.regexp_replace(body, STRING, "''"), r"#[^\n]*", "")
    direct = all_matches(code, r"(?<![\w.])(?<!def )([A-Za-z_]\w*)\s*\(")
    background = all_matches(code, r"background_tasks\.add_task\(\s*([A-Za-z_]\w*)")
    return F.filter(
        F.array_distinct(F.concat(direct, background)),
        lambda n: ~n.isin(SKIPPED_CALLS + BUILTIN_CALLS + STATEMENT_WORDS) & ~n.rlike("(?:Exception|Error)$"))


def call_edges(fns: DataFrame) -> DataFrame:
    """(caller, callee) of the call graph."""
    return fns.select(F.col("name").alias("caller"), F.explode(called_names(F.col("body"))).alias("callee")).distinct()


def with_nodes(fns: DataFrame) -> DataFrame:
    """``fns`` with ``name`` unique over all files: file, then class and function."""
    return fns.withColumn("name", node_of(F.col("file_id"), F.col("qualified")))


def node_of(file_id: Column, qualified: Column) -> Column:
    return F.concat_ws(":", file_id.cast("string"), qualified)


def function_scope(lines: DataFrame) -> DataFrame:
    """Exported function around each line of a user-interface file.

    A function ends when its braces close or at the next export; braces are counted in ``code``, the line without
    those in strings and comments, where the input has it. Running values are carried
    across blocks of lines, so one very long file does not become one task.
    """
    lines = lines if "code" in lines.columns else lines.withColumn("code", T.mask_code(F.col("line")))
    export = F.regexp_extract("line", r"export\s+(?:const\s+(\w+)\s*=|(?:async\s+)?function\s+\w+)", 1)
    by_function = F.regexp_extract("line", r"export\s+(?:async\s+)?function\s+(\w+)", 1)
    name = F.nullif(F.when(export != "", export).otherwise(by_function), F.lit(""))
    count = lambda c: F.length("code") - F.length(F.replace("code", F.lit(c), F.lit("")))
    delta = count("{") - count("}")
    base = running(
        lines.select("file_id", "line_no", "line", "code"), ["file_id"], "line_no",
        {"fn": name, "fn_start": F.when(name.isNotNull(), F.col("line_no"))}, {"depth": delta})
    spans = base.where("fn_start is not null").groupBy("file_id", "fn_start").agg(
        F.min_by(F.col("depth") - delta, "line_no").alias("before"),
        F.min(F.when(F.col("code").contains("{"), F.col("line_no"))).alias("opened"))
    closing = (F.col("depth") <= F.col("before")) & (F.col("line_no") >= F.col("opened"))
    ends = base.join(large(spans), ["file_id", "fn_start"]).groupBy("file_id", "fn_start").agg(
        F.min(F.when(closing, F.col("line_no"))).alias("fn_end"))
    inside = F.col("fn_end").isNull() | (F.col("line_no") <= F.col("fn_end"))
    return base.join(large(ends), ["file_id", "fn_start"], "left").select(
        "file_id", "line_no", F.when(inside, F.col("fn")).alias("function_name"))


# --- tables of functions -------------------------------------------------------------

TABLE_AFTER = r"(?i)\b(?:FROM|JOIN|UPDATE|INSERT\s+INTO|MERGE\s+INTO|DELETE\s+FROM)\s+([a-zA-Z0-9_]+)(?=\s|$|\)|,)"
STRING = r"\"\"\"((?s:.*?))\"\"\"|'''((?s:.*?))'''|\"([^\"\n]*)\"|'([^'\n]*)'"


def looks_like_sql(text: Column) -> Column:
    """At least ten characters, and two hint words or one SQL shape."""
    upper = F.upper(text)
    hints = F.size(F.filter(F.array(*[F.lit(w) for w in rules.SQL_HINT_WORDS]), lambda w: upper.contains(w)))
    shape = upper.rlike("|".join(f"(?:{s})" for s in rules.SQL_SHAPES))
    return F.coalesce((F.length(text) >= 10) & ((hints >= 2) | shape), F.lit(False))


def table_candidate(name: Column) -> Column:
    """Basic test of a table name: three characters, no keyword or number, and upper case, '_' or Capitalised."""
    upper = (name == F.upper(name)) & name.rlike("[A-Za-z]")
    shaped = upper | name.contains("_") | (name.rlike("^[A-Z]") & (F.length(name) > 4))
    return (F.length(name) >= 3) & ~F.lower(name).isin(rules.TABLE_STOP_WORDS) & ~name.rlike(r"^\d+$") & shaped


def likely_table(name: Column) -> Column:
    """Strict test: upper case with '_' or six characters, or '_' with an upper-case letter."""
    upper = (name == F.upper(name)) & name.rlike("[A-Za-z]")
    return (F.length(name) >= 3) & ~F.lower(name).isin(rules.TABLE_STOP_WORDS) & (
        (upper & (name.contains("_") | (F.length(name) > 5))) | (name.contains("_") & name.rlike("[A-Z]")))


def subquery_names(text: Column) -> Column:
    return F.concat(all_matches(text, r"(?i)with\s+([a-zA-Z0-9_]+)\s+as\s*\("), all_matches(text, r"(?i),\s*([a-zA-Z0-9_]+)\s+as\s*\("))


def candidate_names(text: Column) -> Column:
    """Names in table position of a SQL text that are no subqueries, tested for plausibility."""
    return F.filter(all_matches(text, TABLE_AFTER), lambda n: ~F.array_contains(subquery_names(text), n) & table_candidate(n))


def sql_tables(texts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(text_id, table_name) of SQL texts; a known table needs no plausibility test."""
    rows = texts.select("text_id", F.explode(F.array_distinct(candidate_names(F.col("text")))).alias("n"))
    found = rows.select("text_id", F.upper("n").alias("table_name"))
    if known is not None:
        names = texts.select("text_id", F.explode(F.array_distinct(all_matches(F.col("text"), TABLE_AFTER))).alias("table_name"))
        found = found.unionByName(names.join(large(known.select("table_name")), "table_name", "left_semi").select("text_id", "table_name"))
    return found.distinct()


def string_constants(body: Column) -> Column:
    """Contents of the string literals of a piece of code."""
    return F.transform(all_matches(body, STRING, 0), lambda s: F.regexp_replace(s, r"^(?:\"\"\"|'''|[\"'])|(?:\"\"\"|'''|[\"'])$", ""))


def function_sql_tables(fns: DataFrame) -> DataFrame:
    """Tables in SQL strings of functions."""
    sql = F.filter(string_constants(F.col("body")), looks_like_sql)
    names = F.filter(F.flatten(F.transform(sql, candidate_names)), likely_table)
    return fns.select("name", F.explode(F.array_distinct(F.transform(names, lambda n: F.upper(n)))).alias("table_name")).distinct()


def dynamic_tables(fns: DataFrame) -> DataFrame:
    """Strings assigned to ``table_name`` or ``table`` in a branch."""
    return fns.select("name", F.explode(all_matches(
        F.col("body"), r"(?m)^[ \t]{5,}(?:table_name|table)\s*=\s*[\"'](\w+)[\"']")).alias("t")).select(
        "name", F.upper("t").alias("table_name")).distinct()


def attr_tables(fns: DataFrame, model_map: DataFrame, app: rules.AppRules = rules.AppRules()) -> DataFrame:
    """Tables of models used as ``X.col``, ``X.c.col`` or as a bare argument."""
    owners = all_matches(F.col("body"), r"(?<![\w.])([A-Za-z_]\w*)\.\w+")
    arguments = all_matches(F.col("body"), r"[(,]\s*([A-Z]\w*)\s*(?=[,)])")
    used = fns.select("name", F.explode(F.array_distinct(F.concat(owners, arguments))).alias("model_name")).distinct()
    resolved = model_resolve(used, model_map, app)
    return used.join(large(resolved), "model_name").select("name", "table_name").distinct()


def function_tables(fns: DataFrame, model_map: DataFrame, app: rules.AppRules = rules.AppRules()) -> DataFrame:
    """All tables a function touches itself."""
    return function_sql_tables(fns).unionByName(dynamic_tables(fns)).unionByName(attr_tables(fns, model_map, app)).distinct()


# --- procedures, services and flows of functions ---------------------------------------

# Fixed patterns: procedure calls inside SQL strings.
PROCEDURE_CALLS = [
    r"CALL\s+([A-Z_][A-Z0-9_]*)\s*\(", r"CALL\s+IDENTIFIER\s*\(\s*[\"']([A-Z_][A-Z0-9_]*)[\"']",
    r"CREATE\s+(?:OR\s+REPLACE\s+)?PROCEDURE\s+([A-Z_][A-Z0-9_]*)",
]


def procedure_names(body: Column) -> Column:
    in_sql = [all_matches(F.upper(body), p) for p in PROCEDURE_CALLS]
    keyword = all_matches(body, r"proc_name\s*=\s*[\"'](\w+)[\"']")
    constants = all_matches(body, r"\b\w*ProcedureNames\.(\w+)")
    return F.array_distinct(F.concat(*in_sql, keyword, constants))


def proc_calls(fns: DataFrame) -> DataFrame:
    """(name, procedure) stated in a function's own text."""
    return fns.select("name", F.explode(procedure_names(F.col("body"))).alias("procedure")).distinct()


def service_proc_map(fns: DataFrame, hints: list[str] = rules.PROCEDURE_FUNCTION_HINTS) -> DataFrame:
    """Function -> procedures for service-like functions, by short and qualified name."""
    hinted = F.lit(False)
    for hint in hints:
        hinted = hinted | F.lower("qualified").contains(hint)
    rows = fns.where(hinted).select(
        F.array_distinct(F.array("name", "qualified")).alias("keys"), F.explode(procedure_names(F.col("body"))).alias("procedure")
    ).select(F.explode("keys").alias("function_name"), "procedure")
    return rows.distinct()


def function_procs(fns: DataFrame, edges: DataFrame, proc_map: DataFrame) -> DataFrame:
    """Procedures of a function: its own and those mapped to the functions it calls."""
    called = edges.join(large(proc_map), F.col("callee") == F.col("function_name")).select(F.col("caller").alias("name"), "procedure")
    methods = service_calls(fns).select("name", F.col("method").alias("function_name")).distinct().join(
        large(proc_map), "function_name").select("name", "procedure")
    return proc_calls(fns).unionByName(called).unionByName(methods).distinct()


def service_alias(files: DataFrame) -> DataFrame:
    """(file_id, alias, service_class) from imports and ``with`` blocks."""
    imports = F.flatten(F.transform(
        match_pairs(F.regexp_replace("text", r"#[^\n]*|\\\r?\n", ""), r"(?m)^[ \t]*from\s+([\w.]*services[\w.]*)\s+import\s*(\([^)]*\)|[^\n(]+)"),
        lambda m: F.filter(F.transform(F.split(F.translate(m["b"], "()", ""), ","), lambda n: F.regexp_replace(n, r"^\s+|\s+$", "")), lambda n: n != "")))
    imported = F.transform(imports, lambda n: F.struct(
        F.regexp_extract(n, r"(\w+)$", 1).alias("alias"), F.regexp_extract(n, r"^(\w+)", 1).alias("service_class")))
    managed = F.transform(
        match_pairs(F.col("text"), r"\bwith\s+(\w+)\s*\([^)\n]*\)\s+as\s+(\w+)"),
        lambda m: F.struct(m["b"].alias("alias"), m["a"].alias("service_class")))
    rows = F.filter(F.concat(imported, managed), lambda r: F.lower(r["service_class"]).contains("service"))
    return files.where(F.col("path").endswith(".py")).select("file_id", F.inline(F.array_distinct(rows)))


def service_calls(fns: DataFrame) -> DataFrame:
    """(file_id, name, owner, method) of every ``owner.method(`` call."""
    calls = match_pairs(F.col("body"), r"(?<![\w.])([A-Za-z_]\w*)\.(\w+)\s*\(")
    return fns.select("file_id", "name", F.explode(F.array_distinct(calls)).alias("c")).select(
        "file_id", "name", F.col("c.a").alias("owner"), F.col("c.b").alias("method"))


def service_resolve(fns: DataFrame, aliases: DataFrame, target: str = "qualified") -> DataFrame:
    """Method behind each service call: exact, lower-case, bare, with and without 'Service'; first hit.

    ``target`` names the column of ``fns`` that is returned for a method.
    """
    calls = service_calls(fns.withColumn("name", F.col(target)) if target != "qualified" else fns).withColumnRenamed("owner", "alias").join(large(aliases), ["file_id", "alias"])
    owner = F.col("service_class")
    keys = F.array(
        F.concat_ws(".", owner, "method"), F.concat_ws(".", F.lower(owner), "method"), F.col("method"),
        F.concat_ws(".", F.concat(owner, F.lit("Service")), "method"),
        F.concat_ws(".", F.replace(owner, F.lit("Service"), F.lit("")), "method"))
    methods = fns.where(F.lower("class_name").contains("service")).select(
        F.explode(F.array_distinct(F.array(
            F.concat_ws(".", "class_name", "name"), F.concat_ws(".", F.lower("class_name"), "name"), F.col("name")))).alias("key"),
        F.col(target).alias("target")).groupBy("key").agg(F.max("target").alias("target"))
    tried = calls.select("name", "alias", "method", F.posexplode(keys).alias("rank", "key")).join(large(methods), "key")
    return first_per_key(tried, ["name", "alias", "method"], F.col("rank"), ["target"])


def flow_calls(fns: DataFrame, files: DataFrame) -> DataFrame:
    """(name, flow_call): methods called on the flow service or its alias."""
    aliases = files.select("file_id", F.concat(
        F.array(F.lit("flow_service")), all_matches(F.col("text"), r"\bwith\s+flow_service\s+as\s+(\w+)")).alias("aliases"))
    # One row per file on the right and few calls survive the first test.
    calls = service_calls(fns)
    return calls.join(large(aliases), "file_id").where(F.array_contains("aliases", F.col("owner"))).select(
        "name", F.col("method").alias("flow_call")).distinct()
