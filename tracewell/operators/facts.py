"""Facts of view and table definitions.

Input: (object_id, ddl_text) and any other columns, which are kept. A definition is one
row; its scopes, table references and select items are arrays inside that row, so every
step up to the final explode is a narrow map. Nothing here shuffles.

A *scope* is one query block: each named subquery (``cte``), each derived table in FROM (``derived``), each
other subquery (``subquery``), and the main select (kind ``main``, name ''). The selects of a set operation are
branches of one scope. Brackets are taken out level by level (``nesting``), so scopes may be nested to any depth, and
each one's text shows its own level only. A scope's name is that of the subquery or its alias; where several
have the same, all but the last to close carry a number. Names mean what the nearest WITH around them declares.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import nesting as N
from tracewell.functions import text as T

CONTROL = "\x01\x02\x04\x05\x06\x07\x08"
HEAD = (
    r"(?i)^\s*CREATE (?:OR REPLACE )?"
    r"(?:(?:SECURE|RECURSIVE|MATERIALIZED|TEMPORARY|TEMP|TRANSIENT|LOCAL|GLOBAL|VOLATILE) )*"
    rf"(VIEW|TABLE) (?:IF NOT EXISTS )?({T.NAME})\s*(?:\x04(\d+)\x05)?"
)


def parsed(ddl: DataFrame) -> DataFrame:
    """Definition type, name, declared columns and query text of each definition, by bracket level.

    The query starts after the first AS outside brackets that a WITH, a SELECT or a query in brackets follows.
    """
    head = lambda i: F.regexp_extract("level", HEAD, i)
    flat = F.regexp_extract("rest", rf"(?i)^(?:.*?\s)??AS\s*((?:WITH|SELECT)\b.*|{N.QUERY}.*)$", 1)
    lone = F.regexp_extract("flat", rf"^\x06(\d+)\x07$", 1)
    return (
        ddl.withColumn("sql", T.normalise_sql(
            F.when(F.col("ddl_text").rlike(f"[{CONTROL}]"), F.translate("ddl_text", CONTROL, " " * len(CONTROL))).otherwise(F.col("ddl_text"))))
        .withColumn("levels", N.depth(F.col("sql")))
        .withColumn("unsupported_depth", F.col("sql").isNotNull() & F.col("levels").isNull())
        .withColumn("nest", N.nested(F.when(F.col("levels").isNotNull(), F.col("sql")).otherwise(""), F.coalesce("levels", F.lit(0))))
        .withColumn("level", F.when(F.col("levels").isNull(), F.regexp_extract("sql", r"^[^()]*", 0)).otherwise(F.col("nest.text")))
        .withColumn("ddl_type", F.coalesce(F.nullif(F.lower(head(1)), F.lit("")), F.lit("unsupported")))
        .withColumn("object_name", T.shown(head(2)))
        .withColumn("declared", F.coalesce(F.get("nest.surface", F.nullif(head(3), F.lit("")).cast("int")), F.lit("")))
        .withColumn("rest", T.let(F.regexp_replace("level", HEAD, ""), lambda r: F.when(r.contains(";"), F.regexp_replace(r, r"\s*;\s*$", "")).otherwise(r)))
        .withColumn("flat", F.trim(flat))
        .withColumn("has_query", F.col("flat") != "")
        .withColumn("flat", F.when(lone != "", F.get("nest.surface", F.nullif(lone, F.lit("")).cast("int"))).otherwise(F.col("flat")))
        .withColumn("is_supported", (F.col("ddl_type") != "unsupported") & ~F.col("unsupported_depth"))
        .withColumn("identifier_table", F.when(~F.col("ddl_text").rlike("(?i)IDENTIFIER"), "").otherwise(F.regexp_extract(
            T.strip_comments(F.col("ddl_text")), r"(?i)\bIDENTIFIER\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1)))
        .withColumn("uses_identifier", F.col("sql").rlike(r"(?i)\bIDENTIFIER\s*\("))
        .drop("rest", "level", "levels")
    )


def declared_columns(declared: Column) -> Column:
    """Column names of a declared list; table constraints are left out."""
    items = F.filter(
        F.transform(F.split(declared, ","), lambda i: F.trim(i)),
        lambda i: (i != "") & ~i.rlike(r"(?i)^(?:CONSTRAINT|PRIMARY|FOREIGN|UNIQUE|CHECK)\b"),
    )
    return F.transform(items, lambda i: T.shown(F.regexp_extract(i, r"^([\w$]+)", 1)))


SET_OPERATOR = rf"(?i)\b(?:{'|'.join(T.SET_OPERATORS)})\b"
NO_BRANCHES = "CAST(array() AS array<struct<segs:array<struct<kw:string,txt:string>>>>)"


def select_parts(kind: Column, text: Column) -> Column:
    """Struct of ``segs``, the segments of the select that names the columns, and ``branches``, those of the
    other selects of a set operation. ``text`` shows its own level, so it has no brackets.

    In a subquery the first select gives the names, in the main query the best one: more items, a
    star, FROM and WHERE score higher, and the first one with the top score wins.
    """
    pattern = "|".join(T.SET_OPERATORS)
    marked = F.regexp_replace(text, rf"(?i)(\b(?:{pattern})\b)", f"{T.MARK}$1{T.MARK}")
    plain = F.replace(marked, F.lit(T.MARK * 2), F.lit(""))
    segments = lambda t: T.segments(t, groups=False)
    texts = F.split(plain, rf"(?i){T.MARK}(?:{pattern}){T.MARK}(?:\s*(?:ALL|DISTINCT)\b)?")
    scored = F.transform(texts, lambda b, i: T.let(segments(b), lambda segs: F.struct(
        F.when(kind == "main", select_score(segs)).otherwise(0).alias("score"), (-i).alias("order"), segs.alias("segs"))))
    several = T.let(scored, lambda parts: T.let(F.array_max(parts), lambda lead: F.struct(
        lead["segs"].alias("segs"),
        F.transform(F.filter(parts, lambda p: p["order"] != lead["order"]), lambda p: F.struct(p["segs"].alias("segs"))).alias("branches"))))
    return F.when(text.rlike(SET_OPERATOR), several).otherwise(F.struct(segments(text).alias("segs"), F.expr(NO_BRANCHES).alias("branches")))


def in_branches(scope: Column, field: str, value) -> Column:
    """The scope with ``value`` of itself, and of each of its branches, in ``field``."""
    return scope.withField(field, value(scope)).withField("branches", F.transform(scope["branches"], lambda b: b.withField(field, value(b))))


def select_score(segs: Column) -> Column:
    """More items, a star, FROM and WHERE score higher."""
    return T.let(T.select_texts(segs), lambda items: T.let(
        F.size(F.filter(items, T.is_star)),
        lambda stars: F.size(items)
        + F.when((stars > 0) & (F.size(items) > stars), 10).when(stars > 0, 5).otherwise(0)
        + F.when(F.exists(segs, lambda s: s["kw"] == "FROM"), 3).otherwise(0)
        + F.when(F.exists(segs, lambda s: s["kw"] == "WHERE"), 2).otherwise(0),
    ))


CTE = rf"({T.WORD})\s*(?:\x04(\d+)\x05)?\s*AS\s*(?:(?:NOT )?MATERIALIZED )?\s*\x06(\d+)\x07"
WITH_HEAD = rf"(?i)^WITH (?:RECURSIVE )?((?:{CTE.replace('(', '(?:').replace('(?:?:', '(?:')}\s*,?\s*)++)(.*)$"
BRACKETED_SELECT = rf"(?i)(^|\b{N.SET_OPERATORS}(?: ALL| DISTINCT)? )({N.QUERY})"
#: A table expression that is a call; IDENTIFIER names a table instead.
CALL = rf"(?i)^(?:LATERAL )?(?!IDENTIFIER\b)({T.NAME})\s*\x04(\d+)\x05"
ENV = "array<struct<id:int,children:array<int>,visible:array<struct<name:string,key:string>>>>"


def block(number: Column, text: Column) -> Column:
    """Struct of one query: its number, named subqueries, selects without the WITH, and the subqueries right below it."""
    with_ = text.rlike("(?i)^WITH ")
    return T.let(F.when(with_, F.regexp_extract(text, WITH_HEAD, 1)).otherwise(""), lambda head: T.let(
        F.when(head != "", F.regexp_extract(text, WITH_HEAD, 2)).otherwise(text), lambda rest: _block(number, text, with_, head, rest)))


def _block(number: Column, text: Column, with_: Column, head: Column, rest: Column) -> Column:
    each = lambda i: F.regexp_extract_all(head, F.lit(f"(?i){CTE}"), F.lit(i))
    ctes = F.transform(F.arrays_zip(each(1).alias("name"), each(2).alias("columns"), each(3).alias("id")), lambda z: F.struct(
        F.lower(z["name"]).alias("name"), z["id"].cast("int").alias("id"), F.nullif(z["columns"], F.lit("")).cast("int").alias("columns")))
    return F.struct(
        number.alias("id"), F.coalesce(F.get("nest.closed", number), F.lit(2 ** 31 - 1)).alias("closed"),
        F.when(with_, ctes).otherwise(F.expr("CAST(array() AS array<struct<name:string,id:int,columns:int>>)")).alias("ctes"),
        F.when(rest.contains("\x07"), F.regexp_replace(rest, BRACKETED_SELECT, "$1SELECT * FROM $2")).otherwise(rest).alias("text"),
        F.when(F.col("has_inner"), N.query_numbers(N.put_back(text, F.col("nest.inlined"), N.GROUP))).otherwise(F.expr("CAST(array() AS array<int>)")).alias("children"))


def blocks_column() -> Column:
    """The queries of a definition, innermost first in the order of their closing brackets; the main one is last."""
    main = block(F.lit(-1), F.col("flat"))
    numbers = F.filter(F.sequence(F.lit(0), F.size("nest.surface")), lambda k: F.get("nest.surface", k).rlike(N.IS_QUERY))
    inner = F.transform(numbers, lambda k: block(k, F.get("nest.surface", k)))
    # A query in brackets of its own, which stand for nothing, is not below any other.
    below = lambda all_, m: F.concat(m["children"], F.flatten(F.transform(all_, lambda x: x["children"])))
    in_order = lambda all_: F.array_sort(all_, lambda x, y: x["closed"] - y["closed"])
    both = T.let(main, lambda m: T.let(inner, lambda all_: F.concat(
        in_order(T.let(below(all_, m), lambda used: F.filter(all_, lambda b: F.array_contains(used, b["id"])))), F.array(m))))
    return F.when(F.col("is_supported") & F.col("has_query"), F.when(F.col("has_inner"), both).otherwise(F.array(main)))


def table_of(kw: Column, txt: Column, ordinal: Column) -> Column:
    """Table reference of one FROM or JOIN piece: a table, a derived table (``child``) or a table function (``args``)."""
    child = F.when(txt.contains("\x06"), F.regexp_extract(txt, r"(?i)^(?:LATERAL )?\x06(\d+)\x07", 1)).otherwise("")
    call = F.when(txt.contains("\x04"), F.regexp_extract(txt, CALL, 2)).otherwise("")
    after = rf"(?i)^(?:(?:LATERAL )?(?:{T.NAME}\s*{N.GROUP}|{N.QUERY})\s*|{T.NAME} )(?:AS )?({T.WORD})"
    return T.let(child, lambda c: T.let(call, lambda f: T.let(F.regexp_extract(txt, after, 1), lambda a: _table(kw, txt, ordinal, c, f, a))))


def _table(kw: Column, txt: Column, ordinal: Column, child: Column, call: Column, alias: Column) -> Column:
    plain = F.regexp_extract(txt, rf"^({T.NAME})(?![\w$.]|\s*\x04)", 1)
    inner = (child != "") | (call != "")
    name = F.when(inner & (alias != ""), alias).when(child != "", F.concat(F.lit("subquery_"), child)).when(call != "", F.regexp_extract(txt, CALL, 1)).otherwise(plain)
    given = F.regexp_replace(F.get("nest.inlined", F.nullif(call, F.lit("")).cast("int")), rf"\b{T.WORD}\s*=>", "")
    arguments = T.column_refs(N.without_queries(given, "0"))
    return T.let(name, lambda name: F.struct(
        ordinal.cast("int").alias("ordinal"), F.when(kw == "JOIN", "join").otherwise("from").alias("clause"), T.shown(name).alias("table_name"),
        F.lower(T.shown(F.when(alias != "", alias).otherwise(F.substring_index(name, ".", -1)))).alias("alias"),
        F.nullif(child, F.lit("")).cast("int").alias("child"), F.when(call != "", arguments).alias("args")))


IS_TABLE = rf"^(?:(?i:LATERAL )?{N.QUERY}|{T.NAME}(?![\w$.]|\s*\x04))"


def tables_of_select(segs: Column) -> Column:
    """Table references of one select in order; the object itself is not one of its sources."""
    inside = T.from_part(segs, lambda txt: txt.rlike(IS_TABLE) | txt.rlike(CALL))
    return F.filter(F.transform(inside, lambda s, i: table_of(s["kw"], s["txt"], i + 1)), lambda t: F.lower(t["table_name"]) != F.lower(F.col("object_name")))


@cache
def selects_column() -> Column:
    """``blocks`` with segments and tables of their selects."""
    return F.transform("blocks", lambda b: T.let(select_parts(F.when(b["id"] == -1, "main").otherwise("inner"), b["text"]), lambda parts: F.struct(
        b["id"].alias("id"), b["ctes"].alias("ctes"), b["children"].alias("children"), b["text"].alias("text"), parts["segs"].alias("segs"), tables_of_select(parts["segs"]).alias("tables"),
        F.transform(parts["branches"], lambda x: F.struct(x["segs"].alias("segs"), tables_of_select(x["segs"]).alias("tables"))).alias("branches"))))


@cache
def named_column() -> Column:
    """For each block: id, kind, name, declared columns, and ``key``, the name that only this block has."""
    named = F.concat(
        F.flatten(F.transform("selects", lambda b: F.transform(b["ctes"], lambda c: F.struct(
            c["id"].alias("id"), F.lit("cte").alias("kind"), c["name"].alias("name"), c["columns"].alias("columns"))))),
        F.flatten(F.transform("selects", lambda b: F.flatten(F.transform(
            F.concat(F.array(b["tables"]), F.transform(b["branches"], lambda x: x["tables"])),
            lambda tables: F.transform(F.filter(tables, lambda t: t["child"].isNotNull()), lambda t: F.struct(
                t["child"].alias("id"), F.lit("derived").alias("kind"), t["alias"].alias("name"), F.lit(None).cast("int").alias("columns"))))))))
    found = T.let(named, lambda names: F.transform("selects", lambda b: F.when(b["id"] == -1, F.struct(
        F.lit(-1).alias("id"), F.lit("main").alias("kind"), F.lit("").alias("name"), F.lit(None).cast("int").alias("columns"))).otherwise(F.coalesce(
            F.get(F.filter(names, lambda n: n["id"] == b["id"]), F.lit(0)), F.struct(
                b["id"].alias("id"), F.lit("subquery").alias("kind"), F.concat(F.lit("subquery_"), b["id"].cast("string")).alias("name"), F.lit(None).cast("int").alias("columns"))))))
    several = T.let(found, lambda all_: T.let(F.transform(all_, lambda n: n["name"]), lambda names: F.transform(all_, lambda n, i: n.withField(
        "key", F.when(F.size(F.filter(names, lambda m, j: (m == n["name"]) & (j > i))) > 0, F.concat_ws("#", n["name"], n["id"].cast("string"))).otherwise(n["name"])))))
    # A definition of one block has the main one only.
    main = F.struct(F.lit(-1).alias("id"), F.lit("main").alias("kind"), F.lit("").alias("name"), F.lit(None).cast("int").alias("columns"), F.lit("").alias("key"))
    return F.when(F.size("selects") == 1, F.array(main)).otherwise(several)


@cache
def visible_column() -> Column:
    """The named subqueries that each block sees, nearest first, worked out from the main query inwards."""
    key = lambda number: F.get(F.filter("names", lambda n: n["id"] == number), F.lit(0))["key"]
    own = lambda b: F.transform(b["ctes"], lambda c: F.struct(c["name"].alias("name"), key(c["id"]).alias("key")))
    above = lambda known, b: F.coalesce(F.get(F.filter(known, lambda k: F.array_contains(k["children"], b["id"])), F.lit(0))["visible"],
                                        F.expr("CAST(array() AS array<struct<name:string,key:string>>)"))
    step = lambda known, b: F.concat(known, F.array(F.struct(
        b["id"].alias("id"), b["children"].alias("children"), F.concat(own(b), above(known, b)).alias("visible"))))
    return F.reduce(F.reverse("selects"), F.expr(f"CAST(array() AS {ENV})"), step)


@cache
def scopes_column() -> Column:
    """The blocks as scopes; each table has the ``key`` of the scope it stands for, null for a table of the catalog."""
    def keyed(tables: Column, seen: Column, self_: Column) -> Column:
        def key(t: Column) -> Column:
            child = F.get(F.filter("names", lambda n: n["id"] == t["child"]), F.lit(0))["key"]
            cte = F.get(F.filter(seen, lambda v: v["name"] == F.lower(t["table_name"])), F.lit(0))["key"]
            return F.when(t["child"].isNotNull(), child).otherwise(F.when(t["args"].isNull(), T.let(cte, lambda c: F.when(c != self_, c))))

        return F.transform(tables, lambda t: t.withField("key", key(t)))

    def scope(b: Column, i: Column, n: Column, seen: Column) -> Column:
        return F.struct(
            (i + 1).cast("int").alias("ordinal"), n["kind"].alias("kind"), n["key"].alias("name"), n["columns"].alias("columns"),
            b["segs"].alias("segs"), keyed(b["tables"], seen, n["key"]).alias("tables"),
            F.transform(b["branches"], lambda x: F.struct(x["segs"].alias("segs"), keyed(x["tables"], seen, n["key"]).alias("tables"))).alias("branches"))

    return F.transform("selects", lambda b, i: T.let(F.get("names", i), lambda n: T.let(
        F.get("visible", F.size("visible") - 1 - i)["visible"], lambda seen: scope(b, i, n, seen))))


def scoped(ddl: DataFrame) -> DataFrame:
    """Adds ``scopes``: array of (ordinal, kind, name, columns, segs, tables, branches) for each supported query,
    and ``ctes``, the named subqueries (name, body) by their closing brackets."""
    ctes = F.transform(F.filter(F.flatten(F.transform("selects", lambda b: F.transform(b["ctes"], lambda c: F.struct(
        F.get("nest.closed", c["id"]).alias("closed"), c["name"].alias("name"), F.get("nest.whole", c["id"]).alias("body"))))),
        lambda c: c.isNotNull()), lambda c: c)
    none = F.expr("CAST(array() AS array<struct<name:string,body:string>>)")
    return (
        parsed(ddl).withColumn("has_inner", F.col("flat").contains("\x07") | F.exists("nest.surface", lambda g: g.contains("\x07")))
        .withColumn("blocks", blocks_column())
        .withColumn("selects", selects_column())
        .withColumn("names", named_column())
        .withColumn("visible", visible_column())
        .withColumn("scopes", scopes_column())
        .withColumn("ctes", F.coalesce(F.transform(F.array_sort(ctes), lambda c: F.struct(c["name"].alias("name"), c["body"].alias("body"))), none))
        .drop("blocks", "selects", "visible", "flat", "has_inner")
    )


# The columns below do not depend on the input, so each is built once per process.


def item_struct(text: Column, position: Column, columns: Column) -> Column:
    """A select item from its text on its own bracket level; ``columns`` are names declared for its place."""
    return T.let(T.split_alias(text), lambda p: T.let(N.put_back(p["expr"], F.col("nest.whole"), N.ANY_TOKEN), lambda expr: F.struct(
        (position + 1).cast("int").alias("ordinal"),
        F.coalesce(F.when(F.get(columns, position).isNotNull() & ~T.is_star(expr), F.get(columns, position)), T.shown(T.output_name(expr, p["alias"], position + 1))).alias("out_name"),
        T.shown(expr).alias("expr"), T.item_kind(p["expr"]).alias("kind"),
        F.when(expr.contains(".*"), F.lower(T.shown(F.regexp_extract(expr, rf"^({T.NAME})\.\*", 1)))).otherwise("").alias("star_qualifier"),
        p["expr"].alias("level"))))


def itemised(scope: Column) -> Column:
    """The scope with ``items``."""
    return T.let(declared_columns(F.get("nest.surface", scope["columns"])), lambda columns: in_branches(
        scope, "items", lambda b: F.transform(T.select_texts(b["segs"]), lambda text, i: item_struct(text, i, columns))))


@cache
def items_column() -> Column:
    return F.transform("scopes", itemised)


def with_items(scopes: DataFrame) -> DataFrame:
    """Adds ``items`` to every scope: output name, expression, kind and star qualifier."""
    return scopes.withColumn("scopes", items_column())


def shown_refs(refs: Column) -> Column:
    return F.transform(refs, lambda r: F.struct(T.shown(r["qualifier"]).alias("qualifier"), T.shown(r["column_name"]).alias("column_name")))


def referring(scope: Column) -> Column:
    """The scope with root type and references of its items; a subquery in one is named in ``below``, but for EXISTS, which has no value."""
    none = F.expr("CAST(array() AS array<struct<qualifier:string,column_name:string>>)")
    inlined = lambda i: N.put_back(i["level"], F.col("nest.inlined"), N.GROUP)
    key = lambda k: F.get(F.filter("names", lambda n: n["id"] == k), F.lit(0))["key"]
    root = lambda i: F.when(i["level"].rlike(f"^{N.QUERY}$"), "Subquery").otherwise(T.expression_type(F.regexp_replace(i["level"], N.ANY_TOKEN, "()")))
    # A plain column is its own reference.
    refs = lambda i: F.when(i["kind"] == "star", none).when(i["kind"] == "column", shown_refs(T.named_refs(F.array(i["level"])))).otherwise(
        T.let(inlined(i), lambda text: shown_refs(T.column_refs(N.without_queries(text, " 0 ")))))
    below = lambda i: F.when(i["kind"] == "column", F.expr("CAST(array() AS array<string>)")).otherwise(T.let(inlined(i), lambda text: F.transform(
        N.query_numbers(N.without_queries(text, "", r"(?i)\bEXISTS\s*")), lambda k: key(k))))
    described = lambda i: i.withField("expr_type", F.when(i["kind"] == "derived", root(i)).otherwise("")).withField(
        "refs", refs(i)).withField("below", below(i)).dropFields("level")
    # Texts of clauses and items are not carried any further.
    with_refs_ = lambda b: F.transform(b["items"], described)
    return scope.withField("items", with_refs_(scope)).withField("branches", F.transform(
        scope["branches"], lambda b: b.withField("items", with_refs_(b)).dropFields("segs"))).dropFields("segs")


@cache
def refs_column() -> Column:
    return F.transform("scopes", lambda s: T.let(itemised(s), referring))


def with_refs(scopes: DataFrame) -> DataFrame:
    """Adds ``items`` with root type, column references and subqueries to every scope."""
    return scopes.withColumn("scopes", refs_column())


def with_object_columns(items: DataFrame) -> DataFrame:
    """Adds ``object_columns``: the declared list, else the names of the main select."""
    main = F.element_at(F.col("scopes"), -1)["items"]
    names = F.filter(F.transform(main, lambda i: i["out_name"]), lambda n: n.isNotNull())
    selected = F.when(F.exists(main, lambda i: i["kind"] == "star"), F.array().cast("array<string>")).otherwise(names)
    declared = F.col("listed")
    return items.withColumn("listed", declared_columns(F.col("declared"))).withColumn(
        "object_columns",
        F.when(~F.col("is_supported"), F.array().cast("array<string>"))
        .when(F.size(declared) > 0, declared)
        .when(F.col("has_query"), selected)
        .otherwise(F.array().cast("array<string>")),
    )


# --- operators -----------------------------------------------------------------------


def ddl_classify(ddl: DataFrame) -> DataFrame:
    """Type, name and query flag of every definition; one without text is unsupported."""
    return parsed(ddl.withColumn("ddl_text", F.coalesce("ddl_text", F.lit("")))).select("object_id", "ddl_type", "object_name", "has_query", "is_supported", "unsupported_depth")


def ddl_object_columns(ddl: DataFrame) -> DataFrame:
    """Ordered output columns."""
    cols = with_object_columns(with_items(scoped(ddl)))
    return cols.select("object_id", F.posexplode(T.elements("object_columns")).alias("pos", "column_name")).select(
        "object_id", (F.col("pos") + 1).cast("int").alias("ordinal"), "column_name"
    )


def ddl_dedup_columns(columns: DataFrame) -> DataFrame:
    """First occurrence of every output column."""
    return columns.groupBy("object_id", "column_name").agg(F.min("ordinal").alias("ordinal"))


def ddl_pattern(ddl: DataFrame) -> DataFrame:
    """Analysis pattern by IDENTIFIER use, named subqueries and select-list stars."""
    stars = F.exists("scopes", lambda s: F.exists(s["items"], lambda i: i["kind"] == "star"))
    has_star, has_cte = F.coalesce(stars, F.lit(False)), F.size("ctes") > 0
    pattern = (
        F.when(F.col("uses_identifier"), "identifier_function")
        .when(has_cte & has_star, "hybrid")
        .when(has_cte, "nested_cte_dominant")
        .when(has_star, "wildcard_dominant")
        .otherwise("hybrid")
    )
    return with_items(scoped(ddl)).select("object_id", T.only_if(F.col("is_supported"), pattern).alias("sql_pattern"))


def ddl_ctes(ddl: DataFrame) -> DataFrame:
    """Named subqueries in order, with their text."""
    return scoped(ddl).select("object_id", F.posexplode(T.elements("ctes")).alias("pos", "cte")).select(
        "object_id", (F.col("pos") + 1).cast("int").alias("ordinal"),
        F.col("cte.name").alias("cte_name"), F.col("cte.body").alias("body"),
    )


def _scope_rows(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("object_id", *extra, F.explode(T.elements("scopes")).alias("scope"))


def ddl_table_refs(ddl: DataFrame) -> DataFrame:
    """Table references of every scope."""
    return _scope_rows(scoped(ddl)).select(
        "object_id", F.col("scope.name").alias("scope_name"), F.inline("scope.tables")
    ).drop("child", "args", "key")


def ddl_select_items(ddl: DataFrame) -> DataFrame:
    """Select items of every scope."""
    rows = with_items(scoped(ddl))
    return _scope_rows(rows).select(
        "object_id", F.col("scope.name").alias("scope_name"), F.explode("scope.items").alias("i"),
        F.get(F.col("scope.tables"), F.lit(0))["table_name"].alias("from_source"),
    ).select("object_id", "scope_name", "i.ordinal", "i.out_name", "i.expr", "i.kind", "i.star_qualifier", "from_source")


def _item_rows(ddl: DataFrame) -> DataFrame:
    rows = _scope_rows(with_refs(scoped(ddl)))
    return rows.select("object_id", F.col("scope.name").alias("scope_name"), F.explode("scope.items").alias("i"))


def ddl_column_refs(ddl: DataFrame) -> DataFrame:
    """Distinct column references of every select item."""
    return _item_rows(ddl).select(
        "object_id", "scope_name", F.col("i.ordinal").alias("item_ordinal"), F.explode(F.array_distinct("i.refs")).alias("r")
    ).select("object_id", "scope_name", "item_ordinal", "r.qualifier", "r.column_name")


def ddl_expr_type(ddl: DataFrame) -> DataFrame:
    """Root operator of every select item; 'Column' and 'Star' for plain ones."""
    kind = F.col("i.kind")
    return _item_rows(ddl).select(
        "object_id", "scope_name", F.col("i.ordinal").alias("ordinal"),
        F.when(kind == "star", "Star").when(kind == "column", "Column").otherwise(F.col("i.expr_type")).alias("expr_type"),
    )


def ddl_window_refs(ddl: DataFrame) -> DataFrame:
    """Columns of window functions with the place they are used in."""
    pattern = rf"(?i)\b{T.WORD}\s*({T.GROUP})(?: (?:IGNORE|RESPECT) NULLS)? OVER\s*({T.GROUP})"
    strip = lambda c: F.regexp_replace(c, r"^\(|\)$", "")
    over = lambda c: T.segments(strip(c), r"PARTITION BY|ORDER BY", commas=False)
    tagged = lambda refs, tag: F.transform(
        refs, lambda r: F.struct(F.lit(tag).alias("context"), r["qualifier"].alias("qualifier"), r["column_name"].alias("column_name")))
    parts = lambda segs, kw, tag: F.flatten(F.transform(
        F.filter(segs, lambda s: s["kw"] == kw), lambda s: tagged(T.column_refs(s["txt"]), tag)))
    calls = _item_rows(ddl).where(F.col("i.expr").rlike(r"(?i)\bOVER\s*\(")).select(
        "object_id", "scope_name", F.col("i.ordinal").alias("item_ordinal"),
        F.explode(F.arrays_zip(
            F.regexp_extract_all("i.expr", F.lit(pattern), F.lit(1)).alias("args"),
            F.regexp_extract_all("i.expr", F.lit(pattern), F.lit(2)).alias("over"),
        )).alias("w"),
    )
    refs = F.concat(
        tagged(T.column_refs(strip(F.col("w.args"))), "argument"),
        parts(over(F.col("w.over")), "PARTITION BY", "partition_by"),
        parts(over(F.col("w.over")), "ORDER BY", "order_by"),
    )
    return calls.select("object_id", "scope_name", "item_ordinal", F.inline(F.array_distinct(refs)))


def ddl_main_select(ddl: DataFrame) -> DataFrame:
    """Score, items, sources and stars of the select that defines the object."""
    main = F.element_at(F.col("scopes"), -1)
    found = F.struct(
        select_score(main["segs"]).cast("int").alias("score"),
        F.size(main["items"]).alias("n_items"),
        F.exists(main["items"], lambda i: i["kind"] == "star").alias("has_wildcard"),
        F.get(main["tables"], F.lit(0))["table_name"].alias("from_source"),
    )
    return with_items(scoped(ddl)).select("object_id", T.only_if(main.isNotNull(), found).alias("m")).select("object_id", "m.*")


def ddl_main_scope(ddl: DataFrame) -> DataFrame:
    """The first select outside named subqueries, with the subqueries taken out."""
    main = F.element_at(F.col("scopes"), -1)
    found = F.struct(
        F.size("scopes").alias("n_scopes"),
        F.array_join(F.transform(main["items"], lambda i: i["expr"]), " | ").alias("exprs"),
        F.array_join(F.transform(main["tables"], lambda t: t["table_name"]), ";").alias("tables"),
    )
    return with_items(scoped(ddl)).select("object_id", T.only_if(main.isNotNull(), found).alias("m")).select("object_id", "m.*")


def ddl_identifier_fn(ddl: DataFrame) -> DataFrame:
    """Definitions over ``IDENTIFIER('T')``: every column comes from T; no literal is an error."""
    known = F.col("identifier_table") != ""
    names = F.when(known, F.array_distinct("object_columns")).otherwise(F.array(F.lit("ERROR")))
    rows = with_object_columns(with_items(scoped(ddl))).select(
        "object_id", "identifier_table", F.explode(F.when(F.col("uses_identifier") & F.col("is_supported"), names)).alias("view_column"))
    return rows.select(
        "object_id", F.upper("view_column").alias("view_column"),
        F.when(known, "DIRECT").otherwise("ERROR").alias("column_type"),
        F.when(known, F.upper("identifier_table")).otherwise("ANALYSIS_ERROR").alias("source_table"),
        F.when(known, F.upper("view_column")).otherwise("ANALYSIS_ERROR").alias("source_column"),
    )
