"""Lineage resolution.

Everything a view column depends on inside its own definition is in one row, so aliases,
chains of named subqueries and wildcards are followed inside that row: the scopes are
folded in order, and each fold step looks its sources up among the columns resolved so
far. No join, no shuffle, no loop over the cluster.

Resolved columns are kept by scope, with their names beside them, so a reference is one search among the names of its
scope and not a pass over all that is known. With a catalog, the columns of the tables that a definition names are joined to it
first, as one ordered list per table; bare columns and stars then follow them.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import rules
from tracewell.functions import text as T
from tracewell.operators import facts
from tracewell.sources.storage import written

SOURCE = "struct<table_name:string,column_name:string>"
ENTRY = (
    f"struct<scope:string,column_name:string,ordinal:int,kind:string,expr_type:string,"
    f"derived:boolean,depth:int,sources:array<{SOURCE}>>"
)
#: The resolved columns of a scope, and their names, as written and in lower case.
SYMBOLS = f"struct<scope:string,exact:array<string>,lower:array<string>,rows:array<{ENTRY}>>"
CATALOG = "map<string,array<string>>"


def _array(schema: str) -> Column:
    return F.expr(f"CAST(array() AS array<{schema}>)")


def _same(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def tables_of(scope: Column) -> Column:
    """Tables of all selects of a scope, those of the one that names the columns first."""
    return F.concat(scope["tables"], F.flatten(F.transform(scope["branches"], lambda b: b["tables"])))


def scope_facts(ddl: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Definitions with tables, items and references of all scopes, and the ``catalog`` columns of their tables.

    ``catalog`` has (table_name, ordinal, column_name). It is joined once per definition and table it names: by the
    whole name, else by its last part.
    """
    df = facts.with_object_columns(facts.with_refs(facts.scoped(ddl))).withColumn(
        "all_tables", F.flatten(F.transform("scopes", tables_of)))
    if catalog is None:
        return df.withColumn("catalog", F.lit(None).cast(CATALOG))
    df = written(df.withColumn("_row", F.monotonically_increasing_id()), "scopes")
    columns = catalog.groupBy(F.upper("table_name").alias("known")).agg(
        F.transform(F.array_sort(F.collect_set(F.struct("ordinal", "column_name"))), lambda c: c["column_name"]).alias("columns"))
    base = F.transform(F.filter("all_tables", lambda t: t["key"].isNull() & t["args"].isNull()), lambda t: F.upper(t["table_name"]))
    wanted = df.select("_row", F.explode(F.array_distinct(base)).alias("name")).select(
        "_row", "name", F.explode(F.array_distinct(F.array("name", F.substring_index("name", ".", -1)))).alias("known"))
    found = wanted.join(columns, "known").groupBy("_row", "name").agg(F.max_by("columns", F.length("known")).alias("columns"))
    maps = found.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("name", "columns"))).alias("catalog"))
    return df.join(maps, "_row", "left").drop("_row")


def entry_of(symbols: Column, column: Column) -> Column:
    """The first resolved column with that name as written, else in any case; null if there is none."""
    place = lambda names, name: F.array_position(names, name).cast("int")
    return F.get(symbols["rows"], F.coalesce(
        F.nullif(place(symbols["exact"], column), F.lit(0)), place(symbols["lower"], F.lower(column))) - 1)


def symbols_of(known: Column, key: Column) -> Column:
    return _first(F.filter(known, lambda k: k["scope"] == key))


def catalog_of(table: Column) -> Column:
    """The catalog's columns of a table reference, null where it has none."""
    return F.when(table["key"].isNull() & table["args"].isNull(), F.try_element_at(F.col("catalog"), F.upper(table["table_name"])))


TABLE = "struct<ordinal:int,clause:string,table_name:string,alias:string,child:int,args:array<struct<qualifier:string,column_name:string>>,key:string>"
#: Columns of a table function over a semi-structured value.
FUNCTION_COLUMNS = ["value", "key", "index", "seq", "path", "this"]


def _table(name: Column) -> Column:
    """A table reference that stands for the catalog table ``name``."""
    return F.struct(F.lit(0).alias("ordinal"), F.lit("from").alias("clause"), name.alias("table_name"), F.lower(name).alias("alias"),
                    F.lit(None).alias("child"), F.lit(None).alias("args"), F.lit(None).alias("key")).cast(TABLE)


def qualified(scope: Column, all_tables: Column, qualifier: Column) -> Column:
    """Table reference behind a qualifier: the scope's own FROM and JOIN first, then any scope, else the qualifier."""
    match = lambda tables: _first(F.filter(tables, lambda t: t["alias"] == F.lower(qualifier)))
    return F.coalesce(match(scope["tables"]), match(all_tables), _table(qualifier))


def qualified_table(scope: Column, all_tables: Column, qualifier: Column) -> Column:
    return qualified(scope, all_tables, qualifier)["table_name"]


def bare(known: Column, scope: Column, column: Column) -> Column:
    """Table reference of an unqualified column: a subquery or table in FROM that has it, else the last JOIN back to FROM."""
    owns = lambda t: entry_of(symbols_of(known, t["key"]), column).isNotNull() | F.exists(catalog_of(t), lambda c: _same(c, column))
    return F.when(F.size(scope["tables"]) == 1, _first(scope["tables"])).otherwise(T.let(F.reverse(scope["tables"]), lambda tables: F.coalesce(
        _first(F.filter(tables, owns)),
        _first(F.filter(tables, lambda t: t["args"].isNotNull() & F.lower(column).isin(FUNCTION_COLUMNS))),
        _first(F.filter(tables, lambda t: t["key"].isNull() & t["args"].isNull() & catalog_of(t).isNull())),
        _first(F.filter(tables, lambda t: t["key"].isNull() & t["args"].isNull())),
        _first(tables),
    )))


def _hit(sources: Column, expr_type: Column, derived: Column, depth: Column) -> Column:
    return F.struct(sources.alias("sources"), expr_type.alias("expr_type"), derived.alias("derived"), depth.alias("depth"))


def look_up(known: Column, table: Column, column: Column) -> Column:
    """Sources of a column of a table reference: those of the subquery column, of its wildcard, or the base column itself."""
    base = _hit(F.array(F.struct(table["table_name"].alias("table_name"), column.alias("column_name"))), F.lit(""), F.lit(False), F.lit(0))
    nothing = _hit(_array(SOURCE), F.lit(""), F.lit(False), F.lit(0))
    through = lambda symbols: F.coalesce(
        T.let(entry_of(symbols, column), lambda e: F.when(e.isNotNull(), _hit(e["sources"], e["expr_type"], e["derived"], e["depth"]))),
        T.let(entry_of(symbols, F.lit("*")), lambda e: F.when(e.isNotNull(), _hit(
            F.transform(e["sources"], lambda s: F.struct(s["table_name"].alias("table_name"), column.alias("column_name"))),
            e["expr_type"], e["derived"], e["depth"]))),
        nothing,
    )
    return F.when(table.isNull(), nothing).when(table["key"].isNotNull(), T.let(symbols_of(known, table["key"]), through)).otherwise(base)


def referenced(known: Column, scope: Column, all_tables: Column, ref: Column) -> Column:
    """Sources of one column reference; a column of a table function has those of the function's arguments."""
    table_of = lambda r: F.when(r["qualifier"] != "", qualified(scope, all_tables, r["qualifier"])).otherwise(bare(known, scope, r["column_name"]))
    plain = lambda t, r: look_up(known, t, r["column_name"])
    called = lambda t: T.let(F.transform(t["args"], lambda a: T.let(table_of(a), lambda u: F.when(
        u["args"].isNull(), plain(u, a)))), lambda h: _hit(
            F.array_distinct(F.flatten(F.transform(F.filter(h, lambda x: x.isNotNull()), lambda x: x["sources"]))), F.lit(""), F.lit(True),
            F.coalesce(F.array_max(F.transform(h, lambda x: x["depth"])), F.lit(0))))
    return T.let(table_of(ref), lambda t: F.when(t["args"].isNotNull(), called(t)).otherwise(plain(t, ref)))


def _entry(scope: Column, name: Column, ordinal: Column, kind: Column, expr_type: Column, derived: Column,
           depth: Column, sources: Column) -> Column:
    return F.struct(
        scope["name"].alias("scope"), name.alias("column_name"), ordinal.cast("int").alias("ordinal"), kind.alias("kind"),
        expr_type.alias("expr_type"), derived.alias("derived"), depth.cast("int").alias("depth"), sources.alias("sources"),
    )


def item_entries(known: Column, scope: Column, all_tables: Column, item: Column) -> Column:
    """Resolved columns of one select item; a star over a subquery copies the subquery's columns."""
    targets = F.filter(scope["tables"], lambda t: t["args"].isNull() & ((item["star_qualifier"] == "") | (t["alias"] == item["star_qualifier"])))
    from_catalog = lambda t, columns: F.transform(columns, lambda c: _entry(
        scope, c, F.lit(None), F.lit("star"), F.lit(""), F.lit(False), F.lit(1), F.array(F.struct(t["table_name"].alias("table_name"), c.alias("column_name")))))
    star = F.flatten(F.transform(targets, lambda t: F.when(
        t["key"].isNotNull(),
        F.transform(F.coalesce(symbols_of(known, t["key"])["rows"], _array(ENTRY)), lambda e: _entry(
            scope, e["column_name"], F.lit(None), F.lit("star"), e["expr_type"], e["derived"], e["depth"] + 1, e["sources"])),
    ).otherwise(T.let(catalog_of(t), lambda columns: F.when(columns.isNotNull(), from_catalog(t, columns)).otherwise(F.array(_entry(
        scope, F.lit("*"), item["ordinal"], F.lit("star"), F.lit(""), F.lit(False), F.lit(1),
        F.array(F.struct(t["table_name"].alias("table_name"), F.lit("*").alias("column_name"))),
    )))))))
    below = F.transform(item["below"], lambda k: T.let(F.coalesce(symbols_of(known, k)["rows"], _array(ENTRY)), lambda rows: _hit(
        F.flatten(F.transform(rows, lambda e: e["sources"])), F.lit(""), F.lit(True), F.coalesce(F.array_max(F.transform(rows, lambda e: e["depth"])), F.lit(0)))))
    hits = F.concat(F.transform(item["refs"], lambda r: referenced(known, scope, all_tables, r)), below)
    one = T.let(hits, lambda h: F.array(_entry(
        scope, item["out_name"], item["ordinal"], item["kind"],
        F.when(item["kind"] == "derived", item["expr_type"]).otherwise(F.coalesce(_first(h)["expr_type"], F.lit(""))),
        (item["kind"] == "derived") | F.exists(h, lambda x: x["derived"]),
        F.coalesce(F.array_max(F.transform(h, lambda x: x["depth"])), F.lit(0)) + 1,
        F.array_distinct(F.flatten(F.transform(h, lambda x: x["sources"]))),
    )))
    return F.when(item["kind"] == "star", star).otherwise(one)


def with_branch(entry: Column, more: Column) -> Column:
    """A resolved column with the sources that another select of its set operation gives it.

    Columns meet by position; a star of the other select gives the column of the same name. A
    subquery that a select reads under its own name is recursion and adds nothing.
    """
    searched = F.filter(more, lambda m: F.when(m["column_name"] == "*", m["ordinal"] <= F.coalesce(entry["ordinal"], m["ordinal"])).when(
        entry["ordinal"].isNull() | m["ordinal"].isNull(), _same(m["column_name"], entry["column_name"])).otherwise(m["ordinal"] == entry["ordinal"]))
    placed = F.get(more, entry["ordinal"] - 1)
    hits = F.when(placed["ordinal"] == entry["ordinal"], F.array(placed)).otherwise(searched)
    named = lambda m: F.transform(m["sources"], lambda x: F.struct(
        x["table_name"].alias("table_name"), F.when(x["column_name"] == "*", entry["column_name"]).otherwise(x["column_name"]).alias("column_name")))
    return T.let(hits, lambda found: entry.withField("sources", F.array_distinct(F.concat(entry["sources"], F.filter(
        F.flatten(F.transform(found, named)), lambda x: (entry["scope"] == "") | (F.lower(x["table_name"]) != entry["scope"])))))
        .withField("derived", entry["derived"] | F.exists(found, lambda m: m["derived"]))
        .withField("depth", F.greatest(entry["depth"], F.array_max(F.transform(found, lambda m: m["depth"]))))
        .withField("expr_type", F.when(entry["expr_type"] != "", entry["expr_type"]).otherwise(
            F.coalesce(_first(F.filter(F.transform(found, lambda m: m["expr_type"]), lambda x: x != "")), F.lit("")))))


@cache
def known_column() -> Column:
    forward = F.exists("scopes", lambda s: F.exists(tables_of(s), lambda t: t["key"].isNotNull() & F.exists(
        F.col("scopes"), lambda u: (u["name"] == t["key"]) & (u["ordinal"] > s["ordinal"]))))
    def entries(known: Column, scope: Column, items: Column) -> Column:
        """Resolved columns of one select, numbered unless a star is left whose columns are not known."""
        found = F.flatten(F.transform(items, lambda i: item_entries(known, scope, F.col("all_tables"), i)))
        # Without stars the items have their numbers already.
        return T.let(found, lambda rows: F.when(~F.exists(items, lambda i: i["kind"] == "star") | F.exists(rows, lambda e: e["column_name"] == "*"), rows).otherwise(
            F.transform(rows, lambda e, i: e.withField("ordinal", (i + 1).cast("int")))))

    def step(known: Column, s: Column) -> Column:
        select = lambda b: F.struct(s["name"].alias("name"), b["tables"].alias("tables"), b["items"].alias("items"))
        selects = F.concat(F.array(select(s)), F.transform(s["branches"], select))
        own = F.reduce(selects, F.lit(None).cast(f"array<{ENTRY}>"), lambda sofar, b: T.let(
            entries(known, b, b["items"]),
            lambda more: F.when(sofar.isNull(), more).otherwise(F.transform(sofar, lambda e: with_branch(e, more)))))
        symbols = lambda rows: F.array(F.struct(
            s["name"].alias("scope"), F.transform(rows, lambda e: e["column_name"]).alias("exact"),
            F.transform(rows, lambda e: F.lower(e["column_name"])).alias("lower"), rows.alias("rows")).cast(SYMBOLS))
        return F.concat(F.filter(known, lambda k: k["scope"] != s["name"]), T.let(own, symbols))

    repeated = F.flatten(F.array_repeat(F.col("scopes"), F.size("scopes")))
    return F.reduce(F.when(forward, repeated).otherwise(F.col("scopes")), _array(SYMBOLS), step)


def resolved(ddl: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Adds ``known``: by scope, every output column with its base sources; and ``main``, that of the main select.

    One pass over the scopes in order is enough for legal SQL. Where a subquery reads a
    later one, the pass is repeated once per scope; a cycle ends without sources. Without a declared list, the
    object's columns are those of the main select, stars of known columns included; a star of unknown ones is ``*``.
    """
    df = scope_facts(ddl, catalog).withColumn("known", known_column()).withColumn("main", symbols_of(F.col("known"), F.lit("")))
    listed = F.size("listed") > 0
    own = F.filter(F.transform("main.rows", lambda e: e["column_name"]), lambda n: n.isNotNull())
    return df.withColumn("object_columns", F.array_distinct(F.when(
        F.col("has_query") & F.col("is_supported") & ~listed & ~F.col("uses_identifier"), F.coalesce(own, F.array().cast("array<string>"))).otherwise(F.col("object_columns"))))


def _column_entry(position: Column, column: Column) -> Column:
    """Resolved entry of one object column and how it was found."""
    main = F.col("main")
    tag = lambda e, method, sources=None: F.when(e.isNotNull(), F.struct(
        F.lit(method).alias("method"), (e["sources"] if sources is None else sources).alias("sources"),
        e["expr_type"].alias("expr_type"), e["derived"].alias("derived"), e["depth"].alias("depth")))
    usable = lambda e: (F.size(e["sources"]) > 0) | e["derived"]
    own = lambda e: F.transform(e["sources"], lambda s: F.struct(s["table_name"].alias("table_name"), column.alias("column_name")))
    base = _first(F.filter("all_tables", lambda t: t["key"].isNull() & t["args"].isNull()))
    placed = F.get(main["rows"], position)
    in_place = (F.size(main["rows"]) == F.size("object_columns")) & (placed["ordinal"] == position + 1) & (placed["column_name"] != "*") & usable(placed)
    anywhere = F.filter(F.transform("known", lambda k: entry_of(k, column)), lambda e: e.isNotNull() & usable(e))
    searched = lambda same: F.coalesce(
        F.when(column == "*", tag(same, "star")),
        F.when(usable(same), tag(same, "select")),
        F.when(in_place, tag(placed, "position")),
        T.let(entry_of(main, F.lit("*")), lambda e: tag(e, "wildcard", own(e))),
        T.let(_first(anywhere), lambda e: tag(e, "any_subquery")),
        F.when(base.isNotNull() & same.isNull(), F.struct(
            F.lit("first_table").alias("method"),
            F.array(F.struct(base["table_name"].alias("table_name"), column.alias("column_name"))).alias("sources"),
            F.lit("").alias("expr_type"), F.lit(False).alias("derived"), F.lit(0).alias("depth"))),
        F.struct(F.lit("unknown").alias("method"), _array(SOURCE).alias("sources"), F.lit("").alias("expr_type"),
                 F.lit(False).alias("derived"), F.lit(0).alias("depth")),
    )
    return T.let(entry_of(main, column), searched)


@cache
def column_rows() -> Column:
    return F.transform("object_columns", lambda c, i: F.struct(
        (i + 1).cast("int").alias("ordinal"), c.alias("view_column"), _column_entry(i, c).alias("hit")))


def column_sources(ddl: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """One row per (object, output column): method, sources, expression type and depth."""
    df = resolved(ddl, catalog)
    out = df.withColumn("row", F.explode(F.when(~F.col("uses_identifier"), column_rows())))
    return out.select(
        *[c for c in ddl.columns if c != "ddl_text"], "object_name", "row.ordinal", "row.view_column", "row.hit.method",
        "row.hit.sources", "row.hit.expr_type", "row.hit.derived", "row.hit.depth",
    )


# --- result columns ------------------------------------------------------------------


def contributing(sources: Column, field: str) -> Column:
    """Distinct sorted names joined by '; ', upper-cased."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.upper(s[field])))), "; ")


def promoted(n_tables: Column, n_columns: Column, expr_type: Column) -> Column:
    """True when a direct column must be reported as derived."""
    return (n_tables > 1) | (n_columns > 1) | expr_type.isin(rules.DERIVED_EXPRESSION_TYPES)


def clean_name(name: Column) -> Column:
    """Canonical table name: text before ' AS ', without a leading 'CTE_', upper-cased."""
    return F.upper(F.regexp_replace(F.get(F.split(name, " AS "), F.lit(0)), "^CTE_", ""))


def lineage_fields(df: DataFrame) -> list[Column]:
    """The six report columns of resolved sources."""
    count = lambda f: F.size(F.array_distinct(F.transform("sources", lambda s: F.upper(s[f]))))
    unknown = F.col("method") == "unknown"
    # A star whose columns are not known: its tables are told, its type is not.
    star = F.col("method") == "star"
    derived = F.col("derived") | promoted(count("table_name"), count("column_name"), F.col("expr_type"))
    none = F.size("sources") == 0
    return [
        F.upper("object_name").alias("view_name"),
        F.upper("view_column").alias("view_column"),
        F.when(unknown | star, "UNKNOWN").when(derived, "DERIVED").otherwise("DIRECT").alias("column_type"),
        F.when(unknown, "UNKNOWN").when(none, "CALCULATED").otherwise(contributing(F.col("sources"), "table_name")).alias("source_table"),
        F.when(unknown, "UNKNOWN").when(none, F.upper("expr_type"))
        .otherwise(contributing(F.col("sources"), "column_name")).alias("source_column"),
        F.when(derived & ~unknown & ~star, F.upper("expr_type")).otherwise("").alias("expression_type"),
    ]


# --- operators -----------------------------------------------------------------------


def _scopes(df: DataFrame) -> DataFrame:
    return df.withColumn("scope", F.explode(T.elements("scopes")))


def alias_resolve(ddl: DataFrame) -> DataFrame:
    """Table behind every qualifier used in a scope."""
    rows = _scopes(scope_facts(ddl)).withColumn("item", F.explode("scope.items")).withColumn("r", F.explode("item.refs"))
    rows = rows.where("r.qualifier <> ''")
    return rows.select(
        "object_id", F.col("scope.name").alias("scope_name"), F.lower("r.qualifier").alias("qualifier"),
        qualified_table(F.col("scope"), F.col("all_tables"), F.col("r.qualifier")).alias("table_name"),
    ).distinct()


def unqualified_resolve(ddl: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Table of every bare column of the main select.

    Candidates are ranked last JOIN first, FROM last. With a catalog, a candidate that owns
    the column beats one that does not; the rank only breaks ties.
    """
    bare_columns = T.let(F.element_at(F.col("scopes"), -1), lambda m: F.flatten(F.transform(m["items"], lambda i: F.transform(
        F.filter(i["refs"], lambda r: r["qualifier"] == ""),
        lambda r: F.struct(r["column_name"].alias("column_name"), F.reverse(m["tables"]).alias("tables"))))))
    rows = scope_facts(ddl).select("object_id", F.explode(bare_columns).alias("b")).select(
        "object_id", "b.column_name", F.posexplode("b.tables").alias("rank", "t"))
    ranked = rows.select("object_id", "column_name", "rank", F.col("t.table_name").alias("table_name"))
    if catalog is None:
        ranked = ranked.withColumn("owned", F.lit(False))
    else:
        owners = catalog.select(F.upper("table_name").alias("_t"), F.upper("column_name").alias("_c")).distinct()
        ranked = ranked.join(
            owners, (F.upper("table_name") == F.col("_t")) & (F.upper("column_name") == F.col("_c")), "left"
        ).withColumn("owned", F.col("_t").isNotNull())
    return ranked.groupBy("object_id", "column_name").agg(
        F.min_by("table_name", F.struct(~F.col("owned"), "rank")).alias("table_name"))


def wildcard_expand(ddl: DataFrame) -> DataFrame:
    """Declared columns that only a star supplies, with the star's source."""
    return column_sources(ddl).where("method = 'wildcard'").select(
        "object_id", "ordinal", "view_column", contributing(F.col("sources"), "table_name").alias("source_table"))


def star_columns(ddl: DataFrame, catalog: DataFrame) -> DataFrame:
    """Columns of ``SELECT *`` and ``t.*`` items of the main select over catalog tables."""
    main = F.element_at(F.col("scopes"), -1)
    stars = scope_facts(ddl).select("object_id", main.alias("m")).select(
        "object_id", "m.tables", F.explode("m.items").alias("i")).where("i.kind = 'star'")
    wanted = stars.select("object_id", F.explode(F.filter(
        "tables", lambda t: (F.col("i.star_qualifier") == "") | (t["alias"] == F.col("i.star_qualifier")))).alias("t"))
    return wanted.select("object_id", F.upper("t.table_name").alias("table_name")).join(
        catalog, "table_name").select("object_id", "table_name", "column_name", "ordinal")


def cte_dependencies(df: DataFrame) -> DataFrame:
    """Adds ``deps``: for every named subquery the other ones its text names as a word."""
    return df.withColumn("deps", F.transform("ctes", lambda c, i: F.struct(
        (i + 1).cast("int").alias("ordinal"), c["name"].alias("name"),
        F.filter(F.transform("ctes", lambda o: o["name"]), lambda n: (n != c["name"]) & F.array_contains(
            F.regexp_extract_all(F.lower(c["body"]), F.lit(rf"({T.WORD.lower()})"), F.lit(1)), n)).alias("needs"))))


def cte_dependency_order(ddl: DataFrame) -> DataFrame:
    """Layer of every named subquery; members of a cycle come last."""
    df = cte_dependencies(facts.scoped(ddl))
    layer = "array<struct<name:string,level:int>>"
    names = lambda acc: F.transform(acc, lambda e: e["name"])
    step = lambda acc, _: T.let(names(acc), lambda done: F.concat(acc, F.transform(
        F.filter("deps", lambda d: ~F.array_contains(done, d["name"]) & F.forall(d["needs"], lambda n: F.array_contains(done, n))),
        lambda d: F.struct(d["name"].alias("name"), (F.coalesce(F.array_max(F.transform(
            F.filter(acc, lambda e: F.array_contains(d["needs"], e["name"])), lambda e: e["level"])), F.lit(0)) + 1).alias("level")))))
    df = df.withColumn("layers", F.reduce(F.col("deps"), F.expr(f"CAST(array() AS {layer})"), step))
    top = F.coalesce(F.array_max(F.transform("layers", lambda e: e["level"])), F.lit(0))
    found = lambda n: _first(F.filter("layers", lambda e: e["name"] == n))["level"]
    return df.select("object_id", F.explode(F.transform("deps", lambda d: F.struct(
        d["name"].alias("cte_name"), F.coalesce(found(d["name"]), top + 1).cast("int").alias("level")))).alias("x")).select("object_id", "x.*")


def cte_column_details(ddl: DataFrame) -> DataFrame:
    """Per output column of each named subquery: direct, derived or unqualified, and its references."""
    rows = _scopes(scope_facts(ddl)).where("scope.kind <> 'main'").withColumn("i", F.explode("scope.items")).where("i.kind <> 'star'")
    unqualified = F.exists("i.refs", lambda r: r["qualifier"] == "")
    refs = F.array_sort(F.array_distinct(F.transform("i.refs", lambda r: F.concat_ws(
        ".", F.when(r["qualifier"] != "", qualified_table(F.col("scope"), F.col("all_tables"), r["qualifier"])), r["column_name"]))))
    return rows.select(
        "object_id", F.col("scope.name").alias("cte_name"), F.col("i.out_name").alias("column_name"),
        F.when(F.col("i.kind") == "derived", "derived").when(unqualified, "unqualified").otherwise("direct").alias("detail_type"),
        F.array_join(refs, ";").alias("refs"),
    )


def cte_dependent_lookup(ddl: DataFrame) -> DataFrame:
    """For every column of a subquery: the first subquery, in order, it depends on that has the same column."""
    df = cte_dependencies(scope_facts(ddl))
    cols = lambda name: F.transform(_first(F.filter("scopes", lambda s: s["name"] == name))["items"], lambda i: F.lower(i["out_name"]))
    rows = df.select("*", F.explode(T.elements("deps")).alias("d")).select(
        "*", F.explode(cols(F.col("d.name"))).alias("column_name"))
    return rows.select("object_id", F.col("d.name").alias("cte_name"), "column_name", _first(F.filter(
        "d.needs", lambda n: F.array_contains(cols(n), F.col("column_name")))).alias("found_in")).where("found_in is not null")


def cte_trace_base(ddl: DataFrame) -> DataFrame:
    """Closure of (subquery, column) to base tables; no subquery name is left."""
    return resolved(ddl).select("object_id", F.explode(F.filter(F.flatten(F.transform("known", lambda k: k["rows"])), lambda e: e["scope"] != "")).alias("e")).select(
        "object_id", F.col("e.scope").alias("cte_name"), F.col("e.column_name").alias("column_name"),
        F.col("e.depth").alias("depth"), F.inline("e.sources").alias("base_table", "base_column"),
    )


def cte_original_name(ddl: DataFrame) -> DataFrame:
    """Original column behind a renamed or aggregated subquery column: ``x AS y`` and ``agg(t.x) AS y``."""
    pattern = rf"(?i)^(?:{'|'.join(rules.NAME_KEEPING_AGGREGATES)})\s*\(\s*(?:DISTINCT )?({T.NAME})\s*\)$"
    rows = _scopes(scope_facts(ddl)).where("scope.kind <> 'main'").withColumn("i", F.explode("scope.items"))
    source = F.when(F.col("i.kind") == "column", F.col("i.expr")).otherwise(F.regexp_extract("i.expr", pattern, 1))
    return rows.select(
        "object_id", F.col("scope.name").alias("cte_name"), F.col("i.out_name").alias("column_name"),
        F.substring_index(source, ".", -1).alias("original_name")).where("original_name <> ''")


def cte_main(ddl: DataFrame) -> DataFrame:
    """The subquery that stands for the whole view: one that holds most of its columns, else the last."""
    wanted = F.transform("object_columns", F.lower)
    holds = lambda s: F.size(F.array_intersect(wanted, F.transform(s["items"], lambda i: F.lower(i["out_name"]))))
    subqueries = F.filter("scopes", lambda s: s["kind"] == "cte")
    majority = _first(F.filter(subqueries, lambda s: holds(s) * 2 > F.size(wanted)))["name"]
    found = F.struct(
        F.coalesce(majority, F.try_element_at(subqueries, F.lit(-1))["name"]).alias("main_cte"), majority.isNotNull().alias("by_majority"))
    return scope_facts(ddl).select("object_id", T.only_if(F.size("ctes") > 0, found).alias("m")).select("object_id", "m.*")


def lineage_direct(ddl: DataFrame) -> DataFrame:
    """Rows of columns that are one base column."""
    df = column_sources(ddl)
    return df.select("object_id", "depth", *lineage_fields(df)).where("column_type = 'DIRECT'")


def lineage_derived(ddl: DataFrame) -> DataFrame:
    """Rows of columns computed from base columns, 'CALCULATED' when there are none."""
    df = column_sources(ddl)
    return df.select("object_id", *lineage_fields(df)).where("column_type = 'DERIVED'")


def missing_recovery(ddl: DataFrame) -> DataFrame:
    """How each output column was found."""
    return column_sources(ddl).select("object_id", F.upper("view_column").alias("view_column"), "method")


def contributing_sources(ddl: DataFrame) -> DataFrame:
    """All base tables and columns behind each output column."""
    return column_sources(ddl).select(
        "object_id", F.upper("view_column").alias("view_column"),
        contributing(F.col("sources"), "table_name").alias("tables"), contributing(F.col("sources"), "column_name").alias("columns"))


def promote_derived(ddl: DataFrame) -> DataFrame:
    """Columns with more than one source or a computing root, whatever their select item was."""
    count = lambda f: F.size(F.array_distinct(F.transform("sources", lambda s: F.upper(s[f]))))
    return column_sources(ddl).select(
        "object_id", F.upper("view_column").alias("view_column"),
        promoted(count("table_name"), count("column_name"), F.col("expr_type")).alias("is_derived"))


def case_insensitive_match(wanted: DataFrame, keys: DataFrame, by: list[str], name: str, key: str) -> DataFrame:
    """Key that equals the wanted name, else the first one that equals it ignoring case."""
    left = wanted.select(*by, name).distinct().withColumn("_l", F.lower(name))
    right = keys.select(*by, key, F.lower(key).alias("_l")).distinct()
    return left.join(right, [*by, "_l"]).groupBy(*by, name).agg(
        F.min_by(key, F.struct(F.col(key) != F.col(name), F.col(key))).alias(key))


METHOD_RANK = {"a_derived": 1, "a_direct": 2, "b_direct": 3, "b_derived": 4, "unknown": 5}


def hybrid_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two analyses of the same columns: A derived, A direct, B direct, B derived, in that order.

    Both have (object_id, view_column, column_type, source_table, source_column). A row of unknown source comes after
    all others, so a column that neither side knows is kept as unknown, with rank 5.
    """
    def ranked(df: DataFrame, side: str) -> DataFrame:
        rank = F.when(F.col("source_table") == "UNKNOWN", METHOD_RANK["unknown"]).when(
            F.col("column_type") == "DERIVED", METHOD_RANK[f"{side}_derived"]).otherwise(METHOD_RANK[f"{side}_direct"])
        return df.select(
            "object_id", "view_column", F.struct(rank.alias("rank"), "source_table", "source_column", "column_type").alias("c"))

    both = ranked(a, "a").unionByName(ranked(b, "b"))
    best = both.groupBy("object_id", "view_column").agg(F.min("c").alias("c"))
    return best.select("object_id", "view_column", "c.column_type", "c.source_table", "c.source_column", "c.rank")


def candidate_score(candidates: DataFrame, known_prefixes: list[str] = ()) -> DataFrame:
    """Best candidate per column: 10 per qualified table, 5 per plain one, 1 per subquery name.

    Input: (object_id, view_column, candidate_no, table_name, is_subquery), one row per table.
    """
    prefixed = F.lit(False)
    for prefix in known_prefixes:
        prefixed = prefixed | F.upper("table_name").startswith(prefix)
    points = F.when(F.col("table_name").contains(".") | prefixed, 10).when(F.col("is_subquery"), 1).otherwise(5)
    scores = candidates.groupBy("object_id", "view_column", "candidate_no").agg(F.sum(points).cast("int").alias("score"))
    return scores.groupBy("object_id", "view_column").agg(
        F.max_by(F.struct("candidate_no", "score"), F.struct("score", -F.col("candidate_no"))).alias("b")
    ).select("object_id", "view_column", "b.candidate_no", "b.score")


# --- whole pipeline ------------------------------------------------------------------

REPORT = ["view_name", "view_column", "column_type", "source_table", "source_column", "expression_type"]


def error_rows(ddl: DataFrame) -> DataFrame:
    """One row per definition that is missing or cannot be analysed."""
    broken = facts.scoped(ddl)
    reason = failure(broken)
    rows = broken.select("object_id", F.upper("view_name").alias("view_name"), T.only_if(reason.isNotNull(), reason).alias("reason"))
    return rows.select("object_id", *_error_fields())


def _error_fields() -> list[Column]:
    return [
        F.col("view_name"), F.lit("ERROR").alias("view_column"), F.lit("ERROR").alias("column_type"),
        F.col("reason").alias("source_table"), F.col("reason").alias("source_column"), F.lit("ERROR").alias("expression_type"),
    ]


def failure(scopes: DataFrame) -> Column:
    """Why a definition has no lineage, or null: text missing, or outside the supported subset."""
    no_literal = F.col("uses_identifier") & (F.col("identifier_table") == "")
    return (
        F.when(F.col("ddl_text").isNull(), "DDL_NOT_FOUND")
        .when(~F.col("is_supported"), "ANALYSIS_ERROR")
        .when(no_literal, "ANALYSIS_ERROR")
    )


def lineage_all(ddl: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Six-column lineage of every definition, error rows included.

    Input: (object_id, view_name, ddl_text). A single map over the input, unless a ``catalog`` (table_name, ordinal,
    column_name) is given, which decides where bare columns belong and what stars stand for.
    """
    df = resolved(ddl.select("object_id", "view_name", "ddl_text"), catalog)
    df = df.withColumn("reason", failure(df))
    plain = F.transform(column_rows(), lambda r: F.struct(r["view_column"].alias("view_column"), r["hit"].alias("hit")))
    identified = F.transform("object_columns", lambda c: F.struct(c.alias("view_column"), F.struct(
        F.lit("identifier").alias("method"),
        F.array(F.struct(F.col("identifier_table").alias("table_name"), c.alias("column_name"))).alias("sources"),
        F.lit("").alias("expr_type"), F.lit(False).alias("derived"), F.lit(0).alias("depth")).alias("hit")))
    failed = F.array(F.struct(F.lit("ERROR").alias("view_column"), F.struct(
        F.lit("error").alias("method"), _array(SOURCE).alias("sources"), F.lit("").alias("expr_type"),
        F.lit(False).alias("derived"), F.lit(0).alias("depth")).alias("hit")))
    rows = df.select(
        "object_id", F.col("view_name").alias("requested"), "object_name", "reason",
        F.explode(F.when(F.col("reason").isNotNull(), failed).when(F.col("uses_identifier"), identified).otherwise(plain)).alias("row"),
    ).select("object_id", "requested", "object_name", "reason", "row.view_column", "row.hit.*")
    broken = F.col("reason").isNotNull()
    error = {"view_name": F.upper("requested"), "source_table": F.col("reason"), "source_column": F.col("reason")}
    return rows.select("object_id", *[
        F.when(broken, error.get(name, F.lit("ERROR"))).otherwise(column).alias(name) for name, column in zip(REPORT, lineage_fields(rows))
    ])


def processing_stats(ddl: DataFrame) -> DataFrame:
    """Counts of one run: discovered, processed, failed, with and without columns."""
    df = facts.with_object_columns(facts.with_items(facts.scoped(ddl)))
    failed = failure(df).isNotNull()
    columns = F.size("object_columns") > 0
    return df.agg(
        F.count(F.lit(1)).alias("total_discovered"),
        F.count_if(~failed).alias("successfully_processed"),
        F.count_if(failed).alias("failed"),
        F.count_if(~failed & columns).alias("views_with_columns"),
        F.count_if(~failed & ~columns).alias("views_with_zero_columns"),
    )
