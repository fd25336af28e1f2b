"""Catalog listings, definition look-up, source files and report files.

Catalog tables have (database_name, schema_name, view_name, created, ddl_text).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import rules
from tracewell.functions import text as T
from tracewell.functions.skew import spread_few
from tracewell.operators import facts


def catalog_databases(catalog: DataFrame) -> DataFrame:
    """Sorted database names."""
    return catalog.select("database_name").distinct().orderBy("database_name")


def catalog_schemas(catalog: DataFrame, database: str | None = None) -> DataFrame:
    """Sorted schema names, of one database when given."""
    rows = catalog.where(F.col("database_name") == database) if database else catalog
    return rows.select("schema_name").distinct().orderBy("schema_name")


def _in_place(catalog: DataFrame, database: str | None, schemas: list[str] | None) -> DataFrame:
    rows = catalog.where(F.col("database_name") == database) if database else catalog
    return rows.where(F.col("schema_name").isin(list(schemas))) if schemas else rows


def catalog_views_list(catalog: DataFrame, database: str | None = None, schema: str | None = None,
                       limit: int | None = None) -> DataFrame:
    """Views by name with their number of columns, all of them or one page."""
    rows = _in_place(catalog, database, [schema] if schema else None)
    order = ["database_name", "schema_name", "view_name", "object_id"]
    page = rows.orderBy(*order).limit(limit) if limit else rows
    counted = facts.with_object_columns(facts.with_items(facts.scoped(page)))
    return counted.select(
        "view_name", "schema_name", "database_name", F.size(F.array_distinct("object_columns")).alias("column_count"), "created")


def discover_views(catalog: DataFrame, database: str | None = None, schemas: list[str] | None = None,
                   include_system_views: bool = False, max_views: int | None = None,
                   system_pattern: str | None = None) -> DataFrame:
    """View names to analyse: system views left out, sorted, capped on request."""
    rows = _in_place(catalog, database, schemas)
    if system_pattern and not include_system_views:
        rows = rows.where(~F.col("view_name").like(system_pattern))
    names = rows.select("object_id", "schema_name", "view_name")
    return names.orderBy("view_name", "object_id").limit(max_views) if max_views else names.orderBy("view_name", "object_id")


def ddl_lookup(requests: DataFrame, catalog: DataFrame, preferred_schema: str) -> DataFrame:
    """Definition of each requested name.

    A name may be ``db.schema.view``, ``schema.view`` or bare, and must equal that form of a
    view's name. Of several views the preferred schema comes first, then the first schema by
    name. Each form is reduced to its best view before the join, so every request meets one
    row at most, however many schemas hold a view of that name.
    """
    forms = F.array("view_name", F.concat_ws(".", "schema_name", "view_name"), F.concat_ws(".", "database_name", "schema_name", "view_name"))
    place = ["schema_name", "database_name", "view_name"]
    best = catalog.select(F.explode(forms).alias("requested"), *place).groupBy("requested").agg(
        F.min(F.struct((F.col("schema_name") != preferred_schema).alias("other"), *place)).alias("b")
    ).select("requested", *[F.col("b")[c].alias(c) for c in place])
    wanted = requests.select("requested").distinct().join(best, "requested")
    texts = wanted.join(catalog.select(*place, "ddl_text"), place).select("requested", "schema_name", "database_name", "ddl_text")
    return requests.select("requested").join(texts, "requested", "left")


# --- source code ---------------------------------------------------------------------

SKIPPED_FOLDERS = [".venv", "__pycache__"]
SKIPPED_FILES = ["utils.ts", "vite-env.d.ts", "__init__.py"]


def kept_file(path: Column) -> Column:
    """True for program files outside environment folders and not on the skip list."""
    name = F.substring_index(path, "/", -1)
    skipped = F.lit(False)
    for folder in SKIPPED_FOLDERS:
        skipped = skipped | path.contains(folder)
    return ~skipped & ~name.isin(SKIPPED_FILES) & name.rlike(r"\.(?:py|ts|tsx)$")


def code_files_read(files: DataFrame) -> DataFrame:
    """(file_id, path, text) of the files worth reading."""
    return files.where(kept_file(F.col("path")))


def read_code(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all program files below a folder, one row per file."""
    files = (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{py,ts,tsx}").text(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    return spread_few(files.where(kept_file(F.col("path"))))


def code_lines(files: DataFrame) -> DataFrame:
    """(file_id, path, line_no, line), numbered from 1."""
    return files.select("file_id", "path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "file_id", "path", (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def scanned_lines(files: DataFrame) -> DataFrame:
    """``code_lines`` with ``code``: the line with blanks for brackets inside comments, strings and templates of the file."""
    rows = files.select("file_id", "path", F.split("text", "\n").alias("line"), F.split(T.mask_code(F.col("text")), "\n").alias("code"))
    zipped = F.arrays_zip("line", "code")
    return rows.select("file_id", "path", F.posexplode(zipped).alias("pos", "l")).select(
        "file_id", "path", (F.col("pos") + 1).cast("int").alias("line_no"), "l.line", "l.code")


# --- report files --------------------------------------------------------------------


def canonical_header(df: DataFrame) -> DataFrame:
    """Columns renamed to lower case with underscores; spellings of one name are merged by coalesce."""
    groups: dict[str, list[str]] = {}
    for name in df.columns:
        groups.setdefault("_".join(name.strip().lower().replace("_", " ").split()), []).append(name)
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    return df.select(*[F.coalesce(*[quoted(n) for n in names]).alias(key) for key, names in groups.items()])


#: Separators that a report may have, and how many of a file's first lines tell which.
SEPARATORS, TOLD_BY = [",", ";", "\t", "|"], 100


def file_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, separator, header) of every report file below ``path``, from its first lines.

    The separator that cuts most lines into as many cells as the header, more than one, wins; of equals the one with
    more cells. What stands in quotes does not count.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id")).where("start = 0")
    first = lines.groupBy("file").agg(F.min("id").alias("first"), F.min_by("value", "id").alias("header"))
    cells = lambda text, sep: F.size(F.split(F.regexp_replace(text, r'"(?:[^"]|"")*"', ""), "[" + sep + "]"))
    told = lines.join(first, "file").where((F.col("id") < F.col("first") + TOLD_BY) & (F.trim("value") != ""))
    same = [F.struct(
        (F.first(cells("header", sep)) > 1).alias("cuts"), F.count_if(cells("value", sep) == cells("header", sep)).alias("lines"),
        F.first(cells("header", sep)).alias("cells"), F.lit(-i).alias("order"), F.lit(sep).alias("separator")) for i, sep in enumerate(SEPARATORS)]
    return told.groupBy("file", "header").agg(F.greatest(*same).alias("best")).select("file", F.col("best.separator").alias("separator"), "header")


def report_read(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Report files with any header spelling; null-like cells are empty strings.

    Without a ``delimiter`` it is found for each file, and files of one layout are read together. One row per file
    comes to the driver, its name and header.
    """
    if delimiter:
        parts = [spark.read.option("header", True).option("sep", delimiter).csv(path)]
    else:
        layouts: dict[tuple[str, str], list[str]] = {}
        for row in file_layouts(spark, path).orderBy("file").collect():
            layouts.setdefault((row["separator"], row["header"]), []).append(row["file"])
        parts = [spark.read.option("header", True).option("sep", sep).csv(files) for (sep, _), files in layouts.items()]
    if not parts:
        return spark.createDataFrame([], "row_no string").drop("row_no")
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(canonical_header, parts))
    return df.select(*[null_like_to_empty(F.col(f"`{c}`")).alias(c) for c in df.columns])


def null_like_to_empty(value: Column) -> Column:
    trimmed = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.lower(trimmed).isin(rules.NULL_LIKE), "").otherwise(trimmed)


def repo_classify(repositories: DataFrame, frontend: list[str] | None = None, backend: list[str] | None = None) -> DataFrame:
    """Repository names sorted into frontend and backend; a name may be in both or neither.

    The rule lists are short constants, so the test is an expression, not a join.
    """
    patterns = {"frontend": frontend or rules.FRONTEND_REPOSITORY_PATTERNS, "backend": backend or rules.BACKEND_REPOSITORY_PATTERNS}
    kinds = F.filter(
        F.array(*[F.when(F.col("repository").rlike("(?i)^(?:" + "|".join(p) + ")"), kind) for kind, p in patterns.items()]),
        lambda k: k.isNotNull())
    return repositories.select("repository").distinct().select("repository", F.explode(kinds).alias("kind"))


def base_view_read(base: DataFrame) -> DataFrame:
    """The registry ordered by id, with the total."""
    return base.select("*", base.agg(F.count(F.lit(1)).alias("total")).scalar().alias("total")).orderBy("base_primary_id")
