"""Which function a call means: modules, imports under any name, and re-exports.

Input: program files (file_id, path, text) and their functions. A module path meets files by equality only: as a path
from the importing file's folder or one of the folders above it, the nearest first, else by the longest ending of
the path that any file has. All look-up sides have one row per key, so common file names cost no more than rare ones.
Names that a file only passes on are followed from file to file, one join per step, until a definition is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.skew import first_per_key, large
from tracewell.operators import code_scan as scan
from tracewell.sources.storage import written

FROM = r"(?m)^[ \t]*from[ \t]+(\.*)[ \t]*([\w.]*)[ \t]*\bimport\b[ \t]*(\([^)]*\)|[^\n(]+)"
IMPORT = r"(?m)^[ \t]*import[ \t]+([^\n(]+)"
BLOCK_STRING = r"\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''"
#: Steps from file to file that a passed-on name may take; a longer chain ends without a definition.
MOST_STEPS = 20


def code_of(text: Column) -> Column:
    """Text without block strings and comments, continued lines joined."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, BLOCK_STRING, "''"), r"#[^\n]*", ""), r"\\\r?\n", " ")


def imports(files: DataFrame) -> DataFrame:
    """(file_id, path, level, module, original, alias): one row per imported name.

    ``level`` counts the leading dots. ``original`` is ``*`` for all names of the module and null where the module itself is
    imported; ``alias`` is how the file calls it.
    """
    code = files.where(F.col("path").endswith(".py")).withColumn("code", code_of(F.col("text")))
    name = lambda part: F.regexp_extract(part, r"^\s*(\*|[\w.]+)", 1)
    alias = lambda part: F.coalesce(F.nullif(F.regexp_extract(part, r"\sas\s+(\w+)", 1), F.lit("")), name(part))
    found = F.arrays_zip(*[scan.all_matches(F.col("code"), FROM, i).alias(n) for i, n in ((1, "dots"), (2, "module"), (3, "names"))])
    named = code.select("file_id", "path", F.explode(found).alias("m")).select(
        "file_id", "path", F.length("m.dots").alias("level"), F.col("m.module").alias("module"), F.explode(F.split(F.translate("m.names", "()\r\n", "    "), ",")).alias("part"))
    whole = code.select("file_id", "path", F.explode(scan.all_matches(F.col("code"), IMPORT)).alias("names")).select(
        "file_id", "path", F.lit(0).alias("level"), F.explode(F.split("names", ",")).alias("part"))
    rows = named.select("file_id", "path", "level", "module", name(F.col("part")).alias("original"), alias(F.col("part")).alias("alias")).unionByName(
        whole.select("file_id", "path", "level", name(F.col("part")).alias("module"), F.lit(None).cast("string").alias("original"), alias(F.col("part")).alias("alias")))
    return rows.where("coalesce(original, module) <> ''").distinct()


def module_of(path: Column) -> Column:
    return F.regexp_replace(path, r"(?:(?:^|/)__init__)?\.py$", "")


def module_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The file behind each (path, level, module): ``target``, or null with ``n_targets`` files that it may be."""
    known = files.where(F.col("path").endswith(".py")).select("file_id", F.split(module_of(F.col("path")), "/").alias("parts"))
    exact = known.groupBy(F.array_join("parts", "/").alias("key")).agg(F.min("file_id").alias("target"))
    endings = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    ending = known.select("file_id", F.explode(endings(F.col("parts"))).alias("key")).groupBy("key").agg(
        F.min("file_id").alias("target"), F.count(F.lit(1)).alias("n_targets"))
    asked = wanted.select("path", "level", "module").distinct()
    own, parts = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), F.filter(F.split("module", r"\."), lambda p: p != "")
    above = F.when(F.col("level") > 0, F.array(F.slice(own, F.lit(1), F.greatest(F.lit(0), F.size(own) - F.col("level") + 1)))).otherwise(
        F.transform(F.sequence(F.size(own), F.lit(0), F.lit(-1)), lambda n: F.slice(own, F.lit(1), n)))
    keys = F.transform(above, lambda folder: F.array_join(F.concat(folder, parts), "/"))
    near = asked.select("*", F.posexplode(keys).alias("rank", "key")).join(large(exact), "key")
    near = first_per_key(near, ["path", "level", "module"], F.col("rank"), ["target"]).withColumn("n_targets", F.lit(1).cast("long"))
    far = asked.where("level = 0 AND module <> ''").join(large(near), ["path", "level", "module"], "left_anti").select("module").distinct()
    far = first_per_key(far.select("*", F.posexplode(endings(parts)).alias("rank", "key")).join(large(ending), "key"), ["module"], F.col("rank"), ["target", "n_targets"])
    far = asked.where("level = 0").join(large(near), ["path", "level", "module"], "left_anti").join(large(far), "module").select(
        "path", "level", "module", F.when(F.col("n_targets") == 1, F.col("target")).alias("target"), "n_targets")
    return near.unionByName(far)


def import_targets(files: DataFrame) -> DataFrame:
    """(file_id, alias, original, target, n_targets): imports with the file they lead to; null ``original``: the file itself.

    ``from package import name`` may mean a module of the package as well; then there are two rows.
    """
    named = imports(files)
    below = named.where("original IS NOT NULL AND original <> '*'").select(
        "file_id", "path", "level", F.concat_ws(".", F.nullif("module", F.lit("")), "original").alias("module"), F.lit(None).cast("string").alias("original"), "alias")
    # A module below the package counts where its path is met as a whole; endings say nothing about it.
    parts = lambda module: F.size(F.split(module, r"\."))
    rows = named.withColumn("sure", F.lit(False)).unionByName(below.withColumn("sure", F.lit(True)))
    found = module_files(rows, files)
    exact = files.select(F.col("file_id").alias("target"), module_of(F.col("path")).alias("end"))
    met = rows.join(large(found), ["path", "level", "module"]).join(large(exact), "target", "left")
    last = F.replace("module", F.lit("."), F.lit("/"))
    whole = F.concat(F.lit("/"), "end").endswith(F.concat(F.lit("/"), last)) | F.concat(F.lit("/"), last).endswith(F.concat(F.lit("/"), "end")) & (parts(F.col("module")) > 1)
    return met.where(~F.col("sure") | (F.col("target").isNotNull() & whole)).select("file_id", "alias", "original", "target", "n_targets").distinct()


def calls_of(fns: DataFrame) -> DataFrame:
    """(file_id, caller, owner, name): calls by name, and by name of an owner that may be a module."""
    code = F.regexp_replace(F.regexp_replace("body", scan.STRING, "''"), r"#[^\n]*", "")
    dotted = scan.match_pairs(code, r"(?<![\w.])((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*)\.(\w+)\s*\(")
    base = fns.select("file_id", scan.node_of(F.col("file_id"), F.col("qualified")).alias("caller"), "body")
    plain = base.select("file_id", "caller", F.lit("").alias("owner"), F.explode(scan.called_names(F.col("body"))).alias("name"))
    owned = base.select("file_id", "caller", F.explode(F.array_distinct(dotted)).alias("c")).select("file_id", "caller", F.col("c.a").alias("owner"), F.col("c.b").alias("name"))
    return plain.unionByName(owned).distinct()


def definitions(wanted: DataFrame, defs: DataFrame, passed_on: DataFrame) -> DataFrame:
    """The node that each (at, name) of ``wanted`` means: defined in the file ``at``, or imported by it from another.

    ``defs`` has (file_id, name, node), ``passed_on`` the import rows of all files. Several ways may lead to several nodes.
    """
    asked = wanted.select("at", "name").distinct()
    open_ = written(asked.select(F.col("at").alias("start"), F.col("name").alias("wanted"), "at", "name"), "import-steps")
    done, seen = None, open_
    named = passed_on.where("original IS NOT NULL AND target IS NOT NULL").select(
        F.col("file_id").alias("at"), "alias", F.col("original").alias("next_name"), F.col("target").alias("next_at"))
    for _ in range(MOST_STEPS):
        here = open_.join(large(defs.select(F.col("file_id").alias("at"), "name", "node")), ["at", "name"])
        done = here.select("start", "wanted", "node") if done is None else done.unionByName(here.select("start", "wanted", "node"))
        rest = open_.join(large(here.select("at", "name").distinct()), ["at", "name"], "left_anti")
        by_name = rest.join(large(named.where("alias <> '*'").withColumnRenamed("alias", "name")), ["at", "name"])
        by_star = rest.join(large(named.where("alias = '*'").drop("alias")), "at").withColumn("next_name", F.col("name"))
        moved = by_name.select("start", "wanted", "next_at", "next_name").unionByName(by_star.select("start", "wanted", "next_at", "next_name")).select(
            "start", "wanted", F.col("next_at").alias("at"), F.col("next_name").alias("name")).distinct()
        open_ = written(moved.join(large(seen), ["start", "wanted", "at", "name"], "left_anti"), "import-steps")
        if open_.isEmpty():
            break
        seen = seen.unionByName(open_)
    return done.select(F.col("start").alias("at"), F.col("wanted").alias("name"), "node").distinct()


def call_links(fns: DataFrame, files: DataFrame) -> DataFrame:
    """(caller, name, callee, how, n_candidates): every call that a function of the files may answer.

    A called name means the function of the same file (``own``), else what the file imports under that name
    (``imported``), else the only function of that name (``only``). If none of these settles it, the row says
    ``ambiguous``, with no callee and the number of functions that it may mean. Calls of an owner are taken where
    the owner is an imported module.
    """
    node = scan.node_of(F.col("file_id"), F.col("qualified"))
    nodes = fns.select("file_id", "name", "qualified", node.alias("node"))
    top = nodes.where("name = qualified").groupBy("file_id", "name").agg(F.min("node").alias("node"))
    calls = written(calls_of(fns), "calls")
    targets = written(import_targets(files), "imports")
    plain = calls.where("owner = ''")
    own = nodes.groupBy("file_id", "name").agg(F.min("node").alias("own"))
    by_name = nodes.groupBy("name").agg(F.min("node").alias("only"), F.count_distinct("node").alias("n_nodes"))
    through = calls.where("owner <> ''").join(large(targets.where("original IS NULL").select("file_id", F.col("alias").alias("owner"), "target")), ["file_id", "owner"])
    asked = plain.select(F.col("file_id").alias("at"), "name").unionByName(through.select(F.col("target").alias("at"), "name").where("at IS NOT NULL"))
    # A file's own definitions win, so only names that it does not define lead on.
    found = written(definitions(asked, top, targets), "import-definitions")
    one = found.groupBy("at", "name").agg(F.min("node").alias("imported"), F.count(F.lit(1)).alias("n_imported"))
    tried = plain.join(large(own), ["file_id", "name"], "left").join(large(one.withColumnRenamed("at", "file_id")), ["file_id", "name"], "left").join(large(by_name), "name", "left")
    sure = F.when(F.col("n_imported") == 1, F.col("imported"))
    only = F.when((F.col("n_nodes") == 1) & F.col("n_imported").isNull(), F.col("only"))
    links = tried.where("n_nodes IS NOT NULL OR n_imported IS NOT NULL").select(
        "caller", "name", F.coalesce("own", sure, only).alias("callee"),
        F.when(F.col("own").isNotNull(), "own").when(sure.isNotNull(), "imported").when(only.isNotNull(), "only").otherwise("ambiguous").alias("how"),
        F.when(F.coalesce("own", sure, only).isNotNull(), F.lit(1)).otherwise(F.coalesce("n_imported", "n_nodes")).cast("long").alias("n_candidates"))
    modules = through.join(large(one.withColumnRenamed("at", "target")), ["target", "name"]).groupBy("caller", "owner", "name").agg(
        F.min("imported").alias("callee"), F.count_distinct("imported").alias("n"), F.max("n_imported").alias("m"))
    settled = (F.col("n") == 1) & (F.col("m") == 1)
    owned = modules.select("caller", F.concat_ws(".", "owner", "name").alias("name"), F.when(settled, F.col("callee")).alias("callee"),
                           F.when(settled, "imported").otherwise("ambiguous").alias("how"), F.greatest("n", "m").alias("n_candidates"))
    return links.unionByName(owned).distinct()
