"""From user-interface calls to backend routes, tables and report rows."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import rules
from tracewell.functions import text as T
from tracewell.functions.skew import first_per_key, large
from tracewell.operators import code_scan as scan
from tracewell.operators.imports import call_links
from tracewell.sources.storage import checkpointed

# --- URLs ----------------------------------------------------------------------------


def snake(name: Column) -> Column:
    """camelCase as camel_case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def normalise_url(url: Column, app: rules.AppRules = rules.AppRules()) -> Column:
    """Template bases replaced, ``${a.b}`` as ``{b}``, ``${camelCase}`` as ``{camel_case}``, no query string."""
    based = reduce(lambda u, b: F.replace(u, F.lit("${" + b[0] + "}"), F.lit(b[1])), app.url_bases, url)
    dotted = F.regexp_replace(based, r"\$\{[\w.]+\.(\w+)\}", r"{$1}")
    variable = r"\$\{(\w+)\}"
    rebuilt = T.let(dotted, lambda u: F.array_join(F.zip_with(
        F.split(u, variable), scan.all_matches(u, variable),
        lambda text, name: F.concat(text, F.coalesce(F.concat(F.lit("{"), snake(name), F.lit("}")), F.lit("")))), ""))
    return F.trim(F.regexp_replace(rebuilt, r"\?.*$", ""))


def url_normalise(calls: DataFrame, app: rules.AppRules = rules.AppRules()) -> DataFrame:
    return calls.select("call_id", "method", normalise_url(F.col("url_raw"), app).alias("url"))


# --- user-interface calls ------------------------------------------------------------

HTTP_CALL = r"(?:client|tsClient)\.(get|post|put|patch|delete)\b"
INDEXED_CALL = r"(?:client|tsClient)\s*\[\s*[\"'](get|post|put|patch|delete)[\"']\s*\]"
# Fixed patterns: places a URL can stand on a line, in the order they are tried.
URL_PATTERNS = [
    "[`\"](\\$\\{[^}]+\\}[^`\"]*)[`\"]",
    "[`\"']([/\\w\\-{}$\\.]+[^`\"']*)[\"`']",
    "url\\s*[=:]\\s*[`\"']([^`\"']*)[\"`']",
    "endpoint\\s*[=:]\\s*[`\"']([^`\"']*)[\"`']",
    "[`\"'](\\/api\\/[^`\"']*)[\"`']",
    "path\\s*[=:]\\s*[`\"']([^`\"']*)[\"`']",
    "route\\s*[=:]\\s*[`\"']([^`\"']*)[\"`']",
]


def call_method(line: Column) -> Column:
    """HTTP method called on a line, or null."""
    plain, indexed = F.regexp_extract(line, HTTP_CALL, 1), F.regexp_extract(line, f"(?i){INDEXED_CALL}", 1)
    return F.nullif(F.upper(F.when(plain != "", plain).otherwise(indexed)), F.lit(""))


def http_calls(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, method) of every line that calls the HTTP client."""
    return lines.select("file_id", "line_no", call_method(F.col("line")).alias("method")).where("method is not null")


EXPORT = r"(?m)(?=^[^\n]*\bexport\s+(?:const\s+\w+\s*=|(?:async\s+)?function\s+\w+))"
EXPORT_NAME = r"^[^\n]*\bexport\s+(?:const|(?:async\s+)?function)\s+(\w+)"


def exported_functions(files: DataFrame) -> DataFrame:
    """(file_id, path, function_name, start_line, lines, code) of every exported function, cut at its end.

    The text is cut before each export; inside a piece one pass over the lines counts braces, those in strings, templates
    and comments apart: ``code`` has blanks in their place. Text before the first export, or after the end of a
    function, is a row without function name.
    """
    cut = files.where(F.col("path").rlike(r"\.tsx?$")).withColumn("pieces", F.split("text", EXPORT)).withColumn("whole", T.mask_code(F.col("text")))
    lengths = F.transform("pieces", lambda p: F.length(p))
    begins = F.transform(lengths, lambda _, i: F.reduce(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    breaks = F.transform("pieces", lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
    rows = cut.withColumn("breaks", breaks).withColumn("pieces", F.transform(
        "pieces", lambda p, i: F.struct(p.alias("text"), F.substring(F.col("whole"), F.get(begins, i) + 1, F.length(p)).alias("code"))))
    rows = rows.select("file_id", "path", "breaks", F.posexplode(T.elements("pieces")).alias("n", "p"))
    start = F.reduce(F.slice("breaks", F.lit(1), F.col("n")), F.lit(0), lambda a, x: a + x) + 1
    rows = rows.select(
        "file_id", "path", start.alias("start_line"),
        F.nullif(F.regexp_extract("p.text", EXPORT_NAME, 1), F.lit("")).alias("function_name"), F.split("p.text", "\n").alias("lines"), F.split("p.code", "\n").alias("code"))
    count = lambda line, c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    state = F.struct(F.lit(0).alias("line"), F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(None).cast("int").alias("end"))

    def step(a: Column, line: Column) -> Column:
        depth = a["depth"] + count(line, "{") - count(line, "}")
        opened, number = a["opened"] | line.contains("{"), a["line"] + 1
        return T.let(F.struct(number.alias("line"), depth.alias("depth"), opened.alias("opened")), lambda s: F.struct(
            s["line"].alias("line"), s["depth"].alias("depth"), s["opened"].alias("opened"),
            F.coalesce(a["end"], F.when(s["opened"] & (s["depth"] <= 0) & (F.trim(line) != ""), s["line"])).alias("end")))

    rows = rows.withColumn("end", F.reduce("code", state, step, lambda a: a["end"]))
    known = F.col("function_name").isNotNull()
    ended = known & F.col("end").isNotNull()
    part = lambda name, start, cut_: F.struct(name.alias("function_name"), start.cast("int").alias("start_line"), cut_("lines").alias("lines"), cut_("code").alias("code"))
    own = part(F.col("function_name"), F.col("start_line"), lambda c: F.when(ended, F.slice(c, F.lit(1), F.col("end"))).otherwise(F.col(c)))
    after = part(F.lit(None).cast("string"), F.col("start_line") + F.col("end"), lambda c: F.slice(c, F.col("end") + 1, F.size(c)))
    return rows.select("file_id", "path", F.inline(F.when(ended & (F.col("end") < F.size("lines")), F.array(own, after)).otherwise(F.array(own))))


def call_lines(code: Column, i: Column) -> Column:
    """Lines that the client call on line ``i`` spans: to the bracket that closes its arguments, or to the end."""
    rest = F.array_join(F.slice(code, i + 1, F.size(code)), "\n")
    begin = F.regexp_replace(rest, rf"(?s)^.*?(?:{HTTP_CALL}|{INDEXED_CALL})", "")
    skipped = F.length(rest) - F.length(begin)
    # Arguments start at the first round bracket behind the type parameters; pieces end where one closes.
    opened = F.regexp_extract(begin, r"(?s)^[^(]*\(", 0)
    typed = F.regexp_extract(begin, r"(?s)^\s*<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>\s*\(", 0)
    head = F.when(typed != "", typed).otherwise(opened)
    pieces = F.split(F.substring(begin, F.length(head) + 1, F.length(begin)), r"\)")
    walked = F.reduce(pieces, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size")), lambda s, p: F.when(s["depth"] <= 0, s).otherwise(F.struct(
        (s["depth"] + F.length(p) - F.length(F.replace(p, F.lit("("), F.lit(""))) - 1).alias("depth"), (s["size"] + F.length(p) + 1).alias("size"))))
    span = F.substring(rest, F.lit(1), skipped + F.length(head) + walked["size"])
    return F.when(head == "", 1).otherwise(F.length(span) - F.length(F.replace(span, F.lit("\n"), F.lit(""))) + 1)


def url_on_line(line: Column, app: rules.AppRules = rules.AppRules()) -> Column:
    """First acceptable URL of a line, normalised; null on comment and blank lines."""
    tried = F.array(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in URL_PATTERNS])
    shaped = lambda u: u.startswith("/") | u.contains("${") | u.contains("api") | reduce(lambda a, w: a | F.lower(u).contains(w), app.url_words, F.lit(False))
    good = F.filter(
        F.transform(F.filter(tried, lambda u: u.isNotNull() & shaped(u)), lambda u: normalise_url(u, app)), lambda u: F.length(u) > 3)
    skip = F.trim(line).startswith("//") | (F.trim(line) == "")
    return F.when(~skip, F.get(good, F.lit(0)))


VARIABLE_ON_CALL = r"(?:client|tsClient)\.\w+(?:<[^>]*>)?\s*\(\s*(\w+)"


def defined_url(lines: Column, code: Column, name: Column, app: rules.AppRules = rules.AppRules()) -> Column:
    """URL a variable holds after ``lines``: that of its latest definition whose block is still open, or assignment."""
    word = F.concat(F.lit("\\b"), name)
    quoted = "\\s*(?::\\s*\\w+\\s*)?=\\s*[`\"']([^`\"']*)[\"`']"
    count = lambda line, c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    deltas = F.transform(code, lambda line: count(line, "{") - count(line, "}"))
    # How far the depth falls below that of line i on the lines after it, where a fall means that its block has ended.
    fall = lambda i: F.reduce(F.slice(deltas, i + 2, F.size(deltas)), F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda s, d: F.struct(
        (s["now"] + d).alias("now"), F.least(s["least"], s["now"] + d).alias("least")))["least"]
    values = F.transform(lines, lambda line, i: F.struct(
        F.get(F.regexp_extract_all(line, F.concat(word, F.lit(quoted)), F.lit(1)), F.lit(0)).alias("url"),
        line.rlike(r"\b(?:const|let)\b").alias("declared"), i.alias("i")))
    seen = F.filter(values, lambda v: F.coalesce(v["url"], F.lit("")) != "")
    visible = F.filter(seen, lambda v: ~v["declared"] | (fall(v["i"]) >= 0))
    return F.try_element_at(F.filter(F.transform(visible, lambda v: normalise_url(v["url"], app)), lambda u: u != ""), F.lit(-1))


def client_calls(files: DataFrame) -> DataFrame:
    """The functions of ``files`` with one row per client call: ``c`` (i, line, method, variable) and the call's lines."""
    fns = exported_functions(files)
    calls = F.filter(
        F.transform("lines", lambda line, i: F.struct(i.alias("i"), line.alias("line"), call_method(line).alias("method"))),
        lambda c: c["method"].isNotNull())
    rows = fns.select("*", F.explode(calls).alias("c"))
    rows = rows.withColumn("own", F.slice("lines", F.col("c.i") + 1, call_lines(F.col("code"), F.col("c.i"))))
    on_call = F.regexp_extract("c.line", VARIABLE_ON_CALL, 1)
    after_call = F.get(F.filter(
        F.transform(F.slice("own", F.lit(2), F.size("own")), lambda line: F.regexp_extract(F.trim(line), r"^(?:[>\])}]*\(\s*)?([A-Za-z_$][\w$]*)\s*[,)]?;?$", 1)),
        lambda v: v != ""), F.lit(0))
    variable = F.when(on_call != "", on_call).otherwise(after_call)
    return rows.withColumn("variable", F.when(~variable.isin(rules.NON_URL_VARIABLES), variable))


def variable_url(app: rules.AppRules = rules.AppRules()) -> Column:
    before = lambda c: F.slice(c, F.lit(1), F.col("c.i"))
    return F.when(F.col("variable").isNotNull(), defined_url(before("lines"), before("code"), F.col("variable"), app))


def http_call_url(files: DataFrame, app: rules.AppRules = rules.AppRules()) -> DataFrame:
    """(file_id, path, function_name, method, url, line_no) of every call whose URL is found.

    The URL is searched on the lines that the call spans, to the bracket that closes it, then in the latest definition
    of the variable passed to it. All of it happens inside the function's own row.
    """
    rows = client_calls(files).where(~F.lower("c.line").contains("blob") & ~F.col("c.line").contains("responseType:"))
    stated = F.get(F.filter(F.transform("own", lambda line: url_on_line(line, app)), lambda u: u.isNotNull()), F.lit(0))
    return rows.select(
        "file_id", "path", F.coalesce("function_name", F.lit("unknown")).alias("function_name"), F.col("c.method").alias("method"),
        F.coalesce(stated, variable_url(app)).alias("url"), (F.col("start_line") + F.col("c.i")).cast("int").alias("line_no"),
    ).where("url is not null")


def http_call_url_var(files: DataFrame, app: rules.AppRules = rules.AppRules()) -> DataFrame:
    """Calls whose URL is held in a variable defined earlier in the function."""
    return client_calls(files).select("file_id", "function_name", "variable", variable_url(app).alias("url")).where("url is not null")


# --- backend routes ------------------------------------------------------------------


def route_prefix_of(path: Column, prefixes: rules.RouteRules) -> Column:
    """URL prefix of a router file from its folders and the first file rule that applies."""
    inner = F.regexp_replace(path, r"^.*?routers/", "")
    folder = F.concat(F.lit("/"), F.regexp_replace(inner, r"[^/]*$", ""))
    name = F.regexp_replace(F.substring_index(inner, "/", -1), r"\.py$", "")
    folders = [F.when(folder.contains(f"/{f}/"), f"/{f}").otherwise("") for f in prefixes.folders]
    file_rule = F.coalesce(*[F.when(name.contains(key), route) for key, route in prefixes.files], F.lit(""))
    whole = [F.when(name == key, prefix) for key, prefix in prefixes.exact]
    return F.coalesce(*whole, F.concat(F.lit(prefixes.root), *folders, file_rule))


def route_prefix(files: DataFrame, prefixes: rules.RouteRules = rules.RouteRules()) -> DataFrame:
    return files.where(F.col("path").contains("routers/")).select("file_id", "path", route_prefix_of(F.col("path"), prefixes).alias("prefix"))


ROUTE_HEAD = r"(?i)^@router\.(get|post|put|patch|delete)\s*\(\s*[\"']([^\"']*)[\"']"


def backend_routes(files: DataFrame, prefixes: rules.RouteRules = rules.RouteRules()) -> DataFrame:
    """(file_id, path, line_no, method, route_pattern, function_name, response_model) of router files.

    The text is cut before each decorator, so decorator, function line and body are one piece.
    """
    routers = files.where(F.col("path").contains("routers/")).withColumn("pieces", F.split("text", r"(?m)(?=^@router\.)"))
    breaks = F.transform("pieces", lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
    rows = routers.withColumn("breaks", breaks).select("file_id", "path", "breaks", F.posexplode(T.elements("pieces")).alias("n", "piece"))
    rows = rows.where(F.col("piece").rlike(ROUTE_HEAD))
    function = F.regexp_extract("piece", r"(?:^|\n)\s*(?:async\s+)?def\s+(\w+)", 1)
    return rows.select(
        "file_id", "path",
        (F.reduce(F.slice("breaks", F.lit(1), F.col("n")), F.lit(0), lambda a, x: a + x) + 1).cast("int").alias("line_no"),
        F.upper(F.regexp_extract("piece", ROUTE_HEAD, 1)).alias("method"),
        F.concat(route_prefix_of(F.col("path"), prefixes), F.regexp_extract("piece", ROUTE_HEAD, 2)).alias("route_pattern"),
        F.when(function != "", function).otherwise("unknown").alias("function_name"),
        response_model_of(F.col("piece")).alias("response_model"))


def response_model_of(piece: Column) -> Column:
    """Model named in the decorator, else the return annotation of the function."""
    decorator = F.regexp_extract(piece, r"(?s)^(.*?)\n\s*(?:async\s+)?def\s", 1)
    stated = F.regexp_extract(decorator, r"response_model\s*=\s*([\w\.\[\]]+)", 1)
    annotated = F.regexp_extract(piece, r"(?s)^.*?def\s[^:]*?(?:\([^)]*\))?\s*->\s*([\w\.\[\]]+):", 1)
    return F.when(stated != "", stated).otherwise(annotated)


def route_response_model(files: DataFrame) -> DataFrame:
    routes = backend_routes(files)
    return routes.select("file_id", "function_name", "response_model", scan.unwrapped_type(F.col("response_model")).alias("model"))


# --- call graph ----------------------------------------------------------------------


def call_closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, function_name, depth): functions reachable, within ``max_depth`` calls when given, each at its least depth.

    The frontier is joined with the edges once per round and what was seen before is taken
    out. Every round is checkpointed, so plans stay short and a lost executor replays one round.
    """
    edges = checkpointed(edges.select("caller", "callee"))
    frontier = checkpointed(roots.select(F.col("root"), F.col("root").alias("function_name"), F.lit(0).alias("depth")).distinct())
    seen = frontier
    for depth in count(1):
        if max_depth is not None and depth > max_depth:
            break
        reached = frontier.join(large(edges), F.col("function_name") == F.col("caller")).select("root", F.col("callee").alias("function_name")).distinct()
        frontier = checkpointed(
            reached.join(large(seen.select("root", "function_name")), ["root", "function_name"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def inherited(edges: DataFrame, facts: DataFrame, value: str) -> DataFrame:
    """(name, ``value``): what each function has itself or through anything it calls.

    Facts go up from callees to callers, the new ones of each round only, so a fact passes each edge once: the work is
    edges times distinct values, whatever the number of routes and however many functions call a common one. Cycles
    end as nothing new comes round.
    """
    edges = checkpointed(edges.select("caller", "callee").distinct())
    frontier = checkpointed(facts.select("name", value).distinct())
    seen = frontier
    while not frontier.isEmpty():
        risen = frontier.join(large(edges), F.col("name") == F.col("callee")).select(F.col("caller").alias("name"), value).distinct()
        frontier = checkpointed(risen.join(large(seen), ["name", value], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def route_tables(routes: DataFrame, edges: DataFrame, fn_tables: DataFrame) -> DataFrame:
    """(function_name, database_tables): tables of a route's function and everything it calls."""
    tables = inherited(edges, fn_tables, "table_name").join(large(routes.select(F.col("function_name").alias("name")).distinct()), "name", "left_semi")
    return tables.groupBy(F.col("name").alias("function_name")).agg(
        F.array_join(F.array_sort(F.collect_list("table_name")), ";").alias("database_tables"))


def route_procs(routes: DataFrame, edges: DataFrame, fn_procs: DataFrame) -> DataFrame:
    """(function_name, stored_procedures): procedures of a route's function and everything it calls."""
    own = fn_procs.select("name", F.upper("procedure").alias("procedure"))
    procs = inherited(edges, own, "procedure").join(large(routes.select(F.col("function_name").alias("name")).distinct()), "name", "left_semi")
    return _procs_text(procs, "name")


def near_procs(routes: DataFrame, edges: DataFrame, fn_procs: DataFrame) -> DataFrame:
    """(function_name, stored_procedures): procedures of a route's function and of the functions it calls, not of those behind them."""
    roots = routes.select(F.col("function_name").alias("root")).distinct()
    called = roots.join(large(edges), F.col("root") == F.col("caller")).select("root", F.col("callee").alias("name"))
    near = roots.select("root", F.col("root").alias("name")).unionByName(called)
    return _procs_text(near.join(large(fn_procs), "name").select("root", F.upper("procedure").alias("procedure")).distinct(), "root")


def _procs_text(procs: DataFrame, function: str) -> DataFrame:
    return procs.groupBy(F.col(function).alias("function_name")).agg(
        F.array_join(F.array_sort(F.collect_list("procedure")), ",").alias("stored_procedures"))


# --- matching ------------------------------------------------------------------------

MIN_SIMILARITY = 0.6
SUBSET_SEGMENTS = 10


def route_key(url: Column, app: rules.AppRules = rules.AppRules()) -> Column:
    """Comparable form of a URL: no API base, no outer slashes, every parameter as ``{}``."""
    bare = F.regexp_replace(F.replace(url, F.lit(app.root), F.lit("")) if app.root else url, "^/+|/+$", "")
    return F.regexp_replace(bare, r"(?<=^|/)\{[^/]*", "{}")


def route_match_exact(calls: DataFrame, routes: DataFrame, app: rules.AppRules = rules.AppRules()) -> DataFrame:
    """(call_id, route_id): the first route of the same method whose segments equal the call's."""
    first = routes.groupBy("method", route_key(F.col("route_pattern"), app).alias("key")).agg(F.min("route_id").alias("route_id"))
    return calls.select("call_id", "method", route_key(F.col("url"), app).alias("key")).join(large(first), ["method", "key"]).select("call_id", "route_id")


def needed_overlap(n_left: Column, n_right: Column) -> Column:
    """Fewest shared segments for a Jaccard score above the limit: o / (a + b - o) > 0.6."""
    # 10 o > 6 (a + b - o)  <=>  16 o > 6 (a + b), in whole numbers.
    return (F.floor((n_left + n_right) * 6 / 16) + 1).cast("int")


def route_match_fuzzy(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call_id, route_id, score): the most similar route above 0.6, the first one on ties.

    Two segment sets are that similar only if they share a subset of a size that follows from
    their own sizes. Both sides list their large subsets; routes keep only the first route per
    subset and size, which is combined before the shuffle. A call then finds at most one route
    per subset and size, however many routes share a common segment, so no pair list within a
    popular segment is ever built. The score of the largest shared subset is the exact score.
    URLs with more than ten distinct segments are joined on their rarest segments instead.
    """
    sets = lambda df, url: df.withColumn("parts", F.array_sort(F.array_distinct(F.split(url, "/"))))
    left = sets(calls, "url").groupBy("method", "parts").agg(F.min("call_id").alias("set_id"))
    right = sets(routes, "route_pattern").groupBy("method", "parts").agg(F.min("route_id").alias("route_id"))
    left, right = (df.withColumn("n", F.size("parts")) for df in (left, right))
    short = subset_matches(left.where(F.col("n") <= SUBSET_SEGMENTS), right)
    long = prefix_matches(left.where(F.col("n") > SUBSET_SEGMENTS), right)
    best = short.unionByName(long).groupBy("method", "set_id").agg(
        F.max(F.struct("score", (-F.col("route_id")).alias("order"))).alias("b"))
    winners = left.join(large(best), ["method", "set_id"]).select("method", "parts", (-F.col("b.order")).alias("route_id"), F.col("b.score").alias("score"))
    return sets(calls, "url").join(large(winners), ["method", "parts"]).select("call_id", "route_id", "score")


def subsets(parts: Column, n: Column, least: Column) -> Column:
    """All subsets with at least ``least`` members: array of (size, key)."""
    masks = F.filter(
        F.sequence(F.lit(1), F.pow(F.lit(2), n).cast("int") - 1), lambda m: F.bit_count(m).between(least, F.lit(SUBSET_SEGMENTS)))
    member = lambda m, i: F.floor(m / F.pow(F.lit(2), i)).cast("int") % 2 == 1
    return F.transform(masks, lambda m: F.struct(
        F.bit_count(m).alias("o"), F.array_join(F.filter(parts, lambda p, i: member(m, i)), "/").alias("key")))


def jaccard(o: Column, a: Column, b: Column) -> Column:
    return o / (a + b - o)


def subset_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    # Score > 0.6 needs more than 0.6 of either side's own segments; a longer route than 10 / 0.6 cannot match.
    least = (F.floor(F.col("n") * 6 / 10) + 1).cast("int")
    reachable = right.where(F.col("n") < SUBSET_SEGMENTS * 10 / 6)
    keys = lambda df: df.select("*", F.explode(subsets(F.col("parts"), F.col("n"), least)).alias("s"))
    first = keys(reachable).groupBy("method", F.col("s.key").alias("key"), F.col("s.o").alias("o"), F.col("n").alias("m")).agg(
        F.min("route_id").alias("route_id"))
    hits = keys(left).select("method", "set_id", "n", F.col("s.key").alias("key"), F.col("s.o").alias("o")).join(large(first), ["method", "key", "o"])
    return hits.where(F.col("o") >= needed_overlap(F.col("n"), F.col("m"))).select(
        "method", "set_id", "route_id", jaccard(F.col("o"), F.col("n"), F.col("m")).alias("score"))


def prefix_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Long URLs: candidates share one of their rarest segments at a position that still allows the score."""
    counts = right.select("method", F.explode("parts").alias("part")).groupBy("method", "part").agg(F.count(F.lit(1)).alias("uses"))

    def ranked(df: DataFrame, id_: str) -> DataFrame:
        words = df.select("method", id_, "n", F.explode("parts").alias("part")).join(large(counts), ["method", "part"], "left")
        return words.groupBy("method", id_, "n").agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "part"))).alias("words"))

    sizes = lambda n: F.sequence((F.floor(n * 6 / 10) + 1).cast("int"), F.ceil(n * 10 / 6).cast("int"))
    def keyed(df: DataFrame, mine: str, theirs: str) -> DataFrame:
        spread = df.select("*", F.explode(sizes(F.col("n"))).alias("other"))
        head = F.slice("words", F.lit(1), F.greatest(F.col("n") - needed_overlap(F.col("n"), F.col("other")) + 1, F.lit(0)))
        return spread.select("*", F.explode(F.transform(head, lambda w: w["part"])).alias("part")).withColumnsRenamed({"n": mine, "other": theirs})

    a = keyed(ranked(left, "set_id"), "n", "m").withColumnRenamed("words", "a")
    b = keyed(ranked(right.where(F.col("n") > SUBSET_SEGMENTS * 6 / 10), "route_id"), "m", "n").withColumnRenamed("words", "b")
    pairs = a.join(large(b), ["method", "part", "n", "m"])
    o = F.size(F.array_intersect(F.transform("a", lambda w: w["part"]), F.transform("b", lambda w: w["part"])))
    return pairs.withColumn("o", o).where(F.col("o") >= needed_overlap(F.col("n"), F.col("m"))).select(
        "method", "set_id", "route_id", jaccard(F.col("o"), F.col("n"), F.col("m")).alias("score"))


def mapping_build(calls: DataFrame, routes: DataFrame, app: rules.AppRules = rules.AppRules()) -> DataFrame:
    """(call_id, route_id, match_type): every call is kept; exact matches first, then similar ones."""
    exact = route_match_exact(calls, routes, app).withColumn("match_type", F.lit("exact"))
    rest = calls.join(large(exact.select("call_id")), "call_id", "left_anti")
    fuzzy = route_match_fuzzy(rest, routes).select("call_id", "route_id", F.lit("fuzzy").alias("match_type"))
    matched = exact.unionByName(fuzzy)
    return calls.select("call_id").join(large(matched), "call_id", "left").select(
        "call_id", "route_id", F.coalesce("match_type", F.lit("none")).alias("match_type"))


# --- report --------------------------------------------------------------------------


def table_column_details(tables: DataFrame, columns: DataFrame, missing: str = "unknown") -> DataFrame:
    """(id, table_column_details): ``T:[A,B]`` per table joined by ';'.

    ``tables`` has (id, database_tables) with names joined by ';'.
    """
    rows = tables.select("id", F.explode(F.split("database_tables", ";")).alias("table_name")).where("table_name <> ''")
    detail = F.format_string("%s:[%s]", F.col("table_name"), F.coalesce("columns", F.lit(missing)))
    return rows.join(large(scan.table_columns_text(columns)), "table_name", "left").groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_list(detail)), ";").alias("table_column_details"))


def relationship_type(matched: Column, tables: Column) -> Column:
    """Label of a mapping by its number of tables."""
    n = F.size(F.filter(F.split(F.coalesce(tables, F.lit("")), ";"), lambda t: t != ""))
    return F.when(~matched, "unmatched").when(n == 0, "no_tables").when(n == 1, "single_table").otherwise("multi_table_join")


def model_fields_text(fields: DataFrame) -> DataFrame:
    """(model, response_fields, nested_fields, column_count) of every response model."""
    text = lambda order, value: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v")))), lambda x: x["v"]), ",")
    simple = fields.where("is_simple").groupBy("model").agg(text(["ordinal"], "field").alias("response_fields"), F.count(F.lit(1)).alias("n_simple"))
    nested = scan.nested_fields(fields).groupBy("model").agg(
        text(["ordinal", "child_no"], "nested_field").alias("nested_fields"), F.count(F.lit(1)).alias("n_nested"))
    return simple.join(large(nested), "model", "full_outer").select(
        "model", F.coalesce("response_fields", F.lit("")).alias("response_fields"), F.coalesce("nested_fields", F.lit("")).alias("nested_fields"),
        (F.coalesce("n_simple", F.lit(0)) + F.coalesce("n_nested", F.lit(0))).alias("column_count"))


def response_column_count(files: DataFrame) -> DataFrame:
    """Plain and nested fields behind every route's response."""
    models = model_fields_text(scan.response_fields(files))
    return route_response_model(files).join(large(models), "model", "left").select(
        "function_name", "model", F.coalesce("column_count", F.lit(0)).alias("column_count"))


def backend_report(files: DataFrame, prefixes: rules.RouteRules = rules.RouteRules(), app: rules.AppRules = rules.AppRules(),
                   all_procs: bool = True) -> DataFrame:
    """Routes with tables, procedures, flow calls, response fields and table columns.

    Procedures are those of everything a route calls, or, without ``all_procs``, those ``near_procs`` finds.
    """
    # Functions, call edges and routes are read many times below; each is made once from the text.
    # A function is known by its file, class and name, so functions of one name keep apart.
    plain = checkpointed(scan.functions(files))
    fns = scan.with_nodes(plain)
    direct = checkpointed(call_links(plain, files).where("callee IS NOT NULL").select("caller", "callee").distinct())
    services = scan.service_resolve(
        plain.withColumn("node", scan.node_of(F.col("file_id"), F.col("qualified"))), scan.service_alias(files), "node").select(
        F.col("name").alias("caller"), F.col("target").alias("callee"))
    edges = checkpointed(direct.unionByName(services).distinct())
    routes = checkpointed(backend_routes(files, prefixes).withColumn("model", scan.unwrapped_type(F.col("response_model"))).withColumn(
        "node", scan.node_of(F.col("file_id"), F.col("function_name"))))
    roots = routes.select(F.col("node").alias("function_name")).distinct()
    tables = route_tables(roots, edges, scan.function_tables(fns, scan.model_table_map(files, app), app)).withColumnRenamed("function_name", "node")
    fn_procs = scan.function_procs(fns, edges, scan.service_proc_map(fns))
    procs = (route_procs(roots, edges, fn_procs) if all_procs else near_procs(roots, direct, fn_procs)).withColumnRenamed("function_name", "node")
    flows = scan.flow_calls(fns, files).groupBy(F.col("name").alias("node")).agg(
        F.array_join(F.array_sort(F.collect_set("flow_call")), ",").alias("flow_calls"))
    details = table_column_details(tables.withColumnRenamed("node", "id"), scan.orm_columns(files)).withColumnRenamed("id", "node")
    models = model_fields_text(scan.response_fields(files))
    joined = routes.join(large(tables), "node", "left").join(large(procs), "node", "left").join(large(flows), "node", "left") \
        .join(large(details), "node", "left").join(large(models), "model", "left")
    blank = ["database_tables", "stored_procedures", "flow_calls", "response_fields", "nested_fields", "table_column_details"]
    return joined.select(
        # File order, then line: the first route wins a match.
        (F.shiftleft(F.col("file_id"), 32) + F.col("line_no")).alias("route_id"), "method", "route_pattern",
        F.regexp_replace("path", r"^.*?routers/", "").alias("backend_file"), "function_name", "response_model",
        *[F.coalesce(c, F.lit("")).alias(c) for c in blank], F.coalesce("column_count", F.lit(0)).alias("column_count"))


def mapping_report(ui_files: DataFrame, backend_files: DataFrame, prefixes: rules.RouteRules = rules.RouteRules(),
                   app: rules.AppRules = rules.AppRules()) -> DataFrame:
    """The 14-column report: every user-interface call with what lies behind it."""
    calls = checkpointed(http_call_url(ui_files, app).withColumn("call_id", F.shiftleft(F.col("file_id"), 32) + F.col("line_no")))
    # The expected result of this report holds the procedures next to a route; ``backend_report`` by itself follows all calls.
    routes = checkpointed(backend_report(backend_files, prefixes, app, all_procs=False))
    mapped = calls.join(large(mapping_build(calls, routes, app).drop("match_type")), "call_id").join(
        large(routes.drop("method").withColumnRenamed("function_name", "backend_function")), "route_id", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    return mapped.select(
        F.substring_index("path", "/", -1).alias("frontend_file"), F.col("function_name").alias("frontend_function"),
        F.col("method").alias("http_method"), F.col("url").alias("frontend_url"), text("backend_file").alias("backend_file"),
        text("backend_function").alias("backend_function"), text("route_pattern").alias("backend_route"),
        *[text(c).alias(c) for c in ("database_tables", "stored_procedures", "flow_calls", "response_model", "response_fields",
                                     "nested_fields", "table_column_details")])


def mapping_summary(report: DataFrame) -> DataFrame:
    """Totals and percentages of a mapping report."""
    total = F.count(F.lit(1))
    filled = lambda c: F.count_if(F.col(c) != "")
    parts = {
        "matched": "backend_function", "with_tables": "database_tables", "with_procedures": "stored_procedures",
        "with_flows": "flow_calls", "with_columns": "table_column_details"}
    percent = lambda c: F.coalesce(F.round(filled(c) / F.nullif(total, F.lit(0)) * 100, 1), F.lit(0.0))
    return report.agg(
        total.alias("total"), *[filled(c).alias(n) for n, c in parts.items()], *[percent(c).alias(f"{n}_percent") for n, c in parts.items()])
