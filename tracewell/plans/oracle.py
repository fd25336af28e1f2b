"""Expected results in plain SQL.

For corpora made from templates the expected facts are listed per template number; the SQL
never parses the text. The other queries are stated relationally.
"""

from __future__ import annotations

from tracewell.plans.registry import AT, NOW
from tracewell.sources import corpora as C


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def expected(table: str, key: str, modulus: int, names: str, rows: list[tuple], where: str = "true",
             id_name: str | None = "object_id", k: str | None = None) -> str:
    """One result row per driver row and listed fact; ``<k>`` in a text is the key (or ``k``)."""
    columns = names.split()
    value = k or key
    text = [any(isinstance(r[i + 1], str) and "<k>" in r[i + 1] for r in rows) for i in range(len(columns))]
    select = ([f"o.{key} AS {id_name}"] if id_name else []) + [
        (f"replace(v.{c}, '<k>', CAST({value} AS VARCHAR))" if t else f"v.{c}") + f" AS {c}" for c, t in zip(columns, text)]
    values = ", ".join("(" + ", ".join(literal(x) for x in row) + ")" for row in rows)
    return (f"SELECT {', '.join(select)} FROM {table} o JOIN (VALUES {values}) v(t, {', '.join(columns)}) "
            f"ON o.{key} % {modulus} = v.t WHERE {where}")


def view(names: str, rows: list[tuple]) -> str:
    return expected("orders", "o_orderkey", 8, names, rows, "o.o_orderkey % 97 <> 0")


def odd(names: str, rows: list[tuple]) -> str:
    return expected("customer", "c_custkey", 10, names, rows)


def deep(names: str, rows: list[tuple]) -> str:
    return expected("customer", "c_custkey", 16, names, rows)


def proc(names: str, rows: list[tuple], id_name: str | None = "sp_id") -> str:
    return expected("part", "p_partkey", 4, names, rows, id_name=id_name)


def code(names: str, rows: list[tuple], id_name: str | None = None, distinct: bool = True) -> str:
    """Facts of the Python files: template p_partkey % 6, ``<k>`` is the group number."""
    sql = expected("part", "p_partkey", 6, names, rows, id_name=id_name, k="(o.p_partkey // 6)")
    return sql.replace("SELECT", "SELECT DISTINCT", 1) if distinct else sql


L, J, V = C.LINEAGE.sql(), C.JOBS.sql(), C.VIEW_DDL.sql()
API_TYPE = "CASE WHEN upper(column_type) IN ('DIRECT', 'DERIVED') THEN upper(column_type) ELSE 'UNKNOWN' END"
API_SCORE = ("CASE upper(column_type) WHEN 'DIRECT' THEN CAST(1.0 AS DOUBLE) WHEN 'DERIVED' THEN CAST(0.8 AS DOUBLE) "
             "WHEN 'ERROR' THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END")
API_EXPR = "CASE WHEN upper(expression_type) IN ('SUM', 'CASE', 'WINDOW') THEN upper(expression_type) END"
API = (f"(SELECT view_name, view_column, {API_TYPE} AS column_type, source_table, source_column, {API_EXPR} AS expression_type, "
       f"job_id, created_at, {API_SCORE} AS confidence_score, expression_type AS original FROM {L} l)")
STAMPS = f"CAST('{AT}' AS TIMESTAMP) AS analysis_timestamp, CAST('{AT}' AS TIMESTAMP) AS created_at"
CALLS = (
    "(SELECT o_orderkey AS call_id, " + C.FRONTEND_CALL.columns["method"] + " AS method, CASE o_orderkey % 4 "
    "WHEN 0 THEN '/api/v2/r' || CAST(o_custkey % 300 AS VARCHAR) || '/{item_id}' "
    "WHEN 1 THEN '/api/v2/r' || CAST(o_custkey % 300 AS VARCHAR) "
    "WHEN 2 THEN '/api/v2/workflows/r' || CAST(o_custkey % 300 AS VARCHAR) || '/actions/{userId}' "
    "ELSE '/api/v2/none/' || CAST(o_orderkey AS VARCHAR) END AS url FROM orders)")
ROUTES = C.BACKEND_ROUTE.sql()
KEY = "regexp_replace(trim(replace({0}, '/api/v2', ''), '/'), '(^|/)\\{{[^/]*', '\\1{{}}', 'g')"
CALL_KEY, ROUTE_KEY = KEY.format("url"), KEY.format("route_pattern")
EXACT = (f"(SELECT c.call_id, min(r.route_id) AS route_id FROM (SELECT *, {CALL_KEY} AS k FROM {CALLS} a) c "
         f"JOIN (SELECT *, {ROUTE_KEY} AS k FROM {ROUTES} b) r ON c.method = r.method AND c.k = r.k GROUP BY c.call_id)")


def fuzzy(calls: str) -> str:
    """Best Jaccard score by listing shared segments; distinct URLs first to keep it small."""
    parts = "unnest(list_distinct(string_split({0}, '/')))"
    return (
        f"(WITH cu AS (SELECT DISTINCT method, url FROM {calls} c), "
        f"ru AS (SELECT method, route_pattern, min(route_id) AS route_id FROM {ROUTES} r GROUP BY ALL), "
        f"cp AS (SELECT method, url, len(list_distinct(string_split(url, '/'))) AS n, {parts.format('url')} AS p FROM cu), "
        f"rp AS (SELECT method, route_id, len(list_distinct(string_split(route_pattern, '/'))) AS n, {parts.format('route_pattern')} AS p FROM ru), "
        "s AS (SELECT cp.method, url, route_id, count(*) / (max(cp.n) + max(rp.n) - count(*)) AS score "
        "FROM cp JOIN rp ON cp.method = rp.method AND cp.p = rp.p GROUP BY ALL HAVING score > 0.6), "
        "b AS (SELECT *, row_number() OVER (PARTITION BY method, url ORDER BY score DESC, route_id) AS rn FROM s) "
        f"SELECT c.call_id, b.route_id, b.score FROM {calls} c JOIN b ON c.method = b.method AND c.url = b.url WHERE rn = 1)")


VIEW_LINEAGE = [
    (0, "V_<k>", "KEY_ID", "DIRECT", "ORDERS", "O_ORDERKEY", ""), (0, "V_<k>", "TOTAL", "DIRECT", "CUSTOMER", "C_ACCTBAL", ""),
    (1, "V_<k>", "A", "DIRECT", "LINEITEM", "L_ORDERKEY", ""), (1, "V_<k>", "B", "DERIVED", "LINEITEM", "L_DISCOUNT; L_EXTENDEDPRICE", "SUM"),
    (2, "V_<k>", "R_REGIONKEY", "DIRECT", "REGION", "R_REGIONKEY", ""), (2, "V_<k>", "R_NAME", "DIRECT", "REGION", "R_NAME", ""),
    (3, "V_<k>", "K", "DIRECT", "NATION", "N_NATIONKEY", ""), (3, "V_<k>", "N", "DIRECT", "NATION", "N_NAME", ""),
    (4, "V_<k>", "K", "DIRECT", "PART", "P_PARTKEY", ""), (4, "V_<k>", "M", "DERIVED", "PART", "P_RETAILPRICE", "COALESCE"),
    (5, "V_<k>", "S_SUPPKEY", "DIRECT", "SUPPLIER", "S_SUPPKEY", ""), (5, "V_<k>", "RNK", "DERIVED", "SUPPLIER", "S_ACCTBAL; S_NATIONKEY", "WINDOW"),
    (6, "T_<k>", "K", "DIRECT", "ORDERS", "O_ORDERKEY", ""), (6, "T_<k>", "FLAG", "DERIVED", "ORDERS", "O_ORDERSTATUS; O_TOTALPRICE", "CASE"),
]
REPORT = "view_name view_column column_type source_table source_column expression_type"
ERRORS = (
    f"SELECT o_orderkey AS object_id, {C.VIEW_NAME} AS view_name, 'ERROR' AS view_column, 'ERROR' AS column_type, r AS source_table, "
    "r AS source_column, 'ERROR' AS expression_type FROM (SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN 'DDL_NOT_FOUND' "
    "WHEN o_orderkey % 8 = 7 THEN 'ANALYSIS_ERROR' END AS r FROM orders) WHERE r IS NOT NULL")
ALL_LINEAGE = f"{view(REPORT, VIEW_LINEAGE)} UNION ALL {ERRORS}"
DEPTHS = {("KEY_ID", 0): 1, ("TOTAL", 0): 1, ("A", 1): 1, ("R_REGIONKEY", 2): 1, ("R_NAME", 2): 1, ("K", 3): 2, ("N", 3): 2,
          ("K", 4): 4, ("S_SUPPKEY", 5): 1, ("K", 6): 1}
ODD_LINEAGE = [
    (0, "X_<k>", "C_NAME", "DIRECT", "CUSTOMER", "C_NAME", ""), (0, "X_<k>", "N_NAME", "DIRECT", "NATION", "N_NAME", ""),
    (1, "X_<k>", "P_PARTKEY", "DIRECT", "PART", "P_PARTKEY", ""), (1, "X_<k>", "P_NAME", "DIRECT", "PART", "P_NAME", ""),
    (1, "X_<k>", "EXTRA", "DERIVED", "PART", "P_BRAND", "ANONYMOUS"),
    (2, "X_<k>", "A", "DIRECT", "APP.T_<k>", "A", ""), (2, "X_<k>", "B", "DIRECT", "APP.T_<k>", "B", ""),
    (3, "X_<k>", "ID", "DERIVED", "PART; SUPPLIER", "P_PARTKEY; S_SUPPKEY", ""),
    (4, "X_<k>", "K", "DIRECT", "ORDERS", "O_CUSTKEY", ""), (4, "X_<k>", "CNT", "DERIVED", "CALCULATED", "COUNT", "COUNT"),
    (5, "X_<k>", "X", "UNKNOWN", "UNKNOWN", "UNKNOWN", ""),
    (6, "X_<k>", "Q", "DIRECT", "LINEITEM", "L_QUANTITY", ""), (6, "X_<k>", "Z", "DIRECT", "LINEITEM", "L_TAX", ""),
    (7, "X_<k>", "T1", "DERIVED", "ORDERS", "O_TOTALPRICE", "CAST"), (7, "X_<k>", "T2", "DERIVED", "CALCULATED", "LITERAL", "LITERAL"),
    (8, "X_<k>", "ID", "DERIVED", "CUSTOMER; EXTRA_<k>; SUPPLIER", "C_CUSTKEY; ID; S_SUPPKEY", ""),
    (8, "X_<k>", "V", "DERIVED", "CUSTOMER; EXTRA_<k>; SUPPLIER", "C_NAME; S_NAME; V", "ANONYMOUS"),
    (9, "X_<k>", "K", "DERIVED", "CUSTOMER; NATION; PART", "C_NATIONKEY; N_NATIONKEY; P_SIZE", "ADD"),
]
DEEP_LINEAGE = [
    (0, "D_<k>", "Z", "DIRECT", "NATION", "N_NAME", ""), (0, "D_<k>", "RK", "DIRECT", "NATION", "N_REGIONKEY", ""),
    (1, "APP.D_<k>", "PART", "DIRECT", "PART", "P_PARTKEY", ""), (1, "APP.D_<k>", "TOP", "DERIVED", "PART", "P_SIZE", "MAX"),
    (2, "D_<k>", "NM", "DERIVED", "CUSTOMER; SUPPLIER", "C_NAME; S_NAME", ""),
    (3, "APP.MAIN.D_<k>", "CK", "DIRECT", "ORDERS", "O_CUSTKEY", ""), (3, "APP.MAIN.D_<k>", "TWICE", "DERIVED", "ORDERS", "O_TOTALPRICE", "MUL"),
    (4, "D_<k>", "W", "DIRECT", "REGION", "R_NAME", ""), (4, "D_<k>", "N_NAME", "DIRECT", "NATION", "N_NAME", ""),
    (5, "D_<k>", "ID", "DIRECT", "CUSTOMER", "C_CUSTKEY", ""), (5, "D_<k>", "TOP", "DERIVED", "ORDERS", "O_TOTALPRICE", "SUBQUERY"),
    (6, "D_<k>", "OK", "DERIVED", "NATION; SUPPLIER", "N_NATIONKEY; S_NATIONKEY", "CASE"),
    (7, "D_<k>", "Z", "DIRECT", "LINEITEM", "L_TAX", ""), (8, "D_<k>", "DEEP", "DERIVED", "PART", "P_NAME", "PAREN"),
    (9, "D_<k>", "EVENT_ID", "DIRECT", "EVENTS", "EVENT_ID", ""), (9, "D_<k>", "V", "DERIVED", "EVENTS", "PROPS", ""),
    (9, "D_<k>", "AT", "DERIVED", "EVENTS", "PROPS", ""), (10, "D <k>", "FULL NAME", "DIRECT", "MY TABLE", "FIRST NAME", ""),
    (12, "D_<k>", "A", "DERIVED", "NATION; REGION", "N_NAME; R_NAME", ""),
    (13, "D_<k>", "Q", "DERIVED", "LINEITEM", "L_QUANTITY", "MAX"), (13, "D_<k>", "P", "DIRECT", "LINEITEM", "L_PARTKEY", ""),
]
DEEP_ERRORS = [(15, "D_<k>", "ERROR", "ERROR", "ANALYSIS_ERROR", "ANALYSIS_ERROR", "ERROR")]
DEEP_STARS = [
    (11, "D_<k>", "*", "UNKNOWN", "REGION", "*", ""), (14, "D_<k>", "*", "UNKNOWN", "NATION", "*", ""), (14, "D_<k>", "C_NAME", "DIRECT", "REGION", "C_NAME", ""),
]
DEEP_STARS_KNOWN = [
    *[(11, "D_<k>", c, "DIRECT", "REGION", c, "") for c in ("R_REGIONKEY", "R_NAME")],
    *[(14, "D_<k>", c, "DIRECT", "NATION", c, "") for c in ("N_NATIONKEY", "N_NAME", "N_REGIONKEY")], (14, "D_<k>", "C_NAME", "DIRECT", "CUSTOMER", "C_NAME", ""),
]
# (template, scope, ordinal, out_name, expr, kind, star_qualifier, from_source, expr_type, refs)
ITEMS = [
    (0, "", 1, "KEY_ID", "o.o_orderkey", "column", "ORDERS", "Column", ["o.o_orderkey"]),
    (0, "", 2, "TOTAL", "c.c_acctbal", "column", "ORDERS", "Column", ["c.c_acctbal"]),
    (1, "", 1, "A", "l.l_orderkey", "column", "LINEITEM", "Column", ["l.l_orderkey"]),
    (1, "", 2, "B", "SUM(l.l_extendedprice * (1 - l.l_discount))", "derived", "LINEITEM", "Sum", ["l.l_extendedprice", "l.l_discount"]),
    (2, "", 1, None, "*", "star", "REGION", "Star", []),
    (3, "c1", 1, "k", "n.n_nationkey", "column", "NATION", "Column", ["n.n_nationkey"]),
    (3, "c1", 2, "nm", "n.n_name", "column", "NATION", "Column", ["n.n_name"]),
    (3, "", 1, "K", "c1.k", "column", "c1", "Column", ["c1.k"]),
    (3, "", 2, "N", "c1.nm", "column", "c1", "Column", ["c1.nm"]),
    (4, "c1", 1, "k", "p.p_partkey", "column", "PART", "Column", ["p.p_partkey"]),
    (4, "c1", 2, "pr", "p.p_retailprice", "column", "PART", "Column", ["p.p_retailprice"]),
    (4, "c2", 1, "k2", "c1.k", "column", "c1", "Column", ["c1.k"]),
    (4, "c2", 2, "mx", "MAX(c1.pr)", "derived", "c1", "Max", ["c1.pr"]),
    (4, "c3", 1, "k3", "c2.k2", "column", "c2", "Column", ["c2.k2"]),
    (4, "c3", 2, "mx3", "c2.mx", "column", "c2", "Column", ["c2.mx"]),
    (4, "", 1, "K", "c3.k3", "column", "c3", "Column", ["c3.k3"]),
    (4, "", 2, "M", "COALESCE(c3.mx3, 0)", "derived", "c3", "Coalesce", ["c3.mx3"]),
    (5, "", 1, "S_SUPPKEY", "s.s_suppkey", "column", "SUPPLIER", "Column", ["s.s_suppkey"]),
    (5, "", 2, "RNK", "ROW_NUMBER() OVER (PARTITION BY s.s_nationkey ORDER BY s.s_acctbal DESC)", "derived", "SUPPLIER", "Window",
     ["s.s_nationkey", "s.s_acctbal"]),
    (6, "", 1, "K", "o.o_orderkey", "column", "ORDERS", "Column", ["o.o_orderkey"]),
    (6, "", 2, "FLAG", "CASE WHEN o.o_totalprice > 10 THEN '' ELSE o.o_orderstatus END", "derived", "ORDERS", "Case",
     ["o.o_totalprice", "o.o_orderstatus"]),
]
TABLES = [
    (0, "", 1, "from", "ORDERS", "o"), (0, "", 2, "join", "CUSTOMER", "c"), (1, "", 1, "from", "LINEITEM", "l"),
    (2, "", 1, "from", "REGION", "region"), (3, "c1", 1, "from", "NATION", "n"), (3, "", 1, "from", "c1", "c1"),
    (4, "c1", 1, "from", "PART", "p"), (4, "c2", 1, "from", "c1", "c1"), (4, "c3", 1, "from", "c2", "c2"), (4, "", 1, "from", "c3", "c3"),
    (5, "", 1, "from", "SUPPLIER", "s"), (6, "", 1, "from", "ORDERS", "o"),
]
OBJECT_COLUMNS = [
    (t, i + 1, c) for t, cols in enumerate([["KEY_ID", "TOTAL"], ["A", "B"], ["R_REGIONKEY", "R_NAME"], ["K", "N"], ["K", "M"],
                                            ["S_SUPPKEY", "RNK"], ["K", "FLAG"]]) for i, c in enumerate(cols)]
SP_FACTS = [
    (0, "STG_ORDERS", "*", "USED_AS_INSERT"), (0, "ORDERS", "*", "USES_TABLE"), (0, "ORDERS", "O_ORDERKEY", "USED_AS_SELECT"),
    (0, "ORDERS", "O_ORDERSTATUS", "USED_AS_FILTER"), (1, "TMP_PART", "*", "PROCEDURE_CREATES_TABLE"), (1, "DIM_PART", "*", "USES_TABLE"),
    (1, "DIM_PART", "P_NAME", "USED_AS_SELECT"), (2, "SUPPLIER", "*", "USES_TABLE"), (2, "SUPPLIER", "S_NAME", "USED_AS_SELECT"),
    (2, "SUPPLIER", "S_ACCTBAL", "USED_AS_ORDER_BY"), (3, "CUSTOMER", "*", "USED_AS_MERGE"), (3, "NATION", "*", "USES_TABLE"),
    (3, "CUSTOMER", "C_NATIONKEY", "USED_AS_MERGE"), (3, "NATION", "N_NATIONKEY", "USED_AS_MERGE"), (3, "CUSTOMER", "C_NAME", "USED_AS_UPDATE"),
    (3, "NATION", "N_NAME", "USED_AS_MERGE"), (3, "STG_ORDERS", "*", "USED_AS_DELETE"),
]
SET_FACTS = [
    (0, ("STG", "*", "USED_AS_INSERT")), (0, ("X", "*", "USES_TABLE")), (0, ("X", "COL1", "USED_AS_SELECT")), (0, ("Y", "*", "USES_TABLE")),
    (0, ("Y", "COL2", "USED_AS_SELECT")), (0, ("Y", "F", "USED_AS_FILTER")),
    (1, ("OUT_T", "*", "PROCEDURE_CREATES_TABLE")), (1, ("A", "*", "USES_TABLE")), (1, ("A", "P", "USED_AS_SELECT")), (1, ("B", "*", "USES_TABLE")),
    (1, ("B", "Q", "USED_AS_SELECT")), (1, ("C", "*", "USES_TABLE")), (1, ("C", "R", "USED_AS_SELECT")),
    (2, ("ORDERS", "*", "USES_TABLE")), (2, ("ORDERS", "O_CUSTKEY", "USED_AS_SELECT")), (2, ("D", "*", "USES_TABLE")), (2, ("D", "S", "USED_AS_SELECT")),
    (2, ("E", "*", "USES_TABLE")), (2, ("E", "T", "USED_AS_SELECT")),
]
TYPE_FACTS = [
    (0, "Tree_<k>", 1, "kids", "List[Leaf_<k>]", False, False, "Leaf_<k>"), (0, "Tree_<k>", 2, "tags", "Dict[str,List[int]]", True, False, "int"),
    (0, "Tree_<k>", 3, "by_key", "Dict[str,Optional[Leaf_<k>]]", False, False, "Leaf_<k>"), (0, "Tree_<k>", 4, "parent", "Optional[Tree_<k>]", False, True, "Tree_<k>"),
    (0, "Leaf_<k>", 1, "code", "str", True, False, "str"), (0, "Leaf_<k>", 2, "level", "int|None", True, True, "int|None"), (0, "Leaf_<k>", 3, "owner", "Owner_<k>", False, False, "Owner_<k>"),
    (0, "Owner_<k>", 1, "name", "str", True, False, "str"), (0, "Owner_<k>", 2, "tree", "Tuple[int,Tree_<k>]", False, False, "Tree_<k>"),
    (1, "One_<k>", 1, "a", "int", True, False, "int"), (1, "Two_<k>", 1, "b", "str", True, False, "str"),
]
QUALIFIED = sorted({(t, s, r.split(".")[0]) for t, s, *_, refs in ITEMS for r in refs})
ALIASES = {(t, s, a): name for t, s, _, _, name, a in TABLES}
CTE_ITEMS = [r for r in ITEMS if r[1]]
VALID = "base_primary_id > 0 AND length(table_name) BETWEEN 1 AND 255"
BV, CH = C.BASE_VIEW.sql(), C.BASE_VIEW_CHANGE.sql()
REL = C.SP_RELATION.sql()
KINDS = f"(SELECT sp_name, table_name, column_name, trim(unnest(string_split(relationship_types, ','))) AS kind FROM {REL} r)"
CLEAN = "CASE WHEN lower(trim(coalesce({0}, ''))) IN ('null', 'none', 'n/a', 'na', '') THEN '' ELSE trim({0}) END"
MAP = C.MAPPING.sql()
TS = "customer"
CUT = f"(CAST('{NOW}' AS TIMESTAMP) - INTERVAL ({24 * 365 * 22}) HOUR)"
OLD = f"(status IN ('COMPLETED', 'FAILED', 'CANCELLED') AND created_at < {CUT})"
MATCHED = ["backend_file", "backend_function", "backend_route", "database_tables", "stored_procedures", "flow_calls",
           "response_model", "response_fields", "nested_fields", "table_column_details"]


def ratio(condition: str) -> str:
    return f"round(count(*) FILTER (WHERE {condition}) * 100.0 / count(*), 1)"


def hybrid_side(odd_line: int, derived: int, direct: int) -> str:
    return (
        f"SELECT l_orderkey AS object_id, 'C_' || CAST(l_partkey % 3 AS VARCHAR) AS view_column, CASE l_returnflag WHEN 'N' THEN 'DERIVED' ELSE 'DIRECT' END AS column_type, "
        f"CASE l_returnflag WHEN 'R' THEN 'UNKNOWN' ELSE 'T_' || CAST(l_suppkey % 40 AS VARCHAR) END AS source_table, 'S_' || CAST(l_partkey % 200 AS VARCHAR) AS source_column, "
        f"CASE l_returnflag WHEN 'R' THEN 5 WHEN 'N' THEN {derived} ELSE {direct} END AS rank FROM lineitem WHERE l_linenumber % 2 = {odd_line}")


# Report rows of the user-interface files: GET calls of template 0 and POST calls of template 2
# find their router when the group has one.
# Other POST calls share five of seven segments with every POST route, so the first one is taken.
ROUTED = "EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = 6 * c.c_custkey + 3)"
CK = "CAST(c.c_custkey AS VARCHAR)"
NEAREST = f"CAST(CASE WHEN {ROUTED} THEN c.c_custkey ELSE 0 END AS VARCHAR)"


def ui_row(template: int, file: str, fn: str, method: str, url: str, behind: dict[str, str] | None = None, nearest: bool = False) -> str:
    fill = lambda s, key=CK: " || ".join([literal(p) if i == 0 else f"{key} || {literal(p)}" for i, p in enumerate(s.split("<k>"))])
    key = NEAREST if nearest else CK
    cells = [fill((behind or {}).get(c, ""), key) for c in MATCHED]
    if behind:
        cells[0] = f"'admin/revenue_' || CAST(6 * CAST({key} AS BIGINT) + 3 AS VARCHAR) || '.py'"
        if not nearest:
            cells = [f"CASE WHEN {ROUTED} THEN {x} ELSE '' END" for x in cells]
    return (f"SELECT {fill(file)} AS frontend_file, {fill(fn)} AS frontend_function, '{method}' AS http_method, {fill(url)} AS frontend_url, "
            + ", ".join(f"{x} AS {c}" for x, c in zip(cells, MATCHED)) + f" FROM customer c WHERE c_custkey % 4 = {template}")


GET_BEHIND = {
    "backend_function": "get_r<k>", "backend_route": "/api/v2/admin/revenue/r<k>/{id}",
    "database_tables": "CUST_DIM;DYN_TBL_<k>;ORD_HDR_<k>;TBL_HDR_<k>", "stored_procedures": "LOAD_SEA_<k>",
    "response_model": "list[Resp_<k>]", "response_fields": "id,label", "nested_fields": "inner.code,inner.level",
    "table_column_details": "CUST_DIM:[unknown];DYN_TBL_<k>:[unknown];ORD_HDR_<k>:[unknown];TBL_HDR_<k>:[ID_KEY,TITLE]"}
POST_BEHIND = {
    "backend_function": "post_r<k>", "backend_route": "/api/v2/admin/revenue/r<k>", "database_tables": "DYN_TBL_<k>;TBL_HDR_<k>",
    "stored_procedures": "P_<k>", "flow_calls": "start_<k>", "response_model": "Resp_<k>", "response_fields": "id,label",
    "nested_fields": "inner.code,inner.level", "table_column_details": "DYN_TBL_<k>:[unknown];TBL_HDR_<k>:[ID_KEY,TITLE]"}
UI_REPORT = " UNION ALL ".join([
    ui_row(0, "a<k>.ts", "getItem<k>", "GET", "/api/v2/admin/revenue/r<k>/{item_id}", GET_BEHIND),
    ui_row(0, "a<k>.ts", "dropItem<k>", "DELETE", "/api/v2/admin/revenue/r<k>/x"),
    ui_row(1, "b<k>.tsx", "putItem<k>", "PUT", "/api/v2/workflows/r<k>/actions/{userId}"),
    ui_row(2, "c<k>.ts", "sendItem<k>", "POST", "/api/v2/admin/revenue/r<k>", POST_BEHIND, nearest=True)])

SQL: dict[str, str] = {
    "catalog_databases": f"SELECT DISTINCT database_name FROM {V} v",
    "catalog_schemas": f"SELECT DISTINCT schema_name FROM {V} v WHERE database_name = 'DB1'",
    "catalog_views_list": f"SELECT view_name, schema_name, database_name, CAST(CASE WHEN ddl_text IS NULL OR template = 7 THEN 0 ELSE 2 END AS INTEGER) AS column_count, created "
                          f"FROM {V} v WHERE database_name = 'DB1' AND schema_name = 'S2' ORDER BY database_name, schema_name, view_name, object_id LIMIT 1000",
    "discover_views": f"SELECT object_id, schema_name, view_name FROM {V} v WHERE database_name = 'DB1' AND schema_name IN ('S1', 'S2') AND NOT starts_with(view_name, 'SYS_')",
    "ddl_lookup": f"SELECT CASE object_id % 3 WHEN 0 THEN database_name || '.' || schema_name || '.' || view_name WHEN 1 THEN schema_name || '.' || view_name ELSE view_name END AS requested, "
                  f"CASE object_id % 3 WHEN 2 THEN 'APP' ELSE schema_name END AS schema_name, database_name, ddl_text FROM {V} v",
    "procedures_list": f"SELECT sp_id, procedure_name, procedure_schema, CAST(length(procedure_definition) AS INTEGER) AS definition_length FROM {C.PROCEDURES.sql()} p WHERE procedure_schema = 'APP_CORE'",
    "procedures_by_name": "SELECT p_partkey AS sp_id, 'SP_' || CAST(p_partkey AS VARCHAR) AS procedure_name FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)",
    "code_files_read": f"SELECT path, CAST(length(text) AS INTEGER) AS n_chars FROM {C.PY_FILE.sql()} f WHERE file_id % 6 <> 5 UNION ALL "
                       f"SELECT path, CAST(length(text) AS INTEGER) AS n_chars FROM {C.TS_FILE.sql()} f WHERE file_id % 4 <> 3",
    "code_lines": f"SELECT file_id, path, CAST(i AS INTEGER) AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i "
                  f"FROM {C.TS_FILE.sql()} f WHERE file_id % 4 <> 3)",
    "report_read": f"SELECT CAST(row_no AS VARCHAR) AS row_no, {CLEAN.format('sp_name')} AS sp_name, {CLEAN.format('table_name')} AS table_name FROM {C.RAW_REPORT.sql()} r",
    "report_read_mixed": f"SELECT CAST(row_no AS VARCHAR) AS row_no, {CLEAN.format('sp_name')} AS sp_name, {CLEAN.format('table_name')} AS table_name FROM {C.RAW_REPORT.sql()} r",
    "repo_classify": expected("part", "p_partkey", 8, "repository kind", [
        (0, "shop<k>-frontend", "frontend"), (1, "Shop<k>-API", "backend"), (3, "ui-kit<k>", "frontend"), (4, "my<k>-workflow", "frontend"),
        (5, "my<k>-workflow-backend", "backend"), (6, "service-<k>-web", "frontend"), (6, "service-<k>-web", "backend")], id_name=None),
    "base_view_read": f"SELECT base_primary_id, table_name, (SELECT count(*) FROM {BV} b) AS total FROM {BV} b",
    "lineage_save": f"SELECT view_name, view_column, column_type, source_table, source_column, expression_type, job_id, {STAMPS} FROM {L} l",
    "mapping_save": "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in C.MAPPING.columns) + f", {STAMPS} FROM {MAP} m",
    "sp_save": f"SELECT sp_name, table_name, column_name, relationship_types, {STAMPS} FROM {REL} r",
    "lineage_export_csv": f"SELECT view_name AS View_Name, view_column AS View_Column, column_type AS Column_Type, source_table AS Source_Table, source_column AS Source_Column, "
                          f"coalesce(expression_type, '') AS Expression_Type, CAST(confidence_score AS VARCHAR) AS Confidence_Score FROM {API} a",
    "lineage_export_json": f"SELECT view_name, view_column, column_type, source_table, source_column, expression_type, confidence_score FROM {API} a",
    "mapping_export_csv": "SELECT " + ", ".join(C.MAPPING.columns) + f" FROM {MAP} m",
    "mapping_export_json": f"SELECT frontend_function, nullif(backend_function, '') AS backend_function, CASE WHEN database_tables <> '' THEN 'ORDERS' END AS first_table FROM {MAP} m",
    "sp_export_csv": f"SELECT sp_name AS SP_NAME, 'APP' AS SP_SCHEMA, 'SQL' AS SP_LANGUAGE, table_name AS TABLE_NAME, column_name AS COLUMN_NAME, upper(relationship_types) AS RELATIONSHIP_TYPES FROM {REL} r",

    "ddl_classify": "SELECT o_orderkey AS object_id, 'unsupported' AS ddl_type, '' AS object_name, false AS has_query, false AS is_supported, false AS unsupported_depth "
        "FROM orders WHERE o_orderkey % 97 = 0 UNION ALL " + view("ddl_type object_name has_query is_supported unsupported_depth", [
        *[(t, "view", "V_<k>", True, True, False) for t in range(6)], (6, "table", "T_<k>", True, True, False), (7, "unsupported", "", False, False, False)]),
    "ddl_object_columns": view("ordinal column_name", OBJECT_COLUMNS),
    "lineage_all_deep": deep(REPORT, DEEP_LINEAGE + DEEP_STARS + DEEP_ERRORS),
    "lineage_all_catalog": deep(REPORT, DEEP_LINEAGE + DEEP_STARS_KNOWN + DEEP_ERRORS),
    "error_rows_deep": deep(REPORT, DEEP_ERRORS),
    "ddl_object_columns_deep": deep("ordinal column_name", [(t, i + 1, c) for t, names in enumerate([
        "z rk", "part top", "nm", "ck twice", "w n_name", "id top", "ok", "z", "deep", "event_id v at", "", "", "a", "q p"]) for i, c in enumerate(names.split())] + [(10, 1, "Full Name")]),
    "ddl_ctes_deep": deep("ordinal cte_name body", [
        (0, 1, "c", "SELECT n.n_name AS nm, n.n_regionkey AS rk FROM NATION n"), (1, 1, "a", "SELECT p.p_partkey AS x, p.p_size FROM PART p"),
        (1, 2, "b", "SELECT a.x AS y, MAX(a.p_size) AS top FROM a GROUP BY a.x"), (1, 3, "c", "SELECT b.y, b.top FROM b"),
        (2, 1, "u", "(SELECT s.s_name AS nm FROM SUPPLIER s) UNION ALL (SELECT c.c_name FROM CUSTOMER c)"),
        (3, 1, "t", "SELECT o.o_custkey AS ck, SUM(o.o_totalprice) AS total FROM ORDERS o GROUP BY o.o_custkey"),
        (4, 1, "i", "SELECT r.r_name AS v FROM REGION r"), (4, 2, "o", "WITH i AS (SELECT r.r_name AS v FROM REGION r) SELECT i.v AS w FROM i"),
        (4, 3, "i", "SELECT n_name FROM NATION"), (13, 1, "c", "SELECT l_partkey, MAX(l_quantity) FROM LINEITEM GROUP BY l_partkey")]),
    "ddl_table_refs_deep": deep("scope_name ordinal clause table_name alias", [
        (0, "c", 1, "from", "NATION", "n"), (0, "", 1, "from", "c", "c"), (1, "a", 1, "from", "PART", "p"), (1, "b", 1, "from", "a", "a"),
        (1, "c", 1, "from", "b", "b"), (1, "", 1, "from", "c", "c"), (2, "subquery_0", 1, "from", "SUPPLIER", "s"), (2, "subquery_1", 1, "from", "CUSTOMER", "c"),
        (2, "u", 1, "from", "subquery_0", "subquery_0"), (2, "", 1, "from", "u", "u"), (3, "t", 1, "from", "ORDERS", "o"), (3, "", 1, "from", "t", "t"),
        (4, "i#0", 1, "from", "REGION", "r"), (4, "o", 1, "from", "i", "i"), (4, "i", 1, "from", "NATION", "nation"), (4, "", 1, "from", "o", "o"), (4, "", 2, "from", "i", "i"),
        (5, "subquery_1", 1, "from", "ORDERS", "b"), (5, "", 1, "from", "CUSTOMER", "a"), (6, "subquery_0", 1, "from", "NATION", "nation"),
        (6, "subquery_1", 1, "from", "REGION", "region"), (6, "", 1, "from", "SUPPLIER", "a"), (7, "t", 1, "from", "LINEITEM", "u"), (7, "y", 1, "from", "t", "t"),
        (7, "x", 1, "from", "y", "y"), (7, "", 1, "from", "x", "x"), (8, "", 1, "from", "PART", "p"), (9, "", 1, "from", "EVENTS", "e"), (9, "", 2, "from", "f", "f"),
        (10, "", 1, "from", "My Table", "t"), (11, "d", 1, "from", "REGION", "region"), (11, "", 1, "from", "d", "d"), (12, "t#0", 1, "from", "NATION", "n"),
        (12, "t", 1, "from", "REGION", "r"), (12, "", 1, "from", "t", "t"), (13, "c", 1, "from", "LINEITEM", "lineitem"), (13, "", 1, "from", "c", "c"),
        (14, "", 1, "from", "NATION", "n"), (14, "", 2, "join", "CUSTOMER", "c"), (14, "", 3, "join", "REGION", "r")]),
    "ddl_pattern_deep": deep("sql_pattern", [(t, "nested_cte_dominant") for t in (0, 1, 3, 13)] + [(2, "hybrid"), (4, "nested_cte_dominant")]
                             + [(t, "hybrid") for t in (5, 7, 8, 9, 10, 12)] + [(6, "wildcard_dominant"), (11, "wildcard_dominant"), (14, "wildcard_dominant")]),
    "cte_trace_base_deep": deep("cte_name column_name depth base_table base_column", [
        (0, "c", "nm", 1, "NATION", "n_name"), (0, "c", "rk", 1, "NATION", "n_regionkey"),
        (1, "a", "x", 1, "PART", "p_partkey"), (1, "a", "p_size", 1, "PART", "p_size"), (1, "b", "y", 2, "PART", "p_partkey"), (1, "b", "top", 2, "PART", "p_size"),
        (1, "c", "y", 3, "PART", "p_partkey"), (1, "c", "top", 3, "PART", "p_size"),
        (2, "subquery_0", "nm", 1, "SUPPLIER", "s_name"), (2, "subquery_1", "c_name", 1, "CUSTOMER", "c_name"), (2, "u", "nm", 2, "SUPPLIER", "s_name"), (2, "u", "nm", 2, "CUSTOMER", "c_name"),
        (3, "t", "ck", 1, "ORDERS", "o_custkey"), (3, "t", "total", 1, "ORDERS", "o_totalprice"),
        (4, "i#0", "v", 1, "REGION", "r_name"), (4, "o", "w", 2, "REGION", "r_name"), (4, "i", "n_name", 1, "NATION", "n_name"),
        (5, "subquery_1", "MAXb.o_totalprice", 1, "ORDERS", "o_totalprice"), (6, "subquery_0", "n_nationkey", 1, "NATION", "n_nationkey"), (6, "subquery_1", "*", 1, "REGION", "*"),
        (7, "t", "b", 1, "LINEITEM", "l_tax"), (7, "y", "a", 2, "LINEITEM", "l_tax"), (7, "x", "a", 3, "LINEITEM", "l_tax"),
        (11, "d", "*", 1, "REGION", "*"), (12, "t#0", "a", 1, "NATION", "n_name"), (12, "t", "b", 1, "REGION", "r_name"),
        (13, "c", "p", 1, "LINEITEM", "l_partkey"), (13, "c", "q", 1, "LINEITEM", "l_quantity")]),
    "ddl_dedup_columns": "SELECT l_orderkey AS object_id, 'C_' || CAST(l_linenumber % 3 AS VARCHAR) AS column_name, min(l_linenumber) AS ordinal FROM lineitem GROUP BY ALL",
    "ddl_pattern": view("sql_pattern", [(0, "hybrid"), (1, "hybrid"), (2, "wildcard_dominant"), (3, "nested_cte_dominant"), (4, "nested_cte_dominant"), (5, "hybrid"), (6, "hybrid")]),
    "ddl_pattern_odd": odd("sql_pattern", [(0, "hybrid"), (1, "hybrid"), (2, "identifier_function"), (3, "hybrid"), (4, "hybrid"), (5, "nested_cte_dominant"), (6, "nested_cte_dominant"), (7, "hybrid"),
        (8, "nested_cte_dominant"), (9, "nested_cte_dominant")]),
    "ddl_ctes": view("ordinal cte_name body", [
        (3, 1, "c1", "SELECT n.n_nationkey AS k, n.n_name AS nm FROM NATION n"), (4, 1, "c1", "SELECT p.p_partkey AS k, p.p_retailprice AS pr FROM PART p"),
        (4, 2, "c2", "SELECT c1.k AS k2, MAX(c1.pr) AS mx FROM c1 GROUP BY c1.k"), (4, 3, "c3", "SELECT c2.k2 AS k3, c2.mx AS mx3 FROM c2")]),
    "ddl_table_refs": view("scope_name ordinal clause table_name alias", TABLES),
    "ddl_select_items": view("scope_name ordinal out_name expr kind star_qualifier from_source", [(t, s, i, o, e, k, "", f) for t, s, i, o, e, k, f, _, _ in ITEMS]),
    "ddl_column_refs": view("scope_name item_ordinal qualifier column_name", [(t, s, i, *r.split(".")) for t, s, i, *_, refs in ITEMS for r in refs]),
    "ddl_expr_type": view("scope_name ordinal expr_type", [(t, s, i, x) for t, s, i, *_, x, _ in ITEMS]),
    "ddl_window_refs": view("scope_name item_ordinal context qualifier column_name", [(5, "", 2, "partition_by", "s", "s_nationkey"), (5, "", 2, "order_by", "s", "s_acctbal")]),
    "ddl_main_select": odd("score n_items has_wildcard from_source", [
        (0, 5, 2, False, "CUSTOMER"), (1, 15, 2, True, "w"), (2, 9, 1, True, None), (3, 6, 1, False, "PART"), (4, 5, 2, False, "d"),
        (5, 4, 1, False, "a"), (6, 4, 1, False, "a"), (7, 5, 2, False, "orders"), (8, 5, 2, False, "u"), (9, 4, 1, False, "r")]),
    "ddl_main_scope": view("n_scopes exprs tables", [
        (t, n, " | ".join(r[4] for r in ITEMS if r[0] == t and not r[1]), ";".join(r[4] for r in TABLES if r[0] == t and not r[1]))
        for t, n in enumerate([1, 1, 1, 2, 4, 1, 1])]),
    "ddl_identifier_fn": odd("view_column column_type source_table source_column", [(2, c, "DIRECT", "APP.T_<k>", c) for c in "AB"]),

    "alias_resolve": view("scope_name qualifier table_name", [(t, s, q, ALIASES[(t, s, q)]) for t, s, q in QUALIFIED]),
    "case_insensitive_match": "SELECT object_id, wanted, found FROM (SELECT w.object_id, wanted, found, row_number() OVER (PARTITION BY w.object_id, wanted ORDER BY found <> wanted, found) AS rn FROM "
        "(SELECT DISTINCT p_partkey % 50 AS object_id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE upper(p_name) END AS wanted FROM part) w JOIN "
        "(SELECT DISTINCT p_partkey % 50 AS object_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS found FROM part) k "
        "ON w.object_id = k.object_id AND lower(wanted) = lower(found)) WHERE rn = 1",
    "unqualified_resolve": odd("column_name table_name", [(0, "c_name", "CUSTOMER"), (0, "n_name", "NATION")]),
    "unqualified_resolve_by_rank": odd("column_name table_name", [(0, "c_name", "NATION"), (0, "n_name", "NATION")]),
    "wildcard_expand": odd("ordinal view_column source_table", [(1, 1, "P_PARTKEY", "PART"), (1, 2, "P_NAME", "PART")]),
    "wildcard_expand_catalog": view("table_name column_name ordinal", [(2, "REGION", "R_REGIONKEY", 1), (2, "REGION", "R_NAME", 2)]),
    "cte_dependency_order": view("cte_name level", [(3, "c1", 1), (4, "c1", 1), (4, "c2", 2), (4, "c3", 3)]),
    "cte_dependency_order_odd": odd("cte_name level", [(1, "w", 1), (5, "a", 1), (5, "b", 1), (6, "a", 2), (6, "b", 1), (7, "orders", 1), (8, "u", 1), (9, "r", 1)]),
    "cte_column_details": view("cte_name column_name detail_type refs", [
        (t, s, o, "derived" if k == "derived" else "direct", ";".join(ALIASES[(t, s, r.split(".")[0])] + "." + r.split(".")[1] for r in refs))
        for t, s, _, o, _, k, _, _, refs in CTE_ITEMS]),
    "cte_dependent_lookup": odd("cte_name column_name found_in", [(5, "a", "x", "b"), (5, "b", "x", "a"), (6, "a", "q", "b")]),
    "cte_trace_base": view("cte_name column_name depth base_table base_column", [
        (3, "c1", "k", 1, "NATION", "n_nationkey"), (3, "c1", "nm", 1, "NATION", "n_name"), (4, "c1", "k", 1, "PART", "p_partkey"),
        (4, "c1", "pr", 1, "PART", "p_retailprice"), (4, "c2", "k2", 2, "PART", "p_partkey"), (4, "c2", "mx", 2, "PART", "p_retailprice"),
        (4, "c3", "k3", 3, "PART", "p_partkey"), (4, "c3", "mx3", 3, "PART", "p_retailprice")]),
    "cte_trace_base_odd": odd("cte_name column_name depth base_table base_column", [
        (1, "w", "*", 1, "PART", "*"), (4, "d", "k", 1, "ORDERS", "o_custkey"), (6, "a", "q", 2, "LINEITEM", "l_quantity"),
        (6, "b", "q", 1, "LINEITEM", "l_quantity"), (6, "b", "z", 1, "LINEITEM", "l_tax"), (7, "orders", "*", 1, "ORDERS", "*"),
        (8, "u", "id", 1, "CUSTOMER", "c_custkey"), (8, "u", "id", 1, "SUPPLIER", "s_suppkey"), (8, "u", "id", 1, "EXTRA_<k>", "id"),
        (8, "u", "v", 1, "CUSTOMER", "c_name"), (8, "u", "v", 1, "SUPPLIER", "s_name"), (8, "u", "v", 1, "EXTRA_<k>", "v"),
        (9, "r", "k", 1, "NATION", "n_nationkey")]),
    "cte_original_name": view("cte_name column_name original_name", [(t, s, o, refs[0].split(".")[1]) for t, s, _, o, *_, refs in CTE_ITEMS]),
    "cte_main": odd("main_cte by_majority", [(1, "w", False), (5, "a", True), (6, "b", True), (7, "orders", False), (8, "u", True), (9, "r", True)]),
    "lineage_direct": view("depth " + REPORT, [(r[0], DEPTHS[(r[2], r[0])], *r[1:]) for r in VIEW_LINEAGE if r[3] == "DIRECT"]),
    "lineage_derived": view(REPORT, [r for r in VIEW_LINEAGE if r[3] == "DERIVED"]),
    "hybrid_merge": f"SELECT object_id, view_column, column_type, source_table, source_column, rank FROM (SELECT *, row_number() OVER (PARTITION BY object_id, view_column "
                    f"ORDER BY rank, source_table, source_column, column_type) AS rn FROM ({hybrid_side(1, 1, 2)} UNION ALL {hybrid_side(0, 4, 3)})) WHERE rn = 1",
    "missing_recovery": odd("view_column method", [
        (0, "C_NAME", "select"), (0, "N_NAME", "select"), (1, "P_PARTKEY", "wildcard"), (1, "P_NAME", "wildcard"), (1, "EXTRA", "select"), (3, "ID", "select"),
        (4, "K", "select"), (4, "CNT", "select"), (5, "X", "unknown"), (6, "Q", "select"), (6, "Z", "any_subquery"), (7, "T1", "select"), (7, "T2", "select"), (8, "ID", "select"), (8, "V", "select"), (9, "K", "select")]),
    "candidate_score": "SELECT object_id, view_column, candidate_no, score FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY score DESC, candidate_no) AS rn FROM "
        "(SELECT l_orderkey AS object_id, 'C' AS view_column, l_linenumber AS candidate_no, CAST(sum(CASE l_returnflag WHEN 'A' THEN 10 WHEN 'N' THEN 5 ELSE 1 END) AS INTEGER) AS score "
        "FROM lineitem GROUP BY ALL)) WHERE rn = 1",
    "contributing_sources": view("view_column tables columns", [(t, c, tb, col) for t, _, c, _, tb, col, _ in VIEW_LINEAGE]),
    "promote_derived": view("view_column is_derived", [(t, c, kind == "DERIVED") for t, _, c, kind, *_ in VIEW_LINEAGE]),
    "name_cleanup": expected("part", "p_partkey", 3, "table_name", [(0, "BASE_<k>"), (1, "SALES_<k>"), (2, "STOCK_<k>")], id_name="name_id"),
    "error_rows": ERRORS,
    "processing_stats": "SELECT count(*) AS total_discovered, count(*) FILTER (WHERE NOT bad) AS successfully_processed, count(*) FILTER (WHERE bad) AS failed, "
        "count(*) FILTER (WHERE NOT bad) AS views_with_columns, CAST(0 AS BIGINT) AS views_with_zero_columns FROM (SELECT o_orderkey % 97 = 0 OR o_orderkey % 8 = 7 AS bad FROM orders)",
    "lineage_all": ALL_LINEAGE,
    "lineage_all_odd": odd(REPORT, ODD_LINEAGE),

    "confidence_map": f"SELECT * EXCLUDE (original), '{{\"analysis_method\":\"expression_facts\",\"original_expression_type\":\"' || original || '\"}}' AS metadata FROM {API} a",
    "confidence_filter": f"SELECT * EXCLUDE (original) FROM {API} a WHERE confidence_score >= 0.8",
    "confidence_band": f"SELECT view_name, view_column, source_table, source_column, CASE WHEN confidence_score >= 0.8 THEN 'success' WHEN confidence_score >= 0.6 THEN 'warning' ELSE 'error' END AS band, "
                       f"format('{{:.1f}}%', confidence_score * 100) AS percent FROM {API} a",
    "results_page": f"SELECT * FROM {L} l ORDER BY view_name, view_column, column_type, source_table, source_column, expression_type, created_at LIMIT 50 OFFSET 100",
    "results_query": f"SELECT * FROM {L} l WHERE job_id = 7 ORDER BY created_at DESC, view_name, view_column, column_type, source_table, source_column, expression_type LIMIT 100 OFFSET 10",
    "results_query_total": f"SELECT count(*) AS total_records FROM {L} l WHERE job_id = 7",
    "lineage_by_view": f"SELECT * FROM {L} l WHERE view_name = 'V_12'",
    "results_search": f"SELECT * FROM {L} l WHERE " + " OR ".join(f"contains(lower({c}), 't_1')" for c in REPORT.split()),
    "summary_column_type": f"SELECT column_type, count(*) AS n FROM {API} a GROUP BY ALL",
    "summary_confidence": f"SELECT round(avg(confidence_score), 3) AS average, round(min(confidence_score), 3) AS minimum, round(max(confidence_score), 3) AS maximum FROM {API} a",
    "summary_top_sources": f"SELECT source_table, count(*) AS n FROM {API} a GROUP BY ALL ORDER BY n DESC, source_table LIMIT 10",
    "summary_success": f"SELECT j.job_id, coalesce(processed_views / nullif(total_views, 0) * 100, 0.0) AS view_success_rate, coalesce(high / n * 100, 0.0) AS high_confidence_rate FROM {J} j "
                       f"LEFT JOIN (SELECT job_id, count(*) FILTER (WHERE confidence_score >= 0.8) AS high, count(*) AS n FROM {API} a GROUP BY job_id) r USING (job_id)",
    "analysis_summary": f"SELECT count(DISTINCT view_name) AS total_views, count(*) AS total_columns, count(*) FILTER (WHERE column_type <> 'UNKNOWN') AS successful_columns, "
                        f"count(*) FILTER (WHERE column_type = 'UNKNOWN') AS error_columns, round(count(*) FILTER (WHERE column_type <> 'UNKNOWN') / count(*) * 100, 1) AS success_rate FROM {API} a",
    "base_view_insert": f"SELECT * FROM {BV} b UNION ALL SELECT base_primary_id, arg_min(table_name, change_no) AS table_name FROM {CH} c WHERE op = 'I' AND {VALID} "
                        f"AND base_primary_id NOT IN (SELECT base_primary_id FROM {BV} b) GROUP BY base_primary_id",
    "base_view_insert_conflicts": f"SELECT DISTINCT base_primary_id FROM {CH} c WHERE op = 'I' AND {VALID} AND base_primary_id IN (SELECT base_primary_id FROM {BV} b)",
    "base_view_update": f"SELECT b.base_primary_id, coalesce(u.n, b.table_name) AS table_name FROM {BV} b LEFT JOIN (SELECT base_primary_id, arg_max(table_name, change_no) AS n FROM {CH} c "
                        f"WHERE op = 'U' AND {VALID} GROUP BY 1) u USING (base_primary_id)",
    "base_view_update_missing": f"SELECT DISTINCT base_primary_id FROM {CH} c WHERE op = 'U' AND base_primary_id NOT IN (SELECT base_primary_id FROM {BV} b)",
    "base_view_delete": f"SELECT * FROM {BV} b WHERE base_primary_id NOT IN (SELECT base_primary_id FROM {CH} c WHERE op = 'D')",
    "base_view_apply": f"SELECT base_primary_id, coalesce(c.table_name, b.table_name) AS table_name FROM {BV} b FULL JOIN (SELECT base_primary_id, arg_max(op, change_no) AS op, "
                       f"arg_max(table_name, change_no) AS table_name FROM {CH} x WHERE {VALID} GROUP BY 1) c USING (base_primary_id) WHERE coalesce(op, '') <> 'D'",

    "sp_variables": proc("variable table_name", [(0, "VARCHAR", "STG_ORDERS"), (0, "tgt", "STG_ORDERS"), (1, "src", "DIM_PART")]),
    "sp_language": proc("sp_language", [(0, "SQL"), (1, "PYTHON"), (2, "SQL"), (3, "SQL")]),
    "sp_temp_tables": proc("temp_table", [(1, "TMP_PART")]),
    "sp_cursors": proc("cursor", [(2, "c1")]),
    "sp_dynamic_sql": proc("has_dynamic_sql", [(0, False), (1, False), (2, True), (3, False)]),
    "sp_identifier_resolve": proc("variable table_name", [(1, "src", "DIM_PART")]),
    "sp_relations": proc("sp_name table_name column_name kind", [(t, "SP_<k>", *r) for t, *r in SP_FACTS]),
    "sp_report": "SELECT r.* EXCLUDE (sp_id), CASE WHEN o.p_size % 2 = 0 THEN 'APP_CORE' ELSE 'APP_AUX' END AS sp_schema FROM ("
                 + proc("sp_name sp_language table_name column_name relationship_types", [(t, "SP_<k>", "PYTHON" if t == 1 else "SQL", *r) for t, *r in SP_FACTS])
                 + ") r JOIN part o ON o.p_partkey = r.sp_id",
    "sp_relations_sets": expected("part", "p_partkey", 3, "sp_name table_name column_name kind", [(t, "SP_<k>", *r) for t, r in SET_FACTS], id_name="sp_id"),
    "response_fields_types": expected("part", "p_partkey", 2, "model ordinal field type is_simple is_optional base_type", TYPE_FACTS, id_name=None),
    "nested_fields_types": expected("part", "p_partkey", 2, "model ordinal child_no nested_field", [
        (0, "Tree_<k>", 1, 1, "kids.code"), (0, "Tree_<k>", 1, 2, "kids.level"), (0, "Tree_<k>", 3, 1, "by_key.code"), (0, "Tree_<k>", 3, 2, "by_key.level"),
        (0, "Tree_<k>", 1, 1, "kids.owner.name"), (0, "Tree_<k>", 3, 1, "by_key.owner.name"), (0, "Leaf_<k>", 3, 1, "owner.name"), (0, "Leaf_<k>", 3, 2, "owner.tree.tags"),
        (0, "Owner_<k>", 2, 2, "tree.tags"), (0, "Owner_<k>", 2, 1, "tree.kids.code"), (0, "Owner_<k>", 2, 2, "tree.kids.level"),
        (0, "Owner_<k>", 2, 1, "tree.by_key.code"), (0, "Owner_<k>", 2, 2, "tree.by_key.level")], id_name=None),
    "union_fields_types": expected("part", "p_partkey", 2, "model name field", [
        (1, "Any_<k>", "__root__One_<k>", "a"), (1, "Any_<k>", "__root__Two_<k>", "b")], id_name=None),
    "sp_consolidate": f"SELECT sp_name, table_name, column_name, string_agg(DISTINCT kind, ',' ORDER BY kind) AS relationship_types FROM {KINDS} k GROUP BY ALL",
    "sp_content_hash": "SELECT p_partkey AS sp_id, p_partkey % 2 = 0 AND p_partkey % 10 <> 0 AS reusable FROM part",
    "sp_resume": f"SELECT p_partkey AS sp_id, 'SP_' || CAST(p_partkey AS VARCHAR) AS procedure_name FROM part WHERE 'SP_' || CAST(p_partkey AS VARCHAR) NOT IN (SELECT sp_name FROM {REL} r)",
    "sp_kind_distribution": f"SELECT kind, count(*) AS n FROM {KINDS} k GROUP BY kind",
    "sp_summary": f"SELECT count(*) AS total_relationships, count(DISTINCT table_name) AS unique_tables, count(DISTINCT sp_name) AS procedures FROM {REL} r",
    "sp_clean_rows": f"SELECT * FROM (SELECT row_no, {CLEAN.format('sp_name')} AS sp_name, {CLEAN.format('table_name')} AS table_name FROM {C.RAW_REPORT.sql()} r) WHERE sp_name <> '' OR table_name <> ''",

    "known_tables": code("table_name", [(0, "TBL_HDR_<k>"), (1, "THINGS_<k>")]),
    "model_table_map": code("model table_name", [(0, "Model_<k>", "TBL_HDR_<k>"), (1, "Thing_<k>", "THINGS_<k>"), (1, "v2_things_<k>", "THINGS_<k>"), (1, "things_<k>", "THINGS_<k>")]),
    "model_resolve": code("model_name table_name", [(0, "Model_<k>", "TBL_HDR_<k>"), (1, "Things_<k>", "THINGS_<k>")]),
    "orm_columns": code("table_name columns", [(0, "TBL_HDR_<k>", "ID_KEY,TITLE")]),
    "response_fields": code("model ordinal field type is_simple is_optional base_type", [
        (0, "Model_<k>", 1, "id_key", "Mapped[int]", False, False, "Mapped[int]"), (0, "Model_<k>", 2, "title", "Mapped[str]", False, False, "Mapped[str]"),
        (0, "Model_<k>", 3, "owner", "Mapped[User]", False, False, "Mapped[User]"), (2, "Inner_<k>", 1, "code", "str", True, False, "str"),
        (2, "Inner_<k>", 2, "level", "int", True, False, "int"), (2, "Resp_<k>", 1, "id", "int", True, False, "int"),
        (2, "Resp_<k>", 2, "label", "Optional[str]", True, True, "str"), (2, "Resp_<k>", 3, "inner", "Inner_<k>", False, False, "Inner_<k>")]),
    "route_response_model": code("function_name response_model model", [(3, "get_r<k>", "list[Resp_<k>]", "Resp_<k>"), (3, "post_r<k>", "Resp_<k>", "Resp_<k>")]),
    "union_fields": code("model name field", [(2, "Both_<k>", f"__root__{m}_<k>", f) for m, fs in (("Inner", ("code", "level")), ("Resp", ("id", "label"))) for f in fs]),
    "nested_fields": code("model ordinal child_no nested_field", [(2, "Resp_<k>", 3, 1, "inner.code"), (2, "Resp_<k>", 3, 2, "inner.level")]),
    "sql_looks_like": expected("part", "p_partkey", 4, "is_sql", [(0, True), (1, True), (2, True), (3, False)], id_name="text_id"),
    "sql_tables": expected("part", "p_partkey", 4, "table_name", [(0, "SRC_<k>"), (0, "CUSTOMERS"), (1, "ORD_<k>")], id_name="text_id"),
    "table_candidate": expected("part", "p_partkey", 3, "is_candidate is_likely", [(0, True, True), (1, True, True), (2, True, True)], id_name="name_id"),
    "proc_calls": code("name procedure", [(4, "run_<k>", "LOAD_SEA_<k>"), (4, "save_<k>", "p_<k>")]),
    "service_proc_map": code("function_name procedure", [(4, "run_<k>", "LOAD_SEA_<k>"), (4, "save_<k>", "p_<k>"), (4, "ThingService.save_<k>", "p_<k>")]),
    "service_alias": code("alias service_class", [(3, "ts", "ThingService")], id_name="file_id"),
    "service_resolve": code("name alias method target", [(3, "post_r<k>", "ts", "save_<k>", "ThingService.save_<k>")]),
    "flow_calls": code("name flow_call", [(3, "post_r<k>", "start_<k>")]),
    "dynamic_tables": code("name table_name", [(4, "run_<k>", "DYN_TBL_<k>")]),
    "attr_tables": code("name table_name", [(4, "run_<k>", "TBL_HDR_<k>")]),
    "function_scope": expected(TS, "c_custkey", 4, "line_no function_name", [
        *[(0, i, "getItem<k>") for i in (1, 2, 3)], *[(0, i, "dropItem<k>") for i in (4, 5, 6, 7)], (0, 8, None),
        *[(1, i, "putItem<k>") for i in (1, 2, 3, 4)], (1, 5, None), *[(2, i, "sendItem<k>") for i in range(1, 7)], (2, 7, None)], id_name="file_id"),
    "http_calls": expected(TS, "c_custkey", 4, "line_no method", [(0, 2, "GET"), (0, 5, "DELETE"), (1, 3, "PUT"), (2, 2, "POST")], id_name="file_id"),
    "http_call_url": expected(TS, "c_custkey", 4, "path function_name method url line_no", [
        (0, "src/api/a<k>.ts", "getItem<k>", "GET", "/api/v2/admin/revenue/r<k>/{item_id}", 2), (0, "src/api/a<k>.ts", "dropItem<k>", "DELETE", "/api/v2/admin/revenue/r<k>/x", 5),
        (1, "src/api/b<k>.tsx", "putItem<k>", "PUT", "/api/v2/workflows/r<k>/actions/{userId}", 3), (2, "src/api/c<k>.ts", "sendItem<k>", "POST", "/api/v2/admin/revenue/r<k>", 2)], id_name="file_id"),
    "http_call_url_var": expected(TS, "c_custkey", 4, "function_name variable url", [(1, "putItem<k>", "url", "/api/v2/workflows/r<k>/actions/{userId}")], id_name="file_id"),
    "url_normalise": f"SELECT * FROM {CALLS} c",
    "backend_routes": "SELECT p_partkey AS file_id, 'api/v2/routers/admin/revenue_' || CAST(p_partkey AS VARCHAR) || '.py' AS path, r.* EXCLUDE (g) FROM part JOIN (" + code(
        "g line_no method route_pattern function_name response_model", [
            (3, "<k>", 3, "GET", "/api/v2/admin/revenue/r<k>/{id}", "get_r<k>", "list[Resp_<k>]"), (3, "<k>", 7, "POST", "/api/v2/admin/revenue/r<k>", "post_r<k>", "Resp_<k>")])
        + ") r ON p_partkey = 6 * CAST(r.g AS BIGINT) + 3",
    "route_prefix": "SELECT p_partkey AS file_id, 'api/v2/routers/admin/revenue_' || CAST(p_partkey AS VARCHAR) || '.py' AS path, '/api/v2/admin/revenue' AS prefix FROM part WHERE p_partkey % 6 = 3",
    "function_defs": "SELECT d.function_name, d.folder || CAST(6 * CAST(d.g AS BIGINT) + d.off AS VARCHAR) || '.py' AS path, CAST(line_no AS INTEGER) AS line_no FROM (" + code(
        "g function_name folder off line_no", [
            (3, "<k>", "get_r<k>", "api/v2/routers/admin/revenue_", 3, 4), (3, "<k>", "post_r<k>", "api/v2/routers/admin/revenue_", 3, 8),
            (4, "<k>", "load_<k>", "api/v2/services/svc_", 4, 1), (4, "<k>", "run_<k>", "api/v2/services/svc_", 4, 5),
            (4, "<k>", "save_<k>", "api/v2/services/svc_", 4, 12), (4, "<k>", "ThingService.save_<k>", "api/v2/services/svc_", 4, 12)]) + ") d",
    "call_links": "WITH g AS (SELECT p_partkey, p_partkey % 6 AS t, p_partkey // 6 AS g, p_partkey - p_partkey % 6 AS first, count(*) FILTER (WHERE p_partkey % 6 = 0) OVER () AS loads, "
        "count(*) FILTER (WHERE p_partkey % 6 = 2) OVER () AS makes FROM part) SELECT p_partkey || ':' || fn || g AS caller, name, CASE WHEN place IS NOT NULL THEN (first + place) || ':' || target END AS callee, "
        "how, CASE how WHEN 'imported' THEN 1 ELSE CASE name WHEN 'load' THEN loads ELSE makes END END AS n_candidates FROM g JOIN (VALUES "
        "(3, 'run_', 'load', 0, 'load', 'imported'), (3, 'run_', 'hold', 0, 'keep', 'imported'), (3, 'run_', 'build', 2, 'make', 'imported'), (4, 'walk_', 'u.load', 0, 'load', 'imported'), "
        "(4, 'walk_', 'utils.keep', 0, 'keep', 'imported'), (4, 'walk_', 'make', NULL, NULL, 'ambiguous'), (5, 'find_', 'load', NULL, NULL, 'ambiguous')) v(t, fn, name, place, target, how) USING (t)",
    "import_targets": "SELECT p_partkey AS file_id, replace(alias, '<g>', CAST(p_partkey // 6 AS VARCHAR)) AS alias, original, p_partkey - p_partkey % 6 + place AS target, CAST(1 AS BIGINT) AS n_targets FROM part JOIN (VALUES "
        "(1, 'build', 'make', 2), (3, 'load', 'load', 0), (3, 'hold', 'keep', 0), (3, 'build', 'build', 1), (4, 'u', NULL, 0), (4, 'utils', NULL, 0)) v(t, alias, original, place) ON p_partkey % 6 = v.t "
        "WHERE p_partkey - p_partkey % 6 + place IN (SELECT p_partkey FROM part)",
    "call_edges": code("caller callee", [(3, "get_r<k>", "load_<k>"), (4, "load_<k>", "run_<k>"), (4, "run_<k>", "fetch"), (4, "save_<k>", "run_<k>"), (4, "save_<k>", "make")]),
    "call_closure": f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {C.CALL_EDGE.sql()} x), r(root, function_name, depth) AS (SELECT DISTINCT function_name, function_name, 0 FROM {ROUTES} b "
                    "UNION SELECT r.root, e.callee, r.depth + 1 FROM r JOIN e ON e.caller = r.function_name WHERE r.depth < 24) SELECT root, function_name, min(depth) AS depth FROM r GROUP BY ALL",
    "route_tables": code("function_name database_tables stored_procedures flow_calls", [
        (3, "get_r<k>", GET_BEHIND["database_tables"], GET_BEHIND["stored_procedures"], ""), (3, "post_r<k>", POST_BEHIND["database_tables"], "LOAD_SEA_<k>,P_<k>", "start_<k>")]),
    "route_match_exact": f"SELECT * FROM {EXACT} e",
    "route_match_fuzzy": f"SELECT call_id, route_id, round(score, 6) AS score FROM {fuzzy(CALLS)} f",
    "mapping_build": f"SELECT c.call_id, coalesce(e.route_id, f.route_id) AS route_id, CASE WHEN e.route_id IS NOT NULL THEN 'exact' WHEN f.route_id IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS match_type "
                     f"FROM {CALLS} c LEFT JOIN {EXACT} e USING (call_id) LEFT JOIN {fuzzy(CALLS)} f USING (call_id)",
    "mapping_report": UI_REPORT,
    "table_column_details": f"SELECT frontend_function AS id, CASE database_tables WHEN 'ORDERS' THEN o ELSE o || ';' || p END AS table_column_details FROM {MAP} m, "
        "(SELECT 'ORDERS:[O_CUSTKEY,O_ORDERDATE,O_ORDERKEY,O_ORDERPRIORITY,O_ORDERSTATUS,O_TOTALPRICE]' AS o, 'PART:[P_BRAND,P_NAME,P_PARTKEY,P_RETAILPRICE,P_SIZE,P_TYPE]' AS p) WHERE database_tables <> ''",
    "relationship_type": f"SELECT frontend_function, CASE WHEN backend_function = '' THEN 'unmatched' WHEN database_tables = '' THEN 'no_tables' WHEN database_tables = 'ORDERS' THEN 'single_table' "
                         f"ELSE 'multi_table_join' END AS relationship_type FROM {MAP} m",
    "response_column_count": code("function_name model column_count", [(3, "get_r<k>", "Resp_<k>", 4), (3, "post_r<k>", "Resp_<k>", 4)]).replace("v.column_count AS", "CAST(v.column_count AS BIGINT) AS"),
    "mapping_summary": "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {c} <> '') AS {n}, {ratio(c + chr(32) + '<> ' + chr(39) * 2)} AS {n}_percent" for n, c in (
        ("matched", "backend_function"), ("with_tables", "database_tables"), ("with_procedures", "stored_procedures"), ("with_flows", "flow_calls"), ("with_columns", "table_column_details"))) + f" FROM {MAP} m",

    "jobs_list": f"SELECT * FROM {J} j WHERE status = 'COMPLETED' ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 20",
    "jobs_retention": f"SELECT job_id, status, created_at FROM {J} j WHERE NOT {OLD}",
    "jobs_retention_results": f"SELECT job_id, count(*) AS n FROM {L} l WHERE job_id NOT IN (SELECT job_id FROM {J} j WHERE {OLD}) GROUP BY job_id",
    "jobs_progress": f"SELECT job_id, CAST(CASE WHEN total_views > 0 THEN floor(processed_views / total_views * 100 + 0.5) ELSE 0 END AS BIGINT) AS percent FROM {J} j",
    "jobs_duration": f"SELECT job_id, CASE WHEN duration_s < 60 THEN CAST(duration_s AS VARCHAR) || 's' WHEN duration_s < 3600 THEN CAST(duration_s // 60 AS VARCHAR) || 'm ' || CAST(duration_s % 60 AS VARCHAR) || 's' "
                     f"ELSE CAST(duration_s // 3600 AS VARCHAR) || 'h ' || CAST(duration_s % 3600 // 60 AS VARCHAR) || 'm' END AS duration FROM {J} j",
    "jobs_latest_state": f"WITH e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM {C.JOB_EVENTS.sql()} x), "
        "c AS (SELECT job_id, min(rn) FILTER (WHERE status IN ('COMPLETED', 'FAILED', 'CANCELLED')) AS closed FROM e GROUP BY job_id) "
        "SELECT job_id, arg_max(status, rn) FILTER (WHERE closed IS NULL OR rn <= closed) AS status, count(*) FILTER (WHERE rn > closed) AS n_refused, count(*) AS n_events, max(value) FILTER (WHERE closed IS NULL OR rn <= closed) AS max_value "
        "FROM e JOIN c USING (job_id) GROUP BY job_id",
    "stream_incremental_lineage": ALL_LINEAGE,
    "stream_job_progress": f"SELECT date_trunc('hour', ts) AS window_start, status, count(*) AS n FROM {C.JOB_EVENTS.sql()} x GROUP BY ALL",
}
