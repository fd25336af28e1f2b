"""Input corpora derived from the driver's tables.

The tables hold no definitions or code, so each corpus is one portable projection of
a driver table: it grows with that table, and the template number it was made from is
known, which lets the SQL side of a check state the expected facts without parsing.
In templates ``<k>`` stands for the row's key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tracewell.functions.rules import AppRules, RouteRules
from tracewell.functions.skew import spread


def text_of(template: str, **values: str) -> str:
    """SQL expression that yields ``template`` with ``<name>`` replaced by expressions."""
    pieces = [template]
    for name, expr in values.items():
        split = []
        for piece in pieces:
            if isinstance(piece, tuple):
                split.append(piece)
                continue
            for i, part in enumerate(piece.split(f"<{name}>")):
                if i:
                    split.append((expr,))
                split.append(part)
        pieces = split
    terms = []
    for piece in pieces:
        if isinstance(piece, tuple):
            terms.append(f"CAST({piece[0]} AS STRING)")
            continue
        for i, line in enumerate(piece.split("\n")):
            if i:
                terms.append("chr(10)")
            for j, chunk in enumerate(line.split("${")):
                if j:
                    terms.append("'$'")
                    chunk = "{" + chunk
                if chunk:
                    terms.append("'" + chunk.replace("'", "''") + "'")
    return " || ".join(terms) or "''"


def case_of(selector: str, options: list[str], other: str = "NULL") -> str:
    whens = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE {selector} {whens} ELSE {other} END"


@dataclass(frozen=True)
class Corpus:
    table: str
    columns: dict[str, str] = field(hash=False)
    where: str | None = None
    distinct: bool = False
    # Text to be scanned by expressions: worth dealing out when the table has few splits.
    text: bool = False

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        if self.text:
            df = spread(df)
        if self.where:
            df = df.where(self.where)
        df = df.selectExpr(*[f"{expr} AS {name}" for name, expr in self.columns.items()])
        return df.distinct() if self.distinct else df

    def sql(self) -> str:
        cols = ", ".join(f"{expr} AS {name}" for name, expr in self.columns.items())
        where = f" WHERE {self.where}" if self.where else ""
        return f"(SELECT {'DISTINCT ' if self.distinct else ''}{cols} FROM {self.table}{where})"


VIEW_TEMPLATES = [
    "CREATE OR REPLACE VIEW V_<k> (KEY_ID, TOTAL) AS SELECT o.o_orderkey AS KEY_ID, c.c_acctbal AS TOTAL "
    "FROM ORDERS o JOIN CUSTOMER AS c ON c.c_custkey = o.o_custkey",
    "CREATE VIEW V_<k> (A, B) AS SELECT l.l_orderkey AS A, SUM(l.l_extendedprice * (1 - l.l_discount)) AS B "
    "FROM LINEITEM l GROUP BY l.l_orderkey",
    "CREATE VIEW V_<k> (R_REGIONKEY, R_NAME) AS SELECT * FROM REGION",
    "CREATE VIEW V_<k> (K, N) AS WITH c1 AS (SELECT n.n_nationkey AS k, n.n_name AS nm FROM NATION n) "
    "SELECT c1.k AS K, c1.nm AS N FROM c1",
    "CREATE VIEW V_<k> (K, M) AS WITH c1 AS (SELECT p.p_partkey AS k, p.p_retailprice AS pr FROM PART p), "
    "c2 AS (SELECT c1.k AS k2, MAX(c1.pr) AS mx FROM c1 GROUP BY c1.k), "
    "c3 AS (SELECT c2.k2 AS k3, c2.mx AS mx3 FROM c2) SELECT c3.k3 AS K, COALESCE(c3.mx3, 0) AS M FROM c3",
    "CREATE VIEW V_<k> (S_SUPPKEY, RNK) AS SELECT s.s_suppkey AS S_SUPPKEY, ROW_NUMBER() OVER "
    "(PARTITION BY s.s_nationkey ORDER BY s.s_acctbal DESC) AS RNK FROM SUPPLIER s",
    "CREATE TABLE T_<k> AS SELECT o.o_orderkey AS K, CASE WHEN o.o_totalprice > 10 THEN 'a, (b' "
    "ELSE o.o_orderstatus END AS FLAG FROM ORDERS o",
    "DROP VIEW V_<k>",
]

_K = "o_orderkey"
VIEW_NAME = f"CASE WHEN {_K} % 50 = 49 THEN 'SYS_' ELSE 'V_' END || CAST({_K} AS STRING)"
DDL_TEXT = (
    f"CASE WHEN {_K} % 97 = 0 THEN NULL ELSE "
    + case_of(f"{_K} % 8", [text_of(t, k=_K) for t in VIEW_TEMPLATES])
    + " END"
)
VIEW_DDL = Corpus(
    "orders",
    {
        "object_id": _K,
        "database_name": f"'DB' || CAST({_K} % 3 AS STRING)",
        "schema_name": f"'S' || CAST({_K} % 7 AS STRING)",
        "view_name": VIEW_NAME,
        "created": "o_orderdate",
        "template": f"CAST({_K} % 8 AS INT)",
        "ddl_text": DDL_TEXT,
    },
    text=True,
)

# Odd but legal texts: bare columns over a join, stars through a subquery, IDENTIFIER, set
# operations, derived tables, a cycle, a forward reference, a subquery named like its table.
ODD_TEMPLATES = [
    "CREATE VIEW X_<k> (C_NAME, N_NAME) AS SELECT c_name, n_name FROM CUSTOMER c "
    "JOIN NATION n ON c_nationkey = n_nationkey",
    "CREATE VIEW X_<k> (P_PARTKEY, P_NAME, EXTRA) AS WITH w AS (SELECT * FROM PART) "
    "SELECT w.*, UPPER(w.p_brand) AS EXTRA FROM w",
    "CREATE VIEW X_<k> (A, B) AS SELECT * FROM IDENTIFIER('APP.T_<k>')",
    "CREATE VIEW X_<k> (ID) AS SELECT s.s_suppkey AS ID FROM SUPPLIER s UNION ALL "
    "SELECT p.p_partkey AS ID FROM PART p WHERE p.p_size > 1",
    "CREATE VIEW X_<k> (K, CNT) AS SELECT d.k AS K, d.cnt AS CNT FROM "
    "(SELECT o.o_custkey AS k, COUNT(*) AS cnt FROM ORDERS o GROUP BY o.o_custkey) d",
    "CREATE VIEW X_<k> (X) AS WITH a AS (SELECT b.x AS x FROM b), b AS (SELECT a.x AS x FROM a) SELECT a.x AS X FROM a",
    "CREATE VIEW X_<k> (Q, Z) AS WITH a AS (SELECT b.q AS q FROM b), "
    "b AS (SELECT l.l_quantity AS q, l.l_tax AS z /* a, b */ FROM LINEITEM l) -- end, of list\n SELECT a.Q FROM a",
    "CREATE VIEW X_<k> (T1, T2) AS WITH orders AS (SELECT * FROM ORDERS) "
    "SELECT CAST(orders.o_totalprice AS INT) AS T1, 1 AS T2 FROM orders",
    "CREATE VIEW X_<k> (ID, V) AS WITH u AS (SELECT a.c_custkey AS id, a.c_name AS v FROM CUSTOMER a UNION "
    "SELECT a.s_suppkey, UPPER(a.s_name) FROM SUPPLIER a UNION ALL SELECT * FROM EXTRA_<k>) SELECT u.id AS ID, u.v AS V FROM u",
    "CREATE VIEW X_<k> (K) AS WITH r AS (SELECT n.n_nationkey AS k FROM NATION n UNION ALL SELECT r.k FROM r JOIN REGION g ON g.r_regionkey = r.k) "
    "SELECT r.k AS K FROM r INTERSECT SELECT (SELECT 1) + c.c_nationkey FROM CUSTOMER c EXCEPT SELECT p.p_size FROM PART p",
]
ODD_DDL = Corpus(
    "customer",
    {
        "object_id": "c_custkey",
        "view_name": "'X_' || CAST(c_custkey AS STRING)",
        "ddl_text": case_of(f"c_custkey % {len(ODD_TEMPLATES)}", [text_of(t, k="c_custkey") for t in ODD_TEMPLATES]),
    },
    text=True,
)

# Without a column list, and with scopes inside others: chains, brackets around queries, WITH inside WITH, subqueries in
# expressions, derived tables three levels deep, table functions, quoted names, stars.
DEEP_TEMPLATES = [
    "CREATE VIEW D_<k> AS WITH c AS (SELECT n.n_name AS nm, n.n_regionkey AS rk FROM NATION n) SELECT nm AS z, rk FROM c",
    "CREATE OR REPLACE VIEW app.D_<k> COPY GRANTS AS\nWITH a AS (SELECT p.p_partkey AS x, p.p_size FROM PART p),\n"
    "b AS (SELECT a.x AS y, MAX(a.p_size) AS top FROM a GROUP BY a.x),\n c AS (SELECT b.y, b.top FROM b)\nSELECT c.y AS part, c.top FROM c",
    "CREATE VIEW D_<k> AS WITH u AS ((SELECT s.s_name AS nm FROM SUPPLIER s) UNION ALL (SELECT c.c_name FROM CUSTOMER c)) SELECT u.nm FROM u",
    "CREATE TABLE app.main.D_<k> AS WITH t AS (SELECT o.o_custkey AS ck, SUM(o.o_totalprice) AS total FROM ORDERS o GROUP BY o.o_custkey) "
    "SELECT t.ck, t.total * 2 AS twice FROM t",
    "CREATE VIEW D_<k> COMMENT = 'first AS (SELECT' AS WITH o AS (WITH i AS (SELECT r.r_name AS v FROM REGION r) SELECT i.v AS w FROM i), "
    "i AS (SELECT n_name FROM NATION) SELECT o.w, i.n_name FROM o, i",
    "CREATE VIEW D_<k> AS SELECT a.c_custkey AS id, (SELECT MAX(b.o_totalprice) FROM ORDERS b WHERE b.o_custkey = a.c_custkey) AS top FROM CUSTOMER a",
    "CREATE VIEW D_<k> AS SELECT CASE WHEN a.s_nationkey IN (SELECT n_nationkey FROM NATION) AND EXISTS (SELECT * FROM REGION) THEN 1 ELSE 0 END AS ok FROM SUPPLIER a",
    "CREATE VIEW D_<k> AS SELECT x.a AS z FROM (SELECT y.a FROM (SELECT t.b AS a FROM (SELECT u.l_tax AS b FROM LINEITEM u) t) y) x",
    "CREATE VIEW D_<k> AS SELECT " + "(" * 30 + "p.p_name" + ")" * 30 + " AS deep FROM PART p",
    "CREATE VIEW D_<k> AS SELECT e.event_id, f.value AS v, f.index AS at FROM EVENTS e, LATERAL FLATTEN(input => e.props) f",
    'CREATE VIEW "D <k>" AS SELECT "T"."First Name" AS "Full Name" FROM "My Table" "T"',
    "CREATE VIEW D_<k> AS SELECT * FROM (SELECT * FROM REGION) d",
    "CREATE VIEW D_<k> AS SELECT t.a FROM (SELECT n.n_name AS a FROM NATION n) t UNION SELECT t.b FROM (SELECT r.r_name AS b FROM REGION r) t",
    "CREATE VIEW D_<k> AS WITH c (p, q) AS (SELECT l_partkey, MAX(l_quantity) FROM LINEITEM GROUP BY l_partkey) SELECT q, p FROM c",
    "CREATE VIEW D_<k> AS SELECT n.*, c_name FROM NATION n JOIN CUSTOMER c ON c.c_nationkey = n.n_nationkey JOIN REGION r ON r.r_regionkey = n.n_regionkey",
    "CREATE VIEW D_<k> AS SELECT (c.c_name FROM CUSTOMER c",
]
DEEP_DDL = Corpus(
    "customer",
    {
        "object_id": "c_custkey",
        "view_name": "'D_' || CAST(c_custkey AS STRING)",
        "ddl_text": case_of(f"c_custkey % {len(DEEP_TEMPLATES)}", [text_of(t, k="c_custkey") for t in DEEP_TEMPLATES]),
    },
    text=True,
)

PROCEDURE_TEMPLATES = [
    "CREATE PROCEDURE SP_<k>() LANGUAGE SQL AS BEGIN LET tgt VARCHAR := 'STG_ORDERS'; "
    "INSERT INTO STG_ORDERS SELECT o.o_orderkey FROM ORDERS o WHERE o.o_orderstatus = 'F'; END",
    "CREATE PROCEDURE SP_<k>() LANGUAGE PYTHON AS BEGIN src := 'DIM_PART'; "
    "CREATE TEMPORARY TABLE TMP_PART AS SELECT p.p_name FROM IDENTIFIER(:src) p; END",
    "CREATE PROCEDURE SP_<k>() LANGUAGE SQL AS BEGIN LET c1 CURSOR FOR "
    "SELECT s.s_name FROM SUPPLIER s ORDER BY s.s_acctbal; EXECUTE IMMEDIATE q; END",
    "CREATE PROCEDURE SP_<k>() LANGUAGE SQL AS BEGIN MERGE INTO CUSTOMER c USING NATION n "
    "ON c.c_nationkey = n.n_nationkey WHEN MATCHED THEN UPDATE SET c_name = n.n_name; DELETE FROM STG_ORDERS; END",
]
PROCEDURES = Corpus(
    "part",
    {
        "sp_id": "p_partkey",
        "procedure_name": "'SP_' || CAST(p_partkey AS STRING)",
        "procedure_schema": "CASE WHEN p_size % 2 = 0 THEN 'APP_CORE' ELSE 'APP_AUX' END",
        "procedure_definition": case_of("p_partkey % 4", [text_of(t, k="p_partkey") for t in PROCEDURE_TEMPLATES]),
    },
    text=True,
)

# Set operations: a branch's columns belong to its own tables.
SET_TEMPLATES = [
    "CREATE PROCEDURE SP_<k>() AS BEGIN INSERT INTO STG SELECT col1 FROM X UNION ALL SELECT col2 FROM Y WHERE f > 0; END",
    "CREATE PROCEDURE SP_<k>() AS BEGIN CREATE TABLE OUT_T AS SELECT p FROM A EXCEPT SELECT q FROM B INTERSECT SELECT r FROM C; END",
    "CREATE PROCEDURE SP_<k>() AS BEGIN WITH c AS (SELECT o_custkey FROM ORDERS), d2 AS (SELECT s FROM D UNION DISTINCT SELECT t FROM E) SELECT 1; END",
]
SET_PROCEDURES = Corpus(
    "part",
    {
        "sp_id": "p_partkey",
        "procedure_name": "'SP_' || CAST(p_partkey AS STRING)",
        "procedure_schema": "'APP'",
        "procedure_definition": case_of("p_partkey % 3", [text_of(t, k="p_partkey") for t in SET_TEMPLATES]),
    },
    text=True,
)

LINEAGE = Corpus(
    "lineitem",
    {
        "view_name": "'V_' || CAST(l_orderkey AS STRING)",
        "view_column": "'C_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING)",
        "column_type": "CASE WHEN l_returnflag = 'A' THEN 'DIRECT' WHEN l_returnflag = 'N' THEN 'Derived' "
        "WHEN l_linestatus = 'F' THEN 'ERROR' ELSE 'OTHER' END",
        "source_table": "'T_' || CAST(l_suppkey % 40 AS STRING)",
        "source_column": "'S_' || CAST(l_partkey % 200 AS STRING)",
        "expression_type": case_of("l_linenumber % 5", ["'Sum'", "'Case'", "''", "'Window'", "'Anonymous'"]),
        "job_id": "l_orderkey % 1000",
        "created_at": "l_shipdate",
    },
)

JOBS = Corpus(
    "orders",
    {
        "job_id": _K,
        "status": "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END",
        "created_at": "o_orderdate",
        "total_views": "CAST(o_custkey % 120 AS INT)",
        "processed_views": f"CAST(floor((o_custkey % 120) * ({_K} % 11) / 10.0) AS INT)",
        "duration_s": f"{_K} % 9000",
    },
)

JOB_EVENTS = Corpus(
    "events",
    {
        "event_id": "event_id",
        "ts": "ts",
        "job_id": "user_id",
        "status": "CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'COMPLETED' "
        "WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END",
        "value": "value",
    },
)

_METHODS = ["'GET'", "'POST'", "'PUT'", "'PATCH'", "'DELETE'"]
FRONTEND_CALL = Corpus(
    "orders",
    {
        "call_id": _K,
        "method": case_of(f"{_K} % 5", _METHODS),
        "url_raw": case_of(
            f"{_K} % 4",
            [
                text_of("${V2_URL}/r<c>/${itemId}", c="o_custkey % 300"),
                text_of("/api/v2/r<c>?page=2", c="o_custkey % 300"),
                text_of("${V2_WORKFLOW_URL}/r<c>/actions/${item.userId}", c="o_custkey % 300"),
                text_of("/api/v2/none/<k>", k=_K),
            ],
        ),
    },
    text=True,
)

BACKEND_ROUTE = Corpus(
    "customer",
    {
        "route_id": "c_custkey",
        "method": case_of("c_custkey % 5", _METHODS),
        "route_pattern": case_of(
            "c_custkey % 3",
            [
                text_of("/api/v2/r<c>/{id}", c="c_custkey % 300"),
                text_of("/api/v2/r<c>", c="c_custkey % 300"),
                text_of("/api/v2/workflows/r<c>/actions/{uid}/x", c="c_custkey % 300"),
            ],
        ),
        "function_name": "'fn_' || CAST(c_custkey AS STRING)",
    },
    text=True,
)

CALL_EDGE = Corpus(
    "lineitem",
    {
        "caller": "'fn_' || CAST(l_partkey AS STRING)",
        "callee": "'fn_' || CAST(l_partkey - l_partkey % 24 + (l_partkey * 7 + l_linenumber) % 24 AS STRING)",
    },
    distinct=True,
)

BASE_VIEW = Corpus(
    "supplier",
    {"base_primary_id": "s_suppkey", "table_name": "'TABLE_' || CAST(s_suppkey % 60 AS STRING)"},
)
BASE_VIEW_CHANGE = Corpus(
    "events",
    {
        "change_no": "event_id",
        "base_primary_id": "user_id",
        "op": "CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END",
        "table_name": "'TABLE_E' || CAST(event_id % 500 AS STRING)",
    },
)
RAW_REPORT = Corpus(
    "customer",
    {
        "row_no": "c_custkey",
        "sp_name": "CASE c_custkey % 10 WHEN 0 THEN ' null ' WHEN 1 THEN NULL ELSE c_name END",
        "table_name": "CASE c_custkey % 20 WHEN 0 THEN 'N/A' WHEN 1 THEN '' ELSE c_mktsegment END",
    },
)
SP_RELATION = Corpus(
    "lineitem",
    {
        "sp_name": "'SP_' || CAST(l_orderkey % 500 AS STRING)",
        "table_name": "'T_' || CAST(l_suppkey % 40 AS STRING)",
        "column_name": "'C_' || CAST(l_partkey % 25 AS STRING)",
        "relationship_types": case_of(
            "l_linenumber % 3",
            ["'USED_AS_SELECT,USED_AS_FILTER'", "'USED_AS_JOIN'", "'USED_AS_SELECT, USED_AS_GROUP_BY'"],
        ),
    },
)

# Program text, one file per part. The template is p_partkey % 6; names that cross
# files use <g>, the key of the group of six files.
PY_PATHS = [
    "api/v2/orm/model_<k>.py",
    "api/v2/orm/thing_<k>.py",
    "api/v2/models/resp_<k>.py",
    "api/v2/routers/admin/revenue_<k>.py",
    "api/v2/services/svc_<k>.py",
    ".venv/lib/api/v2/services/copy_<k>.py",
]
PY_TEMPLATES = [
    'class Model_<g>(V2Base):\n    __tablename__ = "tbl_hdr_<g>"\n    id_key: Mapped[int] = mapped_column()\n'
    '    title: Mapped[str] = mapped_column()\n    _hidden: Mapped[str] = mapped_column()\n'
    '    owner: Mapped[User] = relationship("User")\n',
    'v2_things_<g> = Table(\n    "things_<g>", V2Base.metadata)\nclass Thing_<g>(V2Base):\n'
    '    __table__ = v2_things_<g>\n',
    'class Inner_<g>(BaseModel):\n    code: str\n    level: int = 0\n\nclass Resp_<g>(BaseModel):\n    id: int\n'
    '    label: Optional[str] = None\n    inner: Inner_<g>\n    _priv: str\n\nclass Both_<g>(BaseModel):\n'
    '    __root__: Inner_<g>|Resp_<g>\n',
    'from api.v2.services.svc import ThingService as ts\n\n'
    '@router.get("/r<g>/{id}", response_model=list[Resp_<g>])\nasync def get_r<g>(id: int):\n'
    '    return load_<g>(id)\n\n'
    '@router.post("/r<g>")\ndef post_r<g>(body: Body) -> Resp_<g>:\n'
    '    flow_service.start_<g>(body)\n    ts.save_<g>(body)\n    return print(body)\n',
    'def load_<g>(x):\n    rows = db.execute("SELECT a FROM ORD_HDR_<g> o JOIN CUST_DIM ON 1 = 1")\n'
    '    return run_<g>(x)\n\n'
    'def run_<g>(x):\n    if x:\n        table_name = "DYN_TBL_<g>"\n'
    '    q = fetch(Model_<g>.title)\n    db.execute("CALL LOAD_SEA_<g>(1)")\n\n'
    'class ThingService:\n    def save_<g>(self, x):\n        run_<g>(x)\n'
    '        return make(proc_name="p_<g>")\n',
    'def copy_<k>(x):\n    return x\n',
]
_G = "CAST(floor(p_partkey / 6) AS BIGINT)"
PY_FILE = Corpus(
    "part",
    {
        "file_id": "p_partkey",
        "path": case_of("p_partkey % 6", [text_of(t, k="p_partkey") for t in PY_PATHS]),
        "text": case_of("p_partkey % 6", [text_of(t, k="p_partkey", g=_G) for t in PY_TEMPLATES]),
    },
    text=True,
)

# User-interface text, one file per customer. Template 0 has the URL on the call line,
# 1 in a variable, 2 some lines further on, 3 is a helper file that is skipped.
TS_PATHS = ["src/api/a<k>.ts", "src/api/b<k>.tsx", "src/api/c<k>.ts", "src/utils<k>/utils.ts"]
TS_TEMPLATES = [
    "export const getItem<k> = async (id) => {\n  return client.get(`${V2_URL}/admin/revenue/r<k>/${itemId}`);\n};\n"
    "export const dropItem<k> = async (id) => {\n  const res = await client.delete(`${V2_URL}/admin/revenue/r<k>/x?y=1`);\n  return res;\n};\n",
    "export const putItem<k> = async (body) => {\n  const url = `${V2_WORKFLOW_URL}/r<k>/actions/${item.userId}`;\n"
    "  return client.put(url, body);\n};\n",
    "export function sendItem<k>(body) {\n  return tsClient.post(\n    // target\n    \"/api/v2/admin/revenue/r<k>\",\n    body);\n}\n",
    "export const getNothing = async () => {\n  return client.get(\"/api/v2/none\");\n};\n",
]
TS_FILE = Corpus(
    "customer",
    {
        "file_id": "c_custkey",
        "path": case_of("c_custkey % 4", [text_of(t, k="c_custkey") for t in TS_PATHS]),
        "text": case_of("c_custkey % 4", [text_of(t, k="c_custkey") for t in TS_TEMPLATES]),
    },
    text=True,
)

# Report rows of user-interface calls; every fourth call has no backend.
_MATCHED = f"{_K} % 4 <> 3"


def _when_matched(template: str) -> str:
    return f"CASE WHEN {_MATCHED} THEN {text_of(template, k=_K, c='o_custkey')} ELSE '' END"


MAPPING = Corpus(
    "orders",
    {
        "frontend_file": text_of("page<k>.ts", k=f"{_K} % 50"),
        "frontend_function": text_of("call<k>", k=_K),
        "http_method": case_of(f"{_K} % 5", _METHODS),
        "frontend_url": text_of("/api/v2/r<c>/{id}", c="o_custkey"),
        "backend_file": _when_matched("admin/r<c>.py"),
        "backend_function": _when_matched("fn_<c>"),
        "backend_route": _when_matched("/api/v2/r<c>/{key}"),
        "database_tables": f"CASE WHEN {_K} % 4 = 0 THEN 'ORDERS;PART' WHEN {_K} % 4 = 1 THEN 'ORDERS' ELSE '' END",
        "stored_procedures": f"CASE WHEN {_K} % 8 = 0 THEN 'LOAD_A,LOAD_B' ELSE '' END",
        "flow_calls": f"CASE WHEN {_K} % 16 = 1 THEN 'start' ELSE '' END",
        "response_model": _when_matched("Resp_<c>"),
        "response_fields": _when_matched("id,label"),
        "nested_fields": "''",
        "table_column_details": f"CASE WHEN {_K} % 4 = 1 THEN 'ORDERS:[O_ORDERKEY]' ELSE '' END",
    },
)

# Names to classify or to clean.
REPOSITORY = Corpus(
    "part",
    {"repository": case_of(
        "p_partkey % 8",
        [text_of(t, k="p_partkey") for t in (
            "shop<k>-frontend", "Shop<k>-API", "tools<k>", "ui-kit<k>", "my<k>-workflow", "my<k>-workflow-backend",
            "service-<k>-web", "data<k>")])},
)
RAW_NAME = Corpus(
    "part",
    {
        "name_id": "p_partkey",
        "raw_name": case_of("p_partkey % 3", [text_of(t, k="p_partkey") for t in ("CTE_base_<k>", "sales_<k> AS s", "Stock_<k>")]),
    },
)
SQL_TEXT = Corpus(
    "part",
    {
        "text_id": "p_partkey",
        "text": case_of("p_partkey % 4", [text_of(t, k="p_partkey") for t in (
            "WITH cte_a AS (SELECT 1 FROM SRC_<k>) SELECT * FROM cte_a JOIN Customers ON 1 = 1",
            "UPDATE ORD_<k> SET a = 1", "please select a colour from the list", "short")]),
    },
)

# Response models whose types hold others: containers in containers, unions, a cycle.
TYPE_FILES = [
    "class Owner_<k>(BaseModel):\n    name: str\n    tree: Tuple[int, Tree_<k>]\n\nclass Leaf_<k>(BaseModel):\n    code: str\n    level: int | None = None\n"
    "    owner: \"Owner_<k>\"\n    _hidden: int\n\nclass Tree_<k>(BaseModel):\n    kids: List[Leaf_<k>]\n    tags: Dict[str, List[int]] = {}\n"
    "    by_key: Dict[str, Optional[Leaf_<k>]]\n    parent: Optional[Tree_<k>]\n",
    "class One_<k>(BaseModel):\n    a: int\n\nclass Two_<k>(BaseModel):\n    b: str\n\nclass Any_<k>(BaseModel):\n    __root__: Union[One_<k>, List[Two_<k>]]\n",
]
TYPE_FILE = Corpus(
    "part",
    {
        "file_id": "p_partkey",
        "path": "'app/models/types_' || CAST(p_partkey AS STRING) || '.py'",
        "text": case_of("p_partkey % 2", [text_of(t, k="p_partkey") for t in TYPE_FILES]),
    },
    text=True,
)

# Files of common names that import each other in every form; the group is p_partkey / 6.
IMPORT_FILES = [
    ("g<g>/utils.py", "def load():\n    return 1\n\ndef keep():\n    return 2\n"),
    ("g<g>/pkg/__init__.py", "from .inner import (\n    make as build,  # renamed (here)\n)\n"),
    ("g<g>/pkg/inner.py", "def make():\n    return 1\n"),
    ("g<g>/main.py", "from g<g>.utils import (\n    load,\n    keep as hold,\n)\nfrom .pkg import build\n\ndef run_<g>():\n    load()\n    hold()\n    build()\n"),
    ("g<g>/side.py", "import g<g>.utils as u\nfrom g<g> import utils\n\ndef walk_<g>():\n    u.load()\n    utils.keep()\n    make()\n"),
    ("g<g>/lost.py", "def find_<g>():\n    load()\n"),
]
_GROUP = "CAST(floor(p_partkey / 6) AS BIGINT)"
IMPORT_FILE = Corpus(
    "part",
    {
        "file_id": "p_partkey",
        "path": case_of("p_partkey % 6", [text_of(p, g=_GROUP) for p, _ in IMPORT_FILES]),
        "text": case_of("p_partkey % 6", [text_of(t, g=_GROUP) for _, t in IMPORT_FILES]),
    },
    text=True,
)

# The catalog of base-table columns is the tables' own schema.
BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, column_name, ordinal) of the base tables, read from their schemas."""
    rows = [
        (table.upper(), column.upper(), i)
        for table in BASE_TABLES
        for i, column in enumerate(spark.read.parquet(f"{sf_dir}/{table}.parquet").columns, 1)
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int")

#: How the router files of these corpora are mounted.
ROUTE_RULES = RouteRules(root="/api/v2", folders=("workflows", "admin"), files=(("revenue", "/revenue"),))

#: What is particular to the program text of these corpora.
APP_RULES = AppRules(url_bases=(("V2_URL", "/api/v2"), ("V2_WORKFLOW_URL", "/api/v2/workflows")), root="/api/v2", url_words=("workflow",), model_prefixes=("v2_",))
FRONTEND_WORDS = [".*workflow.*frontend.*", ".*workflow.*ui.*", ".*workflow$", ".*-workflow$"]
BACKEND_WORDS = [".*workflow.*backend.*", ".*workflow.*api.*", ".*-workflow-backend$"]
