"""Every operator as a named query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import rules
from tracewell.operators import code_scan as scan
from tracewell.operators import exports, facts, imports, jobs, procedures, resolve, results, routes
from tracewell.sources import catalog, corpora
from tracewell.sources.storage import new_path
from tracewell.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
NOW = "2024-06-01 00:00:00"
AT = "2024-01-01 00:00:00"


def on(corpus: corpora.Corpus, op: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """Query that applies an operator to one corpus."""
    return lambda spark, sf: op(corpus.read(spark, sf), *args, **kwargs)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.code_files_read(corpora.PY_FILE.read(spark, sf))


def ui_files(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.code_files_read(corpora.TS_FILE.read(spark, sf))


def on_python(op: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf: op(python_files(spark, sf), *args)


def on_functions(op: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf: op(scan.functions(python_files(spark, sf)))


def on_ui(op: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf: op(ui_files(spark, sf), *args)


def api_results(spark: SparkSession, sf: str) -> DataFrame:
    return results.confidence_map(corpora.LINEAGE.read(spark, sf))


def on_results(op: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, sf: op(api_results(spark, sf), *args, **kwargs)


def written(name: str, write: Callable[[DataFrame, str], None], source: Query, read: Callable[[SparkSession, str], DataFrame]) -> Query:
    """Query that writes through a sink into the shared folder and reads the result back."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = new_path(spark, name)
        write(source(spark, sf), path)
        return read(spark, path)
    return run


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).na.fill("")


def lookup_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per order: the full name, schema and name, or the bare name."""
    return corpora.VIEW_DDL.read(spark, sf).selectExpr(
        "CASE object_id % 3 WHEN 0 THEN database_name || '.' || schema_name || '.' || view_name "
        "WHEN 1 THEN schema_name || '.' || view_name ELSE view_name END AS requested")


def copied_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog with a second copy of every view in schema APP."""
    views = corpora.VIEW_DDL.read(spark, sf)
    return views.unionByName(views.withColumn("schema_name", F.lit("APP")))


def changes(spark: SparkSession, sf: str, op: str | None = None) -> DataFrame:
    log = corpora.BASE_VIEW_CHANGE.read(spark, sf)
    return log.where(F.col("op") == op) if op else log


def base(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.BASE_VIEW.read(spark, sf)


def calls(spark: SparkSession, sf: str) -> DataFrame:
    return routes.url_normalise(corpora.FRONTEND_CALL.read(spark, sf), corpora.APP_RULES)


def backend(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.BACKEND_ROUTE.read(spark, sf)


def case_match(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    wanted = part.selectExpr("p_partkey % 50 AS object_id", "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE upper(p_name) END AS wanted")
    keys = part.selectExpr("p_partkey % 50 AS object_id", "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS found")
    return resolve.case_insensitive_match(wanted.distinct(), keys, ["object_id"], "wanted", "found")


def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    def side(odd: int) -> DataFrame:
        return table(spark, sf, "lineitem").where(f"l_linenumber % 2 = {odd}").selectExpr(
            "l_orderkey AS object_id", "'C_' || CAST(l_partkey % 3 AS STRING) AS view_column",
            "CASE l_returnflag WHEN 'N' THEN 'DERIVED' ELSE 'DIRECT' END AS column_type",
            "CASE l_returnflag WHEN 'R' THEN 'UNKNOWN' ELSE 'T_' || CAST(l_suppkey % 40 AS STRING) END AS source_table",
            "'S_' || CAST(l_partkey % 200 AS STRING) AS source_column")
    return resolve.hybrid_merge(side(1), side(0))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.candidate_score(table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS object_id", "'C' AS view_column", "l_linenumber AS candidate_no",
        "CASE l_returnflag WHEN 'A' THEN 'APP.T' WHEN 'N' THEN 'T_1' ELSE 'c1' END AS table_name", "l_returnflag = 'R' AS is_subquery"))


def duplicate_columns(spark: SparkSession, sf: str) -> DataFrame:
    return facts.ddl_dedup_columns(table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS object_id", "'C_' || CAST(l_linenumber % 3 AS STRING) AS column_name", "l_linenumber AS ordinal"))


def sp_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Stored hashes are those of even procedures, with the text of every tenth one changed since."""
    now = corpora.PROCEDURES.read(spark, sf)
    before = now.where("sp_id % 2 = 0").withColumn("procedure_definition", F.expr(
        "CASE WHEN sp_id % 10 = 0 THEN procedure_definition || ' -- old' ELSE procedure_definition END"))
    return procedures.sp_content_hash(now, before.select(procedures.content_hash().alias("content_hash"))).select("sp_id", "reusable")


def full_relations(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.SP_RELATION.read(spark, sf).withColumns({"sp_schema": F.lit("app"), "sp_language": F.lit("sql")})


def model_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names to resolve: a mapped class, a table variable without its prefix, and an unknown name per group."""
    names = table(spark, sf, "part").where("p_partkey % 6 in (0, 1, 2)").selectExpr(
        "CASE p_partkey % 6 WHEN 0 THEN 'Model_' WHEN 1 THEN 'Things_' ELSE 'None_' END || CAST(floor(p_partkey / 6) AS STRING) AS model_name")
    return scan.model_resolve(names, scan.model_table_map(python_files(spark, sf), corpora.APP_RULES), corpora.APP_RULES)


def closure(spark: SparkSession, sf: str) -> DataFrame:
    roots = backend(spark, sf).select(F.col("function_name").alias("root"))
    return routes.call_closure(corpora.CALL_EDGE.read(spark, sf), roots)


def import_links(spark: SparkSession, sf: str) -> DataFrame:
    files = corpora.IMPORT_FILE.read(spark, sf)
    return imports.call_links(scan.functions(files), files)


def known_sql_tables(spark: SparkSession, sf: str) -> DataFrame:
    return scan.sql_tables(corpora.SQL_TEXT.read(spark, sf))


def mapped_details(spark: SparkSession, sf: str) -> DataFrame:
    tables = corpora.MAPPING.read(spark, sf).select(F.col("frontend_function").alias("id"), "database_tables")
    return routes.table_column_details(tables, corpora.catalog_columns(spark, sf))


def job_results(spark: SparkSession, sf: str) -> DataFrame:
    removed = jobs.expired_jobs(corpora.JOBS.read(spark, sf), NOW, 24 * 365 * 22)
    return jobs.results_retention(corpora.LINEAGE.read(spark, sf), removed).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


def reports_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A report written with one spelling of the header and read back with the canonical one."""
    path = new_path(spark, "report")
    raw = corpora.RAW_REPORT.read(spark, sf)
    raw.select("row_no", F.col("sp_name").alias("Sp Name"), F.col("table_name").alias("TABLE_NAME")).write.option(
        "header", True).option("sep", ";").csv(path)
    return catalog.report_read(spark, path, ";")


def mixed_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of one folder with different separators and header spellings, told apart by their first lines."""
    path = new_path(spark, "reports")
    raw = corpora.RAW_REPORT.read(spark, sf)
    for i, (sep, names) in enumerate([(",", ["row_no", "Sp Name", "TABLE_NAME"]), (";", ["Row No", "sp_name", "Table Name"]), ("\t", ["ROW_NO", "SP_NAME", "table_name"])]):
        raw.where(F.col("row_no") % 3 == i).select("row_no", "sp_name", F.concat(F.coalesce("table_name", F.lit("")), F.lit("")).alias("table_name")).toDF(*names).write.option(
            "header", True).option("sep", sep).option("quoteAll", i == 1).csv(f"{path}/{i}")
    return catalog.report_read(spark, path).select("row_no", "sp_name", "table_name")


def code_from_folder(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.code_files_read(corpora.PY_FILE.read(spark, sf).unionByName(corpora.TS_FILE.read(spark, sf))).select(
        "path", F.length("text").alias("n_chars"))


VIEW, ODD, DEEP, PROC = corpora.VIEW_DDL, corpora.ODD_DDL, corpora.DEEP_DDL, corpora.PROCEDURES

QUERIES: dict[str, Query] = {
    # sources
    "catalog_databases": on(VIEW, catalog.catalog_databases),
    "catalog_schemas": on(VIEW, catalog.catalog_schemas, "DB1"),
    "catalog_views_list": on(VIEW, catalog.catalog_views_list, "DB1", "S2", 1000),
    "discover_views": on(VIEW, catalog.discover_views, "DB1", ["S1", "S2"], system_pattern=r"SYS\_%"),
    "ddl_lookup": lambda s, d: catalog.ddl_lookup(lookup_requests(s, d), copied_catalog(s, d), "APP"),
    "procedures_list": on(PROC, procedures.procedures_list, "%CORE%"),
    "procedures_by_name": lambda s, d: procedures.procedures_by_name(
        PROC.read(s, d), table(s, d, "supplier").selectExpr("'sp_' || CAST(s_suppkey AS STRING) AS procedure_name")).select("sp_id", "procedure_name"),
    "code_files_read": code_from_folder,
    "code_lines": on_ui(catalog.code_lines),
    "report_read": reports_csv,
    "report_read_mixed": mixed_reports,
    "repo_classify": on(corpora.REPOSITORY, catalog.repo_classify, rules.FRONTEND_REPOSITORY_PATTERNS + corpora.FRONTEND_WORDS, rules.BACKEND_REPOSITORY_PATTERNS + corpora.BACKEND_WORDS),
    "base_view_read": on(corpora.BASE_VIEW, catalog.base_view_read),
    # sinks
    "lineage_save": written("save", lambda df, p: exports.lineage_save(df, p, AT), lambda s, d: corpora.LINEAGE.read(s, d), lambda s, p: s.read.parquet(p)),
    "mapping_save": written("save", lambda df, p: exports.mapping_save(df, p, AT), lambda s, d: corpora.MAPPING.read(s, d), lambda s, p: s.read.parquet(p)),
    "sp_save": written("save", lambda df, p: exports.sp_save(df, p, AT), lambda s, d: corpora.SP_RELATION.read(s, d), lambda s, p: s.read.parquet(p)),
    "lineage_export_csv": written("csv", lambda df, p: exports.lineage_export_csv(df, p), api_results, read_csv),
    "lineage_export_json": written("json", lambda df, p: exports.lineage_export_json(df, p, False), lambda s, d: api_results(s, d).drop("created_at", "job_id"), lambda s, p: s.read.schema(
        "view_name string, view_column string, column_type string, source_table string, source_column string, expression_type string, confidence_score double").json(p)),
    "mapping_export_csv": written("csv", exports.mapping_export_csv, lambda s, d: corpora.MAPPING.read(s, d), read_csv),
    "mapping_export_json": written("json", exports.mapping_export_json, lambda s, d: corpora.MAPPING.read(s, d), lambda s, p: s.read.text(p).selectExpr(
        "get_json_object(value, '$.frontend.function') AS frontend_function", "get_json_object(value, '$.backend.function') AS backend_function",
        "get_json_object(value, '$.backend.tables[0]') AS first_table")),
    "sp_export_csv": written("csv", exports.sp_export_csv, full_relations, read_csv),
    # facts
    "ddl_classify": on(VIEW, facts.ddl_classify),
    "ddl_object_columns": on(VIEW, facts.ddl_object_columns),
    "ddl_dedup_columns": duplicate_columns,
    "ddl_pattern": on(VIEW, facts.ddl_pattern),
    "ddl_pattern_odd": on(ODD, facts.ddl_pattern),
    "ddl_ctes": on(VIEW, facts.ddl_ctes),
    "ddl_table_refs": on(VIEW, facts.ddl_table_refs),
    "ddl_select_items": on(VIEW, facts.ddl_select_items),
    "ddl_column_refs": on(VIEW, facts.ddl_column_refs),
    "ddl_expr_type": on(VIEW, facts.ddl_expr_type),
    "ddl_window_refs": on(VIEW, facts.ddl_window_refs),
    "ddl_main_select": on(ODD, facts.ddl_main_select),
    "ddl_main_scope": on(VIEW, facts.ddl_main_scope),
    "ddl_identifier_fn": on(ODD, facts.ddl_identifier_fn),
    # resolution
    "alias_resolve": on(VIEW, resolve.alias_resolve),
    "case_insensitive_match": case_match,
    "unqualified_resolve": lambda s, d: resolve.unqualified_resolve(ODD.read(s, d), corpora.catalog_columns(s, d)),
    "unqualified_resolve_by_rank": on(ODD, resolve.unqualified_resolve),
    "wildcard_expand": on(ODD, resolve.wildcard_expand),
    "wildcard_expand_catalog": lambda s, d: resolve.star_columns(VIEW.read(s, d), corpora.catalog_columns(s, d)),
    "cte_dependency_order": on(VIEW, resolve.cte_dependency_order),
    "cte_dependency_order_odd": on(ODD, resolve.cte_dependency_order),
    "cte_column_details": on(VIEW, resolve.cte_column_details),
    "cte_dependent_lookup": on(ODD, resolve.cte_dependent_lookup),
    "cte_trace_base": on(VIEW, resolve.cte_trace_base),
    "cte_trace_base_odd": on(ODD, resolve.cte_trace_base),
    "cte_original_name": on(VIEW, resolve.cte_original_name),
    "cte_main": on(ODD, resolve.cte_main),
    "lineage_direct": on(VIEW, resolve.lineage_direct),
    "lineage_derived": on(VIEW, resolve.lineage_derived),
    "hybrid_merge": hybrid,
    "missing_recovery": on(ODD, resolve.missing_recovery),
    "candidate_score": scored,
    "contributing_sources": on(VIEW, resolve.contributing_sources),
    "promote_derived": on(VIEW, resolve.promote_derived),
    "name_cleanup": lambda s, d: corpora.RAW_NAME.read(s, d).select("name_id", resolve.clean_name(F.col("raw_name")).alias("table_name")),
    "error_rows": on(VIEW, resolve.error_rows),
    "processing_stats": on(VIEW, resolve.processing_stats),
    "lineage_all": on(VIEW, resolve.lineage_all),
    "lineage_all_odd": lambda s, d: resolve.lineage_all(ODD.read(s, d), corpora.catalog_columns(s, d)),
    "lineage_all_deep": on(DEEP, resolve.lineage_all),
    "lineage_all_catalog": lambda s, d: resolve.lineage_all(DEEP.read(s, d), corpora.catalog_columns(s, d)),
    "ddl_object_columns_deep": on(DEEP, facts.ddl_object_columns),
    "ddl_ctes_deep": on(DEEP, facts.ddl_ctes),
    "ddl_table_refs_deep": on(DEEP, facts.ddl_table_refs),
    "ddl_pattern_deep": on(DEEP, facts.ddl_pattern),
    "cte_trace_base_deep": on(DEEP, resolve.cte_trace_base),
    "error_rows_deep": on(DEEP, resolve.error_rows),
    # results
    "confidence_map": lambda s, d: api_results(s, d).withColumn("metadata", F.to_json("metadata")),
    "confidence_filter": lambda s, d: results.confidence_filter(api_results(s, d), 0.8).drop("metadata"),
    "confidence_band": lambda s, d: results.confidence_band(api_results(s, d)).select("view_name", "view_column", "source_table", "source_column", "band", "percent"),
    "results_page": lambda s, d: results.results_page(
        corpora.LINEAGE.read(s, d), ["view_name", "view_column", "column_type", "source_table", "source_column", "expression_type", "created_at"], 50, 100),
    "results_query": on(corpora.LINEAGE, results.results_query, 7, 100, 10),
    "results_query_total": on(corpora.LINEAGE, results.results_total, 7),
    "lineage_by_view": on(corpora.LINEAGE, results.lineage_by_view, "v_12"),
    "results_search": on(corpora.LINEAGE, results.results_search, " T_1"),
    "summary_column_type": on_results(results.summary_column_type),
    "summary_confidence": on_results(results.summary_confidence),
    "summary_top_sources": on_results(results.summary_top_sources),
    "summary_success": lambda s, d: results.summary_success(corpora.JOBS.read(s, d), api_results(s, d)),
    "analysis_summary": on_results(results.analysis_summary),
    "base_view_insert": lambda s, d: results.base_view_insert(base(s, d), changes(s, d, "I")),
    "base_view_insert_conflicts": lambda s, d: results.base_view_conflicts(base(s, d), changes(s, d, "I")),
    "base_view_update": lambda s, d: results.base_view_update(base(s, d), changes(s, d, "U")),
    "base_view_update_missing": lambda s, d: results.base_view_missing(base(s, d), changes(s, d, "U")),
    "base_view_delete": lambda s, d: results.base_view_delete(base(s, d), changes(s, d, "D").select("base_primary_id").distinct()),
    "base_view_apply": lambda s, d: results.base_view_apply(base(s, d), changes(s, d)),
    # procedures
    "sp_variables": on(PROC, procedures.sp_variables),
    "sp_language": on(PROC, procedures.sp_language),
    "sp_temp_tables": on(PROC, procedures.sp_temp_tables),
    "sp_cursors": on(PROC, procedures.sp_cursors),
    "sp_dynamic_sql": on(PROC, procedures.sp_dynamic_sql),
    "sp_identifier_resolve": on(PROC, procedures.sp_identifier_resolve),
    "sp_relations": lambda s, d: procedures.sp_relations(PROC.read(s, d)).drop("sp_schema", "sp_language"),
    "sp_relations_sets": lambda s, d: procedures.sp_relations(corpora.SET_PROCEDURES.read(s, d)).drop("sp_schema", "sp_language"),
    "sp_report": on(PROC, procedures.sp_report),
    "sp_consolidate": on(corpora.SP_RELATION, procedures.sp_consolidate),
    "sp_content_hash": sp_hash,
    "sp_resume": lambda s, d: procedures.sp_resume(PROC.read(s, d), corpora.SP_RELATION.read(s, d)).select("sp_id", "procedure_name"),
    "sp_kind_distribution": on(corpora.SP_RELATION, procedures.sp_kind_distribution),
    "sp_summary": on(corpora.SP_RELATION, procedures.sp_summary),
    "sp_clean_rows": on(corpora.RAW_REPORT, procedures.sp_clean_rows),
    # code
    "known_tables": on_python(scan.known_tables),
    "model_table_map": on_python(scan.model_table_map, corpora.APP_RULES),
    "model_resolve": model_names,
    "orm_columns": lambda s, d: scan.table_columns_text(scan.orm_columns(python_files(s, d))),
    "response_fields": on_python(scan.response_fields),
    "route_response_model": lambda s, d: routes.route_response_model(python_files(s, d)).drop("file_id"),
    "union_fields": lambda s, d: scan.union_fields(python_files(s, d), scan.response_fields(python_files(s, d))),
    "nested_fields": lambda s, d: scan.nested_fields(scan.response_fields(python_files(s, d))),
    "response_fields_types": on(corpora.TYPE_FILE, scan.response_fields),
    "nested_fields_types": lambda s, d: scan.nested_fields(scan.response_fields(corpora.TYPE_FILE.read(s, d))),
    "union_fields_types": lambda s, d: scan.union_fields(corpora.TYPE_FILE.read(s, d), scan.response_fields(corpora.TYPE_FILE.read(s, d))),
    "sql_looks_like": lambda s, d: corpora.SQL_TEXT.read(s, d).select("text_id", scan.looks_like_sql(F.col("text")).alias("is_sql")),
    "sql_tables": known_sql_tables,
    "table_candidate": lambda s, d: corpora.RAW_NAME.read(s, d).select(
        "name_id", scan.table_candidate(F.col("raw_name")).alias("is_candidate"), scan.likely_table(F.col("raw_name")).alias("is_likely")),
    "proc_calls": on_functions(scan.proc_calls),
    "service_proc_map": on_functions(scan.service_proc_map),
    "service_alias": on_python(scan.service_alias),
    "service_resolve": lambda s, d: scan.service_resolve(scan.functions(python_files(s, d)), scan.service_alias(python_files(s, d))),
    "flow_calls": lambda s, d: scan.flow_calls(scan.functions(python_files(s, d)), python_files(s, d)),
    "dynamic_tables": on_functions(scan.dynamic_tables),
    "attr_tables": lambda s, d: scan.attr_tables(scan.functions(python_files(s, d)), scan.model_table_map(python_files(s, d), corpora.APP_RULES), corpora.APP_RULES),
    "function_scope": lambda s, d: scan.function_scope(catalog.scanned_lines(ui_files(s, d))),
    "http_calls": lambda s, d: routes.http_calls(catalog.code_lines(ui_files(s, d))),
    "http_call_url": on_ui(routes.http_call_url, corpora.APP_RULES),
    "http_call_url_var": on_ui(routes.http_call_url_var, corpora.APP_RULES),
    "url_normalise": on(corpora.FRONTEND_CALL, routes.url_normalise, corpora.APP_RULES),
    "backend_routes": on_python(routes.backend_routes, corpora.ROUTE_RULES),
    "route_prefix": on_python(routes.route_prefix, corpora.ROUTE_RULES),
    "function_defs": on_functions(scan.function_defs),
    "call_edges": on_functions(scan.call_edges),
    "call_links": import_links,
    "import_targets": on(corpora.IMPORT_FILE, imports.import_targets),
    "call_closure": closure,
    "route_tables": lambda s, d: routes.backend_report(python_files(s, d), corpora.ROUTE_RULES, corpora.APP_RULES).select("function_name", "database_tables", "stored_procedures", "flow_calls"),
    "route_match_exact": lambda s, d: routes.route_match_exact(calls(s, d), backend(s, d), corpora.APP_RULES),
    "route_match_fuzzy": lambda s, d: routes.route_match_fuzzy(calls(s, d), backend(s, d)).withColumn("score", F.round("score", 6)),
    "mapping_build": lambda s, d: routes.mapping_build(calls(s, d), backend(s, d), corpora.APP_RULES),
    "mapping_report": lambda s, d: routes.mapping_report(ui_files(s, d), python_files(s, d), corpora.ROUTE_RULES, corpora.APP_RULES),
    "table_column_details": mapped_details,
    "relationship_type": lambda s, d: corpora.MAPPING.read(s, d).select(
        "frontend_function", routes.relationship_type(F.col("backend_function") != "", F.col("database_tables")).alias("relationship_type")),
    "response_column_count": on_python(routes.response_column_count),
    "mapping_summary": on(corpora.MAPPING, routes.mapping_summary),
    # jobs
    "jobs_list": on(corpora.JOBS, jobs.jobs_list, "COMPLETED", 50, 20),
    "jobs_retention": lambda s, d: jobs.jobs_retention(corpora.JOBS.read(s, d), NOW, 24 * 365 * 22).select("job_id", "status", "created_at"),
    "jobs_retention_results": job_results,
    "jobs_progress": on(corpora.JOBS, jobs.jobs_progress),
    "jobs_duration": on(corpora.JOBS, jobs.jobs_duration),
    "jobs_latest_state": on(corpora.JOB_EVENTS, jobs.jobs_latest_state),
    # streams
    "stream_incremental_lineage": lambda s, d: streams.stream_incremental_lineage(s, d, "orders.parquet", VIEW.columns),
    "stream_job_progress": lambda s, d: streams.stream_job_progress(s, d, "events.parquet", corpora.JOB_EVENTS.columns),
}
