"""Queries on lineage results and on the base-view registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import rules

SEARCH_FIELDS = ["view_name", "view_column", "column_type", "source_table", "source_column", "expression_type"]


def confidence_map(rows: DataFrame) -> DataFrame:
    """Report rows as API results: column type, confidence score, known expression type, metadata."""
    kind, expr = F.upper("column_type"), F.upper("expression_type")
    return rows.withColumns({
        "column_type": F.when(kind.isin("DIRECT", "DERIVED"), kind).otherwise("UNKNOWN"),
        "confidence_score": F.when(kind == "DIRECT", 1.0).when(kind == "DERIVED", 0.8).when(kind == "ERROR", 0.0).otherwise(0.5),
        "expression_type": F.when(expr.isin(rules.RESULT_EXPRESSION_TYPES), expr),
        "metadata": F.create_map(
            F.lit("analysis_method"), F.lit("expression_facts"),
            F.lit("original_expression_type"), F.coalesce("expression_type", F.lit(""))),
    })


def confidence_filter(results: DataFrame, threshold: float) -> DataFrame:
    return results.where(F.col("confidence_score") >= threshold)


def confidence_band(results: DataFrame) -> DataFrame:
    """Display band and percent text."""
    score = F.col("confidence_score")
    return results.withColumns({
        "band": F.when(score >= 0.8, "success").when(score >= 0.6, "warning").otherwise("error"),
        "percent": F.format_string("%.1f%%", score * 100),
    })


def results_page(results: DataFrame, order: list[str | Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """A slice of the results under a total order."""
    page = results.orderBy(*order).offset(offset)
    return page.limit(limit) if limit is not None else page


def results_query(lineage: DataFrame, job_id: int | str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Stored lineage, newest first, of one job when given, all of it or one page."""
    rows = lineage.where(F.col("job_id") == job_id) if job_id is not None else lineage
    ties = [c for c in lineage.columns if c not in ("created_at", "view_name", "view_column")]
    return results_page(rows, [F.desc("created_at"), "view_name", "view_column", *ties], limit, offset)


def results_total(lineage: DataFrame, job_id: int | str | None = None) -> DataFrame:
    rows = lineage.where(F.col("job_id") == job_id) if job_id is not None else lineage
    return rows.agg(F.count(F.lit(1)).alias("total_records"))


def lineage_by_view(lineage: DataFrame, view: str | None = None) -> DataFrame:
    """Rows of one view, in any case of its name, or all rows."""
    return lineage.where(F.upper("view_name") == view.upper()) if view else lineage


def results_search(lineage: DataFrame, query: str) -> DataFrame:
    """Rows with the query in any field, ignoring case; a blank query keeps all."""
    needle = query.strip().lower()
    hit = F.lit(not needle)
    for field in SEARCH_FIELDS:
        hit = hit | F.coalesce(F.lower(field).contains(needle), F.lit(False))
    return lineage.where(hit)


def summary_column_type(results: DataFrame) -> DataFrame:
    return results.groupBy("column_type").agg(F.count(F.lit(1)).alias("n"))


def summary_confidence(results: DataFrame) -> DataFrame:
    """Average, minimum and maximum score; 0 without rows."""
    stat = lambda f: F.round(F.coalesce(f("confidence_score"), F.lit(0.0)), 3)
    return results.agg(stat(F.avg).alias("average"), stat(F.min).alias("minimum"), stat(F.max).alias("maximum"))


def summary_top_sources(results: DataFrame, n: int = 10) -> DataFrame:
    """Source tables with the most rows; ties by name."""
    counts = results.groupBy("source_table").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "source_table").limit(n)


def summary_success(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Per job: share of views done and share of rows with a high score, in percent; 0 when empty."""
    scored = results.groupBy("job_id").agg(
        F.count_if(F.col("confidence_score") >= 0.8).alias("high"), F.count(F.lit(1)).alias("rows"))
    rate = lambda part, whole: F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)) * 100, F.lit(0.0))
    return jobs.join(scored, "job_id", "left").select(
        "job_id", rate("processed_views", "total_views").alias("view_success_rate"), rate("high", "rows").alias("high_confidence_rate"))


def analysis_summary(rows: DataFrame) -> DataFrame:
    """Views, columns, successes, errors and success rate of report rows."""
    failed = F.count_if(F.col("column_type").isin("ERROR", "UNKNOWN"))
    total = F.count(F.lit(1))
    return rows.agg(
        F.countDistinct("view_name").alias("total_views"), total.alias("total_columns"),
        (total - failed).alias("successful_columns"), failed.alias("error_columns"),
        F.coalesce(F.round((total - failed) / F.nullif(total, F.lit(0)) * 100, 1), F.lit(0.0)).alias("success_rate"))


# --- base-view registry --------------------------------------------------------------


def valid_base_view() -> Column:
    return (F.col("base_primary_id") > 0) & F.length("table_name").between(1, 255)


def base_view_insert(base: DataFrame, new: DataFrame) -> DataFrame:
    """The registry after inserts: invalid rows and taken ids are refused, the first insert of an id wins."""
    first = new.where(valid_base_view()).groupBy("base_primary_id").agg(F.min_by("table_name", "change_no").alias("table_name"))
    return base.unionByName(first.join(base, "base_primary_id", "left_anti"))


def base_view_conflicts(base: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of inserts that are taken already."""
    return new.where(valid_base_view()).join(base, "base_primary_id", "left_semi").select("base_primary_id").distinct()


def base_view_update(base: DataFrame, updates: DataFrame) -> DataFrame:
    """The registry after renames; the last one of an id wins."""
    last = updates.where(valid_base_view()).groupBy("base_primary_id").agg(F.max_by("table_name", "change_no").alias("new_name"))
    return base.join(last, "base_primary_id", "left").select(
        "base_primary_id", F.coalesce("new_name", "table_name").alias("table_name"))


def base_view_missing(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Ids of changes that are not in the registry."""
    return changes.select("base_primary_id").distinct().join(base, "base_primary_id", "left_anti")


def base_view_delete(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids, "base_primary_id", "left_anti")


def base_view_apply(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The registry after a change log: the latest valid change of an id wins, D removes it."""
    last = changes.where(valid_base_view()).groupBy("base_primary_id").agg(
        F.max_by(F.struct("op", F.col("table_name").alias("new_name")), "change_no").alias("c"))
    return base.join(last, "base_primary_id", "full_outer").where("c is null or c.op <> 'D'").select(
        "base_primary_id", F.coalesce("c.new_name", "table_name").alias("table_name"))
