"""Sinks: tables, CSV and JSON. Each is one distributed write; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty strings as null in every string column."""
    return df.select(*[
        F.nullif(F.col(n), F.lit("")).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes])


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def lineage_save(results: DataFrame, path: str, at: str) -> None:
    """Lineage table with audit timestamps."""
    stamp = F.lit(at).cast("timestamp_ntz")
    required = ["view_name", "view_column", "column_type", "source_table", "source_column"]
    rows = results.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in required], "expression_type",
        *[c for c in results.columns if c == "job_id"],
        stamp.alias("analysis_timestamp"), stamp.alias("created_at"))
    save_table(rows, path)


def mapping_save(mapping: DataFrame, path: str, at: str) -> None:
    """Action mapping with blanks as null and audit timestamps."""
    stamp = F.lit(at).cast("timestamp_ntz")
    save_table(blank_to_null(mapping).withColumns({"analysis_timestamp": stamp, "created_at": stamp}), path)


def sp_save(relations: DataFrame, path: str, at: str) -> None:
    """Procedure usage with audit timestamps."""
    stamp = F.lit(at).cast("timestamp_ntz")
    save_table(blank_to_null(relations).withColumns({"analysis_timestamp": stamp, "created_at": stamp}), path)


CSV_NAMES = {
    "view_name": "View_Name", "view_column": "View_Column", "column_type": "Column_Type", "source_table": "Source_Table",
    "source_column": "Source_Column", "expression_type": "Expression_Type", "confidence_score": "Confidence_Score",
}


def lineage_csv(results: DataFrame, include_metadata: bool = False) -> DataFrame:
    """Export columns of lineage results; a missing expression type is empty."""
    columns = [
        (F.coalesce(F.col(c), F.lit("")) if c == "expression_type" else F.col(c)).alias(name) for c, name in CSV_NAMES.items()]
    return results.select(*columns, *([F.to_json("metadata").alias("Metadata")] if include_metadata else []))


def lineage_export_csv(results: DataFrame, path: str, include_metadata: bool = False) -> None:
    lineage_csv(results, include_metadata).write.mode("overwrite").option("header", True).csv(path)


def lineage_json(results: DataFrame, include_metadata: bool = True) -> DataFrame:
    return results if include_metadata else results.drop("metadata")


def lineage_export_json(results: DataFrame, path: str, include_metadata: bool = True) -> None:
    lineage_json(results, include_metadata).write.mode("overwrite").option("ignoreNullFields", False).json(path)


MAPPING_COLUMNS = [
    "frontend_file", "frontend_function", "http_method", "frontend_url", "backend_file", "backend_function",
    "backend_route", "database_tables", "stored_procedures", "flow_calls", "response_model", "response_fields",
    "nested_fields", "table_column_details",
]


def mapping_json(mapping: DataFrame) -> DataFrame:
    """One JSON text per call: frontend part, backend part or null."""
    frontend = F.struct(
        F.col("frontend_file").alias("file"), F.col("frontend_function").alias("function"),
        F.col("http_method").alias("method"), F.col("frontend_url").alias("url"))
    backend = F.when(F.col("backend_function") != "", F.struct(
        F.col("backend_file").alias("file"), F.col("backend_function").alias("function"), F.col("backend_route").alias("route"),
        F.filter(F.split("database_tables", ";"), lambda t: t != "").alias("tables"), F.col("response_model")))
    return mapping.select(F.to_json(F.struct(frontend.alias("frontend"), backend.alias("backend")), {"ignoreNullFields": "false"}).alias("value"))


def mapping_export_json(mapping: DataFrame, path: str) -> None:
    mapping_json(mapping).write.mode("overwrite").text(path)


def mapping_export_csv(mapping: DataFrame, path: str) -> None:
    """Flat 14-column report."""
    mapping.select(*MAPPING_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


SP_COLUMNS = ["sp_name", "sp_schema", "sp_language", "table_name", "column_name", "relationship_types"]


def sp_csv(relations: DataFrame) -> DataFrame:
    return relations.select(*[F.upper(c).alias(c.upper()) for c in SP_COLUMNS])


def sp_export_csv(relations: DataFrame, path: str, append: bool = False) -> None:
    sp_csv(relations).write.mode("append" if append else "overwrite").option("header", True).csv(path)
