"""Schemas, layered materialisation, append-only logs and load audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = ("raw", "staging", "intermediate", "mart")
SEVERITIES = ("low", "medium", "high", "critical")


def create_schemas(spark: SparkSession, names: tuple[str, ...] = SCHEMAS) -> list[str]:
    for name in names:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")
    return [d.name for d in spark.catalog.listDatabases()]


def materialise(df: DataFrame, layer: str, name: str, path: str | None = None) -> DataFrame:
    """Staging becomes a view, every other layer a table that replaces its predecessor.

    With a path the table's files lie there, else in the catalog's own folder.
    """
    if layer == "staging":
        df.createOrReplaceTempView(name)
        return df.sparkSession.table(name)
    writer = df.write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(f"{layer}.{name}")
    return df.sparkSession.table(f"{layer}.{name}")


def write_sorted(df: DataFrame, path: str, *order: str) -> None:
    """Parquet whose files follow the order from first to last (a total sort on write)."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def load_audit(frames: dict[str, DataFrame]) -> DataFrame:
    """Number of rows per loaded table."""
    audit = None
    for name, df in frames.items():
        row = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        audit = row if audit is None else audit.unionByName(row)
    return audit


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append alerts (severity, title, message, recommended_action) with id and time filled in."""
    valid = F.col("severity").isin(*SEVERITIES)
    checked = F.when(valid, F.col("severity")).otherwise(F.raise_error(F.lit("unknown severity")))
    alerts.select(
        F.uuid().alias("alert_id"), F.current_timestamp().alias("created_at"), checked.alias("severity"), "title", "message",
        "recommended_action",
    ).write.mode("append").parquet(path)


def append_reports(reports: DataFrame, path: str) -> None:
    reports.select(
        F.uuid().alias("report_id"), F.current_timestamp().alias("created_at"), "report"
    ).write.mode("append").parquet(path)


def append_impressions(impressions: DataFrame, path: str) -> None:
    """Append served impressions; outcome counters start at 0."""
    impressions.select(
        F.current_timestamp().alias("logged_at"), F.col("user_id").cast("bigint").alias("user_id"), "variant",
        F.col("items_shown").cast("int").alias("items_shown"), F.lit(0).alias("clicked"), F.lit(0).alias("converted"),
    ).write.mode("append").parquet(path)


def recent_reports(reports: DataFrame, limit: int = 10) -> DataFrame:
    from martspark.plans.analytics import latest_rows, within

    within(limit, 1, 100, "limit")
    return latest_rows(reports, "created_at", limit, "report_id").select(
        "report_id", F.col("created_at").cast("string").alias("created_at"), "report"
    )


def tables_like(spark: SparkSession, schema: str, part: str) -> list[str]:
    """Tables of a schema whose name holds ``part``; a session's temporary views belong to no schema."""
    return [t.name for t in spark.catalog.listTables(schema) if part in t.name and not t.isTemporary]


def table_state(spark: SparkSession, name: str, columns: list[str]) -> dict[str, bool]:
    """Whether a table exists, has the columns and holds a row."""
    if not spark.catalog.tableExists(name):
        return {"exists": False, "columns": False, "has_rows": False}
    table = spark.table(name)
    return {
        "exists": True,
        "columns": set(columns) <= set(table.columns),
        "has_rows": len(table.select(F.lit(1)).take(1)) == 1,
    }
