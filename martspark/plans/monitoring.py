"""Rule-based monitoring: KPIs, forecast deviations and stock to alerts and a report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martspark.functions.numeric import stable_round
from martspark.operators.catalog import search
from martspark.plans import analytics
from martspark.sources.warehouse import append_alerts, append_reports

DEVIATION_LIMIT_PCT, STOCK_LIMIT = 200.0, 0.5


class MonitoringRun(NamedTuple):
    alerts: DataFrame
    report: DataFrame
    related: DataFrame | None


def monitoring_report(
    demand: DataFrame,
    stores: tuple[str, ...] | None = ("CA_1", "TX_1"),
    index: DataFrame | None = None,
    questions=None,
    deviation_limit: float = DEVIATION_LIMIT_PCT,
    stock_limit: float = STOCK_LIMIT,
) -> MonitoringRun:
    """One monitoring run over the demand mart.

    All inputs of the report are bounded answers: one summary row, ten
    deviations and at most twenty stock rows per store (``stores=None``: every store of
    the mart). With a document index
    and an encoder for ``questions`` the titles are looked up in the catalog.
    """
    kpi = analytics.query_kpis(demand, "7d")
    forecast = analytics.forecast_vs_actual(demand)
    stock = analytics.lowest_stock(demand if stores is None else demand.filter(F.col("store_id").isin(*stores)))

    deviating = forecast.deviations.filter(F.col("mape_pct") > deviation_limit).select(
        F.lit("high").alias("severity"),
        F.concat_ws(" ", F.lit("Demand deviates in"), "store_id", "dept_id", "cat_id").alias("title"),
        F.format_string("%d units against a baseline of %.1f", F.col("actual_units"), stable_round(F.col("forecast_proxy"), 1)).alias("message"),
        F.lit("Check promotions and data feeds of the department.").alias("recommended_action"),
    )
    low_stock = stock.filter(F.col("days_of_stock_proxy") < stock_limit).select(
        F.lit("medium").alias("severity"),
        F.concat_ws(" ", F.lit("Low sales against baseline in"), "store_id", "dept_id").alias("title"),
        F.format_string("ratio %.2f", stable_round(F.col("days_of_stock_proxy"), 2)).alias("message"),
        F.lit("Review stock on hand.").alias("recommended_action"),
    )
    alerts = deviating.unionByName(low_stock)
    counts = alerts.agg(F.count(F.lit(1)))
    summary = kpi.summary.withColumn("_f", forecast.summary.select(F.struct("*")).scalar())
    report = summary.select(F.concat_ws(
        "\n",
        F.format_string("Period up to %s, %d stores", F.col("latest_date").cast("string"), "active_stores"),
        F.format_string("Revenue %.2f, units %d", "total_revenue", "total_units"),
        F.format_string("Mean deviation of the largest %d: %.2f%%", F.col("_f.returned_rows"), F.col("_f.avg_ape_of_returned")),
        F.format_string("Alerts raised: %d", counts.scalar()),
    ).alias("report"))
    related = None
    if index is not None and questions is not None:
        asked = alerts.select(F.col("title").alias("query_id"), F.col("title").alias("text"))
        related = search(questions(asked, "text"), index)
    return MonitoringRun(alerts, report, related)


def record(run: MonitoringRun, alerts_path: str, reports_path: str) -> None:
    append_alerts(run.alerts, alerts_path)
    append_reports(run.report, reports_path)
