"""Parameterised questions over the marts.

Parameters are typed Python values that become literals of the plan; no SQL text
is put together. The latest date is a scalar subquery, evaluated once per query.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martspark.functions.numeric import stable_round

# Look-back of each window name, in days.
WINDOW_DAYS = {"1h": 1, "4h": 1, "24h": 1, "7d": 7}
ALL = "all"


class KpiAnswer(NamedTuple):
    summary: DataFrame
    top_departments: DataFrame
    bottom_departments: DataFrame


class ForecastAnswer(NamedTuple):
    deviations: DataFrame
    summary: DataFrame


class WeeklyAnswer(NamedTuple):
    summary: DataFrame
    top_products: DataFrame
    latest_report: DataFrame | None


def matching(df: DataFrame, column: str, value: str) -> DataFrame:
    """Filter on a value unless it is ``all``."""
    return df if value == ALL else df.filter(F.col(column) == value)


def within(value: int, low: int, high: int, what: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{what} must lie between {low} and {high}")
    return value


def _latest(df: DataFrame, column: str) -> Column:
    return df.agg(F.max(column)).scalar()


def query_kpis(demand: DataFrame, time_window: str, store_id: str = ALL, category: str = ALL) -> KpiAnswer:
    """Totals of the trailing days and the five best and worst departments.

    The lower bound is inclusive, so "7d" covers eight dates; the three shorter
    windows all mean one day. The category narrows the summary only.
    """
    days = WINDOW_DAYS.get(time_window, 1)
    recent = matching(demand.filter(F.col("sale_date") >= F.date_sub(_latest(demand, "sale_date"), days)), "store_id", store_id)
    summary = matching(recent, "dept_id", category).agg(
        F.sum("total_revenue").alias("total_revenue"),
        F.sum("total_units").alias("total_units"),
        F.avg("avg_price").alias("avg_price"),
        F.countDistinct("store_id").alias("active_stores"),
        F.max("sale_date").alias("latest_date"),
    )
    revenue = recent.groupBy("dept_id").agg(F.sum("total_revenue").alias("revenue"))
    return KpiAnswer(
        summary,
        revenue.orderBy(F.desc_nulls_last("revenue"), "dept_id").limit(5),
        revenue.orderBy(F.asc_nulls_last("revenue"), "dept_id").limit(5),
    )


def forecast_vs_actual(demand: DataFrame, date: str | None = None, store_id: str = ALL, top_n: int = 10) -> ForecastAnswer:
    """Largest relative deviations from the 28-row baseline on one date (default: the latest).

    The mean covers the returned rows only.
    """
    day = F.to_date(F.lit(date)) if date else _latest(demand, "sale_date")
    baseline = F.col("units_28d_avg")
    rows = matching(demand.filter(F.col("sale_date") == day), "store_id", store_id).select(
        "store_id", "dept_id", "cat_id", "sale_date",
        F.col("total_units").alias("actual_units"),
        F.col("total_revenue").alias("actual_revenue"),
        baseline.alias("forecast_proxy"),
        F.when(baseline > 0, F.abs(F.col("total_units") - baseline) / F.nullif(baseline, F.lit(0.0)) * 100).alias("mape_pct"),
    )
    deviations = rows.orderBy(F.desc_nulls_last("mape_pct"), "store_id", "dept_id", "cat_id").limit(top_n)
    summary = deviations.agg(
        F.count(F.lit(1)).alias("returned_rows"), stable_round(F.avg("mape_pct"), 2).alias("avg_ape_of_returned")
    )
    return ForecastAnswer(deviations, summary)


def latest_per_department(demand: DataFrame) -> DataFrame:
    """Newest row of each store and department (category breaks ties).

    ``max_by`` combines on the map side, so no group is gathered or sorted.
    """
    newest = F.max_by(
        F.struct("sale_date", "cat_id", "total_units", "units_28d_avg"), F.struct("sale_date", "cat_id")
    )
    return demand.groupBy("store_id", "dept_id").agg(newest.alias("r")).select("store_id", "dept_id", "r.*")


def lowest_stock(demand: DataFrame, n: int = 20, threshold_days: float = 2.0) -> DataFrame:
    """Per store the ``n`` departments whose latest units are lowest against their baseline.

    There is one row per store and department before the ranking.
    """
    stock = F.when(F.col("units_28d_avg") > 0, F.col("total_units") / F.nullif(F.col("units_28d_avg"), F.lit(0.0)))
    rows = latest_per_department(demand).withColumn("days_of_stock_proxy", stock).filter(
        F.col("days_of_stock_proxy") < threshold_days)
    place = F.row_number().over(Window.partitionBy("store_id").orderBy("days_of_stock_proxy", "dept_id"))
    return rows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def inventory_status(demand: DataFrame, store_id: str = ALL, threshold_days: float = 2.0) -> DataFrame:
    """The 20 departments whose latest units are lowest against their baseline."""
    stock = F.when(F.col("units_28d_avg") > 0, F.col("total_units") / F.nullif(F.col("units_28d_avg"), F.lit(0.0)))
    return (
        latest_per_department(matching(demand, "store_id", store_id))
        .withColumn("days_of_stock_proxy", stock)
        .filter(F.col("days_of_stock_proxy") < threshold_days)
        .orderBy("days_of_stock_proxy", "store_id", "dept_id")
        .limit(20)
        .select("store_id", "dept_id", "sale_date", "total_units", "units_28d_avg", "days_of_stock_proxy")
    )


def top_products(performance: DataFrame, n: int = 10) -> DataFrame:
    return performance.orderBy("revenue_rank", "product_id").limit(n).select(
        "product_name", "total_revenue", "total_units_sold", "revenue_rank"
    )


def latest_rows(df: DataFrame, time_column: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(time_column), *ties).limit(n)


def weekly_totals(kpis: DataFrame) -> DataFrame:
    """This week against the week before, in one pass with conditional sums.

    The prior week's totals are counted once; joined to every row of this week
    they would be multiplied by its number of days.
    """
    latest = kpis.agg(F.max("kpi_date").alias("latest"))
    recent = kpis.withColumn("_start", F.date_sub(latest.scalar(), 7)).filter(
        F.col("kpi_date") >= F.date_sub("_start", 7)
    )
    current = F.col("kpi_date") >= F.col("_start")
    this = lambda c: F.when(current, F.col(c))
    last = lambda c: F.when(~current, F.col(c))
    return recent.agg(
        stable_round(F.sum(this("total_revenue")), 2).alias("revenue_this_week"),
        stable_round(F.sum(last("total_revenue")), 2).alias("revenue_last_week"),
        F.sum(this("total_orders")).alias("orders_this_week"),
        F.sum(last("total_orders")).alias("orders_last_week"),
        F.sum(this("unique_customers")).alias("customers_this_week"),
        stable_round(F.avg(this("avg_basket_size")), 2).alias("avg_basket_size"),
        F.count_if(current & F.col("is_revenue_spike")).alias("spike_days"),
    )


def weekly_summary(kpis: DataFrame, performance: DataFrame, reports: DataFrame | None = None) -> WeeklyAnswer:
    latest = None if reports is None else latest_rows(reports, "created_at", 1, "report_id").select("report", "created_at")
    return WeeklyAnswer(weekly_totals(kpis), top_products(performance), latest)


def weekly_payload(answer: WeeklyAnswer) -> DataFrame:
    """The weekly answer as one JSON document (one row of totals, at most ten products)."""
    products = answer.top_products.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("revenue_rank", "product_name", "total_revenue", "total_units_sold"))),
            lambda p: F.struct(
                p["product_name"].alias("product_name"), p["total_revenue"].alias("total_revenue"),
                p["total_units_sold"].alias("total_units_sold"), p["revenue_rank"].alias("revenue_rank"),
            ),
        )
    )
    report = F.lit(None).cast("string")
    if answer.latest_report is not None:
        report = answer.latest_report.agg(F.max("report")).scalar()
    fields = [F.col(c) for c in answer.summary.columns]
    document = F.struct(
        *fields, products.scalar().alias("top_products"),
        F.coalesce(report, F.lit("No report yet.")).alias("latest_agent_report"),
    )
    return answer.summary.select(F.to_json(document).alias("payload"))


def recent_kpis(kpis: DataFrame, days: int = 7) -> DataFrame:
    """The last ``days`` KPI rows, newest first, with the date as text."""
    within(days, 1, 90, "days")
    return latest_rows(kpis, "kpi_date", days).select(
        F.col("kpi_date").cast("string").alias("kpi_date"), "total_orders", "unique_customers", "total_units",
        "total_revenue", "avg_basket_size", "revenue_wow_pct", "is_revenue_spike",
    )


def day_over_day(kpis: DataFrame) -> DataFrame:
    """Latest day with its change in percent against the day before (two rows are kept)."""
    by_day = Window.orderBy("kpi_date")
    measures = ["total_revenue", "total_orders", "unique_customers", "avg_basket_size"]
    last_two = latest_rows(kpis, "kpi_date", 2)
    before = {m: F.lag(m, 1).over(by_day) for m in measures}
    change = lambda m: (F.col(m) - before[m]) / F.nullif(before[m].cast("double"), F.lit(0.0)) * 100
    return (
        last_two.select("kpi_date", *measures, *[change(m).alias(f"{m}_delta_pct") for m in measures])
        .orderBy(F.desc("kpi_date"))
        .limit(1)
    )


def last_order_counts(kpis: DataFrame, rows: int = 14) -> DataFrame:
    return latest_rows(kpis, "kpi_date", rows).select("kpi_date", "total_orders").orderBy("kpi_date")


def spike_days(kpis: DataFrame) -> DataFrame:
    return kpis.filter(F.col("is_revenue_spike")).select("kpi_date", "total_revenue")


def revenue_by_country(transactions: DataFrame, n: int = 10) -> DataFrame:
    return (
        transactions.groupBy("country").agg(F.sum("revenue").alias("revenue"))
        .orderBy(F.desc_nulls_last("revenue"), "country").limit(n)
    )


def ab_test_results(log: DataFrame) -> DataFrame:
    """Impressions, clicks and conversions per variant; an empty log gives no rows."""
    return log.groupBy("variant").agg(
        F.count(F.lit(1)).alias("impressions"),
        F.avg("items_shown").alias("avg_items_shown"),
        F.sum("clicked").alias("total_clicks"),
        F.sum("converted").alias("total_conversions"),
    )
