"""Data-quality rules as data, checked in one aggregate pass per table."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """One rule. ``low``/``high`` are inclusive and may be open; NULLs pass all but ``not_null``."""

    kind: str  # not_null | unique | between | in_set | row_count
    column: str = ""
    low: float | None = None
    high: float | None = None
    values: tuple[Any, ...] = ()


def not_null(*columns: str) -> list[Check]:
    return [Check("not_null", c) for c in columns]


def unique(*columns: str) -> list[Check]:
    return [Check("unique", c) for c in columns]


def at_least(low: float, *columns: str) -> list[Check]:
    return [Check("between", c, low=low) for c in columns]


def row_count(low: int, high: int) -> list[Check]:
    return [Check("row_count", low=low, high=high)]


def in_set(column: str, values: tuple[Any, ...]) -> list[Check]:
    return [Check("in_set", column, values=values)]


def _failures(check: Check) -> Column:
    """Number of rows that break the rule; for a row count, the number of rows."""
    value = F.col(check.column) if check.column else None
    if check.kind == "row_count":
        return F.count(F.lit(1))
    if check.kind == "not_null":
        return F.count_if(value.isNull())
    if check.kind == "unique":
        return F.count(value) - F.countDistinct(value)
    if check.kind == "in_set":
        return F.count_if(~value.isin(*check.values))
    if check.kind == "between":
        broken = F.lit(False)
        if check.low is not None:
            broken = broken | (value < check.low)
        if check.high is not None:
            broken = broken | (value > check.high)
        return F.count_if(broken)
    raise ValueError(f"unknown check {check.kind}")


def run_suite(df: DataFrame, table: str, checks: list[Check]) -> DataFrame:
    """One row per check: observed count and whether it passed.

    All checks of a table share one scan. Duplicates are counted as rows beyond
    the first of their value.
    """
    counted = df.agg(*[_failures(c).alias(f"c{i}") for i, c in enumerate(checks)])
    rows = []
    for i, check in enumerate(checks):
        observed = F.col(f"c{i}")
        passed = observed.between(check.low, check.high) if check.kind == "row_count" else observed == 0
        rows.append(F.struct(
            F.lit(table).alias("table_name"), F.lit(check.kind).alias("check_name"),
            F.lit(check.column).alias("column_name"), observed.alias("observed"), passed.alias("success"),
        ))
    return counted.select(F.inline(F.array(*rows)))


def suite_report(results: DataFrame) -> DataFrame:
    """Per table: passed and total checks, and the failed ones with their counts."""
    failed = F.when(~F.col("success"), F.concat_ws(
        "", "check_name", F.lit("("), "column_name", F.lit("): "), F.col("observed").cast("string")
    ))
    return results.groupBy("table_name").agg(
        F.count_if("success").alias("passed"),
        F.count(F.lit(1)).alias("total"),
        F.concat_ws("; ", F.sort_array(F.collect_list(failed))).alias("failed_checks"),
    )


# The rules of the mart suites. Row counts and state sets describe
# one data set, so they are parameters.
def mart_suites(bounds: dict[str, tuple[int, int]], states: tuple[str, ...]) -> dict[str, list[Check]]:
    return {
        "fct_product_performance": [
            *row_count(*bounds["fct_product_performance"]),
            *not_null("product_id"), *unique("product_id"), *not_null("product_name"),
            *at_least(0, "total_revenue", "avg_unit_price"), *at_least(1, "total_units_sold", "revenue_rank"),
            *not_null("revenue_rank"),
        ],
        "fct_daily_demand": [
            *row_count(*bounds["fct_daily_demand"]), *not_null("sale_date", "store_id"),
            *at_least(0, "total_revenue", "total_units", "avg_price"), *in_set("state_id", states),
        ],
        "mart_executive_kpis": [
            *row_count(*bounds["mart_executive_kpis"]), *not_null("kpi_date"), *unique("kpi_date"),
            *at_least(0, "total_revenue"), *at_least(1, "total_orders", "unique_customers"),
            *at_least(0, "avg_basket_size"),
        ],
        "dim_stores": [
            *row_count(*bounds["dim_stores"]), *not_null("store_id"), *unique("store_id"),
            *in_set("state_id", states), *at_least(0, "total_revenue_all_time"),
        ],
    }


DEFAULT_BOUNDS = {
    "fct_product_performance": (3_000, 10_000),
    "fct_daily_demand": (100_000, 500_000),
    "mart_executive_kpis": (500, 2_000),
    "dim_stores": (10, 10),
}
DEFAULT_STATES = ("CA", "TX", "WI")

# Column rules of every layer's tables.
COLUMN_RULES = {
    "stg_sales": not_null("sale_id", "sale_date", "unit_sales", "store_id", "item_id"),
    "stg_interactions": not_null("order_id", "user_id", "product_id"),
    "stg_transactions": not_null("invoice_id", "customer_id", "revenue"),
    "stg_products": [*not_null("product_id"), *unique("product_id"), *not_null("product_name")],
    "int_daily_store_sales": not_null("sale_date", "store_id", "total_revenue", "total_units"),
    "int_user_product_interactions": not_null("user_id", "product_id", "interaction_score"),
    "int_customer_rfm": [
        *not_null("customer_id"), *unique("customer_id"),
        *not_null("recency_days", "frequency_score", "monetary_score"),
    ],
    "fct_daily_demand": not_null("sale_date", "store_id", "total_revenue"),
    "fct_product_performance": [*not_null("product_id"), *unique("product_id"), *not_null("total_revenue")],
    "dim_stores": [*not_null("store_id"), *unique("store_id")],
    "mart_executive_kpis": [*not_null("kpi_date"), *unique("kpi_date"), *not_null("total_revenue")],
    "mart_recsys_interactions": not_null("user_id", "product_id"),
}


def dense_series_report(series: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Per series: length, whether its dates step by one day, and its lowest value.

    Distinct dates that are as many as the days from first to last leave no gap,
    so no ordering is needed.
    """
    day = F.to_date(date)
    return series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        ((F.countDistinct(day) == F.count(F.lit(1))) & (F.datediff(F.max(day), F.min(day)) + 1 == F.count(F.lit(1))))
        .alias("consecutive"),
        (F.min(value) >= 0).alias("non_negative"),
    )


def share_between(df: DataFrame, flag: Column, low: float, high: float) -> DataFrame:
    """Share of rows with the flag and whether it lies strictly inside the band."""
    return df.agg(F.avg(flag.cast("double")).alias("share")).withColumn(
        "success", (F.col("share") > low) & (F.col("share") < high)
    )
