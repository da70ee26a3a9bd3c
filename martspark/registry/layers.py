"""Staging, intermediate and mart tables."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import functions as F

from martspark.plans import intermediate, marts, staging
from martspark.plans.build import build
from martspark.registry.base import (
    CATALOG, DAILY_SALES, DEMAND, INTERACTIONS, KPIS, PAIRS, SALES, TX, iso, iso_time, query, r, rounded,
)
from martspark.session import tasks_for, working_path, written
from martspark.sources import cleaning, tables
from martspark.sources.readers import stacked
from martspark.sources.tables import Tables


def staged_transactions(t: Tables, *dimensions: str):
    return staging.transactions(tables.transactions(t, dimensions))


def staged_sales(t: Tables):
    return staging.sales(tables.sales(t))


def cleaned_interactions(t: Tables):
    lines = stacked(tables.order_lines(t, "O"), tables.order_lines(t, "F"))
    return cleaning.clean_interactions(
        tables.order_headers(t), lines, tables.catalog_products(t), tables.aisles(t), tables.departments(t),
        tasks=tasks_for(t.spark, t("lineitem").count()),
    )


def staged_interactions(t: Tables):
    return staging.interactions(cleaned_interactions(t))


def demand(t: Tables):
    # The frames read the daily sales twice; written once, the order lines are read once.
    return marts.daily_demand(written(intermediate.daily_store_sales(staged_sales(t)), "daily-sales"))


def kpis(t: Tables):
    return marts.executive_kpis(staged_transactions(t))


def pairs(t: Tables):
    return intermediate.user_product_interactions(staged_interactions(t))


def performance(t: Tables):
    return marts.product_performance(staged_transactions(t, "description"))


@lru_cache(maxsize=8)
def _built(spark, folder, state):
    return build(Tables(spark, folder), working_path(spark, "warehouse"), f"_{hashlib.sha256(f'{folder} {state}'.encode()).hexdigest()[:16]}")


def built(t: Tables):
    """The warehouse of a folder, built once per session and state of the folder's files."""
    return _built(t.spark, t.folder, t.state())


def mart(t: Tables, name: str):
    """A mart table as the build wrote it; questions read these."""
    return built(t).table("mart", name)


# --------------------------------------------------------------------- staging


@query("p01_stg_sales", f"""WITH {SALES}
SELECT sale_id, item_id, dept_id, cat_id, store_id, state_id, {iso('sale_date')} AS sale_date,
       CAST(unit_sales AS BIGINT) AS unit_sales, {r('sell_price', 4)} AS sell_price, revenue,
       year(sale_date) AS sale_year, month(sale_date) AS sale_month,
       CAST(extract('dow' FROM sale_date) AS BIGINT) AS day_of_week, CAST(has_sales AS BIGINT) AS has_sales
FROM sales""")
def _(t):
    return rounded(staged_sales(t), sell_price=4)


@query("p02_stg_transactions", f"""WITH {TX}
SELECT invoice_id, product_id, product_name, CAST(quantity AS BIGINT) AS quantity,
       {iso_time('invoice_ts')} AS invoice_ts, {iso('invoice_date')} AS invoice_date,
       {r('unit_price', 4)} AS unit_price, customer_id, country, revenue, year(invoice_ts) AS tx_year,
       month(invoice_ts) AS tx_month, hour(invoice_ts) AS tx_hour,
       CAST(extract('dow' FROM invoice_ts) AS BIGINT) AS tx_dow
FROM tx""")
def _(t):
    return rounded(staged_transactions(t, "country", "description"), unit_price=4)


@query("p03_stg_interactions", f"""WITH {INTERACTIONS}
SELECT order_id, user_id, product_id, product_name, aisle, department,
       CAST(add_to_cart_order AS BIGINT) AS cart_position, reordered = 1 AS is_reorder, order_number, order_dow,
       order_hour_of_day AS order_hour, CAST(days_since_prior_order AS DOUBLE) AS days_since_prior_order
FROM inter""")
def _(t):
    return staged_interactions(t)


CATALOG_ORACLE = f"""WITH {CATALOG}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY product_name, 'dp/' || p_partkey) - 1 AS position FROM priced)
SELECT printf('AMZN_%06d', position) AS product_id, product_name, category AS main_category, sub_category,
       avg_rating AS rating, rating_count, sale_price AS discount_price, list_price AS actual_price, discount_pct,
       CASE WHEN avg_rating >= 4.5 THEN 'excellent' WHEN avg_rating >= 4.0 THEN 'good'
            WHEN avg_rating >= 3.0 THEN 'average' ELSE 'poor' END AS rating_tier,
       CASE WHEN discount_pct >= 50 THEN 'high_discount' WHEN discount_pct >= 20 THEN 'medium_discount'
            WHEN discount_pct > 0 THEN 'low_discount' ELSE 'no_discount' END AS discount_tier
FROM numbered"""


@query("p04_stg_products", CATALOG_ORACLE)
def _(t):
    """Catalog from price text to tiers: P4 to P6, P16 and P18 to P21 in one job."""
    return staging.products(cleaning.clean_catalog(tables.raw_catalog(t)))


# ---------------------------------------------------------------- intermediate


@query("a01_daily_store_sales", f"""WITH {DAILY_SALES}
SELECT {iso('sale_date')} AS sale_date, store_id, state_id, dept_id, cat_id, unique_items_sold,
       CAST(total_units AS BIGINT) AS total_units, {r('total_revenue', 2)} AS total_revenue,
       {r('avg_price', 4)} AS avg_price, CAST(items_with_sales AS BIGINT) AS items_with_sales, total_rows
FROM daily""")
def _(t):
    return rounded(intermediate.daily_store_sales(staged_sales(t)), total_revenue=2, avg_price=4)


@query("a03_customer_rfm", f"""WITH {TX}, base AS (
  SELECT customer_id, max(country) AS country, max(invoice_date) AS last_purchase_date,
         count(DISTINCT invoice_id) AS frequency, sum(revenue) AS monetary_value,
         count(DISTINCT invoice_date) AS active_days FROM tx GROUP BY 1)
SELECT customer_id, country, {iso('last_purchase_date')} AS last_purchase_date, frequency,
       {r('monetary_value', 2)} AS monetary_value, active_days,
       CAST(datediff('day', last_purchase_date, (SELECT max(invoice_date) FROM tx)) AS BIGINT) AS recency_days,
       CAST(CASE WHEN frequency >= 20 THEN 5 WHEN frequency >= 10 THEN 4 WHEN frequency >= 5 THEN 3
            WHEN frequency >= 2 THEN 2 ELSE 1 END AS BIGINT) AS frequency_score,
       CAST(CASE WHEN monetary_value >= 4000000 THEN 5 WHEN monetary_value >= 2500000 THEN 4
            WHEN monetary_value >= 1500000 THEN 3 WHEN monetary_value >= 500000 THEN 2 ELSE 1 END AS BIGINT)
         AS monetary_score
FROM base""")
def _(t):
    """A2 and A3; the money steps are scaled to the test data's amounts."""
    steps = [(4_000_000, 5), (2_500_000, 4), (1_500_000, 3), (500_000, 2)]
    return rounded(
        intermediate.customer_rfm(staged_transactions(t, "country"), monetary_steps=steps), monetary_value=2
    )


@query("a04_user_product_interactions", f"""WITH {PAIRS}
SELECT user_id, product_id, product_name, department, aisle, total_orders, reorder_count, first_order_number,
       last_order_number, {r('avg_cart_position', 4)} AS avg_cart_position,
       {r('interaction_score', 6)} AS interaction_score
FROM pairs""")
def _(t):
    return rounded(pairs(t), avg_cart_position=4, interaction_score=6)


# ----------------------------------------------------------------------- marts


@query("w01_daily_demand", f"""WITH {DEMAND}
SELECT {iso('sale_date')} AS sale_date, store_id, state_id, dept_id, cat_id,
       CAST(total_units AS BIGINT) AS total_units, {r('total_revenue', 2)} AS total_revenue,
       {r('avg_price', 4)} AS avg_price, unique_items_sold, {r('revenue_28d_avg', 2)} AS revenue_28d_avg,
       {r('units_28d_avg', 4)} AS units_28d_avg, is_revenue_spike
FROM demand""")
def _(t):
    """Store baselines over the 28 rows before, and the spike flag."""
    return rounded(demand(t), total_revenue=2, avg_price=4, revenue_28d_avg=2, units_28d_avg=4)


@query("w01_store_day_baseline", f"""WITH {DAILY_SALES}, sd AS (
  SELECT store_id, sale_date, sum(total_revenue) AS total_revenue, sum(total_units) AS total_units
  FROM daily GROUP BY 1, 2), b AS (
  SELECT *, avg(total_revenue) OVER w AS revenue_28d_avg, avg(total_units) OVER w AS units_28d_avg FROM sd
  WINDOW w AS (PARTITION BY store_id ORDER BY sale_date
               RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT store_id, {iso('sale_date')} AS sale_date, {r('total_revenue', 2)} AS total_revenue,
       CAST(total_units AS BIGINT) AS total_units, {r('revenue_28d_avg', 2)} AS revenue_28d_avg,
       {r('units_28d_avg', 4)} AS units_28d_avg,
       coalesce(revenue_28d_avg > 0 AND total_revenue > 2.0 * revenue_28d_avg, false) AS is_revenue_spike
FROM b""")
def _(t):
    daily = intermediate.daily_store_sales(staged_sales(t))
    return rounded(marts.store_day_baseline(daily), total_revenue=2, revenue_28d_avg=2, units_28d_avg=4)


PERFORMANCE = TX + """, totals AS (
  SELECT product_id, max(product_name) AS product_name, count(DISTINCT customer_id) AS unique_customers,
         count(DISTINCT invoice_id) AS total_invoices, sum(quantity) AS total_units_sold,
         sum(revenue) AS total_revenue, avg(unit_price) AS avg_unit_price,
         count(DISTINCT invoice_date) AS active_selling_days, min(invoice_date) AS first_sale_date,
         max(invoice_date) AS last_sale_date
  FROM tx GROUP BY 1), perf AS (
  SELECT *, rank() OVER (ORDER BY round(total_revenue, 4) DESC) AS revenue_rank,
         rank() OVER (ORDER BY total_units_sold DESC) AS volume_rank,
         total_revenue / nullif(active_selling_days, 0) AS revenue_per_day FROM totals)"""


@query("w08_product_performance", f"""WITH {PERFORMANCE}
SELECT product_id, product_name, unique_customers, total_invoices,
       CAST(total_units_sold AS BIGINT) AS total_units_sold, {r('total_revenue', 2)} AS total_revenue,
       {r('avg_unit_price', 4)} AS avg_unit_price, active_selling_days,
       {iso('first_sale_date')} AS first_sale_date, {iso('last_sale_date')} AS last_sale_date, revenue_rank,
       volume_rank, {r('revenue_per_day', 2)} AS revenue_per_day
FROM perf""")
def _(t):
    """Product totals with global ranks."""
    return rounded(performance(t), total_revenue=2, avg_unit_price=4, revenue_per_day=2)


@query("a09_store_dimension", f"""WITH {DAILY_SALES}
SELECT store_id, s.state_id, split_part(store_id, '_', 1) AS state_code,
       CAST(split_part(store_id, '_', 2) AS BIGINT) AS store_number,
       {r('sum(total_revenue)', 2)} AS total_revenue_all_time,
       CAST(sum(total_units) AS BIGINT) AS total_units_all_time, count(DISTINCT sale_date) AS active_days,
       {iso('min(sale_date)')} AS first_sale_date, {iso('max(sale_date)')} AS last_sale_date
FROM (SELECT DISTINCT store_id, state_id FROM sales) s LEFT JOIN daily USING (store_id) GROUP BY 1, 2, 3, 4""")
def _(t):
    """Distinct stores joined to their all-time metrics."""
    sales = staged_sales(t)
    stores = marts.store_dimension(sales, intermediate.daily_store_sales(sales))
    return rounded(stores, total_revenue_all_time=2)


@query("a08_executive_kpis", f"WITH {KPIS} SELECT * REPLACE ({iso('kpi_date')} AS kpi_date) FROM kpis")
def _(t):
    """The flagship daily KPI table."""
    return kpis(t)


@query("p25_recommender_interactions", f"""WITH {PAIRS}
SELECT user_id, product_id, product_name, department, aisle, total_orders, reorder_count,
       {r('interaction_score', 6)} AS interaction_score FROM pairs WHERE interaction_score > 0""")
def _(t):
    return rounded(marts.recommender_interactions(pairs(t)), interaction_score=6)
