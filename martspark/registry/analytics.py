"""Parameterised questions, log reports and service metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from martspark.functions.routing import experiment_bucket, experiment_variant
from martspark.plans import analytics, opsmetrics
from martspark.registry.base import DEMAND, KPIS, TX, iso, iso_time, query, r, rounded
from martspark.registry.layers import PERFORMANCE, mart, staged_transactions
from martspark.sources import tables

LATEST = "(SELECT max(sale_date) FROM demand)"
RECENT = "sale_date >= CAST((SELECT max(sale_date) FROM demand) - INTERVAL 7 DAYS AS DATE)"


@query("q01_kpi_summary", f"""WITH {DEMAND}
SELECT {r('sum(total_revenue)', 2)} AS total_revenue, CAST(sum(total_units) AS BIGINT) AS total_units,
       {r('avg(avg_price)', 4)} AS avg_price, count(DISTINCT store_id) AS active_stores,
       {iso('max(sale_date)')} AS latest_date FROM demand WHERE {RECENT} AND dept_id = 'Brand#12'""")
def _(t):
    answer = analytics.query_kpis(mart(t, "daily_demand"), "7d", category="Brand#12")
    return rounded(answer.summary, total_revenue=2, avg_price=4)


for _order, _name in (("DESC", "top"), ("ASC", "bottom")):

    @query(f"q01_{_name}_departments", f"""WITH {DEMAND}
SELECT dept_id, {r('sum(total_revenue)', 2)} AS revenue FROM demand WHERE {RECENT}
GROUP BY 1 ORDER BY sum(total_revenue) {_order}, 1 LIMIT 5""")
    def _(t, which=f"{_name}_departments"):
        """Five best or worst departments of the trailing week."""
        return rounded(getattr(analytics.query_kpis(mart(t, "daily_demand"), "7d"), which), revenue=2)


@query("q01_store_summary", f"""WITH {DEMAND}
SELECT {r('sum(total_revenue)', 2)} AS total_revenue, CAST(sum(total_units) AS BIGINT) AS total_units,
       {r('avg(avg_price)', 4)} AS avg_price, count(DISTINCT store_id) AS active_stores,
       {iso('max(sale_date)')} AS latest_date
FROM demand WHERE sale_date >= CAST({LATEST} - INTERVAL 1 DAY AS DATE) AND store_id = 'AF_0'""")
def _(t):
    """Every short window means one day."""
    return rounded(analytics.query_kpis(mart(t, "daily_demand"), "4h", "AF_0").summary, total_revenue=2, avg_price=4)


DEVIATIONS = DEMAND + f""", dev AS (
  SELECT store_id, dept_id, cat_id, sale_date, total_units, total_revenue, units_28d_avg,
         CASE WHEN units_28d_avg > 0 THEN abs(total_units - units_28d_avg) / units_28d_avg * 100 END AS ape
  FROM demand WHERE sale_date = (SELECT max(sale_date) FROM demand)
  ORDER BY ape DESC NULLS LAST, store_id, dept_id, cat_id LIMIT 10)"""


@query("q02_forecast_deviations", f"""WITH {DEVIATIONS}
SELECT store_id, dept_id, cat_id, {iso('sale_date')} AS sale_date, CAST(total_units AS BIGINT) AS actual_units,
       {r('total_revenue', 2)} AS actual_revenue, {r('units_28d_avg', 4)} AS forecast_proxy, {r('ape', 4)} AS mape_pct
FROM dev""")
def _(t):
    """Q2 and T3."""
    answer = analytics.forecast_vs_actual(mart(t, "daily_demand"))
    return rounded(answer.deviations, actual_revenue=2, forecast_proxy=4, mape_pct=4)


@query("q02_forecast_summary", f"""WITH {DEVIATIONS}
SELECT count(*) AS returned_rows, {r('avg(ape)', 2)} AS avg_ape_of_returned FROM dev""")
def _(t):
    return analytics.forecast_vs_actual(mart(t, "daily_demand")).summary


@query("w09_latest_per_department", f"""WITH {DEMAND}
SELECT store_id, dept_id, {iso('sale_date')} AS sale_date, cat_id, CAST(total_units AS BIGINT) AS total_units,
       {r('units_28d_avg', 4)} AS units_28d_avg
FROM (SELECT *, row_number() OVER (PARTITION BY store_id, dept_id ORDER BY sale_date DESC, cat_id DESC) AS rn FROM demand)
WHERE rn = 1""")
def _(t):
    return rounded(analytics.latest_per_department(mart(t, "daily_demand")), units_28d_avg=4)


@query("q03_inventory_status", f"""WITH {DEMAND}
SELECT store_id, dept_id, {iso('sale_date')} AS sale_date, CAST(total_units AS BIGINT) AS total_units,
       {r('units_28d_avg', 4)} AS units_28d_avg, {r('total_units / units_28d_avg', 4)} AS days_of_stock_proxy
FROM (SELECT *, row_number() OVER (PARTITION BY store_id, dept_id ORDER BY sale_date DESC, cat_id DESC) AS rn FROM demand)
WHERE rn = 1 AND units_28d_avg > 0 AND total_units / units_28d_avg < 2.0
ORDER BY total_units / units_28d_avg, store_id, dept_id LIMIT 20""")
def _(t):
    return rounded(analytics.inventory_status(mart(t, "daily_demand")), units_28d_avg=4, days_of_stock_proxy=4)


WEEK_START = "CAST((SELECT max(kpi_date) FROM kpis) - INTERVAL 7 DAYS AS DATE)"
PRIOR_START = "CAST((SELECT max(kpi_date) FROM kpis) - INTERVAL 14 DAYS AS DATE)"


@query("q04_weekly_totals", f"""WITH {KPIS},
cur AS (SELECT * FROM kpis WHERE kpi_date >= {WEEK_START}),
prior AS (SELECT sum(total_revenue) AS revenue, sum(total_orders) AS orders FROM kpis
          WHERE kpi_date >= {PRIOR_START} AND kpi_date < {WEEK_START})
SELECT {r('sum(total_revenue)', 2)} AS revenue_this_week, (SELECT {r('revenue', 2)} FROM prior) AS revenue_last_week,
       CAST(sum(total_orders) AS BIGINT) AS orders_this_week, (SELECT CAST(orders AS BIGINT) FROM prior) AS orders_last_week,
       CAST(sum(unique_customers) AS BIGINT) AS customers_this_week, {r('avg(avg_basket_size)', 2)} AS avg_basket_size,
       count(*) FILTER (is_revenue_spike) AS spike_days FROM cur""")
def _(t):
    """Q4 with J7, J8 and A13."""
    return analytics.weekly_totals(mart(t, "executive_kpis"))


@query("t04_top_products", f"""WITH {PERFORMANCE}
SELECT product_name, {r('total_revenue', 2)} AS total_revenue, CAST(total_units_sold AS BIGINT) AS total_units_sold,
       revenue_rank FROM perf ORDER BY revenue_rank, product_id LIMIT 10""")
def _(t):
    return rounded(analytics.top_products(mart(t, "product_performance")), total_revenue=2)


@query("c08_weekly_payload")
def _(t):
    """The weekly answer as one JSON document."""
    return analytics.weekly_payload(analytics.weekly_summary(mart(t, "executive_kpis"), mart(t, "product_performance")))


@query("q05_recent_kpis", f"""WITH {KPIS}
SELECT {iso('kpi_date')} AS kpi_date, total_orders, unique_customers, total_units, total_revenue, avg_basket_size,
       revenue_wow_pct, is_revenue_spike FROM kpis ORDER BY kpi_date DESC LIMIT 30""")
def _(t):
    """Q5 and T5."""
    return analytics.recent_kpis(mart(t, "executive_kpis"), 30)


@query("w19_day_over_day", f"""WITH {KPIS}, d AS (
  SELECT *, lag(total_revenue) OVER w AS r0, lag(total_orders) OVER w AS o0, lag(unique_customers) OVER w AS c0,
         lag(avg_basket_size) OVER w AS b0 FROM kpis WINDOW w AS (ORDER BY kpi_date))
SELECT {iso('kpi_date')} AS kpi_date, total_revenue, total_orders, unique_customers, avg_basket_size,
       {r('(total_revenue - r0) / r0 * 100', 2)} AS total_revenue_delta_pct,
       {r('(total_orders - o0) / o0 * 100', 2)} AS total_orders_delta_pct,
       {r('(unique_customers - c0) / c0 * 100', 2)} AS unique_customers_delta_pct,
       {r('(avg_basket_size - b0) / b0 * 100', 2)} AS avg_basket_size_delta_pct
FROM d ORDER BY kpi_date DESC LIMIT 1""")
def _(t):
    return rounded(
        analytics.day_over_day(mart(t, "executive_kpis")), total_revenue_delta_pct=2, total_orders_delta_pct=2,
        unique_customers_delta_pct=2, avg_basket_size_delta_pct=2,
    )


@query("t07_last_order_counts", f"""WITH {KPIS}
SELECT {iso('kpi_date')} AS kpi_date, total_orders FROM kpis ORDER BY kpi_date DESC LIMIT 14""")
def _(t):
    return analytics.last_order_counts(mart(t, "executive_kpis"))


@query("p28_spike_days", f"""WITH {KPIS}
SELECT {iso('kpi_date')} AS kpi_date, total_revenue FROM kpis WHERE is_revenue_spike""")
def _(t):
    return analytics.spike_days(mart(t, "executive_kpis"))


@query("t06_revenue_by_country", f"""WITH {TX}
SELECT country, {r('sum(revenue)', 2)} AS revenue FROM tx GROUP BY 1 ORDER BY sum(revenue) DESC, 1 LIMIT 10""")
def _(t):
    return rounded(analytics.revenue_by_country(staged_transactions(t, "country")), revenue=2)


# ------------------------------------------------------------- experiment log

BUCKET_SQL = "CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS UBIGINT) % 100"


def experiment_log(t):
    """Impressions with outcome flags, taken from the event log."""
    kind = F.col("event_type")
    return t("events", "event_id", "ts", "user_id", "event_type").filter(kind.isin("view", "click", "purchase")).select(
        F.col("ts").cast("timestamp").alias("logged_at"),
        "user_id",
        experiment_variant(F.col("user_id")).alias("variant"),
        (F.col("event_id") % 10 + 1).cast("int").alias("items_shown"),
        F.when(kind.isin("click", "purchase"), 1).otherwise(0).alias("clicked"),
        F.when(kind == "purchase", 1).otherwise(0).alias("converted"),
    )


@query("m13_experiment_variant", f"""SELECT DISTINCT user_id, CAST({BUCKET_SQL} AS BIGINT) AS bucket,
CASE WHEN {BUCKET_SQL} >= 50 THEN 'treatment' ELSE 'control' END AS variant FROM events""")
def _(t):
    users = t("events", "user_id").distinct()
    return users.select(
        "user_id", experiment_bucket(F.col("user_id")).alias("bucket"), experiment_variant(F.col("user_id")).alias("variant")
    )


@query("q10_ab_test_results", f"""SELECT CASE WHEN {BUCKET_SQL} >= 50 THEN 'treatment' ELSE 'control' END AS variant,
count(*) AS impressions, {r('avg(event_id % 10 + 1)', 4)} AS avg_items_shown,
count(*) FILTER (event_type IN ('click', 'purchase')) AS total_clicks,
count(*) FILTER (event_type = 'purchase') AS total_conversions
FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1""")
def _(t):
    """A14 and Q10."""
    return rounded(analytics.ab_test_results(experiment_log(t)), avg_items_shown=4)


# ------------------------------------------------------------- service metrics

SLOT = "time_bucket(INTERVAL 5 MINUTES, ts)"
# Bounds fitted to the value range of the event log.
EVENT_BOUNDS = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0]


def _quantile_sql(q: float) -> str:
    parts = []
    for i, upper in enumerate(EVENT_BOUNDS):
        below = f"le_{i - 1}" if i else "0"
        lower = EVENT_BOUNDS[i - 1] if i else 0.0
        parts.append(
            f"WHEN le_{i} >= {q} * requests THEN {lower} + {upper - lower} * "
            f"(({q} * requests - {below}) / nullif(le_{i} - {below}, 0))"
        )
    return r("CASE " + " ".join(parts) + f" ELSE {EVENT_BOUNDS[-1]} END", 4)


@query("r08_request_rate", f"""SELECT {iso_time(SLOT)} AS window_start, event_type AS endpoint,
{r('count(*) / 300.0', 6)} AS rate FROM events GROUP BY ALL""")
def _(t):
    return rounded(opsmetrics.request_rate(tables.request_log(t)), rate=6)


@query("r09_latency_quantiles", f"""WITH h AS (
SELECT {iso_time(SLOT)} AS window_start, event_type AS endpoint, count(*) AS requests,
{', '.join(f'count(*) FILTER (value <= {b}) AS le_{i}' for i, b in enumerate(EVENT_BOUNDS))}
FROM events GROUP BY ALL)
SELECT window_start, endpoint, requests, {_quantile_sql(0.5)} AS p50, {_quantile_sql(0.95)} AS p95 FROM h""")
def _(t):
    log = tables.request_log(t)
    return rounded(opsmetrics.latency_quantiles(log, {"p50": 0.5, "p95": 0.95}, EVENT_BOUNDS), p50=4, p95=4)


@query("r10_total_requests", "SELECT count(*) AS total_requests FROM events")
def _(t):
    return opsmetrics.total_requests(tables.request_log(t))


@query("r10_hourly_increase", f"""SELECT {iso_time("s - k * INTERVAL 5 MINUTES")} AS window_start, endpoint,
CAST(sum(n) AS BIGINT) AS requests
FROM (SELECT {SLOT} AS s, event_type AS endpoint, count(*) AS n FROM events GROUP BY ALL), range(12) steps(k)
GROUP BY ALL""")
def _(t):
    return opsmetrics.hourly_increase(tables.request_log(t))


@query("r11_mean_latency", f"""SELECT {iso_time(SLOT)} AS window_start, event_type AS endpoint,
{r('avg(value)', 4)} AS mean_latency FROM events GROUP BY ALL""")
def _(t):
    return rounded(opsmetrics.mean_latency(tables.request_log(t)), mean_latency=4)
