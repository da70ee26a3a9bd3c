"""Quality suites, profiling reports and the raw-layer cleaning jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from martspark.functions.routing import experiment_variant
from martspark.operators import profiling, quality
from martspark.plans import intermediate, marts
from martspark.registry.analytics import BUCKET_SQL
from martspark.registry.base import (
    DAILY_SALES, DEMAND, INTERACTIONS, KPIS, ORDER_HEADERS, PAIRS, SALES, TX, iso, iso_time, query, r, rounded,
)
from martspark.registry.layers import (
    PERFORMANCE, demand, kpis, pairs, performance, staged_interactions, staged_sales, staged_transactions,
)
from martspark.sources import cleaning, tables
from martspark.sources.readers import stacked

# --------------------------------------------------------------------- quality

BOUNDS = {
    "fct_product_performance": (150, 10**9),
    "fct_daily_demand": (1_000, 10**12),
    "mart_executive_kpis": (500, 2_000),
    "dim_stores": (10, 10),
}
STATES = ("AF", "AM", "AS", "EU")  # leaves out one state, so that a failing rule is covered too
SUITES = quality.mart_suites(BOUNDS, STATES)


def suite_sql(ctes: str, relation: str, table: str, checks: list[quality.Check]) -> str:
    """One SELECT per rule, each written as the plain SQL a person would check it with."""
    selects = []
    for c in checks:
        passed = "observed = 0"
        if c.kind == "row_count":
            observed, passed = f"SELECT count(*) FROM {relation}", f"observed BETWEEN {c.low} AND {c.high}"
        elif c.kind == "not_null":
            observed = f"SELECT count(*) FROM {relation} WHERE {c.column} IS NULL"
        elif c.kind == "unique":
            observed = f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {relation} WHERE {c.column} IS NOT NULL GROUP BY {c.column})"
        elif c.kind == "in_set":
            observed = f"SELECT count(*) FROM {relation} WHERE {c.column} NOT IN ({', '.join(repr(v) for v in c.values)})"
        else:
            observed = f"SELECT count(*) FROM {relation} WHERE {c.column} < {c.low}"
        selects.append(
            f"SELECT '{table}' AS table_name, '{c.kind}' AS check_name, '{c.column}' AS column_name, observed, "
            f"{passed} AS success FROM (SELECT CAST(({observed}) AS BIGINT) AS observed)"
        )
    return f"WITH {ctes}, checks AS (" + " UNION ALL ".join(selects) + ")"


STORES = DAILY_SALES + """, stores AS (
  SELECT store_id, s.state_id, sum(total_revenue) AS total_revenue_all_time
  FROM (SELECT DISTINCT store_id, state_id FROM sales) s LEFT JOIN daily USING (store_id) GROUP BY 1, 2)"""


def store_dimension(t):
    sales = staged_sales(t)
    return marts.store_dimension(sales, intermediate.daily_store_sales(sales))


_SUITE_INPUTS = {
    "fct_product_performance": (PERFORMANCE, "perf", performance),
    "fct_daily_demand": (DEMAND, "demand", demand),
    "mart_executive_kpis": (KPIS, "kpis", kpis),
    "dim_stores": (STORES, "stores", store_dimension),
}

for _table, (_ctes, _relation, _frame) in _SUITE_INPUTS.items():

    @query(f"d06_suite_{_table}", suite_sql(_ctes, _relation, _table, SUITES[_table]) + " SELECT * FROM checks")
    def _(t, table=_table, frame=_frame):
        """D1 to D6 for one mart."""
        return quality.run_suite(frame(t), table, SUITES[table])


@query("d06_suite_report", suite_sql(STORES, "stores", "dim_stores", SUITES["dim_stores"]) + """
SELECT table_name, count(*) FILTER (success) AS passed, count(*) AS total,
       coalesce(string_agg(check_name || '(' || column_name || '): ' || observed, '; '
                ORDER BY check_name || '(' || column_name || '): ' || observed) FILTER (NOT success), '') AS failed_checks
FROM checks GROUP BY 1""")
def _(t):
    return quality.suite_report(quality.run_suite(store_dimension(t), "dim_stores", SUITES["dim_stores"]))


_RULE_INPUTS = {
    "stg_sales": (SALES, "sales", staged_sales),
    "stg_interactions": (INTERACTIONS, "inter", staged_interactions),
    "stg_transactions": (TX, "tx", staged_transactions),
    "int_daily_store_sales": (DAILY_SALES, "daily", lambda t: intermediate.daily_store_sales(staged_sales(t))),
    "int_user_product_interactions": (PAIRS, "pairs", pairs),
    "fct_daily_demand": (DEMAND, "demand", demand),
}

for _table, (_ctes, _relation, _frame) in _RULE_INPUTS.items():

    @query(f"d01_rules_{_table}", suite_sql(_ctes, _relation, _table, quality.COLUMN_RULES[_table]) + " SELECT * FROM checks")
    def _(t, table=_table, frame=_frame):
        """Declared column rules of one table."""
        return quality.run_suite(frame(t), table, quality.COLUMN_RULES[table])


DENSE = SALES + """, per_day AS (
  SELECT state_id, cat_id, sale_date, sum(unit_sales) AS units, sum(revenue) AS money FROM sales GROUP BY ALL),
span AS (SELECT state_id, cat_id, min(sale_date) AS lo, max(sale_date) AS hi FROM per_day GROUP BY ALL),
grid AS (SELECT state_id, cat_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS sale_date FROM span),
cal AS (SELECT day, dayofyear(day) AS yday, dayofmonth(day) AS dom
        FROM (SELECT CAST(unnest(generate_series(min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day
              FROM lineitem)),
dense AS (
  SELECT cat_id || '_1' AS item_id, state_id || '_1' AS store_id, cat_id AS dept_id, cat_id, state_id, sale_date,
         CAST(coalesce(units, 0) AS INTEGER) AS unit_sales,
         last_value(money / units IGNORE NULLS) OVER (PARTITION BY state_id, cat_id ORDER BY sale_date) AS sell_price,
         yday % 37 = 0 AS has_event,
         CASE WHEN yday % 37 = 0 THEN ['Sporting', 'Cultural', 'National', 'Religious'][(yday // 37) % 4 + 1]
              ELSE 'None' END AS event_name_type,
         CASE WHEN dom % 3 = 0 THEN 1 ELSE 0 END AS s0, CASE WHEN dom % 3 = 1 THEN 1 ELSE 0 END AS s1,
         CASE WHEN dom % 3 = 2 THEN 1 ELSE 0 END AS s2
  FROM grid LEFT JOIN per_day USING (state_id, cat_id, sale_date) LEFT JOIN cal ON sale_date = day)"""


@query("d07_dense_series", f"""WITH {DENSE}
SELECT store_id, item_id, count(*) AS days,
       count(DISTINCT sale_date) = count(*) AND datediff('day', min(sale_date), max(sale_date)) + 1 = count(*) AS consecutive,
       min(unit_sales) >= 0 AS non_negative FROM dense GROUP BY 1, 2""")
def _(t):
    return quality.dense_series_report(tables.item_sales(t), ["store_id", "item_id"], "date", "unit_sales")


@query("d08_experiment_split", f"""WITH s AS (
SELECT avg(CASE WHEN {BUCKET_SQL} >= 50 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT DISTINCT user_id FROM events))
SELECT {r('share', 6)} AS share, share > 0.45 AND share < 0.55 AS success FROM s""")
def _(t):
    users = t("events", "user_id").distinct()
    treated = experiment_variant(F.col("user_id")) == "treatment"
    return rounded(quality.share_between(users, treated, 0.45, 0.55), share=6)


# -------------------------------------------------------------------- cleaning

RAW_INVOICES = """raw AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || o_orderkey AS invoice,
         CASE l_linenumber WHEN 7 THEN 'POST' WHEN 6 THEN printf('%05d', l_partkey) || 'A'
              ELSE printf('%05d', l_partkey) END AS code,
         CASE WHEN cents <> 10 THEN p_name END AS description,
         CAST(CASE WHEN cents = 9 THEN -l_quantity ELSE l_quantity END AS INTEGER) AS quantity,
         o_orderdate AS invoice_date, CASE WHEN cents = 8 THEN 0.0 ELSE l_extendedprice / l_quantity END AS price,
         CASE WHEN cents <> 7 THEN o_custkey END AS customer, n_name AS country, l_linestatus AS extract_no
  FROM (SELECT *, CAST(round(l_discount * 100) AS INTEGER) AS cents FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), cleaned AS (
  SELECT * FROM raw WHERE invoice NOT LIKE 'C%' AND regexp_full_match(code, '[0-9]{5}') AND quantity > 0
    AND price > 0 AND customer IS NOT NULL AND description IS NOT NULL)"""


def raw_invoices(t):
    """Both extracts stacked by column name."""
    return stacked(tables.raw_invoices(t, "O"), tables.raw_invoices(t, "F"))


@query("s03_stacked_extracts", f"""WITH {RAW_INVOICES}
SELECT invoice AS "Invoice", code AS "StockCode", description AS "Description", CAST(quantity AS BIGINT) AS "Quantity",
       {iso_time('invoice_date')} AS "InvoiceDate", {r('price', 4)} AS "Price",
       CAST(customer AS DOUBLE) AS "Customer ID", country AS "Country" FROM raw""")
def _(t):
    return rounded(raw_invoices(t), Price=4)


@query("p08_clean_invoices", f"""WITH {RAW_INVOICES}
SELECT invoice AS invoice_id, code AS product_id, description, CAST(quantity AS BIGINT) AS quantity,
       {iso_time('invoice_date')} AS invoice_date, {r('price', 4)} AS unit_price, customer AS customer_id, country,
       {r('quantity * price', 2)} AS revenue FROM cleaned""")
def _(t):
    """P8 to P11, P16 and P17."""
    return rounded(cleaning.clean_invoices(raw_invoices(t)), unit_price=4, revenue=2)


@query("a20_load_retention", f"""WITH {RAW_INVOICES}
SELECT (SELECT count(*) FROM raw) AS rows_in, count(*) AS rows_out, count(DISTINCT customer) AS customers,
       count(DISTINCT code) AS products, {iso_time('min(invoice_date)')} AS first_date,
       {iso_time('max(invoice_date)')} AS last_date,
       {r('(1 - count(*) / (SELECT count(*) FROM raw)) * 100', 4)} AS pct_dropped FROM cleaned""")
def _(t):
    raw = raw_invoices(t)
    return rounded(cleaning.load_retention(raw, cleaning.clean_invoices(raw)), pct_dropped=4)


@query("p13_labelled_orders", f"""WITH {ORDER_HEADERS}
SELECT order_id, user_id, eval_set, order_number, order_dow, order_hour_of_day,
       coalesce(days_since_prior_order, 0) AS days_since_prior_order FROM headers WHERE eval_set <> 'test'""")
def _(t):
    """P13 and P14."""
    return cleaning.labelled_orders(tables.order_headers(t))


@query("j05_active_users", f"""WITH {INTERACTIONS}
SELECT DISTINCT user_id FROM inter""")
def _(t):
    """Users left after the order join and the three-order filter."""
    lines = stacked(tables.order_lines(t, "O"), tables.order_lines(t, "F"))
    orders = cleaning.labelled_orders(tables.order_headers(t)).select("order_id", "user_id")
    return cleaning.active_users(lines.join(orders, "order_id"))


def long_sales(t):
    """The wide weekly table as rows, with the calendar's running day label."""
    ids = ["item_id", "dept_id", "cat_id", "store_id", "state_id", "week"]
    melted = cleaning.melt_days(tables.wide_sales(t), ids, [f"d_{k}" for k in range(1, 8)])
    slot = F.substring("d", 3, 1).cast("int")
    first = t("lineitem", "l_shipdate").agg(F.min(F.to_date("l_shipdate")))
    day = F.date_add("week", (slot + 5) % 7)
    return melted.withColumn("d", F.concat(F.lit("d_"), (F.datediff(day, first.scalar()) + 1).cast("string")))


def weekly_prices(t):
    """Mean price per store, item and week; some prices are 0 and must be dropped."""
    priced = tables.sales(t).withColumn("day", F.to_date("date")).join(
        tables.calendar(t).select(F.col("date").alias("day"), "wm_yr_wk"), "day"
    )
    mean = F.when(F.col("item_id") % 23 == 0, 0.0).otherwise(F.avg("sell_price"))
    return priced.groupBy("store_id", "item_id", "wm_yr_wk").agg(mean.alias("sell_price"))


WIDE = SALES + """, lo AS (SELECT min(CAST(l_shipdate AS DATE)) AS lo FROM lineitem), long AS (
  SELECT item_id, dept_id, cat_id, store_id, state_id, date_trunc('week', sale_date)::DATE AS week, k,
         (date_trunc('week', sale_date)::DATE + CAST(k AS INTEGER)) AS day,
         greatest(coalesce(sum(unit_sales) FILTER (datediff('day', date_trunc('week', sale_date), sale_date) = k), 0), 0) AS unit_sales
  FROM sales, range(7) slots(k) GROUP BY ALL), price AS (
  SELECT store_id, item_id, datediff('day', lo, sale_date) // 7 + 1 AS wm_yr_wk, avg(sell_price) AS sell_price
  FROM sales, lo WHERE item_id % 23 <> 0 GROUP BY ALL)"""


@query("p15_long_sales", f"""WITH {WIDE}
SELECT item_id, dept_id, cat_id, store_id, state_id, {iso('week')} AS week,
       'd_' || (datediff('day', lo, day) + 1) AS d, CAST(unit_sales AS BIGINT) AS unit_sales FROM long, lo""")
def _(t):
    """Unpivot with fill and clip."""
    return long_sales(t)


@query("j02_priced_sales", f"""WITH {WIDE}
SELECT item_id, store_id, {iso('day')} AS date, wm_yr_wk, dayname(day) AS weekday, month(day) AS month,
       CAST(unit_sales AS BIGINT) AS unit_sales, {r('sell_price', 4)} AS sell_price,
       {r('unit_sales * sell_price', 2)} AS revenue
FROM long JOIN price USING (store_id, item_id) CROSS JOIN lo
WHERE day >= lo AND day <= (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)
  AND wm_yr_wk = datediff('day', lo, day) // 7 + 1""")
def _(t):
    """Calendar and price lookups of the sales cleaner."""
    df = cleaning.priced_sales(long_sales(t), tables.calendar(t), weekly_prices(t))
    columns = ["item_id", "store_id", F.to_date("date").alias("date"), "wm_yr_wk", "weekday", "month", "unit_sales",
               "sell_price", "revenue"]
    return rounded(df.select(*columns), sell_price=4, revenue=2)


# ------------------------------------------------------------------- profiling


@query("e01_null_report", f"""WITH {RAW_INVOICES}
SELECT c AS column_name, nulls, {r('nulls / n * 100', 2)} AS null_pct FROM (
  SELECT count(*) AS n, count(*) - count(invoice) AS "Invoice", count(*) - count(code) AS "StockCode",
         count(*) - count(description) AS "Description", count(*) - count(quantity) AS "Quantity",
         count(*) - count(invoice_date) AS "InvoiceDate", count(*) - count(price) AS "Price",
         count(*) - count(customer) AS "Customer ID", count(*) - count(country) AS "Country" FROM raw)
UNPIVOT (nulls FOR c IN ("Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"))""")
def _(t):
    return rounded(profiling.null_report(raw_invoices(t)), null_pct=2)


def describe_sql(relation: str, value: str) -> str:
    return f"""SELECT count({value}) AS count, {r(f'avg({value})', 4)} AS mean, {r(f'stddev_samp({value})', 4)} AS std,
CAST(min({value}) AS DOUBLE) AS min, {r(f'quantile_cont({value}, 0.25)', 4)} AS p25,
{r(f'quantile_cont({value}, 0.5)', 4)} AS p50, {r(f'quantile_cont({value}, 0.75)', 4)} AS p75,
CAST(max({value}) AS DOUBLE) AS max FROM {relation}"""


def described(df, column):
    return rounded(profiling.describe(df, F.col(column)), mean=4, std=4, p25=4, p50=4, p75=4)


@query("e02_describe_revenue", describe_sql("lineitem", "l_extendedprice"))
def _(t):
    return described(t("lineitem", "l_extendedprice"), "l_extendedprice")


@query("e07_orders_per_user", describe_sql("(SELECT count(*) AS size FROM orders GROUP BY o_custkey)", "CAST(size AS DOUBLE)"))
def _(t):
    return described(profiling.group_sizes(tables.order_headers(t), "user_id"), "size")


@query("e07_order_size_thresholds", f"""SELECT count(*) AS groups, count(*) FILTER (size = 1) AS single,
count(*) FILTER (size >= 10) AS many, {r('avg(size)', 4)} AS mean_size
FROM (SELECT count(*) AS size FROM orders GROUP BY o_custkey)""")
def _(t):
    sizes = profiling.group_sizes(tables.order_headers(t), "user_id")
    return rounded(profiling.size_thresholds(sizes), mean_size=4)


@query("e07_items_per_order", f"""SELECT count(*) AS groups, count(*) FILTER (size = 1) AS single,
count(*) FILTER (size >= 10) AS many, {r('avg(size)', 4)} AS mean_size
FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey)""")
def _(t):
    lines = stacked(tables.order_lines(t, "O"), tables.order_lines(t, "F"))
    return rounded(profiling.size_thresholds(profiling.group_sizes(lines, "order_id")), mean_size=4)


@query("e03_value_counts", "SELECT l_partkey AS value, count(*) AS rows FROM lineitem GROUP BY 1 ORDER BY rows DESC, value LIMIT 10")
def _(t):
    return profiling.value_counts(t("lineitem", "l_partkey"), "l_partkey", 10)


@query("e04_clipped_histogram", """WITH c AS (SELECT least(l_extendedprice, 50000.0) AS v FROM lineitem),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM c)
SELECT CAST(least(floor((v - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS rows FROM c, b GROUP BY 1""")
def _(t):
    return profiling.clipped_histogram(t("lineitem", "l_extendedprice"), F.col("l_extendedprice"), 50_000)


@query("e05_invalid_invoices", f"""WITH {RAW_INVOICES}
SELECT count(*) FILTER (quantity < 0) AS negative_quantities, count(*) FILTER (quantity = 0) AS zero_quantities,
       count(*) FILTER (price < 0) AS negative_prices, count(*) FILTER (price = 0) AS zero_prices,
       count(*) FILTER (invoice LIKE 'C%') AS cancelled, count(DISTINCT code) AS stock_codes FROM raw""")
def _(t):
    return profiling.invalid_invoices(raw_invoices(t))


@query("e05_non_product_codes", f"""WITH {RAW_INVOICES}
SELECT code AS value, count(*) AS rows FROM raw WHERE NOT regexp_matches(code, '^[0-9]{{5}}')
GROUP BY 1 ORDER BY rows DESC, value LIMIT 15""")
def _(t):
    return profiling.non_product_codes(raw_invoices(t))


@query("e05_cleaning_estimate", f"""WITH {RAW_INVOICES}
SELECT count(*) AS rows_before, count(*) FILTER (customer IS NOT NULL AND quantity > 0 AND price > 0
  AND invoice NOT LIKE 'C%' AND regexp_matches(code, '^[0-9]{{5}}') AND description IS NOT NULL) AS rows_after FROM raw""")
def _(t):
    return profiling.cleaning_estimate(raw_invoices(t))


@query("e06_zero_share", f"""WITH {DENSE}
SELECT {r('avg(CASE WHEN unit_sales = 0 THEN 1.0 ELSE 0.0 END) * 100', 4)} AS zero_pct FROM dense""")
def _(t):
    return rounded(profiling.zero_share(tables.item_sales(t), "unit_sales"), zero_pct=4)


@query("e08_orders_by_hour", "SELECT o_orderkey % 24 AS order_hour_of_day, count(*) AS orders FROM orders GROUP BY 1")
def _(t):
    return profiling.orders_by_hour(tables.order_headers(t))


@query("e08_orders_by_weekday", """SELECT ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][CAST(extract('dow' FROM o_orderdate) AS INTEGER) + 1] AS weekday,
count(*) AS orders FROM orders GROUP BY 1""")
def _(t):
    return profiling.orders_by_weekday(tables.order_headers(t))


@query("e09_ranges", f"""WITH {TX}
SELECT {iso('min(invoice_date)')} AS first_date, {iso('max(invoice_date)')} AS last_date,
       count(DISTINCT customer_id) AS customers, count(DISTINCT country) AS countries FROM tx""")
def _(t):
    return staged_transactions(t, "country").agg(
        F.min("invoice_date").alias("first_date"), F.max("invoice_date").alias("last_date"),
        F.countDistinct("customer_id").alias("customers"), F.countDistinct("country").alias("countries"),
    )


@query("e10_text_profile", f"""SELECT count(text) AS non_null, {r('avg(length(text))', 2)} AS mean_length,
substr(arg_min(text, doc_id), 1, 100) AS sample FROM documents WHERE text IS NOT NULL""")
def _(t):
    return rounded(profiling.text_profile(t("documents", "doc_id", "text"), "text", "doc_id"), mean_length=2)


@query("e11_benefit_days", f"""WITH {DENSE}
SELECT count(*) FILTER (dom % 3 = 0) AS "snap_CA", count(*) FILTER (dom % 3 = 1) AS "snap_TX",
       count(*) FILTER (dom % 3 = 2) AS "snap_WI" FROM cal""")
def _(t):
    return profiling.benefit_days(tables.calendar(t), ["snap_CA", "snap_TX", "snap_WI"])


@query("e11_event_days", f"""WITH {DENSE}
SELECT 'Event' || (yday // 37) AS value, count(*) AS rows FROM cal WHERE yday % 37 = 0
GROUP BY 1 ORDER BY rows DESC, value LIMIT 10""")
def _(t):
    return profiling.value_counts(tables.calendar(t), "event_name_1", 10)


@query("p27_sampled_users", """SELECT user_id FROM (SELECT DISTINCT o_custkey AS user_id FROM orders)
ORDER BY md5(user_id || '-42') LIMIT 500""")
def _(t):
    users = t("orders", "o_custkey").distinct().withColumnRenamed("o_custkey", "user_id")
    return profiling.sampled(users, F.col("user_id"), 500, 42)


@query("a21_reorder_rate", f"""WITH {INTERACTIONS} SELECT {r('avg(reordered)', 4)} AS reorder_rate FROM inter""")
def _(t):
    rate = staged_interactions(t).agg(F.avg(F.col("is_reorder").cast("double")).alias("reorder_rate"))
    return rounded(rate, reorder_rate=4)


@query("j13_top_ordered_products", f"""WITH {INTERACTIONS}, top AS (
  SELECT product_id, count(*) AS orders FROM inter GROUP BY 1 ORDER BY orders DESC, product_id LIMIT 10)
SELECT product_id, p_name || ' ' || p_partkey AS product_name, orders FROM top JOIN part ON product_id = p_partkey""")
def _(t):
    top = profiling.value_counts(staged_interactions(t), "product_id", 10)
    named = tables.catalog_products(t).select("product_id", "product_name")
    return top.withColumnsRenamed({"value": "product_id", "rows": "orders"}).join(named, "product_id")
