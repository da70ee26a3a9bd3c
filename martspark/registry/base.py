"""Registration of queries and the SQL building blocks their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.functions.numeric import stable_round
from martspark.session import ship_package
from martspark.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` is the equivalent check query."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return comparable(fn(Tables(spark, folder)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Output types that both engines print alike: bigint, double, ISO text for dates."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.FloatType, T.DecimalType)):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns with the order-independent rule."""
    return df.withColumns({name: stable_round(F.col(name), k) for name, k in digits.items()})


# --------------------------------------------------------------- SQL fragments


def r(expression: str, digits: int) -> str:
    """The rounding rule of ``stable_round`` in SQL."""
    scale = f"{float(10 ** digits):.1f}"
    return f"floor(({expression}) * {scale} + 0.500001) / {scale}"


def iso(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def iso_time(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


TX = """tx AS (
  SELECT o_orderkey AS invoice_id, l_partkey AS product_id, p_name AS product_name,
         CAST(l_quantity AS INTEGER) AS quantity, o_orderdate AS invoice_ts,
         CAST(o_orderdate AS DATE) AS invoice_date, l_extendedprice / l_quantity AS unit_price,
         o_custkey AS customer_id, n_name AS country, l_extendedprice AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN part ON l_partkey = p_partkey)"""

SALES = """sales AS (
  SELECT l_partkey AS item_id, p_brand AS dept_id, p_type AS cat_id,
         upper(substr(r_name, 1, 2)) || '_' || n_nationkey AS store_id, upper(substr(r_name, 1, 2)) AS state_id,
         l_partkey || '_' || upper(substr(r_name, 1, 2)) || '_' || n_nationkey AS sale_id,
         CAST(l_shipdate AS DATE) AS sale_date, CAST(l_quantity AS INTEGER) AS unit_sales,
         l_extendedprice / l_quantity AS sell_price, l_extendedprice AS revenue,
         CASE WHEN l_quantity > 0 THEN 1 ELSE 0 END AS has_sales
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""

DAILY_SALES = SALES + """, daily AS (
  SELECT sale_date, store_id, state_id, dept_id, cat_id, count(DISTINCT item_id) AS unique_items_sold,
         sum(unit_sales) AS total_units, sum(revenue) AS total_revenue, avg(sell_price) AS avg_price,
         sum(has_sales) AS items_with_sales, count(*) AS total_rows
  FROM sales GROUP BY ALL)"""

DEMAND = DAILY_SALES + """, demand AS (
  SELECT *, coalesce(revenue_28d_avg > 0 AND total_revenue > 2.0 * revenue_28d_avg, false) AS is_revenue_spike
  FROM (SELECT *, avg(total_revenue) OVER w AS revenue_28d_avg, avg(total_units) OVER w AS units_28d_avg
        FROM daily
        WINDOW w AS (PARTITION BY store_id ORDER BY sale_date, dept_id, cat_id
                     ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)))"""

KPIS = TX + f""", days AS (
  SELECT invoice_date AS kpi_date, count(DISTINCT invoice_id) AS total_orders,
         count(DISTINCT customer_id) AS unique_customers, sum(quantity) AS total_units, sum(revenue) AS money,
         sum(revenue) / nullif(count(DISTINCT invoice_id), 0) AS basket,
         count(DISTINCT product_id) AS unique_products_sold
  FROM tx GROUP BY 1), trends AS (
  SELECT *, sum(money) OVER (ORDER BY kpi_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling,
         avg(money) OVER (ORDER BY kpi_date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS baseline,
         lag(money, 7) OVER (ORDER BY kpi_date) AS last_week,
         lag(total_orders, 7) OVER (ORDER BY kpi_date) AS orders_last_week,
         lag(unique_customers, 7) OVER (ORDER BY kpi_date) AS customers_last_week
  FROM days), kpis AS (
  SELECT kpi_date, total_orders, unique_customers, CAST(total_units AS BIGINT) AS total_units,
         {r('money', 2)} AS total_revenue, {r('basket', 2)} AS avg_basket_size, unique_products_sold,
         {r('rolling', 2)} AS revenue_7d_rolling, {r('baseline', 2)} AS revenue_28d_baseline,
         {r('last_week', 2)} AS revenue_last_week, orders_last_week, customers_last_week,
         CASE WHEN last_week > 0 THEN {r('100.0 * (money - last_week) / last_week', 2)} END AS revenue_wow_pct,
         coalesce(baseline > 0 AND money > 2.0 * baseline, false) AS is_revenue_spike
  FROM trends)"""

ORDER_HEADERS = """headers AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id,
         CASE o_orderstatus WHEN 'P' THEN 'test' WHEN 'O' THEN 'train' ELSE 'prior' END AS eval_set,
         CAST(floor(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 30.0) AS BIGINT) + 1
           AS order_number,
         CAST(extract('dow' FROM o_orderdate) AS BIGINT) AS order_dow, o_orderkey % 24 AS order_hour_of_day,
         nullif(o_orderkey % 31, 0) AS days_since_prior_order
  FROM orders)"""

INTERACTIONS = ORDER_HEADERS + """, lines AS (
  SELECT order_id, user_id, order_number, order_dow, order_hour_of_day,
         coalesce(days_since_prior_order, 0) AS days_since_prior_order, l_partkey AS product_id,
         l_linenumber AS add_to_cart_order, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS reordered
  FROM lineitem JOIN headers ON l_orderkey = order_id WHERE eval_set <> 'test'), inter AS (
  SELECT lines.*, p_name || ' ' || p_partkey AS product_name, p_brand AS aisle, p_type AS department
  FROM lines LEFT JOIN part ON product_id = p_partkey
  WHERE user_id IN (SELECT user_id FROM lines GROUP BY 1 HAVING count(DISTINCT order_id) >= 3))"""

PAIRS = INTERACTIONS + """, pairs AS (
  SELECT user_id, product_id, product_name, department, aisle, count(DISTINCT order_id) AS total_orders,
         CAST(sum(reordered) AS BIGINT) AS reorder_count, min(order_number) AS first_order_number,
         max(order_number) AS last_order_number, avg(add_to_cart_order) AS avg_cart_position,
         ln(1 + count(DISTINCT order_id)) + 0.5 * ln(1 + sum(reordered)) AS interaction_score
  FROM inter GROUP BY ALL)"""

CATALOG = """catalog AS (
  SELECT p_partkey, p_name || ' ' || p_partkey AS product_name, p_brand AS category, p_type AS sub_category,
         CASE WHEN p_partkey % 13 <> 0 THEN p_size / 10.0 END AS avg_rating,
         CASE WHEN p_partkey % 17 <> 0 THEN p_partkey * 7 ELSE 0 END AS rating_count,
         CASE WHEN p_partkey % 11 <> 0
              THEN CAST(format('{:.2f}', p_retailprice * (1 - (p_size % 7) / 10.0)) AS DOUBLE) END AS sale_price,
         CASE WHEN p_partkey % 19 <> 0 THEN p_retailprice END AS list_price
  FROM part), priced AS (
  SELECT *, CASE WHEN sale_price IS NOT NULL AND list_price > 0
                 THEN round_even((list_price - sale_price) / list_price * 100, 1) END AS discount_pct
  FROM catalog)"""
