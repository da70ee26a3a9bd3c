"""Sources and sinks: delimited text, Parquet, materialised layers, logs and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.plans import analytics, monitoring
from martspark.operators import catalog
from martspark.registry.base import CATALOG, DAILY_SALES, DEMAND, ORDER_HEADERS, iso, query, r, rounded
from martspark.registry.analytics import experiment_log
from martspark.registry.layers import CATALOG_ORACLE, built, mart, staged_sales
from martspark.plans import intermediate, staging
from martspark.registry.vectors import described
from martspark.session import working_path, written
from martspark.sources import cleaning, readers, tables, warehouse

CATALOG_SCHEMA = T.StructType([
    T.StructField(c, T.StringType())
    for c in ("name", "main_category", "sub_category", "image", "link", "ratings", "no_of_ratings", "discount_price", "actual_price")
])


@query("s01_orders_from_csv", f"""WITH {ORDER_HEADERS}
SELECT order_id, user_id, eval_set, order_number, order_dow, order_hour_of_day,
       CAST(days_since_prior_order AS DOUBLE) AS days_since_prior_order FROM headers""")
def _(t):
    """Orders written as delimited text with a header and read with a declared schema."""
    orders, path = tables.order_headers(t), working_path(t.spark, "orders-csv")
    orders.write.option("header", True).csv(path)
    return readers.read_csv(t.spark, path, orders.schema)


def catalog_csv(t):
    """The catalog as text, each product with a sound line and every eleventh also with
    a line of too many and a line of too few fields."""
    path = working_path(t.spark, "catalog-csv")
    raw = tables.raw_catalog(t)
    quoted = [F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"')) for c in raw.columns]
    sound = F.concat_ws(",", *quoted)
    extra = F.col("discount_price").isNull()
    lines = F.when(
        extra, F.array(sound, F.concat(sound, F.lit(",surplus")), F.concat_ws(",", F.lit('"short"'), quoted[1]))
    ).otherwise(F.array(sound))
    raw.select(F.explode(lines).alias("value")).write.text(path)
    return path


@query("s02_catalog_from_csv", f"""WITH {CATALOG}
SELECT product_name AS name, category AS main_category, list_price FROM priced
UNION ALL SELECT 'short', category, NULL FROM priced WHERE p_partkey % 11 = 0""")
def _(t):
    """Lines with too many fields are skipped, lines with too few are kept."""
    raw = readers.read_csv_skipping_long_lines(t.spark, catalog_csv(t), CATALOG_SCHEMA, header=False)
    return raw.select("name", "main_category", cleaning.clean_price(F.col("actual_price")).alias("list_price"))


@query("s02_malformed_lines", "SELECT count(*) * 2 AS malformed FROM part WHERE p_partkey % 11 = 0")
def _(t):
    bad = readers.malformed_csv_lines(t.spark, catalog_csv(t), CATALOG_SCHEMA, header=False)
    return bad.agg(F.count("_corrupt_record").alias("malformed"))


@query("k01_catalog_on_parquet", CATALOG_ORACLE)
def _(t):
    """The cleaned catalog on disk, staged as a view by name."""
    path = working_path(t.spark, "catalog")
    cleaning.clean_catalog(tables.raw_catalog(t)).write.option("compression", "snappy").parquet(path)
    return warehouse.materialise(staging.products(readers.read_parquet(t.spark, path)), "staging", "stg_products")


@query("t01_sorted_sales", f"""WITH {DAILY_SALES}
SELECT store_id, {iso('sale_date')} AS sale_date, dept_id, cat_id, CAST(total_units AS BIGINT) AS total_units FROM daily""")
def _(t):
    """Total order on write by range partitions."""
    path = working_path(t.spark, "sorted-sales")
    daily = intermediate.daily_store_sales(staged_sales(t))
    warehouse.write_sorted(daily.select("store_id", "sale_date", "dept_id", "cat_id", "total_units"), path, "store_id", "sale_date", "dept_id", "cat_id")
    return t.spark.read.parquet(path)


AUDITED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
           "pages", "benchmark", "labels", "conversations")


@query("k09_load_audit", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in AUDITED))
def _(t):
    return warehouse.load_audit({name: t(name) for name in AUDITED})


@query("k05_experiment_log", "SELECT count(*) AS rows, CAST(sum(event_id % 10 + 1) AS BIGINT) AS items, 0 AS clicks FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def _(t):
    """K5: appended rows get their time and zero counters."""
    path = working_path(t.spark, "experiment-log")
    warehouse.append_impressions(experiment_log(t).select("user_id", "variant", "items_shown"), path)
    return t.spark.read.parquet(path).agg(
        F.count("logged_at").alias("rows"), F.sum("items_shown").alias("items"), F.sum("clicked").alias("clicks")
    )


def spike_alerts(t):
    """One alert per spike row of the demand mart."""
    return mart(t, "daily_demand").filter("is_revenue_spike").select(
        F.when(F.col("total_revenue") > 4 * F.col("revenue_28d_avg"), "high").otherwise("medium").alias("severity"),
        F.concat_ws(" ", F.lit("Spike in"), "store_id", "dept_id").alias("title"),
        F.col("cat_id").alias("message"), F.lit("Review").alias("recommended_action"),
    )


@query("q11_posted_alerts", f"""WITH {DEMAND}
SELECT CASE WHEN total_revenue > 4 * revenue_28d_avg THEN 'high' ELSE 'medium' END AS severity, count(*) AS alerts,
       count(*) AS distinct_ids FROM demand WHERE is_revenue_spike GROUP BY 1""")
def _(t):
    """Q11: alerts appended with generated ids."""
    path = working_path(t.spark, "alerts")
    warehouse.append_alerts(spike_alerts(t), path)
    return t.spark.read.parquet(path).groupBy("severity").agg(
        F.count("created_at").alias("alerts"), F.countDistinct("alert_id").alias("distinct_ids")
    )


MONITORED = DEMAND + f""", dev AS (
  SELECT *, CASE WHEN units_28d_avg > 0 THEN abs(total_units - units_28d_avg) / units_28d_avg * 100 END AS ape FROM demand
  WHERE sale_date = (SELECT max(sale_date) FROM demand)
  ORDER BY ape DESC NULLS LAST, store_id, dept_id, cat_id LIMIT 10),
stock AS (
  SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY proxy, dept_id) AS place FROM (
    SELECT *, total_units / units_28d_avg AS proxy,
           row_number() OVER (PARTITION BY store_id, dept_id ORDER BY sale_date DESC, cat_id DESC) AS rn FROM demand)
  WHERE rn = 1 AND units_28d_avg > 0 AND total_units / units_28d_avg < 2.0),
alerts AS (
  SELECT 'high' AS severity, concat_ws(' ', 'Demand deviates in', store_id, dept_id, cat_id) AS title,
         format('{{}} units against a baseline of {{:.1f}}', CAST(total_units AS BIGINT), {r('units_28d_avg', 1)}) AS message,
         'Check promotions and data feeds of the department.' AS recommended_action FROM dev WHERE ape > 50.0
  UNION ALL
  SELECT 'medium', concat_ws(' ', 'Low sales against baseline in', store_id, dept_id), format('ratio {{:.2f}}', {r('proxy', 2)}),
         'Review stock on hand.' FROM stock WHERE place <= 20 AND proxy < 1.0)"""


def monitored(t):
    documents = catalog.catalog_documents(described(t))
    encoder = catalog.TextEncoder.fit(documents, "document")
    index = written(catalog.vector_table(documents, encoder), "document-vectors")
    return monitoring.monitoring_report(
        mart(t, "daily_demand"), None, index, encoder,
        deviation_limit=50.0, stock_limit=1.0,
    )


@query("q12_monitoring_alerts", f"WITH {MONITORED} SELECT severity, title, message, recommended_action FROM alerts")
def _(t):
    """Q12: alerts raised by the rules of a monitoring run."""
    return monitored(t).alerts


@query("q12_related_products")
def _(t):
    return rounded(monitored(t).related.select("query_id", "position", "id", "distance"), distance=4)


@query("q09_latest_report")
def _(t):
    """Q9: the stored report of a monitoring run, read back newest first."""
    alerts, reports = working_path(t.spark, "run-alerts"), working_path(t.spark, "run-reports")
    monitoring.record(monitored(t), alerts, reports)
    return warehouse.recent_reports(t.spark.read.parquet(reports), 10).select("report")


@query("q04_latest_report_in_summary", f"""WITH {DEMAND}
SELECT 'Spikes: ' || count(*) AS report FROM demand WHERE is_revenue_spike""")
def _(t):
    """T5: the newest of the stored reports."""
    path = working_path(t.spark, "reports")
    text = mart(t, "daily_demand").agg(F.concat(F.lit("Spikes: "), F.count_if("is_revenue_spike").cast("string")).alias("report"))
    warehouse.append_reports(text, path)
    return analytics.latest_rows(t.spark.read.parquet(path), "created_at", 1, "report_id").select("report")


BUILT = {
    ("raw", "transactions"): "SELECT count(*) FROM lineitem", ("raw", "sales"): "SELECT count(*) FROM lineitem",
    ("intermediate", "daily_store_sales"): "SELECT count(*) FROM daily", ("mart", "daily_demand"): "SELECT count(*) FROM daily",
    ("mart", "executive_kpis"): "SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ("mart", "product_performance"): "SELECT count(DISTINCT l_partkey) FROM lineitem",
    ("mart", "dim_stores"): "SELECT count(DISTINCT store_id) FROM sales",
}


@query("k02_warehouse_tables", f"WITH {DAILY_SALES} " + " UNION ALL ".join(
    f"SELECT '{layer}' AS layer, '{name}' AS table_name, ({sql}) AS rows" for (layer, name), sql in BUILT.items()))
def _(t):
    """K2, K4 and K8: the tables that a build leaves in each layer's schema, with their rows."""
    done, rows = built(t), None
    for layer in ("raw", "intermediate", "mart"):
        for name in done.listed(layer):
            count = done.table(layer, name).agg(
                F.lit(layer).alias("layer"), F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
            rows = count if rows is None else rows.unionByName(count)
    return rows


@query("k08_tables_by_name", """SELECT 'daily_demand' AS table_name, 'daily' AS part UNION ALL
SELECT 'executive_kpis', 'kpis' UNION ALL SELECT 'dim_stores', 'stores'""")
def _(t):
    """The search for tables by a part of their name."""
    done = built(t)
    found = [(name, part) for part in ("daily", "kpis", "stores", "nothing") for name in done.listed("mart", part)]
    return t.spark.createDataFrame(found, "table_name string, part string")


@query("d09_table_states", f"""WITH {DAILY_SALES}
SELECT 'daily_demand' AS table_name, true AS "exists", true AS "columns", count(*) > 0 AS has_rows FROM daily UNION ALL
SELECT 'executive_kpis', true, false, count(*) > 0 FROM orders UNION ALL SELECT 'no_such_table', false, false, false""")
def _(t):
    """Whether tables exist, have the asked columns and hold rows."""
    done = built(t)
    asked = {"daily_demand": ["store_id", "units_28d_avg"], "executive_kpis": ["kpi_date", "no_such_column"], "no_such_table": ["a"]}
    states = [(name, *warehouse.table_state(t.spark, done.name("mart", name), columns).values()) for name, columns in asked.items()]
    return t.spark.createDataFrame(states, "table_name string, exists boolean, columns boolean, has_rows boolean")
