"""Transaction feed queries on the batch side."""

from __future__ import annotations

from martspark.plans import analytics, feed
from martspark.registry.base import TX, iso_time, query, r, rounded
from martspark.registry.layers import staged_transactions

# Limits fitted to the test data, where one line earns up to about 105,000.
MIN_QUANTITY, FACTOR, REVENUE_LIMIT = 10, 0.5, 90_000.0


def all_transactions(t):
    return staged_transactions(t, "country", "description")


def lookup(t):
    return feed.product_lookup(staged_transactions(t, "description"))


def enriched(t):
    return feed.enrich(feed.feed_events(all_transactions(t)), lookup(t))


LOOKUP = TX + """, lookup AS (
  SELECT product_id, max(product_name) AS product_name, sum(revenue) AS total_revenue,
         CAST(sum(quantity) AS BIGINT) AS total_units_sold,
         row_number() OVER (ORDER BY round(sum(revenue), 4) DESC, product_id) AS revenue_rank
  FROM tx GROUP BY 1)"""

ENRICHED = LOOKUP + """, enriched AS (
  SELECT CAST(tx.invoice_id AS VARCHAR) AS txn_id, tx.customer_id, tx.product_id, tx.product_name AS description,
         tx.quantity, tx.unit_price, tx.revenue, tx.country, tx.invoice_ts AS ts,
         CASE WHEN l.revenue_rank IS NULL THEN 'unknown' ELSE l.product_name END AS category,
         coalesce(l.revenue_rank, -1) AS revenue_rank, coalesce(l.revenue_rank <= 100, false) AS is_top_seller,
         l.total_units_sold AS units
  FROM tx LEFT JOIN lookup l USING (product_id))"""

MESSAGE_SQL = f"""txn_id, customer_id, product_id, description, CAST(quantity AS BIGINT) AS quantity,
       {r('unit_price', 4)} AS unit_price, revenue, country, {iso_time('ts')} AS timestamp, category, revenue_rank,
       is_top_seller"""

INVENTORY_SQL = f"""'high_volume_order' AS alert_type, country AS store_id, product_id,
       CAST(quantity AS BIGINT) AS quantity, round_even({FACTOR} * units / greatest(revenue_rank, 1), 1) AS threshold,
       {iso_time('ts')} AS timestamp"""
INVENTORY_WHERE = f"""revenue_rank <> -1 AND quantity >= {MIN_QUANTITY}
  AND quantity > {FACTOR} * (units / greatest(revenue_rank, 1))"""
REVENUE_SQL = f"""'high_value_transaction' AS alert_type, txn_id, customer_id, revenue, product_id,
       {iso_time('ts')} AS timestamp"""
TAIL = f"""{ENRICHED}, last_rows AS (
  SELECT * FROM enriched ORDER BY ts DESC, CAST(txn_id AS BIGINT) DESC, product_id DESC, revenue DESC LIMIT 500)"""


def last_messages(t):
    """The newest 500 messages by event time, with ids as tie-break."""
    rows = enriched(t)
    return feed.tail(
        feed.enriched_messages(rows).withColumn("_n", rows["txn_id"].cast("bigint")), 500,
        "timestamp", "_n", "product_id", "revenue",
    ).drop("_n")


@query("a15_product_lookup", f"""WITH {LOOKUP}
SELECT product_id, product_name, {r('total_revenue', 2)} AS total_revenue, total_units_sold, revenue_rank FROM lookup""")
def _(t):
    """A15 and W10."""
    return rounded(lookup(t), total_revenue=2)


@query("r01_enriched_feed", f"WITH {ENRICHED} SELECT {MESSAGE_SQL} FROM enriched")
def _(t):
    """R1 and J9 on the batch side."""
    return rounded(feed.enriched_messages(enriched(t)), unit_price=4)


@query("r02_inventory_alerts", f"WITH {ENRICHED} SELECT {INVENTORY_SQL} FROM enriched WHERE {INVENTORY_WHERE}")
def _(t):
    return feed.inventory_alerts(enriched(t), MIN_QUANTITY, FACTOR)


@query("r03_revenue_alerts", f"WITH {ENRICHED} SELECT {REVENUE_SQL} FROM enriched WHERE revenue > {REVENUE_LIMIT}")
def _(t):
    return feed.revenue_alerts(enriched(t), REVENUE_LIMIT)


@query("r05_labelled_alerts", f"""WITH {ENRICHED}
SELECT topic, label, alert_type, store_id, product_id, quantity, threshold, timestamp, txn_id, customer_id, revenue FROM (
  SELECT 'alerts.inventory' AS topic, '⚠️  INVENTORY' AS label, {INVENTORY_SQL}, NULL AS txn_id,
         NULL AS customer_id, NULL AS revenue FROM enriched WHERE {INVENTORY_WHERE}
  UNION ALL BY NAME
  SELECT 'alerts.revenue' AS topic, '💰 REVENUE' AS label, {REVENUE_SQL} FROM enriched WHERE revenue > {REVENUE_LIMIT})""")
def _(t):
    """R5 and S7."""
    rows = enriched(t)
    return feed.labelled_alerts(
        feed.inventory_alerts(rows, MIN_QUANTITY, FACTOR), feed.revenue_alerts(rows, REVENUE_LIMIT)
    )


@query("s08_last_messages", f"WITH {TAIL} SELECT {MESSAGE_SQL} FROM last_rows")
def _(t):
    return rounded(last_messages(t), unit_price=4)


@query("a18_feed_totals", f"""WITH {TAIL}
SELECT count(*) AS transactions, {r('sum(revenue)', 2)} AS total_revenue, count(DISTINCT product_id) AS unique_products,
       count(*) FILTER (is_top_seller) AS top_seller_hits FROM last_rows""")
def _(t):
    """A18 and R7."""
    return rounded(feed.feed_totals(last_messages(t)), total_revenue=2)


@query("a19_seller_mix", f"""WITH {TAIL}
SELECT CASE WHEN is_top_seller THEN 'Top Seller' ELSE 'Standard' END AS label, count(*) AS messages,
       {r('count(*) / (SELECT count(*) FROM last_rows)', 4)} AS share FROM last_rows GROUP BY 1""")
def _(t):
    return rounded(feed.seller_mix(last_messages(t)), share=4)


@query("r07_feed_countries", f"""WITH {TAIL}
SELECT country, {r('sum(revenue)', 2)} AS revenue FROM last_rows GROUP BY 1 ORDER BY sum(revenue) DESC, 1 LIMIT 10""")
def _(t):
    return rounded(analytics.revenue_by_country(last_messages(t)), revenue=2)
