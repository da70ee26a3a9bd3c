"""Mart layer: the tables that reports and models read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martspark.functions.numeric import ratio, stable_round
from martspark.operators.frames import trailing_frames
from martspark.operators.ranking import descending, global_rank
from martspark.session import written

BASELINE_ROWS = 28
SPIKE_FACTOR = 2.0


def spike_flag(value: Column, baseline: Column) -> Column:
    return F.coalesce((baseline > 0) & (value > SPIKE_FACTOR * baseline), F.lit(False))


def daily_demand(daily_sales: DataFrame) -> DataFrame:
    """Daily demand with the average of the 28 rows before it in the same store.

    Several departments share a store-day, so a frame ordered by date alone would
    depend on row order; department and category complete the order. The frame
    counts rows, not days (see ``store_day_baseline`` for days).
    """
    quarter = F.year("sale_date") * 4 + F.quarter("sale_date")
    framed = trailing_frames(
        daily_sales, ["store_id"], ["sale_date", "dept_id", "cat_id"], quarter, BASELINE_ROWS,
        {"revenue_28d_avg": F.avg("total_revenue"), "units_28d_avg": F.avg("total_units")},
    )
    return framed.select(
        "sale_date", "store_id", "state_id", "dept_id", "cat_id", "total_units", "total_revenue", "avg_price",
        "unique_items_sold", "revenue_28d_avg", "units_28d_avg",
        spike_flag(F.col("total_revenue"), F.col("revenue_28d_avg")).alias("is_revenue_spike"),
    )


def store_day_baseline(daily_sales: DataFrame) -> DataFrame:
    """Store totals per day with the average of the 28 calendar days before.

    One row per store and day, so a store's window holds no more rows than the
    calendar has days.
    """
    days = daily_sales.groupBy("store_id", "sale_date").agg(
        F.sum("total_revenue").alias("total_revenue"), F.sum("total_units").alias("total_units")
    )
    number = F.datediff("sale_date", F.lit("1970-01-01").cast("date"))
    window = Window.partitionBy("store_id").orderBy(number).rangeBetween(-BASELINE_ROWS, -1)
    return days.select(
        "*", F.avg("total_revenue").over(window).alias("revenue_28d_avg"),
        F.avg("total_units").over(window).alias("units_28d_avg"),
    ).withColumn("is_revenue_spike", spike_flag(F.col("total_revenue"), F.col("revenue_28d_avg")))


def product_totals(transactions: DataFrame) -> DataFrame:
    """Totals per product.

    An invoice has one customer and one date. Lines are moved once, to their product
    and customer, where invoices are counted and the sums reduced; the selling days come from the
    distinct days, so no line is expanded once per distinct count. Names are reduced apart from
    that: no line carries its name along, and the counts need no sorting for a text.
    """
    lines = transactions.select(
        "product_id", "customer_id", "invoice_id", "invoice_date", "quantity", "revenue", "unit_price")
    by_customer = lines.repartition("product_id", "customer_id").groupBy("product_id", "customer_id").agg(
        F.countDistinct("invoice_id").alias("invoices"),
        F.sum("quantity").alias("units"), F.sum("revenue").alias("revenue"), F.sum("unit_price").alias("prices"),
        F.count("unit_price").alias("priced"), F.min("invoice_date").alias("lo"), F.max("invoice_date").alias("hi"),
    )
    totals = by_customer.groupBy("product_id").agg(
        F.count("customer_id").alias("unique_customers"),
        F.sum("invoices").alias("total_invoices"),
        F.sum("units").alias("total_units_sold"),
        F.sum("revenue").alias("total_revenue"),
        ratio(F.sum("prices"), F.sum("priced")).alias("avg_unit_price"),
        F.min("lo").alias("first_sale_date"),
        F.max("hi").alias("last_sale_date"),
    )
    days = transactions.groupBy(F.col("product_id").alias("_sold")).agg(
        F.countDistinct("invoice_date").alias("active_selling_days"))
    names = transactions.groupBy(F.col("product_id").alias("_named")).agg(F.max("product_name").alias("product_name"))
    same = lambda key: F.col("product_id").eqNullSafe(F.col(key))
    return totals.join(days, same("_sold")).join(names, same("_named")).select(
        "product_id", "product_name", *totals.columns[1:], "active_selling_days")


def product_performance(transactions: DataFrame) -> DataFrame:
    """Product totals with ranks by revenue and by units.

    The totals are written once: each rank reads them twice, and without the
    written copy every read would run the aggregation over all lines again. It
    also fixes the sums, so equal revenues stay equal in every pass. Revenue is
    compared to four decimals, so that totals which differ only by the order of
    addition tie.
    """
    totals = written(product_totals(transactions), "product-totals")
    ranked = global_rank(totals, descending(F.round("total_revenue", 4)), "revenue_rank")
    ranked = global_rank(ranked, descending(F.col("total_units_sold")), "volume_rank")
    return ranked.withColumn("revenue_per_day", ratio(F.col("total_revenue"), F.col("active_selling_days")))


def store_dimension(sales: DataFrame, daily_sales: DataFrame) -> DataFrame:
    """Stores with all-time metrics; the daily table is reduced to one row per store before the join."""
    stores = sales.select("store_id", "state_id").distinct().select(
        "store_id",
        "state_id",
        F.split_part(F.col("store_id"), F.lit("_"), F.lit(1)).alias("state_code"),
        F.split_part(F.col("store_id"), F.lit("_"), F.lit(2)).try_cast("int").alias("store_number"),
    )
    metrics = daily_sales.groupBy("store_id").agg(
        F.sum("total_revenue").alias("total_revenue_all_time"),
        F.sum("total_units").alias("total_units_all_time"),
        F.countDistinct("sale_date").alias("active_days"),
        F.min("sale_date").alias("first_sale_date"),
        F.max("sale_date").alias("last_sale_date"),
    )
    return stores.join(metrics, "store_id", "left")


def daily_kpis(transactions: DataFrame) -> DataFrame:
    """KPIs per day; lines are reduced to invoices before invoices and customers are counted."""
    day = F.col("invoice_date").alias("kpi_date")
    invoices = transactions.groupBy(day, "invoice_id", "customer_id").agg(
        F.sum("quantity").alias("units"), F.sum("revenue").alias("revenue"))
    days = invoices.groupBy("kpi_date").agg(
        F.countDistinct("invoice_id").alias("total_orders"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.sum("units").alias("total_units"),
        F.sum("revenue").alias("total_revenue"),
    )
    products = transactions.groupBy(day).agg(F.countDistinct("product_id").alias("unique_products_sold"))
    same = days["kpi_date"].eqNullSafe(products["kpi_date"])
    return days.join(products, same).drop(products["kpi_date"]).withColumn(
        "avg_basket_size", ratio(F.col("total_revenue"), F.col("total_orders")))


def executive_kpis(transactions: DataFrame) -> DataFrame:
    """Daily KPIs with rolling sums, a trailing baseline and week-over-week change.

    The windows have no partition key, yet they run over one row per calendar
    day: the table is as long as the calendar, whatever the number of sales. All
    frames count rows, so a lag of 7 is seven trading days.
    """
    by_day = Window.orderBy("kpi_date")
    trends = daily_kpis(transactions).select(
        "*",
        F.sum("total_revenue").over(by_day.rowsBetween(-6, 0)).alias("rolling"),
        F.avg("total_revenue").over(by_day.rowsBetween(-BASELINE_ROWS, -1)).alias("baseline"),
        F.lag("total_revenue", 7).over(by_day).alias("last_week"),
        F.lag("total_orders", 7).over(by_day).alias("orders_last_week"),
        F.lag("unique_customers", 7).over(by_day).alias("customers_last_week"),
    )
    change = 100.0 * (F.col("total_revenue") - F.col("last_week")) / F.col("last_week")
    return trends.select(
        "kpi_date",
        "total_orders",
        "unique_customers",
        "total_units",
        stable_round(F.col("total_revenue"), 2).alias("total_revenue"),
        stable_round(F.col("avg_basket_size"), 2).alias("avg_basket_size"),
        "unique_products_sold",
        stable_round(F.col("rolling"), 2).alias("revenue_7d_rolling"),
        stable_round(F.col("baseline"), 2).alias("revenue_28d_baseline"),
        stable_round(F.col("last_week"), 2).alias("revenue_last_week"),
        "orders_last_week",
        "customers_last_week",
        F.when(F.col("last_week") > 0, stable_round(change, 2)).alias("revenue_wow_pct"),
        spike_flag(F.col("total_revenue"), F.col("baseline")).alias("is_revenue_spike"),
    )


def recommender_interactions(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("interaction_score") > 0).select(
        "user_id", "product_id", "product_name", "department", "aisle", "total_orders", "reorder_count",
        "interaction_score",
    )
