"""Cleaning jobs: raw extracts to the raw layer of the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martspark.functions.numeric import clean_count, clean_price, discount_percent, number_or_null
from martspark.operators.ranking import global_row_number

PRODUCT_CODE = r"^[0-9]{5}$"


def clean_invoices(raw: DataFrame) -> DataFrame:
    """Keep real sales of real products to known customers and name the columns.

    Dropped are cancelled invoices (prefix C), codes that are not five digits,
    quantities or prices that are not positive, and rows without customer or
    description.
    """
    kept = raw.filter(
        ~F.coalesce(F.col("Invoice").startswith("C"), F.lit(False))
        & F.col("StockCode").rlike(PRODUCT_CODE)
        & (F.col("Quantity") > 0)
        & (F.col("Price") > 0)
    ).dropna(subset=["Customer ID", "Description"])
    return kept.select(
        F.col("Invoice").alias("invoice_id"),
        F.col("StockCode").alias("product_id"),
        F.col("Description").alias("description"),
        F.col("Quantity").alias("quantity"),
        F.col("InvoiceDate").alias("invoice_date"),
        F.col("Price").alias("unit_price"),
        F.col("Customer ID").cast("bigint").alias("customer_id"),
        F.col("Country").alias("country"),
        (F.col("Quantity") * F.col("Price")).alias("revenue"),
    )


def load_retention(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows in and out, share dropped, distinct keys and date range of a cleaning run."""
    rows_in = raw.agg(F.count(F.lit(1)).alias("rows_in"))
    return clean.agg(
        F.count(F.lit(1)).alias("rows_out"),
        F.countDistinct("customer_id").alias("customers"),
        F.countDistinct("product_id").alias("products"),
        F.min("invoice_date").alias("first_date"),
        F.max("invoice_date").alias("last_date"),
    ).select(
        rows_in.scalar().alias("rows_in"), "rows_out", "customers", "products", "first_date", "last_date"
    ).withColumn("pct_dropped", (1 - F.col("rows_out") / F.nullif(F.col("rows_in"), F.lit(0))) * 100)


def melt_days(wide: DataFrame, id_columns: list[str], day_columns: list[str]) -> DataFrame:
    """Wide day columns to rows; missing units count 0 and returns are clipped at 0.

    An array of (name, value) pairs is exploded, so the plan stays one generator
    however many day columns there are.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("d"), F.col(c).cast("int").alias("unit_sales")) for c in day_columns])
    return wide.select(*id_columns, F.explode(pairs).alias("p")).select(
        *id_columns,
        F.col("p.d").alias("d"),
        F.greatest(F.coalesce("p.unit_sales", F.lit(0)), F.lit(0)).alias("unit_sales"),
    )


def filled_calendar(calendar: DataFrame) -> DataFrame:
    """Calendar with the event columns filled and only the used columns kept."""
    return calendar.select(
        F.col("date").cast("timestamp").alias("date"), "wm_yr_wk", "weekday", "wday", "month", "year", "d",
        F.coalesce("event_name_1", F.lit("None")).alias("event_name_1"),
        F.coalesce("event_type_1", F.lit("None")).alias("event_type_1"),
        "snap_CA", "snap_TX", "snap_WI",
    )


def priced_sales(long_sales: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """Sales with calendar and price; item-weeks without a positive price are dropped.

    The lookup of a price followed by dropping rows without one is an inner
    join, and the calendar supplies the week that the price is keyed by.
    """
    good = prices.filter(F.col("sell_price") > 0)
    return (
        long_sales.join(filled_calendar(calendar), "d", "left")
        .join(good, ["store_id", "item_id", "wm_yr_wk"])
        .withColumn("revenue", F.col("unit_sales") * F.col("sell_price"))
    )


def labelled_orders(orders: DataFrame) -> DataFrame:
    """Orders outside the held-back split, with the gap of a first order set to 0."""
    return orders.filter(F.col("eval_set") != "test").withColumn(
        "days_since_prior_order", F.coalesce("days_since_prior_order", F.lit(0.0)).cast("int")
    )


def clean_interactions(
    orders: DataFrame,
    order_lines: DataFrame,
    products: DataFrame,
    aisles: DataFrame,
    departments: DataFrame,
    min_orders: int = 3,
    tasks: int | None = None,
) -> DataFrame:
    """Order lines with order, product, aisle and department, for users with enough orders.

    Lines whose order is not labelled have no user and fall out with the user
    filter, as a NULL user belongs to no group. ``tasks`` cuts the product join, and what is
    grouped by product after it, into that many parts: adaptive execution joins partitions by their
    compressed size, and repeating ids and names are many times that size in memory.
    """
    kept_orders = labelled_orders(orders).select(
        "order_id", "user_id", "order_number", "order_dow", "order_hour_of_day", "days_since_prior_order"
    )
    named = products.join(aisles, "aisle_id", "left").join(departments, "department_id", "left")
    lines = order_lines.join(kept_orders, "order_id").filter(F.col("user_id").isNotNull())
    kept = lines.join(active_users(lines, min_orders), "user_id", "left_semi")
    if tasks:
        kept = kept.repartition(tasks, "product_id")
    return kept.join(named, "product_id", "left")


def active_users(lines: DataFrame, min_orders: int = 3) -> DataFrame:
    """Users with at least ``min_orders`` distinct orders."""
    return (
        lines.groupBy("user_id")
        .agg(F.countDistinct("order_id").alias("orders"))
        .filter(F.col("orders") >= min_orders)
        .select("user_id")
    )


def clean_catalog(raw: DataFrame) -> DataFrame:
    """Catalog with numeric prices, ratings and counts, a discount and a running id.

    The id numbers the named rows in name order (link breaks ties), which does
    not depend on how the input was split into files.
    """
    typed = raw.dropna(subset=["name"]).select(
        F.col("name").alias("product_name"),
        F.col("main_category").alias("category"),
        "sub_category",
        number_or_null(F.col("ratings")).alias("avg_rating"),
        clean_count(F.col("no_of_ratings")).alias("rating_count"),
        clean_price(F.col("discount_price")).alias("sale_price"),
        clean_price(F.col("actual_price")).alias("list_price"),
        "link",
    )
    priced = typed.withColumn("discount_pct", discount_percent(F.col("list_price"), F.col("sale_price")))
    numbered = global_row_number(priced, [F.col("product_name"), F.col("link")], "position")
    return numbered.select(
        F.format_string("AMZN_%06d", F.col("position") - 1).alias("product_id"),
        "product_name", "category", "sub_category", "avg_rating", "rating_count", "sale_price", "list_price",
        "discount_pct",
    )
