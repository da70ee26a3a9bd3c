"""Logical retail tables derived from the star-schema Parquet files.

Each function returns a lazy frame. Dimension joins are left joins on unique
keys, so a caller that does not need a dimension's columns can leave the join
out and get the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martspark.sources.readers import read_parquet


class Tables:
    """Named Parquet tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __call__(self, name: str, *columns: str) -> DataFrame:
        frame = read_parquet(self.spark, f"{self.folder}/{name}.parquet")
        return frame.select(*columns) if columns else frame

    def state(self) -> int:
        """A number that changes when any file below the folder is replaced, added or removed."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.folder)
        mark = F.xxhash64("path", "modificationTime", "length")
        return files.select(mark.alias("h")).agg(F.coalesce(F.bit_xor("h"), F.lit(0))).first()[0]


# ---------------------------------------------------------------- transactions

TRANSACTION_DIMENSIONS = ("country", "description")


def transactions(t: Tables, dimensions: Sequence[str] = TRANSACTION_DIMENSIONS) -> DataFrame:
    """Invoice lines: one row per order line with customer, product and money.

    Customer and country are looked up once per order, before the lines join: the lines, which are
    the largest table by far, are moved for the order and for the product only.
    """
    lines = t("lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    orders = t("orders", "o_orderkey", "o_custkey", "o_orderdate")
    columns = {
        "invoice_id": F.col("o_orderkey"),
        "product_id": F.col("l_partkey"),
        "quantity": F.col("l_quantity").cast("int"),
        "invoice_date": F.col("o_orderdate").cast("timestamp"),
        "unit_price": F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)),
        "customer_id": F.col("o_custkey"),
        "revenue": F.col("l_extendedprice"),
    }
    if "country" in dimensions:
        customer = t("customer", "c_custkey", "c_nationkey")
        nation = t("nation", "n_nationkey", "n_name")
        orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        orders = orders.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        columns["country"] = F.col("n_name")
    df = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "description" in dimensions:
        df = df.join(t("part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
        columns["description"] = F.col("p_name")
    return df.select(*[c.alias(name) for name, c in columns.items()])


def raw_invoices(t: Tables, line_status: str) -> DataFrame:
    """One of the two yearly extracts in the form the invoice cleaner reads.

    Returned lines become cancelled invoices, some codes get a letter or a word
    as in a real extract, and some quantities, prices, customers and
    descriptions are made unusable by fixed rules on the line's own values.
    """
    lines = t(
        "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_returnflag", "l_linestatus",
    ).filter(F.col("l_linestatus") == line_status)
    orders = t("orders", "o_orderkey", "o_custkey", "o_orderdate")
    part = t("part", "p_partkey", "p_name")
    customer = t("customer", "c_custkey", "c_nationkey")
    nation = t("nation", "n_nationkey", "n_name")
    cents = F.round(F.col("l_discount") * 100).cast("int")
    code = F.format_string("%05d", F.col("l_partkey"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.concat(F.when(F.col("l_returnflag") == "R", "C").otherwise(""), F.col("l_orderkey").cast("string"))
            .alias("Invoice"),
            F.when(F.col("l_linenumber") == 7, "POST")
            .when(F.col("l_linenumber") == 6, F.concat(code, F.lit("A")))
            .otherwise(code)
            .alias("StockCode"),
            F.when(cents != 10, F.col("p_name")).alias("Description"),
            F.when(cents == 9, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("int").alias("Quantity"),
            F.col("o_orderdate").cast("timestamp").alias("InvoiceDate"),
            F.when(cents == 8, 0.0).otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("Price"),
            F.when(cents != 7, F.col("o_custkey").cast("double")).alias("Customer ID"),
            F.col("n_name").alias("Country"),
        )
    )


# ----------------------------------------------------------------------- sales


def sales(t: Tables) -> DataFrame:
    """Item sales per store: state is a region, store a supplier's nation."""
    lines = t("lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    supplier = t("supplier", "s_suppkey", "s_nationkey")
    nation = t("nation", "n_nationkey", "n_regionkey")
    region = t("region", "r_regionkey", "r_name")
    part = t("part", "p_partkey", "p_brand", "p_type")
    state = F.upper(F.substring("r_name", 1, 2))
    store = F.concat_ws("_", state, F.col("n_nationkey").cast("string"))
    return (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select(
            F.concat_ws("_", F.col("l_partkey").cast("string"), store).alias("id"),
            F.col("l_partkey").alias("item_id"),
            F.col("p_brand").alias("dept_id"),
            F.col("p_type").alias("cat_id"),
            store.alias("store_id"),
            state.alias("state_id"),
            F.col("l_shipdate").cast("timestamp").alias("date"),
            F.col("l_quantity").cast("int").alias("unit_sales"),
            (F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))).alias("sell_price"),
            F.col("l_extendedprice").alias("revenue"),
        )
    )


@lru_cache(maxsize=8)
def _shipping_range(spark: SparkSession, folder: str, state: int):
    """First and last shipping day, read once per session and state of the folder's files."""
    day = F.to_date("l_shipdate")
    return tuple(Tables(spark, folder)("lineitem", "l_shipdate").agg(F.min(day), F.max(day)).first())


def calendar(t: Tables) -> DataFrame:
    """One row per day of the shipping range, with week number, events and benefit days."""
    low, high = (F.lit(day).cast("date") for day in _shipping_range(t.spark, t.folder, t.state()))
    days = t.spark.range(1).select(F.explode(F.sequence(low, high)).alias("date"), low.alias("lo"))
    return days.select(*_calendar_fields(F.col("date"), F.datediff("date", "lo") + 1))


def _calendar_fields(date: Column, position: Column) -> list[Column]:
    yday = F.dayofyear(date)
    event = F.when(yday % 37 == 0, F.concat(F.lit("Event"), (yday / 37).cast("int").cast("string")))
    kind = F.element_at(
        F.array(F.lit("Sporting"), F.lit("Cultural"), F.lit("National"), F.lit("Religious")),
        ((yday / 37).cast("int") % 4 + 1),
    )
    benefit = lambda rest: F.when(F.dayofmonth(date) % 3 == rest, 1).otherwise(0)
    return [
        date.alias("date"),
        F.concat(F.lit("d_"), position.cast("string")).alias("d"),
        (F.floor((position - 1) / 7) + 1).cast("int").alias("wm_yr_wk"),
        F.date_format(date, "EEEE").alias("weekday"),
        F.dayofweek(date).alias("wday"),
        F.month(date).alias("month"),
        F.year(date).alias("year"),
        event.alias("event_name_1"),
        F.when(yday % 37 == 0, kind).alias("event_type_1"),
        benefit(0).alias("snap_CA"),
        benefit(1).alias("snap_TX"),
        benefit(2).alias("snap_WI"),
    ]


# Which benefit-day column applies to each state of the test tables.
STATE_BENEFIT_COLUMNS = {"AF": "snap_CA", "AM": "snap_TX", "AS": "snap_WI"}


def item_sales(t: Tables) -> DataFrame:
    """Dense daily series per (state store, category item) with calendar columns.

    Lines are summed to the day before anything is ordered, so a series holds at
    most one row per calendar day however many lines a hot item has. Days
    without sales count 0 units and keep the last known price.
    """
    from pyspark.sql import Window

    daily = (
        sales(t)
        .groupBy("state_id", "cat_id", F.to_date("date").alias("date"))
        .agg(F.sum("unit_sales").alias("units"), F.sum("revenue").alias("money"))
    )
    spans = daily.groupBy("state_id", "cat_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = spans.select("state_id", "cat_id", F.explode(F.sequence("lo", "hi")).alias("date"))
    by_day = Window.partitionBy("state_id", "cat_id").orderBy("date")
    price = F.col("money") / F.nullif(F.col("units"), F.lit(0))
    dense = (
        grid.join(daily, ["state_id", "cat_id", "date"], "left")
        .withColumn("sell_price", F.last(price, ignorenulls=True).over(by_day))
    )
    days = calendar(t).select("date", "event_name_1", "event_type_1", "snap_CA", "snap_TX", "snap_WI")
    return dense.join(days, "date", "left").select(
        F.concat_ws("_", "cat_id", F.lit("1")).alias("item_id"),
        F.concat_ws("_", "state_id", F.lit("1")).alias("store_id"),
        F.col("cat_id").alias("dept_id"),
        "cat_id",
        "state_id",
        F.col("date").cast("timestamp").alias("date"),
        F.coalesce("units", F.lit(0)).cast("int").alias("unit_sales"),
        "sell_price",
        F.coalesce("event_name_1", F.lit("None")).alias("event_name_1"),
        F.coalesce("event_type_1", F.lit("None")).alias("event_type_1"),
        "snap_CA",
        "snap_TX",
        "snap_WI",
    )


def wide_sales(t: Tables) -> DataFrame:
    """Sales with one column per weekday slot of a week, as in a wide extract.

    Weeks replace the long list of days so that the wide table keeps one row per
    (item, store, week); the slots ``d_1``..``d_7`` are then unpivoted.
    """
    base = sales(t).withColumn("day", F.to_date("date"))
    slot = F.dayofweek("day")
    return (
        base.groupBy("item_id", "dept_id", "cat_id", "store_id", "state_id", F.date_trunc("week", "day").cast("date").alias("week"))
        .agg(*[F.sum(F.when(slot == k, F.col("unit_sales"))).alias(f"d_{k}") for k in range(1, 8)])
    )


# ---------------------------------------------------------------- interactions


def order_headers(t: Tables) -> DataFrame:
    """Orders with the split label, sequence number and time fields of the cleaner's input."""
    day_number = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    return t("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "P", "test")
        .when(F.col("o_orderstatus") == "O", "train")
        .otherwise("prior")
        .alias("eval_set"),
        (F.floor(day_number / 30) + 1).cast("int").alias("order_number"),
        (F.dayofweek("o_orderdate") - 1).alias("order_dow"),
        (F.col("o_orderkey") % 24).cast("int").alias("order_hour_of_day"),
        F.nullif(F.col("o_orderkey") % 31, F.lit(0)).cast("double").alias("days_since_prior_order"),
    )


def order_lines(t: Tables, line_status: str) -> DataFrame:
    """Order × product rows of one split."""
    return (
        t("lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
        .filter(F.col("l_linestatus") == line_status)
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_linenumber").alias("add_to_cart_order"),
            F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("reordered"),
        )
    )


def _department_id() -> Column:
    return F.length("p_type") * 100 + F.ascii("p_type")


def catalog_products(t: Tables) -> DataFrame:
    return t("part", "p_partkey", "p_name", "p_brand", "p_type").select(
        F.col("p_partkey").alias("product_id"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("product_name"),
        F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int").alias("aisle_id"),
        _department_id().cast("int").alias("department_id"),
    )


def aisles(t: Tables) -> DataFrame:
    return t("part", "p_brand").distinct().select(
        F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int").alias("aisle_id"),
        F.col("p_brand").alias("aisle"),
    )


def departments(t: Tables) -> DataFrame:
    return t("part", "p_type").distinct().select(
        _department_id().cast("int").alias("department_id"), F.col("p_type").alias("department")
    )


# --------------------------------------------------------------------- catalog


def raw_catalog(t: Tables) -> DataFrame:
    """Catalog rows with prices, ratings and counts as text, as a shop export has them."""
    key = F.col("p_partkey")
    sale = F.col("p_retailprice") * (1 - (F.col("p_size") % 7) / 10)
    money = lambda value: F.concat(F.lit("₹"), F.format_number(value, 2))
    return t("part").select(
        F.concat_ws(" ", "p_name", key.cast("string")).alias("name"),
        F.col("p_brand").alias("main_category"),
        F.col("p_type").alias("sub_category"),
        F.concat(F.lit("img/"), key.cast("string")).alias("image"),
        F.concat(F.lit("dp/"), key.cast("string")).alias("link"),
        F.when(key % 13 == 0, "Get").otherwise(F.format_string("%.1f", F.col("p_size") / 10)).alias("ratings"),
        F.when(key % 17 == 0, F.lit(None)).otherwise(F.format_number(key * 7, 0)).alias("no_of_ratings"),
        F.when(key % 11 != 0, money(sale)).alias("discount_price"),
        F.when(key % 19 == 0, "nan").otherwise(money(F.col("p_retailprice"))).alias("actual_price"),
    )


# ------------------------------------------------------------------ event logs


def request_log(t: Tables) -> DataFrame:
    """Served requests: endpoint, client, time and latency."""
    return t("events", "event_id", "ts", "user_id", "event_type", "value").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("endpoint"),
        F.col("user_id").alias("client"),
        F.col("value").alias("latency"),
    )
