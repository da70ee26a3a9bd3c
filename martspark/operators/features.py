"""Time-series features per (store, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martspark.functions.calendar import calendar_columns, event_code
from martspark.operators.ranking import global_row_number

SERIES = ["store_id", "item_id"]
TARGET = "unit_sales"

# Frames of the features and the dates the table starts from.
UNIT_LAGS = [1, 7, 14, 28, 364]
PRICE_LAGS = [1, 7]
MEAN_ROWS = [7, 14, 28]
STD_ROWS = [7, 28]
HISTORY_FROM = "2014-01-01"
OUTPUT_FROM = "2015-06-01"
STATE_BENEFITS = {"CA": "snap_CA", "TX": "snap_TX", "WI": "snap_WI"}

CATEGORIES = ["item_id", "store_id", "dept_id", "cat_id", "state_id"]
NOT_FEATURES = {"sale_date", "unit_sales", "sell_price", "snap_CA", "snap_TX", "snap_WI"}


def window_features(ordered: Window) -> dict[str, Column]:
    """All window features over one shared partitioning and ordering."""
    units, price = F.col("unit_sales"), F.col("sell_price")
    before = lambda n: ordered.rowsBetween(-n, -1)
    columns = {f"units_lag_{n}": F.lag(units, n).over(ordered) for n in UNIT_LAGS}
    columns |= {f"price_lag_{n}": F.lag(price, n).over(ordered) for n in PRICE_LAGS}
    columns |= {f"units_roll_mean_{n}": F.avg(units).over(before(n)) for n in MEAN_ROWS}
    columns |= {f"units_roll_std_{n}": F.stddev_samp(units).over(before(n)) for n in STD_ROWS}
    columns["price_roll_mean_7"] = F.avg(price).over(before(7))
    columns["units_expanding_mean"] = F.avg(units).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return columns


def item_features(
    sales: DataFrame,
    history_from: str = HISTORY_FROM,
    output_from: str = OUTPUT_FROM,
    state_benefits: dict[str, str] = STATE_BENEFITS,
) -> DataFrame:
    """Calendar, event, lag and rolling features at (store, item, day) grain.

    The input has one row per series and day, so a series is no longer than the
    calendar and the single exchange by series spreads the work over as many
    tasks as there are series. The early date bound sits below the windows and
    reaches the scan; the later one must stay above them, or lag 364 would lose
    its history.
    """
    benefit = F.lit(0)
    for state, column in state_benefits.items():
        benefit = F.when(F.col("state_id") == state, F.col(column)).otherwise(benefit)
    base = sales.filter(F.col("date") >= F.lit(history_from).cast("timestamp")).select(
        *CATEGORIES,
        F.to_date("date").alias("sale_date"),
        F.col("unit_sales").cast("float").alias("unit_sales"),
        F.col("sell_price").cast("float").alias("sell_price"),
        F.when(F.col("event_name_1") != "None", 1).otherwise(0).alias("is_event"),
        event_code(F.col("event_type_1")).alias("event_type"),
        benefit.alias("is_snap"),
    )
    features = base.withColumns(window_features(Window.partitionBy(*SERIES).orderBy("sale_date")))
    return features.withColumns(calendar_columns(F.col("sale_date"))).filter(
        (F.col("sale_date") >= F.lit(output_from).cast("date"))
        & F.col("units_lag_28").isNotNull()
        & F.col("units_lag_364").isNotNull()
    )


def sparse_item_features(sales: DataFrame, history_from: str = HISTORY_FROM, output_from: str = OUTPUT_FROM) -> DataFrame:
    """The features of ``item_features`` for the days on which a series sold, without its days of zero.

    Most products do not sell in a store on most days. Here a series holds its sales days
    only and a gap is a run of zeros: frames reach back by days instead of rows, a lag is what
    was sold exactly so many days before, and sums are divided by the days of the frame. The
    price of a day without a sale is the last known one; its trailing mean is the difference
    of two running sums of price times days. The number of rows is the number of sales days.

    ``sales`` has SERIES, ``date``, ``unit_sales`` and ``revenue``, any number of rows per day. Rows
    without a store, an item or a date belong to no series and are left out.
    """
    day = F.datediff(F.to_date("date"), F.lit("1970-01-01").cast("date"))
    daily = (
        sales.filter(F.col("date") >= F.lit(history_from).cast("timestamp")).dropna(subset=SERIES)
        .groupBy(*SERIES, F.to_date("date").alias("sale_date"), day.alias("_day"))
        .agg(F.sum("unit_sales").cast("double").alias("unit_sales"), F.sum("revenue").alias("_money"))
        .withColumn("sell_price", F.col("_money") / F.nullif(F.col("unit_sales"), F.lit(0.0)))
    )
    by_day = Window.partitionBy(*SERIES).orderBy("_day")
    frame = lambda n, end=1: by_day.rangeBetween(-n, -end)
    age = F.col("_day") - F.min("_day").over(by_day.rangeBetween(Window.unboundedPreceding, 0))
    known = F.last("sell_price", ignorenulls=True).over(by_day.rangeBetween(Window.unboundedPreceding, 0))
    rows = daily.withColumns({"_age": age, "sell_price": known})
    gap = F.col("_day") - F.lag("_day", 1).over(by_day)
    rows = rows.withColumn("_held", F.coalesce(F.lag("sell_price", 1).over(by_day) * gap, F.lit(0.0)))
    rows = rows.withColumn("_paid", F.sum("_held").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))

    def total(column: Column, n: int) -> Column:
        return F.coalesce(F.sum(column).over(frame(n)), F.lit(0.0))

    units, columns = F.col("unit_sales"), {}
    for n in UNIT_LAGS:
        columns[f"units_lag_{n}"] = F.when(F.col("_age") >= n, F.coalesce(F.sum(units).over(frame(n, n)), F.lit(0.0)))
    for n in PRICE_LAGS:
        columns[f"price_lag_{n}"] = F.last("sell_price").over(by_day.rangeBetween(Window.unboundedPreceding, -n))
    for n in MEAN_ROWS:
        columns[f"units_roll_mean_{n}"] = total(units, n) / F.nullif(F.least(F.lit(n), F.col("_age")), F.lit(0))
    for n in STD_ROWS:
        days = F.least(F.lit(n), F.col("_age"))
        around = total(units * units, n) - total(units, n) ** 2 / F.nullif(days, F.lit(0))
        columns[f"units_roll_std_{n}"] = F.when(days > 1, F.sqrt(F.greatest(around, F.lit(0.0)) / (days - 1)))
    before = F.last(F.struct("_paid", "sell_price", "_day")).over(by_day.rangeBetween(Window.unboundedPreceding, -7))
    paid = before["_paid"] + before["sell_price"] * (F.col("_day") - 7 - before["_day"])
    columns["price_roll_mean_7"] = (F.col("_paid") - F.coalesce(paid, F.lit(0.0))) / F.nullif(
        F.least(F.lit(7), F.col("_age")), F.lit(0))
    columns["units_expanding_mean"] = F.sum(units).over(
        by_day.rangeBetween(Window.unboundedPreceding, -1)) / F.nullif(F.col("_age"), F.lit(0))
    return rows.withColumns(columns).withColumns(calendar_columns(F.col("sale_date"))).filter(
        (F.col("sale_date") >= F.lit(output_from).cast("date")) & F.col("units_lag_364").isNotNull()
    ).drop("_day", "_age", "_money", "_held", "_paid")


def feature_columns(features: DataFrame) -> list[str]:
    """Every column but the target, the date and the raw price and benefit flags."""
    return [c for c in features.columns if c not in NOT_FEATURES]


def write_features(features: DataFrame, path: str) -> None:
    """Compressed Parquet with a folder per store and sorted series, for pruned point reads."""
    (
        features.repartition("store_id", "item_id")
        .sortWithinPartitions("store_id", "item_id", "sale_date")
        .write.mode("overwrite").option("compression", "snappy").partitionBy("store_id").parquet(path)
    )


def one_series(features: DataFrame, store_id: str, item_id: str) -> DataFrame:
    """Point lookup; the store filter prunes folders and the item filter reaches the scan."""
    return features.filter((F.col("store_id") == store_id) & (F.col("item_id") == item_id))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Code 0, 1, 2, … of each distinct value in ascending order of its text.

    The codes are a table to save and join, so the number of labels is not bound
    by what the driver can hold.
    """
    labels = df.select(F.col(column).cast("string").alias(column)).filter(F.col(column).isNotNull()).distinct()
    return global_row_number(labels, [F.col(column)], "_n").select(column, (F.col("_n") - 1).alias(f"{column}_code"))


def encoded(df: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    """Add the code of every category; a label that was not fitted gets -1. The labels stay."""
    for column, table in codes.items():
        df = df.join(table, column, "left").withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(-1)))
    return df
