"""Demand model, its evaluation and the recursive forecast of all series."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martspark.functions.numeric import stable_round
from martspark.operators.features import (
    CATEGORIES, MEAN_ROWS, PRICE_LAGS, SERIES, STD_ROWS, UNIT_LAGS, encoded, feature_columns, label_codes,
)
from martspark.plans.analytics import within
from martspark.session import written


@dataclass(frozen=True)
class Fold:
    name: str
    train_start: str
    train_end: str
    val_start: str
    val_end: str


# The three rolling-origin folds (ends exclusive) and the model's variance power.
FOLDS = [
    Fold("fold_1", "2015-06-01", "2015-09-01", "2015-09-01", "2015-12-01"),
    Fold("fold_2", "2015-06-01", "2015-12-01", "2015-12-01", "2016-03-01"),
    Fold("fold_3", "2015-06-01", "2016-01-01", "2016-01-01", "2016-05-22"),
]
VARIANCE_POWER = 1.5
MIN_SCALE = 0.1
HORIZON, MAX_HORIZON = 28, 56
HISTORY_ROWS = 364
BLOCK_SERIES = 2048


def between_dates(df: DataFrame, start: str, end: str) -> DataFrame:
    day = F.col("sale_date")
    return df.filter((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date")))


def fold_sizes(features: DataFrame, folds: list[Fold] = FOLDS) -> DataFrame:
    """Training and validation rows per fold, counted in one pass."""
    day = F.col("sale_date")
    inside = lambda a, b: F.count_if((day >= F.lit(a).cast("date")) & (day < F.lit(b).cast("date")))
    counted = features.agg(*[
        F.struct(
            F.lit(f.name).alias("fold"), inside(f.train_start, f.train_end).alias("train_rows"),
            inside(f.val_start, f.val_end).alias("val_rows"),
        ).alias(f.name)
        for f in folds
    ])
    return counted.select(F.inline(F.array(*[F.col(f.name) for f in folds])))


# --------------------------------------------------------------------- metrics


def naive_scale(history: DataFrame) -> DataFrame:
    """Mean absolute one-day change per series."""
    ordered = Window.partitionBy(*SERIES).orderBy("sale_date")
    change = F.abs(F.col("unit_sales") - F.lag("unit_sales", 1).over(ordered))
    return history.select(*SERIES, change.alias("_c")).groupBy(*SERIES).agg(F.avg("_c").alias("scale"))


def series_rmse(predicted: DataFrame) -> DataFrame:
    error = F.col("unit_sales") - F.col("prediction")
    return predicted.groupBy(*SERIES).agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def series_scores(full: DataFrame, predicted: DataFrame, val_start: str) -> DataFrame:
    """RMSE over scale per series; the scale uses all rows before validation, and
    series that hardly move (scale below 0.1) are left out."""
    history = full.filter(F.col("sale_date") < F.lit(val_start).cast("date"))
    both = series_rmse(predicted).join(naive_scale(history), SERIES).dropna(subset=["rmse", "scale"])
    return both.filter(F.col("scale") >= MIN_SCALE).withColumn("rmsse", F.col("rmse") / F.col("scale"))


def rmsse(full: DataFrame, predicted: DataFrame, val_start: str) -> DataFrame:
    return series_scores(full, predicted, val_start).agg(
        F.count(F.lit(1)).alias("active_series"), F.avg("rmsse").alias("val_rmsse")
    )


def error_metrics(predicted: DataFrame) -> DataFrame:
    """Mean absolute error and bias of predictions clipped at 0."""
    clipped = F.greatest(F.col("prediction"), F.lit(0.0))
    return predicted.agg(
        F.avg(F.abs(F.col("unit_sales") - clipped)).alias("mae"), F.avg(clipped - F.col("unit_sales")).alias("bias")
    )


# ----------------------------------------------------------------------- model


@dataclass
class DemandModel:
    """Fitted regression with its label codes and the order of its inputs."""

    stages: PipelineModel | None
    codes: dict[str, DataFrame]
    inputs: list[str]

    def coded(self, features: DataFrame) -> DataFrame:
        """Features with label codes, unless they carry them already."""
        missing = {c: table for c, table in self.codes.items() if f"{c}_code" not in features.columns}
        return encoded(features, missing)

    def predict(self, features: DataFrame) -> DataFrame:
        ready = model_input(self.coded(features), self.inputs)
        scored = self.stages.transform(ready).drop("_raw", "_scaled")
        return scored.withColumn("prediction", F.greatest(F.col("prediction"), F.lit(0.0)))

    def predictor(self) -> "LinearPredictor":
        fitted, scaler = self.stages.stages[-1], self.stages.stages[1]
        std = scaler.std.toArray()
        slope = fitted.coefficients.toArray() * np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 0.0)
        return LinearPredictor(float(fitted.intercept - (scaler.mean.toArray() * slope).sum()), slope)

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(f"{path}/stages")
        for column, table in self.codes.items():
            table.write.mode("overwrite").parquet(f"{path}/codes/{column}")

    @staticmethod
    def load(spark: SparkSession, path: str, inputs: list[str]) -> "DemandModel":
        codes = {c: spark.read.parquet(f"{path}/codes/{c}") for c in CATEGORIES}
        return DemandModel(PipelineModel.load(f"{path}/stages"), codes, inputs)


def model_inputs(features: DataFrame) -> list[str]:
    """Feature columns with each category replaced by its code."""
    plain = [c for c in feature_columns(features) if not c.endswith("_code")]
    return [f"{c}_code" if c in CATEGORIES else c for c in plain]


def model_input(df: DataFrame, inputs: list[str]) -> DataFrame:
    """Inputs as doubles; an undefined deviation or price lag counts 0."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs})


def fit_codes(features: DataFrame) -> dict[str, DataFrame]:
    """Label codes of all categories, written once and reused by every model."""
    return {c: written(label_codes(features, c), f"codes-{c}") for c in CATEGORIES}


def fit_demand_model(train: DataFrame, codes: dict[str, DataFrame], max_iter: int = 25) -> DemandModel:
    """Tweedie regression with log link on standardised features.

    The fit passes over its input once per iteration, so the coded rows are
    written before it starts and the code lookups run only once.
    """
    inputs = model_inputs(train)
    model = DemandModel(None, codes, inputs)
    target = F.col("unit_sales").cast("double").alias("unit_sales")
    ready = written(model_input(model.coded(train), inputs).select(*inputs, target), "training-rows")
    stages = Pipeline(stages=[
        VectorAssembler(inputCols=inputs, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        GeneralizedLinearRegression(
            family="tweedie", variancePower=VARIANCE_POWER, linkPower=0.0, featuresCol="_scaled",
            labelCol="unit_sales", regParam=0.1, maxIter=max_iter,
        ),
    ])
    model.stages = stages.fit(ready)
    return model


def cross_validate(features: DataFrame, folds: list[Fold] = FOLDS) -> tuple[DataFrame, dict[str, DemandModel]]:
    """One row of metrics per fold and the fitted models.

    The features are read many times, so they are expected to be a table (see
    ``written``); their coded form is written once for all folds.
    """
    codes = fit_codes(features)
    features = written(encoded(features, codes), "coded-features")
    models, rows = {}, []
    for fold in folds:
        train = between_dates(features, fold.train_start, fold.train_end)
        model = fit_demand_model(train, codes)
        predicted = model.predict(between_dates(features, fold.val_start, fold.val_end))
        fit_error = error_metrics(model.predict(train)).select(F.col("mae").alias("train_mae"))
        models[fold.name] = model
        metrics = error_metrics(predicted).withColumnsRenamed({"mae": "val_mae", "bias": "val_bias"})
        rows.append(
            rmsse(features, predicted, fold.val_start)
            .withColumn("_m", metrics.select(F.struct("val_mae", "val_bias")).scalar())
            .select(
                F.lit(fold.name).alias("fold"), F.lit(fold.train_start).alias("train_start"),
                F.lit(fold.train_end).alias("train_end"), F.lit(fold.val_start).alias("val_start"),
                F.lit(fold.val_end).alias("val_end"), "active_series", "val_rmsse", "_m.*",
                fit_error.scalar().alias("train_mae"),
            )
        )
    log = rows[0]
    for row in rows[1:]:
        log = log.unionByName(row)
    return log, models


def champion(log: DataFrame) -> DataFrame:
    """Fold with the lowest score, next to the mean and spread over folds."""
    return log.agg(
        F.min_by("fold", "val_rmsse").alias("champion"), F.min("val_rmsse").alias("best_rmsse"),
        F.avg("val_rmsse").alias("mean_rmsse"), F.stddev_pop("val_rmsse").alias("std_rmsse"),
    )


def permutation_importance(model: DemandModel, features: DataFrame, top: int = 20, group_rows: int = 10_000) -> DataFrame:
    """Rise of the absolute error when one input is shuffled, highest first.

    Rows are shuffled inside random groups of about ``group_rows``: ordered by a
    hash, each row takes the value of the next one and the last takes the first.
    The model is linear before its link, so one pass scores all inputs: swapping
    an input moves the linear part by its coefficient times the difference.
    """
    fitted = model.stages.stages[-1]
    weights, spread = fitted.coefficients.toArray(), model.stages.stages[1].std.toArray()
    slope = [float(w / s) if s else 0.0 for w, s in zip(weights, spread)]
    ready = model_input(model.coded(features), model.inputs)
    scored = model.stages.transform(ready)
    total = features.agg(F.count(F.lit(1)))
    mixed = F.xxhash64(*SERIES, "sale_date")
    rows = scored.select(
        "unit_sales", "prediction", *model.inputs, mixed.alias("_h"),
        F.pmod(F.xxhash64(mixed, F.lit(7)), F.floor(total.scalar() / group_rows) + 1).alias("_g"),
    )
    group = Window.partitionBy("_g").orderBy("_h")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    swapped = {
        f"_p{i}": F.col("prediction") * F.exp(slope[i] * (F.coalesce(F.lead(c, 1).over(group), F.first(c).over(whole)) - F.col(c)))
        for i, c in enumerate(model.inputs)
    }
    error = lambda p: F.avg(F.abs(F.col("unit_sales") - p))
    errors = rows.withColumns(swapped).agg(
        error(F.col("prediction")).alias("base"), *[error(F.col(name)).alias(name) for name in swapped]
    )
    listed = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.col(f"_p{i}") - F.col("base")).alias("importance"))
        for i, c in enumerate(model.inputs)
    ])
    return errors.select(F.inline(listed)).orderBy(F.desc("importance"), "feature").limit(top)


# -------------------------------------------------------------------- forecast

FORECAST_SCHEMA = (
    "store_id string, item_id string, horizon int, step int, forecast_date date, forecast double, "
    "total_forecast_units double, error string"
)


def forecast_inputs(model, features: DataFrame) -> DataFrame:
    """The last 364 rows of each series with codes and the totals behind the expanding mean.

    The totals are aggregated apart, so a series' task receives 364 rows however
    long its history is.
    """
    newest = Window.partitionBy(*SERIES).orderBy(F.desc("sale_date"))
    recent = features.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= HISTORY_ROWS)
    last = F.max_by(F.struct("units_expanding_mean", "unit_sales"), "sale_date")
    totals = features.groupBy(*SERIES).agg(last.alias("_last"))
    return model.coded(recent.join(totals, SERIES))


@dataclass(frozen=True)
class LinearPredictor:
    """``exp`` of a weighted sum of the inputs, for a matrix with a row per series."""

    intercept: float
    slope: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.intercept + x @ self.slope, -50.0, 50.0))


@dataclass
class FixedDemand:
    """A model whose weights are given, not fitted."""

    intercept: float
    weights: dict[str, float]

    @property
    def inputs(self) -> list[str]:
        return list(self.weights)

    def coded(self, features: DataFrame) -> DataFrame:
        return features

    def predictor(self) -> LinearPredictor:
        return LinearPredictor(self.intercept, np.array(list(self.weights.values())))


class SeriesBlock:
    """The recent rows of many series as matrices, one row per series, and the inputs of their next day.

    Days are columns: the newest is the last filled one, a series with a shorter past has zeros
    before it. A new day is written into the next column, so nothing moves.
    """

    def __init__(self, rows: pd.DataFrame, horizon: int):
        rows = rows.sort_values([*SERIES, "sale_date"], ignore_index=True)
        number = rows.groupby(SERIES, sort=False).ngroup().to_numpy()
        counts = np.bincount(number)
        ends = np.cumsum(counts)
        column = HISTORY_ROWS - ends[number] + np.arange(len(rows))
        self.units, self.prices = (np.zeros((len(counts), HISTORY_ROWS + horizon)) for _ in range(2))
        self.units[number, column] = rows["unit_sales"].to_numpy(float)
        self.prices[number, column] = rows["sell_price"].to_numpy(float)
        self.last = rows.iloc[ends - 1]
        self.rows, self.at = counts, HISTORY_ROWS
        self.days = self.last["sale_date"].to_numpy().astype("datetime64[D]")
        self.seen = self.last["_seen"].to_numpy(float)
        mean = np.nan_to_num(self.last["_mean"].to_numpy(float))
        self.total = mean * (self.seen - 1) + self.units[:, self.at - 1]

    def back(self, values: np.ndarray, n: int) -> np.ndarray:
        return np.where(self.rows >= n, values[:, self.at - n], 0.0)

    def mean(self, values: np.ndarray, n: int) -> np.ndarray:
        return values[:, self.at - n:self.at].sum(axis=1) / np.minimum(self.rows, n)

    def spread(self, n: int) -> np.ndarray:
        used = np.minimum(self.rows, n)
        off = (self.units[:, self.at - n:self.at] - self.mean(self.units, n)[:, None]) * (np.arange(n, 0, -1) <= used[:, None])
        return np.where(used > 1, np.sqrt((off ** 2).sum(axis=1) / np.maximum(used - 1, 1)), 0.0)

    def inputs(self, names: list[str]) -> np.ndarray:
        """Inputs of the day after the newest, by the training definitions, in the order of ``names``."""
        day = pd.DatetimeIndex((self.days + 1).astype("datetime64[ns]"))
        sunday_first = (day.dayofweek.to_numpy() + 1) % 7
        values = {f"units_lag_{n}": lambda n=n: self.back(self.units, n) for n in UNIT_LAGS}
        values |= {f"price_lag_{n}": lambda n=n: self.back(self.prices, n) for n in PRICE_LAGS}
        values |= {f"units_roll_mean_{n}": lambda n=n: self.mean(self.units, n) for n in MEAN_ROWS}
        values |= {f"units_roll_std_{n}": lambda n=n: self.spread(n) for n in STD_ROWS}
        values |= {
            "price_roll_mean_7": lambda: self.mean(self.prices, 7),
            "units_expanding_mean": lambda: self.total / self.seen,
            "day_of_week": lambda: sunday_first,
            "day_of_month": lambda: day.day.to_numpy(),
            "week_of_year": lambda: day.isocalendar().week.to_numpy(),
            "month": lambda: day.month.to_numpy(),
            "year": lambda: day.year.to_numpy(),
            "is_weekend": lambda: np.isin(sunday_first, (0, 6)),
            "is_month_start": lambda: day.day.to_numpy() <= 3,
            "is_month_end": lambda: day.day.to_numpy() >= 28,
        }
        nothing = np.zeros(len(self.rows))  # future days carry no event or benefit flag
        columns = [self.last[c].to_numpy(float) if c.endswith("_code") else values.get(c, lambda: nothing)() for c in names]
        return np.column_stack([np.asarray(c, dtype=float) for c in columns])

    def advance(self, units: np.ndarray) -> None:
        """Take the predictions as the next day; the price stays."""
        self.units[:, self.at], self.prices[:, self.at] = units, self.prices[:, self.at - 1]
        self.total, self.seen = self.total + units, self.seen + 1
        self.days, self.rows, self.at = self.days + 1, self.rows + 1, self.at + 1


def forecast_all(model, features: DataFrame, history: DataFrame, horizon: int = HORIZON,
                 block_series: int = BLOCK_SERIES) -> DataFrame:
    """Recursive daily forecast of every series: each step feeds the next one's lags.

    Series are dealt into hashed blocks of about ``block_series``; a task advances a whole
    block day by day, so the model is asked once per block and day with one row per series.
    Calendar, lag and rolling inputs follow the training definitions at every
    step; the price stays at its last value and future days carry no event or
    benefit flag. ``history`` gives all rows seen per series (columns of SERIES
    plus ``rows``), which weigh the expanding mean.
    """
    within(horizon, 1, MAX_HORIZON, "horizon")
    predict, inputs = model.predictor(), list(model.inputs)
    blocks = max(1, -(-history.count() // block_series))

    def roll(rows: pd.DataFrame) -> pd.DataFrame:
        block = SeriesBlock(rows, horizon)
        parts = []
        for step in range(1, horizon + 1):
            units = np.maximum(predict(block.inputs(inputs)), 0.0)
            block.advance(units)
            parts.append(pd.DataFrame({"store_id": block.last["store_id"].to_numpy(), "item_id": block.last["item_id"].to_numpy(),
                                       "horizon": horizon, "step": step, "forecast_date": block.days.astype("datetime64[ns]"),
                                       "forecast": np.round(units, 2)}))
        out = pd.concat(parts)
        out["forecast_date"] = out["forecast_date"].dt.date
        out["total_forecast_units"] = out.groupby(SERIES)["forecast"].transform("sum").round(1)
        return out.assign(error=None)

    seen = history.select(*SERIES, F.col("rows").alias("_seen"))
    ready = forecast_inputs(model, features).join(seen, SERIES).withColumns({
        "_mean": F.col("_last.units_expanding_mean"), "_block": F.pmod(F.xxhash64(*SERIES), F.lit(blocks))})
    codes = [c for c in inputs if c.endswith("_code")]
    needed = ["_block", *SERIES, "sale_date", "unit_sales", "sell_price", "_mean", "_seen", *codes]
    return ready.select(*needed).groupBy("_block").applyInPandas(roll, FORECAST_SCHEMA)


FORECAST_FOLDERS = ["horizon", "store_id"]


def store_forecasts(forecasts: DataFrame, path: str) -> None:
    """Forecasts in a folder per horizon and store; a run replaces the folders it has rows for."""
    forecasts.repartition(*FORECAST_FOLDERS).sortWithinPartitions("item_id", "step").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*FORECAST_FOLDERS).parquet(path)


def stored_forecast(stored: DataFrame, requested: DataFrame, horizon: int) -> DataFrame:
    """Rows of the asked series and horizon from ``store_forecasts``; nothing is forecast when asked.

    ``requested`` has SERIES and ``horizon``. The stores that it asks for are known at run time
    and prune the folders that are read.
    """
    asked = requested.filter(F.col("horizon") == horizon)
    return forecast_for(stored.filter(F.col("horizon") == horizon).drop("horizon"), asked)


def forecast_for(forecasts: DataFrame, requested: DataFrame) -> DataFrame:
    """Forecast rows of the requested series; a series without data yields an error row."""
    found = requested.join(forecasts.drop("error"), SERIES, "left")
    message = F.concat_ws(" ", F.lit("no history of item"), "item_id", F.lit("in store"), "store_id")
    return found.withColumn("error", F.when(F.col("step").isNull(), message))


def forecast_band(forecasts: DataFrame, width: float = 0.2) -> DataFrame:
    """Daily average of the total forecast with a band of plus and minus 20 percent."""
    average: Column = F.col("total_forecast_units") / F.col("horizon")
    return forecasts.groupBy(*SERIES, "horizon", "total_forecast_units").agg(F.count(F.lit(1)).alias("days")).select(
        *SERIES, "total_forecast_units", average.alias("daily_average"),
        (average * (1 - width)).alias("band_low"), (average * (1 + width)).alias("band_high"),
    )


def recursive_forecast_checks(forecasts: DataFrame) -> DataFrame:
    """Per series: length equals the horizon, dates step by a day, no negative value, total fits the sum."""
    day = F.col("forecast_date")
    return forecasts.filter(F.col("step").isNotNull()).groupBy(*SERIES).agg(
        (F.count(F.lit(1)) == F.max("horizon")).alias("full_horizon"),
        ((F.datediff(F.max(day), F.min(day)) + 1 == F.countDistinct(day)) & (F.countDistinct(day) == F.count(day))).alias("consecutive"),
        (F.min("forecast") >= 0).alias("non_negative"),
        (F.abs(F.max("total_forecast_units") - F.sum("forecast")) < 0.5).alias("total_matches"),
    )


def rounded_forecast(forecasts: DataFrame) -> DataFrame:
    return forecasts.withColumn("forecast", stable_round(F.col("forecast"), 2))


def seasonal_naive(features: DataFrame) -> DataFrame:
    """Last week's value as prediction: the yardstick for the fitted model."""
    return features.withColumn("prediction", F.col("units_lag_7").cast("double"))
