"""Feature table, folds, metrics, model and forecasts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from martspark.operators import boosting as bo
from martspark.operators import features as fe
from martspark.operators import forecasting as fc
from martspark.operators.model_store import ModelStore
from martspark.registry.base import SALES, iso, query, r, rounded
from martspark.registry.checks import DENSE
from martspark.session import working_path, written
from martspark.sources import tables

# The test tables cover 1995 to 2001 instead of 2014 to 2016.
HISTORY_FROM, OUTPUT_FROM = "1996-01-01", "1997-06-01"
FOLDS = [
    fc.Fold("fold_1", "1997-06-01", "1998-06-01", "1998-06-01", "1998-09-01"),
    fc.Fold("fold_2", "1997-06-01", "1999-06-01", "1999-06-01", "1999-09-01"),
    fc.Fold("fold_3", "1997-06-01", "2000-06-01", "2000-06-01", "2000-10-22"),
]


def item_features(t):
    return fe.item_features(tables.item_sales(t), HISTORY_FROM, OUTPUT_FROM, tables.STATE_BENEFIT_COLUMNS)


_WINDOWED = [
    *(f"units_lag_{n}" for n in fe.UNIT_LAGS), *(f"price_lag_{n}" for n in fe.PRICE_LAGS),
    *(f"units_roll_mean_{n}" for n in fe.MEAN_ROWS), *(f"units_roll_std_{n}" for n in fe.STD_ROWS),
    "price_roll_mean_7", "units_expanding_mean",
]

FEATURES = DENSE + f""", base AS (
  SELECT *, CAST(unit_sales AS FLOAT) AS u, CAST(sell_price AS FLOAT) AS p FROM dense WHERE sale_date >= DATE '{HISTORY_FROM}'),
windowed AS (
  SELECT *, {', '.join(f'lag(u, {n}) OVER w AS units_lag_{n}' for n in fe.UNIT_LAGS)},
         {', '.join(f'lag(p, {n}) OVER w AS price_lag_{n}' for n in fe.PRICE_LAGS)},
         {', '.join(f'avg(u) OVER w{n} AS units_roll_mean_{n}' for n in fe.MEAN_ROWS)},
         {', '.join(f'stddev_samp(u) OVER w{n} AS units_roll_std_{n}' for n in fe.STD_ROWS)},
         avg(p) OVER w7 AS price_roll_mean_7,
         avg(u) OVER (PARTITION BY store_id, item_id ORDER BY sale_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
           AS units_expanding_mean
  FROM base
  WINDOW w AS (PARTITION BY store_id, item_id ORDER BY sale_date),
         {', '.join(f'w{n} AS (PARTITION BY store_id, item_id ORDER BY sale_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)'
                    for n in fe.MEAN_ROWS)}),
feat AS (
  SELECT item_id, store_id, dept_id, cat_id, state_id, sale_date, u AS unit_sales, p AS sell_price,
         CASE WHEN has_event THEN 1 ELSE 0 END AS is_event,
         CASE event_name_type WHEN 'Sporting' THEN 1 WHEN 'Cultural' THEN 2 WHEN 'National' THEN 3 WHEN 'Religious' THEN 4
              ELSE 0 END AS event_type,
         CASE state_id WHEN 'AF' THEN s0 WHEN 'AM' THEN s1 WHEN 'AS' THEN s2 ELSE 0 END AS is_snap,
         {', '.join(_WINDOWED)},
         extract('dow' FROM sale_date) AS day_of_week, dayofmonth(sale_date) AS day_of_month,
         extract('week' FROM sale_date) AS week_of_year, month(sale_date) AS month, year(sale_date) AS year,
         CASE WHEN extract('dow' FROM sale_date) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN dayofmonth(sale_date) <= 3 THEN 1 ELSE 0 END AS is_month_start,
         CASE WHEN dayofmonth(sale_date) >= 28 THEN 1 ELSE 0 END AS is_month_end
  FROM windowed
  WHERE sale_date >= DATE '{OUTPUT_FROM}' AND units_lag_28 IS NOT NULL AND units_lag_364 IS NOT NULL)"""

_ROUNDED = {c: 2 for c in ("sell_price", *_WINDOWED) if "price" in c} | {
    c: 4 for c in _WINDOWED if "roll" in c and "units" in c or "expanding" in c}
_WHOLE = [
    "is_event", "event_type", "is_snap", "day_of_week", "day_of_month", "week_of_year", "month", "year", "is_weekend",
    "is_month_start", "is_month_end",
]
_EXACT = ["unit_sales", *(f"units_lag_{n}" for n in fe.UNIT_LAGS)]


@query("m01_item_features", f"""WITH {FEATURES}
SELECT item_id, store_id, dept_id, cat_id, state_id, {iso('sale_date')} AS sale_date,
       {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _EXACT)},
       {', '.join(f'{r(f'CAST({c} AS DOUBLE)', k)} AS {c}' for c, k in _ROUNDED.items())},
       {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _WHOLE)} FROM feat""")
def _(t):
    """M1 with W11 to W17, P22 and P23."""
    return rounded(item_features(t), **_ROUNDED)


@query("m02_label_codes", f"""WITH {FEATURES}
SELECT store_id, item_id, count(*) AS rows,
       dense_rank() OVER (ORDER BY store_id) - 1 AS store_id_code, dense_rank() OVER (ORDER BY item_id) - 1 AS item_id_code
FROM feat GROUP BY 1, 2""")
def _(t):
    features = written(item_features(t), "features")
    codes = {c: fe.label_codes(features, c) for c in ("store_id", "item_id")}
    return fe.encoded(features, codes).groupBy("store_id", "item_id", "store_id_code", "item_id_code").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("m04_fold_sizes", f"WITH {FEATURES} " + " UNION ALL ".join(
    f"""SELECT '{f.name}' AS fold,
count(*) FILTER (sale_date >= DATE '{f.train_start}' AND sale_date < DATE '{f.train_end}') AS train_rows,
count(*) FILTER (sale_date >= DATE '{f.val_start}' AND sale_date < DATE '{f.val_end}') AS val_rows FROM feat"""
    for f in FOLDS))
def _(t):
    return fc.fold_sizes(item_features(t), FOLDS)


LAST = FOLDS[-1]
NAIVE = FEATURES + f""", val AS (
  SELECT *, units_lag_7 AS prediction FROM feat WHERE sale_date >= DATE '{LAST.val_start}' AND sale_date < DATE '{LAST.val_end}'),
scale AS (
  SELECT store_id, item_id, avg(abs(d)) AS scale
  FROM (SELECT store_id, item_id, unit_sales - lag(unit_sales) OVER (PARTITION BY store_id, item_id ORDER BY sale_date) AS d
        FROM feat WHERE sale_date < DATE '{LAST.val_start}') GROUP BY 1, 2),
rmse AS (SELECT store_id, item_id, sqrt(avg((unit_sales - prediction) ** 2)) AS rmse FROM val GROUP BY 1, 2),
scores AS (SELECT store_id, item_id, rmse, scale, rmse / scale AS rmsse FROM rmse JOIN scale USING (store_id, item_id)
           WHERE scale >= 0.1)"""


def naive_validation(features):
    return fc.seasonal_naive(fc.between_dates(features, LAST.val_start, LAST.val_end))


@query("a22_naive_scale", f"WITH {NAIVE} SELECT store_id, item_id, {r('scale', 4)} AS scale FROM scale")
def _(t):
    """A22 and W18."""
    history = item_features(t).filter(F.col("sale_date") < F.lit(LAST.val_start).cast("date"))
    return rounded(fc.naive_scale(history), scale=4)


@query("a23_series_scores", f"""WITH {NAIVE}
SELECT store_id, item_id, {r('rmse', 4)} AS rmse, {r('scale', 4)} AS scale, {r('rmsse', 4)} AS rmsse FROM scores""")
def _(t):
    """A23 and J11."""
    features = item_features(t)
    return rounded(fc.series_scores(features, naive_validation(features), LAST.val_start), rmse=4, scale=4, rmsse=4)


@query("m05_error_metrics", f"""WITH {NAIVE}
SELECT {r('avg(abs(unit_sales - prediction))', 4)} AS mae, {r('avg(prediction - unit_sales)', 4)} AS bias FROM val""")
def _(t):
    return rounded(fc.error_metrics(naive_validation(item_features(t))), mae=4, bias=4)


@query("m06_rmsse", f"WITH {NAIVE} SELECT count(*) AS active_series, {r('avg(rmsse)', 4)} AS val_rmsse FROM scores")
def _(t):
    features = item_features(t)
    return rounded(fc.rmsse(features, naive_validation(features), LAST.val_start), val_rmsse=4)


@lru_cache(maxsize=4)
def _trained(spark, folder, state):
    t = tables.Tables(spark, folder)
    features = written(item_features(t), "features")
    log, models = fc.cross_validate(features, FOLDS)
    return features, log, models


def trained(t):
    """Features, run log and fold models, fitted once per session and state of the folder's files."""
    return _trained(t.spark, t.folder, t.state())


@query("m07_cross_validation")
def _(t):
    """M3, M5 to M7: the run log of the three folds."""
    _, log, _ = trained(t)
    return rounded(log, val_rmsse=4, val_mae=4, val_bias=4, train_mae=4)


@query("m07_champion")
def _(t):
    _, log, _ = trained(t)
    return rounded(fc.champion(log), best_rmsse=4, mean_rmsse=4, std_rmsse=4)


def seen_rows(t):
    """Rows of each series since the history bound, as the expanding mean counts them."""
    sales = tables.item_sales(t).filter(F.col("date") >= F.lit(HISTORY_FROM).cast("timestamp"))
    return sales.groupBy("store_id", "item_id").agg(F.count(F.lit(1)).alias("rows"))


def forecasts(t, horizon=28):
    features, _, models = trained(t)
    return fc.forecast_all(models["fold_3"], features, seen_rows(t), horizon)


@query("m08_recursive_forecast")
def _(t):
    """M8 for every series."""
    return forecasts(t)


@query("m09_forecast_band")
def _(t):
    return rounded(fc.forecast_band(forecasts(t)), daily_average=2, band_low=2, band_high=2)


@query("m10_permutation_importance")
def _(t):
    features, _, models = trained(t)
    return rounded(fc.permutation_importance(models["fold_3"], features), importance=6)


@query("d07_forecast_checks")
def _(t):
    return fc.recursive_forecast_checks(forecasts(t, 7))


@lru_cache(maxsize=4)
def _stored(spark, folder, state):
    t = tables.Tables(spark, folder)
    path = working_path(spark, "forecasts")
    for horizon in (7, 14):
        fc.store_forecasts(forecasts(t, horizon).filter("error is null").drop("error"), path)
    return path


@query("q06_forecast_lookup")
def _(t):
    """Q6: series asked for by users, read from the stored forecasts; stores that do not exist yield an error row."""
    features, _, _ = trained(t)
    stored = t.spark.read.parquet(_stored(t.spark, t.folder, t.state()))
    known = features.select("store_id", "item_id").distinct()
    asked = known.union(known.select(F.lit("NOWHERE_1"), "item_id")).withColumn("horizon", F.lit(14))
    found = fc.stored_forecast(stored, asked, 14)
    return found.select("store_id", "item_id", "horizon", "step", "forecast_date", "forecast", "total_forecast_units", "error")


# Weights of a model that is not fitted: every kind of input has a part in its forecast.
FIXED_INTERCEPT, FIXED_WEIGHTS = 2.5, {
    "units_lag_1": 0.0008, "units_lag_7": 0.0006, "units_lag_14": 0.0005, "units_lag_28": 0.0004, "units_lag_364": 0.0004,
    "price_lag_1": 0.00001, "price_lag_7": 0.00001, "units_roll_mean_7": 0.0005, "units_roll_mean_14": 0.0004,
    "units_roll_mean_28": 0.0007, "units_roll_std_7": 0.0009, "units_roll_std_28": 0.0003, "price_roll_mean_7": 0.00002,
    "units_expanding_mean": 0.0005, "day_of_week": 0.02, "day_of_month": 0.002, "week_of_year": 0.001, "month": 0.01,
    "is_weekend": -0.05, "is_month_start": 0.04, "is_month_end": 0.03, "is_event": 0.5, "is_snap": 0.5,
}
_W = FIXED_WEIGHTS


@query("m08_fixed_weights", f"""WITH RECURSIVE {FEATURES},
aged AS (SELECT *, row_number() OVER (PARTITION BY store_id, item_id ORDER BY sale_date DESC) AS age FROM feat),
seen AS (SELECT store_id, item_id, count(*) AS n FROM base GROUP BY 1, 2),
begun AS (
  SELECT store_id, item_id, max(sale_date) AS day, list(CAST(unit_sales AS DOUBLE) ORDER BY sale_date) AS u,
         list(CAST(sell_price AS DOUBLE) ORDER BY sale_date) AS p,
         arg_max(units_expanding_mean, sale_date) AS mean, arg_max(CAST(unit_sales AS DOUBLE), sale_date) AS newest
  FROM aged WHERE age <= 364 GROUP BY 1, 2),
walk AS (
  SELECT store_id, item_id, 0 AS step, day, u, p, mean * (n - 1) + newest AS total, CAST(n AS DOUBLE) AS seen, CAST(0 AS DOUBLE) AS units
  FROM begun JOIN seen USING (store_id, item_id)
  UNION ALL
  SELECT store_id, item_id, step + 1, next_day, list_append(u, f), list_append(p, p[-1]), total + f, seen + 1, f
  FROM (SELECT *, exp({FIXED_INTERCEPT}
      + {' + '.join(f"{_W[f'units_lag_{n}']} * CASE WHEN len(u) >= {n} THEN u[-{n}] ELSE 0 END" for n in (1, 7, 14, 28, 364))}
      + {' + '.join(f"{_W[f'price_lag_{n}']} * CASE WHEN len(p) >= {n} THEN p[-{n}] ELSE 0 END" for n in (1, 7))}
      + {' + '.join(f"{_W[f'units_roll_mean_{n}']} * list_avg(u[-{n}:])" for n in (7, 14, 28))}
      + {' + '.join(f"{_W[f'units_roll_std_{n}']} * coalesce(list_stddev_samp(u[-{n}:]), 0)" for n in (7, 28))}
      + {_W['price_roll_mean_7']} * list_avg(p[-7:]) + {_W['units_expanding_mean']} * total / seen
      + {_W['day_of_week']} * extract('dow' FROM next_day) + {_W['day_of_month']} * dayofmonth(next_day)
      + {_W['week_of_year']} * extract('week' FROM next_day) + {_W['month']} * month(next_day)
      + CASE WHEN extract('dow' FROM next_day) IN (0, 6) THEN {_W['is_weekend']} ELSE 0 END
      + CASE WHEN dayofmonth(next_day) <= 3 THEN {_W['is_month_start']} ELSE 0 END
      + CASE WHEN dayofmonth(next_day) >= 28 THEN {_W['is_month_end']} ELSE 0 END) AS f
    FROM (SELECT *, CAST(day + INTERVAL 1 DAY AS DATE) AS next_day FROM walk WHERE step < 28)))
SELECT store_id, item_id, CAST(step AS BIGINT) AS step, {iso('day')} AS forecast_date, {r('units', 2)} AS forecast
FROM walk WHERE step > 0""")
def _(t):
    """M8 by blocks of series, under given weights: the steps can be checked one by one."""
    model = fc.FixedDemand(FIXED_INTERCEPT, FIXED_WEIGHTS)
    found = fc.forecast_all(model, written(item_features(t), "features"), seen_rows(t), 28, block_series=7)
    return rounded(found.select("store_id", "item_id", "step", "forecast_date", "forecast"), forecast=2)


def sparse_features(t):
    """Series of one product in one store: they grow with the products."""
    return fe.sparse_item_features(tables.sales(t), HISTORY_FROM, OUTPUT_FROM)


SPARSE = SALES + f""", day AS (
  SELECT store_id, item_id, sale_date, CAST(sum(unit_sales) AS DOUBLE) AS u, sum(revenue) / sum(unit_sales) AS p
  FROM sales WHERE sale_date >= DATE '{HISTORY_FROM}' GROUP BY 1, 2, 3),
pair AS (SELECT a.*, b.u AS bu, b.p AS bp, b.sale_date AS bd, CAST(a.sale_date - b.sale_date AS INT) AS ago
         FROM day a LEFT JOIN day b ON a.store_id = b.store_id AND a.item_id = b.item_id AND b.sale_date < a.sale_date),
wide AS (
  SELECT store_id, item_id, sale_date, u, p, coalesce(max(ago), 0) AS age, sum(bu) AS before,
         {', '.join(f'coalesce(sum(bu) FILTER (ago = {n}), 0) AS lag_{n}' for n in (1, 7, 14, 28, 364))},
         {', '.join(f'coalesce(sum(bu) FILTER (ago <= {n}), 0) AS sum_{n}' for n in (7, 14, 28))},
         {', '.join(f'coalesce(sum(bu * bu) FILTER (ago <= {n}), 0) AS square_{n}' for n in (7, 28))},
         {', '.join(f'arg_max(bp, bd) FILTER (ago >= {n}) AS price_{n}' for n in range(1, 8))}
  FROM pair GROUP BY ALL)"""


@query("m01_sparse_features", f"""WITH {SPARSE}
SELECT store_id, item_id, {iso('sale_date')} AS sale_date, u AS unit_sales, {r('p', 2)} AS sell_price,
       {', '.join(f'lag_{n} AS units_lag_{n}' for n in (1, 7, 14, 28, 364))},
       {r('price_1', 2)} AS price_lag_1, {r('price_7', 2)} AS price_lag_7,
       {', '.join(f"{r(f'sum_{n} / {n}', 4)} AS units_roll_mean_{n}" for n in (7, 14, 28))},
       {', '.join(f"{r(f'sqrt(greatest(square_{n} - sum_{n} * sum_{n} / {n}, 0) / {n - 1})', 4)} AS units_roll_std_{n}" for n in (7, 28))},
       {r('(price_1 + price_2 + price_3 + price_4 + price_5 + price_6 + price_7) / 7', 2)} AS price_roll_mean_7,
       {r('before / age', 4)} AS units_expanding_mean,
       CAST(extract('dow' FROM sale_date) AS BIGINT) AS day_of_week, CAST(dayofmonth(sale_date) AS BIGINT) AS day_of_month,
       CAST(extract('week' FROM sale_date) AS BIGINT) AS week_of_year, CAST(month(sale_date) AS BIGINT) AS month,
       CAST(year(sale_date) AS BIGINT) AS year,
       CAST(CASE WHEN extract('dow' FROM sale_date) IN (0, 6) THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
       CAST(CASE WHEN dayofmonth(sale_date) <= 3 THEN 1 ELSE 0 END AS BIGINT) AS is_month_start,
       CAST(CASE WHEN dayofmonth(sale_date) >= 28 THEN 1 ELSE 0 END AS BIGINT) AS is_month_end
FROM wide WHERE sale_date >= DATE '{OUTPUT_FROM}' AND age >= 364""")
def _(t):
    """M1 with a series per store and product."""
    return rounded(sparse_features(t), **_ROUNDED)


BOOSTING_ROUNDS, BOOSTING_STEP = 8, 0.4  # fewer and longer steps than the default: the test series are short


@lru_cache(maxsize=4)
def _boosted(spark, folder, state):
    t = tables.Tables(spark, folder)
    features, _, models = trained(t)
    codes = models["fold_1"].codes
    coded = written(fe.encoded(features, codes), "coded-features")
    return coded, {f.name: bo.fit_boosted(fc.between_dates(coded, f.train_start, f.train_end), codes, BOOSTING_ROUNDS,
                                          step=BOOSTING_STEP) for f in FOLDS}


def boosted(t):
    """Coded features and the boosted trees of each fold, fitted once per session and state of the folder's files."""
    return _boosted(t.spark, t.folder, t.state())


@query("m03_tree_cross_validation")
def _(t):
    """M3: boosted trees beside the linear model and last week's value, on the same folds."""
    _, log, _ = trained(t)
    coded, trees = boosted(t)
    rows = None
    for f in FOLDS:
        held = fc.between_dates(coded, f.val_start, f.val_end)
        row = fc.rmsse(coded, trees[f.name].predict(held), f.val_start).select(
            F.lit(f.name).alias("fold"), "active_series", F.col("val_rmsse").alias("tree_rmsse"))
        yardstick = fc.rmsse(coded, fc.seasonal_naive(held), f.val_start).select(
            F.lit(f.name).alias("fold"), F.col("val_rmsse").alias("seasonal_rmsse"))
        row = row.join(yardstick, "fold")
        rows = row if rows is None else rows.unionByName(row)
    both = rows.join(log.select("fold", F.col("val_rmsse").alias("linear_rmsse")), "fold")
    return rounded(both, tree_rmsse=4, linear_rmsse=4, seasonal_rmsse=4)


@query("m10_path_attribution")
def _(t):
    """M10 for the trees: the part of each input in the margins of the last fold's held-out rows."""
    coded, trees = boosted(t)
    return rounded(trees["fold_3"].attributions(fc.between_dates(coded, LAST.val_start, LAST.val_end)), mean_size=6, mean_part=6)


@query("m08_tree_forecast")
def _(t):
    """M8 under the boosted trees."""
    coded, trees = boosted(t)
    return fc.forecast_all(trees["fold_3"], coded, seen_rows(t))


_KEPT = " UNION ALL ".join(
    f"SELECT '{kind}' AS model, count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM feat "
    f"WHERE sale_date >= DATE '{LAST.val_start}' AND sale_date < DATE '{LAST.val_end}'" for kind in ("linear", "trees"))


@query("k11_reloaded_models", f"WITH {FEATURES} {_KEPT}")
def _(t):
    """Both models saved with parameters and metrics, the better promoted, and predicted with again."""
    features, log, models = trained(t)
    coded, trees = boosted(t)
    score = {row.fold: row.val_rmsse for row in log.select("fold", "val_rmsse").collect()}
    store = ModelStore(t.spark, working_path(t.spark, "models"))
    held = written(fc.between_dates(coded, LAST.val_start, LAST.val_end), "held-out")
    linear, tree = models["fold_3"], trees["fold_3"]
    tree_score = fc.rmsse(coded, tree.predict(held), LAST.val_start).first().val_rmsse
    saved = {
        "linear": store.save("demand", "linear", linear.save, {"power": fc.VARIANCE_POWER, "fold": "fold_3"},
                             {"val_rmsse": score["fold_3"]}),
        "trees": store.save("demand", "trees", lambda path: tree.save(t.spark, path),
                            {"rounds": BOOSTING_ROUNDS, "step": BOOSTING_STEP, "fold": "fold_3"}, {"val_rmsse": tree_score}),
    }
    store.promote("demand", "val_rmsse")
    best = store.champion("demand")
    if best.path != min((score["fold_3"], saved["linear"].path), (tree_score, saved["trees"].path))[1]:
        raise ValueError("the champion is not the best run")
    again = {"linear": fc.DemandModel.load(t.spark, saved["linear"].path, linear.inputs),
             "trees": bo.BoostedDemand.load(t.spark, saved["trees"].path)}
    rows = None
    for kind, first in (("linear", linear), ("trees", tree)):
        keys = ["store_id", "item_id", "sale_date"]
        left = first.predict(held).select(*keys, F.col("prediction").alias("_first"))
        right = again[kind].predict(held).select(*keys, "prediction")
        row = left.join(right, keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(
            F.abs(F.col("_first") - F.col("prediction")) > 1e-9).alias("differing")).select(F.lit(kind).alias("model"), "rows", "differing")
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("p29_one_series", f"""WITH {FEATURES}
SELECT store_id, item_id, {iso('sale_date')} AS sale_date, CAST(unit_sales AS DOUBLE) AS unit_sales
FROM feat WHERE store_id = 'AF_1' AND item_id = 'PROMO_1'""")
def _(t):
    """The feature table on disk, one folder per store, read for one series."""
    path = working_path(t.spark, "feature-table")
    fe.write_features(item_features(t), path)
    return fe.one_series(t.spark.read.parquet(path), "AF_1", "PROMO_1").select(
        "store_id", "item_id", "sale_date", "unit_sales"
    )
