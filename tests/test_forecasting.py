"""Boosted trees, forecasts in blocks, sparse features and the model store."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from martspark.operators import boosting as bo
from martspark.operators import features as fe
from martspark.operators import forecasting as fc
from martspark.operators.model_store import ModelStore
from martspark.registry import QUERIES
from martspark.session import working_path, written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def toy(spark):
    """Demand that depends on a label and on a threshold, which no straight line fits."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(4000):
        item, x = f"i{k % 12}", float(rng.uniform(0, 10))
        mean = 5.0 * (4 if k % 12 in (1, 4, 7, 10) else 1) * (3 if 3 < x < 6 else 1)
        rows.append((item, f"s{k % 3}", "d", "c", "t", x, float(rng.poisson(mean))))
    frame = spark.createDataFrame(rows, "item_id string, store_id string, dept_id string, cat_id string, state_id string, "
                                        "x double, unit_sales double")
    codes = {c: written(fe.label_codes(frame, c), "codes") for c in fe.CATEGORIES}
    return frame, codes


def test_boosted_trees_learn_labels_and_thresholds(toy):
    frame, codes = toy
    model = bo.fit_boosted(frame, codes, rounds=6, depth=4, step=0.5)
    got = model.predict(frame).toPandas()
    expected = 5.0 * np.where(got["item_id"].isin(["i1", "i4", "i7", "i10"]), 4, 1) * np.where(got["x"].between(3, 6), 3, 1)
    assert np.mean(np.abs(got["prediction"] - expected) / expected) < 0.15
    assert any(row[4] is not None for row in model.nodes)  # some split is by label
    # A label that was not fitted takes the other side of every label split and does not fail.
    new = frame.limit(1).withColumn("item_id", F.lit("unseen"))
    assert model.predict(new).first()["prediction"] > 0


def test_each_round_lowers_the_deviance(toy):
    frame, codes = toy
    model = bo.fit_boosted(frame, codes, rounds=6, depth=3, step=0.5)
    rows = model.ready(frame).select("_x", "unit_sales").toPandas()
    x, y = np.stack(rows["_x"].to_numpy()), rows["unit_sales"].to_numpy()
    deviances = []
    for k in range(7):
        m = bo.BoostedDemand(model.inputs, model.base, model.step, [row for row in model.nodes if row[0] < k]).margin(x)
        deviances.append(np.mean(2 * y * np.exp(-0.5 * m) + 2 * np.exp(0.5 * m)))
    assert all(b < a for a, b in zip(deviances, deviances[1:]))


def test_attributions_add_up_and_name_the_right_input(toy):
    frame, codes = toy
    model = bo.fit_boosted(frame, codes, rounds=4, depth=4, step=0.5)
    rows = {r["feature"]: r for r in model.attributions(frame).collect()}
    assert all(r["rows"] == 4000 and r["largest_gap"] < 1e-9 for r in rows.values())
    ranked = sorted(rows, key=lambda name: -rows[name]["mean_size"])
    assert set(ranked[:2]) == {"item_id_code", "x"} and rows["dept_id_code"]["mean_size"] == 0
    x = np.stack(model.ready(frame).limit(50).toPandas()["_x"].to_numpy())
    margin, parts = model.attributed(x)
    assert np.allclose(margin, model.margin(x)) and np.allclose(parts.sum(axis=1), margin - model.expected)


def test_trees_and_line_beat_last_week(spark):
    rows = QUERIES["m03_tree_cross_validation"](spark, FOLDER).collect()
    assert len(rows) == 3
    for row in rows:
        assert row.tree_rmsse < row.seasonal_rmsse and row.linear_rmsse < row.seasonal_rmsse


def plain_forecast(units, prices, seen, mean, day, weights, intercept, horizon):
    """One series, one day at a time, with lists."""
    units, prices, out = list(units), list(prices), []
    total = mean * (seen - 1) + units[-1]
    for _ in range(horizon):
        day += pd.Timedelta(days=1)
        back = lambda v, n: v[-n] if len(v) >= n else 0.0
        dow = (day.dayofweek + 1) % 7
        values = {f"units_lag_{n}": back(units, n) for n in fe.UNIT_LAGS} | {f"price_lag_{n}": back(prices, n) for n in fe.PRICE_LAGS}
        values |= {f"units_roll_mean_{n}": np.mean(units[-n:]) for n in fe.MEAN_ROWS}
        values |= {f"units_roll_std_{n}": np.std(units[-n:], ddof=1) if len(units[-n:]) > 1 else 0.0 for n in fe.STD_ROWS}
        values |= {"price_roll_mean_7": np.mean(prices[-7:]), "units_expanding_mean": total / seen, "day_of_week": dow,
                   "day_of_month": day.day, "is_weekend": dow in (0, 6)}
        forecast = float(np.exp(intercept + sum(w * values.get(name, 0.0) for name, w in weights.items())))
        out.append((day.date(), round(forecast, 2)))
        units.append(forecast)
        prices.append(prices[-1])
        total, seen = total + forecast, seen + 1
    return out


@pytest.mark.parametrize("block_series", [1, 3, 2048])
def test_blocks_equal_series_by_series(spark, block_series):
    """Short and long series, different last days, one row only; blocks of any size."""
    rng = np.random.default_rng(1)
    rows, history, expected = [], [], {}
    weights = {"units_lag_1": 0.01, "units_lag_7": 0.02, "units_lag_364": 0.03, "units_roll_mean_28": 0.01, "units_roll_std_7": 0.02,
               "price_roll_mean_7": 0.01, "price_lag_7": 0.005, "units_expanding_mean": 0.01, "day_of_week": 0.02, "is_weekend": -0.1,
               "is_event": 3.0, "is_snap": 2.0}
    for k, length in enumerate([1, 2, 6, 30, 364, 500, 365, 8]):
        end = pd.Timestamp("2001-03-01") + pd.Timedelta(days=k)
        days = pd.date_range(end=end, periods=length)
        units, prices = rng.poisson(5, length).astype(float), rng.uniform(1, 3, length)
        mean = float(np.mean(units[:-1])) if length > 1 else 0.0
        rows += [(f"s{k % 2}", f"i{k}", d.date(), u, p, mean if d == end else -1.0)
                 for d, u, p in zip(days, units.tolist(), prices.tolist())]
        history.append((f"s{k % 2}", f"i{k}", length + 3))
        expected[f"i{k}"] = plain_forecast(units[-364:], prices[-364:], length + 3, mean, end, weights, 0.5, 20)
    features = spark.createDataFrame(rows, "store_id string, item_id string, sale_date date, unit_sales double, sell_price double, "
                                           "units_expanding_mean double")
    seen = spark.createDataFrame(history, "store_id string, item_id string, rows long")
    got = fc.forecast_all(fc.FixedDemand(0.5, weights), features, seen, 20, block_series).orderBy("item_id", "step").collect()
    assert len(got) == 20 * len(expected)
    for item, series in expected.items():
        mine = [(r.forecast_date, r.forecast) for r in got if r.item_id == item]
        assert [d for d, _ in mine] == [d for d, _ in series]
        assert np.allclose([x for _, x in mine], [x for _, x in series], atol=0.011)


def test_stored_forecasts_are_pruned_by_the_asked_store(spark):
    rows = [(f"s{k}", "i", h, s, f"2001-01-{s:02d}", 1.0, float(h)) for k in range(6) for h in (7, 14) for s in range(1, h + 1)]
    frame = spark.createDataFrame(rows, "store_id string, item_id string, horizon int, step int, d string, forecast double, "
                                        "total_forecast_units double").withColumn("forecast_date", F.to_date("d")).drop("d")
    path = working_path(spark, "forecasts")
    fc.store_forecasts(frame, path)
    asked = written(spark.createDataFrame([("s1", "i", 7), ("s9", "i", 7), ("s2", "i", 14)],
                                          "store_id string, item_id string, horizon int"), "asked")
    found = fc.stored_forecast(spark.read.parquet(path), asked, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    got = found.collect()
    assert sorted(r.store_id for r in got) == ["s1"] * 7 + ["s9"] and [r.error for r in got if r.store_id == "s9"] != [None]


def test_sparse_features_equal_dense_ones(spark):
    """On a dense series with zeros both forms agree on the days with sales."""
    rng = np.random.default_rng(5)
    rows = []
    for item in ("a", "b"):
        price = 2.0
        for k, day in enumerate(pd.date_range("1999-01-01", periods=500)):
            units = int(rng.poisson(0.7)) if k else 3
            price = float(rng.integers(1, 9)) if units else price
            rows.append((item, "s", "d", "c", "t", day.to_pydatetime(), units, price, units * price, "None", "None", 0, 0, 0))
    dense = spark.createDataFrame(rows, "item_id string, store_id string, dept_id string, cat_id string, state_id string, date timestamp, "
                                        "unit_sales int, sell_price double, revenue double, event_name_1 string, event_type_1 string, "
                                        "snap_CA int, snap_TX int, snap_WI int")
    full = fe.item_features(dense, "1999-01-01", "2000-01-01").toPandas()
    sparse = fe.sparse_item_features(dense.filter("unit_sales > 0"), "1999-01-01", "2000-01-01").toPandas()
    both = sparse.merge(full[full["unit_sales"] > 0], on=["item_id", "store_id", "sale_date"], suffixes=("", "_full"))
    assert len(both) == len(sparse) == (full["unit_sales"] > 0).sum() > 100
    for column in (c for c in sparse.columns if c.startswith(("units_", "price_", "day_", "is_"))):
        assert np.allclose(both[column].astype(float), both[f"{column}_full"].astype(float), atol=1e-4), column


def test_sparse_features_edges(spark):
    schema = "store_id string, item_id string, date timestamp, unit_sales int, revenue double, clash int"
    assert fe.sparse_item_features(spark.createDataFrame([], schema)).count() == 0
    day = lambda s: pd.Timestamp(s).to_pydatetime()
    rows = [("s", "i", day("2015-01-01"), 2, 4.0, 1), ("s", "i", day("2016-02-01"), 1, 3.0, 1), ("s", "i", day("2016-02-01"), 1, 3.0, 1),
            (None, "i", day("2016-02-01"), 1, 1.0, 1), ("s", None, None, 1, 1.0, 1), ("s", "z", day("2016-02-01"), 0, 0.0, 1)]
    row, = fe.sparse_item_features(spark.createDataFrame(rows, schema)).collect()
    assert (row.unit_sales, row.sell_price, row.units_lag_1, row.price_lag_7, row.units_roll_std_7) == (2, 3, 0, 2, 0)
    assert row.units_expanding_mean == pytest.approx(2 / 396)


def test_model_store_keeps_versions_and_the_last_champion(spark):
    store = ModelStore(spark, working_path(spark, "models"))
    assert store.log().count() == 0
    with pytest.raises(ValueError):
        store.champion("demand")
    written_to = []
    a = store.save("demand", "line", written_to.append, {"power": 1.5}, {"val_rmsse": 0.9})
    assert store.promote("demand", "val_rmsse") == a == store.champion("demand")
    b = store.save("demand", "trees", written_to.append, {"rounds": 8}, {"val_rmsse": 0.7})
    store.save("other", "line", written_to.append, {}, {"val_rmsse": 0.1})
    store.save("demand", "broken", written_to.append, {}, {"val_rmsse": float("nan")})
    assert store.champion("demand") == a  # not before it is promoted
    assert store.promote("demand", "val_rmsse") == b == store.champion("demand")
    assert (a.version, b.version) == (1, 2) and len(set(written_to)) == 4
    rows = store.log().filter("experiment = 'demand' and kind = 'model' and version = 2").collect()
    assert rows[0].params == {"rounds": "8"} and rows[0].metrics == {"val_rmsse": 0.7} and rows[0].path == b.path
    with pytest.raises(ValueError):
        store.promote("demand", "mae")
