"""Checks of fitted, ranked and text results that SQL cannot compute: conditions any right result meets.

Each entry runs the job itself and counts what fails; its SQL says how many there must be.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from martspark.operators import catalog, plane
from martspark.operators import forecasting as fc
from martspark.operators import recommending as rec
from martspark.operators.nearest import nearest
from martspark.registry import vectors
from martspark.registry.base import ORACLES, PAIRS, QUERIES, query
from martspark.registry.forecasting import FEATURES, FOLDS, LAST, boosted, forecasts, trained
from martspark.registry.layers import pairs
from martspark.session import written

SERIES_SQL = f"WITH {FEATURES}, series AS (SELECT DISTINCT store_id, item_id FROM feat)"
RATED = PAIRS + ", rated AS (SELECT * FROM pairs WHERE interaction_score > 0)"


def all_true(column):
    return F.coalesce(F.bool_and(column), F.lit(True))


@query("q07_recommend_checks", f"""WITH {RATED}
SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) * least(10, count(DISTINCT product_id)) AS served,
       TRUE AS places_once, TRUE AS falling, TRUE AS named, TRUE AS in_bounds FROM rated""")
def _(t):
    """Places 1 to n once per user, similarities that fall, every product known and met once."""
    served = written(rec.recommend(vectors.factors(t), vectors.factors(t).users,
                                   pairs(t).select("product_id", "product_name", "department")), "recommended")
    before = F.lag("similarity").over(Window.partitionBy("user_id").orderBy("position"))
    users = served.withColumn("_before", before).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("position").alias("last"), F.countDistinct("position").alias("places"),
        F.countDistinct("product_id").alias("items"), all_true(F.col("_before") >= F.col("similarity")).alias("falling"),
        all_true(F.col("product_name").isNotNull() & (F.col("product_name") != "Unknown") & F.col("error").isNull()).alias("named"),
        all_true(F.abs("similarity") <= 1.000001).alias("in_bounds"))
    once = (F.col("n") == F.col("last")) & (F.col("n") == F.col("places")) & (F.col("n") == F.col("items"))
    return users.agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("served"), all_true(once).alias("places_once"),
                     all_true(F.col("falling")).alias("falling"), all_true(F.col("named")).alias("named"),
                     all_true(F.col("in_bounds")).alias("in_bounds"))


@query("m09_band_checks", f"""{SERIES_SQL}
SELECT count(*) AS series, count(*) AS average_of_total, count(*) AS fifth_below, count(*) AS fifth_above FROM series""")
def _(t):
    """M9: the average is the total over the horizon, the band a fifth around it."""
    close = lambda a, b: F.count_if(F.abs(a - b) <= 1e-9 * (1 + F.abs(b)))
    band, average = fc.forecast_band(forecasts(t)), F.col("daily_average")
    return band.agg(F.count(F.lit(1)).alias("series"), close(average, F.col("total_forecast_units") / 28).alias("average_of_total"),
                    close(F.col("band_low"), average * 0.8).alias("fifth_below"),
                    close(F.col("band_high"), average * 1.2).alias("fifth_above"))


ORACLES["d07_forecast_checks"] = f"""{SERIES_SQL}
SELECT store_id, item_id, TRUE AS full_horizon, TRUE AS consecutive, TRUE AS non_negative, TRUE AS total_matches FROM series"""


@query("q06_lookup_checks", f"""{SERIES_SQL}
SELECT count(*) * 14 AS forecast_rows, count(*) AS answered, count(*) AS refused, TRUE AS steps_once FROM series""")
def _(t):
    """Q6: fourteen steps per known series, one error row per unknown one."""
    rows = QUERIES["q06_forecast_lookup"](t.spark, t.folder)
    known = rows.filter("error is null")
    steps = known.groupBy("store_id", "item_id").agg((
        (F.count(F.lit(1)) == 14) & (F.countDistinct("step") == 14) & (F.min("step") == 1) & (F.max("step") == 14)).alias("once"))
    return rows.agg(F.count_if(F.col("error").isNull()).alias("forecast_rows"), F.count_if(
        F.col("error").isNotNull() & F.col("forecast").isNull()).alias("refused")).select(
        "forecast_rows", steps.agg(F.count(F.lit(1))).scalar().alias("answered"), "refused",
        steps.agg(all_true(F.col("once"))).scalar().alias("steps_once"))


@query("m03_tree_checks", f"WITH {FEATURES} " + " UNION ALL ".join(
    f"""SELECT '{f.name}' AS fold, TRUE AS trees_beat_last_week, TRUE AS line_beats_last_week FROM feat
WHERE sale_date >= DATE '{f.val_start}' AND sale_date < DATE '{f.val_end}' HAVING count(*) > 0""" for f in FOLDS))
def _(t):
    """M3: both models do better than last week's value on every fold."""
    rows = QUERIES["m03_tree_cross_validation"](t.spark, t.folder)
    return rows.select("fold", (F.col("tree_rmsse") < F.col("seasonal_rmsse")).alias("trees_beat_last_week"),
                       (F.col("linear_rmsse") < F.col("seasonal_rmsse")).alias("line_beats_last_week"))


@query("m10_attribution_checks", f"""WITH {FEATURES}
SELECT 30 AS inputs, count(*) AS rows, TRUE AS adds_up, TRUE AS some_matter FROM feat
WHERE sale_date >= DATE '{LAST.val_start}' AND sale_date < DATE '{LAST.val_end}'""")
def _(t):
    """The parts of every held-out row add up to its margin minus the base."""
    coded, trees = boosted(t)
    parts = trees["fold_3"].attributions(fc.between_dates(coded, LAST.val_start, LAST.val_end))
    return parts.agg(F.countDistinct("feature").alias("inputs"), F.max("rows").alias("rows"),
                     all_true(F.col("largest_gap") < 1e-6).alias("adds_up"), (F.max("mean_size") > 0).alias("some_matter"))


@query("m10_importance_checks", "SELECT 20 AS rows, 20 AS features, TRUE AS falling")
def _(t):
    """Twenty inputs, each once, the most important first."""
    features, _, models = trained(t)
    ranked = written(fc.permutation_importance(models["fold_3"], features).coalesce(1).withColumn(
        "_n", F.monotonically_increasing_id()), "importance")
    before = F.lag("importance").over(Window.orderBy("_n"))
    return ranked.withColumn("_before", before).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("feature").alias("features"),
                                                    all_true(F.col("_before") >= F.col("importance")).alias("falling"))


@query("m12_hit_rate_checks", f"""WITH {PAIRS}
SELECT least(500, count(*)) AS users, TRUE AS a_share, TRUE AS of_the_hits FROM (
  SELECT user_id FROM pairs GROUP BY 1 HAVING count(*) >= 2)""")
def _(t):
    """The evaluated users are as many as asked for, the rate is hits over users."""
    rate = rec.hit_rate(vectors.rated(t), iterations=4)
    return rate.select("users", F.col("hit_rate").between(0, 1).alias("a_share"),
                       (F.abs(F.col("hit_rate") - F.col("hits") / F.col("users")) < 1e-12).alias("of_the_hits"))


@query("m18_projection_checks", """SELECT count(*) AS points, TRUE AS finite, TRUE AS first_axis_is_longer, TRUE AS uncorrelated
FROM embeddings""")
def _(t):
    """A point per item, the longer axis first, no correlation between the axes."""
    flat = rec.projection(vectors.items(t))
    x, y = F.col("axis_1"), F.col("axis_2")
    return flat.agg(F.count(F.lit(1)).alias("points"), all_true(~F.isnan(x) & ~F.isnan(y)).alias("finite"),
                    (F.var_pop(x) >= F.var_pop(y)).alias("first_axis_is_longer"), (F.abs(F.corr(x, y)) < 1e-6).alias("uncorrelated"))


PLANE_STEPS = 8


@query("m18_neighbour_plane", """SELECT count(*) AS points, count(*) * least(10, count(*) - 1) AS neighbours, TRUE AS keeps_more
FROM embeddings""")
def _(t):
    """The neighbour-keeping plane of the item vectors keeps more of their neighbours than their main axes do."""
    items = vectors.items(t)
    neighbours = written(rec.similar_items(items, plane.NEIGHBOURS), "neighbours")
    axes = written(rec.projection(items).select(F.col("product_id").alias("id"), F.col("axis_1").alias("x"), F.col("axis_2").alias("y")),
                   "main-axes")
    places = written(plane.neighbour_plane(axes, neighbours, PLANE_STEPS), "plane")
    near = lambda queries, corpus, k: nearest(queries, corpus, k, exclude_self=True)
    before, after = (plane.kept_neighbours(flat, neighbours, near) for flat in (axes, places))
    return after.select(places.agg(F.count(F.lit(1))).scalar().alias("points"), "neighbours",
                        (F.col("kept") > before.select("kept").scalar()).alias("keeps_more"))


@query("q08_context_checks", f"""SELECT count(*) FILTER (NOT rejected) AS questions, count(*) FILTER (NOT rejected) AS with_five_lines
FROM ({ORACLES['c07_screened_questions']})""")
def _(t):
    """Q8: every admitted question has a context of five product lines."""
    contexts = catalog.answer_contexts(vectors.search_hits(t), catalog.product_line())
    lines = F.split("context", "\n")
    return contexts.agg(F.count(F.lit(1)).alias("questions"), F.count_if(
        (F.size(lines) == 5) & F.forall(lines, lambda x: x.startswith("- "))).alias("with_five_lines"))


@query("c08_payload_columns", ORACLES["q04_weekly_totals"])
def _(t):
    """The payload, parsed back, holds the weekly totals."""
    totals = QUERIES["q04_weekly_totals"](t.spark, t.folder)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in totals.schema.fields)
    parsed = QUERIES["c08_weekly_payload"](t.spark, t.folder).select(F.from_json("payload", kinds).alias("p"))
    return parsed.select("p.*")
