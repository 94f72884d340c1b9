"""Fitted models on the test tables. They have no SQL counterpart; tests check their invariants."""

from itertools import product

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockloom.functions import columns as C
from stockloom.functions.columns import r6
from stockloom.operators import autoregression as AR
from stockloom.operators import evaluation as EV
from stockloom.operators import folds as FO
from stockloom.operators import forecasting as FC
from stockloom.operators import marts as M
from stockloom.operators import series as S
from stockloom.operators.profiling import union_all
from stockloom.plans import forecasts
from stockloom.plans import marts as P
from stockloom.plans.forecasts import stored_grid
from stockloom.plans.series import FILL, KEY
from stockloom.registry import cte, query
from stockloom.sources.adapters import HOLDOUT_START, HORIZONS

COLS = ["lag1", "lag2", "lag4_filled", "roll_mean_4_filled", "cv2_filled", "weeks_inactive", "coldstart", "iso_week", "quarter", "is_b"]
FOLDS = FO.quarter_folds(1999)
SEEDS = (42, 123, 2024)
TREE = {"maxDepth": 5, "maxBins": 32}


def training(s):
    def build():
        f = S.category_fallback(S.features(stored_grid(s)), FILL)
        rows = S.horizon_targets(f, (1,), P.last_week(s)).where("target_h1 is not null")
        known = rows.withColumns({**{c: F.coalesce(c, F.lit(0)).cast("double") for c in ("lag1", "lag2", *[f"{x}_filled" for x in FILL])},
                                  "weeks_inactive": C.cap_weeks(F.col("weeks_since_active")), "is_b": (F.col("center_id") == "B").cast("int")})
        return known.select(*KEY, F.date_add("week_st", 7).alias("target_date"), *COLS, F.col("target_h1").cast("double").alias("y_true"),
                            C.log1p_clip(F.col("target_h1")).alias("y_log"))
    return s.stored("training_h1", build)


def split(s):
    rows = training(s)
    border = F.lit(HOLDOUT_START).cast("date")
    return rows.where(F.col("target_date") < border), rows.where(F.col("week_st") >= border)


def _out(df, model):
    return df.select(*KEY, "target_date", F.lit(model).alias("model"), "y_true", r6(F.col("y_pred")).alias("y_pred"))


def _ar_sql(horizons, seasons=()):
    """The same stages over the check side's grid."""
    last = max(horizons)
    nest = lambda sql, stages: sql if not stages else nest(f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in stages[0].items())} FROM ({sql})", stages[1:])
    rows = nest("SELECT center_id, sku_id, week_st, qty FROM gq", AR.lag_stages(HOLDOUT_START, seasons, last))
    sums = f"SELECT center_id, sku_id, {', '.join(f'{e} AS {c}' for c, e in AR.sum_stage(seasons).items())} FROM ar_lagged GROUP BY 1, 2"
    fits = f"SELECT center_id, sku_id, status, season, mean_qty, w0, w1, w2, w3 FROM ({nest(sums, [*AR.choice_stages(seasons), *AR.fit_stages(seasons)])})"
    ahead = nest("SELECT * FROM (SELECT * EXCLUDE (n_known, first_row) FROM ar_lagged WHERE NOT known) JOIN ar_fitted USING (center_id, sku_id)", AR.path_stages(seasons, last))
    name = "ar_seasonal" if seasons else "ar"
    out = " UNION ALL ".join(f"SELECT center_id, sku_id, week_st, {h} AS horizon, week_st + {7 * h} AS target_date, '{name}' AS model, status, CAST(season AS INT) AS season, raw{h} AS y_raw FROM ar_ahead" for h in horizons)
    return f"""WITH ar_lagged AS MATERIALIZED ({rows}), ar_fitted AS MATERIALIZED ({fits}), ar_ahead AS MATERIALIZED ({ahead})
SELECT * EXCLUDE (y_raw), CASE WHEN y_raw > 0 AND y_raw < 'infinity'::DOUBLE THEN y_raw ELSE 0 END AS y_pred, y_raw FROM ({out})"""


SEASONS = (13, 26, 52)
cte("ar_plain", _ar_sql(HORIZONS))
cte("ar_best", _ar_sql(HORIZONS, SEASONS))
_AR = "center_id, sku_id, week_st, horizon, target_date, model, status, season, round(y_pred, 6) AS y_pred, round(y_raw, 6) AS y_raw"


def ar_forecasts(s, seasonal):
    name = "ar_seasonal" if seasonal else "ar_plain"
    return s.stored(name, lambda: AR.per_series_fit(stored_grid(s), HOLDOUT_START, HORIZONS, SEASONS if seasonal else ()))


def _rounded(df):
    return df.withColumns({"y_pred": r6(F.col("y_pred")), "y_raw": r6(F.col("y_raw"))})


@query("J05", "per_series_fit", f"SELECT {_AR} FROM ar_plain")
def per_series_fit(s):
    return _rounded(AR.per_series_fit(stored_grid(s), HOLDOUT_START, HORIZONS))


@query("J06", "seasonal_fit", f"SELECT {_AR} FROM ar_best")
def seasonal_fit(s):
    return _rounded(AR.per_series_fit(stored_grid(s), HOLDOUT_START, HORIZONS, SEASONS))


cte("ar_quarter", _ar_sql((1,), (13,)))


@query("J07", "fit_parallel", "SELECT center_id, status, season, count(DISTINCT sku_id) AS series, count(*) AS forecasts FROM ar_quarter GROUP BY 1, 2, 3")
def fit_parallel(s):
    """Fit outcome per series: one failing series never stops the others."""
    fits = AR.per_series_fit(stored_grid(s), HOLDOUT_START, (1,), seasons=(13,))
    return fits.groupBy("center_id", "status", "season").agg(F.count_distinct("sku_id").alias("series"), F.count("*").alias("forecasts"))


@query("J08", "forest_regression")
def forest_regression(s):
    train, hold = split(s)
    return _out(FC.predict_log(FC.fit_trees(train, COLS, "y_log", "forest", numTrees=20, **TREE), hold), "forest")


def _audit(df):
    """Keys, actuals and usable predictions of a model's rows."""
    return df.groupBy("model").agg(F.count("*").alias("n"), F.count_distinct("center_id", "sku_id", "week_st").alias("keys"), F.sum("y_true").cast("double").alias("y_true"),
                                   F.count_if(F.col("y_pred").isNull() | F.isnan("y_pred")).alias("missing"), F.count_if(F.col("y_pred") < 0).alias("negative"))


_AUDIT = f"""SELECT '{{}}' AS model, count(*) AS n, count(*) AS keys, CAST(sum(y) AS DOUBLE) AS y_true, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS negative
FROM (SELECT week_st, lead(qty) OVER (PARTITION BY center_id, sku_id ORDER BY week_st) AS y FROM gq) WHERE y IS NOT NULL AND week_st >= DATE '{HOLDOUT_START}'"""


@query("J08", "forest_audit", _AUDIT.format("forest"))
def forest_audit(s):
    return _audit(forest_regression(s))


@query("J11", "tweedie_audit", _AUDIT.format("tweedie"))
def tweedie_audit(s):
    return _audit(tweedie(s))


@query("J06", "seasonal_audit", f"""
SELECT count(*) * 3 AS n, count(*) AS keys, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS negative, CAST(0 AS BIGINT) AS beyond FROM gq WHERE week_st >= DATE '{HOLDOUT_START}'""")
def seasonal_audit(s):
    """Every origin has every horizon once, delivered forecasts are usable, and target dates follow the horizon."""
    rows = seasonal_fit(s)
    return rows.agg(F.count("*").alias("n"), F.count_distinct("center_id", "sku_id", "week_st").alias("keys"), F.count_if(F.col("y_pred").isNull() | F.isnan("y_pred")).alias("missing"),
                    F.count_if(F.col("y_pred") < 0).alias("negative"), F.count_if(F.col("target_date") != F.date_add("week_st", F.col("horizon") * 7)).alias("beyond"))


@query("J09", "boosted_regression")
def boosted_regression(s):
    train, hold = split(s)
    return _out(FC.predict_log(FC.fit_trees(train, COLS, "y_log", "boosted", maxIter=10, **TREE), hold), "boosted")


@query("J10", "hurdle")
def hurdle(s):
    train, hold = split(s)
    scored = FC.predict_hurdle(FC.fit_hurdle(train, COLS, "y_true", maxIter=8, **TREE), hold)
    return scored.select(*KEY, "target_date", F.lit("hurdle").alias("model"), "y_true", r6(F.col("sale_probability")).alias("sale_probability"),
                         r6(F.col("conditional_qty")).alias("conditional_qty"), r6(F.col("y_pred")).alias("y_pred"))


@query("J11", "tweedie")
def tweedie(s):
    train, hold = split(s)
    scale = lambda df: df.withColumns({c: F.col(c) / 100 for c in ("lag1", "lag2", "lag4_filled", "roll_mean_4_filled", "weeks_inactive")})
    model = FC.fit_tweedie(scale(train), COLS, "y_true")
    return _out(model.transform(scale(hold)).withColumn("y_pred", F.col("prediction")), "tweedie")


def _score(rows, fold, params, seed):
    """Fit one grid point on one fold and keep additive error sums."""
    name, lo, hi = fold.name, fold.val_start, fold.val_end
    val = rows.where(F.col("target_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    model = FC.fit_trees(rows.where(F.col("target_date") < F.lit(lo).cast("date")), COLS, "y_log", "forest", seed=seed, maxBins=32, **params)
    err = F.col("y_pred") - F.col("y_true")
    return FC.predict_log(model, val).agg(F.sum(F.abs(err)).alias("e"), F.sum(err).alias("b"), F.sum("y_true").alias("y"), F.count("*").alias("n")).select(
        F.lit(name).alias("fold"), F.lit(seed).alias("seed"), *[F.lit(v).alias(k) for k, v in params.items()], "*")


def _fold_rates(df, keys):
    per = df.withColumn("wape", F.col("e") / F.col("y") * 100)
    return per.groupBy(*keys).agg(r6(F.sum("e") / F.sum("y") * 100).alias("pooled_wape"), r6(F.sum("b") / F.sum("y") * 100).alias("pooled_bias"),
                                  r6(F.max("wape")).alias("worst_fold_wape"), F.sum("n").alias("n"))


_RATES = """round(sum(e) / sum(y) * 100, 6) AS pooled_wape, round(sum(b) / sum(y) * 100, 6) AS pooled_bias, round(sqrt(sum(q) / sum(n)), 6) AS rmse, round(sum(e) / sum(n), 6) AS mae,
 max(round(e / nullif(y, 0) * 100, 6)) AS worst_fold_wape, count(*) AS folds, CAST(sum(n) AS BIGINT) AS n"""


@query("J12", "grid_trials", f"SELECT model, horizon, trial, ridge, {_RATES} FROM wf_tried GROUP BY 1, 2, 3, 4")
def grid_trials(s):
    """Every family and grid point on every fold of both centres, on the keys common to all of them."""
    return forecasts.rates(forecasts.grid_fits(s), ["model", "horizon", "trial", "ridge"])


@query("J13", "seed_trials", f"""
SELECT model, horizon, trial, seed, {_RATES} FROM (
 SELECT model, horizon, trial, seed, fold, sum(abs(y_pred - y_true)) AS e, sum(y_pred - y_true) AS b, sum((y_pred - y_true) * (y_pred - y_true)) AS q, sum(y_true) AS y, count(*) AS n
 FROM oof JOIN (SELECT model, horizon, trial FROM represent) USING (model, horizon) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4""")
def seed_trials(s):
    """The chosen trial of every family and horizon, refitted at three seeds."""
    return forecasts.rates(forecasts.seed_fits(s), ["model", "horizon", "trial", "seed"])


def _forest_grid(s):
    rows = training(s)
    grid = [{"numTrees": t, "maxDepth": d} for t, d in product((5, 10), (3, 5))]
    return grid, _fold_rates(union_all([_score(rows, fold, p, 42).withColumn("trial", F.lit(i)) for i, p in enumerate(grid) for fold in FOLDS]), ["trial", "numTrees", "maxDepth"])


@query("J12", "grid_trials_forest")
def grid_trials_forest(s):
    return _forest_grid(s)[1]


@query("J13", "seed_trials_forest")
def seed_trials_forest(s):
    """The chosen forest of the grid at three seeds."""
    rows, (grid, tried) = training(s), _forest_grid(s)
    chosen = EV.representative_trial(tried.withColumn("model", F.lit("forest")), ["model"]).select("trial").first().trial
    return _fold_rates(union_all([_score(rows, fold, grid[chosen], seed) for seed in SEEDS for fold in FOLDS]), ["seed", "numTrees", "maxDepth"])


@query("J15", "importance")
def importance(s):
    """Error that the boosted model adds on the holdout when a feature is taken from another row, at two seeds; the model's own split gain beside it."""
    train, hold = split(s)
    model = FC.fit_trees(train, COLS, "y_log", "boosted", maxIter=5, **TREE)
    moved = FC.permutation_importance(model, hold, COLS, "y_true", KEY, SEEDS[:2])
    ranked = moved.groupBy("feature").agg(F.avg("increase").alias("importance"), (F.max("increase") - F.min("increase")).alias("seed_spread"))
    gain = s.rows(FC.importance(model, COLS), "feature string, split_gain double")
    order = F.row_number().over(W.orderBy(F.desc("importance"), "feature"))  # one row per feature
    return ranked.join(F.broadcast(gain), "feature").withColumn("rank", order)
