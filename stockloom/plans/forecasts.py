"""Baseline forecasts, out-of-fold predictions and trial records on the test tables."""

from pyspark.sql import functions as F

from stockloom.functions.columns import r6
from stockloom.operators import evaluation as EV
from stockloom.operators import forecasting as FC
from stockloom.operators import joins as J
from stockloom.operators import folds as FO
from stockloom.operators import marts as M
from stockloom.operators import walkforward as WF
from stockloom.plans import marts as P
from stockloom.plans.series import KEY, _K, grid, stored_grid
from stockloom.registry import cte, query
from stockloom.sources import files
from stockloom.sources.adapters import HOLDOUT_START, HORIZONS, REGIME_START, VALIDATION_YEARS
from stockloom.sources.storage import shared_dir

MODELS = ["last", "ma4", "level", "season", "category"]
CATS = ["cat_s", "cat_m", "cat_l"]
SEEDS = (1, 2, 3)
FOLDS = [f for y in VALIDATION_YEARS for f in FO.quarter_folds(y)]
_ROW_KEY = "concat_ws('|', center_id, sku_id, cast(week_st as string))"

# -- check side ------------------------------------------------------------
_W = "PARTITION BY center_id, sku_id ORDER BY week_st"


def _run_mean(level):
    return (f"cm_{level} AS (SELECT center_id, {level}, week_st, CAST((2000000 * sum(s) OVER z + sum(n) OVER z) // (2 * sum(n) OVER z) AS DOUBLE) / 1000000 AS m "
            f"FROM (SELECT center_id, {level}, week_st, CAST(sum(qty) AS HUGEINT) AS s, count(*) AS n FROM gq GROUP BY 1, 2, 3) WINDOW z AS (PARTITION BY center_id, {level} ORDER BY week_st))")


cte("levels", f"""
WITH {', '.join(_run_mean(c) for c in CATS)}
SELECT gq.*, CAST(qty AS DOUBLE) AS p_last, avg(qty) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS p_ma4,
 avg(qty) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS p_level, row_number() OVER ({_W}) AS n_obs, sum(sold) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS n_sold,
 a.m AS m_cat_s, b.m AS m_cat_m, c.m AS m_cat_l,
 {', '.join(f'lead(qty, {h}) OVER ({_W}) AS y_{h}, CAST(lag(qty, {52 - h}) OVER ({_W}) AS DOUBLE) AS s_{h}' for h in HORIZONS)}
FROM gq JOIN cm_cat_s a USING (center_id, cat_s, week_st) JOIN cm_cat_m b USING (center_id, cat_m, week_st) JOIN cm_cat_l c USING (center_id, cat_l, week_st)""")


def _preds_sql(start, horizons):
    parts = []
    for h in horizons:
        for m, p in (("last", "p_last"), ("ma4", "p_ma4"), ("level", "p_level"), ("season", f"s_{h}"), ("category", "coalesce(m_cat_s, m_cat_m, m_cat_l)")):
            parts.append(f"SELECT center_id, sku_id, week_st, cat_s, cat_m, cat_l, CAST(n_obs AS INT) AS n_obs, CAST(n_sold AS BIGINT) AS n_sold, CASE WHEN n_sold = 0 THEN 'no_history' WHEN n_obs < 52 THEN 'short' ELSE 'model' END AS source, "
                         f"{h} AS horizon, week_st + {7 * h} AS target_date, '{m}' AS model, y_{h} AS y_true, {p} AS y_pred FROM levels "
                         f"WHERE week_st >= DATE '{start}' AND y_{h} IS NOT NULL AND {p} IS NOT NULL")
    return " UNION ALL ".join(parts)


cte("preds", _preds_sql(HOLDOUT_START, HORIZONS))
cte("dev_preds", f"SELECT * FROM ({_preds_sql('1998-12-28', HORIZONS)}) WHERE target_date < DATE '{HOLDOUT_START}'")
cte("mase", f"""
SELECT center_id, sku_id, CASE WHEN count(*) >= 2 AND avg(d) > 0 THEN avg(d) END AS mase_scale FROM (
 SELECT center_id, sku_id, abs(qty - lag(qty) OVER ({_W})) AS d FROM gq WHERE week_st < DATE '{HOLDOUT_START}') GROUP BY 1, 2""")
METRIC = """round(sum(abs(y_pred - y_true)) / nullif(sum(y_true), 0) * 100, 6) AS wape, round(sum(y_pred - y_true) / nullif(sum(y_true), 0) * 100, 6) AS bias,
 round(sqrt(avg((y_pred - y_true) * (y_pred - y_true))), 6) AS rmse, round(avg(abs(y_pred - y_true)), 6) AS mae, count(*) AS n"""
MASE = "round(avg(abs(y_pred - y_true) / mase_scale), 6) AS mase, count(mase_scale) AS mase_n"
# Walk-forward fits: the same expressions are SQL on both sides; sums, folds and selection are written anew.
cte("wf_rows", " UNION ALL ".join(
    f"SELECT center_id, sku_id, week_st, {h} AS horizon, week_st + {7 * h} AS target_date, y_{h} AS y_true, {WF.milli('p_last')} AS x1, {WF.milli('p_ma4')} AS x2, {WF.milli(f'coalesce(s_{h}, p_level)')} AS x3, "
    f"{WF.milli('p_level')} AS x4, {WF.milli('coalesce(m_cat_s, m_cat_m, m_cat_l)')} AS x5, "
    f"{WF.seed_group(_ROW_KEY)} AS g FROM levels WHERE y_{h} IS NOT NULL" for h in HORIZONS))
cte("wf_marked", f"""
WITH wk AS (SELECT horizon, week_st, CAST(100 + row_number() OVER (PARTITION BY horizon ORDER BY week_st) AS INT) AS nr FROM (
 SELECT DISTINCT horizon, week_st FROM wf_rows WHERE center_id = 'B' AND week_st >= DATE '{REGIME_START}' AND target_date <= DATE '{HOLDOUT_START}'))
SELECT r.*, CASE WHEN center_id = 'B' THEN CASE WHEN week_st >= DATE '{REGIME_START}' AND target_date <= DATE '{HOLDOUT_START}' THEN nr END
 WHEN year(target_date) BETWEEN {VALIDATION_YEARS[0]} AND {VALIDATION_YEARS[-1]} THEN CAST((year(target_date) - {VALIDATION_YEARS[0]}) * 4 + quarter(target_date) AS INT) END AS fold FROM wf_rows r LEFT JOIN wk USING (horizon, week_st)""")
cte("wf_sums", f"""
WITH weekly AS (SELECT center_id, horizon, target_date AS day, g, count(*) AS n, {', '.join(f'{e} AS {c}' for c, e in zip(WF.SUMS, WF.sum_columns(), strict=True))}
  FROM wf_marked WHERE center_id <> 'B' OR week_st >= DATE '{REGIME_START}' GROUP BY ALL),
 border AS (SELECT horizon, fold, CASE WHEN fold > 100 THEN min(target_date) ELSE make_date({VALIDATION_YEARS[0]} + (fold - 1) // 4, (fold - 1) % 4 * 3 + 1, 1) END AS day FROM wf_marked WHERE fold IS NOT NULL GROUP BY 1, 2)
SELECT b.horizon, b.fold, seed, sum(n) AS n, {', '.join(f'sum({c}) AS {c}' for c in WF.SUMS)}
FROM border b JOIN weekly w ON w.horizon = b.horizon AND w.day < b.day AND (b.fold > 100 OR center_id <> 'B'), (SELECT CAST(unnest([0, 1, 2, 3]) AS INT) AS seed) s
WHERE seed = 0 OR g <> seed GROUP BY 1, 2, 3 HAVING sum(n) >= {WF.LEAST_ROWS}""")


def _coef_sql():
    parts = []
    for m in WF.FAMILIES:
        terms = ", ".join(f"{e}{' + ridge' if t[0] == 'a' and t[1] == t[2] != '0' else ''} AS {t}" for t, e in WF.family_terms(m).items())
        parts.append(f"SELECT '{m}' AS model, horizon, trial, seed, fold, ridge, n AS train_rows, {terms} FROM wf_sums, "
                     f"(VALUES {', '.join(f'(CAST({k} AS INT), CAST({v} AS DOUBLE))' for k, v in enumerate(WF.LAMBDAS, 1))}) v(trial, ridge)")
    sql = " UNION ALL ".join(parts)
    for step in WF.solution():
        sql = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in step)} FROM ({sql})"
    return f"SELECT model, horizon, trial, seed, fold, ridge, train_rows, {', '.join(f'{WF.coefficient(i)} AS c{i}' for i in range(6))} FROM ({sql})"


cte("wf_coef", _coef_sql())
cte("wf_common", """
SELECT horizon, fold FROM (SELECT horizon, fold, count(*) AS k FROM wf_coef WHERE seed = 0 GROUP BY 1, 2) WHERE k = (SELECT count(*) FROM (SELECT DISTINCT model, trial FROM wf_coef WHERE seed = 0))""")
cte("wf_tried", f"""
SELECT model, horizon, trial, ridge, fold, sum(abs(y_pred - y_true)) AS e, sum(y_pred - y_true) AS b, sum((y_pred - y_true) * (y_pred - y_true)) AS q, sum(y_true) AS y, count(*) AS n FROM (
 SELECT c.model, c.horizon, c.trial, c.ridge, c.fold, y_true, {WF.PREDICTION} AS y_pred FROM wf_marked r JOIN wf_coef c ON r.horizon = c.horizon AND r.fold = c.fold WHERE seed = 0) SEMI JOIN wf_common USING (horizon, fold) GROUP BY ALL""")
cte("trial_rows", """
SELECT model, horizon, trial, round(sum(e) / sum(y) * 100, 6) AS pooled_wape, round(sum(b) / sum(y) * 100, 6) AS pooled_bias, round(sqrt(sum(q) / sum(n)), 6) AS rmse, round(sum(e) / sum(n), 6) AS mae,
 max(round(e / nullif(y, 0) * 100, 6)) AS worst_fold_wape FROM wf_tried GROUP BY 1, 2, 3""")
cte("oof", f"""
SELECT r.center_id, r.sku_id, week_st, r.horizon, target_date, c.model, y_true, {WF.PREDICTION} AS y_pred, c.seed, r.fold, mase_scale
FROM wf_marked r JOIN wf_coef c ON r.horizon = c.horizon AND r.fold = c.fold JOIN represent p ON p.model = c.model AND p.horizon = c.horizon AND p.trial = c.trial
LEFT JOIN mase m ON m.center_id = r.center_id AND m.sku_id = r.sku_id WHERE c.seed > 0""")


# -- Spark side ------------------------------------------------------------
def rolling(s, start=HOLDOUT_START, horizons=HORIZONS):
    return FC.rolling_origin(stored_grid(s), start, horizons, P.last_week(s), CATS)


def preds(s):
    """Holdout predictions of every model, origin and horizon."""
    return s.stored("predictions", lambda: rolling(s))


def validation(s):
    """The same models on the origins of the year before the holdout, targets inside it: rows to choose by."""
    return s.stored("validation_predictions", lambda: rolling(s, "1998-12-28").where(F.col("target_date") < F.lit(HOLDOUT_START).cast("date")))


def history(s):
    return stored_grid(s).where(F.col("week_st") < F.lit(HOLDOUT_START).cast("date"))


def oof(s):
    return s.stored("out_of_fold", lambda: build_oof(s))


def marked(s):
    """Every origin of both centres and all horizons with its features and validation fold."""
    def build():
        rows = WF.origin_rows(stored_grid(s), HORIZONS, P.last_week(s), CATS)
        return WF.mark_folds(rows, FOLDS, "B", REGIME_START, HOLDOUT_START)
    return s.stored("walkforward_rows", build)


def fold_sums(s):
    return s.stored("fold_sums", lambda: WF.fold_sums(marked(s), WF.fold_borders(marked(s), FOLDS, "B"), "B", REGIME_START, (0, *SEEDS)))


def fits(s, points):
    """Rows of the trial table for (model, horizon, trial, ridge, seed) points on every fold that can be fitted."""
    sums = fold_sums(s)
    wanted = points.join(sums.select("horizon", "seed", "fold"), ["horizon", "seed"])
    rules = WF.definition(FOLDS, REGIME_START, HOLDOUT_START, HORIZONS, CATS)
    return WF.run_trials(s.spark, f"{shared_dir(s.spark).rstrip('/')}/trial-table-{rules}", s.fingerprint(), wanted, lambda todo: WF.fit_and_score(marked(s), sums, todo))


def grid_fits(s):
    """Every family and ridge on every fold, fitted on all rows (seed 0)."""
    points = [(m, h, t, v, 0) for m in WF.FAMILIES for h in HORIZONS for t, v in enumerate(WF.LAMBDAS, 1)]
    return WF.common_folds(fits(s, s.rows(points, "model string, horizon int, trial int, ridge double, seed int")))


def seed_fits(s):
    """The chosen trial of every family and horizon, refitted without the rows that each seed leaves out."""
    chosen = EV.representative_trial(trials(s), ["model", "horizon"]).select("model", "horizon", "trial")
    ridge = F.element_at(F.array(*[F.lit(v) for v in WF.LAMBDAS]), F.col("trial"))
    return fits(s, chosen.withColumn("ridge", ridge).withColumn("seed", F.explode(F.array(*[F.lit(k) for k in SEEDS]))))


def build_oof(s):
    """Out-of-fold predictions of the chosen trials at three seeds: quarters of both validation years in A, every walk-forward week in B."""
    rows = WF.predict(marked(s), seed_fits(s).select(*WF.FIT_KEYS, *WF.COEFS))
    return rows.join(EV.mase_scale(history(s)), M.SKU, "left").select(*KEY, "horizon", "target_date", "model", "y_true", "y_pred", "seed", "fold", "mase_scale")


def rates(df, keys):
    """Pooled rates and the worst fold's, from the additive errors of the fits."""
    return df.groupBy(*keys).agg(
        r6(F.sum("e") / F.sum("y") * 100).alias("pooled_wape"), r6(F.sum("b") / F.sum("y") * 100).alias("pooled_bias"), r6(F.sqrt(F.sum("q") / F.sum("val_rows"))).alias("rmse"),
        r6(F.sum("e") / F.sum("val_rows")).alias("mae"), F.max(r6(WF.rate("e", "y"))).alias("worst_fold_wape"), F.count("*").alias("folds"), F.sum("val_rows").alias("n"))


def trials(s):
    return s.stored("trial_rows", lambda: rates(grid_fits(s), ["model", "horizon", "trial"]).drop("folds", "n"))


# -- registered ------------------------------------------------------------
cte("sku_class", """
SELECT center_id, sku_id, count(*) AS weeks, CASE WHEN count(*) < 6 THEN 'short' WHEN min(qty) = max(qty) THEN 'constant' ELSE 'eligible' END AS series_class FROM gq GROUP BY 1, 2""")


@query("J01", "series_class", "SELECT * FROM sku_class")
def series_class(s):
    return FC.series_class(grid(s)).select(*M.SKU, "weeks", "series_class")


@query("J02", "baseline_forecast", f"""
WITH l AS (SELECT center_id, sku_id, avg(qty) AS m, min(qty) AS lo, max(qty) AS hi FROM gq WHERE week_st < DATE '{HOLDOUT_START}' GROUP BY 1, 2)
SELECT center_id, sku_id, CASE WHEN m IS NULL THEN 'none' WHEN lo = hi THEN 'constant' ELSE 'level' END AS source, round(coalesce(m, 0), 6) AS y_pred, CAST(h AS INT) AS horizon
FROM (SELECT DISTINCT center_id, sku_id FROM gq) LEFT JOIN l USING (center_id, sku_id), (SELECT unnest([1, 2, 4]) AS h)""")
def baseline_forecast(s):
    g = grid(s)
    known = g.where(F.col("week_st") < F.lit(HOLDOUT_START).cast("date"))
    return FC.baseline_forecast(known, g.select(*M.SKU).distinct(), HORIZONS).withColumn("y_pred", r6(F.col("y_pred")))


@query("J03", "coldstart_means", f"SELECT {_K}, round(m_cat_s, 6) AS m_cat_s, round(m_cat_m, 6) AS m_cat_m, round(m_cat_l, 6) AS m_cat_l FROM levels")
def coldstart_means(s):
    return FC.coldstart_means(stored_grid(s), CATS).select(*KEY, *[r6(F.col(f"m_{c}")).alias(f"m_{c}") for c in CATS])


@query("J04", "rolling_origin_eval", """
SELECT week_st, horizon, model, source, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS y_true, round(sum(y_pred), 4) AS y_pred FROM preds GROUP BY 1, 2, 3, 4""")
def rolling_origin_eval(s):
    return rolling(s).groupBy("week_st", "horizon", "model", "source").agg(
        F.count("*").alias("n"), F.sum("y_true").alias("y_true"), F.round(F.sum("y_pred"), 4).alias("y_pred"))


@query("J14", "oof_frame", "SELECT center_id, sku_id, week_st, horizon, target_date, model, seed, fold, y_true, round(y_pred, 6) AS y_pred, round(mase_scale, 6) AS mase_scale FROM oof")
def oof_frame(s):
    return build_oof(s).withColumns({"y_pred": r6(F.col("y_pred")), "mase_scale": r6(F.col("mase_scale"))})


cte("wide", """
SELECT center_id, sku_id, week_st, """ + ", ".join(
    f"max(CASE WHEN horizon = {h} THEN y_pred END) AS h{h}_pred, max(CASE WHEN horizon = {h} THEN target_date END) AS h{h}_target_date" for h in HORIZONS)
    + " FROM preds WHERE model = 'ma4' GROUP BY 1, 2, 3")


def wide(s):
    return FC.widen_horizons(preds(s).where("model = 'ma4'"), HORIZONS)


@query("C09", "widen_horizons", "SELECT * FROM wide")
def widen_horizons(s):
    return wide(s)


@query("C10", "trend_long", """
SELECT center_id, sku_id, week_st, 'actual' AS series, CAST(qty AS DOUBLE) AS value FROM gq UNION ALL
SELECT center_id, sku_id, week_st, 'origin', CAST(qty AS DOUBLE) FROM gq SEMI JOIN wide USING (center_id, sku_id, week_st) """ + " ".join(
    f"UNION ALL SELECT center_id, sku_id, h{h}_target_date, 'h{h}', h{h}_pred FROM wide WHERE h{h}_pred IS NOT NULL" for h in HORIZONS))
def trend_long(s):
    from stockloom.operators.reshape import trend_long as build
    return build(grid(s), wide(s), HORIZONS)


@query("C11", "bridge_rows", """
WITH a AS (SELECT center_id, sku_id, max(week_st) AS week_st, arg_max(qty, week_st) AS v FROM gq WHERE week_st < DATE '2000-10-02' GROUP BY 1, 2)
SELECT center_id, sku_id, week_st, 'actual' AS part, qty AS value FROM gq WHERE week_st < DATE '2000-10-02' UNION ALL SELECT center_id, sku_id, week_st, 'forecast', v FROM a""")
def bridge_rows(s):
    from stockloom.operators.reshape import bridge_rows as build
    return build(grid(s).where("week_st < date'2000-10-02'"), "week_st", "qty")


@query("C12", "pivot_blocks", "SELECT center_id, sku_id, week_st, horizon, " + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN y_pred END) AS {m}" for m in MODELS) + " FROM preds GROUP BY 1, 2, 3, 4")
def pivot_blocks(s):
    return preds(s).groupBy(*KEY, "horizon").pivot("model", MODELS).agg(F.max("y_pred"))


@query("D18", "common_key_join", f"""
WITH k AS (SELECT center_id, sku_id, week_st, horizon FROM oof WHERE seed = 1 GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT model) = {len(WF.FAMILIES)})
SELECT model, horizon, fold, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS y_true FROM oof SEMI JOIN k USING (center_id, sku_id, week_st, horizon) WHERE seed = 1 GROUP BY 1, 2, 3""")
def common_key_join(s):
    one = oof(s).where("seed = 1")
    return EV.common_panel(one, len(WF.FAMILIES)).groupBy("model", "horizon", "fold").agg(F.count("*").alias("n"), F.sum("y_true").alias("y_true"))


_BITS = ", ".join(f"max(CASE WHEN model = '{m}' THEN 1 ELSE 0 END) AS {m}" for m in MODELS)


@query("D19", "key_set_ops", f"""
WITH b AS (SELECT center_id, sku_id, week_st, horizon, {_BITS} FROM preds GROUP BY 1, 2, 3, 4)
SELECT 'all_three' AS part, count(*) FILTER (WHERE last + season + category = 3) AS n FROM b UNION ALL
SELECT 'level_minus_season', count(*) FILTER (WHERE level = 1 AND season = 0) FROM b""")
def key_set_ops(s):
    from stockloom.operators.keys import common_keys, only_in_first
    from stockloom.operators.profiling import count_rows
    p = preds(s)
    by = {m: p.where(F.col("model") == m) for m in MODELS}
    return count_rows({"all_three": common_keys([by["last"], by["season"], by["category"]], EV.ROW),
                       "level_minus_season": only_in_first(by["level"], by["season"], EV.ROW)}, "part")


cte("panel", """
SELECT p.* FROM preds p SEMI JOIN (SELECT center_id, sku_id, week_st, horizon FROM preds GROUP BY 1, 2, 3, 4
 HAVING count(DISTINCT model) = 5 AND min(y_true) = max(y_true)) k USING (center_id, sku_id, week_st, horizon)""")


def panel(s):
    return EV.common_panel(preds(s), len(MODELS))


@query("D20", "n_way_common_panel", "SELECT model, horizon, center_id, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS y_true FROM panel GROUP BY 1, 2, 3")
def n_way_common_panel(s):
    return panel(s).groupBy("model", "horizon", "center_id").agg(F.count("*").alias("n"), F.sum("y_true").alias("y_true"))


def _pair_sql():
    parts = []
    for i, a in enumerate(MODELS):
        for b in MODELS[i + 1:]:
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            w = lambda m: f"round(sum(abs({m} - y)) FILTER (WHERE {both}) / nullif(sum(y) FILTER (WHERE {both}), 0) * 100, 6)"
            parts.append(f"SELECT '{a}|{b}' AS pair, count(*) FILTER (WHERE {both}) AS common, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NULL) AS only_first, "
                         f"count(*) FILTER (WHERE {b} IS NOT NULL AND {a} IS NULL) AS only_second, {w(a)} AS wape_first, {w(b)} AS wape_second FROM w")
    cols = ", ".join(f"max(CASE WHEN model = '{m}' THEN y_pred END) AS {m}" for m in MODELS)
    return f"WITH w AS (SELECT max(y_true) AS y, {cols} FROM preds GROUP BY center_id, sku_id, week_st, horizon) " + " UNION ALL ".join(parts)


@query("D21", "pairwise_common", _pair_sql())
def pairwise_common(s):
    return EV.pairwise_common(preds(s), MODELS)


@query("D22", "apply_override", """
WITH o AS (SELECT DISTINCT center_id, sku_id, CAST(0 AS DOUBLE) AS v FROM preds WHERE n_sold = 0 OR n_sold < 80)
SELECT center_id, sku_id, week_st, horizon, CASE WHEN v IS NOT NULL THEN 'override' ELSE 'model' END AS override_source, round(coalesce(v, y_pred), 6) AS y_pred
FROM preds LEFT JOIN o USING (center_id, sku_id) WHERE model = 'ma4'""")
def apply_override(s):
    p = preds(s).where("model = 'ma4'")
    rare = preds(s).where("n_sold < 80").select(*M.SKU, F.lit(0.0).alias("y_pred")).distinct()
    return J.apply_override(p, rare, M.SKU, "y_pred").select(*KEY, "horizon", "override_source", r6(F.col("y_pred")).alias("y_pred"))


TRIAL_SCHEMA = ("model string, horizon int, all_trials array<struct<trial:int,pooled_wape:double,pooled_bias:double,"
                "worst_fold_wape:double,params:map<string,double>>>")


def trial_documents(s):
    t = trials(s)
    flat = t.groupBy("model", "horizon").agg(F.sort_array(F.collect_list(F.struct("trial", "pooled_wape", "pooled_bias", "worst_fold_wape"))).alias("x"))
    return flat.select("model", "horizon", F.transform("x", lambda r: F.struct(
        r["trial"].alias("trial"), r["pooled_wape"].alias("pooled_wape"), r["pooled_bias"].alias("pooled_bias"), r["worst_fold_wape"].alias("worst_fold_wape"),
        F.create_map(F.lit("ridge"), F.element_at(F.array(*[F.lit(v) for v in WF.LAMBDAS]), r["trial"])).alias("params"))).alias("all_trials"))


@query("A13", "read_trials_json", f"SELECT model, horizon, trial, pooled_wape, pooled_bias, worst_fold_wape, [{', '.join(f'CAST({v} AS DOUBLE)' for v in WF.LAMBDAS)}][trial] AS ridge FROM trial_rows")
def read_trials_json(s):
    path = files.write_json_documents(trial_documents(s), "trials")
    return files.read_trials_json(s.spark, path, TRIAL_SCHEMA).select(
        "model", "horizon", "trial", "pooled_wape", "pooled_bias", "worst_fold_wape", F.col("params")["ridge"].alias("ridge"))


@query("C06", "eav_to_map", """
SELECT model, horizon, trial, concat('bias=', CAST(CAST(round(pooled_bias * 1000) AS BIGINT) AS VARCHAR), ';point=', CAST(trial AS VARCHAR), ';wape=', CAST(CAST(round(pooled_wape * 1000) AS BIGINT) AS VARCHAR)) AS params FROM trial_rows""")
def eav_to_map(s):
    from stockloom.operators.reshape import eav_to_map as build
    long = trials(s).select("model", "horizon", "trial", F.explode(F.array(
        F.struct(F.lit("point").alias("k"), F.col("trial").cast("bigint").alias("v")),
        F.struct(F.lit("wape").alias("k"), F.round(F.col("pooled_wape") * 1000).cast("bigint").alias("v")),
        F.struct(F.lit("bias").alias("k"), F.round(F.col("pooled_bias") * 1000).cast("bigint").alias("v")))).alias("e")).select("model", "horizon", "trial", "e.k", "e.v")
    out = build(long, ["model", "horizon", "trial"], "k", "v", "params")
    text = F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return out.select("model", "horizon", "trial", text.alias("params"))
