"""Metrics, comparison and selection on the test tables."""

from pyspark.sql import functions as F

from stockloom.functions.columns import div, r6
from stockloom.operators import evaluation as EV
from stockloom.operators import forecasting as FC
from stockloom.operators import marts as M
from stockloom.operators.profiling import union_all
from stockloom.operators.walkforward import FAMILIES
from stockloom.plans.forecasts import MASE, METRIC, MODELS, SEEDS, history, oof, panel, preds, stored_grid, trials, validation, wide
from stockloom.plans.series import KEY, _K
from stockloom.registry import cte, query
from stockloom.sources.adapters import HOLDOUT_START, HORIZONS, REGIME_START

WAPE = "round(sum(abs(y_pred - y_true)) / nullif(sum(y_true), 0) * 100, 6)"
BIAS = "round(sum(y_pred - y_true) / nullif(sum(y_true), 0) * 100, 6)"

cte("scored", "SELECT p.*, mase_scale FROM preds p LEFT JOIN mase USING (center_id, sku_id)")


def scored(s):
    return preds(s).join(EV.mase_scale(history(s)), M.SKU, "left")


@query("H01", "metrics", f"SELECT model, horizon, {METRIC}, {MASE} FROM scored GROUP BY 1, 2")
def metrics(s):
    return EV.metrics(scored(s), ["model", "horizon"], scale=True)


@query("H02", "mase_scale", "SELECT center_id, sku_id, round(mase_scale, 6) AS mase_scale FROM mase")
def mase_scale(s):
    return EV.mase_scale(history(s)).withColumn("mase_scale", r6(F.col("mase_scale")))


@query("H03", "metrics_by_scope", f"SELECT coalesce(center_id, 'ALL') AS scope, horizon, model, {METRIC} FROM preds GROUP BY GROUPING SETS ((center_id, horizon, model), (horizon, model))")
def metrics_by_scope(s):
    return EV.scoped_metrics(preds(s), ["horizon", "model"])


@query("H04", "metrics_by_source", f"""
SELECT *, round(n * 1.0 / sum(n) OVER (PARTITION BY scope, model, horizon), 6) AS ratio FROM (
 SELECT coalesce(center_id, 'ALL') AS scope, source, model, horizon, {METRIC} FROM preds GROUP BY GROUPING SETS ((center_id, source, model, horizon), (source, model, horizon)))""")
def metrics_by_source(s):
    by = EV.scoped_metrics(preds(s), ["source", "model", "horizon"])
    totals = by.groupBy("scope", "model", "horizon").agg(F.sum("n").alias("_t"))
    return by.join(totals, ["scope", "model", "horizon"]).withColumn("ratio", r6(div(F.col("n"), F.col("_t")))).drop("_t")


@query("H05", "coldstart_metrics", f"""
SELECT coalesce(center_id, 'ALL') AS scope, source, model, horizon, {METRIC} FROM preds WHERE n_sold = 0 GROUP BY GROUPING SETS ((center_id, source, model, horizon), (source, model, horizon))""")
def coldstart_metrics(s):
    """Metrics of rows whose SKU had sold nothing by the origin."""
    return EV.scoped_metrics(preds(s).where("n_sold = 0"), ["source", "model", "horizon"])


@query("H06", "common_panel", "SELECT DISTINCT center_id, sku_id, week_st, horizon FROM panel")
def common_panel(s):
    return EV.panel_keys(preds(s), len(MODELS))


# rules that no row of the panel may break, as text for both sides
_ROW_RULES = {
    "missing_predictions": "y_pred IS NULL", "missing_actuals": "y_true IS NULL", "negative_actuals": "y_true < 0", "unknown_horizon": f"horizon NOT IN ({', '.join(map(str, HORIZONS))})",
    "wrong_target_date": "datediff({unit}target_date, week_st) <> 7 * horizon", "before_holdout": f"week_st < DATE '{HOLDOUT_START}'", "missing_source": "source IS NULL",
}


@query("H07", "panel_audit", """
WITH k AS (SELECT count(*) AS n, count(DISTINCT model) AS m, min(y_true) AS lo, max(y_true) AS hi FROM panel GROUP BY center_id, sku_id, week_st, horizon), v AS (
 SELECT 'models_per_key' AS "check", count(*) FILTER (WHERE m <> 5) AS violations FROM k UNION ALL
 SELECT 'duplicate_rows', count(*) FILTER (WHERE n <> m) FROM k UNION ALL SELECT 'equal_actuals', count(*) FILTER (WHERE lo <> hi) FROM k UNION ALL
 SELECT 'negative_predictions', count(*) FROM panel WHERE y_pred < 0 UNION ALL SELECT 'past_the_end', count(*) FROM panel WHERE target_date > (SELECT max(week_st) FROM tx) """
    + " ".join(f"UNION ALL SELECT '{k}', count(*) FROM panel WHERE {v.replace('datediff({unit}target_date, week_st)', 'target_date - week_st')}" for k, v in _ROW_RULES.items()) + """)
SELECT "check", violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM v""")
def panel_audit(s):
    p = panel(s)
    per = p.groupBy(*EV.ROW).agg(F.count("*").alias("n"), F.count_distinct("model").alias("m"), F.min("y_true").alias("lo"), F.max("y_true").alias("hi"))
    end = s.lines().agg(F.max("week_st")).scalar()
    by_key = {"models_per_key": F.expr(f"m <> {len(MODELS)}"), "duplicate_rows": F.expr("n <> m"), "equal_actuals": F.expr("lo <> hi")}
    by_row = {"negative_predictions": F.col("y_pred") < 0, "past_the_end": F.col("target_date") > end, **{k: F.expr(v.replace("{unit}", "")) for k, v in _ROW_RULES.items()}}

    def counted(df, rules):
        """All rules of one frame in one pass."""
        entries = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("violations")) for k in rules])
        return df.agg(*[F.count_if(rule).alias(k) for k, rule in rules.items()]).select(F.explode(entries).alias("x")).select("x.*")

    found = counted(per, by_key).unionByName(counted(p, by_row))
    return found.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


cte("cover", """
SELECT model, count(*) AS candidate FROM preds GROUP BY 1""")


@query("H08", "coverage", """
SELECT model, candidate, common, candidate - common AS excluded, round(common * 1.0 / candidate, 6) AS rate FROM cover JOIN (SELECT model, count(*) AS common FROM panel GROUP BY 1) USING (model)""")
def coverage(s):
    p = preds(s)
    inside = EV.panel_keys(p, len(MODELS)).withColumn("_in", F.lit(1))
    return (p.select(*EV.ROW, "model").join(inside, EV.ROW, "left").groupBy("model").agg(
        F.count("*").alias("candidate"), F.count("_in").alias("common"))
        .withColumns({"excluded": F.col("candidate") - F.col("common"), "rate": r6(div(F.col("common"), F.col("candidate")))}))


_FAMILY = ", ".join(f"count(*) FILTER (WHERE source = '{x}') AS {x}, round(count(*) FILTER (WHERE source = '{x}') * 1.0 / count(*), 6) AS {x}_rate" for x in ("model", "short", "no_history"))


def _family(s):
    return preds(s).groupBy(F.col("model").alias("family"), "horizon").agg(*[e for x in ("model", "short", "no_history") for e in (
        F.count_if(F.col("source") == x).alias(x), r6(div(F.count_if(F.col("source") == x), F.count("*"))).alias(f"{x}_rate"))])


@query("H09", "family_coverage", f"SELECT model AS family, horizon, {_FAMILY.replace('AS model,', 'AS model,')} FROM preds GROUP BY 1, 2")
def family_coverage(s):
    return _family(s)


@query("K23", "q_stat_coverage", f"SELECT * FROM (SELECT model AS family, horizon, {_FAMILY} FROM preds GROUP BY 1, 2) WHERE horizon = 1")
def q_stat_coverage(s):
    return _family(s).where("horizon = 1")


@query("H10", "rollup_grain_metrics", f"""
SELECT 'sku_week' AS grain, model, horizon, {METRIC} FROM preds GROUP BY 2, 3 UNION ALL SELECT 'center_week', model, horizon, {METRIC} FROM (
 SELECT model, horizon, center_id, week_st, sum(y_true) AS y_true, sum(y_pred) AS y_pred FROM preds GROUP BY 1, 2, 3, 4) GROUP BY 2, 3""")
def rollup_grain_metrics(s):
    p = preds(s)
    center = p.groupBy("model", "horizon", "center_id", "week_st").agg(F.sum("y_true").alias("y_true"), F.sum("y_pred").alias("y_pred"))
    part = lambda df, name: EV.metrics(df, ["model", "horizon"]).withColumn("grain", F.lit(name))
    return union_all([part(p, "sku_week"), part(center, "center_week")])


_NAIVE = """SELECT a.model, a.horizon, round(avg(abs(a.y_pred - a.y_true)) / greatest(avg(abs(b.y_pred - b.y_true)), 1e-5), 6) AS naive_mase, count(*) AS n
FROM preds a JOIN preds b ON b.model = 'last' AND a.center_id = b.center_id AND a.sku_id = b.sku_id AND a.week_st = b.week_st AND a.horizon = b.horizon GROUP BY 1, 2"""


@query("H11", "naive_mase", _NAIVE)
def naive_mase(s):
    per = preds(s).groupBy(*EV.ROW).agg(F.max(F.when(F.col("model") == "last", F.col("y_pred"))).alias("naive"), F.max("y_true").alias("y"),
                                        *[F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in MODELS])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in MODELS])).alias("e")
    long = per.where("naive is not null").select("horizon", "naive", "y", rows).where("e.p is not null")
    mae = lambda c: F.avg(F.abs(F.col(c) - F.col("y")))
    return long.groupBy("e.model", "horizon").agg(r6(mae("e.p") / F.greatest(mae("naive"), F.lit(1e-5))).alias("naive_mase"), F.count("*").alias("n"))


@query("H12", "mape_nonzero", """
SELECT model, horizon, round(avg(CASE WHEN y_true <> 0 THEN abs(y_pred - y_true) / y_true END) * 100, 6) AS mape, count(*) FILTER (WHERE y_true <> 0) AS used,
 count(*) FILTER (WHERE y_true = 0) AS zero_actuals FROM preds GROUP BY 1, 2""")
def mape_nonzero(s):
    ape = F.when(F.col("y_true") != 0, F.abs(F.col("y_pred") - F.col("y_true")) / F.col("y_true"))
    return preds(s).groupBy("model", "horizon").agg(r6(F.avg(ape) * 100).alias("mape"), F.count_if(F.col("y_true") != 0).alias("used"), F.count_if(F.col("y_true") == 0).alias("zero_actuals"))


# A sale probability: share of earlier weeks with a sale; the quantity is the mean level over selling weeks.
cte("hurdle", """
SELECT *, n_sold * 1.0 / n_obs AS sale_probability, y_pred * n_obs / greatest(n_sold, 1) AS conditional_qty FROM preds WHERE model = 'level'""")


def hurdle(s):
    p = preds(s).where("model = 'level'")
    return p.withColumns({"sale_probability": F.col("n_sold").cast("double") / F.col("n_obs"),
                          "conditional_qty": F.col("y_pred") * F.col("n_obs") / F.greatest(F.col("n_sold"), F.lit(1))})


# Every distinct score is a possible cut. Cuts are chosen on validation rows and applied to the holdout. Quantities are whole 8192nds.
_HURDLE = """SELECT center_id, horizon, y_true, CAST(n_sold AS DOUBLE) / n_obs AS score, floor(y_pred * n_obs / greatest(n_sold, 1) * 8192 + 0.5) / 8192 AS y_pred,
 CASE WHEN n_sold > 0 AND CAST(n_obs AS DOUBLE) / n_sold < 1.32 THEN 'smooth' ELSE 'intermittent' END AS adi_group FROM {} WHERE model = 'level'"""
_CUTOFF = "SELECT center_id, horizon, y_true, floor(y_pred * 8192 + 0.5) / 8192 AS score, floor(y_pred * 8192 + 0.5) / 8192 AS y_pred FROM {} WHERE model = 'category'"


def _cut_sql(rows, key, centers=(None,)):
    tag = lambda c: "" if c is None else f"_{c}"
    own = lambda v, c: f"coalesce(sum({v})" + ("" if c is None else f" FILTER (WHERE center_id = '{c}')") + ", 0)"
    sums = ", ".join(f"{own('abs(y_pred - y_true)', c)} AS k{tag(c)}, {own('y_pred - y_true', c)} AS b{tag(c)}, {own('abs(y_true)', c)} AS c{tag(c)}, {own('y_true', c)} AS y{tag(c)}" for c in centers)
    upto = lambda x: f"(sum({x}) OVER (PARTITION BY {key} ORDER BY score) - {x})"
    whole = lambda x: f"sum({x}) OVER (PARTITION BY {key})"
    wape = lambda t: f"({upto('c' + t)} + {whole('k' + t)} - {upto('k' + t)}) / nullif({whole('y' + t)}, 0) * 100"
    bias = lambda t: f"({whole('b' + t)} - {upto('b' + t)} - {upto('y' + t)}) / nullif({whole('y' + t)}, 0) * 100"
    mean = lambda f: f"list_avg(list_filter([{', '.join(f(tag(c)) for c in centers)}], lambda v: v IS NOT NULL))"
    return f"""WITH hold AS ({rows.format('preds')}), sums AS (SELECT {key}, score, {sums} FROM ({rows.format('dev_preds')}) GROUP BY 1, 2),
 tried AS (SELECT {key}, score AS cut, round({mean(wape)}, 6) AS wape, round({mean(bias)}, 6) AS bias FROM sums),
 best AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS cuts, row_number() OVER (PARTITION BY {key} ORDER BY wape, abs(bias), cut) AS r FROM tried) WHERE r = 1)
SELECT {key}, cut, wape AS val_wape, bias AS val_bias, cuts, round(sum(abs(CASE WHEN score >= cut THEN y_pred ELSE 0 END - y_true)) / nullif(sum(y_true), 0) * 100, 6) AS hold_wape,
 round(sum(CASE WHEN score >= cut THEN y_pred ELSE 0 END - y_true) / nullif(sum(y_true), 0) * 100, 6) AS hold_bias FROM hold JOIN best USING ({key}) GROUP BY 1, 2, 3, 4, 5"""


def _hurdle_scores(p):
    rows = p.where("model = 'level'")
    return rows.select("center_id", "horizon", "y_true", (F.col("n_sold").cast("double") / F.col("n_obs")).alias("score"),
                       F.expr("floor(y_pred * n_obs / greatest(n_sold, 1) * 8192 + 0.5) / 8192").alias("y_pred"),
                       F.when(div(F.col("n_obs").cast("double"), F.col("n_sold")) < 1.32, "smooth").otherwise("intermittent").alias("adi_group"))


def _chosen(found, hold, key):
    return EV.apply_cut(hold, EV.best_cut(found, [key]), [key], "score")


@query("H13", "threshold_sweep", _cut_sql(_HURDLE, "horizon"))
def threshold_sweep(s):
    """The best probability threshold of each horizon among all that make a difference."""
    return _chosen(EV.cut_errors(_hurdle_scores(validation(s)), ["horizon"], "score"), _hurdle_scores(preds(s)), "horizon")


@query("H14", "threshold_by_group", _cut_sql(_HURDLE, "adi_group", ("A", "B")))
def threshold_by_group(s):
    """One threshold for each row's own demand interval group, by the mean of both centres' error."""
    return _chosen(EV.cut_errors(_hurdle_scores(validation(s)), ["adi_group"], "score", ["A", "B"]), _hurdle_scores(preds(s)), "adi_group")


@query("H15", "cutoff_sweep", _cut_sql(_CUTOFF, "horizon"))
def cutoff_sweep(s):
    """The quantity below which a prediction counts as no demand."""
    rows = lambda p: p.where("model = 'category'").withColumn("y_pred", F.expr("floor(y_pred * 8192 + 0.5) / 8192")).withColumn("score", F.col("y_pred"))
    return _chosen(EV.cut_errors(rows(validation(s)), ["horizon"], "score"), rows(preds(s)), "horizon")


@query("H16", "hurdle_combine", f"""
SELECT {_K}, horizon, round(sale_probability * conditional_qty, 6) AS soft, round(CASE WHEN sale_probability >= CASE center_id WHEN 'A' THEN 0.1 ELSE 0.15 END
 THEN conditional_qty ELSE 0 END, 6) AS hard FROM hurdle""")
def hurdle_combine(s):
    return EV.hurdle_combine(hurdle(s), {"A": 0.1, "B": 0.15}).select(*KEY, "horizon", r6(F.col("soft")).alias("soft"), r6(F.col("hard")).alias("hard"))


@query("H17", "smearing", """
WITH f AS (SELECT model, horizon, center_id, avg(exp(ln(1 + y_true) - ln(1 + y_pred))) AS factor FROM oof WHERE seed = 1 AND target_date < DATE '1999-10-01' GROUP BY 1, 2, 3)
SELECT model, horizon, center_id, round(min(factor), 6) AS factor, round(sum(y_pred * factor), 2) AS smeared, count(*) AS n FROM oof JOIN f USING (model, horizon, center_id) WHERE seed = 1 AND target_date >= DATE '1999-10-01' GROUP BY 1, 2, 3""")
def smearing(s):
    """A centre's mean back-transform error over its folds before the last quarter, applied to that quarter."""
    one, by = oof(s).where("seed = 1"), ["model", "horizon", "center_id"]
    factor = one.where("target_date < date'1999-10-01'").groupBy(*by).agg(F.avg(F.exp(F.log1p("y_true") - F.log1p("y_pred"))).alias("factor"))
    return one.where("target_date >= date'1999-10-01'").join(F.broadcast(factor), by).groupBy(*by).agg(
        r6(F.min("factor")).alias("factor"), F.round(F.sum(F.col("y_pred") * F.col("factor")), 2).alias("smeared"), F.count("*").alias("n"))


cte("sku_avg", f"SELECT center_id, sku_id, avg(qty) AS avg_qty FROM gq WHERE week_st < DATE '{HOLDOUT_START}' AND (center_id <> 'B' OR week_st >= DATE '{REGIME_START}') GROUP BY 1, 2")
cte("edges", "SELECT center_id, list_sort(list_distinct(quantile_cont(avg_qty, [0, 0.25, 0.5, 0.75, 1]))) AS e FROM sku_avg GROUP BY 1")
cte("quart", """
SELECT center_id, sku_id, avg_qty, CAST(greatest(len([x for x in e if x < avg_qty]), 1) AS INT) AS quartile FROM sku_avg JOIN edges USING (center_id)""")


def sku_avg(s):
    """Mean weekly demand over the final training population: centre B counts from its regime start only."""
    known = history(s).where((F.col("center_id") != "B") | (F.col("week_st") >= F.lit(REGIME_START).cast("date")))
    return known.groupBy(*M.SKU).agg(F.avg(F.col("qty").cast("double")).alias("avg_qty"))


def quartiles(s):
    avg = sku_avg(s)
    return avg.join(EV.quartile_edges(avg, ["center_id"], "avg_qty"), "center_id").withColumn(
        "quartile", EV.cut_right(F.col("avg_qty"), F.col("edges"))).drop("edges")


@query("H18", "qcut_quartiles", "SELECT center_id, sku_id, round(avg_qty, 6) AS avg_qty, quartile FROM quart")
def qcut_quartiles(s):
    return quartiles(s).withColumn("avg_qty", r6(F.col("avg_qty")))


@query("H19", "fixed_cut", "SELECT center_id, sku_id, CAST(CASE WHEN avg_qty >= 0 AND avg_qty <= 1 THEN 1 WHEN avg_qty <= 5 THEN 2 WHEN avg_qty <= 50 THEN 3 WHEN avg_qty <= 1000 THEN 4 END AS INT) AS bin FROM sku_avg")
def fixed_cut(s):
    edges = F.array(*[F.lit(float(x)) for x in (0, 1, 5, 50, 1000)])
    return sku_avg(s).select(*M.SKU, EV.cut_right(F.col("avg_qty"), edges).alias("bin"))


@query("H20", "group_metrics", f"""
SELECT 'quartile' AS grouping, coalesce(CAST(quartile AS VARCHAR), 'no_history') AS value, {METRIC} FROM preds LEFT JOIN quart USING (center_id, sku_id) WHERE model = 'ma4' GROUP BY 2 UNION ALL
SELECT 'quarter', CAST(quarter(target_date) AS VARCHAR), {METRIC} FROM preds WHERE model = 'ma4' GROUP BY 2 UNION ALL
SELECT 'actual', CASE WHEN y_true = 0 THEN 'zero' ELSE 'nonzero' END, {METRIC} FROM preds WHERE model = 'ma4' GROUP BY 2""")
def group_metrics(s):
    p = preds(s).where("model = 'ma4'")
    part = lambda df, name, value: EV.metrics(df.withColumn("value", value), ["value"]).withColumn("grouping", F.lit(name))
    return union_all([part(p.join(quartiles(s), M.SKU, "left"), "quartile", F.coalesce(F.col("quartile").cast("string"), F.lit("no_history"))),
                      part(p, "quarter", F.quarter("target_date").cast("string")),
                      part(p, "actual", F.when(F.col("y_true") == 0, "zero").otherwise("nonzero"))])


_ZERO = """count(*) AS n, round(count(*) FILTER (WHERE y_true = 0) * 1.0 / count(*), 6) AS zero_rate, round(avg(y_pred) FILTER (WHERE y_true = 0), 6) AS mean_pred_zero,
 round(sum(abs(y_pred - y_true)) FILTER (WHERE y_true > 0) / nullif(sum(y_true) FILTER (WHERE y_true > 0), 0) * 100, 6) AS nonzero_wape,
 round(sum(y_pred - y_true) FILTER (WHERE y_true > 0) / nullif(sum(y_true) FILTER (WHERE y_true > 0), 0) * 100, 6) AS nonzero_bias"""
# How often a SKU sells: its share of selling weeks, in quarters per centre.
cte("sku_freq", f"SELECT center_id, sku_id, CAST(sum(sold) AS DOUBLE) / count(*) AS freq FROM gq WHERE week_st < DATE '{HOLDOUT_START}' AND (center_id <> 'B' OR week_st >= DATE '{REGIME_START}') GROUP BY 1, 2")
cte("freq_quart", """
WITH e AS (SELECT center_id, list_sort(list_distinct(quantile_cont(freq, [0, 0.25, 0.5, 0.75, 1]))) AS e FROM sku_freq GROUP BY 1)
SELECT center_id, sku_id, CASE WHEN len(e) > 1 THEN CAST(greatest(len([x for x in e if x < freq]), 1) AS INT) END AS quartile FROM sku_freq JOIN e USING (center_id)""")


@query("H21", "zero_demand", f"""
SELECT 'volume' AS grouping, quartile, model, {_ZERO} FROM preds JOIN quart USING (center_id, sku_id) GROUP BY 2, 3 UNION ALL
SELECT 'frequency', quartile, model, {_ZERO} FROM preds JOIN freq_quart USING (center_id, sku_id) GROUP BY 2, 3""")
def zero_demand(s):
    """Zero weeks by quarter of volume and by quarter of selling frequency; rows are joined to both quarters at once."""
    sold = lambda c: F.when(F.col("y_true") > 0, c)
    freq = development(s).groupBy(*M.SKU).agg((F.sum("sold").cast("double") / F.count(F.lit(1))).alias("freq"))
    by_freq = freq.join(EV.quartile_edges(freq, ["center_id"], "freq"), "center_id").select(*M.SKU, EV.cut_right(F.col("freq"), F.col("edges")).alias("_f"))
    both = quartiles(s).select(*M.SKU, F.col("quartile").alias("_v")).join(by_freq, M.SKU)
    each = F.array(F.struct(F.lit("volume").alias("grouping"), F.col("_v").alias("quartile")), F.struct(F.lit("frequency").alias("grouping"), F.col("_f").alias("quartile")))
    rows = preds(s).join(both, M.SKU).withColumn("g", F.explode(each)).select("model", "y_true", "y_pred", "g.*")
    return rows.groupBy("grouping", "quartile", "model").agg(
        F.count("*").alias("n"), r6(div(F.count_if(F.col("y_true") == 0), F.count("*"))).alias("zero_rate"),
        r6(F.avg(F.when(F.col("y_true") == 0, F.col("y_pred")))).alias("mean_pred_zero"),
        r6(div(F.sum(sold(F.abs(F.col("y_pred") - F.col("y_true")))), F.sum(sold(F.col("y_true")))) * 100).alias("nonzero_wape"),
        r6(div(F.sum(sold(F.col("y_pred") - F.col("y_true"))), F.sum(sold(F.col("y_true")))) * 100).alias("nonzero_bias"))


cte("suff", """
SELECT center_id, sku_id, horizon, model, count(*) AS n, sum(abs(y_pred - y_true)) AS abs_err, sum(y_pred - y_true) AS err, sum((y_pred - y_true) * (y_pred - y_true)) AS sq_err,
 CAST(sum(y_true) AS BIGINT) AS y_true, max(CASE WHEN source = 'no_history' THEN 1 ELSE 0 END) AS had_cold FROM preds GROUP BY 1, 2, 3, 4""")


def suff(s):
    e = F.col("y_pred") - F.col("y_true")
    return preds(s).groupBy(*M.SKU, "horizon", "model").agg(
        F.count("*").alias("n"), F.sum(F.abs(e)).alias("abs_err"), F.sum(e).alias("err"), F.sum(e * e).alias("sq_err"), F.sum("y_true").alias("y_true"),
        F.max(F.when(F.col("source") == "no_history", 1).otherwise(0)).alias("had_cold"))


@query("H22", "sufficient_stats", "SELECT center_id, sku_id, horizon, model, n, round(abs_err, 4) AS abs_err, round(err, 4) AS err, round(sq_err, 3) AS sq_err, y_true FROM suff")
def sufficient_stats(s):
    return suff(s).select(*M.SKU, "horizon", "model", "n", F.round("abs_err", 4).alias("abs_err"), F.round("err", 4).alias("err"), F.round("sq_err", 3).alias("sq_err"), "y_true")


@query("H23", "scope_classify", """
SELECT scope, history, count(*) AS n FROM (SELECT CASE WHEN series_class = 'constant' THEN 'constant' WHEN source = 'no_history' THEN 'fallback' ELSE 'model_fit' END AS scope,
 CASE WHEN n_obs < 52 THEN 'under_year' WHEN n_obs < 104 THEN 'under_two' ELSE 'longer' END AS history FROM preds JOIN sku_class USING (center_id, sku_id)) GROUP BY 1, 2""")
def scope_classify(s):
    classes = FC.series_class(stored_grid(s)).select(*M.SKU, "series_class")
    scope = F.when(F.col("series_class") == "constant", "constant").when(F.col("source") == "no_history", "fallback").otherwise("model_fit")
    length = F.when(F.col("n_obs") < 52, "under_year").when(F.col("n_obs") < 104, "under_two").otherwise("longer")
    return preds(s).join(classes, M.SKU).groupBy(scope.alias("scope"), length.alias("history")).agg(F.count("*").alias("n"))


_MEASURES = {"wape": "abs_err / nullif(y_true, 0)", "bias": "abs(err) / nullif(y_true, 0)", "mae": "abs_err / n", "rmse": "sqrt(sq_err / n)", "mase": "abs_err / n / nullif(mase_scale, 0)"}


@query("H24", "winner_share", "WITH w AS (SELECT center_id, sku_id, horizon, max(y_true) AS demand, " + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN {e} END) AS {m}_{k}" for m in ("ma4", "level") for k, e in _MEASURES.items())
    + " FROM suff LEFT JOIN mase USING (center_id, sku_id) GROUP BY 1, 2, 3), l AS (" + " UNION ALL ".join(
    f"SELECT horizon, '{k}' AS metric, demand, ma4_{k} AS x, level_{k} AS y FROM w" for k in _MEASURES) + """),
 c AS (SELECT horizon, metric, CASE WHEN x IS NULL OR y IS NULL THEN 'excluded' WHEN abs(x - y) <= 1e-9 * greatest(x, y) THEN 'tie' WHEN x < y THEN 'ma4' ELSE 'level' END AS winner, demand FROM l),
 g AS (SELECT horizon, metric, winner, count(*) AS skus, CAST(sum(demand) AS BIGINT) AS demand FROM c GROUP BY 1, 2, 3),
 t AS (SELECT horizon, metric, sum(skus) AS s, sum(demand) AS d FROM g WHERE winner <> 'excluded' GROUP BY 1, 2)
SELECT horizon, metric, winner, skus, demand, CASE WHEN winner <> 'excluded' THEN round(skus * 1.0 / s, 6) END AS sku_share,
 CASE WHEN winner <> 'excluded' THEN round(demand * 1.0 / nullif(d, 0), 6) END AS demand_share FROM g LEFT JOIN t USING (horizon, metric)""")
def winner_share(s):
    rows = suff(s).join(EV.mase_scale(history(s)), M.SKU, "left")
    cols = [F.max(F.when(F.col("model") == m, F.expr(e))).alias(f"{m}_{k}") for m in ("ma4", "level") for k, e in _MEASURES.items()]
    return EV.winner_share(rows.groupBy(*M.SKU, "horizon").agg(F.max("y_true").alias("demand"), *cols), "ma4", "level", list(_MEASURES), ["horizon"])


@query("H25", "oof_validate", """
WITH d AS (SELECT count(*) AS n FROM oof GROUP BY center_id, sku_id, week_st, horizon, model, seed HAVING count(*) > 1), v AS (
 SELECT 'duplicates' AS "check", CAST(coalesce((SELECT sum(n) FROM d), 0) AS BIGINT) AS violations UNION ALL SELECT 'not_finite', count(*) FILTER (WHERE y_pred IS NULL OR isnan(y_pred) OR y_true IS NULL) FROM oof UNION ALL
 SELECT 'negative', count(*) FILTER (WHERE y_pred < 0) FROM oof UNION ALL SELECT 'target_date', count(*) FILTER (WHERE target_date <> week_st + 7 * horizon) FROM oof)
SELECT "check", violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM v""")
def oof_validate(s):
    return EV.oof_validate(oof(s), [*EV.ROW, "model", "seed"])


@query("H26", "per_fold_metrics", f"SELECT model, horizon, fold, seed, {METRIC}, {MASE} FROM oof GROUP BY 1, 2, 3, 4")
def per_fold_metrics(s):
    return EV.metrics(oof(s), ["model", "horizon", "fold", "seed"], scale=True)


cte("picked", """
WITH ok AS (SELECT *, min(pooled_wape) OVER (PARTITION BY horizon) AS best FROM trial_rows WHERE abs(pooled_bias) <= 20),
 near AS (SELECT *, count(*) OVER (PARTITION BY horizon) AS near_ties FROM ok WHERE pooled_wape - best <= 1.0)
SELECT * EXCLUDE (best, r) FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY worst_fold_wape, pooled_wape, trial, model) AS r FROM near) WHERE r = 1""")


@query("H27", "select_trial", "SELECT model, horizon, trial, pooled_wape, pooled_bias, rmse, mae, worst_fold_wape, near_ties FROM (" + """
WITH ok AS (SELECT *, min(pooled_wape) OVER (PARTITION BY model, horizon) AS best FROM trial_rows WHERE abs(pooled_bias) <= 20),
 near AS (SELECT *, count(*) OVER (PARTITION BY model, horizon) AS near_ties FROM ok WHERE pooled_wape - best <= 1.0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, horizon ORDER BY worst_fold_wape, pooled_wape, trial) AS r FROM near) WHERE r = 1)""")
def select_trial(s):
    return EV.select_trial(trials(s), ["model", "horizon"])


cte("represent", """
WITH ok AS (SELECT *, min(pooled_wape) OVER (PARTITION BY model, horizon) AS best FROM trial_rows WHERE abs(pooled_bias) <= 20),
 sel AS (SELECT model, horizon, trial, 1 AS selected FROM (SELECT *, row_number() OVER (PARTITION BY model, horizon ORDER BY worst_fold_wape, pooled_wape, trial) AS r FROM ok WHERE pooled_wape - best <= 1.0) WHERE r = 1),
 m AS (SELECT t.*, coalesce(selected, 0) AS selected FROM trial_rows t LEFT JOIN sel USING (model, horizon, trial))
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY model, horizon ORDER BY selected DESC, pooled_wape, trial) AS r FROM m) WHERE r = 1""")


def represent(s):
    return EV.representative_trial(trials(s), ["model", "horizon"])


@query("H28", "representative_trial", "SELECT * FROM represent")
def representative_trial(s):
    return represent(s)


cte("seed_sum", f"""
WITH f AS (SELECT model, horizon, max(w) AS worst_fold_wape FROM (SELECT model, horizon, fold, avg(wape) AS w FROM (SELECT model, horizon, fold, seed, {WAPE} AS wape FROM oof GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 a AS (SELECT model, horizon, fold, count(DISTINCT (n, y, k)) = 1 AND count(*) = 3 AS same FROM (
  SELECT model, horizon, fold, seed, count(*) AS n, sum(y_true) AS y, bit_xor(hash(center_id, sku_id, week_st, y_true)) AS k FROM oof GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
 d AS (SELECT model, horizon, CAST(count(*) FILTER (WHERE NOT same) AS BIGINT) AS disagreeing_folds FROM a GROUP BY 1, 2)
SELECT model, horizon, avg(wape) AS mean_wape, avg(bias) AS mean_bias, stddev_samp(wape) AS seed_std, count(*) AS seeds, max(worst_fold_wape) AS worst_fold_wape, max(disagreeing_folds) AS disagreeing_folds
FROM (SELECT model, horizon, seed, {WAPE} AS wape, {BIAS} AS bias FROM oof GROUP BY 1, 2, 3) JOIN f USING (model, horizon) JOIN d USING (model, horizon) GROUP BY 1, 2""")


@query("H29", "worst_fold_3seed", "SELECT model, horizon, round(mean_wape, 5) AS mean_wape, round(mean_bias, 5) AS mean_bias, round(seed_std, 5) AS seed_std, seeds, round(worst_fold_wape, 5) AS worst_fold_wape, disagreeing_folds FROM seed_sum")
def worst_fold_3seed(s):
    """Folds whose seeds differ in keys or actuals are counted beside the means."""
    out = EV.seed_summary(oof(s), ["model", "horizon"], len(SEEDS))
    return out.withColumns({c: F.round(c, 5) for c in ("mean_wape", "mean_bias", "seed_std", "worst_fold_wape")})


_COST = {m: float(i) for i, m in enumerate(FAMILIES, 1)}


@query("H30", "select_family", f"""
WITH c AS (SELECT *, CASE model {' '.join(f"WHEN '{m}' THEN {v}" for m, v in _COST.items())} END AS cost, round(mean_wape, 5) AS w, round(worst_fold_wape, 5) AS f, round(seed_std, 5) AS sd FROM seed_sum),
 a AS (SELECT *, CASE WHEN abs(mean_bias) > 20 THEN 'bias_gate' END AS e FROM c), b AS (SELECT * REPLACE (CASE WHEN e IS NULL AND w - (SELECT min(w) FROM a z WHERE e IS NULL AND z.horizon = a.horizon) > 1 THEN 'wape_1pp' ELSE e END AS e) FROM a),
 d AS (SELECT * REPLACE (CASE WHEN e IS NULL AND f > (SELECT min(f) FROM b z WHERE e IS NULL AND z.horizon = b.horizon) THEN 'worst_fold' ELSE e END AS e) FROM b),
 g AS (SELECT * REPLACE (CASE WHEN e IS NULL AND sd > (SELECT min(sd) FROM d z WHERE e IS NULL AND z.horizon = d.horizon) THEN 'seed_stability' ELSE e END AS e) FROM d),
 h AS (SELECT * REPLACE (CASE WHEN e IS NULL AND cost > (SELECT min(cost) FROM g z WHERE e IS NULL AND z.horizon = g.horizon) THEN 'compute' ELSE e END AS e) FROM g)
SELECT model, horizon, e AS eliminated_at, CASE WHEN e IS NULL THEN 1 ELSE 0 END AS winner FROM h""")
def select_family(s):
    cost = F.element_at(F.create_map(*[F.lit(x) for kv in _COST.items() for x in kv]), F.col("model"))
    summary = EV.seed_summary(oof(s), ["model", "horizon"], len(SEEDS)).withColumns({c: F.round(c, 5) for c in ("mean_wape", "worst_fold_wape", "seed_std")})
    return EV.select_family(summary.withColumn("cost", cost), ["horizon"]).select("model", "horizon", "eliminated_at", "winner")


cte("raw_checked", f"""
WITH m AS (SELECT center_id, sku_id, max(qty) AS dev_max FROM gq WHERE week_st < DATE '{HOLDOUT_START}' AND (center_id <> 'B' OR week_st >= DATE '{REGIME_START}') GROUP BY 1, 2)
SELECT f.*, CAST(greatest(coalesce(dev_max, 0), 1) * 100 AS DOUBLE) AS lim, CASE WHEN isinf(y_raw) OR isnan(y_raw) THEN 'not_finite' WHEN abs(y_raw) > greatest(coalesce(dev_max, 0), 1) * 100 THEN 'above_limit' END AS reason
FROM (SELECT * FROM ar_plain UNION ALL SELECT * FROM ar_best) f LEFT JOIN m USING (center_id, sku_id)""")
cte("unstable", """
SELECT model, center_id, sku_id, count(*) AS n_total, count(*) FILTER (WHERE reason = 'not_finite') AS n_inf, count(*) FILTER (WHERE reason = 'above_limit') AS n_exceed, max(lim) AS "limit",
 round(count(reason) * 100.0 / count(*), 1) AS pct, CASE WHEN count(*) FILTER (WHERE reason = 'not_finite') > 0 THEN 'sku' WHEN count(reason) > 0 THEN 'row' ELSE 'none' END AS scope FROM raw_checked GROUP BY 1, 2, 3""")


def development(s):
    """The weeks that models may learn from: all of A, B from its regime start."""
    return history(s).where((F.col("center_id") != "B") | (F.col("week_st") >= F.lit(REGIME_START).cast("date")))


def raw_checked(s):
    """Per-series forecasts as they come, each with the reason that makes it unusable."""
    from stockloom.plans.models import ar_forecasts
    raw = ar_forecasts(s, False).unionByName(ar_forecasts(s, True)).withColumn("y_pred", F.col("y_raw"))
    return EV.instability(raw, development(s).groupBy(*M.SKU).agg(F.max("qty").alias("dev_max")))


@query("H31", "instability", "SELECT * FROM unstable")
def instability(s):
    return EV.instability_by_series(raw_checked(s))


@query("H31", "instability_override", f"""
WITH l AS (SELECT center_id, sku_id, avg(qty) AS mean_qty FROM gq WHERE week_st < DATE '{HOLDOUT_START}' AND (center_id <> 'B' OR week_st >= DATE '{REGIME_START}') GROUP BY 1, 2)
SELECT model, center_id, sku_id, week_st, horizon, scope, reason, round(coalesce(mean_qty, 0), 6) AS y_override FROM raw_checked JOIN (SELECT model, center_id, sku_id, scope FROM unstable) USING (model, center_id, sku_id)
LEFT JOIN l USING (center_id, sku_id) WHERE scope = 'sku' OR reason IS NOT NULL""")
def instability_override(s):
    level = development(s).groupBy(*M.SKU).agg(F.avg(F.col("qty").cast("double")).alias("level"))
    return EV.instability_override(raw_checked(s), level).withColumn("y_override", r6(F.col("y_override")))


@query("H32", "extreme_top_n", f"""
WITH w AS (SELECT {_K}, horizon, {', '.join(f"max(CASE WHEN model = '{m}' THEN y_pred END) AS {m}" for m in MODELS)} FROM preds GROUP BY 1, 2, 3, 4)
SELECT {_K}, horizon, {', '.join(f'round({m}, 6) AS {m}' for m in MODELS)} FROM w WHERE season IS NOT NULL ORDER BY season DESC, center_id, sku_id, week_st, horizon LIMIT 20""")
def extreme_top_n(s):
    wide_rows = preds(s).groupBy(*KEY, "horizon").pivot("model", MODELS).agg(F.max("y_pred")).where("season is not null")
    return wide_rows.orderBy(F.desc("season"), *KEY, "horizon").limit(20).select(*KEY, "horizon", *[r6(F.col(m)).alias(m) for m in MODELS])


@query("H33", "forecast_error_fact", """
SELECT p.center_id, p.sku_id, week_st, horizon, product_name, option_code, y_true, round(y_pred, 6) AS y_pred, round(y_pred - y_true, 6) AS error, round(abs(y_pred - y_true), 6) AS abs_error
FROM preds p LEFT JOIN pmaster USING (center_id, sku_id) WHERE model = 'ma4'""")
def forecast_error_fact(s):
    from stockloom.plans import marts as P
    e = F.col("y_pred") - F.col("y_true")
    return preds(s).where("model = 'ma4'").join(P.master(s).select(*M.SKU, "product_name", "option_code"), M.SKU, "left").select(
        *KEY, "horizon", "product_name", "option_code", "y_true", r6(F.col("y_pred")).alias("y_pred"), r6(e).alias("error"), r6(F.abs(e)).alias("abs_error"))


cte("mh", f"SELECT model, horizon, {METRIC} FROM preds GROUP BY 1, 2")


def mh(s):
    return EV.metrics(preds(s), ["model", "horizon"])


@query("H34", "metric_compare", """
SELECT horizon, a.wape AS stat_wape, b.wape AS ml_wape, round(b.wape - a.wape, 6) AS difference FROM (SELECT * FROM mh WHERE model = 'level') a JOIN (SELECT * FROM mh WHERE model = 'ma4') b USING (horizon)""")
def metric_compare(s):
    value = lambda m: F.max(F.when(F.col("model") == m, F.col("wape")))
    return mh(s).groupBy("horizon").agg(value("level").alias("stat_wape"), value("ma4").alias("ml_wape")).withColumn(
        "difference", r6(F.col("ml_wape") - F.col("stat_wape")))


EXTREME = 130.0
cte("flagged", f"SELECT model, max(CASE WHEN wape > {EXTREME} THEN 1 ELSE 0 END) AS is_extreme FROM mh GROUP BY 1")


def flagged(table):
    return table.groupBy("model").agg(F.max((F.col("wape") > EXTREME).cast("int")).alias("is_extreme"))


@query("H35", "metric_heatmap", """
WITH p AS (SELECT model, """ + ", ".join(f"max(CASE WHEN horizon = {h} THEN wape END) AS h{h}" for h in HORIZONS) + """ FROM mh GROUP BY 1),
 r AS (SELECT min(wape) AS lo, max(wape) AS hi FROM mh JOIN flagged USING (model) WHERE is_extreme = 0)
SELECT model, h1, h2, h4, is_extreme, lo AS color_min, hi AS color_max FROM p JOIN flagged USING (model), r""")
def metric_heatmap(s):
    table = mh(s)
    marked = table.join(flagged(table), "model")
    span = marked.where("is_extreme = 0").agg(F.struct(F.min("wape").alias("lo"), F.max("wape").alias("hi"))).scalar()
    cells = marked.groupBy("model", "is_extreme").agg(*[F.max(F.when(F.col("horizon") == h, F.col("wape"))).alias(f"h{h}") for h in HORIZONS])
    return cells.withColumn("_s", span).withColumns({"color_min": F.col("_s.lo"), "color_max": F.col("_s.hi")}).drop("_s")


@query("H36", "wape_bias_points", "SELECT model, horizon, wape, bias FROM mh JOIN flagged USING (model) WHERE is_extreme = 0")
def wape_bias_points(s):
    table = mh(s)
    return table.join(flagged(table), "model").where("is_extreme = 0").select("model", "horizon", "wape", "bias")


@query("H37", "model_summary", "SELECT model, horizon, trial, pooled_wape, pooled_bias, CASE WHEN abs(pooled_bias) <= 20 THEN 1 ELSE 0 END AS within_guardrail, selected FROM represent")
def model_summary(s):
    return represent(s).select("model", "horizon", "trial", "pooled_wape", "pooled_bias", (F.abs("pooled_bias") <= EV.BIAS_LIMIT).cast("int").alias("within_guardrail"), "selected")


@query("H38", "variable_effect", "SELECT a.model, a.horizon, round(a.wape - b.wape, 6) AS wape_effect, round(a.mae - b.mae, 6) AS mae_effect FROM mh a JOIN mh b ON b.model = 'last' AND b.horizon = a.horizon WHERE a.model <> 'last'")
def variable_effect(s):
    table = mh(s)
    base = table.where("model = 'last'").select("horizon", F.col("wape").alias("_w"), F.col("mae").alias("_m"))
    return table.where("model <> 'last'").join(base, "horizon").select(
        "model", "horizon", r6(F.col("wape") - F.col("_w")).alias("wape_effect"), r6(F.col("mae") - F.col("_m")).alias("mae_effect"))


@query("H39", "fold_mean_std", f"""
SELECT model, horizon, center_id, round(avg(wape), 5) AS mean_wape, round(stddev_samp(wape), 5) AS std_wape, round(avg(CASE WHEN fold IN (1, 101) THEN wape END), 5) AS first_fold,
 round(avg(CASE WHEN fold NOT IN (1, 101) THEN wape END), 5) AS other_folds FROM (SELECT model, horizon, center_id, fold, {WAPE} AS wape FROM oof WHERE seed = 1 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def fold_mean_std(s):
    by = EV.metrics(oof(s).where("seed = 1"), ["model", "horizon", "center_id", "fold"])
    first = F.col("fold").isin(1, 101)
    return by.groupBy("model", "horizon", "center_id").agg(F.round(F.avg("wape"), 5).alias("mean_wape"), F.round(F.stddev_samp("wape"), 5).alias("std_wape"),
                                                           F.round(F.avg(F.when(first, F.col("wape"))), 5).alias("first_fold"),
                                                           F.round(F.avg(F.when(~first, F.col("wape"))), 5).alias("other_folds"))


@query("H40", "canonical_extreme", f"""
WITH m AS (SELECT * FROM (VALUES ('last', 'naive'), ('ma4', 'naive'), ('level', 'mean'), ('category', 'mean'), ('season', 'seasonal')) v(model, canonical))
SELECT canonical, min(wape) AS wape, first(model ORDER BY wape, model) AS model, bool_or(wape > {EXTREME})::INT AS is_extreme FROM mh JOIN m USING (model) WHERE horizon = 1 GROUP BY 1""")
def canonical_extreme(s):
    names = s.rows([("last", "naive"), ("ma4", "naive"), ("level", "mean"), ("category", "mean"), ("season", "seasonal")], "model string, canonical string")
    return mh(s).where("horizon = 1").join(names, "model").groupBy("canonical").agg(
        F.min(F.struct("wape", "model")).alias("b"), F.bool_or(F.col("wape") > EXTREME).cast("int").alias("is_extreme")).select("canonical", "b.wape", "b.model", "is_extreme")


@query("K24", "q_experiments", "SELECT 'trial' AS variant, model, horizon, pooled_wape AS wape FROM represent UNION ALL SELECT 'holdout', model, horizon, wape FROM mh WHERE horizon = 1")
def q_experiments(s):
    tried = represent(s).select(F.lit("trial").alias("variant"), "model", "horizon", F.col("pooled_wape").alias("wape"))
    return tried.unionByName(mh(s).where("horizon = 1").select(F.lit("holdout").alias("variant"), "model", "horizon", "wape"))


@query("C07", "melt_audit", " UNION ALL ".join(f"SELECT model, horizon, '{m}' AS metric, {m} AS value FROM mh" for m in ("wape", "bias", "rmse", "mae")))
def melt_audit(s):
    return mh(s).unpivot(["model", "horizon"], ["wape", "bias", "rmse", "mae"], "metric", "value")
