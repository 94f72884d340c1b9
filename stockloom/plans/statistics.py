"""Series statistics, audits and answer scoring on the test tables."""

from pyspark.sql import functions as F

from stockloom.functions.columns import div, r6
from stockloom.operators import evaluation as EV
from stockloom.operators import folds as FO
from stockloom.operators import forecasting as FC
from stockloom.operators import marts as M
from stockloom.operators import reshape as R
from stockloom.operators import series as S
from stockloom.operators import statistics as ST
from stockloom.operators.profiling import union_all, unpivot_counts
from stockloom.operators.ranking import quantiles
from stockloom.plans import marts as P
from stockloom.plans.folds import FOLDS, _fold_sql
from stockloom.plans.forecasts import MODELS, preds, stored_grid
from stockloom.plans.series import FILL, KEY, _K, _W, features, grid
from stockloom.registry import cte, query
from stockloom.sources.adapters import BASIS_WEEK, HOLDOUT_START, HORIZONS


# -- reshape ---------------------------------------------------------------
def _monthly_wide(s):
    """Monthly sheets as they are delivered: one row per region and year, one column per month."""
    both = s.retail().select("sido", "y", "m", F.col("retail_current").alias("v")).unionByName(
        s.cpi().select(F.lit("national").alias("sido"), "y", "m", F.col("cpi").alias("v")))
    return both.withColumn("m", F.concat(F.lit("m"), F.lpad(F.col("m").cast("string"), 2, "0"))).groupBy("sido", "y").pivot(
        "m", [f"m{i:02d}" for i in range(1, 13)]).agg(F.max("v"))


@query("C01", "melt_months", """
SELECT sido, y, m, round(retail_current, 6) AS value, 'regional' AS scope FROM retail UNION ALL SELECT 'national', y, m, round(cpi, 6), 'national' FROM cpi""")
def melt_months(s):
    long = R.melt_months(_monthly_wide(s), ["sido", "y"], [f"m{i:02d}" for i in range(1, 13)], "value")
    return long.withColumns({"value": r6(F.col("value")), "scope": F.when(F.col("sido") == "national", "national").otherwise("regional")})


@query("C02", "unstack_two_level", """
SELECT sido, y, m, 'current' AS kind, round(retail_current, 6) AS value FROM retail UNION ALL SELECT sido, y, m, 'constant', CAST(retail_constant AS DOUBLE) FROM retail""")
def unstack_two_level(s):
    named = s.retail().select("sido", "y", F.explode(F.array(
        F.struct(F.format_string("m%02d_current", "m").alias("c"), F.col("retail_current").alias("v")),
        F.struct(F.format_string("m%02d_constant", "m").alias("c"), F.col("retail_constant").cast("double").alias("v")))).alias("e"))
    cols = [f"m{i:02d}_{k}" for i in range(1, 13) for k in ("current", "constant")]
    sheet = named.groupBy("sido", "y").pivot("e.c", cols).agg(F.max("e.v"))
    return R.unstack_two_level(sheet, ["sido", "y"], "value").withColumn("value", r6(F.col("value")))


# The regions each survey group stands for; a NULL city is the whole province.
GROUP_REGIONS = [("AFRICA", "AFRICA", None), ("AMERICA", "AMERICA", None), ("ASIA", "ASIA", "NATION_2"), ("ASIA", "ASIA", "NATION_7"),
                 ("EUROPE", "EUROPE", None), ("AMERICA", "AFRICA", None)]


@query("C03", "broadcast_groups", """
WITH m AS (SELECT * FROM (VALUES ('AFRICA', 'AFRICA', NULL), ('AMERICA', 'AMERICA', NULL), ('ASIA', 'ASIA', 'NATION_2'), ('ASIA', 'ASIA', 'NATION_7'),
 ('EUROPE', 'EUROPE', NULL), ('AMERICA', 'AFRICA', NULL)) v(grp, sido, sigungu))
SELECT coalesce(m.sido, r.sido) AS sido, m.sigungu, y, mo AS m, round(avg(v), 5) AS sentiment FROM (SELECT sido, y, m AS mo, retail_current AS v FROM retail) r LEFT JOIN m ON m.grp = r.sido GROUP BY 1, 2, 3, 4""")
def broadcast_groups(s):
    survey = s.retail().select(F.col("sido").alias("grp"), "y", "m", F.col("retail_current").alias("sentiment"))
    mapping = s.rows(GROUP_REGIONS, "grp string, sido string, sigungu string")
    return R.broadcast_groups(survey, "grp", mapping, ["y", "m"], "sentiment").withColumn("sentiment", F.round("sentiment", 5))


@query("C04", "station_fanout", """
SELECT coalesce(mp.region, w.sigungu) AS region, w.sigungu AS station, date, rain FROM weather w LEFT JOIN (
 SELECT n_name AS station, unnest([concat(n_name, ' North'), concat(n_name, ' South')]) AS region FROM nation WHERE n_nationkey % 5 <> 3) mp ON mp.station = w.sigungu WHERE w.sigungu IS NOT NULL""")
def station_fanout(s):
    mapping = s.table("nation").where("n_nationkey % 5 <> 3").select(
        F.col("n_name").alias("station"), F.explode(F.array(F.concat("n_name", F.lit(" North")), F.concat("n_name", F.lit(" South")))).alias("region"))
    rows = s.weather().where("sigungu is not null").select(F.col("sigungu").alias("station"), "date", "rain")
    return R.station_fanout(rows, mapping, "station", "region")


# -- classification answers -------------------------------------------------
ANSWER_MODELS = (1, 2, 3)
cte("answers", """
SELECT doc_id AS item, CASE WHEN doc_id % 4 = 0 THEN 'missing' ELSE 'complete' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS center_id, round_no, model, quality AS t1, toxic AS t2, lang AS t3,
 CASE WHEN (doc_id + round_no) % (5 + model) = 0 THEN 1 - quality ELSE quality END AS p1, toxic AS p2,
 CASE WHEN (doc_id + round_no) % (11 * model) = 0 THEN 'ERROR' WHEN (doc_id * round_no) % (7 + model) = 0 THEN '' WHEN doc_id % (9 + model) = 0 THEN 'zz' ELSE lang END AS p3
FROM labels JOIN documents USING (doc_id), (SELECT CAST(unnest([1, 2, 3]) AS INT) AS round_no), (SELECT CAST(unnest([1, 2, 3]) AS INT) AS model)""")


def answers(s):
    base = s.table("labels").join(s.table("documents").select("doc_id", "lang"), "doc_id")
    each = base.withColumn("round_no", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)]))).withColumn("model", F.explode(F.array(*[F.lit(i) for i in ANSWER_MODELS])))
    return each.selectExpr(
        "doc_id as item", "case when doc_id % 4 = 0 then 'missing' else 'complete' end as kind", "case when doc_id % 2 = 0 then 'A' else 'B' end as center_id",
        "round_no", "model", "quality as t1", "toxic as t2", "lang as t3", "case when (doc_id + round_no) % (5 + model) = 0 then 1 - quality else quality end as p1", "toxic as p2",
        "case when (doc_id + round_no) % (11 * model) = 0 then 'ERROR' when (doc_id * round_no) % (7 + model) = 0 then '' when doc_id % (9 + model) = 0 then 'zz' else lang end as p3")


_RIGHT = "t1 = p1 AND t2 = p2 AND t3 = p3"
_ACC = f"""count(*) AS n, count(*) FILTER (WHERE {_RIGHT}) AS correct, round(count(*) FILTER (WHERE {_RIGHT}) * 100.0 / count(*), 6) AS accuracy,
 round(count(*) FILTER (WHERE {_RIGHT} AND kind = 'missing') * 100.0 / nullif(count(*) FILTER (WHERE kind = 'missing'), 0), 6) AS accuracy_missing,
 round(count(*) FILTER (WHERE {_RIGHT} AND kind = 'complete') * 100.0 / nullif(count(*) FILTER (WHERE kind = 'complete'), 0), 6) AS accuracy_complete"""


def accuracy(df, keys):
    right = F.expr("t1 = p1 and t2 = p2 and t3 = p3")
    rate = lambda rule: r6(div(F.count_if(right & rule), F.count_if(rule)) * 100)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), rate(F.lit(True)).alias("accuracy"),
                                 rate(F.col("kind") == "missing").alias("accuracy_missing"), rate(F.col("kind") == "complete").alias("accuracy_complete"))


@query("E42", "classification_accuracy", f"SELECT model, round_no, {_ACC} FROM answers GROUP BY 1, 2")
def classification_accuracy(s):
    return accuracy(answers(s), ["model", "round_no"])


@query("E43", "accuracy_summary", f"SELECT model, {_ACC} FROM answers GROUP BY 1")
def accuracy_summary(s):
    return accuracy(answers(s), ["model"])


@query("E44", "consistency", """
WITH i AS (SELECT model, kind, item, CASE WHEN count(DISTINCT (p1, p2, p3)) = 1 THEN 1 ELSE 0 END AS same FROM answers GROUP BY 1, 2, 3)
SELECT model, kind, count(*) AS items, CAST(sum(same) AS BIGINT) AS consistent, round(sum(same) * 100.0 / count(*), 6) AS pct FROM i GROUP BY 1, 2""")
def consistency(s):
    item = answers(s).groupBy("model", "kind", "item").agg((F.count_distinct(F.struct("p1", "p2", "p3")) == 1).cast("int").alias("same"))
    return item.groupBy("model", "kind").agg(F.count("*").alias("items"), F.sum("same").alias("consistent"), r6(div(F.sum("same"), F.count("*")) * 100).alias("pct"))


@query("E45", "stratified_sample", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'missing' ELSE 'complete' END AS kind, md5(concat(CAST(doc_id AS VARCHAR), '-42')) AS h FROM labels)
SELECT doc_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h, doc_id) AS r FROM d) WHERE r <= CASE kind WHEN 'missing' THEN 20 ELSE 30 END""")
def stratified_sample(s):
    rows = s.table("labels").selectExpr("doc_id", "case when doc_id % 4 = 0 then 'missing' else 'complete' end as kind")
    order = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-42")).cast("binary"))
    return union_all([rows.where(F.col("kind") == k).orderBy(order, "doc_id").limit(n) for k, n in (("complete", 30), ("missing", 20))])


@query("E46", "cell_compare", " UNION ALL ".join(
    f"""SELECT model, '{c}' AS level, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE NOT ok AND p NOT IN ('ERROR', '')) AS wrong, count(*) FILTER (WHERE p = 'ERROR') AS error, count(*) FILTER (WHERE p = '') AS blank
FROM (SELECT model, CAST(p{c} AS VARCHAR) AS p, CAST(t{c} AS VARCHAR) = CAST(p{c} AS VARCHAR) AS ok FROM answers) GROUP BY 1""" for c in (1, 2, 3)))
def cell_compare(s):
    cells = F.explode(F.array(*[F.struct(F.lit(str(i)).alias("level"), F.col(f"t{i}").cast("string").alias("t"), F.col(f"p{i}").cast("string").alias("p")) for i in (1, 2, 3)])).alias("e")
    ok, p = F.col("e.t") == F.col("e.p"), F.col("e.p")
    return answers(s).select("model", cells).groupBy("model", "e.level").agg(
        F.count_if(ok).alias("correct"), F.count_if(~ok & ~p.isin("ERROR", "")).alias("wrong"), F.count_if(p == "ERROR").alias("error"), F.count_if(p == "").alias("blank"))


@query("C05", "pivot_accuracy", "SELECT center_id, round_no, " + ", ".join(
    f"round(count(*) FILTER (WHERE {_RIGHT} AND model = {m}) * 100.0 / count(*) FILTER (WHERE model = {m}), 6) AS model_{m}" for m in ANSWER_MODELS) + " FROM answers GROUP BY 1, 2")
def pivot_accuracy(s):
    out = R.pivot_sum(answers(s), ["center_id", "round_no"], "model", list(ANSWER_MODELS),
                      r6(div(F.count_if(F.expr("t1 = p1 and t2 = p2 and t3 = p3")), F.count(F.lit(1))) * 100))
    return out.withColumnsRenamed({str(m): f"model_{m}" for m in ANSWER_MODELS})


# -- series audits -----------------------------------------------------------
cte("sku_hist", """
SELECT center_id, sku_id, min(week_st) AS first_week, max(week_st) AS last_week, count(*) AS weeks, CAST(sum(sold) AS BIGINT) AS active_weeks, CAST(sum(qty) AS BIGINT) AS total_qty,
 count(DISTINCT qty) AS unique_values, round((count(*) - sum(sold)) * 1.0 / count(*), 6) AS zero_ratio, CASE WHEN sum(sold) = 0 THEN 1 ELSE 0 END AS all_zero,
 CASE WHEN min(qty) = max(qty) THEN 1 ELSE 0 END AS constant, CASE WHEN (max(week_st) - min(week_st)) / 7 + 1 <> count(*) THEN 1 ELSE 0 END AS has_gap FROM gq GROUP BY 1, 2""")


@query("E33", "sku_history_summary", "SELECT * FROM sku_hist")
def sku_history_summary(s):
    return ST.history_summary(grid(s))


@query("E34", "center_week_summary", """
WITH w AS (SELECT center_id, week_st, CAST(sum(sales_qty) AS DOUBLE) AS v FROM wk_sales GROUP BY 1, 2)
SELECT center_id, CAST((max(week_st) - min(week_st)) / 7 + 1 AS INT) AS expected_weeks, count(*) AS weeks, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std,
 min(v) AS min, max(v) AS max, round(count(*) FILTER (WHERE v = 0) * 1.0 / count(*), 6) AS zero_ratio, CAST((max(week_st) - min(week_st)) / 7 + 1 AS BIGINT) - count(*) AS missing_weeks FROM w GROUP BY 1""")
def center_week_summary(s):
    return ST.center_week_summary(P.sales_facts(s), "sales_qty")


_LV = ["sku_id", "cat_s", "cat_m", "cat_l"]


@query("E35", "level_zero_ratio", """
WITH w AS (""" + " UNION ALL ".join(f"SELECT center_id, '{x}' AS level, {x} AS key, week_st, sum(qty) AS q FROM gq GROUP BY 1, 3, 4" for x in _LV) + """),
 o AS (SELECT center_id, level, key, (max(week_st) - min(week_st)) // 7 + 1 AS length, count(*) AS active, sum(q) AS s FROM w WHERE q <> 0 GROUP BY 1, 2, 3),
 r AS (SELECT *, CAST(length - active AS DOUBLE) / length AS z, CAST(s AS DOUBLE) / length AS d FROM o)
SELECT center_id, level, count(*) AS series, round(avg(z), 6) AS zero_ratio, round(median(z), 6) AS median_zero_ratio, round(count(*) FILTER (WHERE z <= 0.1) * 100.0 / count(*), 6) AS low_zero_pct,
 round(avg(d), 6) AS mean_demand, round(count(*) FILTER (WHERE length < 52) * 100.0 / count(*), 6) AS short_pct FROM r GROUP BY 1, 2""")
def level_zero_ratio(s):
    return ST.level_zero_ratio(grid(s), _LV, 52)


@query("E36", "interval_distribution", """
WITH g AS (SELECT *, count(*) OVER (PARTITION BY center_id, sku_id) AS k, (week_st - lag(week_st) OVER (PARTITION BY center_id, sku_id ORDER BY week_st)) // 7 AS gap FROM wk_sales WHERE sales_qty > 0),
 c AS (SELECT center_id, CAST(least(gap, 12) AS INT) AS weeks_between, count(*) AS n, count(DISTINCT sku_id) AS skus FROM g WHERE k >= 5 AND gap IS NOT NULL GROUP BY 1, 2)
SELECT *, round(n * 1.0 / sum(n) OVER (PARTITION BY center_id), 6) AS share FROM c""")
def interval_distribution(s):
    return ST.interval_distribution(P.sales_facts(s))


cte("sku_order", """SELECT center_id, sku_id, series_class, CASE WHEN series_class <> 'eligible' THEN 0 WHEN zero_ratio < 0.85 THEN 2 ELSE 1 END AS ar_order FROM sku_class JOIN sku_hist USING (center_id, sku_id)""")


def sku_order(s):
    rule = F.when(F.col("series_class") != "eligible", 0).when(F.col("zero_ratio") < 0.85, 2).otherwise(1)
    hist = ST.history_summary(grid(s)).withColumn("series_class", F.when(F.col("weeks") < FC.SHORT_HISTORY, "short").when(F.col("constant") == 1, "constant").otherwise("eligible"))
    return hist.select(*M.SKU, "series_class", rule.alias("ar_order"))


@query("E37", "order_distribution", "SELECT center_id, ar_order, count(*) AS n FROM sku_order GROUP BY 1, 2")
def order_distribution(s):
    return sku_order(s).groupBy("center_id", "ar_order").agg(F.count("*").alias("n"))


@query("E38", "status_summary", """
SELECT coalesce(center_id, 'ALL') AS scope, count(*) AS n, count(*) FILTER (WHERE series_class = 'short') AS short, count(*) FILTER (WHERE series_class = 'constant') AS constant,
 count(*) FILTER (WHERE series_class = 'eligible') AS eligible FROM sku_order GROUP BY CUBE (center_id)""")
def status_summary(s):
    return sku_order(s).cube("center_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("series_class") == c).alias(c) for c in ("short", "constant", "eligible")]).select(
        F.coalesce("center_id", F.lit("ALL")).alias("scope"), "n", "short", "constant", "eligible")


@query("E39", "short_history_audit", """
WITH l AS (SELECT count(*) AS weeks FROM wk_sales GROUP BY center_id, sku_id)
SELECT CAST(k AS BIGINT) AS weeks, (SELECT count(*) FROM l WHERE l.weeks = k) AS skus, round((SELECT count(*) FROM l WHERE l.weeks = k) * 1.0 / (SELECT count(*) FROM l), 6) AS rate FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS k)""")
def short_history_audit(s):
    return ST.short_history(P.sales_facts(s), 8)


@query("E40", "volume_percentile_top20", """
WITH a AS (SELECT center_id, sku_id, CAST(sum(CASE WHEN kind = 'sales' AND qty > 0 THEN qty ELSE 0 END) AS BIGINT) AS sales_qty, CAST(sum(abs(qty)) AS BIGINT) AS volume FROM tx GROUP BY 1, 2),
 r AS (SELECT *, (rank() OVER (PARTITION BY center_id ORDER BY sales_qty) + (count(*) OVER (PARTITION BY center_id, sales_qty) - 1) / 2.0) / count(*) OVER (PARTITION BY center_id) AS p FROM a)
SELECT center_id, sku_id, sales_qty, volume, round(p, 6) AS pct_rank FROM r ORDER BY volume DESC, center_id, sku_id LIMIT 20""")
def volume_percentile_top20(s):
    sums = s.tx().groupBy(*M.SKU).agg(F.sum(F.when((F.col("kind") == "sales") & (F.col("qty") > 0), F.col("qty")).otherwise(0)).alias("sales_qty"), F.sum(F.abs("qty")).alias("volume"))
    return ST.volume_rank(sums.select(*M.SKU, "sales_qty"), sums.select(*M.SKU, "volume"), 20).withColumn("pct_rank", r6(F.col("pct_rank")))


@query("E41", "prediction_percentiles", """
SELECT model, count(*) AS n, round(max(y_pred), 6) AS max_pred, round(quantile_cont(y_pred, 0.5), 6) AS median, round(quantile_cont(y_pred, 0.99), 6) AS p99, round(quantile_cont(y_pred, 0.999), 6) AS p999,
 round(quantile_cont(y_pred, 0.9999), 6) AS p9999 FROM preds GROUP BY 1""")
def prediction_percentiles(s):
    p = preds(s).select("model", "y_pred")
    q = quantiles(p, ["model"], "y_pred", {"median": 0.5, "p99": 0.99, "p999": 0.999, "p9999": 0.9999})
    return p.groupBy("model").agg(F.count("*").alias("n"), r6(F.max("y_pred")).alias("max_pred")).join(q, "model").select(
        "model", "n", "max_pred", *[r6(F.col(c)).alias(c) for c in ("median", "p99", "p999", "p9999")])


@query("E49", "missing_reason", """
SELECT center_id, CASE WHEN target IS NULL THEN 'no_target' WHEN run < 4 THEN 'short_run' ELSE 'kept' END AS reason, count(*) AS n FROM (
 SELECT *, lead(sales_qty) OVER (PARTITION BY center_id, sku_id ORDER BY week_st) AS target, row_number() OVER (PARTITION BY center_id, sku_id, island ORDER BY week_st) AS run FROM (
  SELECT *, sum(CASE WHEN pw IS NULL OR week_st - pw <> 7 THEN 1 ELSE 0 END) OVER (PARTITION BY center_id, sku_id ORDER BY week_st) AS island FROM (
   SELECT *, lag(week_st) OVER (PARTITION BY center_id, sku_id ORDER BY week_st) AS pw FROM wk_sales))) GROUP BY 1, 2""")
def missing_reason(s):
    rows = S.run_length(P.sales_facts(s)).withColumn("target", F.lead("sales_qty").over(S.series()))
    why = F.when(F.col("target").isNull(), "no_target").when(F.col("run") < 4, "short_run").otherwise("kept")
    return rows.groupBy("center_id", why.alias("reason")).agg(F.count("*").alias("n"))


_NANF = ["lag4", "roll_mean_4", "adi", "cv2"]


@query("E50", "nan_audit", " UNION ALL ".join(
    f"SELECT fold, role, '{c}' AS feature, count(*) AS rows, count(*) - count({c}) AS nulls FROM ({_fold_sql(FOLDS, 'feat')}) GROUP BY 1, 2" for c in _NANF))
def nan_audit(s):
    rows = features(s).where("center_id = 'A'").withColumn("target_date", FO.target_date(1))
    folded = FO.assign_folds(rows, FOLDS, "target_date")
    return unpivot_counts(folded, ["fold", "role"], {c: {"rows": F.count("*"), "nulls": F.count_if(F.col(c).isNull())} for c in _NANF}, "feature")


@query("E51", "peer_count_distribution", """
WITH p AS (""" + " UNION ALL ".join(f"SELECT '{x}' AS level, {x} AS key, center_id, week_st, count(cv2) AS peers, count(*) - count(cv2) AS nulls FROM feat GROUP BY 2, 3, 4" for x in _LV[1:]) + """),
 r AS (SELECT level, peers FROM p, generate_series(1, nulls))
SELECT level, count(*) AS null_rows, CAST(min(peers) AS DOUBLE) AS min_peers, round(quantile_cont(peers, 0.25), 6) AS q1, round(quantile_cont(peers, 0.5), 6) AS median, round(quantile_cont(peers, 0.75), 6) AS q3,
 CAST(max(peers) AS DOUBLE) AS max_peers, round(count(*) FILTER (WHERE peers >= 3) * 1.0 / count(*), 6) AS usable FROM r GROUP BY 1""")
def peer_count_distribution(s):
    base = features(s).groupBy("center_id", "week_st", *_LV[1:]).agg(F.count("cv2").alias("k"), F.count_if(F.col("cv2").isNull()).alias("u"))
    tags = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("key")) for x in _LV[1:]])).alias("t")
    peers = base.select("center_id", "week_st", "k", "u", tags).groupBy("t.level", "t.key", "center_id", "week_st").agg(F.sum("k").alias("peers"), F.sum("u").alias("nulls")).where("nulls > 0")
    counts = peers.groupBy("level", "peers").agg(F.sum("nulls").alias("nulls"))
    q = quantiles(counts, ["level"], "peers", {"min_peers": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max_peers": 1.0}, weight="nulls")
    use = counts.groupBy("level").agg(F.sum("nulls").alias("null_rows"), r6(div(F.sum(F.when(F.col("peers") >= 3, F.col("nulls")).otherwise(0)), F.sum("nulls"))).alias("usable"))
    return use.join(q, "level").select("level", "null_rows", "min_peers", *[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3")], "max_peers", "usable")


@query("E52", "explained_nulls", """
SELECT center_id, CASE WHEN cv2 IS NOT NULL THEN 'known' WHEN coldstart = 1 THEN 'cold_start' WHEN is_warmup = 1 THEN 'warm_up' WHEN week_st = (SELECT max(week_st) FROM gq) THEN 'end_of_data' ELSE 'unexplained' END AS reason, count(*) AS n FROM feat GROUP BY 1, 2""")
def explained_nulls(s):
    why = (F.when(F.col("cv2").isNotNull(), "known").when(F.col("coldstart") == 1, "cold_start").when(F.col("is_warmup") == 1, "warm_up")
           .when(F.col("week_st") == P.last_week(s), "end_of_data").otherwise("unexplained"))
    return features(s).withColumn("reason", why).groupBy("center_id", "reason").agg(F.count("*").alias("n"))


@query("E54", "recompute_check", """
WITH r AS (SELECT a.center_id, a.sku_id, a.week_st, a.lag4, a.roll_mean_4, b.qty AS l4, CASE WHEN b3.qty IS NOT NULL THEN (a.qty + b1.qty + b2.qty + b3.qty) / 4.0 END AS rm FROM feat a
 LEFT JOIN gq b ON b.center_id = a.center_id AND b.sku_id = a.sku_id AND b.week_st = a.week_st - 28 LEFT JOIN gq b1 ON b1.center_id = a.center_id AND b1.sku_id = a.sku_id AND b1.week_st = a.week_st - 7
 LEFT JOIN gq b2 ON b2.center_id = a.center_id AND b2.sku_id = a.sku_id AND b2.week_st = a.week_st - 14 LEFT JOIN gq b3 ON b3.center_id = a.center_id AND b3.sku_id = a.sku_id AND b3.week_st = a.week_st - 21)
SELECT 'lag4' AS column_name, count(*) FILTER (WHERE lag4 IS DISTINCT FROM l4) AS mismatches FROM r UNION ALL
SELECT 'roll_mean_4', count(*) FILTER (WHERE round(roll_mean_4, 6) IS DISTINCT FROM round(rm, 6)) FROM r""")
def recompute_check(s):
    """Lag and rolling mean rebuilt by date arithmetic: each row is sent to the weeks that need it."""
    from stockloom.operators.joins import ref_equal
    g = stored_grid(s).select(*KEY, "qty")
    sent = g.select(*M.SKU, "week_st", "qty", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select(
        *M.SKU, F.date_add("week_st", F.col("k") * 7).alias("week_st"), "qty", "k")
    again = sent.groupBy(*KEY).agg(
        F.max(F.when(F.col("k") == 4, F.col("qty"))).alias("lag4"),
        F.when(F.count_if(F.col("k") <= 3) == 4, r6(F.sum(F.when(F.col("k") <= 3, F.col("qty"))) / 4)).alias("roll_mean_4"))
    kept = S.add_rolling(S.add_lags(stored_grid(s))).select(*KEY, "lag4", r6(F.col("roll_mean_4")).alias("roll_mean_4"))
    return ref_equal(kept, again, KEY, ["lag4", "roll_mean_4"])


@query("E58", "source_status_summary", """
SELECT coalesce(center_id, 'ALL') AS scope, model, count(*) AS n, count(*) FILTER (WHERE source = 'model') AS from_model, count(*) FILTER (WHERE source = 'short') AS from_short,
 count(*) FILTER (WHERE source = 'no_history') AS from_fallback FROM preds GROUP BY GROUPING SETS ((center_id, model), (model))""")
def source_status_summary(s):
    sets = [[F.col("center_id"), F.col("model")], [F.col("model")]]
    return preds(s).groupingSets(sets, "center_id", "model").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("source") == k).alias(v) for k, v in (("model", "from_model"), ("short", "from_short"), ("no_history", "from_fallback"))]).select(
        F.coalesce("center_id", F.lit("ALL")).alias("scope"), "model", "n", "from_model", "from_short", "from_fallback")


@query("E59", "population_zero_history", """
WITH o AS (SELECT DISTINCT week_st FROM wk_sales), p AS (SELECT DISTINCT o.week_st, s.center_id, s.sku_id FROM o JOIN wk_sales s ON s.week_st IN (o.week_st + 7, o.week_st + 14, o.week_st + 28)),
 f AS (SELECT center_id, sku_id, min(week_st) AS fw FROM wk_sales GROUP BY 1, 2)
SELECT p.week_st AS origin, count(*) AS population, count(*) FILTER (WHERE fw > p.week_st) AS zero_history FROM p JOIN f USING (center_id, sku_id) GROUP BY 1""")
def population_zero_history(s):
    facts = P.sales_facts(s).select(*KEY)
    origins = facts.select("week_st").distinct()
    seen = facts.select(*M.SKU, F.explode(F.array(*map(F.lit, HORIZONS))).alias("h"), "week_st").select(*M.SKU, F.date_sub("week_st", F.col("h") * 7).alias("origin")).distinct()
    first = facts.groupBy(*M.SKU).agg(F.min("week_st").alias("first_week"))
    return (seen.join(origins.withColumnRenamed("week_st", "origin"), "origin", "left_semi").join(first, M.SKU).groupBy("origin")
            .agg(F.count("*").alias("population"), F.count_if(F.col("first_week") > F.col("origin")).alias("zero_history")))


# -- statistics --------------------------------------------------------------
cte("cseries", "SELECT center_id, week_st, x, row_number() OVER (PARTITION BY center_id ORDER BY week_st) AS t FROM (SELECT center_id, week_st, CAST(sum(sales_qty) AS DOUBLE) AS x FROM wk_sales GROUP BY 1, 2)")


def cseries(s):
    return ST.weekly_series(P.sales_facts(s), "sales_qty")


cte("acf_rows", """
WITH d AS (SELECT center_id, t, x - avg(x) OVER (PARTITION BY center_id) AS d, count(*) OVER (PARTITION BY center_id) AS n FROM cseries), v AS (SELECT center_id, sum(d * d) AS v, max(n) AS n FROM d GROUP BY 1)
SELECT a.center_id, CAST(k AS INT) AS lag, round(sum(a.d * b.d) / max(v), 6) AS acf, round(1.96 / sqrt(max(v.n)), 6) AS "limit" FROM (SELECT unnest(generate_series(1, 30)) AS k) l, d a JOIN d b ON b.center_id = a.center_id
JOIN v ON v.center_id = a.center_id WHERE a.t = b.t + k GROUP BY 1, 2""")


@query("I01", "acf", "SELECT * FROM acf_rows")
def acf(s):
    return ST.acf(cseries(s), 30)


cte("spec_rows", """
WITH c AS (SELECT center_id, t, x - avg(x) OVER (PARTITION BY center_id) AS x, count(*) OVER (PARTITION BY center_id) AS n FROM cseries),
 s AS (SELECT center_id, n, f, sum(x * cos(2 * pi() * f * (t - 1) / n)) AS re, sum(x * sin(2 * pi() * f * (t - 1) / n)) AS im FROM c, (SELECT unnest(generate_series(1, 1000)) AS f) WHERE f <= n // 2 GROUP BY 1, 2, 3)
SELECT center_id, f, n * 1.0 / f AS period, CASE WHEN f * 2 = n THEN 1 ELSE 2 END * (re * re + im * im) / (CAST(n AS DOUBLE) * n) AS power FROM s""")


@query("I02", "periodogram", "SELECT center_id, f, round(period, 6) AS period, round(power, 4) AS power FROM spec_rows")
def periodogram(s):
    return ST.periodogram(cseries(s)).select("center_id", "f", r6(F.col("period")).alias("period"), F.round("power", 4).alias("power"))


@query("I03", "top_peaks", """
SELECT center_id, f, round(period, 6) AS period, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY center_id ORDER BY power DESC, f) AS r FROM spec_rows) WHERE r <= 5""")
def top_peaks(s):
    return ST.top_peaks(ST.periodogram(cseries(s)), ["center_id"], "power", ["f"], 5).select("center_id", "f", r6(F.col("period")).alias("period"), "rank")


@query("I04", "spearman", """
WITH p AS (SELECT center_id, roll_mean_4 AS x, CAST(qty AS DOUBLE) AS y FROM feat WHERE roll_mean_4 IS NOT NULL),
 r AS (SELECT center_id, rank() OVER (PARTITION BY center_id ORDER BY x) + (count(*) OVER (PARTITION BY center_id, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY center_id ORDER BY y) + (count(*) OVER (PARTITION BY center_id, y) - 1) / 2.0 AS ry FROM p)
SELECT center_id, round(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def spearman(s):
    f = S.add_rolling(stored_grid(s)).select("center_id", "roll_mean_4", F.col("qty").cast("double").alias("y"))
    return ST.spearman(f, ["center_id"], "roll_mean_4", "y")


OFFSETS = tuple(range(0, -10, -1))


def monthly_demand(s):
    return s.lines().where("kind = 'sales'").groupBy(F.year("tx_date").alias("y"), F.month("tx_date").alias("m")).agg(F.sum(F.greatest("qty", F.lit(0))).cast("double").alias("demand"))


def candidates(s):
    """Month offsets x two indicators x three transforms, as one row per month and candidate."""
    index = s.retail().groupBy("y", "m").agg(F.sum("retail_constant").cast("double").alias("v")).withColumn("indicator", F.lit("orders"))
    level = s.cpi().select("y", "m", F.col("cpi").alias("v"), F.lit("price").alias("indicator"))
    both = index.unionByName(level)
    out = S.linear_detrend(S.yoy_pct(both, "indicator", "v"), "indicator", "v").select(
        "y", "m", "indicator", F.explode(F.array(*[F.struct(F.lit(n).alias("transform"), F.col(c).alias("x")) for n, c in (("raw", "v"), ("yoy", "yoy"), ("detrended", "residual"))])).alias("e"))
    shifted = out.select("indicator", "e.transform", "e.x", (F.col("y") * 12 + F.col("m")).alias("mi"), F.explode(F.array(*[F.lit(o) for o in OFFSETS])).alias("month_offset"))
    target = monthly_demand(s).select((F.col("y") * 12 + F.col("m")).alias("mi"), "demand")
    return shifted.withColumn("mi", F.col("mi") - F.col("month_offset")).join(target, "mi").where("x is not null")


_CAND = """
WITH ix AS (SELECT y, m, CAST(sum(retail_constant) AS DOUBLE) AS v, 'orders' AS indicator FROM retail GROUP BY 1, 2 UNION ALL SELECT y, m, cpi, 'price' FROM cpi),
 p AS (SELECT *, (v / lag(v, 12) OVER (PARTITION BY indicator ORDER BY y, m) - 1) * 100 AS yoy, CAST(row_number() OVER (PARTITION BY indicator ORDER BY y, m) - 1 AS DOUBLE) AS px FROM ix),
 l AS (SELECT indicator, regr_slope(v, px) AS b, regr_intercept(v, px) AS a FROM p GROUP BY 1),
 t AS (SELECT indicator, y * 12 + m AS mi, 'raw' AS transform, v AS x FROM p UNION ALL SELECT indicator, y * 12 + m, 'yoy', yoy FROM p UNION ALL SELECT p.indicator, y * 12 + m, 'detrended', v - (a + b * px) FROM p JOIN l USING (indicator)),
 d AS (SELECT CAST(year(tx_date) * 12 + month(tx_date) AS INT) AS mi, CAST(sum(greatest(qty, 0)) AS DOUBLE) AS demand FROM tx WHERE kind = 'sales' GROUP BY 1)
SELECT indicator, transform, CAST(-o AS INT) AS month_offset, x, demand FROM t, (SELECT unnest(generate_series(0, 9)) AS o), d WHERE d.mi = t.mi + o AND x IS NOT NULL"""
cte("cand", _CAND)


@query("I05", "candidate_matrix", "SELECT indicator, transform, month_offset, count(*) AS n, round(sum(x), 2) AS x_sum, sum(demand) AS demand FROM cand GROUP BY 1, 2, 3")
def candidate_matrix(s):
    return candidates(s).groupBy("indicator", "transform", "month_offset").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("x_sum"), F.sum("demand").alias("demand"))


cte("month_panel", """
SELECT CASE WHEN cpi.y < 1998 THEN 'early' ELSE 'late' END AS slice, cpi, CAST(c AS DOUBLE) AS orders, demand FROM cpi JOIN (SELECT y, m, sum(retail_constant) AS c FROM retail GROUP BY 1, 2) r ON r.y = cpi.y AND r.m = cpi.m
JOIN (SELECT year(tx_date) AS y, month(tx_date) AS m, CAST(sum(greatest(qty, 0)) AS DOUBLE) AS demand FROM tx WHERE kind = 'sales' GROUP BY 1, 2) d ON d.y = cpi.y AND d.m = cpi.m""")


@query("I06", "pairwise_corr", " UNION ALL ".join(
    f"SELECT slice, '{a}|{b}' AS pair, round(corr({a}, {b}), 6) AS corr, round(var_samp({a}), 2) AS var_first, round(var_samp({b}), 2) AS var_second FROM month_panel GROUP BY 1"
    for a, b in (("cpi", "orders"), ("cpi", "demand"), ("orders", "demand"))))
def pairwise_corr(s):
    orders = s.retail().groupBy("y", "m").agg(F.sum("retail_constant").cast("double").alias("orders"))
    rows = s.cpi().join(orders, ["y", "m"]).join(monthly_demand(s), ["y", "m"]).withColumn("slice", F.when(F.col("y") < 1998, "early").otherwise("late"))
    return ST.pairwise_corr(rows, ["slice"], ["cpi", "orders", "demand"])


def _rhos(s):
    rho = ST.spearman(candidates(s), ["indicator", "month_offset", "transform"], "x", "demand")
    wide = lambda t, c: F.max(F.when(F.col("transform") == t, F.col(c)))
    return rho.groupBy("indicator", "month_offset").agg(*[wide(t, "rho").alias(t) for t in ("raw", "yoy", "detrended")], wide("raw", "n").alias("n")).withColumn(
        "candidate", F.concat_ws("@", "indicator", F.col("month_offset").cast("string")))


@query("I07", "candidate_score", """
WITH r AS (SELECT *, rank() OVER (PARTITION BY indicator, transform, month_offset ORDER BY x) + (count(*) OVER (PARTITION BY indicator, transform, month_offset, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY indicator, transform, month_offset ORDER BY demand) + (count(*) OVER (PARTITION BY indicator, transform, month_offset, demand) - 1) / 2.0 AS ry FROM cand),
 s AS (SELECT indicator, transform, month_offset, round(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 6) AS rho, count(*) AS n FROM r GROUP BY 1, 2, 3),
 w AS (SELECT concat(indicator, '@', CAST(month_offset AS VARCHAR)) AS candidate, max(CASE WHEN transform = 'raw' THEN rho END) AS raw, max(CASE WHEN transform = 'yoy' THEN rho END) AS yoy,
  max(CASE WHEN transform = 'detrended' THEN rho END) AS detrended, max(CASE WHEN transform = 'raw' THEN n END) AS n FROM s GROUP BY 1)
SELECT candidate, raw, yoy, detrended, n, round(abs(raw) + greatest(coalesce(abs(detrended), 0), coalesce(abs(yoy), 0)), 6) AS score FROM w
WHERE abs(raw) >= 1.96 / sqrt(n - 1) AND (coalesce(abs(detrended) >= 1.96 / sqrt(n - 1), false) OR coalesce(abs(yoy) >= 1.96 / sqrt(n - 1), false)) ORDER BY score DESC, candidate LIMIT 5""")
def candidate_score(s):
    return ST.candidate_score(_rhos(s), 5, z=1.96).select("candidate", "raw", "yoy", "detrended", "n", "score")


@query("I08", "center_comparison", """
WITH w AS (SELECT center_id, x FROM cseries), m AS (SELECT center_id, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS lo, max(x) AS hi FROM w GROUP BY 1)
""" + " UNION ALL ".join(f"SELECT '{c}' AS metric, max(CASE WHEN center_id = 'A' THEN {c} END) AS A, max(CASE WHEN center_id = 'B' THEN {c} END) AS B FROM m" for c in ("mean", "std", "lo", "hi")))
def center_comparison(s):
    one = cseries(s).groupBy("center_id").agg(r6(F.avg("x")).alias("mean"), r6(F.stddev_samp("x")).alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return one.unpivot(["center_id"], ["mean", "std", "lo", "hi"], "metric", "value").groupBy("metric").pivot("center_id", ["A", "B"]).agg(F.max("value"))
