"""Series features on the test tables."""

from pyspark.sql import functions as F

from stockloom.functions import columns as C
from stockloom.functions.columns import r6
from stockloom.operators import cleaning
from stockloom.operators import marts as M
from stockloom.operators import series as S
from stockloom.plans import marts as P
from stockloom.plans.joining import places, tx_city
from stockloom.registry import cte, query
from stockloom.sources.adapters import BASIS_DATE, BASIS_WEEK, HOLDOUT_START, HORIZONS, REGIME_START

KEY = [*M.SKU, "week_st"]
_K = "center_id, sku_id, week_st"


def grid(s):
    """The grid's limits come from a scan of two transaction columns."""
    weeks = s.lines()
    floor = weeks.where("kind = 'sales'").agg(F.min("week_st")).scalar()
    return S.weekly_grid(s.tx(), floor, P.last_week(s))


cte("gq", """
WITH fs AS (SELECT center_id, sku_id, min(tx_date) AS first_stock FROM tx WHERE work_type = 'inbound' GROUP BY 1, 2),
 fo AS (SELECT center_id, sku_id, min(week_st) AS seen FROM wk_sales GROUP BY 1, 2),
 st AS (SELECT center_id, sku_id, date_trunc('week', greatest(least(coalesce(first_stock, seen), seen), (SELECT min(week_st) FROM wk_sales))) AS gs
   FROM fo LEFT JOIN fs USING (center_id, sku_id)),
 g AS (SELECT center_id, sku_id, CAST(unnest(generate_series(CAST(gs AS TIMESTAMP), (SELECT CAST(max(week_st) AS TIMESTAMP) FROM tx), INTERVAL 7 DAY)) AS DATE) AS week_st FROM st)
SELECT center_id, sku_id, week_st, cat_l, cat_m, cat_s, coalesce(sales_qty, 0) AS qty,
 CASE WHEN coalesce(sales_qty, 0) > 0 THEN 1 ELSE 0 END AS sold, CASE WHEN sales_qty > 0 THEN ln(1 + sales_qty) END AS qty_log1p
FROM g LEFT JOIN wk_sales USING (center_id, sku_id, week_st) JOIN pmaster USING (center_id, sku_id)""")

_W = "PARTITION BY center_id, sku_id ORDER BY week_st"
cte("feat", f"""
WITH a AS (SELECT *, lag(qty, 1) OVER w AS lag1, lag(qty, 2) OVER w AS lag2, lag(qty, 4) OVER w AS lag4,
  CASE WHEN count(qty) OVER r = 4 THEN avg(qty) OVER r END AS roll_mean_4, CASE WHEN count(qty) OVER r = 4 THEN stddev_samp(qty) OVER r END AS roll_std_4,
  max(CASE WHEN sold = 1 THEN week_st END) OVER (PARTITION BY center_id, sku_id ORDER BY week_st ROWS UNBOUNDED PRECEDING) AS last_active_week,
  min(CASE WHEN sold = 1 THEN week_st END) OVER (PARTITION BY center_id, sku_id) AS fs,
  row_number() OVER w AS pos, sum(sold) OVER b AS nsold, count(CASE WHEN sold = 1 THEN qty END) OVER b AS c,
  sum(CASE WHEN sold = 1 THEN CAST(qty AS HUGEINT) END) OVER b AS sm, sum(CASE WHEN sold = 1 THEN CAST(qty AS HUGEINT) * qty END) OVER b AS sq
 FROM gq WINDOW w AS ({_W}), r AS ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), b AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT center_id, sku_id, week_st, cat_l, cat_m, cat_s, qty, sold, qty_log1p, lag1, lag2, lag4, ln(1 + lag1) AS lag1_log1p, ln(1 + lag2) AS lag2_log1p,
 ln(1 + lag4) AS lag4_log1p, roll_mean_4, roll_std_4, last_active_week, CAST(floor((week_st - last_active_week) / 7) AS INT) AS weeks_since_active,
 CASE WHEN pos <= 52 THEN 1 ELSE 0 END AS is_warmup,
 CASE WHEN fs IS NULL OR week_st < fs OR floor((week_st - fs) / 7) + 1 < 8 THEN 1 ELSE 0 END AS coldstart,
 CASE WHEN week_st >= fs THEN floor((week_st - fs) / 7) / nullif(nsold, 0) END AS adi,
 last_value(CASE WHEN sold = 1 AND c >= 2 AND sm > 0 THEN CAST((2000000 * c * (c * sq - sm * sm) + (c - 1) * sm * sm) // (2 * (c - 1) * sm * sm) AS DOUBLE) / 1000000 END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS cv2,
 CAST(week(week_st) AS INT) AS iso_week, CAST(month(week_st) AS INT) AS month, CAST(quarter(week_st) AS INT) AS quarter
FROM a""")


def stored_grid(s):
    return s.stored("weekly_grid", lambda: grid(s.by_week()))


def features(s):
    return S.features(grid(s))


def stored_features(s):
    """The feature table for all that reads its rows more than once: computed once, with their groups and their return join on what is stored."""
    return s.stored("series_features", lambda: S.features(stored_grid(s)))


def flagship(s):
    cols = ["lag1", "lag2", "lag4", "roll_mean_4", "roll_std_4", "weeks_since_active", "is_warmup", "coldstart", "adi", "cv2"]
    return features(s).select(*KEY, *P.LEVELS, "qty", *cols, "iso_week", "month", "quarter")


def _pick(cols, rounded=()):
    return ", ".join([_K, *cols, *[f"round({c}, 6) AS {c}" for c in rounded]])


@query("F01", "weekly_grid", f"SELECT {_K} FROM gq")
def weekly_grid(s):
    return grid(s).select(*KEY)


@query("F02", "zero_fill_after_stock", f"SELECT {_pick(['qty', 'sold', 'cat_s'], ['qty_log1p'])} FROM gq")
def zero_fill_after_stock(s):
    return grid(s).select(*KEY, "qty", "sold", "cat_s", r6(F.col("qty_log1p")).alias("qty_log1p"))


@query("F08", "lags", f"SELECT {_pick(['lag1', 'lag2', 'lag4'], ['lag1_log1p', 'lag2_log1p', 'lag4_log1p'])} FROM feat")
def lags(s):
    return S.add_lags(grid(s)).select(*KEY, "lag1", "lag2", "lag4", *[r6(F.col(f"lag{n}_log1p")).alias(f"lag{n}_log1p") for n in S.LAGS])


@query("F09", "rolling_mean_std", f"SELECT {_pick([], ['roll_mean_4', 'roll_std_4'])} FROM feat")
def rolling_mean_std(s):
    return S.add_rolling(grid(s)).select(*KEY, r6(F.col("roll_mean_4")).alias("roll_mean_4"), r6(F.col("roll_std_4")).alias("roll_std_4"))


@query("F10", "calendar", f"SELECT {_pick(['iso_week', 'month', 'quarter'])} FROM feat")
def calendar(s):
    return S.add_calendar(grid(s)).select(*KEY, "iso_week", "month", "quarter")


@query("F11", "last_active_week", f"SELECT {_pick(['last_active_week'])} FROM feat")
def last_active_week(s):
    return S.add_activity(grid(s)).select(*KEY, "last_active_week")


@query("F12", "weeks_since_active", f"SELECT {_pick(['weeks_since_active'])} FROM feat")
def weeks_since_active(s):
    return S.add_activity(grid(s)).select(*KEY, "weeks_since_active")


@query("F13", "is_warmup", f"SELECT {_pick(['is_warmup'])} FROM feat")
def is_warmup(s):
    return S.add_warmup(grid(s)).select(*KEY, "is_warmup")


cte("veteran", f"SELECT DISTINCT center_id, sku_id FROM wk_sales WHERE center_id = 'B' AND week_st < DATE '{REGIME_START}' AND sales_qty > 0")
cte("regime_rows", f"""
SELECT gq.*, CASE WHEN v.sku_id IS NULL THEN 0 ELSE 1 END AS existed_before_regime FROM gq LEFT JOIN veteran v
 ON v.center_id = gq.center_id AND v.sku_id = gq.sku_id WHERE gq.center_id = 'A' OR week_st >= DATE '{REGIME_START}'""")


@query("F14", "coldstart_flag", f"""
SELECT {_K}, CASE WHEN existed_before_regime = 1 THEN 0 WHEN fs IS NULL OR week_st < fs OR floor((week_st - fs) / 7) + 1 < 8 THEN 1 ELSE 0 END AS coldstart
FROM (SELECT *, min(CASE WHEN sold = 1 THEN week_st END) OVER (PARTITION BY center_id, sku_id) AS fs FROM regime_rows)""")
def coldstart_flag(s):
    return S.add_coldstart(S.regime_filter(grid(s), "B", REGIME_START), veteran="existed_before_regime").select(*KEY, "coldstart")


@query("F15", "adi_expanding", f"SELECT {_pick([], ['adi'])} FROM feat")
def adi_expanding(s):
    return S.add_intermittency(grid(s)).select(*KEY, r6(F.col("adi")).alias("adi"))


@query("F16", "cv2_expanding", f"SELECT {_pick([], ['cv2'])} FROM feat")
def cv2_expanding(s):
    return S.add_intermittency(grid(s)).select(*KEY, r6(F.col("cv2")).alias("cv2"))


FILL = ["lag4", "roll_mean_4", "cv2"]
for _c in FILL:
    cte(f"fill_{_c}", f"""
WITH f AS (SELECT {_K}, cat_l, cat_m, cat_s, CAST({_c} AS DOUBLE) AS v FROM feat),
 wk AS (SELECT *, CAST((2 * sm + n) // (2 * nullif(n, 0)) AS DOUBLE) / 1000000 AS mean FROM (SELECT center_id, week_st, coalesce(sum(CAST(round(v * 1000000) AS HUGEINT)), 0) AS sm, count(v) AS n FROM f GROUP BY 1, 2)),
 wx AS (SELECT *, CAST((2 * sum(sm) OVER z + sum(n) OVER z) // (2 * nullif(sum(n) OVER z, 0)) AS DOUBLE) / 1000000 AS run FROM wk WINDOW z AS (PARTITION BY center_id ORDER BY week_st)),
 wn AS (SELECT a.center_id, a.week_st, max(b.week_st) AS near FROM wk a JOIN wk b ON b.center_id = a.center_id AND b.week_st < a.week_st AND b.n > 0 GROUP BY 1, 2),
 i AS (SELECT *, CAST(round(v * 1000000) AS HUGEINT) AS mv FROM f),
 x AS (SELECT i.*, CAST((2 * sum(mv) OVER w3 + count(v) OVER w3) // (2 * nullif(count(v) OVER w3, 0)) AS DOUBLE) / 1000000 AS m3, CAST((2 * sum(mv) OVER w2 + count(v) OVER w2) // (2 * nullif(count(v) OVER w2, 0)) AS DOUBLE) / 1000000 AS m2, CAST((2 * sum(mv) OVER w1 + count(v) OVER w1) // (2 * nullif(count(v) OVER w1, 0)) AS DOUBLE) / 1000000 AS m1
   FROM i WINDOW w3 AS (PARTITION BY center_id, cat_s, week_st), w2 AS (PARTITION BY center_id, cat_m, week_st), w1 AS (PARTITION BY center_id, cat_l, week_st)),
 y AS (SELECT x.*, wx.mean AS m0, wx.run, CASE WHEN x.week_st - near <= 56 THEN (x.week_st - near) // 7 END AS k,
   CASE WHEN x.week_st - near <= 56 THEN nb.mean END AS nearv FROM x JOIN wx USING (center_id, week_st) LEFT JOIN wn USING (center_id, week_st)
   LEFT JOIN wk nb ON nb.center_id = x.center_id AND nb.week_st = wn.near)
SELECT {_K}, coalesce(v, m3, m2, m1, m0, nearv, run) AS filled, CASE WHEN v IS NOT NULL THEN NULL WHEN m3 IS NOT NULL THEN 'level3' WHEN m2 IS NOT NULL THEN 'level2'
  WHEN m1 IS NOT NULL THEN 'level1' WHEN m0 IS NOT NULL THEN 'center_week' WHEN nearv IS NOT NULL THEN concat('widen', CAST(k AS VARCHAR))
  WHEN run IS NOT NULL THEN 'expanding' END AS source FROM y""")


def filled(s):
    return S.category_fallback(stored_features(s), FILL)


def _fill_join(make):
    return (f"SELECT {_K}, " + ", ".join(make(c) for c in FILL) + " FROM fill_lag4 "
            "JOIN fill_roll_mean_4 USING (center_id, sku_id, week_st) JOIN fill_cv2 USING (center_id, sku_id, week_st)")


@query("F17", "category_fallback", _fill_join(
    lambda c: f"round(fill_{c}.filled, 6) AS {c}_filled, fill_{c}.source AS {c}_source"))
def category_fallback(s):
    return filled(s).select(*KEY, *[e for c in FILL for e in (r6(F.col(f"{c}_filled")).alias(f"{c}_filled"), F.col(f"{c}_source"))])


@query("F18", "filled_log1p", _fill_join(lambda c: f"CASE WHEN fill_{c}.filled IS NOT NULL THEN round(ln(1 + greatest(fill_{c}.filled, 0)), 6) END AS {c}_log1p"))
def filled_log1p(s):
    return filled(s).select(*KEY, *[r6(F.when(F.col(f"{c}_filled").isNotNull(), C.log1p_clip(F.col(f"{c}_filled")))).alias(f"{c}_log1p") for c in FILL])


@query("E48", "fallback_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce(source, 'own') AS source, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct FROM fill_{c} GROUP BY 2"
    for c in FILL))
def fallback_summary(s):
    long = filled(s).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.coalesce(f"{c}_source", F.lit("own")).alias("source")) for c in FILL])).alias("e"))
    counts = long.groupBy("e.feature", "e.source").agg(F.count("*").alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("t"))
    return counts.join(totals, "feature").select("feature", "source", "n", F.round(F.col("n") * 100.0 / F.col("t"), 6).cast("double").alias("share_pct"))


_HW = "(SELECT list(DISTINCT CAST(date_trunc('week', date) AS DATE)) FROM holidays)"


@query("F19", "holiday_windows", f"SELECT {_K}, " + ", ".join(
    f"CASE WHEN list_contains({_HW}, week_st + {7 * (h + d)}) THEN 1 ELSE 0 END AS holiday_h{h}{n}"
    for h in HORIZONS for n, d in (("", 0), ("_before", -1), ("_after", 1))) + " FROM gq")
def holiday_windows(s):
    flags = [f"holiday_h{h}{n}" for h in HORIZONS for n in ("", "_before", "_after")]
    return S.holiday_windows(grid(s), s.holidays(), HORIZONS).select(*KEY, *flags)


@query("F20", "heavy_rain_weeks", """
SELECT center_id, CAST(date_trunc('week', tx_date) AS DATE) AS week_st, count(*) FILTER (WHERE r >= 2.2) AS heavy_days,
 CASE WHEN count(*) FILTER (WHERE r >= 2.2) > 0 THEN 1 ELSE 0 END AS heavy_flag
FROM (SELECT center_id, tx_date, avg(rain) AS r FROM (SELECT DISTINCT center_id, sido, city, tx_date, rain FROM tx_weather) GROUP BY 1, 2) GROUP BY 1, 2""")
def heavy_rain_weeks(s):
    from stockloom.operators.joins import weather_key_resolve, weather_nullsafe_join
    return S.heavy_rain_weeks(weather_nullsafe_join(tx_city(s), weather_key_resolve(places(s), s.weather()), s.weather()), ["sido", "city"], 2.2)


_RUN = f"""SELECT *, CAST(row_number() OVER (PARTITION BY center_id, sku_id, island ORDER BY week_st) AS INT) AS run FROM (
 SELECT *, sum(CASE WHEN pw IS NULL OR week_st - pw <> 7 THEN 1 ELSE 0 END) OVER ({_W}) AS island FROM (
  SELECT *, lag(week_st) OVER ({_W}) AS pw FROM wk_sales))"""


@query("F21", "run_length", f"SELECT {_K}, run FROM ({_RUN})")
def run_length(s):
    return S.run_length(P.sales_facts(s)).select(*KEY, "run")


LOOKBACK = 4
cte("enc", f"""
SELECT {_K}, target, pos, week_st + 7 AS target_date, list(qty) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS qs,
  list(week_st) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ws
FROM (SELECT *, lead(qty, 1) OVER ({_W}) AS target, row_number() OVER ({_W}) AS pos FROM gq)""")


def windows(s):
    return S.encoder_windows(S.horizon_targets(grid(s), (1,), P.last_week(s)), ["qty"], LOOKBACK, "target_h1")


@query("F22", "encoder_windows", f"SELECT {_K}, array_to_string(qs, ',') AS qty_window, target FROM enc WHERE pos >= 4 AND target IS NOT NULL")
def encoder_windows(s):
    text = F.array_join(F.transform("window", lambda x: x["qty"].cast("string")), ",")
    return windows(s).select(*KEY, text.alias("qty_window"), F.col("target_h1").alias("target"))


@query("F23", "monthly_lag_features", f"""
SELECT {_K}, round(a.cpi, 6) AS cpi_lag1, round(b.cpi, 6) AS cpi_lag12 FROM gq
LEFT JOIN cpi a ON a.y * 12 + a.m = year(week_st) * 12 + month(week_st) - 1
LEFT JOIN cpi b ON b.y * 12 + b.m = year(week_st) * 12 + month(week_st) - 12""")
def monthly_lag_features(s):
    out = S.monthly_lags(grid(s).select(*KEY), s.cpi(), "cpi", {"cpi_lag1": -1, "cpi_lag12": -12})
    return out.select(*KEY, r6(F.col("cpi_lag1")).alias("cpi_lag1"), r6(F.col("cpi_lag12")).alias("cpi_lag12"))


@query("F24", "yoy_pct", """
SELECT sido, y, m, round((retail_current / lag(retail_current, 12) OVER (PARTITION BY sido ORDER BY y, m) - 1) * 100, 6) AS yoy FROM retail""")
def yoy_pct(s):
    return S.yoy_pct(s.retail(), "sido", "retail_current").select("sido", "y", "m", r6(F.col("yoy")).alias("yoy"))


@query("F25", "linear_detrend", """
WITH p AS (SELECT sido, y, m, retail_current AS v, CAST(row_number() OVER (PARTITION BY sido ORDER BY y, m) - 1 AS DOUBLE) AS x FROM retail),
 l AS (SELECT sido, regr_slope(v, x) AS b, regr_intercept(v, x) AS a FROM p GROUP BY 1)
SELECT sido, y, m, round(v - (a + b * x), 3) AS residual FROM p JOIN l USING (sido)""")
def linear_detrend(s):
    return S.linear_detrend(s.retail(), "sido", "retail_current").select("sido", "y", "m", F.round("residual", 3).alias("residual"))


_TGT = ", ".join(f"lead(qty, {h}) OVER w AS target_h{h}, lead(sold, {h}) OVER w AS target_h{h}_sold, lead(qty_log1p, {h}) OVER w AS target_h{h}_log1p" for h in HORIZONS)
cte("targets", f"SELECT *, {_TGT} FROM gq WINDOW w AS ({_W})")


def targets(s):
    return S.horizon_targets(grid(s), HORIZONS, P.last_week(s))


@query("F26", "horizon_targets", f"SELECT {_pick([f'target_h{h}' for h in HORIZONS] + [f'target_h{h}_sold' for h in HORIZONS], [f'target_h{h}_log1p' for h in HORIZONS])} FROM targets")
def horizon_targets(s):
    return targets(s).select(*KEY, *[c for h in HORIZONS for c in (f"target_h{h}", f"target_h{h}_sold")],
                             *[r6(F.col(f"target_h{h}_log1p")).alias(f"target_h{h}_log1p") for h in HORIZONS])


@query("F27", "regime_filter", f"SELECT {_K}, qty, existed_before_regime FROM regime_rows")
def regime_filter(s):
    return S.regime_filter(grid(s), "B", REGIME_START).select(*KEY, "qty", "existed_before_regime")


_SPLITS = [("1998-01-05", "train"), ("1999-01-04", "val"), (HOLDOUT_START, "test")]


@query("F28", "split_by_date", f"""
SELECT split, center_id, count(*) AS n, min(week_st) AS lo, max(week_st) AS hi, CAST(sum(qty) AS BIGINT) AS qty FROM (
 SELECT *, CASE WHEN week_st < DATE '1998-01-05' THEN 'train' WHEN week_st < DATE '1999-01-04' THEN 'val' WHEN week_st < DATE '{HOLDOUT_START}' THEN 'test' ELSE 'holdout' END AS split
 FROM gq) GROUP BY 1, 2""")
def split_by_date(s):
    return S.split_by_date(grid(s), _SPLITS, "holdout").groupBy("split", "center_id").agg(
        F.count("*").alias("n"), F.min("week_st").alias("lo"), F.max("week_st").alias("hi"), F.sum("qty").alias("qty"))


@query("F29", "interpolate_linear", """
WITH p AS (SELECT sido, sigungu, date, CASE WHEN rain % 4 <> 0 AND day(date) % 3 <> 0 THEN temp / 7 END AS t,
  row_number() OVER (PARTITION BY sido, sigungu ORDER BY date) AS pos FROM weather),
 a AS (SELECT *, last_value(CASE WHEN t IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY sido, sigungu ORDER BY date ROWS UNBOUNDED PRECEDING) AS pa,
   last_value(t IGNORE NULLS) OVER (PARTITION BY sido, sigungu ORDER BY date ROWS UNBOUNDED PRECEDING) AS va,
   first_value(CASE WHEN t IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY sido, sigungu ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb,
   first_value(t IGNORE NULLS) OVER (PARTITION BY sido, sigungu ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM p)
SELECT sido, sigungu, date, round(CASE WHEN t IS NOT NULL THEN t WHEN pb IS NULL THEN va ELSE va + (vb - va) / (pb - pa) * (pos - pa) END, 6) AS temp FROM a""")
def interpolate_linear(s):
    gappy = s.weather().selectExpr("sido", "sigungu", "date", "case when rain % 4 <> 0 and day(date) % 3 <> 0 then temp / 7 end as temp")
    return S.interpolate_linear(gappy, ["sido", "sigungu"], "date", "temp").withColumn("temp", F.round("temp", 6))


@query("F30", "null_prefix_weeks", """
SELECT center_id, sku_id, CAST(sum(p) AS BIGINT) AS null_prefix_weeks, count(*) AS weeks FROM (
 SELECT *, min(CASE WHEN lag4 IS NULL AND roll_mean_4 IS NULL AND cv2 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY center_id, sku_id ORDER BY week_st) AS p FROM feat) GROUP BY 1, 2""")
def null_prefix_weeks(s):
    return S.null_prefix(features(s), FILL)


cte("cat_basis", f"""
SELECT cat_m, CAST(sum(sales_amount) AS DECIMAL(18,2)) AS sales_amount FROM wk_sales JOIN pmaster USING (center_id, sku_id)
WHERE week_st = DATE '{BASIS_WEEK}' GROUP BY 1""")


@query("F32", "share_rank", """
SELECT cat_m, sales_amount, round(CAST(sales_amount AS DOUBLE) / CAST(sum(sales_amount) OVER () AS DOUBLE), 6) AS share,
 CAST(row_number() OVER (ORDER BY sales_amount DESC, cat_m) AS INT) AS rank FROM cat_basis""")
def share_rank(s):
    week = P.sales_facts(s).where(F.col("week_st") == F.lit(BASIS_WEEK).cast("date"))
    sums = week.join(P.master(s).select(*M.SKU, "cat_m"), M.SKU).groupBy("cat_m").agg(M.total("sales_amount"))
    return S.share_rank(sums, "cat_m", "sales_amount").withColumn("share", r6(F.col("share")))


@query("F33", "moving_avg_7d", """
SELECT center_id, tx_date, sales_qty, round(avg(sales_qty) OVER (PARTITION BY center_id ORDER BY tx_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS avg_7
FROM (SELECT center_id, tx_date, CAST(sum(sales_qty) AS BIGINT) AS sales_qty FROM day_sales GROUP BY 1, 2)""")
def moving_avg_7d(s):
    daily = M.sign_split(s.lines().where("kind = 'sales'")).groupBy("center_id", "tx_date").agg(M.total("sales_qty"))
    return S.moving_avg(daily, ["center_id"], "tx_date", "sales_qty", 7).withColumn("avg_7", r6(F.col("avg_7")))


cte("week_flags", """
SELECT w.week_st, max(coalesce(covid, 0)) AS covid, max(CASE WHEN h.date IS NULL THEN 0 ELSE 1 END) AS holiday FROM (SELECT DISTINCT week_st, tx_date FROM tx) w
LEFT JOIN covid ON covid.date = w.tx_date LEFT JOIN holidays h ON h.date = w.tx_date GROUP BY 1""")


@query("F34", "exog_future", """
WITH o AS (SELECT DISTINCT week_st FROM tx), r AS (SELECT week_st, step, week_st + CAST(7 * step AS INT) AS target_week FROM o, (SELECT CAST(unnest([1, 2, 3, 4]) AS INT) AS step))
SELECT r.week_st, step, target_week, round(a.cpi, 6) AS sentiment, round(b.cpi, 6) AS cpi_lag3, f.covid, f.holiday FROM r
LEFT JOIN cpi a ON a.y * 12 + a.m = year(r.week_st) * 12 + month(r.week_st) - 1
LEFT JOIN cpi b ON b.y * 12 + b.m = year(target_week) * 12 + month(target_week) - 3
LEFT JOIN week_flags f ON f.week_st = target_week""")
def exog_future(s):
    days = s.lines().select("week_st", "tx_date").distinct()
    flags = (days.join(s.covid().withColumnRenamed("date", "tx_date"), "tx_date", "left")
             .join(s.holidays().withColumnRenamed("date", "tx_date"), "tx_date", "left").groupBy("week_st")
             .agg(F.max(F.coalesce("covid", F.lit(0))).alias("covid"), F.max(F.col("holiday").isNotNull().cast("int")).alias("holiday")))
    out = S.exog_future(days.select("week_st").distinct(), s.cpi(), flags, 4)
    return out.withColumns({"sentiment": r6(F.col("sentiment")), "cpi_lag3": r6(F.col("cpi_lag3"))})


@query("F35", "exog_consistency", """
SELECT week_st, 'cpi' AS column_name, count(DISTINCT cpi) AS distinct_values FROM (SELECT CAST(date_trunc('week', tx_date) AS DATE) AS week_st, cpi, covid FROM enriched) GROUP BY 1 HAVING count(DISTINCT cpi) > 1
UNION ALL SELECT week_st, 'covid', count(DISTINCT covid) FROM (SELECT CAST(date_trunc('week', tx_date) AS DATE) AS week_st, cpi, covid FROM enriched) GROUP BY 1 HAVING count(DISTINCT covid) > 1""")
def exog_consistency(s):
    days = s.lines().select("week_st", "tx_date", F.year("tx_date").alias("y"), F.month("tx_date").alias("m")).distinct()
    outside = days.join(s.cpi(), ["y", "m"], "left").join(s.covid().withColumnRenamed("date", "tx_date"), "tx_date", "left")
    return S.exog_consistency(outside, "week_st", ["cpi", "covid"])


@query("F36", "encoder_decoder_long", """
WITH w AS (SELECT * FROM enc WHERE pos >= 4 AND target IS NOT NULL),
 e AS (SELECT center_id, sku_id, week_st AS origin, CAST(i - 1 AS INT) AS time_idx, ws[i] AS date, qs[i] AS qty, 0 AS is_decoder FROM w, (SELECT unnest([1, 2, 3, 4]) AS i)
  UNION ALL SELECT center_id, sku_id, week_st, 4, target_date, qs[4], 1 FROM w)
SELECT is_decoder, time_idx, CAST(week(date) AS INT) AS iso_week, CAST(quarter(date) AS INT) AS quarter, center_id, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty, max(date) AS last_date FROM e GROUP BY 1, 2, 3, 4, 5""")
def encoder_decoder_long(s):
    long = S.encoder_decoder_long(windows(s), ["qty"], 1)
    return long.groupBy("is_decoder", "time_idx", "iso_week", "quarter", "center_id").agg(
        F.count("*").alias("n"), F.sum("qty").alias("qty"), F.max("date").alias("last_date"))


@query("F37", "decoder_context", f"SELECT {_K}, concat_ws(',', CAST(ws[3] AS VARCHAR), CAST(ws[4] AS VARCHAR), CAST(target_date AS VARCHAR)) AS steps FROM enc WHERE pos >= 4 AND target IS NOT NULL")
def decoder_context(s):
    text = F.array_join(F.transform("decoder", lambda x: x["week_st"].cast("string")), ",")
    return S.decoder_context(windows(s), 2, 1).select(*KEY, text.alias("steps"))


@query("F38", "context_tail", f"""
SELECT 'kept' AS part, count(*) AS n FROM enc WHERE pos >= 4 AND target IS NOT NULL AND week_st >= DATE '{HOLDOUT_START}' UNION ALL
SELECT 'missing', count(*) FROM enc WHERE NOT (pos >= 4 AND target IS NOT NULL) AND week_st >= DATE '{HOLDOUT_START}'""")
def context_tail(s):
    from stockloom.operators.profiling import count_rows
    kept, missing = S.context_tail(S.horizon_targets(grid(s), (1,), P.last_week(s)), ["qty"], LOOKBACK, "target_h1", F.lit(HOLDOUT_START).cast("date"))
    return count_rows({"kept": kept, "missing": missing}, "part")


@query("B21", "normalize_flags", f"SELECT {_K}, coldstart, is_warmup, CASE WHEN quarter = 4 THEN 1 ELSE 0 END AS is_q4 FROM feat")
def normalize_flags(s):
    f = features(s).selectExpr(*KEY, "coldstart = 1 as coldstart", "is_warmup = 1 as is_warmup", "quarter = 4 as is_q4")
    return f.withColumns({c: F.col(c).cast("int") for c in ("coldstart", "is_warmup", "is_q4")})


@query("B22", "log_transforms", f"SELECT {_K}, round(ln(1 + greatest(qty - 5, 0)), 6) AS log_q, round(greatest(exp(qty / 100.0 - 0.1) - 1, 0), 6) AS back FROM gq")
def log_transforms(s):
    return grid(s).select(*KEY, r6(C.log1p_clip(F.col("qty") - 5)).alias("log_q"),
                          r6(C.expm1_clip(F.col("qty") / F.lit(100.0) - F.lit(0.1))).alias("back"))


@query("B23", "interactions", f"""
SELECT {_K}, CASE WHEN center_id = 'B' THEN 1 ELSE 0 END AS is_b, CASE WHEN center_id = 'B' THEN lag1 ELSE lag1 * 0 END AS is_b_lag1,
 round(roll_mean_4 * month, 6) AS mean_month FROM feat""")
def interactions(s):
    is_b = (F.col("center_id") == "B").cast("int")
    return features(s).select(*KEY, is_b.alias("is_b"), (is_b * F.col("lag1")).alias("is_b_lag1"), r6(F.col("roll_mean_4") * F.col("month")).alias("mean_month"))


@query("B24", "cap_weeks_inactive", f"SELECT {_K}, CAST(least(coalesce(weeks_since_active, 156), 156) AS INT) AS weeks_inactive FROM feat")
def cap_weeks_inactive(s):
    return S.add_activity(grid(s)).select(*KEY, C.cap_weeks(F.col("weeks_since_active")).alias("weeks_inactive"))


@query("B28", "select_features", f"SELECT {_K}, lag1, lag2, lag4 FROM feat")
def select_features(s):
    return cleaning.select_features(features(s), KEY, r"lag\d+")


@query("C08", "replicate_horizon", """
SELECT center_id, sku_id, week_st, qty, CAST(h AS INT) AS horizon, week_st + CAST(7 * h AS INT) AS target_date FROM gq, (SELECT unnest([1, 2, 4]) AS h)""")
def replicate_horizon(s):
    rows = grid(s).select(*KEY, "qty", F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("horizon"))
    return rows.withColumn("target_date", F.date_add("week_st", F.col("horizon") * 7))
