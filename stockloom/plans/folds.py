"""Folds, imputation and encoding on the test tables."""

from pyspark.sql import functions as F

from stockloom.functions.columns import r6
from stockloom.operators import folds as FO
from stockloom.operators import marts as M
from stockloom.plans import marts as P
from stockloom.plans.series import KEY, _K, features, grid, stored_features, targets
from stockloom.registry import query
from stockloom.sources.adapters import HOLDOUT_START, HORIZONS, REGIME_START, VALIDATION_YEARS

FOLDS = [f for y in VALIDATION_YEARS for f in FO.quarter_folds(y)]
FIXED = [FO.Fold("expanding_1", "1998-01-01", "1998-06-30"), FO.Fold("expanding_2", "1998-07-01", "1998-12-31"),
         FO.Fold("rolling_1", "1998-01-01", "1998-06-30", "1997-01-01"), FO.Fold("rolling_2", "1998-07-01", "1998-12-31", "1997-07-01")]


def _fold_sql(folds, table="gq", where="center_id = 'A'", date="week_st + 7"):
    values = ", ".join(f"('{f.name}', DATE '{f.val_start}', DATE '{f.val_end}', DATE '{f.train_start}')" for f in folds)
    return f"""SELECT g.*, v.fold, CASE WHEN {date} >= vs THEN 'val' ELSE 'train' END AS role FROM {table} g
 JOIN (VALUES {values}) v(fold, vs, ve, ts) ON {date} >= ts AND {date} <= ve WHERE {where}"""


def folded(s, folds=FOLDS):
    rows = grid(s).where("center_id = 'A'").withColumn("target_date", FO.target_date(1))
    return FO.assign_folds(rows, folds, "target_date")


_COUNTS = "fold, role, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty, min(week_st) AS lo, max(week_st) AS hi"


def _counts(df):
    return df.groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.min("week_st").alias("lo"), F.max("week_st").alias("hi"))


@query("G01", "expanding_folds", f"SELECT {_COUNTS} FROM ({_fold_sql(FOLDS)}) GROUP BY 1, 2")
def expanding_folds(s):
    return _counts(folded(s))


@query("G02", "walkforward_folds", f"""
WITH w AS (SELECT DISTINCT week_st FROM gq WHERE center_id = 'B' AND week_st >= DATE '{REGIME_START}' AND week_st + 7 <= DATE '{HOLDOUT_START}'),
 u AS (SELECT week_st, count(*) AS t, count(*) FILTER (WHERE center_id = 'B') AS b, sum(CASE WHEN center_id = 'B' THEN qty ELSE 0 END) AS bq
  FROM gq WHERE center_id <> 'B' OR week_st >= DATE '{REGIME_START}' GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY w.week_st) AS INT) AS fold, w.week_st AS val_week, w.week_st + 7 AS val_target_date,
 CAST((SELECT sum(t) FROM u x WHERE x.week_st < w.week_st) AS BIGINT) AS train_rows, u.b AS val_rows, CAST(u.bq AS BIGINT) AS val_qty FROM w JOIN u USING (week_st)""")
def walkforward_folds(s):
    return FO.walkforward_folds(grid(s), "B", REGIME_START, HOLDOUT_START, 1)


@query("G03", "final_masks", f"""
SELECT center_id, CASE WHEN (center_id <> 'B' OR week_st >= DATE '{REGIME_START}') AND week_st + 28 < DATE '{HOLDOUT_START}' THEN 1 ELSE 0 END AS in_retrain,
 CASE WHEN week_st >= DATE '{HOLDOUT_START}' AND week_st + 28 <= (SELECT max(week_st) FROM gq) THEN 1 ELSE 0 END AS in_holdout, count(*) AS n FROM gq GROUP BY 1, 2, 3""")
def final_masks(s):
    return FO.final_masks(grid(s), "B", REGIME_START, HOLDOUT_START, P.last_week(s), 4).groupBy("center_id", "in_retrain", "in_holdout").agg(F.count("*").alias("n"))


@query("G04", "boundary_filter", """
SELECT center_id, count(*) AS n, max(week_st) AS hi FROM gq WHERE week_st + 28 <= (SELECT max(week_st) FROM gq g WHERE g.center_id = gq.center_id) GROUP BY 1""")
def boundary_filter(s):
    return FO.boundary_filter(grid(s), 4).groupBy("center_id").agg(F.count("*").alias("n"), F.max("week_st").alias("hi"))


@query("G05", "purge_audit", f"SELECT center_id, count(*) AS train_rows, " + ", ".join(
    f"count(*) FILTER (WHERE week_st + {7 * h} >= DATE '{HOLDOUT_START}') AS crossing_h{h}, CAST(0 AS BIGINT) AS violations_h{h}" for h in HORIZONS)
    + f" FROM gq WHERE week_st < DATE '{HOLDOUT_START}' GROUP BY 1")
def purge_audit(s):
    return FO.purge_audit(grid(s), HOLDOUT_START, HORIZONS)


@query("G06", "fixed_windows", f"SELECT {_COUNTS} FROM ({_fold_sql(FIXED)}) GROUP BY 1, 2")
def fixed_windows(s):
    return _counts(folded(s, FIXED))


@query("G07", "carve_tail_validation", """
SELECT center_id, CASE WHEN week_st > (SELECT max(week_st) - 84 FROM gq g WHERE g.center_id = gq.center_id) THEN 'val' ELSE 'train' END AS part, count(*) AS n,
 CAST(sum(qty) AS BIGINT) AS qty FROM gq GROUP BY 1, 2""")
def carve_tail_validation(s):
    return FO.carve_tail(grid(s), 12).groupBy("center_id", "part").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query("E53", "workload_stats", f"""
SELECT fold, count(*) FILTER (WHERE role = 'train') AS train_rows, count(*) FILTER (WHERE role = 'val') AS val_rows FROM ({_fold_sql(FOLDS)}) GROUP BY 1""")
def workload_stats(s):
    return FO.workload(folded(s))


_BORDER = "1997-01-06"


@query("G08", "hier_median_fit_apply", f"""
WITH t AS (SELECT * FROM feat WHERE week_st < DATE '{_BORDER}'), m3 AS (SELECT cat_s, quantile_cont(adi, 0.5) AS m FROM t GROUP BY 1),
 m2 AS (SELECT cat_m, quantile_cont(adi, 0.5) AS m FROM t GROUP BY 1), m1 AS (SELECT cat_l, quantile_cont(adi, 0.5) AS m FROM t GROUP BY 1), g AS (SELECT quantile_cont(adi, 0.5) AS m FROM t)
SELECT {_K}, round(coalesce(adi, m3.m, m2.m, m1.m, g.m), 6) AS adi_imputed, CASE WHEN adi IS NOT NULL THEN 'own' WHEN m3.m IS NOT NULL THEN 'cat_s'
 WHEN m2.m IS NOT NULL THEN 'cat_m' WHEN m1.m IS NOT NULL THEN 'cat_l' ELSE 'global' END AS adi_source
FROM feat LEFT JOIN m3 USING (cat_s) LEFT JOIN m2 USING (cat_m) LEFT JOIN m1 USING (cat_l), g""")
def hier_median_fit_apply(s):
    f = stored_features(s).select(*KEY, *P.LEVELS, "adi")
    out = FO.hier_median(f.where(F.col("week_st") < F.lit(_BORDER).cast("date")), f, ["cat_s", "cat_m", "cat_l"], "adi")
    return out.select(*KEY, r6(F.col("adi_imputed")).alias("adi_imputed"), "adi_source")


@query("G09", "zscore_fit_apply", f"""
SELECT {_K}, round((qty - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 6) AS qty_z FROM (
 SELECT *, avg(qty) FILTER (WHERE week_st < DATE '{_BORDER}') OVER () AS m, stddev_pop(qty) FILTER (WHERE week_st < DATE '{_BORDER}') OVER () AS s FROM gq)""")
def zscore_fit_apply(s):
    g = grid(s)
    return FO.zscore(g.where(F.col("week_st") < F.lit(_BORDER).cast("date")), g, ["qty"]).select(*KEY, r6(F.col("qty_z")).alias("qty_z"))


_EARLY = HOLDOUT_START


@query("G10", "vocab_encode", f"""
WITH v AS (SELECT cat_s, CAST(row_number() OVER (ORDER BY cat_s) AS INT) AS id FROM (SELECT DISTINCT cat_s FROM tx WHERE week_st < DATE '{_EARLY}'))
SELECT order_no, line_no, qty, cat_s, coalesce(id, 0) AS cat_s_id FROM tx LEFT JOIN v USING (cat_s)""")
def vocab_encode(s):
    tx = s.tx().select("order_no", "line_no", "qty", "cat_s", "week_st")
    return FO.vocab_encode(tx.where(F.col("week_st") < F.lit(_EARLY).cast("date")), tx, "cat_s").drop("week_st")


@query("G11", "category_levels", f"""
WITH t AS (SELECT * FROM tx WHERE week_st < DATE '{_EARLY}'), x AS (SELECT cat_s IN (SELECT cat_s FROM t) AS s, cat_m IN (SELECT cat_m FROM t) AS m, cat_s, cat_m FROM tx)
SELECT CASE WHEN s THEN cat_s END AS cat_s_level, CASE WHEN m THEN cat_m END AS cat_m_level, count(*) AS n, count(*) FILTER (WHERE NOT s) AS unknown_s,
 count(*) FILTER (WHERE NOT m) AS unknown_m FROM x GROUP BY 1, 2""")
def category_levels(s):
    tx = s.tx().select("cat_s", "cat_m", "week_st")
    out = FO.category_levels(tx.where(F.col("week_st") < F.lit(_EARLY).cast("date")), tx, ["cat_s", "cat_m"])
    return out.groupBy("cat_s_level", "cat_m_level").agg(
        F.count("*").alias("n"), F.sum("cat_s_unknown").alias("unknown_s"), F.sum("cat_m_unknown").alias("unknown_m"))


_SLOTS = ("cat_l", "cat_m", "cat_s")


@query("G12", "one_hot", "WITH " + ", ".join(
    f"v_{c} AS (SELECT {c}, CAST(row_number() OVER (ORDER BY {c}) AS INT) AS slot FROM (SELECT DISTINCT {c} FROM tx WHERE week_st < DATE '{HOLDOUT_START}'))" for c in _SLOTS) + f"""
SELECT {', '.join(_SLOTS)}, {', '.join(f'coalesce(v_{c}.slot, 0) AS {c}_slot' for c in _SLOTS)}, count(*) AS n
FROM tx {' '.join(f'LEFT JOIN v_{c} USING ({c})' for c in _SLOTS)} WHERE week_st >= DATE '{HOLDOUT_START}' GROUP BY ALL""")
def one_hot(s):
    """Fitted on the categories before the border and applied after it; a category that training has not seen has no slot (0)."""
    from pyspark.ml.functions import vector_to_array
    tx = s.tx().select("week_st", *_SLOTS)
    border = F.lit(HOLDOUT_START).cast("date")
    later = tx.where(F.col("week_st") >= border).groupBy(*_SLOTS).agg(F.count("*").alias("n"))
    out = FO.one_hot(tx.where(F.col("week_st") < border).select(*_SLOTS).distinct(), list(_SLOTS)).transform(later)
    return out.select(*_SLOTS, *[F.array_position(vector_to_array(f"{c}_vec"), 1.0).cast("int").alias(f"{c}_slot") for c in _SLOTS], "n")


FEATURES = ["lag1", "lag2", "lag4", "roll_mean_4", "roll_std_4", "weeks_since_active", "is_warmup", "coldstart", "adi", "iso_week", "month", "quarter"]


def training_table(s):
    from stockloom.operators import series as S
    return S.horizon_targets(features(s), HORIZONS, P.last_week(s))


@query("G13", "assemble_xy", f"""
SELECT {_K}, week_st + 7 AS target_date, y AS target_h1, CAST({len(FEATURES)} AS INT) AS n_features, round({' + '.join(f'CAST({c} AS DOUBLE)' for c in FEATURES)}, 6) AS feature_sum
FROM (SELECT *, lead(qty) OVER (PARTITION BY center_id, sku_id ORDER BY week_st) AS y FROM feat) WHERE y IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)}""")
def assemble_xy(s):
    from pyspark.ml.functions import vector_to_array
    rows = training_table(s).where("target_h1 is not null")
    out = FO.assemble(rows, FEATURES)
    return out.select(*KEY, FO.target_date(1).alias("target_date"), "target_h1", F.size(vector_to_array("features")).alias("n_features"),
                      r6(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)).alias("feature_sum"))


@query("G14", "sample_weight", """
WITH r AS (SELECT count(*) FILTER (WHERE sold = 0) * 1.0 / count(*) FILTER (WHERE sold = 1) AS w FROM gq)
SELECT center_id, sold, count(*) AS n, CAST(sum(CASE WHEN center_id = 'B' THEN 2.0 ELSE 1.0 END) AS DOUBLE) AS row_weight,
 round(min(CASE WHEN sold = 1 THEN w ELSE 1.0 END), 6) AS class_weight FROM (SELECT gq.*, CAST(r.w AS DOUBLE) AS w FROM gq, r) GROUP BY 1, 2""")
def sample_weight(s):
    return FO.sample_weight(grid(s), "B", 2.0, "sold").groupBy("center_id", "sold").agg(
        F.count("*").alias("n"), r6(F.sum("row_weight")).alias("row_weight"), r6(F.min("class_weight")).alias("class_weight"))
