"""Validation counts and data-quality queries on the test tables."""

from pyspark.sql import functions as F

from stockloom.operators import keys as K
from stockloom.operators import marts as M
from stockloom.operators import profiling
from stockloom.operators import quality as Q
from stockloom.plans import marts as P
from stockloom.plans.joining import MEASURES, enriched, tx_reg
from stockloom.registry import query


@query("E01", "stage_row_counts", """
SELECT 'lineitem' AS stage, count(*) AS n FROM lineitem UNION ALL SELECT 'transactions', count(*) FROM tx UNION ALL
SELECT 'with_region', count(*) FROM tx_reg UNION ALL SELECT 'enriched', count(*) FROM enriched""")
def stage_row_counts(s):
    return profiling.count_rows({"lineitem": s.table("lineitem"), "transactions": s.tx(), "with_region": tx_reg(s), "enriched": enriched(s)})


def _fanout_sql(name, keys):
    on = " AND ".join(f"d.{k} = b.{k}" for k in keys)
    return (f"SELECT '{name}' AS dimension, (SELECT count(*) FROM b) AS base_rows, "
            f"(SELECT count(*) FROM b LEFT JOIN {name} d ON {on}) AS joined_rows, "
            f"(SELECT count(*) FROM (SELECT 1 FROM {name} GROUP BY {', '.join(keys)} HAVING count(*) > 1)) AS duplicate_keys")


_DIMS = {"weather": ["sido", "date"], "holidays": ["date"], "covid": ["date"], "cpi": ["y", "m"], "retail": ["sido", "y", "m"]}


@query("E02", "join_fanout_counts",
       "WITH b AS (SELECT sido, tx_date AS date, CAST(year(tx_date) AS INT) AS y, CAST(month(tx_date) AS INT) AS m FROM tx) "
       + " UNION ALL ".join(_fanout_sql(n, k) for n, k in _DIMS.items()))
def join_fanout_counts(s):
    base = s.tx_region().select("sido", F.col("tx_date").alias("date"), F.year("tx_date").alias("y"), F.month("tx_date").alias("m"))
    return Q.join_fanout(base, {n: (getattr(s, n)(), k) for n, k in _DIMS.items()})


def _ratio_sql(keys, cols, table="enriched"):
    k = "".join(f"{a} AS {b}, " for b, a in keys.items())
    g = f" GROUP BY {', '.join(str(i + 1) for i in range(len(keys)))}" if keys else ""
    return " UNION ALL ".join(
        f"SELECT {k}'{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_rows, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct FROM {table}{g}" for c in cols)


@query("E03", "null_ratio", _ratio_sql({}, MEASURES))
def null_ratio(s):
    return Q.null_ratio(enriched(s), MEASURES)


@query("E04", "null_ratio_by_year", _ratio_sql({"y": "y"}, MEASURES))
def null_ratio_by_year(s):
    return Q.null_ratio(enriched(s), MEASURES, ["y"])


@query("E05", "null_ratio_by_region", _ratio_sql({"region": "coalesce(sido, 'unmatched')"}, ["qty", "sigungu"], "tx_reg"))
def null_ratio_by_region(s):
    return Q.null_ratio(tx_reg(s).withColumn("region", F.coalesce("sido", F.lit("unmatched"))), ["qty", "sigungu"], ["region"])


@query("E06", "unmatched_top", """
SELECT zip5, count(*) AS n FROM tx WHERE zip5 NOT IN (SELECT zip5 FROM postal) GROUP BY 1 ORDER BY n DESC, zip5 LIMIT 20""")
def unmatched_top(s):
    return Q.top(Q.unmatched(s.tx_zip(), s.postal(), "zip5"), "n", ["zip5"], 20)


@query("E07", "unmatched_full", """
SELECT zip5, kind, count(*) AS n FROM tx WHERE zip5 NOT IN (SELECT zip5 FROM postal) GROUP BY 1, 2""")
def unmatched_full(s):
    return Q.unmatched(s.tx_zip(), s.postal(), "zip5", ["kind"])


@query("E08", "match_rate_listed", """
SELECT sido, count(*) AS n, count(*) - count(temp) AS unmatched, round((count(*) - count(temp)) * 100.0 / count(*), 6) AS unmatched_pct
FROM enriched WHERE sido IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY 1""")
def match_rate_listed(s):
    return Q.match_rate(enriched(s), "sido", "temp", ["ASIA", "EUROPE", "AFRICA"])


@query("E09", "flag_distribution", """
SELECT CASE WHEN holiday IS NULL THEN 0 ELSE 1 END AS holiday, coalesce(covid, 0) AS covid, count(*) AS n, count(*) - count(cpi) AS cpi_missing
FROM enriched WHERE kind = 'sales' GROUP BY 1, 2""")
def flag_distribution(s):
    from stockloom.operators.joins import enrich_finalize
    return enrich_finalize(enriched(s)).groupBy("holiday", "covid").agg(
        F.count("*").alias("n"), F.count_if(F.col("cpi").isNull()).alias("cpi_missing"))


@query("E10", "names_per_barcode", """
SELECT barcode, count(DISTINCT product_name) AS names FROM tx GROUP BY 1 HAVING count(DISTINCT product_name) > 1""")
def names_per_barcode(s):
    return Q.names_per_key(s.tx(), "barcode", "product_name")


@query("E11", "distinct_ratio", """
SELECT count(*) AS total_rows, count(DISTINCT CASE WHEN sido IS NOT NULL THEN (tx_date, sku_id, sido, qty) END) AS distinct_rows,
 count(*) - count(DISTINCT CASE WHEN sido IS NOT NULL THEN (tx_date, sku_id, sido, qty) END) AS duplicate_rows FROM tx_reg""")
def distinct_ratio(s):
    return Q.distinct_ratio(tx_reg(s), ["tx_date", "sku_id", "sido", "qty"])


@query("E12", "duplicate_groups", """
SELECT center_id, sku_id, tx_date, count(*) AS n FROM tx GROUP BY 1, 2, 3 HAVING count(*) > 1
ORDER BY n DESC, center_id, sku_id, tx_date LIMIT 10""")
def duplicate_groups(s):
    return Q.top(K.duplicate_groups(s.tx(), [*M.SKU, "tx_date"]), "n", [*M.SKU, "tx_date"], 10)


@query("E13", "row_inspect", """
SELECT order_no, line_no, sku_id, tx_date, qty, amount FROM tx WHERE center_id = 'B' AND barcode = 'Brand#7' AND work_type = 'outbound' AND qty < -40""")
def row_inspect(s):
    return s.tx().where("center_id = 'B' and barcode = 'Brand#7' and work_type = 'outbound' and qty < -40").select(
        "order_no", "line_no", "sku_id", "tx_date", "qty", "amount")


@query("E14", "type_counts", "SELECT kind, work_type, count(*) AS n FROM tx GROUP BY 1, 2")
def type_counts(s):
    lines = s.lines()
    stacked = profiling.union_all([lines.where(f"kind = '{k}'").select("kind", "work_type") for k in ("purchase", "sales")])
    return stacked.groupBy("kind", "work_type").agg(F.count("*").alias("n"))


@query("E15", "negative_counts", """
SELECT kind, center_id, count(*) FILTER (WHERE qty < 0) AS negative_qty, count(*) FILTER (WHERE amount < 0) AS negative_amount
FROM tx GROUP BY 1, 2""")
def negative_counts(s):
    return s.lines().groupBy("kind", "center_id").agg(
        F.count_if(F.col("qty") < 0).alias("negative_qty"), F.count_if(F.col("amount") < 0).alias("negative_amount"))


@query("E16", "sign_crosstab", """
WITH d AS (SELECT center_id, move AS work_type, CASE WHEN amount_d > 0 THEN 'positive' WHEN amount_d < 0 THEN 'negative' ELSE 'zero' END AS amount_sign,
  CASE WHEN qty_d > 0 THEN 'positive' WHEN qty_d < 0 THEN 'negative' ELSE 'zero' END AS qty_sign FROM dirty)
SELECT center_id, work_type, amount_sign, qty_sign, count(*) AS n FROM d GROUP BY ALL""")
def sign_crosstab(s):
    from stockloom.plans.cleaning import dirty
    return Q.sign_crosstab(dirty(s).selectExpr("center_id", "move as work_type", "amount_d as amount", "qty_d as qty"))


_DIRTY_COLS = ["date_s", "zip_s", "barcode_s", "l1", "l2", "l3"]


@query("E17", "missing_by_column", " UNION ALL ".join(
    f"SELECT center_id, '{c}' AS column_name, count(*) AS total_rows, count(*) FILTER (WHERE {c} IS NULL OR trim({c}) = '') AS null_rows, "
    f"round(count(*) FILTER (WHERE {c} IS NULL OR trim({c}) = '') * 100.0 / count(*), 6) AS null_pct FROM dirty GROUP BY 1" for c in _DIRTY_COLS))
def missing_by_column(s):
    from stockloom.plans.cleaning import dirty
    return Q.null_ratio(dirty(s), _DIRTY_COLS, ["center_id"], text=True)


@query("E18", "product_master", """
SELECT barcode, product_name, cat_s, option_code, cluster_no, spec FROM (SELECT *, row_number() OVER (
  PARTITION BY barcode, product_name ORDER BY cat_s, option_code, cluster_no, spec) AS rn FROM tx) WHERE rn = 1""")
def product_master(s):
    cols = ["barcode", "product_name", "cat_s", "option_code", "cluster_no", "spec"]
    return Q.first_row(s.tx().select(cols), ["barcode", "product_name"], cols[2:])


@query("E19", "center_master", """
SELECT center_id, barcode, product_name, cat_s, option_code FROM (SELECT *, row_number() OVER (
  PARTITION BY center_id, barcode, product_name ORDER BY cat_s, option_code) AS rn FROM tx) WHERE rn = 1""")
def center_master(s):
    tx = s.tx()
    cols = ["barcode", "product_name", "cat_s", "option_code"]
    late = F.col("tx_date") >= F.lit("2000-01-01").cast("date")
    parts = {c: [tx.where((F.col("center_id") == c) & rule).select(cols) for rule in (
        F.col("kind") == "purchase", (F.col("kind") == "sales") & ~late, (F.col("kind") == "sales") & late)] for c in ("A", "B")}
    return Q.center_master(parts, ["barcode", "product_name"], ["cat_s", "option_code"])


@query("E21", "calendar_week_agg", """
SELECT CAST(date_trunc('week', date) AS DATE) AS week_st, round(avg(temp), 6) AS temp_mean, max(rain) AS rain_max,
 first(rain ORDER BY date, rain) AS rain_first FROM weather GROUP BY 1""")
def calendar_week_agg(s):
    weekly = s.weather().withColumn("week_st", F.trunc("date", "week"))
    return Q.calendar_week_agg(weekly, "week_st", ["temp"], ["rain"], ["rain"], "date")


@query("E47", "category_tree", """
SELECT cat_l, NULL AS cat_m, NULL AS cat_s, count(*) AS sku_count, 1 AS level FROM pmaster GROUP BY 1 UNION ALL
SELECT cat_l, cat_m, NULL, count(*), 2 FROM pmaster GROUP BY 1, 2 UNION ALL
SELECT cat_l, cat_m, cat_s, count(*), 3 FROM pmaster GROUP BY 1, 2, 3""")
def category_tree(s):
    return Q.category_tree(P.master(s), P.LEVELS)


@query("E55", "target_quality", """
SELECT count(*) AS n, count(*) FILTER (WHERE sales_qty < 0) AS negative_qty, count(*) FILTER (WHERE sales_amount < 0) AS negative_amount,
 CASE WHEN count(*) FILTER (WHERE sales_qty < 0 OR sales_amount < 0) = 0 THEN 1 ELSE 0 END AS gate FROM wk_sales""")
def target_quality(s):
    bad_q, bad_a = F.col("sales_qty") < 0, F.col("sales_amount") < 0
    return P.sales_facts(s).agg(
        F.count("*").alias("n"), F.count_if(bad_q).alias("negative_qty"), F.count_if(bad_a).alias("negative_amount"),
        (F.count_if(bad_q | bad_a) == 0).cast("int").alias("gate"))


@query("E56", "key_uniqueness", """
WITH k AS (SELECT order_no, line_no, count(*) AS n FROM tx GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_keys, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_sharing_key FROM k""")
def key_uniqueness(s):
    return K.key_uniqueness(s.lines(), ["order_no", "line_no"])


_MISS = ["temp", "holiday", "covid", "cpi"]


@query("E57", "missing_by_center_year", _ratio_sql({"center_id": "center_id", "y": "y"}, _MISS))
def missing_by_center_year(s):
    return Q.null_ratio(enriched(s), _MISS, ["center_id", "y"])
