"""Enrichment joins on the test tables."""

from pyspark.sql import functions as F

from stockloom.operators import joins as J
from stockloom.operators import marts as M
from stockloom.plans import marts as P
from stockloom.registry import cte, query
from stockloom.sources.adapters import BASIS_DATE, BASIS_WEEK, HOLDOUT_START

TX = ["order_no", "line_no", "center_id", "tx_date", "sku_id", "qty"]
_TX = ", ".join(TX)
UNIFIED = ["center_id", "kind", "tx_date", "y", "m", "d", "zip5", "barcode", "product_name", "option_code",
           "cat_l", "cat_m", "cat_s", "qty", "amount"]


@query("D01", "unify_tx", f"""
SELECT {', '.join(UNIFIED[:3])}, CAST(year(tx_date) AS INT) AS y, CAST(month(tx_date) AS INT) AS m, CAST(day(tx_date) AS INT) AS d,
  {', '.join(UNIFIED[6:])} FROM tx""")
def unify_tx(s):
    """Six extracts (centre, kind, and for sales two periods) stacked, then described once."""
    late = "tx_date >= '2000-01-01'"
    rules = ["center_id = 'A' and kind = 'purchase'", "center_id = 'B' and kind = 'purchase'",
             f"center_id = 'A' and kind = 'sales' and not {late}", f"center_id = 'A' and kind = 'sales' and {late}",
             f"center_id = 'B' and kind = 'sales' and not {late}", f"center_id = 'B' and kind = 'sales' and {late}"]
    from stockloom.operators.profiling import union_all
    stacked = union_all([s.lines().where(r) for r in rules])
    return (s.described(stacked.join(s.zips().hint("shuffle_hash"), "order_no"))
            .selectExpr(*[c for c in UNIFIED if c not in "ymd"], "year(tx_date) as y", "month(tx_date) as m", "day(tx_date) as d"))


cte("tx_reg", f"SELECT {_TX}, kind, amount, tx.zip5, p.sido, p.sigungu FROM tx LEFT JOIN postal p ON tx.zip5 = p.zip5")


def tx_reg(s):
    return J.resolve_region(s.tx_zip().select(*TX, "kind", "amount", "zip5"), s.postal())


@query("D02", "resolve_region", "SELECT * FROM tx_reg")
def resolve_region(s):
    return tx_reg(s)


cte("tx_city", f"SELECT {_TX}, kind, amount, sido, CASE WHEN line_no % 2 = 0 THEN sigungu ELSE city END AS city FROM tx")


def tx_city(s):
    return s.tx_region().withColumn("city", F.expr("case when line_no % 2 = 0 then sigungu else city end")).select(
        *TX, "kind", "amount", "sido", "city")


@query("D03", "weather_or_join", f"""
SELECT {_TX}, t.city, temp, rain FROM tx_city t LEFT JOIN weather w ON w.sido = t.sido AND w.date = t.tx_date
 AND (w.sigungu = t.city OR w.sigungu IS NULL OR t.city LIKE concat(w.sigungu, ' %'))""")
def weather_or_join(s):
    return J.weather_or_join(tx_city(s), s.weather(), places(s)).select(*TX, "city", "temp", "rain")


cte("weather_keys", """
WITH r AS (SELECT DISTINCT sido, city FROM tx_city), l AS (SELECT DISTINCT sido, sigungu FROM weather WHERE sigungu IS NOT NULL),
 b AS (SELECT DISTINCT sido FROM weather WHERE sigungu IS NULL)
SELECT r.sido, r.city, CASE WHEN e.sigungu IS NOT NULL THEN e.sigungu WHEN b.sido IS NOT NULL THEN NULL ELSE n.sigungu END AS weather_key
FROM r LEFT JOIN l e ON e.sido = r.sido AND e.sigungu = r.city LEFT JOIN b ON b.sido = r.sido AND e.sigungu IS NULL
 LEFT JOIN l n ON n.sido = r.sido AND r.city LIKE concat(n.sigungu, ' %') AND e.sigungu IS NULL""")


@query("D04", "weather_key_resolve", "SELECT * FROM weather_keys")
def weather_key_resolve(s):
    return J.weather_key_resolve(tx_city(s), s.weather())


cte("tx_weather", f"""
SELECT {_TX}, t.kind, t.amount, t.sido, t.city, temp, rain FROM tx_city t LEFT JOIN weather_keys k ON k.sido = t.sido AND k.city = t.city
 LEFT JOIN weather w ON w.sido = t.sido AND w.sigungu IS NOT DISTINCT FROM k.weather_key AND w.date = t.tx_date""")


@query("D05", "weather_nullsafe_join", f"SELECT {_TX}, city, temp, rain FROM tx_weather")
def weather_nullsafe_join(s):
    return J.weather_nullsafe_join(tx_city(s), J.weather_key_resolve(places(s), s.weather()), s.weather(), *span(s)).select(*TX, "city", "temp", "rain")


cte("enriched", f"""
SELECT {_TX}, t.kind, t.amount, t.sido, t.city, temp, rain, holiday, covid.covid, cpi.cpi, retail_current, retail_constant,
  CAST(year(tx_date) AS INT) AS y, CAST(month(tx_date) AS INT) AS m
FROM tx_weather t LEFT JOIN holidays ON holidays.date = t.tx_date LEFT JOIN covid ON covid.date = t.tx_date
 LEFT JOIN cpi ON cpi.y = year(tx_date) AND cpi.m = month(tx_date)
 LEFT JOIN retail ON retail.sido = t.sido AND retail.y = year(tx_date) AND retail.m = month(tx_date)""")
MEASURES = ["temp", "rain", "holiday", "covid", "cpi", "retail_current", "retail_constant"]


def places(s):
    """Every (province, city) spelling, taken from orders and customers without touching the transactions."""
    named = s.orders().join(s.customers().hint("shuffle_hash"), F.expr("o_custkey = c_custkey")).select("sido", "sigungu", "priority").distinct()
    return named.select("sido", F.explode(F.array("sigungu", F.concat_ws(" ", "sigungu", "priority"))).alias("city"))


def span(s):
    """First and last day of the transactions, from a scan of one column."""
    days = s.lines()
    return days.agg(F.min("tx_date")).scalar(), days.agg(F.max("tx_date")).scalar()


def enriched(s):
    return J.star_enrich(tx_city(s), J.weather_key_resolve(places(s), s.weather()), s.weather(), s.holidays(), s.covid(), s.cpi(), s.retail(), *span(s))


@query("D06", "star_enrich", "SELECT * FROM enriched")
def star_enrich(s):
    return enriched(s)


@query("D07", "enrich_finalize", """
SELECT * REPLACE (CASE WHEN holiday IS NULL THEN 0 ELSE 1 END AS holiday, coalesce(covid, 0) AS covid) FROM enriched WHERE kind = 'sales'""")
def enrich_finalize(s):
    return J.enrich_finalize(enriched(s))


cte("catmap", """
SELECT CASE WHEN p_partkey % 7 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '0') ELSE CAST(p_partkey AS VARCHAR) END AS code,
 p_name AS name, lpad(CAST(p_partkey * 97 % 999999 AS VARCHAR), 6, '0') AS kan, p_type AS level1 FROM part WHERE p_partkey % 5 <> 0""")


@query("D08", "map_two_pass", """
WITH src AS (SELECT l_orderkey AS order_no, l_linenumber AS line_no, p_name AS name,
  CASE WHEN l_partkey % 3 = 0 THEN lpad(CAST(l_partkey AS VARCHAR), 13, '0') ELSE CAST(l_partkey AS VARCHAR) END AS code
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT order_no, line_no, src.code, src.name, coalesce(a.kan, b.kan) AS kan, coalesce(a.level1, b.level1) AS level1,
  CASE WHEN a.kan IS NOT NULL THEN 1 WHEN b.kan IS NOT NULL THEN 2 ELSE 0 END AS map_pass
FROM src LEFT JOIN catmap a ON a.code = src.code AND a.name = src.name
 LEFT JOIN catmap b ON starts_with(src.code, '0') AND b.code = ltrim(src.code, '0') AND b.name = src.name""")
def map_two_pass(s):
    part = s.table("part")
    mapping = part.where("p_partkey % 5 <> 0").selectExpr(
        "case when p_partkey % 7 = 0 then lpad(cast(p_partkey as string), 13, '0') else cast(p_partkey as string) end as code",
        "p_name as name", "lpad(cast(p_partkey * 97 % 999999 as string), 6, '0') as kan", "p_type as level1")
    src = s.table("lineitem").join(part, F.expr("l_partkey = p_partkey")).selectExpr(
        "l_orderkey as order_no", "l_linenumber as line_no", "p_name as name",
        "case when l_partkey % 3 = 0 then lpad(cast(l_partkey as string), 13, '0') else cast(l_partkey as string) end as code")
    return J.map_two_pass(src, mapping, "code", "name", ["kan", "level1"])


cte("weather_fix", """
SELECT sido, sigungu, date, CASE WHEN day(date) % 5 = 0 THEN NULL ELSE temp + 1 END AS temp, rain + 1 AS rain
FROM weather WHERE day(date) % 2 = 0""")


def weather_fix(s):
    return s.weather().where("day(date) % 2 = 0").selectExpr(
        "sido", "sigungu", "date", "case when day(date) % 5 = 0 then null else temp + 1 end as temp", "rain + 1 as rain")


PLACE = ["sido", "sigungu", "date"]


@query("D09", "override_values", """
SELECT w.sido, w.sigungu, w.date, coalesce(o.temp, w.temp) AS temp, coalesce(o.rain, w.rain) AS rain
FROM weather w LEFT JOIN weather_fix o ON o.sido = w.sido AND o.sigungu IS NOT DISTINCT FROM w.sigungu AND o.date = w.date""")
def override_values(s):
    return J.override_values(s.weather(), weather_fix(s), PLACE, ["temp", "rain"])


@query("D10", "override_misses", "SELECT * FROM weather WHERE day(date) % 10 = 0")
def override_misses(s):
    return J.override_misses(s.weather(), weather_fix(s), PLACE, "temp")


@query("D11", "semi_valid_sku", """
SELECT order_no, line_no, center_id, sku_id FROM tx SEMI JOIN pmaster USING (center_id, sku_id) WHERE kind = 'purchase'""")
def semi_valid_sku(s):
    return s.purchases().select("order_no", "line_no", *M.SKU).join(P.master(s).select(*M.SKU), M.SKU, "left_semi")


@query("D13", "self_join_future", """
SELECT a.center_id, a.sku_id, a.week_st, a.sales_qty, b.sales_qty AS qty_h4 FROM wk_sales a
LEFT JOIN wk_sales b ON b.center_id = a.center_id AND b.sku_id = a.sku_id AND b.week_st = a.week_st + 28""")
def self_join_future(s):
    return J.self_join_future(P.sales_facts(s).select(*M.SKU, "week_st", "sales_qty"), M.SKU, "week_st", "sales_qty", 28, "qty_h4")


@query("D14", "left_only_check", """
SELECT 'rows' AS "check", count(*) AS n FROM tx UNION ALL SELECT 'joined', count(*) FROM tx_reg UNION ALL
SELECT 'left_only', count(*) FROM tx WHERE zip5 NOT IN (SELECT zip5 FROM postal)""")
def left_only_check(s):
    return J.match_report(s.tx_zip().select("zip5"), s.postal(), ["zip5"])


@query("D15", "asof_backward", """
SELECT p.center_id, p.sku_id, p.week_st, s.week_st AS match_time, s.sales_qty
FROM (SELECT center_id, sku_id, week_st FROM wk_purch) p ASOF LEFT JOIN wk_sales s
 ON s.center_id = p.center_id AND s.sku_id = p.sku_id AND p.week_st >= s.week_st""")
def asof_backward(s):
    return J.asof_backward(P.purchase_facts(s), P.sales_facts(s), M.SKU, "week_st", ["sales_qty"])


@query("D16", "asof_scalar", f"""
SELECT max(week_st) FILTER (WHERE week_st <= DATE '{BASIS_DATE}') AS basis_week,
 max(week_st) FILTER (WHERE week_st <= DATE '1990-01-01') AS too_early FROM wk_sales""")
def asof_scalar(s):
    weeks = s.lines().where("kind = 'sales'")
    latest = lambda d: F.max(F.when(F.col("week_st") <= F.lit(d).cast("date"), F.col("week_st")))
    return weeks.agg(latest(BASIS_DATE).alias("basis_week"), latest("1990-01-01").alias("too_early"))


@query("D17", "one_to_one_merge", """
SELECT a.center_id, a.sku_id, product_name, first_week, total_qty FROM pmaster a JOIN
 (SELECT center_id, sku_id, min(week_st) AS first_week, CAST(sum(sales_qty) AS BIGINT) AS total_qty FROM wk_sales GROUP BY 1, 2) b
 USING (center_id, sku_id)""")
def one_to_one_merge(s):
    history = P.sales_facts(s).groupBy(*M.SKU).agg(F.min("week_st").alias("first_week"), F.sum("sales_qty").alias("total_qty"))
    return J.one_to_one_merge(P.master(s).select(*M.SKU, "product_name"), history, M.SKU)


@query("D24", "siblings", """
WITH m AS (SELECT center_id, sku_id, option_code, barcode, product_name, CASE WHEN CAST(spec AS INT) % 7 = 0 THEN NULL ELSE spec END AS spec FROM pmaster),
 one AS (SELECT * FROM m WHERE center_id = 'A' AND sku_id = (SELECT min(sku_id) FROM m))
SELECT m.* FROM m SEMI JOIN one ON m.center_id = one.center_id AND m.product_name = one.product_name AND m.barcode = one.barcode
 AND m.spec IS NOT DISTINCT FROM one.spec""")
def siblings(s):
    m = P.master(s).select(*M.SKU, "option_code", "barcode", "product_name",
                           F.expr("case when cast(spec as int) % 7 = 0 then null else spec end as spec"))
    return J.siblings(m, "A", m.agg(F.min("sku_id")).scalar(), ["product_name", "barcode"], "spec")


@query("D25", "grid_scope_zero_fill", f"""
WITH scope AS (SELECT DISTINCT cat_m, option_code FROM day_sku_grid WHERE center_id = 'A' AND grid_start <= DATE '{BASIS_DATE}'),
 f AS (SELECT cat_m, option_code, CAST(sum(sales_qty) AS BIGINT) AS sales_qty, CAST(sum(sales_amount) AS DECIMAL(18,2)) AS sales_amount
  FROM day_summary WHERE center_id = 'A' AND tx_date = DATE '{BASIS_DATE}' GROUP BY 1, 2)
SELECT cat_m, option_code, coalesce(sales_qty, 0) AS sales_qty, CAST(coalesce(sales_amount, 0) AS DECIMAL(18,2)) AS sales_amount
FROM scope LEFT JOIN f USING (cat_m, option_code)""")
def grid_scope_zero_fill(s):
    day = F.lit(BASIS_DATE).cast("date")
    scope = P.day_sku_grid(s).where((F.col("center_id") == "A") & (F.col("grid_start") <= day))
    facts = P.day_summary(s).where((F.col("center_id") == "A") & (F.col("tx_date") == day))
    return J.zero_fill_scope(scope, facts, ["cat_m", "option_code"], ["sales_qty", "sales_amount"])


@query("D26", "ref_equal", """
SELECT 'sales_qty' AS column_name, CAST(0 AS BIGINT) AS mismatches UNION ALL
SELECT 'return_qty', count(*) FILTER (WHERE return_qty > 40) FROM wk_sales UNION ALL
SELECT 'sales_amount', count(*) FILTER (WHERE sales_qty % 10 = 0) FROM wk_sales""")
def ref_equal(s):
    old = P.sales_facts(s)
    new = old.withColumn("return_qty", F.expr("case when return_qty > 40 then null else return_qty end")).withColumn(
        "sales_amount", F.expr("cast(case when sales_qty % 10 = 0 then sales_amount + 1 else sales_amount end as decimal(18,2))"))
    return J.ref_equal(new, old, [*M.SKU, "week_st"], ["sales_qty", "return_qty", "sales_amount"])


@query("D27", "cold_lookup", f"""
SELECT center_id, sku_id, cat_l, cat_m, cat_s FROM pmaster SEMI JOIN
 (SELECT center_id, sku_id FROM tx WHERE work_type = 'inbound' AND tx_date <= DATE '{HOLDOUT_START}') USING (center_id, sku_id)""")
def cold_lookup(s):
    stock = s.tx().where("work_type = 'inbound'").groupBy(*M.SKU).agg(F.min("tx_date").alias("first_stock"))
    return J.cold_lookup(s.sales(), stock, HOLDOUT_START, M.SKU, "week_st", ["cat_l", "cat_m", "cat_s"])
