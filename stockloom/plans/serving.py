"""Serving queries at fixed parameters on the test tables."""

from pyspark.sql import functions as F

from stockloom.operators import marts as M
from stockloom.operators import serving as V
from stockloom.operators.serving import Scope
from stockloom.plans import marts as P
from stockloom.plans.forecasts import preds
from stockloom.plans.forecasts import wide as wide_forecast
from stockloom.registry import query
from stockloom.sources.adapters import BASIS_DATE, BASIS_WEEK

A = Scope("A")
ECON = Scope("A", cat_l="ECONOMY")
ONE = Scope("A", sku_id="Brand#1*ECONOMY*0")
_ONE = "center_id = 'A' AND sku_id = 'Brand#1*ECONOMY*0'"
_BW, _BD = f"DATE '{BASIS_WEEK}'", f"DATE '{BASIS_DATE}'"
WEEK_END = "2000-10-08"


def master(s):
    return s.stored("product_master", lambda: P.master(s.kept()))


def weekly(s):
    """Weekly facts, counted for the inventory: demand, movements and stock are made dense from them."""
    return s.stored("weekly_facts", lambda: P.facts(s.by_week(), counted=True))


def demand(s):
    return s.stored("weekly_demand", lambda: P.demand(s, known=weekly(s)))


def moves(s):
    return s.stored("weekly_transactions", lambda: P.mart(s, known=weekly(s).drop(M.INBOUND_ROWS)))


def stock(s):
    return s.stored("weekly_inventory", lambda: P.inventory(s, known=weekly(s)))


def wide(s):
    return s.stored("weekly_forecast", lambda: wide_forecast(s))


def daily(s):
    """Daily facts, from which the sparse rows and the grid's first days are taken."""
    return s.stored("daily_facts", lambda: P.facts(s.by_day(), "day"))


def sparse(s):
    return M.sparse_activity(daily(s))


def summary(s):
    return s.stored("daily_summary", lambda: P.day_summary(s.by_day(), master(s)))


def regional(s):
    return s.stored("daily_region", lambda: P.day_region(s, master(s)))


def sku_grid(s):
    return s.stored("daily_sku_grid", lambda: M.sku_grid_start(daily(s), master(s), "tx_date", P.LEVELS))


def raw(s):
    return records(s.kept())


def records(s):
    """Single sales, without a mart of all transactions: few days are read, and these are cut out before they meet their products."""
    return s.sales().select(*M.SKU, *P.LEVELS, "option_code", "tx_date", "qty")


@query("K01", "q_products", """
SELECT m.center_id, m.sku_id, product_name, barcode, option_code, CASE WHEN EXISTS (SELECT 1 FROM wide w WHERE w.center_id = m.center_id AND w.sku_id = m.sku_id) THEN 1 ELSE 0 END AS has_forecast
FROM pmaster m WHERE center_id = 'A' AND (lower(product_name) LIKE '%re%' OR lower(barcode) LIKE '%re%')""")
def q_products(s):
    return V.products(master(s), wide(s), A, "RE")


@query("K02", "q_forecast", f"""
SELECT * FROM (SELECT week_st, 'history' AS part, CAST(net_qty AS DOUBLE) AS value FROM wk_demand WHERE {_ONE} AND week_st <= {_BW} ORDER BY week_st DESC LIMIT 12) """ + " ".join(
    f"UNION ALL SELECT h{h}_target_date, 'h{h}', h{h}_pred FROM wide WHERE {_ONE} AND week_st = {_BW} AND h{h}_pred IS NOT NULL" for h in (1, 2, 4)))
def q_forecast(s):
    return V.forecast_view(demand(s), wide(s), ONE, BASIS_WEEK, 12)


_ECON = "SEMI JOIN (SELECT center_id, sku_id FROM pmaster WHERE center_id = 'A' AND cat_l = 'ECONOMY') USING (center_id, sku_id)"


@query("K03", "q_demand_trend", f"""
SELECT week_st, CAST(sum(sales_qty) AS DOUBLE) AS value, 'actual' AS part FROM wk_demand {_ECON} WHERE week_st <= {_BW} AND week_st > {_BW} - 84 GROUP BY 1 """ + " ".join(
    f"UNION ALL SELECT week_st + {7 * h}, sum(h{h}_pred), 'h{h}' FROM wide {_ECON} WHERE week_st = {_BW} GROUP BY 1" for h in (1, 2, 4)))
def q_demand_trend(s):
    return V.demand_trend(demand(s), wide(s), master(s), ECON, BASIS_WEEK, 84)


@query("K04", "q_summary", f"""
WITH r AS (SELECT d.*, option_code FROM wk_demand d JOIN pmaster USING (center_id, sku_id) WHERE d.center_id = 'A'), n AS (SELECT * FROM r WHERE week_st = {_BW}),
 t AS (SELECT CAST(sum(sales_amount) AS DECIMAL(18,2)) AS total_sales_amount, CAST(sum(return_amount) AS DECIMAL(18,2)) AS return_amount, CAST(sum(net_sales_amount) AS DECIMAL(18,2)) AS net_sales_amount,
  count(*) FILTER (WHERE sales_qty > 0) AS active_sku_count FROM n), p AS (SELECT sum(sales_amount) AS p FROM r WHERE week_st = {_BW} - 7)
SELECT t.*, round(CAST(return_amount AS DOUBLE) / nullif(CAST(total_sales_amount AS DOUBLE), 0), 6) AS return_rate, round(CAST(total_sales_amount - p AS DOUBLE) / CAST(p AS DOUBLE) * 100, 6) AS change_pct,
 (SELECT string_agg(concat(option_code, '=', CAST(q AS VARCHAR)), ';' ORDER BY concat(option_code, '=', CAST(q AS VARCHAR))) FROM (SELECT option_code, sum(sales_qty) AS q FROM n GROUP BY 1)) AS sales_qty_by_unit,
 (SELECT string_agg(concat(option_code, '=', CAST(q AS VARCHAR)), ';' ORDER BY concat(option_code, '=', CAST(q AS VARCHAR))) FROM (SELECT option_code, sum(return_qty) AS q FROM n GROUP BY 1)) AS return_qty_by_unit,
 (SELECT coalesce(string_agg(concat(CAST(week_st AS VARCHAR), '=', CAST(sa AS VARCHAR), '|', CAST(ra AS VARCHAR), '|', CAST(na AS VARCHAR)), ';' ORDER BY week_st), '') FROM (
  SELECT week_st, CAST(sum(sales_amount) AS DECIMAL(18,2)) AS sa, CAST(sum(return_amount) AS DECIMAL(18,2)) AS ra, CAST(sum(net_sales_amount) AS DECIMAL(18,2)) AS na FROM r
  WHERE week_st <= {_BW} GROUP BY 1 ORDER BY 1 DESC LIMIT 12)) AS sparkline FROM t, p""")
def q_summary(s):
    """The maps and the sparkline are written out as text."""
    units = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";")
    amounts = lambda p: F.concat_ws("|", *[p[c].cast("string") for c in ("sales_amount", "return_amount", "net_sales_amount")])
    line = F.array_join(F.transform("sparkline", lambda p: F.concat(p["week_st"].cast("string"), F.lit("="), amounts(p))), ";")
    out = V.summary(demand(s), master(s), A, BASIS_WEEK)
    return out.withColumns({"sales_qty_by_unit": units("sales_qty_by_unit"), "return_qty_by_unit": units("return_qty_by_unit"), "sparkline": line})


@query("K04", "q_summary_sparkline", f"""
SELECT week_st, CAST(sum(sales_amount) AS DECIMAL(18,2)) AS sales_amount, CAST(sum(return_amount) AS DECIMAL(18,2)) AS return_amount, CAST(sum(net_sales_amount) AS DECIMAL(18,2)) AS net_sales_amount
FROM wk_demand {_ECON} WHERE week_st <= {_BW} AND week_st > {_BW} - 84 GROUP BY 1""")
def q_summary_sparkline(s):
    return V.sparkline(demand(s), master(s), ECON, BASIS_WEEK, 12)


@query("K05", "q_inventory", f"""
SELECT m.center_id, m.sku_id, m.week_st, inbound_qty, outbound_qty, sales_qty, return_qty, inventory_return_excluded AS estimated_inventory, opening_inventory, inventory_available
FROM wk_mart m JOIN wk_inv i USING (center_id, sku_id, week_st) WHERE m.{_ONE} AND m.week_st <= {_BW} ORDER BY m.week_st DESC LIMIT 12""")
def q_inventory(s):
    return V.inventory_view(moves(s), stock(s), ONE, BASIS_WEEK, 12)


@query("K06", "q_transactions", f"SELECT week_st, inbound_qty, outbound_qty, sales_qty, return_qty, sales_amount FROM wk_mart WHERE {_ONE} AND week_st <= {_BW} ORDER BY week_st DESC LIMIT 8")
def q_transactions(s):
    return V.last_periods(ONE.filter(moves(s)), "week_st", BASIS_WEEK, 8, ["week_st", "inbound_qty", "outbound_qty", "sales_qty", "return_qty", "sales_amount"])


@query("K07", "q_forecast_products", f"""
SELECT center_id, sku_id, product_name, option_code, round(h1_pred, 6) AS h1_pred, round(h2_pred, 6) AS h2_pred, round(h4_pred, 6) AS h4_pred
FROM wide JOIN pmaster USING (center_id, sku_id) WHERE week_st = {_BW} AND center_id = 'A' ORDER BY wide.h1_pred DESC NULLS LAST, center_id, sku_id LIMIT 20""")
def q_forecast_products(s):
    return V.forecast_products(wide(s), master(s), A, BASIS_WEEK, 20)


def _share(inner):
    return f"SELECT *, coalesce(round(CAST(sales_amount AS DOUBLE) / nullif(CAST(sum(sales_amount) OVER () AS DOUBLE), 0), 6), 0) AS share FROM ({inner})"


_AMT = "CAST(sum(sales_amount) AS DECIMAL(18,2)) AS sales_amount"


@query("K08", "q_category_sales", _share(f"SELECT cat_m AS category, {_AMT} FROM wk_demand JOIN pmaster USING (center_id, sku_id) WHERE center_id = 'A' AND cat_l = 'ECONOMY' AND week_st = {_BW} GROUP BY 1"))
def q_category_sales(s):
    return V.category_sales(demand(s), master(s), ECON, BASIS_WEEK)


@query("K09", "q_region_sales", _share(f"SELECT sido, sigungu, {_AMT} FROM day_region WHERE center_id = 'A' AND tx_date BETWEEN {_BW} AND DATE '{WEEK_END}' GROUP BY 1, 2"))
def q_region_sales(s):
    return V.region_sales(regional(s), master(s), A, BASIS_WEEK, WEEK_END)


@query("K09", "q_region_sales_category", _share(f"SELECT sido, sigungu, {_AMT} FROM day_region {_ECON} WHERE tx_date BETWEEN {_BW} AND DATE '{WEEK_END}' GROUP BY 1, 2"))
def q_region_sales_category(s):
    return V.region_sales(regional(s), master(s), ECON, BASIS_WEEK, WEEK_END)


@query("K09", "q_region_products", f"SELECT sku_id, product_name, option_code, {_AMT} FROM day_region WHERE center_id = 'A' AND sido = 'ASIA' AND sigungu = 'NATION_2' AND tx_date BETWEEN {_BW} AND DATE '{WEEK_END}' GROUP BY 1, 2, 3 ORDER BY sales_amount DESC, sku_id, product_name, option_code LIMIT 10")
def q_region_products(s):
    return V.region_products(regional(s), master(s), A, "ASIA", "NATION_2", BASIS_WEEK, WEEK_END, 10)


@query("K10", "q_inventory_shortage", f"""
SELECT center_id, sku_id, product_name, option_code, inventory_return_excluded, round(h1_pred, 6) AS h1_pred, round(greatest(h1_pred - inventory_return_excluded, 0), 6) AS shortage_qty,
 round(inventory_return_excluded / nullif(h1_pred, 0), 6) AS fulfillment_rate, eligible_count, round(short * 1.0 / eligible_count, 6) AS shortage_rate
FROM (SELECT *, count(*) OVER () AS eligible_count, count(*) FILTER (WHERE inventory_return_excluded < h1_pred) OVER () AS short FROM wk_inv JOIN wide USING (center_id, sku_id, week_st) JOIN pmaster USING (center_id, sku_id)
 WHERE week_st = {_BW} AND center_id = 'A' AND inventory_available = 1 AND h1_pred IS NOT NULL) WHERE inventory_return_excluded < h1_pred""")
def q_inventory_shortage(s):
    return V.inventory_shortage(stock(s), wide(s), master(s), A, BASIS_WEEK)


def _surge_sql(table, time, basis, extra=""):
    return f"""SELECT center_id, sku_id, current_qty, prev_qty, current_qty - prev_qty AS increase_qty, round((current_qty - prev_qty) * 100.0 / nullif(prev_qty, 0), 6) AS increase_pct, product_name, option_code
FROM (SELECT center_id, sku_id, CAST(coalesce(sum(CASE WHEN {time} = {basis} THEN sales_qty END), 0) AS BIGINT) AS current_qty, CAST(coalesce(sum(CASE WHEN {time} < {basis} THEN sales_qty END), 0) AS BIGINT) AS prev_qty
 FROM {table} WHERE center_id = 'A' AND {time} IN ({basis}, {basis} - 7) GROUP BY 1, 2) JOIN pmaster USING (center_id, sku_id) WHERE current_qty > prev_qty {extra}"""


@query("K11", "q_sales_surge", _surge_sql("wk_demand", "week_st", _BW))
def q_sales_surge(s):
    return V.sales_surge(demand(s), master(s), A, BASIS_WEEK)


@query("K12", "q_returns", f"SELECT center_id, sku_id, product_name, option_code, return_qty, return_amount FROM wk_demand JOIN pmaster USING (center_id, sku_id) WHERE center_id = 'A' AND week_st = {_BW} AND return_amount > 0")
def q_returns(s):
    return V.returns(demand(s), master(s), A, BASIS_WEEK)


def _daily_sql(facts, records, grid="TRUE", active="sum(active_sku_count)"):
    return f"""
WITH d AS (SELECT CAST(unnest(generate_series(CAST(greatest({_BD} - 29, (SELECT min(grid_start) FROM day_sku_grid WHERE {grid})) AS TIMESTAMP), CAST({_BD} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS tx_date),
 a AS (SELECT tx_date, sum(sales_amount) AS sa, sum(return_amount) AS ra, sum(net_sales_amount) AS na, sum(sales_qty) AS sq, sum(return_qty) AS rq, {active} AS ac FROM {facts} GROUP BY 1),
 r AS (SELECT tx_date, count(*) AS n FROM tx WHERE kind = 'sales' AND qty > 0 AND {records} GROUP BY 1)
SELECT tx_date, CAST(coalesce(sa, 0) AS DECIMAL(18,2)) AS sales_amount, CAST(coalesce(ra, 0) AS DECIMAL(18,2)) AS return_amount, CAST(coalesce(na, 0) AS DECIMAL(18,2)) AS net_sales_amount,
 CAST(coalesce(sq, 0) AS BIGINT) AS sales_qty, CAST(coalesce(rq, 0) AS BIGINT) AS return_qty, CAST(coalesce(ac, 0) AS BIGINT) AS active_sku_count, coalesce(n, 0) AS sales_record_count,
 round(CAST(ra AS DOUBLE) / nullif(CAST(sa AS DOUBLE), 0), 6) AS return_rate FROM d LEFT JOIN a USING (tx_date) LEFT JOIN r USING (tx_date)"""


def _daily(s, scope):
    return V.daily_summary(summary(s), sparse(s), sku_grid(s), records(s), scope, BASIS_DATE, 30)


@query("K13", "q_daily_summary", _daily_sql("day_summary", "TRUE"))
def q_daily_summary(s):
    return _daily(s, Scope())


_IN_ECON = "center_id = 'A' AND cat_l = 'ECONOMY'"


def _head_sql(lines, grid):
    return f"""SELECT l.*, (SELECT max(week_st) FROM wide WHERE week_st <= {_BD}) AS forecast_basis_week,
 (SELECT string_agg(option_code || '=' || CAST(q AS VARCHAR), ';' ORDER BY option_code || '=' || CAST(q AS VARCHAR)) FROM (
  SELECT option_code, CAST(coalesce(sum(sales_qty), 0) AS BIGINT) AS q FROM day_sku_grid g LEFT JOIN (SELECT * FROM day_sparse WHERE tx_date = {_BD}) s USING (center_id, sku_id) WHERE grid_start <= {_BD} AND {grid} GROUP BY 1)) AS sales_qty_by_unit
FROM ({lines}) l WHERE tx_date = {_BD}"""


@query("K13", "q_daily_summary_head", _head_sql(_daily_sql("day_summary", "TRUE"), "TRUE"))
def q_daily_summary_head(s):
    return V.daily_head(_daily(s, Scope()), sparse(s), sku_grid(s), wide(s), Scope(), BASIS_DATE)


@query("K13", "q_daily_summary_category", _daily_sql(f"(SELECT * FROM day_summary WHERE {_IN_ECON})", _IN_ECON, _IN_ECON))
def q_daily_summary_category(s):
    return _daily(s, ECON)


@query("K13", "q_daily_summary_head_category", _head_sql(_daily_sql(f"(SELECT * FROM day_summary WHERE {_IN_ECON})", _IN_ECON, _IN_ECON), "g.center_id = 'A' AND g.cat_l = 'ECONOMY'"))
def q_daily_summary_head_category(s):
    return V.daily_head(_daily(s, ECON), sparse(s), sku_grid(s), wide(s), ECON, BASIS_DATE)


@query("K13", "q_daily_summary_sku", _daily_sql(f"(SELECT *, sales_amount - return_amount AS net_sales_amount FROM day_sparse WHERE {_ONE})", _ONE, _ONE, "count(*) FILTER (WHERE sales_qty > 0)"))
def q_daily_summary_sku(s):
    return _daily(s, ONE)


@query("K14", "q_daily_category_sales", _share(f"""
SELECT e.cat_m AS category, CAST(coalesce(sum(sales_amount), 0) AS DECIMAL(18,2)) AS sales_amount FROM (SELECT DISTINCT cat_m FROM day_sku_grid WHERE center_id = 'A' AND cat_l = 'ECONOMY' AND grid_start <= {_BD}) e
LEFT JOIN (SELECT * FROM day_summary WHERE center_id = 'A' AND tx_date = {_BD}) d ON d.cat_m = e.cat_m GROUP BY 1"""))
def q_daily_category_sales(s):
    return V.daily_category_sales(summary(s), sku_grid(s), ECON, BASIS_DATE)


@query("K14", "q_daily_product_ranking", _share(f"""
SELECT center_id, sku_id, product_name, m.option_code, sales_amount FROM day_sparse JOIN pmaster m USING (center_id, sku_id) WHERE center_id = 'A' AND cat_l = 'ECONOMY' AND tx_date = {_BD} AND sales_amount > 0"""))
def q_daily_product_ranking(s):
    return V.product_ranking(sparse(s), master(s), ECON, BASIS_DATE, "tx_date")


@query("K15", "q_daily_region_sales", _share(f"SELECT sido, sigungu, {_AMT} FROM day_region WHERE center_id = 'A' AND tx_date = {_BD} GROUP BY 1, 2"))
def q_daily_region_sales(s):
    return V.region_sales(regional(s), master(s), A, BASIS_DATE, BASIS_DATE)


@query("K16", "q_daily_product_activity", f"""
SELECT center_id, sku_id, product_name, sales_qty, return_qty, sales_amount, inbound_qty, coalesce(n, 0) AS record_count FROM day_sparse JOIN pmaster USING (center_id, sku_id)
LEFT JOIN (SELECT center_id, sku_id, count(*) AS n FROM tx WHERE kind = 'sales' AND qty > 0 AND tx_date = {_BD} GROUP BY 1, 2) USING (center_id, sku_id) WHERE center_id = 'A' AND tx_date = {_BD}""")
def q_daily_product_activity(s):
    return V.product_activity(sparse(s), records(s), master(s), A, BASIS_DATE)


@query("K17", "q_daily_returns", f"SELECT center_id, sku_id, product_name, option_code, return_qty, return_amount FROM day_sales JOIN pmaster USING (center_id, sku_id) WHERE tx_date = {_BD} AND return_amount > 0")
def q_daily_returns(s):
    return V.returns(sparse(s), master(s), Scope(), BASIS_DATE, "tx_date")


@query("K18", "q_daily_sales_surge", _surge_sql("day_sparse", "tx_date", _BD))
def q_daily_sales_surge(s):
    return V.sales_surge(sparse(s), master(s), A, BASIS_DATE, "tx_date")


@query("K19", "q_daily_transactions", f"SELECT center_id, sku_id, tx_date, inbound_qty, outbound_qty, sales_qty, return_qty FROM day_mart WHERE {_ONE} AND tx_date <= {_BD} AND tx_date > {_BD} - 30")
def q_daily_transactions(s):
    return V.daily_transactions(sparse(s), sku_grid(s), ONE, BASIS_DATE, 30)


@query("K20", "q_daily_inventory", f"SELECT center_id, sku_id, tx_date, opening_inventory, inventory_return_excluded, inventory_return_included, inventory_available FROM day_inv WHERE {_ONE} AND tx_date <= {_BD} AND tx_date > {_BD} - 30")
def q_daily_inventory(s):
    """The SKU filter goes below the grid, so only one series is made dense."""
    mart = M.dense_mart(ONE.filter(sparse(s)), "tx_date", 1, P.grid_end(s, "day"))
    bought = stock(s).where("inventory_available = 1")
    inv = M.inventory(mart, bought, "tx_date")
    return inv.where((F.col("tx_date") <= V.day(BASIS_DATE)) & (F.col("tx_date") > F.date_sub(V.day(BASIS_DATE), 30)))


@query("K21", "q_surge_pct", _surge_sql("wk_demand", "week_st", _BW, "AND current_qty >= 5 AND prev_qty > 0"))
def q_surge_pct(s):
    return V.sales_surge(demand(s), master(s), A, BASIS_WEEK).where("current_qty >= 5 and increase_pct is not null")


@query("K22", "q_returns_top_unit", f"""
WITH r AS (SELECT center_id, sku_id, product_name, option_code, return_qty, return_amount FROM wk_demand JOIN pmaster USING (center_id, sku_id) WHERE week_st = {_BW} AND return_amount > 0)
SELECT * FROM r WHERE option_code = (SELECT option_code FROM r GROUP BY 1 ORDER BY sum(return_qty) DESC, option_code LIMIT 1)""")
def q_returns_top_unit(s):
    rows = V.returns(demand(s), master(s), Scope(), BASIS_WEEK)
    lead = rows.groupBy("option_code").agg(F.sum("return_qty").alias("q")).orderBy(F.desc("q"), "option_code").limit(1).select("option_code")
    return rows.join(lead, "option_code", "left_semi")


_PICK = f"""
SELECT m.center_id, m.sku_id, product_name, option_code, CASE WHEN coalesce(h1_pred, h2_pred, h4_pred) IS NULL THEN 0 ELSE 1 END AS has_forecast, round(h1_pred, 6) AS h1_pred, sales_qty, sales_amount
FROM pmaster m LEFT JOIN (SELECT * FROM wide WHERE week_st = {_BW}) w ON w.center_id = m.center_id AND w.sku_id = m.sku_id
LEFT JOIN (SELECT center_id, sku_id, sales_qty, sales_amount FROM wk_demand WHERE week_st = {_BW}) d ON d.center_id = m.center_id AND d.sku_id = m.sku_id
WHERE m.center_id = 'A' AND (lower(product_name) LIKE '%e%' OR lower(barcode) LIKE '%e%')"""


@query("K25", "q_product_picker", _PICK)
def q_product_picker(s):
    return V.product_picker(master(s), wide(s), demand(s), BASIS_WEEK, A, "e")


@query("K25", "q_product_picker_available", f"{_PICK} AND coalesce(h1_pred, h2_pred, h4_pred) IS NOT NULL")
def q_product_picker_available(s):
    return V.product_picker(master(s), wide(s), demand(s), BASIS_WEEK, A, "e", "amount", "available")


@query("K26", "q_kpi_lists", f"""
WITH r AS (SELECT center_id, sku_id, count(*) AS n FROM tx WHERE kind = 'sales' AND qty > 0 AND tx_date BETWEEN {_BW} AND {_BW} + 6 GROUP BY 1, 2),
 b AS (SELECT * FROM wk_demand JOIN pmaster USING (center_id, sku_id) LEFT JOIN r USING (center_id, sku_id) WHERE center_id = 'A' AND week_st = {_BW}),
 l AS (SELECT center_id, sku_id, product_name, 'sales' AS figure, CAST(sales_amount AS DOUBLE) AS value FROM b UNION ALL SELECT center_id, sku_id, product_name, 'records', CAST(n AS DOUBLE) FROM b
  UNION ALL SELECT center_id, sku_id, product_name, 'skus', CAST(sales_qty AS DOUBLE) FROM b)
SELECT center_id, sku_id, product_name, figure, round(value, 6) AS value, round(value / max(value) OVER (PARTITION BY figure), 6) AS bar FROM l WHERE value > 0""")
def q_kpi_lists(s):
    return V.kpi_list(demand(s), records(s), master(s), A, BASIS_WEEK)
