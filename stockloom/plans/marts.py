"""Weekly and daily marts on the test tables."""

from pyspark.sql import functions as F

from stockloom.operators import marts as M
from stockloom.registry import cte, query
from stockloom.sources.adapters import REGIME_START

ATTRIBUTES = ["barcode", "option_code", "cluster_no", "product_name", "spec", "cat_l", "cat_m", "cat_s"]
LEVELS = ["cat_l", "cat_m", "cat_s"]
TIMES = {"wk": ("week_st", 7), "day": ("tx_date", 1)}
PKEY = ["center_id", "barcode", "option_code"]


# -- Spark side ------------------------------------------------------------
def master(s):
    return M.product_master(s.sold(), "week_st", ATTRIBUTES)


def sales_facts(s, grain="wk"):
    return M.sales_facts(s.sales(), TIMES[grain][0])


def purchases(s, grain="wk"):
    return M.resolved_purchases(s.purchases(), s.sold(), TIMES[grain][0])


def purchase_facts(s, grain="wk", counted=False):
    return M.purchase_facts(purchases(s, grain), TIMES[grain][0], counted)


def facts(s, grain="wk", counted=False):
    return M.merge_facts(sales_facts(s, grain), purchase_facts(s, grain, counted), TIMES[grain][0])


def last_week(s):
    return M.last_period(s.lines(), "week_st")


def grid_end(s, grain="wk"):
    return last_week(s) if grain == "wk" else F.date_add(last_week(s), 6)


# ``known``: the facts (for the inventory counted), where they are at hand
def mart(s, grain="wk", known=None):
    time, days = TIMES[grain]
    return M.dense_mart(facts(s, grain) if known is None else known, time, days, grid_end(s, grain))


def demand(s, grain="wk", known=None):
    time, days = TIMES[grain]
    dense = M.densify(
        sales_only(s, grain, known), M.SKU, time, days, grid_end(s, grain), {c: M.zero(c) for c in M.SALES})
    return M.demand_mart(dense, time, "B", REGIME_START)


def sales_only(s, grain="wk", known=None):
    """Sales facts plus an empty row where the SKU was bought before it was first sold."""
    time = TIMES[grain][0]
    return (facts(s, grain) if known is None else known).select(*M.SKU, time, *M.SALES)


def inventory(s, grain="wk", known=None):
    return M.inventory(mart(s, grain, facts(s, grain, counted=True) if known is None else known), None, TIMES[grain][0])


# -- check side ------------------------------------------------------------
_first = ", ".join(f"first({c} ORDER BY week_st, {c}) AS {c}" for c in ATTRIBUTES)
cte("pmaster", f"SELECT center_id, sku_id, {_first} FROM tx WHERE kind = 'sales' GROUP BY 1, 2")

cte("purch_resolved", """
WITH s AS (SELECT * FROM tx WHERE kind = 'sales'),
 amb AS (SELECT center_id, barcode, option_code FROM s GROUP BY 1, 2, 3 HAVING count(DISTINCT cluster_no) > 1),
 nm AS (SELECT center_id, barcode, option_code, product_name, min(cluster_no) AS c FROM s GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT cluster_no) = 1),
 sp AS (SELECT center_id, barcode, option_code, spec, min(cluster_no) AS c FROM s GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT cluster_no) = 1),
 per AS (SELECT center_id, barcode, option_code, cluster_no, min(week_st) AS lo, max(week_st) AS hi FROM s GROUP BY 1, 2, 3, 4),
 clash AS (SELECT DISTINCT center_id, barcode, option_code FROM (SELECT *, lag(hi) OVER (PARTITION BY center_id, barcode, option_code ORDER BY lo, cluster_no) AS ph FROM per) WHERE ph >= lo),
 free AS (SELECT per.* FROM per ANTI JOIN clash USING (center_id, barcode, option_code)),
 p AS (SELECT * FROM tx WHERE kind = 'purchase'),
 wks AS (SELECT DISTINCT center_id, barcode, option_code, week_st FROM p),
 dt AS (SELECT w.center_id, w.barcode, w.option_code, w.week_st, min(f.cluster_no) AS c FROM wks w JOIN free f USING (center_id, barcode, option_code)
   WHERE w.week_st BETWEEN f.lo AND f.hi GROUP BY 1, 2, 3, 4 HAVING count(*) = 1)
SELECT p.* EXCLUDE (sku_id), CASE WHEN amb.barcode IS NULL THEN 'own' WHEN nm.c IS NOT NULL THEN 'name' WHEN sp.c IS NOT NULL THEN 'spec'
    WHEN dt.c IS NOT NULL THEN 'date' ELSE 'none' END AS rule,
  CASE WHEN amb.barcode IS NULL THEN p.cluster_no ELSE coalesce(nm.c, sp.c, dt.c) END AS resolved_cluster,
  concat(p.barcode, '*', p.option_code, '*', CAST(CASE WHEN amb.barcode IS NULL THEN p.cluster_no ELSE coalesce(nm.c, sp.c, dt.c) END AS VARCHAR)) AS sku_id
FROM p LEFT JOIN amb USING (center_id, barcode, option_code)
 LEFT JOIN nm USING (center_id, barcode, option_code, product_name)
 LEFT JOIN sp USING (center_id, barcode, option_code, spec)
 LEFT JOIN dt USING (center_id, barcode, option_code, week_st)""")
cte("purch_known", """
SELECT * FROM purch_resolved SEMI JOIN pmaster USING (center_id, sku_id) WHERE resolved_cluster IS NOT NULL""")

for _g, (_t, _d) in TIMES.items():
    cte(f"{_g}_sales", f"""
SELECT center_id, sku_id, {_t}, CAST(sum(CASE WHEN qty > 0 THEN qty ELSE 0 END) AS BIGINT) AS sales_qty,
 CAST(sum(CASE WHEN qty < 0 THEN -qty ELSE 0 END) AS BIGINT) AS return_qty,
 CAST(sum(CASE WHEN qty > 0 THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS sales_amount,
 CAST(sum(CASE WHEN qty < 0 THEN -amount ELSE 0 END) AS DECIMAL(18,2)) AS return_amount
FROM tx WHERE kind = 'sales' GROUP BY 1, 2, 3""")
    _side = lambda w: (f"CAST(sum(CASE WHEN work_type = '{w}' THEN qty ELSE 0 END) AS BIGINT) AS {w}_qty, "
                       f"CAST(sum(CASE WHEN work_type = '{w}' THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS {w}_amount, "
                       f"CAST(sum(CASE WHEN work_type = '{w}' THEN vat ELSE 0 END) AS DECIMAL(18,4)) AS {w}_vat, "
                       f"CAST(sum(CASE WHEN work_type = '{w}' THEN amount + vat ELSE 0 END) AS DECIMAL(18,4)) AS {w}_total_amount")
    cte(f"{_g}_purch", f"SELECT center_id, sku_id, {_t}, {_side('inbound')}, {_side('outbound')} FROM purch_known GROUP BY 1, 2, 3")
    _end = "max(week_st)" if _g == "wk" else "max(week_st) + 6"
    _fill = ", ".join(f"CAST(coalesce({c}, 0) AS {M._TYPES[c].upper()}) AS {c}" for c in (*M.PURCHASES, *M.SALES))
    cte(f"{_g}_start", f"""
SELECT center_id, sku_id, min({_t}) AS grid_start FROM (SELECT center_id, sku_id, {_t} FROM {_g}_sales UNION ALL
 SELECT center_id, sku_id, {_t} FROM {_g}_purch) GROUP BY 1, 2""")
    cte(f"{_g}_grid", f"""
SELECT center_id, sku_id, CAST(unnest(generate_series(CAST(grid_start AS TIMESTAMP),
  (SELECT CAST({_end} AS TIMESTAMP) FROM tx), INTERVAL {_d} DAY)) AS DATE) AS {_t} FROM {_g}_start""")
    cte(f"{_g}_mart", f"""
SELECT center_id, sku_id, {_t}, {_fill} FROM {_g}_grid LEFT JOIN {_g}_purch USING (center_id, sku_id, {_t})
LEFT JOIN {_g}_sales USING (center_id, sku_id, {_t})""")
    cte(f"{_g}_demand", f"""
SELECT center_id, sku_id, {_t}, sales_qty, return_qty, sales_qty - return_qty AS net_qty, sales_amount, return_amount,
 CAST(sales_amount - return_amount AS DECIMAL(18,2)) AS net_sales_amount,
 CASE WHEN center_id = 'B' THEN CASE WHEN {_t} >= DATE '{REGIME_START}' THEN 'post' ELSE 'pre' END END AS regime
FROM {_g}_mart""")
    cte(f"{_g}_inv", f"""
WITH c AS (SELECT *, CAST(sum(inbound_qty + outbound_qty - sales_qty) OVER w AS BIGINT) AS cum, CAST(sum(return_qty) OVER w AS BIGINT) AS ret
  FROM {_g}_mart WINDOW w AS (PARTITION BY center_id, sku_id ORDER BY {_t})),
 o AS (SELECT center_id, sku_id, greatest(-min(cum), 0) AS opn FROM c GROUP BY 1, 2),
 b AS (SELECT DISTINCT center_id, sku_id, 1 AS has FROM purch_known WHERE work_type = 'inbound')
SELECT center_id, sku_id, {_t}, CASE WHEN has = 1 THEN opn END AS opening_inventory,
 CASE WHEN has = 1 THEN opn + cum END AS inventory_return_excluded,
 CASE WHEN has = 1 THEN opn + cum + ret END AS inventory_return_included, coalesce(has, 0) AS inventory_available
FROM c JOIN o USING (center_id, sku_id) LEFT JOIN b USING (center_id, sku_id)""")


# -- registered ------------------------------------------------------------
@query("D23", "resolve_cluster", """
SELECT rule, center_id, count(*) AS n, CAST(sum(resolved_cluster) AS BIGINT) AS cluster_sum FROM purch_resolved GROUP BY 1, 2""")
def resolve_cluster(s):
    """Purchases are counted by what the rules read, so a product that holds most of them is looked up once per name, specification and week."""
    kinds = s.purchases().groupBy(*PKEY, "product_name", "spec", "cluster_no", "week_st").agg(F.count("*").alias("rows"))
    found = M.resolve_cluster(kinds, M.cluster_profile(s.sold(), PKEY), PKEY)
    return found.groupBy("rule", "center_id").agg(F.sum("rows").alias("n"), F.sum(F.col("resolved_cluster") * F.col("rows")).alias("cluster_sum"))


@query("D12", "in_out_full_outer", "SELECT * FROM wk_purch")
def in_out_full_outer(s):
    return purchase_facts(s).select(*M.SKU, "week_st", *M.PURCHASES)


@query("E20", "latest_master", "SELECT * FROM pmaster")
def latest_master(s):
    return master(s)


@query("E22", "region_to_sku", """
SELECT center_id, sku_id, week_st, CAST(sum(q) AS BIGINT) AS sales_qty, CAST(sum(r) AS BIGINT) AS return_qty FROM (
 SELECT center_id, sku_id, week_st, sido, sum(CASE WHEN qty > 0 THEN qty ELSE 0 END) AS q, sum(CASE WHEN qty < 0 THEN -qty ELSE 0 END) AS r
 FROM tx WHERE kind = 'sales' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def region_to_sku(s):
    regional = M.sign_split(s.tx_region().where("kind = 'sales'")).groupBy(*M.SKU, "week_st", "sido").agg(
        M.total("sales_qty"), M.total("return_qty"))
    return regional.groupBy(*M.SKU, "week_st").agg(M.total("sales_qty"), M.total("return_qty"))


@query("E23", "first_stock", """
SELECT center_id, sku_id, min(tx_date) AS first_stock FROM tx WHERE work_type = 'inbound' GROUP BY 1, 2""")
def first_stock(s):
    return s.tx().where("work_type = 'inbound'").groupBy(*M.SKU).agg(F.min("tx_date").alias("first_stock"))


@query("E24", "weekly_sales", "SELECT * FROM wk_sales")
def weekly_sales(s):
    return sales_facts(s)


@query("E25", "weekly_purchases", "SELECT * FROM wk_purch WHERE inbound_qty <> 0 OR outbound_qty <> 0")
def weekly_purchases(s):
    return purchase_facts(s).where("inbound_qty <> 0 or outbound_qty <> 0")


@query("E26", "daily_sales", "SELECT * FROM day_sales")
def daily_sales(s):
    return sales_facts(s, "day")


@query("E27", "daily_purchases", "SELECT * FROM day_purch")
def daily_purchases(s):
    return purchase_facts(s, "day")


_ACTIVE = "(sales_qty <> 0 OR return_qty <> 0 OR sales_amount <> 0 OR return_amount <> 0)"
cte("day_summary", f"""
SELECT center_id, tx_date, cat_l, cat_m, cat_s, option_code, CAST(sum(sales_qty) AS BIGINT) AS sales_qty,
 CAST(sum(return_qty) AS BIGINT) AS return_qty, CAST(sum(sales_amount) AS DECIMAL(18,2)) AS sales_amount,
 CAST(sum(return_amount) AS DECIMAL(18,2)) AS return_amount, CAST(sum(net_sales_amount) AS DECIMAL(18,2)) AS net_sales_amount,
 count(*) FILTER (WHERE sales_qty > 0) AS active_sku_count
FROM day_demand JOIN pmaster USING (center_id, sku_id) WHERE {_ACTIVE} GROUP BY 1, 2, 3, 4, 5, 6""")


def day_summary(s, products=None):
    """Only active rows count, so the sums are taken from the sparse facts, not from the dense grid. ``products``: as below."""
    daily = M.demand_mart(sales_facts(s, "day"), "tx_date", "B", REGIME_START)
    return M.summary_agg(daily, master(s) if products is None else products, "tx_date", LEVELS)


@query("E28", "summary_agg", "SELECT * FROM day_summary")
def summary_agg(s):
    return day_summary(s)


cte("day_region", """
SELECT center_id, tx_date, sido, sigungu, sku_id, product_name, option_code, CAST(sum(amount) AS DECIMAL(18,2)) AS sales_amount
FROM tx WHERE kind = 'sales' AND qty > 0 GROUP BY 1, 2, 3, 4, 5, 6, 7""")


def day_region(s, products=None):
    """``products``: the product master, where it is at hand."""
    return M.region_agg(s.tx_region().where("kind = 'sales'"), master(s) if products is None else products, "tx_date", s.shares())


@query("E29", "region_agg", "SELECT * FROM day_region")
def region_agg(s):
    return day_region(s)


cte("day_sparse", "SELECT * FROM day_mart WHERE inbound_qty <> 0 OR outbound_qty <> 0 OR sales_qty <> 0 OR return_qty <> 0")


def day_sparse(s):
    return M.sparse_activity(facts(s, "day"))


@query("E30", "sparse_activity", "SELECT * FROM day_sparse")
def sparse_activity(s):
    return day_sparse(s)


cte("day_sku_grid", "SELECT center_id, sku_id, grid_start, option_code, cat_l, cat_m, cat_s FROM day_start LEFT JOIN pmaster USING (center_id, sku_id)")


def day_sku_grid(s):
    return M.sku_grid_start(facts(s, "day"), master(s), "tx_date", LEVELS)


@query("E31", "sku_grid_start", "SELECT * FROM day_sku_grid")
def sku_grid_start(s):
    return day_sku_grid(s)


@query("E32", "ambiguous_keys", """
SELECT center_id, barcode, option_code FROM tx WHERE kind = 'sales' GROUP BY 1, 2, 3 HAVING count(DISTINCT cluster_no) > 1""")
def ambiguous_keys(s):
    return M.ambiguous_keys(s.sales(), PKEY, "cluster_no")


@query("F03", "mart_weekly_grid", "SELECT * FROM wk_grid")
def mart_weekly_grid(s):
    return mart(s).select(*M.SKU, "week_st")


@query("F04", "mart_daily_grid", "SELECT center_id, sku_id, count(*) AS days, min(tx_date) AS lo, max(tx_date) AS hi FROM day_grid GROUP BY 1, 2")
def mart_daily_grid(s):
    grid = mart(s, "day").select(*M.SKU, "tx_date")
    return grid.groupBy(*M.SKU).agg(F.count("*").alias("days"), F.min("tx_date").alias("lo"), F.max("tx_date").alias("hi"))


@query("F05", "mart_weekly_demand", "SELECT * FROM wk_demand")
def mart_weekly_demand(s):
    return demand(s)


_TXCOLS = ", ".join([*M.SKU, "{t}", "option_code", *M.PURCHASES, *M.SALES])


@query("F06", "mart_weekly_tx", f"SELECT {_TXCOLS.format(t='week_st')} FROM wk_mart LEFT JOIN pmaster USING (center_id, sku_id)")
def mart_weekly_tx(s):
    return M.transaction_mart(mart(s), master(s), "week_st")


@query("F07", "mart_daily_demand", """
SELECT tx_date, center_id, regime, count(*) AS n, CAST(sum(sales_qty) AS BIGINT) AS sales_qty, CAST(sum(net_qty) AS BIGINT) AS net_qty,
 CAST(sum(net_sales_amount) AS DECIMAL(18,2)) AS net_sales_amount FROM day_demand GROUP BY 1, 2, 3""")
def mart_daily_demand(s):
    return demand(s, "day").groupBy("tx_date", "center_id", "regime").agg(
        F.count("*").alias("n"), M.total("sales_qty"), F.sum("net_qty").alias("net_qty"), M.total("net_sales_amount"))


@query("F07", "mart_daily_tx", """
SELECT tx_date, center_id, option_code, count(*) AS n, CAST(sum(inbound_qty) AS BIGINT) AS inbound_qty,
 CAST(sum(outbound_qty) AS BIGINT) AS outbound_qty, CAST(sum(sales_amount) AS DECIMAL(18,2)) AS sales_amount,
 CAST(sum(inbound_total_amount) AS DECIMAL(18,4)) AS inbound_total_amount
FROM day_mart LEFT JOIN pmaster USING (center_id, sku_id) GROUP BY 1, 2, 3""")
def mart_daily_tx(s):
    return M.transaction_mart(mart(s, "day"), master(s), "tx_date").groupBy("tx_date", "center_id", "option_code").agg(
        F.count("*").alias("n"), M.total("inbound_qty"), M.total("outbound_qty"), M.total("sales_amount"), M.total("inbound_total_amount"))


@query("F31", "inventory_estimate", "SELECT * FROM wk_inv")
def inventory_estimate(s):
    return inventory(s)
