"""Cleaning rules on an extract with injected defects."""

from pyspark.sql import functions as F

from stockloom.functions import columns as C
from stockloom.operators import cleaning
from stockloom.registry import cte, query

# The raw extract: transactions as text, with defects placed by key arithmetic.
_DIRTY = """
SELECT l_orderkey AS order_no, l_linenumber AS line_no,
 CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS center_id,
 CASE WHEN l_orderkey % 11 = 0 THEN 'unknown' WHEN l_orderkey % 7 = 0 THEN concat(substr({date}, 1, 10), ',')
      WHEN l_orderkey % 5 = 0 THEN concat(substr({date}, 1, 10), ' 13:45:00') ELSE substr({date}, 1, 10) END AS date_s,
 CASE WHEN l_orderkey % 9 = 0 THEN '' WHEN l_orderkey % 11 = 0 THEN 'nan' WHEN l_orderkey % 17 = 0 THEN ' SE1 '
      WHEN l_orderkey % 19 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN concat(CAST(l_suppkey * 37 % 99999 AS {text}), '.0')
      ELSE CAST(l_suppkey * 37 % 99999 AS {text}) END AS zip_s,
 CASE WHEN l_partkey % 13 = 0 THEN '0' WHEN l_partkey % 17 = 0 THEN '' WHEN l_partkey % 19 = 0 THEN NULL
      WHEN l_partkey % 7 = 0 THEN lpad(CAST(l_partkey AS {text}), 11, '0')
      ELSE lpad(CAST(l_partkey AS {text}), 13, '0') END AS barcode_s,
 CASE WHEN l_orderkey % 23 = 0 THEN 'x' ELSE CAST(CAST(l_quantity AS BIGINT) AS {text}) END AS qty_s,
 CAST(CASE WHEN l_orderkey % 10 = 0 THEN 0 WHEN l_orderkey % 7 = 0 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS amount_d,
 CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT) AS qty_d,
 CASE WHEN l_linestatus = 'F' THEN 'inbound' ELSE 'outbound' END AS move,
 CASE WHEN l_partkey % 6 = 0 THEN 'ERROR' ELSE p_type END AS l1,
 CASE WHEN l_partkey % 8 = 0 THEN ' nan ' WHEN l_partkey % 14 = 0 THEN '-' ELSE concat(' ', p_type) END AS l2,
 CASE WHEN l_partkey % 9 = 0 THEN '' WHEN l_partkey % 15 = 0 THEN 'N/A' ELSE concat(p_brand, '　x ') END AS l3,
 p_brand AS brand, p_type AS ptype, l_partkey AS part_no, p_name AS product_name
FROM lineitem JOIN part ON l_partkey = p_partkey"""
cte("dirty", _DIRTY.format(date="CAST(l_shipdate AS VARCHAR)", text="VARCHAR"))


def dirty(s):
    return s.spark.sql(_DIRTY.replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}").format(
        date="CAST(l_shipdate AS STRING)", text="STRING", lineitem="{lineitem}", part="{part}"),
        lineitem=s.table("lineitem"), part=s.table("part"))


KEY = ["order_no", "line_no", "center_id"]
_K = "order_no, line_no, center_id"


@query("B01", "conform_columns", "SELECT l_orderkey AS order_no, l_linenumber AS line_no, l_shipdate AS moved_at FROM lineitem")
def conform_columns(s):
    names = {"l_orderkey": "order_no", "l_linenumber": "line_no", "l_shipdate": "moved_at", "absent": "never"}
    return cleaning.conform_columns(s.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), names)


@query("B02", "drop_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def drop_columns(s):
    return cleaning.drop_columns(s.table("lineitem"), [
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "absent"])


@query("B03", "parse_date", f"SELECT {_K}, CAST(TRY_CAST(replace(date_s, ',', '') AS TIMESTAMP) AS DATE) AS tx_date FROM dirty")
def parse_date(s):
    return dirty(s).select(*KEY, C.parse_date(F.col("date_s")).alias("tx_date"))


_ZIP = """CASE WHEN zip_s IS NULL OR trim(zip_s) IN ('', 'nan') THEN ''
 WHEN TRY_CAST(zip_s AS DOUBLE) IS NOT NULL THEN lpad(CAST(CAST(TRY_CAST(zip_s AS DOUBLE) AS BIGINT) AS VARCHAR), 5, '0')
 ELSE lpad(trim(zip_s), 5, '0') END"""


@query("B04", "zip5", f"SELECT {_K}, {_ZIP} AS zip5 FROM dirty")
def zip5(s):
    return dirty(s).select(*KEY, C.zip5(F.col("zip_s")).alias("zip5"))


@query("B05", "valid_barcode", f"SELECT {_K}, barcode_s FROM dirty WHERE barcode_s IS NOT NULL AND barcode_s NOT IN ('', '0')")
def valid_barcode(s):
    return cleaning.valid_barcode(dirty(s).select(*KEY, "barcode_s"), "barcode_s")


@query("B06", "valid_lengths", f"""
SELECT {_K}, zip_s, barcode_s FROM dirty
WHERE (TRY_CAST(zip_s AS DOUBLE) IS NULL OR isnan(TRY_CAST(zip_s AS DOUBLE)) OR TRY_CAST(zip_s AS DOUBLE) >= 1000)
 AND length(barcode_s) IN (8, 12, 13, 14)""")
def valid_lengths(s):
    return cleaning.valid_lengths(dirty(s).select(*KEY, "zip_s", "barcode_s"), "zip_s", "barcode_s")


@query("B07", "drop_sign_combo", f"""
SELECT {_K}, move, amount_d, qty_d FROM dirty WHERE NOT coalesce(
 (center_id = 'A' AND ((move = 'outbound' AND amount_d = 0 AND qty_d < 0) OR (move = 'inbound' AND amount_d = 0 AND qty_d > 0)))
 OR (center_id = 'B' AND ((move = 'outbound' AND ((amount_d > 0 AND qty_d > 0) OR (amount_d = 0 AND qty_d <> 0)))
   OR (move = 'inbound' AND ((amount_d < 0 AND qty_d > 0) OR (amount_d = 0 AND qty_d < 0))))), false)""")
def drop_sign_combo(s):
    return cleaning.drop_sign_combo(dirty(s).select(*KEY, "move", "amount_d", "qty_d"),
                                    work_type="move", amount="amount_d", qty="qty_d")


_TOK = "CASE WHEN trim({c}) IN ('', 'nan', 'None', 'NULL', 'N/A', '-') THEN NULL ELSE trim({c}) END"
cte("dirty_levels", f"SELECT {_K}, {', '.join(_TOK.format(c=c) + f' AS {c}' for c in ('l1', 'l2', 'l3'))}, brand FROM dirty")


def dirty_levels(s):
    return cleaning.null_tokens(dirty(s).select(*KEY, "l1", "l2", "l3", "brand"), ["l1", "l2", "l3"])


@query("B08", "null_tokens", f"SELECT {_K}, l1, l2, l3 FROM dirty_levels")
def null_tokens(s):
    return dirty_levels(s).drop("brand")


@query("B09", "split_complete", f"""
SELECT {_K}, l1, l2, l3, CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL THEN 1 ELSE 0 END AS is_complete
FROM dirty_levels""")
def split_complete(s):
    return cleaning.flag_complete(dirty_levels(s).drop("brand"), ["l1", "l2", "l3"])


@query("B10", "strip_unicode_space", f"SELECT {_K}, replace(replace(l3, ' ', ''), '　', '') AS l3 FROM dirty")
def strip_unicode_space(s):
    return dirty(s).select(*KEY, C.strip_blanks(F.col("l3")).alias("l3"))


# Old and current province names.
PROVINCES = {"AFRICA": "AFRICA UNION", "ASIA": "ASIA SPECIAL", "MIDDLE EAST": "MIDDLE EAST SPECIAL"}


@query("B11", "map_values", """
SELECT c_custkey, CASE sido WHEN 'AFRICA' THEN 'AFRICA UNION' WHEN 'ASIA' THEN 'ASIA SPECIAL'
  WHEN 'MIDDLE EAST' THEN 'MIDDLE EAST SPECIAL' ELSE sido END AS sido FROM places""")
def map_values(s):
    return s.customers().select("c_custkey", C.map_values(F.col("sido"), PROVINCES).alias("sido"))


@query("B12", "split_once", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS head,
  CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, strpos(p_name, ' ') + 1) END AS rest FROM part""")
def split_once(s):
    head, rest = C.split_once(F.col("p_name"))
    return s.table("part").select("p_partkey", head.alias("head"), rest.alias("rest"))


@query("B13", "holiday_canonical", """
SELECT o_orderkey, CASE WHEN contains(o_orderpriority, 'HIGH') THEN 'HIGH' ELSE 'URGENT' END AS holiday FROM orders
WHERE contains(o_orderpriority, 'HIGH') OR contains(o_orderpriority, 'URGENT')""")
def holiday_canonical(s):
    named = s.table("orders").select("o_orderkey", F.col("o_orderpriority").alias("holiday"))
    return cleaning.holiday_canonical(named, "holiday", ["HIGH", "URGENT"])


@query("B14", "ymd", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
  CAST(day(o_orderdate) AS INT) AS d FROM orders""")
def ymd(s):
    return cleaning.ymd(s.table("orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("B15", "kan_pad_prefix", """
SELECT p_partkey, code, substr(code, 1, 2) AS code_l1, substr(code, 1, 4) AS code_l2, substr(code, 1, 6) AS code_l3
FROM (SELECT p_partkey, lpad(CAST(p_partkey * 97 % 9999999 AS VARCHAR), 8, '0') AS code FROM part)""")
def kan_pad_prefix(s):
    coded = s.table("part").select("p_partkey", F.expr("p_partkey * 97 % 9999999").alias("raw"))
    return cleaning.category_codes(coded, "raw").drop("raw")


# Level 1 implied by level 3 when level 1 failed.
LEVEL1_BY_LEVEL3 = {"Brand#1": "ECONOMY", "Brand#2": "LARGE", "Brand#3": "SMALL"}


@query("B16", "repair_category", f"""
WITH fix AS (SELECT CAST(p AS BIGINT) AS part_no, l1_fix FROM (VALUES (6, 'STANDARD'), (12, 'PROMO')) v(p, l1_fix))
SELECT {_K}, coalesce(l1_fix, CASE WHEN l1 = 'ERROR' THEN CASE brand WHEN 'Brand#1' THEN 'ECONOMY' WHEN 'Brand#2' THEN 'LARGE'
  WHEN 'Brand#3' THEN 'SMALL' ELSE l1 END ELSE l1 END) AS l1
FROM dirty LEFT JOIN fix USING (part_no)""")
def repair_category(s):
    repaired = cleaning.repair_category(dirty(s).select(*KEY, "part_no", "brand", "l1"), "l1", "brand", LEVEL1_BY_LEVEL3)
    fixes = s.rows([(6, "STANDARD"), (12, "PROMO")], "part_no bigint, l1 string")
    return cleaning.apply_corrections(repaired, fixes, ["part_no"], ["l1"]).select(*KEY, "l1")


@query("B17", "coerce_numeric", f"SELECT {_K}, TRY_CAST(qty_s AS DOUBLE) AS qty FROM dirty")
def coerce_numeric(s):
    return dirty(s).select(*KEY, C.number(F.col("qty_s")).alias("qty"))


@query("B18", "sign_split", """
SELECT order_no, line_no, qty, amount, CASE WHEN qty > 0 THEN qty ELSE 0 END AS sales_qty,
  CASE WHEN qty < 0 THEN -qty ELSE 0 END AS return_qty,
  CAST(CASE WHEN qty > 0 THEN amount ELSE 0 END AS DECIMAL(18,2)) AS sales_amount,
  CAST(CASE WHEN qty < 0 THEN -amount ELSE 0 END AS DECIMAL(18,2)) AS return_amount
FROM tx WHERE kind = 'sales'""")
def sign_split(s):
    return cleaning.sign_split(s.lines().where("kind = 'sales'").select("order_no", "line_no", "qty", "amount"))


@query("B19", "sku_key", """
SELECT p_partkey, concat(p_brand, '*', p_type, '*', CAST(p_size % 2 AS VARCHAR)) AS sku_id, p_brand AS barcode,
  p_type AS option_code, CAST(p_size % 2 AS VARCHAR) AS cluster FROM part""")
def sku_key(s):
    keyed = s.products().select(F.col("part_no").alias("p_partkey"), C.sku_key("barcode", "option_code", "cluster_no").alias("sku_id"))
    barcode, option, cluster = C.sku_parts(F.col("sku_id"))
    return keyed.select("*", barcode.alias("barcode"), option.alias("option_code"), cluster.alias("cluster"))


@query("B20", "week_start", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) - CAST(isodow(o_orderdate) - 1 AS INT) AS week_st FROM orders""")
def week_start(s):
    return s.table("orders").select("o_orderkey", C.week_start(F.col("o_orderdate")).alias("week_st"))


@query("B25", "search_products", """
SELECT p_partkey, p_name, p_brand FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%'""")
def search_products(s):
    from stockloom.operators.serving import search_products as search
    return search(s.table("part").select("p_partkey", "p_name", "p_brand"), "RING", ["p_name", "p_brand"])


@query("B26", "code_valid", """
SELECT order_no, line_no, part_no, CASE WHEN part_no IN (SELECT p_partkey FROM part WHERE p_size < 40) THEN 1 ELSE 0 END AS is_valid
FROM (SELECT l_orderkey AS order_no, l_linenumber AS line_no, l_partkey AS part_no FROM lineitem)""")
def code_valid(s):
    codes = s.table("part").where("p_size < 40").select(F.col("p_partkey").alias("part_no"))
    return cleaning.code_valid(s.lines().select("order_no", "line_no", "part_no"), codes, "part_no")


@query("B27", "horizon_parse", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END AS horizon FROM orders""")
def horizon_parse(s):
    raw = F.expr("case o_orderkey % 3 when 0 then 'h4' when 1 then '2' else 'H1' end")
    return s.table("orders").select("o_orderkey", C.parse_horizon(raw).alias("horizon"))
