"""Check-side definitions of the canonical inputs (DuckDB SQL)."""

from stockloom.registry import cte
from stockloom.sources.adapters import HARVEST_DAYS, NEW_YEAR_DAYS

cte("places", """
SELECT c_custkey, r_name AS sido, n_name AS sigungu
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

cte("tx", """
SELECT *, CAST(CASE WHEN neg THEN -q ELSE q END AS BIGINT) AS qty,
  CAST(CASE WHEN neg THEN -a ELSE a END AS DECIMAL(18,2)) AS amount,
  CAST(CASE WHEN neg THEN -a ELSE a END * rate AS DECIMAL(18,4)) AS vat
FROM (
 SELECT l_orderkey AS order_no, l_linenumber AS line_no,
  CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS center_id,
  CASE WHEN l_linenumber % 3 = 0 THEN 'purchase' ELSE 'sales' END AS kind,
  CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_linestatus = 'F' THEN 'inbound' ELSE 'outbound' END
       ELSE CASE WHEN l_returnflag = 'R' THEN 'return' ELSE 'sale' END END AS work_type,
  CAST(l_shipdate AS DATE) AS tx_date, CAST(date_trunc('week', l_shipdate) AS DATE) AS week_st,
  p_brand AS barcode, p_type AS option_code, p_size % 2 AS cluster_no,
  concat(p_brand, '*', p_type, '*', CAST(p_size % 2 AS VARCHAR)) AS sku_id,
  p_name AS product_name, CAST(p_size AS VARCHAR) AS spec, p_type AS cat_l,
  concat(p_type, '/', CAST(CAST(substr(p_brand, 7) AS INT) % 5 AS VARCHAR)) AS cat_m,
  concat(p_type, '/', p_brand) AS cat_s,
  r_name AS sido, n_name AS sigungu, concat(n_name, ' ', o_orderpriority) AS city,
  lpad(CAST(o_custkey % 1000 AS VARCHAR), 5, '0') AS zip5,
  (l_linenumber % 3 = 0 AND l_linestatus <> 'F') OR (l_linenumber % 3 <> 0 AND l_returnflag = 'R') AS neg,
  CAST(l_quantity AS BIGINT) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS a, CAST(l_tax AS DECIMAL(4,2)) AS rate
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey) x""")

cte("postal", """
SELECT lpad(CAST(c_custkey % 1000 AS VARCHAR), 5, '0') AS zip5, arg_min(sido, c_custkey) AS sido,
  arg_min(sigungu, c_custkey) AS sigungu
FROM places WHERE c_custkey % 1000 % 20 <> 0 GROUP BY 1""")

cte("ords", """
SELECT o_orderkey AS order_no, o_custkey, CAST(o_orderdate AS DATE) AS order_date,
  CAST(o_totalprice AS DECIMAL(18,2)) AS total, sido, sigungu
FROM orders JOIN places ON o_custkey = c_custkey""")

cte("weather", """
SELECT sido, CASE WHEN sido = 'ASIA' THEN NULL ELSE sigungu END AS sigungu, order_date AS date,
  CAST(sum(total) AS DOUBLE) / count(*) / 1000 AS temp, count(*) AS rain
FROM ords WHERE sido <> 'EUROPE' GROUP BY 1, 2, 3""")

cte("holidays", "SELECT CAST(d AS DATE) AS date, holiday FROM (VALUES " + ", ".join(
    f"('{d}', '{n}')" for days, n in ((NEW_YEAR_DAYS, "new_year"), (HARVEST_DAYS, "harvest")) for d in days)
    + ") v(d, holiday)")

cte("covid", """
SELECT DISTINCT order_date AS date, CASE WHEN year(order_date) IN (1998, 1999) THEN 1 ELSE 0 END AS covid FROM ords""")

cte("cpi", """
SELECT CAST(year(order_date) AS INT) AS y, CAST(month(order_date) AS INT) AS m,
  CAST(sum(total) AS DOUBLE) / count(*) AS cpi FROM ords GROUP BY 1, 2""")

cte("retail", """
SELECT sido, CAST(year(order_date) AS INT) AS y, CAST(month(order_date) AS INT) AS m,
  CAST(sum(total) AS DOUBLE) / count(*) AS retail_current, count(*) AS retail_constant
FROM ords GROUP BY 1, 2, 3""")
