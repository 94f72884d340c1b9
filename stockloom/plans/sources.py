"""Sources, sinks and load checks on the test tables."""

from pyspark.sql import functions as F

from stockloom.operators import keys, profiling
from stockloom.operators.cleaning import union_labelled
from stockloom.registry import cte, query
from stockloom.sources import files
from stockloom.sources.storage import new_table_path


@query("A01", "scan_pruned", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_pruned(s):
    return s.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("A02", "scan_pushed", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_suppkey = 7 AND l_returnflag = 'R'""")
def scan_pushed(s):
    return (s.table("lineitem").where("l_suppkey = 7 and l_returnflag = 'R'")
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))


@query("A03", "scan_dataset_filter", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')
GROUP BY 1, 2""")
def scan_dataset_filter(s):
    wanted = "(o_orderstatus = 'F' and o_orderpriority = '1-URGENT') or (o_orderstatus = 'O' and o_orderpriority = '5-LOW')"
    return s.table("orders").where(wanted).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("A04", "scan_csv_encoded", "SELECT s_suppkey, concat(s_name, ' 센터') AS s_name, s_nationkey FROM supplier")
def scan_csv_encoded(s):
    named = s.table("supplier").select("s_suppkey", F.concat("s_name", F.lit(" 센터")).alias("s_name"), "s_nationkey")
    path = files.write_csv_encoded(named, "suppliers", sep="\t", encoding="cp949")
    return files.read_csv_fallback(s.spark, path, named.schema, sep="\t")


@query("A05", "union_sheets", """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS _source_sheet, count(*) AS n,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total
FROM orders GROUP BY 1""")
def union_sheets(s):
    """Every year is a sheet of its own; rows carry their sheet's name from one scan."""
    sheets = s.table("orders").select(F.year("o_orderdate").cast("string").alias("_source_sheet"), "o_totalprice")
    return sheets.groupBy("_source_sheet").agg(
        F.count("*").alias("n"),
        F.expr("cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(18,2))").alias("total"))


@query("A06", "sink_csv", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def sink_csv(s):
    df = s.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return files.read_csv(s.spark, files.write_csv(df, "orders"), df.schema)


@query("A07", "sink_partitioned", """
SELECT center_id, work_type, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM tx GROUP BY 1, 2""")
def sink_partitioned(s):
    df = s.lines().select("center_id", "work_type", "qty")
    path = files.write_partitioned(df, "moves", ["center_id", "work_type"])
    back = s.spark.read.parquet(path).withColumns(
        {c: F.col(c).cast("string") for c in ("center_id", "work_type")})
    return back.groupBy("center_id", "work_type").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query("A08", "sink_errorifexists", "SELECT c_custkey, c_mktsegment FROM customer")
def sink_errorifexists(s):
    path = new_table_path(s.spark, "customers")
    return s.spark.read.parquet(files.write_new(s.table("customer").select("c_custkey", "c_mktsegment"), path))


@query("A09", "load_reconcile", """
SELECT count(*) AS source_rows, count(*) AS sink_rows, CAST(0 AS BIGINT) AS difference FROM customer""")
def load_reconcile(s):
    source = s.table("customer")
    path = files.write_new(source, new_table_path(s.spark, "customers"))
    return profiling.reconcile(source, s.spark.read.parquet(path))


cte("orders_gaps", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS custkey FROM orders""")


def _orders_gaps(s):
    return s.table("orders").selectExpr(
        "o_orderkey", "case when o_orderpriority = '5-LOW' then null else o_orderpriority end as priority",
        "case when o_orderstatus = 'P' then null else o_custkey end as custkey")


def _profile_sql(cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS dtype, count(*) - count({c}) AS null_count, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct FROM orders_gaps" for c, k in cols)


@query("A10", "profile_columns", _profile_sql([("o_orderkey", "bigint"), ("priority", "string"), ("custkey", "bigint")]))
def profile_columns(s):
    return profiling.profile_columns(_orders_gaps(s))


_DUCK_TYPES = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"


@query("A11", "profile_schema", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, {_DUCK_TYPES.replace('data_type', 'column_type')} AS data_type FROM (DESCRIBE {t})"
    for t in ("lineitem", "orders", "customer", "part")))
def profile_schema(s):
    return profiling.profile_schema(s.spark, {t: s.table(t) for t in ("lineitem", "orders", "customer", "part")})


@query("A12", "min_max_dates", """
SELECT 'lineitem' AS table_name, count(*) AS n, CAST(min(l_shipdate) AS DATE) AS first_date,
  CAST(max(l_shipdate) AS DATE) AS last_date FROM lineitem UNION ALL
SELECT 'orders', count(*), CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE) FROM orders""")
def min_max_dates(s):
    return profiling.date_ranges({"lineitem": (s.table("lineitem"), "l_shipdate"), "orders": (s.table("orders"), "o_orderdate")})


# A13 is registered with the trial records in plans/evaluation.py.


@query("A14", "surrogate_id", """
WITH k AS (SELECT tx_date, order_no, line_no, center_id, barcode, option_code, qty, amount,
    substr(md5(concat_ws('|', CAST(order_no AS VARCHAR), CAST(line_no AS VARCHAR))), 1, 3) AS slot FROM tx)
SELECT tx_date, order_no, line_no, center_id, barcode, option_code, qty, amount,
  row_number() OVER (ORDER BY tx_date, slot, order_no, line_no, center_id, barcode, option_code, qty, amount) AS row_id
FROM k""")
def surrogate_id(s):
    cols = ["tx_date", "order_no", "line_no", "center_id", "barcode", "option_code", "qty", "amount"]
    return keys.surrogate_id(s.tx().select(cols), "tx_date", ["order_no", "line_no"], cols)
