"""Canonical frames on hand-made tables: parts, customers and orders are never sent to the driver, and marts join parts once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockloom.plans import joining, serving
from stockloom.sources import adapters
from stockloom.sources.adapters import Source

DAY = dt.datetime(2000, 10, 5)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Part 3 is repeated, part 4 unknown, one line has no part, one order no customer, one brand is null."""
    path = str(tmp_path_factory.mktemp("tables"))
    tables = {
        "region": ([(0, "ASIA")], "r_regionkey long, r_name string"),
        "nation": ([(0, "NATION_0", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(7, 0)], "c_custkey long, c_nationkey long"),
        "part": ([(1, "a", "Brand#1", "ECONOMY", 2), (2, "b", None, "LARGE", 3), (3, "c", "Brand#3", "SMALL", 4), (3, "d", "Brand#3", "SMALL", 4)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size long"),
        "orders": ([(10, 7, DAY, 5.0, "1-URGENT"), (11, None, DAY, 5.0, "5-LOW")],
                   "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double, o_orderpriority string"),
        "lineitem": ([(o, p, 2, n, 3.0, 4.5, 0.1, "N", "F", DAY) for o, p, n in [(10, 1, 1), (10, 1, 1), (10, 2, 2), (10, 3, 3), (10, 4, 4), (10, None, 5), (11, 1, 1)]],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, "
                     "l_linestatus string, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return Source(spark, path)


def rows(df):
    return sorted(df.collect(), key=repr)


def broadcast_parts(df):
    """The lines of the plan below its broadcasts."""
    found, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if depth is None and "BroadcastExchange" in line:
            depth = at
        elif depth is not None:
            found.append(line)
    return "\n".join(found)


@pytest.mark.parametrize("build", [Source.tx, Source.tx_region, Source.tx_zip, Source.weather, Source.retail, joining.unify_tx, joining.places], ids=lambda f: f.__name__)
def test_growing_tables_stay_off_the_driver(source, build):
    sent = broadcast_parts(build(source))
    assert not any(c in sent for c in ("p_partkey", "c_custkey", "o_orderkey"))


@pytest.mark.parametrize("build", [lambda s: s.by_week().summed(), lambda s: s.by_day().summed(), Source.sold], ids=["weeks", "days", "sold"])
def test_sums_and_sold_products_stay_off_the_driver(source, build):
    assert "p_partkey" in build(source)._jdf.queryExecution().executedPlan().toString()
    assert not any(c in broadcast_parts(build(source)) for c in ("p_partkey", "l_partkey"))


def test_rows_of_joined_transactions(source):
    columns = source.lines().drop("part_no").columns + source.products().drop("part_no").columns
    assert source.tx().columns == columns
    assert sorted((r.order_no, r.line_no, r.product_name, r.sku_id) for r in source.tx().collect()) == [
        (10, 1, "a", "Brand#1*ECONOMY*0"), (10, 1, "a", "Brand#1*ECONOMY*0"), (10, 2, "b", "LARGE*1"),
        (10, 3, "c", "Brand#3*SMALL*0"), (10, 3, "d", "Brand#3*SMALL*0"), (11, 1, "a", "Brand#1*ECONOMY*0")]
    placed = source.tx_region()
    assert placed.columns == [*columns, "sido", "sigungu", "city"]
    assert sorted((r.order_no, r.product_name, r.sido, r.city) for r in placed.collect()) == [
        (10, n, "ASIA", "NATION_0 1-URGENT") for n in "aabcd"]
    zips = source.tx_zip()
    assert zips.columns == [*columns, "zip5"]
    assert sorted(((r.order_no, r.product_name, r.zip5) for r in zips.collect()), key=repr) == [(10, n, "00007") for n in "aabcd"] + [(11, "a", None)]


def test_unified_lines_are_described_last(source):
    df = joining.unify_tx(source)
    assert df.columns == [c for c in joining.UNIFIED if c not in "ymd"] + ["y", "m", "d"]
    assert rows(df.select("product_name", "zip5", "kind")) == rows(source.tx_zip().select("product_name", "zip5", "kind"))
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    names = [next(i for i, line in enumerate(plan) if "Relation" in line and c in line) for c in ("p_partkey", "o_orderkey")]
    depth = [len(plan[i]) - len(plan[i].lstrip(" :+-")) for i in names]
    assert depth[0] < depth[1]


def test_marts_join_parts_once(source, monkeypatch):
    """All marts of the daily head: its transactions are joined once, and hold what the direct join gives."""
    joined = []
    describe = Source.described
    monkeypatch.setattr(Source, "described", lambda self, lines: joined.append(1) or describe(self, lines))
    for mart in (serving.master, serving.demand, serving.moves, serving.stock, serving.sparse, serving.summary, serving.sku_grid, serving.raw):
        mart(source)
    assert not joined
    kept = [path for (_, _, name), path in adapters._MARTS.items() if name == "transactions"]
    assert len(set(kept)) == len(kept) >= 1
    assert source.kept().tx().columns == source.tx().drop("order_no", "line_no").columns
    assert rows(source.kept().tx()) == rows(source.tx().drop("order_no", "line_no"))


def test_daily_marts_share_their_facts(source):
    facts = serving.P.facts(source, "day")
    assert rows(serving.sparse(source)) == rows(serving.P.day_sparse(source))
    assert rows(serving.sku_grid(source)) == rows(serving.P.day_sku_grid(source))
    assert rows(serving.regional(source)) == rows(serving.P.day_region(source))
    assert facts.count() == serving.daily(source).count()
    assert rows(serving.raw(source).groupBy("sku_id").agg(F.count("*"))) == rows(source.sales().groupBy("sku_id").agg(F.count("*")))


def test_regional_rows_are_dealt_by_their_number(spark, source, tmp_path, monkeypatch):
    """A task's groups follow the share of lines that is set, not the shuffle partitions; nothing is aggregated before rows are dealt."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(59))).alias("k")
    for name in ("region", "nation", "customer", "part", "orders"):
        source.table(name).write.parquet(f"{tmp_path}/{name}.parquet")
    lines = source.table("lineitem")
    many = lines.select("*", copies).withColumn("l_shipdate", F.expr("l_shipdate - make_dt_interval(k)")).select(lines.columns)
    many.write.parquet(f"{tmp_path}/lineitem.parquet")
    grown = Source(spark, str(tmp_path))
    plain = rows(serving.P.day_region(grown))
    assert sum(r.sales_amount for r in plain) == 60 * sum(r.sales_amount for r in serving.P.day_region(source).collect()) > 0
    monkeypatch.setattr(adapters, "LINES", 20)
    df = serving.P.day_region(grown)
    held = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 8 and max(r["count"] for r in held) <= 30
    assert rows(df) == plain and grown.shares() == 21
    plan = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    sums = [i for i, line in enumerate(plan) if "HashAggregate" in line and "sum(amount" in line]
    assert max(sums) < next(i for i, line in enumerate(plan) if "REPARTITION_BY_NUM" in line)
