"""Marts on hand-made tables: they are made from weekly or daily sums and sold products, with the rows that single transactions give."""

import datetime as dt
import random

import pytest

from stockloom.operators import forecasting as FC
from stockloom.operators import marts as M
from stockloom.plans import marts as P
from stockloom.plans import series, serving
from stockloom.sources import adapters
from stockloom.sources.adapters import Source


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Few products under many parts, one part twice, nulls in keys and quantities, quantities of zero and below."""
    rnd = random.Random(7)
    pick = lambda *values: rnd.choice(values)
    day = lambda: dt.datetime(2000, 9, 1) + dt.timedelta(days=rnd.randrange(40))
    parts = [(p, pick("a", "b ", "c", None), f"Brand#{rnd.randint(1, 2)}", pick("ECONOMY", "LARGE"), pick(None, 1, 2, 3, 4)) for p in range(12)]
    lines = [(o, pick(None, *range(13)), pick(1, 2, None), rnd.randint(1, 6), pick(None, -2.0, 0.0, 3.0, 5.0), pick(None, 4.25, 10.5), pick(0.1, 0.05),
              pick("N", "R", None), pick("F", "O"), day()) for o in range(600)]
    path = str(tmp_path_factory.mktemp("tables"))
    tables = {
        "part": ([*parts, parts[0]], "p_partkey long, p_name string, p_brand string, p_type string, p_size long"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_tax double, "
                            "l_returnflag string, l_linestatus string, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return Source(spark, path)


def rows(df):
    return sorted(df.select(*sorted(df.columns)).collect(), key=repr)


def test_sold_products_stand_for_sales(source):
    for made in (source, source.kept(), source.by_week(), source.by_day()):
        assert rows(P.master(made)) == rows(M.product_master(source.sales(), "week_st", P.ATTRIBUTES))
        assert rows(M.cluster_profile(made.sold(), P.PKEY)) == rows(M.cluster_profile(source.sales(), P.PKEY))


def test_weekly_sums_stand_for_transactions(source):
    assert source.by_week().tx().dtypes == source.kept().tx().dtypes
    assert source.by_week().tx().count() < source.kept().tx().count()
    plain = M.merge_facts(P.sales_facts(source), P.purchase_facts(source), "week_st")
    assert rows(serving.weekly(source).drop(M.INBOUND_ROWS)) == rows(plain)
    assert rows(serving.demand(source)) == rows(P.demand(source))
    assert rows(serving.moves(source)) == rows(P.mart(source))
    assert rows(serving.stock(source)) == rows(P.inventory(source))
    assert rows(series.stored_grid(source)) == rows(series.grid(source))
    assert any(r.inventory_available for r in serving.stock(source).collect())


def test_daily_sums_stand_for_transactions(source):
    assert source.by_day().tx().dtypes == source.kept().tx().dtypes
    assert rows(serving.daily(source)) == rows(M.merge_facts(P.sales_facts(source, "day"), P.purchase_facts(source, "day"), "tx_date"))
    assert rows(serving.summary(source)) == rows(P.day_summary(source))
    assert rows(serving.records(source)) == rows(serving.raw(source))


def test_marts_read_no_single_transactions(source, monkeypatch):
    """All weekly marts move the transactions once, all daily ones once, none writes them; the master does not even that."""
    moved = []
    joined = adapters._Kept.joined
    monkeypatch.setattr(adapters, "_MARTS", {})
    monkeypatch.setattr(adapters._Kept, "joined", lambda self: moved.append(1) or joined(self))
    serving.master(source)
    assert not moved
    for mart in (serving.demand, serving.moves, serving.stock, series.stored_grid):
        mart(source)
    assert len(moved) == 1
    for mart in (serving.sparse, serving.summary, serving.sku_grid, serving.records):
        mart(source)
    assert len(moved) == 2 and "transactions" not in {name for _, _, name in adapters._MARTS}


def test_category_means_are_not_sent_to_the_driver(spark, tmp_path, monkeypatch):
    """A small file may hold many categories and weeks: only the means of a centre, one row per week, may be broadcast."""
    weeks = [dt.date(2000, 1, 3) + dt.timedelta(days=7 * w) for w in range(3)]
    grid = [("A", f"s{k}", None if k == 0 else f"c{k}", f"m{k % 2}", "l", w, 10 * k + i) for k in range(4) for i, w in enumerate(weeks)]
    path = str(tmp_path / "grid")
    spark.createDataFrame(grid, "center_id string, sku_id string, cat_s string, cat_m string, cat_l string, week_st date, qty long").write.parquet(path)
    made = []
    monkeypatch.setattr(FC, "written", lambda df, label: made.append(df) or df)
    means = FC.coldstart_means(spark.read.parquet(path), ["cat_s", "cat_m", "cat_l"])
    out = {(r.sku_id, r.week_st): r for r in means.collect()}
    assert len(out) == len(grid)
    last = out["s3", weeks[2]]
    assert (last.m_cat_s, last.m_cat_m, last.m_cat_l, last.m_center) == (31.0, 21.0, 16.0, 16.0)
    assert out["s0", weeks[2]].m_cat_s is None and out["s0", weeks[2]].m_cat_m == 11.0
    for df, joins in ((made[0], 3), (means, 4)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") == joins and plan.count("BroadcastHashJoin") <= 1
