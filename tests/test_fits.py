"""Fitted models beside plain versions on small frames."""

import datetime as dt

import numpy as np
import pandas as pd
import plain_models
import pytest
from pyspark.sql import functions as F

from stockloom.operators import autoregression, evaluation, folds, forecasting, joins, ranking, skew, walkforward
from test_rules import week, weekly


def test_autoregressions_match_least_squares(spark):
    r = np.random.default_rng(3)
    t = np.arange(170)
    shapes = {"wave13": 50 + 40 * np.sin(2 * np.pi * t / 13) + r.normal(size=170), "wave26": 30 + 20 * np.sin(2 * np.pi * t / 26) + r.normal(size=170), "year": 30 + 25 * (t % 52 < 6) + r.poisson(2, 170),
              "noise": r.poisson(3, 170), "rare": r.poisson(0.3, 170), "grown": np.minimum(1.1**t, 1e6)}
    series = {k: np.maximum(np.round(v), 0).astype(int).tolist() for k, v in shapes.items()} | {"short": [1, 2, 3, 1, 2, 5], "tiny": [4], "flat": [7] * 170, "brief": [3, 1, 4, 1, 5, 9, 2, 6] * 18}
    df = None
    for sku, values in series.items():
        part = weekly(spark, values, sku=sku)
        df = part if df is None else df.unionByName(part)
    for seasons in ((), (13, 26, 52)):
        got = autoregression.per_series_fit(df, str(week(130)), (1, 2, 4), seasons).toPandas()
        for sku, values in series.items():
            own = got[got.sku_id == sku].sort_values(["week_st", "horizon"])
            status, season, raw = plain_models.per_series(values, min(130, len(values)), (1, 2, 4), seasons)
            assert len(own) == raw.size
            if raw.size:
                assert set(own.status) == {status} and set(own.season) == {season}, (sku, seasons, set(own.season), season)
                assert np.allclose(own.y_raw, raw.ravel(), rtol=1e-5, atol=1e-3), (sku, seasons)


def test_singular_series_have_their_mean(spark):
    """Every second week sells the same: the two lags add up to a constant."""
    out = autoregression.per_series_fit(weekly(spark, [0, 5] * 40), str(week(60)), (1, 4))
    assert {r.status for r in out.collect()} == {"singular history"} and {r.y_pred for r in out.collect()} == {2.5}


def known_rows(spark, n=400):
    """Rows of both centres over 60 weeks with whole-number features."""
    r = np.random.default_rng(5)
    rows = [("A" if k % 3 else "B", f"s{k % 7}", week(k // 8), 1, week(k // 8 + 1), int(r.poisson(4)), *[int(v) for v in r.integers(0, 3000, 5)], int(k % 4)) for k in range(n)]
    return spark.createDataFrame(rows, "center_id string, sku_id string, week_st date, horizon int, target_date date, y_true bigint, x1 bigint, x2 bigint, x3 bigint, x4 bigint, x5 bigint, g int")


def test_prefix_sums_give_every_folds_own_fit(spark):
    rows = known_rows(spark)
    quarters = folds.quarter_folds(2020)
    start, last = str(week(30)), str(week(60))
    marked = walkforward.mark_folds(rows, quarters, "B", start, last)
    sums = walkforward.fold_sums(marked, walkforward.fold_borders(marked, quarters, "B"), "B", start, (0, 1))
    points = spark.createDataFrame([("recent", 1, 1, 1.0, 0), ("pooled", 1, 1, 0.5, 1)], "model string, horizon int, trial int, ridge double, seed int")
    wanted = points.join(sums.select("horizon", "seed", "fold"), ["horizon", "seed"])
    fits = walkforward.solve(sums, wanted).toPandas()
    pdf, seen = marked.toPandas(), 0
    assert set(fits.fold) > {103} and fits.fold.min() < 100
    for fit in fits.itertuples():
        val = pdf[pdf.fold == fit.fold]
        usable = pdf[(pdf.center_id == "A") | (pdf.week_st >= week(30))]
        border = val.target_date.min() if fit.fold > 100 else dt.date.fromisoformat(quarters[fit.fold - 1].val_start)
        train = usable[(usable.target_date < border) & ((fit.fold > 100) | (usable.center_id == "A")) & ((fit.seed == 0) | (usable.g != fit.seed))]
        use = walkforward.FAMILIES[fit.model][1:]
        x = np.column_stack([np.ones(len(train))] + [train[f"x{i}"] / 1000 for i in use])
        w = np.linalg.solve(x.T @ x + fit.ridge * np.diag([0, 1, 1, 1]), x.T @ train.y_true.to_numpy(float))
        assert fit.train_rows == len(train) and np.allclose([fit.c0, *[getattr(fit, f"c{i}") for i in use]], w, rtol=1e-6, atol=1e-8)
        seen += 1
    assert seen > 30


def test_trial_table_skips_finished_fits(spark, tmp_path):
    made = []

    def fit(todo):
        made.append(todo.count())
        return todo.withColumn("e", F.lit(1.0))

    points = lambda seeds: spark.createDataFrame([("m", 1, 1, k, 1) for k in seeds], "model string, horizon int, trial int, seed int, fold int")
    path = str(tmp_path / "trials")
    assert walkforward.run_trials(spark, path, "in", points([1, 2]), fit).count() == 2
    assert walkforward.run_trials(spark, path, "in", points([2, 3]), fit).count() == 2
    assert walkforward.run_trials(spark, path, "in", points([1, 2, 3]), fit).count() == 3
    assert walkforward.run_trials(spark, path, "other", points([1]), fit).count() == 1
    assert made == [2, 1, 1]


@pytest.mark.parametrize("bound", [100, 100_000])
def test_quantiles_of_many_values_are_exact(spark, monkeypatch, bound):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", bound)
    values = np.random.default_rng(1).permutation(100_000) / 7
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": values})).unionByName(spark.createDataFrame([("b", 1.0), ("b", 2.0), (None, 5.0)], "k string, v double"))
    got = {r.k: r for r in ranking.quantiles(df, ["k"], "v", {"median": 0.5, "p999": 0.999}).collect()}
    assert np.allclose([got["a"].median, got["a"].p999], np.quantile(values, [0.5, 0.999])) and got["b"].median == 1.5 and got[None].median == 5.0


def test_every_cut_is_tried(spark):
    r = np.random.default_rng(2)
    pdf = pd.DataFrame({"center_id": r.choice(["A", "B"], 300), "score": r.integers(0, 40, 300) / 40, "y_pred": r.integers(0, 50, 300) / 8, "y_true": r.poisson(2, 300)})
    for groups in (None, ["A", "B"]):
        got = {row.cut: (row.wape, row.bias) for row in evaluation.cut_errors(spark.createDataFrame(pdf).withColumn("h", F.lit(1)), ["h"], "score", groups).collect()}
        assert set(got) == set(pdf.score)
        for cut, rates in got.items():
            parts = [pdf] if groups is None else [pdf[pdf.center_id == g] for g in groups]
            kept = [(np.where(p.score >= cut, p.y_pred, 0) - p.y_true, p.y_true.sum()) for p in parts]
            assert np.allclose(rates, [np.mean([100 * abs(e).sum() / y for e, y in kept]), np.mean([100 * e.sum() / y for e, y in kept])], atol=1e-5)


def test_moved_features_rank_by_what_they_carry(spark):
    r = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(600), "planted": r.integers(0, 30, 600).astype(float), "weak": r.integers(0, 3, 600).astype(float), "random": r.normal(size=600)})
    pdf["y_true"] = pdf.planted * 3 + pdf.weak * 4
    df = spark.createDataFrame(pdf).withColumn("y_log", F.log1p("y_true"))
    cols = ["random", "weak", "planted"]
    model = forecasting.fit_trees(df, cols, "y_log", "boosted", maxIter=5, maxDepth=4)
    out = forecasting.permutation_importance(model, df, cols, "y_true", ["id"], (1, 2)).toPandas()
    for _, one in out.groupby("seed"):
        assert one.sort_values("increase", ascending=False).feature.tolist() == ["planted", "weak", "random"]


def test_dense_numbers_need_no_single_task(spark):
    df = spark.createDataFrame([(f"v{k:04d}",) for k in range(500)], "c string")
    out = folds.dense_numbers(df, "c", "n")
    assert [r.n for r in out.orderBy("c").collect()] == list(range(1, 501))



def test_unusable_forecasts_are_replaced_by_scope(spark):
    inf = float("inf")
    rows = [("m", "A", "s1", 1, 5.0), ("m", "A", "s1", 2, inf), ("m", "A", "s2", 1, 900.0), ("m", "A", "s2", 2, 3.0), ("m", "A", "s3", 1, 1.0)]
    fc = spark.createDataFrame(rows, "model string, center_id string, sku_id string, horizon int, y_pred double").withColumn("week_st", F.lit(week(0)))
    dev = spark.createDataFrame([("A", "s1", 5, 2.0), ("A", "s2", 5, 1.0)], "center_id string, sku_id string, dev_max bigint, level double")
    marked = evaluation.instability(fc, dev.select("center_id", "sku_id", "dev_max"))
    scopes = {r.sku_id: (r.scope, r.n_total, r.n_inf, r.n_exceed, r.pct) for r in evaluation.instability_by_series(marked).collect()}
    assert scopes == {"s1": ("sku", 2, 1, 0, 50.0), "s2": ("row", 2, 0, 1, 50.0), "s3": ("none", 1, 0, 0, 0.0)}
    got = {(r.sku_id, r.horizon): r.y_override for r in evaluation.instability_override(marked, dev.select("center_id", "sku_id", "level")).collect()}
    assert got == {("s1", 1): 2.0, ("s1", 2): 2.0, ("s2", 1): 1.0}


def test_heavy_keys_are_split(spark):
    """Half of the rows on one key: no part of the join holds more than twice the median, and the rows are those of a plain join."""
    df = spark.range(64_000).select((F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 800)).cast("int").alias("k"), F.col("id").alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, -1), (9999, -2)], "k int, v bigint"))
    dim = spark.range(800).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("d"))
    got, want = skew.split_join(df, dim, ["k"]), df.join(dim, "k", "left")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    sizes = {}
    plain = skew.F.pmod
    parts = []
    skew.F.pmod = lambda *a: parts.append(plain(*a)) or parts[-1]
    try:
        skew.split_join(df, dim, ["k"])
    finally:
        skew.F.pmod = plain
    dealt = df.withColumn("p", F.when(F.col("k") == 0, parts[0]).otherwise(0)).groupBy("k", "p").count().collect()
    sizes = sorted(r["count"] for r in dealt if r.k == 0)
    assert len(sizes) == skew.SPREAD and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_place_days_keep_every_fact(spark):
    facts = spark.createDataFrame([("S", "c1", week(0), 1), ("S", "c1", week(0), 2), ("S", "c2", week(1), 3), (None, None, week(0), 4)], "sido string, city string, tx_date date, v int")
    keys = spark.createDataFrame([("S", "c1", "c1"), ("S", "c2", None)], "sido string, city string, weather_key string")
    weather = spark.createDataFrame([("S", "c1", week(0), 1.0, 2), ("S", None, week(1), 3.0, 4)], "sido string, sigungu string, date date, temp double, rain int")
    none = lambda schema: spark.createDataFrame([], schema)
    out = joins.star_enrich(facts, keys, weather, none("date date, holiday string"), none("date date, covid int"), none("y int, m int, cpi double"),
                            none("sido string, y int, m int, retail_current double, retail_constant int"), F.lit(week(0)), F.lit(week(2)))
    assert sorted((r.v, r.temp, r.rain) for r in out.collect() if r.v < 4) == [(1, 1.0, 2), (2, 1.0, 2), (3, 3.0, 4)] and out.count() == 4
