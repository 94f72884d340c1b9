"""Forecast metrics, common panels, model comparison and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockloom.functions.columns import div, r6
from stockloom.operators.marts import SKU
from stockloom.operators.profiling import union_all

# Selection rules.
BIAS_LIMIT = 20.0
NEAR_TIE = 1.0

ROW = [*SKU, "week_st", "horizon"]
ERR = "(y_pred - y_true)"


def metric_columns(pred: str = "y_pred", scale: bool = False) -> list[Column]:
    """WAPE, bias, RMSE, MAE (and MASE on rows with a usable scale)."""
    y, err = F.col("y_true").cast("double"), F.col(pred) - F.col("y_true")
    cols = [r6(div(F.sum(F.abs(err)), F.sum(y)) * 100).alias("wape"), r6(div(F.sum(err), F.sum(y)) * 100).alias("bias"),
            r6(F.sqrt(F.avg(err * err))).alias("rmse"), r6(F.avg(F.abs(err))).alias("mae"), F.count(F.lit(1)).alias("n")]
    if scale:
        cols += [r6(F.avg(F.abs(err) / F.col("mase_scale"))).alias("mase"), F.count("mase_scale").alias("mase_n")]
    return cols


def metrics(df: DataFrame, keys: list[str], pred: str = "y_pred", scale: bool = False) -> DataFrame:
    return (df.groupBy(*keys) if keys else df.groupBy()).agg(*metric_columns(pred, scale))


def scoped_metrics(df: DataFrame, keys: list[str], scale: bool = False) -> DataFrame:
    """By centre and for all centres together; ALL pools rows, it does not average centres."""
    sets = [[F.col("center_id"), *map(F.col, keys)], [*map(F.col, keys)]]
    out = df.groupingSets(sets, "center_id", *keys).agg(*metric_columns(scale=scale))
    return out.withColumn("scope", F.coalesce("center_id", F.lit("ALL"))).drop("center_id")


def mase_scale(history: DataFrame) -> DataFrame:
    """Mean absolute weekly change of each SKU's history; unknown when it cannot serve as a divisor."""
    step = F.abs(F.col("qty") - F.lag("qty").over(W.partitionBy(*SKU).orderBy("week_st")))
    out = history.withColumn("_d", step.cast("double")).groupBy(*SKU).agg(F.avg("_d").alias("_m"), F.count(F.lit(1)).alias("_n"))
    return out.select(*SKU, F.when((F.col("_n") >= 2) & (F.col("_m") > 0), F.col("_m")).alias("mase_scale"))


def panel_keys(df: DataFrame, models: int) -> DataFrame:
    """Keys that every model predicts, with one actual; from one shuffle over the long panel."""
    return (df.groupBy(*ROW).agg(F.count_distinct("model").alias("_m"), F.min("y_true").alias("_lo"), F.max("y_true").alias("_hi"))
            .where((F.col("_m") == models) & (F.col("_lo") == F.col("_hi"))).select(*ROW))


def common_panel(df: DataFrame, models: int) -> DataFrame:
    return df.join(panel_keys(df, models), ROW, "left_semi")


def key_bits(df: DataFrame, models: list[str]) -> DataFrame:
    """One row per key with a 0/1 column per model."""
    return df.groupBy(*ROW).agg(*[F.max(F.when(F.col("model") == m, 1).otherwise(0)).alias(m) for m in models])


def pairwise_common(df: DataFrame, models: list[str]) -> DataFrame:
    """Per model pair: shared keys, keys only one side has, and both sides' error on shared keys.

    The panel is folded to one row per key first; every pair is then a conditional sum.
    """
    per = df.groupBy(*ROW).agg(F.max("y_true").cast("double").alias("y"), *[
        F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in models])
    entries = {}
    for i, a in enumerate(models):
        for b in models[i + 1:]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            err = lambda m: div(F.sum(F.when(both, F.abs(F.col(m) - F.col("y")))), F.sum(F.when(both, F.col("y")))) * 100
            entries[f"{a}|{b}"] = {
                "common": F.count_if(both), "only_first": F.count_if(F.col(a).isNotNull() & F.col(b).isNull()),
                "only_second": F.count_if(F.col(b).isNotNull() & F.col(a).isNull()), "wape_first": r6(err(a)), "wape_second": r6(err(b))}
    from stockloom.operators.profiling import unpivot_counts
    return unpivot_counts(per, [], entries, "pair")


def oof_validate(df: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicates, missing or negative values and wrong target dates, in two passes."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n"))
    bad = {"not_finite": F.col("y_pred").isNull() | F.isnan("y_pred") | F.col("y_true").isNull(), "negative": F.col("y_pred") < 0,
           "target_date": F.col("target_date") != F.expr("date_add(week_st, 7 * horizon)")}
    from stockloom.operators.profiling import unpivot_counts
    rest = unpivot_counts(df, [], {n: {"n": F.count_if(F.coalesce(c, F.lit(False)))} for n, c in bad.items()}, "check")
    both = dup.select(F.lit("duplicates").alias("check"), F.col("n").cast("bigint").alias("violations")).unionByName(
        rest.select("check", F.col("n").alias("violations")))
    return both.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def cut_errors(df: DataFrame, keys: list[str], score: str, groups: list[str] | None = None) -> DataFrame:
    """Error and bias for every possible cut: rows whose ``score`` reaches it keep ``y_pred``, all others count as 0.

    Every distinct score is a cut, also 0 for "keep all". Running sums in score order give all of them from one aggregate. With ``groups``
    (centres) rates are taken per group and averaged, so one cut serves all of them. Predictions should be dyadic fractions: sums are then exact.
    """
    from stockloom.operators.ranking import running_sums
    y = F.col("y_true").cast("double")
    parts = {"": F.lit(True)} if groups is None else {f"_{g}": F.col("center_id") == g for g in groups}
    sums = {}
    for tag, own in parts.items():
        at = lambda v, own=own: F.coalesce(F.sum(F.when(own, v)), F.lit(0.0))
        sums |= {f"kept{tag}": at(F.abs(F.col("y_pred") - y)), f"bias{tag}": at(F.col("y_pred") - y), f"cut{tag}": at(F.abs(y)), f"y{tag}": at(y)}
    run = running_sums(df, keys, score, sums)
    rate = lambda tag, num: div(num, F.col(f"total_y{tag}")) * 100
    wapes = [rate(t, F.col(f"before_cut{t}") + F.col(f"total_kept{t}") - F.col(f"before_kept{t}")) for t in parts]
    biases = [rate(t, F.col(f"total_bias{t}") - F.col(f"before_bias{t}") - F.col(f"before_y{t}")) for t in parts]
    mean = lambda cols: div(sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)), sum((c.isNotNull().cast("int") for c in cols), F.lit(0)))
    return run.select(*keys, F.col(score).alias("cut"), r6(mean(wapes)).alias("wape"), r6(mean(biases)).alias("bias"))


def best_cut(df: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest WAPE, then bias in size, then cut; with the number of cuts tried."""
    order = F.struct("wape", F.abs("bias").alias("abs_bias"), "cut", "bias")
    picked = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.min(F.when(F.col("wape").isNotNull(), order)).alias("b"), F.count(F.lit(1)).alias("cuts"))
    return picked.select(*keys, "b.cut", F.col("b.wape").alias("val_wape"), F.col("b.bias").alias("val_bias"), "cuts")


def apply_cut(df: DataFrame, best: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Rates of the chosen cuts on other rows, beside those they were chosen by."""
    rows = df.join(F.broadcast(best), keys)  # a row per key
    p, y = F.when(F.col(score) >= F.col("cut"), F.col("y_pred")).otherwise(0.0), F.col("y_true").cast("double")
    return rows.groupBy(*keys, "cut", "val_wape", "val_bias", "cuts").agg(
        r6(div(F.sum(F.abs(p - y)), F.sum(y)) * 100).alias("hold_wape"), r6(div(F.sum(p - y), F.sum(y)) * 100).alias("hold_bias"))


def hurdle_combine(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Soft product and hard cut with one threshold per centre."""
    p, q = F.col("sale_probability"), F.col("conditional_qty")
    cut = reduce(lambda acc, kv: acc.when(F.col("center_id") == kv[0], kv[1]), thresholds.items(), F.when(F.lit(False), 0.0))
    return df.withColumns({"soft": p * q, "hard": F.when(p >= cut, q).otherwise(0.0)})


def quartile_edges(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    from stockloom.operators.ranking import quantiles
    q = quantiles(df, keys, value, {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0})
    return q.select(*keys, F.array_distinct(F.array("q0", "q1", "q2", "q3", "q4")).alias("edges"))


def cut_right(value: Column, edges: Column) -> Column:
    """Bin number from 1: right-closed bins, the lowest edge included, values outside get NULL."""
    inside = (value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1))
    below = F.size(F.filter(edges, lambda e: e < value))
    return F.when(inside & (F.size(edges) > 1), F.greatest(below, F.lit(1)))


def select_trial(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Within the bias limit, lowest WAPE; near ties go to the lowest worst fold."""
    w = W.partitionBy(*keys)  # one row per trial
    ok = trials.where(F.abs("pooled_bias") <= BIAS_LIMIT).withColumn("_best", F.min("pooled_wape").over(w))
    near = ok.where(F.col("pooled_wape") - F.col("_best") <= NEAR_TIE).withColumn("near_ties", F.count(F.lit(1)).over(w))
    rank = F.row_number().over(w.orderBy("worst_fold_wape", "pooled_wape", "trial"))
    return near.withColumn("_r", rank).where("_r = 1").drop("_r", "_best")


def representative_trial(trials: DataFrame, keys: list[str]) -> DataFrame:
    """The selected trial, else the lowest WAPE as a reference only."""
    chosen = select_trial(trials, keys).select(*keys, "trial", F.lit(1).alias("selected"))
    marked = trials.join(chosen, [*keys, "trial"], "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("selected"), "pooled_wape", "trial"))
    return marked.withColumn("_r", rank).where("_r = 1").drop("_r")


def seed_summary(df: DataFrame, keys: list[str], seeds: int = 3) -> DataFrame:
    """Pooled error per seed, worst fold over seed means, spread over seeds, and folds in which seeds differ in keys or actuals.

    A fold agrees if every seed has as many rows, the same keys and the same actuals; keys are compared by the sum of their hashes.
    """
    per = df.groupBy(*keys, "fold", "seed").agg(*metric_columns()[:1], F.count(F.lit(1)).alias("_n"), F.sum(F.xxhash64("center_id", "sku_id", "week_st", "y_true").cast("decimal(38,0)")).alias("_k"))
    folds = per.groupBy(*keys, "fold").agg(F.avg("wape").alias("fold_wape"), ((F.count_distinct("_n", "_k") == 1) & (F.count(F.lit(1)) == seeds)).alias("_same"))
    fold = folds.groupBy(*keys).agg(F.max("fold_wape").alias("worst_fold_wape"), F.count_if(~F.col("_same")).alias("disagreeing_folds"))
    pooled = metrics(df, [*keys, "seed"]).groupBy(*keys).agg(
        F.avg("wape").alias("mean_wape"), F.avg("bias").alias("mean_bias"), F.stddev_samp("wape").alias("seed_std"), F.count(F.lit(1)).alias("seeds"))
    return pooled.join(fold, keys)


def select_family(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bias gate, then near-tie WAPE, worst fold, seed spread and cost; each loser keeps the step it left at."""
    w = W.partitionBy(*keys)  # one row per model family
    alive = F.abs("mean_bias") <= BIAS_LIMIT
    out = df.withColumn("_a", alive.cast("int")).withColumn("eliminated_at", F.when(~alive, "bias_gate"))
    steps = [("wape_1pp", "mean_wape", NEAR_TIE), ("worst_fold", "worst_fold_wape", 0.0), ("seed_stability", "seed_std", 0.0), ("compute", "cost", 0.0)]
    for name, col, slack in steps:
        low = F.min(F.when(F.col("_a") == 1, F.col(col))).over(w)
        out = out.withColumn("_low", low)
        drop = (F.col("_a") == 1) & (F.col(col) - F.col("_low") > slack)
        out = out.withColumn("_d", drop).withColumns({
            "eliminated_at": F.when(F.col("_d"), name).otherwise(F.col("eliminated_at")), "_a": F.when(F.col("_d"), 0).otherwise(F.col("_a"))}).drop("_d", "_low")
    return out.withColumn("winner", F.col("_a")).drop("_a")


def instability(df: DataFrame, dev_max: DataFrame, factor: float = 100.0) -> DataFrame:
    """Predictions that are not finite or, in size, far above anything the SKU ever sold (at least 1)."""
    limit = F.greatest(F.coalesce(F.col("dev_max"), F.lit(0)), F.lit(1)) * factor
    bad = (F.abs("y_pred") == float("inf")) | F.isnan("y_pred")
    return df.join(dev_max, SKU, "left").withColumns({
        "limit": limit.cast("double"), "reason": F.when(bad, "not_finite").when(F.abs("y_pred") > limit, "above_limit")})


def instability_by_series(marked: DataFrame) -> DataFrame:
    """Counts of unusable forecasts per model and SKU, and what is to be replaced: the whole series once a value is not finite, else the rows."""
    per = marked.groupBy("model", *SKU).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("reason") == "not_finite").alias("n_inf"), F.count_if(F.col("reason") == "above_limit").alias("n_exceed"), F.max("limit").alias("limit"))
    bad = F.col("n_inf") + F.col("n_exceed")
    return per.withColumns({"pct": F.round(bad * 100.0 / F.col("n_total"), 1), "scope": F.when(F.col("n_inf") > 0, "sku").when(bad > 0, "row").otherwise("none")})


def instability_override(marked: DataFrame, level: DataFrame) -> DataFrame:
    """The rows that are replaced by their SKU's mean level (0 without history), with the scope that asks for it."""
    scopes = instability_by_series(marked).where("scope <> 'none'").select("model", *SKU, "scope")
    rows = marked.join(scopes, ["model", *SKU]).where("scope = 'sku' or reason is not null")
    return rows.join(level, SKU, "left").select("model", *SKU, "week_st", "horizon", "scope", "reason", F.coalesce("level", F.lit(0.0)).alias("y_override"))


def winner_share(df: DataFrame, a: str, b: str, measures: list[str], keys: list[str]) -> DataFrame:
    """Per measure: how many SKUs, and how much demand, each of two models wins; ties but for rounding errors, and SKUs without the measure."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(f"{a}_{m}").alias("x"), F.col(f"{b}_{m}").alias("y")) for m in measures]
    long = df.select(*keys, "demand", F.explode(F.array(*pairs)).alias("p"))
    x, y = F.col("p.x"), F.col("p.y")
    who = F.when(x.isNull() | y.isNull(), "excluded").when(F.abs(x - y) <= 1e-9 * F.greatest(x, y), "tie").when(x < y, a).otherwise(b)
    counts = long.groupBy(*keys, "p.metric", who.alias("winner")).agg(F.count(F.lit(1)).alias("skus"), F.sum("demand").alias("demand"))
    tot = counts.where("winner <> 'excluded'").groupBy(*keys, "metric").agg(F.sum("skus").alias("_s"), F.sum("demand").alias("_d"))
    share = lambda c, t: F.when(F.col("winner") != "excluded", r6(div(F.col(c), F.col(t))))
    return counts.join(tot, [*keys, "metric"], "left").select(*keys, "metric", "winner", "skus", "demand", share("skus", "_s").alias("sku_share"), share("demand", "_d").alias("demand_share"))
