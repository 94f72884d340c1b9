"""Series summaries, autocorrelation, spectra and rank correlation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockloom.functions.columns import div, r6
from stockloom.operators.marts import SKU
from stockloom.operators.ranking import average_rank, running_counts
from stockloom.sources.storage import pin


def history_summary(grid: DataFrame) -> DataFrame:
    q = F.col("qty")
    out = grid.groupBy(*SKU).agg(
        F.min("week_st").alias("first_week"), F.max("week_st").alias("last_week"), F.count(F.lit(1)).alias("weeks"), F.sum("sold").alias("active_weeks"),
        F.sum(q).alias("total_qty"), F.count_distinct(q).alias("unique_values"), F.min(q).alias("_lo"), F.max(q).alias("_hi"))
    return out.withColumns({
        "zero_ratio": r6(div(F.col("weeks") - F.col("active_weeks"), F.col("weeks"))), "all_zero": (F.col("active_weeks") == 0).cast("int"),
        "constant": (F.col("_lo") == F.col("_hi")).cast("int"),
        "has_gap": (F.datediff("last_week", "first_week") / 7 + 1 != F.col("weeks")).cast("int")}).drop("_lo", "_hi")


def center_week_summary(facts: DataFrame, value: str) -> DataFrame:
    """Weekly totals per centre described; the median is over one value per week."""
    week = facts.groupBy("center_id", "week_st").agg(F.sum(value).cast("double").alias("v"))
    return week.groupBy("center_id").agg(
        (F.datediff(F.max("week_st"), F.min("week_st")) / 7 + 1).cast("int").alias("expected_weeks"), F.count(F.lit(1)).alias("weeks"),
        r6(F.avg("v")).alias("mean"), r6(F.median("v")).alias("median"), r6(F.stddev_samp("v")).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        r6(div(F.count_if(F.col("v") == 0), F.count(F.lit(1)))).alias("zero_ratio")).withColumn("missing_weeks", F.col("expected_weeks") - F.col("weeks"))


def level_zero_ratio(grid: DataFrame, levels: list[str], short: int) -> DataFrame:
    """Zero ratios of the series at each hierarchy level, each over its own first to last week with demand, and how many series are short."""
    tags = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("key")) for x in levels])).alias("t")
    week = grid.select("center_id", "week_st", "qty", tags).groupBy("center_id", "t.level", "t.key", "week_st").agg(F.sum("qty").alias("q")).where("q <> 0")
    length = (F.datediff(F.max("week_st"), F.min("week_st")) / 7).cast("bigint") + 1
    one = week.groupBy("center_id", "level", "key").agg(length.alias("length"), F.count(F.lit(1)).alias("active"), F.sum("q").alias("s"))
    one = one.withColumns({"z": div(F.col("length") - F.col("active"), F.col("length")), "d": div(F.col("s"), F.col("length"))})
    share = lambda rule: r6(div(F.count_if(rule), F.count(F.lit(1))) * 100)
    return one.groupBy("center_id", "level").agg(
        F.count(F.lit(1)).alias("series"), r6(F.avg("z")).alias("zero_ratio"), r6(F.median("z")).alias("median_zero_ratio"), share(F.col("z") <= 0.1).alias("low_zero_pct"),
        r6(F.avg("d")).alias("mean_demand"), share(F.col("length") < short).alias("short_pct"))


def interval_distribution(facts: DataFrame, min_active: int = 5, top: int = 12) -> DataFrame:
    """Weeks between sales, with long gaps pooled."""
    w = W.partitionBy(*SKU).orderBy("week_st")
    gaps = facts.where("sales_qty > 0").withColumns({
        "_n": F.count(F.lit(1)).over(W.partitionBy(*SKU)), "_gap": (F.datediff("week_st", F.lag("week_st").over(w)) / 7).cast("int")})
    counts = gaps.where((F.col("_n") >= min_active) & F.col("_gap").isNotNull()).groupBy(
        "center_id", F.least("_gap", F.lit(top)).alias("weeks_between")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sku_id").alias("skus"))
    totals = counts.groupBy("center_id").agg(F.sum("n").alias("_t"))
    return counts.join(totals, "center_id").withColumn("share", r6(div(F.col("n"), F.col("_t")))).drop("_t")


def short_history(facts: DataFrame, longest: int) -> DataFrame:
    """SKUs by number of recorded weeks from 1 to ``longest``, empty lengths included."""
    lengths = facts.groupBy(*SKU).agg(F.count(F.lit(1)).alias("weeks"))
    sizes = lengths.groupBy("weeks").agg(F.count(F.lit(1)).alias("skus"))
    axis = facts.sparkSession.range(1, longest + 1).withColumnRenamed("id", "weeks")
    total = lengths.agg(F.count(F.lit(1))).scalar()
    return axis.join(sizes, "weeks", "left").withColumn("_t", total).select(
        "weeks", F.coalesce("skus", F.lit(0).cast("bigint")).alias("skus"), r6(div(F.coalesce("skus", F.lit(0)), F.col("_t"))).alias("rate"))


def volume_rank(sales: DataFrame, volume: DataFrame, k: int) -> DataFrame:
    """Share rank of each SKU's sales inside its centre (ties share the average rank), for the most traded."""
    ranks = average_rank(sales, ["center_id"], "sales_qty").select(
        "center_id", F.col("sales_qty").alias("_v"), (F.col("rank") / F.col("total")).alias("pct_rank")).withColumnRenamed("center_id", "_c")
    top = sales.join(volume, SKU).orderBy(F.desc("volume"), *SKU).limit(k)
    return top.join(ranks, (F.col("center_id") == F.col("_c")) & (F.col("sales_qty") == F.col("_v"))).drop("_c", "_v")


def weekly_series(facts: DataFrame, value: str) -> DataFrame:
    """One value per centre and week, numbered in time order."""
    week = facts.groupBy("center_id", "week_st").agg(F.sum(value).cast("double").alias("x"))
    return week.withColumn("t", F.row_number().over(W.partitionBy("center_id").orderBy("week_st")))


def acf(df: DataFrame, max_lag: int) -> DataFrame:
    """Centred autocorrelation per series and its confidence limit."""
    stats = df.groupBy("center_id").agg(F.avg("x").alias("_m"), F.count(F.lit(1)).alias("_n"))
    dev = df.join(stats, "center_id").withColumn("d", F.col("x") - F.col("_m"))
    w = W.partitionBy("center_id").orderBy("t")
    lagged = dev.withColumns({f"_l{k}": F.col("d") * F.lag("d", k).over(w) for k in range(1, max_lag + 1)})
    sums = lagged.groupBy("center_id").agg(F.sum(F.col("d") * F.col("d")).alias("_v"), F.max("_n").alias("_n"), *[F.sum(f"_l{k}").alias(f"_s{k}") for k in range(1, max_lag + 1)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_s{k}").alias("s")) for k in range(1, max_lag + 1)])).alias("e")
    return sums.select("center_id", "_v", "_n", rows).select(
        "center_id", "e.lag", r6(F.col("e.s") / F.col("_v")).alias("acf"), r6(F.lit(1.96) / F.sqrt("_n")).alias("limit"))


def periodogram(df: DataFrame, scaling: str = "spectrum") -> DataFrame:
    """One-sided power per frequency of the mean-free series.

    Every value is spread over the frequencies of its own (calendar-sized) series and summed, so
    no series is gathered in one place.
    """
    stats = df.groupBy("center_id").agg(F.avg("x").alias("_m"), F.count(F.lit(1)).alias("n"))
    pts = df.join(stats, "center_id").withColumn("f", F.explode(F.sequence(F.lit(1).cast("bigint"), F.floor(F.col("n") / 2))))
    angle = F.lit(2 * math.pi) * F.col("f") * (F.col("t") - 1) / F.col("n")
    x = F.col("x") - F.col("_m")
    sums = pts.groupBy("center_id", "n", "f").agg(F.sum(x * F.cos(angle)).alias("_re"), F.sum(x * F.sin(angle)).alias("_im"))
    scale = F.col("n") * F.col("n") if scaling == "spectrum" else F.col("n")
    fold = F.when(F.col("f") * 2 == F.col("n"), 1.0).otherwise(2.0)
    return sums.select("center_id", "f", (F.col("n") / F.col("f")).alias("period"),
                       (fold * (F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")) / scale).alias("power"))


def top_peaks(df: DataFrame, keys: list[str], value: str, ties: list[str], k: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc(value), *ties)  # one row per lag or frequency
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks, and the number of pairs.

    Equal pairs are counted first, so a value that most rows have (zero) is ranked and joined once per partner value.
    """
    pairs = pin(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_w")))
    out = pairs
    for col, name in ((x, "_rx"), (y, "_ry")):
        counts = running_counts(pairs, keys, col, "_w")
        ranks = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(col).alias("_v"), (F.col("before") + (F.col("n") + 1) / 2).alias(name))
        cond = F.col(col) == F.col("_v")
        for k in keys:
            cond = cond & (F.col(k) == F.col(f"_k_{k}"))
        out = out.join(ranks, cond).drop("_v", *[f"_k_{k}" for k in keys])
    n = F.sum("_w")
    mean = lambda c: F.sum(F.col("_w") * F.col(c)) / n
    m = out.groupBy(*keys).agg(n.alias("n"), mean("_rx").alias("_mx"), mean("_ry").alias("_my"))
    d = out.join(F.broadcast(m), keys)  # a row per slice
    dx, dy, w = F.col("_rx") - F.col("_mx"), F.col("_ry") - F.col("_my"), F.col("_w")
    rho = F.sum(w * dx * dy) / F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy))
    return d.groupBy(*keys).agg(r6(F.when(F.sum(w * dx * dx) * F.sum(w * dy * dy) > 0, rho)).alias("rho"), F.max("n").alias("n"))


def pairwise_corr(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Correlation and variances of every pair of columns per slice, in one aggregate."""
    from stockloom.operators.profiling import unpivot_counts
    entries = {f"{a}|{b}": {"corr": r6(F.corr(a, b)), "var_first": F.round(F.var_samp(a), 2), "var_second": F.round(F.var_samp(b), 2)}
               for i, a in enumerate(cols) for b in cols[i + 1:]}
    return unpivot_counts(df, keys, entries, "pair")


def candidate_score(df: DataFrame, k: int, z: float = 1.96) -> DataFrame:
    """Keep candidates that are strong raw and again after detrending or yearly change; best first."""
    need = F.lit(z) / F.sqrt(F.col("n") - 1)
    strong = lambda c: F.coalesce(F.abs(c) >= need, F.lit(False))
    kept = df.where(strong("raw") & (strong("detrended") | strong("yoy")))
    score = F.abs("raw") + F.greatest(F.coalesce(F.abs("detrended"), F.lit(0.0)), F.coalesce(F.abs("yoy"), F.lit(0.0)))
    return kept.withColumn("score", r6(score)).orderBy(F.desc("score"), "candidate").limit(k)
