"""Time-series features on dense SKU-week grids.

All per-series windows share one partitioning (centre, SKU) and one order, so a feature table
costs a single shuffle and sort. A series is bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockloom.functions import columns as C
from stockloom.operators.marts import SKU, densify
from stockloom.sources.storage import written

# Feature settings.
LAGS = (1, 2, 4)
ROLL = 4
COLDSTART_WEEKS = 8
WARMUP_ROWS = 52
MAX_WIDEN_WEEKS = 8

LEVELS = ("cat_s", "cat_m", "cat_l")


def series():
    return W.partitionBy(*SKU).orderBy("week_st")


def earlier():
    return series().rowsBetween(W.unboundedPreceding, -1)


def so_far():
    return series().rowsBetween(W.unboundedPreceding, W.currentRow)


def weekly_grid(tx: DataFrame, floor: Column, end: Column) -> DataFrame:
    """Weekly rows from the earlier of first stock and first sale up to ``end``; no sale means 0.

    Transactions are read once: sales and first inbound dates are summed to SKU, week and category
    in the same aggregate. Everything after it shares the (centre, SKU) partitioning.
    """
    sale, inbound = F.col("kind") == "sales", F.col("work_type") == "inbound"
    week = tx.groupBy(*SKU, "week_st", *LEVELS).agg(
        F.sum(F.when(sale, F.greatest("qty", F.lit(0)))).alias("q"), F.min(F.when(inbound, F.col("tx_date"))).alias("_stock"))
    whole = W.partitionBy(*SKU)
    known = F.when(F.col("q").isNotNull(), F.col("week_st"))
    described = week.select(
        *SKU, "week_st", "q", F.min(known).over(whole).alias("_seen"), F.min("_stock").over(whole).alias("_first"),
        *[F.min(F.when(F.col("q").isNotNull(), F.struct("week_st", c))).over(whole)[c].alias(c) for c in LEVELS])
    active = (described.where("q is not null").groupBy(*SKU, *LEVELS, "_seen", "_first", "week_st").agg(F.sum("q").alias("qty")))
    begin = C.week_start(F.greatest(F.least(F.coalesce("_first", "_seen"), F.col("_seen")), floor))
    dense = densify(active, SKU, "week_st", 7, end, {"qty": F.lit(0).cast("bigint")}, begin=begin)
    return dense.drop("_seen", "_first").withColumns({
        "sold": (F.col("qty") > 0).cast("int"),
        "qty_log1p": F.when(F.col("qty") > 0, F.log1p(F.col("qty").cast("double")))})


def add_lags(df: DataFrame, lags=LAGS) -> DataFrame:
    out = df.withColumns({f"lag{n}": F.lag("qty", n).over(series()) for n in lags})
    return out.withColumns({f"lag{n}_log1p": F.when(F.col(f"lag{n}").isNotNull(), C.log1p_clip(F.col(f"lag{n}"))) for n in lags})


def add_rolling(df: DataFrame, n: int = ROLL) -> DataFrame:
    """Trailing mean and sample deviation including the current row; unknown until n values exist."""
    w = series().rowsBetween(-(n - 1), 0)
    full = F.count("qty").over(w) == n
    q = F.col("qty").cast("double")
    return df.withColumns({f"roll_mean_{n}": F.when(full, F.avg(q).over(w)), f"roll_std_{n}": F.when(full, F.stddev_samp(q).over(w))})


def add_calendar(df: DataFrame, col: str = "week_st") -> DataFrame:
    return df.withColumns({"iso_week": F.weekofyear(col), "month": F.month(col), "quarter": F.quarter(col)})


def weeks_between(later: Column, earlier: Column) -> Column:
    return F.floor(F.datediff(later, earlier) / 7).cast("int")


def add_activity(df: DataFrame) -> DataFrame:
    sale_week = F.when(F.col("sold") == 1, F.col("week_st"))
    out = df.withColumn("last_active_week", F.last(sale_week, ignorenulls=True).over(so_far()))
    return out.withColumn("weeks_since_active", weeks_between(F.col("week_st"), F.col("last_active_week")))


def add_warmup(df: DataFrame, rows: int = WARMUP_ROWS) -> DataFrame:
    return df.withColumn("is_warmup", (F.row_number().over(series()) <= rows).cast("int"))


def first_sale() -> Column:
    """First sale so far; before it the value is unknown, which is all a row needs to know."""
    return F.min(F.when(F.col("sold") == 1, F.col("week_st"))).over(so_far())


def add_coldstart(df: DataFrame, weeks: int = COLDSTART_WEEKS, veteran: str | None = None) -> DataFrame:
    out = df.withColumn("_fs", first_sale())
    cold = F.col("_fs").isNull() | (weeks_between(F.col("week_st"), F.col("_fs")) + 1 < weeks)
    if veteran:
        cold = cold & (F.col(veteran) == 0)
    return out.withColumn("coldstart", cold.cast("int")).drop("_fs")


def add_intermittency(df: DataFrame) -> DataFrame:
    """Demand interval and squared variation from the rows before the current one.

    The variation n(nQ - S^2) / ((n - 1)S^2) is exact: whole-number sums, rounded half up to six places by whole division.
    """
    out = df.withColumns({"_fs": first_sale(), "_n": F.sum("sold").over(earlier())})
    sold_q = F.when(F.col("sold") == 1, F.col("qty").cast("decimal(18,0)"))
    out = out.withColumns({
        "_c": F.count(sold_q).over(earlier()).cast("decimal(18,0)"), "_m": F.sum(sold_q).over(earlier()).cast("decimal(18,0)"),
        "_s": F.sum((sold_q * sold_q).cast("decimal(28,0)")).over(earlier()).cast("decimal(28,0)")})
    exact = F.expr("""cast((2000000 * cast(_c * (_c * _s - _m * _m) as decimal(38,0)) + cast((_c - 1) * _m * _m as decimal(38,0)))
                      div (2 * cast((_c - 1) * _m * _m as decimal(38,0))) as double) / 1000000""")
    at_sale = F.when((F.col("sold") == 1) & (F.col("_c") >= 2) & (F.col("_m") > 0), exact)
    return out.withColumns({
        "adi": C.div(weeks_between(F.col("week_st"), F.col("_fs")), F.col("_n")),
        "cv2": F.last(at_sale, ignorenulls=True).over(so_far())}).drop("_fs", "_n", "_c", "_m", "_s")


def features(df: DataFrame, veteran: str | None = None) -> DataFrame:
    out = add_intermittency(add_coldstart(add_warmup(add_activity(add_rolling(add_lags(df)))), veteran=veteran))
    return add_calendar(out)


def horizon_targets(df: DataFrame, horizons, end: Column) -> DataFrame:
    """Quantity, sold flag and log quantity h weeks ahead; unknown past the end of the data."""
    out = df
    for h in horizons:
        inside = F.date_add("week_st", 7 * h) <= end
        out = out.withColumns({
            f"target_h{h}": F.when(inside, F.lead("qty", h).over(series())),
            f"target_h{h}_sold": F.when(inside, F.lead("sold", h).over(series())),
            f"target_h{h}_log1p": F.when(inside, F.lead("qty_log1p", h).over(series()))})
    return out


def category_fallback(df: DataFrame, cols: list[str], max_weeks: int = MAX_WIDEN_WEEKS) -> DataFrame:
    """Fill unknown features from the same week of ever wider groups, then from earlier weeks.

    Order: level 3, 2, 1 and centre mean of the week; the nearest earlier week with values up to
    ``max_weeks`` back; the mean of all weeks so far. The series rows are aggregated once to
    (centre, week, categories). Every other table is derived from that small one and joined to it,
    so the series rows are shuffled for one join only. Means are exact: values count in millionths,
    and a mean is rounded half up to six places by whole division.
    """
    both = lambda c: [F.sum(F.round(F.col(c).cast("double") * 1000000).cast("decimal(20,0)")).alias(f"{c}_s"), F.count(c).alias(f"{c}_n")]
    merge = lambda c: [F.sum(f"{c}_s").cast("decimal(30,0)").alias(f"{c}_s"), F.sum(f"{c}_n").alias(f"{c}_n")]
    flat = lambda make: [a for c in cols for a in make(c)]
    mean_of = lambda c: F.expr(f"cast((2 * {c}_s + {c}_n) div (2 * nullif({c}_n, 0)) as double) / 1000000")
    keys = ["center_id", "week_st"]
    base = written(df.groupBy(*keys, *LEVELS).agg(*flat(both)), "fallback-base")
    groups = base.select(*keys, *LEVELS)
    for level in LEVELS:
        table = base.where(F.col(level).isNotNull()).groupBy(*keys, level).agg(*flat(merge)).select(*keys, level, *[mean_of(c).alias(f"{c}_{level}") for c in cols])
        groups = groups.join(table, [*keys, level], "left")
    week = base.groupBy(*keys).agg(*flat(merge))
    w = W.partitionBy("center_id").orderBy("week_st")  # one row per week
    back, run = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    week = week.withColumns({f"{c}_{x}r": F.sum(f"{c}_{x}").over(run) for c in cols for x in "sn"})
    weekly = []
    for c in cols:
        known = F.when(F.col(f"{c}_n") > 0, F.struct(F.col("week_st").alias("w"), mean_of(c).alias("v")))
        weekly += [mean_of(c).alias(f"{c}_week"), F.last(known, ignorenulls=True).over(back).alias(f"{c}_near"),
                   F.expr(f"cast((2 * {c}_sr + {c}_nr) div (2 * nullif({c}_nr, 0)) as double) / 1000000").alias(f"{c}_run")]
    groups = groups.join(week.select(*keys, *weekly), keys, "left")
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"g.{k}")) for k in (*keys, *LEVELS)]
    out = df.alias("d").join(groups.alias("g"), same, "left").select("d.*", *[f"g.{n}" for n in groups.columns if n not in (*keys, *LEVELS)])
    for c in cols:
        age = weeks_between(F.col("week_st"), F.col(f"{c}_near.w"))
        near = F.when(age <= max_weeks, F.col(f"{c}_near.v"))
        own = F.col(c).cast("double")
        steps = [(f"{c}_cat_s", "level3"), (f"{c}_cat_m", "level2"), (f"{c}_cat_l", "level1"), (f"{c}_week", "center_week")]
        source = F.when(own.isNotNull(), F.lit(None))
        for name, label in steps:
            source = source.when(F.col(name).isNotNull(), label)
        source = source.when(near.isNotNull(), F.concat(F.lit("widen"), age.cast("string"))).when(F.col(f"{c}_run").isNotNull(), "expanding")
        out = out.withColumns({f"{c}_filled": F.coalesce(own, *[F.col(n) for n, _ in steps], near, F.col(f"{c}_run")),
                               f"{c}_source": source})
    helpers = [f"{c}_{x}" for c in cols for x in (*LEVELS, "week", "near", "run")]
    return out.drop(*helpers)


def holiday_windows(df: DataFrame, holidays: DataFrame, horizons) -> DataFrame:
    """Whether the target week, the one before or the one after holds a holiday."""
    weeks = holidays.agg(F.collect_set(C.week_start(F.col("date")))).scalar()
    out = {}
    for h in horizons:
        for name, shift in (("", 0), ("_before", -1), ("_after", 1)):
            out[f"holiday_h{h}{name}"] = F.array_contains(weeks, F.date_add("week_st", 7 * (h + shift))).cast("int")
    return df.withColumns(out)


def heavy_rain_weeks(df: DataFrame, region: list[str], threshold: float) -> DataFrame:
    """Days on which the regions of a centre average at least ``threshold`` of rain."""
    day = df.select("center_id", *region, "tx_date", "rain").distinct().groupBy("center_id", "tx_date").agg(F.avg("rain").alias("r"))
    week = day.groupBy("center_id", C.week_start(F.col("tx_date")).alias("week_st")).agg(
        F.count_if(F.col("r") >= threshold).alias("heavy_days"))
    return week.withColumn("heavy_flag", (F.col("heavy_days") > 0).cast("int"))


def run_length(df: DataFrame) -> DataFrame:
    """Length of the current unbroken run of weeks."""
    out = df.withColumns({"_rn": F.row_number().over(series()), "_prev": F.lag("week_st").over(series())})
    start = F.when(F.col("_prev").isNull() | (F.datediff("week_st", "_prev") != 7), F.col("_rn"))
    return out.withColumn("run", (F.col("_rn") - F.last(start, ignorenulls=True).over(so_far()) + 1).cast("int")).drop("_rn", "_prev")


def encoder_windows(df: DataFrame, cols: list[str], length: int, target: str) -> DataFrame:
    """The last ``length`` rows as an array, where they are unbroken and the target is known."""
    w = series().rowsBetween(-(length - 1), 0)
    out = run_length(df).withColumn("window", F.collect_list(F.struct("week_st", *cols)).over(w))
    return out.where((F.col("run") >= length) & F.col(target).isNotNull())


def encoder_decoder_long(windows: DataFrame, cols: list[str], horizon: int) -> DataFrame:
    """Windows as rows (origin, time index), plus one row for the target with the last known values."""
    keys = [*SKU, F.col("week_st").alias("origin")]
    enc = windows.select(*keys, F.posexplode("window").alias("time_idx", "e")).select(
        *SKU, "origin", "time_idx", F.col("e.week_st").alias("date"), *[F.col(f"e.{c}").alias(c) for c in cols], F.lit(0).alias("is_decoder"))
    last = F.element_at("window", -1)
    dec = windows.select(*keys, F.size("window").alias("time_idx"), F.date_add("week_st", 7 * horizon).alias("date"),
                         *[last[c].alias(c) for c in cols], F.lit(1).alias("is_decoder"))
    return add_calendar(enc.unionByName(dec), "date")


def decoder_context(windows: DataFrame, label_len: int, horizon: int) -> DataFrame:
    """The last encoder steps followed by the known future step."""
    future = F.struct(F.date_add("week_st", 7 * horizon).alias("week_st"))
    tail = F.transform(F.slice("window", -label_len, label_len), lambda x: F.struct(x["week_st"].alias("week_st")))
    return windows.withColumn("decoder", F.concat(tail, F.array(future)))


def context_tail(df: DataFrame, cols: list[str], length: int, target: str, start: Column) -> tuple[DataFrame, DataFrame]:
    """Windows over development and holdout together, kept for holdout origins, and the count of missing ones."""
    held = df.where(F.col("week_st") >= start)
    windows = encoder_windows(df, cols, length, target).where(F.col("week_st") >= start)
    missing = held.join(windows.select(*SKU, "week_st"), [*SKU, "week_st"], "left_anti")
    return windows, missing


def monthly_lags(df: DataFrame, monthly: DataFrame, value: str, offsets: dict[str, int], date: str = "week_st") -> DataFrame:
    """Monthly indicator at month offsets from the month of each row.

    Every offset is a column of one table with a row per month, so the rows meet the months once.
    """
    by_month = monthly.select(C.month_index(F.col("y"), F.col("m")).alias("_mi"), F.col(value).alias("_v"))
    moved = by_month.select(F.explode(F.array(*[F.struct((F.col("_mi") - off).alias("_mi0"), F.lit(name).alias("_o")) for name, off in offsets.items()])).alias("_e"), "_v").select("_e.*", "_v")
    table = moved.groupBy("_mi0").agg(*[F.max(F.when(F.col("_o") == name, F.col("_v"))).alias(name) for name in offsets])
    return df.withColumn("_mi0", C.month_index(F.year(date), F.month(date))).join(F.broadcast(table), "_mi0", "left").drop("_mi0")  # a row per month


def yoy_pct(df: DataFrame, group: str, value: str) -> DataFrame:
    w = W.partitionBy(group).orderBy("y", "m")
    before = F.lag(value, 12).over(w)
    return df.withColumn("yoy", (F.col(value) / before - 1) * 100)


def linear_detrend(df: DataFrame, group: str, value: str) -> DataFrame:
    placed = df.withColumn("_x", (F.row_number().over(W.partitionBy(group).orderBy("y", "m")) - 1).cast("double"))
    line = placed.groupBy(group).agg(F.regr_slope(value, "_x").alias("_b"), F.regr_intercept(value, "_x").alias("_a"))
    return placed.join(line, group).withColumn("residual", F.col(value) - (F.col("_a") + F.col("_b") * F.col("_x"))).drop("_x", "_a", "_b")


def interpolate_linear(df: DataFrame, keys: list[str], time: str, col: str) -> DataFrame:
    """Fill gaps on a straight line by row position; leading gaps stay, trailing gaps repeat the last value."""
    w = W.partitionBy(*keys).orderBy(time)
    placed = df.withColumn("_p", F.row_number().over(w))
    known = F.when(F.col(col).isNotNull(), F.struct("_p", F.col(col).alias("v")))
    placed = placed.withColumns({
        "_a": F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "_b": F.first(known, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))})
    step = (F.col("_b.v") - F.col("_a.v")) / (F.col("_b._p") - F.col("_a._p"))
    line = F.col("_a.v") + step * (F.col("_p") - F.col("_a._p"))
    return placed.withColumn(col, F.when(F.col(col).isNotNull(), F.col(col)).when(F.col("_b").isNull(), F.col("_a.v"))
                             .otherwise(line)).drop("_p", "_a", "_b")


def null_prefix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Length of the leading run of weeks in which every column is unknown."""
    empty = F.coalesce(*cols).isNull().cast("int")
    return (df.withColumn("_run", F.min(empty).over(so_far())).groupBy(*SKU)
            .agg(F.sum("_run").alias("null_prefix_weeks"), F.count(F.lit(1)).alias("weeks")))


def regime_filter(df: DataFrame, center: str, start: str) -> DataFrame:
    """Drop a centre's rows before its regime start; remember which SKUs sold before it."""
    border = F.lit(start).cast("date")
    before = (F.col("center_id") == center) & (F.col("week_st") < border)
    old = F.max(F.when(before & (F.col("qty") > 0), 1).otherwise(0)).over(W.partitionBy(*SKU))
    return df.withColumn("existed_before_regime", old).where(~before)


def split_by_date(df: DataFrame, borders: list[tuple[str, str]], last: str) -> DataFrame:
    """Label rows by the first border their week lies before."""
    label = None
    for date, name in borders:
        rule = F.col("week_st") < F.lit(date).cast("date")
        label = F.when(rule, name) if label is None else label.when(rule, name)
    return df.withColumn("split", label.otherwise(last))


def share_rank(df: DataFrame, key: str, value: str) -> DataFrame:
    """Share of the total and descending rank. For aggregated results: one row per category or region."""
    total = df.agg(F.sum(value).cast("double")).scalar()
    rank = F.row_number().over(W.orderBy(F.desc(value), key))
    return df.withColumns({"share": F.when(total > 0, F.col(value).cast("double") / total).otherwise(0.0), "rank": rank})


def moving_avg(df: DataFrame, keys: list[str], time: str, value: str, n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(time).rowsBetween(-(n - 1), 0)
    return df.withColumn(f"avg_{n}", F.avg(F.col(value).cast("double")).over(w))


def exog_future(origins: DataFrame, monthly: DataFrame, weekly: DataFrame, steps: int) -> DataFrame:
    """Per origin the next steps: sentiment held at the origin, lagged index and flags taken at the target week."""
    rows = origins.select("week_st", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).withColumn(
        "target_week", F.date_add("week_st", F.col("step") * 7))
    held = monthly_lags(rows, monthly, "cpi", {"sentiment": -1}, "week_st")
    lagged = monthly_lags(held, monthly, "cpi", {"cpi_lag3": -3}, "target_week")
    return lagged.join(weekly.withColumnRenamed("week_st", "target_week"), "target_week", "left")


def exog_consistency(df: DataFrame, time: str, cols: list[str]) -> DataFrame:
    """Weeks in which an external column takes more than one value."""
    spread = df.groupBy(time).agg(*[F.count_distinct(c).alias(c) for c in cols])
    return spread.unpivot([time], cols, "column_name", "distinct_values").where("distinct_values > 1")
