"""Pooled regressions over many folds from one pass: weekly prefix sums of the normal equations.

A ridge fit needs nothing of its training rows but the sums of x x' and x y. The sums are added up per week once; what a fold may learn from is
a running sum up to its border, so hundreds of weekly folds, grid points and seeds are solved from one small table. Features enter as whole
thousandths of log1p and demand as it is, so all sums are exact integers and do not depend on the order of the rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockloom.operators.folds import Fold
from stockloom.operators.forecasting import SEASON, coldstart_means, with_levels
from stockloom.operators.marts import SKU
from stockloom.operators.series import series

FEATURES = ("last", "ma4", "season", "level", "category")  # x1 to x5; x0 is the constant
SIZE = 4  # unknowns of every family: the constant and three features
FAMILIES = {"recent": (0, 1, 2, 4), "seasonal": (0, 2, 3, 4), "pooled": (0, 2, 4, 5)}
LAMBDAS = (0.001, 1.0, 100.0, 10000.0)
LEAST_ROWS = 30
SUMS = [f"s{i}{j}" for i in range(6) for j in range(i, 6)] + [f"t{i}" for i in range(6)]
COEFS = [f"c{i}" for i in range(6)]
FIT_KEYS = ["model", "horizon", "trial", "seed", "fold"]


def milli(value: str) -> str:
    """Thousandths of log1p as a whole number; the same text is SQL on both sides."""
    return f"cast(floor(ln(1 + greatest({value}, 0)) * 1000 + 0.5) as bigint)"


def seed_group(key: str) -> str:
    """Which of three seeds leaves a row out (an eighth of all rows each), by a digest of its key."""
    return f"case when substr(md5({key}), 1, 1) < '2' then 1 when substr(md5({key}), 1, 1) < '4' then 2 when substr(md5({key}), 1, 1) < '6' then 3 else 0 end"


def sum_columns() -> list[str]:
    x = lambda i: "1000" if i == 0 else f"x{i}"
    return [f"sum(cast({x(i)} as bigint) * {x(j)})" for i in range(6) for j in range(i, 6)] + [f"sum(cast({x(i)} as bigint) * y_true)" for i in range(6)]


def solution() -> list[list[tuple[str, str]]]:
    """Steps of an L D L' solve of a (lower, a_ij) and b: expressions on the names before them, one list per level of nesting."""
    steps: list[list[tuple[str, str]]] = []
    minus = lambda first, terms: " - ".join([first, *terms])
    for j in range(SIZE):
        steps.append([(f"d{j}", minus(f"a{j}{j}", [f"l{j}{k} * l{j}{k} * d{k}" for k in range(j)]))])
        steps.append([(f"l{i}{j}", f"({minus(f'a{i}{j}', [f'l{i}{k} * l{j}{k} * d{k}' for k in range(j)])}) / d{j}") for i in range(j + 1, SIZE)]
                     + [(f"z{j}", minus(f"b{j}", [f"l{j}{k} * z{k}" for k in range(j)]))])
    for i in reversed(range(SIZE)):
        steps.append([(f"w{i}", minus(f"z{i} / d{i}", [f"l{k}{i} * w{k}" for k in range(i + 1, SIZE)]))])
    return steps


def family_terms(name: str) -> dict[str, str]:
    """The normal equations of a family, features in units of log1p, without the ridge."""
    use = FAMILIES[name]
    part = lambda i, j: f"cast(s{min(i, j)}{max(i, j)} as double) / 1e6"
    return {**{f"a{i}{j}": part(use[i], use[j]) for i in range(SIZE) for j in range(i + 1)}, **{f"b{i}": f"cast(t{use[i]} as double) / 1e3" for i in range(SIZE)}}


def coefficient(i: int) -> str:
    """The weight of x_i, zero for features that a family does not use."""
    return "case model " + " ".join(f"when '{m}' then w{use.index(i)}" for m, use in FAMILIES.items() if i in use) + " else 0e0 end"


# Predictions are whole 8192nds, so that sums of errors are exact too.
PREDICTION = f"floor(greatest(c0 + {' + '.join(f'c{i} * (x{i} / 1e3)' for i in range(1, 6))}, 0e0) * 8192 + 0.5) / 8192"


def definition(*more) -> str:
    """A digest of all that makes a fit besides its input and its key, so that a trial table never mixes fits of different rules."""
    return hashlib.md5(repr((FEATURES, FAMILIES, LEAST_ROWS, SUMS, sum_columns(), solution(), [family_terms(m) for m in FAMILIES], PREDICTION, SEASON, milli("x"), seed_group("x"), more)).encode()).hexdigest()


def origin_rows(grid: DataFrame, horizons, end, levels: list[str]) -> DataFrame:
    """Per SKU, week and horizon the actual and the features known then, as whole thousandths of log1p. All windows share one partitioning."""
    known = with_levels(coldstart_means(grid, levels))
    steps = {}
    for h in horizons:
        steps[f"_y{h}"] = F.when(F.date_add("week_st", 7 * h) <= end, F.lead("qty", h).over(series()))
        steps[f"_s{h}"] = F.coalesce(F.lag(F.col("qty").cast("double"), SEASON - h).over(series()), F.col("p_level"))
    known = known.withColumns(steps).withColumn("_c", F.coalesce(*[F.col(f"m_{x}") for x in levels], F.col("m_center"), F.lit(0.0)))
    each = [F.struct(F.lit(h).alias("horizon"), F.date_add("week_st", 7 * h).alias("target_date"), F.col(f"_y{h}").alias("y_true"), F.expr(milli("p_last")).alias("x1"), F.expr(milli("p_ma4")).alias("x2"),
                     F.expr(milli(f"_s{h}")).alias("x3"), F.expr(milli("p_level")).alias("x4"), F.expr(milli("_c")).alias("x5")) for h in horizons]
    rows = known.select(*SKU, "week_st", F.explode(F.array(*each)).alias("r")).select(*SKU, "week_st", "r.*").where("y_true is not null")
    return rows.withColumn("g", F.expr(seed_group("concat_ws('|', center_id, sku_id, cast(week_st as string))")))


def mark_folds(rows: DataFrame, folds: list[Fold], center: str, start: str, last: str) -> DataFrame:
    """The validation fold of each row: by target quarter for other centres (1, 2, ...), by week for ``center`` (101, 102, ...); null for none.

    Weeks are numbered per horizon over the weeks that have rows, as walk-forward folds are.
    """
    day = lambda d: F.lit(d).cast("date")
    own = (F.col("center_id") == center) & (F.col("week_st") >= day(start)) & (F.col("target_date") <= day(last))
    weeks = rows.where(own).select("horizon", "week_st").distinct().withColumn("_n", F.row_number().over(W.partitionBy("horizon").orderBy("week_st")) + 100)
    quarter = reduce(lambda acc, kf: acc.when(F.col("target_date").between(day(kf[1].val_start), day(kf[1].val_end)), kf[0]), enumerate(folds, 1), F.when(F.lit(False), 0))
    marked = rows.join(F.broadcast(weeks), ["horizon", "week_st"], "left")  # a row per week and horizon
    return marked.withColumn("fold", F.when(F.col("center_id") != center, quarter).when(own, F.col("_n"))).drop("_n")


def fold_borders(marked: DataFrame, folds: list[Fold], center: str) -> DataFrame:
    """(horizon, pool, fold, border): training targets lie before the border. Pool ``own`` learns from the centre itself, ``all`` from every usable row."""
    seen = marked.where("fold is not null").groupBy("horizon", "fold").agg(F.min("target_date").alias("_first"))
    starts = F.element_at(F.array(*[F.lit(f.val_start).cast("date") for f in folds]), F.least(F.col("fold"), F.lit(len(folds))))
    return seen.select("horizon", F.when(F.col("fold") > 100, "all").otherwise("own").alias("pool"), "fold", F.when(F.col("fold") > 100, F.col("_first")).otherwise(starts).alias("border"))


def fold_sums(marked: DataFrame, borders: DataFrame, center: str, start: str, seeds) -> DataFrame:
    """The normal equations of every (horizon, fold, seed): running sums over a table with a row per centre, week, horizon and seed group."""
    usable = (F.col("center_id") != center) | (F.col("week_st") >= F.lit(start).cast("date"))
    weekly = marked.where(usable).groupBy("center_id", "horizon", F.col("target_date").alias("day"), "g").agg(F.count(F.lit(1)).alias("n"), *[F.expr(e).alias(c) for c, e in zip(SUMS, sum_columns(), strict=True)])
    pools = F.when(F.col("center_id") == center, F.array(F.lit("all"))).otherwise(F.array(F.lit("own"), F.lit("all")))
    numbers = F.array(*[F.lit(k) for k in seeds])
    data = weekly.withColumn("pool", F.explode(pools)).withColumn("seed", F.explode(numbers)).where("g <> seed or seed = 0")
    data = data.select("horizon", "pool", "seed", "day", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("fold"), "n", *SUMS)
    ends = borders.withColumn("seed", F.explode(numbers)).select("horizon", "pool", "seed", F.col("border").alias("day"), F.lit(0).alias("kind"), "fold", *[F.lit(0).cast("bigint").alias(c) for c in ("n", *SUMS)])
    w = W.partitionBy("horizon", "pool", "seed").orderBy("day", "kind").rowsBetween(W.unboundedPreceding, 0)
    summed = data.unionByName(ends).select("horizon", "seed", "fold", "kind", *[F.sum(c).over(w).alias(c) for c in ("n", *SUMS)])
    return summed.where(f"kind = 0 and n >= {LEAST_ROWS}").drop("kind")


def solve(sums: DataFrame, wanted: DataFrame) -> DataFrame:
    """Coefficients for every wanted (model, horizon, trial, ridge, seed, fold) that has enough training rows."""
    out = wanted.join(F.broadcast(sums), ["horizon", "seed", "fold"])
    terms = {m: family_terms(m) for m in FAMILIES}
    named = {t: f"case model {' '.join(f'when {m!r} then {terms[m][t]}' for m in FAMILIES)} end" for t in terms["recent"]}
    out = out.selectExpr(*FIT_KEYS, "ridge", "n as train_rows", *[f"{e}{' + ridge' if t[0] == 'a' and t[1] == t[2] != '0' else ''} as {t}" for t, e in named.items()])
    for step in solution():
        out = out.selectExpr("*", *[f"{e} as {c}" for c, e in step])
    return out.selectExpr(*FIT_KEYS, "ridge", "train_rows", *[f"{coefficient(i)} as c{i}" for i in range(6)])


def predict(marked: DataFrame, coefs: DataFrame) -> DataFrame:
    """Validation rows with the predictions of all given fits of their fold."""
    return marked.where("fold is not null").join(F.broadcast(coefs), ["horizon", "fold"]).withColumn("y_pred", F.expr(PREDICTION))  # a row per fit


def fit_and_score(marked: DataFrame, sums: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row per fit: its coefficients and the additive errors on its fold."""
    coefs = solve(sums, wanted)
    err = F.col("y_pred") - F.col("y_true")
    errors = predict(marked, coefs).groupBy(*FIT_KEYS).agg(F.sum(F.abs(err)).alias("e"), F.sum(err).alias("b"), F.sum(err * err).alias("q"), F.sum("y_true").alias("y"), F.count(F.lit(1)).alias("val_rows"))
    return coefs.join(errors, FIT_KEYS)


def finished(spark: SparkSession, path: str, mark: str) -> DataFrame | None:
    """The fits of a trial table that belong to the input marked ``mark``; None before the first one."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        return None
    return table.where(F.col("input") == mark).dropDuplicates(FIT_KEYS)


def run_trials(spark: SparkSession, path: str, mark: str, wanted: DataFrame, fit) -> DataFrame:
    """The trial table's rows for ``wanted``. Fits that it already holds for this input are not made again; new ones are appended.

    The table lies in shared storage, keyed by grid point, fold, seed and a fingerprint of the input. Two runs that append the same fit
    at once write the same row twice; readers take one.
    """
    have = finished(spark, path, mark)
    todo = wanted if have is None else wanted.join(have, FIT_KEYS, "left_anti")
    if have is None or not todo.isEmpty():
        fit(todo).withColumn("input", F.lit(mark)).write.mode("append").parquet(path)
    return finished(spark, path, mark).join(wanted.select(*FIT_KEYS), FIT_KEYS, "left_semi").drop("input")


def common_folds(fits: DataFrame) -> DataFrame:
    """Fits of the (horizon, fold) pairs that every (model, trial, seed) of the table has, with equal keys and actuals.

    A fold is predicted whole or not at all, so keys common to all trials are the rows of these folds.
    """
    points = fits.select("model", "trial", "seed").distinct().count()
    same = fits.groupBy("horizon", "fold").agg(F.count(F.lit(1)).alias("_n"), F.min("val_rows").alias("_a"), F.max("val_rows").alias("_b"), F.min("y").alias("_c"), F.max("y").alias("_d"))
    return fits.join(F.broadcast(same.where((F.col("_n") == points) & (F.col("_a") == F.col("_b")) & (F.col("_c") == F.col("_d"))).select("horizon", "fold")), ["horizon", "fold"], "left_semi")


def rate(a: str, b: str) -> Column:
    return F.col(a) / F.when(F.col(b) != 0, F.col(b)) * 100
