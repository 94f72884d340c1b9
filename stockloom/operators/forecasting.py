"""Forecasts as Spark jobs: baselines by window, per-series fits, and MLlib models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockloom.functions import columns as C
from stockloom.operators.marts import SKU
from stockloom.operators.series import series, so_far
from stockloom.sources.storage import written

SEASON = 52
SHORT_HISTORY = 6


def series_class(df: DataFrame, short: int = SHORT_HISTORY) -> DataFrame:
    """Short, constant or eligible, per SKU."""
    out = df.groupBy(*SKU).agg(F.count("qty").alias("weeks"), F.min("qty").alias("lo"), F.max("qty").alias("hi"))
    return out.withColumn("series_class", F.when(F.col("weeks") < short, "short").when(F.col("lo") == F.col("hi"), "constant").otherwise("eligible"))


def with_levels(grid: DataFrame) -> DataFrame:
    """Candidate forecasts known at each week: last value, short mean, mean level, and history length."""
    q = F.col("qty").cast("double")
    four = series().rowsBetween(-3, 0)
    return grid.withColumns({
        "p_last": q, "p_ma4": F.avg(q).over(four), "p_level": F.avg(q).over(so_far()),
        "n_obs": F.row_number().over(series()), "n_sold": F.sum("sold").over(so_far())})


def coldstart_means(grid: DataFrame, levels: list[str]) -> DataFrame:
    """Mean demand of each category up to each week, narrowest known level first, then the centre.

    All means are joined to one row per centre, week and categories; the grid is joined once. Categories grow with the products and the
    file of a grid hides its size, so their means are dealt over the executors and not sent to the driver.
    """
    keys = ["center_id", "week_st", *levels]
    base = grid.groupBy(*keys).agg(F.sum("qty").alias("s"), F.count("qty").alias("n"))
    groups = base.select(*keys)
    for level in (*levels, None):
        of = ["center_id", *([level] if level else [])]
        w = W.partitionBy(*of).orderBy("week_st").rowsBetween(W.unboundedPreceding, 0)
        sums = base.where(F.col(level).isNotNull()) if level else base
        table = sums.groupBy(*of, "week_st").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(
            *of, "week_st", F.sum("s").over(w).alias("ss"), F.sum("n").over(w).alias("nn")).select(*of, "week_st", C.mean6("ss", "nn").alias(f"m_{level or 'center'}"))
        groups = groups.join(table.hint("merge") if level else table, [*of, "week_st"], "left")  # a centre has one row per week
    groups = written(groups, "coldstart-means")
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    return grid.alias("d").join(groups.alias("g").hint("merge"), same, "left").select("d.*", *[f"g.{c}" for c in groups.columns if c not in keys])


def rolling_origin(grid: DataFrame, start: str, horizons, end, levels: list[str]) -> DataFrame:
    """Every weekly origin from ``start``: forecasts from the history known then, and the actual.

    One row per (SKU, origin, horizon, model). The actual is read ahead in the same window, so
    origins are never joined to the history they would have to rescan.
    """
    known = with_levels(coldstart_means(grid, levels))
    steps = {}
    for h in horizons:
        steps[f"y_{h}"] = F.when(F.date_add("week_st", 7 * h) <= end, F.lead("qty", h).over(series()))
        steps[f"p_season_{h}"] = F.lag(F.col("qty").cast("double"), SEASON - h).over(series())
    known = known.withColumns(steps).where(F.col("week_st") >= F.lit(start).cast("date"))
    fallback = F.coalesce(*[F.col(f"m_{x}") for x in levels], F.col("m_center"), F.lit(0.0))
    rows = []
    for h in horizons:
        models = {"last": F.col("p_last"), "ma4": F.col("p_ma4"), "level": F.col("p_level"),
                  "season": F.col(f"p_season_{h}"), "category": fallback}
        rows += [F.struct(F.lit(h).alias("horizon"), F.date_add("week_st", 7 * h).alias("target_date"), F.lit(m).alias("model"),
                          F.col(f"y_{h}").alias("y_true"), p.alias("y_pred")) for m, p in models.items()]
    source = F.when(F.col("n_sold") == 0, "no_history").when(F.col("n_obs") < 52, "short").otherwise("model")
    return (known.select(*SKU, "week_st", *levels, "n_obs", "n_sold", source.alias("source"), F.explode(F.array(*rows)).alias("r"))
            .select(*SKU, "week_st", *levels, "n_obs", "n_sold", "source", "r.*")
            .where("y_true is not null and y_pred is not null"))


def baseline_forecast(history: DataFrame, skus: DataFrame, horizons) -> DataFrame:
    """Constant or mean level per SKU for every horizon; SKUs without history get 0."""
    level = history.groupBy(*SKU).agg(F.avg(F.col("qty").cast("double")).alias("_mean"), F.min("qty").alias("_lo"), F.max("qty").alias("_hi"))
    out = skus.join(level, SKU, "left")
    kind = F.when(F.col("_mean").isNull(), "none").when(F.col("_lo") == F.col("_hi"), "constant").otherwise("level")
    return out.select(*SKU, kind.alias("source"), F.coalesce("_mean", F.lit(0.0)).alias("y_pred"), F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))


def widen_horizons(pred: DataFrame, horizons, value: str = "y_pred") -> DataFrame:
    """One row per SKU and origin with a column per horizon, by conditional aggregation."""
    return pred.groupBy(*SKU, "week_st").agg(*[e for h in horizons for e in (
        F.max(F.when(F.col("horizon") == h, F.col(value))).alias(f"h{h}_pred"),
        F.max(F.when(F.col("horizon") == h, F.col("target_date"))).alias(f"h{h}_target_date"))])


# -- pooled models ---------------------------------------------------------
def fit_trees(train: DataFrame, cols: list[str], label: str, kind: str, seed: int = 42, weight: str | None = None, **params):
    """MLlib forest or boosting pipeline on assembled features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    maker = {"forest": RandomForestRegressor, "boosted": GBTRegressor, "classifier": GBTClassifier}[kind]
    extra = {"weightCol": weight} if weight else {}
    model = maker(featuresCol="features", labelCol=label, seed=seed, **extra, **params)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"), model]).fit(train)


def predict_log(model, df: DataFrame, out: str = "y_pred") -> DataFrame:
    """Predictions of a log1p model as quantities."""
    return model.transform(df).withColumn(out, C.expm1_clip(F.col("prediction"))).drop("features", "prediction")


def fit_tweedie(train: DataFrame, cols: list[str], label: str, power: float = 1.5, reg: float = 0.01):
    """Tweedie regression with a log link for demand with many zeros."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    glm = GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, labelCol=label, regParam=reg, maxIter=15)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), glm]).fit(train)


def fit_hurdle(train: DataFrame, cols: list[str], label: str, seed: int = 42, **params):
    """Sale probability model and quantity model on selling rows."""
    marked = train.withColumns({"_sold": (F.col(label) > 0).cast("double"), "_log": C.log1p_clip(F.col(label))})
    sale = fit_trees(marked, cols, "_sold", "classifier", seed, **params)
    size = fit_trees(marked.where("_sold = 1"), cols, "_log", "boosted", seed, **params)
    return sale, size


def predict_hurdle(models, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    sale, size = models
    scored = sale.transform(df).withColumn("sale_probability", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")
    sized = predict_log(size, scored, "conditional_qty")
    return sized.withColumn("y_pred", F.col("sale_probability") * F.col("conditional_qty"))


def importance(model, cols: list[str]) -> list[tuple[str, float]]:
    return [(c, float(v)) for c, v in zip(cols, model.stages[-1].featureImportances.toArray())]


SHIFT_ROWS = 10_000  # rows that exchange values among themselves


def permutation_importance(model, rows: DataFrame, cols: list[str], label: str, keys: list[str], seeds, predict=predict_log) -> DataFrame:
    """(feature, seed, increase): how much the mean absolute error of a fitted model grows when a feature is taken from another row.

    Rows are dealt by a seeded hash of their key into groups of about ``SHIFT_ROWS``, and each takes the values of the row after it in hash
    order, the last of a group those of the first. All features are moved in one pass: every row is scored as it is and once per feature.
    """
    groups = max(1, math.ceil(rows.count() / SHIFT_ROWS))
    seeded = rows.withColumn("seed", F.explode(F.array(*[F.lit(k) for k in seeds]))).withColumn("_h", F.xxhash64("seed", *keys))
    w = W.partitionBy("seed", F.pmod("_h", F.lit(groups))).orderBy("_h", *keys)
    values = F.struct(*[F.col(c) for c in cols])
    first = F.first(values).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    moved = seeded.withColumn("_o", F.coalesce(F.lead(values).over(w), first)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(cols)))))
    given = moved.withColumns({c: F.when(F.col("_k") == k, F.col(f"_o.{c}")).otherwise(F.col(c)) for k, c in enumerate(cols, 1)}).drop("_o", "_h")
    errors = predict(model, given).groupBy("seed", "_k").agg(F.avg(F.abs(F.col("y_pred") - F.col(label))).alias("e"))
    base = errors.where("_k = 0").select("seed", F.col("e").alias("_base"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_k"))
    return errors.where("_k > 0").join(base, "seed").select(name.alias("feature"), "seed", (F.col("e") - F.col("_base")).alias("increase"))
