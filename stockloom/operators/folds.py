"""Validation folds, masks, imputation and encoding for training tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockloom.functions import columns as C
from stockloom.operators.ranking import quantiles
from stockloom.sources.storage import pin, written


@dataclass(frozen=True)
class Fold:
    """Validation is [val_start, val_end]; training is [train_start, val_start)."""
    name: str
    val_start: str
    val_end: str
    train_start: str = "1900-01-01"


def quarter_folds(year: int) -> list[Fold]:
    ends = ("03-31", "06-30", "09-30", "12-31")
    return [Fold(f"{year}Q{q + 1}", f"{year}-{3 * q + 1:02d}-01", f"{year}-{ends[q]}") for q in range(4)]


def target_date(horizon: int, week: str = "week_st") -> Column:
    return F.date_add(week, 7 * horizon)


def assign_folds(df: DataFrame, folds: list[Fold], date: str) -> DataFrame:
    """One row per (row, fold) it takes part in, with its role.

    The fold list is a literal, so this is a projection and not a join.
    """
    day = lambda d: F.lit(d).cast("date")
    entries = F.array(*[F.struct(
        F.lit(f.name).alias("fold"),
        F.when((F.col(date) >= day(f.val_start)) & (F.col(date) <= day(f.val_end)), "val")
        .when((F.col(date) >= day(f.train_start)) & (F.col(date) < day(f.val_start)), "train").alias("role")) for f in folds])
    return df.withColumn("_f", F.explode(F.filter(entries, lambda e: e["role"].isNotNull()))).select(*df.columns, "_f.fold", "_f.role")


def walkforward_folds(df: DataFrame, center: str, start: str, last: str, horizon: int) -> DataFrame:
    """Weekly folds of one centre: sizes of training and validation parts.

    Rows are counted per week first; training sizes are running sums over that short table, so
    rows are never repeated per fold.
    """
    border, end = F.lit(start).cast("date"), F.lit(last).cast("date")
    post = (F.col("center_id") == center) & (F.col("week_st") >= border)
    use = (F.col("center_id") != center) | post
    weeks = df.groupBy("week_st").agg(F.count_if(use).alias("t"), F.count_if(post).alias("val_rows"),
                                      F.sum(F.when(post, F.col("qty")).otherwise(0)).alias("val_qty"))
    w = W.orderBy("week_st")  # one row per week
    sized = weeks.withColumn("train_rows", F.sum("t").over(w.rowsBetween(W.unboundedPreceding, -1)))
    keep = (F.col("val_rows") > 0) & (target_date(horizon) <= end)
    return sized.where(keep).select(
        F.row_number().over(w).alias("fold"), F.col("week_st").alias("val_week"), target_date(horizon).alias("val_target_date"),
        F.coalesce("train_rows", F.lit(0)).cast("bigint").alias("train_rows"), "val_rows", F.col("val_qty").cast("bigint"))


def final_masks(df: DataFrame, center: str, start: str, cutoff: str, last: str, horizon: int) -> DataFrame:
    border, cut, end = (F.lit(d).cast("date") for d in (start, cutoff, last))
    usable = (F.col("center_id") != center) | (F.col("week_st") >= border)
    return df.withColumns({"in_retrain": (usable & (target_date(horizon) < cut)).cast("int"),
                           "in_holdout": ((F.col("week_st") >= cut) & (target_date(horizon) <= end)).cast("int")})


def boundary_filter(df: DataFrame, horizon: int) -> DataFrame:
    """Rows whose target lies inside their centre's own training weeks."""
    last = df.groupBy("center_id").agg(F.max("week_st").alias("_last"))
    return df.join(last, "center_id").where(target_date(horizon) <= F.col("_last")).drop("_last")


def purge_audit(df: DataFrame, border: str, horizons) -> DataFrame:
    """Training rows whose target crosses the border, and violations left after purging them."""
    day = F.lit(border).cast("date")
    train = df.where(F.col("week_st") < day)
    aggs = [F.count(F.lit(1)).alias("train_rows")]
    for h in horizons:
        cross = target_date(h) >= day
        aggs += [F.count_if(cross).alias(f"crossing_h{h}"), F.count_if(cross & (F.col("week_st") < F.date_sub(day, 7 * h))).alias(f"violations_h{h}")]
    return train.groupBy("center_id").agg(*aggs)


def carve_tail(df: DataFrame, weeks: int) -> DataFrame:
    """The last weeks of each centre become internal validation."""
    last = df.groupBy("center_id").agg(F.max("week_st").alias("_last"))
    return df.join(last, "center_id").withColumn(
        "part", F.when(F.col("week_st") > F.date_sub("_last", 7 * weeks), "val").otherwise("train")).drop("_last")


def workload(df: DataFrame) -> DataFrame:
    return df.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "val").alias("val_rows"))


def level_medians(train: DataFrame, levels: list[str], col: str) -> DataFrame:
    """(level, key, median) for every level and for all rows together.

    Rows are counted per value first, so each level only re-groups counts.
    """
    counts = train.where(F.col(col).isNotNull()).groupBy(*levels, col).agg(F.count(F.lit(1)).alias("rows"))
    tags = [F.struct(F.lit(name).alias("level"), F.col(name).alias("key")) for name in levels]
    tags.append(F.struct(F.lit("global").alias("level"), F.lit(None).cast("string").alias("key")))
    long = counts.select(F.explode(F.array(*tags)).alias("t"), col, "rows").select("t.level", "t.key", col, "rows")
    return quantiles(long, ["level", "key"], col, {"median": 0.5}, weight="rows")


def hier_median(train: DataFrame, df: DataFrame, levels: list[str], col: str) -> DataFrame:
    """Fill from training medians of the narrowest known group; the source is recorded."""
    medians = written(level_medians(train, levels, col), "medians")
    groups, source = df.select(*levels).distinct(), F.when(F.col(col).isNotNull(), "own")
    values = [F.col(col).cast("double")]
    for i, level in enumerate(levels):
        table = medians.where(F.col("level") == level).select(F.col("key").alias(level), F.col("median").alias(f"_m{i}"))
        groups = groups.join(table, level, "left")
        values.append(F.col(f"_m{i}"))
        source = source.when(F.col(f"_m{i}").isNotNull(), level)
    same = [F.col(f"d.{x}").eqNullSafe(F.col(f"g.{x}")) for x in levels]  # medians meet on the groups; the rows are joined once
    out = df.alias("d").join(written(groups, "group-medians").alias("g"), same, "left").select("d.*", *[f"g._m{i}" for i in range(len(levels))])
    whole = medians.where("level = 'global'").select("median").scalar()
    return (out.withColumn("_g", whole)
            .withColumns({f"{col}_source": source.when(F.col("_g").isNotNull(), "global").otherwise("none"),
                          f"{col}_imputed": F.coalesce(*values, F.col("_g"))})
            .drop("_g", *[f"_m{i}" for i in range(len(levels))]))


def zscore(train: DataFrame, df: DataFrame, cols: list[str], tiny: float = 1e-8) -> DataFrame:
    """Standardise with training mean and population deviation; a tiny deviation counts as 1."""
    stats = train.agg(F.struct(*[e for c in cols for e in (
        F.avg(F.col(c).cast("double")).alias(f"{c}_m"), F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_s"))])).scalar()
    out = df.withColumn("_st", stats)
    return out.withColumns({f"{c}_z": (F.col(c) - F.col(f"_st.{c}_m")) / F.when(F.col(f"_st.{c}_s") < tiny, 1.0).otherwise(F.col(f"_st.{c}_s"))
                            for c in cols}).drop("_st")


def dense_numbers(values: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct values numbered 1, 2, ... in their order: range partitions are numbered each by itself and offset by the sizes of those before.

    Only the sizes, one per partition, come together. Ranges are pinned, because they are cut at sampled borders.
    """
    ranged = pin(values.repartitionByRange(col).select(col, F.spark_partition_id().alias("_p")))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).agg(F.collect_list(F.struct("_p", "_n"))).scalar()
    inside = F.row_number().over(W.partitionBy("_p").orderBy(col))
    before = F.aggregate(F.filter("_sizes", lambda x: x["_p"] < F.col("_p")), F.lit(0).cast("bigint"), lambda t, x: t + x["_n"])
    return ranged.withColumns({"_sizes": sizes, "_i": inside}).select(col, (F.col("_i") + before).cast("int").alias(out))


def vocab(train: DataFrame, col: str) -> DataFrame:
    """Sorted training vocabulary numbered from 1. One row per distinct category."""
    return dense_numbers(train.select(col).where(F.col(col).isNotNull()).distinct(), col, f"{col}_id")


def vocab_encode(train: DataFrame, df: DataFrame, col: str) -> DataFrame:
    return df.join(vocab(train, col), col, "left").withColumn(f"{col}_id", F.coalesce(f"{col}_id", F.lit(0)))


def category_levels(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """Blank categories that training has not seen; a mark tells which."""
    out = df
    for c in cols:
        known = train.select(F.col(c)).distinct().withColumn("_k", F.lit(1))
        out = out.join(known, c, "left").withColumns({
            f"{c}_unknown": (F.col(c).isNotNull() & F.col("_k").isNull()).cast("int"),
            f"{c}_level": F.when(F.col("_k") == 1, F.col(c))}).drop("_k")
    return out


def sample_weight(df: DataFrame, center: str, weight: float, flag: str) -> DataFrame:
    """Row weight by centre and class weight of the positive class."""
    ratio = df.agg(C.div(F.count_if(F.col(flag) == 0), F.count_if(F.col(flag) == 1))).scalar()
    return df.withColumns({"row_weight": F.when(F.col("center_id") == center, weight).otherwise(1.0),
                           "class_weight": F.when(F.col(flag) == 1, ratio).otherwise(1.0)})


def one_hot(df: DataFrame, cols: list[str]):
    """Sparse one-hot vectors; unseen categories keep their own slot."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    idx = StringIndexer(inputCols=cols, outputCols=[f"{c}_idx" for c in cols], handleInvalid="keep", stringOrderType="alphabetAsc")
    enc = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_vec" for c in cols], dropLast=True)
    return Pipeline(stages=[idx, enc]).fit(df)


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="skip").transform(df)
