"""Data-quality aggregates on transactions and enriched facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.operators.profiling import missing, union_all, unpivot_counts


def pct(part, total):
    return F.round(part * F.lit(100.0) / total, 6).cast("double")


def join_fanout(base: DataFrame, dims: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows after joining each dimension alone, and its duplicate keys.

    The join itself is not run: a left join returns, for every base key, as many rows as the
    dimension holds for it (at least one), so two counted key tables are enough.
    """
    parts = []
    for name, (dim, keys) in dims.items():
        have = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
        sizes = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("d"))
        joined = have.join(sizes, keys, "left").agg(
            F.sum("b").alias("base_rows"), F.sum(F.col("b") * F.coalesce("d", F.lit(1))).alias("joined_rows"))
        dup = sizes.agg(F.count_if(F.col("d") > 1).alias("n")).scalar()
        parts.append(joined.select(F.lit(name).alias("dimension"), "base_rows", "joined_rows", dup.alias("duplicate_keys")))
    return union_all(parts)


def null_ratio(df: DataFrame, cols: list[str], keys: list[str] | None = None, text: bool = False) -> DataFrame:
    total = F.count(F.lit(1))
    return unpivot_counts(df, keys or [], {
        c: {"total_rows": total, "null_rows": F.count_if(missing(c, text)),
            "null_pct": pct(F.count_if(missing(c, text)), total)} for c in cols}, "column_name")


def unmatched(df: DataFrame, dim: DataFrame, key: str, extra: list[str] | None = None) -> DataFrame:
    """Rows per key value that has no partner; counted first, matched afterwards."""
    counted = df.groupBy(key, *(extra or [])).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(dim.select(key), key, "left_anti")


def top(df: DataFrame, by: str, ties: list[str], k: int) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def match_rate(df: DataFrame, group: str, measure: str, listed: list[str]) -> DataFrame:
    total = F.count(F.lit(1))
    lost = F.count_if(F.col(measure).isNull())
    return df.where(F.col(group).isin(*listed)).groupBy(group).agg(
        total.alias("n"), lost.alias("unmatched"), pct(lost, total).alias("unmatched_pct"))


def distinct_ratio(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct complete tuples against all rows; a tuple with a NULL is not counted."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct(*cols).alias("distinct_rows")).withColumn(
        "duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))


def names_per_key(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(name).alias("names")).where("names > 1")


def sign_crosstab(df: DataFrame) -> DataFrame:
    def sign(c):
        return F.when(F.col(c) > 0, "positive").when(F.col(c) < 0, "negative").when(F.col(c) == 0, "zero").otherwise("missing")
    return df.groupBy("center_id", "work_type", sign("amount").alias("amount_sign"), sign("qty").alias("qty_sign")).agg(
        F.count(F.lit(1)).alias("n"))


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest in the given order, without sorting whole groups; repeats are removed first."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.distinct().groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return picked.select(*keys, *[f"_r.{c}" for c in (*order, *rest)])


def center_master(masters: dict[str, list[DataFrame]], keys: list[str], order: list[str]) -> DataFrame:
    """Per centre: stack its product lists and keep one row per key; then both centres with a label."""
    return union_all([first_row(union_all(parts), keys, order).withColumn("center_id", F.lit(c)) for c, parts in masters.items()])


def calendar_week_agg(df: DataFrame, week: str, means: list[str], maxima: list[str], firsts: list[str], order: str) -> DataFrame:
    return df.groupBy(week).agg(
        *[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in means], *[F.max(c).alias(f"{c}_max") for c in maxima],
        *[F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(f"{c}_first") for c in firsts])


def category_tree(master: DataFrame, levels: list[str]) -> DataFrame:
    """SKU counts at every level of the hierarchy."""
    return (master.rollup(*levels).agg(F.count(F.lit(1)).alias("sku_count"), F.grouping_id().alias("_g"))
            .where(f"_g < {2 ** len(levels) - 1}")
            .withColumn("level", F.when(F.col("_g") == 0, 3).when(F.col("_g") == 1, 2).otherwise(1)).drop("_g"))
