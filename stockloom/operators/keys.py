"""Surrogate keys, key uniqueness and set operations on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def surrogate_id(df: DataFrame, period: str, hash_cols: list[str], order: list[str], slot_digits: int = 3) -> DataFrame:
    """Running row number over (period, hash slot, order).

    Rows are numbered inside (period, slot) groups, so a period holding a large share of the
    rows is still spread over 16 ** ``slot_digits`` groups; only the table of group sizes is cumulated.
    """
    slot = F.substring(F.md5(F.concat_ws("|", *hash_cols).cast("binary")), 1, slot_digits)
    rows = df.withColumn("_slot", slot)
    sizes = rows.groupBy(period, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    per_period = sizes.groupBy(period).agg(F.sum("_n").alias("_pn"))
    # one row per period and one row per slot: both bounded by the calendar and the slot count
    period_start = per_period.select(period, (F.sum("_pn").over(W.orderBy(period)) - F.col("_pn")).alias("_p0"))
    starts = (sizes.withColumn("_s0", F.sum("_n").over(W.partitionBy(period).orderBy("_slot")) - F.col("_n"))
              .join(period_start, period).select(period, "_slot", (F.col("_p0") + F.col("_s0")).alias("_start")))
    inner = F.row_number().over(W.partitionBy(period, "_slot").orderBy(*[c for c in order if c != period]))
    return (rows.withColumn("_rn", inner).join(starts, [period, "_slot"])
            .withColumn("row_id", F.col("_start") + F.col("_rn")).drop("_slot", "_start", "_rn"))


def duplicate_groups(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_uniqueness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows that share their key with another row."""
    sizes = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("total_rows"), F.count(F.lit(1)).alias("distinct_keys"),
                     F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0).cast("bigint")).alias("rows_sharing_key"))


def key_set_report(sets: dict[str, DataFrame], cols: list[str]) -> DataFrame:
    """Membership bits of every key in every set, from one shuffle."""
    tagged = reduce(DataFrame.unionByName, [
        df.select(*cols, *[F.lit(1 if n == name else 0).alias(f"in_{n}") for n in sets]) for name, df in sets.items()])
    return tagged.groupBy(*cols).agg(*[F.max(f"in_{n}").alias(f"in_{n}") for n in sets])


def common_keys(sets: list[DataFrame], cols: list[str]) -> DataFrame:
    return reduce(DataFrame.intersect, [df.select(*cols) for df in sets])


def only_in_first(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    return a.select(*cols).subtract(b.select(*cols))
