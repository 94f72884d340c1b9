"""Row counts, NULL profiles and load reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def unpivot_counts(df: DataFrame, keys: list[str], measures: dict[str, dict[str, Column]], label: str) -> DataFrame:
    """One aggregate over the input, then one row per entry of ``measures``.

    ``measures`` maps a row label to its {column name: aggregate}.
    """
    flat = {f"{i}__{c}": agg for i, cols in enumerate(measures.values()) for c, agg in cols.items()}
    one = (df.groupBy(*keys) if keys else df.groupBy()).agg(*[a.alias(n) for n, a in flat.items()])
    entries = [F.struct(F.lit(name).alias(label), *[F.col(f"{i}__{c}").alias(c) for c in cols])
               for i, (name, cols) in enumerate(measures.items())]
    return one.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def missing(col: str, text: bool = False) -> Column:
    empty = F.col(col).isNull()
    return empty | (F.trim(F.col(col)) == "") if text else empty


def profile_columns(df: DataFrame) -> DataFrame:
    """Type, NULL count and NULL share of every column, in one pass."""
    total = F.count(F.lit(1))
    return unpivot_counts(df, [], {
        name: {"dtype": F.lit(dtype), "null_count": F.count_if(F.col(name).isNull()),
               "null_pct": F.round(F.count_if(F.col(name).isNull()) * 100.0 / total, 6).cast("double")}
        for name, dtype in df.dtypes}, "column_name")


def profile_schema(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    rows = [(t, c, k) for t, df in frames.items() for c, k in df.dtypes]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def count_rows(frames: dict[str, DataFrame], label: str = "stage") -> DataFrame:
    return union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias(label), "n")
                      for name, df in frames.items()])


def date_ranges(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    return union_all([
        df.agg(F.count(F.lit(1)).alias("n"), F.min(col).cast("date").alias("first_date"),
               F.max(col).cast("date").alias("last_date")).select(F.lit(name).alias("table_name"), "*")
        for name, (df, col) in frames.items()])


def reconcile(source: DataFrame, sink: DataFrame) -> DataFrame:
    counts = union_all([source.select(F.lit(1).alias("a"), F.lit(0).alias("b")),
                        sink.select(F.lit(0).alias("a"), F.lit(1).alias("b"))])
    return counts.agg(F.sum("a").alias("source_rows"), F.sum("b").alias("sink_rows")).withColumn(
        "difference", F.col("source_rows") - F.col("sink_rows"))
