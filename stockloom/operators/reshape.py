"""Wide to long, long to wide, and fan-out through mapping tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.operators.marts import SKU
from stockloom.operators.profiling import union_all


def melt_months(df: DataFrame, ids: list[str], months: list[str], value: str) -> DataFrame:
    """Month columns become rows; the month number is read from the column name."""
    long = df.unpivot(ids, months, "_m", value).where(F.col(value).isNotNull())
    return long.withColumn("m", F.regexp_extract("_m", "(\\d+)", 1).cast("int")).drop("_m")


def unstack_two_level(df: DataFrame, ids: list[str], value: str) -> DataFrame:
    """Columns named month_kind become (month, kind, value) rows."""
    cols = [c for c in df.columns if c not in ids]
    parts = F.split("_c", "_", 2)
    long = df.unpivot(ids, cols, "_c", value).where(F.col(value).isNotNull())
    return long.select(*ids, F.regexp_extract(parts[0], "(\\d+)", 1).cast("int").alias("m"), parts[1].alias("kind"), value)


def broadcast_groups(df: DataFrame, group: str, mapping: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One group row becomes one row per member region; regions reached twice are averaged."""
    out = df.join(mapping, group, "left").withColumn("sido", F.coalesce("sido", group))
    return out.groupBy("sido", "sigungu", *keys).agg(F.avg(value).alias(value))


def station_fanout(df: DataFrame, mapping: DataFrame, station: str, region: str) -> DataFrame:
    """Every station row for each region it stands for; unknown stations keep their own id."""
    return df.join(mapping, station, "left").withColumn(region, F.coalesce(region, station))


def pivot_sum(df: DataFrame, keys: list[str], col: str, values: list, agg: Column) -> DataFrame:
    return df.groupBy(*keys).pivot(col, values).agg(agg)


def eav_to_map(df: DataFrame, keys: list[str], name: str, value: str, out: str) -> DataFrame:
    """Parameter rows become one map per key. A key holds a handful of parameters."""
    entries = F.sort_array(F.collect_list(F.struct(name, value)))
    return df.groupBy(*keys).agg(F.map_from_entries(entries).alias(out))


def trend_long(actual: DataFrame, wide: DataFrame, horizons) -> DataFrame:
    """Actual, origin anchor and each horizon's forecast as one long fact."""
    key = [*SKU, "week_st"]
    rows = actual.select(*key, F.lit("actual").alias("series"), F.col("qty").cast("double").alias("value"))
    anchor = actual.join(wide.select(*key), key, "left_semi").select(*key, F.lit("origin").alias("series"), F.col("qty").cast("double").alias("value"))
    steps = F.array(*[F.struct(F.col(f"h{h}_target_date").alias("week_st"), F.lit(f"h{h}").alias("series"), F.col(f"h{h}_pred").alias("value")) for h in horizons])
    ahead = wide.select(*SKU, F.explode(steps).alias("e")).select(*SKU, "e.*").where("value is not null")
    return union_all([rows, anchor, ahead])


def bridge_rows(actual: DataFrame, time: str, value: str) -> DataFrame:
    """The last actual of each SKU is repeated as the first point of its forecast line."""
    rows = actual.select(*SKU, time, F.lit("actual").alias("part"), F.col(value).alias("value"))
    last = actual.groupBy(*SKU).agg(F.max(F.struct(time, F.col(value).alias("value"))).alias("l"))
    return rows.unionByName(last.select(*SKU, F.col(f"l.{time}"), F.lit("forecast").alias("part"), F.col("l.value")))
