"""Joins on keys of which a few hold very many rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.sources.storage import pin

SHARE, SPREAD = 0.01, 64  # keys above this share of all rows are spread over so many parts


def split_join(df: DataFrame, dim: DataFrame, on: list[str], how: str = "left", share: float = SHARE, spread: int = SPREAD) -> DataFrame:
    """``df`` joined to ``dim`` on ``on``; the rows of heavy keys are dealt over ``spread`` parts, and only those keys' dimension rows are copied.

    Keys are counted first (only the key columns are read, sums are made in the tasks). At most 1 / ``share`` keys are heavy, so the list of
    them may be broadcast and the copies stay few. Null keys match nothing, as in any equi-join. The part of a row follows from its values.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    counts = pin(counts)
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("t")).scalar()
    heavy = F.broadcast(pin(counts.where(F.col("_n") > total * share).select(*[F.col(k).alias(f"_h_{k}") for k in on])))  # at most 1 / share rows
    same = lambda: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in on])
    names = [f"_h_{k}" for k in on]
    mark = heavy.withColumn("_heavy", F.lit(1))
    part = F.when(F.col("_heavy") == 1, F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(spread)).cast("int")).otherwise(0)
    left = df.join(mark, same(), "left").withColumn("_part", part).drop("_heavy", *names)
    copies = F.when(F.col("_heavy") == 1, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    right = dim.join(mark, same(), "left").withColumn("_part", F.explode(copies)).drop("_heavy", *names)
    return left.join(right, [*on, "_part"], how).drop("_part")
