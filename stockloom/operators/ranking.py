"""Exact ranks, quantiles and running sums that never sort a whole group in one task.

Values are first added up (partial aggregation removes repeats). A group of many distinct values is cut into value buckets at approximate
quantiles, buckets are cut again until none holds more than ``BUCKET_ROWS``; running sums are taken inside the last buckets, and over the
short lists of bucket totals on the way back. The cut points only balance the work: the result is exact for any cut points. They are pinned
in reliable storage, because an approximate quantile may differ when recomputed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockloom.sources.storage import pin

BUCKETS = 64
BUCKET_ROWS = 100_000


def _same(keys: list[str], prefix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return cond


def _running(sums: DataFrame, keys: list[str], value: str, cols: list[str], levels: int) -> DataFrame:
    if not levels:
        w = W.partitionBy(*keys)
        return sums.withColumns({f"before_{c}": F.sum(c).over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)) - F.col(c) for c in cols} | {f"total_{c}": F.sum(c).over(w) for c in cols})
    edges = pin(sums.groupBy(*keys).agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("_edges")))
    here = f"_b{levels}"
    placed = sums.join(edges.withColumnsRenamed({k: f"_e_{k}" for k in keys}), _same(keys, "_e_")).withColumn(
        here, F.size(F.filter("_edges", lambda e: e < F.col(value)))).select(*keys, value, *cols, here)
    inside = _running(placed, [*keys, here], value, cols, levels - 1)
    group = W.partitionBy(*keys)  # at most BUCKETS rows per group
    totals = placed.groupBy(*keys, here).agg(*[F.sum(c).alias(c) for c in cols])
    starts = totals.select(*[F.col(k).alias(f"_s_{k}") for k in (*keys, here)], *[(F.sum(c).over(group.orderBy(here)) - F.col(c)).alias(f"_start_{c}") for c in cols],
                           *[F.sum(c).over(group).alias(f"_total_{c}") for c in cols])
    joined = inside.join(starts, _same([*keys, here], "_s_"))
    return joined.select(*keys, value, *cols, *[(F.col(f"_start_{c}") + F.col(f"before_{c}")).alias(f"before_{c}") for c in cols], *[F.col(f"_total_{c}").alias(f"total_{c}") for c in cols])


def running_sums(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """(keys, value, and per sum: itself, before_, total_): the sums over rows of that value, of smaller values, and of the whole group.

    The number of bucket levels follows from the largest number of distinct values of a group; small groups are summed in one window.
    """
    rows = df.where(F.col(value).isNotNull())
    added = (rows.groupBy(*keys, value)).agg(*[e.alias(c) for c, e in sums.items()])
    added = pin(added)
    per = added.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else added.agg(F.count(F.lit(1)).alias("_n"))
    most = per.agg(F.max("_n")).first()[0] or 0
    levels = 0 if most <= BUCKET_ROWS else max(1, math.ceil(math.log(most / BUCKET_ROWS, BUCKETS)))
    return _running(added, keys, value, list(sums), levels)


def running_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, n, before, total): how many rows hold a smaller value, and how many there are.

    ``weight`` names a column with the number of rows each input row stands for.
    """
    out = running_sums(df, keys, value, {"n": F.sum(weight) if weight else F.count(F.lit(1))})
    return out.withColumnsRenamed({"before_n": "before", "total_n": "total"})


def average_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, rank, total): rank from 1, ties share their average rank."""
    return running_counts(df, keys, value).select(
        *keys, value, (F.col("before") + (F.col("n") + 1) / 2).alias("rank"), "total")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``."""
    counts = running_counts(df, keys, value, weight)
    v = F.col(value).cast("double")

    def at(pos):
        return F.max(F.when((F.col("before") <= pos) & (pos < F.col("before") + F.col("n")), v))

    aggs = []
    for name, p in probs.items():
        pos = (F.col("total") - 1) * F.lit(p)
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"_f_{name}")]
    one = (counts.groupBy(*keys) if keys else counts.groupBy()).agg(*aggs)
    return one.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs])
