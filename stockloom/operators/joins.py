"""Enrichment joins, lookups, overrides and as-of matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockloom.operators.skew import split_join
from stockloom.sources.storage import written


def resolve_region(df: DataFrame, postal: DataFrame, zip_col: str = "zip5") -> DataFrame:
    """Unknown zips keep their rows with an unknown region. Zips that hold a large share of the rows are split."""
    return split_join(df, postal, [zip_col])


def weather_or_join(df: DataFrame, weather: DataFrame, places: DataFrame | None = None, date: str = "tx_date") -> DataFrame:
    """Match province and day, and city exactly, by province-wide rows, or by city prefix. May fan out.

    The alternative is decided between places and weather stations, both bounded by the map. The facts then meet the stored (place, day) rows on
    equality alone, so a row reads only the weather that it gets. An unknown city gets the province-wide rows. ``places`` has every (province,
    city) of the facts; where it is not given they are read from the facts.
    """
    towns = (df if places is None else places).select("sido", "city").distinct()
    stations = weather.select(F.col("sido").alias("_s"), F.col("sigungu").alias("_g")).distinct()
    city = (F.col("_g") == F.col("city")) | F.col("_g").isNull() | F.col("city").startswith(F.concat("_g", F.lit(" ")))
    hits = towns.join(stations, (F.col("sido") == F.col("_s")) & city).select("_s", "_g", F.col("city").alias("_c"))
    w = weather.select(F.col("sido").alias("_p"), F.col("sigungu").alias("_w"), F.col("date").alias("_d"), "temp", "rain")
    rows = hits.join(w, (F.col("_s") == F.col("_p")) & F.col("_g").eqNullSafe(F.col("_w"))).select("_s", "_c", "_d", "temp", "rain")
    same = (F.col("sido") == F.col("_s")) & F.col("city").eqNullSafe(F.col("_c")) & (F.col(date) == F.col("_d"))
    return df.join(written(rows, "place-stations"), same, "left").drop("_s", "_c", "_d")


def weather_key_resolve(regions: DataFrame, weather: DataFrame) -> DataFrame:
    """Decide once per region which weather row it uses: exact, province-wide (NULL), or prefix."""
    local = weather.where("sigungu is not null").select("sido", F.col("sigungu").alias("_g")).distinct()
    wide = weather.where("sigungu is null").select("sido", F.lit(1).alias("_wide")).distinct()
    places = regions.select("sido", "city").distinct()
    exact = local.withColumnRenamed("_g", "_exact")
    near = local.select(F.col("sido").alias("_s"), F.col("_g").alias("_near"))
    return (places.join(exact, (places.sido == exact.sido) & (places.city == exact["_exact"]), "left").drop(exact.sido)
            .join(wide, "sido", "left")
            .join(near, (F.col("sido") == F.col("_s")) & F.col("city").startswith(F.concat("_near", F.lit(" ")))
                  & F.col("_exact").isNull(), "left")
            .select("sido", "city",
                    F.when(F.col("_exact").isNotNull(), F.col("_exact"))
                    .when(F.col("_wide").isNotNull(), F.lit(None)).otherwise(F.col("_near")).alias("weather_key")))


def _span(df: DataFrame, first: Column | None, last: Column | None, date: str) -> tuple[Column, Column]:
    """The days to cover; read from the facts' own dates where the caller does not know them."""
    return (df.agg(F.min(date)).scalar() if first is None else first), (df.agg(F.max(date)).scalar() if last is None else last)


def place_days(keys: DataFrame, first: Column, last: Column, date: str = "tx_date") -> DataFrame:
    """A row per place (with its resolved weather key) and day: bounded by the map and the calendar, not by the facts."""
    return keys.select("sido", "city", "weather_key", F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias(date))


def place_weather(days: DataFrame, weather: DataFrame, date: str = "tx_date") -> DataFrame:
    """The weather of every place and day by the resolved key, NULL matching NULL."""
    w = weather.select(F.col("sido").alias("_s"), F.col("sigungu").alias("_g"), F.col("date").alias("_d"), "temp", "rain")
    same = (F.col("sido") == F.col("_s")) & F.col("weather_key").eqNullSafe(F.col("_g")) & (F.col(date) == F.col("_d"))
    return days.join(w, same, "left").drop("_s", "_g", "_d", "weather_key")


def weather_nullsafe_join(df: DataFrame, keys: DataFrame, weather: DataFrame, first: Column | None = None, last: Column | None = None, date: str = "tx_date") -> DataFrame:
    """One weather row per transaction; the facts meet the composed (place, day) table once."""
    return df.join(written(place_weather(place_days(keys, *_span(df, first, last, date), date), weather, date), "place-weather"), ["sido", "city", date], "left")


def star_enrich(df: DataFrame, keys: DataFrame, weather: DataFrame, holidays: DataFrame, covid: DataFrame,
                cpi: DataFrame, retail: DataFrame, first: Column | None = None, last: Column | None = None, date: str = "tx_date") -> DataFrame:
    """Left joins at day, month and province-month grain; the fact rows are never lost and are joined once.

    Day, month and province tables are first composed to one (place, day) table from ``first`` to ``last``, which is stored: its size is known,
    so the optimiser broadcasts it where it is small and shuffles the facts once where it is not. ``keys`` has every place of the facts.
    """
    day = {"date": date}
    table = (place_weather(place_days(keys, *_span(df, first, last, date), date), weather, date)
             .join(holidays.withColumnsRenamed(day), date, "left")
             .join(covid.withColumnsRenamed(day), date, "left")
             .withColumns({"y": F.year(date), "m": F.month(date)})
             .join(cpi, ["y", "m"], "left")
             .join(retail, ["sido", "y", "m"], "left"))
    return df.join(written(table, "place-days"), ["sido", "city", date], "left")


def enrich_finalize(df: DataFrame) -> DataFrame:
    return df.where("kind = 'sales'").withColumns({
        "holiday": F.col("holiday").isNotNull().cast("int"), "covid": F.coalesce("covid", F.lit(0))})


def map_two_pass(df: DataFrame, mapping: DataFrame, code: str, name: str, values: list[str]) -> DataFrame:
    """Map by (code, name); rows that fail and start with zeros are tried again without them."""
    dim = mapping.groupBy(code, name).agg(F.min(F.struct(*values)).alias("_v"))

    def lookup(key: str, out: str) -> DataFrame:
        return dim.select(F.col(code).alias(key), F.col(name), F.col("_v").alias(out))

    out = df.withColumn("_stripped", F.when(F.col(code).startswith("0"), F.ltrim(F.col(code), F.lit("0"))))
    out = out.join(lookup(code, "_v1"), [code, name], "left").join(lookup("_stripped", "_v2"), ["_stripped", name], "left")
    return out.select(*df.columns, *[F.coalesce(F.col(f"_v1.{v}"), F.col(f"_v2.{v}")).alias(v) for v in values],
                      F.when(F.col("_v1").isNotNull(), 1).when(F.col("_v2").isNotNull(), 2).otherwise(0).alias("map_pass"))


def override_values(base: DataFrame, override: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Take the override where there is one, column by column. Keys may hold NULL."""
    one = override.groupBy(*keys).agg(*[F.max(c).alias(f"_{c}") for c in cols])
    renamed = one.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    out = base.join(renamed, same, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in cols}).select(*base.columns)


def override_misses(base: DataFrame, override: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Rows whose override exists but carries no value, so they stay on the fallback."""
    empty = override.groupBy(*keys).agg(F.max(col).alias("_v")).where("_v is null").drop("_v")
    renamed = empty.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return base.join(renamed, same, "left_semi")


def in_out_full_outer(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two aggregates with zeros for the missing side."""
    out = a.join(b, keys, "full_outer")
    return out.na.fill(0, [c for c in out.columns if c not in keys])


def self_join_future(df: DataFrame, keys: list[str], time: str, value: str, days: int, out: str) -> DataFrame:
    later = df.select(*keys, F.date_sub(F.col(time), days).alias(time), F.col(value).alias(out))
    return df.join(later, [*keys, time], "left")


def match_report(df: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before, after a left join, and without a partner. Both sides are counted by key first, so only counts are joined."""
    from stockloom.operators.profiling import unpivot_counts
    own = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    other = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    both = own.join(other, keys, "left")
    total = lambda c: {"n": F.coalesce(F.sum(c), F.lit(0).cast("bigint"))}
    return unpivot_counts(both, [], {"rows": total(F.col("_n")), "joined": total(F.col("_n") * F.coalesce("_k", F.lit(1))), "left_only": total(F.when(F.col("_k").isNull(), F.col("_n")))}, "check")


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], time: str, cols: list[str]) -> DataFrame:
    """Latest right row at or before each left row, per key.

    Both sides are stacked and swept once in time order; no join on an inequality is needed.
    """
    l = left.select(*keys, time, F.lit(1).alias("_side"), F.lit(None).alias("_r"))
    r = right.select(*keys, time, F.lit(0).alias("_side"), F.struct(F.col(time).alias("match_time"), *cols).alias("_r"))
    w = W.partitionBy(*keys).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = r.unionByName(l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)))
    return (both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
            .select(*keys, time, "_m.match_time", *[f"_m.{c}" for c in cols]))


def one_to_one_audit(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicate keys on each side and keys without a partner, from one shuffle."""
    tagged = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    sizes = tagged.groupBy(*keys).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    return sizes.agg(F.count_if(F.expr("a > 1")).alias("left_duplicates"), F.count_if(F.expr("b > 1")).alias("right_duplicates"),
                     F.count_if(F.expr("b = 0")).alias("left_only"), F.count_if(F.expr("a = 0")).alias("right_only"))


def one_to_one_merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Join that refuses duplicate keys and missing partners."""
    bad = one_to_one_audit(a, b, keys).first().asDict()
    if any(bad.values()):
        raise ValueError(f"keys do not match one to one: {bad}")
    return a.join(b, keys)


def siblings(master: DataFrame, center: str, sku: Column, same: list[str], nullable: str) -> DataFrame:
    """All SKUs that share name and category with one SKU; unknown specs count as equal."""
    one = master.where((F.col("center_id") == center) & (F.col("sku_id") == sku)).select(
        F.col("center_id").alias("_c"), *[F.col(c).alias(f"_{c}") for c in (*same, nullable)])
    cond = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in same],
                  (F.col("center_id") == F.col("_c")) & F.col(nullable).eqNullSafe(F.col(f"_{nullable}")))
    return master.join(one, cond, "left_semi")


def zero_fill_scope(scope: DataFrame, facts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Restore rows a sparse table lost: every key in scope, zeros where it has no facts."""
    known = scope.select(*keys).distinct()
    sums = facts.groupBy(*keys).agg(*[F.sum(v).cast(facts.schema[v].dataType).alias(v) for v in values])
    return known.join(sums, keys, "left").na.fill(0, values)


def ref_equal(current: DataFrame, previous: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Cells that differ between two versions of a table, per column, NULL equal to NULL."""
    old = previous.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    differs = {c: ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols}
    one = current.join(old, keys).agg(*[F.count_if(d).alias(c) for c, d in differs.items()])
    return one.unpivot([], cols, "column_name", "mismatches")


def cold_lookup(sales: DataFrame, first_stock: DataFrame, origin: str, keys: list[str], time: str, cats: list[str]) -> DataFrame:
    """Categories of every SKU stocked by the origin, from its first row."""
    first = sales.groupBy(*keys).agg(F.min(F.struct(time, *cats)).alias("_f"))
    known = first_stock.where(F.col("first_stock") <= F.lit(origin).cast("date")).select(*keys)
    return first.join(known, keys, "left_semi").select(*keys, *[f"_f.{c}" for c in cats])


def apply_override(pred: DataFrame, override: DataFrame, keys: list[str], value: str, out: str = "override_source") -> DataFrame:
    o = override.select(*keys, F.col(value).alias("_o"))
    return pred.join(o, keys, "left").withColumns({
        out: F.when(F.col("_o").isNotNull(), "override").otherwise("model"),
        value: F.coalesce("_o", value)}).drop("_o")
