"""Serving queries: parameterised reads of the marts.

Every function takes the marts it needs and a ``Scope``. Rankings are returned unordered and
complete unless a limit is the feature; a limit is always a distributed top-k.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.columns import div, r6
from stockloom.operators.joins import zero_fill_scope
from stockloom.operators.marts import MONEY, SKU, total

LEVELS = ("cat_l", "cat_m", "cat_s")


@dataclass(frozen=True)
class Scope:
    """Filter set shared by the queries; None means no restriction."""
    center: str = "ALL"
    cat_l: str | None = None
    cat_m: str | None = None
    cat_s: str | None = None
    option_code: str | None = None
    sku_id: str | None = None

    def wanted(self) -> dict[str, str]:
        return {name: value for name in (*LEVELS, "option_code", "sku_id") if (value := getattr(self, name)) is not None}

    def local(self, df: DataFrame) -> DataFrame:
        """The filters on columns that the frame has; the caller joins a filtered master for the rest."""
        out = df if self.center == "ALL" else df.where(F.col("center_id") == self.center)
        for name, value in self.wanted().items():
            if name in df.columns:
                out = out.where(F.col(name) == value)
        return out

    def filter(self, df: DataFrame, master: DataFrame | None = None) -> DataFrame:
        """All filters. Fields that the frame lacks are looked up in the master; one that cannot be applied is an error."""
        missing = set(self.wanted()) - set(df.columns)
        if not missing:
            return self.local(df)
        if master is None or not set(SKU) <= set(df.columns):
            raise ValueError(f"the scope's {sorted(missing)} cannot be applied here")
        return self.local(df).join(self.filter(master).select(*SKU), SKU, "left_semi")

    def drill(self) -> str:
        """The level below the chosen one."""
        return "cat_s" if self.cat_m else "cat_m" if self.cat_l else "cat_l"


def day(text: str):
    return F.lit(text).cast("date")


def search_products(df: DataFrame, text: str, cols: list[str]) -> DataFrame:
    """Case-insensitive substring match on any of the columns."""
    hits = [F.lower(F.col(c)).contains(text.lower()) for c in cols]
    return df.where(reduce(lambda a, b: a | b, hits))


def scoped(facts: DataFrame, master: DataFrame, scope: Scope, cols: list[str]) -> DataFrame:
    return scope.local(facts).join(scope.filter(master).select(*SKU, *cols), SKU)


def products(master: DataFrame, forecast: DataFrame, scope: Scope, text: str) -> DataFrame:
    has = forecast.select(*SKU).distinct().withColumn("_f", F.lit(1))
    found = search_products(scope.filter(master), text, ["product_name", "barcode"])
    return found.join(has, SKU, "left").select(*SKU, "product_name", "barcode", "option_code", F.coalesce("_f", F.lit(0)).alias("has_forecast"))


def last_periods(df: DataFrame, time: str, until: str, n: int, cols: list[str]) -> DataFrame:
    return df.where(F.col(time) <= day(until)).orderBy(F.desc(time)).limit(n).select(*cols)


def forecast_view(demand: DataFrame, wide: DataFrame, scope: Scope, basis: str, n: int) -> DataFrame:
    """Recent history of one SKU, then its forecasts at the basis week."""
    hist = last_periods(scope.filter(demand), "week_st", basis, n, ["week_st", F.lit("history").alias("part"), F.col("net_qty").cast("double").alias("value")])
    steps = F.array(*[F.struct(F.col(f"h{h}_target_date").alias("week_st"), F.lit(f"h{h}").alias("part"), F.col(f"h{h}_pred").alias("value")) for h in (1, 2, 4)])
    ahead = scope.filter(wide).where(F.col("week_st") == day(basis)).select(F.explode(steps).alias("e")).select("e.*")
    return hist.unionByName(ahead.where("value is not null"))


def demand_trend(demand: DataFrame, wide: DataFrame, master: DataFrame, scope: Scope, basis: str, days: int) -> DataFrame:
    """Weekly sums over a scope and the summed forecasts at the basis week."""
    keys = scope.filter(master).select(*SKU)
    window = demand.where((F.col("week_st") <= day(basis)) & (F.col("week_st") > F.date_sub(day(basis), days)))
    hist = window.join(keys, SKU, "left_semi").groupBy("week_st").agg(F.sum("sales_qty").cast("double").alias("value")).withColumn("part", F.lit("actual"))
    at = wide.where(F.col("week_st") == day(basis)).join(keys, SKU, "left_semi")
    steps = F.array(*[F.struct(F.date_add("week_st", 7 * h).alias("week_st"), F.lit(f"h{h}").alias("part"), F.col(f"h{h}_pred").alias("value")) for h in (1, 2, 4)])
    ahead = at.select(F.explode(steps).alias("e")).select("e.*").groupBy("week_st", "part").agg(F.sum("value").alias("value"))
    return hist.unionByName(ahead)


def summary(demand: DataFrame, master: DataFrame, scope: Scope, basis: str, time: str = "week_st", step: int = 7, n: int = 12) -> DataFrame:
    """Totals of a period, change to the one before, quantities by unit (maps) and the sums of the last ``n`` periods with rows, oldest first. One row.

    A basis week is named by its Monday; another day, at which no weekly row can be, is an error.
    """
    if time == "week_st" and date.fromisoformat(basis).weekday():
        raise ValueError(f"the basis week {basis} does not begin on a Monday")
    seen = scoped(demand.where(F.col(time) <= day(basis)), master, scope, ["option_code"])
    rows = seen.where(F.col(time).isin(day(basis), F.date_sub(day(basis), step)))
    now, before = F.col(time) == day(basis), F.col(time) < day(basis)
    at = lambda c: F.coalesce(F.sum(F.when(now, F.col(c))).cast(MONEY), F.lit(0).cast(MONEY))
    one = rows.agg(at("sales_amount").alias("total_sales_amount"), at("return_amount").alias("return_amount"), at("net_sales_amount").alias("net_sales_amount"),
                   F.count_if(now & (F.col("sales_qty") > 0)).alias("active_sku_count"), F.sum(F.when(before, F.col("sales_amount"))).alias("_p"))
    units = rows.where(now & F.col("option_code").isNotNull()).groupBy("option_code").agg(F.sum("sales_qty").alias("sales_qty"), F.sum("return_qty").alias("return_qty"))
    by_unit = lambda c: units.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("option_code", c))))).scalar().alias(f"{c}_by_unit")
    amounts = ["sales_amount", "return_amount", "net_sales_amount"]
    line = last_periods(seen.groupBy(time).agg(*[total(c) for c in amounts]), time, basis, n, [time, *amounts])
    return one.select(
        "total_sales_amount", "return_amount", "net_sales_amount", "active_sku_count",
        r6(div(F.col("return_amount"), F.col("total_sales_amount"))).alias("return_rate"),
        r6(div(F.col("total_sales_amount") - F.col("_p"), F.col("_p")) * 100).alias("change_pct"), by_unit("sales_qty"), by_unit("return_qty"),
        line.agg(F.sort_array(F.collect_list(F.struct(*line.columns)))).scalar().alias("sparkline"))


def sparkline(demand: DataFrame, master: DataFrame, scope: Scope, basis: str, n: int, time: str = "week_st", step: int = 7) -> DataFrame:
    rows = scope.filter(demand, master).where((F.col(time) <= day(basis)) & (F.col(time) > F.date_sub(day(basis), n * step)))
    return rows.groupBy(time).agg(total("sales_amount"), total("return_amount"), total("net_sales_amount"))


def inventory_view(mart: DataFrame, stock: DataFrame, scope: Scope, basis: str, n: int, policy: str = "excluded") -> DataFrame:
    """Recent movements of one SKU with its estimated stock; unknown where no inbound was seen."""
    moves = last_periods(scope.filter(mart), "week_st", basis, n, [*SKU, "week_st", "inbound_qty", "outbound_qty", "sales_qty", "return_qty"])
    level = scope.filter(stock).select(*SKU, "week_st", F.col(f"inventory_return_{policy}").alias("estimated_inventory"), "opening_inventory", "inventory_available")
    return moves.join(level, [*SKU, "week_st"], "left")


def forecast_products(wide: DataFrame, master: DataFrame, scope: Scope, basis: str, k: int) -> DataFrame:
    at = wide.where(F.col("week_st") == day(basis))
    rows = scoped(at, master, scope, ["product_name", "option_code"]).where("coalesce(h1_pred, h2_pred, h4_pred) is not null")
    return rows.orderBy(F.desc_nulls_last("h1_pred"), *SKU).limit(k).select(*SKU, "product_name", "option_code", *[r6(F.col(f"h{h}_pred")).alias(f"h{h}_pred") for h in (1, 2, 4)])


def with_share(df: DataFrame, value: str) -> DataFrame:
    """Share of the total, computed beside the rows and not in one ordered group."""
    whole = df.agg(F.sum(value).cast("double")).scalar()
    return df.withColumn("_t", whole).withColumn("share", F.when(F.col("_t") > 0, r6(F.col(value).cast("double") / F.col("_t"))).otherwise(0.0)).drop("_t")


def category_sales(demand: DataFrame, master: DataFrame, scope: Scope, basis: str, time: str = "week_st") -> DataFrame:
    """Sales one level below the chosen category, with shares."""
    level = scope.drill()
    rows = scoped(demand.where(F.col(time) == day(basis)), master, scope, [level])
    return with_share(rows.groupBy(F.col(level).alias("category")).agg(total("sales_amount")), "sales_amount")


def daily_category_sales(agg: DataFrame, grid: DataFrame, scope: Scope, basis: str) -> DataFrame:
    """As above from the sparse daily sums; categories that exist but sold nothing show zero."""
    level = scope.drill()
    existing = scope.filter(grid).where(F.col("grid_start") <= day(basis)).select(F.col(level).alias("category"))
    facts = scope.filter(agg).where(F.col("tx_date") == day(basis)).withColumnRenamed(level, "category")
    return with_share(zero_fill_scope(existing, facts, ["category"], ["sales_amount"]), "sales_amount")


def product_ranking(facts: DataFrame, master: DataFrame, scope: Scope, basis: str, time: str) -> DataFrame:
    rows = scoped(facts.where((F.col(time) == day(basis)) & (F.col("sales_amount") > 0)), master, scope, ["product_name", "option_code"])
    return with_share(rows.select(*SKU, "product_name", "option_code", "sales_amount"), "sales_amount")


def region_sales(regional: DataFrame, master: DataFrame, scope: Scope, first: str, last: str) -> DataFrame:
    """Sales by province and city, with shares."""
    rows = scope.filter(regional, master).where(F.col("tx_date").between(day(first), day(last)))
    return with_share(rows.groupBy("sido", "sigungu").agg(total("sales_amount")), "sales_amount")


def region_products(regional: DataFrame, master: DataFrame, scope: Scope, sido: str, sigungu: str, first: str, last: str, k: int) -> DataFrame:
    """The best-selling products of one city, with name and unit."""
    place = (F.col("sido") == sido) & (F.col("sigungu") == sigungu)
    rows = scope.filter(regional, master).where(place & F.col("tx_date").between(day(first), day(last)))
    return rows.groupBy("sku_id", "product_name", "option_code").agg(total("sales_amount")).orderBy(F.desc("sales_amount"), "sku_id", "product_name", "option_code").limit(k)


def inventory_shortage(stock: DataFrame, wide: DataFrame, master: DataFrame, scope: Scope, basis: str) -> DataFrame:
    inv = stock.where((F.col("week_st") == day(basis)) & (F.col("inventory_available") == 1))
    fc = wide.where((F.col("week_st") == day(basis)) & F.col("h1_pred").isNotNull()).select(*SKU, "h1_pred")
    eligible = scoped(inv, master, scope, ["product_name", "option_code"]).join(fc, SKU)
    counts = eligible.agg(F.count("*").alias("n"), F.count_if(F.col("inventory_return_excluded") < F.col("h1_pred")).alias("short"))
    n, rate = counts.select("n").scalar(), counts.select(r6(div(F.col("short"), F.col("n")))).scalar()
    rows = eligible.where("inventory_return_excluded < h1_pred")
    short = F.greatest(F.col("h1_pred") - F.col("inventory_return_excluded"), F.lit(0.0))
    return rows.select(*SKU, "product_name", "option_code", "inventory_return_excluded", r6(F.col("h1_pred")).alias("h1_pred"), r6(short).alias("shortage_qty"),
                       r6(div(F.col("inventory_return_excluded"), F.col("h1_pred"))).alias("fulfillment_rate"), n.alias("eligible_count"), rate.alias("shortage_rate"))


def sales_surge(demand: DataFrame, master: DataFrame, scope: Scope, basis: str, time: str = "week_st") -> DataFrame:
    """Increase against the same period seven days before; one conditional aggregate, no self join."""
    rows = scope.local(demand).where(F.col(time).isin(day(basis), F.date_sub(day(basis), 7)))
    at = lambda rule: F.coalesce(F.sum(F.when(rule, F.col("sales_qty"))), F.lit(0).cast("bigint"))
    both = rows.groupBy(*SKU).agg(at(F.col(time) == day(basis)).alias("current_qty"), at(F.col(time) < day(basis)).alias("prev_qty"))
    up = both.withColumn("increase_qty", F.col("current_qty") - F.col("prev_qty")).where("increase_qty > 0")
    return (up.withColumn("increase_pct", r6(div(F.col("increase_qty"), F.col("prev_qty")) * 100))
            .join(scope.filter(master).select(*SKU, "product_name", "option_code"), SKU))


def returns(demand: DataFrame, master: DataFrame, scope: Scope, basis: str, time: str = "week_st") -> DataFrame:
    rows = demand.where((F.col(time) == day(basis)) & (F.col("return_amount") > 0))
    return scoped(rows, master, scope, ["product_name", "option_code"]).select(*SKU, "product_name", "option_code", "return_qty", "return_amount")


def daily_summary(agg: DataFrame, sparse: DataFrame, grid: DataFrame, raw: DataFrame, scope: Scope, basis: str, days: int) -> DataFrame:
    """Zero-filled daily line of sums, return rate, record counts and selling SKUs up to the basis date.

    The summed mart has no SKUs; a scope with one reads the sparse daily rows instead.
    """
    known = scope.filter(grid).agg(F.min("grid_start")).scalar()
    first = F.greatest(F.date_sub(day(basis), days - 1), F.col("_g"))
    one = grid.sparkSession.range(1).withColumn("_g", known)
    dates = one.select(F.explode(F.sequence(first, day(basis), F.expr("interval 1 day"))).alias("tx_date"))
    inside = lambda df: df.where(F.col("tx_date").between(F.date_sub(day(basis), days - 1), day(basis)))
    if scope.sku_id is None:
        facts, active = inside(scope.filter(agg)), F.sum("active_sku_count")
    else:
        facts = inside(scope.filter(sparse, grid)).withColumn("net_sales_amount", F.col("sales_amount") - F.col("return_amount"))
        active = F.count_if(F.col("sales_qty") > 0)
    sums = facts.groupBy("tx_date").agg(total("sales_amount"), total("return_amount"), total("net_sales_amount"), total("sales_qty"), total("return_qty"), active.alias("active_sku_count"))
    records = inside(scope.filter(raw)).where("qty > 0").groupBy("tx_date").agg(F.count(F.lit(1)).alias("sales_record_count"))
    out = dates.join(sums, "tx_date", "left").join(records, "tx_date", "left").na.fill(0)
    return out.withColumn("return_rate", r6(div(F.col("return_amount"), F.col("sales_amount"))))


def daily_head(line: DataFrame, sparse: DataFrame, grid: DataFrame, forecast: DataFrame, scope: Scope, basis: str) -> DataFrame:
    """The basis day's figures, the latest forecast week not after it, and the quantity sold by unit (units on the grid that day, zero included)."""
    weeks = forecast.where(F.col("week_st") <= day(basis)).agg(F.max("week_st")).scalar()
    units = scope.filter(grid).where(F.col("grid_start") <= day(basis)).select(*SKU, "option_code")
    sold = sparse.where(F.col("tx_date") == day(basis)).select(*SKU, "sales_qty")
    by = units.join(sold, SKU, "left").groupBy("option_code").agg(F.coalesce(F.sum("sales_qty"), F.lit(0)).cast("bigint").alias("q"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "option_code", F.col("q").cast("string")))), ";")  # a unit each
    return line.where(F.col("tx_date") == day(basis)).withColumns({"forecast_basis_week": weeks, "sales_qty_by_unit": by.agg(text).scalar()})


def product_activity(sparse: DataFrame, raw: DataFrame, master: DataFrame, scope: Scope, basis: str) -> DataFrame:
    rows = scoped(sparse.where(F.col("tx_date") == day(basis)), master, scope, ["product_name"])
    records = raw.where((F.col("tx_date") == day(basis)) & (F.col("qty") > 0)).groupBy(*SKU).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(records, SKU, "left").select(*SKU, "product_name", "sales_qty", "return_qty", "sales_amount", "inbound_qty", F.coalesce("_n", F.lit(0).cast("bigint")).alias("record_count"))


def daily_transactions(sparse: DataFrame, grid: DataFrame, scope: Scope, basis: str, days: int) -> DataFrame:
    """Day by day movements of one SKU, zeros included, not before its first grid date."""
    span = scope.filter(grid).select(*SKU, F.explode(F.sequence(
        F.greatest(F.date_sub(day(basis), days - 1), F.col("grid_start")), day(basis), F.expr("interval 1 day"))).alias("tx_date"))
    cols = ["inbound_qty", "outbound_qty", "sales_qty", "return_qty"]
    return span.join(sparse.select(*SKU, "tx_date", *cols), [*SKU, "tx_date"], "left").na.fill(0, cols)


PICKER_SORTS = {"name": "product_name", "recent": "sales_qty", "h1": "h1_pred", "amount": "sales_amount"}


def product_picker(master: DataFrame, wide: DataFrame, demand: DataFrame, basis: str, scope: Scope, text: str, sort: str = "h1", forecast: str = "all") -> DataFrame:
    """All products that match, with forecast and recent sales, sorted by name or by one of the values (largest first, missing last).

    ``forecast``: all, available (one horizon at least) or unavailable. Nothing is cut off; a caller pages through the sorted rows.
    """
    fc = wide.where(F.col("week_st") == day(basis)).select(*SKU, "h1_pred", "h2_pred", "h4_pred")
    recent = demand.where(F.col("week_st") == day(basis)).select(*SKU, "sales_qty", "sales_amount")
    rows = search_products(scope.filter(master), text, ["product_name", "barcode"]).join(fc, SKU, "left").join(recent, SKU, "left")
    has = F.coalesce("h1_pred", "h2_pred", "h4_pred").isNotNull()
    if forecast != "all":
        rows = rows.where(has if forecast == "available" else ~has)
    by = F.col("product_name") if sort == "name" else F.desc_nulls_last(PICKER_SORTS[sort])
    return rows.orderBy(by, *SKU).select(*SKU, "product_name", "option_code", has.cast("int").alias("has_forecast"), r6(F.col("h1_pred")).alias("h1_pred"), "sales_qty", "sales_amount")


def kpi_list(demand: DataFrame, raw: DataFrame, master: DataFrame, scope: Scope, basis: str) -> DataFrame:
    """The products behind three figures (sales, record count, selling SKUs), with the bar length relative to the figure's largest value."""
    at = scoped(demand.where(F.col("week_st") == day(basis)), master, scope, ["product_name"])
    week = raw.where((F.col("qty") > 0) & F.col("tx_date").between(day(basis), F.date_add(day(basis), 6)))
    records = week.groupBy(*SKU).agg(F.count(F.lit(1)).cast("double").alias("records"))
    rows = at.join(records, SKU, "left").select(
        *SKU, "product_name", F.explode(F.array(*[F.struct(F.lit(f).alias("figure"), v.cast("double").alias("value")) for f, v in (
            ("sales", F.col("sales_amount")), ("records", F.col("records")), ("skus", F.when(F.col("sales_qty") > 0, F.col("sales_qty"))))])).alias("x")
    ).select(*SKU, "product_name", "x.figure", "x.value").where("value > 0")
    top = rows.groupBy("figure").agg(F.max("value").alias("_top"))
    return rows.join(top, "figure").select(*SKU, "product_name", "figure", r6(F.col("value")).alias("value"), r6(div(F.col("value"), F.col("_top"))).alias("bar"))
