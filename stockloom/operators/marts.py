"""Weekly and daily fact tables: sales, purchases, dense grids, inventory and serving derivatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockloom.functions import columns as C
from stockloom.operators.cleaning import sign_split
from stockloom.sources.storage import pin

SKU = ["center_id", "sku_id"]
SALES = ["sales_qty", "return_qty", "sales_amount", "return_amount"]
PURCHASES = ["inbound_qty", "outbound_qty", "inbound_amount", "outbound_amount", "inbound_vat", "outbound_vat",
             "inbound_total_amount", "outbound_total_amount"]
MONEY = "decimal(18,2)"
FINE_MONEY = "decimal(18,4)"
_TYPES = {c: "bigint" for c in (*SALES, *PURCHASES) if c.endswith("qty")}
_TYPES |= {c: MONEY for c in (*SALES, *PURCHASES) if c.endswith("amount")}
_TYPES |= {c: FINE_MONEY for c in PURCHASES if "vat" in c or "total" in c}
INBOUND_ROWS = "inbound_rows"  # optional: purchases counted beside their sums, as an inbound SKU may sum to zero
_TYPES[INBOUND_ROWS] = "bigint"


def zero(col: str) -> Column:
    return F.lit(0).cast(_TYPES[col])


def filled(col: str) -> Column:
    return F.coalesce(F.col(col), zero(col)).alias(col)


def total(col: str) -> Column:
    return F.sum(col).cast(_TYPES.get(col, MONEY)).alias(col)


def sales_facts(sales: DataFrame, time: str) -> DataFrame:
    """Sales and returns per SKU and period, by the sign of the quantity."""
    return sign_split(sales).groupBy(*SKU, time).agg(*[total(c) for c in SALES])


def purchase_facts(purchases: DataFrame, time: str, counted: bool = False) -> DataFrame:
    """Inbound and outbound per SKU and period in one aggregate; signs are kept. ``counted`` adds the number of inbound rows."""
    inbound = F.col("work_type") == "inbound"
    raw = {"qty": "qty", "amount": "amount", "vat": "vat"}
    aggs = []
    for side, rule in (("inbound", inbound), ("outbound", F.col("work_type") == "outbound")):
        for name, col in raw.items():
            out = f"{side}_{name}"
            aggs.append(F.coalesce(F.sum(F.when(rule, F.col(col))).cast(_TYPES[out]), zero(out)).alias(out))
    if counted:
        aggs.append(F.count_if(inbound).alias(INBOUND_ROWS))
    facts = purchases.groupBy(*SKU, time).agg(*aggs)
    for side in ("inbound", "outbound"):
        out = f"{side}_total_amount"
        facts = facts.withColumn(out, (F.col(f"{side}_amount") + F.col(f"{side}_vat")).cast(FINE_MONEY))
    return facts


def first_by(col: str, *order: str) -> Column:
    """First known value in the given order; ties go to the smallest value."""
    return F.min(F.when(F.col(col).isNotNull(), F.struct(*order, col)))[col].alias(col)


def product_master(sales: DataFrame, order: str, attributes: list[str]) -> DataFrame:
    """First known value of each attribute. Repeats are removed by a hash aggregate before values are ordered."""
    seen = sales.groupBy(*SKU, *attributes).agg(F.min(order).alias(order))
    return seen.groupBy(*SKU).agg(*[first_by(c, order) for c in attributes])


def ambiguous_keys(sales: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Keys that occur with more than one cluster."""
    return (sales.groupBy(*keys).agg(F.min(cluster).alias("lo"), F.max(cluster).alias("hi"))
            .where("lo <> hi").select(*keys))


def cluster_profile(sales: DataFrame, keys: list[str], cluster: str = "cluster_no", name: str = "product_name",
                    spec: str = "spec", week: str = "week_st") -> DataFrame:
    """Names, specs and active weeks of every cluster: all that the decision needs from the sales."""
    return sales.groupBy(*keys, cluster, F.trim(F.col(name)).alias(name), F.trim(F.col(spec)).alias(spec)).agg(
        F.min(week).alias("lo"), F.max(week).alias("hi"))


def resolve_cluster(purchases: DataFrame, profile: DataFrame, keys: list[str], cluster: str = "cluster_no",
                    name: str = "product_name", spec: str = "spec", week: str = "week_st") -> DataFrame:
    """Decide the cluster of purchases whose key is ambiguous in the sales data.

    Rules in order: the only cluster with the same name, the only one with the same spec, the
    only period that contains the week when no two periods overlap. Adds ``resolved_cluster``
    (NULL when undecided) and ``rule``.
    """

    def only_cluster(text: str, out: str) -> DataFrame:
        known = profile.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias(f"_{text}"), cluster)
        return (known.groupBy(*keys, f"_{text}").agg(F.min(cluster).alias(out), F.max(cluster).alias("_hi"))
                .where(F.col(out) == F.col("_hi")).drop("_hi"))

    periods = profile.groupBy(*keys, cluster).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # clusters of one product are few, so the period list of a key is short
    before = F.lag("hi").over(W.partitionBy(*keys).orderBy("lo", cluster))
    ranges = (periods.withColumn("clash", F.coalesce(before >= F.col("lo"), F.lit(False)))
              .groupBy(*keys).agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "lo", "hi")).alias("_ranges"),
                                  F.max("clash").alias("_clash"), F.count(F.lit(1)).alias("_k"))
              .where("_k > 1"))
    out = (purchases.withColumns({f"_{name}": F.trim(F.col(name)), f"_{spec}": F.trim(F.col(spec))})
           .join(ranges, keys, "left")
           .join(only_cluster(name, "_by_name"), [*keys, f"_{name}"], "left")
           .join(only_cluster(spec, "_by_spec"), [*keys, f"_{spec}"], "left"))
    inside = F.filter("_ranges", lambda r: (r["lo"] <= F.col(week)) & (F.col(week) <= r["hi"]))
    by_date = F.when(~F.col("_clash") & (F.size(inside) == 1), F.try_element_at(inside, F.lit(1))["c"])
    rule = (F.when(F.col("_k").isNull(), "own").when(F.col("_by_name").isNotNull(), "name")
            .when(F.col("_by_spec").isNotNull(), "spec").when(by_date.isNotNull(), "date").otherwise("none"))
    decided = F.when(F.col("_k").isNull(), F.col(cluster)).otherwise(F.coalesce("_by_name", "_by_spec", by_date))
    return out.withColumns({"rule": rule, "resolved_cluster": decided}).drop(
        "_ranges", "_clash", "_k", "_by_name", "_by_spec", f"_{name}", f"_{spec}")


def resolved_purchases(purchases: DataFrame, sales: DataFrame, time: str) -> DataFrame:
    """Purchases of SKUs that were ever sold, with the decided cluster.

    Both sides are reduced first: purchases to their measures, sales to the (small) cluster
    profile. The profile is pinned because four joins read it.
    """
    keys = ["center_id", "barcode", "option_code"]
    detail = [*keys, "cluster_no", "product_name", "spec", "week_st", time, "work_type"]
    summed = purchases.groupBy(*dict.fromkeys(detail)).agg(
        F.sum("qty").alias("qty"), F.sum("amount").cast(MONEY).alias("amount"), F.sum("vat").cast(FINE_MONEY).alias("vat"))
    profile = pin(cluster_profile(sales, keys))
    sold = profile.select("center_id", C.sku_key("barcode", "option_code", "cluster_no").alias("sku_id")).distinct()
    found = resolve_cluster(summed, profile, keys).where("resolved_cluster is not null")
    return found.withColumn("sku_id", C.sku_key("barcode", "option_code", "resolved_cluster")).join(sold, SKU, "left_semi")


def merge_facts(sales: DataFrame, purchases: DataFrame, time: str) -> DataFrame:
    """Both fact sets on one key, zeros where a side is missing, with a single shuffle."""
    both = sales.unionByName(purchases, allowMissingColumns=True)
    return both.groupBy(*SKU, time).agg(*[
        F.coalesce(F.sum(c).cast(_TYPES[c]), zero(c)).alias(c) for c in _measures(both)])


def _measures(facts: DataFrame) -> list[str]:
    return [*PURCHASES, *SALES, *([INBOUND_ROWS] if INBOUND_ROWS in facts.columns else [])]


def densify(df: DataFrame, keys: list[str], time: str, days: int, end: Column, fill: dict[str, Column],
            begin: Column | None = None) -> DataFrame:
    """Insert the missing periods of every series up to ``end``.

    Each row is expanded to itself and the empty periods that follow it, so the grid needs one
    window over the series and no join. ``begin`` may start a series before its first row.
    ``fill`` gives the value of each measure in empty periods; other columns are carried.
    ``begin`` and ``end`` must be on the series' own period lattice.
    """
    w = W.partitionBy(*keys).orderBy(time)
    nxt = F.coalesce(F.lead(time).over(w), F.date_add(end, days))
    start = F.col(time) if begin is None else F.when(F.lag(time).over(w).isNull(), F.least(begin, F.col(time))).otherwise(F.col(time))
    steps = F.sequence(F.col("_from"), F.date_sub(F.col("_next"), days), F.expr(f"interval {days} days"))
    out = df.withColumns({"_next": nxt, "_from": start}).select("*", F.explode(steps).alias("_time"))
    own = F.col("_time") == F.col(time)
    return out.withColumns({c: F.when(own, F.col(c)).otherwise(v) for c, v in fill.items()}).withColumn(
        time, F.col("_time")).drop("_next", "_from", "_time")


def last_period(df: DataFrame, time: str) -> Column:
    return df.agg(F.max(time)).scalar()


def dense_mart(facts: DataFrame, time: str, days: int, end: Column) -> DataFrame:
    return densify(facts, SKU, time, days, end, {c: zero(c) for c in _measures(facts)})


def demand_mart(mart: DataFrame, time: str, regime_center: str, regime_start: str) -> DataFrame:
    regime = F.when(F.col("center_id") == regime_center,
                    F.when(F.col(time) >= F.lit(regime_start).cast("date"), "post").otherwise("pre"))
    return mart.select(*SKU, time, "sales_qty", "return_qty", (F.col("sales_qty") - F.col("return_qty")).alias("net_qty"),
                       "sales_amount", "return_amount",
                       (F.col("sales_amount") - F.col("return_amount")).cast(MONEY).alias("net_sales_amount"),
                       regime.alias("regime"))


def transaction_mart(mart: DataFrame, master: DataFrame, time: str) -> DataFrame:
    return mart.join(master.select(*SKU, "option_code"), SKU, "left").select(
        *SKU, time, "option_code", *PURCHASES, *SALES)


def inventory(mart: DataFrame, inbound_skus: DataFrame | None, time: str) -> DataFrame:
    """Estimated stock: an opening level that keeps the running balance from going below zero.

    Unknown for SKUs never bought: by the mart's own count of inbound rows, in the window that the balance needs anyway, or else by ``inbound_skus``.
    """
    series = W.partitionBy(*SKU)
    running = series.orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    delta = F.col("inbound_qty") + F.col("outbound_qty") - F.col("sales_qty")
    if inbound_skus is None:
        known = mart.withColumn("_in", F.max(INBOUND_ROWS).over(series) > 0)
    else:
        flag = inbound_skus.select(*SKU).distinct().withColumn("_in", F.lit(True))
        known = mart.join(flag, SKU, "left")
    out = (known.withColumn("_cum", F.sum(delta).over(running))
           .withColumn("_ret", F.sum("return_qty").over(running))
           .withColumn("_open", F.greatest(-F.min("_cum").over(series), F.lit(0).cast("bigint"))))
    has = F.coalesce("_in", F.lit(False))
    return out.select(
        *SKU, time, F.when(has, F.col("_open")).alias("opening_inventory"),
        F.when(has, F.col("_open") + F.col("_cum")).alias("inventory_return_excluded"),
        F.when(has, F.col("_open") + F.col("_cum") + F.col("_ret")).alias("inventory_return_included"),
        has.cast("int").alias("inventory_available"))


def summary_agg(demand: DataFrame, master: DataFrame, time: str, levels: list[str]) -> DataFrame:
    """Active rows summed to centre, period, category levels and unit."""
    active = demand.where("sales_qty <> 0 or return_qty <> 0 or sales_amount <> 0 or return_amount <> 0")
    return (active.join(master.select(*SKU, *levels, "option_code"), SKU)
            .groupBy("center_id", time, *levels, "option_code")
            .agg(total("sales_qty"), total("return_qty"), total("sales_amount"), total("return_amount"),
                 total("net_sales_amount"), F.count_if(F.col("sales_qty") > 0).alias("active_sku_count")))


def region_agg(sales: DataFrame, master: DataFrame, time: str, shares: int | None = None) -> DataFrame:
    """Sales per product, place and period.

    There are nearly as many groups as rows, so nothing is summed before the shuffle, and the caller may say into how many
    ``shares`` rows are dealt: a number that follows the rows bounds the groups that a task holds in memory.
    """
    keys = ["center_id", time, "sido", "sigungu", "sku_id", "product_name", "option_code"]
    return (sales.where("qty > 0").join(master.select(*SKU), SKU, "left_semi").select(*keys, "amount").repartition(*([shares] if shares else []), *keys)
            .groupBy(*keys).agg(F.sum("amount").cast(MONEY).alias("sales_amount")))


def sparse_activity(mart: DataFrame) -> DataFrame:
    return mart.where("inbound_qty <> 0 or outbound_qty <> 0 or sales_qty <> 0 or return_qty <> 0")


def sku_grid_start(facts: DataFrame, master: DataFrame, time: str, levels: list[str]) -> DataFrame:
    return (facts.groupBy(*SKU).agg(F.min(time).alias("grid_start"))
            .join(master.select(*SKU, "option_code", *levels), SKU, "left"))
