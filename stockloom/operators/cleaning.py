"""Row and column cleaning of purchase and sales extracts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions import columns as C

# Impossible (work type, amount sign, quantity sign) combinations per centre.
IMPOSSIBLE_SIGNS = {
    "A": [("outbound", 0, -1), ("inbound", 0, 1)],
    "B": [("outbound", 1, 1), ("outbound", 0, -1), ("outbound", 0, 1), ("inbound", -1, 1), ("inbound", 0, -1)],
}


def conform_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename to one vocabulary; names that are absent are ignored."""
    return df.withColumnsRenamed(names)


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def union_labelled(frames: dict[str, DataFrame], label: str = "_source_sheet") -> DataFrame:
    """Stack frames of one layout and remember where each row came from."""
    parts = [df.withColumn(label, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def valid_barcode(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.trim(col).isin("", "0"))


def valid_lengths(df: DataFrame, zip_col: str, barcode_col: str) -> DataFrame:
    zip_ok = F.coalesce(C.number(F.col(zip_col)) >= 1000, F.lit(True))
    return df.where(zip_ok & F.coalesce(F.length(barcode_col).isin(*C.BARCODE_LENGTHS), F.lit(False)))


def impossible_sign(center: str, work_type: str, amount: str, qty: str) -> Column:
    hits = [(F.col(center) == c) & (F.col(work_type) == w) & (C.signed(F.col(amount)) == a) & (C.signed(F.col(qty)) == q)
            for c, combos in IMPOSSIBLE_SIGNS.items() for w, a, q in combos]
    return F.coalesce(reduce(lambda x, y: x | y, hits), F.lit(False))


def drop_sign_combo(df: DataFrame, center="center_id", work_type="work_type", amount="amount", qty="qty") -> DataFrame:
    return df.where(~impossible_sign(center, work_type, amount, qty))


def null_tokens(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: C.null_token(F.col(c)) for c in cols})


def flag_complete(df: DataFrame, levels: list[str], flag: str = "is_complete") -> DataFrame:
    """Mark rows with every level present; the two outputs are two filters on the mark."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in levels])
    return df.withColumn(flag, whole.cast("int"))


def holiday_canonical(df: DataFrame, col: str, names: list[str]) -> DataFrame:
    """Keep only the named holidays and collapse their variants to the plain name."""
    chosen = F.coalesce(*[F.when(F.col(col).contains(n), F.lit(n)) for n in names])
    return df.withColumn(col, chosen).where(F.col(col).isNotNull())


def ymd(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns({"y": F.year(col), "m": F.month(col), "d": F.day(col)})


def category_codes(df: DataFrame, code: str, width: int = 8) -> DataFrame:
    """Pad the code and cut the level prefixes (2 + 2 + 2 + 2 digits)."""
    full = C.pad_left(F.trim(F.col(code).cast("string")), width)
    return df.withColumn("code", full).withColumns({f"code_l{i}": F.substring("code", 1, 2 * i) for i in (1, 2, 3)})


def repair_category(df: DataFrame, level1: str, level3: str, by_level3: dict[str, str]) -> DataFrame:
    """Replace a failed level 1 by the value its level 3 implies."""
    fix = reduce(lambda acc, kv: acc.when(F.col(level3) == kv[0], F.lit(kv[1])),
                 list(by_level3.items())[1:],
                 F.when(F.col(level3) == next(iter(by_level3)), F.lit(next(iter(by_level3.values())))))
    return df.withColumn(level1, F.when(F.col(level1) == "ERROR", F.coalesce(fix, F.col(level1))).otherwise(F.col(level1)))


def apply_corrections(df: DataFrame, corrections: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Keyed corrections win over stored values; each corrected column keeps its old value otherwise."""
    fix = corrections.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    out = df.join(fix, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in cols}).drop(*[f"_{c}" for c in cols])


def sign_split(df: DataFrame, qty: str = "qty", amount: str = "amount") -> DataFrame:
    """Positive quantities are sales, negative ones returns (turned positive)."""
    q, a = F.col(qty), F.col(amount)
    zero_q, zero_a = F.lit(0).cast("bigint"), F.lit(0).cast("decimal(18,2)")
    return df.withColumns({
        "sales_qty": F.when(q > 0, q).otherwise(zero_q), "return_qty": F.when(q < 0, -q).otherwise(zero_q),
        "sales_amount": F.when(q > 0, a).otherwise(zero_a), "return_amount": F.when(q < 0, -a).otherwise(zero_a)})


def code_valid(df: DataFrame, codes: DataFrame, col: str, flag: str = "is_valid") -> DataFrame:
    known = codes.select(F.col(col)).distinct().withColumn("_known", F.lit(1))
    return df.join(known, col, "left").withColumn(flag, F.coalesce("_known", F.lit(0))).drop("_known")


def select_features(df: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """Keep the keys and every column whose name matches the pattern."""
    return df.select(*keys, *[c for c in df.columns if c not in keys and re.fullmatch(pattern, c)])
