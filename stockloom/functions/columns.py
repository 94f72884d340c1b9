"""Column-level building blocks. Everything is a built-in Spark expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean "no value" in the extracts.
NULL_TOKENS = ("", "nan", "None", "NULL", "N/A", "-")
# Barcode lengths that are kept.
BARCODE_LENGTHS = (8, 12, 13, 14)
# Fixed value: weeks since the last sale are capped here.
MAX_WEEKS_INACTIVE = 156
SKU_SEPARATOR = "*"


def r6(col: Column) -> Column:
    return F.round(col, 6)


def mean6(total: str, count: str) -> Column:
    """Mean of whole numbers, rounded half up to six places by whole division; exact where a float would fall on either side of a half."""
    return F.expr(f"cast((2000000 * cast({total} as decimal(28,0)) + {count}) div (2 * nullif({count}, 0)) as double) / 1000000")


def div(a: Column, b: Column) -> Column:
    """Double division; NULL when the divisor is zero or unknown."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def pad_left(col: Column, width: int) -> Column:
    """Left-pad with zeros without cutting longer values."""
    return F.when(F.length(col) >= width, col).otherwise(F.lpad(col, width, "0"))


def parse_date(col: Column) -> Column:
    """Drop commas and read as a date; unreadable text becomes NULL."""
    return F.try_to_timestamp(F.trim(F.regexp_replace(col, ",", ""))).cast("date")


def number(col: Column) -> Column:
    return col.try_cast("double")


def zip5(col: Column) -> Column:
    """Five-digit zip text; blank stays blank, non-numeric text is trimmed and padded."""
    text = F.trim(col)
    value = number(text)
    numeric = value.isNotNull() & ~F.isnan(value)
    return (F.when(col.isNull() | text.isin("", "nan"), F.lit(""))
            .when(numeric, pad_left(value.cast("bigint").cast("string"), 5))
            .otherwise(pad_left(text, 5)))


def null_token(col: Column) -> Column:
    text = F.trim(col)
    return F.when(text.isin(*NULL_TOKENS), F.lit(None)).otherwise(text)


def strip_blanks(col: Column) -> Column:
    """Remove ASCII white space and the ideographic space."""
    return F.regexp_replace(col, "[\\s　]+", "")


def map_values(col: Column, mapping: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col)


def split_once(col: Column) -> tuple[Column, Column]:
    """Split on the first blank; the second part is NULL when there is none."""
    parts = F.split(col, " ", 2)
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))


def sku_key(barcode: str, option: str, cluster: str) -> Column:
    return F.concat_ws(SKU_SEPARATOR, F.col(barcode), F.col(option), F.col(cluster).cast("string"))


def sku_parts(col: Column) -> list[Column]:
    parts = F.split(col, "\\*")
    return [F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3)]


def week_start(col: Column) -> Column:
    return F.trunc(col.cast("date"), "week")


def log1p_clip(col: Column) -> Column:
    return F.log1p(F.greatest(col.cast("double"), F.lit(0.0)))


def expm1_clip(col: Column) -> Column:
    """Back-transform to a quantity; a non-finite result becomes NULL."""
    raw = F.expm1(col)
    return F.when(F.isnan(raw) | (raw == float("inf")), F.lit(None)).otherwise(F.greatest(raw, F.lit(0.0)))


def cap_weeks(col: Column) -> Column:
    limit = F.lit(MAX_WEEKS_INACTIVE)
    return F.least(F.coalesce(col, limit), limit)


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + month


def parse_horizon(col: Column) -> Column:
    return F.regexp_extract(col.cast("string"), "(\\d+)", 1).try_cast("int")


def signed(col: Column) -> Column:
    return F.signum(col).cast("int")
