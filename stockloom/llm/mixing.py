"""Mixing sources to target weights by capped water-filling, with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096  # equal ranges of the sampling order in a source: a window never sees a whole source


def fill(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """Targets of a source table (``source``, ``source_size``): adds ``target``.

    Weights repeat over the sources by code point, null last. A target is min(epochs * size, weight * level). The level at which the
    targets sum to the total is found in closed form: sources by epochs * size / weight ascending saturate one after the other, and
    the first k are saturated when the k-th one's own level is not above that of the rest; this is where repeated redistribution ends.
    The windows run over one row per source, never over documents.
    """
    names = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * epochs)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    rows = rows.select(
        "*", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(rising), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rising), F.lit(0))).alias("open"),
    )
    # saturated if its cap is not above its share of what is left for it and all after it; then the level is that of the first open source
    saturated = F.col("cap") * F.col("open") <= F.col("left") * F.col("weight")
    rows = rows.withColumn("level", F.when(~saturated, F.struct(F.col("cap") / F.col("weight"), F.col("left").alias("left"), F.col("open").alias("open"))))
    rows = rows.withColumn("level", F.min("level").over(every))
    target = F.when(saturated | F.col("level").isNull(), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("level.left")).cast("double") / F.col("level.open").cast("double"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 7) -> DataFrame:
    """Per row: id, source, ``size`` (words), ``source_size``, ``target`` and ``taken`` (words the mix takes), ``times`` (whole copies).

    Every document is taken floor(target / source_size) times, and those first in a seeded order once more, until the rest of the target is
    reached; the document on the border is in if half of it still fits. So a source misses its target by half a document at most, and no
    document is taken more than ``epochs`` times. Null and empty texts have size 0 and are taken as the order says. Null sources are one
    source. Repeated rows tie in the order; each is decided as a row, so a rerun gives the same rows. Empty tables give empty results.
    Only id, source and size are shuffled. Order ranges are summed first, so a source with most rows is cut into ``BINS`` windows.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), _draw(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), seed).alias("draw"),
    )
    decided = _decide(stored(_binned(rows), "sizes"), "id", weights, epochs)
    taken = (F.col("times") * F.col("size")).cast("bigint").alias("taken")
    return decided.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken, "times")


def _draw(key: Column, text: Column, seed: int) -> Column:
    """A seeded place in the order from id and text, so that rows with equal or null ids are spread over the bins."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(text)))


def _binned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bin", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int"))


def _decide(rows: DataFrame, key: str, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``times`` to stored rows of ``key``, source, size, draw and bin; equal draws go by ``key``."""
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    targets = fill(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, epochs)
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = bins.withColumn("start", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).drop("bin_size")
    b = ranges.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select("b.source", "bin", "start", "source_size", "target")
    inside = Window.partitionBy("source", "bin").orderBy("draw", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    joined = placed.join(b.alias("b"), F.expr("d.source <=> b.source AND d.bin = b.bin")).select(f"d.{key}", "d.source", "d.size", "source_size", "target", (F.col("offset") + F.col("start")).alias("place"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = F.col("target") - whole * F.col("source_size")
    times = whole + F.when((whole < epochs) & (F.col("place") + F.col("size") / 2 <= rest) & (F.col("place") < rest), 1).otherwise(0)
    return joined.select(key, "source", "size", "source_size", "target", times.cast("bigint").alias("times"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 7) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with all its columns.

    As ``mix``, and every row is decided and copied by itself: rows with equal or null ids do not add to each other. Rows are numbered when stored, once, so that decisions find their row again.
    """
    whole = docs.select(F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.coalesce(F.col(f"doc.`{text_col}`"), F.lit(""))
    draw = _draw(F.col(f"doc.`{id_col}`"), text, seed)
    size = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    rows = stored(_binned(whole.select("doc", F.monotonically_increasing_id().alias("row"), F.col(f"doc.`{source_col}`").alias("source"), size.alias("size"), draw.alias("draw"))), "mix-rows")
    times = _decide(rows.drop("doc"), "row", weights, epochs).filter("times > 0").select("row", "times")
    taken = rows.select("doc", "row").join(times, "row")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc.*")


MIX_SQL = """
WITH d AS (
 SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS draw
 FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap FROM s),
r AS (
 SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
  (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS n
 FROM w),
l AS (SELECT rest AS l_rest, n AS l_n FROM r WHERE cap::HUGEINT * n > rest::HUGEINT * weight ORDER BY cap::DOUBLE / weight, weight, source NULLS LAST LIMIT 1),
t AS (
 SELECT source, source_size, CASE WHEN cap::HUGEINT * n <= rest::HUGEINT * weight OR l_rest IS NULL THEN cap::DOUBLE ELSE (weight * l_rest)::DOUBLE / l_n::DOUBLE END AS target
 FROM r LEFT JOIN l ON true),
p AS (
 SELECT doc_id, d.source, size, source_size, target,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place,
  CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (
 SELECT doc_id, size, source_size, target,
  whole + CASE WHEN whole < 3 AND place + size / 2 <= target - whole * source_size AND place < target - whole * source_size THEN 1 ELSE 0 END AS times
 FROM p)
"""


def mix_sql(docs: str = "documents") -> str:
    return MIX_SQL.replace("{docs}", docs) + "SELECT doc_id, size, source_size, target, (times * size)::BIGINT AS taken FROM m"
