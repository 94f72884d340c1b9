"""What the two vector operators share: valid rows as padded arrays, and blocks of consecutive rows of a sorted table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stockloom.llm.common import stored


def valid(vector: Column) -> Column:
    """Not null, not empty, and every component present and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` doubles; shorter vectors are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def in_blocks(sorted_rows: DataFrame, pack, schema: str, block: int, label: str) -> DataFrame:
    """Blocks of up to ``block`` consecutive rows in each partition, ``pack``ed into a row each, stored, numbered 0, 1, ... in order.

    ``pack`` turns an Arrow table into a tuple for ``schema``. Numbering needs the blocks per partition only: a row per partition.
    """
    full = T._parse_datatype_string(f"part int, seq int, {schema}")
    names = full.names[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        arrow = to_arrow_schema(full)
        held, rows, seq, part = [], 0, 0, TaskContext.get().partitionId()

        def out(table: pa.Table) -> pa.RecordBatch:
            values = [part, seq, *pack(table)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= block:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, block).combine_chunks())
                seq, rows = seq + 1, rows - block
                held = table.slice(block).combine_chunks().to_batches()
        if rows:
            yield out(pa.Table.from_batches(held).combine_chunks())

    blocks = stored(sorted_rows.mapInArrow(run, full), label)
    counts = blocks.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    return blocks.join(before, "part").select((F.col("at") + F.col("seq")).alias("block"), *names)


def box_tree(blocks: DataFrame, total: int, fan: int) -> list[DataFrame]:
    """Boxes (at, low, high) of the numbered blocks, then of ``fan`` consecutive boxes each, up to one root."""
    levels = [blocks.select(F.col("block").alias("at"), "low", "high")]
    for _ in range(max(1, math.ceil(math.log(max(total, 2), fan)))):
        up = F.floor(F.col("at") / fan).cast("bigint")
        sides = levels[-1].select(up.alias("at"), F.posexplode(F.arrays_zip("low", "high")).alias("d", "side")).groupBy("at", "d").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"))
        whole = sides.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("d", "low", "high"))).alias("s"))  # a row per dimension
        levels.append(stored(whole.select("at", F.transform("s", lambda x: x["low"]).alias("low"), F.transform("s", lambda x: x["high"]).alias("high")), "box-tree"))
    return levels


def descend(asks: DataFrame, tree: list[DataFrame], fan: int, keep) -> DataFrame:
    """``asks`` with the number (``block``) of every block whose boxes ``keep`` (a condition on low and high) lets through from the root down."""
    found = asks.withColumn("at", F.lit(0).cast("bigint"))
    for level in reversed(tree[:-1]):
        child = level.select(F.col("at").alias("child"), F.floor(F.col("at") / fan).cast("bigint").alias("at"), "low", "high")
        found = found.join(child, "at").filter(keep()).select(*asks.columns, F.col("child").alias("at"))
    return found.withColumnRenamed("at", "block")
