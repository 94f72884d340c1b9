"""Small helpers shared by the operators: tables, stored tables, Arrow row functions, components of a graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stockloom.sources.storage import new_table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and the optimiser knows the size of what it reads."""
    path = new_table_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, schema: str | T.StructType, slices: Callable[[list[list]], list[list]], budget: int = 4_000_000) -> DataFrame:
    """Apply ``slices`` (columns of values in, columns of values out) to slices of each Arrow batch.

    A slice ends when the characters (or bytes) in it reach ``budget``, so memory does not depend on the batch setting.
    A single value larger than that makes a slice of its own.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def weights(column: pa.Array) -> np.ndarray:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.full(len(column), column.nbytes // max(1, len(column)) + 1, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for batch in batches:
            if not batch.num_rows:
                continue
            reached = np.cumsum(sum(weights(c) for c in batch.columns)) // budget
            ends = [*(np.flatnonzero(np.diff(reached)) + 1).tolist(), batch.num_rows]
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                columns = slices([c.to_pylist() for c in batch.slice(start, end - start).columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, out)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table: (node, component), the component being its smallest node. Nodes without edges do not appear.

    Alternating large-star and small-star steps; each round's edges are stored once, so a lost executor repeats one round at most.
    Joins are on the node; a hub's rows meet in one task, as the minima share the join's exchange. Edges never reach the driver, only their count and checksum do.
    """
    edge = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edge)
    if before[0]:
        for _ in range(most_rounds):
            both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.filter("u <> v").distinct()  # used three times below, its exchange is made once
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
            edge = stored(small.union(least).distinct(), "small-star")
            after = mark(edge)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
    member = edge.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.union(edge.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a stream sorted by the integer column ``key`` into tables of whole groups of about ``rows`` rows; with each the groups' starts.

    Holds ``rows`` and one group at a time. Callers bound their groups.
    """

    def cut(table: pa.Table) -> np.ndarray:
        keys = table.column(key).to_numpy()
        return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])

    held: list[pa.RecordBatch] = []
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() == keys[-1]:
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch])
            starts = cut(table)
            if len(starts) > 1:
                yield table.slice(0, int(starts[-1])), starts[:-1]
            held = table.slice(int(starts[-1])).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table)


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def pairs_in(starts: np.ndarray, total: int, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j inside groups that begin at ``starts`` of ``total`` rows, about ``most`` at a time."""
    sizes = np.diff(np.append(starts, total))
    for size in np.unique(sizes[sizes > 1]):
        begin = starts[sizes == size]
        if size <= 512:
            i, j = np.triu_indices(size, 1)
            step = max(1, most // len(i))
            for k in range(0, len(begin), step):
                at = begin[k : k + step, None]
                yield (at + i).ravel(), (at + j).ravel()
        else:
            for at in begin:
                first = 0
                while first < size - 1:
                    last = min(size - 1, first + max(1, most // (size - first)))
                    i = np.repeat(np.arange(first, last), size - 1 - np.arange(first, last))
                    j = np.concatenate([np.arange(r + 1, size) for r in range(first, last)])
                    yield at + i, at + j
                    first = last
