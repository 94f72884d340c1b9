"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine >= t lie within epsilon = sqrt(2 - 2t). Vectors are sorted by their grid cells (side epsilon) on the leading
principal dimensions, and the sequence is cut into blocks. Intervals of the sequence are joined recursively: a pair of intervals is
dropped when their bounding boxes are more than epsilon apart, else their sixteenths are paired, down to blocks. Inside a task the
recursion goes on to short runs of rows, where a product in single precision screens and one in double precision decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import components, labels_of, stored
from stockloom.llm.vectors import in_blocks, matrix, valid

BLOCK, RUN, FAN, DIMENSIONS = 4096, 512, 16, 4


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(vectors: DataFrame, width: int) -> np.ndarray:
    """The leading principal directions of all unit vectors (rows); width^2 sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, outer, n = np.zeros(width), np.zeros((width, width)), 0
        for batch in batches:
            if batch.num_rows:
                u = unit(matrix(batch.column(0), width))
                total, outer, n = total + u.sum(0), outer + u.T @ u, n + len(u)
        values = np.concatenate([[n], total, outer.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "value"])

    sums = dict(vectors.select("e").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value")).collect())
    flat = np.array([sums.get(k, 0.0) for k in range(1 + width + width * width)])
    mean, outer = flat[1 : 1 + width] / max(1, flat[0]), flat[1 + width :].reshape(width, width) / max(1, flat[0])
    return np.linalg.eigh(outer - np.outer(mean, mean))[1][:, ::-1][:, :DIMENSIONS].T


def _gap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Squared distance of two boxes."""
    apart = F.zip_with(F.zip_with(low_a, high_b, lambda x, y: x - y), F.zip_with(low_b, high_a, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)


def interval_pairs(blocks: DataFrame, count: int, reach: float) -> DataFrame:
    """Pairs (a <= b) of block numbers whose boxes are within ``reach`` (squared), by recursion from the whole sequence."""
    levels = max(1, math.ceil(math.log(max(count, 2), FAN)))
    boxes = blocks.select("block", "low", "high")
    pairs = None
    for level in range(levels - 1, -1, -1):
        own = F.floor(F.col("block") / FAN**level)
        corner = [F.array(*(f(F.get(c, F.lit(k))) for k in range(DIMENSIONS))).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
        node = boxes.groupBy(own.alias("at")).agg(*corner).withColumn("up", F.floor(F.col("at") / FAN))
        if pairs is None:
            pairs = node.groupBy("up").agg(F.lit(1)).select(F.col("up").alias("a"), F.col("up").alias("b"))
        left = node.select(F.col("up").alias("a"), F.col("at").alias("a2"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
        right = node.select(F.col("up").alias("b"), F.col("at").alias("b2"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
        near = pairs.join(left, "a").join(right, "b").filter("a2 <= b2").filter(_gap(F.col("low_a"), F.col("high_a"), F.col("low_b"), F.col("high_b")) <= reach)
        pairs = stored(near.select(F.col("a2").alias("a"), F.col("b2").alias("b")), "interval-pairs")
    return pairs


def _join(threshold: float, reach: float, width: int):
    def box(y):
        return y.min(0), y.max(0)

    def runs(a, b, ya, yb, same, i, m, j, n):
        """Pairs of short runs, rows i..m of one block and j..n of the other, by halving the longer interval."""
        (la, ha), (lb, hb) = box(ya[i:m]), box(yb[j:n])
        if same and n <= i:
            return
        if (np.maximum(0, np.maximum(la - hb, lb - ha)) ** 2).sum() > reach:
            return
        if m - i <= RUN and n - j <= RUN:
            yield i, m, j, n
        elif m - i >= n - j:
            half = (i + m) // 2
            yield from runs(a, b, ya, yb, same, i, half, j, n)
            yield from runs(a, b, ya, yb, same, half, m, j, n)
        else:
            half = (j + n) // 2
            yield from runs(a, b, ya, yb, same, i, m, j, half)
            yield from runs(a, b, ya, yb, same, i, m, half, n)

    def unpack(row):
        x = np.frombuffer(row["vectors"], "<f8").reshape(-1, width)
        return np.frombuffer(row["nodes"], "<i8"), np.frombuffer(row["counts"], "<i8"), x, x.astype(np.float32), np.frombuffer(row["places"], "<f8").reshape(-1, DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(k)[r].as_py() for k, name in enumerate(batch.schema.names)}
                same = row["a"] == row["b"]
                na, ca, xa, fa, ya = unpack(row["left"])
                nb, cb, xb, fb, yb = (na, ca, xa, fa, ya) if same else unpack(row["right"])
                shift = 0 if same else len(na)
                nodes = na if same else np.concatenate([na, nb])
                links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
                for i, m, j, n in runs(xa, xb, ya, yb, same, 0, len(na), 0, len(nb)):
                    close = fa[i:m] @ fb[j:n].T >= threshold - 1e-5
                    if same:
                        close &= np.arange(i, m)[:, None] < np.arange(j, n)[None, :]
                    if not close.any():
                        continue
                    p, q = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
                    sure = (xa[i + p] @ xb[j + q].T >= threshold) & close[np.ix_(p, q)]
                    u, v = np.nonzero(sure)
                    if not len(u):
                        continue
                    u, v = i + p[u], j + q[v]
                    links += np.bincount(u, cb[v], len(nodes)).astype(np.int64) + np.bincount(v + shift, ca[u], len(nodes)).astype(np.int64)
                    own = np.flatnonzero(label != np.arange(len(label)))
                    label = labels_of(len(nodes), np.concatenate([own, u]), np.concatenate([label[own], v + shift]))
                at = np.flatnonzero(links)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(links[at]), pa.array(nodes[label[at]])], names=["a", "links", "b"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Per row: id, ``n_links`` (other rows with cosine >= ``threshold``), ``component_id`` (smallest id reachable), ``kept`` (id is that one).

    Rows whose vector is null, empty, zero, or has null or non-finite components link with nothing: no links, their own component, kept.
    Vectors shorter than the longest count as padded with zeros. Equal vectors are one node with a count: they are linked with each other
    but never paired. Repeated rows count as rows. Other columns are not read; empty tables give empty results. ``threshold`` must be > 0.
    """
    spark = vectors.sparkSession
    e = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # turns -0.0 into 0.0
    usable = valid(F.col(vector_col)) & F.exists(F.col(vector_col), lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable, e).alias("e"))
    classes = stored(rows.filter("e IS NOT NULL").groupBy("e").agg(F.min("id").alias("rep"), F.count("*").alias("cnt")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    width = classes.agg(F.max(F.size("e"))).first()[0]
    if width is None:
        found = classes.select("node", F.lit(0).cast("bigint").alias("links"), F.col("rep").alias("component_id"))
    else:
        epsilon = math.sqrt(2 - 2 * threshold)
        reach = epsilon**2 + 1e-9
        axes = principal(classes, width)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = unit(matrix(batch.column(2), width)) if batch.num_rows else np.zeros((0, width))
                y = np.zeros((len(u), DIMENSIONS))
                y[:, : len(axes)] = u @ axes.T
                cells = np.floor(y / epsilon).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in u], pa.binary()), pa.array([r.tobytes() for r in y], pa.binary()), *(pa.array(cells[:, k]) for k in range(DIMENSIONS))],
                                                 names=["node", "cnt", "u", "y", *(f"c{k}" for k in range(DIMENSIONS))])

        cells = [f"c{k}" for k in range(DIMENSIONS)]
        placed = classes.select("node", "cnt", "e").mapInArrow(place, "node long, cnt long, u binary, y binary, " + ", ".join(f"{c} int" for c in cells))
        parts = max(1, math.ceil(classes.count() / (4 * BLOCK)))
        ordered = placed.repartitionByRange(parts, *cells, "node").sortWithinPartitions(*cells, "node")

        def pack(t: pa.Table) -> tuple:
            y = np.frombuffer(b"".join(t.column("y").to_pylist()), "<f8").reshape(-1, DIMENSIONS)
            return (t.column("node").to_numpy().astype("<i8").tobytes(), t.column("cnt").to_numpy().astype("<i8").tobytes(), b"".join(t.column("u").to_pylist()), y.tobytes(), y.min(0).tolist(), y.max(0).tolist())

        blocks = in_blocks(ordered, pack, "nodes binary, counts binary, vectors binary, places binary, low array<double>, high array<double>", BLOCK, "grid-order")
        pairs = interval_pairs(blocks, blocks.count(), reach)
        payload = F.struct("nodes", "counts", "vectors", "places")
        left, right = blocks.select(F.col("block").alias("a"), payload.alias("left")), blocks.select(F.col("block").alias("b"), payload.alias("right"))
        both = pairs.repartition(max(1, min(2000, 2 * pairs.count())), "a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
        linked = stored(both.mapInArrow(_join(threshold, reach, width), "a long, links long, b long"), "vector-links")
        joined = components(linked.filter("a <> b"))
        links = linked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        known = classes.select("node", "rep").join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        found = known.join(known.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("node", "links", "component_id")
    info = classes.select("e", "node", "cnt").join(found, "node").select("e", (F.col("cnt") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(info, "e", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("e").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
