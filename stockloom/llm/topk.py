"""Exact top-k inner products by pivot-table elimination.

With M the largest norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0). Then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the
best scores are the nearest rows. Distances of every row to many pivots are precomputed; the largest |d(q, p) - d(x, p)| over the pivots
is a lower bound of the distance and so gives an upper bound of the score. Rows are scored in the order of that bound until no bound left
reaches the k-th best score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import stored
from stockloom.llm.vectors import box_tree, descend, in_blocks, matrix, valid

PIVOTS, POOL = 32, 512  # pivots come from a pool of the rows with the smallest hashes; they steer speed, never results
ROWS, QUERIES, CHUNK, FAN = 4096, 256, 256, 16


def _pivots(pool: np.ndarray) -> np.ndarray:
    """Far-apart rows of the pool, each the farthest from those before it."""
    chosen, gap = [0], ((pool - pool[0]) ** 2).sum(1)
    while len(chosen) < min(PIVOTS, len(pool)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((pool - pool[chosen[-1]]) ** 2).sum(1))
    return pool[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T))


def lift(x: np.ndarray, square: float, query: bool) -> np.ndarray:
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, square - (x * x).sum(1)))
    return np.concatenate([x, last[:, None]], axis=1)


def best(q: np.ndarray, q_table: np.ndarray, own: int, x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, table_gap: np.ndarray, square: float, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) rows of one block for one query, at ``least`` or above: (rows, scores)."""
    slack = 1 + 1e-6 * square
    bound = (q @ q + square - table_gap**2) / 2 + slack
    order = np.flatnonzero(bound >= least)
    order = order[np.argsort(-bound[order], kind="stable")]
    rows, scores = np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(order), CHUNK):
        if len(rows) >= k and bound[order[at]] < scores[-1]:
            break
        some = order[at : at + CHUNK]
        some = some[nodes[some] != own]
        rows, scores = np.concatenate([rows, some]), np.concatenate([scores, x[some] @ q])
        top = np.lexsort((nodes[rows], ids[rows], -scores))[:k]
        rows, scores = rows[top], scores[top]
    keep = scores >= least
    return rows[keep], scores[keep]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query (a row whose id is divisible by ``every``) its ``k`` rows of highest integer inner product: query_id, rank, vec_id, score.

    Components become floor(scale * x). Candidates are all rows but the query's own; fewer than k rows give all. Ties go to the smaller id,
    then to the row stored first. Rows with a null or empty vector or a null or non-finite component take no part, nor do rows without an
    id. Repeated rows are rows of their own, as candidates and as queries. Shorter vectors count as padded with zeros. Scores are exact
    while squared norms stay below 2^53. Other columns are not read; empty tables give empty results.

    Queries are met in blocks with the blocks of rows that their bounds cannot exclude, starting from the k-th score inside their own block.
    """
    spark = vectors.sparkSession
    e = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.filter(valid(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), e.alias("e"))
    rows = stored(rows.withColumn("node", F.monotonically_increasing_id()), "vectors")
    square, width, count = rows.agg(F.max(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)), F.max(F.size("e")), F.count("*")).first()
    if not count:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pool = rows.orderBy(F.xxhash64("e", "node"), "node").limit(POOL).select("e").toArrow()
    pivots = _pivots(lift(matrix(pool.column("e"), width), square, False))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), width)
            table = _distances(lift(x, square, False), pivots)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in table], pa.binary()),
                                              pa.array(table.argmin(1).astype(np.int32)), pa.array(table.min(1))], names=["id", "node", "x", "table", "cell", "near"])

    placed = rows.select("id", "node", "e").mapInArrow(place, "id long, node long, x binary, table binary, cell int, near double")
    ordered = placed.repartitionByRange(max(1, math.ceil(count / (4 * ROWS))), "cell", "near", "node").sortWithinPartitions("cell", "near", "node")
    p = len(pivots)

    def pack(t: pa.Table) -> tuple:
        table = np.frombuffer(b"".join(t.column("table").to_pylist()), "<f8").reshape(-1, p)
        return (t.column("id").to_numpy().astype("<i8").tobytes(), t.column("node").to_numpy().astype("<i8").tobytes(), b"".join(t.column("x").to_pylist()), table.tobytes(), table.min(0).tolist(), table.max(0).tolist())

    blocks = in_blocks(ordered, pack, "ids binary, nodes binary, xs binary, tables binary, low array<double>, high array<double>", ROWS, "row-blocks")

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query of a block with its k-th score inside the block (minus infinity if there are fewer rows)."""
        for batch in batches:
            for r in range(batch.num_rows):
                ids, nodes = (np.frombuffer(batch.column(c)[r].as_py(), "<i8") for c in (1, 2))
                x, table = np.frombuffer(batch.column(3)[r].as_py(), "<f8").reshape(-1, width), np.frombuffer(batch.column(4)[r].as_py(), "<f8").reshape(-1, p)
                own = np.flatnonzero(ids % every == 0)
                q_tables = _distances(lift(x[own], square, True), pivots)
                least = []
                for i, q_table in zip(own, q_tables, strict=True):
                    _, scores = best(x[i], q_table, nodes[i], x, nodes, ids, np.abs(q_table - table).max(1), square, k, -math.inf)
                    least.append(float(scores[k - 1]) if len(scores) >= k else -math.inf)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(nodes[own]), pa.array([x[i].tobytes() for i in own], pa.binary()), pa.array([t.tobytes() for t in q_tables], pa.binary()),
                                                  pa.array(least, pa.float64()), pa.array(q_tables.argmin(1).astype(np.int32) if len(own) else [], pa.int32())], names=["id", "node", "x", "table", "least", "cell"])

    seeded = blocks.select("block", "ids", "nodes", "xs", "tables").mapInArrow(seed, "id long, node long, x binary, table binary, least double, cell int")
    seeded = stored(seeded, "queries")
    asked = seeded.count()
    q_sorted = seeded.repartitionByRange(max(1, math.ceil(asked / (4 * QUERIES))), "cell", "node").sortWithinPartitions("cell", "node")

    def pack_queries(t: pa.Table) -> tuple:
        x, table = np.frombuffer(b"".join(t.column("x").to_pylist()), "<f8").reshape(-1, width), np.frombuffer(b"".join(t.column("table").to_pylist()), "<f8").reshape(-1, p)
        least = t.column("least").to_numpy()
        return (t.column("id").to_numpy().astype("<i8").tobytes(), t.column("node").to_numpy().astype("<i8").tobytes(), x.tobytes(), table.tobytes(), least.astype("<f8").tobytes(),
                table.min(0).tolist(), table.max(0).tolist(), float((x * x).sum(1).max()), float(least.min()))

    asks = in_blocks(q_sorted, pack_queries, "q_ids binary, q_nodes binary, qs binary, q_tables binary, leasts binary, q_low array<double>, q_high array<double>, q_square double, q_least double", QUERIES, "query-blocks")
    asks = asks.withColumnRenamed("block", "ask")

    # from a tree over the row blocks: a box stays if its bound can reach the lowest score that a query of the block still needs
    tree = box_tree(blocks, blocks.count(), FAN)

    def reaches():
        apart = F.zip_with(F.zip_with("q_low", "high", lambda a, b: a - b), F.zip_with("low", "q_high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
        return (F.col("q_square") + F.lit(square) - F.pow(F.array_max(apart), 2)) / 2 + 1 + F.lit(1e-6 * square) >= F.col("q_least")

    pairs = stored(descend(asks.select("ask", "q_low", "q_high", "q_square", "q_least"), tree, FAN, reaches).select("ask", "block"), "block-pairs")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                value = {name: batch.column(c)[r].as_py() for c, name in enumerate(batch.schema.names)}
                ids, nodes, q_ids, q_nodes = (np.frombuffer(value[c], "<i8") for c in ("ids", "nodes", "q_ids", "q_nodes"))
                x, qs = (np.frombuffer(value[c], "<f8").reshape(-1, width) for c in ("xs", "qs"))
                table, q_table = (np.frombuffer(value[c], "<f8").reshape(-1, p) for c in ("tables", "q_tables"))
                least = np.frombuffer(value["leasts"], "<f8")
                found = [best(qs[i], q_table[i], q_nodes[i], x, nodes, ids, np.abs(q_table[i] - table).max(1), square, k, least[i]) for i in range(len(q_ids))]
                each, at, scores = [len(f[0]) for f in found], np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                columns = [np.repeat(q_nodes, each), np.repeat(q_ids, each), ids[at], nodes[at], scores.astype(np.int64)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["q_node", "query_id", "vec_id", "node", "score"])

    met = pairs.repartition(max(1, min(2000, pairs.count())), "ask", "block").join(asks, "ask").join(blocks, "block")
    scored = met.select("ids", "nodes", "xs", "tables", "q_ids", "q_nodes", "qs", "q_tables", "leasts").mapInArrow(score, "q_node long, query_id long, vec_id long, node long, score long")
    order = Window.partitionBy("q_node").orderBy(F.desc("score"), "vec_id", "node")
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
