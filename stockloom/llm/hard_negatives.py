"""Hard-negative mining over candidate blocks in the order of a Hilbert curve, chosen by zone maps.

Rows are sorted by label and by their place on a Hilbert curve over the leading principal dimensions, and written as Parquet blocks. Each
block has a zone map: the least and greatest value in every dimension, and its labels. Interval arithmetic on the zone maps of a block of
anchors and of a tree over the candidate blocks bounds all inner products between them, so a block is read only if its bounds allow a
score that some anchor's windows still need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import stored
from stockloom.llm.vectors import in_blocks, matrix, valid

BLOCK, ANCHORS, FAN = 2048, 256, 16
SAMPLE, DIMENSIONS, BITS = 2048, 4, 8  # the rows of smallest hash give axes and cell borders of the curve; they steer order, never results
LOW, HIGH = -(2**62), 2**62  # labels of a node without blocks


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer cells (rows; values below 2^bits) on the Hilbert curve through them."""
    x = cells.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in x:
            upper = (axis >> bit & 1).astype(bool)
            flip = np.where(upper, low, 0)  # turn the upper half round, exchange axes in the lower
            swap = np.where(upper, 0, (x[0] ^ axis) & low)
            x[0] ^= flip
            x[0] ^= swap
            axis ^= swap
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | (axis >> bit & 1)
    return place


def curve(sample: np.ndarray):
    """A function from rows to places on the curve, with axes and borders from the sample."""
    mean = sample.mean(0)
    axes = np.linalg.eigh((sample - mean).T @ (sample - mean))[1][:, ::-1][:, :DIMENSIONS]
    at = (sample - mean) @ axes
    low, high = at.min(0), at.max(0)
    step = np.where(high > low, (high - low) / 2**BITS, 1.0)

    def place(x: np.ndarray) -> np.ndarray:
        return hilbert(np.clip(np.floor(((x - mean) @ axes - low) / step), 0, 2**BITS - 1).astype(np.int64), BITS)

    return place


def product(q: Column, box: Column, upper: bool) -> Column:
    """Bound of the inner products between two boxes, arrays of (low, high) per dimension."""
    pick = F.greatest if upper else F.least
    terms = F.zip_with(q, box, lambda x, y: pick(x["low"] * y["low"], x["low"] * y["high"], x["high"] * y["low"], x["high"] * y["high"]))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def box_of(x: np.ndarray) -> list[dict]:
    return [{"low": float(a), "high": float(b)} for a, b in zip(x.min(0), x.max(0), strict=True)]


def _tree(blocks: DataFrame, total: int) -> list[DataFrame]:
    """Zone maps from the blocks (first) up to one root; a node covers ``FAN`` consecutive nodes of the level below."""
    level = blocks.select(F.col("block").alias("at"), "box", "label_low", "label_high")
    levels = [level]
    for _ in range(max(1, math.ceil(math.log(max(total, 2), FAN)))):
        up = F.floor(F.col("at") / FAN).cast("bigint")
        labels = level.groupBy(up.alias("at")).agg(F.min("label_low").alias("label_low"), F.max("label_high").alias("label_high"))
        sides = level.select(up.alias("at"), F.posexplode("box").alias("d", "side")).groupBy("at", "d").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"))
        box = sides.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", F.struct("low", "high").alias("side")))), lambda s: s["side"]).alias("box"))
        level = stored(labels.join(box, "at").select("at", "box", "label_low", "label_high"), "zone-maps")
        levels.append(level)
    return levels


def _reachable(asks: DataFrame, tree: list[DataFrame], keep) -> DataFrame:
    """(ask, block, bound): pairs that ``keep`` cannot exclude, by descending the tree; ``bound`` is the greatest possible score."""
    found = asks.withColumn("at", F.lit(0).cast("bigint"))
    for level in reversed(tree[:-1]):
        child = level.select(F.col("at").alias("child"), F.floor(F.col("at") / FAN).cast("bigint").alias("at"), F.col("box").alias("c_box"), F.col("label_low").alias("c_low"), F.col("label_high").alias("c_high"))
        met = found.join(child, "at").withColumn("bound", product(F.col("box"), F.col("c_box"), True))
        found = met.filter(keep()).select(*asks.columns, F.col("child").alias("at"), "bound")
    return found.select("ask", F.col("at").alias("block"), "bound")


def _arrays(row: dict, width: int, prefix: str) -> tuple[np.ndarray, ...]:
    return (*(np.frombuffer(row[prefix + c], "<i8") for c in ("ids", "nodes", "labels")), np.frombuffer(row[prefix + "xs"], "<f8").reshape(-1, width))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield {name: batch.column(c)[r].as_py() for c, name in enumerate(batch.schema.names)}


def first(scores: np.ndarray, ids: np.ndarray, nodes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the rows ``at`` the first ``k``: highest score, then smaller id, then the row stored first."""
    if len(at) > 4 * k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((nodes[at], ids[at], -scores[at]))[:k]]


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible inner product of each row with a box."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    return plus @ low + minus @ high, plus @ high + minus @ low


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for anchors (rows whose id is divisible by ``every``).

    Components become floor(scale * x), scores are integer inner products; higher ones come first, ties by smaller id, then by the row stored
    first. An anchor's positives are its first ``positives`` other rows of its label. For each of them the first ``negatives`` rows of other
    labels whose score lies between ``window`` hundredths of the positive's score are ranked from 1; fewer if there are no more, none if
    there are none (a negative positive score has an empty window). Rows take no part if id, label or vector is null, if the vector is empty
    or has a null or non-finite component. Labels are integers. Shorter vectors count as padded with zeros. Repeated rows are rows of their
    own, also as anchors. Scores are exact while squared norms stay below 2^46. Other columns are not read; empty tables give empty results.
    """
    spark = vectors.sparkSession
    e = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    takes_part = valid(F.col(vector_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
    rows = vectors.filter(takes_part).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), e.alias("e"))
    rows = stored(rows.withColumn("node", F.monotonically_increasing_id()), "vectors")
    width, count = rows.agg(F.max(F.size("e")), F.count("*")).first()
    empty = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    if not count:
        return empty
    place_of = curve(matrix(rows.orderBy(F.xxhash64("e", "node"), "node").limit(SAMPLE).select("e").toArrow().column("e"), width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(3), width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in x], pa.binary()), pa.array(place_of(x))], names=["id", "node", "label", "x", "place"])

    placed = rows.select("id", "node", "label", "e").mapInArrow(place, "id long, node long, label long, x binary, place long")
    order = ["label", "place", "node"]

    def pack(t: pa.Table) -> tuple:
        x = b"".join(t.column("x").to_pylist())
        labels = t.column("label").to_numpy().astype("<i8")
        return (t.column("id").to_numpy().astype("<i8").tobytes(), t.column("node").to_numpy().astype("<i8").tobytes(), labels.tobytes(), x,
                box_of(np.frombuffer(x, "<f8").reshape(-1, width)), int(labels.min()), int(labels.max()))

    payload = "ids binary, nodes binary, labels binary, xs binary, box array<struct<low:double,high:double>>, label_low bigint, label_high bigint"
    ordered = placed.repartitionByRange(max(1, math.ceil(count / (4 * BLOCK))), *order).sortWithinPartitions(*order)
    blocks = in_blocks(ordered, pack, payload, BLOCK, "candidate-blocks")

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors of a block, each with the score of its last positive inside the block (minus infinity if there are fewer)."""
        for row in _rows(batches):
            ids, nodes, labels, x = _arrays(row, width, "")
            own = np.flatnonzero(ids % every == 0)
            least = []
            for a in own:
                scores = x @ x[a]
                at = first(scores, ids, nodes, np.flatnonzero((labels == labels[a]) & (nodes != nodes[a])), positives)
                least.append(float(scores[at[-1]]) if len(at) == positives else -math.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(nodes[own]), pa.array(labels[own]), pa.array([x[a].tobytes() for a in own], pa.binary()), pa.array(place_of(x[own])), pa.array(least, pa.float64())],
                                             names=["id", "node", "label", "x", "place", "least"])

    anchors = stored(blocks.select("ids", "nodes", "labels", "xs").mapInArrow(seed, "id long, node long, label long, x binary, place long, least double"), "anchors")
    asked = anchors.count()
    if not asked:
        return empty
    tree = _tree(blocks, blocks.count())

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartitionByRange(max(1, math.ceil(asked / (4 * ANCHORS))), *order).sortWithinPartitions(*order)

    def ask_blocks(df: DataFrame, more, more_schema: str, label: str) -> DataFrame:
        """Anchors packed as candidates are, with what ``more`` packs beside them."""
        packed = in_blocks(in_order(df), lambda t: (*pack(t), *more(t)), f"{payload}, {more_schema}", ANCHORS, label).withColumnRenamed("block", "ask")
        return packed.select(*(F.col(c).alias("q_" + c) if c in ("ids", "nodes", "labels", "xs") else F.col(c) for c in packed.columns))

    def meet(pairs: DataFrame, asks: DataFrame, extra: list[str], score, schema: str) -> DataFrame:
        asks = asks.select("ask", "q_ids", "q_nodes", "q_labels", "q_xs", *extra)
        met = pairs.select("ask", "block").repartition(max(1, min(2000, pairs.count())), "ask", "block").join(asks, "ask").join(blocks.drop("label_low", "label_high"), "block")
        return met.drop("ask", "block").mapInArrow(score, schema)

    # positives: blocks of the anchors' labels whose bound reaches the last score inside the anchors' own block
    asks = ask_blocks(anchors, lambda t: (t.column("least").to_numpy().astype("<f8").tobytes(), float(t.column("least").to_numpy().min())), "leasts binary, need double", "anchor-blocks")
    zone = asks.select("ask", "box", "label_low", "label_high", "need")
    pairs = stored(_reachable(zone, tree, lambda: (F.col("c_low") <= F.col("label_high")) & (F.col("c_high") >= F.col("label_low")) & (F.col("bound") >= F.col("need"))), "positive-pairs")

    def score_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            (ids, nodes, labels, x), (q_ids, q_nodes, q_labels, q) = _arrays(row, width, ""), _arrays(row, width, "q_")
            least = np.frombuffer(row["leasts"], "<f8")
            upper = _bounds(q, *(np.array([side[c] for side in row["box"]]) for c in ("low", "high")))[1]
            out: list[list] = [[], [], [], []]
            for a in np.flatnonzero(upper >= least):
                scores = x @ q[a]
                at = first(scores, ids, nodes, np.flatnonzero((labels == q_labels[a]) & (nodes != q_nodes[a]) & (scores >= least[a])), positives)
                for column, values in zip(out, (np.full(len(at), q_nodes[a]), ids[at], nodes[at], scores[at].astype(np.int64)), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in out], names=["a_node", "positive_id", "p_node", "score"])

    ranked = Window.partitionBy("a_node").orderBy(F.desc("score"), "positive_id", "p_node")
    found = meet(pairs, asks, ["leasts"], score_positives, "a_node long, positive_id long, p_node long, score long")
    found = found.withColumn("k", F.row_number().over(ranked)).filter(F.col("k") <= positives)
    lists = found.groupBy(F.col("a_node").alias("node")).agg(F.array_sort(F.collect_list(F.struct("k", "positive_id", "score"))).alias("positives"))  # at most ``positives`` each
    low, high = window
    wanted = stored(anchors.drop("least").join(lists.filter(F.exists("positives", lambda p: p["score"] >= 0)), "node"), "positives")

    # negatives: the windows of an anchor reach from the lowest to the highest score that any of them admits
    def pack_windows(t: pa.Table) -> tuple:
        given = t.column("positives").to_pylist()
        scores = np.array([p["score"] for ps in given for p in ps], np.float64)
        sizes = np.array([len(ps) for ps in given], "<i8")
        return np.array([p["positive_id"] for ps in given for p in ps], "<i8").tobytes(), scores.tobytes(), sizes.tobytes(), float(low * scores[scores >= 0].min() / 100) - 1, float(high * scores.max() / 100) + 1

    asks = ask_blocks(wanted, pack_windows, "p_ids binary, p_scores binary, p_sizes binary, need double, most double", "window-blocks")
    zone = asks.select("ask", "box", "label_low", "label_high", "need", "most")

    def other_labels() -> Column:
        return ~((F.col("c_low") == F.col("c_high")) & (F.col("label_low") == F.col("label_high")) & (F.col("c_low") == F.col("label_low")))

    def in_window() -> Column:
        return other_labels() & (F.col("bound") >= F.col("need")) & (product(F.col("box"), F.col("c_box"), False) <= F.col("most"))

    def score_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            (ids, nodes, labels, x), (_, q_nodes, q_labels, q) = _arrays(row, width, ""), _arrays(row, width, "q_")
            p_ids, p_scores, sizes = np.frombuffer(row["p_ids"], "<i8"), np.frombuffer(row["p_scores"], "<f8"), np.frombuffer(row["p_sizes"], "<i8")
            needs = np.frombuffer(row["needs"], "<f8") if row.get("needs") else np.full(len(p_ids), -math.inf)
            start = np.cumsum(sizes) - sizes
            least, most = _bounds(q, *(np.array([side[c] for side in row["box"]]) for c in ("low", "high")))
            out: list[list] = [[], [], [], [], []]
            for a in range(len(q)):
                own = range(start[a], start[a] + sizes[a])
                own = [p for p in own if 100 * most[a] >= low * p_scores[p] and 100 * least[a] <= high * p_scores[p] and most[a] >= needs[p]]
                if not own:
                    continue
                scores = x @ q[a]
                other = np.flatnonzero(labels != q_labels[a])
                hundred = 100 * scores[other]
                for p in own:
                    at = first(scores, ids, nodes, other[(hundred >= low * p_scores[p]) & (hundred <= high * p_scores[p]) & (scores[other] >= needs[p])], negatives)
                    for column, values in zip(out, (np.full(len(at), q_nodes[a]), np.full(len(at), p - start[a] + 1), ids[at], nodes[at], scores[at].astype(np.int64)), strict=True):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in out], names=["a_node", "k", "negative_id", "n_node", "negative_score"])

    hit = "a_node long, k long, negative_id long, n_node long, negative_score long"
    windows = ["p_ids", "p_scores", "p_sizes"]
    reach = stored(_reachable(zone, tree, in_window), "window-pairs")
    best = reach.groupBy("ask").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))  # the most promising block of each ask goes first
    seeds = stored(meet(best, asks, windows, score_negatives, hit), "first-negatives")
    ranked = Window.partitionBy("a_node", "k").orderBy(F.desc("negative_score"), "negative_id", "n_node")
    last = seeds.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == negatives).select("a_node", "k", F.col("negative_score").alias("need"))
    last = last.groupBy(F.col("a_node").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("k", "need"))).alias("needs"))

    def pack_needs(t: pa.Table) -> tuple:
        ps, known = t.column("positives").to_pylist(), [dict(m or []) for m in t.column("needs").to_pylist()]
        needs = np.array([float(m.get(p["k"], -math.inf)) for own, m in zip(ps, known, strict=True) for p in own])
        p_ids, p_scores, p_sizes, need, most = pack_windows(t)
        scores = np.frombuffer(p_scores, "<f8")
        return p_ids, p_scores, p_sizes, needs.tobytes(), max(need, float(np.maximum(needs, low * scores / 100 - 1)[scores >= 0].min())), most

    narrowed = wanted.join(last, "node", "left")
    asks = ask_blocks(narrowed, pack_needs, "p_ids binary, p_scores binary, p_sizes binary, needs binary, need double, most double", "narrow-blocks")
    reach = _reachable(asks.select("ask", "box", "label_low", "label_high", "need", "most"), tree, in_window)
    rest = stored(reach.join(best, ["ask", "block"], "left_anti"), "narrow-pairs")
    every_hit = seeds.union(meet(rest, asks, [*windows, "needs"], score_negatives, hit))
    ranks = every_hit.withColumn("rank", F.row_number().over(ranked).cast("int")).filter(F.col("rank") <= negatives)
    named = wanted.select(F.col("node").alias("a_node"), F.col("id").alias("anchor_id"), F.explode("positives").alias("p"))
    named = named.select("a_node", "anchor_id", F.col("p.k").cast("bigint").alias("k"), F.col("p.positive_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return ranks.join(named, ["a_node", "k"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


NEGATIVES_SQL = """
WITH e AS (
 SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
 SELECT a.r, a.vec_id AS anchor_id, a.label, a.v, b.vec_id AS positive_id, list_dot_product(a.v, b.v)::BIGINT AS positive_score,
  row_number() OVER (PARTITION BY a.r ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id, b.r) AS k
 FROM e a JOIN e b ON a.label = b.label AND a.r <> b.r WHERE a.vec_id % 100 = 0),
n AS (
 SELECT a.r, b.vec_id AS negative_id, b.r AS s, list_dot_product(a.v, b.v)::BIGINT AS negative_score FROM e a JOIN e b ON a.label <> b.label WHERE a.vec_id % 100 = 0),
w AS (
 SELECT anchor_id, positive_id, negative_id, positive_score, negative_score, row_number() OVER (PARTITION BY p.r, k ORDER BY negative_score DESC, negative_id, s) AS rank
 FROM p JOIN n USING (r) WHERE k <= 5 AND 30 * positive_score <= 100 * negative_score AND 100 * negative_score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10
"""
