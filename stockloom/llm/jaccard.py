"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of hashed five-word shingles; equal sets form one class. Classes that agree on a band of MinHash values are candidates.
Their signatures are compared a few values at a time; after each step a pair is dropped when the posterior probability (uniform prior)
that its similarity reaches the threshold is below ``TOLERANCE``. The groups that survivors connect are then verified whole and exactly:
within a group every pair goes through the same comparison and, if it survives, through the sets themselves. Large buckets and groups
are cut into blocks and compared block by block; tasks return each member's number of links and a spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import components, labels_of, map_rows, pairs_in, stored, whole_groups

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 5  # a pair at 0.8 shares no band with probability 1.5e-5, at 0.85 below 1e-7
VALUES, STEP, TOLERANCE = BANDS * ROWS, 20, 1e-6
BUCKET_BLOCK, GROUP_BLOCK = 4096, 1024  # members of one task's block; larger buckets and groups take several

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULTIPLY, _ADD = _SEEDS[:VALUES] | np.uint64(1), _SEEDS[VALUES:]
_ORDER = _mix(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points belong to words: letters and digits."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of all shingles of ``texts`` in lower case; a text of one to four words is one shingle, one without words has none."""
    joined = "\n".join(texts).lower()
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    # lower-casing may change a text's length, so text ends are looked up in the joined text when that happens
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    if lengths.sum() + max(0, len(texts) - 1) != len(cps):
        lengths = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    inside = _letters()[cps]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = stops - starts
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    power = np.ones(int(sizes.max()), np.uint64)
    power[1:] = np.uint64(0x100000001B3)
    power = np.multiply.accumulate(power)
    words = _mix(np.add.reduceat((cps[at].astype(np.uint64) + np.uint64(1)) * power[place], np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
    owner = np.searchsorted(ends, starts, side="right")
    count = np.bincount(owner, minlength=len(texts))
    n = len(words)
    total = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, n)):
        total[: n - k] += np.where(owner[k:] == owner[: n - k], words[k:] * _ORDER[k], np.uint64(0)) if k else words * _ORDER[0]
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    full = np.zeros(n, bool)
    full[: max(0, n - SHINGLE + 1)] = owner[SHINGLE - 1 :] == owner[: max(0, n - SHINGLE + 1)]
    keep = full | (first & (count[owner] < SHINGLE))
    return _mix(total[keep]), owner[keep]


def sets_of(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, owner = shingle_sets(texts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts))))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for each non-empty set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), VALUES), np.uint32)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat(((flat * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values: the fewest equal ones with which P(similarity >= threshold) is not below ``tolerance``."""
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        tail = 0.0  # P(S >= t | m of n equal) = P(Binomial(n + 1, t) <= m)
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def survivors(values: np.ndarray, i: np.ndarray, j: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """Which pairs (i, j) of rows outlast the incremental comparison."""
    alive, equal = np.arange(len(i)), np.zeros(len(i), np.int16)
    for n, least in need.items():
        equal = equal + (values[i[alive], n - STEP : n] == values[j[alive], n - STEP : n]).sum(1, dtype=np.int16)
        keep = equal >= least
        alive, equal = alive[keep], equal[keep]
        if not len(alive):
            break
    return alive


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, VALUES)


def _blocks(df: DataFrame, group: str, count: str, node: str, block: int) -> DataFrame:
    """Copies of a row for each pair of blocks that its block takes part in: adds ``g`` (the pair's key) and ``side``."""
    rows = df.withColumn("_n", F.ceil(F.col(count) / block).cast("int")).withColumn("_own", F.pmod(F.xxhash64(node, F.lit(7)), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pair = (F.least("_own", "_other"), F.greatest("_own", "_other"))
    return rows.withColumn("g", F.xxhash64(group, *pair)).withColumn("side", F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)).drop("_n", "_own", "_other")


def _screen(threshold: float):
    need = needed(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, "g"):
            values, side, nodes = _matrix(table.column("sig")), table.column("side").to_numpy(), table.column("fp").to_pylist()
            a, b = [], []
            for i, j in pairs_in(starts, len(nodes)):
                ok = (side[i] != side[j]) | (side[i] == 0)
                i, j = i[ok], j[ok]
                alive = survivors(values, i, j, need)
                label = labels_of(len(nodes), np.concatenate([*a, i[alive]]), np.concatenate([*b, j[alive]])) if len(alive) else None
                if label is not None:  # a forest is all that is kept of the survivors so far
                    own = np.flatnonzero(label != np.arange(len(label)))
                    a, b = [own], [label[own]]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x in a[0]], pa.binary()), pa.array([nodes[x] for x in b[0]], pa.binary())], names=["a", "b"])

    return run


def _verify(threshold: float):
    need, exact = needed(threshold), Fraction(str(threshold))

    def similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact test of the pairs; ``i`` ascending."""
        flat, starts = np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum([0, *map(len, sets)])
        sizes, mark, ok = np.diff(starts), np.zeros(int(flat.max()) + 1, bool), np.zeros(len(i), bool)
        for left in np.unique(i):
            own = flat[starts[left] : starts[left + 1]]
            mark[own] = True
            at = slice(*np.searchsorted(i, [left, left + 1]))
            right = j[at]
            if len(right) * 8 < len(sets):
                common = np.array([np.count_nonzero(mark[flat[starts[r] : starts[r + 1]]]) for r in right], np.int64)
            else:
                common = np.add.reduceat(mark[flat], starts[:-1], dtype=np.int64)[right]
            ok[at] = common * exact.denominator >= exact.numerator * (sizes[left] + sizes[right] - common)
            mark[own] = False
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, "g", 256):
            for start, end in zip(starts, [*starts[1:], table.num_rows], strict=True):
                part = table.slice(int(start), int(end - start))
                nodes, side, weight = part.column("fp").to_pylist(), part.column("side").to_numpy(), part.column("cnt").to_numpy()
                values, sets = _matrix(part.column("sig")), [np.frombuffer(x, dtype="<u8") for x in part.column("shingles").to_pylist()]
                links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
                for i, j in pairs_in(np.array([0]), len(nodes)):
                    ok = (side[i] != side[j]) | (side[i] == 0)
                    i, j = i[ok], j[ok]
                    alive = survivors(values, i, j, need)
                    if not len(alive):
                        continue
                    alive = alive[np.argsort(i[alive], kind="stable")]
                    i, j = i[alive], j[alive]
                    ok = similar(sets, i, j)
                    i, j = i[ok], j[ok]
                    links += np.bincount(i, weight[j], len(nodes)).astype(np.int64) + np.bincount(j, weight[i], len(nodes)).astype(np.int64)
                    own = np.flatnonzero(label != np.arange(len(label)))
                    label = labels_of(len(nodes), np.concatenate([own, i]), np.concatenate([label[own], j]))
                at = np.flatnonzero(links)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x in at], pa.binary()), pa.array(links[at]), pa.array([nodes[x] for x in label[at]], pa.binary())], names=["a", "links", "b"])

    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, ``text_hash``, ``class_id`` (smallest id that links reach), ``n_links`` (other rows at ``threshold`` or more), ``is_first``.

    ``is_first`` marks the class's representative: the smallest id, null last, then the smallest text hash; rows equal in both are all marked.

    Words are runs of letters and digits in lower case. Texts without words have no shingles; exact copies of one, stripped, are one class
    and link to each other only. Null and blank texts have no links and are a class each (their own id). Texts of one to four words are one shingle. Copies (equal shingle sets) are counted, not paired. Repeated rows and rows with
    equal ids count as rows; null ids rank last. Whole texts are read, however long. Other columns are not read; empty tables give empty
    results. Shuffled: a sketch per text, one key per band of each class, and the texts of candidate groups once per block pair.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))

    def describe(columns):
        import xxhash

        sets = sets_of(columns[2])
        full = [k for k, s in enumerate(sets) if len(s)]
        prints, sketches = [None] * len(sets), [None] * len(sets)
        if full:
            values = sketch([sets[k] for k in full])
            for k, row in zip(full, values, strict=True):
                prints[k], sketches[k] = xxhash.xxh3_128_digest(sets[k].tobytes()), row.tobytes()
        for k, s in enumerate(sets):
            if not len(s) and (bare := columns[2][k].strip()):  # no words: copies of the stripped text are one class, without a sketch
                prints[k] = xxhash.xxh3_128_digest(b"text:" + bare.encode("utf-8", "surrogatepass"))
        return [columns[0], columns[1], prints, sketches]

    described = stored(map_rows(rows.select("id", "th", "text"), f"id {kind}, th bigint, fp binary, sig binary", describe, 1_000_000), "sketches")
    classes = stored(described.filter("fp IS NOT NULL").groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep"), F.count("*").alias("cnt"), F.first("sig").alias("sig")), "classes")

    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substr("sig", b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    banded = classes.filter("sig IS NOT NULL").select("fp", F.explode(keys).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    bucket = _blocks(banded.join(shared, "key"), "key", "n", "fp", BUCKET_BLOCK).select("fp", "g", "side").join(classes.select("fp", "sig"), "fp")
    edges = bucket.select("g", "side", "fp", "sig").repartition("g").sortWithinPartitions("g").mapInArrow(_screen(threshold), "a binary, b binary")
    groups = stored(components(edges).withColumnRenamed("node", "fp"), "groups")

    size = groups.groupBy("component").agg(F.count("*").alias("n"))
    members = groups.join(size, "component").join(classes, "fp")
    with_text = members.join(rows.select("text", F.col("id").alias("rid"), F.col("th").alias("rth")), F.expr("rep.id <=> rid AND rep.th = rth")).select("fp", "component", "n", "cnt", "sig", "text").dropDuplicates(["fp"])

    def shingled(columns):
        return [*columns[:5], [s.tobytes() for s in sets_of(columns[5])]]

    ready = map_rows(with_text, "fp binary, component binary, n bigint, cnt bigint, sig binary, shingles binary", shingled, 1_000_000)
    dealt = _blocks(ready, "component", "n", "fp", GROUP_BLOCK).select("g", "side", "fp", "cnt", "sig", "shingles")
    verified = stored(dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_verify(threshold), "a binary, links bigint, b binary"), "links")

    joined = components(verified.filter("a <> b")).withColumnRenamed("node", "fp")
    links = verified.groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links"))
    known = classes.select("fp", "cnt", "rep").join(links, "fp", "left").join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = known.groupBy("component").agg(F.min("rep").alias("first"))
    result = known.join(first, "component").select("fp", "first", (F.col("cnt") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = described.select("id", "th", "fp").join(result, "fp", "left")
    alone, own = F.col("fp").isNull(), F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    return out.select(
        F.col("id").alias(id_col), F.col("th").alias("text_hash"), F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        (alone | own).alias("is_first"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of ``docs``, its representative, with all its columns, also where members share an id or have none.

    Of rows equal in id and text one stays.
    """
    found = jaccard_join(docs, id_col, text_col, threshold)
    stay = found.filter("is_first").select(F.col(id_col).alias("stay_id"), F.col("text_hash").alias("stay_hash")).distinct()
    whole = docs.select(F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = whole.withColumn("own_id", F.col(f"doc.`{id_col}`")).withColumn("own_hash", F.xxhash64(F.coalesce(F.col(f"doc.`{text_col}`"), F.lit(""))))
    joined = rows.join(stay, F.expr("own_id <=> stay_id AND own_hash = stay_hash"), "left_semi")
    once = Window.partitionBy("own_id", "own_hash").orderBy("own_hash")
    return joined.withColumn("n", F.row_number().over(once)).filter("n = 1").select("doc.*")
