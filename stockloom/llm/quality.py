"""Quality by attention-based multiple-instance learning.

A text is a bag of passages. Every passage is encoded as rates of character classes, of pairs of classes and of repeated words; a small
layer maps the encoding to h. Gated attention a = softmax(w . (tanh(V h) * sigmoid(U h))) over a text's passages is learned from text
labels alone, and the text's score is the logistic of the attention-weighted mean of its passages. So a text with one bad part can be told
from its label without marks on passages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stockloom.llm.common import map_rows

PASSAGE = 512  # characters
HIDDEN, GATES = 24, 12
TRAIN_ROWS, TRAIN_CHARS = 4000, 200_000  # at most so many labelled texts, none longer than this, are read for fitting; all texts are scored whole

_CLASSES = 13
_PAIRS = _CLASSES * _CLASSES
WIDTH = _CLASSES + _PAIRS + 6
_TABLE: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """A class for every code point: letters by case, digits, kinds of marks and white space."""
    if not _TABLE:
        table = np.full(0x110000, 12, np.uint8)
        for i in range(0x30000):
            c = chr(i)
            if c.isupper():
                table[i] = 0
            elif c.islower():
                table[i] = 1
            elif c.isalpha():
                table[i] = 2
            elif c.isdigit():
                table[i] = 3
            elif c == "\n":
                table[i] = 4
            elif c.isspace():
                table[i] = 5
        for k, marks in enumerate((".,;:", "!", "?'\"()-", "|", "#$%&*@^~+=", "<>{}[]\\/_`")):
            for c in marks:
                table[ord(c)] = 6 + k
        _TABLE.append(table)
    return _TABLE[0]


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(encodings, first passage of each text); an empty text has one passage without characters."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    count = np.maximum(1, -(-lengths // PASSAGE))
    first = np.cumsum(count) - count
    n = int(count.sum())
    out = np.zeros((n, WIDTH), np.float32)
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(cps):
        return out, first
    owner = np.repeat(np.arange(len(texts)), lengths)
    begin = np.cumsum(lengths) - lengths
    part = np.repeat(first, lengths) + (np.arange(len(cps)) - np.repeat(begin, lengths)) // PASSAGE
    kind = _classes()[cps].astype(np.int64)
    size = np.bincount(part, minlength=n).astype(np.float32)
    full = np.maximum(1, size)
    out[:, :_CLASSES] = np.bincount(part * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, -1) / full[:, None]
    pair = part[1:] * _PAIRS + kind[:-1] * _CLASSES + kind[1:]
    pair = pair[owner[1:] == owner[:-1]]
    out[:, _CLASSES : _CLASSES + _PAIRS] = np.sqrt(np.bincount(pair, minlength=n * _PAIRS).reshape(n, -1) / full[:, None])
    # words: runs without white space; equal neighbours and distinct words in a passage
    solid = (kind != 4) & (kind != 5)
    edge = solid.copy()
    edge[1:] &= ~solid[:-1] | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(edge)
    if len(starts):
        key = cps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
        word = np.cumsum(edge)[solid] - 1
        inside = np.flatnonzero(solid)
        turn = (inside - starts[word]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        hashed = np.add.reduceat(key[inside] * turn * np.uint64(0xBF58476D1CE4E5B9), np.searchsorted(inside, starts))
        at, who = part[starts], owner[starts]
        words = np.maximum(1, np.bincount(at, minlength=n))
        same = (hashed[1:] == hashed[:-1]) & (who[1:] == who[:-1])
        order = np.lexsort((hashed, at))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashed[order][1:] != hashed[order][:-1]) | (at[order][1:] != at[order][:-1])
        out[:, -6] = np.bincount(at[1:][same], minlength=n) / words
        out[:, -5] = np.bincount(at[order][fresh], minlength=n) / words
        out[:, -4] = np.log1p(size / words)
    out[:, -3] = np.log1p(size) / 6
    out[:, -2] = size == 0
    out[:, -1] = np.log1p(np.repeat(count, count)) / 6
    return out, first


class Model:
    """Weights of encoder, attention and output, and the scale of the encodings."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        shape = {"E": (WIDTH, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "w": (GATES,), "c": (HIDDEN,), "b": (1,)}
        self.p = {k: r.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" else np.zeros(s) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).astype(np.float32)

    def forward(self, x: np.ndarray, first: np.ndarray):
        """``x``: scaled encodings."""
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        each = np.diff(np.append(first, len(x)))
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, first), each))
        a /= np.repeat(np.add.reduceat(a, first), each)
        z = np.add.reduceat(a[:, None] * h, first)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))
        return h, t, g, a, z, y, each

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 250, rate: float = 0.01, ridge: float = 1e-4) -> None:
        """Full-batch Adam on the log loss; the same for the same rows in the same order."""
        self.mean, self.scale = x.mean(0, dtype=np.float64).astype(np.float32), (x.std(0, dtype=np.float64) + 0.02).astype(np.float32)
        x = self.scaled(x)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for step in range(1, rounds + 1):
            p = self.p
            h, t, g, a, z, y, each = self.forward(x, first)
            dy = (y - label) / len(label)
            dz = dy[:, None] * p["c"]
            dzr = np.repeat(dz, each, axis=0)
            da = (dzr * h).sum(1)
            ds = a * (da - np.repeat(np.add.reduceat(a * da, first), each))
            dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
            dh = (a[:, None] * dzr + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grad = {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ dy, "b": np.array([dy.sum()])}
            for k, d in grad.items():
                d = d + ridge * p[k] * (k not in "eb")
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, texts: list[str]) -> np.ndarray:
        x, first = passages(texts)
        return self.forward(self.scaled(x), first)[5]


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """A model from the labelled texts that are not held out: the ``rows`` of them with the smallest hashes of their ids.

    An id labelled more than once has its rounded mean label (0.5 counts as 1); null ids and labels are left out. Without any label the model
    scores 0.5 throughout. Only these texts come to the driver, each as its passages' encodings.
    """
    model = Model()
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id"))
    chosen = known.agg((F.avg(label_col) >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(rows).collect()
    label = {r["id"]: r["y"] for r in chosen}
    if not label:
        model.p["c"] = np.zeros(HIDDEN)
        return model
    texts = docs.filter(F.col(id_col).isin(list(label)) & (F.length(F.coalesce(text_col, F.lit(""))) <= chars)).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def encoded(columns):
        x, first = passages(columns[1])
        return [columns[0], [part.tobytes() for part in np.split(x, first[1:])]]

    kind = docs.schema[id_col].dataType.simpleString()
    found = sorted(map_rows(texts, f"id {kind}, x binary", encoded, 500_000).dropDuplicates(["id", "x"]).collect(), key=lambda r: (r["id"], r["x"]))
    if not found:
        model.p["c"] = np.zeros(HIDDEN)
        return model
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in found]
    first = np.cumsum([0, *map(len, bags)])[:-1]
    model.fit(np.concatenate(bags), first, np.array([label[r["id"]] for r in found], float))
    return model


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1 if score >= ``threshold``, else 0).

    Only the text is read by the score. A null text counts as empty; empty texts have one passage without characters and get the score the
    model gives it. Very long texts are scored whole, every passage. Repeated rows get equal scores. Columns named score or predicted are
    replaced. Empty tables give empty results. One pass without a shuffle; the model (some thousand numbers) is sent to the tasks.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: pd.Series) -> pd.Series:
        values, out, start, weight = texts.fillna("").tolist(), [], 0, 0
        for i, t in enumerate(values):
            weight += len(t)
            if weight >= 500_000 or i == len(values) - 1:
                out.append(given.value.score(values[start : i + 1]))
                start, weight = i + 1, 0
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    scored = docs.withColumn("score", pandas_udf(scores, "double")(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
