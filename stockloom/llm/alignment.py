"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes; the byte offsets where tokens of both end cut a text into groups. Most tokens pair one to one, so the two
arrays of ends agree along a diagonal: ``common_runs`` compares stretches of doubling length at the current index shift and jumps over what
is equal. Where the ends differ, the lower one is advanced until they meet, which closes an irregular group and gives the new shift.

What both tokenizers link is then counted over the corpus, and every document is scored by these counts.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import map_rows, stored

# Fixed value: how byte-level tokenizers of this kind cut a text into words.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PART_PAIRS = 4_000_000  # pairs of token ids with their counts in one broadcast (17 bytes each); more pairs are met in further passes
HELD_PAIRS = 1_000_000  # distinct pairs that a counting task holds before it hands them on


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class ByteLevel:
    """Byte-level tokenizer file: ids of a text whose special strings are plain text, and the bytes of each entry."""

    def __init__(self, spec: str):
        self.spec, self.library = spec, None
        model, letters = json.loads(spec)["model"], byte_letters()
        added = {t["id"] for t in json.loads(spec)["added_tokens"]}
        size = max(max(model["vocab"].values()), *added, 0) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, number in model["vocab"].items():
            self.bytes[number] = token.encode() if number in added else bytes(letters[c] for c in token)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks = {self.bytes[n]: n for n in range(size) if n not in added and self.bytes[n]}
        in_order = all(model["vocab"].get(a + b) == 256 + n for n, (a, b) in enumerate(merges)) and len(ranks) == 256 + len(merges)
        self.fast = None
        if in_order:  # ids in the order of merges: the same ids follow from ranks, which the other library merges faster
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except ValueError:  # white-space runs beyond its pattern stack
                pass
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
            self.library.encode_special_tokens = True
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """Piece tokenizer model: ids of texts, and the bytes of each piece."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [self._bytes(self.library.id_to_piece(n), self.library.is_byte(n)) for n in range(self.library.get_piece_size())]

    @staticmethod
    def _bytes(piece: str, is_byte: bool) -> bytes:
        return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.library.encode(texts, num_threads=1)]


def common_runs(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Where two rising lists with the same last value agree, in order, as runs (i, j, n): a[i + k] == b[j + k] for k < n."""
    at_a, at_b, sizes = [], [], []
    i = j = 0
    last = len(a)
    while i < last:
        if a[i] == b[j]:
            start, step, growing = i, 2, True
            i, j = i + 1, j + 1
            while step:
                stretch = a[i : i + step]
                if stretch and stretch == b[j : j + step]:
                    i, j = i + len(stretch), j + len(stretch)
                    step = step * 2 if growing else step // 2
                else:
                    growing, step = False, step // 2
            at_a.append(start)
            at_b.append(j - i + start)
            sizes.append(i - start)
            if i == last:
                break
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
    return at_a, at_b, sizes


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into both arrays of ends at which the tokens of a group end together."""
    at_a, at_b, sizes = (np.array(v, np.int64) for v in common_runs(a.tolist(), b.tolist()))
    steps = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(at_a, sizes) + steps, np.repeat(at_b, sizes) + steps


class Aligner:
    def __init__(self, byte_spec: str, piece_model: bytes):
        self.a, self.b = ByteLevel(byte_spec), Pieces(piece_model)
        self.len_a, self.len_b = (np.array(list(map(len, t.bytes)), np.int64) for t in (self.a, self.b))
        n, m = len(self.a.bytes), len(self.b.bytes)
        self.words = [f"{k}," for k in range(n)] + [f"{k}|" for k in range(n)] + [f"{k}," for k in range(m)] + [f"{k};" for k in range(m)]

    def tokens(self, text: str, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both, empty where the joined bytes of one are not those of a space and the text."""
        data = (" " + text).encode("utf-8")
        ids_a = self.a.encode(" " + text)
        for ids, of in ((ids_a, self.a.bytes), (ids_b, self.b.bytes)):
            if b"".join(map(of.__getitem__, ids.tolist())) != data:
                return ids_a[:0], ids_b[:0]
        return ids_a, ids_b

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, in order."""
        n, m = len(self.a.bytes), len(self.b.bytes)
        code_a, code_b = ids_a.copy(), ids_b + 2 * n
        code_a[end_a] += n
        code_b[end_b] += m
        before_b = np.concatenate([[0], end_b[:-1] + 1])
        codes = np.empty(len(code_a) + len(code_b), np.int64)
        codes[np.arange(len(code_a)) + np.repeat(before_b, np.diff(end_a, prepend=-1))] = code_a
        codes[np.arange(len(code_b)) + np.repeat(end_a + 1, np.diff(end_b, prepend=-1))] = code_b
        return "".join(map(self.words.__getitem__, codes.tolist()))[:-1]

    def rows(self, texts: list[str | None], keep_groups: bool) -> list[list]:
        """Columns n_a, n_b, n_groups, groups_sha256, links (pairs, rising), times (of each pair), groups."""
        own = [k for k, t in enumerate(texts) if t]
        width = len(self.b.bytes)
        kind = np.uint32 if len(self.a.bytes) * width <= 2**32 else np.uint64
        out = [[0] * len(texts), [0] * len(texts), [0] * len(texts), [""] * len(texts), [b""] * len(texts), [b""] * len(texts), [""] * len(texts)]
        for k, encoded in zip(own, self.b.encode([texts[k] for k in own]), strict=True):
            ids_a, ids_b = self.tokens(texts[k], encoded)
            if not len(ids_a):
                continue
            end_a, end_b = common_ends(np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b]))
            groups = self.groups(ids_a, ids_b, end_a, end_b)
            pairs, times = np.unique(ids_a[end_a] * width + ids_b[end_b], return_counts=True)
            row = (len(ids_a), len(ids_b), len(end_a), hashlib.sha256(groups.encode()).hexdigest(), pairs.astype(kind).tobytes(), times.astype(np.uint32).tobytes(), groups if keep_groups else "")
            for column, value in zip(out, row, strict=True):
                column[k] = value
        return out


_BUILT: dict = {}


def _aligner(given) -> Aligner:
    """The two tokenizers of a broadcast, loaded once in each worker process."""
    mark, byte_spec, piece_model = given.value
    if mark not in _BUILT:
        _BUILT.clear()
        _BUILT[mark] = Aligner(byte_spec, piece_model)
    return _BUILT[mark]


def _counted(links: DataFrame, kind: np.dtype) -> DataFrame:
    """(pair, n): how many links of the corpus join each pair of ids. Tasks add up what they meet before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(times.astype(np.int64))], names=["pair", "n"])

        held, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).astype(np.int64)
            times = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).astype(np.int64)
            held, at = np.unique(np.concatenate([held, pairs]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, times]), len(held)).astype(np.int64)
            if len(held) > HELD_PAIRS:
                yield out(held, sums)
                held, sums = held[:0], sums[:0]
        if len(held):
            yield out(held, sums)

    return links.select("links", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, byte_spec: str, piece_model: bytes, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """Per document: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` (and ``groups`` on request).

    A is the byte-level tokenizer of ``byte_spec`` on a space and the text, B the piece tokenizer of ``piece_model`` on the text. Groups end
    where tokens of both end; a link joins the two tokens that end there. A pair of ids counts its links over all documents; a link is best
    if no other pair of its B id counts more (ties are best too). ``count_sum`` adds the counts of a document's links.

    Null and empty texts, and texts whose tokens do not give back the text, have zeros and an empty digest. Repeated rows count each. Texts
    are aligned whole. Other columns are not read; an empty table gives an empty result.

    Documents are encoded once and stored with their pairs. Counts of pairs are pre-aggregated in tasks and shuffled, a pair a row; at most
    as many as both vocabularies allow. They go back to the documents by broadcasts of ``PART_PAIRS`` pairs, a pass over the pairs for each.
    """
    spark = docs.sparkSession
    mark = hashlib.sha256(byte_spec.encode() + piece_model).hexdigest()
    given = spark.sparkContext.broadcast((mark, byte_spec, piece_model))
    kind_id = docs.schema[id_col].dataType.simpleString()

    def encode(columns: list[list]) -> list[list]:
        ids, texts = columns
        return [ids, *_aligner(given).rows(texts, keep_groups)]

    schema = f"id {kind_id}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary, times binary, groups string"
    rows = map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), schema, encode, budget=1_000_000)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")

    sizes = Aligner(byte_spec, piece_model)
    width = len(sizes.b.bytes)
    kind = np.dtype(np.uint32 if len(sizes.a.bytes) * width <= 2**32 else np.uint64)
    counts = _counted(rows, kind)
    best = F.max("n").over(Window.partitionBy(F.col("pair") % width)) == F.col("n")  # at most one row for each A id
    pairs = stored(counts.withColumn("best", best), "pair-counts")
    parts = max(1, math.ceil(pairs.count() / PART_PAIRS))

    def score(table):
        def run(columns: list[list]) -> list[list]:
            pair, n, is_best = table.value
            found: list[list] = [[], []]
            for links, times in zip(*columns[1:3], strict=True):
                own, each = np.frombuffer(links, kind), np.frombuffer(times, np.uint32).astype(np.int64)
                at = np.searchsorted(pair, own)
                if parts > 1:
                    at[at == len(pair)] = 0
                    known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
                    at, each = at[known], each[known]
                found[0].append(int(each[is_best[at]].sum()))
                found[1].append(int((each * n[at]).sum()))
            return [columns[0], *found, *columns[3:]]

        return run

    shown = ["n_a", "n_b", "n_groups", "groups_sha256", "groups"]
    types = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, groups string"
    scored = None
    for part in range(parts):
        mine = pairs if parts == 1 else pairs.filter(F.pmod(F.xxhash64("pair"), F.lit(parts)) == part)
        arrow = mine.select("pair", "n", "best").toArrow()
        pair, n, is_best = (arrow.column(c).to_numpy() for c in range(3))
        order = np.argsort(pair)
        table = spark.sparkContext.broadcast((pair[order].astype(kind), n[order], is_best[order].astype(bool)))
        if parts == 1:
            scored = map_rows(rows.select("id", "links", "times", *shown), f"id {kind_id}, n_best bigint, count_sum bigint, {types}", score(table))
        else:
            some = map_rows(rows.select("row", "links", "times"), "row bigint, n_best bigint, count_sum bigint", score(table))
            scored = some if scored is None else scored.union(some)
    if parts > 1:
        sums = scored.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        scored = rows.drop("links", "times").join(sums, "row")
    columns = [F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"]
    return scored.select(*columns, *(["groups"] if keep_groups else []))
