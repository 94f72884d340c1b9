"""Encoding and decoding with a word-end byte-pair tokenizer; long unsplit text by tree concatenation.

A run of characters without ASCII white space (a chunk) encodes alike alone and in its text, for the tokenizer drops white space and no
pattern crosses it. Short chunks repeat and are looked up. A chunk longer than ``LEAF`` characters is halved until its parts are short; the
parts are encoded as rows of their own, by many tasks, and joined pairwise: around each join a growing window is encoded again until it
shares a token, at the same place, with the left part before the join and with the right part behind it. What lies outside is then final:
an encoding is valid if each pair of neighbouring tokens is, and every pair has been seen together in one of the three encodings.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import map_rows

LEAF = 4096  # characters in a part of a long chunk; parts are joined exactly, so it only balances work
_CHUNK = re.compile("[^ \t-\r]+")
_KEEP, _LONGEST = 200_000, 64  # known chunks kept per generation, and their longest length
# ASCII and Latin-1 letters, perhaps with one mark behind: lower case and NFC change nothing else, and letters and mark are apart anyway
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


class Codec:
    """The tokenizer in three forms: as given, and as a bare model for text that is normalised and free of added tokens."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(spec)
        self.full.no_truncation()
        self.full.no_padding()
        bare = json.loads(spec)
        self.names = {number: word for word, number in bare["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in bare["added_tokens"]}
        self.names |= {number: word for word, number in self.added.items()}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.bare = Tokenizer.from_str(json.dumps(bare | {"normalizer": None, "added_tokens": []}))
        steps = (bare["normalizer"] or {}).get("normalizers", [])
        self.lowers = [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and bare["pre_tokenizer"]["pretokenizers"][-1]["type"] == "ByteLevel"
        self.known, self.old, self.words, self.old_words = {}, {}, {}, {}
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = [b for b in range(256) if b not in printable]
        self.byte_letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}  # how byte-level models write bytes

    # -- short chunks
    def result(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, dtype="<u4").tobytes(), " ".join(map(self.names.__getitem__, ids))

    def word(self, word: str) -> tuple[bytes, str]:
        """Lower-case letters of the plain kind: merged by the model alone."""
        found = self.words.get(word) or self.old_words.get(word)
        if found is None:
            letters = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.byte_letters)
            found = self.result([t.id for t in self.full.model.tokenize(letters)])
        if len(self.words) >= _KEEP:
            self.old_words, self.words = self.words, {}
        self.words[word] = found
        return found

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """A chunk that is not among the known ones of this generation."""
        found = self.old.get(chunk)
        if found is None:
            plain = _PLAIN.fullmatch(chunk) if self.lowers and len(chunk) <= _LONGEST else None
            if plain is None:
                found = self.result(self.full.encode(chunk, add_special_tokens=False).ids)
            elif not plain[2]:
                found = self.word(plain[1].lower())
            else:
                (ids, text), (mark, sign) = self.word(plain[1].lower()), self.known.get(plain[2]) or self.chunk(plain[2])
                found = ids + mark, f"{text} {sign}"
        if len(chunk) <= _LONGEST:
            if len(self.known) >= _KEEP:
                self.old, self.known = self.known, {}
            self.known[chunk] = found
        return found

    def text(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        known, chunk = self.known, self.chunk
        found = [known.get(c) or chunk(c) for c in _CHUNK.findall(text)]
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])

    # -- long chunks
    def segments(self, chunk: str) -> list[tuple[bool, str]]:
        """(is an added token, text) in order; ordinary text comes normalised."""
        out, last = [], 0
        for m in self.special.finditer(chunk) if self.special else ():
            out += [(False, chunk[last : m.start()]), (True, m[0])]
            last = m.end()
        out.append((False, chunk[last:]))
        return [(s, t if s else self.normal(t)) for s, t in out if t]

    def normal(self, text: str) -> str:
        return self.full.normalizer.normalize_str(text) if self.full.normalizer else text

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids and the place in ``text`` (in characters) where each token ends. Bytes of one character share its end."""
        e = self.bare.encode(text, add_special_tokens=False)
        return np.array(e.ids, dtype=np.int64), np.array([b for _, b in e.offsets], dtype=np.int64)

    def join(self, text: str, cut: int, left: tuple, right: tuple, window: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """The encoding of ``text`` from those of text[:cut] and text[cut:]; ``right`` counts its ends from 0."""
        (l_ids, l_ends), (r_ids, r_ends) = left, (right[0], right[1] + cut)
        while True:
            start, stop = max(0, cut - window), min(len(text), cut + window)
            if start:  # the window begins where a token of the left part begins and a character is complete
                k = int(np.searchsorted(l_ends, start, side="right"))
                start = int(l_ends[k - 1]) if k else 0
            if stop < len(text):
                k = int(np.searchsorted(r_ends, stop, side="left"))
                stop = int(r_ends[k]) if k < len(r_ends) else len(text)
            ids, ends = self.encode(text[start:stop])
            ends = ends + start
            i = self._agree(l_ids, l_ends, ids, ends, start, 0, cut) if start else (0, 0)
            j = self._agree(r_ids, r_ends, ids, ends, start, cut, stop) if stop < len(text) else (len(r_ids), len(ids))
            if i and j and i[1] <= j[1]:
                return (np.concatenate([l_ids[: i[0]], ids[i[1] : j[1]], r_ids[j[0] :]]), np.concatenate([l_ends[: i[0]], ends[i[1] : j[1]], r_ends[j[0] :]]))
            if start == 0 and stop == len(text):
                return ids, ends
            window *= 2

    @staticmethod
    def _agree(own_ids, own_ends, ids, ends, start, low, high):
        """A token that a part and the window both have at one place: (its index in the part, in the window); None without one.

        Left of the join (``low`` 0) tokens must end before it, right of it they must begin behind it. Tokens that are bytes of one
        character share their place and are passed over. The first token of a window is passed over on the left and the last on the
        right, because the window's own edges may have shaped them.
        """
        def table(i, e):
            begin = np.concatenate([[0], e[:-1]])
            single = np.ones(len(e), bool)
            single[1:] &= e[1:] != e[:-1]
            single[:-1] &= e[1:] != e[:-1]
            return begin, single

        w_begin, w_single = table(ids, ends)
        if len(ends):
            w_begin[0] = start
        o_begin, o_single = table(own_ids, own_ends)
        if low and len(own_ends):
            o_begin[0] = low
        inside = range(1, len(ids)) if low == 0 else range(len(ids) - 2, -1, -1)
        for k in inside:
            if not w_single[k] or (ends[k] >= high if low == 0 else w_begin[k] <= low):
                continue
            p = int(np.searchsorted(own_ends, ends[k], side="left"))
            if p < len(own_ends) and own_ends[p] == ends[k] and o_single[p] and o_begin[p] == w_begin[k] and own_ids[p] == ids[k]:
                return p, k
        return None

    def tree(self, parts: list[tuple[str, tuple]]) -> np.ndarray:
        """Join neighbouring parts (text, encoding) pairwise until one is left."""
        while len(parts) > 1:
            joined = [(a + b, self.join(a + b, len(a), x, y)) for (a, x), (b, y) in zip(parts[::2], parts[1::2], strict=False)]
            parts = joined + parts[len(joined) * 2 :]
        return parts[0][1][0]


def halves(text: str, leaf: int) -> list[str]:
    """``text`` cut in the middle, again and again, until no part is longer than ``leaf``."""
    if len(text) <= leaf:
        return [text]
    return halves(text[: len(text) // 2], leaf) + halves(text[len(text) // 2 :], leaf)


def encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """Per row: id, ``ids`` (binary, little-endian 32-bit) and ``decoded`` text, as the tokenizers library gives them for the whole text.

    A null text counts as empty: no ids, empty decoded text. Repeated rows (equal ids too) give a row each. Empty tables give empty
    results; other columns are not read. Texts without a chunk longer than ``leaf`` take one pass without a shuffle; of the others only
    the long chunks are dealt out as parts, and only these texts are shuffled. Both ways give the same ids.
    """
    spark = docs.sparkSession
    given, state = spark.sparkContext.broadcast(spec), {}

    def codec() -> Codec:
        if "codec" not in state:
            state["codec"] = Codec(given.value)
        return state["codec"]

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.col("text").rlike(f"[^ \\t-\\r]{{{leaf + 1}}}")

    def short_texts(columns):
        found = list(map(codec().text, columns[1]))
        return [columns[0], [f[0] for f in found], [f[1] for f in found]]

    plain = map_rows(rows.filter((F.length("text") <= leaf) | ~long), f"id {kind}, ids binary, decoded string", short_texts)

    # runs of short chunks stay together (kind 0), a long chunk becomes one row a part (kind 1) and added tokens one (kind 2)
    def deal(columns):
        out = [[], [], [], [], []]
        for row, text in zip(*columns, strict=True):
            step, last = 0, 0

            def put(what, unit, part, value):
                for column, v in zip(out, (row, unit, part, what, value), strict=True):
                    column.append(v)

            for m in _CHUNK.finditer(text):
                if m.end() - m.start() <= leaf:
                    continue
                put(0, step, 0, text[last : m.start()])
                step, last = step + 1, m.end()
                for special, segment in codec().segments(m[0]):
                    for k, part in enumerate([segment] if special else halves(segment, leaf)):
                        put(2 if special else 1, step, k, part)
                    step += 1
            put(0, step, 0, text[last:])
        return out

    tagged = rows.filter((F.length("text") > leaf) & long).select(F.struct("id", F.monotonically_increasing_id().alias("n")).alias("row"), "text")
    dealt = map_rows(tagged, f"row struct<id:{kind},n:bigint>, unit int, part int, what int, value string", deal)

    def leaves(columns):
        out_ids, out_ends = [], []
        c = codec()
        for what, value in zip(columns[3], columns[4], strict=True):
            if what == 0:
                ids, ends = np.frombuffer(c.text(value)[0], dtype="<u4"), np.zeros(0, np.int64)
            elif what == 2:
                ids, ends = np.array([c.added[value]]), np.zeros(0, np.int64)
            else:
                ids, ends = c.encode(value)
            out_ids.append(ids.astype("<u4").tobytes())
            out_ends.append(ends.astype("<i4").tobytes())
        return [*columns[:4], [v if w == 1 else "" for v, w in zip(columns[4], columns[3], strict=True)], out_ids, out_ends]

    encoded = map_rows(dealt.repartition("row", "unit", "part"), f"row struct<id:{kind},n:bigint>, unit int, part int, what int, value string, ids binary, ends binary", leaves)
    # one text's parts meet here, for its result is one row; only joins are encoded again
    gathered = encoded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("unit", "part", "what", "value", "ids", "ends"))).alias("parts"))

    def merge(columns):
        c, out = codec(), [[], [], []]
        for row, parts in zip(*columns, strict=True):
            units: dict[int, list] = {}
            for p in parts:
                units.setdefault(p["unit"], []).append(p)
            ids = b""
            for unit in units.values():
                if unit[0]["what"] == 1:
                    ids += c.tree([(p["value"], (np.frombuffer(p["ids"], "<u4").astype(np.int64), np.frombuffer(p["ends"], "<i4").astype(np.int64))) for p in unit]).astype("<u4").tobytes()
                else:
                    ids += unit[0]["ids"]
            out[0].append(row["id"])
            out[1].append(ids)
            out[2].append(" ".join(map(c.names.__getitem__, np.frombuffer(ids, "<u4").tolist())))
        return out

    joined = map_rows(gathered, f"id {kind}, ids binary, decoded string", merge)
    return plain.unionByName(joined).withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and the columns to ``keep``."""
    return encoded.select(
        id_col, F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), *keep,
    )
