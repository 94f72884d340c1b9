"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

The automaton holds every run of words of every item. A document's words are streamed through it once: the state is always the longest
run ending at the word that occurs in some item, so a matching length of a window or more means that all the words of the run are copied,
and the suffix link at window length says from which items. Items shorter than a window are windows of their own, found along the links.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import map_rows, stored

PART_BYTES = 1_000_000  # words of items in one automaton; more items are met by further passes, each with its own automaton
PIECE_WORDS = 4096  # longer items are cut into pieces that overlap by all but one word of a window

# Bytes of words: digits, ASCII letters (lower-cased) and every byte of a character beyond ASCII. All other bytes separate.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(_FOLD).split() if data else []


class Automaton:
    """All runs of words of the given (item, words) pairs, with the windows that occur in each item."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(item, words) for item, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.owners: dict[int, set] = {}  # state of a whole window -> items that contain it
        self.short: dict[int, dict[int, set]] = {}  # state -> length of a short item -> items
        for item, words in items:
            if len(words) < window:
                self.short.setdefault(self._walk(words), {}).setdefault(len(words), set()).add(item)
            else:
                self._own(item, words)
        self.least = min((min(len(words), window) for _, words in items), default=0)
        self._chains()

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, word, known)
        made = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = made
            at = link[at]
        if at >= 0:
            known = nxt[at][word]
            link[made] = known if length[known] == length[at] + 1 else self._split(at, word, known)
        return made

    def _split(self, at: int, word: bytes, known: int) -> int:
        """A state for the shorter runs of ``known`` that now occur in more places than its longest."""
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[known]))
        link.append(link[known])
        length.append(length[at] + 1)
        link[known] = copy
        while at >= 0 and nxt[at].get(word) == known:
            nxt[at][word] = copy
            at = link[at]
        return copy

    def _walk(self, words: list[bytes]) -> int:
        at = 0
        for word in words:
            at = self.next[at][word]
        return at

    def _own(self, item: str | None, words: list[bytes]) -> None:
        at, window, link, length = self._walk(words[: self.window]), self.window, self.link, self.length
        self.owners.setdefault(at, set()).add(item)
        for word in words[window:]:
            at = self.next[at][word]
            while length[link[at]] >= window:
                at = link[at]
            self.owners.setdefault(at, set()).add(item)

    def _chains(self) -> None:
        """For each state the suffix state of window length, and the nearest suffix state that ends short items."""
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.whole, self.ends = [0] * len(order), [0] * len(order)
        for s in order[1:]:
            up = self.link[s]
            if self.length[s] >= self.window:
                self.whole[s] = s if self.length[up] < self.window else self.whole[up]
            self.ends[s] = s if s in self.short else self.ends[up]

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """The copied spans [first word, end) in order, not touching each other, and the items whose windows occur."""
        nxt, link, length, whole, ends, short = self.next, self.link, self.length, self.whole, self.ends, self.short
        window, least = self.window, self.least
        spans: list[list[int]] = []
        states, items = set(), set()
        at = run = 0
        for i, word in enumerate(words):
            to = nxt[at].get(word)
            if to is None:
                while to is None and at:
                    at = link[at]
                    to = nxt[at].get(word)
                if to is None:
                    run = 0
                    continue
                run = length[at]
            at = to
            run += 1
            if run < least:
                continue
            longest = 0
            if run >= window:
                longest = run
                states.add(whole[at])
            if short:
                s = ends[at]
                while s:
                    for size, owners in short[s].items():
                        if size <= run:
                            longest = max(longest, size)
                            items |= owners
                    s = ends[link[s]]
            if longest:
                first = i + 1 - longest
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, i + 1])
        for s in states:
            items |= self.owners[s]
        return spans, items


def without(data: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words of ``spans`` and what stands between them; one space is left where text goes on at both sides."""
    places = [m.span() for m in _WORD.finditer(data.translate(_FOLD))]
    kept, at = [], 0
    for first, end in spans:
        kept.append(data[at : places[first][0]])
        at = places[end - 1][1]
    kept.append(data[at:])
    return b" ".join(k.strip(b" ") if 0 < n < len(kept) - 1 else k.rstrip(b" ") if n == 0 else k.lstrip(b" ") for n, k in enumerate(kept)).strip(b" ")


_BUILT: dict = {}


def _automaton(given) -> Automaton:
    """The automaton of a broadcast part, built once in each worker process."""
    pieces, window, mark = given.value
    if mark not in _BUILT:
        _BUILT.clear()
        _BUILT[mark] = Automaton([(item, words.split()) for item, words in pieces], window)
    return _BUILT[mark]


def _pieces(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    def run(columns: list[list]) -> list[list]:
        out: list[list] = [[], []]
        for item, data in zip(*columns, strict=True):
            words = words_of(data)
            for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                if words:
                    out[0].append(item)
                    out[1].append(b" ".join(words[at : at + PIECE_WORDS + window - 1]))
        return out

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return map_rows(rows, "item string, words binary", run).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, most_hit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_words``, ``n_hit``, ``spans`` (word numbers [first, end)), ``items`` (ids as strings, sorted), ``clean_text``, ``over_limit``.

    A word is copied (hit) inside ``window`` consecutive words of an item, or inside a whole item of fewer words. ``clean_text`` is the text
    without the copied spans; ``over_limit`` marks documents of which they cover more than ``most_hit``. Words are runs of digits, ASCII
    letters (case folded) and characters beyond ASCII. A null text has no words, no hits and a null clean text; an empty one an empty clean
    text. Items without words match nothing; items with a null id mark words but are not listed; repeated items count once per id.
    Repeated documents are answered each; other columns are not read; empty tables give empty results or no hits.

    Items up to ``PART_BYTES`` are one automaton, sent to all tasks: one pass, no shuffle. Beyond it they are dealt into parts of about that
    size, each with a pass of its own over the stored result of the one before, so neither driver nor tasks hold more than one part.
    """
    spark = docs.sparkSession
    pieces = stored(_pieces(items, window, item_col, item_text_col), "benchmark-words")
    total = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = max(1, math.ceil(total / PART_BYTES))
    kind = docs.schema[id_col].dataType.simpleString()
    between = f"id {kind}, text binary, spans array<array<int>>, items array<string>"
    final = f"`{id_col}` {kind}, n_words bigint, n_hit bigint, spans array<array<int>>, items array<string>, clean_text string, over_limit boolean"

    def met(given, last: bool):
        def run(columns: list[list]) -> list[list]:
            automaton = _automaton(given)
            ids, texts, spans, items = columns
            n_words, n_hit, clean = [], [], []
            for n, data in enumerate(texts):
                words = words_of(data)
                new, owners = automaton.scan(words)
                owners.discard(None)
                spans[n] = merged(spans[n] + new) if spans[n] else new
                items[n] = sorted(owners | set(items[n]))
                if last:
                    n_words.append(len(words))
                    n_hit.append(sum(b - a for a, b in spans[n]))
                    clean.append(None if data is None else (without(data, spans[n]) if spans[n] else data).decode("utf-8"))
            if not last:
                return [ids, texts, spans, items]
            return [ids, n_words, n_hit, spans, items, clean, [h > most_hit * w for h, w in zip(n_hit, n_words, strict=True)]]

        return run

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.expr("cast(array() as array<array<int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for part in range(parts):
        mine = pieces if parts == 1 else pieces.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part)
        held = [(r.item, bytes(r.words)) for r in mine.collect()]  # about PART_BYTES
        given = spark.sparkContext.broadcast((held, window, hashlib.sha256(repr((sorted(held, key=repr), window)).encode()).hexdigest()))
        last = part == parts - 1
        rows = map_rows(rows, final if last else between, met(given, last))
        if not last:
            rows = stored(rows, "decontaminated")
    return rows


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and out[-1][1] >= first:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The fixed-width form of ``decontaminate``: counts and a digest of the item ids."""
    return found.select(
        id_col, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


DECONTAMINATION_SQL = r"""
WITH d AS (
 SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
 SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
 SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS gram
 FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
h AS (
 SELECT r, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram
 FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT r, p, n, item_id FROM h JOIN g USING (n, gram)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM m)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
