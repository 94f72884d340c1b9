"""Token counts with a whole-token shortcut.

Most words of a text are single entries of the vocabulary. ``whole_tokens`` proves once, before any text is read, which vocabulary
strings encode alone as exactly one token. A pre-token in that set counts as one token without any merging; only the rest are merged.
The proof holds in every context because byte-level merges never cross pre-tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import map_rows

# A run of characters that are not white space, with one space before it, starts and ends at a pre-token boundary, as do the white-space
# runs of the pattern. Rare white space, on whose class libraries differ, sends what stands between the nearest white-space runs through the library's own pre-tokenizer: a run of ASCII white space
# after a common character always begins a pre-token.
_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_RARE = re.compile("[\x1c-\x1f\x85\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_CUT = re.compile(rf"(?<=[^\s{_RARE.pattern[1:-1]}])(?=[ \t\n\r\f\v])")
_KEEP, _LONGEST = 150_000, 64


def _load(spec: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def whole_tokens(spec: str) -> frozenset[str]:
    """The vocabulary strings (in the tokenizer's byte letters) that the merge model turns into their own single id."""
    tokenizer = _load(spec)
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    proved = set()
    for word, number in tokenizer.get_vocab(with_added_tokens=False).items():
        tokens = tokenizer.model.tokenize(word)
        if word not in added and len(tokens) == 1 and tokens[0].id == number:
            proved.add(word)
    return frozenset(proved)


class Counter:
    """Counts the tokens of a text. Holds at most ``_KEEP`` counted pieces of at most ``_LONGEST`` characters."""

    def __init__(self, spec: str, whole: frozenset[str]):
        self.tokenizer, self.whole, self.known = _load(spec), whole, {}
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def piece(self, text: str) -> int:
        count = 0
        for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            count += 1 if word in self.whole else len(self.tokenizer.model.tokenize(word))
        if len(text) <= _LONGEST:
            if len(self.known) >= _KEEP:
                self.known.clear()
            self.known[text] = count
        return count

    def segment(self, text: str) -> int:
        known, piece, total = self.known, self.piece, 0
        for p in _PIECE.findall(text):
            n = known.get(p)
            total += piece(p) if n is None else n
        return total

    def stretches(self, text: str) -> int:
        found = _RARE.search(text)
        if not found:
            return self.segment(text)
        cuts, total, at = [0, *(c.start() for c in _CUT.finditer(text)), len(text)], 0, 0
        while found:
            start = max(at, cuts[bisect_right(cuts, found.start()) - 1])
            end = cuts[bisect_left(cuts, found.end())]
            total += self.segment(text[at:start]) + self.piece(text[start:end])
            at = end
            found = _RARE.search(text, at)
        return total + self.segment(text[at:])

    def text(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.stretches(text)
        # the library takes added tokens out of the text first, each is one token
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.stretches, parts))


def count_tokens(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``spec`` is the content of a byte-level tokenizer file (bounded by its vocabulary; executors need no file). A null text counts as empty:
    0 bytes, 0 tokens. Repeated rows are counted each. Very long texts are read in one piece, never cut. Other columns are not touched, so
    clashing names do no harm; an empty table gives an empty result. One pass, no shuffle.
    """
    given = docs.sparkSession.sparkContext.broadcast((spec, whole_tokens(spec)))
    state: dict = {}

    def run(columns: list[list]) -> list[list]:
        counter = state.get("counter")
        if counter is None:
            counter = state["counter"] = Counter(*given.value)
        ids, texts = columns
        texts = [t or "" for t in texts]
        counts = list(map(counter.text, texts))
        return [ids, [len(t.encode("utf-8")) for t in texts], counts, [n > limit for n in counts]]

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col))
    return map_rows(rows, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", run)
