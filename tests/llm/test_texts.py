"""Token counts, encoding, Jaccard join, quality and mixing on hard texts."""

import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import bpe, jaccard, mixing, quality, queries, token_count

WORD, BYTE = queries.tokenizer_spec(queries.WORD_TOKENIZER), queries.tokenizer_spec(queries.BYTE_TOKENIZER)


def library(spec):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def key(row):
    return str(tuple(row))


def test_token_counts_match_the_library(frame, hard_docs):
    got = token_count.count_tokens(frame(hard_docs), BYTE).collect()
    t = library(BYTE)
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x, *_ in hard_docs]
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert token_count.count_tokens(frame([]), BYTE).count() == 0


def test_rare_white_space_keeps_the_shortcut():
    """Counts equal the library's, and only what stands around a rare character is given to its pre-tokenizer."""
    spec = queries.tokenizer_spec(queries.BYTE_TOKENIZER)
    t, counter = library(spec), token_count.Counter(spec, token_count.whole_tokens(spec))
    given = []

    class Spy:
        model = counter.tokenizer.model

        class pre_tokenizer:  # noqa: N801
            @staticmethod
            def pre_tokenize_str(text):
                given.append(text)
                return real.pre_tokenizer.pre_tokenize_str(text)

    real, counter.tokenizer = counter.tokenizer, Spy
    r = random.Random(5)
    units = ["a", "word", "'s", " ", "  ", "\n", "\t", "9", "!", "\u3000", "\u200b", "\u2028", "\ufeff", "\x85", "\x1c", "\u200d", "\u180e", "\u00a0", "\u65e5\u672c", "\U0001f469\u200d\U0001f4bb", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(r.choice(units) for _ in range(r.randint(1, 25)))
        assert counter.text(text) == len(t.encode(text, add_special_tokens=False).ids), repr(text)
    given.clear()
    text = "plain words " * 500 + "a\u3000b" + " and more words" * 500
    assert counter.text(text) == len(t.encode(text, add_special_tokens=False).ids)
    assert max(map(len, given)) < 20


def test_whole_tokens_encode_alone():
    whole, t = token_count.whole_tokens(BYTE), library(BYTE)
    assert len(whole) > 50_000 and "<|endoftext|>" not in whole
    vocab = t.get_vocab()
    for word in random.Random(0).sample(sorted(w for w in whole if w.isascii() and w.isalpha()), 300):
        assert t.encode(word, add_special_tokens=False).ids == [vocab[word]]


@pytest.mark.parametrize("leaf", [64, 4096])
def test_encoding_matches_the_library(frame, hard_docs, leaf):
    got = bpe.digests(bpe.encode(frame(hard_docs), WORD, leaf=leaf)).collect()
    t = library(WORD)
    want = []
    for i, x, *_ in hard_docs:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert bpe.encode(frame([]), WORD).count() == 0


def test_tree_joins_are_exact():
    """Random unsplit texts, halved down to a few characters, join to the library's encoding."""
    codec, t, r = bpe.Codec(WORD), library(WORD), random.Random(5)
    units = ["a", "b", "the", "ing", "'s", "'", "é", "e\u0301", "ñ", "日本", "1", "22", "!", "?!", "Σ", "İ", "😀", "ER", "##", "tion", "aaaaaaaa"]
    for _ in range(400):
        text = codec.normal("".join(r.choice(units) for _ in range(r.randint(2, 60))))
        if text.strip():
            parts = [(p, codec.encode(p)) for p in bpe.halves(text, r.choice([3, 7, 16]))]
            assert codec.tree(parts).tolist() == codec.bare.encode(text, add_special_tokens=False).ids, text
    assert codec.text("It's THE end, <|endoftext|>Ünï.")[1] == t.decode(t.encode("It's THE end, <|endoftext|>Ünï.", add_special_tokens=False).ids, skip_special_tokens=False)


def test_jaccard_join_matches_brute_force(frame, hard_docs):
    r = random.Random(3)
    vocab = [f"v{k}" for k in range(300)]
    base = [r.choices(vocab, k=60) for _ in range(6)]
    rows = [(100 + k, " ".join(w if r.random() > 0.02 else r.choice(vocab) for w in base[k % 6]), "en", "s", 1) for k in range(90)]
    docs = [d for d in hard_docs if d[0] is not None] + rows
    got = jaccard.jaccard_join(frame(docs)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(key, got)) == sorted(map(key, brute.jaccard([(i, t) for i, t, *_ in docs])))
    assert jaccard.jaccard_join(frame([])).count() == 0


def test_jaccard_join_with_null_ids(frame, hard_docs):
    got = Counter(tuple(r) for r in jaccard.jaccard_join(frame(hard_docs)).select("doc_id", "class_id", "n_links").collect())
    assert got == Counter(brute.jaccard([(i, t) for i, t, *_ in hard_docs]))


def test_copies_of_texts_without_words_are_one_class(frame):
    texts = ["!!! ???", "---", "!!! ???", " !!! ???\n", "\U0001f600", "\U0001f600", "", "", None, " ", " ", "a b c"]
    docs = frame([(k, t, "en", "s", 1) for k, t in enumerate(texts)])
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(docs).collect()}
    assert got == {k: (k, 0) for k in range(12)} | {0: (0, 2), 2: (0, 2), 3: (0, 2), 4: (4, 1), 5: (4, 1)}
    assert sorted(r.doc_id for r in jaccard.drop_near_copies(docs).collect()) == [0, 1, 4, 6, 7, 8, 9, 10, 11]


def test_blocks_of_buckets_and_groups(frame, monkeypatch):
    """Buckets and groups over several blocks give what one block gives."""
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 8)
    r = random.Random(1)
    base = [f"v{k}" for k in range(80)]
    docs = [(k, " ".join(w if r.random() > 0.015 else f"x{r.randint(0, 99)}" for w in base), "en", "s", 1) for k in range(60)]
    got = jaccard.jaccard_join(frame(docs, clash=False)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(brute.jaccard([(i, t) for i, t, *_ in docs]))


def test_pruning_keeps_pairs_at_the_threshold():
    need = jaccard.needed()
    assert list(need) == list(range(jaccard.STEP, jaccard.VALUES + 1, jaccard.STEP))
    assert all(need[n] / n < 0.8 for n in need) and need[jaccard.VALUES] / jaccard.VALUES > 0.5


def test_drop_near_copies_keeps_one_of_each_group(frame, hard_docs):
    docs = frame(hard_docs)
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = {i for i, c, _ in brute.jaccard([(i, t) for i, t, *_ in hard_docs]) if i == c and i is not None}
    ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(want)


def test_quality_learns_from_rows_not_held_out(spark, frame):
    r = random.Random(2)
    words = ["the", "house", "river", "stands", "quiet", "light", "over", "and", "old", "garden"]
    good = lambda: " ".join(r.choice(words) for _ in range(120)).capitalize() + "."
    bad = [lambda: "BUY NOW!! " * 60, lambda: " ".join(r.choice(words) + "###" for _ in range(90)), lambda: "spam " * 200]
    rows = [(k, good() if k % 3 else good()[:300] + r.choice(bad)(), "en", "s", 1) for k in range(400)]
    docs = frame([*rows, (900, None, None, None, None), (901, "", None, None, None), (901, "", None, None, None), (902, good() * 50, "en", "s", 1)])
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    scored = quality.score_quality(docs, model)
    assert set(docs.columns) <= set(scored.columns)
    got = {r.doc_id: (r.score, r.predicted, r.held) for r in scored.select("doc_id", "score", "predicted", quality.held_out().alias("held")).collect()}
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for s, p, _ in got.values())
    held = [k for k in range(400) if got[k][2]]
    assert 50 < len(held) < 120 and np.mean([got[k][1] == int(k % 3 > 0) for k in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score_quality(docs, quality.fit(docs, flipped)).select("doc_id", "score").collect()}
    assert again == {k: v[0] for k, v in got.items()}
    assert quality.score_quality(frame([]), model).count() == 0


def test_quality_without_labels_is_even(spark, frame, hard_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.score_quality(frame(hard_docs), quality.fit(frame(hard_docs), labels)).collect()} == {0.5}


def test_mixing_meets_its_targets(frame, hard_docs):
    r = random.Random(4)
    rows = [(k, " ".join("w" for _ in range(r.randint(0, 40))), "en", r.choice(["a", "a", "a", "b", "c", None]), 1) for k in range(600)]
    docs = frame([*rows, *hard_docs[:3], *[d for d in hard_docs if d[0] is None]])
    got = mixing.mix(docs).select("source", "size", "source_size", "target", "taken", "doc_id").collect()
    again = mixing.mix(docs).select("source", "size", "source_size", "target", "taken", "doc_id").collect()
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == docs.count()
    sizes = Counter()
    for row in docs.select("source", "text").collect():
        sizes[row.source] += len(re.findall(r"[^\x20\x09-\x0D]+", row.text or ""))
    want, taken = brute.fill(sizes), Counter()
    for row in got:
        assert row.source_size == sizes[row.source] and row.target == pytest.approx(want[row.source])
        assert row.taken <= 3 * row.size
        taken[row.source] += row.taken
    most = max(row.size for row in got)
    assert all(abs(taken[s] - want[s]) <= most for s in sizes)
    assert mixing.mix(frame([])).count() == 0


def test_water_filling_redistributes(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 40, None: 3, "z": 0}
    got = {r.source: r.target for r in mixing.fill(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    want = brute.fill(sizes)
    assert got == {s: pytest.approx(want[s]) for s in sizes} and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_rows_of_one_id_are_mixed_each_by_itself(frame):
    """Many null and shared ids: every source meets its target, row by row as in brute force."""
    r = random.Random(6)
    rows = [(r.choice([None, None, 1, k]), " ".join(f"w{r.randint(0, 9)}" for _ in range(r.randint(1, 40))), "en", r.choice("aaaabbc"), 1) for k in range(500)]
    docs = frame(rows)
    out = mixing.take(docs)
    assert out.columns == docs.columns
    got = Counter((d.doc_id, d.text, d.source) for d in out.collect())
    assert got == brute.mixed([(i, t, s) for i, t, _, s, _ in rows])
    size = lambda s: sum(len(t.split()) for _, t, _, x, _ in rows if x == s)
    want = brute.fill({s: size(s) for s in "abc"})
    assert all(abs(sum(n * len(t.split()) for (_, t, x), n in got.items() if x == s) - want[s]) <= 40 for s in "abc")
    assert mixing.take(frame([])).count() == 0
