"""Decontamination, cross-tokenizer alignment and hard negatives beside plain versions."""

import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from stockloom.llm import alignment, decontamination, hard_negatives


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_hits(text, items, window):
    words, hit, found = plain_words(text), set(), set()
    for item, body in items:
        run = plain_words(body)
        n = min(len(run), window)
        grams = {tuple(run[k : k + n]) for k in range(len(run) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(item)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None)


def bench_items(r):
    item = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(k, item(r.randint(3, 30))) for k in range(12)] + [(20, "Short. ITEM"), (21, "short item here"), (22, ""), (23, None), (24, "!!!"), (None, item(14)), (20, "Short. ITEM"), (26, "é é É")]
    return [*items, (30, items[0][1]), (31, " ".join(f"w{k}" for k in range(40)))]


@pytest.mark.parametrize("part", [1_000_000, 60])
def test_decontamination_matches_brute_force(frame, hard_docs, monkeypatch, part):
    monkeypatch.setattr(decontamination, "PART_BYTES", part)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 7)
    r = random.Random(3)
    items = bench_items(r)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 60))) for _ in range(30)]
    texts += [(items[k][1] or "") + ", tail" for k in range(12)] + ["a short, item. short-item here é É é", "W5 w6-w7 w8 w9 w10 w11 w12 w13 w14 w15 x w16", " ".join(f"w{k}" for k in range(9))]
    rows = [(100 + k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + hard_docs
    docs = frame(rows)
    bench = frame([(i, t, 1) for i, t in items], "item_id bigint, text string, extra int")
    got = decontamination.decontaminate(docs, bench, window=5).collect()
    want = Counter((row[0], *plain_hits(row[1], items, 5)[:2], ",".join(plain_hits(row[1], items, 5)[2])) for row in rows)
    assert Counter((g.doc_id, g.n_words, g.n_hit, ",".join(g["items"])) for g in got) == want
    for g in got:
        assert sum(b - a for a, b in g.spans) == g.n_hit and (g.clean_text is None or len(plain_words(g.clean_text)) == g.n_words - g.n_hit)


def test_decontamination_of_empty_tables(frame, hard_docs):
    none = frame([], "item_id bigint, text string")
    assert all(r.n_hit == 0 and r["items"] == [] for r in decontamination.decontaminate(frame(hard_docs), none).collect())
    assert decontamination.decontaminate(frame([]), none).count() == 0


def test_removed_spans_leave_the_rest():
    data = "Keep this. Alpha beta, gamma! And that; delta".encode()
    assert decontamination.without(data, [[2, 5]]) == b"Keep this. ! And that; delta"
    assert decontamination.without(data, [[0, 8]]) == b""
    assert decontamination.without(data, [[0, 1], [7, 8]]) == b"this. Alpha beta, gamma! And that;"


def plain_alignment(texts):
    """Per text (n_a, n_b, groups), by the libraries and sets of ends; then n_best and count_sum of each."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters, rows, count = alignment.byte_letters(), [], Counter()
    for text in texts:
        tokens_a = [(k, bytes(letters[c] for c in a.id_to_token(k))) for k in a.encode(" " + (text or ""), add_special_tokens=False).ids] if text else []
        tokens_b = [(k, bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x..>", p) else p.replace("▁", " ").encode()) for k, p in ((k, b.id_to_piece(k)) for k in b.encode(text or ""))]
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(t for _, t in tokens) != whole for tokens in (tokens_a, tokens_b)):
            rows.append((0, 0, "", []))
            continue
        ends = lambda tokens: np.cumsum([len(t) for _, t in tokens]).tolist()
        end_a, end_b = ends(tokens_a), ends(tokens_b)
        links, groups, at = [], [], [0, 0]
        for end in sorted(set(end_a) & set(end_b)):
            group = []
            for side, (tokens, own) in enumerate(((tokens_a, end_a), (tokens_b, end_b))):
                first = at[side]
                at[side] = own.index(end, first) + 1
                group.append([k for k, _ in tokens[first : at[side]]])
            groups.append("|".join(",".join(map(str, g)) for g in group))
            links.append((group[0][-1], group[1][-1]))
        rows.append((len(tokens_a), len(tokens_b), ";".join(groups), links))
        count.update(links)
    top = defaultdict(int)
    for (_, k), n in count.items():
        top[k] = max(top[k], n)
    return [(n_a, n_b, groups, len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links)) for n_a, n_b, groups, links in rows]


@pytest.mark.parametrize("part", [4_000_000, 50])
def test_alignment_matches_the_libraries(frame, hard_docs, monkeypatch, part):
    monkeypatch.setattr(alignment, "PART_PAIRS", part)
    extra = ["plain <s> </s> <unk> text", "a▁b", "▁", "\x00 null \x00", "emoji 😀😀 ok", " lead", "trail ", "tab\t\ttab  two   three", "१२३ ½ ²", "x" * 3000, " " * 400_000 + "x"]
    rows = [row for row in hard_docs if len(row[1] or "") < 20_000] + [(200 + k, t, "en", "s", 1) for k, t in enumerate(extra)]
    from stockloom.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, tokenizer_bytes, tokenizer_spec

    got = alignment.align(frame(rows), tokenizer_spec(BYTE_TOKENIZER), tokenizer_bytes(PIECE_TOKENIZER), keep_groups=True)
    want = Counter((row[0], *w) for row, w in zip(rows, plain_alignment([row[1] for row in rows]), strict=True))
    assert Counter((r.doc_id, r.n_a, r.n_b, r.groups, r.n_links, r.n_best, r.count_sum) for r in got.collect()) == want
    assert all(r.groups_sha256 == (brute.sha(r.groups) if r.n_a else "") for r in got.collect())
    assert alignment.align(frame([]), tokenizer_spec(BYTE_TOKENIZER), tokenizer_bytes(PIECE_TOKENIZER)).count() == 0


def test_runs_are_the_common_ends():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 60)
        a, b = (sorted({r.randint(1, n) for _ in range(r.randint(1, n))} | {n}) for _ in range(2))
        if r.random() < 0.3:
            b = a if r.random() < 0.5 else a[: len(a) // 2] + [a[-1]]
        at_a, at_b = alignment.common_ends(np.array(a), np.array(b))
        assert [a[k] for k in at_a] == [b[k] for k in at_b] == sorted(set(a) & set(b))


def test_ranks_encode_as_the_library_does():
    from tokenizers import Tokenizer

    from stockloom.llm.queries import BYTE_TOKENIZER, tokenizer_spec

    spec = tokenizer_spec(BYTE_TOKENIZER)
    library, own, r = Tokenizer.from_str(spec), alignment.ByteLevel(spec), random.Random(5)
    library.encode_special_tokens = True
    assert own.fast is not None
    for _ in range(400):
        kind = r.choice(["abcdefgh'st ", "ethionarsl", "0123456789 ,.", " \n\t 　a", "éüñ日本語한 ", "".join(map(chr, range(32, 127)))])
        text = "".join(r.choice(kind) for _ in range(r.randint(0, 80)))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def plain_negatives(rows, every, k=5, n=10):
    """[(id, vector, label)] in row order -> sorted result rows."""
    good = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q, own) in enumerate(good):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j, b) for b, (j, v, _) in enumerate(good) if b != a)
            for p_score, p_id, _ in [t for t in scored if good[t[2]][2] == own][:k]:
                fits = [t for t in scored if good[t[2]][2] != own and -30 * p_score <= -100 * t[0] <= -90 * p_score]
                out += [(i, p_id, rank + 1, j, -p_score, -s) for rank, (s, j, _) in enumerate(fits[:n])]
    return sorted(out)


def clustered(kind, n=150):
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 6)) * (3 if kind == "clusters" else 0.05)
    rows = [(k, (centres[k % 6] + r.normal(size=6) * 0.3), int(r.integers(0, 3))) for k in range(n)]
    rows += [(200 + k, rows[3][1], k % 3) for k in range(20)] + [(300, -rows[3][1], 1), (10, rows[3][1], 0), (10, rows[4][1], 1)]
    rows = [(i, [float(np.float32(y)) for y in v], label) for i, v, label in rows]
    return rows + [(400, None, 1), (410, [], 1), (420, [0.0] * 6, 0), (430, [float("nan")] * 6, 0), (440, [float("inf")] + [0.0] * 5, 0), (450, [None] + [1.0] * 5, 0), (460, [1.0, 2.0], 2), (470, [1.0] * 6, None), (None, [1.0] * 6, 0)]


@pytest.mark.parametrize("kind,sizes", [("clusters", (2048, 256)), ("clusters", (8, 2)), ("noise", (8, 2))])
def test_hard_negatives_match_brute_force(frame, monkeypatch, kind, sizes):
    monkeypatch.setattr(hard_negatives, "BLOCK", sizes[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", sizes[1])
    monkeypatch.setattr(hard_negatives, "FAN", 3)
    rows = clustered(kind)
    got = hard_negatives.mine(frame(rows, "vec_id bigint, embedding array<float>, label int"), every=10)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 10)


def test_hard_negatives_few_and_empty(frame):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert hard_negatives.mine(frame([], schema)).count() == 0
    assert hard_negatives.mine(frame([(1, [1.0], 0)], schema)).count() == 0
    assert hard_negatives.mine(frame([(100, [1.0], 0), (1, [1.0], 0), (2, [0.5], 0)], schema)).count() == 0
    rows = [(100, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.0], 1), (3, [0.95, 0.0], 1), (4, [0.29, 0.0], 1)]
    assert [tuple(r) for r in hard_negatives.mine(frame(rows, schema)).collect()] == [(100, 1, 1, 2, 65536, 32768)]


def test_hilbert_neighbours_are_adjacent():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dimensions), -1).reshape(-1, dimensions)
        places = hard_negatives.hilbert(cells, bits)
        assert sorted(places) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(1) == 1).all()


def test_zone_maps_leave_out_far_blocks(frame, monkeypatch):
    """Clusters far apart: most pairs of blocks are never read."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "FAN", 4)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 1)
    pairs, plain = {}, hard_negatives.stored

    def spy(df, label):
        out = plain(df, label)
        if label.endswith("-pairs"):
            pairs[label] = out.count()
        return out

    monkeypatch.setattr(hard_negatives, "stored", spy)
    r = np.random.default_rng(4)
    axis = np.eye(8)
    rows = [(k, [float(np.float32(v)) for v in 4 * axis[k % 8] + r.normal(size=8) * 0.1], k // 8 % 2) for k in range(800)]
    got = hard_negatives.mine(frame(rows, "vec_id bigint, embedding array<float>, label int"), every=100)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 100)
    whole = 8 * 800 / 16  # anchors times blocks
    assert pairs["positive-pairs"] < whole / 5 and pairs["window-pairs"] < whole / 5 and pairs["narrow-pairs"] < whole / 5
