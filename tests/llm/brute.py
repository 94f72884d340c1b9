"""Plain Python versions of the operators, for small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np


def jaccard(rows, threshold=(4, 5)):
    """[(id, text)] -> [(id, class id, links)] by comparing all shingle sets."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    owners = defaultdict(list)
    for n, s in enumerate(sets):
        for shingle in s:
            owners[shingle].append(n)
    common = Counter((a, b) for own in owners.values() for i, b in enumerate(own) for a in own[:i])
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if n * threshold[1] >= threshold[0] * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for n, (i, _) in enumerate(rows):
        r = find(n)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, least.get(find(n)), links[n]) for n, (i, _) in enumerate(rows)]


def cosine(rows, threshold=0.95):
    """[(id, vector)] -> {id: (links, component)} for rows with distinct ids."""
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in good), default=0)
    out = {i: [0, i] for i, _ in rows}
    ids = [i for i, _ in good]
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in good]).reshape(len(good), width)
    x = x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x
    near = x @ x.T >= threshold
    for a in range(len(ids)):
        out[ids[a]][0] = int(near[a].sum() - near[a][a])
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(near), strict=True):
            if out[ids[b]][1] < out[ids[a]][1]:
                out[ids[a]][1], changed = out[ids[b]][1], True
    return {i: tuple(v) for i, v in out.items()}


def top_k(rows, k=5, every=50, scale=256):
    """[(id, vector)] in row order -> sorted [(query, rank, id, score)]."""
    good = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j) for b, (j, v) in enumerate(good) if b != a)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def chat(rows):
    """[(conv, turn, role, text)] -> {conv: (turns, digest, loss characters, loss digest)}."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def rule(url, rules):
    """(host, path, rule, verdict) of a url."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def mixed(rows, seed=7, epochs=3):
    """[(id, text, source)] -> Counter of the rows taken, deciding row after row; equal rows tie."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    order, out = defaultdict(list), Counter()
    for i, text, source in rows:
        order[source].append((md5(f"{seed}:{'' if i is None else i}:{md5(text or '')}"), len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), (i, text, source)))
    sizes = {s: sum(size for _, size, _ in v) for s, v in order.items()}
    target = fill(sizes, epochs=epochs)
    for source, v in order.items():
        whole = int(target[source] // sizes[source]) if sizes[source] else 0
        rest, place = target[source] - whole * sizes[source], 0
        for _, size, row in sorted(v, key=lambda x: x[:2]):
            out[row] += whole + int(whole < epochs and place + size / 2 <= rest and place < rest)
            place += size
    return +out


def fill(sizes, weights=(5, 2, 1), epochs=3):
    """Targets of {source: size} by repeated redistribution."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= epochs * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = float(epochs * sizes[s])
        left -= sum(epochs * sizes[s] for s in full)
        open_ -= full
    return target
