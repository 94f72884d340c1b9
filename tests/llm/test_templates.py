"""Page templates by equivalence classes beside a plain version, and the pipeline's stages on hard rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from stockloom.llm import extraction, jaccard

PAGES = "page_id bigint, url string, html string"


def plain_templates(pages):
    """{host: (root and nested tokens)} of [(host, html)], by whole occurrence vectors."""
    by = defaultdict(dict)
    for host, page in pages:
        by[host][page] = {t["token"]: (t["n"], t["at"]) for t in extraction._tokens(page, *extraction.parse(page))}
    out = {}
    for host, own in by.items():
        keys = list(own)
        vectors = defaultdict(list)
        for token in {t for p in own.values() for t in p}:
            vectors[tuple(own[k].get(token, (0, 0))[0] for k in keys)].append(token)
        valid = {}
        for vector, tokens in vectors.items():
            on = [k for k, n in zip(keys, vector, strict=True) if n]
            orders = {tuple(sorted(tokens, key=lambda t, k=k: (own[k][t][1], t))) for k in on}
            if len(tokens) >= extraction.CLASS_TOKENS and len(on) >= extraction.CLASS_PAGES and len(orders) == 1:
                valid[vector] = tokens
        roots = [v for v in valid if max(v) == 1]
        if not roots:
            out[host] = set()
            continue
        most = max(sum(v) for v in roots)
        roots = [v for v in roots if sum(v) == most]
        root = roots[0] if len(roots) == 1 else None
        if root is None:
            continue
        kept = set(valid[root])
        for vector, tokens in valid.items():
            gaps = set()
            for k, n in zip(keys, vector, strict=True):
                if n and vector != root:
                    frame = [own[k][t][1] for t in valid[root] if t in own[k]]
                    gaps |= {sum(f < own[k][t][1] for f in frame) for t in tokens} if frame else set()
            if len(gaps) == 1:
                kept |= set(tokens)
        out[host] = kept
    return out


def synthetic(host, k, r):
    """A page without an article element: names that say nothing, boilerplate around and between its texts."""
    words = lambda n: " ".join(r.choice(["sun", "river", "stone", "bread", "wind", "field", "road"]) + str(r.randint(0, 999)) for _ in range(n))
    paragraphs = [words(r.randint(4, 20)) for _ in range(r.randint(1, 5))]
    notice = f"<div class='n{host}'><p>We changed our terms</p><p>Read them here</p></div>" if k % 3 == 0 else ""
    page = (f"<html><body><div class='t{host}'>Site of {host}</div>{notice}<div class='x{host}'><h1>{words(3)} {k}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
            + f"</div><div class='z{host}'><p>All rights of {host}</p><p>Made by us</p></div></body></html>")
    return page, paragraphs


def test_templates_are_the_classes_of_whole_vectors(spark, frame):
    r = random.Random(7)
    rows = [(host, synthetic(host, k, r)[0]) for host in ("a", "b") for k in range(12)]
    rows += [("c", f"<div><p>x{k % 5}</p><ul>{'<li>i</li>' * (k % 4)}</ul>{'<b>m</b><i>n</i>' * (k % 2)}<p>foot</p></div>") for k in range(20)]
    rows += rows[:5]
    df = frame([(k, f"http://{h}.com/", p) for k, (h, p) in enumerate(rows)], PAGES)
    kept = {}
    plain = extraction.stored

    def spy(out, label):
        kept[label] = plain(out, label)
        return kept[label]

    extraction.stored = spy
    try:
        extraction.extract(df).count()
    finally:
        extraction.stored = plain
    got = {t.host: set(t.constants) for t in kept["templates"].collect()}
    texts = lambda page: {t["token"] for t in extraction._tokens(page, *extraction.parse(page)) if t["rank"] == -1}
    for host, tokens in plain_templates([(f"{h}.com", p) for h, p in rows]).items():
        own = set().union(*(texts(p) for h, p in rows if f"{h}.com" == host))
        assert got.get(host, set()) == tokens & own, host


def test_boilerplate_without_article_elements_goes(frame):
    r = random.Random(11)
    made = {(h, k): synthetic(h, k, r) for h in ("a", "b", "c") for k in range(15)}
    rows = [(n, f"http://{h}.com/{k}", page) for n, ((h, k), (page, _)) in enumerate(made.items())]
    got = {row.page_id: row.text for row in extraction.extract(frame(rows, PAGES)).collect()}
    for n, (_, paragraphs) in enumerate(made.values()):
        assert got[n].split("\n")[1:] == paragraphs and "rights" not in got[n] and "terms" not in got[n]


def test_names_with_a_subject_of_their_own_stay_in_articles(frame):
    body = "<section class='related-work'><p>earlier studies</p></section><div class='alert-box'>mind the step</div><h2 class='share-price'>prices</h2><figure class='widget-image'>a lever</figure><div class='share-buttons'>share</div>"
    text = "earlier studies\nmind the step\nprices\na lever"
    rows = [(0, "http://one.com/", f"<article><p>x</p>{body}</article>")]
    # the same names over many pages: constant texts are the template's, others are the article's
    rows += [(10 + k, "http://many.com/", f"<html><body><article><h1>h{k}</h1><div class='promo-card'>Join us</div><div class='related-work'>study {k}</div><p>t{k}</p></article><p>foot</p></body></html>") for k in range(5)]
    got = {r.page_id: r.text for r in extraction.extract(frame(rows, PAGES)).collect()}
    assert got == {0: "x\n" + text} | {10 + k: f"h{k}\nstudy {k}\nt{k}" for k in range(5)}


def test_first_stage_keeps_columns_of_its_own_names(spark, frame, tmp_path):
    docs = frame([(k, f"good plain words number {k} " * 5, "en", "s", 1) for k in range(20)])
    docs = docs.drop("score", "predicted").withColumn("score", F.lit(42)).withColumn("predicted", F.lit("mine"))
    frame([(k, 1) for k in range(20)], "doc_id bigint, quality int", clash=False).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() == 20 and {(r.score, r.predicted) for r in out.collect()} == {(42, "mine")}


def test_one_of_each_group_stays_without_ids_too(frame):
    base = "the quick brown fox jumps over the lazy dog and runs away from the old house by the river at night while it rains"
    near = [base, base + " today", base + " again", base.upper()]
    other = "an altogether different text about ships that sail from harbour to harbour in the long winter months of the year"
    rows = [(None, t, "en", "s", 1) for t in near] + [(5, other, "en", "s", 1), (5, other + " too", "en", "s", 1), (5, other, "en", "s", 1), (None, None, "en", "s", 0), (6, None, "en", "s", 0)]
    out = jaccard.drop_near_copies(frame(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:5].lower()) for r in out) == [(False, 5, "an al"), (False, 6, ""), (True, 0, ""), (True, 0, "the q")]
