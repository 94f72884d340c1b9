"""Vectors, chats, urls, pages and the pipeline."""

import math
import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import chat, extraction, near_vectors, queries, topk, urls

VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors():
    r = np.random.default_rng(0)
    x = [r.normal(size=8) for _ in range(40)]
    rows = [(k, v) for k, v in enumerate(x)]
    rows += [(100 + k, x[k] * (1 + k)) for k in range(10)] + [(200 + k, x[3] + r.normal(scale=0.05, size=8)) for k in range(30)] + [(300 + 50 * k, x[5]) for k in range(5)]
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in rows]
    return rows + [(600, None), (601, []), (602, [0.0] * 8), (603, [float("nan")] * 8), (604, [math.inf] + [0.0] * 7), (605, [None] + [1.0] * 7), (606, [1.0, 2.0]), (607, [-0.0, 0.0, 1.0] + [0.0] * 5), (650, [0.0, 0.0, 1.0])]


@pytest.mark.parametrize("block", [4096, 16])
def test_near_vectors_match_brute_force(frame, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "RUN", 8)
    rows = vectors()
    got = near_vectors.near_vectors(frame([(i, v, 0) for i, v in rows], VECTORS)).collect()
    want = brute.cosine(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_repeated_and_empty(frame):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, None, 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_vectors(frame(rows, VECTORS)).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert near_vectors.near_vectors(frame([], VECTORS)).count() == 0
    assert near_vectors.near_vectors(frame([(9, None, 0)], VECTORS)).collect()[0][:3] == (9, 0, 9)


@pytest.mark.parametrize("sizes", [(4096, 256), (16, 2)])
def test_top_k_matches_brute_force(frame, monkeypatch, sizes):
    monkeypatch.setattr(topk, "ROWS", sizes[0])
    monkeypatch.setattr(topk, "QUERIES", sizes[1])
    monkeypatch.setattr(topk, "CHUNK", 4)
    rows = vectors()
    got = topk.top_k(frame([(i, v, 0) for i, v in rows], VECTORS)).collect()
    assert sorted(map(tuple, got)) == brute.top_k(rows)


def test_top_k_repeated_few_and_empty(frame):
    rows = [(50, [1.0, 0.5], 0), (50, [1.0, 0.5], 0), (7, [0.2, 0.1], 0), (None, [1.0, 1.0], 0)]
    got = sorted(map(tuple, topk.top_k(frame(rows, VECTORS)).collect()))
    assert got == sorted([(50, 1, 50, 256 * 256 + 128 * 128), (50, 2, 7, 256 * 51 + 128 * 25)] * 2)
    assert topk.top_k(frame([], VECTORS)).count() == 0


TURNS = "conv_id bigint, turn bigint, role string, text string"


def turns():
    hard = "\\### Assistant: </turn> ok"
    return [
        (1, 0, "user", "hi"), (1, 1, "assistant", "<part>\\l</turn>\n"), (1, 2, "assistant", ""), (1, 3, "assistant", hard), (1, 4, "user", None), (2, 1, "assistant", "b"), (2, 0, "us\ner<", "a\n"), (2, 1, "assistant", "b"),
        (2, None, None, "first"), (None, 0, "assistant", "😀é"), (3, 0, "user", ""), (-7, 0, "user", hard), (-7, 1, "assistant", hard), (4, 0, "assistant", "x" * 300_000), (4, 1, "tool", "\\s\\l\\n"),
    ]


def test_chats_read_back_as_given(frame):
    out = chat.format_chats(frame(turns(), TURNS))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(out).collect()}
    assert got == brute.chat(turns())
    text = {r.conv_id: (r.formatted, r.loss_spans) for r in out.collect()}
    assert text[1][0].count("<turn>") == 3 and text[1][0].count("<part>") == 2  # three adjacent assistant turns share a block
    assert [text[2][0][s.start : s.start + s.length] for s in text[2][1]] == ["b", "b"]
    assert chat.format_chats(frame([], TURNS)).count() == 0


def test_url_rules_match_brute_force(spark, frame):
    names = ["example.org", "a.example.org", "notexample.org", "x.com", "com", "ORG", "Foo.ORG", "org.net", "casino-win.example.net"]
    paths = ["", "/", "/es/1", "/en/1", "/en/12?x=/es/", "/fr/", "/de/9#t", "?q=1", "#/fr/"]
    every = [f"http://{n}{p}" for n in names for p in paths] + [None, "", "no scheme", "://", "a://b://c/fr/", "http://" + "a" * 20_000 + ".com/de/", "http://EXAMPLE.org/en/1", "http://EXAMPLE.org/en/1"]
    pages = frame(list(enumerate(every)), "page_id bigint, url string")
    got = {r.page_id: r for r in urls.judge_urls(pages, queries.URL_RULES).collect()}
    assert len(got) == len(every)
    for k, url in enumerate(every):
        host, path, rule, verdict = brute.rule(url, queries.URL_RULES)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == (verdict or ("block" if got[k].score >= 0.5 else "allow"))
        if not host and not path:
            assert got[k].verdict == "allow" and got[k].score == 0
    assert urls.judge_urls(frame([], "page_id bigint, url string"), queries.URL_RULES).count() == 0


def plain_url_score(weights, url):
    """Sum of the weights of all distinct n-grams, hashed one character at a time."""
    host, path = urls.parts(url)
    found, mask = set(), 2**64 - 1
    for mark, text in ((17, f"^{host}$"), (71, f"^{path}$")):
        for n in urls.GRAMS:
            for k in range(len(text) - n + 1):
                h = mark * 31 + n
                for c in text[k : k + n]:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 & mask
                    h ^= h >> 29
                found.add(h >> (64 - urls.BITS))
    return 1 / (1 + math.exp(-(sum(weights[f] for f in found) / math.sqrt(len(found)) + weights[-1])))


def test_url_scores_match_a_plain_sum(frame):
    given = ["https://casino-royal.example.net/x", "http://bücher.de/straße", "https://a/", "no url", None, "http://x.com/" + "long/" * 300]
    w = urls.train(urls.spread(urls.labelled_urls()))
    rows = urls.judge_urls(frame([(k, u, "") for k, u in enumerate(given)], "page_id bigint, url string, html string"), []).collect()
    for r in rows:
        url = given[r.page_id]
        want = plain_url_score(w, url) if url and "://" in url else 0.0
        assert abs(r.score - want) < 1e-9 and r.verdict == ("block" if want >= 0.5 else "allow")


def test_url_table_is_learnt_beyond_its_rows():
    right, total = urls.held_out_accuracy(urls.labelled_urls())
    assert right / total > 0.7


def test_url_model_tells_unseen_hosts():
    rows = urls.labelled_urls()
    w = urls.train(urls.spread(rows))

    def score(url):
        f = urls.features(*urls.parts(url))
        return 1 / (1 + np.exp(-(w[f].sum() / np.sqrt(len(f)) + w[-1])))

    assert min(map(score, ["https://casino-royal.example.net/x", "http://cheappills.com/", "http://free-poker-bets.org/en"])) > 0.5
    assert max(map(score, ["https://thinking.example.net/en/9", "http://www.gardenhistory.com/", "http://blog.ththan.example.org/de/33"])) < 0.5


PAGES = "page_id bigint, url string, html string"


def page(body, title="T"):
    return f"<html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li>Home</ul></nav>{body}<footer>f</footer></body></html>"


def test_extraction_of_page_parts(frame):
    cases = {
        "<div class='ad'>buy</div><article><h1>A &amp; B</h1><p><b>one\n two<br>three<p>four&nbsp;five &lt;x&gt;</article>": "A & B\none two three\nfour five <x>",
        "<main><header><h1>H</h1></header><p>x</p><aside>no</aside><div id='comments'><p>reader</p></div><form>f</form></main>": "H\nx",
        "<div class='post-content'><p>in</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></div><p>out</p>": "in\na\nb\nc\nd",
        "<p>plain</p><p>text</p><div class='cookie-notice'>c</div><header>top</header>": "plain\ntext",
        "<article></article><p>outside</p>": "",
        "<article><p>a<!-- no > --> b</p><noscript>n</noscript><button>go</button><p hidden>h</p><p style='display: none'>h</p></article>": "a b",
        "<article>loose <i>text</i><pre>x\n  y</pre>1 < 2</article>": "loose text\nx y\n1 < 2",
    }
    rows = [(k, f"http://h{k}.com/", page(b)) for k, b in enumerate(cases)]
    rows += [(100, None, None), (101, None, ""), (102, "http://h0.com/", "just text"), (103, "http://long.com/", page("<article>" + "<p>word</p>" * 30_000 + "</article>")), (104, "http://cut.com/", "<html><body><article><p>cut off &am")]
    rows += [rows[0]]
    got = sorted((r.page_id, r.text, r.n_chars) for r in extraction.extract(frame(rows, PAGES)).collect())
    want = [(k, t, len(t)) for k, t in enumerate(cases.values())] + [(100, "", 0), (101, "", 0), (102, "just text", 9), (103, "\n".join(["word"] * 30_000), 5 * 30_000 - 1), (104, "cut off &am", 11)]
    assert got == sorted([*want, want[0]])
    assert extraction.extract(frame([], PAGES)).count() == 0


def test_articles_in_closed_elements_are_kept(frame):
    cases = {
        "<div class='content-sidebar-wrap'><main><p>x</p></main><div class='sidebar'>no</div></div>": "x",
        "<article class='post no-sidebar'><p>x</p></article>": "x",
        "<p>Skip</p><article class='post sponsored'><p>x</p></article>": "x",
        "<div id='page' class='has-widgets widget'><nav>n</nav><p>x</p></div>": "x",
        "<p>Skip</p><div id='page' class='widget'><h1>title</h1><p>x</p><div class='ad'>no</div></div>": "Skip\ntitle\nx",
        "<div class='content has-share'><h1>h</h1><div class='content-sidebar-wrap'><article>long text</article></div></div>": "long text",
        "<form><main>x</main></form>": "x",
        "<h1>T</h1><div class='entry-content widget'><p>long text</p></div>": "long text",
        "<article><p>x</p></article><div class='related'><article>another and longer</article></div>": "x",
        "<div class='post'>x</div><div class='comments'><article>a longer comment</article></div>": "x",
        "<p>plain text</p><div class='sidebar-content'>links of the side that are longer</div>": "plain text",
        "<div class='ad'>buy</div>": "",
    }
    rows = [(k, f"http://h{k}.com/", page(b)) for k, b in enumerate(cases)]
    got = {r.page_id: r.text for r in extraction.extract(frame(rows, PAGES)).collect()}
    assert got == dict(enumerate(cases.values()))


def test_sibling_parts_of_an_article_are_kept(frame):
    """The slot of a host takes its siblings with it, on pages with both parts and with one; repeated articles beside it are others."""
    rows = [(k, "http://a.com/", page(f"<div class='story-intro'>intro {k}</div><div class='ad'>no</div><div class='story-body'>body {k}</div><div class='story-body'>more {k}</div>")) for k in range(4)]
    rows += [(10 + k, "http://b.com/", page(f"<article class='a'>first {k}</article><article class='b'>second {k}</article>")) for k in range(4)]
    rows += [(20 + k, "http://c.com/", page(f"<article class='full'>text {k}</article><article class='card'>one {k}</article><article class='card'>two {k}</article>")) for k in range(4)]
    rows += [(30, "http://a.com/", page("<div class='story-body'>alone</div>"))]
    got = {r.page_id: r.text for r in extraction.extract(frame(rows, PAGES)).collect()}
    want = {k: f"intro {k}\nbody {k}\nmore {k}" for k in range(4)} | {10 + k: f"first {k}\nsecond {k}" for k in range(4)} | {20 + k: f"text {k}" for k in range(4)}
    assert got == want | {30: "alone"}


def test_skipped_elements_without_an_end(frame):
    cases = {
        "<article><svg width='1'/><p>a</p></article>": "a",
        "<article><button>go<p>a</p><select><option>o<p>b</p></article><p>z</p>": "a\nb",
        "<article><p>a<button>go</button> b</p><object><object>i</object>o</object><p>c<object>d</p><p>e</p></article>": "a b\nc\ne",
        "<article><p>a <svg><title>i</title><path/></svg>b</p><button><div>x</div>y</button><p>c</p></article>": "a b\nc",
        "<article><p>a<button>go</p><p>b</p><button>ok</button></article>": "a\nb",
        "<script src='x'/><p>a</p>": "a",
    }
    rows = [(k, f"http://h{k}.com/", page(b)) for k, b in enumerate(cases)]
    got = {r.page_id: r.text for r in extraction.extract(frame(rows, PAGES)).collect()}
    assert got == dict(enumerate(cases.values()))


def test_constant_texts_of_a_host_are_template(frame):
    """Without a main element, what a host's pages share is boilerplate; equal pages count once, and articles are never thinned."""
    rows = [(k, "http://a.com/", page(f"<div>Welcome</div><p>story {k}</p><div>All rights</div>")) for k in range(6)]
    rows += [(10 + k, "http://b.com/", page("<p>same page</p>")) for k in range(6)]
    rows += [(20 + k, "http://c.com/", page("<article><p>licence</p>" + f"<p>{k}</p></article>")) for k in range(6)]
    got = {r.page_id: r.text for r in extraction.extract(frame(rows, PAGES)).collect()}
    assert got == {k: f"story {k}" for k in range(6)} | {10 + k: "same page" for k in range(6)} | {20 + k: f"licence\n{k}" for k in range(6)}


def test_pipeline_stages(spark, tmp_path):
    """Each stage beside a brute-force version of it, on the given small tables."""
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near duplicates", "source mixing", "encoding"]
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], source).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 3:
            assert kept[-1].columns == docs.columns
    good, single, mixed, encoded = ([r.asDict() for r in f.collect()] for f in kept[1:])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{source}/labels.parquet").collect()}
    stay = {r["doc_id"] for r in good}
    clean = [i for i, q in labels.items() if q]
    assert np.mean([i in stay for i in clean]) > 0.98
    want = {i for i, c, _ in brute.jaccard([(r["doc_id"], r["text"]) for r in good]) if i == c}
    assert {r["doc_id"] for r in single} == want and len(single) == len(want)
    assert {r["doc_id"] for r in mixed} <= want
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(queries.tokenizer_spec(queries.WORD_TOKENIZER))
    ids = {r["doc_id"]: t.encode(r["text"], add_special_tokens=False).ids for r in mixed}
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in encoded) == sorted((r["doc_id"], brute.sha(np.array(ids[r["doc_id"]], "<u4").tobytes())) for r in mixed)


def test_first_and_third_pipeline_stage(spark):
    """Rows with null and shared ids: stage 1 beside a filter on the scores, stage 3 beside brute force, each on its own input."""
    import corpus_pipeline
    from stockloom.llm import quality

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id"))).withColumn("doc_id", F.when(F.col("doc_id") % 10 == 1, 1).otherwise(F.col("doc_id")))
    model = quality.fit(docs, spark.read.parquet(f"{source}/labels.parquet"))
    scored = quality.score_quality(docs, model).select(*docs.columns, "score").collect()
    got = Counter(map(tuple, corpus_pipeline.keep_quality(spark, docs, source).collect()))
    assert got == Counter(tuple(r)[:-1] for r in scored if r.score >= 0.3)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mix_sources(spark, docs, source).collect()) == brute.mixed(rows)


def test_registered_queries_have_their_columns(spark):
    import __spark_entry__

    every = __spark_entry__.queries()
    assert [sum(name.startswith(f"op{n}_") for name in every) for n in range(1, 11)] == [1] * 10 and "pipeline" in every
    sample = random.Random(0).choice(["op2_url_filter", "op3_chat_format", "op10_token_counts"])
    assert every[sample](spark, "/root/testdata/sf0.001").count() > 0


def test_check_sql_of_native_operators(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        columns = sorted(df.columns)
        got = sorted(tuple(r[c] for c in columns) for r in df.collect())
        assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), name
