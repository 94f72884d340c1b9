"""Main text of web pages by equivalence classes of template tokens.

Over the different pages of one host, every element path and every text at its path is a token with an occurrence vector: how often it stands
on each page. Tokens of equal vectors form a class. A class is valid if it has at least ``CLASS_TOKENS`` tokens on ``CLASS_PAGES`` pages and
its tokens stand in one order on all of them. The class on most pages that stands once on each is the root of the host's template; another
valid class is nested where all its tokens stand in one and the same gap of the root on every page. The tokens of the root and of nested
classes are the template: texts among them are boilerplate, and of the gaps that remain, the slots, names of elements only choose the one
that holds the article. A host with too few pages has no classes; names alone decide there, as they do inside a page.
"""

from __future__ import annotations

import html
import re
from array import array
from bisect import bisect_left

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import map_rows, stored
from stockloom.llm.urls import split_url

_ATTRIBUTES = r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:script|style)(?:/|\s{_ATTRIBUTES}(?<=[\s\"']/))>|<(script|style)(?=[\s/>]).*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-z][a-z0-9:-]*)({_ATTRIBUTES})>|</?[a-z][^>]*>|<[!?][^>]*>|([^<]+|<)", re.I | re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)
_WORDS = re.compile("[a-z0-9]+")

# fixed values: HTML's block elements, and names of page parts
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSED_TAGS = frozenset("head nav footer aside form menu dialog search fieldset dir".split())
CLOSED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSED_WORDS = frozenset(
    "nav navbar navigation menu sidebar aside footer ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices alert popup "
    "modal newsletter subscribe subscription share sharing social related recommended recommendations breadcrumb breadcrumbs comment comments commentlist reply replies respond disqus toolbar pagination "
    "pager copyright widget widgets login signup".split()
)
OUTER_WORDS = frozenset("header masthead banner topbar".split())  # closed outside a main element only: an article may have its own header
MAIN_WORDS = frozenset("article content main post entry story".split())
STATE_WORDS = frozenset("no has with without is open closed enabled disabled".split())  # 'no-sidebar' and 'comments-open' say how a page is, not what an element is
WRAP_WORDS = frozenset("page site wrap wrapper container layout root app".split())
OTHERS_WORDS = frozenset("comment comments commentlist reply replies respond disqus related recommended recommendations".split())  # what holds other articles
SKIPPED = frozenset("noscript template svg iframe textarea select button title object canvas".split())  # no text of theirs counts
_SKIPPED_TAG = re.compile(f"<(?:{'|'.join(sorted(SKIPPED))})" + r"(?=[\s/>])", re.I)
CLASS_TOKENS, CLASS_PAGES = 2, 3
HOLDER_WORDS = frozenset("list lists links link buttons button icons bar block area wrap wrapper container section posts post articles stories items item form inner slot unit banner".split())  # kinds of holders, no subject
FREE, LAYOUT, FIRM, HIDDEN = range(4)  # closed not at all, by names or as a form, by tag, role or names of what holds other articles, hidden


def _ended(page: str) -> set[int]:
    """Where the skipped elements begin that have an end tag of their own."""
    ended: set[int] = set()
    if _SKIPPED_TAG.search(page):
        began: dict[str, list[int]] = {}
        for m in _TOKEN.finditer(page):
            if m[3] is not None and (tag := m[3].lower()) in SKIPPED:
                if not m[2]:
                    began.setdefault(tag, []).append(m.start())
                elif began.get(tag):
                    ended.add(began[tag].pop())
    return ended


class _Element:
    __slots__ = ("above", "tag", "path", "closing", "outer", "rank", "only", "wraps", "named", "title", "size", "closed", "main", "doubt")

    def __init__(self, above: _Element | None, tag: str, path: str, closing: int, outer: bool, rank: int, only: bool, wraps: bool, named: bool):
        self.above, self.tag, self.path, self.closing, self.outer, self.rank, self.only = above, tag, path, closing, outer, rank, only
        self.wraps, self.named = wraps, named
        self.title, self.size, self.closed, self.main = tag == "h1", 0, False, ("body", 1)
        self.doubt = above is not None and above.doubt  # inside an article, with a closing word beside a subject of its own


def _says_only_closed(words: list[str]) -> bool:
    """A name of closing words and kinds of holders only, as 'related-posts' is and 'related-work' is not."""
    closing = [w for w in words if w in CLOSED_WORDS]
    return bool(closing) and all(w in CLOSED_WORDS or w in HOLDER_WORDS or w in STATE_WORDS or w.isdigit() for w in words)


def _line(e: _Element | None):
    while e is not None:
        yield e
        e = e.above


def _settle(elements: list[_Element]) -> None:
    """Which elements are closed, and the main element of each, from the closings that stand."""
    for e in elements:
        above = e.above
        closed, main = (above.closed, above.main) if above is not None else (False, ("body", 1))
        if not closed:
            closed = e.closing != FREE or (e.outer and main[1] == 1)
            if not closed and e.rank > main[1]:
                main = (e.path, e.rank)
        e.closed, e.main = closed, main


def _open(elements: list[_Element], blocks: list[tuple[_Element | None, str]]) -> None:
    """Lift closings of elements that are or contain the page's article.

    ``main`` is one by its meaning and always opens. If no open article or main has text, the longest closed article does, with its siblings, when it
    is longer than what is open; below an element for other articles, and in a menu or footer, only when nothing else has text. If there is no
    open main element at all, an element with the page's title or a name for an article opens when longer than what is open, and a page wrapper
    when nothing is.
    """

    def lift(e: _Element) -> None:
        for x in _line(e):
            if x.closing != HIDDEN:
                x.closing, x.outer = FREE, False

    def shown(e: _Element) -> bool:
        return all(x.closing != HIDDEN for x in _line(e))

    _settle(elements)
    if not any(e.closed and (e.rank > 1 or e.title or e.wraps) for e in elements):
        return
    for e, value in blocks:
        for x in _line(e):
            x.size += len(value)
    for e in elements:
        if e.title:
            for x in _line(e):
                x.title = True
    only = [e for e in elements if e.only and e.closed and e.size and shown(e)]
    for e in only:
        lift(e)
    if only:
        _settle(elements)

    def text_of(rank: int) -> int:
        return sum(len(v) for e, v in blocks if (not e.closed and e.main[1] >= rank if e is not None else rank == 1))

    if not text_of(3):
        found = [e for e in elements if e.rank == 3 and e.closed and e.size and shown(e) and not any(x.rank == 3 for x in _line(e.above))]
        loose = [e for e in found if e.title or all(x.closing != FIRM for x in _line(e))]
        best = max(loose, key=lambda e: e.size, default=None)
        if best is not None and best.size <= (text_of(2) or (text_of(1) if best.above is not None and best.above.closed else 0)):
            best = None
        if best is None and found and not text_of(1):
            best = max(found, key=lambda e: e.size)
        if best is not None:
            for e in found:
                if e.above is best.above and (e is best or e.closing != FIRM):
                    lift(e)
            _settle(elements)
    while not any(e.rank > 1 and not e.closed for e in elements):
        free = text_of(1)
        found = [e for e in elements if e.closed and (e.closing == LAYOUT or e.outer) and e.size and not (e.above is not None and e.above.closed)]
        found = [e for e in found if (e.size > free if e.title or e.named else (e.wraps or e.rank > 1) and not free)]
        if not found:
            break
        lift(max(found, key=lambda e: e.size))
        _settle(elements)


def parse(page: str) -> tuple[list[tuple[str, int, str, str, bool, int]], dict[str, list[int]]]:
    """(blocks, element paths with [count, first place]). A block is (path of its main element or body, rank of that, its own path, text, doubt, place), in page order.

    Ranks: 3 for article and main, 2 for elements named so by class, id or role, 1 for the body. Closed elements give no blocks, but none that is
    or contains the article stays closed. An element of rank 2 or 3 also gives a block without text, so that an empty article is known to be
    there. Inside an article an element closes by its name only if the name has no subject of its own ('share-buttons'); others are in doubt
    ('share-price') and go only if the host's template holds their text. A skipped element (button, svg and so on) that is written as empty ends at once; one without an end tag ends at the next block.
    """
    found: list[tuple[_Element | None, str]] = []
    where: list[int] = []  # of each entry of found, in page order with the elements: twice the place of the tag that ends it
    place = 0
    elements: list[_Element] = []
    paths: dict[str, list[int]] = {}
    stack: list[_Element] = []
    text: list[str] = []
    skip: list[str] = []  # tags from a skipped element on
    ended, whole = _ended(page), True

    def flush() -> None:
        if text:
            value = " ".join("".join(text).split())
            text.clear()
            if value:
                found.append((stack[-1] if stack else None, value))
                where.append(2 * place)

    def pop(tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    for m in _TOKEN.finditer(page):
        place = m.start()
        if m[5] is not None:
            if not skip:
                text.append(html.unescape(m[5]))
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in SKIPPED:
            if m[2]:
                if tag in skip:
                    del skip[len(skip) - 1 - skip[::-1].index(tag) :]
            elif not m[4].endswith("/"):
                if not skip:
                    whole = m.start() in ended
                if m.start() in ended or not skip:
                    skip.append(tag)
            continue
        if tag == "br" and not skip:
            text.append(" ")
        if tag not in BLOCKS:
            continue
        if skip:
            if m[2] and tag in skip:
                del skip[len(skip) - 1 - skip[::-1].index(tag) :]
                continue
            if whole and not (m[2] and any(s.tag == tag for s in stack)):
                if not m[2] and tag != "hr":
                    skip.append(tag)
                continue
            skip.clear()
        if m[2]:
            if any(s.tag == tag for s in stack):
                flush()
                while stack.pop().tag != tag:
                    pass
            continue
        flush()
        if tag == "hr":
            continue
        pop(("p",), ("td", "th", "li", "div", "article", "section", "main"))
        if tag == "body":
            pop(("head",), ())
        elif tag == "li":
            pop(("li",), ("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            pop(("dt", "dd"), ("dl",))
        elif tag in ("td", "th"):
            pop(("td", "th"), ("tr", "table"))
        elif tag == "tr":
            pop(("tr",), ("table",))
        above = stack[-1] if stack else None
        names, closing_names, parts, role, hidden = [], [], [], "", False
        if m[4].strip():
            for a in _ATTRIBUTE.finditer(m[4]):
                key, value = (a[1] or "hidden").lower(), (a[2] or a[3] or a[4] or "").lower()
                if key in ("class", "id"):
                    words = _WORDS.findall(value)
                    names += words
                    if CLOSED_WORDS.isdisjoint(words) and OUTER_WORDS.isdisjoint(words):
                        parts.append(words)
                        continue
                    for name in value.split():
                        words = _WORDS.findall(name)
                        parts.append(words)
                        if STATE_WORDS.isdisjoint(words):
                            closing_names += words
                elif key == "role":
                    role = value.strip()
                elif key == "hidden" or "display:none" in value.replace(" ", ""):
                    hidden = True
        label = tag + "".join("." + n for n in sorted(set(names)) if not n.isdigit())
        path = f"{above.path}>{label}" if above is not None else label
        paths.setdefault(path, [0, 2 * place + 1])[0] += 1
        page_level = tag in ("html", "body")
        closing, outer = FREE, False
        if hidden:
            closing = HIDDEN
        elif (tag in CLOSED_TAGS and tag != "form") or role in CLOSED_ROLES or (not page_level and not OTHERS_WORDS.isdisjoint(closing_names)):
            closing = FIRM
        elif tag == "form" or (not page_level and not CLOSED_WORDS.isdisjoint(closing_names)):
            closing = LAYOUT
        elif tag == "header" or (not page_level and not OUTER_WORDS.isdisjoint(closing_names)):
            outer = True
        only = tag == "main" or role == "main"
        rank = 3 if only or tag == "article" or role == "article" else 2 if tag in ("div", "section", "td") and not MAIN_WORDS.isdisjoint(names) else 1
        wraps, named = not WRAP_WORDS.isdisjoint(names), False
        if closing == LAYOUT and (wraps or rank == 2):  # a name of its own says article or wrapper, or one says both
            named = (wraps and rank == 2) or any(not (MAIN_WORDS | WRAP_WORDS).isdisjoint(w) and CLOSED_WORDS.isdisjoint(w) for w in parts)
        doubt = False
        if (closing == LAYOUT and tag != "form" or closing == FIRM and tag not in CLOSED_TAGS and role not in CLOSED_ROLES) and any(x.rank == 3 for x in _line(above)):
            doubt = not any(_says_only_closed(w) for w in parts)
            closing = FREE if doubt else closing
        e = _Element(above, tag, path, closing, outer, rank, only, wraps, named)
        e.doubt = e.doubt or doubt
        elements.append(e)
        if rank > 1:
            flush()
            found.append((e, ""))
            where.append(2 * place + 1)
        stack.append(e)
    place = len(page)
    flush()
    _open(elements, found)
    blocks: list[tuple[str, int, str, str, bool, int]] = []
    for (e, value), at in zip(found, where, strict=True):
        if e is None:
            blocks.append(("body", 1, "body", value, False, at))
        elif not e.closed and (value or e.main[0] == e.path):
            blocks.append((*e.main, e.path, value, e.doubt, at))
    return blocks, paths


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "(^|>)[^>]*$", "")


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def _tokens(page: str, blocks: list, paths: dict) -> list[dict]:
    """The page's template tokens: element paths, and texts outside articles or in doubt; with count, place, and the path of main elements."""
    ranks = {b[0]: b[1] for b in blocks if not b[3]}
    out = [{"token": _number(p), "n": n, "at": at, "path": p if p in ranks else None, "rank": ranks.get(p, 0)} for p, (n, at) in paths.items()]
    texts: dict[str, list[int]] = {}
    for _, rank, path, value, doubt, at in blocks:
        if value and (rank == 1 or doubt):
            texts.setdefault(f"{path}\0{value}", [0, at])[0] += 1
    return out + [{"token": _number(t), "n": n, "at": at, "path": None, "rank": -1} for t, (n, at) in texts.items()]


def _page_orders(columns: list[list]) -> list[list]:
    """(host, class, hash of the class's tokens in page order) of each class of each page."""
    hosts, classes, orders = [], [], []
    for host, held in zip(*columns, strict=True):
        by: dict[int, list[int]] = {}
        for x in sorted(held, key=lambda x: (x["at"], x["token"])):
            by.setdefault(x["class"], []).append(x["token"])
        for name, tokens in by.items():
            hosts.append(host)
            classes.append(name)
            orders.append(xxhash.xxh3_64_intdigest(array("q", tokens).tobytes()) - 2**63)
    return [hosts, classes, orders]


def _page_gaps(columns: list[list]) -> list[list]:
    """(host, class, first and last gap of the root in which its tokens stand) of each class but the root, of each page that holds the root."""
    out: list[list] = [[], [], [], []]
    for host, held, root in zip(*columns, strict=True):
        frame = sorted(x["at"] for x in held if x["class"] == root)
        spans: dict[int, tuple[int, int]] = {}
        for x in held:
            if frame and x["class"] != root:
                low, high = spans.get(x["class"], (x["at"], x["at"]))
                spans[x["class"]] = min(low, x["at"]), max(high, x["at"])
        for name, (low, high) in spans.items():
            for column, value in zip(out, (host, name, bisect_left(frame, low), bisect_left(frame, high)), strict=True):
                column.append(value)
    return out


def templates(parsed: DataFrame) -> DataFrame:
    """Per host its template: ``slot`` (the path of the article's element) and ``constants`` (tokens of boilerplate texts).

    ``parsed`` has uid, host, print (a hash of the page) and tokens. Equal pages of a host count once. A vector is compared by an order-free hash
    of (page, count) pairs, summed within tasks before it is shuffled, so no group holds more than counts. Only tokens that can be in a class are
    gathered again, a page at a time: a row holds one page's tokens, and the tests of order and nesting read it without further shuffles of tokens.
    """
    copies = parsed.groupBy("host", "print").agg(F.min("uid").alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    once = parsed.join(copies, ["host", "print"], "left").filter("first IS NULL OR uid = first").select("host", "print", F.explode("tokens").alias("t")).select("host", "print", "t.*")
    vector = F.xxhash64(F.sum(F.xxhash64("print", "n").cast("decimal(38,0)")))
    vectors = once.groupBy("host", "token").agg(vector.alias("class"), F.count("*").alias("pages"), F.max("n").alias("most"), F.max("path").alias("path"), F.max("rank").alias("rank")).filter(F.col("pages") >= CLASS_PAGES)
    sizes = vectors.groupBy("host", "class").agg(F.count("*").alias("size")).filter(F.col("size") >= CLASS_TOKENS)
    classes = stored(vectors.join(sizes, ["host", "class"]), "token-classes")

    # the tokens of classes of each page
    placed = once.select("host", "print", "token", "at").join(classes.select("host", "token", "class"), ["host", "token"])
    by_page = stored(placed.groupBy("host", "print").agg(F.collect_list(F.struct("class", "at", "token")).alias("held")), "page-classes")

    # valid: one order on every page
    orders = map_rows(by_page.select("host", "held"), "host string, class bigint, order bigint", _page_orders, 1_000_000)
    one_order = orders.groupBy("host", "class").agg(F.min("order").alias("a"), F.max("order").alias("b")).filter("a = b").select("host", "class")
    counts = classes.groupBy("host", "class").agg(F.max("most").alias("most"), F.max("pages").alias("pages"))
    valid = stored(counts.join(one_order, ["host", "class"]), "valid-classes")
    root = valid.filter("most = 1").groupBy("host").agg(F.max(F.struct("pages", "class")).getField("class").alias("root"))

    # nested: one gap of the root for all tokens on all pages
    gaps = map_rows(by_page.select("host", "held").join(root, "host"), "host string, class bigint, low int, high int", _page_gaps, 1_000_000)
    spans = gaps.groupBy("host", "class").agg(F.min("low").alias("a"), F.max("low").alias("b"), F.min("high").alias("c"), F.max("high").alias("d"))
    nested = spans.filter("a = b AND c = d AND a = c").join(valid.select("host", "class"), ["host", "class"])
    template = root.select("host", F.col("root").alias("class")).union(nested.select("host", "class"))
    held = classes.join(template, ["host", "class"])
    slot = F.max(F.when(F.col("path").isNotNull() & (F.col("most") == 1), F.struct("rank", "pages", (-F.length("path")).alias("short"), "path")))
    return held.groupBy("host").agg(slot.getField("path").alias("slot"), F.collect_list(F.when(F.col("rank") == -1, F.col("token"))).alias("constants"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, ``text`` (blocks joined by a line break) and ``n_chars`` (its code points).

    White space inside a block becomes one space. A slot takes its siblings of the same rank with it. A page that lacks its host's article slot gives the blocks of its own best main element,
    or of its body. Null and empty pages give an empty text, as does an empty article. Null urls share one host. Repeated rows are extracted
    each; equal pages of a host count once in its template, so copies do not turn into boilerplate. Very long pages are read whole. Other
    columns are not read; empty tables give empty results. Templates are joined by host; a host with most pages is split by adaptive execution.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host", split_url(F.col("url"))[0])

    def blocks(columns):
        out, tokens, prints = [], [], []
        for page in columns[3]:
            found, paths = parse(page)
            out.append([{"main": main, "rank": rank, "token": _number(f"{path}\0{value}") if rank == 1 or doubt else None, "text": value} for main, rank, path, value, doubt, _ in found])
            tokens.append(_tokens(page, found, paths))
            prints.append(xxhash.xxh3_64_intdigest(page) - 2**63)
        return [*columns[:3], out, tokens, prints]

    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, url string, host string, blocks array<struct<main:string,rank:int,token:bigint,text:string>>, tokens array<struct<token:bigint,n:int,at:int,path:string,rank:int>>, print bigint"
    parsed = stored(map_rows(rows.select("id", "url", "host", "html"), schema, blocks, 1_000_000).withColumn("uid", F.monotonically_increasing_id()), "parsed-pages")  # parsed once, read for the templates and for the texts
    # stored, so that its size is known and neither side of the join hangs on an aggregate: a host with most pages can be split
    joined = parsed.drop("tokens", "print", "uid").join(stored(templates(parsed), "templates"), "host", "left")
    # the slot and its siblings of the same rank on this page; articles repeated under one path are other articles
    slots = F.filter("blocks", lambda b: F.coalesce((b["text"] == "") & (_parent(b["main"]) == _parent(F.col("slot"))), F.lit(False)))
    rank = F.array_max(F.transform(F.filter("blocks", lambda b: F.coalesce(b["main"] == F.col("slot"), F.lit(False))), lambda b: b["rank"]))
    joined = joined.withColumns({"slots": F.transform(slots, lambda b: b["main"]), "slot_rank": rank})
    once = F.filter(F.array_distinct("slots"), lambda p: (p == F.col("slot")) | (F.col("slot_rank") == 2) | (F.size(F.filter("slots", lambda q: q == p)) == 1))
    joined = joined.withColumn("slots", F.when(F.col("slot_rank").isNotNull(), once).otherwise(F.array().cast("array<string>")))
    inside = F.filter("blocks", lambda b: F.array_contains("slots", b["main"]) & (b["rank"] == F.col("slot_rank")))
    top = F.array_max(F.transform("blocks", lambda b: b["rank"]))
    chosen = F.when(F.size(inside) > 0, inside).otherwise(F.filter("blocks", lambda b: b["rank"] == top))
    kept = F.filter(chosen, lambda b: (b["text"] != "") & ~F.coalesce(F.array_contains(F.coalesce("constants", F.array().cast("array<bigint>")), b["token"]), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
