"""Main text of web pages: the maximum-scoring subsequence of a page's words and tags."""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table, text_of

# Element names by what they do to a page's text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
SKIP = {"nav", "header", "footer", "aside", "form", "noscript", "template", "button", "select", "dialog", "svg", "math", "canvas", "object", "audio", "video", "menu", "head", "label", "input", "fieldset", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"} | SKIP
# Words of class, id and role that mark a part of a page as not its article.
BOILER = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "consent", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+")
MAIN = {"article", "main"}

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HEAD_PARTS = {"head", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
OPENERS = HEADINGS | MAIN | {"p", "section", "div", "table", "blockquote", "pre"}  # what an unclosed part cannot hold
NOT_OWN = re.compile(r"(?:has|with|without|no|is)[-_]", re.I)  # class names that speak of other parts

# Scores before any labelled page is seen: words by place, and the price of a tag.
DEFAULT = {"in": 2.0, "block": 1.0, "list": 0.4, "link": -1.5, "boiler": -1.5, "none": 0.0, "tag": -0.2}


def boilerplate(name: str, attrs: str) -> bool:
    """Whether an element's name, class, id or role marks it as no part of an article."""
    if attrs.strip() and HIDDEN.search(attrs):
        return True
    if name in SKIP:
        return True
    if name in ("body", "html", "main") or not attrs.strip():
        return False
    marks = [v for m in NAMES.finditer(attrs) for v in m[1].strip("\"'").split() if not NOT_OWN.match(v)]
    return any(w.lower() in BOILER for v in marks for w in SPLIT.split(v) if w)


def parse(page: str) -> tuple[list[tuple], dict[int, int]]:
    """(start, end, name, closing, attributes) of every tag, with "" as the name of what holds no
    text (comments, scripts), and the number of each opening tag's closing tag."""
    tags, closed, pos = [], {}, 0
    open_: dict[str, list[int]] = {}
    while m := MARK.search(page, pos):
        name, closing, pos = (m[2] or "").lower(), bool(m[1]), m.end()
        if name in RAW and not closing:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            name, pos = "", end.end() if end else len(page)
        elif name and name not in VOID:
            if not closing:
                open_.setdefault(name, []).append(len(tags))
            elif open_.get(name):
                closed[open_[name].pop()] = len(tags)
        tags.append((m.start(), pos, name, closing, m[3] or ""))
    return tags, closed


def part_end(tags: list[tuple], closed: dict[int, int], i: int) -> int:
    """The number of the tag that ends the part which tag ``i`` opens: its own closing tag; for a
    paragraph also the next block; for an open head the first tag that no head holds; for any
    other unclosed part the next tag that opens a block of text."""
    name, last = tags[i][2], closed.get(i, len(tags))
    if name == "p":
        return next((j for j in range(i + 1, last) if tags[j][2] in BLOCK), last)
    if i in closed:
        return last
    if name == "head":
        return next((j for j in range(i + 1, last) if tags[j][2] and tags[j][2] not in HEAD_PARTS), last)
    return next((j for j in range(i + 1, last) if tags[j][2] in OPENERS and not tags[j][3]), last)


def stream(page: str) -> list[tuple[str, str]]:
    """(kind, value) of a page in order: kind "tag" or the place of a text. Text in parts that are
    marked as boilerplate has the kind "boiler", within a marked article "none". What holds the
    page's first article that is not marked so itself is no boilerplate, and headings in an
    article's header belong to it."""
    tags, closed = parse(page)
    first = next((i for i, t in enumerate(tags) if t[2] in MAIN and not t[3] and not boilerplate(t[2], t[4])), -1)
    out, text, pos = [], [], 0
    main = lists = links = 0
    until, heading, titled = -1, 0, False  # the boilerplate part ends at tag ``until``

    def flush():
        if text:
            apart = until >= 0 and not (titled and heading)
            place = ("none" if main else "boiler") if apart else "in" if main else "link" if links else "list" if lists else "block"
            out.append((place, html.unescape("".join(text))))
            text.clear()

    for i, (start, end, name, closing, attrs) in enumerate(tags):
        if start > pos:
            text.append(page[pos:start])
        pos = end
        if not name:
            continue
        if i == until:
            flush()
            until, titled = -1, False
        if until < 0 and not closing and name not in VOID and boilerplate(name, attrs):
            last = part_end(tags, closed, i)
            if name == "head" or not i < first < last:
                flush()
                until, titled = last, bool(main) and name == "header"
        step = -1 if closing else 1
        if name in HEADINGS or name in BLOCK or name in MAIN:
            flush()
            out.append(("none", "") if main and until >= 0 else ("tag", name))
        elif name == "a" and not main and until < 0:
            flush()
        if name in HEADINGS:
            heading = max(0, heading + step)
        if name in MAIN:
            main = max(0, main + step)
        elif name in ("ul", "ol", "dl"):
            lists = max(0, lists + step)
        elif name == "a":
            links = max(0, links + step)
    if pos < len(page):
        text.append(page[pos:])
    flush()
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Linear scan for the contiguous run of the greatest sum; the first and longest of equals."""
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run < 0:
            run, start = 0.0, i
        run += s
        if run > best or (run == best and start == at[0] and best > 0):
            best, at = run, (start, i + 1)
    return at


def score(kind: str, words: str, weights: dict[str, float]) -> float:
    """A tag's price, or the weight of a text's words; a long boilerplate part grows by its root."""
    if kind == "tag":
        return weights["tag"]
    n = words.count(" ") + 1 if words else 0
    return weights[kind] * (n**0.5 if kind == "boiler" else n)


def extract(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best region without its boilerplate parts, in page order, white space
    collapsed, joined by a space. Inline markup never parts a block."""
    tokens = stream(page)
    words = [" ".join(v.split()) if k != "tag" else "" for k, v in tokens]
    a, b = best_region([score(k, w, weights) for (k, _), w in zip(tokens, words)])
    return "".join(blocks(tokens[a:b], words[a:b]))


def blocks(tokens: list[tuple[str, str]], words: list[str]):
    """The kept texts; those that no tag parts run on as they stand on the page."""
    before = ""  # white space or nothing between runs of one block
    first = True
    for (kind, value), w in zip(tokens, words):
        if kind == "tag":
            before = " "
            continue
        if kind in ("boiler", "none"):
            before = " "
            continue
        if not w:
            before = before or (" " if value else "")
            continue
        if not first:
            yield " " if before or value[0].isspace() else ""
        yield w
        first, before = False, " " if value[-1].isspace() else ""


def learn(pages: DataFrame, sample_rows: int = 2_000) -> dict[str, float]:
    """Weights from labelled pages: those that mark their article by an element.

    At most ``sample_rows`` pages, those of smallest hash of page_id, are read; those that mark
    an article give word and tag counts inside and outside the marked parts. Places never seen
    outside keep their defaults. Only ids are sorted; the pages themselves stay in place.
    """
    ids = pages.select(F.col("page_id").cast("long").alias("page_id")).dropna().distinct()
    ids = ids.orderBy(F.xxhash64("page_id"), "page_id").limit(sample_rows)
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), text_of("html").alias("html"))
    sample = known.join(F.broadcast(ids), "page_id", "left_semi").filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))

    def count(batches):
        for batch in batches:
            total: dict[tuple[str, bool], int] = {}
            for page in batch.column("html").to_pylist():
                inside = False
                for kind, value in stream(page):
                    if kind == "tag":
                        inside = inside or value in MAIN
                    else:
                        inside = kind in ("in", "none")
                    key = (kind, inside)
                    total[key] = total.get(key, 0) + (1 if kind == "tag" else len(value.split()))
            kinds, where = zip(*total) if total else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(where, pa.bool_()), pa.array(list(total.values()), pa.int64())], ["kind", "inside", "n"])

    rows = sample.mapInArrow(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    seen = {(r.kind, r.inside): r.n for r in rows}
    words_in = sum(n for (k, i), n in seen.items() if i and k != "tag")
    words_out = sum(n for (k, i), n in seen.items() if not i and k != "tag")
    weights = dict(DEFAULT)
    for kind in ("block", "list", "link", "boiler"):
        out = seen.get((kind, False), 0)
        if words_in and out:  # words at this place of labelled pages lie outside the article
            weights[kind] = -max(0.5, min(4.0, math.log((words_in + words_out + 1) / (out + 1))))
    if words_in:
        tags = sum(n for (k, i), n in seen.items() if k == "tag")
        weights["tag"] = -max(0.01, min(0.25, tags / (tags + words_in)))
    return weights


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, in one pass after fitting.

    Null and empty pages give an empty text; null ids and urls and repeated rows are kept;
    other columns are ignored; an empty table gives no rows. On a page without a marked
    article the default weights choose the region.
    """
    weights = weights or learn(pages)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = []
                for page in part.column("html").to_pylist():
                    marked = re.search(r"<(?:article|main)[\s>]", page, re.I)
                    texts.append(extract(page, weights if marked else DEFAULT))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES, ORACLE_SQL = {"op10_html": op10_html}, {}
