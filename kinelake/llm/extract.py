"""Main text of web pages: flat text blocks classified by a decision tree on their own and their neighbours' features.

A page is cut into flat blocks: text between block-level tags, with its number of words, its link density (share of
words inside links) and the region it stands in (named by the innermost marked container around it). A block is
classified from these and from words and link density of the blocks before and after it. The tree is grown from a
small labelled table of blocks by Gini impurity.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import query, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?[a-zA-Z][^\s>/]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s>/]*)")
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

# Tag and attribute names of HTML and of common page templates.
UNSEEN = {"script", "style", "noscript", "template", "textarea", "select", "option", "button", "svg", "iframe", "object", "canvas", "title", "head", "datalist"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
AROUND = {"nav": 2, "header": 2, "footer": 2, "aside": 2, "form": 2, "menu": 2, "dialog": 2, "article": 1, "main": 1}
BOILER_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "consent", "disclaimer", "disqus", "footer", "form", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promotion", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
CONTENT_WORDS = {"article", "content", "entry", "main", "post", "story"}

#: The labelled table. Columns: words, link density, words and link density of the block before, of the block after,
#: region (0 none, 1 content, 2 surroundings), label (1 main text).
LABELLED = """
6 0.0 1 1.0 80 0.0 1 1
90 0.0 6 0.0 70 0.0 1 1
70 0.02 90 0.0 1 0.0 1 1
1 0.0 70 0.0 55 0.0 1 1
55 0.1 1 0.0 3 0.0 1 1
3 0.0 55 0.0 9 0.0 1 1
2 1.0 40 0.0 60 0.0 1 1
120 0.0 0 0.0 0 0.0 1 1
1 0.0 0 0.0 0 0.0 1 1
15 0.0 8 0.0 12 0.0 1 1
30 0.4 20 0.0 25 0.0 1 1
4 0.0 2 1.0 6 0.0 1 1
4 0.0 5 0.0 3 0.0 1 1
2 0.5 0 0.0 2 1.0 1 1
5 0.0 2 1.0 4 1.0 1 1
3 1.0 40 0.0 2 1.0 1 1
7 0.0 4 0.5 3 1.0 1 1
9 0.0 9 0.0 60 0.0 1 1
20 0.7 2 1.0 15 0.9 1 1
2 1.0 3 1.0 5 0.0 1 1
6 0.3 40 0.0 0 0.0 1 1
1 1.0 0 0.0 1 1.0 2 0
1 1.0 1 1.0 1 1.0 2 0
1 1.0 1 1.0 8 0.0 2 0
8 0.0 1 1.0 6 0.0 2 0
12 0.0 90 0.0 0 0.0 2 0
60 0.0 90 0.0 0 0.0 2 0
90 0.0 70 0.0 60 0.0 2 0
25 0.5 4 0.0 2 1.0 2 0
4 0.0 2 0.0 25 0.5 2 0
2 0.0 0 0.0 0 0.0 2 0
40 0.0 8 0.0 80 0.0 2 0
75 0.0 60 0.0 80 0.0 0 1
60 0.05 75 0.0 40 0.0 0 1
40 0.0 60 0.0 3 0.9 0 1
18 0.0 60 0.0 50 0.0 0 1
25 0.1 70 0.0 2 1.0 0 1
5 0.0 2 1.0 75 0.0 0 1
110 0.0 3 1.0 2 1.0 0 1
35 0.1 0 0.0 45 0.0 0 1
3 1.0 40 0.0 2 1.0 0 0
2 1.0 3 1.0 5 0.0 0 0
5 0.0 2 1.0 4 1.0 0 0
9 0.8 3 0.5 60 0.0 0 0
20 0.7 2 1.0 15 0.9 0 0
7 0.0 4 0.5 3 1.0 0 0
30 0.9 75 0.0 12 0.8 0 0
4 0.0 5 0.0 3 0.0 0 0
6 0.3 40 0.0 0 0.0 0 0
2 0.5 0 0.0 2 1.0 0 0
"""
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "region")


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
    """A decision tree as nested tuples (feature, threshold, below or equal, above) with probabilities as leaves."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in ((values[1:] + values[:-1]) / 2).tolist():
            left = x[:, f] <= t
            if least <= left.sum() <= len(y) - least:
                a, b = y[left].mean(), y[~left].mean()
                impurity = left.mean() * a * (1 - a) + (1 - left.mean()) * b * (1 - b)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, t)
    if best is None:
        return float(y.mean())
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


@lru_cache(maxsize=1)
def trained_tree():
    rows = np.array([[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()])
    return grow(rows[:, :-1], rows[:, -1])


def probability(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def region_of(name: str, tag: str) -> int | None:
    """The region a container opens: by its tag, else by words of its class, id or role."""
    found = AROUND.get(name)
    if name in ("body", "html"):
        return None
    for m in MARKS.finditer(tag):
        named = re.sub(r"\b(?:has|no|with|without)[-_][a-z]+", "", (m[1] or m[2] or m[3] or "").lower())
        words = set(re.split(r"[^a-z]+", named))
        if words & BOILER_WORDS:
            return 2
        if found is None and words & CONTENT_WORDS:
            found = 1
    return found


def flat_blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words, words in links, region) of each non-empty block in page order; unfinished pages are read to the end."""
    out, parts, linked = [], [], 0
    links, hidden = 0, None
    stack: list[tuple[str, int]] = []  # open containers and the region they stand in
    region, at = 0, 0

    def text(raw):
        nonlocal linked
        parts.append(raw)
        if links:
            linked += len(html.unescape(raw).split())

    def close():
        nonlocal parts, linked
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                out.append((" ".join(words), len(words), min(linked, len(words)), region))
            parts, linked = [], 0

    for m in TOKEN.finditer(page):
        if hidden is None and m.start() > at:
            text(page[at : m.start()])
        tag = m[0]
        if hidden is not None:
            if tag[:2] == "</" and NAME.match(tag) and NAME.match(tag)[1].lower() == hidden:
                hidden = None
            at = m.end()
            continue
        at = m.end()
        named = NAME.match(tag)
        if named is None:
            continue
        name, ending = named[1].lower(), tag[1] == "/"
        if name in UNSEEN:
            if not ending and tag[-2] != "/":
                if name not in ("script", "style", "textarea", "title"):
                    hidden = name
                else:  # their content is no markup
                    end = re.compile(f"</{name}", re.I).search(page, at)
                    hidden = name
                    if end is None:
                        at = len(page)
                        break
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links = 0 if ending else 1
        if name not in BLOCKS:
            continue
        close()
        if name in VOID:
            continue
        if not ending:
            opened = region_of(name, tag)
            stack.append((name, region))
            if opened is not None:
                # What stands inside surroundings stays there, whatever it calls itself; only <main> starts anew.
                region = 2 if region == 2 and opened == 1 and name != "main" else opened
            links = 0
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    region = stack[k][1]
                    del stack[k:]
                    break
    if hidden is None and at < len(page):
        rest = page[at:]
        text(rest if "<" not in rest else rest[: rest.index("<")] if re.search(r"<[a-zA-Z/!]", rest) else rest)
    close()
    return out


def main_text(page: str | None) -> str:
    """The blocks that the tree takes for main text, one to a line."""
    blocks, tree = flat_blocks(page or ""), trained_tree()
    density = [linked / words for _, words, linked, _ in blocks]
    out = []
    for k, (text, words, _, region) in enumerate(blocks):
        before = (blocks[k - 1][1], density[k - 1]) if k else (0, 0.0)
        after = (blocks[k + 1][1], density[k + 1]) if k + 1 < len(blocks) else (0, 0.0)
        if probability(tree, (words, density[k], *before, *after, region)) >= 0.5:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A null or empty page, and one without main text, give an empty text; repeated rows give equal rows; broken markup
    is read as far as it goes, an unclosed comment or script hides the rest; an empty table gives none.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op6_main_text")
def op6(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
