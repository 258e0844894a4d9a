"""Main text of web pages from flat text blocks and a small decision tree.

A page is read once, tag by tag, into flat blocks of text; tags that are not inline end a block.
A block's features are its words and link density, those of its neighbours, and what its open
containers say.  A decision tree, grown from the labelled table below, keeps or drops each block.

Reading takes time in proportion to the page, whatever it holds: a quote counts only as the value of an
attribute, and once a tag's quotes never end, those of later tags are not believed either.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Kinds of elements, and words of a class, id or role that tell what a container holds.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER = frozenset("article aside body blockquote center dialog dd details div dl fieldset figure footer form header html main menu nav ol section table tbody td tr ul".split())
DROPPED = frozenset("aside button dialog footer form menu nav".split())
SIGNS = frozenset(
    "ad ads adv advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disclaimer discussion disqus footer form login masthead menu modal nav navbar navigation"
    " newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription widget".split()
)
HEAD_SIGNS = frozenset("header banner masthead".split())
#: Elements whose content is no text of the page: to their end tag, or, if it is missing, to the page's end (code) or not at all (others).
CODE = frozenset("script style".split())
OPAQUE = CODE | frozenset("audio canvas iframe math noscript object select svg template textarea title video".split())

_MARKUP = re.compile(r"<(?:(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)|(?P<odd>[!?]))")
_REST = re.compile(r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>")
_NAMED = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_END = {name: re.compile(rf"</{name}(?![^\s/>])[^>]*+>?", re.I) for name in OPAQUE}
#: Containers of the main text, whose class, id or role does not matter.
WHOLE = frozenset("body main".split())

#: What a block's place says: 0 no article on the page, 1 inside one, -1 outside one.
FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "dropped", "article")


def markup(page: str) -> Iterator[tuple[str | None, str, bool, str]]:
    """The texts and tags of a page in order: (text, "", False, ""), or (None, tag in lower case, whether it closes, what else it holds)."""
    start = at = 0
    quoted, unended = True, set()
    while (p := page.find("<", at)) >= 0:
        m = _MARKUP.match(page, p)
        if not m:  # a sign, not a tag
            at = p + 1
            continue
        if m["odd"]:
            comment = page.startswith("<!--", p)
            e = page.find("-->" if comment else ">", p + 2)
            yield page[start:p], "", False, ""
            if e < 0:
                return
            start = at = e + (3 if comment else 1)
            continue
        end = _REST.match(page, m.end()) if quoted else None
        quoted = end is not None
        e = end.end() - 1 if end else page.find(">", m.end())
        if e < 0:  # no tag ends any more; the last one is cut off, the others are text
            last = page.rfind("<")
            yield page[start : last if _MARKUP.match(page, last) else len(page)], "", False, ""
            return
        if start < p:
            yield page[start:p], "", False, ""
        tag, rest = m["tag"].lower(), page[m.end() : e]
        start = at = e + 1
        if tag not in OPAQUE:
            yield None, tag, bool(m["close"]), rest
            continue
        yield " ", "", False, ""
        if m["close"] or tag in unended or (tag in ("svg", "math") and rest.endswith("/")):
            continue
        if stop := _END[tag].search(page, at):
            start = at = stop.end()
        elif tag in CODE:
            return
        else:
            unended.add(tag)
    yield page[start:], "", False, ""


def _container(tag: str, inside: bool) -> bool:
    """Whether a container is one to drop by its tag."""
    return tag in DROPPED or (tag == "header" and not inside)


def _signed(tag: str, rest: str, inside: bool) -> bool:
    """Whether a container's class, id or role has a word, whole, that tells to drop it."""
    if tag in WHOLE:
        return False
    return any(w in SIGNS or (w in HEAD_SIGNS and not inside) for m in _NAMED.findall(rest) for w in "".join(m).lower().split())


def matrix(rows: list[tuple[int, float, bool, int]]) -> np.ndarray:
    """Features of a page's blocks from words, link density, dropped and article of each."""
    f = np.zeros((len(rows) + 2, len(FEATURES)))
    if rows:
        f[1:-1, [0, 1, 6, 7]] = rows
    f[1:-1, 2:4], f[1:-1, 4:6] = f[:-2, 0:2], f[2:, 0:2]
    return f[1:-1]


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """The texts of a page's blocks, in order, and a row of features each.

    The signs of a container that holds the page's first article, or a main, are ignored, for the
    blocks before it too; so are those of that article.
    """
    texts: list[str] = []
    own: list[tuple[int, float, int, bool]] = []  # words, link density, innermost dropped container (0: none), in an article
    parts: list[str] = []
    words = linked = links = 0
    stack: list[tuple[str, int, bool]] = []  # tag, number if dropped, whether an article
    depth: Counter[str] = Counter()
    outer, by_tag, ignored = [0], [True], [True]  # of each dropped container, by number: the one around it, whether its tag drops it, whether its signs are ignored
    inner = article = 0
    any_article = False

    def close() -> None:
        nonlocal words, linked
        s = " ".join("".join(parts).split())
        parts.clear()
        if s:
            texts.append(s)
            own.append((len(s.split()), linked / max(1, words), inner, article > 0))
        words = linked = 0

    for text, tag, closes, rest in markup(page):
        if text is not None:
            t = html.unescape(text)
            parts.append(t)
            n = len(t.split())
            words += n
            linked += n if links > 0 else 0
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closes else links + 1
            continue
        close()
        if tag not in CONTAINER and tag not in DROPPED:
            continue
        if not closes:
            if tag in VOID or rest.endswith("/"):
                continue
            whole = tag == "main" or (tag == "article" and not any_article)
            if whole:
                x = inner
                while x and not ignored[x]:  # those around an ignored one were ignored with it
                    ignored[x] = not by_tag[x]
                    x = outer[x] if ignored[x] else 0
            named = _container(tag, article > 0)
            drop = named or (not whole and _signed(tag, rest, article > 0))
            if drop:
                outer.append(inner)
                by_tag.append(named)
                ignored.append(False)
                inner = len(outer) - 1
            stack.append((tag, inner if drop else 0, tag in ("article", "main")))
            depth[tag] += 1
            article += stack[-1][2]
            any_article |= stack[-1][2]
        elif depth[tag]:
            while stack:
                name, number, main = stack.pop()
                depth[name] -= 1
                if number:
                    inner = outer[number]
                article -= main
                if name == tag:
                    break
    close()
    gone = [False]  # whether a dropped container, or one around it, counts
    for x in range(1, len(outer)):
        gone.append(not ignored[x] or gone[outer[x]])
    return texts, matrix([(w, l, gone[d], (1 if a else -1) if any_article else 0) for w, l, d, a in own])


#: Labelled blocks of some pages, parted by empty lines: words, link density, dropped, article, and 1 for main text.
LABELLED = """
6 1.0 1 -1 0
1 1.0 1 -1 0
8 0.0 1 -1 0
9 0.0 0 1 1
60 0.0 0 1 1
2 0.0 0 1 1
1 0.0 0 1 1
120 0.05 0 1 1
30 0.5 0 1 1
45 0.0 0 1 1
15 0.0 1 -1 0

5 1.0 0 -1 0
12 0.0 0 -1 0
4 1.0 0 1 1
75 0.0 0 1 1
3 1.0 0 1 1
3 1.0 0 1 1
18 0.8 0 1 1
4 0.0 0 1 1
25 0.0 1 1 0
40 0.0 1 1 0
7 0.6 1 1 0
20 0.0 0 -1 0
4 1.0 0 -1 0

9 0.0 0 -1 0
80 0.0 0 -1 1
70 0.1 0 -1 1
110 0.0 0 -1 1
30 0.0 0 -1 0
12 0.0 0 1 1
24 0.0 0 1 1
16 0.9 0 -1 0
35 0.6 0 -1 0
22 0.0 0 -1 0

3 1.0 1 0 0
4 1.0 1 0 0
8 0.0 0 0 1
55 0.0 0 0 1
42 0.4 0 0 1
65 0.0 0 0 1
5 1.0 1 0 0
3 1.0 1 0 0
10 0.0 1 0 0

5 1.0 0 0 0
2 1.0 0 0 0
3 1.0 0 0 0
7 0.0 0 0 1
80 0.0 0 0 1
2 0.0 0 0 1
45 0.1 0 0 1
26 0.5 0 0 1
18 0.0 0 0 1
90 0.02 0 0 1
5 0.0 0 0 1
2 0.0 0 0 0
6 1.0 0 0 0
7 1.0 0 0 0
3 0.0 0 0 0
8 0.9 0 0 0
24 0.8 0 0 0
6 1.0 0 0 0
4 0.0 0 0 0
2 1.0 0 0 0
10 0.3 0 0 0

9 0.0 0 0 1
50 0.0 0 0 1

1 0.0 0 0 1

28 0.0 1 0 0
33 0.1 1 0 0
70 0.0 1 0 0
14 0.0 0 0 1
38 0.0 0 0 1
4 1.0 0 0 0
3 1.0 0 0 0
60 0.0 0 0 1
12 0.0 0 0 1
2 1.0 1 0 0
"""


def table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled blocks."""
    x, y = [], []
    for page in LABELLED.strip().split("\n\n"):
        rows = [[float(v) for v in r.split()] for r in page.splitlines()]
        x.append(matrix([(w, l, d, a) for w, l, d, a, _ in rows]))
        y += [int(r[-1]) for r in rows]
    return np.concatenate(x), np.array(y)


@lru_cache(maxsize=1)
def tree() -> list[tuple[int, float, int, int]]:
    """The tree grown from the table: (feature, split, left, right) a node; a leaf has feature -1 and its class at left."""
    x, y = table()
    nodes: list[tuple[int, float, int, int]] = []

    def gini(v: np.ndarray) -> float:
        p = v.mean() if len(v) else 0.0
        return len(v) * p * (1 - p)

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, int(2 * y[rows].sum() >= len(rows)), 0))
        best = (gini(y[rows]) - 1e-9, -1, 0.0)
        if depth < 7:
            for f in (6, 7, 1, 0, 3, 5, 2, 4):
                values = np.unique(x[rows, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[rows, f] <= cut
                    best = min(best, (gini(y[rows[low]]) + gini(y[rows[~low]]), f, float(cut)), key=lambda b: b[0])
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[at] = (best[1], best[2], grow(rows[low], depth + 1), grow(rows[~low], depth + 1))
        return at

    grow(np.arange(len(x)), 0)
    return nodes


def keep(features: np.ndarray) -> list[bool]:
    nodes, out = tree(), []
    for row in features.tolist():
        f, cut, left, right = nodes[0]
        while f >= 0:
            f, cut, left, right = nodes[left if row[f] <= cut else right]
        out.append(bool(left))
    return out


def main_text(page: str) -> str:
    texts, features = blocks(page)
    return "\n".join(t for t, k in zip(texts, keep(features), strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (its code points) of every row of pages.

    Null or empty html: an empty text.  Repeated rows: a row each.  Empty table: no rows.
    """
    common.ship(pages.sparkSession)

    def run(batches):
        for b in common.slices(batches, "html"):
            texts = [main_text(s) for s in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text("html").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
