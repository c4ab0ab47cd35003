"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once, tag by tag, into blocks of text between block-level tags. Each block has its
number of words and link density, those of the block before and after it, whether it is a heading,
and what the nearest telling element around it says: an article or main part, or a part that pages
use for navigation, notices, adverts, comments and the like. Names on the body and names that state
whether the page has a part (``no-sidebar``, ``header-fixed``) don't make such a part, and a name of
content beside them counts more. A form says little, since pages may lie in one as a whole; its controls
are not read. A decision tree grown on the small labelled table below tells content from the rest.
Most pages of the table have no names at all, so that words, link densities and neighbours decide where
nothing else does.

Results for unusual input: a null or empty page, or one without any content block, has an empty
text; unclosed tags, comments and scripts reach to the end of the page; very long pages are read whole
in one pass, repeated rows give repeated results, an empty table no rows, and columns other than page_id,
url and the page's are not read.
"""

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .storage import text_of

# Elements that end a block, elements without readable text, words in class, id or
# role attributes and what they say about the text inside.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CONTAINER = frozenset("article aside body details dialog div footer form header main menu nav ol section table ul".split())
UNREAD = frozenset(
    "button canvas datalist head iframe math noscript object script select style svg template textarea title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTER = frozenset(
    "ad ads adv advert adverts advertisement alert author banner bio breadcrumb breadcrumbs byline comment comments "
    "complementary contentinfo cookie cookies copyright dialog discussion disqus footer header meta masthead menu modal "
    "nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted related replies reply "
    "respond search share sharing sidebar social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
INNER = frozenset("article content main post entry story articlebody maincontent".split())
STATES = frozenset("no has have with without hide show is fixed sticky static enabled disabled collapsed expanded".split())

_TAG = re.compile(
    r"<!--|<!\[CDATA\[|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>"
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_PART = re.compile(r"[a-z]+")
IN_FORM = -0.4  # what a form says: less than nothing, as labels lie in forms, more than a part that stays out
_OPENS = re.compile(r"<(?=[a-zA-Z/!?])")


def _says(name, attributes, inside):
    """1 for content, -1 for the rest, 0 for nothing."""
    if name in ("article", "main"):
        return 1
    if name == "form":
        return _named(attributes)
    if name in ("nav", "aside", "footer", "menu", "dialog") or (name == "header" and not inside):
        return -1
    if not attributes:
        return 0
    if _HIDDEN.search(attributes):
        return -1
    said = _named(attributes)
    return 0 if said < 0 and (name == "body" or name == "header" and inside) else said


def _named(attributes):
    """What class, id, role and itemprop say: content if a name says so, else the rest if one does."""
    names = {n for m in _NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()}
    parts = [set(_PART.findall(n)) for n in names]
    if any(p & INNER and not p & OUTER or p & INNER and p & STATES for p in parts):
        return 1
    return -1 if any(p & OUTER and not p & STATES for p in parts) else 0


def blocks(page):
    """(text, words, link density, heading, telling element, inside an article) of each block."""
    out, pieces, linked = [], [], 0
    stack = []  # (element, what it says, inside an article)
    says, inside, heading, link, veiled = 0, False, False, False, False
    at, stop = 0, page.rfind(">") + 1

    def add(raw):
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if link:
            linked += len(text.split())

    def close():
        nonlocal linked
        words = "".join(pieces).split()
        if words and not veiled:
            out.append((" ".join(words), len(words), min(1.0, linked / len(words)), heading, says, inside))
        pieces.clear()
        linked = 0

    while found := _TAG.search(page, at, stop):
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        mark = found[0]
        if mark == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if mark == "<![CDATA[":
            end = page.find("]]>", at)
            at = len(page) if end < 0 else end + 3
            continue
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if name in UNREAD:
            if name in ("title", "head"):
                close()
            if not closing and not (attributes.endswith("/") and name in ("svg", "math", "object", "iframe")):
                end = re.compile(rf"</{name}\b[^>]*>" if name != "head" else r"</head\b[^>]*>|(?=<body\b)", re.I).search(page, at)
                at = len(page) if end is None else end.end()
        elif name == "a":
            link = not closing
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCK:
            close()
            link = False
            veiled = not closing and name not in CONTAINER and bool(attributes and _HIDDEN.search(attributes))
            if name[0] == "h" and name[1:].isdigit():
                heading = not closing
            elif name == "p" or name == "li":
                heading = False
            if name in CONTAINER:
                if not closing:
                    stack.append((name, says, inside))
                    said = _says(name, attributes, inside)
                    says = said or (min(says, IN_FORM) if name == "form" else says)
                    inside = inside or said == 1
                elif any(name == opened for opened, _, _ in stack):
                    while True:
                        opened, says, inside = stack.pop()
                        if opened == name:
                            break
    tail = page[at:]
    unclosed = _OPENS.search(tail)
    add(tail[: unclosed.start()] if unclosed else tail)
    close()
    return out


def block_features(found):
    """Rows: words, density, words and density before and after, heading, telling element, inside."""
    words = np.array([0, *[b[1] for b in found], 0], dtype=float)
    density = np.array([0.0, *[b[2] for b in found], 0.0])
    return np.column_stack([
        words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:],
        [float(b[3]) for b in found], [float(b[4]) for b in found], [float(b[5]) for b in found],
    ])


def grow(x, y, depth=8, least=2):
    """A decision tree by Gini impurity: (feature, limit, low side, high side) or a verdict."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return bool(y.mean() > 0.5)
    best = (2 * y.mean() * (1 - y.mean()) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            n = low.sum()
            if n < least or len(y) - n < least:
                continue
            p, q = y[low].mean(), y[~low].mean()
            impurity = (2 * p * (1 - p) * n + 2 * q * (1 - q) * (len(y) - n)) / len(y)
            if impurity < best[0]:
                best = (impurity, f, limit)
    if best[1] is None:
        return bool(y.mean() > 0.5)
    low = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def decide(tree, row):
    while not isinstance(tree, bool):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


# The labelled table: pages in outline. Each block is (words, linked words, label, tag), and each
# group of blocks has the element around it. Label 1 is content.
_LONG, _MIDDLE, _SHORT, _TINY = 60, 25, 7, 2
TABLE = (
    (("nav", (("li", _TINY, _TINY, 0),) * 5), ('div class="ad"', (("", 10, 0, 0),)),
     ("article", (("h1", 12, 0, 1), ("p", _LONG, 0, 1), ("p", _TINY, 0, 1), ("p", _SHORT, 0, 1), ("p", _MIDDLE, 1, 1))),
     ("footer", (("", 11, 0, 0),))),
    (("header", (("h1", 3, 3, 0), ("p", _SHORT, 0, 0))), ("nav", (("li", 1, 1, 0),) * 4),
     ("main", (("h1", _SHORT, 0, 1), ("p", _MIDDLE, 0, 1), ("p", _LONG, 4, 1), ("h2", 3, 0, 1), ("li", _SHORT, 0, 1),
               ("li", _SHORT, 2, 1), ("p", 1, 0, 1))),
     ("aside", (("h2", 2, 0, 0), ("p", _MIDDLE, 0, 0), ("li", _SHORT, _SHORT, 0))), ("footer", (("p", _MIDDLE, 2, 0),))),
    (("", (("li", 1, 1, 0),) * 6), ("", (("h1", _SHORT, 0, 1), ("p", _LONG, 0, 1), ("p", _MIDDLE, 0, 1), ("p", _LONG, 3, 1),
                                        ("p", 20, 0, 1))),
     ("", (("p", 4, 4, 0), ("p", 3, 3, 0), ("p", 5, 4, 0)))),
    (("", (("p", 2, 2, 0), ("p", 2, 1, 0), ("p", 4, 2, 0))), ("", (("p", 90, 2, 1), ("p", 40, 0, 1), ("p", 35, 5, 1))),
     ("", (("p", 3, 1, 0), ("p", 2, 2, 0), ("p", 1, 0, 0)))),
    (('div class="content"', (("h1", 6, 0, 1), ("p", _TINY, 0, 1), ("p", _LONG, 0, 1), ("p", 1, 0, 1))),
     ('div id="comments"', (("h3", 2, 0, 0), ("p", _MIDDLE, 0, 0), ("p", _LONG, 0, 0), ("p", _TINY, 0, 0))),
     ('div class="sidebar"', (("p", _LONG, 0, 0), ("p", _SHORT, _SHORT, 0)))),
    (('div class="cookie notice"', (("p", _MIDDLE, 1, 0), ("p", _LONG, 0, 0))),
     ("article", (("h1", 5, 0, 1), ("p", 3, 0, 1), ("p", 2, 0, 1), ("p", 14, 14, 1), ("p", 10, 0, 1))),
     ('section class="related"', (("p", 9, 9, 0), ("p", 8, 8, 0), ("p", _MIDDLE, 0, 0))),
     ('div class="newsletter"', (("p", 12, 0, 0), ("p", _TINY, 0, 0)))),
    (("article", (("p", 4, 0, 1),)), ("footer", (("p", 4, 0, 0), ("p", _LONG, 0, 0)))),
    (("article", (("h1", 8, 0, 1), ("p", 80, 0, 1), ("p", _LONG, 0, 1))), ("footer", (("p", 15, 0, 0), ("p", _LONG, 0, 0)))),
    (("article", (("p", 70, 0, 1), ("p", _LONG, 2, 1))), ('div class="comments"', (("p", _LONG, 0, 0), ("p", 45, 0, 0), ("p", 50, 0, 0))),
     ("footer", (("p", 30, 0, 0),))),
    (("article", (("p", 50, 0, 1), ("p", 90, 0, 1))), ("aside", (("p", 55, 0, 0), ("p", 18, 0, 0), ("p", 80, 0, 0))),
     ("", (("p", 70, 0, 1), ("p", 40, 0, 1))), ("footer", (("p", 20, 0, 0),))),
    (("main", (("p", 1, 0, 1), ("p", 1, 0, 1), ("h2", 9, 0, 1), ("p", 1, 0, 1))), ("aside", (("p", 30, 0, 0), ("h2", 4, 0, 0)))),
    # Pages without names: menus, links to other pages, talk in short lines, lists and small print.
    (("", (("li", 2, 2, 0),) * 7), ("", (("p", 3, 0, 1), ("p", 5, 0, 1), ("p", 2, 0, 1), ("p", 6, 0, 1), ("p", 4, 0, 1), ("p", 1, 0, 1),
                                        ("p", 6, 0, 1), ("p", 3, 0, 1))), ("", (("li", 9, 9, 0),) * 6)),
    (("", (("p", 4, 0, 1), ("p", 2, 0, 1), ("p", 5, 0, 1), ("p", 3, 0, 1), ("p", 6, 0, 1), ("p", 2, 0, 1))),),
    (("", (("p", _LONG, 0, 1), ("p", 3, 0, 1), ("p", 1, 0, 1), ("p", 5, 0, 1), ("p", 70, 2, 1), ("p", 2, 0, 1), ("p", 40, 0, 1))),
     ("", (("p", 12, 12, 0), ("p", 10, 10, 0), ("p", 8, 8, 0), ("p", 14, 14, 0), ("p", 9, 8, 0), ("p", 11, 11, 0)))),
    (("", (("li", 1, 1, 0), ("li", 3, 3, 0), ("li", 2, 2, 0), ("li", 5, 5, 0))), ("", (("h1", 7, 0, 1), ("p", 30, 0, 1), ("p", 55, 6, 1),
      ("li", 4, 0, 1), ("li", 6, 0, 1), ("li", 3, 0, 1), ("p", 22, 3, 1))), ("", (("p", 3, 1, 0), ("p", 2, 2, 0), ("p", 1, 1, 0)))),
    (("", (("p", 6, 6, 0), ("p", 2, 0, 0), ("p", 5, 5, 0), ("p", 1, 0, 0), ("p", 3, 3, 0))),
     ("", (("p", 80, 1, 1), ("p", 4, 0, 1), ("p", 75, 0, 1), ("p", 18, 2, 1))),
     ("", (("p", 4, 4, 0), ("p", 2, 0, 0), ("p", 6, 6, 0), ("p", 3, 0, 0), ("p", 5, 5, 0)))),
    (("", (("p", 20, 18, 0), ("p", 16, 12, 0), ("p", 25, 24, 0))), ("", (("h2", 5, 0, 1), ("p", 33, 8, 1), ("p", 48, 10, 1), ("p", 9, 2, 1),
      ("p", 60, 0, 1))), ("", (("li", 7, 7, 0), ("li", 12, 11, 0), ("li", 8, 8, 0), ("li", 10, 10, 0)))),
    (("", (("h1", 9, 0, 1), ("p", 5, 0, 1), ("p", 4, 0, 1), ("h2", 2, 0, 1), ("p", 6, 0, 1), ("p", 3, 0, 1))),
     ("", (("p", 5, 3, 0), ("p", 3, 2, 0), ("p", 1, 0, 0), ("p", 4, 3, 0)))),
    (("", (("li", 4, 4, 0),) * 3), ("", (("p", 7, 0, 1), ("p", 12, 0, 1), ("p", 26, 5, 1), ("p", 3, 0, 1), ("p", 44, 0, 1))),
     ("", (("p", 8, 8, 0), ("p", 2, 0, 0), ("p", 9, 9, 0)))),
    (("", (("li", 3, 3, 0), ("li", 9, 9, 0))), ("", (("p", 2, 0, 1), ("p", 3, 0, 1), ("p", 1, 0, 1), ("p", 6, 0, 1), ("p", 2, 0, 1))),
     ("", (("li", 12, 12, 0), ("li", 2, 2, 0)))),
    (("", (("li", 2, 2, 0),) * 3), ("", (("p", 1, 0, 1), ("p", 2, 0, 1), ("p", 4, 0, 1))), ("", (("li", 7, 7, 0),) * 3)),
    (("", (("li", 10, 10, 0),) * 3), ("", (("p", 4, 0, 1), ("p", 1, 0, 1), ("p", 3, 0, 1))), ("", (("li", 1, 1, 0),) * 3)),
    (("", (("li", 4, 4, 0), ("p", 3, 0, 0), ("li", 5, 5, 0), ("p", 1, 0, 0), ("li", 6, 6, 0))), ("", (("p", 3, 0, 1), ("p", 5, 0, 1)))),
    # Forms: their labels, and pages that lie in one.
    (("article", (("p", _LONG, 0, 1), ("p", 40, 0, 1))), ("form", (("p", 2, 0, 0), ("p", 1, 0, 0), ("p", 3, 0, 0), ("p", 6, 0, 0)))),
    (("", (("p", 50, 0, 1), ("p", 4, 0, 1))), ("form", (("p", 5, 0, 0), ("p", 2, 0, 0), ("p", 2, 0, 0)))),
    (("form", (("li", 2, 2, 0), ("li", 3, 3, 0), ("li", 2, 2, 0), ("p", _LONG, 0, 1), ("p", 45, 2, 1), ("p", 70, 0, 1), ("p", 14, 0, 1),
               ("p", 28, 0, 1), ("li", 8, 8, 0), ("li", 9, 9, 0))),),
    # Links inside a named article belong to it.
    (("", (("li", 2, 2, 0),) * 4), ("article", (("h1", 8, 0, 1), ("p", _LONG, 0, 1), ("li", 3, 3, 1), ("li", 4, 4, 1), ("li", 1, 1, 1),
      ("li", 9, 9, 1), ("p", 1, 0, 1), ("li", 9, 9, 1), ("p", 3, 0, 1), ("li", 4, 4, 1), ("p", 2, 0, 1), ("p", 30, 0, 1), ("p", 12, 12, 1), ("p", 2, 2, 1), ("p", 14, 14, 1), ("p", 6, 5, 1)))),
    (("main", (("h1", 3, 3, 1), ("p", 1, 0, 1), ("p", 45, 2, 1), ("td", 5, 5, 1), ("td", 1, 1, 1), ("td", 6, 6, 1), ("td", 1, 0, 1), ("td", 2, 2, 1), ("td", 2, 0, 1), ("td", 4, 4, 1), ("p", 20, 20, 1))),
     ("", (("li", 6, 6, 0), ("li", 3, 3, 0), ("li", 10, 10, 0)))),
)


# Bodies that pages of the rule below have: long paragraphs, talk, short lines between long ones, lists.
BODIES = (
    (("h1", 8, 0, 1), ("p", 60, 0, 1), ("p", 25, 2, 1), ("p", 40, 0, 1)),
    (("p", 1, 0, 1), ("p", 5, 0, 1), ("p", 2, 0, 1), ("p", 6, 0, 1), ("p", 3, 0, 1)),
    (("p", 4, 0, 1), ("p", 1, 0, 1), ("p", 7, 0, 1), ("p", 2, 0, 1)),
    (("p", 50, 0, 1), ("p", 1, 0, 1), ("p", 3, 0, 1), ("p", 70, 8, 1), ("p", 2, 0, 1)),
    (("h2", 2, 0, 1), ("li", 9, 0, 1), ("li", 12, 2, 1), ("li", 4, 0, 1), ("p", 30, 5, 1)),
)


def varied_table():
    """Outlines by rule: every body between menus and lists of links of several sizes, without names and with."""
    pages = []
    for lead in (1, 2, 4, 9, 14):
        menu = (("li", lead, lead, 0),) * 4
        for tail in (1, 3, 6, 12):
            links = (("li", tail, tail, 0),) * 4
            pages += [(("", menu), ("", body), ("", links)) for body in BODIES]
        for small in (1, 2, 3):  # words between links, as in trails and small print
            between = (("li", lead, lead, 0), ("p", small, 0, 0)) * 3 + (("li", lead, lead, 0),)
            pages.append((("", between), ("", BODIES[small])))
        for body in (*BODIES, BODIES[1][:1], BODIES[3][1:3], BODIES[2][:2]):
            mixed = tuple(block for row in body for block in (row, ("p", lead, lead, 1)))
            pages.append((("nav", menu), ("article", mixed), ("footer", (("p", 12, 0, 0), ("p", lead, lead, 0)))))
            pages.append((("", menu), ("main", mixed[1:]), ("aside", menu)))
            pages += [(("", menu), (name, rows)) for name, rows in (("", body), ("article", body), ("article", mixed))]
            pages += [((name, rows),) for name, rows in (("", body), ("article", body), ("article", mixed))]
    return tuple(pages)


def _outline(page):
    """The page of an outline and the labels of its blocks."""
    parts, labels = [], []
    for around, rows in page:
        name = around.split(" ")[0] or "div"
        parts.append(f"<{around or 'div'}>")
        for tag, words, linked, label in rows:
            text = " ".join(["w"] * (words - linked))
            link = f"<a href='x'>{' '.join(['w'] * linked)}</a>" if linked else ""
            parts.append(f"<{tag or 'p'}>{text} {link}</{tag or 'p'}>")
            labels.append(label)
        parts.append(f"</{name}>")
    return "".join(parts), labels


def train_tree(table=None):
    table = TABLE + varied_table() if table is None else table
    features, labels = [], []
    for page in table:
        text, verdicts = _outline(page)
        features.append(block_features(blocks(text)))
        labels += verdicts
    return grow(np.vstack(features), np.array(labels, dtype=float))


def main_text(tree, page):
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b[0] for b, row in zip(found, block_features(found), strict=True) if decide(tree, row))


def extract(pages, tree=None, html_column="html"):
    """page_id, url, text and n_chars of every page."""
    tree = train_tree() if tree is None else tree

    def task(batches):
        for batch in batches:
            texts = [main_text(tree, page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    frame = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        text_of(html_column).alias("html"),
    )
    return frame.mapInArrow(task, "page_id long, url string, text string, n_chars long")
