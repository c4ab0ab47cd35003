import html
import random
import re

import numpy as np
import pytest

from tramline.llm import block_extraction as B

TREE = B.train_tree()


def plain(page):
    """The article of a given page, by its known layout."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", article))
    return "\n".join(p for p in parts if p)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r.page_id: (r.url, plain(r.html)) for r in pages.collect()}
    for r in B.extract(pages).collect():
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), (None, ""), ("   ", ""), ("<article></article>", ""),
    ("<article><h1>Head &amp; tail</h1><p>One\n  two&nbsp;three</p><p>x&#8364;</p></article>", "Head & tail\nOne two three\nx€"),
    ("<body><nav><a href=x>Home</a></nav><article><p>a <b>b</b>c<i>d</i></p></article><footer>no</footer>", "a bcd"),
    ("<article><p>keep this</p><script>if (a < b) { x('</p>') }</script><!-- <p>no</p> --><style>p{}</style><p>and this</p></article>", "keep this\nand this"),
    ("<article><p>yes</p><div class='ad-slot big'><p>buy it now, buy it</p></div><p>yes too</p></article>", "yes\nyes too"),
    ("<article><p>yes</p><form><p>name</p><input name=q></form><div id=comments><p>first!</p></div></article><p hidden>x</p>", "yes"),
    ("<main><div><h2>T</h2><p>one <p>two</div></main><aside><p>side words here</p></aside>", "T\none\ntwo"),
    ("<article><p>open to the end", "open to the end"),
    ("<article><p>a</p><!-- never closed <p>b</p>", "a"),
    ("<div class='cookie-notice'><p>We use cookies on this site and so on and on</p></div><article><p>5 < 6 and 7 > 2</p></article>", "5 < 6 and 7 > 2"),
])
def test_examples(page, text):
    assert B.main_text(TREE, page) == text


def test_pages_without_telling_elements():
    menu = "".join(f"<li><a href=x>item {k}</a></li>" for k in range(5))
    body = "".join(f"<p>{'word ' * 40}{k}</p>" for k in range(3))
    text = B.main_text(TREE, f"<div><ul>{menu}</ul></div><div>{body}</div><div><p><a href=x>more of it</a></p></div>")
    assert text.count("\n") == 2 and "item" not in text and "more" not in text


ARTICLE = [f"{'word ' * 45}number {k}." for k in range(3)]
MENU = "<ul>" + "".join(f"<li><a href=x>item {k}</a></li>" for k in range(5)) + "</ul>"


@pytest.mark.parametrize("around", [
    ("<body class='has-sidebar'>", "</body>"), ("<body class='page sidebar search'><div>", "</div></body>"),
    ("<div class='content no-sidebar'>", "</div>"), ("<div class='sidebar-left content'>", "</div>"),
    ("<div class='page header-fixed'>", "</div>"), ("<section id=wrap class='with-sidebar'>", "</section>"),
    ("<body><form id=aspnetForm method=post action='x'><input type=hidden name=state value=1>", "</form></body>"),
    ("<body><form><div class='content'>", "</div><select><option>a</option></select><textarea>b</textarea></form></body>"),
])
def test_articles_in_wrappers(around):
    body = "".join(f"<p>{p}</p>" for p in ARTICLE)
    page = f"{around[0]}<nav>{MENU}</nav><div>{body}</div><div id='comments'><p>{'first ' * 30}</p></div>{around[1]}"
    assert B.main_text(TREE, page).split("\n") == [" ".join(p.split()) for p in ARTICLE]


@pytest.mark.parametrize("name", ["main-nav", "post-comments", "comment-content", "sidebar", "footer widget"])
def test_parts_named_after_content_stay_out(name):
    body = "".join(f"<p>{p}</p>" for p in ARTICLE)
    page = f"<main>{body}</main><div class='{name}'><p>{'other ' * 40}</p></div>"
    assert B.main_text(TREE, page).split("\n") == [" ".join(p.split()) for p in ARTICLE]


def test_short_forms_stay_out():
    body = "".join(f"<p>{p}</p>" for p in ARTICLE)
    form = "<form><p>Your name</p><input name=n><p>Your mail</p><input name=m><button>Send it now</button></form>"
    for page in (f"<article>{body}{form}</article>", f"<div>{body}</div>{form}", f"<aside><form><p>{'other ' * 40}</p></form></aside><div>{body}</div>"):
        assert B.main_text(TREE, page).split("\n") == [" ".join(p.split()) for p in ARTICLE]


def linked(n, words):
    return "".join(f"<p><a href=x>{'elsewhere ' * words}{k}</a></p>" for k in range(n))


TALK = [f"{'ja ' * (k % 6)}number {k}" for k in range(8)]


@pytest.mark.parametrize(("before", "after"), [("", ""), (f"<div>{linked(6, 9)}</div>", ""), (f"<div>{MENU}</div>", f"<div>{linked(6, 12)}</div>")])
def test_pages_without_any_name(before, after):
    """Talk in short lines stays, alone and between long blocks; blocks of links go."""
    for lines in (TALK, [ARTICLE[0], "No.", "Yes, he said.", ARTICLE[1], "Oh."]):
        page = f"{before}<div>{''.join(f'<p>{x}</p>' for x in lines)}</div>{after}"
        assert B.main_text(TREE, page).split("\n") == [" ".join(x.split()) for x in lines]
    assert B.main_text(TREE, f"<div>{linked(6, 9)}</div>") == ""


def test_links_inside_a_named_article_stay():
    page = f"<div>{MENU}</div><article><p>{ARTICLE[0]}</p>{linked(3, 2)}<table><tr><td><a href=x>one</a><td><a href=x>two words</a></table></article>"
    assert len(B.main_text(TREE, page).split("\n")) == 6


def test_nothing_of_a_named_article_goes():
    chance = random.Random(4)
    for _ in range(200):
        parts = []
        for _ in range(chance.randint(1, 12)):
            words, links = chance.choice([1, 2, 3, 5, 9, 30]), chance.choice([0, 0, 1])
            text = " ".join(["w"] * words)
            parts.append(f"<p><a href=x>{text}</a></p>" if links else f"<p>{text}</p>")
        for name in ("article", "main"):
            page = f"<nav>{MENU}</nav><{name}>{''.join(parts)}</{name}><footer><p>{'small ' * 20}</p></footer>"
            assert B.main_text(TREE, page).count("\n") == len(parts) - 1


def test_no_markup_at_the_end():
    for tail in ("<!-- not closed", "<div class='x", "</div", "<!doctype"):
        assert B.main_text(TREE, f"<article><p>yes it is</p></article> tail text {tail}").split("\n")[0] == "yes it is"
        assert "<" not in B.main_text(TREE, f"<article><p>yes it is</p></article> tail text {tail}")
    assert B.main_text(TREE, "<article>5 < 6") == "5 < 6"


def test_tree_uses_density_and_neighbours():
    def used(tree):
        return set() if isinstance(tree, bool) else {tree[0]} | used(tree[2]) | used(tree[3])

    found = used(TREE)
    assert {0, 1, 7} <= found and found & {2, 3, 4, 5}


def test_held_out_pages_of_the_table():
    wrong, blocks, varied = 0, 0, B.varied_table()
    for k in range(len(B.TABLE)):
        tree = B.train_tree(B.TABLE[:k] + B.TABLE[k + 1 :] + varied)
        page, labels = B._outline(B.TABLE[k])
        said = [B.decide(tree, row) for row in B.block_features(B.blocks(page))]
        wrong += sum(a != bool(b) for a, b in zip(said, labels, strict=True))
        blocks += len(labels)
    assert wrong <= 0.06 * blocks


def test_long_and_broken_pages_end():
    for page in ("<" * 200_000, "<a" * 100_000 + ">", "<div>" * 20_000 + "x", "<p>" + "w " * 300_000, "<div class='" * 20_000, "&" * 100_000):
        B.main_text(TREE, page)


def test_tree_grows_and_stops():
    x = np.array([[k, k % 3] for k in range(20)], dtype=float)
    y = (x[:, 0] > 9).astype(float)
    tree = B.grow(x, y)
    assert [B.decide(tree, row) for row in x] == [bool(v) for v in y]
    assert B.grow(x, np.ones(20)) is True


def test_unusual_rows(spark):
    rows = [(1, None, None, "t", 1), (None, "u", "<article><p>x</p></article>", "t", 2), (2, "u", "", "t", 3), (2, "u", "", "t", 3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    assert sorted(map(tuple, B.extract(frame).collect()), key=repr) == sorted(
        [(1, None, "", 0), (None, "u", "x", 1), (2, "u", "", 0), (2, "u", "", 0)], key=repr
    )
    assert B.extract(frame.limit(0)).count() == 0
