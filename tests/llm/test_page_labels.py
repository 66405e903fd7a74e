"""What a class or an id of an element says about it, and whole pages of made-up templates against their known text."""

import random

import pandas as pd

import pytest

from lodestar.llm import html_extraction as H

LONG = "long comment of a reader " * 30
PAGES = [
    ("<div class='content-sidebar-wrap'><main><p>One text.</p></main></div>", "One text."),
    ("<article class='post no-sidebar'><p>Two.</p></article>", "Two."),
    ("<article><p>Lead.</p><div class='share-analysis'><p>Share prices rose.</p></div><div class='share'>Tweet</div></article>", "Lead.\nShare prices rose."),
    ("<div class='sidebar'><article><p>All of it.</p></article></div><div class='cookie-notice'>Cookies</div><div id=site-footer>Imprint</div>", "All of it."),
    (f"<article><p>Story.</p></article><section class='comments'><article class='comment'><p>{LONG}</p></article></section>", "Story."),
    (f"<div class='promo'><p>{LONG}</p></div><div class='ad'>Buy</div>", LONG.strip()),
    ("<article><p>Main text of the page.</p></article><div class='related-posts'><article>Teaser</article></div>", "Main text of the page."),
    ("<aside><p>Aside</p></aside><div role='navigation'>Menu</div><section class='news ad-words'><p>About ads.</p></section>", "About ads."),
    ("<div class='ad-300 banner'>x</div><div class='Sidebar_Left'>y</div><p>z and more of z</p>", "z and more of z"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_labels(page, text):
    assert H.extract(f"<html><body>{page}</body></html>", None) == text


def test_labels_of_a_host(spark):
    """Six pages of one host whose articles lie in elements with a listed word."""
    wraps = ["<div class='content-sidebar-wrap'><main>{}</main></div>", "<article class='post no-sidebar'>{}</article>", "<div class=sidebar><article>{}</article></div>"]
    rows = []
    for k, wrap in enumerate(wraps):
        for i in range(6):
            body = wrap.format(f"<h1>Title {i}</h1><p>Text {i} of its own.</p><p>Said on each page.</p>")
            rows.append((k * 10 + i, f"http://h{k}.example/{i}", f"<body><div class='menu'><ul><li>Home</ul></div>{body}<div id='footer'>Imprint</div></body>"))
    frame = spark.createDataFrame(rows + rows[:2], "page_id long, url string, html string")
    found = H.extract_pages(frame).collect()
    assert len(found) == 20
    for r in found:
        assert r.text == f"Title {r.page_id % 10}\nText {r.page_id % 10} of its own.\nSaid on each page."


def test_random_templates(spark):
    """Hosts with a template each: menus, adverts and footers of random kinds around and within the article."""
    draw = random.Random(4)
    outer = ["<nav><a>Home</a><a>More</a></nav>", "<div class='ad'>Buy now</div>", "<div class='site-header'><p>Name</p></div>", "<footer>Imprint</footer>", "<aside>See also</aside>", "<div id='cookie-banner'>Accept</div>", "<form><p>Subscribe</p></form>", "<ul class='breadcrumbs'><li>Start</li></ul>"]
    inner = ["<div class='share'>Tweet this</div>", "<div class='advert'>Buy</div>", "<div class='newsletter-box'>Mail</div>"]
    boxes = ["<article>{}</article>", "<main><div class='text'>{}</div></main>", "<div class='page-content'><article class='entry'>{}</article></div>"]
    rows, want = [], {}
    for host in range(12):
        before, after = draw.sample(outer, draw.randrange(1, 4)), draw.sample(outer, draw.randrange(1, 4))
        box, part = draw.choice(boxes), draw.choice(inner + [""])
        for i in range(draw.randrange(1, 9)):
            lines = [" ".join(f"w{draw.randrange(999)}" for _ in range(draw.randrange(3, 30))) for _ in range(draw.randrange(1, 6))]
            kinds = [draw.choice(["p", "h2", "blockquote", "section"]) for _ in lines]
            body = [f"<{k}>{x}</{k}>" for k, x in zip(kinds, lines, strict=True)]
            body.insert(draw.randrange(len(body) + 1), part)
            page_id = host * 100 + i
            rows.append((page_id, f"https://h{host}.example/{i}", f"<html><body>{''.join(before)}{box.format(''.join(body))}{''.join(after)}</body></html>"))
            want[page_id] = "\n".join(lines)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, slot int")
    assert {r.page_id: r.text for r in H.extract_pages(frame).collect()} == want


def test_very_long_page(spark):
    text = "\n".join(f"paragraph {i} of a very long page" for i in range(40_000))
    page = "<body><nav>Menu</nav><article>" + "".join(f"<p>{x}</p>" for x in text.split("\n")) + "</article></body>"
    frame = spark.createDataFrame([(1, "http://a.example/1", page)], "page_id long, url string, html string")
    found = H.extract_pages(frame).first()
    assert found.text == text and found.n_chars == len(text)


def test_classes_nest_into_slots():
    row = lambda path, vector, once, df=4: ("h", path, 0, df, once, vector, 0.0, 4)
    body, box, text = "/html/body", "/html/body/div", "/html/body/div/article"
    tokens = [row("", 7, 4), row("/html", 7, 4), row(body, 7, 4), row(box, 8, 3, 3), row(text, 8, 3, 3), row(text + "/p", 9, 0), row(body + "/ul/li", 5, 0), row(box + "/li", 5, 0)]
    texts = [("h", text + "/p", 1, 0, 0, 0, 90.0, 4), ("h", body + "/ul/li", 1, 0, 0, 0, 9.0, 4)]
    pdf = pd.DataFrame(tokens + texts, columns=["host", "path", "kind", "df", "once", "vector", "chars", "pages"])
    skeleton = {"/html": 7, body: 7, box: 8, text: 8}
    classes = {7: ["", "/html", body], 8: [box, text], 9: [text + "/p"], 5: [body + "/ul/li", box + "/li"]}
    assert H.nested_classes(classes, skeleton) == {7: "", 8: body, 9: text}  # 5 repeats in two slots
    assert H.choose_slot(pdf).iloc[0].to_dict() == {"host": "h", "slot": text, "skeleton": 4, "classes": 3}
