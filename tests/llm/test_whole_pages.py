"""Main text of pages with marks: every page is aligned with its neighbour, and a mark discards nothing by itself."""

from quillpath.llm import html


def test_marks_discard_nothing(spark):
    cards = "<article class='card'><p>Teaser one</p></article><article class='card'><p>Teaser two</p></article>"
    body = "<html><body><main><div class='text'><p>{0} is the story of this page.</p><p>It goes on about {0}.</p></div></main>" + cards + "<div class='strip'>About this site</div></body></html>"
    told = "<article><h1>{0}</h1><div class='story'><p>Said twice.</p><p>Only {0} is told here at some length.</p></div><div class='xq'><p>Read us daily</p></div></article><div>Bottom of host</div>"
    rows = [(1, "http://b/1", body.format("Ann")), (2, "http://b/2", body.format("Bob")), (3, "http://t/1", told.format("Cat")), (4, "http://t/2", told.format("Dan")), (5, "http://t/9", told.format("Dan"))]
    rows += [(6, "http://s/1", "<article><p>Syndicated text of some length</p></article><p>Mon</p>"), (7, "http://s/2", "<article><p>Syndicated text of some length</p></article><p>Tue</p>")]
    got = {x.page_id: x.text for x in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # the body is in divs of the main element and the cards are articles
    assert got[1] == "Ann is the story of this page. It goes on about Ann." and got[2] == "Bob is the story of this page. It goes on about Bob."
    # a sentence of the story that two pages share stays and a box that they share goes; a page with copies alone beside it stays whole
    assert [got[i] for i in (3, 4)] == [f"{x} Said twice. Only {x} is told here at some length." for x in ("Cat", "Dan")]
    assert got[5] == "Dan Said twice. Only Dan is told here at some length. Read us daily Bottom of host"
    assert got[6] == "Syndicated text of some length Mon" and got[7] == "Syndicated text of some length Tue"


def test_differencing_decides(spark):
    """Pages of one host without marks, dealt into several ranges: what two neighbours share goes, unlisted or only
    suggestive names do not matter, and one very long page is whole."""
    import random

    r = random.Random(2)
    paths = r.sample(["/a/%03d" % i for i in range(60)] + ["/b/%d" % i for i in range(30)] + ["/b/x/" + "y" * k for k in range(12)], 80)
    page = "<div>Welcome to the host</div><div class='share-price'>Price {0}</div><div class='zz'><p>Body {0} one</p><p>Body {0} two</p></div><div class='share-buttons'>tell all</div><div class='top-story'>Read on</div>"
    rows = [(i, f"http://h{p}", page.format(i) + ("<p>more of it</p>" * 1 + "".join(f"<p>line {i} {k}</p>" for k in range(3000)) if i == 7 else "")) for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {x.page_id: x.text for x in html.main_text(df).collect()}
    for i in range(len(paths)):
        want = f"Price {i} Body {i} one Body {i} two" + (" more of it " + " ".join(f"line {i} {k}" for k in range(3000)) if i == 7 else "")
        assert got[i] == want
    marks = [(i, "h", p, i % 3) for i, p in enumerate(paths)]
    near = {x.page_id: x.near_id for x in html._nearest(spark.createDataFrame(marks, "page_id long, host string, path string, mark int")).collect()}
    order = sorted(marks, key=lambda m: m[2])
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for k, (i, _, p, m) in enumerate(order):
        sides = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order)]
        best = max(sides, key=lambda s: common(p, s[2]))
        if best[3] == m and len(sides) > 1:
            best = next(s for s in sides if s is not best)
        assert near[i] == best[0]
