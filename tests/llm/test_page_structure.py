"""What names and odd markup may not do to a page's main text."""

import pytest

from quillpath.llm import html

STORY = "<p>The story of the day is long enough to be most of this page, and it goes on for a while.</p>"
TEXT = "The story of the day is long enough to be most of this page, and it goes on for a while."


def text(page):
    return " ".join(html.lines_of(page)[0])


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content sidebar-right">{STORY}</div>',
        f'<div id="page" class="main-menu-right">{STORY}</div>',
        f'<div class="layout sidebar">{STORY}</div><div class="menu">Home</div>',
        f'<form action="/"><div class="menu">Home</div>{STORY}</form>',
        f'<form><form><div class="sidebar">{STORY}</div></form></form>',
        f'<div class="banner"><div role="banner">{STORY}</div></div>',
        f"<svg/>{STORY}<iframe src='x'/>",
        f"<video src=a>{STORY}",
        f"{STORY}<object data=x>",
        STORY.replace("<p>", '<p title="the hidden cave">'),
        STORY.replace("<p>", '<p data-hidden="false" data-class="ad">'),
        STORY.replace("<p>", "<p title='id=menu' alt=\"style=display:none\">"),
        f'<div class="story-body"><div class="article-content-header"></div>{STORY}</div>',
    ],
)
def test_main_text_stays(page):
    assert text(page) == TEXT


def test_titles_and_formulas_stay():
    assert text(f'<div class="article-header"><h1>Title</h1></div>{STORY}') == f"Title {TEXT}"
    assert text("<p>Here <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='tex'>x=1</annotation></math> holds.</p>") == "Here x=1 holds."


@pytest.mark.parametrize(
    "more",
    [
        "<nav>{0}{0}{0}{0}{0}</nav>", "<div class='comments'>{0}{0}{0}{0}{0}{0}</div>", "<div hidden>{0}{0}{0}{0}{0}</div>", "<div style='color:red; display : none'>{0}{0}{0}{0}{0}{0}</div>", "<footer>{0}{0}{0}{0}{0}</footer>",
        "<div class='ad'>buy</div>", "<div class=\"menu\" title=\"a > b\">Home</div>", "<aside>Also</aside>", "<div id=sidebar>{0}</div>", "<div class='site-header'>Host</div>", "<form>Search <button>go</button></form>", "<script>if (a < b) {{}}</script>", "<style>p {{}}</style>",
    ],
)
def test_furniture_goes(more):
    assert text(STORY + more.format("<p>Something else that is not the story at all.</p>")) == TEXT


def test_an_unclosed_script_ends_the_page():
    assert text(f"{STORY}<script>var x = '<p>no</p>'") == TEXT
