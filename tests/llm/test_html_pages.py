"""Hand-labelled pages of foreign shape, and broken pages in time that grows with their length alone."""

import time

import pytest

from graphloom.llm import html_text

#: (page, main text as a reader sees it).
PAGES = [
    ("<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>News</a></li></ul></nav>Intro text of the page that says what it is about, at some length. <p>First paragraph of the article, which is long enough.</p>"
     "<p>Second one, also with some words.</p><footer>&copy; Me</footer></body></html>",
     "Intro text of the page that says what it is about, at some length.\nFirst paragraph of the article, which is long enough.\nSecond one, also with some words."),
    ("<main><h1>Title here</h1><details><summary>Read the summary</summary><p>Inside details, a paragraph of text.</p></details><figure><img src=x><figcaption>A caption below the picture</figcaption></figure><p>Closing words of the story.</p></main>",
     "Title here\nRead the summary\nInside details, a paragraph of text.\nA caption below the picture\nClosing words of the story."),
    ("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> as we know, and <object data=x>fallback words</object> too.</p><p>More of it follows here.</p></article>", "Energy is E=m as we know, and fallback words too.\nMore of it follows here."),
    ("Just text without any block.", "Just text without any block."),
    ("<div class=wrap><div class=sidebar><h3>Related</h3><ul><li><a href=/>One</a></li></ul></div>Lead text directly in the wrapper, which belongs to the article and runs on for a while. <p>The body of the article, with a few sentences. It goes on.</p></div>",
     "Lead text directly in the wrapper, which belongs to the article and runs on for a while.\nThe body of the article, with a few sentences. It goes on."),
    ("<article><ul><li>Point one of the list<ul><li>nested point</li></ul>and its end, after the nested list</li><li>Point two</li></ul><p>Text below the list.</p></article>",
     "Point one of the list\nnested point\nand its end, after the nested list\nPoint two\nText below the list."),
    ("<body><div id=cookie>We use cookies <button>OK</button></div><article><h1>A</h1>Loose text in the article.<p>Para.</p>Loose tail text in the article.</article></body>", "A\nLoose text in the article.\nPara.\nLoose tail text in the article."),
    ("<article><h2>Numbers</h2><pre>a  b\nc</pre><p>Caf&eacute; &amp; more&#33; A text that is long enough to be one.</article>", "Numbers\na b c\nCafé & more! A text that is long enough to be one."),
]


@pytest.fixture(scope="module")
def model():
    return html_text.train()


def test_hand_labelled_pages(model):
    got = html_text.extract([p for p, _ in PAGES], model)
    right = sum(a == b for a, (_, b) in zip(got, PAGES, strict=True))
    scores = []
    for a, (_, b) in zip(got, PAGES, strict=True):
        x, y = a.split(), b.split()
        both = sum(min(x.count(w), y.count(w)) for w in set(x))
        scores.append(2 * both / (len(x) + len(y)))
    assert right >= len(PAGES) - 1 and min(scores) > 0.9, [(a, b) for a, (_, b) in zip(got, PAGES, strict=True) if a != b]


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</b></section>" * 50_000, "<button>x" * 50_000, "<li>" * 100_000, "<ul><li><ul>" * 30_000 + "</ul>" * 1000, '<a title="x>' * 50_000, "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000])
def test_broken_pages_are_read_in_linear_time(page):
    began = time.process_time()
    html_text.parse(page)
    assert time.process_time() - began < 4


def test_a_very_long_page_is_kept_whole(model):
    lines = [f"Paragraph number {i} of a long article, with some words in it." for i in range(3000)]
    page = "<html><body><nav><a href=/>x</a></nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article></body></html>"
    assert html_text.extract([page, "", page], model) == ["\n".join(lines), "", "\n".join(lines)]
