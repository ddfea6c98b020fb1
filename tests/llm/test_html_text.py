import html
import random
import re

import pytest

from tallyspan.llm import html_text
from tallyspan.llm.html_text import _every_name, best_run, extract, learn_weights, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">One</a></li><li><a>Two</a></li></ul></nav>
<div class="ad">Buy the cheap things now.</div><article><h1>Title &amp; more</h1><p>First  para with <b>bold</b>ed words,\n and enough of them to read.<br>Next line.</p><p>Second&nbsp;para closes the text &lt;here&gt;.</article><footer>&copy; someone, all the rights.</footer></body></html>"""
PLAIN = """<html><body><header><a href=x>Home</a> <a href=y>About us</a></header><div id="nav-menu"><ul><li><a>One</a></li><li><a>two</a></li></ul></div>
<div class="cookie-notice">We use cookies to improve this site and you must accept them all now.</div>
<div class="content"><h1>The Title</h1><p>A first paragraph with <b>many</b> words &amp; more, so that it is long enough.<p>Second one, with a <a href="q">link in it</a> and further words to read.</p>
<div class="ad">Buy this now please it is cheap</div><p>Third para ends the text of the article.</p></div>
<section class="comments"><p>I liked this article very much indeed, thank you for writing it.</p></section><form><label>Email</label><input name=q></form>
<aside><p>Related stuff which is not part.</p></aside><footer>Copyright 2020 some company here</footer></body></html>"""
BODY = "The Title A first paragraph with many words & more, so that it is long enough. Second one, with a link in it and further words to read. Third para ends the text of the article."


@pytest.fixture(scope="module")
def weights(spark):
    return learn_weights(spark.createDataFrame([(n, PAGE) for n in range(20)], "page_id long, html string"))


def test_pages(weights):
    assert main_text(PAGE, weights) == "Title & more First para with bolded words, and enough of them to read. Next line. Second para closes the text <here>."
    assert main_text(PLAIN, weights) == BODY
    assert main_text(PLAIN.replace('<div class="content">', "<main>").replace("of the article.</p></div>", "of the article.</p></main>"), weights) == BODY


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p></p>", ""), ("only words &amp", "only words &"), ('<p class="x" data-a="1>2">hello there, "friend', 'hello there, "friend'), ("<p>cut <b", "cut"), ("<script>if (a<b) {}", ""), ("a<!-- no --> b<![CDATA[x]]>", "a b")])
def test_odd_pages(weights, page, text):
    assert main_text(page, weights) == text


def test_best_run_is_the_best():
    values = [1, -2, 3, 4, -1, 2, -6, 5]
    sums = {(a, b): sum(values[a:b]) for a in range(8) for b in range(a + 1, 9)}
    a, b = best_run(values)
    assert sums[a, b] == max(sums.values())
    assert best_run([-1.0, -2.0]) == (0, 0)
    assert best_run([]) == (0, 0)


def test_rows(spark, weights):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (None, None, None, None, None), (3, "v", "<p>" + "word " * 100_000, None, None)]
    got = extract(spark.createDataFrame(rows, schema), weights).collect()
    assert sorted(r.n_chars for r in got) == sorted([0, len(main_text(PAGE, weights)), len(main_text(PAGE, weights)), 499_999])
    assert extract(spark.createDataFrame([], schema)).count() == 0


def marked_text(page):
    """By hand: what is between the tags of the page's article element."""
    body = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1])
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())


def in_common(a, b):
    a, b = a.split(), b.split()
    return len(set(a) & set(b)) / max(1, len(set(a) | set(b)))


def test_given_pages_without_mark_and_without_usual_names(spark, monkeypatch):
    """The scan over learned scores alone finds what the mark says; without the scan it does not."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    known = learn_weights(pages, usual=False)
    monkeypatch.setattr(html_text, "is_usual", lambda context: False)
    rows = [r.html for r in pages.collect()]
    bare = [re.sub(r"</?article>", "", x) for x in rows]
    assert all(main_text(x, known) == marked_text(x) for x in rows)
    assert sum(in_common(main_text(b, known), marked_text(x)) for b, x in zip(bare, rows)) >= 0.95 * len(rows)
    # a line over the menu, shorter than the content, is cut off by the scan alone
    lines = [(b.replace("<nav>", "<p>A line over the menu.</p><nav>"), marked_text(x)) for b, x in zip(bare, rows) if len(marked_text(x).split()) > 20]
    assert len(lines) > 20
    assert all(main_text(b, known) == text for b, text in lines)
    monkeypatch.setattr(html_text, "best_run", lambda values: (0, len(values)))
    assert not any(main_text(b, known) == text for b, text in lines)


def test_contexts_that_no_list_names_are_learned(spark):
    page = "<body><div class=zork>Words of a box that has an odd name here.</div><article><p>Text of the page with some more words in it.</p></article></body>"
    known = learn_weights(spark.createDataFrame([(n, page) for n in range(20)], "page_id long, html string"))
    other = "<body><p>The first part of another page, which has no mark.</p><div class='a zork'>Words of such a box.</div><p>The second part ends the page, also with words.</p></body>"
    assert main_text(other, known) == "The first part of another page, which has no mark. The second part ends the page, also with words."


def test_deep_and_unclosed_pages_take_linear_time(weights):
    assert main_text("<div class=x>" * 50_000 + "end of it", weights) == "end of it"
    assert main_text("<p><b>word" * 50_000, weights).count("word") == 50_000
    assert main_text("</div>" * 50_000 + "<p>end of it", weights) == "end of it"


MARKED = "<html><head><meta charset=utf-8><title>T</title><body><nav><a>Menu</a></nav><div class='page-with-sidebar'><article><h1>Heading</h1>{}</article></div><footer>Copyright of the site.</footer>"


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<p>The formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds always.</p>", "The formula x=1 holds always."),
        ("<p>A picture:</p><svg><title>no</title><text>drawn label</text></svg><object>Shown instead.</object>", "A picture: drawn label Shown instead."),
        ("<p hidden>Folded away at first.</p><p aria-hidden=true>Not read aloud.</p><p style='display: none'>Shown by a click.</p>", "Folded away at first. Not read aloud. Shown by a click."),
        ("<div class=legal>This whole article on legal matters.</div><div class='related-work'>We discuss related work.</div>", "This whole article on legal matters. We discuss related work."),
        ("<header class=byline>By someone.</header><p data-x='hidden' class=tags>Of tags.</p>", "By someone. Of tags."),
        ("<table><tr><td>1</td><td>2</td></tr><tr><td></td><td>3</td></tr></table>" + "<br>" * 50 + "<p>End.", "1 2 3 End."),
        ("<p>Long enough.</p><div class=ad>Buy these many cheap things now, please.</div><p>End.</p>", "Long enough. End."),
        ("<p>Text.</p><nav>In this page</nav><aside>Beside it</aside><form>Your name</form><div class=cookie-notice>We use them.</div><article class=comment>Nice!</article><p>End.</p>", "Text. End."),
    ],
)
def test_what_stands_inside_the_mark_is_kept(weights, inner, text):
    assert main_text(MARKED.format(inner), weights) == f"Heading {text}"


def test_any_name_around_paragraphs_of_an_article(weights):
    random.seed(4)
    names = [n for n in _every_name() if n[0] == "." and not html_text.OF_KIND.match(n)] + [f".name{n}" for n in range(30)]
    for _ in range(200):
        parts = [(random.choice(names)[1:], f"Sentence {n} of it.") for n in range(random.randint(1, 9))]
        inner = "".join(f"<div class='{a} x'><p id={a}>{text}</p></div>" for a, text in parts)
        assert main_text(MARKED.format(inner), weights) == " ".join(["Heading", *(text for _, text in parts)])


def test_hidden_text_outside_the_mark_is_left_out(weights):
    page = "<body><div hidden>Words that nobody sees on the page.</div><p>The text of the page with enough words in it.</p></body>"
    assert main_text(page, weights) == "The text of the page with enough words in it."


def test_long_attributes_take_linear_time(weights):
    assert main_text("<p " + "a " * 200_000 + " " * 200_000 + ">words", weights) == "words"
