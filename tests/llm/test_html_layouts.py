"""HTML extraction on hand-written pages in the manner of common systems, hostile pages, and the field against enumeration."""

import itertools
import time

import numpy as np
import pytest

from pagemill.llm import html_extract
from pagemill.llm.html_blocks import blocks
from pagemill.llm.html_extract import Field

LONG = "The river rose for three days before the old bridge gave way, and nobody in the valley had slept since."
MORE = "By the fourth morning the water was down again, though the mud stayed until well into the summer."
LAST = "What remains of the bridge can be seen from the mill; the town has not decided what to build there."

#: (name, page, main text)
PAGES = [
    (
        "weblog",
        f"""<body class="home single postid-12 has-sidebar"><div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">Valley News</a></p>
        <nav id="site-navigation" class="main-navigation"><ul id="primary-menu" class="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header>
        <div id="content" class="site-content"><main id="main" class="site-main"><article id="post-12" class="post type-post category-floods"><h1 class="entry-title">The bridge</h1>
        <div class="entry-content"><p>{LONG}</p><p class="has-text-align-center">{MORE}</p><h2>After</h2><p>{LAST}</p></div></article>
        <div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><p>I was there and it was loud. Very loud.</p></article></li></ol>
        <form class="comment-form"><p>Your address will not be shown.</p></form></div></main></div>
        <aside id="secondary" class="widget-area"><section class="widget"><h2 class="widget-title">Recent</h2><ul><li><a href="/x">Other floods of the year</a></li></ul></section></aside>
        <footer id="colophon" class="site-footer"><div class="site-info">Proudly made in the valley.</div></footer></div></body>""",
        ["The bridge", LONG, MORE, "After", LAST],
    ),
    (
        "news",
        f"""<div class="cookie-consent-banner" role="dialog"><p>We and our partners store information on a device. You may change your mind at any time.</p><button>Accept</button></div>
        <div class="ad-slot ad-top">Advertisement</div><main><article class="story-body"><h1>Bridge gives way</h1><p class="lead story-intro">{LONG}</p>
        <div class="share-tools social"><a href="#">Mail</a> <a href="#">Print</a></div><p class="print">{MORE}</p><div class="ad-slot">Buy a boat today. It floats, and it is cheap.</div><p>{LAST}</p>
        <div class="related"><h3>Related</h3><ul><li><a href="/1">The flood in pictures</a></li><li><a href="/2">Who pays for the bridge</a></li></ul></div></article></main><footer><p>&copy; Valley News. All rights reserved.</p></footer>""",
        ["Bridge gives way", LONG, MORE, LAST],
    ),
    (
        "manual",
        f"""<div class="related-nav"><ul class="breadcrumb"><li><a href="/">Docs</a></li></ul></div><div class="sidebar" role="navigation"><ul class="toc"><li><a href="#a">Start</a></li><li><a href="#b">Use</a></li></ul></div>
        <main role="main"><h1>Measuring levels</h1><p>{LONG}</p><div class="warning"><p>Do not wade into running water. It is faster than it looks.</p></div><pre>level --unit m</pre><table class="alert-levels"><tr><td>one</td><td>calm</td></tr></table>
        <p class="message">{MORE}</p><ol><li>Read the gauge.</li><li>Write it down.</li></ol></main><footer role="contentinfo">Made with a tool.</footer>""",
        ["Measuring levels", LONG, "Do not wade into running water. It is faster than it looks.", "level --unit m", "one", "calm", MORE, "Read the gauge.", "Write it down."],
    ),
    (
        "encyclopedia",
        f"""<div id="content" class="mw-body" role="main"><h1 id="firstHeading">River bridge</h1><div id="bodyContent"><p>{LONG} <math><mi>h</mi><mo>=</mo><mn>3</mn></math> was the level.</p>
        <h2>History</h2><p>{MORE}</p><ul><li>Mill bridge</li><li>Stone bridge</li></ul><p>{LAST}</p></div></div><div id="navigation" role="navigation"><ul><li><a href="/r">Random page</a></li><li><a href="/c">Changes</a></li></ul></div>
        <div id="footer" role="contentinfo"><ul><li>This page was last edited in May.</li></ul></div>""",
        ["River bridge", f"{LONG} h=3 was the level.", "History", MORE, "Mill bridge", "Stone bridge", LAST],
    ),
    (
        "old table layout",
        f"""<table width=100%><tr><td class=nav><a href=a>Home</a> | <a href=b>Flood</a> | <a href=c>Mail</a></td></tr><tr><td><div class=content><h1>The bridge</h1><p>{LONG}<p>{MORE}<p>{LAST}</div></td></tr>
        <tr><td class=footer>Best seen at 800 x 600.</td></tr></table>""",
        ["The bridge", LONG, MORE, LAST],
    ),
    (
        "magazine with parts that mislead",
        f"""<nav><a href="/">Start</a></nav><article><h1>Poll finds support</h1><p class="poll">{LONG}</p><section class="contact"><h2>Contact with water</h2><p>{MORE}</p></section><div class="popular">{LAST}</div>
        <noscript><p>A table of the levels stood here in the printed paper, day by day.</p></noscript><object data="x.swf"><p>The film shows the water under the arch.</p></object></article>
        <section class="reader-comments"><h3>Readers say</h3><p>{LONG}</p></section><aside><p>{MORE}</p></aside>""",
        ["Poll finds support", LONG, "Contact with water", MORE, LAST, "A table of the levels stood here in the printed paper, day by day.", "The film shows the water under the arch."],
    ),
]


@pytest.mark.parametrize("name, page, expected", PAGES, ids=[x[0] for x in PAGES])
def test_hand_written_layouts(name, page, expected):
    assert html_extract.main_text(html_extract.trained(), f"<!DOCTYPE html><html><head><title>t</title></head>{page}</html>").split("\n") == expected


@pytest.mark.parametrize("word", "legal alert-levels warning popular comment-free contact tools print poll story top discussion message ad-free has-sidebar".split())
def test_one_class_word_drops_no_part_of_an_article(word):
    parts = [f'<p class="{word}">{LONG}</p>', f'<div class="{word}">{MORE}</div>', f'<div id="{word}"><p>{LAST}</p></div>']
    page = f"<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>First of all.</p>{''.join(parts)}<p>Last of all.</p></article><footer>x</footer></body></html>"
    assert html_extract.main_text(html_extract.trained(), page).split("\n") == ["Title", "First of all.", LONG, MORE, LAST, "Last of all."]


def test_markup_as_browsers_read_it():
    field = html_extract.trained()
    article = lambda x: html_extract.main_text(field, f"<article><h1>T</h1><p>{LONG}</p>{x}</article>").split("\n")[2:]
    assert article("<p>a <script src=https://a.b/x/>var leak=1;</script>b, and so on it goes.</p>") == ["a b, and so on it goes."]
    assert article("<p>Let <math>x</math> be. An <object data=u>object</object> and <svg><title>i</title><path d='M0'/><text>svg</text></svg> stay.</p>") == ["Let x be. An object and svg stay."]
    assert article("<p>one <a href=/b/>two</a> <br/>three it is.<p>four <img src=x data-y='>'> five it is.") == ["one two three it is.", "four five it is."]
    assert article("<p title=it's>his <b title='\">'>own</b> word here.</p><p>the <!--> next --> one is here.") == ["his own word here.", "the next --> one is here."]
    assert article("<script>never closed <p>x</p>") == []
    assert article("<p>a < b and c</d> &amp;lt; e &notin; f &#x41;.") == ["a < b and c &lt; e ∉ f A."]


@pytest.mark.parametrize(
    "page",
    [
        "<div>x" * 150_000, "<a " * 300_000, '<a x="' * 150_000, "<title></title " * 70_000, "".join(f"<x{i}>t" for i in range(80_000)), "<p><table>" + "<nav>x" * 150_000,
        "<ul>" + "<li><div>x" * 90_000, "<" * 1_000_000, "<!--" * 250_000, "<dl>" + "<dt><b class=ad>x" * 50_000, "<p>" + "x <canvas> " * 80_000, "<x>" * 100_000 + "</p>" * 100_000, f"<p class={'ad-' * 300_000}>x",
    ],
    ids=range(13),
)
def test_hostile_pages_take_linear_time(page):
    field = html_extract.trained()
    begin = time.time()
    html_extract.main_text(field, page)
    assert time.time() - begin < 30


def path_score(field, x, y):
    s = field.start[y[0]] + sum(field.w @ x[i] for i in range(len(y)) if y[i])
    return s + sum(field.trans[a, b] for a, b in itertools.pairwise(y))


def random_field(r, n):
    field = Field(n)
    field.w, field.trans, field.start = r.normal(size=n), r.normal(size=(2, 2)), r.normal(size=2)
    return field


def test_decoding_is_the_best_of_all_labellings():
    r = np.random.default_rng(0)
    for _ in range(200):
        n = int(r.integers(1, 9))
        field, x = random_field(r, 5), (r.random((n, 5)) < 0.4).astype(np.float32)
        best = max(path_score(field, x, y) for y in itertools.product((0, 1), repeat=n))
        assert path_score(field, x, field.decode(x).tolist()) == pytest.approx(best, abs=1e-5)
    assert Field(3).decode(np.ones((4, 3), dtype=np.float32)).tolist() == [0, 0, 0, 0]  # ties


def test_gradient_equals_differences_of_the_enumerated_likelihood():
    r = np.random.default_rng(1)
    pages = [((r.random((n, 4)) < 0.5).astype(np.float32), r.integers(0, 2, n)) for n in (1, 2, 4, 6)]
    length = max(len(y) for _, y in pages)
    y, seen = np.zeros((len(pages), length)), np.zeros((len(pages), length), dtype=bool)
    for i, (_, b) in enumerate(pages):
        y[i, : len(b)], seen[i, : len(b)] = b, True
    theta = r.normal(size=4 + 6)

    def field_of(t):
        field = Field(4)
        field.w, field.trans, field.start = t[:4], t[4:8].reshape(2, 2), t[8:]
        return field

    def likelihood(t):
        field, total = field_of(t), 0.0
        for x, labels in pages:
            every = [path_score(field, x, z) for z in itertools.product((0, 1), repeat=len(labels))]
            total += path_score(field, x, labels.tolist()) - np.logaddexp.reduce(every)
        return total

    g, gt, gs = field_of(theta).gradient(np.concatenate([x for x, _ in pages]), y, seen)
    step = 1e-5
    numeric = [(likelihood(theta + step * e) - likelihood(theta - step * e)) / (2 * step) for e in np.eye(10)]
    assert np.allclose(np.concatenate((g, gt.reshape(-1), gs)), numeric, atol=1e-3)
