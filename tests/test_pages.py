"""Page text: elements dropped with all they hold, links kept, character references."""

from __future__ import annotations

import html as standard
import time

import pytest

from linkcurate.functions import html


@pytest.mark.parametrize("page,want", [
    ('x<div class="cookie"><div>x</div> accept all</div>y', "xy"),
    ('<p class="cookie">a<p>b</p>c', "<p>b</p>c"),
    ('<div id="layers">a</div><span class=popup>q</span>z<img class="banner">t', "zt"),
    ('<div class="a"><div class="xconsent y">k<b>l</b></div>m</div>n < 5 <x', '<div class="a">m</div>n < 5 <x'),
    ('<div class="cookie">never <i>closed</i>', '<div class="cookie">never <i>closed</i>'),
    ('<DIV CLASS="banner">g</DIV>h<p data-class="cookie">stay</p>', 'h<p data-class="cookie">stay</p>'),
    ('<div class="Cookie">case counts</div><div id="popup">not an id</div>', '<div class="Cookie">case counts</div><div id="popup">not an id</div>'),
    ('<div class="a signup-prompt"><div class="cookie">both</div></div><div class="popup">again</div>.', "."),
    ("", ""),
])
def test_clutter_goes_with_nested_elements(one, page, want):
    assert one(html.strip_clutter, page) == want


def test_elements_dropped_by_name(one):
    assert one(lambda c: html.strip_clutter(c, dropped=("nav", "head")), "<nav><ul><nav>a</nav></ul></nav>b<header>h</header><head>x</head>") == "b<header>h</header>"


@pytest.mark.parametrize("page,want", [
    ('<p>See <a href="http://x.y/z?a=1&amp;b=2">the <b>page</b></a>, <a name=q>anchor</a>.</p>', "See [the page](http://x.y/z?a=1&b=2), anchor."),
    ('<a class=k href=/rel>rel</a> <a href="/r"><img src=1></a>!', "[rel](/rel) !"),
    ('<a href="u">one <a href="v">two</a> end', "one [two](v) end"),
    ("<table><tr><td>1</td><td>2</td></tr></table>", "1 2"),
    ("no markup", "no markup"),
])
def test_links_keep_their_target(one, page, want):
    assert one(html.main_text, page) == want


def test_links_can_be_left_out(one):
    assert one(lambda c: html.main_text(c, links=False), '<a href="u">w</a>') == "w"


def test_references_are_those_of_the_standard(one):
    texts = ["a &amp; b &lt;c&gt; &#65;&#x42; &#00000065; &copy 2 &notit; &foo; &amp;lt; & &; &comma; &#0; &#99999999999;", "&#150; &#xD800; &NotEqualTilde;",
             "&&amp;&", "&", "", "&#x1F600; &euro;&#128;", "&CounterClockwiseContourIntegral;"]
    assert one(html.unescape, *texts) == [standard.unescape(x) for x in texts]


def test_long_pages_take_time_in_proportion(one):
    page = '<div class="cookie">x</div><p>' * 5000 + "&amp;" * 20_000 + '<a href="u">w</a> <a' * 5000 + "<div>" * 20_000 + "</div>" * 20_000
    start = time.time()
    assert len(one(html.main_text, page)) > 20_000
    assert time.time() - start < 60
