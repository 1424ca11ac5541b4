import time

import pytest

from paperledger.llm import pages

MB = 1 << 20

SHAPES = {
    "tags without an end": "<a ",
    "open quotes": "<a \"",
    "quotes of both kinds": "<a '\"<b \"'",
    "names without an end": "<a",
    "nested branches": "<div>x ",
    "inline elements left open": "<b><div></div>",
    "declarations without an end": "<!",
    "end tags of nothing": "</div></b>",
    "end tags of scripts without an end": "<script></script ",
    "items": "<ul><li>one<li>two",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_a_megabyte_of_broken_markup_takes_seconds(shape):
    start = time.monotonic()
    for source in (SHAPES[shape] * (MB // len(SHAPES[shape])), SHAPES[shape] * (MB // len(SHAPES[shape])) + '"<>', "<div>" * 50_000 + SHAPES[shape] * 50_000):
        page = pages.Page(source)
        page.spare(frozenset(page.looks))
        page.text()
    assert time.monotonic() - start < 60


def test_broken_tags_are_text():
    assert pages.Page("a <b c").text() == "a <b c" and pages.Page("x < y <3 </> z").text() == "x < y <3 </> z"
    assert pages.Page("<a \"b>c").text() == "c"  # a quote without a partner is part of a tag that nothing opens inside
    assert pages.Page("<a \"b <p>c</p>").text() == "<a \"b\nc"
    assert pages.Page("<a title=\"<p>\">b</a>").text() == "b" and pages.Page("<i <b>c").text() == "c"
    assert pages.Page("a<script>b</script c").text() == "a" and pages.Page("a<!-- b").text() == "a"


def test_numbers_of_characters_may_be_long():
    zeros = "0" * 10_000
    assert pages.Page(f"&#{zeros}65;b").text() == "Ab" and pages.Page(f"&#{'9' * 10_000};b").text() == "�b"
    assert pages.Page(f"&#x{zeros}41;b&#65;&amp;#65;").text() == "AbA&#65;"


def test_equal_texts_of_a_branch_have_equal_hashes():
    one = pages.Page("<div class=a>one<p>two</p></div><div class=a>three</div>")
    two = pages.Page("<div class=a><p>one</p>two</div><div class=a><h1>three</h1></div>")
    other = pages.Page("<div class=a>two<p>one</p></div><div class=a>three</div>")
    assert one.texts == two.texts != other.texts and one.looks != two.looks
    assert [texts for _, texts in one.branches.values()] == [["one", "two", "three"]]
