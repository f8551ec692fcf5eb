"""Markup that names furniture and markup that does not, long repeated lines, odd tables."""

import random
import time

import pytest

from squadframe.llm import html_text

TEXT, LOST = html_text.PLAIN, html_text.FURNITURE


@pytest.mark.parametrize("attributes, lost", [
    ('title="The hidden cost"', False), ("alt='hidden treasure'", False), ('data-x="display: none"', False), ('data-hidden="1"', False), ('aria-hidden="false"', False), ('style="color: red"', False),
    ("hidden", True), ('hidden=""', True), ("HIDDEN class=x", True), ('aria-hidden="true"', True), ("aria-hidden=true", True), ('style="display:none"', True), ("style='color: red; display : none;'", True), ('style="visibility:hidden"', True),
    ('class="content has-sidebar"', False), ('class="share-price"', False), ('class="search-term"', False), ('id="related-work"', False), ('class="no-ads"', False), ('class="commentary"', False), ('class="content"', False),
    ('class="ad"', True), ('class="text ads"', True), ('class="site-footer"', True), ('id="main-nav"', True), ('class="comment-list"', True), ('class="cookie_banner"', True), ('class="ad-slot-3"', True), ('class="related-posts"', True), ("class=sidebar", True), ('role="navigation"', True), ('role="presentation"', False), ('data-class="ad"', False),
])
def test_attributes_name_furniture(attributes, lost):
    page = f"<body><div>before</div><div {attributes}>inside</div><p>after</p></body>"
    kinds = dict(html_text.blocks(page))
    assert kinds == {"before": TEXT, "inside": LOST if lost else TEXT, "after": TEXT}
    assert ("inside" in dict(html_text.blocks(f"<article><p {attributes}>inside</p></article>"))) and (dict(html_text.blocks(f"<article><p {attributes}>inside</p></article>"))["inside"] == LOST) == lost


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@pytest.mark.parametrize("pairs", [0, 5, 200_000])
def test_common_lines_are_a_longest_common_subsequence(monkeypatch, pairs):
    monkeypatch.setattr(html_text, "PAIRS", pairs)
    r = random.Random(3)
    for n in (0, 1, 2, 7, 30, 60):
        for letters in (1, 2, 5, 40):
            for _ in range(6):
                a, b = [r.randrange(letters) for _ in range(n)], [r.randrange(letters) for _ in range(r.randrange(n + 3))]
                at = html_text.common_lines(a, b)
                assert at == sorted(set(at)) and len(at) == plain_lcs(a, b)
                rest = iter(b)
                assert all(a[i] in rest for i in at)  # in the same order in b


def test_many_repeated_lines_take_no_square_time():
    began = time.time()
    assert len(html_text.common_lines([7] * 30_000, [7] * 30_000)) == 30_000
    assert len(html_text.common_lines([7] * 30_000, [8] + [7] * 20_000)) == 20_000
    mixed = [i % 3 for i in range(30_000)]
    assert len(html_text.common_lines(mixed, mixed[::-1])) >= 19_000
    assert time.time() - began < 30


def test_odd_tables(spark):
    schema = "page_id int, url string, html string, text string, key int, lines int, gone string"
    odd = [(1, "http://a/x", "<p>same</p><p>one</p>", "clash", 1, 1, "x"), (1, "http://a/x", "<p>same</p><p>one</p>", "clash", 2, 2, "y"), (2, "http://a/y", "<p>same</p><p>two</p>", None, None, None, None), (3, None, None, None, None, None, None), (None, "", "", None, None, None, None)]
    odd.append((4, "http://b/", "<p>" + "long text " * 40_000 + "</p>" + "<p>again</p>" * 3_000, None, None, None, None))
    odd.append((5, "http://b/2", "<p>other</p>" + "<p>again</p>" * 3_000, None, None, None, None))
    got = html_text.main_text(spark.createDataFrame(odd, schema)).collect()
    texts = sorted((x["page_id"] or 0, x["text"]) for x in got)
    assert [t for t in texts if t[0] < 4] == [(0, ""), (1, "one"), (1, "one"), (2, "two"), (3, "")]
    assert dict(texts)[4] == ("long text " * 40_000).strip() and dict(texts)[5] == "other"
    assert html_text.main_text(spark.createDataFrame([], schema)).count() == 0
