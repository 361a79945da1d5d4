"""Plain pages are cut by one expression and read as the parser reads them."""

import random

from tessella.operators.markup import Writer, plain_tokens, read_page

PARTS = ["<table>", "</table>", "<tr>", "</tr>", "<td colspan='2'>", '<td rowspan="3">', "</td>", "<TH>", "</th>", "<caption>", "</caption>", "<p>", "</p>",
         "x y", " | ", "\n", "<ul>", "<li>", "</ul>", "<h2>", "<br>", "</div>", '<div class="topicBody">', "&amp;", "<!-- a -->", "<br/>", "<a href=x>",
         "<script>", "</script>", "<", "a<b", "</td x='1'>", "<img src='a' alt=''>"]


def _parsed(html):
    writer = Writer()
    writer.feed(html)
    writer.close()
    return writer


def test_plain_pages_equal_the_parser():
    rng, plain = random.Random(6), 0
    for i in range(4000):
        html = "".join(rng.choices(PARTS[:23] if i % 2 else PARTS, k=rng.randrange(14)))
        want, got, grids = _parsed(html), read_page(html), read_page(html, grids_only=True)
        assert got.markdown() == want.markdown() and got.grids == want.grids == grids.grids, html
        plain += plain_tokens(html) is not None
    assert 1500 < plain < 4000


def test_a_plain_table_does_without_the_parser(monkeypatch):
    def never(self, data):
        raise AssertionError

    monkeypatch.setattr(Writer, "feed", never)
    page = read_page("<table><tr><th>a</th><th>b</th></tr><tr><td rowspan='2'>1</td><td>2</td></tr><tr><td>3</td></tr></table>", grids_only=True)
    assert page.grids[0].lines == [["a", "b"], ["1", "2"], ["1", "3"]]


def test_what_is_not_plain():
    for html in ("a &lt; b", "<!-- x -->", "<a href=x>", "<br/>", "<script>1</script>", "<p", "</p x='1'>", "<p class>"):
        assert plain_tokens(html) is None
