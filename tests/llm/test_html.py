"""Main text of pages: what markup names, what a site's pages share, and time that follows the length."""

import time

import pytest

from trackweave.llm import html_extract

KEPT = [
    ("<article style='overflow: hidden'><p>kept text</p></article>", "kept text"), ("<div style='visibility: visible; overflow: hidden'>body</div>", "body"),
    ("<p hidden style='color:red'>secret</p>x", "x"), ("<p style='color:red;display : none'>x</p><p hidden=''>z</p><p aria-hidden=true>w</p><p data-x='hidden'>v", "w v"),
    ('<div title="a hidden b">t</div>', "t"), ("<form id=aspnetForm><nav>n</nav><article>a</article>f</form>", "a"), ("<form>f</form><article>a</article>", "a"),
    ("<div class=wrapper id=newsletter><article>a</article></div>", "a"), ("<article class='login'>a</article>", "a"), ("<article>x <section class=discussion>d</section></article>", "x d"),
    ("<article>a<div class='legal'>l</div></article>", "a l"), ("<div class=legal>l</div><p>a", "a"), ("<div class='social-science'>s</div>", "s"), ("<nav><article>n</article></nav>", ""),
    ("<article>a<div class='user-comments'>c</div><div class=cookieBanner>c</div><ul class='commentList'><li>c</ul><div class='fb-share-x'>c</div></article>", "a"),
    ("<article>a</article><article class=comment>c</article>", "a"), ("<div class=related><article>t</article></div><article>a</article>", "a"),
    ("<p>a<div>b</p>c</div>d", "a b c d"), ("<table><tr><td><p>a<td>b</table>c", "a b c"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a b c"), ("<p><table><tr><td><div>a</div></table>b", "a b"),
]


@pytest.mark.parametrize("source,want", KEPT)
def test_names_and_styles(source, want):
    assert html_extract.Page(source).text({}) == want


@pytest.mark.parametrize("source", ["<b>" * 50_000 + "<div>" * 50_000, "<div>x" * 100_000, "<svg><p>a" * 50_000, "<p><table><tr><td>" + "<b>" * 40_000 + "<div>" * 40_000,
                                    "<ul>" + "<li>a" * 100_000, "<i>" * 60_000 + "</b>" * 60_000, "<a " + 'x="' * 200_000, "<!--" * 200_000], ids=range(8))
def test_time_follows_the_length(source):
    begin = time.process_time()
    page = html_extract.Page(source)
    page.text({})
    page.features()
    assert time.process_time() - begin < 12  # a walk over what is open would take minutes


def test_the_tree_cuts_what_pages_share(spark):
    """No name tells the furniture, of which some is in the marked article; without the tree all of it stays."""
    shapes = {
        "plain": "<body><div class=a1>Home News Weather</div><div class=b2><p>{0}</p><p>{1}</p></div><div class=c3><span>All rights of Site</span></div></body>",
        "article": "<body><article><div class=a1>Home News Weather</div><h1>{0}</h1><p>{1}</p><div class=c3><i>Written for Site</i></div></article></body>",
    }
    rows = [(f"{shape}{k}", f"http://{shape}.example/{k}", source.format(f"Title {k} of {shape}", f"Text number {k * 7919} here")) for shape, source in shapes.items() for k in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    for shape in shapes:
        for k in range(20):
            assert got[f"{shape}{k}"] == f"Title {k} of {shape} Text number {k * 7919} here"
    alone = html_extract.Page(rows[0][2]).text({})
    assert alone.startswith("Home News Weather") and alone.endswith("All rights of Site")
    assert "Written for Site" in html_extract.Page(rows[20][2]).text({})
