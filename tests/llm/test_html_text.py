import pytest

from linkloom.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style></head><body class=c>
<header class="site-header">Site <a href="/">Home</a></header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div>
<main><article><header><h1>The &Uuml;ber title</h1></header>
<p>First&nbsp;  paragraph with
 <b>bold</b> text.<p>Second <a href=x>link</a> &amp; more.
<div class="ad">Buy!</div><ul><li>one<li>two</ul><script>var a = "<p>no</p>";</script>
<form><input value=v>Sign up</form><table><tr><td>cell<td>next</table></article></main>
<aside>Side</aside><section id="comments"><p>Reader says a lot of things here</p></section>
<footer>Foot</footer></body></html>"""
TEXT = "The Über title\n\nFirst paragraph with bold text.\n\nSecond link & more.\n\none\n\ntwo\n\ncell\n\nnext"


def test_article_without_the_rest(spark):
    rows = [(k, f"https://h.org/{k}", PAGE) for k in range(3)] + [(9, None, None), (10, "x", ""), (11, "https://h.org/z", "<p>only &lt;this&gt;"), (12, "https://o.org/", "<div><p>open")]
    out = {r["page_id"]: r for r in H.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out[0]["text"] == out[2]["text"] == TEXT and out[0]["n_chars"] == len(TEXT)
    assert out[9]["text"] == out[10]["text"] == "" and out[9]["n_chars"] == 0
    assert out[11]["text"] == "only <this>" and out[12]["text"] == "open"


def test_hosts_vote_for_their_path(spark):
    good = '<body><div class="post1"><p>A long enough text of the article itself.</p></div><div class="x"><p>short</p></div></body>'
    odd = '<body><div class="post2"><p>Tiny.</p></div><div class="x"><p>A box that is longer than the article on this page.</p></div></body>'
    rows = [(k, "https://h.org/", good) for k in range(4)] + [(5, "https://h.org/odd", odd)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = H.host_paths(pages).first()
    assert (path["host"], path["path"], path["votes"]) == ("h.org", ">body>div.post", 4)
    out = {r["page_id"]: r["text"] for r in H.main_text(pages).collect()}
    assert out[5] == "Tiny."  # the winning path of the host, not the longest box


def test_malformed_pages_end():
    for page in ("<", "<p", "<!--", "<script>", "<a href='x", "&#xZZ; &bogus; &amp", "</p></div>", "<p>" * 3000, "<b <p>x", "a" * 100_000):
        assert isinstance(H.extract(page, None), str)
    assert H.extract("a &amp; b &lt", None) == "a & b <"


def test_empty_table_and_extra_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "y")], "page_id bigint, url string, html string, winner string")
    assert H.main_text(pages).first()["text"] == "x"
    assert H.main_text(pages.where("false")).count() == 0


def article(inside, wrapper="<div>{}</div>", rest=""):
    body = "<article><h1>Title</h1><p>The first paragraph of the article, of some length.</p>" + inside + "</article>"
    return f"<html><body>{wrapper.format(body)}{rest}</body></html>"


START = "Title\n\nThe first paragraph of the article, of some length."
GOLDEN = [
    # parts of an article whose names only hold a word of the list
    (article('<div class="notice-board"><p>Board.</p></div><section class="related-work"><p>Others.</p></section><div id="search-algorithms">Trees.</div>'), START + "\n\nBoard.\n\nOthers.\n\nTrees."),
    (article("<p>End.</p>", '<div class="col-md-8 hidden-print post category-social tag-search has-sidebar no-sidebar">{}</div>'), START + "\n\nEnd."),
    # a page that is one form, with controls and a small form inside
    (article('<button>Go</button><select><option>x</select><form class="x"><label>Mail</label><input></form><p>End.</p>', '<form method="post">{}</form>'), START + "\n\nEnd."),
    ("<body><form><div><p>A page that is all in one form, as some servers write them.</p><textarea>t</textarea></div></form></body>", "A page that is all in one form, as some servers write them."),
    # wrappers that are named after what stands beside the article
    (article("", '<div class="sidebar-left">{}</div>', '<div class="sidebar-left"><p>Beside.</p></div>'), START),
    (article("", '<div id="menu-page"><main>{}</main></div>'), START),
    # what is never part of it, however long
    (article("", rest='<section class="article-comments">' + "<article class=comment><p>A reader writes more than the author has.</p></article>" * 30 + "</section>"), START),
    (article("<div class='ad'>Buy</div><div class=adSlot2>Now</div><aside>Side</aside><div hidden>h</div><p style='display: none'>n</p><div aria-hidden=true>a</div>"), START),
    (article("", rest='<div class="cookie-notice">' + "<p>We use cookies, and say so at length.</p>" * 20 + "</div><div id=siteFooter>Imprint</div><div role=navigation>Go</div><div class='related posts'>More</div>"), START),
    # a header of the page and one of the article
    ('<body><header><h1>Site</h1></header><div class="top"><p>Top</p></div>' + article("")[12:].replace("<h1>Title</h1>", "<header class=header><h1>Title</h1></header>"), START),
    # white space, references, line breaks, preformatted text and nested lists
    (article("<p> a&nbsp;&nbsp;b\t\n c<br>d&#233;&lt;e&gt; <i>f</i>g</p><ul><li>one<ul><li>two</ul><li>three</ul><pre>x\n  y</pre>"), START + "\n\na b c dé<e> fg\n\none\n\ntwo\n\nthree\n\nx y"),
]


@pytest.mark.parametrize("k", range(len(GOLDEN)))
def test_golden_pages(k):
    page, expected = GOLDEN[k]
    assert H.extract(page, None) == expected


def test_tied_votes_and_repeated_rows(spark):
    """Two paths with as many votes: the first in order wins for all, however often a row is repeated."""
    one, two = ('<body><div class="{}"><p>A text that is long enough for its container to be chosen.</p></div></body>'.format(c) for c in "ab")
    rows = [(1, "http://h/", one)] * 3 + [(2, "http://H/", two)] * 3 + [(3, None, one), (4, None, two)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {(r["host"], r["path"], r["votes"]) for r in H.host_paths(pages).collect()} == {("h", ">body>div.a", 3), ("", ">body>div.a", 1)}
    out = H.main_text(pages).collect()
    assert len(out) == 8 and all(r["text"].startswith("A text") for r in out)
