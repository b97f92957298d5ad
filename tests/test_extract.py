import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.operators.extract import html as H
from linkloom.operators.extract import markdown as MD
from linkloom.operators.extract.css import css_links
from linkloom.operators.extract.linkfinder import is_email_link, plaintext_links
from linkloom.operators.extract.links import extract_links, fragment_index, register
from linkloom.operators.extract.spans import Lines
from linkloom.operators.extract.srcset import srcset_urls
from linkloom.operators.extract.xml import xml_links


def t(links):
    return [x.text for x in links]


def spans(text, links):
    lines = Lines(text)
    return [(x.text, *lines.at(x.offset)) for x in links]


def test_plain_text():
    text = "see http://127.0.0.1/ and (https://a.org/x_(y)).\nftp://f.org/z, me@h.org! \"https://q.org\" <https://b.org> https://c.org/_/"
    assert spans(text, plaintext_links(text)) == [("http://127.0.0.1/", 1, 5), ("https://a.org/x_(y)", 1, 28), ("ftp://f.org/z", 2, 1), ("me@h.org", 2, 16), ("https://q.org", 2, 27), ("https://b.org", 2, 43), ("https://c.org/_/", 2, 58)]
    assert t(plaintext_links("no://, www.x.org, a@b, x@y..z http:// //h.org")) == []
    assert is_email_link("mailto:a@b.org") and is_email_link("a@b.org") and not is_email_link("a@b.org/x")


def test_css():
    css = "@import url('a.css');\nb{background:url( \"c d.png\" )}\ne{f:url(g.png)} h{i:url()} j{k:url(' ')}"
    assert spans(css, css_links(css)) == [("a.css", 1, 9), ("c d.png", 2, 14), ("g.png", 3, 5)]


def test_srcset():
    assert srcset_urls("a.png 1x, b.png 2x") == ["a.png", "b.png"]
    assert srcset_urls("/x,y=1/z.jpg 640w,/q.jpg 750w") == ["/x,y=1/z.jpg", "/q.jpg"]
    assert srcset_urls("a.png (1,2), b.png") == ["a.png", "b.png"]
    assert srcset_urls("") == srcset_urls(", a.png 1x") == srcset_urls("a.png,, 1x") == []


def test_xml():
    feed = '<?xml version="1.0"?>\n<feed><!-- <loc>no</loc> --><link href="https://a.org" /><entry><link>https://b.org/?a&amp;b</link><loc> </loc></entry></feed>'
    assert [(x.text, x.element, x.attribute) for x in xml_links(feed)] == [("https://a.org", "link", "href"), ("https://b.org/?a&amp;b", "link", None)]
    assert t(xml_links("<urlset><loc>https://a.org</loc></url><loc>https://b.org</loc>")) == ["https://a.org"]
    assert xml_links("no markup") == [] and xml_links("<loc>x") == [("x", "loc", None, 5)]


def test_html_attributes():
    page = """<body background=bg.png><a href="x?a&amp;b">l</a><img srcset="1.png 1x,2.png 2x" src='3.png' alt=no>
<video poster=p.jpg></video><object data=d classid=c></object><form action=/f><blockquote cite=q><div data=no action=no>"""
    assert set(t(H.html_links(page))) == {"bg.png", "x?a&b", "1.png", "2.png", "3.png", "p.jpg", "d", "c", "/f", "q"}
    assert spans(page, H.html_links(page))[1] == ("x?a&b", 1, 34)


def test_html_skips():
    skip = ['<a rel="nofollow" href=x>', '<a href=x rel="a, nofollow ,b">', "<link rel=preconnect href=x>", "<link rel=dns-prefetch href=x>", '<html prefix="og: x" href=x>', "<link rel=stylesheet href=/@x>", "<link rel=stylesheet href=x disabled>", '<link disabled="" rel=stylesheet href=x>', "<a href=a@b.org>", "<img src=mailto:a@b.org>"]
    for page in skip:
        assert H.html_links(page) == [], page
    keep = ['<a rel="nofollow noopener" href=x>', "<a href=mailto:a@b.org>", "<a href=tel:1>", "<link disabled rel=stylesheet href=x>"]
    for page in keep:
        assert len(H.html_links(page)) == 1, page
    assert H.html_links('<a rel="nofollow noopener" href=x>', tree_rules=True) == []


def test_html_verbatim_and_style():
    page = "<pre><pre></pre><a href=no></a></pre><code/><a href=yes>https://text.org</a><style>a{b:url(s.png)}</style><script>'<a href=js>'</script><textarea><a href=ta></textarea>"
    assert t(H.html_links(page)) == ["yes", "s.png"]
    assert set(t(H.html_links(page, include_verbatim=True))) >= {"no", "yes", "https://text.org", "s.png"}


def test_html_fragments_and_visible_text():
    page = '<h1 id="a">T</h1><code id=b></code><a name="c"></a><a rel=nofollow id=d><p id="a">'
    assert H.html_fragments(page) == ["a", "b", "c"]
    assert H.visible_text("<head><title>x</title></head><p>Hell<i>o</i>\n\n <b>w</b></p><script>s</script><select><option>o</select>!") == "Hello w!"
    assert H.visible_text("a<img src=x>hidden") == "a"


def test_html_survives_anything():
    for page in ("<", "<a", "<a href", "<a href='", "<!--", "<style>", "</", "<a href=x", "<plaintext><a href=y>", "\0<a\0href=z>"):
        H.html_links(page), H.html_fragments(page), H.visible_text(page)


DOC = """# Title

An [inline](one.md "t") and ![image](two.png), <https://auto.org>, <m@auto.org>, https://bare.org/x_y.

> quoted [ref][R] [collapsed][] [shortcut] [no ref]

    https://indented.org

```sh
curl https://fenced.org
```

`https://code.org` $[a](math)$ footnote[^1]

[R]: ref.md
[collapsed]: <col.md> 'title'
[Shortcut]: short.md
[^1]: https://note.org

<div><a href="block.html">x</a></div>

text <span id="s"><a href='inline.html'>y</a></span> \\[not](alink)
"""


def test_markdown():
    got = t(MD.markdown_links(DOC))
    assert got == ["one.md", "two.png", "https://auto.org", "m@auto.org", "https://bare.org/x_y", "ref.md", "col.md", "short.md", "https://note.org", "block.html", "inline.html"]
    more = set(t(MD.markdown_links(DOC, include_verbatim=True))) - set(got)
    assert more == {"https://indented.org", "https://fenced.org", "https://code.org"}


NESTED = """> - one [a](a.md)
>   continued [b
>   c](b.md)
>
>       https://code-in-item.org
>
>   1. ```
>      https://fenced-in-item.org
>      ```
>      after [c](c.md)
>
> lazy [d](d.md)
goes on [e](e.md)

- outer

  > quoted [f][F]

      https://code-in-list.org

  [F]: f.md

- <div><a href="g.html">
  x</a></div>

[^n]: note [h](h.md)

    second [i](i.md)

        https://code-in-note.org

10) ten [j](j.md)
	* tab [k](k.md)
"""


def test_markdown_nested_blocks():
    got = MD.markdown_links(NESTED)
    assert t(got) == ["a.md", "b.md", "c.md", "d.md", "e.md", "f.md", "g.html", "h.md", "i.md", "j.md", "k.md"]
    at = {x.text: x.offset for x in got}
    assert all(NESTED[at[f"{c}.md"]] == "[" for c in "abcdefhijk")
    assert set(t(MD.markdown_links(NESTED, True))) - set(t(got)) == {f"https://{x}.org" for x in ("code-in-item", "fenced-in-item", "code-in-list", "code-in-note")}


def kinds(text):
    return [b.kind for b in MD.blocks(text)]


def test_markdown_block_rules():
    # what may interrupt a paragraph, and what may not
    assert kinds("a\n2. b") == ["text"] and kinds("a\n1. b") == ["text", "text"] and kinds("a\n-\nb") == ["heading", "text"] and kinds("a\n*\nb") == ["text"]
    assert kinds("a\n    b") == ["text"] and kinds("a\n\n    b") == ["text", "code"]
    assert kinds("> a\nb") == ["text"] and kinds("> a\n- b") == ["text", "text"] and kinds("> a\n---") == ["text"]
    # fences end with their container; a fence needs as many marks as opened it
    assert kinds("> ```\n> a\nb") == ["code", "text"] and kinds("````\na\n```\nb\n`````\nc") == ["code", "text"]
    # indentation counts from the item's text; a tab reaches the next fourth column
    assert kinds("- a\n\n  b\n\n      c") == ["text", "text", "code"] and kinds("-\ta\n\n\tb") == ["text", "text"] and kinds("1.  a\n\n   b") == ["text", "text"]
    assert kinds("- a\n\n\t\tb") == ["text", "code"] and kinds(">\t\tb") == ["code"]
    # an item that begins with a blank line holds no more of them
    assert kinds("-\n\n  a") == ["text"] and kinds("-\n  a\n\n  b") == ["text", "text"]
    assert kinds("* * *\n- # h\n-     c") == ["heading", "code"]
    # HTML ends at a blank line, raw text elements and comments at their ends
    assert kinds("<!-- a\n\nb -->\nc") == ["html", "text"] and kinds("<div>\na\n\nb") == ["html", "text"] and kinds("<pre>\n\na</pre>\nb") == ["html", "text"]
    assert kinds("> <div>\na") == ["html", "text"]
    # definitions open a paragraph and may be followed by its text
    assert kinds("[a]: b\n[c]: <d> 'e'\nf") == ["definition", "definition", "text"] and kinds("f\n[a]: b") == ["text"]
    assert t(MD.markdown_links("$$ [a](b)\n\n[c](d)")) == ["b", "d"] and t(MD.markdown_links("$$\n[a](b)\n$$ [c](d)")) == ["d"]
    assert MD.markdown_fragments("> - Two\n>   lines\n>   ===\n>   ## In *it*") == ["twolines", "in-it"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["> ", "- ", "1. ", "  ", "    ", "\t", "```", "\n", "\n\n", "a", "[x](y)", "[r]: z", "[r]", "<div>", "<!--", "# ", "---", "[^f]: ", "`", "$$"]), max_size=24))
def test_markdown_places_are_places_of_the_document(parts):
    text, end = "".join(parts), 0
    for b in MD.blocks(text):
        assert b.at >= end or not b.shown
        end = b.at + len(b.shown)
        assert end <= len(text)
        assert all(c == d or c == " " for c, d in zip(b.shown, text[b.at : end], strict=True))
    for link in MD.markdown_links(text, include_verbatim=True):
        assert link.text != "y" or text.startswith("[x](y)", link.offset)


def test_markdown_link_text_counts_only_verbatim():
    text = "[https://shown.org](https://target.org)"
    assert t(MD.markdown_links(text)) == ["https://target.org"]
    assert set(t(MD.markdown_links(text, True))) == {"https://target.org", "https://shown.org"}


def test_wikilinks():
    text = "[[a|b]] [[c#d]] [[#e]] [[_TOC_]] [[TOC]]\n[[f g]]"
    assert spans(text, MD.markdown_links(text, include_wikilinks=True)) == [("a", 1, 3), ("c", 1, 11), ("f g", 2, 3)]
    assert MD.markdown_links(text) == []


def test_jsx_and_html_blocks():
    text = '<Group a={1}>\n  <Item\n    href="https://j.org"\n  >\n  t\n  </Item>\n</Group>'
    assert spans(text, MD.markdown_links(text)) == [("https://j.org", 3, 11)]
    assert t(MD.markdown_links("<div>\n\n[m](in.md)\n\n</div>\n\n<span>[n](span.md)</span>")) == ["in.md", "span.md"]


def test_heading_ids():
    text = "# A Test\n## A `code` *em* [link](x) {#own}\n# A Test\nSetext two\n---\n<a id=\"z\"></a>\n\n# Ünïcode 한글!\n"
    assert MD.markdown_fragments(text) == ["a-test", "own", "a-code-em-link", "a-test-1", "setext-two", "z", "ünïcode-한글"]
    assert MD.heading_id("Many     spaces_and-1.5") == "many-----spaces_and-15"


def test_frames(spark):
    rows = spark.createDataFrame([("a", "html", "<a\nhref='é'>"), ("b", "markdown", None), ("c", "plaintext", ""), ("d", None, "https://x.org")], "source string, file_type string, content string")
    got = sorted(map(tuple, extract_links(rows).select("source", "pos", "text", "span.line", "span.column").collect()))
    assert got == [("a", 0, "é", 2, 7), ("d", 0, "https://x.org", 1, 1)]
    assert {r["source"]: r["fragments"] for r in fragment_index(rows).collect()} == {"a": [], "b": [], "c": [], "d": []}
    register(spark)
    assert spark.sql("SELECT text, line FROM extract_links('[a](b)', 'markdown')").first() == ("b", 1)


def _lines_run(function, *values) -> int:
    """Lines of Python that a call runs."""
    import sys

    n, before = 0, sys.gettrace()

    def trace(frame, event, arg):
        nonlocal n
        n += event == "line"
        return trace

    sys.settrace(trace)
    try:
        function(*values)
    finally:
        sys.settrace(before)
    return n


def test_markdown_text_is_not_walked_by_character():
    from linkloom.operators.extract.markdown import markdown_links

    prose = "words of a long line " * 500
    assert _lines_run(markdown_links, f"[{prose}](/a) {prose}") < 500


def test_values_without_an_at_sign_are_not_searched_for_addresses():
    from linkloom.operators.extract.linkfinder import is_email_link

    assert _lines_run(is_email_link, "https://h.org/x") <= 2
    assert is_email_link("u@h.org") and is_email_link("mailto:u@h.org") and not is_email_link("u@h.org/x")


def test_an_element_costs_few_steps():
    from linkloom.operators.extract.html import html_links

    many = lambda n: _lines_run(html_links, "<a href=/x class='b'>" * n)
    assert (many(200) - many(100)) / 100 < 85


@pytest.mark.parametrize(
    ("name", "most"),
    [
        ("ex_20_embedded_html", 470),
        ("ex_08_verbatim_included", 205),
        ("ex_15_reference_links", 340),
        ("ex_09_rel", 113),
        ("ex_10_stylesheets", 90),
        ("ex_11_mail_values", 83),
        ("ex_19_code_and_text", 330),
    ],
)
def test_documents_of_a_query_cost_few_steps(name, most):
    import inspect

    from linkloom.operators.extract.links import links_of
    from linkloom.plans.rule_queries import QUERIES

    made = inspect.getclosurevars(QUERIES[name]).nonlocals
    run = lambda: [links_of(t, made["file_type"], **made["options"]) for t, _ in made["cases"]]
    run()  # patterns are made once
    assert _lines_run(run) / len(made["cases"]) < most


def test_many_definitions_are_cut_off_once():
    from time import thread_time

    from linkloom.operators.extract.markdown import blocks

    def took(n):
        text, began = "".join(f"[r{k}]: /ref/{k}{'x' * 80}\n" for k in range(n)), thread_time()
        assert len(blocks(text)) == n
        return thread_time() - began

    assert min(took(24_000) for _ in range(2)) < 12 * min(took(4_000) for _ in range(3))


def test_values_of_a_batch():
    import pyarrow as pa

    from linkloom.operators.extract.batches import values

    for rows, kind in ((["a", "a", "a"], pa.string()), (["a", "a", None, "é"], pa.string()), ([None, None], pa.string()), ([], pa.string()), (["a"], pa.string()), ([True, None], pa.bool_()), ([1, 1], pa.int32()), ([{"x": 1}] * 2, pa.struct([("x", pa.int32())]))):
        assert values(pa.array(rows, kind)) == rows
        assert values(pa.array([*rows, *rows], kind)[len(rows) :]) == rows


def test_lines_of_text_and_reference_links_cost_few_steps():
    import inspect

    from linkloom.operators.extract.links import links_of
    from linkloom.operators.extract.markdown import blocks
    from linkloom.plans.rule_queries import QUERIES

    lines = lambda n: _lines_run(blocks, "[a](/x)\n" * n)
    assert (lines(200) - lines(100)) / 100 < 20
    cases = inspect.getclosurevars(QUERIES["ex_15_reference_links"]).nonlocals["cases"]
    assert _lines_run(lambda: [links_of(t, "markdown") for t, _ in cases]) / len(cases) < 290


def test_lines_that_are_more_than_text_are_still_seen():
    from linkloom.operators.extract.markdown import blocks

    found = [(b.kind, b.shown) for b in blocks("[a]\n[^n]: x\n\n[r]: /ref\n(b\n> c\nd\n\n!e\n# f\n\\g\n```\nh\n```\n")]
    assert found == [("text", "[a]"), ("text", "x"), ("definition", "[r]: /ref"), ("text", "(b"), ("text", "c\nd"), ("text", "!e"), ("heading", "# f"), ("text", "\\g"), ("code", "h")]


def test_style_sheets_cost_few_steps():
    import inspect

    from linkloom.operators.extract.html import html_links, is_skipped
    from linkloom.plans.rule_queries import QUERIES

    assert _lines_run(is_skipped, {"rel": "stylesheet", "href": "/x"}, "href") <= 8
    cases = inspect.getclosurevars(QUERIES["ex_10_stylesheets"]).nonlocals["cases"]
    run = lambda: [html_links(t) for t, _ in cases]
    run()  # patterns are made once
    assert _lines_run(run) / len(cases) < 83


def test_relations_and_ends_of_tags():
    from linkloom.operators.extract.html import events, is_skipped

    assert [is_skipped({"rel": r}, "rel") for r in ("nofollow", "x, nofollow", " nofollow ,y", "nofollow x", "nofollower", "dns-prefetch", "prefetch", "")] == [True, True, True, False, False, True, False, False]
    assert [is_skipped({"rel": r}, "rel", loose_rel=True) for r in ("nofollow x", "nofollower", "prefetch")] == [True, True, False]
    assert [e[5] for t in ("<br>", "<br/>", "<br />", "<br/ >", "<a href=x/>", "<a href='x'/>", "<a b/>") for e in events(t)] == [False, True, True, False, False, True, True]


def test_mail_values_cost_few_steps():
    import inspect

    from linkloom.operators.extract.html import html_links
    from linkloom.operators.extract.linkfinder import is_email_link
    from linkloom.plans.rule_queries import QUERIES

    cases = inspect.getclosurevars(QUERIES["ex_11_mail_values"]).nonlocals["cases"]
    run = lambda: [html_links(t) for t, _ in cases]
    run()  # patterns are made once
    assert _lines_run(run) / len(cases) < 75
    assert _lines_run(is_email_link, "u@h.org/x") <= 7


def test_whole_mail_addresses():
    from linkloom.operators.extract.linkfinder import find_links, is_email_link

    texts = ["u@h.org", "mailto:u@h.org", "mailto:mailto:u@h.org", ".u@h.org", "u.@h.org", "u..v@h.org", "u@h", "u@h.org.", "a@b@h.org", "a@b.c@h.org", "@h.org", "u@", "é@ü.de", "https://u@h.org/x", "x u@h.org", "v" * 256 + "@h.org", "v" * 257 + "@h.org", "a,u@h.org", "u@-h.org", "mailto:", "mailto:@", "a@b.c d@e.f"]
    for x in texts:
        bare = x.removeprefix("mailto:")
        assert is_email_link(x) == any(bare[a:b] == bare for a, b, _ in find_links(bare, urls=False)), x
    assert [is_email_link(x) for x in texts[:4]] == [True, True, False, False]
