"""Queries over extraction rules: one document for each customer and case, made from a template.

Templates are HTML, Markdown and so on with ``~`` where the customer's key goes. What a
rule has to give is a table of (case, element, attribute, text) beside them, which the
SQL fills in for every customer; the documents go through the shipped extractors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.extract import links as L
from linkloom.plans.literals import values
from linkloom.session import spread, table

QUERIES: dict = {}
ORACLES: dict = {}
Case = tuple[str, list[tuple[str | None, str | None, str]]]


def documents(spark: SparkSession, sf_dir: str, templates: Sequence[str], file_type: str) -> DataFrame:
    """k, case_id, source, content and file_type of each template for each customer."""
    key = F.col("c_custkey").cast("string")
    made = F.array(*(F.struct(F.lit(n).alias("case_id"), F.replace(F.lit(t), F.lit("~"), key).alias("content")) for n, t in enumerate(templates)))
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("k"), F.explode(made).alias("d"))
    return rows.select("k", "d.*", F.lit(file_type).alias("file_type"))


def _sql(rows: Sequence[tuple], columns: str) -> str:
    """The rows with the key filled in, for every customer."""
    names = columns.split(", ")
    shown = ", ".join(f"replace({c}, '~', CAST(c_custkey AS VARCHAR)) AS {c}" if c in ("text", "shown") else c for c in names)
    return f"SELECT c_custkey AS k, {shown} FROM customer, {values(rows, columns)}"


def rule(name: str, file_type: str, cases: Sequence[Case], doc: str, **options) -> None:
    """Registers a query over the links of the cases."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = L.extract_links(documents(spark, sf_dir, [t for t, _ in cases], file_type), **options)
        return found.select("k", "case_id", "element", "attribute", "text")

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    ORACLES[name] = _sql([(n, *x) for n, (_, found) in enumerate(cases) for x in found], "case_id, element, attribute, text")


#: Attributes that hold links, for some elements only.
PAIRS = [("applet", "codebase"), ("body", "background"), ("button", "formaction"), ("command", "icon"), ("form", "action"), ("frame", "longdesc"), ("head", "profile"), ("html", "manifest"), ("iframe", "longdesc"), ("img", "longdesc"), ("input", "formaction"), ("object", "classid"), ("object", "codebase"), ("object", "data"), ("video", "poster")]
rule(
    "ex_06_link_attributes",
    "html",
    [
        *((f'<{e} {a}="/{e}/~" x="/no/~">', [(e, a, f"/{e}/~")]) for e, a in PAIRS),
        *((f'<p {a}="/p/~">', []) for a in ("codebase", "background", "formaction", "icon", "action", "longdesc", "profile", "manifest", "classid", "data", "poster")),
        *((f"<{e} {a}='/any/~?x=1&amp;y'>", [(e, a, "/any/~?x=1&y")]) for e in ("a", "q", "custom-tag") for a in ("href", "src", "cite", "usemap")),
        ("<a href=/bare/~><A HREF='/upper/~'>", [("a", "href", "/bare/~"), ("a", "href", "/upper/~")]),
        ("<!-- <a href=/comment/~> --><a title='<a href=/in/~>' href=/out/~>", [("a", "href", "/out/~")]),
    ],
    "Attributes that hold links: some on every element, some on certain ones.",
)
rule(
    "ex_07_srcset",
    "html",
    [
        ('<img srcset="/1-~.png 1x, /2-~.png 2x">', [("img", "srcset", "/1-~.png"), ("img", "srcset", "/2-~.png")]),
        ('<source srcset="/a,b-~.png 100w,/c-~.png 2x">', [("source", "srcset", "/a,b-~.png"), ("source", "srcset", "/c-~.png")]),
        ('<img srcset="/only-~.png">', [("img", "srcset", "/only-~.png")]),
        ('<img srcset="/x-~.png,,">', []),
        ('<img srcset=",/x-~.png">', []),
        ('<img src="/s-~.png" srcset="/t-~.png 1w">', [("img", "srcset", "/t-~.png"), ("img", "src", "/s-~.png")]),
    ],
    "Candidates of srcset, with commas in URLs; a comma too many leaves nothing.",
)
VERBATIM = ("code", "kbd", "listing", "noscript", "pre", "samp", "script", "textarea", "var", "xmp")
rule("ex_08_verbatim", "html", [(f"<{e}><a href=/no/~>x</a></{e}><a href=/yes/~>", [("a", "href", "/yes/~")]) for e in VERBATIM] + [("<pre><code>x</code><a href=/no/~></pre><a href=/yes/~>", [("a", "href", "/yes/~")])], "No links from elements that show text as it is.")
rule("ex_08_verbatim_included", "html", [(f"<{e}><a href=/in/~>x</a></{e}><a href=/yes/~>", [("a", "href", "/in/~"), ("a", "href", "/yes/~")]) for e in ("code", "kbd", "pre", "samp", "var")], "With the option they give links, too.", include_verbatim=True)
rule(
    "ex_09_rel",
    "html",
    [
        *((f'<a rel="{r}" href="/no/~"><a href="/yes/~">', [("a", "href", "/yes/~")]) for r in ("nofollow", "preconnect", "dns-prefetch", "x, nofollow", " nofollow ,y")),
        *((f'<a rel="{r}" href="/yes/~">', [("a", "href", "/yes/~")]) for r in ("nofollow noopener", "noopener", "", "prefetch")),
    ],
    "Elements whose rel, split at commas, asks not to be followed.",
)
rule(
    "ex_10_stylesheets",
    "html",
    [
        ('<link rel="stylesheet" href="@vite/~.css">', []),
        ('<link rel="stylesheet" href="/@vite/~.css">', []),
        ('<link rel="stylesheet" href="/no-~.css" disabled>', []),
        ('<link rel="stylesheet" href="/yes-~.css">', [("link", "href", "/yes-~.css")]),
        ('<a href="/@user/~">', [("a", "href", "/@user/~")]),
        ('<a prefix="og: https://o.org/~" href="/no/~"><a href="/yes/~">', [("a", "href", "/yes/~")]),
    ],
    "Style sheets that a tool serves or that are disabled, and elements with a prefix.",
)
rule(
    "ex_11_mail_values",
    "html",
    [
        ('<a href="mailto:u~@h.org">', [("a", "href", "mailto:u~@h.org")]),
        ('<a href="u~@h.org">', []),
        ('<img src="u~@h.org">', []),
        ('<a href="tel:~">', [("a", "href", "tel:~")]),
        ('<a href="https://u@h.org/~">', [("a", "href", "https://u@h.org/~")]),
    ],
    "Values that look like mail addresses count only with mailto: in href.",
)
rule("ex_12_style_elements", "html", [("<style>a{b:url(/1-~.png)} c{d: url( '/2-~.png' )}\ne{f:url(\"/3-~.png\")}</style><a href=/x/~>", [("style", "url", f"/{n}-~.png") for n in (1, 2, 3)] + [("a", "href", "/x/~")])], "URLs of the style sheets in a page.")
rule("ex_13_text_nodes", "html", [("<p>go to https://t~.org/x. now</p><a href=/a/~>", [("a", "href", "/a/~")])], "Plain text in pages holds no links by default.")
rule("ex_13_text_nodes_included", "html", [("<p>go to https://t~.org/x. now</p><a href=/a/~>", [(None, None, "https://t~.org/x"), ("a", "href", "/a/~")])], "With the option it does.", include_verbatim=True)
rule("ex_14_tree_rules", "html", [('<a rel="nofollow noopener" href="/no/~"><a rel="x" href="/yes/~">', [("a", "href", "/yes/~")]), ('<img srcset="/1-~.png 1x">', [("img", "srcset", "/1-~.png")])], "The other rules for pages: rel holds a word anywhere.", tree_rules=True)
rule(
    "ex_15_reference_links",
    "markdown",
    [
        ("[a](/inline/~) [b][r] [r][] [r] ![i](/img/~.png \"t\")\n\n[r]: /ref/~\n", [("a", "href", "/inline/~"), ("a", "href", "/ref/~"), ("a", "href", "/ref/~"), ("a", "href", "/ref/~"), ("img", "src", "/img/~.png")]),
        ("[a](</with space/~>) [no] [x](/p(q)/~)", [("a", "href", "/with space/~"), ("a", "href", "/p(q)/~")]),
        ("> * [q](/quoted/~)\n>   1. [n](/nested/~)\n", [("a", "href", "/quoted/~"), ("a", "href", "/nested/~")]),
        ("\\[e](/escaped/~\\)", []),
    ],
    "Links of Markdown: inline, by reference, images, in quotes and lists.",
)
rule("ex_16_autolinks", "markdown", [("<https://a~.org/x> and <u~@h.org>", [(None, None, "https://a~.org/x"), (None, None, "u~@h.org")])], "Links in angle brackets.")
rule(
    "ex_19_code_and_text",
    "markdown",
    [
        ("see https://b~.org/x. but `https://c~.org`", [(None, None, "https://b~.org/x")]),
        ("```\nhttps://f~.org\n```\n\n    https://i~.org\n\n* x\n\n  ```\n  [a](/in/~)\n  ```\n", []),
        ("$x [a](/math/~)$ and [b](/text/~)", [("a", "href", "/text/~")]),
    ],
    "Bare links in text count, code and formulas do not.",
)
rule("ex_19_code_included", "markdown", [("`https://c~.org/x`\n\n```\nhttps://f~.org/y\n```\n", [(None, None, "https://c~.org/x"), (None, None, "https://f~.org/y")])], "With the option code counts, too.", include_verbatim=True)
rule(
    "ex_19_nested_blocks",
    "markdown",
    [
        ("- > 1. [a](/deep/~)\n  >\n  >        [no](/code/~)\n  >\n  >    [b](/item/~)\nlazy [c](/lazy/~)\n", [("a", "href", f"/{x}/~") for x in ("deep", "item", "lazy")]),
        ("> ```\n> [no](/fence/~)\n[a](/outside/~)\n", [("a", "href", "/outside/~")]),
        ("* x\n\n\t[a](/tab/~)\n\n\t\t[no](/tab-code/~)\n\n[b][r]\n\n> [r]: /from-quote/~\n", [("a", "href", "/tab/~"), ("a", "href", "/from-quote/~")]),
        ("[^n]: x\n\n    [a](/note/~)\n\n        [no](/note-code/~)\n", [("a", "href", "/note/~")]),
        ("> <div>\n> <a href=/in-div/~>x\n\n[a](/after/~)\n", [("a", "href", "/in-div/~"), ("a", "href", "/after/~")]),
    ],
    "Quotes, lists and notes within each other: what is text and what is code.",
)
rule(
    "ex_20_embedded_html",
    "markdown",
    [
        ("<div>\n<a href=\"/block/~\">x</a>\n</div>\n\ntext <img src=\"/inline/~.png\"> more", [("a", "href", "/block/~"), ("img", "src", "/inline/~.png")]),
        ("* item\n\n  <p><a href=/in-list/~>y</a></p>\n", [("a", "href", "/in-list/~")]),
        ("<pre>\n<a href=/no/~>\n</pre>\n\n[a](/yes/~)", [("a", "href", "/yes/~")]),
    ],
    "HTML in Markdown, in blocks and in lines.",
)
rule("ex_02_plain_urls", "plaintext", [("(see https://a~.org/x), \"http://b~.org/?q=1&r=2\"; c~.org and u~@h.org!", [(None, None, "https://a~.org/x"), (None, None, "http://b~.org/?q=1&r=2"), (None, None, "u~@h.org")])], "URLs and mail addresses in plain text, without the marks around them.")
rule("ex_03_style_sheets", "css", [("a{b:url(x~.png)} c{d:url( \"y z~.woff\" ),url('q~.woff2')} e{f:url()} @import url(//g~.css);", [("style", "url", x) for x in ("x~.png", "y z~.woff", "q~.woff2", "//g~.css")])], "URLs of style sheets by the extractor.")
rule(
    "ex_04_sitemaps_and_feeds",
    "xml",
    [
        ("<urlset><url><loc>https://a.org/~</loc></url><url><loc> https://b.org/~ </loc></url></urlset>", [("loc", None, "https://a.org/~"), ("loc", None, "https://b.org/~")]),
        ("<rss><channel><link>https://c.org/~</link></channel></rss>", [("link", None, "https://c.org/~")]),
        ("<feed><link href=\"https://d.org/~\"/><link href=\"https://no.org/~\"></link></feed>", [("link", "href", "https://d.org/~")]),
    ],
    "Links of sitemaps and feeds.",
)
rule("ex_18_wikilinks_extractor", "markdown", [("[[foo~|bar]] [[a~#b]] [[_TOC_]] [[x y~]]", [("a", "wikilink", "foo~"), ("a", "wikilink", "a~"), ("a", "wikilink", "x y~")])], "Wikilinks by the extractor.", include_wikilinks=True)


FRAGMENTS = [
    ("html", "<h1 id=\"a~\">x</h1><a name=\"b~\"></a><p id=\"a~\"><pre id=c~></pre>", ["a~", "b~", "c~"]),
    ("html", "<a rel=nofollow id=no~><div id=d~ name=e~></div>", ["d~", "e~"]),
    ("markdown", "# A Head ~\n\n## A Head ~\n\n### Own {#own~}\n\n<a name=\"n~\"></a>\n", ["a-head-~", "a-head-~-1", "own~", "own", "n~"]),
]


def ex_22_23_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that links can point at, in pages and in Markdown."""
    parts = [L.fragment_index(documents(spark, sf_dir, [t], kind).withColumn("case_id", F.lit(n))) for n, (kind, t, _) in enumerate(FRAGMENTS)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("k", "case_id", F.explode("fragments").alias("text"))


QUERIES["ex_22_23_fragments"] = ex_22_23_fragments
ORACLES["ex_22_23_fragments"] = _sql([(n, x) for n, (_, _, found) in enumerate(FRAGMENTS) for x in found], "case_id, text")

SHOWN = [
    ("<html><head><title>no ~</title></head><body><p>One  ~</p>\n<script>no</script> <p>two <b>bold</b></p></body></html>", "One ~ two bold"),
    ("a<style>no</style><select><option>no</select><template>no</template> ~<video>no</video>", "a ~"),
]


def ex_25_visible_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees of a page."""
    return documents(spark, sf_dir, [t for t, _ in SHOWN], "html").select("k", "case_id", F.trim(F.regexp_replace(L.visible(F.col("content")), r"\s+", " ")).alias("shown"))


QUERIES["ex_25_visible_text_rules"] = ex_25_visible_text_rules
ORACLES["ex_25_visible_text_rules"] = _sql([(n, x) for n, (_, x) in enumerate(SHOWN)], "case_id, shown")
