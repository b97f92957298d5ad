"""Queries over sources and extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import uri as U
from linkloom.functions.filters import matches_any
from linkloom.operators.extract import links as L
from linkloom.plans.literals import PAGE_LINKS, frame, pages, values
from linkloom.session import table
from linkloom.sources import inputs

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


KINDS = [("a.md",), ("B.HTML",), ("c.htm",), ("d.css",), ("e.xml",), ("f.txt",), ("g",), ("dir.d/g",), ("x.Rmd",), ("https://h.org",), ("https://h.org/",), ("https://h.org/a.md",), ("https://h.org/a.pdf",), ("https://h.org/a.css?x=1.html",), (".md",)]


@query(rf"""WITH k AS (SELECT source, lower(regexp_extract(regexp_replace(source, '[?#].*$', ''), '[^/.][^/]*\.([A-Za-z0-9]+)$', 1)) AS ext FROM {values(KINDS, 'source')})
SELECT source, CASE WHEN regexp_matches(source, '^https?://[^/]*/?([?#].*)?$') THEN 'html' WHEN ext IN ('md','markdown','mdx','qmd','rmd','mkd','mkdn','mdwn','mdown','mkdown') THEN 'markdown' WHEN ext IN ('htm','html') THEN 'html' WHEN ext = 'css' THEN 'css' WHEN ext = 'xml' THEN 'xml' WHEN ext = 'txt' THEN 'plaintext' WHEN regexp_matches(source, '^https?://') THEN 'html' ELSE 'plaintext' END AS file_type FROM k""")
def sc_11_file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, KINDS, "source string").select("source", U.file_type(F.col("source")).alias("file_type"))


@query("SELECT CAST(doc_id AS VARCHAR) AS source, 'string' AS source_kind, 'plaintext' AS file_type, length(coalesce(text, '')) AS n FROM documents")
def sc_06_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.from_table(table(spark, sf_dir, "documents"), "doc_id", "text", "string", "plaintext")
    return rows.select("source", "source_kind", "file_type", F.length("content").cast("bigint").alias("n"))


@query("SELECT url AS source FROM pages WHERE NOT regexp_matches(url, '/a|\\.org')")
def sc_12_exclude_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).where(~matches_any(F.col("source"), ["/a", r"\.org"])).select("source")


@query("SELECT DISTINCT url AS source FROM pages UNION ALL SELECT '<stdin>' UNION ALL SELECT '<raw string>'")
def sc_13_dump_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources as they are shown."""
    from linkloom.operators.report import dump_inputs

    more = inputs.from_texts(spark, ["x"], "stdin").unionByName(inputs.from_texts(spark, ["y", "z"]))
    return dump_inputs(pages(spark, sf_dir).unionByName(more))


MAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"


@query(f"SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{MAIL}')) AS address FROM documents")
def ex_02_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses in documents, JVM only."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(L.emails(F.coalesce("text", F.lit("")))).alias("address"))


@query(f"SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{MAIL}')) AS address FROM documents")
def ex_02_emails_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the link finder."""
    found = L.extract_links(inputs.from_table(table(spark, sf_dir, "documents"), "doc_id", "text", "string", "plaintext"))
    return found.select(F.col("source").cast("bigint").alias("doc_id"), F.col("text").alias("address"))


CSS = [(1, "a{background:url(x.png)}"), (2, 'b{src: url( "y z.woff" ) , url(\'q.woff2\')}'), (3, "url()"), (4, "@import url(//c.css);"), (5, 'c{d:url("")}'), (6, "none")]
_CSS = """url\\s*\\(\\s*(?:"([^"]*)"|''([^'']*)''|([^)]+))\\s*\\)"""


@query(f"""WITH m AS (SELECT id, unnest(regexp_extract_all(css, '{_CSS}')) AS x FROM {values(CSS, 'id, css')})
SELECT id, url FROM (SELECT id, trim(coalesce(nullif(regexp_extract(x, '{_CSS}', 1), ''), nullif(regexp_extract(x, '{_CSS}', 2), ''), nullif(regexp_extract(x, '{_CSS}', 3), ''), '')) AS url FROM m) WHERE url <> ''""")
def ex_03_css_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, CSS, "id int, css string").select("id", F.explode(L.css_urls(F.col("css"))).alias("url"))


XML = [(1, "<urlset><url><loc>https://a.org/</loc></url><url><loc> https://b.org/x </loc></url></urlset>"), (2, "<rss><channel><link>https://c.org</link></channel></rss>")]


@query(f"SELECT id, trim(unnest(regexp_extract_all(xml, '<(?:loc|link)>([^<]*)<', 1))) AS url FROM {values(XML, 'id, xml')}")
def ex_04_xml_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a sitemap and a feed."""
    rows = frame(spark, XML, "id int, content string").withColumn("file_type", F.lit("xml"))
    return L.extract_links(rows).select("id", F.col("text").alias("url"))


@query(f"WITH {PAGE_LINKS} SELECT source, text FROM links")
def ex_05_anchor_links_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages whose anchors have one attribute, JVM only."""
    return L.anchor_links(pages(spark, sf_dir)).select("source", "text")


@query(f"WITH {PAGE_LINKS} SELECT source, text FROM links")
def ex_05_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages by the HTML parser."""
    return L.extract_links(pages(spark, sf_dir).withColumn("file_type", F.lit("html"))).select("source", "text")


MARKDOWN = [(1, "[a](x.md) and ![b](y.png)"), (2, "see [c](https://c.org/d)\n\n[e](f.md)"), (3, "no links")]


@query(f"SELECT id, unnest(regexp_extract_all(md, '\\]\\(([^)]*)\\)', 1)) AS url FROM {values(MARKDOWN, 'id, md')}")
def ex_15_17_markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline links and images of Markdown."""
    rows = frame(spark, MARKDOWN, "id int, content string").withColumn("file_type", F.lit("markdown"))
    return L.extract_links(rows).select("id", F.col("text").alias("url"))


WIKI = [(1, "[[foo|bar]] [[a#b]]"), (2, "[[_TOC_]] [[x y]]"), (3, "[[#only]]")]


@query(f"SELECT id, target FROM (SELECT id, trim(regexp_replace(unnest(regexp_extract_all(md, '\\[\\[([^\\[\\]\n]+)\\]\\]', 1)), '[|#].*$', '')) AS target FROM {values(WIKI, 'id, md')}) WHERE target NOT IN ('', 'TOC', '_TOC_')")
def ex_18_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, WIKI, "id int, md string").select("id", F.explode(L.wikilink_targets(F.col("md"))).alias("target"))


_SPANS = """WITH p AS (SELECT url AS source, string_split(html, '<a href="') AS parts FROM pages WHERE contains(html, '<a href="')),
k AS (SELECT source, parts, unnest(range(1, len(parts))) AS n FROM p), b AS (SELECT source, array_to_string(parts[1:n], '<a href="') || '<a href="' AS before FROM k)
SELECT source, length(before) - length(replace(before, chr(10), '')) + 1 AS line, length(split_part(before, chr(10), -1)) + 1 AS col FROM b"""


@query(_SPANS)
def ex_21_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of every link of every page."""
    rows = L.extract_links(pages(spark, sf_dir).withColumn("file_type", F.lit("html")))
    return rows.select("source", F.col("span.line").cast("bigint").alias("line"), F.col("span.column").cast("bigint").alias("col"))


@query(_SPANS)
def ex_21_spans_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for anchors with one attribute, JVM only."""
    mark = '<a href="'
    parts = pages(spark, sf_dir).select("source", "content", F.split("content", mark).alias("parts")).where(F.size("parts") > 1)
    ends = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.length(F.array_join(F.slice("parts", F.lit(1), n), mark)) + len(mark))
    rows = parts.select("source", "content", F.explode(ends).alias("at")).select("source", L.span_of(F.col("content"), F.col("at")).alias("s"))
    return rows.select("source", F.col("s.line").cast("bigint").alias("line"), F.col("s.column").cast("bigint").alias("col"))


IDS = [(1, '<h1 id="a">x</h1><a name="b"></a><p id="a">'), (2, "<p>none</p>"), (3, '<div id="c" name="d"></div>')]


@query(f"SELECT DISTINCT id, unnest(regexp_extract_all(html, '(?:id|name)=\"([^\"]*)\"', 1)) AS fragment FROM {values(IDS, 'id, html')}")
def ex_22_html_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, IDS, "id int, content string").withColumn("file_type", F.lit("html"))
    return L.fragment_index(rows).select("id", F.explode("fragments").alias("fragment"))


HEADINGS = [(1, 1, "A Heading"), (1, 2, "A Heading"), (1, 3, "This header has a :thumbsup: in it"), (2, 1, "Many          spaces"), (2, 2, "foo_bar_, dots . and 1.7e-3"), (2, 3, "A Heading"), (1, 4, "a heading")]


@query(f"""WITH h AS (SELECT document, pos, text, regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\\s-]', '', 'g'), '\\s', '-', 'g') AS base FROM {values(HEADINGS, 'document, pos, text')}), n AS (SELECT *, row_number() OVER (PARTITION BY document, base ORDER BY pos) - 1 AS k FROM h)
SELECT document, pos, base || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS heading_id FROM n""")
def ex_24_heading_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of headings; those that repeat in a document are numbered."""
    return L.heading_ids(frame(spark, HEADINGS, "document int, pos int, text string")).select("document", "pos", "heading_id")


@query()
def ex_25_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page (tested against goldens)."""
    return pages(spark, sf_dir).select("source", L.visible(F.col("content")).alias("shown"))


DOCUMENTS = [
    ("a.html", "<a href='x.html' id=i>l</a><img srcset='/1.png 1w,/2.png 2w' src=/3.png><pre><a href=no></pre><a rel=nofollow href=n>"),
    ("b.md", "# T\n\n[l](y.md) <http://z.org> ![i](p.png) [r]\n\n[r]: ref.md\n\n`http://code.org`\n"),
    ("c.css", "a{b:url(d.png)}"),
    ("d.xml", "<feed><link href='https://e.org'/></feed>"),
    ("e.txt", "go to https://f.org/x. or mail m@n.org!"),
]


@query()
def ex_01_extract_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of one document of each type (tested against goldens)."""
    rows = frame(spark, DOCUMENTS, "source string, content string").withColumn("file_type", U.file_type(F.col("source")))
    return L.extract_links(rows).select("source", "pos", "text", "element", "attribute", F.col("span.line").alias("line"), F.col("span.column").alias("col"))


LINK_TEXTS = [("https://EXAMPLE.com:443/a b?q#x y",), ("http://0x7f.1/",), ("https;//x",), ("https://example]org/x",), ("foo@bar.com",), ("",), ("https://bücher.de/ü",), ("x.html",), ("slack://c?x",)]


@query()
def pr_01_parse_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of texts that need the whole parser (tested against goldens)."""
    from linkloom.operators.resolve import parsed

    return parsed(frame(spark, LINK_TEXTS, "text string"))
