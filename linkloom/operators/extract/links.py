"""Extraction over DataFrames of documents.

``contents`` has source, source_kind, file_type and content; ``raw_links`` adds pos,
text, element, attribute and span to the sources. The parsers run as Arrow UDFs in the
tasks that read the documents: no shuffle, and only the content goes to Python.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.extract.batches import joined, pieces, values
from linkloom.operators.extract.css import URL_PATTERN, css_links
from linkloom.operators.extract.html import html_fragments, html_links, visible_text
from linkloom.operators.extract.linkfinder import plaintext_links
from linkloom.operators.extract.markdown import markdown_fragments, markdown_links
from linkloom.operators.extract.spans import Lines, Link
from linkloom.operators.extract.xml import xml_links

LINKS = "array<struct<pos:int,text:string,element:string,attribute:string,span:struct<line:int,column:int>>>"
_SPAN = pa.struct([("line", pa.int32()), ("column", pa.int32())])
_LINK = pa.struct([("pos", pa.int32()), ("text", pa.string()), ("element", pa.string()), ("attribute", pa.string()), ("span", _SPAN)])


def links_of(content: str, file_type: str, include_verbatim: bool = False, include_wikilinks: bool = False, tree_rules: bool = False) -> list[Link]:
    """Raw links of one document, by its type."""
    if file_type == "html":
        return html_links(content, include_verbatim, tree_rules)
    if file_type == "markdown":
        return markdown_links(content, include_verbatim, include_wikilinks)
    if file_type == "css":
        return css_links(content)
    if file_type == "xml":
        return xml_links(content)
    return plaintext_links(content)


def fragments_of(content: str, file_type: str) -> list[str]:
    if file_type == "html":
        return html_fragments(content)
    return markdown_fragments(content) if file_type == "markdown" else []


def _link_udf(include_verbatim: bool, include_wikilinks: bool, tree_rules: bool):
    def part(content: pa.Array, file_type: pa.Array) -> pa.Array:
        ends, place, links, spans = [0], [], [], []
        for text, kind in zip(values(content), values(file_type), strict=True):
            found = links_of(text, kind or "plaintext", include_verbatim, include_wikilinks, tree_rules) if text else []
            if found:
                links += found
                place += range(len(found))
                if tree_rules and kind == "html":
                    starts = Lines(text)
                    spans += [(starts.at(x.offset)[0], None) for x in found]
                elif "\n" in text:
                    starts = Lines(text)
                    spans += [starts.at(x.offset) for x in found]
                else:
                    spans += [(1, x.offset + 1) for x in found]
            ends.append(len(links))
        texts, elements, attributes, _ = zip(*links, strict=True) if links else ((), (), (), ())
        lines, columns = zip(*spans, strict=True) if spans else ((), ())
        span = pa.StructArray.from_arrays([pa.array(lines, pa.int32()), pa.array(columns, pa.int32())], fields=list(_SPAN))
        rows = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(texts, pa.string()), pa.array(elements, pa.string()), pa.array(attributes, pa.string()), span], fields=list(_LINK))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    def run(content: pa.Array, file_type: pa.Array) -> pa.Array:
        return joined([part(*p) for p in pieces(content, file_type)], pa.list_(_LINK))

    return F.arrow_udf(run, LINKS)


def extract_links(contents: DataFrame, include_verbatim: bool = False, include_wikilinks: bool = False, tree_rules: bool = False) -> DataFrame:
    """One row for each raw link; null and empty contents have none."""
    udf = _link_udf(include_verbatim, include_wikilinks, tree_rules)
    others = [c for c in contents.columns if c not in ("content", "pos", "text", "element", "attribute", "span")]
    return contents.withColumn("_link", F.explode(udf("content", "file_type"))).select(*others, "_link.*")


def anchor_links(contents: DataFrame) -> DataFrame:
    """The quick way for pages whose links are all ``<a href="...">``: JVM only, no spans."""
    found = F.regexp_extract_all("content", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    others = [c for c in contents.columns if c != "content"]
    return contents.select(*others, F.posexplode(found).alias("pos", "text")).withColumn("element", F.lit("a")).withColumn("attribute", F.lit("href"))


def css_urls(content: Column) -> Column:
    """The values of url() in style sheets, JVM only."""
    whole = F.regexp_extract_all(content, F.lit(URL_PATTERN), F.lit(0))
    part = lambda x, k: F.nullif(F.regexp_extract(x, URL_PATTERN, k), F.lit(""))
    return F.filter(F.transform(whole, lambda x: F.trim(F.coalesce(part(x, 1), part(x, 2), part(x, 3), F.lit("")))), lambda x: x != "")


def wikilink_targets(content: Column) -> Column:
    """Targets of ``[[target|label]]`` and ``[[target#heading]]``, JVM only."""
    inner = F.regexp_extract_all(content, F.lit(r"\[\[([^\[\]\n]+)\]\]"), F.lit(1))
    bare = F.transform(inner, lambda x: F.trim(F.regexp_replace(x, r"[|#].*$", "")))
    return F.filter(bare, lambda x: ~x.isin("", "TOC", "_TOC_"))


def emails(content: Column) -> Column:
    """Plain mail addresses, JVM only (ASCII letters, digits and the usual marks)."""
    return F.regexp_extract_all(content, F.lit(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"), F.lit(0))


def heading_ids(headings: DataFrame, document: str = "document", position: str = "pos", text: str = "text") -> DataFrame:
    """Ids of headings; those that repeat in a document get -1, -2 and so on. JVM only."""
    from pyspark.sql import Window

    base = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]|[\p{Mn}\p{Mc}\p{Pc}&&[^_]]", ""), r"(?U)\s", "-")
    n = F.row_number().over(Window.partitionBy(document, "_base").orderBy(position)) - 1
    return headings.withColumn("_base", base).withColumn("heading_id", F.when(n > 0, F.concat("_base", F.lit("-"), n.cast("string"))).otherwise(F.col("_base"))).drop("_base")


def span_of(content: Column, offset: Column) -> Column:
    """struct(line, column) of a character offset (from 0), JVM only."""
    before = F.substring(content, F.lit(1), offset)
    line = F.length(before) - F.length(F.regexp_replace(before, "\n", "")) + 1
    return F.struct(line.cast("int").alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).cast("int").alias("column"))


def fragment_index(contents: DataFrame) -> DataFrame:
    """Per document: all its columns but content, and fragments, the ids that links can point at."""

    def run(content: pa.Array, file_type: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        return joined([pa.array([fragments_of(t, k or "") if t else [] for t, k in zip(c.to_pylist(), f.to_pylist(), strict=True)], kind) for c, f in pieces(content, file_type)], kind)

    return contents.withColumn("fragments", F.arrow_udf(run, "array<string>")("content", "file_type")).drop("content")


def visible(content: Column) -> Column:
    def run(pages: pa.Array) -> pa.Array:
        return joined([pa.array([visible_text(x) if x else "" for x in p.to_pylist()], pa.string()) for (p,) in pieces(pages)], pa.string())

    return F.arrow_udf(run, "string")(content)


def register(spark: SparkSession) -> None:
    """``extract_links(content, file_type)`` for SQL, as a table function: pos, text, element, attribute, line, column."""
    from pyspark.sql.functions import udtf

    class ExtractLinks:
        def eval(self, content: str, file_type: str):
            lines = Lines(content or "")
            for k, x in enumerate(links_of(content, file_type or "plaintext") if content else []):
                yield k, x.text, x.element, x.attribute, *lines.at(x.offset)

    spark.udtf.register("extract_links", udtf(ExtractLinks, returnType="pos int, text string, element string, attribute string, line int, column int"))
