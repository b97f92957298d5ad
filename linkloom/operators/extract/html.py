"""Links, fragments and visible text of HTML.

``events`` is a tolerant tokenizer that knows where attribute values start; the three
readers below differ in what they keep. Tokens are plain tuples and values are put
together as they are read, as pages have far more elements than links. No tree is built, so malformed pages cost no
more than others.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from functools import cache

from linkloom.operators.extract.css import css_links
from linkloom.operators.extract.linkfinder import is_email_link, plaintext_links
from linkloom.operators.extract.spans import Link
from linkloom.operators.extract.srcset import srcset_urls

# Which attributes hold links.
ANY_ELEMENT_ATTRIBUTES = ("href", "src", "cite", "usemap")
ELEMENT_ATTRIBUTES = frozenset((
    ("applet", "codebase"),
    ("body", "background"),
    ("button", "formaction"),
    ("command", "icon"),
    ("form", "action"),
    ("frame", "longdesc"),
    ("head", "profile"),
    ("html", "manifest"),
    ("iframe", "longdesc"),
    ("img", "longdesc"),
    ("input", "formaction"),
    ("object", "classid"),
    ("object", "codebase"),
    ("object", "data"),
    ("video", "poster"),
))
_ELEMENTS_OF = {a: frozenset(e for e, x in ELEMENT_ATTRIBUTES if x == a) for _, a in ELEMENT_ATTRIBUTES}
# Elements whose content is quoted material, and elements without visible text.
VERBATIM = frozenset("code kbd listing noscript plaintext pre samp script textarea var xmp".split())
HIDDEN = frozenset("head script style template iframe img meter object progress video audio select".split())
# Relations whose links are not followed.
UNFOLLOWED = ("nofollow", "preconnect", "dns-prefetch")
_UNFOLLOWED = re.compile("|".join(UNFOLLOWED))

_RAW_TEXT = frozenset("script style xmp iframe noembed noframes noscript".split())
_ESCAPABLE = frozenset(("textarea", "title"))
_MARK = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<shut>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<open>[A-Za-z][^\s/>]*)", re.S)
_ATTRIBUTE = re.compile(r"[\s/]*(?:(?P<end>>)|(?P<name>[^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"(?P<double>[^\"]*)\"|'(?P<single>[^']*)'|(?P<bare>[^\s>]+)))?)")
_END, _NAME = _ATTRIBUTE.groupindex["end"], _ATTRIBUTE.groupindex["name"]


def _decoded(text: str) -> str:
    return html_lib.unescape(text) if "&" in text else text


@cache
def _shut(name: str) -> re.Pattern:
    """The end of an element of raw text."""
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I)


def events(page: str) -> Iterator[tuple[str, str, dict[str, str], dict[str, int], str, bool, int]]:
    """(kind, name, values, offsets, last attribute's name, flag, offset) of each token; kind is start, end or text.

    Of a start tag, values of repeated attributes are appended; those without a value count
    only by the last name; the flag says that the tag closes itself. Of text, the name is
    the text as it stands, and the flag says that it has character references.
    """
    none: dict = {}
    at, raw = 0, None
    mark, attribute = _MARK.search, _ATTRIBUTE.match
    while at < len(page):
        if raw:
            m = _shut(raw).search(page, at)
            stop = m.start() if m else len(page)
            if stop > at:
                yield "text", page[at:stop], none, none, "", raw not in _RAW_TEXT, at
            at, raw = stop, None
            continue
        m = mark(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            yield "text", page[at:stop], none, none, "", True, at
        if not m:
            return
        at = m.end()
        if m.lastgroup == "shut":
            yield "end", m["shut"].lower(), none, none, "", False, stop
        elif m.lastgroup == "open":
            values: dict[str, str] = {}
            offsets: dict[str, int] = {}
            last = ""
            closed = complete = False
            while a := attribute(page, at):
                at, k = a.end(), a.lastindex
                if k == _END:
                    closed, complete = at - a.start() > 1 and page[at - 2] == "/", True
                    break
                last = a[_NAME].lower()
                if k != _NAME:
                    value = _decoded(a[k]) if "&" in a[k] else a[k]
                    if last in values:
                        values[last] += value
                    else:
                        values[last], offsets[last] = value, a.start(k)
            if not complete:  # a tag without an end is no tag
                return
            name = m["open"].lower()
            yield "start", name, values, offsets, last, closed, stop
            if not closed and (name in _RAW_TEXT or name in _ESCAPABLE):
                raw = name
            if name == "plaintext":
                yield "text", page[at:], none, none, "", False, at
                return


def is_skipped(values: dict[str, str], last: str, loose_rel: bool = False) -> bool:
    """Elements whose links are not taken: unfollowed relations, vocabulary prefixes, disabled or aliased style sheets."""
    rel = values.get("rel")
    if rel is None:
        return "prefix" in values
    if "prefix" in values:
        return True
    if _UNFOLLOWED.search(rel) and (loose_rel or any(t.strip() in UNFOLLOWED for t in rel.split(","))):
        return True
    if "stylesheet" in rel:
        return values.get("href", "").startswith(("/@", "@")) or "disabled" in values or last == "disabled"
    return False


def attribute_links(element: str, values: dict[str, str], offsets: dict[str, int]) -> list[Link]:
    out = []
    if "srcset" in values:
        out = [Link(u, element, "srcset", offsets["srcset"]) for u in srcset_urls(values["srcset"]) if not is_email_link(u)]
    for name, value in values.items():
        if (name in ANY_ELEMENT_ATTRIBUTES or element in _ELEMENTS_OF.get(name, ())) and ("@" not in value or not is_email_link(value) or (name == "href" and value.startswith(("mailto:", "tel:")))):
            out.append(Link(value, element, name, offsets[name]))
    return out


def html_links(page: str, include_verbatim: bool = False, tree_rules: bool = False, offset: int = 0) -> list[Link]:
    """All raw links of a page.

    ``tree_rules`` follows the second rule set: relations match by containment, and
    attributes that hold no links are searched as plain text.
    """
    out: list[Link] = []
    known: set[str | None] = set()  # attributes of the links up to ``fresh``
    fresh = 0
    verbatim: list[str] = []
    style: int | None = None
    css = ""
    for kind, name, values, offsets, last, flag, at in events(page):
        if kind == "start":
            if name == "style":
                style, css = at, ""
            if not include_verbatim and name in VERBATIM:
                verbatim.append(name)
            if values and not verbatim and not is_skipped(values, last, tree_rules):
                out += attribute_links(name, values, offsets)
                if tree_rules:
                    known.update(x.attribute for x in out[fresh:])
                    fresh = len(out)
                    for a, value in values.items():
                        if a not in known and a not in ("srcset", "rel"):
                            out += [Link(x.text, name, a, offsets[a]) for x in plaintext_links(value) if not is_email_link(x.text)]
            if flag and verbatim and verbatim[-1] == name:
                verbatim.pop()
        elif kind == "end":
            if name == "style" and style is not None:
                out += css_links(css, style)
                style = None
            if verbatim and verbatim[-1] == name:
                verbatim.pop()
        elif style is not None:
            if not css:
                style = at
            css += _decoded(name) if flag else name
        elif include_verbatim:
            out += plaintext_links(_decoded(name) if flag else name, at)
    return [x._replace(offset=x.offset + offset) for x in out] if offset else out


def html_fragments(page: str) -> list[str]:
    """``id`` and ``name`` values that a link can point at, in page order."""
    out: dict[str, None] = {}
    for kind, _, values, _, last, _, _ in events(page):
        if kind == "start" and values and not is_skipped(values, last):
            out.update(dict.fromkeys(values[k] for k in ("id", "name") if k in values))
    return list(out)


def visible_text(page: str) -> str:
    """Text outside hidden elements with white space runs as one space. An ``img`` hides what follows up to its end tag."""
    hidden: list[str] = []
    parts: list[str] = []
    for kind, name, _, _, _, flag, _ in events(page):
        if kind == "start":
            if name in HIDDEN:
                hidden.append(name)
        elif kind == "end":
            if hidden and hidden[-1] == name:
                hidden.pop()
        elif not hidden:
            parts.append(_decoded(name) if flag else name)
    return re.sub(r"\s+", " ", "".join(parts))
