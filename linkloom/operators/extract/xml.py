"""Links in sitemaps (``loc``) and feeds (``link`` text, ``link href``).

A scanner, not a tree parser: it takes what comes before the first error and then
stops without complaint. Entities are not decoded.
"""

from __future__ import annotations

import re

from linkloom.operators.extract.spans import Link

_EVENT = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<!(?:[^<>\[]|\[[^\]]*\])*>|<(?P<shut>/)?(?P<tag>[^\s/>!?][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/)?>", re.S)
_ATTRIBUTE = re.compile(r"\s*([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def xml_links(content: str) -> list[Link]:
    out: list[Link] = []
    stack: list[str] = []
    at = 0
    while at < len(content):
        start = content.find("<", at)
        stop = len(content) if start < 0 else start
        text = content[at:stop]
        if stack and stack[-1] in ("loc", "link") and text.strip():
            lead = len(text) - len(text.lstrip())
            out.append(Link(text.strip(), stack[-1], None, at + lead))
        if start < 0:
            return out
        m = _EVENT.match(content, start)
        if not m:
            return out
        at = m.end()
        if m["cdata"] is not None:
            if stack and stack[-1] in ("loc", "link") and m["cdata"].strip():
                out.append(Link(m["cdata"].strip(), stack[-1], None, m.start("cdata")))
            continue
        tag = m["tag"]
        if tag is None:
            continue
        if m["shut"]:
            if not stack or stack.pop() != tag:
                return out
        elif m["empty"]:
            if tag == "link":
                for a in _ATTRIBUTE.finditer(m["rest"]):
                    if a[1] == "href":
                        out.append(Link(a[2] if a[2] is not None else a[3], "link", "href", at))
        else:
            stack.append(tag)
    return out
