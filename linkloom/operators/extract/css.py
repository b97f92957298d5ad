"""Links in style sheets: ``url(...)``."""

from __future__ import annotations

import re

from linkloom.operators.extract.spans import Link

#: Fixed pattern of a url(); the same text serves Spark's regular expressions.
URL_PATTERN = r"""url\s*\(\s*(?:"([^"]*)"|'([^']*)'|([^)]+))\s*\)"""
_URL = re.compile(URL_PATTERN)


def css_links(content: str, offset: int = 0) -> list[Link]:
    out = []
    for m in _URL.finditer(content):
        value = next((g for g in m.groups() if g is not None), "").strip()
        if value:
            out.append(Link(value, "style", "url", offset + m.start()))
    return out
