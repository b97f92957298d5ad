"""Candidates of a ``srcset`` attribute, as image candidate strings are split.

A URL runs to the next white space. Commas before the first URL, or more than one at
the end of a URL, make the whole attribute void. After a URL a descriptor runs to
the next comma outside brackets.
"""

from __future__ import annotations

import re

_SPACE = " \t\n\f\r"
_URL = re.compile(r"[^ \t\n\f\r]+")


def _after_descriptor(text: str, at: int) -> int:
    depth = 0
    while at < len(text):
        c = text[at]
        at += 1
        if c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            break
    return at


def srcset_urls(value: str) -> list[str]:
    out: list[str] = []
    at = 0
    while True:
        while at < len(value) and value[at] in _SPACE:
            at += 1
        if at == len(value):
            return out
        if value[at] == ",":
            return []
        m = _URL.match(value, at)
        url, at = m[0], m.end()
        commas = len(url) - len(url.rstrip(","))
        if commas > 1:
            return []
        if commas:
            url = url[:-1]
        out.append(url)
        at = _after_descriptor(value, at)
