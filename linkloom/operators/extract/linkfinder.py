"""URLs and e-mail addresses in plain text.

A URL needs a scheme and ``://``; brackets and quotes end it where they were not opened
in it, and marks of punctuation never are its last character. A mail address needs a
domain with a dot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from linkloom.operators.extract.spans import Link

_TRIGGER = re.compile(r"://|@")
_SCHEME_BEHIND = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*\Z")
_LOCAL_BEHIND = re.compile(r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~.\-\u0080-\U0010ffff]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff](?:[A-Za-z0-9\-\u0080-\U0010ffff]*[A-Za-z0-9\u0080-\U0010ffff])?(?:\.[A-Za-z0-9\u0080-\U0010ffff](?:[A-Za-z0-9\-\u0080-\U0010ffff]*[A-Za-z0-9\u0080-\U0010ffff])?)*")
_STOP = re.compile(r"[\x00-\x20\x7f-\x9f<>\s|`\\^]")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_NEVER_LAST = "?!.,:;*~"
_MATCHED = re.compile(r"""[()\[\]{}"']""")
_MAX_SCHEME = 64


def _url_end(text: str, start: int) -> int:
    """End of the URL whose part after ``://`` starts at ``start``; ``start`` if there is none."""
    stop = _STOP.search(text, start)
    limit = stop.start() if stop else len(text)
    if not _MATCHED.search(text, start, limit):
        return start + len(text[start:limit].rstrip(_NEVER_LAST))
    depth = {"(": 0, "[": 0, "{": 0}
    quotes = {'"': False, "'": False}
    end = start
    for at in range(start, limit):
        c = text[at]
        if c in depth:
            depth[c] += 1
            continue
        if c in _PAIRS:
            depth[_PAIRS[c]] -= 1
            if depth[_PAIRS[c]] < 0:
                break
        elif c in quotes:
            quotes[c] = not quotes[c]
            if quotes[c]:
                continue
        elif c in _NEVER_LAST:
            continue
        end = at + 1
    return end


def _mail_start(text: str, done: int, at: int) -> int:
    """Start of the address whose @ is at ``at``, not before ``done``; -1 if there is none."""
    local = _LOCAL_BEHIND.search(text, max(done, at - 256), at)
    if not local:
        return -1
    start = at - len(local[0].lstrip(".!#$%&'*+/=?^`{|}~"))
    return -1 if start == at or ".." in text[start:at] or text[at - 1] == "." else start


def find_links(text: str, urls: bool = True, emails: bool = True) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of every link, kind ``url`` or ``email``, in text order without overlaps."""
    done = 0
    for m in _TRIGGER.finditer(text):
        at = m.start()
        if at < done:
            continue
        if m[0] == "@":
            if not emails:
                continue
            domain = _DOMAIN.match(text, at + 1)
            if not domain or "." not in domain[0] or (start := _mail_start(text, done, at)) < 0:
                continue
            yield start, domain.end(), "email"
            done = domain.end()
        elif urls:
            scheme = _SCHEME_BEHIND.search(text, max(done, at - _MAX_SCHEME), at)
            if not scheme or (scheme.start() > done and text[scheme.start() - 1].isalnum()):
                continue
            end = _url_end(text, m.end())
            if end == m.end() or (not text[m.end()].isalnum() and text[m.end()] not in "[/_-" and text[m.end()] < "\x80"):
                continue
            if scheme[0].lower() in ("http", "https", "ftp") and text[m.end()] == "/":
                continue
            yield scheme.start(), end, "url"
            done = end


def plaintext_links(text: str, offset: int = 0) -> list[Link]:
    if "@" not in text and "://" not in text:
        return []
    return [Link(text[a:b], None, None, offset + a) for a, b, _ in find_links(text)]


def is_email_link(value: str) -> bool:
    """Whether the whole value, a leading ``mailto:`` aside, is one mail address."""
    if "@" not in value:
        return False
    bare = value.removeprefix("mailto:")
    at = bare.find("@")
    domain = _DOMAIN.match(bare, at + 1)  # of a whole address it is the rest, so there is no other @
    return domain is not None and domain.end() == len(bare) and "." in domain[0] and _mail_start(bare, 0, at) == 0
