"""Links and heading fragments of Markdown.

A scanner for the parts of CommonMark that decide what is a link: block structure
(quotes, lists and footnotes at any depth; in them fences, indented code, HTML blocks,
headings, rules, definitions and text) and, in running text, code spans, math, inline
HTML, autolinks, links, images and wikilinks.
"""

from __future__ import annotations

import html as html_lib
import re
from functools import cache
from typing import NamedTuple

from linkloom.operators.extract.html import html_fragments, html_links
from linkloom.operators.extract.linkfinder import plaintext_links
from linkloom.operators.extract.spans import Link

_FENCE = re.compile(r" {0,3}(?P<mark>`{3,}|~{3,})(?P<info>[^\n]*)")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(?P<text>.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_HTML_BLOCK = re.compile(r" {0,3}<(?:/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$)|!--|\?|![A-Z])")
_BLOCK_TAGS = frozenset(
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul pre script style textarea".split()
)
_OPEN_TAG = re.compile(r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[^<>\"']*(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)?\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>|<!--.*?-->", re.S)
_DEFINITION = re.compile(r" {0,3}\[(?P<label>(?!\^)(?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<(?P<angle>[^<>\n]*)>|(?P<bare>\S+))[ \t]*(?:\n?[ \t]*(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*(?=\n|\Z)")
_ITEM = re.compile(r"(?:[-*+]|(?P<number>\d{1,9})[.)])(?=[ \t]|$)")
_SPACE = re.compile(r"\s*")
_BLANK = re.compile(r"[ \t]*$")
_BLANK_REST = re.compile(r"[^\S\n]*(?:\n|\Z)")
_RULE = re.compile(r"([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_FRONT_MATTER = re.compile(r"(---|\+\+\+)\n(?:.*\n)*?\1[ \t]*(?:\n|\Z)")
_FOOTNOTE = re.compile(r" {0,3}\[\^[^\]\s]+\]:")
_AUTOLINK = re.compile(r"<(?P<url>[A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+)>")
_TARGET = re.compile(r"\(\s*(?:<(?P<angle>(?:[^<>\n\\]|\\.)*)>|(?P<bare>(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\([^\s()]*\))*\))*))(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
_WIKILINK = re.compile(r"\[\[(?P<inner>[^\[\]\n]+)\]\]")
_EXPLICIT_ID = re.compile(r"[ \t]*\{(?P<inner>[^{}]*)\}[ \t]*$")
_SPECIAL = re.compile(r"[\\`$<\[]|!(?=\[)")
_BRACKET = re.compile(r"[\\`\[\]]")
_RUN = re.compile(r"`+")
_MATH = re.compile(r"\$\$.+?\$\$|\$(?!\s)(?:[^$\n\\]|\\.)+?(?<!\s)\$(?!\d)", re.S)
_TAG_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9-]*)")
_QUOTING = re.compile(r"<(code|pre|kbd|samp|var|script|textarea)\b", re.I)
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
# Fixed value: with what a line that is more than text can begin; a footnote's bracket aside.
_OPENERS = frozenset("\n \t>-*+0123456789`~#=_<")


@cache
def _end_of_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def _end_of_code(text: str, run: str, at: int) -> re.Match | None:
    """The run of back quotes that ends the code span whose text starts at ``at``."""
    end = text.find(run, at)
    while end >= 0:
        m = _RUN.match(text, end)
        if len(m[0]) == len(run):
            return m
        end = text.find(run, m.end())
    return None


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


class Block(NamedTuple):
    """A leaf block: code, html, heading, definition or text. ``shown`` starts at ``at`` of the document; marks of quotes and lists in it are spaces, so places in it are places in the document."""

    kind: str
    at: int
    shown: str


class _Cursor:
    """A line of the document, of which containers take marks and columns of indentation."""

    __slots__ = ("text", "at", "end", "col", "spare")

    def __init__(self, text: str, at: int, end: int):
        self.text, self.at, self.end = text, at, end
        self.col = self.spare = 0  # column of ``at``, and columns left of a tab that was taken in part

    def indent(self) -> tuple[int, int]:
        """Columns of white space from here, and where it ends."""
        at, col = self.at, self.col
        if at < self.end and self.text[at] not in " \t":
            return self.spare, at
        while at < self.end and self.text[at] in " \t":
            col += 1 if self.text[at] == " " else 4 - col % 4
            at += 1
        return self.spare + col - self.col, at

    def skip(self, columns: int) -> None:
        """Takes so many columns of white space, or what there is of them."""
        if not columns:
            return
        taken = min(columns, self.spare)
        self.spare -= taken
        while taken < columns and self.at < self.end and self.text[self.at] in " \t":
            width = 1 if self.text[self.at] == " " else 4 - self.col % 4
            self.at, self.col = self.at + 1, self.col + width
            self.spare = max(0, taken + width - columns)
            taken += width

    def take(self, chars: int) -> None:
        self.at, self.col, self.spare = self.at + chars, self.col + chars, 0

    def rest(self) -> str:
        return self.text[self.at : self.end]


class _Blocks:
    """Line by line: which containers go on, which open, and to which leaf the rest of the line belongs."""

    def __init__(self, text: str):
        self.text = text
        self.out: list[Block] = []
        self.within: list[list] = []  # containers: None for a quote, else [columns that a line of the item is indented by, whether it is still empty]
        self.leaf: str | None = None
        self.parts: list[tuple[int, int]] = []
        self.fence = self.until = ""
        self.tag_end = 0

    def close(self, as_heading: bool = False) -> None:
        """Ends the open leaf."""
        kind, parts, self.leaf, self.parts = self.leaf, self.parts, None, []
        if kind == "code" and not self.fence:
            while parts and not self.text[slice(*parts[-1])].strip():
                parts.pop()
        if not parts:
            return
        start = end = parts[0][0]
        if parts[-1][1] - start == len(parts) - 1 + sum([b - a for a, b in parts]):  # whole lines without marks between them
            shown = self.text[start : parts[-1][1]]
        else:
            pieces = []
            for a, b in parts:
                pieces.append(("\n" + " " * (a - end - 1) if a > end else "") + self.text[a:b])
                end = b
            shown = "".join(pieces)
        if kind == "text":
            cut = 0  # the rest is cut off once, however many definitions come first
            while cut < len(shown) and shown[cut] in "[ " and (m := _DEFINITION.match(shown, cut)):
                self.out.append(Block("definition", start + cut, m[0]))
                cut = _SPACE.match(shown, m.end()).end()
            start, shown = start + cut, shown[cut:]
            kind = "heading" if as_heading else "text"
        if shown:
            self.out.append(Block(kind, start, shown))

    def leave(self, depth: int) -> None:
        """Ends the containers beyond ``depth``, with the leaf in them."""
        if depth < len(self.within):
            self.close()
            del self.within[depth:]

    def line(self, at: int, end: int) -> None:
        if self.leaf in (None, "text") and not self.within and (first := self.text[at]) not in _OPENERS and (first != "[" or not self.text.startswith("[^", at)):  # nothing but text can begin so
            if self.leaf is None:
                self.begin("text", None, "")
            self.parts.append((at, end))
            return
        c = _Cursor(self.text, at, end)
        depth = 0
        for box in self.within:
            width, ink = c.indent()
            if box is None:
                if width > 3 or self.text[ink : ink + 1] != ">" or ink >= end:
                    break
                c.skip(width)
                c.take(1)
                c.skip(1)
            elif ink >= end and not box[1]:
                c.skip(width)
            elif width >= box[0] and ink < end:
                c.skip(box[0])
            else:
                break
            depth += 1
        whole = depth == len(self.within)
        if whole and self.leaf in ("code", "html") and self.goes_on(c):
            return
        lazy = self.leaf == "text" and not whole
        marks = -1  # a rule can only be behind all else
        while True:  # containers that begin here
            width, ink = c.indent()
            if width > 3 or ink >= end or self.text[ink].isalpha():
                break
            first = self.text[ink]
            item = _ITEM.match(self.text, ink, end) if first in "-*+0123456789" else None
            note = _FOOTNOTE.match(self.text, ink, end) if first == "[" else None
            if item:
                inside = self.leaf == "text" and whole and depth == len(self.within)
                marks = at + len(self.text[at:end].rstrip(" \t-*_")) if marks < 0 else marks
            if first == ">":
                self.enter(depth, None)
                c.skip(width)
                c.take(1)
                c.skip(1)
            elif note:
                self.enter(depth, [4, False])
                c.skip(width)
                c.take(note.end() - ink)
            elif item and not (ink >= marks and _RULE.match(self.text, ink, end)) and not (inside and (_BLANK.match(self.text, item.end(), end) or item["number"] not in (None, "1"))):
                c.skip(width)
                c.take(item.end() - ink)
                gap, text_at = c.indent()
                bare = text_at >= end
                gap = 1 if bare or gap > 4 else gap
                self.enter(depth, [width + item.end() - ink + gap, bare])
                c.skip(gap)
            else:
                break
            depth += 1
            lazy, whole = False, True
        self.last(c, depth, lazy, width, ink)

    def enter(self, depth: int, box: list | None) -> None:
        self.leave(depth)
        self.close()
        self.filled()
        self.within.append(box)

    def goes_on(self, c: _Cursor) -> bool:
        """Whether the line belongs to the open code or HTML; the last line of a fence does, too."""
        width, ink = c.indent()
        if self.leaf == "code" and self.fence:
            if width < 4 and self.text.startswith(self.fence, ink, c.end) and re.match(rf"{re.escape(self.fence[0])}{{{len(self.fence)},}}\s*$", self.text[ink : c.end]):
                self.close()
            else:
                self.parts.append((c.at, c.end))
            return True
        if self.leaf == "code":
            if width < 4 and ink < c.end:
                return False
            self.parts.append((c.at, c.end))
            return True
        rest = c.rest()
        if not self.until and not rest.strip() and c.at >= self.tag_end:
            self.close()
            return True
        self.parts.append((c.at, c.end))
        if self.until and self.until in rest.lower():
            self.close()
        return True

    def last(self, c: _Cursor, depth: int, lazy: bool, width: int, ink: int) -> None:
        """The rest of a line, behind the marks of its containers and ``width`` columns of white space up to ``ink``."""
        if ink >= c.end:  # blank
            self.leave(depth)
            if self.leaf:
                self.close()
            return
        rest = self.text[ink : c.end]
        if width > 3:
            if self.leaf == "text":
                self.parts.append((ink, c.end))
                return
            self.leave(depth)
            self.close()
            self.begin("code", (c.at, c.end), "")
            return
        fence = _FENCE.match(rest) if rest[0] in "`~" else None
        if fence and not (fence["mark"][0] == "`" and "`" in fence["info"]):
            self.leave(depth)
            self.close()
            self.begin("code", None, fence["mark"])
        elif rest[0] == "#" and _HEADING.match(rest):
            self.leave(depth)
            self.close()
            self.filled()
            self.out.append(Block("heading", ink, rest))
        elif self.leaf == "text" and not lazy and rest[0] in "=-" and _UNDERLINE.match(rest):
            self.close(as_heading=True)
        elif rest[0] in "-*_" and _RULE.match(rest):
            self.leave(depth)
            self.close()
            self.filled()
        elif rest[0] != "<" or not self.html(c, ink, rest, depth):
            if self.leaf != "text":
                self.leave(depth)
                self.close()
                self.begin("text", None, "")
            self.parts.append((ink, c.end))

    def html(self, c: _Cursor, ink: int, rest: str, depth: int) -> bool:
        """Whether a block of HTML begins here; it is opened then."""
        if not _HTML_BLOCK.match(rest):
            return False
        name = _TAG_NAME.match(rest)
        known = not name or name[1].lower() in _BLOCK_TAGS
        tag_end = ink
        if not known and self.leaf != "text":
            m = _OPEN_TAG.match(self.text, ink)
            known = bool(m) and bool(_BLANK_REST.match(self.text, m.end())) and ("\n" not in m[0] or name[1][0].isupper())
            tag_end = m.end() if m else ink
        if not known:
            return False
        self.leave(depth)
        self.close()
        self.begin("html", (ink, c.end), "")
        self.tag_end = tag_end
        raw = name and name[1].lower() in ("pre", "script", "style", "textarea") and rest[1] != "/"
        self.until = f"</{name[1].lower()}>" if raw else "" if name else "-->" if rest.startswith("<!--") else "?>" if rest.startswith("<?") else ">"
        if self.until and self.until in rest.lower():
            self.close()
        return True

    def filled(self) -> None:
        """The innermost container is no longer empty; those around it have not been since it began."""
        if self.within and self.within[-1]:
            self.within[-1][1] = False

    def begin(self, leaf: str, part: tuple[int, int] | None, fence: str) -> None:
        self.filled()
        self.leaf, self.parts, self.fence, self.until = leaf, [part] if part else [], fence, ""


def blocks(text: str) -> list[Block]:
    """The leaf blocks of a document in order, those in quotes, lists and footnotes too, however they are nested."""
    found, at = _Blocks(text), 0
    if front := _FRONT_MATTER.match(text):  # is no text
        at = front.end()
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        found.line(at, end)
        at = end + 1
    found.close()
    return found.out


def _plain(text: str) -> str:
    if "\\" in text:
        text = _ESCAPE.sub(r"\1", text)
    return html_lib.unescape(text) if "&" in text else text


def _closing(text: str, at: int) -> int:
    """Where the bracket that opens at ``at`` closes, -1 if it does not."""
    depth, k = 0, at
    while m := _BRACKET.search(text, k):
        k, c = m.start(), m[0]
        if c == "\\":
            k += 2
            continue
        if c == "`":
            run = _RUN.match(text, k)[0]
            end = _end_of_code(text, run, k + len(run))
            k = end.end() if end else k + len(run)
            continue
        depth += (c == "[") - (c == "]")
        if not depth:
            return k
        k += 1
    return -1


class _Inline:
    """Scans running text that starts at ``offset`` of the document."""

    def __init__(self, definitions: dict[str, str], verbatim: bool, wikilinks: bool):
        self.definitions, self.verbatim, self.wikilinks = definitions, verbatim, wikilinks
        self.links: list[Link] = []

    def scan(self, text: str, offset: int, linked: bool = False) -> None:
        """``linked``: the text of a link, whose own links count only with ``verbatim``."""
        bare_from = at = 0
        marked = (not linked or self.verbatim) and ("@" in text or "://" in text)

        def bare(upto: int) -> None:
            if marked and upto > bare_from:
                self.links.extend(plaintext_links(text[bare_from:upto], offset + bare_from))

        while m := _SPECIAL.search(text, at):
            at, c = m.start(), m[0]
            took = 0
            if c == "\\":
                at += 2
                continue
            if c == "`":
                run = _RUN.match(text, at)[0]
                end = _end_of_code(text, run, at + len(run))
                if end:
                    bare(at)
                    if self.verbatim:
                        self.links.extend(plaintext_links(text[at + len(run) : end.start()], offset + at + len(run)))
                    took = end.end()
                else:
                    at += len(run)
                    continue
            elif c == "$":
                m = _MATH.match(text, at)
                if m:
                    bare(at)
                    took = m.end()
            elif c == "<":
                m = _AUTOLINK.match(text, at)
                if m:
                    bare(at)
                    self.links.extend(plaintext_links(m["url"], offset + at + 1) if not linked or self.verbatim else [])
                    took = m.end()
                else:
                    m = _OPEN_TAG.match(text, at)
                    if m:
                        bare(at)
                        self.links.extend(html_links(m[0], self.verbatim, offset=offset + at))
                        took = m.end()
                        name = _QUOTING.match(m[0])
                        if name and not self.verbatim and not m[0].endswith("/>"):
                            end = _end_of_tag(name[1].lower()).search(text, took)
                            took = end.end() if end else took
            else:
                took = self._bracket(text, at, offset, bare)
            if took:
                bare_from = at = took
            else:
                at += 1
        bare(len(text))

    def _bracket(self, text: str, at: int, offset: int, bare) -> int:
        image = text[at] == "!"
        start = at + image
        if not image and self.wikilinks and (w := _WIKILINK.match(text, at)):
            bare(at)
            target = w["inner"].split("|", 1)[0].split("#", 1)[0].strip()
            if target and target not in ("TOC", "_TOC_"):
                self.links.append(Link(target, "a", "wikilink", offset + at + 2))
            return w.end()
        m = _BRACKET.search(text, start + 1)
        end = -1 if m is None else m.start() if m[0] == "]" else _closing(text, start)
        if end < 0:
            return 0
        label = text[start + 1 : end]
        if label.startswith("^") and not image:  # a footnote's mark
            bare(at)
            return end + 1
        target = stop = None
        m = _TARGET.match(text, end + 1)
        if m:
            target, stop = _plain(m["angle"] if m["angle"] is not None else m["bare"]), m.end()
        elif not self.definitions:
            return 0
        elif text.startswith("[", end + 1) and (close := _closing(text, end + 1)) > 0:
            target, stop = self.definitions.get(_label(text[end + 2 : close] or label)), close + 1
        if target is None:
            target, stop = self.definitions.get(_label(label)), end + 1
        if target is None:
            return 0
        bare(at)
        self.links.append(Link(target, "img" if image else "a", "src" if image else "href", offset + at))
        if not image and (self.verbatim or _SPECIAL.search(label)):
            self.scan(label, offset + start + 1, linked=True)
        return stop


def _definitions(found: list[Block]) -> dict[str, str]:
    out: dict[str, str] = {}
    for b in found:
        if b.kind == "definition" and (m := _DEFINITION.match(b.shown)):
            out.setdefault(_label(m["label"]), _plain(m["angle"] if m["angle"] is not None else m["bare"]))
    return out


def markdown_links(text: str, include_verbatim: bool = False, include_wikilinks: bool = False) -> list[Link]:
    found = blocks(text)
    inline = _Inline(_definitions(found), include_verbatim, include_wikilinks)
    for b in found:
        if b.kind in ("text", "heading"):
            inline.scan(b.shown, b.at)
        elif b.kind == "html":
            inline.links.extend(html_links(b.shown, include_verbatim, offset=b.at))
        elif b.kind == "code" and include_verbatim:
            inline.links.extend(plaintext_links(b.shown, b.at))
    return inline.links


def heading_id(text: str) -> str:
    """Lower case; letters, digits, ``_`` and ``-`` stay, every white space becomes a dash, all else goes."""
    return "".join("-" if c.isspace() else c for c in text.lower() if c.isalnum() or c in "_-" or c.isspace())


def _heading_text(raw: str) -> str:
    """What a reader sees of a heading; line ends in it are no text."""
    raw = re.sub(r"[ \t]*\n[ \t]*", "", raw)
    raw = re.sub(r"(`+)(.+?)\1", lambda m: m[2].strip(), raw)
    raw = re.sub(r"!?\[((?:[^\[\]]|\[[^\]]*\])*)\](?:\([^)]*\)|\[[^\]]*\])?", r"\1", raw)
    raw = re.sub(r"</?[A-Za-z][^>]*>", "", raw)
    raw = re.sub(r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", raw)
    raw = re.sub(r"(?<![\w*])([*_])(?=\S)(.+?)(?<=\S)\1(?![\w*])", r"\2", raw)
    return _plain(raw)


def markdown_fragments(text: str) -> list[str]:
    """Explicit and generated heading ids and the ids of embedded HTML, in document order."""
    out: dict[str, None] = {}
    seen: dict[str, int] = {}
    for kind, _, line in blocks(text):
        if kind == "heading":
            m = _HEADING.match(line)
            title = (m["text"] or "") if m else line.strip()
            explicit = _EXPLICIT_ID.search(title)
            if explicit and (named := re.search(r"#([^\s#.]+)", explicit["inner"])):
                out[named[1]] = None
                title = title[: explicit.start()]
            shown = _heading_text(title)
            if shown:
                base = heading_id(shown)
                n = seen.get(base, 0)
                seen[base] = n + 1
                out[f"{base}-{n}" if n else base] = None
            out.update(dict.fromkeys(html_fragments(title)))
        elif kind == "html":
            out.update(dict.fromkeys(html_fragments(line)))
        elif kind == "text":
            for m in _OPEN_TAG.finditer(re.sub(r"(`+).+?\1", lambda m: " " * len(m[0]), line, flags=re.S)):
                out.update(dict.fromkeys(html_fragments(m[0])))
    return list(out)
