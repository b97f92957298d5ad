"""Main text of web pages by consensus paths of their host.

1. Each page is tokenised once and its containers are scored: a container earns
   the length of the unlinked text of the blocks directly in it, and half of that
   of the blocks in its child containers. The best container votes for its path,
   the chain of tag.class from the root with digits left out.
2. The votes are added up by (host, path) and each host's winner is chosen in
   Spark. Votes are summed in the tasks first, so a host with a third of all pages
   is a few rows by then.
3. Each page is extracted again from all outermost containers at the winning path
   of its host; a page that has none, or no text there, uses its own best one.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are known by tag, role or class and id names and never enter a score
or a text. (A header inside an article is part of it.) A name counts only as a whole:
all its parts between hyphens must be known ones, and one must say what the element
is, so ``site-footer`` and ``article-comments`` match, ``has-sidebar``,
``related-work`` and ``notice-board`` don't. A form, or an element with a name that
layouts give to wrappers too (``sidebar-left`` on a body's only div), stays if a main
or article element is in it or more than half of the page's text; adverts, notices
on cookies and reader comments never do. The winners are broadcast only while they
are at most ``BROADCAST_HOSTS``; beyond that Spark joins by host.

Edge cases: a null or empty html gives an empty text; markup without an end runs to
the end of the page; repeated rows stay; a null url is the host named ''.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import written

BROADCAST_HOSTS = 200_000

_TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_DROP = frozenset("head script style noscript template iframe object svg math nav footer aside button select textarea input dialog menu canvas audio video title noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
_CONTAINER = frozenset("html body div article main section td th blockquote li dd center details figure fieldset header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
#: Names of what is never part of an article.
_NEVER = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promotions banner banners comment comments commentlist disqus replies respond cookie cookies consent gdpr popup popups newsletter newsletters subscribe signup".split())
#: Names of what is beside an article, but also given to elements around one.
_BESIDE = frozenset("sidebar sidebars aside side nav navbar navigation menu menus breadcrumb breadcrumbs crumbs footer footers foot notice notices alert alerts modal modals overlay share sharing social related recommended widget widgets masthead topbar toolbar pagination pager hidden skip login search form".split())
#: And of a page's head, outside an article.
_HEADS = frozenset("header head top".split())
#: Parts that a name may have beside those.
_WITH = frozenset("site page main global bottom left right bar box list area section container wrapper wrap block blocks link links post posts article articles inner outer content contents item items user users reader readers blog primary secondary mobile desktop sticky fixed thread group panel module unit slot zone holder frame message text title meta button buttons home email mail web google js the sub mega small large big mini first second third".split()) | {""}
_PARTS = re.compile(r"[\s_-]+|\d+|(?<=[a-z])(?=[A-Z])")
_P_ENDS = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SCOPES = frozenset("html body div article main section td th blockquote table header footer aside nav form figure fieldset button object".split())
#: An open element of the key tag ends where one of the value tags opens.
_SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_LIST_SCOPES = frozenset("ul ol dl table".split())


class Block:
    """Text of one block: which containers and which doubtful elements hold it."""

    __slots__ = ("chain", "doubts", "parts", "linked")

    def __init__(self, chain: tuple[int, ...], doubts: tuple[int, ...]):
        self.chain, self.doubts, self.parts, self.linked = chain, doubts, [], 0


def host_of(url: str | None) -> str:
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


#: What becomes of an element: it stays, it is dropped, it is dropped unless it holds the article, too.
STAYS, DROPPED, DOUBTFUL = range(3)


def _named(value: str, in_article: bool) -> int:
    """By the names in a class or id."""
    worst = STAYS
    for name in value.split():
        parts = {x.lower() for x in _PARTS.split(name)}
        if not parts <= _NEVER | _BESIDE | _HEADS | _WITH:
            continue
        if parts & _NEVER:
            return DROPPED
        if parts & _BESIDE or (parts & _HEADS and not in_article):
            worst = DOUBTFUL
    return worst


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    if tag in _DROP or (tag == "header" and not in_article):
        return DROPPED
    worst = DOUBTFUL if tag == "form" else STAYS
    if not attributes or tag in ("html", "body", "main"):
        return worst
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.lower().replace(" ", "")):
            return DROPPED
        if name == "role" and value.lower() in _ROLES:
            worst = DOUBTFUL
        if name in ("class", "id"):
            found = _named(value, in_article)
            if found == DROPPED:
                return DROPPED
            worst = worst or found
    return worst


def _step(tag: str, attributes: str) -> str:
    for m in _ATTRIBUTE.finditer(attributes or ""):
        if m[1].lower() == "class":
            first = re.sub(r"\d+", "", (m[2] or m[3] or m[4] or "").lower()).split()
            return f"{tag}.{first[0]}" if first else tag
    return tag


def blocks_of(page: str) -> tuple[list[Block], list[tuple[str, str, int]]]:
    """The text blocks of a page and its containers (path, tag, number of the container around it or -1)."""
    blocks: list[Block] = []
    containers: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, int, tuple[int, ...]]] = []  # (tag, path, container, doubtful elements around)
    n_doubts, holders = 0, set()  # of the doubtful elements, those that hold an article or main
    skip = 0  # depth of the stack at which dropping began, plus 1
    articles = links = at = 0
    block: Block | None = None

    def close(depth: int) -> None:
        nonlocal skip, articles, links
        while len(stack) > depth:
            tag = stack.pop()[0]
            articles -= tag in ("article", "main")
            links -= tag == "a"
            if skip and len(stack) < skip:
                skip = 0

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not skip:
            text = page[at:stop]
            if "&" in text:
                text = html_lib.unescape(text)
            if block is None:
                k = stack[-1][2] if stack else -1
                chain = []
                while k >= 0:
                    chain.append(k)
                    k = containers[k][2]
                block = Block(tuple(chain), stack[-1][3] if stack else ())
            block.parts.append(text)
            if links:
                block.linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        shut, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if (tag in _BLOCK or tag in _CONTAINER) and block is not None:
            blocks.append(block)
            block = None
        if tag in ("br", "img", "wbr") and block is not None:
            if tag == "br":
                block.parts.append(" ")
        if shut:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == tag:
                    close(d)
                    break
                if tag == "p" and stack[d][0] in _SCOPES:
                    break
            continue
        if tag in _P_ENDS:  # a paragraph ends before the next block
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == "p":
                    close(d)
                    break
                if stack[d][0] in _SCOPES:
                    break
        elif tag in _SAME_ENDS:
            for d in range(len(stack) - 1, -1, -1):
                if tag in _SAME_ENDS.get(stack[d][0], ()):
                    close(d)
                    break
                if stack[d][0] in _LIST_SCOPES:
                    break
        if tag in _VOID:
            continue
        if tag == "body" and skip and stack[skip - 1][0] == "head":
            close(skip - 1)
        if tag in _RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = found.end() if found else end
            continue
        if attributes.endswith("/") and tag not in _BLOCK:
            continue
        parent = stack[-1] if stack else ("", "", -1, ())
        doubts = parent[3]
        if not skip:
            kind = _kind(tag, attributes, articles > 0)
            if kind == DROPPED:
                skip = len(stack) + 1
            elif kind == DOUBTFUL:
                doubts = (*doubts, n_doubts)
                n_doubts += 1
            if not skip and tag in ("article", "main"):
                holders.update(doubts)
        path = f"{parent[1]}>{_step(tag, attributes)}" if not skip else ""
        own = parent[2]
        if tag in _CONTAINER and not skip:
            own = len(containers)
            containers.append((path, tag, parent[2]))
        stack.append((tag, path, own, doubts))
        articles += tag in ("article", "main")
        links += tag == "a"
    if block is not None:
        blocks.append(block)
    if n_doubts:
        sizes, total = Counter(), 0
        for b in blocks:
            n = len(_text(b))
            total += n
            for k in b.doubts:
                sizes[k] += n
        holders.update(k for k, n in sizes.items() if 2 * n > total)
        blocks = [b for b in blocks if holders.issuperset(b.doubts)]
    return blocks, containers


def _text(block: Block) -> str:
    return " ".join("".join(block.parts).split())


def best_container(blocks: list[Block], containers: list[tuple[str, str, int]]) -> int:
    """The container with the highest score, or the article or main around it; -1 if none has text."""
    scores: Counter[int] = Counter()
    for b in blocks:
        if b.chain:
            n = len(_text(b)) - 2 * b.linked
            if n > 0:
                scores[b.chain[0]] += n
                if len(b.chain) > 1:
                    scores[b.chain[1]] += n / 2
    if not scores:
        return -1
    k = best = max(scores, key=lambda c: (scores[c], -c))
    while k >= 0:
        if containers[k][1] in ("article", "main"):
            return k
        k = containers[k][2]
    return best


def extract(page: str | None, winner: str | None) -> str:
    """The text at the winning path of a page's host, or else of its own best container."""
    if not page:
        return ""
    blocks, containers = blocks_of(page)
    if winner is not None:
        chosen = {k for k, c in enumerate(containers) if c[0] == winner}
        texts = [t for b in blocks if not chosen.isdisjoint(b.chain) and (t := _text(b))]
        if texts:
            return "\n\n".join(texts)
    best = best_container(blocks, containers)
    return "\n\n".join(t for b in blocks if (best in b.chain or best < 0) and (t := _text(b)))


def vote(urls: list[str | None], pages: list[str | None]) -> Counter:
    """Votes by (host, path)."""
    votes: Counter[tuple[str, str]] = Counter()
    for url, page in zip(urls, pages, strict=True):
        if page:
            blocks, containers = blocks_of(page)
            best = best_container(blocks, containers)
            if best >= 0:
                votes[host_of(url), containers[best][0]] += 1
    return votes


def host_paths(pages: DataFrame) -> DataFrame:
    """Per host: host, path, votes of the winning path (of equal ones the first in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = vote(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], names=["host", "path", "votes"])

    votes = pages.select("url", "html").mapInArrow(run, "host string, path string, votes bigint")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("less"), "path")).alias("best")).select("host", "best.path", (-F.col("best.less")).alias("votes"))


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    winners = written(host_paths(pages), "host-paths").select(F.col("host").alias("winner_host"), F.col("path").alias("winner"))
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = pages.select("page_id", "url", "html").join(winners, host == F.col("winner_host"), "left").select("page_id", "url", "html", "winner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, w) for p, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
