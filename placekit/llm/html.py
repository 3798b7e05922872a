"""Main text of web pages by removal of site templates.

A page is parsed into a tree of elements. Each element outside the article, and each container inside it, is hashed
with all it holds; Spark counts on how many pages of a host each hash occurs; elements that recur on many pages of
their host are deleted with all they hold. So are elements that say by tag, role, class or id that they are menus,
adverts, comments and the like. What remains of the article (or the page, if it marks none) is the text, block by block.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placekit.llm.common import cut, slices

MIN_PAGES = 8
SHARE_OUTSIDE, SHARE_INSIDE = 0.02, 0.6
SHORT = 120  # characters; a block of an article named like a frame is one if no longer, and what holds most of a page is longer
H1, MAIN, MAIN_TEXT, MOST = 1, 2, 4, 8

# The tags and words of the markup language and of common page frames.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
DROP = frozenset("head script style noscript template title textarea nav aside footer form button select input option optgroup fieldset dialog menu "
                 "iframe object embed applet canvas svg math audio video map noembed noframes xmp".split())
# of these, what may be a wrapper around a page's text
WRAPPERS = frozenset("form fieldset dialog".split())
MAY_HOLD = WRAPPERS | {"nav", "aside", "footer", "menu"}
IN_HEAD = frozenset("head base link meta title style script noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
FRAME_WORDS = frozenset("nav navbar navigation menu menus header masthead footer sidebar sidebars aside ad ads adv advert adverts advertisement advertising adsense sponsor sponsored "
                        "sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
                        "login comment comments commentlist disqus reply replies respond share sharing social breadcrumb breadcrumbs related recommended recommendations pagination "
                        "pager toolbar widget widgets skip".split())
# names of readers' comments, and words that say nothing of what a block holds
COMMENTS = frozenset("comments commentlist disqus replies respond".split())
PLAIN_WORDS = frozenset("area bar block bottom box button buttons container content group icon icons inner item items left link links list main module page panel post posts right row "
                        "section site slot top unit widget wrap wrapper".split())
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
             "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPES = frozenset("article body div section main td th table ul ol dl li blockquote form fieldset aside header footer nav figure button details".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<(?=/?[a-zA-Z])[^>]*\Z|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict[str, str]
    parts: list = field(default_factory=list)  # texts and elements, in page order
    holds: int = 0  # which of H1, MAIN and MAIN_TEXT are inside it, and whether most of the page's text is (MOST)
    plain: int = 0  # characters of text inside it that is no link, and
    linked: int = 0  # of links


class Open:
    """The open elements of a page, and the places of each tag among them, so depth costs nothing."""

    def __init__(self, root: Element):
        self.stack, self.places = [root], {}

    def push(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.stack))
        self.stack.append(e)

    def close(self, tags, until=()) -> None:
        """Close the nearest open element of ``tags``, unless one of ``until`` comes before."""
        at = self._last(tags)
        if at and at >= self._last(until):
            for e in self.stack[at:]:
                self.places[e.tag].pop()
            del self.stack[at:]

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def parse(html: str) -> Element:
    """The tree of a page. Whatever isn't closed ends with what it is in; markup cut off at the end is dropped."""
    root = Element("#page", {})
    opened, at, end = Open(root), 0, len(html)
    stack = opened.stack
    while at < end:
        m = _MARKUP.search(html, at)
        if (until := m.start() if m else end) > at:
            if stack[-1].tag == "head" and not html[at:until].isspace():
                opened.close(("head",))
            stack[-1].parts.append(html[at:until])
        if m is None:
            break
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            opened.close((tag,))
            continue
        if tag not in IN_HEAD:
            opened.close(("head",))  # its end tag may be left out
        if tag in BLOCK:
            opened.close(("p",), SCOPES)
        if tag in CLOSED_BY:
            opened.close(*CLOSED_BY[tag])
        element = Element(tag, {a[1].lower(): entities.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(rest)} if rest.strip(" /") else {})
        stack[-1].parts.append(element)
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            if close is None:
                break
            at = close.start()
        if tag not in VOID and not rest.endswith("/"):
            opened.push(element)
    for e, _ in _walk(root):
        for p in e.parts:
            if isinstance(p, str):
                e.plain += len(" ".join(p.split()))
                continue
            e.holds |= p.holds | (H1 if p.tag == "h1" else 0)
            if is_main(p):
                e.holds |= MAIN if is_frame(p, True) else MAIN | MAIN_TEXT
            if p.tag not in DROP or p.tag in WRAPPERS:
                e.plain += 0 if p.tag == "a" else p.plain
                e.linked += p.linked + (p.plain if p.tag == "a" else 0)
    for e, _ in _walk(root):
        e.holds |= MOST if 2 * e.plain > root.plain and e.plain > SHORT else 0
    return root


def is_frame(e: Element, inside: bool) -> bool:
    """Whether an element says of itself that it is part of the page's frame.

    A header inside an article that holds its title is none, nor is anything that holds an article. On a page that marks
    no article, a name or a form around most of the text is none. Inside an article a name alone isn't enough.
    """
    if "hidden" in e.attributes:
        return True
    if e.tag in DROP and not (e.tag in WRAPPERS and not inside and e.holds & MOST):
        return not (e.holds & MAIN_TEXT and e.tag in MAY_HOLD)
    if e.tag in ("html", "body", "main", "#page"):
        return False
    if e.tag == "article":  # may be a reader's comment
        return bool({"comment", "comments", "reply"} & set(e.attributes.get("class", "").lower().split()))
    most = not inside and e.holds & MOST
    said = FRAME_WORDS & set().union(*_names(e))
    if e.tag == "header" or not inside and said and said <= {"header"}:
        return not (inside and e.holds & H1) and not e.holds & MAIN and not most
    if e.holds & MAIN_TEXT or most:
        return False
    return e.attributes.get("role", "").lower() in ROLES or (frame_in_article(e) if inside else bool(said))


def frame_in_article(e: Element) -> bool:
    """Whether a block of an article that is named like a frame is one: readers' comments, mostly links, or a short block."""
    if any(COMMENTS & set(words) for words in _names(e)):
        return True
    if not named_frame(e) or e.holds & H1:
        return False
    return e.linked >= max(1, e.plain) or e.tag not in PARAGRAPH and e.plain + e.linked <= SHORT


def named_frame(e: Element) -> bool:
    """A class or id of nothing but words of frames, and words that say nothing of what is in it."""
    return any(FRAME_WORDS & set(words) and set(words) <= FRAME_WORDS | PLAIN_WORDS for words in _names(e))


def _names(e: Element) -> list[list[str]]:
    """Words of each class and the id of an element; names such as "no-sidebar" or "has-menu" speak of others."""
    out = []
    for name in f"{e.attributes.get('class', '')} {e.attributes.get('id', '')}".split():
        words = [w.lower() for w in _SPLIT.split(name) if w]
        if words and words[0] not in ("no", "not", "has", "is", "with", "without"):
            out.append(words)
    return out


def is_main(e: Element) -> bool:
    return e.tag in ("article", "main") or e.attributes.get("role", "").lower() in ("main", "article")


def _walk(root: Element) -> Iterator[tuple[Element, bool]]:
    """Elements outside frames, each after what it holds, with whether it is inside an article."""
    stack = [(root, False, False)]
    while stack:
        e, inside, seen = stack.pop()
        if seen:
            yield e, inside
            continue
        stack.append((e, inside, True))
        inner = inside or is_main(e)
        stack += [(p, inner, False) for p in e.parts if isinstance(p, Element)]


def subtree_hashes(root: Element, host: str) -> dict[int, tuple[int, bool]]:
    """Hash of each element that may be part of a template, by the element's identity, with whether it is inside an article.

    The host is part of each hash. Elements without text have none; paragraphs inside an article are templates only if
    they are named like a frame, and what is so named counts as if it were outside.
    """
    own: dict[int, bytes] = {}
    out: dict[int, tuple[int, bool]] = {}
    for e, inside in _walk(root):
        said = [e.tag.encode(), e.attributes.get("class", "").encode("utf-8", "surrogatepass")]
        text = False
        for p in e.parts:
            if isinstance(p, str):
                words = " ".join(p.split())
                text |= bool(words)
                said.append(words.encode("utf-8", "surrogatepass"))
            else:
                inner = own[id(p)]
                text |= inner != b""
                said.append(inner)
        value = hashlib.blake2b(b"\x1f".join(said), digest_size=8).digest() if text else b""
        own[id(e)] = value
        inside = inside and not named_frame(e)
        if value and e.tag not in ("#page", "html", "body") and not is_main(e) and not (inside and e.tag in PARAGRAPH):
            key = hashlib.blake2b(value + (b"\1" if inside else b"\0") + host.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            out[id(e)] = (int.from_bytes(key, "little", signed=True), inside)
    return out


def main_part(root: Element) -> set[int]:
    """Of a page that marks no article: the elements, by identity, that no template deletes.

    They are those that hold most of the text outside frames, and the paragraphs in the innermost container of them.
    """
    frames, size = set(), {}
    stack = [root]
    while stack:
        e = stack.pop()
        if is_frame(e, False):
            frames.add(id(e))
        else:
            stack += [p for p in e.parts if isinstance(p, Element)]
    for e, _ in _walk(root):
        size[id(e)] = 0 if id(e) in frames else sum(len(" ".join(p.split())) if isinstance(p, str) else size[id(p)] for p in e.parts)
    kept, top, e = set(), root, root
    while e is not None and size[id(root)]:
        kept.add(id(e))
        top = e if e.tag in BLOCK and e.tag not in PARAGRAPH else top
        e = next((p for p in e.parts if isinstance(p, Element) and 2 * size[id(p)] > size[id(root)]), None)
    if top.tag not in ("#page", "html", "body"):
        kept |= {id(x) for x, _ in _walk(top) if x.tag in PARAGRAPH}
    return kept


def main_text(root: Element, templates: set[int], hashes: dict[int, tuple[int, bool]]) -> str:
    """The blocks that remain, joined by two line ends."""
    kept: set[int] = set()

    def gone(e: Element, inside: bool) -> bool:
        return is_frame(e, inside) or (id(e) in hashes and hashes[id(e)][0] in templates and id(e) not in kept)

    def mains(e: Element) -> list[Element]:
        found, stack = [], [e]
        while stack:
            x = stack.pop()
            if gone(x, False):
                continue
            if x.tag == "article" or x.attributes.get("role", "").lower() == "article":
                found.append(x)
            else:
                stack += [p for p in reversed(x.parts) if isinstance(p, Element)]
        if not found:
            stack = [e]
            while stack:
                x = stack.pop()
                if gone(x, False):
                    continue
                if is_main(x):
                    found.append(x)
                else:
                    stack += [p for p in reversed(x.parts) if isinstance(p, Element)]
        return found or [e]

    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    tops = mains(root)
    if tops[0] is root and templates:
        kept |= main_part(root)
    for top in tops:
        inside = top is not root
        stack: list = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                line.append(entities.unescape(x))
            elif x is None:
                flush()
            elif x.tag == "br":
                line.append(" ")
            elif x is top or not gone(x, inside):
                if x.tag in BLOCK or x is top:
                    flush()
                    stack.append(None)
                stack += reversed(x.parts)
        flush()
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    """A page's host; pages without one are their own site, the empty one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _count_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host, page, key, inside`` once per page and hash; a null key counts the page itself, ``page`` names its text."""
    for batch in slices(batches, "html"):
        hosts, names, keys, within = [], [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            root = parse(html or "")
            found = set(subtree_hashes(root, host).values())
            name = hashlib.blake2b(main_text(root, set(), {}).encode("utf-8", "surrogatepass"), digest_size=8).digest()
            hosts += [host] * (len(found) + 1)
            names += [int.from_bytes(name, "little", signed=True)] * (len(found) + 1)
            keys += [None, *(k for k, _ in found)]
            within += [False, *(i for _, i in found)]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(names, pa.int64()), pa.array(keys, pa.int64()), pa.array(within, pa.bool_())], ["host", "page", "key", "inside"])


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, keys``: the subtrees that recur on at least ``min_pages`` pages of a host and on a share of them.

    Pages of a host with the same text, such as mirrors and repeated rows, are one page.
    As each is on at least that share of the host's pages, a host has few: some tens times what a page holds.
    """
    seen = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_count_subtrees, "host string, page long, key long, inside boolean").distinct()
    counted = cut(seen.groupBy("host", "key", "inside").agg(F.count(F.lit(1)).alias("n")).where(F.col("key").isNull() | (F.col("n") >= min_pages)))
    size = counted.where("key is null").select("host", F.col("n").alias("pages"))
    share = F.when(F.col("inside"), F.lit(SHARE_INSIDE)).otherwise(F.lit(SHARE_OUTSIDE))
    return (counted.where("key is not null").join(size, "host").where(F.col("n") >= share * F.col("pages"))
            .groupBy("host").agg(F.collect_list("key").alias("keys")))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page.

    ``pages`` needs ``page_id, url, html``; other columns are ignored. A null or empty html, and a page with no main
    text, gives an empty text. Pages with a null or malformed url are one site without a name. Repeated rows each
    give a row, and count once towards what recurs. An empty table gives an empty result.
    """
    site = cut(site_templates(pages, min_pages))  # stored, so its size is known to the join
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html").join(site, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts, known = [], {}
            for host, html, keys in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("keys"), strict=True):
                if host not in known:
                    known = {host: set(keys.as_py() or ())} if len(known) > 256 else known | {host: set(keys.as_py() or ())}
                root = parse(html or "")
                texts.append(main_text(root, known[host], subtree_hashes(root, host) if known[host] else {}))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
