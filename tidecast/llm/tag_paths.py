"""Main text of web pages by tag-path ratios.

A page is read once, in linear time and forgivingly (unclosed paragraphs, stray end tags, cut pages,
scripts that hold markup). Text gathers in blocks; a block's path is the list of structural tags from
the root to it, each with its class and id, inline markup left out. Then, per page:

1. Blocks inside elements that are never part of an article (navigation, footer, aside, script ...,
   a header outside of articles, or hidden) go.
2. Text characters, punctuation marks, link characters and blocks are summed per path.
3. Characters per block and marks per block are smoothed over neighbouring paths of the same parent
   (1, 2, 1), which lifts headings and short paragraphs to their surroundings, and fused to
   ``text * (1 + marks) * (1 - link share)``. Paths inside an article or main element weigh
   ``ARTICLE_WEIGHT`` times that; each element of a path that is a form, or whose class, id or role
   names nothing but page furniture (``NOISE`` words, alone or with ``PLAIN`` ones: "comment-list",
   "related-posts", but neither "related-work" nor "has-sidebar"), takes it times ``NAME_WEIGHT``.
   A name is a weight and nothing more: where all the text has such names, the best of it stays.
4. The best path leads. In an article, that article element is content (the innermost one around
   most of the path's text); what lies in it below another article or a furniture name, and what
   lies in other articles, is content only if its fused value reaches ``LEAST_SHARE`` of the best.
   Without an article, content is what has the same parent and as few such names and does not
   consist of links, and paths that reach that share.

Content blocks come in page order, joined by a line end; character references are decoded, white
space becomes one blank. A null or empty page, or one without text, gives the empty text. Repeated
pages are read one by one. Extra columns are ignored; null ids and urls pass through.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.words import whole

LEAST_SHARE, ARTICLE_WEIGHT, NAME_WEIGHT, MOST_LINKS = 0.5, 8.0, 0.001, 0.8
#: A tag with its attributes; quoted values may hold ">".
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?>[^>"']|"[^"]*"|'[^']*')*+)>""")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: Elements by their part in a page.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math select".split())
INLINE = frozenset(
    "b i em strong span font u s small big sup sub code abbr acronym cite q mark time label img br wbr tt kbd samp var ins del bdi bdo ruby rt rp data"
    " input embed param source track meta link base area col".split()
)
VOID = frozenset("img br wbr input embed param source track meta link base area col hr".split())
NEVER = frozenset("nav footer aside button dialog menu fieldset head".split()) | RAW
ARTICLE = frozenset(["article", "main"])
CLOSES = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "option": ["option"]}
SCOPES = frozenset(["article", "main", "section", "div", "table", "body"])
#: Words for parts of a page beside its article, and words that name a part without saying of what.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox banner sponsor sponsored sponsors promo promos promotion promotions comment comments"
    " commentlist disqus reply replies sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices"
    " alert alerts popup modal overlay subscribe newsletter share sharing social related recommend recommended recommendations toolbar pagination pager login"
    " signup search contentinfo complementary dialog skip".split()
)
#: These name a part of many articles too; on a section they say nothing.
UNSURE = frozenset("discussion discussions response responses".split())
OUTSIDE = frozenset("header masthead".split())
PLAIN = frozenset(
    "area bar block body box button buttons container content count entry feed field footer form group head header heading holder icons inner item items left"
    " link links list main meta module outer panel policy post posts right row section site text thread title top bottom wrap wrapper js page".split()
)
WORDS = re.compile(r"[a-z]+", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
MARK = re.compile(r"[.,;:!?…。，、؟।]")


class Node(NamedTuple):
    """An open element; ``path`` numbers the labels from the root to it."""

    tag: str
    path: int
    noise: bool
    names: int  # elements around and including it with furniture names
    article: int  # innermost article element, 0 for none
    names_in: int  # those with furniture names below that article
    ends: int  # which of the tags that others end are open within the section, one bit each


class Block(NamedTuple):
    node: Node
    text: str
    links: int


ROOT = Node("", 0, False, 0, 0, 0, 0)
_BIT = {t: 1 << k for k, t in enumerate("p li dt dd tr td th option".split())}


class Page(NamedTuple):
    blocks: list[Block]
    parents: list[int]  # of each path


def _ends(page: str, at: int) -> tuple[list[int], list[int]]:
    """Places of quotes and ">" from ``at`` on, and where a tag that goes on at each of them ends
    (-1: nowhere), quoted values being passed over."""
    marks = [m.start() for m in re.compile("[>\"']").finditer(page, at)]
    ends, after = [-1] * (len(marks) + 1), {'"': -1, "'": -1}
    for k in range(len(marks) - 1, -1, -1):
        c = page[marks[k]]
        if c == ">":
            ends[k] = marks[k]
        else:
            ends[k] = ends[after[c] + 1] if after[c] >= 0 else -1
            after[c] = k
    return marks, ends


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, tag, attributes) of tags, in one pass; comments and declarations have no tag.

    A caller that passes over text sends the place to go on at.
    """
    last, at, slow = page.rfind(">"), page.find("<"), None
    while at >= 0:
        found, after = None, page[at + 1 : at + 3]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            found = (at, end + 3 if end >= 0 else len(page), False, "", "")
        elif at > last:  # no tag can end any more
            at = page.find("<!--", at)
            continue
        elif after[:1] in ("!", "?"):
            found = (at, page.find(">", at) + 1, False, "", "")
        elif after[:1].isalpha() and after[:1].isascii() or after[:1] == "/" and after[1:].isalpha() and after[1:].isascii():
            m = TAG.match(page, at) if slow is None else None
            if m:
                found = (at, m.end(), bool(m[1]), m[2].lower(), m[3])
            else:  # quotes that stay open: from now on the ends of tags are looked up
                slow = slow or _ends(page, at)
                name = NAME.match(page, at)
                end = slow[1][bisect_left(slow[0], name.end())]
                end = end if end >= 0 else page.find(">", name.end())
                found = (at, end + 1, bool(name[1]), name[2].lower(), page[name.end() : end])
        if found is None:
            at = page.find("<", at + 1)
            continue
        sent = yield found
        at = page.find("<", max(found[1], sent or 0))


def _furniture(tag: str, label: str, in_article: bool) -> bool:
    """Whether the element is a form or one of its names says nothing but furniture."""
    if tag == "form":
        return True
    if not label or tag in ("body", "html"):
        return False
    words = NOISE if tag == "section" else NOISE | UNSURE
    words = words if in_article else words | OUTSIDE
    for name in label.split():
        parts = [w.lower() for w in WORDS.findall(CAMEL.sub(" ", name))]
        if parts and any(w in words for w in parts) and all(w in words or w in PLAIN for w in parts):
            return True
    return False


def read(page: str, judge: bool = True) -> Page:
    """All blocks of a page, those of furniture too. Without ``judge`` attributes are not looked at:
    the text is the same but for hidden pieces within a line, which stay."""
    stack = [ROOT]
    blocks: list[Block] = []
    parents, numbers = [0], {}
    parts: list[str] = []
    links = anchors = at = 0
    mute: list = []  # tag and depth of a hidden inline element

    def flush():
        nonlocal links
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append(Block(stack[-1], text, links))
            parts.clear()
        links = 0

    open_tags: dict[str, int] = defaultdict(int)

    def pop(names):
        """Closes the innermost of these elements, which is open, and all inside it."""
        while True:
            node = stack.pop()
            open_tags[node.tag] -= 1
            if node.tag in names:
                return

    reader, place = tags(page), None
    while True:
        try:
            start, end, closing, tag, rest = reader.send(place)
        except StopIteration:
            break
        place = None
        if not mute:
            if start > at:
                parts.append(page[at:start])
                links += start - at if anchors else 0
        at = end
        if not tag:
            continue
        if mute and (tag in INLINE or tag == "a"):
            mute[1] += (-1 if closing else 1) if tag == mute[0] else 0
            if not mute[1]:
                mute = []
        elif tag in ("br", "wbr"):
            parts.append(" ")
        elif tag in INLINE or tag == "a":
            if tag == "a":
                anchors = 0 if closing else 1
            low = rest.lower() if rest and judge and not closing and tag not in VOID else ""
            if ("hid" in low or "none" in low) and _hidden(_names(rest)):
                mute = [tag, 1]
        else:
            flush()
            anchors, mute = 0, []
            if closing:
                if open_tags[tag]:
                    pop([tag])
            elif tag in RAW:
                m = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = place = m.end() if m else len(page)
            else:
                if stack[-1].ends:
                    closes = CLOSES.get(tag, ["p"])
                    if stack[-1].ends & sum(_BIT[t] for t in closes):
                        pop(closes)
                top = stack[-1]
                names = _names(rest) if rest and judge else {}
                label = " ".join(names.get(k, "") for k in ("class", "id", "role")).strip() if names else ""
                article = end if tag in ARTICLE else top.article
                named = judge and _furniture(tag, label, bool(article))
                key = (top.path, tag, label)
                if key not in numbers:
                    numbers[key] = len(parents)
                    parents.append(top.path)
                noise = top.noise or tag in NEVER or tag == "header" and not article or bool(names) and _hidden(names)
                below = 0 if tag in ARTICLE else top.names_in + named
                if not rest.endswith("/") and tag not in VOID:
                    ends = 0 if tag in SCOPES else top.ends | _BIT.get(tag, 0)
                    stack.append(Node(tag, numbers[key], noise, top.names + named, article, below, ends))
                    open_tags[tag] += 1
    if not mute:
        parts.append(page[at:])
    flush()
    return Page(blocks, parents)


def _names(rest: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)}


def _hidden(names: dict[str, str]) -> bool:
    return "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "").lower()


def content(page: str) -> str:
    """The main text of a page."""
    found = read(page)
    blocks = [b for b in found.blocks if not b.node.noise]
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])  # characters, marks, links, blocks
    of: dict[int, Node] = {}
    for b in blocks:
        of_path, n = sums[b.node.path], len(b.text)
        of_path[0] += n
        of_path[1] += len(MARK.findall(b.text))
        of_path[2] += min(b.links, n)
        of_path[3] += 1
        of[b.node.path] = b.node
    if not sums:
        return ""
    ratios = {p: (c / n, m / n) for p, (c, m, _, n) in sums.items()}
    families: dict[int, list[int]] = defaultdict(list)
    for p in sums:
        families[found.parents[p]].append(p)
    fused = {}
    for family in families.values():
        for k, p in enumerate(family):
            text, marks = ratios[p]
            if len(family) > 1:
                near = [ratios[family[j]] for j in (k - 1, k, k, k + 1) if 0 <= j < len(family)]
                text, marks = (sum(x) / len(near) for x in zip(*near, strict=True))
            weight = (ARTICLE_WEIGHT if of[p].article else 1) * NAME_WEIGHT ** min(of[p].names, 20)
            fused[p] = text * (1 + marks) * (1 - sums[p][2] / sums[p][0]) * weight
    best = max(fused, key=lambda p: fused[p])
    linked = {p for p in sums if sums[p][2] > MOST_LINKS * sums[p][0]}
    carried = {p for p in sums if p not in linked and fused[p] >= LEAST_SHARE * fused[best] > 0}
    if not of[best].article:
        if not fused[best]:
            return ""
        family = {p for p in families[found.parents[best]] if p not in linked and of[p].names <= of[best].names}
        return "\n".join(b.text for b in blocks if b.node.path in family or b.node.path in carried)
    # the article element that holds most of the best path's text
    text_in: dict[int, int] = defaultdict(int)
    for b in blocks:
        if b.node.path == best:
            text_in[b.node.article] += len(b.text)
    main = max(text_in, key=lambda a: text_in[a])
    level = min(b.node.names_in for b in blocks if b.node.path == best)
    carried = {p for p in carried if of[p].article}
    keep = (b.node.article == main and b.node.names_in <= level or b.node.path in carried for b in blocks)
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = pa.array([content(x) for x in part[2].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part[0], part[1], texts], names=[key, url, "text"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    cols = pages.select(key, url, whole(page).alias("html"))
    return cols.mapInArrow(work, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string")


def query(pages: DataFrame) -> DataFrame:
    """op2: main text of each page."""
    return extract(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
