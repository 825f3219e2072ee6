"""Main text of HTML pages by tree scoring.

A page becomes a tree of its elements. Paragraphs give points for their length and commas to their ancestors, fewer to
farther ones; an element's points are discounted by the share of its text that is links. The element with the most
points is found, and the whole article or main element around it is kept; beside it, siblings with points and few
links, and the headings over them. Menus, headers, footers, notices, forms, comments and the
like never give or hold text; they are known by their tag, role, class or id, if every word of it says so. Unmistakable
words (ad, comments, cookie) drop a container beside any other word, unless it seems to hold the article. Words that may
as well name a part of an article (legal, print, share) never drop a paragraph, and drop a container only if it is short
or consists of links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, batches

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attributes2>[^>]*+)(?:>|\Z)",
    re.S,
)
#: The same for the rest of a page in which UNQUOTED tags had a quote that nothing closes: it is looked for in vain each time.
_LOOSE = re.compile(_MARKUP.pattern.replace(r"""(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>""", r"""[^>]*+)>"""), re.S)
UNQUOTED = 16
_NAME = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_STYLE = re.compile(r"""display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
#: Elements that never hold main text.
_OUT = _RAW | frozenset("head nav footer aside form button select option svg canvas object dialog menu video audio map".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_PARAGRAPH = frozenset("p pre td blockquote dd li figcaption".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark what isn't the article.
_BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners billboard breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices outbrain pagination paywall popup promo promoted promos promotion "
    "reply replies respond shoutbox sidebar sidebars signup skyscraper sponsor sponsored sponsors subscribe subscription taboola complementary contentinfo".split()
)
#: Words that mark it unless what they mark is a paragraph or has text of its own.
_WEAK = frozenset(
    "alert cc comms dialog disclaimer download form header hidden legal login meta notification overlay pager print privacy recommend recommended related search share sharing shares "
    "skip social tabs tags teaser toolbar tooltip topbar trending widget widgets".split()
)
#: Words that mark a container whatever other word stands beside them, unless it seems to hold the article.
_SURE = frozenset(
    "ad ads adsense adv advert advertisement advertising adverts comment commentlist comments cookie cookies discussion disqus gdpr outbrain promo promoted promos replies responses reviews sponsor sponsored "
    "sponsors taboola".split()
)
_PROSE = frozenset("discussion responses reviews".split())  # may be the name of an article's section
#: Words that say nothing beside such words.
_PLAIN = frozenset("a area bar block body bottom box button buttons container content fixed global group holder inner item items js left link links list main mobile module my outer page panel right row section site sticky text the top wrap wrapper".split())
_GOOD = frozenset("article articlebody body content entry main post story text hentry page column".split())
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


_LISTS = frozenset("ul ol table dl select body".split())
_BLOCKS = frozenset("div article section td body li main table".split())
_SECTIONS = frozenset("article main section".split())


class _Tree:
    """Elements in page order, a parent before its children; runs of text with the element that holds each.

    The elements that are open are counted by tag, in all and since the last block or list, so that no tag walks up to
    look for what isn't there.
    """

    def __init__(self) -> None:
        self.parent, self.tag, self.out, self.weak, self.good, self.doubtful = [-1], ["#root"], [False], [False], [False], [False]
        self.block, self.list, self.sections, self.opened = [0], [0], [0], {}
        self.texts: list[tuple[int, str]] = []  # an empty text marks the border of a block

    def open(self, parent: int, tag: str, attributes: str) -> int:
        out, weak, good, doubtful = self.out[parent] or tag in _OUT, False, tag in ("article", "main"), False
        if attributes and not out:
            for m in _NAME.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    out = True
                    continue
                for token in value.split():
                    words = {w.lower() for w in _SPLIT.split(token)} - {""}
                    good = good or bool(words & _GOOD)
                    sure = words & _SURE - (_PROSE if tag in ("section", "article") else frozenset())
                    doubtful = doubtful or bool(sure) and tag not in _PARAGRAPH | _HEADING | _INLINE and tag not in ("body", "html", "main")
                    if tag in ("body", "html", "article", "main") or not words & (_BAD | _WEAK) or words - _BAD - _WEAK - _PLAIN:
                        continue
                    if words & _BAD:
                        out = True
                    else:
                        weak = weak or tag not in _PARAGRAPH and tag not in _HEADING
            out = out or "style" in attributes and bool(_STYLE.search(attributes))
        if tag == "header" and not self.sections[parent]:
            out = True
        node = len(self.parent)
        self.parent.append(parent)
        self.tag.append(tag)
        self.out.append(out)
        self.weak.append(weak)
        self.good.append(good)
        self.doubtful.append(doubtful)
        self.block.append(node if tag in _BLOCKS else self.block[parent])
        self.list.append(node if tag in _LISTS else self.list[parent])
        self.sections.append(self.sections[parent] + (tag in _SECTIONS))
        for key in self._counted(node):
            self.opened[key] = self.opened.get(key, 0) + 1
        return node

    def _counted(self, node: int) -> tuple:
        tag, up = self.tag[node], self.parent[node]
        return tag, (self.block[up], tag), (-1 - self.list[up], tag)

    def close(self, now: int, node: int) -> int:
        """Closes node, which is open, and all in it; what is open after that."""
        up = self.parent[node]
        while now != up:
            for key in self._counted(now):
                self.opened[key] -= 1
            now = self.parent[now]
        return up


def parse(html: str) -> _Tree:
    tree, at, now, raw = _Tree(), 0, 0, None
    end_raw, markup, unquoted = None, _MARKUP, 0
    while True:
        if raw:
            m = end_raw.search(html, at)
            at = m.start() if m else len(html)  # what a raw element holds is no text
            raw = None
        m = markup.search(html, at)
        if m is None:
            tree.texts.append((now, html[at:]))
            return tree
        if m.start() > at:
            tree.texts.append((now, html[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            tree.texts.append((now, m["cdata"].replace("&", "&amp;")))
        unquoted += m["tag2"] is not None
        markup = markup if unquoted < UNQUOTED else _LOOSE
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag not in _INLINE:
            tree.texts.append((now, ""))
        if m["close"] or m["close2"]:
            now = _close(tree, now, tag)
            continue
        attributes = m["attributes"] or m["attributes2"] or ""
        if tag in _CLOSES_P and tree.opened.get("p"):
            now = _close(tree, now, "p")
        elif tag in ("li", "tr", "td", "th", "dd", "dt", "option"):
            now = _implied(tree, now, tag)
        if tag in _VOID:
            continue
        now = tree.open(now, tag, attributes)
        if attributes.endswith("/") and tag in ("svg", "path", "use"):
            now = tree.close(now, now)
        elif tag in _RAW:
            raw, end_raw = tag, re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def _close(tree: _Tree, now: int, tag: str) -> int:
    """The element that is open after an end tag; one that matches nothing changes nothing. A paragraph, or inline
    markup, isn't closed from outside the block it stands in."""
    near = tag == "p" or tag in _INLINE
    if not tree.opened.get((tree.block[now], tag) if near else tag):
        return now
    node = now
    while tree.tag[node] != tag:
        node = tree.parent[node]
    return tree.close(now, node)


_ENDS = {"li": ("li",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}


def _implied(tree: _Tree, now: int, tag: str) -> int:
    """Where a list item or cell goes: an open one before it in the same list or table ends."""
    ends = _ENDS[tag]
    if not any(tree.opened.get((-1 - tree.list[now], t)) for t in ends):
        return now
    node = now
    while tree.tag[node] not in ends:
        node = tree.parent[node]
    return tree.close(now, node)


def _whole(tree: _Tree, best: int) -> int:
    """The outermost article around an element, or else the outermost main element, or else the element itself."""
    around = {}
    node = best
    while node > 0:
        around[tree.tag[node]] = node
        node = tree.parent[node]
    return around.get("article") or around.get("main") or best


def _measure(tree: _Tree, texts: list[tuple[int, str]], in_link: list[bool]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of each element: characters, those in links, commas, and characters that stand in it or in its inline markup."""
    n = len(tree.parent)
    chars, links, commas, direct = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in texts:
        if text and not tree.out[node]:
            size = len(text) - text.count(" ") - text.count("\n")
            chars[node] += size
            direct[node] += size
            links[node] += size * in_link[node]
            commas[node] += text.count(",") + text.count("，") + text.count("、")
    for node in range(n - 1, 0, -1):
        up = tree.parent[node]
        chars[up] += chars[node]
        links[up] += links[node]
        commas[up] += commas[node]
        if tree.tag[node] in _INLINE:
            direct[up] += direct[node]
    return chars, links, commas, direct


def _doubtful(tree: _Tree, chars: list[int], links: list[int], direct: list[int]) -> list[bool]:
    """Containers that go: those with an unmistakable word, but for one with the title in it, one that no paragraph of
    some length stands outside of, and one with most of the page's text before all such paragraphs."""
    n = len(tree.parent)
    inside, title = tree.doubtful[:], [False] * n
    for node in range(1, n):
        inside[node] = inside[node] or inside[tree.parent[node]]
    for node in range(n - 1, 0, -1):
        title[tree.parent[node]] = title[tree.parent[node]] or title[node] or tree.tag[node] == "h1" and chars[node] > 0
    reads = [i for i in range(1, n) if not inside[i] and not tree.out[i] and direct[i] >= 80 and links[i] < 0.3 * chars[i] and tree.tag[i] not in _INLINE]
    first = reads[0] if reads else n
    return [tree.doubtful[i] and bool(reads) and not title[i] and (first < i or 2 * chars[i] < chars[0]) for i in range(n)]


_NUMBER = re.compile(r"&#0*(\d+);?")


def _plain(raw: str) -> str:
    """Text with its character references decoded; a number of more digits than any character has is none."""
    if "&" not in raw:
        return raw
    return unescape(_NUMBER.sub(lambda m: f"&#{m[1]};" if len(m[1]) < 8 else "\ufffd", raw) if "&#" in raw else raw)


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in order, white space as one space; empty if there is none."""
    if not html:
        return ""
    tree = parse(html)
    n = len(tree.parent)
    in_link = [False] * n
    for node in range(1, n):
        in_link[node] = tree.tag[node] == "a" or in_link[tree.parent[node]]
    texts = [(node, _plain(raw)) for node, raw in tree.texts]
    chars, links, commas, direct = _measure(tree, texts, in_link)
    if any(tree.doubtful):
        gone = _doubtful(tree, chars, links, direct)
        for node in range(1, n):
            tree.out[node] = tree.out[node] or gone[node] or tree.out[tree.parent[node]]
        chars, links, commas, direct = _measure(tree, texts, in_link)
    if any(tree.weak):
        for node in range(1, n):
            thin = tree.weak[node] and (chars[node] < 80 or links[node] >= 0.3 * chars[node])
            tree.out[node] = tree.out[node] or thin or tree.out[tree.parent[node]]
        chars, links, commas, direct = _measure(tree, texts, in_link)
    if not chars[0]:
        return ""
    points, given, passed = [0.0] * n, [0.0] * n, [0.0] * n
    for node in range(1, n):
        reads = tree.tag[node] in _PARAGRAPH or tree.tag[node] in ("div", "section", "article", "main", "body") and direct[node]
        if not reads or tree.out[node] or not chars[node]:
            continue
        own = chars[node] if tree.tag[node] in _PARAGRAPH else direct[node]
        gives = (1 + commas[node] * own / chars[node] + min(own / 100, 3)) * min(1, own / 25)
        given[node if tree.tag[node] not in _PARAGRAPH else tree.parent[node]] += gives
    for node in range(n - 1, 0, -1):  # the next ancestor gets a half, each further one two thirds of the one below
        points[node] = given[node] + passed[node]
        passed[tree.parent[node]] += given[node] / 2 + passed[node] * 2 / 3
    for node in range(1, n):
        points[node] *= 0.2 if tree.weak[node] else 1
        points[node] = (points[node] + 5 * (tree.tag[node] in ("article", "main") or tree.good[node] and tree.tag[node] != "body") * (points[node] > 0)) * (1 - links[node] / max(chars[node], 1))
    best = max((i for i in range(1, n) if not tree.out[i] and tree.tag[i] not in _INLINE), key=lambda i: (points[i], chars[i] - links[i], -i), default=0)
    if not best or not points[best]:
        best = next((i for i in range(1, n) if tree.tag[i] == "article" and chars[i]), None) or next((i for i in range(1, n) if tree.tag[i] == "body"), 0)
    best = _whole(tree, best)
    keep, goes_on = [False] * n, False
    for node in range(n - 1, 0, -1):
        if node == best:
            keep[node] = goes_on = True
        elif tree.parent[node] == tree.parent[best] and tree.parent[best] > 0 and not tree.out[node]:
            if links[node] >= 0.25 * max(chars[node], 1):
                continue
            if tree.tag[node] in _HEADING:
                keep[node] = goes_on  # one that heads nothing that is kept stands over what isn't the article
            else:
                keep[node] = points[node] > 0 or tree.tag[node] in ("p", "blockquote") and (chars[node] > 80 or commas[node] > 0)
                goes_on = goes_on or keep[node]
    if best == 0:
        keep[0] = True
    for node in range(1, n):
        keep[node] = (keep[node] or keep[tree.parent[node]]) and not tree.out[node]
    return " ".join("".join([text or " " for node, text in texts if keep[node] or not text]).split())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per row of pages: id_col, the columns named in carry, text, n_chars (code points of text).

    A page that is null, empty or has no main text gives an empty text. Very long pages are read whole, in time that grows
    with their length; repeated rows, and ties, have a row each, and null ids and addresses stay null. An empty table gives
    no rows; other columns don't matter.
    """
    slim = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    names = [c for c in slim.columns if c != "_html"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 256):
            texts = [main_text(h) for h in batch.column(batch.schema.get_field_index("_html")).to_pylist()]
            yield append_columns(batch, names, {"text": pa.array(texts, pa.string())})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "_html")
    out = slim.mapInArrow(run, f"{schema}, text string")
    kept = (F.col(f"_c{i}").alias(c) for i, c in enumerate(carry))
    return out.select(F.col("_id").alias(id_col), *kept, "text", F.char_length("text").cast("long").alias("n_chars"))
