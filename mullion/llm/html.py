"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mullion.llm.common import picked, plain

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("""script style textarea title xmp iframe noembed noframes noscript template head svg math canvas object video
    audio select option button fieldset nav footer aside dialog menu""".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2
    h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("body html td th tr tbody thead tfoot li dd dt".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("table ul ol dl div article section main body aside header footer nav form td blockquote".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTAINERS = frozenset("article main section div td body html".split())
LINKED = 0.9  # share of its text in links that makes a list a menu
NAME_FACTOR = 0.5  # what a block's fused ratio is worth under a name that speaks against it
# Words in class, id and role that name what is not the article.
ASIDE_WORDS = frozenset("""ad ads advert advertisement adverts banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus
    footer form gdpr header hidden masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related reply
    replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget""".split())
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")
# Headings that open the comments of readers, without numbers and punctuation, in lower case.
COMMENT_HEADINGS = frozenset("""comments
comment
reader comments
user comments
leave a comment
leave a reply
post a comment
add a comment
join the conversation""".split("\n"))
# Possessive throughout, so that one pass decides: a quote means something after an equals sign only.
ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
TAG = re.compile(rf"</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|{ATTRIBUTE})*+)>")
BARE = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)")
VALUE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
DEEPEST = 512  # elements opened inside one another; deeper ones count as part of the last


class _Element:
    """One element; ``order`` numbers elements as they open, so those inside it are order + 1 to ``last``."""

    __slots__ = ("tag", "path", "parent", "aside", "named", "order", "last", "depth", "hidden", "link", "article", "form", "layout", "items")

    def __init__(self, tag, path, parent, order):
        self.tag, self.path, self.parent, self.order, self.last, self.named, self.layout = tag, path, parent, order, order, 0, False
        self.depth = parent.depth + 1 if parent else 0
        self.aside = bool(parent) and parent.aside or tag in SKIPPED
        self.hidden = bool(parent) and parent.hidden or (tag in SKIPPED and tag not in BLOCKS)
        self.link = bool(parent) and parent.link or tag == "a"
        self.article = bool(parent) and parent.article or tag in ("article", "main")
        self.form = self if tag == "form" else parent and parent.form
        self.items = self if tag in ("ul", "ol", "dl") else parent and parent.items

    def within(self, top) -> bool:
        return top.order <= self.order <= top.last


def _named_aside(tag: str, attributes: str) -> int:
    """How far class, id and role name an aside: 2 if one of their names is a listed word, 1 if one has such a word in it.

    On a paragraph or a heading a listed word counts 1; part of a name on an element within a line counts nothing.
    """
    if "=" not in attributes or tag in ("body", "html", "article", "main"):
        return 0
    level = 0
    for m in VALUE.finditer(attributes):
        if m[1].lower() not in ("class", "id", "role"):
            continue
        for name in (m[2] or m[3] or m[4] or "").split():
            if name.lower() in ASIDE_WORDS:
                level = 2
            elif not ASIDE_WORDS.isdisjoint(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())):
                level = max(level, 1)
    if tag in ("p", *HEADINGS):
        return min(level, 1)
    return level if tag in BLOCKS or level == 2 else 0


def blocks(page: str, deepest: int = DEEPEST) -> list[tuple[_Element, str, float]]:
    """(element, text, share of it in links) of every block of text in page order.

    Text is decoded, with single spaces, never empty. Elements close where HTML says an end tag may be left out; a stray
    end tag is passed over, a tag the page ends in is left out. One pass: no part of the page is scanned again, whatever
    quotes, comments or tags are left open.
    """
    top = _Element("", 0, None, 0)
    here, out, held, owner, count, paths = top, [], [], top, 0, {}
    chars = linked = 0
    beyond = {}  # open elements deeper than ``deepest``, by tag

    def take(text):
        nonlocal owner, chars, linked
        if here.hidden:
            return
        if not held:
            owner = here
        held.append(text)
        n = len(text.strip())
        chars += n
        linked += n * here.link

    def flush():
        nonlocal chars, linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((owner, text, linked / max(chars, 1)))
            held.clear()
        chars = linked = 0

    def leave(e):
        nonlocal here
        while here is not e:
            here.last = max(here.last, count)
            here = here.parent

    pos, size, last, quoted = 0, len(page), page.rfind(">"), True
    while pos < size:
        at = page.find("<", pos)
        if at != pos:
            take(page[pos:at] if at > 0 else page[pos:])
        if at < 0:
            break
        kind = page[at + 1:at + 2]
        if page.startswith("<![CDATA[", at):
            stop = page.find("]]>", at + 9)
            take(entities.escape(page[at + 9:stop] if stop >= 0 else page[at + 9:]))
            pos = stop + 3 if stop >= 0 else size
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 2)
            pos = stop + 3 if stop >= 0 else size
            continue
        name = page[at + 2:at + 3] if kind == "/" else kind
        if not (name.isascii() and name.isalpha()):
            if kind and kind in "!?/" and at < last:
                pos = page.find(">", at) + 1
            elif kind and kind in "!?":
                pos = size
            else:
                take("<")
                pos = at + 1
            continue
        if at > last:
            break
        m = TAG.match(page, at) if quoted else None
        if m:
            pos = m.end()
        else:  # all that is left stands in quotes: from here on they mean nothing
            quoted, pos = False, page.find(">", at) + 1
            m = BARE.match(page, at, pos)
        tag = m[1].lower()
        if kind == "/":
            if tag in BLOCKS and not here.hidden:
                flush()
            if beyond.get(tag):
                beyond[tag] -= 1
                continue
            e = here
            while e is not top and e.tag != tag and not (tag not in BLOCKS and e.tag in SCOPE):
                e = e.parent
            if e is not top and e.tag == tag:
                if e.named or (e.aside != e.parent.aside and not e.hidden):
                    flush()
                leave(e.parent)
                beyond.clear()
            continue
        if tag == "br":
            take(" ")
            continue
        if tag in RAW:
            if not m[2].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
                stop = page.find(">", close.end()) if close else -1
                pos = stop + 1 if stop >= 0 else size
            continue
        shut = SAME_LEVEL.get(tag) or (("p",) if tag in ENDS_PARAGRAPH else ())
        e = here
        while shut and e is not top:
            if e.tag in shut:
                flush()
                leave(e.parent)
                if tag not in ("tr",):
                    break
            elif e.tag in SCOPE and not (tag == "tr" and e.tag == "td"):
                break
            e = e.parent
        if tag in BLOCKS and not here.hidden:
            flush()
        if tag in VOID:
            continue
        if here.depth >= deepest:
            beyond[tag] = beyond.get(tag, 0) + 1
            continue
        count += 1
        new = _Element(tag, paths.setdefault((here.path, tag), len(paths) + 1), here, count)
        new.named = _named_aside(tag, m[2])
        if tag == "header" and not here.article:
            new.aside = True
        if new.named or (new.aside != here.aside and not new.hidden):
            flush()
        if tag in ("h1", "main", "article") and new.form:
            new.form.layout = True
        here = new
    flush()
    leave(top)
    top.last = count
    return out


def _region(content: list[_Element]) -> _Element | None:
    """The smallest container that holds all of ``content``, or the article or main around it; None of no content."""
    if not content:
        return None
    shared, lo, hi = content[0], min(e.order for e in content), max(e.order for e in content)
    while not shared.order <= lo <= hi <= shared.last:
        shared = shared.parent
    held = shared
    while held is not None and held.tag not in ("article", "main"):
        held = held.parent
    while held is None and shared is not None:
        if shared.tag in CONTAINERS or not shared.tag:
            return shared
        shared = shared.parent
    return held


def _spoken_against(found: list[tuple[_Element, str, float]], high: np.ndarray) -> list[int]:
    """Per block, the strongest name around it that counts: 0, 1 or 2 as in ``_named_aside``.

    A name does not count on an element with most of the text of the ``high`` blocks; a whole listed word (2) does, unless
    the element has the page's h1 or main too, or all of that text.
    """
    total = sum(len(t) for (_, t, _), c in zip(found, high) if c)
    around, held, lead, level = {}, {}, set(), {}
    for (e, t, _), c in zip(found, high):
        if c:
            held[e.order] = held.get(e.order, 0) + len(t)
        while e is not None and e.order not in around:
            around[e.order] = e
            e = e.parent
    for order in sorted(around, reverse=True):  # those inside an element have larger numbers
        e = around[order]
        if e.parent is not None:
            held[e.parent.order] = held.get(e.parent.order, 0) + held.get(order, 0)
            if e.tag in ("h1", "main") or order in lead:
                lead.update((order, e.parent.order))
    for order in sorted(around):
        e, mine = around[order], held.get(order, 0)
        counts = e.named and not (2 * mine > total and (e.named == 1 or order in lead or mine == total))
        level[order] = max(level[e.parent.order] if e.parent is not None else 0, e.named if counts else 0)
    return [level[e.order] for e, _, _ in found]


def _without_comments(found: list[tuple[_Element, str, float]]) -> list[tuple[_Element, str, float]]:
    """The blocks before readers' comments: from a heading that opens them, to the end of the element it stands in.

    Where that element ends with the heading, the next one around it counts. All blocks, if only comments would be left out.
    """
    shut, kept = -1, []
    for i, (e, t, share) in enumerate(found):
        if e.order <= shut:
            continue
        words = " ".join(re.sub(r"[^a-z\s]", " ", t.lower()).split()) if len(t) < 64 else ""
        head = e
        while head is not None and head.tag not in HEADINGS[1:] and head.tag not in BLOCKS:
            head = head.parent
        if words in COMMENT_HEADINGS and head is not None and head.tag in HEADINGS[1:] and kept:
            around = head.parent
            while i + 1 < len(found) and not found[i + 1][0].within(around):
                around = around.parent
            shut = around.last
            continue
        kept.append((e, t, share))
    return kept


def _link_lists(found: list[tuple[_Element, str, float]]) -> list[bool]:
    """Per block, whether it is of a list of links alone (two items at least), or the heading of such a list."""
    size, linked, rows = {}, {}, {}
    for e, t, share in found:
        if e.items is not None:
            k = e.items.order
            size[k], linked[k], rows[k] = size.get(k, 0) + len(t), linked.get(k, 0) + share * len(t), rows.get(k, 0) + 1
    out = [e.items is not None and rows[e.items.order] > 1 and linked[e.items.order] >= LINKED * size[e.items.order] for e, _, _ in found]
    return [x or (e.tag in HEADINGS[1:] and i + 1 < len(out) and out[i + 1]) for i, (x, (e, _, _)) in enumerate(zip(out, found))]


def main_text(page: str, sigma: float = 1.0, spread: float = 0.8) -> str:
    """The article of a page, one block per line.

    Every block's root-to-leaf tag path gets two ratios over the page: characters of text per node and punctuation marks
    per node. Each block takes its path's ratios, both are smoothed over the page order with a Gaussian, scaled to their
    largest and fused by their product; blocks above ``spread`` times the standard deviation of the fused ratio are
    content nodes. The article is all content nodes, and of the smallest container that holds every one of them (or the
    article or main element around it) also the other blocks, so that its short headings stay.

    A path's ratio counts for the share of its text that is not in links. Lists of links alone, with their heading, are menus,
    and readers' comments are left out from the heading that opens them.

    Elements of menus, forms and the like are left out by their tag; a form with the h1, main or article in it, or with all
    the text of the page, is only its layout. A class, id or role that names an aside (adverts,
    comments) is ignored on an element with most of the high-ratio text. Elsewhere its blocks are no content nodes; inside
    the container they stay if they are an h1, or if the name is only part of another (or a paragraph's own) and
    ``NAME_FACTOR`` of the ratio is still above the threshold.
    """
    every = [b for b in blocks(page) if not b[0].aside]
    found = _without_comments([b for b in every if b[0].form is None or b[0].form.layout] or every)
    if not found:
        return ""
    chars, marks, nodes, links = {}, {}, {}, {}
    for e, t, share in found:
        links[e.path] = links.get(e.path, 0) + share * len(t)
        chars[e.path] = chars.get(e.path, 0) + len(t)
        marks[e.path] = marks.get(e.path, 0) + len(PUNCTUATION.findall(t))
        nodes[e.path] = nodes.get(e.path, 0) + 1
    length = np.array([(chars[e.path] - links[e.path]) / nodes[e.path] for e, _, _ in found])
    points = np.array([marks[e.path] / nodes[e.path] for e, _, _ in found])
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()

    def smooth(x):
        x = np.convolve(np.pad(x, reach, "edge"), kernel, "valid")
        return x / x.max() if x.max() > 0 else x

    fused = smooth(length) * smooth(points + 1e-3)
    threshold = spread * fused.std()
    level = np.array(_spoken_against(found, fused >= threshold))
    if not (level[fused >= threshold] == 0).any():
        level[level == 1] = 0  # nothing else is left to be the article
    level = np.where(_link_lists(found), 2, level)
    content = (fused >= threshold) & (level == 0)
    region = _region([e for (e, _, _), c in zip(found, content) if c])
    fused = np.where(level > 0, NAME_FACTOR * fused, fused)
    kept = []
    for (e, t, _), r, against, c in zip(found, fused, level, content):
        inside = region is None or e.within(region)
        if c or (inside and (against == 0 or e.tag == "h1" or (against == 1 and r >= threshold))):
            kept.append(t)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; null and empty pages, and pages without an article, give an empty text.

    Each row is read whole and alone: rows that repeat an id are extracted each, nothing is shuffled.
    """
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    rows = picked(pages, page_id=id_col, url=url_col, html=html_col)
    return rows.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), plain(F.col("html")).alias("html")).mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")
