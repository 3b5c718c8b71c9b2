"""Main-text extraction by line-block distribution.

Markup is stripped to lines, one per block element. Elements that are never article text (scripts, menus, forms and
the like, by tag, role or class) leave a gap of empty lines, and so do lists of links. Each line weighs its characters
outside links, and the weights are summed over sliding windows of WINDOW lines. Where the sums rise over SURGE text
begins, where they fall to zero it ends; the lines between are kept, however short. If the page marks its article
(article, main, or a telling class) and the heaviest stretch lies inside that mark, lines inside weigh MARKED times as
much and lines outside so much less; a mark that does not hold the heaviest stretch gives way to the next weaker one,
and to none in the end.

Tags and class names are hints, and a hint gives way to the text: an element is not left out if it holds the page's
article or main element; if it holds the top heading and half of all text, or running text if it is a form; if it was
never closed and holds a quarter of all text; if a part of a longer class name alone speaks against it (social-issues)
and it holds half of all text outside links, unless that name is one of readers' comments; or if, being a form or told
by its class alone, it holds the most text of those left out, and what remains has neither weight nor a mark. What marks
an article is left out by whole class names only. A numbered list of links between paragraphs of its own section is
part of the text. A section that begins with a heading such as "3 Comments" is readers' comments, and a line that only says "Share
this" or the like is no text, whatever their classes.

Pages are read in time proportional to their length, whatever their markup: a search for the end of a comment, of a tag
or of a raw element that finds none is not made again.

Defined results: null or empty html gives an empty text; very long pages are used whole; pages of which no window
reaches SURGE keep their heaviest stretch; a short stretch in the same section as a kept one stays with it; unclosed
and stray tags end with the element around them; a comment, tag or raw element without an end is dropped up to its next
character; rows are independent, so repeated rows and repeated or null ids each give a row; an empty table gives an
empty result; other columns may have any names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3
SURGE = 80  # characters in a window that mark the start of running text
MARKED = 4  # times the weight of lines that the page marks as its article, and one part in so many of the others

LINKS = 3  # list items in a row that are links and nothing else make a menu

# What HTML calls its elements, and words that sites give as class or id.
RAW = frozenset("script style noscript template textarea svg iframe object canvas title math audio video".split())
NEVER = frozenset("nav header footer aside form button fieldset dialog menu label input select option optgroup datalist head".split())
WRAPPERS = frozenset({"form"})  # of those, what can be around a whole page
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset(
    "ad ads adv alert announcement advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies disclaimer disqus footer "
    "gdpr header masthead menu modal nav navbar navigation newsletter notice notification overlay pagination pager paywall popup popover promo promoted promotion rail recommended related reply replies search login signin poll copyright "
    "respond share sharing sidebar signup skip social sponsor sponsored sponsorship subscribe subscription tagcloud tags toolbar topbar widget widgets".split()
)
SECTIONS = frozenset("div section article main table center td form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Of an element that marks an article, only these words say that it is not the page's article.
NOT_THE_ARTICLE = frozenset("ad ads advert advertisement comment comments commentlist promo related reply replies sponsored teaser".split())
TELLING = frozenset(
    "article articlebody article-body article-content article-text body-text content entry entry-content main-content maincontent page-content post post-body post-content story story-body story-content".split()
)
#: Readers' comments, also as the first part of a longer name; not so before these endings, which say what a page allows.
COMMENTARY = frozenset("comment comments commentlist disqus replies reply respond".split())
STATE_ENDS = frozenset("open closed enabled disabled on off allowed count link".split())
_COMMENTS = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|replies|responses|commentaires?|kommentare?|comentarios?)(?: ?\(\d+\))?:?|leave a (?:reply|comment)|(?:join|add to) the (?:conversation|discussion)", re.I)
#: Lines that are about the page.
SAID = frozenset("share this|share this article|share this page|share this post|share this story|advertisement|skip to content|skip to main content|back to top".split("|"))
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
#: Inside a marked article these words say what a part of it is.
PARTS = frozenset({"header"})
IN_ARTICLES = BOILERPLATE - PARTS
#: Class names that begin so describe a layout, not what is in the element.
STATES = ("has-", "with-", "no-", "without-", "is-", "js-")

_NAME = re.compile(r"(/?)([a-zA-Z][\w:-]*)")
_QUOTED = re.compile(r"""(?:[^<>"']+|"[^"]*"|'[^']*')*+""")
_ATTRIBUTE = re.compile(r"""(?<![\w:-])([\w:-]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[\s_-]+")
_NO_WORDS: frozenset[str] = frozenset()


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes): kind text, open or close; comments, declarations and raw elements are left out."""
    at, n = 0, len(page)
    nowhere: set[str] = set()  # what is not found from here on
    plain_until = 0  # up to here, a tag's quotes have led to no end

    def find(what: str, start: int) -> int:
        if what in nowhere:
            return -1
        found = page.find(what, start)
        if found < 0:
            nowhere.add(what)
        return found

    def raw_end(tag: str, start: int) -> int:
        if tag in nowhere:
            return -1
        found = re.compile(rf"</{tag}\s*>", re.I).search(page, start)
        if not found:
            nowhere.add(tag)
        return found.end() if found else -1

    text_from = 0
    while (at := page.find("<", at)) >= 0:
        end, token = -1, None
        if page.startswith("<!--", at):
            end = find("-->", at + 4) + 3
            end = end if end > 2 else -1
        elif at + 1 < n and page[at + 1] in "!?":
            end = find(">", at + 2) + 1 or -1
        elif name := _NAME.match(page, at + 1):
            if page.startswith(">", name.end()):
                end = name.end() + 1
            elif at >= plain_until:
                stop = _QUOTED.match(page, name.end()).end()
                if stop < n and page[stop] == ">":
                    end = stop + 1
                else:
                    plain_until = stop
            if end < 0:
                end = find(">", name.end()) + 1 or -1
            tag = name[2].lower()
            token = ("close" if name[1] else "open", tag, page[name.end() : end - 1] if end > 0 else "")
            if end > 0 and tag in RAW:
                token = None
                if not name[1] and (closed := raw_end(tag, end)) > 0:
                    end = closed
        if end < 0:
            at += 1
            continue
        if at > text_from:
            yield "text", page[text_from:at], ""
        if token:
            yield token
        at = text_from = end
    if text_from < n:
        yield "text", page[text_from:], ""


def _traits(tag: str, attributes: str) -> tuple[bool, frozenset[str], frozenset[str], int]:
    """(never article text, words of class and id, those that are whole names or begin one of comments, how surely it
    marks the article: 3 article, 2 main, 1 a telling class, 0)."""
    never, mark = tag in NEVER, 3 if tag == "article" else 2 if tag == "main" else 0
    if not attributes or attributes.isspace():
        return never, _NO_WORDS, _NO_WORDS, mark
    words: set[str] = set()
    whole: set[str] = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            never = True
        elif name == "role":
            never |= value in ROLES
            mark = max(mark, 2 if value == "main" else 3 if value == "article" else 0)
        elif name == "itemprop":
            mark = max(mark, 3 if value == "articlebody" else 0)
        elif name in ("class", "id") and tag not in ("body", "html"):
            names = [n for n in value.split() if not n.startswith(STATES)]
            for n in names:
                parts = _WORDS.split(n)
                words.update(parts)
                if len(parts) == 1 or (parts[0] in COMMENTARY and parts[-1] not in STATE_ENDS):
                    whole.add(parts[0])
            mark = max(mark, 0 if TELLING.isdisjoint(names) else 1)
    return never, frozenset(words), frozenset(whole), mark


class Element:
    """An open block element; elements are numbered in page order, so those inside one follow it."""

    __slots__ = ("closed", "last", "lines", "mark", "never", "parent", "section", "start", "tag", "whole", "words")

    def __init__(self, tag: str, never: bool, words: frozenset[str], whole: frozenset[str], mark: int, parent: int, start: int):
        self.tag, self.never, self.words, self.whole, self.mark, self.parent, self.start = tag, never, words, whole, mark, parent, start
        self.closed, self.last, self.lines, self.section = False, -1, (start, start), 0


def parse(page: str) -> tuple[list[tuple[str, int, int]], list[Element]]:
    """Lines (text, characters outside links, element) in page order and all block elements; element 0 is the page."""
    lines: list[tuple[str, int, int]] = []
    elements = [Element("", False, frozenset(), frozenset(), 0, -1, 0)]
    stack, open_ = [0], Counter()
    text: list[str] = []
    linked, in_link = 0, False

    def end_line() -> None:
        nonlocal linked
        if text:
            words = "".join(text)
            words = " ".join((html.unescape(words) if "&" in words else words).split())
            if words:
                lines.append((words, max(0, len(words) - linked), stack[-1]))
            text.clear()
        linked = 0

    def close(upto: int) -> None:
        for k in stack[upto:]:
            elements[k].last, elements[k].lines = len(elements) - 1, (elements[k].start, len(lines))
            open_[elements[k].tag] -= 1
        del stack[upto:]

    for kind, value, attributes in tokens(page):
        if kind == "text":
            text.append(value)
            if in_link:
                linked += len(value)
        elif value in INLINE or value == "br":
            if value == "a":
                in_link = kind == "open"
            if value in ("br", "img"):
                text.append(" ")
        else:
            end_line()
            in_link = False
            if kind == "close":
                if open_[value]:
                    at = next(k for k in range(len(stack) - 1, -1, -1) if elements[stack[k]].tag == value)
                    elements[stack[at]].closed = True
                    close(at)
            elif value not in VOID and not attributes.rstrip().endswith("/"):
                if value == "p" and elements[stack[-1]].tag == "p":
                    elements[stack[-1]].closed = True
                    close(len(stack) - 1)
                elements.append(Element(value, *_traits(value, attributes), stack[-1], len(lines)))
                stack.append(len(elements) - 1)
                open_[value] += 1
    end_line()
    close(0)
    return lines, elements


def _left_out(lines: list[tuple[str, int, int]], elements: list[Element]) -> list[bool]:
    """Whether each element, or one around it, is left out; sets the elements' marks and sections to those in force."""
    upto = list(accumulate((len(t) for t, *_ in lines), initial=0))
    held = [upto[e.lines[1]] - upto[e.lines[0]] for e in elements]

    def inside(flags: list[bool]) -> list[int]:
        before = list(accumulate(flags, initial=0))
        return [before[e.last + 1] - before[k + 1] for k, e in enumerate(elements)]

    articles = inside([e.tag in ("article", "main") and e.words.isdisjoint(NOT_THE_ARTICLE) for e in elements])
    tops = inside([e.tag == "h1" for e in elements])
    weighed = list(accumulate((w for _, w, _ in lines), initial=0))
    marks, hints = [0] * len(elements), [False] * len(elements)
    for k, e in enumerate(elements):
        around = marks[e.parent] if k else 0
        marks[k] = max(around, e.mark)
        if not e.never and not e.words:
            continue
        words = NOT_THE_ARTICLE if e.mark else IN_ARTICLES if around else BOILERPLATE
        sure = (e.never and not (e.tag == "header" and around >= 2)) or not words.isdisjoint(e.whole)
        by_part = not e.mark and not words.isdisjoint(e.words)
        if by_part and not sure:
            mine = weighed[e.lines[1]] - weighed[e.lines[0]]
            by_part = mine < SURGE or 2 * mine < weighed[-1]
        hints[k] = sure or by_part
    most = held[0]

    def gives_way(k: int, e: Element) -> bool:
        headed = tops[k] and (2 * held[k] >= most or (e.tag in WRAPPERS and held[k] >= SURGE))
        return bool(articles[k] or headed or (not e.closed and 4 * held[k] >= most))

    hints = [h and not gives_way(k, e) for k, (h, e) in enumerate(zip(hints, elements))]
    for text, _, k in lines:
        e = elements[k]
        if e.tag in HEADINGS and _COMMENTS.fullmatch(text) and elements[e.parent].tag in ("div", "section") and elements[e.parent].start == e.start and not articles[e.parent]:
            hints[e.parent] = True

    def spread(flags: list[bool]) -> list[bool]:
        out = list(flags)
        for k, e in enumerate(elements[1:], 1):
            out[k] |= out[e.parent]
        return out

    gone = spread(hints)
    weights = [0 if gone[k] else w for _, w, k in lines]
    marked = any(marks[k] and not gone[k] for *_, k in lines)
    if not marked and max((sum(weights[k : k + WINDOW]) for k in range(len(weights))), default=0) < SURGE:
        around = [k for k, (h, e) in enumerate(zip(hints, elements)) if h and not gone[e.parent] and e.tag not in NEVER - WRAPPERS]
        if around:
            top = max(around, key=held.__getitem__)
            within = range(top, elements[top].last + 1)
            gone = spread([h and not (k in within and 2 * held[k] >= held[top] and e.tag not in NEVER - WRAPPERS) for k, (h, e) in enumerate(zip(hints, elements))])
    for k, e in enumerate(elements):
        around = elements[e.parent] if k else None
        e.section = k if e.tag in SECTIONS else around.section if around else 0
        e.mark = marks[k]
    return gone


def lines_of(page: str) -> list[tuple[str, int, int, int]]:
    """(text, characters outside links, mark, section) per block in page order; boilerplate leaves empty lines.

    section numbers the innermost element around the block that groups blocks, with 0 for the page itself.
    """
    lines, elements = parse(page)
    gone = _left_out(lines, elements)
    gap = [("", 0, 0, 0)] * WINDOW
    # A gap is where elements that are left out begin and end, also if they are empty.
    cuts = {at for k, e in enumerate(elements) if k and gone[k] and not gone[e.parent] for at in e.lines}
    out: list[tuple[str, int, int, int]] = []
    links: list[tuple[str, int, int, int]] = []
    ordered = False

    def end_links(following: int | None) -> None:
        """following: the section of the paragraph behind them, if there is one."""
        if len(links) >= LINKS and ordered and following and out and out[-1][1] and out[-1][3] == following:
            out.extend((t, max(w, 1), m, s) for t, w, m, s in links)
        else:
            out.extend(gap if len(links) >= LINKS else links)
        links.clear()

    for n, (text, weight, k) in enumerate(lines):
        e = elements[k]
        if len(text) <= 20 and text.lower() in SAID:
            text, weight = "", 0
        row = (text, weight, e.mark, e.section)
        at = e if e.tag == "li" else elements[e.parent] if e.parent > 0 else e
        item = not weight and at.tag == "li"
        if n in cuts or not item:
            end_links(e.section if weight and n not in cuts and not gone[k] else None)
        if n in cuts:
            out.extend(gap)
        if not gone[k]:
            (links if item else out).append(row)
            ordered = item and elements[at.parent].tag == "ol"
    end_links(None)
    return out


def stretches(weights: list[int]) -> list[tuple[int, int, int]]:
    """(first line, line after the last, highest window sum) between surge and dive points of the window sums."""
    n = len(weights)
    upto = list(accumulate(weights, initial=0))
    sums = [upto[min(k + WINDOW, n)] - upto[k] for k in range(n)]
    found, start = [], None
    for k in range(n + 1):
        alive = k < n and sums[k] > 0
        if alive and start is None and weights[k] > 0:
            start = k
        elif not alive and start is not None:
            found.append((start, k, max(sums[start:k])))
            start = None
    return found


def _heaviest(weights: list[int]) -> int:
    return max((sum(weights[lo:hi]) for lo, hi, _ in stretches(weights)), default=0)


def _sides(lines: list[tuple[str, int, int, int]]) -> list[tuple[list[int], list[bool]]]:
    """The weights and the members of the lines inside the mark and of those outside it; members have text."""
    for least in sorted({m for t, _, m, _ in lines if t and m}, reverse=True):
        inside = [bool(t) and m >= least for t, _, m, _ in lines]
        outside = [bool(t) and m < least for t, _, m, _ in lines]
        marked = [max(w, 1) if i else 0 for i, (_, w, _, _) in zip(inside, lines)]
        rest = [w if o else 0 for o, (_, w, _, _) in zip(outside, lines)]
        if _heaviest(marked) >= _heaviest(rest):
            return [([w * MARKED for w in marked], inside), ([w // MARKED for w in rest], outside)]
    return [([w if t else 0 for t, w, _, _ in lines], [bool(t) for t, *_ in lines])]


def extract(page: str | None) -> str:
    lines = lines_of(page or "")
    found = [(stretches(weights), members) for weights, members in _sides(lines)]
    top = max((peak for some, _ in found for *_, peak in some), default=0)
    kept: list[int] = []
    for some, members in found:
        own = [([k for k in range(lo, hi) if members[k]], peak >= min(SURGE, top)) for lo, hi, peak in some]
        sections = {lines[k][3] for ks, sure in own if sure for k in ks} - {0}
        kept += [k for ks, sure in own if sure or any(lines[k][3] in sections for k in ks) for k in ks]
    return " ".join(lines[k][0] for k in sorted(kept))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: the id, the url, text and n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})
