"""Main text of web pages from the distribution of text over lines.

The markup is stripped to one line per block, with a gap of empty lines where a section of the page
begins or ends. Lengths of text outside links are summed over sliding windows of lines; the text of the article
rises in a first surge and falls in a last dive, and everything between the two is kept.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kifuframe.llm.common import with_columns, schema_with

#: Lines per window, and the gap between sections: as wide, so that no window sees two sections.
SPAN = 3
#: A window with so many characters outside links surges; so does one with a sentence, however short.
SURGE = 40
SENTENCE = re.compile("[.!?…。！？।؟:;][\"'”’»)\\]]*$")
LEGAL = re.compile(r"(?i)(?:©|\(c\)|copyright\b|all rights reserved)")

#: A short stretch about cookies that asks for something is a notice, marked or not.
NOTICE_CHARS = 400
COOKIES = re.compile(r"(?i)\bcookies?\b")
ASKED = re.compile(r"(?i)\b(?:accept\w*|consent\w*|agree\w*|we use|policy|settings|preferences|akzeptier\w*|zustimm\w*|acept\w*|utilis\w*)\b")

#: Elements whose content is never text of the page.
HIDDEN = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "select",
          "textarea", "button", "audio", "video")
#: Those of them whose content is no markup: it ends only at their own closing tag.
RAW = {n: re.compile(rf"(?i)</{n}(?=[\s/>])[^>]*>?") for n in ("script", "style", "noscript", "iframe", "textarea")}
#: Elements around the article, and those that belong to no article.
ASIDE = ("nav", "footer", "aside", "form", "dialog", "menu")
#: Parts of a class, id or role that mark menus, notices, adverts and reader comments, wherever they stand in the name.
MARK = re.compile(
    r"ads?|adsbygoogle|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|popup|modal|overlay|"
    r"nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|footer\w*|comment\w*|disqus\w*|reply|replies|respond|responses?|"
    r"share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|login|signup|search\w*|pagination|pager|"
    r"toolbar|widget\w*|complementary|contentinfo|navigation")
#: Marks of a page's header; an article keeps its own.
FRONT = frozenset(("header", "masthead"))
OWN = frozenset("article entry post story content section".split())
#: Names with one of these parts say how a wrapper is laid out, not what it holds.
STATE = frozenset("has have with without no not is free layout enabled disabled open closed".split())
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Elements that begin a line of their own.
BLOCKS = frozenset(
    "address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SECTIONS = frozenset("article aside body div footer form header main nav section table".split())
BODIES = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An article with links and less than a fifth of the heaviest one's text is a teaser.
TEASER = 5

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_INNER = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_OFF = re.compile(r"(?i)(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none")


def marks(value: str) -> tuple[bool, bool]:
    """Whether a class, id or role marks something beside the article, and whether it marks a page's header."""
    away = front = False
    for name in value.split():
        parts = [p.lower() for p in PART.findall(name)]
        if STATE.isdisjoint(parts):
            away |= any(MARK.fullmatch(p) for p in parts) or "side" in parts and "bar" in parts or "sign" in parts and "up" in parts
            front |= not FRONT.isdisjoint(parts) and OWN.isdisjoint(parts)
    return away, front


def balanced(value: str) -> bool:
    """Whether the tags in an attribute's value close each other; what runs from one tag's quote to another's does not."""
    if "<" not in value or ">" not in value:
        return True
    names: list[str] = []
    for closing, name in _INNER.findall(value):
        if closing:
            if not names or names.pop() != name.lower():
                return False
        elif name.lower() not in VOID:
            names.append(name.lower())
    return not names


def tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends the tag whose name ends at ``at``; -1 if none does.

    Quotes count after an equals sign, if they close and hold no halves of elements.
    """
    first = page.find(">", at)
    while first >= 0:
        at = _PLAIN.match(page, at).end()
        if at == len(page):
            break
        if page[at] == ">":
            return at
        if page[max(0, at - 8):at].rstrip().endswith("="):
            end = page.find(page[at], at + 1)
            if end >= 0 and balanced(page[at + 1:end]):
                at = end
        at += 1
    return first


class Line(NamedTuple):
    """Text of one block, the number of the article it stands in (0: none) and of the innermost marked wrapper, its characters
    in links, its heading level, whether it stands in a table.
    """

    text: str
    inside: int = 0
    wrapper: int = 0
    linked: int = 0
    heading: int = 0
    table: bool = False


class Scan:
    """One pass over a page: its blocks in order, with empty lines as gaps; its marked wrappers and its articles.

    ``outer[w]`` is the wrapper around wrapper ``w``, ``around`` the wrappers that contain an article begun in them, ``bodies[b]`` the name
    of article ``b`` and the number of the one around it.
    """

    def __init__(self, page: str):
        self.page, self.lines = page, []
        self.outer: list[int] = [0]
        self.around: set[int] = set()
        self.bodies: list[tuple[str, int]] = [("", 0)]
        self._words: list[str] = []
        self._open: list[tuple[str, bool, int, int]] = []  # sections and dropped elements: name, dropped, wrapper and article before
        self._count: dict[str, int] = defaultdict(int)
        self._dropped = self._wrapper = self._body = self._linked = self._heading = 0
        self._link = False
        self._run()

    def _end_line(self) -> None:
        text = " ".join(entities.unescape("".join(self._words)).split()) if self._words else ""
        self._words.clear()
        if text:
            self.lines.append(Line(text, self._body, self._wrapper, self._linked, self._heading, self._count["table"] > 0))
        self._linked = self._heading = 0

    def _break(self, name: str) -> None:
        self._end_line()
        if name in SECTIONS:
            self.lines.extend([Line("")] * SPAN)

    def _text(self, start: int, end: int) -> None:
        if not self._dropped and start < end:
            self._words.append(self.page[start:end])
            self._linked += len(entities.unescape(self._words[-1]).strip()) if self._link else 0

    def _run(self) -> None:
        page, at, look, skip_to = self.page, 0, 0, ""
        ends: dict[str, int] = {}
        lowered, last = "", page.rfind(">")
        while (begin := page.find("<", look)) >= 0:
            mark = page[begin + 1:begin + 2]
            closing = mark == "/"
            if mark in ("!", "?"):
                if page.startswith("<!--", begin):
                    end = page.find("-->", begin + 4)
                    end = end + 3 if end >= 0 else len(page)
                elif page.startswith("<![CDATA[", begin):
                    end = page.find("]]>", begin)
                    end = end + 3 if end >= 0 else len(page)
                else:
                    end = page.find(">", begin)
                    end = end + 1 if end >= 0 else len(page)
                name, rest = "", ""
            else:
                named = _NAME.match(page, begin + 1 + closing) if begin < last else None
                end = tag_end(page, named.end()) + 1 if named else 0
                if not end:  # no tag: the sign is text
                    look = begin + 1
                    continue
                name, rest = named.group().lower(), page[named.end():end - 1]
            if name in RAW and not closing and (skip_to or not rest.endswith("/")):
                close = RAW[name].search(page, end)
                look = close.end() if close else len(page)
            else:
                look = end
            if skip_to:
                if closing and name == skip_to:
                    skip_to, at = "", look
                continue
            self._text(at, begin)
            at = look
            if name == "a":
                self._link = not closing
            if not name or name in RAW:
                continue
            if closing:
                self._close(name)
                continue
            if name in HIDDEN and name != "head" and name not in VOID and not rest.endswith("/"):
                if name not in ends:
                    lowered = lowered or page.lower()
                    ends[name] = lowered.rfind(f"</{name}")
                if ends[name] > begin:  # one that never ends hides nothing
                    skip_to = name
                continue
            self._enter(name, rest)
        if not skip_to:
            self._text(at, len(page))
        self._end_line()

    def _close(self, name: str) -> None:
        if self._count[name]:
            self._break(name)
            while True:
                n, away, self._wrapper, self._body = self._open.pop()
                self._count[n] -= 1
                self._dropped -= away
                if n == name:
                    return
        if name in BLOCKS and not self._dropped:
            self._end_line()

    def _enter(self, name: str, rest: str) -> None:
        if name == "head":
            self._push(name, True)
            return
        if name == "body" and self._open and self._open[-1][:2] == ("head", True):  # a head that was left open
            self._close("head")
        away = name in ASIDE or (name == "header" and not self._body)
        marked = False
        if rest and not away and name not in BODIES and name not in ("body", "html"):
            away = bool(_OFF.search(rest))
            if not away:
                for _, a, b, c in _ATTRIBUTE.findall(rest):
                    beside, front = marks(a or b or c)
                    marked |= beside or front and not self._body
        if name in BLOCKS or away or marked:
            self._break(name)
        if not self._dropped and name in ("h1", "h2"):
            self._heading = int(name[1])
        if (away or marked or name in SECTIONS or self._open and self._open[-1][1]) and name not in VOID and not rest.endswith("/"):
            self._push(name, away)
            if self._dropped:
                return
            if marked:
                self.outer.append(self._wrapper)
                self._wrapper = len(self.outer) - 1
            if name in BODIES:
                if not self._body:
                    w = self._wrapper
                    while w and w not in self.around:
                        self.around.add(w)
                        w = self.outer[w]
                self.bodies.append((name, self._body))
                self._body = len(self.bodies) - 1

    def _push(self, name: str, away: bool) -> None:
        self._open.append((name, away, self._wrapper, self._body))
        self._count[name] += 1
        self._dropped += away


def prose(line: Line) -> int:
    """Characters outside links."""
    return max(0, len(line.text) - line.linked) if 2 * line.linked < len(line.text) else 0


def surging(lines: list[Line]) -> bool:
    return any(b > a or len(lines[a].text) >= SURGE for a, b in surges(lines))


def without_wrappers(scan: Scan) -> list[Line]:
    """The lines with those of marked wrappers emptied, but not of wrappers that contain the article.

    Without a marked article outside, a wrapper contains it if it is marked there. If no text is left that surges, in the
    articles or on a page that marks none, the wrapper with the most text of its own contains it, and so do those around it.
    """
    inside = any(x.inside for x in scan.lines)

    def outside(freed: set[int]) -> list[Line]:
        closed = [False] * len(scan.outer)
        for w in range(1, len(closed)):
            closed[w] = closed[scan.outer[w]] or w not in freed
        return [Line("") if closed[x.wrapper] else x for x in scan.lines]

    freed = set() if any(x.inside and not x.wrapper for x in scan.lines) else set(scan.around)
    left = outside(freed)
    if len(scan.outer) == 1 or surging([x if x.inside else Line("") for x in left] if inside else left):
        return left
    weights: dict[int, int] = defaultdict(int)
    for x in scan.lines:
        if x.wrapper and (x.inside or not inside):
            weights[x.wrapper] += prose(x)
    w = max(weights, key=weights.__getitem__, default=0)
    if weights[w] >= 2 * SURGE:
        while w:
            freed.add(w)
            w = scan.outer[w]
    return outside(freed)


def without_teasers(scan: Scan, lines: list[Line]) -> list[Line]:
    """The lines without those of articles that are teasers beside the heaviest, or shorter ones inside another article."""
    count = len(scan.bodies)
    own, linked = [0] * count, [0] * count
    for x in lines:
        own[x.inside] += prose(x)
        linked[x.inside] += x.linked
    whole, links, over = own.copy(), linked.copy(), [0] * count  # over: nearest article around
    for i in range(1, count):
        name, up = scan.bodies[i]
        over[i] = up if scan.bodies[up][0] == "article" else over[up]
    for i in range(count - 1, 0, -1):
        whole[scan.bodies[i][1]] += whole[i]
        links[scan.bodies[i][1]] += links[i]
    heaviest = max((whole[i] for i in range(1, count) if scan.bodies[i][0] == "article"), default=0)
    gone = [False] * count
    for i in range(1, count):
        name, up = scan.bodies[i]
        gone[i] = gone[up] or name == "article" and (
            whole[i] < own[over[i]] and own[over[i]] >= SURGE if over[i] else TEASER * whole[i] < heaviest and links[i] > 0)
    return [Line("") if gone[x.inside] else x for x in lines]


def stretches(lines: list[Line]) -> list[tuple[int, int]]:
    """First and last line of every run of lines without a gap between them."""
    if not lines:
        return []
    sums = np.convolve([len(x.text) for x in lines], np.ones(SPAN, np.int64))[:len(lines)]  # window that ends at the line
    up = np.flatnonzero((sums > 0) & np.concatenate(([True], sums[:-1] == 0)))
    down = np.flatnonzero((sums > 0) & np.concatenate((sums[1:] == 0, [True])))
    return [(int(a), int(b)) for a, b in zip(up, down, strict=True)]


def is_notice(part: list[Line]) -> bool:
    """A short stretch about cookies that asks for something."""
    if sum(len(x.text) for x in part) > NOTICE_CHARS:
        return False
    text = " ".join(x.text for x in part)
    return bool(COOKIES.search(text) and ASKED.search(text))


def surges(lines: list[Line]) -> list[tuple[int, int]]:
    """The stretches in which the text outside links surges: a window of it holds SURGE characters, or a line of it a sentence."""
    out = []
    for a, b in stretches(lines):
        part = [x for x in lines[a:b + 1] if not LEGAL.match(x.text)]
        if is_notice(part):
            continue
        sums = np.convolve([prose(x) for x in part] or [0], np.ones(SPAN, np.int64))
        if sums.max() >= SURGE or any(prose(x) and SENTENCE.search(x.text) for x in part):
            out.append((a, b))
    return out


def main_text(page: str | None) -> str:
    """The lines of the article, joined by ``\\n``.

    If the page marks an article, all stretches inside it count; else everything from the first surge to the last dive,
    with headings that stand right before it and tables right after it. A page without a surge is taken whole.
    """
    if not page:
        return ""
    scan = Scan(page)
    lines = without_teasers(scan, without_wrappers(scan))
    parts = stretches(lines)
    if any(x.inside for x in lines):
        kept = [(a, b) for a, b in parts if any(x.inside for x in lines[a:b + 1])]
    elif found := set(surges(lines)):
        first = min(i for i, p in enumerate(parts) if p in found)
        last = max(i for i, p in enumerate(parts) if p in found)
        while first and any(x.heading for x in lines[parts[first - 1][0]:parts[first - 1][1] + 1]):
            first -= 1
        while last + 1 < len(parts) and any(x.table and prose(x) for x in lines[parts[last + 1][0]:parts[last + 1][1] + 1]):
            last += 1
        kept = [(a, b) for a, b in parts[first:last + 1] if not is_notice(lines[a:b + 1])]
    else:
        kept = parts
    return "\n".join(lines[i].text for a, b in kept for i in range(a, b + 1) if lines[i].text)


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of each page.

    * Null or empty pages, and pages without text, give an empty text. Pages are taken whole.
    * Character references are decoded, white space inside a block becomes one space, blocks are joined by ``\\n``.
    * Unclosed and crossed elements are allowed: a closing tag ends the elements that stand open inside it.
    * Rows are read alone, repeated rows give equal texts, an empty table stays empty; a column of the same name is replaced.

    No shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(html)]
            yield with_columns(batch, {out: pa.array(texts, pa.string())})

    return pages.mapInArrow(run, schema_with(pages, f"{out} string"))
