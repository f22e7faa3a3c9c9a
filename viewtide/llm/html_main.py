"""Main text of HTML pages by minimum-cut labelling.

A page becomes its text blocks in page order. A linear classifier gives each block a cost for either label from its
elements (article, navigation, form, ...), class names, length, share of links and punctuation; these costs are the
capacities to the two terminals. Neighbouring blocks, and blocks that follow each other inside one element, are tied by
smoothness edges. The minimum cut, found by maximum flow, separates content from boilerplate.

A page is handled by itself, in one pass over its whole html, so pages are a map over batches.

Edge cases: a null or empty html has no text; unclosed and stray tags, comments and raw elements are taken as browsers
do; controls, media and drawings are dropped from their begin to their own end tag, and if they have none (an ancestor ends,
a button opens in a button, a paragraph opens in a drawing), only their tag is; a tag cut off by the page's end is dropped; repeated rows give repeated results; a page without any content block
has an empty text; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame

from viewtide.llm import common

ROWS = "page_id bigint, url string, text string, n_chars bigint, n_blocks int, n_kept int"
#: Elements that end a block. Fixed values of HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split())
#: Elements that hold other blocks.
HOLDERS = BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 hr li dt dd td th tr caption summary legend option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw and no text of the page; without an end tag they reach to the page's end.
SKIPPED = "script style noscript template textarea iframe title".split()
#: Elements that are dropped with their content if they are closed.
DROPPED = frozenset("select button svg math object canvas audio video".split())
#: Elements that close an open one of their name.
ALONE = frozenset("select button".split())
DRAWINGS = ("svg", "math")
#: HTML elements that end a drawing, unless inside of one of INTEGRATION.
BREAKOUT = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li menu ol p pre table ul".split())
INTEGRATION = frozenset("foreignobject desc annotation-xml mtext".split())
RAW = re.compile("(" + "|".join(SKIPPED) + r")\b", re.I)
RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in SKIPPED}
NAME = re.compile("(/?)([a-z][a-z0-9:-]*)", re.I)
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Words of class names and roles.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|byline-social|comments?|complementary|"
    r"consent|contentinfo|cookies?|copyright|dialog|discussion|disqus|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|"
    r"navigation|newsletter|notices?|outbrain|overlay|pager|pagination|popup|promo|promoted|recommended|related|replies|"
    r"responses?|search|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|subscription|taboola|"
    r"tags?|toolbar|trending|widget)(?:$|[\s_\d-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|articlebody|blog|body|content|entry|main|post|story|text)(?:$|[\s_\d-])", re.I)
#: Costs in favour of content, by what holds the block.
BOILERPLATE_TAGS = {"nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "dialog": -9.0, "head": -20.0,
                    "search": -9.0, "header": -7.0}
CONTENT_TAGS = {"article": 6.0, "main": 4.0}
MARKED, NAMED = -9.0, 2.0
#: On a page without any of CONTENT_TAGS all text counts for more.
UNMARKED = 1.5
ADJACENT, SIBLING = 0.5, 0.75


@dataclass
class Block:
    text: str
    score: float
    parent: int


def names(attributes: str) -> str:
    return " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attributes)) if "=" in attributes else ""


def holder_score(tag: str, attributes: str, outer: float) -> float:
    """Score that an element passes on to the blocks inside it."""
    if tag in BOILERPLATE_TAGS:
        if tag == "header" and outer > 0:  # the head of the article itself
            return outer - 1.0
        return min(outer, BOILERPLATE_TAGS[tag])
    score = outer
    if attributes:
        named = names(attributes)
        if HIDDEN.search(attributes):
            return min(outer, MARKED)
        if named and tag not in ("body", "html"):
            if BOILERPLATE.search(named):
                # "post-header", "entry-content comments": the narrower word decides, but an article stays one
                return outer if tag in CONTENT_TAGS else min(outer, MARKED)
            if CONTENT.search(named) and outer > MARKED:
                score += NAMED
    if tag in CONTENT_TAGS and outer > MARKED:
        score = max(score, 0.0) + CONTENT_TAGS[tag]
    return score


class Markup(NamedTuple):
    """A comment, declaration or raw element (no tag), or a tag with its slash and attributes."""

    begin: int
    end: int
    slash: str = ""
    tag: str | None = None
    attributes: str = ""


class TagEnds:
    """Where tags end: at the first > outside of quotation marks. Asked for growing places, it reads a page once."""

    def __init__(self, page: str):
        self.page, self.known = page, {}
        self.last = {mark: page.rfind(mark) for mark in ">\"'"}
        self.asked = self.found = -1

    def stop(self, at: int) -> int:
        """The first >, \" or ' from ``at`` on; -1 if none is left."""
        if not self.asked <= at <= self.found:
            hit = STOP.search(self.page, at) if at <= max(self.last.values()) else None
            self.asked, self.found = at, hit.start() if hit else len(self.page)
        return self.found if self.found < len(self.page) else -1

    def end(self, at: int) -> int:
        """The place after the tag whose attributes begin at ``at``; -1 if it has no end."""
        place, passed, result = self.stop(at), [], -1
        while place >= 0:
            if place in self.known:
                result = self.known[place]
                break
            passed.append(place)
            mark = self.page[place]
            if mark == ">":
                result = place + 1
                break
            if place >= self.last[mark]:      # a quotation that never ends
                break
            after = STOP.search(self.page, self.page.find(mark, place + 1) + 1)
            place = after.start() if after else -1
        self.known.update(dict.fromkeys(passed, result))
        return result


def markup(page: str) -> Iterator[Markup]:
    """Comments, raw elements and tags of a page in order; what is none of these is text."""
    ends, at = TagEnds(page), page.find("<")
    while at >= 0:
        piece = None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            piece = Markup(at, end + 3 if end >= 0 else len(page))
        elif name := NAME.match(page, at + 1):
            end = ends.end(name.end())
            raw = RAW.match(page, at + 1) if end >= 0 else None
            if raw:
                close = RAW_END[raw.group(1).lower()].search(page, end)
                piece = Markup(at, close.end() if close else len(page))
            elif end >= 0:
                piece = Markup(at, end, name.group(1), name.group(2), page[name.end():end - 1])
        if piece is None and page[at + 1:at + 2] in ("!", "?", "/"):
            end = page.find(">", at + 2) + 1
            piece = Markup(at, end or len(page))
        elif piece is None and at > ends.last[">"] and page[at + 1:at + 2].isascii() and page[at + 1:at + 2].isalpha():
            piece = Markup(at, len(page))
        if piece:
            yield piece
        at = page.find("<", piece.end if piece else at + 1)


def closed(tags: list[Markup]) -> dict[int, int]:
    """Begin and end of the elements of DROPPED that have an end tag of their own."""
    out: dict[int, int] = {}
    open_at: dict[str, list[tuple[int, int]]] = {x: [] for x in DROPPED}
    depth = integrated = 0
    for m in tags:
        if m.tag is None:
            continue
        tag, closing = m.tag.lower(), m.slash
        if tag in DROPPED:
            if closing:
                if open_at[tag]:
                    out[open_at[tag].pop()[0]] = m.end
            elif tag in DRAWINGS and m.attributes.endswith("/"):
                out[m.begin] = m.end
            else:
                if tag in ALONE:
                    open_at[tag].clear()
                open_at[tag].append((m.begin, depth))
            continue
        if tag in INTEGRATION:
            integrated = max(0, integrated + (-1 if closing else 1))
        elif tag in BREAKOUT and not closing and not integrated:
            for x in DRAWINGS:
                open_at[x].clear()
        if tag in HOLDERS:
            depth += -1 if closing else 1
            if closing:
                for some in open_at.values():
                    while some and some[-1][1] > depth:
                        some.pop()
    return out


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, scored."""
    out: list[Block] = []
    stack: list[tuple[str, float, int]] = [("", 0.0, 0)]
    opened: Counter[str] = Counter()      # how many of each tag the stack holds
    held, linked, in_link, own, tag_of_block, count = [], 0, 0, 0.0, "", 0
    marked_content = False

    def close() -> None:
        nonlocal held, linked, own, tag_of_block
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, stack[-1][1] + own + text_score(text, linked, tag_of_block), stack[-1][2]))
        held, linked, own, tag_of_block = [], 0, 0.0, ""

    def add(piece: str) -> None:
        nonlocal linked
        text = html.unescape(piece) if "&" in piece else piece
        held.append(text)
        if in_link:
            linked += len(text.strip())

    at, tags = 0, list(markup(page))
    dropped = closed(tags)
    for m in tags:
        if m.begin < at:  # inside of a dropped element
            continue
        if m.begin > at:
            add(page[at:m.begin])
        at = dropped.get(m.begin, m.end)
        tag = m.tag
        if tag is None or tag.lower() in DROPPED:
            continue
        tag, closing, attributes = tag.lower(), m.slash, m.attributes
        if tag == "br":
            held.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in VOID:
            if tag == "hr":
                close()
        elif closing:
            if tag in BLOCK:
                close()
            if opened[tag]:
                if tag not in BLOCK:
                    close()
                while stack[-1][0] != tag:
                    opened[stack.pop()[0]] -= 1
                opened[stack.pop()[0]] -= 1
        else:
            marked = attributes and "=" in attributes and tag not in HOLDERS and BOILERPLATE.search(names(attributes))
            if tag in BLOCK or marked:
                close()
            if tag in HOLDERS or (marked and tag not in BLOCK):
                count += 1
                marked_content = marked_content or tag in CONTENT_TAGS
                stack.append((tag, holder_score(tag, attributes, stack[-1][1]), count))
                opened[tag] += 1
            elif tag in BLOCK:
                tag_of_block = tag
                if attributes:
                    own = holder_score(tag, attributes, stack[-1][1]) - stack[-1][1]
    if at < len(page):
        add(page[at:])
    close()
    if not marked_content:
        for b in out:
            b.score += UNMARKED
    return out


def text_score(text: str, linked: int, tag: str) -> float:
    """The part of a block's cost that its own text gives."""
    n = len(text)
    score = min(n / 100.0, 3.0) - 1.0 - 4.0 * min(linked / n, 1.0)
    if tag == "p":
        score += 1.0
    elif tag[:1] == "h" and len(tag) == 2:
        score += 0.5
    if text[-1] in ".!?:;\"'»":
        score += 0.5
    return score


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the content side of the minimum cut.

    Node i is tied to the content terminal by its gain if that is positive, to the other by its loss; ``edges`` are the
    smoothness edges. Maximum flow by shortest augmenting levels; what the residual graph still reaches is content.
    """
    n = len(gain)
    source, sink = n, n + 1
    to, room, around = [], [], [[] for _ in range(n + 2)]

    def tie(a: int, b: int, there: float, back: float) -> None:
        around[a].append(len(to))
        to.append(b)
        room.append(there)
        around[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            tie(source, i, g, 0.0)
        elif g < 0:
            tie(i, sink, -g, 0.0)
    for a, b, weight in edges:
        tie(a, b, weight, weight)

    def levels() -> list[int]:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in around[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        return level

    level = levels()
    while level[sink] >= 0:
        tried = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                back = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                at = to[path[back] ^ 1]
                del path[back:]
                continue
            while tried[at] < len(around[at]):
                e = around[at][tried[at]]
                if room[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    break
                tried[at] += 1
            else:
                if at == source:
                    break
                e = path.pop()
                at = to[e ^ 1]
                tried[at] += 1
                continue
            path.append(e)
            at = to[e]
        level = levels()
    return [level[i] >= 0 for i in range(n)]


def labelled(found: list[Block]) -> list[bool]:
    """Content or not for each block. Neighbours of one parent and one sign form one node of the graph."""
    node, gain, last_of, edges = [], [], {}, {}
    for i, b in enumerate(found):
        before = found[i - 1] if i else None
        if before and before.parent == b.parent and (before.score > 0) == (b.score > 0):
            gain[node[-1]] += b.score
        else:
            if before:
                edges[node[-1], len(gain)] = ADJACENT
            if b.parent in last_of:
                pair = (last_of[b.parent], len(gain))
                edges[pair] = edges.get(pair, 0.0) + SIBLING
            gain.append(b.score)
        node.append(len(gain) - 1)
        last_of[b.parent] = node[-1]
    content = minimum_cut(gain, [(a, b, w) for (a, b), w in edges.items()])
    return [content[k] for k in node]


def main_text(page: str | None) -> tuple[str, int, int]:
    """Text, number of blocks and of blocks kept."""
    found = blocks(page) if page else []
    kept = [b.text for b, yes in zip(found, labelled(found)) if yes] if found else []
    return "\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of every row of ``pages`` (page_id, url, html)."""
    def run(batch):
        rows = [main_text(x.as_py()) for x in batch["html"]]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": [r[0] for r in rows],
                "n_chars": [len(r[0]) for r in rows], "n_blocks": [r[1] for r in rows], "n_kept": [r[2] for r in rows]}

    return common.arrow_map(common.pick(pages, "page_id", "url", "html"), run, ROWS)
