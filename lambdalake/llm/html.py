"""Operator 2: HTML main-text extraction by minimum-cut labelling.

A tolerant tag scan cuts a page into text blocks with their DOM places. A classifier gives each block its log-odds of being
content, which become terminal capacities: what its text looks like (length, last character, element, link share; weights
fitted on a bounded sample of blocks that their place on the page labels) and where it stands (within an article, within
navigation, under a class of adverts, notices or comments). Blocks next to each other, and next to each other within one
container, are tied by smoothness edges that weaken with their distance in the DOM and are of the size of a text's
log-odds. A maximum flow gives the cheapest labelling; blocks on the source's side are content. Equal cuts go to
boilerplate.

Class words that articles use themselves (notice, legal, search, ...) cost less than what prose within an article and two
kept neighbours weigh, so a paragraph between paragraphs stays and a short notice goes. A box that is one link and nothing else is an advert
or a button, wherever it stands. On a page without any article, the innermost box with three quarters of its prose stands in
for one: text outside is dearer, but for the last heading before it and what follows that.

The sample is ``SAMPLE`` pages at most (by a hash of page_id). Null and empty pages have an empty text. A page of any length and
depth is one unit; nothing is capped. Repeated rows are rows like any others; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"""["'>]""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is never text of the page; those that end a block; those that have no end tag.
SKIPPED = set("script style noscript template title textarea iframe svg object audio video canvas noframes noembed".split())
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the value ends where one of the key begins.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS |= {x: {"p"} for x in BLOCKS - set(ENDS) - {"head", "html", "body"}}
HARD = set("nav footer aside form button select dialog menu head fieldset".split())
HARD_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id names of what is not the article, how such words begin, and words that only say what a box is.
HINTS = set(
    "ad ads adbox banner promo promotion popup modal overlay subscribe subscription signup login gdpr consent menu nav navigation"
    " topbar toolbar footer masthead recommended recommendations pagination pager skip outbrain taboola comment comments commentlist disqus respond reply replies".split()
)
#: Such words that an article's own parts have as well.
LOOSE_HINTS = set("notice notification notifications alert legal copyright disclaimer search discussion share sharing social related".split())
HINT_STARTS = ("advert", "cookie", "sidebar", "navbar", "newsletter", "breadcrumb", "sponsor")
NEUTRAL = set("box block bar list links link wrapper wrap container area section item items panel pane group row widget form button buttons icons posts articles stories top bottom left right main site page global".split())
ARTICLE, NAVIGATION, HINTED, SOFT, LOOSE = 1, 2, 4, 8, 16


@dataclass
class Element:
    tag: str
    flags: int
    parent: Element | None
    depth: int = 0
    inner: int = 0  # open elements of the same name inside that are not on the stack


@dataclass
class Block:
    text: str
    element: Element
    linked: int


class Scanner:
    """Tags of a page from left to right. Every part of the text is looked at a bounded number of times: places from which a tag
    is known not to end are remembered, and nothing is looked for behind the last of its kind."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        self.dead: set[int] = set()

    def _end(self, at: int) -> int:
        """Where a tag ends whose attributes are read from ``at``: behind the first ``>`` outside quotes; -1 if a quote stays open."""
        seen = []
        while True:
            if at in self.dead:
                break
            seen.append(at)
            m = MARK.search(self.html, at)
            if not m:
                break
            if m[0] == ">":
                return m.end()
            if self.last_quote[m[0]] <= m.start():
                break
            at = self.html.index(m[0], m.end()) + 1
        self.dead.update(seen)
        return -1

    def tag(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """The next (start, end, name, closing, attributes) from ``at``; declarations and comments have no name."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if start > self.last:  # only a comment that does not end can begin here
                start = html.find("<!--", start)
                return None if start < 0 else (start, len(html), "", False, "")
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), "", False, ""
            if html.startswith(("<!", "<?"), start):
                return start, html.index(">", start) + 1, "", False, ""
            m = NAME.match(html, start)
            if m:
                end = self._end(m.end())
                if end < 0:  # a quote stays open: to the first > all the same
                    end = html.index(">", m.end() if html[m.end() - 1] != ">" else m.end() - 1) + 1
                return start, end, m[1].lower(), html[start + 1] == "/", html[m.end() : end - 1]
            at = start + 1
        return None

    def skip(self, tag: str, at: int) -> int:
        """Behind the closing tag of an element whose content is no text."""
        m = re.compile(rf"</{tag}\b", re.IGNORECASE).search(self.html, at)
        end = self.html.find(">", m.end()) if m and m.end() <= self.last else -1
        return end + 1 if end >= 0 else len(self.html)


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def flush(self, top: Element) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text:
                self.blocks.append(Block(text, top, self.linked))
            self.parts, self.linked = [], 0


def _hint(names: str) -> int:
    """HINTED if all words of a class or id are about something else than the article, LOOSE if they may be its own as well, SOFT if
    only some are."""
    out = 0
    for name in names.lower().split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        sure = [w in HINTS or w.startswith(HINT_STARTS) for w in words]
        told = [t or w in LOOSE_HINTS for t, w in zip(sure, words, strict=True)]
        if any(told):
            whole = all(t or w in NEUTRAL for t, w in zip(told, words, strict=True))
            out |= SOFT if not whole else HINTED if any(sure) else LOOSE
    return out


def _flags(tag: str, raw: str, above: int) -> int:
    flags, hint, attributes = above, 0, {}
    if raw and not raw.isspace():
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}
        hint = _hint(f"{attributes.get('class', '')} {attributes.get('id', '')}")
    role = attributes.get("role", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        flags |= NAVIGATION
    if tag in HARD or role in HARD_ROLES or tag == "header" and not above & ARTICLE:
        flags |= NAVIGATION
    if tag not in ("body", "html"):
        flags |= hint
    if (tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop") == "articleBody") and not hint & HINTED:
        flags |= ARTICLE
    return flags


def blocks(html: str) -> list[Block]:
    """Text blocks in page order; character references decoded, white space runs made one blank."""
    page, stack, at = Page(), [Element("", 0, None)], 0
    links, scanner = 0, Scanner(html)
    open_now: Counter[str] = Counter()

    def push(tag: str, flags: int) -> None:
        stack.append(Element(tag, flags, stack[-1], stack[-1].depth + 1))
        open_now[tag] += 1

    def pop() -> None:
        open_now[stack.pop().tag] -= 1

    while True:
        m = scanner.tag(at)
        text = html[at : m[0] if m else len(html)]
        if text:
            page.parts.append(text)
            if links:
                page.linked += len(text)
        if not m:
            break
        _, at, tag, closing, raw = m
        if not tag:
            continue
        top = stack[-1]
        if tag in SKIPPED and not closing:
            at = scanner.skip(tag, at)
            continue
        if tag == "br":
            page.parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag not in BLOCKS:
            if closing and top.tag == tag:
                if top.inner:
                    top.inner -= 1
                else:
                    page.flush(top)
                    pop()
            elif not closing and tag not in VOID:
                own = _flags(tag, raw, 0) if any(x in raw for x in ("class", "id", "hidden", "role", "style")) else 0
                if own & (NAVIGATION | HINTED | LOOSE):
                    page.flush(top)
                    push(tag, top.flags | own)
                elif top.tag == tag:
                    top.inner += 1
            continue
        page.flush(top)
        links = 0
        if closing:
            while open_now[tag] and stack[-1].tag != tag:
                pop()
            if open_now[tag]:
                pop()
        elif tag not in VOID:
            while len(stack) > 1 and stack[-1].tag in ENDS.get(tag, ()):
                pop()
            push(tag, _flags(tag, raw, stack[-1].flags))
    page.flush(stack[-1])
    return page.blocks


# Costs.

HEADINGS = ("h1", "h2", "h3", "h4")
TEXT_TAGS = {"p", "blockquote", "pre", "li", "td", "th", "dt", "dd", "option", *HEADINGS}

FEATURES = ["bias", "under 25 characters", "80 and more", "200 and more", "ends in a stop", "paragraph", "heading", "list or cell", "mostly link", "some link"]
#: Weights by hand, which the fit starts from and is drawn to; the weights of places; the most that a text counts.
PRIOR = (0.0, -1.5, 1.0, 1.0, 1.0, 1.0, 0.5, -0.8, -3.0, -1.0)
IN_ARTICLE, ELSEWHERE, IN_NAVIGATION, IN_HINTED, IN_LOOSE, IN_SOFT, MOST = 4.0, -6.0, -13.0, -13.0, -7.5, -1.0, 3.0
#: A box of one link only; text outside the box that stands in for an article.
ONE_LINK, OUTSIDE = -6.0, -4.0
#: Log-odds of a tie at distance 0; pages of the sample; blocks that a sample counts as, against the prior's one.
TIE, SAMPLE, EVIDENCE = 3.0, 2000, 1000.0


def features(block: Block) -> int:
    """Bit set of FEATURES."""
    n, tag = len(block.text), block.element.tag
    on = (
        True, n < 25, n >= 80, n >= 200, block.text[-1] in ".!?…:;»”\"'", tag in ("p", "blockquote", "pre"), tag in HEADINGS,
        tag in ("li", "td", "th", "dt", "dd", "option"), 2 * block.linked > n, 5 * block.linked > n,
    )
    return sum(1 << k for k, x in enumerate(on) if x)


def place(block: Block) -> int | None:
    """1 for content and 0 for boilerplate where the place of a block says so by itself."""
    flags = block.element.flags
    return 0 if flags & (NAVIGATION | HINTED) else 1 if flags & ARTICLE and not flags & (SOFT | LOOSE) else None


def fit_weights(counts: dict[tuple[int, int], int]) -> tuple[float, ...]:
    """Logistic weights for counts of (features, label), drawn to PRIOR, by Newton's steps."""
    prior = np.array(PRIOR)
    if not counts:
        return PRIOR
    on = np.array([[bits >> k & 1 for k in range(len(FEATURES))] for bits, _ in counts], float)
    label, n = np.array([y for _, y in counts], float), np.array(list(counts.values()), float)
    # Both kinds count the same, whatever their numbers.
    for y in (0, 1):
        n[label == y] *= EVIDENCE / 2 / max(1.0, n[label == y].sum())
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(on @ w, -30, 30)))
        gradient = on.T @ (n * (label - p)) - (w - prior)
        step = np.linalg.solve(on.T @ (on * (n * p * (1 - p))[:, None]) + np.eye(len(w)), gradient)
        w += step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return tuple(w.round(6).tolist())


def fit(pages: DataFrame, sample: int = SAMPLE) -> tuple[float, ...]:
    """Weights of FEATURES from the blocks of about ``sample`` pages at most."""
    part = pages.where("html is not null").select("page_id", "html")
    bound = min(1 << 40, (sample << 40) // max(1, part.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        for batch in batches:
            for html in batch.column(1).to_pylist():
                for block in blocks(html):
                    if (y := place(block)) is not None:
                        key = features(block), y
                        counts[key] = counts.get(key, 0) + 1
        yield pa.record_batch([pa.array([b for b, _ in counts], pa.int32()), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["bits", "label", "n"])

    chosen = part.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 40)) < bound)
    got = chosen.mapInArrow(run, "bits int, label int, n long").groupBy("bits", "label").agg(F.sum("n").alias("n")).orderBy("bits", "label").collect()
    return fit_weights({(r.bits, r.label): r.n for r in got})


def outside(found: list[Block]) -> list[bool]:
    """For a page without an article: which blocks lie outside the innermost box that holds three quarters of the prose. The last
    heading before it, and what is between them, count as inside. Each element is looked at once."""
    seen: dict[int, Element] = {}
    prose: dict[int, int] = {}
    total = 0
    for b in found:
        e, n = b.element.parent or b.element, len(b.text)
        if n >= 25 and 2 * b.linked <= n and not b.element.flags & (NAVIGATION | HINTED | LOOSE):
            prose[id(e)] = prose.get(id(e), 0) + n
            total += n
        e = b.element
        while e is not None and id(e) not in seen:
            seen[id(e)] = e
            e = e.parent
    if not total:
        return [False] * len(found)
    by_depth = sorted(seen.values(), key=lambda e: e.depth)
    for e in reversed(by_depth):
        if e.parent is not None and id(e) in prose:
            prose[id(e.parent)] = prose.get(id(e.parent), 0) + prose[id(e)]
    # More than half: at most one of each depth, each within the one before.
    box = [e for e in by_depth if 4 * prose.get(id(e), 0) >= 3 * total][-1]
    inside: dict[int, bool] = {}
    for e in by_depth:
        inside[id(e)] = e is box or e.parent is not None and inside[id(e.parent)]
    out = [not inside[id(b.element)] for b in found]
    begin = out.index(False)
    title = max((j for j in range(begin) if found[j].element.tag in HEADINGS), default=begin)
    return [x and not title <= j < begin for j, x in enumerate(out)]


def cost(block: Block, has_article: bool, weights: tuple[float, ...] = PRIOR, out: bool = False) -> int:
    """Above 0: so much dearer as boilerplate; below: as content. Hundredths of log-odds."""
    bits, flags = features(block), block.element.flags
    score = max(-MOST, min(MOST, sum(w for k, w in enumerate(weights) if bits >> k & 1)))
    if flags & ARTICLE:
        score += IN_ARTICLE
    elif has_article:
        score += ELSEWHERE
    score += IN_NAVIGATION * bool(flags & NAVIGATION) + IN_HINTED * bool(flags & HINTED) + IN_LOOSE * bool(flags & LOOSE) + IN_SOFT * bool(flags & SOFT)
    n = len(block.text)
    score += OUTSIDE * out + ONE_LINK * (n <= block.linked and n < 200 and block.element.tag not in TEXT_TAGS)
    return round(100 * score)


def _distance(a: Element, b: Element) -> int:
    """Steps from one element to the other; over all neighbours of a page about as many as it has elements."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(all_blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, weight): neighbours on the page, and neighbours within one container."""
    out, last = [], {}
    weight = lambda steps: round(100 * TIE / (1 + steps))
    for j, b in enumerate(all_blocks):
        if j:
            out.append((j - 1, j, weight(_distance(all_blocks[j - 1].element, b.element))))
        i = last.get(id(b.element.parent))
        if i is not None and i != j - 1:
            out.append((i, j, weight(0 if all_blocks[i].element is b.element else 2)))
        last[id(b.element.parent)] = j
    return out


def minimum_cut(costs: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source, by shortest augmenting paths in levels. Positive costs are
    capacities from the source, negative ones to the sink, ties go both ways."""
    n = len(costs)
    source, sink = n, n + 1
    near: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def link(a: int, b: int, there: int, back: int) -> None:
        near[a].append(len(to))
        to.append(b)
        room.append(there)
        near[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            link(source, i, c, 0)
        elif c < 0:
            link(i, sink, -c, 0)
    for a, b, w in ties:
        if w:
            link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in near[x]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn, path, x = [0] * (n + 2), [], source
        while True:
            if x == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] == 0)
                x = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[x] < len(near[x]):
                e = near[x][turn[x]]
                if room[e] > 0 and level[to[e]] == level[x] + 1:
                    break
                turn[x] += 1
            else:
                if x == source:
                    break
                level[x] = -1
                x = to[path.pop() ^ 1]
                continue
            path.append(e)
            x = to[e]


def main_text(html: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    if not html:
        return ""
    found = blocks(html)
    has_article = any(place(b) == 1 for b in found)
    out = [False] * len(found) if has_article else outside(found)
    keep = minimum_cut([cost(b, has_article, weights, x) for b, x in zip(found, out, strict=True)], edges(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, weights: tuple[float, ...] = PRIOR) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x, weights) for x in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
