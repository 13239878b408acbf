"""HTML extraction by minimum-cut labelling of text blocks.

A page becomes blocks of text in page order. A linear classifier over the text alone (length, links, end mark,
depth, neighbours) gives every block a cost of being called boilerplate or content, which become
capacities to the two terminals. Elements whose tag or name tells what they hold are nodes as well, bound to the terminal
of their kind and tied to every block whose innermost telling ancestor they are: firmly, or less than confident text where only a part of a name tells, or where
the element holds most of the page's prose and next to none is elsewhere. Neighbouring blocks are joined by smoothness edges, stronger the
closer they are in the document tree, and so are consecutive blocks of one parent. The minimum cut
labels all blocks at once: the text alone says little of a short block, its element and its neighbours settle it.

The classifier is fitted on the pages at hand: blocks in ``article`` or ``main`` are its examples of content, those outside, in tags like ``nav`` or on several of a host's pages those of boilerplate;
names of elements aren't looked at. At most about ``FIT_PAGES`` pages and ``FIT_BLOCKS`` blocks take part, by hash of the page_id. A corpus without
examples of both kinds uses ``DEFAULT_WEIGHTS``.

Scripts, styles, comments and other elements without text of their own never become
blocks. Parsing takes one step a character, whatever is left open. Defined results for odd input: a null or empty page, or one of boilerplate alone,
gives an empty text; broken markup is read as browsers do, roughly (a stray ``<`` is text, missing end
tags are implied, after ``BROKEN_TAGS`` tags whose quotes never end quotes don't count); other columns aren't read; repeated rows give repeated results.
"""

from __future__ import annotations

import html as html_entities
import math
import re
from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_END = re.compile(r"[^>\"']*+([>\"'])")
_HINT = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Tags with quotes that never end, after which quotes are read as any character.
BROKEN_TAGS = 16

#: Elements whose content HTML reads as raw text up to their end tag.
RAW = frozenset("script style textarea iframe title xmp noembed noframes".split())
#: Elements whose own text is no block's; they are parsed, and end with their parent at the latest.
SILENT = frozenset("template select optgroup option svg annotation annotation-xml".split())
#: Elements of other languages, all of whose tags stand inside a line.
FOREIGN = frozenset(("svg", "math"))
#: Those of both that an element of HTML's text ends, as they have none.
ENDED = FOREIGN | {"select", "optgroup", "option"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Start tags that do so.
TEXT_TAGS = HEADINGS | frozenset("address article aside blockquote body center dd details div dl dt figure footer form header hr li main nav ol p pre section table ul".split())

#: What the innermost telling ancestor says of a block; 0 leaves it to those above.
TAG_HINT = {
    "article": 4.0, "main": 2.5, "nav": -6.0, "header": -5.0, "footer": -6.0, "aside": -5.0, "form": -5.0,
    "button": -5.0, "menu": -5.0, "dialog": -5.0, "fieldset": -4.0, "object": -6.0,
}
#: Words of class, id and role names, in the tables' languages.
BAD_WORDS = frozenset(
    "ad ads adbox adsbygoogle adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments cookie cookies "
    "consent discussion disqus disclaimer dialog footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification pagination pager popup promo promoted promotion recommended related replies reply respond share sharing "
    "sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget contentinfo complementary search "
    "kommentar kommentare werbung anzeige anzeigen seitenleiste fusszeile kopfzeile hinweis commentaire commentaires publicite pub annonce annonces pied entete "
    "comentario comentarios publicidad anuncio anuncios pie cabecera aviso".split()
)
GOOD_WORDS = frozenset("article articlebody body content entry main post story text artikel inhalt beitrag contenu texte contenido articulo texto".split())
#: Words that only say where or what kind of box something is; those of FRAMES hold whatever their other words name.
PLACES = frozenset(
    "site page main global top bottom left right primary secondary first last list lists box area bar block item items link links section col column row inner outer "
    "wrap wrapper container holder panel group region thread form fixed sticky mobile desktop".split()
)
FRAMES = frozenset("wrap wrapper container layout outer inner page holder".split())
#: First words of names that tell a state, not what an element is.
STATES = frozenset("has is no not with without js show hide".split())
BAD_HINT, GOOD_HINT = -6.0, 3.0
#: What a name says only with one of its parts.
WEAK_HINT = -1.0

#: The classifier's cost difference is cut to this, below the tie to an element that tells for certain.
CLIP = 2.5
#: Smoothness between a block and its telling element, for each kind of hint: more than the text and its neighbours can say, or less than confident text alone.
TIE, WEAK_TIE = 6.0, 0.5
#: A block of so many words, at most this share of them in links, is prose.
PROSE_WORDS, PROSE_LINKS = 10, 0.3
#: An element that tells of boilerplate but holds most of a page's prose, with less than this share of it elsewhere, is bound by WEAK_TIE as well.
ELSEWHERE = 0.2
#: Smoothness of neighbours with the same parent; FADE of it is left after every step of tree distance.
NEAR = 1.0
#: Smoothness of consecutive blocks of one parent that have others between them.
FADE = 0.1
SIBLING = 0.5
SCALE = 1000

#: Bounds of the sample that the classifier is fitted on.
FIT_PAGES = 1000
FIT_BLOCKS = 20_000
#: Sampled pages of one host on which boilerplate stands.
REPEATED = 3
#: What tags a text stands in isn't among them: sites differ in that, and telling tags have nodes of their own.
FEATURES = ("one", "log_words", "link_density", "end_mark", "depth", "log_words_near", "link_density_near", "log_siblings")
#: Used where the pages show no examples of both kinds; fitted weights are held to it with the strength HOLD.
HOLD = 0.02
DEFAULT_WEIGHTS = (-1.6, 0.8, -3.0, 0.8, 0.0, 0.1, -0.5, 0.0)


@dataclass
class Element:
    tag: str
    parent: int
    depth: int
    #: What the innermost telling element around it (itself included) says, and that element.
    hint: float
    teller: int


@dataclass
class Block:
    element: int
    text: str
    tag: str
    hint: float
    teller: int
    linked: int = 0


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def name_hint(name: str) -> tuple[bool, float]:
    """Whether one class, id or role is a content word, and what it says of boilerplate: for certain, with a part of it, or nothing."""
    words = _WORD.findall(re.sub("([a-z])([A-Z])", r"\1-\2", name).lower())
    if not words or words[0] in STATES:
        return False, 0.0
    bad = [w in BAD_WORDS for w in words]
    good = any(w in GOOD_WORDS for w in words)
    if not any(bad):
        return good, 0.0
    if good and words[-1] in FRAMES:  # a frame around both
        return False, 0.0
    rest = [w for w in words if w not in PLACES or w in BAD_WORDS]
    if good and set(rest) & BAD_WORDS <= {"header", "byline"}:  # the header of a post holds its title
        return True, 0.0
    return False, BAD_HINT if rest[-1] in BAD_WORDS and (good or all(w in BAD_WORDS for w in rest)) else WEAK_HINT


def hint_of(tag: str, attributes: str, inside_article: bool) -> float:
    if tag in ("html", "body"):
        return 0.0
    if attributes:
        found = [name_hint(x) for m in _HINT.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").split()]
        worst, good = min((h for _, h in found), default=0.0), any(g for g, _ in found)
        if worst < 0 and tag not in ("article", "main"):
            names = {w for m in _HINT.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())}
            if names & BAD_WORDS <= {"header", "byline"} and (inside_article or good):
                return 0.0
            if worst == BAD_HINT or not good:
                return worst
        if good and tag not in TAG_HINT:
            return GOOD_HINT
    if tag == "header" and inside_article:  # an article's own header holds its title
        return 0.0
    if tag == "noscript" and not inside_article:
        return BAD_HINT
    return TAG_HINT.get(tag, 0.0)


def markup(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """``start, end, closing, tag, attributes`` of every tag, comment and declaration; the tag of the last two is empty.

    The reader may send a position to go on from. No character is looked at more than
    ``BROKEN_TAGS`` times or so.
    """
    at, size, broken = 0, len(page), 0
    while True:
        start = page.find("<", at)
        if start < 0 or start + 1 >= size:
            return
        mark = page[start + 1]
        closing, tag, attributes = mark == "/", "", ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = size if end < 0 else end + 3
        elif mark in "!?":
            end = page.find(">", start) + 1
            if not end:
                return
        else:
            name = _NAME.match(page, start + 1 + closing)
            if not name:
                at = start + 1
                continue
            tag, end = name[0].lower(), 0
            if broken < BROKEN_TAGS:
                m = _TAG_END.match(page, name.end())
                while m and m[1] != ">":
                    close = page.find(m[1], m.end())
                    m = _TAG_END.match(page, close + 1) if close >= 0 else None
                end = m.end() if m else 0
                broken += not m
            if not end:
                end = page.find(">", name.end()) + 1
                if not end:
                    return
            attributes = page[name.end() : end - 1]
        sent = yield start, end, closing, tag, attributes
        at = end if sent is None else sent
        if sent is not None:
            yield (0, 0, False, "", "")  # the answer to send()


class Open:
    """The stack of open elements, with where each tag stands in it, so that no question walks down the stack."""

    def __init__(self) -> None:
        self.stack = [0]
        self.tags = [""]
        self.where: dict[str, list[int]] = defaultdict(list)
        self.blocks = [0]  # places of elements that aren't inline
        self.foreign: list[int] = []
        self.silent = 0

    def push(self, element: int, tag: str) -> None:
        k = len(self.stack)
        self.stack.append(element)
        self.tags.append(tag)
        self.where[tag].append(k)
        if tag not in INLINE:
            self.blocks.append(k)
        if tag in FOREIGN:
            self.foreign.append(k)
        self.silent += tag in SILENT

    def cut(self, k: int) -> None:
        """Closes the elements from place ``k`` on."""
        while len(self.stack) > k:
            self.stack.pop()
            tag = self.tags.pop()
            self.where[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            if tag in FOREIGN:
                self.foreign.pop()
            self.silent -= tag in SILENT

    def last(self, tag: str) -> int:
        """The place of the innermost open ``tag``; 0 if none is open."""
        found = self.where.get(tag)
        return found[-1] if found else 0

    def first(self, tags: frozenset | set) -> int:
        found = [self.where[t][0] for t in tags if self.where.get(t)]
        return min(found, default=0)

    def block(self) -> int:
        """The place of the innermost element that isn't inline and lies outside foreign ones."""
        if not self.foreign:
            return self.blocks[-1]
        return self.blocks[max(0, bisect_left(self.blocks, self.foreign[0]) - 1)]


def parse(page: str) -> Page:
    """Blocks of text with their elements, in page order."""
    out = Page([Element("", -1, 0, 0.0, 0)])
    open_ = Open()
    parts: list[str] = []
    linked = 0
    in_link = 0
    at, size = 0, len(page)

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                k = open_.stack[open_.block()]
                inner = out.elements[open_.stack[-1]]
                out.blocks.append(Block(k, text, out.elements[k].tag, inner.hint, inner.teller, min(linked, len(text))))
        linked = 0

    def text_until(end: int) -> None:
        nonlocal linked
        if end > at and not open_.silent:
            parts.append(page[at:end])
            if in_link:
                linked += end - at

    tokens = markup(page)
    for start, end, closing, tag, attributes in tokens:
        text_until(start)
        at = end
        if not tag:
            continue
        if closing:
            k = open_.last(tag)
            if k and open_.foreign and (tag in FOREIGN or open_.foreign[0] < k):
                open_.cut(k)
                continue
            if tag in FOREIGN:
                continue
            if tag not in INLINE:
                close_block()
            elif tag == "a":
                in_link = max(0, in_link - 1)
            # An inline end tag doesn't close a block.
            if k and (tag not in INLINE or k > open_.blocks[-1]):
                if tag not in INLINE:
                    in_link = 0
                open_.cut(k)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = found.end() if found else size
                tokens.send(at)
            if not open_.foreign:
                close_block()
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                close_block()
            continue
        if tag in TEXT_TAGS or tag in ("option", "optgroup"):
            k = open_.first(ENDED if tag in TEXT_TAGS else {"option"} if tag == "option" else {"option", "optgroup"})
            if k and not open_.last("template") and not open_.last("foreignobject"):
                open_.cut(k)
        if tag in FOREIGN or open_.foreign:
            pass
        elif tag not in INLINE:
            close_block()
            in_link = 0
            closes = ("p",) if tag not in ("li", "dt", "dd", "tr", "td", "th") else (tag, "p")
            k = open_.blocks[-1]
            if k and open_.tags[k] in closes:
                open_.cut(k)
        elif tag == "a":
            in_link += 1
        if attributes.endswith("/") and (tag not in INLINE or open_.foreign):
            continue
        up = out.elements[open_.stack[-1]]
        own = hint_of(tag, attributes, bool(open_.last("article")))
        if attributes and _HIDDEN.search(attributes):
            own = BAD_HINT
        n = len(out.elements)
        out.elements.append(Element(tag, open_.stack[-1], up.depth + 1, own or up.hint, n if own else up.teller))
        open_.push(n, tag)
    if at < size:
        text_until(size)
    close_block()
    return out


def features(page: Page) -> np.ndarray:
    """One row of FEATURES a block, of its text and place alone."""
    n = len(page.blocks)
    out = np.zeros((n, len(FEATURES)))
    siblings: dict[int, int] = defaultdict(int)
    for b in page.blocks:
        siblings[page.elements[b.element].parent] += 1
    for i, b in enumerate(page.blocks):
        out[i, :5] = 1, math.log1p(b.text.count(" ") + 1), b.linked / len(b.text), b.text[-1] in ".!?…\"”", min(page.elements[b.element].depth, 20) / 10
        out[i, 7] = math.log1p(siblings[page.elements[b.element].parent])
    if n > 1:
        near = np.zeros((n, 2))
        near[1:] += out[:-1, 1:3]
        near[:-1] += out[1:, 1:3]
        near[1:-1] /= 2
        out[:, 5:7] = near
    return out


def fitted_weights(x: np.ndarray, content: np.ndarray, hold: float = HOLD, rounds: int = 25) -> tuple[float, ...] | None:
    """Logistic weights of examples, both kinds weighing the same; None without both.

    The penalty ``hold`` (an example's share) pulls to DEFAULT_WEIGHTS, so that pages of one
    layout don't drive the weights to what holds in that layout alone.
    """
    n_content = int(content.sum())
    if not n_content or n_content == len(content):
        return None
    y = content.astype(float)
    share = np.where(content, 0.5 / n_content, 0.5 / (len(y) - n_content)) * len(y)
    prior, ridge = np.array(DEFAULT_WEIGHTS), hold * len(y)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (y - p)) - ridge * (w - prior)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(np.round(w, 9).tolist())


def tree_distance(elements: list[Element], a: int, b: int, most: int = 16) -> int:
    n = 0
    while a != b and n < most:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        n += 1
    return n


def min_cut(unary: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """True for nodes on the source's side; ``unary`` > 0 is capacity from the source, < 0 to the sink.

    A node whose terminal capacity exceeds all its edges is labelled at once, and its edges become
    capacities of its neighbours, which changes no minimum cut. Blocking flows along shortest paths
    settle the others; nodes that a cut may leave on either side go to the sink.
    """
    near: list[dict[int, int]] = [{} for _ in unary]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    excess = list(unary)
    label: list[bool | None] = [None] * len(unary)
    around = [sum(x.values()) for x in near]
    todo = deque(range(len(unary)))
    while todo:
        x = todo.popleft()
        if label[x] is None and abs(excess[x]) > around[x]:
            label[x] = excess[x] > 0
            for y, w in near[x].items():
                del near[y][x]
                around[y] -= w
                excess[y] += w if label[x] else -w
                todo.append(y)
            near[x].clear()
    left = [x for x in range(len(unary)) if label[x] is None]
    while True:
        level = {x: 0 for x in left if excess[x] > 0}
        queue = deque(level)
        found = False
        while queue:
            x = queue.popleft()
            found = found or excess[x] < 0
            for y, w in near[x].items():
                if w > 0 and y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        if not found:
            break
        arcs = {x: iter(list(near[x])) for x in level}
        for start in [x for x in level if level[x] == 0]:
            path = [start]
            while path and excess[start] > 0:
                x = path[-1]
                if excess[x] < 0:
                    flow = min([excess[start], -excess[x], *(near[a][b] for a, b in zip(path, path[1:], strict=False))])
                    excess[start] -= flow
                    excess[x] += flow
                    for a, b in zip(path, path[1:], strict=False):
                        near[a][b] -= flow
                        near[b][a] += flow
                    k = next((k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if not near[a][b]), len(path) - 1)
                    del path[k + 1 :]
                    continue
                y = next((y for y in arcs[x] if near[x][y] > 0 and level.get(y, -1) == level[x] + 1), None)
                if y is None:
                    path.pop()
                else:
                    path.append(y)
    return [x in level if label[x] is None else bool(label[x]) for x in range(len(unary))]


def _is_prose(b: Block) -> bool:
    return b.linked <= PROSE_LINKS * len(b.text) and b.text.count(" ") + 1 >= PROSE_WORDS


def doubtful_elements(page: Page) -> set[int]:
    """Elements that tell of boilerplate but hold more than half of the page's prose, with next to none elsewhere: frames around a page rather than a part of it.

    Any text elsewhere in an element that tells of content leaves no doubt.
    """
    n = len(page.elements)
    inside, plain, told = [0] * n, [0] * n, [0] * n
    for b in page.blocks:
        if _is_prose(b):
            inside[b.element] += len(b.text)
            plain[b.element] += len(b.text) * (b.hint >= 0)
        told[b.element] += b.hint > 0
    for k in range(n - 1, 0, -1):  # children come after their parents
        up = page.elements[k].parent
        for sums in (inside, plain, told):
            sums[up] += sums[k]
    tellers = {b.teller for b in page.blocks if b.hint < 0}
    return {
        k for k in tellers
        if 2 * inside[k] > inside[0] and plain[0] - plain[k] < ELSEWHERE * inside[k] and told[0] == told[k]
    }


def label_blocks(page: Page, weights: Sequence[float] = DEFAULT_WEIGHTS) -> tuple[list[bool], list[bool]]:
    """Whether each block is content, by the cut and by its own text alone."""
    n = len(page.blocks)
    if not n:
        return [], []
    scores = np.clip(features(page) @ np.array(weights), -CLIP, CLIP)
    unary = [int(x) for x in np.round(SCALE * scores)]
    doubtful = doubtful_elements(page)
    edges: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    tellers: dict[int, int] = {}
    for i, b in enumerate(page.blocks):
        parent = page.elements[b.element].parent
        if i:
            distance = tree_distance(page.elements, page.blocks[i - 1].element, b.element)
            edges[i - 1, i] = round(SCALE * NEAR * FADE ** max(0, distance - 2))
        if parent in last and last[parent] != i - 1:
            edges[last[parent], i] = round(SCALE * SIBLING)
        last[parent] = i
        if b.teller:
            k = tellers.setdefault(b.teller, n + len(tellers))
            if k == len(unary):
                unary.append(0)
            # The element is bound to its terminal by more than all of its ties, so that many blocks don't outvote it.
            tie = WEAK_TIE if b.hint == WEAK_HINT or b.teller in doubtful else TIE
            edges[i, k] = round(SCALE * tie)
            unary[k] += round(SCALE * math.copysign(tie + 1, b.hint))
    return min_cut(unary, edges)[:n], [x > 0 for x in unary[:n]]


def extract(page: str | None, weights: Sequence[float] = DEFAULT_WEIGHTS) -> tuple[str, int, int, int, int]:
    """The main text, the number of blocks, of content blocks, of blocks whose label isn't their text's own, and of those whose label isn't their element's."""
    parsed = parse(page or "")
    content, alone = label_blocks(parsed, weights)
    kept = [b.text for b, on in zip(parsed.blocks, content, strict=True) if on]
    overruled = sum(bool(b.teller) and on != (b.hint > 0) for b, on in zip(parsed.blocks, content, strict=True))
    return " ".join(kept), len(parsed.blocks), len(kept), sum(x != y for x, y in zip(content, alone, strict=True)), overruled


def tag_label(page: Page) -> list[float | None]:
    """What the innermost telling tag around each block says, whatever names elements have: 1 article or main, 0 boilerplate.

    Without a telling tag it is 0 on a page that has an article or main element with text, else None.
    """
    of: list[float | None] = [None] * len(page.elements)
    for k, e in enumerate(page.elements):
        hint = TAG_HINT.get(e.tag, 0.0)
        of[k] = float(hint > 0) if hint else of[e.parent] if e.parent >= 0 else None
    found = [of[b.element] for b in page.blocks]
    return [0.0 if x is None else x for x in found] if 1.0 in found else found


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES, fit_blocks: int = FIT_BLOCKS) -> tuple[float, ...]:
    """The classifier's weights from a bounded sample of ``page_id, html`` and, if there is one, ``url``: about ``fit_pages`` pages, at most ``fit_blocks`` blocks.

    A block is an example of boilerplate if its text stands on ``REPEATED`` sampled pages of its host, in a tag like ``nav``, or outside of a page's ``article`` and
    ``main``, one of content inside of these. Names of elements have no part in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[float]] = []
            texts: list[str] = []
            labels: list[float | None] = []
            hosts: list[str] = []
            for html, host in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True):
                page = parse(html or "")
                rows += features(page).tolist()
                texts += [b.text for b in page.blocks]
                labels += tag_label(page)
                hosts += [host or ""] * len(page.blocks)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(texts, pa.string()), pa.array(labels, pa.float64()), pa.array(rows, pa.list_(pa.float64()))], ["host", "text", "label", "x"])

    share = max(1, math.ceil(pages.count() / fit_pages))
    host = F.regexp_extract("url", r"^(?:\w+:)?//([^/?#]+)", 1) if "url" in pages.columns else F.lit("")
    some = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(share)) == 0).select("html", host.alias("host"))
    found = some.mapInArrow(run, "host string, text string, label double, x array<double>").withColumn("h", F.xxhash64("text")).drop("text")
    repeated = found.groupBy("host", "h").count().where(F.col("count") >= REPEATED).select("host", "h", F.lit(0.0).alias("_again"))
    found = found.join(repeated, ["host", "h"], "left").select(F.coalesce("_again", "label").alias("label"), "x").where("label is not null")
    rows = found.orderBy(F.xxhash64("x", "label"), "x").limit(fit_blocks).collect()
    if not rows:
        return DEFAULT_WEIGHTS
    return fitted_weights(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows]) > 0) or DEFAULT_WEIGHTS


def main_text(pages: DataFrame, weights: Sequence[float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_content, n_changed, n_overruled`` for every row of ``page_id, url, html``.

    ``n_changed`` are blocks that the cut labels otherwise than their own text does, ``n_overruled`` those that it labels otherwise than their telling element. Without ``weights`` they are fitted.
    """
    used = tuple(weights or fit(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x, used) for x in batch.column("html").to_pylist()]
            texts = [x[0] for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()),
                    *[pa.array([x[k] for x in found], pa.int64()) for k in (1, 2, 3, 4)],
                ],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_content", "n_changed", "n_overruled"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long, n_blocks long, n_content long, n_changed long, n_overruled long"
    )
