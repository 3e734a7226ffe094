"""Main text of HTML pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import functools
import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import kernels as K

#: Expected bound on the pages of the table, and number of the generated ones, that the classifier is fitted on.
TRAINING_PAGES, GENERATED_PAGES = 400, 400
#: Fixed values of HTML: elements without content, elements whose content is no markup, elements that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "iframe", "title", "svg", "annotation-xml", "annotation")
#: Elements of other languages: these alone can end in their own tag, with ``/>``.
FOREIGN = frozenset(("svg", "annotation-xml", "annotation"))
#: Elements that a head may hold; any other ends it.
IN_HEAD = frozenset("head title base link meta style script noscript template".split())
BREAKING = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements, and words of class, id and role, that the classifier has features for; none of them decides alone.
AGAINST = frozenset("nav footer aside menu button dialog select textarea".split())
AGAINST_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted related search share sharing sidebar social sponsor sponsored subscribe tags toolbar widget".split())
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
FOR = frozenset("article main".split())
FOR_WORDS = frozenset("article body content entry main post story text".split())
#: Words that leave the meaning of the others in a class as it is: ``share-buttons`` is as ``share``, ``share-price`` is not.
NEUTRAL_WORDS = frozenset("area author bar block bottom box button buttons col column container form group inner item items left level links list meta module outer page panel posts right row section site top unit wrap wrapper".split())
#: Smoothness of edges that are tried; terminal capacities are cut off at this cost.
SMOOTHNESS, LIMIT = (0.25, 0.5, 1.0, 1.5, 2.0), 8.0
PENALTY = 1e-5

_ATTRS = r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>" + _ATTRS + r")>|</[^>]*>|<[a-zA-Z/][^<>]*\Z", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
#: A class that says what a page has or lacks, not what the element is.
_ABOUT = re.compile(r"(?:has|have|with|no|without|show|hide)[-_]", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_CLOSES_P = BREAKING - frozenset("br option button".split())

#: What an element says of what is below it.
HARD, MARKED, PARTIAL, COMMENTS, CONTENT_TAG, CONTENT_WORD, HEADER, HIDDEN = (1 << k for k in range(8))
FEATURES = ("bias", "words", "log_words", "link_share", "sentence", "paragraph", "item", "heading", "hard", "marked", "partial", "comments", "content_tag", "content_word", "header", "hidden", "outside_content", "plain")
SHAPE = 8


@dataclass
class Page:
    """Blocks of text in page order, and the elements around them.

    A block has its text, the share of it in links, the name of the element that it stands in and
    that element's number; an element has its parent's number, which is smaller, and its marks.
    """

    texts: list[str] = field(default_factory=list)
    linked: list[float] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    elements: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [0])
    marks: list[int] = field(default_factory=lambda: [0])


@functools.lru_cache(4096)
def _class_marks(value: str) -> int:
    """Marks of one class, id or role."""
    if _ABOUT.match(value):
        return 0
    words = {w.lower() for w in _WORD.findall(value)}
    if words & (AGAINST_WORDS | COMMENT_WORDS):
        if not words <= AGAINST_WORDS | COMMENT_WORDS | FOR_WORDS | NEUTRAL_WORDS:
            return PARTIAL
        return (MARKED if words & AGAINST_WORDS else 0) | (COMMENTS if words & COMMENT_WORDS else 0)
    return CONTENT_WORD if words & FOR_WORDS and words <= FOR_WORDS | NEUTRAL_WORDS else 0


def attributes(source: str) -> dict[str, str]:
    """Attributes of a tag by name, in lower case; of repeated ones the first; one without a value has ''."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _marks(name: str, attrs: str, in_content: bool) -> int:
    found = HARD if name in AGAINST else HEADER if name == "header" and not in_content else MARKED if name == "form" else CONTENT_TAG if name in FOR else HIDDEN if name == "template" else 0
    if attrs.strip(" /\t\n") and name not in ("html", "body"):
        given = attributes(attrs)
        for key in ("class", "id", "role"):
            for value in given.get(key, "").split():
                found |= _class_marks(value)
        if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _NOT_SHOWN.search(given.get("style", "")):
            found |= HIDDEN
    return found


def parse(source: str) -> Page:
    """Blocks of a page; character references are decoded and white space is one space.

    Scripts, styles, drawings and the title are no text; all else comes back, hidden or not, for the cut to decide.
    """
    page = Page()
    # An open element: name, number, links open, number and name of the nearest element that ends
    # blocks, whether an article or main is around.
    stack: list[tuple[str, int, int, int, str, bool]] = [("", 0, 0, 0, "", False)]
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    linked, where, at = 0, (0, ""), 0
    unended: set[str] = set()  # elements that do not end on the rest of the page, so that it is searched once

    def flush() -> None:
        nonlocal linked, where
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                page.texts.append(text)
                page.linked.append(min(1.0, linked / len(text)))
                page.elements.append(where[0])
                page.names.append(where[1])
        parts.clear()
        top = stack[-1]
        linked, where = 0, (top[3], top[4])

    def close(depth: int) -> bool:
        broken = False
        while len(stack) > depth:
            gone = stack.pop()[0]
            places[gone].pop()
            broken |= gone in BREAKING
        return broken

    def add(text: str) -> None:
        nonlocal linked
        if text:
            if stack[-1][0] == "head" and text.strip():
                leave_head()
            parts.append(text)
            if stack[-1][2]:
                linked += len(text)

    def leave_head() -> None:
        close(places["head"][-1])
        flush()

    while token := _TOKEN.search(source, at):
        add(source[at : token.start()])
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["end"]:
            if places.get(name) and close(places[name][-1]):
                flush()
            continue
        attrs = token["attrs"]
        if name in _ENDS:
            # What is inside is no text of the page. Without an end a script or style goes on to the
            # end of the page; of the others the tag alone is passed over.
            closed = name in unended or name in FOREIGN and attrs.endswith("/")
            ends = None if closed else _ENDS[name].search(source, at)
            if ends:
                at = ends.end()
            elif not closed:
                unended.add(name)
                at = len(source) if name in ("script", "style") else at
            continue
        if places.get("head") and name not in IN_HEAD:
            leave_head()
        if name in _CLOSES_P and stack[-1][4] == "p":
            close(places["p"][-1])
        if name not in VOID:
            _, parent, links, near, near_name, in_content = stack[-1]
            number = len(page.parents)
            mark = _marks(name, attrs, in_content)
            page.parents.append(parent)
            page.marks.append(mark)
            if name in BREAKING:
                near, near_name = number, name
            places.setdefault(name, []).append(len(stack))
            stack.append((name, number, links + (name == "a"), near, near_name, in_content or bool(mark & CONTENT_TAG)))
        if name in BREAKING:
            flush()
    add(source[at:])
    flush()
    return page


def surroundings(page: Page) -> np.ndarray:
    """All marks of the elements around each block.

    A mark against content counts for nothing on an element that holds over half of the page's text
    and all that is marked as content: it is the page's wrapper. Comments are a wrapper only where
    something is marked as content.
    """
    n = len(page.parents)
    size, content, inside = [0] * n, [0] * n, [0] * n
    for e in range(1, n):
        inside[e] = inside[page.parents[e]] | page.marks[e]
    for e, text in zip(page.elements, page.texts, strict=True):
        size[e] += len(text)
        if inside[e] & (CONTENT_TAG | CONTENT_WORD) and not inside[e] & HARD:
            content[e] += len(text)
    for e in range(n - 1, 0, -1):
        size[page.parents[e]] += size[e]
        content[page.parents[e]] += content[e]
    for e in range(1, n):
        mark = page.marks[e]
        if mark & (MARKED | PARTIAL | COMMENTS) and 2 * size[e] > size[0] and content[e] == content[0]:
            mark &= ~(MARKED | PARTIAL | COMMENTS) if content[0] else ~(MARKED | PARTIAL)
        inside[e] = inside[page.parents[e]] | mark
    return np.array(inside, np.int64)[page.elements]


def describe(page: Page) -> np.ndarray:
    """What the classifier sees of each block: its shape, and the marks around it (see FEATURES)."""
    n = len(page.texts)
    rows = np.zeros((n, len(FEATURES)))
    if not n:
        return rows
    words = np.array([t.count(" ") + 1 for t in page.texts])
    rows[:, 0] = 1
    rows[:, 1] = np.minimum(words, 60) / 60
    rows[:, 2] = np.log1p(words) / 6
    rows[:, 3] = page.linked
    rows[:, 4] = [t[-1] in ".!?…:\"'" for t in page.texts]
    rows[:, 5] = [name in ("p", "pre", "blockquote") for name in page.names]
    rows[:, 6] = [name in ("li", "td", "a") for name in page.names]
    rows[:, 7] = [name[:1] == "h" and name[1:].isdigit() for name in page.names]
    marks = surroundings(page)
    for k, mark in enumerate((HARD, MARKED, PARTIAL, COMMENTS, CONTENT_TAG, CONTENT_WORD, HEADER, HIDDEN)):
        rows[:, SHAPE + k] = marks & mark > 0
    # A page without a link or anything that says what it is.
    rows[:, SHAPE + 9] = not any(page.marks) and not any(page.linked)
    rows[:, SHAPE + 8] = (rows[:, SHAPE + 4] == 0) & bool(rows[:, SHAPE + 4].any())
    return rows


def edges_of(page: Page) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of nodes and edges of a page's graph: blocks first, then the elements that hold several branches with text.

    A block hangs on the nearest such element with weight 1, an element on the next one around it
    with a half, and neighbouring blocks on each other with a half. Relabelling all that an element
    holds therefore costs little, relabelling one block in the midst of it costs most.
    """
    n = len(page.texts)
    branches = [0] * len(page.parents)
    for e in page.elements:
        branches[e] += 1
    for e in range(len(page.parents) - 1, 0, -1):
        if branches[e]:
            branches[page.parents[e]] += 1
    node, count = [-1] * len(page.parents), n
    edges: list[tuple[int, int, float]] = []
    for e, held in enumerate(branches):
        above = node[page.parents[e]] if e else -1
        node[e] = above
        if held > 1:
            node[e] = count
            if above >= 0:
                edges.append((count, above, 0.5))
            count += 1
    edges += [(i, node[e], 1.0) for i, e in enumerate(page.elements) if node[e] >= 0]
    edges += [(i, i + 1, 0.5) for i in range(n - 1)]
    return count, edges


def minimum_cut(gain: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels that minimise the cost: True where a node stays with the source.

    A node of positive gain hangs on the source by it, one of negative gain on the sink; edges cost
    their weight where their ends differ. Blocking flows go along the shortest paths, then along
    the next shortest, until none is left; what the source still reaches is content.
    """
    n = len(gain)
    supply = [max(0.0, float(g)) for g in gain]
    drain = [max(0.0, -float(g)) for g in gain]
    arcs: list[list[int]] = [[] for _ in range(n)]
    head: list[int] = []
    room: list[float] = []
    for a, b, w in edges:
        arcs[a].append(len(head))
        arcs[b].append(len(head) + 1)
        head += (b, a)
        room += (w, w)
    least = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i] > least)
        for i in queue:
            level[i] = 0
        nearest = n
        while queue:
            i = queue.popleft()
            if level[i] > nearest:
                break
            if drain[i] > least:
                nearest = level[i]
            for arc in arcs[i]:
                j = head[arc]
                if level[j] < 0 and room[arc] > least:
                    level[j] = level[i] + 1
                    queue.append(j)
        if nearest == n:
            return np.array(level) >= 0
        tried = [0] * n
        for source in range(n):
            if level[source]:
                continue
            path: list[int] = []
            i = source
            while supply[source] > least:
                if drain[i] > least:
                    flow = min(drain[i], supply[source], *(room[arc] for arc in path))
                    drain[i] -= flow
                    supply[source] -= flow
                    for arc in path:
                        room[arc] -= flow
                        room[arc ^ 1] += flow
                    path.clear()
                    i = source
                    continue
                own = arcs[i]
                while tried[i] < len(own):
                    arc = own[tried[i]]
                    if room[arc] > least and level[head[arc]] == level[i] + 1 <= nearest:
                        break
                    tried[i] += 1
                if tried[i] < len(own):
                    path.append(arc)
                    i = head[arc]
                elif path:
                    i = head[path.pop() ^ 1]
                    tried[i] += 1
                else:
                    break


@dataclass(frozen=True)
class Model:
    """Weights of the block classifier and the strength of edges against them."""

    weights: np.ndarray
    smoothness: float

    def gain(self, page: Page) -> np.ndarray:
        """Cost of calling a block boilerplate less that of calling it content: the classifier's log odds."""
        return np.clip(describe(page) @ self.weights, -LIMIT, LIMIT)


def label(page: Page, model: Model) -> np.ndarray:
    """Which blocks are content."""
    count, edges = edges_of(page)
    gain = np.concatenate((model.gain(page), np.zeros(count - len(page.texts))))
    return minimum_cut(gain, [(a, b, w * model.smoothness) for a, b, w in edges])[: len(page.texts)]


def main_text(source: str, model: Model) -> str:
    page = parse(source)
    if not page.texts:
        return ""
    return " ".join(t for t, keep in zip(page.texts, label(page, model), strict=True) if keep)


def labelled_pages(n: int, seed: int = 3, marked: bool = True) -> Iterator[tuple[str, frozenset[str]]]:
    """``n`` pages made by rule, each with the texts of its content blocks.

    A few are their article alone.
    A page has an article of headings, paragraphs, lists and inner boxes, and around and inside it
    some of: menu, header, advert, sidebar, comments, notice, form and footer. Each part carries
    its HTML element, a class that names it, a class that misleads or none; with ``marked`` false
    only elements and classes without a meaning occur.
    """
    rng = np.random.default_rng(seed)
    syllables = ("an", "ba", "ce", "do", "el", "fi", "gu", "ha", "in", "ka", "lo", "mu", "ne", "or", "pi", "ra", "se", "to", "un", "ve")

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def chance(p: float) -> bool:
        return rng.random() < p

    def prose(low: int, high: int, end: str = "") -> str:
        words = ["".join(pick(*syllables) for _ in range(int(rng.integers(2, 5)))) for _ in range(int(rng.integers(low, high + 1)))]
        return " ".join(words).capitalize() + end

    def box(inner: str, element: str, *classes: str) -> str:
        """An element or a div with a class that says what it is, or neither."""
        if not marked or chance(0.25):
            return f'<div class="{prose(1, 1).lower()}">{inner}</div>' if chance(0.5) else f"<div>{inner}</div>"
        if element and chance(0.5):
            return f"<{element}>{inner}</{element}>"
        return f'<{pick("div", "section")} {pick("class", "id")}="{pick(*classes)}">{inner}</{"div"}>'.replace("<section", "<div")

    def links(low: int, high: int) -> str:
        rows = "".join(f"<li><a href=x>{prose(1, 3)}</a></li>" for _ in range(int(rng.integers(low, high + 1))))
        return f"<ul>{rows}</ul>" if chance(0.7) else rows.replace("<li>", "<span>").replace("</li>", "</span> ")

    for _ in range(n):
        content: set[str] = set()

        def own(text: str) -> str:
            content.add(text)
            return text

        def comments() -> str:
            said = "".join(pick("<p>%s</p>", "<div>%s</div>", '<article class="comment"><p>%s</p></article>' if marked else "<p>%s</p>") % prose(4, 30, ".") for _ in range(int(rng.integers(1, 9))))
            kind = pick("comments", "comment-list", "disqus_comments", "replies", "post-comments")
            return f'<section class="{kind}"><h3>{prose(1, 2)}</h3>{said}</section>'

        def inner() -> str:
            kind = int(rng.integers(12 if marked else 8))
            if kind < 4:
                text = own(prose(8, 70, pick(".", ".", "!", "?")))
                words = text.split(" ")
                if chance(0.3) and len(words) > 12:
                    words[3] = f"<a href=y>{words[3]}</a>"
                return f"<p>{' '.join(words)}</p>"
            if kind == 4:
                return f"<p>{own(prose(1, 6, pick('', '.')))}</p>"
            if kind == 5:
                return f"<h2>{own(prose(1, 6))}</h2><p>{own(prose(12, 50, '.'))}</p>"
            if kind == 6:
                return "<ul>" + "".join(f"<li>{own(prose(2, 14))}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>"
            if kind == 7:
                return f"<blockquote>{own(prose(8, 40, '.'))}</blockquote>"
            if kind == 8:
                about = pick("related-work", "share-price", "tags-of-war", "search-history", "banner-year", "cookie-recipe", "menu-week", "social-studies", "widget-factory")
                return f'<div class="{about}"><h2>{own(prose(1, 4))}</h2><p>{own(prose(10, 50, "."))}</p></div>'
            if kind == 9:
                return f'<div class="{pick("ad", "advert", "ads-box", "promo", "sponsored")}">{pick("%s", "<p>%s</p>") % prose(2, 14, pick("", ".", "!"))}</div>'
            if kind == 10:
                return f'<div class="{pick("share", "share-buttons", "social-links", "related", "related-posts", "tags", "newsletter-box")}">{pick(links(2, 5), f"<p>{prose(3, 12, pick(str(), chr(46)))}</p>")}</div>'
            return f"<{(e := pick('aside', 'form', 'nav', 'footer'))}>{pick(links(1, 4), f'<p>{prose(3, 20, chr(46))}</p>')}</{e}>"

        if marked and chance(0.08):  # a page that is its article, without a word of markup about it
            only = [own(prose(8, 60, ".")) for _ in range(int(rng.integers(1, 4)))]
            yield pick("%s", "<html><body>%s</body></html>", "<p>%s</p>", "<noscript><p>%s</p></noscript>", "<object><p>%s</p></object>") % pick("</p><p>", "<p>").join(only), frozenset(content)
            continue
        head = f"<h1>{own(prose(3, 9))}</h1>"
        if chance(0.3):
            head = f"<header>{head}<p>{own(prose(2, 8))}</p></header>" if marked else head
        if marked and chance(0.2):  # a short article
            parts = [head if chance(0.5) else "", *(f"<p>{own(prose(1, 10, pick('', '.')))}</p>" for _ in range(int(rng.integers(1, 4))))]
            content &= {t for part in parts for t in content if t in part}
        else:
            parts = [head, *(f"<p>{own(prose(12, 60, '.'))}</p>" for _ in range(2)), *(inner() for _ in range(int(rng.integers(1, 12))))]
        if marked and chance(0.15):
            parts.append(comments())
        article = box("".join(parts), pick("article", "main"), "content", "post-body", "entry-content", "story", "article-text")
        before, after = [], []
        if chance(0.8):
            before.append(box(links(3, 10), "nav", "menu", "nav", "site-menu", "navigation", "navbar"))
        if chance(0.4):
            before.append(box(f"<h2>{prose(1, 3)}</h2><p>{prose(2, 6)}</p>", "header", "header", "site-header", "masthead", "banner"))
        if chance(0.5):
            pick(before, after).append(box(pick("%s", "<p>%s</p>") % prose(3, 12, pick("", ".")), "aside" if marked else "", "ad", "ads", "advertisement", "promo-box"))
        if chance(0.4):
            pick(before, after).append(box(f"<h3>{prose(1, 2)}</h3>{links(2, 8)}" + (f"<p>{prose(10, 30, '.')}</p>" if marked and chance(0.5) else ""), "aside", "sidebar", "sidebar-right", "widget", "related-posts"))
        if chance(0.3):
            pick(before, after).append(f'<div id="{pick("cookie-notice", "gdpr-consent", "notice", "cookies")}"><p>{prose(5, 25, ".")}</p></div>' if marked else f"<div>{prose(2, 5)} <a href=z>{prose(1, 2)}</a></div>")
        if marked and chance(0.35):
            after.append(comments())
        if chance(0.3):
            after.append(box(f"<label>{prose(1, 2)}</label>", "form", "search", "subscribe", "newsletter"))
        if chance(0.8):
            after.append(box(f"&copy; {prose(1, 4, pick('', '.'))}" + (links(1, 4) if chance(0.5) else ""), "footer", "footer", "site-footer", "copyright"))
        if marked and chance(0.3):  # what is not shown: a dialog or a notice around the article
            unseen = pick("<div hidden>%s</div>", '<div style="display: none">%s</div>', '<div aria-hidden="true">%s</div>', "<template>%s</template>")
            pick(before, after).append(unseen % f"<h2>{prose(1, 3)}</h2><p>{prose(4, 25, '.')}</p>")
        body = "".join(before) + article + "".join(after)
        if marked and chance(0.3):
            body = f'<div class="{pick("has-sidebar", "menu-open", "search-page", "with-comments", "no-banner", "sidebar-left", "page")}">{body}</div>'
        yield f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>", frozenset(content)


def logistic(x: np.ndarray, y: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on rows with their numbers, with a small penalty on large ones."""
    weights = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (many * (p - y)) + PENALTY * weights
        bend = (x * (many * p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(weights))
        weights = weights - np.linalg.solve(bend, slope)
    return weights


@functools.cache
def _generated() -> tuple[list[tuple[Page, np.ndarray]], list[tuple[Page, np.ndarray]]]:
    """Pages with block labels: those to fit the classifier on, and those to choose the smoothness on."""
    made = [*labelled_pages(GENERATED_PAGES // 2), *labelled_pages(GENERATED_PAGES // 2, 4, marked=False)]
    parsed = [(p, np.array([t in content for t in p.texts])) for p, content in ((parse(source), content) for source, content in made)]
    return parsed[::2], parsed[1::2]


def train(more: np.ndarray | None = None) -> Model:
    """Fits the classifier on generated pages, and on rows of ``more`` if given: features, label, number.

    Those rows count half as much as the generated ones. The smoothness is the one of SMOOTHNESS
    whose cuts get most of the held-back generated pages' text right.
    """
    first, second = _generated()
    x, y = np.concatenate([describe(p) for p, _ in first]), np.concatenate([c for _, c in first]).astype(float)
    many = np.full(len(y), 1 / len(y))
    if more is not None and len(more) and 0 < more[:, -2].mean() < 1:
        own = more[:, -1] * np.where(more[:, -2] > 0, 0.5 / more[more[:, -2] > 0, -1].sum(), 0.5 / more[more[:, -2] == 0, -1].sum())
        x, y, many = np.concatenate((x, more[:, :-2])), np.concatenate((y, more[:, -2])), np.concatenate((many, 0.5 * own))
    weights = logistic(x, y, many)

    def wrong(smoothness: float) -> float:
        model = Model(weights, smoothness)
        return sum(float(np.dot(label(p, model) != c, [len(t) for t in p.texts])) for p, c in second)

    return Model(weights, min(SMOOTHNESS, key=wrong))


def fit(pages: DataFrame, most: int = TRAINING_PAGES) -> Model:
    """The model of ``train``, with blocks of about ``most`` pages of the table, drawn by a hash of the id.

    Of these pages, blocks inside article or main are examples of content, and blocks inside other
    elements with a meaning (nav, footer, aside ...) of the rest. Their own marks are blanked out:
    they teach what text of either kind looks like where nothing marks it.
    """
    share = most / max(1, pages.count())
    draw = F.pmod(F.xxhash64("page_id", "url", F.lit(13)), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in K.fill(batch.column(0)).to_pylist():
                rows = describe(parse(source))
                against = rows[:, [SHAPE, SHAPE + 1, SHAPE + 6]].any(1)
                known = against | (rows[:, SHAPE + 4] > 0) & ~rows[:, SHAPE + 2 : SHAPE + 4].any(1)
                rows[:, SHAPE:] = 0
                made = np.column_stack((rows, ~against))[known]
                if len(made):
                    yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.list_(pa.float64()))], ["x"])

    # Rows alike are summed on the executors: few shapes come back, whatever the number of blocks.
    made = K.map_batches(pages.where(draw < share).select("html"), examples, "x array<double>")
    got = made.select(F.transform("x", lambda c: F.round(c, 2)).alias("x")).groupBy("x").count().toArrow()
    if not got.num_rows:
        return train()
    order = np.array(sorted([*x, n] for x, n in zip(got.column("x").to_pylist(), got.column("count").to_pylist(), strict=True)))
    return train(order)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of the main text of every page, from its whole html.

    The text is that of the blocks on the content side of a minimum cut, in page order, joined by
    one space. A block's terminal capacities are the costs of a classifier that sees its shape and
    the elements and classes around it; blocks hang on their elements, elements on those around
    them, and neighbours on each other. Null or empty html, and pages without content, give an
    empty text. Repeated rows give a row each; an empty table gives no rows; other columns are not
    read. Time and memory grow with a page's length, and each page is one task's work.
    """
    pages = pages.select("page_id", "url", "html")
    learned = fit(pages) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source, learned) for source in K.fill(batch.column(2)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return K.map_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, url string, text string, n_chars long")
