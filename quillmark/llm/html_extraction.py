"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags, and its block-level elements form a tree. Blocks
and elements are the nodes of a graph:

* A linear classifier gives every block a cost from what it is made of: share of linked text, length,
  closing punctuation, kind of its own tag, neighbours' lengths, copyright sign and share of calls to the reader (`WEIGHTS`, fitted by `fit_costs`).
  Elements have the log odds of their tag, role and names, and of standing beside a marked article.
  A cost is the capacity of the node's terminal edge, to content if positive, to boilerplate if negative.
* Smoothness edges join a block to its element, an element to its parent, and blocks that follow each
  other, the less the farther apart they are in the tree. An element that is itself marked as
  something else than its surroundings is joined weakly; inside an article the others are joined firmly.

Of several marked articles the one with the most prose counts as marked (`_decided`), so that teasers and
comments that are articles, too, go by their own costs.

The minimum cut, by Dinic's maximum flow, separates content from boilerplate. Before it, nodes that
settle themselves are taken out and bare elements are contracted; both leave the cut's cost as it is.

Content blocks are decoded, white space becomes one space, and they are joined in page order by one
space. Null, empty and text-less pages give an empty text; repeated rows give theirs each, and extra
columns are left out. Pages go whole; time grows with a page's length, not with its depth.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.texts import map_rows

#: A quote opens a value only right after "="; one that never closes is a character like any other.
_INSIDE = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*){_INSIDE}(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements whose text is never shown as prose.
DROPPED = frozenset("script style noscript template iframe object svg canvas head title select option button textarea datalist audio video".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas stand inside a line.
INLINE |= frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd mspace mpadded mphantom menclose mmultiscripts mprescripts semantics annotation".split())
#: Elements that an opening tag of the key closes while they are innermost.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

# Costs of elements: log odds of content.
STRONG = 6.0
#: An article that is marked as such, isn't inside boilerplate and has the most prose is content, whatever stands in it.
SEED = 1e6
#: Of the prose of the page's longest article a sibling needs this share to be content as well.
RIVAL = 0.5
TAG_COSTS = {"article": SEED, "main": 4.0, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0, "header": -6.0, "address": -1.0}
ROLE_COSTS = {"article": SEED, "main": 4.0} | dict.fromkeys("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split(), -6.0)
#: Names that mean boilerplate wherever they stand in a name, and those that do at its end only ("share-box", not "share-prices").
BOILERPLATE = frozenset("advert adverts advertisement advertisements advertising sponsored cookie cookies gdpr navbar navigation breadcrumb breadcrumbs sidebar footer masthead comments disqus related recommended recommendations newsletter subscribe subscription signup login popup modal pagination pager".split())
BOILERPLATE_LAST = frozenset("ad ads sponsor sponsors promo promos promotion banner consent notice notices alert alerts notification notifications nav menu menus header comment reply replies respond share sharing social overlay widget widgets toolbar skip disclaimer copyright discussion".split())
#: Names that paragraphs of an article have, too, with the cost that leaves the verdict to the paragraph itself.
AMBIGUOUS, DOUBT = frozenset("comment reply respond share sharing social notice".split()), -3.0
PARAGRAPHS = frozenset("p blockquote pre".split())
CONTENT_LAST = frozenset("article content main post entry story text body".split())
#: What a name says besides its meaning.
FILLERS = frozenset("area bar block box button buttons col column container group holder icons inner inline item items left link links list main mobile outer panel right row section slot text top unit wrap wrapper".split())
NOT_ITS_OWN = frozenset("has with no without".split())

#: Least cost of an element that marks the article, and what others lose beside it.
FRAME, BESIDE = 4.0, 2.0
ROOTS = frozenset(["", "html", "body"])

# Smoothness.
FIRM, JOINED, LOOSE, ROOT, ADJACENT = 12.0, 3.0, 1.0, 0.25, 1.0

FEATURES = ("bias", "linked", "length", "closed", "heading", "paragraph", "item", "beside", "copyright", "calls")
#: Log odds of content by feature, as `fit_costs` finds them on pages whose article is known, rounded.
WEIGHTS = (-2.72, -2.53, 1.26, 0.87, 1.6, 1.01, -1.66, 2.36, -2.73, -2.42)
#: Fixed: words that call a reader to do something, or tell terms, in the languages of the given tables.
CALLS = frozenset("newsletter subscribe subscription sign signup login register cookie cookies inbox advertisement sponsored abonnieren anmelden registrieren werbung anzeige abonner inscrivez connexion publicité suscríbete suscribirse regístrate publicidad".split())
#: A block with a call in so many words, or fewer, has the whole feature.
WORDS_A_CALL = 5
#: No block outweighs the edge to its element alone.
MOST_COST = 2.5


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    element: int
    #: Steps in the tree from the block before.
    apart: int


@dataclass(slots=True)
class Page:
    """Block-level elements in page order (tag, parent, cost; the root is number 0), and the blocks of text."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    cost: list[float] = field(default_factory=lambda: [0.0])
    #: The nearest element around that is marked by its cost, itself included; 0 if none is.
    mark: list[int] = field(default_factory=lambda: [0])
    blocks: list[Block] = field(default_factory=list)


def _name_cost(token: str, tag: str = "", above: float = 0.0) -> float:
    """Log odds of content of one name; paragraphs inside an article are only doubted where their name says little."""
    words = _NAME.findall(_HUMP.sub("-", token).lower())
    if not words or words[0] in NOT_ITS_OWN:
        return 0.0
    if not BOILERPLATE.isdisjoint(words):
        return -STRONG
    while len(words) > 1 and words[-1] in FILLERS and not words[-1] == "main":
        words.pop()
    if words[-1] in BOILERPLATE_LAST:
        if above >= FRAME and tag in PARAGRAPHS and words[-1] in AMBIGUOUS:
            return DOUBT
        return 0.0 if words[-1] == "header" and not CONTENT_LAST.isdisjoint(words) else -STRONG
    return 3.0 if words[-1] in CONTENT_LAST else 0.0


def _element_cost(tag: str, attributes: str, above: float) -> float:
    """Log odds of content of an element whose nearest marked element around has the cost `above`."""
    costs = [TAG_COSTS.get(tag, 0.0)]
    if tag == "header" and above > 0:
        costs = [0.0]
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            if tag not in ("html", "body"):
                costs += (_name_cost(x, tag, above) for x in value.split())
        elif key == "role":
            costs += (ROLE_COSTS.get(x, 0.0) for x in value.lower().split())
        elif key == "itemprop":
            costs += [4.0] if value.lower() == "articlebody" else []
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.lower().replace(" ", ""):
            costs.append(-STRONG)
    least, most = min(costs), max(costs)
    # a mark of boilerplate outdoes one of content, also one further out
    return least if least <= -STRONG or above < 0 or not most else most


def parse(page: str) -> Page:
    """The page's elements and blocks."""
    out = Page()
    stack: list[tuple[str, int]] = []  # (tag, its element, or for an inline one that around it)
    opened: Counter = Counter()
    parts: list[str] = []
    linked = dropped = low = before = deep = 0  # deep: block-level elements around; low: the least since the last block
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked, low, before
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.blocks.append(Block(text, linked, stack[-1][1] if stack else 0, before + deep - 2 * low))
                low = before = deep
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not dropped:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if opened["a"]:
                linked += len(text)

    def pop(k: int) -> None:
        nonlocal dropped, deep, low
        for tag, _ in stack[k:]:
            dropped -= tag in DROPPED
            opened[tag] -= 1
            deep -= tag not in INLINE
        low = min(low, deep)
        del stack[k:]

    while at < end:
        found = _TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        if found[1]:
            tag = found[1].lower()
            if tag not in INLINE:
                flush()
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag and (tag not in INLINE or stack[k][0] in INLINE):
                    k -= 1
                if stack[k][0] == tag:
                    pop(k)
        elif found[2]:
            if not found[4]:
                break  # the page ends inside a tag
            tag, attributes = found[2].lower(), found[3]
            if tag not in INLINE:
                flush()
                closes = CLOSES.get(tag, {"p"} if tag not in VOID else frozenset())
                while True:
                    k = len(stack)
                    while k and stack[k - 1][0] in INLINE:
                        k -= 1
                    if not k or stack[k - 1][0] not in closes:
                        break
                    pop(k - 1)
            if tag in VOID or attributes.rstrip().endswith("/") and tag in DROPPED | INLINE:
                if tag == "img" and parts:
                    parts.append(" ")
                continue
            around = stack[-1][1] if stack else 0
            if tag in INLINE:
                stack.append((tag, around))
            else:
                mark = out.mark[around]
                cost = _element_cost(tag, attributes, out.cost[mark])
                stack.append((tag, len(out.tag)))
                out.mark.append(len(out.tag) if abs(cost) >= JOINED else mark)
                out.tag.append(tag)
                out.parent.append(around)
                out.cost.append(cost)
                deep += 1
            opened[tag] += 1
            dropped += tag in DROPPED
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                pop(len(stack) - 1)
                at = page.find(">", close.start()) + 1 if close else 0
                if not at:
                    break
    flush()
    return _decided(out)


def _decided(page: Page) -> Page:
    """Of several marked articles only the one with the most prose stays marked, with siblings that have nearly as much.

    Prose is text outside links. Articles inside boilerplate stand back behind others, and behind other prose of the page where that is
    more. Those that lose (teasers, comments) count like any element; so do articles in articles.
    """
    marked = [e for e, c in enumerate(page.cost) if c >= SEED]
    if not marked:
        return page
    outer = [0] * len(page.tag)  # the outermost marked article around each element
    for e in range(1, len(page.tag)):
        outer[e] = outer[page.parent[e]] or (e if page.cost[e] >= SEED else 0)
    prose: Counter = Counter()
    for b in page.blocks:
        mark = page.cost[page.mark[b.element]]
        if mark > 0 or mark == 0 == outer[b.element]:
            prose[outer[b.element]] += len(b.text) - b.linked
    first = [e for e in marked if outer[e] == e]
    free = [e for e in first if page.cost[page.mark[page.parent[e]]] >= 0] or [e for e in first if prose[e] > prose[0]]
    best = max(free, key=lambda e: (prose[e], -e), default=0)  # the first of equals
    stay = {e for e in free if e == best or page.parent[e] == page.parent[best] and prose[e] >= RIVAL * prose[best]}
    lost = set(marked) - stay
    for e in lost:
        page.cost[e] = 0.0
    for e in range(1, len(page.tag)):
        if page.mark[e] in lost:
            page.mark[e] = page.mark[page.parent[e]]
    return page


def features(page: Page) -> np.ndarray:
    """One row of FEATURES for each block."""
    n = len(page.blocks)
    out = np.zeros((n, len(FEATURES)))
    long = [math.log1p(len(b.text)) / 5 for b in page.blocks]
    for i, b in enumerate(page.blocks):
        tag = page.tag[b.element]
        heading, paragraph, item = re.fullmatch("h[1-6]", tag) is not None, tag in ("p", "blockquote", "pre"), tag in ("li", "dt", "dd", "td", "th")
        beside = long[max(i - 1, 0)] + long[min(i + 1, n - 1)]
        words = b.text.lower().split()
        calls = min(1.0, WORDS_A_CALL * sum(w.strip(".,:;!?()") in CALLS for w in words) / max(len(words), 1))
        out[i] = 1.0, b.linked / len(b.text), long[i], b.text[-1] in ".!?…:;\"”'»)", heading, paragraph, item, beside / 2, "©" in b.text, calls
    return out


def fit_costs(pages: list[Page], content: list[list[bool]], penalty: float = 100.0, rounds: int = 20) -> np.ndarray:
    """WEIGHTS by penalised logistic regression over blocks whose label is known: Newton's method, pages and labels in one list each."""
    x, y = np.concatenate([features(p) for p in pages]), np.concatenate([np.array(c, float) for c in content])
    w, hold = np.zeros(x.shape[1]), np.diag([penalty] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (p - y) + penalty * w)
    return w


def block_costs(page: Page, weights=WEIGHTS) -> list[float]:
    """Log odds of content of each block on its own: the classifier's verdict before any cut."""
    if len(page.tag) == 1:  # no element, nothing to part
        return [MOST_COST] * len(page.blocks)
    return np.clip(features(page) @ np.array(weights), -MOST_COST, MOST_COST).tolist() if page.blocks else []


def element_costs(page: Page) -> list[float]:
    """Log odds of content of each element; where the page marks an article, those neither in nor around it lose.

    Where a page has blocks under marks of content, an element under a mark of boilerplate loses what its blocks can bring at most,
    so that many of them together don't outweigh the mark.
    """
    out, around = list(page.cost), set()
    for e, c in enumerate(page.cost):
        if c >= FRAME:
            while e not in around:
                around.add(e)
                e = page.parent[e] if e else 0
    if around:
        for e in range(len(out)):
            if page.tag[e] in ROOTS:
                out[e] -= STRONG
            elif e not in around and page.mark[e] == 0:
                out[e] -= BESIDE
    marks = [page.cost[page.mark[b.element]] for b in page.blocks]
    if any(c > 0 for c in marks):
        for b, c in zip(page.blocks, marks, strict=True):
            if c <= -STRONG:
                out[b.element] -= MOST_COST
    return out


def graph(page: Page) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Costs of all nodes, blocks first and elements after them, and the smoothness of their edges."""
    n, smooth = len(page.blocks), {}
    firm = {e for e, c in enumerate(page.cost) if c >= SEED}
    for e in range(1, len(page.tag)):
        p = page.parent[e]
        around = page.mark[p]
        if page.tag[p] in ROOTS:
            w = ROOT
        elif page.mark[e] == e:
            w = LOOSE
        else:
            w = FIRM if around in firm else JOINED if around else LOOSE
        smooth[n + p, n + e] = w
    for i, b in enumerate(page.blocks):
        smooth[i, n + b.element] = FIRM if page.mark[b.element] in firm else JOINED
        if i:
            smooth[i - 1, i] = ADJACENT / (1 + b.apart)
    return [*block_costs(page), *element_costs(page)], smooth


def minimum_cut(score: list[float], smooth: dict[tuple[int, int], float], labelled: int | None = None) -> list[bool]:
    """True for nodes on the content side of a minimum cut, for the first `labelled` nodes. Ties go to boilerplate."""
    n = len(score)
    labelled = n if labelled is None else labelled
    cost = [round(s * 1000) for s in score]
    near: list[dict[int, int] | None] = [{} for _ in range(n)]
    for (a, b), w in smooth.items():
        w = round(w * 1000)
        if w:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        own = near[i]
        if label[i] is not None or own is None:
            continue
        if abs(cost[i]) > sum(own.values()):  # a settled node passes its edges on as terminal costs
            label[i] = cost[i] > 0
            for k, w in own.items():
                cost[k] += w if label[i] else -w
                del near[k][i]
                todo.append(k)
            near[i] = {}
        elif i >= labelled and not cost[i] and len(own) <= 2:  # a bare element between two nodes is one edge, a bare leaf none
            ends = list(own)
            for k in ends:
                del near[k][i]
                todo.append(k)
            if len(ends) == 2:
                (a, b), w = ends, min(own.values())
                near[a][b] = near[a].get(b, 0) + w
                near[b][a] = near[b].get(a, 0) + w
            near[i] = None
    rest = [i for i in range(n) if label[i] is None and near[i] is not None]
    if any(cost[i] > 0 for i in rest):
        content = _flow_side(rest, cost, near)
        for i in rest:
            label[i] = i in content
    return [bool(x) for x in label[:labelled]]


def _flow_side(rest: list[int], cost: list[int], near: list[dict[int, int]]) -> set[int]:
    """Dinic's maximum flow; returns what the source still reaches."""
    source, sink = -1, -2
    left: dict[int, dict[int, int]] = {i: {} for i in [*rest, source, sink]}
    for i in rest:
        for k, w in near[i].items():
            left[i][k] = w
        a, b = (source, i) if cost[i] > 0 else (i, sink)
        left[a][b], left[b][a] = abs(cost[i]), 0
    while True:
        depth, todo = {source: 0}, deque([source])
        while todo:
            i = todo.popleft()
            for k, w in left[i].items():
                if w and k not in depth:
                    depth[k] = depth[i] + 1
                    todo.append(k)
        if sink not in depth:
            return set(depth) - {source}
        tried = {i: list(left[i]) for i in depth}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(left[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    left[a][b] -= flow
                    left[b][a] += flow
                path = path[: next(k for k in range(len(path) - 1) if not left[path[k]][path[k + 1]]) + 1]
                continue
            while tried[i] and not (left[i][tried[i][-1]] and depth.get(tried[i][-1]) == depth[i] + 1):
                tried[i].pop()
            if tried[i]:
                path.append(tried[i][-1])
            else:
                path.pop()
                if path:
                    tried[path[-1]].pop()


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    own = parse(page)
    kept = minimum_cut(*graph(own), len(own.blocks))
    return " ".join(b.text for b, k in zip(own.blocks, kept, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """Returns page_id, url, text and n_chars of every row of `pages`."""

    def rows(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(x) for x in texts]}

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), rows, "page_id long, url string, text string, n_chars long")
