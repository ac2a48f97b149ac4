"""Main text of web pages by a minimum cut.

A page is a row of text blocks, each with the tags and class names around it. A logistic classifier gives every block a cost for each
label (content or boilerplate); these costs are the capacities to the two terminals. Blocks that stand next to each other and blocks
with the same parent are joined by smoothness edges. The minimum cut separates content from boilerplate; the text is the content blocks in
page order. The classifier is fitted here: on pages with an ``article`` or ``main`` element, whose blocks label themselves, with
the structural features hidden in a second copy so that the words' own features are learned as well. Its weights are drawn to fixed
ones (``PRIOR``), which it equals when no page can teach it.

Scripts, styles, templates, the head, comments and markup are never text; formulas are text, but for their hidden annotations. NULL and empty
pages give an empty text, pages without tags are one block. Broken markup (open paragraphs, cut ends) is read to the end: only a script,
style, title or text field that is never closed takes the rest of the page; of other elements without text the start tag alone is skipped. A quote
opens a value only behind ``=``. A ``header`` element is left out wherever it stands, with the title of an article that it may hold. Class names
that only touch on a topic ("related-work", "tag-news") do not make boilerplate, and what an element is wholly called ("post") counts for more
than a part of another name. Equal costs go to boilerplate. Pages are read whole, very long ones too; rows are independent, repeated
rows are handled each for itself, an empty table gives no rows, other columns pass through whatever their names.
"""
from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import smallest

TRAINING_PAGES, TRAINING_BLOCKS = 300, 20_000
NEXT, SIBLING = 0.6, 0.5
#: How elements and class names of the web's common layouts read.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
                   "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts "
                   "mprescripts none maction mtable mtr mlabeledtr mtd semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "textarea", "iframe", "head", "title", "object", "canvas", "annotation", "annotation-xml", "select", "button")
#: Those that a browser reads to the end of the page when they are not closed.
TO_THE_END = frozenset("script style textarea title".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog header".split())
CONTENT_TAGS = frozenset("article main".split())
#: Words of a class name or id that stand for boilerplate wherever they are in it ...
BOILER_WORD = (r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|nav\w*|menu\w*|footer|header|cookies?|consent|gdpr|comments?|respond|repl(?:y|ies)|disqus|"
               r"newsletter|subscribe|signup|sign-?in|log-?in|breadcrumbs?|pagination|pager|popup|modal|widget\w*|toolbar|copyright|skip\w*|author-?box|toc)")
#: ... and those that do only as the whole name or beside a word of layout ("related-posts", but not "related-work" or "tag-news").
TOPIC_WORD = r"(?:notice\w*|share|social|related|recommend\w*|search\w*|legal|tags?)"
LAYOUT_WORD = (r"(?:list\w*|links?|box|bar|cloud|posts?|articles?|stor(?:y|ies)|entr(?:y|ies)|items?|blocks?|sections?|buttons?|btns?|icons?|form|area|wrap\w*|container|panel|module|rows?|group|"
               r"this|it|reading|content|text|pages?|products?|videos?|tools?|counts?|media|line|meta|terms|inner|outer|top|bottom|left|right|info|message|grid|feed|carousel|strip|"
               r"input|results?|field|label|title|heading|holder|region|zone|slot|view|column|col|follow|us)")
BOILER_NAMES = re.compile(rf"(?:^|[\s_-]){BOILER_WORD}(?=$|[\s_-])|(?:^|\s){TOPIC_WORD}(?=$|\s)|(?:^|[\s_-])(?:{TOPIC_WORD}[_-]+{LAYOUT_WORD}|{LAYOUT_WORD}[_-]+{TOPIC_WORD})(?=$|[\s_-])"
                          rf"|(?:^|[\s_-]){TOPIC_WORD}[_-]+{TOPIC_WORD}(?=$|[\s_-])", re.I)
#: Whole names; what an element is wholly called counts for more than a part of another of its names.
BOILER_WHOLE = re.compile(rf"(?:^|\s)(?:{BOILER_WORD}|{TOPIC_WORD})(?=$|\s)", re.I)
CONTENT_WHOLE = re.compile(r"(?:^|\s)(?:h-?entry|(?:blog-?|news-?)?(?:article|post|entry|story)(?:[_-]?(?:body|content|text))?|body-?text|content|main)(?=$|\s)", re.I)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|story|body-?text|content|main|text)(?:$|[\s_-])", re.I)
BOILER_ROLES = re.compile(r"navigation|banner|contentinfo|complementary|search|form|dialog|alert", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"'=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)(?:>|\Z)|<", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ROLE = re.compile(r"(?:^|\s)role\s*=\s*[\"']?([\w-]+)", re.I)
CLOSES_P = frozenset("p div ul ol li table section article aside nav footer header main form h1 h2 h3 h4 h5 h6 blockquote pre hr dl fieldset figure".split())
WORDY = re.compile(r"[.!?;:,…。！？]")
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|respond|repl(?:y|ies)|disqus)(?:$|[\s_-])", re.I)


@dataclass
class Block:
    text: str
    parent: int
    boiler: bool
    content: bool
    comment: bool
    tag: str
    linked: int


def _closings(page: str, tag: str) -> dict[int, int]:
    """Place behind the end tag of each element ``tag`` that has one, by the place of its start tag; a start tag within belongs to an element within."""
    found: dict[int, int] = {}
    begun: list[int] = []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*>", page, re.I):
        if not m[1]:
            if not m[0].endswith("/>"):
                begun.append(m.start())
        elif begun:
            found[begun.pop()] = m.end()
    return found


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order; white space inside a block is one space."""
    page = page or ""
    # open elements: (tag, number, boilerplate around, content around, reader comments around)
    stack: list[tuple] = [("", 0, False, False, False)]
    found: list[Block] = []
    text: list[str] = []
    linked, links, number, at, end = 0, 0, 0, 0, len(page)
    closings: dict[str, dict[int, int]] = {}

    def close() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                top = next((x for x in reversed(stack) if x[0] not in INLINE), stack[0])
                found.append(Block(joined, top[1], top[2], top[3], top[4], top[0], min(linked, len(joined))))
            text.clear()
        linked = 0

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text.append(page[at:])
            linked += (end - at) * (links > 0)
            break
        if m.start() > at:
            text.append(page[at:m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0] == "<":
                text.append("&lt;")
            continue
        if m[1]:
            if tag in INLINE:
                links -= tag == "a" and links > 0
                continue
            close()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            if tag in TO_THE_END or tag == "head":
                if tag == "title" or not m[0].endswith("/>"):
                    stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                    if stop:
                        at = stop.end()
                    elif tag == "head":      # an unclosed head ends where the body begins
                        body = re.compile(r"<body\b", re.I).search(page, at)
                        at = body.start() if body else at
                    else:
                        at = end
            elif not m[0].endswith("/>"):
                if tag not in closings:
                    closings[tag] = _closings(page, tag)
                at = closings[tag].get(m.start(), at)
            if tag not in ("button", "select", "svg", "annotation", "annotation-xml"):
                close()
            continue
        if tag in INLINE:
            links += tag == "a"
            if tag in VOID:
                text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        close()
        links = 0
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li":
            stack.pop()
        _, _, boiler, content, comment = stack[-1]
        names = " ".join(x or y or z for x, y, z in NAMES.findall(m[3])) if m[3] else ""
        role = ROLE.search(m[3]) if m[3] else None
        parts = bool(names) and (BOILER_WHOLE.search(names) is not None or CONTENT_WHOLE.search(names) is None)
        remark = parts and bool(COMMENT_NAMES.search(names))
        named = parts and tag not in CONTENT_TAGS and tag not in ("body", "html") and bool(BOILER_NAMES.search(names))
        own = tag in BOILER_TAGS or named or bool(role and BOILER_ROLES.search(role[1]))
        number += 1
        comment = comment or remark
        nested = tag == "article" and comment
        stack.append((tag, number, boiler or own or remark or nested, content or tag in CONTENT_TAGS or bool(names and not own and CONTENT_NAMES.search(names)), comment))
    close()
    return found


FEATURES = ("one", "boiler", "content", "comment", "link_share", "length", "marks", "item", "heading", "any_content", "in_content_page")
#: Mean of the weights before any page is seen.
PRIOR = np.array([0.6, -6.0, 3.0, -4.0, -2.5, 0.5, 0.8, -0.5, 0.2, 0.0, -3.0])
STRUCTURE = [FEATURES.index(x) for x in ("boiler", "content", "comment", "any_content", "in_content_page")]


def features(page: list[Block]) -> np.ndarray:
    any_content = any(b.content and not b.boiler for b in page)
    rows = []
    for b in page:
        n = len(b.text)
        rows.append((1.0, b.boiler, b.content and not b.boiler, b.comment, b.linked / n, math.log(n / 40), min(1.0, 20 * len(WORDY.findall(b.text)) / n),
                     b.tag in ("li", "td", "th", "dt", "dd", "option"), b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), any_content, any_content and not b.content))
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


def fit(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic regression with weights drawn to PRIOR, by Newton's method. Each block is seen twice, once without its structure."""
    w = PRIOR.copy()
    if not len(y) or not 0 < y.sum() < len(y):
        return w
    plain = x.copy()
    plain[:, STRUCTURE] = 0
    x, y = np.concatenate([x, plain]), np.concatenate([y, y])
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) * min(1000.0 / len(y), 1.0)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + strength * (w - PRIOR)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        w = w - np.linalg.solve(curve, gradient)
    return w


def _saturate(flow: dict[int, dict[int, float]], source: int, sink: int) -> dict[int, int]:
    """Raises the flow to its maximum in the residual capacities ``flow``, all shortest paths of one length at a time; the nodes that the source
    still reaches."""
    while True:
        level, line = {source: 0}, [source]
        for i in line:
            for j, c in flow[i].items():
                if c > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    line.append(j)
        if sink not in level:
            return level
        arcs, tried, path = {i: list(flow[i]) for i in line}, dict.fromkeys(line, 0), [source]
        while path:
            i = path[-1]
            if i == sink:
                steps = list(zip(path, path[1:]))
                least = min(flow[a][b] for a, b in steps)
                for a, b in steps:
                    flow[a][b] -= least
                    flow[b][a] = flow[b].get(a, 0.0) + least
                del path[1 + next(k for k, (a, b) in enumerate(steps) if flow[a][b] <= 1e-9):]
                continue
            while tried[i] < len(arcs[i]):
                j = arcs[i][tried[i]]
                if flow[i][j] > 1e-9 and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
                tried[i] += 1
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1


def minimum_cut(to_content: np.ndarray, to_boiler: np.ndarray, edges: dict[tuple[int, int], float]) -> np.ndarray:
    """True for the blocks on the content side of the minimum cut; ties go to boilerplate. ``to_content[i]`` is paid when block i is cut off
    from content.

    A block whose terminals differ by more than its edges hold together keeps its label in every minimum cut, so such blocks are
    taken out first, their edges turned into terminal capacity; blocking flows settle the rest."""
    n = len(to_content)
    gain = (to_content - to_boiler).tolist()
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    label: list[bool | None] = [None] * n
    queue = list(range(n))
    while queue:
        i = queue.pop()
        if label[i] is not None:
            continue
        if abs(gain[i]) > sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, c in near[i].items():
                gain[j] += c if label[i] else -c
                del near[j][i]
                queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source, sink = n, n + 1
        flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
        flow[source], flow[sink] = {}, {}
        for i in rest:
            if gain[i] > 0:
                flow[source][i] = gain[i]
                flow[i][source] = 0.0
            else:
                flow[i][sink] = -gain[i]
                flow[sink][i] = 0.0
        held = _saturate(flow, source, sink)
        for i in rest:
            label[i] = i in held
    return np.array(label, bool)


def smooth_edges(page: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between neighbours and between following blocks of one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(page):
        if i:
            edges[i - 1, i] = NEXT
        j = last.get(b.parent)
        if j is not None:
            edges[j, i] = edges.get((j, i), 0.0) + SIBLING
        last[b.parent] = i
    return edges


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    if len(found) == 1 and not found[0].boiler and not found[0].linked:
        return found[0].text                 # nothing to tell it from
    value = features(found) @ weights
    kept = minimum_cut(np.logaddexp(0, value), np.logaddexp(0, -value), smooth_edges(found))
    return " ".join(b.text for b, k in zip(found, kept) if k)


def train(pages: DataFrame, page_id: str = "page_id", page: str = "html") -> np.ndarray:
    """Weights from the TRAINING_PAGES pages with the smallest hash of their id; at most TRAINING_BLOCKS blocks come to the driver."""
    some = smallest(pages.select(F.col(page_id).cast("string").alias("id"), F.col(page).alias("page")), F.xxhash64("id"), TRAINING_PAGES, "id")

    def labelled(batches):
        for batch in batches:
            rows = []
            for text in batch["page"]:
                found = blocks(text)
                if any(b.content and not b.boiler for b in found):
                    rows += [(x.tolist(), float(b.content and not b.boiler)) for x, b in zip(features(found), found) if b.boiler or b.content]
            yield pd.DataFrame(rows, columns=["x", "y"])

    rows = some.mapInPandas(labelled, "x array<double>, y double").limit(TRAINING_BLOCKS).collect()
    if not rows:
        return PRIOR.copy()
    return fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]))


def extract(pages: DataFrame, weights: np.ndarray | None = None, page_id: str = "page_id", page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each. No shuffle; the model is eleven numbers."""
    weights = train(pages, page_id, page) if weights is None else weights

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return column.map(lambda p: main_text(p, weights))

    return pages.withColumn(out, text_of(F.coalesce(F.col(page), F.lit(""))))
