"""Main text of HTML pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A logistic classifier tells from a block's own text and layout (links,
length, punctuation, element, place on the page) how likely it is content. What is written around it in so many
words (a menu or an article element, a class name such as comments) is no input of the classifier: it labels the
blocks that the classifier is fitted on, and is evidence that is added to its log odds. The sums are the capacities to the
two terminals. Blocks that follow each other and blocks under the same parent are tied by smoothness edges, and the
maximum flow separates content from boilerplate. Blocks whose own cost outweighs all their ties keep their side in any
minimum cut and are settled first; the flow runs over what is left.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athletrack.llm.base import distinct_sample, sliced

SAMPLE = 300
NEXT, SIBLING = 0.2, 1.2  # smoothness of blocks in sequence, and under one parent

# fixed values: elements of the HTML standard, by what they mean here
RAW = frozenset("script style noscript template textarea select svg math iframe object canvas audio video title head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
TO_THE_END = frozenset("script style title textarea".split())  # what hides the rest of the page if it is not closed
THROUGH = frozenset("address div p".split())  # what a list item closes together with the item before it
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_CELLS = ("td", "th")
_ROWS = ("caption", "thead", "tbody", "tfoot", "tr", *_CELLS)
CELLS = {"td": _CELLS, "th": _CELLS, "tr": ("tr", *_CELLS), "caption": _ROWS, "thead": _ROWS, "tbody": _ROWS, "tfoot": _ROWS}  # closed in the same table
#: end tags that don't reach beyond these
STOPS = {"li": ("ul", "ol", "menu", "dir", "table"), "dt": ("dl", "table"), "dd": ("dl", "table"), "p": ("table",)} | {name: ("table",) for name in CELLS}
LEAVES = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6".split())  # elements of one block: its parent is what holds them
GOOD_TAGS = frozenset(("article", "main"))
BAD_TAGS = frozenset("nav footer aside header form menu dialog button label fieldset".split())
# fixed values: words in the names of containers
GOOD_NAMES = frozenset("article content main post story entry body text".split())
FOREIGN_NAMES = re.compile(r"comments?|repl(?:y|ies)|discussions?|ads?|advert\w*|sponsor\w*|cookies?|sidebar|breadcrumbs?|menu|nav|navbar|navigation|footer|masthead|newsletter|subscribe|signup|login|pagination|pager|copyright")
DOUBTFUL_NAMES = frozenset("banner promo consent notice popup modal widget header share social related recommended form legal".split())
#: what they add to the log odds, a container each
GOOD, BAD, GOOD_NAME, FOREIGN_NAME, DOUBTFUL_NAME = 1.0, -3.0, 0.5, -5.0, -1.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|([^<]+|<)", re.S
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!-)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "features", "parent", "sure", "evidence")

    def __init__(self, text: str, features: list[float], parent: int, sure: int, evidence: float):
        self.text, self.features, self.parent, self.sure, self.evidence = text, features, parent, sure, evidence


def _with_place(found: list[Block]) -> list[Block]:
    """Adds what the page tells of a block: how far it is from the middle, and whether it is repeated."""
    same = Counter(b.text for b in found)
    for k, b in enumerate(found):
        b.features += [abs(2 * (k + 0.5) / len(found) - 1), float(same[b.text] > 1)]
    return found


def blocks(html: str | None) -> list[Block]:
    """Blocks in page order. ``sure`` is 1 in an article or main element, 0 in a menu, footer, advert, ..., else -1."""
    html = html or ""
    out: list[Block] = []
    # open containers: tag, number, good containers, bad containers, what their names add
    stack: list[tuple[str, int, int, int, float]] = [("", 0, 0, 0, 0.0)]
    places: dict[str, list[int]] = {name: [] for name in BLOCK}  # where each tag is open
    nearest = [0]  # for each open container, the nearest one that isn't in THROUGH
    unclosed: set[str] = set()  # tags without an end tag in the rest of the page
    parts: list[str] = []
    linked = numbers = in_link = 0
    tag = ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                _, _, good, bad, named = stack[-1]
                parent = stack[-2 if stack[-1][0] in LEAVES else -1][1]
                size = len(text)
                features = [
                    1.0, min(1.0, linked / size), min(size, 400) / 400, float(size < 25), float(text[-1] in ".!?:;\"'”»…"), min(1.0, 20 * sum(map(text.count, ".,;")) / size),
                    float(tag[:1] == "h" and tag[1:].isdigit()), float(tag == "li"), float(tag == "p"), float("©" in text or "all rights reserved" in text.lower()),
                ]
                out.append(Block(text, features, parent, 0 if bad or named <= FOREIGN_NAME else 1 if good else -1, GOOD * (good > 0) + BAD * bad + named))
        linked = 0

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop()[0]].pop()
            nearest.pop()

    def innermost(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places[n]), default=0)

    def ending(name: str, pattern: str) -> re.Match | None:
        end = None if name in unclosed else re.compile(pattern, re.I).search(html, at)
        if not end:
            unclosed.add(name)
        return end

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.match(html, at)
        at = m.end()
        closing, name, attributes, text = m.groups()
        if text is not None:
            parts.append(text)
            if in_link:
                linked += len(text)
            continue
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                end = ending(name, f"</{re.escape(name)}(?=[\\s/>])[^>]*>")
                if end:
                    at = end.end()
                elif name in TO_THE_END:
                    at = size
            if name not in ("head", "title", "script", "style"):
                parts.append(" ")
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in BLOCK:
            if name in BAD_TAGS and not closing:  # a button or label
                flush()
                end = ending(name, f"</{re.escape(name)}\\s*>")
                at = end.end() if end else at
            continue
        flush()
        if not closing and stack[-1][0] == "p" and name not in ("option", "optgroup"):
            close(len(stack) - 1)
        if name in VOID:
            continue
        if not closing:
            if name in ITEMS:
                if stack[nearest[-1]][0] in ITEMS[name]:
                    close(nearest[-1])
            elif name in CELLS:
                table = innermost(("table",))
                if before := [places[n][-1] for n in CELLS[name] if places[n] and places[n][-1] > table]:
                    close(min(before))
            elif name == "option" and stack[-1][0] == name:
                close(len(stack) - 1)
            in_link = 0
            tag = name
            numbers += 1
            _, _, good, bad, named = stack[-1]
            if attributes and name not in ("html", "body") and (got := _NAMED.findall(attributes)):
                got = _WORDS.findall(" ".join(got).lower())
                if any(FOREIGN_NAMES.fullmatch(w) for w in got):
                    named += FOREIGN_NAME
                elif any(w in DOUBTFUL_NAMES for w in got):
                    named += DOUBTFUL_NAME
                elif any(w in GOOD_NAMES for w in got):
                    named += GOOD_NAME
            if attributes and _HIDDEN.search(attributes):
                bad += 1
            places[name].append(len(stack))
            nearest.append(nearest[-1] if name in THROUGH else len(stack))
            # a header or footer of an article belongs to it
            stack.append((name, numbers, good + (name in GOOD_TAGS), bad + (name in BAD_TAGS and not (name in ("header", "footer") and good)), named))
        else:
            if places[name] and places[name][-1] > innermost(STOPS.get(name, ())):
                close(places[name][-1])
            tag = stack[-1][0]
    flush()
    return _with_place(out)


#: what the weights are before any page is seen: bias, links, length, short, end of sentence, punctuation, heading, list
#: item, paragraph, copyright, distance from the middle, repeated
PRIOR = np.array([-1.6, -3.0, 1.5, -0.5, 0.8, 0.5, 0.4, -0.3, 0.8, -2.5, -0.4, -1.0])


def fit(pages: list[str], rounds: int = 300, pull: float = 0.01) -> np.ndarray:
    """Logistic weights from the blocks whose elements leave no doubt, held near ``PRIOR``. Both sides weigh the same."""
    found = [b for html in pages for b in blocks(html) if b.sure >= 0]
    if not found:
        return PRIOR
    x, y = np.array([b.features for b in found]), np.array([b.sure for b in found], float)
    share = 0.5 / np.maximum(1, np.where(y > 0, y.sum(), len(y) - y.sum()))
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= x.T @ ((p - y) * share) + pull * (w - PRIOR)
    return w


def cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The minimum cut: node i pays ``costs[i]`` if positive and not content, and minus that if negative and content.

    Edges (i, j, c) cost c where their ends differ. Undecided nodes (no cost either way) become boilerplate.
    """
    n = len(costs)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, c in edges:
        near[i].append((j, c))
        near[j].append((i, c))
    costs, settled, left = list(costs), [None] * n, [sum(c for _, c in x) for x in near]
    todo = deque(range(n))
    while todo:  # own cost above all ties: settled, and the ties become costs of the neighbours
        i = todo.popleft()
        if settled[i] is None and abs(costs[i]) > left[i]:
            settled[i] = costs[i] > 0
            for j, c in near[i]:
                if settled[j] is None:
                    costs[j] += c if settled[i] else -c
                    left[j] -= c
                    todo.append(j)
    open_nodes = [i for i in range(n) if settled[i] is None]
    if not open_nodes:
        return settled
    # residual capacities; n is the source (content), n + 1 the sink
    residual: dict[int, dict[int, float]] = {i: {} for i in (*open_nodes, n, n + 1)}
    for i in open_nodes:
        a, b = (n, i) if costs[i] > 0 else (i, n + 1)
        residual[a][b], residual[b][a] = abs(costs[i]), 0.0
        for j, c in near[i]:
            if settled[j] is None:
                residual[i][j] = residual[i].get(j, 0.0) + c
    while True:
        back = {n: n}
        todo = deque([n])
        while todo and n + 1 not in back:
            i = todo.popleft()
            for j, c in residual[i].items():
                if c > 1e-9 and j not in back:
                    back[j] = i
                    todo.append(j)
        if n + 1 not in back:
            break
        path, j = [], n + 1
        while j != n:
            path.append((back[j], j))
            j = back[j]
        flow = min(residual[i][j] for i, j in path)
        for i, j in path:
            residual[i][j] -= flow
            residual[j][i] += flow
    for i in open_nodes:
        settled[i] = i in back
    return settled


def labelled(html: str | None, weights: list[float]) -> tuple[list[Block], list[float], list[bool]]:
    """Blocks of a page, their costs, and whether they are content by the minimum cut."""
    found = blocks(html)
    costs = [sum(map(float.__mul__, weights, b.features), b.evidence) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return found, costs, cut(costs, edges)


def main_text(html: str | None, weights: list[float]) -> str:
    found, _, content = labelled(html, weights)
    return "\n\n".join(b.text for b, keep in zip(found, content) if keep)


def train(pages: DataFrame, limit: int = SAMPLE) -> list[float]:
    """Fitted on at most ``limit`` distinct pages, chosen by the hash of the html."""
    rows = pages.select(F.col("html").cast("string").alias("html")).where("html is not null")
    return fit([r["html"] for r in distinct_sample(rows, "html", limit).collect()]).tolist()


def extract(pages: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """(page_id, url, text) for every row.

    Null and empty pages, and pages without a content block, have an empty text. Repeated rows each give a row, null
    ids and urls stay null, other columns are not read.
    """
    weights = weights or train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = pa.array([main_text(h, weights) for h in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
