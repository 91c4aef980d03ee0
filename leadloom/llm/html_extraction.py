"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text with their places in the element tree. A
logistic classifier, fitted on labelled blocks, gives each block the cost of
calling it boilerplate or content; these are its capacities to the two terminals.
What it sees of a block: its length, marks, share of link text and kind, those of
its neighbours, and the evidence of the elements around it (an article, a menu, a
name such as ``sidebar``). Smoothness edges join blocks that follow one another and
those of one parent, the more weakly the farther apart they lie in the tree. The
maximum flow is the minimum cut: what stays on the source's side is the text.

Pages are independent: one map over the rows, no shuffle, memory for one page, and
reading a page takes time in proportion to it at any depth of nesting.

Defined cases: null or empty html, or a page without text, gives the empty text;
unclosed, stray or crossed tags are closed as browsers close them: only script,
style and other elements of plain text run to the end of a page; of a button or
list of options only its own words are left out; hidden elements count like any
other; repeated rows and ties give a row each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import fresh, small_batches, table

# Element classes of HTML.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes".split())
#: Their own text is no part of the page's; a block inside or behind ends them where they are unclosed.
SKIPPED = set("button datalist noscript optgroup option select template".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"},
    "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
SCOPES = set("table ul ol dl menu body html article main div section".split())
BOUNDARY_TAGS = set("nav aside footer header form menu dialog fieldset search".split())
BOUNDARY_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BOUNDARY_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|header|"
    r"login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|promos?|promoted|related|repl(?:y|ies)|"
    r"respond|share|sharing|sidebar|signup|social|sponsor(?:s|ed)?|subscribe|toolbar|widget)(?:$|[\s_-])"
)
CONTENT_WORDS = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|main|post|story|text)(?:$|[\s_-])")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SENTENCE = re.compile(r"[.!?…:;,]")


#: What the classifier sees of a block, see `features`.
FEATURES = (
    "bias chars marks links heading item long_before long_after links_before links_after in_article in_content in_boundary in_named_boundary"
).split()


@dataclass
class Weights:
    """The classifier's weights by feature, in the unit of log odds, and the smoothness."""

    of: dict[str, float]
    follows: float = 2.0
    siblings: float = 1.2
    bounded: float = 0.25  # what a boundary between two blocks leaves of their edge


#: As `fit` finds them on the labelled pages of tests/llm/labelled_pages.py.
WEIGHTS = Weights(
    {
        "bias": 1.19, "chars": -0.37, "marks": 0.63, "links": -4.56, "heading": 1.87, "item": 2.4,
        "long_before": -0.43, "long_after": 0.15, "links_before": -2.72, "links_after": -5.4,
        "in_article": 4.39, "in_content": 4.04, "in_boundary": -4.76, "in_named_boundary": -6.42,
    }
)
#: Blocks that `fit` takes at most, and steps through the tree beyond which blocks count as far apart.
FIT_BLOCKS, FAR = 50_000, 6


class Element:
    """An open element, and what holds of everything inside it."""

    __slots__ = ("tag", "parent", "depth", "boundary", "named", "article", "content", "skipped", "block", "number")

    def __init__(self, tag: str, parent: Element | None, number: int):
        self.tag, self.parent, self.number = tag, parent, number
        self.depth = parent.depth + 1 if parent else 0
        self.boundary, self.named, self.article, self.content, self.skipped = (
            (parent.boundary, parent.named, parent.article, parent.content, parent.skipped) if parent else (False,) * 5
        )
        self.block = self if parent is None or tag in BLOCKS else parent.block


@dataclass
class Block:
    parts: list[str]
    place: Element
    link_chars: int = 0
    text: str = ""


def _attributes(source: str) -> dict[str, str]:
    if "=" not in source and not source.strip(" /\t\r\n"):
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(source)}


def _element(tag: str, source: str, around: Element, number: int) -> Element:
    made = Element(tag, around, number)
    found = _attributes(source)
    if tag in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articleBody":
        made.article = True
    inside = tag == "header" and around.article  # the head of the article itself
    if (tag in BOUNDARY_TAGS and not inside) or found.get("role") in BOUNDARY_ROLES:
        made.boundary = True
    names = f"{found.get('class', '')} {found.get('id', '')}".lower() if found else ""
    if names.strip() and tag not in ("body", "html", "article", "main"):
        content = bool(CONTENT_WORDS.search(names))
        made.content |= content
        made.named |= bool(BOUNDARY_WORDS.search(names)) and not content
    made.skipped |= tag in SKIPPED
    return made


def blocks_of(page: str) -> list[Block]:
    """The blocks of text in page order."""
    stack, blocks, made = [Element("html", None, 0)], [], 0
    opened: Counter[str] = Counter()
    now: Block | None = None
    at = 0

    def add(text: str) -> None:
        nonlocal now
        if not text or stack[-1].skipped:
            return
        if now is None:
            if text.isspace():
                return
            now = Block([], stack[-1].block)
            blocks.append(now)
        now.parts.append(text)
        if opened["a"]:
            now.link_chars += len(text.strip())

    def pop() -> Element:
        nonlocal now
        gone = stack.pop()
        opened[gone.tag] -= 1
        if gone.tag in BLOCKS:
            now = None
        return gone

    while (token := TOKEN.search(page, at)) is not None:
        add(page[at : token.start()])
        at = token.end()
        close, tag, source = token.group(1, 2, 3) if token[2] else token.group(4, 5, 6)
        if tag is None:
            if token[0].startswith("<![CDATA["):
                add(entities.escape(token[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if close:
            if tag in BLOCKS:
                now = None
            if opened[tag] > 0:
                while pop().tag != tag:
                    pass
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag in BLOCKS:
                now = None
            continue
        if tag in RAW:
            if not source.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCKS:
            now = None
            # a block ends an open control, and a paragraph that no other block lies in
            while len(stack) > 1 and (stack[-1].tag in SKIPPED - {"noscript", "template"} or stack[-1].block.tag == "p"):
                pop()
            wanted = CLOSES.get(tag, ())
            if any(opened[x] for x in wanted):
                k = len(stack) - 1
                while k and stack[k].tag not in SCOPES and stack[k].tag not in wanted:
                    k -= 1
                while k and stack[k].tag in wanted:
                    while len(stack) > k:
                        pop()
                    k -= 1
        if tag == "a" and opened["a"]:
            continue
        made += 1
        stack.append(_element(tag, source, stack[-1], made))
        opened[tag] += 1
    add(page[at:])
    for block in blocks:
        block.text = " ".join(entities.unescape("".join(block.parts)).split())
    return [b for b in blocks if b.text]


def features(blocks: list[Block]) -> list[list[float]]:
    """A row for each block, in the order of FEATURES."""
    own = []
    for b in blocks:
        n, place = len(b.text), b.place
        own.append((min(n, 200) / 100, min(4, len(SENTENCE.findall(b.text))) / 2, min(1.0, b.link_chars / n), place))
    found = []
    for i, (chars, marks, links, place) in enumerate(own):
        before, after = own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None
        clear = not (place.boundary or place.named)  # an advert in an article is no article
        found.append(
            [1.0, chars, marks, links, float(place.tag in HEADINGS), float(place.tag in ("li", "dt", "dd"))]
            + [x[0] if x else 0.0 for x in (before, after)]
            + [x[2] if x else 0.0 for x in (before, after)]
            + [float(x) for x in (place.article and clear, place.content and clear, place.boundary, place.named)]
        )
    return found


def fit(labelled: list[tuple[list[Block], list[bool]]], ridge: float = 1.0, rounds: int = 30) -> dict[str, float]:
    """Logistic weights by Newton's method from the labelled blocks of pages (at most
    FIT_BLOCKS). Each block is also taught without the evidence of the elements around it,
    so that the text alone decides where a page gives none."""
    rows, labels = [], []
    for blocks, content in labelled:
        rows += features(blocks)
        labels += content
    x, y = np.array(rows[:FIT_BLOCKS]), np.array(labels[:FIT_BLOCKS], float)
    plain = x.copy()
    plain[:, FEATURES.index("in_article") :] = 0
    x, y = np.concatenate([x, plain]), np.concatenate([y, y])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return {name: round(float(v), 2) for name, v in zip(FEATURES, w, strict=True)}


def log_odds(blocks: list[Block], w: Weights = WEIGHTS) -> list[float]:
    """Log odds that each block is content."""
    weights = [w.of[name] for name in FEATURES]
    return [sum(v * x for v, x in zip(weights, row, strict=True)) for row in features(blocks)]


def distance(a: Element, b: Element) -> int:
    """Steps through the tree from one element to the other, FAR at most."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


class Flow:
    """Maximum flow by shortest levels and blocking paths; the source side of the minimum cut."""

    def __init__(self, nodes: int):
        self.edges: list[list] = []  # to, capacity left
        self.of: list[list[int]] = [[] for _ in range(nodes)]

    def join(self, a: int, b: int, there: float, back: float) -> None:
        self.of[a].append(len(self.edges))
        self.edges.append([b, there])
        self.of[b].append(len(self.edges))
        self.edges.append([a, back])

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.of)
        level[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for k in self.of[a]:
                b, left = self.edges[k]
                if left > 1e-9 and level[b] < 0:
                    level[b] = level[a] + 1
                    todo.append(b)
        return level

    def cut(self, source: int, sink: int) -> list[bool]:
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return [x >= 0 for x in level]
            at = [0] * len(self.of)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    most = min(self.edges[k][1] for k in path)
                    for k in path:
                        self.edges[k][1] -= most
                        self.edges[k ^ 1][1] += most
                    path, a = [], source
                    continue
                while at[a] < len(self.of[a]):
                    k = self.of[a][at[a]]
                    if self.edges[k][1] > 1e-9 and level[self.edges[k][0]] == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] < len(self.of[a]):
                    path.append(k)
                    a = self.edges[k][0]
                elif path:
                    a = self.edges[path.pop() ^ 1][0]
                    at[a] += 1
                else:
                    break


def label(blocks: list[Block], w: Weights = WEIGHTS) -> list[bool]:
    """Which blocks are content."""
    odds = log_odds(blocks, w)
    if not odds or min(odds) > 0 or max(odds) <= 0:
        return [x > 0 for x in odds]
    n = len(blocks)
    flow = Flow(n + 2)
    last_of: dict[int, int] = {}
    for i, (block, x) in enumerate(zip(blocks, odds, strict=True)):
        flow.join(n, i, max(0.0, x), 0.0)
        flow.join(i, n + 1, max(0.0, -x), 0.0)
        place = block.place
        parent = place.parent.number if place.parent else -1
        for j, weight in ((i - 1, w.follows), (last_of.get(parent, -1), w.siblings)):
            if j >= 0:
                other = blocks[j].place
                weight /= 1 + distance(other, place) / 2
                if (other.boundary, other.named) != (place.boundary, place.named):
                    weight *= w.bounded
                flow.join(j, i, weight, weight)
        last_of[parent] = i
    return flow.cut(n, n + 1)[:n]


def main_text(page: str | None, w: Weights = WEIGHTS) -> str:
    """The content blocks of a page, joined by line feeds."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, kept in zip(blocks, label(blocks, w), strict=True) if kept)


def extract(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: Weights = WEIGHTS) -> DataFrame:
    """``keep`` and the main text of every page."""
    small_batches(pages.sparkSession)
    (source,) = fresh([*pages.columns, *keep], "source")
    rows = pages.select(*keep, F.col(html).cast("string").alias(source))

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(x, weights) for x in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], [*keep, "text"])

    return rows.mapInArrow(run, rows.drop(source).schema.add("text", "string"))


def op6_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
