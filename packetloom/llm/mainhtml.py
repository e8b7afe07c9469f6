"""The main text of a web page by a minimum cut.

A page is cut into blocks of text at block-level markup. A classifier gives each block the cost of calling it content and the cost of
calling it boilerplate; they are the capacities of its edges to the two terminals. Neighbouring blocks, and consecutive blocks of one
container, are tied by smoothness edges whose capacity falls with their distance in the tree. The cheapest labelling is a minimum
cut, found by maximum flow in one small graph per page. Pages are independent: one pass, no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from packetloom.llm import textbytes

_TOKEN = re.compile(
    r"(?P<text>[^<]+)|<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Content that is not text of the page.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
_DROPPED = {"select", "button", "svg", "math", "canvas", "object", "audio", "video", "datalist", "map", "dialog", "menu"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "search",
}
#: Markup that says what it holds, in log-odds of content.
_TAGS = {"nav": -9.0, "footer": -9.0, "aside": -8.0, "form": -8.0, "header": -7.0, "search": -9.0, "fieldset": -5.0, "article": 5.0, "main": 4.0}
_BAD_NAMES = {
    "ad": -9.0, "ads": -9.0, "advert": -9.0, "adverts": -9.0, "advertisement": -9.0, "advertising": -9.0, "sponsor": -8.0, "sponsored": -8.0, "promo": -8.0,
    "promotion": -8.0, "banner": -7.0, "nav": -8.0, "navbar": -8.0, "navigation": -8.0, "menu": -8.0, "breadcrumb": -8.0, "breadcrumbs": -8.0,
    "sidebar": -8.0, "aside": -7.0, "widget": -7.0, "footer": -8.0, "header": -6.0, "masthead": -7.0, "cookie": -9.0, "cookies": -9.0, "consent": -9.0,
    "gdpr": -9.0, "notice": -8.0, "notification": -8.0, "popup": -8.0, "modal": -8.0, "overlay": -7.0, "newsletter": -8.0, "subscribe": -8.0,
    "subscription": -8.0, "signup": -8.0, "login": -8.0, "share": -7.0, "sharing": -7.0, "social": -7.0, "related": -7.0, "recommended": -7.0,
    "recommendations": -7.0, "trending": -7.0, "popular": -7.0, "comment": -9.0, "comments": -9.0, "disqus": -9.0, "reply": -8.0, "replies": -8.0,
    "respond": -8.0, "discussion": -7.0, "pagination": -8.0, "pager": -8.0, "toolbar": -7.0, "copyright": -8.0, "legal": -7.0, "disclaimer": -7.0,
    "search": -8.0, "skip": -7.0, "tags": -6.0, "byline": -3.0, "teaser": -5.0, "alert": -6.0, "hidden": -7.0,
}
_GOOD_NAMES = {"article": 4.0, "content": 2.5, "main": 2.5, "post": 2.0, "entry": 2.5, "story": 3.0, "body": 1.5, "text": 1.5, "prose": 3.0}
_ROLES = {
    "navigation": -9.0, "banner": -7.0, "contentinfo": -9.0, "complementary": -8.0, "search": -9.0, "form": -8.0, "alert": -7.0, "dialog": -8.0,
    "menu": -8.0, "menubar": -8.0, "main": 4.0, "article": 4.0,
}
#: Capacity between blocks side by side, and how it falls with each step of their distance in the tree.
SMOOTHNESS = 3.0
DECAY = 0.55
_UNIT = 1000
#: Steps beyond which the capacity rounds to 0.
FAR = math.ceil(math.log(0.5 / (SMOOTHNESS * _UNIT)) / math.log(DECAY))


#: Words that turn a name after them into a statement about layout, as in has-sidebar, and words that do so behind it, as in comments-open.
_LAYOUT_BEFORE = {"has", "no", "with", "without", "not", "is"}
_LAYOUT_AFTER = {"open", "closed", "enabled", "disabled", "left", "right", "none", "on", "off"}
#: What runs to the end of a page without any further ">".
_TO_THE_END = re.compile(r"<[!?]|</[a-zA-Z]")


@dataclass
class Block:
    text: str
    node: int
    hint: float
    tag: str
    linked: int


@dataclass
class Tree:
    """Containers by number; a parent comes before its children."""

    parent: list[int]
    tag: list[str]
    attrs: list[str]


def _name_hints(value: str) -> list[float]:
    """Hints of the words of a class or id; words that only describe the layout give none."""
    found = []
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and (words[0] in _LAYOUT_BEFORE or words[-1] in _LAYOUT_AFTER and len(words) > 1):
            continue
        found += [_BAD_NAMES.get(w, 0.0) or _GOOD_NAMES.get(w, 0.0) for w in words]
    return found


def _hint(tag: str, attrs: str, trusted: bool) -> float:
    """What a container's markup says about its content; the strongest hint counts.

    A container that is not ``trusted`` holds most of the page: its names, and that it is a form, say nothing against all that text.
    """
    found = [_TAGS.get(tag, 0.0) if trusted or tag not in ("form", "fieldset") else 0.0]
    for name, *values in _ATTRIBUTE.findall(attrs):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name in ("class", "id"):
            found += [h for h in _name_hints(value) if trusted or h > 0]
        elif name == "role":
            found.append(_ROLES.get(value.lower(), 0.0))
        elif name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            found.append(-9.0)
    low = min(found)
    return low if low < 0 else max(found)


def _hints(tree: Tree, found: list[Block]) -> list[float]:
    """The sum of hints from the root down to each container.

    Of a container with half of the page's text or more, names count against it only if it is no page or form as a whole, has no good
    name beside, and holds no article, main or top heading.
    """
    n = len(tree.parent)
    size = [0] * n
    holds = [tag in ("article", "main", "h1") for tag in tree.tag]
    for block in found:
        size[block.node] += len(block.text)
    for node in range(n - 1, 0, -1):
        size[tree.parent[node]] += size[node]
        holds[tree.parent[node]] |= holds[node]
    total = [0.0] * n
    for node in range(1, n):
        tag, attrs, above = tree.tag[node], tree.attrs[node], total[tree.parent[node]]
        if tag in ("header", "hgroup") and above >= 4:
            # A header inside an article holds its title.
            total[node] = above
        elif not attrs and tag not in _TAGS:
            total[node] = above
        else:
            major = 2 * size[node] >= size[0] > 0
            good = any(_GOOD_NAMES.get(w.lower()) for a, *v in _ATTRIBUTE.findall(attrs) if a.lower() in ("class", "id") for w in _WORD.findall(" ".join(v)))
            total[node] = above + _hint(tag, attrs, not (major and (tag in ("html", "body", "form", "fieldset") or holds[node] or good)))
    return total


def parsed(page: str) -> tuple[Tree, list[Block]]:
    """The containers and the blocks of text of a page, in its order, without hints; time in proportion to the page.

    Unclosed and stray tags are repaired as far as block-level markup needs it.
    """
    out: list[Block] = []
    tree = Tree([0], [""], [""])
    # (tag, number, text is dropped)
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0
    last = page.rfind(">")
    in_link = False
    at, end = 0, len(page)
    lower = None

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, stack[-1][1], 0.0, stack[-1][0], linked))
        parts.clear()
        linked = 0

    def leave(depth: int) -> None:
        opened.subtract(s[0] for s in stack[depth:])
        del stack[depth:]

    while at < end:
        if at > last:
            # No tag can end any more: the rest is text, up to what runs to the end.
            rest = _TO_THE_END.search(page, at)
            text = page[at : rest.start() if rest else end]
            if not stack[-1][2]:
                parts.append(text)
                linked += len(text) * in_link
            break
        token = _TOKEN.match(page, at)
        at = token.end()
        kind = token.lastgroup
        if kind == "text" or kind == "cdata":
            if not stack[-1][2]:
                text = token.group(kind)
                parts.append(text)
                if in_link:
                    linked += len(text)
        elif kind == "close":
            tag = token.group("close").lower()
            if tag == "a":
                in_link = False
            elif tag in _BLOCK or tag in _DROPPED:
                if opened[tag]:
                    flush()
                    leave(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
                elif tag == "p":
                    flush()
        elif token.group("open"):
            tag = token.group("open").lower()
            attrs = token.group("attrs")
            if tag in _RAW:
                # Everything up to the closing tag belongs to the element.
                if not attrs.endswith("/"):
                    lower = page.lower() if lower is None else lower
                    close = lower.find(f"</{tag}", at)
                    at = end if close < 0 else close
            elif tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = True
            elif tag in _BLOCK or tag in _DROPPED:
                flush()
                if tag == "body":
                    leave(1)
                in_link = in_link and tag not in ("li", "nav", "article")
                if stack[-1][0] == "p" or tag == stack[-1][0] and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                    leave(len(stack) - 1)
                if tag not in _VOID and not attrs.endswith("/"):
                    stack.append((tag, len(tree.tag), stack[-1][2] or tag in _DROPPED or "hidden" in attrs.split()))
                    opened[tag] += 1
                    tree.parent.append(stack[-2][1])
                    tree.tag.append(tag)
                    tree.attrs.append(attrs)
        elif token.group() == "<":
            if not stack[-1][2]:
                parts.append("<")
    flush()
    return tree, out


def cost(block: Block, position: float) -> float:
    """The classifier's log-odds that a block is content: hints of its containers, its length, links, punctuation and place."""
    n = len(block.text)
    score = block.hint - 1.0
    score += min(n / 80, 3.0)
    score -= 4.0 * block.linked / n if n else 0.0
    if block.text[-1] in ".!?…:;\"”»" and n > 30:
        score += 0.8
    if block.tag in ("h1", "h2", "h3"):
        score += 1.2
    if block.tag == "p":
        score += 1.0
    if block.text.startswith(("©", "Copyright")):
        score -= 5.0
    return score - 0.5 * (position > 0.95)


def _distance(parent: list[int], a: int, b: int) -> int:
    """Steps from one container to the other through the tree, or more than ``FAR``, from where on a tie weighs nothing."""
    steps = 0
    while a != b and steps <= FAR:
        # A parent has a smaller number than its children.
        a, b = (parent[a], b) if a > b else (a, parent[b])
        steps += 1
    return steps


def minimum_cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """True for the blocks on the source's side of a minimum cut. Scores above 0 are capacities from the source, below 0 to the sink."""
    n = len(scores)
    source, sink = n, n + 1
    edges: list[list[int]] = []
    graph: list[list[int]] = [[] for _ in range(n + 2)]

    def connect(a: int, b: int, ahead: float, back: float) -> None:
        graph[a].append(len(edges))
        edges.append([b, round(ahead * _UNIT)])
        graph[b].append(len(edges))
        edges.append([a, round(back * _UNIT)])

    for i, s in enumerate(scores):
        if s > 0:
            connect(source, i, s, 0)
        elif s < 0:
            connect(i, sink, -s, 0)
    for a, b, capacity in ties:
        connect(a, b, capacity, capacity)
    while True:
        # Levels by breadth, then blocking flow by depth.
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            here = queue.popleft()
            for e in graph[here]:
                to, room = edges[e]
                if room > 0 and level[to] < 0:
                    level[to] = level[here] + 1
                    queue.append(to)
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        here = source
        while True:
            if here == sink:
                flow = min(edges[e][1] for e in path)
                for e in path:
                    edges[e][1] -= flow
                    edges[e ^ 1][1] += flow
                back = next(i for i, e in enumerate(path) if edges[e][1] == 0)
                here = edges[path[back] ^ 1][0]
                del path[back:]
                continue
            mine = graph[here]
            while turn[here] < len(mine):
                to, room = edges[mine[turn[here]]]
                if room > 0 and level[to] == level[here] + 1:
                    break
                turn[here] += 1
            else:
                if here == source:
                    break
                level[here] = -1
                here = edges[path.pop() ^ 1][0]
                turn[here] += 1
                continue
            path.append(mine[turn[here]])
            here = edges[path[-1]][0]


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by line ends."""
    tree, found = parsed(page or "")
    if not found:
        return ""
    hints = _hints(tree, found)
    for block in found:
        block.hint = hints[block.node]
    scores = [cost(b, i / len(found)) for i, b in enumerate(found)]
    ties = []
    before: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            ties.append((i - 1, i, SMOOTHNESS * DECAY ** _distance(tree.parent, found[i - 1].node, block.node)))
        # The block before in the same container, when others stand between.
        container = tree.parent[block.node] if block.node else -1
        last = before.get(container)
        if last is not None and last < i - 1:
            ties.append((last, i, SMOOTHNESS * DECAY ** _distance(tree.parent, found[last].node, block.node)))
        before[container] = i
    kept = minimum_cut(scores, ties)
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def with_main_text(pages: DataFrame, source: str = "html", keep: list[str] | None = None, text: str = "text", length: str = "n_chars") -> DataFrame:
    """All columns (or those in ``keep``) with ``text`` and ``n_chars``, its code points.

    Null, empty and text-free pages give an empty text. Pages are read whole; truncated markup is read as far as it goes. Rows are
    independent, so repeated rows get equal texts; an empty table stays empty; input columns named like a result are replaced.
    """
    textbytes.bounded_batches(pages.sparkSession)
    carried = [c for c in (pages.columns if keep is None else keep) if c not in (text, length)]
    rows = pages.select(F.col(f"`{source}`").cast("string").alias("_html"), F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, offsets in textbytes.slices(batch.column(0)):
                n = len(offsets) - 1
                texts = [main_text(page) for page in batch.column(0).slice(row, n).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(row, n), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["_row", "_text", "_length"]
                )

    schema = StructType([rows.schema["_row"], StructField("_text", StringType()), StructField("_length", LongType())])
    made = rows.mapInArrow(extract, schema)
    return made.select(*[F.col(f"_row.`{c}`") for c in carried], F.col("_text").alias(text), F.col("_length").alias(length))


def op8_minimum_cut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return with_main_text(pages, keep=["page_id", "url"])
