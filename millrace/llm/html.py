"""Main-text extraction by minimum cut.

A page is cut into blocks at its block-level tags. A logistic classifier prices each block: the price of
calling it boilerplate is the capacity from the source, that of calling it content the capacity to the
sink. Neighbouring blocks and blocks of one DOM parent are joined by smoothness edges. The maximum
flow separates content (still reachable from the source) from boilerplate. A price is at most CAP, which the
edges of a block can outweigh, so a heading or a short line goes with the paragraphs around it.

The classifier is fitted on a bounded sample (FIT_PAGES) of the pages themselves: blocks inside an article or
main element are content, unless they stand in a part that is set apart, and all other blocks of such pages are
not. Each of these pages is learned twice, once with the landmarks hidden, so that pages without any are priced by
their texts and tags. HAND is the prior that the weights are drawn to, and stands alone where no page has landmarks.

Blocks whose terminal outweighs all their smoothness edges keep their own label in every minimum cut, so
they are settled first and folded into their neighbours' terminals; the flow runs on the rest.

Defined cases: a null or empty html gives an empty text; html is read whole, however deeply nested; stray tags
are tolerated; an element whose end tag is missing ends with its parent, and of those whose content is
skipped only the tag is (script, style and the like, which by definition run to the end, excepted); a price of 0 with balanced edges
is boilerplate; repeated pages each get a row; ids and urls are only carried; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title", "select", "xmp"}
#: Of these, what runs to the page's end if no end tag follows.
_TO_END = {"script", "style", "textarea", "title", "xmp", "iframe"}
_BLOCK = {
    "html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "pre", "blockquote",
    "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "nav", "header", "footer", "aside", "form", "fieldset", "figure", "figcaption",
    "address", "details", "summary", "dialog", "menu", "center", "hgroup", "search", "button", "legend", "label", "option",
}
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_APART = {"nav", "footer", "aside", "form", "dialog", "menu", "search", "button", "fieldset", "label", "legend"}
_HINT = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|submenu|sidebar|side|aside|footer|foot|masthead|topbar|banner|ad|ads|adv|advert|adverts|advertisement|advertorial|sponsor|sponsored|promo|promotion|"
    r"cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommend|trending|popular|"
    r"comment|comments|disqus|reply|replies|respond|breadcrumb|breadcrumbs|pager|pagination|widget|toolbar|copyright|legal|disclaimer|skip|search|tags|taglist|byline-share|outbrain|taboola)(?:$|[\s_-]|\d)", re.I)  # fmt: skip
_REPLY = re.compile(r"(?:^|[\s_-])(?:comment|comments|reply|replies|respond|disqus|related|recommended|teaser|ad|ads|advert|sponsored|promo)(?:$|[\s_-]|\d)", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?:$|[\s_-])", re.I)

#: Prior weights of the classifier, in the order of features(); positive speaks for content.
HAND = (-0.6, 0.045, 1.2, 2.6, -7.0, -3.0, 0.8, -3.6, 0.8)
PRIOR = 0.2
#: Pages to fit on at most, and of each of them so many blocks, by position from its start, to bound what one page weighs.
FIT_PAGES, PAGE_BLOCKS = 500, 200
BESIDE, SIBLING, BORDER, CAP = 1.5, 1.0, 0.05, 3.0


class Block:
    __slots__ = ("text", "linked", "tag", "parent", "apart", "inside", "good")

    def __init__(self, text, linked, tag, parent, apart, inside, good):
        self.text, self.linked, self.tag, self.parent, self.apart, self.inside, self.good = text, linked, tag, parent, apart, inside, good


def _end(html: str, name: str, at: int) -> tuple[int, int]:
    """Where the content of a skipped element ends, and where the page goes on; (-1, -1) if nowhere.
    A head without an end tag ends where the body begins."""
    found = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)" + (r"|(?=<body[\s>])" if name == "head" else ""), re.I).search(html, at)
    return (found.start(), found.end()) if found else (-1, -1)


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    stack = [("", False, False, False, 0)]  # tag, apart, inside an article, good hint, number
    opened: Counter = Counter()
    count, anchors, text, linked, at, n = 0, 0, [], 0, 0, len(html)
    endless: set[str] = set()  # elements for which no end tag follows any more

    def flush():
        nonlocal linked
        if text:
            t = " ".join("".join(text).split())
            if t:
                tag, apart, inside, good, number = stack[-1]
                holder = stack[-2][4] if tag in ("p", "li", "dd", "dt", "td", "th", "blockquote", "pre") or tag in _HEADS else number
                out.append(Block(t, linked, tag, holder, apart, inside, good))
            text.clear()
        linked = 0

    def say(piece):
        nonlocal linked
        if "&" in piece:
            piece = unescape(piece)
        text.append(piece)
        if anchors:
            linked += len(piece.strip())

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, close = m[2].lower(), bool(m[1])
        if name in _RAW:
            if not close and not m[3].endswith("/") and name not in endless:
                end, on = _end(html, name, at)
                if end >= 0:
                    at = on
                elif name in _TO_END:
                    break
                else:
                    endless.add(name)
            continue
        if name in ("br", "hr", "img"):
            text.append(" ")
            continue
        if name == "a":
            anchors = 0 if close else 1
            continue
        if name not in _BLOCK:
            continue
        flush()
        if close:
            if opened[name]:
                while True:
                    tag = stack.pop()[0]
                    opened[tag] -= 1
                    if tag == name:
                        break
            anchors = 0
            continue
        if stack[-1][0] == "p" or stack[-1][0] in _HEADS or name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name:
            opened[stack.pop()[0]] -= 1
        _, apart, inside, good, _ = stack[-1]
        hint, liked, hidden = False, good, False
        if m[3]:
            for a in _ATTR.finditer(m[3]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id", "role"):
                    # an article with a passing name is still one, unless it is somebody's comment or a teaser
                    hint = hint or name not in ("html", "body", "main") and bool((_REPLY if name == "article" else _HINT).search(value))
                    liked = liked or bool(_GOOD.search(value))
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    hidden = True
        count += 1
        opened[name] += 1
        header = name == "header" and not inside
        stack.append((name, apart or hint or hidden or header or name in _APART, inside or name in ("article", "main"), liked, count))
    flush()
    return out


def features(b: Block, has_article: bool) -> tuple[float, ...]:
    words = b.text.count(" ") + 1
    return (
        1.0,
        min(words, 60),
        float(b.text[-1] in ".!?…:;\"”»"),
        float(b.inside),
        float(b.apart),
        b.linked / len(b.text),
        float(b.tag in ("p", "pre", "blockquote") or b.tag in _HEADS),
        float(has_article and not b.inside),
        float(b.good),
    )


#: The features that tell of landmarks.
LANDMARKS = [3, 7]


def rows(found: list[Block], landmarks: bool = True) -> list[tuple[float, ...]]:
    has_article = any(b.inside and not b.apart for b in found)
    out = [features(b, has_article) for b in found]
    return out if landmarks else [tuple(0.0 if i in LANDMARKS else v for i, v in enumerate(r)) for r in out]


def fit(x: np.ndarray, y: np.ndarray, prior=HAND, pull: float = PRIOR) -> tuple[float, ...]:
    """Logistic regression by Newton's method, with a Gaussian prior around the given weights."""
    centre = np.array(prior)
    w = centre.copy()
    if len(y):
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (p - y) / len(y) + pull / 100 * (w - centre)
            curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + pull / 100 * np.eye(len(w))
            step = np.linalg.solve(curve, slope)
            w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return tuple(w.tolist())


def _examples(batches):
    for b in batches:
        x, y = [], []
        for html in b.column("html").to_pylist():
            found = blocks(html or "")
            if any(f.inside and not f.apart for f in found):
                some = found[:PAGE_BLOCKS]
                labels = [float(f.inside and not f.apart) for f in some]
                x += rows(found)[:PAGE_BLOCKS] + rows(found, landmarks=False)[:PAGE_BLOCKS]
                y += labels + labels
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.float64()), pa.array([list(r) for r in x], pa.list_(pa.float64()))], names=["y", "x"])


def fit_on_pages(pages: DataFrame, most: int = FIT_PAGES) -> tuple[float, ...]:
    """Weights fitted on at most `most` of the given pages; a hash of the html picks them, copies count once."""
    common.small_batches(pages.sparkSession)
    known = pages.filter(F.col("html").isNotNull()).select("html")
    chosen = common.sampled(known, most, "html").dropDuplicates(["order_"]).orderBy("order_").limit(most)
    got = sorted((r.y, tuple(r.x)) for r in chosen.select("html").mapInArrow(_examples, "y double, x array<double>").collect())
    return fit(np.array([x for _, x in got]).reshape(len(got), len(HAND)), np.array([y for y, _ in got]))


def prices(found: list[Block], weights=HAND) -> list[float]:
    return [max(-CAP, min(CAP, sum(w * v for w, v in zip(weights, r)))) for r in rows(found)]


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours and to the one before of the same parent; a border between containers of
    different kinds is no reason to agree."""
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            p = found[i - 1]
            edges.append((i - 1, i, BESIDE if (p.apart, p.inside) == (b.apart, b.inside) else BORDER))
        if b.parent in last and found[last[b.parent]].apart == b.apart:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return edges


def min_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut. terminal: what it costs to part a
    node from the source, less what it costs to part it from the sink. Undirected edges."""
    n = len(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    score, label = list(terminal), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(score[i]) > sum(near[i].values()):
            label[i] = score[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                score[j] += w if label[i] else -w
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source, sink = n, n + 1
        cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
        cap[source], cap[sink] = {}, {}
        for i in rest:
            cap[source][i], cap[i][source] = max(score[i], 0), 0
            cap[i][sink], cap[sink][i] = max(-score[i], 0), 0
        while True:  # by levels from the source, each level graph filled by paths without search twice
            level, queue = {source: 0}, deque([source])
            while queue:
                i = queue.popleft()
                for j, c in cap[i].items():
                    if c > 1e-9 and j not in level:
                        level[j] = level[i] + 1
                        queue.append(j)
            if sink not in level:
                break
            ahead = {i: list(cap[i]) for i in level}
            path = [source]
            while path:
                i = path[-1]
                if i == sink:
                    push = min(cap[a][b] for a, b in zip(path, path[1:]))
                    for a, b in zip(path, path[1:]):
                        cap[a][b] -= push
                        cap[b][a] += push
                    path = path[: next(k for k in range(len(path) - 1) if cap[path[k]][path[k + 1]] <= 1e-9) + 1]
                    continue
                while ahead[i]:
                    j = ahead[i][-1]
                    if cap[i][j] > 1e-9 and level.get(j) == level[i] + 1:
                        path.append(j)
                        break
                    ahead[i].pop()
                else:
                    path.pop()
                    if path:
                        ahead[path[-1]].pop()
        for i in rest:
            label[i] = i in level
    return label


def extract(html: str | None, weights=HAND) -> str:
    """The main text of a whole page: content blocks joined by a line end."""
    found = blocks(html or "")
    return "\n".join(b.text for b, keep in zip(found, min_cut(prices(found, weights), smoothness(found))) if keep)


def extracted(pages: DataFrame, weights: tuple[float, ...] = HAND, out: str = "main") -> DataFrame:
    """pages with a struct column `out` of text and n_chars."""
    common.small_batches(pages.sparkSession)

    def start():
        def run(htmls):
            texts = [extract(h, weights) for h in htmls]
            return {"text": texts, "n_chars": list(map(len, texts))}

        return run

    udf = common.text_struct(start, pa.schema([("text", pa.string()), ("n_chars", pa.int64())]), "text string, n_chars bigint")
    return pages.withColumn(out, udf(F.col("html")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.spread(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return extracted(pages, fit_on_pages(pages)).select("page_id", "url", "main.*")
