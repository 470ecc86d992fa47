"""Main text of HTML pages by minimum-cut labelling.

A page is read into blocks, the runs of text between block-level tags, each with
its chain of container elements. A linear classifier scores a block as content
(positive) or boilerplate from text, link and tag densities of the block, its
container and its neighbours, and from its containers' names, whose weight is
bounded; it is fitted on the pages that mark their article (``fit_weights``). Its
two log-costs are the capacities from the source and to the sink. Neighbouring blocks, and consecutive blocks of
one container, are joined by smoothness edges that weaken with their distance in
the DOM. The minimum cut labels all blocks at once; the source side is the text.

Blocks whose terminal costs differ by more than all their edges carry are
decided at once, which never changes the cut; the rest goes through max-flow.

Null or empty html: empty text. Broken markup is read as browsers do: unknown or
unclosed tags are tolerated, a tag cut off by the end of the page is dropped.
Whole pages are read; a task holds one page at a time. Repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bnlake.llm.common import staged

#: Weight of the squared change of the weights against the mean log-loss.
REGULARISATION = 1.0

OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?])")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

# HTML element names by their meaning.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup
option p pre search section select summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg".split())
#: What may stand in a head; anything else ends it, as its end tag may be left out.
HEAD = frozenset("head html base basefont bgsound link meta title style script noscript template".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = frozenset("p blockquote pre".split())
ITEM = frozenset("li dd dt td th option".split())
CLOSES_P = BLOCK - {"button", "body", "html", "head", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
# Names that hint at boilerplate or content, as elements or in class, id and role.
BAD_TAGS = frozenset("nav header footer aside form menu dialog button select fieldset head option".split())
GOOD_TAGS = frozenset("article main".split())
BAD_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs
comment comments commentlist consent contentinfo cookie cookies copyright disqus disclaimer footer footers form gdpr header
headers login masthead menu menus nav navbar navigation newsletter notice notices notification pager pagination popup
modal promo promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup
skyscraper social sponsor sponsored sponsors subscribe tags toolbar topbar widget widgets""".split())
GOOD_NAMES = frozenset("article content entry main post story text body maincontent articlebody postbody".split())
#: Words that make a name tell a state ("no-sidebar", "comments-open"), not what the element is.
STATE = frozenset("""closed collapsed disabled enabled expanded has hidden hide is no not off on open show single type with
without""".split())


@dataclass(frozen=True)
class Weights:
    """Classifier and smoothness. These hold where a table has no labelled page to
    fit them on; ``fit_weights`` replaces all but the last three."""

    bias: float = -1.0
    good: float = 6.0
    bad: float = -8.0
    links: float = -4.0
    length: float = 1.0
    stop: float = 1.0
    heading: float = 0.5
    paragraph: float = 0.7
    item: float = -0.7
    company: float = 0.7
    around: float = 0.4
    near: float = 1.0
    same: float = 0.6
    #: What a name may weigh at most, so that text can speak against it.
    hint_bound: float = 8.0


#: The classifier's features in the order of ``features``, after the bias.
FEATURES = ("good", "bad", "links", "length", "stop", "heading", "paragraph", "item", "company", "around")


class Element:
    """An open element; hint is its own or else that of the nearest one around it."""

    __slots__ = ("depth", "hint", "inside", "name", "parent")

    def __init__(self, name: str, parent: Element | None, hint: int):
        self.name, self.parent = name, parent
        self.hint = hint or (parent.hint if parent else 0)
        self.depth = parent.depth + 1 if parent else 0
        self.inside = name in GOOD_TAGS or bool(parent and parent.inside)


class Block:
    __slots__ = ("at", "linked", "parts", "tag")

    def __init__(self, at: Element, tag: str):
        self.at, self.tag, self.parts, self.linked = at, tag, [], 0


def _hint(name: str, attributes: str) -> int:
    """1: content, -1: boilerplate, 0: says nothing."""
    if name in BAD_TAGS:
        return -1
    good = name in GOOD_TAGS
    if attributes and "=" in attributes and name not in ("html", "body", "a"):
        words: set[str] = set()
        for m in NAMES.finditer(attributes):
            for one in (m[1] or m[2] or m[3] or "").lower().split():
                parts = set(SPLIT.split(one))
                if not parts & STATE:
                    words |= parts
        if words & BAD_NAMES:
            return -1
        good = good or bool(words & GOOD_NAMES)
    return 1 if good else 0


def blocks(page: str) -> list[tuple[Block, str]]:
    """Blocks of the page that have text, in page order."""
    top = Element("#page", None, 0)
    now, block, links = top, Block(top, ""), 0
    known: Counter[str] = Counter()  # open elements by name, so that no walk is in vain

    def close(found: Element) -> Element:
        e = now
        while e is not found.parent:
            known[e.name] -= 1
            e = e.parent
        return e

    out, at, size = [], 0, len(page)
    while at < size:
        m = OPEN.search(page, at)
        text = page[at:m.start() if m else size]
        if text:
            if now.name == "head" and not text.isspace():
                out.append(block)
                now = close(now)
                block = Block(now, now.name)
            block.parts.append(text)
            if links:
                block.linked += len(text)
        if not m:
            break
        if m[1]:
            end = page.find("-->", m.end())
            at = size if end < 0 else end + 3
            continue
        rest = REST.match(page, m.end())
        end = rest.end() if rest else page.find(">", m.end()) + 1
        if not end:
            break
        at = end
        name = (m[3] or "").lower()
        if not name:
            continue
        closing = bool(m[2])
        if name == "a":
            links = 0 if closing else 1
        if not closing and known["head"] and name not in HEAD:
            out.append(block)
            now = close(_opened(now, "head"))
            block = Block(now, now.name)
        if not closing and name == "svg" and page[m.end():end - 1].endswith("/"):
            continue
        if not closing and name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else size
            if name == "xmp":  # shown as it is, tags and entities too
                out.append(block)
                block = Block(now, now.name)
                block.parts.append(page[end:stop.start() if stop else size].replace("&", "&amp;"))
                out.append(block)
                block = Block(now, now.name)
            if name in ("textarea", "iframe"):
                block.parts.append(" ")
            continue
        if name == "br":
            block.parts.append(" ")
        if name not in BLOCK:
            hint = 0 if closing or name in VOID or not page[m.end():end - 1].strip() else _hint(name, page[m.end():end])
            if hint >= 0 and not (closing and known[name]):
                continue  # inline elements matter only if their names hint at boilerplate
        out.append(block)
        if closing:
            if known[name]:
                now = close(_opened(now, name))
        else:
            if name in CLOSES_P and known["p"] and (p := _opened(now, "p", stop="button td th")):
                now = close(p)
            if name in ("li", "dd", "dt", "option", "tr", "td", "th") and now.name == name:
                now = close(now)
            if name != "hr" and name not in VOID:
                own = name == "header" and now.inside      # an article's own header holds its title
                now = Element(name, now, _hint("div" if own else name, page[m.end():end]))
                known[name] += 1
        block = Block(now, now.name)
        if name not in ("b", "i", "em", "strong", "span"):
            links = links if name == "a" else 0
    out.append(block)
    kept = []
    for b in out:
        if b.parts:
            raw = "".join(b.parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                kept.append((b, text))
    return kept


def _opened(at: Element, name: str, stop: str = "") -> Element | None:
    """The nearest open element of that name."""
    limits = stop.split()
    while at.parent:
        if at.name == name:
            return at
        if at.name in limits:
            return None
        at = at.parent
    return None


def features(found: list[tuple[Block, str]]) -> list[list[float]]:
    """A row of FEATURES for each block. Names of containers give the first two; link
    share, length, closing stop and tag are the block's own; ``company`` is the running
    text in paragraphs of its container, ``around`` the length of its two neighbours."""
    size = [min(3.0, math.log10(len(t) + 1)) - 1.5 for _, t in found]
    linked = [min(1.0, b.linked / len(t)) for b, t in found]
    prose: Counter[int] = Counter()
    for (b, t), share in zip(found, linked):
        if b.tag in PARAGRAPH and share < 0.5:
            prose[id(b.at.parent or b.at)] += len(t)
    rows = []
    for i, (b, t) in enumerate(found):
        near = size[max(0, i - 1):i] + size[i + 1:i + 2]
        rows.append([float(b.at.hint > 0), float(b.at.hint < 0), linked[i], size[i], float(t[-1] in ".!?:;\"”»…"),
                     float(b.tag in HEADING), float(b.tag in PARAGRAPH), float(b.tag in ITEM),
                     min(1.0, math.log10(prose[id(b.at.parent or b.at)] + 1) - 1.5), sum(near) / 2])
    return rows


def scores(found: list[tuple[Block, str]], w: Weights) -> list[float]:
    """Log-odds that a block is content."""
    by = [getattr(w, f) for f in FEATURES]
    return [w.bias + sum(a * x for a, x in zip(by, row)) for row in features(found)]


def _distance(a: Element, b: Element) -> int:
    """Steps from one container to the other through the DOM."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def edges(found: list[tuple[Block, str]], w: Weights) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for i, (b, _) in enumerate(found):
        if i:
            out.append((i - 1, i, w.near / (1 + _distance(found[i - 1][0].at, b.at))))
        home = b.at.parent or b.at
        if (j := last.get(id(home))) is not None and j < i - 1:
            out.append((j, i, w.same / (1 + math.log2(i - j))))
        last[id(home)] = i
    return out


def minimum_cut(z: list[float], pairs: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut: capacities log(1 + e^z) from the source,
    log(1 + e^-z) to the sink, and the pairs between. Only the difference z of a
    node's two capacities decides."""
    n = len(z)
    net, joined = list(z), [{} for _ in range(n)]
    for a, b, c in pairs:
        joined[a][b] = joined[a].get(b, 0.0) + c
        joined[b][a] = joined[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(net[i]) >= sum(joined[i].values()):
            label[i] = net[i] > 0
            for j, c in joined[i].items():
                del joined[j][i]
                net[j] += c if label[i] else -c
                todo.append(j)
            joined[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _max_flow(rest, net, joined)
        for i in rest:
            label[i] = i in side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], net: list[float], joined: list[dict[int, float]]) -> set[int]:
    """Nodes on the source side after the blocking flows of Dinic's method."""
    s, t = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(joined[i]) for i in nodes}
    room[s], room[t] = {}, {}
    for i in nodes:
        if net[i] > 0:
            room[s][i], room[i][s] = net[i], 0.0
        elif net[i] < 0:
            room[i][t], room[t][i] = -net[i], 0.0
    tiny = 1e-9
    while True:
        level, todo = {s: 0}, deque([s])
        while todo:
            i = todo.popleft()
            for j, c in room[i].items():
                if c > tiny and j not in level:
                    level[j] = level[i] + 1
                    todo.append(j)
        if t not in level:
            return set(level) - {s}
        ways = {i: iter(list(room[i])) for i in level}
        path = [s]
        while path:
            i = path[-1]
            if i == t:
                least = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= least
                    room[b][a] = room[b].get(a, 0.0) + least
                cut = next(k for k in range(len(path) - 1) if room[path[k]][path[k + 1]] <= tiny)
                for k in path[cut + 1:-1]:
                    ways[k] = iter(list(room[k]))
                del path[cut + 1:]
                continue
            step = next((j for j in ways[i] if room[i][j] > tiny and level.get(j) == level[i] + 1), None)
            if step is None:
                path.pop()
            else:
                path.append(step)


def extract(page: str | None, w: Weights = Weights()) -> str:
    found = blocks(page or "")
    content = minimum_cut(scores(found, w), edges(found, w))
    return "\n".join(t for (_, t), keep in zip(found, content) if keep)


def labelled_blocks(page: str) -> list[tuple[list[float], float]]:
    """Features and label of each block of a page that marks its article by an element:
    content is what stands in it and in no part named as boilerplate. Pages without
    such an element give none."""
    found = blocks(page)
    if not any(b.at.inside for b, _ in found):
        return []
    return [(row, float(b.at.inside and b.at.hint > 0)) for (b, _), row in zip(found, features(found))]


def fit_weights(pages: DataFrame, sample_pages: int = 2000, start: Weights = Weights()) -> Weights:
    """Weights by logistic regression on the marked pages among at most ``sample_pages``
    different ones, those with the smallest hashes. Every page counts once, however many
    blocks it has. Its blocks are given twice, with their names and without, so the
    weights of text, links and tags are learned as if names were missing half the time.
    What is fitted is the change from ``start`` (an offset), held near none by its squared
    length, so a name that the sample lacks, such as comments, keeps its meaning.
    ``start`` comes back where no page is marked or only one label occurs."""
    top = 1 << 30
    keyed = pages.select("html", F.xxhash64("html").alias("h")).filter(F.col("html").isNotNull())
    n = keyed.count()
    if not n:
        return start
    bound = min(top, -(-4 * sample_pages * top // n))       # four times the sample, then the smallest of those
    low = keyed.filter(F.pmod("h", F.lit(top)) < bound)
    picked = low.select("h").distinct().orderBy(F.pmod("h", F.lit(top)), "h").limit(sample_pages)
    sample = low.join(F.broadcast(picked), "h").groupBy("h").agg(F.first("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page in b.column(0).to_pylist():
                rows = labelled_blocks(page)
                x = [r for r, _ in rows] + [[0.0, 0.0, *r[2:]] for r, _ in rows]
                y = [label for _, label in rows] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64()),
                     pa.array([1 / max(1, len(y))] * len(y), pa.float64())], ["x", "label", "weight"])

    rows = staged(sample.select("html").mapInArrow(run, "x array<double>, label double, weight double"), "html_blocks")
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return start
    prior = F.aggregate(F.arrays_zip("x", F.array(*[F.lit(getattr(start, f)) for f in FEATURES]).alias("w")),
                        F.lit(start.bias), lambda z, e: z + e["x"] * e["w"])
    model = GeneralizedLinearRegression(family="binomial", link="logit", regParam=REGULARISATION, maxIter=50,
                                        weightCol="weight", offsetCol="prior").fit(
        rows.select(array_to_vector("x").alias("features"), "label", "weight", prior.alias("prior")))
    learned = {f: getattr(start, f) + c for f, c in zip(FEATURES, model.coefficients.tolist())}
    learned["good"] = min(max(learned["good"], 0.0), start.hint_bound)
    learned["bad"] = max(min(learned["bad"], 0.0), -start.hint_bound)
    return replace(start, bias=start.bias + float(model.intercept), **learned)


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html);
    weights not given are fitted on the pages."""
    weights = weights or fit_weights(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(x, weights) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
