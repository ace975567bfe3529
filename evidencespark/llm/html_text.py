"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree: block-level elements, and under them the text blocks. Each node is content or not. Unary
potentials come from a node's tag, the words of its class, id and role, and from a text block's length, share of linked
text and end mark; pair potentials join each node to its parent. A sum-product pass from the leaves to the root and back
gives the marginal of every text block; blocks whose marginal is at least one half are the text.

Potentials are counts over labelled pages, on top of a few pseudo-counts. A page labels itself where its markup
names its main part: blocks inside article or main, outside of parts that are named otherwise, are content. At most
SAMPLE_PAGES pages, the first by a hash of page_id, are used for that.

Defined results: null or empty html gives an empty text; tags cut off at the end of a page are dropped; unclosed elements
end with their parent; white space of any kind, also line breaks by br and table cells, is one space inside a block;
repeated rows give a row each; without labelled pages the pseudo-counts alone decide.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, each_text, stored


SAMPLE_PAGES = 2000

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z""",
    re.S,
)
_NAMES = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# HTML's element names by their role, and words by which sites name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
DROPPED = frozenset("script style textarea title xmp head noscript template svg math iframe object canvas select button audio video".split())
BLOCK = frozenset(
    "html body div section article main header footer nav aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption"
    " pre blockquote figure figcaption address hr details summary dialog center".split()
)
ENDS_P = BLOCK - {"html", "body", "tr", "thead", "tbody", "tfoot", "caption"}
SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "p": {"p"}}
LIST_SCOPE = frozenset("ul ol dl table html body div section article main".split())
OTHER_PARTS = frozenset("nav aside footer header form menu dialog fieldset".split())
OTHER_WORDS = re.compile(
    r"(?:^|[^a-z])(?:nav|navigation|navbar|menu|foot|footer|head|header|masthead|side|sidebar|ad|ads|adv|advert|advertisement|banner|promo|sponsor|sponsored"
    r"|cookie|cookies|consent|gdpr|notice|alert|comment|comments|disqus|reply|replies|respond|share|sharing|social|form|login|signup|subscribe|newsletter"
    r"|related|recommended|breadcrumb|breadcrumbs|popup|modal|overlay|widget|search|pagination|pager|toolbar|copyright|legal|tags|skip)(?:$|[^a-z])",
    re.I,
)
MAIN_WORDS = re.compile(r"(?:^|[^a-z])(?:article|content|post|entry|story|main|body|text|articlebody)(?:$|[^a-z])", re.I)


class Page:
    """Nodes in page order, a parent before its children: parent, features (one value per kind), text (None for an element)."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.features: list[tuple[str, ...]] = [("tag:root", "name:none")]
        self.text: list[str | None] = [None]
        self.main: list[bool] = [False]
        self.other: list[bool] = [False]
        self._held: list[str] = []
        self._linked = 0
        self._read(source)

    def _element(self, parent: int, tag: str, attributes: str) -> int:
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else ""
        other_name = bool(names) and OTHER_WORDS.search(names) is not None
        if tag in OTHER_PARTS:
            group = "other"
        elif tag in ("article", "main"):
            group = "main"
        elif tag in ("p", "pre", "blockquote"):
            group = "p"
        elif tag[0] == "h" and len(tag) == 2 and tag[1].isdigit():
            group = "heading"
        elif tag in ("ul", "ol", "li", "dl", "dt", "dd"):
            group = "list"
        elif tag in ("table", "thead", "tbody", "tfoot", "tr", "caption"):
            group = "table"
        else:
            group = "div"
        name = "other" if other_name else "main" if names and MAIN_WORDS.search(names) else "none"
        self.parent.append(parent)
        self.features.append((f"tag:{group}", f"name:{name}"))
        self.text.append(None)
        self.main.append(self.main[parent] or group == "main")
        self.other.append(self.other[parent] or group == "other" or other_name)
        return len(self.parent) - 1

    def _flush(self, parent: int) -> None:
        if self._held:
            text = " ".join("".join(self._held).split())
            if text:
                words = text.count(" ") + 1
                share = self._linked / max(1, len(text))
                self.parent.append(parent)
                self.features.append((
                    "words:" + ("1" if words < 4 else "2" if words < 12 else "3" if words < 30 else "4"),
                    "links:" + ("none" if not self._linked else "some" if share < 0.4 else "most"),
                    "end:" + ("stop" if text[-1] in ".!?:;\"')”»…" else "open"),
                ))
                self.text.append(text)
                self.main.append(self.main[parent])
                self.other.append(self.other[parent])
        self._held, self._linked = [], 0

    def _read(self, source: str) -> None:
        # Open elements: (tag, node of the nearest block-level element, inside a dropped element, inside a link).
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        open_tags: Counter[str] = Counter()
        at, end = 0, len(source)

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                open_tags[stack.pop()[0]] -= 1

        def add_text(a: int, b: int) -> None:
            if a < b and not stack[-1][2]:
                piece = html.unescape(source[a:b]) if "&" in source[a:b] else source[a:b]
                self._held.append(piece)
                if stack[-1][3]:
                    self._linked += len(piece.strip())

        while at < end:
            found = _MARKUP.search(source, at)
            if not found:
                add_text(at, end)
                break
            add_text(at, found.start())
            at = found.end()
            tag = found[2] or found[5]
            if tag is None:
                continue
            tag, closing, attributes = tag.lower(), bool(found[1] or found[4]), found[3] or found[6] or ""
            if closing:
                if tag == "br" or not open_tags[tag]:
                    continue
                if tag in BLOCK:
                    self._flush(stack[-1][1])
                depth = len(stack) - 1
                while depth > 0 and stack[depth][0] != tag:
                    if tag not in BLOCK and stack[depth][0] in BLOCK and tag not in DROPPED:
                        depth = -1  # an inline end tag does not end the block it stands in
                        break
                    depth -= 1
                if depth > 0:
                    close_to(depth)
                continue
            if tag in ("br", "td", "th"):
                self._held.append(" ")
            if tag == "body" and open_tags["head"]:
                close_to(next(i for i, x in enumerate(stack) if x[0] == "head"))
            if tag in BLOCK:
                self._flush(stack[-1][1])
                if tag in ENDS_P and open_tags["p"]:
                    depth = max(i for i, x in enumerate(stack) if x[0] == "p")
                    if not any(x[0] in ("table", "div", "article", "section") for x in stack[depth:]):
                        close_to(depth)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in SIBLING_ENDS.get(tag, ()):
                        close_to(i)
                        break
                    if stack[i][0] in LIST_SCOPE:
                        break
            if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
                continue
            _, node, dropped, linked = stack[-1]
            dropped = dropped or tag in DROPPED
            if tag in BLOCK and not dropped:
                node = self._element(node, tag, attributes)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
                continue
            stack.append((tag, node, dropped, linked or tag == "a"))
            open_tags[tag] += 1
        self._flush(stack[-1][1])

    def pair_kind(self, i: int) -> str:
        """Which pair potential joins a node to its parent: one of its own holds below parts named as something else."""
        if "tag:other" in self.features[self.parent[i]] or "name:other" in self.features[self.parent[i]]:
            return "pair:inside"
        return "pair:element" if self.text[i] is None else "pair:text"

    def labels(self) -> list[int] | None:
        """For a page whose markup names its main part: 1 for content; an element by the larger part of the text in it."""
        if not any(m and t is not None for m, t in zip(self.main, self.text)):
            return None
        weight = [0] * len(self.parent)
        for i in range(len(self.parent) - 1, -1, -1):
            if self.text[i] is not None:
                weight[i] = len(self.text[i]) * (1 if self.main[i] and not self.other[i] else -1)
            if i:
                weight[self.parent[i]] += weight[i]
        return [int(w > 0) for w in weight]


def count_page(page: Page) -> Counter[tuple[str, int]]:
    """What a labelled page adds to the counts: features by label, and kind of node with its parent's label by label."""
    counts: Counter[tuple[str, int]] = Counter()
    labels = page.labels()
    if labels is not None:
        for i, (parent, features) in enumerate(zip(page.parent, page.features)):
            for f in features:
                counts[f, labels[i]] += 1
            if i:
                counts[f"{page.pair_kind(i)}:{labels[parent]}", labels[i]] += 1
            else:
                counts["pair:root", labels[i]] += 1
    return counts


#: Pseudo-counts (not content, content): what is held without labelled pages.
PRIOR: dict[str, tuple[float, float]] = {
    "tag:other": (20, 0.02), "tag:main": (0.1, 10), "tag:div": (5, 5), "tag:root": (1, 1), "tag:p": (2, 10), "tag:heading": (2, 4), "tag:list": (5, 5), "tag:table": (2, 2),
    "name:other": (20, 0.01), "name:main": (0.5, 10), "name:none": (20, 20),
    "words:1": (12, 3), "words:2": (6, 4), "words:3": (3, 6), "words:4": (1, 8), "links:most": (12, 1), "links:some": (3, 3), "links:none": (8, 16), "end:stop": (4, 14), "end:open": (12, 5),
    "pair:root": (1, 2), "pair:element:0": (20, 2), "pair:element:1": (4, 20), "pair:text:0": (40, 1), "pair:text:1": (1, 40),
    "pair:inside:0": (40, 0.01), "pair:inside:1": (4, 4),
}


#: What all labelled pages together weigh at most in a family of counts, so that many pages of one make don't outvote the rest.
WEIGHT = 30.0


class TreeModel:
    """Log potentials from counts over labelled pages."""

    def __init__(self, counts: dict[tuple[str, int], float]):
        seen: dict[str, float] = {}
        for (f, _), v in counts.items():
            seen[f.rpartition(":")[0]] = seen.get(f.rpartition(":")[0], 0.0) + v
        table = {f: [p + counts.get((f, y), 0.0) * min(1.0, WEIGHT / seen.get(f.rpartition(":")[0], 1.0)) for y, p in enumerate(prior)] for f, prior in PRIOR.items()}
        totals: dict[str, list[float]] = {}
        for f, (a, b) in table.items():
            if not f.startswith("pair:"):
                t = totals.setdefault(f.split(":")[0], [0.0, 0.0])
                t[0] += a
                t[1] += b
        self.unary = {f: tuple(math.log(v / totals[f.split(":")[0]][y]) for y, v in enumerate(row)) for f, row in table.items() if not f.startswith("pair:")}
        self.pair = {f: tuple(v / sum(row) for v in row) for f, row in table.items() if f.startswith("pair:")}

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node. Messages are kept as pairs (not content, content), scaled to sum one."""
        n = len(page.parent)
        own, up = [], [(1.0, 1.0)] * n
        for features in page.features:
            d = sum(self.unary[f][1] - self.unary[f][0] for f in features)
            own.append((1.0, math.exp(d)) if d < 0 else (math.exp(-d), 1.0))
        belief = list(own)
        pairs = {k: (self.pair[f"{k}:0"], self.pair[f"{k}:1"]) for k in ("pair:element", "pair:text", "pair:inside")}
        tables = [pairs["pair:element"], *(pairs[page.pair_kind(i)] for i in range(1, n))]
        for i in range(n - 1, 0, -1):  # children stand after their parents
            b0, b1 = belief[i]
            (t00, t01), (t10, t11) = tables[i]
            m0, m1 = t00 * b0 + t01 * b1, t10 * b0 + t11 * b1
            s = m0 + m1
            up[i] = (m0 / s, m1 / s)
            p0, p1 = belief[page.parent[i]]
            p0, p1 = p0 * up[i][0], p1 * up[i][1]
            s = p0 + p1
            belief[page.parent[i]] = (p0 / s, p1 / s) if s > 1e-290 else (0.5, 0.5)
        r0, r1 = self.pair["pair:root"]
        total = [(0.0, 0.0)] * n
        b0, b1 = belief[0][0] * r0, belief[0][1] * r1
        total[0] = (b0 / (b0 + b1), b1 / (b0 + b1))
        for i in range(1, n):
            p0, p1 = total[page.parent[i]]
            p0, p1 = p0 / max(up[i][0], 1e-300), p1 / max(up[i][1], 1e-300)  # the parent's belief without this child
            s = p0 + p1
            p0, p1 = p0 / s, p1 / s
            (t00, t01), (t10, t11) = tables[i]
            b0, b1 = belief[i][0] * (p0 * t00 + p1 * t10), belief[i][1] * (p0 * t01 + p1 * t11)
            s = b0 + b1
            total[i] = (b0 / s, b1 / s) if s > 0 else (0.5, 0.5)
        return [t[1] for t in total]

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        return "\n".join(t for t, m in zip(page.text, self.marginals(page)) if t is not None and m >= 0.5)


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> TreeModel:
    """Counts over the pages of at most sample page_ids, chosen by a hash of the id alone: only these pages are read in full. A row a
    feature and label reaches the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[tuple[str, int]] = Counter()
        for pdf in batches:
            for source in pdf["html"]:
                if source:
                    counts.update(count_page(Page(source)))
        yield pd.DataFrame([(f, y, float(v)) for (f, y), v in counts.items()], columns=["feature", "label", "n"])

    ids = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    chosen = pages.select("page_id", "html").join(F.broadcast(ids), "page_id", "left_semi")
    with bounded_batches(pages.sparkSession):
        rows = chosen.mapInPandas(count, "feature string, label int, n double").groupBy("feature", "label").agg(F.sum("n").alias("n")).collect()
    return TreeModel({(r["feature"], r["label"]): r["n"] for r in rows})


def extract_pages(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars."""
    model = fit(pages, sample)

    @F.arrow_udf("string")
    def main_text(source: pa.Array) -> pa.Array:
        return pa.array([model.extract(x) for x in each_text(source)], pa.string())

    out = stored(pages.select("page_id", "url", main_text("html").alias("text")), "html-text")
    return out.withColumn("n_chars", F.length("text").cast("long"))
