"""Main text of web pages: boosted trees score DOM nodes, a tree decoding makes the choices consistent."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.llm.shared import arrow_map, bounded_sample, text_slices

# Element kinds of HTML, and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSED_BY = {
    "p": BLOCKS - {"body", "html", "head", "title", "button", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "select"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"},
    "head": {"body"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}}
NOT_MAIN_TAGS = frozenset("nav footer aside form button select script style textarea noscript template iframe head title menu dialog svg object".split())
MAIN_TAGS = frozenset(["article", "main"])
NOT_MAIN_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side"
    " footer header masthead comment comments disqus reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe"
    " signup login search share sharing social related recommended widget toolbar pagination pager copyright legal".split()
)
#: elements that hold the main text with all beside it: what their classes say of parts of the page is not said of them
FRAME_TAGS = MAIN_TAGS | {"html", "body"}
#: a token with such a word states a condition (has-sidebar, comments-open) and does not name a part
STATE_WORDS = frozenset("has with without no not is open opened closed enabled disabled on off".split())
MAIN_WORDS = frozenset("article articlebody entry post story maintext".split())

TAGS = "html body div section article main header footer nav aside p h1 h2 h3 ul ol li a b i em strong span table td form script style title blockquote pre".split()
NUMBERS = [
    "depth", "place", "siblings", "same_siblings", "children", "log_text", "log_inner", "density", "link_share", "words_a_block", "stops", "before", "page_share",
    "headings", "paragraphs", "links", "upper", "mean_word",
]
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
#: attributes that name an element, by their whole name
NAMING = frozenset(["class", "id", "role", "itemprop", "aria-label"])
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: elements that carry text themselves: a phrase of their classes (market share) names no part of the page
TEXT_TAGS = HEADINGS | frozenset("p blockquote pre b i em strong figcaption cite q dfn".split())


def _attribute_words(tag: str, attrs: str) -> tuple[str, ...]:
    """Words of the naming attributes, without those of NOT_MAIN_WORDS that do not name the element itself.

    Values of other attributes (href, data-id) say nothing; nor do ids of
    headings, which are made of the heading's words, nor single words of a
    phrase on an element that carries text.
    """
    words: list[str] = []
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        if name not in NAMING or tag in HEADINGS and name == "id":
            continue
        found = [(token, _WORD.findall(token)) for token in value.strip("\"'").lower().split()]
        phrase = tag in TEXT_TAGS and any(not NOT_MAIN_WORDS.intersection(parts) for _, parts in found)
        for _, parts in found:
            if tag in FRAME_TAGS or phrase or tag in TEXT_TAGS and len(parts) > 1 or len(parts) > 1 and STATE_WORDS.intersection(parts):
                parts = [w for w in parts if w not in NOT_MAIN_WORDS]
            words += parts
    return tuple(words)


class Page:
    """Nodes of a page in order of their start; ``segments`` are (node, block, text) pieces of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.words = ["#root"], [-1], [()]
        self.segments: list[tuple[int, int, str]] = []
        stack, block, at, raw = [0], 0, 0, None
        open_names: Counter = Counter()

        def text(piece: str) -> None:
            if piece:
                self.segments.append((stack[-1], block, piece))

        while True:
            if raw:  # nothing inside is markup but its own end
                end = re.compile(rf"</{re.escape(raw)}\s*>", re.I).search(source, at)
                text(source[at : end.start() if end else len(source)])
                at, raw = (end.end() if end else len(source)), None
                open_names[self.tag[stack.pop()]] -= 1
                block += 1
            found = _TOKEN.search(source, at)
            text(source[at : found.start() if found else len(source)])
            if not found:
                break
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name, attrs = name.lower(), found[3] or found[6] or ""
            if found[1] or found[4]:
                if open_names[name] > 0:
                    closed = None
                    while closed != name:
                        closed = self.tag[stack.pop()]
                        open_names[closed] -= 1
                if name in BLOCKS:
                    block += 1
                continue
            if name == "br":
                text(" ")
                continue
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = self.tag[stack[depth]]
                if name in CLOSED_BY.get(open_tag, ()):
                    open_names.subtract(self.tag[n] for n in stack[depth:])
                    del stack[depth:]
                    break
                if open_tag in SCOPE.get(name, ()) or open_tag in BLOCKS and open_tag not in CLOSED_BY:
                    break
            if name in BLOCKS:
                block += 1
            if name in VOID:
                continue
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.words.append(_attribute_words(name, attrs) if "=" in attrs else ())
            stack.append(len(self.tag) - 1)
            open_names[name] += 1
            if name in RAW:
                raw = name

    def teacher(self) -> np.ndarray:
        """1 in what page structure marks as main text, 0 in what it marks as something else, -1 where it says nothing."""
        label = [-1] * len(self.tag)
        for node in range(1, len(self.tag)):
            above, tag, words = label[self.parent[node]], self.tag[node], self.words[node]
            if above == 0 or tag in NOT_MAIN_TAGS or NOT_MAIN_WORDS.intersection(words) or (tag == "header" and above != 1):
                label[node] = 0
            elif above == 1 or tag in MAIN_TAGS or MAIN_WORDS.intersection(words):
                label[node] = 1
        return np.asarray(label)

    def features(self, vocabulary: dict[str, int]) -> np.ndarray:
        """(nodes, features): signs, tags and attribute words of the vocabulary, above and of the node; then counts and place."""
        n = len(self.tag)
        parent = np.asarray(self.parent)
        chars, words, stops, upper, blocks = (np.zeros(n) for _ in range(5))
        last = -1
        for node, block, piece in self.segments:
            size = len(piece)
            chars[node] += size
            words[node] += piece.count(" ") + 1 if size > 1 else 0
            stops[node] += piece.count(". ") + piece.count(",") + (piece[-1:] == ".")
            upper[node] += piece[:1].isupper()
            blocks[node] += block != last
            last = block
        own = chars.copy()
        is_tag = {t: np.fromiter((x == t for x in self.tag), float, n) for t in ("a", "p")}
        heading = np.fromiter((len(x) == 2 and x[0] == "h" and x[1].isdigit() for x in self.tag), float, n)
        linked = np.where(is_tag["a"] > 0, chars, 0)
        nodes = np.ones(n)
        table = np.column_stack([chars, words, stops, upper, blocks, linked, nodes, heading, is_tag["p"], is_tag["a"]])
        depth, place, siblings, same = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        kinds: Counter = Counter()
        for node in range(1, n):
            up = self.parent[node]
            depth[node] = depth[up] + 1
            place[node] = siblings[up]
            siblings[up] += 1
            kinds[up, self.tag[node]] += 1
        before = np.cumsum(own) - own
        for node in range(n - 1, 0, -1):  # children come after their parents
            if self.tag[node] == "a":
                table[node, 5] = table[node, 0]
            table[self.parent[node]] += table[node]
        for node in range(1, n):
            same[node] = kinds[self.parent[node], self.tag[node]]
        total = max(1.0, table[0, 0])
        chars, words, stops, upper, blocks, linked, nodes, heads, paragraphs, links = table.T
        numbers = np.column_stack([
            depth, place, siblings[np.maximum(parent, 0)], same, siblings, np.log1p(own), np.log1p(chars), chars / nodes,
            linked / np.maximum(chars, 1), words / np.maximum(blocks, 1), stops / np.maximum(words, 1), before / total, chars / total,
            heads, paragraphs, links, upper / np.maximum(blocks, 1), chars / np.maximum(words, 1),
        ])
        first = len(TAGS) + len(SIGNS)
        marks = np.zeros((n, first + len(vocabulary)))
        for node, (tag, attr) in enumerate(zip(self.tag, self.words, strict=True)):
            for sign, (tags, named) in enumerate(SIGNS):
                if tag in tags or named.intersection(attr):
                    marks[node, sign] = 1
            if tag in _TAG_AT:
                marks[node, len(SIGNS) + _TAG_AT[tag]] = 1
            for word in attr:
                if word in vocabulary:
                    marks[node, first + vocabulary[word]] = 1
        # a node's own marks, and those of everything above it
        above = marks.copy()
        for node in range(1, n):
            np.maximum(above[node], above[self.parent[node]], out=above[node])
        return np.concatenate([above, marks, numbers], axis=1).astype(np.float32)

    def decode(self, log_odds: np.ndarray) -> list[bool]:
        """Which nodes are main text, by the likeliest consistent labelling of the tree.

        A node is mixed, in or out. Below out all is out, below in nothing is
        mixed, so no part of a menu is text and no text hangs in a rejected
        ancestor. Best scores go up from the leaves, choices down from the root.
        """
        n = len(self.tag)
        odds = np.clip(log_odds, -12, 12)
        says_in, says_out = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        inside, outside, mixed = says_in.tolist(), says_out.tolist(), (MIXED - np.abs(odds)).tolist()
        for node in range(n - 1, 0, -1):
            up = self.parent[node]
            outside[up] += outside[node]
            inside[up] += max(inside[node], outside[node])
            mixed[up] += max(inside[node], outside[node], mixed[node])
        state = ["mixed"] * n
        for node in range(n):
            above = state[self.parent[node]] if node else "mixed"
            if above == "out":
                state[node] = "out"
            elif above == "in" or max(inside[node], outside[node]) >= mixed[node]:
                state[node] = "in" if inside[node] >= outside[node] else "out"
        return [s == "in" for s in state]

    def text(self, kept: list[bool]) -> str:
        """Kept text by blocks: references decoded, white space made one space, blocks joined by two newlines."""
        out: list[str] = []
        parts: list[str] = []
        last = -1
        for node, block, piece in [*self.segments, (-1, -2, "")]:
            if block != last:
                if parts and (joined := " ".join(html.unescape("".join(parts)).split())):
                    out.append(joined)
                parts, last = [], block
            if node >= 0 and kept[node]:
                parts.append(piece)
        return "\n\n".join(out)


#: kinds of tags or attribute words that count alike
SIGNS = [(NOT_MAIN_TAGS, frozenset()), (MAIN_TAGS, frozenset()), (frozenset(), NOT_MAIN_WORDS), (frozenset(), MAIN_WORDS)]
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
#: log score of a mixed node whose own odds are even; the surer the node, the dearer to call it mixed
MIXED = -1.0


class BoostedTrees:
    """Binary classification by Newton-boosted trees on binned features; a level of all nodes is split at once."""

    def __init__(self, depth: int = 4, trees: int = 50, rate: float = 0.2, bins: int = 24, ridge: float = 1.0):
        self.depth, self.trees, self.rate, self.bins, self.ridge = depth, trees, rate, bins, ridge
        self.base, self.edges, self.model = 0.0, np.zeros((0, bins - 1)), []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.edges = [np.array([0.5]) if set(np.unique(c)) <= {0.0, 1.0} else e for e, c in zip(self.edges, x.T, strict=True)]
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        if not len(y) or y.min() == y.max():
            return self
        binned = self._bin(x)
        width = self.bins
        offset = binned + np.arange(x.shape[1]) * width
        total = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-total))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            leaf = np.zeros(len(y), np.int64)
            features, cuts = [], []
            for level in range(self.depth):
                count = 1 << level
                cell = (leaf[:, None] * (x.shape[1] * width) + offset).ravel()
                shape = (count, x.shape[1], width)
                gs = np.cumsum(np.bincount(cell, np.repeat(g, x.shape[1]), count * x.shape[1] * width).reshape(shape), axis=2)
                hs = np.cumsum(np.bincount(cell, np.repeat(h, x.shape[1]), count * x.shape[1] * width).reshape(shape), axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                best = gain.reshape(count, -1).argmax(axis=1)
                feature, cut = best // width, best % width
                features.append(feature)
                cuts.append(cut)
                leaf = 2 * leaf + (binned[np.arange(len(y)), feature[leaf]] > cut[leaf])
            size = 1 << self.depth
            values = -self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.ridge)
            self.model.append((features, cuts, values))
            total += values[leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.model:
            binned, rows = self._bin(x), np.arange(len(x))
            for features, cuts, values in self.model:
                leaf = np.zeros(len(x), np.int64)
                for feature, cut in zip(features, cuts, strict=True):
                    leaf = 2 * leaf + (binned[rows, feature[leaf]] > cut[leaf])
                total += values[leaf]
        return total


def _distinct_sample(pages: DataFrame, most: int) -> DataFrame:
    """At most ``most`` different pages (html): hashes are made distinct and sampled, then one page of each is read."""
    hashed = pages.select("html", F.xxhash64("html").alias("_page"))
    chosen = bounded_sample(hashed.select("_page").distinct(), ["_page"], most)
    return hashed.join(F.broadcast(chosen), "_page", "left_semi").dropDuplicates(["_page"]).select("html")


def train_node_model(pages: DataFrame, html_col: str, max_pages: int = 300, max_chars: int = 200_000, max_words: int = 40) -> tuple[BoostedTrees, dict[str, int]]:
    """Fit on the nodes of at most ``max_pages`` different pages (smallest hashes, none over ``max_chars`` characters).

    Labels come from what pages say of themselves (``Page.teacher``). Half of
    the rows are repeated without tag and attribute marks, so that the counts
    carry a page that has none; the other half with their signs beside the
    counts and tags of other nodes, so that each sign is learnt by itself.
    """
    readable = pages.where(F.col(html_col).isNotNull() & (F.length(html_col) <= max_chars)).select(F.col(html_col).alias("html"))
    sample = sorted(_distinct_sample(readable, max_pages).collect())
    parsed = [Page(row.html) for row in sample]
    common = Counter(w for page in parsed for words in page.words for w in words)
    vocabulary = {w: i for i, (w, _) in enumerate(sorted(common.items(), key=lambda wc: (-wc[1], wc[0]))[:max_words])}
    rows, labels = [np.zeros((0, len(NUMBERS) + 2 * (len(TAGS) + len(SIGNS) + len(vocabulary))), np.float32)], [np.zeros(0)]
    for page in parsed:
        y = page.teacher()
        rows.append(page.features(vocabulary)[y >= 0])
        labels.append(y[y >= 0])
    x, y = np.concatenate(rows), np.concatenate(labels)
    bare = x[::2].copy()
    bare[:, : -len(NUMBERS)] = 0
    signed = x[1::2].copy()
    mixed = np.random.default_rng(1).permutation(len(signed))
    width = len(TAGS) + len(SIGNS) + len(vocabulary)
    signs = [*range(len(SIGNS)), *range(width, width + len(SIGNS))]
    others = np.setdiff1d(np.arange(x.shape[1]), signs)
    signed[:, others] = signed[mixed][:, others]
    signed[(y[1::2] == 0) & (mixed % 2 == 0), 1] = 1  # some parts that are not main text lie inside an article
    return BoostedTrees().fit(np.concatenate([x, bare, signed]), np.concatenate([y, y[::2], y[1::2]]).astype(float)), vocabulary


def extract_main_text(pages: DataFrame, model: tuple[BoostedTrees, dict[str, int]], id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, ``keep`` columns, text, n_chars) per page, from the whole html.

    Null and empty pages, and pages without main text, have empty text; broken
    markup is read as far as it can be; repeated rows stay repeated. One scan,
    no shuffle.
    """
    kinds = [(id_col, "id"), *((c, f"k{i}") for i, c in enumerate(keep))]
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c, _ in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, vocabulary = model
        for part in text_slices(batches, limit=1 << 20):
            parsed = [Page(x or "") for x in part.column("text").to_pylist()]
            odds = trees.log_odds(np.concatenate([p.features(vocabulary) for p in parsed]))
            ends = np.cumsum([len(p.tag) for p in parsed])
            texts = [p.text(p.decode(o)) for p, o in zip(parsed, np.split(odds, ends[:-1]), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for _, k in kinds), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=[*(c for c, _ in kinds), "text", "n_chars"],
            )

    picked = pages.select(*[F.col(c).alias(k) for c, k in kinds], F.col(html_col).alias("text"))
    return arrow_map(picked, run, f"{fields}, text string, n_chars long")
