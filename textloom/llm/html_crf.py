"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks, in page order: runs of text between the boundaries of block elements. Features of a block are the tags and
class words of its ancestors, its own tag, its length, link share, punctuation and place. The chain labels each block as article or not;
the Viterbi labels decide.

Training takes a bounded sample of pages and labels blocks by page structure: text in article or main elements, outside menus, adverts,
forms, comments and the like, is article. Each sampled page is also set in other templates, with plain divisions, other class words,
notices, sidebars, forms and comments whose texts come from sampled pages, so that no single template or element decides.

Pages of more than SAMPLE_LENGTH characters are extracted like all others, but not trained on. Where no sampled page has a structure to learn from,
every block counts as article.

Null and empty pages give an empty text. Cut-off pages and tags, missing end tags and unknown elements are accepted. Long and deeply nested pages
take time in proportion to their length, as the ancestors of a place are held as counts. Equal pages give equal texts; rows with equal or null ids
and repeated rows are extracted one by one. An empty table gives an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import crf
from textloom.llm import textscan as ts
from textloom.llm.shared import hash_sample

SAMPLE_PAGES = 400
VARIANTS = 3
SAMPLE_BLOCKS = 80  # blocks of a training sequence; longer pages give the blocks around their label changes
SAMPLE_LENGTH = 1_000_000

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template svg iframe object title noscript textarea select canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
IMPLIED_END = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dd": frozenset({"dd", "dt"}), "dt": frozenset({"dd", "dt"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
CLOSES_P = BLOCKS - {"button", "label", "legend", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
TELLING = BLOCKS - {"html", "body", "div", "p"}  # ancestors that are features
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words in class, id and role values, and the kind of region that they speak for.
REGION_WORDS = {
    "menu": ("nav", "menu", "breadcrumb", "toc", "tabs", "pager", "pagination"),
    "advert": ("ad", "ads", "advert", "advertisement", "adsense", "promo", "sponsor", "sponsored", "banner", "teaser"),
    "footer": ("footer", "foot", "copyright", "legal", "imprint", "contentinfo"),
    "header": ("header", "masthead", "topbar", "logo", "branding"),
    "sidebar": ("sidebar", "aside", "widget", "related", "recommended", "complementary", "rail", "popular"),
    "notice": ("cookie", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "disclaimer", "warning"),
    "form": ("form", "search", "login", "signup", "register", "input"),
    "comments": ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "reviews"),
    "share": ("share", "social", "tags", "meta", "byline", "author"),
    "article": ("article", "content", "post", "entry", "story", "main", "body", "text", "prose"),
}
_REGION = {w: k for k, words in REGION_WORDS.items() for w in words}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<[/A-Za-z][^<]*\Z""", re.DOTALL)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z]+")
MARK = "data-article"


@dataclass
class Block:
    text: str
    tag: str
    path: frozenset[str]  # tags of its ancestors
    regions: frozenset[str]
    linked: int
    marked: bool


@dataclass
class _Open:
    tag: str
    regions: frozenset[str] = frozenset()
    marked: bool = False


class _Names:
    """How often each name is open, and the set of open names, made anew only when it changes."""

    def __init__(self):
        self.counts: dict[str, int] = {}
        self._open: frozenset[str] | None = frozenset()

    def add(self, name: str, by: int) -> None:
        before = self.counts.get(name, 0)
        self.counts[name] = before + by
        if not before or not before + by:
            self._open = None

    def open(self) -> frozenset[str]:
        if self._open is None:
            self._open = frozenset(n for n, c in self.counts.items() if c)
            self.counts = {n: self.counts[n] for n in self._open}
        return self._open

    def __contains__(self, name: str) -> bool:
        return self.counts.get(name, 0) > 0


def regions_of(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    found = set()
    for m in _NAMED.finditer(attributes):
        for word in _PART.findall((m[2] or m[3] or m[4] or "").lower()):
            if word in _REGION:
                found.add(_REGION[word])
    return frozenset(found)


@dataclass
class _Parser:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    holders: list[str] = field(default_factory=list)  # the open block elements
    tags: _Names = field(default_factory=_Names)
    regions: _Names = field(default_factory=_Names)
    marks: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def flush(self) -> None:
        if not self.parts:
            return
        raw = "".join(self.parts)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        self.parts.clear()
        linked, self.linked = self.linked, 0
        if text:
            self.blocks.append(Block(text, self.holders[-1] if self.holders else "body", self.tags.open(), self.regions.open(), linked, self.marks > 0))

    def text(self, value: str) -> None:
        if value:
            self.parts.append(value)
            if "a" in self.tags:
                self.linked += len(value)

    def close(self, tags: frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        """Close the innermost of these elements and all inside it, unless stop comes first."""
        if not any(t in self.tags for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in tags:
                if any(o.tag in BLOCKS for o in self.stack[i:]):
                    self.flush()
                for gone in self.stack[i:]:
                    self._count(gone, -1)
                del self.stack[i:]
                return
            if self.stack[i].tag in stop:
                return

    def _count(self, element: _Open, by: int) -> None:
        self.tags.add(element.tag, by)
        for r in element.regions:
            self.regions.add(r, by)
        self.marks += by * element.marked
        if element.tag in BLOCKS:
            if by > 0:
                self.holders.append(element.tag)
            else:
                self.holders.pop()

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES_P:
                self.close(frozenset({"p"}), BLOCKS - {"p"})
            if tag in IMPLIED_END:
                self.close(IMPLIED_END[tag], frozenset({"ul", "ol", "dl", "table", "select", "div", "section", "article"}))
        if tag not in VOID:
            self.stack.append(_Open(tag, regions_of(attributes), MARK in attributes))
            self._count(self.stack[-1], 1)


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; text of scripts, styles and other skipped elements is none."""
    parser, at, n = _Parser(), 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            parser.text(page[at:])
            break
        parser.text(page[at : m.start()])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                parser.close(frozenset({tag}))
            elif tag in SKIPPED:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else n
            else:
                parser.open(tag, m[3])
    parser.flush()
    return parser.blocks


def _bucket(n: int) -> int:
    return min(n.bit_length(), 9)


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of every block of a page."""
    total, out = len(blocks), []
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        names = [f"own={b.tag}", f"words={_bucket(words)}", f"links={4 * b.linked // max(len(b.text), 1)}", f"end={b.text[-1] if b.text[-1] in '.!?:;,' else '-'}", f"third={3 * i // total}"]
        names += [f"in={t}" for t in sorted(b.path & TELLING)]
        names += [f"region={r}" for r in sorted(b.regions)]
        if b.text[0] in "©":
            names.append("copyright")
        out.append(names)
    return out


_OUTSIDE = frozenset({"nav", "aside", "footer", "form", "header", "menu", "button", "dialog"})
_BOILER = frozenset({"menu", "advert", "footer", "sidebar", "notice", "form", "comments"})


def structural_labels(blocks: list[Block]) -> list[int]:
    """1 for text that the page's own structure marks as article."""
    return [int(("article" in b.path or "main" in b.path) and not _OUTSIDE & {*b.path} and not _BOILER & b.regions) for b in blocks]


def restyled(content: list[Block], other: list[Block], spare: list[str], rng: np.random.Generator) -> str:
    """The article blocks of a page in another template; boilerplate comes from the page's own and from spare texts."""

    def pick(*options: str) -> str:
        return options[int(rng.integers(len(options)))]

    def some(low: int, high: int) -> list[str]:
        return [spare[int(rng.integers(len(spare)))] for _ in range(int(rng.integers(low, high)))] if spare else []

    def wrapped(start: str, inner: list[str], tag: str) -> str:
        name = start.split()[0]
        return f"<{start}>" + "".join(f"<{tag}>{html.escape(t)}</{tag}>" for t in inner) + f"</{name}>"

    def cut(texts: list[str]) -> list[str]:
        return [" ".join(t.split()[: int(rng.integers(3, 30))]) for t in texts]

    menu = [b.text for b in other if "nav" in b.path or b.linked] or cut(some(2, 6))
    parts = []
    if rng.random() < 0.5:
        parts.append(wrapped(pick('div class="cookie-notice"', 'div id="consent"', 'div role="alert"', 'div class="popup newsletter"', 'section class="notice"'), cut(some(1, 3)), pick("p", "span", "div")))
    if rng.random() < 0.6:
        parts.append(wrapped(pick("header", 'div class="masthead"', 'div id="header"', 'header class="site-header"'), cut(some(1, 3)), pick("h1", "p", "h2", "div")))
    parts.append("".join((f"<{(s := pick('nav', 'div class=\"menu\"', 'div id=\"navbar nav\"', 'ul class=\"nav\"'))}>", "<ul>" * (s[:2] != "ul"), *(f'<li><a href="/x">{html.escape(t)}</a></li>' for t in menu), "</ul>" * (s[:2] != "ul"), f"</{s.split()[0]}>")))
    adverts = [wrapped(pick('div class="ad"', 'div class="promo banner"', 'aside class="sponsored"', 'div id="ads"'), cut(some(1, 3)), pick("p", "span", "div")) for _ in range(int(rng.integers(0, 3)))]
    if adverts:
        parts.append(adverts.pop())
    start = pick("article", "main", 'div class="content"', 'div class="post-body"', 'div id="story"', 'div class="entry-content"', 'section class="article-text"', "div", "section")
    inner = []
    for i, b in enumerate(content):
        tag = b.tag if b.tag in HEADINGS or b.tag in ("li", "blockquote", "pre", "td") else pick("p", "p", "p", "p", "div")
        inner.append(f"<{tag} {MARK}>{html.escape(b.text)}</{tag}>")
        if adverts and rng.random() < 0.2:
            inner.append(adverts.pop())
    parts.append(f"<{start}>" + "".join(inner) + f"</{start.split()[0]}>")
    if rng.random() < 0.5:
        parts.append(wrapped(pick('section class="comments"', 'div id="comments"', 'div class="discussion replies"', 'ol class="comment-list"'), some(1, 6), pick("p", "div", "li")))
    if rng.random() < 0.5:
        parts.append(wrapped(pick("aside", 'div class="sidebar"', 'div class="related widget"', 'aside id="rail"'), cut(some(1, 5)), pick("p", "li", "h3", "div")))
    if rng.random() < 0.4:
        parts.append(wrapped(pick('form action="/s"', 'form class="search"', 'div class="login form"'), cut(some(1, 4)), pick("label", "p", "div", "button")))
    parts.append(wrapped(pick("footer", 'div class="footer"', 'div id="legal"', 'footer class="site"'), [*cut(some(0, 2)), "© " + " ".join(cut(some(1, 2)))], pick("p", "div", "span")))
    return "<html><body>" + "".join(parts) + "</body></html>"


@dataclass
class Model:
    features: dict[str, int]
    chain: crf.Chain

    def labels(self, blocks: list[Block]) -> np.ndarray:
        """Viterbi labels of the blocks of a page."""
        w = self.chain.weights
        e = np.empty((len(blocks), w.shape[1]))
        for i, names in enumerate(block_features(blocks)):
            e[i] = w[[0, *(self.features[n] for n in names if n in self.features)]].sum(axis=0)
        return self.chain.decode(e)


def _around_changes(labels: list[int]) -> list[int]:
    """Indexes of at most SAMPLE_BLOCKS blocks: all, or the two halves around the first and last article block."""
    n, half = len(labels), SAMPLE_BLOCKS // 4
    if n <= SAMPLE_BLOCKS:
        return list(range(n))
    ones = [i for i, y in enumerate(labels) if y] or [0]
    keep = {i for c in (ones[0], ones[-1]) for i in range(max(0, c - half), min(n, c + half))}
    return sorted(keep)


def fit_pages(pages: list[str], variants: int = VARIANTS, seed: int = 11) -> Model:
    """A chain from sampled pages, labelled by structure and set in other templates."""
    rng = np.random.default_rng(seed)
    parsed = [leaf_blocks(p) for p in pages]
    spare = [b.text for blocks in parsed for b in blocks][:20_000]
    names: list[list[list[str]]] = []
    gold: list[list[int]] = []
    for blocks in parsed:
        y = structural_labels(blocks)
        if not any(y):
            continue
        sets = [(blocks, y)]
        content, other = [b for b, k in zip(blocks, y) if k][:SAMPLE_BLOCKS], [b for b, k in zip(blocks, y) if not k]
        for _ in range(variants):
            made = leaf_blocks(restyled(content, other, spare, rng))
            sets.append((made, [int(b.marked) for b in made]))
        for own, labels in sets:
            f, keep = block_features(own), _around_changes(labels)
            names.append([f[i] for i in keep])
            gold.append([labels[i] for i in keep])
    index = {f: i + 1 for i, f in enumerate(sorted({f for s in names for t in s for f in t}))}
    if not names:
        return Model({}, crf.Chain(np.array([[0.0, 1.0]]), np.zeros((2, 2)), np.zeros(2)))
    features, lengths = crf.padded([[[index[f] for f in t] for t in s] for s in names], max(len(t) for s in names for t in s))
    y = np.zeros(features.shape[:2], dtype=np.int64)
    for i, g in enumerate(gold):
        y[i, : len(g)] = g
    return Model(index, crf.fit(features, lengths, y, len(index), epochs=15, batch=64, rate=0.05, l2=1e-3))


def fit(pages: DataFrame, page: str = "html", key: str = "page_id") -> Model:
    """A model from SAMPLE_PAGES pages at most, of SAMPLE_LENGTH characters at most, chosen by hash of their id."""
    known = pages.select(F.col(key).alias("sample_id"), F.col(page).cast("string").alias("html")).where(F.length("html") <= SAMPLE_LENGTH)
    ids = hash_sample(known.select("sample_id").distinct(), "sample_id", SAMPLE_PAGES)
    chosen = known.join(F.broadcast(ids), "sample_id").select("html", "sample_id")
    rows = chosen.dropDuplicates(["sample_id"]).orderBy("sample_id").collect()  # SAMPLE_PAGES rows of SAMPLE_LENGTH characters at most
    return fit_pages([r["html"] for r in rows])


def main_text(page: str | None, model: Model) -> tuple[str, int, int]:
    """The article text, the number of blocks and of article blocks."""
    blocks = leaf_blocks(page or "")
    if not blocks:
        return "", 0, 0
    kept = [b.text for b, y in zip(blocks, model.labels(blocks)) if y]
    return "\n".join(kept), len(blocks), len(kept)


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in ts.slices(batches, "html"):
            made = [main_text(p, model) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=[*b.schema.names[:-1], "text", "n_blocks", "n_kept"])

    return run


def extract_main_text(pages: DataFrame, model: Model, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The keep columns, text, n_chars (code points), n_blocks, n_kept. One scan, no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    source = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(page).cast("string").alias("html"))
    kinds = [f.dataType.simpleString() for f in source.schema.fields[:-1]]
    made = source.mapInArrow(_extract(shared), ", ".join([*(f"k{i} {t}" for i, t in enumerate(kinds)), "text string, n_blocks long, n_kept long"]))
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")
