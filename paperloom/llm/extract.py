"""Main text of web pages by the maximum-scoring subsequence (operator 7).

A page is a sequence of words and tags. Words where articles have them score
positive; tags, and words where menus, adverts and footers have them, score negative.
One linear scan finds the contiguous region with the largest sum. The weights are
log odds counted on labelled pages, those that mark their article themselves.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 2_000  # labelled pages the weights are counted on: those of the least hashes
SAMPLE_CHARS = 200_000  # longer pages are not taken for the sample
MIN_COUNT = 5  # occurrences of a context below which its prior counts
TOP = 2.0  # the most a word scores; less than it may lose, so that a boundary holds
LOW = -6.0
TAG = -0.05  # a tag inside articles
BESIDE_WORD = -0.5  # a word of a part that is never article text

# Elements by what they do, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head iframe object svg math canvas audio video select textarea button datalist map".split())
BOILER = frozenset("nav aside footer header form menu dialog".split())
FLOW = frozenset("html body main article section div center td tr table tbody thead tfoot th blockquote figure figcaption".split())
ROOT = frozenset("html body main article".split())
BLOCK = FLOW | BOILER | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre address hr fieldset details summary caption title".split())
# Words that, as the noun of a class or id name, make it a part beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo comment comments reply replies respond disqus cookie cookies "
    "consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended sidebar "
    "side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead widget toolbar pagination pager tags skip form".split()
)
# Words that follow the noun of such a name and say nothing of their own ("related-posts", "ad-slot-2").
TAIL = frozenset(
    "area bar block box button buttons col column container content group icon icons inner item items label left link links list main "
    "outer panel post posts article articles right row section slot stories story top bottom text title unit wrap wrapper".split()
)
WITHOUT = frozenset("no has with without".split())  # "has-sidebar" tells of a part, it is none
NAMES_IT = frozenset("article entry post story content".split())  # "article-header" is the article's own
READERS = frozenset("comment comments reply replies respond disqus".split())
WRAPPERS = frozenset("form sidebar side widget modal overlay".split())  # parts that sites also wrap whole pages in
WRAPS = 0.9  # share of the paragraph words that a part holds only if it wraps the page
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
CLOSES_P = BLOCK - frozenset({"td", "th", "tr", "tbody", "thead", "tfoot", "title"})

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|math)\b(?P<rawattr>(?:[^>"']|"[^"]*"|'[^']*')*)(?<!/)>(?P<inner>.*?)(?:</(?P=raw)\s*>|\Z)
    |<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)
    |(?P<text>(?:[^<]|<(?![a-zA-Z/!?]))+|<)""",
    re.X | re.S | re.I,
)
NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    part: str  # what its tag, class, id or role makes it, if that is a part beside an article
    hidden: bool
    inside: bool  # in an article
    reader: bool  # in a part of reader comments
    paragraph: bool  # in a paragraph
    words: int = 0  # of paragraphs in it
    zone: str = ""  # nearest surrounding part
    key: str = ""
    beside: bool = False  # in a part that never belongs to an article


@dataclass(slots=True)
class Piece:
    key: str  # context whose weight counts
    words: int  # 0 for a tag
    text: str  # decoded text of a word run
    breaks: bool  # a block begins or ends here
    drop: bool  # never part of the result
    article: bool  # inside the marked article
    tag: str = ""


def part_of(name: str, inside: bool) -> str:
    """The part beside an article that one class or id name stands for, or nothing.

    The noun decides: the last word that is no mere place or box. Words before it
    only describe it, so "related-work" and "ad-free" are text, "related-posts" is not.
    """
    words = [w for w in re.split(r"[_\W]+|(?<=[a-z])(?=[A-Z])", name) if w]
    words = [w.lower() for w in words]
    at = len(words) - 1
    while at > 0 and (words[at] in TAIL or words[at].isdigit()):
        at -= 1
    if at < 0 or words[at] not in BESIDE or (at and words[at - 1] in WITHOUT):
        return ""
    if words[at] == "header" and (inside or words[0] in NAMES_IT):
        return ""  # as the header element of an article, which names it
    return words[at]


def child_of(top: Element, at: int, tag: str, attr: str) -> Element:
    """An element in the one at ``at`` of the list."""
    part, hidden = "", top.hidden or tag in HIDDEN
    if attr:
        for m in NAMED.finditer(attr):
            what, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if what in ("class", "id"):
                for name in value.split():
                    got = part_of(name, top.inside)
                    # Roots and articles are no parts, except that each reader comment may be an article.
                    if got and (tag not in ROOT or tag == "article" and got in READERS):
                        part = part or got
            elif what == "role" and value.lower() in ROLES:
                part = part or value.lower()
            elif what == "hidden" or (what == "aria-hidden" and value.lower() == "true"):
                hidden = True
    # The header of an article names it; a header of the page does not.
    if not part and tag in BOILER and not (tag == "header" and top.inside):
        part = tag
    return Element(tag, at, part, hidden, top.inside or tag == "article", top.reader or part in READERS, top.paragraph or tag == "p")


def tree(page: str) -> tuple[list[Element], list[tuple[str, int, str]]]:
    """Elements of a page, parents first, and its tokens: (what, element, text or tag). Linear in the page."""
    elements = [Element("", 0, "", False, False, False, False)]
    tokens: list[tuple[str, int, str]] = []
    stack = [0]
    # Depths of the open elements by tag, of those that are blocks, and of those an inline end tag leaves open.
    depths: dict[str, list[int]] = {}
    blocks: list[int] = []
    walls: list[int] = []

    def add(tag: str, attr: str) -> int:
        elements.append(child_of(elements[stack[-1]], stack[-1], tag, attr))
        return len(elements) - 1

    def close(depth: int) -> None:
        while len(stack) > depth:
            depths[elements[stack.pop()].tag].pop()
        for marks in (blocks, walls):
            while marks and marks[-1] >= depth:
                marks.pop()

    for m in TOKEN.finditer(page):
        text = m.group("text")
        if text is not None:
            top = elements[stack[-1]]
            if top.paragraph and not top.hidden:
                top.words += len(text.split())
            tokens.append(("text", stack[-1], text))
            continue
        raw = m.group("raw")
        if raw is not None:
            tokens.append(("raw", add(raw.lower(), m.group("rawattr")), raw.lower()))
            continue
        tag = m.group("name")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("close"):
            depth = depths[tag][-1] if depths.get(tag) else 0
            if depth and tag not in BLOCK and walls and walls[-1] > depth:
                depth = 0  # an inline end tag does not close the blocks around it
            tokens.append(("close" if depth else "lone", stack[depth] if depth else add(tag, ""), tag))
            if depth:
                close(depth)
            continue
        if (tag in CLOSES_P or tag == "li") and blocks:
            last = elements[stack[blocks[-1]]].tag
            if last == "p" or tag == "li" and last == "li":
                close(blocks[-1])
        new = add(tag, m.group("attr"))
        tokens.append(("open", new, tag))
        if tag not in VOID and not m.group("attr").endswith("/"):
            depths.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            if tag in FLOW or tag in BOILER:
                walls.append(len(stack))
            stack.append(new)
    return elements, tokens


def wrappers(elements: list[Element]) -> set[int]:
    """Elements around the article, which are no parts beside it whatever they are called.

    They hold the article element with most paragraph words (else the main element);
    comments of readers do not count. On a page without either, a form, side bar or
    the like is a wrapper if it holds nine tenths of the paragraph words.
    """
    for i in range(len(elements) - 1, 0, -1):
        elements[elements[i].parent].words += elements[i].words
    for tag in ("article", "main"):
        own = [i for i, e in enumerate(elements) if e.tag == tag and not e.reader and not e.hidden]
        if own:
            at = max(own, key=lambda i: (elements[i].words, -i))
            out = {at}
            while at:
                at = elements[at].parent
                out.add(at)
            return out
    total = elements[0].words
    return {i for i, e in enumerate(elements) if total and e.part in WRAPPERS and e.words >= WRAPS * total and not e.paragraph and not e.reader}


def pieces(page: str) -> Iterator[Piece]:
    """Words and tags of a page in order, each with its context."""
    elements, tokens = tree(page)
    around = wrappers(elements)
    for i, e in enumerate(elements):
        if i:
            top = elements[e.parent]
            e.zone, e.beside = top.zone, top.beside
            if e.part and i not in around:
                e.zone, e.beside = e.part, True
        kind = "root" if e.tag in ROOT else "flow" if not i or e.tag in FLOW or e.tag == "header" else e.tag
        e.key = f"{e.zone}>{kind}"
    article = 0
    for what, at, text in tokens:
        e = elements[at]
        if what == "text":
            yield Piece(f"w {e.key}", len(text.split()), entities.unescape(text), False, e.beside or e.hidden, article > 0)
            continue
        if what == "close" and text == "article":
            article = max(article - 1, 0)
        # The text of a raw element is never part of the result; a title belongs to the head.
        drop = what == "raw" or e.beside or e.hidden
        yield Piece(f"t {e.key}", 0, "", text in BLOCK, drop, article > 0, "/" + text if what in ("close", "lone") else text)
        if what == "open" and text == "article":
            article += 1


@dataclass
class Weights:
    """Score of a context: log odds of lying in an article, or a prior where it was hardly seen."""

    seen: dict[str, float] = field(default_factory=dict)

    def of(self, p: Piece) -> float:
        if p.drop:  # left out of the text in any case: only a long such part ends a region
            return BESIDE_WORD * max(p.words, 1)
        weight = self.seen.get(p.key)
        if weight is None:  # a part beside the article, or flow
            weight = LOW if p.key[2] != ">" else 1.0
        return p.words * weight if p.words else min(weight, TAG)


def counted(page: str) -> Counter:
    """(context, in the article) counts of a labelled page; words by number, tags by one."""
    out: Counter = Counter()
    for p in pieces(page):
        out[p.key, p.article] += p.words or (not p.text)
    return out


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Weights:
    """Weights from at most ``sample`` pages with an article element, each of at most ``sample_chars``.

    The sample is that of the least hashes. Without labelled pages all weights
    are priors: words in flow text count for the article, parts beside it against.
    """
    c = F.col(html)
    rows = pages.select(c.alias("html")).filter(c.isNotNull() & (F.length(c) <= sample_chars) & F.lower(c).contains("<article"))
    keyed = rows.withColumn("h", F.xxhash64("html"))
    # The bound is found on hashes alone; only pages below it are exchanged, copies once.
    last = keyed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    keyed = keyed.filter(F.col("h") <= F.lit(last if last is not None else 0)).groupBy("h").agg(F.min("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for page in b.column("html").to_pylist():
                total.update(counted(page))
        keys = list(total)
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([int(total[k]) for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "inside", "n"])

    parts = keyed.select("html").mapInArrow(run, "key string, inside boolean, n long")
    got = parts.groupBy("key").pivot("inside", [True, False]).agg(F.sum("n")).toDF("key", "inside", "outside")
    seen = {}
    for r in got.filter(F.coalesce("inside", F.lit(0)) + F.coalesce("outside", F.lit(0)) >= MIN_COUNT).collect():
        odds = math.log(((r["inside"] or 0) + 0.5) / ((r["outside"] or 0) + 0.5))
        seen[r["key"]] = max(min(odds, TOP), LOW)
    return Weights(seen)


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum (the first, then the shortest); (0, 0) if none is positive."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, where = total, (start, i + 1)
    return where


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best region, one per line; white space inside a block is one space."""
    run = list(pieces(page or ""))
    start, end = region([weights.of(p) for p in run])
    blocks, block = [], []
    for p in run[start:end]:
        if p.breaks:
            blocks.append("".join(block))
            block = []
        elif p.text and not p.drop:
            block.append(p.text)
        elif p.tag == "br":
            block.append(" ")
    blocks.append("".join(block))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def extracted(pages: DataFrame, weights: Weights, html: str = "html", out: str = "text") -> DataFrame:
    """All columns but the page, and ``text``: the main text of the whole page.

    Null and empty pages, and pages without words outside menus and the like, have
    an empty text. Repeated rows stay repeated; a column named as ``out`` is replaced.
    """
    keep = [c for c in pages.columns if c not in (html, out)]
    inner = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(html).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    names = [*(f"k{i}" for i in range(len(keep))), "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(p, shared.value) for p in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=names)

    fields = [f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    got = inner.mapInArrow(run, ", ".join([*fields, "text string"]))
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("text").alias(out))
