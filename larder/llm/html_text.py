"""Main text of HTML pages by two passes over blocks.

Elements that never hold the article (navigation, headers, footers, asides, forms, scripts) are left out while a page is read, and
so are containers that their class or id names as adverts, notices, comments and the like, unless most of the text, or
of the marked article, is in them. The first pass decides each block from stop-word density, length and link density. That
a page marks its article is one more sign, if the marked part holds no less good text than the rest: then a block in it is
bad for its links only, and one outside is bad. In the second pass ambiguous blocks take the label of their nearest
decided neighbours; the edge of a marked article counts as good, and that of a page decides nothing. Blocks of a page where
nothing is decided are good.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import COMMON_WORDS
from .words import portions, texts

#: One tag, comment or declaration. Atomic: a quote counts only after an equals sign, and nothing is tried twice.
TAG = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<(/?)([A-Za-z][^\s/>]*+)((?>[^>=]+|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: HTML's elements by role.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "search", "input"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
#: Words of class and id names that mark what isn't the article.
MARKS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended recommendations "
    "comment comments disqus respond reply replies login signup search pagination pager widget widgets tagcloud".split()
)
ARTICLE_MARKS = {"articlebody", "article-body", "entry-content", "post-content", "article-content"}
STOP_WORDS = frozenset(w for listed in COMMON_WORDS.values() for w in listed) | frozenset(
    "with as be are this by he at or from not but have an they which her his she will there their were been has more when who so no if out up into them some could than "
    "auf für als auch es an dem ein eine nicht im aus werden bei oder sind vor wie nach wird war um am haben nur über noch einen mehr "
    "dans pour qui par au ne se pas plus sur ce avec il sont ou sa son aux cette mais nous ses elle leur était y a été être tout comme "
    "por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son".split()
)
#: Thresholds of the block rules. Lengths and links are the published ones (fixed values); the densities are lower, as they are published for
#: lists of several hundred stop words a language, and STOP_WORDS holds some fifty.
SHORT, LONG, LOW, HIGH, LINKS = 70, 200, 0.15, 0.20, 0.2
#: What may stand around a word.
AROUND = ".,;:!?\"'()#*$%&|<>"
#: The share of linked text from which a block within the marked article is a menu.
MENU = 0.8
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose end tag may be missing: one ends where the next begins.
UNCLOSED = {"p", "li", "td", "th", "tr", "dt", "dd", "option"}


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    article: bool = False
    doubt: int = -1
    kind: str = ""
    text: str = ""


@dataclass
class Open:
    """An open element; doubt: the innermost doubtful container; block: the place of the innermost block element."""

    tag: str
    dropped: bool
    article: bool
    doubt: int
    block: int


class Stack:
    """Open elements, and for each tag the places where it is open, so that an end tag costs no search."""

    def __init__(self):
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = {}

    def push(self, o: Open) -> None:
        self.places.setdefault(o.tag, []).append(len(self.open))
        self.open.append(o)

    def cut(self, depth: int) -> None:
        while len(self.open) > depth:
            self.places[self.open.pop().tag].pop()

    def last(self, tag: str) -> int | None:
        found = self.places.get(tag)
        return found[-1] if found else None

    @property
    def top(self) -> Open:
        return self.open[-1] if self.open else Open("", False, False, -1, -1)


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def is_dropped(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    return attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))


def is_doubtful(tag: str, attrs: dict[str, str]) -> bool:
    """Whether the names of an element say that it isn't the article."""
    if not attrs or tag in ("html", "body", "main"):
        return False
    names = re.split(r"[\s_-]+|(?<=[a-z])(?=[A-Z])", f"{attrs.get('class', '')} {attrs.get('id', '')}")
    return any(n.lower() in MARKS for n in names)


def blocks(source: str) -> list[Block]:
    """The blocks of a page in order, without those of elements that never hold the article and of doubtful containers."""
    found: list[Block] = []
    stack, doubts = Stack(), []  # doubts: of each doubtful container the one around it, and whether it is within the article
    now, links, at = Block(), 0, 0

    def close(heading: bool = False) -> None:
        nonlocal now
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            found.append(now)
        top = stack.top
        now = Block(article=top.article, doubt=top.doubt, heading=heading or any(o.tag in HEADINGS for o in stack.open[-3:]))

    def add(raw: str) -> None:
        if raw and not stack.top.dropped:
            text = html.unescape(raw)
            now.parts.append(text)
            if links:
                now.linked += len(text.strip())

    while m := TAG.search(source, at):
        add(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            depth = stack.last(tag)
            if depth is None:
                continue
            if tag in BLOCK:
                if stack.open[depth].dropped:
                    now = Block()
                else:
                    close()
                stack.cut(depth)
                close()
            elif stack.top.block < depth:  # an inline end tag doesn't close blocks
                stack.cut(depth)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if tag == "a":
            links += 1
        if tag in BLOCK:
            close()
            links = 0
            if tag in UNCLOSED:
                i = stack.top.block
                while tag == "tr" and i >= 0 and stack.open[i].tag in ("td", "th"):
                    i = stack.open[i - 1].block if i else -1
                if i >= 0 and stack.open[i].tag == tag:
                    stack.cut(i)
            if tag in ("article", "main") and stack.last("nav") is not None:
                stack.cut(stack.places["nav"][0])
        attrs = attributes(m[3]) if m[3] else {}
        outer = stack.top
        says = tag in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop", "").lower() == "articlebody" or bool(ARTICLE_MARKS & set(attrs.get("class", "").lower().split()))
        dropped = outer.dropped or is_dropped(tag, attrs, outer.article)
        doubt = outer.doubt
        if not dropped and is_doubtful(tag, attrs):
            doubts.append((doubt, outer.article))
            doubt = len(doubts) - 1
        depth = len(stack.open)
        stack.push(Open(tag, dropped, (outer.article or says) and not dropped, doubt, depth if tag in BLOCK else outer.block))
        if tag in BLOCK:
            now = Block(article=stack.top.article, doubt=doubt, heading=tag in HEADINGS)
        elif doubt != outer.doubt:  # the text before an inline container isn't in it
            close()
    add(source[at:])
    close()
    return _without_doubtful(found, doubts)


def _without_doubtful(found: list[Block], doubts: list[tuple[int, bool]]) -> list[Block]:
    """Blocks that are in no doubtful container, but for those that hold over half of the marked text, or of all if none is marked.

    A container within the article, as comments are, must hold nine tenths of it. One of little text must hold all.
    """
    if not doubts:
        return found
    counted = [b.article for b in found] if any(b.article for b in found) else [True] * len(found)
    held = [0] * len(doubts)
    for b, counts in zip(found, counted, strict=True):
        if counts and b.doubt >= 0:
            held[b.doubt] += len(b.text)
    for i in range(len(doubts) - 1, -1, -1):
        if doubts[i][0] >= 0:
            held[doubts[i][0]] += held[i]
    total = sum(len(b.text) for b, counts in zip(found, counted, strict=True) if counts)
    dropped = [False] * len(doubts)
    for i, (outer, inside) in enumerate(doubts):
        little = held[i] < min(LONG, total)
        dropped[i] = little or held[i] <= total * (0.9 if inside else 0.5) or outer >= 0 and dropped[outer]
    return [b for b in found if b.doubt < 0 or not dropped[b.doubt]]


def first_pass(b: Block) -> str:
    """good, near (good), weak, short or bad, from the block alone; weak: too few stop words, yet no links."""
    length, words = len(b.text), b.text.lower().split()
    if b.linked / max(1, length) > LINKS or "\xa9" in b.text or "&copy" in b.text:
        return "bad"
    if length < SHORT:
        return "bad" if b.linked else "short"
    stops = sum(w.strip(AROUND) in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= HIGH:
        return "good" if length > LONG else "near"
    return "near" if stops >= LOW else "bad" if b.linked else "weak"


def nearest(found: list[Block], side: range) -> list[tuple[int, str]]:
    """How far the nearest decided block on one side of each is, and its kind; empty if there is none."""
    out, at, kind = [(len(found), "")] * len(found), 0, ""
    for i in side:
        if kind:
            out[i] = (abs(i - at), kind)
        if found[i].kind not in ("short", "weak"):
            at, kind = i, "bad" if found[i].kind == "bad" else "good"  # a near-good block counts as one that is good
    return out


def classify(found: list[Block]) -> list[Block]:
    """The blocks of the main text."""
    for b in found:
        b.kind = first_pass(b)
    text = {inside: sum(len(b.text) for b in found if b.article == inside and b.kind not in ("short", "bad")) for inside in (True, False)}
    marked = any(b.article for b in found) and text[True] >= text[False]
    if marked:
        for b in found:
            if not b.article:
                b.kind = "bad"
            elif b.kind == "weak" or b.kind == "bad" and b.linked <= MENU * len(b.text):
                b.kind = "near"
        return _within(found)
    before, after = (nearest(found, side) for side in (range(len(found)), range(len(found) - 1, -1, -1)))
    kinds = []
    for b, left, right in zip(found, before, after, strict=True):
        if b.kind in ("good", "bad"):
            kinds.append(b.kind)
        elif b.heading:
            kinds.append(right[1] or left[1] or "good")
        elif b.kind == "near":
            kinds.append("bad" if left[1] == right[1] == "bad" else "good")
        elif b.article:  # in an article that isn't trusted, a teaser for instance
            kinds.append("good" if left[1] == right[1] == "good" else "bad")
        else:
            close = min(left[0], right[0])
            beside = {kind for far, kind in (left, right) if far == close}
            kinds.append("bad" if beside == {"bad"} else "good")
    return [b for b, kind in zip(found, kinds, strict=True) if kind == "good"]


def _within(found: list[Block]) -> list[Block]:
    """The blocks of the main text of a page that marks its article; its edges are good."""
    beside = [["", ""] for _ in found]
    for side, order in ((0, range(len(found))), (1, range(len(found) - 1, -1, -1))):
        kind, was_inside = "bad", False
        for i in order:
            if found[i].article != was_inside:
                was_inside = found[i].article
                kind = "good" if was_inside else "bad"
            beside[i][side] = kind
            if found[i].kind != "short":
                kind = "bad" if found[i].kind == "bad" else "good"
    for b, (left, right) in zip(found, beside, strict=True):
        if b.kind in ("short", "near"):
            b.kind = right if b.heading else "bad" if left == right == "bad" else "good"
    return [b for b in found if b.kind == "good"]


def main_text(source: str) -> str:
    return "\n".join(b.text for b in classify(blocks(source)))


def extract(pages: DataFrame, key: str = "page_id", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, keep..., text, n_chars) of every row of pages(html): the main text, its blocks joined by line feeds.

    A null or empty html gives an empty text. The kept columns are carried along, null or not. Repeated rows stay. An empty
    table gives none. Pages are worked through one at a time, whole, in parallel; nothing is shuffled. The time a page
    takes grows with its length, however its elements are nested.
    """
    carried = [key, *keep]
    kinds = {c: pages.schema[c].dataType.simpleString() for c in carried}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "html", 4 << 20):
            out = [main_text(t.decode("utf-8", "replace")) for t in texts(batch.column("html"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"c{i}") for i in range(len(carried))), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [*(f"c{i}" for i in range(len(carried))), "text", "n_chars"])

    rows = pages.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carried)), F.col("html").cast("string").alias("html"))
    schema = ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(carried)) + ", text string, n_chars long"
    return rows.mapInArrow(run, schema).toDF(*carried, "text", "n_chars")


def op3_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
