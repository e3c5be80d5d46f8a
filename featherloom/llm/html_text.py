"""Main-text extraction from HTML by two-pass block rules.

A page is read once, tag by tag. Block-level tags part its text into blocks; each block
knows its words, the letters inside links, and the elements around it. The first pass
weighs each block: length, stop-word density and the form of a sentence speak for text,
link density and long runs without stop words against it; an article or main element
around it speaks for it, elements and names of menus, footers, adverts, forms, notices or
comments against it. Names count whole (``class="comments"``, ``"cookie-notice"``); a
token that only holds such a word among others (``"legal-analysis"``) weighs little.
Blocks of clear weight are decided; the others, mostly short ones, get in the second pass
the label of the nearest decided neighbour within the same region of the page: of text if
two are equally near and the block is inside an article, ends as a sentence or heads text.

Stop words are those of eight languages; of scripts without spaces two letters count as a
word, and particles as stop words. On a page of no known language blocks that end as
sentences take the place of blocks rich in stop words.

Cases. Null and empty pages give an empty text, as do pages without text. A page of any
length or depth is read whole, in time that grows with its length; a page cut off inside
a tag loses that tag only. Elements that are never closed end with their parent. White
space is any Unicode white space. Null ids and urls and extra columns pass through;
repeated rows each get a row; empty tables give empty results.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words from which on a block's stop words count; densities above and below which they speak for text and against it.
LONG, STOP_RICH, STOP_POOR = 15, 0.10, 0.04
#: Share of letters in links from which on a block is taken for links; words of a sentence.
LINK_DENSITY, SENTENCE = 0.5, 5
#: Weights of the evidence, and the sums from which on a block is text, or boilerplate.
INSIDE, LENGTH, RICH, POOR, LINKED, LINKED_SENTENCE, RIGHTS = 1, 1, 2, -3, -4, -2, -6
NAMED_WEIGHT, HINT_INSIDE, HINT_OUTSIDE = -6, -1, -2
TEXT_FROM, BOILERPLATE_TO = 2, -2
#: Share of stop words in a page from which on its language counts as known.
KNOWN = 0.04

STOP_WORDS = frozenset(
    "the of and to in is that for it as was with be by on are this from or an at not "
    "le la les de des du un une et en est que qui dans pour par sur avec au aux "
    "der die das und ist von zu den dem mit im ein eine sich auf für nicht als auch "
    "el los las y del con para se su al lo il di che non per una sono da "
    "o os um uma não em do na com het een van niet op te zijn voor och att det som på är av "
    "и в не на что с по как это к из у".split()
)
#: Particles of scripts without spaces.
PARTICLES = frozenset("のはをがにでともへ的了是在不和有人这我")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
ENDS = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u0964\u061f][\"'\u2019\u201d\u00bb)\]]*$")
RIGHTS_MARK = re.compile(r"\s*(?:\u00a9|\(c\)|copyright\b)|.*\ball rights reserved\b", re.I | re.S)

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
MUTE = frozenset("head svg math canvas object audio video select datalist button dialog applet map".split())
#: Elements that are boilerplate with all they hold.
ASIDE = frozenset("nav footer aside form menu".split())
MAIN = frozenset("article main".split())
#: Elements that keep a place in the stack of open elements.
HOLDERS = frozenset(
    "html body div section article main header hgroup nav footer aside form menu ul ol dl li dt dd table thead tbody tfoot tr td th "
    "caption blockquote figure figcaption fieldset details summary address pre center a".split()
) | MUTE
BLOCKS = (HOLDERS - {"a"}) | frozenset("p h1 h2 h3 h4 h5 h6 hr legend option title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that name boilerplate.
NAMED = frozenset(
    "ad ads adsbygoogle adbox adslot advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar sidenav menu menubar "
    "nav navbar navigation navigator breadcrumb breadcrumbs footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login search social share sharing related recommended recommendations "
    "widget widgets pagination pager paging comment comments commentlist reply replies respond disqus discussion disclaimer copyright legal "
    "contentinfo complementary dialog form skip tags tagcloud rail teaser teasers".split()
)
#: Words that may stand beside those in a name, which then still names boilerplate as a whole.
FILLERS = frozenset(
    "site page global user users reader readers post posts article articles content main primary secondary sub top bottom left right list lists item items "
    "box bar wrap wrapper container section block area slot unit inner outer panel region group row col column body header head title text link links button buttons "
    "btn icon count thread threads form input field module component card cards view bottom sticky fixed floating mobile desktop google dfp gpt law info policy message "
    "msg settings accept dismiss more all to it and js ui id the children tree author meta entry".split()
)
#: Named boilerplate only outside an article, whose own heading may bear the name.
OUTSIDE = frozenset("header banner".split())
HIDDEN = re.compile(r"(?:^|[\s;])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
WORD = re.compile(r"[^\W\d_]+")


class _Open:
    """An open element: its name, and what holds for all within it."""

    __slots__ = ("hints", "inside", "link", "mute", "name", "out", "region")

    def __init__(self, name, out, hints, mute, inside, link, region):
        self.name, self.out, self.hints, self.mute, self.inside, self.link, self.region = name, out, hints, mute, inside, link, region


def _names(value: str, inside: bool) -> tuple[bool, bool]:
    """(names boilerplate, holds such a word among others) for a class, id or role."""
    named = hinted = False
    for token in value.split():
        for words in ([w.lower() for w in PARTS.findall(token)], [w for w in re.split(r"[^a-z]+", token.lower()) if w]):
            found = [w in NAMED or not inside and w in OUTSIDE for w in words]
            if any(found):
                whole = all(f or w in FILLERS or w.isdigit() or len(w) == 1 for f, w in zip(found, words, strict=True))
                named, hinted = named or whole, hinted or not whole
    return named, hinted


def _boilerplate(attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """(boilerplate by its names, a hint of it, not shown) for an element's attributes."""
    named = hinted = hidden = False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            whole, part = _names(value, inside)
            named, hinted = named or whole, hinted or part
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
            hidden = True
    return named, hinted, hidden


class _Block:
    """A block's text, its letters inside links, and what the elements around it say."""

    __slots__ = ("heading", "hints", "inside", "linked", "out", "region", "text")

    def __init__(self, text, linked, out, hints, inside, region, heading):
        self.text, self.linked, self.out, self.hints, self.inside, self.region, self.heading = text, linked, out, hints, inside, region, heading


def blocks(page: str) -> list[_Block]:
    """The page's blocks of text, in order."""
    found: list[_Block] = []
    stack = [_Open("", False, 0, False, False, False, 0)]
    open_: Counter[str] = Counter()  # so that no end tag looks for an element that is not open
    held: list[str] = []
    linked, heading, regions, at, n = 0, False, 0, 0, len(page)

    def flush():
        nonlocal linked
        if held:
            top = stack[-1]
            if text := " ".join("".join(held).split()):
                found.append(_Block(text, linked, top.out, top.hints, top.inside, top.region, heading))
            held.clear()
        linked = 0

    def say(run: str):
        nonlocal linked
        top = stack[-1]
        if run and not top.mute:
            run = html.unescape(run)
            held.append(run)
            if top.link:
                linked += len(run.strip())

    while at < n:
        m = TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[1]:
            continue
        name, closing = m[1].lower(), page[m.start() + 1] == "/"
        if name in BLOCKS:
            flush()
            heading = name in HEADINGS and not closing
        elif name == "br":
            held.append(" ")
        if closing:
            while open_[name]:
                if name == "a" and stack[-1].name in BLOCKS:
                    break
                open_[last := stack.pop().name] -= 1
                if last == name:
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name not in HOLDERS or m[2].endswith("/") and name in MUTE:
            continue
        top = stack[-1]
        if top.name == name and (name == "a" or name in ("li", "dt", "dd", "tr", "td", "th")):
            open_[stack.pop().name] -= 1
            top = stack[-1]
        named, hinted, hidden = _boilerplate(m[2], top.inside) if m[2].strip() else (False, False, False)
        main, whole = name in MAIN, name in ("html", "body", "a")
        out = top.out or name in ASIDE or name == "header" and not top.inside or named and not whole
        if main:
            regions += 1
        open_[name] += 1
        hints = min(2, top.hints + (hinted and not whole))
        stack.append(_Open(name, out, hints, top.mute or name in MUTE or hidden, top.inside or main, name == "a" or top.link and not main, regions if main else top.region))
    flush()
    return found


def _measure(text: str) -> tuple[int, int]:
    """Words and stop words of a text."""
    words = WORD.findall(text)
    letters = UNSPACED.findall(text)
    if not letters:
        return len(words), sum(w.lower() in STOP_WORDS for w in words)
    spaced = [x for w in words for x in UNSPACED.split(w) if x]
    return len(spaced) + (len(letters) + 1) // 2, sum(w.lower() in STOP_WORDS for w in spaced) + sum(x in PARTICLES for x in letters)


def weights(found: list[_Block]) -> list[int]:
    """The first pass: the sum of the evidence for each block."""
    measured = [_measure(b.text) for b in found]
    total = sum(n for n, _ in measured)
    known = sum(stop for _, stop in measured) >= KNOWN * total
    out = []
    for b, (n, stop) in zip(found, measured, strict=True):
        sentence = n >= SENTENCE and ENDS.search(b.text) is not None
        rich = stop >= STOP_RICH * n if known else sentence
        w = INSIDE * b.inside + NAMED_WEIGHT * b.out + b.hints * (HINT_INSIDE if b.inside else HINT_OUTSIDE)
        if n >= LONG:
            w += LENGTH + RICH * rich + POOR * (known and stop < STOP_POOR * n)
        if b.linked > LINK_DENSITY * len(b.text):
            w += LINKED_SENTENCE if sentence and rich else LINKED
        if not b.inside and RIGHTS_MARK.match(b.text):
            w += RIGHTS
        out.append(w)
    return out


def labels(found: list[_Block]) -> list[bool]:
    """Whether each block is main text."""
    sums = weights(found)
    decided = [True if w >= TEXT_FROM else False if w <= BOILERPLATE_TO else None for w in sums]
    n, far = len(found), 1 << 60

    def nearest(order):
        """Distance and label of the last decided block of the same region, along ``order``."""
        out, seen = [(far, False)] * n, {}
        for k in order:
            if decided[k] is not None:
                # what is boilerplate by its element says nothing about text in an article
                if not (found[k].inside and found[k].out):
                    seen[found[k].region] = (k, decided[k])
            elif found[k].region in seen:
                j, label = seen[found[k].region]
                out[k] = (abs(k - j), label)
        return out

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    out = []
    for k, b in enumerate(found):
        if decided[k] is not None:
            out.append(decided[k])
            continue
        (d, x), (e, y) = before[k], after[k]
        if d == e == far:
            label = b.inside or sums[k] > 0  # nothing near it is decided: its own evidence, however little
        elif d == e and x != y:
            label = b.inside or b.heading and y or ENDS.search(b.text) is not None
        else:
            label = x if d < e else y
        if b.heading and not b.inside and e < far:
            label = y  # a heading goes with what it heads
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    """The main text of one page: its blocks, joined by two newlines."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def _extract(batches):
    for batch in batches:
        text = [main_text(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["row", "text"])


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The columns of ``pages`` other than the html, and the main text of each page."""
    small_batches(pages.sparkSession)
    names = {c: f"c{k}" for k, c in enumerate(pages.columns) if c not in (html_col, text_col)}
    source = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(f"`{html_col}`").cast("string").alias("html"))
    packed = source.select(F.struct(*names.values(), F.lit(0).alias("pad")).alias("row"), "html")
    done = packed.mapInArrow(_extract, f"row {packed.schema['row'].dataType.simpleString()}, text string")
    return done.select(*(F.col(f"row.{n}").alias(c) for c, n in names.items()), F.col("text").alias(text_col))
