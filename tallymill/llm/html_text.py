"""Main text of web pages by rules over blocks, in two passes.

The page is cut into blocks (what stands between block-level tags). The first pass decides by stop-word density,
length and link density, and by the element a block stands in; the second lets short blocks that the first could not
decide inherit the label of their nearest decided neighbours, within the article or outside it.

Defined cases: a null or empty page gives an empty text and 0 characters; unclosed and stray tags, comments and
unclosed scripts are accepted; time is linear in the page's length; null ids and urls are kept; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.frames import pieces

# fixed values: frequent function words of English, French, German and Spanish
STOP_WORDS = frozenset(
    """
    the of and to in a is that it for on was be with as by are this from or an at not but have has had were which their
    will would can there been if more when who what so no we you he she they his her its our your about into than then
    le la les de des du un une et est en que qui dans pour pas sur au aux avec ce cette ces se sa son ses il elle ils
    elles nous vous je ne plus par ou où mais comme sont été être avoir leur leurs on y à
    der die das und ist im den dem des ein eine einer einem einen nicht mit von zu auf für als auch sich er sie es wir
    ihr ich an bei aus nach wie oder aber wenn noch nur war sind hat werden wird so über am zum zur durch
    el los las y del al lo una por con para su sus es son como más pero se le ha han este esta estos estas o muy sin
    sobre también ya entre cuando todo ser fue
    """.split()
)
# fixed values: element names and words in class, id and role that mark what is no main text
SILENT = frozenset("script style noscript template svg math title textarea select button iframe object canvas audio video map datalist".split())
ASIDE = frozenset("nav footer aside form header menu dialog fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent"
    " disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup"
    " promo promoted promotion related respond share sharing sidebar side signup social sponsor sponsored subscribe subscription"
    " teaser toolbar tracking widget complementary contentinfo search alert announcement replies reply".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FRAMED = frozenset("article main nav header footer h1".split())

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.30
LINKS = 0.33
#: Below this share of stop words in all its running text, a page is in none of the listed languages.
FOREIGN = 0.05

#: Attributes up to the end of a tag. Quotes count behind an equals sign only; nothing is tried twice, so time is linear.
_REST = r"(?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+"
#: Raw text up to the literal end tag comes first: what looks like tags in it is none.
_TOKEN = re.compile(
    r"(?P<raw><(?P<of>(?i:script|style|textarea|title|xmp|iframe|noembed|noframes))(?=[\s/>])" + _REST + r"(?<!/)>"
    r".*?(?:</(?i:(?P=of))(?=[\s/>])[^>]*+(?:>|\Z)|\Z))|<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z][^\s<>/]*+" + _REST + r">|[^<]+|<",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s>/]*)")
_HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Classes that say what a page has or allows, not what the element is.
_STATE = re.compile(r"(?:has|no|with|without|is)[-_]|.*[-_](?:open|opened|closed|enabled|disabled|on|off)$", re.I)
_EDGE = re.compile(r"^\W+|\W+$")
_HREF = re.compile(r"\shref\s*=", re.I)
#: Letters of scripts that write a word with one or two of them.
_DENSE = re.compile(r"[\u2e80-\ud7ff\uf900-\ufaff]")
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u0964\u061f]")


@dataclass
class Block:
    text: str
    linked: int
    inside: int  # number of the article or main element around it, 0 outside
    aside: bool
    heading: bool
    label: str = ""


def _hinted(tag: str) -> bool:
    for found in _HINT.finditer(tag):
        value = next(v for v in found.groups() if v is not None)
        if any(w.lower() in HINTS for v in value.split() if not _STATE.match(v) for w in _WORD.findall(v)):
            return True
    return False


@dataclass
class Tag:
    name: str
    closing: bool
    text: str
    alone: bool  # ends in "/>"
    closed: bool = False  # has an end tag of its own
    frame: bool = False  # a form around parts of a page, not around fields only


def _tokens(page: str) -> list[str | Tag]:
    """Text and tags in page order, with what is known of each start tag's end."""
    found: list[str | Tag] = []
    open_: dict[str, list[Tag]] = {}
    for token in _TOKEN.finditer(page):
        if token["raw"]:
            continue
        piece = token.group()
        if piece[0] != "<" or len(piece) == 1:
            found.append(piece)
            continue
        matched = _NAME.match(piece)
        if matched is None:
            continue
        tag = Tag(matched.group(1).lower(), piece[1] == "/", piece, piece.endswith("/>"))
        found.append(tag)
        waiting = open_.setdefault(tag.name, [])
        if tag.closing:
            if waiting:
                waiting.pop().closed = True
        elif not tag.alone or tag.name == "a":
            if tag.name == "a":
                waiting.clear()  # a link ends where the next one begins
            waiting.append(tag)
        if tag.name in FRAMED:
            for form in open_.get("form", ())[-1:]:
                form.frame = True
    return found


def blocks_of(page: str, outer_hints: bool = True) -> list[Block]:
    """Blocks in page order; what silent elements hold is left out. Without ``outer_hints``, a hint counts only within
    another hinted element.

    A link without an end tag, and a silent element without one, end at the next block. A form without an end tag, or
    around an article, a main element, navigation or a first heading, is the frame of a page and no aside; another
    aside element without an end tag ends where an article or main element begins.
    """
    found: list[Block] = []
    open_: list[list] = []  # name, aside, article, a hint passed over, an aside without an end
    names: Counter[str] = Counter()
    asides = passes = endless = 0
    parts: list[str] = []
    links: list[str] = []
    within: list[int] = []
    articles, skip, heading = 0, "", False
    link: Tag | None = None
    hushed = False

    def end() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            linked = len(" ".join(html.unescape("".join(links)).split()))
            found.append(Block(text, linked, within[-1] if within else 0, asides > 0, heading))
        parts.clear()
        links.clear()

    def leave() -> str:
        nonlocal asides, passes, endless
        name, aside, article, passed, unended = open_.pop()
        names[name] -= 1
        asides, passes, endless = asides - aside, passes - passed, endless - unended
        if article:
            within.pop()
        return name

    for tag in _tokens(page):
        if isinstance(tag, str):
            if not skip and not hushed:
                parts.append(tag)
                if link is not None:
                    links.append(tag)
            continue
        name = tag.name
        if skip:
            if tag.closing and name == skip:
                skip = ""
            continue
        if name in SILENT:
            if not tag.closing and not tag.alone:
                skip, hushed = (name, hushed) if tag.closed else ("", True)
            continue
        if name in BLOCKS:
            end()
            hushed = False
            if link is not None and not link.closed:
                link = None
        elif name == "br":
            parts.append(" ")
            continue
        if name == "a":
            link = None if tag.closing or not _HREF.search(tag.text) else tag
            continue
        if tag.closing:
            if names[name]:
                while leave() != name:
                    pass
        elif name not in VOID and not tag.alone:
            if name in ("p", "li", "tr", "td", "th", "dt", "dd") and open_ and open_[-1][0] == name:
                leave()
            if name in ("article", "main") and endless:
                for entry in open_:
                    if entry[4]:
                        entry[1] = entry[4] = False
                        asides -= 1
                endless = 0
            hinted = "=" in tag.text and name not in ("html", "head", "body") and _hinted(tag.text)
            passed = hinted and not outer_hints and not passes
            hinted = hinted and not passed
            main = name in ("article", "main") and not hinted and not asides
            aside = hinted or (name in ASIDE and not (name == "header" and within))
            if name == "form" and (tag.frame or not tag.closed):
                aside = hinted
            unended = aside and name in ASIDE and not hinted and not tag.closed
            if main:
                articles += 1
                within.append(articles)
            open_.append([name, aside, main, passed, unended])
            names[name] += 1
            asides, passes, endless = asides + aside, passes + passed, endless + unended
        if name in BLOCKS:
            heading = name in HEADINGS and not tag.closing
    end()
    return found


def stop_density(text: str) -> float:
    words = [_EDGE.sub("", w) for w in text.lower().split()]
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def _foreign(blocks: list[Block]) -> bool:
    """Whether the page's running text is in none of the languages of ``STOP_WORDS``."""
    texts = [b.text for b in blocks if not b.aside and not b.heading and b.linked <= LINKS * len(b.text) and _SENTENCE.search(b.text)]
    return stop_density(" ".join(texts)) < FOREIGN


def decide(blocks: list[Block]) -> list[Block]:
    """Labels all blocks ``good`` or ``bad``.

    On a page in none of the listed languages, length and link density of blocks with sentences decide.
    """
    has_article = any(b.inside for b in blocks)
    foreign = not has_article and _foreign(blocks)
    for b in blocks:
        size, link = len(b.text), b.linked / max(len(b.text), 1)
        if foreign:
            size += 2 * len(_DENSE.findall(b.text))
        if b.aside or (has_article and not b.inside) or (link > LINKS and not b.heading):
            b.label = "bad"
        elif b.heading or size < SHORT:
            b.label = "short"
        elif foreign:
            b.label = "bad" if not _SENTENCE.search(b.text) else "good" if size >= LONG else "short"
        else:
            stop = stop_density(b.text)
            if b.inside or (stop >= STOP_HIGH and size >= LONG):
                b.label = "good"
            elif stop >= STOP_LOW:
                b.label = "short" if size < LONG and stop < STOP_HIGH else "good"
            else:
                b.label = "bad"
    first = [b.label for b in blocks]
    after = list(_nearest(blocks, first, range(len(blocks) - 1, -1, -1)))[::-1]
    for k, before in enumerate(_nearest(blocks, first, range(len(blocks)))):
        b = blocks[k]
        if b.label == "short":
            b.label = _inherited(b, first, k, before, after[k])
    return blocks


def _nearest(blocks: list[Block], first: list[str], order: range) -> Iterator[int | None]:
    """For each block in ``order``, the last decided one before it in the same element."""
    last: dict[int, int] = {}
    for k in order:
        yield last.get(blocks[k].inside)
        if first[k] != "short" and not blocks[k].aside:
            last[blocks[k].inside] = k


def _inherited(block: Block, first: list[str], k: int, before: int | None, after: int | None) -> str:
    """The label of the nearest decided neighbour in the same element; a tie goes to the one that follows."""
    if block.inside:
        return "good"
    if before is None and after is None:
        return "good" if stop_density(block.text) >= STOP_LOW else "bad"
    if before is None or (after is not None and after - k <= k - before):
        return first[after]
    return first[before]


def main_text(page: str) -> str:
    blocks = decide(blocks_of(page))
    texts = [b.text for b in blocks if b.label == "good"]
    if not texts and any(b.aside for b in blocks):
        # a hint on a container of everything: the rules for blocks decide
        texts = [b.text for b in decide(blocks_of(page, outer_hints=False)) if b.label == "good"]
    return "\n".join(texts)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = [main_text(p) if p else "" for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
