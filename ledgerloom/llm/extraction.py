"""Main text of web pages by two-pass block rules (operator 11).

A page is read once, from left to right, into blocks: runs of text that no block-level tag interrupts, each with its
place (inside an article, inside what its names call content, inside something that is never content, or none of these), its container, its share of stop words and
its share of linked characters.

First pass: place, links, length and stop words decide what they can. Blocks of an article are content, and where a page
has one, blocks outside it are not. On pages without an article, blocks of links and copyright lines are not content, and
longer blocks are if they hold enough stop words; if there are none, what stands beside a first-level heading is, or all that is ambiguous. Second pass: the ambiguous blocks, most of them short, take the label of the
nearest decided block of their container, else of the page; headings look ahead first, and between two as near the label is boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_columns, table

#: Characters from which a block is judged by its stop words; shares of stop words that show a known language and that make content; share of linked characters of a menu.
SHORT, LOW_STOPS, HIGH_STOPS, LINKED = 70, 0.1, 0.2, 0.34
#: Pages read at a time.
SLICE = 64

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is was that for it with as on be at by this are from or an not have his her were which you but they he we all one there their has will would "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "de la le et les en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son ou aux cette mais comme "
    "el y a los del las por con no su para al lo como más o pero sus ha me si sin sobre este".split()
)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag, never markup; none of it is shown as text of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that are never content; those after the bar stay so even where an article opens inside them.
NEVER = frozenset("nav header form menu dialog select button head object canvas audio video fieldset".split())
NEVER_INSIDE = frozenset(("aside", "footer"))
#: Parts of class names and ids that say the same.
CUES = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies gdpr header footer login masthead menu modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promoted promotion share sharing signup social sponsor sponsored subscribe subscription toolbar".split()
)
CUES_INSIDE = frozenset("aside comment comments commentlist discussion disqus rail recommended related replies reply respond responses sidebar widget widgets".split())
#: Roles that say so, and those that hold wherever an article opens.
ROLES, ROLES_INSIDE = frozenset("navigation banner search form dialog alert alertdialog menu".split()), frozenset(("contentinfo", "complementary"))
#: Headings that open a part which is not the article's.
CLOSING_HEADINGS = re.compile(
    r"(?:\d+ )?(?:reader )?(?:comments?|responses|replies|kommentare?|commentaires?|comentarios?|related(?: (?:articles|posts|stories|links))?|leave a (?:comment|reply)|you may also like|read more|more (?:articles|stories))"
    r"(?: \(?\d+\)?)?:?"
)

#: Parts of names of what holds a page's content, which count where there is no article.
CONTENT_CUES = frozenset("article content entry main post story".split())

#: Places of a block: none of these, in what its names call content, in an article, in what is never content, and in what stays so.
ANY, NAMED, ARTICLE, OUT, FAR_OUT = 0, 1, 2, 3, 4
CONTENT, BOILERPLATE = "content", "boilerplate"

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_NAME_PART = re.compile(r"[a-z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")


def _place(name: str, attributes: str, now: int) -> int:
    """The place inside an element that opens where the place is `now`."""
    said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(said.get("style", "")):
        return FAR_OUT
    role = said.get("role", "").strip().lower()
    names = [_NAME_PART.findall(n.lower()) for n in f"{said.get('class', '')} {said.get('id', '')}".split()] if said else []
    parts = {p for n in names if n and n[0] not in ("has", "with", "no", "without", "is") for p in n}
    if name in ("article", "main") or role in ("main", "article"):
        return FAR_OUT if now == FAR_OUT or parts & {"comment", "comments", "reply"} else ARTICLE
    if name in ("html", "body"):
        return now
    # The header of an article holds its title.
    title = now in (NAMED, ARTICLE) and (name == "header" or parts & CUES == {"header"})
    if name in NEVER_INSIDE or role in ROLES_INSIDE or parts & CUES_INSIDE:
        return FAR_OUT
    if (name in NEVER or role in ROLES or parts & CUES) and not title:
        return max(OUT, now)
    return NAMED if now == ANY and name in ("div", "section", "td") and parts & CONTENT_CUES else now


class Block:
    """Text of a page between block-level tags."""

    __slots__ = ("container", "element", "link_share", "place", "stop_share", "text")

    def __init__(self, text: str, linked: int, element: str, container: int, place: int):
        self.text, self.element, self.container, self.place = text, element, container, place
        words = _WORD.findall(text.lower())
        self.stop_share = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        self.link_share = min(linked / len(text), 1.0)


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, all white space inside a block as one space, character references decoded."""
    found: list[Block] = []
    # Open elements: name, place inside, number.
    opened = [("", ANY, 0)]
    names: Counter = Counter()
    number = at = 0
    linked, in_link, pieces, link_pieces = 0, False, [], []

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            name, place, _ = opened[-1]
            box = next((e for e in reversed(opened[-3:]) if e[0] not in HEADINGS and e[0] not in ("p", "li")), opened[0])
            if name in HEADINGS and place < OUT and CLOSING_HEADINGS.fullmatch(text.lower()):
                place = FAR_OUT
                # What follows in the heading's container belongs to it.
                holder = len(opened) - 2
                opened[holder] = (opened[holder][0], FAR_OUT, opened[holder][2])
            found.append(Block(text, sum(len(" ".join(p.split())) for p in link_pieces), name, box[2], place))
        pieces.clear()
        link_pieces.clear()

    def say(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if in_link:
                link_pieces.append(text)

    def close(name: str) -> None:
        while names[name]:
            last = opened.pop()[0]
            names[last] -= 1
            if last == name:
                return

    while (m := _TAG.search(page, at)) is not None:
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCKS or names[name]:
                flush()
            if name == "a":
                in_link = False
            elif name == "br":
                pieces.append(" ")
            if names[name]:
                close(name)
                if name in ("li", "td", "ul", "ol", "nav", "section", "article"):
                    in_link = False
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW:
            end = re.compile(f"</{name}\\b[^>]*(?:>|\\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCKS:
            flush()
            if opened[-1][0] == "p" or opened[-1][0] == name == "li" or opened[-1][0] in ("dd", "dt") and name in ("dd", "dt"):
                close(opened[-1][0])
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = True
        if name in VOID or attributes.endswith("/"):
            continue
        place = _place(name, attributes, opened[-1][1])
        if name in BLOCKS or name in NEVER or place != opened[-1][1]:
            # An inline element that is never content is a block of its own.
            if name not in BLOCKS and place != opened[-1][1]:
                flush()
            number += 1
            opened.append((name, place, number))
            names[name] += 1
    say(page[at:])
    flush()
    return found


def decided(blocks: list[Block]) -> list[str | None]:
    """First pass: the label of each block, None where it is ambiguous."""
    # What names call content decides only if it holds a longer block.
    long_named = any(b.place == NAMED and len(b.text) >= SHORT for b in blocks)
    place = ARTICLE if any(b.place == ARTICLE for b in blocks) else NAMED if long_named else ANY
    # Where no block has stop words enough, the language is another one, and length alone decides.
    known = any(b.stop_share >= LOW_STOPS and len(b.text) >= SHORT for b in blocks)
    out: list[str | None] = []
    for b in blocks:
        if b.place != place and not (place == ANY and b.place == NAMED):
            out.append(BOILERPLATE)
        elif place != ANY:
            out.append(BOILERPLATE if b.element == "li" and b.link_share > LINKED else CONTENT)
        elif b.link_share > LINKED or "©" in b.text:
            out.append(BOILERPLATE)
        else:
            out.append(CONTENT if len(b.text) >= SHORT and (b.stop_share >= HIGH_STOPS or not known) else None)
    if CONTENT not in out:
        titled = {b.container for b in blocks if b.element == "h1" and b.place <= NAMED}
        out = [CONTENT if label is None and (not titled or b.container in titled) else label for b, label in zip(blocks, out, strict=True)]
    return out


def inherited(blocks: list[Block], labels: list[str | None]) -> list[str]:
    """Second pass: ambiguous blocks take the label of the nearest decided one."""

    def nearest(order: range) -> list[tuple]:
        # For each block the last decided place before it in that order: of its container, and of the page.
        by_container: dict = {}
        last, out = None, [(None, None)] * len(blocks)
        for k in order:
            out[k] = (by_container.get(blocks[k].container), last)
            if labels[k]:
                by_container[blocks[k].container] = last = k
        return out

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    out = []
    for k, (block, label) in enumerate(zip(blocks, labels, strict=True)):
        if not label:
            ahead = block.element in HEADINGS and after[k][1]
            sides = [s for s in ((before[k][0], after[k][0]), (before[k][1], after[k][1])) if s != (None, None)][:1]
            if ahead:
                label = labels[ahead]
            elif sides:
                near = [s for s in sides[0] if s is not None]
                least = min(abs(s - k) for s in near)
                said = {labels[s] for s in near if abs(s - k) == least}
                label = CONTENT if said == {CONTENT} else BOILERPLATE
        out.append(label or BOILERPLATE)
    return out


BLOCK_TYPE = "array<struct<text:string,element:string,stop_share:double,link_share:double,first_label:string,label:string>>"


def page_blocks(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as page_id, url and `blocks`: each with its text, element, shares, the label of the first pass (null: ambiguous) and its label.

    Null and empty html: no blocks. Rows that share a page_id each have their own. Pages of any length; other columns are not read.
    """

    def begin():
        def work(ids: pa.Array, urls: pa.Array, texts: pa.Array) -> Iterator[list[pa.Array]]:
            rows, upto = [], [0]
            for text in texts.to_pylist():
                blocks = read_blocks(text or "")
                first = decided(blocks)
                rows += [(b.text, b.element, b.stop_share, b.link_share, f, label) for b, f, label in zip(blocks, first, inherited(blocks, first), strict=True)]
                upto.append(len(rows))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string()]
            names = ["text", "element", "stop_share", "link_share", "first_label", "label"]
            fields = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            yield [ids, urls, pa.ListArray.from_arrays(pa.array(np.array(upto, dtype=np.int32)), fields)]

        return work

    return map_columns(pages.select(F.col("page_id").cast("long"), "url", "html"), begin, f"page_id bigint, url string, blocks {BLOCK_TYPE}", SLICE)


def main_text(blocks: Column) -> Column:
    """The content blocks in page order, joined by one space; empty if there are none."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b.label == CONTENT), lambda b: b.text), " ")


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    text = page_blocks(table(spark, sf_dir, "pages")).select("page_id", "url", main_text(F.col("blocks")).alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op11_page_text": op11_page_text}
