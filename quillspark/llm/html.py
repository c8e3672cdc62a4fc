"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags; scripts, styles and what an element itself says is no article (menus,
headers, footers, asides, forms, and elements whose role, class or id says advert, sidebar, notice, comments and the
like) are cleaned away. The first pass labels each block that is left by its length, stop-word density and link density:
text, boilerplate, or open where it is short or says too little. An article element is one more feature: inside it a
block with many links is open, not boilerplate; outside it, where the article elements hold most of the page's dense
text, a block is boilerplate. The second pass gives each open block the label of its nearest decided neighbours: text
if both sides agree on text, the nearer one's label if they differ, text where both are as near; inside an article
element only neighbours of the same element count, and its borders are text. Where nothing was decided there is no text.

Class and id words count as whole words; a compound such as `site-footer` counts if each of its parts is such a word or
says no more than a place, so `has-sidebar` and `article-header` say nothing. A form that holds the article is no form.

Scripts, styles and the like run to the end of the page when they are not closed, as in browsers. Buttons, pictures,
players and the like are left out up to their own end tag; one that has none is passed over and what follows stays.

Null or empty html, or a page without text, gives ''. Text may be of any length. Repeated rows and ties give equal text,
each row one of its own; a null page_id or url stays null. An empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(script|style|noscript|template|textarea)(?=[\s/>])(?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>",
    re.S | re.I,
)
#: Left out with what is inside, where they are closed.
DROPPED = frozenset("svg iframe select button object canvas audio video math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ALWAYS_OUT = frozenset("nav aside form dialog menu head title footer fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SAID = re.compile(r"""([^\s"'=<>/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
OUT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: What a class or id says of an element that is no article.
OUT_WORD = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar navigation menu menubar topbar toolbar breadcrumb breadcrumbs header masthead footer sidebar aside rail widget cookie cookies consent gdpr notice alert disclaimer popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies share sharing social related recommended recommendations pagination pager search copyright".split()
)
#: What stands beside such words in compounds and says nothing else, and what may stand before comments.
PLACE_WORD = frozenset("site page main global primary secondary left right top bottom upper lower inner outer first last area bar box block container wrapper wrap section list item items group panel slot unit col column row content text links buttons posts stories form thread js".split())
COMMENTS, NOT_THERE = frozenset("comment comments commentlist disqus replies".split()), frozenset("has have with without no is hide show toggle allow enable disable can open".split())
STOP = frozenset(
    "the of and to in a is that for it was on are as with his they at be this have from or had by but not what all were we when your can said there an each which she do how their if will up other about out many then them these so some her would make like him into has he not "
    "der die das und in zu den von mit ist im für auf ein eine dem des nicht sich auch als an nach wie es aus bei am war oder sie er wir aber noch "
    "de la le les et des en un une du que qui dans pour par sur au avec est pas ce il elle sont plus ne se aux son sa ses ou mais comme "
    "el los las y del una por con para es se lo al su más como pero sus no si o este ya entre cuando todo esta ser son".split()
)
LINKS, STOPS_HIGH, STOPS_LOW, SHORT, LONG = 0.33, 0.28, 0.12, 70, 140


class Block(NamedTuple):
    text: str
    n_link: int
    place: int  # number of the article element that holds it, 0 outside of any, -1 inside boilerplate


def says_out(word: str) -> bool:
    """Does one word of a class or id say that its element is no article?"""
    if word in OUT_WORD:
        return True
    parts = [p for p in re.split(r"[^a-z]+", word) if p]
    if len(parts) < 2:
        return bool(parts) and parts[0] in OUT_WORD
    return not OUT_WORD.isdisjoint(parts) and all(p in OUT_WORD or p in PLACE_WORD for p in parts) or parts[-1] in COMMENTS and parts[0] not in NOT_THERE


def said_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in ALWAYS_OUT or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "article", "main") or tag in HEADINGS or not attributes:
        return False
    for name, value in SAID.findall(attributes.lower()):
        value = value.strip("\"'")
        if name == "role" and value in OUT_ROLE or name in ("class", "id") and any(map(says_out, value.split())):
            return not (tag == "header" and value in ("header", "banner"))
    return False


def named(m: re.Match) -> tuple[str, str, str]:
    """The slash of an end tag, the name and the attributes of a tag; no name for what else there is."""
    end, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
    return end, (tag or "").lower(), attributes


def left_out(tokens: list[re.Match]) -> dict[int, int]:
    """Where elements of DROPPED start and end; an end tag belongs to the last open start tag of its name."""
    opened: dict[str, list[int]] = {}
    out: dict[int, int] = {}
    for m in tokens:
        end, tag, attributes = named(m)
        if tag not in DROPPED:
            continue
        if not end:
            if tag not in ("svg", "math") or not attributes.endswith("/"):
                opened.setdefault(tag, []).append(m.start())
        elif opened.get(tag):
            out[opened[tag].pop()] = m.end()
    return out


def with_article(tokens: list[re.Match]) -> set[int]:
    """Where forms start that hold an article or main element."""
    opened: list[int] = []
    found: set[int] = set()
    for m in tokens:
        end, tag, _ = named(m)
        if tag == "form":
            if not end:
                opened.append(m.start())
            elif opened:
                opened.pop()
        elif tag in ("article", "main") and not end:
            found.update(opened)
    return found


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # open containers and the place of what is inside
    parts: list[str] = []
    link_parts: list[str] = []
    in_link, at, articles = 0, 0, 0

    def text(piece: str) -> None:
        if piece:
            parts.append(piece)
            if in_link:
                link_parts.append(piece)

    def close(place: int) -> None:
        # references are decoded once a block is whole, as markup may stand between their letters' neighbours
        line = " ".join(entities.unescape("".join(parts)).split())
        if line:
            out.append(Block(line, len(" ".join(entities.unescape("".join(link_parts)).split())), place))
        parts.clear()
        link_parts.clear()

    tokens = list(TOKEN.finditer(page))
    out_to, whole = left_out(tokens), with_article(tokens)
    for m in tokens:
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = out_to.get(m.start(), m.end())
        end, tag, attributes = named(m)
        if not tag or tag in DROPPED:
            continue
        place = stack[-1][1] if stack else 0
        if tag in INLINE:
            if tag == "br":
                text(" ")
            elif tag == "a":
                in_link = 0 if end else 1
            if not end and tag not in VOID and place >= 0 and tag != "a" and said_out(tag, attributes, place > 0):
                stack.append((tag, -1))
                close(place)
            elif end and stack and stack[-1] == (tag, -1):
                close(-1)
                stack.pop()
            continue
        close(place)
        in_link = 0
        if tag in VOID or attributes.endswith("/") and not end:
            continue
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag == "body":
            stack[:] = [("body", 0)]
        elif tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "option"):
            # their end tags may be missing; only one whose own attributes speak against it opens a container
            while stack and stack[-1][0] == tag:
                stack.pop()
            if place >= 0 and said_out(tag, attributes, place > 0):
                stack.append((tag, -1))
        elif place < 0 or said_out(tag, attributes, place > 0) and m.start() not in whole:
            stack.append((tag, -1))
        else:
            if tag in ("article", "main") and not place:
                articles += 1
                place = articles
            stack.append((tag, place))
    text(page[at:])
    close(stack[-1][1] if stack else 0)
    return out


def dense(block: Block) -> bool:
    """Long or with many stop words, and few links."""
    n = len(block.text)
    if n < SHORT or block.n_link > LINKS * n:
        return False
    tokens = block.text.lower().split()
    share = sum(t.strip(".,;:!?\"'()") in STOP for t in tokens) / len(tokens)
    return share >= STOPS_HIGH or n >= LONG and (share >= STOPS_LOW or not block.n_link and n >= 2 * LONG)


def first_pass(found: list[Block]) -> list[int]:
    """1 text, -1 boilerplate, 0 open, of each block that is not inside boilerplate."""
    thick = [dense(b) for b in found]
    inside = sum(len(b.text) for b, t in zip(found, thick, strict=True) if t and b.place)
    outside = sum(len(b.text) for b, t in zip(found, thick, strict=True) if t and not b.place)
    # an article without a dense block still is one where nothing outside is dense
    article = any(b.place for b in found) and inside >= outside

    def label(b: Block, t: bool) -> int:
        if not b.place and (article or b.n_link > LINKS * len(b.text) or "\xa9" in b.text and len(b.text) < LONG):
            return -1
        return int(t)

    return [label(b, t) for b, t in zip(found, thick, strict=True)]


def second_pass(labels: list[int], places: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided neighbours."""
    n = len(labels)

    def nearest(order) -> list[tuple[int, int]]:
        out, seen, last = [(0, 0)] * n, (0, 0), 0
        for i in order:
            if places[i] != last:  # the border of an article element is text to what is inside, and ends what is outside
                seen, last = (1, 0) if places[i] else (0, 0), places[i]
            seen = (labels[i], 0) if labels[i] else (seen[0], seen[1] + 1)
            out[i] = seen
        return out

    out = []
    for label, (a, da), (b, db) in zip(labels, nearest(range(n)), nearest(range(n - 1, -1, -1)), strict=True):
        decided = [x for x in ((da, a), (db, b)) if x[1]]
        out.append(label or (min(decided, key=lambda x: (x[0], -x[1]))[1] if decided else -1))
    return out


def labelled(page: str | None) -> list[tuple[Block, int, int]]:
    """The blocks that are not inside boilerplate, with their labels after the first and the second pass."""
    found = [b for b in blocks(page or "") if b.place >= 0]
    first = first_pass(found)
    return list(zip(found, first, second_pass(first, [b.place for b in found]), strict=True))


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b, _, label in labelled(page) if label > 0)


def extract(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page: a narrow job, one page in memory at a time."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for page_id, url, page in rows:
            text = main_text(page)
            yield page_id, url, text, len(text)

    return map_rows(pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), html_column), run, "page_id long, url string, text string, n_chars long")
