"""Main text of web pages by two passes over text blocks.

The first pass classifies each block by its stop-word density, length and link density, and by the containers it
stands in.  The second gives every short or undecided block the label of its nearest decided neighbours.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_text, prepare, struct_array

SHORT_CHARS = 70
LONG_CHARS = 200
MAX_LINK_DENSITY = 0.33
STOP_LOW = 0.10
STOP_HIGH = 0.20
STOP_KNOWN = 0.03  # share of stop words from which on a page's language counts as known

# Frequent function words of the languages to expect; a parameter of `extract`.
STOP_WORDS = frozenset(
    """
    the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
    de la le les et des en un une du que est pour qui dans il au par sur pas plus ne ce avec se son
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass
    el los y las del se por con no su para es al lo como más o pero sus ha me si sin sobre este ya
    """.split()
)

_BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol optgroup option
    p pre section select summary table tbody td tfoot th thead title tr ul
    """.split()
)
_CONTAINERS = frozenset(
    "article aside body button dialog div fieldset figure footer form header html main menu nav ol section select table td tr ul".split()
)
_NEVER_TEXT = frozenset("script style noscript template iframe textarea select svg math object canvas title head".split())
_BOILERPLATE_TAGS = frozenset("nav aside footer form menu dialog button select".split())
_CONTENT_TAGS = frozenset(("article", "main"))
_BOILERPLATE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|aside|nav|navbar|navigation|menu"
    r"|breadcrumbs?|header|masthead|footer|foot|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|comments?"
    r"|commentlist|disqus|replies|respond|reactions?|share|sharing|social|related|recommend\w*|newsletter|subscri\w*"
    r"|signup|login|search|widgets?|pagination|pager|toolbar|disclaimer|copyright|skip)(?=$|[\s_-])"
)
# What says only how a container is laid out or what state it is in, and a widget of a page builder.
_MODIFIER = re.compile(
    r"(?:^|(?<=[\s_-]))(?:has|with|without|no)[_-]\S*|\S+[_-](?:open|closed|enabled|disabled|visible|hidden|active)(?=$|\s)"
    r"|(?<=\w[_-])widget(?=$|[\s_-])"
)
# Containers of these names hold no article, however much text they hold.
_NEVER_ARTICLE = re.compile(
    r"\s*(?:\S*[_-])?(?:comments?|commentlist|disqus|replies|respond|reactions?|related|recommend\w*|cookies?|consent|gdpr)(?=$|[\s_-])"
)
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)", re.S
)
_IN_TAG = re.compile(r"[<>\"']")
_NO_QUOTES = re.compile(r"[^<>]*>")
_OPENS_VALUE = re.compile(r"=\s{0,8}\Z")
_AFTER_VALUE = re.compile(r"[\s/>]")
_ATTRIBUTE = re.compile(r"(?<![A-Za-z-])([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    link_chars: int
    boilerplate: bool
    content: int  # number of the article or main element that holds the block; 0 outside
    heading: bool
    label: str = ""
    region: int = 0
    counted: tuple[int, int] | None = None  # stop words and words, once asked for

    def stops(self, stop_words: frozenset[str]) -> tuple[int, int]:
        if self.counted is None:
            self.counted = _stops(self.text, stop_words)
        return self.counted


@dataclass
class _Open:
    tag: str
    region: int
    content: int


@dataclass
class _Region:
    """A container that looks like boilerplate, or (tag set) an article or main element inside one."""

    above: int
    sure: bool
    tag: str = ""
    near: bool = False  # holds an article or main element or stands in one
    stops: int = 0
    boilerplate: bool = False


class _Ends:
    """Ends of the tags of a page.  A quote that led to no end is not followed again, so all take linear time."""

    def __init__(self, page: str) -> None:
        self.page, self.dead, self.last = page, set(), {q: page.rfind(q) for q in "\"'"}

    def of(self, at: int) -> int:
        """The place behind the tag whose name ends at `at`; -1 if there is none.

        A quoted value reaches over a `<` if it is short, or if it stands as a value does: behind a `=`, and with
        white space, a slash or the end of the tag behind it.
        """
        page, start, seen = self.page, at, []
        while (m := _IN_TAG.search(page, at)) and m.start() not in self.dead:
            i, c = m.start(), m.group()
            if c == ">":
                return i + 1
            seen.append(i)
            if c == "<" or self.last[c] <= i:
                break
            end = page.find(c, i + 1)
            if end - i > 401 and page.find("<", i, end) >= 0:
                if not (_OPENS_VALUE.search(page[max(start, i - 9) : i]) and _AFTER_VALUE.match(page, end + 1)):
                    break
            at = end + 1
        self.dead.update(seen)
        plain = _NO_QUOTES.match(page, start)
        return plain.end() if plain else -1


def _boilerplate(tag: str, attrs: str, inside_content: bool) -> str:
    """sure, maybe (it may still hold the article) or nothing."""
    if tag in _BOILERPLATE_TAGS or (tag == "header" and not inside_content):
        return "maybe" if tag == "form" else "sure"
    if tag in ("html", "body", *_CONTENT_TAGS) or not attrs or "=" not in attrs:
        return ""
    found = ""
    for name, *values in _ATTRIBUTE.findall(attrs):
        value = "".join(values).lower()
        if name.lower() in ("class", "id"):
            if tag == "header" and inside_content:
                continue
            if _BOILERPLATE_NAME.search(_MODIFIER.sub(" ", value)):
                if _NEVER_ARTICLE.match(_MODIFIER.sub(" ", value)):
                    return "sure"
                found = "maybe"
        elif name.lower() == "role" and value in _BOILERPLATE_ROLES:
            if value != "form":
                return "sure"
            found = "maybe"
    return found


def _stops(text: str, stop_words: frozenset[str]) -> tuple[int, int]:
    """How many words of a text are stop words, and how many there are."""
    words = _WORD.findall(text.lower())
    return sum(w in stop_words for w in words), len(words)


def knows_language(blocks: list[Block], stop_words: frozenset[str]) -> bool:
    """Whether the page's text outside links has a fair share of the stop words; if not, they say nothing about it."""
    counts = [b.stops(stop_words) for b in blocks if b.link_chars <= MAX_LINK_DENSITY * len(b.text)]
    return sum(n for n, _ in counts) >= STOP_KNOWN * sum(words for _, words in counts)


def _settle_regions(blocks: list[Block], regions: list[_Region], stop_words: frozenset[str]) -> None:
    """Which blocks are boilerplate by their containers.

    A container that only may be boilerplate is none if it holds most stop words of the page, unless all articles are
    elsewhere.  Inside one, an article that has no fewer of them than the articles outside is no boilerplate, and a main
    element never is.  On a page whose language is unknown, characters count instead of stop words.
    """
    if len(regions) > 1:
        outside = whole = 0
        anywhere = not any(b.content for b in blocks)
        known = knows_language(blocks, stop_words)
        for block in blocks:
            if block.link_chars <= MAX_LINK_DENSITY * len(block.text):
                n = block.stops(stop_words)[0] if known else len(block.text)
                whole += n
                regions[block.region].stops += n
                if not block.region and block.content:
                    outside += n
        for region in reversed(regions[1:]):
            regions[region.above].stops += region.stops
            regions[region.above].near |= region.near
        for region in regions[1:]:
            above = regions[region.above]
            if region.tag:
                region.sure = above.sure and region.tag != "main"
                kept = region.tag == "main" or (not above.sure and region.stops >= outside)
                region.boilerplate = above.boilerplate and not kept
            else:
                region.boilerplate = above.boilerplate or region.sure or 2 * region.stops <= whole or not (anywhere or region.near)
                region.sure = region.sure or above.sure
    for block in blocks:
        block.boilerplate = regions[block.region].boilerplate


def split_blocks(page: str, stop_words: frozenset[str] = STOP_WORDS) -> list[Block]:
    """Text blocks of a page in order, with references decoded and white space collapsed; never-shown elements left out."""
    blocks: list[Block] = []
    regions = [_Region(0, False)]
    ends = _Ends(page)
    stack: list[_Open] = [_Open("", 0, 0)]
    open_of: dict[str, int] = {}
    unclosed: set[str] = set()
    text: list[str] = []
    links: list[str] = []
    in_link = heading = False
    contents = breaks = 0

    def end_block() -> None:
        nonlocal text, links, breaks
        whole = _SPACE.sub(" ", references.unescape("".join(text))).strip()
        if whole:
            linked = _SPACE.sub(" ", references.unescape("".join(links))).strip()
            blocks.append(Block(whole, len(linked), False, stack[-1].content, heading, region=stack[-1].region))
        text, links, breaks = [], [], 0

    def add(piece: str) -> None:
        nonlocal breaks
        if piece:
            text.append(piece)
            if in_link:
                links.append(piece)
            if breaks and not piece.isspace():
                breaks = 0

    at = look = 0
    size = len(page)
    while at < size:
        found = _MARKUP.search(page, look)
        if not found:
            add(page[at:])
            break
        tag, end = found["name"], found.end()
        if tag:
            end = ends.of(found.end())
            if end < 0:
                look = found.start() + 1
                continue
        add(page[at : found.start()])
        at = look = end
        if not tag:
            continue
        tag = tag.lower()
        closing = bool(found["close"])
        attrs = page[found.end() : end - 1]
        if tag in _NEVER_TEXT and not closing:
            if tag == "head" or attrs.rstrip().endswith("/"):
                continue
            end = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end:
                at = look = end.end()
            elif tag in ("script", "style"):
                at = size
            else:
                unclosed.add(tag)
            if tag in _BLOCK_TAGS:
                end_block()
            continue
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            breaks += 1
            if breaks == 2:
                end_block()
            else:
                text.append(" ")
        elif tag in _BLOCK_TAGS:
            end_block()
            in_link = False
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            if tag not in _CONTAINERS:
                continue
            if not closing:
                above = stack[-1]
                if tag in _CONTENT_TAGS and not above.content:
                    contents += 1
                    inside = contents
                else:
                    inside = above.content
                region = above.region
                if kind := _boilerplate(tag, attrs, bool(above.content)):
                    regions.append(_Region(region, kind == "sure", near=bool(above.content)))
                    region = len(regions) - 1
                elif region and tag in _CONTENT_TAGS:
                    regions.append(_Region(region, False, tag, near=True))
                    region = len(regions) - 1
                stack.append(_Open(tag, region, inside))
                open_of[tag] = open_of.get(tag, 0) + 1
            elif open_of.get(tag):
                while True:
                    last = stack.pop()
                    open_of[last.tag] -= 1
                    if last.tag == tag:
                        break
    end_block()
    _settle_regions(blocks, regions, stop_words)
    return blocks


def first_pass(block: Block, stop_words: frozenset[str] = STOP_WORDS, known: bool = True) -> str:
    """good, bad, near (probably good), short or open (undecided) by the block alone.

    Where the page's language is not `known`, length and link density decide as if stop words were dense enough.
    """
    if block.boilerplate:
        return "bad"
    size = len(block.text)
    if block.link_chars > MAX_LINK_DENSITY * size:
        return "bad"
    if size < SHORT_CHARS:
        return "short"
    stops, words = block.stops(stop_words)
    share = stops / max(1, words) if known else 1.0
    if share >= STOP_HIGH:
        return "good" if size > LONG_CHARS else "near"
    if share >= STOP_LOW:
        return "near"
    return "open" if block.content else "bad"


def _counts(block: Block) -> bool:
    """Whether a block's label says something about its neighbours: not if its container alone decided it."""
    return block.label == "good" or (block.label == "bad" and not block.boilerplate and not block.content)


def _settle(blocks: list[Block], kinds: tuple[str, ...]) -> None:
    """Label the blocks of these kinds by their nearest decided neighbour on either side in the same content element."""
    sides: list[list[tuple[int, str]]] = [[] for _ in blocks]
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        nearest: dict[int, int] = {}
        for i in order:
            block = blocks[i]
            if block.label in kinds and block.content in nearest:
                at = nearest[block.content]
                sides[i].append((abs(i - at), blocks[at].label))
            if _counts(block):
                nearest[block.content] = i
    for block, known in zip(blocks, sides):
        if block.label == "near":
            block.label = "bad" if [label for _, label in known] == ["bad", "bad"] else "good"
        elif block.label in kinds:
            edge = "good" if block.content else "bad"
            block.label = min(known, key=lambda k: (k[0], k[1] != "good"), default=(0, edge))[1]


def second_pass(blocks: list[Block]) -> None:
    """Settle the undecided blocks by their nearest decided neighbours, on both sides, in the same content element.

    Near blocks, which come first, become good unless both neighbours are bad.  Short and open ones then take the
    label of the nearer neighbour (good if both are as near).  One without a decided neighbour is good inside an
    article or main element and bad outside.
    """
    _settle(blocks, ("near",))
    _settle(blocks, ("short", "open"))


def main_text(page: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The main text of one page: its good blocks in order, one a line."""
    blocks = split_blocks(page or "", stop_words)
    known = knows_language([b for b in blocks if not b.boilerplate], stop_words)
    for block in blocks:
        block.label = first_pass(block, stop_words, known)
    second_pass(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract_text(stop_words: frozenset[str] = STOP_WORDS) -> Callable[[Column], Column]:
    """A column function from html to struct(text, n_chars)."""

    def make() -> Callable[[list[str | None]], pa.Array]:
        def apply(pages: list[str | None]) -> pa.Array:
            texts = [main_text(p, stop_words) for p in pages]
            return struct_array(_RESULT.names, [pa.string(), pa.int64()], [texts, [len(t) for t in texts]])

        return apply

    return per_text(make, _RESULT)


def extract(pages: DataFrame, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per page, from its whole html.

    Null html counts as empty and gives empty text; repeated rows and null ids give a row each; other columns are not
    read; an empty table gives no rows.
    """
    prepare(pages.sparkSession)
    return pages.select("page_id", "url", extract_text(stop_words)(F.col("html")).alias("r")).select("page_id", "url", "r.*")
