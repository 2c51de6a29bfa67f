"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; a block knows its length, its share of characters inside links, its
share of stop words, whether it is a heading, and the region it stands in (outside, an article, or one that its tag,
role, class or id marks as menu, header, footer, sidebar, notice, advert, form or comments).

Pass 1, each block alone: a high share of links or a marked region is boilerplate; long text with enough stop words is
content, inside an article or not, and so is any long text of a page in a language that the stop words (English, French,
German, Spanish) are not of. The rest is open: headings, short blocks, long ones with few stop words, and in an article
also a linked sentence (enough stop words, ending like one).
Pass 2: open blocks take the label of the nearest decided neighbour of their region, a tie going to content; headings look
forward first. A region with nothing decided is content if it is an article, else not.

Character references are decoded, white space of a block becomes one space, blocks are joined by a newline. Broken markup is
read leniently: end tags without a start are ignored, a paragraph, list item, row or cell ends with the next one or with its
parent, a link goes on through blocks up to its end tag, or to the end of its block if it has none, and what else is never
closed ends with the page.

Null or empty html gives an empty text; very long pages go whole, in time linear in them. Repeated rows, and rows of one
page_id or without one: a row each. Two decided neighbours that are equally far: see pass 2. Extra columns are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import collections
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import common as C

LONG, MOST_LINKS, ENOUGH_STOPS = 70, 0.5, 0.15
#: The share of a page's long text, in words, that must have enough stop words for the page to be in a known language.
KNOWN = 0.2
#: A tag's attributes end at the first `>` outside quotes, or where quotes are not balanced, at the first `>`; no backtracking.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s></]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>|[^<>]*+>)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title", "canvas", "audio", "video", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: The next begin or end of a link, and the ends of elements whose contents are no text.
LINK = re.compile(r"<(/?)a(?=[\s>/])", re.I | re.A)
RAW_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
BLOCK_TAGS = set("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag ends although its end tag is missing, and the elements that such a search stops at.
NEAR = BLOCK_TAGS - {"li", "dt", "dd", "option", "address", "div", "p", "label", "legend"}
IMPLIED = {
    "li": ({"li"}, NEAR),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, NEAR)),
    "option": ({"option"}, NEAR),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr"}, {"table"})),
}
#: Elements that the search for an end tag's start stops at, and block tags that may stand in a paragraph.
PARENTS = {"li": {"ul", "ol", "menu", "dir", "table", "td", "th"}, **dict.fromkeys(("dt", "dd"), {"dl", "table", "td", "th"}), **dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot"), {"table"})}
IN_PARAGRAPH = {"label", "legend", "option", "button"}
AROUND = BLOCK_TAGS - IN_PARAGRAPH
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MARKED_TAGS = {"nav", "footer", "aside", "form", "menu", "head", "dialog", "button", "fieldset", "label", "legend"}
MARKED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
MARKED_NAMES = set("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments respond disqus cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager copyright disclaimer".split())
STOPS = frozenset("the of and to in is that it was for on are as with his they at be this have from or had by not but what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into has a i he you de la le et les des en un une du que est pour qui dans par sur au avec pas plus ce se ne il elle son der die und den das von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei el los las una por con no su para al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos".split())


@dataclass
class Block:
    text: str
    links: int
    region: int  # number of the innermost region
    marked: bool
    article: bool
    heading: bool


def is_marked(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in MARKED_TAGS or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in MARKED_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and not MARKED_NAMES.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    blocks: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, region, marked, article
    parts: list[str] = []
    links = regions = 0
    in_link = through = heading = False

    def end() -> None:
        nonlocal links
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            _, region, marked, article = stack[-1]
            blocks.append(Block(text, min(links, len(text)), region, marked, article, heading))
        parts.clear()
        links = 0

    opened: collections.Counter[str] = collections.Counter()

    def leave(tags: set[str], stops: set[str]) -> None:
        """Close the innermost open element of `tags` that is not beyond one of `stops`, and all inside it."""
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                opened.subtract(x[0] for x in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in stops:
                return

    at = 0
    while (m := TOKEN.match(page, at)) is not None:
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                parts.append(m[0])
                if in_link:
                    links += len(m[0].strip())
            continue
        tag, closing = tag.lower(), m[1] == "/"
        if tag in RAW:
            if not closing and not m[3].endswith("/>"):
                stop = RAW_ENDS[tag].search(page, at)
                at = stop.start() if stop else len(page)
                parts.append(" ")
            continue
        if tag == "a":
            in_link = not closing
            if in_link:  # with an end tag of its own it goes on through blocks
                nearest = LINK.search(page, at)
                through = nearest is not None and nearest[1] == "/"
            continue
        if tag not in BLOCK_TAGS:
            if tag == "br":
                parts.append(" ")
            continue
        end()
        if tag in HEADINGS:
            heading = not closing
        in_link = in_link and through
        if closing:
            if tag == "p":
                leave({"p"}, AROUND)
            elif tag not in HEADINGS:
                leave({tag}, PARENTS.get(tag, set()))
            continue
        if tag not in IN_PARAGRAPH:
            leave({"p"}, AROUND)
        if tag in IMPLIED:
            leave(*IMPLIED[tag])
        if tag in VOID or tag in HEADINGS:
            continue
        _, region, marked, article = stack[-1]
        own = marked or is_marked(tag, m[3], article)
        inside = article or tag in ("article", "main")
        if own != marked or inside != article:
            regions += 1
            region = regions
        stack.append((tag, region, own, inside))
        opened[tag] += 1
    end()
    return blocks


def decide(b: Block, unknown: bool = False) -> tuple[bool | None, str]:
    """Pass 1: content, boilerplate, or open, and by which rule; `unknown` if the stop words say nothing about the page."""
    stops, words = stops_of(b)
    dense = stops >= ENOUGH_STOPS * words
    if b.links > MOST_LINKS * len(b.text):
        sentence = b.article and not b.marked and dense and b.text[-1] in ".!?…"
        return (None, "linked sentence") if sentence else (False, "links")
    if b.marked:
        return False, "marked"
    if b.heading or len(b.text) < LONG:
        return None, "short"
    if dense:
        return True, "stop words"
    return (True, "length") if unknown else (None, "few stop words")


def stops_of(b: Block) -> tuple[int, int]:
    """Stop words and words."""
    words = b.text.lower().split()
    return sum(w in STOPS for w in words), len(words)


def is_unknown(blocks: list[Block]) -> bool:
    """Whether the stop words are of other languages than the page: too little of its long text has enough of them."""
    counts = [stops_of(b) for b in blocks if not (b.marked or b.heading) and len(b.text) >= LONG and b.links <= MOST_LINKS * len(b.text)]
    return sum(n for k, n in counts if k >= ENOUGH_STOPS * n) < KNOWN * sum(n for _, n in counts)


def explained(page: str | None) -> list[tuple[str, bool, str]]:
    """(text, kept, rule) of every block."""
    blocks = blocks_of(page or "")
    unknown = is_unknown(blocks)
    first = [decide(b, unknown) for b in blocks]
    n = len(blocks)
    # nearest decided neighbour of the same region, by one walk each way
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for out, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            if first[i][0] is not None:
                last[blocks[i].region] = (i, first[i][0])
            out[i] = last.get(blocks[i].region)
    told = []
    for i, b in enumerate(blocks):
        label, rule = first[i]
        if label is None:
            x, y = before[i], after[i]
            if x is None and y is None:
                label, rule = b.article, "region"
            else:
                rule = "neighbour"
                if b.heading and y is not None:
                    label = y[1]
                elif x is None or y is None:
                    label = (x or y)[1]
                else:
                    label = x[1] if i - x[0] < y[0] - i else y[1] if y[0] - i < i - x[0] else x[1] or y[1]
        told.append((b.text, label, rule))
    return told


def main_text(page: str | None) -> str:
    return "\n".join(text for text, kept, _ in explained(page) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    C.small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
