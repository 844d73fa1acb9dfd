"""Main text of web pages by two-pass block rules (operator 3).

Pass one decides on a block by its link density, by whether it stands in page furniture, and by its length
and stop-word density: long dense blocks are good; short, sparse or middling ones stay open, whether
inside <article> or not. Pass two gives each open block the label of its nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Thresholds of the rules, in characters and shares.
LOW_LENGTH, HIGH_LENGTH = 70, 200
LOW_STOPS, HIGH_STOPS = 0.15, 0.30
MOST_LINKS = 0.5

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    """the of and to in a is that it for as with was on are be by this at from or an not but they his her he she which you we have had has were their its
    der die das und ist in den von zu mit sich des auf für nicht im dem ein eine als auch es an werden aus er hat dass sie nach bei um am
    le la les de des du et en un une que qui est dans pour par sur au aux pas ne se ce il elle sont avec plus ou son sa ses
    el los las del y por con para una su al lo como más o pero sus es no si""".split()
)

BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas head title textarea select button option datalist audio video map".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements outside the article wherever they stand.
OUTSIDE = frozenset("nav aside form footer menu dialog fieldset".split())
#: Words of class, id and role that mark what is outside the article.
OUTSIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe
    subscription signup nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets related recommended recommendations share sharing social
    footer foot copyright masthead topbar search login toolbar complementary contentinfo skip tags""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies reply discussion reviews".split())
HEADER_WORDS = frozenset("header head masthead".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = re.compile(r"[^a-z]+")
WORDS = re.compile(r"[^\W\d_]+")
RIGHTS = re.compile(r"©|\(c\) |copyright\b", re.IGNORECASE)

NONE, PAGE, COMMENTS = 0, 1, 2


def marked(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is outside the article: PAGE furniture, or COMMENTS."""
    kind = NONE
    if tag in OUTSIDE or tag == "header" and not in_article:
        kind = PAGE
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
            if name in ("hidden",) or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                kind = max(kind, PAGE)
            elif name in ("class", "id", "role"):
                words = set(PARTS.split(value))
                if words & COMMENT_WORDS:
                    return COMMENTS
                if words & OUTSIDE_WORDS or not in_article and words & HEADER_WORDS:
                    kind = PAGE
    return kind


class Block(NamedTuple):
    text: str
    #: Characters inside links.
    linked: int
    #: In page furniture or comments.
    outside: bool
    #: Inside <article> or <main>.
    inside: bool
    tag: str


def blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    found: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    # open block elements: tag, what it is, whether the article has begun, outside or not by all that is open
    stack: list[tuple[str, int, bool]] = [("", NONE, False)]
    in_link, silent, at, n = False, "", 0, len(page)

    def end_block() -> None:
        if text:
            s = " ".join("".join(text).split())
            if s:
                found.append(Block(s, len(" ".join("".join(linked).split())), stack[-1][1] != NONE, stack[-1][2], stack[-1][0]))
            text.clear()
            linked.clear()

    def say(raw: str) -> None:
        if raw and not silent:
            s = html.unescape(raw)
            text.append(s)
            if in_link:
                linked.append(s)

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        closing, attributes = (m.group(1) or m.group(4)) == "/", m.group(3) or m.group(6) or ""
        if silent:
            if closing and tag == silent or silent == "head" and tag == "body":
                silent = ""
            if not (silent == "" and tag == "body"):
                continue
        if not closing and tag in SILENT:
            if tag in RAW:
                m = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = m.end() if m else n
            elif not attributes.endswith("/"):
                silent = tag
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in BLOCKS:
            end_block()
            if tag in VOID:
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                if stack[-1][0] == "p":
                    stack.pop()
                if tag in ("li", "dt", "dd", "td", "th", "tr") and stack[-1][0] == tag:
                    stack.pop()
                _, kind, inside = stack[-1]
                own = marked(tag, attributes, inside)
                if tag in ("article", "main") and own == NONE and kind != COMMENTS:
                    kind, inside = NONE, True  # an unclosed advert before the article doesn't swallow it
                stack.append((tag, max(kind, own), inside))
    end_block()
    return found


GOOD, BAD, SHORT, SPARSE, NEAR, TITLE = "good", "bad", "short", "sparse", "near", "title"


def first_pass(b: Block) -> tuple[str, str]:
    """The block's label and the rule that gave it: decided (GOOD, BAD) or open."""
    n = len(b.text)
    if b.linked > MOST_LINKS * n:
        return BAD, "links"
    if b.outside or n < HIGH_LENGTH and RIGHTS.match(b.text):
        return BAD, "furniture"
    if b.tag in HEADINGS:
        return TITLE, "heading"
    if n < LOW_LENGTH:
        return SHORT, "length"
    words = WORDS.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops < LOW_STOPS:
        return SPARSE, "density"
    return (GOOD, "density") if stops >= HIGH_STOPS and n > HIGH_LENGTH else (NEAR, "density")


def neighbours(labels: list[str], found: list[Block], order: range) -> list[int]:
    """For each block the nearest decided one before it in the given order, -1 if there is none. Blocks of
    the article have neighbours in the article only, and what is set apart inside it (an aside) is none."""
    out, inner, outer = [-1] * len(labels), -1, -1
    for i in order:
        out[i] = inner if found[i].inside else outer
        if labels[i] in (GOOD, BAD):
            outer = i
            if not found[i].inside:
                inner = -1  # another article begins behind it
            elif not found[i].outside:
                inner = i
    return out


def second_pass(labels: list[str], found: list[Block]) -> list[str]:
    """Decides the open blocks. Where a page has no good block, its near-good ones are, or else its sparse
    ones. A heading goes with the nearest decided block after it, and then counts as decided. Other open
    blocks are good between good ones, or beside a good one of their own tag; the ends of an article count
    as good, those of the page don't."""
    labels, n = list(labels), len(labels)
    for instead in (NEAR, SPARSE):
        if GOOD not in labels:
            labels = [GOOD if x == instead else x for x in labels]
    after = neighbours(labels, found, range(n - 1, -1, -1))
    for i, b in enumerate(found):
        if labels[i] == TITLE:
            labels[i] = labels[after[i]] if after[i] >= 0 else GOOD if b.inside else BAD
    before, after = neighbours(labels, found, range(n)), neighbours(labels, found, range(n - 1, -1, -1))
    out = []
    for i, (label, b) in enumerate(zip(labels, found, strict=True)):
        if label not in (GOOD, BAD):
            sides = [(labels[k], found[k].tag) for k in (before[i], after[i]) if k >= 0]
            between = all(x == GOOD for x, _ in sides) and (len(sides) == 2 or b.inside)
            label = GOOD if between or any(x == GOOD and tag == b.tag for x, tag in sides) else BAD
        out.append(label)
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    keep = second_pass([first_pass(b)[0] for b in found], found)
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages, read whole, in one pass without a shuffle.

    Null html counts as empty and gives an empty text, as does a page without a block of its own. Null
    page_id and url and repeated rows are kept; an empty table gives an empty result; other columns are
    ignored. Broken markup is read as far as it goes: an unclosed tag ends with its parent.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(x.as_py() or "") for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
