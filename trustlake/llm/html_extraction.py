"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Elements that are no prose by
their tag, role, class or id (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments, hidden parts) are skipped
whole; a class or id that has such a word among others (content-widget) is only
a hint: blocks inside have to be clear prose. Inside ``article`` or ``main``
asides, menus, names of single paragraphs and names that are topics as well
(discussion, related, search) are hints, too, and headings go by their text
alone, whatever their anchors are called. A form that wraps the page's article,
main part or first heading is no form of the page's furniture.

First pass: link density, length and stop-word density decide clear blocks.
Standing inside ``article`` or ``main`` lowers the stop-word densities that are
asked for, standing outside of them on a page that has one raises them. Few
function words reject a block inside if a third of it is links, outside at once
where the page has an article. Second pass: headings, short blocks and those in
between inherit the label of the nearest decided neighbours, those inside an
article from neighbours inside (either is enough), those of a hinted element from neighbours in
that element (rejected without any), and longer ones without function words
only after prose that goes on or ends there. Headings look ahead. Where no
block is clear prose, paragraphs without links stand for it; where nothing is
decided, all that isn't links is kept.

Each task parses its own pages; there is no shuffle. Edge cases: null html is
an empty page (text '', 0 characters); truncated markup, unclosed tags and bad
character references are taken as they come; very long pages are parsed whole,
one at a time, in time linear in their length; repeated rows, ties and null ids
or urls don't matter, each row stands alone; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm._words import parts

# Element names of HTML.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|canvas|audio|video|select|noembed|noframes"
SKIP = frozenset("nav footer aside form button dialog menu head datalist".split())
OPEN_ENDED = frozenset("p li dt dd td th tr option".split())
NEVER = frozenset("html body main article".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist status".split())
# Parts of class and id names that mark page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense adslot sponsor sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr notice notices alert alerts announcement "
    "popup modal overlay newsletter subscribe subscription signup signin login register paywall sidebar sidebars rail widget widgets menu menus nav navi navbar navigation topnav subnav breadcrumb breadcrumbs masthead header topbar "
    "footer footnav copyright comment comments commentlist disqus reply replies respond discussion related recommended recommendations share sharing shares social follow toolbar pagination pager skip skiplink search searchform hidden".split()
)
# Of these, names that an article's own parts have as well.
TOPICS = frozenset("discussion related recommended recommendations search social share sharing follow replies".split())
# Elements of a single paragraph: inside an article their names are hints.
PARAGRAPHS = frozenset("p li dt dd td th pre blockquote figcaption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Frequent function words of English, French, German and Spanish.
STOP = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which who will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se son sur un une vous "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einen einer er es für hat ich im ist mit nach nicht oder sich sie sind so über um und von war wie wird zu zum zur "
    "al como con cuando del el ella entre era es ese esta este fue ha hay las lo los más me mi muy no nos o para pero por porque se si sin sobre son su sus también un una unos y ya".split()
)

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|(?P<text>[^<]+)|(?P<lone><)",
    re.S | re.I,
)
# One attribute with its value, so that nothing is looked for inside values or longer names.
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_NAME = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
_WRAPS = re.compile(r"<(?:article|main|h1)\b", re.I)
LONG, SHORT = 140, 70
MANY, SOME, FEW = 0.30, 0.20, 0.10
#: What a place inside an article, or outside on a page that has one, adds to these densities.
INSIDE, OUTSIDE = -0.10, 0.10
LINKED = 0.33


DROP, HINT = 2, 1


def _furniture(tag: str, attrs: str, inside: int) -> int:
    """DROP, HINT or 0."""
    if tag in SKIP:
        return HINT if inside and tag in ("aside", "menu") else DROP
    if tag == "header":
        return 0 if inside else DROP
    if not attrs or tag in NEVER:
        return 0
    found = 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in HEADINGS:
            for own in value.split():
                parts_of = [x.lower() for x in _NAME.findall(_CAMEL.sub(" ", own))]
                if parts_of and parts_of[0] not in ("has", "with", "no", "without") and not FURNITURE.isdisjoint(parts_of):
                    if len(parts_of) == 1 and not (inside and (tag in PARAGRAPHS or parts_of[0] in TOPICS)):
                        return DROP
                    found = HINT
        elif name == "role":
            if value.strip().lower() in ROLES:
                return DROP
        elif name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return DROP
        elif name == "aria-hidden":
            if value.strip().lower() == "true":
                return DROP
        elif name == "hidden":
            return DROP
    return found


class _Block:
    """``hint``: where the hinted element around the block ends, 0 without one. ``weak``: no function words, no links."""

    __slots__ = ("heading", "hint", "inside", "label", "linked", "text", "weak")

    def __init__(self, text: str, linked: int, inside: bool, heading: bool, hint: int) -> None:
        self.text, self.linked, self.inside, self.heading, self.hint, self.label, self.weak = text, linked, inside, heading, hint, None, False


def blocks(page: str) -> list[_Block]:
    """Blocks of a page in order, without furniture."""
    out: list[_Block] = []
    pieces: list[str] = []
    linked = links = inside = 0
    heading = False
    at = hint = hint_ends = 0
    size = len(page)

    def close() -> None:
        nonlocal linked, heading
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(_Block(text, linked, inside > 0, heading, hint))
            pieces.clear()
        linked, heading = 0, False

    while at < size:
        m = _TOKEN.match(page, at)
        if m is None:
            pieces.append(page[at])
            at += 1
            continue
        at = m.end()
        text = m["text"] or m["lone"]
        if text is not None:
            hint = hint_ends if m.start() < hint_ends else 0
            pieces.append(text)
            if links:
                linked += len(text)
            continue
        if m["tag"] is None:
            if m["raw"] and m["raw"].lower() in BLOCK:
                close()
            continue
        tag, end = m["tag"].lower(), bool(m["end"])
        kind = 0 if end or tag in VOID else _furniture(tag, m["attrs"], inside)
        if kind == HINT and at >= hint_ends:
            hint_ends = _after(page, at, tag)
        if kind == DROP:
            if tag in BLOCK or tag in SKIP:
                close()
            ends = _after(page, at, tag)
            if tag != "form" or not _WRAPS.search(page, at, ends):
                at = ends
            continue
        if tag == "a":
            links = max(0, links - 1) if end else 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK:
            close()
            links = 0
            if tag in ("article", "main"):
                inside = max(0, inside - 1) if end else inside + 1
                if not end:
                    hint_ends = at
            heading = not end and len(tag) == 2 and tag[0] == "h" and tag != "hr"
    close()
    return out


def _after(page: str, at: int, tag: str) -> int:
    """Where the element that opened before ``at`` ends."""
    depth = 1
    while at < len(page):
        m = _TOKEN.match(page, at)
        if m is None:
            at += 1
            continue
        if m["tag"] is not None:
            name = m["tag"].lower()
            if tag in OPEN_ENDED and depth == 1 and (name == tag and not m["end"] or name in BLOCK and name not in OPEN_ENDED and (m["end"] or tag == "p")):
                return at
            if name == tag:
                depth += -1 if m["end"] else 1
                if not depth:
                    return m.end()
        at = m.end()
    return at


def _dense(b: _Block) -> float:
    words = [w.lower() for w in _WORD.findall(b.text)]
    return sum(w in STOP for w in words) / len(words) if words else 0.0


def _clear(b: _Block, framed: bool) -> bool | None:
    """First pass: prose, no prose, or undecided."""
    n = len(b.text)
    links = b.linked / n
    if b.hint and (b.inside or not framed):
        if links > 0.5:
            return False
        return None if b.heading or n < SHORT else _dense(b) >= (SOME if n >= LONG else MANY)
    if links > (0.8 if b.inside else 0.5) or "©" in b.text and n < LONG and not b.inside:
        return False
    if n < SHORT or b.heading:
        return False if links > 0.2 and not b.inside else None
    shift = INSIDE if b.inside else OUTSIDE if framed else 0.0
    dense = _dense(b)
    if b.inside and dense < FEW and links > LINKED:
        return False
    if dense >= MANY + shift or n >= LONG and dense >= SOME + shift:
        return True
    if dense < FEW + shift and (n < LONG or framed):
        if framed or links > 0:
            return False
        b.weak = True
    return None


def _inherited(b: _Block, i: int, near: list[int], fixed: dict[int, bool]) -> bool:
    """The label of the nearest decided blocks; inside an article one of two neighbours is enough."""
    k = bisect.bisect(near, i)
    if b.weak:
        return k > 0 and fixed[near[k - 1]] and (k == len(near) or fixed[near[k]])
    if not near:
        return not b.hint
    if k == 0 or k == len(near):
        return fixed[near[0 if k == 0 else -1]]
    if fixed[near[k - 1]] == fixed[near[k]] or b.heading:
        return fixed[near[k]]
    if b.inside:
        return True
    left, right = i - near[k - 1], near[k] - i
    return fixed[near[k - 1]] if left < right else fixed[near[k]] if right < left else True


def label(found: list[_Block]) -> None:
    """Two passes: decide clear blocks, then let the others inherit."""
    framed = any(b.inside and b.linked < 0.5 * len(b.text) for b in found)
    for b in found:
        b.label = _clear(b, framed)
    if not any(b.label for b in found):
        # No clear prose: paragraphs without links stand for it, else what is hinted.
        plain = [b for b in found if b.label is None and not b.hint]
        for b in plain:
            if len(b.text) >= SHORT and not b.heading and not b.linked:
                b.label = True
        for b in found if not plain else ():
            if b.hint and (b.inside or not framed) and b.linked <= 0.5 * len(b.text):
                b.label = True
    fixed = {i: b.label for i, b in enumerate(found) if b.label is not None}
    # What a hinted element decides stays in that element.
    plain = [i for i in fixed if not found[i].hint]
    within = [i for i in plain if found[i].inside]
    hinted: dict[int, list[int]] = {}
    for i in fixed:
        hinted.setdefault(found[i].hint, []).append(i)
    for i, b in enumerate(found):
        if b.label is None:
            b.label = _inherited(b, i, hinted.get(b.hint, []) if b.hint else within if b.inside else plain, fixed)


def main_text(page: str) -> str:
    found = blocks(page)
    label(found)
    return "\n".join(b.text for b in found if b.label)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts(whole, "html"):
            text = [main_text(page) if page else "" for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id long, url string, html string, ...) -> page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
