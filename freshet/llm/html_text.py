"""Main text of web pages: blocks are judged on their own, then ambiguous ones by their neighbours.

Elements that say what they are (navigation, footers, asides, forms, adverts,
notices, comments, hidden parts) are left out with all they hold. The other
blocks form regions: the articles of a page, or its body where it has none.

What a class or id only may mean (``notice-of-appeal``, a heading with the id
``related-work``) excludes nothing; such blocks are left to pass two.

Pass one labels a block by length, link density and stop-word density: good,
bad, near (long enough, but few stop words) or short. Pass two gives near and
short blocks the label of the nearest decided blocks of their region on either
side; short ones need both to be good, near ones need one. The edge of an
article counts as good, that of a body as bad. A body in which no block has the
stop words of a known language is judged by length and links alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import text_batches, text_bytes

SHORT_CHARS, LONG_CHARS = 70, 200
MAX_LINKS, MAX_LINKS_IN_ARTICLE = 0.2, 0.5
LOW_STOP_WORDS, HIGH_STOP_WORDS = 0.15, 0.30

# Frequent function words of the languages of the corpus.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he in is it its not of on or she that the their they this to was were which will with you "
    "au aux avec ce cette dans de des du elle en est et il la le les leur mais ne ou par pas plus pour qui que sa se ses son sont sur un une "
    "aber als am auch auf aus bei das dem den der des die ein eine einer er es für im ist mit nach nicht noch oder sich sie sind und von wie zu zum zur "
    "al como con cual de del el ella en es esta este la las lo los más no o para pero por que se sin sobre son su sus un una y".split()
)
# Elements of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button datalist".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ASIDE = frozenset("nav footer aside form dialog menu".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
# Where HTML lets authors leave out end tags.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_ENDS_P = _HEADINGS | frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li "
    "listing main menu nav ol p pre search section summary table ul xmp".split()
)
_ITEMS = {"li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"])}
_CELLS = frozenset(["td", "th"])
_ROWS = _CELLS | {"tr"}
_ROW_GROUPS = _ROWS | {"caption", "colgroup", "tbody", "thead", "tfoot"}
_IN_TABLE = {"td": _CELLS, "th": _CELLS, "tr": _ROWS, "tbody": _ROW_GROUPS, "thead": _ROW_GROUPS, "tfoot": _ROW_GROUPS}
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of class names and ids that tell what an element is for.
_NAMED = frozenset(
    "ad ads advert advertisement adverts advertising adsbygoogle banner breadcrumb breadcrumbs byline-social comment comments consent cookie "
    "cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination "
    "paywall popup promo promoted promotion recommended related replies respond search share sharebar sharing sidebar signup skip "
    "social sponsor sponsored subscribe subscription taboola teaser teasers toolbar widget widgets".split()
)
#: What a name may say besides, and still be sure.
_PARTS = frozenset(
    "area articles bar block blocks bottom box boxes button buttons fixed form header icons inline inner left links list message msg outer panel "
    "posts right section site slot small sticky stories text title top unit user zone".split()
)
_PAGE_HEADERS = frozenset("header site-header page-header masthead top-bar topbar site_header page_header".split())
#: Names of wrappers and of states, which hold the article as well.
_AROUND = frozenset("has with no wrap wrapper container layout content main page body article post entry".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[^a-z0-9]+")
_COMMENT_NAMES = frozenset("comment comments reply replies ad advert promo promoted related sponsored teaser".split())


@dataclass
class Block:
    text: str
    links: float
    region: int
    heading: bool = False
    doubtful: bool = False
    label: str = ""


@dataclass(frozen=True)
class _State:
    """What holds inside an element: it is left out, belongs to a region, is linked, may be no part of the text."""

    out: bool = False
    region: int = 0
    linked: bool = False
    doubtful: bool = False


@dataclass
class _Element:
    tag: str
    inside: _State


def _says(name: str) -> str:
    """Whether a class or id says that an element is no main text: ``yes``, ``maybe`` or nothing.

    Sure is a name that has no other meaning: words for such parts, alone or
    with words for a box, and numbers.
    """
    words = {w for w in _NAME.split(name) if w}
    if not words & _NAMED or words & _AROUND:
        return ""
    return "yes" if all(w in _NAMED or w in _PARTS or w.isdigit() for w in words) else "maybe"


def _excluded(tag: str, attrs: dict[str, str | None], region: int) -> str:
    """Whether an element says that it is no part of the main text; in a region, a header may be the article's.

    Headings are not judged by their names, and in a region no element is by
    its id alone: generators of pages write the text of headings there.
    """
    if tag in _SKIPPED or tag in _ASIDE or tag == "header" and not region:
        return "yes"
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style") or ""):
        return "yes"
    if (attrs.get("role") or "").lower() in _ROLES:
        return "yes"
    if tag in ("html", "body", "main") or tag in _HEADINGS:
        return ""
    classes, ids = ((attrs.get(a) or "").lower().split() for a in ("class", "id"))
    if tag == "article":
        return "yes" if any(set(_NAME.split(n)) & _COMMENT_NAMES and _says(n) == "yes" for n in classes + ids) else ""
    if not region and _PAGE_HEADERS & {*classes, *ids}:
        return "yes"
    said = {_says(n) for n in classes}
    of_id = {_says(n) for n in ids} - {""}
    if "yes" in said or not region and "yes" in of_id:
        return "yes"
    return "maybe" if "maybe" in said or of_id else ""


class _Blocks(HTMLParser):
    """Collects the blocks of a page that no element excludes.

    Each open element knows what holds inside it, and how many of a name are
    open is counted, so a token costs the same however many are open.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Element] = []
        self.opened: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.regions = 0
        self.breaks = 0
        self.heading = False
        self.code = False

    def _state(self) -> _State:
        return self.open[-1].inside if self.open else _OUTSIDE

    def _push(self, tag: str, inside: _State) -> None:
        self.open.append(_Element(tag, inside))
        self.opened[tag] += 1

    def _cut(self, k: int) -> list[_Element]:
        """Close the elements from the k-th on."""
        gone = self.open[k:]
        del self.open[k:]
        self.opened.subtract(e.tag for e in gone)
        return gone

    def _end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            now = self._state()
            self.blocks.append(Block(text, min(1.0, self.linked / len(text)), now.region, self.heading, now.doubtful or self.code))
        self.parts, self.linked, self.breaks = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.breaks += 1
            self.parts.append(" ")
            if self.breaks > 1:
                self._end_block()
            return
        if tag in ("td", "th"):
            self.parts.append(" ")
        self._imply_ends(tag)
        if tag in _BLOCK:
            self._end_block()
            self.heading, self.code = tag in _HEADINGS, tag == "pre"
        if tag in _VOID:
            return
        now = self._state()
        said = _excluded(tag, dict(attrs), now.region)
        region = now.region
        if tag in ("article", "main") and not now.out and said != "yes" and not region:
            self.regions += 1
            region = self.regions
        inside = _State(now.out or said == "yes", region, now.linked or tag == "a", now.doubtful or said == "maybe")
        if tag in _BLOCK or tag == "a" or inside != now or now.out:
            self._push(tag, inside)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _imply_ends(self, tag: str) -> None:
        """Close what the start of an element ends in HTML: the head, items of a list, parts of a table, a paragraph, a link."""
        if tag == "body" or tag not in _IN_HEAD:
            self._end_head(anywhere=tag == "body")
        if tag in _ITEMS:
            self._end_nearest(_ITEMS[tag], through=("address", "div", "p"))
        if tag in _IN_TABLE and any(self.opened[t] > 0 for t in _IN_TABLE[tag]):
            outermost = None
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag == "table":
                    break
                if self.open[k].tag in _IN_TABLE[tag]:
                    outermost = k
            else:
                outermost = None
            if outermost is not None:
                self._end(outermost)
        if tag in _ENDS_P:
            self._end_nearest(("p",))
        if tag == "a" and self.opened["a"] > 0:
            self._end_link()

    def _end_head(self, anywhere: bool = False) -> None:
        if self.opened["head"] <= 0:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == "head":
                self._cut(k)
            if not anywhere:
                return

    def _end_nearest(self, tags: Collection[str], through: Collection[str] = ()) -> None:
        """End the nearest open element of these names, if only inline elements and those of ``through`` are open in it."""
        if not any(self.opened[t] > 0 for t in tags):
            return
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k].tag
            if tag in tags:
                self._end(k)
                return
            if tag in _SKIPPED or tag in _BLOCK and tag not in through:
                return

    def _end(self, k: int) -> None:
        """End an element without its end tag; a link that is open in it goes on."""
        self._end_block()
        if any(e.tag == "a" for e in self._cut(k)[1:]):
            now = self._state()
            self._push("a", _State(now.out, now.region, True, now.doubtful))

    def _end_link(self) -> None:
        """End the open link; what is open in it goes on, without the link."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == "a":
                for e in self._cut(k)[1:]:
                    self._push(e.tag, _State(e.inside.out, e.inside.region, False, e.inside.doubtful))
                return

    def _close(self, tag: str) -> None:
        """Close the nearest open element of a name."""
        if self.opened[tag] <= 0:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                self._cut(k)
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._end_block()
        self._close(tag)
        if tag == "pre":
            self.code = False

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        now = self._state()
        if now.out:
            return
        if data.strip():
            self.breaks = 0
        self.parts.append(data)
        if now.linked:
            self.linked += len(" ".join(data.split()))

    def close(self) -> None:
        super().close()
        self._end_block()


_OUTSIDE = _State()


def _density(block: Block) -> float:
    words = block.text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)


def _first_label(block: Block, known: bool) -> str:
    """``known``: some block of the page is in a language whose stop words are known."""
    if block.heading and block.region:
        return "short"  # a title may be a link
    if block.links > (MAX_LINKS_IN_ARTICLE if block.region else MAX_LINKS):
        return "bad"
    if len(block.text) < SHORT_CHARS and not block.doubtful:
        return "bad" if block.links > 0 and not block.region else "short"
    if block.doubtful:
        return "near"
    density, long = _density(block), len(block.text) > LONG_CHARS
    if density >= HIGH_STOP_WORDS or density >= LOW_STOP_WORDS and long or not known and long and not block.region:
        return "good"
    return "near" if density >= LOW_STOP_WORDS or block.region or long or not known else "bad"


def main_blocks(html: bytes | None) -> list[Block]:
    """The blocks of the main text, in page order."""
    # A marked section is a comment in HTML; the parser would stop at one that it does not know.
    page = (html or b"").decode("utf-8", "replace").replace("<![", "<! [")
    last = page.rfind("<")
    if last > page.rfind(">") and re.match("[a-zA-Z/!]", page[last + 1 : last + 2]):
        page = page[:last]  # a tag that the end of the page cuts off
    parser = _Blocks()
    parser.feed(page)
    parser.close()
    blocks = [b for b in parser.blocks if b.region or not parser.regions]
    known = any(len(b.text) >= SHORT_CHARS and b.links <= MAX_LINKS and _density(b) >= LOW_STOP_WORDS for b in blocks)
    for block in blocks:
        block.label = _first_label(block, known)
    edge = "good" if parser.regions else "bad"
    before, after = [edge] * len(blocks), [edge] * len(blocks)
    for order, found in ((range(len(blocks)), before), (range(len(blocks) - 1, -1, -1), after)):
        last, region = edge, -1
        for k in order:
            if blocks[k].region != region:
                last, region = edge, blocks[k].region
            found[k] = last
            if blocks[k].label in ("good", "bad"):
                last = blocks[k].label
    kept = []
    for block, a, b in zip(blocks, before, after):
        either = block.label == "near" or block.label == "short" and block.region
        if block.label == "good" or either and "good" in (a, b):
            kept.append(block)
        elif block.label == "short" and b == "good" and (a == "good" or block.heading):
            kept.append(block)
    return kept


def main_text(html: bytes | None) -> str:
    """The main blocks with two line feeds between them; empty for a null page or one without main text."""
    return "\n\n".join(b.text for b in main_blocks(html))


@F.arrow_udf(T.StringType())
def _main_text(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(html.as_py()) for html in pages], pa.string())


def extracted(html_col: str = "html") -> Column:
    """The main text of a column of pages, whole pages of any length.

    Null and empty pages, and those without main text, give an empty text.
    Every row is judged on its own: repeated rows give the same text, and an
    empty table gives no rows. A page costs time in proportion to its length,
    whatever it leaves open.
    """
    text_batches(SparkSession.active())
    return _main_text(text_bytes(html_col)).alias("text")
