"""Main text of web pages by two-pass block rules.

A tolerant tokenizer cuts the page into blocks of text. Pass 1 judges every visible block by link density, length and stop-word
density; where the dense text lies then tells which places to believe: a landmark (article, main) that holds half of it lifts its blocks by a
class, and a container named like a sidebar that holds the page's text is none. Pass 2 gives blocks that are too short or too thin to judge the label
of the nearest decided neighbours in the same region.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelyard.llm._shared import released, small_batches, values_of

#: Elements whose text is never shown, whose content is raw text, which break blocks, and which have no content.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend",
    "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td",
    "template", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements outside the article wherever they stand.
ASIDE = {"nav", "aside", "footer", "form", "dialog", "menu", "search", "fieldset"}
#: Elements without prose of their own.
UNSEEN = {"button", "select", "template", "svg", "math", "object", "canvas", "audio", "video", "head"}
#: Words of class and id names, and roles, of what is not the article.
NAMES = set(
    "ad ads adbox advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent "
    "disclaimer disqus dropdown footer gdpr login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination "
    "popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription teaser teasers toolbar topbar widget widgets".split()
)
REMARKS = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "related", "teaser", "teasers", "recommended"}
ADVERTS = {"ad", "ads", "advert", "advertisement", "promo", "promoted", "sponsor", "sponsored"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
#: Opening one of these ends an open p.
ENDS_P = BLOCKS - {"body", "head", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "option", "optgroup"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Common words of four languages.
STOP_WORDS = frozenset(
    (
        "a an and are as at be been but by for from had has have he her his i if in is it its my no not of on or our she so than that the their them "
        "there they this to was we were what when which who will with would you your "
        "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son "
        "sont sur un une vous "
        "aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht "
        "noch nur oder sich sie sind so und uns vom von vor war was wenn wer wie wir zu zum zur über "
        "al como con del donde el ella ellos era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por porque que se ser si sin "
        "sobre su sus también te tiene todo un una y ya"
    ).split()
)


@dataclass(frozen=True)
class BlockRules:
    """Thresholds: lengths in characters; densities as shares."""

    short: int = 70
    long: int = 140
    stop_low: float = 0.10
    stop_high: float = 0.20
    link_high: float = 0.5


@dataclass
class Block:
    """A visible block: characters in links, the innermost hint around it (0: none), whether a landmark holds it, its region, and what was decided by which rule."""

    text: str
    links: int
    hint: int
    article: bool
    region: int
    label: str = ""
    rule: str = ""


@dataclass
class Hint:
    """An element that by its tag, role or names is not the article. Only names can be wrong: ``named`` tells that nothing else speaks against it."""

    parent: int
    named: bool
    heads: bool = False
    dense: int = 0


@dataclass
class _Node:
    tag: str
    hint: int
    remark: bool
    article: bool
    region: int
    link: bool = field(default=False)
    shut: bool = field(default=False)


_MARK = re.compile(
    r"<!--(?:>|->)|<!--(?P<comment>.*?)(?:--!?>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^<]*\Z",
    re.S,
)
#: A tag that the end of the page cuts off.
_CUT_OFF = re.compile(r"<(?:[a-zA-Z/?]|!(?!--))[^<]*\Z|<!--.*\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")


def _place(tag: str, rest: str, parent: _Node, count: int, hints: list[Hint]) -> _Node:
    """The state within an element: the hint and the landmark that hold it, its region, and whether it is shown."""
    named = remark = advert = role = False
    shut = parent.shut or tag in UNSEEN
    if rest and not rest.isspace():
        got = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(rest)}
        parts = set(re.split(r"[^a-z0-9]+", html.unescape(got.get("class", "") + " " + got.get("id", "")).lower()))
        shut = shut or "hidden" in got or "hidden" in parts or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I) is not None
        role = got.get("role", "").lower() in ROLES
        named, remark, advert = bool(parts & NAMES), bool(parts & REMARKS), bool(parts & ADVERTS)
    if tag in ("html", "body"):
        named = remark = advert = role = False

    def hinted(told: bool, by_name: bool) -> int:
        if not told:
            return parent.hint
        hints.append(Hint(parent.hint, by_name))
        return len(hints) - 1

    if tag in ("article", "main"):
        # A landmark of its own: a wrapper left open before it doesn't swallow it, a comment or a teaser does.
        part = remark or advert or parent.remark
        return _Node(tag, hinted(remark or advert, False) if part else 0, part, not part, count, parent.link, shut)
    firm = role or tag in ASIDE or tag == "header" and not parent.article
    below = parent.remark or remark or tag in ("aside", "form", "nav", "footer", "dialog")
    region = count if tag == "section" and not parent.article else parent.region
    return _Node(tag, hinted(firm or named, not firm), below, parent.article, region, parent.link or tag == "a", shut)


def blocks_of(page: str) -> tuple[list[Block], list[Hint]]:
    """Visible text blocks in page order, references decoded, white space within a block one space; and the hints around them (the first stands for the page)."""
    out: list[Block] = []
    hints = [Hint(0, False)]
    root = _Node("", 0, False, False, 0)
    closed = page.rfind(">")  # no tag ends beyond it
    headed = False  # whether the page has a heading or a landmark
    stack = [root]
    # Places of the open elements by tag, and of the open blocks, so that no depth needs a search.
    open_at: dict[str, list[int]] = defaultdict(lambda: [0])
    block_at = [0]
    pieces: list[tuple[str, bool]] = []
    at = count = 0

    def flush() -> None:
        if not pieces:
            return
        text = " ".join("".join(t for t, _ in pieces).split())
        top = stack[-1]
        if text and not top.shut:
            links = sum(len("".join(t.split())) for t, linked in pieces if linked)
            out.append(Block(text, links, top.hint, top.article, top.region))
        pieces.clear()

    def add(raw: str) -> None:
        if raw:
            pieces.append((html.unescape(raw) if "&" in raw else raw, stack[-1].link))

    def close_to(depth: int) -> None:
        if block_at[-1] >= depth:
            flush()
        while len(stack) > depth:
            open_at[stack.pop().tag].pop()
            if block_at[-1] == len(stack):
                block_at.pop()

    while True:
        # Up to the last ">" every tag ends somewhere, so that no search for one runs over the page in vain.
        m = _MARK.search(page, at, closed + 1) if at <= closed else None
        if m is None:
            cut = _CUT_OFF.search(page, at)
            add(page[at : cut.start()] if cut else page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m["comment"] is not None and at == closed + 1 and not m[0].endswith(("-->", "--!>")):
            break  # a comment without an end
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["close"] or m["close2"]:
            depth = open_at[tag][-1]
            # An inline or p end tag doesn't close a container around it.
            if depth and (tag in BLOCKS - {"p"} or block_at[-1] <= depth):
                close_to(depth)
            elif tag in BLOCKS:
                flush()
            continue
        rest = m["rest"] if m["tag"] else m["rest2"]
        if tag == "br":
            pieces.append((" ", False))
            continue
        if tag in ENDS_P:
            if stack[block_at[-1]].tag == "p":
                close_to(block_at[-1])
        if tag in SIBLINGS:
            same, bounds = SIBLINGS[tag]
            depth = max(open_at[t][-1] for t in same)
            if depth > max(open_at[t][-1] for t in bounds):
                close_to(depth)
        if tag in BLOCKS:
            flush()
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        count += 1
        open_at[tag].append(len(stack))
        if tag in BLOCKS:
            block_at.append(len(stack))
        stack.append(_place(tag, rest, stack[-1], count, hints))
        if tag == "h1" and not stack[-1].remark or tag in ("article", "main") and stack[-1].article:
            hints[stack[-2].hint].heads = headed = True
    flush()
    hints[0].heads = headed
    return out, hints


def _decide(b: Block, rules: BlockRules) -> tuple[str, str]:
    """Pass 1, of the text alone: good, near, short or bad, and the rule that tells."""
    size = len(b.text)
    if b.links > rules.link_high * max(1, len(b.text.replace(" ", ""))):
        return "bad", "links"
    if size < rules.short:
        return ("bad", "links") if b.links and not b.article else ("short", "length")
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= rules.stop_high:
        return ("good" if size > rules.long or b.article else "near"), "stop words"
    return ("near" if stops >= rules.stop_low else "bad"), "stop words"


def _outside(found: list[Block], hints: list[Hint]) -> list[bool]:
    """By hint whether it is to be believed: not if names alone tell it and the element has over half of the dense text and the page's heading or landmark, or, on a page without these, all dense text."""
    for b in found:
        if b.label == "good":
            hints[b.hint].dense += len(b.text)
    for h in reversed(hints[1:]):  # an element comes after those around it
        if h.parent:
            hints[h.parent].dense += h.dense
            hints[h.parent].heads |= h.heads
    total = sum(len(b.text) for b in found if b.label == "good")
    out = [False]
    for h in hints[1:]:
        void = h.named and 2 * h.dense > total and (h.heads or h.dense == total and not hints[0].heads)
        out.append(out[h.parent] or not void)
    return out


def _settle(found: list[Block], outside: list[bool]) -> list[Block]:
    """The blocks that pass 2 looks at: none under a hint; if landmarks hold half of the dense text or no place does, theirs alone, each a class higher."""
    for b in found:
        if outside[b.hint]:
            b.label, b.rule = "bad", "hint"
    open_ = [b for b in found if b.rule != "hint"]
    if not any(b.label in ("good", "near") for b in open_):
        # No known language: length and links alone speak for a block.
        for b in open_:
            if b.rule == "stop words":
                b.label = "near"
    dense = sum(len(b.text) for b in open_ if b.label == "good")
    inside = [b for b in open_ if b.article]
    if not inside or 2 * sum(len(b.text) for b in inside if b.label == "good") < dense:
        return open_
    for b in open_:
        if not b.article:
            b.label, b.rule = "bad", "landmark"
        elif b.rule == "stop words" and b.label != "good":
            b.label, b.rule = {"near": "good", "bad": "near"}[b.label], "landmark"
    return inside


def _nearest(found: list[Block], step: int) -> list[int | None]:
    """For each block the nearest decided one before it (step 1) or after it (-1) in an unbroken run of its region."""
    out: list[int | None] = [None] * len(found)
    last, region = None, None
    for i in range(len(found))[::step]:
        if found[i].region != region:
            last, region = None, found[i].region
        out[i] = last
        if found[i].label in ("good", "bad"):
            last = i
    return out


def judged_blocks(page: str | None, rules: BlockRules = BlockRules()) -> list[Block]:
    """All visible blocks in page order; ``label`` good or bad and the ``rule`` that decided: links, stop words, hint, landmark or neighbours."""
    blocks, hints = blocks_of(page or "")
    for b in blocks:
        b.label, b.rule = _decide(b, rules)
    found = _settle(blocks, _outside(blocks, hints))
    # Pass 2: by region, what is short or near-good takes the label of its neighbours.
    sure = any(b.label in ("good", "bad") for b in found)
    before, after = _nearest(found, 1), _nearest(found, -1)
    final = {}
    for i, b in enumerate(found):
        if b.label not in ("short", "near"):
            continue
        near = [(abs(i - j), found[j].label) for j in (before[i], after[i]) if j is not None]
        labels = {x for _, x in near}
        if len(labels) == 2 and near[0][0] == near[1][0] or len(labels) != 1 and b.label == "near" or not near:
            final[i] = b.article or b.label == "near" or not sure
        elif b.article:
            final[i] = "good" in labels
        else:
            final[i] = min(near)[1] == "good"
    for i, good in final.items():
        found[i].label, found[i].rule = "good" if good else "bad", "neighbours"
    return blocks


def main_blocks(page: str | None, rules: BlockRules = BlockRules()) -> list[str]:
    """Texts of the blocks of the article, in page order."""
    return [b.text for b in judged_blocks(page, rules) if b.label == "good"]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: BlockRules = BlockRules()) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row: the blocks of the article joined by newlines, and their code points.

    Null or empty html gives an empty text; long pages are read whole; repeated rows are extracted alike; other columns are
    ignored, whatever their names; an empty table gives an empty result. Cut-off pages, unclosed elements and unbalanced quotes are tolerated.
    """
    small_batches(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_blocks(x, rules)) for x in values_of(batch.column("html"))]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return picked.mapInArrow(released(run), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
