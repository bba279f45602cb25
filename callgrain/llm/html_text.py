"""Main text of web pages by two passes of block rules.

First, every block between block-level tags is classed by its share of stop words, its length and its share of link text, and by what
encloses it: navigation, forms, adverts and the like are out whatever they say. Then blocks that are too short or too mixed to tell inherit
the class of the nearest decided neighbours in their container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import resting, schema, text_chunks

#: A quote is one only where a value begins and another ends it; elsewhere it is a character of a name or a value.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s/>=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")
SPACE, WORD = re.compile(r"[\s\x00-\x1f]+"), re.compile(r"[^\W\d_]+")

# Names of elements, words in class, id and role, and frequent function words of four languages.
RAW = frozenset("script style noscript template textarea select svg annotation annotation-xml iframe object canvas audio video title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
OUT = frozenset("nav footer aside form dialog menu search button fieldset head".split())
# What is never the page's own text, though it may be prose; and parts of a layout, which prose overrules.
FIRM_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal footer comment comments reply replies respond disqus newsletter subscribe subscription signup login contentinfo".split()
)
WEAK_NAMES = frozenset(
    "banner notice notification alert overlay sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs masthead topbar toolbar discussion share sharing social related recommended recommendations register search pagination pager widget complementary".split()
)
#: Parts of a class that only tell what is beside or inside an element, as in has-sidebar or comments-open.
TELLS = frozenset("has with no not without free open closed enabled disabled".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PAGE_HEAD = frozenset(["header"])
STOP = frozenset(
    (
        "a an and are as at be been but by for from had has have he her his i if in is it its not of on or she so that the their there they this to was we were what when which who will with you "
        "als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wird zu zum zur "
        "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour qu que qui sa se ses son sur un une vous y "
        "al como con de del el ella en es esta este ha hay la las lo los más me mi no o para pero por que se sin su sus un una y ya"
    ).split()
)

#: Below this share of stop words in the longer blocks a page is in none of the four languages. Scripts that are written without spaces.
STRANGE = 0.06
LETTERS, DENSE = re.compile(r"[^\W\d_]"), re.compile("[\u0e00-\u0eff\u1000-\u109f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")

GOOD, BAD, UNSURE = 1, 0, -1
SHUT, FIRM, WEAK, OPEN = 3, 2, 1, 0


class Named:
    """An element whose class, id or role is on a list, or an article in one, with the one around it: firm if either is, prose if it holds some."""

    __slots__ = ("article", "firm", "outer", "prose")

    def __init__(self, outer: Named | None, firm: bool, article: bool = False):
        self.outer, self.firm, self.article, self.prose = outer, firm or outer is not None and outer.firm, article, False

    def out(self) -> bool:
        own = self.outer if self.article and self.outer is not None else self
        return own.firm or not own.prose

    def overruled(self) -> None:
        x: Named | None = self
        while x is not None and not x.prose:
            x.prose, x = True, x.outer


class Block:
    __slots__ = ("core", "label", "links", "named", "out", "parts", "text")

    def __init__(self, out: bool, core: bool, named: Named | None):
        self.out, self.core, self.named, self.parts, self.links, self.text, self.label = out, core, named, [], 0, "", UNSURE


def _named(value: str) -> int:
    """Whether a class, id or role has a word on a list."""
    kind = OPEN
    for token in value.split():
        words = set(re.split(r"[^a-z0-9]+", token))
        if not words & TELLS:
            kind = max(kind, FIRM if words & FIRM_NAMES else WEAK if words & WEAK_NAMES else OPEN)
    return kind


def _shut(name: str, attributes: str, core: bool) -> int:
    """Whether an element puts its content out: SHUT by its kind or as it isn't shown, FIRM or WEAK by its class, id or role."""
    if name in OUT or name in PAGE_HEAD and not core:
        return SHUT
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return OPEN
    kind = OPEN
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value, key = (a or b or c).lower(), key.lower()
        if key in ("class", "id", "role"):
            # a heading is named for what it heads; in the article a paragraph is only out if it is something else for sure
            if name not in ("html", "body", "article", "main", *HEADINGS):
                found = _named(value)
                if not (name == "p" and core and found == WEAK):
                    kind = max(kind, FIRM if found and key == "role" else found)
        elif key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return SHUT
    return SHUT if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes) and name not in ("html", "body") else kind


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, with text."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, Named | None]] = []  # name, out, core, named
    now = Block(False, False, None)
    link = 0
    unclosed: set[str] = set()  # raw elements that no end tag follows; it isn't looked for again

    def renew() -> None:
        nonlocal now
        if now.parts:
            found.append(now)
        _, out, core, named = stack[-1] if stack else ("", False, False, None)
        now = Block(out, core, named)

    def enter(name: str, kind: int, core: bool) -> None:
        _, out, inside, named = stack[-1] if stack else ("", False, False, None)
        if name == "main":
            named = None
        elif name == "article" and named is not None and not inside:
            named = Named(named, False, True)
        stack.append((name, out or kind == SHUT, core, Named(named, kind == FIRM) if kind in (FIRM, WEAK) else named))

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.match(html, at)
        at = m.end()
        name = m[1]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                now.parts.append(piece)
                if link:
                    now.links += len(piece.strip())
            elif piece.startswith("<![CDATA["):
                now.parts.append(piece[9:-3])
            continue
        if m[0][-1] != ">":  # a tag that the page's end cuts off
            break
        name, closing = name.lower(), m[0][1] == "/"
        if name in RAW:
            if not closing and not m[0].endswith("/>"):
                shut = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                if shut is None:
                    unclosed.add(name)
                    if name in ("script", "style", "textarea", "title"):
                        break
                    continue
                at = shut.end()
                now.parts.append(" ")
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        if name == "br":
            now.parts.append(" ")
            continue
        if name not in BLOCK and name != "button":
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        renew()
                        break
                    if stack[i][0] in BLOCK:
                        break
            elif m[2] and not m[0].endswith("/>") and name not in ("img", "input", "meta", "link", "wbr", "source", "col", "embed", "area", "base", "param", "track") and (kind := _shut(name, m[2], bool(stack) and stack[-1][2])):
                renew()
                enter(name, kind, bool(stack) and stack[-1][2])
                renew()
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body") and name not in ("html", "body", "main"):
                    break  # a stray end tag doesn't close what encloses the text
        else:
            link = 0
            if name != "button":
                while stack and stack[-1][0] in ("p", *HEADINGS):
                    stack.pop()
            if name in ("li", "dd", "dt", "td", "th", "tr"):
                peers = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}[name]
                while stack and stack[-1][0] in peers:
                    stack.pop()
            if name != "hr":
                core = bool(stack) and stack[-1][2] or name in ("article", "main")
                enter(name, _shut(name, m[2], core), core)
        renew()
    renew()
    for b in found:
        b.text = SPACE.sub(" ", unescape("".join(b.parts))).strip()
    return [b for b in found if b.text]


def classify(page: list[Block], short: int = 70, long: int = 200, few: float = 0.20, many: float = 0.30, linked: float = 0.5) -> None:
    """Set labels: blocks alone, then undecided ones by their neighbours. Where an article or main element holds text, what stands outside is
    out, unless there is far more prose outside, as on a page of teasers. Where the longer blocks hold hardly any of the stop words, the page
    is in another language, and length and links alone decide.

    A name puts an element out unless it is a part of a layout and holds a long block dense in stop words. Where the page has no article and no
    such block besides, an article in an element with a name is the page's.
    """
    facts, rescued, known, total = [], True, 0, 0
    for b in page:
        words = WORD.findall(b.text.lower())
        stops, share = sum(w in STOP for w in words), b.links / len(b.text)
        if not b.out and share <= linked and len(b.text) >= short:
            known, total = known + stops, total + len(words)
        facts.append((stops / len(words) if words else 0.0, share, len(b.text)))
    if total and known < STRANGE * total and not any(d >= many and n > long for d, _, n in facts):
        # scripts without spaces say more in a character
        facts = [(many if LETTERS.search(b.text) else 0.0, share, n + 2 * len(DENSE.findall(b.text))) for b, (_, share, n) in zip(page, facts, strict=True)]
    prosy = []
    for b, (density, share, size) in zip(page, facts, strict=True):
        prose = density >= many and size > long and share <= linked
        prosy.append(prose)
        if b.out:
            continue
        if b.named is None:
            rescued = rescued and not (b.core or prose)
        elif prose:
            b.named.overruled()
    has_core, inside, outside = False, 0, 0
    for b, prose, (_, share, size) in zip(page, prosy, facts, strict=True):
        own = b.named is None or rescued and b.named.article
        b.out = b.out or not own and b.named.out()
        has_core = has_core or own and b.core and not b.out
        if not b.out:
            inside, outside = inside + size * (b.core and share <= linked), outside + size * (prose and not b.core)
    if outside > 2 * inside:  # a teaser is no core
        has_core = False
        for b in page:
            b.core = False
    for b, (density, share, size) in zip(page, facts, strict=True):
        if b.out or has_core and not b.core or share > linked:
            b.label = BAD
        elif size < short:
            b.label = BAD if share > 0.2 and not b.core else UNSURE
        elif density >= many and size > long:
            b.label = GOOD
        elif density >= few or b.core:
            b.label = UNSURE
        else:
            b.label = BAD
    n = len(page)
    before, after, seen = [UNSURE] * n, [UNSURE] * n, UNSURE
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        seen = UNSURE
        for i in order:
            side[i] = seen
            # what is out by its container says nothing of the article around it
            if page[i].label != UNSURE and not (page[i].core and page[i].out):
                seen = page[i].label
    for i, b in enumerate(page):
        if b.label == UNSURE:
            near = {before[i], after[i]} - {UNSURE}
            if b.core:
                b.label = GOOD  # in the article: out only by its own links or its container
            elif near == {BAD}:
                b.label = GOOD if len(b.text) >= short else BAD
            else:
                b.label = GOOD if GOOD in near and (near == {GOOD} or len(b.text) >= short) or not near else BAD


def main_text(html: str | None) -> str:
    page = blocks(html or "")
    classify(page)
    return "\n\n".join(b.text for b in page if b.label == GOOD)


@resting
def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, pages in text_chunks(batches, "html"):
        texts = [main_text(x.decode("utf-8", "replace")) for x in pages]
        yield pa.RecordBatch.from_pydict({"page_id": part["page_id"].cast(pa.int64()), "url": part["url"].cast(pa.string()), "text": pa.array(texts, pa.string())})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text for each row of pages (page_id, url, html).

    One pass without a shuffle. A null or empty html has an empty text; null ids and urls, repeated rows and copies keep a row each; an
    empty table gives no rows; other columns are ignored. Pages are read whole, however long, one at a time.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return pages.mapInArrow(_extracted, schema("page_id long, url string, text string"))
