"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Blocks inside menus, page headers and footers, sidebars, notices,
adverts, forms and reader comments (by tag, role, or a class or id that names such a part) are boilerplate at once; what a blog
files an article under (category-, tag-) names no part, headings and articles are none, and an element with most of a
page's text isn't one for a loose name such as "related". In the first pass,
link density, length and stop-word density decide the others: bad are links without text of their own, good is what is long and
has stop words, and all else stays ambiguous. In the second pass these take the label of their nearest decided
neighbours; without any, the longest block with a letter is good. If the articles of a page (or else
its <main>) hold a good part of what was found good, only blocks in them are taken. There a long block needs no stop words,
and links speak against a block only in a run of short linked list items or boxes, a menu. The page's own frequent short
words (single characters in scripts without spaces) count as stop words too.

Defined cases: null or empty html gives an empty text; unclosed tags and comments end with their parent or
the page; an embedded object without an end tag is passed over, and its content kept; unknown character references stay as they are; repeated rows and equal ids are kept; empty tables
give no rows; other columns are ignored. Pages are handled one by one, whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tag names, names of boilerplate parts, frequent function words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title iframe textarea xmp noembed noframes".split())
EMBEDDED = frozenset("noscript template svg math object video audio canvas".split())
PROSE = frozenset("p blockquote pre dd dt figcaption caption address".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_TAGS = frozenset("aside button dialog footer form head menu nav select datalist fieldset".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion promoted recommendations recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar topbar widget widgets".split()
)
STOP_WORDS = frozenset(
    "a all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our she so some than that the their them then there they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist kann mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wenn werden wie wird wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous y à été être "
    "al con como cual de del desde donde el ella ellos en entre era es esta este fue ha hay la las le lo los más me mi muy no o os para pero por porque que se ser si sin sobre son su sus también te tu un una uno ya".split()
)
#: Of these, those of reader comments, and those that an article may have, too.
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies respond".split())
LOOSE_NAMES = frozenset("banner header masthead notice notices promo promoted promotion recommended related share sharing skip social teaser teasers widget widgets".split())
#: How blogs begin the classes that tell what an article is, or is filed under.
FILED = ("category-", "tag-", "post-", "type-", "format-", "status-")
#: Share of a page's text from which an element is no boilerplate by a loose name.
MOST = 0.5
LONG = 70  # characters
STOPS = 0.2
LINKS_HIGH = 0.5
#: Linked blocks in a row that make a menu inside an article, if they have fewer characters than that on average.
MENU, MENU_ITEM = 3, 25
#: Share of a page's good text from which its articles, or its <main>, are taken alone.
SHARE = 0.3
#: Letters of a short word, and how often it must stand on a page, for a stop word of the page's own.
SHORT, OFTEN = 4, 2

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Words; each character of a script without spaces (Thai to Burmese, Khmer, Kana, Han) is one.
WORDS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]|[^\\W\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]+")
SPACE = re.compile(r"\s+")

GOOD, BAD, AMBIGUOUS = "good", "bad", "ambiguous"


@dataclass
class Block:
    tag: str
    containers: frozenset[str]  # article and main, as far as it is inside them
    regions: tuple[int, ...]  # the elements around it that are boilerplate by name
    pieces: list[str] = field(default_factory=list)
    linked: int = 0  # characters inside links
    text: str = ""

    def close(self) -> Block:
        self.text = SPACE.sub(" ", html.unescape("".join(self.pieces))).strip()
        return self

    @property
    def is_linked(self) -> bool:
        return self.linked > LINKS_HIGH * len(self.text) and self.tag not in HEADINGS


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


def names_of(value: str) -> set[str]:
    """What the classes or the id of an element call it: each as a whole, and the last word of a compound."""
    tokens = [re.sub(r"([a-z])([A-Z])", r"\1-\2", t).lower() for t in value.split()]
    tokens = [re.sub(r"[^a-z]+", "-", t).strip("-") for t in tokens if not t.startswith(FILED)]
    return {name for t in tokens for name in (t.replace("-", ""), t.rpartition("-")[2])}


def is_boilerplate(tag: str, attrs: dict[str, str], inside: frozenset[str]) -> bool:
    """By tag, role or visibility; inside: the enclosing containers."""
    if tag in BOILERPLATE_TAGS or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "main") or not attrs:
        return False
    return attrs.get("role", "").lower() in BOILERPLATE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")


def called_boilerplate(tag: str, attrs: dict[str, str], inside: frozenset[str]) -> frozenset[str]:
    """The names of boilerplate that an element has by its class or id."""
    if tag in ("html", "body", "main") or tag in HEADINGS or not attrs:
        return frozenset()
    found = names_of(f"{attrs.get('class', '')} {attrs.get('id', '')}") & BOILERPLATE_NAMES
    if tag == "article":
        found &= COMMENT_NAMES
    return frozenset(found - {"header"} if inside else found)


def cut(page: str) -> list[Block]:
    """The blocks with text that aren't boilerplate by their place."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, frozenset[str], tuple[int, ...]]] = []  # tag, boilerplate, containers, regions
    called: list[frozenset[str]] = []  # the names of each region
    links, current, at = 0, None, 0
    endless: set[str] = set()  # embedded objects without a further end tag

    def add(text: str) -> None:
        nonlocal current
        if text and not (stack and stack[-1][1]):
            if current is None:
                if not text.strip():
                    return
                tag = next((entry[0] for entry in reversed(stack) if entry[0] in BLOCKS), "")
                current = Block(tag, *((stack[-1][2], stack[-1][3]) if stack else (frozenset(), ())))
                blocks.append(current)
            current.pieces.append(text)
            current.linked += len(text.strip()) if links else 0

    while m := MARKUP.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            current = None
        elif tag == "br":
            add(" ")
        if m["end"] or m["end2"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            # an inline end tag closes nothing beyond its block
            if depth is not None and (tag in BLOCKS or not any(entry[0] in BLOCKS for entry in stack[depth + 1 :])):
                links -= sum(entry[0] == "a" for entry in stack[depth:])
                del stack[depth:]
            continue
        attrs_source = m["attrs"] if m["tag"] else m["attrs2"]
        if tag in RAW:
            if not attrs_source.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in EMBEDDED:
            if not attrs_source.rstrip().endswith("/") and tag not in endless:
                if end := re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at):
                    at = end.end()
                else:
                    endless.add(tag)
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:  # closes an open paragraph and what is open in it; list items and cells close their like
            like = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(tag, ())
            stops = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}.get(tag, ("table",))
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name == "p" or name in like:
                    links -= sum(entry[0] == "a" for entry in stack[k:])
                    del stack[k:]
                    if name != "p":
                        break
                elif name in BLOCKS and (not like or name in stops):
                    break
        above, inside, regions = stack[-1][1:] if stack else (False, frozenset(), ())
        attrs = attributes(attrs_source)
        dropped = above or is_boilerplate(tag, attrs, inside)
        if not dropped and (names := called_boilerplate(tag, attrs, inside)):
            regions = (*regions, len(called))
            called.append(names)
        stack.append((tag, dropped, inside | {tag} if tag in ("article", "main") else inside, regions))
        links += tag == "a"
    add(page[at:])
    found = [b for b in blocks if b.close().text]
    size = Counter()
    for b in found:
        size.update(dict.fromkeys(b.regions, len(b.text)))
    whole = sum(len(b.text) for b in found)
    gone = {k for k, names in enumerate(called) if not names <= LOOSE_NAMES or size[k] <= MOST * whole}
    return [b for b in found if not gone & set(b.regions)]


def own_stop_words(blocks: list[Block]) -> frozenset[str]:
    """Frequent short words of the page's long blocks without many links."""
    words = Counter(w for b in blocks if len(b.text) >= LONG and not b.is_linked for w in WORDS.findall(b.text.lower()) if len(w) <= SHORT and w.isalpha())
    return frozenset(w for w, n in words.items() if n >= OFTEN)


def menus(blocks: list[Block]) -> list[bool]:
    """Whether each block is in a run of at least MENU linked ones that are short and no prose."""
    out: list[bool] = []
    for linked, run in groupby(blocks, lambda b: b.is_linked and b.tag not in PROSE):
        lengths = [len(b.text) for b in run]
        out += [linked and len(lengths) >= MENU and sum(lengths) < MENU_ITEM * len(lengths)] * len(lengths)
    return out


def first_pass(b: Block, in_menu: bool, stop_words: frozenset[str]) -> str:
    words = WORDS.findall(b.text.lower())
    stops = sum(w in stop_words for w in words) / len(words) if words else 0.0
    if b.containers:
        return BAD if in_menu else GOOD if len(b.text) >= LONG or stops >= STOPS else AMBIGUOUS
    if in_menu or b.is_linked:
        return BAD
    return GOOD if len(b.text) >= LONG and stops >= STOPS else AMBIGUOUS


def second_pass(labels: list[str]) -> list[str]:
    """Ambiguous blocks take the label of the nearest decided one; if two are as near, good wins; without any, they are good."""
    n = len(labels)
    before, after = [n + 1] * n, [n + 1] * n  # distances
    for k in range(n):
        before[k] = 0 if labels[k] != AMBIGUOUS else before[k - 1] + 1 if k else n + 1
    for k in range(n - 1, -1, -1):
        after[k] = 0 if labels[k] != AMBIGUOUS else after[k + 1] + 1 if k < n - 1 else n + 1
    out = []
    for k, label in enumerate(labels):
        near = [labels[j] for j, d in ((k - before[k], before[k]), (k + after[k], after[k])) if d == min(before[k], after[k]) and d <= n and 0 <= j < n]
        out.append(label if label != AMBIGUOUS else GOOD if GOOD in near or not near else BAD)
    return out


def good_blocks(blocks: list[Block], stop_words: frozenset[str]) -> list[Block]:
    labels = [first_pass(b, m, stop_words) for b, m in zip(blocks, menus(blocks), strict=True)]
    if GOOD not in labels:
        rest = [k for k, label in enumerate(labels) if label == AMBIGUOUS and (blocks[k].containers or any(c.isalpha() for c in blocks[k].text))]
        if not rest:
            return []
        labels[max(rest, key=lambda k: len(blocks[k].text))] = GOOD
    return [b for b, label in zip(blocks, second_pass(labels), strict=True) if label == GOOD]


def extract(page: str) -> str:
    blocks = cut(page)
    stop_words = STOP_WORDS | own_stop_words(blocks)
    good = good_blocks(blocks, stop_words)
    size = lambda found: sum(len(b.text) for b in found)
    for container in ("article", "main"):
        inside = good_blocks([b for b in blocks if container in b.containers], stop_words)
        if inside and size(inside) >= SHARE * size(good):
            good = inside
            break
    return "\n\n".join(b.text for b in good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h.as_py() or "") for h in batch.column("html")]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
