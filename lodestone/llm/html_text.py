"""Main text of web pages by two-pass block rules.

The first pass cuts a page into blocks and labels each by stop-word density, length and link density. What the page's own
markup says enters as a prior: regions named as menu, footer, advert and the like are bad, an article or main element
shifts the limits for its blocks. In the second pass, blocks that the first left open take the label of their nearest
decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import pick

# Element and region names, stop words of the page languages.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "textarea", "select", "title", "xmp", "noembed", "noframes")
REGIONS = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "figure", "label", "datalist", "search")
BLOCKS = tuple("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = tuple("area base br col embed hr img input link meta param source track wbr".split())
NAMES = tuple("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay sidebar sidebars side menu menus nav navbar navigation breadcrumb breadcrumbs footer footnav header masthead topbar toolbar comment comments commentlist respond replies reply disqus discussion share sharing social related recommended newsletter subscribe signup login widget widgets pagination pager skip hidden copyright legal disclaimer".split())
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar")
STOP_WORDS = frozenset("the of and to in is that it for as was with on be by at this are or from an not have has had but his her they which you we de la le les et des un une du que en est pour dans au qui sur par pas plus ne se ce il elle avec der die das und ist von zu den mit nicht ein eine auf dem des sich im für als auch es an werden aus el los las y una por con para su al lo como más pero sus no del sobre".split())
LINK_DENSITY, MAIN_LINK_DENSITY, STOP_LOW, STOP_HIGH, SHORT, LONG = 0.33, 0.75, 0.12, 0.20, 70, 200
OUTWEIGH = 4  # times the text of a main element that good text outside must have to count beside it

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*(?:>|\Z)|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden|aria-label|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: list[str] = field(default_factory=list)
    linked: int = 0
    chars: int = 0
    main: int = 0  # number of the outermost main element around it
    out: bool = False  # in a region that is no part of the article
    head: bool = False


def _named_out(tag: str, attrs: str) -> bool:
    if not attrs:
        return False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            words = set(_WORDS.split(_CAMEL.sub("-", value).lower()))
            if not words.isdisjoint(NAMES):
                return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order; end tags that are missing or too many do no harm."""
    found, stack, block = [], [], Block()
    links, mains = 0, 0

    def flush(fresh: bool = True) -> None:
        nonlocal block
        if block.text and "".join(block.text).strip():
            found.append(block)
        block = Block(main=next((x[2] for x in stack if x[2]), 0), out=any(x[1] for x in stack), head=bool(stack) and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"))

    def put(raw: str) -> None:
        text = html.unescape(raw)
        block.text.append(text)
        n = len(text.strip())
        block.chars += n
        block.linked += n * bool(links)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        if m["cdata"]:
            put(m["cdata"])
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if tag == "a":
                links = 0
            if tag in BLOCKS or tag in REGIONS:
                at_stack = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if at_stack is not None:
                    del stack[at_stack:]
                flush()
            elif (i := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)) is not None:
                del stack[i:]
                flush()
            continue
        attrs = m["attrs"] or ""
        if tag in RAW:
            if tag == "head":
                end = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
                at = end.end() if end else at
            elif not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n if tag in ("script", "style") else at
            continue
        if tag == "a":
            links = 1
        if tag in ("br", "wbr", "hr", "img", "input", "td", "th"):
            block.text.append(" " if tag != "wbr" else "")
        if tag in VOID and tag != "hr":
            continue
        out, main = _named_out(tag, attrs), tag in ("article", "main") or "role" in attrs and bool(re.search(r"role\s*=\s*[\"']?main\b", attrs))
        mains += main
        main *= mains
        if tag in BLOCKS or tag in REGIONS:
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                stack.pop()
            elif tag in BLOCKS and stack and stack[-1][0] == "p":
                stack.pop()
            region = tag in REGIONS and not (tag in ("header", "figure", "fieldset", "label") and any(x[2] for x in stack))
            if tag != "hr":
                stack.append((tag, out or region, main))
            flush()
        elif out:
            stack.append((tag, True, main))
            flush()
    flush()
    return found


def first_pass(b: Block, text: str) -> str:
    """good, bad, near (good if a neighbour is) or short, by stop words, length and links. A main element only shifts the limits."""
    link = b.linked / max(1, b.chars)
    if b.out or text.startswith("©") or link > (MAIN_LINK_DENSITY if b.main else LINK_DENSITY):
        return "short" if b.head and b.main and not b.out else "bad"
    if len(text) < SHORT:
        return "bad" if b.linked and not b.main else "short"
    words = text.lower().split()
    stop = sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / max(1, len(words))
    if stop >= STOP_HIGH:
        return "good" if len(text) > LONG else "near"
    return "near" if stop >= STOP_LOW or b.main else "bad"


def _settled(blocks: list[Block], texts: list[str], first: list[str]) -> list[str]:
    """Blocks outside a main element are bad, unless the densities find several times its text there."""
    inside = sum(len(t) for b, t, x in zip(blocks, texts, first, strict=True) if b.main and x != "bad")
    outside = sum(len(t) for b, t, x in zip(blocks, texts, first, strict=True) if not b.main and x == "good")
    if inside and outside <= OUTWEIGH * inside:
        return [x if b.main else "bad" for b, x in zip(blocks, first, strict=True)]
    return first


def second_pass(blocks: list[Block], first: list[str]) -> list[bool]:
    """Open blocks take the label of their nearest decided neighbours, inside a main element of those in it.

    A near one needs one good neighbour, a short one two, or one after it if it is a heading. A short one counts near ones as decided.
    Where nothing is decided, the open ones are all there is, and stay.
    """
    out = []
    for i, kind in enumerate(first):
        if kind in ("good", "bad"):
            out.append(kind == "good")
            continue
        main, decided = blocks[i].main, ("good", "bad") if kind == "near" else ("good", "bad", "near")
        sides = []
        for step in (range(i - 1, -1, -1), range(i + 1, len(first))):
            side = next((first[j] for j in step if blocks[j].main == main and first[j] in decided), None)
            sides.append(None if side is None else side != "bad")
        known = [x for x in sides if x is not None]
        if not known:
            out.append(True)
        elif main:  # its edges are no neighbours
            out.append(any(known) if kind == "near" or blocks[i].head and sides[1] else all(known))
        elif kind == "near":
            out.append(any(known) or "good" not in first)
        else:
            out.append(known == [True, True] or bool(blocks[i].head and sides[1]) or not {"good", "near"} & set(first))
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by one line feed; white space inside a block becomes one space. Null gives no text."""
    if not page:
        return ""
    blocks = blocks_of(page)
    texts = [" ".join("".join(b.text).split()) for b in blocks]
    blocks, texts = [b for b, t in zip(blocks, texts, strict=True) if t], [t for t in texts if t]
    first = _settled(blocks, texts, [first_pass(b, t) for b, t in zip(blocks, texts, strict=True)])
    return "\n".join(t for t, good in zip(texts, second_pass(blocks, first), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row, whole pages, without a shuffle.

    Null html gives an empty text and 0; repeated rows stay; an empty table gives none; null ids and urls pass through.
    """
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                s = b.slice(lo, 512)
                texts = [main_text(x.as_py()) for x in s.column(2)]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pick(pages, "page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
