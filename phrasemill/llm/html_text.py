"""Main text of web pages by two-pass block rules.

A page is split into blocks at block-level tags. The first pass decides blocks by link density, by the elements around
them (menus, forms, asides, elements named as adverts, notices or comments), by stop-word density and by length; where no
stop-word list applies (the letters are of a script without one, or no block of the page has such words), length and link
density decide; blocks
that it can't decide - short ones, and ones in the page's article whose words say too little - stay open. In the second
pass an open block takes the label of its nearest decided neighbours: both agree, or the nearer one, within its own
article if it has one; without any, blocks of an article are text and others are not.
On a page that would be left without text, open blocks without links are text.

Defined results: null html counts as empty and gives an empty text; cut-off tags at the end are dropped and open elements
end with the page; repeated rows are extracted each; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.bpe import parts_of
from phrasemill.llm.common import prepare

STOP = frozenset(
    "the of and to a in is it that for was on are with as be at by this have from or had not but what all were we when your can said there an which she do "
    "de la le les et des en un une du que qui dans pour est pas sur au par avec ce il se ne plus son aux "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei einer "
    "el los las del y una con por no su para lo como más o se al pero sus le ya este sí porque esta entre "
    "di che il per non sono da come della nel i gli alla o os das dos não uma um com para mais na no em ao het een van dat op te".split()
)
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "select", "canvas", "audio", "video", "title")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside form button menu dialog fieldset head search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising|orial)?|adsense|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"side-?bar|nav(?:bar|igation)?|menu|breadcrumbs?|footer|masthead|site-?header|page-?header|topbar|toolbar|share|sharing|social|related|recommended|newsletter|subscribe|"
    r"signup|login|comments?|commentlist|respond|disqus|replies|widget|pagination|pager|skip-?link|copyright|tag-?cloud|tags|hidden|sr-only|toc)(?:$|[\s_-])",
    re.I,
)
_BODY = re.compile(r"(?:^|[\s_-])(?:articlebody|article-body|article-content|post-content|entry-content|post-body|story-body|article-text|entry|article|main-content)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_DENSE = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")  # scripts that say a word in a letter or two
_OTHER = re.compile("[^\\W\\d_A-Za-z\u00c0-\u024f]")  # letters that aren't Latin
OPEN, GOOD, BAD = 0, 1, -1
SHORT, LOW, HIGH, LINKS = 70, 0.15, 0.30, 0.33


@dataclass
class Block:
    text: str
    linked: int  # letters inside links
    boiler: bool  # inside an element that is never main text
    home: int  # number of the article around it, 0: none
    heading: bool


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, int]] = []  # (name, boiler, article) of open elements
    opened: Counter[str] = Counter()  # how many of each name are in it
    homes = in_link = 0
    heading = False

    def flush() -> None:
        nonlocal linked, heading
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, min(linked, len(text)), bool(stack) and stack[-1][1], stack[-1][2] if stack else 0, heading))
        pieces.clear()
        linked, heading = 0, False

    def said(raw: str) -> None:
        nonlocal linked
        text = html_lib.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if in_link:
            linked += len(" ".join(text.split()))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            if m["raw"] and m["raw"].lower() in ("textarea", "select"):
                pieces.append(" ")
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in BLOCKS:
                flush()
            if opened[name]:
                while stack:
                    n = stack.pop()[0]
                    opened[n] -= 1
                    if n == name:
                        break
            continue
        if name == "br":
            pieces.append("\n")
            continue
        if name in BLOCKS:
            flush()
            in_link = 0
            if name in ("p", "li", "dd", "dt", "td", "th", "tr", "option") or stack and stack[-1][0] == "p":
                peers = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(name, (name,))
                while stack and (stack[-1][0] in ("p", *peers)):
                    opened[stack.pop()[0]] -= 1
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name in VOID:
            continue
        if name == "a":
            in_link += 1
        attrs = m["attrs"] or m["attrs2"] or ""
        boiler, home = stack[-1][1:] if stack else (False, 0)
        named = body = False
        if attrs.strip():
            for key, *vals in _ATTR.findall(attrs):
                key, val = key.lower(), "".join(vals)
                if key in ("class", "id"):
                    named = named or bool(_NAMED.search(val))
                    body = body or bool(_BODY.search(val))
                elif key == "role":
                    named = named or val.lower() in ROLES
                    body = body or val.lower() in ("main", "article")
                elif key == "itemprop":
                    body = body or val.lower() == "articlebody"
                elif key == "hidden" or key == "aria-hidden" and val.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", val, re.I):
                    named = True
        top = name in ("article", "main") or body and not named and name in ("div", "section")
        if top and name not in ("html", "body"):
            if not home and not boiler:
                homes += 1
                home = homes
            elif home and name == "article" and opened["article"]:
                boiler = True  # an article in an article is a reader comment
        if name in BOILER or name == "header" and not home or named and name not in ("html", "body", "article", "main") and not (body and top):
            boiler = True
        if name in BLOCKS or named or boiler != (stack[-1][1] if stack else False):
            if name not in BLOCKS and boiler and not (stack and stack[-1][1]):
                flush()  # an inline element that is boilerplate ends the block before it
            stack.append((name, boiler, home))
            opened[name] += 1
    if at < len(page):
        said(page[at:])
    flush()
    return out


def labels_of(blocks: list[Block]) -> list[int]:
    """GOOD or BAD for each block."""
    any_home = any(b.home and not b.boiler for b in blocks)
    first = []
    found = [[w.lower() for w in _LETTERS.findall(b.text)] for b in blocks]
    densities = [sum(w in STOP for w in words) / len(words) if words else 0.0 for words in found]
    # in a language without a list, no long block has its words
    listed = any(d >= LOW for d, b in zip(densities, blocks, strict=True) if len(b.text) >= SHORT) or not any(len(b.text) >= SHORT and not b.boiler and b.linked / len(b.text) <= LINKS for b in blocks)
    for b, density in zip(blocks, densities, strict=True):
        size = len(b.text)
        if not listed:
            density = HIGH  # unknown: length decides
        if not b.text.isascii() and (other := len(_OTHER.findall(b.text))):
            size += 2 * len(_DENSE.findall(b.text))
            if 2 * other > sum(map(len, _LETTERS.findall(b.text))):
                density = HIGH
        if b.boiler or any_home and not b.home or b.linked / len(b.text) > LINKS:
            first.append(BAD)
        elif b.home:
            first.append(GOOD if size >= SHORT and density >= LOW else OPEN)
        elif b.text.startswith(("©", "Copyright")) or "©" in b.text[:40] or b.heading and size < SHORT:
            first.append(BAD if not b.heading else OPEN)
        elif size < SHORT:
            first.append(OPEN)
        else:
            first.append(GOOD if density >= HIGH or density >= LOW and size > 200 else OPEN if density >= LOW else BAD)
    out = list(first)
    # the nearest decided block before and after each, with its distance
    for k, b in enumerate(blocks):
        if first[k] == OPEN:
            out[k] = GOOD if b.home else BAD
    for home in {b.home for b in blocks}:
        own = [k for k, b in enumerate(blocks) if b.home == home and not b.boiler] if home else [k for k, b in enumerate(blocks) if not b.home]
        before, last = {}, None
        for k in own:
            before[k] = last
            last = k if first[k] != OPEN else last
        last = None
        for k in reversed(own):
            if first[k] == OPEN:
                a, z = before[k], last
                known = [x for x in (a, z) if x is not None]
                if known:
                    near = min(known, key=lambda x: (abs(x - k), -first[x]))
                    out[k] = first[a] if len(known) == 2 and first[a] == first[z] else first[near]
                    if home and first[near] == BAD and not (len(known) == 2 and first[a] == first[z] == BAD and blocks[k].linked):
                        out[k] = GOOD  # an unlinked block of an article isn't ruled out by a list of links beside it
            last = k if first[k] != OPEN else last
    if GOOD not in out:  # a page of short blocks only
        out = [GOOD if x == OPEN and not b.linked else y for b, x, y in zip(blocks, first, out, strict=True)]
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, y in zip(blocks, labels_of(blocks), strict=True) if y == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in parts_of(b.column(2)):
                found = [main_text(t) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), b.column(1).slice(lo, len(texts)), pa.array(found), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    lean = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return lean.mapInArrow(run, "page_id long, url string, text string, n_chars long")
