"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Scripts, styles, comments and the like are no text;
what lies in a part that its tag, role, class or id names as navigation, header, footer, sidebar, notice, advert,
form or reader comments is boilerplate. Pass one decides blocks by themselves: many letters in links or a
copyright line is bad; a short block is open; a longer one is good or
near-good by its length and its share of stop words (by its length, on a page where no block has that
share, as in other languages). Pass two settles the open blocks by the nearest
decided ones before and after. Where a page marks its article or main part, blocks
outside it are bad, and inside it the stop words ask for less, as the mark-up already speaks for it.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Frequent function words of English, German, French, Spanish.
STOP_WORDS = frozenset("""
a an and are as at be been but by can for from had has have he her his i if in is it its not of on or our she so that the
their them there they this to was we were which who will with would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in
ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wie wir zu zum zur
au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa
se ses son sont sur un une vous à
al como con de del el ella en era es esta este ha la las le lo los más me mi no o para pero por que se si sin su sus también
un una y ya
""".split())

# Tags without running text, tags that open a block, tags and names of boilerplate parts.
NO_TEXT = frozenset("script style noscript template textarea select svg math iframe object canvas head title audio video".split())
TAKES_ALL = frozenset("script style textarea iframe noscript template".split())
BLOCK = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
""".split())
PARTS = frozenset("nav header footer aside form menu dialog button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar tooltip".split())
NAMES = frozenset("""
ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promoted promotion
nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc skip
header masthead topbar footer bottom sidebar side aside rail widget widgets
cookie cookies consent gdpr notice notification alert popup modal overlay paywall disclaimer copyright legal
newsletter subscribe subscription signup login register search form
comment comments commentlist respond reply replies disqus discussion
share sharing social related recommended recommendations trending
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

SHORT, LONG = 70, 200
MOST_LINKS = 0.2
STOP_LOW, STOP_HIGH = 0.15, 0.25
STOP_INSIDE = 0.02

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _boilerplate(tag: str, attributes: str) -> bool:
    if tag in PARTS:
        return True
    if tag in ("body", "html", "article", "main") or not attributes.strip():
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and HIDDEN.search(value)):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id") and not NAMES.isdisjoint(NAME.findall(CAMEL.sub("-", value).lower())):
            return True
    return False


class Block:
    __slots__ = ("parts", "linked", "dropped", "inside", "heading", "text", "state")

    def __init__(self, dropped: bool, inside: bool, heading: bool):
        self.parts, self.linked, self.dropped, self.inside, self.heading = [], 0, dropped, inside, heading
        self.text, self.state = "", "bad"


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open block-level tags: name, boilerplate from here on, inside the article from here on
    dropped = inside = False
    links = 0
    now = Block(False, False, False)

    def close(heading=False):
        nonlocal now
        if now.parts:
            now.text = " ".join(entities.unescape("".join(now.parts)).split())
            if now.text:
                out.append(now)
        now = Block(dropped, inside, heading)

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            now.parts.append(page[at:])
            break
        if m.start() > at:
            piece = page[at : m.start()]
            now.parts.append(piece)
            if links:
                now.linked += len(entities.unescape(piece).strip())
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and tag in NO_TEXT and not attributes.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            # unclosed, only these take in the rest of the page, as browsers have it; of others the tag alone is skipped
            if stop is None and tag not in TAKES_ALL:
                continue
            at = end if stop is None else stop.end()
            if tag in BLOCK:
                close()
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            now.parts.append(" ")
        elif closing:
            # the nearest open tag of that name and all within it end
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                    break
            if tag in BLOCK:
                links = 0
                close()
        elif tag in BLOCK or (tag not in VOID and _boilerplate(tag, attributes)):
            if tag in ("article", "main") and not any(s[0] in ("article", "main") for s in stack):
                # a part left open before the article does not take it in
                stack = [s for s in stack if not s[1]]
                dropped = False
            if tag in ("p", "li", "td", "th", "tr", "dd", "dt") and stack and stack[-1][0] == tag:
                stack.pop()
                dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            dropped = dropped or _boilerplate(tag, attributes)
            inside = inside or tag in ("article", "main")
            if not (tag in VOID or attributes.endswith("/")):
                stack.append((tag, dropped, inside))
            if tag in BLOCK:
                close(heading=len(tag) == 2 and tag[0] == "h" and tag != "hr")
            elif dropped:
                close()
    close()
    return out


def _stop_share(b: Block) -> float:
    words = b.text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def _alone(b: Block, marked: bool, listed: bool) -> str:
    """Pass one: good, near, short or bad; ``listed`` tells whether the page is in a language of the stop words."""
    if b.dropped or (marked and not b.inside):
        return "bad"
    n = len(b.text)
    links = b.linked / n
    if links > MOST_LINKS:
        return "bad"
    if not b.inside and ("©" in b.text or "all rights reserved" in b.text.lower()):
        return "bad"
    if n < SHORT:
        return "bad" if links and not b.inside else "short"
    if not listed:
        # what is left of broken mark-up is no language either
        if 20 * b.text.count("<") > n:
            return "bad"
        return "good" if n > LONG else "near"
    share = _stop_share(b)
    if b.inside:
        return "good" if share >= STOP_INSIDE else "near"
    if share >= STOP_HIGH:
        return "good" if n > LONG else "near"
    return "near" if share >= STOP_LOW else "bad"


def classify(found: list[Block]) -> None:
    """Both passes; afterwards every block is good or bad."""
    marked = any(b.inside and not b.dropped for b in found)
    # where no longer block of the page has its share of stop words, length and links alone decide
    asked = [b for b in found if not b.dropped and len(b.text) >= SHORT]
    listed = not asked or any(_stop_share(b) >= STOP_LOW for b in asked)
    first = [_alone(b, marked, listed) for b in found]
    n = len(found)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        before[i] = last
        if first[i] in ("good", "bad") and not found[i].dropped:
            last = i
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        if first[i] in ("good", "bad") and not found[i].dropped:
            last = i
    for i, b in enumerate(found):
        state = first[i]
        if state in ("short", "near"):
            # blocks which the mark-up rules out, or beyond the article's ends, are no neighbours; with none at all the mark-up decides
            near = [k for k in (before[i], after[i]) if k is not None and found[k].inside == b.inside]
            if b.heading and after[i] in near:
                near = [after[i]]
            good = [abs(i - k) for k in near if first[k] == "good"]
            bad = [abs(i - k) for k in near if first[k] == "bad"]
            if not good and not bad:
                state = "good" if b.inside or state == "near" else "bad"
            elif not bad or not good:
                state = "good" if good else "bad"
            elif state == "near" or b.inside:
                state = "good" if min(good) <= min(bad) else "bad"
            else:
                state = "good" if min(good) < min(bad) else "bad"
        b.state = state


def main_text(page: str | None) -> str:
    """The good blocks of a page, one on a line."""
    if not page:
        return ""
    found = blocks(page)
    classify(found)
    return "\n".join(b.text for b in found if b.state == "good")


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` with (text, n_chars) of every row; n_chars counts code points.

    A null or empty page, or one without main text, has an empty text. Rows that repeat are each extracted. A page
    is one task's row whatever its length; other columns are ignored. Of unclosed tags, script, style, textarea, iframe, noscript and
    template take in what follows them; all others end where their parent does.
    """
    slim = pages.select(*(F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)), F.col(f"`{html_col}`").cast("string").alias("html"))
    kinds = [f.dataType.simpleString() for f in slim.schema.fields[:-1]]

    def run(batches):
        for b in batches:
            text = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f"keep_{i}") for i in range(len(keep))), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*(f"keep_{i}" for i in range(len(keep))), "text", "n_chars"]
            )

    out = slim.mapInArrow(run, ", ".join([*(f"keep_{i} {k}" for i, k in enumerate(kinds)), "text string, n_chars long"]))
    return out.select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")
