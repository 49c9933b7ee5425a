"""HTML extraction: flat text blocks, judged by a small decision tree on their and their neighbours' word counts and link densities."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.blocks_table import LABELLED
from trajspark.llm.common import small_batches

FEATURES = ["words", "link_density", "words_before", "density_before", "words_after", "density_after", "marked", "in_article", "beside_article"]
DEPTH, LEAST = 8, 1
FAINT = 0.01
MARKS = (1, 3)

# Element names by what they mean for the text around them.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup "
                   "hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe object title canvas audio video map".split())
CLUTTER = frozenset("nav footer aside form menu dialog button select search fieldset".split())
ARTICLE = frozenset("article main".split())
# Words of class, id and role names that mark clutter.
HINTS = frozenset("ad ads advert adverts advertisement advertising alert alertdialog aside banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disclaimer disqus dropdown "
                  "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promoted promotion "
                  "recommended related respond responses reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar topbar tracking widget widgets".split())
WHOLE = frozenset("html body article main".split())
STEMS = tuple("adbanner adbox adsense adslot adunit advert breadcrumb commentarea commentbox commentform commentlist commentsection commentthread cookie footer mainnav newsletter sidebar sitenav sponsor topnav".split())
# A name that begins so says what a page has or lacks, not what its element is.
QUALIFIED = re.compile(r"(?<![\w-])(?:has|have|no|with|without)(?:[-_]+\w[\w-]*|(?=[A-Z])\w[\w-]*)")
# With these, a name that says header means the head of the article.
OWN = frozenset("article post entry story content main body".split())
# An article in these is none of its own; one after another article is not either, in wrappers whose names have these words.
HOLDS = frozenset("aside footer dialog".split())
BESIDE = frozenset("comment comments complementary disqus outbrain recommended related replies reply respond responses sidebar sponsored taboola widget widgets".split())
# A form with these in it is around the page.
PAGE = frozenset("nav header footer".split())
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile("[>\"']")
NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def names_of(attributes: str) -> Iterator[list[str]]:
    """The words of each class, id and role name, without those that a has, no or with qualifies."""
    for value in NAMED.findall(attributes):
        yield re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", QUALIFIED.sub("", value)).lower())


def kind_of(name: str, attributes: str, inside: bool) -> int:
    """1: clutter, 2: article, 3: clutter by a name only, 0: none; ``inside``: in an article already."""
    if name in CLUTTER:
        return 1
    if name == "header":
        return 0 if inside else 1
    if name not in WHOLE and attributes:
        for words in names_of(attributes):
            hints = {w for w in words if w in HINTS or w.startswith(STEMS)}
            if hints - {"header"} or hints and not (inside or re.match("h[1-6]$", name) or OWN.intersection(words)):
                return 3
    if name in ARTICLE or name == "div" and re.search(r"\b(?:role\s*=\s*[\"']?main|itemprop\s*=\s*[\"']?articleBody)\b", attributes):
        return 2
    return 0


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of the tags of a page; comments, declarations and whole elements like scripts have no name.

    The page is gone over once: what is scanned is consumed, or nothing can be found after it any more. A quotation mark without a partner is
    an ordinary character; a tag that never ends is text, and so is what follows.
    """
    at = page.find("<")
    lonely = {'"': False, "'": False}  # no further mark of this kind
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(page)
            yield at, end, "", "", ""
        elif page[at + 1:at + 2] in ("!", "?"):
            end = page.find(">", at) + 1 or len(page)
            yield at, end, "", "", ""
        else:
            slash = "/" if page.startswith("/", at + 1) else ""
            named = NAME.match(page, at + 1 + len(slash))
            if named is None:
                at = page.find("<", at + 1)
                continue
            name, end = named[0].lower(), named.end()
            if name in RAW and not slash:
                end = page.find(">", end) + 1
                if not end:
                    return
                if page[end - 2] != "/":
                    close = CLOSE[name].search(page, end)
                    end = close.end() if close else len(page)
                yield at, end, "", "", ""
            else:
                while True:
                    stop = STOP.search(page, end)
                    if stop is None:
                        return
                    end = stop.end()
                    if stop[0] == ">":
                        break
                    if not lonely[stop[0]]:
                        partner = page.find(stop[0], end)
                        lonely[stop[0]] = partner < 0
                        end = partner + 1 or end
                yield at, end, slash, name, page[named.end():end - 1]
        at = page.find("<", end)


CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def text_blocks(page: str) -> list[tuple[str, list[float]]]:
    """The text blocks of a page in order, with words, link density, marked, in article, beside an article.

    Elements like navigation mark with 1. A name is soft evidence: it marks with one less the share of the page's words that its element holds,
    so a name on a wrapper around the whole page says nearly nothing, and one on a part of it nearly as much as an element does.
    An article that opens in clutter ends the mark for its own content, but for those in asides and the like, comments and teasers. A form
    whose names do not say clutter, with an article or the navigation, header or footer of the page in it, is none.
    """
    out: list[tuple[str, list[float]]] = []
    stack: list[tuple[str, int, int]] = []  # name, kind, marks around an article that ended them
    open_names: Counter[str] = Counter()
    ended: list[int] = []  # places in the stack of articles that ended marks,
    holders: list[int] = []  # of elements that hold articles of their own,
    forms: list[tuple[int, int]] = []  # of forms that may be around the page, with the number of blocks before
    freed: list[tuple[int, int]] = []  # blocks from .. to lose a mark
    named: list[list[int]] = []  # first and last block of elements that a name marks
    active: list[tuple[int, int, bool]] = []  # marks: place in the stack, number in named or -1, whether an element is among it and those around it
    marked_by: list[int] = []  # per block: number in named, -1 for an element, -2 for nothing
    clutter = article = links = at = 0
    seen = False  # an article
    parts: list[str] = []
    linked: list[str] = []

    def within() -> bool:
        """Whether the innermost mark counts here: no article inside it ended it."""
        return bool(active) and (not ended or active[-1][0] > ended[-1])

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                words = len(text.split())
                share = len(" ".join(unescape("".join(linked)).split()).split()) / words
                out.append((text, [float(words), min(1.0, share), float(clutter), float(article > 0)]))
                marked_by.append(-2 if not clutter else -1 if not within() or active[-1][2] else active[-1][1])
            parts.clear()
            linked.clear()

    def leave() -> str:
        nonlocal clutter, article, links
        name, kind, marks = stack.pop()
        open_names[name] -= 1
        clutter += marks - (kind in MARKS)
        article -= kind == 2
        links -= name == "a"
        for places in (ended, holders):
            while places and places[-1] >= len(stack):
                places.pop()
        while forms and forms[-1][0] >= len(stack):
            forms.pop()
        while active and active[-1][0] >= len(stack):
            number = active.pop()[1]
            if number >= 0:
                named[number][1] = len(out)
        return name

    def free(lowest: int, places: set[int]) -> None:
        """Marks from a place on anew, without those at some places."""
        above = []
        while active and active[-1][0] >= lowest:
            above.append(active.pop())
        for place, number, _ in reversed(above):
            if place not in places:
                mark(place, number)

    def mark(place: int, number: int) -> None:
        active.append((place, number, number < 0 or within() and active[-1][2]))

    def add(text: str) -> None:
        parts.append(text)
        if links:
            linked.append(text)

    for start, end, slash, name, attributes in tokens(page):
        if start > at:
            add(page[at:start])
        at = end
        if not name:
            continue
        if slash:
            if name in BLOCKS:
                flush()
            if open_names[name]:
                while leave() != name:
                    pass
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            flush()
            while stack and (stack[-1][0] == "p" or name == stack[-1][0] and name in ("li", "dd", "dt", "td", "th", "tr", "option")):
                leave()
            if name not in ("p",) and stack and stack[-1][0] in ("b", "i", "em", "strong", "span", "font", "u") and open_names["p"]:
                while leave() != "p":
                    pass
        if name in VOID or attributes.endswith("/"):
            continue
        kind = kind_of(name, attributes, article > 0)
        if clutter and (kind == 2 or name in PAGE and not article):
            for place, before in forms:
                stack[place] = (stack[place][0], 0, 0)
                clutter -= 1
                freed.append((before, len(out)))
            if forms:
                free(forms[0][0], {place for place, _ in forms})
                holders = [h for h in holders if h not in {place for place, _ in forms}]
                forms.clear()
        marks, holds = 0, False
        if kind == 2:
            own = set().union(*names_of(attributes)) if name == "article" else set()
            inner = ended[-1] + 1 if ended else 0
            if clutter and (name != "article" or (own & OWN or not own & HINTS) and not (holders and holders[-1] >= inner)):
                marks, clutter = clutter, 0
            seen = seen or clutter == 0 and (name == "article" or "articleBody" in attributes)
        elif kind in MARKS:
            holds = name in HOLDS or seen and not BESIDE.isdisjoint(set().union(*names_of(attributes)))
        if marks:
            ended.append(len(stack))
        if holds:
            holders.append(len(stack))
        if kind == 1 and name == "form" and kind_of("div", attributes, article > 0) not in MARKS:
            forms.append((len(stack), len(out)))
        if kind in MARKS:
            mark(len(stack), -1 if kind == 1 else len(named))
            if kind == 3:
                named.append([len(out), -1])
        stack.append((name, kind, marks))
        open_names[name] += 1
        clutter += kind in MARKS
        article += kind == 2
        links += name == "a"
    if at < len(page):
        rest = page[at:]
        add(rest if not re.match(r"<[/a-zA-Z!?]", rest) else "")
    flush()
    fewer = [0] * (len(out) + 1)
    for a, b in freed:
        fewer[a] += 1
        fewer[b] -= 1
    fewer = list(accumulate(fewer))
    before = [0.0, *accumulate(f[0] for _, f in out)]

    def marked(k: int) -> float:
        if out[k][1][2] <= fewer[k]:
            return 0.0
        if marked_by[k] < 0:
            return 1.0
        a, b = named[marked_by[k]]
        return max(FAINT, 1 - (before[b if b >= 0 else -1] - before[a]) / before[-1])

    marks_of = [marked(k) for k in range(len(out))]
    own_text = any(f[3] and not m for (_, f), m in zip(out, marks_of))
    return [(text, [*f[:2], m, f[3], float(own_text and not f[3])]) for (text, f), m in zip(out, marks_of)]


def features(blocks: list[tuple[str, list[float]]]) -> np.ndarray:
    """Feature rows; before the first and after the last block there are no words."""
    if not blocks:
        return np.zeros((0, len(FEATURES)))
    own = np.array([f for _, f in blocks])
    near = np.vstack([np.zeros(5), own, np.zeros(5)])
    return np.column_stack([own[:, :2], near[:-2, :2], near[2:, :2], own[:, 2:]])


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> tuple:
    """A decision tree by Gini impurity: (share of 1) or (feature, threshold, below, from there on)."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = (2 * share * (1 - share) * len(y) - 1e-9, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            side = x[:, f] < t
            if min(side.sum(), (~side).sum()) < LEAST:
                continue
            loss = sum(2 * z.mean() * (1 - z.mean()) * len(z) for z in (y[side], y[~side]))
            if loss < best[0]:
                best = (loss, (f, float(t), side))
    if best[1] is None:
        return (share,)
    f, t, side = best[1]
    return f, t, grow(x[side], y[side], depth - 1), grow(x[~side], y[~side], depth - 1)


def judge(tree: tuple, row: np.ndarray) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree[0]


@lru_cache(maxsize=1)
def trained() -> tuple:
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def main_text(page: str | None, tree: tuple | None = None) -> str:
    blocks = text_blocks(page or "")
    tree = tree or trained()
    return "\n".join(text for (text, _), row in zip(blocks, features(blocks)) if judge(tree, row) >= 0.5)


def _extracted(tree: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = [main_text(h.as_py(), tree) for h in part.column("html")]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text and n_chars (its code points).

    Markup is cut into flat blocks at block elements; comments, scripts, styles and the like are no text. A block has its word count and
    link density, those of its neighbours, how far it is marked as clutter (1 in navigation, footers and forms; less in elements whose names say so, the
    more of the page they hold), and whether it lies in or beside an article. A decision tree trained on the labelled table of :mod:`blocks_table` keeps or drops it. Kept blocks have their character
    references decoded and white space joined, and are put together in page order by line feeds; nothing is capped.

    Null and empty html, and pages without a kept block, have an empty text. Malformed and cut-off markup is read as far as it goes.
    Repeated rows are read alike; extra columns are ignored.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted(trained()), "page_id long, url string, text string, n_chars long")
