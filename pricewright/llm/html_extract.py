"""HTML extraction by line-block distribution: the text between surges and dives of text length over lines."""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

# HTML elements by what they do to text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
SKIP = frozenset("nav footer button select label input menu dialog head object embed canvas audio video".split())
SOFT = frozenset("aside form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words at the start or end of a class, id or role that speak against an article.
NOISE = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar notice notices alert newsletter subscribe subscription signup login social share sharing related recommended recommendations widget pagination pager search contentinfo complementary".split())
#: Words for what readers wrote and what isn't shown with the page.
STRONG = frozenset("comment comments disqus respond replies reply cookie cookies consent gdpr popup modal overlay skip dialog hidden".split())
#: Words that say what a page does with such a thing, or that it has none: ``comments-open`` isn't where comments stand.
STATE = frozenset("open opened closed shown visible enabled disabled on off has have no not non without with is to how free count".split())
INSIDE = frozenset(("article", "main"))
#: Elements that a new element of their kind closes, and those that keep it from doing so.
ITEMS = frozenset("p li dt dd tr option".split())
HOLDERS = frozenset("ul ol dl table div section blockquote article main".split())

_TAG = re.compile(r"""<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>(?:"[^"]*"|'[^']*'|[^'">])*))>""", re.S)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_OPEN = re.compile(r"<[a-zA-Z/!?]")

#: Lines in a block of the distribution; characters that a block has to reach for a surge, on pages that have such a block.
WIDTH, SURGE = 3, 80
#: A marked element counts as text after all if, on a page without an unmarked article, it holds so many times what is unmarked. A strongly marked one does if there is nothing else.
OUTWEIGHS = 4
#: The share of a page's text that articles must hold for the lines outside them to weigh less, and how much less those weigh then.
SHARE, OUTSIDE = 1 / 3, 0.25


def _noise(attrs: str) -> int:
    """0: nothing said; 1: marked as no article; 2: strongly so."""
    if not attrs:
        return 0
    found = 2 if _HIDDEN.search(attrs) else 0
    for m in _MARK.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in re.split(r"[_\-:.]+|(?<=[a-z])(?=[A-Z])", name) if w]
            if words and not STATE.intersection(words):
                ends = {words[0], words[-1]}
                strong = ends & STRONG and (ends & STRONG != {"hidden"} or len(words) == 1)
                found = max(found, 2 if strong else 1 if ends & NOISE else 0)
    return found


class Page:
    """The page as lines: text, characters outside links, whether inside an article, and the innermost marked element around it (-1: none)."""

    def __init__(self, html: str):
        self.out: list[tuple[str, int, bool, int]] = []
        self.around: list[int] = []  # of each marked element: the next one around it
        self.strong: set[int] = set()
        self.holders: set[int] = set()  # those that hold an article
        self.stack: list[tuple[str, int, bool]] = []  # name, 1 if left out, whether marked
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # open elements by name, and those of a kind
        self.mark = -1
        self.parts: list[str] = []
        self.linked = self.off = self.inside = self.link = 0
        self.read(html)

    def flush(self, gap: bool = False) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append((text, max(0, len(text) - self.linked), self.inside > 0, self.mark))
        elif gap and self.out and self.out[-1][0]:
            self.out.append(("", 0, self.inside > 0, self.mark))
        self.parts.clear()
        self.linked = 0

    def say(self, text: str) -> None:
        if self.off or not text:
            return
        text = unescape(text) if "&" in text else text
        self.parts.append(text)
        if self.link:
            self.linked += len(text.strip())

    def shut(self, i: int) -> None:
        for name, left_out, marked in self.stack[i:]:
            for key in self.keys(name):
                self.places[key].pop()
            self.off -= left_out
            self.inside -= name in INSIDE
            self.link -= name == "a"
        for _, _, marked in reversed(self.stack[i:]):
            if marked:
                self.mark = self.around[self.mark]
        del self.stack[i:]

    @staticmethod
    def keys(name: str) -> list[str]:
        return [name] + ["/blocks"] * (name in BLOCKS) + ["/holders"] * (name in HOLDERS)

    def last(self, key: str) -> int:
        """Where the innermost open element of a name or kind stands; -1: nowhere."""
        at = self.places[key] if key in self.places else None
        return at[-1] if at else -1

    def read(self, html: str) -> None:
        at, n, last = 0, len(html), html.rfind(">")
        while at < n:
            i = html.find("<", at)
            while i >= 0 and not _OPEN.match(html, i):
                i = html.find("<", i + 1)
            self.say(html[at : n if i < 0 else i])
            if i < 0 or i > last:  # no tag is left that ends
                break
            if html.startswith("<!--", i):
                end = html.find("-->", i + 4)
                at = n if end < 0 else end + 3
            elif html[i + 1] in "!?":
                end = html.find("]]>" if html.startswith("<![CDATA[", i) else ">", i)
                at = n if end < 0 else html.index(">", end) + 1
            elif m := _TAG.match(html, i):
                at = m.end()
                name, attrs = m["name"].lower(), m["attrs"]
                if m["close"]:
                    self.close(name)
                else:
                    bare = attrs.rstrip().endswith("/")
                    if name in RAW:
                        if not bare:
                            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                            at = n if end is None else end.end()
                        if name in BLOCKS:
                            self.flush()
                    else:
                        self.open(name, attrs, bare)
            else:  # an open quote or no name: up to the next end of a tag
                at = html.index(">", i) + 1
        self.flush()

    def close(self, name: str) -> None:
        block = name in BLOCKS
        if block:
            self.flush()
        elif name in ("td", "th"):
            self.say(" ")
        i = self.last(name)
        # what isn't a block doesn't close the blocks inside it
        if i < 0 or not block and self.last("/blocks") > i:
            return
        off, mark = self.off, self.mark
        if mark >= 0 and any(marked for _, _, marked in self.stack[i:]):
            self.flush()
        self.shut(i)
        if off and not self.off or mark != self.mark:
            self.flush(True)

    def open(self, name: str, attrs: str, bare: bool) -> None:
        if name in ("br", "td", "th", "img"):
            self.say(" ")
        if name in BLOCKS:
            if name in ITEMS:
                i = self.last(name)
                if i > self.last("/holders"):
                    self.flush()
                    self.shut(i)
            self.flush()
        if name in VOID or bare and name not in BLOCKS:
            return
        left_out = name in SKIP or name == "header" and not self.inside
        noise = 0 if left_out or name in ("html", "body", "article", "main") and not self.inside else max(_noise(attrs), int(name in SOFT))
        if (left_out or noise) and not self.off:
            self.flush(True)
        for key in self.keys(name):
            self.places[key].append(len(self.stack))
        self.stack.append((name, left_out, noise > 0))
        self.off += left_out
        if noise:
            self.around.append(self.mark)
            self.mark = len(self.around) - 1
            if noise == 2:
                self.strong.add(self.mark)
        if name in INSIDE:
            self.inside += 1
            x = self.mark
            while x >= 0 and x not in self.holders:
                self.holders.add(x)
                x = self.around[x]
        self.link += name == "a"

    def lines(self) -> list[tuple[str, int, bool]]:
        """(text, characters outside links, inside an article); what is noise gives an empty line.

        Unmarked text stands. A marked element that holds articles counts as text if these hold ``OUTWEIGHS`` times
        what the page's other articles do. Others count only on pages without an unmarked article,
        where they outweigh the unmarked text (strongly marked ones: where there is none): such a page is marked as a
        whole. The fullest is looked at first.
        """
        own: dict[int, int] = defaultdict(int)
        article: dict[int, int] = defaultdict(int)
        for _, plain, inside, mark in self.out:
            own[mark] += plain
            article[mark] += plain * inside
        # marked elements are numbered from the outside in, so this adds what is inside
        for x in range(len(self.around) - 1, -1, -1):
            y = self.around[x]
            if y >= 0:
                own[y] += own[x]
                article[y] += article[x]
        kept = {-1}
        base, inner = own[-1], article[-1]
        for x in sorted(range(len(self.around)), key=lambda x: (-own[x], x)):
            y = self.around[x]
            if not own[x] or y not in kept:
                continue
            rest = own[y] - own[x] if y >= 0 else base
            within = article[y] - article[x] if y >= 0 else inner
            if x in self.holders and y < 0:
                good = article[x] > OUTWEIGHS * within
            else:
                good = within == 0 and (rest == 0 if x in self.strong else own[x] > OUTWEIGHS * rest)
            if good:
                kept.add(x)
                if y < 0:
                    base, inner = base + own[x], inner + article[x]
        found: list[tuple[str, int, bool]] = []
        for text, plain, inside, mark in self.out:
            if text and mark in kept:
                found.append((text, plain, inside))
            elif found and found[-1][0]:
                found.append(("", 0, inside))
        return found


def blocks(weights: np.ndarray) -> np.ndarray:
    """The sum of ``WIDTH`` lines from each on."""
    total = np.concatenate([[0], np.cumsum(weights)])
    return total[np.minimum(np.arange(len(weights)) + WIDTH, len(weights))] - total[:-1]


def spans(weights: np.ndarray, least: float | None = None) -> list[tuple[int, int]]:
    """[surge, dive) line ranges: a block of lines rises to the surge and the text goes on; later two blocks hold nothing.

    A surge is ``least`` characters: ``SURGE``, or on pages whose fullest block has fewer than twice that, half of it.
    """
    n = len(weights)
    if not n or not weights.any():
        return []
    block = blocks(weights)
    least = min(SURGE, block.max() / 2) if least is None else least
    out, i = [], 0
    while i < n:
        if weights[i] and block[i] >= least:
            j = i
            while j < n and (block[j] or j + 1 < n and block[j + 1]):
                j += 1
            out.append((i, j))
            i = j
        i += 1
    return out


def chosen(found: list[tuple[str, int, bool]]) -> list[int]:
    """The lines that the distribution of text over lines keeps.

    A line weighs its characters outside links, if they are half of it at least. Where articles hold their share,
    any line outside weighs a quarter, and what is inside needs no more than a character for a surge: only where nothing but
    links stands for a whole block does the text dive. At the edges of an article shorter runs of such lines stay.
    """
    inside = np.array([x for _, _, x in found], bool)
    there = np.array([bool(text) for text, _, _ in found], bool)
    plain = np.array([x for _, x, _ in found], int)
    weights = np.where(2 * plain >= np.array([len(text) for text, _, _ in found], int), plain, 0)
    within = plain[inside].sum()
    if not within or within < SHARE * plain.sum():
        if not weights.any():  # an article of links alone is an article
            weights = np.where(inside & there, 1, 0)
        return [i for a, b in spans(weights) for i in range(a, b) if there[i]]
    surge = min(SURGE, blocks(np.where(inside, plain, 0)).max() / 2)
    keep = []
    for a, b in spans(np.where(inside, weights, 0), 1):
        while a and b - a < len(found) and inside[a - 1] and there[a - 1] and not weights[a - 1] and not _long(inside, there, weights, a - 1, -1):
            a -= 1
        while b < len(found) and inside[b] and there[b] and not weights[b] and not _long(inside, there, weights, b, 1):
            b += 1
        keep += [i for i in range(a, b) if there[i] and inside[i]]
    for a, b in spans(np.where(inside, 0, weights * OUTSIDE), surge):
        keep += [i for i in range(a, b) if there[i] and not inside[i]]
    return sorted(set(keep))


def _long(inside: np.ndarray, there: np.ndarray, weights: np.ndarray, i: int, step: int) -> bool:
    """Whether ``WIDTH`` weightless lines of an article stand in a row from line i on."""
    run = [j for j in range(i, i + step * WIDTH, step) if 0 <= j < len(weights)]
    return len(run) == WIDTH and all(inside[j] and there[j] and not weights[j] for j in run)


def extract(html: str | None) -> str:
    """The main text of a page; see ``extract_pages``."""
    if not html:
        return ""
    found = Page(html).lines()
    return "\n".join(found[i][0] for i in chosen(found)) if found else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row.

    Markup, scripts, styles, menus, headers, footers and fields of forms go by
    their elements. What is left are lines, one a block element, with character
    references decoded and white space turned into single spaces. Elements that
    are marked as sidebars, notices, adverts, comments, hidden and the like have no weight, unless
    they hold most of what stands in articles or, on pages without an unmarked article, nearly all of the text.

    Weights summed over ``WIDTH`` lines form the distribution; what stands
    between a surge and the following dive is the text, short lines included. Being inside ``article`` or ``main``
    only scales the weights (see ``chosen``): a list of links inside may dive, and a long text outside may rise.

    Null and empty pages give an empty text, pages cut off anywhere what stands
    before the cut. Every row gives one row, repeated and null ids too; other
    columns are not read; an empty table gives an empty result. Linear in the
    page's length, however deep its elements are nested.
    """
    short_batches(pages.sparkSession)
    a, b = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches):
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), F.col(f"`{html_col}`")).mapInArrow(run, f"`{id_col}` {a}, `{url_col}` {b}, text string, n_chars long")
