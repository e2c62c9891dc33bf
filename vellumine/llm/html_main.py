"""Main text of web pages by line-block distribution.

Markup is stripped to one line for each block of text. The text of elements that are never article text (menus,
footers, adverts, forms, scripts ...), and of lines that are mostly links, counts as empty. The lengths of the lines
are summed over a sliding window: the text dives where a sum is zero, and between two dives it surges if a sum exceeds
the threshold. The stretch with the most text is the article's, and so is every other that surges and stands as it does,
in article and main elements or outside of them. Lines at either end of a stretch that lie outside of the elements which
hold most of it are cut off if they are at most ``EDGE`` of its text.

Cases: null and empty pages, and pages without text, give the empty string. Where nothing surges, the stretch with the
most text is taken. Comments, quoted attributes and raw text are read as browsers do, and what follows an unfinished
tag, comment or script is dropped. Elements of a menu or advert that are never closed do not count as such (a footer
does). Each page is read once from start to end, in time that grows with its length. Repeated rows stay rows; extra columns are
ignored. An empty table gives an empty result.
"""

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import filled, slices

WINDOW, SURGE = 3, 86  # lines a window; characters in a window that are a surge
EDGE = 0.25  # share of a stretch's text that may be cut off at its ends

# HTML element names.
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
SILENT = frozenset("template object svg math canvas audio video select optgroup option button".split())
NEVER = frozenset("nav footer aside form dialog menu header".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end where one of these begins.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",)}
# Words in class, id or role that mark an element as no article text.
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer foot masthead banner ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search "
    "comment comments reply replies disqus share sharing social related recommended pagination pager widget toolbar complementary contentinfo".split()
)

# Every part is possessive, and a value's quotes count only after "=": a tag is read in one way, without going back.
TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|[^>=]++)*+)(>?)|[!?/])")
ATTRIBUTE = re.compile(r"(?<![^\s/\"'])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
TOKEN = re.compile(r"[\s_\-:]+")


def _marked(attributes: str) -> bool:
    return any(t in MARKS for m in ATTRIBUTE.finditer(attributes) for t in TOKEN.split((m[1] or m[2] or m[3] or "").lower()))


class _Page:
    """Lines of a page, gathered tag by tag."""

    def __init__(self):
        self.lines: list[tuple[list[tuple[str, bool, int]], int]] = []  # pieces (text, if of a link, what leaves it out), holder
        self.parts: list[tuple[str, bool, int]] = []
        self.open: list[tuple[str, int, int]] = []  # elements: name, what leaves their text out, outermost article or main
        self.depth: dict[str, int] = {}
        self.outs: list[list] = [[0, False]]  # elements that leave text out: the one around it, if it is closed
        self.n_holders = 0

    def around(self) -> tuple[int, int]:
        return self.open[-1][1:] if self.open else (0, 0)

    def text(self, piece: str) -> None:
        out = self.around()[0]
        if out and self.outs[out][0] is None and any(self.depth.get(h) for h in HEADINGS):  # an article's own heading
            out = self.outs[out][2]
        self.parts.append((piece, self.depth.get("a", 0) > 0, out))

    def flush(self) -> None:
        if any(not p.isspace() for p, _, _ in self.parts):
            self.lines.append((self.parts, self.around()[1]))
        self.parts = []

    def pop(self) -> None:
        name, out, _ = self.open.pop()
        self.depth[name] -= 1
        if out and out != self.around()[0]:
            self.outs[out][1] = True

    def start(self, name: str, attributes: str) -> None:
        while self.open and name in ENDED_BY.get(self.open[-1][0], ()):
            self.pop()
        if name in BLOCKS:
            self.flush()
            if self.open and self.open[-1][0] == "p":
                self.pop()
        if name == "br":
            self.text(" ")
        if name in VOID:
            return
        out, holder = self.around()
        inside = holder or name in ("article", "main")
        if name in SILENT or name in NEVER or (attributes and name not in ("html", "body", "main") and (name != "article" or holder) and _marked(attributes)):
            own = name == "header" and holder  # headings in an article's header are the article's
            self.outs.append([None if own else out, name == "footer", out])
            out = len(self.outs) - 1
        elif inside and not holder and not out:
            self.n_holders += 1
            holder = self.n_holders
        self.open.append((name, out, holder))
        self.depth[name] = self.depth.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        if self.depth.get(name):
            while self.open[-1][0] != name:
                self.pop()
            self.pop()

    def result(self) -> list[tuple[str, int, int]]:
        self.flush()
        left_out = [False]
        for own in self.outs[1:]:
            around = own[2]
            left_out.append(own[1] or left_out[around])
        out = []
        for pieces, holder in self.lines:
            kept = [(t, a) for t, a, k in pieces if not left_out[k]]
            text = "".join(t for t, _ in kept)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            out.append((text, min(len(text), sum(len(t.strip()) for t, a in kept if a)), holder))
        return out


def lines_of(source: str) -> list[tuple[str, int, int]]:
    """(text, characters of links, holder) of each line; holder: number of the outermost article or main, 0 for none."""
    page, at = _Page(), 0
    while m := TAG.search(source, at):
        if m.start() > at:
            page.text(source[at : m.start()])
        at = m.end()
        if m[2] is None:  # comment, declaration, stray end tag
            if m[0] == "<!--":
                end = source.find("-->", at - 2)
                at = end + 3 if end >= 0 else len(source)
            else:
                end = source.find(">", at)
                at = end + 1 if end >= 0 else len(source)
            continue
        if not m[4]:  # unfinished: the rest is dropped
            return page.result()
        name = m[2].lower()
        if m[1]:
            page.end(name)
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(source, at)
            at = end.end() if end else len(source)
            page.text(" ")
        else:
            page.start(name, m[3])
            if m[3].endswith("/") and name in SILENT:  # an empty element of a drawing
                page.end(name)
    page.text(source[at:])
    return page.result()


def stretches(sizes: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int, int, bool]]:
    """(first line, line after the last, size, if it surges) of the text between dives: window sums of zero, or the ends."""
    found, start, last, size, peak, total = [], None, 0, 0, 0, 0
    for i, n in enumerate(sizes):
        total += n - (sizes[i - window] if i >= window else 0)
        if start is not None and total == 0:
            found.append((start, last + 1, size, peak > surge))
            start = None
        if n:
            if start is None:
                start, size, peak = i, 0, 0
            last, size = i, size + n
        peak = max(peak, total)
    if start is not None:
        found.append((start, last + 1, size, peak > surge))
    return found


def main_text(source: str, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = lines_of(source)
    sizes = [len(t) if 2 * links <= len(t) else 0 for t, links, _ in lines]
    found = stretches(sizes, window, surge)
    if not found:
        return "\n\n".join(t for t, _, _ in lines if t) if not any(links for _, links, _ in lines) else ""
    best = max(found, key=lambda s: (s[3], s[2], -s[0]))

    def held(a: int, b: int) -> bool:
        return 2 * sum(sizes[i] for i in range(a, b) if lines[i][2]) >= sum(sizes[a:b])

    mine, out = held(*best[:2]), []
    for s in found:
        a, b, size, surges = s
        if s != best and not (surges and held(a, b) == mine):
            continue
        if mine:  # lines outside of the article at the ends
            inside = [i for i in range(a, b) if lines[i][2]]
            if inside and sum(sizes[a : inside[0]]) + sum(sizes[inside[-1] + 1 : b]) <= EDGE * size:
                a, b = inside[0], inside[-1] + 1
        out += [t for t, _, _ in lines[a:b] if t]
    return "\n\n".join(out)


def extract(pages: DataFrame, html_col: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """``page_id, url, text`` of every page; each page is worked on by itself, without a shuffle."""
    pages = pages.select("page_id", "url", F.col(html_col).cast("string").alias("html"))
    schema = pages.select("page_id", "url", F.col("html").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(h, window, surge) for h in filled(b, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.mapInArrow(run, schema)
