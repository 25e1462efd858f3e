"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and a threshold on their clusters."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

#: Elements that end a line of text. Fixed values.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text a page does not show as text, and what a head may hold. Fixed values.
HIDDEN = frozenset("head script style noscript template select textarea iframe object svg canvas audio video".split())
HEAD = frozenset("title meta link base style script noscript template".split())
#: Elements that hold no content. Fixed values.
NEVER = frozenset("nav footer aside form button menu dialog".split())
#: Headings; marks of what may stand around one.
HEADINGS, AROUND = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("header banner".split())
#: Elements without an end tag. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an element's start ends, up to the element that holds both. Fixed values.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tr td th thead tbody", "table"), "tfoot": ("tr td th thead tbody", "table")}
#: Words in class, id or role that mark what is not content, and words that say nothing beside them.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline cookie cookies comment comments consent copyright disclaimer disqus footer header menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
PLAIN = frozenset("area bar block body bottom box button buttons center column container content form group inner item items left links list main module outer page panel post posts reader right row section site slot text thread top unit user wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Least ratio of a line of an article or main part; what a character of a link counts for.
LEAST, LINK = 0.3, 0.1
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")


def marked(value: str) -> str:
    """Whether one of the names in a class or id says that an element is no content: all its words are marks or plain, and one is a mark.

    ``around`` if that mark only says that it may stand around a heading, ``noise`` for others, else empty.
    """
    found = ""
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        words = [w for w in _SPLIT.split(name) if w]
        marks = [w for w in words if w in MARKS]
        if marks and all(w in MARKS or w in PLAIN for w in words):
            if not AROUND.issuperset(marks):
                return "noise"
            found = "around"
    return found


def is_noise(tag: str, attrs: list[tuple[str, str | None]], within: bool, forms: bool = True) -> str:
    """Whether an element's text counts for nothing, as ``marked`` says it.

    ``within``: inside an article or main part, where a plain header has the
    title. ``forms``: a form is no content.
    """
    if tag in NEVER and (forms or tag != "form") or tag == "header" and not within:
        return "noise"
    if tag in ("html", "body", "main", "h1") or tag == "form":
        return ""
    found = ""
    for name, value in attrs:
        if name in ("hidden",) or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value):
            return "noise"
        if name == "role" and value and value.lower() in ROLES:
            return "noise"
        if name in ("class", "id") and value:
            kind = marked(value)
            if kind == "noise":
                return kind
            found = found or kind
    return found


class Lines(HTMLParser):
    """Lines of text of a page: text, characters that count, tags, article or main part, and the run of sister blocks.

    Text in links (anchors that lead somewhere) counts for little, text in
    elements that hold no content for nothing; in an article, headings count in
    what only stands around them. Memory grows with the page only.
    """

    def __init__(self, forms: bool = True):
        super().__init__(convert_charrefs=True)
        self.forms = forms
        #: Characters that would count if forms did, and those of them in forms.
        self.shown = self.formed = 0
        self.lines: list[tuple[str, float, int, int, tuple[int, bool, int]]] = []
        self.text: list[str] = []
        self.count = 0.0
        self.tags = 0
        self.where: tuple[int, bool, int] | None = None
        #: Open elements: name, whether noise; and how many of each name are open.
        self.open: list[tuple[str, str]] = []
        self.held: Counter[str] = Counter()
        #: Whether each open anchor leads somewhere.
        self.anchors: list[bool] = []
        self.blocks: list[int] = [0]
        self.seen = self.noise = self.around = self.hidden = self.main = self.region = 0

    def end_line(self):
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text and self.where is not None:
            self.lines.append((text, self.count, max(1, self.tags), self.where[2], self.where))
        if text or self.text:
            self.tags = 0
        self.text, self.count, self.where = [], 0.0, None

    def handle_starttag(self, tag, attrs):
        if self.held["head"] and tag not in HEAD and tag != "head":
            self._close("head")
        if tag in ENDS:
            self._imply(*ENDS[tag])
        elif tag in BLOCKS and self.held["p"]:
            self._imply("p", "table td th li button object")
        if tag in BLOCKS:
            self.end_line()
        if tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        noise = is_noise(tag, attrs, bool(self.main), self.forms)
        if noise == "around" and not self.main:
            noise = "noise"
        if noise:
            self.end_line()
            self.noise += noise == "noise"
            self.around += noise == "around"
        if tag in HIDDEN:
            self.hidden += 1
        if tag in ("article", "main"):
            if not self.main:
                self.region += 1
            self.main += 1
        if tag in BLOCKS:
            self.seen += 1
            self.blocks.append(self.seen)
        if tag == "a":
            self.anchors.append(any(name == "href" for name, _ in attrs))
        self.open.append((tag, noise))
        self.held[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def _pop(self):
        tag, noise = self.open.pop()
        self.held[tag] -= 1
        if noise or tag in BLOCKS:
            self.end_line()
        self.noise -= noise == "noise"
        self.around -= noise == "around"
        self.hidden -= tag in HIDDEN
        if tag == "a":
            self.anchors.pop()
        self.main -= tag in ("article", "main")
        if tag in BLOCKS:
            self.blocks.pop()

    def _close(self, tag: str):
        # an end tag ends what is open inside it; one without a start ends nothing
        while self.held[tag]:
            last = self.open[-1][0]
            self._pop()
            if last == tag:
                break

    def _imply(self, names: str, until: str):
        wanted, stop = names.split(), until.split()
        if not any(self.held[w] for w in wanted):
            return
        at = len(self.open) - 1
        last = None
        while at >= 0 and self.open[at][0] not in stop:
            if self.open[at][0] in wanted:
                last = at
                if len(wanted) == 1:
                    break
            at -= 1
        while last is not None and len(self.open) > last:
            self._pop()

    def handle_endtag(self, tag):
        if tag in BLOCKS and self.held[tag]:
            self.end_line()
        self.tags += 1
        self._close(tag)

    def handle_data(self, data):
        if self.hidden:
            return
        silent = bool(self.noise) or bool(self.around) and not any(self.held[h] for h in HEADINGS)
        if self.where is None and not data.isspace():
            self.where = (self.blocks[-2] if len(self.blocks) > 1 else 0, silent, self.region if self.main else 0)
        self.text.append(data)
        size = len(data.strip())
        if self.noise <= (self.held["form"] if self.forms else 0):
            self.shown += size
            self.formed += size if self.held["form"] else 0
        if not silent:
            self.count += size * (LINK if any(self.anchors) else 1)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with reflected ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="reflect" if len(ratios) > reach else "edge")
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def levels(lines: list, sigma: float) -> np.ndarray:
    """Logarithms of text-to-tag ratios, smoothed in each run of sister blocks."""
    ratios = np.log1p(np.array([count / tags for _, count, tags, _, _ in lines], np.float64))
    out = np.empty(len(lines))
    start = 0
    for end in range(1, len(lines) + 1):
        if end == len(lines) or lines[end][4] != lines[start][4]:
            out[start:end] = smoothed(ratios[start:end], sigma) if end - start > 1 else ratios[start:end]
            start = end
    return out


def read_lines(html: str, forms: bool = True) -> Lines:
    page = Lines(forms)
    page.feed(html)
    page.close()
    page.end_line()
    return page


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The page's content: blocks in page order, two line ends between them; empty if there is none.

    Each line has a ratio of counted characters to tags. Logarithms of ratios
    are smoothed along sister blocks and split by a threshold: the deviation of
    all levels, so that one long line does not move it much. In an article or
    main part, a line needs LEAST only: text without links does. Elsewhere each
    run of lines that has one above the threshold is content from the first to
    the last such line, with the headline just before. Text in menus, adverts
    and the like counts for nothing and stays at the bottom.
    """
    if not html:
        return ""
    page = read_lines(html)
    if 2 * page.formed > page.shown:
        page = read_lines(html, forms=False)
    lines = page.lines
    if not lines:
        return ""
    level = levels(lines, sigma)
    least = np.log1p(LEAST)
    bar = max(least, min(level.std(), level.max()))
    region = np.array([r for _, _, _, r, _ in lines])
    silent = np.array([w[1] for *_, w in lines])
    keep = (region > 0) & (level >= least)
    group = np.where(silent, -1, region)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(lines)]))
    for start, end in zip(cuts[:-1], cuts[1:]):
        if group[start] == 0:
            at = np.flatnonzero(level[start:end] >= bar)
            if len(at):
                keep[start + max(0, at[0] - 1) : start + at[-1] + 1] = True
    return "\n\n".join(lines[k][0] for k in np.flatnonzero(keep))


def _extract(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            keep = [k for k, name in enumerate(part.schema.names) if name != "html"]
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*[part.schema.names[k] for k in keep], "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages``.

    Null or empty html, and pages without content, give an empty text. Tags
    that are left open end with the page; text of any length is kept whole.
    Repeated rows give equal results. Other columns do not matter.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
