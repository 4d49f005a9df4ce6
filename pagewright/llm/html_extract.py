"""Main text of web pages: parser events, text-to-tag ratios, smoothing, and clustering of content regions.

The standard library's parser streams events; each block of text becomes a line with its text-to-tag ratio. The ratios
are smoothed with a Gaussian and split into two clusters; lines of the upper one anchor the content. The region is the
innermost container that holds all anchored lines (those in article and main elements, where these hold most of the
anchored text), and all of its lines belong to it, short ones too, except what is marked as no part of an article:
menus, headers, footers, sidebars, notices, adverts, forms, comments.

Defined cases: a null or empty html, and a page with no text outside such parts, give an empty text; unclosed tags end
with what holds them; repeated rows are extracted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
#: article and main elements are the content where they hold this share of the anchored text together
SHARE = 0.6
#: lines of links outside the content clusters, in a region without an article, are menus
LINKS = 0.6

BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 hr dt dd option legend summary html".split())
SILENT = frozenset("script style noscript template head title textarea select option button iframe object svg canvas audio video map math datalist".split())
APART = frozenset("nav header footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|adsense|sponsor(?:ed)?|promo|promotion|banner|cookies?|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe"
    r"|subscription|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|commentlist|disqus|replies|reply|respond|share|sharing|social|related|recommended|widget|toolbar|pager|pagination|login|signup|search)(?:$|[\s_-])"
)
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
_SPACE = re.compile(r"\s+")


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []  # text, tags, characters in links, container, apart
        self.parents, self.names = [-1], [""]
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, container, apart, silent
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0

    def cut(self):
        line = _SPACE.sub(" ", "".join(self.text)).strip()
        if line:
            _, container, apart, _ = self.stack[-1]
            self.lines.append((line, self.tags, self.linked, container, apart))
            self.tags = self.linked = 0
        self.text = []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "a":
            self.links += 1
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS:
            self.cut()
        if tag in VOID:
            return
        top = self.stack[-1]
        marked = tag in CONTAINERS or tag in ("p", "span", "ins")
        if tag in CONTAINERS or tag in SILENT or (marked and attrs and self.apart(tag, attrs)):
            apart = top[2] or self.apart(tag, attrs)
            container = top[1]
            if tag in CONTAINERS:
                container = len(self.parents)
                self.parents.append(top[1])
                self.names.append(tag)
            self.cut()
            self.stack.append((tag, container, apart, top[3] or tag in SILENT))

    @staticmethod
    def apart(tag, attrs) -> bool:
        if tag in APART:
            return True
        for name, value in attrs:
            if name in ("class", "id") and value and tag not in ("body", "article", "main") and _MARKS.search(value.lower()):
                return True
            if name == "hidden" or name == "role" and value in _ROLES or name == "aria-hidden" and value == "true":
                return True
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCKS:
            self.cut()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.cut()
                del self.stack[i:]
                break
            if tag not in CONTAINERS and tag not in SILENT and self.stack[i][0] in CONTAINERS:
                break

    def handle_data(self, data):
        if not self.stack[-1][3]:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    inside = np.convolve(np.ones(len(values)), weight)[reach:-reach]
    return np.convolve(values, weight)[reach:-reach] / inside


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Two means in one dimension; True for values nearer the upper mean, and for all where the two are one."""
    low, high = float(values.min()), float(values.max())
    if high - low < 1e-9:
        return np.ones(len(values), bool)
    for _ in range(50):
        upper = values >= (low + high) / 2
        now = float(values[~upper].mean()), float(values[upper].mean())
        if now == (low, high):
            break
        low, high = now
    return values >= (low + high) / 2


def main_text(html: str | None) -> str:
    if not html:
        return ""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.cut()
    lines = reader.lines
    if not lines:
        return ""
    ratio = np.array([len(text) / (1 + tags) for text, tags, *_ in lines])
    content = upper_cluster(np.log1p(smooth(ratio)))
    free = np.array([not apart for *_, apart in lines])
    if not free.any():
        return ""
    anchor = content & free if (content & free).any() else free
    named, inside = ([False] * len(reader.parents) for _ in range(2))
    for c in range(len(named)):  # parents come first
        named[c] = reader.names[c] in ("article", "main") or (c > 0 and named[reader.parents[c]])
    size = np.array([len(text) for text, *_ in lines])
    marked = anchor & np.array([named[container] for *_, container, _ in lines])
    if size[marked].sum() >= SHARE * size[anchor].sum():
        anchor = marked
    held = [0] * len(reader.parents)
    for k in np.flatnonzero(anchor):
        container = lines[k][3]
        while container >= 0:
            held[container] += 1
            container = reader.parents[container]
    region = 0
    for c in range(1, len(held)):  # the containers that hold all anchored lines are one path
        if held[c] == held[0] and reader.names[region] not in ("article", "main"):
            region = c
    for c in range(len(inside)):
        inside[c] = c == region or (c > 0 and inside[reader.parents[c]])
    kept = []
    for k, (text, _, linked, container, apart) in enumerate(lines):
        if inside[container] and not apart and (named[container] or content[k] or linked < LINKS * len(text)):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
