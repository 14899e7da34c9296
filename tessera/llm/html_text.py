"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text; what stands in menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles
counts as markup and leaves an empty line; the text of links adds nothing to a line's
length, in an article or outside.  The lengths of ``WINDOW`` lines from each line on
are summed: a surge is where the sum comes to ``SURGE``, a dive where it falls to
nothing.  Text between a surge's rise and its dive is kept.  Marked articles (article and main
elements) are a feature: on a page that has some, lines outside have no length, and
an article surges if it has ``SHARE`` of the longest one's length; its title and last words
may be short, so that inside it a dive alone cuts, not a missing surge.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, table

WINDOW = 3
#: Characters in a window that make a surge.
SURGE = 80
#: Length of an article, to that of the page's longest, that makes a surge of its own.
SHARE = 0.25
#: Empty lines that a stripped element leaves: one inside the text makes no dive.
GAP = 1

#: Fixed lists of element names.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video".split())
DROPPED = frozenset("nav header footer aside form menu dialog select button fieldset head figure-ad".split())
ARTICLE = frozenset(("article", "main"))
#: Parts of class, id and role values that mark what is not the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side|menu\w*|nav\w*|breadcrumb\w*|header|masthead|footer\w*|notice\w*|cookie\w*|consent|gdpr|popup|modal|overlay|"
    r"comments?|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe\w*|subscription|signup|login|search|widget\w*|toolbar|pagination|pager|copyright|complementary|contentinfo|alert|paywall)(?:$|[\s_-])",
    re.IGNORECASE,
)
HIDDEN = re.compile(r"""\bhidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HEADER = re.compile(r"header|masthead", re.IGNORECASE)
_RAW_END = {name: re.compile(f"</{name}(?:[^>]*>|$)", re.IGNORECASE) for name in RAW}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)(?:>|(?=<)|\Z)""", re.DOTALL)
_VALUE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)


class _Lines:
    """Lines of (text, length without links, article number); empty ones between."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.article = 0

    def text(self, raw: str, in_link: bool) -> None:
        self.parts.append(raw)
        if in_link:
            self.linked += len("".join(html.unescape(raw).split()))

    def close(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            self.lines.append((text, max(0, len(text.replace(" ", "")) - self.linked), self.article))
        self.parts, self.linked = [], 0

    def gap(self) -> None:
        self.close()
        self.lines.extend([("", 0, self.article)] * GAP)


def _dropped(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED and not (in_article and name == "header"):
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for m in _VALUE.finditer(attributes):
        value = _CAMEL.sub("-", next((v for v in m.groups() if v), ""))
        # An article's own header has its title.
        if MARKS.search(_HEADER.sub("", value) if in_article or name == "article" else value):
            return True
    return bool(HIDDEN.search(attributes))


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """The page's lines; open elements are kept on a stack, and an end tag closes its
    element and those opened since, so that unclosed ones do no harm.  Open elements are
    counted by name, so that an end tag without a start costs nothing."""
    out, stack, at, articles = _Lines(), [], 0, 0
    # A stack entry: (name, dropped, article number outside it).
    opened: dict[str, int] = {}
    drops = links = 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at and not drops:
            out.text(page[at : m.start()], links > 0)
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if name not in INLINE and not drops:
            out.close()
        elif name == "br" and not drops:
            out.text(" ", False)
        if name in RAW and not closing:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            if not drops:
                out.gap()
        elif closing:
            if opened.get(name):
                own = ""
                while own != name:
                    own, dropped, article = stack.pop()
                    opened[own] -= 1
                    drops -= dropped
                    links -= own == "a"
                    if own in ARTICLE and not drops:
                        out.close()
                    out.article = article
                    if dropped and not drops:
                        out.parts, out.linked = [], 0
                        out.gap()
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            dropped = _dropped(name, m[3], out.article > 0)
            if name in ARTICLE and not dropped and drops and not any(opened.get(x) for x in ARTICLE):
                # An element that was never closed doesn't swallow the article.
                stack, opened, drops, links = [], {}, 0, 0
            if dropped and not drops:
                out.gap()
            stack.append((name, dropped, out.article))
            opened[name] = opened.get(name, 0) + 1
            drops += dropped
            links += name == "a"
            if name in ARTICLE and not drops and not out.article:
                articles += 1
                out.article = articles
    if not drops:
        out.text(page[at:], links > 0)
        out.close()
    return out.lines


def window_sums(lengths: list[int]) -> list[int]:
    """The line-block distribution: for each line, the length of WINDOW lines from it on."""
    return [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]


def regions(lengths: list[int]) -> list[tuple[int, int]]:
    """(first line, line after the last) from each rise of the distribution to its dive,
    without the lines of no length that a window reaches before the rise."""
    out, start = [], None
    for i, total in enumerate([*window_sums(lengths), 0]):
        if total and start is None:
            start = i
        elif not total and start is not None:
            while not lengths[start]:
                start += 1
            out.append((start, i))
            start = None
    return out


def _of_article(lines: list[tuple[str, int, int]]) -> list[str]:
    """An article's lines but for those of its dives: runs of at least WINDOW lines
    without a length, such as lists of links."""
    out: list[str] = []
    flat: list[str] = []
    for i, (text, n, _) in enumerate([*lines, ("", 1, 0)]):
        if n == 0:
            flat.append(text)
            continue
        # Empty lines and a few of links between text are no dive; nor is an article of links alone.
        if len([t for t in flat if t]) < WINDOW or len(flat) == i == len(lines):
            out += flat
        flat = []
        out.append(text)
    return [t for t in out if t]


def kept_lines(lines: list[tuple[str, int, int]]) -> list[str]:
    """Text between surges and dives, of marked articles if there are any."""
    articles: dict[int, list[tuple[str, int, int]]] = {}
    for line in lines:
        if line[2]:
            articles.setdefault(line[2], []).append(line)
    # An article of links alone still has its text.
    sizes = {k: sum(n for _, n, _ in own) or int(any(t for t, *_ in own)) for k, own in articles.items()}
    longest = max(sizes.values(), default=0)
    if longest:
        # The longest surges, whatever its length; text is all that a short page has.
        return [t for k, own in articles.items() if sizes[k] == longest or sizes[k] >= max(SURGE, SHARE * longest) for t in _of_article(own)]
    lengths = [n for _, n, _ in lines]
    sums, found = window_sums(lengths), regions(lengths)
    surging = [r for r in found if max(sums[r[0] : r[1]]) >= SURGE]
    if not surging and found:
        surging = [max(found, key=lambda r: sum(lengths[r[0] : r[1]]))]
    return [t for a, b in surging for t, *_ in lines[a:b] if t]


def main_text(page: str | None) -> str:
    return "\n".join(kept_lines(lines_of(page or "")))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [main_text(p) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """Return (page_id, url, text, n_chars) for each row of ``pages`` (page_id, url,
    html; other columns are ignored).

    Null, empty and textless pages give ''.  White space inside a block becomes one
    space, blocks are joined by a newline, and br is white space.  Rows are
    independent; an empty table gives an empty result.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    found = own.mapInArrow(_extracted, "page_id long, url string, text string")
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_text": op3}
ORACLE: dict[str, str] = {}
