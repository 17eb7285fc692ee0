"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element; parts that cannot be the article
(menus, notices, forms, scripts ...) leave blank lines. Text lengths are summed over
sliding windows of lines. Text between a surge of that sum and the next dive to nothing
is the main text; a page may have several such stretches. The surge is a share of the
page's fullest window. Article and main elements weigh more, and their ends and those of
every container inside them bound stretches, so that a container which is no text of its
own is left out whatever it is called.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window, the part of the page's fullest window that starts a stretch, and how
#: much more a character counts in an article or main element.
WINDOW, SURGE, WEIGHT = 3, 0.25, 4

BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead
tr ul""".split())
CONTAINERS = BLOCKS - frozenset("p hr h1 h2 h3 h4 h5 h6".split()) | {"span", "button", "select", "head", "title", "label", "noscript", "iframe"}
NEVER = frozenset("nav footer aside form button select option head title noscript iframe dialog menu textarea".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose direct text belongs together, where no article or main element is around it.
SECTIONS = frozenset("body div section td dd center".split())
#: Whole names of class, id or role that mark what is not the article.
MARKS = frozenset("""ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie
cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo
promotion recommended related replies respond reply search share sharing sidebar signup social sponsor sponsored subscribe
toolbar widget complementary contentinfo ad-banner ad-container comment-list comments-area cookie-banner cookie-bar cookie-consent
cookie-notice main-menu main-nav page-footer page-header related-articles related-posts search-form share-buttons site-footer
site-header site-nav social-links social-share""".split())
RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|svg|template|textarea)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
BLANK = ("", False, 0.0, ())


def _marked(attributes: str) -> set[str]:
    return {w for v in NAMED.findall(attributes) for w in v.strip("\"'").lower().split()} & MARKS


def page_lines(page: str) -> list[tuple[str, bool, float, tuple[int, ...]]]:
    """(text, inside an article or main element, share of the text in links, section) per line.

    A section is an article or main element or the nearest of SECTIONS; inside an article it
    is the path of those from the article down. A part that is left out, and both ends of
    an article and of every section in it, give WINDOW blank lines. Elements may lack their
    end tags: an end tag closes all that is open inside its element, and an article ends
    whatever menu or notice was left open before it.
    """
    lines: list[tuple[str, bool, float, tuple[int, ...]]] = []
    open_: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # container, left out, bounds stretches, section
    text: list[str] = []
    linked, in_link, depth_out, depth_main, sections = 0, False, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        line = " ".join(entities.unescape("".join(text)).split())
        if line:
            lines.append((line, depth_main > 0, min(1.0, linked / len(line)), open_[-1][3] if open_ else ()))
        text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not depth_out:
            text.append(raw)
            linked += len(raw) if in_link else 0

    def close(k: int) -> None:
        nonlocal depth_out, depth_main
        bounded = any(bounds for _, _, bounds, _ in open_[k:])
        for name, out, _, _ in open_[k:]:
            depth_out -= out
            depth_main -= name in ("article", "main")
        del open_[k:]
        if bounded:
            lines.extend([BLANK] * WINDOW)

    page = RAW.sub("", page)
    at = 0
    for tag in TAG.finditer(page):
        add(page[at : tag.start()])
        at = tag.end()
        end, name, attributes = tag.group(1, 2, 3) if tag.group(2) else tag.group(4, 5, 6)
        name = name.lower()
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            flush()
        if name == "a":
            in_link = not end
        if name not in CONTAINERS or name in VOID:
            continue
        if end:
            places = [i for i, (x, _, _, _) in enumerate(open_) if x == name]
            if places:
                close(places[-1])
            continue
        if attributes.endswith("/"):
            continue
        if name in ("article", "main", "body"):
            if depth_out and not depth_main:
                close(next(i for i, (_, out, _, _) in enumerate(open_) if out))
            out = False
        else:
            marked = _marked(attributes)
            out = name in NEVER or bool(marked) or (name == "header" and not depth_main)
        starts = name in ("article", "main") and not depth_main
        inner = name in SECTIONS and depth_main > 0
        if (out and not depth_out) or starts or inner:
            flush()
            lines.extend([BLANK] * WINDOW)
        section = open_[-1][3] if open_ else ()
        if starts or name in SECTIONS:
            sections += 1
            section = (*(section if inner else ()), sections)
        open_.append((name, out, starts or inner, section))
        depth_out += out
        depth_main += name in ("article", "main")
    add(page[at:])
    flush()
    return lines


def stretches(lengths: list[int], surge: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """(first, last + 1) of the lines between each surge and the next dive."""
    sums, total = [], 0
    for i, n in enumerate(lengths):
        total += n - (lengths[i - window] if i >= window else 0)
        sums.append(total)  # of the window that ends here
    found, start = [], None
    for i, n in enumerate(lengths):
        if start is None and n and max(sums[i : i + window]) >= surge:
            start = i
            while start and lengths[start - 1]:
                start -= 1
            if found:
                start = max(start, found[-1][1])
        elif start is not None and not sums[i]:
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(lengths)))
    return found


def main_text(page: str | None) -> str:
    """The article's blocks joined by line feeds; empty where there is none.

    A line counts with its characters outside links, or in an article or main element
    WEIGHT times with all. A stretch needs a window of SURGE times the fullest one. What
    stands apart from a stretch but in its section or around it in the article, as a
    closing line between two removed parts, belongs to it; lines made of links alone belong
    to it only between its lines.
    """
    lines = page_lines(page or "")
    lengths = [WEIGHT * len(text) if main else round(len(text) * (1 - share)) for text, main, share, _ in lines]
    most = max((sum(lengths[i : i + WINDOW]) for i in range(len(lengths))), default=0)
    taken: set[int] = set()
    for start, end in stretches(lengths, max(1, SURGE * most), WINDOW):
        while not lengths[end - 1]:
            end -= 1
        taken.update(range(start, end))
    sections = {lines[i][3][:k] for i in taken if lengths[i] for k in range(len(lines[i][3]) + 1)} - {()}
    return "\n".join(line[0] for i, line in enumerate(lines) if line[0] and (i in taken or (lengths[i] and line[3] in sections)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Null and empty pages have empty texts; whole pages of any length are read; repeated
    rows each get their row; other columns are left behind.
    """
    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")) + ", text string, n_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def op2_query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
