"""HTML functions: titles and anchors as expressions, paragraph and table text by a streaming parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seamark.functions.urls import canonical_url

#: Content types that are taken for pages.
PAGE_TYPES = ["text/html", "text/html; charset=UTF-8", "text/html; charset=utf-8", "text/html;charset=utf-8"]


def is_page(headers: Column) -> Column:
    """Whether the content type is one of the four accepted spellings."""
    return F.coalesce(headers.isin(*PAGE_TYPES), F.lit(False))


def title(html: Column) -> Column:
    """Text of the title element, empty if there is none."""
    return F.coalesce(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def hrefs(html: Column) -> Column:
    """Targets of all anchors in order, in any case and quotes, entities decoded, without fragments of the page itself."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(1))

    def target(x: Column) -> Column:
        bare = F.trim(F.regexp_replace(x, r"""^["']|["']$""", ""))
        for entity, sign in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&")):
            bare = F.replace(bare, F.lit(entity), F.lit(sign))
        return bare

    every = F.transform(F.coalesce(found, F.array().cast("array<string>")), target)
    return F.filter(every, lambda x: ~x.startswith("#") & (x != ""))


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct (id, target) of the anchors of each page's HTML in canonical form."""
    raw = pages.select("id", F.explode(hrefs(F.col("raw_html"))).alias("href"))
    return raw.select("id", canonical_url(F.col("href"), F.col("id")).alias("target")).where("target <> ''").distinct()


_QUIET = frozenset(("script", "style", "template"))


class _Body(HTMLParser):
    """Texts of paragraphs and tables in the order in which they begin; a paragraph within a table follows it."""

    def __init__(self):
        super().__init__()
        self.out: list = []  # parts of a paragraph, or rows of a table with its heads
        self.open: list[tuple[str, object]] = []  # elements of interest that are open
        self.quiet = 0

    def handle_starttag(self, tag, attrs):
        if tag in _QUIET:
            self.quiet += 1
        elif tag == "p":
            self._end("p", "td", "th", "table")  # a paragraph ends where the next begins
            self._begin(tag, [])
            self.out.append(self.open[-1][1])
        elif tag == "table":
            self._begin(tag, ([], []))
            self.out.append(self.open[-1][1])
        elif tag == "tr":
            self._end("tr", "table")
            row: list = []
            for name, table in self.open:
                if name == "table":
                    table[1].append(row)
            self._begin(tag, row)
        elif tag in ("td", "th"):
            self._end("td", "tr", "table")
            self._end("th", "tr", "table")
            cell: list[str] = []
            for name, it in self.open:
                if tag == "td" and name == "tr":
                    it.append(cell)
                elif tag == "th" and name == "table":
                    it[0].append(cell)
            self._begin(tag, cell)

    def handle_endtag(self, tag):
        if tag in _QUIET:
            self.quiet = max(0, self.quiet - 1)
        elif tag in ("p", "table", "tr", "td", "th"):
            self._end(tag)

    def handle_data(self, data):
        if not self.quiet:
            for name, it in self.open:
                if name in ("p", "td", "th"):
                    it.append(data)

    def _begin(self, tag, it):
        self.open.append((tag, it))

    def _end(self, tag, *walls):
        """Close the last open ``tag`` and what is open in it, but not through one of ``walls``."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in walls:
                return

    def text(self) -> str:
        parts = []
        for it in self.out:
            if isinstance(it, list):
                parts.append("".join(it))
                continue
            heads, rows = (["".join(x) for x in it[0]], [["".join(x) for x in row] for row in it[1]])
            cells = "".join(f"{heads[k]}:{c}" if len(heads) == len(row) else c for row in rows for k, c in enumerate(row))
            parts.append(cells.replace("\n", " ") + "\n ")
        return "".join(parts)


def body_text(html: str | None) -> str:
    """Paragraph texts without a separator; per table its cells, each behind its head where the table has as many heads as the row cells, and one line end.

    Paragraphs in cells stand in the table and once more behind it.  A paragraph that is not closed ends where the next one begins.
    """
    page = _Body()
    page.feed(html or "")
    page.close()
    return page.text()


def extract_text(pages: DataFrame) -> DataFrame:
    """(id, title, text) of every page; missing HTML gives empty texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "title": f["title"], "text": f["raw_html"].map(lambda h: body_text(h) if isinstance(h, str) else "")})

    return pages.select("id", title(F.col("raw_html")).alias("title"), "raw_html").mapInPandas(run, "id string, title string, text string")
