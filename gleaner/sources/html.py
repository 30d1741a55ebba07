"""HTML documents as rows: dated episodes of list items, and page-level parts."""

from __future__ import annotations

import datetime
import html as _html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CHUNKS = "page_id long, episode_date date, format string, position int, title string, text string, markdown string, links array<struct<href:string,text:string>>, images array<struct<src:string,alt:string>>"
_DATE = re.compile(r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})")
_WRAP = {"sup": ("<sup>", "</sup>"), "s": ("~~", "~~"), "u": ("<u>", "</u>"), "i": ("*", "*"), "em": ("*", "*"), "b": ("**", "**"), "strong": ("**", "**")}
_STYLES = {"font-style:italic": "i", "font-weight:700": "b", "font-weight:bold": "b", "text-decoration:underline": "u", "text-decoration:line-through": "s", "vertical-align:super": "sup"}


class _Inline(HTMLParser):
    """Flattens one item: plain text, markdown, links, images. Tags that carry no format only separate text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.plain: list[str] = []
        self.markdown: list[str] = []
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.stack: list[tuple[str, list[str], str | None]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "br":
            self.plain.append("\n")
            self.markdown.append("  \n")
        elif tag == "img":
            alt, src = a.get("alt") or "", a.get("src") or ""
            self.images.append({"src": src, "alt": alt})
            self.plain.append(f"[Image: {alt}]" if alt else "[Image]")
            self.markdown.append(f"![{alt}]({src})" if src else "")
        else:
            style = re.sub(r"\s", "", a.get("style") or "").lower()
            marks = [m for s, m in _STYLES.items() if s in style] + ([tag] if tag in _WRAP else [])
            self.stack.append((tag, marks, a.get("href") if tag == "a" else None))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        text = re.sub(r"\s+", " ", data)
        if not text.strip():
            if text and not (self.plain and self.plain[-1].endswith(" ")):
                self.plain.append(" ")
                self.markdown.append(" ")
            return
        if re.match(r"\s*[.,;:!?)\]]", text):
            text = text.lstrip()
            self.plain[-1:] = [self.plain[-1].rstrip(" ")] if self.plain else []
            self.markdown[-1:] = [self.markdown[-1].rstrip(" ")] if self.markdown else []
        self.plain.append(text)
        marks = {m for _, own, _ in self.stack for m in own}
        href = next((h for _, _, h in reversed(self.stack) if h), None)
        out = text
        for m in ("sup", "s", "u", "i", "em", "b", "strong"):
            if m in marks:
                out = _WRAP[m][0] + out + _WRAP[m][1]
        if href:
            self.links.append({"href": href, "text": text.strip()})
            out = f"[{out}]({href})"
        self.markdown.append(out)


def inline(fragment: str) -> _Inline:
    p = _Inline()
    p.feed(fragment)
    p.close()
    return p


def title_of(text: str) -> str:
    """The first sentence of the first line, without footnote markers."""
    line = re.sub(r"\s+", " ", re.sub(r"(?i)\[(?:[a-z]{1,4}|\d+)\]", "", text.split("\n")[0])).strip()
    m = re.search(r"[.!?](?=\s|$)", line)
    return line[: m.end()].strip() if m and line[: m.end()].strip() else line


def _date(text: str) -> datetime.date | None:
    m = _DATE.search(text)
    if not m:
        return None
    try:
        return datetime.date(int(m[3]) + (2000 if len(m[3]) == 2 else 0), int(m[1]), int(m[2]))
    except ValueError:
        return None


def episodes(page: str) -> Iterator[dict]:
    """Episodes of a page: sections headed by a date; list items with a margin are text, those at depth 0 start a chunk."""
    for section in re.split(r"<h1\b[^>]*>", page or "")[1:]:
        head, found, body = section.partition("</h1>")
        date = _date(_html.unescape(re.sub("<[^>]+>", " ", head))) if found else None
        if date is None:
            continue
        chunks: list[dict] = []
        for m in re.finditer(r"<li\b([^>]*)>(.*?)</li>", body, re.S | re.I):
            margin = re.search(r"margin-left:\s*(\d+)pt", m[1], re.I)
            if not margin:
                continue
            item = inline(m[2])
            plain = "".join(item.plain).strip()
            if not plain:
                continue
            depth = max(int(int(margin[1]) / 36 + 0.5) - 1, 0)
            if depth == 0 or not chunks:
                chunks.append({"lines": [], "markdown": [], "links": [], "images": []})
            chunks[-1]["lines"].append(plain)
            chunks[-1]["markdown"].append("  " * depth + "- " + "".join(item.markdown).strip())
            chunks[-1]["links"] += item.links
            chunks[-1]["images"] += item.images
        if not chunks:
            whole = inline(body)
            plain = "".join(whole.plain).strip()
            if len(plain) > 10:
                chunks.append({"lines": [plain], "markdown": ["".join(whole.markdown).strip()], "links": whole.links, "images": whole.images})
        lines = sum(len("\n".join(c["lines"]).split("\n")) for c in chunks) / len(chunks) if chunks else 0
        yield {"date": date, "format": "essays" if 0 < len(chunks) <= 12 and lines >= 3 else "notes", "chunks": chunks}


def parse_pages(pages: DataFrame) -> DataFrame:
    """A row per chunk of each page's episodes; pages: page_id, html. Pages without dated headings give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "episode_date", "format", "position", "title", "text", "markdown", "links", "images"]
        for b in batches:
            rows = []
            for page_id, page in zip(b["page_id"], b["html"], strict=True):
                for e in episodes(page):
                    for k, c in enumerate(e["chunks"]):
                        text = "\n".join(c["lines"])
                        rows.append((page_id, e["date"], e["format"], k, title_of(c["lines"][0]), text, "\n".join(c["markdown"]), c["links"], c["images"]))
            yield pd.DataFrame(rows, columns=columns)

    return pages.select("page_id", "html").mapInPandas(run, CHUNKS)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """Whole HTML files as page_id, url, html."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.col("_metadata.file_path")).alias("page_id"), F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
