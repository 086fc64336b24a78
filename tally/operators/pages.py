"""What pages hold: paragraphs, sections, bullets, facts and tables, by the standard library's HTML parser, and links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "page_id long, kind string, pos int, key string, value string"
LEAST_CHARS = 30
#: Paragraphs that begin like this are none; a section with such a name ends the text. Fixed values.
REJECTED = ("Aquest article", "Vegeu també", "Cookie")
ENDS = ("referències", "enllaços externs", "references")
#: Hosts by what they are. Fixed values.
HOSTS = (("instagram", ("instagram",)), ("facebook", ("facebook",)), ("twitter", ("twitter", "x.com")), ("youtube", ("youtube",)), ("wikipedia", ("wikipedia",)))


class _Reader(HTMLParser):
    """Collects (kind, key, value) in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str | None, str]] = []
        self.text: list[str] = []
        self.skip = 0
        self.cells: list[str] = []
        self.ended = False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif tag in ("p", "li", "td", "th", "h1", "h2", "h3", "title"):
            self.text = []
        elif tag == "tr":
            self.cells = []

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
            return
        value = " ".join("".join(self.text).split())
        if tag in ("h1", "h2", "h3", "title"):
            self.ended = self.ended or value.lower() in ENDS
            self.add("section" if tag != "title" else "title", None, f"## {value}" if tag == "h2" else value)
        elif tag == "p" and len(value) > LEAST_CHARS and not value.startswith(REJECTED):
            self.add("paragraph", None, value)
        elif tag == "li":
            self.add("bullet", None, value)
        elif tag in ("td", "th"):
            self.cells.append(value)
        elif tag == "tr" and len(self.cells) == 2:
            self.add("fact", *self.cells)
        elif tag == "tr" and len(self.cells) > 2:
            points = self.cells[-1] if self.cells[-1].isdigit() else "0"
            self.add("result", self.cells[0], " | ".join([*self.cells[1:-1], points]))
        if tag in ("p", "li", "td", "th", "h1", "h2", "h3", "title"):
            self.text = []

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)

    def add(self, kind, key, value):
        if value and not self.ended and (kind, key, value) not in self.seen:
            self.seen.add((kind, key, value))
            self.found.append((kind, key, value))

    @property
    def seen(self):
        return self.__dict__.setdefault("_seen", set())


def parts(html: str | None) -> list[tuple[str, str | None, str]]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.found


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, kind, pos, key, value): what the pages hold, in order, each thing once a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [(i, k, n, key, v) for i, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()) for n, (k, key, v) in enumerate(parts(html))]
                columns = list(zip(*rows)) or [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()))], ["page_id", "kind", "pos", "key", "value"])

    return pages.select("page_id", "html").mapInArrow(run, PART)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, kind, links): a page's different links by what their host is."""
    href = F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*\bhref=\"([^\"]*)\""), F.lit(1))).alias("href")
    host = F.lower(F.regexp_extract("href", r"^https?://([^/]+)", 1))
    kind = F.when(host == "", "internal")
    for name, words in HOSTS:
        hit = host.contains(words[0])
        for w in words[1:]:
            hit = hit | host.contains(w)
        kind = kind.when(hit, name)
    return pages.select("page_id", href).groupBy("page_id", kind.otherwise("other").alias("kind")).agg(F.count_distinct("href").alias("links"))
