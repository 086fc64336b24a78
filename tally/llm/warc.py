"""WARC derivatives: metadata and plain-text conversion records of response records, in DataFrame operations.

A response is a row (record_id, target_uri, date, http_headers, payload). Each gives two records:

    metadata     application/warc-fields: title, language, the source's HTTP headers, payload digest and length,
                 and its outgoing links in order
    conversion   text/plain: the payload without head, scripts, styles, comments and tags

Both carry WARC-Refers-To with the response's identifier, its target URI and date, and a digest of their own
block; each names the other in WARC-Concurrent-To. Identifiers are made from the response's identifier, so a
rerun makes the same records.

A null payload counts as empty, and gives both records; a null target URI gives no WARC-Target-URI. A null
record_id gives identifiers made from the empty string. Malformed tags are text from their "<" on unless a ">" follows;
characters by number (&#233;) stay as they are written. Very long pages are converted whole. Repeated rows give repeated records. Other columns,
whatever their names, take no part. Empty tables give no records.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm.common import materialize

VERSION = "WARC/1.1"
CRLF = "\r\n"
#: What goes whole, in this order; what breaks a line; named characters. Fixed values of the conversion.
DROPPED = r"(?is)<!--.*?-->|<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>"
BLOCKS = r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
TAGS = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(html, DROPPED, " ")
    text = F.regexp_replace(text, BLOCKS, "\n")
    text = unescaped(F.regexp_replace(text, TAGS, ""))
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def record_id(kind: str, source: Column) -> Column:
    """A URN made from the kind and the source's identifier, in the form of a name-based UUID."""
    digest = F.md5(F.concat(F.lit(f"{kind}|"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5"), F.lit(">"))


def digest_of(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response records of a table of pages that were fetched, with the headers of a plain HTML answer."""
    payload = F.coalesce(F.col(html), F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    source = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(url), F.lit("")))
    return pages.select(record_id("response", source).alias("record_id"), F.col(url).alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), payload.alias("payload"))


def derivatives(source: DataFrame) -> DataFrame:
    """Two rows for each response: the record's identifiers, digests, header (lines that end in CRLF) and block."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    title = unescaped(F.regexp_replace(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1), r"[ \t\r\n]+", " "))
    lang = F.regexp_extract("payload", r"(?i)<html\b[^>]*\blang=\"([^\"]*)\"", 1)
    links = F.regexp_extract_all("payload", F.lit(r"(?i)<a\b[^>]*\bhref=\"([^\"]*)\""), F.lit(1))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    has = lambda name, value: F.when(value != "", line(name, value)).otherwise("")
    http = F.array_join(F.transform(F.filter(F.split(F.coalesce("http_headers", F.lit("")), CRLF), lambda x: x != ""), lambda x: F.concat(F.lit("source-http-header: "), x, F.lit(CRLF))), "")
    outlinks = F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), unescaped(x), F.lit(CRLF))), "")
    base = source.withColumn("payload", payload).select(
        F.col("record_id").alias("refers_to"), "target_uri", "date",
        digest_of(F.col("payload")).alias("payload_digest"),
        F.octet_length("payload").alias("payload_length"),
        record_id("metadata", F.col("record_id")).alias("metadata_id"), record_id("conversion", F.col("record_id")).alias("conversion_id"),
        title.alias("title"), lang.alias("lang"), http.alias("http"), outlinks.alias("outlinks"), plain_text(F.col("payload")).alias("text"),
    )
    fields = F.concat(has("title", F.col("title")), has("language", F.col("lang")), F.col("http"), line("source-payload-digest", F.col("payload_digest")), line("source-payload-length", F.col("payload_length").cast("string")), F.col("outlinks"))
    record = lambda kind, own, other, mime, block: F.struct(F.lit(kind).alias("warc_type"), F.col(own).alias("record_id"), F.col(other).alias("concurrent_to"), F.lit(mime).alias("content_type"), block.alias("block"))
    both = F.inline(F.array(record("metadata", "metadata_id", "conversion_id", "application/warc-fields", fields), record("conversion", "conversion_id", "metadata_id", "text/plain; charset=utf-8", F.col("text"))))
    each = base.select("refers_to", "target_uri", "date", "payload_digest", both)
    each = each.withColumns({"content_length": F.octet_length("block").cast("long"), "block_digest": digest_of(F.col("block"))})
    header = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")),
        F.coalesce(line("WARC-Refers-To", F.col("refers_to")), F.lit("")), line("WARC-Concurrent-To", F.col("concurrent_to")),
        F.coalesce(line("WARC-Target-URI", F.col("target_uri")), F.lit("")), F.coalesce(line("WARC-Date", F.col("date")), F.lit("")),
        line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
    )
    return each.select("record_id", "warc_type", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "content_length", "block_digest", "payload_digest", header.alias("header"), "block")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


INDEX = "record_id string, file string, offset long, length long"


def write(records: DataFrame, folder: str) -> DataFrame:
    """WARC files of records, one for each partition: each record (header, an empty line, the block, and two line ends)
    is a gzip member of its own, so that it can be read alone. Gives where each stands: (record_id, file, offset, length).
    A file is written under a name of its attempt and then renamed, so a task that is run again writes the same file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(folder)
        task = TaskContext.get()
        name, mine = f"{root}/part-{task.partitionId():05d}.warc.gz", f"{root}/_attempt-{task.taskAttemptId()}"
        store.create_dir(root, recursive=True)
        offset, index = 0, []
        with store.open_output_stream(mine, compression=None) as out:
            for batch in batches:
                start = offset
                for header, block in zip(batch.column("header").to_pylist(), batch.column("block").to_pylist()):
                    member = gzip.compress(((header or "") + CRLF + (block or "") + CRLF + CRLF).encode(), mtime=0)
                    out.write(member)
                    index.append((offset, len(member)))
                    offset += len(member)
                if offset > start:
                    places = pa.array(index, pa.list_(pa.int64(), 2)).flatten().to_numpy().reshape(-1, 2)
                    yield pa.RecordBatch.from_pydict({"record_id": batch.column("record_id"), "file": pa.array([name] * len(index)), "offset": pa.array(places[:, 0]), "length": pa.array(places[:, 1])})
                    index = []
        store.move(mine, name)

    return materialize(records.select("record_id", "header", "block").mapInArrow(run, INDEX), "warc-index")


def _records(stream) -> Iterator[tuple[dict, bytes, bool]]:
    """(headers, block, whole) of a stream of records that follow one another, each as long as its Content-Length says;
    whole: the two line ends come where they should. What is no record ends the file."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            yield {}, line, False
            return
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode(errors="replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = headers.get("content-length", "")
        block = stream.read(int(size)) if size.isdigit() else b""
        yield headers, block, size.isdigit() and len(block) == int(size) and stream.read(4) == b"\r\n\r\n"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(headers, block, whole) of the records of WARC files, plain or gzip: the headers as a map with names in lower case,
    the block, and whether it is as long as Content-Length says. Files are tasks, and are read as streams."""
    files = spark.read.format("binaryFile").load(folder).select("path")  # the content is not read here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = _place(path)
                with store.open_input_stream(name, compression=None) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw, 1 << 20)
                    held, size = [], 0
                    for headers, block, whole in _records(stream):
                        held.append((list(headers.items()), block, whole))
                        size += len(block)
                        if size > 1 << 24 or len(held) == 1024:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["headers", "block", "whole"])
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["headers", "block", "whole"])

    found = files.repartition(max(1, files.count()), "path").mapInArrow(run, "headers map<string, string>, block binary, whole boolean")
    return found.withColumn("block", F.col("block").cast("string"))
