"""Token ids as binary files: flat unsigned integers, with 64-bit document offsets, to be memory-mapped.

The documents are range-partitioned and sorted by doc_id. Each partition is one shard of three files:

    shard-00007.ids      the ids of its documents, one after another: uint16, or uint32 for large vocabularies
    shard-00007.offsets  uint64, one more than documents: where each document's ids start, counted in ids
    shard-00007.docs     for each document its doc_id (int64) and whether it has one (uint8)

The manifest has for each shard its documents, ids and base: the ids of all earlier shards, a prefix sum over
shards. A document's start is base + offset. A shard is written under a name of its attempt and then renamed,
so a task that is run again writes the same files again.

The tokenizers library encodes each different match of the tokenizer's own pre-tokenizer; a worker keeps recent
ones, see pieces. A text that holds the string of an added token is encoded whole by the library, and so is every text
if the tokenizer is not plain byte-level BPE.

Nulls and empty texts have the end id alone; a null doc_id sorts first. Repeated rows are separate documents.
An empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tally.llm import pieces
from tally.llm.common import blocks_for, materialize, scratch_path, shuffle_partitions

DOC = np.dtype([("doc_id", "<i8"), ("known", "u1")])
#: Byte-level vocabularies write bytes as characters: printable ones of Latin-1 as themselves, the others, in order, from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
#: Bytes of text of a shard.
SHARD_BYTES = 256 << 20
MANIFEST = "part int, n_docs long, n_ids long"
FOUND = "doc_id long, start long, n_tokens long, ids_crc32 long"


class LibraryEncoder:
    """Texts to ids by a tokenizers file, as the library does without special tokens of its own."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        cutter = spec.get("pre_tokenizer") or {}
        plain = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) and not spec.get("normalizer")
        self.by_parts = pieces.Encoder(pieces.BYTE_LEVEL, self.match).encode if plain else None
        self.model = self.tokenizer.model
        self.added = [t["content"] for t in spec.get("added_tokens", []) if t.get("content")]

    def whole(self, text: str) -> bytes:
        return array(self.dtype.char, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def match(self, match: str) -> bytes:
        """One match of the byte-level pattern, by the library's model alone."""
        if match.isascii() and match.isprintable():
            as_chars = match.replace(" ", "\u0120")  # of ASCII's printable bytes only the space is written as another character
        else:
            as_chars = match.encode().decode("latin-1").translate(BYTE_CHARS)
        return array(self.dtype.char, [t.id for t in self.model.tokenize(as_chars)]).tobytes()

    def encode(self, text: str) -> bytes:
        if self.by_parts is None or any(a in text for a in self.added):
            return self.whole(text)
        return self.by_parts(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards of docs (doc_id, text) below folder, each of about shard_bytes of text or less; the manifest:
    part, n_docs, n_ids, base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(folder)
        task = TaskContext.get()
        part, enc = task.partitionId(), encoder(tokenizer_path)
        name, mine = f"{root}/shard-{part:05d}", f"{root}/_attempt-{task.taskAttemptId()}"
        end = np.array([end_id], enc.dtype).tobytes()
        store.create_dir(root, recursive=True)
        offset, n_docs = 0, 0
        with store.open_output_stream(f"{mine}.ids") as ids, store.open_output_stream(f"{mine}.offsets") as offsets, store.open_output_stream(f"{mine}.docs") as names:
            offsets.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                doc_ids = batch.column("doc_id").to_pylist()
                for a in range(0, len(texts), 256):
                    encoded = [enc.encode(t) + end for t in texts[a : a + 256]]
                    ids.write(b"".join(encoded))
                    ends = offset + np.cumsum([len(x) // enc.dtype.itemsize for x in encoded])
                    offsets.write(ends.astype("<u8").tobytes())
                    offset = int(ends[-1])
                names.write(np.array([(d if d is not None else 0, d is not None) for d in doc_ids], DOC).tobytes())
                n_docs += len(texts)
        for kind in ("ids", "offsets", "docs"):
            store.move(f"{mine}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_ids": [offset]})

    spark = docs.sparkSession
    tied = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(shuffle_partitions(spark), blocks_for(size, shard_bytes))
    dealt = tied.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = materialize(dealt.select("doc_id", "text").mapInArrow(run, MANIFEST), "token-manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return manifest.select("*", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))


class _File:
    """A file as an array that is read by ranges: memory-mapped where the store is a file system."""

    def __init__(self, store: fs.FileSystem, path: str, dtype):
        self.dtype = np.dtype(dtype)
        self.n = store.get_file_info(path).size // self.dtype.itemsize
        self.mapped = np.memmap(path, self.dtype, "r") if self.n and isinstance(store, fs.LocalFileSystem) else None
        self.file = None if self.mapped is not None else store.open_input_file(path)

    def range(self, a: int, b: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[a:b]
        self.file.seek(a * self.dtype.itemsize)
        return np.frombuffer(self.file.read((b - a) * self.dtype.itemsize), self.dtype)


def read_shards(manifest: DataFrame, folder: str, wide: bool = False) -> DataFrame:
    """One row for each document in the shards: doc_id, start, n_tokens, ids_crc32 (of the ids as uint32)."""
    dtype = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                name = f"{root}/shard-{shard['part']:05d}"
                ids, offsets, docs = _File(store, f"{name}.ids", dtype), _File(store, f"{name}.offsets", "<u8"), _File(store, f"{name}.docs", DOC)
                for a in range(0, docs.n, 1024):
                    b = min(a + 1024, docs.n)
                    at = offsets.range(a, b + 1).astype(np.int64)
                    own = docs.range(a, b)
                    sums = [zlib.crc32(ids.range(x, y).astype("<u4").tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                    known = own["known"].astype(bool)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own["doc_id"].astype(np.int64), pa.int64(), mask=~known), "start": pa.array(at[:-1] + shard["base"]), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(sums, pa.int64())})

    return manifest.repartition(shuffle_partitions(manifest.sparkSession), "part").mapInArrow(run, FOUND)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes docs as token files and reads them back: the folder, and read_shards() of it."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    wide = Tokenizer.from_file(tokenizer_path).get_vocab_size() > 1 << 16
    return folder, read_shards(write_shards(docs, tokenizer_path, end_id, folder), folder, wide)
