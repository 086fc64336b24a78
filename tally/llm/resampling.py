"""Importance resampling towards a target distribution.

Features are runs of one and two consecutive words, dealt to BUCKETS buckets by their CRC-32. Counts of all documents and of all
target texts give each bucket a gain, the logarithm of how much likelier the target is to hold it, in thousandths. A document's
weight is the mean gain of its features; with Gumbel noise from a hash of its doc_id added, the greatest scores are a sample
without replacement in proportion to the weights.

Weights come from arrays: a task numbers the words of a batch, takes the checksums of the different ones, and gets those of
all pairs from them, since the checksum of `a b` is that of `a`, moved on by the length of ` b`, exclusive-or that of ` b`.
The order comes from a distributed LSD radix sort (radix.py) over the digits of score and doc_id.

Nulls: a null text has no words; a null doc_id is hashed as an empty one and stands last among equal scores. Texts without words
weigh 0. Texts of fewer than `least_words` words are never drawn. Very long texts are taken whole. Repeated rows are separate documents;
those of equal doc_id and score stand in the order in which they were read. Empty tables give an empty result, and an empty target
gives gains against no feature at all. Other columns take no part.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import materialize
from tally.llm.radix import radix_sort

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Words whose features a task works on at once.
CHUNK = 1 << 20

#: What is no word: ASCII but for digits and small letters, after lower-casing.
_NOT_WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of the lower-cased text. UTF-8 has no ASCII bytes inside other characters, so bytes will do."""
    return (text or b"").lower().translate(_NOT_WORD).split()


#: What one zero byte makes of a checksum's register, for each value of its low byte; the rest moves down by eight bits.
_ZERO = np.array([zlib.crc32(b"\0", b ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


class Moves(dict):
    """By number of bytes: four tables that move a checksum on by so many zero bytes, one for each of its bytes."""

    def __missing__(self, n: int) -> np.ndarray:
        at = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        for _ in range(n):
            at = _ZERO[at & np.uint32(255)] ^ (at >> np.uint32(8))
        self[n] = at
        return at


#: Words longer than this, which have no table, take the checksum of their pair one by one.
TABLE_BYTES = 64
_moves = Moves()


def bucket_arrays(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the single words of all texts, of their pairs, and for each text how many words it has."""
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for w in chain.from_iterable(texts)), np.int64)
    known = list(ids)
    crc = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in known), np.uint32, len(known))
    length = np.fromiter(map(len, known), np.int64, len(known)) + 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    inside = np.ones(max(len(flat) - 1, 0), bool)
    ends = np.cumsum(sizes)
    inside[ends[(ends > 0) & (ends < len(flat))] - 1] = False
    first, second = flat[:-1][inside], flat[1:][inside]
    a, by = crc[first], length[second]
    short = np.minimum(by, TABLE_BYTES + 1)
    # rows of tables that are in use, found by their length
    used = np.unique(short)
    tables = np.stack([_moves[n] for n in used.tolist()]) if len(used) else np.zeros((1, 4, 256), np.uint32)
    row = np.searchsorted(used, short)
    moved = tables[row, 0, a & 255] ^ tables[row, 1, (a >> 8) & 255] ^ tables[row, 2, (a >> 16) & 255] ^ tables[row, 3, a >> 24]
    pairs = moved ^ spaced[second]
    for i in np.flatnonzero(by > TABLE_BYTES):
        pairs[i] = zlib.crc32(b" " + known[second[i]], int(a[i]))
    return (crc % BUCKETS)[flat].astype(np.int64), (pairs % np.uint32(BUCKETS)).astype(np.int64), sizes


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[list[bytes]]]]:
    """Slices of batches with the words of their texts, CHUNK words or a little more together."""
    for batch in batches:
        at, found, n = 0, [], 0
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            found.append(words(text.as_py()))
            n += len(found[-1])
            if n >= CHUNK:
                yield batch.slice(at, len(found)), found
                at, found, n = i + 1, [], 0
        if found:
            yield batch.slice(at, len(found)), found


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts each bucket has. BUCKETS rows at most come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, found in _chunks(batches):
            singles, pairs, _ = bucket_arrays(found)
            total += np.bincount(singles, minlength=BUCKETS) + np.bincount(pairs, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for row in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in thousandths; the counts that features of both have."""
    all_source, all_target = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    ratio = lambda s, t: (float(t + 1) * float(all_source)) / (float(s + 1) * float(all_target))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of the doc_id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gained: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gained)  # BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch, found in _chunks(batches):
            singles, pairs, sizes = bucket_arrays(found)
            n_pairs = np.maximum(sizes - 1, 0)
            # sums of whole numbers between ends, exact
            part = lambda buckets, n: np.diff(np.concatenate([[0], np.cumsum(gain[buckets])])[np.concatenate([[0], np.cumsum(n)])])
            n_features = sizes + n_pairs
            weight = (part(singles, sizes) + part(pairs, n_pairs)) // np.maximum(n_features, 1)
            ids = batch.column("doc_id")
            scores = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (sizes, n_features, weight, scores))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each document; rank is null if it is not drawn."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weighed = materialize(weigh(docs, gains(bucket_counts(docs), bucket_counts(target)), seed), "resampling-scores")
    columns = ["doc_id", "n_features", "weight", "score"]
    placed = radix_sort(weighed.filter(F.col("n_words") >= least_words).select(columns), [("score", True), ("doc_id", False)], "resampling")
    drawn = percent * placed.count() // 100
    ranked = placed.select(*columns, F.when(F.col("pos") < drawn, F.col("pos") + 1).alias("rank"))
    return ranked.unionByName(weighed.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
