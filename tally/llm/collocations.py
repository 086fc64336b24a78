"""Phrase collocations by SON partitioning.

Texts are lower-cased (A-Z), split into pieces at `.,;:!?` and line ends, and pieces into words at spaces and tabs. Phrases
are two to three consecutive words of a piece. A phrase counts if its language holds it `support` times or more.

The corpus is dealt to SHARDS shards by a hash of the text. A shard is no task: it is as large as the corpus over SHARDS, and many
tasks mine it. Its local support is the global one times the shard's share of all bytes; a phrase below that in every shard
is below the global support, so the union of what is frequent in some shard misses nothing.

First pass: each task turns the phrases of its texts into numbers, that is a bucket and 32 bits of a hash, counts equal ones and
passes on packed arrays; a group of one shard and one bucket adds them up and keeps what reaches the local support. Two phrases
with equal numbers add up, which can only let in more. The union becomes a bit filter, of a size that grows with it up to
MOST_BITS; beyond that the filter lets in more phrases than it must, and the result is the same. Second pass: every phrase that
the filter lets in is counted exactly, as text, over the whole corpus, with all words beside it.

A candidate's parts are frequent themselves, so the rest is joins of the counted phrases. Nulls: a null text is empty, a null
language is `und`. Repeated rows are separate documents. Very long texts are taken whole. Ties of score and count stand in byte
order. Empty tables, and languages without frequent phrases, give no rows. Other columns take no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import materialize

SUPPORT = 10
SHARDS = 3
TOP = 2000
#: Words whose phrases a task counts at once.
CHUNK = 1_500_000
#: Phrases of one shard and bucket, about.
GROUP = 1 << 21
#: The bit filter: bits for each candidate, and bounds of all bits. Bits come in blocks.
BITS_EACH = 16
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 29
BLOCK_BITS = 1 << 20
#: A language's rows are ranked in so many parts first.
RANK_PARTS = 64

#: Ends of pieces become line ends; bytes.lower() is that of ASCII.
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


class Ids(dict):
    """Words to numbers, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """Texts of some languages and shards as arrays of word numbers."""

    def __init__(self) -> None:
        self.ids, self.n = Ids(), 0
        self.words: dict[tuple, list[int]] = {}
        self.sizes: dict[tuple, list[int]] = {}

    def add(self, text: bytes, lang: str, shard: int) -> None:
        words, sizes = self.words.setdefault((lang, shard), []), self.sizes.setdefault((lang, shard), [])
        before, number = len(words), self.ids.__getitem__
        for piece in text.lower().translate(ENDS).split(b"\n"):
            if found := piece.split():
                words.extend(map(number, found))
                sizes.append(len(found))
        self.n += len(words) - before

    def phrases(self) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(language, shard, word numbers, whether two words begin there, whether three do)."""
        for key, words in self.words.items():
            ids = np.array(words, np.int64)
            sizes = np.array(self.sizes[key], np.int64)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))  # words of the piece from here on
            yield key[0], key[1], ids, left >= 2, left >= 3


def _chunks(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in batches:
        for text, lang in zip(batch.column("text").cast(pa.binary()), batch.column("lang"), strict=True):
            text = text.as_py() or b""
            chunk.add(text, lang.as_py(), zlib.crc32(text) % shards)
            if chunk.n >= CHUNK:
                yield chunk
                chunk = Chunk()
    yield chunk


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order, that of a sequence if a is one."""
    x = (a ^ (a >> np.uint64(29))) * _STEP + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashes(chunk: Chunk) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chunk.ids), np.uint64, len(chunk.ids))


def _phrase_hashes(words: np.ndarray, lang: str, two: np.ndarray, three: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the phrases of two words and of three, in order of place. words: hashes."""
    pairs = _mixed(_mixed(np.full(1, xxhash.xxh3_64_intdigest(lang), np.uint64), words[:-1]), words[1:]) if len(words) > 1 else words[:0]
    return pairs[two[:-1]], _mixed(pairs[:-1], words[2:])[three[:-2]] if len(words) > 2 else words[:0]


def _number(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket above 32 bits of the hash; buckets is a power of two."""
    return hashes & np.uint64((buckets << 32) - 1)


def _filter_places(numbers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits for each number."""
    one = _mixed(numbers, np.full(1, 1, np.uint64))
    return (one & np.uint64(bits - 1)).astype(np.int64), ((one >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _local_counts(docs: DataFrame, shards: int, buckets: int) -> DataFrame:
    """(shard, bucket, once, more, n): packed low halves of the numbers that a task met once, or more often and then n times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, shards):
            hashes, met = _hashes(chunk), {}
            for lang, shard, ids, two, three in chunk.phrases():
                met.setdefault(shard, []).extend(_number(h, buckets) for h in _phrase_hashes(hashes[ids], lang, two, three))
            for shard, found in met.items():
                numbers, n = np.unique(np.concatenate(found), return_counts=True)
                low, high = (numbers & np.uint64(0xFFFFFFFF)).astype("<u4"), (numbers >> np.uint64(32)).astype(np.int64)
                at = np.flatnonzero(np.diff(high, prepend=-1))
                rows = [(low[a:b], n[a:b]) for a, b in pairwise([*at, len(high)])]
                columns = [pa.array([shard] * len(at), pa.int32()), pa.array(high[at].astype(np.int32)), *(pa.array([f(x, k) for x, k in rows], pa.binary()) for f in (lambda x, k: x[k == 1].tobytes(), lambda x, k: x[k > 1].tobytes(), lambda x, k: k[k > 1].astype("<u4").tobytes()))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "bucket", "once", "more", "n"])

    return docs.mapInArrow(count, "shard int, bucket int, once binary, more binary, n binary")


def _frequent(counts: DataFrame, least: list[int]) -> DataFrame:
    """(bucket, found, n): packed low halves that are frequent in some shard; least: the shards' local supports."""

    def add(group: pa.Table) -> pa.Table:
        column = lambda name: np.frombuffer(b"".join(group.column(name).to_pylist()), "<u4")
        once, more, n = column("once"), column("more"), column("n")
        low = np.concatenate([once, more])
        order = np.argsort(low, kind="stable")
        low, n = low[order], np.concatenate([np.ones(len(once), np.int64), n])[order]
        at = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
        kept = low[at][np.add.reduceat(n, at) >= least[group.column("shard")[0].as_py()]] if len(at) else low
        return pa.table({"bucket": group.column("bucket")[:1], "found": pa.array([kept.tobytes()], pa.binary()), "n": pa.array([len(kept)], pa.int64())})

    return counts.groupBy("shard", "bucket").applyInArrow(add, "bucket int, found binary, n long")


def _bit_filter(frequent: DataFrame, bits: int) -> np.ndarray:
    """The filter as bytes. Blocks are made in tasks; they come to the driver, MOST_BITS at most in all."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, found in zip(batch.column("bucket").to_pylist(), batch.column("found").to_pylist(), strict=True):
                at = np.concatenate(_filter_places(np.frombuffer(found, "<u4").astype(np.uint64) | np.uint64(bucket << 32), bits))
                at.sort()
                block = at // BLOCK_BITS
                first = np.flatnonzero(np.diff(block, prepend=-1))
                parts = [(at[a:b] % BLOCK_BITS).astype("<u4").tobytes() for a, b in pairwise([*first, len(at)])]
                yield pa.RecordBatch.from_arrays([pa.array(block[first].astype(np.int32)), pa.array(parts, pa.binary())], ["block", "places"])

    def packed(group: pa.Table) -> pa.Table:
        flags = np.zeros(BLOCK_BITS, np.uint8)
        for part in group.column("places").to_pylist():
            flags[np.frombuffer(part, "<u4")] = 1
        return pa.table({"block": group.column("block")[:1], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    filled = np.zeros(bits // 8, np.uint8)
    made = frequent.select("bucket", "found").mapInArrow(places, "block int, places binary").groupBy("block").applyInArrow(packed, "block int, bits binary")
    for row in made.toLocalIterator():
        at = row["block"] * (BLOCK_BITS // 8)
        filled[at : at + BLOCK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return filled


def _counted(docs: DataFrame, shards: int, buckets: int, bits: np.ndarray) -> DataFrame:
    """(lang, words, phrase, n) of a task's texts: words 1 for each word, 2 and 3 for phrases that the filter lets in, 0
    for the count of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(shared.value, np.uint8)
        total = len(flags) * 8

        def wanted(hashes: np.ndarray) -> np.ndarray:
            one, two = _filter_places(_number(hashes, buckets), total)
            return ((flags[one >> 3] >> (one & 7)) & (flags[two >> 3] >> (two & 7)) & 1).astype(bool)

        for chunk in _chunks(batches, shards):
            hashes, names = _hashes(chunk), list(chunk.ids)
            by_lang: dict[str, list] = {}
            for lang, _, *arrays in chunk.phrases():
                by_lang.setdefault(lang, []).append(arrays)
            for lang, parts in by_lang.items():
                ids, two, three = (np.concatenate(x) for x in zip(*parts, strict=True))
                pair_hashes, triple_hashes = _phrase_hashes(hashes[ids], lang, two, three)
                starts, starts3 = np.flatnonzero(two)[wanted(pair_hashes)], np.flatnonzero(three)[wanted(triple_hashes)]
                base = np.int64(len(names))
                seen = [(0, [b""], np.array([len(ids)]))]
                found, n = np.unique(ids, return_counts=True)
                seen.append((1, [names[i] for i in found], n))
                found, n = np.unique(ids[starts] * base + ids[starts + 1], return_counts=True)
                seen.append((2, [names[x // base] + b" " + names[x % base] for x in found.tolist()], n))
                heads, rank = np.unique(ids[starts3] * base + ids[starts3 + 1], return_inverse=True)
                found, n = np.unique(rank * base + ids[starts3 + 2], return_counts=True)
                heads = heads.tolist()
                seen.append((3, [b" ".join((names[heads[x // base] // base], names[heads[x // base] % base], names[x % base])) for x in found.tolist()], n))
                for size, phrases, n in seen:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array([size] * len(phrases), pa.int8()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "words", "phrase", "n"])

    return docs.mapInArrow(count, "lang string, words byte, phrase string, n long")


def phrase_counts(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> DataFrame:
    """(lang, words, phrase, n): the words and the phrases of two and three words that a language holds `support` times or
    more, and, as words 0, the count of all its words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    sizes = {r["shard"]: r["n"] for r in texts.groupBy((F.crc32("text") % shards).alias("shard")).agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return spark.createDataFrame([], "lang string, words byte, phrase string, n long")
    least = [-(-support * sizes.get(i, 0) // total) for i in range(shards)]
    # some three bytes of text for each phrase, at least
    buckets = 1 << max(6, (total // (3 * shards * GROUP)).bit_length())
    frequent = materialize(_frequent(_local_counts(texts, shards, buckets), least), "collocations-frequent")
    union = frequent.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (union * BITS_EACH).bit_length()))
    counts = _counted(texts, shards, buckets, _bit_filter(frequent, bits)).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return materialize(counts.filter((F.col("n") >= support) | (F.col("words") == 0)), "collocations-counts")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases by the score of their worst cut, without those
    that a longer candidate holds and mostly stands for."""
    counts = phrase_counts(docs, support, shards)
    phrases = counts.filter("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    # the most frequent longer phrase around each shorter one
    inner = F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("phrase")
    longer = phrases.filter("words = 3").select("lang", F.col("a").alias("longer"), inner).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 50 * a").drop("longer")

    cut = F.explode(F.sequence(F.lit(1), F.col("words").cast("int") - 1)).alias("k")
    cuts = kept.select("lang", "phrase", "a", "words", cut).selectExpr("lang", "phrase", "a", "k", "substring_index(phrase, ' ', k) AS first", "substring_index(phrase, ' ', k - words) AS rest")
    part = lambda name, n: counts.filter("words IN (1, 2)").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = {c: f"CAST({c} AS DECIMAL(19, 0))" for c in "alr"}
    # 38 digits hold 10^6 * a * a for counts up to 10^16; both products are exact, and so is the division of whole numbers
    score = F.expr(f"CAST(CAST({wide['a']} * {wide['a']} AS DECIMAL(32, 0)) * CAST(1000000 AS DECIMAL(7, 0)) AS DECIMAL(38, 0)) DIV CAST({wide['l']} * {wide['r']} AS DECIMAL(38, 0))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = worst.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part"))
    # a language can hold a third of all phrases: the first of each part, then the first of these
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", F.col("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
