"""Joining texts to a dictionary by partial ratio, without losing a pair and without comparing all of them.

From the ratio follows how many pairs of adjacent characters the shorter string of a pair must share with the longer one
(fuzzy.least_grams). Where that is one or more, pairs are found by an index: the rarest of the shorter string's pairs of characters, all but the
needed number less j, are looked up among those of the longer one, since at least j of them must be there. Where
the ratio is so low, or the string so short, that nothing follows, blocks of texts meet blocks of names; a pair is compared only if
the characters that both have could give the ratio.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.functions import fuzzy

GRAM = 2
#: So many grams must be shared among those looked up, if as many are needed: more are looked up, and fewer pairs compared.
HITS = 4
BLOCK = 512
#: Sizes up to which the needed number is found by trying all cases; above them a bound is worked out.
TRIED = 100


@lru_cache(maxsize=None)
def needed(size: int, least: float) -> int:
    if size <= TRIED:
        return fuzzy.least_grams(size, least, GRAM)
    # common - (1 + both sizes - 2 * common), both sizes being 200 * common / least at most
    return math.ceil(fuzzy.least_common(size, least) * (3 - 200 / least) - 1)


def _parts(texts: DataFrame) -> int:
    """Parts of texts and pairs: cutting and comparing takes far longer than their bytes say, so the number is not left to these."""
    return int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _grams(strings: DataFrame, column: str, least: float) -> DataFrame:
    """(the other columns of strings, size, need, gram): a row for each pair of adjacent characters; the n-th of a kind is a gram of its
    own. The string itself is not repeated beside its grams."""
    keys = [c for c in strings.columns if c != column]
    schema = strings.select(*keys).selectExpr("*", "0 AS size", "0 AS need", "'' AS gram").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, grams = batch.column(column).to_pylist(), []
            for s in texts:
                seen: Counter = Counter()
                for gram in map("".join, zip(s, s[1:])):
                    seen[gram] += 1
                    grams.append(f"{gram}{seen[gram]}")
            sizes = np.array([len(s) for s in texts], np.int64)
            rows = np.repeat(np.arange(len(texts)), np.maximum(sizes - GRAM + 1, 0))
            needs = np.array([needed(int(n), least) for n in sizes], np.int32)
            out = batch.select(keys).take(pa.array(rows, pa.int64()))
            for name, values in (("size", pa.array(sizes[rows], pa.int32())), ("need", pa.array(needs[rows], pa.int32())), ("gram", pa.array(grams, pa.string()))):
                out = out.append_column(name, values)
            yield out

    return strings.mapInArrow(cut, schema)


def _rarest(grams: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Of each string as many of its rarest grams as `hits` that are shared must be among."""
    hits = F.least("need", F.lit(HITS))
    known = grams.filter("need >= 1").join(counts, "gram", "left")
    order = Window.partitionBy(*keys).orderBy(F.coalesce("n", F.lit(0)), "gram")  # one string's own grams
    return known.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col("size") - GRAM + 1 - F.col("need") + hits).select(*keys, "size", hits.alias("hits"), "gram")


def _indexed(texts: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(asked, name, low) whose shorter string has grams enough, and that share enough of those looked up.

    Texts go through the index by a hash, so that a row of it is as small for a long text; two texts of one hash would only be compared
    with each other's names too. Texts are looked up in names only where they are shorter than the longest name."""
    keyed = texts.select("asked", F.xxhash64("asked").alias("key"))
    longest = names.agg(F.coalesce(F.max(F.length("low")), F.lit(0))).first()[0]
    low = names.select("name", "low", F.col("low").alias("string"))
    of_names, of_texts = _grams(low, "string", least), _grams(keyed, "asked", least)
    of_short = _grams(keyed.filter(F.length("asked") < longest), "asked", least)
    counts = of_names.groupBy("gram").agg(F.count("*").alias("n"))
    plain = lambda grams, keys: grams.select(*keys, F.col("size").alias("other"), "gram")
    by_name = _rarest(of_names, counts, ["name", "low"]).join(plain(of_texts, ["key"]), "gram").filter("size <= other")
    by_text = _rarest(of_short, counts, ["key"]).join(plain(of_names, ["name", "low"]), "gram").filter("size < other")
    found = by_name.select("key", "name", "low", "hits").union(by_text.select("key", "name", "low", "hits"))
    enough = found.groupBy("key", "name", "low", "hits").agg(F.count("*").alias("n")).filter("n >= hits").select("key", "name", "low")
    parts = _parts(texts)
    return enough.repartition(parts, "key").join(keyed.repartition(parts, "key"), "key").select("asked", "name", "low")


def _in_blocks(texts: DataFrame, names: DataFrame, least: float, most: int) -> DataFrame:
    """(asked, name, score): the best of each pair of blocks whose shorter string gives no gram to look for."""

    def blocks(rows: DataFrame, key: str, n: int, value) -> DataFrame:
        return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(value).alias(key))

    n_names, n_texts = (max(1, math.ceil(df.count() / BLOCK)) for df in (names, texts))
    left = blocks(texts, "asked", n_texts, F.col("asked")).select("asked", F.explode(F.sequence(F.lit(0), F.lit(n_names - 1))).alias("block"))
    pairs = left.join(blocks(names, "name", n_names, F.struct("name", "low")), "block").select("asked", "name")

    def letters(strings: list[str], known: dict[str, int]) -> np.ndarray:
        out = np.zeros((len(strings), len(known) + 1), np.int16)
        for row, s in zip(out, strings, strict=True):
            for c, n in Counter(s).items():
                row[known.get(c, len(known))] += n
        return out

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, listed in zip(batch.column("asked").to_pylist(), batch.column("name").to_pylist(), strict=True):
                name, low = [x["name"] for x in listed], [x["low"] for x in listed]
                known = {c: i for i, c in enumerate(sorted(set("".join(low))))}
                a, b = letters(asked, known)[:, :-1], letters(low, known)[:, :-1]
                size_a, size_b = np.array([len(x) for x in asked]), np.array([len(x) for x in low])
                loose_a, loose_b = (np.array([needed(int(n), least) < 1 for n in s]) for s in (size_a, size_b))
                found = []
                for i in range(len(asked)):
                    shared = np.minimum(a[i], b).sum(axis=1)
                    short = np.minimum(size_a[i], size_b)
                    loose = np.where(size_b <= size_a[i], loose_b, loose_a[i])
                    found += [(i, j) for j in np.flatnonzero(loose & (shared * (200 - least) >= least * short))]
                scores = fuzzy.partial_ratios([asked[i] for i, _ in found], [low[j] for _, j in found])
                best: dict[int, list] = {}
                for (i, j), score in zip(found, scores.tolist(), strict=True):
                    if score >= least:
                        best.setdefault(i, []).append((-score, name[j]))
                kept = [(asked[i], n, -s) for i, x in best.items() for s, n in sorted(x)[:most]]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.string()), pa.array([k[2] for k in kept], pa.float64())], ["asked", "name", "score"])

    return pairs.mapInArrow(meet, "asked string, name string, score double")


def best_names(texts: DataFrame, names: DataFrame, least: float, most: int) -> DataFrame:
    """(asked, name, score, rank): for each different text (asked) the `most` names whose small letters have the largest partial ratio with
    it, from `least` on, ties by name. Nulls and empty strings have no part in it."""
    texts = texts.select("asked").filter("asked <> ''").repartition(_parts(texts), "asked").distinct()
    names = names.select("name", F.lower("name").alias("low")).filter("name <> ''").distinct()
    if needed(10 * TRIED, least) < 1:  # no string gives a gram
        scored = _in_blocks(texts, names, least, most)
    else:
        short = [n for n in range(1, 10 * TRIED) if needed(n, least) < 1]
        loose = lambda c: F.length(c).isin(short)
        scored = _in_blocks(texts, names.filter(loose("low")), least, most).union(_in_blocks(texts.filter(loose("asked")), names.filter(~loose("low")), least, most))
        scored = scored.union(_indexed(texts, names, least).select("asked", "name", fuzzy.partial_ratio("low", "asked").alias("score")).filter(F.col("score") >= least))
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "name")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most).select("asked", "name", "score", "rank")
