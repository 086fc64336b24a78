"""A distributed LSD radix sort of rows by whole-number keys.

Rows have a place from 0 on; ROWS consecutive places are a part. A pass over one digit counts the digits of each part,
turns the counts into the first place of each digit in each part (first all smaller digits, then the same digit in earlier parts),
and moves each row to that place plus the rows of its digit before it in its part. Such a pass is stable, so passes from
the least digit of the last key to the greatest digit of the first one sort by all keys. Each pass is one shuffle of the rows by
part, whose groups hold `rows` of them whatever the keys are, and is written to the shared folder. Digits above the range of a
key take no pass.

A null key stands last. Equal rows keep the order of their first places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import materialize, shuffle_partitions

BITS = 12
LEAST_ROWS, MOST_ROWS = 64, 1 << 19
#: Parts for each shuffle partition: several, so that hashing deals them evenly.
PARTS = 4


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows, written, with `pos`: 0, 1, 2 and so on in the order in which tasks wrote them. The names `pos`, `part` and
    `place` are taken."""
    schema = T.StructType([*rows.schema, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield batch.append_column("part", pa.array(np.full(batch.num_rows, part, np.int32))).append_column("place", pa.array(np.arange(at, at + batch.num_rows)))
            at += batch.num_rows

    written = materialize(rows.mapInArrow(number, schema), name)
    sizes = written.groupBy("part").agg(F.count("*").alias("n"))  # one row for each task
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written.join(sizes.select("part", before.alias("base")), "part").select(*rows.columns, (F.col("base") + F.col("place")).alias("pos"))


def _unsigned(column: pa.ChunkedArray | pa.Array, low: int, high: int, descending: bool) -> np.ndarray:
    """Distances from the end that stands first, modulo 2^64, in which whole 64-bit ranges fit; a null one beyond the range."""
    missing = np.asarray(column.is_null())
    values = np.asarray(column.fill_null(low)).astype(np.int64).view(np.uint64)
    wrap = lambda x: np.uint64(x % (1 << 64))
    away = wrap(high) - values if descending else values - wrap(low)
    away[missing] = wrap(high - low + 1)
    return away


def _counts(rows: DataFrame, key: tuple, shift: int, per_part: int) -> DataFrame:
    """(part, digit, n)."""
    name, low, high, descending = key

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digit = (_unsigned(batch.column(name), low, high, descending) >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)
            part = np.asarray(batch.column("pos")) // per_part
            both, n = np.unique((part << BITS) | digit.astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both >> BITS), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)), pa.array(n)], ["part", "digit", "n"])

    return rows.select(name, "pos").mapInArrow(count, "part long, digit int, n long").groupBy("part", "digit").agg(F.sum("n").alias("n"))


def _first_places(counts: DataFrame) -> DataFrame:
    """(part, digits, firsts): the first place of each digit of a part."""
    counts = materialize(counts, "radix-counts")
    totals = counts.groupBy("digit").agg(F.sum("n").alias("total"))  # 2^BITS rows at most
    smaller = totals.select("digit", F.coalesce(F.sum("total").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("smaller"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("digit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("part", "digit", earlier.alias("earlier")).join(F.broadcast(smaller), "digit")
    both = F.sort_array(F.collect_list(F.struct("digit", (F.col("smaller") + F.col("earlier")).alias("first"))))
    return firsts.groupBy("part").agg(both.alias("b")).select("part", F.col("b.digit").alias("digits"), F.col("b.first").alias("firsts"))


def _moved(rows: DataFrame, key: tuple, shift: int, per_part: int) -> DataFrame:
    """rows with the places that this digit gives them."""
    name, low, high, descending = key
    firsts = _first_places(_counts(rows, key, shift, per_part))
    columns = rows.columns

    def move(group: pa.Table, where: pa.Table) -> pa.Table:
        pos = np.asarray(group.column("pos"))
        if not len(pos):
            return group.select(columns)
        slot = np.empty(len(pos), np.int64)  # rows in order of place
        slot[pos - pos.min()] = np.arange(len(pos))
        digit = ((_unsigned(group.column(name), low, high, descending)[slot] >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)).astype(np.uint16)
        order = np.argsort(digit, kind="stable")  # of 16-bit numbers: a counting sort
        n = np.bincount(digit, minlength=1 << BITS)
        first = np.zeros(1 << BITS, np.int64)
        first[np.asarray(where.column("digits")[0].values)] = np.asarray(where.column("firsts")[0].values)
        inside = np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)  # how many of the digit stand before
        placed = np.empty(len(pos), np.int64)
        placed[slot[order]] = first[digit[order]] + inside
        return group.drop_columns(["pos", "part"]).append_column("pos", pa.array(placed)).select(columns)

    dealt = rows.withColumn("part", F.floor(F.col("pos") / per_part).cast("long"))
    return dealt.groupBy("part").cogroup(firsts.groupBy("part")).applyInArrow(move, rows.schema)


def radix_sort(rows: DataFrame, keys: list[tuple[str, bool]], name: str = "radix") -> DataFrame:
    """rows with `pos`, the place of the row in order of keys (column, descending), from 0 on."""
    spark = rows.sparkSession
    now = materialize(numbered(rows, f"{name}-numbered"), f"{name}-start")
    ends = now.agg(F.count("*").alias("n"), *[f(k).alias(f"{w}{i}") for i, (k, _) in enumerate(keys) for w, f in (("low", F.min), ("high", F.max), ("nulls", lambda c: F.count_if(F.col(c).isNull())))]).first()
    per_part = min(MOST_ROWS, max(LEAST_ROWS, -(-ends["n"] // (PARTS * shuffle_partitions(spark)))))
    for i, (column, descending) in reversed(list(enumerate(keys))):
        low, high = ends[f"low{i}"] or 0, ends[f"high{i}"] or 0
        span = high - low + (ends[f"nulls{i}"] > 0)
        if span >= 1 << 64:
            raise ValueError(f"{column} has nulls beside a whole range of 64 bits")
        for shift in range(0, span.bit_length(), BITS):
            now = materialize(_moved(now, (column, low, high, descending), shift, per_part), f"{name}-pass")
    return now
