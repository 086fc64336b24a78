"""Byte-level BPE encoding and decoding by rank files.

A text is cut by the tokenizer's pattern, and each match is encoded by itself. A match starts as single bytes.
A segment tree over the byte positions holds, for each live part, the rank of joining it with its right
neighbour, and its root the leftmost smallest; a merge takes the root, joins the two parts and updates three
leaves (the joined part, the one that went, and the left neighbour), each in logarithmic time. So a match of
n bytes takes O(n log n), however long it is.

Matches recur, so a worker keeps the ids of recent short ones, see pieces.

Nulls and empty texts give no ids. Very long texts and matches are encoded whole. Repeated rows are separate
documents; other columns pass through untouched, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.pieces import KEPT, Encoder


def encode_match(ranks: dict[bytes, int], match: bytes) -> list[int]:
    """The ids of one match of the pattern."""
    whole = ranks.get(match)
    if whole is not None:
        return [whole]
    n = len(match)
    none = len(ranks) * n + n + 1  # above every rank * n + position
    size = 1 << (n - 1).bit_length()
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(match[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    after = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n - 1))  # where the part to the left of this one starts

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            left, right = tree[2 * k], tree[2 * k + 1]
            least = left if left < right else right
            if tree[k] == least:
                return
            tree[k] = least

    def rank_at(i: int) -> int:
        """What joining the part at i with the next one is worth."""
        mid = after[i]
        if mid >= n:
            return none
        rank = ranks.get(match[i : after[mid]])
        return none if rank is None else rank * n + i

    while tree[1] < none:
        i = tree[1] % n
        gone = after[i]
        end = after[gone]
        after[i] = end
        if end < n:
            before[end] = i
        put(gone, none)
        put(i, rank_at(i))
        if before[i] >= 0:
            put(before[i], rank_at(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[match[i : after[i]]])
        i = after[i]
    return ids


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(path).items()}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, kept: int = KEPT) -> Encoder:
    ranks = load_ranks(path)
    return Encoder(pattern, lambda match: np.array(encode_match(ranks, match.encode()), "<u4").tobytes(), kept)


def _added(batch: pa.RecordBatch, name: str, values: list[bytes]) -> pa.RecordBatch:
    return batch.append_column(name, pa.array(values, pa.large_binary()).cast(pa.binary()))


def _decoded(ids: bytes | None, known: dict[int, bytes]) -> bytes:
    return b"".join(map(known.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None, kept: int = KEPT) -> DataFrame:
    """docs without the text, with the column `ids`: the ids as little-endian unsigned 32-bit integers; and, if
    it has a name, with the column `decoded`: the bytes that the ids stand for, by the worker that encoded them.
    Columns of docs that are called like the new ones give way to them. A worker's stores hold `kept` entries each:
    fewer take less memory and more time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, known = encoder(ranks_path, pattern, kept).encode, token_bytes(ranks_path)
        for whole in batches:
            for batch in _slices(whole):
                values = [to_ids(t or "") for t in batch.column(text).to_pylist()]
                out = _added(batch.drop_columns([text]), ids, values)
                yield _added(out, decoded, [_decoded(x, known) for x in values]) if decoded else out

    rest = docs.drop(text, ids, *([decoded] if decoded else []))
    schema = rest.withColumns({c: F.lit(None).cast("binary") for c in (ids, decoded) if c}).schema
    return docs.select(text, *[F.col(f"`{c}`") for c in rest.columns]).mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """tokens with the column `out`: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(ranks_path)
        for whole in batches:
            for batch in _slices(whole):
                yield _added(batch, out, [_decoded(x, known) for x in batch.column(ids).to_pylist()])

    return tokens.mapInArrow(run, tokens.withColumn(out, F.lit(None).cast("binary")).schema)


def n_tokens(ids: str = "token_ids"):
    return (F.octet_length(ids) / 4).cast("long")
