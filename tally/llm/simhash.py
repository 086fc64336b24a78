"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes of its shingles.
Different fingerprints are compared once each; documents that share one are linked by it already.

Two fingerprints that differ in at most `radius` bits have population counts that differ by at most as much,
in whole and summed over the four 16-bit quarters. A tile holds the fingerprints of the same population count, or,
for a small radius, whose quarters have the same four; pairs of tiles whose counts differ beyond the radius are
skipped, and the others are compared whole, by numpy exclusive-or and bit counts. There are at most 17**4 tiles,
whatever the input; a tile
of more than `block` fingerprints is split into blocks that meet each other one by one, so that no task holds
more than a block and passes its visitors by in slices.

A task links what it found to the least fingerprint of each local component, so no group of near copies is
written as all its pairs; the links are joined into components by stars.

keep_one() takes such links as candidates only, since 64 bits say too little about a similarity of 0.8: texts just
above it are often further apart than the radius, and others are within it by chance. Texts that share a band of
minimum hashes are candidates too, which misses a pair of similarity 0.8 with a chance of 5e-6. In each component of
candidates the texts' whole sets of shingles are compared, and only pairs with a Jaccard similarity of SIMILAR or
more are linked.

Nulls and empty texts have fingerprint 0 and are linked like any other. A null doc_id is kept and never names a
component that has another id. Repeated rows are separate documents. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import materialize
from tally.llm.components import components

RADIUS = 2
WORDS = 3
BLOCK = 8192
#: Fingerprints of a row of those that travel.
PACKED = 1024
#: Pairs that are compared at once; if all are near, their numbers take some forty bytes each.
COMPARED = 1 << 20
SEED = 42
#: The radius for texts that share 0.8 of their shingles: 64 acos(2 * 0.8 / 1.8) / pi = 9.7 bits are expected to differ.
SIMILAR_RADIUS = 10
#: The widest radius for which tiles are told apart by quarters; beyond it quarters skip next to nothing.
QUARTERED = 3
#: The least Jaccard similarity of two near copies' sets of shingles.
SIMILAR = 0.8
#: Bands of minimum hashes, and hashes in each: 1 - (1 - 0.8**6)**40 = 0.999995 of the pairs at 0.8 share a band.
BANDS, ROWS = 40, 6
#: Shingles of a component that are compared with one another in one task, in whole texts.
VERIFIED = 1 << 19
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, n_words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The XXH64 hashes of a text's shingles in their order; a text of fewer words is one shingle, an empty one none."""
    words = text.translate(LOWER).split()  # bytes split at 0x09-0x0D and 0x20
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n_words:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(n_words))))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64, max(1, len(words) - n_words + 1))


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, n_words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text in UTF-8, as an unsigned number."""
    return _majority(shingle_hashes(text, n_words, seed))


def fingerprints(docs: DataFrame, text: str = "text", n_words: int = WORDS) -> DataFrame:
    """docs without the text, with `fp`, the fingerprint as a signed 64-bit number, in place of a column of this name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t or b"", n_words) for t in batch.column(text).cast(pa.binary()).to_pylist()]
            yield batch.drop_columns([text]).append_column("fp", pa.array(np.array(values, np.uint64).view(np.int64)))

    rest = docs.drop(text, "fp")
    return docs.select(text, *[F.col(f"`{c}`") for c in rest.columns]).mapInArrow(run, rest.withColumn("fp", F.lit(0).cast("long")).schema)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _parts(radius: int) -> int:
    """Into how many parts of equal width a fingerprint is cut to name its tile."""
    return 4 if radius <= QUARTERED else 1


def _tile(fp: Column, parts: int) -> list[Column]:
    width = 64 // parts
    part = lambda q: F.shiftrightunsigned(fp, width * q).bitwiseAND(F.lit((1 << width) - 1).cast("long")) if parts > 1 else fp
    return [F.bit_count(part(q)).cast("int") for q in range(parts)]


def _steps(radius: int, parts: int) -> list[tuple[int, ...]]:
    """The differences of two tiles' counts within the radius, one of each pair of opposites."""
    found = [()]
    for _ in range(parts):
        found = [s + (d,) for s in found for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return [s for s in found if s > (0,) * parts]


def _number(counts: list[Column], parts: int) -> Column:
    number = F.lit(0)
    for c in counts:
        number = number * (64 // parts + 1) + c
    return number


def link_block(members: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), a below b, that join all that is within the radius among members, and between members and
    visitors: one link for each fingerprint that is not the least of its component here."""
    both = np.concatenate([members, visitors])
    order = np.unique(both)
    own, guests = np.searchsorted(order, members), np.searchsorted(order, visitors)
    root = np.arange(len(order))
    side = max(1, COMPARED // max(1, len(members)))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = root[i], root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low < high
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(root, high[apart], low[apart])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up

    for rows in (own, guests):
        for at in range(0, len(rows), side):
            part = rows[at : at + side]
            near = np.bitwise_count(order[part][:, None] ^ members[None, :]) <= radius
            i, j = np.nonzero(near)
            join(part[i], own[j])
    linked = np.flatnonzero(root != np.arange(len(order)))
    return order[root[linked]], order[linked]


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the different values of fps.fp which join all that differ in radius bits or fewer."""
    parts = _parts(radius)
    counts = _tile(F.col("fp"), parts)
    tiled = fps.select("fp", F.array(*counts).alias("counts"), _number(counts, parts).alias("tile"))
    # at most 17**4 rows, whatever the input, so it can be broadcast
    blocks = tiled.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    blocks = F.broadcast(materialize(blocks, "simhash-tiles"))
    own_block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a block's fingerprints travel as arrays, to their own place and to those that they visit
    at_home = tiled.join(blocks, "tile").groupBy("tile", own_block.alias("home")).agg(F.first("counts").alias("counts"), F.first("blocks").alias("blocks"), F.collect_list("fp").alias("fps"))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("fps") - 1) / PACKED).cast("int")), lambda i: F.slice("fps", i * PACKED + 1, F.lit(PACKED)))
    at_home = materialize(at_home.select("tile", "home", "counts", "blocks", F.explode(slices).alias("fps")), "simhash-packed")
    member = at_home.select("tile", F.col("home").alias("block"), F.lit(True).alias("member"), "fps")
    later = F.when(F.col("home") + 1 < F.col("blocks"), F.sequence(F.col("home") + 1, F.col("blocks") - 1)).otherwise(F.array().cast("array<int>"))
    within = at_home.filter("blocks > 1").select("tile", F.explode(later).alias("block"), F.lit(False).alias("member"), "fps")

    def beside(step: tuple[int, ...]) -> Column:
        near = [F.element_at("counts", q + 1) + d for q, d in enumerate(step)]
        legal = F.lit(True)
        for c, d in zip(near, step):
            legal = legal & c.between(0, 64 // parts) if d else legal
        return F.when(legal, _number(near, parts))

    away = at_home.select("fps", F.explode(F.array_compact(F.array(*[beside(s) for s in _steps(radius, parts)]))).alias("tile"))
    away = away.join(blocks, "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("member"), "fps")
    dealt = member.union(within).union(away).repartition("tile", "block").sortWithinPartitions("tile", "block", F.col("member").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[np.ndarray] = []
        at = None

        def meet(guests: list[np.ndarray]) -> pa.RecordBatch:
            a, b = link_block(np.concatenate(members), np.concatenate([*guests, np.zeros(0, np.uint64)]), radius)
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        guests: list[np.ndarray] = []
        for batch in batches:
            packed = batch.column("fps")
            sizes = packed.value_lengths().to_numpy()
            place = np.repeat(batch.column("tile").to_numpy().astype(np.int64) << 32 | batch.column("block").to_numpy(), sizes)
            is_member = np.repeat(batch.column("member").to_numpy(zero_copy_only=False), sizes)
            fp = packed.flatten().to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if x == y:
                    continue
                if place[x] != at:
                    if members:
                        yield meet(guests)
                    at, members, guests = place[x], [], []
                mine = is_member[x:y]
                if mine.any():
                    members.append(fp[x:y][mine])
                guests.append(fp[x:y][~mine])
                if sum(map(len, guests)) > 4 * block:  # members come first, so all of them are here
                    yield meet(guests)
                    guests = []
        if members:
            yield meet(guests)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, n_words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: the least doc_id reachable over links."""
    marked = materialize(fingerprints(docs.select("doc_id", "text"), n_words=n_words), "simhash")
    # signed order differs from unsigned order, but the root only names the component
    by_fp = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = materialize(components(links(by_fp.select("fp"), radius)), "simhash-roots")
    grouped = by_fp.join(roots, by_fp.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp")


def _bands() -> tuple[np.ndarray, np.ndarray]:
    """The factors of the minimum hashes, and those that join the minima of a band."""
    rng = np.random.default_rng(SEED)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    return draw(BANDS * ROWS), draw(BANDS * ROWS).reshape(BANDS, ROWS)


def band_keys(distinct: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One key for each band: texts of similarity s have the same key of a band with chance s**ROWS."""
    scale, join = factors
    least = np.full(len(scale), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), 1 << 10):
        np.minimum(least, (scale[:, None] * distinct[None, at : at + (1 << 10)]).min(axis=1), out=least)
    return (least.reshape(BANDS, ROWS) * join).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)


def _sketches(docs: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, tie, node, n, fp, keys): node names the set of shingles, of which there are n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _bands()
        for batch in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(t or b"", n_words)
                distinct = np.unique(hashes)
                nodes.append(xxhash.xxh64_intdigest(distinct.tobytes(), seed=SEED))
                sizes.append(len(distinct))
                prints.append(_majority(hashes))
                keys.append(band_keys(distinct, factors).view(np.int64))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), signed(nodes), pa.array(sizes, pa.int64()), signed(prints), listed],
                names=["doc_id", "tie", "node", "n", "fp", "keys"],
            )

    out = docs.select("doc_id", "tie", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("fp"), F.array(F.lit(0).cast("long")).alias("keys")).schema
    return docs.select("text", "doc_id", "tie").mapInArrow(run, out)


def _candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): links whose components hold all pairs of nodes that share a band, or whose fingerprints are linked."""
    keyed = nodes.filter("n > 0").select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a <> last").select("key", "a")
    by_band = keyed.join(materialize(shared, "simhash-bands"), "key").select("a", F.col("node").alias("b"))
    by_fp = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "simhash-distinct")
    near = materialize(links(by_fp.select("fp"), radius), "simhash-near")
    least = by_fp.withColumnRenamed("fp", "x")
    linked = near.join(least, near.a == least.x).select(F.col("first").alias("a"), F.col("b").alias("other"))
    linked = linked.join(least, linked.other == least.x).select("a", F.col("first").alias("b"))
    same = nodes.join(by_fp, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return by_band.union(linked).union(same).filter("a <> b").distinct()


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, least: float = SIMILAR) -> list[tuple[int, int]]:
    """Links that join all pairs of sets of different sides (any, if all are of one side) that are as similar as
    `least` or more. Two such sets share one of the first n - ceil(least * n) + 1 elements of each, in any common
    order; the rarest come first. Pairs that earlier links join already are left out."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((inverse, counts[inverse], owner))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    whole = len(np.unique(side)) == 1
    root = np.arange(len(sets))
    posted: dict[int, list[int]] = {}
    found = []
    for i in range(len(sets)):
        n = int(sizes[i])
        # a little less than least * n, lest rounding cut one element too many
        prefix = inverse[order[starts[i] : starts[i] + n - int(np.ceil(least * n - 1e-9)) + 1]]
        lists = []
        for e in prefix[counts[prefix] > 1].tolist():
            held = posted.setdefault(e, [])
            if held:
                lists.append(np.array(held))
            held.append(i)
        others = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
        if not whole:
            others = others[side[others] != side[i]]
        others = others[np.minimum(sizes[others], n) >= least * np.maximum(sizes[others], n) - 1e-9]
        others = others[root[others] != root[i]]
        while len(others):
            j = int(others[0])
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= least * (n + int(sizes[j]) - both) - 1e-9:
                found.append((j, i))
                root[root == root[i]] = root[j]
            others = others[1:]
            others = others[root[others] != root[i]]
    return found


def _verified(docs: DataFrame, chosen: DataFrame, n_words: int) -> DataFrame:
    """(a, b): links between nodes that join all near copies within each component of candidates.

    chosen (node, root, n, key, tie) names a row of docs for each node. A component of many shingles is cut into blocks
    that meet each other one by one."""
    blocks = chosen.groupBy("root").agg(F.ceil(F.sum("n") / VERIFIED).cast("int").alias("blocks"))
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = chosen.join(materialize(blocks, "simhash-blocks"), "root").select("key", "tie", "node", "root", "blocks", home.alias("home"))
    texts = docs.join(materialize(dealt, "simhash-chosen"), ["key", "tie"]).dropDuplicates(["node"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t or b"", n_words)).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield batch.drop_columns(["text"]).append_column("set", pa.array(sets, pa.binary()))

    sets = materialize(texts.select("text", "node", "root", "blocks", "home").mapInArrow(hashed, "node long, root long, blocks int, home int, set binary"), "simhash-sets")
    meet = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = sets.select("node", "root", "home", "set", meet).select("node", "root", "home", "set", F.least("home", "other").alias("x"), F.greatest("home", "other").alias("y"))
    pairs = pairs.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, homes, held = None, [], [], []

        def compare() -> pa.RecordBatch:
            found = similar_pairs(held, np.array(homes))
            a, b = [nodes[i] for i, _ in found], [nodes[j] for _, j in found]
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            for node, root, home, x, y, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "root", "home", "x", "y", "set"))):
                if (root, x, y) != at:
                    if len(held) > 1:
                        yield compare()
                    at, nodes, homes, held = (root, x, y), [], [], []
                nodes.append(node)
                homes.append(home)
                held.append(np.frombuffer(raw, np.uint64))
        if len(held) > 1:
            yield compare()

    return pairs.mapInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, radius: int = SIMILAR_RADIUS, n_words: int = 5) -> DataFrame:
    """docs with one document of each group of near copies: that of the least doc_id, nulls last, ties by the whole
    row. Near copies share SIMILAR or more of their shingles; groups are the components of such pairs."""
    hashable = [f.name for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    whole = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id").alias("key"), F.xxhash64(*hashable).alias("tie"))
    narrow = whole.select("row.doc_id", "row.text", "key", "tie")
    marked = materialize(_sketches(narrow, n_words), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie"))
    alike = marked.groupBy("node").agg(first.alias("least"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = materialize(alike, "simhash-nodes")
    loose = materialize(components(_candidates(nodes, radius)), "simhash-loose")
    chosen = nodes.filter("n > 0").join(loose, "node").select("node", "root", "n", F.xxhash64("least.doc_id").alias("key"), "least.tie")
    proved = materialize(_verified(narrow, chosen, n_words), "simhash-proved")
    roots = materialize(components(proved), "simhash-roots").withColumnRenamed("node", "of")
    grouped = nodes.join(roots, nodes.node == roots.of, "left").select("least", F.coalesce("root", "node").alias("root"))
    kept = grouped.groupBy("root").agg(F.min("least").alias("least")).select(F.xxhash64("least.doc_id").alias("key"), "least.tie")
    # rows that are equal in all columns share key and tie; join and dropDuplicates are by them, after one shuffle
    return whole.join(materialize(kept, "simhash-kept"), ["key", "tie"], "left_semi").dropDuplicates(["key", "tie"]).select("row.*")
