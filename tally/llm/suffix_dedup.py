"""Removal of repeated passages by external suffix arrays: a byte goes if a string of `length` bytes that covers
it also starts anywhere else.

1. Each window of `length` bytes owns an anchor, the least hash of the k-grams in it, the leftmost of equals.
   Equal windows have equal anchors at equal places, so a window whose anchor occurs once is not repeated. All
   consecutive windows of one anchor make a context: the bytes that they cover, at most length + length - k.
2. Contexts of one anchor that are equal are one context with a count. A context goes on if its anchor occurs
   twice or more; its bytes are cut from one document that holds it.
3. The contexts are dealt to shards by anchor, and each shard's suffixes are sorted by external induction, see
   suffix_array. Neighbours that share `length` bytes, and contexts counted twice or more, are repeated.
4. What was found returns to every document that holds the context, and the documents' bytes are removed.

An anchor of more than `hot` different contexts would outgrow a shard. Its contexts are cut in two, by how far
before the anchor their windows start. All windows of a half hold the same middle, which is longer than the
anchor: halves are dealt anew by a hash of it, those whose middle occurs once are let go, and halves that are
still hot are cut again, in the end to single windows, whose middle is the window. So equal windows always meet,
and no shard has more than `hot` contexts of a kind.

Nulls count as empty texts. Texts shorter than `length` lose nothing, and no string reaches over the end of a
document. Exact copies, and rows that are repeated in doc_id and text, lose everything from `length` bytes on.
Very long texts are hashed in pieces of a megabyte with the overlap that windows need. Other columns, whatever
their names, take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm import suffix_array
from tally.llm.common import blocks_for, materialize, shuffle_partitions

LENGTH = 400
KGRAM = 32
HOT = 2048
SHARD_BYTES = 3 << 20
PIECE = 1 << 20
GROUP = 1 << 18
#: The bits of a hash that give way to the place in which it stands.
LOW = np.uint64((1 << 24) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place on."""
    h = data.astype(np.uint64) + np.uint64(1)
    width = 1
    # odd multipliers, one for each doubling of the width
    for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        h = h[:-width] * np.uint64(c) + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = len(values) - width + 1
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:n], values[rest : rest + n]) if rest else values[:n]


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last) for each anchor of texts that stand one after another in data and stop at `ends`:
    the anchor's hash, and the first and last start of the windows that it owns. data: below 2**24 bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), none, none
    hashes = _gram_hashes(data)
    least = _sliding_min((hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64), length - KGRAM + 1)
    at = (least & LOW).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    starts = np.r_[0, ends[:-1]]
    long = ends - starts >= length
    inside[starts[long]] += 1
    inside[ends[long] - length + 1] -= 1
    own = np.cumsum(inside)[: len(at)] > 0
    change = np.r_[True, at[1:] != at[:-1]]
    change[1:] |= own[1:] != own[:-1]
    change[ends[:-1][ends[:-1] < len(at)]] = True
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(at)] - 1
    keep = own[first]
    first, last = first[keep], last[keep]
    return hashes[at[first]], first, last


def _digests(parts: list, seeds: list[int]) -> np.ndarray:
    """128-bit hashes as pairs of signed numbers."""
    joined = b"".join(xxhash.xxh3_128_digest(p, s) for p, s in zip(parts, seeds))
    return np.frombuffer(joined, "<i8").reshape(-1, 2)


def _key(text: Column) -> list[Column]:
    """A text's content as a pair of numbers: its md5."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return [half(1).alias("t1"), half(17).alias("t2")]


OCCURRENCES = "anchor long, c1 long, c2 long, t1 long, t2 long, doc_id long, first int, windows int"


def occurrences(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All contexts of docs (doc_id, text, t1, t2): their anchor and hash, their text, and where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2")]
            doc_ids = batch.column("doc_id")
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            held: list[tuple[int, int, bytes]] = []  # row, place in its text, bytes
            size = 0

            def emit() -> pa.RecordBatch:
                data = b"".join(p for _, _, p in held)
                ends = np.cumsum([len(p) for _, _, p in held])
                hashes, first, last = anchors(np.frombuffer(data, np.uint8), ends, length)
                seeds = hashes.tolist()
                digests = _digests([data[a : b + length] for a, b in zip(first.tolist(), last.tolist())], seeds)
                piece = np.searchsorted(ends, first, "right")
                rows = np.array([r for r, _, _ in held], np.int64)[piece]
                offsets = np.array([o for _, o, _ in held], np.int64)[piece] - np.r_[0, ends[:-1]][piece]
                columns = [hashes.view(np.int64), digests[:, 0], digests[:, 1], names[0][rows], names[1][rows]]
                return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), doc_ids.take(pa.array(rows)), pa.array((first + offsets).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], ["anchor", "c1", "c2", "t1", "t2", "doc_id", "first", "windows"])

            for row, text in enumerate(texts):
                text = text or b""
                if len(text) < length:
                    continue
                for at in range(0, len(text) - length + 1, PIECE):
                    piece = text[at : at + PIECE + length - 1]
                    held.append((row, at, piece))
                    size += len(piece)
                    if size >= GROUP:
                        yield emit()
                        held, size = [], 0
            if held:
                yield emit()

    return docs.select("doc_id", "text", "t1", "t2").mapInArrow(run, OCCURRENCES)


OWNER = "struct<unnamed: boolean, doc_id: long, t1: long, t2: long, first: int>"
CONTEXT = f"anchor long, c1 long, c2 long, copies long, owner {OWNER}, windows int, low int, high int, hot boolean"
_OWNER = pa.struct([("unnamed", pa.bool_()), ("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("first", pa.int32())])


def _cut(contexts: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """contexts, which are whole, with their bytes, cut from the document that owns each."""
    per_doc = contexts.groupBy("owner.t1", "owner.t2", "owner.doc_id").agg(F.collect_list(F.struct("anchor", "c1", "c2", "copies", "owner.first", "windows", "hot")).alias("contexts")).alias("w")
    same = (F.col("d.t1") == F.col("w.t1")) & (F.col("d.t2") == F.col("w.t2")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    joined = docs.alias("d").join(per_doc, same).select("d.text", "w.t1", "w.t2", "w.doc_id", "w.contexts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                listed = batch.column("contexts")
                every = pa.RecordBatch.from_struct_array(listed.flatten())
                rows = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
                for a in range(0, every.num_rows, 4096):
                    flat, row = every.slice(a, 4096), pa.array(rows[a : a + 4096])
                    doc_id, t1, t2 = (batch.column(c).take(row) for c in ("doc_id", "t1", "t2"))
                    owner = pa.StructArray.from_arrays([doc_id.is_null(), doc_id, t1, t2, flat.column("first")], fields=list(_OWNER))
                    cut = [texts[r][f : f + w + length - 1] for r, f, w in zip(row.to_pylist(), flat.column("first").to_pylist(), flat.column("windows").to_pylist())]
                    whole_range = [pa.array(np.full(flat.num_rows, x, np.int32)) for x in (0, length - KGRAM + 1)]
                    columns = [*(flat.column(c) for c in ("anchor", "c1", "c2", "copies")), owner, flat.column("windows"), *whole_range, flat.column("hot"), pa.array(cut, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, "anchor c1 c2 copies owner windows low high hot bytes".split())

    return joined.mapInArrow(run, f"{CONTEXT}, bytes binary")


HALVES = f"anchor long, c1 long, c2 long, copies long, owner {OWNER}, windows int, low int, high int, bytes binary, p1 long, p2 long, skip int"
_HALF = pa.schema(list(zip("anchor c1 c2 copies owner windows low high bytes p1 p2 skip".split(), [*[pa.int64()] * 4, _OWNER, *[pa.int32()] * 3, pa.binary(), pa.int64(), pa.int64(), pa.int32()])))


def _halves(contexts: pa.RecordBatch, length: int) -> list[dict]:
    """Each context in two: the windows that start at least half of the range low..high before the anchor, and the
    others. All windows of a half hold the same middle, so its hash takes the anchor's place. p1, p2 and skip say of
    which context a half is part, and from which window on. A half of one window is grouped with its equals alone."""
    out = []
    for c in contexts.to_pylist():
        data, middle = c["bytes"], (c["low"] + c["high"]) // 2
        hashes = _gram_hashes(np.frombuffer(data[:length], np.uint8))
        at = int((hashes & ~LOW).argmin())
        edge = at - middle  # the last start that is `middle` or more before the anchor
        for first, last, low, high in ((0, min(c["windows"] - 1, edge), middle, c["high"]), (max(0, edge + 1), c["windows"] - 1, c["low"], middle)):
            if first > last:
                continue
            anchor = xxhash.xxh3_64_intdigest(data[at - low : at - high + 1 + length], (c["anchor"] + low * 0x9E3779B97F4A7C15) % (1 << 64))
            part = data[first : last + length]
            digest = _digests([part], [anchor])[0].tolist()
            owner = c["owner"] | {"first": c["owner"]["first"] + first}
            values = (anchor - (1 << 64) if anchor >> 63 else anchor, *digest, c["copies"], owner, last - first + 1, low, high, part, c["c1"], c["c2"], first)
            out.append(dict(zip(_HALF.names, values)))
    return out


#: keeper: the owner in whose text the first copy of the run's windows stands, and its place there; null in other runs.
FOUND = "c1 long, c2 long, start int, n int, keeper struct<doc_id: long, t1: long, t2: long, at: int>"
_KEEPER = pa.struct([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("at", pa.int32())])


def _runs(starts: np.ndarray, kept: np.ndarray | None) -> Iterator[tuple[int, int, bool]]:
    """(start, n, kept) of the runs of consecutive starts that are alike in kept."""
    if len(starts):
        change = np.diff(starts) != 1
        if kept is not None:
            change |= kept[1:] != kept[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), len(starts)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield int(starts[a]), b - a, kept is not None and bool(kept[a])


_FOUND = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("keeper", _KEEPER)])


def _sorted_shards(contexts: DataFrame, n_shards: int, length: int, keep_first: bool) -> DataFrame:
    """run: the runs of repeated windows of each context, by one suffix array for each shard; half: the halves of the
    contexts that are hot, which are dealt out by themselves."""

    def both(run: list[dict], half: list[dict]) -> pa.RecordBatch:
        nulls = lambda rows, other: [*rows, *[None] * other]
        arrays = [pa.array(nulls(run, len(half)), pa.struct(list(_FOUND))), pa.array([None] * len(run) + half, pa.struct(list(_HALF)))]
        return pa.RecordBatch.from_arrays(arrays, ["run", "half"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[bytes, int, dict]] = {}
        for batch in batches:
            hot = batch.filter(batch.column("hot"))
            for at in range(0, hot.num_rows, 1024):
                yield both([], _halves(hot.slice(at, 1024), length))
            batch = batch.filter(pc.invert(batch.column("hot")))
            columns = (batch.column(c).to_pylist() for c in ("c1", "c2", "bytes", "copies"))
            owners = batch.column("owner").to_pylist() if keep_first else [None] * batch.num_rows
            for c1, c2, data, copies, owner in zip(*columns, owners):
                held[c1, c2] = data, copies, owner
        if not held:
            return
        keys = list(held)
        strings, copies, owners = zip(*(held[k] for k in keys))
        held.clear()
        rank = place = None
        if keep_first:
            texts = [(o["unnamed"], o["doc_id"] or 0, o["t1"], o["t2"]) for o in owners]
            order = {t: i for i, t in enumerate(sorted(set(texts)))}
            rank, place = np.array([order[t] for t in texts]), np.array([o["first"] for o in owners])
        found, first = suffix_array.repeated(strings, np.array(copies), length, rank, place)
        out: list[dict] = []
        for k, (c1, c2) in enumerate(keys):
            for start, n, kept in _runs(found[k], first[k] if keep_first else None):
                o = owners[k]
                out.append({"c1": c1, "c2": c2, "start": start, "n": n, "keeper": {"doc_id": o["doc_id"], "t1": o["t1"], "t2": o["t2"], "at": o["first"] + start} if kept else None})
            if len(out) > 1 << 15:
                yield both(out, [])
                out = []
        if out:
            yield both(out, [])

    shard = F.when(F.col("hot"), F.xxhash64("anchor", "c1")).otherwise(F.col("anchor"))
    return contexts.repartition(n_shards, shard).mapInArrow(run, f"run struct<{FOUND}>, half struct<{HALVES}>")


def _repeated(contexts: DataFrame, with_bytes: Callable[[DataFrame], DataFrame], length: int, hot: int, shard_bytes: int, keep_first: bool) -> DataFrame:
    """The runs of repeated windows of contexts; with_bytes adds their bytes."""
    spark = contexts.sparkSession
    hot_anchors = materialize(contexts.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("anchor", F.lit(True).alias("is_hot")), "suffix-hot")
    marked = contexts.join(hot_anchors, "anchor", "left").withColumn("hot", F.coalesce("is_hot", F.lit(False))).drop("is_hot")
    size = contexts.agg(F.coalesce(F.sum(F.col("windows") + (length - 1)), F.lit(0))).first()[0]
    shards = max(shuffle_partitions(spark), blocks_for(size, shard_bytes))
    both = materialize(_sorted_shards(with_bytes(marked), shards, length, keep_first), "suffix-repeated")
    found = both.filter("run IS NOT NULL").select("run.*")
    if not hot_anchors.limit(1).count():
        return found
    # a context comes as often as its owner's row
    halves = both.filter("half IS NOT NULL").select("half.*").dropDuplicates(["p1", "p2", "skip"])
    halves = materialize(halves, "suffix-halves")
    often = materialize(halves.groupBy("anchor").agg(F.sum("copies").alias("n")).filter("n > 1").select("anchor"), "suffix-anchors")
    halves = halves.join(often, "anchor", "left_semi")
    same = [F.first(c).alias(c) for c in ("windows", "low", "high", "bytes")]
    grouped = halves.groupBy("anchor", "c1", "c2").agg(F.sum("copies").alias("copies"), F.min("owner").alias("owner"), *same)
    below = _repeated(materialize(grouped, "suffix-contexts"), lambda some: some, length, hot, shard_bytes, keep_first)
    back = halves.select("c1", "c2", "p1", "p2", "skip").join(below, ["c1", "c2"])
    back = back.select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), (F.col("start") + F.col("skip")).alias("start"), "n", "keeper")
    return found.union(materialize(back, "suffix-repeated-hot"))


def repeated_starts(docs: DataFrame, length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES, keep_first: bool = False) -> DataFrame:
    """(t1, t2, runs) for each content of docs (doc_id, text, t1, t2) that holds repeated windows: arrays of
    (start, n), n windows in a row from byte `start` on; with keep_first also of (kept, doc_id): whether these are the
    first of their equals in the document doc_id of this content."""
    found = materialize(occurrences(docs, length), "suffix-occurrences")
    # as tables, the counts leave their joins free for Spark to split where an anchor holds very many rows
    often = materialize(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "suffix-anchors")
    found = materialize(found.join(often, "anchor", "left_semi"), "suffix-often")
    owner = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t1", "t2", "first")
    contexts = found.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("copies"), F.min(owner).alias("owner"), F.first("windows").alias("windows"))
    contexts = materialize(contexts, "suffix-contexts")
    repeated = _repeated(contexts, lambda some: _cut(some, docs, length), length, hot, shard_bytes, keep_first)
    # every content that holds the context, once
    held = found.select("c1", "c2", "t1", "t2", "first").join(repeated, ["c1", "c2"])
    start = F.col("first") + F.col("start")
    run = [start.alias("start"), "n"]
    if keep_first:
        here = F.col("keeper").isNotNull() & (F.col("keeper.t1") == F.col("t1")) & (F.col("keeper.t2") == F.col("t2")) & (F.col("keeper.at") == start)
        run += [here.alias("kept"), F.when(here, F.col("keeper.doc_id")).alias("doc_id")]
    runs = held.select("t1", "t2", F.struct(*run).alias("run"))
    return materialize(runs.groupBy("t1", "t2").agg(F.collect_set("run").alias("runs")), "suffix-runs")


def removed_spans(runs: list[dict], length: int, doc_id: int | None = None) -> list[tuple[int, int]]:
    """Maximal spans [from, to) that the windows cover, in order; without those that are kept in doc_id."""
    spans: list[list[int]] = []
    gone = (r for r in runs or () if not (r.get("kept") and r["doc_id"] == doc_id))
    for start, end in sorted((r["start"], r["start"] + r["n"] - 1 + length) for r in gone):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return [(a, b) for a, b in spans]


def remove_repeated(docs: DataFrame, length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES, as_text: bool = False, keep_first: bool = False) -> DataFrame:
    """docs (all columns, in a struct `row`) with n_bytes, spans (array of from, to), n_removed and kept: the bytes
    that are left, or (as_text) what they read, without characters of which a byte was removed.

    keep_first: the first of equal strings, in order of doc_id (null last), content and place, is no reason to remove
    anything. So each removed byte stands in a string that also starts at an earlier place. Rows that are repeated in
    doc_id and text are one document in this."""
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", "text", *_key(F.col("text")))
    narrow = keyed.select("doc_id", "text", "t1", "t2")
    runs = repeated_starts(narrow, length, hot, shard_bytes, keep_first)
    joined = keyed.join(runs, ["t1", "t2"], "left").select("row", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = batch.column("row").field("text").cast(pa.binary()).to_pylist()
                names = batch.column("row").field("doc_id").to_pylist()
                spans = [removed_spans(r, length, d) for r, d in zip(batch.column("runs").to_pylist(), names)]
                kept = []
                for text, gone in zip(texts, spans):
                    text, at_ = text or b"", 0
                    parts = []
                    for a, b in gone:
                        parts.append(text[at_:a])
                        at_ = b
                    left = b"".join([*parts, text[at_:]])
                    kept.append(left.decode(errors="ignore") if as_text else left)
                arrays = [batch.column("row"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([[{"from": a, "to": b} for a, b in s] for s in spans], SPANS), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "n_bytes", "spans", "n_removed", "kept"])

    row_type = keyed.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"row {row_type}, n_bytes long, spans array<struct<from: int, to: int>>, n_removed long, kept {'string' if as_text else 'binary'}")


SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def without_repeated(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """docs with the repeated passages cut out of text (keep_first: but for the first of each), and n_chars, where
    there is one, counted anew."""
    cleaned = remove_repeated(docs, length, as_text=True, keep_first=keep_first)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return cleaned.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col(f"row.`{f.name}`") for f in docs.schema])
