"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector x with K functions floor((a . x + b) / w), a from the normal (2-stable) distribution, and
the K numbers name its bucket. Several tables index every row. A query visits, in each table, its own bucket and
perturbed ones, in which some functions are one step up or down. The visits are in order of estimated success:
the sum of the squared distances from the query's projections to the borders that a perturbation crosses, least
first, generated by a heap of perturbation sets. The tables' candidates are merged, and ranked by the exact
inner product in double precision on the original vectors.

The largest inner product becomes a least distance by one more component: rows are scaled into the unit ball by
the largest norm and completed to norm 1, queries are scaled to norm 1 and get 0.

How many tables, functions and probes, and how wide the slots are, follows from the table: on a sample of at most
FIT_QUERIES queries, whose true neighbours one pass over all rows gives, and of at most FIT_ROWS rows, each of the
CHOICES is tried; of those whose probes meet TARGET of the neighbours, the one that costs least is taken, a visited
row and a probe being weighed by what they take. More rows make more functions worth their probes.

The index is shuffled to shards by (table, bucket), as many as it has `shard_rows`; a bucket of more than `block`
rows is split into blocks, each visited by all probes of the bucket. Probes travel as numbers, and a query's vector
once to each shard that its probes name. A task holds the rows of one shard, passes its queries by in batches,
and keeps `k` rows for each. Queries for which fewer than k candidates were found visit all shards of one table.

Vectors that are null, empty or zero, or hold a null or a number that is not finite, take no part; nor do null ids.
Vectors of different lengths have no inner product: each length is searched by itself, with parameters of its own, so a
query meets the rows of its own length. Rows repeated in id and vector count once; ties in score go to the smaller
id. An empty table, or one with no queries, gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import blocks_for, materialize

BLOCK = 8192
SHARD_ROWS = 16384
SEED = 11
#: A function's number is within -16 and 15 and takes five bits of the bucket.
BITS = 5
#: Tables, functions, width of a slot, most probes of a table.
CHOICES = ((2, 4, 2.5, 81), (2, 6, 2.5, 320), (2, 8, 2.0, 960), (3, 10, 2.0, 1600), (4, 12, 2.0, 2400))
FIT_QUERIES = 32
FIT_ROWS = 2048
#: The share of the sampled neighbours that the probes must meet: 0.9 is wanted, the rest is room for the sample's error.
TARGET = 0.95
#: What a probe takes, in visited rows.
PROBE_COST = 20


class Hashes:
    """The functions of all tables, for vectors of so many components."""

    def __init__(self, size: int, tables: int, functions: int, width: float, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.tables, self.functions = tables, functions
        self.a = rng.normal(size=(tables, functions, size + 1)) / width
        self.b = rng.uniform(size=(tables, functions))

    def project(self, rows: np.ndarray) -> np.ndarray:
        """(rows, tables, functions): where the rows stand, in widths."""
        return np.einsum("rd,tfd->rtf", rows, self.a, optimize=True) + self.b

    @staticmethod
    def bucket(numbers: np.ndarray) -> np.ndarray:
        half = 1 << (BITS - 1)
        digits = np.clip(numbers, -half, half - 1).astype(np.int64) + half
        return (digits << (BITS * np.arange(numbers.shape[-1]))).sum(axis=-1)


def perturbations(within: np.ndarray, most: int) -> list[np.ndarray]:
    """Steps (-1, 0, 1 for each function) in ascending order of the summed squared distances to the borders they
    cross; within: where a query stands in its slots, from 0 to 1. The first is no step at all."""
    n = len(within)
    costs = np.concatenate([within**2, (1 - within) ** 2])
    order = np.argsort(costs, kind="stable")
    sorted_costs = costs[order]
    found = [np.zeros(n, np.int64)]
    heap = [(float(sorted_costs[0]), (0,))]
    while heap and len(found) < most:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * n:
            step = float(sorted_costs[last + 1])
            heapq.heappush(heap, (cost - float(sorted_costs[last]) + step, (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + step, (*chosen, last + 1)))
        picks = order[list(chosen)]
        if len(set((picks % n).tolist())) == len(picks):  # not both ways at once
            steps = np.zeros(n, np.int64)
            steps[picks % n] = np.where(picks < n, -1, 1)
            found.append(steps)
    return found


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec, norm) of the vectors that take part, whatever their length."""
    vec = F.col(vector_col).cast("array<double>")
    good = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x))
    named = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    return named.filter(good).withColumn("norm", norm).filter("norm > 0").dropDuplicates(["id", "vec"])


def _index(rows: DataFrame, hashes: Hashes, size: int, longest: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = hashes.bucket(np.floor(hashes.project(_completed(_matrix(batch.column("vec"), size), longest))))
            for t in range(hashes.tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(buckets[:, t]), batch.column("id"), batch.column("vec")], ["tbl", "bucket", "id", "vec"])

    return rows.select("id", "vec").mapInArrow(run, "tbl int, bucket long, id long, vec array<double>")


def _probes(queries: DataFrame, hashes: Hashes, size: int, most: int) -> DataFrame:
    """(tbl, bucket, id): the buckets that each query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                buckets = probed(_matrix(batch.column("vec"), size), hashes, most)
                for t in range(hashes.tables):
                    which = np.repeat(np.arange(batch.num_rows), [len(b[t]) for b in buckets])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), t, np.int32)), pa.array(np.concatenate([b[t] for b in buckets])), batch.column("id").take(pa.array(which))], ["tbl", "bucket", "id"])

    return queries.select("id", "vec").mapInArrow(run, "tbl int, bucket long, id long")


def probed(vecs: np.ndarray, hashes: Hashes, most: int) -> list[list[np.ndarray]]:
    """For each query, by table, the buckets that it visits, in order."""
    scaled = vecs / np.sqrt((vecs**2).sum(axis=1))[:, None]
    stands = hashes.project(np.column_stack([scaled, np.zeros(len(scaled))]))
    slots = np.floor(stands)
    steps = lambda q, t: np.array(perturbations(stands[q, t] - slots[q, t], most))
    return [[hashes.bucket(slots[q, t] + steps(q, t)) for t in range(hashes.tables)] for q in range(len(vecs))]


def _completed(vecs: np.ndarray, longest: float) -> np.ndarray:
    """Rows scaled into the unit ball, with the component that completes them to norm 1."""
    scaled = vecs / longest
    return np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))])


def choose(queries: np.ndarray, near: list[np.ndarray], rows: np.ndarray, longest: float, n_rows: int, choices=CHOICES) -> tuple[int, int, float, int]:
    """(tables, functions, width, probes): the cheapest of the choices whose probes meet TARGET of `near`, the true
    neighbours of each sampled query; the cost is in rows that a query visits, by the sampled rows. If none of them
    does, the one that meets most."""
    found = []
    for tables, functions, width, most in choices:
        # more probes than this would cost more than what is found already
        least = min([n_rows, *(cost for missed, _, cost, _ in found if not missed)])
        most = min(most, max(CHOICES[0][3], int(least / (PROBE_COST * tables))))
        hashes = Hashes(queries.shape[1], tables, functions, width)
        name = lambda vecs, h=hashes: h.bucket(np.floor(h.project(_completed(vecs, longest))))
        buckets = name(rows)
        met, seen = [], []
        for visits, true in zip(probed(queries, hashes, most), near):
            places = [{b: i for i, b in reversed(list(enumerate(v.tolist())))} for v in visits]
            first = lambda of, places=places, most=most: [min(p.get(int(x), most) for p, x in zip(places, row)) for row in of]
            met += first(name(true))
            seen += first(buckets)
        met, seen = np.sort(met), np.sort(seen)
        wanted = int(np.ceil(TARGET * len(met)))
        probes = min(most, int(met[wanted - 1]) + 1)
        share = np.searchsorted(met, probes) / len(met)
        cost = np.searchsorted(seen, probes) / len(seen) * n_rows + PROBE_COST * tables * probes
        found.append((share < TARGET, -share if share < TARGET else 0.0, cost, (tables, functions, width, probes)))
    return min(found)[-1]


def fit(rows: DataFrame, queries: DataFrame, size: int, longest: float, k: int) -> tuple[int, int, float, int]:
    """choose() on bounded samples by hashes of ids, which are the same on every run."""
    by_hash = lambda df, n: df.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(n).collect()
    asked = by_hash(queries, FIT_QUERIES)
    if not asked:
        return CHOICES[0]
    ids, vecs = np.array([r["id"] for r in asked]), np.array([r["vec"] for r in asked])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, size))
        for batch in batches:
            own, own_ids = _matrix(batch.column("vec"), size), batch.column("id").to_numpy()
            query, near, score = nearest_in_block(ids, vecs, own_ids, own, k)
            place = np.argsort(own_ids, kind="stable")
            at = place[np.searchsorted(own_ids, near, sorter=place)]
            held = tuple(np.concatenate([a, b]) for a, b in zip(held, (query, near, score, own[at])))
            keep = _best(held[0], held[1], held[2], k)
            held = tuple(x[keep] for x in held)
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(held[2]), pa.array(list(held[3]), pa.list_(pa.float64()))], ["query", "id", "score", "vec"])

    found = rows.select("id", "vec").mapInArrow(scan, "query long, id long, score double, vec array<double>")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    true = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).collect()  # FIT_QUERIES * k rows
    near = [np.array([r["vec"] for r in true if r["query"] == i]).reshape(-1, size) for i in ids.tolist()]
    if not any(map(len, near)):
        return CHOICES[0]
    return choose(vecs, near, np.array([r["vec"] for r in by_hash(rows, FIT_ROWS)]), longest, rows.count())


def _best(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best of each query, each candidate once, in order of query, score and id."""
    order = np.lexsort((found, -score, query))
    q, f, s = query[order], found[order], score[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    order, q = order[once], q[once]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[rank < k]


def nearest_in_block(q_ids: np.ndarray, q_vecs: np.ndarray, ids: np.ndarray, vecs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): for each query the k rows of the block of largest inner product, and those tied."""
    found = []
    for at in range(0, len(q_ids), max(1, (1 << 21) // max(1, len(ids)))):
        qs, qi = q_vecs[at : at + max(1, (1 << 21) // max(1, len(ids)))], q_ids[at : at + max(1, (1 << 21) // max(1, len(ids)))]
        rough = qs @ vecs.T
        rough[qi[:, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
            # products of one pair may differ in the last bits by its place in the matrix
            i, j = np.nonzero(rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
        else:
            i, j = np.nonzero(rough > -np.inf)
        real = rough[i, j] > -np.inf
        i, j = i[real], j[real]
        exact = (qs[i] * vecs[j]).sum(axis=1)
        found.append((qi[i], ids[j], exact))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    query, near, score = (np.concatenate(x) for x in zip(*found))
    keep = _best(query, near, score, k)
    return query[keep], near[keep], score[keep]


def _visit(members: DataFrame, visits: DataFrame, size: int, k: int, shards: int) -> DataFrame:
    """(query, id, score): for each query and shard the k best rows of what it visits. members: shard, tbl, bucket,
    block, id, vec; visits: shard, id, vec and `seen`, the (tbl, bucket, block) that it visits there; null: table 0."""
    kind = "array<struct<tbl: int, bucket: bigint, block: int>>"
    one = F.array(F.struct("tbl", "bucket", "block")).cast(kind)
    both = members.select("shard", F.lit(True).alias("member"), "id", "vec", one.alias("seen")).union(visits.select("shard", F.lit(False).alias("member"), "id", "vec", F.col("seen").cast(kind)))
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", F.col("member").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, table = None, [], None

        def indexed() -> tuple:
            """The rows in order of their places, the places, where each begins, and how many are of the first table."""
            ids, vecs, places = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort(places.T[::-1])
            ids, vecs, places = ids[order], vecs[order], places[order]
            starts = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]).any(axis=1)])
            names = {tuple(p): i for i, p in enumerate(places[starts].tolist())}
            return ids, vecs, names, np.r_[starts, len(ids)], int((places[starts, 0] == 0).sum())

        for whole in batches:
            shards_, is_member = whole.column("shard").to_numpy(), whole.column("member").to_numpy(zero_copy_only=False)
            change = (shards_[1:] != shards_[:-1]) | (is_member[1:] != is_member[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), whole.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if x == y:
                    continue
                batch = whole.slice(x, y - x)
                if shards_[x] != shard:
                    shard, held, table = shards_[x], [], None
                ids, vecs, seen = batch.column("id").to_numpy(), _matrix(batch.column("vec"), size), batch.column("seen")
                if is_member[x]:
                    flat = seen.flatten()
                    held.append((ids, vecs, np.column_stack([flat.field(c).to_numpy().astype(np.int64) for c in ("tbl", "bucket", "block")])))
                    continue
                if not held:
                    continue
                table = table or indexed()
                own_ids, own_vecs, names, starts, of_first = table
                by_place: dict[int, list[int]] = {}
                for q, places in enumerate(seen.to_pylist()):
                    numbers = range(of_first) if places is None else [names.get((p["tbl"], p["bucket"], p["block"])) for p in places]
                    for i in numbers:
                        if i is not None:
                            by_place.setdefault(i, []).append(q)
                found, n_found = [], 0
                for i, who in by_place.items():
                    a, b = starts[i], starts[i + 1]
                    found.append(nearest_in_block(ids[who], vecs[who], own_ids[a:b], own_vecs[a:b], k))
                    n_found += len(found[-1][0])
                    if n_found > 1 << 20:
                        found = [_merged(found, k)]
                        n_found = len(found[0][0])
                if found:
                    yield pa.RecordBatch.from_pydict(dict(zip(("query", "id", "score"), map(pa.array, _merged(found, k)))))

    return dealt.mapInArrow(run, "query long, id long, score double")


def _merged(found: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    query, near, score = (np.concatenate(x) for x in zip(*found))
    keep = _best(query, near, score, k)
    return query[keep], near[keep], score[keep]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", parameters: tuple[int, int, float, int] | None = None, block: int = BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row for which is_query, a condition on `id`, holds.
    parameters: (tables, functions, width, probes); by default what fit() chooses."""
    spark = vectors.sparkSession
    all_rows = materialize(valid(vectors, id_col, vector_col), "ann-vectors")
    asks = F.count_if(is_query).alias("asks")
    # one row for each length of a vector
    lengths = all_rows.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n"), F.max("norm").alias("longest"), asks).filter("asks > 0").collect()
    found = [_of_length(all_rows.filter(F.size("vec") == x["size"]), is_query, x["size"], x["n"], x["longest"], k, parameters, block, shard_rows) for x in lengths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query", "size").orderBy(F.desc("score"), "id")
    ranked = reduce(DataFrame.union, found).distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _of_length(rows: DataFrame, is_query: Column, size: int, n: int, longest: float, k: int, parameters: tuple[int, int, float, int] | None, block: int, shard_rows: int) -> DataFrame:
    """(query, id, score, size): the best rows found for each query, k or more unless there are fewer; rows are n vectors of one length."""
    queries = rows.filter(is_query)
    tables, functions, width, probes = parameters or fit(rows, queries, size, longest, k)
    hashes = Hashes(size, tables, functions, width)
    index = _index(rows, hashes, size, longest)
    directory = materialize(index.groupBy("tbl", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "ann-buckets")
    shards = blocks_for(n * tables, shard_rows)
    shard = F.pmod(F.xxhash64("tbl", "bucket", "block"), F.lit(shards)).cast("int").alias("shard")
    members = index.join(directory, ["tbl", "bucket"]).select("tbl", "bucket", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "vec").select(shard, "*")
    visits = _probes(queries, hashes, size, probes).join(directory, ["tbl", "bucket"]).select("id", "tbl", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    per_shard = visits.select(shard, "id", F.struct("tbl", "bucket", "block").alias("place")).groupBy("shard", "id").agg(F.collect_list("place").alias("seen"))
    asked = per_shard.join(queries.select("id", "vec"), "id").select("shard", "id", "vec", "seen")
    found = materialize(_visit(members, asked, size, k, shards), "ann-found")
    enough = found.groupBy("query").agg(F.count_distinct("id").alias("n")).filter(F.col("n") >= k)
    short = queries.join(enough, queries.id == enough["query"], "left_anti")
    if short.limit(1).count():
        # fewer than k found: a visit to the first table's part of every shard meets all rows
        every = short.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "vec", F.lit(None).alias("seen"))
        found = found.union(_visit(members, every, size, k, shards))
    return found.withColumn("size", F.lit(size))
