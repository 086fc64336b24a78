"""A stored inverted file of vectors: rows lie in folders by their list, the centres and sizes of the lists beside them.

Centres are fitted once, on a bounded sample; rows that come later go to the list of their nearest centre. A search looks for
the lists of its queries first, and the scan reads only those folders. Vectors and queries then meet in blocks, list by list, each pair
of blocks by one product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.operators.retrieval import BLOCK_ROWS, best_of_blocks
from tally.sources.store import Store

LISTS = 50
#: Rows that the centres are fitted on, about: those whose ids have the least hashes.
SAMPLE = 50_000
SEED, ITERATIONS = 7, 10
_HASHES = 1 << 30


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _nearest(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances but for the vectors' own length, which is the same for all centres."""
    return (centres * centres).sum(axis=1) - 2 * (units @ centres.T)


def _with_unit(rows: DataFrame) -> DataFrame:
    """Rows that have a vector with a length, which `unit` is brought to one by."""
    vec = F.transform("vec", lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    good = rows.filter("vec IS NOT NULL").withColumn("unit_length", length).filter("unit_length > 0 AND unit_length < double('infinity')")
    return good.withColumn("unit", F.transform(vec, lambda x: x / F.col("unit_length"))).drop("unit_length")


def _fit(rows: DataFrame, lists: int) -> list[list[float]]:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = rows.count()
    share = min(_HASHES, _HASHES * SAMPLE // max(n, 1))
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(_HASHES)) < share).select(array_to_vector("unit").alias("features"))
    model = KMeans(k=lists, seed=SEED, maxIter=ITERATIONS).fit(sample)
    return [[float(x) for x in c] for c in model.clusterCenters()]


def _listed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows with the list of their nearest centre. There are as many centres as lists, a parameter."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearest(_matrix(batch.column("unit"), batch.num_rows), shared.value).argmin(axis=1) if batch.num_rows else np.zeros(0)
            yield batch.append_column("list", pa.array(near.astype(np.int32)))

    return rows.mapInArrow(assign, rows.withColumn("list", F.lit(None).cast("int")).schema)


def _centres(store: Store, name: str) -> np.ndarray:
    return np.array([r["centre"] for r in store.read(f"{name}_centres").orderBy("list").collect()])


def _parts(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges, so that a list of any size is a few files of about equal size
    return _listed(_with_unit(rows), centres).drop("unit").repartitionByRange(spread, "list", "id")


def create(store: Store, name: str, rows: DataFrame, lists: int = LISTS) -> None:
    """The file under `name`, in place of what is there: rows (id, vec, and what is to be kept beside). Rows without a vector, or
    with one of length zero, are left out."""
    centres = _fit(_with_unit(rows.select("id", "vec")), lists)
    beside = rows.sparkSession.createDataFrame(list(enumerate(centres)), "list int, centre array<double>")
    store.replace({name: _parts(rows, np.array(centres)), f"{name}_centres": beside}, {name: ("list",)})


def append(store: Store, name: str, rows: DataFrame, batch: str | None = None) -> bool:
    """Further rows, put to the lists that are there; a batch that is there already is passed over, and False."""
    return store.append(name, _parts(rows, _centres(store, name)), batch, ("list",))


def _visits(queries: DataFrame, centres: np.ndarray, sizes: np.ndarray, k: int, probes: int) -> DataFrame:
    """(list, id, unit): the lists that each query visits, the nearest `probes`, and more as long as they hold fewer than k rows."""
    shared = queries.sparkSession.sparkContext.broadcast((centres, sizes))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sizes = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            order = _nearest(_matrix(batch.column("unit"), batch.num_rows), centres).argsort(axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1) - sizes[order]
            row, place = np.nonzero((np.arange(len(centres)) < probes) | (held < k))
            yield pa.RecordBatch.from_arrays([pa.array(order[row, place].astype(np.int32)), batch.column("id").take(pa.array(row)), batch.column("unit").take(pa.array(row))], ["list", "id", "unit"])

    return _with_unit(queries.select(F.col("query_id").cast("long").alias("id"), F.col("qvec").alias("vec"))).select("id", "unit").mapInArrow(visit, "list int, id long, unit array<double>")


def _blocks(rows: DataFrame) -> DataFrame:
    """(list, ids, units): rows (list, id, unit) of one list, BLOCK_ROWS at most, as they come together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids, units = np.asarray(batch.column("list")), np.asarray(batch.column("id")).astype(np.int64), _matrix(batch.column("unit"), batch.num_rows) if batch.num_rows else None
            for one in np.unique(lists).tolist():
                at = np.flatnonzero(lists == one)
                for i in range(0, len(at), BLOCK_ROWS):
                    part = at[i : i + BLOCK_ROWS]
                    yield pa.RecordBatch.from_pydict({"list": pa.array([one], pa.int32()), "ids": [ids[part].tobytes()], "units": [units[part].tobytes()]})

    return rows.select("list", "id", "unit").mapInArrow(pack, "list int, ids binary, units binary")


def search(store: Store, name: str, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, rank, id, score): of the lists nearest to each query (query_id, qvec) the k vectors of largest cosine, ties by id."""
    stored, centres = store.read(name), _centres(store, name)
    sizes = np.zeros(len(centres), np.int64)
    for r in stored.groupBy("list").agg(F.count("*").alias("n")).collect():  # one row for each list; a scan of no column
        sizes[r["list"]] = r["n"]
    visits = _visits(queries, centres, sizes, k, probes)
    wanted = sorted(r["list"] for r in visits.select("list").distinct().collect())  # lists at most
    rows = stored if len(wanted) == len(centres) else stored.filter(F.col("list").isin(wanted))
    asked = _blocks(visits).select("list", F.col("ids").alias("q_ids"), F.col("units").alias("q_units"))
    pairs = _blocks(_with_unit(rows.select("list", "id", "vec"))).join(asked, "list")
    found = pairs.select("ids", "units", "q_ids", "q_units").mapInArrow(best_of_blocks(k), "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", F.round("score", 6).alias("score"))
