"""Stored tables and the stored inverted file."""

import os

import pytest
from pyspark.sql import functions as F

from tally.operators import retrieval, vector_store
from tally.registry import retrieval as registered
from tally.sources.store import Store, copied


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/store")


def broken(spark):
    return spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))


def test_a_write_that_fails_halfway_changes_nothing(spark, store):
    store.replace({"a": spark.range(3), "b": spark.range(4)})
    with pytest.raises(Exception, match="broken"):
        store.replace({"a": spark.range(9), "b": broken(spark)})
    assert ids(store.read("a")) == [0, 1, 2] and ids(store.read("b")) == [0, 1, 2, 3] and store.version() == 1
    store.replace({"a": store.read("a").selectExpr("id + 10 AS id")})  # read from and written to the same store
    assert ids(store.read("a")) == [10, 11, 12] and ids(store.read("a", version=1)) == [0, 1, 2]
    assert store.vacuum() == 3 and ids(store.read("b")) == [0, 1, 2, 3]  # both parts of the failed write, and the first a


def test_a_load_goes_on_where_it_stopped(spark, store):
    asked = []

    def batch(name, rows):
        def read():
            asked.append(name)
            return rows

        return read

    bad = {"1": batch("1", spark.range(2)), "2": batch("2", broken(spark)), "3": batch("3", spark.range(4, 6))}
    with pytest.raises(Exception, match="broken"):
        store.load("t", bad)
    assert ids(store.read("t")) == [0, 1] and store.batches("t") == {"1"}
    assert store.load("t", bad | {"2": batch("2", spark.range(2, 4))}) == ["2", "3"]
    assert ids(store.read("t")) == [0, 1, 2, 3, 4, 5] and asked == ["1", "2", "2", "3"]
    assert not store.append("t", spark.range(7), batch="3") and store.append("t", spark.range(6, 7))
    assert ids(store.read("t")) == list(range(7))


def test_of_two_writers_one_is_told(spark, store):
    store.replace({"a": spark.range(1)})
    version, tables = store.version(), store.manifest()
    store.append("a", spark.range(1, 2))
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(version, tables)
    assert ids(store.read("a")) == [0, 1]
    assert not [f for f in os.listdir(f"{store.folder.removeprefix('file:')}/manifests") if f.startswith(".new")]


def test_empty_tables_keep_their_columns(spark, store, tmp_path):
    rows = spark.range(6).selectExpr("id", "id % 2 AS part", "NULL AS nothing").withColumn("nothing", F.lit(None).cast("string"))
    store.replace({"a": rows}, {"a": ("part",)})
    store.truncate(["a"])
    assert store.read("a").columns == rows.columns and store.read("a").count() == 0
    store.append("a", rows, partition_by=("part",))
    assert store.read("a").count() == 6 and store.read("a").dtypes == rows.dtypes
    other = Store(spark, f"{tmp_path}/other")
    assert [tuple(r) for r in copied(store, other).collect()] == [("a", 6, 6, True)]
    other.drop(["a"])
    assert other.names() == [] and other.counts().count() == 0
    assert Store(spark, f"{tmp_path}/none").manifest() == {} and Store(spark, f"{tmp_path}/none").vacuum() == 0


def test_inverted_file(spark, data, store):
    """Recall with fewer lists than all, rows that come later, and a scan that reads the visited lists only."""
    vectors = registered._vectors(spark, data)
    queries = vectors.filter("id % 50 = 0").selectExpr("id AS query_id", "vec AS qvec")
    found = lambda df: {(r["query_id"], r["id"]) for r in df.collect()}
    want = found(retrieval.top_k(vectors, queries, 10))
    got = found(registered.QUERIES["vector_ivf"](spark, data))
    assert {q for q, _ in got} == {r["query_id"] for r in queries.collect()} and registered.PROBES < vector_store.LISTS
    assert len(want & got) >= 0.9 * len(want)

    first = vectors.filter("id % 3 > 0").withColumn("note", F.concat(F.lit("n"), "id"))
    vector_store.create(store, "v", first.unionByName(spark.createDataFrame([(-1, [0.0] * 64, "zero"), (-2, None, None)], "id long, vec array<double>, note string").withColumn("vec", F.col("vec").cast(first.schema["vec"].dataType))), lists=10)
    centres = store.read("v_centres").collect()
    assert vector_store.append(store, "v", vectors.filter("id % 3 = 0").withColumn("note", F.lit(None).cast("string")), "late")
    assert not vector_store.append(store, "v", vectors.withColumn("note", F.lit("again")), "late")
    assert store.read("v_centres").collect() == centres and ids(store.read("v")) == ids(vectors)
    assert found(vector_store.search(store, "v", queries, 10, probes=10)) == want  # all lists
    few = vector_store.search(store, "v", queries.limit(1), 60, probes=1)
    assert few.count() == 60  # lists go on until there are enough rows
    one = vector_store.search(store, "v", queries.limit(1), 3, probes=1)
    plan = one._jdf.queryExecution().toString()
    assert any("list#" in filters.split("]")[0] for filters in plan.split("PartitionFilters: [")[1:])
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert one.count() == 3
