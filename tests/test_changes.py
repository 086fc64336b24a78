"""Nested cleaning, dense ids, counted loads, and stored chats that are changed in place."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.operators import chat_store, ingest
from tally.sources.store import Store

FIELDS = "name string, n int, tags array<string>, info map<string,string>, parts array<struct<a:string,b:array<struct<c:string>>>>, deep struct<x:string,y:struct<z:array<string>>>"


def plain(v, t):
    """Without empty texts, lists and records, in one pass from the top."""

    def empty(x, k):
        if isinstance(k, T.StructType):
            return x is not None and all(f is None for f in x)
        return x == "" if isinstance(k, T.StringType) else x is not None and isinstance(k, (T.ArrayType, T.MapType)) and not x

    if v is None:
        return None
    if isinstance(t, T.StructType):
        return tuple(None if empty(x, f.dataType) else plain(x, f.dataType) for x, f in zip(v, t.fields))
    if isinstance(t, T.ArrayType):
        return [plain(x, t.elementType) for x in v if not empty(x, t.elementType)]
    if isinstance(t, T.MapType):
        return {k: plain(x, t.valueType) for k, x in v.items() if not empty(x, t.valueType)}
    return v


def made(r, t):
    if r.random() < 0.15:
        return None
    if isinstance(t, T.StructType):
        return tuple(None if r.random() < 0.3 else made(r, f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return [made(r, t.elementType) for _ in range(r.choice([0, 0, 1, 3]))]
    if isinstance(t, T.MapType):
        return {k: made(r, t.valueType) for k in r.sample("abc", r.choice([0, 1, 3]))}
    return r.choice(["", " ", "x", "yz"]) if isinstance(t, T.StringType) else r.randint(0, 3)


def test_without_empty(spark):
    r, schema = random.Random(5), T._parse_datatype_string(FIELDS)
    rows = [made(r, schema) or tuple([None] * len(schema)) for _ in range(300)]
    df = spark.createDataFrame([(i, row) for i, row in enumerate(rows)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", schema)]))
    got = {x["i"]: x["v"] for x in df.select("i", ingest.without_empty(F.col("v"), schema).alias("v")).collect()}
    bare = lambda v: tuple(map(bare, v)) if isinstance(v, tuple) else [bare(x) for x in v] if isinstance(v, list) else v
    assert {i: bare(v) for i, v in got.items()} == {i: plain(row, schema) for i, row in enumerate(rows)}


def test_dense_ids(spark):
    df = spark.createDataFrame([(i * 7 % 101, f"n{i}") for i in range(101)], "k long, name string").repartition(5)
    ids = ingest.with_dense_ids(df, ["k"], 1000, "id")
    got = sorted((r["k"], r["id"]) for r in ids.collect())
    assert got == [(k, 1001 + k) for k in range(101)]
    assert got == sorted((r["k"], r["id"]) for r in ingest.with_dense_ids(df.repartition(2), ["k"], 1000, "id").collect())
    assert "Window" not in ids._jdf.queryExecution().executedPlan().toString()
    assert ingest.with_dense_ids(df.limit(0), ["k"], 5, "id").count() == 0
    old = spark.createDataFrame([(40, "a"), (7, "b")], "event_id long, name string")
    new = spark.createDataFrame([(1, "c"), (2, "a"), (3, "c"), (4, "d")], "event_id long, name string")
    assert sorted(map(tuple, ingest.events_after(old, new, ["name"], ["name"]).collect())) == [(7, "b"), (40, "a"), (41, "c"), (42, "d")]
    assert ingest.events_after(old.limit(0), new, ["name"], ["name"]).agg(F.max("event_id")).first()[0] == 3


@pytest.mark.parametrize("kind,values", [("wiki", "text string"), ("performances", "points long, items array<string>"), ("info", "m map<string,string>, text string")])
def test_counters_of_loads(spark, tmp_path, kind, values):
    store = Store(spark, f"{tmp_path}/{kind}")
    r = random.Random(kind)
    fields = T._parse_datatype_string(values)
    names = [f.name for f in fields if not isinstance(f.dataType, T.MapType)]  # maps have no equality
    row = lambda k: (k, *[made(random.Random((k * 31 + r.randint(0, 1)) % 97), f.dataType) for f in fields if f.name in names])
    schema = T.StructType([T.StructField("k", T.LongType()), *[f for f in fields if f.name in names]])
    old, new = {k: row(k) for k in range(0, 60)}, {k: row(k) for k in range(30, 80)}
    store.replace({kind: spark.createDataFrame(list(old.values()), schema)})
    got = ingest.load_changes(store, kind, spark.createDataFrame(list(new.values()), schema), ["k"], names)
    same = sum(old[k][1:] == new[k][1:] for k in range(30, 60))
    assert got == {"insert": 20, "update": 30 - same, "same": same, "keep": 30}
    stored = {x["k"]: tuple(x) for x in store.read(kind).collect()}
    assert stored == old | new


def files(folder):
    return {d: sorted(os.listdir(f"{folder}/{d}")) for d in os.listdir(folder) if d.startswith("bucket=")}


def test_changes_touch_few_files(spark, tmp_path):
    sessions, messages = f"{tmp_path}/sessions", f"{tmp_path}/messages"
    rows = spark.range(200).selectExpr("id AS session", "id % 7 AS user_id", "'old' AS title")
    chat_store.write(rows, sessions, "session")
    chat_store.write(spark.range(1000).selectExpr("id % 200 AS session", "id AS turn"), messages, "session")
    before = files(sessions)
    assert len(before) == chat_store.BUCKETS
    titles = spark.createDataFrame([(3, 3, "new"), (5, 0, "not theirs"), (999, 1, "none")], "session long, user_id long, title string")
    assert chat_store.rename(spark, sessions, titles) == 1
    after = files(sessions)
    assert sum(before[b] != after[b] for b in before) == 1  # the others keep their files
    got = {r["session"]: r["title"] for r in chat_store.read(spark, sessions).collect()}
    assert len(got) == 200 and got[3] == "new" and got[5] == "old"
    assert chat_store.delete(spark, [sessions, messages], spark.createDataFrame([(3,), (4,), (999,)], "session long")) == [2, 10]
    assert chat_store.read(spark, sessions).count() == 198 and chat_store.read(spark, messages).filter("session IN (3, 4)").count() == 0
    bucket = chat_store.read(spark, messages).select("session", chat_store._bucket("session")).filter("bucket = 1").select("session").distinct()
    gone = bucket.count()
    assert chat_store.delete(spark, [messages], bucket) == [gone * 5] and "bucket=1" not in files(messages)  # a folder that is left empty goes
    assert chat_store.delete(spark, [messages], bucket.limit(0)) == [0] and chat_store.read(spark, messages).count() == 990 - gone * 5


def test_expiry_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:09:00"), ("b", "2024-01-01 00:04:00"), ("c", "2024-01-01 00:05:00")], "message_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    chat_store.write(rows, f"{tmp_path}/pending", "message_id")
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    assert chat_store.expire(spark, f"{tmp_path}/pending", now) == 1 and chat_store.expire(spark, f"{tmp_path}/pending", now) == 0
    assert {r["message_id"] for r in chat_store.read(spark, f"{tmp_path}/pending").collect()} == {"a", "c"}


def test_containing_equals_brute_force(spark):
    r = random.Random(6)
    text = lambda most: "".join(r.choice("abcé ") for _ in range(r.randint(0, most)))
    parts, wholes = sorted({text(5) for _ in range(150)}), sorted({text(14) for _ in range(150)})
    got = ingest.containing(spark.createDataFrame([(x,) for x in [*parts, None, parts[0]]], "part string"), spark.createDataFrame([(x,) for x in [*wholes, None, wholes[3]]], "whole string"))
    assert sorted(map(tuple, got.collect())) == sorted((p, w) for p in parts for w in wholes if p in w)
    names = spark.createDataFrame([("Colla Vella",), ("Vella",), ("la Colla Vella dels Xiquets",), ("zz",), (None,)], "raw string")
    groups = spark.createDataFrame([(2, "Colla Vella"), (1, "Colla Vella dels X"), (5, "Colla")], "group_id long, group_name string")
    aliases = spark.createDataFrame([], "alias string, group_name string")
    resolved = ingest.resolve_names(names, groups, aliases)
    assert {tuple(x) for x in resolved.collect()} == {("Colla Vella", 2, 1), ("Vella", 1, 3), ("la Colla Vella dels Xiquets", 1, 4), ("zz", None, None), (None, None, None)}
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
