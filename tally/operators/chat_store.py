"""Stored chat tables that are changed in place: only the folders of rows that a change touches are written anew.

Rows lie in BUCKETS folders by a hash of their key. A change works out which buckets its keys are in, reads those, and puts the new rows in
their place; the files of all others stay as they are. The new rows are written aside first, so that a job that fails while it works
them out changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.sources.scratch import materialize

BUCKETS = 32


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def write(rows: DataFrame, folder: str, key: str) -> None:
    """The table (without a column `bucket`), by buckets of its key."""
    dealt = rows.select("*", _bucket(key))
    dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("bucket")


def change(spark: SparkSession, folder: str, keys: DataFrame, key: str, hit: Column, update: Callable[[DataFrame], DataFrame]) -> int:
    """Puts update(rows) in place of the rows of the buckets that hold keys. The rows that update gets have the columns of keys
    beside them, null where there is none. Gives how many rows `hit` is true for."""
    buckets = sorted(r["bucket"] for r in keys.select(_bucket(key)).distinct().collect())  # BUCKETS at most
    if not buckets:
        return 0
    stored = spark.read.parquet(folder)
    near = materialize(stored.filter(F.col("bucket").isin(buckets)).join(keys.dropDuplicates([key]), key, "left").withColumn("__hit", F.coalesce(hit, F.lit(False))), "chat-change")
    n = near.filter("__hit").count()
    if not n:
        return 0
    touched = sorted(r["bucket"] for r in near.filter("__hit").select("bucket").distinct().collect())
    rows = materialize(update(near.filter(F.col("bucket").isin(touched))).select(*stored.columns), "chat-rows")
    left = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    for bucket in touched:
        if bucket not in left:  # nothing was written there
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket={bucket}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def rename(spark: SparkSession, sessions: str, titles: DataFrame) -> int:
    """Gives stored sessions new titles (session, user_id, title), if they are the user's; how many there were."""
    mine = F.col("__user") == F.col("user_id")
    new = titles.select("session", F.col("user_id").alias("__user"), F.col("title").alias("__title"))
    return change(spark, sessions, new, "session", mine, lambda rows: rows.withColumn("title", F.when(F.col("__hit"), F.col("__title")).otherwise(F.col("title"))))


def delete(spark: SparkSession, folders: list[str], gone: DataFrame) -> list[int]:
    """Deletes sessions (session) from stored tables, those of messages and that of sessions; how many rows went from each."""
    keys = gone.select("session").withColumn("__gone", F.lit(True))
    return [change(spark, f, keys, "session", F.col("__gone"), lambda rows: rows.filter("NOT __hit")) for f in folders]


def expire(spark: SparkSession, pending: str, now: Column, minutes: int = 5) -> int:
    """Deletes stored messages (message_id, ts) whose last update is older than the time to live; how many rows went."""
    last = read(spark, pending).groupBy("message_id").agg(F.max("ts").alias("__last"))
    old = last.filter(F.col("__last") < now - F.expr(f"interval {minutes} minutes"))
    return change(spark, pending, old, "message_id", F.col("__last").isNotNull(), lambda rows: rows.filter("NOT __hit"))
