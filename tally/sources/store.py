"""Stored tables whose changes are seen all at once or not at all.

A store is a folder. Every write goes to folders of its own first; then a manifest, a small file that lists the folders of each
table, is put in place by one rename, and what it says is the store. A write that fails halfway leaves folders that no manifest
names, and the tables as they were. Loads in batches put one manifest in place for each batch, under the batch's name; a load
that is run again passes over the batches that are there. Two writers at once: the rename of the second finds its number taken,
and is an error.

The rename must not replace a file that is there: so it is on HDFS and on local disks. Manifests are as large as the list of
folders, not as the tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The manifest's file names: numbers of so many digits.
DIGITS = 12


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.spark, self.fs = spark, path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = path.makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()).toString().rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def version(self) -> int:
        """The number of the manifest in force, 0 if there is none."""
        manifests = self._path("manifests")
        if not self.fs.exists(manifests):
            return 0
        return max((int(f.getPath().getName()) for f in self.fs.listStatus(manifests) if f.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[dict]]:
        """For each table its parts, each with a folder, a schema, and the batch that it came with, None for none."""
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.folder}/manifests/{version:0{DIGITS}d}", wholetext=True).first()
        return json.loads(text["value"])

    def _commit(self, version: int, tables: dict[str, list[dict]]) -> None:
        """Puts the manifest after `version` in place."""
        new, place = self._path(f"manifests/.new-{uuid.uuid4().hex}"), self._path(f"manifests/{version + 1:0{DIGITS}d}")
        out = self.fs.create(new, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        if self.fs.exists(place) or not self.fs.rename(new, place):
            self.fs.delete(new, False)
            raise RuntimeError(f"another writer has put manifest {version + 1} of {self.folder} in place")

    def _stage(self, name: str, rows: DataFrame, partition_by: tuple[str, ...] = (), batch: str | None = None) -> dict:
        """A part, written, and not yet in any manifest."""
        folder = f"parts/{name}-{uuid.uuid4().hex}"
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.folder}/{folder}")
        return {"folder": folder, "batch": batch, "schema": rows.schema.jsonValue()}

    def names(self) -> list[str]:
        return sorted(self.manifest())

    def batches(self, name: str) -> set[str]:
        return {p["batch"] for p in self.manifest().get(name, []) if p["batch"] is not None}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table, of all its parts. A table that was emptied keeps its columns."""
        parts = self.manifest(version)[name]
        # each part has its own root, so that the folders of partitions are columns, and its schema, so that it may be empty
        frames = [self._part(p) for p in parts]
        return reduce(DataFrame.unionByName, frames)

    def _part(self, part: dict) -> DataFrame:
        schema = T.StructType.fromJson(part["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part['folder']}").select(*schema.names)

    def replace(self, tables: dict[str, DataFrame], partition_by: dict[str, tuple[str, ...]] | None = None) -> None:
        """All the tables given take the place of what is stored under their names, at once; other tables stay. They may be
        read from this store."""
        version = self.version()
        staged = {n: [self._stage(n, df, (partition_by or {}).get(n, ()))] for n, df in tables.items()}
        self._commit(version, self.manifest(version) | staged)

    def append(self, name: str, rows: DataFrame, batch: str | None = None, partition_by: tuple[str, ...] = ()) -> bool:
        """rows as a further part of the table; a batch that is there already is passed over, and False."""
        version = self.version()
        tables = self.manifest(version)
        if batch is not None and any(p["batch"] == batch for p in tables.get(name, [])):
            return False
        self._commit(version, tables | {name: [*tables.get(name, []), self._stage(name, rows, partition_by, batch)]})
        return True

    def load(self, name: str, batches: dict[str, Callable[[], DataFrame]], partition_by: tuple[str, ...] = ()) -> list[str]:
        """Appends batches in order of their names, each committed for itself; gives the names of those that were not there. Batches
        are read when their turn comes, each from its own files."""
        there = self.batches(name)
        return [b for b in sorted(batches) if b not in there and self.append(name, batches[b](), b, partition_by)]

    def truncate(self, names: list[str]) -> None:
        """Empties tables, at once; their columns stay."""
        self.replace({n: self.read(n).limit(0) for n in names})

    def drop(self, names: list[str]) -> None:
        version = self.version()
        self._commit(version, {n: p for n, p in self.manifest(version).items() if n not in names})

    def vacuum(self) -> int:
        """Deletes the parts that the manifest in force does not name, and older manifests; gives how many parts went. Nothing may
        be writing or reading older versions meanwhile."""
        version = self.version()
        kept = {p["folder"].rpartition("/")[2] for parts in self.manifest(version).values() for p in parts}
        gone = 0
        if self.fs.exists(self._path("parts")):
            for f in self.fs.listStatus(self._path("parts")):
                if f.getPath().getName() not in kept:
                    self.fs.delete(f.getPath(), True)
                    gone += 1
        for f in self.fs.listStatus(self._path("manifests")) if version else []:
            if f.getPath().getName() != f"{version:0{DIGITS}d}":
                self.fs.delete(f.getPath(), False)
        return gone

    def counts(self, names: list[str] | None = None) -> DataFrame:
        """(table, rows)."""
        spark, out = self.spark, None
        for n in self.names() if names is None else names:
            one = self.read(n).agg(F.lit(n).alias("table"), F.count("*").alias("rows"))
            out = one if out is None else out.union(one)
        return spark.createDataFrame([], "table string, rows long") if out is None else out


def copied(source: Store, target: Store, names: list[str] | None = None) -> DataFrame:
    """Copies tables to another store, all at once, and compares the counts of both: (table, source_rows, target_rows, equal)."""
    names = source.names() if names is None else names
    target.replace({n: source.read(n) for n in names})
    left, right = source.counts(names), target.counts(names)
    both = left.withColumnRenamed("rows", "source_rows").join(right.withColumnRenamed("rows", "target_rows"), "table", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return both.select("table", zero("source_rows"), zero("target_rows")).select("*", (F.col("source_rows") == F.col("target_rows")).alias("equal"))
