"""Scratch folders that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a local session, as in tests, takes one of its
    own; on a cluster a machine's own folder would not do, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tally-shared")
    return f"{qualified(spark, folder)}/tally"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, the default one if it names none, so that what reads it without Spark finds the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString().rstrip("/")


#: The scratch tables made inside the innermost scope of this thread; None outside of scopes.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scope(spark: SparkSession, keep: str) -> Iterator[None]:
    """Deletes the scratch tables that this thread makes inside, at its end, but for those whose name begins with `keep`, which a scope
    around it gets. What is computed from them must be written by then."""
    outer = _made.set([])
    try:
        yield
    finally:
        mine = _made.get()
        _made.reset(outer)
        for path in mine:
            if os.path.basename(path).startswith(keep):
                if (around := _made.get()) is not None:
                    around.append(path)
            else:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there, and a lost executor
    costs no recomputation. The files are scratch; the shared folder is cleared after a job."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
