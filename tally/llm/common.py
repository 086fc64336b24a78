"""What the training-data operators share: the word rule, table reading and, from the library, scratch tables in the
shared folder."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.sources.scratch import materialize, scratch_path

__all__ = ["materialize", "scratch_path"]
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: A word: a longest run of characters other than the ASCII white space 0x09-0x0D and 0x20.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))
