"""Tables to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.operators import ingest
from tally.sources.store import Store

#: Parents before children: a load writes in this order, a clearing goes the other way.
ORDER = ("groups", "scores", "events", "event_groups", "attempts", "editions", "rankings", "general_info", "chunks")


def write_tables(tables: dict[str, DataFrame], folder: str, partition: dict[str, str] | None = None) -> None:
    """Each table as Parquet, overwritten, parents first; large ones by a column, such as the year of events."""
    for name in sorted(tables, key=lambda n: (ORDER.index(n) if n in ORDER else len(ORDER), n)):
        writer = tables[name].write.mode("overwrite")
        if partition and name in partition:
            writer = writer.partitionBy(partition[name])
        writer.parquet(f"{folder}/{name}")


def reload_tables(store: Store, tables: dict[str, DataFrame]) -> DataFrame:
    """The given tables in place of the stored ones of the same names, all at once, and the counts of both. Until the last of
    them is written, and for ever if one cannot be, the stored ones stay as they are."""
    store.replace({n: tables[n] for n in sorted(tables, key=lambda n: (ORDER.index(n) if n in ORDER else len(ORDER), n))})
    return ingest.count_compare(tables, {n: store.read(n) for n in tables})


def write_dataset(rows: DataFrame, statistics: DataFrame, folder: str) -> None:
    """A dataset as JSON lines, beside one line of statistics."""
    rows.write.mode("overwrite").json(f"{folder}/rows")
    statistics.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{folder}/statistics")


def write_lines(lines: DataFrame, folder: str) -> None:
    """A text report, one line a row (column `line`)."""
    lines.select("line").write.mode("overwrite").text(folder)
