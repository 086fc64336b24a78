"""Text files as tables: numbered lines with a running section."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sections(docs: DataFrame, header: str) -> DataFrame:
    """(doc_id, line_number, category, text): the lines of each text with the last header above them; headers and
    blank lines go."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.trim("line")
    is_head = line.rlike(header)
    above = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = lines.select("doc_id", (F.col("pos") + 1).alias("line_number"), line.alias("text"), is_head.alias("head"), F.last(F.when(is_head, line), ignorenulls=True).over(above).alias("category"))
    return running.filter(~F.col("head") & (F.col("text") != "")).select("doc_id", F.col("line_number").cast("long").alias("line_number"), "category", "text")
