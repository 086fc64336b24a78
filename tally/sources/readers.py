"""Files to tables. Nested files give a column `json`, one object a row, which tally.operators flattens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators import contest, ingest, text

CHUNKS = "struct<chunks: array<struct<id: string, title: string, category: string, years: array<int>, year_ranges: array<string>, colles: array<string>, places: array<string>, keywords: array<string>, castells: array<string>, text: string, source: string>>>"
#: The dictionaries of the quiz by their file names' stems.
DICTIONARIES = {
    "groups_active": "colla_name string, min_year int, max_year int, year_range string, years_with_10plus_events int, total_events_in_range string, boost double",
    "groups_founded": "name string, any_primera_actuacio int, color_camisa string, color_code string",
    "contest_days": "any int, jornada string",
    "item_points": "castell_code string, castell_code_external string, punts_descarregat int, punts_carregat int, years array<int>",
}


def objects(spark: SparkSession, path: str, wrapper: str | None = None, lines: bool = False) -> DataFrame:
    """One row for each object of JSON files that hold a list, or a list under a name; or, for files that grow,
    one object a line. Commas before a closing bracket are let pass."""
    raw = spark.read.text(path) if lines else spark.read.text(path, wholetext=True)
    plain = F.regexp_replace("value", r",(\s*[\]}])", "$1")
    if lines:
        return raw.select(plain.alias("json")).filter(F.trim("json") != "")
    body = F.coalesce(F.get_json_object(plain, f"$.{wrapper}"), plain) if wrapper else plain
    # an object read as a string is its text
    return raw.select(F.explode(F.from_json(body, "array<string>")).alias("json"))


def events(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    return ingest.flatten_events(objects(spark, path, "events", lines))


def groups(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return ingest.flatten_groups(objects(spark, path, "colles", lines))


def scores(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return ingest.flatten_scores(whole.select(F.coalesce(F.get_json_object("value", "$.puntuacions"), "value").alias("json")))


def contests(spark: SparkSession, results: str, editions: str) -> DataFrame:
    return contest.flatten(objects(spark, results), objects(spark, editions))


def general_info(spark: SparkSession, path: str, header: str) -> DataFrame:
    """Numbered lines of text files with the header above them; a file is one text."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return text.sections(whole, header)


def info_chunks(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", CHUNKS)["chunks"]).alias("c")).select("c.*")


def dictionary(spark: SparkSession, path: str, name: str, lines: bool = False) -> DataFrame:
    """A dictionary of the quiz: files that hold a list, or, for those that grow, one object a line."""
    return spark.read.schema(DICTIONARIES[name]).option("multiLine", not lines).json(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")
