"""Contests: results of each edition and session-day, their rounds, rankings and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.operators import scoring
from tally.plans.filters import FilterSpec
from tally.plans.roles import COMPLETE
from tally.sources.scratch import materialize

ROUNDS = 8
SHOWN_ROUNDS = 5
ROUND_MAP = "map<string, struct<castell: string, status: string>>"
RESULTS = "struct<edition: int, title: string, year: int, results: array<struct<group_name: string, position: int, points: string, day: string, rounds: string>>>"
EDITIONS = "struct<edition: int, location: string, date: string, infobox: map<string, string>>"
#: The session-days of an edition in order, fixed labels.
DAY_LABELS = ("Jornada Torredembarra", "Jornada Dissabte Tarragona", "Jornada Diumenge Tarragona")


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, day, group_id, group_name, position, points, rounds): a group's best five attempts of a session-day
    are its rounds, as JSON text; positions count over the year."""
    return rankings_of(materialize(scoring.performances(spark, sf_dir).select(*RANKED), "contest-performances"))


#: What rankings need of performances.
RANKED = ("event_year", "day", "group_id", "group_name", "points", "attempt_id", "item_name", "status")


def rankings_of(perf: DataFrame) -> DataFrame:
    """The rankings of performances, which are read three times: a stored table, or one that is written first."""
    best = Window.partitionBy("event_year", "day", "group_id").orderBy(F.desc("points"), "attempt_id")
    totals = perf.groupBy("event_year", "day", "group_id", "group_name").agg(F.sum("points").alias("points"))
    top = scoring.without_hopeless(perf, ("event_year", "day", "group_id"), SHOWN_ROUNDS)
    top = top.withColumn("rn", F.row_number().over(best)).filter(f"rn <= {SHOWN_ROUNDS}")
    cell = "concat('\"', rn, 'a\":{\"castell\":\"', item_name, '\",\"status\":\"', status, '\"}')"
    rounds = top.groupBy("event_year", "day", "group_id").agg(F.expr(f"concat('{{', listagg({cell}, ',') WITHIN GROUP (ORDER BY rn), '}}') AS rounds"))
    position = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("points"), "group_id", "day"))
    return totals.join(rounds, ["event_year", "day", "group_id"]).withColumnRenamed("event_year", "year").withColumn("position", position)


def typed_rounds(text: str = "rounds") -> Column:
    return F.from_json(text, ROUND_MAP)


def round_columns(ranked: DataFrame) -> DataFrame:
    """One JSON column for each of the eight rounds, null where there was none, beside the whole text."""
    rounds = typed_rounds()
    return ranked.select("*", *[F.to_json(F.try_element_at(rounds, F.lit(f"{k}a"))).alias(f"round_{k}_json") for k in range(1, ROUNDS + 1)])


def flatten(results: DataFrame, editions: DataFrame) -> DataFrame:
    """Rows of nested results (column `json`), each with what the editions' file says of its edition: a missing
    edition is dated by its year, the winner stands under either of two names, numbers that are none are null."""
    rows = results.select(F.from_json("json", RESULTS).alias("r")).select("r.edition", "r.title", "r.year", F.explode("r.results").alias("x"))
    rows = rows.select("edition", "title", "year", "x.*")
    info = editions.select(F.from_json("json", EDITIONS).alias("e")).select("e.*")
    winner = F.coalesce(F.try_element_at("infobox", F.lit("Colla guanyadora")), F.try_element_at("infobox", F.lit("Colles guanyadores")))
    info = info.select("edition", "location", "date", winner.alias("winner"), F.try_element_at("infobox", F.lit("Espectadors")).try_cast("int").alias("spectators"))
    joined = rows.join(info, "edition", "left")
    return joined.select("edition", "title", F.coalesce("date", F.col("year").cast("string")).alias("date"), "location", "winner", "spectators", "group_name", "position", F.col("points").try_cast("long").alias("points"), "day")


def nested_results(ranked: DataFrame) -> DataFrame:
    """The ranking as one JSON text for each edition."""
    one = F.struct("group_name", F.col("position").cast("int").alias("position"), F.when(F.col("position") % 11 == 0, F.lit("Desqualificada")).otherwise(F.col("points").cast("string")).alias("points"), "day", "rounds")
    grouped = ranked.groupBy("year").agg(F.collect_list(one).alias("results"))
    return grouped.select(F.to_json(F.struct(F.col("year").alias("edition"), F.concat(F.lit("Concurs "), "year").alias("title"), "year", "results")).alias("json"))


def nested_editions(ranked: DataFrame) -> DataFrame:
    """The editions' file, without every third year; the winner's name and the spectators vary in form."""
    name = F.when(F.col("year") % 2 == 0, F.lit("Colla guanyadora")).otherwise(F.lit("Colles guanyadores"))
    crowd = F.when(F.col("year") % 2 == 0, (F.col("year") * 3).cast("string")).otherwise(F.lit("unknown"))
    first = ranked.filter("position = 1 AND year % 3 <> 0")
    box = F.map_from_arrays(F.array(name, F.lit("Espectadors")), F.array(F.col("group_name"), crowd))
    return first.select(F.to_json(F.struct(F.col("year").alias("edition"), F.lit("Tarragona").alias("location"), F.concat(F.lit("01/10/"), "year").alias("date"), box.alias("infobox"))).alias("json"))


def ranking(ranked: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """The ranking with five rounds as "item (status)"; with a day filter, positions are those of the day."""
    spec.only("editions", "days", "groups", "positions", "years", "items", "statuses")
    if spec.days:
        of_day = Window.partitionBy("year", "day").orderBy("position")
        ranked = ranked.withColumn("position", F.row_number().over(of_day))
    for given, column in ((spec.editions, "year"), (spec.years, "year"), (spec.groups, "group_name"), (spec.positions, "position")):
        if given:
            ranked = ranked.filter(F.col(column).isin(*given))
    if spec.days:
        ranked = ranked.filter(F.col("day").contains(spec.days[0]) if len(spec.days) == 1 else F.col("day").isin(*spec.days))
    if spec.items or spec.statuses:
        ranked = ranked.filter(holds_round(spec.items, spec.statuses))
    rounds = typed_rounds()
    cell = lambda k: F.try_element_at(rounds, F.lit(f"{k}a"))
    shown = [F.concat(cell(k)["castell"], F.lit(" ("), cell(k)["status"], F.lit(")")).alias(f"round_{k}") for k in range(1, SHOWN_ROUNDS + 1)]
    return ranked.select(F.col("year").alias("edition"), F.concat(F.lit("Concurs "), "year").alias("title"), F.lit("Tarragona").alias("place"), F.col("position").cast("int").alias("position"), "group_name", F.col("points").alias("total_points"), "day", *shown)


def holds_round(items: tuple[str, ...], statuses: tuple[str, ...]) -> Column:
    """Whether a round has one of the items and one of the statuses, as far as they are given."""

    def fits(r: Column) -> Column:
        ok = r["castell"].isin(*items) if items else F.lit(True)
        return ok & r["status"].isin(*statuses) if statuses else ok

    return F.exists(F.map_values(typed_rounds()), fits)


def history(ranked: DataFrame) -> DataFrame:
    """For each year and day: groups, winner (a group without points never wins), and what was completed by round."""
    rounds = typed_rounds()

    def completed(k: int) -> Column:
        cell = F.try_element_at(rounds, F.lit(f"{k}a"))
        items = F.array_sort(F.collect_set(F.when(cell["status"] == COMPLETE, cell["castell"])))
        return F.array_join(items, ", ").alias(f"round_{k}_completed")

    winner = F.max_by("group_name", F.when(F.col("points").isNotNull(), F.struct(F.col("points"), (-F.col("group_id")).alias("g"))))
    return ranked.groupBy("year", "day").agg(F.count_distinct("group_name").alias("groups"), winner.alias("winner"), F.max("points").alias("winner_points"), *[completed(k) for k in range(1, SHOWN_ROUNDS + 1)])


def session_days(rows: DataFrame, first_year: int = 2014, repaired_year: int = 2014) -> DataFrame:
    """rows (year, group_name, day) with `session_day`. In the repaired year the day stands in brackets in the
    group's name. From first_year on days are put in the form d/m, and the days of a year, in order, get the
    fixed labels; a day that is none counts as the first of January."""
    in_name = F.regexp_extract("group_name", r"\(([^)]+)\)", 1)
    repair = (F.col("year") == repaired_year) & (in_name != "")
    fixed = rows.withColumns({"day": F.when(repair, in_name).otherwise(F.col("day")), "group_name": F.when(repair, F.regexp_replace("group_name", r"\s*\([^)]+\)", "")).otherwise(F.col("group_name"))})
    plain = F.regexp_replace("day", r"D[sg]\.? ", "")
    part = lambda k: F.try_element_at(F.split(plain, "/"), F.lit(k)).try_cast("int")
    tidy = F.when(F.size(F.split(plain, "/")) == 2, F.concat_ws("/", part(1).cast("string"), part(2).cast("string"))).otherwise(plain)
    date = F.coalesce(F.try_to_date(F.concat_ws("-", F.col("year").cast("string"), part(2).cast("string"), part(1).cast("string")), "y-M-d"), F.make_date("year", F.lit(1), F.lit(1)))
    dated = fixed.withColumns({"tidy": tidy, "on": date})
    order = Window.partitionBy("year").orderBy("on", "tidy")
    days = dated.filter(F.col("day").isNotNull() & (F.col("year") >= first_year)).select("year", "on", "tidy").distinct().withColumn("rank", F.row_number().over(order))
    label = F.try_element_at(F.array(*map(F.lit, DAY_LABELS)), F.col("rank").cast("int"))
    return dated.join(days.select("year", "tidy", label.alias("session_day")), ["year", "tidy"], "left").select(*rows.columns, "session_day")
