"""The reports: each takes performances and a FilterSpec and gives a table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.operators import scoring
from tally.plans import filters, roles
from tally.plans.filters import FilterSpec

DISPLAY_CUT = 10


def _numbered(top: DataFrame, *order) -> DataFrame:
    """Ranks of a table that is cut already, so that the window sees a bounded number of rows."""
    return top.withColumn("ranking", F.row_number().over(Window.orderBy(*order)).cast("long"))


def _names(value, alias: str):
    """The different values in order, as one text; null if there are none. Groups and cities are few, and sets
    of them, unlike several distinct listaggs, aggregate in one pass."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(value)), ", "), F.lit("")).alias(alias)


def best_event(perf: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Events by the points of what counts. With items, an event stays if one of them counts (with the status)."""
    spec.only("groups", "years", "locations", "event_names", "items", "item_status")
    done = F.col("item_code").isin(*spec.items) & (F.col("status") == spec.item_status if spec.item_status else F.lit(True))
    inner = FilterSpec(groups=spec.groups, years=spec.years, locations=spec.locations, event_names=spec.event_names)
    totals = scoring.event_totals(filters.apply(perf, inner), *([F.bool_or(F.coalesce(done, F.lit(False))).alias("has")] if spec.items else []))
    totals = totals.filter("has") if spec.items else totals
    order = [F.desc("total_points"), F.col("event_date"), F.col("event_id"), F.col("group_id")]
    top = _numbered(totals.orderBy(*order).limit(spec.limit), *order)
    return top.select("ranking", "event_name", "event_date", "group_name", F.col("place").alias("event_place"), F.col("city").alias("event_city"), "items_done", "total_points")


def best_item(perf: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    spec.only("groups", "years", "locations", "event_names", "statuses", "tier")
    top = filters.apply(perf, spec).orderBy(F.desc("points"), "event_date", "attempt_id").limit(spec.limit)
    tier = [F.lit(spec.tier).alias("tier_filtered")] if spec.tier else []
    return top.select(*tier, "event_name", F.col("event_date").alias("date"), "place", "city", "group_name", "item_name", "status", "points")


def item_history(perf: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """How often each item was done, by status; by group too, if groups are given, else with all groups' names."""
    spec.only("groups", "items", "years", "locations", "statuses", "tier")
    keys = ["item_name", "status", *(["group_name"] if spec.groups else [])]
    names = [] if spec.groups else [_names("group_name", "group_names")]
    grouped = filters.apply(perf, spec).groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"), _names("city", "cities"), *names)
    return grouped.orderBy(F.desc("occurrences"), *keys).limit(spec.limit)


def location_performances(perf: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    spec.only("groups", "years", "locations", "tier")
    totals = scoring.event_totals(filters.apply(perf, spec))
    top = totals.orderBy(F.desc("total_points"), F.desc("event_date"), "event_id", "group_id").limit(spec.limit)
    return top.select("event_name", "event_date", F.year("event_date").alias("year"), "group_name", F.col("place").alias("event_place"), F.col("city").alias("event_city"), "num_items", "items_done", "total_points")


def year_summary(perf: DataFrame, spec: FilterSpec) -> DataFrame:
    spec.only("years", "locations", "groups", "tier")
    if not spec.years:
        raise ValueError("year_summary needs years")
    by_status = {"complete": roles.COMPLETE, "loaded": roles.LOADED, "attempts_failed": roles.ATTEMPT, "dismantled": roles.DISMANTLED}
    grouped = filters.apply(perf, spec).groupBy("group_name").agg(F.count_distinct("event_id").alias("num_events"), F.count("*").alias("num_attempts"), *[F.count_if(F.col("status") == s).alias(n) for n, s in by_status.items()], F.sum("points").alias("total"))
    return grouped.orderBy(F.desc("total"), "group_name").limit(spec.limit).drop("total")


def first_item(perf: DataFrame, spec: FilterSpec) -> DataFrame:
    """The earliest attempt for each status, at most four rows."""
    spec.only("items", "groups", "locations", "event_names", "statuses", "tier")
    if not spec.items:
        raise ValueError("first_item needs items")
    first = Window.partitionBy("status").orderBy("event_date", "event_id", "attempt_id")
    found = filters.apply(perf, spec).withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    return found.select("status", F.col("event_date").alias("date"), "event_name", "place", "city", "group_name", "item_name")


def item_statistics(perf: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """For each item: counts, first dates, groups by outcome with their names cut to 400 characters, points."""
    spec.only("groups", "items", "years", "locations", "event_names", "tier")
    is_ = lambda s: F.col("status") == s
    names = lambda s, out: F.substring(_names(F.when(is_(s), F.col("group_name")), out), 1, 400).alias(out)
    outcomes = {"complete": roles.COMPLETE, "loaded": roles.LOADED, "attempted": roles.ATTEMPT, "dismantled": roles.DISMANTLED}
    # one row for each group and outcome of an item first, so that groups are counted without being distinct
    each = filters.apply(perf, spec).groupBy("item_name", "status", "group_id", "group_name").agg(F.count("*").alias("n"), F.min("event_date").alias("first"), F.max("full").alias("full"), F.max("partial").alias("partial"))
    return each.groupBy("item_name").agg(
        *[F.coalesce(F.sum(F.when(is_(s), F.col("n"))), F.lit(0)).alias(f"times_{n}") for n, s in outcomes.items()],
        *[F.min(F.when(is_(outcomes[n]), F.col("first"))).alias(f"first_{n}") for n in ("complete", "loaded")],
        *[F.count_if(is_(s)).alias(f"groups_{n}") for n, s in outcomes.items()],
        names(roles.COMPLETE, "names_complete"), names(roles.LOADED, "names_loaded"),
        F.max("full").alias("full"), F.max("partial").alias("partial"),
    )


#: Years with more than this many events count for a group's range.
RANGE_EVENTS = 10


def group_year_ranges(attempts: DataFrame, events: DataFrame, groups: DataFrame) -> DataFrame:
    """For each group its years of more than RANGE_EVENTS events. The year is read from the event's text date,
    which has several forms."""
    text = F.col("date_text")
    year = F.coalesce(F.when(text.contains("/"), F.try_element_at(F.split(text, "/"), F.lit(3)).try_cast("int")), F.when(text.rlike("^[0-9]{4}-"), F.substring(text, 1, 4).try_cast("int")), F.regexp_extract(text, "([0-9]{4})", 1).try_cast("int"))
    per_year = attempts.join(events.select("event_id", year.alias("year")), "event_id").groupBy("group_id", "year").agg(F.count_distinct("event_id").alias("n")).filter(F.col("n") > RANGE_EVENTS)
    ranges = per_year.groupBy("group_id").agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.count("*").alias("num_years"), F.sum("n").alias("total_events"))
    label = F.when(F.col("min_year") == F.col("max_year"), F.col("min_year").cast("string")).otherwise(F.concat_ws(" - ", F.col("min_year").cast("string"), F.col("max_year").cast("string")))
    return ranges.join(groups, "group_id").select("group_name", "min_year", "max_year", label.alias("year_range"), "num_years", "total_events")


def groups_with_min_events(perf: DataFrame, n: int = 10, year: int | None = None, fallback: int = 50) -> DataFrame:
    """Groups of n events or more (in the year); if there is none, any groups, at most `fallback`."""
    rows = perf.filter(filters.in_years(perf, (year,))) if year else perf
    enough = rows.groupBy("group_name").agg(F.count_distinct("event_id").alias("n")).filter(F.col("n") >= n).select("group_name")
    found = enough.agg(F.count("*").alias("found"))
    others = perf.select("group_name").distinct().orderBy("group_name").limit(fallback).crossJoin(F.broadcast(found)).filter("found = 0").select("group_name")
    return enough.union(others)


def active_groups(ranges: DataFrame) -> DataFrame:
    """(year, group_name) for every year in a group's range: the range as rows, so that a year joins by equality."""
    return ranges.select(F.explode(F.sequence("min_year", "max_year")).alias("year"), "group_name")


def item_count(perf: DataFrame, items: list[str], status: str) -> DataFrame:
    return perf.filter(F.col("item_code").isin(*items) & (F.col("status") == status)).groupBy("group_name", "event_year", "item_code").agg(F.count("*").alias("n"))


def items_with_points(perf: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """(group_name, event_year, item_name, item_code, full): the items of each group and year that a score is known for,
    once each, with the points of a complete one."""
    spec.only("groups", "years")
    known = filters.apply(perf, spec).filter(F.col("full") > 0)
    return known.groupBy("group_name", "event_year", "item_name", "item_code").agg(F.max("full").alias("full"))


@dataclass(frozen=True)
class SmallItems:
    """Items that are too small to ask for: by name, by the beginning of their name in small letters without spaces and dashes, and
    by other beginnings where a group has more than `many` items at an event."""

    names: tuple[str, ...] = ()
    beginnings: tuple[str, ...] = ()
    many: int | None = None
    beginnings_of_many: tuple[str, ...] = ()


#: Small pillars where items of an event are listed, where they are chosen from, and where they are counted. Fixed values.
SMALL_LISTED = SmallItems(beginnings=("pd4", "pde4"), many=6, beginnings_of_many=("pd5", "pde5"))
SMALL_CHOSEN = SmallItems(beginnings=("pd4", "pde4"), many=8, beginnings_of_many=("pd5", "pde5"))
SMALL_COUNTED = SmallItems(names=("Pde4", "Pde4cam", "Pde4ps"), beginnings=("pde4",))


def without_small(perf: DataFrame, small: SmallItems) -> DataFrame:
    name = F.lower(F.translate("item_name", " -", ""))
    begins = lambda beginnings: reduce(lambda x, b: x | name.startswith(b), beginnings, F.lit(False))
    drop = F.col("item_name").isin(*small.names) | begins(small.beginnings)
    if small.many is not None:
        at_event = F.count("*").over(Window.partitionBy("event_id", "group_id"))
        perf = perf.withColumn("__n", at_event)
        drop = drop | ((F.col("__n") > small.many) & begins(small.beginnings_of_many))
    return perf.filter(~drop).drop("__n")


#: What each report shows, in this order, and under which names. Fixed values.
LAYOUTS = {
    "best_event": {"ranking": "#", "event_name": "Diada", "event_date": "Data", "group_name": "Colla", "event_city": "Ciutat", "items_done": "Castells"},
    "best_item": {"tier_filtered": "Gamma", "item_name": "Castell", "event_name": "Diada", "date": "Data", "group_name": "Colla", "city": "Ciutat", "status": "Estat"},
    "item_history": {"tier_filtered": "Gamma", "item_name": "Castell", "status": "Estat", "occurrences": "Vegades", "group_name": "Colla", "group_names": "Colles", "first_date": "Primera Data", "last_date": "Última Data", "cities": "Ciutats"},
    "location_performances": {"event_name": "Diada", "event_date": "Data", "event_city": "Ciutat", "group_name": "Colla", "items_done": "Castells"},
    "first_item": {"item_name": "Castell", "status": "Estat", "event_name": "Diada", "date": "Data", "group_name": "Colla", "city": "Ciutat"},
    "item_statistics": {
        "item_name": "Castell", "times_complete": "Cops Descarregat", "times_loaded": "Cops Carregat", "times_dismantled": "Cops Intent Desmuntat", "times_attempted": "Cops Intent",
        "first_complete": "Primera Data Descarregat", "first_loaded": "Primera Data Carregat", "groups_complete": "Colles Descarregat", "groups_loaded": "Colles Carregat", "groups_attempted": "Colles Intentat",
        "names_complete": "Primeres Colles Descarregat", "names_loaded": "Primeres Colles Carregat",
    },
    "contest_ranking": {"group_name": "Colla", "position": "Posició", "total_points": "Punts Totals", "day": "Jornada", "round_1": "Ronda 1", "round_2": "Ronda 2", "round_3": "Ronda 3", "round_4": "Ronda 4", "round_5": "Ronda 5"},
    "contest_history": {"year": "Any", "day": "Jornada", "groups": "Colles Participants", "winner": "Colla Guanyadora", "winner_points": "Punts Guanyador", "r1": "Castells R1", "r2": "Castells R2", "r3": "Castells R3", "r4": "Castells R4", "r5": "Castells R5"},
    "year_summary": {"tier_filtered": "Gamma", "group_name": "Colla", "num_events": "Núm. Actuacions", "num_attempts": "Núm. Castells", "complete": "Castells Descarregats", "loaded": "Castells Carregats", "dismantled": "Castells Intent Desmuntat", "attempts_failed": "Castells Intent"},
}
#: Columns whose lists are cut.
CUT_COLUMNS = ("cities", "group_names")


def laid_out(report: DataFrame, kind: str, rows: int = 20) -> DataFrame:
    """The report as it is shown: those of its layout's columns that it has."""
    return display(report, {c: n for c, n in LAYOUTS[kind].items() if c in report.columns}, CUT_COLUMNS, rows)


def display(report: DataFrame, names: dict[str, str], lists: tuple[str, ...] = (), rows: int = 20) -> DataFrame:
    """The report's columns by their display names, missing values as "-", lists cut to DISPLAY_CUT parts."""

    def shown(column: str):
        value = F.col(column).cast("string")
        if column in lists:
            parts = F.split(value, ", ")
            cut = F.concat(F.array_join(F.slice(parts, 1, DISPLAY_CUT), ", "), F.lit("..."))
            value = F.when(F.size(parts) > DISPLAY_CUT, cut).otherwise(value)
        return F.coalesce(value, F.lit("-")).alias(names[column])

    return report.limit(rows).select(*[shown(c) for c in names])
