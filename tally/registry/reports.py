"""Reports, filters and aggregates over performances."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import reports, scoring
from tally.plans import roles
from tally.plans.filters import FilterSpec
from tally.registry.sqlroles import roles as R
from tally.sources.scratch import materialize

perf = scoring.performances
ITEMS = ("1", "2", "3", "5", "8", "13", "21", "34", "55", "89", "144")
_ITEMS = ", ".join(f"'{i}'" for i in ITEMS)
_BEST = "row_number() OVER (ORDER BY total_points DESC, event_date, event_id, group_id) AS ranking, event_name, event_date, group_name, place AS event_place, city AS event_city, items_done, total_points"
_TOP = "ORDER BY total_points DESC, event_date, event_id, group_id LIMIT 20"


def _filtered(spec: FilterSpec):
    """A filter alone: the attempts that pass it, counted by group, year and status."""
    from tally.plans.filters import apply

    return lambda s, d: apply(perf(s, d), spec).groupBy("group_name", "event_year", "status").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


def _filtered_sql(where: str) -> str:
    return R("perf") + f"SELECT group_name, event_year, status, count(*) AS n, sum(points)::BIGINT AS points FROM perf WHERE {where} GROUP BY ALL"


def star_join(s, d):
    joined = roles.attempts(s, d).join(roles.events(s, d), "event_id").join(roles.groups(s, d), "group_id")
    return joined.select("attempt_id", "event_name", "city", "event_date", "group_name", "item_name", "status")


def agg_counts(s, d):
    return perf(s, d).agg(F.count("*").alias("rows"), F.count("item_code").alias("scored"), F.count_distinct("event_id").alias("events"), F.count_distinct("group_id").alias("groups"), F.count_distinct("item_name").alias("items"))


def _with_codes(s, d):
    """Performances whose items have codes of the domain: a width, a height and a letter by the number of the part."""
    k = F.regexp_extract("item_name", "([0-9]+)", 1).cast("int")
    code = F.concat((k % 9 + 1).cast("string"), F.lit("d"), (k % 4 + 6).cast("string"), F.when(k % 3 == 0, "a").when(k % 3 == 1, "f").otherwise(""))
    return perf(s, d).withColumn("item_code", code)


def text_report(s, d):
    """A line for each event and group with its results in order."""
    line = "listagg(concat(item_name, ' (', status, ')'), '; ') WITHIN GROUP (ORDER BY attempt_id)"
    return perf(s, d).groupBy("event_id", "event_name", "date_text", "group_name").agg(F.expr(f"concat(date_text, ' ', event_name, ' - ', group_name, ': ', {line}) AS line")).select("event_id", "line")


def dataset_stats(s, d):
    """The six figures of a dataset's header."""
    attempts, events = roles.attempts(s, d), roles.events(s, d)
    with_results = attempts.select("event_id").distinct().withColumn("has", F.lit(True))
    of_events = events.join(with_results, "event_id", "left").agg(F.count("*").alias("events"), F.count("has").alias("events_with_results"), F.count_if(F.col("has").isNull()).alias("events_without_results"), F.count_distinct("city").alias("cities"))
    of_attempts = attempts.agg(F.count("*").alias("attempts"), F.count_distinct("group_id").alias("groups"))
    return of_events.crossJoin(of_attempts)  # one row each


def option_lists(s, d):
    """The values that a user can choose from, by kind."""
    p = perf(s, d)
    one = lambda name, col: F.struct(F.lit(name).alias("kind"), F.col(col).cast("string").alias("value"))
    each = p.select(F.explode(F.array(one("group", "group_name"), one("city", "city"), one("event", "event_name"), one("item", "item_code"))).alias("v")).select("v.*").filter("value IS NOT NULL").distinct()
    years = roles.events(s, d).select(F.lit("year").alias("kind"), F.regexp_extract("date_text", "([0-9]{4})", 1).alias("value")).distinct()
    return each.union(years)


DISPLAY = {"ranking": "#", "event_name": "Diada", "event_date": "Data", "event_place": "Lloc", "event_city": "Ciutat", "group_name": "Colla", "items_done": "Castells", "total_points": "Punts"}
HISTORY = {"item_name": "Castell", "status": "Estat", "occurrences": "Vegades", "group_names": "Colles", "cities": "Ciutats"}

QUERIES = {
    "best_event": lambda s, d: reports.best_event(perf(s, d)),
    "best_event_having": lambda s, d: reports.best_event(perf(s, d), FilterSpec(items=ITEMS, item_status=roles.COMPLETE)),
    "best_item": lambda s, d: reports.best_item(perf(s, d)),
    "item_history": lambda s, d: reports.item_history(perf(s, d)),
    "location_performances": lambda s, d: reports.location_performances(perf(s, d), FilterSpec(locations=("ASIA",))),
    "year_summary": lambda s, d: reports.year_summary(perf(s, d), FilterSpec(years=(1997,), limit=50)),
    "first_item": lambda s, d: reports.first_item(perf(s, d), FilterSpec(items=ITEMS)),
    "item_statistics": lambda s, d: reports.item_statistics(perf(s, d)),
    "year_ranges": lambda s, d: reports.group_year_ranges(roles.attempts(s, d), roles.events(s, d), roles.groups(s, d)),
    "active_groups": lambda s, d: reports.active_groups(reports.group_year_ranges(roles.attempts(s, d), roles.events(s, d), roles.groups(s, d))).join(reports.groups_with_min_events(materialize(perf(s, d).select("group_name", "event_id", "event_year"), "active-events")), "group_name"),
    "item_count": lambda s, d: reports.item_count(perf(s, d), list(ITEMS), roles.COMPLETE),
    "star_join": star_join,
    "alias_join": lambda s, d: scoring.alias_join(roles.attempts(s, d), roles.scores(s, d)).select("attempt_id", "item_name", "item_code", "full", "partial"),
    "points_case": lambda s, d: perf(s, d).select("attempt_id", "item_name", "status", "points"),
    "class_case": lambda s, d: perf(s, d).groupBy("item_class", "status").agg(F.count("*").alias("n"), F.sum("points").alias("points")),
    "agg_counts": agg_counts,
    "filter_group": _filtered(FilterSpec(groups=("NATION_3", "NATION_7"))),
    "filter_item": _filtered(FilterSpec(items=ITEMS)),
    "filter_year": _filtered(FilterSpec(years=(1996, 1999))),
    "filter_location": _filtered(FilterSpec(locations=("ASI",))),
    "filter_event_name": _filtered(FilterSpec(event_names=("Fair ASIA", "Fair EUROPE"))),
    "filter_status": _filtered(FilterSpec(statuses=(roles.COMPLETE,))),
    "filter_tier": lambda s, d: reports.best_item(perf(s, d), FilterSpec(tier="ECONOMY", limit=50)),
    "filter_tier_codes": lambda s, d: reports.item_history(_with_codes(s, d), FilterSpec(tier="gamma extra", limit=1000)).select("item_name", "status", "occurrences"),
    "items_with_points": lambda s, d: reports.items_with_points(perf(s, d)),
    "text_report": text_report,
    "dataset_stats": dataset_stats,
    "option_lists": option_lists,
    "display_table": lambda s, d: reports.display(reports.item_history(perf(s, d)), HISTORY, ("group_names", "cities")),
}

SQL = {
    "best_event": R("totals") + f"SELECT {_BEST} FROM totals {_TOP}",
    "best_event_having": R("totals") + f"SELECT {_BEST} FROM totals WHERE (event_id, group_id) IN (SELECT (event_id, group_id) FROM counted WHERE item_code IN ({_ITEMS}) AND status = 'Descarregat') {_TOP}",
    "best_item": R("perf") + "SELECT event_name, event_date AS date, place, city, group_name, item_name, status, points FROM perf ORDER BY points DESC, event_date, attempt_id LIMIT 20",
    "item_history": R("perf") + "SELECT item_name, status, count(*) AS occurrences, min(event_date) AS first_date, max(event_date) AS last_date, string_agg(DISTINCT city, ', ' ORDER BY city) AS cities, string_agg(DISTINCT group_name, ', ' ORDER BY group_name) AS group_names FROM perf GROUP BY ALL ORDER BY occurrences DESC, item_name, status LIMIT 20",
    "location_performances": R("totals") + "SELECT event_name, event_date, year(event_date)::INTEGER AS year, group_name, place AS event_place, city AS event_city, num_items, items_done, total_points FROM totals WHERE city LIKE '%ASIA%' ORDER BY total_points DESC, event_date DESC, event_id, group_id LIMIT 20",
    "year_summary": R("perf") + "SELECT group_name, count(DISTINCT event_id) AS num_events, count(*) AS num_attempts, count_if(status = 'Descarregat') AS complete, count_if(status = 'Carregat') AS loaded, count_if(status = 'Intent') AS attempts_failed, count_if(status = 'Intent desmuntat') AS dismantled FROM perf WHERE event_year = 1997 GROUP BY group_name ORDER BY sum(points) DESC, group_name LIMIT 50",
    "first_item": R("perf") + f"SELECT status, event_date AS date, event_name, place, city, group_name, item_name FROM perf WHERE item_code IN ({_ITEMS}) QUALIFY row_number() OVER (PARTITION BY status ORDER BY event_date, event_id, attempt_id) = 1",
    "item_statistics": R("perf") + "SELECT item_name, "
    + ", ".join(f"count_if(status = '{s}') AS times_{n}, count(DISTINCT CASE WHEN status = '{s}' THEN group_id END) AS groups_{n}" for n, s in (("complete", roles.COMPLETE), ("loaded", roles.LOADED), ("attempted", roles.ATTEMPT), ("dismantled", roles.DISMANTLED)))
    + ", " + ", ".join(f"min(CASE WHEN status = '{s}' THEN event_date END) AS first_{n}, substr(string_agg(DISTINCT CASE WHEN status = '{s}' THEN group_name END, ', ' ORDER BY CASE WHEN status = '{s}' THEN group_name END), 1, 400) AS names_{n}" for n, s in (("complete", roles.COMPLETE), ("loaded", roles.LOADED)))
    + ', max("full") AS "full", max(partial) AS partial FROM perf GROUP BY item_name',
    "year_ranges": R("ranges") + "SELECT * FROM ranges",
    "active_groups": R("ranges", "perf") + "SELECT unnest(range(min_year, max_year + 1))::INTEGER AS year, group_name FROM ranges WHERE group_name IN (SELECT group_name FROM perf GROUP BY 1 HAVING count(DISTINCT event_id) >= 10)",
    "item_count": R("perf") + f"SELECT group_name, event_year, item_code, count(*) AS n FROM perf WHERE item_code IN ({_ITEMS}) AND status = 'Descarregat' GROUP BY ALL",
    "star_join": R("att", "ev", "grp") + "SELECT attempt_id, event_name, city, event_date, group_name, item_name, status FROM att JOIN ev USING (event_id) JOIN grp USING (group_id)",
    "alias_join": R("att", "sc") + "SELECT attempt_id, item_name, code AS item_code, \"full\", partial FROM att LEFT JOIN sc ON item_name = external OR item_name = code OR item_name = name",
    "points_case": R("perf") + "SELECT attempt_id, item_name, status, points FROM perf",
    "class_case": R("perf") + "SELECT item_class, status, count(*) AS n, sum(points)::BIGINT AS points FROM perf GROUP BY ALL",
    "agg_counts": R("perf") + "SELECT count(*) AS rows, count(item_code) AS scored, count(DISTINCT event_id) AS events, count(DISTINCT group_id) AS groups, count(DISTINCT item_name) AS items FROM perf",
    "filter_group": _filtered_sql("group_name IN ('NATION_3', 'NATION_7')"),
    "filter_item": _filtered_sql(f"item_code IN ({_ITEMS})"),
    "filter_year": _filtered_sql("event_year IN (1996, 1999)"),
    "filter_location": _filtered_sql("city LIKE '%ASI%'"),
    "filter_event_name": _filtered_sql("event_name IN ('Fair ASIA', 'Fair EUROPE')"),
    "filter_status": _filtered_sql("status = 'Descarregat'"),
    "filter_tier": R("perf") + "SELECT 'ECONOMY' AS tier_filtered, event_name, event_date AS date, place, city, group_name, item_name, status, points FROM perf WHERE tier = 'ECONOMY' ORDER BY points DESC, event_date, attempt_id LIMIT 50",
    "filter_tier_codes": R("perf") + ", k AS (SELECT *, regexp_extract(item_name, '([0-9]+)', 1)::INTEGER AS k FROM perf) SELECT item_name, status, count(*) AS occurrences FROM k WHERE (k % 9 + 1) || 'd' || (k % 4 + 6) || CASE k % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'f' ELSE '' END IN ('2d9fm', '4d9af', '3d9af', '5d9f', '9d8', '9d9f', '3d10fm', '4d10fm', 'pd8fm', 'pd9fmp', '4d9', '7d9f', '2d9f', '3d9') GROUP BY ALL ORDER BY occurrences DESC, item_name, status LIMIT 1000",
    "items_with_points": R("perf") + "SELECT group_name, event_year, item_name, item_code, max(\"full\") AS \"full\" FROM perf WHERE \"full\" > 0 GROUP BY ALL",
    "text_report": R("perf") + "SELECT event_id, date_text || ' ' || event_name || ' - ' || group_name || ': ' || string_agg(item_name || ' (' || status || ')', '; ' ORDER BY attempt_id) AS line FROM perf GROUP BY event_id, event_name, date_text, group_name",
    "dataset_stats": R("att", "ev") + "SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(DISTINCT event_id) FROM att) AS events_with_results, (SELECT count(*) FROM ev WHERE event_id NOT IN (SELECT event_id FROM att)) AS events_without_results, (SELECT count(DISTINCT city) FROM ev) AS cities, (SELECT count(*) FROM att) AS attempts, (SELECT count(DISTINCT group_id) FROM att) AS groups",
    "option_lists": R("perf") + "SELECT DISTINCT 'group' AS kind, group_name AS value FROM perf UNION ALL SELECT DISTINCT 'city', city FROM perf UNION ALL SELECT DISTINCT 'event', event_name FROM perf UNION ALL SELECT DISTINCT 'item', item_code FROM perf WHERE item_code IS NOT NULL UNION ALL SELECT DISTINCT 'year', regexp_extract(date_text, '([0-9]{4})', 1) FROM ev",
    "display_table": R("perf") + "SELECT item_name AS \"Castell\", status AS \"Estat\", count(*)::VARCHAR AS \"Vegades\", "
    + ", ".join(f"CASE WHEN count(DISTINCT {c}) > 10 THEN array_to_string(list_sort(list(DISTINCT {c}))[1:10], ', ') || '...' ELSE coalesce(string_agg(DISTINCT {c}, ', ' ORDER BY {c}), '-') END AS \"{n}\"" for c, n in (("group_name", "Colles"), ("city", "Ciutats")))
    + " FROM perf GROUP BY item_name, status ORDER BY count(*) DESC, item_name, status LIMIT 20",
}
