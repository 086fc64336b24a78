"""Contest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.functions import codes
from tally.operators import contest
from tally.plans import roles
from tally.plans.filters import FilterSpec
from tally.registry.sqlroles import roles as R

_RANKED = {
    "tot": "SELECT event_year AS year, day, group_id, group_name, sum(points)::BIGINT AS points FROM perf GROUP BY ALL",
    "top5": "SELECT event_year AS year, day, group_id, item_name, status, row_number() OVER (PARTITION BY event_year, day, group_id ORDER BY points DESC, attempt_id) AS rn FROM perf QUALIFY rn <= 5",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY year ORDER BY points DESC, group_id, day) AS position FROM tot",
    "wide": "SELECT r.*, " + ", ".join(f"max(CASE WHEN rn = {k} THEN item_name END) AS i{k}, max(CASE WHEN rn = {k} THEN t.status END) AS s{k}" for k in range(1, 6)) + " FROM ranked r JOIN top5 t USING (year, day, group_id) GROUP BY ALL",
}
_json = lambda k: f"'{{\"castell\":\"' || i{k} || '\",\"status\":\"' || s{k} || '\"}}'"
_SHOWN = ", ".join(f"i{k} || ' (' || s{k} || ')' AS round_{k}" for k in range(1, 6))
_HEAD = "year AS edition, 'Concurs ' || year AS title, 'Tarragona' AS place"
ROUND_ITEMS = ("1", "P1", "7", "P8", "12de", "33de")


def _cells(s, d):
    """Contest cells as they are written down: marks in several forms."""
    a = roles.attempts(s, d)
    odd = F.col("group_id") % 2 == 1
    mark = F.when(F.col("status") == roles.LOADED, F.when(odd, " (c)").otherwise("c")).when(F.col("status") == roles.ATTEMPT, F.when(odd, "(i)").otherwise(" i")).when(F.col("status") == roles.DISMANTLED, F.when(odd, " (id)").otherwise("id")).otherwise(F.when(odd, "").otherwise("fa"))
    return a.select("attempt_id", F.concat(F.when(odd, "*").otherwise(""), F.col("item_name"), mark).alias("cell"))


def _days(s, d):
    """Results with days as they are written down, years moved so that the rules apply."""
    k = F.substring("day", 1, 1).cast("int")
    day = F.when(k == 1, "Ds. 05/10").when(k == 2, "Dg. 6/10").when(k == 3, "28/09").when(k == 4, "Dg 6/10").otherwise("soon")
    year = F.col("event_year") + 15
    rows = contest.scoring.performances(s, d).select(year.alias("year"), "group_name", day.alias("day")).distinct()
    name = F.when(F.col("year") == 2014, F.concat("group_name", F.lit(" ("), "day", F.lit(")"))).otherwise(F.col("group_name"))
    return contest.session_days(rows.withColumn("group_name", name))


QUERIES = {
    "contest_flatten": lambda s, d: contest.flatten(contest.nested_results(contest.rankings(s, d)), contest.nested_editions(contest.rankings(s, d))),
    "contest_rounds": lambda s, d: contest.round_columns(contest.rankings(s, d)),
    "contest_ranking": lambda s, d: contest.ranking(contest.rankings(s, d), FilterSpec(days=("1-URGENT",), positions=(1, 2, 3, 4, 5))),
    "contest_round_filter": lambda s, d: contest.ranking(contest.rankings(s, d), FilterSpec(items=ROUND_ITEMS, statuses=(roles.COMPLETE, roles.LOADED))),
    "contest_history": lambda s, d: contest.history(contest.rankings(s, d)),
    "contest_cell_clean": lambda s, d: _cells(s, d).select("attempt_id", codes.cell_item(F.col("cell")).alias("item"), codes.cell_status(F.col("cell")).alias("status")),
    "contest_days": _days,
}

SQL = {
    "contest_flatten": R("perf", **_RANKED) + "SELECT r.year AS edition, 'Concurs ' || r.year AS title, CASE WHEN r.year % 3 <> 0 THEN '01/10/' || r.year ELSE r.year::VARCHAR END AS date, CASE WHEN r.year % 3 <> 0 THEN 'Tarragona' END AS location, CASE WHEN r.year % 3 <> 0 THEN w.group_name END AS winner, CASE WHEN r.year % 3 <> 0 AND r.year % 2 = 0 THEN r.year * 3 END AS spectators, r.group_name, r.position, CASE WHEN r.position % 11 <> 0 THEN r.points END AS points, r.day FROM ranked r JOIN ranked w ON w.year = r.year AND w.position = 1",
    "contest_rounds": R("perf", **_RANKED) + "SELECT year, day, group_id, group_name, points, position, '{' || concat_ws(',', " + ", ".join(f"'\"{k}a\":' || {_json(k)}" for k in range(1, 6)) + ") || '}' AS rounds, " + ", ".join(f"{_json(k)} AS round_{k}_json" for k in range(1, 6)) + ", NULL::VARCHAR AS round_6_json, NULL::VARCHAR AS round_7_json, NULL::VARCHAR AS round_8_json FROM wide",
    "contest_ranking": R("perf", **_RANKED) + f"SELECT {_HEAD}, row_number() OVER (PARTITION BY year, day ORDER BY position) AS position, group_name, points AS total_points, day, {_SHOWN} FROM wide WHERE day = '1-URGENT' QUALIFY row_number() OVER (PARTITION BY year, day ORDER BY position) <= 5",
    "contest_round_filter": R("perf", **_RANKED) + f"SELECT {_HEAD}, position, group_name, points AS total_points, day, {_SHOWN} FROM wide WHERE (year, day, group_id) IN (SELECT (year, day, group_id) FROM top5 WHERE item_name IN {ROUND_ITEMS} AND status IN ('Descarregat', 'Carregat'))",
    "contest_history": R("perf", **_RANKED) + "SELECT t.year, t.day, count(DISTINCT t.group_name) AS groups, arg_max(t.group_name, struct_pack(p := t.points, g := -t.group_id)) AS winner, max(t.points) AS winner_points, " + ", ".join(f"coalesce(array_to_string(list_sort(list_filter(list(DISTINCT CASE WHEN s{k} = 'Descarregat' THEN i{k} END), lambda x: x IS NOT NULL)), ', '), '') AS round_{k}_completed" for k in range(1, 6)) + " FROM wide t GROUP BY t.year, t.day",
    "contest_cell_clean": R("att") + "SELECT attempt_id, replace(replace(replace(replace(item_name || CASE WHEN status = 'Descarregat' AND group_id % 2 = 0 THEN 'fa' WHEN group_id % 2 = 1 THEN '' WHEN status = 'Carregat' THEN 'c' WHEN status = 'Intent' THEN 'i' WHEN status = 'Intent desmuntat' THEN 'id' ELSE '' END, 'de', 'd'), 'fa', 'af'), 'ps', 's'), 'pd', 'Pd') AS item, status FROM att",
    "contest_days": R("perf") + ", d AS (SELECT DISTINCT event_year + 15 AS year, group_name, CASE left(day, 1) WHEN '1' THEN 'Ds. 05/10' WHEN '2' THEN 'Dg. 6/10' WHEN '3' THEN '28/09' WHEN '4' THEN 'Dg 6/10' ELSE 'soon' END AS day FROM perf) SELECT year, CASE WHEN year = 2014 THEN group_name ELSE group_name END AS group_name, day, CASE WHEN year >= 2014 THEN CASE day WHEN 'soon' THEN 'Jornada Torredembarra' WHEN '28/09' THEN 'Jornada Dissabte Tarragona' WHEN 'Ds. 05/10' THEN 'Jornada Diumenge Tarragona' END END AS session_day FROM d",
}
