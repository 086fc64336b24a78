"""Quiz queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tally.operators import contest, quiz, reports, scoring
from tally.plans import roles
from tally.registry.contest import _RANKED
from tally.registry.sqlroles import roles as R
from tally.sources import readers
from tally.sources.scratch import materialize, scratch_path

perf = scoring.performances


#: What stands for small pillars in the tables.
SMALL = reports.SmallItems(names=("P1", "P2", "P3", "P4", "P5"), beginnings=("p10", "p11", "p12"))


def _colours(s, d):
    return roles.groups(s, d).select("group_name", F.concat(F.lit("colour "), (F.col("group_id") % 6).cast("string")).alias("value"))


def _founded(p):
    return p.groupBy("group_name").agg((F.min("event_year") - F.min("group_id") % 5).cast("string").alias("value"))


def attribute(s, d):
    """Shirt colours, and the year of a group's first event as its founding year."""
    colours, founded = _colours(s, d), _founded(perf(s, d))
    return quiz.attribute(colours).withColumn("kind", F.lit("colour")).union(quiz.attribute(founded).withColumn("kind", F.lit("founded")))


def scoring_of_answers(s, d):
    """Answers of all three kinds, made from the event stream."""
    e = roles.stream_events(s, d)
    i = F.col("event_id")
    array = lambda *x: F.array(*[(v % 6).cast("int") for v in x])
    chosen, right = F.array_distinct(array(i, i + 2, i * 3)), F.array_distinct(array(i, i + 1))
    given, order = array(i, i + 1, i + 2, i + 3), array(i, i + 1, i + 3, i + 2)
    rows = e.select("event_id", "user_id", quiz.exactly(quiz.slider_score(i % 20, i % 17, i % 4)).alias("slider"), quiz.exactly(quiz.multi_score(chosen, right)).alias("multi"), quiz.exactly(quiz.ordering_score(given, F.when(i % 3 == 0, given).otherwise(order))).alias("ordering"))
    total = lambda c: F.round(F.sum(c), 4).cast("double").alias(c)
    percent, band = quiz.game(F.sum(F.col("slider") + F.col("multi") + F.col("ordering")), F.count("*") * 3)
    return rows.groupBy("user_id").agg(total("slider"), total("multi"), total("ordering"), percent.alias("percent"), band.alias("band"))


def quiz_dictionaries(s, d):
    """The four dictionaries, written as files and read back: (dictionary, key, value)."""
    ranges = reports.group_year_ranges(roles.attempts(s, d), roles.events(s, d), roles.groups(s, d))
    tables = {
        "groups_active": ranges.select(F.col("group_name").alias("colla_name"), "min_year", "max_year", "year_range", F.col("num_years").cast("int").alias("years_with_10plus_events"), F.col("total_events").cast("string").alias("total_events_in_range"), (F.col("num_years") / 10).alias("boost")),
        "groups_founded": roles.groups(s, d).select(F.col("group_name").alias("name"), (F.col("group_id") + 1900).cast("int").alias("any_primera_actuacio"), F.concat(F.lit("color "), (F.col("group_id") % 6).cast("string")).alias("color_camisa"), F.lit("#fff").alias("color_code")),
        "contest_days": roles.order_events(s, d).select(F.year("event_date").alias("any"), F.col("day").alias("jornada")).distinct(),
        "item_points": roles.scores(s, d).select(F.col("code").alias("castell_code"), F.col("external").alias("castell_code_external"), F.col("full").cast("int").alias("punts_descarregat"), F.col("partial").cast("int").alias("punts_carregat"), F.array(F.lit(2018), F.lit(2022)).alias("years")),
    }
    shown = {"groups_active": ("colla_name", "concat_ws('|', min_year, max_year, year_range, years_with_10plus_events, total_events_in_range)"), "groups_founded": ("name", "concat_ws('|', any_primera_actuacio, color_camisa, color_code)"), "contest_days": ("any", "jornada"), "item_points": ("castell_code", "concat_ws('|', castell_code_external, punts_descarregat, punts_carregat, size(years))")}
    out = None
    for name, df in tables.items():
        folder = scratch_path(s, f"dictionary-{name}")
        df.write.json(folder)
        key, value = shown[name]
        rows = readers.dictionary(s, folder, name, lines=True).select(F.lit(name).alias("dictionary"), F.col(key).cast("string").alias("key"), F.expr(value).alias("value"))
        out = rows if out is None else out.union(rows)
    return out


def _active(s, d):
    """Groups with their years of activity, and a boost by their number."""
    ranges = reports.group_year_ranges(roles.attempts(s, d), roles.events(s, d), roles.groups(s, d))
    return _boosted(ranges)


def _boosted(ranges):
    return ranges.select("group_name", "min_year", "max_year", (F.length("group_name") % 4).alias("boost"))


def quiz_dataset(s, d):
    p = perf(s, d).select("attempt_id", "event_id", "group_id", "group_name", "event_name", "event_date", "event_year", "place", "city", "day", "item_name", "item_code", "item_class", "status", "points")
    p = materialize(p, "quiz-performances")  # once, and narrow
    active = p.groupBy("group_name").agg(F.min("event_year").alias("min_year"), F.max("event_year").alias("max_year")).withColumn("boost", F.length("group_name") % 4)
    return quiz.dataset(p, roles.scores(s, d), materialize(contest.rankings_of(p), "quiz-rankings"), _colours(s, d), materialize(_founded(p), "quiz-founded"), small=SMALL, active=materialize(active, "quiz-active"), first_year=0)


def _first_group(s, d, **how):
    """The questions of each year; the tables' years are all before the first one of the rules."""
    p = materialize(perf(s, d).select("event_year", "item_code", "group_id", "group_name", "event_date", "event_id", "date_text", "status"), "quiz-firsts")
    # the fact is written once, narrow, and the groups' years come from it too: one row for each event of a group, then one for each event
    shows = p.select("event_id", "group_id", "group_name", "date_text").distinct()
    ranges = reports.group_year_ranges(shows, shows.select("event_id", "date_text").distinct(), shows.select("group_id", "group_name").distinct())
    return quiz.first_group(p, _boosted(ranges), first_year=0, **how)


def _days(s, d):
    """Session-days of the contests, those of the second priority being the main ones, in years as late as the rules'."""
    return roles.order_events(s, d).select((F.year("event_date") + 20).alias("year"), F.when(F.col("day") == "2-HIGH", quiz.MAIN_DAY).otherwise(F.col("day")).alias("day")).distinct()


def similar_items(s, d):
    """For each group and year its four best items, and the two first codes of nearly their average of points."""
    best = quiz.best_item_unique(perf(s, d)).filter("points > 0")
    top = best.withColumn("rn", F.row_number().over(Window.partitionBy("group_name", "event_year").orderBy(F.desc("points"), "item_name"))).filter("rn <= 4")
    answers = top.groupBy(F.concat_ws("|", "group_name", "event_year").alias("key")).agg(F.collect_list(F.struct("item_name", "status")).alias("items"))
    answers = materialize(answers, "similar-answers")  # a row for each group and year, for which the fact is read once
    return quiz.similar_items(answers, roles.scores(s, d), order=F.col("code")).select("key", F.round("average", 6).alias("average"), "similar")


QUERIES = {
    "quiz_dictionaries": quiz_dictionaries,
    "quiz_best_event": lambda s, d: quiz.best_event(perf(s, d)),
    "best_item_unique": lambda s, d: quiz.best_item_unique(perf(s, d)),
    "distractors": lambda s, d: quiz.distractors(roles.scores(s, d)),
    "quiz_performance": lambda s, d: quiz.performance(materialize(perf(s, d).select("event_id", "group_id", "group_name", "event_name", "event_date", "event_year", "item_name", "status", "points", "attempt_id"), "quiz-performances"), SMALL),
    "quiz_multi": lambda s, d: quiz.multi(perf(s, d), roles.scores(s, d), SMALL),
    "first_groups": lambda s, d: quiz.first_groups(perf(s, d)),
    "quiz_first_group": lambda s, d: _first_group(s, d, order=(F.desc("boost"),)),
    "quiz_items": lambda s, d: quiz.sample_items(_first_group(s, d), roles.scores(s, d)),
    "quiz_days": lambda s, d: quiz.sample_days(_days(s, d)),
    "quiz_performance_options": lambda s, d: quiz.performance_options(materialize(perf(s, d).select("event_id", "group_id", "group_name", "event_name", "event_date", "event_year", "city", "item_name", "status", "points", "attempt_id"), "quiz-performances"), SMALL),
    "quiz_attribute": attribute,
    "quiz_counts": lambda s, d: quiz.counts(perf(s, d), SMALL),
    "quiz_ordering": lambda s, d: quiz.ordering(contest.rankings(s, d)),
    "quiz_scoring": scoring_of_answers,
    "quiz_sample": lambda s, d: quiz.sample_years(perf(s, d)).select("group_name", "event_year"),
    "quiz_groups": lambda s, d: quiz.sample_groups(_active(s, d)),
    "similar_items": similar_items,
    "quiz_dataset": quiz_dataset,
}

_LABEL = "event_name || ', ' || city || ' (' || event_date || ' | ' || group_name || ')'"
_PRIO = "CASE status WHEN 'Descarregat' THEN 1 WHEN 'Carregat' THEN 2 WHEN 'Intent' THEN 3 WHEN 'Intent desmuntat' THEN 4 ELSE 99 END"
_BIG = "item_name NOT IN ('P1', 'P2', 'P3', 'P4', 'P5') AND NOT regexp_matches(lower(regexp_replace(item_name, '[ -]', '', 'g')), '^p1[012]')"
_WRONG = {
    "vals": 'SELECT "full", min(code) AS code FROM sc GROUP BY 1',
    "near": 'SELECT a."full" AS p, b.code, row_number() OVER (PARTITION BY a."full" ORDER BY abs(b."full" - a."full"), b."full") AS rn FROM vals a JOIN vals b ON a."full" <> b."full" AND abs(b."full" - a."full") <= greatest(200, floor(a."full" * 0.2)) QUALIFY rn <= 3',
    "wrongs": "SELECT p, string_agg(code, ',' ORDER BY rn) AS wrong, min_by(code, rn) AS other FROM near GROUP BY p",
}
_EVENTS = {
    "t4": "SELECT event_id, group_id, group_name, event_name, event_date, event_year, sum(points)::BIGINT AS top FROM (SELECT *, row_number() OVER (PARTITION BY event_id, group_id ORDER BY points DESC, attempt_id) AS rn FROM perf) WHERE rn <= 4 GROUP BY ALL",
    "evs": "SELECT *, row_number() OVER (PARTITION BY group_id, event_year ORDER BY top DESC, event_date, event_id) AS place FROM t4 QUALIFY place <= 4",
    "its": f"SELECT event_id, group_id, item_name, arg_min(status, {_PRIO}) AS status, max(points) AS points, max(item_code) AS item_code FROM perf WHERE {_BIG} GROUP BY event_id, group_id, item_name",
}
_ARR = lambda *x: "[" + ", ".join(f"(({v}) % 6)" for v in x) + "]"
_CH, _RI = f"list_distinct({_ARR('event_id', 'event_id + 2', 'event_id * 3')})", f"list_distinct({_ARR('event_id', 'event_id + 1')})"

SQL = {
    "quiz_dictionaries": R("ranges", "oe", "sc") + "SELECT 'groups_active' AS dictionary, group_name AS key, min_year || '|' || max_year || '|' || year_range || '|' || num_years || '|' || total_events AS value FROM ranges UNION ALL SELECT 'groups_founded', n_name, (n_nationkey + 1900) || '|color ' || n_nationkey % 6 || '|#fff' FROM nation UNION ALL SELECT DISTINCT 'contest_days', year(event_date)::VARCHAR, day FROM oe UNION ALL SELECT 'item_points', code, external || '|' || \"full\" || '|' || partial || '|2' FROM sc",
    "quiz_best_event": R("totals") + f", t AS (SELECT *, year(event_date)::INTEGER AS y, row_number() OVER (PARTITION BY group_id, year(event_date) ORDER BY total_points DESC, event_date, event_id) AS rn FROM totals QUALIFY rn <= 4) SELECT group_name, y AS year, max(CASE WHEN rn = 1 THEN {_LABEL} END) AS correct, string_agg(CASE WHEN rn > 1 THEN {_LABEL} END, '; ' ORDER BY rn) AS wrong FROM t GROUP BY group_name, y HAVING count(*) > 1",
    "best_item_unique": R("perf") + f"SELECT group_name, event_year, item_name, status, points FROM perf QUALIFY row_number() OVER (PARTITION BY group_name, event_year, item_name ORDER BY points DESC, {_PRIO}, attempt_id) = 1",
    "distractors": R("sc", **_WRONG) + 'SELECT code, "full", wrong FROM sc JOIN wrongs ON p = "full"',
    "similar_items": R("perf", "sc") + f", b AS (SELECT group_name || '|' || event_year AS key, item_name, status, points, row_number() OVER (PARTITION BY group_name, event_year ORDER BY points DESC, item_name) AS rn FROM (SELECT group_name, event_year, item_name, status, points FROM perf QUALIFY row_number() OVER (PARTITION BY group_name, event_year, item_name ORDER BY points DESC, {_PRIO}, attempt_id) = 1) WHERE points > 0 QUALIFY rn <= 4), v AS (SELECT key, avg(points) AS average FROM b GROUP BY key), w AS (SELECT key, average, greatest(0, average - greatest(200, floor(average * 0.2))) AS lo, average + greatest(200, floor(average * 0.2)) AS hi FROM v), n AS (SELECT key, average, external AS code, CASE WHEN \"full\" BETWEEN lo AND hi THEN 'Descarregat' ELSE 'Carregat' END AS st FROM w JOIN sc ON \"full\" BETWEEN lo AND hi OR partial BETWEEN lo AND hi WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.key = w.key AND lower(b.item_name) = lower(external)) QUALIFY row_number() OVER (PARTITION BY key ORDER BY external) <= 2) SELECT key, round(average, 6) AS average, string_agg(code || ' (' || st || ')', ', ' ORDER BY code) AS similar FROM n GROUP BY key, average",
    "quiz_performance": R("perf", **_EVENTS) + ", li AS (SELECT event_id, group_id, string_agg(item_name || ' (' || status || ')', ', ' ORDER BY points DESC, item_name) AS items FROM its GROUP BY ALL), g AS (SELECT group_id, group_name, event_year, min_by(event_id, place) AS event_id, max(CASE WHEN place = 1 THEN event_name || ' (' || event_date || ')' END) AS correct, string_agg(CASE WHEN place > 1 THEN event_name || ' (' || event_date || ')' END, '; ' ORDER BY place) AS wrong FROM evs GROUP BY ALL) SELECT group_name, event_year, items, correct, wrong FROM g JOIN li USING (event_id, group_id)",
    "quiz_multi": R("perf", **_EVENTS, **_WRONG) + ", f AS (SELECT i.*, group_name, row_number() OVER (PARTITION BY i.event_id, i.group_id ORDER BY i.points DESC, item_name) AS rn FROM its i JOIN evs e USING (event_id, group_id) WHERE place <= 3 AND item_code IS NOT NULL QUALIFY rn <= 4) SELECT group_name, event_id, string_agg(item_name || ' (' || status || ')', ', ' ORDER BY rn) AS \"right\", string_agg(CASE WHEN rn <= 2 THEN item_name || ' (' || CASE WHEN status = 'Descarregat' THEN 'Carregat' ELSE 'Descarregat' END || ')' ELSE other || ' (' || status || ')' END, ', ' ORDER BY rn) AS wrong FROM f JOIN sc ON code = item_code LEFT JOIN wrongs ON p = \"full\" GROUP BY group_name, event_id HAVING count(*) = 4",
    "first_groups": R("perf") + "SELECT item_code, row_number() OVER (PARTITION BY item_code ORDER BY d, e, group_name) AS place, group_name, d AS date FROM (SELECT item_code, group_name, min(event_date) AS d, arg_min(event_id, struct_pack(d := event_date, e := event_id)) AS e FROM perf WHERE item_code IS NOT NULL GROUP BY ALL) QUALIFY place <= 4",
    "quiz_first_group": R("perf", "ranges") + ", f AS (SELECT event_year, item_code, group_name, min(event_date) AS d, arg_min(event_id, struct_pack(d := event_date, e := event_id)) AS e, bool_or(status = 'Descarregat') AS c FROM perf WHERE item_code IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_year, item_code ORDER BY d, e, group_name) AS place, bool_or(c) OVER (PARTITION BY event_year, item_code) AS done FROM f), q AS (SELECT event_year, item_code, list(group_name ORDER BY place) FILTER (place <= 4) AS names FROM r WHERE done GROUP BY ALL), y AS (SELECT group_name, unnest(range(min_year, max_year + 1)) AS event_year FROM ranges), m AS (SELECT event_year, list(group_name ORDER BY length(group_name) % 4 DESC, group_name) AS more FROM y GROUP BY ALL) SELECT event_year, item_code, names[1] AS correct, array_to_string(list_concat(names[2:4], list_filter(list_concat(coalesce(more, []), FILL), lambda x: NOT list_contains(names, x)))[1:3], ', ') AS wrong FROM q LEFT JOIN m USING (event_year)".replace("FILL", str(list(quiz.FILL_GROUPS))),
    "quiz_performance_options": R("perf", **_EVENTS) + ", li AS (SELECT event_id, group_id, string_agg(item_name || ' (' || status || ')', ', ' ORDER BY points DESC, item_name) AS items FROM its GROUP BY ALL), n AS (SELECT e.*, CASE WHEN contains(e.event_name, city) THEN e.event_name ELSE e.event_name || ', ' || city END AS label FROM evs e JOIN ev USING (event_id)), g AS (SELECT group_id, group_name, event_year, min_by(event_id, place) AS event_id, list(label ORDER BY place) AS names FROM n GROUP BY ALL) SELECT group_name, event_year, items, group_name || ', ' || names[1] || ' (' || event_year || ')' AS correct, array_to_string(list_concat(list_transform(names[2:4], lambda x: group_name || ', ' || x || ' (' || event_year || ')'), list_transform([-1, 1, -2], lambda o: group_name || ', ' || names[1] || ' (' || (event_year + o) || ')'))[1:3], '; ') AS wrong FROM g JOIN li USING (event_id, group_id)",
    "quiz_attribute": R("perf") + ", v AS (SELECT 'colour' AS kind, group_name, 'colour ' || group_id % 6 AS value FROM grp UNION ALL SELECT 'founded', group_name, (min(event_year) - min(group_id) % 5)::VARCHAR FROM perf GROUP BY group_name), a AS (SELECT kind, list_sort(list(DISTINCT value)) AS vals FROM v GROUP BY kind) SELECT kind, group_name, value AS correct, array_to_string(list_filter(vals, lambda x: x <> value)[1:3], ', ') AS wrong FROM v JOIN a USING (kind)",
    "quiz_counts": R("perf") + f", c AS (SELECT group_name, event_year, item_name, count_if(status = 'Descarregat') AS f, count_if(status = 'Carregat') AS l FROM perf WHERE {_BIG} GROUP BY ALL), a AS (SELECT group_name, event_year, item_name, CASE WHEN f > 0 THEN 'Descarregat' ELSE 'Carregat' END AS status, CASE WHEN f > 0 THEN f ELSE l END AS answer FROM c) SELECT *, CASE WHEN answer <= 2 THEN 0 WHEN answer <= 9 THEN 1 ELSE 2 END AS margin, answer + 5 + answer % 16 AS slider_max FROM a WHERE answer > 0",
    "quiz_ordering": R("perf", **{k: v for k, v in _RANKED.items() if k in ("tot", "ranked")}) + "SELECT year, day, count(*) AS n, string_agg(group_name, ' > ' ORDER BY position) AS names FROM (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY year, day ORDER BY position) <= 10) GROUP BY ALL HAVING count(*) >= 3",
    "quiz_scoring": f"WITH a AS (SELECT user_id, event_id, abs(event_id % 20 - event_id % 17) AS off, event_id % 4 AS m, {_CH} AS ch, {_RI} AS ri FROM events), r AS (SELECT user_id, round(CASE WHEN off = 0 THEN 1.0 WHEN m > 0 AND off <= m THEN greatest(0.1, 0.9 - off::DOUBLE / m * 0.8) ELSE 0 END::DOUBLE, 6) AS slider, round(greatest(0, len(list_intersect(ch, ri))::DOUBLE / len(ri) - (len(ch) - len(list_intersect(ch, ri)))::DOUBLE / len(ri) * 0.5), 6) AS multi, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS ordering FROM a) SELECT user_id, round(sum(slider), 4) AS slider, round(sum(multi), 4) AS multi, round(sum(ordering), 4) AS ordering, floor(sum(slider + multi + ordering) / (count(*) * 3) * 100 + 0.5)::INTEGER AS percent, CASE WHEN percent >= 80 THEN 'excellent' WHEN percent >= 50 THEN 'good' ELSE 'again' END AS band FROM r GROUP BY user_id",
}
