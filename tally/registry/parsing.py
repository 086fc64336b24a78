"""Cleaning and parsing queries. Questions are user turns, put in the words of a dozen fixed forms, and as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.functions import parse
from tally.functions.tables import DISPLAY_NAMES, SYNONYMS
from tally.operators import linking, pages, text
from tally.plans import roles
from tally.registry.sqlroles import roles as R

#: Forms of questions; {g} is a group, {y} a year, {s} its last two digits, {h} a height.
FORMS = (
    "Quina va ser la millor diada de {g} l'any {y}?",
    "quants 3 de 9 amb folre i manilles han descarregat {g} del {s}",
    "torre de 6 i pilar de 5 carregat",
    "pilar de {h} intent desmuntat",
    "dos de set amb manilles",
    "tres de nou amb folre i manilles fet amb agulla",
    "qui ets i quin llm fas servir",
    "qui va guanyar el concurs de castells {y} - 1997",
    "castells de 8 i gamma extra dels anys 80 a la Fira Asia",
    "segle xix i anys noranta a {g}",
    "4D9 amb folre i agulla de {g} aconseguit",
    "I els {g} de l'any {y}?",
)
#: The events of the tables are regions.
EVENT_WORDS = (("asia", ("Fair ASIA",)), ("europa", ("Fair EUROPE",)), ("africa", ("Fair AFRICA",)), ("america", ("Fair AMERICA",)), ("orient", ("Fair MIDDLE EAST",)))
_values = {"g": "'NATION_' || conv_id % 25", "y": "(1995 + conv_id % 7)", "s": "lpad((conv_id % 90 + 10)::VARCHAR, 2, '0')", "h": "(conv_id % 5 + 4)"}


def _form_sql(form: str) -> str:
    out = "'" + form.replace("'", "''") + "'"
    for key, value in _values.items():
        out = out.replace("{" + key + "}", f"' || {value} || '")
    return out


ASKED = "asked AS (SELECT conv_id * 1000 + turn AS qid, conv_id AS session, turn, CASE (conv_id + turn // 2) % 12 " + " ".join(f"WHEN {k} THEN {_form_sql(f)}" for k, f in enumerate(FORMS)) + " END AS text FROM conversations WHERE role = 'user')"


def asked(s, d):
    q = roles.questions(s, d)
    values = {"g": F.concat(F.lit("NATION_"), (F.col("session") % 25).cast("string")), "y": (F.col("session") % 7 + 1995).cast("string"), "s": (F.col("session") % 90 + 10).cast("string"), "h": (F.col("session") % 5 + 4).cast("string")}
    form = F.element_at(F.array(*map(F.lit, FORMS)), ((F.col("session") + F.floor(F.col("turn") / 2)) % len(FORMS) + 1).cast("int"))
    for key, value in values.items():
        form = F.replace(form, F.lit("{" + key + "}"), value)
    return q.select("qid", "session", "turn", form.alias("text"))


#: The forms and, with numbers of their own, what the turns really say.
SPOKEN = ASKED + ", spoken AS (SELECT * FROM asked UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, conv_id, turn, text FROM conversations WHERE role = 'user')"


def spoken(s, d):
    return asked(s, d).union(roles.questions(s, d).select(F.col("qid") + 1_000_000_000, "session", "turn", "text"))


def _each(parser):
    return lambda s, d: spoken(s, d).select("qid", "text", parser(F.col("text")).alias("value"))


def _entities(s, d):
    """Entities as they are asked for: as they are, in small letters, with accents, and unknown."""
    g = F.concat(F.lit("NATION_"), (F.col("session") % 25).cast("string"))
    form = F.col("session") % 4
    return asked(s, d).select("qid", F.when(form == 0, g).when(form == 1, F.lower(g)).when(form == 2, F.concat(F.lit("Nàtìon_"), (F.col("session") % 25).cast("string"))).otherwise("Nobody").alias("entity"))


def _names(s, d, column="group_name"):
    return (roles.groups(s, d) if column == "group_name" else roles.events(s, d)).select(F.col(column).alias("name")).distinct()


def follow_up(s, d):
    a = asked(s, d).withColumns({"template": linking.classify_by_phrase(F.col("text")), "group_name": F.nullif(F.regexp_extract("text", "(NATION_[0-9]+)", 1), F.lit("")), "years": parse.years(F.col("text"))})
    return linking.follow_ups(a)


def _routed(s, d):
    """Questions with the route that they were given, and what they name."""
    route = F.element_at(F.array(*map(F.lit, ("sql", "hybrid", "rag", "direct"))), (F.col("session") % 4 + 1).cast("int"))
    return spoken(s, d).select("*", route.alias("route"), F.contains("text", F.lit("NATION")).alias("has_entities"), (F.col("turn") % 4 == 0).alias("has_places_in_contest"))


def _codes(s, d):
    return s.createDataFrame([(c,) for c in DISPLAY_NAMES], "name string")


def _asked_items(s, d):
    """Items as they are asked for: codes, codes with "de", unknown ones, with outcomes that exist or not."""
    k = (F.col("session") + F.col("turn")) % 5
    code = F.when(k == 0, "3d9f").when(k == 1, "3de10").when(k == 2, "9de9").when(k == 3, "12d12").otherwise("4d8")
    return asked(s, d).select("qid", code.alias("code"), F.when(F.col("session") % 3 == 0, roles.COMPLETE).when(F.col("session") % 3 == 1, "Caigut").alias("status"))


def entity_checks(s, d):
    """The years, cities and events that questions name, of which only those stay that events have."""
    e = roles.events(s, d)
    kind = lambda rows, name, value: rows.select(F.lit(name).alias("kind"), value.cast("string").alias("value"))
    known = kind(e, "year", F.year("event_date")).union(kind(e, "city", F.col("city"))).union(kind(e, "event", F.col("event_name"))).distinct()
    one = lambda name, value: F.struct(F.lit(name).alias("kind"), value.cast("string").alias("value"))
    city = F.element_at(F.array(*map(F.lit, ("ASIA", "Asia", "EUROPE", "ATLANTIS"))), (F.col("session") % 4 + 1).cast("int"))
    named = asked(s, d).select("qid", F.explode(F.array(one("year", F.col("session") % 20 + 1985), one("city", city), one("event", F.concat(F.lit("Fair "), city)))).alias("v")).select("qid", "v.*")
    return linking.known_values(named, known)


def _raw_event(s, d):
    """Events as scraped: date, time, place and city run together, and names glued to places."""
    e = roles.events(s, d)
    low = F.initcap("city")
    return e.select("event_id", F.concat(F.date_format("event_date", "dd/MM/yyyy"), F.when(F.col("event_id") % 3 == 0, "").otherwise("09:30"), F.lit("Plaça Vella"), low).alias("place_raw"), F.concat(F.lit("Sant Fèlix a Vila"), F.lit("Diada de "), low).alias("name_raw"))


QUERIES = {
    "parse_item_code": _each(parse.item_code),
    "parse_years": lambda s, d: spoken(s, d).select("qid", F.array_join(parse.years(F.col("text")), ",").alias("value")),
    "parse_status": _each(parse.status),
    "detect_tier": _each(parse.tier),
    "synonym_rewrite": _each(parse.rewrite_synonyms),
    "guard_flags": lambda s, d: roles.questions(s, d).select("qid", parse.guard_flags(F.col("text")).alias("g")).select("qid", "g.*").unionByName(asked(s, d).select((F.col("qid") + 1_000_000_000).alias("qid"), parse.guard_flags(F.col("text")).alias("g")).select("qid", "g.*")),
    "decade_expand": lambda s, d: spoken(s, d).select("qid", F.array_join(parse.decades(F.col("text")), ",").alias("years")),
    "clean_text": lambda s, d: roles.chat(s, d).select("session", "turn", parse.clean_answer(F.concat(F.lit("| a | b |\n|--|--|\n"), F.coalesce("text", F.lit("")), F.lit("  , end ."))).alias("text")),
    "parse_place_city": lambda s, d: _raw_event(s, d).select("event_id", parse.place_city(F.col("place_raw")).alias("p")).select("event_id", "p.*"),
    "parse_result": lambda s, d: roles.attempts(s, d).select("attempt_id", parse.result(F.concat(F.lit(" "), "item_name", F.lit(" ("), "status", F.lit(") "))).alias("r")).select("attempt_id", "r.*"),
    "parse_event_name": lambda s, d: _raw_event(s, d).select("event_id", parse.event_name(F.col("name_raw")).alias("name")),
    "text_categorize": lambda s, d: roles.table(s, d, "documents").select("doc_id", parse.categorize(F.col("text"), (*parse.CATEGORIES, ("english", ("THE ",)), ("german", ("DER ", "UND ")), ("french", ("LES ",)))).alias("category")),
    "text_sections": lambda s, d: text.sections(roles.table(s, d, "documents"), r"^[^ ]+\.$"),
    "entity_validate": lambda s, d: linking.validate(_entities(s, d), _names(s, d)),
    "follow_up": follow_up,
    "classify_question": lambda s, d: linking.classify(_routed(s, d)),
    "template_inherit": lambda s, d: linking.inherit_template(asked(s, d).select("qid", "session", "turn", linking.classify_by_phrase(F.col("text")).alias("template"))),
    "link_items": lambda s, d: linking.link_items(spoken(s, d), _codes(s, d)),
    "link_cities": lambda s, d: linking.link_cities(spoken(s, d), _names(s, d, "city")),
    "item_repair": lambda s, d: linking.repair_items(_asked_items(s, d), _codes(s, d)),
    "entity_checks": entity_checks,
    "fuzzy_link": lambda s, d: linking.fuzzy_link(spoken(s, d), _names(s, d)),
    "link_events": lambda s, d: linking.link_events(spoken(s, d), _names(s, d, "event_name"), words=EVENT_WORDS),
    "page_extract": lambda s, d: pages.extract(roles.table(s, d, "pages")),
    "page_links": lambda s, d: pages.links(roles.table(s, d, "pages")),
}

_W = "WITH " + ASKED + " "
_SPOKEN = "WITH " + SPOKEN + " "
_num = lambda x: "CASE " + x + " " + " ".join(f"WHEN '{w}' THEN '{n}'" for w, n in parse.NUMBERS.items()) + " END"


def _chain() -> str:
    """Seeking the words of parts one after another, as nested selects."""
    sql = "SELECT *, rest AS r0, '' AS c0 FROM b"
    for k, (word, code) in enumerate(parse.PARTS):
        sql = f"SELECT *, CASE WHEN contains(r{k}, '{word}') THEN regexp_replace(r{k}, '{word}', '') ELSE r{k} END AS r{k + 1}, CASE WHEN contains(r{k}, '{word}') THEN c{k} || '{code}' ELSE c{k} END AS c{k + 1} FROM ({sql})"
    return sql


_N = len(parse.PARTS)
_ITEM = _SPOKEN + f""", a AS (SELECT qid, text, lower(trim(text)) AS t FROM spoken),
b AS (SELECT *, {_num(r"regexp_extract(t, '([a-z]+)\s+de\s+([a-z]+)', 1)")} AS width, regexp_extract(t, '([a-z]+)\\s+de\\s+([a-z]+)', 2) AS w2,
  trim(CASE WHEN width IS NOT NULL THEN regexp_replace(t, '(?s)^.*?[a-z]+\\s+de\\s+[a-z]+', '') ELSE regexp_replace(t, '(?s)^.*?[0-9]+\\s+de\\s+[0-9]+', '') END) AS rest FROM a),
c AS ({_chain()})
SELECT qid, text, CASE
  WHEN regexp_extract(t, '\\b([0-9]+d[0-9]+[afms]*)\\b', 1) <> '' THEN regexp_extract(t, '\\b([0-9]+d[0-9]+[afms]*)\\b', 1)
  WHEN regexp_extract(t, 'torre\\s+de\\s+([0-9]+)', 1) <> '' THEN '2d' || regexp_extract(t, 'torre\\s+de\\s+([0-9]+)', 1)
  WHEN regexp_extract(t, 'pilar\\s+de\\s+([0-9]+)', 1) <> '' THEN 'Pd' || regexp_extract(t, 'pilar\\s+de\\s+([0-9]+)', 1)
  WHEN width IS NOT NULL THEN width || 'd' || coalesce({_num("w2")}, w2) || CASE WHEN contains(c{_N}, 'f') THEN 'f' ELSE '' END || CASE WHEN contains(c{_N}, 'f') AND contains(c{_N}, 'm') THEN 'm' ELSE '' END || CASE WHEN contains(c{_N}, 'f') AND contains(c{_N}, 'm') AND contains(c{_N}, 'p') THEN 'p' ELSE '' END || regexp_replace(c{_N}, '[^a]', '', 'g') || CASE WHEN contains(c{_N}, 's') THEN 's' ELSE '' END
  WHEN regexp_extract(t, '([0-9]+)\\s+de\\s+([0-9]+)', 1) <> '' THEN regexp_extract(t, '([0-9]+)\\s+de\\s+([0-9]+)', 1) || 'd' || regexp_extract(t, '([0-9]+)\\s+de\\s+([0-9]+)', 2) || array_to_string(list_sort(string_split(c{_N}, '')), '')
  ELSE '' END AS value FROM c"""


def _synonyms_sql() -> str:
    out = "text"
    for old, new in sorted(SYNONYMS.items(), key=lambda p: -len(p[0])):
        out = f"regexp_replace({out}, '{old}', '{new}', 'gi')"
    return out


def _contains_any(column: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


def _cases(column: str, groups, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {_contains_any(column, words)} THEN '{name}'" for name, words in groups) + f" ELSE {default} END"


_STATUS = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(text)), '\\b{w}\\b') THEN '{v}'" for w, v in parse.STATUS_WORDS) + " END"
_YEARS = r"list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(lower(text), '\b((?:19|20)[0-9]{2})\b', 1), lambda x: x::INTEGER), list_transform(regexp_extract_all(lower(text), '\bdels?\s+([0-9]{2})\b', 1), lambda x: CASE WHEN x::INTEGER <= 30 THEN 2000 + x::INTEGER ELSE 1900 + x::INTEGER END))))[1:5]"
_GUARD = lambda t: f"{_contains_any(f'lower({t})', parse.OFF_TOPIC)} AS off_topic, len(regexp_extract_all({t}, '([^ \\t\\r\\n]+)')) > 25 AS too_long"
_DEC = "concat_ws(','" + "".join(f", CASE WHEN regexp_matches(lower(text), '{p}') THEN array_to_string(range({a}, {b}), ',') END" for p, a, b in [*[(rf"\bany[s]?\s*{x}\b|\bdècada.*{x}\b|anys\s*{n}", 1900 + x, 1910 + x) for x, n in ((80, "vuitanta"), (70, "setanta"), (90, "noranta"), (60, "seixanta"), (50, "cinquanta"))], *[(rf"\bsegle\s*{r}\b|segle\s*{n}", 100 * n - 100, 100 * n) for n, r in ((18, "xviii"), (19, "xix"), (20, "xx"))]]) + ")"
_CATS = [*parse.CATEGORIES, ("english", ("THE ",)), ("german", ("DER ", "UND ")), ("french", ("LES ",))]
_TEMPLATE = _cases("lower(text)", linking.TEMPLATES.items())
_RAWS = ", raws AS (SELECT event_id, strftime(event_date, '%d/%m/%Y') AS ds, event_id % 3 = 0 AS untimed, upper(left(city, 1)) || lower(substr(city, 2)) AS low, city FROM ev)"

SQL = {
    "parse_item_code": _ITEM,
    "parse_years": _SPOKEN + f"SELECT qid, array_to_string({_YEARS}, ',') AS value FROM spoken",
    "parse_status": _SPOKEN + f"SELECT qid, text, {_STATUS} AS value FROM spoken",
    "detect_tier": _SPOKEN + f"SELECT qid, text, {_cases('lower(text)', parse.TIER_WORDS)} AS value FROM spoken",
    "synonym_rewrite": _SPOKEN + f"SELECT qid, text, {_synonyms_sql()} AS value FROM spoken",
    "guard_flags": _W + f"SELECT conv_id * 1000 + turn AS qid, {_GUARD('text')} FROM conversations WHERE role = 'user' UNION ALL SELECT qid + 1000000000, {_GUARD('text')} FROM asked",
    "decade_expand": _SPOKEN + f"SELECT qid, {_DEC} AS years FROM spoken",
    "clean_text": r"SELECT conv_id AS session, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(coalesce(text, '') || '  , end .', chr(10)), lambda x: length(x) - length(replace(x, '|', '')) < 2), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '\s{2,}', ' ', 'g'), '\s+\.', '.', 'g'), '\s+,', ',', 'g'), '^\s+|\s+$', '', 'g') AS text FROM conversations",
    "parse_place_city": R("ev") + _RAWS + " SELECT event_id, ds AS date, CASE WHEN NOT untimed THEN '09:30' END AS time, 'Plaça Vella' AS place, CASE WHEN contains(city, ' ') THEN 'Middle East' ELSE low END AS city FROM raws",
    "parse_result": R("att") + "SELECT attempt_id, item_name, status FROM att",
    "parse_event_name": R("ev") + _RAWS + " SELECT event_id, 'Diada de ' || CASE WHEN contains(city, ' ') THEN 'Middle East' ELSE low END AS name FROM raws",
    "text_categorize": f"SELECT doc_id, {_cases('upper(text)', _CATS, chr(39) + 'other' + chr(39))} AS category FROM documents",
    "text_sections": r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), m AS (SELECT *, regexp_matches(trim(line), '^[^ ]+\.$') AS head FROM l), f AS (SELECT *, last_value(CASE WHEN head THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS category FROM m) SELECT doc_id, n AS line_number, category, trim(line) AS text FROM f WHERE NOT head AND trim(line) <> ''",
    "entity_validate": _W + ", e AS (SELECT qid, CASE session % 4 WHEN 0 THEN 'NATION_' || session % 25 WHEN 1 THEN 'nation_' || session % 25 WHEN 2 THEN 'Nàtìon_' || session % 25 ELSE 'Nobody' END AS entity FROM asked) SELECT qid, entity, n_name AS name FROM e LEFT JOIN nation ON lower(strip_accents(entity)) = lower(n_name)",
    "template_inherit": _W + f"SELECT qid, session, turn, coalesce({_TEMPLATE}, last_value({_TEMPLATE} IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS template FROM asked",
    "item_repair": _W + "SELECT qid, code, CASE code WHEN '3de10' THEN '3d10fm' WHEN '9de9' THEN '9d9f' ELSE code END AS item, status FROM (SELECT qid, CASE (session + turn) % 5 WHEN 0 THEN '3d9f' WHEN 1 THEN '3de10' WHEN 2 THEN '9de9' WHEN 3 THEN '12d12' ELSE '4d8' END AS code, CASE WHEN session % 3 = 0 THEN 'Descarregat' END AS status FROM asked)",
    "entity_checks": R("ev") + f", {ASKED}, v AS (SELECT qid, session, ['ASIA', 'Asia', 'EUROPE', 'ATLANTIS'][session % 4 + 1] AS city FROM asked) SELECT qid, 'year' AS kind, (session % 20 + 1985)::VARCHAR AS value FROM v WHERE session % 20 + 1985 IN (SELECT year(event_date) FROM ev) UNION ALL SELECT qid, 'city', city FROM v WHERE city IN (SELECT city FROM ev) UNION ALL SELECT qid, 'event', 'Fair ' || city FROM v WHERE 'Fair ' || city IN (SELECT event_name FROM ev)",
    "follow_up": _W + f", a AS (SELECT *, {_TEMPLATE} AS tpl, nullif(regexp_extract(text, '(NATION_[0-9]+)', 1), '') AS g, {_YEARS} AS y FROM asked), p AS (SELECT *, lag(text) OVER w AS pt, lag(tpl) OVER w AS pp, lag(g) OVER w AS pg, lag(y) OVER w AS py FROM a WINDOW w AS (PARTITION BY session ORDER BY turn)), f AS (SELECT *, coalesce(pp IS NOT NULL AND length(text) < 50 AND (" + " OR ".join("starts_with(lower(trim(text)), '{}')".format(x.replace("'", "''")) for x in parse.FOLLOW_UP) + ") AND (g IS NOT NULL OR len(y) > 0), false) AS is_follow_up FROM p) SELECT qid, session, turn, is_follow_up, CASE WHEN is_follow_up THEN pp ELSE tpl END AS template, CASE WHEN is_follow_up THEN coalesce(g, pg) ELSE g END AS group_name, array_to_string(CASE WHEN is_follow_up AND len(y) = 0 THEN py ELSE y END, ',') AS years, CASE WHEN length(pt) > 30 THEN substr(pt, 1, 30) || '...' ELSE pt END AS context FROM f",
    "page_links": r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)) AS href FROM pages), k AS (SELECT page_id, href, lower(regexp_extract(href, '^https?://([^/]+)', 1)) AS host FROM h) SELECT page_id, CASE WHEN host = '' THEN 'internal' WHEN contains(host, 'instagram') THEN 'instagram' WHEN contains(host, 'facebook') THEN 'facebook' WHEN contains(host, 'twitter') OR contains(host, 'x.com') THEN 'twitter' WHEN contains(host, 'youtube') THEN 'youtube' WHEN contains(host, 'wikipedia') THEN 'wikipedia' ELSE 'other' END AS kind, count(DISTINCT href) AS links FROM k GROUP BY ALL""",
}
