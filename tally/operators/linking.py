"""Linking questions to dictionary entries, templates and what was asked before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.functions import fuzzy, parse
from tally.functions.tables import TEMPLATES
from tally.operators import fuzzy_join
from tally.plans.roles import STATUSES

SUBSTRING_SCORE = 0.8
#: The least score of a template by the route that a question was given: one that is not for reports needs more.
LEAST_SCORES = {"sql": 0.3, "hybrid": 0.3, "rag": 0.8, "direct": 0.85}
#: The least token-set ratio of an entity to the entry that repairs it.
LEAST_TOKEN_SET = 75.0
#: Words that stand for events whatever their full name. Fixed values.
EVENT_WORDS = (
    ("sant magi", ("Diada de Sant Magí a Tarragona",)),
    ("sant magí", ("Diada de Sant Magí a Tarragona",)),
    ("santa tecla", ("Diada de Santa Tecla a Tarragona",)),
    ("merce", ("Diada de la Mercè a Barcelona", "Diada de la Mercè (colles convidades) a Barcelona")),
    ("mercè", ("Diada de la Mercè a Barcelona", "Diada de la Mercè (colles convidades) a Barcelona")),
    ("sant felix", ("Diada de Sant Fèlix a Vilafranca del Penedès",)),
    ("sant fèlix", ("Diada de Sant Fèlix a Vilafranca del Penedès",)),
    ("sant ramon", ("Diada de Sant Ramon a Vilafranca del Penedès",)),
    ("les santes", ("Les Santes a Mataró",)),
    ("tots sants", ("Diada de Tots Sants a Vilafranca del Penedès",)),
    ("sant narcis", ("Diada de Sant Narcís a Girona",)),
    ("sant narcís", ("Diada de Sant Narcís a Girona",)),
    ("santa ursula", ("Diada de Santa Úrsula a Valls",)),
    ("santa úrsula", ("Diada de Santa Úrsula a Valls",)),
    ("les neus", ("Diada de les Neus de Vilanova i la Geltrú",)),
    ("santa teresa", ("Diada de Santa Teresa al Vendrell",)),
    ("mercadal", ("Diada del Mercadal a Reus",)),
)
#: Words that say nothing about which event is meant. Fixed values.
EVENT_STOP_WORDS = (
    "diada", "diades", "actuació", "actuacions", "actuacio", "castellers", "casteller", "castell", "castells", "colla", "colles", "jornada", "jornades",
    "millor", "millors", "pitjor", "primera", "primer", "última", "últim", "quina", "quin", "quines", "quins", "quan", "quant", "quantes", "quants",
    "historia", "història", "temporada", "any", "anys", "part", "llarg", "estat", "sido", "fer", "fet", "feta", "fets",
    "dels", "les", "els", "per", "que", "com", "amb", "una", "uns",
)


def classify_by_phrase(question: Column) -> Column:
    """The first template with a phrase that the question contains."""
    text = F.lower(question)
    tests = [(reduce(lambda a, b: a | b, [text.contains(p) for p in phrases]), name) for name, phrases in TEMPLATES.items()]
    return parse._first(tests)


def classify(questions: DataFrame) -> DataFrame:
    """(qid, template, score): the template of the most similar phrase of those that score enough; one that is
    contained counts as 0.8 at least, and of equal templates the first counts. The phrases are a fixed dictionary.

    Optional columns: route (sql, hybrid, rag or direct; sql if absent), has_entities (questions that are not for
    reports are matched only if they name something) and has_places_in_contest (days or positions turn the history of
    contests into their ranking). Only phrases whose length lets them beat what is contained are compared letter by letter."""
    spark = questions.sparkSession
    listed = [(k, n, p) for k, (n, ps) in enumerate(TEMPLATES.items()) for p in ps]
    phrases = spark.createDataFrame(listed, "place int, template string, phrase string")
    given = lambda name, default: F.coalesce(F.col(name), default) if name in questions.columns else default
    route, named, ranked = given("route", F.lit("sql")), given("has_entities", F.lit(True)), given("has_places_in_contest", F.lit(False))
    least = F.coalesce(*[F.when(route == r, v) for r, v in LEAST_SCORES.items()], F.lit(LEAST_SCORES["sql"]))
    asked = questions.select("qid", F.lower("text").alias("text"), least.alias("least"), route.isin("rag", "direct").alias("strict"), named.alias("named"), ranked.alias("ranked"))
    texts = asked.select("text").filter("text IS NOT NULL").distinct()
    pairs = texts.crossJoin(F.broadcast(phrases)).withColumn("inside", F.contains("text", "phrase"))
    contained = pairs.groupBy("text").agg(F.max(F.when(F.col("inside"), SUBSTRING_SCORE)).alias("sure"))
    bound = 2 * F.least(F.length("text"), F.length("phrase")) / (F.length("text") + F.length("phrase"))
    open_ = pairs.join(contained, "text").filter(bound >= F.coalesce("sure", F.lit(min(LEAST_SCORES.values()))))
    alike = open_.select("text", "place", "template", fuzzy.sequence_ratio("text", "phrase").alias("score"))
    scored = pairs.filter("inside").select("text", "place", "template", F.lit(SUBSTRING_SCORE).alias("score")).union(alike)
    best = scored.groupBy("text").agg(F.max(F.struct("score", (-F.col("place")).alias("first"), "template")).alias("b"))
    joined = asked.join(best, "text", "left")
    template = F.when((F.col("b.template") == "contest_history") & F.col("ranked"), "contest_ranking").otherwise(F.col("b.template"))
    enough = (F.col("b.score") >= F.col("least")) & (~F.col("strict") | F.col("named"))
    return joined.select("qid", F.when(enough, template).alias("template"), F.when(F.col("b.score") >= LEAST_SCORES["sql"], F.col("b.score")).alias("score"))


def inherit_template(asked: DataFrame) -> DataFrame:
    """asked (qid, session, turn, template) with the last template of the session where a question has none."""
    before = Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return asked.withColumn("template", F.coalesce("template", F.last("template", ignorenulls=True).over(before)))


def fuzzy_link(questions: DataFrame, names: DataFrame, least: float = 85.0, most: int = 5) -> DataFrame:
    """(qid, name, score, rank): for each question the `most` names of the dictionary that fit it best, by partial ratio
    from `least` on.

    Each different question is compared with the names that share enough with it for the ratio (fuzzy_join), so nothing is lost."""
    asked = F.lower("text").alias("asked")
    top = fuzzy_join.best_names(questions.select(asked), names, least, most)
    return questions.select("qid", asked).join(top, "asked").select("qid", "name", "score", "rank")


def link_items(questions: DataFrame, codes: DataFrame, most: int = 3) -> DataFrame:
    """(qid, code, status, score): the item that a question names by its rules, else the codes that fit it best from a
    ratio of 30 on; with the outcome that the question asks for."""
    read = questions.select("qid", "text", parse.item_code(F.col("text")).alias("code"), parse.status(F.col("text")).alias("status"))
    direct = read.filter("code <> ''").select("qid", "code", "status", F.lit(100.0).alias("score"))
    rest = read.filter("code = ''")
    found = fuzzy_link(rest, codes, least=30.0, most=most).select("qid", F.col("name").alias("code"), "score")
    return direct.union(found.join(rest.select("qid", "status"), "qid").select("qid", "code", "status", "score"))


def link_cities(questions: DataFrame, cities: DataFrame, most: int = 3) -> DataFrame:
    """(qid, name, score, rank): cities from a ratio of 50 on."""
    return fuzzy_link(questions, cities, least=50.0, most=most)


def repair_items(asked: DataFrame, codes: DataFrame) -> DataFrame:
    """(qid, code, item, status): asked (qid, code, status) with the code that stands for it: itself, or, if there is no
    such item, the first code that contains it without its "e", else itself; and its status, if there is such a one."""
    known = codes.select(F.col("name").alias("item")).distinct()
    odd = asked.select("code").distinct().join(known, F.col("code") == F.col("item"), "left_anti")
    # the codes are a dictionary of some fifty entries
    near = odd.crossJoin(F.broadcast(known)).filter(F.contains("item", F.replace("code", F.lit("e"), F.lit(""))))
    first = near.groupBy("code").agg(F.min("item").alias("near"))
    status = F.when(F.col("status").isin(*STATUSES), F.col("status"))
    return asked.join(first, "code", "left").select("qid", "code", F.coalesce("near", "code").alias("item"), status.alias("status"))


def known_values(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of asked (qid, kind, value) whose value is an entry of its kind in known (kind, value)."""
    return asked.join(known.select("kind", "value").distinct(), ["kind", "value"], "left_semi")


def without_stop_words(text: Column, words: tuple[str, ...] = EVENT_STOP_WORDS) -> Column:
    """The text in small letters without these words and without numbers, words one space apart."""
    # the boundaries of words are those of Unicode letters, digits and the underscore
    rest = F.regexp_replace(F.lower(text), rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}_])", "")
    return F.trim(F.regexp_replace(F.regexp_replace(rest, r"\p{Nd}+", ""), r"\s+", " "))


def link_events(questions: DataFrame, names: DataFrame, most: int = 6, words=EVENT_WORDS) -> DataFrame:
    """(qid, name, score, rank): the events that fixed words of the question stand for, in the order of these words, then those most
    similar to what is left of it without words that fit every event, at most `most` together."""
    low = F.lower("text")
    listed = [F.when(low.contains(w), F.struct(F.lit(i * 10 + j).alias("place"), F.lit(n).alias("name"))) for i, (w, events) in enumerate(words) for j, n in enumerate(events)]
    by_word = questions.select("qid", F.explode(F.array_compact(F.array(*listed))).alias("w")).groupBy("qid", "w.name").agg(F.min("w.place").alias("place"))
    by_word = by_word.select("qid", "name", "place", F.lit(101.0).alias("score"))
    cleaned = questions.select("qid", without_stop_words(F.col("text")).alias("text"))
    alike = fuzzy_link(cleaned, names, least=50.0, most=most).select("qid", "name", F.lit(len(words) * 10).alias("place"), "score")
    all_ = by_word.union(alike).groupBy("qid", "name").agg(F.min("place").alias("place"), F.max("score").alias("score"))
    best = Window.partitionBy("qid").orderBy("place", F.desc("score"), "name")
    return all_.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most).select("qid", "name", "score", "rank")


def validate(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, entity, name): the dictionary's entry for each entity: equal, equal without accents and case, or that of
    the largest token-set ratio from 75 on. Each entity that is left over is scored once with every entry."""
    exact = entities.join(names, F.col("entity") == F.col("name"), "left").select("qid", "entity", "name")
    folded = names.groupBy(parse.fold(F.col("name")).alias("folded")).agg(F.min("name").alias("near"))
    joined = exact.withColumn("folded", parse.fold(F.col("entity"))).join(folded, "folded", "left")
    joined = joined.select("qid", "entity", F.coalesce("name", "near").alias("name"))
    left = joined.filter(F.col("name").isNull() & F.col("entity").isNotNull()).select(F.col("entity").alias("left_over")).distinct()
    pairs = left.crossJoin(names.select(F.col("name").alias("entry")).distinct())
    alike = pairs.withColumn("score", fuzzy.token_set_ratio("left_over", "entry")).filter(F.col("score") >= LEAST_TOKEN_SET)
    repaired = alike.groupBy("left_over").agg(F.min(F.struct((-F.col("score")).alias("s"), "entry")).alias("b")).select("left_over", F.col("b.entry").alias("repaired"))
    both = joined.join(repaired, joined.entity == repaired.left_over, "left")
    return both.select("qid", "entity", F.coalesce("name", "repaired").alias("name"))


def follow_ups(asked: DataFrame) -> DataFrame:
    """asked (qid, session, turn, text, template, group_name, years) with what a follow-up takes over: a short
    question that begins like one, names something, and comes after one that a report answered."""
    before = Window.partitionBy("session").orderBy("turn")
    prev = F.lag(F.struct("text", "template", "group_name", "years")).over(before)
    text = F.lower(F.trim("text"))
    starts = reduce(lambda a, b: a | b, [text.startswith(p) for p in parse.FOLLOW_UP])
    names_one = F.col("group_name").isNotNull() | (F.size("years") > 0)
    with_prev = asked.withColumn("prev", prev)
    follows = F.coalesce(F.col("prev.template").isNotNull() & (F.length("text") < parse.FOLLOW_UP_CHARS) & starts & names_one, F.lit(False))
    took = lambda own, old: F.when(follows & own.isNull(), old).otherwise(own)
    return with_prev.select(
        "qid", "session", "turn", follows.alias("is_follow_up"),
        F.when(follows, F.col("prev.template")).otherwise(F.col("template")).alias("template"),
        took(F.col("group_name"), F.col("prev.group_name")).alias("group_name"),
        F.array_join(F.when(follows & (F.size("years") == 0), F.col("prev.years")).otherwise(F.col("years")), ",").alias("years"),
        parse.truncated(F.col("prev.text"), 30).alias("context"),
    )
