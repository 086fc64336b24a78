"""Quiz datasets: every question of a kind as a row of one table, for each group and year at once, then samples."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.operators import reports, scoring
from tally.plans.roles import ATTEMPT, COMPLETE, DISMANTLED, LOADED
from tally.sources.scratch import materialize

OPTIONS = 4
TOP_ITEMS = 4
BAND, BAND_PERCENT, NEAREST, WRONG = 200, 20, 6, 3
#: A better outcome has a lower number.
PRIORITY = {COMPLETE: 1, LOADED: 2, ATTEMPT: 3, DISMANTLED: 4}
#: The first and last year of eras with their chance, which their years share alike, and the years without events. Fixed values.
ERAS = ((2016, 2025, 0.45), (2005, 2015, 0.25), (1990, 2004, 0.20), (1960, 1989, 0.10))
EXCLUDED_YEARS = (2020, 2021)
#: The weight of a contest's year from each of these years on, the session-day that weighs more in a year of several, and how much. Fixed values.
CONTEST_YEARS = ((2016, 0.5), (2000, 0.35), (1980, 0.10), (0, 0.05))
MAIN_DAY, MAIN_DAY_WEIGHT = "Jornada Diumenge Tarragona", 5
#: Groups that fill a question when there are no others, and the years and the distance within which other years do. Fixed values.
FILL_GROUPS = ("Castellers de Vilafranca", "Castellers de Barcelona", "Colla Joves Xiquets de Valls")
FIRST_YEAR, LAST_YEAR, YEARS_APART = 1960, 2025, 5
#: In how many drawn orders the groups of a year stand ready to fill its questions.
DRAWS = 16
#: How often each way of answering comes, and within it each kind of question: of all questions, of those about chosen groups, and
#: of those about chosen years. Fixed values.
FORMS = {"all": {"options": 0.7, "multi": 0.15, "slider": 0.2, "ordering": 0.05}, "groups": {"options": 0.5, "multi": 0.25, "slider": 0.25}, "years": {"options": 0.45, "multi": 0.2, "slider": 0.2, "ordering": 0.15}}
KINDS = {
    "all": {"options": {"best_event": 3, "best_item": 2, "colour": 1, "founded": 1, "performance": 2, "first_group": 1}, "multi": {"multi": 1}, "slider": {"founded_year": 1, "counts": 1}, "ordering": {"ordering": 1}},
    "groups": {"options": {"best_event": 1, "best_item": 1, "performance": 1}, "multi": {"multi": 1}, "slider": {"counts": 1}},
    "years": {"options": {"best_event": 1, "best_item": 1, "first_group": 1}, "multi": {"multi": 1}, "slider": {"counts": 1}, "ordering": {"ordering": 1}},
}


def chances(groups: tuple = (), years: tuple = ()) -> dict[str, float]:
    """How often each kind of question comes, given what was chosen."""
    of = "groups" if groups else "years" if years else "all"
    total = sum(FORMS[of].values())
    return {k: FORMS[of][form] / total * w / sum(kinds.values()) for form, kinds in KINDS[of].items() for k, w in kinds.items()}


def priority(status: str = "status") -> Column:
    out = F.when(F.col(status) == COMPLETE, PRIORITY[COMPLETE])
    for s in (LOADED, ATTEMPT, DISMANTLED):
        out = out.when(F.col(status) == s, PRIORITY[s])
    return out.otherwise(99)


def best_event(perf: DataFrame) -> DataFrame:
    """(group_name, year, correct, wrong): a group's best event of a year among its best four."""
    totals = scoring.event_points(perf)
    year = F.year("event_date")
    best = Window.partitionBy("group_id", year).orderBy(F.desc("total_points"), "event_date", "event_id")
    top = totals.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= OPTIONS)
    label = F.expr("concat(event_name, ', ', city, ' (', event_date, ' | ', group_name, ')')")
    grouped = top.groupBy("group_name", year.alias("year")).agg(F.max(F.when(F.col("rn") == 1, label)).alias("correct"), F.expr("listagg(CASE WHEN rn > 1 THEN concat(event_name, ', ', city, ' (', event_date, ' | ', group_name, ')') END, '; ') WITHIN GROUP (ORDER BY rn) AS wrong"))
    return grouped.filter("wrong IS NOT NULL")


def best_item_unique(perf: DataFrame) -> DataFrame:
    """Each item once for a group and year: its best outcome."""
    best = Window.partitionBy("group_name", "event_year", "item_name").orderBy(F.desc("points"), priority(), "attempt_id")
    return perf.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("group_name", "event_year", "item_name", "status", "points")


def distractors(scores: DataFrame, seed: int | None = None) -> DataFrame:
    """(code, full, wrong): for each code three others of nearly as many points, within the band, each value of points by its least
    code: with a seed, three drawn of the six nearest, else the nearest.

    The nearest six are among the six next values on either side, in one pass over the different values in order.
    Points are small whole numbers, so these are few however many codes there are."""
    among = WRONG if seed is None else NEAREST
    values = scores.groupBy("full").agg(F.min("code").alias("code")).filter("full IS NOT NULL")
    order, own = Window.orderBy("full"), F.struct("full", "code")
    beside = F.array_compact(F.array(*[f(own, i).over(order) for f in (F.lag, F.lead) for i in range(1, among + 1)]))
    off = lambda x: F.abs(x["full"] - F.col("full"))
    band = F.greatest(F.lit(BAND), F.floor(F.col("full") * BAND_PERCENT / 100))
    near = F.array_sort(F.transform(F.filter("beside", lambda x: off(x) <= band), lambda x: F.struct(off(x).alias("off"), x["full"].alias("full"), x["code"].alias("code"))))
    chosen = F.slice(near, 1, among)
    if seed is not None:
        drawn = lambda x: F.struct(F.xxhash64(F.lit(seed), F.col("full"), x["code"]).alias("draw"), x["code"].alias("code"))
        chosen = F.slice(F.array_sort(F.transform(chosen, drawn)), 1, WRONG)
    wrong = F.array_join(F.transform(chosen, lambda x: x["code"]), ",")
    picked = values.withColumn("beside", beside).select(F.col("full").alias("p"), wrong.alias("wrong")).filter("wrong <> ''")
    return scores.join(picked, scores["full"] == picked["p"]).select("code", "full", "wrong")


def similar_items(answers: DataFrame, scores: DataFrame, most: int = 2, order: Column | None = None, seed: int = 1) -> DataFrame:
    """(key, average, similar): for answers (key, items: array of (item_name, status)) the first `most`, drawn unless there is an order, of
    the codes whose points are within a fifth, or BAND, of the average points of the answer's items: complete ones if those
    points are near, else loaded ones. Items of the answer are no choice, and items without points do not count.

    Points are binned by BAND, so that a band meets the bins that it covers by equality. An order, which goes by the code alone, is taken
    before that: of each number of points no more codes are needed than `most`, and as many as any answer excludes."""
    known = scoring.aliases(scores).select(F.lower(F.trim("alias")).alias("name"), "full", "partial")
    each = answers.select("key", F.explode("items").alias("i")).select("key", F.lower(F.trim("i.item_name")).alias("name"), "i.status")
    value = F.coalesce(F.when(F.col("status") == COMPLETE, F.col("full")).when(F.col("status") == LOADED, F.col("partial")), F.lit(0))
    average = each.join(known, "name").groupBy("key").agg(F.avg(value).alias("average"))
    width = F.greatest(F.lit(BAND), F.floor(F.col("average") * BAND_PERCENT / 100))
    low, high = F.greatest(F.lit(0.0), F.col("average") - width), F.col("average") + width
    bands = average.select("key", "average", low.alias("low"), high.alias("high")).select("*", F.explode(F.sequence(F.floor(F.col("low") / BAND), F.floor(F.col("high") / BAND))).alias("bin"))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("full").alias("points")), F.struct(F.lit(1).alias("kind"), F.col("partial").alias("points")))).alias("p")
    codes = scores.select(F.coalesce("external", "code").alias("code"), kinds).filter("p.points IS NOT NULL").select("code", "p.*")
    own = each.select("key", F.col("name").alias("own")).distinct()
    choice = codes.select("code", "points")
    if order is not None:
        excluded = own.join(codes.select("code").distinct(), F.lower(F.trim("code")) == F.col("own")).groupBy("key").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("excluded"))
        rank = F.dense_rank().over(Window.partitionBy("points").orderBy(order, "code"))
        choice = choice.withColumn("place", rank).join(F.broadcast(excluded)).filter(F.col("place") <= most + F.col("excluded")).select("code", "points")  # one row
    near = bands.join(choice.withColumn("bin", F.floor(F.col("points") / BAND)), "bin").filter("points BETWEEN low AND high").select("key", "average", "low", "high", "code").distinct()
    near = near.join(own, (near["key"] == own["key"]) & (F.lower(F.trim("code")) == F.col("own")), "left_anti")
    draw = weighted_order(F.lit(1.0), F.col("key").cast("string"), F.col("code"), seed=seed) if order is None else order
    first = near.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(draw, "code"))).filter(F.col("rn") <= most)
    every = codes.withColumnRenamed("code", "same")  # a code may be near by its other points too
    first = first.join(every, F.col("code").eqNullSafe(F.col("same")) & F.col("points").between(F.col("low"), F.col("high"))).groupBy("key", "average", "rn", "code").agg(F.min("kind").alias("kind"))
    text = F.concat("code", F.lit(" ("), F.when(F.col("kind") == 0, COMPLETE).otherwise(LOADED), F.lit(")"))
    return first.groupBy("key", "average").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))), lambda x: x["t"]), ", ").alias("similar"))


def _events_by_best(perf: DataFrame) -> DataFrame:
    """A group's events of each year in order of the points of their best four items. Which of items of equal points count makes no
    difference to their sum, so no text is sorted. The events are few, and written, so that what is joined to them knows their size."""
    best = Window.partitionBy("event_id", "group_id").orderBy(F.desc("points"))
    top = perf.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= TOP_ITEMS)
    sums = top.groupBy("event_id", "group_id", "group_name", "event_name", "event_date", "event_year").agg(F.sum("points").alias("top_points"))
    order = Window.partitionBy("group_id", "event_year").orderBy(F.desc("top_points"), "event_date", "event_id")
    return materialize(sums.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= OPTIONS), "quiz-best-events")


def _items_of(perf: DataFrame, small: reports.SmallItems, events: DataFrame) -> DataFrame:
    """Items of those events and groups without small pillars, each with its best outcome. All others go before they are grouped."""
    best = F.min(F.struct(priority().alias("p"), F.col("status"))).alias("b")
    perf = perf.join(events.select("event_id", "group_id"), ["event_id", "group_id"], "left_semi")
    return reports.without_small(perf, small).groupBy("event_id", "group_id", "item_name").agg(best, F.max("points").alias("points")).select("event_id", "group_id", "item_name", F.col("b.status").alias("status"), "points")


def performance(perf: DataFrame, small: reports.SmallItems = reports.SMALL_LISTED, events: DataFrame | None = None) -> DataFrame:
    """(group_name, event_year, items, correct, wrong): which event of the year had these items? `events`: _events_by_best(perf), if it is there."""
    events = _events_by_best(perf) if events is None else events
    items = _items_of(perf, small, events.filter("place = 1")).groupBy("event_id", "group_id").agg(F.expr("listagg(concat(item_name, ' (', status, ')'), ', ') WITHIN GROUP (ORDER BY points DESC, item_name) AS items"))
    label = "concat(event_name, ' (', event_date, ')')"
    grouped = events.groupBy("group_id", "group_name", "event_year").agg(F.min_by("event_id", "place").alias("event_id"), F.expr(f"max(CASE WHEN place = 1 THEN {label} END) AS correct"), F.expr(f"listagg(CASE WHEN place > 1 THEN {label} END, '; ') WITHIN GROUP (ORDER BY place) AS wrong"))
    return grouped.join(items, ["event_id", "group_id"]).select("group_name", "event_year", "items", "correct", "wrong")


def performance_options(perf: DataFrame, small: reports.SmallItems = reports.SMALL_LISTED, seed: int | None = None) -> DataFrame:
    """performance() with three wrong options at all times, as "group, event, city (year)": the year's next best events, then the right
    event in other years, at most YEARS_APART away: with a seed, drawn ones, else the nearest, earlier ones first. The city stands
    only where the event's name does not hold it."""
    held = F.coalesce(F.contains("event_name", "city"), F.lit(False)) | (F.coalesce("city", F.lit("")) == "")
    name = F.when(held, F.coalesce("event_name", F.lit("Diada castellera"))).otherwise(F.concat(F.coalesce("event_name", F.lit("Diada castellera")), F.lit(", "), "city"))
    events = _events_by_best(perf.withColumn("event_name", name))
    items = _items_of(perf, small, events.filter("place = 1")).groupBy("event_id", "group_id").agg(F.expr("listagg(concat(item_name, ' (', status, ')'), ', ') WITHIN GROUP (ORDER BY points DESC, item_name) AS items"))
    listed = F.array_sort(F.collect_list(F.struct("place", "event_name")))  # OPTIONS events at most
    grouped = events.groupBy("group_id", "group_name", "event_year").agg(F.min_by("event_id", "place").alias("event_id"), F.transform(listed, lambda x: x["event_name"]).alias("names"))
    label = lambda event, year: F.concat(F.col("group_name"), F.lit(", "), event, F.lit(" ("), year.cast("string"), F.lit(")"))
    offsets = F.array(*[F.lit(i) for i in range(-YEARS_APART, YEARS_APART + 1) if i])
    rank = (lambda o: F.abs(o).cast("long")) if seed is None else (lambda o: F.xxhash64(F.lit(seed), F.col("group_name"), F.col("event_year"), o))
    near = F.array_sort(F.transform(F.filter(offsets, lambda o: (F.col("event_year") + o).between(FIRST_YEAR, LAST_YEAR)), lambda o: F.struct(rank(o).alias("rank"), o.alias("off"))))
    elsewhen = F.transform(near, lambda x: label(F.col("names")[0], F.col("event_year") + x["off"]))
    same_year = F.transform(F.slice("names", 2, WRONG), lambda n: label(n, F.col("event_year")))
    wrong = F.array_join(F.slice(F.concat(same_year, elsewhen), 1, WRONG), "; ")
    return grouped.join(items, ["event_id", "group_id"]).select("group_name", "event_year", "items", label(F.col("names")[0], F.col("event_year")).alias("correct"), wrong.alias("wrong"))


def multi(perf: DataFrame, scores: DataFrame, small: reports.SmallItems = reports.SMALL_CHOSEN, events: DataFrame | None = None) -> DataFrame:
    """(group_name, event_id, right, wrong): four items of one of a group's three best events of a year; wrong are
    the first two with another outcome and similar items of the last two. `events`: _events_by_best(perf), if it is there."""
    events = (_events_by_best(perf) if events is None else events).filter("place <= 3").select("event_id", "group_id", "group_name")
    order = Window.partitionBy("event_id", "group_id").orderBy(F.desc("points"), "item_name")
    items = _items_of(perf.filter("item_code IS NOT NULL"), small, events).join(events, ["event_id", "group_id"])
    first = items.withColumn("rn", F.row_number().over(order)).filter("rn <= 4")
    code = scoring.aliases(scores).select(F.col("alias").alias("item_name"), F.col("item_code").alias("code"))
    similar = distractors(scores).select("code", F.split_part("wrong", F.lit(","), F.lit(1)).alias("other"))
    joined = first.join(code, "item_name", "left").join(similar, "code", "left")
    flipped = F.when(F.col("status") == COMPLETE, LOADED).otherwise(COMPLETE)
    wrong = F.when(F.col("rn") <= 2, F.concat("item_name", F.lit(" ("), flipped, F.lit(")"))).otherwise(F.concat("other", F.lit(" ("), "status", F.lit(")")))
    labelled = joined.select("group_name", "event_id", "rn", F.concat("item_name", F.lit(" ("), "status", F.lit(")")).alias("right"), wrong.alias("wrong"))
    grouped = labelled.groupBy("group_name", "event_id").agg(F.count("*").alias("n"), F.expr("listagg(right, ', ') WITHIN GROUP (ORDER BY rn) AS right"), F.expr("listagg(wrong, ', ') WITHIN GROUP (ORDER BY rn) AS wrong"))
    return grouped.filter("n = 4").drop("n")


def first_groups(perf: DataFrame, most: int = 4) -> DataFrame:
    """(item_code, place, group_name, date): the first groups that did each item."""
    first = perf.filter("item_code IS NOT NULL").groupBy("item_code", "group_name").agg(F.min(F.struct("event_date", "event_id")).alias("f"))
    order = Window.partitionBy("item_code").orderBy("f.event_date", "f.event_id", "group_name")
    return first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("item_code", "place", "group_name", F.col("f.event_date").alias("date"))


def _when() -> Column:
    """An event's date and then its id as one whole number in their order, nulls first; the least of it needs no sort, unlike that of a struct."""
    day = F.coalesce(F.unix_date("event_date"), F.lit(-(1 << 31))).cast("decimal(10,0)")
    return day * F.lit(Decimal(10**20)) + F.coalesce(F.col("event_id").cast("decimal(20,0)"), F.lit(Decimal(-(10**19))).cast("decimal(20,0)"))


def first_group(perf: DataFrame, active: DataFrame, first_year: int = 2005, fill: tuple[str, ...] = FILL_GROUPS, order: tuple[Column, ...] | None = None, seed: int = 1) -> DataFrame:
    """(event_year, item_code, correct, wrong): which group was the year's first to do the item, of the items completed in the year? Wrong are
    the next three. Where they are fewer, groups active in the year (group_name, min_year, max_year, boost) fill up, drawn by
    boost + 1 unless there is an order, and then `fill`.

    The groups of a year are drawn DRAWS times, not once for each question, and a question takes the draw that its item's hash names.
    Of a draw the first OPTIONS are enough, as a question that needs fill names fewer groups than that."""
    of_year = perf.filter(F.col("item_code").isNotNull() & (F.col("event_year") >= first_year))
    first = of_year.groupBy("event_year", "item_code", "group_name").agg(F.min(_when()).alias("f"), F.bool_or(F.col("status") == COMPLETE).alias("complete"))
    order_of = Window.partitionBy("event_year", "item_code").orderBy("f", "group_name")
    placed = first.withColumn("place", F.row_number().over(order_of))
    # the rows come in order of these keys, so that plain maxima take them as they come; lists would be hashed or sorted again
    listed = F.slice(F.array(*[F.max(F.when(F.col("place") == i + 1, F.col("group_name"))) for i in range(OPTIONS)]), F.lit(1), F.least(F.max("place"), F.lit(OPTIONS)))
    asked = placed.groupBy("event_year", "item_code").agg(F.bool_or("complete").alias("complete"), listed.alias("names")).filter("complete")
    each = active.select("group_name", "boost", F.explode(F.sequence("min_year", "max_year")).alias("event_year"), F.lit(list(range(DRAWS))).alias("draws")).filter(F.col("event_year") >= first_year)
    each = each.select("group_name", "boost", "event_year", F.explode("draws").alias("draw"))
    drawn = weighted_order(F.coalesce(F.col("boost"), F.lit(0)) + 1, F.col("event_year"), F.col("draw"), F.col("group_name"), seed=seed)
    best = each.withColumn("rn", F.row_number().over(Window.partitionBy("event_year", "draw").orderBy(*(order or (drawn,)), "group_name"))).filter(F.col("rn") <= OPTIONS)
    more = best.groupBy("event_year", "draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "group_name"))), lambda x: x["group_name"]).alias("more"))
    named = asked.withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "item_code"), F.lit(DRAWS)).cast("int")).join(more, ["event_year", "draw"], "left")
    others = F.array_except(F.concat(F.coalesce("more", F.lit([]).cast("array<string>")), F.lit(list(fill)).cast("array<string>")), "names")
    wrong = F.slice(F.concat(F.slice("names", 2, WRONG), others), 1, WRONG)
    return named.select("event_year", "item_code", F.col("names")[0].alias("correct"), F.array_join(wrong, ", ").alias("wrong"))


def attribute(groups: DataFrame) -> DataFrame:
    """groups (group_name, value) with wrong: the first three different values that are not the group's. Names
    that end in years are no groups of today. The first three of the others are among the first four of all."""
    today = groups.filter(~F.col("group_name").rlike(r"\([0-9]{4}(-[0-9]{4})?\)$"))
    least = today.select("value").filter("value IS NOT NULL").distinct().orderBy("value").limit(WRONG + 1)
    values = least.agg(F.array_sort(F.collect_list("value")).alias("all"))
    others = F.slice(F.array_remove("all", F.col("value")), 1, WRONG)
    return today.crossJoin(F.broadcast(values)).select("group_name", F.col("value").alias("correct"), F.array_join(others, ", ").alias("wrong"))


def counts(perf: DataFrame, small: reports.SmallItems = reports.SMALL_COUNTED) -> DataFrame:
    """(group_name, event_year, item_name, status, answer, margin, slider_max): how often was it completed, or, if
    never, loaded?"""
    grouped = reports.without_small(perf, small).groupBy("group_name", "event_year", "item_name").agg(F.count_if(F.col("status") == COMPLETE).alias("complete"), F.count_if(F.col("status") == LOADED).alias("loaded"))
    done = F.col("complete") > 0
    answer = F.when(done, F.col("complete")).otherwise(F.col("loaded"))
    asked = grouped.select("group_name", "event_year", "item_name", F.when(done, COMPLETE).otherwise(LOADED).alias("status"), answer.alias("answer")).filter("answer > 0")
    return asked.select("*", F.when(F.col("answer") <= 2, 0).when(F.col("answer") <= 9, 1).otherwise(2).alias("margin"), (F.col("answer") + 5 + F.col("answer") % 16).alias("slider_max"))


def ordering(ranked: DataFrame, most: int = 10, least: int = 3) -> DataFrame:
    """(year, day, n, names): the first groups of each session-day in order."""
    order = Window.partitionBy("year", "day").orderBy("position")
    top = ranked.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
    return top.groupBy("year", "day").agg(F.count("*").alias("n"), F.expr("listagg(group_name, ' > ') WITHIN GROUP (ORDER BY rn) AS names")).filter(F.col("n") >= least)


def slider_score(user: Column, correct: Column, margin: Column) -> Column:
    off = F.abs(user - correct)
    inside = F.greatest(F.lit(0.1), F.lit(0.9) - off / margin * 0.8)
    return F.when(off == 0, 1.0).when((margin > 0) & (off <= margin), inside).otherwise(0.0)


def multi_score(chosen: Column, right: Column) -> Column:
    hits = F.size(F.filter(chosen, lambda x: F.array_contains(right, x)))
    n = F.size(right)
    return F.when(n > 0, F.greatest(F.lit(0.0), hits / n - (F.size(chosen) - hits) / n * 0.5)).otherwise(0.0)


def ordering_score(given: Column, right: Column) -> Column:
    same = F.size(F.filter(F.zip_with(given, right, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    return F.when(F.size(right) > 0, same / F.size(right)).otherwise(0.0)


def exactly(score: Column, places: int = 6) -> Column:
    """A rounded score as a decimal number, so that sums of many do not hang on their order."""
    return F.round(score, places).cast(f"decimal(18,{places})")


def game(points: Column, n: Column, places: int = 6) -> tuple[Column, Column]:
    """A game's per cent, half up, and its band; in whole numbers, so that a half is a half. Points are a sum of at most so many places."""
    got, full = (F.round(points, places) * 10**places).cast("long"), (n * 10**places).cast("long")
    percent = F.call_function("div", 200 * got + full, 2 * full).cast("int")
    return percent, F.when(percent >= 80, "excellent").when(percent >= 50, "good").otherwise("again")


def weighted_order(weight: Column, *key: Column, seed: int = 1) -> Column:
    """A number to sort by: the first n rows are a weighted sample without replacement, the same on every run."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    return -F.log(u) / weight


def sample_years(perf: DataFrame, n: int = 5, seed: int = 1, chosen: tuple[int, ...] = ()) -> DataFrame:
    """(group_name, event_year): n years of each group, by the chance of their era; of chosen years, each alike."""
    years = perf.select("group_name", "event_year").distinct()
    if chosen:
        years, weight = years.filter(F.col("event_year").isin(*chosen)), F.lit(1.0)
    else:
        years = years.filter(~F.col("event_year").isin(*EXCLUDED_YEARS))
        weight = F.lit(None).cast("double")
        for first, last, chance in ERAS:
            of_era = sum(y not in EXCLUDED_YEARS for y in range(first, last + 1))
            weight = F.when(F.col("event_year").between(first, last), F.lit(chance / of_era)).otherwise(weight)
        years = years.withColumn("w", weight).filter("w IS NOT NULL")
        weight = F.col("w")
    order = Window.partitionBy("group_name").orderBy(weighted_order(weight, F.col("group_name"), F.col("event_year"), seed=seed))
    return years.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n).select("group_name", "event_year", "rn")


def sample_groups(active: DataFrame, n: int = 5, seed: int = 1, chosen: tuple[str, ...] = ()) -> DataFrame:
    """(year, group_name, rn): for each year n of the groups active in it (group_name, min_year, max_year, boost), by their boost; of chosen
    groups, each alike. Years come by equality, the span of a group being rows."""
    rows = active.filter(F.col("group_name").isin(*chosen)) if chosen else active.filter("boost > 0")
    each = rows.select(F.explode(F.sequence("min_year", "max_year")).alias("year"), "group_name", F.lit(1.0).alias("w") if chosen else F.col("boost").cast("double").alias("w"))
    order = Window.partitionBy("year").orderBy(weighted_order(F.col("w"), F.col("year"), F.col("group_name"), seed=seed), "group_name")
    return each.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n).select("year", "group_name", "rn")


def _item_weights(questions: DataFrame, scores: DataFrame) -> DataFrame:
    """questions (event_year, item_code, ...) with `w`, the full points of the item; 1 for all of a year without points."""
    known = questions.join(scores.groupBy(F.col("code").alias("item_code")).agg(F.max("full").alias("full")), "item_code", "left").withColumn("full", F.coalesce("full", F.lit(0)))
    known = materialize(known, "quiz-weighed")  # a year holds many questions: its sum is a row of a small table, not a window over them
    of_year = known.groupBy("event_year").agg(F.sum("full").alias("of_year"))
    return known.join(of_year, "event_year").withColumn("w", F.when(F.col("of_year") == 0, 1.0).otherwise(F.col("full").cast("double"))).drop("full", "of_year")


def sample_items(questions: DataFrame, scores: DataFrame, n: int = 5, seed: int = 1) -> DataFrame:
    """n of the questions (event_year, item_code, ...) of each year, by the full points of their items, with their place rn."""
    weighed = _item_weights(questions, scores).filter("w > 0")
    order = Window.partitionBy("event_year").orderBy(weighted_order(F.col("w"), F.col("event_year"), F.col("item_code"), seed=seed), "item_code")
    return weighed.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n).drop("w")


def _day_weights(days: DataFrame, years: tuple[int, ...] = (), main_day: str = MAIN_DAY) -> DataFrame:
    """days (year, day, ...) with `w`: late years weigh more, chosen years alike, and in a year of several days the main one more than each
    other. If no chosen year is there, all are, alike."""
    if years:
        among = days.filter(F.col("year").isin(*years))
        days, of_year = (among if among.limit(1).count() else days), F.lit(1.0)
    else:
        of_year = F.lit(None).cast("double")
        for first, weight in reversed(CONTEST_YEARS):
            of_year = F.when(F.col("year") >= first, F.lit(weight)).otherwise(of_year)
    of_day = F.when(F.col("day") == main_day, float(MAIN_DAY_WEIGHT)).otherwise(1.0)
    return days.withColumn("d", of_day).withColumn("w", of_year * F.col("d") / F.sum("d").over(Window.partitionBy("year"))).drop("d").filter("w IS NOT NULL")


def sample_days(days: DataFrame, n: int = 10, seed: int = 1, years: tuple[int, ...] = (), main_day: str = MAIN_DAY) -> DataFrame:
    """n of the days (year, day, ...), each year and day once, drawn by their weights."""
    return _day_weights(days, years, main_day).orderBy(weighted_order(F.col("w"), F.col("year"), F.col("day"), seed=seed), "year", "day").limit(n).drop("w")


def _best_item(perf: DataFrame) -> DataFrame:
    """(group_name, event_year, item): the item of the most points of a group and year, of equal ones the last by name. The most points
    are found first, as numbers, and only rows that have them are compared by name."""
    keys = ["group_name", "event_year"]
    most = materialize(perf.filter("points > 0").groupBy(*keys).agg(F.max("points").alias("points")), "quiz-most-points")
    return perf.join(most, [*keys, "points"], "left_semi").groupBy(*keys).agg(F.max("item_name").alias("item"))


def _no_question_twice(stored: DataFrame) -> DataFrame:
    """Questions (kind, question, answer, w), of equal ones the first by kind, answer and w. They are counted by hashes, and only texts whose
    hash is not single, few or none as a rule, are sorted. The table is read as often as the result, so it is to be stored."""
    hashed = stored.withColumn("h", F.xxhash64("question"))
    again = materialize(hashed.groupBy("h").count().filter("count > 1").select("h"), "quiz-repeated")
    first = hashed.join(again, "h", "left_semi").groupBy("question").agg(F.min(F.struct("kind", "answer", "w")).alias("f"))
    return hashed.join(again, "h", "left_anti").select("kind", "question", "answer", "w").union(first.select("f.kind", "question", "f.answer", "f.w"))


def dataset(perf: DataFrame, scores: DataFrame, ranked: DataFrame, colours: DataFrame, founded: DataFrame, n: int = 200, seed: int = 1, groups: tuple[str, ...] = (), years: tuple[int, ...] = (), small: reports.SmallItems | None = None, active: DataFrame | None = None, first_year: int = 2005) -> DataFrame:
    """(kind, question, answer): n questions of all kinds that go with what was chosen, drawn by the kinds' chances, no question twice; within a
    kind, first groups by the points of their items and orders by their years and days, the others alike.
    colours and founded: (group_name, value); active: as first_group() takes it, which asks for a year's firsts from first_year on (of chosen years, all);
    without it only firsts of all time are asked. Every kind reads the fact, the ranking and founded for itself: they are to be stored tables, the fact narrow."""
    kinds = chances(groups, years)
    chosen = perf.filter(F.col("group_name").isin(*groups)) if groups else perf
    chosen = chosen.filter(F.col("event_year").isin(*years)) if years else chosen
    # one pass for what goes by the points of events
    best = materialize(scoring.best_of_classes(chosen.select(*scoring.EVENT_KEYS, "event_year", "item_class", "points"), TOP_ITEMS), "quiz-best")
    events = _events_by_best(best) if {"performance", "multi"} & set(kinds) else None
    days = ranked.filter(F.col("year").isin(*years)) if years else ranked
    named = lambda default: default if small is None else small
    q = lambda kind, text, answer, w=F.lit(1.0): [F.lit(kind).alias("kind"), F.expr(text).alias("question"), F.col(answer).cast("string").alias("answer"), w.alias("w")]
    firsts = lambda: _item_weights(first_group(chosen, active, 0 if years else first_year), scores).select(*q("first_group", "concat('Which group did ', item_code, ' first in ', event_year, '? ', array_join(array_sort(array_append(split(wrong, ', '), correct)), ' / '))", "correct", F.col("w")))
    makers = {
        "best_event": lambda: best_event(best).select(*q("best_event", "concat('Best event of ', group_name, ' in ', year, '?')", "correct")),
        "best_item": lambda: _best_item(chosen).select(*q("best_item", "concat('Best item of ', group_name, ' in ', event_year, '?')", "item")),
        "colour": lambda: attribute(colours).select(*q("colour", "concat('Colour of the shirt of ', group_name, '?')", "correct")),
        "founded": lambda: attribute(founded).select(*q("founded", "concat('Founding year of ', group_name, '?')", "correct")),
        "performance": lambda: performance(chosen, named(reports.SMALL_LISTED), events).select(*q("performance", "concat('At which event of ', event_year, ' did ', group_name, ' do ', items, '?')", "correct")),
        "first_group": firsts if active is not None else lambda: first_groups(chosen, most=1).select(*q("first_group", "concat('Which group did ', item_code, ' first?')", "group_name")),
        "multi": lambda: multi(chosen, scores, named(reports.SMALL_CHOSEN), events).select(*q("multi", "concat('Which items did ', group_name, ' do at event ', event_id, '?')", "right")),
        "founded_year": lambda: founded.select(*q("founded_year", "concat('In which year was ', group_name, ' founded?')", "value")),
        "counts": lambda: counts(chosen, named(reports.SMALL_COUNTED)).select(*q("counts", "concat('How often was ', item_name, ' ', status, ' by ', group_name, ' in ', event_year, '?')", "answer")),
        "ordering": lambda: _day_weights(ordering(days), years).select(*q("ordering", "concat('Order of ', day, ' in ', year, '?')", "names", F.col("w"))),
    }
    all_ = reduce(DataFrame.union, [makers[k]() for k in kinds])
    all_ = _no_question_twice(materialize(all_.filter("question IS NOT NULL AND answer IS NOT NULL AND w > 0"), "quiz-questions"))
    per_kind = all_.groupBy("kind").agg(F.sum("w").alias("of_kind"))  # one row for each kind
    weights = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    weight = F.element_at(weights, F.col("kind")) * F.col("w") / F.col("of_kind")
    return all_.join(F.broadcast(per_kind), "kind").orderBy(weighted_order(weight, F.col("question"), seed=seed), "question").limit(n).select("kind", "question", "answer")
