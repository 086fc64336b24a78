"""Points of attempts: the alias join to the score table, the point and class rules, and the best of each event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.plans import roles
from tally.sources.scratch import materialize

TOWER, PILLAR, OTHER = "castell", "pilar", "altres"


def aliases(scores: DataFrame) -> DataFrame:
    """Every name that a score answers to, once: a join on any of three columns becomes one on this one."""
    names = F.explode(F.array_distinct(F.array("external", "code", "name"))).alias("alias")
    return scores.select(names, F.col("code").alias("item_code"), "full", "partial", "tier")


def alias_join(attempts: DataFrame, scores: DataFrame, parts: int | None = None) -> DataFrame:
    """attempts with the score that their item's name answers to; `parts`: in how many parts they meet, if Spark's own number will not do."""
    attempts, known = roles.dealt(attempts, parts, "item_name"), roles.dealt(aliases(scores), parts, "alias")
    return attempts.join(known, attempts["item_name"] == known["alias"], "left").drop("alias")


def points(status: str = "status") -> Column:
    """Full points for a complete item, partial ones for a loaded one, else none."""
    given = F.when(F.col(status) == roles.COMPLETE, F.col("full")).when(F.col(status) == roles.LOADED, F.col("partial")).otherwise(F.lit(0))
    return F.coalesce(given, F.lit(0)).cast("long")


def item_class(item: str = "item_name") -> Column:
    return F.when(F.col(item).rlike("^[0-9]"), TOWER).when(F.col(item).rlike("^[Pp]"), PILLAR).otherwise(OTHER)


def performances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide fact: each attempt with its event, group, score, points and class."""
    parts = roles.parts_of(spark, sf_dir)
    scored = alias_join(roles.attempts_in_regions(spark, sf_dir, parts), roles.scores(spark, sf_dir), parts)
    joined = roles.named(scored).join(roles.groups(spark, sf_dir), "group_id")
    columns = ["group_id", *[c for c in roles.ATTEMPT_COLUMNS if c != "group_id"], "item_code", "full", "partial", "tier", "group_name"]
    return joined.select(*columns, points().alias("points"), item_class().alias("item_class"), F.year("event_date").alias("event_year"))


def counted(perf: DataFrame, ties: tuple[str, ...] = ("attempt_id",)) -> DataFrame:
    """The attempts that count for an event and group: the best three towers and the best pillar; of equal points, the first by `ties`."""
    best = Window.partitionBy("event_id", "group_id", "item_class").orderBy(F.desc("points"), *ties)
    ranked = perf.filter(F.col("item_class").isin(TOWER, PILLAR)).withColumn("rn", F.row_number().over(best))
    # the plain bound lets Spark cut the windows' input before its shuffle
    return ranked.filter((F.col("rn") <= 3) & ((F.col("item_class") == TOWER) | (F.col("rn") == 1)))


LEAST = -(1 << 63)


def without_hopeless(perf: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """perf without rows that cannot be among the `most` of the most points of their keys; what has that many rows of more points goes.
    Rows are dealt to so many heaps, and the least of the heaps' maxima is a bound: each heap has a row of no fewer points. Maxima are hashed
    where windows sort, so that these have few rows left. Rows of equal points stay. perf is read twice: a stored table."""
    heap = perf.select(*keys, "points", (F.monotonically_increasing_id() % most).alias("heap"))
    highest = [F.coalesce(F.max(F.when(F.col("heap") == i, F.col("points"))), F.lit(LEAST)) for i in range(most)]
    bounds = heap.groupBy(*keys).agg((F.least(*highest) if most > 1 else highest[0]).alias("bound"))
    bounds = materialize(bounds.select(*[F.col(k).alias(f"of_{k}") for k in keys], "bound"), "best-bounds")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    return perf.join(bounds, same & (F.coalesce("points", F.lit(LEAST)) >= F.col("bound")), "left_semi")


def best_of_classes(perf: DataFrame, most: int) -> DataFrame:
    """So many best attempts of each event, group and class, for what sums their points: of equal points any. The best of an event and group
    in all classes are among them, too. perf is read twice."""
    keys = ("event_id", "group_id", "item_class")
    best = Window.partitionBy(*keys).orderBy(F.desc("points"))
    return without_hopeless(perf, keys, most).withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= most).drop("rn")


EVENT_KEYS = ["event_id", "group_id", "event_name", "event_date", "place", "city", "group_name"]
ITEMS_DONE = "listagg(concat(item_name, ' (', status, ')'), ', ') WITHIN GROUP (ORDER BY points DESC, attempt_id) AS items_done"


def event_totals(perf: DataFrame, *more: Column) -> DataFrame:
    """One row for each event and group: the counted items, best first, and their points."""
    return counted(perf).groupBy(*EVENT_KEYS).agg(F.expr(ITEMS_DONE), F.sum("points").alias("total_points"), F.count("*").alias("num_items"), *more)


def event_points(perf: DataFrame) -> DataFrame:
    """event_totals() without the items, for which no text is sorted: which of items of equal points count makes no difference to their sum."""
    return counted(perf, ties=()).groupBy(*EVENT_KEYS).agg(F.sum("points").alias("total_points"))
