"""From nested files to tables: flattening, name resolution, and upserts of every kind the loads need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.sources.scratch import materialize
from tally.sources.store import Store

EVENT = "struct<event_id: bigint, event_name: string, date: string, place: string, city: string, colles: array<struct<colla_name: string, castells: array<struct<castell_name: string, status: string, raw_text: string>>>>>"
GROUP = "struct<colla_id: bigint, colla_name: string, info: map<string, string>, texts: array<string>, best_actuacions: array<struct<diada: string, points: bigint>>, best_castells: array<struct<castell_name: string, castell: string, name: string, descarregats: bigint>>>"
SCORE = "map<string, struct<descarregat: bigint, descarregats: bigint, carregat: bigint, carregats: bigint>>"


def flatten_events(nested: DataFrame) -> dict[str, DataFrame]:
    """The tables events, event_groups (each pair once) and attempts of nested events (column `json`)."""
    one = nested.select(F.from_json("json", EVENT).alias("e")).select("e.*")
    each = one.select("event_id", "event_name", "date", "place", "city", F.explode("colles").alias("c"))
    attempts = each.select("event_id", F.col("c.colla_name").alias("group_name"), F.explode("c.castells").alias("a")).select("event_id", "group_name", F.col("a.castell_name").alias("item_name"), "a.status", "a.raw_text")
    return {"events": one.drop("colles").dropDuplicates(["event_id"]), "event_groups": each.select("event_id", F.col("c.colla_name").alias("group_name")).distinct(), "attempts": attempts}


def flatten_attempts(nested: DataFrame) -> DataFrame:
    """The attempts of nested events with their event's columns, by one parse: what the tables give when joined."""
    one = nested.select(F.from_json("json", EVENT).alias("e")).select("e.*")
    each = one.select("event_id", "event_name", "date", "place", "city", F.explode("colles").alias("c"))
    item = F.explode("c.castells").alias("a")
    return each.select("event_id", "event_name", "date", "place", "city", F.col("c.colla_name").alias("group_name"), item).select("*", F.col("a.castell_name").alias("item_name"), "a.status", "a.raw_text").drop("a")


def flatten_groups(nested: DataFrame) -> DataFrame:
    """The children of nested groups (column `json`) as (group_id, kind, position, key, value): the facts of a map,
    the texts that are not blank, the best performances and the best items, whose name has one of three fields."""
    one = nested.select(F.from_json("json", GROUP).alias("g")).select("g.*")
    child = lambda kind, position, key, value: [F.col("colla_id").alias("group_id"), F.lit(kind).alias("kind"), position.cast("int").alias("position"), key.cast("string").alias("key"), value.cast("string").alias("value")]
    info = one.select("colla_id", F.explode("info")).select(*child("info", F.lit(None), F.col("key"), F.col("value")))
    texts = one.select("colla_id", F.posexplode("texts")).filter(F.trim("col") != "").select(*child("text", F.col("pos"), F.lit(None), F.trim("col")))
    shows = one.select("colla_id", F.posexplode("best_actuacions")).select(*child("performance", F.col("pos"), F.col("col.diada"), F.col("col.points")))
    name = F.coalesce(*[F.nullif(F.col(f"col.{c}"), F.lit("")) for c in ("castell_name", "castell", "name")])
    items = one.select("colla_id", F.posexplode("best_castells")).select(*child("item", F.col("pos"), name, F.col("col.descarregats")))
    return info.union(texts).union(shows).union(items)


def flatten_scores(nested: DataFrame) -> DataFrame:
    """(code, external, full, partial) of score files (column `json`): keys in singular or plural, and no zeros."""
    one = nested.select(F.explode(F.from_json("json", SCORE)).alias("code", "s"))
    either = lambda a, b: F.coalesce(F.nullif(F.col(f"s.{a}"), F.lit(0)), F.nullif(F.col(f"s.{b}"), F.lit(0)))
    return one.select("code", F.replace("code", F.lit("d"), F.lit("de")).alias("external"), either("descarregat", "descarregats").alias("full"), either("carregat", "carregats").alias("partial"))


GRAM = 3


def containing(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole) for each text of parts (part) that a text of wholes (whole) contains, each different text once. A part is looked
    up by the rarest of its runs of three characters, or by itself if it is shorter, among those of the wholes."""

    def runs(text: Column, size) -> Column:
        n = F.length(text) - size + 1
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(size) if isinstance(size, int) else size))).otherwise(F.array().cast("array<string>"))

    whole, part = F.col("whole"), F.col("part")
    every = F.array_distinct(F.flatten(F.array(F.array(F.lit("")), *[runs(whole, q) for q in range(1, GRAM + 1)])))
    of_wholes = wholes.select("whole").filter("whole IS NOT NULL").distinct().select("whole", F.explode(every).alias("gram"))
    own = F.when(part == "", F.array(F.lit(""))).otherwise(runs(part, F.least(F.lit(GRAM), F.length(part))))
    of_parts = parts.select("part").filter("part IS NOT NULL").distinct().select("part", F.explode(F.array_distinct(own)).alias("gram"))
    counts = of_wholes.groupBy("gram").agg(F.count("*").alias("n"))
    # a part with a run that no whole has is in none; its other runs may still be looked up, and give nothing
    rarest = of_parts.join(counts, "gram").groupBy("part").agg(F.min(F.struct("n", "gram")).alias("r")).select("part", F.col("r.gram").alias("gram"))
    return rarest.join(of_wholes, "gram").filter(whole.contains(part)).select("part", "whole")


def resolve_names(names: DataFrame, groups: DataFrame, aliases: DataFrame) -> DataFrame:
    """(raw, group_id, step) for each different name: equal, by alias, contained in a group's name, or containing
    one; the least id where several fit."""
    raw = names.select("raw").distinct()
    found = raw.join(groups, F.col("raw") == F.col("group_name")).select("raw", "group_id", F.lit(1).alias("step"))
    by_alias = raw.join(aliases, F.col("raw") == F.col("alias")).join(groups, "group_name").select("raw", "group_id", F.lit(2).alias("step"))
    found = found.union(by_alias)
    rest = raw.join(found, "raw", "left_anti")
    known = groups.select(F.col("group_name").alias("name"))
    inside = containing(rest.select(F.col("raw").alias("part")), known.select(F.col("name").alias("whole"))).select(F.col("part").alias("raw"), F.col("whole").alias("group_name"), F.lit(3).alias("step"))
    around = containing(known.select(F.col("name").alias("part")), rest.select(F.col("raw").alias("whole"))).select(F.col("whole").alias("raw"), F.col("part").alias("group_name"), F.lit(4).alias("step"))
    near = inside.union(around).join(groups, "group_name").select("raw", "group_id", "step")
    best = found.union(near).groupBy("raw").agg(F.min(F.struct("step", "group_id")).alias("b"))
    return raw.join(best, "raw", "left").select("raw", "b.group_id", "b.step")


def _tie(df: DataFrame) -> Column:
    """A number for each row by which equal keys are told apart alike on every run."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if kind.startswith("map") else F.col(c) for c, kind in df.dtypes])


def upsert_latest(batches: DataFrame, keys: list[str], batch: str = "batch") -> DataFrame:
    """The row of the last batch for each key; of several in one batch, that of the least hash."""
    last = Window.partitionBy(*keys).orderBy(F.desc(batch), _tie(batches))
    return batches.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn")


def upsert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose key it lacks; of several, that of the least hash."""
    first = Window.partitionBy(*keys).orderBy(_tie(new))
    once = new.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
    return old.unionByName(once.join(old, keys, "left_anti"))


def incremental_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.join(old, key, "left_anti")


def upsert_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The keys of both with the action that brings old up to new: insert, update, same or keep."""
    o, n = old.select(*keys, F.struct(*values).alias("old")), new.select(*keys, F.struct(*values).alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "keep").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("update")
    return o.join(n, keys, "full").select(*keys, action.alias("action"))


def dedupe_events(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the events of new that it lacks, once each; ids follow from the key, not from a sequence."""
    first = Window.partitionBy(*keys).orderBy("event_id")
    fresh = new.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn").join(old, keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def count_compare(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """Row counts of two stores, table by table."""

    def counts(store: dict[str, DataFrame], name: str) -> DataFrame:
        parts = [df.agg(F.count("*").alias(name)).select(F.lit(t).alias("table"), name) for t, df in sorted(store.items())]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    both = counts(left, "source_rows").join(counts(right, "target_rows"), "table", "full")
    return both.select("*", F.col("source_rows").eqNullSafe(F.col("target_rows")).alias("equal"))


def parse_date(text: Column) -> Column:
    """A date in one of the known forms, else null."""
    return F.coalesce(*[F.try_to_date(text, form) for form in ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "yyyy/MM/dd", "d MMM yyyy")])


def drop_empty(fields: Column) -> Column:
    """A map without fields that are null or blank."""
    return F.map_filter(fields, lambda k, v: v.isNotNull() & (F.trim(v) != ""))


def without_empty(value: Column, kind: T.DataType) -> Column:
    """A nested value of this type without empty texts, lists and records, at any depth: fields of records become null, elements of
    lists and entries of maps go. It is one pass from the top: what is empty only after it has lost its empty parts stays. A record
    is empty if all its fields are null."""

    def empty(v: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StringType):
            return v == ""
        if isinstance(t, (T.ArrayType, T.MapType)):
            return F.size(v) == 0
        if isinstance(t, T.StructType):
            return v.isNotNull() & reduce(lambda x, y: x & y, [v[f.name].isNull() for f in t.fields], F.lit(True))
        return F.lit(False)

    kept = lambda t: lambda v: ~F.coalesce(empty(v, t), F.lit(False))
    if isinstance(kind, T.StructType):
        fields = [x for f in kind.fields for x in (F.lit(f.name), F.when(kept(f.dataType)(value[f.name]), without_empty(value[f.name], f.dataType)))]
        return F.when(value.isNotNull(), F.named_struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(F.filter(value, kept(kind.elementType)), lambda v: without_empty(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.map_filter(value, lambda _, v: kept(kind.valueType)(v)), lambda _, v: without_empty(v, kind.valueType))
    return value


def with_dense_ids(rows: DataFrame, order: list[str], after: int, name: str) -> DataFrame:
    """rows with the column `name`: after + 1, after + 2 and so on in this order, equal rows of which may stand either way. Ranges of the
    order are sorted side by side; the numbers in a range follow those of the ranges before it, whose counts are one row for each."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(spread, *order).sortWithinPartitions(*order)
    # the upper bits of the growing number are the partition's, the lower 33 count its rows
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    written = materialize(sorted_.select("*", F.spark_partition_id().alias("__part"), place.alias("__place")), "dense-ids")
    counts = written.groupBy("__part").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("__part", "n"))).alias("all"))
    before = F.aggregate(F.filter("all", lambda x: x["__part"] < F.col("part")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    starts = counts.select("all", F.explode(F.transform("all", lambda x: x["__part"])).alias("part")).select(F.col("part").alias("__part"), before.alias("__before"))
    numbered = written.join(F.broadcast(starts), "__part")  # one row for each partition
    return numbered.select(*rows.columns, (F.col("__before") + F.col("__place") + 1 + after).alias(name))


def events_after(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old, and the events of new that it lacks by their keys, once each, with ids that follow the largest of old without a gap, in
    this order."""
    first = Window.partitionBy(*keys).orderBy(*order, _tie(new))
    fresh = new.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn", "event_id").join(old, keys, "left_anti")
    last = old.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
    return old.unionByName(with_dense_ids(fresh, order, last, "event_id"), allowMissingColumns=True)


ACTIONS = ("insert", "update", "same", "keep")


def load_changes(store: Store, name: str, new: DataFrame, keys: list[str], values: list[str]) -> dict[str, int]:
    """Brings a stored table up to new: keys that it lacks come in, values that differ are taken over, all else stays. Gives how many
    rows each action had, counted by the pass that writes them."""
    old = store.read(name)
    o, n = old.select(*keys, F.struct(*values).alias("old")), new.select(*keys, F.struct(*values).alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "keep").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("update")
    merged = o.join(n, keys, "full").select(*keys, action.alias("action"), F.coalesce("new", "old").alias("v"))
    seen = Observation()
    counted = merged.observe(seen, *[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])
    store.replace({name: counted.select(*keys, "v.*").select(*old.columns)})
    return {a: seen.get[a] for a in ACTIONS}


def lenient_json(text: Column, schema: str) -> Column:
    """JSON that may have a comma before a closing bracket."""
    return F.from_json(F.regexp_replace(text, r",(\s*[\]}])", "$1"), schema)
