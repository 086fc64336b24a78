"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words. A document of the source is expected target / source_size times;
the expected copies are summed up along the source's documents, in order of size, one offset per source is
added, and a document is emitted once for each integer that its step of the sum crosses. Documents in order of
size keep the words taken near the target: neighbours in the sum are about equally long.

All documents of one source share one step, so the sum before a document is rank * step, and ranks come from a
range partitioning by (source, size): ranks within a partition, plus the rows of the source in earlier
partitions. A source that holds most rows is spread over many partitions.

Nulls: a null text has size 0, the null source is a source of its own and stands last, null doc_ids are kept.
Sources of size 0 have target 0. Repeated rows are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import WORD, materialize, shuffle_partitions, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_TIMES = 2
#: Offsets are multiples of 1/65536, so that sums of whole steps stay exact.
OFFSET_STEPS = 65536


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie, row): the words of the whole text, a hash of the whole row for a total order,
    and the row itself."""
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(*hashable).alias("tie"), F.struct("*").alias("row"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share_percent=SHARE_PERCENT, most_times=MOST_TIMES) -> DataFrame:
    """One row for each source: source, source_size, target.

    Water filling: with sources in order of cap / weight, those before a point are full, and the rest share
    what is left by weight. The sums are decimals, so the comparison is exact."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    wide = T.DecimalType(38, 0)
    size, weight = F.col("source_size").cast(wide), F.col("weight").cast(T.DecimalType(10, 0))
    by_fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # amounts are in hundredths of a word
    each = each.select(
        "source", "source_size", "weight",
        (F.sum(size).over(whole) * share_percent - F.coalesce(F.sum(size).over(before), F.lit(0)) * (100 * most_times)).cast(wide).alias("left"),
        F.sum(weight).over(rest).cast(wide).alias("weights_left"),
    )
    full = F.col("left") * F.col("weight") >= F.col("source_size").cast(wide) * F.lit(100 * most_times) * F.col("weights_left")
    each = each.withColumn("full", full)
    level = Window.partitionBy()
    first = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / F.col("weight")).alias("ratio"), F.col("left").alias("left"), F.col("weights_left").alias("weights_left")))).over(level)
    each = each.withColumn("first", first)
    shared = (F.col("first.left") * F.col("weight")).cast("double") / (F.col("first.weights_left") * 100).cast("double")
    return each.select("source", "source_size", F.when(F.col("full"), (F.col("source_size") * most_times).cast("double")).otherwise(shared).alias("target"))


def offset(seed: str, source: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the source alone, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / OFFSET_STEPS


def copies(sized: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, tie) with source_size, target and copies: how often the mix emits the row."""
    spark = sized.sparkSession
    keys = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), F.col("tie")]
    dealt = sized.select("doc_id", "source", "size", "tie").repartitionByRange(shuffle_partitions(spark), *keys)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "mix-ranges")
    per_part = dealt.groupBy("source", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    here = Window.partitionBy("part", "source").orderBy("size", "doc_id", "tie")
    ranked = dealt.withColumn("rank_here", F.row_number().over(here)).alias("d")
    ranked = ranked.join(per_part.alias("p"), (F.col("d.part") == F.col("p.part")) & F.col("d.source").eqNullSafe(F.col("p.source")))
    ranked = ranked.select("d.doc_id", "d.source", "d.size", "d.tie", (F.col("base") + F.col("rank_here")).alias("rank"))
    joined = ranked.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = lambda rank: F.floor(step * rank + offset(seed, F.col("d.source")))
    return joined.select("d.doc_id", "d.source", "d.size", "d.tie", "source_size", "target", (crossed(F.col("rank")) - crossed(F.col("rank") - 1)).alias("copies"))


def mixture_plan(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """One row for each document with what the mix takes of it."""
    sized = materialize(sizes(docs).select("doc_id", "source", "size", "tie"), "mix-sizes")
    return copies(sized, materialize(source_targets(sized), "mix-targets"), seed)


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is emitted, with the columns of docs."""
    sized = sizes(docs)
    narrow = materialize(sized.select("doc_id", "source", "size", "tie"), "mix-sizes")
    plan = copies(narrow, materialize(source_targets(narrow), "mix-targets"), seed)
    # rows that are equal in every column are one row here, emitted as often as they are together
    plan = plan.groupBy(F.xxhash64("doc_id").alias("key"), "tie").agg(F.sum("copies").alias("copies")).filter(F.col("copies") > 0)
    once = sized.select(F.xxhash64("doc_id").alias("key"), "tie", "row").dropDuplicates(["key", "tie"])
    out = once.join(plan, ["key", "tie"])
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
