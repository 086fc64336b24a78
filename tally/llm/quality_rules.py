"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Fixed base rules fail a text at once. The method's rules each give a score, larger for worse texts, and reject
a text whose score is above a cutoff. Labelled texts that pass the base rules are dealt to two halves by a hash of
their doc_id. The first half proposes: in each stratum (a language), for each rule the cutoff that rejects most bad
texts, less `good_cost` times the good texts, the largest where several are equal; and the order of the rules, by
that gain. The second half, the holdout, certifies: the rules are taken one after another as long as the exact
binomial tail says that at most `risk` of the stratum's good texts are rejected by any of those taken, all
together, at the level `delta` divided by the number of strata tested (Bonferroni). Within a stratum the tests
follow a sequence that the holdout has no part in and end at the first failure, so they need no further correction.
With probability 1 - delta, every stratum loses at most `risk` of its good texts to the union of its rules. A rule
that is not taken, and a stratum with too few labels, rejects nothing.

Nulls: a null text has no words and fails the base rules; a null language is a stratum of its own; labels that
are null, or whose doc_id is null, are left out; a doc_id that has several labels counts as bad if one says so, and
one that several rows of a stratum have counts once, with the largest of their scores.
Empty texts fail the base rules. Repeated rows are separate documents. Empty tables give empty results, empty
labels reject by the base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import SPACE, materialize, text_or_empty

MIN_WORDS = 20
MOST_REPEAT_PERCENT = 30
WINDOW = 8
RISK = 0.02
DELTA = 0.05
GOOD_COST = 5
#: Cutoffs tested for each rule; scores are shares from 0 to 1.
CUTOFFS = (0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
RULES = ("symbols", "marks", "capitals", "dup_lines", "repeats")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """How many words stand in a window of eight words that occurs twice or more in the text."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            beside = lambda x, j: F.coalesce(F.try_element_at(p, j)["h"] == x["h"], F.lit(False))
            # element j of the array is try_element_at(j + 1); index 0 is not allowed, so the first looks ahead only
            same = F.filter(p, lambda x, j: F.when(j > 0, beside(x, F.greatest(j, F.lit(1)))).otherwise(F.lit(False)) | beside(x, j + 2))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        add = lambda acc, at: F.struct(at.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("sum"))
        count = lambda s: F.aggregate(s, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")), add, lambda acc: acc["sum"])
        return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0)).otherwise(_let(pairs, lambda p: count(starts(p))))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(windows, covered))


def features(docs: DataFrame, stratum: str = "lang", carry: tuple = ()) -> DataFrame:
    """doc_id, the columns of carry, stratum, the counts of the base rules, base_failed and the rules' scores."""
    text = text_or_empty()
    line_words = lambda line: line.rlike(r"[^\x20\x09-\x0D]")

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), _repeated(words).cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n"), line_words)
    drop = lambda keep: F.length(F.regexp_replace(text, F.lit(keep), F.lit(""))).cast("long")
    # as the one element of an exploded array, the counts are not computed again by what filters on them
    counted = F.struct(
        _let(F.array_remove(F.split(text, SPACE), ""), counts).alias("w"),
        drop(r"[^#*$%&|<>]+").alias("n_symbols"),
        drop(r"[^!?]+").alias("n_marks"),
        drop(r"[^\p{Lu}]+").alias("n_capitals"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )
    one = docs.select("doc_id", *carry, F.coalesce(F.concat(F.lit("s:"), F.col(stratum).cast("string")), F.lit("null")).alias("stratum"), F.explode(F.array(counted)).alias("c"))
    flat = one.select("doc_id", *carry, "stratum", "c.w.n_words", "c.w.word_chars", "c.n_symbols", F.col("c.l.dup").alias("n_dup_lines"), "c.w.n_repeat_words", "c.n_marks", "c.n_capitals", F.col("c.l.n").alias("n_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEAT_PERCENT)
    share = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(1.0), F.col(a) / F.col(b))).otherwise(F.lit(0.0))
    scores = {"symbols": ("n_symbols", "word_chars"), "marks": ("n_marks", "n_words"), "capitals": ("n_capitals", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
    return flat.select("*", failed.alias("base_failed"), *[share(*scores[r]).alias(f"score_{r}") for r in RULES])


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial with n trials of chance p, exact: the terms' logarithms follow one another, and
    the sum is kept relative to the largest term, so that no term underflows."""
    log_odds = F.log(F.lit(p / (1 - p)))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + log_odds
        top = F.greatest(acc["top"], term)
        return F.struct(term.alias("term"), top.alias("top"), (acc["sum"] * F.exp(acc["top"] - top) + F.exp(term - top)).alias("sum"))

    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("term"), first.alias("top"), F.lit(1.0).alias("sum"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    # beyond the mean the tail is over a third; there is nothing to certify and no need to add it up
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(steps, start, add, lambda acc: acc["sum"] * F.exp(acc["top"])))


def is_holdout(doc_id: Column) -> Column:
    """Whether the labelled text certifies rules instead of proposing them."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 1), 16, 10).cast("int") % 2 == 1


def labelled(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, doc_id, good, holdout, the rules' scores) of the labelled texts that pass the base rules."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = scored.filter(~F.col("base_failed")).join(marks, "doc_id")
    once = known.groupBy("stratum", "doc_id").agg((F.min("quality") == 1).alias("good"), *[F.max(f"score_{r}").alias(f"score_{r}") for r in RULES])
    return once.withColumn("holdout", is_holdout(F.col("doc_id")))


def proposals(known: DataFrame, good_cost: int = GOOD_COST) -> DataFrame:
    """(stratum, rule, cutoff, place) from the proposing half: the best cutoff of each rule that has one, in the
    order in which they are to be certified. One pass over the labelled texts gives counts for each stratum, rule and
    interval between cutoffs; the rest works on these counts."""
    cutoffs = F.array(*[F.lit(c) for c in CUTOFFS])
    above = lambda rule: F.size(F.filter(cutoffs, lambda c: F.col(f"score_{rule}") > c))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), above(r).alias("above")) for r in RULES])).alias("r")
    counts = known.filter("not holdout").select("stratum", "good", rules).groupBy("stratum", "r.rule", "r.above").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # a text whose score is above j cutoffs is rejected by the first j
    tested = F.explode(F.transform(F.lit(cutoffs), lambda c, j: F.struct(c.alias("cutoff"), (j + 1).alias("needs")))).alias("t")
    reject = lambda kind: F.sum(F.when(F.col("above") >= F.col("t.needs"), F.col(kind)).otherwise(0))
    gain = (reject("bad") - reject("good") * good_cost).alias("gain")
    by_cutoff = counts.select("*", tested).groupBy("stratum", "rule", "t.cutoff").agg(gain).filter("gain > 0")
    best = by_cutoff.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("best"))
    order = Window.partitionBy("stratum").orderBy(F.desc("best.gain"), "rule")  # at most one row for each rule
    return best.select("stratum", "rule", "best.cutoff", F.row_number().over(order).alias("place"))


def calibrate(scored: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, good_cost: int = GOOD_COST) -> DataFrame:
    """(stratum, rule, cutoff): what is certified on the holdout."""
    known = materialize(labelled(scored, labels), "quality-labelled")
    proposed = materialize(proposals(known, good_cost), "quality-proposed")
    path = proposed.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("place", "rule", "cutoff"))).alias("path"))
    scores = F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(f"score_{r}"))])
    held = known.filter("holdout and good").select("stratum", scores.alias("scores")).join(path, "stratum")
    first = F.array_min(F.transform(F.filter("path", lambda p: F.element_at("scores", p["rule"]) > p["cutoff"]), lambda p: p["place"]))
    counts = held.groupBy("stratum", first.alias("first")).agg(F.count("*").alias("n"))
    joint = proposed.join(counts, "stratum").groupBy("stratum", "rule", "cutoff", "place").agg(F.sum("n").alias("n_good"), F.coalesce(F.sum(F.when(F.col("first") <= F.col("place"), F.col("n"))), F.lit(0)).alias("rejected"))
    tests = proposed.agg(F.count_distinct("stratum").alias("tests"))
    tail = binomial_tail(F.col("n_good"), F.col("rejected"), risk)
    # what is rejected grows along the path, so what follows a failure fails as well
    return joint.crossJoin(F.broadcast(tests)).filter(tail <= F.lit(delta) / F.col("tests")).select("stratum", "rule", "cutoff")


def verdicts(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """scored with kept: not failed by the base rules, and above no cutoff of its stratum."""
    by_stratum = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(F.col(f"score_{rule}") > F.try_element_at("cutoffs", F.lit(rule)), F.lit(False))
    return scored.join(by_stratum, "stratum", "left").select(*scored.columns, (~F.col("base_failed") & ~rejected).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The features of each document with its verdict."""
    scored = materialize(features(docs, stratum), "quality-features")
    return verdicts(scored, materialize(calibrate(scored, labels, risk, delta), "quality-cutoffs"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs. The features are computed once for the cutoffs
    and once beside each row, which is less work than a shuffle of all texts to join them."""
    beside = docs.select(F.struct("*").alias("row")).select("row", "row.doc_id", "row.text", F.col(f"row.`{stratum}`").alias("stratum_of"))
    scored = features(beside, "stratum_of", carry=("row",))
    known = materialize(features(docs, stratum), "quality-features")
    cutoffs = materialize(calibrate(known, labels), "quality-cutoffs")
    return verdicts(scored, cutoffs).filter("kept").select("row.*")
