"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from fixed patterns: e-mail addresses, IPv4 addresses, card numbers that pass Luhn's check and phone numbers with
a plus sign. They always stay. The method adds spans of other kinds: `mail` (addresses with a spelled-out at sign), `ipv6`,
`account` (numbers of 13 to 19 digits with other separators or lengths than a card's, that pass the check too) and
`tel` (phone numbers without a plus sign). Their candidates are found by wide patterns, and those that meet a base span are let go.

Labelers vote on each candidate: +1 for, -1 against, 0 abstains. Some are regular expressions (strict forms, look-alikes), some
gazetteers (top-level domains, issuer and dialling prefixes), some look at the context (words before, other personal data in
the text). The counts of the different patterns of votes, at most 3 to the number of labelers for each kind, are all that
expectation-maximisation needs: in turn it estimates how each labeler votes on true and on false candidates, and how likely each
pattern is true. These estimates are the soft labels of the final classifier, a naive Bayes over features of the span and its
context that no labeler sees: its shape, its first characters, the words beside it. Its counts cover all candidates. A candidate
becomes a span if its estimated chance is MOST_SURE or more.

Patterns take possessive repeats and look behind at runs of characters, so that time is linear in the text. Positions are code
points. Starts come from the lengths of what stands between the matches, added up in blocks.

Nulls: a null text is empty. Null doc_ids are kept. Repeated rows are separate documents. Very long texts are taken whole. Empty
tables give an empty result, and kinds without candidates no spans. Other columns take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import materialize, text_or_empty

BASE = ("email", "ip", "card", "phone")
ADDED = ("mail", "ipv6", "account", "tel")

#: The base patterns, written so that they match the same strings in linear time: no repeat gives back what it took, and no match
#: begins within a run that has failed.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Candidates of the added kinds.
_AT, _DOT = r" ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| (?:at|AT) ", r" ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) |\."
_HEX = "[0-9A-Fa-f]{1,4}"
CANDIDATES = {
    "mail": rf"(?<!{_LOCAL}){_LOCAL}++(?:{_AT})[A-Za-z0-9-]++(?:(?:{_DOT})[A-Za-z0-9-]++)++",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,5}})?::{_HEX}(?::{_HEX}){{0,5}})(?![0-9A-Za-z:])",
    "number": r"(?<![0-9A-Za-z+._])\(?[0-9](?:[\x20().\x2f-]{0,2}+[0-9]){6,}+",
}

#: Fixed values of the gazetteers and of the words of context.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "cat", "es", "fr", "de", "it", "pt", "uk", "us", "ch", "at", "be", "nl")
ISSUERS = r"^(?:3[47]|30[0-5]|3[689]|4|5[0-8]|6[0-9]|2[2-7])"
DIALLING = r"^(?:00[1-9]|0[1-9]|1?[2-9][0-9]{2}[2-9]|[6789][0-9]{8}$)"
NETWORKS = r"(?i)^(?:2[0-9a-f]{3}:|fe80:|f[cd][0-9a-f]{2}:|::1$|::ffff:)"
WORDS_BEFORE = {
    "mail": r"\b(?:e-?mail|mail|contact|write|correo|courriel|adresse?|kontakt|correu)\b",
    "ipv6": r"\b(?:ip|ipv6|host|server|addr(?:ess)?|client|serveur|servidor)\b",
    "account": r"\b(?:card|visa|mastercard|amex|credit|debit|account|tarjeta|cuenta|carte|compte|karte|konto|targeta)\b",
    "tel": r"\b(?:tel|phone|telephone|mobile|cell|call|fax|t[eé]l[eé]fono?|t[eé]l[eé]phone|m[oó]vil|telefon|handy|portable|mòbil)\b",
}
WORDS_AGAINST = r"\b(?:isbn|issn|doi|order|invoice|page|version|ref|id|no|serial|art|fig|table|token|key|hash)\b"

LABELERS = ("form", "look_alike", "gazetteer", "words_before", "company", "edges")
ROUNDS = 25
SMOOTH = 1.0
#: Feature values are hashed to so many numbers each.
VALUES = 256
FEATURES = ("shape", "start", "before", "after", "length", "last_mark")
MOST_SURE = 0.9
CONTEXT = 32
_BLOCK = 256
_MILLION = 1_000_000


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums_before(sizes: Column) -> Column:
    """For each element the sum of those before it. Blocks are added up first, so that no long array grows by one
    element at a time."""

    def running(xs: Column, start: Column) -> Column:
        add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["all"], acc["sum"]).alias("all"))
        return F.aggregate(xs, F.struct(start.cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all")), add, lambda acc: acc["all"])

    def by_block(blocks: Column) -> Column:
        total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)
        return _let(running(F.transform(blocks, total), F.lit(0)), lambda starts: F.flatten(F.zip_with(blocks, starts, running)))

    count = F.ceil(F.size(sizes) / F.lit(_BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK)))
    return F.when(F.size(sizes) > 0, _let(blocks, by_block)).otherwise(F.array().cast("array<bigint>"))


def _found(text: Column, pattern: str, wanted: str) -> Column:
    """The matches in order: (start, end, match, before, after), the last two being what stands between the matches. A text that
    lacks what `wanted` says has none and is not searched."""

    def placed(matches: Column, gaps: Column) -> Column:
        sizes = F.zip_with(gaps, matches, lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
        whole = lambda starts: F.transform(matches, lambda m, i: _match(m, F.get(gaps, i), F.get(gaps, i + 1), F.get(starts, i)))
        return _let(_sums_before(sizes), whole)

    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>")
    both = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, _let(F.split(text, pattern, -1), lambda g: placed(m, g))).otherwise(none))
    return F.when(text.rlike(wanted), both).otherwise(none)


def _match(match: Column, before: Column, after: Column, start: Column) -> Column:
    at = start + F.length(before)
    return F.struct(at.alias("start"), (at + F.length(match)).alias("end"), match.alias("match"), F.substring(before, -CONTEXT, CONTEXT).alias("before"), F.substring(after, 1, CONTEXT).alias("after"))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, F.lit("[^0-9]+"), F.lit(""))


def passes_luhn(number: Column) -> Column:
    """number: ASCII digits."""
    values = F.transform(F.split(F.reverse(number), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def base_spans(text: Column) -> Column:
    """(kind, start, end) of the base kinds, by kind as listed, then by start."""

    def card(m: Column) -> Column:
        size = F.length(digits(m["match"]))
        # F.when keeps long runs of digits from the check
        return F.when((size < 16) | (size > 19), F.lit(False)).otherwise(passes_luhn(digits(m["match"])))

    def phone(m: Column) -> Column:
        return F.length(digits(m["match"])).between(8, 15)

    def ip(m: Column) -> Column:
        return m["match"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")

    found = {
        "email": (_found(text, EMAIL, "@"), lambda m: F.lit(True)),
        "ip": (_found(text, IP, r"[0-9]\.[0-9]"), ip),
        "card": (_found(text, CARD, r"[0-9](?:[\x20-]?[0-9]){15}"), card),
        "phone": (_found(text, PHONE, r"\+[0-9]"), phone),
    }
    span = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    return F.concat(*[F.transform(F.filter(matches, keep), span(kind)) for kind, (matches, keep) in found.items()])


def _kind(name: str, m: Column) -> Column:
    """The kind of a candidate, null if it is none."""
    size = F.length(digits(m["match"]))
    if name == "number":
        return F.when(size <= 12, F.lit("tel")).when(size <= 19, F.lit("account"))
    return F.lit(name)


def _by_kind(kind: Column, options: dict[str, Column]) -> Column:
    return reduce(lambda c, k: c.when(kind == k, options[k]), options, F.when(F.lit(False), F.lit(0))).otherwise(F.lit(0))


def _vote(yes: Column, no: Column | None = None) -> Column:
    against = F.lit(0) if no is None else F.when(no, F.lit(-1)).otherwise(F.lit(0))
    return F.when(yes, F.lit(1)).otherwise(against)


def _votes(kind: Column, m: Column, n_base: Column) -> Column:
    """One vote of each labeler."""
    text, number = m["match"], digits(m["match"])
    never = F.lit(False)
    form = {
        "mail": _vote(text.rlike(r"[\[({<] ?(?:at|AT|@)")),
        "ipv6": _vote(text.rlike(r"(?:[0-9A-Fa-f]+:){7}") | (F.length(F.regexp_replace(text, F.lit("[^:]+"), F.lit(""))) >= 4), F.length(text) < 6),
        "account": _vote(text.rlike(r"^[0-9]{4}(?:[ .\x2f-])[0-9]{4}(?:[ .\x2f-])[0-9]{4}|^3[47][0-9]{2}[ .-]?[0-9]{6}[ .-]?[0-9]{5}$"), text.rlike(r"[()]")),
        "tel": _vote(text.rlike(r"^\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4})?$"), text.rlike(r"[ .()\x2f-]{2}[0-9]{1,2}$")),
    }
    alike = {
        "mail": _vote(never, text.rlike(r"(?i)(?:^| )(?:look|is|was|are|be|not|and|only|all) ?at ")),
        "ipv6": _vote(never, text.rlike(r"^[0-9]{1,2}(?::[0-9]{2}){1,2}$|^[a-fA-F]+::[a-fA-F]+$")),
        "account": _vote(never, text.rlike(r"^([0-9])\1+$|^[0-9]+(?:\.[0-9]+)$")),
        "tel": _vote(never, text.rlike(r"^(?:1[89]|20)[0-9]{2}[ .\x2f-]|[ .\x2f-](?:1[89]|20)[0-9]{2}$|^[0-9]{1,3}(?:[ .][0-9]{3})+$|^[0-9]+$|^[0-9]+\.[0-9]+$")),
    }
    gazetteer = {
        "mail": _vote(F.lower(F.regexp_extract(text, "([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS), F.lit(True)),
        "ipv6": _vote(text.rlike(NETWORKS), F.lit(True)),
        "account": _vote(number.rlike(ISSUERS), F.lit(True)),
        "tel": _vote(number.rlike(DIALLING), F.lit(True)),
    }
    left = F.lower(m["before"])
    before = {k: _vote(left.rlike(WORDS_BEFORE[k]), left.rlike(WORDS_AGAINST)) for k in ADDED}
    company = _vote(n_base > 0)
    edges = _vote(m["after"].rlike(r"^[\s.,;)\"']|^$") & m["before"].rlike(r"[\s:(\"']$|^$"), m["after"].rlike(r"^[A-Za-z0-9_%]") | m["before"].rlike(r"[A-Za-z0-9_#$=]$"))
    return F.array(*[_by_kind(kind, x) for x in (form, alike, gazetteer, before)], company, edges).cast("array<int>")


def _features(m: Column) -> Column:
    """Hashed values, one for each of FEATURES."""
    shape = lambda s: F.regexp_replace(F.regexp_replace(s, F.lit("[0-9]"), F.lit("9")), F.lit(r"\p{L}+"), F.lit("a"))
    word = lambda s, pattern: F.lower(shape(F.regexp_extract(s, pattern, 1)))
    values = (
        shape(m["match"]),
        F.substring(m["match"], 1, 2),
        word(m["before"], r"(\S*)\s*$"),
        word(m["after"], r"^\s*(\S*)"),
        F.length(m["match"]).cast("string"),
        F.regexp_extract(m["match"], r"([^0-9A-Za-z])[0-9A-Za-z]*$", 1),
    )
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), v), F.lit(VALUES)).cast("int") for i, v in enumerate(values)])


def candidates(text: Column, base: Column) -> Column:
    """(kind, start, end, votes, features) of what the wide patterns find and no base span meets. Numbers of an account must pass
    Luhn's check."""
    wanted = {"mail": r"[\[({<] ?(?:at|AT|@) ?[\])}>]| (?:at|AT) ", "ipv6": "::|:[0-9A-Fa-f]{1,4}:", "number": "[0-9]{2}"}

    def named(name: str):
        return lambda m: F.struct(_kind(name, m).alias("kind"), m.alias("m"))

    def stays(c: Column) -> Column:
        sound = F.when(c["kind"] == "account", passes_luhn(digits(c["m"]["match"]))).otherwise(F.lit(True))
        return c["kind"].isNotNull() & sound & ~F.exists(base, lambda b: (b["start"] < c["m"]["end"]) & (c["m"]["start"] < b["end"]))

    def judged(c: Column) -> Column:
        return F.struct(c["kind"].alias("kind"), c["m"]["start"].alias("start"), c["m"]["end"].alias("end"), _votes(c["kind"], c["m"], F.size(base)).alias("votes"), _features(c["m"]).alias("features"))

    every = F.concat(*[F.transform(_found(text, CANDIDATES[name], wanted[name]), named(name)) for name in CANDIDATES])
    return F.transform(F.filter(every, stays), judged)


def looked_through(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates), written to the shared folder: what later steps need of the texts."""
    # as elements of exploded arrays, texts are searched once, whatever reads the result
    first = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", "text", F.explode(F.array(base_spans(F.col("text")))).alias("base"))
    return materialize(first.select("doc_id", "base", F.explode(F.array(candidates(F.col("text"), F.col("base")))).alias("candidates")), "pii-candidates")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def estimate(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, votes, n, chance, odds): each pattern of votes with the estimated chance that its candidates are true, and for each
    labeler and vote (-1, 0, 1) what the vote adds to the logarithm of the odds. A kind's patterns, a bounded number, meet in one
    row, and there expectation-maximisation goes on for `rounds` rounds from the share of votes for."""
    patterns = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n"))
    rows = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))
    p = F.col("p")

    def odds(q: Column) -> Column:
        """The last element is that of the share of true candidates."""
        weight = lambda true, same: _sum(F.zip_with(p, q, lambda x, y: F.when(same(x), x["n"] * (y if true else 1 - y)).otherwise(F.lit(0.0))))
        any_ = lambda x: F.lit(True)

        def of(totals: Column) -> Column:
            true, false = totals["true"], totals["false"]

            def one(j: Column, v: Column) -> Column:
                same = lambda x: F.get(x["votes"], j) == v
                return F.log((weight(True, same) + SMOOTH) / (true + 3 * SMOOTH)) - F.log((weight(False, same) + SMOOTH) / (false + 3 * SMOOTH))

            each = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(LABELERS) - 1)), lambda j: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda v: one(j, v))))
            return F.array_append(each, F.log((true + SMOOTH) / (false + SMOOTH)))

        return _let(F.named_struct(F.lit("true"), weight(True, any_), F.lit("false"), weight(False, any_)), of)

    def expected(table: Column) -> Column:
        def one(x: Column) -> Column:
            sums = F.aggregate(F.transform(x["votes"], lambda v, j: F.get(table, j * 3 + v + 1)), F.element_at(table, -1), lambda a, y: a + y)
            return 1 / (1 + F.exp(-sums))

        return F.transform(p, one)

    # the share of votes for, kept from 0 and 1
    start = F.transform(p, lambda x: (F.size(F.filter(x["votes"], lambda v: v > 0)) + 1.0) / (F.size(F.filter(x["votes"], lambda v: v != 0)) + 2.0))
    settled = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda q, _: _let(odds(q), expected))
    done = rows.select("kind", "p", F.explode(F.array(settled)).alias("q")).select("kind", F.explode(F.arrays_zip("p", "q")).alias("x"), F.explode(F.array(odds(F.col("q")))).alias("odds"))
    return materialize(done.select("kind", F.col("x.p.votes").alias("votes"), F.col("x.p.n").alias("n"), F.col("x.q").alias("chance"), "odds"), "pii-votes")


def _kind_number(kind: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(k) for k in ADDED]), kind) - 1).cast("int")


def train(found: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: `weights`, what each value of each feature adds to the logarithm of the odds, for each kind, and after them the kinds'
    starts. Labels are rounded to millionths, so that the sums are exact."""
    soft = F.broadcast(labels.select("kind", "votes", F.round(F.col("chance") * _MILLION).cast("long").alias("true")))  # at most 3^len(LABELERS) rows a kind
    known = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features").join(soft, ["kind", "votes"])
    size = len(FEATURES) * VALUES
    places = F.transform("features", lambda v, i: _kind_number(F.col("kind")) * size + i * VALUES + v)
    totals = F.lit(len(ADDED) * size) + _kind_number(F.col("kind"))
    counts = known.select("true", F.explode(F.array_append(places, totals)).alias("at")).groupBy("at").agg(F.sum("true").alias("true"), F.sum(F.lit(_MILLION) - F.col("true")).alias("false"))
    spark = found.sparkSession
    kind_of = F.when(F.col("at") < len(ADDED) * size, F.floor(F.col("at") / size)).otherwise(F.col("at") - len(ADDED) * size).cast("int")
    every = spark.range(len(ADDED) * (size + 1)).select(F.col("id").cast("int").alias("at")).join(counts, "at", "left").select("at", kind_of.alias("k"), *[(F.coalesce(F.col(c), F.lit(0)) / _MILLION).alias(c) for c in ("true", "false")])
    whole = Window.partitionBy("k")
    all_ = lambda c: F.max(F.when(F.col("at") >= len(ADDED) * size, F.col(c))).over(whole)
    share = lambda c: F.log((F.col(c) + SMOOTH) / (F.col(f"all_{c}") + SMOOTH * VALUES))
    both = every.withColumns({f"all_{c}": all_(c) for c in ("true", "false")})
    weight = F.when(F.col("at") < len(ADDED) * size, share("true") - share("false")).otherwise(F.log((F.col("true") + SMOOTH) / (F.col("false") + SMOOTH)))
    # len(ADDED) * (len(FEATURES) * VALUES + 1) numbers
    return materialize(both.select("at", weight.alias("w")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("weights")), "pii-weights")


def find(docs: DataFrame, most_sure: float = MOST_SURE) -> DataFrame:
    """(doc_id, base, added): the base spans (kind, start, end) and those that the classifier adds, with their chance."""
    found = looked_through(docs)
    weights = F.broadcast(train(found, estimate(found)))
    size = len(FEATURES) * VALUES
    k = lambda c: _kind_number(c["kind"])

    def chance(c: Column) -> Column:
        start = F.get(F.col("weights"), F.lit(len(ADDED) * size) + k(c))
        parts = F.transform(c["features"], lambda v, i: F.get(F.col("weights"), k(c) * size + i * VALUES + v))
        return 1 / (1 + F.exp(-F.aggregate(parts, start, lambda a, x: a + x)))

    scored = F.transform("candidates", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), chance(c).alias("chance")))
    order = F.array_sort(F.transform(F.filter(scored, lambda c: c["chance"] >= most_sure), lambda c: F.struct(_kind_number(c["kind"]).alias("k"), c["start"].alias("start"), c.alias("c"))))
    return found.join(weights).select("doc_id", "base", F.transform(order, lambda x: x["c"]).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """The digest columns: counts of the base kinds, the base spans' digest, and all spans."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat("base", F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return found.select("doc_id", *[n(kind) for kind in BASE], F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(every).alias("spans"))
