"""Parsers of scraped and asked text, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tally.functions.tables import OFF_TOPIC, STATUS_WORDS, SYNONYMS, TIER_WORDS

#: Fixed values of the language: number words, words for parts of an item in the order in which they are sought.
NUMBERS = {"zero": "0", "un": "1", "dos": "2", "tres": "3", "quatre": "4", "cinc": "5", "sis": "6", "set": "7", "vuit": "8", "nou": "9", "deu": "10", "una": "1", "dues": "2"}
PARTS = (("amb agulla", "a"), ("amb pilar", "a"), ("manilles", "m"), ("per sota", "s"), ("puntals", "p"), ("agulla", "a"), ("folre", "f"), ("pilar", "a"))
MOST_TOKENS = 25
FOLLOW_UP = ("i els ", "i de ", "i dels ", "i la ", "i les ", "i el ", "i al ", "i a ", "i l'")
FOLLOW_UP_CHARS = 50
#: Categories of text lines by keywords in capitals; the first one with a hit counts. Fixed values.
CATEGORIES = (
    ("introduction", ("QUE SON ELS CASTELLS",)),
    ("history", ("HISTÒRIA", "ELS ORÍGENS", "PRIMERES COLLES", "ÈPOCA D'OR", "DECADÈNCIA", "RENAIXENÇA", "FRANQUISME", "RECUPERACIÓ", "BOOM", "AVUI")),
    ("technique", ("LA TÈCNICA", "PARTS D'UN CASTELL", "TIPUS DE CASTELL", "ESTRUCTURES")),
    ("music", ("MÚSICA", "ELS INSTRUMENTS", "EL TOC DE CASTELLS")),
    ("events", ("ACTUACIÓ", "ON I QUAN", "DIADES", "COM FUNCIONEN", "CONCURS")),
    ("values", ("VALORS", "AMATEURISME", "TREBALL EN EQUIP", "COHESIÓ", "TRADICIÓ")),
    ("colles", ("LES COLLES", "ORGANITZEN", "INDUMENTÀRIA")),
    ("unesco", ("UNESCO", "PATRIMONI")),
    ("safety", ("CONSELLS", "SEGURETAT", "RISCS")),
)
ACCENTS = ("àáâäèéêëìíîïòóôöùúûüçñ", "aaaaeeeeiiiioooouuuucn")


def fold(text: Column) -> Column:
    """Lower case without accents, for the letters of the languages at hand."""
    return F.translate(F.lower(F.trim(text)), *ACCENTS)


def place_city(raw: Column) -> Column:
    """struct(date, time, place, city): the first date and time, and what follows, cut where a capital stands
    right after a small letter; without such a place all of it is the city."""
    text = F.trim(F.replace(raw, F.lit("\n"), F.lit(" ")))
    date = F.nullif(F.regexp_extract(text, r"([0-9]{2}/[0-9]{2}/[0-9]{4})", 1), F.lit(""))
    time = F.nullif(F.regexp_extract(text, r"([0-9]{1,2}:[0-9]{2})", 1), F.lit(""))
    rest = F.trim(F.when(time.isNotNull(), F.regexp_replace(text, r"(?s)^.*?[0-9]{1,2}:[0-9]{2}", "")).when(date.isNotNull(), F.regexp_replace(text, r"(?s)^.*?[0-9]{2}/[0-9]{2}/[0-9]{4}", "")).otherwise(text))
    place = F.regexp_extract(rest, r"(?s)^(.*?\p{Ll})\p{Lu}", 1)
    city = F.when(place == "", rest).otherwise(F.expr("NULL"))
    return F.struct(date.alias("date"), time.alias("time"), F.trim(place).alias("place"), F.coalesce(city, F.trim(F.substring(rest, F.length(place) + 1, F.length(rest)))).alias("city"))


def result(raw: Column) -> Column:
    """struct(item_name, status) of "name (status)"."""
    text = F.trim(raw)
    status = F.nullif(F.regexp_extract(text, r"\(([^)]+)\)", 1), F.lit(""))
    name = F.when(status.isNotNull(), F.trim(F.regexp_replace(text, r"(?s)\([^)]+\).*$", ""))).otherwise(text)
    return F.struct(name.alias("item_name"), status.alias("status"))


def event_name(raw: Column) -> Column:
    """What follows the first small letter that a capital stands right after, else the whole."""
    tail = F.regexp_extract(raw, r"[a-z]([A-Z].*)", 1)
    return F.when(tail != "", tail).otherwise(raw)


def _parts(rest: Column) -> Column:
    """The letters of the parts that the text names, each word found taken out before the next is sought."""
    known = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(c).alias("code")) for w, c in PARTS])

    def seek(acc: Column, part: Column) -> Column:
        before = F.split_part(acc["rest"], part["word"], F.lit(1))
        after = F.substring(acc["rest"], F.length(before) + F.length(part["word"]) + 1, F.length(acc["rest"]))
        taken = F.struct(F.concat(before, after).alias("rest"), F.concat(acc["codes"], part["code"]).alias("codes"))
        return F.when(F.contains(acc["rest"], part["word"]), taken).otherwise(acc)

    start = F.struct(rest.alias("rest"), F.lit("").alias("codes"))
    return F.aggregate(known, start, seek, lambda acc: acc["codes"])


def _after(text: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(text, f"(?s)^.*?{pattern}", ""))


def item_code(question: Column) -> Column:
    """The code of the item that a question names, or an empty text: a code as such, a tower or pillar with its
    height, two number words (parts in their order, and only where they can be), or two numbers (parts by letter)."""
    text = F.lower(F.trim(question))
    direct = F.regexp_extract(text, r"\b([0-9]+d[0-9]+[afms]*)\b", 1)
    tower = F.regexp_extract(text, r"torre\s+de\s+([0-9]+)", 1)
    pillar = F.regexp_extract(text, r"pilar\s+de\s+([0-9]+)", 1)
    words = r"([a-z]+)\s+de\s+([a-z]+)"
    number = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    first, second = F.regexp_extract(text, words, 1), F.regexp_extract(text, words, 2)
    width = F.try_element_at(number, first)
    found = _parts(_after(text, r"[a-z]+\s+de\s+[a-z]+"))
    has = lambda c: F.contains(found, F.lit(c))
    ordered = F.concat(F.when(has("f"), "f").otherwise(""), F.when(has("f") & has("m"), "m").otherwise(""), F.when(has("f") & has("m") & has("p"), "p").otherwise(""), F.regexp_replace(found, "[^a]", ""), F.when(has("s"), "s").otherwise(""))
    by_word = F.concat(width, F.lit("d"), F.coalesce(F.try_element_at(number, second), second), ordered)
    digits = r"([0-9]+)\s+de\s+([0-9]+)"
    w, h = F.regexp_extract(text, digits, 1), F.regexp_extract(text, digits, 2)
    by_letter = F.array_join(F.array_sort(F.array_remove(F.split(_parts(_after(text, r"[0-9]+\s+de\s+[0-9]+")), ""), "")), "")
    return (
        F.when(direct != "", direct)
        .when(tower != "", F.concat(F.lit("2d"), tower))
        .when(pillar != "", F.concat(F.lit("Pd"), pillar))
        .when((first != "") & width.isNotNull(), by_word)
        .when(w != "", F.concat(w, F.lit("d"), h, by_letter))
        .otherwise("")
    )


def years(question: Column, most: int = 5) -> Column:
    """The years that a question names, in order: four digits, or two after "del" or "dels", up to 30 of this century."""
    text = F.lower(F.trim(question))
    long = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda x: x.cast("int"))
    short = F.transform(F.regexp_extract_all(text, F.lit(r"\bdels?\s+([0-9]{2})\b"), F.lit(1)), lambda x: F.when(x.cast("int") <= 30, x.cast("int") + 2000).otherwise(x.cast("int") + 1900))
    return F.slice(F.array_sort(F.array_distinct(F.concat(long, short))), 1, most)


def _first(tests: list[tuple[Column, str]]) -> Column:
    return reduce(lambda acc, t: acc.when(*t), tests[1:], F.when(*tests[0]))


def status(question: Column) -> Column:
    text = F.lower(F.trim(question))
    return _first([(text.rlike(rf"\b{word}\b"), value) for word, value in STATUS_WORDS])


def tier(question: Column) -> Column:
    text = F.lower(question)
    return _first([(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), name) for name, words in TIER_WORDS])


def rewrite_synonyms(question: Column) -> Column:
    longest_first = sorted(SYNONYMS.items(), key=lambda p: -len(p[0]))
    return reduce(lambda text, p: F.regexp_replace(text, "(?i)" + re.escape(p[0]), p[1]), longest_first, question)


def guard_flags(question: Column) -> Column:
    """struct(off_topic, too_long)."""
    text = F.lower(question)
    words = F.size(F.regexp_extract_all(question, F.lit(r"([^ \t\r\n]+)"), F.lit(1)))
    return F.struct(text.rlike("|".join(re.escape(w) for w in OFF_TOPIC)).alias("off_topic"), (words > MOST_TOKENS).alias("too_long"))


def decades(question: Column) -> Column:
    """The years of the decades and centuries that a question names."""
    text = F.lower(question)
    names = {80: "vuitanta", 70: "setanta", 90: "noranta", 60: "seixanta", 50: "cinquanta"}
    tests = [(rf"\banys?\s*{d}\b|\bdècada.*{d}\b|anys\s*{name}", 1900 + d, 1900 + d + 9) for d, name in names.items()]
    tests += [(rf"\bsegle\s*{roman}\b|segle\s*{n}", 100 * (n - 1), 100 * n - 1) for n, roman in ((18, "xviii"), (19, "xix"), (20, "xx"))]
    return F.flatten(F.array(*[F.when(text.rlike(p), F.sequence(F.lit(a), F.lit(b))).otherwise(F.array().cast("array<int>")) for p, a, b in tests]))


def categorize(text: Column, categories=CATEGORIES, default: str = "other") -> Column:
    upper = F.upper(text)
    return _first([(reduce(lambda a, b: a | b, [upper.contains(k) for k in keys]), name) for name, keys in categories]).otherwise(default)


def clean_answer(text: Column) -> Column:
    """A reply without table rows and rules, with plain spacing."""
    keep = F.filter(F.split(text, "\n"), lambda x: (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) < 2) & ~(x.rlike(r"^[\s|:-]+$") & x.contains("|")))
    out = F.array_join(keep, "\n")
    for pattern, new in ((r"\n{3,}", "\n\n"), (r"\s{2,}", " "), (r"\s+\.", "."), (r"\s+,", ",")):
        out = F.regexp_replace(out, pattern, new)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def slug(name: Column, suffix: str) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("colla_"), clean, F.lit(f"_{suffix}"))


def without_citations(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, r"\[[0-9]+\]", ""), r"\[cal citació\]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))
