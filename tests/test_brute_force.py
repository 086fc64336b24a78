"""Queries that SQL cannot say, against plain Python over the whole smallest tables."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from tally.functions import fuzzy
from tally.functions.tables import DISPLAY_NAMES, TEMPLATES
from tally.operators import linking, pages, quiz, retrieval
from tally.plans import roles
from tally.registry import parsing, quiz as quiz_registry, retrieval as registered
from tally.registry import queries

QUERIES = queries()
#: The queries without SQL, all of which are held against something here or in test_semantics.
COVERED = {"classify_question", "fuzzy_link", "link_cities", "link_events", "link_items", "page_extract", "quiz_dataset", "quiz_days", "quiz_groups", "quiz_items", "quiz_sample", "rerank_fuzzy", "vector_ivf"}


@pytest.fixture(scope="module")
def asked(spark, data):
    return [(r["qid"], r["text"]) for r in parsing.spoken(spark, data).collect()]


def cached(function):
    known = {}

    def call(*key):
        if key not in known:
            known[key] = function(*key)
        return known[key]

    return call


def best_templates(text):
    scores = []
    for name, phrases in TEMPLATES.items():
        score = max(difflib.SequenceMatcher(None, text, p).ratio() for p in phrases)
        scores.append((name, max(score, 0.8) if any(p in text for p in phrases) else score))
    return max(scores, key=lambda s: s[1])


def test_classify_question(spark, data):
    best = cached(best_templates)
    asked = parsing._routed(spark, data).collect()
    got = {r["qid"]: (r["template"], r["score"]) for r in QUERIES["classify_question"](spark, data).collect()}
    assert len(got) == len(asked)
    seen = set()
    for r in asked:
        name, score = best(r["text"].lower())
        if name == "contest_history" and r["has_places_in_contest"]:
            name = "contest_ranking"
        least = {"sql": 0.3, "hybrid": 0.3, "rag": 0.8, "direct": 0.85}[r["route"]]
        enough = score >= least and (r["has_entities"] or r["route"] in ("sql", "hybrid"))
        assert got[r["qid"]][0] == (name if enough else None), r["text"]
        assert got[r["qid"]][1] == (pytest.approx(score) if score >= 0.3 else None)
        seen.add(got[r["qid"]][0])
    assert len(seen) > 3


def ranked(texts, names, least, most):
    ratio = cached(lambda name, text: fuzzy.partial_ratio_of(name.lower(), text.lower()))
    out = set()
    for qid, text in texts:
        scored = sorted((-ratio(n, text), n) for n in names)
        out |= {(qid, n, round(-s, 6)) for s, n in scored[:most] if -s >= least}
    return out


def test_links_lose_nothing(spark, data, asked):
    groups = [r["name"] for r in parsing._names(spark, data).collect()]
    cities = [r["name"] for r in parsing._names(spark, data, "city").collect()]
    rows = lambda name: {(r["qid"], r["name"], round(r["score"], 6)) for r in QUERIES[name](spark, data).collect()}
    assert rows("fuzzy_link") == ranked(asked, groups, 85, 5)
    assert rows("link_cities") == ranked(asked, cities, 50, 3)


def test_link_events(spark, data, asked):
    names = [r["name"] for r in parsing._names(spark, data, "event_name").collect()]
    words = {"asia": "Fair ASIA", "europa": "Fair EUROPE", "africa": "Fair AFRICA", "america": "Fair AMERICA", "orient": "Fair MIDDLE EAST"}
    cleaned = lambda t: re.sub(r"\s+", " ", re.sub(r"\d+", "", re.sub(r"\b(" + "|".join(linking.EVENT_STOP_WORDS) + r")\b", "", t.lower()))).strip()
    alike = ranked([(q, cleaned(t)) for q, t in asked], names, 50, 6)
    want = {}
    for qid, text in asked:
        first = [n for w, n in words.items() if w in text.lower()]
        rest = sorted(((-s, n) for q, n, s in alike if q == qid and n not in first))
        score = {n: s for q, n, s in alike if q == qid} | {n: 101.0 for n in first}
        want |= {(qid, n): score[n] for n in (first + [n for _, n in rest])[:6]}
    assert {(r["qid"], r["name"]): round(r["score"], 6) for r in QUERIES["link_events"](spark, data).collect()} == want


def test_link_items(spark, data, asked):
    read = {r["qid"]: r["value"] for r in QUERIES["parse_item_code"](spark, data).collect()}
    status = {r["qid"]: r["value"] for r in QUERIES["parse_status"](spark, data).collect()}
    want = {(q, read[q], status[q], 100.0) for q, _ in asked if read[q]}
    want |= {(q, n, status[q], s) for q, n, s in ranked([(q, t) for q, t in asked if not read[q]], DISPLAY_NAMES, 30, 3)}
    assert {(r["qid"], r["code"], r["status"], round(r["score"], 6)) for r in QUERIES["link_items"](spark, data).collect()} == want


def test_pages(spark, data):
    html = """<html><head><title>Colla  X</title><style>p {}</style></head><body><h1>Colla X</h1>
    <p>Too short.</p><p>Aquest article or a longer text that begins like one.</p><p>A paragraph of <b>more</b> than thirty characters &amp; so on.</p>
    <h2>Historia</h2><ul><li>First</li><li>First</li><li></li></ul><table><tr><th>Seu</th><td>Valls</td></tr>
    <tr><td>1</td><td>02/10/2022</td><td>Tarragona</td><td>4d9f</td><td>1200</td></tr><tr><td>2</td><td>a</td><td>b</td><td>none</td></tr></table>
    <script>document.write("<p>A paragraph that is not one of the page at all.</p>")</script>
    <h2>Referències</h2><p>What comes after the references is not part of the text.</p></body></html>"""
    want = [
        ("title", None, "Colla X"), ("section", None, "Colla X"), ("paragraph", None, "A paragraph of more than thirty characters & so on."), ("section", None, "## Historia"), ("bullet", None, "First"),
        ("fact", "Seu", "Valls"), ("result", "1", "02/10/2022 | Tarragona | 4d9f | 1200"), ("result", "2", "a | b | 0"),
    ]
    got = pages.extract(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("page_id", "pos").collect()
    assert [(r["kind"], r["key"], r["value"]) for r in got] == want
    # on the table: titles and items by patterns over the whole pages
    pages_ = roles.table(spark, data, "pages").select("page_id", "html").collect()
    found = QUERIES["page_extract"](spark, data).collect()
    plain = lambda x: " ".join(re.sub("<[^>]+>", "", x).replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&#39;", "'").replace("&nbsp;", " ").split())
    want = {(r["page_id"], t) for r in pages_ for t in [plain(x) for x in re.findall(r"(?is)<title[^>]*>(.*?)</title>", r["html"] or "")] if t}
    assert {(r["page_id"], r["value"]) for r in found if r["kind"] == "title"} == want
    assert len({(r["page_id"], r["kind"], r["key"], r["value"]) for r in found}) == len(found)


def words_of(question):
    return [w for w in re.findall(r"\w+", question.lower()) if w not in retrieval.STOP_WORDS and len(w) > 2]


def test_rerank_many_questions(spark):
    """Each question by its own words, lists that are null or empty, and the context of each."""
    schema = "query_id int, question string, asked_groups array<string>, asked_years array<int>, asked_places array<string>, id int, score double, title string, category string, groups array<string>, years array<int>, year_ranges array<string>, keywords array<string>, places array<string>"
    doc = lambda i, category, score: (i, score, f"D{i}", category, ["Xiquets"], [1980, 1981], ["1980-1989"], ["folre", "Història"], ["Valls"])
    asked = [(1, "La història dels Xiquets", ["xiquets de valls"], [1980, 1995], ["VALLS"]), (2, None, None, None, None), (3, "Com es fa el folre?", [], [], [])]
    found = spark.createDataFrame([(*a, *d) for a in asked for d in (doc(7, "history", 0.1), doc(8, "colles", 0.1), doc(9, "colles", 0.5))] + [(4, "nulls", [], [], [], 7, 0.0, "D7", None, None, None, None, None, None)], schema)
    got = {(r["query_id"], r["id"]): (r["is_match"], r["score"]) for r in retrieval.rerank_each(found).collect()}
    assert got == {(1, 7): (True, 1.0), (1, 8): (True, pytest.approx(0.1 + 0.35 + 0.2 + 0.1 + 0.1 + 0.15)), (1, 9): (True, 1.0), (2, 7): (False, 0.1), (2, 9): (False, pytest.approx(0.3)), (3, 7): (False, pytest.approx(0.2)), (3, 9): (False, pytest.approx(0.4))}
    texts = spark.createDataFrame([(7, "seven"), (8, "eight"), (9, None)], "doc_id int, text string")
    contexts = {r["query_id"]: (r["context"], r["documents"]) for r in retrieval.context_each(retrieval.rerank_each(found), texts).collect()}
    assert contexts == {1: ("[Document 1: D7]\nseven\n\n[Document 2: D8]\neight", 2), 2: ("[Document 1: D9]\n\n\n[Document 2: D7]\nseven", 2), 3: ("[Document 1: D9]\n\n\n[Document 2: D7]\nseven", 2)}
    words = ["Quina és la tècnica, i l'estructura?", "3d9f de 2004 als ANYS_80"]
    rows = spark.createDataFrame([(w,) for w in words], "q string").select(retrieval.question_words(F.col("q")).alias("w"), retrieval.about(F.col("q")).alias("about")).collect()
    assert [r["w"] for r in rows] == [words_of(w) for w in words] and [r["about"] for r in rows] == ["technique", None]


def test_rerank_fuzzy(spark, data):
    from tally.registry.retrieval import GROUPS, PLACES, QUESTION, YEARS

    rows = registered._found(spark, data).collect()
    want = {}
    for r in rows:
        groups = [g.lower() for g in r["groups"]]
        named = sum(any(g in x or x in g for x in groups) for g in GROUPS)
        years = len(set(r["years"]) & set(YEARS))
        in_range = any(str(y) in x for x in r["year_ranges"] for y in YEARS)
        alike = lambda w, k: w in k or k in w or difflib.SequenceMatcher(None, w, k).ratio() > 0.7
        matched = sum(any(alike(w, k.lower()) for k in r["keywords"]) for w in words_of(QUESTION))
        score = r["score"] + 0.35 * named + 0.2 * min(years, 3) + 0.1 * in_range
        score += 0.15 + (min(matched, 4) - 1) * 0.15 if matched > 1 else 0.1 * matched
        score += 0.15 * (r["category"] == "history") + 0.15 * bool({p.lower() for p in r["places"]} & set(PLACES))
        if score >= 0.005:
            want[r["id"]] = round(min(1.0, score), 6)
    got = {r["id"]: round(r["score"], 6) for r in QUERIES["rerank_fuzzy"](spark, data).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)


def test_weighted_samples(spark):
    """The first of each sample falls on a choice as often as it weighs; reruns agree."""
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    choices = spark.createDataFrame(list(weights.items()), "choice string, weight double")
    keyed = spark.range(4000).crossJoin(choices).withColumn("order", quiz.weighted_order(F.col("weight"), F.col("id"), F.col("choice")))
    first = keyed.groupBy("id").agg(F.min_by("choice", "order").alias("first")).groupBy("first").count()
    assert {r["first"]: r["count"] / 4000 for r in first.collect()} == pytest.approx(weights, abs=0.03)
    assert keyed.filter(F.col("order") < 0).count() == 0


def test_quiz_sample(spark, data):
    perf = roles.attempts_at_events(spark, data).join(roles.groups(spark, data), "group_id").select("group_name", F.year("event_date").alias("event_year")).distinct()
    years = {}
    for r in perf.collect():
        if r["event_year"] not in quiz.EXCLUDED_YEARS:
            years.setdefault(r["group_name"], set()).add(r["event_year"])
    got = {}
    rows = QUERIES["quiz_sample"](spark, data).collect()
    for r in rows:
        got.setdefault(r["group_name"], []).append(r["event_year"])
    assert got.keys() == years.keys()
    n = max(map(len, got.values()))
    for g, chosen in got.items():
        assert len(set(chosen)) == len(chosen) == min(n, len(years[g])) and set(chosen) <= years[g]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["quiz_sample"](spark, data).collect()))


def test_chances_and_samplers(spark):
    """Kinds, years and groups come as often as the rules say."""
    every = quiz.chances()
    assert sum(every.values()) == pytest.approx(1) and every["best_event"] == pytest.approx(0.7 / 1.1 * 0.3) and every["counts"] == pytest.approx(0.2 / 1.1 / 2)
    assert set(quiz.chances(groups=("a",))) == {"best_event", "best_item", "performance", "multi", "counts"}
    assert set(quiz.chances(years=(2000,))) == {"best_event", "best_item", "first_group", "multi", "counts", "ordering"}
    perf = spark.range(3000).select(F.col("id").cast("string").alias("group_name"), F.explode(F.sequence(F.lit(1950), F.lit(2025))).alias("event_year"))
    first = quiz.sample_years(perf, n=1).groupBy("event_year").count().collect()
    share = {r["event_year"]: r["count"] / 3000 for r in first}
    assert not set(share) & {2020, 2021} and min(share) >= 1960
    for a, b, chance in quiz.ERAS:
        assert sum(v for y, v in share.items() if a <= y <= b) == pytest.approx(chance, abs=0.03)
    assert {r["event_year"] for r in quiz.sample_years(perf, n=9, chosen=(2020, 1955)).select("event_year").distinct().collect()} == {2020, 1955}
    active = spark.createDataFrame([("a", 1000, 3999, 3), ("b", 1000, 3999, 1), ("c", 1000, 2499, 4), ("d", 1000, 3999, 0)], "group_name string, min_year int, max_year int, boost int")
    late = quiz.sample_groups(active, n=1).filter("year >= 2500").groupBy("group_name").count().collect()
    assert {r["group_name"]: r["count"] / 1500 for r in late} == pytest.approx({"a": 0.75, "b": 0.25}, abs=0.05)
    assert {r["group_name"] for r in quiz.sample_groups(active, n=1, chosen=("d", "c")).collect()} == {"c", "d"}


def test_quiz_groups(spark, data):
    active = {(y, g) for g, a, b, boost in ((r["group_name"], r["min_year"], r["max_year"], r["boost"]) for r in quiz_registry._active(spark, data).collect()) if boost for y in range(a, b + 1)}
    rows = QUERIES["quiz_groups"](spark, data).collect()
    assert {(r["year"], r["group_name"]) for r in rows} <= active
    per_year = {y: sum(a == y for a, _ in active) for y, _ in active}
    assert {y: sum(r["year"] == y for r in rows) for y in per_year} == {y: min(5, n) for y, n in per_year.items()}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["quiz_groups"](spark, data).collect()))


def test_first_group_of_a_year(spark):
    rows = [(2010, "3d8", g, f"2010-01-0{i + 1}", i, "Carregat") for i, g in enumerate("edcba")] + [(2010, "4d8", "b", "2010-05-01", 9, "Descarregat"), (2010, "4d8", "a", "2010-04-01", 8, "Intent")]
    rows += [(2010, "3d8", "e", "2010-02-01", 7, "Descarregat"), (2011, "4d8", "a", "2011-04-01", 10, "Descarregat"), (2012, "4d8", "a", "2012-04-01", 11, "Carregat"), (2012, None, "a", "2012-04-01", 11, "Descarregat"), (2001, "4d8", "a", "2001-04-01", 1, "Descarregat")]
    perf = spark.createDataFrame(rows, "event_year int, item_code string, group_name string, event_date string, event_id int, status string")
    active = spark.createDataFrame([(g, 2000, 2010, b) for g, b in (("a", 5), ("b", 4), ("x", 0), ("y", 9), ("z", None))], "group_name string, min_year int, max_year int, boost int")
    asked = lambda **how: {(r["event_year"], r["item_code"]): (r["correct"], r["wrong"].split(", ")) for r in quiz.first_group(perf, active, **how).collect()}
    got = asked(order=(F.desc_nulls_last("boost"),))
    # 2011: nobody is active; 2012: not completed; 2001: before the first year
    assert got == {(2010, "3d8"): ("e", ["d", "c", "b"]), (2010, "4d8"): ("a", ["b", "y", "x"]), (2011, "4d8"): ("a", list(quiz.FILL_GROUPS))}
    assert asked() == asked() and set(asked(first_year=0)) == {*got, (2001, "4d8")}
    many = perf.filter("event_year = 2011").select(F.explode(F.sequence(F.lit(1), F.lit(400)).cast("array<string>")).alias("item_code"), F.lit(2010).alias("event_year"), "group_name", "event_date", "event_id", "status")
    filled = [r["wrong"].split(", ") for r in quiz.first_group(many, active).collect()]
    assert len(filled) == 400 and all(len(set(w)) == 3 and set(w) <= set("bxyz") for w in filled) and len(set(map(tuple, filled))) > 3
    assert sum("y" in w for w in filled) > sum("x" in w for w in filled)  # drawn by boost
    assert quiz.first_group(perf.limit(0), active).count() == 0 and quiz.first_group(perf, active.limit(0)).count() == 3


def test_drawn_items_and_days(spark, data):
    """Items by their points, days by the rules of years and of the main day."""
    scores = spark.createDataFrame([("a", 600), ("b", 300), ("c", 100), ("d", None), ("e", 0)], "code string, full int")
    asked = spark.range(1, 3001).select(F.col("id").alias("event_year"), F.explode(F.lit(list("abcde"))).alias("item_code"))
    first = quiz.sample_items(asked, scores, n=1).groupBy("item_code").count().collect()
    assert {r["item_code"]: r["count"] / 3000 for r in first} == pytest.approx({"a": 0.6, "b": 0.3, "c": 0.1}, abs=0.04)
    assert quiz.sample_items(asked.filter("event_year < 10 AND item_code IN ('d', 'e')"), scores, n=5).count() == 18  # no points: alike
    rows = [(1970, ""), (1990, ""), (2000, ""), (2018, "x"), (2018, quiz.MAIN_DAY)]
    weights = {(r["year"], r["day"]): r["w"] for r in quiz._day_weights(spark.createDataFrame(rows, "year int, day string")).collect()}
    assert weights == pytest.approx({(1970, ""): 0.05, (1990, ""): 0.1, (2000, ""): 0.35, (2018, "x"): 0.5 / 6, (2018, quiz.MAIN_DAY): 2.5 / 6})
    drawn = lambda **how: [tuple(r) for r in quiz.sample_days(spark.createDataFrame(rows, "year int, day string"), **how).collect()]
    assert sorted(drawn()) == sorted(rows) and drawn(n=2) == drawn(n=2) and {y for y, _ in drawn(years=(1970, 2018))} == {1970, 2018} and len(drawn(years=(1,))) == 5
    often = [drawn(n=1, seed=i)[0][0] for i in range(40)]
    assert sum(y >= 2000 for y in often) > 25
    days = [tuple(r) for r in QUERIES["quiz_days"](spark, data).collect()]
    assert len(days) == len(set(days)) == 10 and set(days) <= {tuple(r) for r in quiz_registry._days(spark, data).collect()}
    every = {(r["event_year"], r["item_code"]): r["correct"] for r in quiz_registry._first_group(spark, data).collect()}
    chosen = QUERIES["quiz_items"](spark, data).collect()
    assert all(every[r["event_year"], r["item_code"]] == r["correct"] for r in chosen)
    years = {y: sum(a == y for a, _ in every) for y, _ in every}
    assert {y: sorted(r["rn"] for r in chosen if r["event_year"] == y) for y in years} == {y: list(range(1, min(5, n) + 1)) for y, n in years.items()}


def test_performance_in_other_years(spark):
    """Two events of a year leave a place for the right one in another year; a year at the edge has years on one side only."""
    rows = [(1, 1, "g", "Fair", "2020-01-01", 2020, "Valls", "3d8", "Descarregat", 9), (2, 1, "g", None, "2020-02-01", 2020, None, "3d7", "Carregat", 5), (3, 2, "h", "Fair of Reus", "2025-01-01", 2025, "Reus", "4d8", "Carregat", 4)]
    perf = spark.createDataFrame([(*r, str(i)) for i, r in enumerate(rows)], "event_id int, group_id int, group_name string, event_name string, event_date string, event_year int, city string, item_name string, status string, points long, attempt_id string")
    got = {r["group_name"]: (r["correct"], r["wrong"].split("; ")) for r in quiz.performance_options(perf).collect()}
    assert got == {"g": ("g, Fair, Valls (2020)", ["g, Diada castellera (2020)", "g, Fair, Valls (2019)", "g, Fair, Valls (2021)"]), "h": ("h, Fair of Reus (2025)", ["h, Fair of Reus (2024)", "h, Fair of Reus (2023)", "h, Fair of Reus (2022)"])}
    drawn = {r["group_name"]: r["wrong"].split("; ") for r in quiz.performance_options(perf, seed=3).collect()}
    assert len(set(drawn["h"])) == 3 and all(2020 <= int(w[-5:-1]) <= 2024 for w in drawn["h"])


def test_small_items_and_layouts(spark):
    from tally.operators import reports

    rows = [(1, 1, f"3d{i}") for i in range(6)] + [(1, 1, "Pd5"), (1, 1, "P de 4"), (2, 1, "Pd5"), (2, 1, "pd4ps"), (2, 1, "4d8"), (3, 1, "Pde4cam")]
    perf = spark.createDataFrame(rows, "event_id int, group_id int, item_name string")
    kept = lambda small: sorted((r["event_id"], r["item_name"]) for r in reports.without_small(perf, small).collect() if not r["item_name"].startswith("3d"))
    assert kept(reports.SMALL_LISTED) == [(2, "4d8"), (2, "Pd5")]
    assert kept(reports.SMALL_CHOSEN) == [(1, "Pd5"), (2, "4d8"), (2, "Pd5")]
    assert kept(reports.SMALL_COUNTED) == [(1, "Pd5"), (2, "4d8"), (2, "Pd5"), (2, "pd4ps")]
    cities = ", ".join(f"c{i}" for i in range(12))
    shown = reports.laid_out(spark.createDataFrame([("3d7", "Descarregat", 5, cities, None)], "item_name string, status string, occurrences long, cities string, group_names string"), "item_history")
    assert shown.columns == ["Castell", "Estat", "Vegades", "Colles", "Ciutats"]
    assert tuple(shown.first()) == ("3d7", "Descarregat", "5", "-", ", ".join(f"c{i}" for i in range(10)) + "...")


def test_drawn_distractors(spark):
    scores = spark.createDataFrame([(f"x{i:02}", 1000 + 30 * i) for i in range(20)], "code string, full int")
    drawn = {r["code"]: r["wrong"].split(",") for r in quiz.distractors(scores, seed=4).collect()}
    assert len(drawn) == 20 and all(len(set(w)) == 3 for w in drawn.values())
    nearest = {f"x{i:02}": [f"x{j:02}" for _, j in sorted((abs(i - j), j) for j in range(20) if j != i)[:6]] for i in range(20)}
    assert all(set(w) <= set(nearest[c]) for c, w in drawn.items()) and any(set(w) != set(nearest[c][:3]) for c, w in drawn.items())


def test_quiz_dataset(spark, data):
    rows = QUERIES["quiz_dataset"](spark, data).collect()
    assert len({r["question"] for r in rows}) == len(rows) > 0
    assert {r["kind"] for r in rows} == set(quiz.chances())
    best = {(r["group_name"], r["year"]): r["correct"] for r in QUERIES["quiz_best_event"](spark, data).collect()} if "quiz_best_event" in QUERIES else None
    counts = {f"How often was {r['item_name']} {r['status']} by {r['group_name']} in {r['event_year']}?": str(r["answer"]) for r in QUERIES["quiz_counts"](spark, data).collect()}
    for r in rows:
        if r["kind"] == "counts":
            assert counts[r["question"]] == r["answer"]
        if r["kind"] == "best_event" and best is not None:
            group, year = re.fullmatch(r"Best event of (.*) in (\d+)\?", r["question"]).groups()
            assert best[group, int(year)] == r["answer"]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["quiz_dataset"](spark, data).collect()))
