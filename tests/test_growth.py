"""What findings at larger sizes have led to: results that hang on no order, and steps that grow no faster than their input."""

import datetime

from pyspark.sql import functions as F

from tally.operators import quiz
from tally.streaming import jobs


def _at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def _analyzed(stream):
    return stream._jdf.queryExecution().analyzed().toString()


def test_inserts_of_a_batch_are_the_least_without_python_for_each_key(spark, tmp_path):
    rows = [(i % 5 if i % 5 else None, 99 - i, float(i)) for i in range(100)]
    spark.createDataFrame(rows, "key long, n long, v double").repartition(7).write.parquet(f"{tmp_path}/in.parquet")
    stream = jobs.insert_once(jobs.replay(spark, f"{tmp_path}/in.parquet", "n", files=3), ["key"], "n")
    assert "TransformWithState" not in _analyzed(stream)
    want = {}
    for key, n, v in rows:
        want[key] = min(want.get(key, (n, v)), (n, v))
    got = [(r["key"], (r["n"], r["v"])) for r in jobs.run(stream, "insert", on_disk=True).collect()]
    assert len(got) == 5 and dict(got) == want


def test_a_task_that_leaves_one_row_of_a_key_takes_any_number_of_batches():
    import pyarrow as pa

    parts = [pa.RecordBatch.from_pydict({"k": [i % 50_000 for i in range(a, a + 10_000)], "n": list(range(200_000 - a, 190_000 - a, -1))}) for a in range(0, 200_000, 10_000)]
    got = pa.Table.from_batches(list(jobs.least_of_keys(iter(parts), ["k"], "n"))).to_pydict()
    assert dict(zip(got["k"], got["n"])) == {k: 200_000 - 150_000 - k for k in range(50_000)} and len(got["k"]) == 50_000


def test_progress_of_messages_over_hours(spark, tmp_path):
    rows = [("a", "complete", _at(58)), ("a", "pending", _at(61)), ("b", "pending", _at(62)), ("b", "what", _at(63)), (None, "error", _at(64)), ("c", "entities_ready", _at(400)), ("c", "pending", _at(401)), ("b", "error", _at(402))]
    spark.createDataFrame(rows, "message_id string, status string, ts timestamp").write.parquet(f"{tmp_path}/in.parquet")
    stream = jobs.progress(jobs.replay(spark, f"{tmp_path}/in.parquet", "ts", files=8))
    assert "TransformWithState" not in _analyzed(stream)
    got = jobs.whole(jobs.run_latest(stream, "status", ["message_id", "slot"], "updates")).collect()
    assert sorted(map(tuple, got)) == [("a", "complete", 2), ("b", "error", 2), ("c", "entities_ready", 2)]


def test_halves_of_a_game_are_halves_in_any_order(spark):
    """65 of 200 points are 32.5 per cent, which goes up; ten sums of a tenth and the like do not move it."""
    scores = [0.633333, 0.366667, 0.1, 0.2, 0.7] * 13 + [0.0] * 69 + [39.0]
    for part in (scores, scores[::-1], sorted(scores)):
        df = spark.createDataFrame([(x,) for x in part], "s double").select(quiz.exactly(F.col("s")).alias("s"))
        percent, band = quiz.game(F.sum("s"), F.lit(200))
        assert tuple(df.agg(percent.alias("p"), band.alias("b")).first()) == (33, "again")


def test_totals_of_answers_are_exact(spark, tmp_path):
    """Slider scores of 0.633333 and 0.366667 by turns add up to whole numbers, whatever the parts they come in."""
    one = spark.range(0, 3000, 1, 7).select(quiz.exactly(F.when(F.col("id") % 2 == 0, 0.633333).otherwise(0.366667)).alias("s"))
    assert float(one.agg(F.sum("s").alias("s")).first()["s"]) == 1500.0


def test_similar_items_meet_no_more_codes_than_answers_can_need(spark):
    """Many codes of the same points, an answer's own ones in front, under two spellings; a code that is near by both of its points."""
    scores = spark.createDataFrame([(f"c{i:04d}", f"P{i:04d}", None, 1000 + i % 3 * 150, 900 + i % 3 * 150, "t") for i in range(900)] + [("x", "p0000", None, 1000, 900, "t")], "code string, external string, name string, full long, partial long, tier string")
    items = [[("P0000", "Descarregat")], [("P0000", "Carregat"), ("P0003", "Carregat"), ("P0006", "Descarregat")], [("P0002", "Descarregat"), ("P0001", "Carregat")]]
    answers = spark.createDataFrame(list(enumerate(items)), "key int, items array<struct<item_name: string, status: string>>")
    rows = scores.collect()
    value = {(a.lower(), s): v for r in rows for a in (r["code"], r["external"]) for s, v in (("Descarregat", r["full"]), ("Carregat", r["partial"]))}
    want = {}
    for k, its in enumerate(items):
        found = [float(r["full"] if s == "Descarregat" else r["partial"]) for i, s in its for r in rows if i.lower() in (r["code"].lower(), r["external"].lower())]
        average = sum(found) / len(found)
        width = max(quiz.BAND, average * quiz.BAND_PERCENT // 100)
        near = {r["external"]: ("Descarregat" if abs(r["full"] - average) <= width else "Carregat") for r in rows if min(abs(r["full"] - average), abs(r["partial"] - average)) <= width and r["external"].lower() not in {i.lower() for i, _ in its}}
        want[k] = (average, ", ".join(f"{c} ({near[c]})" for c in sorted(near)[:2]))
    got = quiz.similar_items(answers, scores, order=F.col("code"))
    assert {r["key"]: (r["average"], r["similar"]) for r in got.collect()} == want
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "denserank" in text.lower() or "dense_rank" in text


def _sorted_parts(df):
    """The numbers of partitions that the joins of a plan take their rows in."""
    import re

    text = df._jdf.queryExecution().executedPlan().toString()
    return {int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", text)}


def test_parts_of_the_fact_grow_with_the_tables(spark, data, monkeypatch):
    """Tasks of the joins hold PART_ROWS rows of the fact each, however many there are, and the results are the same."""
    from compare import rows
    from tally.operators import scoring
    from tally.plans import roles

    import __spark_entry__ as entry

    names = ("items_with_points", "item_statistics", "ingest_flatten", "load_batches", "first_groups", "agg_counts")
    few = {n: rows(entry.queries()[n](spark, data)) for n in names}
    assert not _sorted_parts(scoring.performances(spark, data))
    monkeypatch.setattr(roles, "PART_ROWS", 500)
    assert _sorted_parts(scoring.performances(spark, data)) == {12}
    assert {n: rows(entry.queries()[n](spark, data)) for n in names} == few


def test_a_task_of_the_blocked_search_gives_k_rows_a_query_for_many_blocks(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from tally.operators import retrieval

    monkeypatch.setattr(retrieval, "HELD_ROWS", 4000)
    k, r = 100, np.random.default_rng(1)
    n = retrieval.query_rows(k)
    units = lambda m: (lambda x: x / np.sqrt((x * x).sum(axis=1))[:, None])(r.normal(size=(m, 8)))
    q, v = units(n), units(3000)
    rows = [{"ids": np.arange(a, a + 300).tobytes(), "units": v[a : a + 300].tobytes(), "q_ids": np.arange(n).tobytes(), "q_units": q.tobytes()} for a in range(0, 3000, 300)]
    got = pa.Table.from_batches(list(retrieval.best_of_blocks(k)(iter([pa.RecordBatch.from_pylist(rows)]))))
    want = {(i, int(j)) for i, s in enumerate(q @ v.T) for j in np.argsort(-s)[:k]}
    assert got.num_rows == n * k and set(zip(got["query_id"].to_pylist(), got["id"].to_pylist())) == want


def test_items_of_group_chunks_are_cut_before_they_are_gathered(spark, data):
    from tally.registry import retrieval

    plan = retrieval.group_chunks(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "WindowGroupLimit" in plan


def _perf(spark):
    """A small fact: two groups with two events a year, items of equal points, one without a date and one of an event with the least id."""
    rows = []
    for g in (1, 2):
        for e in range(6):
            for i in range(5):
                status = ("Descarregat", "Carregat", "Intent")[(e + i + g) % 3]
                rows.append((f"a{g}{e}{i}", e - 3, g, f"g{g}", f"Fair {e}", None if e == 0 else datetime.date(2000 + e // 2, 1 + e, 1), 2000 + e // 2, "square", "city", f"P{(i * g) % 7}", f"{(i * g) % 7}", "pilar" if i % 2 else "castell", status, 100 * ((i + e) % 3)))
    return spark.createDataFrame(rows, "attempt_id string, event_id long, group_id long, group_name string, event_name string, event_date date, event_year int, place string, city string, item_name string, item_code string, item_class string, status string, points long")


def test_items_are_listed_of_the_asked_events_only(spark):
    """Before, the items of all events were grouped and listed, and those of few then joined."""
    for made in (quiz.performance(_perf(spark)), quiz.performance_options(_perf(spark)), quiz.multi(_perf(spark), spark.createDataFrame([("1", "P1", None, 100, 50, "t")], "code string, external string, name string, full long, partial long, tier string"))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        lines = plan.splitlines()
        semi = next(n for n, line in enumerate(lines) if "LeftSemi" in line)
        assert any("Aggregate" in line and "item_name" in line and line.index("Aggregate") < lines[semi].index("Join") for line in lines[:semi])


def test_first_groups_of_years_are_found_without_a_sort_of_structs(spark):
    perf = _perf(spark)
    active = perf.groupBy("group_name").agg(F.min("event_year").alias("min_year"), F.max("event_year").alias("max_year")).withColumn("boost", F.lit(1))
    made = quiz.first_group(perf, active, first_year=0, fill=())
    firsts = {}
    for r in perf.collect():
        found = firsts.setdefault((r["event_year"], r["item_code"]), {}), r["group_name"]
        at = (r["event_date"] is not None, r["event_date"] or datetime.date.min, r["event_id"])
        one = found[0].setdefault(found[1], [at, False])
        one[0], one[1] = min(one[0], at), one[1] or r["status"] == "Descarregat"
    want = {k: min(v, key=lambda g: (v[g][0], g)) for k, v in firsts.items() if any(c for _, c in v.values())}
    assert {(r["event_year"], r["item_code"]): r["correct"] for r in made.collect()} == want
    plan = made._jdf.queryExecution().sparkPlan().toString()
    keyed = [line for line in plan.splitlines() if "Aggregate(key" in line and all(k in line.split("functions")[0] for k in ("event_year", "item_code", "group_name"))]
    assert keyed and all("HashAggregate" in line for line in keyed)


def test_best_items_go_by_points_and_then_by_name(spark):
    perf = _perf(spark)
    best = {}
    for r in perf.collect():
        if r["points"] > 0:
            key = r["group_name"], r["event_year"]
            best[key] = max(best.get(key, (0, "")), (r["points"], r["item_name"]))
    assert {(r["group_name"], r["event_year"]): r["item"] for r in quiz._best_item(perf).collect()} == {k: v[1] for k, v in best.items()}


def test_points_of_events_from_the_best_of_classes(spark):
    from tally.operators import scoring

    perf, keys = _perf(spark), ["event_id", "group_id"]
    few = scoring.best_of_classes(perf, quiz.TOP_ITEMS)
    of = lambda df: {tuple(r[k] for k in keys): r["total_points"] for r in df.collect()}
    assert of(scoring.event_points(few)) == of(scoring.event_totals(perf))
    top = {}
    for r in perf.collect():
        top.setdefault((r["event_id"], r["group_id"]), []).append(r["points"])
    got = {tuple(r[k] for k in keys): r["top_points"] for r in quiz._events_by_best(few).collect()}
    assert got == {k: sum(sorted(v)[-quiz.TOP_ITEMS :]) for k, v in top.items()}


def test_questions_are_once_without_a_sort_of_all(spark):
    rows = [("counts", f"q{i}", str(i), 1.0) for i in range(50)] + [("best", "q3", "z", 2.0), ("best", "q3", "y", 3.0), ("counts", "q4", "4", 1.0)]
    got = quiz._no_question_twice(spark.createDataFrame(rows, "kind string, question string, answer string, w double"))
    want = {q: (k, a, w) for k, q, a, w in rows[:50]} | {"q3": ("best", "y", 3.0)}
    assert {r["question"]: (r["kind"], r["answer"], r["w"]) for r in got.collect()} == want and got.count() == 50


def test_rows_that_cannot_be_among_the_best_go_before_windows(spark):
    """Few rows of many stay for a window, all of equal points that may be among them, and all of keys with too few rows; null keys and points too."""
    from tally.operators import scoring

    rows = [(1, i * 7919 % 3000) for i in range(3000)] + [(2, 5)] * 20 + [(3, None), (3, 1), (None, 4), (None, None)] + [(4, p) for p in (9, 9, 9, 9, 8, 8, None)]
    perf = spark.createDataFrame([(g, p, f"a{i}") for i, (g, p) in enumerate(rows)], "g long, points long, attempt_id string").repartition(5)
    for most in (1, 2, 5):
        left = {}
        for r in scoring.without_hopeless(perf, ("g",), most).collect():
            left.setdefault(r["g"], []).append((r["points"] is not None, r["points"] or 0, r["attempt_id"]))
        every = {}
        for r in perf.collect():
            every.setdefault(r["g"], []).append((r["points"] is not None, r["points"] or 0, r["attempt_id"]))
        best = lambda x: sorted(x, key=lambda r: (not r[0], -r[1], r[2]))[:most]
        assert {g: best(x) for g, x in left.items()} == {g: best(x) for g, x in every.items()}
        assert len(left[1]) < 300 and len(left[2]) == 20
