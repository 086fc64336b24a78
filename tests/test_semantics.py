"""Decisions that a comparison with SQL does not show: edge cases, properties and plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.functions import fuzzy
from tally.operators import chat, ingest, linking, quiz, reports, retrieval, scoring
from tally.plans import roles
from tally.plans.filters import FilterSpec
from tally.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().toString()


def test_alias_join_is_the_or_join(spark, data):
    a, s = roles.attempts(spark, data), roles.scores(spark, data)
    direct = a.join(s, (a.item_name == s.external) | (a.item_name == s.code) | (a.item_name == s.name), "left").select("attempt_id", "code")
    aliased = scoring.alias_join(a, s).select("attempt_id", "item_code")
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, aliased.collect()))


def test_report_plans(spark, data):
    text = plan(reports.best_event(scoring.performances(spark, data)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "WindowGroupLimit" in text


def test_unsupported_filters_are_errors(spark, data):
    perf = scoring.performances(spark, data)
    with pytest.raises(ValueError, match="statuses"):
        reports.best_event(perf, FilterSpec(statuses=("x",)))
    with pytest.raises(ValueError, match="years"):
        reports.first_item(perf, FilterSpec(items=("1",), years=(1999,)))
    with pytest.raises(ValueError):
        reports.year_summary(perf, FilterSpec())


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = ingest.upsert_latest(old.withColumn("batch", F.lit(1)).union(new.withColumn("batch", F.lit(2))), ["k"])
    twice = ingest.upsert_latest(once.union(new.withColumn("batch", F.lit(3))), ["k"])
    assert sorted(r["v"] for r in once.collect()) == sorted(r["v"] for r in twice.collect()) == ["a", "c", "d"]
    assert sorted(map(tuple, ingest.upsert_diff(old, new, ["k"], ["v"]).collect())) == [(1, "keep"), (2, "update"), (3, "insert")]


@pytest.mark.parametrize("n", [0, 1, 199, 200, 201, 349, 350, 351, 1000])
def test_chunks_cover_the_text(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = retrieval.chunks(spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string")).orderBy("chunk_index").collect()
    back = [w for k, r in enumerate(got) for w in r["chunk"].split()[0 if k == 0 else 50 :]]
    assert back == words
    assert all(r["n_words"] <= 200 for r in got)


def test_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(retrieval.normalized(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_scores_of_answers(spark):
    row = spark.range(1).select(
        quiz.slider_score(F.lit(5), F.lit(5), F.lit(0)).alias("same"), quiz.slider_score(F.lit(6), F.lit(5), F.lit(2)).alias("near"), quiz.slider_score(F.lit(9), F.lit(5), F.lit(2)).alias("far"),
        quiz.multi_score(F.array(F.lit("a"), F.lit("x")), F.array(F.lit("a"), F.lit("b"))).alias("multi"), quiz.ordering_score(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3))).alias("order"),
    ).first()
    assert row["same"] == 1 and row["near"] == pytest.approx(0.5) and row["far"] == 0 and row["multi"] == pytest.approx(0.25) and row["order"] == 0.5


def test_streams_equal_batches_in_any_order(spark, tmp_path):
    rows = [(f"m{i % 5}", s, i) for i, s in enumerate(["pending", "complete", "entities_ready", "pending", "error", "complete", "pending", "entities_ready"])]
    for k, part in enumerate((rows[4:], rows[:4])):
        spark.createDataFrame(part, "message_id string, status string, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in.parquet")
    stream = jobs.source(spark, f"{tmp_path}/in.parquet", files_per_batch=1)
    got = {r["message_id"]: (r["status"], r["updates"]) for r in jobs.run_latest(jobs.advance(stream), "status", ["message_id"], "updates").collect()}
    want = {}
    for m, s, _ in rows:
        want.setdefault(m, []).append(s)
    assert got == {m: (max(s, key=chat.STATES.index), len(s)) for m, s in want.items()}


def test_odd_updates_do_not_end_the_stream(spark, tmp_path):
    """Batches of unknown or null statuses alone, and no batch at all; a message's state is forgotten in time."""
    schema = "message_id string, status string, ts timestamp"
    at = lambda minute: __import__("datetime").datetime(2024, 1, 1, minute // 60, minute % 60)
    files = [[("a", "what", at(0)), ("b", None, at(0)), (None, "complete", at(0))], [("a", "complete", at(1))], [("c", "pending", at(300))], [("c", "error", at(301)), ("d", "pending", None)]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in.parquet")
    stream = jobs.source(spark, f"{tmp_path}/in.parquet", files_per_batch=1)
    got = {r["message_id"]: (r["status"], r["updates"]) for r in jobs.run_latest(jobs.advance(stream), "status", ["message_id"], "updates").collect()}
    assert got == {"a": ("complete", 1), "c": ("error", 2)}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none.parquet")
    assert jobs.run_latest(jobs.advance(jobs.source(spark, f"{tmp_path}/none.parquet")), "status", ["message_id"], "updates").count() == 0


def test_inserts_of_a_stream_come_once(spark, tmp_path):
    for k in range(4):
        rows = [(i % 7, i + 100 * k, f"v{k}") for i in range(10)]
        spark.createDataFrame(rows, "key long, n long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in.parquet")
    one_by_one = jobs.replay(spark, f"{tmp_path}/in.parquet", "n", files=10)
    got = jobs.run(jobs.insert_once(one_by_one, ["key"], "n"), "insert", on_disk=True).collect()
    assert sorted((r["key"], r["n"], r["v"]) for r in got) == [(i, i, "v0") for i in range(7)]


def _batches(stream, tmp_path):
    """How many batches a stream takes."""
    seen = []
    query = stream.writeStream.foreachBatch(lambda batch, n: seen.append(batch.count())).option("checkpointLocation", f"{tmp_path}/seen").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(n > 0 for n in seen)


def test_shuffled_files_are_replayed_in_order(spark, tmp_path):
    """70 files in no order of time, in ten batches and more, give what one batch gives; what is late otherwise has a side of its own."""
    rows = spark.range(1400).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id * 300) AS ts", "id % 3 AS user_id", "'view' AS event_type")
    rows.repartition(70, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    stream = jobs.replay(spark, f"{tmp_path}/events.parquet", "ts", files=12)
    assert _batches(stream, tmp_path) >= 10
    same = lambda df: sorted(map(tuple, df.collect()))
    for name, job in (("windows", lambda s: jobs.windows(s, "10 minutes")), ("sessions", lambda s: jobs.sessions(s, "10 minutes")), ("dedupe", lambda s: jobs.dedupe(s, ["user_id", "event_id"]))):
        whole = same(jobs.run(job(jobs.source(spark, f"{tmp_path}/events.parquet")), name))
        assert same(jobs.run(job(stream), name)) == whole and whole
    on_time, late = jobs.run_by_lateness(stream, "lateness")
    assert late.count() == 0 and on_time.count() == 1400
    on_time, late = jobs.run_by_lateness(jobs.source(spark, f"{tmp_path}/events.parquet", files_per_batch=7), "lateness")
    assert late.count() > 0 and on_time.count() + late.count() == 1400


def test_a_timer_forgets_a_message(spark, tmp_path):
    at = lambda minute: __import__("datetime").datetime(2024, 1, 1, minute // 60, minute % 60)
    rows = [("a", "pending", at(0)), ("a", "complete", at(30)), ("b", "pending", at(31)), ("c", "pending", at(60 * 5)), ("a", "pending", at(60 * 10)), ("d", "pending", at(60 * 15))]
    spark.createDataFrame(rows, "message_id string, status string, ts timestamp").write.parquet(f"{tmp_path}/in.parquet")
    seen = []
    stream = jobs.advance(jobs.replay(spark, f"{tmp_path}/in.parquet", "ts", files=6), tell=True)
    with jobs.rocksdb(spark):
        query = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [x for x in seen if x[0] == "a"] == [("a", "pending", 1), ("a", "complete", 2), ("a", "expired", 2), ("a", "pending", 1), ("a", "expired", 1)]
    assert ("b", "expired", 1) in seen and ("c", "expired", 1) in seen and ("d", "expired", 1) not in seen
    kept = [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress if p.stateOperators]
    assert max(kept) <= 4 * 3  # a message, its timer and the timer's index, of those of the last hours only


def test_reports_read_each_table_once_and_push_years(spark, data):
    df = reports.year_summary(scoring.performances(spark, data), FilterSpec(years=(1997,)))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") <= 8
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01" in text
    assert "Expand" not in plan(reports.item_statistics(scoring.performances(spark, data)))


def test_blocks_of_queries_find_what_single_ones_do(spark):
    rng = __import__("random").Random(3)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)], "id long, vec array<double>").repartition(5)
    queries = vectors.filter("id % 7 = 0").selectExpr("id AS query_id", "vec AS qvec")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(retrieval.top_k_blocks(vectors, queries, 9)) == rows(retrieval.top_k(vectors, queries, 9))
    # what a task cuts and gives away on its way loses nothing
    whole = sorted((-float(x), i, q) for q in range(3) for i, x in enumerate(np.random.default_rng(q).normal(size=40).round(1)))
    parts = [tuple(np.array(c) for c in ([q for _, _, q in p], [i for _, i, _ in p], [-x for x, _, _ in p])) for p in (whole[::2], whole[1::2])]
    got = sorted(zip(*(c.tolist() for c in retrieval._cut([retrieval._cut(parts[:1], 5), parts[1]], 5))))
    assert got == sorted((q, i, -x) for n in range(3) for x, i, q in [w for w in whole if w[2] == n][:5])
    assert retrieval.top_k_blocks(vectors.limit(0), queries, 9).count() == 0
    assert retrieval.top_k_blocks(vectors.limit(4), queries, 9).count() == 4 * queries.count()


def test_streams_of_many_files_lose_nothing(spark, tmp_path):
    """More than 64 files, the latest rows in those that are read first."""
    rows = spark.range(700).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + (699 - id) * 600) AS ts", "id % 3 AS user_id", "'view' AS event_type")
    rows.repartitionByRange(70, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    assert len(list((tmp_path / "events.parquet").glob("part-*.parquet"))) > 64
    total = lambda df: df.agg({"n": "sum"}).first()[0]
    open_ = 2  # windows that the watermark of the end has not passed
    assert total(jobs.run(jobs.windows(jobs.source(spark, f"{tmp_path}/events.parquet"), "5 minutes"), "windows")) >= 700 - open_
    assert total(jobs.run(jobs.sessions(jobs.source(spark, f"{tmp_path}/events.parquet"), "5 minutes"), "sessions")) >= 700 - open_
    assert jobs.run(jobs.dedupe(jobs.source(spark, f"{tmp_path}/events.parquet"), ["event_id"]), "dedupe").count() == 700


def test_events_are_linked_as_by_brute_force(spark):
    names = ["Fair AFRICA", "Fair AMERICA", "Fair ASIA", "Fair EUROPE", "Fair MIDDLE EAST"]
    texts = ["castells de 8 i gamma extra dels anys 80 a la Fira Asia", "Quina va ser la millor diada de NATION_3 l'any 1998?", "res"]
    questions = spark.createDataFrame(list(enumerate(texts)), "qid int, text string")
    found = linking.link_events(questions, spark.createDataFrame([(n,) for n in names], "name string"), words=(("asia", ("Fair ASIA",)), ("fira", ("Fair ASIA", "Fira de la Fira")))).collect()
    cleaned = ["de i gamma extra a la fira asia", "va ser la de nation_ l'?", "res"]
    assert [r["t"] for r in questions.select(linking.without_stop_words(F.col("text")).alias("t")).collect()] == [*cleaned[:1], "va ser la de nation_ l' ?", "res"]
    got = {(r["qid"], r["name"]) for r in found}
    want = {(q, n) for q, t in enumerate([cleaned[0], "va ser la de nation_ l' ?", "res"]) for n in names if fuzzy.partial_ratio_of(n.lower(), t) >= 50}
    assert got == want | {(0, "Fair ASIA"), (0, "Fira de la Fira")}
    assert [(r["rank"], r["name"]) for r in found if r["qid"] == 0 and r["rank"] <= 2] == [(1, "Fair ASIA"), (2, "Fira de la Fira")]
    real = linking.link_events(spark.createDataFrame([(1, "la diada de la Mercè del 2019")], "qid int, text string"), spark.createDataFrame([], "name string"))
    assert [r["name"] for r in real.orderBy("rank").collect()] == ["Diada de la Mercè a Barcelona", "Diada de la Mercè (colles convidades) a Barcelona"]


def test_entities_are_repaired(spark):
    names = spark.createDataFrame([("NATION_3",), ("Colla Vella de Valls",), ("Àger",)], "name string")
    asked = ["NATION_3", "nation_3", "colla NATION_3", "Valls Vella Colla", "ager", "Nobody", None]
    rows = linking.validate(spark.createDataFrame(list(enumerate(asked)), "qid int, entity string"), names).collect()
    assert {r["qid"]: r["name"] for r in rows} == {0: "NATION_3", 1: "NATION_3", 2: "NATION_3", 3: "Colla Vella de Valls", 4: "Àger", 5: None, 6: None}
    assert len(rows) == len(asked)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "attempt_id string, event_id long, group_id long, item_name string, status string, day string")
    scores = spark.createDataFrame([], 'code string, external string, name string, full long, partial long, tier string')
    assert scoring.alias_join(empty, scores).count() == 0
    assert retrieval.chunks(spark.createDataFrame([(1, None)], "doc_id int, text string")).count() == 0
