"""Readers and sinks on small files."""

import json

from pyspark.sql import functions as F

from tally.operators import reports, scoring
from tally.plans import roles
from tally.sources import readers, sinks

EVENT = {"event_id": 1, "event_name": "Diada", "date": "01/02/2003", "place": "P", "city": "C", "colles": [{"colla_name": "A", "castells": [{"castell_name": "3d7", "status": "Descarregat", "raw_text": "3d7 (Descarregat)"}]}, {"colla_name": "B", "castells": []}]}


def test_events_in_three_forms(spark, tmp_path):
    forms = {"wrapped": json.dumps({"events": [EVENT]}, indent=1), "bare": json.dumps([EVENT]), "loose": json.dumps({"events": [EVENT]}).replace("]}", ",]}")}
    for name, body in forms.items():
        (tmp_path / f"{name}.json").write_text(body)
        got = readers.events(spark, f"{tmp_path}/{name}.json")
        assert got["attempts"].select("event_id", "group_name", "item_name", "status").collect() == [(1, "A", "3d7", "Descarregat")]
        assert got["event_groups"].count() == 2 and got["events"].count() == 1
    (tmp_path / "lines.jsonl").write_text(json.dumps(EVENT) + "\n\n" + json.dumps(EVENT | {"event_id": 2}) + "\n")
    assert readers.events(spark, f"{tmp_path}/lines.jsonl", lines=True)["events"].count() == 2


def test_scores_contests_and_texts(spark, tmp_path):
    (tmp_path / "scores.json").write_text(json.dumps({"title": "t", "puntuacions": {"3d7": {"descarregats": 100, "carregat": 0}}}))
    assert readers.scores(spark, f"{tmp_path}/scores.json").collect() == [("3d7", "3de7", 100, None)]
    (tmp_path / "r.json").write_text(json.dumps([{"edition": 5, "title": "E", "year": 1999, "results": [{"group_name": "A", "position": 1, "points": "x"}]}]))
    (tmp_path / "e.json").write_text("[]")
    row = readers.contests(spark, f"{tmp_path}/r.json", f"{tmp_path}/e.json").first()
    assert row["date"] == "1999" and row["points"] is None and row["winner"] is None
    (tmp_path / "g.txt").write_text("MÚSICA\none\n\ntwo\nTÈCNICA\nthree\n")
    got = readers.general_info(spark, f"{tmp_path}/g.txt", r"^\p{Lu}+$").orderBy("line_number").collect()
    assert [(r["category"], r["text"], r["line_number"]) for r in got] == [("MÚSICA", "one", 2), ("MÚSICA", "two", 4), ("TÈCNICA", "three", 6)]
    (tmp_path / "c.json").write_text(json.dumps({"chunks": [{"id": "a", "years": [1980], "colles": ["X"]}], "metadata": {}}))
    assert readers.info_chunks(spark, f"{tmp_path}/c.json").select("id", F.size("years")).collect() == [("a", 1)]
    (tmp_path / "d.json").write_text(json.dumps([{"any": 2018, "jornada": ""}]))
    assert readers.dictionary(spark, f"{tmp_path}/d.json", "contest_days").collect() == [(2018, "")]


def test_sinks(spark, data, tmp_path):
    perf = scoring.performances(spark, data)
    sinks.write_tables({"attempts": perf, "groups": roles.groups(spark, data)}, f"{tmp_path}/a", {"attempts": "event_year"})
    assert any(p.name.startswith("event_year=") for p in (tmp_path / "a" / "attempts").iterdir())
    year = readers.table(spark, f"{tmp_path}/a", "attempts").filter("event_year = 1997")
    assert year.count() == perf.filter("event_year = 1997").count()
    sinks.write_dataset(reports.best_event(perf), perf.agg(F.count("*").alias("attempts")), f"{tmp_path}/set")
    assert spark.read.json(f"{tmp_path}/set/rows").count() == 20 and spark.read.json(f"{tmp_path}/set/statistics").first()["attempts"] == perf.count()
    sinks.write_lines(reports.best_event(perf).select(F.col("items_done").alias("line")), f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").count() == 20
