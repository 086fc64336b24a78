"""Parsers and codes on single texts."""

import pytest
from pyspark.sql import functions as F

from tally.functions import codes, fuzzy, parse
from tally.functions.tables import DISPLAY_NAMES


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("dos de set", "2d7"), ("3 de 9 amb folre", "3d9f"), ("torre de 6", "2d6"), ("pilar de 5", "Pd5"), ("3 de 7 amb agulla", "3d7a"), ("3 de 7 per sota", "3d7s"),
        ("tres de nou amb folre i manilles", "3d9fm"), ("dos de set amb manilles", "2d7"), ("un 4d9f net", "4d9f"), ("res de res", ""), ("", ""), ("tres de deu amb folre manilles i puntals", "3d10fmp"), ("3 de 9 amb manilles i folre", "3d9fm"),
    ],
)
def test_item_code(spark, text, code):
    assert one(spark, text, parse.item_code) == code


@pytest.mark.parametrize(("text", "years"), [("2019 i 2023", [2019, 2023]), ("del 96", [1996]), ("dels 23", [2023]), ("3 de 10", []), ("2001-2004", [2001, 2004]), ("cap", [])])
def test_years(spark, text, years):
    assert one(spark, text, parse.years) == years


@pytest.mark.parametrize(("cell", "item", "status"), [("3de9f(id)", "3d9f", "Intent desmuntat"), ("*4de8 (c)", "4d8", "Carregat"), ("—", "—", ""), ("", "", ""), (None, "", ""), ("3d9fa", "3d9af", "Descarregat"), ("pd7f (i)", "Pd7f", "Intent"), ("3d7ps", "3d7s", "Descarregat")])
def test_contest_cells(spark, cell, item, status):
    assert one(spark, cell, codes.cell_item) == item
    assert one(spark, cell, codes.cell_status) == status


def test_place_and_city(spark):
    got = one(spark, "26/09/202410:00Plaça VellaTarragona", parse.place_city)
    assert tuple(got) == ("26/09/2024", "10:00", "Plaça Vella", "Tarragona")
    assert tuple(one(spark, "Tarragona", parse.place_city)) == (None, None, "", "Tarragona")


def test_result_and_event_name(spark):
    assert tuple(one(spark, "3de9f (Descarregat)", parse.result)) == ("3de9f", "Descarregat")
    assert tuple(one(spark, "3de9f", parse.result)) == ("3de9f", None)
    assert one(spark, "Sant Fèlix a VilafrancaDiada de Sant Fèlix", parse.event_name) == "Diada de Sant Fèlix"


def test_decades(spark):
    assert one(spark, "anys 80", parse.decades) == list(range(1980, 1990))
    assert one(spark, "segle XIX", parse.decades) == list(range(1800, 1900))
    assert one(spark, "avui", parse.decades) == []


def test_display_names(spark):
    names = DISPLAY_NAMES
    assert len(names) == 54 and names["3d6a"] == "3de6p" and names["3d9af"] == "3de9fp" and names["Pd4"] == "Pde4"
    assert one(spark, "zz", codes.code_to_name) == "zz"


def test_ratios():
    assert fuzzy.partial_ratio_of("vella", "colla vella de valls") == 100
    assert fuzzy.partial_ratio_of("", "x") == 0
    assert fuzzy.token_set_ratio_of("colla vella", "vella colla de valls") == 100
