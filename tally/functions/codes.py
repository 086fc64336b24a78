"""Item codes and contest cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tally.functions.tables import DISPLAY_NAMES
from tally.plans.roles import ATTEMPT, COMPLETE, DISMANTLED, LOADED

def code_to_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def cell_text(cell: Column) -> Column:
    return F.regexp_replace(F.coalesce(cell, F.lit("")), r"[* ]", "")


def cell_status(cell: Column) -> Column:
    """The outcome that a contest cell is marked with."""
    low = F.lower(cell_text(cell))
    return (
        F.when(low == "", "")
        .when(low.rlike(r"(id|\(id\))$|^(id|\(id\))"), DISMANTLED)
        .when(low.rlike(r"(i|\(i\))$|^(i|\(i\))"), ATTEMPT)
        .when(low.rlike(r"(c|\(c\))$"), LOADED)
        .when(low.rlike("[-—]$"), "")
        .otherwise(COMPLETE)
    )


def cell_item(cell: Column) -> Column:
    """The item of a contest cell, without marks, in canonical spelling."""
    out = cell_text(cell)
    for old, new in (("(id)", ""), ("(i)", ""), ("(c)", ""), ("de", "d"), ("fa", "af"), ("ps", "s"), ("pd", "Pd")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out
