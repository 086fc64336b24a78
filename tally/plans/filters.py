"""Filters of reports, as one value: what is not given does not filter, and what a report cannot honour is an error."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.tables import TIER_CODES


@dataclass(frozen=True)
class FilterSpec:
    groups: tuple[str, ...] = ()
    items: tuple[str, ...] = ()
    item_status: str | None = None
    years: tuple[int, ...] = ()
    locations: tuple[str, ...] = ()
    event_names: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    editions: tuple[int, ...] = ()
    days: tuple[str, ...] = ()
    positions: tuple[int, ...] = ()
    tier: str | None = None
    limit: int = 20

    def only(self, *names: str) -> FilterSpec:
        """self, if no filter but the named ones is set."""
        odd = [f.name for f in fields(self) if f.name not in (*names, "limit") and getattr(self, f.name)]
        if odd:
            raise ValueError(f"this report does not filter by {', '.join(odd)}")
        return self


def one_or_many(column: str, values: tuple[str, ...]) -> Column:
    """One value is sought inside the column, several must be equal to it."""
    return F.col(column).contains(values[0]) if len(values) == 1 else F.col(column).isin(*values)


def in_years(df: DataFrame, years: tuple[int, ...]) -> Column:
    """Whether an event is in one of the years. Where the rows carry the date from which the event's month comes, the
    years are ranges of it, which scans can take over."""
    if "ordered_on" not in df.columns:
        return F.year("event_date").isin(*years)
    day = lambda year: F.lit(datetime.date(year, 1, 1))
    return reduce(lambda a, b: a | b, [(F.col("ordered_on") >= day(y)) & (F.col("ordered_on") < day(y + 1)) for y in sorted(set(years))])


def apply(df: DataFrame, spec: FilterSpec, group: str = "group_name") -> DataFrame:
    """Rows of performances that pass the filters on group, item, year, location, event name, status and tier. A tier
    that is a named list of codes stands for these codes; any other one is a value of the column."""
    tests = [
        (spec.groups, lambda: F.col(group).isin(*spec.groups)),
        (spec.items, lambda: F.col("item_code").isin(*spec.items)),
        (spec.years, lambda: in_years(df, spec.years)),
        (spec.locations, lambda: one_or_many("city", spec.locations)),
        (spec.event_names, lambda: one_or_many("event_name", spec.event_names)),
        (spec.statuses, lambda: F.col("status").isin(*spec.statuses)),
        (spec.tier, lambda: F.col("item_code").isin(*TIER_CODES[spec.tier]) if spec.tier in TIER_CODES else F.col("tier") == spec.tier),
    ]
    for given, test in tests:
        if given:
            df = df.filter(test())
    return df
