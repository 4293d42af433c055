"""Partial dates: a year, a month or a day, as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "January February March April May June July August September October November December".split()
# Month names as one citation style shortens them.
SHORT_MONTHS = "Jan. Feb. Mar. Apr. May June July Aug. Sept. Oct. Nov. Dec.".split()


def year_of(published: Column) -> Column:
    """First four digits, if a plausible year."""
    y = F.regexp_extract(published, r"([0-9]{4})", 1).try_cast("int")
    return F.when((y > 1500) & (y < 2200), y)


def parse_date(published: Column) -> Column:
    """struct(year, month, day) of YYYY[-MM[-DD]]."""
    part = lambda n: F.regexp_extract(published, r"^\s*([0-9]{4})(?:-([0-9]{1,2})(?:-([0-9]{1,2}))?)?", n).try_cast("int")
    month = F.when(part(2).between(1, 12), part(2))
    return F.struct(part(1).alias("year"), month.alias("month"), F.when(month.isNotNull() & part(3).between(1, 31), part(3)).alias("day"))


def _month(date: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), date["month"])


def long_date(date: Column) -> Column:
    """March 4, 2021"""
    return F.when(date["day"].isNotNull(), F.concat(_month(date, MONTHS), F.lit(" "), date["day"].cast("string"), F.lit(", "), date["year"].cast("string"))).when(
        date["month"].isNotNull(), F.concat(_month(date, MONTHS), F.lit(" "), date["year"].cast("string"))
    ).otherwise(date["year"].cast("string"))


def apa_date(date: Column) -> Column:
    """2021, March 4"""
    return F.coalesce(
        F.when(date["day"].isNotNull(), F.concat(date["year"].cast("string"), F.lit(", "), _month(date, MONTHS), F.lit(" "), date["day"].cast("string"))).when(
            date["month"].isNotNull(), F.concat(date["year"].cast("string"), F.lit(", "), _month(date, MONTHS))
        ).otherwise(date["year"].cast("string")),
        F.lit("n.d."),
    )


def mla_date(date: Column) -> Column:
    """4 Mar. 2021"""
    return F.when(date["day"].isNotNull(), F.concat(date["day"].cast("string"), F.lit(" "), _month(date, SHORT_MONTHS), F.lit(" "), date["year"].cast("string"))).when(
        date["month"].isNotNull(), F.concat(_month(date, SHORT_MONTHS), F.lit(" "), date["year"].cast("string"))
    ).otherwise(date["year"].cast("string"))


def year_bounds(low: Column, high: Column) -> Column:
    """struct(from, to): implausible years dropped, reversed bounds swapped."""
    a, b = F.when(low.between(1500, 2200), low), F.when(high.between(1500, 2200), high)
    both = a.isNotNull() & b.isNotNull()
    return F.struct(F.when(both, F.least(a, b)).otherwise(a).alias("from"), F.when(both, F.greatest(a, b)).otherwise(b).alias("to"))


def within(year: Column, low: Column, high: Column) -> Column:
    """Inside the bounds; an unknown year fails where there are bounds."""
    free = low.isNull() & high.isNull()
    return free | F.coalesce(year.isNotNull() & (low.isNull() | (year >= low)) & (high.isNull() | (year <= high)), F.lit(False))
