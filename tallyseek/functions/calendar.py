"""Calendar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (name, month, day); the order decides between two holidays in reach.
HOLIDAYS = (
    ("New Year", 1, 1),
    ("Women's Day", 3, 8),
    ("Men's Day", 11, 14),
    ("Independence Day of Ukraine", 8, 24),
    ("Constitution Day of Ukraine", 6, 28),
    ("Day of Defenders of Ukraine", 10, 14),
    ("Valentine's Day", 2, 14),
    ("Teacher's Day", 10, 5),
    ("Day of Lviv city", 4, 27),
    ("Day of Dignity and Freedom", 11, 21),
    ("Day of Ukrainian Language", 11, 9),
    ("The Nativity of Christ", 12, 25),
    ("Saint Nicholas Day", 12, 6),
    ("Easter", 4, 16),
)


def season(date: Column) -> Column:
    """Meteorological season, from the quarter that starts in December."""
    names = F.array(F.lit("Winter"), F.lit("Spring"), F.lit("Summer"), F.lit("Autumn"))
    return names[F.floor((F.month(date) % 12) / 3).cast("int")]


def weekday_name(date: Column) -> Column:
    return F.date_format(date, "EEEE")


def parse_day_first(text: Column) -> Column:
    """`DD.MM.YYYY` to a date; anything else is null."""
    return F.when(text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(text, "d.M.yyyy"))


def date_parts(date: Column) -> dict[str, Column]:
    return {"Year": F.year(date), "Month": F.month(date), "Day": F.dayofmonth(date)}


def next_holiday(date: Column, reach_days: int = 3, holidays=HOLIDAYS) -> Column:
    """Struct `name, holiday` of the first listed holiday within reach in the date's year.

    The calendar is a short fixed list, so the range lookup is an expression: no join, no
    shuffle.  Null when no holiday is in reach.
    """
    candidates = []
    for name, month, day in holidays:
        when = F.make_date(F.year(date), F.lit(month), F.lit(day))
        within = when.between(date, F.date_add(date, reach_days))
        candidates.append(F.when(within, F.struct(F.lit(name).alias("name"), when.alias("holiday"))))
    return F.coalesce(*candidates)


def purchase_date(date: Column, holiday: Column) -> Column:
    """The day before the holiday in reach, else the date itself."""
    return F.coalesce(F.date_sub(holiday["holiday"], 1), date)
