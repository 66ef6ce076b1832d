"""Day calendars and calendar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema as S
from faultline.functions.text import lookup


def weekday_name(day: Column) -> Column:
    return lookup(F.weekday(day), dict(enumerate(S.WEEKDAY_LABELS)))


def calendar_between(bounds: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """One row per day from ``first`` to ``last`` of a one-row frame."""
    days = F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))
    return bounds.where(F.col(first).isNotNull()).select(F.explode(days).alias(name))


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by integer arithmetic (anonymous algorithm)."""

    def div(left: Column, right: int) -> Column:
        return F.floor(left / right)

    century, golden = div(year, 100), year % 19
    leap = div(century - div(century + 8, 25) + 1, 3)
    epact = (golden * 19 + century - div(century, 4) - leap + 15) % 30
    weekday = ((century % 4) * 2 + div(year % 100, 4) * 2 + 32 - epact - (year % 100) % 4) % 7
    shift = div(golden + epact * 11 + weekday * 22, 451)
    total = epact + weekday - shift * 7 + 114
    return F.make_date(year.cast("int"), div(total, 31).cast("int"), (total % 31 + 1).cast("int"))


# National holidays of Brazil on a fixed day (month * 100 + day),
# the one that exists only since a given year, and Good Friday.
FIXED_HOLIDAYS = [101, 421, 501, 907, 1012, 1102, 1115, 1225]
LATE_HOLIDAY, LATE_HOLIDAY_SINCE = 1120, 2024
GOOD_FRIDAY_OFFSET = -2


def is_holiday(day: Column) -> Column:
    month_day = F.month(day) * 100 + F.dayofmonth(day)
    return (
        month_day.isin(FIXED_HOLIDAYS)
        | ((month_day == LATE_HOLIDAY) & (F.year(day) >= LATE_HOLIDAY_SINCE))
        | (day == F.date_add(easter_sunday(F.year(day)), GOOD_FRIDAY_OFFSET))
    )


def black_friday(day: Column) -> Column:
    """Fourth Friday of November in the year of ``day``."""
    before = F.make_date(F.year(day), F.lit(10), F.lit(31))
    return F.date_add(F.next_day(before, "Fri"), 21)


def calendar_features(day: Column) -> dict[str, Column]:
    friday = black_friday(day)
    flags = {f"dow_{number}": F.weekday(day) == number for number in range(7)}
    flags |= {
        "is_weekend": F.weekday(day) >= 5,
        "is_holiday": is_holiday(day),
        "black_week": day.between(F.date_sub(friday, 1), F.date_add(friday, 4)),
        "dec_season": (F.month(day) == 12) & (F.dayofmonth(day) >= 15),
    }
    return {name: flag.cast("int") for name, flag in flags.items()}
