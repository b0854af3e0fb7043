"""Names of events from their dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Holidays of the solar calendar, and approximate dates of lunar ones.
SOLAR = {
    (1, 1): "元旦",
    (2, 14): "情人节",
    (3, 8): "妇女节",
    (5, 1): "劳动节",
    (6, 1): "儿童节",
    (10, 1): "国庆节",
    (10, 31): "万圣节",
    (12, 25): "圣诞节",
    (12, 31): "跨年夜",
}
LUNAR = [(1, 22, "春节"), (2, 5, "元宵节"), (4, 5, "清明节"), (6, 10, "端午节"), (8, 15, "中秋节")]
LUNAR_DAYS = 3


def holiday_of(day: Column) -> Column:
    """The holiday of one date, or null; a solar one comes before a lunar one within three days of the same month."""
    month, number = F.month(day), F.dayofmonth(day)
    found = [F.when((month == m) & (number == d), name) for (m, d), name in SOLAR.items()]
    found += [F.when((month == m) & (F.abs(number - d) <= LUNAR_DAYS), name) for m, d, name in LUNAR]
    return F.coalesce(*found)


def first_holiday(start: Column, end: Column) -> Column:
    """The holiday of the earliest date from start to end that has one."""
    days = F.sequence(F.to_date(start), F.to_date(end))
    return F.get(F.filter(F.transform(days, holiday_of), lambda h: h.isNotNull()), 0)


def event_name(start: Column, end: Column, location: Column | None = None) -> Column:
    """Holiday, else several days with or without a place, else weekend or weekday."""
    holiday, days = first_holiday(start, end), F.date_diff(F.to_date(end), F.to_date(start)) + 1
    place = location if location is not None else F.lit(None).cast("string")
    day = F.when(F.weekday(start) >= 5, "周末随拍").otherwise("日常记录")
    return (
        F.when(holiday.isNotNull(), F.concat(F.year(start).cast("string"), F.lit(" 年"), holiday))
        .when((days > 1) & (F.length(place) > 0), F.concat(place, F.lit(" ("), F.date_format(start, "yyyy-MM"), F.lit(")")))
        .when(days > 1, F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit(" ~ "), F.date_format(end, "MM-dd"), F.lit(" ("), days.cast("string"), F.lit("天)")))
        .otherwise(F.concat(day, F.lit(" · "), F.date_format(start, "yyyy-MM-dd")))
    )
