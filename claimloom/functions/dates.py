"""Dates as written: read where the text settles them, assumed by a stated convention, or refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import let

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
TIME_OF_DAY = r"[\s,]+\d{1,2}:\d{2}(:\d{2})?\s*([AaPp]\.?[Mm]\.?)?\s*$"


def _valid(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where the calendar has none; told by the length of the month, as a failed parse costs an exception a row."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when(month.between(1, 12) & year.between(1, 9999) & (day >= 1) & (day <= days), F.make_date(year, month, day))


def month_number(word: Column, extra: dict[str, int] | None = None) -> Column:
    """1 to 12 of a month's name or its first three letters."""
    names = {x: i + 1 for i, m in enumerate(MONTHS) for x in (m, m[:3])} | (extra or {})
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.lower(word))


def full_year(year: Column) -> Column:
    """Two digits are of this century; 100 to 1899 is no year that can be told."""
    return F.when(year >= 1900, year).when(year.between(0, 99), year + 2000)


def resolve_date(raw: Column, order: str = "dmy") -> Column:
    """struct(value, status): read, assumed (by `order`, dmy or mdy), ambiguous (under strict), year, invalid, unreadable; null if blank."""
    return let(date_parts(raw), lambda parts: by_order(parts, order))


def date_parts(raw: Column) -> Column:
    """What a date's text says whatever the order of day and month, for `by_order`; null if blank. Worked out once, it serves every order."""
    return let(F.trim(F.regexp_replace(F.trim(raw), TIME_OF_DAY, "")), lambda text: F.when(F.length(text) > 0, _read(text)))


def _read(text: Column) -> Column:
    iso = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$"
    written, american = r"^(\d{1,2})(-|\s+)([A-Za-z]+)(-|\s+)(\d{4})$", r"^([A-Za-z]+)\s+(\d{1,2})\s+(\d{4})$"
    form = F.when(~text.rlike("[A-Za-z]"), F.when(text.rlike(iso), "iso").otherwise("numbers")).when(text.rlike(written), F.when(F.trim(F.regexp_extract(text, written, 2)) == F.trim(F.regexp_extract(text, written, 4)), "written")).when(text.rlike(american), "written")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    seen = F.struct(form.alias("form"), numbers.alias("numbers"), month_number(F.regexp_extract(text, "([A-Za-z]+)", 1)).alias("month"))
    return let(seen, _parts)


def _parts(seen: Column) -> Column:
    """struct(named, three, first, second, year, day_first, month_first): a date that only one order can mean, or three numbers and the dates they may be."""
    at = lambda k: F.get(seen["numbers"], F.lit(k))
    named = F.when(seen["form"] == "iso", _valid(at(0), at(1), at(2))).when(seen["form"] == "written", _valid(at(1), seen["month"], at(0)))
    three = F.coalesce(seen["form"].isin("iso", "numbers"), F.lit(False)) & (F.size(seen["numbers"]) == 3)
    each = F.struct(named.alias("named"), three.alias("three"), at(0).alias("first"), at(1).alias("second"), full_year(at(2)).alias("year"))
    return let(each, lambda p: F.struct(*(p[c].alias(c) for c in ("named", "three", "first", "second", "year")), _valid(p["year"], p["second"], p["first"]).alias("day_first"), _valid(p["year"], p["first"], p["second"]).alias("month_first")))


def by_order(parts: Column, order: str) -> Column:
    """`resolve_date` of a text's `date_parts`."""
    first, second, day_first, month_first = (parts[c] for c in ("first", "second", "day_first", "month_first"))
    assumed = {"dmy": day_first, "mdy": month_first}.get(order, F.lit(None).cast("date"))
    days, months, either = (first > 12) & (second <= 12), (second > 12) & (first <= 12), (first <= 12) & (second <= 12)
    value = F.when(days, day_first).when(months, month_first).when(either, assumed)
    status = F.when(parts["year"].isNull(), "year").when(either, F.lit("ambiguous") if order == "strict" else F.when(assumed.isNull(), "invalid").otherwise("assumed")).when(days | months, F.when(value.isNull(), "invalid").otherwise("read")).otherwise("unreadable")
    told = F.struct(F.when(parts["named"].isNotNull(), parts["named"]).when(parts["three"], value).alias("value"), F.when(parts["named"].isNotNull(), "read").when(parts["three"], status).otherwise("unreadable").alias("status"))
    return F.when(parts.isNotNull(), told)


def resolve_expiry(raw: Column) -> Column:
    """struct(value, status): the last day of a month and year as printed, or a whole date by `resolve_date`."""
    text = F.trim(raw)
    parts = F.filter(F.split(text, "[^0-9A-Za-z]+"), lambda p: p != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    digits = lambda p: p.rlike(r"^\d+$")
    sept = {"sept": 9}
    leading = digits(first) & digits(second) & (F.length(first) == 4) & (F.length(second) <= 2)
    month = F.when(leading, second.try_cast("int")).when(digits(first) & digits(second), first.try_cast("int")).when(digits(second), month_number(first, sept)).when(digits(first), month_number(second, sept))
    year = F.when(leading, first.try_cast("int")).when(digits(second), second.try_cast("int")).when(digits(first), first.try_cast("int"))
    full = full_year(year)
    sound = month.between(1, 12)
    value = F.last_day(_valid(full, month, F.lit(1)))
    two = F.when(sound & full.isNotNull(), F.struct(value.alias("value"), F.lit("read").alias("status"))).when(sound, F.struct(F.lit(None).cast("date").alias("value"), F.lit("year").alias("status"))).otherwise(F.struct(F.lit(None).cast("date").alias("value"), F.lit("unreadable").alias("status")))
    other = F.struct(F.lit(None).cast("date").alias("value"), F.lit("unreadable").alias("status"))
    return F.when((F.length(text) > 0) & ~text.isin("-", "--", "—"), F.when(F.size(parts) == 3, resolve_date(text)).when(F.size(parts) == 2, two).otherwise(other))
