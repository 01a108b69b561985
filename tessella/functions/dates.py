"""Dates of e-mail headers and office documents as milliseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of e-mail dates.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _millis(year, month, day, hour, minute, second, offset_minutes) -> Column:
    days = F.unix_date(F.expr("try_make_timestamp(1970, 1, 1, 0, 0, 0)").cast("date"))
    days = F.unix_date(F.to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")) + days
    return ((days.cast("long") * 24 + hour) * 60 + minute - offset_minutes) * 60_000 + second * 1000


def _offset(sign: Column, hours: Column, minutes: Column) -> Column:
    total = F.coalesce(hours.try_cast("int"), F.lit(0)) * 60 + F.coalesce(minutes.try_cast("int"), F.lit(0))
    return F.when(sign == "-", -total).otherwise(total)


def rfc5322_millis(text: Column) -> Column:
    """``[weekday,] day month year hour:minute[:second] [zone]``; named zones count as UTC."""
    pattern = r"^\s*(?:[A-Za-z]+,\s*)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+([+-])(\d{2})(\d{2}))?"
    part = lambda k: F.regexp_extract(text, pattern, k)
    number = lambda k: F.coalesce(part(k).try_cast("int"), F.lit(0))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(2))).cast("int")
    year = F.when(F.length(part(3)) == 2, F.when(number(3) < 70, 2000 + number(3)).otherwise(1900 + number(3))).otherwise(number(3))
    return F.when(text.rlike(pattern) & (month > 0), _millis(year, month, number(1), number(4), number(5), number(6), _offset(part(7), part(8), part(9))))


def w3cdtf_millis(text: Column) -> Column:
    """``year-month-day[Thour:minute[:second][Z or offset]]``; a second with a fraction counts as 0."""
    pattern = r"^\s*(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2})(?::([0-9.]+))?(?:Z|([+-])(\d{2}):(\d{2}))?)?\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    number = lambda k: F.coalesce(part(k).try_cast("int"), F.lit(0))
    return F.when(text.rlike(pattern), _millis(number(1), number(2), number(3), number(4), number(5), number(6), _offset(part(7), part(8), part(9))))


def exif_millis(text: Column) -> Column:
    """``year:month:day hour[:minute[:second]]``; parts of the time that aren't numbers count as 0."""
    pattern = r"^\s*(\d{4}):(\d{1,2}):(\d{1,2}) ([^:\s]*)(?::([^:\s]*))?(?::([^:\s]*))?"
    part = lambda k: F.regexp_extract(text, pattern, k)
    number = lambda k: F.coalesce(part(k).try_cast("int"), F.lit(0))
    return F.when(text.rlike(pattern), _millis(number(1), number(2), number(3), number(4), number(5), number(6), F.lit(0)))


def best_date(raw: Column, source: Column, mtime_ms: Column) -> tuple[Column, Column]:
    """Milliseconds and origin of a file's date: what it states, if that can be read, else its time of change."""
    stated = F.when(source == "office_metadata", w3cdtf_millis(raw)).when(source == "exif", exif_millis(raw)).when(source == "email_header", rfc5322_millis(raw))
    return F.coalesce(stated, mtime_ms), F.when(stated.isNotNull(), source).otherwise("filesystem_modified")
