"""Years of evidence as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.dictionaries import YEARS
from folioscope.functions.urls import path

_ANY = r"(?<!\d)(20\d\d)(?!\d)"
# Classes of elements that hold a date.
DATE_CLASSES = ("date", "published", "entry-date", "post-date", "article-date", "created", "modified", "updated", "datetime", "data-publicacao")


def _all(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_ANY), F.lit(1)).cast("array<int>")))


def inside(text: Column, years: tuple[int, int] = YEARS) -> Column:
    """Distinct years of the window in a text, ascending."""
    return F.filter(_all(text), lambda y: y.between(*years))


def outside(text: Column, years: tuple[int, int] = YEARS) -> Column:
    """Distinct years 20xx out of the window."""
    return F.filter(_all(text), lambda y: ~y.between(*years))


def _decoded_path(url: Column) -> Column:
    return F.coalesce(F.try_url_decode(path(url)), path(url))


def inside_path(url: Column) -> Column:
    """Years of the window in the path of a URL; host and query don't count (Y2)."""
    return inside(_decoded_path(url))


def outside_path(url: Column) -> Column:
    return outside(_decoded_path(url))


def provisional(url: Column) -> Column:
    """The year of the path if there is just one."""
    found = inside_path(url)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def pdf_date(raw: Column, years: tuple[int, int] = YEARS) -> Column:
    """The year that a document's date begins with, if it lies in the window."""
    digits = F.regexp_extract(F.trim(raw), r"^(?:D:)?(\d{4})", 1)
    year = F.nullif(digits, F.lit("")).cast("int")
    return F.when(year.between(*years), year)


def html_dates(html: Column, years: tuple[int, int] = YEARS) -> Column:
    """Years in time elements and in elements of date-like classes (Y6), by regular expression."""
    text = F.coalesce(html, F.lit(""))
    attributes = F.transform(F.regexp_extract_all(text, F.lit(r'(?is)<time\b[^>]*?\bdatetime\s*=\s*["\']?(\d{4})'), F.lit(1)), lambda y: y.cast("int"))
    elements = F.regexp_extract_all(text, F.lit(r"(?is)<time\b[^>]*>(.*?)</time>"), F.lit(1))
    words = "|".join(DATE_CLASSES)
    value = "(?:" + "|".join(f"{q}[^{q}]*(?:{words})[^{q}]*{q}" for q in ('"', "'")) + rf"|[^\s\"'>]*(?:{words})[^\s\"'>]*)"
    classed = F.regexp_extract_all(text, F.lit(r"(?is)<(\w+)\b[^>]*?\bclass\s*=\s*" + value + r"[^>]*>(.*?)</\1>"), F.lit(2))
    inner = F.array_join(F.transform(F.concat(elements, classed), lambda e: F.regexp_replace(e, "(?s)<[^>]*>", "")), "\n")
    return F.array_sort(F.array_union(F.filter(attributes, lambda y: y.between(*years)), inside(inner, years)))


def off_peak(minute: Column, start: int, end: int) -> Column:
    """Whether a minute of the day lies in [start, end), which may wrap past midnight."""
    return (minute >= start) & (minute < end) if start <= end else (minute >= start) | (minute < end)
