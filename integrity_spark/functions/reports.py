"""Column functions over report text: dates, circuits, CML numbers, wall-thickness readings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reading patterns and bounds.
FAX = r"\d{3}\.\d{2}\s+0\.\d{3,4}\b"
READING = r"(?<!\d)(?<!\.)0\.\d{2,4}(?!\d)(?!\.\d)"
COLLAPSED_READING = r"(?<!\d)0\.\d{2,4}(?!\d)"
FALLBACK_READING = r"(?<!\d)(\d+\.\d{3,4})(?!\d)"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _filled(values: Column) -> Column:
    """The array, or null if it is empty."""
    return once(values, lambda v: F.when(F.size(v) > 0, v))


def looks_like_date(v: Column) -> Column:
    part = v - F.floor(v)
    return (v.between(1.0, 12.5) & part.between(0.2015, 0.2040)) | v.between(0.904, 0.908)


def plausible_reading(v: Column, fallback: bool = False) -> Column:
    ok = v.between(0.05, 3.0) & ~looks_like_date(v)
    return ok & ~(v.between(0.99, 1.01) | v.between(1.99, 2.01)) if fallback else ok


def extract_readings(text: Column) -> Column:
    """Plain readings; if none, those of the text without blanks; if none, numbers with three or four decimals."""

    def found(t: Column, pattern: str, fallback: bool = False) -> Column:
        values = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda x: x.try_cast("double"))
        return F.filter(values, lambda v: plausible_reading(v, fallback))

    tight = lambda t: F.regexp_replace(t, r"\s+", "")
    return once(F.regexp_replace(text, FAX, " "), lambda t: F.coalesce(_filled(found(t, READING)), _filled(found(tight(t), COLLAPSED_READING)), found(t, FALLBACK_READING, True)))


def made_date(year: Column, month: Column, day: Column) -> Column:
    text = lambda p: F.concat_ws("-", p.y.cast("string"), F.lpad(p.m.cast("string"), 2, "0"), F.lpad(p.d.cast("string"), 2, "0"))
    parts = F.struct(year.try_cast("int").alias("y"), month.try_cast("int").alias("m"), day.try_cast("int").alias("d"))
    return once(parts, lambda p: F.try_to_date(F.when(p.m.between(1, 12) & p.d.between(1, 31), text(p)), "yyyy-MM-dd"))


def month_number(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(name, F.lit(3)))).cast("string")


def parse_date(text: Column) -> Column:
    numeric = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"
    words = r"(?i)(january|february|march|april|may|june|july|august|september|october|november|december)\s+(\d{1,2}),?\s+(\d{4})"
    short = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+(\d{1,2})\s+(\d{4})"
    part = F.regexp_extract

    def read(t: Column) -> Column:
        by_number = made_date(part(t, numeric, 3), part(t, numeric, 1), part(t, numeric, 2))
        return F.coalesce(by_number, *(made_date(part(t, p, 3), month_number(part(t, p, 1)), part(t, p, 2)) for p in (words, short)))

    return once(text, read)


def report_date(text: Column, filename: Column | None = None) -> Column:
    line = parse_date(F.regexp_extract(text, r"(?i)DATE\s*:\s*([^\n]+)", 1))
    marked = parse_date(F.regexp_extract(text, r"(?i)DATE\s*\([^)]*\)\s*:\s*(\d{1,2}/\d{1,2}/\d{4})", 1))
    out = [line, marked]
    if filename is not None:
        p = r"_(\d{2})\.(\d{2})\.(\d{4})"
        out.append(made_date(*(F.regexp_extract(filename, p, k) for k in (3, 1, 2))))
    return F.coalesce(*out)


def circuit_raw(text: Column) -> Column:
    found = F.trim(F.regexp_extract(text, r"(?i)Circuit\s*:\s*([^\n]+)", 1))
    return F.when(found != "", found)


def circuit_base(raw: Column) -> Column:
    """``52-021K 1-2`` -> ``52-021K``; blank -> ``Unknown``."""
    text = F.trim(raw)
    base = F.regexp_extract(text, r"^(\d+-\w+)(?:\s+[\d,]*-[\d]+)?", 1)
    return F.when(text.isNull() | (text == ""), "Unknown").when(base != "", base).otherwise(text)


def _numbers(raw: Column) -> Column:
    return F.filter(F.split(raw, r"[\s,&]+"), lambda x: x.rlike(r"^\d+(\.\d+)?$"))


def cml_ids(text: Column, filename: Column | None = None) -> Column:
    """CML numbers of the text, else of the examined items, else of the file name."""
    none = F.array().cast("array<string>")
    own = [_numbers(F.regexp_extract(text, p, 1)) for p in (r"(?i)CML\s*:?\s*([\d.\s,&]+)", r"(?i)ITEM\(S\)\s*EXAMINED\s*:\s*CML\s*([\d.\s,&]+)")]
    if filename is not None:
        raw = [F.regexp_extract(filename, p, 1) for p in (r"(?i)CML\s*([\d.,\s&]+)", r"(?i)\d+-\w+\s+[\d,]*-[\d]+\s+([\d.]+)\s*UT", r"\d+-\w+\s+[\d,]*-[\d]+\s+([\d.,\s&]+)")]
        own.append(_numbers(F.when(raw[0] != "", raw[0]).when(raw[1] != "", raw[1]).otherwise(raw[2])))
    return F.coalesce(*map(_filled, own), none)
