"""Column functions: numbers, keys, clock orientation, text. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: A welded joint in dig packages (a seam weld counts too), and in feature maps.
DIG_WELD, MAP_WELD = r"girth weld|gwd|gw|weld", r"girth|gwd"


def to_number(col: Column) -> Column:
    """Malformed, NaN and suffixed text (``1d``) become null."""
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def number_of(df: DataFrame, name: str) -> Column:
    """``to_number`` of a column that may be numeric already; then no text is made."""
    if name in df.columns and isinstance(df.schema[name].dataType, NumericType):
        value = F.col(f"`{name}`").cast("double")
        return F.when(~F.isnan(value), value)
    return to_number(F.col(f"`{name}`"))


def clock_to_hours(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    part = F.split(text, ":")
    clock = to_number(F.get(part, F.lit(0))) + to_number(F.get(part, F.lit(1))) / 60.0
    return F.when(text == "", None).when(F.contains(text, F.lit(":")), clock).otherwise(to_number(text))


def clock_to_degrees(col: Column) -> Column:
    """Degrees from 12 o'clock; a plain number is in degrees already."""
    text = F.trim(col.cast("string"))
    return F.when(F.contains(text, F.lit(":")), clock_to_hours(text) / 12.0 * 360.0).otherwise(to_number(text))


def hours_to_clock(hours: Column) -> Column:
    whole = F.floor(hours)
    minutes = F.bround((hours - whole) * 60.0, 0).cast("int")
    carry = F.when(minutes >= 60, 1).otherwise(0)
    return F.concat(F.lpad((whole + carry).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes - carry * 60).cast("string"), 2, "0"))


def collapsed(col: Column) -> Column:
    """No-break spaces and runs of blanks become one blank."""
    return F.trim(F.regexp_replace(col.cast("string"), r"[\s\x{00A0}]+", " "))


def normalize_key(col: Column) -> Column:
    """Number-like text in one canonical form, other text in capitals with single blanks; null becomes empty."""
    text = F.trim(col.cast("string"))
    number = to_number(F.replace(text, F.lit(","), F.lit("")))
    whole = number.cast("decimal(38,0)").cast("string")
    fraction = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", number), "0+$", ""), r"\.$", "")
    other = F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.coalesce(F.when(number.isNull(), other).when(F.abs(number) >= 1e37, other).when(number == F.floor(number), whole).otherwise(fraction), F.lit(""))


def key_of(df: DataFrame, name: str) -> Column:
    """``normalize_key`` of a column; whole numbers, up to those that a double holds exactly, are their own text."""
    key = normalize_key(F.col(f"`{name}`"))
    return F.when(F.col(f"`{name}`").between(-(2**53), 2**53), F.col(f"`{name}`").cast("string")).otherwise(key) if isinstance(df.schema[name].dataType, IntegralType) else key


def split_multivalue(col: Column) -> Column:
    """Distinct lines of a cell, trimmed, without blanks and place-holders."""
    lines = F.transform(F.split(F.regexp_replace(col.cast("string"), "\r\n?", "\n"), "\n"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(lines, lambda x: ~x.isin("", "-", "N/A", "n/a")))


def first_line(col: Column) -> Column:
    lines = F.filter(F.transform(F.split(col, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit("-"))


def dash_default(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("-"))


def safe_name(name: Column, dig_id: Column) -> Column:
    """A file-name segment: the dig's name, else its id."""
    base = F.coalesce(F.when(~F.trim(name).isin("", "-"), name), dig_id.cast("string"), F.lit(""))
    out = F.btrim(F.regexp_replace(F.trim(base), r'[<>:"/\\|?*]', "_"), F.lit(" ._"))
    return F.when(out == "", "dig_package").otherwise(out)


def issue_date(col: Column) -> tuple[Column, Column]:
    """The parsed date, and the raw text where it doesn't parse."""
    text = F.when(F.trim(col.cast("string")) != "", F.trim(col.cast("string")))
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "yyyy/M/d", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy")
    found = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))
    return found, F.when(found.isNull(), text)


def valid_dig_id(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    number = to_number(F.replace(text, F.lit(","), F.lit("")))
    short = (number == F.floor(number)) & F.abs(number).between(1000, 999999)
    return F.coalesce(~F.lower(text).isin("", "-", "nan", "none") & (F.contains(F.upper(text), F.lit("GW")) | F.coalesce(short, F.lit(False))), F.lit(False))


def is_dig_weld(feature_type: Column) -> Column:
    return F.coalesce(F.lower(feature_type).rlike(DIG_WELD), F.lit(False))


def is_map_weld(feature_type: Column) -> Column:
    return F.coalesce(F.lower(feature_type).rlike(MAP_WELD), F.lit(False))


def is_defect(feature_type: Column) -> Column:
    return ~F.coalesce(F.lower(feature_type).rlike("girth|seam|gwd"), F.lit(False))


def json_number(col: Column) -> Column:
    number = to_number(col)
    return F.when(number.isNull(), col.cast("string")).when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))


def depth_band(depth: Column) -> Column:
    return F.when(depth.isNull() | F.isnan(depth), "grey").when(depth < 20, "green").when(depth < 40, "yellow").when(depth < 60, "orange").otherwise("red")


def hover_text(*fields: tuple[str, Column]) -> Column:
    """``Label: value`` lines of the fields that are there."""
    return F.concat_ws("\n", *(F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c.cast("string"))) for label, c in fields))


def dimensions_match(mdl: Column, ili: Column) -> Column:
    """Equal within tolerance as they are, mm against inches, or inches against mm."""
    inches, mm = mdl / 25.4, mdl * 25.4
    direct = F.abs(mdl - ili) <= F.greatest(F.lit(0.01), F.greatest(F.abs(mdl), F.abs(ili)) * 0.01)
    as_inch = F.abs(inches - ili) <= F.greatest(F.lit(0.02), F.greatest(F.abs(ili), F.abs(inches)) * 0.02)
    as_mm = F.abs(mm - ili) <= F.greatest(F.lit(0.01), F.greatest(F.abs(ili), F.abs(mm)) * 0.01)
    return F.coalesce(direct | as_inch | as_mm, F.lit(False))
