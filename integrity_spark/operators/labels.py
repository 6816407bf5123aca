"""Labels of joint summaries: metrics, units, and the inspection sources that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import collapsed

# Unit-like qualifiers, words of metric labels.
UNITS = ("hh:mm", "m", "mm", "in", "ft", "deg", "degree", "degrees", "clock", "clock position")
LABEL_WORDS = r"Long Seam Orientation|Longseam Orientation|Seam Orientation|Long Seam|Longseam|Orientation|hh:mm|Girth Weld No\.?"


def is_unit(text: Column) -> Column:
    norm = F.lower(collapsed(text))
    return (norm == "") | norm.isin(*UNITS) | norm.rlike(r"^[a-z%:/.\- ]{1,6}$")


def clean_source_name(label: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(collapsed(label), LABEL_WORDS, " "), r"[()]", " ")
    return F.btrim(collapsed(bare), F.lit(" -:"))


def clean_metric(label: Column) -> Column:
    """The label without parenthesised source names; units stay."""
    inside = F.filter(F.regexp_extract_all(label, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda x: ~is_unit(x))
    bare = F.aggregate(inside, collapsed(label), lambda acc, x: F.replace(acc, F.concat(F.lit("("), x, F.lit(")")), F.lit(" ")))
    return F.btrim(collapsed(bare), F.lit(" -:"))


def label_sources(label: Column) -> Column:
    """Source names in parentheses, else on the lines after the first; first spelling of each, in order."""
    found = F.filter(F.transform(F.regexp_extract_all(label, F.lit(r"\(([^)]+)\)"), F.lit(1)), collapsed), lambda x: ~is_unit(x))
    lines = F.filter(F.split(label, r"[\r\n]+"), lambda x: collapsed(x) != "")
    rest = F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: F.btrim(collapsed(x), F.lit("()"))), lambda x: ~is_unit(x))
    names = F.when(F.size(found) > 0, found).otherwise(rest)
    zero = F.array().cast("array<string>")
    return F.aggregate(names, zero, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def runs_of_labels(labels: DataFrame) -> DataFrame:
    """The one-column shape: occurrences restart with each run of equal labels."""
    by = W.partitionBy("program_id").orderBy("row")
    new = F.when(F.col("label").eqNullSafe(F.lag("label").over(by)), 0).otherwise(1)
    run = labels.withColumn("__new", new).withColumn("run", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("__new")
    return run.withColumn("occurrence", F.row_number().over(W.partitionBy("program_id", "run").orderBy("row")))
