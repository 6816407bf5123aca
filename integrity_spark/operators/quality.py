"""Comparisons with expected values, column statistics and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import to_number
from ..sources.shared import kept


def compare_ground_truth(readings: DataFrame, expected: DataFrame, additions: DataFrame | None = None, tolerance: float = 0.01) -> DataFrame:
    """Expected rows (marked correct; the corrected value first) and additions, with what is missing or off."""
    keys = ["circuit_id", "cml_id"]
    e = expected.where("is_correct").select(*keys, F.coalesce("corrected_reading", "min_reading").alias("expected"))
    if additions is not None:
        e = e.unionByName(additions.select(*keys, F.col("min_reading").alias("expected")))
    met = e.join(readings.select(*keys, F.col("min_reading").alias("actual")), keys, "left")
    diff = F.abs(F.col("actual") - F.col("expected"))
    return met.withColumn("problem", F.when(F.col("actual").isNull(), "missing").when(diff > tolerance, "different"))


def diff_keys(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only."""
    a, b = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("extra")))


def compare_dig_ids(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return diff_keys(expected, actual, ["dig_id"])


def percentiles(values: DataFrame, at: Sequence[float]) -> DataFrame:
    """Exact percentiles of each ``column`` by linear interpolation, as ``column`` and the array ``q``. ``values`` has
    ``column`` and the number ``v``; null numbers don't count, and a column without any has no row. Values are counted,
    the counts range-partitioned and summed up inside their range, so that no task holds more than a range."""
    counts = values.where("v IS NOT NULL").groupBy("column", "v").agg(F.count("*").alias("n"))
    dealt = kept(counts.repartitionByRange("column", "v").withColumn("__range", F.spark_partition_id()), "ranges")
    of_column = W.partitionBy("column")
    ahead = dealt.groupBy("column", "__range").agg(F.sum("n").alias("n"))
    ahead = ahead.select("column", "__range", F.coalesce(F.sum("n").over(of_column.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"), F.sum("n").over(of_column).alias("__all"))
    upto = F.sum("n").over(W.partitionBy("__range", "column").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = dealt.withColumn("__upto", upto).join(ahead.hint("broadcast"), ["column", "__range"]).withColumn("__end", F.col("__upto") + F.col("__ahead"))

    def value(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("__end")) & (rank >= F.col("__end") - F.col("n")), F.col("v")))

    found = []
    for p in at:
        place = F.lit(float(p)) * (F.col("__all") - 1)
        part = F.max(place - F.floor(place))
        found.append((1 - part) * value(F.floor(place)) + part * value(F.ceil(place)))
    return ranked.groupBy("column").agg(F.array(*found).alias("q"))


#: Items that a quantile sketch keeps a level; ranks are off by 2.3 / SKETCH ** 0.9 of all rows at most, with 99 % confidence.
SKETCH = 800
RANK_ERROR = 2.296 / SKETCH**0.9021


def sketched(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One mergeable KLL sketch for each column, of its numbers, in one pass: ``column, sketch``. Sketches of parts, days or files can be
    stored and merged by ``merged_sketches``."""
    one = [F.struct(F.lit(c).alias("column"), F.kll_sketch_agg_double(to_number(F.col(c)), SKETCH).alias("sketch")) for c in cols]
    return df.agg(F.array(*one).alias("s")).select(F.inline("s"))


def merged_sketches(parts: DataFrame) -> DataFrame:
    return parts.groupBy("column").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_percentiles(sketches: DataFrame, at: Sequence[float]) -> DataFrame:
    """``column, at, value``: values whose rank is off by ``RANK_ERROR`` at most; null where a column has no number."""
    one = lambda p: F.struct(F.lit(float(p)).alias("at"), F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias("value"))
    return sketches.select("column", F.inline(F.array(*map(one, at))))


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Moments of all columns in one pass, and exact quartiles, interpolated linearly."""
    numbers = {c: to_number(F.col(c)) for c in cols}
    one = [F.struct(F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")) for c, v in numbers.items()]
    moments = df.agg(F.array(*one).alias("s")).select(F.inline("s"))
    q = percentiles(df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), v.alias("v")) for c, v in numbers.items())))), (0.25, 0.5, 0.75))
    return moments.join(q.hint("broadcast"), "column", "left").select("column", "count", "mean", "std", "min", "max", *(F.get("q", F.lit(k)).alias(f"q{p}") for k, p in enumerate((25, 50, 75))))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal bins over [min, max], the last closed; equal ends are widened by a half. Every bin has a row."""
    v = to_number(F.col(col))
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).where("lo IS NOT NULL")
    same = F.col("lo") == F.col("hi")
    ends = ends.select(F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    binned = df.select(v.alias("v")).where("v IS NOT NULL").join(F.broadcast(ends))  # one row
    counts = binned.groupBy(F.least(F.width_bucket("v", "lo", "hi", F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = ends.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return frame.join(counts, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("edge_lo"), (F.col("lo") + F.col("bin") * width).alias("edge_hi"), F.coalesce("n", F.lit(0)).alias("n"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.coalesce(F.col(col).cast("string"), F.lit("")) != "").select(col).distinct().orderBy(col)
