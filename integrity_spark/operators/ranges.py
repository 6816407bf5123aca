"""Range and nearest joins without nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import last_value, next_value, scan


#: Bins of a cell, by which the rows of a range join are dealt.
CELL = 16
#: Unless this setting is "false", Spark shuffles rows again for a join whose keys are more than those by which they are dealt.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` for joins that have them among others, where the session lets joins use that."""
    return df.repartition(*keys) if df.sparkSession.conf.get(CO_PARTITION) == "false" else df


def dealt_points(points: DataFrame, on: Sequence[str], at: Column, bin_width: float) -> DataFrame:
    """``points`` dealt by keys and cell of their place, with their ``__cell`` and ``__bin``."""
    spot = F.floor(at / bin_width)
    return dealt(points.withColumn("__cell", F.floor(spot / CELL)), *on, "__cell").withColumn("__bin", spot)


def dealt_spans(spans: DataFrame, on: Sequence[str], lo: str, hi: str, bin_width: float) -> DataFrame:
    """``spans`` dealt by keys and cell, then cut into bins: a span is shuffled once for each cell that it reaches, mostly one."""
    a, z = F.floor(F.col(lo) / bin_width), F.floor(F.col(hi) / bin_width)
    cells = F.sequence(F.floor(a / CELL), F.floor(z / CELL))
    each = dealt(spans.where(F.col(lo) <= F.col(hi)).withColumn("__cell", F.explode(cells)), *on, "__cell")
    return each.withColumn("__bin", F.explode(F.sequence(F.greatest(a, F.col("__cell") * CELL), F.least(z, F.col("__cell") * CELL + CELL - 1))))


def range_join(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, lo: str, hi: str, bin_width: float, open_ends: bool = True) -> DataFrame:
    """Rows of ``points`` with each of ``spans`` whose closed interval [lo, hi] holds ``at``. Intervals are cut into bins
    of ``bin_width``, so the join is an equi-join on the keys and the bin; both sides are dealt by cells of CELL bins. Unbounded intervals (a null end) meet by key
    alone, in a branch of their own, which shuffles all points once more and is left out for ``open_ends=False``, where the
    caller knows both ends of every interval. Key columns are kept once."""
    keys = list(on)
    bounded = F.col(lo).isNotNull() & F.col(hi).isNotNull()
    cut = dealt_spans(spans.where(bounded), keys, lo, hi, bin_width)
    near = dealt_points(points, keys, F.col(at), bin_width).join(cut.hint("merge"), [*keys, "__cell", "__bin"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("__cell", "__bin")
    if not open_ends:
        return near
    open_spans = spans.where(~bounded)
    wide = points.join(open_spans.hint("merge"), keys).where((F.col(lo).isNull() | (F.col(at) >= F.col(lo))) & (F.col(hi).isNull() | (F.col(at) <= F.col(hi))))
    return near.unionByName(wide)


def nearest_value(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, value: str, out: str, also: Sequence[str] = ()) -> DataFrame:
    """``left`` with the nearest non-null ``value`` of ``right`` under the same keys, the lower one on ties; null where
    there is none. One ordered scan of both sides, which splits a key over many tasks. ``also``: columns of ``right`` that come
    with the value, of which ``right`` then has one row for each key."""
    keys = list(on)
    a = left.select(*keys, F.col(at).cast("double").alias("__x"), F.lit(1).alias("__side"), F.struct(*(c for c in left.columns if c not in keys)).alias("__row"))
    x = F.col(value).cast("double")
    b = right.where(F.col(value).isNotNull()).select(*keys, x.alias("__x"), F.struct(x.alias("__x"), *also).alias("__mark"))
    both = a.unionByName((b if also else b.distinct()).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    got = scan(both, keys, ["__x", "__side"], {"__lo": last_value("__mark"), "__hi": next_value("__mark")}).where("__side = 1")
    # A mark at the row's own place stands before it in the order.
    best = F.when(F.col("__hi").isNull() | (F.col("__x") - F.col("__lo.__x") <= F.col("__hi.__x") - F.col("__x")), F.col("__lo")).otherwise(F.col("__hi"))
    own = [F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in left.columns]
    return got.withColumn("__best", F.when(F.col("__x").isNotNull(), best)).select(*own, F.col("__best.__x").alias(out), *(F.col(f"__best.{c}").alias(c) for c in also))
