"""Ordered scans that split a key: rows are dealt to ranges of (keys, order), so a line that holds most of a table is shared
by many tasks. Inside a range a window does the work; what a row needs of the ranges before or behind is carried to it.

Only the first and the last key of a range can go on in another one, so just these pieces, at most two a range, are summed up.
Their summaries are as many as tasks: one small window adds them up, and the result is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Place of a row in its piece, and rows of the piece, for the steps.
NTH, SIZE = "__nth", "__size"


@dataclass(frozen=True)
class Step:
    """One output of a scan: its value ``inside`` a piece (given the piece's window in order, and in reverse), the summary of a
    ``piece``, what is ``carried`` to a piece (given the summaries' column and the key's window over them), and the two ``met``."""

    inside: Callable[[WindowSpec, WindowSpec], Column]
    piece: Column
    carried: Callable[[Column, WindowSpec], Column]
    met: Callable[[Column, Column], Column]


def _before(w: WindowSpec, most: int = W.unboundedPreceding) -> WindowSpec:
    return w.rowsBetween(most, -1)


def row_number() -> Step:
    """The row's number in its key, from 1."""
    return Step(lambda w, _: F.row_number().over(w).cast("long"), F.count("*"), lambda s, w: F.sum(s).over(_before(w)), lambda own, c: own + F.coalesce(c, F.lit(0).cast("long")))


def key_size() -> Step:
    """Rows of the key."""
    whole = lambda s, w: F.sum(s).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return Step(lambda w, _: F.col(SIZE).cast("long"), F.count("*"), whole, lambda own, c: F.coalesce(c, own))


def key_least(col: str) -> Step:
    """The least non-null ``col`` of the key."""
    return _of_key(col, F.min, F.least)


def key_greatest(col: str) -> Step:
    """The greatest non-null ``col`` of the key."""
    return _of_key(col, F.max, F.greatest)


def _of_key(col: str, best: Callable[[Column | str], Column], met: Callable[[Column, Column], Column]) -> Step:
    every = lambda c, w: best(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return Step(lambda w, _: every(col, w), best(col), every, met)


def running_sum(col: str, before: bool = False) -> Step:
    """Sum of ``col`` up to the row, or up to the one ``before``; nulls add nothing, a sum of none is 0."""
    own = lambda w, _: F.coalesce(F.sum(col).over(w.rowsBetween(W.unboundedPreceding, -1 if before else 0)), F.sum(F.lit(0)).over(w))
    return Step(own, F.sum(col), lambda s, w: F.sum(s).over(_before(w)), lambda own, c: own + F.coalesce(c, F.lit(0)))


def running_xor(col: str) -> Step:
    """The XOR of ``col`` over the rows before; of none 0."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return Step(lambda w, _: zero(F.bit_xor(col).over(_before(w))), F.bit_xor(col), lambda s, w: F.bit_xor(s).over(_before(w)), lambda own, c: own.bitwiseXOR(zero(c)))


def last_value(col: str) -> Step:
    """The last non-null ``col`` up to and with the row."""
    return Step(lambda w, _: F.last(col, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.max_by(col, F.when(F.col(col).isNotNull(), F.col(NTH))), lambda s, w: F.last(s, ignorenulls=True).over(_before(w)), F.coalesce)


def next_value(col: str) -> Step:
    """The first non-null ``col`` from the row on."""
    behind = lambda s, w: F.first(s, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return Step(lambda _, back: F.last(col, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0)), F.min_by(col, F.when(F.col(col).isNotNull(), F.col(NTH))), behind, F.coalesce)


def _ends(col: str, keep: Column) -> Column:
    """The rows of a piece that other pieces may ask for, in order."""
    return F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(NTH).alias("at"), F.col(col).alias("v")))))


def lag(col: str, k: int = 1) -> Step:
    """``col`` of the row ``k`` before. Every piece has a row at least, so the ``k`` pieces before hold it."""
    own = lambda w, _: F.lag(F.struct(F.col(col).alias("v")), k).over(w)
    ahead = lambda s, w: F.flatten(F.collect_list(s).over(_before(w, -k)))
    met = lambda own, c: F.coalesce(own, F.struct(F.get(c, (F.size(c) - k + F.col(NTH) - 1).cast("int")).v.alias("v"))).v
    return Step(own, _ends(col, F.col(SIZE) - F.col(NTH) < k), ahead, met)


def lead(col: str, k: int = 1) -> Step:
    """``col`` of the row ``k`` behind."""
    own = lambda w, _: F.lead(F.struct(F.col(col).alias("v")), k).over(w)
    behind = lambda s, w: F.flatten(F.collect_list(s).over(w.rowsBetween(1, k)))
    met = lambda own, c: F.coalesce(own, F.struct(F.get(c, (k - 1 - F.col(SIZE) + F.col(NTH)).cast("int")).v.alias("v"))).v
    return Step(own, _ends(col, F.col(NTH) <= k), behind, met)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], steps: Mapping[str, Step], ranges: int | None = None) -> DataFrame:
    """``df`` with the outputs of ``steps`` over the rows of each key in ascending order, nulls first. ``order`` should leave no
    ties but between rows for which it makes no difference. Null keys are a key. ``ranges``: how many, else as many as
    shuffle partitions. Columns called ``__range``, ``__nth`` or ``__size`` aren't allowed."""
    by = [*keys, *order]
    tied = df.withColumn("__tie", F.monotonically_increasing_id())  # equal rows can be dealt to several ranges
    ranged = tied.repartitionByRange(ranges, *by, "__tie") if ranges else tied.repartitionByRange(*by, "__tie")
    dealt = kept(ranged.withColumn("__range", F.spark_partition_id()), "ranges")
    key = F.struct(*keys)
    borders = dealt.groupBy("__range").agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))

    piece = W.partitionBy("__range", *keys)
    there = [F.col(c).asc_nulls_first() for c in [*order, "__tie"]]
    back = [F.col(c).desc_nulls_last() for c in [*order, "__tie"]]
    w = piece.orderBy(*there)
    placed = {NTH: F.row_number().over(w), SIZE: F.count("*").over(piece)}

    at_border = dealt.join(F.broadcast(borders), "__range").where(key.eqNullSafe(F.col("__lo")) | key.eqNullSafe(F.col("__hi"))).drop("__lo", "__hi")
    summed = at_border.withColumns(placed).groupBy("__range", *keys).agg(*(s.piece.alias(f"__s{k}") for k, s in enumerate(steps.values())))
    pieces = W.partitionBy(*keys).orderBy("__range")
    carried = summed.select(F.col("__range").alias("__r"), F.struct(*keys).alias("__key"), *(s.carried(F.col(f"__s{k}"), pieces).alias(f"__c{k}") for k, s in enumerate(steps.values())))

    own = dealt.withColumns(placed | {f"__o{k}": s.inside(w, piece.orderBy(*back)) for k, s in enumerate(steps.values())})
    met = own.join(F.broadcast(carried), (F.col("__range") == F.col("__r")) & key.eqNullSafe(F.col("__key")), "left")
    return met.select(*df.columns, *(s.met(F.col(f"__o{k}"), F.col(f"__c{k}")).alias(name) for k, (name, s) in enumerate(steps.items())))
