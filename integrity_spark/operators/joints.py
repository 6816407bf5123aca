"""Joint summaries: seam position per girth weld and source, and its joins to welds and feature sources.

Long tables: ``matrix(program_id, gwd, source, hours)``, ``lengths(program_id, gwd, length_m)``; matrices come in as
cells ``(program_id, row, col, value)`` with labels in column 0 (and 1); their layouts are resolved in ``matrices``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import collapsed, hours_to_clock, to_number
from ..sources.shared import kept
from .labels import clean_metric, clean_source_name, is_unit, label_sources, runs_of_labels  # noqa: F401
from .matrices import joint_matrix
from .ordered import key_size, lag, lead, row_number, scan
from .ranges import nearest_value

# Words that name no source; reach of a seam by weld number and by chainage (m); plausible joint lengths (m).
STOP_WORDS = ("ili", "tool", "inspection", "source", "vendor", "feature", "summary", "joint", "long", "seam", "orientation", "orient", "clock")
GWD_REACH, CHAINAGE_REACH, LENGTHS = 15, 2.0, (0.5, 200.0)


def gwd_from_text(text: Column) -> Column:
    """A header's weld number: the whole token (with an optional ``__n``), else its first run of 4 or 5 digits."""
    head = F.regexp_replace(F.trim(text), r"__\d+$", "")
    whole = to_number(head)
    run = F.regexp_extract(text, r"(?<!\d)(\d{4,5})(?!\d)", 1).try_cast("double")
    fits = lambda v: F.when((v > 100) & (v < 99999), v.cast("bigint"))
    return F.coalesce(fits(whole), F.when(whole.isNull(), fits(run)))


def normalize_joint_summary(labels: DataFrame) -> DataFrame:
    """Metric and source of each label row ``(program_id, row, label, source_label)``. A label that names several sources
    stands for as many rows: its nth occurrence takes the nth source, the last one when they run out."""
    by = W.partitionBy("program_id", F.col("label")).orderBy("row")
    n = F.row_number().over(by)
    names = label_sources(F.col("label"))
    own = F.when(F.trim(F.coalesce("source_label", F.lit(""))) != "", clean_source_name(F.col("source_label")))
    return labels.withColumns({"metric": clean_metric(F.col("label")), "occurrence": n, "names": names}).withColumn(
        "source", F.coalesce(own, F.when(F.size("names") > 0, F.element_at("names", F.least(F.col("occurrence"), F.size("names")))), F.lit(""))
    ).drop("names")


def unpivot_joint_matrix(cells: DataFrame) -> DataFrame:
    """Cells of joint summary matrices, header in row 0, as rows ``(program_id, row, gwd, source, hours)``."""
    return joint_matrix(cells)[0].drop("shown")


def joint_lengths(lengths: DataFrame) -> DataFrame:
    """Mean of the plausible lengths of each weld, to 2 decimals half-even."""
    v = to_number(F.col("length_m"))
    return lengths.where((v > LENGTHS[0]) & (v < LENGTHS[1])).groupBy("program_id", "gwd").agg(F.bround(F.avg(v), 2).alias("length_m"))


def source_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(collapsed(name)), F.lit(r"[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS)))


def match_source_names(feature_sources: DataFrame, joint_sources: DataFrame) -> DataFrame:
    """The closest joint source of each feature source of a program: by token subset, overlap, then containment, the
    first on ties; the first source where nothing is alike. Pairs stay within a program."""
    a = feature_sources.select("program_id", F.col("source").alias("feature_source"))
    b = joint_sources.select("program_id", F.col("source").alias("joint_source"), "ord")
    x, y = source_tokens(F.col("feature_source")), source_tokens(F.col("joint_source"))
    fs, js = F.lower(collapsed(F.col("feature_source"))), F.lower(collapsed(F.col("joint_source")))
    subset = F.when((F.size(y) > 0) & (F.size(F.array_except(y, x)) == 0), 1).otherwise(0)
    contains = F.when(((js != "") & F.contains(fs, js)) | ((fs != "") & F.contains(js, fs)), 1).otherwise(0)
    score = F.struct(subset.alias("subset"), F.size(F.array_intersect(x, y)).alias("overlap"), contains.alias("contains"), (-F.col("ord")).alias("first"))
    best = a.join(b, "program_id").withColumn("score", score).groupBy("program_id", "feature_source").agg(F.max(F.struct("score", "joint_source")).alias("b"))
    return best.select("program_id", "feature_source", F.col("b.joint_source").alias("joint_source"))


def seam_for_weld(welds: DataFrame, matrix: DataFrame, keys: Sequence[str] = ("program_id", "source"), reach: float = GWD_REACH) -> DataFrame:
    """Seam hours of the weld's number, else of the nearest number within reach; the lower one on ties."""
    near = nearest_value(welds, matrix, keys, "gwd", "gwd", "near_gwd")
    one = matrix.groupBy(*keys, F.col("gwd").cast("double").alias("near_gwd")).agg(F.min("hours").alias("seam_hours"))
    met = near.join(one, [*keys, "near_gwd"], "left")
    close = F.abs(F.col("near_gwd") - F.col("gwd")) <= reach
    return met.withColumn("seam_hours", F.when(close, F.col("seam_hours"))).withColumn("seam_label", hours_to_clock(F.col("seam_hours"))).drop("near_gwd")


def seam_by_chainage(spans: DataFrame, seams: DataFrame, keys: Sequence[str] = ("line_id",), reach: float = CHAINAGE_REACH) -> DataFrame:
    """Seam hours of the nearest chainage strictly within reach."""
    near = nearest_value(spans, seams, keys, "chainage", "chainage", "near_x")
    one = seams.groupBy(*keys, F.col("chainage").cast("double").alias("near_x")).agg(F.min("hours").alias("seam_hours"))
    met = near.join(one, [*keys, "near_x"], "left")
    return met.withColumn("seam_hours", F.when(F.abs(F.col("near_x") - F.col("chainage")) < reach, F.col("seam_hours"))).drop("near_x")


def positional_welds(girth: DataFrame, matrix_gwds: DataFrame) -> DataFrame:
    """Pair welds by offset from their anchors: of the girth list the weld nearest chainage 0, of the matrix its target
    column, else the middle one. A girth list may bring its own order as ``idx``."""
    g = girth if "idx" in girth.columns else scan(girth, ["program_id"], ["chainage"], {"idx": row_number()})
    zero = g.groupBy("program_id").agg(F.min_by("idx", F.struct(F.abs("chainage"), "idx")).alias("anchor"))
    m = scan(matrix_gwds, ["program_id"], ["ord"], {"idx": row_number()})
    mid = m.groupBy("program_id").agg(F.coalesce(F.min(F.when(F.col("is_target"), F.col("idx"))), F.floor(F.count("*") / 2) + 1).alias("anchor"))
    a = g.join(zero, "program_id").select("program_id", "idx", "chainage", (F.col("idx") - F.col("anchor")).alias("offset"))
    return a.join(m.join(mid, "program_id").select("program_id", "gwd", (F.col("idx") - F.col("anchor")).alias("offset")), ["program_id", "offset"])


def dedupe_welds(girth: DataFrame) -> DataFrame:
    """One row, that of the lowest chainage, of each program, source, chainage to 6 decimals and number."""
    key = {"__s": collapsed(F.col("source")), "__x": F.bround("chainage", 6)}
    first = girth.withColumns(key).groupBy("program_id", "__s", "__x", "gwd").agg(F.min_by(F.struct(*girth.columns), F.struct("chainage", *girth.columns)).alias("r"))
    return first.select("r.*")


def joint_context(girth: DataFrame, matrix: DataFrame, matches: DataFrame) -> DataFrame:
    """Per feature source: the weld nearest to chainage 0 and its neighbours, with seam labels of the matched joint
    source. Columns: program, source, role, gwd, chainage, seam."""
    g = dedupe_welds(girth.where("chainage IS NOT NULL"))
    zero = g.groupBy("program_id", "source").agg(F.min_by("chainage", F.struct(F.abs("chainage"), "chainage")).alias("t"))
    g = g.join(zero, ["program_id", "source"]).withColumn("role", F.when(F.col("chainage") < F.col("t"), "upstream").when(F.col("chainage") > F.col("t"), "downstream").otherwise("target"))
    near = g.groupBy("program_id", F.col("source").alias("feature_source"), "role").agg(F.min_by(F.struct("gwd", "chainage"), F.struct(F.abs(F.col("chainage") - F.col("t")), "gwd")).alias("w")).select("program_id", "feature_source", "role", "w.*")
    met = near.join(matches, ["program_id", "feature_source"], "left").withColumn("source", F.col("joint_source"))
    return seam_for_weld(met, matrix).drop("source")


def seam_carry_upstream(rows: DataFrame) -> DataFrame:
    """Rows at a negative distance take the seam of the row before."""
    got = scan(rows, ["program_id", "source"], ["distance"], {"__before": lag("hours")})
    return got.withColumn("hours", F.when(F.col("distance") < 0, F.coalesce("__before", "hours")).otherwise(F.col("hours"))).drop("__before")


def tgw_layout(order: DataFrame, lengths: DataFrame, matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Four welds on the distance-from-target axis, and the seam spans between them. ``order``: program, gwd, ord,
    is_target. Needs four welds, one before and two after the target, and three plausible lengths."""
    by = W.partitionBy("program_id")
    o = scan(order, ["program_id"], ["ord"], {"idx": row_number(), "n": key_size()}).withColumn("idx", F.col("idx") - 1)
    at = o.groupBy("program_id").agg(F.coalesce(F.min(F.when(F.col("is_target"), F.col("idx"))), F.floor((F.max("n") - 1) / 2)).alias("it"), F.max("n").alias("n"))
    at = at.where("n >= 4 AND it >= 1 AND it + 2 < n").select("program_id", "it")
    four = o.join(at, "program_id").withColumn("k", F.col("idx") - F.col("it")).where("k BETWEEN -1 AND 2").select("program_id", "gwd", "k")
    v = F.when((F.col("length_m") > LENGTHS[0]) & (F.col("length_m") < LENGTHS[1]), F.col("length_m"))
    own = four.join(lengths.select("program_id", "gwd", v.alias("own")), ["program_id", "gwd"], "left")
    step = own.withColumn("length", F.coalesce("own", F.lead("own").over(by.orderBy("k"))))
    whole = step.groupBy("program_id").agg(F.count_if((F.col("k") < 2) & F.col("length").isNotNull()).alias("c")).where("c = 3").select("program_id")
    run = F.coalesce(F.sum("length").over(by.orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    placed = step.join(whole, "program_id", "left_semi").withColumn("run", run)
    zero = F.max(F.when(F.col("k") == 0, F.col("run"))).over(by)
    girths = placed.withColumn("chainage", F.col("run") - zero).select("program_id", "gwd", "k", "chainage", F.when(F.col("k") == 0, F.concat(F.lit("GWD "), F.col("gwd").cast("string"), F.lit(" (TGW)"))).otherwise(F.concat(F.lit("GWD "), F.col("gwd").cast("string"))).alias("label"))
    spans = girths.withColumn("chainage_end", F.lead("chainage").over(by.orderBy("k"))).where("k < 2")
    asked = spans.join(matrix.select("program_id", "source").distinct(), "program_id")
    seams = seam_for_weld(asked, matrix).where("seam_hours IS NOT NULL").select("program_id", "source", "gwd", F.col("chainage").alias("chainage_start"), "chainage_end", F.col("seam_hours").alias("orientation_hours"), F.col("seam_label").alias("orientation_label"))
    return girths.drop("k"), seams


def first_source_welds(matrix: DataFrame, order: DataFrame) -> DataFrame:
    """The welds of each program's first joint source in order of their numbers, with the seam of each."""
    of_source = matrix.groupBy("program_id", "source").agg(F.min("row").alias("row"))
    first = of_source.groupBy("program_id").agg(F.min_by("source", F.struct("row", "source")).alias("source"))
    welds = matrix.join(first, ["program_id", "source"]).groupBy("program_id", "source", "gwd").agg(F.min("hours").alias("hours"))
    marked = order.where("is_target").select("program_id", "gwd", F.lit(True).alias("is_target")).distinct()
    return welds.join(marked, ["program_id", "gwd"], "left").withColumns({"is_target": F.coalesce("is_target", F.lit(False)), "ord": F.col("gwd")})


def seam_spans_of_welds(welds: DataFrame, matrix: DataFrame) -> DataFrame:
    """From each weld (``idx`` is its place) to the next one, the seam of every joint source that has the weld's number
    or one within reach; the first of equal spans of a source."""
    spans = scan(welds, ["program_id"], ["idx"], {"chainage_end": lead("chainage")}).where("chainage_end IS NOT NULL AND gwd IS NOT NULL").drop("source")
    met = seam_for_weld(spans.join(matrix.select("program_id", "source").distinct(), "program_id"), matrix).where("seam_hours IS NOT NULL")
    one = F.struct("gwd", F.col("seam_hours").alias("orientation_hours"), F.col("seam_label").alias("orientation_label"))
    return met.groupBy("program_id", "source", F.col("chainage").alias("chainage_start"), "chainage_end").agg(F.min_by(one, "idx").alias("s")).select("program_id", "source", "s.gwd", "chainage_start", "chainage_end", "s.orientation_hours", "s.orientation_label")


def dig_feature_map(features: DataFrame, girth: DataFrame, matrix_cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A dig's map: features (distance from the target preferred), welds and seams. These come from the four-weld layout
    where a program has one, else from its weld list, whose welds without number take the matrix's by position. A program
    with features and a matrix, but no span, has one seam without ends: that of the first source's middle weld."""
    f = features.withColumn("chainage", F.coalesce("distance_from_tgw", "chainage")).where("chainage IS NOT NULL")
    found, lengths, order = joint_matrix(matrix_cells)
    matrix = kept(found.drop("shown"), "matrix")
    first = first_source_welds(matrix, order)
    g4, s4 = tgw_layout(order, lengths, matrix)
    laid = s4.select("program_id").distinct()
    rest = scan(girth.where("chainage IS NOT NULL").join(laid, "program_id", "left_anti"), ["program_id"], ["chainage", "gwd", "source"], {"idx": row_number()})
    placed = positional_welds(rest.select("program_id", "idx", "chainage"), first.select("program_id", "gwd", "ord", "is_target")).select("program_id", "idx", F.col("gwd").alias("placed"))
    rest = rest.join(placed, ["program_id", "idx"], "left").withColumn("gwd", F.coalesce("gwd", "placed")).drop("placed")
    spans = kept(s4.unionByName(seam_spans_of_welds(rest, matrix)), "seams")
    middle = first.groupBy("program_id").agg(F.array_sort(F.collect_list(F.struct("gwd", "hours", "source"))).alias("w")).withColumn("w", F.get("w", F.floor(F.size("w") / 2).cast("int")))
    lone = middle.join(f.select("program_id").distinct(), "program_id", "left_semi").join(spans.select("program_id").distinct(), "program_id", "left_anti")
    none = F.lit(None).cast("double")
    lone = lone.select("program_id", "w.source", "w.gwd", none.alias("chainage_start"), none.alias("chainage_end"), F.col("w.hours").alias("orientation_hours"), hours_to_clock(F.col("w.hours")).alias("orientation_label"))
    welds = g4.join(laid, "program_id", "left_semi").unionByName(rest.select("program_id", "gwd", "chainage", F.concat(F.lit("GWD "), F.col("gwd").cast("string")).alias("label")))
    return f, welds, spans.unionByName(lone)
