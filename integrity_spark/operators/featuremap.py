"""Feature maps: chainage and clock position of features, girth and seam welds, windows, views."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clock_to_degrees, clock_to_hours, hours_to_clock, hover_text, is_defect, is_map_weld, number_of, to_number
from ..sources.shared import kept
from .ordered import key_greatest, key_least, lag, lead, row_number, scan

DEFAULT_HOURS = 6.0
# Outside diameter (mm) by nominal pipe size.
OUTSIDE_DIAMETER = {4: 114.3, 5: 141.3, 6: 168.3, 8: 219.1, 10: 273.0, 12: 323.8, 14: 355.6, 16: 406.4, 18: 457.0, 20: 508.0, 24: 610.0, 28: 711.0, 32: 813.0}


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def gwd_parts(col: Column) -> tuple[Column, Column]:
    """Number (truncated) and text of a girth-weld cell."""
    number = to_number(col)
    whole = F.when(number.isNotNull(), number.cast("bigint"))
    return whole, F.coalesce(whole.cast("string"), F.trim(col.cast("string")))


def feature_map_anomaly(df: DataFrame) -> DataFrame:
    """Features of a defect listing; rows without a numeric chainage go."""
    number, label = gwd_parts(_col(df, "gwd_number"))
    raw = _col(df, "orientation_raw")
    zero = {c: F.coalesce(number_of(df, c) if c in df.columns else F.lit(None).cast("double"), F.lit(0.0)) for c in ("depth_pct", "length_mm", "width_mm")}
    out = df.withColumn("chainage", number_of(df, "chainage")).where("chainage IS NOT NULL")
    return out.select(
        _col(df, "line_id").alias("line_id"), F.trim(F.coalesce(_col(df, "source"), F.lit(""))).alias("source"), _col(df, "feature_id").alias("feature_id"),
        F.trim(F.coalesce(_col(df, "feature_type"), F.lit(""))).alias("feature_type"), _col(df, "feature_desc").alias("feature_desc"), "chainage",
        *(zero[c].alias(c) for c in zero), raw.alias("orientation_raw"), F.coalesce(clock_to_hours(raw), F.lit(DEFAULT_HOURS)).alias("orientation_hours"), clock_to_degrees(raw).alias("orientation_deg"),
        clock_to_hours(_col(df, "seam_raw")).alias("seam_hours"), number.alias("gwd_number"), label.alias("gwd_label"),
        hover_text(("Feature ID", _col(df, "feature_id")), ("Type", _col(df, "feature_type")), ("Description", _col(df, "feature_desc")), ("Depth", _col(df, "depth_pct")), ("Length (mm)", _col(df, "length_mm")), ("Width (mm)", _col(df, "width_mm")), ("Orientation", raw), ("Source", _col(df, "source")), ("Chainage (m)", F.col("chainage"))).alias("hover_text"),
    )


def girth_welds(features: DataFrame) -> DataFrame:
    label = F.when(F.col("gwd_label").isNotNull(), F.concat(F.lit("GWD "), F.col("gwd_label"))).otherwise("")
    return features.where(is_map_weld(F.col("feature_type"))).select("line_id", "source", "gwd_number", "chainage", label.alias("label"), "seam_hours")


def seam_spans(girth: DataFrame) -> DataFrame:
    """Each weld's span ends at the next weld of its line; the last has no end. Only weld rows are sorted."""
    return scan(girth, ["line_id"], ["chainage", "gwd_number", "source"], {"chainage_end": lead("chainage")}).withColumnRenamed("chainage", "chainage_start")


def seam_welds(features: DataFrame) -> DataFrame:
    """Spans of girth welds that name a seam position, and rows of type seam, which have no ends."""
    spans = seam_spans(girth_welds(features)).where("seam_hours IS NOT NULL").select("line_id", "source", "gwd_number", "chainage_start", "chainage_end", F.col("seam_hours").alias("orientation_hours"))
    kind = F.lower("feature_type")
    own = features.where(kind.contains("seam") & ~is_map_weld(kind)).select("line_id", "source", "gwd_number", F.lit(None).cast("double").alias("chainage_start"), F.lit(None).cast("double").alias("chainage_end"), "orientation_hours")
    return spans.unionByName(own).withColumn("orientation_label", hours_to_clock(F.col("orientation_hours")))


def feature_map_tally(df: DataFrame) -> DataFrame:
    """Pipe joints of a tally as features."""
    us, ds, own = (number_of(df, c) if c in df.columns else F.lit(None).cast("double") for c in ("us_chainage", "ds_chainage", "joint_length_m"))
    length = F.coalesce(F.abs(ds - us), own)
    number, label = gwd_parts(_col(df, "joint_number"))
    seam = clock_to_hours(_col(df, "seam_raw"))
    mm = F.when(F.coalesce(length, F.lit(0.0)) != 0, length * 1000.0).otherwise(0.001)
    center = F.coalesce((us + ds) / 2.0, us + F.coalesce(length, F.lit(0.0)) / 2.0)
    out = df.select(
        _col(df, "line_id").alias("line_id"), F.trim(F.coalesce(_col(df, "source"), F.lit(""))).alias("source"), F.coalesce(_col(df, "feature_id"), label).alias("feature_id"), F.lit("Pipe Joint").alias("feature_type"),
        center.alias("chainage"), us.alias("us_chainage"), ds.alias("ds_chainage"), length.alias("joint_length_m"), F.lit(0.0).alias("depth_pct"), mm.alias("length_mm"), F.lit(0.001).alias("width_mm"),
        F.coalesce(seam, F.lit(DEFAULT_HOURS)).alias("orientation_hours"), seam.alias("seam_hours"), number.alias("gwd_number"), label.alias("gwd_label"),
        F.coalesce(to_number(_col(df, "wall_thickness")), F.lit(0.0)).alias("wall_thickness"), F.trim(F.coalesce(_col(df, "pipe_grade"), F.lit(""))).alias("pipe_grade"),
        hover_text(("GWD", label), ("US Chainage (m)", F.format_string("%.3f", us)), ("DS Chainage (m)", F.when(ds.isNotNull(), F.format_string("%.3f", ds))), ("Joint Length (m)", F.when(length.isNotNull(), F.format_string("%.3f", length))), ("Seam Orientation", _col(df, "seam_raw"))).alias("hover_text"),
    )
    return out.where("us_chainage IS NOT NULL")


def tally_girths(joints: DataFrame, order: Sequence[str] = ("gwd_number", "source")) -> DataFrame:
    """One girth weld for each upstream chainage (3 decimals) of a line, and the downstream end of its last row in
    input order, if new. ``order`` stands for the input order."""
    key = F.bround(F.col("us_chainage"), 3)
    by = W.partitionBy("line_id", key).orderBy("us_chainage", *order)
    first = joints.withColumn("__n", F.row_number().over(by)).where("__n = 1")
    label = F.coalesce(F.concat(F.lit("GWD "), F.col("gwd_label")), F.format_string("%.3f m", F.col("us_chainage")))
    welds = first.select("line_id", "source", "gwd_number", F.col("us_chainage").alias("chainage"), label.alias("label"))
    last = joints.groupBy("line_id").agg(F.max_by("ds_chainage", F.struct(*order)).alias("chainage")).where("chainage IS NOT NULL")
    ends = last.withColumn("k", F.bround("chainage", 3)).join(welds.select("line_id", F.bround("chainage", 3).alias("k")), ["line_id", "k"], "left_anti")
    return welds.unionByName(ends.select("line_id", F.lit("").alias("source"), F.lit(None).cast("bigint").alias("gwd_number"), "chainage", F.lit("DS end").alias("label")))


def tally_seams(joints: DataFrame) -> DataFrame:
    end = F.coalesce("ds_chainage", F.col("us_chainage") + F.col("length_mm") / 1000.0)
    return joints.where("seam_hours IS NOT NULL").select("line_id", "source", "gwd_number", F.col("us_chainage").alias("chainage_start"), end.alias("chainage_end"), F.col("seam_hours").alias("orientation_hours"), hours_to_clock(F.col("seam_hours")).alias("orientation_label"))


#: Data format -> builder; a new format is a new entry.
BUILDERS: dict[str, Callable[[DataFrame], DataFrame]] = {"anomaly": feature_map_anomaly, "pipe_tally": feature_map_tally}


def feature_map(df: DataFrame, data_format: str) -> DataFrame:
    """By format; an unknown one is taken for an anomaly listing."""
    return df.transform(BUILDERS.get(data_format, feature_map_anomaly))


def chainage_window(df: DataFrame, lo: float | None, hi: float | None, data_format: str = "anomaly") -> DataFrame:
    """Rows inside the bounds; joints of a tally that overlap them. A missing bound is open."""
    start, end = (F.col("us_chainage"), F.coalesce("ds_chainage", "us_chainage")) if data_format == "pipe_tally" else (F.col("chainage"),) * 2
    keep = start.isNotNull()
    if lo is not None:
        keep &= end >= lo
    if hi is not None:
        keep &= start <= hi
    return df.where(keep)


def feature_window(features: DataFrame, girth: DataFrame, seam: DataFrame, lo: float, hi: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same bounds on a built map; seams must lie inside, unbounded ones stay."""
    inside = F.col("chainage").between(lo, hi)
    open_seam = F.col("chainage_start").isNull() | F.col("chainage_end").isNull()
    return features.where(inside), girth.where(inside), seam.where(open_seam | ((F.col("chainage_start") >= lo) & (F.col("chainage_end") <= hi)))


def source_filter(df: DataFrame, sources: Sequence[str], structural: Column | None = None) -> DataFrame:
    """Rows of those sources, either name containing the other; no sources keeps all, structural rows always stay."""
    if not sources:
        return df
    names = F.array(*map(F.lit, sources))
    own = F.coalesce(F.col("source"), F.lit(""))
    keep = F.exists(names, lambda s: own.contains(s) | s.contains(own))
    return df.where(keep | structural if structural is not None else keep)


def defects_only(features: DataFrame) -> DataFrame:
    return features.where(is_defect(F.col("feature_type")))


def weld_numbers(df: DataFrame) -> DataFrame:
    """Distinct whole girth-weld numbers with a numeric chainage. Reads two columns."""
    number, _ = gwd_parts(F.col("gwd_number"))
    return df.where(number_of(df, "chainage").isNotNull() & number.isNotNull()).select("line_id", number.alias("gwd_number")).distinct()


def weld_anchors(df: DataFrame) -> DataFrame:
    """The lowest chainage of each girth-weld number of a line."""
    number, _ = gwd_parts(F.col("gwd_number"))
    x = number_of(df, "chainage")
    return df.where(x.isNotNull() & number.isNotNull()).groupBy("line_id", number.alias("gwd_number")).agg(F.min(x).alias("chainage"))


def weld_bounds(anchors: DataFrame, asked: DataFrame, n: int = 2) -> DataFrame:
    """Chainage bounds for rows ``(line_id, center, start, end)``: with a centre, n anchors on each side, clamped; else
    from the start to the end weld, a missing one standing for the line's end; an unknown centre gives none. One ordered
    scan of the anchors finds the bounds of every centre; rows asked for join it by their number."""
    ends = anchors.groupBy("line_id").agg(F.min("chainage").alias("lo"), F.max("chainage").alias("hi"))
    placed = scan(anchors.select("line_id", "gwd_number", "chainage"), ["line_id"], ["chainage", "gwd_number"], {"x_lo": lag("chainage", n), "x_hi": lead("chainage", n), "lo": key_least("chainage"), "hi": key_greatest("chainage")})
    hit = placed.withColumnsRenamed({"gwd_number": "center"}).select("line_id", "center", F.coalesce("x_lo", "lo").alias("x_lo"), F.coalesce("x_hi", "hi").alias("x_hi"))
    centered = asked.where("center IS NOT NULL").join(hit, ["line_id", "center"], "left").select(*asked.columns, F.col("x_lo").alias("lo"), F.col("x_hi").alias("hi"))
    x = anchors.select("line_id", "gwd_number", "chainage")
    spans = asked.where("center IS NULL").join(ends, "line_id", "left")
    spans = spans.join(x.withColumnsRenamed({"gwd_number": "start", "chainage": "x_start"}), ["line_id", "start"], "left").join(x.withColumnsRenamed({"gwd_number": "end", "chainage": "x_end"}), ["line_id", "end"], "left")
    a, b = F.coalesce("x_start", "lo"), F.coalesce("x_end", "hi")
    return centered.unionByName(spans.select(*asked.columns, F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))


def center_context(girth: DataFrame, center: DataFrame, n: int = 2) -> DataFrame:
    """For each ``(line_id, center)`` and source: the centre weld and the window-edge welds up- and downstream."""
    own = girth.where("gwd_number IS NOT NULL").select("line_id", "source", "gwd_number", "chainage").withColumns({"w": F.struct("gwd_number", "chainage"), "at": F.struct("chainage", "gwd_number")})
    r = scan(own, ["line_id", "source"], ["chainage", "gwd_number"], {"idx": row_number(), "up": lag("w", n), "down": lead("w", n), "first": key_least("at"), "last": key_greatest("at")})
    met = r.join(center.withColumnRenamed("center", "gwd_number").hint("merge"), ["line_id", "gwd_number"]).groupBy("line_id", "source", "gwd_number").agg(F.min_by(F.struct("up", "w", "down", "first", "last"), "idx").alias("s"))
    three = {"upstream": F.coalesce("s.up", F.struct("s.first.gwd_number", "s.first.chainage")), "target": F.col("s.w"), "downstream": F.coalesce("s.down", F.struct("s.last.gwd_number", "s.last.chainage"))}
    roles = F.inline(F.array(*(F.struct(F.lit(k).alias("role"), w.gwd_number.alias("gwd_number"), w.chainage.alias("chainage")) for k, w in three.items())))
    return met.withColumnRenamed("gwd_number", "center").select("line_id", "source", "center", roles)


def feature_boxes(features: DataFrame, nominal_size: int = 10) -> DataFrame:
    """Rectangles in chainage (m) and clock hours."""
    around = 3.14159 * OUTSIDE_DIAMETER[nominal_size]
    length, width = (F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.001)) for c in ("length_mm", "width_mm"))
    half_x, half_y = length / 1000.0 / 2.0, width / around * 12.0 / 2.0
    return features.withColumns({"x0": F.col("chainage") - half_x, "x1": F.col("chainage") + half_x, "y0": F.col("orientation_hours") - half_y, "y1": F.col("orientation_hours") + half_y})


def axis_extent(boxes: DataFrame, by: str = "line_id") -> DataFrame:
    ends = boxes.groupBy(by).agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    pad = F.greatest(F.greatest(F.col("hi") - F.col("lo"), F.lit(0.5)) * 0.05, F.lit(0.3))
    return ends.select(by, (F.col("lo") - pad).alias("axis_lo"), (F.col("hi") + pad).alias("axis_hi"))


def depth_raster(defects: DataFrame, lo: float, hi: float, nominal_size: int = 10, n_x: int = 300, n_theta: int = 120) -> DataFrame:
    """The deepest defect over each cell of a grid on the pipe surface between two chainages; uncovered cells are left
    out. Each defect yields just the cells that it covers, round the pipe if need be."""
    around, span = 3.14159 * OUTSIDE_DIAMETER[nominal_size] / 1000.0, max(hi - lo, 1.0)
    dx, turn = (hi - lo) / (n_x - 1), 2 * math.pi
    half = F.greatest(F.col("length_mm") / 1000.0, F.lit(span * 0.012)) / 2.0
    half_bins = F.greatest(F.col("width_mm") / 1000.0, F.lit(around * 0.05)) / around * math.pi / (turn / n_theta)
    at_bin = F.col("orientation_hours") / 12.0 * n_theta
    first, last = F.ceil(at_bin - half_bins), F.floor(at_bin + half_bins)
    x0, x1 = F.greatest(F.ceil((F.col("chainage") - half - lo) / dx), F.lit(0)), F.least(F.floor((F.col("chainage") + half - lo) / dx), F.lit(n_x - 1))
    seen = defects.where(F.col("chainage").between(lo - 0.1, hi + 0.1) & (F.col("depth_pct") > 0))
    seen = seen.select("line_id", "depth_pct", x0.alias("x0"), x1.alias("x1"), first.alias("t0"), F.least(last, first + n_theta - 1).alias("t1")).where("x0 <= x1 AND t0 <= t1")
    cells = seen.withColumn("bin_x", F.explode(F.sequence("x0", "x1"))).withColumn("t", F.explode(F.sequence("t0", "t1")))
    return cells.groupBy("line_id", F.col("bin_x").cast("int").alias("bin_x"), F.pmod("t", F.lit(n_theta)).cast("int").alias("bin_theta")).agg(F.max("depth_pct").alias("depth_pct"))


def intervals(lo: Column, hi: Column, bits: int) -> Column:
    """A range of cells as at most two blocks of each power of two, ``(k, b)`` for cells from b * 2**k on."""
    blocks = []
    for k in range(bits + 1):
        size = 1 << k
        first, end = F.ceil(lo / size).cast("int"), F.floor((hi + 1) / size).cast("int")
        some = first < end
        blocks += [F.when(some & (first % 2 == 1), F.struct(F.lit(k).alias("k"), first.alias("b"))), F.when(some & (end % 2 == 1), F.struct(F.lit(k).alias("k"), (end - 1).alias("b")))]
    return F.filter(F.array(*blocks), lambda x: x.isNotNull())


#: Places of defects that a task spreads over cells.
PLACES = 50_000


def tiled_raster(defects: DataFrame, span: float, nominal_size: int = 10, n_x: int = 300, n_theta: int = 120) -> DataFrame:
    """The raster of the whole line in tiles of ``span`` metres: ``(line_id, tile, bin_x, bin_theta, depth_pct)``, each tile as ``depth_raster``
    from ``tile * span`` on. A defect isn't spread over its cells: its sides are cut into blocks of powers of two, of which there are
    few however wide it is; the deepest of each block is kept before blocks meet cells, so a tile has no more than its own blocks.
    Only the distinct places of defects are shuffled, to the task of their tile; blocks and cells stay there."""
    around = 3.14159 * OUTSIDE_DIAMETER[nominal_size] / 1000.0
    dx, turn = span / (n_x - 1), 2 * math.pi
    own = defects.where(F.col("depth_pct") > 0)
    near = F.sequence(F.floor((F.col("chainage") - 0.1) / span), F.floor((F.col("chainage") + 0.1) / span))
    own = own.withColumn("tile", F.explode(near)).withColumn("lo", F.col("tile") * span).where(F.col("chainage").between(F.col("lo") - 0.1, F.col("lo") + span + 0.1))
    half = F.greatest(F.col("length_mm") / 1000.0, F.lit(max(span, 1.0) * 0.012)) / 2.0
    half_bins = F.greatest(F.col("width_mm") / 1000.0, F.lit(around * 0.05)) / around * math.pi / (turn / n_theta)
    at_bin = F.col("orientation_hours") / 12.0 * n_theta
    x0, x1 = F.greatest(F.ceil((F.col("chainage") - half - F.col("lo")) / dx), F.lit(0)), F.least(F.floor((F.col("chainage") + half - F.col("lo")) / dx), F.lit(n_x - 1))
    first = F.ceil(at_bin - half_bins)
    own = own.select("line_id", "tile", "depth_pct", x0.alias("x0"), x1.alias("x1"), first.alias("t0"), F.least(F.floor(at_bin + half_bins), first + n_theta - 1).alias("t1")).where("x0 <= x1 AND t0 <= t1")
    places = kept(own.groupBy("line_id", "tile", "x0", "x1", "t0", "t1").agg(F.max("depth_pct").alias("depth_pct")), "places")
    own = places.repartition(places.count() // PLACES + 1, "line_id", "tile")
    from_t, wide = F.pmod("t0", F.lit(n_theta)), F.col("t1") - F.col("t0")
    over = from_t + wide - n_theta
    parts = F.filter(F.array(F.struct(from_t.alias("t0"), F.least(from_t + wide, F.lit(n_theta - 1)).alias("t1")), F.struct(F.lit(0).cast("bigint").alias("t0"), over.alias("t1"))), lambda p: p.t0 <= p.t1)
    own = own.withColumn("p", F.explode(parts)).select("line_id", "tile", "depth_pct", F.explode(intervals(F.col("x0"), F.col("x1"), (n_x - 1).bit_length())).alias("x"), "p")
    own = own.select("line_id", "tile", "depth_pct", "x", F.explode(intervals(F.col("p.t0"), F.col("p.t1"), (n_theta - 1).bit_length())).alias("t"))
    blocks = own.groupBy("line_id", "tile", "x", "t").agg(F.max("depth_pct").alias("depth_pct"))
    cells = lambda b: F.sequence(b.b * F.pow(F.lit(2), b.k).cast("int"), (b.b + 1) * F.pow(F.lit(2), b.k).cast("int") - 1)
    each = blocks.withColumn("bin_x", F.explode(cells(F.col("x")))).withColumn("bin_theta", F.explode(cells(F.col("t"))))
    return each.groupBy("line_id", "tile", "bin_x", "bin_theta").agg(F.max("depth_pct").alias("depth_pct"))


def nde_region(start: Column, end: Column) -> tuple[Column, Column]:
    both = start.isNotNull() & end.isNotNull()
    return F.when(both, F.least(start, end)), F.when(both, F.greatest(start, end))


def context_text(target: Column, upstream: Column, downstream: Column, joint_source: Column) -> Column:
    """``Source: U/S GWD a @ 03:00 | Target … | D/S …`` of structs (gwd_number, seam_label)."""

    def one(label: str, s: Column) -> Column:
        return F.when(s.gwd_number.isNotNull(), F.concat(F.lit(f"{label} GWD "), s.gwd_number.cast("string"), F.coalesce(F.concat(F.lit(" @ "), s.seam_label), F.lit(""))))

    joined = F.concat_ws(" | ", one("U/S", upstream), one("Target", target), one("D/S", downstream))
    return F.when((joined != "") & joint_source.isNotNull(), F.concat(joint_source, F.lit(": "), joined)).otherwise(joined)
