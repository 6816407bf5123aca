"""Feature maps, welds, windows and views over the feature and tally views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import featuremap as M
from ..operators.quality import distinct_sorted
from ..sources.fixtures import view
from .registry import query

ILI, TALLY = ("ili_features",), ("pipe_tally",)
HOURS = "(cast(split_part({c}, ':', 1) AS double) + cast(split_part({c}, ':', 2) AS double) / 60.0e0)"
CLOCK = "lpad(cast(cast(floor({h}) AS bigint) + CASE WHEN round_even(({h} - floor({h})) * 60.0e0, 0) >= 60 THEN 1 ELSE 0 END AS varchar), 2, '0') || ':' || lpad(cast(cast(round_even(({h} - floor({h})) * 60.0e0, 0) AS bigint) - CASE WHEN round_even(({h} - floor({h})) * 60.0e0, 0) >= 60 THEN 60 ELSE 0 END AS varchar), 2, '0')"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.feature_map(view(spark, sf_dir, "ili_features"), "anomaly")


def joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.feature_map(view(spark, sf_dir, "pipe_tally"), "pipe_tally")


@query(f"SELECT line_id, source, feature_id, feature_type, chainage, depth_pct, length_mm, width_mm, round({HOURS.format(c='orientation_raw')}, 6) AS orientation_hours, round({HOURS.format(c='orientation_raw')} / 12.0e0 * 360.0e0, 6) AS orientation_deg, gwd_number, cast(gwd_number AS varchar) AS gwd_label FROM ili_features WHERE chainage IS NOT NULL", ILI)
def feature_map_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return f.select("line_id", "source", "feature_id", "feature_type", "chainage", "depth_pct", "length_mm", "width_mm", F.round("orientation_hours", 6).alias("orientation_hours"), F.round("orientation_deg", 6).alias("orientation_deg"), "gwd_number", "gwd_label")


@query("SELECT line_id, source, gwd_number, chainage, 'GWD ' || cast(gwd_number AS varchar) AS label FROM ili_features WHERE feature_type = 'Girth Weld'", ILI)
def girth_welds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.girth_welds(features(spark, sf_dir)).drop("seam_hours")


@query("SELECT line_id, source, gwd_number, chainage AS chainage_start, lead(chainage) OVER (PARTITION BY line_id ORDER BY chainage, gwd_number, source) AS chainage_end FROM ili_features WHERE feature_type = 'Girth Weld'", ILI)
def seam_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.seam_spans(M.girth_welds(features(spark, sf_dir))).select("line_id", "source", "gwd_number", "chainage_start", "chainage_end")


@query(f"SELECT line_id, source, gwd_number, round({HOURS.format(c='orientation_raw')}, 6) AS orientation_hours, {CLOCK.format(h=HOURS.format(c='orientation_raw'))} AS orientation_label FROM ili_features WHERE feature_type = 'Seam Weld'", ILI)
def seam_welds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.seam_welds(features(spark, sf_dir)).select("line_id", "source", "gwd_number", F.round("orientation_hours", 6).alias("orientation_hours"), "orientation_label")


_TALLY_LENGTH = "coalesce(abs(ds_chainage - us_chainage), joint_length_m)"


@query(f"SELECT line_id, 'Pipe Joint' AS feature_type, coalesce((us_chainage + ds_chainage) / 2.0e0, us_chainage + joint_length_m / 2.0e0) AS chainage, us_chainage, ds_chainage, {_TALLY_LENGTH} AS joint_length_m, {_TALLY_LENGTH} * 1000.0e0 AS length_mm, round({HOURS.format(c='seam_raw')}, 6) AS seam_hours, joint_number AS gwd_number, coalesce(pipe_grade, '') AS pipe_grade FROM pipe_tally", TALLY)
def feature_map_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joints(spark, sf_dir).select("line_id", "feature_type", "chainage", "us_chainage", "ds_chainage", "joint_length_m", "length_mm", F.round("seam_hours", 6).alias("seam_hours"), "gwd_number", "pipe_grade")


@query("""SELECT line_id, gwd_number, chainage, label FROM (SELECT line_id, joint_number AS gwd_number, us_chainage AS chainage, 'GWD ' || cast(joint_number AS varchar) AS label, row_number() OVER (PARTITION BY line_id, round(us_chainage, 3) ORDER BY joint_number) AS n FROM pipe_tally) WHERE n = 1
 UNION ALL SELECT line_id, NULL, chainage, 'DS end' FROM (SELECT line_id, max_by(ds_chainage, joint_number) AS chainage, max(joint_number) AS top FROM pipe_tally WHERE true GROUP BY line_id) l WHERE chainage IS NOT NULL AND (SELECT t.ds_chainage FROM pipe_tally t WHERE t.line_id = l.line_id AND t.joint_number = l.top) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pipe_tally p WHERE p.line_id = l.line_id AND round(p.us_chainage, 3) = round(l.chainage, 3))""", TALLY)
def tally_girths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tally_girths(joints(spark, sf_dir), ["gwd_number"]).select("line_id", "gwd_number", "chainage", "label")


@query(f"SELECT line_id, joint_number AS gwd_number, us_chainage AS chainage_start, coalesce(ds_chainage, us_chainage + joint_length_m * 1000.0e0 / 1000.0e0) AS chainage_end, {CLOCK.format(h=HOURS.format(c='seam_raw'))} AS orientation_label FROM pipe_tally", TALLY)
def tally_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tally_seams(joints(spark, sf_dir)).select("line_id", "gwd_number", "chainage_start", "chainage_end", "orientation_label")


LO, HI = 1200.0, 9000.0


@query(f"SELECT line_id, feature_id, chainage FROM ili_features WHERE chainage BETWEEN {LO} AND {HI}", ILI)
def chainage_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chainage_window(features(spark, sf_dir), LO, HI).select("line_id", "feature_id", "chainage")


@query(f"SELECT line_id, joint_number AS gwd_number, us_chainage FROM pipe_tally WHERE coalesce(ds_chainage, us_chainage) >= {LO} AND us_chainage <= {HI}", TALLY)
def chainage_window_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chainage_window(joints(spark, sf_dir), LO, HI, "pipe_tally").select("line_id", "gwd_number", "us_chainage")


@query(f"SELECT kind, count(*) AS n FROM (SELECT 'features' AS kind FROM ili_features WHERE chainage BETWEEN {LO} AND {HI} UNION ALL SELECT 'girth' FROM ili_features WHERE feature_type = 'Girth Weld' AND chainage BETWEEN {LO} AND {HI} UNION ALL SELECT 'seam' FROM ili_features WHERE feature_type = 'Seam Weld') GROUP BY kind", ILI)
def feature_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    parts = M.feature_window(f, M.girth_welds(f), M.seam_welds(f), LO, HI)
    named = [p.groupBy().agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, p in zip(("features", "girth", "seam"), parts, strict=True)]
    return named[0].union(named[1]).union(named[2])


@query("SELECT source, feature_type, count(*) AS n FROM ili_features WHERE contains(source, 'RunB') OR contains('RunB', source) OR feature_type = 'Girth Weld' GROUP BY source, feature_type", ILI)
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.source_filter(features(spark, sf_dir), ["RunB"], S.is_map_weld(F.col("feature_type")))
    return out.groupBy("source", "feature_type").agg(F.count("*").alias("n"))


@query("SELECT line_id, count(*) AS n, round(max(depth_pct), 6) AS deepest FROM ili_features WHERE feature_type NOT IN ('Girth Weld', 'Seam Weld') GROUP BY line_id", ILI)
def defects_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.defects_only(features(spark, sf_dir)).groupBy("line_id").agg(F.count("*").alias("n"), F.round(F.max("depth_pct"), 6).alias("deepest"))


@query("SELECT DISTINCT line_id, gwd_number FROM ili_features WHERE chainage IS NOT NULL AND gwd_number IS NOT NULL", ILI)
def weld_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.weld_numbers(view(spark, sf_dir, "ili_features"))


@query("SELECT line_id, gwd_number, min(chainage) AS chainage FROM ili_features GROUP BY line_id, gwd_number", ILI)
def weld_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.weld_anchors(view(spark, sf_dir, "ili_features"))


_ANCHORS = ", r AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY chainage, gwd_number) AS idx, count(*) OVER (PARTITION BY line_id) AS n, min(chainage) OVER (PARTITION BY line_id) AS lowest FROM (SELECT line_id, gwd_number, min(chainage) AS chainage FROM ili_features GROUP BY line_id, gwd_number))"


@query(f"{_ANCHORS} SELECT a.line_id, a.gwd_number AS center, x.chainage AS lo, y.chainage AS hi FROM r a JOIN r x ON x.line_id = a.line_id AND x.idx = greatest(a.idx - 2, 1) JOIN r y ON y.line_id = a.line_id AND y.idx = least(a.idx + 2, a.n)", ILI)
def weld_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds around every weld number."""
    anchors = M.weld_anchors(view(spark, sf_dir, "ili_features"))
    asked = anchors.select("line_id", F.col("gwd_number").alias("center"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"))
    return M.weld_bounds(anchors, asked).select("line_id", "center", "lo", "hi")


@query(f"{_ANCHORS} SELECT a.line_id, CASE WHEN a.idx % 2 = 0 THEN a.gwd_number END AS first, z.gwd_number AS last, CASE WHEN a.idx % 2 = 0 THEN least(a.chainage, z.chainage) ELSE a.lowest END AS lo, CASE WHEN a.idx % 2 = 0 THEN greatest(a.chainage, z.chainage) ELSE z.chainage END AS hi FROM r a JOIN r z ON z.line_id = a.line_id AND z.idx = a.n + 1 - a.idx", ILI)
def weld_bounds_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every weld to its mirror image on the line; every other one without a start, which is the line's own."""
    anchors = M.weld_anchors(view(spark, sf_dir, "ili_features"))
    by = W.partitionBy("line_id")
    idx = F.row_number().over(by.orderBy("chainage", "gwd_number"))
    r = anchors.withColumns({"idx": idx, "far": F.count("*").over(by) + 1 - idx})
    ends = r.select("line_id", F.col("idx").alias("far"), F.col("gwd_number").alias("end"))
    asked = r.join(ends, ["line_id", "far"]).select("line_id", F.lit(None).cast("bigint").alias("center"), F.when(F.col("idx") % 2 == 0, F.col("gwd_number")).alias("start"), "end")
    return M.weld_bounds(anchors, asked).select("line_id", F.col("start").alias("first"), F.col("end").alias("last"), "lo", "hi")


@query(""", r AS (SELECT line_id, source, gwd_number, chainage, row_number() OVER (PARTITION BY line_id, source ORDER BY chainage, gwd_number) AS idx, count(*) OVER (PARTITION BY line_id, source) AS n FROM ili_features WHERE feature_type = 'Girth Weld'),
h AS (SELECT line_id, source, gwd_number, min(idx) AS idx, max(n) AS n FROM r GROUP BY line_id, source, gwd_number)
SELECT h.line_id, h.source, h.gwd_number AS center, role, x.gwd_number, x.chainage FROM h, (VALUES ('upstream', -2), ('target', 0), ('downstream', 2)) AS t(role, k) JOIN r x ON x.line_id = h.line_id AND x.source = h.source AND x.idx = least(greatest(h.idx + k, 1), h.n)""", ILI)
def center_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every weld as a centre: itself and the welds at the edges of its window, in every run."""
    g = M.girth_welds(features(spark, sf_dir))
    center = g.select("line_id", F.col("gwd_number").alias("center")).distinct()
    return M.center_context(g, center).select("line_id", "source", "center", "role", "gwd_number", "chainage")


_AROUND = 3.14159 * 273.0


@query(f"SELECT feature_id, chainage, round(chainage - greatest(length_mm, 0.001e0) / 1000.0e0 / 2.0e0, 9) AS x0, round(chainage + greatest(length_mm, 0.001e0) / 1000.0e0 / 2.0e0, 9) AS x1, round({HOURS.format(c='orientation_raw')} + greatest(width_mm, 0.001e0) / {_AROUND!r}e0 * 12.0e0 / 2.0e0, 9) AS y1, CASE WHEN depth_pct < 20 THEN 'green' WHEN depth_pct < 40 THEN 'yellow' WHEN depth_pct < 60 THEN 'orange' ELSE 'red' END AS band FROM ili_features WHERE feature_type = 'Metal Loss'", ILI)
def feature_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = M.feature_boxes(M.defects_only(features(spark, sf_dir)), 10)
    return b.select("feature_id", "chainage", *(F.round(c, 9).alias(c) for c in ("x0", "x1", "y1")), S.depth_band(F.col("depth_pct")).alias("band"))


@query("SELECT line_id, round(lo - greatest(greatest(hi - lo, 0.5e0) * 0.05e0, 0.3e0), 6) AS axis_lo, round(hi + greatest(greatest(hi - lo, 0.5e0) * 0.05e0, 0.3e0), 6) AS axis_hi FROM (SELECT line_id, min(chainage - greatest(length_mm, 0.001e0) / 1000.0e0 / 2.0e0) AS lo, max(chainage + greatest(length_mm, 0.001e0) / 1000.0e0 / 2.0e0) AS hi FROM ili_features WHERE feature_type = 'Metal Loss' GROUP BY line_id)", ILI)
def axis_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.axis_extent(M.feature_boxes(M.defects_only(features(spark, sf_dir)), 10)).select("line_id", F.round("axis_lo", 6).alias("axis_lo"), F.round("axis_hi", 6).alias("axis_hi"))


RASTER = (1200.0, 2400.0)
_DX, _CIRC = (RASTER[1] - RASTER[0]) / 299, 3.14159 * 273.0 / 1000.0
_HALF = f"(greatest(length_mm / 1000.0e0, {(RASTER[1] - RASTER[0]) * 0.012!r}e0) / 2.0e0)"
_HALF_T = f"(greatest(width_mm / 1000.0e0, {_CIRC * 0.05!r}e0) / {_CIRC!r}e0 * pi() / (2 * pi() / 120))"


@query(f"""SELECT line_id, cast(bx AS integer) AS bin_x, cast(((t % 120) + 120) % 120 AS integer) AS bin_theta, max(depth_pct) AS depth_pct FROM (SELECT line_id, depth_pct, bx, unnest(range(t0, least(t1, t0 + 119) + 1)) AS t FROM (SELECT line_id, depth_pct, t0, t1, unnest(range(x0, x1 + 1)) AS bx FROM (SELECT line_id, depth_pct, greatest(cast(ceil((chainage - {_HALF} - {RASTER[0]}) / {_DX!r}e0) AS bigint), 0) AS x0, least(cast(floor((chainage + {_HALF} - {RASTER[0]}) / {_DX!r}e0) AS bigint), 299) AS x1, cast(ceil({HOURS.format(c='orientation_raw')} / 12.0e0 * 120 - {_HALF_T}) AS bigint) AS t0, cast(floor({HOURS.format(c='orientation_raw')} / 12.0e0 * 120 + {_HALF_T}) AS bigint) AS t1 FROM ili_features WHERE feature_type = 'Metal Loss' AND depth_pct > 0 AND chainage BETWEEN {RASTER[0] - 0.1} AND {RASTER[1] + 0.1}))) GROUP BY ALL""", ILI)
def depth_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.depth_raster(M.defects_only(features(spark, sf_dir)), *RASTER)


#: Metres of a tile; its cells' width.
SPAN = 36.0
_TDX, _THALF = repr(SPAN / 299), f"(greatest(length_mm / 1000.0e0, {SPAN * 0.012!r}e0) / 2.0e0)"


@query(f"""SELECT line_id, cast(tile AS bigint) AS tile, count(*) AS cells, round(max(depth_pct), 6) AS deepest, round(sum(depth_pct), 3) AS total, sum(bin_x * 120 + bin_theta)::BIGINT AS places FROM (
 SELECT line_id, tile, bx AS bin_x, ((t % 120) + 120) % 120 AS bin_theta, max(depth_pct) AS depth_pct FROM (SELECT line_id, tile, depth_pct, bx, unnest(range(t0, least(t1, t0 + 119) + 1)) AS t FROM (SELECT line_id, tile, depth_pct, t0, t1, unnest(range(x0, x1 + 1)) AS bx FROM (
 SELECT line_id, tile, depth_pct, greatest(cast(ceil((chainage - {_THALF} - tile * {SPAN}e0) / {_TDX}e0) AS bigint), 0) AS x0, least(cast(floor((chainage + {_THALF} - tile * {SPAN}e0) / {_TDX}e0) AS bigint), 299) AS x1, cast(ceil({HOURS.format(c='orientation_raw')} / 12.0e0 * 120 - {_HALF_T}) AS bigint) AS t0, cast(floor({HOURS.format(c='orientation_raw')} / 12.0e0 * 120 + {_HALF_T}) AS bigint) AS t1
 FROM (SELECT *, unnest(range(cast(floor((chainage - 0.1e0) / {SPAN}e0) AS bigint), cast(floor((chainage + 0.1e0) / {SPAN}e0) AS bigint) + 1)) AS tile FROM ili_features WHERE feature_type = 'Metal Loss' AND depth_pct > 0)))) GROUP BY 1, 2, 3, 4) GROUP BY line_id, tile""", ILI)
def tiled_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile of every line: its covered cells, and sums that name their places and depths."""
    r = M.tiled_raster(M.defects_only(features(spark, sf_dir)), SPAN)
    return r.groupBy("line_id", F.col("tile").cast("long").alias("tile")).agg(F.count("*").alias("cells"), F.round(F.max("depth_pct"), 6).alias("deepest"), F.round(F.sum("depth_pct"), 3).alias("total"), F.sum(F.col("bin_x").cast("long") * 120 + F.col("bin_theta")).alias("places"))


@query("SELECT DISTINCT source FROM ili_features", ILI)
def feature_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_sorted(features(spark, sf_dir), "source")


@query("SELECT feature_id, chainage, 'Feature ID: ' || feature_id || chr(10) || 'Type: ' || feature_type || chr(10) || 'Orientation: ' || orientation_raw AS hover FROM ili_features", ILI)
def hover_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = S.hover_text(("Feature ID", F.col("feature_id")), ("Type", F.col("feature_type")), ("Description", F.lit(None).cast("string")), ("Orientation", F.col("orientation_raw")))
    return view(spark, sf_dir, "ili_features").select("feature_id", "chainage", h.alias("hover"))
