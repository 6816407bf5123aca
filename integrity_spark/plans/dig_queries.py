"""Dig packages: the dig list against the inspection runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import digs as D
from ..operators import joints as J
from ..operators.quality import compare_dig_ids
from ..sources.fixtures import VIEWS, view
from ..sources.shared import kept
from .registry import query

BOTH = ("mdl", "ili_features")


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "mdl"), view(spark, sf_dir, "ili_features")


@query("SELECT m.dig_id, i.line_id, i.feature_id, i.source, i.chainage FROM mdl m JOIN ili_features i ON i.line_id = m.line_id AND i.feature_id = split_part(m.feature_ids, chr(10), 1) AND m.feature_ids <> 'missing'", BOTH)
def match_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.match_by_id(*inputs(spark, sf_dir)).select("dig_id", "line_id", "feature_id", "source", "chainage")


def _close(a: str, b: str) -> str:
    return f"(abs({a} - {b}) <= greatest(0.01e0, greatest(abs({a}), abs({b})) * 0.01e0) OR abs({a} / 25.4e0 - {b}) <= greatest(0.02e0, greatest(abs({b}), abs({a} / 25.4e0)) * 0.02e0) OR abs({a} * 25.4e0 - {b}) <= greatest(0.01e0, greatest(abs({b}), abs({a} * 25.4e0)) * 0.01e0))"


_NEAR = "abs(i.gwd_number - m.target_girth_weld) <= 2"


@query(f"SELECT DISTINCT m.dig_id, i.feature_id, i.chainage FROM mdl m JOIN ili_features i ON i.line_id = m.line_id AND {_NEAR} AND {_close('m.length_in', 'i.length_mm')} AND {_close('m.width_in', 'i.width_mm')}", BOTH)
def match_by_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features near each dig's weld number that agree with its length and width in some unit."""
    mdl, ili = inputs(spark, sf_dir)
    near = F.explode(F.sequence(F.col("target_girth_weld") - 2, F.col("target_girth_weld") + 2))
    met = D.match_by_dimensions(mdl.withColumn("gwd_number", near), ili, ("line_id", "gwd_number"))
    return met.select("dig_id", "feature_id", "chainage").distinct()


_FOUND = """SELECT d.dig_id, r.line_id, r.source, f.chainage AS target_chainage
 FROM (SELECT dig_id, line_id, min(target_girth_weld) AS t FROM mdl GROUP BY dig_id, line_id) d JOIN (SELECT DISTINCT line_id, source FROM ili_features) r ON r.line_id = d.line_id
 LEFT JOIN (SELECT line_id, source, gwd_number, min(chainage) AS chainage FROM ili_features GROUP BY line_id, source, gwd_number) f ON f.line_id = r.line_id AND f.source = r.source AND f.gwd_number = d.t"""


@query(_FOUND, BOTH)
def locate_target_weld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.locate_target_weld(*inputs(spark, sf_dir), ["chainage", "feature_id"])


_WELDS = "SELECT line_id, source, chainage AS x, row_number() OVER (PARTITION BY line_id, source ORDER BY chainage) AS idx, count(*) OVER (PARTITION BY line_id, source) AS n FROM ili_features WHERE feature_type IN ('Girth Weld', 'Seam Weld')"
_PLACES = "SELECT line_id, source, x, min(idx) AS idx, any_value(n) AS n FROM welds GROUP BY line_id, source, x"
_SIDES = " UNION ALL ".join(f"SELECT t.dig_id, t.line_id, t.source, t.target_chainage, w.idx, w.n, w.x FROM targets t ASOF JOIN places w ON w.line_id = t.line_id AND w.source = t.source AND t.target_chainage {side} w.x" for side in (">=", "<="))
_NEAREST = f"SELECT * EXCLUDE (x) FROM ({_SIDES}) QUALIFY row_number() OVER (PARTITION BY dig_id, line_id, source ORDER BY abs(x - target_chainage), idx) = 1"
_WINDOWS = f"""WITH ili_features AS ({VIEWS['ili_features']}), mdl AS ({VIEWS['mdl']}), targets AS ({_FOUND}), welds AS ({_WELDS}), places AS ({_PLACES}), near AS ({_NEAREST}),
 bounds AS (SELECT n.*, CASE WHEN n.idx > 1 THEN (SELECT x FROM welds w WHERE w.line_id = n.line_id AND w.source = n.source AND w.idx = greatest(n.idx - 3, 1)) ELSE target_chainage - 30 END - 0.5e0 AS lo, CASE WHEN n.idx < n.n THEN (SELECT x FROM welds w WHERE w.line_id = n.line_id AND w.source = n.source AND w.idx = least(n.idx + 3, n.n)) ELSE target_chainage + 30 END + 0.5e0 AS hi FROM near n)"""


@query(f"{_WINDOWS} SELECT dig_id, line_id, source, target_chainage, lo, hi FROM bounds", lean=True)
def weld_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three welds on each side of every target that was found."""
    mdl, ili = inputs(spark, sf_dir)
    found = D.found_targets(mdl, ili, ["chainage", "feature_id"])
    return D.weld_window(found, ili).select("dig_id", "line_id", "source", "target_chainage", "lo", "hi")


@query(f"{_WINDOWS} SELECT b.dig_id, b.line_id, b.source, i.feature_id, round(i.chainage - b.target_chainage, 6) AS distance_m FROM bounds b JOIN ili_features i ON i.line_id = b.line_id AND i.source = b.source AND i.chainage BETWEEN b.lo AND b.hi", lean=True)
def dig_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mdl, ili = inputs(spark, sf_dir)
    found = D.found_targets(mdl, ili, ["chainage", "feature_id"])
    rows = D.window_rows(kept(D.weld_window(found, ili), "windows"), ili, whole_runs=False)
    return rows.select("dig_id", "line_id", "source", "feature_id", F.round(F.col("x") - F.col("target_chainage"), 6).alias("distance_m"))


@query(f"{_WINDOWS}, runs AS (SELECT line_id, source, count(*) AS n FROM ili_features GROUP BY line_id, source) SELECT t.dig_id, t.line_id, t.source, t.target_chainage IS NOT NULL AS target_found, coalesce(t.target_chainage, 0) AS target_chainage, b.lo, b.hi, CASE WHEN t.target_chainage IS NULL THEN any_value(runs.n) ELSE count(i.chainage) END AS n_rows FROM targets t JOIN runs ON runs.line_id = t.line_id AND runs.source = t.source LEFT JOIN bounds b ON b.dig_id = t.dig_id AND b.line_id = t.line_id AND b.source = t.source LEFT JOIN ili_features i ON i.line_id = b.line_id AND i.source = b.source AND i.chainage BETWEEN b.lo AND b.hi GROUP BY t.dig_id, t.line_id, t.source, t.target_chainage, b.lo, b.hi")
def dig_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of digs and runs, with and without the target weld, with the number of rows that each stands for."""
    return D.dig_runs(*inputs(spark, sf_dir))


def package(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    mdl, ili = inputs(spark, sf_dir)
    return mdl, D.dig_feature_table(mdl, ili, fallback="skip")


@query("SELECT dig_id, count(*) AS mdl_rows, count(DISTINCT line_id) AS lines FROM mdl WHERE dig_id BETWEEN 1000 AND 999999 GROUP BY dig_id", ("mdl",))
def dig_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and lines of the dig ids of four to six digits."""
    return view(spark, sf_dir, "mdl").where(S.valid_dig_id(F.col("dig_id"))).groupBy("dig_id").agg(F.count("*").alias("mdl_rows"), F.countDistinct("line_id").alias("lines"))


@query("SELECT DISTINCT dig_id FROM mdl ORDER BY dig_id LIMIT 5", ("mdl",))
def first_digs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.first_digs(view(spark, sf_dir, "mdl"), 5)


_TABLE = f"""{_WINDOWS}, wr AS (SELECT b.dig_id, b.target_chainage, i.* FROM bounds b JOIN ili_features i ON i.line_id = b.line_id AND i.source = b.source AND i.chainage BETWEEN b.lo AND b.hi),
 m AS (SELECT *, row_number() OVER () AS u FROM mdl),
 hit AS (SELECT m.u, w.* FROM m JOIN wr w ON w.dig_id = m.dig_id AND m.feature_ids <> 'missing' AND w.feature_id = split_part(m.feature_ids, chr(10), 1)),
 dim AS (SELECT w.* FROM m JOIN wr w ON w.dig_id = m.dig_id AND {_close('m.length_in', 'w.length_mm')} AND {_close('m.width_in', 'w.width_mm')} WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.u = m.u AND h.source = w.source)),
 tgt AS (SELECT DISTINCT dig_id, line_id, source, feature_id, chainage FROM (SELECT dig_id, line_id, source, feature_id, chainage FROM hit UNION ALL SELECT dig_id, line_id, source, feature_id, chainage FROM dim)),
 pack AS (SELECT w.*, t.dig_id IS NOT NULL AS is_target FROM wr w LEFT JOIN tgt t ON t.dig_id = w.dig_id AND t.line_id = w.line_id AND t.source = w.source AND t.feature_id = w.feature_id AND t.chainage = w.chainage)"""


@query(f"{_TABLE} SELECT p.dig_id, d.dig_no, line_id, source, feature_id, chainage, is_target, round(chainage - target_chainage, 6) AS distance_m, depth_pct, length_mm, width_mm FROM pack p JOIN (SELECT dig_id, dense_rank() OVER (ORDER BY dig_id) AS dig_no FROM (SELECT DISTINCT dig_id FROM mdl)) d ON d.dig_id = p.dig_id", lean=True)
def dig_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole package table of the runs in which a dig's target weld is found."""
    _mdl, made = package(spark, sf_dir)
    return made.select("dig_id", F.col("dig_no").cast("long").alias("dig_no"), "line_id", "source", "feature_id", "chainage", "is_target", F.round("distance_m", 6).alias("distance_m"), "depth_pct", "length_mm", "width_mm")


@query(f"{_TABLE} SELECT d.dig_id, coalesce(runs, 0) AS runs, coalesce(n_rows, 0) AS n_rows, coalesce(targets, 0) AS targets, CASE WHEN n_rows IS NULL THEN 'no inspection rows' END AS skipped FROM (SELECT DISTINCT dig_id FROM mdl) d LEFT JOIN (SELECT dig_id, count(DISTINCT line_id || '/' || source) AS runs, count(*) AS n_rows, count(*) FILTER (WHERE is_target) AS targets FROM pack GROUP BY dig_id) p ON p.dig_id = d.dig_id", lean=True)
def dig_package_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    mdl, made = package(spark, sf_dir)
    return D.package_summary(mdl, made)


@query("SELECT dig_id, 'missing' AS side FROM mdl WHERE dig_id % 2 = 1 GROUP BY dig_id", ("mdl",))
def compare_digs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dig ids of the list against the even ones."""
    mdl = view(spark, sf_dir, "mdl")
    return compare_dig_ids(mdl, mdl.where("dig_id % 2 = 0"))


@query("SELECT dig_id, min(line_id) AS line_id, cast(dig_id AS varchar) AS file_name FROM mdl GROUP BY dig_id", ("mdl",))
def dig_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dig_header(view(spark, sf_dir, "mdl"), ["line_id"], ["line_id", "feature_ids"])


def seam_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seam hours by weld and source out of the tally: the program is a line."""
    t = view(spark, sf_dir, "pipe_tally")
    return t.select(F.col("line_id").alias("program_id"), F.col("joint_number").alias("gwd"), S.clock_to_hours(F.col("seam_raw")).alias("hours"))


_MATRIX = "SELECT line_id AS program_id, joint_number AS gwd, cast(split_part(seam_raw, ':', 1) AS double) + cast(split_part(seam_raw, ':', 2) AS double) / 60.0e0 AS hours FROM pipe_tally"


@query(f"SELECT g.line_id AS program_id, g.gwd, round(m.hours, 6) AS seam_hours FROM (SELECT DISTINCT line_id, gwd_number AS gwd FROM ili_features WHERE feature_type = 'Girth Weld') g LEFT JOIN ({_MATRIX}) m ON m.program_id = g.line_id AND abs(m.gwd - g.gwd) <= 15 QUALIFY row_number() OVER (PARTITION BY g.line_id, g.gwd ORDER BY abs(m.gwd - g.gwd), m.gwd) = 1", ("ili_features", "pipe_tally"))
def seam_for_weld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seam of each weld's own number, else of the nearest one in the tally."""
    g = view(spark, sf_dir, "ili_features").where("feature_type = 'Girth Weld'").select(F.col("line_id").alias("program_id"), F.col("gwd_number").alias("gwd")).distinct()
    return J.seam_for_weld(g, seam_matrix(spark, sf_dir), ("program_id",)).select("program_id", "gwd", F.round("seam_hours", 6).alias("seam_hours"))


@query("SELECT f.line_id, f.chainage, round(t.h, 6) AS seam_hours FROM (SELECT DISTINCT line_id, chainage FROM ili_features WHERE feature_type = 'Girth Weld') f LEFT JOIN (SELECT line_id, us_chainage AS x, min(cast(split_part(seam_raw, ':', 1) AS double) + cast(split_part(seam_raw, ':', 2) AS double) / 60.0e0) AS h FROM pipe_tally GROUP BY line_id, us_chainage) t ON t.line_id = f.line_id AND abs(t.x - f.chainage) < 2 QUALIFY row_number() OVER (PARTITION BY f.line_id, f.chainage ORDER BY abs(t.x - f.chainage), t.x) = 1", ("ili_features", "pipe_tally"))
def seam_by_chainage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "ili_features").where("feature_type = 'Girth Weld'").select("line_id", "chainage").distinct()
    t = view(spark, sf_dir, "pipe_tally").select("line_id", F.col("us_chainage").alias("chainage"), S.clock_to_hours(F.col("seam_raw")).alias("hours"))
    return J.seam_by_chainage(f, t).select("line_id", "chainage", F.round("seam_hours", 6).alias("seam_hours"))


@query("SELECT line_id AS program_id, joint_number AS gwd, round_even(avg(joint_length_m), 2) AS length_m FROM pipe_tally GROUP BY line_id, joint_number", ("pipe_tally",))
def joint_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "pipe_tally").select(F.col("line_id").alias("program_id"), F.col("joint_number").alias("gwd"), "joint_length_m")
    return J.joint_lengths(t.withColumnRenamed("joint_length_m", "length_m"))


@query("SELECT program_id, gwd, 12e0 * (k - t) AS chainage, 'GWD ' || cast(gwd AS varchar) || CASE WHEN k = t THEN ' (TGW)' ELSE '' END AS label FROM (SELECT *, (n - 1) // 2 + 1 AS t FROM (SELECT line_id AS program_id, joint_number AS gwd, row_number() OVER (PARTITION BY line_id ORDER BY joint_number) AS k, count(*) OVER (PARTITION BY line_id) AS n FROM pipe_tally)) WHERE k BETWEEN t - 1 AND t + 2 AND n >= 4", ("pipe_tally",))
def tgw_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four welds around the middle of each line's joints; checked by tests on small rows."""
    t = view(spark, sf_dir, "pipe_tally")
    order = t.select(F.col("line_id").alias("program_id"), F.col("joint_number").alias("gwd"), F.col("joint_number").alias("ord"), F.lit(False).alias("is_target"))
    lengths = t.select(F.col("line_id").alias("program_id"), F.col("joint_number").alias("gwd"), F.col("joint_length_m").alias("length_m"))
    girths, _seams = J.tgw_layout(order, J.joint_lengths(lengths), seam_matrix(spark, sf_dir).withColumn("source", F.lit("tally")))
    return girths


_CONTEXT = """, g AS (SELECT line_id, source, gwd_number AS gwd, chainage - 6000 AS x FROM ili_features WHERE feature_type = 'Girth Weld'),
z AS (SELECT line_id, source, arg_min(x, (abs(x), x)) AS t FROM g GROUP BY line_id, source),
near AS (SELECT g.line_id, g.source, CASE WHEN x < t THEN 'upstream' WHEN x > t THEN 'downstream' ELSE 'target' END AS role, gwd, x, t FROM g JOIN z USING (line_id, source) QUALIFY row_number() OVER (PARTITION BY g.line_id, g.source, role ORDER BY abs(x - t), gwd) = 1)"""


@query(f"{_CONTEXT} SELECT n.line_id AS program_id, n.source AS feature_source, role, n.gwd, x AS chainage, round(CASE WHEN abs(m.gwd - n.gwd) <= 15 THEN m.hours END, 6) AS seam_hours FROM near n LEFT JOIN ({_MATRIX}) m ON m.program_id = n.line_id AND abs(m.gwd - n.gwd) <= 15 QUALIFY row_number() OVER (PARTITION BY n.line_id, n.source, role ORDER BY abs(m.gwd - n.gwd), m.gwd) = 1", ("ili_features", "pipe_tally"))
def joint_context_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of joint_context, with rounded seams."""
    return joint_context(spark, sf_dir).select("program_id", "feature_source", "role", "gwd", "chainage", F.round("seam_hours", 6).alias("seam_hours"))


@query()
def joint_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, up- and downstream weld of each source of a line, with the tally's seam; checked by tests."""
    g = view(spark, sf_dir, "ili_features").where("feature_type = 'Girth Weld'").select(F.col("line_id").alias("program_id"), "source", F.col("gwd_number").alias("gwd"), (F.col("chainage") - 6000).alias("chainage"))
    matches = J.match_source_names(g.select("program_id", "source").distinct(), g.select("program_id").distinct().select("program_id", F.lit("2025 RunB").alias("source"), F.lit(0).alias("ord")))
    return J.joint_context(g, seam_matrix(spark, sf_dir).withColumn("source", F.lit("2025 RunB")), matches)
