"""Dig maps from the sheets of dig packages: sections, features, welds, seams and limits of all files in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clock_to_hours, collapsed, hours_to_clock, to_number
from ..sources.keywords import INSPECTION
from ..sources.shared import kept
from . import featuremap as M
from . import ingest as I
from . import joints as J
from .matrices import weld_number

# Titles of the sections; header names of the distance, best first; header names of joint rows.
FEATURE_SECTION = ("feature summary", "feature summary table", "ili feature summary")
JOINT_SECTION = ("joint summary", "joint summary table", "girth weld summary")
DISTANCES = ("Distance from TGW (m)", "Distance from TGW", "ILI Chainage (m)", "Chainage", "Odometer", "Log Dist.")
JOINT_ROWS = {
    "distance": ["Distance from TGW (m)", "Distance to Target", "Distance to target", "Distance from TGW"],
    "chainage": ["Chainage", "ILI Chainage (m)", "Odometer"],
    "seam": ["Long Seam Orientation for the Target", "Longseam Orientation for the Target", "Long Seam Orientation (hh:mm)", "Longseam Orientation", "Seam Orientation", "Longseam Orient", "Orientation (hh:mm)", "Orientation (clock)"],
    "gwd": ["GWD", "Joint", "Joint Number", "Joint No", "Girth Weld No"],
}


NEAR_LIMITS = f"row > limits_title AND row <= limits_title + {I.NDE_ROWS}"


def sheet_rows(cells: DataFrame) -> DataFrame:
    """Rows of both sections and below the title of the limits, with the rows where these stand in their sheet, written once."""
    marks = {"features": I.title_of(FEATURE_SECTION), "joints": I.title_of(JOINT_SECTION), "limits": I.nde_title()}
    rows = I.with_sections(I.filled_rows(cells, marks), ["features", "joints"])
    every = W.partitionBy(*I.SHEET).orderBy("row").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({"limits_title": F.min(F.when(F.col("limits"), F.col("row"))).over(every), "sheet_ord": F.min("sheet_ord").over(every)})
    used = [f"row = {m}_header OR row BETWEEN {m}_first AND {m}_last" for m in ("features", "joints")]
    return kept(rows.where(" OR ".join([*used, NEAR_LIMITS])).drop("n", "d", *marks), "dig-rows")


def section(rows: DataFrame, name: str) -> DataFrame:
    """Rows of each file's section, header in row 0 and data from row 1, from its first sheet that has one."""
    own = rows.where(f"{name}_first IS NOT NULL AND (row = {name}_header OR row BETWEEN {name}_first AND {name}_last)")
    first = own.where(f"row = {name}_header").groupBy("file").agg(F.min_by("sheet", "sheet_ord").alias("sheet"))
    row = F.when(F.col("row") == F.col(f"{name}_header"), 0).otherwise(F.col("row") - F.col(f"{name}_first") + 1).cast("int")
    return own.join(first.hint("merge"), I.SHEET).select("file", row.alias("row"), "cells")


def named(rows: DataFrame, keywords: dict[str, Sequence[str]], ranked: tuple[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows of a section with the columns that its headers stand for: file, row, and each key. ``ranked``: a key that is the
    column of the first of these names that a sheet has, else of its keywords."""
    heads = rows.where("row = 0").select("file", F.lit("section").alias("sheet"), F.inline("cells")).select(*I.SHEET, "col", collapsed(F.coalesce("value", F.lit(""))).alias("header"))
    key, names = ranked or (None, ())
    best = {f"{i:02d}": [name] for i, name in enumerate(names)}
    at = I.resolve_columns(heads, {**keywords, **best}).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "col"))).alias("at"))
    col = lambda k: F.try_element_at("at", F.lit(k))
    place = {k: F.when(col(k).isNotNull(), F.coalesce(*map(col, best), col(k))) if k == key else col(k) for k in keywords}
    at = at.select("file", *(c.alias(f"at_{k}") for k, c in place.items()))
    # The last of cells at one place is the greatest.
    cols, values = F.reverse(F.col("cells").getField("col")), F.reverse(F.col("cells").getField("value"))
    return rows.where("row > 0").join(at.hint("merge"), "file", "left").select("file", "row", *(F.get(values, (F.array_position(cols, F.col(f"at_{k}")) - 1).cast("int")).alias(k) for k in keywords))


def seams_by_rows(joints: DataFrame) -> DataFrame:
    """Joint rows with a chainage and a seam; rows before the target take the seam of the row before."""
    rows = named(joints, JOINT_ROWS).select(F.col("file").alias("program_id"), F.lit("").alias("source"), to_number(F.col("distance")).alias("off"), F.coalesce(to_number(F.col("chainage")), to_number(F.col("distance"))).alias("chainage"), clock_to_hours(F.col("seam")).alias("hours"), weld_number(to_number(F.col("gwd"))).alias("gwd"))
    before = J.scan(rows.where("chainage IS NOT NULL"), ["program_id"], ["chainage", "gwd"], {"first": J.row_number(), "before": J.lag("hours")})
    hours = F.when((F.col("off") < 0) & (F.col("first") > 1), F.col("before")).otherwise(F.col("hours"))
    return before.select("program_id", "source", "chainage", hours.alias("hours")).where("hours IS NOT NULL")


def dig_map(cells: DataFrame, merged: DataFrame | None = None) -> dict[str, DataFrame]:
    """``features, welds, seams, limits`` of every file: chainage is the distance from the target weld where a sheet has it. Seams are
    those of the joint matrix; without one, joint rows give each span the seam nearest to its start, within 2 m; without any
    of these, rows of type seam in the feature section."""
    rows = sheet_rows(I.fill_merged(cells, merged) if merged is not None else cells)
    listing, joints = kept(section(rows, "features"), "dig-features"), kept(section(rows, "joints"), "dig-joints")
    raw = named(listing, INSPECTION, ("distance", DISTANCES)).select(F.col("file").alias("line_id"), "row", to_number(F.col("distance")).alias("chainage"), "source", F.coalesce("feature_id", F.col("row").cast("string")).alias("feature_id"), "feature_type", "feature_desc", F.col("depth").alias("depth_pct"), F.col("length").alias("length_mm"), F.col("width").alias("width_mm"), F.col("orientation").alias("orientation_raw"), F.col("joint_number").alias("gwd_number"))
    features = kept(M.feature_map_anomaly(raw), "dig-map")
    girth = M.girth_welds(features).select(F.col("line_id").alias("program_id"), "source", F.col("gwd_number").alias("gwd"), "chainage")
    matrix = joints.select(F.col("file").alias("program_id"), "row", F.inline("cells"))
    own = features.select(F.col("line_id").alias("program_id"), "chainage", F.lit(None).cast("double").alias("distance_from_tgw"))
    _, welds, spans = J.dig_feature_map(own, girth, matrix)
    spans = kept(spans, "dig-spans")
    rest = J.scan(girth.where("chainage IS NOT NULL"), ["program_id"], ["chainage", "gwd", "source"], {"chainage_end": J.lead("chainage")}).where("chainage_end IS NOT NULL").drop("source")
    rest = rest.join(spans.select("program_id").distinct().hint("merge"), "program_id", "left_anti")
    by_rows = J.seam_by_chainage(rest, seams_by_rows(joints), ("program_id",)).where("seam_hours IS NOT NULL")
    by_rows = by_rows.select("program_id", F.lit("").alias("source"), "gwd", F.col("chainage").alias("chainage_start"), "chainage_end", F.col("seam_hours").alias("orientation_hours"), hours_to_clock(F.col("seam_hours")).alias("orientation_label")).dropDuplicates(["program_id", "chainage_start", "chainage_end"])
    built = kept(spans.unionByName(by_rows), "dig-seams")
    plain = M.seam_welds(features).select(F.col("line_id").alias("program_id"), "source", F.col("gwd_number").alias("gwd"), "chainage_start", "chainage_end", "orientation_hours", "orientation_label")
    seams = built.unionByName(plain.join(built.select("program_id").distinct().hint("merge"), "program_id", "left_anti"))
    near = rows.where(NEAR_LIMITS).select(*I.SHEET, "sheet_ord", "row", F.inline("cells")).where(F.col("col") < I.NDE_COLUMNS)
    limits = I.limits_below(near, [*I.SHEET, "sheet_ord"]).groupBy("file").agg(F.min_by(F.struct("length_m", "start_m", "end_m", "target_gwd"), "sheet_ord").alias("s"))
    lo, hi = M.nde_region(F.col("s.start_m"), F.col("s.end_m"))
    limits = limits.select(F.col("file").alias("program_id"), lo.alias("lo"), hi.alias("hi"), "s.length_m", "s.target_gwd")
    return {"features": features.withColumnRenamed("line_id", "program_id"), "welds": welds, "seams": seams, "limits": limits}
