"""Metal-loss assessment: growth, failure mode, repair year, summaries and calibration.

Everything is a narrow projection: the years stay in an array until a long table is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pressure as P
from ..functions.scalars import is_defect, number_of
from ..sources.shared import kept, small_or_merged
from .quality import percentiles

YEARS = 11


@dataclass(frozen=True)
class Pipe:
    diameter: float = 273.1
    wall: float = 10.2
    yield_strength: float = 305.0
    tensile_strength: float = 455.0
    depth_tolerance: float = 10.0
    length_tolerance: float = 0.0
    rate: float = 0.51226
    rate_low: float | None = None
    rate_mid: float | None = None
    rate_high: float | None = None
    length_rate: float = 0.0
    start_year: int = 2025
    ili_date: str | None = None
    maop_psi: float | None = 1000.0
    safety_factor: float = 1.25

    def __post_init__(self) -> None:
        P.positive(diameter=self.diameter, wall=self.wall, yield_strength=self.yield_strength, tensile_strength=self.tensile_strength, maop_psi=self.maop_psi, safety_factor=self.safety_factor)


def protect_year_columns(df: DataFrame) -> DataFrame:
    """Input columns named like years get another name, so that results don't collide with them."""
    return df.withColumnsRenamed({c: f"_ref_{c}" for c in df.columns if c.isdigit() and 2000 <= int(c) <= 2100})


def valid_defects(df: DataFrame, depth: str = "depth_pct", length: str = "length_mm") -> DataFrame:
    """``is_valid``: depth and length are positive numbers. Rows stay."""
    d, n = number_of(df, depth), number_of(df, length)
    return df.withColumns({"depth_in": d, "length_in": n, "is_valid": F.coalesce((d > 0) & (n > 0), F.lit(False))})


def fraction_autoscale(df: DataFrame, by: str | None = None) -> DataFrame:
    """Where no valid depth of a data set is above 1.5, all of them are fractions: times 100. One small aggregate: the
    rows of data sets are broadcast behind a count, so a data set that holds most rows stays spread over all tasks."""
    top = F.max(F.when(F.col("is_valid"), F.col("depth_in")))
    if by:
        most = small_or_merged(kept(df.groupBy(F.col(by).alias("__by")).agg(top.alias("top")), "tops"))
        joined = df.join(most, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    else:
        joined = df.join(F.broadcast(df.agg(top.alias("top"))))
    scaled = F.coalesce(F.col("top") <= 1.5, F.lit(False))
    return joined.withColumn("depth_scaled", scaled).withColumn("depth_in", F.when(scaled, F.col("depth_in") * 100.0).otherwise(F.col("depth_in"))).drop("top")


def reference_time(pipe: Pipe) -> Column:
    start = F.make_date(F.lit(pipe.start_year), F.lit(1), F.lit(1))
    return (F.coalesce(F.try_to_timestamp(F.lit(pipe.ili_date), F.lit("yyyy-MM-dd")).cast("date"), start) if pipe.ili_date else start).cast("timestamp")


def mass_assess(df: DataFrame, pipe: Pipe = Pipe(), depth: str = "depth_pct", length: str = "length_mm", wall: str | None = "wall_thickness", autoscale: bool = False) -> DataFrame:
    """``df`` with depth and length with tolerance, rate, ``years`` (array of year, pf_psi, over_80), time to defect,
    failure mode and repair year. Invalid rows stay, with nulls."""
    out = valid_defects(protect_year_columns(df), depth, length)
    if autoscale:
        out = fraction_autoscale(out)
    ok = F.col("is_valid")
    own = number_of(out, wall) if wall else F.lit(None).cast("double")
    out = out.withColumn("wall_mm", F.coalesce(F.when(own > 0, own), F.lit(pipe.wall)))
    d0, l0 = P.with_tolerance(F.col("depth_in"), F.col("length_in"), F.col("wall_mm"), pipe.depth_tolerance, pipe.length_tolerance)
    rate = P.banded_rate(F.col("depth_in"), pipe.rate, pipe.rate_low, pipe.rate_mid, pipe.rate_high)
    out = out.withColumns({"depth_mm": F.when(ok, d0), "length0_mm": F.when(ok, l0), "rate_mm_yr": F.when(ok, rate)})
    diameter, ys = F.lit(pipe.diameter), F.lit(pipe.yield_strength)

    # each step is a projection of its own with small expressions, so that all of it stays in generated code
    span = range(YEARS)
    factor = {i: f"__m{i if pipe.length_rate else 0}" for i in span}
    out = out.withColumns({m: P.folias_factor(diameter, F.col("wall_mm"), F.col("length0_mm") + i * pipe.length_rate) for i, m in reversed(factor.items())})
    depth_at = [F.col("depth_mm") + F.col("rate_mm_yr") * float(i) for i in span]
    psi = {f"__p{i}": P.failure_pressure(depth_at[i], F.col("length0_mm"), diameter, F.col("wall_mm"), ys, folias=F.col(factor[i])) * P.PSI_PER_KPA for i in span}
    out = out.withColumns(psi | {f"__o{i}": depth_at[i] / F.col("wall_mm") > P.CUTOFF for i in span})
    each = F.array(*(F.struct(F.lit(pipe.start_year + i).alias("year"), F.col(f"__p{i}").alias("pf_psi"), F.col(f"__o{i}").alias("over_80")) for i in span))
    extra = [*set(factor.values()), *psi, *(f"__o{i}" for i in span)]
    to_defect = P.years_to_defect(F.col("depth_mm"), F.col("wall_mm"), F.col("rate_mm_yr"))
    out = out.withColumn("years_to_defect", to_defect).withColumn("defect_date", P.date_of_defect(reference_time(pipe), F.col("years_to_defect")))
    out = out.withColumn("status", F.when(ok, "Active"))
    if pipe.maop_psi is None:
        mode, first = F.when(ok, "Leak"), F.lit(None).cast("int")
    else:
        limit = pipe.maop_psi * pipe.safety_factor
        below = [F.col(f"__p{i}") < limit for i in span]
        rupture = reduce(or_, (below[i] & ~F.col(f"__o{i}") for i in span))
        first = F.coalesce(*(F.when(below[i] | F.col(f"__o{i}"), pipe.start_year + i) for i in span))
        mode = F.when(rupture, "Rupture").when(ok, "Leak")
    out = out.withColumns({"failure_mode": mode, "repair_year": first, "years": F.when(ok, each)}).drop(*extra)
    label = F.coalesce(F.col("repair_year").cast("string"), F.lit("Beyond horizon"))
    return out.withColumn("repair_label", F.when(ok & F.lit(pipe.maop_psi is not None), label))


def long_years(assessed: DataFrame, *keys: str) -> DataFrame:
    return assessed.where("is_valid").select(*keys, F.explode("years").alias("y")).select(*keys, "y.year", F.round("y.pf_psi", 10).alias("pf_psi"), "y.over_80", F.when(F.col("y.over_80"), ">80% leak").otherwise(F.round("y.pf_psi", 10).cast("string")).alias("pf_display"))


def wide_years(assessed: DataFrame, pipe: Pipe = Pipe(), digits: int = 6) -> DataFrame:
    """One Pf column for each year, read off the array: no pivot, no shuffle."""
    each = {f"pf_{pipe.start_year + i}": F.round(F.get("years", F.lit(i)).pf_psi, digits) for i in range(YEARS)}
    return assessed.withColumns(each).drop("years")


def over_80_by_year(assessed: DataFrame) -> DataFrame:
    return long_years(assessed).groupBy("year").agg(F.count_if("over_80").alias("over_80"))


def assessment_summary(assessed: DataFrame) -> DataFrame:
    d = F.when(F.col("is_valid"), F.col("depth_in"))
    return assessed.agg(
        F.count("*").alias("total_rows"), F.count_if("is_valid").alias("valid_rows"), F.count_if(~F.col("is_valid")).alias("skipped_rows"),
        F.count_if(d < 20).alias("rows_lt20"), F.count_if((d >= 20) & (d <= 40)).alias("rows_20_40"), F.count_if(d > 40).alias("rows_gt40"),
        F.count_if(F.col("failure_mode") == "Rupture").alias("rupture_count"), F.count_if(F.col("failure_mode") == "Leak").alias("leak_count"), F.count_if(F.col("repair_year").isNotNull()).alias("repair_within_horizon"),
    )


def worst_features(assessed: DataFrame, n: int = 20, id_col: str = "feature_id") -> DataFrame:
    """The lowest year-0 pressures; ties by id, then by depth and length."""
    pf0 = F.get("years", F.lit(0)).pf_psi
    worst = assessed.where("is_valid").select(id_col, F.round("depth_in", 2).alias("depth_pct"), F.round("length_in", 1).alias("length_mm"), F.round(pf0, 6).alias("pf_year0_psi"), "failure_mode")
    return worst.orderBy(F.col("pf_year0_psi").asc_nulls_last(), id_col, "depth_pct", "length_mm").limit(n)


def assess_feature(df: DataFrame, months: int, rates: dict[str, float], pipe: Pipe = Pipe()) -> DataFrame:
    """A row for each feature, scenario and month: depth, safe operating pressure (psi)."""
    own = valid_defects(df).where("is_valid")
    d0, l0 = P.with_tolerance(F.col("depth_in"), F.col("length_in"), F.lit(pipe.wall), pipe.depth_tolerance, pipe.length_tolerance)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(float(v)).alias("rate")) for k, v in rates.items())))
    rows = own.withColumns({"d0": d0, "l0": l0, "s": each}).withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(months - 1))))
    depth = F.col("d0") + F.col("month") * (F.col("s.rate") / 12.0)
    pf = P.failure_pressure(depth, F.col("l0"), F.lit(pipe.diameter), F.lit(pipe.wall), F.lit(pipe.yield_strength))
    return rows.select(*df.columns, F.col("s.scenario").alias("scenario"), "month", depth.alias("depth_mm"), (pf * P.PSI_PER_KPA * P.SOP_FACTOR).alias("sop_psi"))


def cutoff_month(df: DataFrame, months: int, rates: dict[str, float], pipe: Pipe = Pipe()) -> DataFrame:
    """The first month at 80 % of the wall for each feature and scenario, else -1. In closed form, so nothing is
    exploded: months are tried in an array only."""
    own = valid_defects(df).where("is_valid")
    d0, _ = P.with_tolerance(F.col("depth_in"), F.col("length_in"), F.lit(pipe.wall), pipe.depth_tolerance, pipe.length_tolerance)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(float(v)).alias("rate")) for k, v in rates.items())))
    rows = own.withColumns({"d0": d0, "s": each})
    hit = F.filter(F.sequence(F.lit(0), F.lit(months - 1)), lambda m: F.col("d0") + m * (F.col("s.rate") / 12.0) >= pipe.wall * P.CUTOFF)
    return rows.select(*df.columns, F.col("s.scenario").alias("scenario"), F.coalesce(F.get(hit, F.lit(0)), F.lit(-1)).alias("cutoff_month"))


def growth_table(df: DataFrame, months: int, rates: dict[str, float], pipe: Pipe = Pipe(), shown: int = 20) -> DataFrame:
    """Depth (mm, % of wall) and safe pressure by scenario, one row for each feature and month, with dates 30 days
    apart."""
    own = valid_defects(df).where("is_valid")
    d0, l0 = P.with_tolerance(F.col("depth_in"), F.col("length_in"), F.lit(pipe.wall), pipe.depth_tolerance, pipe.length_tolerance)
    rows = own.withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(min(months, shown) - 1))))
    cols = {}
    for k, v in rates.items():
        depth = d0 + F.col("month") * (float(v) / 12.0)
        pf = P.failure_pressure(depth, l0, F.lit(pipe.diameter), F.lit(pipe.wall), F.lit(pipe.yield_strength))
        cols |= {f"depth_mm_{k}": depth, f"depth_pct_{k}": depth / pipe.wall * 100.0, f"sop_psi_{k}": pf * P.PSI_PER_KPA * P.SOP_FACTOR}
    date = F.date_add(reference_time(pipe).cast("date"), (F.col("month") * 30).cast("int"))
    return rows.withColumn("date", date).withColumns(cols).select(*df.columns, "month", "date", *cols)


def fit_errors(compared: DataFrame, actual: str, expected: str) -> DataFrame:
    d = F.col(actual) - F.col(expected)
    pct = F.try_divide(d, F.col(expected)) * 100.0
    one = compared.agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(pct).alias("bias_pct"), F.count_if(F.abs(pct) > 10).alias("outside_10_pct"))
    p90 = percentiles(compared.select(F.lit("pct").alias("column"), F.abs(pct).alias("v")), (0.9,))
    met = one.withColumn("column", F.lit("pct")).join(p90.hint("broadcast"), "column", "left")
    return met.select("n", "rmse", "bias_pct", F.get("q", F.lit(0)).alias("p90_pct"), "outside_10_pct")


def calibrate(reference: DataFrame, grid: DataFrame, tolerance: float, top: int = 15) -> DataFrame:
    """Candidates (diameter, wall, yield_strength) of a small grid by RMSE of year-0 pressure against ``pf_psi`` of the
    reference. The grid is a parameter (its size is fixed by the caller), so it is the broadcast side."""
    depth, length = P.with_tolerance(F.col("depth_pct"), F.col("length_mm"), F.col("wall"), tolerance, 0.0)
    pairs = reference.select("depth_pct", "length_mm", "pf_psi").join(F.broadcast(grid))
    pf = P.failure_pressure(depth, length, F.col("diameter"), F.col("wall"), F.col("yield_strength")) * P.PSI_PER_KPA
    fits = pairs.groupBy("diameter", "wall", "yield_strength").agg(F.sqrt(F.avg((pf - F.col("pf_psi")) * (pf - F.col("pf_psi")))).alias("rmse"))
    return fits.orderBy(F.col("rmse").asc_nulls_last(), "diameter", "wall", "yield_strength").limit(top)


def fine_grid(best: DataFrame, steps: tuple[float, float, float] = (1.0, 0.1, 5.0), reach: int = 3) -> DataFrame:
    """Candidates around the winner."""
    around = F.sequence(F.lit(-reach), F.lit(reach))
    one = best.orderBy("rmse").limit(1)
    for name, step in zip(("diameter", "wall", "yield_strength"), steps, strict=True):
        one = one.withColumn("__k", F.explode(around)).withColumn(name, F.col(name) + F.col("__k") * step).drop("__k")
    return one.select("diameter", "wall", "yield_strength").where("diameter > 0 AND wall > 0 AND yield_strength > 0")


def defects(features: DataFrame) -> DataFrame:
    return features.where(is_defect(F.col("feature_type")))
