"""Metal-loss assessment over the defects of the feature view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pressure as P
from ..operators import assess as A
from ..operators.quality import RANK_ERROR, column_stats, histogram, merged_sketches, sketch_percentiles, sketched
from ..sources.fixtures import view
from .registry import query

PIPE = A.Pipe()
RATES = {"low": 0.196, "ave": 0.245, "high": 0.452}
IS_DEFECT = "feature_type NOT IN ('Girth Weld', 'Seam Weld')"
#: Methods with the flow stress (MPa) and area ratio that their query uses.
FLOW, AREA = 394.9, 0.4


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.defects(view(spark, sf_dir, "ili_features"))


def sql_folias(length: str, wall: str, method: str = "mb31g", diameter: float = PIPE.diameter) -> str:
    z = f"(({length}) * ({length}) / ({diameter}e0 * ({wall})))"
    inner = f"(1.0e0 + {z} * 0.6275e0 - {z} * {z} * 0.003375e0)"
    root = f"CASE WHEN {inner} >= 0 THEN sqrt({inner}) END"
    return {
        "b31g": f"(CASE WHEN {z} <= 20 THEN sqrt(1.0e0 + {z} * 0.8e0) END)", "ng18": f"({root})", "lpc1": f"sqrt(1.0e0 + {z} * 0.31e0)", "shell92": f"sqrt(1.0e0 + {z} * 0.8e0)",
    }.get(method, f"(CASE WHEN {z} <= 50 THEN {root} ELSE {z} * 0.032e0 + 3.3e0 END)")


def sql_pf(depth: str, length: str, wall: str, method: str = "mb31g", flow: str = f"({PIPE.yield_strength}e0 + 69.0e0)") -> str:
    """kPa."""
    m, r = sql_folias(length, wall, method), f"{AREA}e0" if method == "rstreng" else f"(({depth}) / ({wall}))"
    share = {"b31g": f"{2 / 3!r}e0", "mb31g": "0.85e0"}.get(method, "1.0e0")
    loss = f"({r} * {share})"
    rs = f"((1.0e0 - {loss}) / nullif(1.0e0 - {loss} / {m}, 0))"
    if method == "b31g":
        rs = f"(CASE WHEN {m} IS NULL THEN 1.0e0 - {r} ELSE {rs} END)"
    return f"({flow} * 2.0e0 / ({PIPE.diameter}e0 / ({wall})) * {rs} * 1000.0e0)"


ASSESSED = f"""v AS (SELECT *, depth_pct > 0 AND length_mm > 0 AS ok, coalesce(CASE WHEN wall_thickness > 0 THEN wall_thickness END, {PIPE.wall}e0) AS w FROM ili_features WHERE {IS_DEFECT}),
 d AS (SELECT *, CASE WHEN ok THEN (depth_pct + {PIPE.depth_tolerance}e0) * 0.01e0 * w END AS d0, CASE WHEN ok THEN length_mm END AS l0, CASE WHEN ok THEN {PIPE.rate}e0 END AS r FROM v),
 p AS (SELECT *, {", ".join(f"{sql_pf(f'(d0 + r * {i}.0e0)', 'l0', 'w')} * {P.PSI_PER_KPA}e0 AS p{i}, (d0 + r * {i}.0e0) / w > 0.8e0 AS o{i}" for i in range(A.YEARS))} FROM d),
 a AS (SELECT *, CASE WHEN {" OR ".join(f"(p{i} < 1250 AND NOT o{i})" for i in range(A.YEARS))} THEN 'Rupture' WHEN ok THEN 'Leak' END AS failure_mode,
  CASE {" ".join(f"WHEN p{i} < 1250 OR o{i} THEN {2025 + i}" for i in range(A.YEARS))} END AS repair_year,
  CASE WHEN r > 0 THEN greatest((w * 0.8e0 - d0) / r, 0.0e0) END AS ytd FROM p)"""


def assessed_sql(select: str) -> tuple[str, tuple[str, ...]]:
    from ..sources.fixtures import VIEWS

    return f"WITH ili_features AS ({VIEWS['ili_features']}), {ASSESSED} {select}", ()


@query(*assessed_sql(f"SELECT line_id, feature_id, chainage, {', '.join(f'round(p{i}, 6) AS pf_{2025 + i}' for i in range(A.YEARS))}, failure_mode, repair_year, CASE WHEN ok THEN coalesce(cast(repair_year AS varchar), 'Beyond horizon') END AS repair_label, round(ytd, 6) AS years_to_defect, strftime(TIMESTAMP '2025-01-01' + to_microseconds(cast(trunc(ytd * 365.25e0 * 86400.0e0 * 1e6) AS bigint)), '%Y-%m-%d') AS defect_date FROM a"))
def mass_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = A.wide_years(A.mass_assess(defects(spark, sf_dir), PIPE))
    years = [f"pf_{PIPE.start_year + i}" for i in range(A.YEARS)]
    return wide.select("line_id", "feature_id", "chainage", *years, "failure_mode", "repair_year", "repair_label", F.round("years_to_defect", 6).alias("years_to_defect"), F.date_format("defect_date", "yyyy-MM-dd").alias("defect_date"))


@query(*assessed_sql("SELECT feature_id, chainage, y AS year, round(round(CASE " + " ".join(f"WHEN y = {2025 + i} THEN p{i}" for i in range(A.YEARS)) + " END, 10), 6) AS pf_psi, CASE " + " ".join(f"WHEN y = {2025 + i} THEN o{i}" for i in range(A.YEARS)) + " END AS over_80 FROM a, (SELECT unnest(range(2025, 2036)) AS y) WHERE ok"))
def pressure_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = A.long_years(A.mass_assess(defects(spark, sf_dir), PIPE), "feature_id", "chainage")
    return long.select("feature_id", "chainage", F.col("year").cast("long").alias("year"), F.round("pf_psi", 6).alias("pf_psi"), "over_80")


@query(*assessed_sql("SELECT y AS year, count(*) FILTER (WHERE CASE " + " ".join(f"WHEN y = {2025 + i} THEN o{i}" for i in range(A.YEARS)) + " END) AS over_80 FROM a, (SELECT unnest(range(2025, 2036)) AS y) WHERE ok GROUP BY y"))
def over_80_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.over_80_by_year(A.mass_assess(defects(spark, sf_dir), PIPE)).select(F.col("year").cast("long").alias("year"), "over_80")


@query(*assessed_sql("SELECT count(*) AS total_rows, count(*) FILTER (WHERE ok) AS valid_rows, count(*) FILTER (WHERE NOT ok) AS skipped_rows, count(*) FILTER (WHERE ok AND depth_pct < 20) AS rows_lt20, count(*) FILTER (WHERE ok AND depth_pct BETWEEN 20 AND 40) AS rows_20_40, count(*) FILTER (WHERE ok AND depth_pct > 40) AS rows_gt40, count(*) FILTER (WHERE failure_mode = 'Rupture') AS rupture_count, count(*) FILTER (WHERE failure_mode = 'Leak') AS leak_count, count(*) FILTER (WHERE repair_year IS NOT NULL) AS repair_within_horizon FROM a"))
def assessment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.assessment_summary(A.mass_assess(defects(spark, sf_dir), PIPE))


@query(*assessed_sql("SELECT feature_id, round(depth_pct, 2) AS depth_pct, round(length_mm, 1) AS length_mm, round(p0, 6) AS pf_year0_psi, failure_mode FROM a WHERE ok ORDER BY pf_year0_psi NULLS LAST, feature_id, depth_pct, length_mm LIMIT 20"))
def worst_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.worst_features(A.mass_assess(defects(spark, sf_dir), PIPE))


def _method_query(method: str) -> None:
    sql = f"""SELECT feature_id, chainage, round({sql_folias('length_mm', f'{PIPE.wall}e0', method)}, 6) AS folias,
     round({sql_pf(f'depth_pct * 0.01e0 * {PIPE.wall}e0', 'length_mm', f'{PIPE.wall}e0', method, f'{FLOW}e0')}, 4) AS pf_kpa FROM ili_features WHERE {IS_DEFECT} AND depth_pct > 0 AND length_mm > 0"""

    @query(sql, ("ili_features",), f"failure_pressure_{method}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wall, diameter = F.lit(PIPE.wall), F.lit(PIPE.diameter)
        own = A.valid_defects(defects(spark, sf_dir)).where("is_valid")
        pf = P.failure_pressure(F.col("depth_pct") * 0.01 * PIPE.wall, F.col("length_mm"), diameter, wall, F.lit(PIPE.yield_strength), method, F.lit(FLOW), F.lit(AREA))
        return own.select("feature_id", "chainage", F.round(P.folias_factor(diameter, wall, F.col("length_mm"), method), 6).alias("folias"), F.round(pf, 4).alias("pf_kpa"))


for _method in P.METHODS:
    _method_query(_method)

MONTHS = 24
_SCENARIOS = "(VALUES " + ", ".join(f"('{k}', {v}e0)" for k, v in RATES.items()) + ") AS s(scenario, rate)"
_MONTHLY = f"SELECT feature_id, chainage, scenario, m AS month, ((depth_pct + {PIPE.depth_tolerance}e0) * 0.01e0 * {PIPE.wall}e0) + m * (rate / 12.0e0) AS dm, length_mm AS l0 FROM ili_features, {_SCENARIOS}, (SELECT unnest(range(0, {MONTHS})) AS m) WHERE {IS_DEFECT} AND depth_pct > 0 AND length_mm > 0"


@query(f"SELECT scenario, month, count(*) AS n, round(min({sql_pf('dm', 'l0', f'{PIPE.wall}e0')} * {P.PSI_PER_KPA}e0 * 0.8e0), 4) AS min_sop, round(max(dm), 6) AS max_depth FROM ({_MONTHLY}) GROUP BY scenario, month", ("ili_features",))
def monthly_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly projection of every feature under three rates, rolled up."""
    rows = A.assess_feature(defects(spark, sf_dir).select("feature_id", "chainage", "depth_pct", "length_mm"), MONTHS, RATES, PIPE)
    return rows.groupBy("scenario", F.col("month").cast("long").alias("month")).agg(F.count("*").alias("n"), F.round(F.min("sop_psi"), 4).alias("min_sop"), F.round(F.max("depth_mm"), 6).alias("max_depth"))


@query(f"SELECT any_value(feature_id) AS feature_id, any_value(chainage) AS chainage, scenario, coalesce(min(CASE WHEN ((depth_pct + {PIPE.depth_tolerance}e0) * 0.01e0 * {PIPE.wall}e0) + m * (rate / 12.0e0) >= {PIPE.wall}e0 * 0.8e0 THEN m END), -1) AS cutoff_month FROM (SELECT *, row_number() OVER () AS u FROM ili_features WHERE {IS_DEFECT} AND depth_pct > 0 AND length_mm > 0), {_SCENARIOS}, (SELECT unnest(range(0, {MONTHS})) AS m) GROUP BY u, scenario", ("ili_features",))
def cutoff_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.cutoff_month(defects(spark, sf_dir).select("feature_id", "chainage", "depth_pct", "length_mm"), MONTHS, RATES, PIPE)
    return out.select("feature_id", "chainage", "scenario", F.col("cutoff_month").cast("long").alias("cutoff_month"))


@query(f"SELECT month, count(*) AS n, round(avg(depth_low), 6) AS depth_low, round(avg(depth_high), 6) AS depth_high, round(min(sop_ave), 4) AS sop_ave, any_value(date) AS date FROM (SELECT m AS month, strftime(DATE '2025-01-01' + cast(30 * m AS integer), '%Y-%m-%d') AS date, d0 + m * ({RATES['low']}e0 / 12.0e0) AS depth_low, d0 + m * ({RATES['high']}e0 / 12.0e0) AS depth_high, {sql_pf(f'(d0 + m * ({RATES["ave"]}e0 / 12.0e0))', 'length_mm', f'{PIPE.wall}e0')} * {P.PSI_PER_KPA}e0 * 0.8e0 AS sop_ave FROM (SELECT (depth_pct + {PIPE.depth_tolerance}e0) * 0.01e0 * {PIPE.wall}e0 AS d0, length_mm FROM ili_features WHERE {IS_DEFECT} AND depth_pct > 0 AND length_mm > 0), (SELECT unnest(range(0, 20)) AS m)) GROUP BY month", ("ili_features",))
def growth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month's text is made of its date, once: an aggregate that carries text sorts all its rows."""
    rows = A.growth_table(defects(spark, sf_dir).select("depth_pct", "length_mm"), 48, RATES, PIPE)
    return rows.groupBy(F.col("month").cast("long").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("depth_mm_low"), 6).alias("depth_low"), F.round(F.avg("depth_mm_high"), 6).alias("depth_high"), F.round(F.min("sop_psi_ave"), 4).alias("sop_ave"), F.date_format(F.any_value("date"), "yyyy-MM-dd").alias("date"))


GRID = [(d, w, y) for d in (219.1, 273.1, 323.9) for w in (6.35, 8.2, 10.2) for y in (290.0, 305.0, 359.0)]


@query(f"SELECT diameter, wall, yield_strength, round(sqrt(avg((pf - ref) * (pf - ref))), 4) AS rmse FROM (SELECT diameter, wall, yield_strength, {sql_pf(f'(depth_pct + {PIPE.depth_tolerance}e0) * 0.01e0 * {PIPE.wall}e0', 'length_mm', f'{PIPE.wall}e0')} * {P.PSI_PER_KPA}e0 AS ref, {sql_pf(f'(depth_pct + {PIPE.depth_tolerance}e0) * 0.01e0 * wall', 'length_mm', 'wall', flow='(yield_strength + 69.0e0)').replace(f'{PIPE.diameter}e0', 'diameter')} * {P.PSI_PER_KPA}e0 AS pf FROM ili_features, (VALUES {', '.join(f'({d}e0, {w}e0, {y}e0)' for d, w, y in GRID)}) AS g(diameter, wall, yield_strength) WHERE {IS_DEFECT} AND depth_pct > 0 AND length_mm > 0) GROUP BY diameter, wall, yield_strength ORDER BY rmse, diameter, wall, yield_strength LIMIT 15", ("ili_features",))
def calibrate_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.valid_defects(defects(spark, sf_dir)).where("is_valid")
    depth, length = P.with_tolerance(F.col("depth_pct"), F.col("length_mm"), F.lit(PIPE.wall), PIPE.depth_tolerance, 0.0)
    ref = own.withColumn("pf_psi", P.failure_pressure(depth, length, F.lit(PIPE.diameter), F.lit(PIPE.wall), F.lit(PIPE.yield_strength)) * P.PSI_PER_KPA)
    grid = spark.createDataFrame(GRID, "diameter double, wall double, yield_strength double")
    return A.calibrate(ref, grid, PIPE.depth_tolerance).withColumn("rmse", F.round("rmse", 4))


@query(f"SELECT count(*) AS n, round(sqrt(avg((a - e) * (a - e))), 4) AS rmse, round(avg((a - e) / e * 100.0e0), 4) AS bias_pct, round(quantile_cont(abs((a - e) / e * 100.0e0), 0.9), 4) AS p90_pct, count(*) FILTER (WHERE abs((a - e) / e * 100.0e0) > 10) AS outside_10_pct FROM (SELECT {sql_pf('depth_pct * 0.01e0 * 10.2e0', 'length_mm', '10.2e0', 'mb31g', '394.9e0')} AS a, {sql_pf('depth_pct * 0.01e0 * 10.2e0', 'length_mm', '10.2e0', 'lpc1', '394.9e0')} AS e FROM ili_features WHERE {IS_DEFECT} AND depth_pct > 0 AND length_mm > 0)", ("ili_features",))
def fit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One equation against another."""
    own = A.valid_defects(defects(spark, sf_dir)).where("is_valid")
    args = (F.col("depth_pct") * 0.01 * PIPE.wall, F.col("length_mm"), F.lit(PIPE.diameter), F.lit(PIPE.wall), F.lit(PIPE.yield_strength))
    pair = own.select(P.failure_pressure(*args, "mb31g", F.lit(FLOW)).alias("a"), P.failure_pressure(*args, "lpc1", F.lit(FLOW)).alias("e"))
    e = A.fit_errors(pair, "a", "e")
    return e.select("n", *(F.round(c, 4).alias(c) for c in ("rmse", "bias_pct", "p90_pct")), "outside_10_pct")


_STAT = "SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM ili_features"
STAT_COLUMNS = ("chainage", "depth_pct", "length_mm", "width_mm", "wall_thickness")


@query(" UNION ALL ".join(_STAT.format(c=c) for c in STAT_COLUMNS), ("ili_features",))
def feature_column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = column_stats(view(spark, sf_dir, "ili_features"), STAT_COLUMNS)
    return s.select("column", "count", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "q25", "q50", "q75")))


@query("SELECT b.bin AS bin, round(lo + (b.bin - 1) * (hi - lo) / 30, 6) AS edge_lo, round(lo + b.bin * (hi - lo) / 30, 6) AS edge_hi, count(x.v) AS n FROM (SELECT unnest(range(1, 31)) AS bin) b CROSS JOIN (SELECT min(depth_pct) AS lo, max(depth_pct) AS hi FROM ili_features) e LEFT JOIN (SELECT depth_pct AS v, least(cast(floor((depth_pct - lo2) / ((hi2 - lo2) / 30)) AS bigint) + 1, 30) AS bin FROM ili_features, (SELECT min(depth_pct) AS lo2, max(depth_pct) AS hi2 FROM ili_features)) x ON x.bin = b.bin GROUP BY b.bin, lo, hi", ("ili_features",))
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = histogram(view(spark, sf_dir, "ili_features"), "depth_pct", 30)
    return h.select(F.col("bin").cast("long").alias("bin"), F.round("edge_lo", 6).alias("edge_lo"), F.round("edge_hi", 6).alias("edge_hi"), "n")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", q AS quantile, count({c}) AS count, TRUE AS within FROM ili_features, (VALUES (0.25e0), (0.5e0), (0.75e0)) AS v(q) GROUP BY q" for c in STAT_COLUMNS), ("ili_features",))
def sketched_column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of merged sketches, one a line: whether their exact ranks are within the stated error."""
    f = view(spark, sf_dir, "ili_features")
    parts = [sketched(f.where(F.col("line_id") == line), STAT_COLUMNS) for line in ("L0", "L1", "L2")]
    q = sketch_percentiles(merged_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2])), (0.25, 0.5, 0.75))
    values = f.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in STAT_COLUMNS)))).where("v IS NOT NULL")
    met = values.join(F.broadcast(q), "column")  # three rows a column
    ranks = met.groupBy("column", "at").agg(F.count("*").alias("count"), (F.count_if(F.col("v") < F.col("value")) / F.count("*")).alias("below"), (F.count_if(F.col("v") <= F.col("value")) / F.count("*")).alias("upto"))
    close = (F.col("below") - RANK_ERROR <= F.col("at")) & (F.col("at") <= F.col("upto") + RANK_ERROR)
    return ranks.select("column", F.col("at").alias("quantile"), "count", close.alias("within"))
