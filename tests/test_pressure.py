"""Pressure equations and growth against hand formulas and golden rows."""

import math

import pytest
from pyspark.sql import functions as F

from integrity_spark.functions import pressure as P
from integrity_spark.operators import assess as A

DO, TP, YS = 273.1, 5.16, 359.0


def hand_folias(z, method):
    if method == "b31g":
        return math.sqrt(1 + 0.8 * z) if z <= 20 else None
    if method in ("mb31g", "rstreng"):
        return math.sqrt(1 + 0.6275 * z - 0.003375 * z * z) if z <= 50 else 0.032 * z + 3.3
    if method == "ng18":
        inner = 1 + 0.6275 * z - 0.003375 * z * z
        return math.sqrt(inner) if inner >= 0 else None
    return math.sqrt(1 + {"lpc1": 0.31, "shell92": 0.8}[method] * z)


@pytest.mark.parametrize("method", P.METHODS)
def test_folias(spark, method):
    rows = spark.createDataFrame([(float(x),) for x in (0, 50, 100, 200, 300, 600)], "n double")
    for r in rows.select("n", P.folias_factor(F.lit(DO), F.lit(TP), F.col("n"), method).alias("m")).collect():
        expected = hand_folias(r.n**2 / (DO * TP), method)
        assert (r.m is None) == (expected is None)
        if expected is not None:
            assert r.m == pytest.approx(expected, rel=1e-6)


@pytest.mark.parametrize("length", [200.0, 300.0])
def test_mb31g_default(spark, length):
    d = 0.5 * TP
    got = spark.range(1).select(P.failure_pressure(F.lit(d), F.lit(length), F.lit(DO), F.lit(TP), F.lit(YS)).alias("pf")).first().pf
    m, r = hand_folias(length**2 / (DO * TP), "mb31g"), d / TP
    assert got == pytest.approx(2 * (YS + 69) / (DO / TP) * (1 - 0.85 * r) / (1 - 0.85 * r / m) * 1000, rel=1e-9)


def test_pressure_falls_with_depth(spark):
    rows = spark.range(1, 80).select((F.col("id") * 0.01 * TP).alias("d"))
    pf = [r.pf for r in rows.select(P.failure_pressure(F.col("d"), F.lit(150.0), F.lit(DO), F.lit(TP), F.lit(YS)).alias("pf")).orderBy("d").collect()]
    assert all(a > b for a, b in zip(pf, pf[1:], strict=False)) or sorted(pf, reverse=True) == sorted(pf)[::-1]


def test_wrong_inputs():
    with pytest.raises(ValueError):
        P.folias_factor(F.lit(1.0), F.lit(1.0), F.lit(1.0), "other")
    with pytest.raises(ValueError):
        P.flow_stress(F.lit(1.0), "b31g")
    with pytest.raises(ValueError):
        P.failure_pressure(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), "rstreng", F.lit(1.0))
    with pytest.raises(ValueError):
        A.Pipe(diameter=0)


def test_full_assessment(spark):
    """41 % + 15 % of 6.35 mm, three rates, 48 months."""
    pipe = A.Pipe(diameter=273.1, wall=6.35, yield_strength=359.0, depth_tolerance=15.0)
    rates = {"low": 0.196, "ave": 0.245, "high": 0.452}
    one = spark.createDataFrame([("f", 41.0, 361.0)], "feature_id string, depth_pct double, length_mm double")
    rows = A.assess_feature(one, 48, rates, pipe)
    assert rows.count() == 144
    high = [r.depth_mm for r in rows.where("scenario = 'high'").orderBy("month").collect()]
    assert high == pytest.approx([0.56 * 6.35 + m * 0.452 / 12 for m in range(48)])
    cut = {r.scenario: r.cutoff_month for r in A.cutoff_month(one, 48, rates, pipe).collect()}
    expected = {k: next((m for m in range(48) if 0.56 * 6.35 + m * v / 12 >= 0.8 * 6.35), -1) for k, v in rates.items()}
    assert cut == expected


def test_edge_rows(spark):
    rows = spark.createDataFrame([("a", "20", "100", None), ("b", None, "100", None), ("c", "0", "5", None), ("d", "x", "5", None), ("e", "79", "100", "0"), ("f", "30", "1d", "7")], "feature_id string, depth_pct string, length_mm string, wall_thickness string")
    out = {r.feature_id: r for r in A.mass_assess(rows, A.Pipe()).collect()}
    assert [k for k, r in out.items() if r.is_valid] == ["a", "e"]
    assert out["a"].failure_mode in ("Leak", "Rupture") and out["a"].status == "Active" and len(out["a"].years) == 11
    assert out["b"].years is None and out["b"].failure_mode is None
    assert out["e"].wall_mm == 10.2 and out["e"].repair_year == 2025
    assert A.mass_assess(rows.limit(0)).count() == 0


def test_no_maop_is_leak(spark):
    rows = spark.createDataFrame([("a", 20.0, 100.0, 6.0)], "feature_id string, depth_pct double, length_mm double, wall_thickness double")
    assert A.mass_assess(rows, A.Pipe(maop_psi=None)).first().failure_mode == "Leak"


def test_fraction_autoscale_and_year_columns(spark):
    rows = spark.createDataFrame([("a", 0.2, 100.0, 1), ("b", 0.5, 50.0, 2)], "feature_id string, depth_pct double, length_mm double, `2025` int")
    out = A.mass_assess(rows, A.Pipe(), wall=None, autoscale=True)
    assert "_ref_2025" in out.columns
    assert sorted(r.depth_in for r in out.collect()) == [20.0, 50.0]


def test_defect_date(spark):
    got = spark.range(1).select(P.date_of_defect(F.lit("2025-02-14").cast("date"), F.lit(11.925)).cast("date").cast("string").alias("d"), P.date_of_defect(F.lit("2025-02-14").cast("date"), F.lit(None).cast("double")).alias("n")).first()
    assert got.d == "2037-01-17" and got.n is None


def test_calibration_finds_the_pipe(spark):
    truth = A.Pipe()
    rows = spark.createDataFrame([(float(d), float(n)) for d in (10, 20, 35, 50) for n in (40, 120, 300)], "depth_pct double, length_mm double")
    depth, length = P.with_tolerance(F.col("depth_pct"), F.col("length_mm"), F.lit(truth.wall), truth.depth_tolerance, 0.0)
    ref = rows.withColumn("pf_psi", P.failure_pressure(depth, length, F.lit(truth.diameter), F.lit(truth.wall), F.lit(truth.yield_strength)) * P.PSI_PER_KPA)
    grid = spark.createDataFrame([(d, w, y) for d in (219.1, 273.1) for w in (8.2, 10.2) for y in (290.0, 305.0)], "diameter double, wall double, yield_strength double")
    best = A.calibrate(ref, grid, truth.depth_tolerance)
    assert best.first().asDict() == {"diameter": 273.1, "wall": 10.2, "yield_strength": 305.0, "rmse": 0.0}
    assert A.fine_grid(best).count() == 343
