"""What the dig package moves: the listing once in its last join, spans once a cell, and shuffle files that don't outlive their step."""

import random

import pytest
from test_operators import runs

from integrity_spark.operators import digs as D
from integrity_spark.operators import ranges as R
from integrity_spark.plans.registry import LEAN, QUERIES

MDL = "dig_id long, target_girth_weld long, line_id string, feature_ids string, length_in string, width_in string"


@pytest.fixture
def lean(spark):
    before = {k: spark.conf.get(k) for k in LEAN}
    for k, v in LEAN.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_the_last_join_shuffles_the_listing_once(lean):
    mdl = lean.createDataFrame([(6000, 3180, "L", "F-001\n-", "25.4", "12.7"), (6001, 3180, "L", "gone", "25.4", "12.7")], MDL)
    table = D.dig_feature_table(mdl, runs(lean), fallback="skip")
    assert exchanges(table) == 2  # the listing and the windows
    assert {r.dig_id for r in table.collect()} == {6000, 6001}


@pytest.mark.parametrize("co_partition", ["true", "false"])
def test_range_join_over_cells(lean, co_partition):
    lean.conf.set(R.CO_PARTITION, co_partition)
    rng = random.Random(4)
    place = lambda: rng.choice([float(rng.randint(-90, 90)), rng.uniform(-90, 90)])
    points = [(k, rng.choice("ab"), place()) for k in range(300)]
    spans = [(k, rng.choice("ab"), lo, lo + rng.choice([-1.0, 0.0, 0.4, 3.0, 70.0])) for k, lo in enumerate(place() for _ in range(80))]
    got = R.range_join(lean.createDataFrame(points, "p int, k string, x double"), lean.createDataFrame(spans, "s int, k string, lo double, hi double"), ["k"], "x", "lo", "hi", 0.5, open_ends=False)
    assert exchanges(got) == 2
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((p, s) for p, k, x in points for s, j, lo, hi in spans if k == j and lo <= x <= hi)


def test_nearest_value_brings_columns(spark):
    rng = random.Random(8)
    right = [(k, float(x), k + str(x)) for k in "ab" for x in rng.sample(range(60), 9)]
    left = [(i, rng.choice("abc"), rng.choice([None, rng.uniform(-5, 65), float(rng.randint(0, 60))])) for i in range(200)]
    got = R.nearest_value(spark.createDataFrame(left, "i int, k string, at double"), spark.createDataFrame(right, "k string, x double, name string"), ["k"], "at", "x", "near", ("name",))
    assert got.columns == ["i", "k", "at", "near", "name"]
    for r in got.collect():
        own = [] if r["at"] is None else sorted((abs(x - r["at"]), x, n) for k, x, n in right if k == r.k)
        assert (r.near, r["name"]) == (own[0][1:] if own else (None, None))


@pytest.mark.parametrize("most", [0, 100_000])
def test_first_chainage_of_a_long_or_short_list(spark, monkeypatch, most):
    """Of rows of one key the first by chainage counts, a null before all; then the next column's."""
    monkeypatch.setattr(D, "small", lambda df: df.count() <= most)
    mdl = spark.createDataFrame([(1, "L", "70"), (2, "L", "80"), (3, "M", "70"), (4, "L", "90")], "dig_id int, line_id string, target_girth_weld string")
    rows = [("L", "s", "70", "x", 9.0), ("L", "s", "70", "w", 4.0), ("L", "t", "70", "a", None), ("L", "t", "70", "b", 2.0), ("L", "t", "1", "70", 7.0), ("L", "s", "80", "c", float("nan")), ("M", "s", "71", "70", 5.0), ("L", "s", "9", "90", 3.0)]
    ili = spark.createDataFrame(rows, "line_id string, source string, gwd_number string, feature_id string, chainage double")
    for order in (["chainage", "feature_id"], ["feature_id", "chainage"]):
        first = 4.0
        got = {(r.dig_id, r.source): r.target_chainage for r in D.locate_target_weld(mdl, ili, order).collect()}
        assert got == {(1, "s"): first, (1, "t"): 7.0, (2, "s"): None, (2, "t"): None, (3, "s"): 5.0, (4, "s"): 3.0, (4, "t"): None}
        assert {(r.dig_id, r.source): r.target_chainage for r in D.found_targets(mdl, ili, order).collect()} == {k: v for k, v in got.items() if v is not None}


def test_settings_of_lean_queries_only(spark):
    before = {k: spark.conf.get(k) for k in LEAN}
    QUERIES["dig_package_summary"](spark, "/root/testdata/sf0.001")
    assert {k: spark.conf.get(k) for k in LEAN} == LEAN != before
    QUERIES["dig_ids"](spark, "/root/testdata/sf0.001")
    assert {k: spark.conf.get(k) for k in LEAN} == before


def test_summary_of_a_dig_that_asks_for_several_sizes(lean):
    """One size is compared without a lambda, several with one: the targets are the same."""
    rows = [(6001, 3180, "L", "gone", "25.4", "12.7"), (6002, 3180, "L", "gone", "25.4", "12.7"), (6002, 3180, "L", None, "900", "900"), (6003, 3180, "L", "gone", None, "12.7"), (6004, 3180, "L", "F-001", None, None)]
    mdl, ili = lean.createDataFrame(rows, MDL), runs(lean)
    table = D.dig_feature_table(mdl, ili, fallback="skip")
    got = {r.dig_id: (r.runs, r.n_rows, r.targets) for r in D.package_summary(mdl, table).collect()}
    assert got == {6001: (1, 9, 2), 6002: (1, 9, 2), 6003: (1, 9, 0), 6004: (1, 9, 1)}
    assert exchanges(table) == 2
