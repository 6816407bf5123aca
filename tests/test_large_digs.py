"""Rows of windows are many times the listing: they are made once and aren't shuffled."""

import pytest
from test_operators import runs

from integrity_spark.operators import digs as D

MDL = "dig_id long, target_girth_weld long, line_id string, feature_ids string, length_in string, width_in string"


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Join ")


def test_rows_of_windows_are_made_by_the_last_join(spark):
    mdl = spark.createDataFrame([(6000, 3180, "L", "F-001\n-", "25.4", "12.7"), (6001, 3180, "L", "gone", "25.4", "12.7")], MDL)
    assert joins(D.dig_feature_table(mdl, runs(spark), fallback="skip")) == 1


def test_rows_of_a_key_are_targets_together(spark):
    ili = runs(spark)
    twin = ili.where("feature_id = 'F-001'").selectExpr(*(f"CAST(999 AS string) AS {c}" if c == "length_mm" else c for c in ili.columns))
    mdl = spark.createDataFrame([(6001, 3180, "L", "gone", "25.4", "12.7"), (6002, 9999, "L", "gone", "25.4", "12.7")], MDL)
    table = D.dig_feature_table(mdl, ili.unionByName(twin))
    got = {d: [r.is_target for r in table.where(f"dig_id = {d} AND feature_id = 'F-001'").collect()] for d in (6001, 6002)}
    assert got == {6001: [True, True], 6002: [True, True]}
    with pytest.raises(ValueError):
        D.dig_feature_table(mdl, ili, row_key=("feature_id",))


def test_bins_are_as_wide_as_windows(spark):
    windows = spark.createDataFrame([(0.0, 600.0), (10.0, 610.0), (0.0, 5.0)], "lo double, hi double")
    assert D.bin_of(windows) == 600.0 and D.bin_of(windows.limit(0)) == D.BIN_M
