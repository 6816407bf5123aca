"""Windows by line, run and program with every line spread over several ranges: the same rows as SQL gives."""

import pytest
from test_registered import test_same_in_both_engines as same

NAMES = ["seam_spans", "seam_welds", "weld_bounds", "weld_bounds_between", "center_context", "seam_for_weld", "seam_by_chainage", "seam_carry_upstream", "positional_welds", "tgw_four_welds", "joint_context_seams", "weld_window", "dig_feature_map"]


@pytest.fixture
def ranges(spark):
    """As many ranges as partitions, none put together."""
    key, n = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set(key, "true")
    spark.conf.set("spark.sql.shuffle.partitions", n)


@pytest.mark.parametrize("name", NAMES)
def test_spread(spark, ranges, name):
    same(spark, name)
