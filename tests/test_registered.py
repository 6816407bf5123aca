"""The registered queries that reach one branch each, in Spark and in DuckDB, on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from integrity_spark.plans import detail_queries, ingest_queries, map_queries, reading_queries, tml_queries  # noqa: F401
from integrity_spark.plans.registry import ORACLES, QUERIES
from integrity_spark.sources.keywords import INSPECTION, merged
from integrity_spark.sources.shared import numbered

SF = "/root/testdata/sf0.001"
NAMES = [
    *(f"tml_workflow_{i:02d}" for i in (3, 4, 5, 6, 7, 10, 11, 13, 14, 15, 16, 17, 19, 20)), "tml_workflow_17_all", "tml_full_batch", "tml_appended_assets", "tml_filter_conditions", "resolve_columns", "infer_vendor", "fill_merged_ranges",
    "promote_header", "unique_headers", "dedupe_headers", "canonical_columns", "auto_sheet", "reheader_banner", "parse_nde_limits", "detect_tally_format", "parse_quoted_text", "parse_broken_lines", "landed_row_numbers", "write_package", "tiled_raster", "sketched_column_stats", "vendor_columns", "user_columns", "pipe_inputs", "workflow_plans", "tgw_layout", "dig_runs", "circuits_of_one_beginning", "parse_listed_reports", "write_and_read", "issue_date", "json_number", "label_parts",
    "gwd_from_text", "context_text", "fraction_autoscale", "match_source_names", "positional_welds", "tgw_four_welds", "seam_carry_upstream", "unpivot_joint_matrix", "joint_matrix_plain", "joint_matrix_merged", "joint_matrix_interleaved", "joint_matrix_stacked", "dig_map_from_sheets", "normalize_joint_summary", "runs_of_labels", "sequence_zones", "tokens_to_rows",
    "numeric_page_readings", "select_strategy", "user_keywords", "weld_bounds", "weld_bounds_between", "center_context", "joint_context_seams", "loader_assets", "loader_edited", "circuit_prefixes", "summary_page_choice", "dig_feature_table", "dig_feature_map",
]


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return v


@pytest.mark.parametrize("name", NAMES)
def test_same_in_both_engines(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    expected = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(expected.columns)
    rows = [tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in expected.columns)).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in expected.fetchall()), key=repr)


def test_numbered_in_ranges(spark):
    df = spark.range(0, 5000, 7).selectExpr("id % 901 AS k").repartition(5)
    got = {r.k: r.n for r in numbered(df, "k", "n").collect()}
    assert got == {k: i for i, k in enumerate(sorted({i % 901 for i in range(0, 5000, 7)}), 1)}


def test_blank_keywords_go():
    assert "" not in {n.strip() for n in merged(INSPECTION, {"depth": ["", "  ", "own"]})["depth"]}
