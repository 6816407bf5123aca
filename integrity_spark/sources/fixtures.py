"""Views that stand in for pipeline tables on a star schema. The same text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_ID = "concat_ws('-', cast(l_orderkey AS string), cast(l_partkey AS string), cast(l_suppkey AS string), cast(l_linenumber AS string))"

VIEWS = {
    "ili_features": f"""SELECT 'L' || cast(l_suppkey % 3 AS string) AS line_id,
 CASE l_returnflag WHEN 'A' THEN '2022 RunA MFL-A' WHEN 'N' THEN '2025 RunB' ELSE '2025 RunC EMAT' END AS source,
 {_ID} AS feature_id,
 CASE WHEN l_linenumber = 1 THEN 'Girth Weld' WHEN l_linenumber = 7 THEN 'Seam Weld' ELSE 'Metal Loss' END AS feature_type,
 cast(l_orderkey AS double) * 12 + cast(l_linenumber AS double) * 1.5e0 AS chainage,
 l_orderkey AS gwd_number,
 l_quantity * 1.6e0 AS depth_pct, l_extendedprice / 250 AS length_mm, l_discount * 1000 AS width_mm,
 cast(l_partkey % 12 AS string) || ':' || lpad(cast((l_suppkey * 5) % 60 AS string), 2, '0') AS orientation_raw,
 CASE WHEN l_tax = 0 THEN NULL ELSE 5 + l_tax * 50 END AS wall_thickness FROM lineitem""",
    "pipe_tally": """SELECT 'L' || cast(o_custkey % 3 AS string) AS line_id, o_orderkey AS joint_number,
 cast(o_orderkey AS double) * 12 AS us_chainage,
 CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE cast(o_orderkey AS double) * 12 + 12 END AS ds_chainage,
 12.0e0 AS joint_length_m, CASE o_orderstatus WHEN 'F' THEN 'X52' WHEN 'O' THEN 'X60' ELSE NULL END AS pipe_grade,
 cast(o_custkey % 12 AS string) || ':' || lpad(cast(o_orderkey % 60 AS string), 2, '0') AS seam_raw FROM orders""",
    "mdl": f"""SELECT 1000 + l_orderkey AS dig_id, l_orderkey AS target_girth_weld, 'L' || cast(l_suppkey % 3 AS string) AS line_id,
 CASE WHEN l_tax = 0 THEN 'missing' ELSE {_ID} || chr(10) || '-' END AS feature_ids,
 l_extendedprice / 250 / 25.4e0 AS length_in, l_discount * 1000 / 25.4e0 AS width_in FROM lineitem WHERE l_linenumber = 3""",
    "tml_source": """SELECT lpad(cast(l_suppkey AS string), 6, '0') AS equipment_id, 'G' || cast(l_partkey AS string) AS cml_group_id,
 cast(l_orderkey AS string) || '.' || cast(l_linenumber AS string) AS sub_cml_id,
 CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'N' THEN 'No' ELSE 'Yes - To be de-active' END AS aer_status,
 CASE WHEN l_linenumber = 4 THEN 0 WHEN l_linenumber = 5 THEN NULL ELSE l_quantity * 10 END AS corr_od,
 l_extendedprice / 100 AS corr_p,
 CASE WHEN l_tax < 0.03e0 THEN 0.8e0 WHEN l_tax < 0.06e0 THEN 0.72e0 ELSE NULL END AS design_factor,
 CASE WHEN l_linestatus = 'F' THEN 'E' WHEN l_quantity < 10 THEN NULL ELSE 'D' END AS piping_formula FROM lineitem""",
    "tml_full": """SELECT lpad(cast(l_suppkey AS string), 6, '0') AS equipment_id, 'G' || cast(l_partkey AS string) AS cml_group_id,
 cast(l_orderkey AS string) || '.' || cast(l_linenumber AS string) AS sub_cml_id,
 CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'N' THEN 'No' ELSE 'Yes - To be de-active' END AS aer_status,
 CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN '2022' ELSE 'N/A' END AS code_year,
 CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN '0' ELSE 'B31.' || cast(l_linenumber AS string) END AS design_code,
 CASE WHEN l_tax = 0 THEN NULL ELSE 'A' || cast(l_partkey % 200 AS string) END AS material,
 CASE WHEN l_discount = 0 THEN NULL WHEN l_linestatus = 'F' THEN 'B' ELSE '0.0' END AS grade,
 CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity - 10 END AS corr_t,
 CASE WHEN l_linenumber = 5 THEN 0e0 ELSE l_quantity / 4 END AS corr_nps,
 CASE WHEN l_linenumber = 6 THEN NULL ELSE cast(l_partkey % 3 * 40 AS string) END AS corr_schedule,
 CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 0.9e0 ELSE 1e0 END AS temperature_coefficient,
 CASE WHEN l_linenumber = 4 THEN NULL ELSE l_discount * 100 END AS corr_tnom,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax * 100 END AS corr_tmin,
 CASE l_linenumber % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN NULL ELSE 'True' END AS override_stress,
 CASE WHEN l_linestatus = 'F' THEN NULL WHEN l_linenumber = 1 THEN 0e0 ELSE l_quantity END AS smys,
 CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 0.85e0 ELSE 1e0 END AS joint_factor,
 CASE WHEN l_linenumber = 2 THEN 0e0 WHEN l_linenumber = 3 THEN NULL ELSE 0.5e0 END AS location_factor FROM lineitem""",
    "report_text": """SELECT concat('R', cast(o_orderkey AS string)) AS report, 1 AS page,
 concat('Circuit: 52-0', lpad(cast(o_custkey % 100 AS string), 2, '0'), 'K 1-2', chr(10), 'CML 1.0', cast(o_orderkey % 9 + 1 AS string), chr(10),
 'DATE: 02/', lpad(cast(o_orderkey % 28 + 1 AS string), 2, '0'), '/2026', chr(10), 'reading 0.', cast(200 + o_orderkey % 300 AS string), ' 0.', cast(250 + o_custkey % 700 AS string), ' Fax 780.79 0.9061') AS text FROM orders""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = re.search(r"FROM (\w+)", VIEWS[name])[1]
    return spark.sql(VIEWS[name].replace(f"FROM {base}", "FROM {base}"), base=table(spark, sf_dir, base))


def with_views(sql: str, *names: str) -> str:
    """DuckDB text: ``sql`` over those views."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + sql
