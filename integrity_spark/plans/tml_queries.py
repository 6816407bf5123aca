"""Loader workflows over the thickness-monitoring view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tml as T
from ..sources.fixtures import view
from .registry import query

RENAMED = {"equipment_id": T.EQUIPMENT, "cml_group_id": T.GROUP, "sub_cml_id": T.SUB, "aer_status": T.STATUS_COLUMN, "corr_od": "CorrValue_OD", "corr_p": "CorrValue_P", "design_factor": "Design Factor", "piping_formula": "Piping Formula"}
IDS = (1, 2, 8, 9, 12, 18)
V = ("tml_source",)


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tml_source").withColumnsRenamed(RENAMED)


def template(spark: SparkSession) -> DataFrame:
    cols = ", ".join(f"`{c}` string" for c in (*T.KEYS.values(), *T.CONSTANTS))
    return spark.createDataFrame([], cols)


_KEY = "equipment_id, cml_group_id AS tml_group_id, sub_cml_id AS tml_id"
_EACH = {
    1: ("Status Indicator", "'Inactive'", "contains(aer_status, 'To be de-active')"),
    2: ("Follow Up TML", "'True'", "contains(aer_status, 'Yes')"),
    8: ("Piping Formula", "'E'", "piping_formula IS DISTINCT FROM 'E'"),
    9: ("Outside Diameter", "cast(corr_od AS varchar)", "corr_od IS NOT NULL AND corr_od <> 0"),
    12: ("Design Pressure", "cast(cast(round_even(corr_p, 0) AS bigint) AS varchar)", "corr_p IS NOT NULL AND corr_p <> 0"),
    18: ("Design Factor", "'0.8'", "design_factor IS DISTINCT FROM 0.8e0"),
}


def _short(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({T.EQUIPMENT: "equipment_id", "TML Group ID": "tml_group_id", "TML_ID": "tml_id"})


def _workflow_query(i: int) -> None:
    output, value, cond = _EACH[i]
    name = output.lower().replace(" ", "_")

    @query(f"SELECT {_KEY}, {value} AS {name} FROM tml_source WHERE {cond}", V, f"tml_workflow_{i:02d}_{name}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _short(T.workflow(source(spark, sf_dir), T.WORKFLOWS[i])).select("equipment_id", "tml_group_id", "tml_id", F.col(f"`{output}`").alias(name))


for _i in _EACH:
    _workflow_query(_i)

FULL = {
    "equipment_id": T.EQUIPMENT, "cml_group_id": T.GROUP, "sub_cml_id": T.SUB, "aer_status": T.STATUS_COLUMN, "code_year": "Code Year (T-Min Formula)", "design_code": "CorrValue_Design_Code", "material": "CorrValue_Material",
    "grade": "CorrValue_Grade", "corr_t": "CorrValue_T", "corr_nps": "CorrValue_NPS", "corr_schedule": "CorrValue_Schedule", "temperature_coefficient": "Temperature Coefficient", "corr_tnom": "CorrValue_Tnom", "corr_tmin": "CorrValue_Tmin",
    "override_stress": "Override Allowable Stress", "smys": "AER_SMYS", "joint_factor": "Joint Factor", "location_factor": "CorrValue_LocFactor",
}
_NUMBER = "{0} IS NOT NULL AND {0} <> 0"
_TEXT = "{0} IS NOT NULL AND coalesce(try_cast({0} AS double) <> 0, true)"
_MORE = {
    3: ("Code Year (T-Min Formula)", "'N/A'", "code_year IS DISTINCT FROM 'N/A'"),
    4: ("Design Code", "design_code", _TEXT.format("design_code")),
    5: ("Material Specification", "material", _TEXT.format("material")),
    6: ("Material Grade", "grade", _TEXT.format("grade")),
    7: ("Design Temperature", "cast(corr_t AS varchar)", _NUMBER.format("corr_t")),
    10: ("Piping Nominal Diameter - NPS", "cast(corr_nps AS varchar)", _NUMBER.format("corr_nps")),
    11: ("Schedule", "corr_schedule", _TEXT.format("corr_schedule")),
    13: ("Temperature Factor", "'1'", "temperature_coefficient IS DISTINCT FROM 1e0"),
    14: ("TNominal Thickness", "cast(corr_tnom AS varchar)", _NUMBER.format("corr_tnom")),
    15: ("Minimum Thickness", "cast(corr_tmin AS varchar)", _NUMBER.format("corr_tmin")),
    16: ("Override Allowable Stress", "'True'", "lower(override_stress) IS DISTINCT FROM 'true'"),
    17: ("Allowable Stress", "cast(smys AS varchar)", _NUMBER.format("smys")),
    19: ("Joint Factor", "'1'", "joint_factor IS DISTINCT FROM 1e0"),
    20: ("Location Factor", "cast(location_factor AS varchar)", _NUMBER.format("location_factor")),
}


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tml_full").withColumnsRenamed(FULL)


def _full_query(i: int, output: str, sql: str, suffix: str = "") -> None:
    @query(sql, ("tml_full",), f"tml_workflow_{i:02d}{suffix}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = T.WORKFLOWS[i]
        made = T.workflow_outputs(full(spark, sf_dir), spec)[output]
        return _short(made).select("equipment_id", "tml_group_id", "tml_id", F.col(f"`{spec.output}`").alias("value"))


for _i, (_o, _v, _c) in _MORE.items():
    _full_query(_i, _o, f"SELECT {_KEY}, {_v} AS value FROM tml_full WHERE {_c}")
_full_query(17, "Allowable Stress (all)", f"SELECT {_KEY}, cast(smys AS varchar) AS value FROM tml_full", "_all")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT {_KEY}, {i} AS workflow_id, '{o}' AS output, {v} AS value FROM tml_full WHERE contains(aer_status, 'Yes') AND {c}" for i, (o, v, c) in _MORE.items()) + ")", ("tml_full",))
def tml_full_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined rows of fourteen workflows, values and all, through a template that holds a row of its own."""
    own = spark.createDataFrame([("old", "G0", "0.0")], f"`{T.EQUIPMENT}` string, `TML Group ID` string, `TML_ID` string")
    active, frames = T.aer_filter(full(spark, sf_dir), check=False), []
    for i in _MORE:
        spec = T.WORKFLOWS[i]
        rows = T.workflow(active, spec).withColumn("value", F.col(f"`{spec.output}`")).withColumns({"workflow_id": F.lit(i), "output": F.lit(spec.output)})
        frames.append(T.with_template(own, rows.select(*T.KEYS.values(), "workflow_id", "output", "value")))
    return _short(T.combine_outputs(frames)).select("equipment_id", "tml_group_id", "tml_id", "workflow_id", "output", "value")


@query("SELECT 'old' AS equipment_id, 'kept' AS cmms_system UNION SELECT equipment_id, 'P1R-100' FROM tml_full WHERE contains(aer_status, 'Yes') AND smys IS NOT NULL AND smys <> 0", ("tml_full",))
def tml_appended_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template's own asset stays beside the new ones."""
    own = spark.createDataFrame([("old", "kept")], f"`{T.EQUIPMENT}` string, `CMMS System` string")
    rows = T.workflow(T.aer_filter(full(spark, sf_dir), check=False), T.WORKFLOWS[17])
    return T.append_assets(own, rows).withColumnsRenamed({T.EQUIPMENT: "equipment_id", "CMMS System": "cmms_system"})


@query("SELECT DISTINCT equipment_id FROM tml_full WHERE contains(aer_status, 'Yes')", ("tml_full",))
def tml_distinct_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.distinct_assets(T.aer_filter(full(spark, sf_dir), check=False)).withColumnRenamed(T.EQUIPMENT, "equipment_id")


@query("SELECT condition, count(*) AS n FROM (SELECT unnest(list_filter(['not_empty', 'empty', 'True', 'False'], lambda c: CASE c WHEN 'not_empty' THEN override_stress IS NOT NULL WHEN 'empty' THEN override_stress IS NULL WHEN 'True' THEN coalesce(lower(override_stress) = 'true', false) ELSE coalesce(lower(override_stress) = 'false', false) END)) AS condition FROM tml_full) GROUP BY condition", ("tml_full",))
def tml_filter_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four conditions."""
    rows = full(spark, sf_dir)
    made = [T.filter_records(rows, "Override Allowable Stress", c, {"condition": c}).select("condition") for c in ("not_empty", "empty", "True", "False")]
    return made[0].union(made[1]).union(made[2]).union(made[3]).groupBy("condition").agg(F.count("*").alias("n"))


_BATCH = " UNION ALL ".join(f"SELECT {_KEY}, {i} AS workflow_id, '{o}' AS output, {v} AS value FROM tml_source WHERE contains(aer_status, 'Yes') AND {c}" for i, (o, v, c) in _EACH.items())


@query(_BATCH, V)
def tml_long_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All workflows that the columns allow, in one pass over the active rows."""
    return _short(T.long_batch(T.aer_filter(source(spark, sf_dir), check=False), IDS))


@query(f"SELECT workflow_id, count(*) AS records FROM ({_BATCH}) GROUP BY workflow_id UNION ALL SELECT 99, 0", V)
def tml_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, _failed = T.tml_batch(source(spark, sf_dir), template(spark), (*IDS, 99))
    return T.workflow_summary(batch, (*IDS, 99))


@query("SELECT DISTINCT equipment_id, 'P1R-100' AS cmms_system FROM tml_source WHERE contains(aer_status, 'Yes')", V)
def tml_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], f"`{T.EQUIPMENT}` string, `CMMS System` string")
    rows = T.workflow(T.aer_filter(source(spark, sf_dir), check=False), T.WORKFLOWS[2])
    return T.append_assets(empty, rows).withColumnsRenamed({T.EQUIPMENT: "equipment_id", "CMMS System": "cmms_system"})


@query("SELECT equipment_id, min(tml_id) AS tml_id FROM (SELECT equipment_id, sub_cml_id AS tml_id FROM tml_source) GROUP BY equipment_id", V)
def tml_combined_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset a piece of equipment, the first by id."""
    return _short(T.combine_assets(T.deactivate_all(source(spark, sf_dir)), ["TML_ID"])).select("equipment_id", "tml_id")


@query(f"SELECT {_KEY}, 'Inactive' AS status_indicator FROM tml_source", V)
def tml_deactivate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(T.deactivate_all(source(spark, sf_dir))).withColumnRenamed("Status Indicator", "status_indicator")


@query("SELECT equipment_id, cml_group_id, sub_cml_id, 'Yes' AS aer_status, cast(corr_od AS varchar) AS od, '' AS nps FROM tml_source", V)
def tml_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loader source from differently named columns, with a constant and an absent column."""
    raw = view(spark, sf_dir, "tml_source").drop("aer_status")
    made = T.assemble_source(raw, {T.EQUIPMENT: "equipment_id", T.GROUP: "cml_group_id", T.SUB: "sub_cml_id", "CorrValue_OD": "corr_od"}, {T.STATUS_COLUMN: "Yes"}, (9, 10))
    return made.withColumnsRenamed({T.EQUIPMENT: "equipment_id", T.GROUP: "cml_group_id", T.SUB: "sub_cml_id", T.STATUS_COLUMN: "aer_status", "CorrValue_OD": "od", "CorrValue_NPS": "nps"})


@query("SELECT count(*) AS n, 'x' AS flag FROM tml_source WHERE corr_od IS NULL", V)
def tml_filter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.filter_records(source(spark, sf_dir), "CorrValue_OD", "empty", {"flag": "x"}).groupBy("flag").agg(F.count("*").alias("n"))
