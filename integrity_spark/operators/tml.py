"""Loader workflows over thickness-monitoring rows: 20 specifications of one operator, template union, combined output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import to_number

# Key columns, constants and texts of the loader format.
EQUIPMENT, GROUP, SUB = "Equipment ID", "CML Group ID", "sub-CML ID"
KEYS = {EQUIPMENT: EQUIPMENT, GROUP: "TML Group ID", SUB: "TML_ID"}
STATUS_COLUMN, ACTIVE = "AER_Status_CML", "Yes"
CONSTANTS = {"CMMS System": "P1R-100", "TML Analysis Type": "TML"}
FOLLOW_UP = "Follow up TML Flag - intended for AER section CML"


@dataclass(frozen=True)
class Spec:
    """Keep rows of ``column`` by ``rule`` (contains, differs, present) and give ``output`` the value or ``constant``."""

    id: int
    column: str
    rule: str
    argument: str | float | None
    output: str
    constant: str | float | None = None
    more: tuple[tuple[str, str], ...] = ()
    whole_number: bool = False
    also_all: bool = False


# The 20 workflows.
WORKFLOWS = {s.id: s for s in (
    Spec(1, STATUS_COLUMN, "contains", "To be de-active", "Status Indicator", "Inactive"),
    Spec(2, STATUS_COLUMN, "contains", "Yes", "Follow Up TML", "True", (("TML Comment", FOLLOW_UP),)),
    Spec(3, "Code Year (T-Min Formula)", "differs", "N/A", "Code Year (T-Min Formula)", "N/A"),
    Spec(4, "CorrValue_Design_Code", "present", None, "Design Code"),
    Spec(5, "CorrValue_Material", "present", None, "Material Specification"),
    Spec(6, "CorrValue_Grade", "present", None, "Material Grade"),
    Spec(7, "CorrValue_T", "present", None, "Design Temperature"),
    Spec(8, "Piping Formula", "differs", "E", "Piping Formula", "E"),
    Spec(9, "CorrValue_OD", "present", None, "Outside Diameter"),
    Spec(10, "CorrValue_NPS", "present", None, "Piping Nominal Diameter - NPS"),
    Spec(11, "CorrValue_Schedule", "present", None, "Schedule"),
    Spec(12, "CorrValue_P", "present", None, "Design Pressure", whole_number=True),
    Spec(13, "Temperature Coefficient", "differs", 1.0, "Temperature Factor", "1"),
    Spec(14, "CorrValue_Tnom", "present", None, "TNominal Thickness"),
    Spec(15, "CorrValue_Tmin", "present", None, "Minimum Thickness"),
    Spec(16, "Override Allowable Stress", "differs", "True", "Override Allowable Stress", "True"),
    Spec(17, "AER_SMYS", "present", None, "Allowable Stress", also_all=True),
    Spec(18, "Design Factor", "differs", 0.8, "Design Factor", "0.8"),
    Spec(19, "Joint Factor", "differs", 1.0, "Joint Factor", "1"),
    Spec(20, "CorrValue_LocFactor", "present", None, "Location Factor"),
)}


def filter_records(df: DataFrame, column: str, condition: str, constants: Mapping[str, object] | None = None) -> DataFrame:
    rules = {"not_empty": F.col(f"`{column}`").isNotNull(), "empty": F.col(f"`{column}`").isNull(), "True": F.col(f"`{column}`").cast("boolean"), "False": ~F.col(f"`{column}`").cast("boolean")}
    if condition not in rules:
        raise ValueError(f"unknown filter condition {condition!r}")
    return df.where(F.coalesce(rules[condition], F.lit(False))).withColumns({k: F.lit(v) for k, v in (constants or {}).items()})


def aer_filter(source: DataFrame, check: bool = True) -> DataFrame:
    """Rows whose status contains ``Yes``; a missing column or an empty result is an error."""
    if STATUS_COLUMN not in source.columns:
        raise ValueError(f"column {STATUS_COLUMN!r} is missing; found {source.columns}")
    out = source.where(F.coalesce(F.col(STATUS_COLUMN).cast("string").contains(ACTIVE), F.lit(False)))
    if check and not out.head(1):
        raise ValueError(f"no row has {ACTIVE!r} in {STATUS_COLUMN!r}")
    return out


def keeps(spec: Spec) -> Column:
    """Missing values are kept by ``differs``, as unequal."""
    value = F.col(f"`{spec.column}`")
    text = value.cast("string")
    if spec.rule == "contains":
        return F.coalesce(text.contains(str(spec.argument)), F.lit(False))
    if spec.rule == "present":
        return value.isNotNull() & ~F.coalesce(to_number(text) == 0, F.lit(False))
    if isinstance(spec.argument, float):
        return ~to_number(text).eqNullSafe(F.lit(spec.argument))
    return ~F.coalesce(F.lower(text) == "true" if spec.argument == "True" else text == str(spec.argument), F.lit(False))


def workflow(source: DataFrame, spec: Spec, everything: bool = False) -> DataFrame:
    """New loader rows of one workflow: keys under loader names, the output columns as text."""
    missing = [c for c in (*KEYS, spec.column) if c not in source.columns]
    if missing:
        raise ValueError(f"workflow {spec.id} lacks columns {missing}")
    value = F.col(f"`{spec.column}`")
    if spec.whole_number:
        value = F.bround(to_number(value), 0).cast("bigint")
    shown = F.lit(str(spec.constant)) if spec.constant is not None else value.cast("string")
    rows = source if everything else source.where(keeps(spec))
    return rows.select(*(F.col(f"`{a}`").cast("string").alias(b) for a, b in KEYS.items()), shown.alias(spec.output), *(F.lit(v).alias(k) for k, v in spec.more))


def workflow_outputs(source: DataFrame, spec: Spec) -> dict[str, DataFrame]:
    """The outputs of one workflow by name: its own, and for ``also_all`` one of every row, without the filter."""
    outputs = {spec.output: workflow(source, spec)}
    return outputs | ({f"{spec.output} (all)": workflow(source, spec, everything=True)} if spec.also_all else {})


def with_template(template: DataFrame, rows: DataFrame) -> DataFrame:
    """Template rows, then the new ones with the loader constants; ``is_template`` and ``seq`` tell them apart."""
    new = rows.withColumns({k: F.lit(v) for k, v in CONSTANTS.items()})
    return template.withColumn("is_template", F.lit(True)).unionByName(new.withColumn("is_template", F.lit(False)), allowMissingColumns=True)


def append_assets(template: DataFrame, rows: DataFrame) -> DataFrame:
    """Template assets and the distinct equipment of the rows, each full row once."""
    new = rows.select(EQUIPMENT).distinct().withColumn("CMMS System", F.lit(CONSTANTS["CMMS System"]))
    return template.unionByName(new, allowMissingColumns=True).dropDuplicates()


def distinct_assets(rows: DataFrame) -> DataFrame:
    return rows.select(EQUIPMENT).dropDuplicates([EQUIPMENT])


def combine_outputs(frames: Sequence[DataFrame]) -> DataFrame:
    """New rows only, of all workflows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.where("NOT is_template").drop("is_template")


def combine_assets(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One asset row for each equipment, the first by ``order``."""
    by = W.partitionBy(EQUIPMENT).orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in order))
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def long_batch(source: DataFrame, ids: Sequence[int]) -> DataFrame:
    """All workflows in one pass over the source: each row is read once and yields an array of the workflows that keep
    it. Columns: keys, ``workflow_id``, ``output``, ``value``. Workflows whose columns are missing yield nothing."""
    specs = [WORKFLOWS[i] for i in ids if i in WORKFLOWS and WORKFLOWS[i].column in source.columns]
    if not specs:
        raise ValueError("no workflow can run on these columns")

    def one(s: Spec) -> Column:
        value = F.col(f"`{s.column}`")
        if s.whole_number:
            value = F.bround(to_number(value), 0).cast("bigint")
        shown = F.lit(str(s.constant)) if s.constant is not None else value.cast("string")
        return F.when(keeps(s), F.struct(F.lit(s.id).alias("workflow_id"), F.lit(s.output).alias("output"), shown.alias("value")))

    each = F.explode(F.filter(F.array(*map(one, specs)), lambda x: x.isNotNull()))
    return source.select(*(F.col(f"`{a}`").cast("string").alias(b) for a, b in KEYS.items()), each.alias("w")).select(*KEYS.values(), "w.*")


def tml_batch(source: DataFrame, template: DataFrame, ids: Sequence[int]) -> tuple[DataFrame, dict[int, str]]:
    """Combined new rows of the workflows that can run on the active rows, and why others didn't; none is an error."""
    active, frames, failed = aer_filter(source), [], {}
    for i in ids:
        if i not in WORKFLOWS:
            failed[i] = "unknown workflow"
            continue
        try:
            frames.append(with_template(template, workflow(active, WORKFLOWS[i]).withColumn("workflow_id", F.lit(i))))
        except ValueError as e:
            failed[i] = str(e)
    if not frames:
        raise ValueError("no workflow was processed")
    return combine_outputs(frames), failed


def workflow_summary(batch: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Records of every asked workflow, 0 for those without output."""
    asked = batch.sparkSession.createDataFrame([(i,) for i in ids], "workflow_id int")
    counts = batch.groupBy("workflow_id").agg(F.count("*").alias("records"))
    return asked.join(counts, "workflow_id", "left").fillna(0, ["records"])


def deactivate_all(source: DataFrame) -> DataFrame:
    """Every row inactive, no filter."""
    return source.select(*(F.col(f"`{a}`").cast("string").alias(b) for a, b in KEYS.items()), F.lit("Inactive").alias("Status Indicator"))


def needed_columns(ids: Sequence[int]) -> list[str]:
    return list(dict.fromkeys([EQUIPMENT, GROUP, SUB, STATUS_COLUMN, *(WORKFLOWS[i].column for i in ids if i in WORKFLOWS)]))


def assemble_source(df: DataFrame, mapping: Mapping[str, str], constants: Mapping[str, object], ids: Sequence[int]) -> DataFrame:
    """Rename by ``mapping`` (canonical name -> column), add what is missing from constants or as empty text; ids
    that read nan or None become empty."""
    cols = {}
    for name in needed_columns(ids):
        given = mapping.get(name)
        if given in df.columns:
            cols[name] = F.col(f"`{given}`").cast("string")
        elif name in df.columns:
            cols[name] = F.col(f"`{name}`").cast("string")
        else:
            cols[name] = F.lit(str(constants.get(name, "")))
    for key in (EQUIPMENT, GROUP, SUB):
        cols[key] = F.when(cols[key].isNull() | F.lower(F.trim(cols[key])).isin("nan", "none"), "").otherwise(cols[key])
    return df.select(*(c.alias(n) for n, c in cols.items()))


def missing_columns(mapping: Mapping[str, str], constants: Mapping[str, object], ids: Sequence[int]) -> list[str]:
    return [c for c in needed_columns(ids) if c not in mapping and c not in constants]


def normalize_plan(plan: Mapping[str, object]) -> dict:
    """Known workflow ids, sorted and once each; empty mappings for what isn't given; what is still missing."""
    ids = sorted({int(i) for i in plan.get("workflow_ids", ()) if str(i).isdigit() and int(i) in WORKFLOWS})
    mapping, constants = dict(plan.get("mapping") or {}), dict(plan.get("constants") or {})
    return {"file": plan.get("file"), "sheet": plan.get("sheet"), "workflow_ids": ids, "mapping": mapping, "constants": constants, "missing": missing_columns(mapping, constants, ids)}


def refine_plan(plan: Mapping[str, object], answers: Mapping[str, object]) -> dict:
    return normalize_plan({**plan, "constants": {**dict(plan.get("constants") or {}), **answers}})


def validate_plan(plan: Mapping[str, object]) -> list[str]:
    out = [f"{k} is missing" for k in ("file", "sheet") if not plan.get(k)]
    return out + ([] if plan.get("workflow_ids") else ["no workflow"]) + [f"column {c!r} has neither a mapping nor a constant" for c in plan.get("missing", ())]


def normalized_plans(plans: DataFrame) -> DataFrame:
    """Many plans at once, ``(file, sheet, workflow_ids array, mapping map, constants map)`` and any other columns: known ids, sorted and once
    each; empty maps for those not given; ``missing``, the columns that neither map has, in the order of the spine and the workflows."""
    known = F.create_map(*(F.lit(x) for i, w in WORKFLOWS.items() for x in (i, w.column)))
    ids = F.array_sort(F.array_distinct(F.filter(F.coalesce("workflow_ids", F.array().cast("array<int>")), lambda i: i.isNotNull() & F.map_contains_key(known, i))))
    empty = F.create_map().cast("map<string,string>")
    spine = F.array(*map(F.lit, (EQUIPMENT, GROUP, SUB, STATUS_COLUMN)))
    own = plans.withColumns({"workflow_ids": ids, "mapping": F.coalesce("mapping", empty), "constants": F.coalesce("constants", empty)})
    needed = F.array_distinct(F.concat(spine, F.transform("workflow_ids", lambda i: F.try_element_at(known, i))))
    return own.withColumn("missing", F.array_except(needed, F.concat(F.map_keys("mapping"), F.map_keys("constants"))))


def refined_plans(plans: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Plans with the constants that users answered, ``(key, name, value)``; a later answer to one name is an error of the caller."""
    given = answers.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("__given"))
    met = plans.join(given.hint("merge"), key, "left")
    old = F.map_filter("constants", lambda k, _: ~F.map_contains_key("__given", k))
    return normalized_plans(met.withColumn("constants", F.when(F.col("__given").isNull(), F.col("constants")).otherwise(F.map_concat(F.coalesce(old, F.create_map().cast("map<string,string>")), "__given"))).drop("__given"))


def plan_problems(plans: DataFrame) -> Column:
    """What is wrong with each normalized plan, in order."""
    said = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c} is missing")) for c in ("file", "sheet")] + [F.when(F.size("workflow_ids") == 0, F.lit("no workflow"))]
    columns = F.transform("missing", lambda c: F.concat(F.lit("column '"), c, F.lit("' has neither a mapping nor a constant")))
    return F.concat(F.filter(F.array(*said), lambda x: x.isNotNull()), columns)
