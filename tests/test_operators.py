"""Operators on small rows."""

import pytest
from pyspark.sql import functions as F

from integrity_spark.functions import reports as P
from integrity_spark.functions import scalars as S
from integrity_spark.operators import digs as D
from integrity_spark.operators import featuremap as M
from integrity_spark.operators import ingest as I
from integrity_spark.operators import joints as J
from integrity_spark.operators import readings as R
from integrity_spark.operators import tml as T
from integrity_spark.operators.quality import compare_ground_truth, histogram
from integrity_spark.sources.keywords import INSPECTION, merged, vendor_keywords


def values(spark, expr, texts, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_numbers_and_keys(spark):
    assert values(spark, S.to_number, ["1", " 2.5 ", "1e3", "1d", "nan", "", None, ".5", "x"]) == [1.0, 2.5, 1000.0, None, None, None, None, 0.5, None]
    assert values(spark, S.normalize_key, ["3180.0", " 3,180 ", "ab  c", "1.50", "", None, "2982520000000"]) == ["3180", "3180", "AB C", "1.5", "", "", "2982520000000"]
    assert values(spark, S.split_multivalue, ["1\n2\r\n-\n1\nN/A", None]) == [["1", "2"], None]
    assert values(spark, S.first_line, ["\n a \nb", " "]) == ["a", "-"]
    assert values(spark, S.valid_dig_id, ["6000", "1,234", "999", "GW 12", "-", "nan", None, "6000.5"]) == [True, True, False, True, False, False, False, False]
    assert values(spark, S.json_number, ["2.0", "2.5", "x"]) == ["2", "2.5", "x"]
    assert values(spark, S.collapsed, ["a  b ", None]) == ["a b", None]


def test_orientation(spark):
    assert values(spark, S.clock_to_hours, ["3:30", "08:22:10", "5.5", "x", "", None]) == [3.5, 8 + 22 / 60, 5.5, None, None, None]
    assert values(spark, S.clock_to_degrees, ["3:00", "90", "a:b"]) == [90.0, 90.0, None]
    assert values(spark, S.hours_to_clock, [8.37, 2.9999, 11.5], "double") == ["08:22", "03:00", "11:30"]


def test_dimensions(spark):
    rows = spark.createDataFrame([(25.4, 1.0), (12.7, 0.5), (25.4, 2.0), (12.7, 0.75), (1.0, 25.4)], "a double, b double")
    assert [r.v for r in rows.select(S.dimensions_match(F.col("a"), F.col("b")).alias("v")).collect()] == [True, True, False, False, True]


def test_weld_bounds(spark):
    anchors = spark.createDataFrame([("L", g, (g - 9) * 100.0) for g in range(10, 15)] + [("K", g, g * 10.0) for g in range(4, 9)], "line_id string, gwd_number long, chainage double")
    asked = spark.createDataFrame([("L", 12, None, None), ("L", 10, None, None), ("L", 99, None, None), ("K", None, 5, 7), ("K", None, 5, None)], "line_id string, center long, start long, end long")
    got = {(r.line_id, r.center, r.start, r.end): (r.lo, r.hi) for r in M.weld_bounds(anchors, asked).collect()}
    assert got == {("L", 12, None, None): (100.0, 500.0), ("L", 10, None, None): (100.0, 300.0), ("L", 99, None, None): (None, None), ("K", None, 5, 7): (50.0, 70.0), ("K", None, 5, None): (50.0, 80.0)}


def runs(spark):
    welds = [(w, "Girth Weld", f"W{k}", 3177 + k, None, None) for k, w in enumerate((940.0, 960.0, 980.0, 1000.0, 1020.0, 1040.0, 1060.0))]
    found = [(1005.0, "Metal Loss", "F-001", 3180, 25.4, 12.7), (1200.0, "Metal Loss", "F-002", 3200, 1.0, 0.5), (1010.0, "Metal Loss", "F-003", 3180, 1.0, 0.5)]
    return spark.createDataFrame([("L", "2022 RunA", *x) for x in welds + found], "line_id string, source string, chainage double, feature_type string, feature_id string, gwd_number long, length_mm double, width_mm double").withColumn("depth_pct", F.lit(40.0))


def test_dig_package(spark):
    mdl = spark.createDataFrame([(6000, 3180, "L", "F-001\n-", "25.4", "12.7"), (6001, 3180, "L", "gone", "25.4", "12.7"), (6002, 9999, "L", "F-001", None, None)], "dig_id long, target_girth_weld long, line_id string, feature_ids string, length_in string, width_in string")
    table = D.dig_feature_table(mdl, runs(spark)).cache()
    of = lambda d: {r.feature_id: r for r in table.where(F.col("dig_id") == d).collect()}
    one, two, three = of(6000), of(6001), of(6002)
    assert "F-002" not in one and one["F-001"].is_target and not one["F-003"].is_target
    assert one["F-001"].distance_m == pytest.approx(5.0) and one["F-001"].dig_no == 1
    assert two["F-001"].is_target and two["F-003"].is_target  # by size, in mm and in inches
    assert len(three) == 10 and three["F-001"].is_target  # weld not found: all rows
    assert {r.dig_id: r.targets for r in D.package_summary(mdl, table).collect()} == {6000: 1, 6001: 2, 6002: 1}
    skip = D.dig_feature_table(mdl, runs(spark), fallback="skip")
    assert skip.where("dig_id = 6002").count() == 0
    assert [r.dig_id for r in D.skipped_digs(mdl, skip).collect()] == [6002]


def test_weld_window_fallbacks(spark):
    no_welds = runs(spark).where("feature_type = 'Metal Loss'")
    target = spark.createDataFrame([(1, "L", "2022 RunA", 1000.0)], "dig_id long, line_id string, source string, target_chainage double")
    assert D.weld_window(target, no_welds).first()[-2:] == (970.0, 1030.0)
    assert D.weld_window(target, runs(spark)).first()[-2:] == (939.5, 1060.5)
    edge = spark.createDataFrame([(1, "L", "2022 RunA", 941.0)], "dig_id long, line_id string, source string, target_chainage double")
    assert D.weld_window(edge, runs(spark)).first()[-2:] == (910.5, 1000.5)


def test_feature_map_and_tally(spark):
    rows = spark.createDataFrame([("L", "s", "a", "Metal Loss", "10", None, "x", "3:30", "12"), ("L", "s", "b", "GWD", None, "1", "1", None, "13"), ("L", None, "g", "Girth Weld", "20", "1", "1", None, "14A")], "line_id string, source string, feature_id string, feature_type string, chainage string, depth_pct string, length_mm string, orientation_raw string, gwd_number string")
    got = {r.feature_id: r for r in M.feature_map(rows, "unknown").collect()}
    assert set(got) == {"a", "g"} and got["a"].orientation_hours == 3.5 and got["g"].orientation_hours == 6.0
    assert got["a"].length_mm == 0.0 and got["g"].gwd_label == "14A" and got["g"].gwd_number is None
    tally = spark.createDataFrame([("L", "1", 0.0, 12.0, "3:00"), ("L", "2", 12.0, None, None), ("L", "3", 24.0, 36.0, "4:00")], "line_id string, joint_number string, us_chainage double, ds_chainage double, seam_raw string").withColumn("joint_length_m", F.lit(12.0))
    j = M.feature_map(tally, "pipe_tally")
    assert {(r.chainage, r.label) for r in M.tally_girths(j, ["gwd_number"]).collect()} == {(0.0, "GWD 1"), (12.0, "GWD 2"), (24.0, "GWD 3"), (36.0, "DS end")}
    assert {(r.chainage_start, r.chainage_end, r.orientation_label) for r in M.tally_seams(j).collect()} == {(0.0, 12.0, "03:00"), (24.0, 36.0, "04:00")}
    assert M.chainage_window(j, 5.0, 13.0, "pipe_tally").count() == 2


def test_report_text(spark):
    readings = lambda t: values(spark, P.extract_readings, t)
    assert readings(["0.285 and 0.380, Fax 780.79 0.9061", "0 . 2 8 5", "1.250 2.2026 1.005", "", "780.790.1776"]) == [[0.285, 0.38], [0.285], [1.25], [], []]
    d = lambda t: [None if x is None else str(x) for x in values(spark, P.report_date, t)]
    assert d(["DATE: February 23, 2026", "DATE (MM/DD/YYYY): 02/23/2026", "DATE: FEB 23 2026", "DATE: 13/45/2026", "none"]) == ["2026-02-23"] * 3 + [None, None]
    assert values(spark, P.circuit_base, ["52-021K 1-2", "57-008U 1,3-3", "", None, "odd one"]) == ["52-021K", "57-008U", "Unknown", "Unknown", "odd one"]
    assert values(spark, P.cml_ids, ["CML 1.01 & 1.05", "CML:1.37, 1.29", "none"]) == [["1.01", "1.05"], ["1.37", "1.29"], []]


def test_many_reports(spark):
    pages = spark.createDataFrame([("A", 1, "Circuit: 52-021K 1-2\nCML 1.52, 1.29\nDATE: 02/23/2026"), ("B", 1, "Circuit: 57-008U 1-1\nCML 4.09\nreading 0.300 0.250"), ("C", 1, None)], "report string, page int, text string")
    rows = spark.createDataFrame([("A", 1, 1, 1, ["CIRCUIT", "CML", "ZONE"]), ("A", 1, 1, 2, ["1", '8"', "0.310", "0.290"]), ("A", 1, 1, 3, ["2", '6"', "0", ".2", "9 7"])], "report string, page int, table_no int, row_no int, cells array<string>")
    got = {(r.circuit_id, r.cml_id): r.min_reading for r in R.parse_many_reports(pages, rows).collect()}
    assert got == {("52-021K", "1.52-1"): 0.31, ("52-021K", "1.29-2"): 0.297, ("57-008U", "4.09-1"): 0.3, ("57-008U", "4.09-2"): 0.25}


def test_sequence_and_split(spark):
    rows = spark.createDataFrame([("r", "9.1", 1, None), ("r", "9.1", 2, 1), ("r", "9.1", 3, None), ("r", "9.1", 4, None)], "report string, cml_base string, row_no int, zone int")
    assert [r.zone for r in R.sequence_zones(rows).orderBy("row_no").collect()] == [1, 1, 2, 3]
    meta = lambda v: spark.createDataFrame([("r", "c", None, ["1.29", "1.37"], v)], "report string, circuit_id string, measurement_date date, cml_ids array<string>, readings array<double>")
    split = lambda v: [r.cml_id for r in R.split_readings_to_zones(meta(v)).collect()]
    assert split([0.3] * 5) == ["1.29-1", "1.29-2", "1.29-3", "1.37-1", "1.37-2"]
    assert split([0.3] * 6)[0] == "1.37-1" and split([0.3] * 5 + [0.2])[0] == "1.29-1" and len(split([0.3] * 14)) == 6
    assert split([0.3]) == []


def test_equipment(spark):
    readings = spark.createDataFrame([("52-021K", "1.01-1"), ("52-021K 1", "1.01-1"), ("99", "1"), ("5", "1")], "circuit_id string, cml_id string")
    source = spark.createDataFrame([(1, "52-021K", "E1", "1.01-1", "G1"), (2, "52-021K", "E2", "1.01-1", "G2")], "row_ord int, circuit_id string, equipment_id string, cml_id string, group_id string")
    got = {r.circuit_id: (r.equipment_id, r.group_id, r.status) for r in R.cml_to_group(R.circuit_to_equipment(readings, source, ["row_ord"]), source, ["row_ord"]).collect()}
    assert got == {"52-021K": ("E1", "G2", "OK"), "52-021K 1": ("E1", R.NO_GROUP, "missing group"), "99": (R.NO_EQUIPMENT, R.NO_GROUP, "missing equipment and group"), "5": ("E1", R.NO_GROUP, "missing group")}


def test_workflows(spark):
    cols = [T.EQUIPMENT, T.GROUP, T.SUB, T.STATUS_COLUMN, "Code Year (T-Min Formula)", "Override Allowable Stress", "CorrValue_P"]
    src = spark.createDataFrame([("001", "G", "1", "Yes", None, None, "2.5"), ("002", "G", "2", "Yes - To be de-active", "N/A", "True", "0"), ("003", "G", "3", "No", "2020", "true", None)], ", ".join(f"`{c}` string" for c in cols))
    n = lambda i: sorted(r[T.EQUIPMENT] for r in T.workflow(src, T.WORKFLOWS[i]).collect())
    assert n(1) == ["002"] and n(2) == ["001", "002"] and n(3) == ["001", "003"] and n(16) == ["001"] and n(12) == ["001"]
    assert T.workflow(src, T.WORKFLOWS[12]).first()["Design Pressure"] == "2"
    template = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in (*T.KEYS.values(), *T.CONSTANTS)))
    batch, failed = T.tml_batch(src, template, [1, 2, 9, 77])
    assert set(failed) == {9, 77} and {r.workflow_id: r.records for r in T.workflow_summary(batch, [1, 2, 77]).collect()} == {1: 1, 2: 2, 77: 0}
    with pytest.raises(ValueError):
        T.aer_filter(src.where("`Equipment ID` = '003'"))
    plan = T.normalize_plan({"file": "f", "workflow_ids": [9, 9, 2, 99], "mapping": {T.EQUIPMENT: "a"}})
    assert plan["workflow_ids"] == [2, 9] and "CorrValue_OD" in plan["missing"] and T.validate_plan(plan)[0] == "sheet is missing"
    assert "CorrValue_OD" not in T.refine_plan(plan, {"CorrValue_OD": "1"})["missing"]


def cells(spark, rows, file="f", sheet="s", ord_=1):
    out = [(file, sheet, ord_, r, c, v) for r, row in enumerate(rows, 1) for c, v in enumerate(row) if v is not None]
    return spark.createDataFrame(out, "file string, sheet string, sheet_ord int, row int, col int, value string")


def test_headers_after_a_banner(spark):
    head = ["Feature ID", "Description", "Length (mm)", "Width (mm)", "Peak Depth", "Orientation (hh:mm)", "ILI Chainage (m)", "Joint No. or US GW No."]
    c = cells(spark, [["2022 inspection"], head, ["F-1", "Metal Loss", "25.4", "12.7", "42", "03:30", "1000.5", "3150"], [None], ["F-2", "Metal Loss", "1", "1", "1", "1:00", "2", "3"], [None], [None], [None], ["late"]])
    rows = I.detect_header_row(c, INSPECTION)
    assert rows.first().header_row == 2
    found = I.resolve_columns(I.headers_at(c, rows), INSPECTION)
    at = {r.key: r.col for r in found.collect()}
    assert (at["feature_id"], at["length"], at["width"], at["depth"], at["orientation"], at["distance"], at["joint_number"]) == (0, 2, 3, 4, 5, 6, 7)
    got = I.named_table(I.cells_to_table(c, rows), found, ["feature_id", "depth", "pipe_grade"]).orderBy("row_ord").collect()
    assert [(r.feature_id, r.depth, r.pipe_grade) for r in got] == [("F-1", "42", None), ("F-2", "1", None)]
    assert I.detect_data_format(found, I.headers_at(c, rows)).first().data_format == "anomaly"


def test_sections_and_limits(spark):
    c = cells(spark, [["NDE limits"], ["NDE Assessment length", "9.0"], ["NDE Assessment Start from TGW", "-0.5"], ["NDE Assessment End from TGW", "8.5"], ["NDE Assessment Start from D/S GW", "99"], [None], ["Feature Summary"], ["ID", "Depth", "Length"], ["1", "2", "3"], ["4", "5", "6"], [None], ["x"]])
    lim = I.parse_nde_limits(c).first()
    assert (lim.length_m, lim.start_m, lim.end_m, lim.length_differs) == (9.0, -0.5, 8.5, False)
    sec = I.find_section(c, ["feature summary"]).first()
    assert (sec.title_row, sec.header_row, sec.first_row, sec.last_row) == (7, 8, 9, 10)


def test_small_ingest(spark):
    c = cells(spark, [["a", "a", "b"], ["1", "2", "3"]])
    heads = c.where("row = 1").select("file", "sheet", "col", F.col("value").alias("header"))
    assert [r.header for r in I.unique_headers(heads).orderBy("col").collect()] == ["a", "a__2", "b"] and I.dedupe_columns(heads).count() == 2
    text = spark.createDataFrame([("x", "depth\tlength\n1\t2"), ("y", "one")], "file string, text string")
    p = I.parse_delimited_text(text)
    assert p.count() == 4 and {r.name for r in I.promote_header(p).collect()} == {"depth", "length"}
    merged_cells = I.fill_merged(cells(spark, [["top", None], [None, "z"]]), spark.createDataFrame([("f", "s", 1, 0, 2, 0)], "file string, sheet string, r0 int, c0 int, r1 int, c1 int"))
    assert {(r.row, r.col, r.value) for r in merged_cells.collect()} == {(1, 0, "top"), (2, 0, "top"), (2, 1, "z")}
    df = spark.createDataFrame([("1", "2", "3")], "`Equip ID` string, `TML ID` string, extra string")
    assert I.canonical_columns(df, ["Equipment ID", "sub-CML ID"]).columns == ["Equipment ID", "sub-CML ID"]
    with pytest.raises(ValueError):
        I.canonical_columns(df, ["CML Group ID"])
    assert values(spark, I.infer_vendor, ["2022 TDW run", "BakerHughes EMAT", "line MFL-C", "emat 2020", "x", None]) == ["TDW", "BH-EMAT", "Rosen-MFLC", "Rosen-EMAT", "Rosen-MFLA", "Rosen-MFLA"]
    assert merged({"a": ["X", "y"]}, {"a": ["Y"]}) == {"a": ["Y", "X"]} and vendor_keywords("TDW")[1][0] == "Pipetally"


def test_joint_summary(spark):
    m = J.unpivot_joint_matrix(spark.createDataFrame([("p", 0, c, v) for c, v in enumerate(["Metric", "Source", "3179", "3180", "3181"])] + [("p", 1, c, v) for c, v in enumerate(["Seam Orientation (hh:mm)", "2022 Alpha Tool", "3:00", "4:30", "x"])] + [("p", 2, c, v) for c, v in enumerate(["Joint length (m)", "", "12", "12", "12"])], "program_id string, row int, col int, value string"))
    assert {(r.gwd, r.source, r.hours) for r in m.collect()} == {(3179, "2022 Alpha Tool", 3.0), (3180, "2022 Alpha Tool", 4.5)}
    assert values(spark, J.label_sources, ["Seam (hh:mm) (Alpha Tool) (Beta Tool)", "Seam\nRun C longer\nrun c longer", "x"]) == [["Alpha Tool", "Beta Tool"], ["Run C longer"], []]
    assert values(spark, J.gwd_from_text, ["3180__2", "GWD 3180", "12", "99999"]) == [3180, 3180, None, None]
    fs = spark.createDataFrame([("p", "2022 Alpha MFL-A"), ("p", "none")], "program_id string, source string")
    js = spark.createDataFrame([("p", "2025 Beta", 0), ("p", "2022 Alpha", 1)], "program_id string, source string, ord int")
    assert {r.feature_source: r.joint_source for r in J.match_source_names(fs, js).collect()} == {"2022 Alpha MFL-A": "2022 Alpha", "none": "2025 Beta"}
    welds = spark.createDataFrame([("p", "s", 100), ("p", "s", 112), ("p", "s", 140)], "program_id string, source string, gwd long")
    seams = spark.createDataFrame([("p", "s", 101, 3.0), ("p", "s", 110, 4.0)], "program_id string, source string, gwd long, hours double")
    assert {r.gwd: r.seam_hours for r in J.seam_for_weld(welds, seams).collect()} == {100: 3.0, 112: 4.0, 140: None}


def test_four_weld_layout(spark):
    order = spark.createDataFrame([("p", g, k, False) for k, g in enumerate((3179, 3180, 3181, 3182))], "program_id string, gwd long, ord int, is_target boolean")
    lengths = spark.createDataFrame([("p", g, n) for g, n in ((3179, 11.0), (3180, 12.0), (3181, 13.0))], "program_id string, gwd long, length_m double")
    matrix = spark.createDataFrame([("p", "s", 3179, 3.0), ("p", "s", 3181, 5.0)], "program_id string, source string, gwd long, hours double")
    girths, seams = J.tgw_layout(order, lengths, matrix)
    assert {r.gwd: r.chainage for r in girths.collect()} == {3179: -11.0, 3180: 0.0, 3181: 12.0, 3182: 25.0}
    assert {(r.chainage_start, r.orientation_label) for r in seams.collect()} == {(-11.0, "03:00"), (0.0, "03:00"), (12.0, "05:00")}


def test_comparisons(spark):
    got = spark.createDataFrame([("c", "1", 0.30), ("c", "2", 0.50)], "circuit_id string, cml_id string, min_reading double")
    exp = spark.createDataFrame([("c", "1", True, None, 0.305), ("c", "2", True, 0.2, 0.5), ("c", "3", True, None, 0.1), ("c", "4", False, None, 0.1)], "circuit_id string, cml_id string, is_correct boolean, corrected_reading double, min_reading double")
    assert {r.cml_id: r.problem for r in compare_ground_truth(got, exp).collect()} == {"1": None, "2": "different", "3": "missing"}
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    h = histogram(flat, "v", 4).orderBy("bin").collect()
    assert [r.n for r in h] == [0, 0, 2, 0] and h[0].edge_lo == 0.5
