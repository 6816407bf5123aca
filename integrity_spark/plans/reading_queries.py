"""Readings out of report text, and their loader joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reports as P
from ..operators import readings as R
from ..operators.quality import compare_ground_truth
from ..sources.fixtures import table, view
from .registry import query

V = ("report_text",)
ORDER = ["row_ord"]
_CIRCUIT = "regexp_extract(text, 'Circuit: ([0-9]+-[0-9A-Za-z]+)', 1)"
_CML = "regexp_extract(text, 'CML ([0-9.]+)', 1)"
_DATE = "strftime(make_date(2026, 2, cast(regexp_extract(text, 'DATE: 02/([0-9]+)/', 1) AS bigint)), '%Y-%m-%d')"
_VALUES = "list_filter(list_transform(regexp_extract_all(regexp_extract(text, 'reading ([0-9. ]+) Fax', 1), '0\\.[0-9]{2,4}'), lambda x: cast(x AS double)), lambda v: v BETWEEN 0.05 AND 3.0 AND NOT v BETWEEN 0.904 AND 0.908)"


def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading row a report: circuit, CML, lowest value."""
    meta = R.report_metadata(view(spark, sf_dir, "report_text"))
    return R.aggregate_readings(meta)


@query(f"SELECT report, {_CIRCUIT} AS circuit_id, {_DATE} AS measurement_date, {_CML} AS cml, list_min({_VALUES}) AS lowest, cast(len({_VALUES}) AS integer) AS n FROM report_text", V)
def report_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.report_metadata(view(spark, sf_dir, "report_text"))
    return m.select("report", "circuit_id", F.date_format("measurement_date", "yyyy-MM-dd").alias("measurement_date"), F.array_join("cml_ids", ",").alias("cml"), F.array_min("readings").alias("lowest"), F.size("readings").alias("n"))


@query("SELECT report, page FROM report_text", V)
def summary_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary_pages(view(spark, sf_dir, "report_text")).select("report", "page")


@query(f"SELECT report, {_CIRCUIT} AS circuit_id, {_CML} || '-1' AS cml_id, list_min({_VALUES}) AS min_reading FROM report_text", V)
def aggregate_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir).select("report", "circuit_id", "cml_id", "min_reading")


_SINGLE = f"SELECT report, {_CIRCUIT} AS circuit_id, {_CML} || '-1' AS cml_id, list_min({_VALUES}) AS min_reading FROM report_text"


@query(f"SELECT circuit_id, cml_id, min(min_reading) AS min_reading, min_by(report, (min_reading, report)) AS report FROM ({_SINGLE}) GROUP BY circuit_id, cml_id", V)
def min_reading_per_cml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.min_reading_per_cml(single(spark, sf_dir), ["report"]).select("circuit_id", "cml_id", "min_reading", "report")


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table a report: one row per line item, zone in front, the thickness from its quantity."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")).select(F.concat(F.lit("R"), F.col("l_orderkey").cast("string")).alias("report"), F.lit(1).alias("page"), F.lit(1).alias("table_no"), F.col("l_linenumber").alias("row_no"), F.array(F.col("l_linenumber").cast("string"), F.lit('6"'), F.format_string("%.3f", F.lit(0.2) + F.col("q") / 1000)).alias("cells"))


_ROWS = "SELECT 'R' || cast(l_orderkey AS varchar) AS report, l_linenumber AS z, round(0.2e0 + max(l_quantity) / 1000, 3) AS v FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _table_query(name: str, parse) -> None:
    @query(f"SELECT r.report, {_CIRCUIT} AS circuit_id, {_CML} || '-' || cast(z AS varchar) AS cml_id, v AS min_reading FROM ({_ROWS}) r JOIN report_text t ON t.report = r.report", V, name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        meta = R.report_metadata(view(spark, sf_dir, "report_text"))
        return parse(report_rows(spark, sf_dir), meta).select("report", "circuit_id", "cml_id", "min_reading")


for _name, _parse in (("parse_summary_rows", R.parse_summary_rows), ("parse_diameter_rows", R.parse_diameter_rows), ("parse_permissive_rows", R.parse_permissive_rows), ("parse_zone_rows", R.parse_zone_rows)):
    _table_query(_name, _parse)


@query()
def parse_many_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy over all reports; checked by tests on small rows."""
    return R.parse_many_reports(view(spark, sf_dir, "report_text"), report_rows(spark, sf_dir)).select("report", "circuit_id", "cml_id", "min_reading", "strategy")


def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two CMLs and six readings a report, from its own numbers."""
    o = table(spark, sf_dir, "orders")
    v = F.array(*(F.round(F.lit(0.3) + (F.col("o_orderkey") + k) % 90 / 1000, 3) for k in range(6)))
    return o.select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("report"), F.lit("52-001A").alias("circuit_id"), F.lit(None).cast("date").alias("measurement_date"), F.array(F.lit("1.29"), F.lit("1.37")).alias("cml_ids"), v.alias("readings"))


@query("SELECT 'R' || cast(o_orderkey AS varchar) AS report, CASE WHEN k < 3 THEN '1.37' ELSE '1.29' END || '-' || cast(k % 3 + 1 AS varchar) AS cml_id, round(0.3e0 + (o_orderkey + k) % 90 / 1000, 3) AS min_reading FROM orders, (SELECT unnest(range(0, 6)) AS k)")
def split_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split_readings_to_zones(split_lists(spark, sf_dir)).select("report", "cml_id", "min_reading")


def equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equipment and groups of circuits, out of the suppliers."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("52-0"), F.lpad((F.col("s_suppkey") % 60).cast("string"), 2, "0"), F.lit("K")).alias("circuit_id"), F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("equipment_id"), F.concat(F.lit("1.0"), (F.col("s_suppkey") % 9 + 1).cast("string"), F.lit("-1")).alias("cml_id"), F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("group_id"), F.col("s_suppkey").alias("row_ord"))


_EQUIPMENT = "SELECT '52-0' || lpad(cast(s_suppkey % 60 AS varchar), 2, '0') || 'K' AS circuit_id, 'E' || cast(s_suppkey AS varchar) AS equipment_id, '1.0' || cast(s_suppkey % 9 + 1 AS varchar) || '-1' AS cml_id, 'G' || cast(s_suppkey AS varchar) AS group_id, s_suppkey AS row_ord FROM supplier"


@query(f"SELECT r.report, r.circuit_id, coalesce(e.equipment_id, 'EQUIPMENT_NOT_FOUND') AS equipment_id FROM ({_SINGLE}) r LEFT JOIN (SELECT circuit_id, min_by(equipment_id, row_ord) AS equipment_id FROM ({_EQUIPMENT}) GROUP BY circuit_id) e ON e.circuit_id = r.circuit_id", V)
def circuit_to_equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.circuit_to_equipment(single(spark, sf_dir), equipment(spark, sf_dir), ORDER).select("report", "circuit_id", "equipment_id")


_LOADED = f"SELECT r.*, coalesce(e.equipment_id, 'EQUIPMENT_NOT_FOUND') AS equipment_id, coalesce(g.group_id, 'GROUP_NOT_FOUND') AS group_id FROM ({_SINGLE}) r LEFT JOIN (SELECT circuit_id, min_by(equipment_id, row_ord) AS equipment_id FROM ({_EQUIPMENT}) GROUP BY circuit_id) e ON e.circuit_id = r.circuit_id LEFT JOIN (SELECT circuit_id, cml_id, max_by(group_id, row_ord) AS group_id FROM ({_EQUIPMENT}) GROUP BY circuit_id, cml_id) g ON g.circuit_id = r.circuit_id AND g.cml_id = r.cml_id"


@query(f"SELECT equipment_id, group_id, cml_id AS tml_id, CASE WHEN equipment_id LIKE 'EQ%' AND group_id LIKE 'GROUP%' THEN 'missing equipment and group' WHEN equipment_id LIKE 'EQ%' THEN 'missing equipment' WHEN group_id LIKE 'GROUP%' THEN 'missing group' ELSE 'OK' END AS status FROM ({_LOADED})", V)
def measurement_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _assets = R.measurement_loader(single(spark, sf_dir), equipment(spark, sf_dir), ORDER)
    return rows.select("equipment_id", "group_id", F.col("TML_ID").alias("tml_id"), "status")


@query(f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE equipment_id LIKE 'EQ%') AS missing_equipment, count(*) FILTER (WHERE group_id LIKE 'GROUP%') AS missing_group FROM ({_LOADED})", V)
def loader_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _assets = R.measurement_loader(single(spark, sf_dir), equipment(spark, sf_dir), ORDER)
    return R.loader_status_counts(rows)


@query(f"SELECT circuit_id, cml_id, expected, actual, CASE WHEN abs(actual - expected) > 0.01 THEN 'different' END AS problem FROM (SELECT circuit_id, cml_id, min(min_reading) AS actual, round(min(min_reading) + CASE WHEN cml_id = '1.01-1' THEN 0.05e0 ELSE 0.0e0 END, 3) AS expected FROM ({_SINGLE}) GROUP BY circuit_id, cml_id)", V)
def compare_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest readings against expected values that are off for one CML."""
    got = R.min_reading_per_cml(single(spark, sf_dir), ["report"])
    off = F.round(F.col("min_reading") + F.when(F.col("cml_id") == "1.01-1", 0.05).otherwise(0.0), 3)
    expected = got.select("circuit_id", "cml_id", F.lit(True).alias("is_correct"), off.alias("corrected_reading"), "min_reading")
    return compare_ground_truth(got, expected).select("circuit_id", "cml_id", "expected", "actual", "problem")


@query("SELECT report, cast(v AS double) AS v FROM (SELECT 'R' || cast(o_orderkey AS varchar) AS report, round(0.3e0 + o_orderkey % 90 / 1000, 3) AS v FROM orders UNION ALL SELECT 'R' || cast(o_orderkey AS varchar), 0.5e0 FROM orders WHERE o_orderkey % 2 = 0)")
def supplement_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A primary CML for each report, and a second one that half of them lack."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("report"), "o_orderkey")

    def rows(df: DataFrame, cml: str, v) -> DataFrame:
        return df.select("report", F.col("report").alias("circuit_id"), F.lit(cml).alias("cml_id"), F.lit(None).cast("date").alias("measurement_date"), v.alias("min_reading"), F.array(v).alias("all_readings"), F.lit("x").alias("method"), F.lit(1).alias("page"))

    first = F.round(F.lit(0.3) + F.col("o_orderkey") % 90 / 1000, 3)
    primary, secondary = rows(o, "1.01-1", first), rows(o.where("o_orderkey % 2 = 0"), "2.02-1", F.lit(0.5)).unionByName(rows(o.where("o_orderkey % 2 = 0"), "1.01-1", first))
    return R.supplement_readings(primary, secondary).select("report", F.col("min_reading").alias("v"))


@query("SELECT report, page, string_agg(t, ' ' ORDER BY n) AS line FROM (SELECT 'R' || cast(l_orderkey AS varchar) AS report, 1 AS page, l_linenumber AS n, 'w' || cast(l_linenumber AS varchar) AS t FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY report, page")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a page on one line, in reading order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    left = F.col("l_linenumber") * 50.0
    tokens = li.select(F.concat(F.lit("R"), F.col("l_orderkey").cast("string")).alias("report"), F.lit(1).alias("page"), F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias("text"), F.lit(0.9).alias("conf"), left.alias("left"), (left + 40).alias("right"), F.lit(10.0).alias("top"), F.lit(20.0).alias("bottom"), F.lit(15.0).alias("cy"), F.lit(10.0).alias("height"))
    return R.page_text(tokens).select("report", "page", F.col("text").alias("line"))


@query(f"SELECT report, {_DATE} AS d FROM report_text", V)
def report_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "report_text").select("report", F.date_format(P.report_date(F.col("text")), "yyyy-MM-dd").alias("d"))


@query(f"SELECT DISTINCT equipment_id, 'P1R-100' AS cmms_system FROM ({_LOADED})", V)
def loader_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _rows, assets = R.measurement_loader(single(spark, sf_dir), equipment(spark, sf_dir), ORDER)
    return assets.toDF("equipment_id", "cmms_system")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'given' ELSE 'EQUIPMENT_NOT_FOUND' END AS equipment_id, CASE WHEN o_orderkey % 3 = 0 THEN 'seen' ELSE '' END AS comment FROM orders WHERE o_orderkey % 4 <> 3")
def loader_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table edited by hand: rows with a blank circuit go, comments and a given equipment stay."""
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(
        F.when(k % 4 == 3, F.lit(" ")).otherwise("nowhere").alias("circuit_id"), k.cast("string").alias("cml_id"), F.lit(None).cast("date").alias("measurement_date"), F.lit(0.3).alias("min_reading"), F.when(k % 4 == 0, "given").alias("given_equipment"), F.when(k % 3 == 0, "seen").otherwise("").alias("comment")
    )
    rows, _assets = R.measurement_loader(r, equipment(spark, sf_dir), ORDER, edited=True)
    return rows.select(F.col("TML_ID").cast("long").alias("id"), F.col("`Equipment ID`").alias("equipment_id"), F.col("`Measurement Comment`").alias("comment"))


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'E1' WHEN 1 THEN 'E2' WHEN 2 THEN 'E0' ELSE 'EQUIPMENT_NOT_FOUND' END AS equipment_id FROM customer")
def circuit_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circuits that start with a known one, that a known one starts with, that differ in blanks, and that match none;
    among several the first by order."""
    k = F.col("c_custkey") % 4
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(k == 0, "52-001K-AB").when(k == 1, "53-0").when(k == 2, "54-7  X").otherwise("99").alias("circuit_id"))
    known = spark.createDataFrame([("52-001K", "E1", 1), ("52-001K-A", "E9", 2), ("53-002", "E2", 1), ("53-003", "E9", 5), ("54-7 X", "E0", 3)], "circuit_id string, equipment_id string, row_ord int")
    return R.circuit_to_equipment(asked, known, ORDER).select("id", "equipment_id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'E0' WHEN c_custkey % 3 = 2 THEN (SELECT 'E' || cast(min(n_nationkey) AS varchar) FROM nation) ELSE 'E' || cast(c_nationkey AS varchar) END AS equipment_id FROM customer")
def circuits_of_one_beginning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every circuit, known or asked for, begins with ``52-``: whole ones with a tail, with other blanks, the common beginning alone."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("52-0"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit("K  1")).alias("circuit_id"), F.concat(F.lit("E"), F.col("n_nationkey").cast("string")).alias("equipment_id"), F.col("n_nationkey").alias("row_ord"))
    c, own = table(spark, sf_dir, "customer"), F.concat(F.lit("52-0"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("K 1"))
    k = F.col("c_custkey")
    asked = c.select(k.alias("id"), F.when(k % 7 == 0, "52-").when(k % 3 == 2, "52-0").when(k % 3 == 1, F.concat(own, F.lit("-"), k.cast("string"))).otherwise(own).alias("circuit_id"))
    return R.circuit_to_equipment(asked, n, ORDER).select("id", "equipment_id")


_LISTED = "CASE WHEN o_orderkey % 50 = 0 THEN 'no pages' WHEN o_orderkey % 50 = 1 THEN 'pages without number' WHEN o_orderkey % 50 = 2 THEN 'no text' WHEN o_orderkey % 50 = 3 THEN 'listed twice' WHEN o_orderkey % 50 = 4 THEN 'no CML' END"


@query(f"SELECT 'R' || cast(o_orderkey AS varchar) AS report, o_orderkey AS report_ord, {_LISTED} AS reason, CASE WHEN {_LISTED} IS NULL THEN round(least((200 + o_orderkey % 300) / 1000e0, CASE WHEN o_orderkey % 50 = 5 THEN 1 ELSE 0.5e0 END), 3) END AS min_reading FROM orders")
def parse_listed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in the order of their list: some can't be read, each for its own reason, and are in the quarantine alone; one kind has its reading
    only in a table cell."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("report"), (F.col("o_orderkey") % 50).alias("kind"))
    listed = o.select("report", F.col("o_orderkey").alias("report_ord")).unionByName(o.where("kind = 3").select("report", (F.col("o_orderkey") + 1).alias("report_ord")))
    value = F.format_string("0.%d", 200 + F.col("o_orderkey") % 300)
    text = F.when(F.col("kind") == 2, "  ").when(F.col("kind") == 4, "nothing measured").when(F.col("kind") == 5, F.concat(F.lit("Circuit: 52-"), F.lpad(F.col("o_orderkey").cast("string"), 3, "0"), F.lit("\nCML 1.01"))).otherwise(F.concat(F.lit("Circuit: 52-001K 1-2\nCML 1.01\nreading "), value))
    pages = o.where("kind <> 0").select("report", F.when(F.col("kind") != 1, 1).alias("page"), text.alias("text"))
    cells = o.where("kind = 5").select("report", F.lit(1).alias("page"), F.lit(1).alias("table_no"), F.lit(1).alias("row_no"), F.array(F.lit("x"), value).alias("cells"))
    found, bad = R.parse_listed_reports(listed, pages, cells)
    least = found.groupBy("report", "report_ord").agg(F.round(F.min("min_reading"), 3).alias("min_reading"))
    return bad.select("report", "report_ord", "reason", F.lit(None).cast("double").alias("min_reading")).unionByName(least.select("report", "report_ord", F.lit(None).cast("string").alias("reason"), "min_reading"))


_PAGES = "'R' || cast(o_orderkey AS varchar) AS report, k AS page FROM orders, (VALUES (1), (2), (3)) AS v(k)"


@query(f"SELECT {_PAGES} WHERE k = CASE WHEN o_orderkey % 2 = 0 THEN 2 END OR (o_orderkey % 2 = 1 AND k < 3)")
def summary_page_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a report has a summary page only that counts, else every page but those of grids."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("report"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    texts = F.array(F.struct(F.lit(1).alias("page"), F.lit("Notes").alias("text")), F.struct(F.lit(2).alias("page"), F.when(F.col("even"), "U T R E P O R T - ELBOW").otherwise("More notes").alias("text")), F.struct(F.lit(3).alias("page"), F.lit("UT Grid 1").alias("text")))
    return R.summary_pages(o.select("report", F.inline(texts))).select("report", "page")
