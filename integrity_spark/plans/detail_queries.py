"""Column functions and joint summaries over derived rows, each beside SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assess as A
from ..operators import featuremap as M
from ..operators import joints as J
from ..operators import readings as R
from ..sources.fixtures import table, view
from ..sources.keywords import INSPECTION, VENDORS, vendor_keywords
from ..functions.pressure import not_positive
from ..operators import ingest as I
from ..operators.tml import EQUIPMENT, GROUP, STATUS_COLUMN, SUB, WORKFLOWS, normalized_plans, plan_problems, refined_plans
from .registry import query

TALLY, ILI = ("pipe_tally",), ("ili_features",)


@query("SELECT joint_number, line_id, round((cast(split_part(seam_raw, ':', 1) AS double) + cast(split_part(seam_raw, ':', 2) AS double) / 60.0e0) / 12 * 360, 6) AS degrees FROM pipe_tally", TALLY)
def clock_to_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "pipe_tally")
    return t.select("joint_number", "line_id", F.round(S.clock_to_degrees(F.col("seam_raw")), 6).alias("degrees"))


@query("SELECT joint_number, coalesce(pipe_grade, '-') AS grade, CASE joint_number % 3 WHEN 0 THEN 'a ' || line_id WHEN 1 THEN '-' ELSE line_id END AS line FROM pipe_tally", TALLY)
def report_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of cells with leading blank lines, of blank cells, and dashes for what is missing."""
    cell = F.expr("CASE joint_number % 3 WHEN 0 THEN concat(chr(10), ' a ', line_id, ' ', chr(10), 'b') WHEN 1 THEN ' ' ELSE line_id END")
    return view(spark, sf_dir, "pipe_tally").select("joint_number", S.dash_default(F.col("pipe_grade")).alias("grade"), S.first_line(cell).alias("line"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS issued, CASE WHEN o_orderkey % 5 = 4 THEN 'soon' END AS raw FROM orders")
def issue_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in four spellings, and a text that is none."""
    d = F.col("o_orderdate").cast("date")
    kind = F.col("o_orderkey") % 5
    text = F.when(kind == 0, F.date_format(d, "yyyy-MM-dd")).when(kind == 1, F.date_format(d, "M/d/yyyy")).when(kind == 2, F.date_format(d, "d-MMM-yyyy")).when(kind == 3, F.date_format(d, "MMMM d, yyyy")).otherwise(" soon ")
    found, raw = S.issue_date(text)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(found, "yyyy-MM-dd").alias("issued"), raw.alias("raw"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN cast(cast(l_quantity AS bigint) AS varchar) WHEN 1 THEN cast(l_quantity + 0.5e0 AS varchar) ELSE l_returnflag END AS value FROM lineitem")
def json_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("CASE l_linenumber % 3 WHEN 0 THEN cast(l_quantity AS string) WHEN 1 THEN cast(l_quantity + 0.5e0 AS string) ELSE l_returnflag END")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), S.json_number(v).alias("value"))


_MAKER = "'mk ' || cast(p_size AS varchar)"


@query(f"SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_brand || ',' || {_MAKER} WHEN 1 THEN {_MAKER} WHEN 2 THEN '' ELSE p_brand END AS sources, CASE p_partkey % 4 WHEN 3 THEN 'Long Seam (hh:mm) ' || p_brand WHEN 2 THEN 'Seam (hh:mm)' WHEN 1 THEN 'Orientation ' || {_MAKER} || ' ' || upper({_MAKER}) ELSE 'Seam' END AS metric, {_MAKER} AS cleaned FROM part")
def label_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in parentheses (once each) or on later lines, the metric without them, and the bare source name."""
    maker = "concat('mk ', cast(p_size AS string))"
    label = F.expr(f"CASE p_partkey % 4 WHEN 0 THEN concat('Seam (', p_brand, ') (', {maker}, ') (', upper({maker}), ')') WHEN 1 THEN concat('Orientation ', chr(10), {maker}, ' ', chr(10), upper({maker})) WHEN 2 THEN 'Seam  (hh:mm)' ELSE concat('Long Seam', chr(10), '(hh:mm) ', chr(10), p_brand) END")
    own = F.concat(F.lit("Long Seam Orientation ("), F.expr(maker), F.lit(") -"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(J.label_sources(label), ",").alias("sources"), J.clean_metric(label).alias("metric"), J.clean_source_name(own).alias("cleaned"))


@query("SELECT p_partkey AS id, CASE WHEN gwd > 100 AND gwd < 99999 THEN gwd END AS gwd FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1000 + p_partkey WHEN 1 THEN 1000 + p_partkey WHEN 2 THEN 1000 + p_size END AS gwd FROM part)")
def gwd_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers, copies with a suffix, numbers inside text, names, and numbers out of range."""
    text = F.expr("CASE p_partkey % 5 WHEN 0 THEN cast(1000 + p_partkey AS string) WHEN 1 THEN concat(cast(1000 + p_partkey AS string), '.0__2') WHEN 2 THEN concat('GWD No. ', cast(1000 + p_size AS string), ' U/S') WHEN 3 THEN p_name ELSE '7' END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), J.gwd_from_text(text).alias("gwd"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_tax <> 0 THEN least(l_quantity, l_discount * 400) END AS lo, CASE WHEN l_tax <> 0 THEN greatest(l_quantity, l_discount * 400) END AS hi FROM lineitem")
def nde_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = M.nde_region(F.col("l_quantity"), F.when(F.col("l_tax") != 0, F.col("l_discount") * 400))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), lo.alias("lo"), hi.alias("hi"))


@query("SELECT joint_number, CASE joint_number % 4 WHEN 0 THEN line_id || ': U/S GWD 7 @ 03:00 | Target GWD ' || cast(joint_number AS varchar) || ' | D/S GWD 9' WHEN 1 THEN 'Target GWD ' || cast(joint_number AS varchar) WHEN 2 THEN '' ELSE line_id || ': D/S GWD 9 @ ' || seam_raw END AS text FROM pipe_tally", TALLY)
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("joint_number") % 4

    def weld(number, label):
        return F.struct(number.cast("long").alias("gwd_number"), label.cast("string").alias("seam_label"))

    none = F.lit(None)
    up = weld(F.when(kind == 0, 7), F.lit("03:00"))
    target = weld(F.when(kind < 2, F.col("joint_number")), none)
    down = weld(F.when((kind == 0) | (kind == 3), 9), F.when(kind == 3, F.col("seam_raw")))
    return view(spark, sf_dir, "pipe_tally").select("joint_number", M.context_text(target, up, down, F.when(kind.isin(0, 2, 3), F.col("line_id"))).alias("text"))


@query("SELECT feature_id, CASE WHEN top <= 1.5e0 THEN round(d * 100, 6) ELSE round(d, 6) END AS depth, top <= 1.5e0 AS scaled FROM (SELECT *, max(CASE WHEN d > 0 AND length_mm > 0 THEN d END) OVER (PARTITION BY source) AS top FROM (SELECT feature_id, source, length_mm, CASE WHEN starts_with(source, '2025') THEN depth_pct / 100 ELSE depth_pct END AS d FROM ili_features))", ILI)
def fraction_autoscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three runs have fractions."""
    f = view(spark, sf_dir, "ili_features")
    d = A.valid_defects(f.withColumn("depth_pct", F.when(F.startswith("source", F.lit("2025")), F.col("depth_pct") / 100).otherwise(F.col("depth_pct"))))
    out = A.fraction_autoscale(d, "source")
    return out.select("feature_id", F.round("depth_in", 6).alias("depth"), F.col("depth_scaled").alias("scaled"))


@query("SELECT feature_id, depth_pct AS own, chainage AS other FROM ili_features", ILI)
def protect_year_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column called 2026 is renamed, one called 1999 isn't."""
    f = view(spark, sf_dir, "ili_features").select("feature_id", F.col("depth_pct").alias("2026"), F.col("chainage").alias("1999"))
    return A.protect_year_columns(f).select("feature_id", F.col("_ref_2026").alias("own"), F.col("`1999`").alias("other"))


_KINDS = "(VALUES ('ILI Tool RunA', 'RunA 2022'), ('2025 RunB MFL', 'RunB 2025'), ('EMAT', 'emat inspection'), ('unknown vendor', 'RunA 2022')) AS k(feature_source, joint_source)"


@query(f"SELECT line_id AS program_id, feature_source, joint_source FROM (SELECT DISTINCT line_id FROM pipe_tally), {_KINDS}", TALLY)
def match_source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By tokens, by containment, and the first one where nothing is alike."""
    lines = view(spark, sf_dir, "pipe_tally").select(F.col("line_id").alias("program_id")).distinct()
    a = lines.withColumn("source", F.explode(F.array(*map(F.lit, ("ILI Tool RunA", "2025 RunB MFL", "EMAT", "unknown vendor")))))
    b = lines.select("program_id", F.posexplode(F.array(*map(F.lit, ("RunA 2022", "RunB 2025", "emat inspection")))).alias("ord", "source"))
    return J.match_source_names(a, b)


_ORDERED = "SELECT line_id AS program_id, joint_number AS gwd, row_number() OVER (PARTITION BY line_id ORDER BY joint_number) AS k, count(*) OVER (PARTITION BY line_id) AS n FROM pipe_tally"


@query(f"SELECT program_id, chainage, gwd, k - t AS off FROM (SELECT *, (joint_number_x - 0) AS chainage FROM (SELECT program_id, gwd, k, n, n // 2 + 1 AS t, 12e0 * (k - (n // 2 + 1)) AS joint_number_x FROM ({_ORDERED})))", TALLY)
def positional_welds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A girth list that has chainage 0 at its middle weld, against a matrix of the same welds without a target."""
    t = view(spark, sf_dir, "pipe_tally").select(F.col("line_id").alias("program_id"), F.col("joint_number").alias("gwd"))
    n = t.groupBy("program_id").agg(F.count("*").alias("n"))
    by = W.partitionBy("program_id").orderBy("gwd")
    k = t.withColumn("k", F.row_number().over(by)).join(n, "program_id")
    girth = k.select("program_id", (12.0 * (F.col("k") - (F.floor(F.col("n") / 2) + 1))).alias("chainage"))
    matrix = t.select("program_id", "gwd", F.col("gwd").alias("ord"), F.lit(False).alias("is_target"))
    return J.positional_welds(girth, matrix).select("program_id", "chainage", "gwd", F.col("offset").cast("long").alias("off"))


@query(f"SELECT program_id, gwd, 12e0 * (k - t) AS chainage, 'GWD ' || cast(gwd AS varchar) || CASE WHEN k = t THEN ' (TGW)' ELSE '' END AS label FROM (SELECT *, (n - 1) // 2 + 1 AS t FROM ({_ORDERED})) WHERE k BETWEEN t - 1 AND t + 2 AND n >= 4", TALLY)
def tgw_four_welds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four welds around the middle of each line's joints; all joints are 12 m long."""
    t = view(spark, sf_dir, "pipe_tally").select(F.col("line_id").alias("program_id"), F.col("joint_number").alias("gwd"), "joint_length_m", F.lit("tally").alias("source"), S.clock_to_hours(F.col("seam_raw")).alias("hours"))
    order = t.select("program_id", "gwd", F.col("gwd").alias("ord"), F.lit(False).alias("is_target"))
    return J.tgw_layout(order, J.joint_lengths(t.withColumnRenamed("joint_length_m", "length_m")), t.select("program_id", "gwd", "source", "hours"))[0]


@query("SELECT joint_number AS gwd, line_id AS program_id, round(CASE WHEN d < 0 THEN coalesce(lag(h) OVER (PARTITION BY line_id ORDER BY d), h) ELSE h END, 6) AS hours FROM (SELECT *, CASE WHEN joint_number % 2 = 0 THEN -1 ELSE 1 END * joint_number AS d, cast(split_part(seam_raw, ':', 1) AS double) + cast(split_part(seam_raw, ':', 2) AS double) / 60.0e0 AS h FROM pipe_tally)", TALLY)
def seam_carry_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "pipe_tally")
    rows = t.select(F.col("line_id").alias("program_id"), F.lit("s").alias("source"), F.col("joint_number").alias("gwd"), (F.when(F.col("joint_number") % 2 == 0, -1).otherwise(1) * F.col("joint_number")).alias("distance"), S.clock_to_hours(F.col("seam_raw")).alias("hours"))
    return J.seam_carry_upstream(rows).select("gwd", "program_id", F.round("hours", 6).alias("hours"))


def matrix_cells(programs: DataFrame, key: str, hour: str) -> DataFrame:
    """A matrix a program: welds in the header, twice each for two sources, and seam clocks of both in one row."""
    cell = lambda r, c, v: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.expr(v).cast("string").alias("value"))
    label = "'Long Seam Orientation (Run 1) (Run 2)'"
    cells = [cell(0, 0, "'Metric'"), cell(0, 1, "'Source'"), cell(1, 0, label), cell(1, 1, "''"), cell(2, 0, "'Length (m)'"), cell(2, 1, "'Run 1'"), cell(3, 0, "'Seam'"), cell(3, 1, "'Run 3'")]
    for c in range(4):
        cells += [cell(0, 2 + c, f"concat('GWD ', cast(1000 + 10 * ({key} % 5000) + {c // 2} AS string))"), cell(1, 2 + c, f"concat(cast({hour} + {c} AS string), ':30')"), cell(2, 2 + c, "12.5"), cell(3, 2 + c, f"CASE WHEN {c} = 0 THEN '13' ELSE cast({hour} AS string) END")]
    return programs.select(F.col(key).cast("string").alias("program_id"), F.inline(F.array(*cells)))


@query("SELECT cast(n_nationkey AS varchar) AS program_id, 1000 + 10 * n_nationkey + k AS gwd, 'Run 1' AS source, n_regionkey + 2 * k + 0.5e0 AS hours FROM nation, (SELECT unnest(range(0, 2)) AS k) UNION ALL SELECT cast(n_nationkey AS varchar), 1000 + 10 * n_nationkey + 1, 'Run 3', n_regionkey FROM nation")
def unpivot_joint_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two label columns: a row is one source's, so it reads a weld's first column only; numbers over 12 are no clocks."""
    return J.unpivot_joint_matrix(matrix_cells(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey")).select("program_id", "gwd", "source", F.round("hours", 6).alias("hours"))


_SEAMS = "(VALUES (0, 'Run 1', 0.5e0), (1, 'Run 1', 2.5e0), (0, 'Run 3', 0e0), (1, 'Run 3', 0e0)) AS v(k, source, plus)"


@query(f"SELECT cast(s_suppkey AS varchar) AS program_id, source, 1000 + 10 * (s_suppkey % 5000) + k AS gwd, 12e0 * (k - s_suppkey % 3) AS chainage_start, 12e0 * (k + 1 - s_suppkey % 3) AS chainage_end, s_nationkey % 5 + plus AS hours FROM supplier, {_SEAMS} WHERE s_suppkey % 3 < 2 UNION ALL SELECT cast(s_suppkey AS varchar), 'Run 1', 1000 + 10 * (s_suppkey % 5000) + 1, NULL, NULL, s_nationkey % 5 + 2.5e0 FROM supplier WHERE s_suppkey % 3 = 2")
def dig_feature_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seams of digs whose welds have numbers, whose welds have none and meet the matrix by place, and of digs without welds."""
    s = table(spark, sf_dir, "supplier").withColumns({"program_id": F.col("s_suppkey").cast("string"), "kind": F.col("s_suppkey") % 3, "hour": F.col("s_nationkey") % 5})
    feats = s.select("program_id", F.lit(5.0).alias("chainage"), F.lit(1.5).alias("distance_from_tgw"))
    weld = F.struct(F.when(F.col("kind") == 0, 1000 + 10 * (F.col("s_suppkey") % 5000) + F.col("k")).alias("gwd"), (12.0 * (F.col("k") - F.col("kind"))).alias("chainage"))
    girth = s.where("kind < 2").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("program_id", F.lit("Run 1").alias("source"), weld.alias("w")).select("program_id", "source", "w.*")
    cells = matrix_cells(s, "s_suppkey", "hour")
    seams = J.dig_feature_map(feats, girth, cells)[2]
    return seams.select("program_id", "source", "gwd", "chainage_start", "chainage_end", F.round("orientation_hours", 6).alias("hours"))


@query("SELECT cast(n_nationkey AS varchar) AS program_id, k AS row, CASE k WHEN 4 THEN 'Depth' ELSE 'Seam' END AS metric, CASE k WHEN 4 THEN n_name ELSE CASE least(k, 2) WHEN 1 THEN 'Run 1' ELSE 'Run 2' END END AS source, CASE k WHEN 4 THEN 1 ELSE k END AS occurrence FROM nation, (SELECT unnest(range(1, 5)) AS k)")
def normalize_joint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label over three rows for two sources: the last source serves again; a source column comes before the label."""
    n = table(spark, sf_dir, "nation")
    rows = F.array(*(F.struct(F.lit(k).alias("row"), F.lit("Depth" if k == 4 else "Seam (Run 1) (Run 2)").alias("label"), (F.col("n_name") if k == 4 else F.lit(" ")).alias("source_label")) for k in range(1, 5)))
    out = J.normalize_joint_summary(n.select(F.col("n_nationkey").cast("string").alias("program_id"), F.inline(rows)))
    return out.select("program_id", "row", "metric", "source", "occurrence")


@query("SELECT cast(n_nationkey AS varchar) AS program_id, k AS row, CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 2 END AS occurrence FROM nation, (SELECT unnest(range(1, 6)) AS k)")
def runs_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    rows = F.array(*(F.struct(F.lit(k).alias("row"), F.lit(v).alias("label")) for k, v in enumerate("aabaa", 1)))
    return J.runs_of_labels(n.select(F.col("n_nationkey").cast("string").alias("program_id"), F.inline(rows))).select("program_id", "row", "occurrence")


@query("SELECT l_orderkey AS id, l_linenumber AS n, last_value(CASE WHEN l_tax > 0.05e0 THEN l_returnflag END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS cml FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def forward_fill_cml(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("cml", F.when(F.col("l_tax") > 0.05, F.col("l_returnflag")))
    out = R.forward_fill(li, "cml", ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    once = li.groupBy("l_orderkey", "l_linenumber").count().where("count = 1").select("l_orderkey", "l_linenumber")
    return out.join(once, ["l_orderkey", "l_linenumber"], "left_semi").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), "cml")


@query("SELECT 'R' || cast(o_orderkey AS varchar) AS report, k AS row_no, CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 + o_orderkey % 2 WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END ELSE 4 END AS zone FROM orders, (SELECT unnest(range(1, 5)) AS k)")
def sequence_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second row has zone 2 or 3, the others take the lowest number not used before."""
    o = table(spark, sf_dir, "orders")
    rows = F.array(*(F.struct(F.lit(k).alias("row_no"), (F.lit(2) + F.col("o_orderkey") % 2 if k == 2 else F.lit(None)).cast("int").alias("zone")) for k in range(1, 5)))
    r = o.select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("report"), F.lit("1.01").alias("cml_base"), F.inline(rows))
    return R.sequence_zones(r).select("report", "row_no", "zone")


_TOKEN_ROWS = {
    0: [("1.01-1", 1), ("1.01-2", 2), ("1.01-3", 3), ("1.34-1", 4), ("1.34-2", 5), ("1.34-3", 6)],
    1: [("1.01-9", 1), ("1.01-10", 2), ("1.01-12", 3), ("1.01-1", 4)],
    2: [("1.01-1", 1), ("1.01-2", 2), ("1.01-3", 4)],
    3: [("9.05", 1)],
}


@query(" UNION ALL ".join(f"SELECT 'R' || cast(o_orderkey AS varchar) AS report, '{cml}' AS cml_id, round(0.2e0 + (o_orderkey % 50 + {k}) / 1000, 3) AS min_reading FROM orders WHERE o_orderkey % 4 = {kind}" for kind, rows in _TOKEN_ROWS.items() for cml, k in rows))
def tokens_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a report, of four kinds: two CMLs whose labels stand in the middle of their sections; sections of two digits, diameters beside
    them, and a row without number; a directional table with a row to skip and a reading that isn't sure; a CML without sections."""
    o = table(spark, sf_dir, "orders")
    number = lambda k: F.format_string("%.3f", F.lit(0.2) + (F.col("o_orderkey") % 50 + k) / 1000)

    def token(text, left, cy, conf=0.9):
        text = F.lit(text) if isinstance(text, str) else text
        return F.struct(text.alias("text"), F.lit(conf).alias("conf"), F.lit(float(left)).alias("left"), F.lit(left + 20.0).alias("right"), F.lit(cy - 5.0).alias("top"), F.lit(cy).alias("cy"), F.lit(10.0).alias("height"))

    head = [token("CIRCUIT", 0, 10.0), token("CML", 60, 10.0)]
    sections = [*head, token("SECTION", 120, 11.0), token("DIAM.", 180, 10.0), token("A", 240, 10.0), token("B", 300, 10.0)]
    merged = [t for k in range(6) for t in (token(str(k % 3 + 1), 122, 40.0 + 30 * k), token(number(k + 1), 240, 41.0 + 30 * k), token("2.500", 300, 40.0 + 30 * k))] + [token("1.01", 62, 71.0), token("1.34", 62, 161.0), token("52-001A", 0, 71.0)]
    wide = [t for k, zone in enumerate(("9", "10", "12", None)) for t in ([token(zone, 121, 40.0 + 30 * k)] if zone else []) + [token("1.01", 60, 40.0 + 30 * k), token("8" if zone else "8in", 181, 40.0 + 30 * k), token(number(k + 1), 240, 42.0 + 30 * k)]]
    compass = [*head, token("NORTH", 120, 10.0), token("SOUTH", 180, 10.0), token("1.01", 61, 40.0)] + [t for k in range(4) for t in (token(number(k + 1) if k != 2 else "FLANGE", 120, 40.0 + 30 * k), token("0.111", 180, 40.0 + 30 * k, 0.3))]
    single = [*head, token("ZONE", 120, 10.0), token("TOP", 240, 10.0), token("9.05", 60, 40.0), token("1", 121, 40.0), token(number(1), 240, 40.0), token("2", 121, 70.0), token(number(2), 240, 70.0)]
    kinds = [[*sections, *merged], [*sections, *wide], compass, single]
    ids = [("1.01", "1.34"), ("1.01",), ("1.01",), ("9.05",)]
    names = o.select("o_orderkey", F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("report"), (F.col("o_orderkey") % 4).alias("kind"))
    pages = [names.where(F.col("kind") == k).select("report", F.lit(1).alias("page"), F.inline(F.array(*tokens))) for k, tokens in enumerate(kinds)]
    t = pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])
    lists = F.get(F.array(*(F.array(*map(F.lit, i)) for i in ids)), F.col("kind").cast("int"))
    meta = names.select("report", F.lit("52-001A").alias("circuit_id"), F.lit(None).cast("date").alias("measurement_date"), lists.alias("cml_ids"))
    return R.tokens_to_rows(t, meta).select("report", "cml_id", F.round("min_reading", 3).alias("min_reading"))


@query("SELECT 'R' || cast(o_orderkey AS varchar) AS report, CASE WHEN o_orderkey % 2 = 0 THEN '0.333,0.222,0.111' ELSE '0.333,0.444' END AS readings FROM orders")
def numeric_page_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page first; cells where a page has some, else its text."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("report"), F.col("o_orderkey").alias("k"))
    pages = o.select("report", F.inline(F.array(F.struct(F.lit(1).alias("page"), F.lit("reading 0.444 in").alias("text")), F.struct(F.lit(2).alias("page"), F.lit("reading 0.333 in").alias("text")))))
    rows = o.where("k % 2 = 0").select("report", F.lit(1).alias("page"), F.lit(1).alias("table_no"), F.inline(F.array(F.struct(F.lit(2).alias("row_no"), F.array(F.lit("x"), F.lit("0.111")).alias("cells")), F.struct(F.lit(1).alias("row_no"), F.array(F.lit("a 0.222 b"), F.lit(None).cast("string")).alias("cells")))))
    return R.numeric_page_readings(pages, rows).select("report", F.array_join("readings", ",").alias("readings"))


_STRATEGY = "CASE o_orderkey % 5 WHEN 0 THEN 'tokens' WHEN 1 THEN 'zone' WHEN 2 THEN 'permissive' WHEN 3 THEN 'diameter' ELSE 'aggregate' END"


@query(f"SELECT 'R' || cast(o_orderkey AS varchar) AS report, {_STRATEGY} AS strategy FROM orders")
def select_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens only without readings, zones for three CMLs, permissive rows where they are more, diameters, and the rest."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("report"), (F.col("o_orderkey") % 5).alias("k"))

    def rows(where: str, n: int = 1) -> DataFrame:
        own = o.where(where).withColumn("cml_id", F.explode(F.array(*(F.lit(f"1.0{j}") for j in range(n)))))
        return own.select("report", F.lit("c").alias("circuit_id"), "cml_id", F.lit(None).cast("date").alias("measurement_date"), F.lit(0.3).alias("min_reading"), F.array(F.lit(0.3)).alias("all_readings"), F.lit("m").alias("method"), F.lit(1).alias("page"))

    found = {"tokens": rows("k IN (0, 3)"), "zone": rows("k IN (0, 1, 3)", 3), "diameter": rows("k IN (1, 2, 3)"), "permissive": rows("k = 2", 2), "aggregate": rows("true")}
    meta = o.select("report", F.when(F.col("k") == 1, F.array(*map(F.lit, ("1", "2", "3")))).when(F.col("k") == 3, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array(F.lit("1"))).alias("cml_ids"), F.when(F.col("k") == 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.3))).alias("readings"), F.lit(500).alias("text_length"))
    return R.select_strategy(found, meta).select("report", "strategy").distinct()


@query("SELECT line_id, count(*) AS rows, count(DISTINCT gwd_number) AS welds FROM ili_features GROUP BY line_id", ILI)
def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a line, and its weld numbers with a chainage."""
    f = view(spark, sf_dir, "ili_features")
    welds = M.weld_numbers(f).groupBy("line_id").agg(F.count("*").alias("welds"))
    return f.groupBy("line_id").agg(F.count("*").alias("rows")).join(welds, "line_id")


@query("SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'Depth!' WHEN 1 THEN 'own depth' ELSE 'depth' END AS first, s_suppkey % 3 < 2 AS own FROM supplier")
def user_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's names come before those of the list; blank names and copies in other case go."""
    from ..sources.keywords import merged

    lists = [merged(INSPECTION, {"depth": names})["depth"] for names in (["Depth!", "", "depth! "], ["own depth", " "], [])]
    firsts = F.array(*(F.lit(x[0]) for x in lists))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.get(firsts, F.col("s_suppkey") % 3).alias("first"), F.get(F.array(*(F.lit(len(x) > len(lists[2])) for x in lists)), F.col("s_suppkey") % 3).alias("own"))


_VENDOR_ROWS = " UNION ALL ".join(f"SELECT '{v}' AS vendor, '{'Anomalies' if 'Rosen' in v else 'Pipetally'}' AS sheet" for v in VENDORS)


@query(f"SELECT s_suppkey AS id, vendor, sheet FROM supplier, ({_VENDOR_ROWS})")
def vendor_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sheet name that each vendor's layout looks for."""
    rows = F.array(*(F.struct(F.lit(v).alias("vendor"), F.lit(vendor_keywords(v)[1][0]).alias("sheet")) for v in VENDORS))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.inline(rows))


def _resolved(vendor: str, headers: list[str], override: dict[str, list[str]]) -> list[tuple[str, int]]:
    """Key and column by the rule: exact before contained, longer names first, then the list's order, then the leftmost."""
    from ..sources.keywords import DEFAULT_VENDOR, merged

    out = []
    for key, names in merged(vendor_keywords(vendor if vendor in VENDORS else DEFAULT_VENDOR)[0], override).items():
        found = [(h.lower() != n.lower().strip(), -len(n.strip()), i, c) for i, n in enumerate(names) for c, h in enumerate(headers) if h.lower() == n.lower().strip() or (len(n.strip()) >= 4 and n.lower().strip() in h.lower())]
        out += [(key, min(found)[3])] if found else []
    return out


#: A header row for each vendor: the last name of six of its keys, a user's own name, and one that stands for nothing.
_LAYOUTS = {v: [vendor_keywords(v)[0][k][-1] for k in ("depth", "length", "width", "distance", "feature_type", "joint_number")] + ["Tiefe (mm) neu", "qq"] for v in [*VENDORS, "Nobody"]}
_OWN = {"depth": ["Tiefe"]}


@query(" UNION ALL ".join(f"SELECT 'f' || cast(s_suppkey AS varchar) AS file, '{key}' AS key, {col} AS col FROM supplier WHERE s_suppkey % {len(_LAYOUTS)} = {i}" for i, (v, heads) in enumerate(_LAYOUTS.items()) for key, col in _resolved(v, heads, {})))
def vendor_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows of files of all vendors and of an unknown one, each resolved by its vendor's keywords."""
    return I.resolve_by_vendor(_vendor_headers(spark, sf_dir)).select("file", "key", "col")


@query(" UNION ALL ".join(f"SELECT 'f' || cast(s_suppkey AS varchar) AS file, '{key}' AS key, {col} AS col FROM supplier WHERE s_suppkey % {len(_LAYOUTS)} = {i}" for i, (v, heads) in enumerate(_LAYOUTS.items()) for key, col in _resolved(v, heads, _OWN) if key == "depth"))
def user_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same header rows with a user's name for the depth."""
    return I.resolve_by_vendor(_vendor_headers(spark, sf_dir), override=_OWN).where("key = 'depth'").select("file", "key", "col")


def _vendor_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.struct(F.lit(v).alias("vendor"), F.array(*map(F.lit, heads)).alias("heads")) for v, heads in _LAYOUTS.items()))
    s = table(spark, sf_dir, "supplier").withColumn("l", F.get(names, (F.col("s_suppkey") % len(_LAYOUTS)).cast("int")))
    return s.select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("file"), F.lit("S").alias("sheet"), F.col("l.vendor").alias("vendor"), F.posexplode("l.heads").alias("col", "header"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, concat_ws(',', CASE WHEN l_quantity - 25 <= 0 THEN 'diameter' END, CASE WHEN l_discount <= 0 THEN 'wall' END, CASE WHEN l_linenumber <> 3 AND l_tax <= 0 THEN 'safety' END) AS wrong FROM lineitem")
def pipe_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which inputs of each row aren't positive; a safety factor that isn't given passes."""
    li = table(spark, sf_dir, "lineitem")
    wrong = not_positive(diameter=F.col("l_quantity") - 25, wall=F.col("l_discount"), safety=F.when(F.col("l_linenumber") != 3, F.col("l_tax")))
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.array_join(wrong, ",").alias("wrong"))


_COLUMN_OF = "CASE w " + " ".join(f"WHEN {i} THEN '{w.column}'" for i, w in WORKFLOWS.items()) + " END"


@query(f"""WITH p AS (SELECT s_suppkey AS id, 1 + s_suppkey % 20 AS own, s_suppkey % 2 = 0 AS given, s_suppkey % 3 = 0 AS answered FROM supplier),
 n AS (SELECT id, given, answered, unnest(list_sort(list_distinct([9, own]))) AS w FROM p),
 c AS (SELECT id, w, {_COLUMN_OF} AS c, given, answered FROM n),
 m AS (SELECT id, string_agg(c, ',' ORDER BY w) FILTER (c <> '{STATUS_COLUMN}' AND NOT (answered AND c = '{WORKFLOWS[9].column}')) AS missing FROM c GROUP BY id)
SELECT p.id, array_to_string(list_sort(list_distinct([9, own])), ',') AS ids, concat_ws(',', CASE WHEN NOT given THEN '{STATUS_COLUMN}' END, missing) AS missing, (CASE WHEN given THEN 0 ELSE 1 END) + (CASE WHEN missing IS NULL THEN 0 ELSE len(string_split(missing, ',')) END) + 1 AS problems FROM p JOIN m USING (id)""")
def workflow_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for each supplier: ids given twice and unknown ones, a mapping of the spine with or without the status, an answer for every third;
    no plan names its sheet."""
    s = table(spark, sf_dir, "supplier")
    spine = [x for k in (EQUIPMENT, GROUP, SUB) for x in (F.lit(k), F.lit("a"))]
    mapping = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(*spine, F.lit(STATUS_COLUMN), F.lit("s"))).otherwise(F.create_map(*spine))
    plans = s.select(F.col("s_suppkey").alias("id"), F.lit("f").alias("file"), F.lit(None).cast("string").alias("sheet"), F.array(F.lit(9), F.lit(99), (1 + F.col("s_suppkey") % 20).cast("int"), F.lit(9)).alias("workflow_ids"), mapping.alias("mapping"), F.lit(None).cast("map<string,string>").alias("constants"))
    answers = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), F.lit(WORKFLOWS[9].column).alias("name"), F.lit("1").alias("value"))
    done = refined_plans(normalized_plans(plans), answers, "id")
    return done.select("id", F.array_join(F.col("workflow_ids").cast("array<string>"), ",").alias("ids"), F.array_join("missing", ",").alias("missing"), F.size(plan_problems(done)).alias("problems"))
