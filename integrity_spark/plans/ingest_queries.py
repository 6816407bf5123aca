"""Header, sheet and column resolution over sheets that hold the customers and suppliers of each nation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..sources.fixtures import table
from ..sources.keywords import INSPECTION
from ..sources.shared import shared_dir
from .registry import query

HEADERS = ("Feature ID", "Feature Type", "Peak Depth", "Length (mm)", "Log Dist.")
FIRST = 3


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a nation: a cover sheet, and a listing with a banner in row 1, headers in row 2 and its customers below."""
    c = table(spark, sf_dir, "customer")
    row = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) + FIRST - 1
    values = F.array(F.col("c_custkey").cast("string"), F.lit("Metal Loss"), (F.abs("c_acctbal") % 60).cast("int").cast("string"), F.col("c_custkey").cast("string"), (F.col("c_custkey") * 12).cast("string"))
    body = c.withColumn("row", row).select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("file"), "row", F.posexplode(values).alias("col", "value"))
    files = body.select("file").distinct()
    head = files.select("file", F.lit(2).alias("row"), F.posexplode(F.array(*map(F.lit, HEADERS))).alias("col", "value"))
    banner = files.select("file", F.lit(1).alias("row"), F.lit(0).alias("col"), F.lit("Listing of metal loss features").alias("value"))
    listing = body.unionByName(head).unionByName(banner).select("file", F.lit("Anomaly Listing").alias("sheet"), F.lit(2).alias("sheet_ord"), "row", "col", "value")
    cover = files.select("file", F.lit("Cover").alias("sheet"), F.lit(1).alias("sheet_ord"), F.lit(1).alias("row"), F.lit(0).alias("col"), F.lit("Report").alias("value"))
    return listing.unionByName(cover)


_FILES = "SELECT DISTINCT 'n' || cast(c_nationkey AS varchar) AS file FROM customer"


@query(f"SELECT file, 'Anomaly Listing' AS sheet, 2 AS header_row FROM ({_FILES})")
def detect_header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.detect_header_row(sheets(spark, sf_dir), INSPECTION)


@query(f"SELECT file, 'Anomaly Listing' AS sheet FROM ({_FILES})")
def select_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.select_sheet(sheets(spark, sf_dir), ["Anomalies", "Anomaly", "Anomaly Listing"])


@query(f"SELECT file, 'Anomaly Listing' AS sheet, 2 AS header_row FROM ({_FILES})")
def choose_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.choose_sheet_by_mapping(sheets(spark, sf_dir), INSPECTION, ["Anomalies"])


@query(f"SELECT file, k.key AS key, k.col AS col, k.header AS header FROM ({_FILES}), (VALUES ('feature_id', 0, 'Feature ID'), ('feature_type', 1, 'Feature Type'), ('depth', 2, 'Peak Depth'), ('length', 3, 'Length (mm)'), ('distance', 4, 'Log Dist.')) AS k(key, col, header)")
def resolve_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sheets(spark, sf_dir)
    found = I.resolve_columns(I.headers_at(cells, I.detect_header_row(cells, INSPECTION)), INSPECTION)
    return found.where(F.col("key").isin("feature_id", "feature_type", "depth", "length", "distance")).select("file", "key", "col", "header")


@query("SELECT 'n' || cast(c_nationkey AS varchar) AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row_ord, cast(c_custkey AS varchar) AS feature_id, cast(cast(trunc(abs(c_acctbal) % 60) AS integer) AS varchar) AS depth, cast(c_custkey * 12 AS varchar) AS distance FROM customer")
def sheet_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From cells to a named table, all files in one job."""
    cells = sheets(spark, sf_dir)
    rows = I.detect_header_row(cells, INSPECTION)
    found = I.resolve_columns(I.headers_at(cells, rows), INSPECTION)
    named = I.named_table(I.cells_to_table(cells, rows), found, ["feature_id", "depth", "distance"])
    return named.select("file", F.col("row_ord").cast("long").alias("row_ord"), "feature_id", "depth", "distance")


@query(f"SELECT file, 'anomaly' AS data_format FROM ({_FILES})")
def detect_data_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sheets(spark, sf_dir)
    heads = I.headers_at(cells, I.detect_header_row(cells, INSPECTION))
    return I.detect_data_format(I.resolve_columns(heads, INSPECTION), heads).select("file", "data_format")


@query("SELECT 'n' || cast(c_nationkey AS varchar) AS file, 'Anomaly Listing' AS sheet, count(*) + 1 AS n_rows FROM customer GROUP BY c_nationkey UNION ALL SELECT DISTINCT 'n' || cast(c_nationkey AS varchar), 'Cover', 0 FROM customer")
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table_profile(sheets(spark, sf_dir)).select("file", "sheet", "n_rows")


@query("SELECT 'n' || cast(c_nationkey AS varchar) AS file, 2 + count(*) AS last_row FROM customer GROUP BY c_nationkey")
def find_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.find_section(sheets(spark, sf_dir), ["listing of metal loss"]).select("file", F.col("last_row").cast("long").alias("last_row"))


@query("SELECT 'n' || cast(c_nationkey AS varchar) AS file, 1 AS row, 0 AS col, 'a' AS value FROM customer GROUP BY c_nationkey UNION ALL SELECT 'n' || cast(c_nationkey AS varchar), 1, 1, cast(count(*) AS varchar) FROM customer GROUP BY c_nationkey")
def parse_delimited_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    docs = c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("file"), F.concat(F.lit("a,"), F.col("n").cast("string")).alias("text"))
    return I.parse_delimited_text(docs).select("file", "row", "col", "value")


_NAMES = "CASE p_partkey % 9 WHEN 0 THEN 'BH EMAT ' || p_name WHEN 1 THEN 'Baker_mfl_2020 ' || p_name WHEN 2 THEN p_name || '-TDW' WHEN 3 THEN p_name || ' MFL-A' WHEN 4 THEN 'CMFL MFL-A ' || p_name WHEN 5 THEN 'MFL / C ' || p_name WHEN 6 THEN 'run EMAT' || p_name WHEN 7 THEN NULL ELSE p_name END"


@query(f"SELECT {_NAMES} AS name, CASE p_partkey % 9 WHEN 0 THEN 'BH-EMAT' WHEN 1 THEN 'BH-MFLA' WHEN 2 THEN 'TDW' WHEN 3 THEN 'Rosen-MFLA' WHEN 4 THEN 'Rosen-MFLC' WHEN 5 THEN 'Rosen-MFLC' WHEN 6 THEN 'Rosen-EMAT' ELSE 'Rosen-MFLA' END AS vendor FROM part")
def infer_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by each rule in turn, null ones, and plain ones."""
    p = table(spark, sf_dir, "part").select(F.expr(_NAMES).alias("name"))
    return p.select("name", I.infer_vendor(F.col("name")).alias("vendor"))


@query("SELECT 'n' || cast(n_nationkey AS varchar) AS file, r AS row, c AS col, CASE WHEN c < 2 THEN 'top ' || n_name ELSE 'own' || cast(r AS varchar) END AS value FROM nation, (VALUES (1), (2)) AS a(r), (VALUES (0), (1), (2)) AS b(c)")
def fill_merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of two rows and two columns beside cells of its own, of which just some are stored."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file"), F.lit("S").alias("sheet"), F.lit(1).alias("sheet_ord"), "n_name")
    cells = n.select("file", "sheet", "sheet_ord", F.inline(F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), v.alias("value")) for r, c, v in ((1, 0, F.concat(F.lit("top "), "n_name")), (1, 2, F.lit("own1")), (2, 1, F.lit("hidden")), (2, 2, F.lit("own2")))))))
    ranges = n.select("file", "sheet", F.lit(1).alias("r0"), F.lit(0).alias("c0"), F.lit(2).alias("r1"), F.lit(1).alias("c1"))
    return I.fill_merged(cells, ranges).select("file", "row", "col", "value")


def laid(spark: SparkSession, sf_dir: str, rows: list[tuple[int, list[str | None]]], sheet: str = "S", sheet_ord: int = 1) -> DataFrame:
    """A sheet a nation: row numbers, and the values of each as SQL over the nation."""
    n = table(spark, sf_dir, "nation")
    cells = F.array(*(F.struct(F.expr(str(r)).cast("int").alias("row"), F.lit(c).alias("col"), F.expr(v).cast("string").alias("value")) for r, values in rows for c, v in enumerate(values) if v is not None))
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file"), F.lit(sheet).alias("sheet"), F.lit(sheet_ord).alias("sheet_ord"), F.inline(cells))


_N = "'n' || cast(n_nationkey AS varchar) AS file"


@query(f"SELECT {_N}, c AS col, CASE c WHEN 0 THEN 'ILI Chainage' WHEN 1 THEN '_col1' ELSE n_name END AS name FROM nation, (VALUES (0), (1), (2)) AS k(c) WHERE n_nationkey % 2 = 0")
def promote_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other nation's first row holds a header word."""
    cells = laid(spark, sf_dir, [(1, ["CASE WHEN n_nationkey % 2 = 0 THEN 'ILI Chainage' ELSE 'x' END", "' '", "n_name"]), (2, ["1", "2", "3"])])
    return I.promote_header(cells.withColumn("value", F.when(F.col("value").isNotNull(), F.col("value")))).select("file", "col", "name")


_COPIES = "CASE c % 3 WHEN 0 THEN n_name WHEN 1 THEN 'Depth' ELSE CASE WHEN n_regionkey = c THEN 'Depth' ELSE 'c' || cast(c AS {0}) END END"


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file"), F.lit("S").alias("sheet"), F.col("c").alias("col"), F.expr(_COPIES.format("string")).alias("header"))


_HEADS = f"SELECT {_N}, c AS col, {_COPIES.format('varchar')} AS header FROM nation, (SELECT unnest(range(0, 7)) AS c)"


@query(f"SELECT file, col, header || CASE WHEN n > 1 THEN '__' || cast(n AS varchar) ELSE '' END AS header FROM (SELECT *, row_number() OVER (PARTITION BY file, header ORDER BY col) AS n FROM ({_HEADS}))")
def unique_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.unique_headers(copies(spark, sf_dir)).select("file", "col", "header")


@query(f"SELECT file, col, header FROM ({_HEADS}) QUALIFY row_number() OVER (PARTITION BY file, header ORDER BY col) = 1")
def dedupe_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.dedupe_columns(copies(spark, sf_dir)).select("file", "col", "header")


@query("SELECT cast(s_suppkey AS varchar) AS equipment, s_name AS circuit FROM supplier")
def canonical_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns under other spellings of two canonical names."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("equip id "), F.col("s_name").alias("CIRCUIT #"), "s_acctbal")
    return I.canonical_columns(s, ["Equipment ID", "Circuit ID"]).toDF("equipment", "circuit")


@query(f"SELECT {_N}, CASE WHEN n_nationkey % 3 = 0 THEN 'Second' WHEN n_nationkey % 3 = 1 THEN 'First' ELSE 'Liked' END AS sheet FROM nation")
def auto_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sheet that has both columns and rows, or a preferred one that has."""
    full_ = ["'Equip ID'", "' circuit number '"]
    some = lambda k, name, order: laid(spark, sf_dir, [(1, full_), (2, ["1", "2"])], name, order).where(k)
    nth = "cast(substring(file, 2) AS int) % 3"
    first = laid(spark, sf_dir, [(1, ["'Equip ID'", f"CASE WHEN n_nationkey % 3 = 0 THEN 'none' ELSE 'Circuit #' END"]), (2, ["1", "2"])], "First", 1)
    cells = first.unionByName(some("true", "Second", 2)).unionByName(some(f"{nth} = 2", "Liked", 3)).unionByName(laid(spark, sf_dir, [(1, full_)], "Bare", 0))
    return I.auto_sheet(cells, ["Equipment ID", "Circuit ID"], ["Liked"])


@query(f"SELECT {_N}, 2 + n_nationkey % 5 AS header_row FROM nation WHERE n_nationkey % 4 <> 3")
def reheader_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banners over headers that only a lower row spells out; a quarter of the sheets resolve at once and are left alone."""
    head = ["'Log Dist.'", "'Peak Depth'", "'Length (mm)'"]
    low = laid(spark, sf_dir, [("2 + n_nationkey % 5", head), ("3 + n_nationkey % 5", ["1", "2", "3"])]).where("cast(substring(file, 2) AS int) % 4 <> 3")
    top = laid(spark, sf_dir, [(1, ["'Listing of ' || n_name"])]).where("cast(substring(file, 2) AS int) % 4 <> 3")
    fine = laid(spark, sf_dir, [(1, head), (2, ["1", "2", "3"])]).where("cast(substring(file, 2) AS int) % 4 = 3")
    cells = low.unionByName(top).unionByName(fine)
    resolved = I.resolve_columns(I.headers_at(cells, cells.select("file", "sheet").distinct().withColumn("header_row", F.lit(1))), INSPECTION)
    return I.reheader_banner(cells, resolved, INSPECTION).select("file", F.col("header_row").cast("long").alias("header_row"))


@query(f"SELECT {_N}, 5e0 + n_regionkey AS length_m, -2e0 AS start_m, 3e0 + n_nationkey % 2 AS end_m, 1000 + n_nationkey AS target_gwd, abs(5 + n_nationkey % 2 - 5 - n_regionkey) > 0.06e0 AS length_differs FROM nation")
def parse_nde_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits under their title: exposure limits, distances from other welds, other labels and rows below a summary don't count,
    the last of two lengths does, 40 rows below the title."""
    rows = [(3, ["'NDE Limits'"]), (4, ["'Target Girth Weld (U/S)'", "1000 + n_nationkey"]), (5, ["'NDE Exposure Length (m)'", "50"]), (6, ["'NDE Exposure Start from TGW (m)'", "-9"]), (7, ["'NDE Assessment Length (m)'", "1"]), (8, ["7", "'NDE Assessment Start from TGW (m)'", "-2"])]
    rows += [(9, ["'NDE Assessment Start from D/S GW (m)'", "77"]), (10, ["'bend start from TGW'", "88"]), (11, ["'NDE Exposure End from TGW (m)'", "66"]), (30, ["'NDE Assessment'", "'End from TGW (m)'", "3 + n_nationkey % 2", "99"]), (43, ["'NDE Assessment Length (m)'", "5 + n_regionkey"]), (45, ["'Joint Summary'"]), (46, ["'NDE Assessment Start from TGW (m)'", "99"])]
    return I.parse_nde_limits(laid(spark, sf_dir, rows)).drop("sheet")


@query(f"SELECT {_N}, CASE WHEN n_nationkey % 2 = 0 THEN 'pipe_tally' ELSE 'anomaly' END AS data_format FROM nation")
def detect_tally_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies have joints and a downstream distance or a wall, anomaly lists have depths."""
    even = "CASE WHEN n_nationkey % 2 = 0 THEN '{0}' ELSE '{1}' END".format
    cells = laid(spark, sf_dir, [(1, [even("Joint Number", "Feature Type"), even("DS Chainage (m)", "Peak Depth"), even("Nominal WT", "Length (mm)")])])
    heads = I.headers_at(cells, cells.select("file", "sheet").distinct().withColumn("header_row", F.lit(1)))
    return I.detect_data_format(I.resolve_columns(heads, INSPECTION), heads).select("file", "data_format")


@query("SELECT cast(p_partkey AS varchar) AS file, r AS row, c AS col, CASE r WHEN 1 THEN CASE c WHEN 0 THEN 'id' WHEN 1 THEN 'name' ELSE 'note' END ELSE CASE c WHEN 0 THEN cast(p_partkey AS varchar) WHEN 1 THEN p_name || ', ' || p_brand ELSE 'say \"' || cast(p_size AS varchar) || '\"' END END AS value FROM part, (VALUES (1), (2)) AS a(r), (VALUES (0), (1), (2)) AS b(c)")
def parse_quoted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with separators and quotes inside; every other text is parted by tabs."""
    p = table(spark, sf_dir, "part")
    sep = F.when(F.col("p_partkey") % 2 == 0, ",").otherwise("\t")
    line = F.concat(F.lit("id"), sep, F.lit("name"), sep, F.lit("note\r\n\r\n"), F.col("p_partkey").cast("string"), sep, F.lit(' "'), "p_name", F.lit(", "), "p_brand", F.lit('"'), sep, F.lit('"say ""'), F.col("p_size").cast("string"), F.lit('"""'))
    return I.parse_delimited_text(p.select(F.col("p_partkey").cast("string").alias("file"), line.alias("text"))).select("file", "row", "col", "value")


_SEP = "CASE WHEN p_partkey % 2 = 0 THEN ',' ELSE chr(9) END"
_BROKEN = [(1, 0, "'id'"), (1, 1, "'name'"), (1, 2, "'note'"), (2, 0, "cast(p_partkey AS varchar)"), (2, 1, "p_name || chr(10) || 'second ' || chr(34) || 'q' || chr(34) || ' line'"), (2, 2, "'5' || chr(34) || ' pipe'"), (3, 0, "'y'"), (3, 1, f"'a' || {_SEP} || 'b' || chr(10) || chr(10) || 'c'"), (3, 2, "'end'")]


@query(" UNION ALL ".join(f"SELECT cast(p_partkey AS varchar) AS file, {r} AS row, {c} AS col, {v} AS value FROM part" for r, c, v in _BROKEN))
def parse_broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values over several lines, blank ones among them, doubled quotes, a separator inside, and a quote that opens nothing; commas and tabs."""
    p = table(spark, sf_dir, "part")
    sep = F.when(F.col("p_partkey") % 2 == 0, ",").otherwise("\t")
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("id"), sep, F.lit("name"), sep, F.lit("note\r\n"), key, sep, F.lit('"'), "p_name", F.lit('\nsecond ""q"" line"'), sep, F.lit('5" pipe\n"y"'), sep, F.lit('"a'), sep, F.lit('b\n\nc"'), sep, F.lit("end\n\n"))
    return I.parse_delimited_text(p.select(key.alias("file"), text.alias("text"))).select("file", "row", "col", "value")


@query("SELECT cast(o_orderkey AS varchar) AS id, 2 AS off, cast(o_custkey AS varchar) AS customer FROM orders")
def landed_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of many splits, written with each row's place: row numbers are that place and the header."""
    path, size = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}", "spark.sql.files.maxPartitionBytes"
    sorted_rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey")
    sorted_rows.withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))).write.option("header", True).csv(path)
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        back = I.read_table(spark, path, "csv", numbered=True)
    finally:
        spark.conf.set(size, before)
    return back.select(F.col("o_orderkey").alias("id"), (F.col("row_ord") - F.col("place").cast("bigint")).cast("int").alias("off"), F.col("o_custkey").alias("customer"))


@query("SELECT CAST(c_nationkey AS varchar) AS key, count(*) AS n_rows, count(*) AS n_read, CAST(ceil(count(*) / 40.0) AS bigint) AS files, FALSE AS whole FROM customer GROUP BY c_nationkey UNION ALL SELECT NULL, count(*), count(*), (SELECT sum(f)::BIGINT FROM (SELECT ceil(count(*) / 40.0) AS f FROM customer GROUP BY c_nationkey)), TRUE FROM customer")
def write_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder a nation in files of 40 rows, all rows together, and the summary, read back and compared."""
    path = f"{shared_dir(spark)}/package-{uuid.uuid4().hex}"
    summary = I.write_package(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), path, "nation", ("id",), file_rows=40)
    parts = spark.read.parquet(f"{path}/by_key").groupBy(F.col("nation").cast("string").alias("k")).agg(F.count("*").alias("n_read"))
    whole = spark.read.parquet(f"{path}/combined").agg(F.lit(None).cast("string").alias("k"), F.count("*").alias("n_read"))
    return summary.join(parts.unionByName(whole).hint("merge"), F.col("key").eqNullSafe(F.col("k")), "left").select("key", "n_rows", "n_read", "files", "whole")


@query("SELECT cast(s_nationkey AS varchar) AS nation, cast(s_suppkey AS varchar) AS id, s_name AS name FROM supplier")
def write_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder a nation, written to the session's shared folder and read back as text."""
    path = f"{shared_dir(spark)}/outputs-{uuid.uuid4().hex}"
    I.write_outputs(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), path, "nation", "csv")
    back = I.read_table(spark, path, "csv", header=False)
    return back.select("nation", F.col("_c0").alias("id"), F.col("_c1").alias("name"))


@query("SELECT 'n' || cast(c_nationkey AS varchar) AS file, row, 0 AS col, 'Listing of metal loss features' AS value FROM (SELECT DISTINCT c_nationkey FROM customer), (VALUES (1)) AS r(row)")
def fill_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The banner of each listing, merged over five columns: its first cell."""
    cells = sheets(spark, sf_dir)
    ranges = cells.select("file", F.lit("Anomaly Listing").alias("sheet")).distinct().select("file", "sheet", F.lit(1).alias("r0"), F.lit(0).alias("c0"), F.lit(1).alias("r1"), F.lit(4).alias("c1"))
    return I.fill_merged(cells.where("sheet = 'Anomaly Listing'"), ranges).where("row = 1 AND col = 0").select("file", "row", "col", "value")
