"""Sources: tables, header and sheet detection, column resolution, sections, sinks.

Sheets come as cells ``(file, sheet, sheet_ord, row, col, value)``, rows and columns from 1 and 0; headers stay data until
they are resolved, so one job handles any number of files. Keyword lists are small tables fixed by the caller.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import collapsed, to_number
from ..sources.keywords import ALIASES, DEFAULT_VENDOR, HEADER_WORDS, TALLY_WORDS, VENDORS, merged, vendor_keywords
from ..sources.shared import kept, small_or_merged

SHEET = ["file", "sheet"]
SCAN_ROWS, ENOUGH, MAPPED_ENOUGH, MAX_SHEETS = 60, 5, 6, 10


def read_table(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv", header: bool = True, numbered: bool = False) -> DataFrame:
    """Files as all-text tables with the file's name; other columns of Parquet and JSON are turned to text. ``numbered``: with
    ``row_ord``, the row's number in its file (of text files the line's, so that the header is 1), however many splits it has."""
    paths = [path] if isinstance(path, str) else list(path)
    if numbered and fmt in ("csv", "tsv"):
        return split_lines(landed_lines(spark, paths), "\t" if fmt == "tsv" else ",", header)
    reader = spark.read.option("header", header).option("inferSchema", False) if fmt in ("csv", "tsv") else spark.read
    if fmt == "tsv":
        reader = reader.option("sep", "\t")
    df = reader.format("csv" if fmt == "tsv" else fmt).load(paths)
    place = [(F.col("_metadata.row_index") + 1).alias("row_ord")] if numbered else []  # Parquet only
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns), F.col("_metadata.file_name").alias("_file"), *place)


def landed_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines of text files with their number ``(_file, row_ord, line)``: the place inside a split, and the lines of the splits before it in
    its file. Lines are written once with their places; then only a row for each split is summed up."""
    lines = spark.read.text(list(paths)).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    landed = kept(lines, "landed")
    splits = landed.groupBy("path", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    ahead = kept(splits.select("path", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "splits")
    met = landed.join(small_or_merged(ahead), ["path", "split"])
    return met.select("path", "_file", (F.col("at") - F.col("first") + F.col("ahead") + 1).alias("row_ord"), "line")


def split_lines(lines: DataFrame, sep: str, header: bool) -> DataFrame:
    """Lines as all-text columns, named by the first line of the first file, else ``_c0`` and so on; blank lines go."""
    first = lines.where("row_ord = 1").agg(F.min_by("line", "path").alias("line")).first()[0] or ""
    names = next(csv.reader([first], delimiter=sep), [])
    columns = names if header else [f"_c{k}" for k in range(len(names))]
    schema = ", ".join(f"`{c}` string" for c in columns) or "`_c0` string"
    rows = lines.where(F.trim("line") != "").where("row_ord > 1" if header else "true").withColumn("r", F.from_csv("line", schema, {"sep": sep}))
    return rows.select("r.*", "_file", "row_ord")


def write_outputs(df: DataFrame, path: str, partition: str | None = None, fmt: str = "parquet") -> None:
    """One folder for each workflow or dig."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).format(fmt).save(path)


#: Rows of a file of an output folder.
FILE_ROWS = 1_000_000


def write_package(df: DataFrame, path: str, key: str, order: Sequence[str] = (), fmt: str = "parquet", file_rows: int = FILE_ROWS) -> DataFrame:
    """Three sinks of one job: ``by_key`` (a folder for each key), ``combined`` (all rows) and ``summary`` (rows and files of each key, a row for
    all as null), which is written last, so a folder without it isn't done. Rows are written once and dealt by key and salt: a large key has
    as many salts as files of ``file_rows``, a small one a single file. Gives the summary."""
    rows = kept(df, "package")
    counts = rows.groupBy(key).agg(F.count("*").alias("n_rows")).withColumn("files", F.ceil(F.col("n_rows") / file_rows).cast("int"))
    counts = kept(counts, "counts")
    sized = rows.join(small_or_merged(counts.select(F.col(key).alias("__k"), "files")), F.col(key).eqNullSafe(F.col("__k"))).drop("__k")
    salted = sized.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.col("files")).cast("int")).drop("files")
    dealt = salted.repartition(key, "__salt").sortWithinPartitions(key, "__salt", *order).drop("__salt")
    dealt.write.mode("overwrite").partitionBy(key).format(fmt).save(f"{path}/by_key")
    rows.write.mode("overwrite").format(fmt).save(f"{path}/combined")
    total = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))
    summary = counts.select(F.col(key).cast("string").alias("key"), "n_rows", F.col("files").cast("long").alias("files"), F.lit(False).alias("whole")).unionByName(total.select(F.lit(None).cast("string").alias("key"), "n_rows", "files", F.lit(True).alias("whole")))
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    return df.sparkSession.read.schema(summary.schema).parquet(f"{path}/summary")


def shown(value: Column) -> Column:
    return F.lower(collapsed(F.coalesce(value, F.lit(""))))


def parse_delimited_text(docs: DataFrame, text_col: str = "text", id_col: str = "file") -> DataFrame:
    """Pasted text as cells: tabs if the first record has any, else commas; the first record is row 1. A value in double quotes may
    hold separators, line breaks and doubled quotes."""
    rows = records(docs, text_col, id_col)
    cells = rows.select("file", "row", F.posexplode(F.when(F.col("sep") == ",", quoted_parts(F.col("record"), ",")).otherwise(quoted_parts(F.col("record"), "\t"))).alias("col", "value"))
    wide = cells.groupBy("file").agg(F.max("col").alias("w")).where("w > 0").select("file")
    return cells.join(wide.hint("merge"), "file", "left_semi").select("file", F.lit("text").alias("sheet"), F.lit(1).alias("sheet_ord"), "row", "col", "value")


def records(docs: DataFrame, text_col: str = "text", id_col: str = "file") -> DataFrame:
    """Records ``(file, row, sep, record)`` of pasted text, blank ones left out. A quote opens a value only where the value begins. Each line
    says whether it ends inside quotes, were it to begin outside and were it to begin inside; running over a text's lines, the last line for
    which both agree, and the number of lines that turn it round since, tell where each line begins. A line that begins
    outside starts a record. A text is one row of the input, which bounds the windows."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n"), "\n")
    first = F.get(F.filter(lines, lambda x: F.trim(x) != ""), F.lit(0))
    unquoted = F.regexp_replace(first, r'"(?:[^"]++|"")*+"', "")
    sep = F.when(unquoted.contains("\t"), "\t").otherwise(",")
    rows = docs.select(F.col(id_col).alias("file"), sep.alias("sep"), F.posexplode(lines).alias("n", "line"))

    def opened(text: Column) -> Column:
        tab = F.regexp_replace(text, r'(^|\t) *"(?:[^"]++|"")*+"', "$1x").rlike(r'(^|\t) *"')
        comma = F.regexp_replace(text, r'(^|,) *"(?:[^"]++|"")*+"', "$1x").rlike(r'(^|,) *"')
        return F.when(F.col("sep") == ",", comma).otherwise(tab)

    rest = F.regexp_replace("line", r'^(?:[^"]++|"")*+"', "x")
    inside = F.when(F.col("line").rlike(r'^(?:[^"]++|"")*+"'), opened(rest)).otherwise(True)
    by = W.partitionBy("file").orderBy("n")
    d = rows.withColumns({"out": opened(F.col("line")), "in": inside}).withColumn("turns", F.sum((F.col("out") & ~F.col("in")).cast("int")).over(by))
    known = F.when(F.col("out") == F.col("in"), F.struct(F.col("out").alias("v"), F.col("turns").alias("t")))
    d = d.withColumn("k", F.last(known, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)))
    ends_inside = F.coalesce(F.col("k.v"), F.lit(False)) != (F.pmod(F.col("turns") - F.coalesce("k.t", F.lit(0)), F.lit(2)) == 1)
    d = d.withColumn("ends_inside", ends_inside)
    starts = (~F.coalesce(F.lag("ends_inside").over(by), F.lit(False))).cast("int")
    d = d.withColumn("starts", starts).withColumn("record", F.sum("starts").over(by))
    made = d.groupBy("file", "sep", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x.line), "\n").alias("text"))
    full = made.where(F.trim("text") != "")
    return full.select("file", F.row_number().over(W.partitionBy("file").orderBy("record")).alias("row"), "sep", F.col("text").alias("record"))


def quoted_parts(line: Column, sep: str) -> Column:
    """A line's values, trimmed; quotes around a value go, doubled ones inside are one."""
    parts = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(rf'{sep}[ ]*("(?:[^"]++|"")*+"|[^{sep}]*)'), F.lit(1))
    return F.transform(parts, lambda x: F.trim(F.when(F.startswith(x, F.lit('"')), F.replace(F.regexp_replace(x, '^"|" *$', ""), F.lit('""'), F.lit('"'))).otherwise(x)))


def promote_header(cells: DataFrame) -> DataFrame:
    """Header names ``(file, sheet, col, name)`` where the first of at least two rows holds a header word; blank names
    become ``_colN``."""
    text = cells.where("row = 1").groupBy(*SHEET).agg(F.concat_ws(" ", F.collect_list(F.lower("value"))).alias("t"))
    two = cells.where("row >= 2").select(*SHEET).distinct()
    ok = text.where(F.col("t").rlike("|".join(HEADER_WORDS))).join(two.hint("merge"), SHEET, "left_semi").select(*SHEET)
    name = F.coalesce(F.nullif(F.trim("value"), F.lit("")), F.concat(F.lit("_col"), F.col("col").cast("string")))
    return cells.where("row = 1").join(ok.hint("merge"), SHEET, "left_semi").select(*SHEET, "col", name.alias("name"))


def keyword_table(spark: SparkSession, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(k, i, n.lower().strip()) for k, names in keywords.items() for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "key string, ord int, name string")


def keyword_hits(headers: DataFrame, keywords: Mapping[str, Sequence[str]], value: str = "value") -> DataFrame:
    """Header cells with each keyword that they equal, or contain if it has four letters or more. The keyword table is
    the caller's, of fixed size, so it is broadcast."""
    table = F.broadcast(keyword_table(headers.sparkSession, keywords))
    h = headers.withColumn("__h", F.lower(F.trim(F.coalesce(F.col(value).cast("string"), F.lit("")))))
    exact = F.col("__h") == F.col("name")
    met = h.join(table, exact | ((F.length("name") >= 4) & F.contains("__h", "name")))
    return met.withColumn("kind", F.when(exact, 0).otherwise(1))


def header_scores(cells: DataFrame, keywords: Mapping[str, Sequence[str]], scan: int = SCAN_ROWS) -> DataFrame:
    """Rows with at least two filled cells: keyword groups matched, cells filled."""
    top = cells.where(F.col("row") <= scan)
    filled = top.groupBy(*SHEET, "row").agg(F.count_if(shown(F.col("value")) != "").alias("filled")).where("filled >= 2")
    score = keyword_hits(top, keywords).groupBy(*SHEET, "row").agg(F.countDistinct("key").alias("score"))
    return filled.join(score.hint("merge"), [*SHEET, "row"])


def detect_header_row(cells: DataFrame, keywords: Mapping[str, Sequence[str]], min_matches: int = 2, enough: int = ENOUGH) -> DataFrame:
    """The first row that scores ``enough``, else the best by score, then filled cells, then position."""
    s = header_scores(cells, keywords).where(F.col("score") >= min_matches)
    best = F.min(F.struct((-F.col("score")).alias("s"), (-F.col("filled")).alias("f"), F.col("row").alias("row")))
    return s.groupBy(*SHEET).agg(F.coalesce(F.min(F.when(F.col("score") >= enough, F.col("row"))), best.row).alias("header_row"))


def select_sheet(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """The sheet of each file whose name equals one of the names, else holds one or is held by one, else the first."""
    sheets = cells.select("file", "sheet", "sheet_ord").distinct()
    own = shown(F.col("sheet"))
    listed = F.array(*(F.lit(" ".join(n.lower().split())) for n in names))
    rank = F.when(F.array_contains(listed, own), 0).when(F.exists(listed, lambda n: F.contains(own, n) | F.contains(n, own)), 1).otherwise(2)
    return sheets.withColumn("rank", rank).groupBy("file").agg(F.min_by("sheet", F.struct("rank", "sheet_ord")).alias("sheet"))


def resolve_columns(headers: DataFrame, keywords: Mapping[str, Sequence[str]], value: str = "header") -> DataFrame:
    """For each sheet and key the header that stands for it: exact before contained, longer keywords first, then keyword
    order, then the leftmost. ``headers``: file, sheet, col and the name."""
    hits = keyword_hits(headers, keywords, value)
    by = W.partitionBy(*SHEET, "key").orderBy("kind", F.desc(F.length("name")), "ord", "col")
    return hits.withColumn("__n", F.row_number().over(by)).where("__n = 1").select(*SHEET, "key", "col", F.col(value).alias("header"))


def resolve_by_vendor(headers: DataFrame, value: str = "header", override: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``resolve_columns`` for files of many vendors at once: ``headers`` also have the ``vendor``, whose own keywords count; an unknown one's are
    those of the default layout. ``override``: a user's names, before all others. The vendors' keyword table is of fixed size."""
    rows = [(v, k, i, n.lower().strip()) for v in VENDORS for k, names in merged(vendor_keywords(v)[0], dict(override or {})).items() for i, n in enumerate(names)]
    table = F.broadcast(headers.sparkSession.createDataFrame(rows, "__v string, key string, ord int, name string"))
    h = headers.withColumn("__h", F.lower(F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))))).withColumn("__v", F.when(F.col("vendor").isin(*VENDORS), F.col("vendor")).otherwise(DEFAULT_VENDOR))
    exact = F.col("__h") == F.col("name")
    met = h.join(table, "__v").where(exact | ((F.length("name") >= 4) & F.contains("__h", "name"))).withColumn("kind", F.when(exact, 0).otherwise(1))
    first = F.min_by(F.struct("col", F.col(value).alias("header")), F.struct("kind", -F.length("name"), "ord", "col"))
    return met.groupBy(*SHEET, "vendor", "key").agg(first.alias("f")).select(*SHEET, "vendor", "key", "f.*")


def headers_at(cells: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Header cells ``(file, sheet, col, header)`` of the detected rows."""
    met = cells.join(header_rows.hint("merge"), SHEET).where("row = header_row")
    name = F.coalesce(F.nullif(F.trim("value"), F.lit("")), F.concat(F.lit("_col"), F.col("col").cast("string")))
    return met.select(*SHEET, "col", name.alias("header"))


def choose_sheet_by_mapping(cells: DataFrame, keywords: Mapping[str, Sequence[str]], names: Sequence[str], min_matches: int = 2) -> DataFrame:
    """Per file the sheet and header row: the primary sheet first, then the others, ten in all; the first with six mapped
    keys, else the most mapped ones; without any header row, the primary sheet and row 1."""
    primary = select_sheet(cells, names).withColumnRenamed("sheet", "primary")
    sheets = cells.select("file", "sheet", "sheet_ord").distinct().join(primary, "file")
    order = F.row_number().over(W.partitionBy("file").orderBy(F.when(F.col("sheet") == F.col("primary"), 0).otherwise(1), "sheet_ord"))
    sheets = sheets.withColumn("ord", order).where(F.col("ord") <= MAX_SHEETS)
    rows = detect_header_row(cells.join(sheets.select(*SHEET), SHEET, "left_semi"), keywords, min_matches)
    mapped = resolve_columns(headers_at(cells, rows), keywords, "header").groupBy(*SHEET).agg(F.count("*").alias("mapped"))
    s = sheets.join(rows.join(mapped, SHEET), SHEET)
    best = F.min(F.struct((-F.col("mapped")).alias("m"), "ord", "sheet", "header_row"))
    early = F.min(F.when(F.col("mapped") >= MAPPED_ENOUGH, F.struct(F.lit(0).cast("bigint").alias("m"), "ord", "sheet", "header_row")))
    found = s.groupBy("file").agg(F.coalesce(early, best).alias("b")).select("file", F.col("b.sheet").alias("sheet"), F.col("b.header_row").alias("header_row"), F.col("b.m").alias("__m"))
    rest = primary.join(found, "file", "left_anti").select("file", F.col("primary").alias("sheet"), F.lit(1).alias("header_row"))
    return found.drop("__m").unionByName(rest)


def cells_to_table(cells: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Rows under the header as ``(file, sheet, row_ord, values map<int,string>)``; blank rows are skipped, and the table
    ends at three blank rows in a row once data began."""
    met = cells.join(header_rows.hint("merge"), SHEET).where("row > header_row")
    width = cells.join(header_rows.hint("merge"), SHEET).where("row = header_row").groupBy(*SHEET).agg(F.max("col").alias("last"))
    met = met.join(width.hint("merge"), SHEET).where((F.col("col") <= F.col("last")) & (shown(F.col("value")) != ""))
    rows = met.groupBy(*SHEET, "row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), "value"))).alias("values"))
    by = W.partitionBy(*SHEET).orderBy("row")
    ended = F.coalesce(F.col("row") - F.lag("row").over(by) > 3, F.lit(False)).cast("int")
    return rows.withColumn("__e", ended).withColumn("__e", F.max("__e").over(by)).where("__e = 0").select(*SHEET, F.row_number().over(by).alias("row_ord"), "values")


def named_table(table: DataFrame, resolved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values of resolved keys as columns; unresolved ones are null."""
    at = resolved.groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("col").cast("int")))).alias("at"))
    met = table.join(at.hint("merge"), SHEET)
    return met.select(*SHEET, "row_ord", *(F.try_element_at("values", F.try_element_at("at", F.lit(k))).alias(k) for k in keys))


def infer_vendor(name: Column) -> Column:
    """Vendor layout of a file name, by rules in order."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    tight = F.regexp_replace(low, "[^a-z0-9]", "")
    mfl_a = low.rlike(r"mfl\s*[-_/]?\s*a\b") | tight.contains("mfla")
    mfl_c = low.rlike(r"mfl\s*[-_/]?\s*c\b") | tight.contains("mflc") | tight.contains("cmfl")
    bh = low.rlike(r"(^|[^a-z0-9])bh([^a-z0-9]|$)") | low.contains("baker")
    return (
        F.when(bh & tight.contains("emat"), "BH-EMAT").when(bh & tight.contains("mfl"), "BH-MFLA").when(tight.contains("tdw"), "TDW")
        .when(mfl_a & mfl_c & tight.contains("cmfl"), "Rosen-MFLC").when(mfl_a, "Rosen-MFLA").when(mfl_c, "Rosen-MFLC").when(tight.contains("emat"), "Rosen-EMAT").otherwise(DEFAULT_VENDOR)
    )


def detect_data_format(resolved: DataFrame, headers: DataFrame) -> DataFrame:
    """``pipe_tally`` or ``anomaly`` for each sheet."""
    has = lambda k: F.coalesce(F.max(F.col("key") == k), F.lit(False)).alias(k)
    keys = resolved.groupBy(*SHEET).agg(*(has(k) for k in ("ds_distance", "wall_thickness", "pipe_grade", "joint_number", "depth", "feature_type")))
    words = headers.groupBy(*SHEET).agg(F.concat_ws(" ", F.collect_list(F.lower("header"))).alias("text"))
    hint = F.exists(F.array(*map(F.lit, TALLY_WORDS)), lambda w: F.contains("text", w))
    joint = F.col("joint_number") & ~F.col("depth")
    tally = F.col("ds_distance") | ((F.col("wall_thickness") | F.col("pipe_grade")) & joint) | (hint & joint & ~F.col("feature_type"))
    return words.join(keys, SHEET, "left").select(*SHEET, F.when(tally, "pipe_tally").otherwise("anomaly").alias("data_format"))


def reheader_banner(cells: DataFrame, resolved: DataFrame, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """For sheets without a depth or length column: the first of ten rows that speaks of both, if depth then maps."""
    have = resolved.where(F.col("key").isin("depth", "length")).groupBy(*SHEET).agg(F.countDistinct("key").alias("n")).where("n = 2")
    text = cells.where("row <= 10").groupBy(*SHEET, "row").agg(F.concat_ws(" ", F.collect_list(F.lower("value"))).alias("t"))
    rows = text.where(F.col("t").contains("depth") & F.col("t").contains("length")).groupBy(*SHEET).agg(F.min("row").alias("header_row")).join(have, SHEET, "left_anti")
    mapped = resolve_columns(headers_at(cells, rows), {"depth": keywords["depth"]}, "header").select(*SHEET).distinct()
    return rows.join(mapped, SHEET, "left_semi")


def canonical_columns(df: DataFrame, required: Sequence[str], aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Columns under canonical names, the required ones only; what is missing is an error."""
    low = {c.lower().strip(): c for c in reversed(df.columns)}
    found = {k: next((low[a.lower().strip()] for a in aliases.get(k, [k]) if a.lower().strip() in low), None) for k in required}
    if missing := [k for k, c in found.items() if c is None]:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df.select(*(F.col(f"`{c}`").alias(k) for k, c in found.items()))


def auto_sheet(cells: DataFrame, required: Sequence[str], preferred: Sequence[str] = (), aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """The first non-empty sheet (preferred ones first) whose header row 1 has all required columns."""
    names = cells.sparkSession.createDataFrame([(k, a.lower().strip()) for k in required for a in aliases.get(k, [k])], "key string, alias string")
    head = cells.where("row = 1").withColumn("alias", F.lower(F.trim("value")))
    full = head.join(F.broadcast(names), "alias").groupBy("file", "sheet", "sheet_ord").agg(F.countDistinct("key").alias("n")).where(F.col("n") == len(required))
    full = full.join(cells.where("row > 1").select(*SHEET).distinct(), SHEET, "left_semi")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)).cast("array<string>"), F.col("sheet")), F.lit(0)), F.lit(10**6))
    return full.groupBy("file").agg(F.min_by("sheet", F.struct(rank.alias("r"), "sheet_ord")).alias("sheet"))


def unique_headers(headers: DataFrame, value: str = "header") -> DataFrame:
    """Later copies of a name get ``__2``, ``__3``."""
    n = F.row_number().over(W.partitionBy(*SHEET, F.col(value)).orderBy("col"))
    return headers.withColumn(value, F.when(n == 1, F.col(value)).otherwise(F.concat(F.col(value), F.lit("__"), n.cast("string"))))


def dedupe_columns(headers: DataFrame, value: str = "header") -> DataFrame:
    """Later copies of a name go."""
    n = F.row_number().over(W.partitionBy(*SHEET, F.col(value)).orderBy("col"))
    return headers.withColumn("__n", n).where("__n = 1").drop("__n")


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every cell of a merged range shows its top-left value. Ranges are exploded to their cells, an equi-join."""
    each = ranges.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    top = each.join(cells.select(*SHEET, F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("value").alias("shown")).hint("merge"), [*SHEET, "r0", "c0"], "left").select(*SHEET, "row", "col", "shown")
    out = cells.join(top.hint("merge"), [*SHEET, "row", "col"], "full_outer")
    ords = cells.select(*SHEET, F.col("sheet_ord").alias("__o")).distinct()
    return out.join(ords.hint("merge"), SHEET, "left").select(*SHEET, F.coalesce("sheet_ord", "__o").alias("sheet_ord"), "row", "col", F.coalesce("shown", "value").alias("value"))


def title_of(keywords: Sequence[str]) -> Column:
    """Whether a ``text`` holds one of the titles or is held by one."""
    text, names = F.col("text"), [F.lit(k.lower()) for k in keywords]
    return (text != "") & reduce(lambda x, y: x | y, (F.contains(text, k) | F.contains(k, text) for k in names))


def filled_rows(cells: DataFrame, marks: Mapping[str, Column]) -> DataFrame:
    """Rows with a filled cell: their ``cells`` (col, value) in order, filled and distinct values in columns 1-20, and for each mark,
    a condition on the shown ``text``, whether one of the first five columns meets it in rows 1-500."""
    texts = cells.where("file IS NOT NULL AND sheet IS NOT NULL").withColumn("text", shown(F.col("value")))
    own = F.when(F.col("col") < 20, F.nullif("text", F.lit("")))
    early = (F.col("row") <= 500) & (F.col("col") < 5)
    found = [F.coalesce(F.bool_or(early & mark), F.lit(False)).alias(name) for name, mark in marks.items()]
    rows = texts.groupBy(*SHEET, "row").agg(F.min("sheet_ord").alias("sheet_ord"), F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"), F.count_if(F.col("text") != "").alias("filled"), F.count(own).alias("n"), F.size(F.collect_set(own)).alias("d"), *found)
    return rows.where("filled > 0").drop("filled")


def with_sections(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``filled_rows`` with ``<name>_title``, ``_header``, ``_first`` and ``_last``, the rows of their sheet's section for each of these marks
    (see ``find_section``), all in one pass over the rows of a sheet."""
    ordered = W.partitionBy(*SHEET).orderBy("row")
    every, upto = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), ordered.rowsBetween(W.unboundedPreceding, 0)
    row, at = F.col("row"), lambda name, part: F.col(f"{name}_{part}")
    out = rows.withColumns({f"{m}_title": F.min(F.when(F.col(m), row)).over(every) for m in names})
    out = out.withColumns({f"{m}_header": F.min(F.when((row > at(m, "title")) & (row <= at(m, "title") + 19) & (F.col("n") >= 3) & (F.col("d") >= 3), row)).over(every) for m in names})
    below = {m: F.when(row > at(m, "header"), row) for m in names}
    out = out.withColumns({f"{m}_first": F.min(below[m]).over(every) for m in names} | {f"{m}_nth": F.count(below[m]).over(upto) for m in names})
    return out.withColumns({f"{m}_last": F.max(F.when(row - at(m, "nth") == at(m, "first") - 1, below[m])).over(every) for m in names}).drop(*(f"{m}_nth" for m in names))


def find_section(cells: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Header and last row of a titled section: the title is in rows 1-500 and the first five columns; the header is the
    first of the next 19 rows with three filled and three distinct values in columns 1-20; data ends at the first
    blank row once it began."""
    rows = with_sections(filled_rows(cells.withColumn("sheet_ord", F.lit(1)), {"s": title_of(keywords)}), ["s"])
    return rows.where("row = s_header").select(*SHEET, *(F.col(f"s_{part}").alias(f"{part}_row") for part in ("title", "header", "first", "last")))


# Rows below the title, columns of a row, titles that end the block.
NDE_ROWS, NDE_COLUMNS, NDE_ENDS = 49, 25, ("feature summary", "joint summary")


def nde_title() -> Column:
    """Whether a ``text`` is the title of a block of limits."""
    return F.col("text").contains("nde") & F.col("text").contains("limit")


def label_and_value(own: Column) -> tuple[Column, Column]:
    """A row's first number behind a text, and the texts before it in lower case. ``own``: structs (text, number) of its filled cells in order."""
    from_text = F.slice(own, F.greatest(F.array_position(F.transform(own, lambda x: x.number.isNull()), F.lit(True)), F.lit(1)).cast("int"), F.greatest(F.size(own), F.lit(1)))
    at = F.array_position(F.transform(from_text, lambda x: x.number.isNotNull()), F.lit(True))
    texts = F.slice(from_text, 1, F.when(at > 0, at - 1).otherwise(F.size(from_text)).cast("int"))
    label = F.lower(F.array_join(F.transform(F.filter(texts, lambda x: x.number.isNull()), lambda x: x.text), " "))
    return label, F.when(label != "", F.get(from_text, (at - 1).cast("int")).number)


def limits_below(near: DataFrame, keys: Sequence[str] = SHEET) -> DataFrame:
    """The limits that the cells below a sheet's title name (see ``parse_nde_limits``). Texts and numbers are made once a cell, before rows are built."""
    number = to_number(F.replace(F.col("value"), F.lit(",")))
    made = near.select(*keys, "row", "col", "value", collapsed(F.coalesce("value", F.lit(""))).alias("text"), F.when(~F.regexp_replace("value", "[eE]", "").rlike(r"\p{L}"), number).alias("number"))
    rows = made.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("col", "value", "text", "number")))).alias("own"))
    label, value = label_and_value(F.col("own"))
    r = rows.select(*keys, "row", label.alias("label"), value.alias("v"))
    lab, v = F.col("label"), F.col("v")
    ends = reduce(lambda x, y: x | y, (lab.contains(k) for k in NDE_ENDS))
    r = r.withColumn("stop", F.min(F.when(ends, F.col("row"))).over(W.partitionBy(*keys))).where("(stop IS NULL OR row < stop) AND v IS NOT NULL")
    target = lab.contains("target") & lab.contains("girth") & lab.contains("weld")
    down = lab.contains("from d/s") | lab.contains("from ds ") | lab.contains("d/s gw")
    tgw = ~target & ~down & lab.contains("tgw")
    number = F.bround(v, 0).cast("bigint")
    pick = lambda cond, x: F.max_by(F.when(cond, x), F.when(cond, F.col("row")))
    whole = ~target & ~down & lab.contains("nde assessment length")
    out = r.groupBy(*keys).agg(pick(whole, v).alias("length_m"), pick(tgw & lab.contains("nde assessment start"), v).alias("start_m"), pick(tgw & lab.contains("nde assessment end"), v).alias("end_m"), pick(target & (number > 100) & (number < 99999), number).alias("target_gwd"))
    off = F.abs(F.abs(F.col("end_m") - F.col("start_m")) - F.col("length_m")) > 0.06
    return out.where("start_m IS NOT NULL AND end_m IS NOT NULL").withColumn("length_differs", F.coalesce(off, F.lit(False)))


def parse_nde_limits(cells: DataFrame) -> DataFrame:
    """Assessment length, start and end from the target weld, and the target's number, from the 49 rows under a title with ``nde`` and
    ``limit`` in rows 1-500 and the first five columns. Only labels of the NDE assessment count (exposure limits don't), start and
    end only from the TGW; the last of equal labels wins; a summary's title ends the block. None unless start and end are there;
    a length off by more than 0.06 m is marked."""
    early = cells.where("row <= 500 AND col < 5").withColumn("text", shown(F.col("value")))
    at = early.where(nde_title()).groupBy(*SHEET).agg(F.min("row").alias("t"))
    return limits_below(cells.join(at.hint("merge"), SHEET).where((F.col("row") > F.col("t")) & (F.col("row") <= F.col("t") + NDE_ROWS) & (F.col("col") < NDE_COLUMNS)))


def table_profile(cells: DataFrame, max_cols: int = 60, samples: int = 6) -> DataFrame:
    """Per sheet: columns (row 1), data rows, sample rows as text; the primary sheet is the first ``Source_Data``, else
    the first sheet of the first file."""
    cols = cells.where((F.col("row") == 1) & (F.col("col") < max_cols)).groupBy("file", "sheet", "sheet_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x.value).alias("columns"))
    rows = cells.where("row > 1").groupBy(*SHEET, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: F.coalesce(x.value, F.lit(""))), "\t").alias("line"))
    counts = rows.groupBy(*SHEET).agg(F.count("*").alias("n_rows"))
    nth = F.row_number().over(W.partitionBy(*SHEET).orderBy("row"))
    some = rows.withColumn("n", nth).where(F.col("n") <= samples).groupBy(*SHEET).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x.line).alias("samples"))
    out = cols.join(counts.hint("merge"), SHEET, "left").join(some.hint("merge"), SHEET, "left").fillna(0, ["n_rows"])
    first = cols.agg(F.min(F.struct(F.when(F.col("sheet") == "Source_Data", 0).otherwise(1).alias("p"), "file", "sheet_ord", "sheet")).alias("f"))
    return out.join(F.broadcast(first)).withColumn("is_primary", (F.col("file") == F.col("f.file")) & (F.col("sheet") == F.col("f.sheet"))).drop("f")
