"""Wall-thickness readings out of report text, table rows and recognised tokens, and their loader.

Tables: ``report_text(report, page, text)``, ``report_rows(report, page, table_no, row_no, cells array<string>)``,
``tokens(report, page, text, conf, left, right, top, bottom, cy, height)``. A report's metadata row is
``(report, circuit_id, measurement_date, cml_ids)``. Readings: ``(report, circuit_id, cml_id, measurement_date,
min_reading, all_readings, method, page)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import reports as R
from ..functions.scalars import collapsed
from .tml import CONSTANTS
from .token_tables import table_readings
from ..sources.shared import kept, small_or_merged

# Titles of summary pages, marks of grid pages, header and skip words of result tables.
SUMMARY_TITLE = r"(?i)(?:U\s*T\s*R\s*E\s*P\s*O\s*R\s*T|UT\s+REPORT)\s*[-–]\s*(?:T\s*E\s*E|TEE|E\s*L\s*B\s*O\s*W|ELBOW|CONNECTIONS?|PIPE|REDUCER|CAP|WELD|STRAIGHT)"
GRID_PAGE = r"""(?i)UT\s+Grid|GRID\s+Reading|GRID\s+STARTS|(?<![0-9A-Za-z])[12]\s*["']?\s*[xX]\s*[12]\s*["']?"""
NO_READING = r"(?i)\bN/?A\b|\bFLANGE\b"
HEADER = {"diameter": r"(?i)CIRCUIT|CML|SECTION|DIAM", "permissive": r"(?i)CIRCUIT|CML|SECTION|DIAM|ZONE|NORTH|SOUTH", "zone": r"(?i)CIRCUIT|CML\s+[A-Z]|ZONE|DIAM|SECTION|NORTH|SOUTH"}
DIAMETERS = {"diameter": ("8", "6", "12", "10", "4", "16", "30"), "zone": ("16", "30", "8", "6", "12", "10", "4")}
#: A zone number that is a whole cell, named or not, or stands before an inch mark.
PERMISSIVE_ZONE = r"""(?i)^(?:(?:Zone|Loc|Location)?\s*(?=[1-9]\d*\s*\.?$)|(?=[1-9]\d*\s*['"]))([1-9]\d*)"""
SHORT_TEXT = 100
ZONES = ("1", "2", "3", "4", "5", "6", "7", "8", "9")
NO_EQUIPMENT, NO_GROUP = "EQUIPMENT_NOT_FOUND", "GROUP_NOT_FOUND"
OUT = ("report", "circuit_id", "cml_id", "measurement_date", "min_reading", "all_readings", "method", "page")


def report_metadata(pages: DataFrame) -> DataFrame:
    """Circuit, date and CML list of each report, from its text in page order, else its name; with readings but no CML,
    ``1``."""
    whole = pages.groupBy("report").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: F.coalesce(p.text, F.lit(""))), "\n").alias("text"))
    read = whole.select("*", R.cml_ids(F.col("text"), F.col("report")).alias("ids"), R.extract_readings(F.col("text")).alias("readings"))
    cmls = F.when((F.size("ids") == 0) & (F.size("readings") > 0), F.array(F.lit("1"))).otherwise(F.col("ids"))
    return read.select("report", R.circuit_base(R.circuit_raw(F.col("text"))).alias("circuit_id"), R.report_date(F.col("text"), F.col("report")).alias("measurement_date"), cmls.alias("cml_ids"), "readings", F.length(F.trim("text")).alias("text_length"))


def summary_pages(pages: DataFrame) -> DataFrame:
    """Pages to process: only summary pages where a report has some; never grid pages."""
    text = F.coalesce("text", F.lit(""))
    spaced = text.rlike(r"(?i)U\s*T\s*R") & text.rlike(r"(?i)R\s*T[\s\S]{0,80}[-–]")
    marked = pages.withColumns({"is_summary": text.rlike(SUMMARY_TITLE) | spaced, "is_grid": text.rlike(GRID_PAGE)})
    any_summary = F.max("is_summary").over(W.partitionBy("report"))
    return marked.withColumn("has_summary", any_summary).where(~F.col("is_grid") & (F.col("is_summary") | ~F.col("has_summary")))


def prepared(rows: DataFrame) -> DataFrame:
    cells = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    out = rows.withColumn("cells", cells).withColumn("row_text", F.array_join("cells", " "))
    return out.withColumn("tight", F.regexp_replace("row_text", r"\s+", ""))


def in_range(values: Column) -> Column:
    return F.filter(values, lambda v: v.between(0.05, 3.0))


def numbers(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", "").try_cast("double"))


def broken_readings() -> Column:
    """Readings whose digits stand apart."""
    return in_range(numbers(F.col("row_text"), r"0\s*\.\s*\d\s*\d\s*\d(?:\s*\d)?"))


def featured(rows: DataFrame) -> DataFrame:
    """Rows with what several layouts look at, each worked out once: ``plain`` readings and the ``first`` reading."""
    p = prepared(rows).withColumn("plain", in_range(numbers(F.col("tight"), r"0\.\d{2,4}")))
    return p.withColumn("first", F.coalesce(F.get("plain", F.lit(0)), F.get(broken_readings(), F.lit(0))))


def digit_cells() -> Column:
    """Positions and values of cells that are one digit 1-9."""
    at = F.transform("cells", lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    return F.filter(at, lambda x: x.c.isin(*ZONES))


def zone_cell() -> Column:
    """A digit cell, or a zone written with its diameter (``4"``)."""
    zones = F.filter(F.transform("cells", lambda c: F.when(c.isin(*ZONES), c).otherwise(F.regexp_extract(c, r"""^([1-9]\d*)\s*['"]""", 1))), lambda z: z != "")
    return F.get(zones, F.lit(0))


def diameter(which: str) -> Column:
    out = F.lit(None).cast("string")
    for d in reversed(DIAMETERS[which]):
        hit = F.col("row_text").rlike(rf"""(?:^|[^\d.]){d}\s*["']""") | F.col("tight").contains(f'{d}"') | F.col("row_text").contains(f"{d}'")
        out = F.when(hit, d).otherwise(out)
    return out


def based(base: Column, zone: Column) -> Column:
    return R.once(zone, lambda z: F.when(z.isNotNull(), F.concat_ws("-", base, z)))


def shaped(rows: DataFrame, *hits: Column) -> DataFrame:
    """The readings among ``hits`` of each row. Hits are made in one array that is unfolded, so no filter makes them once more."""
    made = F.filter(F.array(*hits), lambda h: h.cml_id.isNotNull() & h.min_reading.isNotNull())
    return rows.select("report", "circuit_id", "measurement_date", "page", "table_no", "row_no", F.inline(made)).select(*OUT, "table_no", "row_no")


def hit(cml: Column | str, reading: Column | str, method: str, every: Column | str | None = None) -> Column:
    value = F.col(reading) if isinstance(reading, str) else reading
    return F.struct((F.col(cml) if isinstance(cml, str) else cml).alias("cml_id"), value.alias("min_reading"), (F.array(value) if every is None else F.col(every)).alias("all_readings"), F.lit(method).alias("method"))


def summary_cml() -> Column:
    """Summary layout: the zone is a digit up to three columns left of the diameter, else the first digit after column
    one."""
    at = F.transform("cells", lambda c, i: F.when(c.rlike(r"""[468]\s*["']|1\s*0\s*["']"""), i))
    diam = F.array_min(F.filter(at, lambda i: i.isNotNull()))
    near = R.once(diam, lambda d: F.filter(digit_cells(), lambda x: (x.i < d) & (x.i > d - 4)))
    zone = F.coalesce(R.once(near, lambda v: F.get(v, F.size(v) - 1).c), F.get(F.filter(digit_cells(), lambda x: x.i > 0), F.lit(0)).c)
    return F.when(~F.col("row_text").rlike(NO_READING), based(F.coalesce(F.get("cml_ids", F.lit(0)), F.lit("1.01")), zone))


def diameter_cml() -> Column:
    """Diameter layout: with one CML any zone cell; with more, a digit before the diameter, and 8 or 6 inches choose the
    first or second CML."""
    first, second = F.coalesce(F.get("cml_ids", F.lit(0)), F.lit("1.01")), F.coalesce(F.get("cml_ids", F.lit(1)), F.lit("1.05"))
    after = F.filter(digit_cells(), lambda x: F.get(F.filter(F.slice("cells", x.i + 2, F.size("cells")), lambda c: c != ""), F.lit(0)).rlike(r'^(8|6|4|10|12|16|30).*"'))
    many = R.once(diameter("diameter"), lambda d: F.when(d == "8", first).when(d == "6", second))
    one = F.get("cml_ids", F.lit(0))
    named = F.when(F.size("cml_ids") != 1, F.concat(many, F.lit("-"), F.get(after, F.lit(0)).c)).otherwise(F.concat(one, F.lit("-"), zone_cell()))
    return F.when(~F.col("row_text").rlike(HEADER["diameter"]), named)


def permissive_cml() -> Column:
    """One CML: the first zone and the smallest reading of a row."""
    zones = F.filter(F.transform("cells", lambda c: F.regexp_extract(c, PERMISSIVE_ZONE, 1)), lambda z: z != "")
    return F.when((F.size("cml_ids") >= 1) & ~F.col("row_text").rlike(HEADER["permissive"]), based(F.get("cml_ids", F.lit(0)), F.get(zones, F.lit(0))))


def permissive_reading() -> Column:
    return F.coalesce(F.array_min("plain"), "first")


def parse_summary_rows(rows: DataFrame, meta: DataFrame) -> DataFrame:
    return shaped(featured(rows.join(meta, "report")), hit(summary_cml(), "first", "summary"))


def parse_diameter_rows(rows: DataFrame, meta: DataFrame) -> DataFrame:
    return shaped(featured(rows.join(meta, "report")), hit(diameter_cml(), "first", "diameter"))


def parse_permissive_rows(rows: DataFrame, meta: DataFrame) -> DataFrame:
    return shaped(featured(rows.join(meta, "report")).withColumn("least", permissive_reading()), hit(permissive_cml(), "least", "permissive"))


def zoned(p: DataFrame, hints: Mapping[str, str] | None = None, where: Column | None = None) -> DataFrame:
    """Several CMLs: an explicit CML of the row, else the CML of its diameter (hints, else in order of first
    sight), else the current CML carried down the rows; the smallest reading of a row: columns ``zone_cml``, ``zone_least``,
    ``zone_values``. Diameters are few, so their order of sight is a report's array of first places. ``where``: reports of which it holds; the others' columns are null."""
    asked = F.lit(True) if where is None else where
    named = F.filter(F.transform("cells", lambda c: F.regexp_extract(c, r"(\d+\.\d+)", 1)), lambda x: F.array_contains("cml_ids", x))
    header = F.col("row_text").rlike(HEADER["zone"]) & ~F.col("row_text").rlike(r"^\s*[1-9]\d*\s+")
    plain, loose = in_range(numbers(F.col("tight"), r"0\.\d{2,3}(?!\d)")), in_range(F.transform(numbers(F.col("tight"), r"0\.\d{2,4}"), lambda v: F.bround(v, 3)))
    values = F.concat(R.once(plain, lambda v: F.when(F.size(v) > 0, v).otherwise(loose)), broken_readings())
    made = {"explicit": F.get(named, F.lit(0)), "diam": diameter("zone"), "zone": F.when(~header, zone_cell()), "zone_values": values}
    p = p.withColumns({k: F.when(asked, v) for k, v in made.items()})
    ok = F.col("zone").isNotNull() & (F.size("zone_values") > 0) & ((F.size("cml_ids") <= 1) | F.col("diam").isNotNull() | F.col("explicit").isNotNull())
    p = p.withColumn("ok", asked & F.coalesce(ok, F.lit(False)))
    report, place = W.partitionBy("report"), F.struct("page", "table_no", "row_no")
    above = report.orderBy("page", "table_no", "row_no").rowsBetween(W.unboundedPreceding, 0)
    firsts = {f"at_{d}": F.min(F.when(F.col("ok") & F.col("explicit").isNull() & (F.col("diam") == d), place)).over(report) for d in DIAMETERS["zone"]}
    p = p.withColumns({"current": F.last("explicit", ignorenulls=True).over(above), **firsts})
    seen = F.array_sort(F.filter(F.array(*(F.struct(F.col(f"at_{d}").alias("at"), F.lit(d).alias("d")) for d in DIAMETERS["zone"])), lambda x: x["at"].isNotNull()))
    nth = R.once(F.array_position(F.transform(seen, lambda x: x.d), F.col("diam")), lambda k: F.when(k > 0, k))
    turn = F.get("cml_ids", F.pmod(nth - 1, F.greatest(F.size("cml_ids"), F.lit(1))).cast("int"))
    hinted = F.lit(None).cast("string")
    for d, base in (hints or {}).items():
        hinted = F.when((F.col("diam") == d) & F.array_contains("cml_ids", base), base).otherwise(hinted)
    base = F.coalesce("explicit", hinted, F.when(F.col("diam").isNotNull(), turn), "current", F.get("cml_ids", F.lit(0)))
    return p.withColumns({"zone_cml": F.when(F.col("ok"), F.concat(base, F.lit("-"), F.col("zone"))), "zone_least": F.when(F.col("ok"), F.array_min("zone_values"))})


def parse_zone_rows(rows: DataFrame, meta: DataFrame, hints: Mapping[str, str] | None = None) -> DataFrame:
    return shaped(zoned(prepared(rows.join(meta, "report")), hints), hit("zone_cml", "zone_least", "zone", "zone_values"))


def row_strategies(rows: DataFrame, meta: DataFrame, hints: Mapping[str, str] | None = None, every: bool = False) -> DataFrame:
    """Readings by the zone, summary, diameter and permissive layouts, the rows read and shuffled once for all of them. ``meta`` has a row a report, with
    its ``pages`` and the ``titled`` ones among them. Only the first admissible layout of each report is returned, and the zone layout, the dearest, is worked out
    just where the others leave the choice to it; ``every`` returns all layouts' readings."""
    met = rows.join(meta.hint("merge"), "report").where(F.array_contains("pages", F.col("page")))
    n, report = F.size("cml_ids"), W.partitionBy("report")
    p = featured(met).withColumns({"summary_cml": F.when((n == 1) & F.array_contains("titled", F.col("page")), summary_cml()), "diameter_cml": diameter_cml(), "permissive_cml": F.when(n == 1, permissive_cml()), "least": permissive_reading()})
    pairs = {"summary": ("summary_cml", "first"), "diameter": ("diameter_cml", "first"), "permissive": ("permissive_cml", "least")}
    count = lambda cml, reading: F.count_if(F.col(cml).isNotNull() & F.col(reading).isNotNull()).over(report)
    p = p.withColumns({f"n_{k}": count(*v) for k, v in pairs.items()})
    left = (n >= 3) | ((F.col("n_diameter") == 0) & ((n != 1) | ((F.col("n_summary") == 0) & (F.col("n_permissive") == 0))))
    p = zoned(p, hints, None if every else left).withColumn("n_zone", count("zone_cml", "zone_least"))
    p = p.withColumn("pick", first_admissible(n, {k: F.col(f"n_{k}") for k in ("zone", *pairs)}))
    hits = [hit("zone_cml", "zone_least", "zone", "zone_values"), *(hit(*v, k) for k, v in pairs.items())]
    return shaped(p, *hits if every else [F.when(F.col("pick") == k, h) for k, h in zip(("zone", *pairs), hits)])


def forward_fill(rows: DataFrame, value: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last non-null ``value`` above each row of its group."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def sequence_zones(rows: DataFrame, key: str = "cml_base", zone: str = "zone", order: Sequence[str] = ("row_no",)) -> DataFrame:
    """Rows without a zone number get the lowest number that their CML hasn't used before. A CML's rows are few (a
    table), so they are walked in an ordered array."""
    made = rows.groupBy("report", key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(zone).cast("int").alias("z")))).alias("r"))
    zero = F.struct(F.array().cast("array<int>").alias("seen"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size(acc.seen) + 1), acc.seen))
        z = F.coalesce(x.z, free)
        return F.struct(F.array_append(acc.seen, z).alias("seen"), F.array_append(acc.out, z).alias("out"))

    filled = made.withColumn("z", F.aggregate("r", zero, step, lambda acc: acc.out))
    pairs = filled.select("report", key, F.explode(F.arrays_zip("r", "z")).alias("x")).select("report", key, *(F.col(f"x.r.{c}").alias(c) for c in order), F.col("x.z").alias("__zone"))
    return rows.drop(zone).join(pairs.hint("merge"), ["report", key, *order]).withColumnRenamed("__zone", zone)


def token_rows(tokens: DataFrame, gap: float = 0.5, reach: float = 1.8) -> DataFrame:
    """Tokens with the row of their page: centres are laid greedily from the top, a new one where a token is farther than
    half the page's mean height from the last; a token goes to its nearest centre within ``reach`` heights. One page
    bounds the arrays."""
    page = tokens.groupBy("report", "page").agg(F.array_sort(F.collect_list("cy")).alias("ys"), F.avg("height").alias("h"))
    zero = F.array().cast("array<double>")
    centres = F.aggregate("ys", zero, lambda acc, y: F.when((F.size(acc) == 0) | (y - F.get(acc, F.size(acc) - 1) > F.col("h") * gap), F.array_append(acc, y)).otherwise(acc))
    page = page.select("report", "page", "h", centres.alias("centres"))
    near = F.array_min(F.transform("centres", lambda c, i: F.struct(F.abs(c - F.col("cy")).alias("d"), i.alias("i"))))
    return tokens.join(page, ["report", "page"]).withColumn("n", near).where(F.col("n.d") <= F.col("h") * reach).withColumn("row_no", F.col("n.i")).drop("n", "centres", "h")


def page_text(tokens: DataFrame) -> DataFrame:
    """Reading-order text: rows from the top, tokens from the left."""
    lines = token_rows(tokens).groupBy("report", "page", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda t: t.text), " ").alias("line"))
    return lines.groupBy("report", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda t: t.line), "\n").alias("text"))


def tokens_to_rows(tokens: DataFrame, meta: DataFrame) -> DataFrame:
    """Readings of recognised tables, the lowest of each report's CML and section, the first on ties."""
    rows = table_readings(tokens, meta, sequence_zones)
    least = F.min_by(F.struct("measurement_date", "min_reading", "all_readings", "page"), F.struct("min_reading", "page", "row_no"))
    return rows.groupBy("report", "circuit_id", "cml_id").agg(least.alias("r")).select("report", "circuit_id", "cml_id", "r.measurement_date", "r.min_reading", "r.all_readings", F.lit("tokens").alias("method"), "r.page")


def numeric_page_readings(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Fallback readings of a report, pages last to first: those of table cells, else of the page text."""
    cells = rows.select("report", "page", "table_no", "row_no", F.posexplode("cells").alias("col", "cell")).withColumn("v", F.regexp_extract("cell", R.READING, 0).try_cast("double")).where(R.plausible_reading(F.col("v")))
    by_cell = cells.groupBy("report", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "row_no", "col", "v"))), lambda x: x.v).alias("of_cells"))
    both = pages.select("report", "page", R.extract_readings(F.coalesce("text", F.lit(""))).alias("of_text")).join(by_cell.hint("merge"), ["report", "page"], "left")
    own = F.when(F.size("of_cells") > 0, F.col("of_cells")).otherwise(F.col("of_text"))
    return both.groupBy("report").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("page")).alias("p"), own.alias("v")))), lambda x: x.v)).alias("readings"))


def split_readings_to_zones(meta: DataFrame) -> DataFrame:
    """Zones from a bare list of readings ``(readings, cml_ids)``: two CMLs take 3 + 2 of five; of twelve or more,
    every other, six; of six with one outlier, 3 + 2 of the rest; even splits of 2 to 9 each; 3 + 3 swaps the CMLs."""
    n = F.size("cml_ids")
    m = meta.withColumn("v", in_range(F.col("readings"))).where((F.size("v") > 0) & (n >= 1))
    other = F.filter("v", lambda x, i: i % 2 == 0)
    cut = F.when((n == 2) & (F.size("v") >= 12), F.slice(other, 1, 6)).when((n == 2) & (F.size("v") >= 6), F.slice("v", 1, 6)).otherwise(F.col("v"))
    m = m.withColumn("v", cut)
    odd = (n == 2) & (F.size("v") == 6) & (F.size(F.filter("v", lambda x: x >= 0.3)) >= 4) & (F.size(F.filter("v", lambda x: x < 0.25)) == 1)
    m = m.withColumn("swap", (n == 2) & (F.size("v") == 6) & ~odd).withColumn("v", F.when(odd, F.filter("v", lambda x: x >= 0.25)).otherwise(F.col("v")))
    per = F.when((n == 2) & (F.size("v") == 5), 3).when((F.size("v") % n == 0) & (F.size("v") / n).between(2, 9), (F.size("v") / n).cast("int"))
    m = m.withColumn("per", per).where("per IS NOT NULL").withColumn("ids", F.when(F.col("swap"), F.reverse("cml_ids")).otherwise(F.col("cml_ids")))
    e = m.select("report", "circuit_id", "measurement_date", "ids", "per", F.posexplode("v").alias("i", "min_reading"))
    cml = F.concat_ws("-", F.get("ids", F.floor(F.col("i") / F.col("per")).cast("int")), (F.col("i") % F.col("per") + 1).cast("string"))
    return e.select("report", "circuit_id", cml.alias("cml_id"), "measurement_date", "min_reading", F.array("min_reading").alias("all_readings"), F.lit("split").alias("method"), F.lit(None).cast("int").alias("page"))


def aggregate_readings(meta: DataFrame) -> DataFrame:
    """One CML: the lowest reading, as zone 1; several: equal chunks of the list, the last takes the rest. Without
    readings 0.0, flagged ``no_reading``."""
    n, total = F.size("cml_ids"), F.size("readings")
    chunk = F.greatest(F.floor(total / n).cast("int"), F.lit(1))
    e = meta.where(n >= 1).select("*", F.posexplode("cml_ids").alias("i", "base"))
    start = F.col("i") * chunk
    subset = F.when(n == 1, F.col("readings")).otherwise(F.slice("readings", start + 1, F.when(F.col("i") < n - 1, chunk).otherwise(F.greatest(total - start, F.lit(0)))))
    own = F.when(F.size(subset) > 0, subset).otherwise(F.col("readings"))
    cml = F.when((n == 1) & ~F.col("base").contains("-"), F.concat(F.col("base"), F.lit("-1"))).otherwise(F.col("base"))
    return e.select("report", "circuit_id", cml.alias("cml_id"), "measurement_date", F.coalesce(F.array_min(own), F.lit(0.0)).alias("min_reading"), own.alias("all_readings"), F.lit("aggregate").alias("method"), F.lit(None).cast("int").alias("page"), (total == 0).alias("no_reading"))


def min_reading_per_cml(readings: DataFrame, order: Sequence[str] = ("page",), keys: Sequence[str] = ("circuit_id", "cml_id")) -> DataFrame:
    """The row with the lowest reading of each (circuit, CML), the first on ties. With ``report`` among the keys, of each report."""
    by = W.partitionBy(*keys).orderBy("min_reading", *order)
    return readings.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def base_of(cml: Column) -> Column:
    return F.when(cml.contains("-"), F.substring_index(cml, "-", 1))


def supplement_readings(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Keys that the primary lacks are added. Where the secondary has whole CMLs that the primary lacks, and as many rows
    or more, it becomes the base of that report, and the primary adds only CMLs that it doesn't have. Per report: one shuffle of both,
    and a report's rows bound the windows."""
    both = primary.withColumn("__second", F.lit(0)).unionByName(secondary.withColumn("__second", F.lit(1))).withColumn("base", base_of(F.col("cml_id")))
    report, of_key = W.partitionBy("report"), W.partitionBy("report", "circuit_id", "cml_id")
    second, named = F.col("__second") == 1, reduce(and_, (F.col(c).isNotNull() for c in ("report", "circuit_id", "cml_id")))
    sets = {"__ns": F.sum("__second").over(report), "__n": F.count("*").over(report), "__p": F.collect_set(F.when(~second, F.col("base"))).over(report), "__s": F.collect_set(F.when(second, F.col("base"))).over(report)}
    seen = both.withColumns(sets).withColumn("__lacks", F.size(F.array_except("__s", "__p")) > 0)
    swapped = F.col("report").isNotNull() & F.col("__lacks") & (F.col("__ns") * 2 >= F.col("__n"))
    lacked = seen.withColumns({"__swapped": swapped, "__has": F.min("__second").over(of_key) == 0})
    usual = ~second | ~(named & F.col("__has"))
    other = second | ~F.coalesce(F.array_contains("__s", F.coalesce("base", "cml_id")), F.lit(False))
    rows = lacked.where(F.when(F.col("__swapped"), other).otherwise(usual)).select(*primary.columns)
    return min_reading_per_cml(rows, keys=("report", "circuit_id", "cml_id"))


def first_admissible(n: Column, has: Mapping[str, Column]) -> Column:
    """The layout of a report's rows that is chosen, of its number of CMLs and of readings by each; null where none is."""
    return (
        F.when((n >= 3) & (has["zone"] > 0), "zone").when((n == 1) & (has["summary"] > 0), "summary").when((n == 1) & (has["permissive"] > has["diameter"]), "permissive").when(has["diameter"] > 0, "diameter")
        .when((n == 1) & (has["zone"] < 5) & (has["permissive"] > 0), "permissive").when(has["zone"] > 0, "zone")
    )


def select_strategy(found: Mapping[str, DataFrame], meta: DataFrame) -> DataFrame:
    """The readings of each report's first admissible strategy. ``found`` has the outputs of tokens, zone, summary,
    diameter, permissive, split and aggregate (those at hand), written once; each is counted once per report. Where ``meta`` has the
    readings and the length of the text, tokens are tried only for reports without readings, with little text, with nothing
    but zeros, or with three CMLs or more."""
    frames = [df.select(*OUT).withColumn("strategy", F.lit(k)) for k, df in found.items()]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    rows = kept(rows, "strategies")
    counts = rows.groupBy("report").pivot("strategy", list(found)).count().fillna(0)
    extra = [c for c in ("readings", "text_length") if c in meta.columns]
    m = meta.select("report", F.size("cml_ids").alias("n"), *extra).join(counts, "report", "left").fillna(0)
    has = {k: F.col(k) if k in found else F.lit(0) for k in ("tokens", "zone", "summary", "diameter", "permissive", "split")}
    tried = F.lit(True)
    if {"readings", "text_length"} <= set(meta.columns):
        tried = (F.size("readings") == 0) | (F.col("text_length") < SHORT_TEXT) | F.forall("readings", lambda v: v == 0) | (F.col("n") >= 3)
    tokens_ok = (has["tokens"] > 0) & ((F.col("n") > 0) | (has["tokens"] >= 3)) & tried
    pick = F.when(tokens_ok, "tokens").otherwise(F.coalesce(first_admissible(F.col("n"), has), F.when(has["split"] > 0, "split").otherwise("aggregate")))
    return rows.join(m.select("report", pick.alias("strategy")), ["report", "strategy"])


def parse_many_reports(pages: DataFrame, rows: DataFrame, tokens: DataFrame | None = None, hints: Mapping[str, str] | None = None) -> DataFrame:
    """All reports in one job: every strategy on the pages to process, the first admissible one of each report, the
    lowest reading of each of its CMLs. Reports whose text has no readings take those of their table cells and pages, last page first."""
    use = summary_pages(pages)
    chosen = use.groupBy("report").agg(F.collect_set("page").alias("pages"), F.collect_set(F.when(F.col("is_summary"), F.col("page"))).alias("titled"))
    meta = kept(report_metadata(pages).join(chosen.hint("merge"), "report", "left"), "meta")
    bare = kept(meta.where(F.size("readings") == 0).select("report", "pages"), "bare")
    if not bare.isEmpty():
        asked = small_or_merged(bare)
        none = F.array().cast("array<double>")
        own = rows.join(asked, (rows["report"] == asked["report"]) & F.array_contains(asked["pages"], rows["page"]), "left_semi")
        spare = numeric_page_readings(use.join(asked, "report", "left_semi"), own).withColumnRenamed("readings", "__spare")
        meta = meta.join(spare.hint("merge"), "report", "left").withColumn("readings", F.when(F.size("readings") > 0, F.col("readings")).otherwise(F.coalesce("__spare", none))).drop("__spare")
        meta = kept(meta.withColumn("cml_ids", F.when((F.size("cml_ids") == 0) & (F.size("readings") > 0), F.array(F.lit("1"))).otherwise(F.col("cml_ids"))), "meta")
    by_row = kept(row_strategies(rows, meta.select("report", "circuit_id", "measurement_date", "cml_ids", "pages", "titled"), hints, tokens is not None), "by-row")
    keys = ("report", "circuit_id", "cml_id")
    if tokens is None:
        rest = kept(meta.join(by_row.select("report").distinct().hint("merge"), "report", "left_anti"), "rest")
        others = select_strategy({"split": split_readings_to_zones(rest), "aggregate": aggregate_readings(rest)}, rest)
        return min_reading_per_cml(by_row.select(*OUT).withColumn("strategy", F.col("method")).unionByName(others), keys=keys)
    found = {k: by_row.where(F.col("method") == k) for k in ("zone", "summary", "diameter", "permissive")} | {"split": split_readings_to_zones(meta), "aggregate": aggregate_readings(meta)}
    found["tokens"] = supplement_readings(tokens_to_rows(tokens, meta.select("report", "circuit_id", "measurement_date", "cml_ids")), found["zone"].select(*OUT))
    return min_reading_per_cml(select_strategy(found, meta), keys=keys)


#: Why a report has no readings, the first that holds.
UNREADABLE = ("no name", "listed twice", "no pages", "pages without number", "no text", "no CML")


def parse_listed_reports(reports: DataFrame, pages: DataFrame, rows: DataFrame, tokens: DataFrame | None = None, hints: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Readings of ``reports(report, report_ord)``, each with its ``report_ord``, and a quarantine ``(report, report_ord, reason)`` of those that
    can't be read. A report in quarantine gives no readings and takes nothing from the others; every report is in
    one of the two."""
    listed = reports.groupBy("report").agg(F.min("report_ord").alias("report_ord"), F.count("*").alias("times"))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    seen = pages.groupBy("report").agg(F.count("*").alias("n"), F.count_if(F.col("page").isNull()).alias("lost"), F.count_if(~blank).alias("full"))
    cells = rows.where("page IS NOT NULL").select("report").distinct().withColumn("tables", F.lit(True))
    if tokens is not None:
        cells = cells.unionByName(tokens.where("page IS NOT NULL").select("report").distinct().withColumn("tables", F.lit(True))).distinct()
    why = F.when(F.trim(F.coalesce("report", F.lit(""))) == "", "no name").when(F.col("times") > 1, "listed twice").when(F.col("n").isNull(), "no pages").when(F.col("lost") > 0, "pages without number").when((F.col("full") == 0) & F.col("tables").isNull(), "no text")
    judged = kept(listed.join(seen.hint("merge"), "report", "left").join(cells.hint("merge"), "report", "left").select("report", "report_ord", why.alias("reason")), "reports")
    fine = judged.where("reason IS NULL").select("report", "report_ord")
    only = lambda df: df.join(fine.select("report").hint("merge"), "report", "left_semi")
    found = kept(parse_many_reports(only(pages), only(rows), only(tokens) if tokens is not None else None, hints), "readings")
    silent = fine.join(found.select("report").distinct().hint("merge"), "report", "left_anti").withColumn("reason", F.lit("no CML"))
    # A report all of whose readings belong to another one's lower rows is read all the same.
    named = only(pages).transform(report_metadata).where(F.size("cml_ids") > 0).select("report")
    silent = silent.join(named.hint("merge"), "report", "left_anti")
    return found.join(fine.hint("merge"), "report"), judged.where("reason IS NOT NULL").unionByName(silent)


def prefix_pairs(left: DataFrame, right: DataFrame, key: str, best: Column, value: str) -> DataFrame:
    """For each ``key`` of ``left`` the ``value`` of the first by ``best`` among the keys of ``right`` that it begins with, or that begin with it. Both
    sides meet on whole strings: an index holds, for each beginning of a right key whose length some left key has, just its first
    entry; and each left key's beginnings, of lengths that right keys have, are looked up in those. So a beginning that all keys
    share is one row of the index."""

    def lengths(df: DataFrame) -> Column:
        found = sorted(r.n for r in df.select(F.length(key).alias("n")).distinct().collect())  # as many as lengths
        return F.array(*map(F.lit, found)).cast("array<int>")

    def beginnings(df: DataFrame, of: Column) -> DataFrame:
        return df.withColumn("n", F.explode(F.filter(of, lambda k: (k > 0) & (k <= F.length(key))))).withColumn("part", F.left(key, F.col("n"))).drop("n")

    first = right.groupBy(key).agg(F.min_by(F.struct(F.col(value), best.alias("__best")), best).alias("f"))
    index = beginnings(first, lengths(left)).groupBy("part").agg(F.min_by("f", "f.__best").alias("f"))
    longer = left.withColumnRenamed(key, "part").join(index.hint("merge"), "part").select(F.col("part").alias(key), "f")
    shorter = beginnings(left, lengths(first)).join(first.withColumnRenamed(key, "part").hint("merge"), "part").select(key, "f")
    return longer.unionByName(shorter).groupBy(key).agg(F.min_by("f", "f.__best").alias("f")).select(key, F.col(f"f.{value}").alias(value))


def circuit_to_equipment(readings: DataFrame, source: DataFrame, order: Sequence[str]) -> DataFrame:
    """Equipment of each circuit: exact, else the first source entry equal but for blanks or a prefix either way, else a
    placeholder. The circuits' map, of as many rows as circuits, is written and broadcast if it is small."""
    first = kept(source.where("circuit_id IS NOT NULL AND equipment_id IS NOT NULL").groupBy("circuit_id").agg(F.min_by(F.struct("equipment_id", F.struct(*order).alias("ord")), F.struct(*order)).alias("s")).select("circuit_id", "s.*"), "equipment")
    asked = kept(readings.select("circuit_id").where("circuit_id IS NOT NULL").distinct(), "circuits")
    exact = asked.join(first, "circuit_id").select("circuit_id", "equipment_id")
    left = asked.join(first.select("circuit_id"), "circuit_id", "left_anti").withColumn("norm", collapsed(F.col("circuit_id")))
    near = prefix_pairs(left.select("norm").distinct(), first.select(collapsed(F.col("circuit_id")).alias("norm"), "equipment_id", "ord"), "norm", F.col("ord"), "equipment_id")
    fuzzy = left.join(near.hint("merge"), "norm").select("circuit_id", "equipment_id")
    found = small_or_merged(kept(exact.unionByName(fuzzy), "circuit-map"))
    return readings.join(found, "circuit_id", "left").withColumn("equipment_id", F.coalesce("equipment_id", F.lit(NO_EQUIPMENT)))


def cml_to_group(readings: DataFrame, source: DataFrame | None, order: Sequence[str]) -> DataFrame:
    """Group id of (circuit, CML), the last source row winning; no map at all gives the circuit; and the status text."""
    if source is None:
        out = readings.withColumn("group_id", F.col("circuit_id"))
    else:
        last = source.groupBy(collapsed(F.col("circuit_id")).alias("c"), F.col("cml_id").alias("m")).agg(F.max_by("group_id", F.struct(*order)).alias("group_id"))
        out = readings.join(last, (collapsed(F.col("circuit_id")) == F.col("c")) & (F.col("cml_id") == F.col("m")), "left").drop("c", "m").withColumn("group_id", F.coalesce("group_id", F.lit(NO_GROUP)))
    no_e, no_g = F.col("equipment_id") == NO_EQUIPMENT, F.col("group_id") == NO_GROUP
    return out.withColumn("status", F.when(no_e & no_g, "missing equipment and group").when(no_e, "missing equipment").when(no_g, "missing group").otherwise("OK"))


def loader_status_counts(loaded: DataFrame) -> DataFrame:
    return loaded.agg(F.count("*").alias("n_rows"), F.count_if(F.col("equipment_id") == NO_EQUIPMENT).alias("missing_equipment"), F.count_if(F.col("group_id") == NO_GROUP).alias("missing_group"))


def measurement_loader(readings: DataFrame, source: DataFrame, order: Sequence[str], edited: bool = False) -> tuple[DataFrame, DataFrame]:
    """Loader rows (date padded to a timestamp text, reading as text) and distinct assets. ``edited`` tables skip rows
    without circuit or CML, and keep comments and an equipment id that is given. Readings are written once, as three joins
    need them."""
    r = readings
    if edited:
        r = r.where((F.trim(F.coalesce("circuit_id", F.lit(""))) != "") & (F.trim(F.coalesce("cml_id", F.lit(""))) != ""))
    given = F.col("given_equipment") if edited and "given_equipment" in r.columns else F.lit(None).cast("string")
    comment = F.col("comment") if edited and "comment" in r.columns else F.lit("")
    r = kept(r.withColumns({"__given": given, "__comment": comment}), "readings")
    met = circuit_to_equipment(r, source.select("circuit_id", "equipment_id", *order).distinct(), order).withColumn("equipment_id", F.coalesce("__given", "equipment_id"))
    met = cml_to_group(met, source if "group_id" in source.columns else None, order)
    rows = met.select(
        F.col("equipment_id").alias("Equipment ID"), F.col("group_id").alias("TML Group ID"), F.col("cml_id").alias("TML_ID"), F.concat(F.date_format("measurement_date", "yyyy-MM-dd"), F.lit(" 00:00:00")).alias("Measurement Taken Date"),
        F.col("min_reading").cast("string").alias("Readings"), F.col("__comment").alias("Measurement Comment"), F.lit(CONSTANTS["CMMS System"]).alias("CMMS System"), "status", "equipment_id", "group_id",
    )
    assets = rows.select("Equipment ID", "CMMS System").dropDuplicates(["Equipment ID"])
    return rows, assets
