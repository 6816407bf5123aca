"""Tables of recognised tokens: rows, columns and labels by their geometry.

Tokens ``(report, page, text, conf, left, top, cy, height)``. A page is one table: its header row gives the columns' places; rows below
it are centres laid greedily from the top; what a row says is read by the distance of its tokens from those places. A page bounds
every array and window here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import reports as R
from ..sources.shared import kept

# Header words; what a table must speak of; distances in token heights, and in the page's own units; least confidence.
HEADER_WORD = r"(?i)^(CIRCUIT|CML|SECTION|ZONE|DIAM\.?|NORTH|SOUTH|EAST|WEST|TOP|BOTTOM|CENTER|HIGH|COMMENTS|A|B|C|D|E)$"
DIRECTIONS, FIRST_READINGS, SECTIONS = ("NORTH", "SOUTH", "EAST", "WEST"), ("A", "NORTH", "TOP"), ("SECTION", "ZONE")
ROW_GAP, ROW_REACH, HEADER_GAP = 0.5, 1.8, 0.3
LABEL_REACH, READING_SLACK, BEHIND_DIAMETER = 80, 10, 80
LEAST_CONF, MOST_SECTIONS, PAGE = 0.6, 40, ["report", "page"]
SKIPPED, CIRCUIT, CML = r"(?i)\bN/?A\b|\bFLANGE\b", r"\b\d{2,3}-\d{3}[A-Z]?(?:\s+\d+-\d+)?\b", r"\b[1-9]\d*\.\d{1,2}\b"


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def table_pages(tokens: DataFrame, meta: DataFrame) -> DataFrame:
    """Pages that hold a table, with its header's places: ``section_x``, ``cml_x``, ``reading_x``, ``below`` (where rows begin), ``h`` (mean height), ``ys`` (its tokens' places in order), and
    the circuit and first CML that the page or its report names."""
    word = F.upper(F.regexp_replace("text", r"\.$", ""))
    head = F.when(F.col("text").rlike(HEADER_WORD), F.struct("top", "left", "cy", word.alias("word")))
    pages = tokens.groupBy(*PAGE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "left", "text"))), lambda t: t.text), " ").alias("joined"), F.avg("height").alias("h"), F.array_sort(F.collect_list(head)).alias("heads"), F.array_sort(F.collect_list("cy")).alias("ys")
    )
    up, has = F.upper("joined"), lambda words: F.col("joined").rlike("(?i)" + "|".join(words))
    pages = pages.where(up.contains("CIRCUIT") & up.contains("CML") & has(SECTIONS + DIRECTIONS))

    def row_of(t: Column) -> Column:
        return F.filter("heads", lambda o: F.abs(o.cy - t.cy) <= F.col("h") * ROW_REACH)

    def is_header(row: Column) -> Column:
        words = F.transform(row, lambda o: o.word)
        names = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
        return names(["CIRCUIT"]) & names(["CML"]) & (names(SECTIONS) | names(DIRECTIONS))

    pages = pages.withColumn("head", _first(F.filter(F.transform("heads", row_of), is_header)))
    at = lambda w: _first(F.filter("head", lambda o: o.word == w)).left
    first = F.array_min(F.filter(F.array(*(at(w) for w in FIRST_READINGS)), lambda x: x.isNotNull()))
    below = F.array_max(F.transform("head", lambda o: o.cy)) + F.col("h") * HEADER_GAP
    known = pages.join(meta.select("report", "circuit_id", "measurement_date", "cml_ids").hint("merge"), "report")
    ids = F.coalesce("cml_ids", F.array().cast("array<string>"))
    named = F.nullif(F.regexp_extract("joined", CIRCUIT, 0), F.lit(""))
    circuit = F.when(F.coalesce("circuit_id", F.lit("")).isin("", "Unknown"), F.coalesce(R.circuit_base(named), F.lit("Unknown"))).otherwise(F.col("circuit_id"))
    base = F.coalesce(_first(F.filter(ids, lambda i: (i != "") & F.col("joined").contains(i))), F.nullif(F.regexp_extract("joined", CML, 0), F.lit("")))
    out = known.select(*PAGE, "h", "ys", F.coalesce(at("SECTION"), at("ZONE")).alias("section_x"), at("CML").alias("cml_x"), F.coalesce(first, F.coalesce(at("DIAM"), F.lit(0.0)) + BEHIND_DIAMETER).alias("reading_x"), below.alias("below"), circuit.alias("circuit"), "measurement_date", ids.alias("ids"), base.alias("base"))
    # filtered as written, or the filters would find each header once more
    return kept(out, "table-pages").where("base IS NOT NULL AND below IS NOT NULL")


def table_rows(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of each of the written ``pages``' tables in order: ``row_no``, ``y``, and its tokens ``t`` from the left. A token farther than half a height
    below the last centre starts a row; each goes to the nearest centre within ``ROW_REACH`` heights. Tokens are shuffled once."""
    lay = lambda acc, y: F.when((F.size(acc) == 0) | (y - F.get(acc, F.size(acc) - 1) > F.col("h") * ROW_GAP), F.array_append(acc, y)).otherwise(acc)
    below = F.filter("ys", lambda y: y > F.col("below"))
    centres = pages.select(*PAGE, "h", "below", F.aggregate(below, F.array().cast("array<double>"), lay).alias("centres"))
    near = F.array_min(F.transform("centres", lambda c, i: F.struct(F.abs(c - F.col("cy")).alias("d"), i.alias("i"), c.alias("y"))))
    met = tokens.join(centres.hint("merge"), PAGE).where(F.col("cy") > F.col("below")).withColumn("n", near).where(F.col("n.d") <= F.col("h") * ROW_REACH)
    rows = met.groupBy(*PAGE, F.col("n.i").alias("row_no"), F.col("n.y").alias("y")).agg(F.array_sort(F.collect_list(F.struct("left", "cy", "text", F.coalesce("conf", F.lit(1.0)).alias("conf")))).alias("t"))
    return rows.join(pages.drop("ys").hint("merge"), PAGE)


def nearest_text(t: Column, x: Column, matches) -> Column:
    """The text of the token nearest to a column's place among those that match, the left one on ties."""
    return F.array_min(F.transform(F.filter(t, matches), lambda o: F.struct(F.abs(o.left - x).alias("d"), o.left.alias("l"), o.text.alias("text")))).text


def table_readings(tokens: DataFrame, meta: DataFrame, sequence) -> DataFrame:
    """One reading row for each table row: report, page, row_no, circuit_id, cml_id, measurement_date, min_reading, all_readings. The CML is the row's own, else,
    where several are known, that of the nearest label above or below (a merged label stands in the middle of its rows), else the last one
    above. A section is the number nearest to its column; rows without one, and directional tables, are numbered by ``sequence``, anew
    for each run of a CML. CMLs ``9.x`` have no sections."""
    pages = table_pages(tokens, meta)
    every = kept(table_rows(tokens, pages), "table-rows")
    rows = every.withColumn("line", F.array_join(F.transform("t", lambda o: o.text), " ")).where(~F.col("line").rlike(SKIPPED))
    cml = nearest_text(F.col("t"), F.col("cml_x"), lambda o: o.text.rlike(r"^[1-9]\d*\.\d+$"))
    allowed = (F.size("ids") == 0) | F.array_contains("ids", cml)
    section = nearest_text(F.col("t"), F.col("section_x"), lambda o: o.text.rlike(r"^\d{1,2}$") & o.text.try_cast("int").between(1, MOST_SECTIONS))
    numbers = F.transform(F.filter("t", lambda o: (o.left + READING_SLACK >= F.col("reading_x")) & o.text.rlike(r"^\d+\.\d{2,4}$") & (o.conf >= LEAST_CONF)), lambda o: o.text.try_cast("double"))
    readings = F.filter(numbers, lambda v: v.between(0.05, 3.0))
    rows = rows.withColumns({"own": F.when(F.col("cml_x").isNotNull() & allowed, cml), "section": F.when(F.col("section_x").isNotNull(), section).try_cast("int"), "readings": readings})

    # Labels also stand in rows that are skipped; they are looked for in all.
    label = _first(F.transform(F.filter("t", lambda o: o.text.rlike(r"^\d+\.\d+$") & (F.abs(o.left - F.col("cml_x")) < LABEL_REACH) & F.array_contains("ids", o.text)), lambda o: o.text))
    labels = every.where("cml_x IS NOT NULL AND size(ids) > 1").withColumn("label", label).where("label IS NOT NULL")
    labels = labels.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y", "label"))).alias("labels"))
    rows = rows.join(labels.hint("merge"), PAGE, "left")
    near = F.array_min(F.transform("labels", lambda o: F.struct(F.abs(o.y - F.col("y")).alias("d"), o.y.alias("y"), o.label.alias("label")))).label
    by = W.partitionBy(*PAGE).orderBy("row_no")
    above = F.last("own", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("cml", F.coalesce("own", near, above, "base"))
    changed = (~F.col("cml").eqNullSafe(F.coalesce(F.lag("cml").over(by), "base"))).cast("int")
    rows = rows.withColumn("changed", changed).withColumn("run", F.sum("changed").over(by)).where(F.size("readings") > 0)
    single = F.startswith("cml", F.lit("9."))
    rows = rows.withColumn("key", F.concat_ws("|", F.col("page").cast("string"), F.col("run").cast("string")))
    rows = kept(rows.select(*PAGE, "row_no", "key", "circuit", "cml", "measurement_date", "readings", F.col("section").alias("zone")), "table-sections")
    done = sequence(rows, key="key", order=("page", "row_no"))
    name = F.when(single, F.col("cml")).otherwise(F.concat_ws("-", "cml", F.col("zone").cast("string")))
    return done.select(*PAGE, "row_no", F.col("circuit").alias("circuit_id"), name.alias("cml_id"), "measurement_date", F.array_min("readings").alias("min_reading"), F.col("readings").alias("all_readings"))
