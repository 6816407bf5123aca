"""Joint summary matrices: seam positions and joint lengths of girth welds, whatever the layout of the sheet.

Cells ``(program_id, row, col, value)`` have the header in row 0. A header's first two names tell a program's shape:

* ``pair``: two label columns, metric and source. A metric that names several sources stands over as many rows; its nth row is the
  nth source's. A source cell comes first.
* ``single``: one label column, welds from the second on. Rows of one label in a run take its sources in turn.
* ``plain``: labels as they are. A seam label with as many sources as every weld has columns is *interleaved*: one row, a column for
  each source. Else it is *stacked*: its nth row is its nth source's. Any other label is itself the source.

Any row counts that has an accepted clock, but for rows of weld numbers and of joint lengths. Windows run over the label rows of one
program, of which a worksheet has at most 1,048,576; cells are only joined and grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clock_to_hours, collapsed, to_number
from ..sources.shared import kept
from .labels import clean_metric, clean_source_name, label_sources, runs_of_labels

# Bounds of weld numbers and of joint lengths in metres; hours of a clock.
GWD_BOUNDS, LENGTH_BOUNDS, CLOCK_HOURS = (100, 99_999), (0.5, 200.0), 12.0


def weld_number(number: Column) -> Column:
    whole = F.when(F.abs(number) < 1e9, number.cast("bigint"))
    return F.when((whole > GWD_BOUNDS[0]) & (whole < GWD_BOUNDS[1]), whole)


def digits_in(text: Column) -> Column:
    """The first run of four or five digits that is a weld number."""
    found = F.transform(F.regexp_extract_all(F.replace(text, F.lit(",")), F.lit(r"\b(\d{4,5})\b"), F.lit(1)), lambda x: weld_number(x.try_cast("double")))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def header_weld(text: Column) -> Column:
    """A header's weld number: of its first word that is one (copies end in ``__n``), else of its first run of digits."""
    words = F.split(F.replace(text, F.lit(","), F.lit(" ")), r"\s+")
    found = F.transform(words, lambda x: weld_number(to_number(F.regexp_replace(x, r"__\d+$", ""))))
    return F.coalesce(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)), digits_in(text))


def weld_columns(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """``(program_id, col, gwd, nth, width)``: the columns of each weld, from the header, or where it names less than two, from the first row
    with two cells that are weld numbers. Programs with less than two welds have none."""
    named = heads.withColumn("gwd", header_weld(F.col("head"))).where("gwd IS NOT NULL").select("program_id", "col", "gwd")
    two = named.groupBy("program_id").agg(F.countDistinct("gwd").alias("n")).where("n >= 2").select("program_id")
    number = weld_number(to_number(F.replace(F.col("value"), F.lit(","))))
    rest = cells.where("row > 0").withColumn("gwd", number).where("gwd IS NOT NULL").join(two.hint("merge"), "program_id", "left_anti")
    first = rest.groupBy("program_id", "row").agg(F.count("*").alias("n")).where("n >= 2").groupBy("program_id").agg(F.min("row").alias("row"))
    below = rest.join(first.hint("merge"), ["program_id", "row"]).select("program_id", "col", "gwd")
    found = named.join(two.hint("merge"), "program_id", "left_semi").unionByName(below)
    several = found.groupBy("program_id").agg(F.countDistinct("gwd").alias("n")).where("n >= 2").select("program_id")
    by = W.partitionBy("program_id", "gwd")
    return found.join(several.hint("merge"), "program_id", "left_semi").withColumns({"nth": F.row_number().over(by.orderBy("col")), "width": F.count("*").over(by)})


def target_weld(heads: DataFrame, columns: DataFrame) -> DataFrame:
    """``(program_id, gwd)`` of the column headed ``Target``: by the number in its name, else its own weld; else the first header
    that speaks of a target and a gwd."""
    own = heads.withColumn("low", F.lower("head")).join(columns.select("program_id", "col", "gwd").hint("merge"), ["program_id", "col"], "left")
    number = digits_in(F.col("head"))
    is_target = (F.col("low") == "target") | F.startswith("low", F.lit("target "))
    first = F.min(F.when(is_target, F.struct("col", F.coalesce(number, "gwd").alias("g")))).g
    other = F.min(F.when(F.col("low").contains("target") & F.col("low").contains("gwd") & number.isNotNull(), F.struct("col", number.alias("g")))).g
    return own.groupBy("program_id").agg(F.coalesce(first, other).alias("gwd")).where("gwd IS NOT NULL")


def label_rows(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """``(program_id, row, first, second, source_cell)``: the labels of each row, resolved by the program's shape."""
    at = lambda k, c, v: F.coalesce(F.max(F.when(F.col(c) == k, F.col(v))), F.lit(""))
    names = heads.groupBy("program_id").agg(at(0, "col", "head").alias("h0"), at(1, "col", "head").alias("h1"), (F.max("col") + 1).alias("n"))
    h0, h1 = F.lower("h0"), F.lower("h1")
    welds = F.startswith(h0, F.lit("girth weld"))
    token = weld_number(to_number(F.regexp_replace(F.replace(F.trim("h1"), F.lit(",")), r"__\d+$", "")))
    shape = F.when(F.col("n") < 3, "plain").when((welds & F.startswith(h1, F.lit("girth weld"))) | h1.isin("source", "ili source"), "pair").when(welds & token.isNotNull(), "single").otherwise("plain")
    shapes = names.select("program_id", shape.alias("shape"), ((h1 == "source") | ((h0 == "metric") & F.startswith(h1, F.lit("girth weld")))).alias("has_source"))
    texts = cells.where("row > 0 AND col < 2").withColumn("value", F.coalesce("value", F.lit(""))).groupBy("program_id", "row").agg(at(0, "col", "value").alias("label"), at(1, "col", "value").alias("second"))
    rows = cells.where("row > 0").select("program_id", "row").distinct().join(texts.hint("merge"), ["program_id", "row"], "left").fillna("", ["label", "second"]).join(shapes.hint("merge"), "program_id")
    text, second = collapsed(F.col("label")), collapsed(F.col("second"))
    nth = F.get("sources", F.least(F.col("occurrence"), F.size("sources")) - 1)

    plain = rows.where("shape = 'plain'").select("program_id", "row", text.alias("first"), second.alias("second"), F.when(F.col("has_source"), second).otherwise("").alias("source_cell"))

    by = W.partitionBy("program_id", text).orderBy("row")
    pair = rows.where("shape = 'pair'").withColumns({"occurrence": F.row_number().over(by), "sources": label_sources(text), "text": text, "own": second, "metric": clean_metric(text)})
    given = F.when(F.size("sources") > 0, F.when(F.col("own").isin("") | (F.col("own") == F.col("text")) | (F.col("own") == F.col("metric")), nth).otherwise(F.col("own"))).when(F.col("own") != "", clean_source_name(F.col("own"))).otherwise("")
    blank = F.col("text") == ""
    pair = pair.select("program_id", "row", F.when(blank | ((F.size("sources") == 0) & (F.col("own") == "")), F.col("text")).otherwise(F.col("metric")).alias("first"), F.when(blank, F.col("own")).otherwise(given).alias("source_cell"))

    single = runs_of_labels(rows.where("shape = 'single'").withColumn("label", text)).join(rows.select("program_id", "row", F.col("label").alias("whole")).hint("merge"), ["program_id", "row"])
    single = single.withColumn("sources", label_sources(F.col("whole")))
    single = single.select("program_id", "row", clean_metric(F.col("whole")).alias("first"), F.when(F.size("sources") > 0, clean_source_name(nth)).otherwise("").alias("source_cell"))

    return plain.unionByName(pair.unionByName(single).withColumn("second", F.col("source_cell")))


def is_seam_label(text: Column) -> Column:
    low = F.lower(text)
    return (low.contains("long seam") | low.contains("longseam") | low.contains("seam orientation")) & ~low.contains("joint length")


def joint_matrix(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``matrix(program_id, row, gwd, source, hours, shown)``, ``lengths(program_id, gwd, length_m)`` (mean of the plausible ones, two
    decimals) and ``order(program_id, gwd, ord, is_target)`` of all programs."""
    cells = kept(cells.select("program_id", "row", "col", F.col("value").cast("string").alias("value")), "matrix-cells")
    heads = cells.where("row = 0").select("program_id", "col", collapsed(F.coalesce("value", F.lit(""))).alias("head"))
    columns = kept(weld_columns(cells, heads), "matrix-columns")
    marked = target_weld(heads, columns).withColumn("is_target", F.lit(True))
    order = columns.select("program_id", "gwd").distinct().join(marked.hint("merge"), ["program_id", "gwd"], "left")
    order = order.select("program_id", "gwd", F.col("gwd").alias("ord"), F.coalesce("is_target", F.lit(False)).alias("is_target"))

    either = F.lower(F.when(F.col("first") != "", F.col("first")).otherwise(F.col("second")))
    numbers = either.contains("girth weld") | (either.contains("joint") & either.contains("no"))
    kind = F.when(numbers, "numbers").when(either.contains("joint length"), "lengths").otherwise("seams")
    seam_first = is_seam_label(F.col("first"))
    block = F.when(seam_first, F.col("first")).when(is_seam_label(F.col("second")), F.col("second")).otherwise("")
    rows = label_rows(cells, heads).withColumns({"kind": kind, "block": block}).withColumn("sources", F.when(F.col("block") != "", label_sources(F.col("block"))).otherwise(F.array().cast("array<string>")))
    widths = columns.groupBy("program_id").agg(F.min("width").alias("least"), F.max("width").alias("most"))
    one_row = (F.col("most") > 1) & (F.col("least") == F.col("most")) & (F.col("block") != "") & (F.size("sources") == F.col("most"))
    rows = kept(rows.where("kind <> 'numbers'").join(widths.hint("merge"), "program_id").withColumn("interleaved", one_row), "matrix-rows")
    values = cells.where("row > 0 AND value IS NOT NULL").join(columns.hint("merge"), ["program_id", "col"])

    metres = to_number(F.replace(F.col("value"), F.lit(",")))
    long = values.join(rows.where("kind = 'lengths'").select("program_id", "row").hint("merge"), ["program_id", "row"], "left_semi").withColumn("m", metres).where((F.col("m") > LENGTH_BOUNDS[0]) & (F.col("m") < LENGTH_BOUNDS[1]))
    lengths = long.groupBy("program_id", "gwd").agg(F.bround(F.avg("m"), 2).alias("length_m"))

    hours = clock_to_hours(F.col("value"))
    clock = F.col("value").contains(":") & F.col("value").rlike(r"\d")
    seams = values.join(rows.where("kind = 'seams'").select("program_id", "row", "interleaved").hint("merge"), ["program_id", "row"]).where("interleaved OR nth = 1")
    seams = seams.withColumn("hours", hours).where(F.col("hours").isNotNull() & (clock | F.col("hours").between(0, CLOCK_HOURS))).withColumn("part", F.when(F.col("interleaved"), F.col("nth")).otherwise(1))
    seams = kept(seams.select("program_id", "row", "part", "gwd", "hours", F.col("value").alias("shown")), "matrix-seams")

    found = seams.select("program_id", "row", "part").distinct().join(rows.hint("merge"), ["program_id", "row"])
    stacked = (F.col("source_cell") == "") & (F.col("block") != "") & ~F.col("interleaved")
    before = W.partitionBy("program_id", "block").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumns({"seen": F.coalesce(F.sum(stacked.cast("int")).over(before), F.lit(0)), "over": F.coalesce(F.max("interleaved").over(before), F.lit(False))})
    spare = F.concat(F.lit("Source_"), (F.col("row") - 1).cast("string"))
    said = lambda text: F.coalesce(F.nullif(clean_source_name(text), F.lit("")), spare)
    turn = F.when(F.col("over"), F.size("sources")).otherwise(F.least(F.col("seen") + 1, F.size("sources")))
    own = F.get("sources", F.col("part") - 1)
    name = (
        F.when(F.col("interleaved"), F.coalesce(F.nullif(clean_source_name(own), F.lit("")), own))
        .when(F.col("source_cell") != "", said(F.col("source_cell")))
        .when(F.col("block") != "", F.when(F.size("sources") > 0, F.get("sources", turn.cast("int") - 1)).otherwise(spare))
        .otherwise(said(F.when(F.col("first") != "", F.col("first")).otherwise(F.col("second"))))
    )
    again = F.row_number().over(W.partitionBy("program_id", "name").orderBy("row", "part")) > 1
    named = found.withColumn("name", name).withColumn("source", F.when(again, F.concat("name", F.lit(" #"), (F.col("row") - 1).cast("string"))).otherwise(F.col("name"))).select("program_id", "row", "part", "source")
    matrix = seams.join(named.hint("merge"), ["program_id", "row", "part"]).select("program_id", "row", "gwd", "source", "hours", "shown")
    return matrix, lengths, order
