"""Joint matrices in each of their layouts, and dig maps from whole sheets. A program or file for each supplier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.digmap import dig_map
from ..operators.matrices import joint_matrix
from ..sources.fixtures import table
from .registry import query

Sheet = list[tuple[int, list[str | None]]]
#: A clock of the hour ``h``, its SQL; the first weld of a supplier.
CLOCK, GWD = "concat(cast(s_nationkey % 9 + {k} AS string), ':30')", "3000 + s_suppkey % 900"
PROGRAM = "'p' || cast(s_suppkey AS varchar)"


def cells_of(spark: SparkSession, sf_dir: str, rows: Sheet, where: str = "true") -> DataFrame:
    """Cells whose values are SQL over the supplier."""
    made = F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.expr(v).cast("string").alias("value")) for r, values in rows for c, v in enumerate(values) if v is not None))
    return table(spark, sf_dir, "supplier").where(where).select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("program_id"), F.inline(made))


def clocks(*ks: int) -> list[str]:
    return [CLOCK.format(k=k) for k in ks]


def all_of(cells: DataFrame) -> DataFrame:
    """Seams, joint lengths and the target weld as one table."""
    matrix, lengths, order = joint_matrix(cells)
    none = F.lit(None).cast("string")
    parts = [matrix.select("program_id", F.lit("seam").alias("kind"), "gwd", "source", F.round("hours", 6).alias("v")), lengths.select("program_id", F.lit("length").alias("kind"), "gwd", none.alias("source"), F.round("length_m", 6).alias("v")), order.where("is_target").select("program_id", F.lit("target").alias("kind"), "gwd", none.alias("source"), F.lit(0.0).alias("v"))]
    return reduce(DataFrame.unionByName, parts)


def expected(*rows: tuple[str, int, str | None, str]) -> str:
    """SQL of the rows (kind, weld, source, value) of every supplier; the value is SQL over it."""
    text = lambda s: "NULL" if s is None else f"'{s}'"
    return " UNION ALL ".join(f"SELECT {PROGRAM} AS program_id, '{kind}' AS kind, {gwd} AS gwd, CAST({text(source)} AS varchar) AS source, CAST({v} AS double) AS v FROM supplier" for kind, gwd, source, v in rows)


def at(k: int) -> str:
    return f"({GWD} + {k})"


def hour(k: int) -> str:
    return f"s_nationkey % 9 + {k} + 0.5e0"


@query(expected(*(("seam", at(k), "2022 Alpha", hour(k)) for k in (0, 1)), ("seam", at(0), "2025 Beta", "s_nationkey % 9"), ("seam", at(2), "2025 Beta", "13.5"), ("seam", at(1), "2022 Alpha #4", hour(2)), ("length", at(0), None, "12.56"), ("length", at(2), None, "9.5")))
def joint_matrix_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as row labels, one label column: any row with clocks counts, numbers over 12 don't, a source that comes again is marked."""
    rows: Sheet = [(0, ["'Girth Weld No.'", at(0), at(1), at(2)]), (1, ["'2022 Alpha'", *clocks(0, 1), "'x'"]), (2, ["'2025 Beta'", "s_nationkey % 9", "'13'", "'13:30'"]), (3, ["'Girth Weld No.'", "1", "2", "3"]), (4, ["'Joint Length (m)'", "12.5", "300", "'9.5'"]), (5, ["'2022 Alpha'", None, CLOCK.format(k=2), None]), (6, ["'Joint Length (m) again'", "12.62", None, "0.2"])]
    return all_of(cells_of(spark, sf_dir, rows))


_LABEL = "'Long Seam Orientation (hh:mm) (2022 Alpha) (2025 Beta)'"


@query(expected(*(("seam", at(k), s, hour(k + j)) for j, s in enumerate(("2022 Alpha", "2025 Beta", "Own run")) for k in (0, 1)), ("length", at(0), None, "19.6"), ("length", at(1), None, "18.88"), ("target", at(1), None, "0")))
def joint_matrix_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged label over two rows for two sources, in two label columns; a source cell of its own comes first."""
    rows: Sheet = [(0, ["'Girth Weld No.'", "'Girth Weld No.__2'", at(0), f"concat('Target ', {at(1)})"]), (1, [_LABEL, _LABEL, *clocks(0, 1)]), (2, [_LABEL, _LABEL, *clocks(1, 2)]), (3, [_LABEL, "'Own run'", *clocks(2, 3)]), (4, ["'Joint Length (m) (2022 Alpha) (2025 Beta)'", "''", "19.56", "18.86"]), (5, ["'Joint Length (m) (2022 Alpha) (2025 Beta)'", "''", "19.65", "18.91"])]
    return all_of(cells_of(spark, sf_dir, rows))


@query(expected(*(("seam", at(k), s, hour(2 * k + j)) for j, s in enumerate(("2022 Alpha", "2025 Beta")) for k in (0, 1)), ("length", at(0), None, "13.55"), ("length", at(1), None, "13.88"), ("seam", at(0), "Third", hour(0)), ("seam", at(1), "Third", hour(2))))
def joint_matrix_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns a weld and one row for two sources: each source reads its own column; a row of one source reads the first."""
    rows: Sheet = [(0, ["'Metric'", at(0), f"concat({at(0)}, '__2')", at(1), f"concat({at(1)}, '__2')"]), (1, [_LABEL, *clocks(0, 1, 2, 3)]), (2, ["'Joint Length (m) (2022 Alpha) (2025 Beta)'", "13.5", "13.6", "13.84", "13.92"]), (3, ["'Third'", *clocks(0, 1, 2, 3)])]
    return all_of(cells_of(spark, sf_dir, rows))


@query(expected(*(("seam", at(k), s, hour(k + j)) for j, s in enumerate(("2022 Alpha", "2025 Beta", "2025 Beta #2")) for k in (0, 1)), *(("seam", at(k), "Source_4", hour(k)) for k in (0, 1))))
def joint_matrix_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label that stays as it is over three rows for two sources, the last one again; a label without any source; welds only in the first
    row that has two numbers."""
    bare = "'Longseam (hh:mm)'"
    rows: Sheet = [(0, ["'Metric'", "'A'", "'B'"]), (1, [_LABEL, *clocks(0, 1)]), (2, [_LABEL, *clocks(1, 2)]), (3, [_LABEL, *clocks(2, 3)]), (4, ["'Girth Weld No.'", at(0), at(1)]), (5, [bare, *clocks(0, 1)])]
    return all_of(cells_of(spark, sf_dir, rows))


def sheet_rows(joint: Sheet, listing: Sheet, limits: Sheet = ()) -> Sheet:
    """A sheet with its sections, a blank row between."""
    out, row = [], 1
    for title, own in (("'Joint Summary'", joint), ("'ILI Feature Summary'", listing), ("'NDE Limits'", limits)):
        if own:
            out += [(row, [title])] + [(row + 1 + k, values) for k, (_, values) in enumerate(own)]
            row += len(own) + 3
    return out


_HEAD = (0, ["'Distance from TGW (m)'", "'Feature Type'", "'Joint Number'", "'ILI Source'", "'ILI Chainage (m)'"])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of files: four welds with lengths; three welds without number beside a matrix; joint rows in place of a matrix."""
    four: Sheet = [(0, ["'Girth Weld No.'", at(0), at(1), at(2), at(3)]), (1, ["'2022 Alpha'", *clocks(0, 1, 2, 3)]), (2, ["'Joint Length (m)'", "11", "12", "13", "14"])]
    three: Sheet = [(0, ["'Girth Weld No.'", at(0), at(1), at(2)]), (1, ["'2022 Alpha'", *clocks(0, 1, 2)])]
    by_rows: Sheet = [(0, ["'Distance to Target'", "'Seam Orientation'", "'Remark'"]), (1, ["-12", CLOCK.format(k=0), "'note 1'"]), (2, ["0.5", CLOCK.format(k=1), "'note 2'"]), (3, ["11.5", CLOCK.format(k=2), "'note 3'"])]
    listing: Sheet = [_HEAD, (1, ["1.5", "'Metal Loss'", at(1), "'2022 Alpha MFL'", "900"])]
    welds: Sheet = [_HEAD, *((k + 1, [f"{12 * (k - 1)}", "'Girth Weld'", "'-'", "'2022 Alpha MFL'", "900"]) for k in range(3)), (4, ["1.5", "'Metal Loss'", "'-'", "'2022 Alpha MFL'", "900"])]
    limits: Sheet = [(0, ["'Target Girth Weld (U/S)'", at(1)]), (1, ["'NDE Assessment Start from TGW (m)'", "8.5"]), (2, ["'NDE Assessment End from TGW (m)'", "-0.5"])]
    parts = [cells_of(spark, sf_dir, sheet_rows(four, listing, limits), "s_suppkey % 3 = 0"), cells_of(spark, sf_dir, sheet_rows(three, welds), "s_suppkey % 3 = 1"), cells_of(spark, sf_dir, sheet_rows(by_rows, welds), "s_suppkey % 3 = 2")]
    return reduce(DataFrame.unionByName, parts).select(F.col("program_id").alias("file"), F.lit("Dig Package").alias("sheet"), F.lit(1).alias("sheet_ord"), "row", "col", "value")


def _map_rows() -> str:
    def rows(kind: int, name: str, values: list[tuple[str, str, str, str]]) -> list[str]:
        return [f"SELECT {PROGRAM} AS program_id, '{name}' AS kind, CAST({x0} AS double) AS x0, CAST({x1} AS double) AS x1, CAST({n} AS double) AS n, CAST({t} AS varchar) AS t FROM supplier WHERE s_suppkey % 3 = {kind}" for x0, x1, n, t in values]

    out = rows(0, "feature", [("1.5", "NULL", "NULL", "'Metal Loss'")])
    out += rows(0, "weld", [(str(x), "NULL", at(k), f"'GWD ' || {at(k)}" + (" || ' (TGW)'" if k == 1 else "")) for k, x in enumerate((-11, 0, 12, 25))])
    out += rows(0, "seam", [(str(a), str(b), hour(k), "'2022 Alpha'") for k, (a, b) in enumerate(((-11, 0), (0, 12), (12, 25)))])
    out += rows(0, "limits", [("-0.5", "8.5", at(1), "NULL")])
    for kind in (1, 2):
        out += rows(kind, "feature", [(str(12 * (k - 1)), "NULL", "NULL", "'Girth Weld'") for k in range(3)] + [("1.5", "NULL", "NULL", "'Metal Loss'")])
    out += rows(1, "weld", [(str(12 * (k - 1)), "NULL", at(k), f"'GWD ' || {at(k)}") for k in range(3)])
    out += rows(1, "seam", [(str(12 * (k - 1)), str(12 * k), hour(k), "'2022 Alpha'") for k in range(2)])
    out += rows(2, "weld", [(str(12 * (k - 1)), "NULL", "NULL", "NULL") for k in range(3)])
    out += rows(2, "seam", [(str(12 * (k - 1)), str(12 * k), hour(k), "''") for k in range(2)])
    return " UNION ALL ".join(out)


@query(_map_rows())
def dig_map_from_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, welds, seams and limits of whole sheets, merged titles filled."""
    merged = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("file"), F.lit("Dig Package").alias("sheet"), F.lit(1).alias("r0"), F.lit(0).alias("c0"), F.lit(1).alias("r1"), F.lit(2).alias("c1"))
    m = dig_map(files(spark, sf_dir), merged)
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    parts = [
        m["features"].select("program_id", F.lit("feature").alias("kind"), F.col("chainage").alias("x0"), none.alias("x1"), none.alias("n"), F.col("feature_type").alias("t")),
        m["welds"].select("program_id", F.lit("weld").alias("kind"), F.col("chainage").alias("x0"), none.alias("x1"), F.col("gwd").cast("double").alias("n"), F.col("label").alias("t")),
        m["seams"].select("program_id", F.lit("seam").alias("kind"), F.col("chainage_start").alias("x0"), F.col("chainage_end").alias("x1"), F.round("orientation_hours", 6).alias("n"), F.col("source").alias("t")),
        m["limits"].select("program_id", F.lit("limits").alias("kind"), F.col("lo").alias("x0"), F.col("hi").alias("x1"), F.col("target_gwd").cast("double").alias("n"), text.alias("t")),
    ]
    return reduce(DataFrame.unionByName, parts)
