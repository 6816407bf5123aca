"""Sections, header names and limits of sheets are found in one pass over their rows, and are what joins cell by cell give."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from integrity_spark.functions.scalars import collapsed, to_number
from integrity_spark.operators import digmap as D
from integrity_spark.operators import ingest as I

CELLS = "file string, sheet string, sheet_ord int, row int, col int, value string"
TITLES = ["Feature Summary", "ILI  Feature Summary Table", "Joint Summary", "NDE Limits", "Girth Weld Summary", "nde limit of feature summary"]
HEADS = ["Distance from TGW (m)", "Chainage", "Feature Type", "ILI Source", "Depth (%)", "Joint", "Length", "Remark", "", None, "ID"]
LABELS = ["NDE Assessment Start from TGW (m)", "NDE Assessment End from TGW (m)", "Target Girth Weld (U/S)", "NDE Assessment Length", "from D/S GW", "Joint Summary"]


def made(spark, n=120):
    rng, out = random.Random(3), []
    for k in range(n):
        for o in range(rng.randint(1, 3)):
            place = (None if k == 5 else f"f{k}", f"s{(o + k) % 3}", None if k == 9 else o)
            row = rng.randint(1, 3)
            for _ in range(rng.randint(1, 4)):
                title = rng.choice(TITLES)
                out.append((*place, row, rng.choice([0, 0, 1, 4, 5]), title))
                row += rng.randint(1, 3)
                if "nde" in title.lower() or rng.random() < 0.2:
                    for label in rng.sample(LABELS, rng.randint(2, 5)):
                        out += [(*place, row, 0, rng.choice(["", label, " "])), (*place, row, 1, label), (*place, row, rng.choice([2, 3, 26]), rng.choice(["3,150", "8.5", "-0.5", "1e2", "2 m", None, "3150"]))]
                        row += 1
                else:
                    for r in range(rng.randint(1, 6)):
                        names = rng.sample(HEADS, 6) if r == 0 else [rng.choice(["1.5", "a", "b", "", None, "-3"]) for _ in range(6)]
                        out += [(*place, row, c, v) for c, v in enumerate(names) if rng.random() < 0.9]
                        out += [(*place, row, rng.choice([2, 25]), rng.choice(["z", "", None]))] if rng.random() < 0.1 else []
                        row += 1
                row += rng.choice([0, 1, 1, 2, 25])
    return spark.createDataFrame(out, CELLS)


def section_by_joins(cells, keywords):
    text = I.shown(F.col("value"))
    title = F.exists(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains(text, k) | F.contains(k, text))
    at = cells.where((F.col("row") <= 500) & (F.col("col") < 5) & (text != "") & title).groupBy(*I.SHEET).agg(F.min("row").alias("title_row"))
    filled = cells.where(text != "").groupBy(*I.SHEET, "row").agg(F.count_if(F.col("col") < 20).alias("n"), F.countDistinct(F.when(F.col("col") < 20, text)).alias("d"))
    head = filled.join(at, I.SHEET).where("row > title_row AND row <= title_row + 19 AND n >= 3 AND d >= 3").groupBy(*I.SHEET, "title_row").agg(F.min("row").alias("header_row"))
    below = filled.join(head, I.SHEET).where("row > header_row")
    run = below.join(below.groupBy(*I.SHEET).agg(F.min("row").alias("first_row")), I.SHEET).withColumn("k", F.col("row") - F.row_number().over(W.partitionBy(*I.SHEET).orderBy("row")))
    last = run.where(F.col("k") == F.col("first_row") - 1).groupBy(*I.SHEET).agg(F.min("first_row").alias("first_row"), F.max("row").alias("last_row"))
    return head.join(last, I.SHEET, "left")


def named_by_joins(cells, keywords, key, names):
    """``cells``: file, row, col, value of a section."""
    heads = cells.where("row = 0").select("file", F.lit("section").alias("sheet"), "col", collapsed(F.coalesce("value", F.lit(""))).alias("header"))
    at = I.resolve_columns(heads, keywords).select("file", "key", "col")
    first = I.resolve_columns(heads, {f"{i:02d}": [name] for i, name in enumerate(names)}).groupBy("file").agg(F.min_by("col", "key").alias("best"))
    at = at.join(first, "file", "left").withColumn("col", F.when(F.col("key") == key, F.coalesce("best", "col")).otherwise(F.col("col")))
    values = cells.where("row > 0").join(at, ["file", "col"]).groupBy("file", "row").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keywords))
    return cells.where("row > 0").select("file", "row").distinct().join(values, ["file", "row"], "left")


def limits_by_rows(cells):
    """Limits of each sheet, in plain Python."""
    by, out = {}, {}
    for c in cells.withColumns({"t": collapsed(F.coalesce("value", F.lit(""))), "n": to_number(F.replace("value", F.lit(",")))}).where("file IS NOT NULL").collect():
        by.setdefault((c.file, c.sheet), {}).setdefault(c.row, []).append((c.col, c.value or "", c.t, c.n))
    for sheet, rows in by.items():
        top = [r for r, cs in rows.items() for c in cs if r <= 500 and c[0] < 5 and "nde" in c[2].lower() and "limit" in c[2].lower()]
        got = {}
        for r in sorted(r for r in rows if top and min(top) < r <= min(top) + 49):
            cs = [c for c in sorted(rows[r]) if c[0] < 25 and c[2]]
            texts, number = [], None
            for c in cs:
                if c[3] is None:
                    texts.append(c[2].lower())
                elif texts:
                    number = c[3]
                    break
            lab = " ".join(texts)
            if "feature summary" in lab or "joint summary" in lab:
                break
            target = all(w in lab for w in ("target", "girth", "weld"))
            if number is None or "from d/s" in lab or "d/s gw" in lab:
                continue
            if target and 100 < round(number) < 99999:
                got["target"] = round(number)
            for part in ("start", "end"):
                if not target and "tgw" in lab and f"nde assessment {part}" in lab:
                    got[part] = number
            if not target and "nde assessment length" in lab:
                got["length"] = number
        if "start" in got and "end" in got:
            out[sheet] = (got.get("length"), got["start"], got["end"], got.get("target"))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sections_equal_joins(spark):
    cells = made(spark).localCheckpoint()
    for titles in (D.FEATURE_SECTION, D.JOINT_SECTION):
        got = rows_of(I.find_section(cells, titles))
        assert got == rows_of(section_by_joins(cells, titles)) and len(got) > 40 and any(r[-1] is None for r in got)


def test_names_equal_joins(spark):
    cells = made(spark).localCheckpoint()
    rows = D.sheet_rows(cells)
    found = section_by_joins(cells, D.FEATURE_SECTION).where("first_row IS NOT NULL").join(cells.select(*I.SHEET, "sheet_ord").distinct(), I.SHEET)
    one = found.groupBy("file").agg(F.min_by(F.struct("sheet", "header_row", "first_row", "last_row"), "sheet_ord").alias("s")).select("file", "s.*")
    met = cells.join(one, I.SHEET).where("row = header_row OR row BETWEEN first_row AND last_row")
    met = met.select("file", F.when(F.col("row") == F.col("header_row"), 0).otherwise(F.col("row") - F.col("first_row") + 1).cast("int").alias("row"), "col", "value")
    section = D.section(rows, "features")
    assert rows_of(section.select("file", "row", F.inline("cells"))) == rows_of(met) and met.count() > 200
    got = rows_of(D.named(section, D.INSPECTION, ("distance", D.DISTANCES)))
    assert got == rows_of(named_by_joins(met, D.INSPECTION, "distance", D.DISTANCES)) and any(r[5] for r in got)


def test_limits_equal_a_loop(spark):
    cells = made(spark).localCheckpoint()
    got = {(r.file, r.sheet): (r.length_m, r.start_m, r.end_m, r.target_gwd) for r in I.parse_nde_limits(cells).collect()}
    assert got == limits_by_rows(cells) and len(got) > 5
    of_maps = {r.program_id for r in D.dig_map(cells.where("file IN ('f1', 'f2', 'f3', 'f9', 'f11', 'f12', 'f20')"))["limits"].collect()}
    assert of_maps == {f for f, _ in got if f in ("f1", "f2", "f3", "f9", "f11", "f12", "f20")}


def test_cells_are_shuffled_and_read_once(spark):
    cells = made(spark, 5)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(I.find_section(cells, D.FEATURE_SECTION)) <= 2
    # A cell's blanks are collapsed once for the title and once for its label, not once for each use.
    assert I.parse_nde_limits(cells)._jdf.queryExecution().optimizedPlan().toString().count("[\\s\\x{00A0}]+") <= 8
