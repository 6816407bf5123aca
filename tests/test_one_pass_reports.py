"""Reports are read in one pass, and give what each layout by itself and the choice among them give."""

import random

from pyspark.sql import functions as F

from integrity_spark.operators import readings as R

PAGES, ROWS = "report string, page int, text string", "report string, page int, table_no int, row_no int, cells array<string>"


def made(spark, n=60):
    rng = random.Random(7)
    pages, rows = [], []
    for k in range(n):
        ids = ["", "CML 1.01", "CML 1.01, 1.05", "CML 1.01, 1.05, 2.02"][k % 4]
        for p in range(1, 1 + rng.randint(1, 3)):
            title = rng.choice(["", "", "UT REPORT - ELBOW", "UT Grid"])
            pages.append((f"R{k}", p, rng.choice([None, f"Circuit: 52-0{k % 10}K 1-2\n{ids}\n{title}", f"{ids}\n{title}\nreading 0.{rng.randint(200, 400)} 0.251"])))
            for r in range(rng.randint(0, 5)):
                cell = [rng.choice(["1", "2", "Zone 3", "4\"", "CIRCUIT", "1.05", ""]), rng.choice(["8\"", "6 \"", "12'", "N/A", "10\"", "5", "7."]), rng.choice(["0.310", "0. 2 9 7", "0.3111", "x", "3.5", "0.45"]), rng.choice([None, "0.280", "2", "1.01"])]
                rows.append((f"R{k}", rng.choice([p, 9]), 1, r, rng.sample(cell, 4) if k % 3 else cell))
    return spark.createDataFrame(pages, PAGES), spark.createDataFrame(rows, ROWS)


def test_one_pass_equals_each_layout(spark):
    pages, rows = made(spark)
    use = R.summary_pages(pages)
    meta = R.report_metadata(pages)
    bare = meta.where(F.size("readings") == 0).select("report")
    own = rows.join(use.select("report", "page").distinct(), ["report", "page"], "left_semi")
    spare = R.numeric_page_readings(use.join(bare, "report", "left_semi"), own.join(bare, "report", "left_semi")).withColumnRenamed("readings", "spare")
    values = F.when(F.size("readings") > 0, F.col("readings")).otherwise(F.coalesce("spare", F.array().cast("array<double>")))
    meta = meta.join(spare, "report", "left").withColumn("readings", values).drop("spare")
    meta = meta.withColumn("cml_ids", F.when((F.size("cml_ids") == 0) & (F.size("readings") > 0), F.array(F.lit("1"))).otherwise(F.col("cml_ids"))).localCheckpoint()
    titled = rows.join(use.where("is_summary").select("report", "page").distinct(), ["report", "page"], "left_semi")
    slim = meta.select("report", "circuit_id", "measurement_date", "cml_ids")
    one = slim.where(F.size("cml_ids") == 1)
    found = {"zone": R.parse_zone_rows(own, slim), "summary": R.parse_summary_rows(titled, one), "diameter": R.parse_diameter_rows(own, slim), "permissive": R.parse_permissive_rows(own, one), "split": R.split_readings_to_zones(meta), "aggregate": R.aggregate_readings(meta)}
    expected = R.min_reading_per_cml(R.select_strategy(found, meta), keys=("report", "circuit_id", "cml_id"))
    of = lambda df: sorted((r.report, str(r.circuit_id), r.cml_id, r.min_reading, r.strategy) for r in df.collect())
    got = of(R.parse_many_reports(pages, rows))
    assert got == of(expected) and len({g[4] for g in got}) >= 5


def test_rows_are_made_once(spark):
    times = spark.sparkContext.accumulator(0)

    def counted(cells):
        times.add(1)
        return cells

    pages = spark.createDataFrame([(f"R{k}", 1, "Circuit: 52-021K 1-2\nCML 1.01\nreading 0.300") for k in range(20)], PAGES)
    rows = spark.createDataFrame([(f"R{k}", 1, 1, r, [str(r), '6"', "0.310"]) for k in range(20) for r in range(1, 4)], ROWS)
    once = rows.withColumn("cells", F.udf(counted, "array<string>")("cells"))
    assert R.parse_many_reports(pages, once).count() == 60 and times.value == 60
