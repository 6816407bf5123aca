"""What changes with the size of tables: keys beyond those of the small ones, and plans."""

import duckdb
from pyspark.sql import functions as F

from integrity_spark.operators import assess as A
from integrity_spark.operators import digs as D
from integrity_spark.operators import featuremap as M
from integrity_spark.operators import readings as R
from integrity_spark.plans.registry import ORACLES, QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(spark, folder, name, table, df):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    assert sorted(map(tuple, QUERIES[name](spark, str(folder)).collect())) == sorted(con.sql(ORACLES[name]).fetchall())


def test_dig_ids_beyond_six_digits(spark, tmp_path):
    rows = spark.range(998_990, 999_010).selectExpr("id AS l_orderkey", "1L AS l_partkey", "id AS l_suppkey", "3 AS l_linenumber", "1.0D AS l_quantity", "1.0D AS l_extendedprice", "0.0D AS l_discount", "0.0D AS l_tax")
    same(spark, tmp_path, "dig_ids", "lineitem", rows)


def test_weld_numbers_beyond_the_range(spark, tmp_path):
    rows = spark.range(98_990, 99_010).selectExpr("id AS p_partkey", "7 AS p_size", "'blue ring' AS p_name")
    rows = rows.where("p_partkey % 5 < 3")
    out = "gwd_from_text"
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    got, want = {r.id: r.gwd for r in QUERIES[out](spark, str(tmp_path)).collect()}, dict(con.sql(ORACLES[out]).fetchall())
    assert got == want and want[98_995] == 99_995 and want[99_000] is None


def test_growth_table_sorts_no_rows(spark):
    assert "SortAggregate" not in plan(QUERIES["growth_table"](spark, "/root/testdata/sf0.001"))


def test_a_data_set_stays_spread(spark):
    d = A.valid_defects(spark.createDataFrame([("a", 0.2, 1.0), ("b", 20.0, 1.0), (None, 0.3, 1.0)], "source string, depth_pct double, length_mm double"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = A.fraction_autoscale(d, "source")
        assert "SortMergeJoin" not in plan(out)
        assert {r.source: (r.depth_in, r.depth_scaled) for r in out.collect()} == {"a": (20.0, True), "b": (20.0, False), None: (30.0, True)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_buckets_hold_all_sizes(spark):
    values = [k / 40 for k in range(1, 200)] + [7.0 * 1.0099**k for k in range(400)]
    ili = spark.createDataFrame([("L", v, v) for v in values], "line_id string, length_mm double, width_mm double").withColumn("row", F.monotonically_increasing_id())
    mdl = spark.createDataFrame([(k, "L", v, v) for k, v in enumerate(values[::7])], "dig_id long, line_id string, length_in double, width_in double")
    same_size = D.dimensions_match(F.col("length_in"), F.col("length_mm")) & D.dimensions_match(F.col("width_in"), F.col("width_mm"))
    want = mdl.join(ili, "line_id").where(same_size).select("dig_id", "row")
    got = D.match_by_dimensions(mdl, ili).select("dig_id", "row")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_tile_is_one_shuffle(spark):
    d = spark.createDataFrame([("L", 10.0, 30.0, 100.0, 50.0, 3.0), ("L", 10.0, 40.0, 100.0, 50.0, 3.0)], "line_id string, chainage double, depth_pct double, length_mm double, width_mm double, orientation_hours double")
    r = M.tiled_raster(d, 36.0)
    assert plan(r.groupBy("line_id", "tile").count()).count("Exchange") == 1
    assert {x.depth_pct for x in r.collect()} == {40.0}


def test_tokens_are_read_for_pages_and_rows_only(spark):
    assert "orders.parquet" not in plan(QUERIES["tokens_to_rows"](spark, "/root/testdata/sf0.001"))


def test_supplement_joins_nothing(spark):
    schema = "report string, circuit_id string, cml_id string, measurement_date date, min_reading double, all_readings array<double>, method string, page int"
    frame = lambda rows: spark.createDataFrame([(r, c, m, None, v, [v], "x", 1) for r, c, m, v in rows], schema)
    first = frame([("a", "c", "1.01-1", 0.3), ("b", "c", "1.01-1", 0.4), ("b", "c", "3.03-1", 0.5), ("d", "c", "1.01-1", 0.1), ("e", None, "1.01-1", 0.2), (None, "c", "1.01-1", 0.9)])
    second = frame([("a", "c", "1.01-1", 0.2), ("a", "c", "1.01-2", 0.6), ("b", "c", "1.01-1", 0.9), ("b", "c", "2.02-1", 0.8), ("e", None, "1.01-1", 0.1), ("f", "c", "1", 0.7), (None, "c", "2.02-1", 0.9)])
    out = R.supplement_readings(first, second)
    want = [("None", "1.01-1", 0.9), ("None", "2.02-1", 0.9), ("a", "1.01-1", 0.3), ("a", "1.01-2", 0.6), ("b", "1.01-1", 0.9), ("b", "2.02-1", 0.8), ("b", "3.03-1", 0.5), ("d", "1.01-1", 0.1), ("e", "1.01-1", 0.1), ("f", "1", 0.7)]
    assert sorted((str(r.report), r.cml_id, r.min_reading) for r in out.collect()) == want
    assert "Join" not in plan(out)
