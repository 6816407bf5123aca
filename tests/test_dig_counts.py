"""Counts of rows in windows without their pairs, keys of whole numbers, and the keys that are searched for target welds."""

import random

from pyspark.sql import functions as F

from integrity_spark.functions import scalars as S
from integrity_spark.operators import digs as D

RUNS = [("L1", "a"), ("L1", "b"), ("L2", "a")]


def test_rows_inside_equals_pairs(spark):
    rng = random.Random(3)
    points = [(*rng.choice(RUNS), rng.choice([None, float(rng.randint(-50, 400)), rng.uniform(-50, 400)])) for _ in range(900)]
    windows = []
    for k in range(80):
        lo = rng.choice([float(rng.randint(-60, 400)), rng.uniform(-60, 400)])
        windows.append((k, *rng.choice(RUNS), lo, lo + rng.choice([0.0, 3.5, 20.0, 20.0, 20.0, 300.0, -1.0])))
    p = spark.createDataFrame(points, "line_id string, source string, x double")
    w = spark.createDataFrame(windows, "dig_id int, line_id string, source string, lo double, hi double")
    got = {r.dig_id: r.inside for r in D.rows_inside(p, w).collect() if r.inside}
    expected = {k: sum(q[:2] == (line, source) and q[2] is not None and lo <= q[2] <= hi for q in points) for k, line, source, lo, hi in windows}
    assert got == {k: n for k, n in expected.items() if n}


def test_keys_of_whole_numbers(spark):
    values = [0, 7, -12, 1000000, 2**53, 2**53 + 1, -(2**53) - 1, 2**63 - 1, -(2**63), None]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    rows = df.select(S.key_of(df, "v").alias("k"), S.normalize_key(F.col("v")).alias("n")).collect()
    assert [r.k for r in rows] == [r.n for r in rows] and rows[3].k == "1000000" and rows[-1].k == ""


def test_only_keys_of_digs_are_searched(spark, monkeypatch):
    """The listing's other keys, such as its feature ids, don't get as far as the join; the columns are still searched in turn."""
    mdl = spark.createDataFrame([(1, "L", "70.0"), (2, "L", "fx 9"), (3, "L", "1,234.5"), (4, "L", "none"), (5, "L", None)], "dig_id int, line_id string, target_girth_weld string")
    rows = [("L", "s", "70", "F-100000001", "x", 5.0), ("L", "s", "70", "F-100000002", "x", 4.0), ("L", "s", "80", "FX  9", "x", None), ("L", "s", "81", "F-100000003", "fx 9", 8.0), ("L", "t", "82", "1234.50", "x", 9.0), ("L", "t", None, "F-100000004", "70", 3.0)]
    ili = spark.createDataFrame(rows, "line_id string, source string, gwd_number string, feature_id string, feature_desc string, chainage double")
    seen, join = [], type(ili).join

    def watched(self, other, on=None, how=None):
        if on == ["line_id", "key"]:
            seen.extend(r.key for r in self.select("key").collect())
        return join(self, other, on, how)

    monkeypatch.setattr(type(ili), "join", watched)
    got = {(r.dig_id, r.source): r.target_chainage for r in D.locate_target_weld(mdl, ili, ["chainage", "feature_id"]).collect()}
    assert got == {(1, "s"): 4.0, (1, "t"): 3.0, (2, "s"): 8.0, (2, "t"): None, (3, "s"): None, (3, "t"): 9.0, **{(k, s): None for k in (4, 5) for s in "st"}}
    assert seen and not any(k.startswith("F-1") for k in seen)
