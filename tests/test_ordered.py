"""Ordered scans against one window for each key, with keys spread over many ranges."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from integrity_spark.operators import ordered as O

def outs():
    return {"n": O.row_number(), "size": O.key_size(), "total": O.running_sum("v"), "ahead": O.running_sum("v", before=True), "last": O.last_value("v"), "next": O.next_value("v"), "one": O.lag("v"), "three": O.lag("v", 3), "then": O.lead("v"), "far": O.lead("v", 4), "least": O.key_least("v"), "most": O.key_greatest("v")}


def brute(rows):
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0))
        v = [r[2] for r in own]
        for i, r in enumerate(own):
            before, behind = [x for x in v[: i + 1] if x is not None], [x for x in v[i:] if x is not None]
            out.append((*r, i + 1, len(v), sum(before), sum(x for x in v[:i] if x is not None), before[-1] if before else None, behind[0] if behind else None, v[i - 1] if i else None, v[i - 3] if i > 2 else None, v[i + 1] if i + 1 < len(v) else None, v[i + 4] if i + 4 < len(v) else None, min((x for x in v if x is not None), default=None), max((x for x in v if x is not None), default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [None, 1, 7, 40])
def test_scan(spark, ranges):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None, "c%d" % rng.randrange(9)]), rng.choice([None, rng.randrange(60)]), rng.choice([None, rng.randrange(50)])) for _ in range(400)] + [("z", 1, 1)]
    df = spark.createDataFrame(rows, "k string, x int, v int").repartition(3)
    got = O.scan(df, ["k"], ["x", "v"], outs(), ranges)
    assert got.columns == ["k", "x", "v", *outs()]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_equal_rows_are_spread(spark):
    """Rows that tie in all columns go to several ranges, and are numbered once each."""
    got = O.scan(spark.createDataFrame([("a", 1)] * 300, "k string, x int").repartition(2), ["k"], ["x"], {"n": O.row_number(), "size": O.key_size()}, 6)
    assert sorted((r.n, r.size) for r in got.collect()) == [(i, 300) for i in range(1, 301)]


def test_empty(spark):
    assert O.scan(spark.createDataFrame([], "k string, x int, v int"), ["k"], ["x", "v"], outs()).count() == 0


def test_as_windows(spark):
    df = spark.range(3000).selectExpr("id % 3 AS k", "hash(id) AS x", "CASE WHEN id % 5 = 0 THEN NULL ELSE id END AS v")
    w = W.partitionBy("k").orderBy("x", "v")
    want = df.select("*", F.row_number().over(w).cast("long").alias("n"), F.lag("v", 2).over(w).alias("two"), F.last("v", ignorenulls=True).over(w).alias("last"))
    got = O.scan(df, ["k"], ["x", "v"], {"n": O.row_number(), "two": O.lag("v", 2), "last": O.last_value("v")}, 11)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
