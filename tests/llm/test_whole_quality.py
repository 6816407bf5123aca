"""A document that only the limit on covered words rejects."""

import random

from integrity_spark.llm import repetition


def test_coverage_limit_rejects(spark):
    rng = random.Random(2)
    w = [f"w{rng.random()}" for _ in range(200)]
    rows = [" ".join(w + w[20:35]), " ".join(w + w[20:26]), " ".join(w)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.quality_rules(df).select("doc_id", "quality.*").collect()}
    assert not got[0].base_failed and got[0].longest_repeat == 15 <= repetition.LONGEST and not got[0].kept
    assert got[1].kept and got[2].kept
