"""Marginals of the mix with the parameters that op3 and the pipeline use, and targets that cannot be met."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from integrity_spark.llm import mixing

MIXED = "source string, lang string, topic string, tokens long"


def test_default_mix_meets_its_marginals(spark):
    """With the parameters of op3 and of the pipeline: a hot source, and cells that are rare in all three dimensions."""
    amounts = {"source": {"hot": 4000, "warm": 900, "rare": 2}, "lang": {"en": 800, "de": 90, "is": 1}, "topic": {"general": 700, "legal": 30, "contact": 1}}
    rows = [(s, g, t, a * b * c) for s, a in amounts["source"].items() for g, b in amounts["lang"].items() for t, c in amounts["topic"].items()]
    cells = mixing.raked(spark.createDataFrame(rows, MIXED)).collect()
    for d in mixing.DIMENSIONS:
        share, held = Counter(), Counter()
        for r in cells:
            share[r[f"k_{d}"]] += r.start
            held[r[f"k_{d}"]] += r.weight
        norm = sum(v**mixing.FLATTEN for v in share.values())
        assert all(held[k] == pytest.approx(v**mixing.FLATTEN / norm, abs=2 * mixing.TOLERANCE) for k, v in share.items())
    assert max(r.ratio for r in cells) > 1.25 and all(r.gap <= mixing.TOLERANCE for r in cells)


def test_given_targets_are_met_or_refused(spark):
    feats = spark.createDataFrame([("a", "en", "general", 96), ("a", "de", "general", 2), ("b", "en", "general", 1), ("b", "de", "general", 1)], MIXED)
    target = spark.createDataFrame([("en", 0.3), ("de", 0.7)], "value string, weight double")
    got = {r.k_lang: r.w for r in mixing.raked(feats, {"lang": target}).groupBy("k_lang").agg(F.sum("weight").alias("w")).collect()}
    assert got == {"en": pytest.approx(0.3, abs=1e-5), "de": pytest.approx(0.7, abs=1e-5)}
    alone = spark.createDataFrame([("a", "en", "general", 60), ("b", "de", "general", 25), ("b", "fr", "general", 15)], MIXED)
    with pytest.raises(ValueError, match="off by"):
        mixing.raked(alone, {"lang": spark.createDataFrame([("en", 0.2), ("de", 0.4), ("fr", 0.4)], "value string, weight double")})
    with pytest.warns(UserWarning, match="default target"):
        assert all(r.gap > mixing.TOLERANCE for r in mixing.raked(alone).collect())
