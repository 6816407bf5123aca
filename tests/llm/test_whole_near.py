"""Near-duplicates of the pipeline from 80 percent on, and the cut-off that follows the threshold."""

import random

import pytest
from test_llm import components, shingles

from integrity_spark.llm import minhash


def test_stage_finds_pairs_from_80_percent(spark):
    import corpus_pipeline

    rng, rows = random.Random(11), []
    for k in range(60):
        w = [f"w{rng.random()}" for _ in range(204)]
        other = list(w)
        size = 15 + k % 5
        at = rng.randrange(4, 200 - size)
        other[at : at + size] = [f"x{rng.random()}" for _ in range(size)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    sets = {i: shingles(t) for i, t in rows}
    share = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 120, 2)]
    assert min(share) < 0.8 < max(share) < 0.85
    groups = components(sets, [(i, i + 1) for i, s in zip(range(0, 120, 2), share, strict=True) if s >= 0.8])
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == {i for i in groups if groups[i] == i}


def test_cut_off_follows_the_threshold(spark):
    for t in (80, 85, 95):
        m = t / 100 + (1 - t / 100) / 16
        assert minhash.least_estimate(t) == pytest.approx(t / 100 - 4 * (m * (1 - m) / 384) ** 0.5 / (15 / 16)) and minhash.missed(t) < 1e-4
    with pytest.raises(ValueError, match="bands"):
        minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), threshold=60)
