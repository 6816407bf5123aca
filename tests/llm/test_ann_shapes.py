"""Recall of one shard's graph against brute force on shapes that break greedy graphs: clusters, ties, high dimensions."""

import numpy as np
import pytest

from integrity_spark.llm import ann as A


def shapes():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(60, 16)) * 10
    return {
        "clusters": np.repeat(centers, 100, 0) + rng.normal(size=(6000, 16)) * 0.05,
        "high dimensions": rng.normal(size=(8000, 64)),
        "equal distances": np.eye(1000),
        "integers": rng.integers(0, 4, size=(5000, 8)).astype(float),
        "few": rng.normal(size=(7, 3)),
        "lengths apart": rng.normal(size=(3000, 16)) * np.exp(rng.normal(size=(3000, 1)) * 2),
    }


@pytest.mark.parametrize("name", ["clusters", "high dimensions", "equal distances", "integers", "few", "lengths apart"])
def test_recall(name):
    x = shapes()[name]
    index = A.build(np.arange(len(x)), x, 7)
    at = np.arange(0, len(x), max(1, len(x) // 150))
    got = A.hits(index, at, x[at], 20, None)
    most = min(20, len(x) - 1)
    assert (got.groupby("query_id").size() == most).all() and got.query_id.nunique() == len(at)
    score = x[at] @ x.T
    score[np.arange(len(at)), at] = -np.inf
    least = np.sort(score, axis=1)[:, -most]
    row = {v: i for i, v in enumerate(at)}
    assert np.mean([r.score >= least[row[r.query_id]] - 1e-9 for r in got.itertuples()]) >= 0.9


def test_all_nodes_reached():
    for x in shapes().values():
        links = A.grow(x, A.LINKS)
        seen = np.zeros(len(x), bool)
        A.reached(links, seen, np.zeros(1, np.int64))
        assert seen.all()


def test_several_shards(spark):
    """Clustered rows in shards of 1,500, parts of a shard, and another length of vectors left out."""
    x = shapes()["clusters"][:4000]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [1.0, 2.0])], "id long, v array<double>")
    queries = rows.where("id % 40 = 0")
    got = A.nearest(A.index(rows, shard_rows=1500), queries, 20).toPandas()
    at = np.arange(0, 4000, 40)
    score = x[at] @ x.T
    score[np.arange(len(at)), at] = -np.inf
    least = np.sort(score, axis=1)[:, -20]
    assert sorted(got.query_id.unique()) == at.tolist() and (got.groupby("query_id").size() == 20).all()
    assert np.mean(got.score.to_numpy() >= least[got.query_id.to_numpy() // 40] - 1e-9) >= 0.9
