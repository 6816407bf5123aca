"""Texts of one template just under the threshold: nearly all pairs are candidates, none is a link, and texts aren't sent pair by pair."""

import random

from integrity_spark.llm import minhash as M


def template(n, words=120, changed=5):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(5, words - 5), changed // 2):
            own[k] = f"x{i}-{k}"
        out.append(" ".join(own))
    return out


def test_no_links_and_few_texts(spark, monkeypatch):
    n = 1500
    texts = [" ".join([*(f"w{k}" for k in range(100)), *(f"x{i}-{k}" for k in range(12))]) for i in range(n)]
    a, b = M.shingle_set(texts[0]), M.shingle_set(texts[1])
    assert len(a & b) / len(a | b) == 0.8 > M.least_estimate(85)
    sent = []
    real = M.confirmed
    monkeypatch.setattr(M, "confirmed", lambda pairs, docs, threshold: sent.append(pairs.count()) or real(pairs, docs, threshold))
    got = M.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.kept for r in got) and len(got) == n
    assert sum(sent) == 0  # no pair under the threshold takes its texts along


def test_tiles_are_cut(spark, monkeypatch):
    """Copies with one word changed, in tiles cut to pieces: the links are the same."""
    monkeypatch.setattr(M, "TILE", 500)
    texts = template(60, 300, 2) + template(5, 40, 2)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [M.shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: find(i) for i in range(len(texts))}
