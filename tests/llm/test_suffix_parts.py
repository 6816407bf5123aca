"""op8: what is shuffled grows with the text, not with shards times parts; parts over the bound are merged as a tree."""

import random

import numpy as np
import pandas as pd
import pytest
from test_llm import brute_removal

from integrity_spark.llm import suffix_dedup


@pytest.mark.parametrize(("node", "merged"), [(48_000_000, 6_000_000), (3_000, 700), (600, 1)])
def test_parts_over_the_bound_are_merged_as_a_tree(spark, monkeypatch, node, merged):
    for name, value in (("SHARD_BYTES", 1_000), ("PART_BYTES", 12_000), ("FINE_BYTES", 3_000), ("NODE_BYTES", node), ("MERGED_BYTES", merged), ("FAN_IN", 2)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(5)
    passages = ["".join(rng.choices("abcd ", k=rng.randint(60, 200))) for _ in range(40)]
    rows = [(i, f"{i} " + " ".join(p[rng.randint(0, 9) :] for p in rng.sample(passages, 3)) + f" {i * 7}") for i in rng.sample(range(10_000), 150)]
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_removal([(i, t.encode()) for i, t in rows], suffix_dedup.LENGTH)


def test_a_shard_sends_a_row_to_each_of_few_parts(spark, monkeypatch):
    """At 32 MB of text to a part, 60 MB are two parts; the fine parts, by which transforms are merged, are no rows."""
    rng, sent, kept = random.Random(6), [], suffix_dedup.segments

    def seen(shards, codes, parts, fines):
        sent.append((parts, fines))
        return kept(shards, codes, parts, fines)

    monkeypatch.setattr(suffix_dedup, "segments", seen)
    monkeypatch.setattr(suffix_dedup, "LEAST_PARTS", 1)
    monkeypatch.setattr(suffix_dedup, "text_bytes", lambda *_: 64_000_000)
    text = "".join(rng.choices("abcdefgh ", k=4_000))
    got = suffix_dedup.deduplicated(spark.createDataFrame([(1, text), (2, "x" + text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 4_000)] and sent == [(2, 64)]


@pytest.mark.parametrize("seed", range(10))
def test_fine_parts_of_a_group(seed, monkeypatch):
    """Marks and what is left are the same whether sources are merged at once or in turn, and whole groups or in two levels."""
    rng = random.Random(seed)
    base = [bytes(rng.choices(b"abc ", k=rng.choice([60, 80, 113]))) for _ in range(6)]
    rows = []
    for shard in range(9):
        row, number = {"part": 0, "shard": shard, "fine": [], "sizes": [], "bwt": b"", "first": [], "ids": []}, 0
        for fine in sorted(rng.sample(range(3), rng.randint(1, 3))):
            own = {s: rng.randint(0, 20) for s in (base[2 * fine + rng.randint(0, 1)][rng.randint(0, 8) :] for _ in range(3))}
            before, _, _ = suffix_dedup.own_transform(np.frombuffer(b"".join(own), np.uint8), np.array([len(s) for s in own]), np.array(list(own.values())))
            row["fine"].append(fine), row["sizes"].append(len(before))
            row["bwt"] += before.tobytes()
            for s, i in own.items():
                row["first"].append(number), row["ids"].append(i)
                number += len(s) - 49
        rows.append(row | {k: np.array(row[k], t).tobytes() for k, t in (("fine", np.int32), ("sizes", np.int32), ("first", np.int64), ("ids", np.int64))})
    g = pd.DataFrame(rows)

    def marked(*outs):
        found = {}
        for out in outs:
            for shard, runs in zip(out.shard, out.runs, strict=True):
                for lo, hi in np.frombuffer(runs, np.int64).reshape(-1, 2):
                    found.setdefault(shard, set()).update(range(lo, hi))
        return found

    whole = marked(suffix_dedup.met(g, True))
    levels = [suffix_dedup.met(g[k : k + 3], False) for k in (0, 3, 6)]
    rest = pd.concat([x[x.bwt != b""] for x in levels])
    assert whole and marked(*levels, suffix_dedup.met(rest, True)) == whole
    monkeypatch.setattr(suffix_dedup, "MERGED_BYTES", 150)
    assert marked(suffix_dedup.met(g, True)) == whole
