"""The trie against plain dictionaries: hot prefixes, copies, long conversations in several blocks, many small shards."""

import hashlib
import random
import re
import zlib

import pytest

from integrity_spark.llm import prefix_trie as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def conversations():
    rng = random.Random(9)
    said = ["hi there", "ok", "", "a b c", None, "x\ty z"]
    rows = []
    for c in list(range(0, 90)) + [-7, -20, 2000, 2003]:
        n = rng.choice((1, 1, 2, 3, 4, 6, 9)) if c % 13 else 0
        rows += [(c, k, ("user", "assistant", None)[min(rng.randrange(12), 2) if k else 0] if rng.random() < 0.2 else ("user", "assistant")[k % 2], rng.choice(said[: 2 if k < 2 else 6])) for k in range(n)]
    for c in range(100, 108):  # long ones that share far more than a block, or a block, or end at its border
        n = (200, 200, 150, 128, 64, 65, 130, 64)[c - 100]
        rows += [(c, k, ("user", "assistant")[k % 2], f"turn {k % 7}" if k < 140 or c < 102 else f"own {c} {k}") for k in range(n)]
    rows += [(c, k, "user", "same") for c in range(300, 360) for k in range(3)]
    rows += [(400, None, "user", "first"), (400, None, "assistant", "first"), (400, 2, "user", "z"), (None, 1, "user", "lost")]
    return rows


def brute(rows):
    def ident(r):
        role, text = r[2] or "", r[3] or ""
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()

    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append(r)
    for c, turns in own.items():
        own[c] = [(r[2] or "", r[3] or "") for r in sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, ident(r)))]
    nodes = {(): []}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, len(path) == d))
    kids, out = {}, []
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    saved, leaves = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        words = len(WORD.findall(path[-1][1])) if path else 0
        saved[path] = (len(nodes[path]) - 1) * words + sum(saved[k] for k in kids.get(path, ()))
        leaves[path] = sum(leaves[k] for k in kids[path]) if path in kids else 1
        ends = ",".join(map(str, sorted(c for c, over in nodes[path] if over)))
        out.append((min(c for c, _ in nodes[path]), len(path), min(c for c, _ in nodes[path[:-1]]) if path else None, len(nodes[path]), len(kids.get(path, ())), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_rows", [32_768, 9])
def test_trie(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(P, "SHARD_ROWS", shard_rows)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    got = P.trie(P.rebuilt(P.turn_ids(df.withColumn("conv", df.turn).withColumn("block", df.turn))))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_short_and_empty(spark):
    schema = "conv_id long, turn int, role string, text string"
    rows = [(c, k, "user", str(k // 2)) for c in range(30) for k in range(c % 4)]
    assert sorted(map(tuple, P.trie(P.rebuilt(P.turn_ids(spark.createDataFrame(rows, schema)))).collect()), key=repr) == brute(rows)
    assert P.trie(P.rebuilt(P.turn_ids(spark.createDataFrame([], schema)))).count() == 0
