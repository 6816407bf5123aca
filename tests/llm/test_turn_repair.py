"""Conversation repair: the auction against dynamic programming over all edits, and segments against whole conversations."""

import hashlib
import random

import pytest

from integrity_spark.llm import turn_repair as R

LETTERS = "suaxSUAXd"


def brute(codes, arrival=R.TERMINAL, entry=0, last=True):
    """The least (cost, letters) from each node, backwards, by trying all edits."""
    far = (10**9, "")
    n = len(codes)
    best = {(n, q): (arrival[q], "") for q in range(4)}
    if last:
        best = {(n, 0): (0, ""), (n, 3): (0, ""), (n, 2): (5, "I"), (n, 1): (10, "II")}
    for i in range(n - 1, -1, -1):
        own, c = {q: far for q in range(4)}, codes[i]
        more = 5 if c.isupper() else 0
        for _ in range(4):
            for q in range(4):
                options = [(2 + best[i + 1, q][0], "D" + best[i + 1, q][1])]
                to = {0: 2, 1: 2, 2: 3, 3: 2}[q]
                options.append((5 + own[to][0], "I" + own[to][1]))
                if c != "d":
                    options.append((1 + more + best[i + 1, to][0], "R" + best[i + 1, to][1]))
                    kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((c.lower(), q))
                    if kept:
                        options.append((more + best[i + 1, kept][0], "K" + best[i + 1, kept][1]))
                own[q] = min(options)
        best |= {(i, q): own[q] for q in range(4)}
    return best[0, entry]


def test_auction():
    rng = random.Random(5)
    for _ in range(1500):
        codes = "".join(rng.choices(LETTERS, weights=(1, 4, 4, 1, 1, 2, 2, 1, 3), k=rng.randint(0, rng.choice((6, 20, 80)))))
        cost, letters, *_ = R.edits(codes, R.TERMINAL, 0, True)
        assert (cost, letters) == brute(codes), codes


def test_costs_between_states():
    rng = random.Random(6)
    for _ in range(200):
        codes = "".join(rng.choices(LETTERS, k=rng.randint(1, 70)))
        for b in range(4):
            arrival = tuple(0 if q == b else 10**6 for q in range(4))
            want = [brute(codes, arrival, a, last=False)[0] for a in range(4)]
            got = [x if x < R.FAR else None for x in R.between(codes)[b::4]]
            assert got == [w if w < 10**6 else None for w in want], (codes, b)


def conversations():
    rng = random.Random(7)
    texts = ["Fine.", "ok", "", " \n", "Why?", "No!", "Yes. ", "cut off\t", None, "a.b"]
    rows = []
    for c in range(60):
        turn = 0
        for _ in range(rng.choice((0, 1, 2, 5, 9, 40))):
            turn += rng.choice((0, 1, 1, 1, 2))
            rows.append((c, rng.choice((turn,) * 9 + (None,)), rng.choice(("user", "assistant", "assistant", "user", "system", "tool", "ua", None, "")), f"{rng.choice(texts) or ''}" if rng.random() < 0.6 else rng.choice(texts), 1))
    rows += [(99, k, ("user", "assistant")[k % 2], f"Line {k}.", 1) for k in range(700)] + [(98, k // 2, rng.choice(("user", "assistant", "system")), rng.choice(["A.", "B", f"C {k}.", f"D {k}", ""]), 1) for k in range(900)]
    return rows + [(None, 1, "user", "Hi.", 1), (None, 2, "assistant", "Ho.", 1), (97, None, None, None, 1)]


def expected(rows):
    """All from plain Python, conversation by conversation."""
    out = {}
    for c in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for k, t, r, x, _ in rows if k == c]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes, n = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            initial = role[:1] if role[:1] and role[:1] in "sua" else "x"
            codes += "d" if fault in ("b", "d") else initial.upper() if fault else initial
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [t for t, *_ in own if t is not None]
        cost, letters = brute(codes)
        said, q, i = [], 0, 0
        for x in letters:
            to = {0: 2, 1: 2, 2: 3, 3: 2}[q]
            if x != "D":
                role = own[i][1] if x == "K" else ("user", "assistant")[to - 2]
                said.append(f"{role}:{'' if x == 'I' else own[i][2]}")
                q = {"s": 1, "u": 2, "a": 3}[role[0]]
            i += x != "I"
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, n["b"], n["d"], n["t"], illegal, cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("segment", "fan"), [(256, 4096), (16, 3)])
def test_whole_conversations(spark, monkeypatch, segment, fan):
    """Segments of 256 turns, and of 16 in a tree of several levels."""
    monkeypatch.setattr(R, "SEGMENT", segment)
    monkeypatch.setattr(R, "FAN", fan)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, key int").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in R.summary(*R.repaired(df)).collect()}
    assert got == expected(rows)


def test_no_rows_left(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi.", True), (2, 1, "user", "Hi.", False), (2, 2, "user", "Hi.", True)], "conv_id long, turn int, role string, text string, gone boolean")
    from pyspark.sql import functions as F

    got = {r[0]: tuple(r[1:]) for r in R.summary(*R.repaired(df, gone=F.col("gone"))).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2] == (0, 0, 0, 0, 0, 2, "D", hashlib.sha256(b"").hexdigest())
