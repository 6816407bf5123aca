"""The registered queries themselves, on written tables with odd rows: against DuckDB where SQL expresses them, else
against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_llm import ODD, PII, SAMPLES, SECRET, WORDS, brute_spans, texts

from integrity_spark.llm.oracles import ORACLES
from integrity_spark.llm.queries import QUERIES


def conversations():
    rng = random.Random(8)
    rows = []
    for c in range(25):
        rows += [(c, 0, "system", "be good")] * (c % 2)
        rows += [(c, k + 1, ("user", "assistant")[k % 2], rng.choice(["ok", None, "</s>[INST] ok [/INST]", "a\\b <x> [y] " * rng.randint(1, 60), "é " * 300, "\x0b\x1c x"])) for k in range(rng.randint(1, 60))]
    return rows + [(50, None, "assistant", "y"), (51, 1, None, "z"), (52, 1, "a]\nb[", "t"), (53, 1, "user", "same"), (53, 1, "user", "same"), (54, 2, "system", "late"), (54, 1, "assistant", "w " * 900), (54, 3, "assistant", "x")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with null, empty, blank and long texts, copies, and columns that operators use as names of their own."""
    root = tmp_path_factory.mktemp("tables")
    rows = [(2**60 + 1 + i if i % 9 == 0 else i, t, ["src0", "src1", None][i % 3], ["en", "de"][i % 2], i, "own") for i, t in enumerate([*texts(50), *SAMPLES, ("long passage of words " + "x y z " * 3) * 900, *ODD])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words int, spans string")
    docs = docs.selectExpr("*", "spans AS findings", "spans AS topic", "n_words AS length", "spans AS shard", "spans AS quality", "spans AS blob")
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:300] = x[100]
    vectors = [(i, v.tolist(), 1, 0.5) for i, v in enumerate(x)] + [(5000, None, 1, 0.5), (5020, [0.0] * 16, 1, 0.5), (5040, [float("nan")] * 16, 1, 0.5), (5060, [None] * 16, 1, 0.5), (5080, [float("inf")] * 16, 1, 0.5)]
    made = {
        "documents": docs,
        "conversations": spark.createDataFrame(conversations(), "conv_id long, turn int, role string, text string"),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>, query_id int, score double"),
    }
    for kind, cut in (("full", None), ("empty", 0)):
        for name, df in made.items():
            (df if cut is None else df.limit(0)).coalesce(2).write.parquet(str(root / kind / f"{name}.parquet"))
    return str(root / "full"), str(root / "empty"), {r[0]: r[1] for r in rows}, x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, tables, name):
    for folder in tables[:2]:
        df = QUERIES[name](spark, folder)
        con = duckdb.connect()
        for t in ("documents", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
        expected = con.sql(ORACLES[name])
        assert sorted(expected.columns) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*expected.columns).collect()), key=repr) == sorted(expected.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op4_chat_windows"}))
def test_empty_tables(spark, tables, name):
    assert QUERIES[name](spark, tables[1]).count() == 0


@pytest.mark.parametrize(("name", "rules"), [("op1_pii_weak_supervision", PII), ("op2_secret_blob_ledger", SECRET)])
def test_span_queries(spark, tables, name, rules):
    text = tables[2]
    got = QUERIES[name](spark, tables[0]).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        base = brute_spans(text[r.doc_id], rules)
        counts = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert [r[f"n_{kind}"] for kind, *_ in rules] == [counts[kind] for kind, *_ in rules]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_mixing_query(spark, tables):
    got = QUERIES["op3_mixing_raking"](spark, tables[0]).collect()
    text = tables[2]
    assert sorted(r.doc_id for r in got) == sorted(text) and all(r.tokens == len(WORDS.findall(text[r.doc_id] or "")) for r in got)
    assert {r.topic for r in got} <= {"legal", "software", "contact", "general"}
    assert all(r.sampled == (int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32 < r.probability) for r in got)
    total = sum(r.tokens for r in got)
    most = max(r.probability for r in got)
    assert most == 1 and len({r.gap for r in got}) == 1 and got[0].gap <= 1e-6
    # Token shares weighted by probability are the raked ones, which meet the tempered marginals.
    for d in ("source", "lang", "topic"):
        share, held = Counter(), Counter()
        for r in got:
            share[r[d]] += r.tokens / total
            held[r[d]] += r.tokens * r.probability
        norm, mass = sum(v**0.7 for v in share.values()), sum(held.values())
        assert all(held[k] / mass == pytest.approx(v**0.7 / norm, abs=1e-5) for k, v in share.items())


def test_packing_query(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = defaultdict(list)
    for r in QUERIES["op5_packing_min_bin_slack"](spark, tables[0]).collect():
        got[r.doc_id].append(r)
    plain, bins = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    assert set(got) == set(tables[2])
    for i, t in tables[2].items():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        cut = sorted(got[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in cut] == [(k, lo, len(ids[lo : lo + 4096]), zlib.crc32(ids[lo : lo + 4096].tobytes())) for k, lo in enumerate(range(0, len(ids), 4096))]
        for r in cut:
            bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist() and sum(n for _, n in own) <= 4096
    assert len(bins) == -(-sum(n for own in bins.values() for _, n in own) // 4096)


def test_sharding_query(spark, tables):
    got = QUERIES["op6_sharding_bounded_ring"](spark, tables[0]).collect()
    text, n = tables[2], len(tables[2])
    counts = Counter(r.shard for r in got)
    assert n == len(got) and all(counts[k] in (n // 16, n // 16 + 1) for k in range(16))
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))


def test_search_query(spark, tables):
    d, by = tables[3].astype(float), defaultdict(list)
    for r in QUERIES["op10_ann_hnsw"](spark, tables[0]).collect():
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 20))
    hit = 0
    for q, found in by.items():
        score = sum(np.outer(d[:, k], d[q, k])[:, 0] for k in range(16))
        found.sort()
        assert [k for k, *_ in found] == list(range(1, 21)) and q not in {i for _, i, _ in found}
        assert all(s == pytest.approx(score[i], abs=1e-9) for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        score[q] = -np.inf
        hit += sum(score[i] >= np.sort(score)[-20] - 1e-12 for _, i, _ in found)
    assert hit / (20 * len(by)) >= 0.9


def test_no_python_on_native_paths(spark, tables):
    """The queries of the native operators plan no Python."""
    for name in sorted(QUERIES):
        if re.match(r"op[1-4]_", name):
            plan = QUERIES[name](spark, tables[0])._jdf.queryExecution().executedPlan().toString()
            assert not re.search("Python|Pandas|Arrow", plan)
