"""Token counts against the library on whole texts."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from integrity_spark.llm import token_counts as T
from integrity_spark.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "\n", "\n\n a", " a", "a ", "a  b", "a\nb", "a\n b \n", f"{T.MARK}a{T.MARK}{T.MARK}b", f"a {T.MARK} b", "<s>x</s> <unk> <0x0A>", "\x00\x01", "\t tab\tb", "ａ é ﬁ", "日本語 テキスト\n漢字", "😀😀 a😀b", "x" * 5000, "word " * 20_000, " " * 300, "a" + " " * 40 + "b", "\r\n a\r\nb", "  a b", "don't-stop_it's (fine).", "0123 456789 3.14"]


def test_pre_tokens(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert T.splits(model)
    lengths, rng = T.Lengths({}, lambda t: len(model.encode(t))), random.Random(4)
    alphabet = [*"aeiou rst\n ", " ", "  ", T.MARK, "the", "ing", "é", "ß", "\t", "漢", "😀", "<s>", ".", "\n\n"]
    for text in [t or "" for t in ODD] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]:
        assert lengths.count(text) == len(model.encode(text)), text


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, i, "own", 7) for i, t in enumerate([*ODD, *ODD])]
    folder = tmp_path_factory.mktemp("docs")
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, tokens string, n_bytes int")
    df.repartition(3).write.parquet(f"{folder}/full/documents.parquet")
    df.limit(0).coalesce(1).write.parquet(f"{folder}/empty/documents.parquet")
    return str(folder), {r[0]: r[1] for r in rows}


def test_query(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = QUERIES["op12_token_counts"](spark, f"{docs[0]}/full")
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = {i: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in docs[1].items()}
    assert {r.doc_id: tuple(r[1:]) for r in got.collect()} == want and got.count() == len(want)
    assert QUERIES["op12_token_counts"](spark, f"{docs[0]}/empty").count() == 0


def test_table_changes_nothing(spark, docs):
    df = spark.read.parquet(f"{docs[0]}/full/documents.parquet")
    table = T.frequent(df, MODEL)
    assert 0 < len(table) <= T.TABLE and len(T.frequent(df, MODEL, keys=3)) == 3
    runs = [{r.doc_id: r.tokens.n_tokens for r in T.token_counts(df, MODEL, table=t).collect()} for t in (table, {})]
    assert runs[0] == runs[1]
    assert T.token_counts(df, MODEL, table={}).columns == df.columns  # ``tokens`` gives way, the others stay


def test_other_tokenizers(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = T.token_counts(spark.read.parquet(f"{docs[0]}/full/documents.parquet"), path).collect()
    assert all(r.tokens.n_tokens == len(plain.encode(docs[1][r.doc_id] or "", add_special_tokens=False).ids) for r in got)


def test_packing_with_another_tokenizer():
    """One that parts words in another way encodes whole texts; the known one looks its parts up."""
    from integrity_spark.llm.packing import WordTokenizer

    texts = ["Hello  World's 12 é!", "", "tabs\tand\nlines"]
    for name, whole in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        own, plain = WordTokenizer(path), Tokenizer.from_file(path)
        assert own.whole is whole
        assert [x.tolist() for x in own.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
