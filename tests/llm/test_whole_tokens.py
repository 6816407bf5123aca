"""Ids of texts that hold the tokenizer's added tokens, against the tokenizer as it is read from its file."""

import numpy as np

from integrity_spark.llm import packing


def test_added_tokens_are_one_id(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain = Tokenizer.from_file(path)
    rows = ["a b  don't<|endoftext|> ΟΔΟΣ", "<|startoftext|>One two.<|endoftext|><|endoftext|>three", "<|ENDOFTEXT|> <|endoftext <| |> <|endoftext|>", "x <|endoftext|>\u0338 é", "<|endoftext|>", "no added token", "", None]
    expected = [plain.encode(t or "", add_special_tokens=False).ids for t in rows]
    assert 49406 in expected[1] and expected[1].count(49407) == 2
    cut = packing.pieces(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), with_ids=True)
    got = {r.doc_id: r.ids for r in cut.collect()}
    assert [got[i] for i in range(len(rows))] == [[*ids, packing.END_TOKEN] for ids in expected]
    mine = packing.WordTokenizer(path, encode_special_tokens=False)
    again = list(mine.encode(rows * 2))
    assert all(np.array_equal(x, y) for x, y in zip(again, expected * 2, strict=True))
