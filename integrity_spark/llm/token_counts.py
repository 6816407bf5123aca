"""Token counts by a map-side two-tier lookup.

A subword model with marks for word starts never joins across one: no piece of its vocabulary has a mark behind another
character, nor a line feed. So a text's tokens are those of its pre-tokens: a run of marks with the word behind it, a line
feed, or the rest of a word behind a line feed. Lengths of frequent pre-tokens are a hash table that every worker gets by
broadcast (at most ``TABLE`` keys of at most ``LONGEST`` characters each, some MB); the rest is encoded where it is met, and
kept in the worker's own cache. No pre-token is shuffled: texts are counted where they are read.

The table is filled from a sample of about ``SAMPLE`` documents over the whole table. It decides what is found at once and what is
encoded, never a result. A worker checks the model for the rule above and for a normalizer that changes nothing; a model
that breaks it, and a ``.json`` tokenizer, encodes whole texts.

Defined results: a null text counts as empty and has no tokens; very long texts are counted whole, and words beyond
``LONGEST`` characters are encoded each time; repeated rows are counted each; an empty table gives no rows; extra columns
pass, but for one that is called like ``out``, which gives way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
#: Keys of the broadcast table; characters of a key; sampled documents; keys of a worker's cache before it starts anew.
TABLE, LONGEST, SAMPLE, CACHE = 32_768, 48, 4096, 262_144
#: Tasks that add up the sample's counts; each gives the driver as many keys as the table has, at most.
MERGE_TASKS = 4
MARK = "▁"
PRE_TOKEN = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|\n|[^ {MARK}\n]+")


def splits(model) -> bool:
    """Whether texts may be counted by pre-tokens."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    crossed = any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
    # White space kept, full-width and composed characters left alone, a mark before the text.
    probe = " a  b \nＡéé c"
    return not crossed and model.decode(model.encode(probe)) == probe and model.encode("a", out_type=str)[0].startswith(MARK)


def encoded(path: str) -> tuple[Callable[[str], int], bool]:
    """Tokens of a text by the library of the file, and whether pre-tokens may be counted on their own."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids), False
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(model.encode(text)), splits(model)


class Lengths(dict):
    """Lengths of pre-tokens: the broadcast table, and behind it what this worker met."""

    def __init__(self, table: dict[str, int], encode: Callable[[str], int]) -> None:
        super().__init__(table)
        self.encode, self.met = encode, {}

    def __missing__(self, key: str) -> int:
        n = self.met.get(key)
        if n is None:
            # The library puts a mark before each text but an empty one; behind a line feed there is none.
            if key[0] in (" ", MARK):
                n = self.encode(key[1:]) if len(key) > 1 else 1
            else:
                n = self.encode(key) - 1 if key == "\n" else self.encode("\n" + key) - 2
            if len(key) <= LONGEST:
                if len(self.met) >= CACHE:
                    self.met.clear()
                self.met[key] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, PRE_TOKEN.findall(" " + text))) if text else 0


def frequent(docs: DataFrame, path: str, text_col: str = "text", keys: int = TABLE, sample: int = SAMPLE) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a sample. Each task counts its share of the sample and gives its ``keys``
    most frequent ones."""
    share = min(1.0, sample / max(1, docs.count()))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, split = encoded(path)
        seen: Counter[str] = Counter()
        for batch in batches if split else ():
            for text in batch["text"]:
                seen.update(p for p in PRE_TOKEN.findall(" " + (text or "")) if len(p) <= LONGEST)
        lengths, best = Lengths({}, encode), seen.most_common(keys)
        if best:
            yield pd.DataFrame({"piece": [p for p, _ in best], "length": [lengths[p] for p, _ in best], "n": [n for _, n in best]}).astype({"length": "int64", "n": "int64"})

    each = docs.select(F.col(text_col).alias("text")).sample(share, seed=1).mapInPandas(counted, "piece string, length long, n long")
    best = each.repartition(MERGE_TASKS, "piece").groupBy("piece", "length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(keys)
    return {r.piece: r.length for r in best.collect()}


def token_counts(docs: DataFrame, path: str, text_col: str = "text", out: str = "tokens", limit: int = LIMIT, table: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with the struct ``out``: n_bytes (UTF-8), n_tokens, over_limit."""
    held = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text_col) if table is None else table)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, split = encoded(path)
        count = Lengths(held.value, encode).count if split else encode
        for texts in batches:
            yield pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    n = n_tokens(F.col(text_col))
    sizes = docs.withColumn(out, F.struct(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens")))
    return sizes.withColumn(out, F.col(out).withField("over_limit", F.col(f"{out}.n_tokens") > limit))
