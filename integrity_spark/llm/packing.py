"""Best-fit packing by minimum bin slack.

Pieces of equal length are interchangeable, so bins are planned on the counts of the lengths, at most ``capacity`` of
them whatever the input. For each bin, the longest length left is taken, and a bitset dynamic programme over
the available lengths (bit s set: some choice sums to s) finds the fullest combination that still fits; it is removed,
at once for as many bins as the counts allow. The plan holds, for each length, ranges of ranks and the bins and places
they go to; pieces get their rank within their length in two levels (salted, then offsets of the salts), so that a
length that a third of all pieces have is shared by tasks as its count grows. Counts, salts and plan are broadcast: the
capacity bounds their rows. Offsets grow with the root of the pieces and are broadcast behind a count.

Defined results: a null or blank text is the end token alone; an added token of the tokenizer that stands in a text is
that token, as in ``encode(text, add_special_tokens=False)``; a very long text is taken whole, in one call;
pieces tied in length are ranked by id, piece and checksum, which of equal rows comes first being arbitrary; repeated rows
are packed each, pieces of null id too; an empty table gives no rows; extra columns, whatever their names, don't pass
through.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

CAPACITY, END_TOKEN = 4096, 1
#: Pieces of one length that a task ranks, at least; offsets (of lengths and salts) that are broadcast at most.
LEAST_SALT_ROWS, BROADCAST_OFFSETS = 512, 500_000
#: Parts of texts whose ids a worker keeps; it starts anew beyond. Characters of text that it takes at once; new parts
#: that it encodes together.
KEPT_WORDS, TEXT_AT_ONCE, TOGETHER = 400_000, 1_000_000, 200
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbered(dict):
    """Numbers its keys as they come and remembers the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


# White space as the tokenizer sees it, characters that stand for themselves when lower-cased one by one,
# letters among these, how the tokenizer parts them, and how it marks the end of a part.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿœŒ"
PLAIN = f"{LETTERS}\t\n\r -~¡¿«»“”‘’„…–—€°"
PARTS = f"[{LETTERS}]+|[0-9]|'(?:[sS]|[tT]|[rR][eE]|[vV][eE]|[mM]|[lL][lL]|[dD])|[^{BLANK}{LETTERS}0-9]+"
WORD_END = "</w>"
# The tokenizer's normalizer and the pattern of its pre-tokenizer, for which all this holds.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_words(spec: dict) -> bool:
    """Whether a tokenizer's file parts and ends words as the lookup takes it."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = steps[0]
    return (spec.get("normalizer") or {}).get("normalizers") == NORMALIZER and first.get("pattern") == {"Regex": SPLIT} and first.get("invert") is True and spec["model"].get("end_of_word_suffix") == WORD_END and not spec["model"].get("dropout")


class WordTokenizer:
    """Ids of whole texts by lookup. The tokenizer drops white space, ignores case and parts letters, single digits and
    punctuation, so the ids of a text of plain characters are those of its parts in turn. Each distinct part is encoded
    once, many at a time, where the tokens' own end marks tell the parts apart. A word with any other character is
    encoded as a whole, by itself. The tokenizer's added tokens are cut out of the text as written, before all else, and
    have one id each; ``encode_special_tokens`` makes plain text of them. A tokenizer that parts words in any other way encodes
    whole texts."""

    def __init__(self, path: str, encode_special_tokens: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = encode_special_tokens
        self.whole = not parts_words(json.loads(self.tokenizer.to_str()))
        added = [] if encode_special_tokens else sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added, self.added_start = set(added), commonprefix(added)
        self.cut = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.plain = re.compile(f"[{PLAIN}]*")
        self.parts, self.words = re.compile(PARTS), re.compile(f"(?<![^{BLANK}])(?=[{PLAIN}]*[^{PLAIN}{BLANK}])[^{BLANK}]+|{PARTS}")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.number, self.ids, self.start = _Numbered(), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def learn(self) -> None:
        new, self.number.new = self.number.new, []
        one = [self.parts.fullmatch(x) is not None for x in new]
        joined, alone = [k for k, ok in enumerate(one) if ok], [k for k, ok in enumerate(one) if not ok]
        got: list = [None] * len(new)
        blocks = [joined[k : k + TOGETHER] for k in range(0, len(joined), TOGETHER)]
        texts = [" ".join(new[k] for k in block) for block in blocks]
        for block, e in zip(blocks, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            flat = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[flat]) + 1
            if len(cuts) != len(block):
                alone += block
                continue
            for k, lo, hi in zip(block, [0, *cuts.tolist()], cuts.tolist(), strict=False):
                got[k] = flat[lo:hi]
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([new[k] for k in alone], add_special_tokens=False), strict=True):
            got[k] = np.array(e.ids, np.uint32)
        self.ids = np.concatenate([self.ids, *got])
        self.start = np.r_[self.start, self.start[-1] + np.cumsum([len(x) for x in got], dtype=np.int64)]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        lo = 0
        while lo < len(texts):
            hi, room = lo, TEXT_AT_ONCE
            while hi < len(texts) and (hi == lo or room > 0):
                room -= len(texts[hi] or "")
                hi += 1
            if self.whole:
                yield from (np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts[lo:hi]], add_special_tokens=False))
            else:
                yield from self._encode(texts[lo:hi])
            lo = hi

    def split(self, text: str) -> list[str]:
        """The parts of a text, its words with odd characters, and the added tokens in it."""
        if self.plain.fullmatch(text) and (self.cut is None or self.added_start not in text):
            return self.parts.findall(text.lower())
        out: list[str] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.added:
                out.append(piece)
            else:
                out += [x.lower() if self.plain.fullmatch(x) else x for x in self.words.findall(piece)]
        return out

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.number) > KEPT_WORDS:
            self.clear()
        split = [self.split(t or "") for t in texts]
        counts = [len(x) for x in split]
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, sum(counts))
        del split
        self.learn()
        sizes = self.start[at + 1] - self.start[at]
        ends = np.cumsum(sizes)
        flat = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - sizes), sizes)]
        cuts = np.r_[0, ends][np.cumsum(counts)]
        return np.split(flat, cuts[:-1])


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, so that its parts outlive a task. A task has one core, so the tokenizer's own threads
    would only get in each other's way."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END_TOKEN, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document, cut only beyond ``capacity``; with their ``ids`` if wanted. Narrow."""
    path = path or tokenizer_path()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(path)
        for batch in batches:
            rows, of = [], []
            for nth, ids in enumerate(tok.encode(list(batch.text))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for k, lo in enumerate(range(0, len(ids), capacity)):
                    part = ids[lo : lo + capacity]
                    of.append(nth)
                    rows.append((k, lo, len(part), zlib.crc32(part.tobytes())) + ((part.astype(np.int64),) if with_ids else ()))
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            out.insert(0, "doc_id", pd.arrays.IntegerArray(batch.id.to_numpy(np.int64)[of], ~batch.known.to_numpy(bool)[of]))
            yield out

    key = F.col(id_col).cast("long")
    return docs.select(F.coalesce(key, F.lit(0)).alias("id"), key.isNotNull().alias("known"), F.col(text_col).alias("text")).mapInPandas(cut, PIECE + ", ids array<int>" * with_ids)


def fullest(counts: np.ndarray, lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, how many) whose sum is nearest below ``room``, by a bitset over reachable sums."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        left, power = min(int(counts[length]), room // length), 1
        while left > 0:
            take = min(power, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & full
            left -= take
            power *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return list(used.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first bin, pieces a bin, offset of the first): bins are filled by
    ranges of ranks of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    taken, rows, first = np.zeros(capacity + 1, np.int64), [], 0
    lengths = [int(x) for x in np.flatnonzero(left)[::-1]]
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        chosen = dict(fullest(left, lengths, capacity - longest)) if capacity > longest else {}
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(int(left[x]) // n for x, n in chosen.items())
        offset = 0
        for x in sorted(chosen, reverse=True):
            n = chosen[x]
            rows.append((x, int(taken[x]), int(taken[x] + n * bins), first, n, offset))
            offset += n * x
            taken[x] += n * bins
            left[x] -= n * bins
        first += bins
        lengths = [x for x in lengths if left[x]]
    return rows


def packed(cut: DataFrame, capacity: int = CAPACITY, salt_rows: int | None = None) -> DataFrame:
    """``cut`` (from ``pieces``, written) with ``sequence_id`` and ``offset``. ``salt_rows``: pieces of one length that a
    task ranks, about; by default their whole number's root, so that tasks and offsets both stay few."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    room = salt_rows or max(LEAST_SALT_ROWS, math.isqrt(sum(counts.values())))
    salts = {length: -(-n // room) for length, n in counts.items()}
    small = "broadcast" if sum(salts.values()) <= BROADCAST_OFFSETS else "merge"
    spread = spark.createDataFrame([*salts.items()] or [(0, 1)], "length long, salts long")
    salted = cut.join(spread.hint("broadcast"), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    sizes = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    rows = plan(counts, capacity) or [(0, 0, 0, 0, 1, 0)]
    plans = spark.createDataFrame(rows, "length long, lo long, hi long, first long, each long, place long")
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("ahead"))
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("rank", rank - 1).join(offsets.hint(small), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    p, r = plans.hint("broadcast"), ranked
    met = r.join(p, (r.length == p.length) & (r["rank"] >= p.lo) & (r["rank"] < p.hi)).drop(p.length)
    nth = F.col("rank") - F.col("lo")
    return met.select(*cut.columns, (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("place") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return packed(written(pieces(docs, id_col, text_col, capacity, path=path), "pieces"), capacity)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` and the ``pieces`` in them; a sequence is bounded by
    the capacity."""
    laid = packed(written(pieces(docs, id_col, text_col, capacity, path=path, with_ids=True), "pieces"), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return laid.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))
