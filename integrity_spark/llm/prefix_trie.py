"""The trie of conversation prefixes, from padded matrices of turn ids.

A turn's id is the MD5 of its role and text, as two 64-bit numbers. Conversations are rows of ids, cut into blocks of WIDTH turns; a
block stands under the key of all turns before it. Rows are dealt to shards by ranges of (block, key, ids), equal ones by their
conversation. A shard is one padded matrix: numpy's lexsort orders it, the columns' changes from row to row are OR-accumulated
along the row, so a set bit is the start of a node, and for each depth ``reduceat`` adds up the rows from start to start.

Everything that a node needs of its subtree is a sum over its rows. Words of distinct nodes: each node is owned by its first row in
its block's order, so a row owns the words behind its common prefix with the row before. Leaves: each is owned by the last row
that ends there. What rows own in later blocks is added up once for each conversation that has several blocks.

A shard also gets the row before its first and the one behind its last; so pieces of nodes on both sides of a border are sums that
just add up. These border nodes, at most two paths a shard, nodes whose children stand in a later block, and the root are
grouped by key again; all other nodes are final in their shard. Lists of conversations that end in a node are hashed as streams.

Defined results: rows without a conversation id take no part; null role or text counts as empty; null turns sort first; turns of one
number sort by the MD5 of role and text; repeated rows are turns of their own; very long texts count whole; an empty table has
no nodes; extra columns don't pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import row_number, running_sum, running_xor, scan
from ..sources.shared import small_or_merged
from .common import streamed_sha, tasks, written

#: Turns of a block; rows of a shard, about. Turns that conversations may take from another one.
WIDTH, SHARD_ROWS, HEAD = 64, 32_768, 3
LEAST = -(2**63)
NODES = "partial boolean, depth long, k1 long, k2 long, p1 long, p2 long, conv long, parent long, n long, children long, leaves long, saved long, sha string, ends array<long>, at long"
OWNED = "conv long, block long, words long, leaves long"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def mixed(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of ids (pairs in the last axis) at places, for keys of prefixes that are XORs of them."""
    out = []
    with np.errstate(over="ignore"):
        hi, lo = ids[..., 0].view(np.uint64), ids[..., 1].view(np.uint64)
        # Odd multipliers of a common 64-bit finalizer.
        for a, b in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
            x = hi * np.uint64(a) ^ (lo + at.astype(np.uint64) * np.uint64(b))
            for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
            out.append((x ^ (x >> np.uint64(31))).view(np.int64))
    return np.stack(out, axis=-1)


@F.pandas_udf(T.ArrayType(T.LongType()))
def folded(ids: pd.Series, block: pd.Series) -> pd.Series:
    """The XOR of a whole block's hashes."""
    return pd.Series([np.bitwise_xor.reduce(mixed(np.array(x, np.int64).reshape(-1, 2), np.arange(len(x) // 2) + b * WIDTH), axis=0).tolist() for x, b in zip(ids, block, strict=True)])


class Matrix:
    """The sorted rows of a shard, between its neighbours' rows (``kind`` -1 and 1)."""

    def __init__(self, part: pd.DataFrame) -> None:
        length = part.ids.map(len).to_numpy(np.int64) // 2
        width = max(1, int(length.max()))
        ids = np.full((len(part), width, 2), LEAST, np.int64)
        words = np.zeros((len(part), width + 1), np.int64)
        there = np.arange(width)[None, :] < length[:, None]
        if there.any():
            ids[there] = np.concatenate([np.asarray(x, np.int64) for x in part.ids]).reshape(-1, 2)
            words[:, 1:][there] = np.concatenate([np.asarray(x, np.int64) for x in part.words])
        group = part[["block", "k1", "k2"]].to_numpy(np.int64)
        columns = ids.reshape(len(part), -1)
        by = np.lexsort((part.conv, part.goes_on, *columns.T[::-1], *group.T[::-1], part.kind))
        self.part, self.length, self.ids, self.group = part.iloc[by], length[by], ids[by], group[by]
        self.words = words[by].cumsum(axis=1)  # words before each column
        other = np.r_[True, (self.group[1:] != self.group[:-1]).any(axis=1)]
        change = np.ones((len(part), width), bool)
        change[1:] = (self.ids[1:] != self.ids[:-1]).any(axis=2)
        self.new = np.logical_or.accumulate(change, axis=1) | other[:, None]
        before = np.r_[0, self.length[:-1]]
        self.common = np.minimum(np.minimum((~self.new).sum(axis=1), self.length), before)
        self.first = other
        kind = self.part.kind.to_numpy()
        lo, hi = int((kind < 0).sum()), len(part) - int((kind > 0).sum())
        goes_on = self.part.goes_on.to_numpy(bool)
        extended = np.r_[~other[1:] & (self.common[1:] >= self.length[:-1]), False]
        rows = np.arange(len(part))
        self.owned = self.words[rows, self.length] - self.words[rows, self.common]
        self.leaf = (~goes_on & ~extended).astype(np.int64)
        self.own, self.goes_on = slice(lo, hi), goes_on
        #: Turns that the last own row shares with the next shard's first.
        self.shared_next = int(self.common[hi]) if hi < len(part) and not other[hi] else -1

    def totals(self) -> pd.DataFrame:
        own = self.part.iloc[self.own]
        return pd.DataFrame({"conv": own.conv, "block": own.block, "words": self.owned[self.own], "leaves": self.leaf[self.own]})

    def nodes(self, at: int) -> pd.DataFrame:
        s, own = self.own, self.part.iloc[self.own]
        conv, goes_on, length, new = own.conv.to_numpy(np.int64), self.goes_on[s], self.length[s], self.new[s]
        owned = self.owned[s] + own.deep_words.to_numpy(np.int64)
        leaves = self.leaf[s] + own.deep_leaves.to_numpy(np.int64)
        total, prior, words, common = own.total.to_numpy(np.int64), own.prior.to_numpy(np.int64), self.words[s], self.common[s]
        block, base = self.group[s][:, 0], self.group[s][:, 1:]
        width = new.shape[1]
        keys = np.bitwise_xor.accumulate(mixed(self.ids[s], np.arange(width)[None, :] + block[:, None] * WIDTH), axis=1) ^ base[:, None, :]
        out, n = [], len(own)

        # The root, and what blocks behind the first add to the nodes that they stand under.
        starts = np.flatnonzero(np.r_[True, (self.group[s][1:] != self.group[s][:-1]).any(axis=1)])
        top = block[starts] == 0
        kids = np.add.reduceat((new[:, 0] & (length > 0)).astype(np.int64), starts)
        zero = np.zeros(len(starts), np.int64)
        sums = {"n": np.diff(np.r_[starts, n]), "leaves": np.add.reduceat(leaves, starts), "saved": np.add.reduceat(total - owned, starts)}
        ended = [conv[a:b][(length[a:b] == 0)] if root else [] for a, b, root in zip(starts, np.r_[starts[1:], n], top, strict=True)]
        frame = {"partial": True, "depth": block[starts] * WIDTH, "k1": base[starts, 0], "k2": base[starts, 1], "p1": None, "p2": None, "conv": np.where(top, np.minimum.reduceat(conv, starts), LEAST), "parent": LEAST, "children": kids}
        out.append(pd.DataFrame(frame | {c: np.where(top, v, zero) for c, v in sums.items()} | {"sha": None, "ends": ended}))

        above_start, above_conv, above_partial = None, None, None
        for d in range(width):
            idx = np.flatnonzero(length > d)
            if not len(idx):
                break
            starts = np.flatnonzero(np.r_[True, new[idx[1:], d]])
            at_row, size = idx[starts], np.diff(np.r_[starts, len(idx)])
            true_start = new[at_row, d]
            add = lambda v: np.add.reduceat(v[idx], starts)  # noqa: E731, B023
            first = np.where(true_start, words[at_row, common[at_row]] - words[at_row, d], 0)
            saved = add(total) - size * (prior[at_row] + words[at_row, d]) - add(owned) - first
            kids = add((new[:, d + 1] & (length > d + 1)).astype(np.int64)) if d + 1 < width else np.zeros(len(starts), np.int64)
            ends = (length == d + 1) & ~goes_on
            partial = ~true_start
            if self.shared_next > d and idx[-1] == n - 1:
                partial[-1] = True
            if d == WIDTH - 1:
                partial |= add(goes_on.astype(np.int64)) > 0
            smallest = np.minimum.reduceat(conv[idx], starts)
            if d:
                of = np.searchsorted(above_start, at_row, side="right") - 1
                parent, known = above_conv[of], ~above_partial[of]
                above = keys[at_row, d - 1]
            else:
                parent, known, above = np.full(len(starts), LEAST), np.zeros(len(starts), bool), base[at_row]
            n_ends = add(ends.astype(np.int64))
            lists = [conv[idx[a : a + m]] if m else () for a, m in zip(starts, n_ends, strict=True)]  # who ends stands first
            sha = [None if p else hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() if len(x) else EMPTY_SHA for x, p in zip(lists, partial, strict=True)]
            frame = {"partial": partial, "depth": block[at_row] * WIDTH + d + 1, "k1": keys[at_row, d, 0], "k2": keys[at_row, d, 1], "p1": above[:, 0], "p2": above[:, 1], "conv": smallest, "parent": np.where(known, parent, LEAST)}
            out.append(pd.DataFrame(frame | {"n": size, "children": kids, "leaves": add(leaves), "saved": saved, "sha": sha, "ends": [x if p else () for x, p in zip(lists, partial, strict=True)]}))
            above_start, above_conv, above_partial = at_row, smallest, partial
        made = pd.concat(out, ignore_index=True)
        for c in ("conv", "parent"):
            made[c] = made[c].astype("Int64").where(made[c] != LEAST)
        for c in ("p1", "p2"):
            made[c] = made[c].astype("Int64")
        made["at"] = at
        return made


def sharded(blocks: DataFrame, emit: Callable[[Matrix, int], pd.DataFrame], schema: str) -> DataFrame:
    """Blocks dealt to shards by ranges, each with its neighbours' next rows, and what ``emit`` makes of it."""
    shards = max(tasks(blocks.sparkSession), -(-blocks.count() // SHARD_ROWS))
    order = ["block", "k1", "k2", "ids", "goes_on", "conv"]
    dealt = written(blocks.repartitionByRange(shards, *order).withColumn("at", F.spark_partition_id().cast("long")), "trie-rows")
    row = F.struct(*order, "words")
    ends = dealt.groupBy("at").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    w = W.orderBy("at")  # a row for each shard
    near = ends.select("at", F.lag("hi").over(w).alias("before"), F.lead("lo").over(w).alias("behind"))
    around = near.select("at", F.inline(F.array(F.struct(F.lit(-1).alias("kind"), F.col("before").alias("r")), F.struct(F.lit(1).alias("kind"), F.col("behind").alias("r"))))).where("r IS NOT NULL").select("at", "kind", "r.*")
    rows = dealt.withColumn("kind", F.lit(0)).unionByName(around, allowMissingColumns=True)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return emit(Matrix(part.fillna({c: 0 for c in ("prior", "total", "deep_words", "deep_leaves")})), int(key[0]))

    return rows.groupBy("at").applyInPandas(run, schema)


def id_parts(digest: Column) -> Column:
    """An MD5 in hex as two longs above the padding."""
    half = lambda at: F.greatest(F.conv(F.substring(digest, at, 16), 16, -10).cast("long"), F.lit(LEAST + 1))
    return F.array(half(1), half(17))


def packed(turns: Column) -> tuple[Column, Column]:
    """Ids and words of an array of turns."""
    return F.flatten(F.transform(turns, lambda t: t.id)), F.transform(turns, lambda t: t.words)


def rebuilt(turns: DataFrame) -> DataFrame:
    """Blocks of conversations whose first turns come from another one, by the rule of the query: ``conv, block, ids, words,
    goes_on`` for ``(conv, turn, digest, words)``."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    t = turns.withColumn("t", F.struct("turn", "digest", id_parts(F.col("digest")).alias("id"), "words"))
    long = written(t.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > WIDTH).select("conv"), "long-conversations")
    several = bool(long.take(1))
    hint = small_or_merged(long)
    short = (t.join(hint, "conv", "left_anti") if several else t).groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    short = written(short.select("conv", F.transform("t", lambda x: F.struct(x.id.alias("id"), x.words.alias("words"))).alias("t")), "short")
    head = short.where("conv % 20 = 0").select("conv", F.slice("t", 1, HEAD).alias("head"))
    if several:
        placed = written(scan(t.join(hint, "conv", "left_semi").select("conv", "turn", "digest", "t"), ["conv"], ["turn", "digest"], {"pos": row_number()}).select("conv", (F.col("pos") - 1).alias("pos"), F.struct("t.id", "t.words").alias("t")), "long")
        first = placed.where(f"conv % 20 = 0 AND pos < {HEAD}").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("x")).select("conv", F.col("x.t").alias("head"))
        head = head.unionByName(first)
    heads = written(head.withColumnRenamed("conv", "base"), "heads")

    none = F.array().cast(heads.schema["head"].dataType)
    base = F.col("conv") - F.col("conv") % 20
    met = short.withColumns({"base": base, "h": h.cast("int")}).join(heads.hint("merge"), "base", "left")
    whole = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("t", F.col("h") + 1, F.greatest(F.size("t"), F.lit(1))))
    ids, words = packed(F.col("w"))
    out = met.withColumn("w", whole).select("conv", F.lit(0).cast("long").alias("block"), ids.alias("ids"), words.alias("words"), F.lit(False).alias("goes_on"))
    if not several:
        return out
    taken = long.withColumns({"base": base, "h": h}).join(heads.hint("merge"), "base", "left").select("conv", "h", F.slice(F.coalesce("head", none), F.lit(1), F.col("h").cast("int")).alias("head"))
    taken = written(taken, "taken")
    own = placed.join(small_or_merged(taken), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.size("head")).alias("pos"), "t")
    given = taken.select("conv", F.posexplode("head").alias("pos", "t")).select("conv", F.col("pos").cast("long").alias("pos"), "t")
    cut = own.unionByName(given).groupBy("conv", F.floor(F.col("pos") / WIDTH).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("x"))
    last = cut.groupBy("conv").agg(F.max("block").alias("last"))
    ids, words = packed(F.col("x.t"))
    return out.unionByName(cut.join(last.hint("merge"), "conv").select("conv", "block", ids.alias("ids"), words.alias("words"), (F.col("block") < F.col("last")).alias("goes_on")))


def trie(blocks: DataFrame) -> DataFrame:
    """The nodes of all prefixes of ``(conv, block, ids, words, goes_on)``: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    none = F.lit(0).cast("long")
    sums = F.aggregate("words", none, lambda a, x: a + x)
    own = written(blocks.withColumn("sum", sums), "blocks")
    plain = {"k1": none, "k2": none, "prior": none, "total": F.col("sum"), "deep_words": none, "deep_leaves": none}
    lone = own.where("block = 0 AND NOT goes_on").withColumns(plain)
    rows = lone
    cut = own.where("block > 0 OR goes_on")
    if cut.take(1):
        hashed = cut.withColumn("x", folded("ids", "block")).withColumns({"x1": F.get("x", F.lit(0)), "x2": F.get("x", F.lit(1))}).drop("x")
        keyed = written(scan(hashed, ["conv"], ["block"], {"k1": running_xor("x1"), "k2": running_xor("x2"), "prior": running_sum("sum", before=True)}).drop("x1", "x2"), "keyed")
        total = keyed.groupBy("conv").agg(F.sum("sum").alias("total"))
        owned = sharded(keyed.where("block > 0").drop("sum"), lambda m, _: m.totals(), OWNED)
        both = keyed.select("conv", "block").where("block = 0").withColumns({"words": none, "leaves": none}).unionByName(owned).withColumn("back", -F.col("block"))
        deep = scan(both, ["conv"], ["back"], {"deep_words": running_sum("words", before=True), "deep_leaves": running_sum("leaves", before=True)}).select("conv", "block", "deep_words", "deep_leaves")
        long = keyed.join(total.hint("merge"), "conv").join(deep.hint("merge"), ["conv", "block"])
        rows = lone.unionByName(long)
    made = written(sharded(rows.drop("sum"), lambda m, at: m.nodes(at), NODES), "nodes")
    key = ["depth", "k1", "k2"]
    pieces = made.where("partial")
    merged = pieces.groupBy(*key).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv").alias("conv"), F.max("parent").alias("parent"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")))
    name = F.concat_ws(":", *key)
    shas = streamed_sha(pieces.where(F.size("ends") > 0).select(name.alias("key"), F.col("at").alias("seg"), F.array_join("ends", ",").alias("part")), ",")
    borders = written(merged.withColumn("key", name).join(shas.hint("merge"), "key", "left").drop("key"), "borders")
    whole = made.where("NOT partial").select(*borders.columns).unionByName(borders)
    parents = borders.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("above"))
    met = whole.join(small_or_merged(parents), ["depth", "p1", "p2"], "left")
    return met.select(F.col("conv").alias("conv_id"), "depth", F.coalesce("parent", "above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def turn_ids(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, digest, words`` of the turns that take part."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), words.alias("words"))
