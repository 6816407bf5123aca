"""Near-duplicate documents by b-bit MinHash.

One narrow pass gives each document its shingle count, a 128-bit key of its shingle set, 25 band keys of 5 minima
each, and 384 minima of which only the low 4 bits are kept, packed in 24 longs. Documents with the same set become one
class at once, so copies cost nothing further. Classes that share a band are candidates. Inside a band bucket, dealt
in blocks of bounded size, pairs are compared by bit counts: with share m of equal lanes, the similarity estimate is
(m - 2**-b) / (1 - 2**-b). Pairs estimated well below the threshold go; the rest are counted on their sets of shingle hashes, for
which a text goes once to each block in which it has pairs, and what is left is confirmed on the full shingle sets: all in
two rounds. The first takes each class's nearest partners of a bucket, which already joins nearly all groups.
The second takes every remaining pair across different components, so that no link that matters is left out.

Defined results: null or blank text has no shingles and links with nothing; a text of fewer than five words is one
shingle; a very long text counts whole; equal rows share a class; pairs exactly at the threshold are linked; rows of one
id are one document, linked through each of their texts; a null doc_id stays alone with a null component and is kept;
an empty table gives no rows; extra columns, whatever their names, don't pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

WORDS, THRESHOLD = 5, 85
BANDS, ROWS, MINIMA, BITS = 25, 5, 384, 4
#: Candidates estimated so many standard errors under the threshold are dropped; the largest share of pairs at the
#: threshold that may have no band in common.
ERRORS, MISSED = 4, 1e-4
#: Members of a block of a band bucket, about; partners of the first round.
BLOCK, NEAREST = 1024, 3
#: Shingle hashes that a task holds at once, about.
TILE = 4_000_000
SIGNATURE = "n_shingles long, set_a long, set_b long, lanes array<long>, bands array<long>"

_rng = np.random.default_rng(20_240_607)
MULTIPLY = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z lower-cased; only the six ASCII blanks part words."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(text: str | None) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    return set(zip(*(w[k:] for k in range(WORDS)))) if len(w) >= WORDS else {tuple(w)} if w else set()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    words = words_of(text)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    spans = max(1, len(w) - WORDS + 1)
    size = min(WORDS, len(w))
    h = np.full(spans if size else 0, size, np.uint64)
    for k in range(size):
        h = h * PRIME + w[k : k + spans]
    return np.unique(mixed(h))


def signature(texts: list[str | None], hashes: _Hashes) -> list[tuple]:
    rows: list = [(0, 0, 0, None, None)] * len(texts)
    sets = [shingle_hashes(t, hashes) for t in texts]
    at = [k for k, s in enumerate(sets) if len(s)]
    lo = 0
    while lo < len(at):
        hi, room = lo, 40_000
        while hi < len(at) and (hi == lo or room >= len(sets[at[hi]])):
            room -= len(sets[at[hi]])
            hi += 1
        own = [sets[k] for k in at[lo:hi]]
        sizes = np.array([len(s) for s in own])
        flat, starts = np.concatenate(own), np.r_[0, np.cumsum(sizes)[:-1]]
        keys = [np.add.reduceat(mixed(flat + np.uint64(c)), starts).view(np.int64) for c in (1, 2)]
        low = np.empty((MINIMA, len(own)), np.uint64)
        for k in range(MINIMA):
            low[k] = np.minimum.reduceat(flat * MULTIPLY[k] + ADD[k], starts)
        lanes = np.zeros((len(own), MINIMA * BITS // 64), np.uint64)
        per = 64 // BITS
        for k in range(MINIMA):
            lanes[:, k // per] |= (low[k] & np.uint64(2**BITS - 1)) << np.uint64(k % per * BITS)
        bands = np.empty((len(own), BANDS), np.uint64)
        for k in range(BANDS):
            h = np.full(len(own), k + 1, np.uint64)
            for r in range(ROWS):
                h = mixed(h * PRIME + low[k * ROWS + r])
            bands[:, k] = h
        for j, k in enumerate(at[lo:hi]):
            rows[k] = (int(sizes[j]), int(keys[0][j]), int(keys[1][j]), lanes[j].view(np.int64).tolist(), bands[j].view(np.int64).tolist())
        lo = hi
    return rows


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    @F.pandas_udf(SIGNATURE)
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for texts in batches:
            if len(hashes) > 300_000:
                hashes.clear()
            yield pd.DataFrame(signature(list(texts), hashes), columns=[x.split()[0] for x in SIGNATURE.split(", ")])

    return docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")).alias("text_key"), signed(F.col(text_col)).alias("s")).select("id", "text_key", "s.*")


def estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures, by bit counts."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    differ = np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1)
    c = 2.0**-BITS
    return (1 - differ / MINIMA - c) / (1 - c)


def least_estimate(threshold: int) -> float:
    """The estimate from which a candidate is confirmed: ERRORS standard errors under the threshold in percent."""
    c, s = 2.0**-BITS, threshold / 100
    m = s + (1 - s) * c
    return s - ERRORS * math.sqrt(m * (1 - m) / MINIMA) / (1 - c)


def missed(threshold: int) -> float:
    """The share of pairs at the threshold that have no band in common."""
    return (1 - (threshold / 100) ** ROWS) ** BANDS


def _pairs(group: np.ndarray, side: np.ndarray, node: np.ndarray, comp: np.ndarray, lanes: np.ndarray, band: np.ndarray, bands: np.ndarray, nearest: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of one run of whole groups, and a row of each pair's group: all rows of a group stand together. side: bits of the
    blocks a row belongs to; a group of two blocks pairs only across them. A pair that shares several bands is taken in the
    first of them only."""
    left, right, near = [], [], []
    live, shift = np.arange(len(group)), 1
    while True:
        live = live[live + shift < len(group)]
        live = live[group[live] == group[live + shift]]
        if not len(live):
            break
        at = live[(comp[live] != comp[live + shift]) & ((side[live] | side[live + shift]) == 3)]
        est = estimates(lanes[at], lanes[at + shift])
        good = est >= least
        same = bands[at[good]] == bands[at[good] + shift]
        good[good] = bands[at[good], same.argmax(axis=1)] == band[at[good]]
        left.append(at[good])
        right.append(at[good] + shift)
        near.append(est[good])
        shift += 1
    if not left:
        return (np.empty(0, np.int64),) * 3
    i, j, e = map(np.concatenate, (left, right, near))
    if nearest and len(i):
        who, other, e2 = np.r_[i, j], np.r_[j, i], np.r_[e, e]
        by = np.lexsort((-e2, who))
        w = who[by]
        start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        rank = np.arange(len(w)) - np.repeat(start, np.diff(np.r_[start, len(w)]))
        take = by[rank < nearest]
        i, j = who[take], other[take]
    pairs, first = np.unique(np.sort(np.c_[node[i], node[j]], axis=1), axis=0, return_index=True)
    return pairs[:, 0], pairs[:, 1], i[first]


def candidates(members: DataFrame, nearest: int, least: float) -> DataFrame:
    """Distinct pairs (a < b) of bucket members ``(band, copies, id, comp, lanes, bands)`` in different components that are
    estimated at ``least`` or more by their bits; with ``nearest``, only the nearest few of each member in each block. ``tile``
    names the blocks in which a pair was met: all pairs of a tile have at most two blocks of members."""
    blocks = F.ceil(F.col("copies") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("band", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "id", "comp", "lanes", "bands", F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
        .withColumn("tile", F.xxhash64("band", "bi", "bj"))
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(part: pd.DataFrame) -> pd.DataFrame:
            group = part.groupby(["band", "bi", "bj"], sort=False).ngroup().to_numpy()
            a, b, at = _pairs(group, part.side.to_numpy(), part.id.to_numpy(), part.comp.to_numpy(), np.stack(part.lanes.to_numpy()).view(np.uint64), part.band.to_numpy(), np.stack(part.bands.to_numpy()), nearest, least)
            return pd.DataFrame({"a": a, "b": b, "tile": part.tile.to_numpy()[at]})

        rest = None
        for batch in batches:
            part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = part.iloc[-1]
            tail = (part.band == last.band) & (part.bi == last.bi) & (part.bj == last.bj)
            rest = part[tail]
            if not tail.all():
                yield found(part[~tail])
        if rest is not None and len(rest):
            yield found(rest)

    return dealt.repartition("band", "bi", "bj").sortWithinPartitions("band", "bi", "bj").mapInPandas(compare, "a long, b long, tile long")


def likely(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """Those pairs ``(a, b, tile)`` whose sets of shingle hashes meet the threshold. A text goes to each of its tiles once, not to each of
    its pairs: of k texts of one template, all pairs of which may be candidates, each is sent as often as it has bands and blocks.
    Tiles of more than TILE shingles are cut by both ids, so a task holds about that many hashes at once."""
    met = pairs.select("tile", F.col("a").alias("id")).unionByName(pairs.select("tile", F.col("b").alias("id"))).distinct()
    cuts = met.join(sizes.hint("merge"), "id").groupBy("tile").agg(F.ceil(F.sum("n_shingles") / TILE).cast("int").alias("cuts"))
    dealt = pairs.join(cuts.hint("merge"), "tile")
    part = lambda c: F.pmod(F.xxhash64(c), F.col("cuts"))
    dealt = written(dealt.select("a", "b", F.xxhash64("tile", part("a"), part("b")).alias("tile")), "tiles")
    asked = dealt.select("tile", F.col("a").alias("id")).unionByName(dealt.select("tile", F.col("b").alias("id"))).distinct()
    own = asked.join(texts.hint("merge"), "id").withColumn("kind", F.lit(0))
    rows = own.unionByName(dealt.withColumn("kind", F.lit(1)), allowMissingColumns=True).select("tile", "kind", F.coalesce("id", "a").alias("a"), "b", "text")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, sets, hashes = None, {}, _Hashes()
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for k, (t, kind, a, b, text) in enumerate(zip(batch.tile, batch.kind, batch.a, batch.b, batch.text, strict=True)):
                if t != tile:
                    tile, sets = t, {}
                if kind == 0:
                    if len(hashes) > 300_000:
                        hashes.clear()
                    sets[a] = shingle_hashes(text, hashes)
                else:
                    x, y = sets[a], sets[int(b)]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = 100 * both >= threshold * (len(x) + len(y) - both) > 0
            yield batch.loc[keep, ["a", "b"]].astype("int64")

    return rows.repartition("tile").sortWithinPartitions("tile", "kind", "a").mapInPandas(check, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Those pairs whose full shingle sets meet ``100 * intersection >= threshold * union``."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, set] = {}

        def of(key: int, text: str) -> set:
            if key not in kept:
                if len(kept) >= 64:
                    kept.pop(next(iter(kept)))
                kept[key] = shingle_set(text)
            return kept[key]

        for part in batches:
            keep = []
            for a, b, x, y in zip(part.a, part.b, part.text_a, part.text_b, strict=True):
                s, t = of(a, x), of(b, y)
                both = len(s & t)
                keep.append(100 * both >= threshold * (len(s) + len(t) - both) > 0)
            yield part.loc[keep, ["a", "b"]]

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return two.select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id``, ``kept``. Thresholds (in
    percent) at which the bands would miss too many pairs are refused."""
    if missed(threshold) > MISSED:
        raise ValueError(f"{BANDS} bands of {ROWS} miss {missed(threshold):.1e} of the pairs at {threshold} %")
    least = least_estimate(threshold)
    signed = written(signatures(docs, id_col, text_col), "signatures")
    sets = ["set_a", "set_b", "n_shingles"]
    # Any numbers serve for the classes: they are fixed once written.
    grouped = signed.where("n_shingles > 0 AND id IS NOT NULL").groupBy(*sets).agg(F.min(F.struct("id", "text_key")).alias("first"), F.min_by(F.struct("lanes", "bands"), F.struct("id", "text_key")).alias("s"))
    classes = written(grouped.select(*sets, F.col("first.id").alias("rep"), "first.text_key", "s.*", F.monotonically_increasing_id().alias("node")), "classes")
    rows_of = written(signed.select("id", *sets).join(classes.select(*sets, "node").hint("merge"), sets, "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("node")).alias("node")), "rows")
    banded = classes.select(F.col("node").alias("id"), F.explode("bands").alias("band"))
    shared = written(banded.groupBy("band").agg(F.count("*").alias("copies")).where("copies > 1"), "bands")
    members = written(banded.join(shared.hint("merge"), "band"), "members")
    lanes = classes.select(F.col("node").alias("id"), "lanes", "bands")
    wanted = classes.select("node", "rep", "text_key").join(written(members.select("id").distinct(), "nodes").withColumnRenamed("id", "node").hint("merge"), "node", "left_semi")
    keyed = docs.select(F.col(id_col).alias("rep"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")).alias("text_key"), F.col(text_col).alias("text"))
    texts = written(keyed.join(wanted.hint("merge"), ["rep", "text_key"]).select(F.col("node").alias("id"), "text").dropDuplicates(["id"]), "texts")
    rows = members.join(lanes.hint("merge"), "id")

    # One id with several texts links their classes.
    spread = rows_of.where("node IS NOT NULL").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").select("id", "a")
    same_id = rows_of.join(written(spread, "ids").hint("merge"), "id").where("node > a").select("a", F.col("node").alias("b"))
    sizes = classes.select(F.col("node").alias("id"), "n_shingles")
    first = written(candidates(rows.withColumn("comp", F.col("id")), NEAREST, least), "pairs")
    links = written(confirmed(written(likely(first, texts, sizes, threshold), "likely"), texts, threshold).union(same_id), "links")
    comps = written(connected_components(links), "components")
    joined = rows.join(comps.hint("merge"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    second = written(candidates(joined, 0, least).join(first.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    more = written(confirmed(written(likely(second, texts, sizes, threshold), "likely"), texts, threshold), "links")
    if more.head(1):
        comps = written(connected_components(links.union(more)), "components")
    named = classes.select(F.col("node").alias("id"), "rep").join(comps.hint("merge"), "id", "left").select("id", "rep", F.coalesce("component", "id").alias("component"))
    lowest = written(named.groupBy("component").agg(F.min("rep").alias("found")), "lowest")
    of_class = written(named.join(lowest.hint("merge"), "component").select(F.col("id").alias("node"), "found"), "found")
    out = rows_of.join(of_class.hint("merge"), "node", "left")
    component = F.coalesce("found", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
