"""Nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Rows are dealt to shards by a hash of their id; shards grow with the root of the rows, up to MOST_ROWS, so that a query
meets few of them. A shard's distinct vectors become the nodes of its graph (copies share a node, with all their ids), so
a vector that a third of all rows hold costs one node a shard. A vector gets one more coordinate that makes all lengths
equal; then the largest inner product is the smallest distance. Levels are drawn geometrically. The graph of a level is
grown in batches: each searches the graph so far with a beam, adds the nearest of its own batch, links to diverse near
nodes (a candidate is taken unless it is closer to one taken before; what room is left takes the nearest others), and the nodes it links to
choose anew among their links and the new ones. Nodes that the first one doesn't reach get a link from one that it does. Links
are kept as one flat neighbour array for each level. A search keeps a small beam on the upper levels and a large one on the
lowest, for many queries at once. How large, each shard finds out itself: it scans all its nodes for the nearest of PROBES of them, and widens
the beam until the graph finds ENOUGH of these, at worst up to a scan of the shard. A shard's index is sent once for each of its parts,
and queries stream behind it; the shards' lists are merged by score.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows of null id; scores are summed in the order of the components, so equal vectors have equal scores
in every shard, and ties go to the smaller id; repeated rows of one id are all candidates of other queries; an empty
table gives no rows; extra columns, whatever their names, don't pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import tasks, written

#: Rows of a shard: ROOT times the root of all rows, within bounds. Queries of a block; entries of its table of visits.
ROOT, LEAST_ROWS, MOST_ROWS, QUERY_ROWS, VISITS = 64, 16_384, 262_144, 1024, 2**26
LINKS, NEAR, BEAM, EXPAND, SEED = 16, 64, 80, 4, 7
#: Beam of the upper levels; what a shard is asked to find: nearest nodes of so many probes, the share of them that is enough, steps of the beam; nodes out of
#: reach that are joined at once.
UPPER, TOP, PROBES, ENOUGH, WIDER, JOINED = 16, 20, 192, 0.95, 1.4, 256
#: Nodes of a level's first batch, which is linked by all its products; nodes of a later batch at most; beam of growing.
FIRST, BATCH, GROWING = 1024, 2048, 96
#: Nodes whose near nodes are compared at once.
BLOCK = 512
#: Precision inside the graph; scores are of the vectors themselves.
GRAPH = np.float32
INDEX = "shard int, dim int, beam int, ids binary, id_from binary, vectors binary, levels array<struct<nodes:binary,links:binary>>"


def valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def diverse(near: np.ndarray, dist: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """For each row of near nodes (nearest first, -1: none) up to ``most``: in turn those not closer to one taken before, then the
    nearest of the others."""
    rows, width = near.shape
    mask, count = np.zeros((rows, width), bool), np.zeros(rows, np.int64)
    for lo in range(0, rows, BLOCK):
        part = slice(lo, lo + BLOCK)
        own, gap = x[near[part]], dist[part]
        square = np.einsum("rkd,rkd->rk", own, own)
        apart = square[:, :, None] + square[:, None, :] - 2 * np.matmul(own, own.transpose(0, 2, 1))
        between = np.full(gap.shape, np.inf, x.dtype)
        for k in range(width):
            ok = (near[part, k] >= 0) & (gap[:, k] <= between[:, k]) & (count[part] < most)
            mask[part, k] = ok
            count[part] += ok
            between = np.where(ok[:, None], np.minimum(between, apart[:, k]), between)
    by = np.argsort(np.where(near < 0, 2, np.where(mask, 0, 1)), axis=1, kind="stable")[:, :most]
    taken = np.full((rows, most), -1, np.int32)
    taken[:, : by.shape[1]] = np.take_along_axis(near, by, axis=1)
    return taken


def nearest_in(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest other rows, nearest first, and the squared distances."""
    width = min(width, len(x) - 1)
    if width <= 0:
        return np.empty((len(x), 0), np.int64), np.empty((len(x), 0))
    square = np.square(x).sum(axis=1)
    d = square[:, None] + square[None, :] - 2 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    near = np.argpartition(d, width - 1, axis=1)[:, :width]
    gap = np.take_along_axis(d, near, axis=1)
    by = np.argsort(gap, axis=1, kind="stable")
    return np.take_along_axis(near, by, axis=1), np.take_along_axis(gap, by, axis=1)


def link_back(links: np.ndarray, x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
    """Nodes ``dst`` choose up to a row's width of links among those they have and their new ``src``, nearest first."""
    width = links.shape[1]
    by = np.lexsort((np.square(x[src] - x[dst]).sum(axis=1), dst))
    src, dst = src[by], dst[by]
    start = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
    nth = np.arange(len(dst)) - np.repeat(start, np.diff(np.r_[start, len(dst)]))
    nodes = dst[start]
    pool = np.full((len(nodes), 2 * width), -1, np.int64)
    pool[:, :width] = links[nodes]
    fits = nth < width
    pool[np.repeat(np.arange(len(nodes)), np.diff(np.r_[start, len(dst)]))[fits], width + nth[fits]] = src[fits]
    for lo in range(0, len(nodes), BATCH):
        p, own = pool[lo : lo + BATCH], nodes[lo : lo + BATCH]
        p.sort(axis=1)
        p[:, 1:][p[:, 1:] == p[:, :-1]] = -1
        gap = np.where(p >= 0, np.square(x[p] - x[own][:, None, :]).sum(axis=2), np.inf)
        by = np.argsort(gap, axis=1, kind="stable")
        p, gap = np.take_along_axis(p, by, axis=1), np.take_along_axis(gap, by, axis=1)
        crowded = (p >= 0).sum(axis=1) > width
        links[own] = p[:, :width]
        links[own[crowded]] = diverse(p[crowded], gap[crowded], x, width)


def grow(x: np.ndarray, most: int) -> np.ndarray:
    """The flat neighbour array of one level over its nodes ``x``, all of one length; every node is reached from the first."""
    n = len(x)
    links, done = np.full((n, 2 * most), -1, np.int32), 0
    while done < n:
        size = min(n - done, FIRST if not done else min(BATCH, done))
        own = x[done : done + size]
        near, gap = nearest_in(own, NEAR)
        near = near + done
        if done:
            start = np.zeros((size, 1), np.int64)
            found, score = beam_search(x[:done], links[:done], start, own, min(GROWING, done))
            far = np.where(found >= 0, np.square(own).sum(axis=1)[:, None] + np.square(x[np.maximum(found, 0)]).sum(axis=2) - 2 * score, np.inf)
            near, gap = np.c_[near, found], np.c_[gap, far]
            by = np.argsort(gap, axis=1, kind="stable")[:, :NEAR]
            near, gap = np.take_along_axis(near, by, axis=1), np.take_along_axis(gap, by, axis=1)
        if near.shape[1]:
            taken = diverse(near, gap, x, most)
            links[done : done + size, :most] = taken
            src, dst = np.repeat(np.arange(done, done + size), most), taken.ravel().astype(np.int64)
            link_back(links, x, src[dst >= 0], dst[dst >= 0])
        done += size
        links[:done] = connected(links[:done], x[:done]) if done < n else links[:done]
    return connected(links, x, wider=True)


def reached(links: np.ndarray, seen: np.ndarray, front: np.ndarray) -> None:
    """Marks in ``seen`` what links lead to from ``front``."""
    while len(front):
        seen[front] = True
        near = np.unique(links[front])
        near = near[near >= 0]
        front = near[~seen[near]]


def connected(links: np.ndarray, x: np.ndarray, wider: bool = False) -> np.ndarray:
    """Links with more ones, so that every node is reached from the first: nodes out of reach get a link from the nearest of those in reach
    that have room, or with ``wider`` a column more."""
    seen = np.zeros(len(x), bool)
    reached(links, seen, np.zeros(1, np.int64))
    rng = np.random.default_rng(SEED)
    while not seen.all():
        lost = np.flatnonzero(~seen)
        lost = lost[rng.permutation(len(lost))[:JOINED]]
        room = seen & (links[:, -1] < 0)
        if not room.any():
            if not wider:
                return links
            links = np.c_[links, np.full((len(x), 1), -1, np.int32)]
            room = seen.copy()
        base = np.flatnonzero(room)
        gap = np.square(x[base]).sum(axis=1)[None, :] - 2 * (x[lost] @ x[base].T)
        at = base[gap.argmin(axis=1)]
        at, first = np.unique(at, return_index=True)
        lost = lost[first]
        links[at, (links[at] >= 0).sum(axis=1)] = lost
        reached(links, seen, lost)
    return links


def build(ids: np.ndarray, vectors: np.ndarray, seed: int) -> dict:
    """The index of one shard, with the beam that it needs."""
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    by = np.lexsort((ids, node.ravel()))
    id_from = np.r_[0, np.cumsum(np.bincount(node.ravel(), minlength=len(distinct)))].astype(np.int64)
    square = np.square(distinct).sum(axis=1)
    x = np.c_[distinct, np.sqrt(np.maximum(square.max() - square, 0))].astype(GRAPH)
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(rng.random(len(x))) / np.log(LINKS)).astype(int)
    level[0] = level.max()  # the first node is on all levels
    levels = []
    for k in range(level.max() + 1):
        nodes = np.flatnonzero(level >= k).astype(np.int32)
        own = grow(x[nodes], LINKS if k == 0 else LINKS // 2)
        levels.append({"nodes": nodes.tobytes(), "links": np.ascontiguousarray(own, np.int32).tobytes()})
    made = {"dim": distinct.shape[1], "beam": BEAM, "ids": ids[by].astype(np.int64).tobytes(), "id_from": id_from.tobytes(), "vectors": distinct.astype(np.float64).tobytes(), "levels": levels}
    return made | {"beam": needed_beam(made, distinct[rng.permutation(len(x))[:PROBES]])}


def needed_beam(index: dict, probes: np.ndarray) -> int:
    """The least widening of BEAM that finds ENOUGH of the nearest nodes of the probes, which a scan of the shard finds all."""
    x = np.frombuffer(index["vectors"]).reshape(-1, index["dim"])
    top, beam = min(TOP, len(x)), BEAM
    score = probes @ x.T
    least = np.partition(score, len(x) - top, axis=1)[:, len(x) - top]
    least = least - 1e-9 * np.maximum(1, np.abs(least))
    while beam < len(x):
        step = max(1, min(PROBES, VISITS // len(x)))
        found = np.concatenate([search(index, probes[lo : lo + step], beam) for lo in range(0, len(probes), step)])[:, :top]
        hit = (found >= 0) & (np.take_along_axis(score, np.maximum(found, 0), axis=1) >= least[:, None])
        if hit.mean() >= ENOUGH:
            break
        beam = int(beam * WIDER)
    return min(beam, len(x))


def search(index: dict, queries: np.ndarray, beam: int) -> np.ndarray:
    """The best nodes of each query, best first; -1 where fewer were met. The first node is always a start, as all others are
    reached from it."""
    x, queries = np.frombuffer(index["vectors"]).reshape(-1, index["dim"]).astype(GRAPH), queries.astype(GRAPH)
    first = np.zeros((len(queries), 1), np.int64)
    start = first
    for k, level in reversed(list(enumerate(index["levels"]))):
        nodes = np.frombuffer(level["nodes"], np.int32)
        links = np.frombuffer(level["links"], np.int32).reshape(len(nodes), -1)
        local = np.where(start >= 0, np.searchsorted(nodes, start), -1)
        found = beam_search(x[nodes] if k else x, links, np.c_[local, first], queries, min(beam, len(nodes)) if k == 0 else min(UPPER, len(nodes)))[0]
        start = np.where(found >= 0, nodes[found], -1)
    return start


def beam_search(x: np.ndarray, links: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The best nodes by inner product that a beam from the ``start`` nodes (-1: none) meets, best first, with their products; -1
    where fewer."""
    q, expand = len(queries), min(EXPAND, beam)
    every = np.arange(q)
    start = np.sort(start, axis=1)
    start[:, 1:][start[:, 1:] == start[:, :-1]] = -1
    first = np.where(start >= 0, np.einsum("qkd,qd->qk", x[start], queries), -np.inf)
    by = np.argsort(-first, axis=1, kind="stable")[:, :beam]
    start, first = np.take_along_axis(start, by, axis=1), np.take_along_axis(first, by, axis=1)
    m = start.shape[1]
    found, value = np.full((q, beam), -1, np.int64), np.full((q, beam), -np.inf)
    found[:, :m], value[:, :m] = start, first
    fresh, seen = found >= 0, np.zeros((q, len(x)), bool)
    r, c = np.nonzero(found >= 0)
    seen[r, found[r, c]] = True
    live = every
    while len(live):
        rank = np.where(fresh[live], value[live], -np.inf)
        pick = np.argpartition(-rank, expand - 1, axis=1)[:, :expand]
        r = np.arange(len(live))[:, None]
        use = np.take_along_axis(rank, pick, axis=1) > -np.inf
        fresh[live[:, None], pick] = False
        nodes = np.where(use, found[live[:, None], pick], 0)
        near = np.where(use[:, :, None], links[nodes], -1).reshape(len(live), -1).astype(np.int64)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near >= 0) & seen[live[:, None], near]] = -1
        a, b = np.nonzero(near >= 0)
        seen[live[a], near[a, b]] = True
        s = np.full(near.shape, -np.inf)
        s[a, b] = np.einsum("ed,ed->e", x[near[a, b]], queries[live[a]])
        all_v, all_n = np.c_[value[live], s], np.c_[found[live], near]
        all_f = np.c_[fresh[live], near >= 0]
        keep = np.argpartition(-all_v, beam - 1, axis=1)[:, :beam]
        value[live], found[live], fresh[live] = all_v[r, keep], all_n[r, keep], all_f[r, keep]
        live = live[(fresh[live] & (value[live] > -np.inf)).any(axis=1)]
    by = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(found, by, axis=1), np.take_along_axis(value, by, axis=1)


def products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, whatever the number of rows."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * query[k]
    return total


def hits(index: dict, query_ids: np.ndarray, queries: np.ndarray, top: int, beam: int | None) -> pd.DataFrame:
    """The shard's ``top`` rows of each query, its own row left out."""
    x = np.frombuffer(index["vectors"]).reshape(-1, index["dim"])
    ids, id_from = np.frombuffer(index["ids"], np.int64), np.frombuffer(index["id_from"], np.int64)
    block = max(1, min(QUERY_ROWS, VISITS // len(x)))
    beam = min(max(beam or index["beam"], top + 1), len(x))
    found = np.concatenate([search(index, queries[lo : lo + block], beam) for lo in range(0, len(queries), block)])
    out = []
    for k, nodes in enumerate(found):
        nodes = nodes[nodes >= 0]
        score = products(x[nodes], queries[k])
        got = [(s, i) for s, node in zip(score, nodes, strict=True) for i in ids[id_from[node] : min(id_from[node + 1], id_from[node] + top + 1)] if i != query_ids[k]]
        out += [(query_ids[k], i, s) for s, i in sorted(got, key=lambda t: (-t[0], t[1]))[:top]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def index(rows: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """The written index of all rows ``(id, v)``: one row for each shard."""
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    room = shard_rows or max(LEAST_ROWS, min(MOST_ROWS, ROOT * math.isqrt(sizes["n"] if sizes else 0)))
    dim, shards = (sizes["d"], -(-sizes["n"] // room)) if sizes else (0, 1)

    def built(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"shard": key[0]} | build(part.id.to_numpy(), np.stack(part.v.to_numpy()), SEED + key[0])])

    dealt = rows.where(F.size("v") == dim).withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("shard").applyInPandas(built, INDEX), "index")


def nearest(built: DataFrame, queries: DataFrame, top: int, beam: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of all queries ``(id, v)`` against all rows of the index. Each shard's index is sent once for each of
    its parts, of which there are only as many as keep all tasks busy, and the queries stream behind it."""
    spark = built.sparkSession
    last = built.agg(F.max("shard")).first()[0] or 0
    parts = max(1, -(-tasks(spark) // (last + 1)))
    every = F.explode(F.sequence(F.lit(0), F.lit(last)))
    indexes = built.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("kind", F.lit(0))
    asked = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), every.alias("shard"))
    rows = indexes.unionByName(asked, allowMissingColumns=True).repartition((last + 1) * parts, "shard", "part").sortWithinPartitions("shard", "part", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, waiting = None, []

        def flush() -> Iterator[pd.DataFrame]:
            own = [w for w in waiting if len(w[1]) == index["dim"]]
            waiting.clear()
            if own:
                yield hits(index, np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.float64), top, beam)

        for batch in batches:
            asked = batch["kind"].to_numpy() > 0
            for k in range(len(batch)):
                if not asked[k]:
                    yield from flush()
                    index = batch.iloc[k].to_dict()
                    index |= {c: int(index[c]) for c in ("shard", "dim", "beam")}
                elif index and index["shard"] == batch["shard"].iat[k]:  # a shard may have got no rows
                    waiting.append((batch["id"].iat[k], batch["v"].iat[k]))
                    if len(waiting) >= QUERY_ROWS:
                        yield from flush()
        yield from flush()

    each = rows.mapInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
