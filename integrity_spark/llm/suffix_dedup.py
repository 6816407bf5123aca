"""Exact substring deduplication by merging shard Burrows-Wheeler transforms.

A byte goes if it is covered by a ``LENGTH``-byte string that also starts in a document with a smaller id.

1. Documents are dealt by ranges of (hash of their first characters, id), so that copies, exact or near, mostly meet in
   one shard while a text that a third of all rows hold is still spread; they are gathered in shards of a few MB, written
   in buckets, so that later joins move no text.
2. Anchors: each LENGTH-byte window has the smallest hash of its GRAM-byte strings as its anchor, so equal windows have
   equal anchors. Shards send their distinct anchors, by hash part, and get back a code for each: whether another shard
   has it, and among how many sub-parts the windows of a very common one are dealt. Anchors only thin the candidates.
3. The stretches of windows with one anchor are the segments. Segments of a shard with equal bytes collapse to the one
   with the smallest id. The shard sorts the suffixes of the rest, which gives their Burrows-Wheeler transform (BWT) and,
   where ranks of neighbours agree over LENGTH bytes, the repeated intervals inside the shard. Segments that a smaller
   id holds whole go no further; those whose anchor another shard has are sent as BWTs, one for each hash part.
4. A part is dealt to fine parts by anchor, which are small enough for a processor's cache and cost no row of their own.
   In each, the BWTs of the shards are merged by iterative interleave refinement: each round re-deals the interleave
   stably by the two preceding characters and follows the last-to-first map, after which it is sorted by two more
   characters. No suffix of the union is compared or sorted again. Rows that stand alone in their block have their common
   prefix with both neighbours and need no more rounds; blocks left after LENGTH characters are the repeated intervals,
   and all their windows but those of the smallest id are marked.
5. All shards' transforms of a part are merged by one task, unless they are more than NODE_BYTES. Then the part is merged as
   a tree: as many groups of shards as keep to that, then the transforms that are left of FAN_IN such groups, and so on.
   A fine part of more than MERGED_BYTES is merged so inside a task. A segment that is marked whole drops out (a transform
   without it is the same transform less its rows), so a passage that all shards hold is passed on once a group.
6. The marks go back to the shards, are united to spans, and cut out.

Defined results: null text is empty; texts shorter than LENGTH keep all bytes; rows with one id, and repeats inside one
document, don't remove each other; a null id removes nothing and loses nothing; a very long text is a shard of its own,
hashed and sorted in pieces; an empty table gives no rows; extra columns, whatever their names, don't pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, tasks, text_bytes, written

LENGTH, GRAM = 50, 20
#: Bytes of text in a shard, about (a longer document is a shard of its own); bytes of text in a hash part and in a fine
#: part of it, about. A shard sends one row to each part, so their product is what grows with the square of the text.
SHARD_BYTES, PART_BYTES, FINE_BYTES = 3_000_000, 32_000_000, 500_000
#: Parts that there are at least, if there are as many tasks.
LEAST_PARTS = 256
#: Windows that are hashed at once; windows of a segment at most; bytes of segments that a shard sorts at once, about.
CHUNK, WIDEST, SORTED = 100_000, 64, 150_000
#: Bytes of transforms that a task has of a part, and that it merges at once, about.
NODE_BYTES, MERGED_BYTES = 48_000_000, 6_000_000
#: Groups of shards whose rest a task merges; shards with one anchor from which on its windows are dealt to sub-parts.
FAN_IN, HOT = 48, 4096
#: Characters by which copies find their shard; they decide nothing.
PREFIX = 32
#: Bytes of an anchor that are sent; a chance match merely sends a segment more.
ANCHOR_BYTES = 5
SHARD = "shard long, ids binary, known binary, sizes binary, text binary"
SENT = "shard long, follow binary, lo binary, width binary, runs binary, parts array<struct<part:long,size:long,fine:binary,sizes:binary,bwt:binary,first:binary,ids:binary>>"
MERGED = "part long, shard long, fine binary, sizes binary, bwt binary, first binary, ids binary, runs binary"
_BASE = 0x9E3779B97F4A7C15
_MOST = np.iinfo(np.int64).max


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of all GRAM-byte (16 + 4) strings."""
    power = {k: np.uint64(pow(_BASE, k, 2**64)) for k in (1, 2, 4, 8)}
    h = b.astype(np.uint64) + np.uint64(1)
    four = h
    for k in (1, 2, 4, 8):
        h = h[:-k] * power[k] + h[k:]
        if k == 2:
            four = h
    x = h[: len(h) - 4] * power[4] + four[16:]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def stretches(b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at most WIDEST windows of one document with one anchor: first window, last + 1, anchor, document. CHUNK
    windows are hashed at a time, as the hashes need many times the room of the text."""
    ends, doc = np.cumsum(sizes), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    found = []
    for begin in range(0, max(0, len(b) - LENGTH + 1), CHUNK):
        m, width, span = gram_hashes(b[begin : begin + CHUNK + LENGTH - 1]), 1, LENGTH - GRAM + 1
        while 2 * width <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
        d = doc[begin : begin + len(m)]
        inside = np.arange(begin + LENGTH, begin + LENGTH + len(m)) <= ends[d]
        change = (m[1:] != m[:-1]) | (d[1:] != d[:-1])
        lo = np.flatnonzero(np.r_[True, change | ~inside[:-1]] & inside)
        hi = np.flatnonzero(np.r_[change | ~inside[1:], True] & inside) + 1
        found.append((lo + begin, hi + begin, m[lo], d[lo]))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none
    lo, hi, anchor, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    return _parted(lo, hi, np.full(len(lo), WIDEST), anchor, owner)


def _parted(lo: np.ndarray, hi: np.ndarray, most: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs cut to pieces of ``most`` windows each."""
    n = -(-(hi - lo) // most)
    if (n == 1).all():
        return lo, hi, *rest
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(lo, n) + nth * np.repeat(most, n)
    return start, np.minimum(start + np.repeat(most, n), np.repeat(hi, n)), *(np.repeat(x, n) for x in rest)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(8 * ANCHOR_BYTES)) % np.uint64(parts)).astype(np.int64)


def fine_of(hashes: np.ndarray, fines: int) -> np.ndarray:
    return ((hashes & np.uint64((1 << 8 * ANCHOR_BYTES) - 1)) % np.uint64(fines)).astype(np.int64)


def runs_of(at: np.ndarray) -> bytes:
    """Sorted distinct numbers as runs (first, last + 1)."""
    if not len(at):
        return b""
    new = np.flatnonzero(np.diff(at) != 1)
    return np.c_[at[np.r_[0, new + 1]], at[np.r_[new, len(at) - 1]] + 1].astype(np.int64).tobytes()


def sorted_suffixes(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For segments with an end mark each, 0 under all characters: the characters + 1, the order of all suffixes (of equal
    ones, by segment), and ranks by which any two windows agree on 32 bytes."""
    k, n = len(sizes), len(text) + len(sizes)
    ends = np.cumsum(sizes + 1)
    segment = np.repeat(np.arange(k, dtype=np.int32), sizes + 1)
    chars = np.zeros(n + 8, np.uint8)
    body = np.ones(n, bool)
    body[ends - 1] = False
    chars[:n][body] = text + 1
    left = np.repeat(ends, sizes + 1) - np.arange(n)
    key = chars.astype(np.uint64)
    for w in (1, 2, 4):
        key = key[:-w] << np.uint64(8 * w) | key[w:]
    key = key[:n]
    short = np.flatnonzero(left < 8)
    key[short] &= ~((np.uint64(1) << (8 * (8 - left[short])).astype(np.uint64)) - np.uint64(1))
    order = np.argsort(key)
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    del key
    starts = np.flatnonzero(first)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    width, at_32 = 8, None
    while True:
        if width == 32:
            at_32 = rank.copy()
        single = np.r_[first[1:], True] & first
        slots = np.flatnonzero(~single)
        if not len(slots):
            return chars[:n], order, rank if at_32 is None else at_32
        s = order[slots]
        second = np.where(left[s] > width, rank[np.minimum(s + width, n - 1)] + np.int64(k), segment[s])
        by = np.argsort(rank[s].astype(np.int64) << 32 | second)
        s, second = s[by], second[by]
        order[slots] = s
        new = first[slots] | np.r_[True, second[1:] != second[:-1]]
        at = slots[new]
        first[at] = True
        rank[s] = np.repeat(at, np.diff(np.r_[np.flatnonzero(new), len(new)]))
        width *= 2


def own_transform(text: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's segments: the characters before the sorted suffixes, the segment of each of these, and whether each
    window (in order of the segments) also is in a segment with a smaller id."""
    chars, order, rank = sorted_suffixes(text, sizes)
    n, ends = len(order), np.cumsum(sizes + 1)
    segment = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    window = np.repeat(ends, sizes + 1) - np.arange(n) > LENGTH
    rows = order[window[order]]
    marked = np.zeros(n, bool)
    if len(rows):
        a, b = rank[rows], rank[rows + LENGTH - 32]
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        own = ids[segment[rows]]
        marked[rows] = own > np.repeat(np.minimum.reduceat(own, start), np.diff(np.r_[start, len(rows)]))
    before = chars[order - 1]
    before[np.isin(order, ends - sizes - 1)] = 0
    return before, segment[order], marked[window]


def interleaved(bwt: np.ndarray, sizes: np.ndarray, first: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transforms of several sources, one behind another, and for their segments in turn the number of the first window
    and the id: numbers of the windows that also are in a segment with a smaller id, the segment of each, and the rows and
    segments that aren't marked whole."""
    n, base = len(bwt), np.cumsum(sizes) - sizes
    source = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) < 1 << 16 else np.uint32), sizes)
    counts = np.bincount(source[bwt == 0], minlength=len(sizes))
    by = np.argsort(bwt, kind="stable")
    if len(sizes) > 1:
        by = by[np.argsort(source[by], kind="stable")]
    to_first = np.empty(n, np.int32)
    to_first[by] = np.arange(n, dtype=np.int32)
    del by, source
    # Where each row stands: its segment and how far from the end, by following the map from the end marks.
    segment, far = np.empty(n, np.int32), np.empty(n, np.int32)
    own = np.arange(counts.sum(), dtype=np.int32)
    row, size = own + np.repeat(base - (np.cumsum(counts) - counts), counts), np.empty(len(own), np.int64)
    step = 0
    while len(row):
        segment[row], far[row] = own, step
        more = bwt[row] != 0
        size[own[~more]] = step
        row, own = to_first[row[more]], own[more]
        step += 1
    two = bwt[to_first].astype(np.uint16) << np.uint16(8) | bwt
    two[(bwt == 0) | (two < 256)] = 0
    back = to_first[to_first].astype(np.int64)
    live, block = np.arange(n), np.zeros(n, np.int32)
    for _ in range(LENGTH // 2):
        c = two.take(live)
        by = np.argsort(c, kind="stable")
        by = by[len(c) - np.count_nonzero(c) :]
        c, b = c.take(by), block.take(by)
        new = np.ones(len(c) + 1, bool)
        new[1:-1] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        more = np.flatnonzero(~(new[:-1] & new[1:]))
        live, block = back.take(live.take(by.take(more))), np.cumsum(new[:-1], dtype=np.int32).take(more)
    marked = np.empty(0, np.int64)
    if len(live):
        start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        least = np.repeat(np.minimum.reduceat(ids[segment[live]], start), np.diff(np.r_[start, len(live)]))
        marked = live[ids[segment[live]] > least]
    of = segment[marked]
    whole = np.bincount(of, minlength=len(size)) == size - LENGTH + 1
    return first[of] + size[of] - far[marked], of, ~whole[segment], ~whole


def merged(bwts: list[np.ndarray], first: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """``interleaved`` for a list of sources; of the rows that aren't marked whole, each source's."""
    cuts = np.cumsum([len(b) for b in bwts])
    bwt = np.concatenate(bwts)
    number, segment, rows, kept = interleaved(bwt, np.diff(cuts, prepend=0), first, ids)
    return number, segment, [b[r] for b, r in zip(bwts, np.split(rows, cuts[:-1]), strict=True)], kept


def in_turn(bwt: np.ndarray, sizes: np.ndarray, first: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``interleaved``, but of more than MERGED_BYTES only so many at once, then what is left of these, for as long as that
    gets a quarter less each time; at last all that is left."""
    if len(bwt) <= MERGED_BYTES:
        return interleaved(bwt, sizes, first, ids)
    number, segment, rows, segs, before = [], [], np.arange(len(bwt)), np.arange(len(first)), np.inf
    while True:
        ends = np.cumsum(sizes)
        batch = ends // MERGED_BYTES if 4 * len(rows) < 3 * before else np.zeros(len(sizes), np.int64)
        before = len(rows)
        edge = np.r_[0, np.flatnonzero(np.diff(batch)) + 1, len(sizes)]
        marks = np.r_[0, np.cumsum(bwt[rows] == 0)]
        kept_rows, kept_segs = [], []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            a, z = (ends[lo - 1] if lo else 0), ends[hi - 1]
            own = segs[marks[a] : marks[z]]
            got = interleaved(bwt[rows[a:z]], sizes[lo:hi], first[own], ids[own])
            number.append(got[0])
            segment.append(own[got[1]])
            kept_rows.append(got[2])
            kept_segs.append(got[3])
        kept = np.concatenate(kept_rows)
        sizes = np.diff(np.r_[0, np.cumsum(kept)][ends], prepend=0)
        rows, segs = rows[kept], segs[np.concatenate(kept_segs)]
        if len(edge) == 2:
            break
    kept_rows, kept_segs = np.zeros(len(bwt), bool), np.zeros(len(first), bool)
    kept_rows[rows], kept_segs[segs] = True, True
    return np.concatenate(number), np.concatenate(segment), kept_rows, kept_segs


def _numbers(raw: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(raw, kind)


def _spread(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of those pieces, one after another."""
    ends = np.cumsum(size)
    return text[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def shards_of(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, ids, known, texts, room = TaskContext.get().partitionId() << 32, [], [], [], SHARD_BYTES

        def full() -> pd.DataFrame:
            row = (number, np.array(ids, np.int64).tobytes(), np.array(known, np.uint8).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), b"".join(texts))
            return pd.DataFrame([row], columns=["shard", "ids", "known", "sizes", "text"])

        for batch in batches:
            for key, ok, text in zip(batch.id, batch.known, batch.text, strict=True):
                ids.append(key)
                known.append(ok)
                texts.append(bytes(text))
                room -= len(text)
                if room <= 0:
                    yield full()
                    number, ids, known, texts, room = number + 1, [], [], [], SHARD_BYTES
        if ids:
            yield full()

    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(key, F.lit(0)).alias("id"), key.isNotNull().alias("known"), text.cast("binary").alias("text"), F.xxhash64(F.left(text, F.lit(PREFIX))).alias("near"))
    near = rows.repartitionByRange(max(tasks(docs.sparkSession), size // (4 * SHARD_BYTES)), "near", "id").sortWithinPartitions("near", "id")
    return bucketed(near.select("id", "known", "text").mapInPandas(gather, SHARD), "shards", "shard")


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that are sorted by ``keys``."""
    rest = None
    for batch in batches:
        both = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = (both[keys] == both[keys].iloc[-1]).all(axis=1)
        for _, g in both[~last].groupby(keys, sort=False):
            yield g
        rest = both[last]
    if rest is not None and len(rest):
        yield rest


def shared_anchors(shards: DataFrame, parts: int) -> DataFrame:
    """For each shard and part, a byte for each of the shard's sorted distinct anchors: 0 if no other shard has it, else 1
    and the power of two of sub-parts for its windows."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, sizes, text in zip(batch.shard, batch.sizes, batch.text, strict=True):
                found = np.unique(stretches(_numbers(text, np.uint8), _numbers(sizes))[2])
                part = part_of(found, parts)
                by = np.argsort(part, kind="stable")
                low = found[by].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ANCHOR_BYTES]
                own, at = np.unique(part[by], return_index=True)
                yield pd.DataFrame({"part": own, "shard": shard, "hashes": [x.tobytes() for x in np.split(low, at[1:])][: len(own)]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _grouped(batches, ["part"]):
            per = [len(h) // ANCHOR_BYTES for h in g.hashes]
            wide = np.zeros((sum(per), 8), np.uint8)
            wide[:, :ANCHOR_BYTES] = np.frombuffer(b"".join(g.hashes), np.uint8).reshape(-1, ANCHOR_BYTES)
            by = np.argsort(values := wide.view("<u8").ravel())
            start = np.flatnonzero(np.r_[True, values[by[1:]] != values[by[:-1]]])
            n = np.diff(np.r_[start, len(values)])
            code = np.empty(len(values), np.uint8)
            code[by] = np.repeat(np.where(n > 1, 1 + np.ceil(np.log2(np.maximum(n / HOT, 1))), 0).astype(np.uint8), n)
            yield pd.DataFrame({"shard": g.shard, "part": g.part, "codes": [x.tobytes() for x in np.split(code, np.cumsum(per)[:-1])]})

    sent = shards.select("shard", "sizes", "text").mapInPandas(send, "part long, shard long, hashes binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInPandas(meet, "shard long, part long, codes binary")


def segments(shards: DataFrame, codes: DataFrame, parts: int, fines: int) -> DataFrame:
    """For each shard: its stretches that matter, the class of equal segments that each belongs to (-1: a smaller id of the
    shard holds it), the runs of windows of the classes (numbered in order) that the shard itself marks, and by part the
    transforms of classes that other shards may hold."""

    def sent(row: dict) -> tuple:
        raw, sizes, ids, known = row["text"], _numbers(row["sizes"]), _numbers(row["ids"]), _numbers(row["known"], np.uint8)
        text = _numbers(raw, np.uint8)
        lo, hi, anchor, doc = stretches(text, sizes)
        found, inverse = np.unique(anchor, return_inverse=True)
        part, code = part_of(found, parts), np.zeros(len(found), np.uint8)
        by = np.argsort(part, kind="stable")
        begin = np.searchsorted(part[by], np.arange(parts + 1))
        for b in row["codes"] if row["codes"] is not None else []:
            code[by[begin[b["part"]] : begin[b["part"] + 1]]] = _numbers(b["codes"], np.uint8)
        own, least, most = ids[doc], np.full(len(found), _MOST), np.full(len(found), -_MOST - 1)
        np.minimum.at(least, inverse, own)
        np.maximum.at(most, inverse, own)
        use = np.flatnonzero(((code > 0) | (least < most))[inverse] & known[doc].astype(bool))
        lo, hi, at, own = _parted(lo[use], hi[use], np.where(code[inverse[use]] > 1, 1, WIDEST), inverse[use], own[use])
        classes: dict[bytes, int] = {}
        follow = np.fromiter((classes.setdefault(raw[s:e], len(classes)) for s, e in zip(lo.tolist(), (hi + LENGTH - 1).tolist(), strict=True)), np.int64, len(lo))
        n = len(classes)
        smallest, start, width, of = np.full(n, _MOST), np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        np.minimum.at(smallest, follow, own)
        start[follow], width[follow], of[follow] = lo, hi - lo, at
        several = np.bincount(of, minlength=len(found)) > 1
        where, first = part[of], np.cumsum(width) - width
        for k in np.flatnonzero(code[of] > 1):
            where[k] += parts * (1 + xxhash.xxh3_64_intdigest(raw[start[k] : start[k] + LENGTH]) % (1 << int(code[of[k]] - 1)))
        where = where * fines + fine_of(found, fines)[of]
        sort = np.flatnonzero((code[of] > 0) | several[of])
        sort = sort[np.argsort(where[sort], kind="stable")]
        fill = np.cumsum(width[sort] + LENGTH)
        new = np.r_[True, where[sort][1:] != where[sort][:-1]] if len(sort) else np.empty(0, bool)
        batch = (np.maximum.accumulate(np.where(new, fill, 0)) // SORTED).astype(np.int64)
        runs, goers = [], []
        for own_batch in np.split(sort, np.flatnonzero(np.diff(batch)) + 1) if len(sort) else []:
            size = width[own_batch] + LENGTH - 1
            before, segment, marked = own_transform(_spread(text, start[own_batch], size), size, smallest[own_batch])
            ends = np.cumsum(width[own_batch])
            number = np.repeat(first[own_batch] - (ends - width[own_batch]), width[own_batch]) + np.arange(len(marked))
            runs.append(number[marked])
            whole = np.add.reduceat(marked, ends - width[own_batch]) == width[own_batch]
            goes = (code[of[own_batch]] > 0) & ~whole
            places, nth = np.unique(where[own_batch][goes], return_inverse=True)
            place = np.zeros(len(own_batch), np.uint16 if len(places) < 1 << 16 else np.uint32)
            place[goes] = nth
            by_part = np.flatnonzero(goes[segment])
            own_place = place[segment[by_part]]
            goers.append((places, np.bincount(own_place, minlength=len(places)), np.bincount(nth, minlength=len(places)), before[by_part[np.argsort(own_place, kind="stable")]], own_batch[goes]))
        rows = []
        if goers:
            places, sizes, counts, bwt, kept = (np.concatenate(x) for x in zip(*goers, strict=True))
            edge = np.r_[0, np.flatnonzero(np.diff(places // fines)) + 1, len(places)] if len(places) else np.zeros(1, np.int64)
            to, segs = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(counts)]
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                own_bwt, c = bwt[to[i] : to[j]], kept[segs[i] : segs[j]]
                fine, each = (places[i:j] % fines).astype(np.int32), sizes[i:j].astype(np.int32)
                rows.append({"part": int(places[i] // fines), "size": len(own_bwt), "fine": fine.tobytes(), "sizes": each.tobytes(), "bwt": own_bwt.tobytes(), "first": first[c].tobytes(), "ids": smallest[c].tobytes()})
        run = runs_of(np.sort(np.concatenate([*runs, np.empty(0, np.int64)])))
        return (row["shard"], np.where(own > smallest[follow], -1, follow).astype(np.int32).tobytes(), lo.tobytes(), (hi - lo).astype(np.uint8).tobytes(), run, rows)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield pd.DataFrame([sent(row)], columns=["shard", "follow", "lo", "width", "runs", "parts"])

    back = codes.groupBy("shard").agg(F.collect_list(F.struct("part", "codes")).alias("codes"))
    return bucketed(shards.join(back.hint("merge"), "shard", "left").mapInPandas(send, SENT), "segments", "shard")


def _joined(parts: list[bytes], kind: type = np.int64) -> np.ndarray:
    return _numbers(b"".join(parts), kind)


def met(g: pd.DataFrame, last: bool) -> pd.DataFrame:
    """The transforms of shards for one part, a row for each shard: the runs of windows that it marks, and unless it is the ``last``
    of its part what is left of them."""
    per = np.array([len(x) // 4 for x in g.fine])
    fine, size, source = _joined(g.fine, np.int32), _joined(g.sizes, np.int32).astype(np.int64), np.repeat(np.arange(len(g)), per)
    bwt = _joined(g.bwt, np.uint8)
    at = np.cumsum(size) - size
    begin = np.r_[np.searchsorted(np.flatnonzero(bwt == 0), at), (bwt == 0).sum()]
    count, begin = np.diff(begin), begin[:-1]
    by = np.argsort(fine, kind="stable")
    fine, size, source, count = fine[by], size[by], source[by], count[by]
    bwt, first, ids = _spread(bwt, at[by], size), _spread(_joined(g["first"]), begin[by], count), _spread(_joined(g.ids), begin[by], count)
    to, segs = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(count)]
    owner = np.repeat(np.arange(len(size)), count)
    edge = np.r_[0, np.flatnonzero(np.diff(fine)) + 1, len(fine)]
    number, of, rows, kept = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.ones(len(bwt), bool), np.ones(len(first), bool)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if hi - lo > 1:
            r, c = slice(to[lo], to[hi]), slice(segs[lo], segs[hi])
            n, segment, rows[r], kept[c] = in_turn(bwt[r], size[lo:hi], first[c], ids[c])
            number.append(n)
            of.append(source[owner[c][segment]])
    number, of = np.concatenate(number), np.concatenate(of)
    by = np.lexsort((number, of))
    runs = [runs_of(x) for x in np.split(number[by], np.searchsorted(of[by], np.arange(1, len(g))))]
    out = pd.DataFrame({"part": g.part.to_numpy(), "shard": g.shard.to_numpy(), "runs": runs})
    if last:
        return out[["shard", "runs"]][out.runs != b""]
    size = np.diff(np.r_[0, np.cumsum(rows)][to])
    owner, has = source[owner[kept]], size > 0
    of_row, source = np.repeat(source, np.diff(to))[rows].astype(np.uint16 if len(g) < 1 << 16 else np.uint32), source[has]
    split = lambda x, own: [y.tobytes() for y in np.split(x[np.argsort(own, kind="stable")], np.cumsum(np.bincount(own, minlength=len(g)))[:-1])]
    out = out.assign(fine=split(fine[has], source), sizes=split(size[has].astype(np.int32), source), bwt=split(bwt[rows], of_row), first=split(first[kept], owner), ids=split(ids[kept], owner))
    return out[(out.bwt != b"") | (out.runs != b"")][[c.split()[0] for c in MERGED.split(", ")]]


def marks(sent: DataFrame) -> DataFrame:
    """For each shard, the runs of windows of its classes that a smaller id of another shard holds."""
    rows = sent.select("shard", F.explode("parts").alias("p")).select("p.part", "shard", "p.size", "p.fine", "p.sizes", "p.bwt", "p.first", "p.ids")
    most = rows.groupBy("part").agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] or 0
    nodes, found = max(1, -(-most // NODE_BYTES)), []
    node = F.pmod(F.xxhash64("shard"), F.lit(nodes))
    while True:
        last = nodes == 1

        def meet(batches: Iterator[pd.DataFrame], last: bool = last) -> Iterator[pd.DataFrame]:
            for g in _grouped(batches, ["part", "node"]):
                if len(g) > 1 or not last:
                    yield met(g, last)

        dealt = rows.drop("size").withColumn("node", node).repartition(tasks(sent.sparkSession), "part", "node").sortWithinPartitions("part", "node")
        done = written(dealt.mapInPandas(meet, "shard long, runs binary" if last else MERGED), "merged")
        found.append(done.where("length(runs) > 0").select("shard", "runs"))
        if last:
            break
        rows, nodes, node = done.where("length(bwt) > 0").drop("runs"), -(-nodes // FAN_IN), F.floor(node / FAN_IN)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return written(every.groupBy("shard").agg(F.collect_list("runs").alias("more")), "marks")


def cut(shards: DataFrame, sent: DataFrame, found: DataFrame, id_col: str, with_text: bool) -> DataFrame:
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                text, sizes, ids, known = _numbers(row["text"], np.uint8), _numbers(row["sizes"]), _numbers(row["ids"]), _numbers(row["known"], np.uint8).astype(bool)
                follow, lo, width = _numbers(row["follow"], np.int32), _numbers(row["lo"]), _numbers(row["width"], np.uint8).astype(np.int64)
                mine = follow >= 0
                windows = np.zeros(follow.max(initial=-1) + 1, np.int64)
                windows[follow[mine]] = width[mine]
                first = np.r_[0, np.cumsum(windows)]
                r = _numbers(b"".join([row["runs"], *(row["more"] if row["more"] is not None else [])])).reshape(-1, 2)
                step = np.bincount(r[:, 0], minlength=first[-1] + 1) - np.bincount(r[:, 1], minlength=first[-1] + 1)
                marked = np.cumsum(step[:-1]) > 0
                n_marked = np.r_[0, np.cumsum(marked)]
                share = n_marked[first[1:]] - n_marked[first[:-1]]
                whole, some = ~mine, np.zeros(len(mine), bool)
                whole[mine] = share[follow[mine]] == width[mine]
                some[mine] = share[follow[mine]] > 0
                some &= ~whole
                at = np.repeat(lo[some] - (np.cumsum(width[some]) - width[some]), width[some]) + np.arange(width[some].sum())
                at = at[_spread(marked, first[follow[some]], width[some])]
                step = np.bincount(np.r_[lo[whole], at], minlength=len(text) + 1) - np.bincount(np.r_[(lo + width)[whole], at + 1] + LENGTH - 1, minlength=len(text) + 1)
                gone = np.cumsum(step[:-1]) > 0
                out, begin = [], 0
                for n in sizes.tolist():
                    r, own = gone[begin : begin + n], text[begin : begin + n]
                    kept = (own[~r] if (k := int(r.sum())) else own).tobytes()
                    out.append((n, k, int((r & ~np.r_[False, r[:-1]]).sum()) if k else 0, hashlib.sha256(kept).hexdigest()) + ((kept,) if with_text else ()))
                    begin += n
                result = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)
                result.insert(0, "id", pd.arrays.IntegerArray(ids.copy(), ~known))
                yield result

    met = shards.join(sent.drop("parts").hint("merge"), "shard").join(found.hint("merge"), "shard", "left")
    return met.mapInPandas(apply, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text).withColumnRenamed("id", id_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each document: bytes, bytes removed, removed runs, hash of what is kept, and the kept bytes if
    wanted (a cut can fall inside a character, so they are binary)."""
    size = text_bytes(docs, text_col)
    parts = max(min(tasks(docs.sparkSession), LEAST_PARTS), size // PART_BYTES)
    fines = max(1, size // (parts * FINE_BYTES))
    with shards_of(docs, id_col, text_col, size) as shards, segments(shards, shared_anchors(shards, parts), parts, fines) as sent:
        return written(cut(shards, sent, marks(sent), id_col, with_text), "deduplicated")
