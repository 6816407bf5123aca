"""Conversation structure repair: cheapest edits by the auction algorithm for shortest paths.

Turns are a lattice: a node is a number of turns read and the state of the grammar ``(s?(ua)+)?`` of role initials; its arcs
are the edits Delete, Insert, Keep and Rerole with integer costs. The auction keeps a price for each node and one path:
the path's last node is extended along its best arc if its price allows, else its price is raised to the best arc's value and
the path contracts by one. When the path arrives, every arc's cost covers the difference of its ends' prices, and all shortest paths
consist of arcs that are tight; of these the trace takes the least letter from which tight arcs still lead to the end.

A lattice is solved in blocks of BLOCK turns, from the end: the converged prices at the start of a block are the arrival costs of the
block before. Conversations of up to SEGMENT turns are one row each. Longer ones are cut into segments, which many tasks
solve: each gives its costs between all entry and exit states, a tree of bounded fan-in turns these into exit prices, and
then the segments' traces into entry states. Texts stay in the JVM but for digests of such long ones, which are read as a stream.

Defined results: a null in role or text counts as one space, an empty text is blank; null turns sort first; turns of
one number sort by role and text; repeated rows are turns of their own, the later ones duplicates; a null conversation id is a
conversation; very long texts are judged whole; an empty table gives no rows; extra columns don't pass. One row holds a
conversation's edits, so its turns must fit in 2**31.
"""

from __future__ import annotations

from functools import lru_cache, partial
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import lag, row_number, scan
from ..sources.shared import small_or_merged
from .common import streamed_sha, written

SEGMENT, BLOCK, FAN = 256, 32, 4096
# Costs of edits; states of the grammar: nothing, system, user, assistant.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
STATES, NEXT, TERMINAL, ROLE = 4, (2, 2, 3, 2), (0, 10, 5, 0), ("user", "user", "assistant", "user")
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LEGAL = ("s|u", "u|a", "a|u")
FAR = 1 << 40
SPACES, STOPS = " \t\n\x0b\x0c\r", (".", "!", "?")


def arcs_of(code: str) -> list[list[tuple[str, int, int, int]]]:
    """The arcs of a turn's layer from each state: letter, cost, turns read, next state. ``code``: the role's initial or x,
    upper case if truncated; d: to be deleted."""
    out = []
    for q in range(STATES):
        more = TRUNCATED if code.isupper() else 0
        arcs = [("D", DELETE, 1, q), ("I", INSERT, 0, NEXT[q])]
        if code != "d":
            kept = KEPT.get(code.lower(), {}).get(q)
            arcs += [("K", more, 1, kept)] if kept is not None else []
            arcs.append(("R", REROLE + more, 1, NEXT[q]))
        out.append(arcs)
    return out


ARCS = {c: arcs_of(c) for c in "suaxSUAXd"}


class Block:
    """One block's lattice. Node ``4 * turns read + state``; the end node has number ``end``."""

    def __init__(self, codes: str, arrival: tuple[int, ...]) -> None:
        n = len(codes)
        self.end, self.arrival = STATES * (n + 1), arrival
        layers = [ARCS[c] for c in codes]
        self.out = [[(letter, cost, STATES * (i + step) + to) for letter, cost, step, to in arcs] for i, layer in enumerate(layers) for arcs in layer]
        self.out += [[("", cost, self.end)] if cost < FAR else [] for cost in arrival]
        self.price = [min(arrival)] * self.end + [0]

    def auction(self, origin: int) -> int:
        """The cost from ``origin`` to the end. Prices stay feasible, so later origins go on from them."""
        price, out, end, path = self.price, self.out, self.end, [origin]
        while path[-1] != end:
            node, best, at = path[-1], FAR, -1
            for _, cost, to in out[node]:
                if cost + price[to] < best:
                    best, at = cost + price[to], to
            if price[node] < best:
                price[node] = best  # contraction
                if len(path) > 1:
                    path.pop()
                elif best >= FAR:
                    return FAR
            else:
                path.append(at)  # extension
        return price[origin]

    def traced(self, origin: int) -> list[tuple[str, int, int]]:
        """The least letters over tight arcs: letter, node before, node after."""
        price, ends = self.price, [False] * self.end + [True]
        tight = [[(letter, to) for letter, cost, to in arcs if price[node] == cost + price[to] and price[node] < FAR] for node, arcs in enumerate(self.out)]
        for layer in range(self.end // STATES - 1, -1, -1):
            own = range(STATES * layer, STATES * (layer + 1))
            for _ in range(STATES):  # insertions stay in the layer
                for node in own:
                    ends[node] = ends[node] or any(ends[to] for _, to in tight[node])
        node, steps = origin, []
        while True:
            letter, to = min((x for x in tight[node] if ends[x[1]]), key=lambda x: x[0])
            if to == self.end:
                return steps
            steps.append((letter, node, to))
            node = to


def solved(codes: str, arrival: tuple[int, ...], entries: tuple[int, ...] = tuple(range(STATES))) -> tuple[list[Block], list[int]]:
    """The blocks of a run of turns with converged prices, and the costs from each entry state."""
    blocks: list[Block] = []
    for lo in range((max(len(codes), 1) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        block = Block(codes[lo : lo + BLOCK], arrival)
        first = entries if lo == 0 else range(STATES)
        arrival = tuple(block.auction(q) if q in first else FAR for q in range(STATES))
        blocks.append(block)
    return blocks[::-1], list(arrival)


@lru_cache(65_536)
def edits(codes: str, arrival: tuple[int, ...], entry: int, last: bool) -> tuple[int, str, list[int], list[str | None], int]:
    """Cost to the end, letters, kept rows (-1: inserted), their new roles (None: as it was), exit state."""
    blocks, cost = solved(codes, arrival, (entry,))
    letters, rows, roles, q, base = [], [], [], entry, 0
    for block in blocks:
        for letter, node, to in block.traced(q):
            letters.append(letter)
            if letter != "D":
                rows.append(-1 if letter == "I" else base + node // STATES)
                roles.append(None if letter == "K" else ROLE[node % STATES])
            q = to % STATES
        base += BLOCK
    while last and q in (1, 2):
        letters.append("I")
        rows.append(-1)
        roles.append(ROLE[q])
        q = NEXT[q]
    return cost[entry], "".join(letters), rows, roles, q


def between(codes: str) -> list[int]:
    """Costs from each entry state to each exit state, row by row. Nothing leads back to the first two states."""
    n, out = len(codes), [[FAR] * STATES for _ in range(STATES)]
    out[0][0] = out[1][1] = DELETE * n
    if "s" in codes or "S" in codes:
        out[0][1] = DELETE * (n - 1) + (0 if "s" in codes else TRUNCATED)
    for b in (2, 3):
        for a, cost in enumerate(solved(codes, tuple(0 if q == b else FAR for q in range(STATES)))[1]):
            out[a][b] = cost
    return [x for row in out for x in row]


def judged(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone: Column) -> DataFrame:
    """Turns under a key for their conversation, with nulls as one space."""
    own = {c: F.coalesce(F.col(col).cast("string"), F.lit(" ")) for c, col in (("role", role_col), ("text", text_col))}
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    return turns.select(key.alias("key"), F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), *(v.alias(c) for c, v in own.items()), gone.alias("gone"))


def digest() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))


def segments(turns: DataFrame) -> tuple[DataFrame, bool]:
    """One row for each run of up to SEGMENT turns: ``key, seg, conv`` and ``x``, its turns in order. A row without a turn
    (``gone``) only names its conversation. Says whether any conversation has several."""
    there = turns.withColumn("x", F.when(~F.col("gone"), F.struct("turn", "role", "text", digest().alias("digest"))))
    sizes = there.groupBy("key").agg(F.count("x").alias("n")).where(F.col("n") > SEGMENT).select("key")
    long = written(sizes, "long-conversations")
    grouped = F.array_sort(F.collect_list("x")).alias("x")
    if not long.take(1):
        return there.groupBy("key").agg(F.lit(0).cast("long").alias("seg"), F.min("conv").alias("conv"), grouped).withColumn("seen", F.lit(None).cast("array<boolean>")), False
    hint = small_or_merged(long)
    short = there.join(hint, "key", "left_anti").groupBy("key").agg(F.lit(0).cast("long").alias("seg"), F.min("conv").alias("conv"), grouped).withColumn("seen", F.lit(None).cast("array<boolean>"))
    own = scan(turns.where("NOT gone").join(hint, "key", "left_semi").select("key", "conv", "turn", "role", "text"), ["key"], ["turn", "role", "text"], {"pos": row_number()}).withColumn("digest", digest())
    first = own.groupBy("key", "digest").agg(F.min("pos").alias("first"))
    met = own.join(first.hint("merge"), ["key", "digest"])
    x = F.struct("pos", F.struct("turn", "role", "text", "digest").alias("t"), (F.col("pos") > F.col("first")).alias("seen"))
    cut = met.groupBy("key", F.floor((F.col("pos") - 1) / SEGMENT).alias("seg")).agg(F.min("conv").alias("conv"), F.array_sort(F.collect_list(x)).alias("y"))
    return short.unionByName(cut.select("key", "seg", "conv", F.col("y.t").alias("x"), F.col("y.seen").alias("seen"))), True


def coded(segs: DataFrame) -> DataFrame:
    """Segments with their faults, ``codes`` for the lattice, and what the borders between segments need."""
    digests = F.col("x.digest")
    seen = F.coalesce("seen", F.transform("x", lambda t, i: F.array_position(digests, t.digest) <= i))
    bare = F.transform("x", lambda t: F.right(F.rtrim(t.text, F.lit(SPACES)), F.lit(1)))
    blank, cut = F.transform(bare, lambda c: c == ""), F.transform(bare, lambda c: ~c.isin(*STOPS))
    fault = F.zip_with(F.zip_with(blank, seen, lambda b, s: F.when(b, "b").when(s, "d")), cut, lambda f, c: F.when(f.isNotNull(), f).when(c, "t").otherwise(""))
    initials = F.transform("x", lambda t: F.substring(t.role, 1, 1))
    known = F.transform("initials", lambda i: F.when(i.isin("s", "u", "a"), i).otherwise("x"))
    code = F.zip_with("faults", known, lambda f, i: F.when(f.isin("b", "d"), "d").when(f == "t", F.upper(i)).otherwise(i))
    d = segs.withColumns({"faults": fault, "initials": initials})
    pairs = F.zip_with("initials", F.slice("initials", 2, F.size("initials")), lambda a, b: F.concat(a, F.lit("|"), b))
    known_turns = F.filter(F.transform("x", lambda t: t.turn), lambda t: t.isNotNull())
    counts = {name: F.size(F.filter("faults", partial(eq, F.lit(c)))).cast("long") for name, c in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))}
    inside = F.size(F.filter(pairs, lambda p: p.isNotNull() & ~p.isin(*LEGAL))).cast("long")
    d = d.withColumns({"codes": F.array_join(code, ""), "turns": known_turns, "illegal": inside} | counts)
    return d.withColumns({"n_turns": F.size(F.array_distinct("turns")).cast("long"), "first_turn": F.array_min("turns"), "last_turn": F.array_max("turns"), "first_initial": F.get("initials", F.lit(0)), "last_initial": F.get("initials", F.size("initials") - 1)})


@F.pandas_udf(T.ArrayType(T.LongType()))
def matrices(codes: pd.Series) -> pd.Series:
    return codes.map(between)


@F.pandas_udf(T.ArrayType(T.LongType()))
def exits_of(codes: pd.Series, arrival: pd.Series) -> pd.Series:
    """The exit state for each entry state."""
    return pd.Series([[edits(c, tuple(map(int, a)), q, False)[4] for q in range(STATES)] for c, a in zip(codes, arrival, strict=True)])


EDITS = T.StructType([T.StructField("cost", T.LongType()), T.StructField("letters", T.StringType()), T.StructField("rows", T.ArrayType(T.IntegerType())), T.StructField("roles", T.ArrayType(T.StringType()))])


@F.pandas_udf(EDITS)
def edited(codes: pd.Series, arrival: pd.Series, entry: pd.Series, last: pd.Series) -> pd.DataFrame:
    found = [edits(c, tuple(map(int, a)), int(q), bool(z))[:4] for c, a, q, z in zip(codes, arrival, entry, last, strict=True)]
    return pd.DataFrame(found, columns=["cost", "letters", "rows", "roles"])


def combined(pieces: DataFrame, join, spread, top: list[int]) -> DataFrame:
    """A scan over each key's pieces ``(key, at, v)`` by a tree of fan-in FAN: ``join`` folds the values of neighbours into one,
    ``spread`` deals what a parent got (``top`` at the root) to its children. Gives ``key, at, got``."""

    def up(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        return pd.DataFrame([{"key": key[0], "at": key[1], "v": join(list(part.v))}])

    def down(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        return pd.DataFrame({"key": part.key, "at": part["at"], "got": spread(list(part.v), list(part.got.iloc[0]))})

    levels = [pieces]
    while levels[-1].agg(F.max("at")).first()[0]:
        parents = levels[-1].withColumn("to", F.floor(F.col("at") / FAN)).groupBy("key", "to").applyInPandas(up, "key string, at long, v array<long>")
        levels.append(written(parents, "tree"))
    got = levels.pop().select("key", "at", F.array(*(F.lit(v).cast("long") for v in top)).alias("got"))
    for level in reversed(levels):
        met = level.withColumn("to", F.floor(F.col("at") / FAN)).join(got.withColumnRenamed("at", "to").hint("merge"), ["key", "to"])
        got = written(met.groupBy("key", "to").applyInPandas(down, "key string, at long, got array<long>"), "tree")
    return got


def _times(ms: list) -> list[int]:
    total = np.array(ms[0]).reshape(STATES, STATES)
    for m in ms[1:]:
        total = np.minimum((total[:, :, None] + np.array(m).reshape(STATES, STATES)[None]).min(axis=1), FAR)
    return total.ravel().tolist()


def _arrivals(ms: list, at_end) -> list[list[int]]:
    out, now = [], np.array(at_end)
    for m in reversed(ms):
        out.append(now.tolist())
        now = np.minimum((np.array(m).reshape(STATES, STATES) + now[None]).min(axis=1), FAR)
    return out[::-1]


def _through(maps: list) -> list[int]:
    at = list(range(STATES))
    for m in maps:
        at = [int(m[q]) for q in at]
    return at


def _entries(maps: list, entry) -> list[list[int]]:
    out, q = [], int(entry[0])
    for m in maps:
        out.append([q])
        q = int(m[q])
    return out


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> tuple[DataFrame, bool]:
    """Segments with their edits: ``key, seg, conv``, faults, ``cost`` from here to the conversation's end, ``letters``, ``out``
    (the repaired turns: role, text) and whether the segment is ``lone``; and whether any isn't. Rows that are ``gone`` take no part, but their
    conversations do."""
    segs, several = segments(judged(turns, conv_col, turn_col, role_col, text_col, F.lit(False) if gone is None else gone))
    segs = coded(segs)
    end = F.array(*(F.lit(v).cast("long") for v in TERMINAL))
    if several:
        segs = written(segs, "segments")
        last = segs.groupBy("key").agg(F.max("seg").alias("last")).where("last > 0")
        cut = segs.join(last.hint("merge"), "key")
        arrival = combined(written(cut.select("key", F.col("seg").alias("at"), matrices("codes").alias("v")), "costs"), _times, _arrivals, list(TERMINAL)).withColumnsRenamed({"at": "seg", "got": "arrival"})
        ended = written(cut.select("key", "seg", "codes").join(arrival.hint("merge"), ["key", "seg"]).withColumn("exits", exits_of("codes", "arrival")), "exits")
        entry = combined(ended.select("key", F.col("seg").alias("at"), F.col("exits").alias("v")), _through, _entries, [0]).select("key", F.col("at").alias("seg"), F.get("got", F.lit(0)).alias("entry"))
        borders = entry.join(ended.select("key", "seg", "arrival").hint("merge"), ["key", "seg"]).join(last.hint("merge"), "key")
        segs = segs.join(borders.hint("merge"), ["key", "seg"], "left").withColumns({"arrival": F.coalesce("arrival", end), "entry": F.coalesce("entry", F.lit(0)), "ends": F.coalesce(F.col("last") == F.col("seg"), F.lit(True))}).drop("last")
    else:
        segs = segs.withColumns({"arrival": end, "entry": F.lit(0).cast("long"), "ends": F.lit(True)})
    done = segs.withColumn("e", edited("codes", "arrival", "entry", "ends"))
    turn = F.zip_with("e.rows", "e.roles", lambda r, role: F.struct(F.coalesce(role, F.get(F.col("x"), r).role).alias("role"), F.when(r >= 0, F.get(F.col("x"), r).text).otherwise("").alias("text")))
    return done.select("key", "seg", "conv", "blank", "duplicate", "truncated", "illegal", "n_turns", "first_turn", "last_turn", "first_initial", "last_initial", "e.cost", "e.letters", turn.alias("out"), (F.col("ends") & (F.col("seg") == 0)).alias("lone")), several


def summary(segs: DataFrame, several: bool) -> DataFrame:
    """One row for each conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    part = F.when(F.size("out") > 0, F.array_join(F.transform("out", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n"))
    faults = ["blank", "duplicate", "truncated", "illegal", "n_turns"]
    columns = ["conv", *faults, "first_turn", "last_turn", "cost", "letters", "repaired_sha256"]
    own = written(segs, "repaired") if several else segs
    out = own.where("lone").withColumn("repaired_sha256", F.sha2(F.coalesce(part, F.lit("")).cast("binary"), 256)).select(*columns)
    if several:
        cut = own.where("NOT lone")
        before = scan(cut.drop("out"), ["key"], ["seg"], {"b_turn": lag("last_turn"), "b_initial": lag("last_initial")})
        border, pair = F.col("seg") > 0, F.concat("b_initial", F.lit("|"), "first_initial")
        met = before.withColumns({"illegal": F.col("illegal") + F.when(border & ~pair.isin(*LEGAL), 1).otherwise(0), "n_turns": F.col("n_turns") - F.when(border & (F.col("b_turn") == F.col("first_turn")), 1).otherwise(0)})
        letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "letters"))), lambda s: s.letters), "")
        whole = met.groupBy("key").agg(F.min("conv").alias("conv"), *(F.sum(c).alias(c) for c in faults), F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), F.min_by("cost", "seg").alias("cost"), letters.alias("letters"))
        hashed = streamed_sha(cut.select("key", "seg", part.alias("part")), "\n").withColumnRenamed("sha", "repaired_sha256")
        out = out.unionByName(whole.join(hashed.hint("merge"), "key").select(*columns))
    gaps = F.coalesce((F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns")).cast("long"), F.lit(0).cast("long"))
    return out.select("conv", gaps.alias("gaps"), *faults[:4], "cost", F.col("letters").alias("audit"), "repaired_sha256")
