"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns get prefix sums of their tokens, in two levels so that one huge conversation is shared by many tasks: sums of
blocks of turns, then running sums inside a block. A turn's prefix sum divided by the stride is its window,
so windows are runs of whole turns. The stride is the budget less the system turn, the history and the room for one
``longest`` turn; a window passes the budget only by a turn beyond that, and says so. Each later window starts with
the system turn and up to ``history`` tokens of the turns before, which are repeated as context: the loss mask holds
each assistant turn only where it is fresh.

The template is ``<s>[role]`` + newline + text + ``</s>``. Control characters inside roles and texts are
escaped (``\\`` as ``\\e``, ``<`` as ``\\l``, ``[`` as ``\\b``, ``]`` as ``\\r``), so no text can imitate the template, and
``unescaped`` gives back every text.

Defined results: null role or text counts as empty; a null turn sorts first; turns with one number sort by role and
text; repeated rows are turns of their own; a null conv_id is one conversation; an empty table gives no rows; extra
columns don't pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET, HISTORY, LONGEST, LEAST_STRIDE = 1024, 192, 256, 64
#: Tokens of a turn's markers; turns of a block.
MARKERS, BLOCK = 4, 256
# The escapes.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r"))


def escaped(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def opening(role: Column) -> Column:
    return F.concat(F.lit("<s>["), escaped(role), F.lit("]\n"))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")).cast("long") + MARKERS


def numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns with their position, tokens, prefix sum ``ahead`` and the tokens of the conversation's system turn."""
    t = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumns({"tokens": token_count(F.col("text")), "block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62)))})
    system = F.when((F.col("role") == "system"), F.struct(F.col("turn").alias("at"), F.col("tokens").alias("n")))
    blocks = t.groupBy("conv", "block").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("turns"), F.min(system).alias("system"))
    by = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ahead = blocks.select(
        F.col("conv").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("tokens").over(by), F.lit(0)).alias("tokens_ahead"), F.coalesce(F.sum("turns").over(by), F.lit(0)).alias("turns_ahead"), F.min("system").over(W.partitionBy("conv")).alias("system")
    )
    inside = W.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    running = F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")
    own = t.withColumns({"inner": running, "nth": F.row_number().over(inside)})
    met = own.join(ahead.hint("merge"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
    return met.select("conv", (F.col("turns_ahead") + F.col("nth") - 1).alias("pos"), "turn", "role", "text", "tokens", (F.col("tokens_ahead") + F.col("inner")).alias("ahead"), "system")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, longest: int = LONGEST, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each window: conversation, ``window``, ``formatted``, ``loss`` (spans of code points of the escaped
    targets), ``n_turns``, ``n_fresh`` (the last ones), ``n_tokens`` and ``over_budget``."""
    t = numbered(turns, conv_col, turn_col, role_col, text_col)
    stride = F.greatest(F.lit(budget - history - longest) - F.coalesce("system.n", F.lit(0)), F.lit(LEAST_STRIDE))
    t = t.withColumn("stride", stride).withColumn("window", F.floor(F.col("ahead") / F.col("stride")))
    head = opening(F.col("role"))
    part = F.struct(F.col("pos"), F.concat(head, escaped(F.col("text")), F.lit("</s>")).alias("body"), F.length(head).cast("long").alias("from"), F.col("tokens"), (F.col("role") == "assistant").alias("target"))
    is_system = (F.col("role") == "system") & F.col("turn").eqNullSafe(F.col("system.at"))
    fresh = t.select("conv", "window", F.lit(True).alias("fresh"), part.alias("p"))
    near = F.col("ahead") >= (F.col("window") + 1) * F.col("stride") - history
    past = t.where(near & ~is_system).select("conv", (F.col("window") + 1).alias("window"), F.lit(False).alias("fresh"), part.alias("p"))
    later = fresh.select("conv", "window").distinct().select(F.col("conv").alias("c"), F.col("window").alias("w"))
    lead = t.where(is_system).groupBy("conv").agg(F.min_by(F.struct("window", part.alias("p")), "pos").alias("s"))
    kept = lead.join(later.hint("merge"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("w") > F.col("s.window"))).select("conv", F.col("w").alias("window"), F.lit(False).alias("fresh"), F.col("s.p").alias("p"))
    rows = fresh.unionByName(past).unionByName(kept)
    grouped = rows.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("p.pos", "fresh", "p.body", "p.from", "p.tokens", "p.target"))).alias("x"), F.count_if("fresh").alias("n_fresh")).where("n_fresh > 0")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc.at + F.length(x.body)
        span = F.struct((acc.at + x["from"]).alias("start"), (end - 4).alias("end"))
        return F.struct(end.alias("at"), F.when(x.fresh & x.target, F.array_append(acc.out, span)).otherwise(acc.out).alias("out"))

    n_tokens = F.aggregate("x", F.lit(0).cast("long"), lambda acc, x: acc + x.tokens)
    out = grouped.select(F.col("conv").alias(conv_col), "window", F.array_join("x.body", "").alias("formatted"), F.aggregate("x", zero, step, lambda acc: acc.out).alias("loss"), F.size("x").alias("n_turns"), "n_fresh", n_tokens.alias("n_tokens"))
    return out.withColumn("over_budget", F.col("n_tokens") > budget)


def parsed(formatted: Column) -> Column:
    """The turns of a formatted window: role and text, unescaped."""
    bodies = F.filter(F.split(formatted, "</s>", -1), lambda b: F.startswith(b, F.lit("<s>[")))

    def turn(b: Column) -> Column:
        end = F.instr(b, "]\n")
        return F.struct(unescaped(F.substring(b, F.lit(5), end - 5)).alias("role"), unescaped(F.substring(b, end + 2, F.length(b))).alias("text"))

    return F.transform(bodies, turn)


def fresh_turns(window: DataFrame) -> Column:
    """The fresh turns of a window, read back from its text."""
    turns = parsed(F.col("formatted"))
    return F.slice(turns, F.col("n_turns") - F.col("n_fresh").cast("int") + 1, F.col("n_fresh").cast("int"))


def masked_text(window: DataFrame) -> Column:
    """All text under the loss mask of a window, read back from its text."""
    return F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
