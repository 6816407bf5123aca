"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents fall into cells of source, language and topic. Starting from each cell's share of all tokens, the weights
are raked in turn to the source, language and topic marginals until these hold. Ratios to the start are trimmed after
each round only where the caller gives ``trim``, as survey calibration does; the marginals then may not hold. Marginals
that no weights on the given cells can meet (a language that only one source has, with another target) leave a gap:
given targets raise an error, default ones a warning; the column ``gap`` states what is left. A document's probability is its cell's ratio over the largest
one, so token shares of the sample meet the raked weights in expectation; a hash of the id decides, the same
way on every run. Only the small cell table is iterated; it joins back by broadcast behind a check of its size.

Topics come from a fixed lexicon: the topic most of a text's listed words belong to, the first on ties, else
``general``. Defined results: a null text has no tokens; null source or language is a value of its own; a cell without
tokens has ratio 1; a very long text counts whole, for its tokens and its topic; an empty table has no cells and gives no rows; a null id draws like the text ``null``; repeated rows with one id are kept or dropped together;
extra columns pass through.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .spans import let

# The topic lexicon.
TOPICS = {
    "legal": ["license", "licensed", "copyright", "court", "contract", "law", "warranty", "terms"],
    "software": ["software", "code", "server", "token", "password", "secret", "api", "data"],
    "contact": ["example", "mail", "com", "phone", "address", "call", "street", "www"],
}
DIMENSIONS = ("source", "lang", "topic")
#: Targets default to each value's share of tokens to this power, made to sum to one.
FLATTEN = 0.95
#: Raking goes on until all marginals hold to TOLERANCE. It is given up after ROUNDS, or where BATCH rounds leave more
#: than STALLED of the gap.
TOLERANCE, ROUNDS, BATCH, STALLED = 1e-6, 500, 5, 0.999
#: Largest cell table that is broadcast; a larger one is joined by sort-merge.
BROADCAST_CELLS = 100_000
SEED = "mix-1"


def topic_of(text: Column) -> Column:
    names, words = list(TOPICS), [w for ws in TOPICS.values() for w in ws]
    initials = "".join(sorted({w[0] for w in words}))  # most positions of a text fail at these
    pattern = rf"(?i)(?=[{initials}])\b(?:" + "|".join(words) + r")\b"
    index = F.create_map(*(F.lit(x) for k, ws in enumerate(TOPICS.values()) for w in ws for x in (w, k)))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: index[F.lower(w)])

    def most(ks: Column) -> Column:
        def share(k: int) -> Column:
            return F.struct(F.size(F.filter(ks, lambda f: f == k)).alias("n"), F.lit(-k).alias("k"))

        return F.array_max(F.array(*map(share, range(len(names)))))

    return let(let(found, most), lambda best: F.when(best.n > 0, F.get(F.array(*map(F.lit, names)), -best.k)).otherwise("general"))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``topic`` and ``tokens`` (words of the whole text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"topic": topic_of(text), "tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")})


def cell(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("\0null"))


def raked(feats: DataFrame, targets: dict[str, DataFrame] | None = None, flatten: float = FLATTEN, trim: tuple[float, float] | None = None, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """A row for each cell: its keys ``k_*``, ``start`` and raked ``weight`` (shares of all tokens), ``ratio``,
    ``probability`` and the largest ``gap`` of a marginal to its target. ``targets``: for a dimension, a table of ``value`` and ``weight``; other values get weight 0."""
    keys = [f"k_{d}" for d in dimensions]
    cells = written(feats.groupBy(*(cell(d).alias(k) for d, k in zip(dimensions, keys, strict=True))).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("start", F.col("tokens") / F.lit(float(max(total, 1)))).withColumn("weight", F.col("start"))
    for d, k in zip(dimensions, keys, strict=True):
        if targets and d in targets:
            given = targets[d].select(F.coalesce(F.col("value").cast("string"), F.lit("\0null")).alias(k), F.col("weight").cast("double").alias("t"))
        else:
            given = cells.groupBy(k).agg(F.pow(F.sum("tokens") / F.lit(float(max(total, 1))), F.lit(flatten)).alias("t"))
        norm = given.join(cells.select(k).distinct(), k, "left_semi").agg(F.sum("t")).first()[0] or 1.0
        now = now.join(given.withColumn("t", F.col("t") / norm).withColumnRenamed("t", f"t_{d}").hint("merge"), k, "left").fillna(0.0, [f"t_{d}"])
    now = written(now, "raking")
    gap = math.inf
    for _ in range(0, ROUNDS, BATCH):
        for _ in range(BATCH):
            for d, k in zip(dimensions, keys, strict=True):
                held = F.sum("weight").over(W.partitionBy(k))
                now = now.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"t_{d}"), held), F.lit(0.0)))
            if trim is not None:
                now = now.withColumn("weight", F.least(F.greatest(F.col("weight"), F.col("start") * trim[0]), F.col("start") * trim[1]))
        now = written(now, "raking")
        off = [F.max(F.abs(F.col(f"h_{d}") - F.col(f"t_{d}"))) for d in dimensions]
        last, gap = gap, now.select("*", *(F.sum("weight").over(W.partitionBy(k)).alias(f"h_{d}") for d, k in zip(dimensions, keys, strict=True))).agg(F.greatest(*off) if len(off) > 1 else off[0]).first()[0]
        gap = gap or 0.0
        if gap <= TOLERANCE or gap > STALLED * last:
            break
    if total and trim is None and gap > TOLERANCE:
        if targets:
            raise ValueError(f"no weights found that meet the targets: a marginal is off by {gap:.2e}")
        warnings.warn(f"a marginal of the mix is off its default target by {gap:.2e}", stacklevel=2)
    ratio = F.when(F.col("start") > 0, F.col("weight") / F.col("start")).otherwise(1.0)
    out = now.withColumn("ratio", ratio)
    most = out.where("start > 0").agg(F.max("ratio")).first()[0] or 1.0
    return out.select(*keys, "tokens", "documents", "start", "weight", "ratio", F.least(F.col("ratio") / most, F.lit(1.0)).alias("probability"), F.lit(gap).alias("gap"))


def drawn(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / 2.0**32


def sample(feats: DataFrame, cells: DataFrame, id_col: str = "doc_id", dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``feats`` with ``probability`` and ``sampled``."""
    keys = [f"k_{d}" for d in dimensions]
    cells = written(cells.select(*keys, "probability"), "probabilities")
    small = cells.count() <= BROADCAST_CELLS
    keyed = feats.withColumns({k: cell(d) for d, k in zip(dimensions, keys, strict=True)})
    joined = keyed.join(cells.hint("broadcast" if small else "merge"), keys, "left")
    return joined.withColumn("sampled", drawn(F.col(id_col)) < F.col("probability")).drop(*keys)
