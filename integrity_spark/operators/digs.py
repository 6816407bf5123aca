"""Dig packages: match planned digs to inspection features by id, by dimensions or inside the weld window.

All digs and runs are one job. A run is a line and a source; digs reach the runs of their line.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import dash_default, dimensions_match, is_dig_weld, key_of, normalize_key, safe_name, number_of, split_multivalue
from ..sources.shared import kept, numbered, small, small_or_merged
from .ordered import key_greatest, key_least, key_size, lag, lead, row_number, scan
from .ranges import dealt, dealt_points, dealt_spans, nearest_value, range_join

SIDE_M, BUFFER_M, WELDS, BIN_M, LEAST_BIN_M = 30.0, 0.5, 3, 64.0, 4.0
RUN = ("line_id", "source")


def exploded_ids(mdl: DataFrame) -> DataFrame:
    """A row for each id of a dig's cell, normalised."""
    out = mdl.select("dig_id", "line_id", F.posexplode(split_multivalue(F.col("feature_ids"))).alias("id_pos", "feature_id_raw"))
    return out.withColumn("norm_id", normalize_key(F.col("feature_id_raw"))).where("norm_id <> ''")


def match_by_id(mdl: DataFrame, ili: DataFrame) -> DataFrame:
    """All inspection rows of each id."""
    return exploded_ids(mdl).join(ili.withColumn("norm_id", normalize_key(F.col("feature_id"))).hint("merge"), ["line_id", "norm_id"])


def match_by_dimensions(mdl: DataFrame, ili: DataFrame, by: Sequence[str] = ("line_id",)) -> DataFrame:
    """Rows whose length and width both agree, in equal or converted units. Candidates meet on equal keys and a
    logarithmic bucket of the length: tolerances of at most 2 % reach one bucket or two under
    each unit hypothesis. Where one of the lengths is below 2, absolute tolerances rule; those meet in buckets of
    an absolute width instead. Every pair is tested by the exact predicate, and kept once."""
    step, flat, reach = 0.084, 0.1, 0.021
    keys = list(by)

    def buckets(value: Column) -> Column:
        return F.when(value >= 1, F.concat(F.lit("g"), F.floor(F.ln(value) / step).cast("string"))).otherwise(F.concat(F.lit("f"), F.floor(value / flat).cast("string")))

    def around(value: Column) -> Column:
        geo = F.ln(F.greatest(value, F.lit(0.5)))
        each = lambda kind, at, width: F.transform(F.sequence(F.floor((at - reach) / width), F.floor((at + reach) / width)), lambda k: F.concat(F.lit(kind), k.cast("string")))
        near, low = each("g", geo, step), each("f", F.least(value, F.lit(2.0)), flat)
        return F.concat(F.when(value > 0.5, near).otherwise(F.array().cast("array<string>")), F.when(value < 1.5, low).otherwise(F.array().cast("array<string>")))

    length, width = F.col("mdl_length"), F.col("mdl_width")
    asked = mdl.withColumns({"mdl_length": number_of(mdl, "length_in"), "mdl_width": number_of(mdl, "width_in")}).where(length.isNotNull() & width.isNotNull())
    hypotheses = F.array_distinct(F.flatten(F.array(*(around(F.abs(length) * k) for k in (1.0, 1 / 25.4, 25.4)))))
    asked = asked.withColumn("__b", F.explode(hypotheses))
    had = ili.withColumn("__b", buckets(F.abs(number_of(ili, "length_mm"))))
    same = dimensions_match(length, number_of(ili, "length_mm")) & dimensions_match(width, number_of(ili, "width_mm"))
    return asked.join(had.hint("merge"), [*keys, "__b"]).where(same).drop("__b")


def _targets(mdl: DataFrame) -> DataFrame:
    """The digs on each line with the key of their target weld, written."""
    asked = mdl.groupBy("dig_id", "line_id").agg(F.min("target_girth_weld").alias("target_girth_weld"))
    return kept(asked.withColumn("key", key_of(asked, "target_girth_weld")), "targets")


def _found(first: DataFrame, ili: DataFrame, order: Sequence[str]) -> DataFrame:
    """The digs and runs whose target weld is found, with its chainage. A list of digs that is small picks its rows where the listing lies; only a
    long one shuffles the listing, once by line and key, and of that just the keys as long as some dig's key. Rows that tie up to the
    chainage have one chainage, so what orders them further isn't needed."""
    keys = [c for c in ("gwd_number", "feature_id", "feature_desc", "girth_weld") if c in ili.columns]
    order = order[: order.index("chainage") + 1] if "chainage" in order else order
    lengths = [r.n for r in first.select(F.length("key").alias("n")).distinct().collect()]  # as many as lengths
    each = F.filter(F.array(*(F.struct(F.lit(k).alias("prio"), key_of(ili, c).alias("key")) for k, c in enumerate(keys))), lambda s: (s.key != "") & F.length(s.key).isin(lengths))
    searched = ili.select(*RUN, *(F.col(c).alias(f"o_{c}") for c in dict.fromkeys(["chainage", *order])), F.inline(each))
    of = [F.col("prio") == k for k in range(len(keys))]
    x = number_of(searched, "o_chainage").alias("x")
    if list(order) == ["chainage"]:  # nulls first, so the least is the first row's unless there is a null; a number or text is hashed, not sorted
        least = lambda own: F.when(F.count_if(own & F.col("o_chainage").isNull()) == 0, F.min(F.when(own, F.col("o_chainage"))))
        heads = [least(own).alias(f"h{k}") for k, own in enumerate(of)]
        place = lambda k: number_of(searched.select(F.col("o_chainage").alias(f"h{k}")), f"h{k}")
    else:
        heads = [F.min_by(F.when(own, F.struct(x)), F.when(own, F.struct(*(f"o_{c}" for c in order)))).alias(f"h{k}") for k, own in enumerate(of)]
        place = lambda k: F.col(f"h{k}.x")
    if small(first):
        met = searched.join(first.hint("broadcast"), ["line_id", "key"]).groupBy("dig_id", *RUN).agg(*heads)
    else:
        met = searched.repartition("line_id", "key").groupBy("line_id", "key", "source").agg(*heads).join(first.hint("merge"), ["line_id", "key"])
    return met.select("dig_id", *RUN, F.coalesce(*(place(k) for k in range(len(keys)))).alias("target_chainage")).where("target_chainage IS NOT NULL")


def found_targets(mdl: DataFrame, ili: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows of ``locate_target_weld`` that have a chainage, without the others."""
    return _found(_targets(mdl), ili, order)


def locate_target_weld(mdl: DataFrame, ili: DataFrame, order: Sequence[str]) -> DataFrame:
    """The target weld's chainage for each dig and run. Columns are searched in turn; of each, only the first matching
    row (by ``order``) counts, and the first numeric chainage wins. Digs reach every run of their line."""
    first = _targets(mdl)
    runs = ili.select(*RUN).distinct()
    return first.select("dig_id", "line_id").join(runs, "line_id").join(_found(first, ili, order), ["dig_id", *RUN], "left")


def weld_window(targets: DataFrame, ili: DataFrame, n: int = WELDS) -> DataFrame:
    """Chainage bounds around each target: n welds on each side of the nearest one (the lower on ties), clamped, with a
    buffer; 30 m on a side without welds; no bounds and chainage 0 where the target wasn't found."""
    x = number_of(ili, "chainage")
    welds = ili.where(is_dig_weld(F.col("feature_type")) & x.isNotNull()).select(*RUN, x.alias("x"))
    placed = scan(welds, RUN, ["x"], {"idx": row_number(), "n": key_size(), "x_before": lag("x"), "x_up": lag("x", n), "x_down": lead("x", n), "x_first": key_least("x"), "x_last": key_greatest("x")})
    sides = {"x_up": F.when(F.col("idx") > 1, F.coalesce("x_up", "x_first")), "x_down": F.when(F.col("idx") < F.col("n"), F.coalesce("x_down", "x_last"))}
    places = placed.where("NOT (x <=> x_before)").withColumns(sides)  # the first weld of a place
    at = nearest_value(targets, places, RUN, "target_chainage", "x", "near", ("x_up", "x_down"))
    t = F.col("target_chainage")
    pad = F.when(F.col("near").isNotNull(), BUFFER_M).otherwise(0.0)
    lo, hi = F.coalesce("x_up", t - SIDE_M) - pad, F.coalesce("x_down", t + SIDE_M) + pad
    return at.select("dig_id", *RUN, F.coalesce(t, F.lit(0.0)).alias("target_chainage"), t.isNotNull().alias("target_found"), F.when(t.isNotNull(), lo).alias("lo"), F.when(t.isNotNull(), hi).alias("hi"))


def bin_of(windows: DataFrame) -> float:
    """Width of the bins in which rows meet written ``windows``: their median, so that half of them lie in two bins at most."""
    return max(windows.agg(F.percentile_approx(F.col("hi") - F.col("lo"), 0.5)).first()[0] or BIN_M, LEAST_BIN_M)


def window_rows(windows: DataFrame, ili: DataFrame, whole_runs: bool = True) -> DataFrame:
    """Inspection rows of each of the written ``windows``; without bounds, all rows of the run, chainage or not (``whole_runs=False``: there are
    no such windows)."""
    own = ili.withColumn("x", number_of(ili, "chainage"))
    inside = range_join(own.where("x IS NOT NULL"), windows.where("target_found"), RUN, "x", "lo", "hi", bin_of(windows), open_ends=False)
    return inside.unionByName(own.join(windows.where("NOT target_found"), list(RUN))) if whole_runs else inside


def rows_inside(points: DataFrame, windows: DataFrame) -> DataFrame:
    """How many of ``points`` (with chainage ``x``) lie in each of the written ``windows``: ``inside``. A bin, as wide as the median window, is one row that
    holds its places and their counts, so no pair of a window and a row is made."""
    width, by = bin_of(windows), [*RUN, "__bin"]
    placed = points.where("x IS NOT NULL").select(*RUN, "x", F.floor(F.col("x") / width).alias("__bin")).repartition(*by)
    held = placed.groupBy(*by, "x").agg(F.count("*").alias("n")).groupBy(*by).agg(F.collect_list(F.struct("x", "n")).alias("__held"))
    bins = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)))
    cut = windows.where("lo <= hi").select("dig_id", *RUN, "lo", "hi", bins.alias("__bin"))
    own = F.filter("__held", lambda h: h.x.between(F.col("lo"), F.col("hi")))
    n = F.aggregate(own, F.lit(0).cast("long"), lambda total, h: total + h.n)
    return cut.join(held.hint("merge"), by).select("dig_id", *RUN, n.alias("n")).groupBy("dig_id", *RUN).agg(F.sum("n").alias("inside"))


def dig_runs(mdl: DataFrame, ili: DataFrame, order: Sequence[str] = ("chainage", "feature_id"), n: int = WELDS) -> DataFrame:
    """Every pair of a dig and a run of its line: ``target_found``, ``target_chainage`` (0 without it), the window's bounds, and ``n_rows``. Where the
    target weld isn't found, the pair stands for all rows of the run, which the listing holds once: ``n_rows`` counts them, no row
    is written for them. With ``dig_rows`` this is the whole result of the "all rows" rule without its product."""
    found = kept(locate_target_weld(mdl, ili, order), "located")
    windows = kept(weld_window(found.where("target_chainage IS NOT NULL"), ili, n), "bounds")
    own = ili.select(*RUN, number_of(ili, "chainage").alias("x"))
    inside = rows_inside(own, windows)
    whole = small_or_merged(kept(own.groupBy(*RUN).agg(F.count("*").alias("of_run")), "runs"))
    pairs = found.join(windows.drop("target_chainage", "target_found").hint("merge"), ["dig_id", *RUN], "left").join(inside.hint("merge"), ["dig_id", *RUN], "left").join(whole, list(RUN))
    hit = F.col("target_chainage").isNotNull()
    return pairs.select("dig_id", *RUN, hit.alias("target_found"), F.coalesce("target_chainage", F.lit(0.0)).alias("target_chainage"), "lo", "hi", F.when(hit, F.coalesce("inside", F.lit(0))).otherwise(F.col("of_run")).alias("n_rows"))


def dig_rows(pairs: DataFrame, ili: DataFrame, digs: Sequence[int]) -> DataFrame:
    """All rows of a few digs, those of runs without the target weld included."""
    return window_rows(kept(pairs.where(F.col("dig_id").isin(*digs)), "asked"), ili)


def with_asked(windows: DataFrame, mdl: DataFrame, ili: DataFrame, whole_runs: bool = True) -> DataFrame:
    """Written ``windows`` with what their dig asks for: its ``ids``, and the ``sizes`` of those MDL rows whose ids aren't in any of the dig's windows of
    the same source. Only ids meet the listing for that; the rows of windows aren't made, and all else meets on rows that are dealt by dig
    once. ``whole_runs=False``: every window has bounds."""
    asked = mdl.withColumn("mdl_row", F.xxhash64(*mdl.columns))
    ids = asked.select("dig_id", "mdl_row", F.explode(split_multivalue(F.col("feature_ids"))).alias("raw")).withColumn("norm_id", normalize_key(F.col("raw"))).where("norm_id <> ''").drop("raw")
    keyed = ili.select(*RUN, normalize_key(F.col("feature_id")).alias("norm_id"), number_of(ili, "chainage").alias("x"))
    spans = windows.select("dig_id", *RUN, "lo", "hi", "target_found").join(ids.hint("merge"), "dig_id")
    by, row = [*RUN, "norm_id"], ["dig_id", "mdl_row", "source"]
    hits = range_join(keyed.where("x IS NOT NULL"), spans.where("target_found"), by, "x", "lo", "hi", bin_of(windows), open_ends=False).select(*row)
    if whole_runs:
        hits = hits.unionByName(spans.where("NOT target_found").select(*by, "dig_id", "mdl_row").join(keyed.select(*by).distinct().hint("merge"), by).select(*row))
    sized = asked.select("dig_id", "mdl_row", F.struct(number_of(asked, "length_in").alias("length"), number_of(asked, "width_in").alias("width")).alias("size")).where("size.length IS NOT NULL AND size.width IS NOT NULL")
    sources = dealt(windows.select("dig_id", "source"), "dig_id").distinct()
    rest = sized.join(sources.hint("merge"), "dig_id").join(dealt(hits, "dig_id").distinct().hint("merge"), row, "left_anti")
    sizes = rest.groupBy("dig_id", "source").agg(F.collect_set("size").alias("sizes"))
    return windows.join(ids.groupBy("dig_id").agg(F.collect_set("norm_id").alias("ids")).hint("merge"), "dig_id", "left").join(sizes.hint("merge"), ["dig_id", "source"], "left")


def with_members(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the ids and sizes of all rows of their key, on rows that are dealt by some of ``keys`` already."""
    one = F.struct(normalize_key(F.col("feature_id")).alias("norm_id"), number_of(rows, "length_mm").alias("length"), number_of(rows, "width_mm").alias("width"))
    return rows.withColumn("__members", F.collect_list(one).over(W.partitionBy(*keys)))


def dig_feature_table(mdl: DataFrame, ili: DataFrame, row_key: Sequence[str] = ("feature_id", "chainage"), order: Sequence[str] = ("chainage", "feature_id"), n: int = WELDS, first_n: int | None = None, fallback: str = "all") -> DataFrame:
    """Per dig and run: the rows in its window with target flag, distance from the target weld (negative numbers of the
    shown dimensions are 0) and the dig's number in sorted order. ``fallback``: for runs without the target weld, ``all``
    takes all rows of the run (a product of digs and runs, so for few digs only), ``skip`` takes none.

    Targets are asked for by id, and by dimensions for MDL rows without any id hit. A window carries what its dig asks for, and a row the ids and sizes of
    all rows of its ``row_key``, which holds the chainage: one that is a target makes all of them targets. So the rows of windows, many times
    the listing, are made once, in the last join, and never shuffled; the listing is, once."""
    if "chainage" not in row_key:
        raise ValueError(f"the rows of a key lie at one chainage: {row_key}")
    digs = numbered(mdl, "dig_id", "dig_no")
    if first_n is not None:
        digs = digs.where(F.col("dig_no") <= first_n)
        mdl = mdl.join(digs.select("dig_id"), "dig_id", "left_semi")
    skip = fallback == "skip"
    found = kept((found_targets if skip else locate_target_weld)(mdl, ili, order), "found")  # a scan's ranges take two runs over it
    windows = kept(weld_window(found, ili, n), "windows")
    asking = kept(with_asked(windows, mdl, ili, not skip).join(digs.hint("merge"), "dig_id").withColumnsRenamed({"ids": "__ids", "sizes": "__sizes"}), "asking")
    width, by = bin_of(windows), [*RUN, "__cell", "__bin"]
    x = number_of(ili, "chainage")
    points = with_members(dealt_points(ili.where(x.isNotNull()), RUN, x, width).withColumn("x", x), [*by, *row_key])
    rows = points.join(dealt_spans(asking.where("target_found"), RUN, "lo", "hi", width).hint("merge"), by).where("x BETWEEN lo AND hi").drop("__cell", "__bin")
    if not skip:
        rows = rows.unionByName(with_members(ili.withColumn("x", x), [*RUN, *row_key]).join(asking.where("NOT target_found"), list(RUN)))
    alike = lambda s, m: dimensions_match(s.length, m.length) & dimensions_match(s.width, m.width)
    asked = lambda m: F.coalesce(F.array_contains("__ids", m.norm_id), F.lit(False))
    # Most rows are alone with their key and most windows ask for one size at most; without a lambda these are compiled.
    single = (F.size("__members") == 1) & (F.coalesce(F.size("__sizes"), F.lit(0)) <= 1)
    member, size = F.get("__members", F.lit(0)), F.get("__sizes", F.lit(0))
    any_pair = F.exists("__members", lambda m: asked(m) | F.coalesce(F.exists("__sizes", lambda s: alike(s, m)), F.lit(False)))
    one = F.when(single, asked(member) | alike(size, member)).otherwise(any_pair)
    is_target = reduce(and_, (F.col(c).isNotNull() for c in row_key)) & one
    joined = rows.withColumn("is_target", is_target).drop("__ids", "__sizes", "__members")
    shown = {c: F.greatest(number_of(joined, c), F.lit(0.0)) for c in ("depth_pct", "length_mm", "width_mm")}
    return joined.withColumns(shown).withColumn("distance_m", F.col("x") - F.col("target_chainage")).drop("x")


def skipped_digs(mdl: DataFrame, table: DataFrame) -> DataFrame:
    return mdl.select("dig_id").distinct().join(table.select("dig_id").distinct(), "dig_id", "left_anti").withColumn("reason", F.lit("no inspection rows"))


def package_summary(mdl: DataFrame, table: DataFrame) -> DataFrame:
    """Per dig: runs used, rows, matched targets; digs without rows with a reason."""
    made = table.groupBy("dig_id").agg(F.countDistinct("line_id", "source").alias("runs"), F.count("*").alias("n_rows"), F.count_if("is_target").alias("targets"))
    all_digs = mdl.select("dig_id").distinct().join(made, "dig_id", "left").fillna(0, ["runs", "n_rows", "targets"])
    return all_digs.withColumn("skipped", F.when(F.col("n_rows") == 0, "no inspection rows"))


def first_digs(mdl: DataFrame, n: int) -> DataFrame:
    ids = mdl.select("dig_id").distinct()
    return ids.orderBy("dig_id").limit(n)


def dig_header(mdl: DataFrame, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Header values from each dig's first MDL row, missing ones as a dash, and its file name."""
    first = mdl.groupBy("dig_id").agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("h"))
    name = F.col("h.dig_name") if "dig_name" in fields else F.lit(None).cast("string")
    return first.select("dig_id", *(dash_default(F.col(f"h.{c}")).alias(c) for c in fields), safe_name(name, F.col("dig_id")).alias("file_name"))
