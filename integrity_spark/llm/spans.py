"""Regex matches of a text column as spans, with built-in functions only.

``split`` gives the text between the matches and ``regexp_extract_all`` the matches; running lengths of both are the
code-point offsets. Running values are folded in blocks, so that a text with very many matches costs their number times
its root, not its square. Patterns must never match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of context on both sides; values that are folded at once, and code points of text that are cut at once.
LEFT, RIGHT, BLOCK, PIECE = 24, 12, 128, 16384
SPAN = "struct<start:bigint,end:bigint,hit:string,part:string,before:string,after:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """The fold of each array element (bigint) with all before it."""

    def inside(block: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.array_append(acc, F.when(F.size(acc) == 0, x).otherwise(fold(F.element_at(acc, -1), x)))

        return F.aggregate(block, F.array().cast("array<bigint>"), step)

    def whole(x: Column) -> Column:
        def joined(blocks: Column) -> Column:
            ends = inside(F.transform(blocks, lambda b: F.element_at(b, -1)))
            return let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda v: fold(F.get(e, i - 1), v))))))

        size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(x))).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / size).cast("int")), lambda k: inside(F.slice(x, k * size + 1, size)))
        return F.when(F.size(x) <= BLOCK, inside(x)).otherwise(let(cut, joined))

    return let(values, whole)


def matches(text: Column, pattern: str, group: int = 0, need: str | None = None) -> Column:
    """All leftmost non-overlapping matches: start, end, the match, one group of it, and a little text on both sides.
    ``need`` is a string that every match holds, which is looked for first."""
    every = [F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")]
    if group:
        every.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("parts"))
    whole = F.struct(*every)

    def placed(x: Column) -> Column:
        ends = running(F.transform(x.hits, lambda hit, i: (F.length(F.get(x.gaps, i)) + F.length(hit)).cast("bigint")), lambda a, b: a + b)

        def span(end: Column, i: Column) -> Column:
            hit = F.get(x.hits, i)
            return F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit"), (F.get(x.parts, i) if group else hit).alias("part"), F.right(F.get(x.gaps, i), F.lit(LEFT)).alias("before"), F.left(F.get(x.gaps, i + 1), F.lit(RIGHT)).alias("after"))

        return F.transform(ends, span)

    none = F.array().cast(f"array<{SPAN}>")
    some = F.regexp_like(text, F.lit(pattern))
    if need is not None:
        some = F.contains(text, F.lit(need)) & some
    return F.when(some, let(whole, placed)).otherwise(none)


def clear_of(spans: Column, base: Column) -> Column:
    """Those ``spans`` that overlap none of ``base``; both have start and end. One sort, then running bounds from both sides."""

    def sorted_all(all_: Column) -> Column:
        far = F.lit(2**62)
        most_before = running(F.transform(all_, lambda s: F.when(s.own, F.lit(-1).cast("bigint")).otherwise(s.end)), lambda a, b: F.greatest(a, b))
        next_base = F.reverse(running(F.reverse(F.transform(all_, lambda s: F.when(s.own, far).otherwise(s.start))), lambda a, b: F.least(a, b)))
        bounds = F.struct(most_before.alias("end"), next_base.alias("start"))
        return let(bounds, lambda b: F.filter(F.transform(all_, lambda s, i: F.when(s.own & (F.get(b.end, i) <= s.start) & (F.get(b.start, i) >= s.end), F.get(spans, s.i))), lambda s: s.isNotNull()))

    def tagged(x: Column, own: bool) -> Column:
        return F.transform(x, lambda s, i: F.struct(s.start.cast("bigint").alias("start"), F.lit(own).alias("own"), s.end.cast("bigint").alias("end"), i.alias("i")))

    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(let(F.array_sort(F.concat(tagged(spans, True), tagged(base, False))), sorted_all))


def cut_out(text: Column, spans: Column, mark: str) -> Column:
    """The text with each run of overlapping spans replaced by ``mark``. It is taken in pieces, each with the spans that
    reach into it, as finding a code point takes a walk from the piece's start."""
    ordered = F.array_sort(F.transform(spans, lambda f: F.struct(f.start.cast("bigint").alias("start"), f.end.cast("bigint").alias("end"))))

    def piece(own: Column, chunk: Column, begin: Column) -> Column:
        zero = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out"))
        cut = lambda a, b: F.substring(chunk, (a - begin + 1).cast("int"), (b - a).cast("int"))

        def step(acc: Column, f: Column) -> Column:
            gap = F.when((f.start >= acc.at) & (f.start >= begin), F.concat(cut(acc.at, f.start), F.lit(mark))).otherwise(F.lit(""))
            return F.struct(F.greatest(acc.at, f.end).alias("at"), F.array_append(acc.out, gap).alias("out"))

        def finish(acc: Column) -> Column:
            return F.concat(F.array_join(acc.out, ""), F.when(acc.at < begin + PIECE, cut(acc.at, begin + PIECE)).otherwise(F.lit("")))

        return F.aggregate(own, zero, step, finish)

    def pieces(sorted_spans: Column) -> Column:
        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))

        def each(chunk: Column, k: Column) -> Column:
            begin = (k * PIECE).cast("bigint")
            return piece(F.filter(sorted_spans, lambda f: (f.start < begin + PIECE) & (f.end > begin)), chunk, begin)

        return F.array_join(F.transform(chunks, each), "")

    short = F.length(text) <= PIECE
    return F.when(F.size(spans) == 0, text).when(short, piece(ordered, text, F.lit(0).cast("bigint"))).otherwise(let(ordered, pieces))


def digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn check of a string of digits."""
    rev = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(rev, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then by order of the kind, joined by commas. Spans have start, order, kind, end."""
    sorted_spans = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.order.alias("order"), s.end.alias("end"), s.kind.alias("kind"))))
    return F.array_join(F.transform(sorted_spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
