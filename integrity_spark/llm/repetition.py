"""Quality rules from a suffix array: maximal repeated word strings inside each document.

The suffixes of a batch of documents are sorted together by prefix doubling over word ids. The first key also holds
the document, so suffixes of two documents never tie, and later rounds sort only suffixes that still do. Ranks of all
rounds are kept; the longest common prefix (LCP) of neighbours comes from them by binary descent. An LCP interval of
at least ``min_words`` is a repeated string; every suffix in it covers its longest LCP, and the union of these spans
and the longest repeat are held against limits.

Defined results: null or blank text has no words, measures 0 and fails the base rule of ten words; a repeated
string may overlap its copy; equal documents do not touch each other, and repeated rows are judged each; a very long text is sorted alone and
judged whole; an empty table gives no rows; extra columns pass through ``quality_rules``, whatever their names, but for one called ``quality``,
which gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A repeated string counts for coverage from so many words; documents whose repeats cover more than COVERED of their
#: words, or with one longer than LONGEST words, are rejected. COVERED is under the 0.20 that the base rule allows repeated
#: 5-word windows, as it could reject nothing else: 0.12, as the Gopher rules have for 8-grams.
MIN_WORDS, COVERED, LONGEST = 8, 0.12, 80
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Words of one numpy sort; a longer document is sorted alone.
CHUNK = 400_000


def suffix_ranks(words: np.ndarray, doc: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of the words, documents apart, and (the last only, unless ``keep``) for round k each suffix's rank
    by its first 2**k words."""
    n = len(words)
    key = doc.astype(np.int64) << 32 | words.astype(np.int64)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    rank = np.empty(n, np.int64)
    first = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    starts = np.flatnonzero(first)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    ranks, width = [rank], 1
    ends = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])
    end_of = ends[np.searchsorted(ends, np.arange(n))] + 1
    while True:
        sizes = np.diff(np.r_[starts, n])
        tied = np.repeat(sizes > 1, sizes)
        if not tied.any():
            return order, ranks
        slots = np.flatnonzero(tied)
        suffixes = order[slots]
        nxt = suffixes + width
        second = np.where(nxt < end_of[suffixes], rank[np.minimum(nxt, n - 1)] + 1, 0)
        head = rank[suffixes]
        by = np.lexsort((second, head))
        suffixes, second, head = suffixes[by], second[by], head[by]
        order[slots] = suffixes
        new = np.r_[True, (head[1:] != head[:-1]) | (second[1:] != second[:-1])]
        at = slots[new]
        rank = rank.copy() if keep else rank
        rank[suffixes] = np.repeat(at, np.diff(np.r_[np.flatnonzero(new), len(new)]))
        first[at] = True
        starts = np.flatnonzero(first)
        ranks = [*ranks, rank] if keep else [rank]
        width *= 2


def neighbour_lcp(order: np.ndarray, ranks: list[np.ndarray], end_of: np.ndarray) -> np.ndarray:
    """LCP in words of the suffixes at i and i + 1 of the suffix array."""
    a, b = order[:-1].copy(), order[1:].copy()
    total = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    live = live[ranks[0][a] == ranks[0][b]]
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a[live] + total[live], b[live] + total[live]
        inside = (x + (1 << k) <= end_of[a[live]]) & (y + (1 << k) <= end_of[b[live]])
        n = len(end_of)
        same = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
        total[live[same]] += 1 << k
    return total


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def repeats(words: np.ndarray, sizes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document of ``sizes`` words each: words in repeated 5-word windows, words in repeats of ``min_words`` or
    more, longest repeat."""
    n, doc = len(words), np.repeat(np.arange(len(sizes)), sizes)
    if n < 2:
        z = np.zeros(len(sizes), np.int64)
        return z, z, z
    end_of = np.repeat(np.cumsum(sizes), sizes)
    order, ranks = suffix_ranks(words, doc)
    lcp = neighbour_lcp(order, ranks, end_of)
    most = np.zeros(n, np.int64)
    most[order] = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])
    out = []
    for least, span in ((5, None), (min_words, most)):
        at = np.flatnonzero(most >= least)
        hit = covered(at, np.full(len(at), least) if span is None else span[at], n)
        out.append(np.bincount(doc[hit], minlength=len(sizes)))
    longest = np.zeros(len(sizes), np.int64)
    np.maximum.at(longest, doc, most)
    return out[0], out[1], longest


def measure(texts: list[str | None], min_words: int) -> pd.DataFrame:
    """The measures of whole texts, sorted in chunks of about CHUNK words."""
    rows, ids, pending, room = [], {}, [], CHUNK

    def flush() -> None:
        nonlocal room
        if pending:
            got = repeats(np.concatenate([w for _, w in pending]), np.array([len(w) for _, w in pending]), min_words)
            for (k, _), five, cover, longest in zip(pending, *got, strict=True):
                rows[k] += [int(five), int(cover), int(longest)]
        pending.clear()
        ids.clear()
        room = CHUNK

    for k, text in enumerate(texts):
        text = text or ""
        raw = text.encode("utf-8", "replace")
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x.strip()] if words else []
        rows.append([len(words), len(text) - sum(text.count(x) for x in BLANKS), sum(text.count(x) for x in SYMBOLS), len(lines) - len(set(lines))])
        pending.append((k, np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))))
        room -= len(words)
        if room <= 0:
            flush()
    flush()
    return pd.DataFrame(rows, columns=[x.split()[0] for x in MEASURES.split(", ")], dtype="int64")


def quality_rules(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, max_covered: float = COVERED, max_longest: int = LONGEST) -> DataFrame:
    """``docs`` with a struct column ``quality``: the measures, ``base_failed`` and ``kept``. Narrow: no shuffle."""

    @F.pandas_udf(MEASURES)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield measure(list(texts), min_words)

    own = next(name for name in ("__m" + "_" * k for k in range(len(docs.columns) + 1)) if name not in docs.columns)
    m = F.col(own)
    failed = (m.n_words < 10) | (100 * m.n_repeat_words > 20 * m.n_words)
    passed = (m.covered_words <= max_covered * m.n_words) & (m.longest_repeat <= max_longest)
    return docs.withColumn(own, measured(F.col(text_col))).withColumn("quality", m.withField("base_failed", failed).withField("kept", ~failed & passed)).drop(own)
