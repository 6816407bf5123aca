"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans of each kind come from a regex over the whole text. Five labelers vote on each candidate, for (1),
against (2) or not at all (0): the format check behind the regex, a gazetteer, words on the left, the neighbouring
characters, and the shape of the match. Expectation-maximisation over the counts of (kind, votes) estimates how often
each labeler votes rightly and how often a candidate of each kind is personal data. Its posteriors then train the final
classifier, a logistic model on the kind, the votes and the span itself: its length, its share of figures, its breaks and capitals, each also
for its kind alone. So spans of one vote pattern part by what they look like. Both fits see every candidate through counts of
patterns, whose number is bounded by kinds x 3**5 votes x 4 lengths x SHAPES whatever the input. The scan of the texts is one narrow
pass.

The base spans (email, ip, card, phone that pass their format check) always stay; the classifier adds spans of
the kinds name, ssn and iban, where it is sure enough and they overlap no base span.

Defined results: null text is empty; a very long text is scanned whole; no candidates anywhere, or an empty table, leaves
the classifier at its priors and adds nothing; of candidates of one kind the leftmost wins, those of two kinds may tie
and both stand, but an added span that touches a base span goes; repeated rows give repeated results and count as often
in training; extra columns of the input pass through, and only one that is called like the result is replaced.
"""

from __future__ import annotations

import math
import uuid
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .spans import clear_of, digits, let, luhn, matches

# The kinds with their patterns. The look-behinds spare hopeless starts inside a run; where they can, they
# stand after the first character, as most positions of a text fail at that.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "name": r"(?=\p{Lu})(?<![\p{L}])(?!(?:Mr|Mrs|Ms|Dr|Herr|Frau|Dear|Contact|Name|Signed|Monsieur|Madame|Se\u00f1or|Se\u00f1ora|The|And|For|From) )\p{Lu}\p{Ll}{1,20} \p{Lu}\p{Ll}{1,20}(?![\p{L}])",
    "ssn": r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])",
}
KINDS, BASE = list(PATTERNS), 4
#: What each match of a kind holds; a text without it is not scanned for that kind.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "ip": r"^(10|127|169\.254|172\.(1[6-9]|2[0-9]|3[01])|192\.168)\.",
    "card": r"^(3[47]|4|5[1-5]|6011|65)",
    "phone": r"^\+(1|7|20|27|3[0-69]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "name": r"^(James|Mary|John|Anna|Robert|Maria|Michael|Laura|David|Sarah|Thomas|Peter|Hans|Klaus|Pierre|Marie|Jean|Luis|Carlos|Carmen|Jose|Elena|Paul|Julia) ",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^(AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
}
CONTEXT = {
    "email": r"(?i)(e-?mail|contact|write|mailto|address)\W*$",
    "ip": r"(?i)(\bip\b|host|server|address|client|login from)\W*$",
    "card": r"(?i)(card|visa|master|credit|amex|karte|carte|tarjeta)\W*(no|number|nr)?\W*$",
    "phone": r"(?i)(phone|tel|call|mobile|fax|cell)\W*(no|number|nr)?\W*$",
    "name": r"(?i)(\bmr|\bmrs|\bms|\bdr|herr|frau|monsieur|madame|se.or|se.ora|\bname|signed|contact|dear)\W*$",
    "ssn": r"(?i)(ssn|social security|\bsoc\b)\W*(no|number|nr)?\W*$",
    "iban": r"(?i)(iban|account|konto|compte|cuenta)\W*(no|number|nr)?\W*$",
}
LABELERS = 5
#: Classes of figures (none, fewer than half, more), breaks (0 to 3 or more) and capitals (none, one or two, more).
SHAPES = 3 * 4 * 3
#: Least probability of an added span; steps of the two fits.
SURE, EM_STEPS, FIT_STEPS, RATE, DECAY = 0.9, 50, 800, 0.25, 1e-3
CANDIDATE = "array<struct<start:bigint,order:int,end:bigint,kind:string,valid:boolean,pattern:int>>"


def format_check(kind: str, hit: Column) -> Column:
    n = F.length(digits(hit))
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*+([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(digits(hit))).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    if kind == "iban":
        return F.length(hit).between(15, 34)
    return F.lit(True)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 2).otherwise(0)


def candidate(kind: str, s: Column) -> Column:
    """A span with its format check and its pattern: five votes, a length class and a shape as one number."""
    valid, known, size = format_check(kind, s.hit), F.regexp_like(s.hit, F.lit(GAZETTEER[kind])), F.length(s.hit)
    said = F.regexp_like(s.before, F.lit(CONTEXT[kind]))
    glued = F.regexp_like(F.right(s.before, F.lit(1)), F.lit(r"[\p{L}\p{N}_]")) | F.regexp_like(F.left(s.after, F.lit(1)), F.lit(r"[\p{L}\p{N}_]"))
    dull = F.regexp_like(digits(s.hit), F.lit(r"^(.)\1*$"))
    votes = [
        F.when(valid, 1).otherwise(2) if kind != "name" else F.lit(0),
        F.when(known, 1).otherwise(2 if kind in ("name", "iban", "ssn") else 0),
        vote(said, F.lit(False)) if kind not in ("name", "ssn") else F.when(said, 1).otherwise(2),
        F.when(glued, 2).otherwise(1),
        vote(F.lit(False), dull),
    ]
    n, breaks, capitals = F.length(digits(s.hit)), F.regexp_count(s.hit, F.lit(r"[^\p{L}\p{N}]")), F.regexp_count(s.hit, F.lit(r"\p{Lu}"))
    figures = F.when(n == 0, 0).when(2 * n < size, 1).otherwise(2)
    shape = (figures * 4 + F.least(breaks, F.lit(3))) * 3 + F.when(capitals == 0, 0).when(capitals < 3, 1).otherwise(2)
    pattern = F.when(size < 12, 0).when(size < 20, 1).when(size < 32, 2).otherwise(3) * SHAPES + shape
    for v in votes:
        pattern = pattern * 3 + v
    return F.struct(s.start.alias("start"), F.lit(KINDS.index(kind)).alias("order"), s.end.alias("end"), F.lit(kind).alias("kind"), F.coalesce(valid, F.lit(False)).alias("valid"), pattern.cast("int").alias("pattern"))


def candidates(docs: DataFrame, text_col: str = "text") -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = [F.transform(matches(text, PATTERNS[kind], need=NEEDS.get(kind)), partial(candidate, kind)) for kind in KINDS]
    return F.concat(*each).cast(CANDIDATE)


def votes_of(pattern: int) -> tuple[list[int], int]:
    votes = []
    for _ in range(LABELERS):
        pattern, v = divmod(pattern, 3)
        votes.append(v)
    return votes[::-1], pattern


def reliabilities(counts: dict[tuple[int, int], int]) -> tuple[dict, dict[tuple[int, int], float]]:
    """Expectation-maximisation over (kind, pattern) counts: P(vote | class) of each labeler, P(class) of each kind, and
    the posterior of each pattern. A Dirichlet prior holds labelers to be better than chance."""
    start = np.empty((LABELERS, 2, 3))
    start[:, 1], start[:, 0] = (0.3, 0.55, 0.15), (0.3, 0.2, 0.5)
    table, each = start.copy(), np.arange(LABELERS)
    if counts:
        kinds, kind = np.unique([k for k, _ in counts], return_inverse=True)
        votes, n = np.array([votes_of(p)[0] for _, p in counts]), np.array(list(counts.values()), float)
        prior = np.full(len(kinds), 0.5)
        for _ in range(EM_STEPS):
            a, b = (np.log(x)[kind] + np.log(table[each, c, votes]).sum(axis=1) for c, x in ((1, prior), (0, 1 - prior)))
            post = 1 / (1 + np.exp(np.clip(b - a, -500, 500)))
            total = 10 * start
            for j in range(LABELERS):
                total[j, 1] += np.bincount(votes[:, j], n * post, 3)
                total[j, 0] += np.bincount(votes[:, j], n * (1 - post), 3)
            prior = (2 + np.bincount(kind, n * post)) / (4 + np.bincount(kind, n))
            table = total / total.sum(axis=2, keepdims=True)
    shown = {(j, c, v): float(table[j, c, v]) for j in range(LABELERS) for c in range(2) for v in range(3)}
    return shown, dict(zip(counts, post.tolist(), strict=True)) if counts else {}


def features(kind: int, pattern: int) -> list[str]:
    votes, rest = votes_of(pattern)
    size, shape = divmod(rest, SHAPES)
    own = [f"size{size}", f"figures{shape // 12}", f"breaks{shape // 3 % 4}", f"capitals{shape % 3}"]
    return ["bias", f"kind{kind}", *own, *(f"kind{kind}:{x}" for x in own), *(f"vote{j}={v}" for j, v in enumerate(votes))]


def fitted(counts: dict[tuple[int, int], int], post: dict[tuple[int, int], float]) -> dict[str, float]:
    """Logistic regression on the posteriors, weighted by log counts so that rare patterns are heard."""
    if not counts:
        return {}
    keys = sorted(counts)
    names, flat = np.unique([features(*k) for k in keys], return_inverse=True)
    at = flat.reshape(len(keys), -1)
    target, n = np.array([post[k] for k in keys]), np.log1p([counts[k] for k in keys])
    weight = np.zeros(len(names))
    for _ in range(FIT_STEPS):
        p = 1 / (1 + np.exp(-np.clip(weight[at].sum(axis=1), -30, 30)))
        slope = np.bincount(at.ravel(), np.repeat(n * (target - p) / n.sum(), at.shape[1]), len(names))
        weight += RATE * (slope - DECAY * weight)
    return dict(zip(names.tolist(), weight.tolist(), strict=True))


def classifier(found: DataFrame) -> dict[tuple[int, int], float]:
    """P(personal data) of each (kind, pattern) that occurs; ``found`` has the ``candidates``."""
    rows = found.select(F.explode("candidates").alias("c")).groupBy("c.order", "c.pattern").agg(F.count("*").alias("n")).collect()
    counts = {(r["order"], r["pattern"]): r["n"] for r in rows}
    _, post = reliabilities(counts)
    weight = fitted(counts, post)
    return {k: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight.get(x, 0.0) for x in features(*k)))))) for k in counts}


def detect(docs: DataFrame, text_col: str = "text", sure: float = SURE, name: str = "spans") -> DataFrame:
    """``docs`` without the text, with ``spans``: base spans and the added ones. A column of the input that has this
    ``name`` is replaced."""
    own = f"candidates_{uuid.uuid4().hex}"
    found = written(docs.withColumn(own, candidates(docs, text_col)).drop(text_col), "pii")
    accepted = sorted(KINDS[k] + ":" + str(p) for (k, p), prob in classifier(found.select(F.col(own).alias("candidates"))).items() if k >= BASE and prob >= sure)
    sure_of = F.array(*map(F.lit, accepted)).cast("array<string>")
    base = F.filter(own, lambda c: (c.order < BASE) & c.valid)
    added = F.filter(own, lambda c: (c.order >= BASE) & F.array_contains(sure_of, F.concat_ws(":", c.kind, c.pattern.cast("string"))))
    both = F.struct(base.alias("base"), added.alias("added"))
    return found.withColumn(name, let(both, lambda b: F.concat(b.base, clear_of(b.added, b.base)))).drop(own)
