"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every historical version of every path is content-addressed by the SHA-256 of its text. The ledger has a row for each
blob with the rule versions it has been scanned by and what they found. A run scans each distinct blob once, by just
those rule versions that the ledger lacks for it, and joins findings back to all paths that hold the blob. Copies,
even a third of all rows, cost one scan; the join back meets hot blobs on its left side only, which Spark can split. ``scan``
takes a ledger as a table; ``scan_into`` keeps one on disk, run after run, with the versions of every path.

Defined results: null text counts as empty; a very long text is scanned whole; findings of two rules may overlap or tie and
all stand; repeated rows give repeated results; an empty table gives no rows and an empty ledger; extra columns of the
input pass through ``scan``, but ``blob`` and ``findings`` are its own and replace columns of these names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .spans import cut_out, matches


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: The group that is the secret itself, and its least length in code points.
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Names and shapes of the base rules and of three widely published token formats.
# A key block: its header lines and base64 up to its own END; without END the lines of base64, also where line breaks
# are blanks, quoted or escaped, and a last shorter one alone on its line. Loops of groups are possessive, which Java runs without recursion.
_BREAK = r"(?:[\s\x22',>|]|\\[nr])"
PEM = (
    r"-----BEGIN ([A-Z ]{0,20})PRIVATE KEY-----"
    + rf"(?:{_BREAK}{{0,8}}+(?:[A-Za-z0-9-]{{1,40}}+:\x20[^\r\n\\]{{0,200}}+{_BREAK}{{1,8}}+){{0,8}}+"
    + r"(?:[A-Za-z0-9+/=\s\\\x22',>|]*+-----END \1PRIVATE KEY-----"
    + rf"|(?:{_BREAK}{{0,8}}+[A-Za-z0-9+/]{{24,}}+={{0,2}}+)++(?:{_BREAK}{{1,8}}+[A-Za-z0-9+/]{{1,23}}+={{0,2}}+(?=[\r\n\\\x22']|\z))?+))?+"
)
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(?=[psta])(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}+"),
    Rule("hex", 1, r"[0-9a-f](?<![0-9a-f][0-9a-f])[0-9a-f]{23,}+"),
)
MORE_RULES = (
    Rule("pem", 3, PEM),
    Rule("jwt", 1, r"e(?<![A-Za-z0-9_-]e)yJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("github", 1, r"g(?<![A-Za-z0-9_]g)h[pousr]_[A-Za-z0-9]{36,}+"),
)
RULES = BASE_RULES + MORE_RULES
FINDINGS = "array<struct<start:bigint,order:int,end:bigint,kind:string,rule:string>>"
LEDGER = f"blob string, rules array<string>, findings {FINDINGS}"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def found_by(text: Column, rule: Rule, order: int) -> Column:
    spans = matches(text, rule.pattern, rule.group)
    if rule.least > 1:
        spans = F.filter(spans, lambda s: F.length(s.part) >= rule.least)
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(order).alias("order"), s.end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule")))


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], text_col: str = "text") -> DataFrame:
    """Each distinct blob that lacks some rule version: ``blob``, ``text``, ``missing``."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    blobs = docs.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        return blobs.withColumn("missing", keys)
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    return blobs.join(seen.hint("merge"), "blob", "left").select("blob", "text", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))).alias("missing")).where(F.size("missing") > 0)


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows to append to the ledger."""
    none = F.array().cast(FINDINGS)
    each = [F.when(F.array_contains("missing", r.key), found_by(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules)]
    return unseen(docs, ledger, rules, text_col).select("blob", F.col("missing").alias("rules"), F.concat(*each).cast(FINDINGS).alias("findings"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``blob`` and the ``findings`` of ``rules``, and the grown ledger."""
    added = written(scan_unseen(docs, ledger, rules, text_col), "ledger")
    grown = added if ledger is None else ledger.unionByName(added)
    keys = [r.key for r in rules]
    of_blob = grown.where(F.size("findings") > 0).select("blob", F.filter("findings", lambda f: f.rule.isin(keys)).alias("findings"))
    if ledger is not None:
        of_blob = of_blob.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    out = docs.drop("findings").withColumn("blob", blob_of(F.col(text_col))).join(of_blob.hint("merge"), "blob", "left")
    return out.withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS))), grown


def ledger_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of a ledger on disk; empty before its first run."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_into(docs: DataFrame, path: str, version: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One run of a ledger that lasts, in the folder ``path``: ``docs`` are the paths' texts as of ``version``. Blobs that lack a rule version are
    scanned by just that one and appended to ``blobs``; the blob of each path is appended to ``versions``. A run that is
    lost between the two is made up by running it again, which scans nothing twice. Gives ``docs`` with ``blob`` and the
    findings of ``rules``, as ``scan`` does."""
    spark = docs.sparkSession
    before = ledger_table(spark, path, "blobs", f"{LEDGER}, version string")
    added = scan_unseen(docs, before.drop("version"), rules, text_col).withColumn("version", F.lit(version))
    added.write.mode("append").parquet(f"{path}/blobs")
    held = docs.select(F.col(id_col).cast("string").alias("path"), F.lit(version).alias("version"), blob_of(F.col(text_col)).alias("blob")).distinct()
    held.write.mode("append").parquet(f"{path}/versions")
    return with_findings(docs.withColumn("blob", blob_of(F.col(text_col))), ledger_table(spark, path, "blobs", f"{LEDGER}, version string"), rules)


def with_findings(rows: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``rows`` that hold a ``blob`` with the ``findings`` that a ledger has for it by these rules."""
    keys = [r.key for r in rules]
    of_blob = ledger.where(F.size("findings") > 0).groupBy("blob").agg(F.filter(F.flatten(F.collect_list("findings")), lambda f: f.rule.isin(keys)).alias("findings"))
    return rows.drop("findings").join(of_blob.hint("merge"), "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS)))


def history(spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every version of every path with its findings: ``path, version, blob, findings``."""
    versions = ledger_table(spark, path, "versions", "path string, version string, blob string").distinct()
    return with_findings(versions, ledger_table(spark, path, "blobs", f"{LEDGER}, version string"), rules)


def redacted(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping findings replaced by ``mark``. Positions are code points."""
    return cut_out(text, findings, mark)
