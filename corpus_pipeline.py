"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet
and read again. All but the last return the columns of ``documents``, whatever these are and however they are called.

Defined results, stage by stage, for odd rows: a null, empty or blank text has fewer than ten words, so the quality rules
reject it; a very long text is judged whole, by every stage. Of near-duplicates the row with the smallest id stays, and
repeated rows of that id stay together, as do rows of null id. Secrets that overlap are masked as one. Null
sources and languages are values of the mix; rows of one id are drawn together. Packing takes every row that is left;
lengths that tie are dealt by id. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from integrity_spark.llm import minhash, mixing, packing, repetition, secrets
from integrity_spark.llm.common import read_table, written

#: Least similarity of near-duplicates in percent, of sets of five-word shingles.
NEAR = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carried(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and the whole row in ``row``, out of reach of the names that operators give their results."""
    return docs.select(*columns, F.struct(*docs.columns).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the repetition rules go."""
    return repetition.quality_rules(carried(docs, "text")).where("quality.kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays."""
    found = written(minhash.near_duplicates(docs.select("doc_id", "text"), threshold=NEAR), "kept")
    gone = found.where("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes."""
    found, _ledger = secrets.scan(carried(docs, "text"))
    kept = {c: F.col(f"row.{c}") for c in docs.columns}
    kept["text"] = secrets.redacted(F.col("text"), F.col("findings"))
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.size("findings") > 0, F.length(kept["text"])).otherwise(kept["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*(column.alias(c) for c, column in kept.items()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities that meet the raked source, language and topic weights. Topics and tokens
    are found once."""
    feats = written(mixing.features(carried(docs, "doc_id", "source", "lang", "text")).drop("text"), "features")
    return mixing.sample(feats, mixing.raked(feats)).where("sampled").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their sequence and place in it."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("mixing", mix),
    ("packing", pack),
]

#: MinHash candidates, raking to a tolerance and the tokenizer have no SQL form; tests/llm holds the rows against a
#: brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
