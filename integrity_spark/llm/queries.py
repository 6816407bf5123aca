"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, minhash, mixing, packing, pii, prefix_trie, repetition, secrets, sharding, suffix_dedup, token_counts, turn_repair
from ..sources.shared import shared_dir
from .common import read_table, written
from .oracles import ORACLES  # noqa: F401
from .spans import listed


#: The mix of op3: each marginal's share of tokens to this power, as multilingual corpora are often tempered.
MIX_FLATTEN = 0.7


def span_digest(spans: str, kinds: Sequence[str]) -> list[Column]:
    """Counts of the base kinds (the first in their operator's order), the hash of their list, and the list of all."""
    base = F.filter(spans, lambda s: s.order < len(kinds))
    counts = [F.size(F.filter(spans, lambda s: s.order == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(kinds)]
    return [*counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col(spans)).alias("spans")]


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detect(docs).select("doc_id", *span_digest("spans", pii.KINDS[: pii.BASE]))


def op2_secret_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one ledger: the first version holds the documents of every other source, and is scanned by the base rules alone;
    the second holds all documents, so what the first has seen is scanned by the other rules only."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 2 == 0).alias("early"))
    path = f"{shared_dir(spark)}/llm-ledger-{uuid.uuid4().hex}"
    secrets.scan_into(docs.where("early").drop("early"), path, "1", secrets.BASE_RULES)
    found = secrets.scan_into(docs.drop("early"), path, "2")
    return found.select("doc_id", *span_digest("findings", [r.kind for r in secrets.BASE_RULES]))


def op3_mixing_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    feats = written(mixing.features(docs).drop("text"), "features")
    cells = written(mixing.raked(feats, flatten=MIX_FLATTEN), "cells")
    return mixing.sample(feats, cells).select("doc_id", "source", "lang", "topic", "tokens", "probability", "sampled", F.lit(cells.agg(F.max("gap")).first()[0]).alias("gap"))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT cast(-1 AS bigint) AS conv_id, turn, role, '{control}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    made = written(chat.windows(turns.unionByName(more)), "windows")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    back = made.withColumn("turns", chat.fresh_turns(made)).select("conv_id", "window", F.size("turns").alias("n"), said.alias("said"), chat.masked_text(made).alias("target"), F.length("formatted").alias("chars"))
    whole = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "target"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    joined = {name: F.array_join(F.col(f"w.{name}"), "") for name in ("said", "target")}
    return whole.select("conv_id", "n_turns", F.sha2(joined["said"].cast("binary"), 256).alias("turns_sha256"), F.length(joined["target"]).cast("long").alias("loss_chars"), F.sha2(joined["target"].cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op5_packing_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_sharding_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_suffix_dedup_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.quality_rules(docs).select("doc_id", F.col("quality.*"))


def op10_ann_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(ann.valid(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    found = ann.nearest(ann.index(rows), rows.where("id % 20 = 0"), top=20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by the hash of conversation and turn; ``gone`` marks the dropped ones."""
    own = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    hit = (F.crc32(F.concat(own["conv_id"], F.lit(":"), own["turn"]).cast("binary")) % 20).alias("hit")
    t = turns.select("conv_id", "turn", own["role"].alias("role"), own["text"].alias("text"), hit)
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy")
    return t.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("hit") == 0).alias("gone"), copies)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged(read_table(spark, sf_dir, "conversations"))
    return turn_repair.summary(*turn_repair.repaired(turns, gone=F.col("gone"))).withColumnRenamed("conv", "conv_id")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "tokens.*")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_ids(read_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_weak_supervision": op1_pii_weak_supervision,
    "op2_secret_blob_ledger": op2_secret_blob_ledger,
    "op3_mixing_raking": op3_mixing_raking,
    "op4_chat_windows": op4_chat_windows,
    "op5_packing_min_bin_slack": op5_packing_min_bin_slack,
    "op6_sharding_bounded_ring": op6_sharding_bounded_ring,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_suffix_dedup_bwt": op8_suffix_dedup_bwt,
    "op9_quality_repetition": op9_quality_repetition,
    "op10_ann_hnsw": op10_ann_hnsw,
    "op11_turn_repair": op11_turn_repair,
    "op12_token_counts": op12_token_counts,
    "op13_prefix_trie": op13_prefix_trie,
}
